"""The queries of this package's operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from tributary.llm import chat, decontaminate, langid, licenses, media, mixing, neardup, quality, secret_scan, tokens

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_quality": quality.op2_quality,
    "op3_language_id": langid.op3_language_id,
    "op4_secrets": secret_scan.op4_secrets,
    "op5_media": media.op5_media,
    "op6_chat": chat.op6_chat,
    "op7_token_ids": tokens.op7_token_ids,
    "op8_near_duplicates": neardup.op8_near_duplicates,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_mixing": mixing.op10_mixing,
}
ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op9_license_scan": licenses.ORACLE,
}
