"""Memory that a very long text takes, in a process of its own for each operator."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent.parent
MB = 24
PROBE = """
import resource, sys
import numpy as np, pyarrow as pa
from tributary.llm import {module} as op
rng = np.random.default_rng(1)
words = np.array(["w%d" % k for k in range(50_000)] + ["Some", "line.\\n", "key=aB3xY9zz", "password=hunter22x"], dtype=object)
piece = " ".join(rng.choice(words, 1 << 16))
text = (piece + " ") * ({mb} * (1 << 20) // len(piece))
column = pa.array([text])
size = len(text)
del text
start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
{code}
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - start) * 1024, size)
"""
CASES = {
    "quality": ("op.features(column, np.ones((op.BUCKETS, op.DIM)), np.ones(op.BUCKETS))", 3, 100),
    "secret_scan": ("op.scan(column, op.Crf())", 10, 300),
    "tokens": ("op.encoder_of(op.vocabulary()).encode(*op.as_bytes(column))", 6, 200),
    "neardup": ("op.shingles(*op.as_bytes(column))", 10, 60),
}


@pytest.mark.parametrize("module", sorted(CASES))
def test_memory_of_a_long_text(module):
    code, each, more = CASES[module]
    found = subprocess.run([sys.executable, "-c", PROBE.format(module=module, code=code, mb=MB)], cwd=ROOT, capture_output=True, text=True, timeout=600)
    assert found.returncode == 0, found.stderr
    grown, size = map(int, found.stdout.split())
    print(module, grown / 1e6, size / 1e6)
    assert grown <= each * size + more * 1_000_000
