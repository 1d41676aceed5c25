"""Mixing sources to target weights by Pareto order sampling.

A source's target is its weighted share of a total, at most ``CAP`` times its size; what that limit cuts off goes to the
other sources by weight until none is above. A source of target/size ratio f gives floor(f) certain whole copies of every
document. The words left for it are a Pareto sample of one more copy, of unequal probabilities: a document's inclusion
probability is proportional to its size to the power of ``tilt`` (``TILT``; 0 makes all equal), so longer documents are likelier. It is
scaled so that the expected words are the words left. Documents that would pass 1 are certain, and the rest is scaled anew.
Each other document draws u from a hash of its id, text and a seed; its rank is the odds of u divided by the odds of its
inclusion probability, and the documents of least rank are taken, as many as the words left hold: a sample of fixed size, in
words. Ranks are fixed by the document and its source's scale.

The scale is found on sizes in ``STEPS`` classes an octave, a few hundred sums for each source; all documents of a class have
one probability. The cut among the ranks of a source is found without sorting it: ranks become 48-bit integers, word sums
are taken over ``2**BITS`` bins of them (partial sums first), the bin that holds the cut is opened into as many finer bins, and so
on. What is collected is a bin for each source. Documents that share even the last bin (repeated rows) are written apart,
numbered within the partitions they are in, after the sums of the partitions before.

Defined cases: a null text has size 0 and is taken 0 times its size; a null source is a source, ordered last; ties of rank
(repeated rows) are cut one by one; a source of size 0 has target 0; an empty table gives no rows; extra columns may have any
name, and `mix` keeps them; a text's length matters to its size alone; reruns agree, but for which of some equal rows is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tributary.llm import shared

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP = 1.5, 2.0
BITS, LEVELS = 12, 4
SEED = 20240611
#: The power of a document's size that its inclusion probability is proportional to, and the size classes of an octave.
TILT, STEPS = 0.5, 16
#: Texts at a cut are found by 2**SIFT buckets of their digests.
SIFT = 16
#: Sources are collected with their sizes; more than this many are refused.
MAX_SOURCES = 1_000_000
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict[str | None, float]:
    """The target of each source: by code point, null last, weights repeating; limited, the excess reshared by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-32-be", "surrogatepass")))
    weight = {name: float(weights[k % len(weights)]) for k, (name, _) in enumerate(order)}
    limit = {name: cap * size for name, size in order}
    left = share * sum(size for _, size in order)
    out: dict[str | None, float] = {}
    free = [name for name, _ in order]
    while free:
        total = sum(weight[x] for x in free)
        full = [x for x in free if left * weight[x] / total > limit[x]]
        if not full:
            out |= {x: left * weight[x] / total for x in free}
            break
        for x in full:
            out[x] = limit[x]
        left -= sum(limit[x] for x in full)
        free = [x for x in free if x not in out]
    return out


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORDS)), F.lit(0)).cast("long")


def plan(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target, whole, rest): what each source gives; one row for each source."""
    spark = rows.sparkSession
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    aims = targets([(x.source, x.size) for x in found], weights, share, cap)
    out = []
    for x in found:
        ratio = aims[x.source] / x.size if x.size else 0.0
        whole = min(int(ratio + 1e-12), int(cap))
        out.append((x.source, int(x.size), float(aims[x.source]), whole, max(0.0, aims[x.source] - whole * x.size)))
    return spark.createDataFrame(out, "source string, source_size long, target double, whole long, rest double")


def step() -> Column:
    """The size class of a document; -1 for no words."""
    return F.when(F.col("size") > 0, F.floor(F.log2("size") * STEPS)).otherwise(-1).cast("int")


def pull(tilt: float) -> Column:
    """What a class's inclusion probability is proportional to."""
    return F.pow(F.lit(2.0), F.col("step") * F.lit(tilt / STEPS))


def scales(rows: DataFrame, aims: DataFrame, tilt: float) -> DataFrame:
    """(source, certain, scale, spare): classes of at least `certain` are taken whole, the others with probability scale * pull;
    spare is the words left for these."""
    given = F.broadcast(aims.where("rest > 0").select(F.col("source").alias("of"), "rest"))  # one row for each source
    sums = rows.where("step >= 0").groupBy("source", "step").agg(F.sum("size").alias("size"))
    sums = sums.join(given, F.expr("source <=> of")).withColumn("pull", pull(tilt)).select("source", "step", "rest", "size", "pull")
    up = Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("source").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, -1)
    # if this class is the greatest that is not certain: what is left for it and the lesser ones, and their scale
    sums = sums.withColumn("spare", F.col("rest") - F.coalesce(F.sum("size").over(down), F.lit(0)))
    sums = sums.withColumn("scale", F.col("spare") / F.sum(F.col("size") * F.col("pull")).over(up))
    good = sums.where((F.col("spare") > 0) & (F.col("scale") * F.col("pull") <= 1 + 1e-9))
    return good.groupBy("source").agg(F.max_by(F.struct((F.col("step") + 1).alias("certain"), "scale", "spare"), "step").alias("x")).select("source", "x.certain", "x.scale", "x.spare")


def ranked(rows: DataFrame, tilt: float, seed: int) -> DataFrame:
    """Adds p, the inclusion probability of one more copy, and key, the rank as 48 bits: odds of u over odds of p, mapped to
    (0, 1) in order; for rows that are neither certain nor out of question."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "digest"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    chance = F.least(F.greatest(F.col("scale") * pull(tilt), F.lit(1e-9)), F.lit(1 - 1e-9))
    # rank / (1 + rank), written with u and p once each: repeated, they make methods too long for the JIT compiler
    share = 1 / (1 + (1 / u - 1) / (1 / F.col("p") - 1))
    top = F.lit(float((1 << (BITS * LEVELS)) - 1))
    drawn = (F.col("step") >= 0) & (F.col("step") < F.col("certain"))
    return rows.withColumn("p", F.when(drawn, chance)).withColumn("key", F.least(share * (top + 1), top).cast("long"))


def cuts(rows: DataFrame, aims: DataFrame) -> DataFrame:
    """(source, cut, left): keys below cut are taken; of those at it, as many as `left` words hold; aims: (source, spare)."""
    spark = rows.sparkSession
    state = {x.source: [0, x.spare] for x in aims.collect()}  # one entry for each source
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("prefix", T.LongType()), T.StructField("spare", T.DoubleType())])
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        now = spark.createDataFrame([(k, prefix, spare) for k, (prefix, spare) in state.items()], schema).withColumnRenamed("source", "of")
        open_rows = rows.join(F.broadcast(now), F.expr("source <=> of") & (F.shiftright("key", shift + BITS) == F.col("prefix")))
        bins = open_rows.groupBy("source", F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("size"), F.first("spare").alias("spare"))
        before = F.sum("size").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        bins = bins.withColumn("before", F.coalesce(before, F.lit(0)))
        edge = bins.where("before + size > spare").groupBy("source").agg(F.min_by(F.struct("bin", "before"), "bin").alias("edge"))
        got = {x.source: x.edge for x in edge.collect()}
        for name, (prefix, spare) in list(state.items()):
            if name in got:
                state[name] = [got[name].bin, spare - got[name].before]
            else:  # all of it is taken
                state[name] = [(prefix + 1) << BITS, 0.0]
    return spark.createDataFrame([(k, cut, spare) for k, (cut, spare) in state.items()], T.StructType([schema["source"], T.StructField("cut", T.LongType()), T.StructField("left", T.DoubleType())]))


def copies(docs: DataFrame, text: str = "text", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, keep: bool = False, tilt: float = TILT, seed: int = SEED) -> DataFrame:
    """(row, size, source_size, target, p, copies): each row, and how often the mix takes it; p is the inclusion probability of
    its last copy, null where none is drawn. keep: row has all columns, else doc_id."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if keep else F.struct("doc_id")
    base = docs.select(row.alias("row"), "doc_id", "source", F.xxhash64(F.col(f"`{text}`")).alias("digest"), F.col(f"`{text}`").alias("text"))
    sized = base.select("row", "doc_id", "source", "digest", words("text").alias("size"))
    slim = shared.cut(sized.select("doc_id", "source", "digest", "size").withColumn("step", step()))
    aims = plan(slim, weights, share, cap)
    scale = shared.cut(scales(slim, aims, tilt))
    given = F.broadcast(aims.withColumnRenamed("source", "of"))  # one row for each source, as the next two
    scaled = F.broadcast(scale.select(F.col("source").alias("by"), "certain", "scale"))
    drawn = ranked(slim.join(scaled, F.expr("source <=> by")), tilt, seed).where("p IS NOT NULL")
    edge = cuts(drawn.select("source", "size", "key"), scale)
    held = F.broadcast(edge.withColumnRenamed("source", "at"))

    def settled(rows: DataFrame) -> DataFrame:
        rows = rows.join(given, F.expr("source <=> of")).join(scaled, F.expr("source <=> by"), "left").join(held, F.expr("source <=> at"), "left")
        return ranked(rows, tilt, seed)

    out = near = slim.select(F.struct("doc_id").alias("row"), "doc_id", "source", "digest", "size", "step")
    if keep:
        out = sized.withColumn("step", step())
        # words are counted again for the few texts that may be at a cut, not for all: at most 2**SIFT buckets are broadcast
        bucket = F.pmod("digest", F.lit(1 << SIFT)).alias("bucket")
        few = drawn.join(held, F.expr("source <=> at AND key = cut")).select(bucket).distinct()
        near = base.withColumn("bucket", bucket).join(F.broadcast(shared.cut(few)), "bucket", "left_semi")
        near = near.withColumn("size", words("text")).withColumn("step", step()).select("row", "doc_id", "source", "digest", "size", "step")
    out, near = settled(out), settled(near)
    more = F.when(F.col("p").isNotNull(), F.col("key") < F.col("cut")).otherwise(F.coalesce(F.col("step") >= F.col("certain"), F.lit(False)))
    tie = F.coalesce(F.col("p").isNotNull() & (F.col("key") == F.col("cut")), F.lit(False))
    names = ["row", "size", "source_size", "target", "p"]
    plain = out.where(~tie).select(*names, (F.col("whole") + more.cast("int")).alias("copies"))
    # of the last bin, the rows that begin within the words left and end nearer to them than without
    ties = shared.cut(near.where(tie).select(*names, "source", "doc_id", "digest", "whole", "left", F.spark_partition_id().alias("part")))
    parts = ties.groupBy("source", "part").agg(F.sum("size").alias("sum"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("of"), F.col("part").alias("at"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("source", "part").orderBy("doc_id", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ties = ties.join(parts, F.expr("source <=> of AND part = at")).withColumn("after", F.col("before") + F.sum("size").over(within))
    return plain.unionByName(ties.select(*names, (F.col("whole") + F.when(F.col("after") - F.col("size") / 2 <= F.col("left"), 1).otherwise(0)).alias("copies")))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed documents with all their columns, each as often as the mix takes it."""
    return copies(docs, keep=True).where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = copies(shared.table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
