"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Each document of a source is expected ``target / source_size`` times in the mix. The expected copies are
summed along an order of the source's documents, one random offset per source is added, and a document
is taken once for each whole number that the sum crosses at it. The order runs from short to long documents
(by the leading digits of the size, then at random), so that the words taken stay near the target.

Sums are made in units of 2 ** -32 copies, in whole numbers: they agree whatever the order of addition. A
source's documents are cut into buckets along the order; bucket totals give each bucket its start, so no task
sums a whole source.

Results in odd cases: null sources are one source, the last; null or empty texts have size 0, may be taken,
and count nothing; a very long text is one row of its size; rows that repeat a ``doc_id`` are drawn one by one, and
``mixed`` gives each what it drew, told apart by a 64-bit hash of the row (rows alike in all columns share what they drew
together, to the copy); a null ``doc_id`` counts as the smallest, and such rows are drawn by the hash of what they hold;
an empty table gives no rows; other columns are not read by ``copies``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.llm.shared import NO_ID, given, number, written

WORD = r"[^\x20\x09-\x0D]+"
#: One copy in the units of the sums.
UNIT = 1 << 32
#: Rows of a bucket that one task sums along.
BUCKET_ROWS = 2_000


def _uniform(*parts: Column | str) -> Column:
    """A number from 0 to UNIT - 1 that depends on the parts alone."""
    return F.conv(F.substring(F.md5(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])), 1, 8), 16, 10).cast("long")


def targets(sized: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``key``, ``source_size`` and ``target`` of each source.

    Sources in code point order, null last, have the weights in turn and share ``share`` of all words. A target
    stops at ``cap`` times its source's size; what is over goes to the others by weight. The level of words per
    weight follows from the sources in the order in which they reach their caps. One task orders one row per
    source (its name and three numbers), never documents.
    """
    per = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.substring("key", 1, 1).desc(), "key")) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    by_cap = Window.orderBy(F.col("source_size") * F.lit(float(cap)) / F.col("weight"), "key")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(cap))) / F.sum("weight").over(after)
    full = F.col("source_size") * F.lit(float(cap))
    per = per.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= full)
    reached = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    per = per.withColumn("reached", reached)
    return per.select("key", "source_size", F.least(full, F.coalesce(F.col("reached") * F.col("weight"), full)).alias("target"))


def copies(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` and ``copies`` (times it is taken) of every row of ``docs(doc_id, text, source)``."""
    twin = F.when(F.col("doc_id").isNull(), F.xxhash64("text", "source"))
    return _drawn(docs, twin, weights, share, cap, seed).select(given(), "size", "source_size", "target", "copies")


def _drawn(docs: DataFrame, twin: Column, weights: Sequence[float], share: float, cap: float, seed: int) -> DataFrame:
    """What ``copies`` gives, with the document number never null and ``twin``, a number that tells rows of one document number apart."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    sized = written(docs.select(number().alias("doc_id"), key.alias("key"), size.alias("size"), twin.alias("twin")), "sizes")
    digits = F.col("size").cast("string")
    band = F.length(digits) * 100 + F.substring(F.rpad(digits, 2, "0"), 1, 2).cast("int")
    unnumbered = F.when(F.col("doc_id") == NO_ID, F.concat(F.lit(":"), F.col("twin").cast("string"))).otherwise("")
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"), unnumbered))
    largest = sized.groupBy("key", band).count().agg(F.max("count")).first()[0] or 0
    cut = 0  # leading digits of the draw that split a band, so that a bucket has about BUCKET_ROWS rows
    while largest > BUCKET_ROWS * 16**cut:
        cut += 1
    goals = targets(sized, weights, share, cap)
    expected = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * F.lit(float(UNIT)) + 0.5)).otherwise(0)
    rows = sized.select("*", band.alias("band"), drawn.alias("draw")).join(goals, "key")
    rows = rows.select("*", F.substring("draw", 1, cut).alias("part"), expected.cast("decimal(20,0)").alias("expected"))
    bucket = ["key", "band", "part"]
    along = Window.partitionBy("key").orderBy("band", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*bucket).agg(F.sum("expected").alias("total"))
    starts = starts.select(*bucket, (F.coalesce(F.sum("total").over(along), F.lit(0)) + _uniform(f"{seed}:", F.col("key"))).cast("decimal(38,0)").alias("start"))
    inside = Window.partitionBy(*bucket).orderBy("draw", "doc_id", "size", "twin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(starts, bucket).withColumn("to", (F.col("start") + F.sum("expected").over(inside)).cast("decimal(38,0)"))
    crossed = F.expr(f"cast((`to` div {UNIT}) - ((`to` - expected) div {UNIT}) as int)")
    return rows.select("doc_id", "twin", "size", "source_size", "target", crossed.alias("copies"))


#: Copies of rows alike that one task writes in a run.
RUN = 1_000


def mixed(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns."""
    twin = F.xxhash64(*[F.col(f"`{c.name}`") for c in docs.schema if "map<" not in c.dataType.simpleString()])
    drawn = _drawn(docs, twin, weights, share, cap, seed)
    taken = drawn.groupBy("doc_id", "twin").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("rows")).where("copies > 0")
    taken = written(taken.withColumnsRenamed({"doc_id": "_number", "twin": "_twin"}), "copies")
    rows = docs.select(F.struct("*").alias("row"), number().alias("number"), twin.alias("twin"))
    same = (F.col("number") == F.col("_number")) & (F.col("twin") == F.col("_twin"))
    out = rows.join(taken.where("rows = 1"), same).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
    if taken.where("rows > 1").isEmpty():
        return out
    # rows alike: one stands for all and is written in runs, each by the task it falls to
    alike = rows.join(taken.where("rows > 1"), same).groupBy("number", "twin").agg(F.first("row").alias("row"), F.first("copies").alias("copies"))
    runs = alike.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / RUN))).alias("run")).repartition("number", "twin", "run")
    length = F.least(F.lit(RUN), F.col("copies") - F.col("run") * RUN).cast("int")
    return out.unionByName(runs.select("row", F.explode(F.sequence(F.lit(1), length)).alias("copy")).select("row.*"))
