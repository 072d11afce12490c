"""Mixing sources to target weights by a time-varying curriculum (native).

Each source has a weight schedule over training time t in [0, 1]: its weight times 1 + ramp * (2 t - 1). The integral
over the whole run is the weight, so it fixes how many words the source gives (`targets`); the integral up to t is
its cumulative demand. A document's place in its source's pass is an amount of words, and the inverse of the
cumulative demand turns this amount into a training position. Output is range-sorted by position.

Nothing here gathers a source in one task: cumulative sums come from sums over hash buckets of about `bucket_rows`
rows, then from a window within each bucket; the buckets themselves are summed by runs of `run_buckets`, so a source
with a third of all rows spreads over all tasks at every step.

Edge cases: null text has size 0; a null source is a source of its own, last in order; a row of size 0 takes 0 words
and has no positions; rows without a position come after all others, in order of their digest; a source whose sizes
are all 0 has target 0; equal and repeated rows each take their own place (order is by the digest of the key, then
size); rows with a null key are ordered by the digest of their text; an empty table gives an empty table. Input
columns with the names of output columns are replaced; the prefix `__mx_` is reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, digest, quoted, unit, without

WEIGHTS = (5, 2, 1)
RAMPS = (0.0, 0.5, -0.5)
OUT = ["size", "source_size", "target", "taken", "position", "positions"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = 1.5, cap: float = 2.0, weights=WEIGHTS, ramps=RAMPS) -> DataFrame:
    """Water-filling over a table (source, source_size, ...) with one row for each source.

    Sources in order of cap over weight are full up to some place in that order; the rest share what is left by
    weight. The level after k full sources is (total - their caps) / (weights of the others), and the first k whose
    level fills nobody else is the answer, so sums over the ordered table replace repeated resharing.
    """
    everyone = Window.orderBy(F.col("source").isNull(), F.col("source"))
    n = F.row_number().over(everyone) - 1
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("__mx_n") % len(values) + 1).cast("int"))
    df = sources.withColumn("__mx_n", n).withColumn("__mx_w", pick(weights)).withColumn("ramp", pick(ramps))
    df = df.withColumn("__mx_cap", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("__mx_cap") / F.col("__mx_w"), F.col("__mx_n"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn("__mx_left", F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("__mx_cap").over(before), F.lit(0.0)))
    df = df.withColumn("__mx_rest", F.sum("__mx_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    df = df.withColumn("__mx_level", F.col("__mx_left") / F.col("__mx_rest"))
    fits = F.col("__mx_level") * F.col("__mx_w") <= F.col("__mx_cap")
    df = df.withColumn("__mx_at", F.min(F.when(fits, F.struct(F.col("__mx_cap") / F.col("__mx_w"), F.col("__mx_n"), F.col("__mx_level")))).over(whole))
    me = F.struct(F.col("__mx_cap") / F.col("__mx_w"), F.col("__mx_n"))
    full = F.col("__mx_at").isNull() | (me < F.struct(F.col("__mx_at.col1"), F.col("__mx_at.__mx_n")))
    target = F.when(full, F.col("__mx_cap")).otherwise(F.least(F.col("__mx_cap"), F.col("__mx_at.__mx_level") * F.col("__mx_w")))
    return df.withColumn("target", target).drop("__mx_n", "__mx_w", "__mx_cap", "__mx_left", "__mx_rest", "__mx_level", "__mx_at")


def when_demanded(part: Column, ramp: Column) -> Column:
    """Training time at which the share `part` of a source's words has been demanded: solves t + ramp (t^2 - t) = part."""
    b = F.lit(1.0) - ramp
    root = (F.sqrt(b * b + F.lit(4.0) * ramp * part) - b) / (F.lit(2.0) * ramp)
    return F.when(F.abs(ramp) < 1e-9, part).otherwise(root)


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, cap: float = 2.0, weights=WEIGHTS, ramps=RAMPS, bucket_rows: int = 4_096, run_buckets: int = 4_096, sort: bool = True) -> DataFrame:
    """All columns of docs, and size, source_size, target, taken, position (of the first pass) and positions (of each
    pass that takes words of the row), range-sorted by position. See the module."""
    keep = without(docs, OUT)
    base = docs.select(*[quoted(c) for c in keep], word_count(quoted(text)).alias("size"), quoted(source).alias("__mx_source"), digest(quoted(key), quoted(text)).alias("__mx_digest"))
    totals = base.groupBy(F.col("__mx_source").alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("__mx_rows"))
    totals = cut(targets(totals, share, cap, weights, ramps), "mix-sources").withColumnRenamed("source", "__mx_of")
    dealt = base.join(totals, F.col("__mx_source").eqNullSafe(F.col("__mx_of")))
    dealt = dealt.withColumn("__mx_bucket", F.floor(unit(F.col("__mx_digest")) * F.ceil(F.col("__mx_rows") / bucket_rows)).cast("long"))
    sums = dealt.groupBy("__mx_source", "__mx_bucket").agg(F.sum("size").alias("__mx_sum"))
    sums = sums.withColumn("__mx_run", F.floor(F.col("__mx_bucket") / run_buckets))
    ahead = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    runs = sums.groupBy("__mx_source", "__mx_run").agg(F.sum("__mx_sum").alias("__mx_sum"))
    runs = runs.select(F.col("__mx_source").alias("__mx_of3"), F.col("__mx_run").alias("__mx_run3"), before("__mx_sum", ahead(["__mx_source"], "__mx_run")).alias("__mx_first"))
    sums = sums.join(runs, F.col("__mx_source").eqNullSafe(F.col("__mx_of3")) & (F.col("__mx_run") == F.col("__mx_run3")))
    sums = sums.withColumn("__mx_offset", F.col("__mx_first") + before("__mx_sum", ahead(["__mx_source", "__mx_run"], "__mx_bucket")))
    sums = cut(sums, "mix-buckets").select(F.col("__mx_source").alias("__mx_of2"), F.col("__mx_bucket").alias("__mx_bucket2"), "__mx_offset")
    dealt = dealt.join(sums, F.col("__mx_source").eqNullSafe(F.col("__mx_of2")) & (F.col("__mx_bucket") == F.col("__mx_bucket2")))
    within = Window.partitionBy("__mx_source", "__mx_bucket").orderBy("__mx_digest", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("__mx_offset") + F.coalesce(F.sum("size").over(within), F.lit(0))
    dealt = dealt.withColumn("__mx_start", start)
    passes = F.sequence(F.lit(0), F.lit(max(0, int(-(-cap // 1)) - 1)))
    whole = F.floor(F.col("target"))
    left = lambda i: whole - i * F.col("source_size") - F.col("__mx_start")
    took = F.aggregate(F.transform(passes, lambda i: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left(i)))), F.lit(0).cast("long"), lambda a, x: a + x)
    hit = F.filter(passes, lambda i: (F.col("size") > 0) & (left(i) > 0))
    places = F.transform(hit, lambda i: when_demanded((i * F.col("source_size") + F.col("__mx_start")) / whole, F.col("ramp")))
    out = dealt.withColumn("taken", took).withColumn("positions", places).withColumn("position", F.try_element_at("positions", F.lit(1)))
    if sort:
        # rows without a position have places of their own beyond the last one
        out = out.withColumn("__mx_place", F.coalesce(F.col("position"), F.lit(2.0) + unit(F.col("__mx_digest"))))
        out = out.repartitionByRange("__mx_place").sortWithinPartitions("__mx_place")
    return out.select(*[quoted(c) for c in keep], *OUT)
