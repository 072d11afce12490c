"""Sharding by sampled splitters (native).

Keys are digests of the texts, so copies lie together. A sample of rows, drawn with a chance in proportion to size,
gives quantile boundaries for many more ranges than shards; the boundaries are found again through a small cell
table (an equality join and a short comparison, no nested loop). Exact bytes of each range are then counted. A range
that is overfull (one text with very many copies) is subdivided by the digest of the document key. Ranges in key
order are laid end to end and cut into shards at equal bytes. Slots are counted in buckets of about `bucket_rows`
rows within each part, so no task orders more than that however large the table is.

Law: `bytes`. Sizes of shards differ by a fraction of a range from each other; copies of one text share a shard but
where a boundary falls into a subdivided range, i.e. for a text with more than `overfull` of a shard's bytes.

Edge cases: null text counts no bytes beside the overhead and has the key of its own empty digest; its crc32 is null;
repeated rows each get their own slot; rows with a null key are told apart by their text, and with one text they lie
in one part; an empty table gives an empty table. Input columns with the names of output
columns are replaced; the prefix `__sh_` is reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, digest, quoted, unit, without

OUT = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
#: Keys are the first 48 bits of a digest, cells its first 12 bits.
CELL = 1 << 36


def splitters(rows: DataFrame, total: int, ranges: int, per_range: int) -> DataFrame:
    """Boundaries (ascending, distinct) from a size-weighted sample of about ranges * per_range draws, a number that
    depends on parameters alone. A key that alone fills a range gets a boundary on both sides."""
    rate = ranges * per_range / max(1, total)
    draws = F.floor(F.col("size") * rate + unit(F.md5(F.concat(F.col("__sh_tie"), F.lit("draw")).cast("binary")))).cast("long")
    sample = rows.select(F.col("__sh_key"), draws.alias("__sh_m")).filter("__sh_m > 0").groupBy("__sh_key").agg(F.sum("__sh_m").alias("__sh_m"))
    order = Window.orderBy("__sh_key")
    sample = sample.withColumn("__sh_end", F.sum("__sh_m").over(order)).withColumn("__sh_all", F.sum("__sh_m").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    slot = lambda c: F.floor(c * ranges / F.col("__sh_all"))
    crossed = slot(F.col("__sh_end")) - slot(F.col("__sh_end") - F.col("__sh_m"))
    sample = sample.withColumn("__sh_x", crossed).filter("__sh_x > 0")
    both = F.when(F.col("__sh_x") > 1, F.array(F.col("__sh_key"), F.col("__sh_key") + 1)).otherwise(F.array(F.col("__sh_key")))
    return sample.select(F.explode(both).alias("__sh_b")).distinct()


def cells(bounds: DataFrame) -> DataFrame:
    """For each of 4096 cells of the key space: how many boundaries lie before it, and those within it."""
    spark = bounds.sparkSession
    inside = bounds.groupBy(F.floor(F.col("__sh_b") / CELL).cast("long").alias("__sh_cell")).agg(F.collect_list("__sh_b").alias("__sh_in"))
    full = spark.range(4096).withColumnRenamed("id", "__sh_cell").join(inside, "__sh_cell", "left").withColumn("__sh_in", F.coalesce("__sh_in", F.array().cast("array<long>")))
    before = Window.orderBy("__sh_cell").rowsBetween(Window.unboundedPreceding, -1)
    return full.withColumn("__sh_before", F.coalesce(F.sum(F.size("__sh_in")).over(before), F.lit(0)))


def shard(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", overhead: int = 16, ranges_per_shard: int = 32, per_range: int = 32, overfull: float = 0.125, bucket_rows: int = 65_536) -> DataFrame:
    """All columns of docs, and size, text_crc32, law, shard, slot, grown_shard. See the module."""
    keep = without(docs, OUT)
    t = quoted(text)
    rows = docs.select(*[quoted(c) for c in keep], (F.coalesce(F.octet_length(t), F.lit(0)) + overhead).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.md5(F.coalesce(t, F.lit("")).cast("binary")).alias("__sh_digest"), digest(quoted(key), t).alias("__sh_tie"))
    rows = rows.withColumn("__sh_key", F.conv(F.substring("__sh_digest", 1, 12), 16, 10).cast("long"))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # bounded by parameters: 4096 cells and at most 2 * shards * ranges_per_shard boundaries
    lookup = F.broadcast(cut(cells(cut(splitters(rows, total, shards * ranges_per_shard, per_range), "shard-bounds")), "shard-cells"))
    rows = rows.withColumn("__sh_cell", F.floor(F.col("__sh_key") / CELL).cast("long")).join(lookup, "__sh_cell")
    rows = rows.withColumn("__sh_range", (F.col("__sh_before") + F.size(F.filter("__sh_in", lambda b: b <= F.col("__sh_key")))).cast("long"))
    fill = total / shards
    parts = rows.groupBy("__sh_range").agg(F.sum("size").alias("__sh_bytes"), F.count("*").alias("__sh_rows"))
    split = F.when(F.col("__sh_bytes") > overfull * fill, F.ceil(F.col("__sh_bytes") * ranges_per_shard / max(1.0, fill))).otherwise(1).cast("long")
    parts = parts.select("__sh_range", split.alias("__sh_parts"), F.ceil(F.col("__sh_rows") / split / bucket_rows).cast("long").alias("__sh_buckets"))
    parts = F.broadcast(cut(parts, "shard-parts"))  # a row for each range at most
    rows = rows.join(parts, "__sh_range").withColumn("__sh_part", F.floor(unit(F.col("__sh_tie")) * F.col("__sh_parts")).cast("long"))
    rows = rows.withColumn("__sh_bucket", F.floor(unit(F.substring("__sh_tie", 13, 12)) * F.col("__sh_buckets")).cast("long"))
    # a row for each part and bucket: written once, for it grows (by one for bucket_rows rows)
    sums = cut(rows.groupBy("__sh_range", "__sh_part", "__sh_bucket").agg(F.sum("size").alias("__sh_bytes"), F.count("*").alias("__sh_rows")), "shard-buckets")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.groupBy("__sh_range", "__sh_part").agg(F.sum("__sh_bytes").alias("__sh_bytes"), F.sum("__sh_rows").alias("__sh_rows"))
    middle = F.coalesce(F.sum("__sh_bytes").over(before(Window.orderBy("__sh_range", "__sh_part"))), F.lit(0)) + F.col("__sh_bytes") / 2
    ends = ends.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(float(max(1, total))))).cast("int"))
    first = F.coalesce(F.sum("__sh_rows").over(before(Window.partitionBy("shard").orderBy("__sh_range", "__sh_part"))), F.lit(0))
    # ranges and their parts: at most 3 * shards * ranges_per_shard rows
    ends = F.broadcast(cut(ends.withColumn("__sh_first", first).select("__sh_range", "__sh_part", "shard", "__sh_first"), "shard-ranges"))
    place = ["__sh_range", "__sh_part", "__sh_bucket"]
    into = F.coalesce(F.sum("__sh_rows").over(before(Window.partitionBy("__sh_range", "__sh_part").orderBy("__sh_bucket"))), F.lit(0))
    sums = sums.withColumn("__sh_into", into).join(ends, ["__sh_range", "__sh_part"]).select(*place, "shard", (F.col("__sh_first") + F.col("__sh_into")).alias("__sh_first"))
    rows = rows.join(cut(sums, "shard-slots"), place)
    order = Window.partitionBy(*place).orderBy("__sh_digest", "__sh_tie", "size")
    rows = rows.withColumn("slot", (F.col("__sh_first") + F.row_number().over(order) - 1).cast("long"))
    rows = rows.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))
    return rows.select(*[quoted(c) for c in keep], *OUT)
