"""Proportional stratified interleaving into shards.

Rows are shuffled within their source by a seeded hash and ranked; the fractional rank
(rank - 1/2) / (rows of the source) places every source evenly over the unit interval. Sorted by it, any
run of rows has the sources in the mixture's proportions, so equal cuts give shards that all match.

Ranking and cutting are done in two steps: rows are counted by (source, hash bucket) and by interval
of the fractional rank, so a source with a third of all rows is ranked by many tasks. The number of
buckets follows the row count. Only these counts, never rows, are summed over one partition.

Edge cases: a null source is a source of its own; null or empty text has size 1 and CRC 0; repeated rows
are ranked one after the other (ties by hash, id and text CRC); an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _ranked(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Adds the 0-based rank of each row within its keys, in the order of (bucket, order)."""
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    df = df.withColumn("_within", F.row_number().over(within) - 1)
    renamed = offsets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), "_before")
    same = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(renamed, same).withColumn(name, F.col("_within") + F.col("_before")).drop("_bucket", "_b", "_within", "_before", *[f"_k{i}" for i in range(len(keys))])


def stratified_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = 8, seed: int = 17, rows_per_bucket: int = 1024) -> DataFrame:
    """(doc id, source, size, text_crc32, fraction, shard, slot) for every row of df.

    Row counts of shards differ by one at most; slots count from 0 without gaps.
    """
    total = df.count()
    buckets = max(1, -(-total // rows_per_bucket))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
    tie = [F.col("_h"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    spread = F.floor((F.shiftrightunsigned("_h", 1) / F.lit(float(1 << 63))) * buckets)
    tie_h = [F.shiftrightunsigned("_h", 1), *tie]
    rows = _ranked(rows, ["source"], spread, tie_h, "_rank")
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("_rows")).withColumnRenamed("source", "_source")
    rows = rows.join(sizes, F.col("source").eqNullSafe(F.col("_source"))).withColumn("fraction", (F.col("_rank") + 0.5) / F.col("_rows")).drop("_source", "_rows", "_rank")
    interval = F.floor(F.col("fraction") * buckets)
    rows = _ranked(rows.withColumn("_all", F.lit(0)), ["_all"], interval, [F.col("fraction"), F.col("source"), *tie], "_place")
    base, extra = divmod(total, shards)
    wide = extra * (base + 1)
    place = F.col("_place")
    shard = F.when(place < wide, F.floor(place / (base + 1))).otherwise(F.lit(extra) + F.floor((place - wide) / max(base, 1)))
    first = F.when(F.col("shard") <= extra, F.col("shard") * (base + 1)).otherwise(F.lit(wide) + (F.col("shard") - extra) * base)
    return rows.withColumn("shard", shard.cast("int")).withColumn("slot", (place - first).cast("long")).drop("_place", "_h", "_all")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = stratified_shards(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", F.round("fraction", 9).alias("fraction"))
