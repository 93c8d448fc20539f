"""Balanced contiguous shards by global byte-size prefix sums.

Rows are put in one global order, each partition of it reports its byte total, the
totals' prefix sums give every partition its offset, and a row belongs to the shard in
which the middle of its bytes falls when the whole is cut at equal targets. Sizes then
differ by less than the largest row. The order is by text digest, then id: equal texts
lie side by side, so a group of copies is parted only where a cut falls into it, and a
group of any size is dealt over partitions by id.

Defined results: a null text has one byte; repeated rows are kept and ordered side by
side; an empty table gives no rows; rows larger than a shard leave shards empty. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, materialize


def assign(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of docs (doc_id, text).

    Texts are read once and not shuffled: what is sorted is the id, size and digest. One
    row for each partition comes to the driver.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("binary")
    light = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("").cast("binary"))).alias("text_crc32"),
        F.md5(F.coalesce(text, F.lit("").cast("binary"))).alias("_digest"),
    )
    ordered = materialize(
        light.repartitionByRange("_digest", "doc_id").sortWithinPartitions("_digest", "doc_id", "text_crc32", "size")
        .withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()),
        "shards",
    )
    totals = ordered.groupBy("_part").agg(F.sum("size").alias("size")).orderBy("_part").collect()
    offsets, whole = [], 0
    for r in totals:
        offsets.append((r["_part"], whole))
        whole += r["size"]
    # a row for each partition, and below one more for each shard: as many as shuffle partitions
    sent = F.broadcast if len(offsets) + shards <= MOST_BROADCAST else lambda small: small
    offset = sent(spark.createDataFrame(offsets, "_part int, _offset long"))
    inside = Window.partitionBy("_part").orderBy("_at")
    end = F.sum("size").over(inside) + F.col("_offset")
    # twice the middle byte keeps the arithmetic whole
    shard = F.expr(f"cast(((2 * _end - size) * {shards}) div {max(2 * whole, 1)} as int)")
    placed = ordered.join(offset, "_part").withColumn("_end", end).withColumn("shard", F.least(shard, F.lit(shards - 1)))
    # slots: the rows of a shard before this partition, then those in it
    counts = placed.groupBy("shard", "_part").count()
    placed_counts = sorted(((r["shard"], r["_part"], r["count"]) for r in counts.collect()))
    before, rows = {}, []
    for s, p, n in placed_counts:
        rows.append((s, p, before.get(s, 0)))
        before[s] = before.get(s, 0) + n
    base = sent(spark.createDataFrame(rows, "shard int, _part int, _base long"))
    slot = F.col("_base") + F.row_number().over(Window.partitionBy("_part", "shard").orderBy("_at")) - 1
    return placed.join(base, ["shard", "_part"]).select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"))
