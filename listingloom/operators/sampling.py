"""Shuffles, samples, quotas and splits, reproducible by md5 order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import md5_order
from ..sources.sinks import written


def shuffle(df: DataFrame, seed: int, *key: str) -> DataFrame:
    return df.orderBy(md5_order(seed, *key), *key)


#: Rows that a top-n may hold in a task; larger samples are cut by bucket counts.
MOST_HELD = 100_000


def numbered(df: DataFrame, seed: int, *key: str, by: str | None = None, name: str = "position") -> DataFrame:
    """df with its places from 0, without gaps, in md5 order, those of each value of `by` if given.

    A row's place is that within its bucket (the first md5 digits) and the rows of the buckets
    before, so no task orders all rows. A group has 4096 buckets at most, and so many rows are
    summed up by a task.
    """
    order, group = md5_order(seed, *key), [] if by is None else ["_by"]
    rows = df.withColumn("_at", order).withColumn("_part", F.substring(order, 1, 3))
    rows = rows if by is None else rows.withColumn("_by", F.col(by))
    sums = rows.groupBy(*group, "_part").count()
    before = sums.select(*group, "_part", (F.sum("count").over(Window.partitionBy(*group).orderBy("_part")) - F.col("count")).alias("_before"))
    inside = Window.partitionBy(*group, "_part").orderBy("_at", *key)
    ranked = rows.withColumn("_in", F.row_number().over(inside))
    if by is None:
        ranked = ranked.join(F.broadcast(before), "_part")
    else:
        before = before.withColumnsRenamed({"_by": "_g", "_part": "_p"})
        ranked = ranked.join(before, F.col("_by").eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return ranked.select(*df.columns, (F.col("_in") + F.col("_before") - 1).alias(name))


def batches(df: DataFrame, size: int, seed: int, *key: str) -> DataFrame:
    """df with `batch` and `place`, both from 0: batches of `size` rows in md5 order, the last one may be shorter."""
    ranked = numbered(df, seed, *key, name="_rank")
    return ranked.select(*df.columns, F.floor(F.col("_rank") / size).cast("long").alias("batch"), (F.col("_rank") % size).cast("int").alias("place"))


def cut(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """The first n rows in md5 order, or all if fewer, whatever n.

    Buckets (the first md5 digits) are counted; those wholly below n are kept as they are, those
    beyond are dropped before any shuffle, and only the bucket in which n falls is cut by rank.
    """
    order = md5_order(seed, *key)
    rows = df.withColumn("_at", order).withColumn("_part", F.substring(order, 1, 3))
    sums = rows.groupBy("_part").count()
    # 4096 rows at most
    ends = sums.select(F.col("_part"), F.sum("count").over(Window.orderBy("_part")).alias("_end"), "count").withColumn("_left", F.lit(n) - F.col("_end") + F.col("count"))
    met = rows.join(F.broadcast(ends.where("_left > 0").drop("count")), "_part")
    whole = met.where(F.col("_end") <= n)
    edge = met.where(F.col("_end") > n).withColumn("_in", F.row_number().over(Window.partitionBy("_part").orderBy("_at", *key))).where(F.col("_in") <= F.col("_left"))
    return whole.select(*df.columns).unionByName(edge.select(*df.columns))


def sample(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """n rows, or all if fewer: a bounded top-n, not a full sort; a large n is cut by bucket counts."""
    return df.orderBy(md5_order(seed, *key), *key).limit(n) if n <= MOST_HELD else cut(df, n, seed, *key)


def sample_of_many(df: DataFrame, n: int, count: int, seed: int, *key: str) -> DataFrame:
    """`sample` of a table of about `count` rows, far more than n, that is dear to hold but cheap to make again.

    Of so many rows about 4 n + 100 stand before a bound of the md5 order; only those are kept and
    ordered. Should fewer than n be found, all rows are ordered.
    """
    share = (4 * n + 100) / max(count, 1)
    if share >= 1:
        return sample(df, n, seed, *key)
    few = written(df.where(md5_order(seed, *key) < f"{int(share * 16**12):012x}"), "first-rows")
    return sample(few if few.count() >= n else df, n, seed, *key)


def quota(df: DataFrame, n: int | Column, seed: int, key: list[str], by: list[str | Column] | None = None) -> DataFrame:
    """At most n rows for each value of `by`; a constant n is cut before the shuffle as well."""
    if by is None:
        if not isinstance(n, int):
            raise ValueError("a quota over all rows takes a number")
        return sample(df, n, seed, *key)
    w = Window.partitionBy(*by).orderBy(md5_order(seed, *key), *key)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def split_sizes(n: int, test: float = 0.15, val: float = 0.15) -> tuple[int, int, int]:
    """(train, val, test) row counts."""
    from math import ceil

    n_test = ceil(round(test * n, 9))
    n_val = ceil(round((n - n_test) * (val / (1 - test)), 9))
    return n - n_test - n_val, n_val, n_test


def _shares(counts: dict, part: int) -> dict:
    """part rows dealt to the labels in proportion, by largest remainder, ties to the first label."""
    total = sum(counts.values())
    exact = {k: n * part / total for k, n in counts.items()}
    out = {k: int(v) for k, v in exact.items()}
    for k in sorted(exact, key=lambda k: (out[k] - exact[k], str(k)))[: part - sum(out.values())]:
        out[k] += 1
    return out


def stratified_split(df: DataFrame, label: str, seed: int, key: list[str], test: float = 0.15, val: float = 0.15) -> DataFrame:
    """df with a column `split`: exactly split_sizes rows each, labels in proportion.

    Of each label's md5 order the first rows are test, the next val. Buckets (the first md5 digits) are
    counted; all rows of a bucket but those in which a part ends belong to one part, so only the rows of
    these (two of a label's 4096 at most) are shuffled and ranked. Only the label counts (a row for
    each label) come to the driver.
    """
    order = md5_order(seed, *key)
    rows = df.withColumn("_at", order).withColumn("_part", F.substring(order, 1, 3)).withColumn("_label", F.col(label))
    sums = written(rows.groupBy("_label", "_part").count(), "split-buckets")
    counts = {r[0]: r[1] for r in sums.groupBy("_label").agg(F.sum("count")).collect()}
    if not counts:
        return df.withColumn("split", F.lit("train"))
    _, n_val, n_test = split_sizes(sum(counts.values()), test, val)
    tests = _shares(counts, n_test)
    vals = _shares({k: n - tests[k] for k, n in counts.items()}, n_val)
    ends = df.sparkSession.createDataFrame([(k, tests[k], tests[k] + vals[k]) for k in counts], T.StructType([T.StructField("_l", df.schema[label].dataType), T.StructField("_test", T.LongType()), T.StructField("_val", T.LongType())]))
    end = F.sum("count").over(Window.partitionBy("_label").orderBy("_part"))
    cuts = sums.withColumn("_end", end).withColumn("_before", F.col("_end") - F.col("count")).join(F.broadcast(ends), F.col("_l").eqNullSafe(F.col("_label")))
    inside = lambda n: (F.col("_before") < n) & (F.col("_end") > n)
    told = lambda at: F.when(at < F.col("_test"), "test").when(at < F.col("_val"), "val").otherwise("train")
    cuts = cuts.select("_l", F.col("_part").alias("_p"), "_before", "_test", "_val", F.when(~inside(F.col("_test")) & ~inside(F.col("_val")), told(F.col("_before"))).alias("_split"))
    met = rows.join(cuts, F.col("_l").eqNullSafe(F.col("_label")) & F.col("_p").eqNullSafe(F.col("_part")))
    ranked = met.where("_split is null").withColumn("_in", F.row_number().over(Window.partitionBy("_label", "_part").orderBy("_at", *key)))
    edge = ranked.select(*df.columns, told(F.col("_before") + F.col("_in") - 1).alias("split"))
    return met.where("_split is not null").select(*df.columns, F.col("_split").alias("split")).unionByName(edge)


def negative_quota(positives: DataFrame, negatives: DataFrame, seed: int, key: list[str], ratio: float = 1.5) -> DataFrame:
    """int(positives * ratio) negatives in md5 order: the count is one number for the driver."""
    return cut(negatives, int(positives.count() * ratio), seed, *key)


def mix_sizes(total: int) -> tuple[int, int, int]:
    """Positive, hard and easy negative rows: two fifths, 35 in a hundred, the rest."""
    positive, hard = int(total * 0.40), int(total * 0.35)
    return positive, hard, total - positive - hard
