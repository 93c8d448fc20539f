"""Classification metrics and training bookkeeping as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import col


def value_counts(df: DataFrame, c: str) -> DataFrame:
    return df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.desc("count"), c)


def conditional_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.count_if(F.col(label) == 1).alias("positives"), F.count_if(F.col(label) == 0).alias("negatives"), F.count(F.lit(1)).alias("total"))


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def class_table(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """class, tp, fp, fn, support, precision, recall, f1 for the classes of truth and prediction.

    Rows are first counted by (truth, prediction); all else works on that small table.
    """
    cells = df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    both = cells.select(F.explode(F.array(
        F.struct(F.col("y").alias("class"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.col("n").alias("support")),
        F.struct(F.col("p").alias("class"), F.lit(0).cast("long").alias("tp"), F.when(F.col("y") != F.col("p"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("support")),
    )).alias("x")).select("x.*")
    out = both.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("support").alias("support")).withColumn("fn", F.col("support") - F.col("tp"))
    out = out.withColumn("precision", _share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _share(F.col("tp"), F.col("support")))
    return out.withColumn("f1", _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def accuracy(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))


def binary_metrics(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """accuracy, precision, recall, f1 of class 1."""
    n = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == F.col(p)).alias("hit"), F.count_if((F.col(y) == 1) & (F.col(p) == 1)).alias("tp"),
        F.count_if(F.col(p) == 1).alias("pp"), F.count_if(F.col(y) == 1).alias("ap"),
    )
    n = n.select(_share(F.col("hit"), F.col("n")).alias("accuracy"), _share(F.col("tp"), F.col("pp")).alias("precision"), _share(F.col("tp"), F.col("ap")).alias("recall"))
    return n.withColumn("f1", _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_metrics(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    t = class_table(df, y, p)
    return t.agg(
        _share(F.sum("tp"), F.sum("support")).alias("accuracy"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1")
    )


def compute_metrics(df: DataFrame, y: str = "y", p: str = "p", classes: int = 2) -> DataFrame:
    return binary_metrics(df, y, p) if classes == 2 else macro_metrics(df, y, p)


def classification_report(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Per class, then accuracy, macro avg and weighted avg."""
    t = class_table(df, y, p)
    rows = t.select(F.col("class").cast("string").alias("class"), "precision", "recall", "f1", "support")
    n = F.sum("support")
    total = t.agg(
        _share(F.sum("tp"), n).alias("acc"), *[F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")],
        *[_share(F.sum(F.col(c) * F.col("support")), n).alias(f"w_{c}") for c in ("precision", "recall", "f1")], n.alias("n"),
    )
    more = total.select(F.inline(F.array(
        F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1"), F.col("n").alias("support")),
        *[F.struct(F.lit(name).alias("class"), F.col(f"{k}_precision").alias("precision"), F.col(f"{k}_recall").alias("recall"), F.col(f"{k}_f1").alias("f1"), F.col("n").alias("support")) for k, name in (("m", "macro avg"), ("w", "weighted avg"))],
    )))
    return rows.union(more)


def report_lines(report: DataFrame) -> DataFrame:
    """class, line: a classification report as lines of text, four decimals, blank where there is no value."""
    value = lambda c: F.lpad(F.coalesce(F.format_string("%.4f", c), F.lit("")), 10, " ")
    blank = lambda c: F.when(F.col(c).isNull(), F.lit(" " * 10)).otherwise(value(c))
    return report.select("class", F.concat(F.lpad("class", 32, " "), blank("precision"), blank("recall"), blank("f1"), F.lpad(F.col("support").cast("string"), 12, " ")).alias("line"))


def confusion_matrix(df: DataFrame, labels: list, y: str = "y", p: str = "p") -> DataFrame:
    """A row for each true label, a column for each predicted one."""
    return df.groupBy(F.col(y).alias("y")).pivot(p, labels).count().fillna(0)


def _bucket(c: Column, cuts: list[float], first: int = 0) -> Column:
    """How many of the ascending cuts are no larger than c: a binary search in CASE expressions."""
    if not cuts:
        return F.lit(first)
    m = len(cuts) // 2
    return F.when(c < cuts[m], _bucket(c, cuts[:m], first)).otherwise(_bucket(c, cuts[m + 1 :], first + m + 1))


def roc_auc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """auc: ties count half; null with one class only.

    Scores are counted before they are ranked, so the ordered table has a row for each
    distinct score; 256 quantile buckets of it are ranked on their own and put together by
    the running sums of their totals.
    """
    points = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    cuts = df.agg(F.percentile_approx(F.col(score).cast("double"), [i / 256 for i in range(1, 256)], 2000)).first()[0] or []
    points = points.where(F.col("s").isNotNull()).withColumn("_part", _bucket(F.col("s"), sorted(set(cuts))))
    totals = points.groupBy("_part").agg(F.sum("neg").alias("_neg"))
    # 256 rows at most
    before = totals.select("_part", (F.sum("_neg").over(Window.orderBy("_part")) - F.col("_neg")).alias("_before"))
    below = F.sum("neg").over(Window.partitionBy("_part").orderBy("s")) - F.col("neg")
    ranked = points.withColumn("_below", below).join(F.broadcast(before), "_part")
    wins = F.sum(F.col("pos") * (F.col("_below") + F.col("_before") + F.col("neg") / 2))
    return ranked.agg(F.try_divide(wins, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def roc_auc_ovr(df: DataFrame, classes: list, y: str = "y", probs: str = "probs") -> DataFrame:
    """auc: the mean over classes of one class against the rest; probs maps class to probability."""
    parts = None
    for c in classes:
        one = roc_auc(df.select((F.col(y) == c).cast("int").alias("y"), F.element_at(probs, F.lit(c)).alias("score")))
        parts = one if parts is None else parts.union(one)
    return parts.agg(F.when(F.count("auc") == F.count(F.lit(1)), F.avg("auc")).alias("auc"))


def class_weights(df: DataFrame, classes: list, label: str = "label") -> DataFrame:
    """class, weight: total / (classes * rows of the class); a class without rows counts as one."""
    spark = df.sparkSession
    names = spark.createDataFrame([(c,) for c in classes], df.select(F.col(label).alias("class")).schema)
    counts = df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    out = names.join(counts, "class", "left").crossJoin(F.broadcast(total))  # one row
    return out.select("class", (F.col("total") / (len(classes) * F.coalesce("n", F.lit(1)))).alias("weight"))


def cross_entropy(df: DataFrame, probs: str = "probs", label: str = "label", weight: str | None = None) -> DataFrame:
    """loss: the mean over rows, weighted if a weight is given."""
    loss = -F.log(F.greatest(F.element_at(probs, F.col(label).cast("int") + 1), F.lit(1e-12)))
    w = col(weight) if weight else F.lit(1.0)
    return df.agg((F.sum(loss * w) / F.sum(w)).alias("loss"))


def best_epoch(history: DataFrame, metric: str = "f1", epoch: str = "epoch") -> DataFrame:
    """The first epoch with the largest metric."""
    return history.agg(F.max_by(epoch, F.struct(F.col(metric), -F.col(epoch))).alias("best_epoch"), F.max(metric).alias("best_metric"))


def early_stop(history: DataFrame, metric: str = "val_loss", epoch: str = "epoch", patience: int = 3, min_delta: float = 1e-4, mode: str = "min", run: list[str] | None = None) -> DataFrame:
    """stop_epoch (null: never), best: a fold over each run's epochs in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("e"), F.col(metric).cast("double").alias("v"))))
    better = (lambda v, b: v < b - min_delta) if mode == "min" else (lambda v, b: v > b + min_delta)
    zero = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("bad"), F.lit(None).cast("long").alias("stop"))

    def step(s: Column, x: Column) -> Column:
        improved = s["best"].isNull() | better(x["v"], s["best"])
        bad = F.when(improved, 0).otherwise(s["bad"] + 1)
        stop = F.when(bad >= patience, x["e"].cast("long"))
        moved = F.struct(F.when(improved, x["v"]).otherwise(s["best"]).alias("best"), bad.alias("bad"), stop.alias("stop"))
        return F.when(s["stop"].isNotNull(), s).otherwise(moved)

    out = history.groupBy(*(run or [])).agg(ordered.alias("_h")) if run else history.agg(ordered.alias("_h"))
    out = out.withColumn("_s", F.aggregate("_h", zero, step))
    return out.select(*(run or []), F.col("_s.stop").alias("stop_epoch"), F.col("_s.best").alias("best"))


def running_average(df: DataFrame, value: str, n: str) -> DataFrame:
    return df.agg(F.coalesce(F.try_divide(F.sum(F.col(value) * F.col(n)), F.sum(n)), F.lit(0.0)).alias("average"))


def eta_seconds(elapsed: str | Column, step: str | Column, total: str | Column) -> Column:
    """Time left at the pace so far."""
    return col(elapsed) / F.greatest(col(step), F.lit(1)) * (col(total) - col(step))
