"""A linear classifier trained over epochs: Spark adds up the gradients, the driver holds the weights.

A pass over the rows is one aggregation: batches give weighted means of loss and gradient, and
what comes to the driver is the mean over batches, a number for each feature. The rows are
written once, with their batch and scaled features, whatever the number of epochs.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import col
from ..operators.metrics import class_weights
from ..operators.sampling import numbered
from ..sources.sinks import written

HISTORY = "epoch int, train_loss double, val_loss double, accuracy double, precision double, recall double, f1 double, rate double"


@dataclass(frozen=True)
class LinearModel:
    """A constant and a weight for each feature, in units of its deviation from its mean."""

    constant: float
    weights: tuple[float, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]

    def logit(self, features: str | Column) -> Column:
        x, out = col(features), F.lit(self.constant)
        for i, (w, m, s) in enumerate(zip(self.weights, self.means, self.deviations, strict=True)):
            out = out + F.lit(w) * ((F.get(x, F.lit(i)) - m) / s)
        return out

    def probabilities(self, features: str | Column) -> Column:
        """Of class 0 and class 1: what a probability scorer takes."""
        p = 1 / (1 + F.exp(-self.logit(features)))
        return F.array(1 - p, p)

    def save(self, spark: SparkSession, path: str) -> None:
        row = (self.constant, list(self.weights), list(self.means), list(self.deviations))
        spark.createDataFrame([row], "constant double, weights array<double>, means array<double>, deviations array<double>").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearModel:
        r = spark.read.parquet(path).first()
        return cls(r["constant"], tuple(r["weights"]), tuple(r["means"]), tuple(r["deviations"]))


def rates(epochs: int, rate: float, warmup: float) -> list[float]:
    """The learning rate of each epoch: it rises over the first share of them, then falls towards 0."""
    rising = ceil(epochs * warmup)
    return [rate * ((e + 1) / (rising + 1) if e < rising else (epochs - e) / (epochs - rising)) for e in range(epochs)]


def scaling(train: DataFrame, size: int) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Means and deviations of the features; a feature that never varies keeps its unit."""
    x = [F.get("features", F.lit(i)) for i in range(size)]
    r = train.agg(*[f(c) for c in x for f in (F.avg, F.stddev_pop)]).first()
    return tuple(v or 0.0 for v in r[0::2]), tuple(v or 1.0 for v in r[1::2])


def _pass(rows: DataFrame, model: LinearModel) -> dict[str, dict]:
    """For train and val: loss and gradient as means over batches, and the confusion counts."""
    size = len(model.weights)
    x = [F.get("_x", F.lit(i)) for i in range(size)]
    z = F.lit(model.constant)
    for i, w in enumerate(model.weights):
        z = z + F.lit(w) * x[i]
    made = rows.select("_side", "_batch", "label", "_w", "_x", z.alias("_z"))
    y, z, w = F.col("label"), F.col("_z"), F.col("_w")
    loss = F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - z * y
    off = 1 / (1 + F.exp(-z)) - y
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    by = made.groupBy("_side", "_batch").agg(
        (F.sum(w * loss) / F.sum(w)).alias("loss"), (F.sum(w * off) / F.sum(w)).alias("g"), *[(F.sum(w * off * c) / F.sum(w)).alias(f"g{i}") for i, c in enumerate(x)],
        count((z >= 0) & (y == 1)).alias("tp"), count((z >= 0) & (y == 0)).alias("fp"), count((z < 0) & (y == 1)).alias("fn"), count((z < 0) & (y == 0)).alias("tn"),
    )
    means, sums = ["loss", "g", *[f"g{i}" for i in range(size)]], ["tp", "fp", "fn", "tn"]
    found = by.groupBy("_side").agg(*[F.avg(c).alias(c) for c in means], *[F.sum(c).alias(c) for c in sums]).collect()
    return {r["_side"]: r.asDict() for r in found}


def _metrics(r: dict) -> tuple[float, float, float, float]:
    """accuracy, precision, recall, f1; what divides by nothing is 0."""
    share = lambda a, b: a / b if b else 0.0
    precision, recall = share(r["tp"], r["tp"] + r["fp"]), share(r["tp"], r["tp"] + r["fn"])
    return share(r["tp"] + r["tn"], sum(r[c] for c in ("tp", "fp", "fn", "tn"))), precision, recall, share(2 * precision * recall, precision + recall)


def fit(
    train: DataFrame, val: DataFrame, key: list[str], epochs: int = 10, rate: float = 2.0, warmup: float = 0.1, decay: float = 0.01, most: float = 1.0,
    batch: int = 32, patience: int = 3, least: float = 1e-4, seed: int = 42,
) -> tuple[LinearModel, DataFrame]:
    """The model of the epoch with the largest f1 on val (the first of equal ones), and a row for each epoch.

    train and val: key, features (array of doubles, none null), label (0 or 1). Classes weigh by
    their rarity; gradients longer than `most` are shortened; weights decay by rate * decay an
    epoch. The epochs end early when the loss on val has not fallen by `least` for `patience` of
    them. A history's train_loss is that before the epoch's step, as the mean of batch means;
    val_loss and the metrics are those after it.
    """
    spark = train.sparkSession
    first = train.select(F.size("features")).first()
    if first is None:
        raise ValueError("no rows to train on")
    means, deviations = scaling(train, first[0])
    weights = {r["class"]: r["weight"] for r in class_weights(train.select(F.col("label").cast("int").alias("label")), [0, 1]).collect()}
    names = [*key, "features", "label"]
    both = train.select(*names, F.lit("train").alias("_side")).unionByName(val.select(*names, F.lit("val").alias("_side")))
    scaled = F.array(*[(F.get("features", F.lit(i)) - m) / s for i, (m, s) in enumerate(zip(means, deviations, strict=True))])
    placed = numbered(both, seed, *key, by="_side", name="_place")
    rows = written(placed.select("_side", F.floor(F.col("_place") / batch).alias("_batch"), F.col("label").cast("int").alias("label"), F.when(F.col("label") == 1, weights[1]).otherwise(weights[0]).alias("_w"), scaled.alias("_x")), "training")
    model = LinearModel(0.0, (0.0,) * len(means), means, deviations)
    history, best, lowest, waited = [], (-1.0, model), float("inf"), 0
    seen = _pass(rows, model)
    for epoch, step in enumerate(rates(epochs, rate, warmup)):
        g = seen["train"]
        slope = [g["g"], *[g[f"g{i}"] for i in range(len(means))]]
        length = sqrt(sum(v * v for v in slope))
        short = min(1.0, most / length) if length else 1.0
        kept = 1 - step * decay
        model = LinearModel(model.constant - step * short * slope[0], tuple(kept * w - step * short * v for w, v in zip(model.weights, slope[1:], strict=True)), means, deviations)
        before, seen = g["loss"], _pass(rows, model)
        after = seen.get("val", {"loss": 0.0, "tp": 0, "fp": 0, "fn": 0, "tn": 0})
        told = _metrics(after)
        history.append((epoch, before, after["loss"], *told, step))
        if told[3] > best[0]:
            best = (told[3], model)
        lowest, waited = (after["loss"], 0) if after["loss"] < lowest - least else (lowest, waited + 1)
        if waited >= patience:
            break
    return best[1], spark.createDataFrame(history, HISTORY)


def curves(history: DataFrame) -> DataFrame:
    """figure, series, epoch, value: what the curves of loss, accuracy and f1 are drawn from."""
    lines = [("loss", "train", "train_loss"), ("loss", "val", "val_loss"), ("accuracy", "val", "accuracy"), ("f1", "val", "f1")]
    points = F.array(*[F.struct(F.lit(f).alias("figure"), F.lit(s).alias("series"), F.col("epoch"), F.col(c).alias("value")) for f, s, c in lines])
    return history.select(F.explode(points).alias("p")).select("p.*")
