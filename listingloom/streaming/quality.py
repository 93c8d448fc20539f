"""Quality rules and duplicate removal on streams of listings.

Rules and labels are row-wise Column algebra, so they run on a stream as they are;
unordered duplicates are dropped within a watermark, which bounds the state: the first to
arrive stays, or, with `first_by_order`, the first in the rows' own order, whenever it arrives.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rules import quality_report
from ..functions.text import unordered_key
from ..operators.pairs import gate, label_pairs


def report_stream(listings: DataFrame, brand_col: str | None = "brand") -> DataFrame:
    return quality_report(listings, brand_col=brand_col)


def label_stream(pairs: DataFrame) -> DataFrame:
    return label_pairs(gate(pairs))


def dedupe_stream(pairs: DataFrame, a: str, b: str, event_time: str, delay: str = "1 hour") -> DataFrame:
    """The first of each unordered pair within the delay."""
    key = unordered_key(a, b)
    rows = pairs.where(key["a"] != key["b"]).withColumn("_a", key["a"]).withColumn("_b", key["b"])
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_a", "_b"]).drop("_a", "_b")


#: What `first_by_order` adds.
_VERSION, _KEY = "version", ["_a", "_b"]
#: Groups that the keys of `first_by_order` are dealt to.
BUCKETS = 512


def first_by_order(pairs: DataFrame, a: str, b: str, order: list[str], event_time: str, delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """The first of each unordered pair by the columns `order`, whatever order the rows arrive in.

    Equal sides go, and rows with a null in `order`. A key's state is its first row's order. When a
    row that comes earlier arrives, it is put out with the next version; `latest` keeps each key's
    last version. A key is forgotten `delay` after the latest event time that its rows have, so
    state is bounded by the keys of that time; rows later than the delay are dropped. Keys are dealt to
    `buckets` by hash, and those of a bucket share a state and a call. Columns: those of pairs, _a and _b (the key), version.
    """
    key = unordered_key(a, b)
    rows = pairs.where(key["a"] != key["b"]).dropna(subset=[*order, event_time]).withColumn("_a", key["a"]).withColumn("_b", key["b"])
    names, out = rows.columns, T.StructType([*rows.schema.fields, T.StructField(_VERSION, T.IntegerType())])
    held = T.StructType([T.StructField("_known", T.BinaryType())])
    until = F.unix_millis(F.col(event_time)) + _milliseconds(delay)
    rows = rows.withWatermark(event_time, delay).withColumn("_until", until).withColumn("_bucket", F.pmod(F.xxhash64(*_KEY), F.lit(buckets)))

    def keep(_: tuple, frames: Iterator, state) -> Iterator:
        # key -> its first row's order, version, until
        known, found, parts = pickle.loads(state.get[0]) if state.exists else {}, {}, []
        for n, frame in enumerate(frames):
            for i, (at, k, end) in enumerate(zip(*[zip(*[frame[c].tolist() for c in cs], strict=True) for cs in (order, _KEY)], frame["_until"].tolist(), strict=True)):
                best = known.get(k)
                if best is None:
                    known[k], found[k] = [at, 0, end], (n, i)
                    continue
                best[2] = max(best[2], end)
                if at < best[0]:
                    best[0], found[k] = at, (n, i)
            # of each frame only what may be put out is held
            places = {i: k for k, (m, i) in found.items() if m == n}
            parts.append((list(places.values()), frame[names].iloc[list(places)]))
        for n, (keys, part) in enumerate(parts):
            still = [found[k][0] == n for k in keys]
            versions = []
            for k in (k for k, s in zip(keys, still, strict=True) if s):
                known[k][1] += 1
                versions.append(known[k][1])
            if versions:
                yield part[still].assign(**{_VERSION: versions})
        now = state.getCurrentWatermarkMs()
        known = {k: best for k, best in known.items() if best[2] >= now}
        if known:
            state.update((pickle.dumps(known, pickle.HIGHEST_PROTOCOL),))
            state.setTimeoutTimestamp(max(min(best[2] for best in known.values()), now + 1))
        elif state.exists:
            state.remove()

    return rows.groupBy("_bucket").applyInPandasWithState(keep, out, held, "append", "EventTimeTimeout")


def latest(changes: DataFrame) -> DataFrame:
    """Each key's last version of what `first_by_order` has put out, without its own columns."""
    names = [c for c in changes.columns if c not in (*_KEY, _VERSION)]
    kept = changes.groupBy(*_KEY).agg(F.max_by(F.struct(*names), _VERSION).alias("_row"))
    return kept.select("_row.*")


def _milliseconds(interval: str) -> int:
    n, unit = interval.split()
    return int(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]


def severity_counts(listings: DataFrame, event_time: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Listings by severity in tumbling windows."""
    from ..functions.rules import issues, rank
    from ..functions.text import candidate_text

    found = issues(candidate_text("title", "description"), F.col("brand"))
    worst = F.coalesce(F.array_max(F.transform(found, lambda i: rank(i["severity"]))), F.lit(-1))
    rows = listings.select(F.col(event_time).alias("ts"), worst.alias("severity_rank"))
    return rows.withWatermark("ts", delay).groupBy(F.window("ts", window), "severity_rank").count()
