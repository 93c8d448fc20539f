"""What the operators of this subpackage share: tables, scratch space, components."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import work_folder

#: Rows and bytes that one Arrow batch may hold; bounds the memory of a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

_shipped_to: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Hands this package to the application's Python workers, once.

    Workers need it to unpickle what runs there; they may start elsewhere, without the
    driver's import path.
    """
    if spark.sparkContext.applicationId in _shipped_to:
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="listingloom-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped_to.add(spark.sparkContext.applicationId)


def bound_batches(spark: SparkSession) -> None:
    """Long texts make Spark's default of 10,000 rows a batch too large for a worker.

    Every operator that runs Python calls this first, so the package is shipped here too.
    """
    ship(spark)
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, after which its worker gives freed memory back to the system.

    Workers are used again by later stages; what one stage's peak left in their allocators
    would add up over a pipeline.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def trim_driver(spark: SparkSession) -> None:
    """Has the driver's JVM return freed native memory (what compiling plans took) to the system.

    Over many rounds of planning it adds up to more than the heap holds. A JVM without that
    command is left alone.
    """
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    methods = {m.getName(): m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods()}

    def call(method: str, *values):
        # by its interface, as the server's own class is closed
        given = new_array(jvm.java.lang.Object, len(values))
        for i, v in enumerate(values):
            given[i] = v
        return methods[method].invoke(server, given)

    if any(o.getName() == TRIM for o in call("getMBeanInfo", commands).getOperations()):
        call("invoke", commands, TRIM, None, None)


TRIM = "systemTrimNativeHeap"


def scratch(spark: SparkSession, label: str) -> str:
    """A new name in the folder that the driver and all executors see."""
    return work_folder(spark, label)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: it is computed once, and a lost
    executor costs a re-read instead of the whole lineage."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    trim_driver(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes what `materialize` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if not re.search(r"-[0-9a-f]{32}$", folder):
            raise ValueError(f"{folder} is no scratch folder")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Short rows (edges, ids) that are worth a task of their own.
ROWS_OF_A_TASK = 50_000


def tasks_of(df: DataFrame, total: int) -> DataFrame:
    """df, of about total short rows, in no more tasks than these are worth, however many the session shuffles to."""
    return df.coalesce(max(1, -(-total // ROWS_OF_A_TASK)))


#: Rows of one key that a task may get by a shuffle.
MOST_OF_A_KEY = 2000


def meet(rows: DataFrame, of_key: DataFrame, key: list[str], total: int, short: bool = False) -> DataFrame:
    """rows joined with of_key, which has one row for each key and the number of its rows in _rows.

    total is the number of all rows, or more; short ones are met in no more tasks than they are worth. Keys of more than MOST_OF_A_KEY rows are broadcast with what belongs to them, so no key
    gathers its rows in one task. There are at most rows / threshold of them; the threshold
    rises with the rows until that many may be broadcast.
    """
    most = max(MOST_OF_A_KEY, total // MOST_BROADCAST)
    plain = of_key.drop("_rows")
    dealt = partial(tasks_of, total=total) if short else lambda df: df
    if total <= most or dealt(of_key.where(F.col("_rows") > most)).isEmpty():
        return dealt(rows.join(plain, key))
    hot = F.broadcast(of_key.where(F.col("_rows") > most).drop("_rows"))
    return dealt(rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(plain, key)))


#: Ids up to which a list is broadcast; beyond it the join is shuffled.
MOST_BROADCAST = 1_000_000


def without(docs: DataFrame, gone: DataFrame, label: str) -> DataFrame:
    """docs whose doc_id is not in gone (doc_id); rows with a null id stay.

    The texts are shuffled only if the ids are too many to broadcast; they are counted first.
    """
    ids = materialize(gone.select("doc_id").where("doc_id is not null").distinct(), label)
    return docs.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, "doc_id", "left_anti").select(docs.columns)


def held_out(doc_id) -> F.Column:
    """True where crc32 of the id as text leaves 2 on division by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@contextmanager
def brief_plans(spark: SparkSession):
    """Within it the status store keeps short descriptions of plans: it holds one for each of
    many rounds, and adaptive execution sends it another at every step."""
    key = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def connected_components(edges: DataFrame, label: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of edges (a, b); component is the least node reachable.

    Nodes are whole numbers. Each task first contracts the edges it holds to stars, which spares
    rounds. Then alternating large-star and small-star rounds (Kiveris et al., 2014). Each round keeps
    at most one row for each edge, ends in a written table, and hubs are met by grouped
    minima that combine before the shuffle and reach their larger neighbours by `meet`. Of a
    node's smaller neighbours only those that are least around a neighbour are left by then.
    """
    with brief_plans(edges.sparkSession):
        now = _star_forest(edges, label, most_rounds)
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )


def roots_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges that are not the least of their component, and that least node for each."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    rest = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[rest], nodes[root[rest]]


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) that join the same nodes: of each EDGES_AT_ONCE of a task a spanning forest of stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            u, v = roots_of(*[np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("u", "v")])
            for at in range(0, len(u), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in (u, v)], ["u", "v"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= EDGES_AT_ONCE:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    return edges.mapInArrow(tidy(run), "u long, v long")


#: Edges that a task of `_contracted` holds at a time.
EDGES_AT_ONCE = 1 << 20


def _star_forest(edges: DataFrame, label: str, most_rounds: int) -> DataFrame:
    """(u, v): each node but the roots with its root."""
    bound_batches(edges.sparkSession)
    given = materialize(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")),
        f"{label}-edges",
    )
    now = materialize(_contracted(tasks_of(given, given.count())), f"{label}-contracted")
    discard(given)
    mark, total = None, 2 * now.count()
    for _ in range(most_rounds):
        # large star: link each larger neighbour of u to the least node around u
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("_rows"))
        large = tasks_of(meet(both.where("v > u"), least, ["u"], total, short=True).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), total)
        # small star: u has smaller neighbours only; link them and u to the least of them
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(floor.select("u", F.col("m").alias("v")))
            .where("u <> v")
        )
        last, now = now, materialize(tasks_of(tasks_of(small, total).distinct(), total), f"{label}-round")
        discard(last)
        # a star forest repeats itself: same number of edges, same order-free hash
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    return now
