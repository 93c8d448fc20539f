"""How well brands are covered by a table's text cells.

A brand list of any length is looked for in one scan: each brand is indexed under one of its
runs of three characters, one that few brands and few cells hold, a cell asks the index for its
own runs, and what it is offered is verified. The index is what is broadcast, in parts of a
checked size; cells are never shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SchemaError

STATUS = ["MISSING", "THIN", "OK"]
#: Characters of a run that a brand is indexed under; shorter brands are indexed whole.
GRAM = 3
#: Bytes of brands that share one scan of the cells.
INDEX_BYTES = 32 << 20
#: Cells that tell which runs are frequent; more or fewer change the cost and no count.
LOOK = 10_000


def text_columns(columns: list[str]) -> list[str]:
    """Columns that end in _title, _description or _brand, else those names themselves."""
    found = [c for c in columns if c.endswith(("_title", "_description", "_brand"))] or [c for c in ("title", "description", "brand") if c in columns]
    if not found:
        raise SchemaError("no title, description or brand columns to audit")
    return found


def grams(c: Column, n: int = GRAM) -> Column:
    """The distinct runs of n characters, in time linear in the text: a look ahead from each place."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def cells_of(df: DataFrame) -> DataFrame:
    """cell: the lower-cased text cells of a table."""
    cells = F.array(*[F.lower(F.col(c).cast("string")) for c in text_columns(df.columns)])
    return df.select(F.explode(cells).alias("cell")).where("cell <> ''")


def brand_index(names: DataFrame, cells: DataFrame) -> DataFrame:
    """low, gram: each lower-cased brand under the run that the fewest sampled cells and brands hold."""
    size = F.char_length("low")
    runs = names.select("low", F.explode(F.when(size < GRAM, F.array("low")).otherwise(grams(F.col("low")))).alias("gram"))
    seen = cells.limit(LOOK).select(F.explode(grams(F.col("cell"))).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("cells"))
    held = runs.groupBy("gram").agg(F.count(F.lit(1)).alias("brands"))
    ranked = runs.join(held, "gram").join(seen, "gram", "left")
    return ranked.groupBy("low").agg(F.min_by("gram", F.struct(F.coalesce("cells", F.lit(0)) * F.col("brands"), "brands", "gram")).alias("gram"))


def mentions(cells: DataFrame, names: DataFrame) -> DataFrame:
    """low, mentions of the distinct lower-cased brands `low` that a cell holds."""
    sizes = names.agg(F.sum(F.octet_length("low") + 16), F.min(F.char_length("low"))).first()
    if sizes[0] is None:
        return names.select("low", F.lit(0).cast("long").alias("mentions")).limit(0)
    asked = [grams(F.col("cell"))] + [grams(F.col("cell"), n) for n in range(sizes[1], GRAM)]
    offered = cells.select("cell", F.explode(F.concat(*asked)).alias("gram"))
    index, parts = brand_index(names, cells), -(-sizes[0] // INDEX_BYTES)
    found = []
    for k in range(parts):
        some = index if parts == 1 else index.where(F.pmod(F.xxhash64("low"), F.lit(parts)) == k)
        met = offered.join(F.broadcast(some), "gram").where(F.contains("cell", "low"))
        found.append(met.groupBy("low").agg(F.count(F.lit(1)).alias("mentions")))
    return reduce(lambda a, b: a.unionByName(b), found)


def coverage(df: DataFrame, brands: list[str] | DataFrame, thin: int = 10) -> DataFrame:
    """brand, mentions, status: the cells that hold the brand, in any case.

    brands: names, or a table with a column `brand`; null, empty and repeated names count once
    or not at all. A null cell mentions nothing.
    """
    if not isinstance(brands, DataFrame):
        brands = df.sparkSession.createDataFrame([(b,) for b in brands], "brand string")
    names = brands.select("brand").where("brand <> ''").distinct().withColumn("low", F.lower("brand"))
    counted = names.join(mentions(cells_of(df), names.select("low").distinct()), "low", "left")
    out = counted.select("brand", F.coalesce("mentions", F.lit(0)).cast("long").alias("mentions"))
    status = F.when(F.col("mentions") == 0, "MISSING").when(F.col("mentions") < thin, "THIN").otherwise("OK")
    return out.withColumn("status", status)


def ordered(report: DataFrame) -> DataFrame:
    """Worst first."""
    order = F.array_position(F.array(*[F.lit(s) for s in STATUS]), F.col("status"))
    return report.orderBy(order, "mentions", "brand")
