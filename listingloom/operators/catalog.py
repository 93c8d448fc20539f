"""Catalog assembly from id-keyed files, and category filters over it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import join_paths, top_category
from ..sources.sinks import work_folder


def stored(*files: DataFrame, key: str = "id", buckets: int | None = None) -> list[DataFrame]:
    """The files as tables in as many buckets of the key each, sorted by it, in the shared folder.

    Each is shuffled once, when it is written; joins of them on the key exchange and sort
    nothing after that. As many buckets as the session's shuffles have partitions, unless told.
    """
    out = []
    for df in files:
        spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = df.repartition(n, key)
        dealt.write.bucketBy(n, key).sortBy(key).option("path", work_folder(spark, name)).format("parquet").saveAsTable(name)
        out.append(spark.table(name))
    return out


def assemble(descriptions: DataFrame, titles: DataFrame, categories: DataFrame, brands: DataFrame) -> DataFrame:
    """id, title, brand, description, category: (id, value) files, (id, paths) for categories.

    A title and a category are needed, a brand is not.
    """
    rows = descriptions.select("id", F.col("value").alias("description")).join(titles.select("id", F.col("value").alias("title")), "id")
    rows = rows.join(categories.select("id", top_category("paths").alias("category")), "id").join(brands.select("id", F.col("value").alias("brand")), "id", "left")
    return rows.select("id", "title", F.coalesce("brand", F.lit("")).alias("brand"), "description", "category")


def has_keyword(c: Column, keywords: list[str]) -> Column:
    low = F.lower(c)
    out = F.lit(False)
    for k in keywords:
        out = out | low.contains(k.lower())
    return out


def filter_dataset(titles: DataFrame, categories: DataFrame, brands: DataFrame, descriptions: DataFrame, keywords: list[str]) -> DataFrame:
    """The products whose joined category paths hold a keyword; the filter comes before all joins."""
    chosen = categories.withColumn("category", join_paths("paths")).where(has_keyword(F.col("category"), keywords)).select("id", "category")
    side = lambda df, name: df.select("id", F.col("value").alias(name))
    rows = chosen.join(side(titles, "title"), "id").join(side(brands, "brand"), "id", "left").join(side(descriptions, "description"), "id", "left")
    return rows.select("id", "title", F.coalesce("brand", F.lit("")).alias("brand"), F.coalesce("description", F.lit("")).alias("description"), "category")


def with_sub_category(products: DataFrame, lookup: DataFrame, fallback: str = "category") -> DataFrame:
    """The lookup's (id, sub_category) where there is one, else the product's own category."""
    return products.join(lookup, "id", "left").withColumn("sub_category", F.coalesce("sub_category", F.col(fallback)))
