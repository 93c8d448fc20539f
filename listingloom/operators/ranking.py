"""Alternatives for products: retrieve, score, split off the exact match, rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import let
from ..functions.text import reasons, rounded_score
from .pairs import FIELDS, listed_candidates, retrieve_candidates

LISTED = ["SAME_PRODUCT_DIFFERENT_VARIANT", "SIMILAR_ALTERNATIVE"]


def _scored(originals: DataFrame, pool: DataFrame, scorer, limit: int, pos: str) -> DataFrame:
    """Scored candidates; what a scorer prepares of a product is made once for each, before they meet."""
    extra = []
    if hasattr(scorer, "prepare"):
        plain = [*FIELDS, pos]
        originals, pool = scorer.prepare(originals), scorer.prepare(pool)
        extra = [c for c in originals.columns if c in pool.columns and c not in plain and c.startswith("_scored")]
    found = scorer.transform(retrieve_candidates(originals, pool, limit, pos, extra))
    bare = lambda s: F.struct(*[F.col(s)[f].alias(f) for f in FIELDS])
    return found.withColumn("original", bare("original")).withColumn("candidate", bare("candidate"))


def rank_alternatives(originals: DataFrame, pool: DataFrame, scorer, top_n: int = 5, include_weakly_similar: bool = False, limit: int = 50, pos: str = "pos") -> DataFrame:
    """original_id, original_product, exact_match, similar_products: a row for each original.

    The exact match is the best scored one (0 to 100, the first of equal ones); the others
    are ordered by score (0 to 1, four decimals), then by place in the pool.
    """
    wanted = [*LISTED, "WEAKLY_SIMILAR"] if include_weakly_similar else LISTED
    if hasattr(scorer, "prepare") and hasattr(scorer, "score"):
        return _ranked_in_place(originals, pool, scorer, top_n, wanted, limit, pos)
    scored = _scored(originals, pool, scorer, limit, pos)
    row = scored.select(
        "original", "candidate", "pos", "relationship", F.col("similarity_score").alias("score"), rounded_score("similarity_score").alias("share"),
        reasons(F.col("original.brand"), F.col("candidate.brand"), F.col("relationship")).alias("reasons"),
    )
    exact = F.max_by(
        F.when(F.col("relationship") == "EXACT_MATCH", F.struct(F.col("candidate.title").alias("title"), F.col("score").alias("similarity_score"))),
        F.when(F.col("relationship") == "EXACT_MATCH", F.struct("score", (-F.col("pos")).alias("p"))),
    )
    # an original has `limit` candidates at most
    listed = F.collect_list(F.when(F.col("relationship").isin(wanted), F.struct(
        (-F.col("share")).alias("o"), F.col("pos").alias("p"),
        F.struct(F.col("candidate.title").alias("title"), F.col("share").alias("similarity_score"), "relationship", "reasons").alias("x"),
    )))
    made = row.groupBy("original").agg(exact.alias("exact_match"), F.slice(F.transform(F.array_sort(listed), lambda s: s["x"]), 1, top_n).alias("similar_products"))
    ids = originals.select(F.struct("id", "title", "brand", "description").alias("o")).distinct()
    # a row for each original: by its bytes on disk it would be broadcast
    out = ids.join(made.hint("merge"), F.col("o").eqNullSafe(F.col("original")), "left")
    return out.select(F.col("o.id").alias("original_id"), F.col("o.title").alias("original_product"), "exact_match", F.coalesce("similar_products", F.array().cast(made.schema["similar_products"].dataType)).alias("similar_products"))


def _ranked_in_place(originals: DataFrame, pool: DataFrame, scorer, top_n: int, wanted: list[str], limit: int, pos: str) -> DataFrame:
    """`rank_alternatives` with a scorer that tells two prepared products by columns: an original's candidates
    are an array of its row, so they are scored and ordered there and no pair is shuffled."""
    # a few bytes are much work: the rows of a small table are dealt to as many tasks as a shuffle has
    tasks = int(originals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = originals.select(*FIELDS).repartition(tasks, *FIELDS).distinct()
    found = listed_candidates(rows, pool, limit, pos, prepare=lambda *tables: [scorer.prepare(t) for t in tables])
    o = F.col("original")

    def told(x):
        c = x["candidate"]
        return let(scorer.score(o["_scored"], c["_scored"]), lambda s: F.struct(s["score"].alias("score"), (-x["pos"]).alias("p"), s["relationship"].alias("relationship"), c["title"].alias("title"), c["brand"].alias("brand")))

    found = found.select("original", F.transform("candidates", told).alias("_told"))
    # by score, then by place
    best = F.array_max(F.filter("_told", lambda x: x["relationship"] == "EXACT_MATCH"))
    kept = F.transform(F.filter("_told", lambda x: x["relationship"].isin(wanted)), lambda x: F.struct((-rounded_score(x["score"])).alias("o"), (-x["p"]).alias("p"), x.alias("x")))
    said = lambda s: F.struct(s["x"]["title"].alias("title"), (-s["o"]).alias("similarity_score"), s["x"]["relationship"].alias("relationship"), reasons(o["brand"], s["x"]["brand"], s["x"]["relationship"]).alias("reasons"))
    found = found.select("original", best.alias("_best"), F.slice(F.array_sort(kept), 1, top_n).alias("_first"))
    exact = F.when(F.col("_best").isNotNull(), F.struct(F.col("_best.title").alias("title"), F.col("_best.score").alias("similarity_score")))
    return found.select(o["id"].alias("original_id"), o["title"].alias("original_product"), exact.alias("exact_match"), F.transform("_first", said).alias("similar_products"))


def ranked_rows(originals: DataFrame, pool: DataFrame, scorer, top_n: int = 5, include_weakly_similar: bool = False, limit: int = 50, pos: str = "pos") -> DataFrame:
    """The listed alternatives as rows: original_id, candidate_id, rank, score, relationship."""
    wanted = [*LISTED, "WEAKLY_SIMILAR"] if include_weakly_similar else LISTED
    scored = _scored(originals, pool, scorer, limit, pos).where(F.col("relationship").isin(wanted))
    share = rounded_score("similarity_score")
    w = Window.partitionBy("original").orderBy(share.desc(), "pos")
    out = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    return out.select(F.col("original.id").alias("original_id"), F.col("candidate.id").alias("candidate_id"), "rank", share.alias("score"), "relationship")
