"""Text normalisation and small scalar rules as Column expressions.

Python's regular expressions know Unicode classes and cases by default; Java's need the
flags (?iU). A null text is an empty one unless a function says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import RELATIONSHIP_IDS

#: Units that are joined to the number before them.
UNITS = ["gb", "tb", "mb", "mp", "inch", "in", "hz", "w", "mah", "ghz"]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: str | Column, null_text: str = "") -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(null_text))


def squeeze(c: str | Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def clean_text(c: str | Column) -> Column:
    """Lower case, numbers joined to their units, odd characters to blanks, blanks squeezed."""
    low = F.lower(F.regexp_replace(text(c), r"(?U)^\s+|\s+$", ""))
    joined = F.regexp_replace(low, rf"(?iU)(\d)\s*({'|'.join(UNITS)})\b", "$1$2")
    return F.trim(F.regexp_replace(F.regexp_replace(joined, r"[^a-z0-9.\-\s]", " "), r"\s+", " "))


def product_text(title=None, brand=None, specs=None, description=None) -> Column:
    """title | brand x | specs or description, each cleaned and left out when empty."""
    parts = []
    if title is not None:
        parts.append(F.nullif(clean_text(title), F.lit("")))
    if brand is not None:
        cleaned = clean_text(brand)
        parts.append(F.when(cleaned != "", F.concat(F.lit("brand "), cleaned)))
    details = [F.when(text(c) != "", text(c)) for c in (specs, description) if c is not None]
    if details:
        parts.append(F.nullif(clean_text(F.coalesce(*details)), F.lit("")))
    return F.concat_ws(" | ", *parts)


def candidate_text(title="title", description="description", null_text: str = "") -> Column:
    return F.concat(text(title, null_text), F.lit(" "), text(description, null_text))


def distinct_matches(c: str | Column, pattern: str) -> Column:
    """The sorted distinct matches, found in any case and kept in their own."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(col(c), F.lit("(?iU)" + pattern), F.lit(0))))


def first_group(c: str | Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    return F.when(col(c).rlike(pattern), F.regexp_extract(col(c), pattern, group))


def category_segments(paths: Column) -> Column:
    """The trimmed comma-separated segments of the first path."""
    return F.transform(F.split(F.get(paths, F.lit(0)), ","), lambda s: F.trim(s))


def top_category(paths: str | Column) -> Column:
    first = F.get(category_segments(col(paths)), F.lit(0))
    return F.coalesce(F.when(F.size(col(paths)) > 0, first), F.lit("UNKNOWN"))


def sub_category(paths: str | Column, depth: int = 2) -> Column:
    """The first segments of the first path; null without a path."""
    return F.when(F.size(col(paths)) > 0, F.array_join(F.slice(category_segments(col(paths)), 1, depth), ", "))


def join_paths(paths: str | Column) -> Column:
    return F.array_join(col(paths), " | ")


def relationship_title(c: str | Column) -> Column:
    return F.initcap(F.replace(F.lower(col(c)), F.lit("_"), F.lit(" ")))


def reasons(brand_a: Column, brand_b: Column, relationship: Column) -> Column:
    """Why a candidate is listed: its brand, where both are known, and its relationship."""
    known = (F.trim(text(brand_a)) != "") & (F.trim(text(brand_b)) != "")
    same = F.lower(F.trim(brand_a)) == F.lower(F.trim(brand_b))
    about = F.when(known & same, F.concat(F.lit("Same brand: "), brand_b)).when(
        known, F.concat(F.lit("Different brand: "), brand_b, F.lit(" vs "), brand_a)
    )
    return F.array_compact(F.array(about, F.concat(F.lit("Relationship: "), relationship_title(relationship))))


def format_time(seconds: str | Column) -> Column:
    """1h 02m 03s, 2m 03s or 3s; never below zero."""
    s = F.greatest(F.floor(col(seconds)), F.lit(0)).cast("int")
    h, m, r = F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60
    return (
        F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, r)).when(m > 0, F.format_string("%dm %02ds", m, r)).otherwise(F.format_string("%ds", r))
    )


def unordered_key(a: str | Column, b: str | Column, trim: bool = True) -> Column:
    """The same for (a, b) and (b, a): lower-cased, trimmed unless told otherwise."""
    norm = (lambda c: F.lower(F.regexp_replace(text(c), r"(?U)^\s+|\s+$", ""))) if trim else (lambda c: F.lower(text(c)))
    return F.struct(F.least(norm(a), norm(b)).alias("a"), F.greatest(norm(a), norm(b)).alias("b"))


def id_key(a: str | Column, b: str | Column) -> Column:
    return F.array_sort(F.array(col(a), col(b)))


def relationship_id(c: str | Column) -> Column:
    """Null for a name that is not known."""
    pairs = [F.lit(x) for kv in RELATIONSHIP_IDS.items() for x in kv]
    return F.element_at(F.create_map(*pairs), col(c))


def label_number(c: str | Column) -> Column:
    """A label as a number; null where it is none."""
    return F.expr(f"try_cast({c} as double)") if isinstance(c, str) else c.cast("string").try_cast("double")


def md5_order(seed: int | str, *key: str | Column) -> Column:
    """A reproducible stand-in for a random order, the same in any SQL engine."""
    parts = [col(k).cast("string") for k in key]
    return F.md5(F.concat(F.lit(f"{seed}|"), *reduce(lambda a, b: [*a, F.lit("|"), b] if a else [b], parts, [])))


def softmax(logits: str | Column) -> Column:
    top = F.array_max(col(logits))
    raised = F.transform(col(logits), lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def argmax(values: str | Column) -> Column:
    """Place of the largest value from 0; the first of equal ones."""
    return (F.array_position(col(values), F.array_max(col(values))) - 1).cast("int")


def rounded_score(score: str | Column) -> Column:
    """A percentage as a share with four decimals."""
    return F.round(col(score) / 100, 4)


def comparison_text(score: Column, prediction: Column, relationship: Column) -> Column:
    """A comparison for people to read."""
    return F.concat(
        F.format_string("Similarity Score: %.1f%%\nPrediction:\n%s", score, prediction),
        F.coalesce(F.concat(F.lit("\nRelationship: "), relationship), F.lit("")),
    )
