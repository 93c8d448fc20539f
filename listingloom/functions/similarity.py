"""Token sets and their Jaccard similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, text


def tokens(c: str | Column) -> Column:
    """The distinct runs of a-z and 0-9 of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9]+"), F.lit(0)))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value worked out once, where Spark would repeat it (in join conditions)."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Of two token arrays; 0 if either is empty. Sizes come from one intersection."""
    a, b = col(a), col(b)
    both = F.size(F.array_intersect(a, b))
    share = let(both, lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(share)


#: Words of 64 bits that hold a product's frequent tokens.
WORDS_OF_BITS = 4


def split_tokens(c: str | Column, frequent: Column) -> Column:
    """struct<w0.., rest, n>: a set of tokens as bits, one for each of the array `frequent` (64 * WORDS_OF_BITS
    tokens at most), and an array of its other tokens; n is the size of the set."""
    have = F.array_intersect(frequent, col(c))

    def word(k: int) -> Column:
        places = F.filter(F.transform(have, lambda w: F.array_position(frequent, w) - 1), lambda p: F.floor(p / 64) == k)
        return F.aggregate(places, F.lit(0).cast("long"), lambda a, p: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))))

    return F.struct(*[word(k).alias(f"w{k}") for k in range(WORDS_OF_BITS)], F.array_except(col(c), frequent).alias("rest"), F.size(col(c)).alias("n"))


def shared(a: Column, b: Column) -> Column:
    """How many tokens two sets of `split_tokens` (of the same frequent ones) share."""
    both = sum((F.bit_count(a[f"w{k}"].bitwiseAND(b[f"w{k}"])) for k in range(1, WORDS_OF_BITS)), F.bit_count(a["w0"].bitwiseAND(b["w0"])))
    rare = F.when((F.size(a["rest"]) > 0) & (F.size(b["rest"]) > 0), F.size(F.array_intersect(a["rest"], b["rest"]))).otherwise(0)
    return both + rare


def jaccard_of_bits(a: Column, b: Column) -> Column:
    """`jaccard` of two sets of `split_tokens`."""
    n = shared(a, b)
    return F.when((a["n"] == 0) | (b["n"] == 0), F.lit(0.0)).otherwise(n / (a["n"] + b["n"] - n))


def token_overlap(a: str | Column, b: str | Column) -> Column:
    return jaccard(tokens(a), tokens(b))


def token_ids(c: str | Column) -> Column:
    """The tokens as 64-bit hashes: for arrays that are intersected many times."""
    return F.transform(tokens(c), lambda w: F.xxhash64(w))
