"""Language identification by compression.

The whole text, lower-cased and its words between single blanks, is compressed once with each language's zstandard raw-content dictionary; the
language whose dictionary gives the fewest bytes wins, and the lead over the runner-up
decides whether the answer is kept (`rejected`).

Defined results: a null text or one without a letter gives `und` with score 0 and
rejected; an empty training set gives `und` for all; repeated rows are answered row by
row; texts of any length are compressed whole; ties go to the language with more
training rows, then to the smaller name. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, tidy

#: Bound of the labelled sample: rows for each language, and characters of a passage, at a
#: place told by the row's id, that one row may give.
ROWS_PER_LANGUAGE, CHARS_PER_ROW = 100, 3000
#: Bytes of a dictionary; near equal lengths keep match offsets equally dear everywhere.
DICTIONARY_BYTES = 64000
#: Dictionaries that a worker holds ready at a time; more languages are scored in passes.
AT_A_TIME = 200
#: From level 6 the match finder searches rows of candidates; below it misses too many.
LEVEL = 6
#: A lead of less than this share of the best size is too narrow.
MARGIN = 0.01

_LETTER = re.compile(r"[^\W\d_]")
#: ASCII bytes that are no letters become blanks; bytes of other characters stay.
_BLANK = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def plain(text: str) -> bytes:
    """The lower-cased words of the whole text between single blanks.

    Blanks at both ends let the outer words match too.
    """
    return b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANK).split()) + b" "


def learn(docs: DataFrame, usable: F.Column) -> list[tuple[str, int, bytes]]:
    """(language, training rows, dictionary) from a bounded, hash-ordered sample of rows.

    Counts cover all usable rows. Only ids and labels are shuffled; the texts of the
    passages of the sampled rows (at most ROWS_PER_LANGUAGE for each language) come to the driver.
    """
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = (
        rows.select("doc_id", "lang").withColumn("_at", F.row_number().over(order))
        .where(F.col("_at") <= ROWS_PER_LANGUAGE).select("doc_id", "lang").distinct()
    )
    texts: dict[str, list[bytes]] = {}
    found = rows.join(F.broadcast(picked), ["doc_id", "lang"]).select("doc_id", "lang", "text")
    place = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - CHARS_PER_ROW + 1, F.lit(1))) + 1
    best = found.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "doc_id", F.expr("text").substr(place.cast("int"), F.lit(CHARS_PER_ROW)).alias("text"))
    for r in best.orderBy("lang", "doc_id").collect():
        texts.setdefault(r["lang"], []).append(plain(r["text"]))
    # the rows of a language share its dictionary equally; what short ones leave is filled from the others' rest
    out = []
    for r in counts:
        if r["lang"] in texts:
            mine = texts[r["lang"]]
            share = DICTIONARY_BYTES // len(mine)
            whole = b"".join([t[share:] for t in mine] + [t[:share] for t in mine])
            out.append((r["lang"], r["count"], whole[-DICTIONARY_BYTES:]))
    return out


def identify(docs: DataFrame, model: list[tuple[str, int, bytes]], margin: float = MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected for each row of docs (doc_id, text)."""
    bound_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)  # DICTIONARY_BYTES for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        def ready(part: list) -> list:
            made = []
            for _, _, data in part:
                d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
            return made

        languages = sorted(known.value, key=lambda m: (-m[1], m[0]))
        parts = [languages[i : i + AT_A_TIME] for i in range(0, len(languages), AT_A_TIME)]
        first = ready(parts[0]) if parts else []
        for batch in batches:
            out: list[list] = [[], [], [], []]
            texts = batch.column("text").to_pylist()
            known_sizes: list[list[int]] = [[] for _ in texts]
            told = [bool(languages) and t is not None and bool(_LETTER.search(t)) for t in texts]
            for k, part in enumerate(parts):
                makers = ready(part) if k else first
                for i, text in enumerate(texts):
                    if told[i]:
                        data = plain(text)
                        known_sizes[i] += [len(f(data)) for f in makers]
            for sizes in known_sizes:
                if not sizes:
                    row = ("und", 0.0, 0.0, True)
                else:
                    best = min(sizes)
                    at = sizes.index(best)
                    second = min((s for i, s in enumerate(sizes) if i != at), default=2 * best)
                    share = sum(math.exp(max(-60.0, (best - s) / 4)) for s in sizes)
                    lead = (second - best) / best
                    row = (languages[at][0], 1 / share, lead, lead < margin)
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(out[0], pa.string()), pa.array(out[1], pa.float64()),
                pa.array(out[2], pa.float64()), pa.array(out[3], pa.bool_()),
            ], ["doc_id", "lang_pred", "score", "margin", "rejected"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, margin double, rejected boolean"
    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)
