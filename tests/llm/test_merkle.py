"""Manifests against a tree built in plain Python."""

import hashlib
import zlib

import pytest

from listingloom.llm import merkle

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, tree string, place long, leaf string, n long"


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _brute(rows: list[dict]) -> set:
    def leaf(r, text):
        return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)])

    def paths(digests):
        """(root, [siblings of each leaf, level by level, with its place in the run])."""
        proofs, now, at = [[] for _ in digests], list(digests), list(range(len(digests)))
        while len(now) > 1:
            for k, p in enumerate(at):
                run = now[p // 16 * 16 : p // 16 * 16 + 16]
                proofs[k].append((p % 16, run[: p % 16] + run[p % 16 + 1 :]))
            now = [_h(*now[i : i + 16]) for i in range(0, len(now), 16)]
            at = [p // 16 for p in at]
        return now[0], proofs

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by: dict = {}
    for r in rows:
        by.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(by[s], key=lambda x: x[:3]), *paths([x[2] for x in sorted(by[s], key=lambda x: x[:3])])) for s in order}
    root, above = paths([trees[s][1] for s in order]) if order else ("", [])
    out = []
    for s, up in zip(order, above, strict=True):
        leaves, subroot, proofs = trees[s]
        for (_, _, d, r), own in zip(leaves, proofs, strict=True):
            shown = d
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
                shown = leaf(r, r["text"] and r["text"].translate(lower))
            for slot, others in own + up:
                shown = _h(*others[:slot], shown, *others[slot:])
            out.append((r["doc_id"], d, subroot, root, _h(*[x for _, others in own + up for x in others]), shown, shown == root))
    return out


def _row(i, text, source, lang="en"):
    return {"doc_id": i, "text": text, "lang": lang, "source": source, "n_chars": None if text is None else len(text)}


CASES = {
    "many": [_row(i, f"Text Nr {i}", f"s{i % 3}") for i in range(700)] + [_row(1000 + i, "ONE", f"lone{i}") for i in range(20)],
    "hot": [_row(i, "Same Text", "hot" if i % 5 else None) for i in range(400)],
    "odd": [_row(None, None, None), _row(None, "A", None), _row(5, "B", ""), _row(5, "B", ""), _row(5, None, ""), _row(-7, "ÄÖ Zz" * 20_000, "Ä", None), _row(9, "", "a"), _row(10, "UP", "B")],
    "one": [_row(3, "Only ONE", "s")],
    "empty": [],
}


@pytest.mark.parametrize("kind", list(CASES))
def test_against_plain_trees(spark, kind):
    rows = CASES[kind]
    df = spark.createDataFrame([(*[r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")], "x", 1, "y", None) for r in rows], COLUMNS).repartition(3)
    got = merkle.verify(merkle.document_leaves(df))
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got.columns == columns
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(_brute(rows), key=key)
    if kind == "many":
        assert 0 < got.where("not verified").count() < len(rows) / 3


def test_a_fold_needs_the_right_place():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(3)]
    root = merkle.node_digest(digests)
    assert merkle.fold(digests[1], [(1, 3)], digests[0] + digests[2]) == root
    assert merkle.fold(digests[1], [(0, 3)], digests[0] + digests[2]) != root
    assert [merkle.depth(n) for n in (0, 1, 2, 16, 17, 256, 257)] == [0, 0, 1, 1, 2, 2, 3]
