"""SQL for the operators that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Five hex digits are 20 bits, four letters.
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
 d AS (SELECT page_id, strlen(t) AS n, sha1(t) AS h, max(page_id) OVER (PARTITION BY t) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('{_BASE32}', ((CAST(concat('0x', substr(h, (i // 4) * 5 + 1, 5)) AS BIGINT) >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
 CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
"""

JACCARD = """
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')))
   WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
 n AS (SELECT doc_id, len(s) AS n FROM s), u AS (SELECT doc_id, unnest(s) AS x FROM s), h AS (SELECT u.doc_id, hash(x) AS x, n FROM u JOIN n USING (doc_id)),
 c AS (SELECT a.doc_id AS i, b.doc_id AS j, a.n AS ni, b.n AS nj, count(*) AS hits FROM h a JOIN h b ON a.x = b.x AND a.doc_id < b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY ALL),
 l AS (SELECT i, j FROM c WHERE 100 * hits >= 90 * (ni + nj - hits)), e AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
 r AS (WITH RECURSIVE q AS (SELECT doc_id AS i, doc_id AS j FROM n UNION SELECT q.i, e.j FROM q JOIN e ON q.j = e.i) SELECT i, min(j) AS component_id FROM q GROUP BY 1)
SELECT doc_id, n::BIGINT AS n_shingles, component_id FROM n JOIN r ON i = doc_id
"""

#: The CRC table comes from its rule; a text's bytes are folded over it.
_CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl"


def _crc32(bytes_: str) -> str:
    """Of a list of byte values, beside a row of k (tbl)."""
    return f"xor(list_reduce(list_concat([4294967295], {bytes_}), lambda c, y: xor(c >> 8, tbl[xor(c & 255, y) + 1])), 4294967295)"


def _byte_values(hexa: str, n: str) -> str:
    return f"list_transform(range({n}), lambda i: CAST(concat('0x', substr({hexa}, 2 * i + 1, 2)) AS BIGINT))"


SHARDING = f"""
WITH k AS ({_CRC_TABLE}),
 d AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS n FROM documents),
 x AS (SELECT doc_id, n + 1 AS size, md5(t) AS dig, hex(encode(t)) AS h, n FROM d),
 b AS (SELECT doc_id, size, dig, {_byte_values('h', 'n')} AS bytes FROM x),
 s AS (SELECT doc_id, size, dig, {_crc32('bytes')} AS text_crc32 FROM b, k),
 o AS (SELECT *, sum(size) OVER (ORDER BY dig, doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) AS e, sum(size) OVER () AS w FROM s),
 p AS (SELECT *, least(7, ((2 * e - size) * 8) // (2 * w))::INT AS shard FROM o)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY e) - 1 AS slot, NULL::INT AS grown_shard FROM p
"""

#: The stored image is header and payload; sizes and samples are read from its hex digits.
MEDIA = f"""
WITH k AS ({_CRC_TABLE}),
 d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) AS n, greatest(ceil(strlen(coalesce(text, '')) / 576.0), 1)::BIGINT * 576 AS m FROM documents),
 p AS MATERIALIZED (SELECT id, doc_id, n, m, concat(hex(encode(t)), repeat('FF', (m - n)::INT)) AS h FROM d),
 x AS (SELECT id, concat('0x', y)::INT AS y FROM (SELECT id, unnest(regexp_extract_all(h, '..')) AS y FROM p)),
 f AS (SELECT id, sum(y) AS total, min(y) AS low, max(y) AS high, {", ".join(f"count(*) FILTER (WHERE y // 32 = {j}) AS n{j}" for j in range(8))} FROM x GROUP BY id),
 b AS (SELECT *, unhex(h) AS payload, unhex(concat(hex(encode(concat('P5', chr(10), '24 ', m // 24, chr(10), '255', chr(10)))), h)) AS media, {_byte_values('right(h, 64)', '32')} AS tail FROM p JOIN f USING (id))
SELECT doc_id, n::BIGINT AS n_bytes, m AS payload_bytes, sha256(payload) AS payload_sha256, {_crc32('tail')}::BIGINT AS tail_crc32, octet_length(media)::BIGINT AS media_bytes,
 sha256(media) AS media_sha256, concat('24x', m // 24, ';', total::BIGINT, ';', low, ';', high, ';', {", ',', ".join(f"n{j}" for j in range(8))}) AS feature
FROM b, k
"""

#: Levels of a source's tree and of the tree over the sources that the SQL goes up to.
_LEVELS, _ABOVE = 5, 2


def _tree(name: str, levels: int) -> list[str]:
    """CTEs {name}1.. from {name}0 (s, i, n, d), and {name}x: each node with what stands before and after it in its run."""
    out = []
    for j in range(1, levels + 1):
        out.append(f"{name}{j} AS MATERIALIZED (SELECT s, i // 16 AS i, max((n + 15) // 16) AS n, sha256(string_agg(d, '' ORDER BY i)) AS d FROM {name}{j - 1} WHERE n > 1 GROUP BY s, i // 16)")
    all_ = " UNION ALL ".join(f"SELECT {j} AS l, * FROM {name}{j}" for j in range(levels + 1))
    run = "OVER (PARTITION BY l, s, i // 16 ORDER BY i ROWS BETWEEN {})"
    before, after = run.format("UNBOUNDED PRECEDING AND 1 PRECEDING"), run.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")
    out.append(f"{name}x AS MATERIALIZED (SELECT *, coalesce(string_agg(d, '') {before}, '') AS a, coalesce(string_agg(d, '') {after}, '') AS z FROM ({all_}))")
    return out


def _merkle() -> str:
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen({c}::VARCHAR), ':', {c}) END"
    leaf = lambda text: "sha256(concat(" + ", ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    digits = "list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c))"
    ctes = [
        f"k AS ({_CRC_TABLE})",
        f"f AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_crc32(digits)} % 5 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS shown FROM documents, k)",
        "o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s FROM f)",
        "t0 AS MATERIALIZED (SELECT s, i, n, leaf AS d FROM o)", *_tree("t", _LEVELS),
        "u0 AS MATERIALIZED (SELECT 0 AS s, s AS i, (SELECT count(DISTINCT s) FROM o) AS n, d FROM tx WHERE n = 1)", *_tree("u", _ABOVE),
        "r0 AS (SELECT o.doc_id, o.leaf, o.shown, o.s, o.i, u.d AS subroot, v.d AS root, u.n AS k, shown AS g, '' AS path FROM o JOIN u0 u ON u.i = o.s JOIN ux v ON v.n = 1)",
    ]
    step = 0
    for name, levels, of, at in (("t", _LEVELS, "r.s", "r.i"), ("u", _ABOVE, "0", "r.s")):
        for j in range(levels):
            step += 1
            ctes.append(
                f"r{step} AS (SELECT r.* REPLACE (CASE WHEN x.n > 1 THEN sha256(concat(x.a, r.g, x.z)) ELSE r.g END AS g, CASE WHEN x.n > 1 THEN concat(r.path, x.a, x.z) ELSE r.path END AS path)"
                f" FROM r{step - 1} r LEFT JOIN {name}x x ON x.l = {j} AND x.s = {of} AND x.i = {at} // {16**j})"
            )
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, root, sha256(path) AS proof_sha256, g AS folded_root, g = root AS verified FROM r{step}"


def _centroids(rounds: int = 10) -> str:
    """A centroid is a row (j, d, x) for each component."""
    near = lambda c: (
        f"SELECT id, vec_id, j, dist FROM (SELECT id, vec_id, j, dist, row_number() OVER (PARTITION BY id ORDER BY dist, j) AS nth FROM"
        f" (SELECT v.id, any_value(vec_id) AS vec_id, j, sum((v.x - c.x) * (v.x - c.x)) AS dist FROM v JOIN {c} c USING (d) GROUP BY v.id, j)) WHERE nth = 1"
    )
    ctes = [
        "e AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: isfinite(y))) = 64)",
        "v AS MATERIALIZED (SELECT id, vec_id, d, floor(1024 * x[d])::HUGEINT AS x FROM e, (SELECT unnest(range(1, 65)) AS d))",
        "c0 AS MATERIALIZED (SELECT j, d, v.x FROM (SELECT id, row_number() OVER (ORDER BY sha256(concat('3:', vec_id)), x) - 1 AS j FROM e WHERE vec_id IS NOT NULL ORDER BY j LIMIT 8) JOIN v USING (id))",
    ]
    for r in range(rounds):
        ctes.append(f"a{r} AS MATERIALIZED ({near(f'c{r}')})")
        ctes.append(
            f"c{r + 1} AS MATERIALIZED (SELECT c.j, c.d, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN"
            f" (SELECT j, d, CASE WHEN sum(x) % count(*) < 0 THEN sum(x) // count(*) - 1 ELSE sum(x) // count(*) END AS x FROM a{r} JOIN v USING (id) GROUP BY j, d) m ON m.j = c.j AND m.d = c.d)"
        )
    last = f"c{rounds}"
    return (
        f"WITH {', '.join(ctes)}, a AS ({near(last)}), h AS (SELECT j, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS h FROM {last} GROUP BY j)"
        " SELECT vec_id, j::INT AS cluster, dist::BIGINT AS distance, (sum(dist) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(dist) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM a JOIN h USING (j)"
    )


MERKLE, CENTROIDS = _merkle(), _centroids()

ORACLES = {"op1_warc": WARC, "op3_jaccard_join": JACCARD, "op4_sharding": SHARDING, "op11_media_chunks": MEDIA, "op12_merkle_manifest": MERKLE, "op13_centroids": CENTROIDS}
