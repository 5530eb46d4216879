"""DuckDB SQL of the queries whose rows SQL can give."""

from __future__ import annotations

OP1 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""

_CRCS = """crcs AS (SELECT list_transform(range(256), lambda v: list_reduce(list_prepend(v, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"""


def _crc(hexed: str) -> str:
    """CRC-32 of bytes in hex, by the table of crcs."""
    return f"""xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length({hexed}), 2), lambda i: ('0x' || substr({hexed}, i, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"""


def _lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _leaf(text: str) -> str:
    parts = [f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)]
    return f"sha256({' || '.join(parts)})"


def _climb(name: str, base: str) -> str:
    """All nodes (tree, level, pos, n, digest) of the trees of base (tree, pos, n, digest)."""
    return f"""{name} AS (SELECT tree, 0 AS level, pos, n, digest FROM {base}
    UNION ALL SELECT tree, level + 1, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 8)"""


def _beside(nodes: str) -> str:
    """The digests left and right of each node in its run."""
    return f"""SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
        coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
    FROM {nodes} a LEFT JOIN {nodes} b ON a.tree IS NOT DISTINCT FROM b.tree AND a.level = b.level AND a.pos // 8 = b.pos // 8 AND a.pos <> b.pos WHERE a.n > 1 GROUP BY ALL"""


def _paths(base: str, sides: str) -> str:
    return f"""SELECT p.tree, p.pos, list({{'l': s.l, 'r': s.r}} ORDER BY s.level) FILTER (s.level IS NOT NULL) AS path
    FROM {base} p LEFT JOIN {sides} s ON p.tree IS NOT DISTINCT FROM s.tree AND s.pos = p.pos // (8 ** s.level)::BIGINT GROUP BY ALL"""


OP11 = f"""
WITH RECURSIVE {_CRCS},
leaves AS (SELECT doc_id, lang AS tree, {_leaf("text")} AS digest, CASE WHEN {_crc("hex(doc_id::VARCHAR)")} % 3 = 0 THEN {_leaf(_lower("text"))} ELSE {_leaf("text")} END AS seen FROM documents, crcs),
based AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
{_climb("nodes", "based")},
tops AS (SELECT tree AS lang, digest AS subroot FROM nodes WHERE n = 1),
roots AS (SELECT 0 AS tree, lang, subroot AS digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tops),
{_climb("above", "roots")},
sides AS ({_beside("nodes")}), over_sides AS ({_beside("above")}),
own AS ({_paths("based", "sides")}), upper AS ({_paths("roots", "over_sides")}),
whole AS (SELECT b.doc_id, b.digest AS leaf, b.seen, r.digest AS subroot, t.digest AS root, list_concat(coalesce(o.path, []), coalesce(u.path, [])) AS path
    FROM based b JOIN own o ON b.tree IS NOT DISTINCT FROM o.tree AND b.pos = o.pos JOIN roots r ON b.tree IS NOT DISTINCT FROM r.lang
    JOIN upper u ON u.pos = r.pos, (SELECT digest FROM above WHERE n = 1) t),
told AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda p: p.l || p.r), '')) AS proof_sha256,
    list_reduce(list_prepend({{'l': seen, 'r': ''}}, path), lambda now, p: {{'l': sha256(p.l || now.l || p.r), 'r': ''}}).l AS folded_root FROM whole)
SELECT *, folded_root = root AS verified FROM told"""

OP12 = """
SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN page_id < keep THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < keep THEN keep END AS refers_to
FROM (SELECT page_id, h, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS keep FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))"""

OP13 = rf"""
WITH {_CRCS},
texts AS (SELECT 0 AS kind, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
worded AS (SELECT kind, row_number() OVER () AS row, doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (SELECT kind, row, f, count(*) AS n FROM (SELECT kind, row, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM worded) GROUP BY ALL),
spelled AS (SELECT DISTINCT f, hex(f) AS x FROM runs),
hashed AS (SELECT f, {_crc("x")} % 10000 AS bucket FROM spelled, crcs),
placed AS (SELECT * FROM runs JOIN hashed USING (f)),
totals AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (kind = 1), 0)::BIGINT AS t FROM placed GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0)::BIGINT AS ss, coalesce(sum(t), 0)::BIGINT AS tt FROM totals),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (ss + 10000) / ((s + 1)::DOUBLE * (tt + 10000))))::BIGINT AS gain FROM totals, sums),
weights AS (SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE kind = 0 GROUP BY row),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM worded LEFT JOIN weights USING (row) WHERE kind = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * able // 100 THEN place END AS rank FROM ranked"""
