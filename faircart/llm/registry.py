"""Driver queries of this subpackage and, where SQL can express one, its DuckDB text."""

from . import ann, decontam, license_scan, lm, merkle, packing, pii, simhash, substring, toxicity, trie, urlfilter, warc

QUERIES = {
    "op1_ann": ann.op1_ann,
    "op2_simhash": simhash.op2_simhash,
    "op3_warc": warc.op3_warc,
    "op4_urls": urlfilter.op4_urls,
    "op5_pii": pii.op5_pii,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_packing": packing.op7_packing,
    "op8_licenses": license_scan.op8_licenses,
    "op9_lm": lm.op9_lm,
    "op10_decontam": decontam.op10_decontam,
    "op11_trie": trie.op11_trie,
    "op12_merkle": merkle.op12_merkle,
    "op13_substring": substring.op13_substring,
}

#: Containment of five-word shingles, item by item; items of fewer words are one shingle.
OP10 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '[\pL\pN_]+') AS w FROM documents WHERE text IS NOT NULL
), b AS (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(lower(text), '[\pL\pN_]+') AS w FROM benchmark WHERE text IS NOT NULL
), bs AS (
  SELECT DISTINCT q, item_id, least(len(w), 5) AS n, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM b WHERE len(w) > 0)
), size AS (SELECT q, count(*) AS shingles FROM bs GROUP BY q
), ds AS (
  SELECT DISTINCT r, doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bs) WHERE len(w) >= n)
)
SELECT doc_id, item_id, shared, shingles, shared / shingles AS containment FROM (
  SELECT r, doc_id, q, item_id, count(*) AS shared FROM ds JOIN bs USING (n, s) GROUP BY ALL
) JOIN size USING (q) WHERE shared >= ceil(0.8 * shingles - 1e-9)
"""

#: crc32 of the text form of a value, bit by bit.
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split({0}::VARCHAR, '')]),
  lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""

#: Conversations are lists of turns; a node is a distinct prefix, and its descendants are the nodes whose smallest conversation has it as a prefix.
OP11 = f"""
WITH t AS (
  SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce("text", '')}} ORDER BY turn NULLS FIRST, role, "text") AS w
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (SELECT *, {CRC.format("c")} % 9 AS h FROM t
), r AS (
  SELECT h.c, list_concat(coalesce(b.w, [])[1:h.h], h.w[h.h + 1:]) AS w FROM h LEFT JOIN t b ON b.c = h.c - h.c % 5
), p AS (SELECT c, d, len(w) AS n, w[1:d] AS k, w[d]."text" AS last FROM (SELECT *, unnest(range(0, len(w) + 1)) AS d FROM r)
), n AS (
  SELECT k, d, min(c) AS c, count(*) AS n_convs, any_value(last) AS last,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends
  FROM p GROUP BY k, d
), u AS (SELECT a.c, a.d, b.c AS up FROM n a JOIN p ON p.c = a.c AND p.d = a.d - 1 JOIN n b ON b.k = p.k AND b.d = p.d
), f AS (SELECT up AS c, d - 1 AS d, count(*) AS n_children FROM u GROUP BY ALL
), g AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN f USING (c, d)
), s AS (
  SELECT a.k, a.d, sum((g.n_convs - 1) * coalesce(strlen(g.last), 0)) AS saved, count(*) FILTER (WHERE g.n_children = 0) AS n_leaves
  FROM g JOIN p a ON a.c = g.c AND a.d <= g.d GROUP BY a.k, a.d
)
SELECT g.c AS conv_id, g.d AS depth, u.up AS parent_conv_id, n_convs, n_children, n_leaves, saved::BIGINT AS saved_tokens, ends AS ends_sha256
FROM g JOIN s USING (k, d) LEFT JOIN u ON u.c = g.c AND u.d = g.d
"""


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


#: Trees by recursion over levels, the sources' tree as one more group; then each leaf is folded upwards.
OP12 = f"""
WITH RECURSIVE l AS (
  SELECT row_number() OVER () AS r, doc_id, source,
         sha256(concat({", ".join(map(_field, ("doc_id", "source", "lang", "n_chars", '"text"')))})) AS leaf,
         sha256(concat({", ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "translate(\"text\", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")))})) AS struck,
         coalesce({CRC.format("doc_id")} % 5 = 0, false) AS hit
  FROM documents
), o AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l
), t AS (
  SELECT g, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY g) AS n FROM o
  UNION ALL
  SELECT g, level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 15) // 16) FROM t WHERE n > 1 GROUP BY g, level, pos // 16
), top AS (
  SELECT 0 AS level, g AS pos, h, count(*) OVER () AS n FROM t WHERE n = 1
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 15) // 16) FROM top WHERE n > 1 GROUP BY level, pos // 16
), a AS (SELECT g, level, pos, h, n FROM t UNION ALL SELECT -1, level, pos, h, n FROM top
), side AS (
  SELECT x.g, x.level, x.pos, x.n, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (WHERE y.pos < x.pos), '') AS lhs,
         coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (WHERE y.pos > x.pos), '') AS rhs
  FROM a x JOIN a y ON y.g = x.g AND y.level = x.level AND y.pos // 16 = x.pos // 16 GROUP BY ALL
), f AS (
  SELECT r, g, g AS own, 0 AS level, pos, CASE WHEN hit THEN struck ELSE leaf END AS cur, '' AS proof, false AS done FROM o
  UNION ALL
  SELECT r, CASE WHEN s.n = 1 THEN -1 ELSE s.g END, own, CASE WHEN s.n = 1 THEN 0 ELSE s.level + 1 END, CASE WHEN s.n = 1 THEN own ELSE s.pos // 16 END,
         CASE WHEN s.n = 1 THEN cur ELSE sha256(lhs || cur || rhs) END, proof || lhs || rhs, s.n = 1 AND s.g = -1
  FROM f JOIN side s ON s.g = f.g AND s.level = f.level AND s.pos = f.pos WHERE NOT done
)
SELECT o.doc_id, o.leaf, t.h AS subroot, root.h AS root, sha256(f.proof) AS proof_sha256, f.cur AS folded_root, f.cur = root.h AS verified
FROM f JOIN o USING (r) JOIN t ON t.g = o.g AND t.n = 1 JOIN (SELECT h FROM top WHERE n = 1) root ON true WHERE f.done
"""

#: Windows as strings; the words that a window of an earlier document covers go.
OP13 = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM w)
), f AS (SELECT s, min(doc_id) AS first FROM p GROUP BY s
), hit AS (SELECT DISTINCT r, i + j AS x FROM (SELECT r, i FROM p JOIN f USING (s) WHERE first < coalesce(doc_id, 9223372036854775807)), range(0, 13) y(j)
), gone AS (SELECT r, list(x) AS cut FROM hit GROUP BY r
), o AS (SELECT doc_id, w, coalesce(cut, []) AS cut FROM w LEFT JOIN gone USING (r))
SELECT doc_id, len(w) AS n_words, len(cut) AS n_removed, sha256(array_to_string([x FOR x, i IN w IF NOT list_contains(cut, i)], ' ')) AS kept_sha256 FROM o
"""

ORACLE_SQL: dict[str, str] = {"op10_decontam": OP10, "op11_trie": OP11, "op12_merkle": OP12, "op13_substring": OP13}
