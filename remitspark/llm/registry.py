"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from remitspark.llm.additive_ann import op5_additive_ann
from remitspark.llm.byte_bpe import op11_byte_bpe
from remitspark.llm.divergence import op12_source_divergence
from remitspark.llm.epsgrid import op4_embedding_neardup
from remitspark.llm.license_scan import op8_license_scan
from remitspark.llm.merkle import op13_merkle_manifest
from remitspark.llm.mixing import op1_pareto_mixing
from remitspark.llm.piece_bpe import op6_sentencepiece
from remitspark.llm.sharding import op9_tiered_sharding
from remitspark.llm.simhash import op3_simhash_neardup
from remitspark.llm.substring import op2_substring_dedup
from remitspark.llm.suffix_array import op10_suffix_dedup
from remitspark.llm.toxicity import op7_toxicity_mil

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_pareto_mixing, op2_substring_dedup, op3_simhash_neardup, op4_embedding_neardup, op5_additive_ann, op6_sentencepiece, op7_toxicity_mil, op8_license_scan, op9_tiered_sharding, op10_suffix_dedup, op11_byte_bpe, op12_source_divergence, op13_merkle_manifest)}


#: Where SQL can say it: every window of 35 words by its words, and links and reach of vectors by brute force.
SUBSTRING = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
  p AS (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
  r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + 34], ' ')) AS c FROM p) WHERE c > 1),
  g AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS j FROM r), n AS (SELECT rid, count(*) AS gone FROM g GROUP BY 1),
  u AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM d),
  k AS (SELECT u.rid, string_agg(x, ' ' ORDER BY u.j) AS kept FROM u LEFT JOIN g ON g.rid = u.rid AND g.j = u.j WHERE g.rid IS NULL GROUP BY 1)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN n USING (rid) LEFT JOIN k USING (rid)"""
NEAR = """WITH RECURSIVE v AS (SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
  good AS (SELECT * FROM v WHERE e IS NOT NULL AND label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
  l AS (SELECT a.rid AS p, b.rid AS q FROM good a JOIN good b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
  reach(p, q) AS (SELECT rid, rid FROM v UNION SELECT reach.p, l.q FROM reach JOIN l ON l.p = reach.q),
  c AS (SELECT p, min(vec_id) AS component_id FROM reach JOIN v ON v.rid = reach.q GROUP BY 1), n AS (SELECT p, count(*) AS n_links FROM l GROUP BY 1)
  SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept FROM v JOIN c ON c.p = v.rid LEFT JOIN n ON n.p = v.rid"""

#: The hash trees level by level; CRC-32 by its table, which follows from its polynomial.
MERKLE = """WITH RECURSIVE bit(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bit WHERE k < 8),
  crc AS (SELECT list(c ORDER BY i) AS t FROM bit WHERE k = 8),
  f AS (SELECT row_number() OVER () AS rid, doc_id, lang, n_chars, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS a, coalesce(octet_length(encode(text)) || ':' || text, '-') AS z,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 7 = 0 AS hit FROM documents, crc),
  d AS (SELECT rid, doc_id, lang, sha256(a || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') || z) AS leaf, CASE WHEN hit THEN sha256(a || coalesce(octet_length(encode(CAST(n_chars::HUGEINT + 1 AS VARCHAR))) || ':' || (n_chars::HUGEINT + 1), '-') || z) END AS changed FROM f),
  l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM d),
  tree(lang, h, pos, n, x) AS (SELECT lang, 0, place, n, leaf FROM l UNION ALL SELECT lang, h + 1, pos // 2, (n + 1) // 2, sha256(string_agg(x, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY lang, h, pos // 2, n),
  s AS (SELECT lang, x AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1),
  crown(h, pos, n, x) AS (SELECT 0, place, n, subroot FROM s UNION ALL SELECT h + 1, pos // 2, (n + 1) // 2, sha256(string_agg(x, '' ORDER BY pos)) FROM crown WHERE n > 1 GROUP BY h, pos // 2, n),
  up AS (SELECT s.lang, s.subroot, list(CASE WHEN b.x IS NULL THEN '-' WHEN a.pos % 2 = 0 THEN '>' || b.x ELSE '<' || b.x END ORDER BY a.h) AS path FROM s JOIN crown a ON a.n > 1 AND a.pos = s.place >> a.h LEFT JOIN crown b ON b.h = a.h AND b.pos = xor(a.pos, 1) GROUP BY 1, 2),
  own AS (SELECT l.rid, list(CASE WHEN b.x IS NULL THEN '-' WHEN a.pos % 2 = 0 THEN '>' || b.x ELSE '<' || b.x END ORDER BY a.h) AS path FROM l JOIN tree a ON a.lang IS NOT DISTINCT FROM l.lang AND a.n > 1 AND a.pos = l.place >> a.h LEFT JOIN tree b ON b.lang IS NOT DISTINCT FROM a.lang AND b.h = a.h AND b.pos = xor(a.pos, 1) GROUP BY 1),
  p AS (SELECT doc_id, leaf, s.subroot, coalesce(changed, leaf) AS start, list_concat(coalesce(own.path, []), coalesce(up.path, [])) AS path FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang LEFT JOIN own USING (rid) LEFT JOIN up ON up.subroot = s.subroot AND up.lang IS NOT DISTINCT FROM s.lang),
  r AS (SELECT doc_id, leaf, subroot, (SELECT x FROM crown WHERE n = 1) AS root, sha256(array_to_string(list_transform(path, lambda y: substr(y, 2)), '')) AS proof_sha256,
    list_reduce(list_concat([start], path), lambda g, y: sha256(CASE WHEN y[1] = '<' THEN substr(y, 2) || g WHEN y[1] = '>' THEN g || substr(y, 2) ELSE g END)) AS folded_root FROM p)
  SELECT *, folded_root = root AS verified FROM r"""

#: Every kept term of every group, those that do not occur there too, without any of the operator's sums by kind.
DIVERGENCE = r"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
  o AS (SELECT rid, lang, source, unnest(w) AS term FROM d), k AS (SELECT lang, term, count(*) AS m FROM o GROUP BY 1, 2 HAVING count(DISTINCT rid) >= 3), g AS (SELECT DISTINCT lang, source FROM d),
  c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY 1, 2, 3), e AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
  q AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (m + 1) // (sum(m) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM k),
  p AS (SELECT *, 1 + CAST(1000000000 AS HUGEINT) * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM e),
  b AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
  u AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN b ON b.lang = x.lang AND b.source = x.source AND b.item = y.source
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
  r AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
  SELECT * FROM r WHERE part = 'pair' OR rank <= 200"""


def oracle_sql() -> dict[str, str]:
    return {"op12_source_divergence": DIVERGENCE, "op13_merkle_manifest": MERKLE, "op2_substring_dedup": SUBSTRING, "op4_embedding_neardup": NEAR}
