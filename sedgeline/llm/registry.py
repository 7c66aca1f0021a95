"""Queries of this subpackage, and DuckDB SQL for those that SQL expresses over whole tables."""

from __future__ import annotations

import corpus_pipeline

from .jaccard import op4_jaccard
from .licenses import op5_licenses
from .mixing import op3_mixing
from .neighbours import op9_neighbours
from .packing import op10_packing
from .pii import op2_pii
from .quality import op8_quality
from .substrings import op6_substrings
from .tokencounts import op7_token_counts
from .toxicity import op1_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_pii, op3_mixing, op4_jaccard, op5_licenses, op6_substrings, op7_token_counts, op8_quality, op9_neighbours, op10_packing)
} | {"pipeline": corpus_pipeline.run}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op4_jaccard": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, CASE WHEN len(w) = 0 THEN 1 ELSE greatest(len(w) - 4, 1) + 1 END)) AS i FROM d)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op6_substrings": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM d)),
t AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM g SEMI JOIN t USING (g)),
u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS k FROM d),
v AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY k) AS kept FROM u ANTI JOIN c USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(v.n, 0) AS n_removed, sha256(coalesce(v.kept, '')) AS kept_sha256
FROM d LEFT JOIN v USING (doc_id)
""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
