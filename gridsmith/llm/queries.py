"""The operators' queries over the driver's tables, and their SQL."""

from __future__ import annotations

from gridsmith.llm.common import table
from gridsmith.llm.decontaminate import contaminated
from gridsmith.llm.jaccard import jaccard_components
from gridsmith.llm.licenses import scan_licenses
from gridsmith.llm.lm import score_documents
from gridsmith.llm.packing import pack
from gridsmith.llm.pii import pii_report
from gridsmith.llm.secrets import secrets_report, secrets_sql
from gridsmith.llm.suffixes import remove_repeats
from gridsmith.llm.topk import top_k, top_k_sql
from gridsmith.llm.toxicity import score_toxicity


def op1_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"))


def op3_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op5_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op6_secret_scans(spark, sf_dir):
    return secrets_report(table(spark, sf_dir, "documents"))


def op7_pii(spark, sf_dir):
    return pii_report(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))


def op9_license_scans(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_decontamination": op3_decontamination,
    "op4_packing": op4_packing,
    "op5_top_k": op5_top_k,
    "op6_secret_scans": op6_secret_scans,
    "op7_pii": op7_pii,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_license_scans": op9_license_scans,
    "op10_toxicity": op10_toxicity,
}

#: All windows of 100 bytes by definition, then the islands of removed bytes and what is left between them.
SUFFIX_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, b, unnest(range(0, octet_length(b) - 99)) AS p FROM d WHERE octet_length(b) >= 100),
t AS (SELECT doc_id, p, b[p + 1:p + 100] AS t FROM w),
m AS (SELECT t, min(doc_id * 4294967296::HUGEINT + p) AS first FROM t GROUP BY t HAVING count(*) > 1),
l AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM t JOIN m USING (t) WHERE doc_id * 4294967296::HUGEINT + p > first),
i AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS i FROM l),
s AS (SELECT doc_id, i, min(p) AS a, max(p) + 100 AS z FROM i GROUP BY 1, 2),
k AS (SELECT s.doc_id, a, z, hex(b[coalesce(lag(z) OVER (PARTITION BY s.doc_id ORDER BY a), 0) + 1:a]) AS h FROM s JOIN d USING (doc_id)),
r AS (SELECT doc_id, sum(z - a) AS gone, count(*) AS spans, max(z) AS last, string_agg(h, '' ORDER BY a) AS h FROM k GROUP BY 1)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(CASE WHEN spans IS NULL THEN b ELSE unhex(h || hex(b[last + 1:])) END) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""

#: All pairs by their common shingles, then everything that is reachable.
JACCARD_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b USING (g) WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r AS (WITH RECURSIVE c(x, y) AS (SELECT x, x FROM e UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x) SELECT x, min(y) AS y FROM c GROUP BY x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(r.y, doc_id) AS component_id FROM s LEFT JOIN r ON r.x = doc_id
"""

SQL = {
    "op1_suffix_dedup": SUFFIX_SQL,
    "op8_jaccard_join": JACCARD_SQL,
    "op5_top_k": top_k_sql(),
    "op6_secret_scans": secrets_sql(),
}
