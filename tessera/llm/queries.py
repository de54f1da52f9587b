"""The queries of the numbered operators and the SQL that checks them."""

from __future__ import annotations

from .bpe import op4_bpe
from .language_model import op10_lm_scoring
from .near_dedup import op3_near_dedup
from .packing import op7_best_fit_packing
from .pii import op8_pii
from .quality_model import op5_quality_classifier
from .quality_rules import op2_quality_rules
from .secrets import op9_secret_scan
from .sharding import op1_kd_sharding
from .topk import op6_topk_search

QUERIES = {
    f.__name__: f
    for f in (op1_kd_sharding, op2_quality_rules, op3_near_dedup, op4_bpe, op5_quality_classifier, op6_topk_search, op7_best_fit_packing, op8_pii, op9_secret_scan, op10_lm_scoring)
}

ORACLE_SQL = {
    "op6_topk_search": """
WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings),
s AS (SELECT a.id AS query_id, b.id AS vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id % 50 = 0 AND a.id <> b.id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
}
