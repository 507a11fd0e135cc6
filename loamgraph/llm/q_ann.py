from __future__ import annotations

from ..session import table
from . import ann as A

QUERIES = {
    "p1_found": lambda s, d: A.similar_pairs(table(s, d, "chunk_embeddings")),
    "p1_copies": lambda s, d: A.copies(table(s, d, "chunk_embeddings")),
    "p1_nearest": lambda s, d: A.nearest(table(s, d, "chunk_embeddings")),
}
_USABLE = """
  v AS (SELECT DISTINCT provider, model_id, dimensions, chunk_id, embedding::DOUBLE[] AS e, embedding AS raw FROM chunk_embeddings
        WHERE chunk_id IS NOT NULL AND embedding_id IS NOT NULL AND provider IS NOT NULL AND model_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = dimensions
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
"""
SQL = {
    "p1_found": f"""WITH {_USABLE},
      s AS (SELECT a.chunk_id AS i, b.chunk_id AS j, round(list_cosine_similarity(a.e, b.e), 12) AS c
            FROM v a JOIN v b ON a.provider = b.provider AND a.model_id = b.model_id AND a.dimensions = b.dimensions AND a.chunk_id <> b.chunk_id),
      r AS (SELECT *, rank() OVER (PARTITION BY i ORDER BY c DESC) AS k FROM s)
      SELECT DISTINCT least(i, j) AS chunk_id_a, greatest(i, j) AS chunk_id_b FROM r WHERE k <= 5 AND c >= 0.9""",
    "p1_copies": f"""WITH {_USABLE},
      g AS (SELECT provider, model_id, dimensions, raw, min(chunk_id) AS first_chunk_id, count(*) AS copies FROM v GROUP BY ALL HAVING count(*) > 1)
      SELECT provider, model_id, g.first_chunk_id, v.chunk_id, g.copies FROM g JOIN v USING (provider, model_id, dimensions, raw)""",
}
