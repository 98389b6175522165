"""The registered queries and their SQL."""

from gristmill.plans import index_queries, replay_queries, sketch_queries

_PARTS = (sketch_queries, index_queries, replay_queries)

QUERIES: dict = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
ORACLE: dict = {k: s for p in _PARTS for k, s in p.ORACLE.items()}
FLAGSHIP = "digest_summary"
