"""The queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

import corpus_pipeline
from mailquarry.llm import bpe, bytebpe, centroids, chat, decontaminate, htmltext, langid, media, negatives, sharding, simhash, suffixdedup, warc

_MODULES = (simhash, htmltext, warc, langid, sharding, bpe, media, chat, decontaminate, suffixdedup, negatives, bytebpe, centroids)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in getattr(m, "ORACLE_SQL", {}).items()}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
