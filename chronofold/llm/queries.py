"""The registered queries of this subpackage, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import chat_template, fingerprints, jaccard_join, neighbours, packing, pair_index_bpe, pii, rans_store, toxicity, warc

MODULES = [toxicity, warc, rans_store, neighbours, pii, packing, fingerprints, jaccard_join, pair_index_bpe, chat_template]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
