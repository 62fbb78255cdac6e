"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

import corpus_pipeline

from . import chat, langid, lines, lloyd, minhash, mixing, prefixjoin, shard, simhash, tiling, tokens, toxicity, trie

MODULES = [minhash, lines, prefixjoin, shard, chat, langid, mixing, toxicity, tokens, tiling, simhash, trie, lloyd]


def queries():
    out = {}
    for m in MODULES:
        out.update(m.QUERIES)
    return out | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    out = {}
    for m in MODULES:
        out.update(getattr(m, "ORACLE", {}))
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
