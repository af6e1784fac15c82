"""Every query of the training-data operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuscope.llm import audit, bpe, fingerprints, language, lmscore, media, mixing, neardup, packing, sharding, toxicity, trie, webarchive

MODULES = (lmscore, language, webarchive, neardup, toxicity, sharding, packing, fingerprints, mixing, media, bpe, audit, trie)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: q for m in MODULES for k, q in m.ORACLE_SQL.items()}
