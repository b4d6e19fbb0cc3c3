"""Registry of named queries and their DuckDB oracle SQL.

``register(name, sql)`` decorates a ``(spark, sf_dir) -> DataFrame`` function.
``sql`` is an equivalent query over the pre-registered DuckDB views; omit it for
operators that are not SQL-expressible (streams, hooks).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so that it registers its queries."""
    from cadenza.plans import (  # noqa: F401
        q_align, q_chain, q_corpus, q_curate, q_defects, q_lexicon, q_metre, q_phonetics, q_rhyme, q_similarity, q_sinks, q_scans, q_stats, q_streams, q_tags, q_thesaurus, q_tokens,
    )
