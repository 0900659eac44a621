"""Pipelines composed of the operators, and a look at the plan that Spark made of one."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratakb.functions.text import body_sha256
from stratakb.operators import chunking, governance, retrieval


@dataclass(frozen=True)
class Ingested:
    """What an ingest writes: new documents with their hash, and their chunks."""

    documents: DataFrame
    chunks: DataFrame


def ingest(raw: DataFrame, stored: DataFrame, least: int = chunking.LEAST, most: int = chunking.MOST, overlap: int = chunking.OVERLAP) -> Ingested:
    """New documents of raw (doc_id, body, stored_at, ...) and their chunks.

    stored has content_sha256 of what is held already. A body that is held, or that an earlier row of
    the batch has (by stored_at, then doc_id), isn't taken; the anti join stands before the chunker, so
    only new bodies reach Python. Null ids and null bodies are dropped.
    """
    hashed = governance.latest(raw, "doc_id", "stored_at").where("body is not null").withColumn("content_sha256", body_sha256(F.col("body")))
    fresh = hashed.join(stored.select("content_sha256").where("content_sha256 is not null").distinct(), "content_sha256", "left_anti")
    first = fresh.groupBy("content_sha256").agg(F.min_by("doc_id", F.struct("stored_at", "doc_id")).alias("doc_id"))
    documents = fresh.join(first, ["content_sha256", "doc_id"], "left_semi")
    return Ingested(documents, chunking.chunk_documents(documents, "doc_id", "body", least, most, overlap))


def remove(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every derived table without the documents in gone."""
    return {name: governance.remove_documents(df, gone) for name, df in tables.items()}


def fused_search(lists: list[DataFrame], query: str, item: str, k: int = 10) -> DataFrame:
    """The k best items of each query over several ranked lists."""
    return retrieval.top_ranked(retrieval.reciprocal_rank_fusion(lists, query, item), k, query, item, "rrf_score")


def operators(df: DataFrame) -> Counter[str]:
    """How often each physical operator stands in the plan of df."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return Counter(re.findall(r"(?m)^[\s:+|*()\d-]*?([A-Z]\w+)", plan))
