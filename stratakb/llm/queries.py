"""The queries of the training-data operators, pN_ for problem N, and their SQL where SQL can say it.

Each callable takes (spark, directory of the tables) and reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratakb.llm import bpe, furniture, knn, moderation, neardup, packing, residue, truncation
from stratakb.operators.governance import latest
from stratakb.session import cut, table

Query = Callable[[SparkSession, str], DataFrame]


# --- 1: cut values -----------------------------------------------------------------------------------


def p1_found(spark: SparkSession, at: str) -> DataFrame:
    """(chunk_id, field) of the summaries and contents that break off."""
    return truncation.truncated(table(spark, at, "chunks")).select("chunk_id", "field")


def p1_source_rates(spark: SparkSession, at: str) -> DataFrame:
    """Per source and column, how many non-empty values there are and which share was cut."""
    return truncation.source_rates(table(spark, at, "chunks"))


# --- 2: most similar vectors -------------------------------------------------------------------------


def chunk_vectors(spark: SparkSession, at: str) -> DataFrame:
    """(key, vec, id) of chunk vectors; the key is a 64-bit hash of chunk_id, short enough to shuffle."""
    rows = table(spark, at, "vectors").where("kind = 'chunk' and chunk_id is not null")
    return rows.select(F.xxhash64("chunk_id").alias("key"), F.col("dense_vector").alias("vec"), "id")


def chunk_names(spark: SparkSession, at: str) -> DataFrame:
    rows = table(spark, at, "vectors").where("kind = 'chunk' and chunk_id is not null")
    return rows.select(F.xxhash64("chunk_id").alias("key"), "chunk_id").distinct()


def p2_found(spark: SparkSession, at: str) -> DataFrame:
    """Pairs of chunks of which one is among the 10 most similar of the other, with a cosine of 0.85 or more."""
    near = knn.most_similar(chunk_vectors(spark, at).withColumn("query", F.lit(True)), k=10, min_sim=0.85)
    pairs = near.select(F.least("key", "near").alias("lo"), F.greatest("key", "near").alias("hi")).repartition("lo").distinct()
    names = chunk_names(spark, at)
    a = names.select(F.col("key").alias("lo"), F.col("chunk_id").alias("x"))
    b = names.select(F.col("key").alias("hi"), F.col("chunk_id").alias("y"))
    both = pairs.join(a, "lo").join(b, "hi")
    return both.select(F.least("x", "y").alias("chunk_id_a"), F.greatest("x", "y").alias("chunk_id_b"))


def p2_topk(spark: SparkSession, at: str) -> DataFrame:
    """(chunk_id, rank, near_chunk_id, sim) for the query set id % 100 = 0 against all chunk vectors."""
    asked = chunk_vectors(spark, at).withColumn("query", F.col("id") % 100 == 0)
    near = knn.most_similar(asked, k=10, distance=1.0, success=0.98, scan=True)
    names = chunk_names(spark, at)
    a = names.select("key", "chunk_id")
    b = names.select(F.col("key").alias("near"), F.col("chunk_id").alias("near_chunk_id"))
    ranked = near.join(a, "key").join(b, "near")
    rank = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("sim"), "near_chunk_id"))
    return ranked.select("chunk_id", rank.alias("rank"), "near_chunk_id", F.round("sim", 4).alias("sim"))


# --- 3: near-duplicates ------------------------------------------------------------------------------

NEAR = {"threshold": 0.6, "size": 3, "least": 40}


def chunk_texts(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "chunks").select(F.col("chunk_id").alias("id"), F.col("content").alias("text"))


def p3_found(spark: SparkSession, at: str) -> DataFrame:
    """Pairs of chunks whose sets of three consecutive tokens have a Jaccard similarity of 0.6 or more."""
    pairs = neardup.similar_pairs(chunk_texts(spark, at), **NEAR)
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p3_groups(spark: SparkSession, at: str) -> DataFrame:
    """(chunk_id, group_id, links) of the groups formed by those pairs."""
    return neardup.similar_groups(chunk_texts(spark, at), **NEAR).withColumnRenamed("id", "chunk_id")


# --- 4: residue --------------------------------------------------------------------------------------


def residue_records(spark: SparkSession, at: str) -> DataFrame:
    chunks = table(spark, at, "chunks").select(F.lit("chunks").alias("record_table"), F.col("chunk_id").alias("record_id"), F.col("content").alias("text"))
    answers = table(spark, at, "qa_answers").select(F.lit("qa_answers").alias("record_table"), F.col("answer_id").alias("record_id"), F.col("answer").alias("text"))
    return chunks.unionByName(answers)


def p4_found(spark: SparkSession, at: str) -> DataFrame:
    """(record_table, record_id) of contents and answers that hold or are residue."""
    return residue.residue(residue_records(spark, at))


def without_residue(spark: SparkSession, at: str, name: str, key: str, order: str) -> DataFrame:
    """The last row of each key of a table, without the records of p4_found; rows with a null key all stay."""
    rows = table(spark, at, name)
    gone = p4_found(spark, at).where(F.col("record_table") == name).select(F.col("record_id").alias(key))
    kept = latest(rows, key, order).join(gone, key, "left_anti")
    return kept.select(*rows.columns).unionByName(rows.where(F.col(key).isNull()))


def p4_clean_chunks(spark: SparkSession, at: str) -> DataFrame:
    """Chunks, once each, without the records of p4_found."""
    return without_residue(spark, at, "chunks", "chunk_id", "ingested_at")


def p4_clean_answers(spark: SparkSession, at: str) -> DataFrame:
    """Answers, once each, without the records of p4_found."""
    return without_residue(spark, at, "qa_answers", "answer_id", "logged_at")


# --- 5: page furniture -------------------------------------------------------------------------------


def p5_found(spark: SparkSession, at: str) -> DataFrame:
    """(chunk_id, line_no) of lines of the page around the article."""
    return furniture.furniture_lines(table(spark, at, "chunks"))


def p5_content(spark: SparkSession, at: str) -> DataFrame:
    """(chunk_id, content) without those lines."""
    chunks = table(spark, at, "chunks")
    return furniture.without_lines(chunks, cut(furniture.furniture_lines(chunks), "furniture"))


# --- 6 and 7: tokens and containers ------------------------------------------------------------------


def p6_ids(spark: SparkSession, at: str) -> DataFrame:
    """(doc_id, ids) of every document."""
    return bpe.encode_column(table(spark, at, "documents"))


def token_sizes(spark: SparkSession, at: str) -> DataFrame:
    return cut(p6_ids(spark, at).select("doc_id", F.size("ids").alias("size")), "sizes")


def p7_packing(spark: SparkSession, at: str) -> DataFrame:
    """(container_id, doc_id, start, end): every text with a token, in containers of 2,048 tokens."""
    return packing.pack(token_sizes(spark, at))


def p7_containers(spark: SparkSession, at: str) -> DataFrame:
    """(container_id, used, items, ranges): one row a container."""
    return packing.containers(packing.pack(token_sizes(spark, at)))


# --- 8: abusive, hateful and sexual content ----------------------------------------------------------


def p8_scores(spark: SparkSession, at: str) -> DataFrame:
    """(doc_id, score, sentence, sentence_no, sentence_score) of every document."""
    return scored_documents(spark, at).drop("source")


def scored_documents(spark: SparkSession, at: str) -> DataFrame:
    """p8_scores with the source of each document, carried through the pass that scores."""
    model = moderation.train(table(spark, at, "moderation_examples"))
    return moderation.score(table(spark, at, "documents"), model, keep="source")


def p8_found(spark: SparkSession, at: str) -> DataFrame:
    """(doc_id) of the documents with such content."""
    return p8_scores(spark, at).where(F.col("score") >= moderation.THRESHOLD).select("doc_id")


def p8_source_rates(spark: SparkSession, at: str) -> DataFrame:
    """Documents, offending documents and their share per source; a null source is ''."""
    scores = scored_documents(spark, at).select(F.coalesce("source", F.lit("")).alias("source"), "score")
    found = F.sum((F.col("score") >= moderation.THRESHOLD).cast("long"))
    return scores.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), found.alias("found")).withColumn("share", F.round(F.col("found") / F.col("documents"), 6))


QUERIES: dict[str, Query] = {
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_source_rates": p8_source_rates,
    "p1_found": p1_found,
    "p1_source_rates": p1_source_rates,
    "p4_found": p4_found,
    "p4_clean_chunks": p4_clean_chunks,
    "p4_clean_answers": p4_clean_answers,
    "p5_found": p5_found,
    "p5_content": p5_content,
    "p2_found": p2_found,
    "p2_topk": p2_topk,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p6_ids": p6_ids,
    "p7_packing": p7_packing,
    "p7_containers": p7_containers,
}

#: No SQL: these are iterative, learned or too slow in SQL; tests/llm holds them against brute force.
ORACLE: dict[str, str] = {}
