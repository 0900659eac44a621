"""Retrieval: exact dense search in blocks, sparse and lexical search, rank fusion, question collapse, rerank order."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratakb.functions.text import tokens


#: Postings of one term that one task multiplies.
TERM_ROWS = 100_000
#: Query terms that are broadcast at most; more are joined by a shuffle.
SENT_TERMS = 200_000


def usable_vectors(df: DataFrame, vec: str = "dense_vector", dim: int = 64) -> DataFrame:
    """Rows with dim finite values that are not all zero; nulls anywhere in the vector drop the row."""
    v = F.col(vec)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(v.isNotNull() & (F.size(v) == dim)).where(finite & F.exists(v, lambda x: x != 0))


def dense_topk(index: DataFrame, queries: DataFrame, k: int, key: str = "id", vec: str = "dense_vector", block_rows: int = 50_000) -> DataFrame:
    """(query_id, id, score, rank): the k index rows with the highest inner product for every query row.

    Both sides are split by hashes of their keys and meet on a grid of blocks, so the work is rows times
    queries in matrix products, no task holds more than a block of rows and a block of queries, and only
    k rows of a query and block are shuffled. Ties are ordered by key. Both sides must hold usable
    vectors; an empty side gives an empty result.
    """
    blocks, asked_blocks = (max(1, -(-side.count() // block_rows)) for side in (index, queries))
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    place = lambda n: F.pmod(F.xxhash64(key), F.lit(n))
    left = index.select(F.col(key).cast("long").alias("id"), F.col(vec).alias("v"), place(blocks).alias("block")).withColumn("tile", grid(asked_blocks))
    right = queries.select(F.col(key).cast("long").alias("query_id"), F.col(vec).alias("v"), place(asked_blocks).alias("tile")).withColumn("block", grid(blocks))

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        rows = column.combine_chunks()
        rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
        return np.asarray(rows.flatten()).astype(np.float64).reshape(len(rows), -1)

    def search(key_: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, x = np.asarray(a.column("id")), matrix(a.column("v"))
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        asked, y = np.asarray(b.column("query_id")), matrix(b.column("v"))
        out = []
        step, most = max(1, 4_000_000 // len(ids)), min(k, len(ids))
        for i in range(0, len(asked), step):
            scores = y[i : i + step] @ x.T
            least = np.partition(scores, len(ids) - most, axis=1)[:, len(ids) - most]
            row, col = np.nonzero(scores >= (least - 2e-9)[:, None])  # all that may be equal to the last one when rounded
            s = scores[row, col]
            order = np.lexsort((col, -np.round(s, 9), row))
            row, col, s = row[order], col[order], s[order]
            first = np.searchsorted(row, row, "left")
            kept = np.arange(len(row)) - first < most
            out.append((asked[i + row[kept]], ids[col[kept]], s[kept]))
        q, c, s = (np.concatenate(z) for z in zip(*out))
        return pa.table({"query_id": q, "id": c, "score": s})

    found = left.groupBy("block", "tile").cogroup(right.groupBy("block", "tile")).applyInArrow(search, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf): one row per document and term; null and empty texts have none."""
    return docs.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def sparse_scores(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query_text: str, rows: int) -> DataFrame:
    """(query_key, key, score): tf * idf inner products over the terms that a query and a document share.

    idf is ln(1 + rows / df) with df counted over all documents. Postings are kept to query terms by a
    semi join before the join that multiplies them; those of a frequent term meet its queries in salted
    parts of TERM_ROWS postings, so that no word is one task.
    """
    asked = queries.select(query_key, F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
    wanted = asked.select("term").distinct()
    held = postings(docs, key, text).join(wanted, "term", "left_semi")
    count = F.count(F.lit(1))
    idf = held.groupBy("term").agg(F.log1p(F.lit(float(rows)) / count).alias("idf"), F.ceil(count / TERM_ROWS).cast("int").alias("parts"))
    weighted = asked.join(idf, "term").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    salted = held.join(idf.select("term", "parts"), "term").withColumn("part", F.pmod(F.hash(key), "parts")).drop("parts")
    scored = weighted.join(salted, ["term", "part"]).groupBy(query_key, key).agg(F.sum(F.col("tf") * F.col("idf") * F.col("idf")).alias("score"))
    return scored.select(query_key, key, F.round("score", 6).alias("score"))


def lexical_topk(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query_text: str, k: int, ways: Iterable[str] = ("sparse",), block_rows: int = 10_000, tile_rows: int = 20_000) -> DataFrame:
    """(list, query_key, key, score, rank): the k best documents of every query, for each of ways.

    list is the place in ways: 'sparse' has the scores of sparse_scores, 'overlap' the number of distinct
    query terms that a document holds. Documents and queries are split by hashes of their keys and meet
    on a grid of blocks, so no task holds more than a block of postings and a tile of queries, no pair of
    a query and a document leaves its task, and only k rows of a query, block and way are shuffled.
    Equal scores are ordered by key, a null key last.
    """
    ways, rows = tuple(ways), docs.count()
    blocks, tiles = max(1, -(-rows // block_rows)), max(1, -(-queries.count() // tile_rows))
    asked = queries.select(F.col(query_key).alias("query"), F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
    wanted = asked.select("term").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= SENT_TERMS else wanted
    words = docs.select(F.col(key).alias("doc"), F.explode(tokens(F.col(text))).alias("term")).join(wanted, "term", "left_semi")
    held = words.groupBy("doc").agg(F.collect_list("term").alias("terms"))  # a row a document: its key isn't shuffled with every term
    idf = held.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.log1p(F.lit(float(rows)) / F.count(F.lit(1))).alias("idf"))
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    left = held.withColumn("block", place("doc", blocks)).withColumn("tile", grid(tiles))
    right = asked.join(idf, "term").withColumn("tile", place("query", tiles)).withColumn("block", grid(blocks))
    kinds = {c: df.schema[c].dataType.simpleString() for df, c in ((queries, query_key), (docs, key))}

    def best(score: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(score)
        if len(at) > k:
            near = np.round(score[at], 6)
            least = np.partition(near, -k)[-k]
            above = at[near > least]
            at = np.concatenate((above, at[near == least][: k - len(above)]))  # documents are numbered by key
        return at

    def numbered(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
        values = pc.unique(column)
        values = values.take(pc.array_sort_indices(values))
        return values, np.asarray(pc.index_in(column, value_set=values))

    def search(_: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"list": pa.array([], pa.int32()), query_key: b.column("query").slice(0, 0), key: a.column("doc").slice(0, 0), "score": pa.array([], pa.float64())})
        terms, query_term = numbered(b.column("term"))
        lists, queries_, found, scores = [np.array([], np.int32)], [np.array([], np.int64)], [np.array([], np.int64)], [np.array([])]
        asking, query_no = numbered(b.column("query"))
        keys, key_no = numbered(a.column("doc"))
        bags = a.column("terms").combine_chunks()
        bags = bags.chunk(0) if isinstance(bags, pa.ChunkedArray) else bags
        term = np.asarray(pc.fill_null(pc.index_in(bags.flatten(), value_set=terms), -1)).astype(np.int64)
        doc = np.repeat(key_no, np.asarray(pc.list_value_length(bags)))
        code, tf = np.unique(term[term >= 0] * len(keys) + doc[term >= 0], return_counts=True)
        term, doc = code // len(keys), code % len(keys)
        weight = np.zeros(len(terms))
        weight[query_term] = np.asarray(b.column("idf"))
        value = tf * weight[term] * weight[term]
        ends = np.searchsorted(term, np.arange(len(terms)), "right")
        starts = np.searchsorted(term, np.arange(len(terms)), "left")
        order = np.lexsort((query_term, query_no))
        for q, own in enumerate(np.split(query_term[order], np.cumsum(np.bincount(query_no))[:-1])):
            spans = [slice(starts[t], ends[t]) for t in own]
            docs_ = np.concatenate([doc[s] for s in spans])
            if not len(docs_):
                continue
            for n, way in enumerate(ways):
                score = np.bincount(docs_, np.concatenate([value[s] for s in spans]) if way == "sparse" else None, len(keys))
                at = best(score)
                lists.append(np.full(len(at), n, np.int32))
                queries_.append(np.full(len(at), q))
                found.append(at)
                scores.append(score[at].astype(np.float64))
        return pa.table({"list": np.concatenate(lists), query_key: asking.take(pa.array(np.concatenate(queries_))), key: keys.take(pa.array(np.concatenate(found))), "score": np.concatenate(scores)})

    found = left.groupBy("block", "tile").cogroup(right.groupBy("block", "tile")).applyInArrow(search, f"list int, `{query_key}` {kinds[query_key]}, `{key}` {kinds[key]}, score double")
    found = found.withColumn("score", F.round("score", 6))
    rank = F.row_number().over(Window.partitionBy("list", query_key).orderBy(F.desc("score"), F.asc_nulls_last(key)))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_ranked(scores: DataFrame, k: int, query: str, item: str, score: str = "score") -> DataFrame:
    """Adds rank 1..k within each query by score, ties by item."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), item))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def reciprocal_rank_fusion(lists: list[DataFrame], query: str, item: str, k: int = 60) -> DataFrame:
    """(query, item, rrf_score, lists): sum of 1 / (k + rank) over ranked lists (query, item, rank)."""
    tagged = [df.select(query, item, "rank", F.lit(i).alias("list")) for i, df in enumerate(lists)]
    return fused(reduce(DataFrame.unionByName, tagged), query, item, k)


def fused(both: DataFrame, query: str, item: str, k: int = 60) -> DataFrame:
    """reciprocal_rank_fusion of lists that are one table, told apart by the column list."""
    return both.groupBy(query, item).agg(F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), 6).alias("rrf_score"), F.count_distinct("list").alias("lists"))


def rounded(value: Column, digits: int) -> Column:
    """round() as DuckDB has it: the product with the power of ten is rounded, not the decimal digits of the double."""
    return F.round(value * 10.0**digits) / 10.0**digits


def collapse_questions(hits: DataFrame, query: str, k: int = 60) -> DataFrame:
    """(query, chunk_id, rrf_score, kinds, best_rank): hits of a chunk and of its questions as one.

    hits has query, chunk_id, kind and rank; rows without a chunk_id are dropped.
    """
    kept = hits.where(F.col("chunk_id").isNotNull() & (F.col("chunk_id") != ""))
    return kept.groupBy(query, "chunk_id").agg(F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), 6).alias("rrf_score"), F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"), F.min("rank").alias("best_rank"))


def multi_query(hits: DataFrame, group: str, query: str, k: int = 60) -> DataFrame:
    """(group, chunk_id, rrf_score, queries, kinds, shown): the hits of several queries of one search, fused by chunk.

    hits has the group, the query, chunk_id, id, kind and rank; a blank chunk_id falls back to the id.
    shown is the id to display: that of the first hit on the chunk itself, else of the first hit.
    """
    key = F.coalesce(F.nullif(F.col("chunk_id"), F.lit("")), F.col("id").cast("string"))
    first = F.struct(query, "rank")
    fused = hits.withColumn("chunk_id", key).groupBy(group, "chunk_id").agg(
        F.round(F.sum(F.lit(1.0) / (k + F.col("rank"))), 6).alias("rrf_score"),
        F.count_distinct(query).alias("queries"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("kind") != "", F.col("kind")))), ",").alias("kinds"),
        F.min_by("id", F.when(F.col("kind") == "chunk", first)).alias("own"),
        F.min_by("id", first).alias("any"),
    )
    return fused.withColumn("shown", F.coalesce("own", "any")).drop("own", "any")


def contains_all(text: Column, keywords: list[str]) -> Column:
    """Whether a text holds every keyword, in any case; no keywords match nothing."""
    words = [w.strip().lower() for w in keywords if w.strip()]
    if not words:
        return F.lit(False)
    return F.coalesce(reduce(lambda a, b: a & b, [F.contains(F.lower(text), F.lit(w)) for w in words]), F.lit(False))


def overlap_ratio(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text holds; -1 for a blank text, as a missing score sorts last."""
    q, t = F.array_distinct(tokens(query)), tokens(text)
    share = F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1))
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit(-1.0)).otherwise(F.round(share, 6))
