"""Queries on retrieval: dense, sparse, lexical and fused search, evidence pools."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakb.operators import evidence, retrieval
from stratakb.queries.documents import CHUNKS, chunks_once
from stratakb.session import table

USABLE = "len(dense_vector) = 64 and len(list_filter(dense_vector, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(dense_vector, lambda x: x <> 0)) > 0"
DENSE = f"""u as (select id, kind, chunk_id, source, dense_vector::double[] as v from vectors where {USABLE}),
  s as (select q.id as query_id, u.id, u.kind, u.chunk_id, list_inner_product(q.v, u.v) as score from u q join u on q.id % 100 = 0),
  dense as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from s)"""
WORDS = "regexp_extract_all(lower({}), '([a-z0-9]{{2,}}|[\\x{{4e00}}-\\x{{9fff}}])', 1)"
SPARSE = f"""q as (select doc_id as query_id, unnest(list_distinct({WORDS.format('title')})) as term from documents where doc_id % 100 = 0),
  p as (select doc_id, term, count(*) as tf from (select doc_id, unnest({WORDS.format('text')}) as term from documents) group by 1, 2),
  i as (select term, ln(1 + (select count(*) from documents)::double / count(*)) as idf from p group by 1),
  scored as (select query_id, doc_id, round(sum(tf * idf * idf), 6) as score from q join p using (term) join i using (term) group by 1, 2),
  sparse as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from scored)"""
OVERLAP = f"""o as (select query_id, doc_id, count(*) as score from q join (select distinct doc_id, term from p) using (term) group by 1, 2),
  overlap as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from o)"""


def dense_hits(spark: SparkSession, at: str, k: int = 20) -> DataFrame:
    """Top k of every vector whose id is divisible by 100, over all usable vectors."""
    usable = retrieval.usable_vectors(table(spark, at, "vectors")).select("id", "dense_vector")
    return retrieval.dense_topk(usable, usable.where("id % 100 = 0"), k)


def dense_topk(spark: SparkSession, at: str) -> DataFrame:
    return dense_hits(spark, at, 10).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


def dense_topk_filtered(spark: SparkSession, at: str) -> DataFrame:
    """As dense_topk among the chunks of hosts: the filter reaches the scan."""
    usable = retrieval.usable_vectors(table(spark, at, "vectors"))
    index = usable.where("kind = 'chunk' and source <> 'user-upload'").select("id", "dense_vector")
    hits = retrieval.dense_topk(index, usable.where("id % 100 = 0").select("id", "dense_vector"), 5)
    return hits.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


def dense_label_recall(spark: SparkSession, at: str) -> DataFrame:
    """Share of the five nearest embeddings that carry the label of the query, per label."""
    e = table(spark, at, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("dense_vector"), "label")
    hits = retrieval.dense_topk(e.select("id", "dense_vector"), e.where("id % 100 = 0").select("id", "dense_vector"), 6).where("id <> query_id")
    near = hits.join(e.select("id", F.col("label").alias("near")), "id").join(e.select(F.col("id").alias("query_id"), "label"), "query_id")
    return near.groupBy("label").agg(F.count_distinct("query_id").alias("queries"), F.round(F.avg((F.col("near") == F.col("label")).cast("int")), 6).alias("share"))


def lexical_hits(spark: SparkSession, at: str, k: int, *ways: str) -> DataFrame:
    """The k best documents by each of ways for the titles of documents whose doc_id is divisible by 100."""
    d = table(spark, at, "documents").select("doc_id", "title", "text")
    asked = d.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("title").alias("question"))
    return retrieval.lexical_topk(d.select("doc_id", "text"), asked, "doc_id", "text", "query_id", "question", k, ways)


def sparse_hits(spark: SparkSession, at: str, k: int = 20) -> DataFrame:
    """Top k documents by tf-idf."""
    return lexical_hits(spark, at, k, "sparse")


def sparse_topk(spark: SparkSession, at: str) -> DataFrame:
    return sparse_hits(spark, at, 10).select("query_id", "doc_id", F.round("score", 4).alias("score"))


def sparse_gate(spark: SparkSession, at: str) -> DataFrame:
    """Mean of the three best sparse scores of each query: low ones call for other sources."""
    return sparse_hits(spark, at, 3).groupBy("query_id").agg(F.round(F.avg("score"), 3).alias("mean"), F.count(F.lit(1)).alias("hits"))


def hybrid_rrf(spark: SparkSession, at: str) -> DataFrame:
    """Fusion of the two ranked lists of each query, the ten best."""
    fused = retrieval.fused(lexical_hits(spark, at, 20, "sparse", "overlap"), "query_id", "doc_id")
    best = retrieval.top_ranked(fused, 10, "query_id", "doc_id", "rrf_score")
    return best.select("query_id", "doc_id", retrieval.rounded(F.col("rrf_score"), 5).alias("rrf_score"), "lists", F.col("rank").cast("long").alias("rank"))


def question_collapse(spark: SparkSession, at: str) -> DataFrame:
    """Dense hits of chunks and of their questions, fused per chunk."""
    named = table(spark, at, "vectors").select("id", "kind", "chunk_id")
    fused = retrieval.collapse_questions(dense_hits(spark, at).join(named, "id"), "query_id")
    return fused.select("query_id", "chunk_id", F.round("rrf_score", 5).alias("rrf_score"), "kinds", F.col("best_rank").cast("long").alias("best_rank"))


def rerank_order(spark: SparkSession, at: str) -> DataFrame:
    """The ten sparse hits of each query in the order of an overlap reranker on the head of the text."""
    d = table(spark, at, "documents")
    asked = d.select(F.col("doc_id").alias("query_id"), F.col("title").alias("question"))
    both = sparse_hits(spark, at, 10).select("query_id", "doc_id").join(asked, "query_id").join(d.select("doc_id", "text"), "doc_id")
    scored = both.withColumn("rerank", retrieval.overlap_ratio(F.col("question"), F.col("text")))
    out = retrieval.top_ranked(scored, 10, "query_id", "doc_id", "rerank")
    return out.select("query_id", "doc_id", F.round("rerank", 5).alias("rerank"), F.col("rank").cast("long").alias("rank"))


def lexical_and_grep(spark: SparkSession, at: str) -> DataFrame:
    """Chunks per source that hold both of two keywords."""
    rows = chunks_once(spark, at, "source", "content").where(retrieval.contains_all(F.col("content"), ["cache", "index"]))
    return rows.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("chunks"))


def lexical_first_n(spark: SparkSession, at: str) -> DataFrame:
    """The first five chunks by id of each document that name a keyword."""
    rows = chunks_once(spark, at, "doc_id", "content").where(retrieval.contains_all(F.col("content"), ["pipeline"]))
    hit = rows.select("doc_id", "chunk_id", F.lit(1).alias("score"))
    return retrieval.top_ranked(hit, 5, "doc_id", "chunk_id").select("doc_id", "chunk_id", F.col("rank").cast("long").alias("rank"))


def evidence_dedup(spark: SparkSession, at: str) -> DataFrame:
    """The best dense hit of each query and chunk, questions and chunks together."""
    named = table(spark, at, "vectors").select("id", "kind", "chunk_id").where("chunk_id <> ''")
    pool = dense_hits(spark, at).join(named, "id")
    best = evidence.best_per_key(pool, ["query_id", "chunk_id"], "score", "rank")
    return best.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "kind")


def evidence_merge(spark: SparkSession, at: str) -> DataFrame:
    """Union of the sparse and the overlap list in which a document keeps its first row."""
    lists = lexical_hits(spark, at, 10, "sparse", "overlap").select("list", "query_id", "doc_id", "rank")
    return evidence.first_of(lists, ["query_id", "doc_id"], "rank").select("query_id", "doc_id", F.col("list").cast("long").alias("list"), F.col("rank").cast("long").alias("rank"))


def evidence_budget(spark: SparkSession, at: str) -> DataFrame:
    """Chunks of each document, in order, that fit 3,000 characters."""
    rows = chunks_once(spark, at, "doc_id", "content").where("doc_id is not null").select("doc_id", "chunk_id", F.length(F.coalesce("content", F.lit(""))).cast("long").alias("size"))
    return evidence.within_budget(rows, "doc_id", "chunk_id", "size", 3000)


def visited_anti(spark: SparkSession, at: str) -> DataFrame:
    """Chunks that no answer has returned yet."""
    seen = table(spark, at, "qa_answers").select(F.explode("returned_chunk_ids").alias("chunk_id")).distinct()
    return chunks_once(spark, at, "doc_id").join(seen, "chunk_id", "left_anti").select("chunk_id", "doc_id")


QUERIES = {f.__name__: f for f in (dense_topk, dense_topk_filtered, dense_label_recall, sparse_topk, sparse_gate, hybrid_rrf, question_collapse, rerank_order, lexical_and_grep, lexical_first_n, evidence_dedup, evidence_merge, evidence_budget, visited_anti)}

ORACLE = {
    "dense_topk": f"with {DENSE} select query_id, id, rank, round(score, 5) as score from dense where rank <= 10",
    "dense_topk_filtered": f"with {DENSE}".replace("from u q join u on q.id % 100 = 0", "from u q join u on q.id % 100 = 0 where u.kind = 'chunk' and u.source <> 'user-upload'") + " select query_id, id, rank, round(score, 5) as score from dense where rank <= 5",
    "dense_label_recall": """with s as (select q.vec_id as query_id, e.vec_id as id, q.label, e.label as near, list_inner_product(q.embedding::double[], e.embedding::double[]) as score from embeddings q join embeddings e on q.vec_id % 100 = 0),
      r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from s)
      select label, count(distinct query_id) as queries, round(avg((near = label)::int), 6) as share from r where rank <= 6 and id <> query_id group by 1""",
    "sparse_topk": f"with {SPARSE} select query_id, doc_id, round(score, 4) as score from sparse where rank <= 10",
    "sparse_gate": f"with {SPARSE} select query_id, round(avg(score), 3) as mean, count(*) as hits from sparse where rank <= 3 group by 1",
    "hybrid_rrf": f"""with {SPARSE}, {OVERLAP}, f as (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 6) as rrf_score, count(*) as lists from (select query_id, doc_id, rank from sparse where rank <= 20 union all select query_id, doc_id, rank from overlap where rank <= 20) group by 1, 2),
      r as (select *, row_number() over (partition by query_id order by rrf_score desc, doc_id) as rank from f) select query_id, doc_id, round(rrf_score, 5) as rrf_score, lists, rank from r where rank <= 10""",
    "question_collapse": f"""with {DENSE} select query_id, chunk_id, round(round(sum(1.0::double / (60 + rank)), 6), 5) as rrf_score, string_agg(distinct kind, ',' order by kind) as kinds, min(rank) as best_rank from dense where rank <= 20 and chunk_id <> '' group by 1, 2""",
    "rerank_order": f"""with {SPARSE}, b as (select s.query_id, s.doc_id, t.title, d.text from sparse s join documents t on t.doc_id = s.query_id join documents d on d.doc_id = s.doc_id where rank <= 10),
      w as (select query_id, doc_id, text, list_distinct({WORDS.format('title')}) as qt, list_distinct({WORDS.format('text')}) as tt from b),
      r as (select query_id, doc_id, case when coalesce(trim(text, ' '), '') = '' then -1.0 else round(len(list_intersect(qt, tt))::double / greatest(len(qt), 1), 6) end as rerank from w)
      select query_id, doc_id, round(rerank, 5) as rerank, row_number() over (partition by query_id order by rerank desc, doc_id) as rank from r""",
    "lexical_and_grep": f"with {CHUNKS} select coalesce(source, '') as source, count(*) as chunks from once where contains(lower(content), 'cache') and contains(lower(content), 'index') group by 1",
    "lexical_first_n": f"with {CHUNKS} select doc_id, chunk_id, rank from (select doc_id, chunk_id, row_number() over (partition by doc_id order by chunk_id) as rank from once where contains(lower(content), 'pipeline')) where rank <= 5",
    "evidence_dedup": f"with {DENSE}, b as (select *, row_number() over (partition by query_id, chunk_id order by score desc, rank) as best from dense where rank <= 20 and chunk_id <> '') select query_id, chunk_id, rank, kind from b where best = 1",
    "evidence_merge": f"""with {SPARSE}, {OVERLAP}, a as (select query_id, doc_id, 0 as list, rank from sparse where rank <= 10 union all select query_id, doc_id, 1, rank from overlap where rank <= 10)
      select query_id, doc_id, list::bigint as list, rank from (select *, row_number() over (partition by query_id, doc_id order by list, rank) as first from a) where first = 1""",
    "evidence_budget": f"with {CHUNKS}, s as (select doc_id, chunk_id, length(coalesce(content, '')) as size from once where doc_id is not null), r as (select *, sum(size) over (partition by doc_id order by chunk_id rows unbounded preceding)::bigint as used from s) select * from r where used <= 3000",
    "visited_anti": f"with {CHUNKS} select chunk_id, doc_id from once where chunk_id not in (select c from (select unnest(returned_chunk_ids) as c from qa_answers) where c is not null)",
}
