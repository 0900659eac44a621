"""Queries that fuse vector and lexical lists: hybrid search, several queries at once, contribution of each path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratakb.functions import text as T
from stratakb.operators import evaluation, retrieval
from stratakb.queries.documents import CHUNKS, chunks_once
from stratakb.queries.search import USABLE, WORDS
from stratakb.session import cut, table


def asked_questions(spark: SparkSession, at: str) -> DataFrame:
    """(query_id, chunk_id, doc_id, source, question, dense_vector) of the question vectors whose id is divisible by 100."""
    once = chunks_once(spark, at, "questions").select("chunk_id", F.posexplode(T.clean_list(F.col("questions"))).alias("pos", "question"))
    text = once.select(F.concat("chunk_id", F.lit("-q"), F.lpad((F.col("pos") + 1).cast("string"), 2, "0")).alias("question_id"), "question")
    rows = retrieval.usable_vectors(table(spark, at, "vectors")).where("kind = 'question' and id % 100 = 0")
    return rows.select(F.col("id").alias("query_id"), "chunk_id", "doc_id", F.coalesce("source", F.lit("")).alias("source"), "question_id", "dense_vector").join(text, "question_id", "left").drop("question_id")


def vector_list(spark: SparkSession, at: str, asked: DataFrame, k: int, only: str | None = None) -> DataFrame:
    """(query_id, id, rank, kind, chunk_id): the k nearest usable vectors of each question, its own row left out."""
    rows = retrieval.usable_vectors(table(spark, at, "vectors"))
    rows = rows.where(F.col("kind") == only) if only else rows
    queries = asked.select(F.col("query_id").alias("id"), "dense_vector")
    hits = retrieval.dense_topk(rows.select("id", "dense_vector"), queries, k + 1).where("id <> query_id")
    again = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    hits = hits.select("query_id", "id", again.alias("rank")).where(F.col("rank") <= k)
    return hits.join(rows.select("id", "kind", "chunk_id"), "id")


def chunk_list(hits: DataFrame) -> DataFrame:
    """(query_id, chunk_id, rank): each chunk once, at the place of its first row."""
    first = hits.where("chunk_id is not null").groupBy("query_id", "chunk_id").agg(F.min("rank").alias("at"))
    return first.select("query_id", "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at")).alias("rank"))


def sparse_list(spark: SparkSession, at: str, asked: DataFrame, k: int) -> DataFrame:
    best = retrieval.lexical_topk(chunks_once(spark, at, "content"), asked.select("query_id", "question"), "chunk_id", "content", "query_id", "question", k)
    return best.select("query_id", "chunk_id", "rank")


def grep_list(spark: SparkSession, at: str, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, rank): chunks that hold all words of a question of four letters or more, by id; a question without any has none."""
    words = F.filter(F.array_distinct(T.tokens(F.col("question"))), lambda w: F.length(w) >= 4)
    wanted = asked.select("query_id", words.alias("words")).where(F.size("words") > 0)
    terms = wanted.select("query_id", F.size("words").alias("n"), F.explode("words").alias("term"))
    held = chunks_once(spark, at, "content").select("chunk_id", F.explode(F.array_distinct(T.tokens(F.col("content")))).alias("term"))
    held = held.join(terms.select("term").distinct(), "term", "left_semi")
    whole = terms.join(held, "term").groupBy("query_id", "n", "chunk_id").agg(F.count(F.lit(1)).alias("hits")).where("hits = n")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id"))
    return whole.select("query_id", "chunk_id", rank.alias("rank")).where(F.col("rank") <= k)


def hybrid_dense_sparse(spark: SparkSession, at: str) -> DataFrame:
    """Fusion of the nearest chunk vectors and the best tf-idf chunks of each question, the ten best."""
    asked = cut(asked_questions(spark, at), "asked")
    lists = [chunk_list(vector_list(spark, at, asked, 20, "chunk")), sparse_list(spark, at, asked, 20)]
    best = retrieval.top_ranked(retrieval.reciprocal_rank_fusion(lists, "query_id", "chunk_id"), 10, "query_id", "chunk_id", "rrf_score")
    return best.select("query_id", "chunk_id", retrieval.rounded(F.col("rrf_score"), 5).alias("rrf_score"), "lists", F.col("rank").cast("long").alias("rank"))


def multi_query_search(spark: SparkSession, at: str) -> DataFrame:
    """The questions of one source as one search: the lists of all of them over chunks and questions, fused by chunk, the ten best."""
    asked = asked_questions(spark, at)
    hits = vector_list(spark, at, asked, 20).join(asked.select("query_id", "source"), "query_id")
    best = retrieval.top_ranked(retrieval.multi_query(hits, "source", "query_id"), 10, "source", "chunk_id", "rrf_score")
    return best.select("source", "chunk_id", F.round("rrf_score", 5).alias("rrf_score"), "queries", "kinds", F.col("shown").alias("id"), F.col("rank").cast("long").alias("rank"))


def retrieval_ranks(spark: SparkSession, at: str) -> DataFrame:
    """Per question, the ranks of its own chunk in the vector list, in the lexical list and in both as one (lexical first), and of its document in the vector list."""
    asked = asked_questions(spark, at)
    vector, grep = chunk_list(vector_list(spark, at, asked, 10, "chunk")), grep_list(spark, at, asked, 10)
    own = asked.select("query_id", "chunk_id", "doc_id")
    owner = chunks_once(spark, at, "doc_id")
    by_doc = vector.join(owner, "chunk_id").groupBy("query_id", "doc_id").agg(F.min("rank").alias("doc_rank"))
    held = grep.groupBy("query_id").agg(F.count(F.lit(1)).alias("held"))
    placed = own.join(vector.withColumnRenamed("rank", "embedding_rank"), ["query_id", "chunk_id"], "left").join(grep.withColumnRenamed("rank", "grep_rank"), ["query_id", "chunk_id"], "left")
    both = vector.join(grep.select("query_id", "chunk_id"), ["query_id", "chunk_id"]).select("query_id", F.col("rank").alias("shared"))
    before = placed.select("query_id", "embedding_rank").join(both, "query_id").where("shared < embedding_rank").groupBy("query_id").agg(F.count(F.lit(1)).alias("before"))
    full = evaluation.merged_rank(F.col("grep_rank"), F.coalesce("held", F.lit(0)), F.col("embedding_rank"), F.coalesce("before", F.lit(0)))
    return placed.join(held, "query_id", "left").join(before, "query_id", "left").join(by_doc, ["query_id", "doc_id"], "left").select("query_id", "embedding_rank", "grep_rank", full.alias("full_rank"), "doc_rank")


def path_contribution(spark: SparkSession, at: str) -> DataFrame:
    """Recall at 5 of vectors alone, of the lexical list alone and of both, and what the lexical list rescues."""
    return evaluation.path_contribution(retrieval_ranks(spark, at))


def retrieval_recall(spark: SparkSession, at: str) -> DataFrame:
    """Recall of the vector list at 1, 3, 5 and 10, at 5 by document, and the mean reciprocal rank."""
    ranks = retrieval_ranks(spark, at).withColumnRenamed("embedding_rank", "rank")
    return ranks.agg(*evaluation.summary(), evaluation.recall_at(5, "doc_rank").alias("doc_recall_5"))


QUERIES = {f.__name__: f for f in (hybrid_dense_sparse, multi_query_search, path_contribution, retrieval_recall)}

ASKED = f"""{CHUNKS}, qt as (select chunk_id || '-q' || lpad(i::varchar, 2, '0') as question_id, q as question from (select chunk_id, unnest(qs) as q, unnest(range(1, len(qs) + 1)) as i from (select chunk_id, list_filter(list_transform(questions, lambda x: trim(x)), lambda x: x <> '') as qs from once) where qs is not null)),
  u as (select id, kind, chunk_id, doc_id, source, question_id, dense_vector::double[] as v from vectors where {USABLE}),
  asked as (select u.id as query_id, chunk_id, doc_id, coalesce(source, '') as source, question, v from u left join qt using (question_id) where kind = 'question' and u.id % 100 = 0)"""
NEAR = """{name} as (select query_id, id, kind, chunk_id, source, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank
    from (select a.query_id, u.id, u.kind, u.chunk_id, a.source, list_inner_product(a.v, u.v) as score from asked a join u on u.id <> a.query_id where {only}) qualify rank <= {k})"""
LIST = "{name}_c as (select query_id, chunk_id, row_number() over (partition by query_id order by min(rank)) as rank from {name} where chunk_id is not null group by 1, 2)"
SPARSE = f"""t as (select query_id, unnest(list_distinct({WORDS.format('question')})) as term from asked), p as (select chunk_id, term, count(*) as tf from (select chunk_id, unnest({WORDS.format('content')}) as term from once) group by 1, 2),
  i as (select term, ln(1 + (select count(*) from once)::double / count(*)) as idf from p group by 1), sc as (select query_id, chunk_id, round(sum(tf * idf * idf), 6) as score from t join p using (term) join i using (term) group by 1, 2),
  s as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from sc)"""
FOUND = f"""{ASKED}, {NEAR.format(name='d', only="u.kind = 'chunk'", k=10)}, {LIST.format(name='d')}, {SPARSE},
  n as (select query_id, count(*) as n from t where length(term) >= 4 group by 1), gm as (select query_id, chunk_id from t join p using (term) join n using (query_id) where length(term) >= 4 group by query_id, chunk_id, n having count(*) = n),
  g as (select *, row_number() over (partition by query_id order by chunk_id) as rank from gm qualify rank <= 10),
  f as (select query_id, chunk_id, row_number() over (partition by query_id order by side, rank) as rank from (select query_id, chunk_id, 0 as side, rank from g union all select d_c.query_id, d_c.chunk_id, 1, d_c.rank from d_c anti join g on d_c.query_id = g.query_id and d_c.chunk_id = g.chunk_id)),
  w as (select a.query_id, d_c.rank as e, g.rank as g, f.rank as f, (select min(x.rank) from d_c x join once o using (chunk_id) where x.query_id = a.query_id and o.doc_id = a.doc_id) as doc from asked a
    left join d_c on d_c.query_id = a.query_id and d_c.chunk_id = a.chunk_id left join g on g.query_id = a.query_id and g.chunk_id = a.chunk_id left join f on f.query_id = a.query_id and f.chunk_id = a.chunk_id)"""
ORACLE = {
    "hybrid_dense_sparse": f"""with {ASKED}, {NEAR.format(name='d', only="u.kind = 'chunk'", k=20)}, {LIST.format(name='d')}, {SPARSE},
      b as (select query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 6) as rrf_score, count(*) as lists from (select * from d_c union all select query_id, chunk_id, rank from s where rank <= 20) group by 1, 2),
      r as (select *, row_number() over (partition by query_id order by rrf_score desc, chunk_id) as rank from b) select query_id, chunk_id, round(rrf_score, 5) as rrf_score, lists, rank from r where rank <= 10""",
    "multi_query_search": f"""with {ASKED}, {NEAR.format(name='d', only='true', k=20)},
      b as (select source, coalesce(nullif(chunk_id, ''), id::varchar) as chunk_id, round(sum(1.0::double / (60 + rank)), 6) as rrf_score, count(distinct query_id) as queries, string_agg(distinct kind, ',' order by kind) as kinds,
        coalesce(arg_min(id, query_id * 1000 + rank) filter (kind = 'chunk'), arg_min(id, query_id * 1000 + rank)) as id from d group by 1, 2),
      r as (select *, row_number() over (partition by source order by rrf_score desc, chunk_id) as rank from b) select source, chunk_id, round(rrf_score, 5) as rrf_score, queries, kinds, id, rank from r where rank <= 10""",
    "path_contribution": f"""with {FOUND} select round(avg(coalesce((e <= 5)::int, 0)), 4) as embedding_only_recall_5, round(avg(coalesce((g <= 5)::int, 0)), 4) as grep_only_recall_5, round(avg(coalesce((f <= 5)::int, 0)), 4) as full_recall_5,
      sum((f <= 5 and coalesce(e > 5, true))::int)::bigint as grep_rescue_count, round(avg(coalesce((f <= 5 and coalesce(e > 5, true))::int, 0)), 4) as grep_rescue_pct from w""",
    "retrieval_recall": f"""with {FOUND} select count(*) as queries, round(avg(coalesce((e <= 1)::int, 0)), 4) as recall_1, round(avg(coalesce((e <= 3)::int, 0)), 4) as recall_3, round(avg(coalesce((e <= 5)::int, 0)), 4) as recall_5,
      round(avg(coalesce((e <= 10)::int, 0)), 4) as recall_10, round(avg(coalesce(1.0::double / e, 0)), 4) as mrr, round(avg(coalesce((doc <= 5)::int, 0)), 4) as doc_recall_5 from w""",
}
