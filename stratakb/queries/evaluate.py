"""Queries on answers, feedback and questions: hit ranks, recall, coverage, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratakb.functions import dates
from stratakb.functions import text as T
from stratakb.operators import evaluation, evidence
from stratakb.queries.documents import CHUNKS, DOCS, KIND, chunks_once, docs
from stratakb.session import table

ANSWERS = "a as (select * from (select *, row_number() over (partition by answer_id order by logged_at desc) as rn from qa_answers where answer_id is not null) where rn = 1)"
RETURNED = "r as (select answer_id, c.doc_id, min(i) as rank from (select answer_id, unnest(range(1, len(returned_chunk_ids) + 1)) as i, unnest(returned_chunk_ids) as chunk_id from a) x join (select distinct chunk_id, doc_id from chunks) c using (chunk_id) where c.doc_id is not null group by 1, 2)"
EXPECTED = """j as (select answer_id, from_json(returned_doc_ids, '["VARCHAR"]') as ids from feedback where json_valid(returned_doc_ids)),
  e as (select distinct answer_id, doc_id from (select answer_id, trim(unnest(ids)) as doc_id from j) where doc_id <> '' and answer_id is not null)"""
RANKS = f"{ANSWERS}, {RETURNED}, {EXPECTED}, k as (select e.answer_id, min(r.rank) as rank from e left join r on e.answer_id = r.answer_id and e.doc_id = r.doc_id group by 1)"
SUMMARY = """count(*) as queries, round(avg(coalesce((rank <= 1)::int, 0)), 4) as recall_1, round(avg(coalesce((rank <= 3)::int, 0)), 4) as recall_3,
  round(avg(coalesce((rank <= 5)::int, 0)), 4) as recall_5, round(avg(coalesce((rank <= 10)::int, 0)), 4) as recall_10, round(avg(coalesce(1.0::double / rank, 0)), 4) as mrr"""


#: The scenario and the dimensions of a question, written down for the oracle on their own.
SCENARIO = """case when regexp_matches({q}, '报错|失败|错误|异常|为什么.*不|why.*fail|debug') then 'troubleshoot' when regexp_matches({q}, '最近|最新|更新|版本|changelog|latest update') then 'update'
  when regexp_matches({q}, ' vs |对比|区别|差异|谁更|哪个好|compare') then 'compare' when regexp_matches({q}, '怎么|如何|使用方法|部署|安装|how to|install|setup') then 'howto'
  when regexp_matches({q}, '配置|参数|选项|configure|setting') then 'config' when regexp_matches({q}, '是什么|做什么|用途|用来|简介|介绍|概念|特性|what is') then 'definition' else 'general' end"""
DIMENSION_LIST = """list_filter([case when regexp_matches({q}, '是什么|什么是|定义|概念|介绍|概述|摘要|内容|what is|definition') then 'direct' end,
  case when regexp_matches({q}, '如何|怎么|怎样|操作|配置|安装|使用|创建|部署|how to|how do|steps|guide') then 'action' end, case when regexp_matches({q}, '区别|对比|比较|差异|不同|vs|versus|difference|compare') then 'comparison' end,
  case when regexp_matches({q}, '风险|问题|错误|故障|异常|限制|不适合|注意|坑|risk|error|issue|limitation|caveat') then 'fault' end, case when regexp_matches({q}, '别名|又叫|又称|同义词|同一个|一样吗|是指|aka|alias|same as') then 'alias' end,
  case when regexp_matches({q}, '版|edition|最新|升级|v[0-9]|version|release|changelog') then 'version' end], lambda x: x is not null)"""
_DIM = "unnest(case when len({d}) = 0 then ['direct'] else {d} end)"


def answers_once(spark: SparkSession, at: str) -> DataFrame:
    """Answers by distinct answer_id: the row that was logged last."""
    rows = table(spark, at, "qa_answers").where("answer_id is not null")
    newest = Window.partitionBy("answer_id").orderBy(F.desc("logged_at"))
    return rows.withColumn("rn", F.row_number().over(newest)).where("rn = 1").drop("rn")


def feedback_expected(spark: SparkSession, at: str) -> DataFrame:
    """(answer_id, doc_id) that feedback names; broken lists name none."""
    named = table(spark, at, "feedback").where("answer_id is not null").select("answer_id", F.explode(T.json_list(F.col("returned_doc_ids"))).alias("doc_id"))
    return named.distinct()


def answer_ranks(spark: SparkSession, at: str) -> DataFrame:
    """(answer_id, rank): at which place an answer's chunks first come from a document its feedback names."""
    owner = table(spark, at, "chunks").where("doc_id is not null").select("chunk_id", "doc_id").distinct()
    placed = answers_once(spark, at).select("answer_id", F.posexplode("returned_chunk_ids").alias("pos", "chunk_id"))
    ranked = placed.join(owner, "chunk_id").groupBy("answer_id", "doc_id").agg((F.min("pos") + 1).alias("rank"))
    return evaluation.hit_ranks(feedback_expected(spark, at), ranked, "answer_id", "doc_id")


def recall_overall(spark: SparkSession, at: str) -> DataFrame:
    return answer_ranks(spark, at).agg(*evaluation.summary())


def recall_by_group(spark: SparkSession, at: str) -> DataFrame:
    """Recall overall, by type of source and by scenario of the question, in one pass."""
    asked = answers_once(spark, at).select("answer_id", dates.source_type(F.col("source_type")).alias("kind"), T.scenario(F.col("question")).alias("scenario"))
    return evaluation.grouped_summary(answer_ranks(spark, at).join(asked, "answer_id", "left"), "kind", "scenario")


def cache_contribution(spark: SparkSession, at: str) -> DataFrame:
    """How many hits each kind of cache outcome contributes, and its share of all hits."""
    asked = answers_once(spark, at).select("answer_id", F.coalesce("crystallized_status", F.lit("unknown")).alias("path"))
    hits = answer_ranks(spark, at).join(asked, "answer_id").groupBy("path").agg(F.count(F.lit(1)).alias("queries"), F.count("rank").alias("hits"))
    return hits.withColumn("share", F.round(F.col("hits") / F.greatest(F.sum("hits").over(Window.partitionBy()), F.lit(1)), 4))


def eval_diff(spark: SparkSession, at: str) -> DataFrame:
    """Metrics of answers with at least two pieces of evidence against those of the others."""
    ranks = answer_ranks(spark, at).join(answers_once(spark, at).select("answer_id", "evidence_count"), "answer_id")
    names = ("recall_1", "recall_3", "recall_5", "recall_10", "mrr")

    def report(rows: DataFrame) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])
        return rows.agg(*evaluation.summary()).select(F.explode(pairs).alias("m")).select("m.metric", "m.value")

    return evaluation.report_difference(report(ranks.where("evidence_count < 2")), report(ranks.where("evidence_count >= 2")))


def scenario_classify(spark: SparkSession, at: str) -> DataFrame:
    return answers_once(spark, at).groupBy(T.scenario(F.col("question")).alias("scenario")).agg(F.count(F.lit(1)).alias("questions"))


def question_dimensions(spark: SparkSession, at: str) -> DataFrame:
    rows = answers_once(spark, at).select("answer_id", F.explode(T.question_dimensions(F.col("question"))).alias("dimension"))
    return rows.groupBy("dimension").agg(F.count(F.lit(1)).alias("questions"))


def coverage_summary(spark: SparkSession, at: str) -> DataFrame:
    """Chunks per dimension that their questions cover, and the share of all chunks."""
    once = chunks_once(spark, at, "questions")
    asked = once.select("chunk_id", F.explode(T.clean_list(F.col("questions"))).alias("q"))
    covered = asked.select("chunk_id", F.explode(T.question_dimensions(F.col("q"))).alias("dimension")).distinct()
    total = once.count()
    return covered.groupBy("dimension").agg(F.count(F.lit(1)).alias("chunks")).select("dimension", "chunks", F.round(F.col("chunks") * 100.0 / F.lit(float(total)), 1).alias("percent"))


def missing_dimensions(spark: SparkSession, at: str) -> DataFrame:
    """Per chunk, the dimensions that none of its questions asks about, in their fixed order."""
    once = chunks_once(spark, at, "questions")
    missing = T.missing_dimensions(T.clean_list(F.col("questions")))
    return once.select("chunk_id", F.size(missing).cast("long").alias("count"), F.array_join(missing, ",").alias("missing"))


def feedback_to_queries(spark: SparkSession, at: str) -> DataFrame:
    """Evaluation queries from feedback of rating 4 or 5 and type positive or partial, once per feedback."""
    once = table(spark, at, "feedback").distinct()
    good = once.where((F.col("user_rating").between(4, 5)) & F.lower(F.trim("feedback_type")).isin("positive", "partial"))
    asked = answers_once(spark, at).where("length(trim(question)) > 0").select("answer_id", "question")
    rows = good.join(asked, "answer_id")
    return rows.select(F.concat(F.lit("real-"), F.lpad(F.col("feedback_id").cast("string"), 9, "0")).alias("id"), "question", F.size(T.json_list(F.col("returned_doc_ids"))).cast("long").alias("expected"))


def feedback_consistency(spark: SparkSession, at: str) -> DataFrame:
    """Feedback per unified type: rows, ratings out of range, ratings that contradict the type, broken lists."""
    once = table(spark, at, "feedback").distinct().withColumn("type", F.coalesce(F.lower(F.trim("feedback_type")), F.lit("none")))
    rating = F.col("user_rating")
    against = ((F.col("type") == "positive") & rating.between(1, 2)) | ((F.col("type") == "negative") & rating.between(4, 5))
    broken = F.col("returned_doc_ids").isNotNull() & F.from_json("returned_doc_ids", "array<string>").isNull()
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return once.groupBy("type").agg(F.count(F.lit(1)).alias("rows"), count(~rating.between(1, 5)).alias("out_of_range"), count(against).alias("against"), count(broken).alias("broken"))


def session_last12(spark: SparkSession, at: str) -> DataFrame:
    """The last twelve answers of each session, numbered from the oldest."""
    rows = answers_once(spark, at).where("session_id is not null").select("session_id", "answer_id", "asked_at")
    return evidence.last_rows(rows, "session_id", ["asked_at", "answer_id"], 12).select("session_id", "answer_id", F.col("position").cast("long").alias("position"))


def session_stats(spark: SparkSession, at: str) -> DataFrame:
    """Per session: answers, unanswered ones, seconds from first to last question."""
    rows = answers_once(spark, at).where("session_id is not null")
    empty = F.coalesce(F.length(F.trim("answer")) == 0, F.lit(True)).cast("long")
    span = F.timestamp_diff("SECOND", F.min("asked_at"), F.max("asked_at"))
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("answers"), F.sum(empty).alias("unanswered"), span.cast("long").alias("seconds"))


def answer_trust(spark: SparkSession, at: str) -> DataFrame:
    """Trust of each answer: the worst tier and the greatest age among the documents its chunks come from."""
    owner = table(spark, at, "chunks").where("doc_id is not null").select("chunk_id", "doc_id").distinct()
    used = answers_once(spark, at).select("answer_id", F.explode(F.array_distinct("returned_chunk_ids")).alias("chunk_id")).join(owner, "chunk_id")
    known = docs(spark, at).select("doc_id", "tier", "age")
    out = used.join(known, "doc_id").groupBy("answer_id").agg(F.max("tier").cast("long").alias("tier"), F.max("age").cast("long").alias("age"), F.count_distinct("doc_id").alias("documents"))
    return out.withColumn("notice", F.when(F.col("age") > 180, "refresh").when(F.col("age") > 90, "notice").otherwise("none"))


def answer_coverage(spark: SparkSession, at: str) -> DataFrame:
    """Per session, the share of distinct questions that got evidence and an answer."""
    rows = answers_once(spark, at).where("session_id is not null and length(trim(question)) > 0")
    asked = rows.groupBy("session_id", F.lower(F.trim("question")).alias("q")).agg(F.max(((F.col("evidence_count") > 0) & (F.length(F.trim("answer")) > 0)).cast("int")).alias("covered"))
    return asked.groupBy("session_id").agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg(F.coalesce("covered", F.lit(0))), 4).alias("coverage"))


def time_windows(spark: SparkSession, at: str) -> DataFrame:
    """Answers by the time words of questions, counted back from the last day of the log."""
    day = F.to_date("asked_at")
    rows = answers_once(spark, at).where("asked_at is not null").select(day.alias("day"))
    today = F.lit(rows.agg(F.max("day")).first()[0]).cast("date")
    windows = {
        "recent": F.col("day") > F.date_sub(today, 30),
        "this_week": F.col("day") >= F.date_trunc("week", today).cast("date"),
        "this_year": F.year("day") == F.year(today),
        "last_year": F.year("day") == F.year(today) - 1,
    }
    counted = rows.agg(*[F.sum(c.cast("long")).alias(n) for n, c in windows.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("span"), F.coalesce(F.col(n), F.lit(0)).alias("answers")) for n in windows])).alias("w")).select("w.span", "w.answers")


QUERIES = {f.__name__: f for f in (recall_overall, recall_by_group, cache_contribution, eval_diff, scenario_classify, question_dimensions, coverage_summary, missing_dimensions, feedback_to_queries, feedback_consistency, session_last12, session_stats, answer_trust, answer_coverage, time_windows)}

ORACLE = {
    "recall_overall": f"with {RANKS} select {SUMMARY} from k",
    "recall_by_group": f"""with {RANKS}, g as (select k.rank, case when k.answer_id is not null then coalesce(nullif(trim({KIND.replace('source_type', 'a.source_type')}), ''), 'unknown') end as kind, case when a.answer_id is null then 'unknown' else {SCENARIO.format(q='lower(a.question)')} end as scenario from k left join a using (answer_id))
      select kind, scenario, {SUMMARY} from g group by grouping sets ((), (kind), (scenario))""",
    "cache_contribution": f"""with {RANKS}, h as (select coalesce(crystallized_status, 'unknown') as path, count(*) as queries, count(rank) as hits from k join a using (answer_id) group by 1)
      select path, queries, hits, round(hits::double / greatest(sum(hits) over (), 1), 4) as share from h""",
    "eval_diff": f"""with {RANKS}, m as (select k.rank, evidence_count from k join a using (answer_id)), l as (select {SUMMARY} from m where evidence_count < 2), h as (select {SUMMARY} from m where evidence_count >= 2)
      """ + " union all ".join(f"select '{n}' as metric, l.{n} as \"left\", h.{n} as \"right\", round(h.{n} - l.{n}, 4) as delta from l, h" for n in ("recall_1", "recall_3", "recall_5", "recall_10", "mrr")),
    "scenario_classify": f"with {ANSWERS} select {SCENARIO.format(q='lower(question)')} as scenario, count(*) as questions from a group by 1",
    "question_dimensions": f"with {ANSWERS}, d as (select answer_id, {DIMENSION_LIST.format(q='lower(coalesce(question, ' + chr(39) * 2 + '))')} as dims from a), u as (select {_DIM.format(d='dims')} as dimension from d) select dimension, count(*) as questions from u group by 1",
    "coverage_summary": f"""with {CHUNKS}, q as (select chunk_id, trim(unnest(questions)) as q from once), d as (select chunk_id, {DIMENSION_LIST.format(q='lower(q)')} as dims from q where q <> ''), u as (select distinct chunk_id, {_DIM.format(d='dims')} as dimension from d)
      select dimension, count(*) as chunks, round(100.0::double * count(*) / (select count(*) from once), 1) as percent from u group by 1""",
    "missing_dimensions": f"""with {CHUNKS}, q as (select chunk_id, trim(unnest(questions)) as q from once), d as (select chunk_id, {DIMENSION_LIST.format(q='lower(q)')} as dims from q where q <> ''), u as (select distinct chunk_id, {_DIM.format(d='dims')} as dimension from d),
      x as (select chunk_id, dim, i from once, (select unnest(['direct', 'action', 'comparison', 'fault', 'alias', 'version']) as dim, unnest([1, 2, 3, 4, 5, 6]) as i)), m as (select x.chunk_id, dim, i from x left join u on x.chunk_id = u.chunk_id and dim = dimension where dimension is null)
      select o.chunk_id, count(dim) as count, coalesce(string_agg(dim, ',' order by i), '') as missing from once o left join m using (chunk_id) group by 1""",
    "feedback_to_queries": f"""with {ANSWERS}, f as (select distinct * from feedback) select 'real-' || lpad(feedback_id::varchar, 9, '0') as id, question,
      coalesce(len(list_filter(from_json(case when json_valid(returned_doc_ids) then returned_doc_ids end, '["VARCHAR"]'), lambda x: trim(x) <> '')), 0) as expected
      from f join a using (answer_id) where user_rating between 4 and 5 and lower(trim(feedback_type)) in ('positive', 'partial') and length(trim(question)) > 0""",
    "feedback_consistency": """with f as (select distinct * from feedback), t as (select *, coalesce(lower(trim(feedback_type)), 'none') as type from f)
      select type, count(*) as rows, sum(coalesce((user_rating not between 1 and 5)::int, 0))::bigint as out_of_range,
        sum(coalesce(((type = 'positive' and user_rating between 1 and 2) or (type = 'negative' and user_rating between 4 and 5))::int, 0))::bigint as against, sum(case when returned_doc_ids is null or (json_valid(returned_doc_ids) and json_type(case when json_valid(returned_doc_ids) then returned_doc_ids end) = 'ARRAY') then 0 else 1 end)::bigint as broken from t group by 1""",
    "session_last12": f"""with {ANSWERS}, b as (select session_id, answer_id, row_number() over (partition by session_id order by asked_at desc, answer_id desc) as back from a where session_id is not null)
      select session_id, answer_id, row_number() over (partition by session_id order by back desc) as position from b where back <= 12""",
    "session_stats": f"with {ANSWERS} select session_id, count(*) as answers, sum((coalesce(length(trim(answer)), 0) = 0)::int)::bigint as unanswered, date_diff('second', min(asked_at), max(asked_at)) as seconds from a where session_id is not null group by 1",
    "answer_trust": f"""with {ANSWERS}, {DOCS}, u as (select distinct answer_id, unnest(returned_chunk_ids) as chunk_id from a), o as (select distinct chunk_id, doc_id from chunks where doc_id is not null)
      select answer_id, max(tier)::bigint as tier, max(age)::bigint as age, count(distinct d.doc_id) as documents, case when max(age) > 180 then 'refresh' when max(age) > 90 then 'notice' else 'none' end as notice
      from u join o using (chunk_id) join docs d on d.doc_id = o.doc_id group by 1""",
    "answer_coverage": f"""with {ANSWERS}, q as (select session_id, lower(trim(question)) as q, max((evidence_count > 0 and length(trim(answer)) > 0)::int) as covered from a where session_id is not null and length(trim(question)) > 0 group by 1, 2)
      select session_id, count(*) as questions, round(avg(coalesce(covered, 0)), 4) as coverage from q group by 1""",
    "time_windows": f"""with {ANSWERS}, r as (select asked_at::date as day, max(asked_at::date) over () as today from a where asked_at is not null)
      select 'recent' as span, count(*) filter (day > today - 30) as answers from r union all select 'this_week', count(*) filter (day >= date_trunc('week', today)::date) from r
      union all select 'this_year', count(*) filter (year(day) = year(today)) from r union all select 'last_year', count(*) filter (year(day) = year(today) - 1) from r""",
}
