"""Queries on documents and chunks: catalogue, hashes, dates, URLs, removal, chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakb.functions import dates as D
from stratakb.functions import text as T
from stratakb.operators import chunking, governance
from stratakb.session import table

AS_OF = "2026-01-01"

# --- SQL shared by several oracles -------------------------------------------------------------------

DATE = """coalesce(
  case when regexp_matches(trim(fetched_at), '^\\d{4}-\\d{2}-\\d{2}') then try_strptime(regexp_extract(trim(fetched_at), '^(\\d{4}-\\d{2}-\\d{2})', 1), '%Y-%m-%d') end,
  case when regexp_matches(trim(fetched_at), '^\\d{4}/\\d{2}/\\d{2}') then try_strptime(regexp_extract(trim(fetched_at), '^(\\d{4}/\\d{2}/\\d{2})', 1), '%Y/%m/%d') end,
  case when regexp_matches(trim(fetched_at), '^\\d{8}$') then try_strptime(trim(fetched_at), '%Y%m%d') end,
  case when regexp_matches(trim(fetched_at), '^\\d{2}\\.\\d{2}\\.\\d{4}') then try_strptime(regexp_extract(trim(fetched_at), '^(\\d{2}\\.\\d{2}\\.\\d{4})', 1), '%d.%m.%Y') end)::date"""
ID_DATE = "try_strptime(nullif(regexp_extract(doc_id, '-(\\d{4}-\\d{2}-\\d{2})(?:-[0-9a-f]{8})?$', 1), ''), '%Y-%m-%d')::date"
KIND = """case when regexp_replace(lower(trim(source_type)), '[\\s_]+', '-', 'g') not in ('', '-', 'n/a', 'na', 'none', 'null', 'unknown', '?', 'nan')
  then regexp_replace(lower(trim(source_type)), '[\\s_]+', '-', 'g') end"""
DOCS = f"""docs as (
  select *, case when age is not null and kind = 'official-doc' and age <= 90 then 1 when age is not null and kind in ('official-doc', 'extracted') and age <= 180 then 2 else 3 end as tier,
    case when kind = 'official-doc' and coalesce(age, 999) <= 90 then 'P0' when kind in ('official-doc', 'user-upload') then 'P1'
         when kind = 'community' and coalesce(age, 999) <= 90 then 'P2' else 'P3' end as priority
  from (select *, case when fetched is not null then greatest(date_diff('day', fetched, date '{AS_OF}'), 0) end as age
        from (select doc_id, title, source, url, {KIND} as kind, coalesce({DATE}, {ID_DATE}) as fetched
              from (select *, row_number() over (partition by doc_id order by stored_at desc) as rn from raw_docs where doc_id is not null) where rn = 1)))"""
BODY = "regexp_replace(replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^\\n+|\\n+$', '', 'g')"
HASHES = f"""hashes as (
  select doc_id, has_frontmatter, case when body is not null then sha256({BODY}) end as actual, lower(trim(declared_sha256)) as declared,
    coalesce(regexp_matches(lower(trim(declared_sha256)), '^[0-9a-f]{{64}}$'), false) as valid
  from (select *, row_number() over (partition by doc_id order by stored_at desc) as rn from raw_docs where doc_id is not null) where rn = 1)"""
CHUNKS = "once as (select * from (select *, row_number() over (partition by chunk_id order by ingested_at desc) as rn from chunks where chunk_id is not null) where rn = 1)"
URL_KEY = "nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(www\\.)?', ''), '[?#].*$', ''), '(/index\\.html?)?/*$', ''), '')"
HOST = "nullif(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\\.)?([^/?#:]+)', 1), '')"


def docs(spark: SparkSession, at: str) -> DataFrame:
    return governance.documents(table(spark, at, "raw_docs"), AS_OF)


def chunks_once(spark: SparkSession, at: str, *columns: str) -> DataFrame:
    """Chunks by distinct chunk_id with the given columns; their copies differ in ingested_at alone."""
    return governance.latest(table(spark, at, "chunks").select("chunk_id", "ingested_at", *columns), "chunk_id", "ingested_at")


# --- queries -----------------------------------------------------------------------------------------


def doc_catalogue(spark: SparkSession, at: str) -> DataFrame:
    return governance.catalogue(table(spark, at, "raw_docs"), table(spark, at, "chunks"))


def kb_stats(spark: SparkSession, at: str) -> DataFrame:
    """Documents per unified type: counts, date range and documents without a date."""
    kinds = docs(spark, at).groupBy(F.coalesce("kind", F.lit("unknown")).alias("kind"))
    return kinds.agg(F.count(F.lit(1)).alias("documents"), F.min("fetched").alias("first_date"), F.max("fetched").alias("last_date"), F.sum(F.col("fetched").isNull().cast("long")).alias("undated"))


def trust_tier_dist(spark: SparkSession, at: str) -> DataFrame:
    return docs(spark, at).groupBy(F.col("tier").cast("long").alias("tier"), "priority").agg(F.count(F.lit(1)).alias("documents"))


def stale_buckets(spark: SparkSession, at: str) -> DataFrame:
    """Documents per source that are stale (over 90 days), fresh or of unknown age, and the oldest age."""
    bucket = F.when(F.col("age").isNull(), "unknown").when(F.col("age") > 90, "stale").otherwise("fresh")
    return docs(spark, at).groupBy(F.coalesce("source", F.lit("")).alias("source"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("documents"), F.max("age").cast("long").alias("oldest"))


def chunk_priorities(spark: SparkSession, at: str) -> DataFrame:
    """(doc_id, chunk_id, kind, priority) of every chunk, by its own type and date."""
    once = chunks_once(spark, at, "doc_id", "source_type", "fetched_at").where("doc_id is not null")
    fetched = F.coalesce(D.lenient_date(F.col("fetched_at")), D.date_in_id(F.col("doc_id")))
    kind = F.coalesce(D.source_type(F.col("source_type")), F.lit("unknown"))
    return once.select("doc_id", "chunk_id", kind.alias("kind"), D.source_priority(kind, D.age_days(fetched, AS_OF)).alias("priority"))


def priority_conflicts(spark: SparkSession, at: str) -> DataFrame:
    """Documents whose chunks disagree in type or priority, with the chunks below the best priority."""
    return governance.conflicts(chunk_priorities(spark, at), "doc_id").withColumnRenamed("documents", "chunks")


def page_conflicts(spark: SparkSession, at: str) -> DataFrame:
    """Pages whose documents disagree in type or priority."""
    pages = docs(spark, at).withColumn("page", T.url_key(F.col("url"))).where("page is not null")
    return governance.conflicts(pages, "page")


def priority_backfill(spark: SparkSession, at: str) -> DataFrame:
    """What a backfill of the documents' priorities would do: kept where the stored one is right, else updated or added."""
    stored = governance.latest(table(spark, at, "raw_docs").select("doc_id", "source_priority", "stored_at"), "doc_id", "stored_at").select("doc_id", F.nullif(F.trim("source_priority"), F.lit("")).alias("stored"))
    both = docs(spark, at).select("doc_id", "priority").join(stored, "doc_id")
    return both.groupBy(F.when(F.col("stored").isNull(), "added").when(F.col("stored") == F.col("priority"), "skipped").otherwise("updated").alias("action"), "priority").agg(F.count(F.lit(1)).alias("documents"))


def conflict_arbitration(spark: SparkSession, at: str) -> DataFrame:
    """Which document of a page counts: best priority, then newest."""
    pages = docs(spark, at).withColumn("page", T.url_key(F.col("url"))).where("page is not null")
    return governance.arbitrate(pages, "page").select("page", "doc_id", "priority", "fetched", "tied")


def frontmatter_text(spark: SparkSession, at: str) -> DataFrame:
    """The frontmatter that each document would be written with."""
    d = docs(spark, at)
    block = T.frontmatter_of({"doc_id": F.col("doc_id"), "title": F.col("title"), "source_type": F.col("kind"), "fetched_at": F.col("fetched").cast("string"), "source_priority": F.col("priority")})
    return d.select("doc_id", F.sha2(block, 256).alias("digest"), F.length(block).cast("long").alias("chars"))


def hash_groups(spark: SparkSession, at: str) -> DataFrame:
    return governance.duplicate_groups(governance.hash_index(table(spark, at, "raw_docs")))


def hash_backfill_class(spark: SparkSession, at: str) -> DataFrame:
    classed = governance.backfill_class(governance.hash_index(table(spark, at, "raw_docs")))
    return classed.groupBy("class").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("valid").cast("long")).alias("valid"))


def hash_mismatches(spark: SparkSession, at: str) -> DataFrame:
    """Documents whose valid declared digest isn't that of their body."""
    index = governance.hash_index(table(spark, at, "raw_docs"))
    return index.where("valid and declared <> actual").select("doc_id", "declared", "actual")


def hash_lookup_semi(spark: SparkSession, at: str) -> DataFrame:
    """Documents whose declared digest is the content hash of some document, their own or another."""
    index = governance.hash_index(table(spark, at, "raw_docs"))
    known = index.where("actual is not null").select(F.col("actual").alias("declared")).distinct()
    return index.join(known, "declared", "left_semi").select("doc_id", "declared")


def hash_new_anti(spark: SparkSession, at: str) -> DataFrame:
    """Chunk contents that no answer repeats word for word: what an ingest would still have to store."""
    chunks = chunks_once(spark, at, "content").where("content is not null").select("chunk_id", T.body_sha256(F.col("content")).alias("digest"))
    answers = table(spark, at, "qa_answers").where("answer is not null").select(T.body_sha256(F.col("answer")).alias("digest")).distinct()
    return chunks.join(answers, "digest", "left_anti").select("chunk_id", "digest")


def url_variants(spark: SparkSession, at: str) -> DataFrame:
    """Pages that chunks name under more than one spelling of the URL."""
    rows = table(spark, at, "chunks").where("length(trim(url)) > 0").select("url", T.url_key(F.col("url")).alias("page"))
    return rows.groupBy("page").agg(F.count_distinct("url").alias("spellings"), F.count(F.lit(1)).alias("rows")).where("spellings > 1")


def url_host_stats(spark: SparkSession, at: str) -> DataFrame:
    rows = table(spark, at, "raw_docs").select(F.coalesce(T.url_host(F.col("url")), F.lit("")).alias("host"), "doc_id", "source")
    return rows.groupBy("host").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("documents"), F.count_distinct("source").alias("sources"))


def url_slug_docs(spark: SparkSession, at: str) -> DataFrame:
    return table(spark, at, "raw_docs").where("url is not null").select("url", T.url_slug(F.col("url")).alias("slug"), T.short_hash(F.col("url")).alias("short")).distinct()


def url_extract(spark: SparkSession, at: str) -> DataFrame:
    """URLs named in texts, with their route and how many documents name them."""
    found = table(spark, at, "documents").select("doc_id", F.explode(T.urls_in(F.col("text"))).alias("named"))
    return found.groupBy("named").agg(F.count_distinct("doc_id").alias("documents"), F.max(T.url_kind(F.col("named"))).alias("kind"))


def headings(spark: SparkSession, at: str) -> DataFrame:
    """First heading, topic and size of every chunk."""
    rows = chunks_once(spark, at, "doc_id", "content")
    return rows.select("chunk_id", T.first_heading(F.col("content")).alias("heading"), T.topic_of(F.col("doc_id")).alias("topic"), F.length("content").cast("long").alias("chars"), F.octet_length("content").cast("long").alias("bytes"))


def vector_ingest_rows(spark: SparkSession, at: str) -> DataFrame:
    """Rows that a vector ingest writes: one per chunk and one per question, with their ids."""
    once = chunks_once(spark, at, "doc_id", "questions")
    chunk = once.select("doc_id", "chunk_id", F.lit("chunk").alias("kind"), F.lit("").alias("question_id"))
    asked = once.select("doc_id", "chunk_id", F.posexplode(T.clean_list(F.col("questions"))).alias("pos", "q"))
    question = asked.select("doc_id", "chunk_id", F.lit("question").alias("kind"), F.concat("chunk_id", F.lit("-q"), F.lpad((F.col("pos") + 1).cast("string"), 2, "0")).alias("question_id"))
    return chunk.unionByName(question)


def delete_by_doc(spark: SparkSession, at: str) -> DataFrame:
    """Vectors left per kind once documents of unknown type are removed."""
    gone = docs(spark, at).where("kind is null").select("doc_id")
    return governance.remove_documents(table(spark, at, "vectors"), gone).groupBy("kind").agg(F.count(F.lit(1)).alias("left"), F.count_distinct("doc_id").alias("documents"))


def replace_docs(spark: SparkSession, at: str) -> DataFrame:
    """Chunk rows per document after the chunks of uploads were replaced by their last version."""
    chunks = table(spark, at, "chunks").where("doc_id is not null").select("doc_id", "chunk_id", "source", "ingested_at")
    new = governance.latest(chunks.where("source = 'user-upload'"), "chunk_id", "ingested_at")
    return governance.replace_documents(chunks, new).groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("chunk_id").alias("chunks"))


def removal_impact(spark: SparkSession, at: str) -> DataFrame:
    """What a removal of each document would take with it in every derived table."""
    d = table(spark, at, "raw_docs").where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("stored"))
    c = table(spark, at, "chunks").groupBy("doc_id").agg(F.count_distinct("chunk_id").alias("chunks"))
    v = table(spark, at, "vectors").groupBy("doc_id").agg(F.count(F.lit(1)).alias("vectors"))
    named = table(spark, at, "feedback").select("feedback_id", F.explode(T.json_list(F.col("returned_doc_ids"))).alias("doc_id"))
    f = named.groupBy("doc_id").agg(F.count_distinct("feedback_id").alias("feedback"))
    out = d.join(c, "doc_id", "left").join(v, "doc_id", "left").join(f, "doc_id", "left")
    return out.select("doc_id", "stored", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("chunks", "vectors", "feedback")])


def keyword_counts(spark: SparkSession, at: str) -> DataFrame:
    """Keyword counters of documents, raised by those of their chunks."""
    raw = governance.latest(table(spark, at, "raw_docs").select("doc_id", "keywords", "stored_at"), "doc_id", "stored_at")
    state = raw.select(F.explode(T.clean_list(F.col("keywords"))).alias("keyword")).groupBy("keyword").agg(F.count(F.lit(1)).alias("count"))
    new = chunks_once(spark, at, "keywords").select(F.explode(T.clean_list(F.col("keywords"))).alias("keyword"))
    return governance.upsert_counts(state, new, "keyword")


def site_freshness(spark: SparkSession, at: str) -> DataFrame:
    """Sites with their documents; sites without any and sources without a site stay."""
    held = docs(spark, at).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.max("fetched").alias("newest"))
    sites = table(spark, at, "sites").select("source", "site_kind", "priority")
    out = sites.join(held, "source", "full")
    return out.select(F.coalesce("source", F.lit("")).alias("source"), "site_kind", F.coalesce("documents", F.lit(0)).alias("documents"), "newest", F.round(F.coalesce("priority", F.lit(0.5)), 3).alias("priority"))


def chunk_documents(spark: SparkSession, at: str) -> DataFrame:
    """Chunks of every text of documents."""
    return chunking.chunk_documents(table(spark, at, "documents"), "doc_id", "text", 800, 1200, 80)


def chunk_stats(spark: SparkSession, at: str) -> DataFrame:
    """Chunks and their sizes per document, at the default bounds over the stored bodies."""
    raw = governance.latest(table(spark, at, "raw_docs").select("doc_id", "body", "stored_at"), "doc_id", "stored_at")
    parts = chunking.chunk_documents(raw, "doc_id", "body")
    return parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.length("content")).cast("long").alias("longest"), F.sum(F.length("content")).cast("long").alias("chars"))


def chunk_size_class(spark: SparkSession, at: str) -> DataFrame:
    """Documents by what the chunker does first: nothing, keep whole, or split."""
    size = F.length(F.trim(F.coalesce("text", F.lit(""))))
    kind = F.when(size == 0, "empty").when(size <= chunking.MOST, "single").otherwise("split")
    return table(spark, at, "documents").groupBy(kind.alias("class")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))


QUERIES = {f.__name__: f for f in (doc_catalogue, kb_stats, trust_tier_dist, stale_buckets, priority_conflicts, page_conflicts, priority_backfill, conflict_arbitration, frontmatter_text, hash_groups, hash_backfill_class, hash_mismatches, hash_lookup_semi, hash_new_anti, url_variants, url_host_stats, url_slug_docs, url_extract, headings, vector_ingest_rows, delete_by_doc, replace_docs, removal_impact, keyword_counts, site_freshness, chunk_documents, chunk_stats, chunk_size_class)}

ORACLE = {
    "doc_catalogue": """with d as (select doc_id, max(title) as raw_title from raw_docs where doc_id is not null group by 1),
      c as (select doc_id, chunk_id, max(title) as t, max(coalesce(len(questions), 0)) as q from chunks where doc_id is not null group by 1, 2),
      h as (select doc_id, count(*) as chunks, sum(q)::bigint as questions, max(t) as chunk_title from c group by 1)
      select coalesce(d.doc_id, h.doc_id) as doc_id, coalesce(raw_title, chunk_title) as title, coalesce(chunks, 0) as chunks, coalesce(questions, 0) as questions,
        case when d.doc_id is null then 'missing_raw' when h.doc_id is null then 'no_chunks' else 'ok' end as status from d full join h on d.doc_id = h.doc_id""",
    "kb_stats": f"with {DOCS} select coalesce(kind, 'unknown') as kind, count(*) as documents, min(fetched) as first_date, max(fetched) as last_date, count(*) filter (fetched is null) as undated from docs group by 1",
    "trust_tier_dist": f"with {DOCS} select tier::bigint as tier, priority, count(*) as documents from docs group by 1, 2",
    "stale_buckets": f"with {DOCS} select coalesce(source, '') as source, case when age is null then 'unknown' when age > 90 then 'stale' else 'fresh' end as bucket, count(*) as documents, max(age)::bigint as oldest from docs group by 1, 2",
    "priority_conflicts": f"""with {CHUNKS}, k as (select doc_id, chunk_id, coalesce({KIND}, 'unknown') as kind, coalesce({DATE}, {ID_DATE}) as fetched from once where doc_id is not null),
      p as (select *, case when kind = 'official-doc' then case when fetched >= date '{AS_OF}' - 90 then 0 else 1 end when kind = 'user-upload' then 1
        when kind = 'community' and fetched >= date '{AS_OF}' - 90 then 2 else 3 end as number from k),
      m as (select *, number > min(number) over (partition by doc_id) as low from p)
      select doc_id, count(*) as chunks, count(distinct kind) as types, count(distinct number) as priorities, sum(low::int)::bigint as lower from m group by 1 having count(distinct kind) > 1 or count(distinct number) > 1""",
    "page_conflicts": f"""with {DOCS}, p as (select {URL_KEY} as page, kind, priority, substr(priority, 2)::int as number from docs),
      m as (select *, number > min(number) over (partition by page) as low from p where page is not null)
      select page, count(*) as documents, count(distinct kind) as types, count(distinct priority) as priorities, sum(low::int)::bigint as lower from m group by 1 having count(distinct kind) > 1 or count(distinct priority) > 1""",
    "priority_backfill": f"""with {DOCS}, s as (select doc_id, nullif(trim(source_priority), '') as stored from (select *, row_number() over (partition by doc_id order by stored_at desc) as rn from raw_docs where doc_id is not null) where rn = 1)
      select case when stored is null then 'added' when stored = priority then 'skipped' else 'updated' end as action, priority, count(*) as documents from docs join s using (doc_id) group by 1, 2""",
    "conflict_arbitration": f"""with {DOCS}, p as (select {URL_KEY} as page, doc_id, priority, fetched from docs),
      r as (select *, row_number() over (partition by page order by priority, fetched desc nulls last, doc_id) as rank, count(*) over (partition by page, priority, fetched) > 1 as tied from p where page is not null)
      select page, doc_id, priority, fetched, tied from r where rank = 1""",
    "frontmatter_text": f"""with {DOCS}, v as (select doc_id, unnest(['doc_id', 'title', 'source_type', 'fetched_at', 'source_priority']) as k, unnest([doc_id, title, kind, fetched::varchar, priority]) as v, unnest([1, 2, 3, 4, 5]) as i from docs),
      l as (select doc_id, i, k || ': ' || case when regexp_matches(v, '^[0-9A-Za-z_./:@+-]+$') then v else '"' || replace(replace(replace(v, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n') || '"' end as line from v where length(trim(v)) > 0),
      b as (select doc_id, '---' || chr(10) || string_agg(line, chr(10) order by i) || chr(10) || '---' || chr(10) as block from l group by 1) select doc_id, sha256(block) as digest, length(block) as chars from b""",
    "hash_groups": f"with {HASHES} select actual, count(*) as documents, min(doc_id) as first_doc from hashes where actual is not null group by 1 having count(*) > 1",
    "hash_backfill_class": f"""with {HASHES} select case when not coalesce(has_frontmatter, false) then 'no_frontmatter' when declared is not distinct from actual then 'already_ok'
      when declared is null or declared = '' then 'added' else 'refreshed' end as class, count(*) as documents, sum(valid::int)::bigint as valid from hashes group by 1""",
    "hash_mismatches": f"with {HASHES} select doc_id, declared, actual from hashes where valid and declared <> actual",
    "hash_lookup_semi": f"with {HASHES} select doc_id, declared from hashes where declared in (select actual from hashes where actual is not null)",
    "hash_new_anti": f"""with {CHUNKS}, c as (select chunk_id, sha256({BODY.replace('body', 'content')}) as digest from once where content is not null)
      select chunk_id, digest from c where digest not in (select sha256({BODY.replace('body', 'answer')}) from qa_answers where answer is not null)""",
    "url_variants": f"select {URL_KEY} as page, count(distinct url) as spellings, count(*) as rows from chunks where length(trim(url)) > 0 group by 1 having count(distinct url) > 1",
    "url_host_stats": f"select coalesce({HOST}, '') as host, count(*) as rows, count(distinct doc_id) as documents, count(distinct source) as sources from raw_docs group by 1",
    "url_slug_docs": """with b as (select distinct url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '[?#].*$', ''), '[^a-z0-9_\\x{4e00}-\\x{9fff}]+', '-', 'g'), '-+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g') as s from raw_docs where url is not null)
      select url, case when regexp_replace(substr(s, 1, 100), '[-_]+$', '') = '' then 'unknown' else regexp_replace(substr(s, 1, 100), '[-_]+$', '') end as slug, substr(sha256(url), 1, 16) as short from b""",
    "url_extract": """with f as (select doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '(https?://[^\\s<>"\\)\\]]+)', 1), lambda u: regexp_replace(u, '[.,;:!?]+$', '')))) as named from documents)
      select named, count(distinct doc_id) as documents, max(case when regexp_matches(lower(named), '^https?://(www\\.)?github\\.com/[^/]+/[^/]+') then 'github' when regexp_matches(lower(named), '^https?://(www\\.)?gitlab\\.com/[^/]+/[^/]+') then 'gitlab'
        when regexp_matches(lower(named), '^https?://(www\\.)?arxiv\\.org/(abs|pdf|html)/') then 'arxiv' when regexp_matches(lower(named), 'rfc-editor\\.org|/rfc[-_]?\\d+') then 'rfc'
        when regexp_matches(lower(named), '\\.(pdf|docx?|pptx?|xlsx?)$') then 'file' when regexp_matches(lower(named), '^https?://') then 'web' end) as kind from f group by 1""",
    "headings": f"""with {CHUNKS} select chunk_id, nullif(trim(regexp_extract(content, '(?m)^[ \\t]*#{{1,6}}[ \\t]+(.*)$', 1)), '') as heading, regexp_replace(doc_id, '-\\d{{4}}-\\d{{2}}-\\d{{2}}(-[0-9a-f]{{8}})?$', '') as topic,
      length(content) as chars, strlen(content) as bytes from once""",
    "vector_ingest_rows": f"""with {CHUNKS}, q as (select doc_id, chunk_id, list_filter(list_transform(questions, lambda x: trim(x)), lambda x: x <> '') as qs from once)
      select doc_id, chunk_id, 'chunk' as kind, '' as question_id from once union all
      select doc_id, chunk_id, 'question', chunk_id || '-q' || lpad(i::varchar, 2, '0') from (select doc_id, chunk_id, unnest(range(1, len(qs) + 1)) as i from q where qs is not null)""",
    "delete_by_doc": f"""with {DOCS} select v.kind as kind, count(*) as "left", count(distinct v.doc_id) as documents from vectors v
      where v.doc_id is null or v.doc_id not in (select doc_id from docs where kind is null) group by 1""",
    "replace_docs": """with c as (select doc_id, chunk_id, source, ingested_at from chunks where doc_id is not null),
      n as (select doc_id, chunk_id from (select *, row_number() over (partition by chunk_id order by ingested_at desc) as rn from c where source = 'user-upload' and chunk_id is not null) where rn = 1),
      r as (select doc_id, chunk_id from c where doc_id not in (select doc_id from n) union all select doc_id, chunk_id from n) select doc_id, count(*) as rows, count(distinct chunk_id) as chunks from r group by 1""",
    "removal_impact": """with d as (select doc_id, count(*) as stored from raw_docs where doc_id is not null group by 1), c as (select doc_id, count(distinct chunk_id) as chunks from chunks group by 1), v as (select doc_id, count(*) as vectors from vectors group by 1),
      j as (select feedback_id, from_json(returned_doc_ids, '["VARCHAR"]') as ids from feedback where json_valid(returned_doc_ids)), e as (select feedback_id, trim(unnest(ids)) as doc_id from j), f as (select doc_id, count(distinct feedback_id) as feedback from e where doc_id <> '' group by 1)
      select d.doc_id, stored, coalesce(chunks, 0) as chunks, coalesce(vectors, 0) as vectors, coalesce(feedback, 0) as feedback from d left join c using (doc_id) left join v using (doc_id) left join f using (doc_id)""",
    "keyword_counts": f"""with {CHUNKS}, r as (select * from (select *, row_number() over (partition by doc_id order by stored_at desc) as rn from raw_docs where doc_id is not null) where rn = 1),
      k as (select trim(unnest(keywords)) as keyword from r union all select trim(unnest(keywords)) from once) select keyword, count(*) as count from k where keyword <> '' group by 1""",
    "site_freshness": f"""with {DOCS}, h as (select source, count(*) as documents, max(fetched) as newest from docs group by 1)
      select coalesce(s.source, h.source, '') as source, site_kind, coalesce(documents, 0) as documents, newest, round(coalesce(priority, 0.5), 3) as priority from sites s full join h on s.source = h.source""",
    "chunk_size_class": f"""select case when length(trim(coalesce(text, ''), ' ')) = 0 then 'empty' when length(trim(coalesce(text, ''), ' ')) <= {chunking.MOST} then 'single' else 'split' end as class, count(*) as documents, sum(n_chars)::bigint as chars from documents group by 1""",
}
