"""Queries on stored files and streams that Spark derives from the tables: Markdown, JSON, chunk store, HTML, streaming ingest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakb.functions import dates as D
from stratakb.functions import text as T
from stratakb.operators import chunking, governance
from stratakb.queries.documents import AS_OF, CHUNKS, DATE, DOCS, HASHES, URL_KEY, chunks_once, docs
from stratakb.session import shared_dir, table
from stratakb.sources import files
from stratakb.streaming import ingest


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder on the shared storage."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, at: str, name: str, time: str) -> DataFrame:
    """The stored files of a table as a stream, its time column with a zone."""
    rows = table(spark, at, name)
    whole = any(path.rstrip("/").endswith(f"/{name}.parquet") for path in rows.inputFiles())  # one file, or a folder of them
    folder, only = (at, f"{name}.parquet") if whole else (f"{at}/{name}.parquet", "*")
    return ingest.read_stream(spark, folder, rows.schema, only=only).withColumn(time, F.col(time).cast("timestamp"))


def last_bodies(spark: SparkSession, at: str) -> DataFrame:
    return governance.latest(table(spark, at, "raw_docs").select("doc_id", "title", "source_type", "source", "url", "fetched_at", "source_priority", "body", "stored_at"), "doc_id", "stored_at")


def markdown_of() -> Column:
    """A document as a Markdown file with frontmatter."""
    return F.concat(T.frontmatter_of({c: F.col(c) for c in ("doc_id", "title", "source", "url")}), F.coalesce("body", F.lit("")))


def markdown_fields(spark: SparkSession, at: str) -> DataFrame:
    """Documents written as Markdown and parsed again: their fields, and the hash of the body."""
    text = last_bodies(spark, at).select(markdown_of().alias("value"))
    parsed = text.select(files.frontmatter(F.col("value")).alias("meta"), files.body(F.col("value")).alias("body"))
    get = lambda k: F.try_element_at("meta", F.lit(k))
    return parsed.select(get("doc_id").alias("doc_id"), get("source").alias("source"), get("url").alias("url"), T.body_sha256(F.col("body")).alias("digest"))


def chunk_files(spark: SparkSession, at: str) -> DataFrame:
    """Chunks written as JSON lines and read again, per document: valid rows and rows without a required field."""
    folder = scratch(spark, "chunks-json")
    table(spark, at, "chunks").select("doc_id", "chunk_id", "title", "source", "url", "summary", "content").write.json(folder)
    rows = files.read_chunks_json(spark, folder)
    return rows.groupBy("doc_id").agg(F.sum(F.col("valid").cast("long")).alias("valid"), F.sum((~F.col("valid")).cast("long")).alias("broken"))


def answer_log(spark: SparkSession, at: str) -> DataFrame:
    """The answer log appended as JSON lines and read again: rows and answers per session."""
    folder = scratch(spark, "answers-log")
    rows = table(spark, at, "qa_answers").select("answer_id", "session_id", "answer", "evidence_count")
    files.append_log(rows, folder)
    log = files.read_log(spark, folder, "answer_id string, session_id string, answer string, evidence_count int")
    return log.groupBy("session_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("answer_id").alias("answers"), F.sum("evidence_count").alias("evidence"))


def file_backends(spark: SparkSession, at: str) -> DataFrame:
    """Which converter takes the original files of documents, and how many there are of each extension."""
    rows = table(spark, at, "raw_docs").select(F.coalesce(files.backend(F.col("original_file")), F.lit("none")).alias("backend"), F.lower(F.regexp_extract(F.coalesce("original_file", F.lit("")), r"\.([A-Za-z0-9]+)$", 1)).alias("extension"))
    return rows.groupBy("backend", "extension").agg(F.count(F.lit(1)).alias("rows"))


def question_index(spark: SparkSession, at: str) -> DataFrame:
    """Questions per chunk after an index of later questions was merged: entries of the index win over those of the chunk."""
    rows = table(spark, at, "chunks").where("chunk_id is not null").select("chunk_id", "questions", "ingested_at")
    index = files.read_question_index(spark, files.write_question_index(governance.latest(rows, "chunk_id", "ingested_at").where("size(questions) > 1"), scratch(spark, "questions")))
    new = governance.latest(rows, "chunk_id", "ingested_at").where("size(questions) > 2").select("chunk_id", F.slice("questions", 1, 1).alias("questions"))
    merged = files.upsert_questions(index, new)
    out = files.override_questions(chunks_once(spark, at, "questions"), merged)
    return out.select("chunk_id", F.size(T.clean_list(F.col("questions"))).cast("long").alias("questions"), F.sha2(F.coalesce(F.get("questions", F.lit(0)), F.lit("")), 256).alias("first"))


def stored_chunks(spark: SparkSession, at: str) -> DataFrame:
    """Chunks of the stored bodies, written with their inherited fields: per document what was inherited, and the text where one chunk holds it all."""
    folder = scratch(spark, "chunk-store")
    chunking.write_chunks(chunking.chunk_rows(last_bodies(spark, at)), folder)
    rows = spark.read.parquet(folder)
    one = F.when(F.count(F.lit(1)) == 1, F.max(F.sha2("content", 256)))
    small = F.max(F.length("content")) <= chunking.MOST
    return rows.groupBy("doc_id").agg(F.max("url").alias("url"), F.max("source_priority").alias("priority"), F.when(small, one).alias("digest"), F.min("chunk_id").alias("first_chunk")).where("digest is not null")


def html_markdown(spark: SparkSession, at: str) -> DataFrame:
    """Titles and contents of chunks as HTML pages, converted to Markdown: the heading that comes out."""
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    pages = chunks_once(spark, at, "title", "content").where("length(trim(title)) > 0")
    page = F.concat(F.lit("<html><head><script>x = 1</script></head><body><nav>Home</nav><h1>"), esc("title"), F.lit("</h1><pre>"), F.coalesce(esc("content"), F.lit("")), F.lit("</pre></body></html>"))
    out = files.html_to_markdown(pages.select("chunk_id", page.alias("page")), "page")
    return out.select("chunk_id", T.first_heading(F.col("markdown")).alias("heading"), F.contains("markdown", F.lit("x = 1")).alias("script"))


def stream_hours(spark: SparkSession, at: str) -> DataFrame:
    """Events per hour and type, counted by a stream over the stored events."""
    events = table_stream(spark, at, "events", "ts")
    out = ingest.last_rows(ingest.drain(ingest.windowed_counts(events, "ts", "event_type", "1 hour"), "update", scratch(spark, "hours")), "window_start", "event_type")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("hour"), "event_type", "events")


def stream_hits(spark: SparkSession, at: str) -> DataFrame:
    """Hits and distinct days of each user, kept as state by a stream."""
    events = table_stream(spark, at, "events", "ts")
    out = ingest.last_rows(ingest.drain(ingest.hit_state(events, "user_id", "ts"), "update", scratch(spark, "hits")), "key")
    return out.select(F.col("key").cast("long").alias("user_id"), "hits", F.col("days").cast("long").alias("days"), "promoted")


def stream_new_documents(spark: SparkSession, at: str) -> DataFrame:
    """Content hashes of documents that a deduplicating stream lets through, once each."""
    raw = table_stream(spark, at, "raw_docs", "stored_at").select("doc_id", "body", "stored_at")
    return ingest.drain(ingest.new_documents(raw, "stored_at"), "append", scratch(spark, "ingest")).select("content_sha256")


def stream_counters(spark: SparkSession, at: str) -> DataFrame:
    """Counters per event type, upserted batch by batch."""
    folder = scratch(spark, "counters")
    stream = table_stream(spark, at, "events", "ts").select("event_type")
    query = stream.writeStream.foreachBatch(ingest.keep_counts(folder, "event_type")).option("checkpointLocation", f"{folder}-log").trigger(availableNow=True).start()
    query.awaitTermination(600)
    return spark.read.parquet(f"{folder}/v{query.lastProgress['batchId']}")


def document_order(spark: SparkSession, at: str) -> DataFrame:
    """Documents, the newest first, then by id from the end."""
    return docs(spark, at).select("doc_id", "fetched", "priority").orderBy(F.desc_nulls_last("fetched"), F.desc("doc_id"))


def text_titles(spark: SparkSession, at: str) -> DataFrame:
    """Title that a text would be filed under, its slug, and its first paragraph's length."""
    rows = table(spark, at, "documents").where("text is not null").select("doc_id", T.title_of(F.col("text")).alias("title"))
    return rows.select("doc_id", F.sha2(F.coalesce("title", F.lit("")), 256).alias("title"), T.file_slug(F.col("title")).alias("slug"))


def enrichment_due(spark: SparkSession, at: str) -> DataFrame:
    """Chunks per source that still lack a summary, keywords or questions."""
    once = chunks_once(spark, at, "source", "summary", "keywords", "questions")
    due = T.needs_enrichment(F.col("summary"), F.col("keywords"), F.col("questions"))
    return once.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.sum(due.cast("long")).alias("due"), F.count(F.lit(1)).alias("chunks"))


def chunk_groups(spark: SparkSession, at: str) -> DataFrame:
    """Chunks of each document in order, as a scan of the chunk store groups them; chunks without a document or content are skipped."""
    once = chunks_once(spark, at, "doc_id", "content").where("doc_id is not null and content is not null")
    return once.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.array_join(F.sort_array(F.collect_list("chunk_id")), ",").alias("chunk_ids"), F.sum(F.length("content")).cast("long").alias("chars"))


def chunk_prefix_join(spark: SparkSession, at: str) -> DataFrame:
    """Documents with the chunks and question rows whose ids continue the id of the document, whatever document they name."""
    own = F.regexp_replace("chunk_id", r"-\d{3}$", "")
    chunks = chunks_once(spark, at).select(own.alias("doc_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"))
    asked = table(spark, at, "vectors").where("kind = 'question'").select(F.regexp_replace("question_id", r"-\d{3}-q\d{2}$", "").alias("doc_id"), "question_id")
    asked = asked.groupBy("doc_id").agg(F.count_distinct("question_id").alias("questions"))
    held = docs(spark, at).select("doc_id").join(chunks, "doc_id", "left").join(asked, "doc_id", "left")
    return held.select("doc_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("questions", F.lit(0)).alias("questions"))


def url_prefix_join(spark: SparkSession, at: str) -> DataFrame:
    """Pages of chunks with the documents stored at them or below them: a prefix join as an equi join on every path above a document."""
    page = T.url_key(F.col("url"))
    below = docs(spark, at).select("doc_id", page.alias("page")).where("page is not null")
    parts = F.split("page", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = below.select("doc_id", F.explode(above).alias("page"))
    asked = table(spark, at, "chunks").select(page.alias("page")).where("page is not null").distinct()
    return asked.join(above, "page").groupBy("page").agg(F.count_distinct("doc_id").alias("documents"))


def store_health(spark: SparkSession, at: str) -> DataFrame:
    """Documents per trust tier, documents without chunks, chunks without a document, and vectors without a chunk."""
    d, c = docs(spark, at), chunks_once(spark, at, "doc_id")
    tiers = d.groupBy(F.concat(F.lit("tier "), F.col("tier").cast("string")).alias("what")).agg(F.count(F.lit(1)).alias("rows"))
    count = lambda name, df: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("what"), "rows")
    bare = d.join(c.where("doc_id is not null"), "doc_id", "left_anti")
    orphan = c.join(d, "doc_id", "left_anti")
    loose = table(spark, at, "vectors").join(c.select("chunk_id"), "chunk_id", "left_anti")
    return tiers.unionByName(count("no chunks", bare)).unionByName(count("orphan chunks", orphan)).unionByName(count("orphan vectors", loose))


def inferred_types(spark: SparkSession, at: str) -> DataFrame:
    """Source types that URLs suggest beside those that documents carry."""
    return docs(spark, at).groupBy(F.coalesce("kind", F.lit("unknown")).alias("kind"), T.inferred_type(F.col("url")).alias("inferred")).agg(F.count(F.lit(1)).alias("documents"))


def sites_due(spark: SparkSession, at: str) -> DataFrame:
    """Sites that were last seen more than 30 days ago, with the documents that wait for a new look."""
    s = table(spark, at, "sites").select("source", D.lenient_date(F.col("last_seen")).alias("seen"))
    held = docs(spark, at).groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    out = s.join(held, "source", "left").where(D.is_due(F.col("seen"), AS_OF, 30 * 24))
    return out.select("source", "seen", F.coalesce("documents", F.lit(0)).alias("documents"))


def outcome_fan_in(spark: SparkSession, at: str) -> DataFrame:
    """Per session, the answers whose extraction worked and those that failed, and the kinds of failure."""
    status = F.regexp_replace(F.lower(F.trim("extraction_status")), "_", "-")
    rows = governance.latest(table(spark, at, "qa_answers").select("answer_id", "session_id", "extraction_status", "logged_at"), "answer_id", "logged_at").select("session_id", status.alias("status"))
    worked = F.col("status") == "ok"
    return rows.groupBy("session_id").agg(F.count_if(worked).alias("worked"), F.count_if(~F.coalesce(worked, F.lit(False))).alias("failed"), F.array_join(F.sort_array(F.collect_set(F.when(~worked, F.col("status")))), ",").alias("kinds"))


def first_paragraphs(spark: SparkSession, at: str) -> DataFrame:
    """First paragraph of every chunk, as a summary falls back to it."""
    rows = chunks_once(spark, at, "content").select("chunk_id", T.first_paragraph(F.col("content")).alias("p"))
    return rows.where("p is not null").select("chunk_id", F.length("p").cast("long").alias("chars"), F.sha2("p", 256).alias("digest"))


QUERIES = {f.__name__: f for f in (markdown_fields, chunk_files, answer_log, file_backends, question_index, stored_chunks, html_markdown, stream_hours, stream_hits, stream_new_documents, stream_counters, document_order, text_titles, enrichment_due, chunk_groups, chunk_prefix_join, url_prefix_join, store_health, inferred_types, sites_due, outcome_fan_in, first_paragraphs)}

LAST = "l as (select * from (select *, row_number() over (partition by doc_id order by stored_at desc) as rn from raw_docs where doc_id is not null) where rn = 1)"
LF = "replace(replace({c}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
ORACLE = {
    "markdown_fields": f"with {HASHES}, {LAST} select l.doc_id, nullif(l.source, '') as source, nullif(trim(l.url), '') as url, coalesce(actual, sha256('')) as digest from l join hashes using (doc_id)",
    "chunk_files": "select doc_id, sum((chunk_id is not null and content is not null and doc_id is not null)::int)::bigint as valid, sum((chunk_id is null or content is null or doc_id is null)::int)::bigint as broken from chunks group by 1",
    "answer_log": "select session_id, count(*) as rows, count(distinct answer_id) as answers, sum(evidence_count)::bigint as evidence from qa_answers group by 1",
    "file_backends": r"""with e as (select lower(regexp_extract(coalesce(original_file, ''), '\.([A-Za-z0-9]+)$', 1)) as extension from raw_docs)
      select case when extension in ('pdf', 'docx', 'pptx', 'xlsx', 'png', 'jpg', 'jpeg') then 'document' when extension in ('html', 'htm') then 'html' when extension in ('md', 'markdown') then 'markdown' when extension in ('txt', 'text', 'log', 'rst') then 'text' when extension = 'tex' then 'tex' when extension = '' then 'none' else 'code' end as backend, extension, count(*) as rows from e group by 1, 2""",
    "question_index": f"""with {CHUNKS}, q as (select chunk_id, case when len(questions) > 2 then questions[1:1] else questions end as qs from once)
      select chunk_id, coalesce(len(list_filter(list_transform(qs, lambda x: trim(x)), lambda x: x <> '')), 0) as questions, sha256(coalesce(qs[1], '')) as first from q""",
    "stored_chunks": f"""with {LAST}, b as (select *, trim({LF.format(c='body')}, ' ' || chr(10) || chr(9)) as t from l where body is not null)
      select doc_id, nullif(trim(url), '') as url, nullif(trim(source_priority), '') as priority, sha256(t) as digest, doc_id || '-001' as first_chunk from b where length(t) between 1 and {chunking.MOST}""",
    "html_markdown": f"with {CHUNKS} select chunk_id, trim(title) as heading, contains(content, 'x = 1') as script from once where length(trim(title)) > 0",
    "stream_hours": "select date_trunc('hour', ts) as hour, event_type, count(*) as events from events where ts is not null group by 1, 2",
    "stream_hits": "select user_id, count(*) as hits, count(distinct ts::date) as days, count(*) >= 3 and count(distinct ts::date) >= 2 as promoted from events where user_id is not null and ts is not null group by 1",
    "stream_new_documents": f"select distinct sha256(regexp_replace({LF.format(c='body')}, '^\n+|\n+$', '', 'g')) as content_sha256 from raw_docs where body is not null",
    "stream_counters": "select event_type, count(*) as count from events where trim(event_type) <> '' group by 1",
    "document_order": f"with {DOCS} select doc_id, fetched, priority from docs",
    "text_titles": r"""with t as (select doc_id, string_split(replace(text, chr(13), ''), chr(10)) as ls, list_filter(string_split(replace(text, chr(13), ''), chr(10))[1:50], lambda x: regexp_matches(x, '^#[ \t]+[^ \t]')) as hs from documents where text is not null),
      h as (select doc_id, substr(coalesce(regexp_replace(hs[1], '^#[ \t]+|[ \t]+$', '', 'g'), regexp_replace(list_filter(ls, lambda x: regexp_matches(x, '[^ \t\f]'))[1], '^[ \t\f]+|[ \t\f]+$', '', 'g')), 1, 200) as title from t),
      s as (select doc_id, title, regexp_replace(regexp_replace(lower(regexp_replace(title, '\.[A-Za-z0-9]+$', '')), '[^a-z0-9\x{4e00}-\x{9fff}]+', '-', 'g'), '^-+|-+$', '', 'g') as slug from h)
      select doc_id, sha256(coalesce(title, '')) as title, case when coalesce(length(slug), 0) = 0 then 'untitled' else slug end as slug from s""",
    "enrichment_due": f"""with {CHUNKS} select coalesce(source, '') as source, sum((coalesce(trim(summary), '') = '' or coalesce(len(list_filter(keywords, lambda x: trim(x) <> '')), 0) = 0 or coalesce(len(list_filter(questions, lambda x: trim(x) <> '')), 0) = 0)::int)::bigint as due, count(*) as chunks from once group by 1""",
    "chunk_groups": f"with {CHUNKS} select doc_id, count(*) as chunks, string_agg(chunk_id, ',' order by chunk_id) as chunk_ids, sum(length(content))::bigint as chars from once where doc_id is not null and content is not null group by 1",
    "chunk_prefix_join": f"""with {CHUNKS}, {DOCS}, c as (select regexp_replace(chunk_id, '-[0-9]{{3}}$', '') as doc_id, count(*) as n from once group by 1),
      q as (select regexp_replace(question_id, '-[0-9]{{3}}-q[0-9]{{2}}$', '') as doc_id, count(distinct question_id) as n from vectors where kind = 'question' group by 1)
      select d.doc_id, coalesce(c.n, 0) as chunks, coalesce(q.n, 0) as questions from docs d left join c using (doc_id) left join q using (doc_id)""",
    "url_prefix_join": f"""with {DOCS}, b as (select doc_id, {URL_KEY} as page from docs), a as (select distinct {URL_KEY} as page from chunks)
      select a.page, count(distinct b.doc_id) as documents from a join b on b.page = a.page or starts_with(b.page, a.page || '/') where a.page is not null group by 1""",
    "store_health": f"""with {CHUNKS}, {DOCS} select 'tier ' || tier as what, count(*) as rows from docs group by 1 union all select 'no chunks', count(*) from docs where doc_id not in (select doc_id from once where doc_id is not null)
      union all select 'orphan chunks', count(*) from once where doc_id is null or doc_id not in (select doc_id from docs) union all select 'orphan vectors', count(*) from vectors where chunk_id is null or chunk_id not in (select chunk_id from once)""",
    "inferred_types": f"""with {DOCS} select coalesce(kind, 'unknown') as kind, case when contains(u, '/docs/') or contains(u, 'docs.') or contains(u, '.readthedocs.') or contains(u, 'arxiv.org/abs') or contains(u, 'rfc-editor.org') or contains(u, 'tools.ietf.org/rfc') then 'official-doc' else 'community' end as inferred, count(*) as documents
      from (select kind, lower(coalesce(url, '')) as u from docs) group by 1, 2""",
    "sites_due": f"""with {DOCS}, h as (select source, count(*) as documents from docs group by 1), s as (select source, {DATE.replace('fetched_at', 'last_seen')} as seen from sites)
      select source, seen, coalesce(documents, 0) as documents from s left join h using (source) where seen is null or seen < date '{AS_OF}' - 30""",
    "outcome_fan_in": """with a as (select session_id, replace(lower(trim(extraction_status)), '_', '-') as status from (select *, row_number() over (partition by answer_id order by logged_at desc) as rn from qa_answers where answer_id is not null) where rn = 1)
      select session_id, count(*) filter (status = 'ok') as worked, count(*) filter (coalesce(status <> 'ok', true)) as failed, coalesce(string_agg(distinct status, ',' order by status) filter (status <> 'ok'), '') as kinds from a group by 1""",
    "first_paragraphs": rf"""with {CHUNKS}, b as (select chunk_id, list_filter(list_transform(string_split_regex(replace(content, chr(13), ''), '\n[ \t]*\n'), lambda x: trim(regexp_replace(regexp_replace(x, '(?m)^[ \t]*#{{1,6}}[ \t].*$', '', 'g'), '[ \t\n\f\r\v]+', ' ', 'g'))), lambda x: x <> '') as ps from once)
      select chunk_id, length(substr(ps[1], 1, 500)) as chars, sha256(substr(ps[1], 1, 500)) as digest from b where ps[1] is not null""",
}
