"""Catalogue, content hashes, duplicates, staleness, conflicts and consistent removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratakb.functions import dates, text


def latest(df: DataFrame, key: str, time: str) -> DataFrame:
    """The last row of each key by time; rows repeated by a later ingest are folded before the shuffle.

    Null keys are dropped; a null time sorts first; ties are broken by the row's own content.
    """
    names = [c for c in df.columns if c != key]
    stamp = F.struct(F.col(time), F.xxhash64(*names))
    picked = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*names), stamp).alias("row"))
    return picked.select(key, "row.*")


def documents(raw: DataFrame, as_of: str) -> DataFrame:
    """One typed row per doc_id: dates parsed, source types unified, age, trust tier and priority added."""
    base = raw.select("doc_id", "title", "source_type", "source", "url", "fetched_at", "source_priority", "stored_at")
    once = latest(base, "doc_id", "stored_at")
    typed = once.withColumn("kind", dates.source_type(F.col("source_type"))).withColumn("fetched", F.coalesce(dates.lenient_date(F.col("fetched_at")), dates.date_in_id(F.col("doc_id"))))
    aged = typed.withColumn("age", dates.age_days(F.col("fetched"), as_of))
    return aged.withColumn("tier", dates.trust_tier(F.col("kind"), F.col("age"))).withColumn("priority", dates.source_priority(F.col("kind"), F.col("age")))


def catalogue(raw: DataFrame, chunks: DataFrame) -> DataFrame:
    """Full outer view of documents and their chunks: (doc_id, title, chunks, questions, status)."""
    docs = raw.where("doc_id is not null").groupBy("doc_id").agg(F.max("title").alias("raw_title"))
    once = chunks.where("doc_id is not null").groupBy("doc_id", "chunk_id").agg(F.max("title").alias("t"), F.max(F.size(F.coalesce("questions", F.array().cast("array<string>")))).alias("q"))
    held = once.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("q").cast("long").alias("questions"), F.max("t").alias("chunk_title"), F.lit(True).alias("held"))
    both = docs.withColumn("stored", F.lit(True)).join(held, "doc_id", "full")
    status = F.when(F.col("stored").isNull(), "missing_raw").when(F.col("held").isNull(), "no_chunks").otherwise("ok")
    return both.select("doc_id", F.coalesce("raw_title", "chunk_title").alias("title"), F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("questions", F.lit(0)).alias("questions"), status.alias("status"))


def hash_index(raw: DataFrame) -> DataFrame:
    """(doc_id, actual, declared, valid): the content hash of each document's last body beside the declared one."""
    once = latest(raw.select("doc_id", "declared_sha256", "has_frontmatter", "body", "stored_at"), "doc_id", "stored_at")
    declared = F.lower(F.trim("declared_sha256"))
    return once.select("doc_id", "has_frontmatter", text.body_sha256(F.col("body")).alias("actual"), declared.alias("declared"), text.is_digest(F.col("declared_sha256")).alias("valid"))


def duplicate_groups(index: DataFrame) -> DataFrame:
    """(actual, documents, first_doc): content hashes of more than one document; null bodies are no group."""
    return index.where("actual is not null").groupBy("actual").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc")).where("documents > 1")


def backfill_class(index: DataFrame) -> DataFrame:
    """Adds class: what a backfill of declared hashes would do to each document; running it twice changes nothing."""
    kind = (
        F.when(~F.coalesce("has_frontmatter", F.lit(False)), "no_frontmatter")
        .when(F.col("declared").eqNullSafe(F.col("actual")), "already_ok")
        .when(F.col("declared").isNull() | (F.col("declared") == ""), "added")
        .otherwise("refreshed")
    )
    return index.withColumn("class", kind)


def remove_documents(table: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """table without the rows of the documents in gone: an anti join, the same for every derived table."""
    return table.join(gone.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def replace_documents(table: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """table with the rows of all documents in new replaced by those rows."""
    return remove_documents(table, new, key).unionByName(new.select(*table.columns))


def upsert_counts(state: DataFrame, events: DataFrame, key: str, count: str = "count") -> DataFrame:
    """Counter state after adding one for each event row; blank keys are left out."""
    new = events.select(F.trim(key).alias(key)).where(F.col(key) != "").groupBy(key).agg(F.count(F.lit(1)).alias("_new"))
    return state.join(new, key, "full").select(key, (F.coalesce(count, F.lit(0)) + F.coalesce("_new", F.lit(0))).alias(count))


def conflicts(docs: DataFrame, group: str) -> DataFrame:
    """Groups with more than one source type or priority, and how many of their rows rank below the best."""
    low = F.col("number") > F.min("number").over(Window.partitionBy(group))
    marked = docs.withColumn("number", dates.priority_number(F.col("priority"))).withColumn("low", low.cast("long"))
    out = marked.groupBy(group).agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("kind").alias("types"), F.count_distinct("priority").alias("priorities"), F.sum("low").alias("lower"))
    return out.where("types > 1 or priorities > 1")


def arbitrate(docs: DataFrame, group: str) -> DataFrame:
    """The document that wins each group: best priority, then newest, then smallest id; tied says whether the first two decide."""
    number = dates.priority_number(F.col("priority"))
    order = Window.partitionBy(group).orderBy(number, F.col("fetched").desc_nulls_last(), "doc_id")
    same = Window.partitionBy(group, number, "fetched")
    ranked = docs.withColumn("_rank", F.row_number().over(order)).withColumn("tied", F.count(F.lit(1)).over(same) > 1)
    return ranked.where("_rank = 1").drop("_rank")


def guard_schema(df: DataFrame, required: dict[str, str], vector: str | None = None, dim: int | None = None) -> DataFrame:
    """df, after a check that it has the required columns and types; rows whose vector has another length fail on reading."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    wrong = [f"{n}: {have.get(n, 'missing')} instead of {t}" for n, t in required.items() if have.get(n) != t]
    if wrong:
        raise ValueError("; ".join(wrong))
    if vector is None:
        return df
    sized = F.when(F.col(vector).isNull() | (F.size(vector) == dim), F.col(vector)).otherwise(F.raise_error(F.lit(f"{vector} must have {dim} values")))
    return df.withColumn(vector, sized)
