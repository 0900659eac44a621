"""Operators against brute force and on edge cases."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratakb.operators import chunking, evaluation, evidence, governance, retrieval


def test_dense_topk_is_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8)).round(2)
    x[10] = x[20]  # a tie
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, dense_vector array<float>")
    got = retrieval.dense_topk(df, df.where("id % 50 = 0"), 7, block_rows=64).collect()
    x32 = x.astype(np.float32).astype(float)
    for q in range(0, 300, 50):
        order = sorted(range(300), key=lambda j: (-round(float(x32[q] @ x32[j]), 9), j))[:7]
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == order


def test_unusable_vectors_are_dropped(spark):
    rows = [(1, [1.0, 2.0]), (2, [float("nan"), 1.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "id long, dense_vector array<float>")
    kept = retrieval.usable_vectors(df, dim=2)
    assert [r.id for r in kept.collect()] == [1]
    assert retrieval.dense_topk(kept.limit(0), kept, 3).count() == 0


def test_fusion_and_collapse(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "q int, d string, rank int")
    b = spark.createDataFrame([(1, "y", 1)], "q int, d string, rank int")
    got = {r.d: (r.rrf_score, r.lists) for r in retrieval.reciprocal_rank_fusion([a, b], "q", "d").collect()}
    assert got == {"x": (round(1 / 61, 6), 1), "y": (round(1 / 62 + 1 / 61, 6), 2)}
    hits = spark.createDataFrame([(1, "c", "chunk", 2), (1, "c", "question", 1), (1, "", "chunk", 3), (1, None, "chunk", 4)], "q int, chunk_id string, kind string, rank int")
    row = retrieval.collapse_questions(hits, "q").collect()
    assert [(r.chunk_id, r.kinds, r.best_rank) for r in row] == [("c", "chunk,question", 1)]


def test_grep(spark):
    df = spark.createDataFrame([("Alpha beta",), ("alpha",), (None,)], "t string")
    assert [r[0] for r in df.select(retrieval.contains_all(F.col("t"), ["ALPHA", "beta"])).collect()] == [True, False, False]
    assert not any(r[0] for r in df.select(retrieval.contains_all(F.col("t"), [" "])).collect())


def test_recall_and_groups(spark):
    expected = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "q int, d string")
    ranked = spark.createDataFrame([(1, "a", 1), (2, "x", 1), (2, "b", 4)], "q int, d string, rank int")
    ranks = evaluation.hit_ranks(expected, ranked, "q", "d")
    row = ranks.agg(*evaluation.summary()).first()
    assert (row.queries, row.recall_1, row.recall_3, row.recall_5, row.mrr) == (3, 0.3333, 0.3333, 0.6667, round((1 + 0.25) / 3, 4))
    empty = ranks.limit(0).agg(*evaluation.summary()).first()
    assert (empty.queries, empty.recall_1, empty.mrr) == (0, 0.0, 0.0)
    groups = ranks.withColumn("g", F.when(F.col("q") == 1, " ").otherwise("z"))
    got = {r.g: r.queries for r in evaluation.grouped_summary(groups, "g").collect()}
    assert got == {None: 3, "unknown": 1, "z": 2}


def test_report_difference(spark):
    left = spark.createDataFrame([("r1", 0.5), ("old", 1.0)], "metric string, value double")
    right = spark.createDataFrame([("r1", 0.75), ("new", 1.0)], "metric string, value double")
    got = {r.metric: r.delta for r in evaluation.report_difference(left, right).collect()}
    assert got == {"r1": 0.25, "old": None, "new": None}


def test_evidence(spark):
    rows = [("q", "c1", 0.5, 1), ("q", "c2", 0.7, 2), ("q", "c1", 0.9, 3), ("q", "c3", None, 4), ("q", "c2", 0.7, 5)]
    df = spark.createDataFrame(rows, "g string, c string, s double, p int")
    assert sorted((r.c, r.p) for r in evidence.best_per_key(df, ["g", "c"], "s", "p").collect()) == [("c1", 3), ("c2", 2), ("c3", 4)]
    sized = df.withColumn("n", F.lit(10))
    assert sorted(r.p for r in evidence.within_budget(sized, "g", "p", "n", 30).collect()) == [1, 2, 3]
    assert [(r.p, r.position) for r in evidence.last_rows(df, "g", ["p"], 2).orderBy("p").collect()] == [(4, 1), (5, 2)]
    merged = evidence.merged_first([df.where("p > 2"), df], ["c"], "p")
    assert sorted((r.c, r.list, r.p) for r in merged.collect()) == [("c1", 0, 3), ("c2", 0, 5), ("c3", 0, 4)]


def test_content_hash_cases(spark):
    import hashlib

    a, b = (hashlib.sha256(x).hexdigest() for x in (b"A", b"B"))
    rows = [("ok", True, a, "A", 1), ("stale", True, "0" * 64, "B", 1), ("missing", True, None, "C", 1), ("plain", False, None, "D", 1), ("copy", True, a, "A", 1), ("ok", True, a, "A", 2)]
    raw = spark.createDataFrame(rows, "doc_id string, has_frontmatter boolean, declared_sha256 string, body string, stored_at int")
    index = governance.hash_index(raw)
    assert [(r.documents, r.first_doc) for r in governance.duplicate_groups(index).collect()] == [(2, "copy")]
    got = {r["class"]: r["count"] for r in governance.backfill_class(index).groupBy("class").count().collect()}
    assert got == {"already_ok": 2, "refreshed": 1, "added": 1, "no_frontmatter": 1}
    filled = raw.join(index.select("doc_id", "actual"), "doc_id").withColumn("declared_sha256", F.col("actual")).drop("actual")
    again = governance.backfill_class(governance.hash_index(filled)).where("class in ('added', 'refreshed')")
    assert again.count() == 0


def test_removal_and_upsert(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "doc_id string, n int")
    gone = spark.createDataFrame([("a",), (None,)], "doc_id string")
    assert sorted(r.n for r in governance.remove_documents(t, gone).collect()) == [2, 3]
    new = spark.createDataFrame([("b", 9), ("c", 8)], "doc_id string, n int")
    assert sorted(r.n for r in governance.replace_documents(t, new).collect()) == [1, 3, 8, 9]
    state = spark.createDataFrame([("k", 2)], "kw string, count long")
    events = spark.createDataFrame([(" k",), ("z",), ("",), (None,)], "kw string")
    assert {r.kw: r["count"] for r in governance.upsert_counts(state, events, "kw").collect()} == {"k": 3, "z": 1}


def test_catalogue_keeps_orphans(spark):
    raw = spark.createDataFrame([("a", "A"), ("b", None)], "doc_id string, title string")
    chunks = spark.createDataFrame([("a", "a-1", "t", ["q"]), ("a", "a-1", "t", ["q"]), ("z", "z-1", "Z", None)], "doc_id string, chunk_id string, title string, questions array<string>")
    got = {r.doc_id: (r.title, r.chunks, r.questions, r.status) for r in governance.catalogue(raw, chunks).collect()}
    assert got == {"a": ("A", 1, 1, "ok"), "b": (None, 0, 0, "no_chunks"), "z": ("Z", 1, 0, "missing_raw")}


# --- chunker -----------------------------------------------------------------------------------------


def test_chunker_rules():
    assert chunking.chunk(None) == [] and chunking.chunk(" \n ") == []
    assert chunking.chunk("---\na: b --- c\n---\nbody") == ["body"]
    long = "# One\n" + "a" * 40 + "\n\n```\n# no heading\n```\n## Two\n" + "b" * 60
    parts = chunking.chunk(long, 30, 100, 10)
    assert [p.split("\n")[0] for p in parts] == ["# One", "## Two"]
    assert chunking.chunk("#### deep\n" + "x" * 120, 10, 100, 10)[0].startswith("#### deep")


def test_chunker_repeats_table_headers():
    rows = "\n".join(f"| {i} | {'v' * 20} |" for i in range(20))
    parts = chunking.chunk("before\n| a | b |\n|---|---|\n" + rows + "\nafter", 10, 200, 20)
    assert len(parts) > 2 and all("| a | b |\n|---|---|" in p for p in parts)
    assert parts[0].startswith("before") and parts[-1].endswith("after")
    assert [x for p in parts for x in p.split("\n") if x.startswith("| ") and "v" in x] == rows.split("\n")


def test_chunker_joins_short_tail():
    parts = chunking.chunk("# A\n" + "a" * 90 + "\n# B\nshort", 50, 95, 0)
    assert len(parts) == 1 and parts[0].endswith("short")


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.lists(st.text(alphabet="ab 。.\n#|-`", max_size=60), max_size=12))
def test_chunker_loses_no_letters(parts):
    text = "\n\n".join(parts)
    whole = sum(c in "ab" for c in chunking.FRONTMATTER.sub("", text, count=1))
    got = chunking.chunk(text, 20, 40, 0)
    assert sum(c in "ab" for p in got for c in p) >= whole


def test_chunk_documents(spark):
    df = spark.createDataFrame([(1, "x" * 30 + ". " + "y" * 30), (2, None), (3, "")], "doc_id long, text string")
    got = chunking.chunk_documents(df, "doc_id", "text", 10, 40, 5).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.seq) for r in got] == [("1-001", 1), ("1-002", 2)]


@pytest.mark.parametrize("seed", range(3))
def test_latest_row(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), rng.randrange(5), rng.randrange(100)) for _ in range(40)] + [(None, 9, 9)]
    got = governance.latest(spark.createDataFrame(rows, "k string, t int, v int"), "k", "t").collect()
    assert {r.k: r.t for r in got} == {k: max(t for a, t, _ in rows if a == k) for k in {r[0] for r in rows} if k}


def test_arbitration(spark):
    import datetime as dt

    rows = [("p", "a", "P1", dt.date(2024, 1, 2)), ("p", "b", "P0", dt.date(2023, 1, 1)), ("p", "c", "P0", None), ("q", "d", "P2", None), ("q", "e", "P2", None)]
    df = spark.createDataFrame(rows, "page string, doc_id string, priority string, fetched date")
    got = {r.page: (r.doc_id, r.tied) for r in governance.arbitrate(df, "page").collect()}
    assert got == {"p": ("b", False), "q": ("d", True)}


def test_schema_guard(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id long, v array<float>")
    assert governance.guard_schema(df, {"id": "bigint"}, "v", 2).count() == 2
    with pytest.raises(ValueError, match="missing"):
        governance.guard_schema(df, {"other": "string"})
    with pytest.raises(Exception, match="must have 3 values"):
        governance.guard_schema(df, {}, "v", 3).collect()


def test_chunk_rows_inherit_and_are_stored(spark, tmp_path):

    long = "\n\n".join(f"# Part {i}\n" + "word " * 900 for i in range(4))
    raw = spark.createDataFrame([("d1", "T", "https://h/x", " ", "P1", "short"), ("d2", None, None, "community", None, long), ("d3", "E", None, None, None, None)], "doc_id string, title string, url string, source_type string, source_priority string, body string")
    chunking.write_chunks(chunking.chunk_rows(raw), str(tmp_path / "store"))
    rows = {r.chunk_id: r for r in spark.read.parquet(str(tmp_path / "store")).collect()}
    assert {r.doc_id for r in rows.values()} == {"d1", "d2"} and len(rows) == 5
    one = rows["d1-001"]
    assert (one.title, one.url, one.source_type, one.source_priority, one.source, one.summary, one.keywords, one.content) == ("T", "https://h/x", None, "P1", None, "", [], "short")


def test_dense_search_on_a_grid(spark):
    rows = [(i, [float((i * 7 + j) % 5 - 2) + i / 1000 for j in range(4)]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, dense_vector array<float>")
    one = sorted((r.query_id, r.id, r["rank"]) for r in retrieval.dense_topk(df, df.where("id < 20"), 3).collect())
    grid = sorted((r.query_id, r.id, r["rank"]) for r in retrieval.dense_topk(df, df.where("id < 20"), 3, block_rows=6).collect())
    assert one == grid and len(one) == 60


def test_frequent_terms_are_split(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "cache " * (i % 3 + 1) + "index") for i in range(30)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "cache index")], "q long, text2 string")
    score = lambda: sorted(tuple(r) for r in retrieval.sparse_scores(docs, asked, "doc_id", "text", "q", "text2", 30).collect())
    whole = score()
    monkeypatch.setattr(retrieval, "TERM_ROWS", 4)
    assert score() == whole and len(whole) == 30


def test_multi_query_prefers_the_chunk(spark):
    rows = [("g", 1, 10, "c1", "question", 1), ("g", 1, 11, "c1", "chunk", 2), ("g", 2, 12, "c1", "question", 1), ("g", 2, 13, "", "chunk", 2), ("g", 2, 14, None, "question", 3)]
    hits = spark.createDataFrame(rows, "source string, query_id long, id long, chunk_id string, kind string, rank int")
    got = {r.chunk_id: (r.rrf_score, r.queries, r.kinds, r.shown) for r in retrieval.multi_query(hits, "source", "query_id").collect()}
    assert got == {"c1": (round(2 / 61 + 1 / 62, 6), 2, "chunk,question", 11), "13": (round(1 / 62, 6), 1, "chunk", 13), "14": (round(1 / 63, 6), 1, "question", 14)}


def test_path_contribution(spark):

    rows = [(1, 6, 1), (None, 2, 2), (9, None, 12), (None, None, None)]
    df = spark.createDataFrame(rows, "embedding_rank int, grep_rank int, full_rank int")
    assert tuple(evaluation.path_contribution(df).first()) == (0.25, 0.25, 0.5, 1, 0.25)
    assert tuple(evaluation.path_contribution(df.limit(0)).first()) == (0.0, 0.0, 0.0, 0, 0.0)
