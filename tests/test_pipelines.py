"""Pipelines and the plans they turn into."""

from stratakb.plans import pipelines
from stratakb.operators import retrieval


def test_ingest_takes_new_bodies_once(spark):
    rows = [("a", "x\r\n", 1), ("b", "x", 2), ("c", "known", 1), ("d", None, 1), (None, "z", 1), ("e", "y" * 30 + ". " + "w" * 30, 1), ("e", "old", 0)]
    raw = spark.createDataFrame(rows, "doc_id string, body string, stored_at int")
    stored = spark.createDataFrame([("known",), (None,)], "body string").selectExpr("sha2(body, 256) as content_sha256")
    got = pipelines.ingest(raw, stored, 10, 40, 5)
    assert sorted(r.doc_id for r in got.documents.collect()) == ["a", "e"]
    assert sorted(r.chunk_id for r in got.chunks.collect()) == ["a-001", "e-001", "e-002"]
    left = pipelines.remove({"chunks": got.chunks}, spark.createDataFrame([("e",)], "doc_id string"))
    assert [r.doc_id for r in left["chunks"].collect()] == ["a"]


def test_fused_search(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "q int, d string, rank int")
    b = spark.createDataFrame([(1, "y", 1)], "q int, d string, rank int")
    assert [r.d for r in pipelines.fused_search([a, b], "q", "d", 1).collect()] == ["y"]


def test_top_k_is_limited_before_the_shuffle(spark):
    scores = spark.range(1000).selectExpr("id % 10 as q", "id as d", "id * 1.5D as score")
    nodes = pipelines.operators(retrieval.top_ranked(scores, 3, "q", "d"))
    assert nodes["WindowGroupLimit"] >= 1 and not nodes["CartesianProduct"] and not nodes["BroadcastNestedLoopJoin"]
