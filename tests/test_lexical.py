"""Lexical search on a grid of blocks against brute force, and the plans of the queries on it."""

import math
import random
import re

from pyspark.sql import functions as F

from stratakb.operators import retrieval
from stratakb.plans import pipelines
from stratakb.queries import fusion, search

WORDS = "cache index node shard 表 page rare".split()


def brute(docs, asked, k):
    """{(list, query): keys in order} by tf-idf and by overlap; a null key is last among equals."""
    tf, out = {}, {}
    for key, text in docs:
        for w in re.findall(r"[a-z0-9]{2,}|[一-鿿]", (text or "").lower()):
            held = tf.setdefault(key, {})
            held[w] = held.get(w, 0) + 1
    idf = {w: math.log1p(len(docs) / sum(w in held for held in tf.values())) for held in tf.values() for w in held}
    for q, text in asked:
        words = list(dict.fromkeys(re.findall(r"[a-z0-9]{2,}|[一-鿿]", (text or "").lower())))
        for n, weigh in enumerate((lambda held, w: held[w] * idf[w] * idf[w], lambda held, w: 1)):
            score = {key: round(sum(weigh(held, w) for w in words if w in held), 6) for key, held in tf.items() if any(w in held for w in words)}
            if score:
                out[n, q] = sorted(score, key=lambda key: (-score[key], key is None, key or ""))[:k]
    return out


def test_blocks_give_the_lists_of_brute_force(spark):
    rng = random.Random(7)
    docs = [(f"d{i:03}", " ".join(rng.choices(WORDS[:-1], k=rng.randint(0, 6)))) for i in range(120)]
    docs += [(None, "cache index"), ("d007", "rare cache"), ("é1", "cache"), ("blank", None)]
    asked = [(i, " ".join(rng.choices(WORDS, k=3))) for i in range(9)] + [(20, None), (21, "absent")]
    left, right = spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame(asked, "q long, question string")
    for k, sizes in ((5, {}), (5, {"block_rows": 7, "tile_rows": 2}), (500, {"block_rows": 30})):
        got = {}
        for r in retrieval.lexical_topk(left, right, "doc_id", "text", "q", "question", k, ("sparse", "overlap"), **sizes).orderBy("rank").collect():
            got.setdefault((r.list, r.q), []).append(r.doc_id)
        assert got == brute(docs, asked, k)
    assert retrieval.lexical_topk(left.limit(0), right, "doc_id", "text", "q", "question", 5).count() == 0
    assert retrieval.lexical_topk(left, right.limit(0), "doc_id", "text", "q", "question", 5).count() == 0


def plan_of(spark, tmp_path, query):
    rows = [(i, f"cache page {i}", "cache index page " * 3) for i in range(0, 400, 50)]
    spark.createDataFrame(rows, "doc_id long, title string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    return pipelines.operators(query(spark, str(tmp_path)))


def test_evidence_merge_shuffles_no_pairs(spark, tmp_path):
    """Pairs of a query and a document are made and ranked inside tasks, once for both lists."""
    assert plan_of(spark, tmp_path, search.evidence_merge)["FlatMapCoGroupsInArrow"] == 1


def test_hybrid_rrf_makes_both_lists_in_one_pass(spark, tmp_path):
    assert plan_of(spark, tmp_path, search.hybrid_rrf)["FlatMapCoGroupsInArrow"] == 1


def test_rounding_of_doubles_is_that_of_the_sql(spark):
    """0.031545 as a double lies below its decimal digits: times 1e5 it is under a half."""
    df = spark.createDataFrame([(0.031545,), (0.5,), (None,)], "x double")
    assert [r[0] for r in df.select(retrieval.rounded(F.col("x"), 5)).collect()] == [0.03154, 0.5, None]


def test_equal_vectors_are_cut_by_id(spark):
    """Scores that differ by less than the rounding are equal, so the smaller id stays also where a block is cut."""
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1e-12]), (3, [0.5, 0.0])], "id long, dense_vector array<double>")
    asked = spark.createDataFrame([(9, [1.0, 1.0])], "id long, dense_vector array<double>")
    assert [r.id for r in retrieval.dense_topk(df, asked, 1).collect()] == [1]


def test_hybrid_dense_sparse_shuffles_no_pairs(spark):
    """Vectors and texts both meet their queries in blocks."""
    assert pipelines.operators(fusion.hybrid_dense_sparse(spark, "/root/testdata/sf0.001"))["FlatMapCoGroupsInArrow"] == 2
