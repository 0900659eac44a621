"""Near-duplicates against brute force."""

import random
import unicodedata

import numpy as np
from pyspark.sql import functions as F

from stratakb.llm import neardup

WORDS = [f"w{i}" for i in range(400)] + list("一二三四五六七八九十")


def texts(seed, n=120):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        base = [rng.choice(WORDS) for _ in range(rng.randrange(45, 160))]
        out.append(base)
        for _ in range(rng.randrange(3)):
            copy = list(base)
            for _ in range(rng.randrange(12)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            if rng.random() < 0.3:
                k = rng.randrange(len(copy))
                copy = copy[k:] + copy[:k]
            out.append(copy)
    return [(f"id{i:04d}", " ".join(t)) for i, t in enumerate(out)]


def brute(rows, threshold, size, least):
    sets = {}
    for i, t in rows:
        tokens = slow_tokens(t or "")
        if len(tokens) >= least:
            sets[i] = {tuple(tokens[k : k + size]) for k in range(len(tokens) - size + 1)}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def slow_tokens(text):
    out, run = [], ""
    for c in text.lower() + " ":
        if "一" <= c <= "鿿" or unicodedata.category(c)[0] not in "LN":
            if run:
                out.append(run)
            run = ""
            if "一" <= c <= "鿿":
                out.append(c)
        else:
            run += c
    return out


def test_tokens_follow_the_definition():
    odd = "Aé_b一二x3 ½²Ⅷ don't​źq ﬁ हिन्दी"
    assert neardup.TOKEN.findall(odd.lower()) == slow_tokens(odd)


def test_pairs_match_brute_force(spark):
    rows = texts(5) + [("n", None), ("e", ""), ("s", "too short")]
    rows += [rows[0], ("copy", rows[0][1]), ("upper", rows[0][1].upper())]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("cls", F.lit("clash"))
    want = brute(rows, 0.6, 3, 40)
    got = {(r.id_a, r.id_b) for r in neardup.similar_pairs(df, threshold=0.6, size=3, least=40).collect()}
    assert got <= want and len(got) >= 0.98 * len(want)


def test_hot_group_of_different_texts(spark):
    rng = random.Random(9)
    base = [rng.choice(WORDS) for _ in range(120)]
    rows = []
    for i in range(60):  # all like each other: their blocks are shared by all
        t = list(base)
        t[i * 2] = f"only{i}"
        rows.append((f"h{i:02d}", " ".join(t)))
    df = spark.createDataFrame(rows, "id string, text string")
    before, neardup.HOT = neardup.HOT, 7
    try:
        got = neardup.similar_pairs(df, threshold=0.6, size=3, least=40).count()
    finally:
        neardup.HOT = before
    assert got == len(brute(rows, 0.6, 3, 40)) == 60 * 59 // 2


def test_groups(spark):
    rows = texts(7, 40) + [("copy", texts(7, 40)[0][1])]
    pairs = brute(rows, 0.8, 5, 5)
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    group = {}
    for start in sorted(near):
        if start not in group:
            todo = [start]
            while todo:
                x = todo.pop()
                if x not in group:
                    group[x] = start
                    todo.extend(near[x])
    got = {r.id: (r.group_id, r.links) for r in neardup.similar_groups(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert got == {x: (g, len(near[x])) for x, g in group.items()}


def test_empty(spark):
    df = spark.createDataFrame([], "id string, text string")
    assert neardup.similar_pairs(df).count() == 0 and neardup.similar_groups(df).count() == 0


def test_long_text():
    s = neardup.shingles("word " * 200_000, 5, 5)
    assert isinstance(s, np.ndarray) and len(s) == 1


def test_a_large_class_meets_itself_in_parts(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", 4)
    text = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(f"k{i:02d}", text) for i in range(15)], "id string, text string")
    got = {(r.id_a, r.id_b) for r in neardup.similar_pairs(df, threshold=0.6, size=3, least=40).collect()}
    assert got == {(f"k{i:02d}", f"k{j:02d}") for i in range(15) for j in range(i + 1, 15)}
