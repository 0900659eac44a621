"""BPE against a second implementation, and packing."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratakb.llm import bpe, packing

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def other():
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


ODD = ["", " ", "\n\n \t", "<|endoftext|> x", "x" * 5000, "ab" * 3000, "你好" * 1500, "🙂👍🏽 👩‍💻", "don't I'LL 's", "\x1c\x85 a​b", "हिन्दी עברית", "   a", "1234567 ½²", "é", "　 x"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(other, text):
    assert bpe.encoder(bpe.VOCABULARY).encode(text) == other.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=st.characters(blacklist_categories=("Cs", "Cn"), max_codepoint=0xFFFF), max_size=200))
def test_round_trip(text):
    enc = bpe.encoder(bpe.VOCABULARY)
    assert b"".join(enc.bytes[i] for i in enc.encode(text)).decode() == text


@settings(max_examples=100, deadline=None)
@given(text=st.text(alphabet="abcdeth nrsi", max_size=400))
def test_merge_order(text):
    """The queue merges as a plain search for the lowest rank does."""
    enc = bpe.encoder(bpe.VOCABULARY)
    piece = text.encode()
    if not piece:
        return
    parts = [bytes([b]) for b in piece]
    while True:
        ranked = [(enc.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in enc.ranks]
        if not ranked:
            break
        _, i = min(ranked)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    assert enc.merge(piece) == [enc.ranks[p] for p in parts]


def test_column(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (3, "")]
    got = bpe.encode_column(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, len(r.ids)) for r in got) == [(1, 2), (2, 0), (3, 0), (3, 0)]


def test_rank_queue():
    q = bpe.RankQueue(300_000)
    rng = random.Random(1)
    ranks = [rng.randrange(300_000) for _ in range(500)]
    for i, r in enumerate(ranks):
        q.push(r, i)
    out = []
    while (top := q.pop()) is not None:
        out.append(top[0])
    assert out == sorted(set(ranks)) and not any(any(level) for level in q.levels)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=12))
def test_plan_places_every_item(counts):
    placed = dict.fromkeys(counts, 0)
    next_container = 0
    for first, times, filling in packing.plan(counts, 64):
        assert first == next_container and times > 0
        assert sum(n * c for n, c in filling.items()) <= 64
        next_container += times
        for n, c in filling.items():
            placed[n] += times * c
    assert placed == counts
    total = sum(n * c for n, c in counts.items())
    assert next_container <= 11 / 9 * -(-total // 64) + 6 or next_container <= sum(counts.values())


@pytest.mark.parametrize("bad", [{0: 1}, {65: 1}])
def test_plan_rejects(bad):
    with pytest.raises(ValueError, match="between"):
        packing.plan(bad, 64)


def test_packing(spark):
    rng = random.Random(3)
    sizes = [(i, rng.choice([7, 7, 7, 30, 64, rng.randrange(1, 64), 200])) for i in range(700)] + [(900, 0), (901, None)]
    df = spark.createDataFrame(sizes, "doc_id long, size int")
    rows = packing.pack(df, capacity=64, part_rows=20).collect()
    used, ranges = {}, {}
    for r in rows:
        used[r.container_id] = used.get(r.container_id, 0) + r.end - r.start
        ranges.setdefault(r.doc_id, []).append((r.start, r.end))
    assert max(used.values()) <= 64 and sorted(used) == list(range(len(used)))
    for i, n in sizes:
        if not n:
            assert i not in ranges
            continue
        got = sorted(ranges[i])
        assert got[0][0] == 0 and got[-1][1] == n and all(a[1] == b[0] for a, b in zip(got, got[1:]))
        assert len(got) == 1 or n > 64
    total = sum(n or 0 for _, n in sizes)
    assert len(used) <= -(-total // 64) * 1.02 + 1
    boxes = packing.containers(packing.pack(df, capacity=64, part_rows=20)).collect()
    assert {b.container_id: b.used for b in boxes} == used
    assert packing.pack(df.limit(0)).count() == 0
