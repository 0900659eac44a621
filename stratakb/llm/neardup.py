"""Near-duplicate texts: pigeonhole blocks over fingerprints, Hamming check, exact similarity, groups.

The fingerprint of a text is a row of min-hash symbols over its shingle set: two texts with Jaccard
similarity J differ in about 1 - J of the symbols. It is split into blocks of `width` symbols; texts
that differ in fewer symbols than there are blocks must agree in a block, and texts with J at the
threshold miss all blocks with a probability of (1 - J^width)^blocks (0.7 % for the defaults at 0.6,
0.08 % at 0.65). Blocks are the join keys; pairs are verified by the Hamming distance of one bit a
symbol, then by the exact similarity of the shingle sets.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratakb.operators.graph import connected_components
from stratakb.session import cut

#: A CJK ideograph, or a run of other letters and digits (\w without the underscore is categories L and N).
TOKEN = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
HOT = 2_000


class _Hashes(dict):
    """Token to 64-bit hash; emptied when it holds a million tokens."""

    def __missing__(self, token: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[token] = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"))
        return h


_hashes = _Hashes()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(text: str | None, size: int, least: int) -> np.ndarray | None:
    """Sorted distinct hashes of runs of `size` tokens, or None under `least` tokens."""
    if not text:
        return None
    tokens = TOKEN.findall(text.lower())
    if len(tokens) < max(least, size):
        return None
    h = np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def _fingerprint(batches: Iterator[pd.DataFrame], size: int, least: int, blocks: int, width: int) -> Iterator[pd.DataFrame]:
    rng = np.random.default_rng(31)
    k = blocks * width
    odd, add = rng.integers(0, 2**32, k, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, k, dtype=np.uint32)
    lift = rng.integers(1, 2**63, (blocks, width), dtype=np.uint64) | np.uint64(1)
    salt = rng.integers(1, 2**63, blocks, dtype=np.uint64)
    for frame in batches:
        ids, sets = [], []
        for rid, text in zip(frame["id"], frame["text"]):
            s = shingles(text, size, least)
            if s is not None:
                ids.append(rid)
                sets.append(s)
        for i in range(0, len(ids), 256):  # small enough to stay in the cache
            part = sets[i : i + 256]
            start = np.cumsum([0] + [len(s) for s in part[:-1]])
            both = np.concatenate(part)
            x, y = (both >> np.uint64(32)).astype(np.uint32), both.astype(np.uint32)
            sig = np.empty((len(part), k), np.uint32)
            for j in range(k):
                h = x * odd[j] + (y ^ add[j])
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x85EBCA6B)
                sig[:, j] = np.minimum.reduceat(h, start)
            with np.errstate(over="ignore"):
                block = _mix((sig.reshape(len(part), blocks, width).astype(np.uint64) * lift).sum(2) + salt)
            bits = np.packbits((sig[:, :128] >> np.uint32(7)) & np.uint32(1), axis=1).view(np.uint64)
            yield pd.DataFrame(
                {
                    "id": ids[i : i + 256],
                    "cls": np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in part], np.uint64).view(np.int64),
                    "s0": bits[:, 0].view(np.int64),
                    "s1": bits[:, 1].view(np.int64),
                    "blocks": list(block.view(np.int64)),
                }
            )


def bucket_pairs(prints: DataFrame, sketch: list[str], near: Callable[[str, str], Column]) -> DataFrame:
    """Distinct pairs (lo, hi) of classes that share a block and whose sketches are near.

    prints has cls, blocks and the sketch columns; near(a, b) is the condition on the aliases a and b.
    Copies of a class are folded while blocks are counted; a block of two classes is a pair at once, and
    the members of a larger one meet in salted parts, so that none is too large for a task.
    """
    rows = prints.select("cls", F.explode("blocks").alias("block"))
    buckets = rows.groupBy("block").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    buckets = cut(buckets, "buckets")
    sketches = prints.select("cls", *sketch).distinct()
    two = buckets.where("n = 2").select("lo", "hi").distinct()
    two = two.join(sketches.alias("a"), F.col("lo") == F.col("a.cls")).join(sketches.alias("b"), F.col("hi") == F.col("b.cls")).where(near("a", "b")).select("lo", "hi")
    more = buckets.where("n > 2").select("block", F.ceil(F.col("n") / HOT).cast("int").alias("parts"))
    full = prints.select("cls", *sketch, F.explode("blocks").alias("block")).join(more, "block").distinct()
    left = full.withColumn("part", F.pmod(F.hash("cls"), "parts"))
    right = full.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    many = left.alias("a").join(right.alias("b"), (F.col("a.block") == F.col("b.block")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.cls") < F.col("b.cls")) & near("a", "b"))
    many = many.select(F.col("a.cls").alias("lo"), F.col("b.cls").alias("hi"))
    return cut(two.unionByName(many).distinct(), "candidates")


def similar_classes(df: DataFrame, threshold: float = 0.8, size: int = 5, least: int = 5, blocks: int = 36, width: int = 4, hamming: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs of text classes with a similarity of threshold or more, and the members of the classes.

    df has (id string, text string). Returns pairs (lo, hi, sim) and members (id, cls): texts with the
    same shingle set share a class, so copies cost no pairs; no link between different texts is lost to
    a cap. Texts with fewer than `least` tokens (null and empty ones too) are in no class. Rows that
    repeat an id with one text count once; rows that repeat an id with several texts are in several
    classes. An empty table gives two empty tables.
    """
    if blocks * width < 128:
        raise ValueError("the fingerprint needs at least 128 symbols")
    if hamming is None:  # expected (1 - J) / 2 of 128 bits, and four standard deviations
        p = (1 - threshold) / 2
        hamming = int(128 * p + 4.2 * (128 * p * (1 - p)) ** 0.5) + 1
    df = df.select(F.col("id"), F.col("text")).where("id is not null and text is not null")
    prints = cut(df.mapInPandas(lambda b: _fingerprint(b, size, least, blocks, width), "id string, cls long, s0 long, s1 long, blocks array<long>"), "prints")
    far = lambda a, b: F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))) + F.bit_count(F.col(f"{a}.s1").bitwiseXOR(F.col(f"{b}.s1")))
    pairs = bucket_pairs(prints.select("cls", "s0", "s1", "blocks"), ["s0", "s1"], lambda a, b: far(a, b) <= hamming)

    wanted = pairs.select(F.explode(F.array("lo", "hi")).alias("cls")).distinct()
    named = prints.join(wanted, "cls").groupBy("cls").agg(F.min("id").alias("id"))
    texts = df.join(named.select("id").distinct(), "id", "left_semi")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            cls, packed = [], []
            for text in frame["text"]:
                s = shingles(text, size, least)
                if s is not None:
                    cls.append(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64))
                    packed.append(np.unique((s >> np.uint64(20)).astype(np.uint32)).tobytes())
            yield pd.DataFrame({"cls": np.array(cls, np.int64), "set": packed})

    bags = cut(texts.select("text").mapInPandas(sets, "cls long, set binary").dropDuplicates(["cls"]), "sets")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = []
            for a, b in zip(batch.column("x"), batch.column("y")):
                a, b = np.frombuffer(a.as_buffer(), np.uint32), np.frombuffer(b.as_buffer(), np.uint32)
                both = len(a) + len(b) - len(np.unique(np.concatenate((a, b))))
                sims.append(both / (len(a) + len(b) - both))
            yield pa.record_batch([batch.column("lo"), batch.column("hi"), pa.array(sims, pa.float64())], names=["lo", "hi", "sim"])

    full = pairs.join(bags.select(F.col("cls").alias("lo"), F.col("set").alias("x")), "lo").join(bags.select(F.col("cls").alias("hi"), F.col("set").alias("y")), "hi")
    found = full.select("lo", "hi", "x", "y").mapInArrow(verify, "lo long, hi long, sim double").where(F.col("sim") >= threshold)
    return cut(found, "pairs"), prints.select("id", "cls").distinct()


def similar_pairs(df: DataFrame, **options) -> DataFrame:
    """(id_a, id_b): every pair of different ids in similar or equal classes, the smaller id first."""
    pairs, members = similar_classes(df, **options)
    members = cut(members, "members")
    a, b = members.select(F.col("id").alias("p"), F.col("cls").alias("lo")), members.select(F.col("id").alias("q"), F.col("cls").alias("hi"))
    across = pairs.select("lo", "hi").join(a, "lo").join(b, "hi").select("p", "q")
    crowded = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    inside = members.join(crowded, "cls").select("cls", "id", F.ceil(F.col("n") / HOT).cast("int").alias("parts"))  # a large class meets itself in salted parts
    left = inside.withColumn("part", F.pmod(F.hash("id"), "parts"))
    right = inside.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    within = left.alias("a").join(right.alias("b"), (F.col("a.cls") == F.col("b.cls")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("p"), F.col("b.id").alias("q"))
    both = across.where("p <> q").unionByName(within)
    return both.select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b")).distinct()


def similar_groups(df: DataFrame, **options) -> DataFrame:
    """(id, group_id, links): one row per text in a group of two or more ids.

    group_id is the smallest id of the connected component; links counts the other ids it is linked to.
    """
    pairs, members = similar_classes(df, **options)
    members = cut(members, "members")
    comps = connected_components(pairs, "lo", "hi")
    of = members.join(comps.select(F.col("node").alias("cls"), F.col("component")), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    sizes = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n"))
    degree = pairs.select(F.col("lo").alias("cls"), F.col("hi").alias("other")).unionByName(pairs.select(F.col("hi").alias("cls"), F.col("lo").alias("other")))
    degree = degree.join(sizes.withColumnRenamed("cls", "other"), "other").groupBy("cls").agg(F.sum("n").alias("links"))
    names = of.groupBy("component").agg(F.min("id").alias("group_id"), F.count_distinct("id").alias("size")).where("size > 1")
    out = of.join(names, "component").join(sizes, "cls").join(degree, "cls", "left")
    return out.groupBy("id", "group_id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
