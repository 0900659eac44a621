"""Page furniture: differencing of pages that lie next to each other by URL path within a host.

Pages are range-sorted by host and path, so each task holds a run of neighbouring pages and a hot host
is spread over as many tasks as its size asks for. Every page is compared with the few before it: the
lines that both have are aligned by longest common subsequence, and aligned lines count as shared.
Pairs that share their article (copies under another URL) are not compared. Sharing decides:

* a label (a short line without a closing stop, or a row of short entries) that was ever shared belongs
  to the page, and so do the entries right below it (a list of related pages under its heading);
* prose and list items belong to the page if they were shared in most comparisons of their host, as
  notices and menus are and notes, steps and copied passages are not;
* only where that leaves a line open, its words decide (lines.furniture_kind), and they too need the
  line to have been shared somewhere.

Headings, code and tables stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratakb.llm import lines as L
from stratakb.session import cut

NEIGHBOURS = 6
#: Prose and items belong to the page if shared in this part of the comparisons of their host, over this many pages.
RATE, PAGES = 0.3, 4
#: Rows of a task that compares neighbouring pages.
TASK_ROWS = 20_000
DIGITS = re.compile(r"\d+")


def url_path(url: Column, fallback: Column) -> Column:
    """Path of a URL without scheme, www, query, fragment and closing slash; fallback where there is none."""
    path = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z]+://(www\.)?|[?#].*$", "")
    path = F.regexp_replace(path, r"(/index\.html?)?/*$", "")
    return F.when(F.length(F.trim(url)) > 0, path).otherwise(fallback)


def line_key(line: str, parts: list[str]) -> int:
    """What lines of other pages are compared by: digits as one, rows of entries by their first entry."""
    text = "menu " + L.bare(parts[0]) if parts else DIGITS.sub("0", L.bare(line))
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


class _Page:
    __slots__ = ("host", "doc", "rows", "keys", "prose", "shared", "compared", "blocks", "fixed")

    def __init__(self, host: str, doc: str):
        self.host, self.doc = host, doc
        self.rows: list[tuple[str, int, str, int, int | None, str]] = []  # chunk, line number, form, key, key of the label above, text
        self.keys: set[int] = set()
        self.prose: set[int] = set()
        self.compared = 0
        self.blocks: list[tuple[str, int]] = []  # chunk and number of the block of lines that each row is in
        self.fixed: set[tuple[str, int]] = set()  # blocks with a heading, code or a table

    def add(self, chunk: str, text: str) -> None:
        lines = text.split("\n")
        head, block = None, 0
        for i, (line, form) in enumerate(zip(lines, L.shapes(lines))):
            if form in ("blank", "code", "table", "heading"):
                head = None
                block += form == "blank"
                if form != "blank":
                    self.fixed.add((chunk, block))
                continue
            parts = L.entries(line) if form != "item" else []
            if form == "prose" and len(parts) > 2 and not L.END.search(line):
                form = "label"  # a long row of entries
            key = line_key(line, parts if form == "label" else [])
            if form == "prose":
                head = None
                if len(line) > 40:
                    self.prose.add(hash(line.strip()))
            self.rows.append((chunk, i + 1, form, key, head, line))
            self.blocks.append((chunk, block))
            if form == "label" and head is None:
                head = key
        self.keys.update(r[3] for r in self.rows)

    def align(self, other: _Page) -> None:
        if self.prose and other.prose:
            same = len(self.prose & other.prose)
            if same * 4 >= min(len(self.prose), len(other.prose)) and same >= 2:
                return  # the same article under two paths
        self.compared += 1
        other.compared += 1
        common = self.keys & other.keys
        if not common:
            return
        a = [i for i, r in enumerate(self.rows) if r[3] in common]
        b = [i for i, r in enumerate(other.rows) if r[3] in common]
        for i, j in longest_common([self.rows[i][3] for i in a], [other.rows[j][3] for j in b]):
            self.shared[a[i]] += 1
            other.shared[b[j]] += 1


    def frame(self) -> list[bool]:
        """Whether each row stands above or below the article in its chunk, in a block of lines without a line of the article."""
        of = set(self.fixed)
        for row, block, n in zip(self.rows, self.blocks, self.shared):
            if row[2] == "prose" and n < RATE * self.compared or row[2] == "prose" and not self.compared:
                of.add(block)
        first: dict[str, int] = {}
        last: dict[str, int] = {}
        for chunk, block in of:
            first[chunk] = min(first.get(chunk, block), block)
            last[chunk] = max(last.get(chunk, block), block)
        return [b < first.get(c, b + 1) or b > last.get(c, b) for c, b in self.blocks]


def longest_common(a: list, b: list) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence of a and b: the longest rising run through the matching positions."""
    where: dict = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    tails: list[int] = []  # the least last position of a run of each length
    ends: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            n = bisect_left(tails, j)
            step = (i, j, ends[n - 1] if n else None)
            tails[n : n + 1] = [j]
            ends[n : n + 1] = [step]
    out, step = [], ends[-1] if ends else None
    while step:
        out.append(step[:2])
        step = step[2]
    return out[::-1]


COLUMNS = "chunk_id string, line_no int, host string, form string, key long, head long, known boolean, frame boolean, shared int, compared int"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def _difference(batches: Iterator[pd.DataFrame], neighbours: int) -> Iterator[pd.DataFrame]:
    window: deque[_Page] = deque()
    out: list[tuple] = []
    page, last = None, None

    def leave(p: _Page) -> None:
        out.extend((c, n, p.host, form, key, head, L.furniture_kind(line) is not None, frame, s, p.compared) for (c, n, form, key, head, line), frame, s in zip(p.rows, p.frame(), p.shared))

    def frame_of(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=NAMES, dtype=object)
        return frame.astype({"line_no": "int32", "key": np.int64, "head": "Int64", "known": bool, "frame": bool, "shared": "int32", "compared": "int32"})

    def finish(p: _Page | None) -> None:
        if p is None:
            return
        p.shared = [0] * len(p.rows)
        for q in window:
            if q.host == p.host:
                p.align(q)
        window.append(p)
        if len(window) > neighbours:
            leave(window.popleft())

    for frame in batches:
        for host, doc, chunk, text in zip(frame["host"], frame["doc"], frame["chunk_id"], frame["text"]):
            if page is None or page.host != host or page.doc != doc:
                finish(page)
                page, last = _Page(host, doc), None
            if chunk != last:  # a chunk repeated by a later ingest counts once
                page.add(chunk, text)
            last = chunk
        if len(out) >= 20_000:
            yield frame_of(out)
            out.clear()
    finish(page)
    for p in window:
        leave(p)
    yield frame_of(out)


def judged_lines(chunks: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(chunk_id, line_no, way) of the lines that belong to the page; way is 'shared', 'below' or 'words'."""
    pages = chunks.where("chunk_id is not null and source is not null and source <> 'user-upload' and length(content) > 0")
    pages = pages.select(F.col("source").alias("host"), url_path(F.col("url"), F.col("doc_id")).alias("path"), F.coalesce("doc_id", "chunk_id").alias("doc"), "chunk_id", F.col("content").alias("text"))
    rows = chunks.select("chunk_id").where("chunk_id is not null").count()
    parts = max(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))
    ordered = pages.repartitionByRange(parts, "host", "path", "doc", "chunk_id").sortWithinPartitions("host", "path", "doc", "chunk_id")
    found = cut(ordered.select("host", "doc", "chunk_id", "text").mapInPandas(lambda b: _difference(b, neighbours), COLUMNS), "lines")
    host = found.groupBy("host", "key").agg(F.sum("shared").alias("hs"), F.sum("compared").alias("hc"), F.count(F.lit(1)).alias("hn"), F.max((F.col("form") == "label").cast("int")).alias("label"))
    host = host.where("hs > 0 or label = 1")
    seen = host.groupBy("key").agg(F.sum("hs").alias("ks")).where("ks > 0").select("key", F.lit(True).alias("seen"))  # shared on some host
    usual = (F.col("hs") >= RATE * F.greatest(F.col("hc"), F.lit(1))) & (F.col("hn") >= PAGES) & (F.col("hs") >= PAGES)
    judged = host.join(seen, "key").select("host", "key", "seen", usual.alias("usual"))
    open_ = found.where("form = 'label' or frame or known or head is not null")  # no other line can belong to the page
    own = open_.join(judged, ["host", "key"], "left")
    # without a label above there is nothing to look up: no key is shared by all such lines
    heads = judged.select("host", F.col("key").alias("above"), F.col("seen").alias("headed"))
    own = own.withColumn("above", F.coalesce("head", F.xxhash64("chunk_id", "line_no"))).join(heads, ["host", "above"], "left").withColumn("headed", F.col("headed") & F.col("head").isNotNull())
    way = (
        F.when((F.col("seen") & (F.col("form") == "label")) | (F.col("usual") & F.col("frame")), "shared")
        .when(F.col("headed") & F.col("form").isin("label", "item"), "below")
        .when(F.col("seen") & F.col("known"), "words")
    )
    return own.withColumn("way", way).where("way is not null").groupBy("chunk_id", "line_no").agg(F.min("way").alias("way"))


def furniture_lines(chunks: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(chunk_id, line_no) of the lines of content that belong to the page, numbered from 1.

    Only chunks with a host as source are pages; rows with a null chunk_id, source or content, and
    empty contents, give no line. Repeated rows of a chunk count once. An empty table gives no lines.
    At the edge of a task a page lacks the neighbours of the task before; tasks hold some 20,000 rows.
    """
    return judged_lines(chunks, neighbours).select("chunk_id", "line_no")


def without_lines(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """(chunk_id, content) of every chunk, without the lines in found; other contents stay as they are."""
    drop = found.groupBy("chunk_id").agg(F.collect_set("line_no").alias("gone"))
    once = chunks.select("chunk_id", "content").dropDuplicates(["chunk_id"])
    lines = F.filter(F.split("content", "\n"), lambda x, i: ~F.array_contains(F.col("gone"), i + 1))
    return once.join(drop, "chunk_id", "left").select("chunk_id", F.when(F.col("gone").isNull(), F.col("content")).otherwise(F.array_join(lines, "\n")).alias("content"))
