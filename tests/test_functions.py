"""Scalar functions on small cases, nulls and blanks among them."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from stratakb.functions import dates
from stratakb.functions import text as T


def values(spark, column, rows, schema="x string"):
    df = spark.createDataFrame([(r,) for r in rows], schema)
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_body_hash_ignores_line_ends(spark):
    got = values(spark, T.body_sha256, ["a\r\nb\n", "a\nb", "\n\na\rb", None, ""])
    want = hashlib.sha256(b"a\nb").hexdigest()
    assert got == [want, want, want, None, hashlib.sha256(b"").hexdigest()]


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("https://www.a.example/x/?q=1#f", "a.example/x"),
        ("http://A.example/x/index.html", "a.example/x"),
        ("a.example/x", "a.example/x"),
        ("  ", None),
        (None, None),
    ],
)
def test_url_key(spark, url, key):
    assert values(spark, T.url_key, [url]) == [key]


def test_url_slug_and_host(spark):
    assert values(spark, T.url_slug, ["https://a.b:80/X_y/z?q", None, "://"]) == ["a-b-80-x_y-z", "unknown", "unknown"]
    assert values(spark, T.url_slug, ["https://h.example/" + "a" * 300])[0] == ("h-example-" + "a" * 300)[:100]
    assert values(spark, T.url_host, ["https://me@www.a.b:80/x", "nohost", None]) == ["a.b", None, None]


def test_urls_in_text(spark):
    got = values(spark, T.urls_in, ["see https://a.example/x. and (https://b.example/y) https://a.example/x!", "none", None])
    assert got == [["https://a.example/x", "https://b.example/y"], [], None]


def test_routes(spark):
    assert values(spark, T.url_kind, ["https://github.com/a/b", "https://arxiv.org/abs/2401.00001v2", "https://x.example/rfc9110", "https://x.example/a.pdf", "ftp://x", None]) == ["github", "arxiv", "rfc", "file", None, None]
    assert values(spark, T.arxiv_pdf, ["https://arxiv.org/abs/2401.00001v2", "https://x.example"]) == ["https://arxiv.org/pdf/2401.00001v2", None]
    row = values(spark, T.github_parts, ["https://github.com/o/r.git/blob/main/a/b.md"])[0]
    assert (row.kind, row.owner, row.repo, row.branch, row.path) == ("blob", "o", "r", "main", "a/b.md")


def test_headings_and_paragraphs(spark):
    text = "intro line\nmore\n\n## Title here  \nbody"
    assert values(spark, T.first_heading, [text, "none", None]) == ["Title here", None, None]
    assert values(spark, T.first_paragraph, [text, "# only\n\n second  one", ""]) == ["intro line more", "second one", None]


@pytest.mark.parametrize("n", range(0, 12))
def test_truncate_keeps_whole_characters(spark, n):
    text = "aé漢😀z"
    want = text.encode()[:n].decode("utf-8", "ignore")
    assert values(spark, lambda c: T.truncate_utf8(c, n), [text]) == [want]


def test_classifiers(spark):
    assert values(spark, T.scenario, ["How to install it", "What is a cache", "", None, "最近怎么报错", "a vs b", "最新版本", "参数"]) == ["howto", "definition", "general", "general", "troubleshoot", "compare", "update", "config"]
    assert values(spark, T.question_dimensions, ["How to compare v2 with v1?", "x", None, "又叫什么"]) == [["action", "comparison", "version"], ["direct"], ["direct"], ["alias"]]


def test_lists(spark):
    assert values(spark, T.json_list, ['["a", " ", "b "]', "[broken", None]) == [["a", "b"], [], []]
    assert values(spark, T.clean_list, [[" a", "", None], None], "x array<string>") == [["a"], []]


def test_markup(spark):
    page = "<p>a</p><script>x()</script><!-- c --><link rel='prefetch' href='y'><SVG>d</SVG>b"
    assert values(spark, T.strip_markup, [page]) == ["<p>a</p>b"]


def test_dates(spark):
    rows = ["2024-05-06", "2024/05/06", "06.05.2024", "20240506", "2024-05-06T01:02:03Z", "2024-13-40", "unknown", "", None]
    day = dt.date(2024, 5, 6)
    assert values(spark, dates.lenient_date, rows) == [day] * 5 + [None] * 4
    assert values(spark, dates.date_in_id, ["a-2024-05-06", "a-2024-05-06-0123abcd", "a"]) == [day, day, None]
    assert values(spark, lambda c: dates.age_days(dates.lenient_date(c), "2024-05-10"), ["2024-05-06", "2025-01-01", None]) == [4, 0, None]
    assert values(spark, dates.source_type, [" Official_Doc", "N/A", "", None]) == ["official-doc", None, None, None]


def test_tiers(spark):
    rows = [("official-doc", 90), ("official-doc", 91), ("official-doc", 181), ("extracted", 180), ("community", 1), (None, None), ("official-doc", None), ("user-upload", 400), ("community", 90), ("community", 91)]
    df = spark.createDataFrame(rows, "k string, a int")
    got = df.select(dates.trust_tier(F.col("k"), F.col("a")).alias("t"), dates.source_priority(F.col("k"), F.col("a")).alias("p")).collect()
    assert [(r.t, r.p) for r in got] == [(1, "P0"), (2, "P1"), (3, "P1"), (2, "P3"), (3, "P2"), (3, "P3"), (3, "P1"), (3, "P1"), (3, "P2"), (3, "P3")]


def test_model_output_and_frontmatter(spark):
    assert values(spark, T.json_block, ['text ```json\n{"a": {"b": 1}}\n``` end', "none", None]) == ['{"a": {"b": 1}}', None, None]
    df = spark.createDataFrame([("d-1", 'A "b": c\nd', None, " ")], "i string, t string, n string, e string")
    block = df.select(T.frontmatter_of({"doc_id": F.col("i"), "title": F.col("t"), "none": F.col("n"), "empty": F.col("e")})).first()[0]
    assert block == '---\ndoc_id: d-1\ntitle: "A \\"b\\": c\\nd"\n---\n'
    assert values(spark, T.normal_text, ["﻿a\r\nb\rc", None]) == ["a\nb\nc", None]


def test_titles_slugs_and_links(spark):
    df = spark.createDataFrame([("a\r\n#  Head \nb", "My Notes (v2).pdf", "https://x.org/RFC_2616.html", "https://gitlab.example.com/a/b/-/blob/main/x.md", "![a](./p.png) ![b](https://h/q.png)"), (None, "...", "https://x.org/", None, None), (" \n first line", None, None, "https://h/x", "")], "t string, n string, u string, g string, m string")
    got = [tuple(r) for r in df.select(T.title_of(F.col("t")), T.file_slug(F.col("n")), T.rfc_number(F.col("u")), T.gitlab_raw(F.col("g")), T.image_links(F.col("m"), "img")).collect()]
    assert got == [("Head", "my-notes-v2", 2616, "https://gitlab.example.com/a/b/-/raw/main/x.md", "![a](img/p.png) ![b](https://h/q.png)"), (None, "untitled", None, None, None), ("first line", "untitled", None, None, "")]


def test_meta_lists_and_vectors(spark):
    page = '<meta name="author" content="A"><META content=\'B\' name="author"><meta name="other" content="C">'
    df = spark.createDataFrame([(page, '["a", " b "]', [("x", 1.0), ("x", 2.0), ("y", 0.0), (None, 1.0), ("z", 2.0), ("z", 2.0)], 140.0, " ", "text"), (None, None, None, None, "ab", None)], "p string, j string, v array<struct<token:string, weight:double>>, s double, h string, t string")
    r = df.select(T.meta_contents(F.col("p"), "author").alias("m"), T.strict_list(F.col("j")).alias("l"), T.sparse_vector(F.col("v")).alias("v"), T.evidence_score(F.col("s")).alias("s"), T.evidence_hash(F.col("h"), F.col("t")).alias("h")).collect()
    assert r[0].m == ["A", "B"] and r[0].l == ["a", " b "] and r[0].v == {"x": 2.0, "z": 2.0} and r[0].s == 100.0 and len(r[0].h) == 64
    assert r[1].m is None and r[1].l is None and r[1].v is None and r[1].s == 0.0 and r[1].h == "ab"
    with pytest.raises(Exception, match="not a JSON list"):
        spark.createDataFrame([("{",)], "j string").select(T.strict_list(F.col("j"))).collect()


def test_missing_dimensions_and_enrichment(spark):
    df = spark.createDataFrame([(["什么是缓存", "how to install"], "s", ["k"]), (None, "", None), ([], "s", ["k"])], "q array<string>, s string, k array<string>")
    got = [(r.m, r.n) for r in df.select(T.missing_dimensions(F.col("q")).alias("m"), T.needs_enrichment(F.col("s"), F.col("k"), F.col("q")).alias("n")).collect()]
    every = ["direct", "action", "comparison", "fault", "alias", "version"]
    assert got == [(["comparison", "fault", "alias", "version"], False), (every, True), (every, True)]
