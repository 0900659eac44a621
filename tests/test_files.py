"""Sources: Markdown, JSON, logs and HTML."""

import json

from pyspark.sql import functions as F

from stratakb.sources import files


def test_markdown_folder(spark, tmp_path):
    (tmp_path / "a.md").write_text('---\ntitle: "A --- b"\nurl: https://x.example/a\ntitle: Last\nquestions: ["q1", ""]\ndoc_id: d\nchunk_id: d-001\n---\n# Head\n\nfirst\nsecond\n')
    (tmp_path / "b.md").write_bytes(b"no fence\r\ntext")
    (tmp_path / "c.txt").write_text("other")
    rows = {r.doc_id: r for r in files.read_markdown(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a", "b"} and rows["b"].meta is None and rows["b"].body == "no fence\r\ntext"
    assert rows["a"].meta["title"] == "Last" and rows["a"].meta["url"] == "https://x.example/a"
    df = files.read_markdown(spark, str(tmp_path)).select(files.chunk_record(F.col("meta"), F.col("body")).alias("c"))
    kept = [r.c for r in df.collect() if r.c]
    assert len(kept) == 1 and kept[0].questions == ["q1"] and kept[0].summary == "first second"


def test_chunk_json(spark, tmp_path):
    good = {"doc_id": "d", "chunk_id": "c", "content": "x"}
    (tmp_path / "a.jsonl").write_text(json.dumps(good) + "\n{broken\n" + json.dumps({"doc_id": "d"}) + "\n")
    got = files.read_chunks_json(spark, str(tmp_path / "a.jsonl")).select("chunk_id", "valid").collect()
    assert sorted((r.chunk_id or "", r.valid) for r in got) == [("", False), ("", False), ("c", True)]
    (tmp_path / "b.json").write_text(json.dumps([good, good]))
    assert files.read_chunks_json(spark, str(tmp_path / "b.json"), multiline=True).where("valid").count() == 2


def test_log(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"ts": "1", "what": "a"}\n\n{oops\n{"ts": "2"}\n')
    assert [(r.ts, r.what) for r in files.read_log(spark, str(tmp_path / "l.jsonl"), "ts string, what string").orderBy("ts").collect()] == [("1", "a"), ("2", None)]


def test_backends(spark):
    df = spark.createDataFrame([("a.PDF",), ("b.html",), ("c.py",), ("d.unknown",), (None,)], "p string")
    assert [r[0] for r in df.select(files.backend(F.col("p"))).collect()] == ["document", "html", "code", None, None]


def test_html(spark):
    page = "<html><head><style>x</style></head><body><nav>menu</nav><main><h1>T &amp; U</h1><p>a <b>bold</b> <a href='u'>link</a></p><ol><li>one<li>two</ol><table><tr><th>h</th></tr><tr><td>v</td></tr></table><pre>x\n y</pre></main></body></html>"
    df = spark.createDataFrame([(page,), (None,), ("",)], "html string")
    got = [r.markdown for r in files.html_to_markdown(df, "html").collect()]
    assert got[1] is None and got[2] == ""
    for part in ("# T & U", "a **bold** [link](u)", "1. one", "2. two", "| h |\n|---|\n| v |", "```\nx\n y\n```"):
        assert part in got[0]
    assert "menu" not in got[0]


def test_fence(spark):
    df = spark.createDataFrame([("a\n", "py"), ("```\nb\n```", None)], "c string, l string")
    assert [r[0] for r in df.select(files.fenced(F.col("c"), F.col("l"))).collect()] == ["```py\na\n```", "````\n```\nb\n```\n````"]


def test_question_index_and_log(spark, tmp_path):
    rows = spark.createDataFrame([("a", ["x", "y"]), ("b", ["z"]), (None, ["n"])], "chunk_id string, questions array<string>")
    index = files.read_question_index(spark, files.write_question_index(rows, str(tmp_path / "index")))
    new = spark.createDataFrame([("b", ["w"]), ("c", [])], "chunk_id string, questions array<string>")
    merged = files.upsert_questions(index, new)
    assert {r.chunk_id: r.questions for r in merged.collect()} == {"a": ["x", "y"], "b": ["w"], "c": []}
    chunks = spark.createDataFrame([("a", ["old"]), ("d", None)], "chunk_id string, questions array<string>")
    assert {r.chunk_id: r.questions for r in files.override_questions(chunks, merged).collect()} == {"a": ["x", "y"], "d": None}
    for _ in range(2):
        files.append_log(spark.createDataFrame([("q", None), ("r", 2)], "id string, n int"), str(tmp_path / "log"))
    assert sorted((r.id, r.n or 0) for r in files.read_log(spark, str(tmp_path / "log"), "id string, n int").collect()) == [("q", 0), ("q", 0), ("r", 2), ("r", 2)]
