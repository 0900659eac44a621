"""Markdown with frontmatter, JSON chunk files, JSON-lines logs and HTML as DataFrames."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakb.functions import text as T

CHUNK_SCHEMA = "doc_id string, chunk_id string, title string, source string, url string, summary string, content string, _broken string"
REQUIRED = ("doc_id", "chunk_id", "content")
#: Which converter takes a file, by extension.
BACKENDS = {
    "document": "pdf docx pptx xlsx png jpg jpeg",
    "html": "html htm",
    "markdown": "md markdown",
    "text": "txt text log rst",
    "tex": "tex",
    "code": "py js ts jsx tsx java kt scala go rs c h cpp hpp cs rb php swift sh bash sql r lua pl hs ml ex erl clj dart m mm jl yaml yml toml ini json xml css scss",
}


def frontmatter(text: Column) -> Column:
    """Map of the `key: value` lines between the fences at the start of a Markdown text; null without fences."""
    block = F.regexp_extract(F.replace(text, F.lit("\r"), F.lit("")), r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)", 1)
    keys = F.regexp_extract_all(block, F.lit(r"(?m)^([A-Za-z_][\w-]*)[ \t]*:"), F.lit(1))
    values = F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^[A-Za-z_][\w-]*[ \t]*:[ \t]*(.*)$"), F.lit(1)), lambda v: F.regexp_replace(F.trim(v), r'^"(.*)"$', "$1"))
    # of a repeated key the last line counts
    pairs = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.when(block != "", F.map_from_entries(last))


def body(text: Column) -> Column:
    """A Markdown text without its frontmatter."""
    return F.regexp_replace(text, r"(?s)\A---[ \t]*\r?\n.*?\n---[ \t]*(?:\r?\n|\z)", "")


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, meta, body, modified) of the *.md files under a folder; doc_id is the file's stem."""
    rows = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).text(path, wholetext=True)
    named = rows.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "").alias("doc_id"), F.col("value"), F.col("_metadata.file_modification_time").alias("modified"))
    return named.select("doc_id", frontmatter(F.col("value")).alias("meta"), body(F.col("value")).alias("body"), "modified")


def chunk_record(meta: Column, text: Column) -> Column:
    """struct of a chunk file: title falls back to the first heading, summary to the first paragraph; null without ids."""
    get = lambda k: F.nullif(F.trim(F.try_element_at(meta, F.lit(k))), F.lit(""))
    row = F.struct(
        get("doc_id").alias("doc_id"),
        get("chunk_id").alias("chunk_id"),
        F.coalesce(get("title"), T.first_heading(text)).alias("title"),
        F.coalesce(get("summary"), T.first_paragraph(text)).alias("summary"),
        T.json_list(get("questions")).alias("questions"),
        T.json_list(get("keywords")).alias("keywords"),
    )
    return F.when(get("doc_id").isNotNull() & get("chunk_id").isNotNull(), row)


def read_chunks_json(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Chunks of a JSON array (multiline) or of JSON lines with `valid`: false for broken or incomplete rows."""
    rows = spark.read.schema(CHUNK_SCHEMA).option("columnNameOfCorruptRecord", "_broken").option("multiLine", multiline).json(path)
    complete = F.col("_broken").isNull()
    for name in REQUIRED:
        complete = complete & F.col(name).isNotNull()
    return rows.withColumn("valid", complete)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON-lines log; blank and broken lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_log(rows: DataFrame, folder: str) -> None:
    """Append rows to a JSON-lines log; nulls are left out of the line."""
    rows.write.mode("append").json(folder)


QUESTION_INDEX = "chunk_id string, questions array<string>"


def write_question_index(rows: DataFrame, folder: str) -> str:
    """Store (chunk_id, questions) as JSON lines; the folder is returned."""
    rows.where("chunk_id is not null").select("chunk_id", "questions").write.mode("overwrite").json(folder)
    return folder


def read_question_index(spark: SparkSession, folder: str) -> DataFrame:
    """(chunk_id, questions) of a stored index; broken lines are skipped."""
    return spark.read.schema(QUESTION_INDEX).option("mode", "DROPMALFORMED").json(folder)


def upsert_questions(index: DataFrame, new: DataFrame) -> DataFrame:
    """The index with the entries of new added or put in place of those of the same chunk."""
    return index.join(new.select("chunk_id"), "chunk_id", "left_anti").unionByName(new.select("chunk_id", "questions"))


def override_questions(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """chunks whose questions are those of the index where it has the chunk."""
    held = index.select("chunk_id", F.col("questions").alias("_indexed"))
    return chunks.join(held, "chunk_id", "left").withColumn("questions", F.coalesce("_indexed", "questions")).drop("_indexed")


def backend(path: Column) -> Column:
    """The converter for a file name; null for unknown extensions."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for kind, names in BACKENDS.items() for name in names.split() for x in (name, kind)])
    return F.try_element_at(table, extension)


class _Markdown(HTMLParser):
    """Collects Markdown from the events of the standard parser."""

    SKIP = {"script", "style", "noscript", "svg", "iframe", "nav", "footer", "aside", "form", "template"}
    BLOCK = {"p", "div", "section", "article", "main", "ul", "ol", "table", "blockquote", "figure", "header"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.pre = False
        self.lists: list[list] = []
        self.href: list[str] = []
        self.cells: list[str] | None = None
        self.header = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skip += 1
        if self.skip:
            return
        if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in self.BLOCK:
            self.out.append("\n\n")
            if tag in ("ul", "ol"):
                self.lists.append([tag, 0])
        elif tag == "br":
            self.out.append("\n")
        elif tag == "li":
            kind = self.lists[-1] if self.lists else ["ul", 0]
            kind[1] += 1
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + (f"{kind[1]}. " if kind[0] == "ol" else "- "))
        elif tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "pre":
            self.pre = True
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a":
            self.href.append(dict(attrs).get("href") or "")
            self.out.append("[")
        elif tag == "tr":
            self.cells, self.header = [], False
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append("")
            self.header |= tag == "th"

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if tag in ("strong", "b"):
            self.out.append("**")
        elif tag in ("em", "i"):
            self.out.append("*")
        elif tag == "pre":
            self.pre = False
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "a" and self.href:
            self.out.append(f"]({self.href.pop()})")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.out.append("\n")
        elif tag == "tr" and self.cells is not None:
            self.out.append("\n| " + " | ".join(c.strip() for c in self.cells) + " |")
            if self.header:
                self.out.append("\n|" + "---|" * len(self.cells))
            self.cells = None

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        text = data if self.pre else re.sub(r"\s+", " ", data)
        if not self.pre and (not self.out or self.out[-1].endswith("\n")):
            text = text.lstrip()
        if self.cells:
            self.cells[-1] += text
        elif self.cells is None:
            self.out.append(text)


def to_markdown(page: str | None) -> str | None:
    """Markdown of an HTML page; null stays null."""
    if page is None:
        return None
    parser = _Markdown()
    parser.feed(page)
    parser.close()
    lines = [x.rstrip() for x in "".join(parser.out).split("\n")]
    out: list[str] = []
    for line in lines:
        if line or (out and out[-1]):
            out.append(line)
    return html.unescape("\n".join(out)).strip()


def html_to_markdown(df: DataFrame, page: str, to: str = "markdown") -> DataFrame:
    """df with the Markdown of an HTML column."""

    @F.pandas_udf("string")
    def convert(pages):  # noqa: ANN001, ANN202
        return pages.map(to_markdown, na_action="ignore")

    return df.withColumn(to, convert(F.col(page)))


def fenced(code: Column, language: Column) -> Column:
    """Source code as a fenced block; four backticks where the code has three."""
    fence = F.when(F.contains(code, F.lit("```")), "````").otherwise("```")
    return F.concat(fence, F.coalesce(language, F.lit("")), F.lit("\n"), F.regexp_replace(code, r"\n+\z", ""), F.lit("\n"), fence)
