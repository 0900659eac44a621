"""Splitting documents into chunks at headings, tables, paragraphs and sentences.

Lengths are code points. A text of at most `most` characters is one chunk. Longer ones are split at
headings of level 1 to 3 outside fenced code, short sections are joined with the next, long ones are
packed from table rows or from paragraphs, lines or sentences with an overlap, and a last pass joins
chunks that stayed short with the one before them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST, OVERLAP = 3500, 5000, 200
FRONTMATTER = re.compile(r"\A---[ \t]*\n.*?\n---[ \t]*(\n|\Z)", re.S)
SECTION = re.compile(r"#{1,3}\s")
RULE = re.compile(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$")
SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")


def outside_fences(lines: list[str]) -> list[bool]:
    """For each line whether it lies outside fenced code; the fences themselves lie inside."""
    out, inside = [], False
    for line in lines:
        fence = line.lstrip().startswith("```")
        out.append(not inside and not fence)
        inside ^= fence
    return out


def sections(text: str) -> list[str]:
    """Blocks that begin at headings of level 1 to 3."""
    lines = text.split("\n")
    blocks, current = [], []
    for line, free in zip(lines, outside_fences(lines)):
        if free and SECTION.match(line) and current:
            blocks.append("\n".join(current))
            current = []
        current.append(line)
    blocks.append("\n".join(current))
    return [b for b in (x.strip("\n") for x in blocks) if b.strip()]


def joined(blocks: list[str], least: int) -> list[str]:
    """A block that is still short takes in the next one."""
    out: list[str] = []
    for block in blocks:
        if out and len(out[-1]) < least:
            out[-1] += "\n\n" + block
        else:
            out.append(block)
    return out


def table_parts(block: str, most: int) -> list[str] | None:
    """Packs the rows of a table under its repeated header; None when the block has no regular table.

    Text before the table goes with the first part, text after it with the last.
    """
    lines = block.split("\n")
    at = [i for i, (x, free) in enumerate(zip(lines, outside_fences(lines))) if free and "|" in x]
    if len(at) < 3 or at[-1] - at[0] != len(at) - 1 or not RULE.match(lines[at[1]]):
        return None
    head = lines[at[0] : at[0] + 2]
    before, after = "\n".join(lines[: at[0]]).strip("\n"), "\n".join(lines[at[-1] + 1 :]).strip("\n")
    parts, rows = [], []
    room = most - sum(len(x) + 1 for x in head)
    for row in lines[at[0] + 2 : at[-1] + 1]:
        lead = len(before) + 1 if not parts and before else 0
        if rows and sum(len(x) + 1 for x in rows) + len(row) + lead > room:
            parts.append("\n".join(head + rows))
            rows = []
        rows.append(row)
    parts.append("\n".join(head + rows))
    if before:
        parts[0] = before + "\n" + parts[0]
    if after:
        parts[-1] += "\n" + after
    return parts


def pieces(block: str) -> list[str]:
    """Paragraphs, else lines (each with its line feed), else sentences."""
    for found in (re.split(r"\n[ \t]*\n", block), block.splitlines(keepends=True), SENTENCE.split(block)):
        found = [x for x in found if x.strip()]
        if len(found) > 1:
            return found
    return [block]


def packed(block: str, most: int, overlap: int) -> list[str]:
    """Fills parts up to `most`; each new part opens with the last `overlap` characters of the one before."""
    out, current = [], ""
    for piece in pieces(block):
        if len(piece) > most:
            if current:
                out.append(current)
                current = ""
            out.extend(piece[i : i + most] for i in range(0, max(1, len(piece) - overlap), most - overlap))
        elif current and len(current) + len(piece) > most:
            out.append(current)
            current = current[-overlap:] + piece if overlap else piece
        else:
            current += piece
    return out + [current] if current else out


def chunk(text: str | None, least: int = LEAST, most: int = MOST, overlap: int = OVERLAP) -> list[str]:
    """Chunks of a document; none for a null or blank one."""
    if not text:
        return []
    body = FRONTMATTER.sub("", text.replace("\r\n", "\n").replace("\r", "\n"), count=1).strip()
    if not body:
        return []
    if len(body) <= most:
        return [body]
    parts: list[str] = []
    for block in joined(sections(body), least):
        if len(block) <= most:
            parts.append(block)
            continue
        lines = block.split("\n")
        rows = sum("|" in x for x, free in zip(lines, outside_fences(lines)) if free and x.lstrip().startswith("|"))
        if rows >= 3:
            parts.extend(table_parts(block, most) or [block])
        else:
            parts.extend(packed(block, most, overlap))
    for i in range(len(parts) - 1, 0, -1):
        if len(parts[i]) < least:
            parts[i - 1] += "\n\n" + parts.pop(i)
    return parts


#: Fields that chunks inherit from their document.
INHERITED = ("source_type", "url", "fetched_at", "source", "title", "source_priority")


def chunk_rows(raw: DataFrame, text: str = "body", least: int = LEAST, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of documents as they are stored: ids, the inherited fields (null where blank), empty summary, keywords and questions, content.

    Fields that raw lacks are null; its doc_id must be unique.
    """
    parts = chunk_documents(raw, "doc_id", text, least, most, overlap)
    fields = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in INHERITED]
    none = F.array().cast("array<string>")
    out = parts.join(raw.select("doc_id", *fields), "doc_id", "left")
    return out.select("doc_id", "chunk_id", *INHERITED, F.lit("").alias("summary"), none.alias("keywords"), none.alias("questions"), "content")


def write_chunks(chunks: DataFrame, folder: str) -> None:
    """Store chunk rows, hashed by document into as many files as there are shuffle partitions: the chunks of a document lie together."""
    chunks.repartition("doc_id").sortWithinPartitions("doc_id", "chunk_id").write.mode("overwrite").parquet(folder)


def chunk_documents(df: DataFrame, key: str, text: str, least: int = LEAST, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_id, seq, content): chunks of every row, numbered from 1; the id is <key>-%03d.

    Rows with a null or blank text give none; repeated rows give repeated chunks.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [chunk(x, least, most, overlap) for x in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("key"), pa.array(parts, pa.list_(pa.string()))], names=["key", "parts"])

    split = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, parts array<string>")
    rows = split.select(F.col("key").alias(key), F.posexplode("parts").alias("pos", "content"))
    return rows.select(key, F.concat(F.col(key).cast("string"), F.lit("-"), F.lpad((F.col("pos") + 1).cast("string"), 3, "0")).alias("chunk_id"), (F.col("pos") + 1).alias("seq"), "content")
