"""Values cut off by field limits or broken transfers.

Per source and column, the histograms of lengths in characters and in bytes are tested for a spike at
the maximum: a length that is far more frequent than its neighbours and hardly ever exceeded. Values
at a spike length without terminal punctuation are cut. Elsewhere a value is cut if it ends with the
mark of a cut or a broken character, or if its last line is running prose that stops without
terminal punctuation; whether a single unfinished clause is prose or a noun phrase is decided by how
often values that open like it end with a stop, counted over the whole corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratakb.llm import lines as L
from stratakb.llm.residue import opens_with_residue
from stratakb.session import cut

#: A spike holds this many values and this many times the values of a usual length below it; at most this share is longer. Cuts may lose a broken character or trailing white space.
SPIKE_ROWS, SPIKE_RATIO, LONGER, SLACK = 8, 4.0, 0.02, 4
#: Share of values with an opening that end with a stop, from which an unfinished clause is prose.
PROSE, PROSE_AT_SPIKE = 0.5, 0.05
# Marks that fields and readers put where they cut.
MARK = re.compile(
    r"(?:\s*(?:…|\.\.\.|\[…\]|\[\.\.\.\]|\(…\)|\(\.\.\.\)|&hellip;|\[?\+?\d+ (?:more )?(?:chars?|characters|words)\]?|[\[(]?(?:\.\.\.|…)?\s*(?:read more|continue reading|show more|more|truncated|cut|continued|weiterlesen|mehr|lire la suite|suite|leer más|seguir leyendo|阅读全文|更多|展开(?:全文)?|未完待续|全文)\s*(?:\.\.\.|…|»|›|→)?[\])]|(?:read more|continue reading|weiterlesen|lire la suite|leer más|阅读全文)\s*(?:\.\.\.|…|»|›|→)?))+\s*$",
    re.I,
)
BROKEN = re.compile(r"(?:�+|&[a-z#]\w{0,6}|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|%[0-9A-F]?|<[a-z/!][^<>\n]{0,60}|\s*\[[^\[\]\n]{0,80}\]\([^()\s]{0,200})$")
STOP = re.compile(r"[.!?。！？؟।;；:：](?:['\"”’»)\]*_`]|</\w+>)*$")
UNSTOPPED = re.compile(r"(?:\b(?:version|versión|v)|从) ?\d+\.$", re.I)
SENTENCES = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*")


#: Articles and other short words that open a sentence in front of a capital without being part of a name.
DETERMINERS = frozenset("the a an this that these those each every all no one any some most our your its their his her my what which who why how when where if to in on for from with by as at of and or but not der die das ein eine einen einem einer diese dieser dieses jede jeder jedes alle kein keine wer was wie wo wann wenn im in am an auf aus bei für mit nach von vor zu zum zur und oder aber bitte le la les l un une des du de ce cette ces chaque tous toutes aucun si en dans sur pour par avec et ou mais el los las lo uno una unos unas este esta estos cada todo todos ningún si en con por para del al y o pero".split())


def opening(text: str) -> str:
    """What a clause opens with: its first word, or its first two characters in CJK; names (two words with capitals, or capitals inside) as one."""
    text = text.lstrip("*_#>-•→ \t\"'“«(")
    if L.CJK.match(text):
        return text[:2]
    words = text.split(None, 2)
    if not words:
        return ""
    first = words[0]
    if first.startswith("`"):
        return "`"
    low = first.lower().strip(",.:;")
    if re.search(r"[a-z][A-Z]", first) or (len(words) > 1 and first[0].isupper() and words[1][0].isupper() and low not in DETERMINERS):
        return "<name>"
    return low


def ending(text: str) -> tuple[str, str, str]:
    """(verdict, opening, last line): 'mark', 'open' (several sentences, the last unfinished), 'clause'
    (one unfinished clause, prose or not) or 'whole'."""
    value = text.rstrip()
    lines = value.split("\n")
    shape = L.shapes(lines)
    last = lines[-1].strip()
    if shape[-1] in ("code", "table", "heading"):
        return "whole", "", last
    marked = MARK.search(lines[-1]) or BROKEN.search(lines[-1])  # a mark stands at the end of the last line
    if marked and marked.start() + len(value) - len(lines[-1]) > 0:
        body = value[: len(value) - len(lines[-1]) + marked.start()].rstrip()
        line = body.split("\n")[-1].strip()
        kind = L.shapes([line])[0] if line else "blank"
        if kind == "table" or L.furniture_kind(last) is not None or opens_with_residue(value):
            return "whole", "", last
        if line and (kind not in ("item", "heading") or "�" in value[-3:]):
            return "mark", opening(SENTENCES.split(line)[-1]), last
    if shape[-1] == "item" and len(SENTENCES.split(L.ITEM.sub("", last))) < 2:
        return "whole", "", last
    open_tick = last.count("`") % 2 == 1
    if STOP.search(last) and not UNSTOPPED.search(last) and not open_tick:
        return "whole", opening(SENTENCES.split(lines[-1])[0]), last
    if L.furniture_kind(last) is not None or len(lines) - 1 in L.related_items(lines, shape):
        return "whole", "", last
    if opens_with_residue(value):
        return "whole", "", last
    sentences = SENTENCES.split(last)
    if len(sentences) > 1 and STOP.search(sentences[0]):
        return "open", opening(sentences[-1]), last
    return "clause", opening(last), last


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        out = []
        for chunk, source, summary, content in zip(frame["chunk_id"], frame["source"], frame["summary"], frame["content"]):
            for field, text in (("summary", summary), ("content", content)):
                if text and not text.isspace():
                    verdict, first, last = ending(text)
                    clause = verdict == "clause"
                    before = text.rstrip()[: -len(last)] if clause and last else ""
                    out.append((chunk, source, field, len(text), len(text.encode("utf-8", "replace")), verdict, first or None, _hash(last) if clause else None, _hash(before) if clause else None))
        frame = pd.DataFrame(out, columns=NAMES, dtype=object)
        yield frame.astype({"chars": "int32", "bytes": "int32", "last": "Int64", "before": "Int64"})


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


ENDS = "chunk_id string, source string, field string, chars int, bytes int, verdict string, opening string, last long, before long"
NAMES = [c.split()[0] for c in ENDS.split(", ")]


def value_ends(chunks: DataFrame) -> DataFrame:
    """How each non-blank summary and content ends, once per chunk_id and field."""
    rows = chunks.where("chunk_id is not null").select("chunk_id", F.coalesce("source", F.lit("")).alias("source"), "summary", "content")
    return cut(rows.mapInPandas(_ends, ENDS).dropDuplicates(["chunk_id", "field"]), "ends")


def spikes(ends: DataFrame) -> DataFrame:
    """(source, field, unit, length, n, longer, total): lengths at which a field limit cuts."""
    units = F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))
    unfinished = F.sum((F.col("verdict") != "whole").cast("long"))
    histogram = ends.select("source", "field", "verdict", F.explode(units).alias("u")).groupBy("source", "field", "u.unit", "u.length").agg(F.count(F.lit(1)).alias("n"), unfinished.alias("cut"))
    series = Window.partitionBy("source", "field", "unit").orderBy("length")
    below = F.coalesce(F.sum("n").over(series.rangeBetween(-60, -SLACK - 1)), F.lit(0)) / 55.0
    near = F.sum("n").over(series.rangeBetween(-SLACK, 0))
    near_cut = F.sum("cut").over(series.rangeBetween(-SLACK, 0))
    total = F.sum("n").over(Window.partitionBy("source", "field", "unit"))
    longer = F.coalesce(F.sum("n").over(series.rangeBetween(1, Window.unboundedFollowing)), F.lit(0))
    tested = histogram.select("source", "field", "unit", "length", "n", below.alias("usual"), near.alias("near"), near_cut.alias("near_cut"), longer.alias("longer"), total.alias("total"))
    high = (F.col("near") >= SPIKE_ROWS) & (F.col("near") >= SPIKE_RATIO * (SLACK + 1) * F.greatest("usual", F.lit(0.2))) & (F.col("longer") <= F.greatest(F.lit(3.0), LONGER * F.col("total")))
    return tested.where(high & (F.col("near_cut") * 2 >= F.col("near")) & (F.col("n") > 0)).select("source", "field", "unit", "length", "n", "longer", "total")


def truncated(chunks: DataFrame) -> DataFrame:
    """(chunk_id, field, at_limit): the values of summary and content that were cut.

    at_limit says that the length lies at a spike of its source and column, which then decides: there a
    value without a finished end is cut. Elsewhere the mark of a cut, an unfinished sentence behind
    others, or an unfinished clause that opens like prose decides. Null and blank values are none; rows
    repeated by a later ingest count once; a null source counts as a source of its own; an empty table
    gives an empty result.
    """
    return _judge(value_ends(chunks))


def _judge(ends: DataFrame) -> DataFrame:
    limit = spikes(ends).groupBy("source", "field").agg(F.max(F.when(F.col("unit") == "chars", F.col("length"))).alias("max_chars"), F.max(F.when(F.col("unit") == "bytes", F.col("length"))).alias("max_bytes"))
    at = lambda c, m: F.coalesce(F.col(c).between(F.col(m) - SLACK, F.col(m)), F.lit(False))
    rows = ends.where("verdict <> 'whole'").join(limit, ["source", "field"], "left").withColumn("at_limit", at("chars", "max_chars") | at("bytes", "max_bytes"))
    sure = rows.where("verdict <> 'clause'").select("chunk_id", "field", "at_limit")
    # single clauses: do values that open like them end with a stop, and is the clause a label that ends many different texts?
    stops = ends.where("opening is not null").groupBy("field", "opening").agg(F.avg((F.col("verdict") == "whole").cast("double")).alias("stops"))
    clauses = rows.where("verdict = 'clause'")
    label = clauses.groupBy("source", "field", "last").agg(F.count_distinct("before").alias("same"))
    clauses = clauses.where("opening is not null").join(stops, ["field", "opening"]).join(label, ["source", "field", "last"])
    prose = F.col("stops") >= F.when(F.col("at_limit"), F.lit(PROSE_AT_SPIKE)).otherwise(F.lit(PROSE))
    return sure.unionByName(clauses.where(prose & (F.col("at_limit") | (F.col("same") < 3))).select("chunk_id", "field", "at_limit"))


def source_rates(chunks: DataFrame) -> DataFrame:
    """(source, field, filled, cut, at_limit, share) per source and column; a null source is ''."""
    ends = value_ends(chunks)
    found = _judge(ends)
    rows = ends.join(found.withColumn("cut", F.lit(1)), ["chunk_id", "field"], "left")
    out = rows.groupBy("source", "field").agg(F.count(F.lit(1)).alias("filled"), F.count("cut").alias("cut"), F.sum(F.coalesce(F.col("at_limit"), F.lit(False)).cast("long")).alias("at_limit"))
    return out.withColumn("share", F.round(F.col("cut") / F.col("filled"), 6))
