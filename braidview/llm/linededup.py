"""Line dedup over overlapping three-line windows.

The lines with a word are numbered in each document; every three in a row are a window, known by 128 bits of hash over the
trimmed lines. A window that occurs more than once anywhere keeps its first occurrence (smallest ``doc_id``, then smallest
text hash, then place; null ids last). All later occurrences are removed, and lines that several of them cover go once.

Defined cases. Null and empty texts, and texts of fewer than three lines with a word, lose nothing; a null text comes back empty.
Blank lines are never removed and never part a window. Repeated rows (one id, one text) are one document, so none of them is later than
another; rows with one id and unlike texts are told apart by the text. A document may lose all its lines; its row stays.
Only ``doc_id`` and ``text`` are read; all columns come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_key

SPAN = 3
_KEY = ("_none", "_id", "_k1", "_k2")
#: Up to so many documents with later windows, and so many of these (4 bytes each), are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_PLACES = 500_000, 5_000_000


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _own() -> list[Column]:
    return [F.col("doc_id").isNull().alias("_none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id")]


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(*_own(), *text_key(_text("text")), F.split(_text("text"), "\n").alias("_lines"))


def _worded() -> Column:
    """Places (from 1) of the lines with a word."""
    return F.filter(F.sequence(F.lit(1), F.size("_lines")), lambda i: F.get("_lines", i - 1).rlike(r"[^\x20\x09-\x0D]"))


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\n\x0b\x0c\r"))


def windows(documents: DataFrame) -> DataFrame:
    """``_none _id _k1 _k2 _at _w1 _w2``: the windows of every document, ``_at`` counting lines with a word."""
    lines = _keyed(documents).select(*_KEY, F.transform(F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")), _trimmed).alias("_t"))
    hashed = lines.where(F.size("_t") >= SPAN).select(
        *_KEY, F.transform("_t", lambda x: F.struct(F.xxhash64(F.lit(3), x).alias("a"), F.xxhash64(F.lit(5), x).alias("b"))).alias("_h")
    )

    def window(i: Column) -> Column:
        parts = [F.get("_h", i - 1 + j) for j in range(SPAN)]
        return F.struct(i.alias("at"), F.xxhash64(*[p["a"] for p in parts]).alias("w1"), F.xxhash64(F.lit(7), *[p["b"] for p in parts]).alias("w2"))

    rows = hashed.select(*_KEY, F.explode(F.transform(F.sequence(F.lit(1), F.size("_h") - (SPAN - 1)), window)).alias("_w"))
    return rows.select(*_KEY, F.col("_w.at").alias("_at"), F.col("_w.w1").alias("_w1"), F.col("_w.w2").alias("_w2"))


def later_windows(documents: DataFrame) -> DataFrame:
    """Per document that has any, the places of the windows that occurred before: ``_none _id _k1 _k2 _gone``."""
    rows = windows(documents)
    place = F.struct(*_KEY, "_at")
    # map-side combine leaves one row per window and task, however often a window occurs
    first = rows.groupBy("_w1", "_w2").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).where("_first < _last")
    later = rows.join(first.select("_w1", "_w2", "_first"), ["_w1", "_w2"]).where(place > F.col("_first"))
    return later.groupBy(*_KEY).agg(F.sort_array(F.collect_set("_at")).alias("_gone"))


def dedup_lines(documents: DataFrame) -> DataFrame:
    """``documents`` with ``text`` without the removed lines, and ``n_lines n_removed n_runs`` (in place of columns of these names)."""
    gone = stored(later_windows(documents), "gone")
    rows, places = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("_gone")), F.lit(0))).first()
    keyed = documents.select(F.struct("*").alias("_row"), *_own(), *text_key(_text("text")))
    # the text moves, once, only where the places are too many to be sent to it
    full = keyed.join(F.broadcast(gone) if rows <= BROADCAST_ROWS and places <= BROADCAST_PLACES else gone, list(_KEY), "left")
    split = full.select("_row", "_gone", _text("_row.text").alias("_text"), F.split(_text("_row.text"), "\n").alias("_lines"))
    places_of = lambda worded: F.array_distinct(F.flatten(F.transform("_gone", lambda i: F.slice(worded, i, SPAN))))
    cut = F.get(F.transform(F.array(_worded()), places_of), F.lit(0))  # so the worded lines are found once
    placed = split.select("_row", "_text", "_lines", F.when(F.col("_gone").isNotNull(), cut).alias("_cut"))
    left = F.transform(F.array_except(F.sequence(F.lit(1), F.size("_lines")), "_cut"), lambda i: F.get("_lines", i - 1))
    runs = F.size(F.array_except("_cut", F.transform("_cut", lambda p: p + 1)))
    made = {
        "n_lines": F.size("_lines").cast("long"), "n_removed": F.when(F.col("_cut").isNull(), F.lit(0)).otherwise(F.size("_cut")).cast("long"),
        "n_runs": F.when(F.col("_cut").isNull(), F.lit(0)).otherwise(runs).cast("long"),
    }
    text = F.when(F.col("_cut").isNull(), F.col("_text")).otherwise(F.array_join(left, "\n")).alias("text")
    return placed.select(
        *[text if c == "text" else F.col("_row").getField(c).alias(c) for c in documents.columns if c not in made], *[v.alias(k) for k, v in made.items()]
    )


def query(documents: DataFrame) -> DataFrame:
    """op2, a row per document: what was removed, the text that is left and its SHA-256."""
    out = dedup_lines(documents.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "n_runs", F.sha2("text", 256).alias("kept_sha256"), "text")
