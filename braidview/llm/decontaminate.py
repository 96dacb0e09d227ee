"""Benchmark decontamination by winnowing, with DataFrame functions only.

A document word is hit if it lies inside an occurrence of a benchmark window: ten consecutive words of
an item, or all words of an item that has fewer. Of every ten-word window, winnowing keeps the smallest
hash among its six five-word grams (the leftmost of equals). The choice depends on the window's words
alone, so a window shared by a document and an item leaves the same fingerprint at the same place in
both, and joining fingerprints finds every shared window. Hits are then extended over the words around
them; only extensions of at least ten equal words count.

Defined cases. Null and empty texts have no words and are clean. Items without words or without an
``item_id`` are ignored. Items with one ``item_id`` count once. Rows are identified by their text, so
repeated rows, repeated ids and null ids each get their own text's result. Other columns of either
table are not read, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_key

#: Anything but digits, a-z and what lies beyond ASCII separates words.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAKS_OF_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
GRAM = 5
#: At most so many distinct fingerprints (8 bytes each) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_FINGERPRINTS = 500_000
#: At most so many fingerprints, and first words of short items, are looked up in the texts themselves before anything else is made of these; beyond, that step is left out.
IN_PLACE = 20_000
#: Up to so many hit texts, and so many items of theirs, are broadcast; beyond, they are joined by a shuffle.
BROADCAST_HITS, BROADCAST_ITEMS = 500_000, 2_000_000


def match_words(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    ascii_ = F.octet_length(text) == F.char_length(text)  # there lower() changes A-Z alone, and is much the faster
    lowered = F.when(ascii_, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.filter(F.split(lowered, BREAKS), lambda w: w != F.lit(""))


def match_words_count(text: Column) -> Column:
    """The number of words, for which case is no matter: letters of both kinds are parts of words."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), BREAKS_OF_ANY_CASE), lambda w: w != F.lit(""))).cast("long")


def _positions(n: Column, last: Column) -> Column:
    """1, 2, ..., last; empty if there is none."""
    return F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))


def _hashed(df: DataFrame, text: str, *keep: str) -> DataFrame:
    words = df.select(*keep, match_words(F.col(text)).alias("_words"))
    return words.select(*keep, F.transform("_words", lambda w: F.xxhash64(w)).alias("_w")).select(*keep, "_w", F.size("_w").alias("_n"))


def _within(value: str, values: list[int]) -> str:
    return f"{value} IN ({', '.join(f'{v}L' for v in values)})" if values else "false"


def fingerprints(hashed: DataFrame, *keep: str, known: list[int] | None = None) -> DataFrame:
    """A row per fingerprint of each row's word hashes ``_w``: place ``_p`` (from 1), hash ``_h`` and the words around it.

    With ``known`` only rows that have one of these grams anywhere are winnowed: the others can't have it as a fingerprint.
    """
    # no filters on what is made here, nor explode(), which brings its own: Spark would push them down and work out the words twice
    around = WINDOW - GRAM
    grams = hashed.select(
        *keep, "_w", "_n",
        F.transform(_positions(F.col("_n"), F.col("_n") - GRAM + 1), lambda i: F.xxhash64(*[F.get("_w", i - 1 + j) for j in range(GRAM)])).alias("_g"),
    )
    span = WINDOW - GRAM + 1

    def least(i: Column) -> Column:
        piece = F.slice("_g", i, span)
        return i + F.array_position(piece, F.array_min(piece)).cast("int") - 1

    at = F.array_distinct(F.transform(_positions(F.col("_n"), F.col("_n") - WINDOW + 1), least))
    if known is not None:
        at = F.when(F.expr(f"exists(_g, g -> {_within('g', known)})"), at).otherwise(F.array().cast("array<int>"))
    chosen = grams.select(*keep, "_w", "_n", "_g", at.alias("_at"))

    def described(p: Column) -> Column:
        first = F.greatest(p - around, F.lit(1))
        return F.struct(
            p.alias("p"), F.get("_g", p - 1).alias("h"), first.alias("first"),
            F.slice("_w", first, p - first + GRAM + around).alias("around"),
        )

    rows = chosen.select(*keep, F.explode_outer(F.transform("_at", described)).alias("_f")).where("_f is not null")
    return rows.select(*keep, F.col("_f.p").alias("_p"), F.col("_f.h").alias("_h"), F.col("_f.first").alias("_first"), F.col("_f.around").alias("_around"))


def _equal_run(a: Column, b: Column, a_from: Column, b_from: Column, step: int) -> Column:
    """How many words agree from the given places (from 1) on, going by ``step``; at most ten less the gram."""
    run = F.lit(0)
    for k in reversed(range(WINDOW - GRAM)):
        x, y = F.get(a, a_from - 1 + step * k), F.get(b, b_from - 1 + step * k)
        run = F.when(x.isNotNull() & y.isNotNull() & (x == y), run + 1).otherwise(F.lit(0))
    return run


def _maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_FINGERPRINTS else df


def spans(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``_k1 _k2 item_id start end``: word ranges (from 1, both ends included) of texts inside benchmark windows; rows may overlap."""
    keys = ("_k1", "_k2")
    texts = _hashed(documents.select(*text_key(F.coalesce("text", F.lit(""))), "text"), "text", *keys)
    items = _hashed(benchmark.where(F.col("item_id").isNotNull()).select("item_id", "text"), "text", "item_id").where("_n > 0").distinct()

    theirs = fingerprints(items, "item_id").select("item_id", F.col("_p").alias("_ip"), "_h", F.col("_first").alias("_if"), F.col("_around").alias("_ia"))
    hashes = theirs.select("_h").distinct()
    known = hashes.count()
    values = [r["_h"] for r in hashes.collect()] if known <= IN_PLACE else None
    ours = fingerprints(texts, *keys, known=values).join(_maybe_broadcast(hashes, known), "_h", "left_semi").distinct()
    # few rows are left: those of texts that share a gram with an item
    paired = ours.join(theirs, "_h")
    at, item_at = F.col("_p") - F.col("_first") + 1, F.col("_ip") - F.col("_if") + 1
    left = _equal_run(F.col("_around"), F.col("_ia"), at - 1, item_at - 1, -1)
    right = _equal_run(F.col("_around"), F.col("_ia"), at + GRAM, item_at + GRAM, 1)
    found = paired.select(*keys, "item_id", "_p", _equal_gram(at, item_at).alias("_same"), left.alias("_l"), right.alias("_r"))
    long = found.where(F.col("_same") & (F.col("_l") + F.col("_r") + GRAM >= WINDOW)).select(
        *keys, "item_id", (F.col("_p") - F.col("_l")).alias("start"), (F.col("_p") + GRAM - 1 + F.col("_r")).alias("end")
    )

    short = items.where(F.col("_n") < WINDOW).select("item_id", F.col("_n").alias("_m"), F.xxhash64("_n", "_w").alias("_h"), F.get("_w", F.lit(0)).alias("_first"))
    lengths = sorted(r["_m"] for r in short.select("_m").distinct().collect())  # nine values at most
    if not lengths:
        return long
    first = short.select("_first").distinct()
    places = _positions(F.col("_n"), F.col("_n"))
    if first.count() <= IN_PLACE:  # most words begin no short item: they are left out before anything is made of them
        listed = [r["_first"] for r in first.collect()]
        places = F.when(F.col("_n") > 0, F.expr(f"filter(sequence(1, _n), i -> {_within('get(_w, i - 1)', listed)})")).otherwise(F.array().cast("array<int>"))

    def whole(i: Column) -> Column:
        made = [F.struct(i.alias("start"), (i + m - 1).alias("end"), F.xxhash64(F.lit(m), F.slice("_w", i, m)).alias("h")) for m in lengths]
        return F.filter(F.array(*made), lambda x: x["end"] <= F.col("_n"))

    pieces = texts.select(*keys, F.explode_outer(F.flatten(F.transform(places, whole))).alias("_f")).where("_f is not null")
    pieces = pieces.select(*keys, F.col("_f.start").alias("start"), F.col("_f.end").alias("end"), F.col("_f.h").alias("_h"))
    hashes = short.select("_h").distinct()
    few = pieces.join(_maybe_broadcast(hashes, hashes.count()), "_h", "left_semi").distinct()
    return long.unionByName(few.join(short, "_h").select(*keys, "item_id", "start", "end"))


def _equal_gram(at: Column, item_at: Column) -> Column:
    same = F.lit(True)
    for j in range(GRAM):
        same = same & (F.get("_around", at - 1 + j) == F.get("_ia", item_at - 1 + j))
    return same


def covered(ranges: Column) -> Column:
    """Words inside the union of an array of structs (start, end)."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))

    def add(acc: Column, x: Column) -> Column:
        grown = F.greatest(x["end"], acc["to"])
        fresh = F.greatest(grown - F.greatest(x["start"] - 1, acc["to"]), F.lit(0)).cast("long")
        return F.struct((acc["n"] + fresh).alias("n"), grown.alias("to"))

    return F.aggregate(F.array_sort(ranges), start, add, lambda acc: acc["n"])


def _sent(hits: DataFrame, items: Column) -> DataFrame:
    """What was found, written once, and broadcast if it is small enough."""
    found = stored(hits, "hits")
    n, many = found.agg(F.count("*"), F.coalesce(F.sum(items), F.lit(0))).first()
    return F.broadcast(found) if n <= BROADCAST_HITS and many <= BROADCAST_ITEMS else found


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` with ``n_words n_hit n_items items_sha256 contaminated`` (in place of columns of these names); every row stays."""
    hits = spans(documents, benchmark).groupBy("_k1", "_k2").agg(
        covered(F.collect_set(F.struct("start", "end"))).alias("n_hit"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("_items"),
    )
    hits = _sent(hits, F.size("_items"))
    text = F.coalesce("text", F.lit(""))
    counted = documents.select(F.struct("*").alias("_row"), *text_key(text), match_words_count(F.col("text")).alias("_n"))
    items = F.coalesce("_items", F.array().cast("array<string>"))
    made = {
        "n_words": F.col("_n"), "n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "n_items": F.size(items).cast("long"), "items_sha256": F.sha2(F.array_join(items, ","), 256),
        "contaminated": F.coalesce(F.col("n_hit") > 0, F.lit(False)),
    }
    old = [F.col("_row").getField(c).alias(c) for c in documents.columns if c not in made]
    return counted.join(hits, ["_k1", "_k2"], "left").select(*old, *[v.alias(k) for k, v in made.items()])


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents``, unchanged, that no benchmark window touches."""
    hit = _sent(spans(documents, benchmark).select("_k1", "_k2").distinct(), F.lit(0))
    keyed = documents.select(F.struct("*").alias("_row"), *text_key(F.coalesce("text", F.lit(""))))
    return keyed.join(hit, ["_k1", "_k2"], "left_anti").select("_row.*")


def query(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of op9, a row per document."""
    return contamination(documents.select("doc_id", "text"), benchmark).drop("text")
