"""Quality rules and an importance score, with DataFrame functions only.

The score of a text is the mean, over its words and word pairs, of log p(bucket | trusted) / p(bucket | corpus):
both multinomials are over hashed buckets with add-one smoothing, the trusted one counted over texts labelled
``quality`` 1 and the other over every text. A trusted text is scored, for its own verdict and for the threshold, with counts
of the other trusted texts, so that texts which were learned from are judged as unseen ones are. The threshold is the score that best separates the
labelled texts (highest balanced accuracy; the lowest of equals), so it is the same in every run. Where no text is labelled 0, or none
is labelled 1, no text is rejected by score.

Texts are read, split and hashed once; their measures and buckets are written to the shared folder, and counts and scores are made
from there. Scores are written as well: the threshold and the verdicts read them, not the buckets, which are deleted then. Windows of
eight words are compared by 64 bits of hash, and only where four words in a row occur twice.

Defined cases. Null and empty texts have no words; the word rule rejects them. A ``doc_id`` with several labels counts as
the lowest of them; null labels and ids are ignored. Repeated rows are scored each. Only ``doc_id``, ``text`` and the two label
columns are read, whatever other columns are named.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, drop_stored, stored

BUCKETS = 1 << 14
WINDOW = 8
#: Score bins of the threshold search: width and the limit on either side.
BIN, BINS = 0.005, 1600
#: At most so many labelled ids are broadcast; beyond, they are joined by a shuffle.
BROADCAST_LABELS = 1_000_000


def _hashes(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _joined(hashes: str, apart: int, f: Callable[[Column, Column], Column] = F.xxhash64) -> Column:
    """``f`` (a hash) of every element and the one ``apart`` places later; null of null."""
    left = F.greatest(F.size(hashes) - apart, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, left), F.slice(hashes, apart + 1, left), lambda a, b: f(a, b))


def buckets_of(words: str, pairs: str) -> Column:
    """Buckets of the hashes of the words and of those of the pairs of neighbours: their remainders by ``BUCKETS``, a power of two."""
    return F.transform(F.concat(words, pairs), lambda h: h.bitwiseAND(F.lit(BUCKETS - 1).cast("long"))).cast("array<int>")


def quality_labels(labels: DataFrame) -> DataFrame:
    """``_id quality`` with one row an id."""
    rows = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("quality"))
    return rows.where(F.col("_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("_id").agg(F.min("quality").alias("quality"))


def _with_labels(documents: DataFrame, labels: DataFrame, how: str) -> DataFrame:
    small = labels.count() <= BROADCAST_LABELS
    return documents.join(F.broadcast(labels) if small else labels, documents["doc_id"] == labels["_id"], how)


def bucket_counts(rows: DataFrame) -> tuple[list[float], list[float]]:
    """How often each bucket occurs in all of ``rows`` and in trusted ones; lists of fixed length."""
    # explode() would bring a filter on what it explodes, which Spark would push down
    grams = rows.select((F.col("_quality") == 1).cast("long").alias("_t"), F.explode_outer("_b").alias("_b"))
    counts = grams.where("_b is not null").groupBy("_b").agg(F.count("*").alias("n"), F.sum("_t").alias("t")).collect()  # BUCKETS rows at most
    n, t = [0.0] * BUCKETS, [0.0] * BUCKETS
    for r in counts:
        n[r["_b"]], t[r["_b"]] = float(r["n"]), float(r["t"] or 0)
    return n, t


def with_score(rows: DataFrame, n: list[float], t: list[float]) -> DataFrame:
    """``rows`` with their ``score`` in place of ``_b``, from it and ``_quality``; add-one smoothing, and without a trusted text's own counts."""
    table = lambda x: F.from_json(F.lit(json.dumps(x)), "array<double>")  # noqa: E731  # folded to a constant once
    corpus, size, trusted = math.log(sum(n) + BUCKETS), F.size("_b"), F.col("_quality") == 1
    plain = table([math.log(b + 1.0) - math.log(a + 1.0) for a, b in zip(n, t)])
    once = table([math.log(max(b - 1.0, 0.0) + 1.0) - math.log(a + 1.0) for a, b in zip(n, t)])
    sum_of = lambda x: F.aggregate("_b", F.lit(0.0), lambda acc, b: acc + F.get(x, b))
    unseen = sum_of(plain) + size * F.lit(corpus - math.log(sum(t) + BUCKETS))
    # a trusted text's buckets as if it had each once, and what those it has more often differ from that by: once sorted, equal ones
    # lie side by side, and all but the first of each run are left
    again = F.filter("_s", lambda b, i: b == F.get("_s", i - 1))
    counts = table(t)
    smooth = lambda b, own: F.log(F.greatest(F.get(counts, b) - own, F.lit(0.0)) + 1.0)
    of_run = lambda acc: acc["n"] * (smooth(acc["b"], acc["n"]) - smooth(acc["b"], F.lit(1.0)))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("b"), F.lit(1.0).alias("n"))  # bucket 0, had once: adds nothing

    def step(acc: Column, b: Column) -> Column:
        same = acc["b"] == b
        return F.struct(
            F.when(same, acc["sum"]).otherwise(acc["sum"] + of_run(acc)).alias("sum"), b.alias("b"), (F.when(same, acc["n"]).otherwise(F.lit(1.0)) + 1.0).alias("n"),
        )

    more = F.aggregate(again, start, step, lambda acc: acc["sum"] + of_run(acc))
    own = sum_of(once) + more + size * (F.lit(corpus) - F.log(F.lit(sum(t) + BUCKETS) - size))
    score = F.when(size > 0, F.when(trusted, own).otherwise(unseen) / size).otherwise(F.lit(0.0))
    return rows.withColumn("_s", F.when(trusted, F.sort_array("_b"))).withColumn("score", score).drop("_b", "_s")


def best_threshold(scored: DataFrame) -> float:
    """The lower edge of the score bin from which labelled rows (``_quality``, ``_score``) are best told apart."""
    at = F.least(F.greatest(F.floor(F.col("_score") / BIN).cast("int"), F.lit(-BINS)), F.lit(BINS))
    bins = scored.select(F.col("_quality").alias("quality"), at.alias("at")).groupBy("quality", "at").count().collect()  # 2 * (2 * BINS + 1) rows at most
    good, bad = (sum(r["count"] for r in bins if r["quality"] == q) for q in (1, 0))
    if not good or not bad:
        return -math.inf
    edges = sorted({r["at"] for r in bins})
    lost = {e: [0, 0] for e in edges}
    for r in bins:
        lost[r["at"]][r["quality"]] += r["count"]
    best, where, low, high = 1.0, -math.inf, 0, 0
    for e in edges:
        balanced = low / bad + (good - high) / good
        if balanced > best:
            best, where = balanced, e * BIN
        low, high = low + lost[e][0], high + lost[e][1]
    return where


def with_repeated_words(rows: DataFrame, pairs: str) -> DataFrame:
    """``rows`` with ``n_repeat_words``, the words inside eight-word windows that occur twice or more in the text, given the hashes of ``pairs`` of neighbours."""
    kept = rows.columns
    # a window that occurs twice has its first four words, and so a value of these, twice: else nothing is looked for, and what follows is null
    rows = rows.withColumn("_x", _joined(pairs, 2, lambda a, b: a.bitwiseXOR(b)))
    rows = rows.withColumn("_x", F.when(F.size(F.array_distinct("_x")) < F.size("_x"), F.col(pairs)))
    for apart in (2, 4):  # four words, then WINDOW
        rows = rows.withColumn("_x", _joined("_x", apart))
    rows = rows.withColumn("_x", F.sort_array(F.transform("_x", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    same = lambda a, b: a.isNotNull() & b.isNotNull() & (a["h"] == b["h"])
    twice = F.filter("_x", lambda x, i: same(x, F.get("_x", i - 1)) | same(x, F.get("_x", i + 1)))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    union = F.aggregate(
        F.sort_array(F.transform(twice, lambda x: x["i"])), start,
        lambda acc, p: F.struct((acc["n"] + (p + WINDOW) - F.greatest(acc["to"], p)).cast("long").alias("n"), (p + WINDOW).alias("to")),
        lambda acc: acc["n"],
    )
    return rows.select(*kept, F.coalesce(union, F.lit(0).cast("long")).alias("n_repeat_words"))


def measures(documents: DataFrame, *keep: str) -> DataFrame:
    """The base measures and ``base_failed`` of every row, and ``_b``, the buckets of its words and pairs."""
    base = documents.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = base.select(*keep, "text", lines.alias("_lines"))
    base = base.select(
        *keep, (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), F.array_remove(F.split("text", SPACE), "").alias("_words"),
    )
    rows = base.select(
        *keep, "n_dup_lines", "n_symbols", F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"), _hashes("_words").alias("_w"),
    )
    rows = rows.withColumn("_p", _joined("_w", 1))
    rows = with_repeated_words(rows.withColumn("_b", buckets_of("_w", "_p")).drop("_w"), "_p")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "_b")


def quality(documents: DataFrame, labels: DataFrame, *keep: str) -> DataFrame:
    """Base measures, ``base_failed``, ``score`` and ``kept`` of every row of ``documents``; the score is fitted on them and ``labels``. ``keep`` has to name ``doc_id``."""
    known = quality_labels(labels).withColumnRenamed("quality", "_quality")
    rows = stored(_with_labels(measures(documents, *keep), known, "left").drop("_id"), "quality")
    scored = stored(with_score(rows, *bucket_counts(rows)), "scores")
    drop_stored(rows)
    threshold = best_threshold(scored.where("_quality is not null").select("_quality", F.col("score").alias("_score")))
    passed = F.lit(True) if threshold == -math.inf else F.col("score") >= threshold
    return scored.drop("_quality").withColumn("kept", ~F.col("base_failed") & passed)


def query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest of op5, a row per document."""
    return quality(documents.select("doc_id", "text"), labels, "doc_id")
