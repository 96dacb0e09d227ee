"""Language identification by the nearest of several centroids per language.

A text is a vector of TF-IDF weights of its byte n-grams (``ORDERS``), hashed into ``BUCKETS`` and scaled to length 1. Words are runs of letters in lower
case with a blank on either side; everything else only separates. Document frequencies are counted over all training rows. The centroids of a
language come from spherical k-means over at most ``SAMPLE`` of its training rows, those with the smallest hashes: the only part that is fitted on a
sample. A text gets the language of the centroid with the highest cosine. It is rejected where its distance (one minus the
cosine) exceeds that centroid's radius, the ``RADIUS`` quantile of the distances of its own sample times ``SLACK``.

The centroids are sent to the executors in slices of ``SLICE`` languages, ``SLICE * CENTROIDS * BUCKETS`` numbers at most; with
more languages the texts meet one slice after the other.

Defined cases. Texts that are null or without any letter are ``und`` with score 0. A text none of whose n-grams was learned gets the
language with the most training rows (the first by name of equals), score 0. Nothing learned: every text is ``und``. Rows with a null id or a null ``lang`` aren't
learned from; null ids aren't held out. Repeated rows count as often as they occur. Only ``doc_id``, ``text`` and ``lang`` are read, whatever other columns are named.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

BUCKETS = 1 << 14
#: Lengths of the n-grams, in bytes.
ORDERS = (2, 3, 4)
CENTROIDS = 4
#: Training rows of a language that its centroids are fitted on, at most.
SAMPLE = 600
#: A cluster with a smaller share of the sample is dissolved: single odd texts aren't a kind of text.
LEAST_SHARE = 0.05
RADIUS, SLACK = 0.99, 1.1
ROUNDS = 12
SLICE = 64
UNKNOWN = "und"
#: Bytes of letters that are looked at at once.
PIECE = 1 << 20
#: Odd multipliers that spread n-grams of each length over the buckets.
SPREAD = {n: np.uint64(0x9E3779B97F4A7C15 + 2 * n) for n in ORDERS}
NOT_LETTERS = re.compile(r"[\W\d_]+")
ONE_HOT = BUCKETS.bit_length() - 1


def letters(text: str) -> bytes:
    """The words in lower case, a blank before, between and after them; nothing if there is none."""
    words = NOT_LETTERS.sub(" ", text.lower()).strip()
    return f" {words} ".encode() if words else b""


def _grams(data: bytes) -> np.ndarray:
    """Buckets of the n-grams of all ORDERS that begin in ``data``, with how often each occurs."""
    total = np.zeros(BUCKETS, np.int64)
    longest = max(ORDERS)
    for low in range(0, len(data), PIECE):
        b = np.frombuffer(data[low : low + PIECE + longest - 1], np.uint8).astype(np.uint64)
        code = b
        for n in range(2, longest + 1):
            if len(b) < n:
                break
            code = (code[:-1] << np.uint64(8)) | b[n - 1 :]
            if n in ORDERS:
                mine = code[:PIECE]
                total += np.bincount(((mine * SPREAD[n]) >> np.uint64(64 - ONE_HOT)).astype(np.int64), minlength=BUCKETS)
    return total


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and the weights of their term frequencies."""
    data = letters(text) if text else b""
    counts = _grams(data)
    at = np.flatnonzero(counts)
    return at, 1.0 + np.log(counts[at])


def unit(at: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The TF-IDF weights of the buckets ``at``, scaled to length 1 (zero stays zero)."""
    w = tf * idf[at]
    size = float(np.sqrt(w @ w))
    return w / size if size > 0 else w


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(documents: DataFrame) -> DataFrame:
    """``doc_id text lang`` of the rows that are learned from."""
    return documents.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            at, _ = features(text.as_py())
            df[at] += 1
            n += len(at) > 0
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.append(at, -1), pa.int32()), "n": pa.array(np.append(df[at], n), pa.int64())})


def inverse_frequencies(rows: DataFrame) -> np.ndarray:
    """The weight of each bucket, from all of ``rows``: log((1 + texts) / (1 + texts with it)); 0 for buckets that no text has."""
    found = small_batches(rows.select("text")).mapInArrow(_count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS + 1 rows at most
    df, n = np.zeros(BUCKETS), 0
    for r in found:
        if r["bucket"] < 0:
            n = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    return np.where(df > 0, np.log((1.0 + n) / (1.0 + df)) + 1e-3, 0.0)


def sampled(rows: DataFrame) -> DataFrame:
    """At most SAMPLE rows of each language, those with the smallest hashes of id and text."""
    sizes = stored(rows.groupBy("lang").agg(F.count("*").alias("_n")), "langid-sizes")
    hashed = rows.withColumn("_h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    # a share that gives twice the sample (all rows of small languages), so that no large language is sorted as a whole
    near = hashed.join(F.broadcast(sizes) if sizes.count() <= 100_000 else sizes, "lang").where(F.col("_h") * F.col("_n") < F.lit(float(2 * SAMPLE * (1 << 40))))
    first = Window.partitionBy("lang").orderBy("_h", "doc_id", F.xxhash64("text"))
    return near.withColumn("_i", F.row_number().over(first)).where(F.col("_i") <= SAMPLE).select("lang", "_i", "text")


def _vectors(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(2)]
            at = [a.astype(np.int32) for a, _ in found]
            w = [unit(a, tf, idf).astype(np.float32) for a, tf in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(w, pa.list_(pa.float32()))], names=["lang", "_i", "at", "w"])

    return run


def cluster(x: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means of unit rows: centroids of length 1 and the cluster of each row.

    It starts from the mean and from rows that are farther from all centres so far than nine of ten rows are, and dissolves small clusters.
    """
    scaled = lambda c: c / np.maximum(np.linalg.norm(c, axis=-1, keepdims=True), 1e-12)
    centres = [scaled(x.mean(axis=0))]
    best = x @ centres[0]
    while len(centres) < min(k, len(x)):
        i = int(np.argsort(best, kind="stable")[len(x) // 10])
        if best[i] > 1 - 1e-6:
            break
        centres.append(x[i])
        best = np.maximum(best, x @ x[i])
    c = np.array(centres)
    for _ in range(rounds):
        of = np.argmax(x @ c.T, axis=1)
        sizes = np.bincount(of, minlength=len(c))
        enough = np.flatnonzero(sizes >= max(1, LEAST_SHARE * len(x)))
        c = np.array([scaled(x[of == j].sum(axis=0)) for j in enough])
    return c, np.argmax(x @ c.T, axis=1)


def _centroids(table: pa.Table) -> pa.Table:
    order = np.argsort(table.column("_i").to_numpy())
    at, w = (table.column(c).to_pylist() for c in ("at", "w"))
    x = np.zeros((len(order), BUCKETS), np.float32)
    for row, i in enumerate(order):
        x[row, at[i]] = w[i]
    x = x[x.any(axis=1)]
    weights, radius = [], []
    if len(x):
        c, of = cluster(x, CENTROIDS)
        for j in range(len(c)):
            mine = x[of == j]
            if len(mine):
                weights.append(c[j])
                radius.append(float(min(1.0, SLACK * np.quantile(1.0 - mine @ c[j], RADIUS))))
    k = len(weights)
    return pa.table({"lang": pa.array([table.column("lang")[0].as_py()] * k, pa.string()), "j": pa.array(range(k), pa.int32()), "radius": pa.array(radius, pa.float64()), "weights": pa.array(weights, pa.list_(pa.float32()))})


class Model:
    """Weights of buckets, the most frequent language, and where the centroids lie (a table ``lang j radius weights``)."""

    def __init__(self, idf: np.ndarray, usual: str | None, centroids: DataFrame | None):
        self.idf, self.usual, self.centroids = idf, usual, centroids

    def slices(self) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """Languages, radii and weights (buckets by centroids), SLICE languages at a time."""
        if self.centroids is None:
            return
        names = sorted(r["lang"] for r in self.centroids.select("lang").distinct().collect())  # names only
        for i in range(0, len(names), SLICE):
            rows = self.centroids.where(F.col("lang").isin(names[i : i + SLICE])).orderBy("lang", "j").collect()  # SLICE * CENTROIDS rows at most
            yield [r["lang"] for r in rows], np.array([r["radius"] for r in rows]), np.array([r["weights"] for r in rows], np.float32).T


def fit(documents: DataFrame) -> Model:
    rows = training_rows(documents)
    usual = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").first()
    if usual is None:
        return Model(np.zeros(BUCKETS), None, None)
    idf = inverse_frequencies(rows)
    vectors = small_batches(sampled(rows)).mapInArrow(_vectors(idf), "lang string, _i int, at array<int>, w array<float>")
    return Model(idf, usual["lang"], stored(vectors.groupBy("lang").applyInArrow(_centroids, "lang string, j int, radius double, weights array<float>"), "langid-centroids"))


def _nearest(names: list[str], radius: np.ndarray, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, idf = sent.value
        for batch in batches:
            langs, scores, radii = (batch.column(i).to_pylist() for i in (2, 3, 4))
            for row, text in enumerate(batch.column(1)):
                at, tf = features(text.as_py())
                if not len(at):
                    continue
                cosines = unit(at, tf, idf) @ weights[at]
                j = int(np.argmax(cosines))
                if scores[row] is None or cosines[j] > scores[row]:
                    langs[row], scores[row], radii[row] = names[j], float(cosines[j]), float(radius[j])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(radii, pa.float64())], names=["doc_id", "text", "lang", "score", "radius"])

    return run


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id lang_pred score rejected`` of every row; no shuffle. ``rejected`` texts lie beyond the radius of their nearest centroid."""
    rows = small_batches(documents.select(F.col("doc_id").cast("long"), "text", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("radius")))
    sc = documents.sparkSession.sparkContext
    for names, radius, weights in model.slices():
        rows = rows.mapInArrow(_nearest(names, radius, sc.broadcast((weights, model.idf))), "doc_id long, text string, lang string, score double, radius double")
    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = F.col("score").isNotNull() & (F.col("score") > 0)
    lang = F.when(~known, F.lit(UNKNOWN)).when(found, F.col("lang")).otherwise(F.lit(model.usual or UNKNOWN))
    score = F.when(known & found, F.least(F.col("score"), F.lit(1.0))).otherwise(F.lit(0.0))
    return rows.select("doc_id", lang.alias("lang_pred"), score.alias("score"), (~known | ~found | (1.0 - score > F.col("radius"))).alias("rejected"))


def query(documents: DataFrame) -> DataFrame:
    """The digest of op13, a row per document. ``lang_pred`` is the nearest language of rejected texts too, as its contract asks; ``rejected`` marks them."""
    rows = documents.select("doc_id", "text", "lang")
    return identify(rows, fit(rows)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
