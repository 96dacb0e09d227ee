"""Toxicity scores from a learned lexicon, matched through Levenshtein automata.

The lexicon holds the words that tell toxic training texts from others best. It is a trie; intersected with the
Levenshtein automaton of distance one and made deterministic step by step, it accepts each lexicon word of five letters or more with up to one
letter added, dropped or exchanged, and shorter ones as they are. A word runs through it once, letter by letter, and most words fail after three letters.
Every accepted word has a weight of its own: lexicon words their log odds; misspellings seen in training texts the log odds of that spelling (so that
innocent look-alikes weigh nothing); unseen misspellings a share of their word's weight. A hit counts as quoted if quotation marks enclose it within
``CONTEXT`` tokens on both sides or a word of citing stands there before it. A logistic model scores a text from its abusive and its quoted weight.

Bounded fit: lexicon and model are fitted on at most ``TRAIN_ROWS`` labelled rows (those with the smallest hashes of ``doc_id``), of which none has
crc32(doc_id as text) mod 5 = 0. From them come ``LEXICON`` words of 3 to 40 letters at most, those with the greatest odds, and ``VARIANTS`` of their spellings, the most frequent
ones; rarer spellings count as unseen. All texts are scored, whole. A text's own share is left out of its words' odds while fitting, as if it were new.

Defined cases. Null and empty texts get the score of a text without hits. A null ``doc_id`` is neither held out nor used to learn. Conflicting labels
of one id count as toxic; null labels are ignored. Without labels of both kinds every score is 0. Only ``doc_id``, ``text`` and ``toxic`` are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored

TRAIN_ROWS = 20_000
LEXICON = 1_000
VARIANTS = 20_000
LEAST_TEXTS = 3
LEAST_ODDS = 3.0
UNSEEN = 0.6
CONTEXT = 6
WORD = re.compile(r"[^\W_](?:[\w*@$!]*[^\W_])?")
TOKEN = re.compile(r"[\"“”„«»‹›]|[^\W_](?:[\w*@$!]*[^\W_])?")
QUOTES = frozenset("\"“”„«»‹›")
# Words that introduce what someone else said.
CITING = frozenset("said says quote quoted quoting called wrote sagte sagt schrieb zitat zitiert dit disait cité citation écrit dijo dice citó cita escribió".split())


class Automaton:
    """Words of a trie within one edit, made deterministic lazily; a state is a set of (node, edits)."""

    #: Transitions kept before the memory starts anew.
    KEPT = 400_000

    def __init__(self, words: Iterable[str]) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.fuzzy: list[bool] = [False]  # a word of five letters or more lies below
        for w in words:
            node = 0
            for c in w:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                    self.fuzzy.append(False)
                self.fuzzy[node] = self.fuzzy[node] or len(w) >= 5
                node = self.children[node][c]
            self.fuzzy[node] = self.fuzzy[node] or len(w) >= 5
            self.word[node] = w
        self._clear()

    def _clear(self) -> None:
        self.states: list[frozenset[tuple[int, int]]] = [frozenset({(0, 0)} | {(n, 1) for n in self.children[0].values() if self.fuzzy[n]})]
        self.number: dict[frozenset[tuple[int, int]], int] = {self.states[0]: 0}
        self.steps: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [self._end(self.states[0])]
        self.kept = 0

    def _end(self, state: frozenset[tuple[int, int]]) -> str | None:
        found = [(e, self.word[n]) for n, e in state if self.word[n] is not None and (e == 0 or len(self.word[n]) >= 5)]
        return min(found)[1] if found else None

    def _step(self, at: int, c: str) -> int:
        out = set()
        for node, e in self.states[at]:
            if c in self.children[node]:
                child = self.children[node][c]
                out.add((child, e))
                if e == 0:  # a letter dropped after it
                    out.update((n, 1) for n in self.children[child].values() if self.fuzzy[n])
            if e == 0:
                if self.fuzzy[node]:
                    out.add((node, 1))  # a letter added
                out.update((n, 1) for n in self.children[node].values() if self.fuzzy[n])  # a letter exchanged
        state = frozenset(out)
        to = -1
        if state:
            to = self.number.get(state, -1)
            if to < 0:
                to = self.number[state] = len(self.states)
                self.states.append(state)
                self.steps.append({})
                self.ends.append(self._end(state))
        self.steps[at][c] = to
        self.kept += 1
        return to

    def match(self, word: str) -> str | None:
        """The lexicon word that ``word`` is or misspells by one edit; equal ones first, then in order of letters."""
        if self.kept > self.KEPT:
            self._clear()
        at, steps = 0, self.steps
        for c in word:
            to = steps[at].get(c)
            if to is None:
                to = self._step(at, c)
            if to < 0:
                return None
            at = to
        return self.ends[at]


def odds(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float:
    return math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))


class Model:
    """What scoring needs; pickled to the executors. Its size is bounded by LEXICON and VARIANTS."""

    def __init__(self, lexicon: dict[str, tuple[int, int]], n_toxic: int, n_clean: int) -> None:
        self.counts, self.n_toxic, self.n_clean = dict(lexicon), n_toxic, n_clean
        self.lexicon = sorted(lexicon)
        self.coefficients = [0.0, 0.0, 0.0, 0.0]
        self.fitted = False

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("automaton", "memo")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)

    def matched(self, words: Iterable[str]) -> dict[str, str]:
        """Those of ``words`` that the automaton accepts, with the lexicon word."""
        if "automaton" not in self.__dict__:
            self.automaton, self.memo = Automaton(self.lexicon), {}
        memo, match, found = self.memo, self.automaton.match, {}
        if len(memo) > 300_000:
            memo.clear()
        for w in words:
            if w in memo:
                term = memo[w]
            else:
                term = memo[w] = match(w)
            if term is not None:
                found[w] = term
        return found

    def weight(self, word: str, term: str, label: int | None) -> float:
        """Log odds of a spelling; ``label``: of the training text it is in, whose own share is left out."""
        t, c = self.counts.get(word, (0, 0))
        if label is not None:
            t, c = max(t - label, 0), max(c - 1 + label, 0)
        n_toxic, n_clean = self.n_toxic - (label == 1), self.n_clean - (label == 0)
        if t + c:
            return max(0.0, odds(t, c, n_toxic, n_clean)) * (t / (t + 1.0))
        if word == term:
            return 0.0
        t, c = self.counts[term]
        return UNSEEN * max(0.0, odds(t, c, n_toxic, n_clean))

    def features(self, text: str | None, label: int | None = None) -> tuple[float, float, float]:
        """Abusive weight, quoted weight (both as log1p) and abusive weight a hundred words."""
        text = (text or "").lower()
        words = WORD.findall(text)
        hits = self.matched(set(words))
        hits = {w: x for w, term in hits.items() if (x := self.weight(w, term, label)) > 0.0}
        if not hits:
            return 0.0, 0.0, 0.0
        tokens = TOKEN.findall(text)
        abuse = quoted = 0.0
        for i, w in enumerate(tokens):
            if w in hits:
                before, after = tokens[max(0, i - CONTEXT) : i], tokens[i + 1 : i + 1 + CONTEXT]
                if (not QUOTES.isdisjoint(before) and not QUOTES.isdisjoint(after)) or not CITING.isdisjoint(before):
                    quoted += hits[w]
                else:
                    abuse += hits[w]
        return math.log1p(abuse), math.log1p(quoted), math.log1p(100.0 * abuse / max(len(words), 1))

    def score(self, text: str | None) -> float:
        if not self.fitted:
            return 0.0
        z = self.coefficients[0] + sum(b * x for b, x in zip(self.coefficients[1:], self.features(text)))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``text toxic`` of the rows that are learned from."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~_held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)  # the bound of the fit, and of the broadcast
    return documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic")


def _count(words_of, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1)):
            (toxic if label.as_py() else clean).update(words_of(set(WORD.findall((text.as_py() or "").lower()))))
    words = list(toxic.keys() | clean.keys())
    yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "t": pa.array([toxic[w] for w in words], pa.int64()), "c": pa.array([clean[w] for w in words], pa.int64())})


def _counts(rows: DataFrame, words_of) -> DataFrame:
    return rows.mapInArrow(lambda batches: _count(words_of, batches), "word string, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    rows = small_batches(stored(training_rows(documents, labels), "toxic-sample"))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Model({}, n_toxic, n_clean)
    z = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    told = _counts(rows, lambda words: [w for w in words if 3 <= len(w) <= 40]).where(F.col("t") >= LEAST_TEXTS).withColumn("z", z).where(F.col("z") >= LEAST_ODDS)
    lexicon = {r["word"]: (r["t"], r["c"]) for r in told.orderBy(F.desc(F.col("z") * F.sqrt("t")), "word").limit(LEXICON).collect()}
    model = Model(lexicon, n_toxic, n_clean)
    spelled = _counts(rows, lambda words: list(model.matched(words))).orderBy(F.desc(F.col("t") + F.col("c")), "word").limit(VARIANTS).collect()
    model.counts |= {r["word"]: (r["t"], r["c"]) for r in spelled}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_pylist()
            found = [model.features(x.as_py(), y) for x, y in zip(batch.column(0), labels)]
            a, b, c = (pa.array(x, pa.float64()) for x in zip(*found)) if found else (pa.array([], pa.float64()),) * 3
            yield pa.RecordBatch.from_arrays([a, b, c, pa.array(labels, pa.int32())], names=["a", "b", "c", "y"])

    # a few numbers a training row, TRAIN_ROWS at most
    table = np.array([tuple(r) for r in rows.mapInArrow(features, "a double, b double, c double, y int").collect()], dtype=float)
    table = table[np.lexsort(table.T)]
    model.coefficients, model.fitted = _logistic(table[:, :3], table[:, 3]), True
    return model


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, rounds: int = 40) -> list[float]:
    """Newton's method with a small ridge on all but the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    ridge = np.diag([1e-6] + [penalty] * (x.shape[1] - 1))
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ b)
        b = b + step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return [float(v) for v in b]


def score(documents: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``documents`` with the score as column ``out`` (in place of one of that name); no shuffle."""
    documents = documents.select(*[c for c in documents.columns if c != out])
    columns = documents.columns
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([model.score(x.as_py()) for x in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*columns, out])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return small_batches(documents).mapInArrow(run, StructType([*documents.schema.fields, StructField(out, DoubleType())]))


def reject_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents``, unchanged, whose score is below one half."""
    out = "_toxicity"
    while out in documents.columns:
        out += "_"
    return score(documents, fit(documents, labels), out).where(F.col(out) < 0.5).drop(out)


def query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest of op6, a row per document."""
    scored = score(documents.select("doc_id", "text"), fit(documents, labels))
    return scored.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
