"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut where no piece can reach across (before a word mark that follows anything else, and around letters outside the
vocabulary); each distinct segment is kept once and all are joined into one batch text. A suffix array over that text,
sorted to the length of the longest piece, is searched for every piece at once; a piece's range in it lists all places where the piece occurs. Each
occurrence is an edge from its start to its end. The edges are sorted by position and relaxed from left to right: an edge may extend the
segmentation that ends at its start if, for the pair (last piece there, piece of the edge), the merges of the model end in just these two pieces. For
merge models this leaves one segmentation for every prefix: the one that the model's own merge order gives.

The model (a public merge model with byte fallback, no normalisation and a leading word mark) is read at the driver from a path that is a parameter; its pieces
travel to the executors. Nothing is trained.

Defined cases. Null texts encode to null and decode to null; empty ones to no ids. Letters outside the vocabulary become byte pieces. A word mark in the text
itself is read as a space, as the model does; such texts decode to spaces. Repeated rows are encoded each. Clashing column names are no matter:
only the text column is read and one column, named by the caller, is added.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from .common import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Letters of distinct segments that are matched at once, and of text that is held at once.
MATCH_LETTERS = 400_000
HOLD_LETTERS = 1_500_000
#: Segments whose ids a task remembers; longer ones than so many letters are matched by themselves.
REMEMBERED, LONG_LETTERS = 400_000, 5_000
#: Answers about pairs of pieces that a task remembers, as a power of two.
PAIR_BITS = 20


class Pieces:
    """The vocabulary: pieces with their merge order, and the ids of bytes. What is derived from them is worked out once, at the driver."""

    def __init__(self, pieces: list[str], order: list[float], byte_ids: list[int], plain: list[bool]) -> None:
        self.pieces, self.byte_ids = pieces, byte_ids
        own = [i for i, ok in enumerate(plain) if ok]
        self.rank = {pieces[i]: -order[i] for i in own}
        self.id_of = {pieces[i]: i for i in own}
        self.letters = {c for i in own for c in pieces[i]}
        if self.letters - self.rank.keys():
            raise ValueError("a letter of a piece is no piece itself")
        if any(re.search(f"[^{MARK}]{MARK}", pieces[i]) for i in own):
            raise ValueError("a piece goes on after a word's end")
        self.pattern = self._breaks([pieces[i] for i in own])
        # patterns as rows of letters, shorter ones padded by 0, in order of length
        self.ids = np.array(sorted(own, key=lambda i: (len(pieces[i]), i)), dtype=np.int32)
        self.lengths = np.array([len(pieces[i]) for i in self.ids], dtype=np.int32)
        # letters numbered in order, from 1; 0 stands between segments
        self.codes = np.array(sorted(map(ord, self.letters)), dtype=np.int64)
        number = self._numbers()
        self.patterns = np.zeros((len(own), int(self.lengths[-1])), dtype=np.uint16)
        for row, i in enumerate(self.ids.tolist()):
            self.patterns[row, : self.lengths[row]] = number[[ord(c) for c in pieces[i]]]
        self._ends(own)
        self._begin()

    def _breaks(self, own: list[str]) -> str:
        """The pattern of segments."""
        beside = {pair for x in own for pair in zip(x, x[1:])}
        words, signs = {c for c in self.letters if c.isalpha()}, {c for c in self.letters if c.isascii() and not c.isalnum()}
        if any((a in words and b in signs) or (a in signs and b in words) for a, b in beside):
            words, signs = set(), set()  # some piece holds both kinds: they stay together
        listed = lambda x: "".join(re.escape(c) for c in sorted(x))
        known, other = listed(self.letters - {MARK}), listed(self.letters - words - signs - {MARK})
        apart = "".join(f"[{listed(x)}]++(?![{other}])|" for x in (words, signs) if x and other)
        return f"{MARK}*(?:{apart}[{known}]+)|{MARK}+|[^{MARK}{known}]"

    def _ends(self, own: list[int]) -> None:
        """What stands at the left and at the right end of each piece while it is merged, each with the order of the merge that takes it; the merges by their two sides."""
        found: dict[str, tuple[list, list]] = {}
        whole = np.zeros(len(self.pieces), dtype=bool)
        for i in sorted(own, key=lambda i: len(self.pieces[i])):
            piece = self.pieces[i]
            left, right = [(i, np.inf)], [(i, np.inf)]
            parts = self.merge(piece, halves=True)
            whole[i] = len(piece) == 1 or len(parts) == 2
            if len(parts) == 2:
                order = self.rank[piece]
                left += [(e, min(o, order)) for e, o in found[parts[0]][0]]
                right += [(e, min(o, order)) for e, o in found[parts[1]][1]]
            found[piece] = left, right
        self.whole = whole
        self.sides = []
        for side in (0, 1):
            rows = [found[self.pieces[i]][side] if self.pieces[i] in found and self.id_of[self.pieces[i]] == i else [] for i in range(len(self.pieces))]
            many = np.array([len(x) for x in rows], dtype=np.int64)
            flat = [e for x in rows for e in x]
            self.sides.append((np.cumsum(many) - many, many, np.array([e for e, _ in flat], dtype=np.int64), np.array([o for _, o in flat])))
        n = len(self.pieces)
        merges = {}
        for i in own:
            piece = self.pieces[i]
            for k in range(1, len(piece)):
                if piece[:k] in self.id_of and piece[k:] in self.id_of:
                    merges[self.id_of[piece[:k]] * n + self.id_of[piece[k:]]] = self.rank[piece]
        self.merge_codes = np.array(sorted(merges), dtype=np.int64)
        self.merge_orders = np.array([merges[c] for c in self.merge_codes.tolist()])

    def _numbers(self) -> np.ndarray:
        number = np.zeros(0x110000, dtype=np.uint16)
        number[self.codes] = np.arange(1, len(self.codes) + 1)
        return number

    def _begin(self) -> None:
        """What a worker adds while it encodes."""
        self.number, self.bits, self.longest = self._numbers(), len(self.codes).bit_length(), int(self.lengths[-1])
        self.cut = re.compile(self.pattern)
        self.length_of = np.zeros(len(self.pieces), dtype=np.int64)
        self.length_of[self.ids] = self.lengths
        # answers about pairs of pieces, each at the place that its code hashes to
        self.asked, self.answers = np.full(1 << PAIR_BITS, -1, dtype=np.int64), np.zeros(1 << PAIR_BITS, dtype=bool)
        self.memo: dict[str, int] = {}
        self.held, self.first, self.many = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.text_of = {i: self.pieces[i].replace(MARK, " ") for i in self.ids.tolist()}
        self.text_of |= {i: chr(b) for b, i in enumerate(self.byte_ids[:128])}  # whole letters by themselves
        self.plain = np.zeros(len(self.pieces), dtype=bool)
        self.plain[list(self.text_of)] = True

    _STATE = ("pieces", "byte_ids", "letters", "pattern", "ids", "lengths", "codes", "patterns", "whole", "sides", "merge_codes", "merge_orders")

    def __getstate__(self) -> tuple:
        return tuple(getattr(self, k) for k in self._STATE)

    def __setstate__(self, state: tuple) -> None:
        self.__dict__ |= dict(zip(self._STATE, state))
        self._begin()

    def merge(self, text: str, halves: bool = False) -> list[str]:
        """The model's definition, for short texts: merge the best pair, the leftmost of equals, until none is left; ``halves``: stop before the last merge."""
        parts = list(text)
        while True:
            best = min(((self.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.rank), default=None)
            if best is None or (halves and len(parts) == 2):
                return parts
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def stay(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether no merge crosses from one piece into the next: one would have to come before either side's end is taken by a merge of its own side."""
        (left_at, left_many, left, gone), (right_at, right_many, right, taken) = self.sides
        wide = left_many[after]
        many = right_many[before] * wide
        pair = np.repeat(np.arange(len(before)), many)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
        r, x = right_at[before][pair] + k // wide[pair], left_at[after][pair] + k % wide[pair]
        code = right[r] * len(self.pieces) + left[x]
        at = np.minimum(np.searchsorted(self.merge_codes, code), len(self.merge_codes) - 1)
        order = self.merge_orders[at]
        crosses = (self.merge_codes[at] == code) & (order < taken[r]) & (order <= gone[x])
        return np.bincount(pair[crosses], minlength=len(before)) == 0

    def _fit(self, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Whether the merges of two pieces' text end in these two pieces; answers are kept."""
        codes = before * len(self.pieces) + after
        at = ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.answers[at]
        missing = np.flatnonzero(self.asked[at] != codes)
        if len(missing):
            new, back = np.unique(codes[missing], return_inverse=True)
            answers = self.stay(new // len(self.pieces), new % len(self.pieces))
            out[missing] = answers[back]
            slot = at[missing]
            self.asked[slot] = codes[missing]  # of several codes for one place the last stays, in both arrays
            self.answers[slot] = out[missing]
        return out

    def segment_ids(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of segments that consist of known letters, in a row, and how many each has."""
        sizes = np.array([len(s) for s in segments], dtype=np.int64)
        text = self.number[np.frombuffer("\0".join(segments).encode("utf-32-le"), dtype=np.uint32)]
        starts = np.concatenate([[0], np.cumsum(sizes[:-1] + 1)]).astype(np.int64)
        since = (np.arange(len(text)) - np.repeat(starts, sizes + 1)[: len(text)]).astype(np.int32)  # how far into its segment a place is
        array = suffix_array(text, self.longest, self.bits)
        low, high = occurrences(text, array, self.patterns, self.lengths)
        count = high - low
        piece = np.repeat(np.arange(len(count), dtype=np.int32), count)
        place = array[np.repeat(low - np.concatenate([[0], np.cumsum(count[:-1])]), count) + np.arange(count.sum())].astype(np.int32)
        ok = self.whole[self.ids[piece]]  # whose own letters merge into it
        piece, place = piece[ok], place[ok]
        reach = since[place] + self.lengths[piece]
        order = np.argsort(reach.astype(np.uint16) if len(reach) and reach.max() < 65536 else reach, kind="stable")
        place, piece, reach = place[order], piece[order], reach[order]
        end, token, first = place + self.lengths[piece], self.ids[piece], since[place] == 0
        last = np.full(len(text) + 2, -1, dtype=np.int64)
        (self._relax_one if len(segments) == 1 else self._relax)(place, token, end, reach, first, last)
        active, at = np.arange(len(segments)), starts + sizes
        backwards = []
        while len(active):
            t = last[at]
            if (t < 0).any():
                raise ValueError("a segment has no segmentation")
            backwards.append((active, t))
            at = at - self.length_of[t]
            go = at > starts[active]
            active, at = active[go], at[go]
        who, ids = (np.concatenate(x[::-1]) for x in zip(*backwards))
        return ids[np.argsort(who, kind="stable")].astype(np.int32), np.bincount(who, minlength=len(segments))

    def _relax(self, place: np.ndarray, token: np.ndarray, end: np.ndarray, reach: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        """Edges in order of how far they reach into their segments, those of all segments that reach as far at once."""
        bounds = np.flatnonzero(np.concatenate([[True], reach[1:] != reach[:-1], [True]])) if len(reach) else np.zeros(1, dtype=np.int64)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            t, before, ok = token[a:b], last[place[a:b]], first[a:b].copy()
            rest = np.flatnonzero(~ok & (before >= 0))
            ok[rest] = self._fit(before[rest], t[rest])
            last[end[a:b][ok]] = t[ok]

    def _relax_one(self, place: np.ndarray, token: np.ndarray, end: np.ndarray, reach: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        """The edges of one segment, one by one."""
        n, known, so_far = len(self.pieces), {}, [-1] * len(last)
        for a in range(0, len(place), 1 << 20):
            b = a + (1 << 20)
            for p, t, e, f in zip(place[a:b].tolist(), token[a:b].tolist(), end[a:b].tolist(), first[a:b].tolist()):
                before = so_far[p]
                if not f:
                    if before < 0:
                        continue
                    ok = known.get(before * n + t)
                    if ok is None:
                        ok = known[before * n + t] = bool(self.stay(np.array([before]), np.array([t]))[0])
                    if not ok:
                        continue
                so_far[e] = t
        last[:] = so_far

    def _learn(self, segments: list[str], ids: np.ndarray, many: np.ndarray) -> None:
        self.memo.update(zip(segments, range(len(self.many), len(self.many) + len(segments))))
        self.first = np.concatenate([self.first, len(self.held) + np.cumsum(many) - many])
        self.held, self.many = np.concatenate([self.held, ids]), np.concatenate([self.many, many])

    def _look_up(self, segments: list[str]) -> np.ndarray:
        """The segments' places among those remembered; new ones are matched."""
        new = set(segments).difference(self.memo)
        if len(self.memo) + len(new) > REMEMBERED:
            self.memo.clear()
            self.held, self.first, self.many = self.held[:0], self.first[:0], self.many[:0]
            new = set(segments)
        some, size, raw = [], 0, []
        for s in new:
            if s[0] != MARK and s[0] not in self.letters:
                raw.append(s)
            elif len(s) > LONG_LETTERS:
                self._learn([s], *self.segment_ids([s]))
            else:
                some.append(s)
                size += len(s) + 1
                if size >= MATCH_LETTERS:
                    self._learn(some, *self.segment_ids(some))
                    some, size = [], 0
        if some:
            self._learn(some, *self.segment_ids(some))
        if raw:
            ids = [[self.byte_ids[b] for b in s.encode("utf-8", "surrogatepass")] for s in raw]
            self._learn(raw, np.array(list(chain.from_iterable(ids)), dtype=np.int32), np.array([len(x) for x in ids], dtype=np.int64))
        return np.fromiter(map(self.memo.__getitem__, segments), dtype=np.int64, count=len(segments))

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the bounds of each text's; null texts have none."""
        cut = self.cut
        split = [cut.findall(MARK + t.replace(" ", MARK)) if t else () for t in texts]
        at = self._look_up(list(chain.from_iterable(split)))
        many = self.many[at]
        ends = np.concatenate([[0], np.cumsum(many)])
        ids = self.held[np.repeat(self.first[at] - ends[:-1], many) + np.arange(ends[-1])]
        return ids, ends[np.concatenate([[0], np.cumsum([len(x) for x in split])]).astype(np.int64)]

    def encode_all(self, texts: list[str | None]) -> list[list[int] | None]:
        ids, bounds = self.encode_flat(texts)
        flat, bounds = ids.tolist(), bounds.tolist()
        return [None if t is None else flat[a:b] for t, a, b in zip(texts, bounds, bounds[1:])]

    def decode_flat(self, ids: np.ndarray, bounds: np.ndarray) -> Iterator[str]:
        """The text of each run of ids."""
        parts = list(map(self.text_of.get, ids.tolist()))
        odd = np.concatenate([[0], np.cumsum(~self.plain[ids])])
        odd = (odd[bounds[1:]] > odd[bounds[:-1]]).tolist()
        for a, b, other in zip(bounds[:-1].tolist(), bounds[1:].tolist(), odd):
            if other:
                yield self.decode(ids[a:b].tolist())
            else:
                marked = a < b and parts[a][:1] == " " and int(ids[a]) not in self.byte_of
                yield "".join(parts[a:b])[marked:]

    def decode(self, ids: Iterable[int] | None) -> str | None:
        """Pieces in a row, runs of byte pieces as UTF-8 (what isn't comes out as U+FFFD); the leading word mark goes."""
        if ids is None:
            return None
        ids = list(ids)
        parts = list(map(self.text_of.get, ids))
        marked = bool(ids) and ids[0] not in self.byte_of and (parts[0] or "")[:1] == " "
        if None not in parts:
            return "".join(parts)[marked:]
        out, raw = [], bytearray()
        for i, piece in zip(ids, parts):
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if piece is None:
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            out.append(piece)
        out.append(raw.decode("utf-8", "replace"))
        return "".join(out)[marked:]


def load(path: str = MODEL) -> Pieces:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    plain = [not (p.is_unknown(i) or p.is_control(i) or p.is_byte(i) or p.is_unused(i)) for i in range(n)]
    byte_ids = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    return Pieces([p.id_to_piece(i) for i in range(n)], [p.get_score(i) for i in range(n)], byte_ids, plain)


def suffix_array(text: np.ndarray, depth: int, bits: int = 16) -> np.ndarray:
    """Places in the order of the ``depth`` letters (at least) that start there: by as many letters of ``bits`` bits as a word holds, then by doubling."""
    n = len(text)
    width = 62 // bits
    key = np.zeros(n, dtype=np.int64)
    for d in range(width):
        key <<= bits
        key[: max(n - d, 0)] |= text[d:].astype(np.int64)
    while True:
        array = np.argsort(key)
        if width >= depth:
            return array
        ordered = key[array]
        rank = np.empty(n, dtype=np.int64)
        rank[array] = np.concatenate([[1], 1 + np.cumsum(ordered[1:] != ordered[:-1])])
        key = rank << 32
        key[: max(n - width, 0)] |= rank[width:]
        width *= 2


def occurrences(text: np.ndarray, array: np.ndarray, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each pattern (a row of letters; rows in order of length) its range [low, high) in the suffix array: a binary search letter by letter, all patterns at once."""
    n = len(text)
    low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), n, dtype=np.int64)
    padded = np.concatenate([text, np.zeros(patterns.shape[1], dtype=text.dtype)])
    for d in range(patterns.shape[1]):
        rows = np.flatnonzero((lengths > d) & (low < high))
        letter = patterns[rows, d]
        for side in (low, high):
            a, b = low[rows].copy(), high[rows].copy()
            open_ = np.flatnonzero(a < b)
            while len(open_):
                mid = (a[open_] + b[open_]) >> 1
                there = padded[array[mid] + d]
                right = there < letter[open_] if side is low else there <= letter[open_]
                a[open_[right]] = mid[right] + 1
                b[open_[~right]] = mid[~right]
                open_ = open_[a[open_] < b[open_]]
            if side is low:
                firsts = a
            else:
                high[rows] = a
        low[rows] = firsts
    return low, np.maximum(low, high)


def _held(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """Slices of about HOLD_LETTERS bytes (or ids)."""
    for batch in batches:
        column = batch.column(at)
        size = pc.binary_length(column) if pa.types.is_string(column.type) else pc.list_value_length(column)
        ends = np.cumsum(size.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < batch.num_rows:
            before = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + HOLD_LETTERS, side="right")))
            yield batch.slice(first, last - first)
            first = last


def _lists(texts: list[str | None], ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()), mask=pa.array([t is None for t in texts], pa.bool_()))


def _without(df: DataFrame, *made: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in made])


def encode(df: DataFrame, pieces: Pieces, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with a column of piece ids (in place of one of that name); no shuffle."""
    df = _without(df, out)
    at, names = df.columns.index(text), [*df.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _held(batches, at):
            texts = b.column(at).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(texts, *pieces.encode_flat(texts))], names=names)

    return small_batches(df).mapInArrow(run, StructType([*df.schema.fields, StructField(out, ArrayType(IntegerType()))]))


def decode(df: DataFrame, pieces: Pieces, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with a column of the texts that its piece ids spell (in place of one of that name); no shuffle."""
    df = _without(df, out)
    at, names = df.columns.index(ids), [*df.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _held(batches, at):
            texts = pa.array([pieces.decode(x) for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=names)

    return small_batches(df).mapInArrow(run, StructType([*df.schema.fields, StructField(out, StringType())]))


def encode_checked(df: DataFrame, pieces: Pieces, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` and ``round_trip``, whether they decode to the text again (in place of columns of these names), in one pass of Python; a null text has null ids, which decode to null again."""
    df = _without(df, "ids", "round_trip")
    at, names = df.columns.index(text), [*df.columns, "ids", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _held(batches, at):
            texts = b.column(at).to_pylist()
            ids, bounds = pieces.encode_flat(texts)
            same = pa.array([t is None or x == t for x, t in zip(pieces.decode_flat(ids, bounds), texts)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(texts, ids, bounds), same], names=names)

    return small_batches(df).mapInArrow(run, StructType([*df.schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("round_trip", BooleanType())]))


def query(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """op1, a row per document: the ids of the whole text, their number, and whether they decode to the text again."""
    both = encode_checked(documents.select("doc_id", "text"), load(model))
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), "round_trip")
