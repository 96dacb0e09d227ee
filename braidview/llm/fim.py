"""Fill-in-middle transformation: each text is cut into prefix, middle and suffix and written in the order that a model is to learn.

A unit is a run of letters A-Z and a-z, or any other code point. One table-driven automaton over bytes knows where units and code points begin
and whether a sentinel ends. Its state depends on the last two bytes alone, which is worked out from the table, so that
numpy looks up the states of a whole block at once. The first scan counts the transitions of each kind, per text and per block of ``BLOCK`` bytes; once
the number of units has given the cuts, a second pass scans only the blocks that hold a cut and finds its byte.

Where a cut is, and the form, come from the SHA-256 of ``1:`` and the document's id. A text that is empty or contains a sentinel stays plain.

Defined cases. Null and empty texts are plain and have no units. A null id hashes as no digits. Repeated rows are cut alike. Texts
of any length are scanned a block at a time (a text itself has to fit into a task). Only ``doc_id`` and ``text`` are read, whatever other columns are named.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 1
#: Of 100 texts so many get a form other than plain, and of 100 of those so many have the suffix first.
CHANGED, SUFFIX_FIRST = 90, 20
BLOCK = 1 << 20

# Classes of bytes, states, and the automaton.
OTHER, LETTER, NAME, OPEN, CLOSE, MORE = range(6)  # NAME: a letter of a sentinel; MORE: a later byte of a code point
START, WORD, OPENED, NAMED = range(4)


def _classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint8)
    table[list(string.ascii_letters.encode())] = LETTER
    table[list(b"PSM")] = NAME
    table[ord("<")], table[ord(">")] = OPEN, CLOSE
    table[0x80:0xC0] = MORE
    return table


def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The next state, and whether a unit begins, a code point begins, a sentinel ends, by state and class."""
    following, unit, point, ends = (np.zeros((4, 6), np.uint8) for _ in range(4))
    for state in (START, WORD, OPENED, NAMED):
        in_word = state in (WORD, NAMED)
        for kind in (OTHER, LETTER, NAME, OPEN, CLOSE, MORE):
            letter = kind in (LETTER, NAME)
            following[state, kind] = NAMED if state == OPENED and kind == NAME else WORD if letter else OPENED if kind == OPEN else START
            unit[state, kind] = kind != MORE and not (letter and in_word)
            point[state, kind] = kind != MORE
            ends[state, kind] = state == NAMED and kind == CLOSE
    return following, unit, point, ends


CLASS = _classes()
NEXT, UNIT, POINT, ENDS = _automaton()
#: The state after two bytes, whatever the state before them.
AFTER_TWO = NEXT[NEXT[START]]
assert all((NEXT[NEXT[s]] == AFTER_TWO).all() for s in range(len(NEXT)))


def transitions(data: np.ndarray, low: int, high: int, starts: np.ndarray) -> np.ndarray:
    """The transition (state and class as one number) of each byte of ``data[low:high]``; ``starts`` are the places where texts begin."""
    kind = CLASS[data[max(0, low - 2) : high]]
    state = np.full(len(kind), START, np.uint8)
    first = starts[np.searchsorted(starts, max(0, low - 2)) : np.searchsorted(starts, high)] - max(0, low - 2)
    state[1:] = AFTER_TWO[kind[:-1], kind[1:]]
    alone = NEXT[START]
    state[:1] = alone[kind[:1]]  # right if a text begins here; else only the state after the next byte is used
    state[first] = alone[kind[first]]
    before = np.full(len(kind), START, np.uint8)
    before[1:] = state[:-1]
    before[first] = START
    return (before * 6 + kind)[low - max(0, low - 2) :]


def count(data: np.ndarray, ends: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First scan: per text the units, code points and sentinels; and per block the units before it. ``ends`` are the texts' ends, with a leading 0."""
    n = len(ends) - 1
    starts = np.unique(ends[:-1])
    sums, units = np.zeros((3, n), np.int64), [0]
    for low in range(0, len(data), block):
        high = min(low + block, len(data))
        moves = transitions(data, low, high, starts)
        a, b = np.searchsorted(ends[1:], low, "right"), np.searchsorted(ends[:-1], high, "left")
        edges = np.clip(ends[a : b + 1], low, high) - low
        for row, table in enumerate((UNIT, POINT, ENDS)):
            marks = table.ravel()[moves]
            upto = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
            sums[row, a:b] += upto[edges[1:]] - upto[edges[:-1]]
            if table is UNIT:
                units.append(units[-1] + int(upto[-1]))
    return sums[0], sums[1], sums[2], np.array(units)


def locate(data: np.ndarray, ends: np.ndarray, units: np.ndarray, wanted: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Second pass: the bytes where the units of the (ascending) ordinals ``wanted`` begin."""
    starts = np.unique(ends[:-1])
    where = np.empty(len(wanted), np.int64)
    held = np.searchsorted(units, wanted, "right") - 1
    for b in np.unique(held):
        low = int(b) * block
        moves = transitions(data, low, min(low + block, len(data)), starts)
        here = held == b
        where[here] = low + np.flatnonzero(UNIT.ravel()[moves])[wanted[here] - units[b]]
    return where


def draws(doc_id: int | None) -> list[int]:
    """h1 to h4: the first four groups of eight hexadecimal digits of the id's digest."""
    digest = hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def write(text: bytes, form: str, a: int, b: int) -> bytes:
    """The output for a text whose middle is ``text[a:b]``."""
    if form == "plain":
        return text
    if form == "psm":
        return b"".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))
    return b"".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))


def restore(output: bytes, form: str) -> bytes:
    """The text that an output was made from; the texts hold no sentinel, and none can arise where one meets a text."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at = output.index(second, len(first))
    end = output.index(MIDDLE, at + len(second))
    one, two, middle = output[len(first) : at], output[at + len(second) : end], output[end + len(MIDDLE) :]
    return b"".join((one, middle, two) if form == "psm" else (two, middle, one))


def _points(data: np.ndarray, low: int, high: int) -> int:
    return sum(int(np.count_nonzero((data[i : min(i + BLOCK, high)] & 0xC0) != 0x80)) for i in range(low, high, BLOCK))


def cut_all(ids: list[int | None], data: np.ndarray, ends: np.ndarray, block: int = BLOCK) -> list[tuple]:
    """``n form prefix_end middle_end prefix_chars middle_chars`` of texts that lie end to end in ``data``; ends are bytes of ``data``."""
    n, _, sentinels, units = count(data, ends, block)
    before = np.concatenate([[0], np.cumsum(n)])
    rows, wanted = [], []
    for i, doc_id in enumerate(ids):
        h = draws(doc_id)
        m = int(n[i])
        low, high = sorted((h[0] % (m + 1), h[1] % (m + 1)))
        plain = not m or sentinels[i] or h[2] % 100 >= CHANGED
        form = "plain" if plain else "spm" if h[3] % 100 < SUFFIX_FIRST else "psm"
        rows.append((m, form))
        if not plain:
            wanted += [(before[i] + k) if k < m else -1 for k in (low, high)]
    places = np.array(wanted, np.int64)
    found = np.full(len(places), -1, np.int64)
    found[places >= 0] = locate(data, ends, units, places[places >= 0], block)
    cuts, out = iter(found.tolist()), []
    for i, (m, form) in enumerate(rows):
        if form == "plain":
            out.append((m, form, None, None, None, None))
            continue
        a, b = (int(ends[i + 1]) if x < 0 else x for x in (next(cuts), next(cuts)))
        out.append((m, form, a, b, _points(data, int(ends[i]), a), _points(data, a, b)))
    return out


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, end to end, and the ends with a leading 0."""
    wide = pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def transform(documents: DataFrame) -> DataFrame:
    """``doc_id n form prefix_chars middle_chars output restored`` of every row (the last two as bytes, ``restored`` from ``output`` and ``form``)."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, ends = _texts(batch.column(1))
            ids = batch.column(0).to_pylist()
            made = []
            for i, (n, form, a, b, x, y) in enumerate(cut_all(ids, data, ends)):
                low = int(ends[i])
                output = write(data[low : ends[i + 1]].tobytes(), form, (a or low) - low, (b or low) - low)
                made.append((ids[i], n, form, x, y, output, restore(output, form)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), kinds)], names=names)

    rows = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return small_batches(rows).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary, restored binary")


def query(documents: DataFrame) -> DataFrame:
    """The digest of op12, a row per document."""
    return transform(documents).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
