"""Substring dedup: every byte inside a 50-byte string that also starts in a document with a smaller id goes.

Candidates first. Winnowing keeps, for each 50-byte window, its smallest 20-byte gram (the rightmost of equals). The choice depends on the window alone,
so equal windows choose equal grams at equal places: a window can only be repeated if its gram is. Windows of one document that chose the same gram form a
snippet of 50 to 80 bytes; equal snippets of a batch are one class with the smallest id. Grams found in one document only are done with.

Then suffixes. A gram with one class left is settled by ids. Where a gram has several snippets, those with a window hash in common go into one
text, whose suffixes are sorted by Lyndon grouping: suffixes are grouped by their longest Lyndon prefix, groups being
processed in descending order while previous-smaller pointers tell which suffixes' prefixes grow; a second pass over the groups, ascending,
emits every group's suffixes in order along the same pointers. No renaming, no recursion, linear in the text. Runs of suffixes that agree in 50 bytes are the
occurrences of one string; the smallest id among them decides for the others.

Documents are dealt into batches by key, and one batch's documents come back to the same batch for each step, so that only gram hashes, snippets of grams that
several documents share, and covered ranges are shuffled besides.

What hashes decide. Snippets with equal 64-bit hashes count as equal, here and between batches, without a look at their bytes (1 in 2 x 10^19 for a pair of different ones). Whether a gram has differing snippets
is told by 39 bits of their hashes, and grams are told apart by 48 bits at first: an error there would leave a window unseen only if all of a gram's differing snippets agree in 39 bits (1 in 5 x 10^11 for a pair).
On ordinary text most repeated bytes are whole copies, which equal snippets settle; the suffix order decides the rest.

Defined cases. Null texts are empty; texts of fewer than 50 bytes lose nothing. A null ``doc_id`` counts as larger than all others; rows with equal ids (or none)
are not smaller than each other, so they don't remove from one another. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_key

LONG, GRAM = 50, 20
SPAN = LONG - GRAM + 1
#: Bytes of text in a batch and in what is hashed at once; gram hashes in a bucket, roughly.
BATCH_BYTES, PIECE_BYTES, BUCKET_GRAMS = 4 << 20, 1 << 19, 600_000
NO_ID = (1 << 63) - 1

#: 48 bits of a gram, 39 of a snippet and a flag; 63 bits would be as good, but these are most of what is shuffled.
_HASH = np.dtype([("high", "<u4"), ("low", "<u2"), ("s", "<u4"), ("t", "u1")])
_CLASS = np.dtype([("a", "<u8"), ("s", "<u8"), ("doc", "<i8"), ("members", "<u4"), ("size", "u1"), ("mixed", "u1")])
_MEMBER = np.dtype([("row", "<u4"), ("start", "<u4")])
_COVER = np.dtype([("row", "<u4"), ("start", "<u4"), ("end", "<u4")])
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_BASE = 0x5851F42D4C957F2D
_UNBASE = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _slide(x: np.ndarray, width: int, least) -> np.ndarray:
    """The least (or greatest) of every ``width`` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        x, done = least(x[:-done], x[done:]), 2 * done
    return least(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def snippets(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Of all texts the winnowed grams: hash ``a``, snippet hash ``s``, ``row`` of the text, ``start`` of the snippet in it, number of windows ``size``."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("a", "s", "row", "start", "size")}
    first = 0
    while first < len(texts):
        last, held = first, 0
        while last < len(texts) and (last == first or held + sizes[last] <= PIECE_BYTES):
            held += sizes[last]
            last += 1
        if held >= LONG:
            for k, v in _snippets(b"".join(texts[first:last]), sizes[first:last]).items():
                out[k].append(v + first if k == "row" else v)
        first = last
    kinds = {"a": np.uint64, "s": np.uint64}
    return {k: np.concatenate(v) if v else np.zeros(0, kinds.get(k, np.int64)) for k, v in out.items()}


def _snippets(raw: bytes, sizes: np.ndarray) -> dict[str, np.ndarray]:
    data = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64)
    n = len(data)
    eight = data[:-1] | data[1:] << np.uint64(8)
    eight = eight[:-2] | eight[2:] << np.uint64(16)
    eight = eight[:-4] | eight[4:] << np.uint64(32)
    grams = n - GRAM + 1
    h = _mix(_mix(eight[:grams] * _M[0]) + eight[8 : 8 + grams] * _M[1] ^ _mix(eight[GRAM - 8 : GRAM - 8 + grams] * _M[2]))
    low = _slide(h, SPAN, np.minimum)
    edge = np.zeros(SPAN - 1, dtype=np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([edge, low, edge]), SPAN, np.maximum) == h)
    value = h[at]
    ends = np.cumsum(sizes)
    row = np.searchsorted(ends, at, side="right")
    begin = ends[row] - sizes[row]
    lo, hi = np.maximum(at - (SPAN - 1), begin), np.minimum(at, ends[row] - LONG)
    for d in range(1, SPAN):
        close = at[d:] - at[:-d] < SPAN
        if not close.any():
            break
        k = np.flatnonzero(close & (value[:-d] < value[d:])) + d
        lo[k] = np.maximum(lo[k], at[k - d] + 1)
        k = np.flatnonzero(close & (value[d:] <= value[:-d]))
        hi[k] = np.minimum(hi[k], at[k + d] - SPAN)
    ok = lo <= hi
    at, value, row, lo, hi, begin = at[ok], value[ok], row[ok], lo[ok], hi[ok], begin[ok]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * _powers(_BASE, n), dtype=np.uint64)])
    s = _mix((total[hi + LONG] - total[lo]) * _powers(_UNBASE, n)[lo] + (at - lo).astype(np.uint64) * _M[0] + (hi - lo).astype(np.uint64) * _M[1])
    return {"a": value, "s": s, "row": row, "start": lo - begin, "size": hi - lo + 1}


def suffix_order(text: bytes) -> list[int]:
    """The suffix array of ``text`` by Lyndon grouping."""
    n = len(text)
    order: list[int] = []
    group, where, size = [0] * n, [0] * n, [0] * (n + 1)
    places: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        places.setdefault(c, []).append(i)
    for c in sorted(places):
        start = len(order)
        size[start] = len(places[c])
        for i in places[c]:
            group[i], where[i] = start, len(order)
            order.append(i)
    smaller = [-1] * n
    end = n
    while end:
        # the largest group not yet processed; all its suffixes share their longest Lyndon prefix so far
        start = group[order[end - 1]]
        hits: dict[int, int] = {}
        for i in sorted(order[start:end]):
            p = i - 1
            while p >= 0 and group[p] >= start:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                hits[p] = hits.get(p, 0) + 1
        # their previous smaller suffixes' prefixes grow by this prefix, as often as it follows; grown ones come last in their group
        grown = list(hits)
        times = 1
        while grown:
            split: dict[int, list[int]] = {}
            for p in grown:
                split.setdefault(group[p], []).append(p)
            for g, moved in split.items():
                k = size[g]
                if len(moved) == k:
                    continue
                to = g + k
                for p in moved:
                    to -= 1
                    other, here = order[to], where[p]
                    order[here], where[other] = other, here
                    order[to], where[p] = p, to
                    group[p] = g + k - len(moved)
                size[g], size[g + k - len(moved)] = k - len(moved), len(moved)
            times += 1
            grown = [p for p in grown if hits[p] >= times]
        end = start
    out, placed = [0] * n, bytearray(n)
    slot = list(range(n + 1))
    for k in range(-1, n):
        i = (out[k] if k >= 0 else n) - 1
        while i >= 0 and not placed[i]:
            placed[i] = 1
            g = group[i]
            out[slot[g]] = i
            slot[g] += 1
            i = smaller[i]
    return out


def _zip(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True) if data else b""


def _unzip(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, codec="zstd", asbytes=True) if size else b""


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts packed one by one, as they are shuffled and read several times."""
    for batch in batches:
        sizes, data = [], []
        for x in batch.column(4):
            text = x.as_py()
            sizes.append(len(text))
            data.append(_zip(text))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], names=["batch", "doc_id", "k1", "k2", "size", "data"])


def _rows_of(table: pa.Table) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Ids (null: NO_ID), texts and the order in which a batch's documents are numbered in every step."""
    ids = table.column("doc_id").fill_null(NO_ID).to_numpy()
    k1, k2 = (table.column(c).to_numpy() for c in ("k1", "k2"))
    order = np.lexsort((k2, k1, ids))
    data, sizes = table.column("data").to_pylist(), table.column("size").to_pylist()
    return ids[order], [_unzip(data[i], sizes[i]) for i in order], order


def _packed(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    by = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], bucket[by][1:] != bucket[by][:-1], [True]])) if len(by) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield int(bucket[by[a]]), [x[by[a:b]].tobytes() for x in arrays]


def _grams(buckets: int):
    """Per bucket the batch's distinct (gram, snippet) hashes; the last bit of ``t``: in more than one document."""

    def run(table: pa.Table) -> pa.Table:
        ids, texts, _ = _rows_of(table)
        x = snippets(texts)
        doc = ids[x["row"]]
        a = x["a"] >> np.uint64(16)
        by = np.lexsort((doc, x["s"], a))
        a, s, doc = a[by], x["s"][by], doc[by]
        new = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        lowest, highest = (np.full(number[-1] + 1 if len(a) else 0, v, np.int64) for v in (NO_ID, -NO_ID))
        np.minimum.at(lowest, number, doc)
        np.maximum.at(highest, number, doc)
        keep = new | np.concatenate([[False], s[1:] != s[:-1]]) if len(a) else new
        found = np.zeros(int(keep.sum()), dtype=_HASH)
        found["high"], found["low"], found["s"] = a[keep] >> np.uint64(16), a[keep] & np.uint64(65535), (s[keep] >> np.uint64(7)).astype(np.uint32)
        found["t"] = (s[keep] & np.uint64(0x7F)) << np.uint64(1) | (lowest < highest)[number[keep]]
        rows = list(_packed((a[keep] % np.uint64(buckets)).astype(np.int64), found))
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int64()), "of": pa.array([table.column("batch")[0].as_py()] * len(rows), pa.int64()), "data": pa.array([d[0] for _, d in rows], pa.binary())})

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """For each batch its grams that more than one document has, and whether their snippets differ."""
    parts = [np.frombuffer(x.as_py(), dtype=_HASH) for x in table.column("data")]
    batch = np.repeat(table.column("of").to_numpy(), [len(p) for p in parts])
    all_ = np.concatenate(parts)
    s = all_["s"].astype(np.uint64) << np.uint64(7) | (all_["t"] >> 1).astype(np.uint64)
    a = all_["high"].astype(np.uint64) << np.uint64(16) | all_["low"].astype(np.uint64)
    by = np.lexsort((s, batch, a))
    a, b, s, many = a[by], batch[by], s[by], (all_["t"][by] & 1).astype(bool)
    new = np.concatenate([[True], a[1:] != a[:-1]])
    starts = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    twice = (np.minimum.reduceat(b, starts) < np.maximum.reduceat(b, starts)) | np.logical_or.reduceat(many, starts)
    mixed = np.minimum.reduceat(s, starts) < np.maximum.reduceat(s, starts)
    keep = twice[number] & np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    rows = list(_packed(b[keep], a[keep] << np.uint64(1) | mixed[number[keep]].astype(np.uint64)))
    return pa.table({"of": pa.array([x for x, _ in rows], pa.int64()), "data": pa.array([d[0] for _, d in rows], pa.binary())})


def _classes(buckets: int):
    """Per bucket the batch's classes of equal snippets with their members; copies within the batch are covered at once."""

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        names = ["bucket", "of", "classes", "members", "size", "texts", "cover"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
        if not table.num_rows or not told.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        batch = table.column("batch")[0].as_py()
        ids, texts, _ = _rows_of(table)
        known = np.sort(np.concatenate([np.frombuffer(x.as_py(), dtype=np.uint64) for x in told.column("data")]))
        x = snippets(texts)
        gram = x["a"] >> np.uint64(16)
        at = np.minimum(np.searchsorted(known >> np.uint64(1), gram), len(known) - 1)
        ok = known[at] >> np.uint64(1) == gram
        x, mixed = {k: v[ok] for k, v in x.items()}, (known[at[ok]] & np.uint64(1)).astype(np.uint8)
        doc = ids[x["row"]]
        by = np.lexsort((doc, x["s"], x["a"]))
        x, mixed, doc = {k: v[by] for k, v in x.items()}, mixed[by], doc[by]
        new = np.concatenate([[True], (x["a"][1:] != x["a"][:-1]) | (x["s"][1:] != x["s"][:-1])])
        starts, number = np.flatnonzero(new), np.cumsum(new) - 1
        later = doc > doc[starts][number]
        cover = np.zeros(int(later.sum()), dtype=_COVER)
        cover["row"], cover["start"] = x["row"][later], x["start"][later]
        cover["end"] = (x["start"] + x["size"] + LONG - 1)[later]
        members = np.zeros(int((~later).sum()), dtype=_MEMBER)
        members["row"], members["start"] = x["row"][~later], x["start"][~later]
        classes = np.zeros(len(starts), dtype=_CLASS)
        for k in ("a", "s", "size"):
            classes[k] = x[k][starts]
        classes["doc"], classes["mixed"], classes["members"] = doc[starts], mixed[starts], np.bincount(number[~later], minlength=len(starts))
        bucket = (classes["a"] >> np.uint64(20)).astype(np.int64) % buckets
        offset = np.concatenate([[0], np.cumsum(classes["members"], dtype=np.int64)])
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1], [True]]))
        rows: list[tuple] = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            own = order[lo:hi]
            mine = np.concatenate([np.arange(offset[c], offset[c + 1]) for c in own])
            content = b"".join(texts[x["row"][starts[c]]][x["start"][starts[c]] : x["start"][starts[c]] + x["size"][starts[c]] + LONG - 1] for c in own if mixed[starts[c]])
            rows.append((int(bucket[own[0]]), batch, classes[own].tobytes(), members[mine].tobytes(), len(content), _zip(content), b""))
        if len(cover):
            rows.append((batch % buckets, batch, b"", b"", 0, b"", cover.tobytes()))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def _window_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all LONG-byte windows, and the number of the text each is in."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8).astype(np.uint64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    count = sizes - LONG + 1
    of = np.repeat(np.arange(len(texts)), count)
    at = begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * _powers(_BASE, len(data)), dtype=np.uint64)])
    return _mix((total[at + LONG] - total[at]) * _powers(_UNBASE, len(data))[at]), of


def first_ids(texts: list[bytes], ids: list[int]) -> list[list[int]]:
    """For every LONG-byte window of every text the smallest id of a text that has it, by the suffix order of all texts joined."""
    joined = b"".join(texts)
    owner: list[int] = []  # the text of each place where a window starts, else -1
    for k, t in enumerate(texts):
        owner += [k] * (len(t) - LONG + 1) + [-1] * (LONG - 1)
    begin, out = [0], [[0] * (len(t) - LONG + 1) for t in texts]
    for t in texts:
        begin.append(begin[-1] + len(t))
    run: list[int] = []
    before = None
    for i in [*suffix_order(joined), -1]:
        if i >= 0 and owner[i] < 0:
            continue
        window = joined[i : i + LONG] if i >= 0 else None
        if window != before and run:
            best = min(ids[owner[j]] for j in run)
            for j in run:
                out[owner[j]][j - begin[owner[j]]] = best
            run = []
        run.append(i)
        before = window
    return out


def _settle(table: pa.Table) -> pa.Table:
    """The covered ranges that a bucket's classes tell, by batch."""
    found: dict[int, list[np.ndarray]] = {}
    parts, members, of, content = [], [], [], []
    for b, c, m, size, t, cover in zip(*(table.column(k).to_pylist() for k in ("of", "classes", "members", "size", "texts", "cover"))):
        t = _unzip(t, size)
        if cover:
            found.setdefault(b, []).append(np.frombuffer(cover, dtype=_COVER))
        if c:
            part = np.frombuffer(c, dtype=_CLASS)
            parts.append(part)
            members.append(np.frombuffer(m, dtype=_MEMBER))
            of.append(np.full(len(part), b))
            at = 0
            for mixed, windows in zip(part["mixed"].tolist(), part["size"].tolist()):
                content.append(t[at : at + windows + LONG - 1] if mixed else b"")
                at += windows + LONG - 1 if mixed else 0
    if parts:
        classes, member, of = np.concatenate(parts), np.concatenate(members), np.concatenate(of)
        offset = np.concatenate([[0], np.cumsum(classes["members"], dtype=np.int64)])
        by = np.lexsort((classes["doc"], classes["s"], classes["a"]))
        a, s, doc = (classes[k][by] for k in ("a", "s", "doc"))
        new_a = np.concatenate([[True], a[1:] != a[:-1]])
        new_s = new_a | np.concatenate([[False], s[1:] != s[:-1]])
        heads, kind = np.flatnonzero(new_s), np.cumsum(new_s) - 1  # snippets, each with its smallest id first
        whole = doc > doc[heads][kind]
        picked, span = [by[whole]], [np.stack([np.zeros(int(whole.sum()), np.int64), classes["size"][by[whole]] + LONG - 1], axis=1)]
        # grams with several snippets
        gram = (np.cumsum(new_a) - 1)[heads]
        several = np.flatnonzero((np.bincount(gram) > 1)[gram] & (classes["mixed"][by[heads]] > 0))
        covered: dict[int, list[int]] = {}
        if len(several):
            texts = [content[c] for c in by[heads[several]].tolist()]
            hashes, text = _window_hashes(texts)
            g = gram[several][text]
            near = np.lexsort((text, hashes, g))
            same = (hashes[near][1:] == hashes[near][:-1]) & (g[near][1:] == g[near][:-1]) & (text[near][1:] != text[near][:-1])
            shared = np.zeros(len(hashes), dtype=bool)
            shared[near[1:][same]] = shared[near[:-1][same]] = True
            # of each snippet what its shared windows span
            at = np.arange(len(hashes)) - np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))])[text]
            low, high = np.full(len(texts), 255), np.full(len(texts), -1)
            np.minimum.at(low, text[shared], at[shared])
            np.maximum.at(high, text[shared], at[shared])
            ids = doc[heads[several]].tolist()
            use = np.flatnonzero(high >= 0)
            cuts = np.flatnonzero(np.concatenate([[True], gram[several][use][1:] != gram[several][use][:-1], [True]])) if len(use) else np.zeros(1, np.int64)
            for x, y in zip(cuts[:-1], cuts[1:]):
                own = use[x:y].tolist()
                # what many documents share is the same between unlike neighbours: one text with the smallest id stands for equal ones
                least: dict[bytes, int] = {}
                for k in own:
                    part = texts[k][low[k] : high[k] + LONG]
                    least[part] = min(ids[k], least.get(part, NO_ID))
                first = dict(zip(least, first_ids(list(least), list(least.values()))))
                for k in own:
                    covered[int(several[k])] = [int(low[k]), *first[texts[k][low[k] : high[k] + LONG]]]
        # classes of a snippet that is no gram's only one: its windows whose first id is smaller than the class's
        for k in np.flatnonzero(np.isin(kind, list(covered))).tolist() if covered else []:
            if whole[k]:
                continue
            low_, *first = covered[int(kind[k])]
            ranges: list[list[int]] = []
            for w, f in enumerate(first, low_):
                if f < doc[k]:
                    if ranges and w <= ranges[-1][1]:
                        ranges[-1][1] = w + LONG
                    else:
                        ranges.append([w, w + LONG])
            if ranges:
                picked.append(np.full(len(ranges), by[k]))
                span.append(np.array(ranges, dtype=np.int64))
        chosen, span = np.concatenate(picked), np.concatenate(span)
        count = classes["members"][chosen].astype(np.int64)
        which = np.repeat(np.arange(len(chosen)), count)
        mine = offset[chosen][which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        cover = np.zeros(len(mine), dtype=_COVER)
        cover["row"] = member["row"][mine]
        for side, name in enumerate(("start", "end")):
            cover[name] = member["start"][mine] + span[which, side]
        for b, (data,) in _packed(of[chosen][which], cover):
            found.setdefault(b, []).append(np.frombuffer(data, dtype=_COVER))
    batches = sorted(found)
    return pa.table({"of": pa.array(batches, pa.int64()), "cover": pa.array([np.concatenate(found[b]).tobytes() for b in batches], pa.binary())})


def _cut(with_text: bool):
    """The batch's documents without the covered ranges."""

    def run(table: pa.Table, covers: pa.Table) -> pa.Table:
        _, texts, order = _rows_of(table)
        cover = np.concatenate([np.zeros(0, _COVER), *(np.frombuffer(x.as_py(), dtype=_COVER) for x in covers.column("cover"))])
        cover = cover[np.lexsort((cover["start"], cover["row"]))]
        bounds = np.searchsorted(cover["row"], np.arange(len(texts) + 1))
        out = []
        for k, text in enumerate(texts):
            spans: list[list[int]] = []
            for start, end in zip(*(cover[c][bounds[k] : bounds[k + 1]].tolist() for c in ("start", "end"))):
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], end)
                else:
                    spans.append([start, end])
            kept = b"".join(text[a:b] for (_, a), (b, _) in zip([[0, 0], *spans], [*spans, [len(text), 0]])) if spans else text
            out.append((len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), *([kept, [x for s in spans for x in s]] if with_text else [])))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64())]
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
        columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds[: 6 if with_text else 4]]
        return pa.table([table.column("doc_id").take(pa.array(order)), *columns], names=["doc_id", *names[: len(columns)]])

    return run


def dedup_substrings(documents: DataFrame, with_text: bool = True) -> DataFrame:
    """``doc_id n_bytes n_removed n_spans kept_sha256`` of every row and, ``with_text``, the bytes ``kept`` and the removed ``spans`` (start, end, start, ...)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    total = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    batches, buckets = max(1, math.ceil(total / BATCH_BYTES)), max(8, math.ceil(total / 13 / BUCKET_GRAMS))
    k1, k2 = text_key(text)
    rows = documents.select(F.col("doc_id").cast("long"), k1.alias("k1"), k2.alias("k2"), text.cast("binary").alias("text"))
    rows = rows.select(F.pmod(F.xxhash64("doc_id", "k1", "k2"), F.lit(batches)).cast("long").alias("batch"), "doc_id", "k1", "k2", "text")
    rows = small_batches(rows).mapInArrow(_zipped, "batch long, doc_id long, k1 long, k2 long, size long, data binary")
    hashes = rows.groupBy("batch").applyInArrow(_grams(buckets), "bucket long, of long, data binary")
    told = hashes.groupBy("bucket").applyInArrow(_repeated, "of long, data binary")
    classes = rows.groupBy("batch").cogroup(told.groupBy("of")).applyInArrow(_classes(buckets), "bucket long, of long, classes binary, members binary, size long, texts binary, cover binary")
    covers = classes.groupBy("bucket").applyInArrow(_settle, "of long, cover binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, spans array<long>" * with_text
    return rows.groupBy("batch").cogroup(covers.groupBy("of")).applyInArrow(_cut(with_text), schema)


def query(documents: DataFrame) -> DataFrame:
    """The digest of op4, a row per document."""
    return dedup_substrings(documents.select("doc_id", "text"), with_text=False)
