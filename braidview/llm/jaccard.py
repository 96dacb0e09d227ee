"""N-gram Jaccard join and its components, exact at a similarity of 0.8, by set-relation skipping.

A document's set is its distinct five-word shingles. Sets are compared by prefix: under any fixed order of shingles, linked sets of n shingles share one of
their first n - ceil(0.8 n) + 1. The order here is by the number of sets that have a shingle, counted over all documents, then by hash; a set with enough shingles of its own
enters no index list that any other set meets. The index list of a shingle holds the sets with it in their prefix, with their size and the shingle's position.

* Lists are skipped by position. A set of n shingles that meets another at position p shares n - p of them at most from there on. Lists are sorted by size and
  cut into blocks; a block whose extremes of size and position reach no other block is skipped as a whole, and so are then the entries that reach no other entry.
* Answers are derived from those of a similar set. What is left of a list is cut where sizes leave a gap of more than 20 %; each part has a hub, its set with the smallest mixed id, which near copies have in
  common in most of their lists. All sets of a hub are compared with it, which gives their overlap with it and their differences from it. The overlap of two of them follows from the hub's
  answers and the differences alone: |S and T| = |H| - |H without S| - |H without T| + |what differs from H alike in both|. No two sets are compared that the hub has connected already, or whose
  distances to it differ by more than 0.2 (1 - similarity is a metric).
* A hub with more than ``GROUP`` sets has them in several parts. Within a part everything is compared as said; across parts only the sets that aren't in the component which is the largest
  around the hub go to the other parts.

This gives the components, and enough links to connect each of them; links inside a component aren't counted one by one.

Defined cases. Null and empty texts have the empty set, are linked with nothing and are their own component. A text of one to four words has one shingle, the whole
sequence. Rows are told apart by their text, so repeated ids are no matter; a component whose ids are all null has a null ``component_id``. Only
``doc_id`` and ``text`` are read. Sets are known by 64 bits of hash, as are shingles; in index lists shingles are known by the bucket and 32 more bits, which can only add entries.
A single document is never split: its set has to fit a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, small_batches, stored, text_key
from .graph import components

SIZE, PERCENT = 5, 80
#: Bytes of text in a batch, and of text whose words are hashed at once.
BATCH_BYTES, HOLD_BYTES = 4 << 20, 1 << 20
#: Entries of a bucket, at most about (each batch sends a shingle once); sets of a hub, and shingles of theirs, that are compared in one part.
BUCKET_POSTINGS, GROUP, GROUP_SHINGLES = 1 << 20, 2000, 1_000_000
#: Entries of a list's block.
BLOCK = 32
#: Set ids that a task remembers, to send the text of copies once.
REMEMBERED = 200_000
#: At most so many keys (16 bytes each) are broadcast; beyond, they are joined by a shuffle.
BROADCAST_KEYS = 1_000_000

POSTING = np.dtype([("token", "<u4"), ("id", "<i8"), ("n", "<u4"), ("at", "<u4")])
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_STEPS = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ...; the longest ones are kept."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        _POWERS[base] = np.cumprod(out, dtype=np.uint64)
    return _POWERS[base][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each text (UTF-8) the sorted distinct hashes of its shingles."""
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", dtype=np.uint8)  # bytes.lower() touches A-Z alone
    space = _SPACE[data]
    before = np.concatenate([[True], space[:-1]])
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), dtype=np.uint64)])
    words = _mix((total[ends] - total[starts]) * _powers(_UNBASE, len(data))[starts] + (ends - starts).astype(np.uint64))
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
    full = len(words) - SIZE + 1
    grams = _mix(sum((words[j : j + full] * np.uint64(_STEPS[j]) for j in range(SIZE)), np.zeros(1, np.uint64))) if full > 0 else words[:0]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= SIZE:
            yield np.unique(grams[a : b - SIZE + 1])
        elif b > a:
            some = words[a:b] * np.array(_STEPS[: b - a], dtype=np.uint64)
            yield _mix(np.array([some.sum(dtype=np.uint64) + np.uint64(b - a)]))
        else:
            yield words[:0]


def set_id(s: np.ndarray) -> int:
    """64 bits that stand for a set."""
    return int(_mix(np.array([_mix(s * np.uint64(_STEPS[1])).sum(dtype=np.uint64) + np.uint64(len(s))]))[0].astype(np.int64))


def needed(n: np.ndarray) -> np.ndarray:
    """The overlap that a set of ``n`` needs with any linked set."""
    return -(-PERCENT * n // 100)


def linked(inter: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * inter >= PERCENT * (a + b - inter)


def _texts(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts, about HOLD_BYTES each."""
    for batch in batches:
        held, first, size = [], 0, 0
        for k, x in enumerate(batch.column(at)):
            held.append((x.as_py() or "").encode("utf-8", "surrogatepass"))
            size += len(held[-1])
            if size >= HOLD_BYTES:
                yield batch.slice(first, k + 1 - first), held
                held, first, size = [], k + 1, 0
        if held:
            yield batch.slice(first), held


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id`` and ``n`` of each document's set; the packed text with the first of its copies in the task."""
    seen: set[int] = set()
    for batch, texts in _texts(batches, 3):
        ids, sizes, data = [], [], []
        for t, s in zip(texts, shingle_sets(texts)):
            ids.append(set_id(s) if len(s) else None)
            sizes.append(len(s))
            new = len(s) and ids[-1] not in seen
            data.append(pa.compress(t, codec="zstd", asbytes=True) if new else None)
            if new:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(ids[-1])
        size = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), size, pa.array(data, pa.binary())], names=["doc_id", "k1", "k2", "id", "n", "size", "data"])


def _keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    k1, k2 = text_key(text)
    return documents.select(F.col("doc_id").cast("long"), k1.alias("k1"), k2.alias("k2"), text.alias("text"))


def survey(documents: DataFrame) -> DataFrame:
    """``doc_id k1 k2 id n`` of all rows, and ``size data``, the packed text, of one row at least for each id."""
    return stored(small_batches(_keyed(documents)).mapInArrow(_survey, "doc_id long, k1 long, k2 long, id long, n long, size long, data binary"), "sets")


def _sets(table: pa.Table) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """id, bytes, packed text and set of a table's rows, equal ids once."""
    seen: set[int] = set()
    held: list[tuple[int, int, bytes]] = []
    texts: list[bytes] = []

    def out() -> Iterator[tuple[int, int, bytes, np.ndarray]]:
        for x, s in zip(held, shingle_sets(texts)):
            yield *x, s
        held.clear()
        texts.clear()

    total = 0
    for me, size, data in zip(table.column("id").to_pylist(), table.column("size").to_pylist(), table.column("data")):
        if me in seen:
            continue
        seen.add(me)
        held.append((me, size, data.as_py()))
        texts.append(pa.decompress(held[-1][2], size, codec="zstd", asbytes=True))
        total += size
        if total >= HOLD_BYTES:
            yield from out()
            total = 0
    if held:
        yield from out()


def _cuts(x: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal neighbours."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, np.int64)


def _buckets(shingles: int) -> int:
    """Bits of a shingle's hash that are its bucket."""
    return min(32, max(3, math.ceil(math.log2(max(shingles, 1) / BUCKET_POSTINGS + 1))))


def _tokens(bits: int):
    """Per bucket the batch's shingles, 32 bits each, with the number of its sets that have them (nothing if it is one for all)."""
    shift = np.uint64(32 - bits)

    def run(table: pa.Table) -> pa.Table:
        token, n = np.unique(np.concatenate([s for *_, s in _sets(table)]) >> shift, return_counts=True)
        bucket = (token >> np.uint64(32)).astype(np.int64)
        cuts = _cuts(bucket).tolist()
        low, n = token.astype(np.uint32), np.minimum(n, 255).astype(np.uint8)
        spans = list(zip(cuts[:-1], cuts[1:]))
        counts = [b"" if n[a:b].max() == 1 else pa.compress(n[a:b].tobytes(), codec="zstd", asbytes=True) for a, b in spans]
        own = table.column("batch")[0].as_py()
        return pa.table({
            "bucket": pa.array(bucket[cuts[:-1]], pa.int64()), "of": pa.array([own] * len(spans), pa.int64()),
            "tokens": pa.array([low[a:b].tobytes() for a, b in spans], pa.binary()), "counts": pa.array(counts, pa.binary()),
        })

    return run


def _add_up(table: pa.Table) -> pa.Table:
    """For each batch the numbers of sets that have its shingles of the bucket, in its order, 255 for more."""
    parts = [np.frombuffer(x.as_py(), dtype=np.uint32) for x in table.column("tokens")]
    own = [np.frombuffer(pa.decompress(x.as_py(), len(p), codec="zstd", asbytes=True), dtype=np.uint8) if len(x.as_py()) else np.ones(len(p), np.uint8) for x, p in zip(table.column("counts"), parts)]
    tokens = np.concatenate(parts)
    by = np.argsort(tokens, kind="stable")
    new = np.concatenate([[True], tokens[by[1:]] != tokens[by[:-1]]])
    total = np.add.reduceat(np.concatenate(own)[by].astype(np.int64), np.flatnonzero(new))
    many = np.empty(len(tokens), dtype=np.uint8)
    many[by] = np.minimum(total, 255).astype(np.uint8)[np.cumsum(new) - 1]
    ends = np.cumsum([len(p) for p in parts]).tolist()
    data = [pa.compress(many[a:b].tobytes(), codec="zstd", asbytes=True) for a, b in zip([0, *ends], ends)]
    return pa.table({"of": table.column("of"), "bucket": table.column("bucket"), "size": pa.array([len(p) for p in parts], pa.int64()), "data": pa.array(data, pa.binary())})


def _index(bits: int):
    """Per bucket the prefixes of the batch's sets, what no other set has left out; and the packed texts of the sets that are in any."""
    shift = np.uint64(32 - bits)
    schema = pa.schema([("bucket", pa.int64()), ("postings", pa.binary()), ("id", pa.int64()), ("size", pa.int64()), ("data", pa.binary())])

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows:
            return schema.empty_table()
        rows = list(_sets(table))
        sets = [s for *_, s in rows]
        ends = np.cumsum([len(s) for s in sets])
        starts = ends - [len(s) for s in sets]
        everything = np.concatenate(sets)
        tokens, inverse = np.unique(everything >> shift, return_inverse=True)
        order = np.argsort(told.column("bucket").to_numpy())
        sizes, data = told.column("size").to_pylist(), told.column("data").to_pylist()
        many = np.concatenate([np.frombuffer(pa.decompress(data[i], sizes[i], codec="zstd", asbytes=True), dtype=np.uint8) for i in order.tolist()])
        if len(many) != len(tokens):
            raise ValueError("a batch's shingles and their numbers don't match")
        many = many[inverse]
        n = ends - starts
        prefix = n - needed(n) + 1
        held, live = [np.empty(0, dtype=POSTING)], []
        for k in np.flatnonzero(np.add.reduceat(many == 1, starts) < prefix).tolist():
            part = many[starts[k] : ends[k]]
            first = np.argsort(part, kind="stable")[: prefix[k]]  # of equal numbers the smaller hash is first
            shared = np.flatnonzero(part[first] > 1)
            post = np.empty(len(shared), dtype=POSTING)
            post["token"], post["id"], post["n"], post["at"] = 0, rows[k][0], n[k], shared
            held.append((post, tokens[inverse[starts[k] + first[shared]]]))
            live.append(rows[k][:3])
        all_ = np.concatenate([held[0], *(p for p, _ in held[1:])])
        token = np.concatenate([np.zeros(0, np.uint64), *(t for _, t in held[1:])])
        all_["token"] = token.astype(np.uint32)
        bucket = (token >> np.uint64(32)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        bucket, all_ = bucket[by], all_[by]
        cuts = _cuts(bucket).tolist()
        lists = [all_[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
        none = [None] * len(lists)
        nothing = [None] * len(live)
        columns = [bucket[cuts[:-1]].tolist() + nothing, lists + nothing, *(none + [x[c] for x in live] for c in range(3))]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _most_before(value: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """In each run the greatest value so far."""
    run = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts)) << 34
    return np.maximum.accumulate(value + run) - run


def _reaching(all_: np.ndarray) -> np.ndarray:
    """Which entries of lists (sorted by token, size) reach another entry of their list: sharing, from their positions on, enough for a link.

    Entries x and y reach each other if the smaller of what is left of either from its position on would do:
    180 min(n_x - at_x, n_y - at_y) >= 80 (n_x + n_y), that is n_y <= top_x and n_x <= top_y with top = 2.25 (n - at) - n.
    """
    n = all_["n"].astype(np.int64)
    top = (100 + PERCENT) * (n - all_["at"].astype(np.int64)) // PERCENT - n
    cuts = _cuts(all_["token"])
    inside = np.arange(len(n)) - np.repeat(cuts[:-1], np.diff(cuts))
    number = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    # blocks: a list's entries by BLOCK; they are in order of their least size
    heads = np.flatnonzero(inside % BLOCK == 0)
    of = number[heads]
    least, highest = n[heads], np.maximum.reduceat(top, heads)
    best = _most_before(highest, _cuts(of))
    at = np.searchsorted((of << 34) + least, (of << 34) + np.clip(highest, 0, (1 << 34) - 1), side="right") - 1  # the last block whose least size the block's best reaches
    start = _cuts(of)[:-1][np.cumsum(np.concatenate([[True], of[1:] != of[:-1]])) - 1] if len(of) else of
    good = (at >= start) & (best[np.maximum(at, 0)] >= least)
    kept = np.flatnonzero(np.repeat(good, np.diff(np.append(heads, len(n)))))
    if not len(kept):
        return kept
    # entries of the blocks that are left: the two best tops among the entries up to the size that an entry reaches, as it may itself be the best one
    n, top, number = n[kept], top[kept], number[kept]
    cuts = _cuts(number)
    first = _most_before(top, cuts)
    starts = np.repeat(cuts[:-1], np.diff(cuts))
    shifted = np.concatenate([[-1], first[:-1]])
    shifted[cuts[:-1]] = -(1 << 33)
    second = _most_before(np.minimum(top, shifted), cuts)
    at = np.searchsorted((number << 34) + n, (number << 34) + np.clip(top, 0, (1 << 34) - 1), side="right") - 1
    there = at >= starts
    at = np.maximum(at, 0)
    mine = (at >= np.arange(len(n))) & (first[at] == top)  # itself is among them, and best
    return kept[there & (np.where(mine, second[at], first[at]) >= n)]


def _hubs(table: pa.Table) -> pa.Table:
    """``a n hub``: the sets of the bucket's lists that reach another one there, with the hub of their part of the list."""
    all_ = np.concatenate([np.frombuffer(x.as_py(), dtype=POSTING) for x in table.column("postings")])
    all_ = all_[np.lexsort((all_["at"], all_["id"], all_["token"]))]
    all_ = all_[np.concatenate([[True], (all_["token"][1:] != all_["token"][:-1]) | (all_["id"][1:] != all_["id"][:-1])])]
    all_ = all_[np.lexsort((all_["at"], all_["n"], all_["token"]))]
    all_ = all_[_reaching(all_)]
    n = all_["n"].astype(np.int64)
    gap = np.concatenate([[True], (all_["token"][1:] != all_["token"][:-1]) | (100 * n[:-1] < PERCENT * n[1:])]) if len(n) else np.zeros(0, bool)
    cuts = np.flatnonzero(np.concatenate([gap, [True]]))
    part = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    hub = all_["id"][np.lexsort((_mix(all_["id"].astype(np.uint64)), part))[cuts[:-1]]][part]
    rows = np.unique(np.stack([all_["id"], n, hub], axis=1)[all_["id"] != hub], axis=0) if len(n) else np.zeros((0, 3), np.int64)
    return pa.table({c: pa.array(rows[:, k], pa.int64()) for k, c in enumerate(("a", "n", "hub"))})


class _Forest:
    """Sets known to be connected."""

    def __init__(self, n: int) -> None:
        self.root, self.links = np.arange(n), []

    def join(self, i: int, j: int) -> None:
        a, b = int(self.root[i]), int(self.root[j])
        if a != b:
            self.links.append((i, j))
            self.root[self.root == max(a, b)] = min(a, b)


class _Overlaps:
    """Overlaps of one of some arrays of distinct values with a run of them."""

    def __init__(self, arrays: list[np.ndarray]) -> None:
        self.ends = np.cumsum([len(x) for x in arrays])
        self.starts = self.ends - [len(x) for x in arrays]
        values, codes = np.unique(np.concatenate(arrays), return_inverse=True)
        self.codes, self.mark = codes, np.zeros(len(values), dtype=bool)
        self.totals = np.zeros(len(codes) + 1, dtype=np.int64)

    def of(self, i: int, low: int, high: int) -> np.ndarray:
        mine = self.codes[self.starts[i] : self.ends[i]]
        self.mark[mine] = True
        a, b = self.starts[low], self.ends[high - 1]
        np.cumsum(self.mark[self.codes[a:b]], out=self.totals[1 : b - a + 1])
        self.mark[mine] = False
        return self.totals[self.ends[low:high] - a] - self.totals[self.starts[low:high] - a]


def _around_hub(hub: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect whatever is linked among a hub (0) and the sets around it (from 1), derived from the sets' differences from the hub."""
    n = np.array([len(hub), *(len(s) for s in sets)], dtype=np.int64)
    here = [np.minimum(np.searchsorted(hub, s), len(hub) - 1) for s in sets]
    there = [hub[at] == s for at, s in zip(here, sets)]
    inter = np.array([len(hub), *(int(x.sum()) for x in there)], dtype=np.int64)
    forest = _Forest(len(n))
    close = np.flatnonzero(linked(inter, n, n[0]))
    forest.root[close] = 0
    forest.links += [(i, 0) for i in close[1:].tolist()]
    apart = np.flatnonzero(forest.root)
    if not len(apart) or len(sets) < 2:
        return forest.links
    # sets in order of their distance to the hub
    far = 1 - inter / (n + n[0] - inter)
    order = np.argsort(far[1:], kind="stable") + 1
    lacking = n[0] - inter
    differ = []
    for i in order.tolist():
        lacks = np.ones(len(hub), dtype=bool)
        lacks[here[i - 1][there[i - 1]]] = False
        differ.append(np.concatenate([hub[lacks], sets[i - 1][~there[i - 1]]]))
    derived = sum(map(len, differ)) < n[1:].sum()
    overlaps = _Overlaps(differ if derived else [sets[i - 1] for i in order.tolist()])
    place = np.empty(len(n), dtype=np.int64)
    place[order] = np.arange(len(order))
    far, reach = far[order], 1 - PERCENT / 100 + 1e-9
    for i in apart.tolist():
        k = int(place[i])
        low, high = np.searchsorted(far, far[k] - reach), np.searchsorted(far, far[k] + reach, side="right")
        others = order[low:high]
        if (forest.root[others] == forest.root[i]).all():
            continue
        common = overlaps.of(k, low, high) + (n[0] - lacking[i] - lacking[others] if derived else 0)
        for j in others[linked(common, n[i], n[others]) & (forest.root[others] != forest.root[i])].tolist():
            forest.join(i, j)
    return forest.links


def _link_table(links: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})


def _spans(x: np.ndarray) -> dict[tuple, np.ndarray]:
    """Rows of equal keys together."""
    by = np.lexsort(x[::-1])
    cuts = np.flatnonzero(np.concatenate([[True], (x[:, by[1:]] != x[:, by[:-1]]).any(axis=0), [True]])) if len(by) else np.zeros(1, np.int64)
    return {tuple(x[:, by[a]].tolist()): by[a:b] for a, b in zip(cuts[:-1], cuts[1:])}


def _keys(table: pa.Table, *names: str) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in names])


def _known_sets(*tables: pa.Table) -> dict[int, np.ndarray]:
    return {me: s for t in tables for me, _, _, s in _sets(t)}


def _within(members: pa.Table, hubs: pa.Table) -> pa.Table:
    """``a b``: links that connect what is linked among the sets of a hub's part and the hub."""
    found = []
    if members.num_rows:
        sets, ids = _known_sets(members, hubs), members.column("id").to_numpy()
        for (hub, _), at in _spans(_keys(members, "hub", "part")).items():
            names = [hub, *ids[at].tolist()]
            found += [(names[i], names[j]) for i, j in _around_hub(sets[hub], [sets[x] for x in names[1:]])]
    return _link_table(found)


def _across(visitors: pa.Table, members: pa.Table) -> pa.Table:
    """``a b``: links that connect the visitors with what they are linked to in a part, as far as it isn't connected yet."""
    found = []
    if visitors.num_rows and members.num_rows:
        sets = _known_sets(visitors, members)
        hosts = _spans(_keys(members, "hub", "part", "share"))
        for key, at in _spans(_keys(visitors, "hub", "part", "share")).items():
            if key not in hosts:
                continue
            names = [*visitors.column("id").to_numpy()[at].tolist(), *members.column("id").to_numpy()[hosts[key]].tolist()]
            roots = np.concatenate([visitors.column("root").to_numpy()[at], members.column("root").to_numpy()[hosts[key]]])
            n = np.array([len(sets[x]) for x in names], dtype=np.int64)
            forest, overlaps = _Forest(len(names)), _Overlaps([sets[x] for x in names])
            forest.root = np.unique(roots, return_inverse=True)[1]
            for i in range(len(at)):
                if (forest.root[len(at) :] != forest.root[i]).any():
                    common = overlaps.of(i, len(at), len(names))
                    for j in (len(at) + np.flatnonzero(linked(common, n[i], n[len(at) :]) & (forest.root[len(at) :] != forest.root[i]))).tolist():
                        forest.join(i, j)
            found += [(names[i], names[j]) for i, j in forest.links]
    return _link_table(found)


def links(documents: DataFrame, known: DataFrame) -> DataFrame:
    """``a b``: enough links between sets that every component is connected; ``known`` is the :func:`survey` of the documents."""
    packed = known.where("data is not null")
    shingles, size = packed.agg(F.sum("n"), F.sum("size")).first()
    if not shingles:
        return documents.sparkSession.createDataFrame([], "a long, b long")
    batches, bits = max(1, math.ceil(size / BATCH_BYTES)), _buckets(shingles)
    rows = packed.select(F.pmod(F.xxhash64("id"), F.lit(batches)).cast("long").alias("batch"), "id", "size", "data")  # copies meet in a batch
    counts = rows.groupBy("batch").applyInArrow(_tokens(bits), "bucket long, of long, tokens binary, counts binary")
    told = counts.groupBy("bucket").applyInArrow(_add_up, "of long, bucket long, size long, data binary")
    files = max(8, batches)  # there are no more groups to work on, so fewer tasks lose nothing
    index = rows.groupBy("batch").cogroup(told.groupBy("of")).applyInArrow(_index(bits), "bucket long, postings binary, id long, size long, data binary")
    index = stored(index.coalesce(files), "index")
    texts = index.where("id is not null").select("id", "size", "data")
    again = texts.toDF(*texts.columns)  # for the other side of a cogroup
    around = index.where("bucket is not null").select("bucket", "postings").groupBy("bucket").applyInArrow(_hubs, "a long, n long, hub long")
    around = stored(around.distinct().coalesce(files), "around")
    width = around.groupBy("hub").agg(F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n") / GROUP_SHINGLES)).cast("int").alias("parts"))
    total, most = around.agg(F.sum("n")).first()[0] or 0, width.agg(F.max("parts")).first()[0] or 0
    groups = max(1, math.ceil(total / GROUP_SHINGLES))
    placed = around.join(width, "hub").select("hub", F.col("a").alias("id"), F.pmod(F.xxhash64("a"), "parts").cast("int").alias("part"), "parts")
    group = F.pmod(F.xxhash64("hub", "part"), F.lit(groups)).alias("group")
    members = placed.join(texts, "id").select("hub", "part", "id", "size", "data", group)
    hubs = width.select(F.col("hub").alias("id"), F.col("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).join(again, "id").select("id", "size", "data", group)
    found = stored(members.groupBy("group").cogroup(hubs.groupBy("group")).applyInArrow(_within, "a long, b long").coalesce(max(8, groups)), "links")
    if most > 1:
        roots = components(found)
        rooted = placed.where("parts > 1").join(roots, F.col("id") == F.col("node"), "left").select("hub", "id", "part", "parts", F.coalesce("root", "id").alias("root"))
        rooted = stored(rooted, "rooted")
        main = rooted.groupBy("hub", "root").agg(F.count("*").alias("many")).groupBy("hub").agg(F.max(F.struct("many", "root"))["root"].alias("main"))
        others = rooted.join(main, "hub").where("root <> main").drop("main")
        # visitors of a part, in shares
        share = others.groupBy("hub").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("shares"))
        visits = others.join(share, "hub").select("hub", "id", "root", F.col("part").alias("own"), F.pmod(F.xxhash64("id", F.lit(5)), "shares").cast("int").alias("share"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        hosts = rooted.join(share, "hub").select("hub", "id", "root", "part", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
        names = ["hub", "part", "share", "id", "root", "size", "data", F.pmod(F.xxhash64("hub", "part", "share"), F.lit(groups)).alias("group")]
        came, there = visits.where("part <> own").join(texts, "id").select(*names), hosts.toDF(*hosts.columns).join(again, "id").select(*names)
        more = stored(came.groupBy("group").cogroup(there.groupBy("group")).applyInArrow(_across, "a long, b long").coalesce(max(8, groups)), "links")
        drop_stored(rooted)
        found = found.unionByName(more)
    drop_stored(index)
    drop_stored(around)
    return found


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def classes(documents: DataFrame) -> DataFrame:
    """``doc_id k1 k2 id n_shingles component_id`` of every row; ``id`` stands for the set."""
    known = survey(documents)
    found = links(documents, known)
    roots = stored(components(found), "roots")
    drop_stored(found)
    named = known.join(_small(roots), known["id"] == roots["node"], "left").select("doc_id", "k1", "k2", "id", "n", F.coalesce("root", "id").alias("root"))
    # most documents are alone; the others' roots are few enough to be sent along, or are joined by a shuffle
    least = stored(named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("many")).where("many > 1").select("root", "least"), "least")
    joined = named.join(_small(least), "root", "left")
    return joined.select(
        "doc_id", "k1", "k2", "id", F.col("n").alias("n_shingles"), F.when(least["root"].isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")
    )


def keep_one(documents: DataFrame) -> DataFrame:
    """The rows of ``documents``, unchanged, but for those whose component has a smaller ``doc_id``."""
    gone = stored(classes(documents).where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "k1", "k2").distinct(), "gone")
    k1, k2 = text_key(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), k1.alias("k1"), k2.alias("k2"))
    same = (rows["k1"] == gone["k1"]) & (rows["k2"] == gone["k2"]) & rows["id"].eqNullSafe(gone["doc_id"])
    return rows.join(_small(gone), same, "left_anti").select("row.*")


def query(documents: DataFrame) -> DataFrame:
    """The digest of op10, a row per document."""
    return classes(documents.select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
