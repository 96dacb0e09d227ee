"""Sums and row blocks exchanged between the tasks of a barrier stage.

The tasks find each other through the barrier's own ``allGather``, once; that call takes about a second, so what is exchanged in every step goes over
connections to the first task instead. All tasks get the same numbers in the same order of additions. If a task is lost, the others fail on
their connections and Spark runs the whole stage again.
"""

from __future__ import annotations

import numpy as np

#: Rows whose order is settled at once in :func:`in_order`.
CHUNK_ROWS = 65_536


class Alone:
    """One task that has all rows."""

    rank, size = 0, 1

    def gather(self, block: np.ndarray) -> list[np.ndarray]:
        return [block]

    def sum(self, x: np.ndarray) -> np.ndarray:
        return x

    def close(self) -> None:
        pass


class Link:
    """The tasks of a barrier stage; each has to make the same calls in the same order. ``secret`` is a key that all of them know."""

    def __init__(self, context, secret: bytes) -> None:
        from multiprocessing.connection import Client, Listener

        self.rank, tasks = context.partitionId(), context.getTaskInfos()
        self.size, self.peers, self.hub, self.door = len(tasks), [], None, None
        if not self.rank:
            self.door = Listener(("", 0), backlog=self.size, authkey=secret)
        port = context.allGather(str(self.door.address[1]) if self.door else "")[0]
        if self.rank:
            self.hub = Client((tasks[0].address.rsplit(":", 1)[0] or "localhost", int(port)), authkey=secret)
            self.hub.send(self.rank)
        else:
            found = {}
            for _ in range(self.size - 1):
                peer = self.door.accept()
                found[peer.recv()] = peer
            self.peers = [found[r] for r in sorted(found)]

    def gather(self, block: np.ndarray) -> list[np.ndarray]:
        """The blocks of all tasks, by rank."""
        if self.hub:
            self.hub.send(block)
            return self.hub.recv()
        blocks = [block, *(p.recv() for p in self.peers)]
        for p in self.peers:
            p.send(blocks)
        return blocks

    def sum(self, x: np.ndarray) -> np.ndarray:
        """The sum of all tasks' arrays of one shape."""
        if self.hub:
            self.hub.send(x)
            return self.hub.recv()
        total = x.copy()
        for p in self.peers:
            total += p.recv()
        for p in self.peers:
            p.send(total)
        return total

    def collect(self, x):
        """What all tasks have, by rank, at the first task; None at the others."""
        if self.hub:
            self.hub.send(x)
            return None
        return [x, *(p.recv() for p in self.peers)]

    def tell(self, x=None):
        """What the first task says."""
        if self.hub:
            return self.hub.recv()
        for p in self.peers:
            p.send(x)
        return x

    def close(self) -> None:
        for c in (*self.peers, self.hub, self.door):
            if c is not None:
                c.close()


def place_rows(link: Alone | Link, at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """All ``n`` rows of a batch in order; this task has those at the places ``at``."""
    if link.size == 1:
        return rows
    out = np.empty((n, rows.shape[1]))
    for block in link.gather(np.column_stack([at, rows])):
        out[block[:, 0].astype(np.int64)] = block[:, 1:]
    return out


def _cuts(keys: np.ndarray, order: np.ndarray, n: int) -> list[int]:
    """Where a task's sorted keys change from one chunk of all tasks' rows to the next."""
    chunks = max(1, -(-n // CHUNK_ROWS))
    edges = [-(2**63) + (2**64 * i) // chunks for i in range(1, chunks)]
    return [0, *np.searchsorted(keys[order], np.array(edges, dtype=np.int64)).tolist(), len(order)]


def in_order(link: Alone | Link, keys: np.ndarray, n: int):
    """Blocks of (task, row) in the order of all tasks' 64-bit keys together, about CHUNK_ROWS rows each; keys have to be spread evenly."""
    order = np.argsort(keys, kind="stable")
    cuts = _cuts(keys, order, n)
    for a, b in zip(cuts[:-1], cuts[1:]):
        blocks = link.gather(np.column_stack([keys[order[a:b]], order[a:b]]))
        rank = np.repeat(np.arange(len(blocks)), [len(x) for x in blocks])
        both = np.concatenate(blocks)
        first = np.argsort(both[:, 0], kind="stable")  # of equal keys the lower rank
        yield np.column_stack([rank, both[:, 1]])[first]


def rows_in_order(link: Link, keys: np.ndarray, rows: np.ndarray, n: int):
    """The rows themselves in the order of :func:`in_order`, at the first task; the others only send theirs."""
    order = np.argsort(keys, kind="stable")
    cuts = _cuts(keys, order, n)
    for a, b in zip(cuts[:-1], cuts[1:]):
        found = link.collect((keys[order[a:b]], rows[order[a:b]]))
        if found is not None:
            first = np.argsort(np.concatenate([k for k, _ in found]), kind="stable")
            yield np.concatenate([x for _, x in found])[first]
