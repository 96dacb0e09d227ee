"""A Merkle manifest of a data set: a leaf per row, a tree per group, a tree over the groups' roots, and a proof per row.

A digest is lowercase hex SHA-256; digests are hashed as their hex text. A row's leaf hashes its fields, each ``-`` if null, else its UTF-8 byte
count, ``:`` and its value. In a tree every two consecutive nodes become their common digest, a last single one its own, until one node remains.

Rows are sorted by ranges of group and order and checkpointed, so that partitions stay as they are; the sizes of each partition's groups give
every row its place. A partition makes all complete aligned subtrees of its places alone. What is left at its ragged ends, two nodes a level at
most, is shuffled by the coordinate of a common ancestor, which finishes the upper levels. The siblings above come back to the partition, which
makes its subtrees again and returns a proof for each row. A large group is many partitions; no partition has much more than ``LEAVES_A_PART`` rows.

Defined cases. A null ``lang`` is a group of its own, before all others. Null ids come first in their group; rows of equal id are
ordered by leaf, equal rows in any order (all have the same leaf). Empty tables give no rows. Only the five columns of ``documents`` are read,
whatever other columns are named. A row whose id is null is never tampered with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from .common import checkpoint_folder, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of a sorted partition, as aimed at, and how few make a partition of their own when cores are free.
LEAVES_A_PART, LEAST_LEAVES = 32_768, 4_096
#: Levels that the first round of upper levels finishes, and each further one: bounds the nodes that a task of it gets.
FIRST_LEVELS, MORE_LEVELS = 26, 11
#: At most so many runs (a partition's rows of one group) are sent to all executors; beyond, they are joined by shuffle.
SENT_RUNS = 500
#: Rows of a batch that carries proofs.
PROOF_ROWS = 2_000
PROOF = "array<struct<sibling string, left boolean>>"
NODE = ("_part", "_g", "level", "idx", "hash", "n")
NODE_TYPE = "_part long, _g string, level int, idx long, hash string, n long"


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*fields: Column) -> Column:
    """The leaf of a row of these fields."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*told), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings of its proof lead to."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.when(s["left"], F.concat(s["sibling"], h)).otherwise(F.concat(h, s["sibling"])), 256))


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return max(0, n - 1).bit_length()


def grow(first: int, leaves: list[str], n: int) -> list[tuple[int, list[str]]]:
    """Per level, the first place and the digests of what can be made from the leaves at ``first``, ``first + 1``, ... of a tree of ``n``."""
    levels, nodes = [(first, leaves)], leaves
    while n > 1 and nodes:
        odd = first & 1  # its sibling is in an earlier partition
        alone = first + len(nodes) == n and n & 1
        made = [_digest(nodes[i] + nodes[i + 1]) for i in range(odd, len(nodes) - 1, 2)]
        if alone:
            made.append(_digest(nodes[-1]))
        first, n, nodes = (first + odd) >> 1, (n + 1) >> 1, made
        levels.append((first, nodes))
    return levels


def ragged(levels: list[tuple[int, list[str]]], n: int) -> Iterator[tuple[int, int, str]]:
    """``level place digest`` of the nodes whose parent isn't among ``levels``."""
    for level, (first, nodes) in enumerate(levels):
        up, above = levels[level + 1] if level + 1 < len(levels) else (0, [])
        at_ends = {0, len(nodes) - 1} if nodes else set()
        for i in sorted(at_ends):
            if not up <= (first + i) >> 1 < up + len(above):
                yield level, first + i, nodes[i]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Consecutive rows of one ``_part`` and ``_g``, as a table each."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        parts, groups = batch.column("_part").to_pylist(), batch.column("_g").to_pylist()
        start = 0
        for i, now in enumerate(zip(parts, groups)):
            if now != key:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, key, start = [], now, i
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in _runs(batches):
        part, g, first, n = (run.column(c)[0].as_py() for c in ("_part", "_g", "_first", "_n"))
        found = list(ragged(grow(first, run.column("hash").to_pylist(), n), n))
        level, idx, digest = zip(*found)
        k = len(found)
        columns = [pa.array([part] * k, pa.int64()), pa.array([g] * k, pa.string()), pa.array(level, pa.int32()), pa.array(idx, pa.int64()), pa.array(digest, pa.string()), pa.array([n] * k, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=list(NODE))


def _proofs(siblings: list[list[str]], lefts: list[list[bool]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, siblings)])
    flat = pa.StructArray.from_arrays([pa.array([s for x in siblings for s in x], pa.string()), pa.array([s for x in lefts for s in x], pa.bool_())], names=["sibling", "left"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def _closed(cap: int):
    """A function of all ragged nodes below one node of level ``cap`` (or below the root of a lower tree): their paths up to it, and its digest."""

    def run(table: pa.Table) -> pa.Table:
        n, levels, places = table.column("n")[0].as_py(), table.column("level").to_pylist(), table.column("idx").to_pylist()
        top = min(cap, height(n))
        known: list[dict[int, str]] = [{} for _ in range(top + 1)]
        for level, i, digest in zip(levels, places, table.column("hash").to_pylist()):
            known[level][i] = digest
        size = [((n - 1) >> level) + 1 for level in range(top + 1)]
        for level in range(top):
            below = known[level]
            for i in below:
                if i >> 1 not in known[level + 1]:
                    left = i & ~1
                    known[level + 1][i >> 1] = _digest(below[left] + (below[left + 1] if left + 1 < size[level] else ""))
        siblings = [[known[h].get((i >> (h - level)) ^ 1, "") for h in range(level, top)] for level, i in zip(levels, places)]
        lefts = [[bool((i >> (h - level)) & 1) for h in range(level, top)] for level, i in zip(levels, places)]
        at = [i >> (top - level) for level, i in zip(levels, places)]
        more = {"path": _proofs(siblings, lefts), "up_level": pa.array([top] * len(at), pa.int32()), "up_idx": pa.array(at, pa.int64()), "up_hash": pa.array([known[top][i] for i in at], pa.string())}
        return pa.Table.from_arrays([*(table.column(c).combine_chunks() for c in NODE), *more.values()], names=[*NODE, *more])

    return run


def finish(nodes: DataFrame, tallest: int, cap: int = FIRST_LEVELS, more: int = MORE_LEVELS) -> DataFrame:
    """``nodes`` (columns NODE) with ``path``, the siblings on the way to their tree's root, and ``top``, that root."""
    low = nodes.where(F.col("level") <= cap)
    lid = F.least(F.lit(cap), F.ceil(F.log2(F.greatest(F.col("n"), F.lit(1)).cast("double"))).cast("int") + 1)  # an ancestor's level, at or above the top
    # a level too many only means that the block is a whole tree; the function finds its top
    low = low.withColumn("_lid", F.greatest(lid, F.col("level"))).withColumn("_block", F.expr("shiftright(idx, _lid - level)"))
    low = stored(low.groupBy("_g", "_block").applyInArrow(_closed(cap), f"{NODE_TYPE}, path {PROOF}, up_level int, up_idx long, up_hash string"), "merkle-nodes")
    if tallest <= cap:
        return low.select(*NODE, "path", F.col("up_hash").alias("top"))
    tops = low.select(F.lit(-1).cast("long").alias("_part"), "_g", F.col("up_level").alias("level"), F.col("up_idx").alias("idx"), F.col("up_hash").alias("hash"), "n").distinct()
    above = finish(nodes.where(F.col("level") > cap).unionByName(tops), tallest, cap + more, more)
    way = above.where("_part < 0").select("_g", F.col("level").alias("up_level"), F.col("idx").alias("up_idx"), F.col("path").alias("_more"), "top")
    way = low.join(way, ["_g", "up_level", "up_idx"]).select(*NODE, F.concat("path", "_more").alias("path"), "top")
    return way.unionByName(above.where("_part >= 0").select(*NODE, "path", "top"))


def _with_runs(placed: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Each row with its run's columns; a run's rows stay together and in order."""
    if runs.count() <= SENT_RUNS:
        return placed.join(F.broadcast(runs), ["_part", "_g"])
    joined = placed.join(runs, ["_part", "_g"])  # a run has a bounded number of rows
    return joined.repartition("_part").sortWithinPartitions("_part", *keys)


def _prove(kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches):
            first, n = (table.column(c)[0].as_py() for c in ("_first", "_n"))
            top, root = (table.column(c)[0].as_py() for c in ("_top", "_root"))
            above = {(e["level"], e["idx"]): e["path"] for e in table.column("_ends")[0].as_py()}
            levels = grow(first, table.column("hash").to_pylist(), n)
            for start in range(0, table.num_rows, PROOF_ROWS):
                piece = table.slice(start, PROOF_ROWS).combine_chunks()
                siblings, lefts = [], []
                for i in range(first + start, first + start + piece.num_rows):
                    mine, sides, level = [], [], 0
                    while (level, i) not in above:
                        low, nodes = levels[level]
                        at = (i ^ 1) - low
                        mine.append(nodes[at] if at < len(nodes) else "")
                        sides.append(bool(i & 1))
                        i, level = i >> 1, level + 1
                    rest = above[level, i]
                    siblings.append(mine + [e["sibling"] for e in rest])
                    lefts.append(sides + [e["left"] for e in rest])
                k = piece.num_rows
                columns = [piece.column(c).combine_chunks() for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([top] * k, pa.string()), pa.array([root] * k, pa.string()), _proofs(siblings, lefts)], names=[*kept, "subroot", "root", "proof"])

    return run


def trees(leaves: DataFrame, order: list[str], over_groups: bool = True, leaves_a_part: int = LEAVES_A_PART, levels: tuple[int, int] = (FIRST_LEVELS, MORE_LEVELS)) -> DataFrame:
    """``leaves`` (``_g`` group, never null; ``hash``; any others) with ``subroot``, ``root`` and ``proof``.

    A tree for each group, its leaves by ``order`` and then by ``hash``; with ``over_groups`` a tree over the groups' roots in the order of ``_g``, else ``root`` is ``subroot``.
    """
    spark = leaves.sparkSession
    checkpoint_folder(spark)
    kept = leaves.columns
    total = leaves.count()
    parts = max(1, -(-total // leaves_a_part), min(spark.sparkContext.defaultParallelism, total // LEAST_LEAVES))
    keys = ["_g", *order, "hash", "_tie"]
    rows = leaves.withColumn("_tie", F.monotonically_increasing_id())  # many equal rows can be dealt to several partitions
    placed = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id().cast("long")).checkpoint()
    before = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy("_part", "_g").agg(F.count("*").alias("_m"))
    runs = runs.select("_part", "_g", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_first"), F.sum("_m").over(Window.partitionBy("_g")).alias("_n"))
    runs = stored(runs, "merkle-runs")
    tallest = height(runs.agg(F.max("_n")).first()[0] or 0)
    nodes = _with_runs(placed.select("_part", *keys), runs, keys).mapInArrow(_ends, NODE_TYPE)
    ends = finish(nodes, tallest, *levels)
    if over_groups:
        roots = trees(ends.select(F.lit("").alias("_g"), F.col("_g").alias("_of"), F.col("top").alias("hash")).distinct(), ["_of"], False, leaves_a_part, levels)
        roots = roots.select(F.col("_of").alias("_g"), "root", F.col("proof").alias("_more"))
        ends = ends.join(roots, "_g").withColumn("path", F.concat("path", "_more"))
    else:
        ends = ends.withColumn("root", F.col("top"))
    ends = ends.groupBy("_part", "_g").agg(F.collect_list(F.struct("level", "idx", "path")).alias("_ends"), F.min("top").alias("_top"), F.min("root").alias("_root"))  # two a level at most
    runs = stored(runs.join(ends, ["_part", "_g"]), "merkle-ends")
    types = StructType([*(placed.schema[c] for c in kept), StructField("subroot", StringType()), StructField("root", StringType()), StructField("proof", _parse_datatype_string(PROOF))])
    return _with_runs(placed, runs, keys).mapInArrow(_prove(kept), types)


def group_key(group: Column) -> Column:
    """A text that is never null and orders as ``group`` does, with null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def tampered_leaf(documents: DataFrame) -> Column:
    """The leaf after tampering adds 1 to ``n_chars``, for the ids that tampering reaches; else null."""
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    reached = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return F.when(reached, leaf_of(*(more if c == "n_chars" else documents[c] for c in FIELDS)))


def manifest(documents: DataFrame, **sizes) -> DataFrame:
    """``doc_id leaf tampered subroot root proof`` of every row; ``tampered`` is the leaf after tampering, or null."""
    leaves = documents.select("doc_id", group_key(F.col("lang")).alias("_g"), leaf_of(*(F.col(c) for c in FIELDS)).alias("hash"), tampered_leaf(documents).alias("tampered"))
    # written once, without the texts: the sort reads them twice
    return trees(stored(leaves, "merkle-leaves"), ["doc_id"], **sizes).select("doc_id", F.col("hash").alias("leaf"), "tampered", "subroot", "root", "proof")


def query(documents: DataFrame, **sizes) -> DataFrame:
    """The digest of op11, a row per document."""
    rows = manifest(documents.select(*FIELDS), **sizes)
    folded = fold(F.coalesce("tampered", "leaf"), F.col("proof"))
    rows = rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(F.transform("proof", lambda s: s["sibling"]), ""), 256).alias("proof_sha256"), folded.alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
