"""Studies of several profiles: a Spark data source over folders of long delimited records, and the views that they make.

A study is a folder with a folder (or a file) a profile, each with delimited records ``sample feature value`` and a header, and perhaps ``clinical`` with a row a sample.
``spark.read.format("study")`` reads them as ``profile sample feature value``. A file is cut at line ends into partitions of about ``SPLIT_BYTES``; profiles that the option
``profiles`` doesn't name aren't opened, nor are those that a filter on ``profile`` leaves out where the session pushes filters to Python sources; samples and features are whole numbers where the heads of all files say so, texts otherwise. What isn't a number is a null value. Lines may not
hold line breaks.

Any store that pyarrow opens can hold the folder; all tasks have to reach it.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyarrow import csv
from pyarrow import fs as stores
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from ..operators.relational import align_views, clean_numbers
from ..operators.wide import sparse_rows

SPLIT_BYTES, HEAD_BYTES = 32 << 20, 1 << 16
#: Features of a profile that become columns at most; beyond, a profile is a sparse column.
MOST_COLUMNS = 2_000
CLINICAL = "clinical"


def _open(path: str) -> tuple[stores.FileSystem, str]:
    return stores.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (stores.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, str, int]]:
    """Profile, file and bytes of all files of a study, but for hidden ones, markers and the clinical table."""
    store, root = _open(path)
    root = root.rstrip("/")
    found = []
    for f in store.get_file_info(stores.FileSelector(root, recursive=True)):
        inside = f.path.rsplit(root + "/", 1)[-1].split("/")
        profile = inside[0].split(".")[0]
        if f.type == stores.FileType.File and f.size and profile != CLINICAL and not any(p.startswith((".", "_")) for p in inside):
            found.append((profile, f.path, f.size))
    return sorted(found)


def _lines(store: stores.FileSystem, path: str, start: int, end: int) -> bytes:
    """The lines that begin in bytes [start, end) of a file."""
    with store.open_input_file(path) as f:
        if start:
            f.seek(start - 1)
            _to_line_end(f)
        else:
            f.seek(0)
        first = f.tell()
        if first >= end:
            return b""
        block = f.read(end - first)
        return block if block.endswith(b"\n") else block + _to_line_end(f)


def _to_line_end(f) -> bytes:
    found = []
    while piece := f.read(4096):
        cut = piece.find(b"\n")
        if cut >= 0:
            f.seek(f.tell() - len(piece) + cut + 1)
            return b"".join([*found, piece[: cut + 1]])
        found.append(piece)
    return b"".join(found)


def _table(head: bytes, lines: bytes, names: Sequence[str], delimiter: str) -> pa.Table:
    data = lines if lines.startswith(head) else head + lines
    options = csv.ConvertOptions(include_columns=list(names), column_types={n: pa.string() for n in names}, strings_can_be_null=True)
    return csv.read_csv(io.BytesIO(data), read_options=csv.ReadOptions(use_threads=False), parse_options=csv.ParseOptions(delimiter=delimiter), convert_options=options)


class Split(InputPartition):
    def __init__(self, profile: str, path: str, start: int, end: int) -> None:
        self.profile, self.path, self.start, self.end = profile, path, start, end


class StudySource(DataSource):
    """Options: ``path``; ``profiles`` (names with commas between them); ``sample``, ``feature``, ``value`` (the columns' names in the files), ``delimiter``, ``split`` (bytes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "study"

    @property
    def names(self) -> list[str]:
        return [self.options.get(n, n) for n in ("sample", "feature", "value")]

    def schema(self) -> str:
        kinds = {"sample": "bigint", "feature": "bigint"}
        store, _ = _open(self.options["path"])
        for _, path, size in _files(self.options["path"]):
            with store.open_input_file(path) as f:
                head = f.read(min(size, HEAD_BYTES))
            line, _, rest = head.partition(b"\n")
            table = _table(line + b"\n", rest if len(head) == size else rest[: rest.rfind(b"\n") + 1], self.names, self.options.get("delimiter", ","))
            for kind, column in zip(kinds, table.columns):
                if not all(x is None or (x.isascii() and x.lstrip("-").isdigit() and len(x) < 19) for x in column.to_pylist()):
                    kinds[kind] = "string"
        return f"profile string, sample {kinds['sample']}, feature {kinds['feature']}, value double"

    def reader(self, schema) -> StudyReader:
        return (FilteredReader if self.options.get("filtered") == "true" else StudyReader)(self.options, self.names, schema)


class StudyReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str], names: Sequence[str], schema) -> None:
        self.path, self.delimiter, self.names, self.schema = options["path"], options.get("delimiter", ","), list(names), schema
        self.split, self.profiles = int(options.get("split", SPLIT_BYTES)), set(options["profiles"].split(",")) if "profiles" in options else None

    def partitions(self) -> list[Split]:
        chosen = [x for x in _files(self.path) if self.profiles is None or x[0] in self.profiles]
        return [Split(profile, path, a, min(a + self.split, size)) for profile, path, size in chosen for a in range(0, size, self.split)] or [Split("", "", 0, 0)]

    def read(self, part: Split) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        store, _ = _open(self.path)
        with store.open_input_file(part.path) as f:
            head = _to_line_end(f)
        lines = _lines(store, part.path, part.start, part.end)
        if part.start == 0 and len(lines) <= len(head):
            return
        if not lines:
            return
        table = _table(head, lines, self.names, self.delimiter)
        columns = [pa.array([part.profile] * len(table), pa.string())]
        for field, column in zip(self.schema.fields[1:], table.columns):
            x = column.combine_chunks()
            if field.dataType.simpleString() == "bigint":
                x = pa.array(pd.to_numeric(x.to_pandas(), errors="coerce").astype("Int64"), pa.int64())
            elif field.name == "value":
                x = pa.array(pd.to_numeric(x.to_pandas(), errors="coerce").astype("float64"), pa.float64(), from_pandas=True)
            columns.append(x)
        yield from pa.Table.from_arrays(columns, names=["profile", "sample", "feature", "value"]).to_batches(max_chunksize=65_536)


class FilteredReader(StudyReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on ``profile`` choose the files; the others are left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("profile",):
                chosen = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.profiles = chosen if self.profiles is None else self.profiles & chosen
            else:
                yield f


def read_study(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """``profile sample feature value`` of a study's records."""
    spark.dataSource.register(StudySource)
    filtered = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")  # Spark refuses a reader of filters where it sends none
    return spark.read.format("study").options(path=path, filtered=filtered, **options).load()


def profile_view(records: DataFrame, profile: str, features: Sequence[object] | None = None) -> tuple[DataFrame, list[str]]:
    """A profile as a row a sample (the mean of repeated records), with a column ``<profile>_<feature>`` for each of ``features`` or of all that it has; and these names."""
    own = records.where(F.col("profile") == profile)
    if features is None:
        features = [r["feature"] for r in own.select("feature").where("feature is not null").distinct().orderBy("feature").limit(MOST_COLUMNS + 1).collect()]
        if len(features) > MOST_COLUMNS:
            raise ValueError(f"{profile} has more than {MOST_COLUMNS} features: take sparse_profile or name some")
    wide = own.groupBy("sample").pivot("feature", list(features)).agg(F.avg("value"))
    names = [f"{profile}_{f}" for f in features]
    return wide.toDF("sample", *names), names


def sparse_profile(records: DataFrame, profile: str) -> DataFrame:
    """A profile of any number of features (whole numbers) as one sparse column a sample, named as the profile."""
    cells = records.where((F.col("profile") == profile) & F.col("feature").isNotNull() & F.col("value").isNotNull()).groupBy("sample", "feature").agg(F.avg("value").alias("value"))
    return sparse_rows(cells, ["sample"], "feature", "value", profile)


def study_views(spark: SparkSession, path: str, features: Mapping[str, Sequence[object] | None], outcome: str | None = None, **options: str) -> tuple[DataFrame, dict[str, list[str]]]:
    """The samples that all profiles (and the clinical table) have, with the columns of all views, gaps as 0, and the outcome as a number; and the views' columns."""
    records = read_study(spark, path, profiles=",".join(features), **options)
    tables, views = [], {}
    if outcome is not None:
        clinical = spark.read.csv(f"{path.rstrip('/')}/{CLINICAL}", header=True).select(F.col(options.get("sample", "sample")).cast(records.schema["sample"].dataType).alias("sample"), F.col(outcome).alias("outcome"))
        tables.append(clean_numbers(clinical, ["outcome"]))
    for profile, wanted in features.items():
        table, views[profile] = profile_view(records, profile, wanted)
        tables.append(table)
    return align_views(tables, "sample"), views
