"""Landed payload files as a Spark data source with pruning.

A fetcher leaves one file for each payload:
``<root>/<board>/<yyyy-mm-dd>/<role>-<cell>-<payload>[-<token>].<ext>``. The
source reads them as rows (role_id, source, search_cell, payload_id, token, day,
body). Comparisons on ``source`` and ``day`` are pushed down to it: only the
folders that can match are listed, in the tasks, and no file of another folder is
opened. A partition is a board's day, or one of ``splits`` equal parts of it.

Files are opened by pyarrow's file systems, which the root's scheme must be one
of; files that end in ``.gz`` are unpacked.

    payload_files.register(spark)
    spark.read.format("payload_files").option("path", root).load().where("source = 'remotive' AND day >= DATE'2024-01-20'")
"""

from __future__ import annotations

import datetime as dt
import gzip
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull,
    LessThan, LessThanOrEqual,
)

SCHEMA = "role_id int, source string, search_cell int, payload_id long, token string, day date, body string"
NAME = re.compile(r"(\d+)-(\d+)-(\d+)(?:-([^.]*))?\.[a-z]+(?:\.gz)?$")
#: Bytes of bodies in one batch, about.
BATCH_BYTES = 8 << 20


def file_system(root: str) -> tuple[pafs.FileSystem, str]:
    root = re.sub(r"^file:/+", "/", root)
    return pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)


class Day(InputPartition):
    """One part of a board's day."""

    def __init__(self, source: str, day: dt.date, part: int):
        self.source, self.day, self.part = source, day, part


class PayloadReader(DataSourceReader):
    def __init__(self, root: str, splits: int):
        self.root, self.splits = root, splits
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes all comparisons on ``source`` and ``day``; Spark keeps the rest."""
        for f in filters:
            kinds = (EqualTo, EqualNullSafe, In, IsNotNull, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
            if isinstance(f, kinds) and tuple(f.attribute) in (("source",), ("day",)):
                self.tests.append(f)
            else:
                yield f

    def _matches(self, column: str, value) -> bool:
        for f in self.tests:
            if f.attribute[0] != column or isinstance(f, IsNotNull):
                continue
            if isinstance(f, In):
                ok = value in f.value
            elif f.value is None:
                ok = False
            else:
                ok = {EqualTo: value == f.value, EqualNullSafe: value == f.value, GreaterThan: value > f.value,
                      GreaterThanOrEqual: value >= f.value, LessThan: value < f.value, LessThanOrEqual: value <= f.value}[type(f)]
            if not ok:
                return False
        return True

    def partitions(self) -> list[Day]:
        """The folders that can match; files are listed in the tasks."""
        fs, root = file_system(self.root)
        out = []
        for board in _folders(fs, root):
            if self._matches("source", board):
                for name in _folders(fs, f"{root}/{board}"):
                    if re.fullmatch(r"\d{4}-\d\d-\d\d", name) and self._matches("day", day := dt.date.fromisoformat(name)):
                        out += [Day(board, day, part) for part in range(self.splits)]
        return out

    def read(self, partition: Day | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no folder matches
            return
        fs, root = file_system(self.root)
        rows, size = [], 0
        for info in fs.get_file_info(pafs.FileSelector(f"{root}/{partition.source}/{partition.day}")):
            found = NAME.match(info.base_name)
            if not found or zlib.crc32(info.base_name.encode()) % self.splits != partition.part:
                continue
            with fs.open_input_stream(info.path, compression=None) as f:
                data = f.read()
            body = (gzip.decompress(data) if info.base_name.endswith(".gz") else data).decode("utf-8", "replace")
            role, cell, payload, token = found.groups()
            rows.append((int(role), partition.source, int(cell), int(payload), token, partition.day, body))
            size += len(data)
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _folders(fs: pafs.FileSystem, path: str) -> list[str]:
    infos = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted(i.base_name for i in infos if i.type == pafs.FileType.Directory)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.date32(), pa.string()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class PayloadFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "payload_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PayloadReader:
        return PayloadReader(self.options["path"], int(self.options.get("splits", "1")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PayloadFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, root: str, boards: list[str], first_day: dt.date | None = None, splits: int = 1) -> DataFrame:
    """Payloads of some boards, from a day on."""
    register(spark)
    df = spark.read.format("payload_files").option("path", root).option("splits", str(splits)).load()
    df = df.filter(df["source"].isin(list(boards)))
    return df if first_day is None else df.filter(df["day"] >= first_day)


def write(payloads: DataFrame, root: str, extension: str) -> None:
    """Payload rows (role_id, source, search_cell, payload_id, token, day, body)
    as files, from the tasks: what a fetcher leaves."""
    def store(rows):
        fs, base = file_system(root)
        for r in rows:
            if r["body"] is not None:
                folder = f"{base}/{r['source']}/{r['day']}"
                fs.create_dir(folder, recursive=True)
                name = f"{r['role_id']}-{r['search_cell']}-{r['payload_id']}" + (f"-{r['token']}" if r["token"] else "")
                with fs.open_output_stream(f"{folder}/{name}.{extension}", compression=None) as f:
                    f.write(r["body"].encode())

    payloads.select("role_id", "source", "search_cell", "payload_id", "token", "day", "body").foreachPartition(store)
