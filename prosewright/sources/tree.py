"""Files below a folder, with folders pruned before they are listed and old files before they are opened.

``Tree`` is a Spark data source whose rows are blocks of files.  The driver opens folders from the top only until there are enough to share
out; tasks list the rest, so a tree of many folders is never listed in one place.  A folder named in ``without`` is not opened at all.
What is read of the blocks is dealt out anew by their places, so a folder that holds most of the files, or a file that is most of
the data, is read by many tasks.

Any store that Arrow can open will do (a plain path, ``file:``, ``hdfs:``, ``s3:``, …).  A folder that is not there is an error; one that vanishes while it is listed is empty.
"""

from __future__ import annotations

import datetime
import io
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ENTRY = "path string, size long, modified timestamp, start long, end long"
LINE = "path string, modified timestamp, offset long, text string"
BLOCK_BYTES = 64 << 20
SHARED_FOLDERS = 64
BATCH_BYTES = 4 << 20


def opened(store: fs.FileSystem, folder: str, missing_ok: bool = True) -> list[fs.FileInfo]:
    """What lies in one folder."""
    return store.get_file_info(fs.FileSelector(folder, recursive=False, allow_not_found=missing_ok))


class Folder(InputPartition):
    """One folder: its own files, or with ``deep`` all below it."""

    def __init__(self, folder: str, deep: bool):
        super().__init__(None)
        self.folder, self.deep = folder, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("the tree's path is missing")
        self.path = options["path"]
        self.without = {w for w in options.get("without", "").split(",") if w}
        self.suffixes = tuple("." + s.lower() for s in options.get("suffixes", "").split(",") if s)
        self.block = int(options.get("blockbytes", BLOCK_BYTES))
        self.enough = int(options.get("folders", SHARED_FOLDERS))
        since = options.get("since")
        self.since = datetime.datetime.fromisoformat(since).replace(tzinfo=datetime.UTC) if since else None

    def _below(self, store: fs.FileSystem, folder: str, missing_ok: bool = True) -> list[str]:
        return [e.path for e in opened(store, folder, missing_ok) if e.type == fs.FileType.Directory and e.base_name not in self.without]

    def partitions(self) -> list[Folder]:
        store, top = fs.FileSystem.from_uri(self.path)
        shallow, front = [], [top]
        first = True
        while front and len(front) < self.enough:
            below = [d for f in front for d in self._below(store, f, missing_ok=not first)]
            shallow, front, first = shallow + front, below, False
        return [Folder(f, False) for f in shallow] + [Folder(f, True) for f in front]

    def read(self, partition: Folder) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.path)
        folders = [partition.folder]
        while folders:
            for e in opened(store, folders.pop()):
                if e.type == fs.FileType.Directory:
                    if partition.deep and e.base_name not in self.without:
                        folders.append(e.path)
                elif e.type == fs.FileType.File and e.path.lower().endswith(self.suffixes or "") and (self.since is None or e.mtime >= self.since):
                    for start in range(0, max(e.size, 1), self.block):
                        yield e.path, e.size, e.mtime, start, min(e.size, start + self.block)


class Tree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> TreeReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})


def entries(spark: SparkSession, path: str, without: Iterable[str] = (), suffixes: Iterable[str] = (), since: str | None = None, **options) -> DataFrame:
    """(path, size, modified, start, end): the blocks of all files, those before ``since`` (ISO time, UTC) left out; an empty file is one block."""
    spark.dataSource.register(Tree)
    told = {"without": ",".join(without), "suffixes": ",".join(suffixes), **({"since": since} if since else {}), **{k: str(v) for k, v in options.items()}}
    return spark.read.format("tree").options(**told).load(path)


def _lines_of(source, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Lines that begin in the block, each with its place; the last may run on beyond the block's end."""
    at = start
    if start:  # a line that began earlier is the earlier block's
        source.seek(start - 1)
        at = start - 1 + len(source.readline())
    while at < end:
        row = source.readline()
        if not row:
            return
        yield at, row
        at += len(row)


def lines(blocks: DataFrame, path: str, tasks: int | None = None) -> DataFrame:
    """(path, modified, offset, text) of every line of the blocks; ``offset`` is its place in the file in bytes.

    Lines end with a line feed, a carriage return before it is not part of the text; bytes that are no UTF-8 become the mark
    of such.  Memory holds one batch of some megabytes and the longest line.
    """
    schema = pa.schema([("path", pa.string()), ("modified", pa.timestamp("us", tz="UTC")), ("offset", pa.int64()), ("text", pa.string())])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(path)
        rows, held = [], 0
        for batch in batches:
            for b in batch.to_pylist():
                with io.BufferedReader(store.open_input_file(b["path"]), 1 << 20) as source:
                    for at, row in _lines_of(source, b["start"], b["end"]):
                        text = row.removesuffix(b"\n").removesuffix(b"\r").decode("utf-8", "replace")
                        rows.append((b["path"], b["modified"], at, text))
                        held += len(row) + 64
                        if held >= BATCH_BYTES:
                            yield packed(rows)
                            rows, held = [], 0
        if rows:
            yield packed(rows)

    own = blocks.select("path", "modified", "start", "end")
    n = tasks or int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return own.repartition(n, "path", "start").mapInArrow(read, LINE)


def documents(spark: SparkSession, path: str, without: Iterable[str] = (), suffixes: Iterable[str] = (), since: str | None = None) -> DataFrame:
    """(path, format, modified, raw) of whole files, as ``formats.read_documents`` gives them; a file is held whole in the task that reads it."""
    files = entries(spark, path, without, suffixes, since, blockBytes=1 << 62).select("path", "modified")
    schema = "path string, format string, modified timestamp, raw string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            for b in batch.to_pylist():
                with store.open_input_file(b["path"]) as source:
                    raw = source.read().decode("utf-8", "replace")
                name = b["path"].rsplit("/", 1)[-1]
                kind = name.rsplit(".", 1)[-1].lower() if "." in name else ""
                yield pa.RecordBatch.from_pydict({"path": [b["path"]], "format": [kind], "modified": pa.array([b["modified"]], pa.timestamp("us", tz="UTC")), "raw": [raw]})

    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInArrow(read, schema)


def log_rows(spark: SparkSession, path: str, schema: str, ts: str, since: str, without: Iterable[str] = ()) -> DataFrame:
    """JSON-lines logs of files changed since then, by each row's own time; broken lines are left out.

    A file's time only says that it may hold such rows, so rows are asked as well.
    """
    told = lines(entries(spark, path, without, ["jsonl"], since), path)
    rows = told.select(F.from_json("text", f"{schema}, _broken string", {"columnNameOfCorruptRecord": "_broken"}).alias("r")).select("r.*")
    return rows.where(F.col("_broken").isNull() & (F.col(ts) >= F.lit(since).cast("timestamp"))).drop("_broken")
