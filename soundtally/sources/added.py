"""Readers that a user adds: of text lines, as a function from lines to rows, or of files' bytes, as a data source that reads files block by block.

An added reader takes the files whose names match its pattern before the built-in ones
do, and those for which it is asked by name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from soundtally.sources.place import opened

#: Bytes of a file that a task reads, and lines of a file's beginning that each of its blocks sees.
BLOCK, HEAD = 64 << 20, 100
#: Rows of an Arrow batch.
BATCH = 50_000
ROWS = "path string, ms long, name string, freq_hz double, level double"
#: What a block's reader gives: time, name of the level, frequency or None, level.
Row = tuple[int, str, float | None, float]


@dataclass(frozen=True)
class Reader:
    """name as it can be asked for, in small letters; pattern of lower-case file names; rows from lines (path, line_no, line) to (path, ms, name, freq_hz, level)."""

    name: str
    pattern: str
    rows: Callable[[DataFrame], DataFrame]


READERS: dict[str, Reader] = {}


def add(reader: Reader) -> None:
    """From now on files are routed to this reader too; one of the same name is replaced, a built-in one can't be."""
    from soundtally.sources.names import ALIASES

    if reader.name in ALIASES or not reader.name.isidentifier() or reader.name != reader.name.lower():
        raise ValueError(f"{reader.name!r} is no name for a reader")
    READERS[reader.name] = reader


def remove(name: str) -> None:
    READERS.pop(name, None)


@dataclass
class Block(InputPartition):
    path: str
    start: int
    stop: int


def block_lines(path: str, start: int, stop: int) -> Iterator[str]:
    """The lines that begin in a block of a file: each line of a file is in exactly one of its blocks."""
    with opened(path) as held:
        at = 0
        if start:
            # the line before the block ends where this one begins
            held.seek(start - 1)
            at = start - 1
            for skipped in _raw(held):
                at += len(skipped)
                break
        held.seek(at)
        for line in _raw(held):
            if at >= stop:
                return
            at += len(line)
            yield line.rstrip(b"\r\n").decode("utf-8", "replace")


def _raw(held, size: int = 1 << 20) -> Iterator[bytes]:
    """Lines with their line feeds, read a piece at a time."""
    rest = b""
    while piece := held.read(size):
        *whole, rest = (rest + piece).split(b"\n")
        for line in whole:
            yield line + b"\n"
    if rest:
        yield rest


def block_source(name: str, parse: Callable[[list[str], Iterator[str]], Iterator[Row]], suffix: str = "") -> type[DataSource]:
    """A data source to be registered: spark.read.format(name).load(folder or file) gives ROWS.

    parse gets a file's first HEAD lines and the lines of one of its blocks, and gives
    rows; lines of the header are among those of the first block. Options: block, the
    bytes of a block. A file that can't be read fails its task, as Spark's own sources do.
    """

    class Blocks(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return ROWS

        def reader(self, schema: StructType) -> DataSourceReader:
            return BlockReader(self.options)

    class BlockReader(DataSourceReader):
        def __init__(self, options: dict[str, str]):
            self.root, self.block = options["path"], int(options.get("block", BLOCK))

        def partitions(self) -> list[Block]:
            local = self.root.startswith("file:") or "://" not in self.root
            store, place = (fs.LocalFileSystem(), "/" + self.root.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(self.root)
            info = store.get_file_info(place)
            found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(place, recursive=True))
            files = [f for f in found if f.type == fs.FileType.File and f.path.endswith(suffix) and not f.base_name.startswith((".", "_"))]
            scheme = "" if local else self.root.split("://")[0] + "://"
            return [Block(scheme + f.path, at, min(at + self.block, f.size)) for f in sorted(files, key=lambda f: f.path) for at in range(0, f.size, self.block)] or [Block("", 0, 0)]

        def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
            if not partition.path:
                return
            head = []
            for line in block_lines(partition.path, 0, 1 << 62):
                head.append(line)
                if len(head) == HEAD:
                    break
            rows = iter(parse(head, block_lines(partition.path, partition.start, partition.stop)))
            kinds = (("ms", pa.int64()), ("name", pa.string()), ("freq_hz", pa.float64()), ("level", pa.float64()))
            while some := list(islice(rows, BATCH)):
                columns = [pa.array([r[i] for r in some], kind) for i, (_, kind) in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(some)), *columns], names=["path", *(n for n, _ in kinds)])

    return Blocks


def register(spark: SparkSession, source: type[DataSource]) -> None:
    spark.dataSource.register(source)
