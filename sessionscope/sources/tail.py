"""A streaming source that follows a folder of growing log files.

An offset holds, per file, how many bytes of complete lines there were and a checksum of the first line. A round reads what lies between two
offsets, cut into byte ranges (at least ``span_bytes`` long, and no more of them than ``MOST_SPANS`` and one a file), each line by the range that it begins in. A last line without its line feed waits for it. A file
that is shorter than before, or begins with another line, is a new one under the old name and is read from its start. All this
follows from the two offsets alone, so a round that is repeated after a crash reads the same lines.

Rounds carry the latest change time in the folder; event_seq is text that sorts by round, file name and byte, the order in which
lines came. Files may be local, mounted, or in a store that pyarrow's file systems know; driver and executors must reach them.
"""

from __future__ import annotations

import fnmatch
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from sessionscope.sources.logs import log_glob

SCHEMA = "raw_line binary, source_file string, byte_offset bigint, event_seq string"
HEAD = 4096  # so many bytes of a first line tell it apart
BLOCK = 1 << 20
MOST_SPANS = 512  # ranges of a round: each is a task that starts a reader, so a round that has grown gets longer ranges; they are read by the block


@dataclass
class Span(InputPartition):
    """Lines of a file that begin in [low, high); ``begin`` is where the round's lines of the file begin, ``end`` where they end."""

    file: str
    begin: int
    low: int
    high: int
    end: int
    round: int


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def complete_length(f: pa.NativeFile, size: int) -> int:
    """Bytes up to and with the last line feed among the first ``size``, looked for from the end."""
    high = size
    while high > 0:
        low = max(0, high - BLOCK)
        f.seek(low)
        at = f.read(high - low).rfind(b"\n")
        if at >= 0:
            return low + at + 1
        high = low
    return 0


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.glob = options["path"], options.get("glob", "*.log")
        self.span_bytes = int(options.get("spanbytes", 16 << 20))

    def initialOffset(self) -> dict:
        return {"round": 0, "files": {}}

    def latestOffset(self) -> dict:
        store, folder = opened(self.folder)
        files, latest = {}, 0
        for info in store.get_file_info(pafs.FileSelector(folder)):
            if info.type != pafs.FileType.File or not fnmatch.fnmatchcase(info.base_name, self.glob):
                continue
            with store.open_input_file(info.path) as f:
                length = complete_length(f, info.size)
                f.seek(0)
                head = f.read(min(HEAD, length)).split(b"\n", 1)[0]
            files[info.base_name] = [length, zlib.crc32(head)]
            latest = max(latest, info.mtime_ns or 0)
        return {"round": latest // 1000, "files": files}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        news = []
        for name, (length, head) in sorted(end["files"].items(), key=lambda x: (x[0].lower(), x[0])):
            known, known_head = start["files"].get(name, (0, head))
            news.append((name, 0 if length < known or known and head != known_head else known, length))
        step = max(self.span_bytes, -(-sum(length - begin for _, begin, length in news) // MOST_SPANS))
        return [Span(name, begin, low, min(low + step, length), length, end["round"]) for name, begin, length in news for low in range(begin, length, step)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        store, folder = opened(self.folder)
        with store.open_input_file(f"{folder.rstrip('/')}/{partition.file}") as f:
            yield from _batches(f, partition)


def _batches(f: pa.NativeFile, p: Span) -> Iterator[pa.RecordBatch]:
    at = p.low
    if p.low > p.begin:  # the line that goes on into this range belongs to the one before
        at = _after_feed(f, p.low - 1, p.end)
    f.seek(at)
    rest, lines, places = b"", [], []
    while at + len(rest) < p.end and at < p.high:
        block = f.read(min(BLOCK, p.end - at - len(rest)))
        if not block:
            raise EOFError(f"{p.file} has become shorter while it was read; the next round starts it again")
        parts = (rest + block).split(b"\n")
        rest = parts.pop()
        for line in parts:
            if at >= p.high:
                break
            lines.append(line.removesuffix(b"\r"))
            places.append(at)
            at += len(line) + 1
        if lines:
            yield _batch(p, lines, places)
            lines, places = [], []


def _after_feed(f: pa.NativeFile, at: int, end: int) -> int:
    """The place behind the first line feed from ``at`` on."""
    f.seek(at)
    while at < end:
        block = f.read(min(BLOCK, end - at))
        found = block.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(block)
    return end


def _batch(p: Span, lines: list[bytes], places: list[int]) -> pa.RecordBatch:
    seq = [f"{p.round:017d}:{p.file.lower()}:{at:015d}" for at in places]
    columns = [pa.array(lines, pa.binary()), pa.array([p.file] * len(lines), pa.string()), pa.array(places, pa.int64()), pa.array(seq, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["raw_line", "source_file", "byte_offset", "event_seq"])


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(dict(self.options))


def tail_log_lines(spark: SparkSession, folder: str, log_type: str = "routes", glob: str | None = None, span_bytes: int = 16 << 20) -> DataFrame:
    """A stream of the complete lines of files as they grow: raw_line (bytes that are no UTF-8 replaced), source_file, byte_offset (where
    the line begins), event_seq. Line feeds end lines; a carriage return before one is dropped."""
    spark.dataSource.register(LogTail)
    stream = spark.readStream.format("log_tail").option("path", folder).option("glob", glob or log_glob(log_type)).option("spanBytes", span_bytes).load()
    return stream.withColumn("raw_line", F.make_valid_utf8(F.col("raw_line").cast("string")))
