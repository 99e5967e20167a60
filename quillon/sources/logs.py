"""Logs as a Python data source: byte ranges of the newest log, read from its end or on from an offset, in batches or as a stream.

    spark.dataSource.register(LogSource)
    spark.read.format("quillon_log").option("path", folder).option("lines", 300).load()
    spark.readStream.format("quillon_log").option("path", folder).load()

A log is a file `*.log` in the folder, or a folder of that name whose files, in
order of their names, are one log after the other, as Spark writes them.
`train.log` wins; else it is the one that was changed last; the reader's own
log is left out. Rows are (part, at, line): the file's name, the byte at which
the line begins, and the line without its end; bytes that are not UTF-8 are
replaced.

The driver lists files and sizes, and for `lines` it reads blocks from the end
until it has met so many line ends; texts are read in tasks, each a range of
RANGE bytes at most. A line belongs to the range in which it begins. A stream's
offset is the end of the last whole line of each file, so a line that is still
being written waits, a restart goes on where the last batch ended, and a
replayed batch reads the same bytes. Files may grow and new ones may come; one
that is shorter than its offset was replaced and is read from its begin.

Paths are opened by pyarrow, so they may be local, shared mounts, or stores
that pyarrow knows; an empty or missing log has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

OWN, MAIN = "dashboard.log", "train.log"
RANGE, BLOCK = 32 << 20, 1 << 16


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


def _listed(store: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    return sorted(store.get_file_info(pafs.FileSelector(folder, allow_not_found=True)), key=lambda f: f.path)


def parts_of(path: str, own: str = OWN) -> dict[str, int]:
    """The files of the log that counts, with their sizes, in order."""
    store, folder = _opened(path)
    logs = [f for f in _listed(store, folder) if f.base_name.endswith(".log") and f.base_name != own and not f.base_name.startswith(("_", "."))]
    if not logs:
        return {}
    chosen = max(logs, key=lambda f: (f.base_name == MAIN, f.mtime_ns or 0, f.path))
    if chosen.type != pafs.FileType.Directory:
        return {chosen.base_name: chosen.size or 0}
    inside = [f for f in _listed(store, chosen.path) if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))]
    return {f"{chosen.base_name}/{f.base_name}": f.size or 0 for f in inside}


@dataclass
class Range(InputPartition):
    """Lines of a file that begin from `start` up to `end`, of which the file has `size` bytes or more."""

    part: str
    start: int
    end: int
    size: int


def ranges(part: str, start: int, end: int) -> list[Range]:
    return [Range(part, i, min(i + RANGE, end), end) for i in range(start, end, RANGE)]


def lines_in(path: str, r: Range) -> Iterator[tuple[str, int, str]]:
    """(part, at, line) of a range; of a last line the part up to `size`."""
    store, folder = _opened(path)
    with store.open_input_file(f"{folder}/{r.part}") as f:
        at, held = r.start, b""
        if r.start:  # a line that began before belongs to the range before
            f.seek(r.start - 1)
            while (block := f.read(min(BLOCK, r.size - at + 1))) and (i := block.find(b"\n")) < 0:
                at += len(block)
                f.seek(at - 1)
            if not block:
                return
            at += i
        f.seek(at)
        read = at
        while at < r.end:
            block = f.read(min(BLOCK, r.size - read))
            read += len(block)
            held += block
            *whole, rest = held.split(b"\n")
            for line in whole:
                if at >= r.end:
                    return
                yield r.part, at, _text(line)
                at += len(line) + 1
            held = rest
            if not block:
                if held and at < r.end:
                    yield r.part, at, _text(held)
                return


def _text(line: bytes) -> str:
    return line.removesuffix(b"\r").decode("utf-8", "replace")


def tail_ranges(path: str, lines: int, own: str = OWN) -> list[Range]:
    """Ranges that hold the last lines; blocks are read from the end until enough line ends are found."""
    store, folder = _opened(path)
    out: list[Range] = []
    left = lines
    for part, size in reversed(list(parts_of(path, own).items())):
        if left <= 0:
            break
        start, seen = size, 0
        with store.open_input_file(f"{folder}/{part}") as f:
            while start and seen <= left:
                step = min(BLOCK, start)
                f.seek(start - step)
                block = f.read(step)
                if start == size and block.endswith(b"\n"):
                    block = block[:-1]  # the end of the last line
                start -= step
                n = block.count(b"\n")
                if seen + n >= left:  # the line after this many ends from the back is the first
                    for _ in range(left - seen):
                        block = block[: block.rfind(b"\n")]
                    out[:0] = ranges(part, start + len(block) + 1, size)
                    return out
                seen += n
        out[:0] = ranges(part, 0, size)
        left -= seen + 1 if size else 0
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.own = options["path"], options.get("own", OWN)
        self.lines = int(options["lines"]) if "lines" in options else None

    def partitions(self) -> list[Range]:
        if self.lines is not None:
            found = tail_ranges(self.path, self.lines, self.own)
        else:
            found = [r for part, size in parts_of(self.path, self.own).items() for r in ranges(part, 0, size)]
        return found or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return lines_in(self.path, partition) if partition.part else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.own = options["path"], options.get("own", OWN)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {part: self._whole(part, size) for part, size in parts_of(self.path, self.own).items()}

    def _whole(self, part: str, size: int) -> int:
        """Bytes of the file up to its last line end."""
        store, folder = _opened(self.path)
        with store.open_input_file(f"{folder}/{part}") as f:
            while size:
                step = min(BLOCK, size)
                f.seek(size - step)
                i = f.read(step).rfind(b"\n")
                if i >= 0:
                    return size - step + i + 1
                size -= step
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for part, to in sorted(end.items()):
            begin = start.get(part, 0)
            out += ranges(part, begin if begin <= to else 0, to)
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return lines_in(self.path, partition) if partition.part else iter(())

    def commit(self, end: dict) -> None:
        pass


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quillon_log"

    def schema(self) -> str:
        return "part string, at bigint, line string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def log_lines(spark: SparkSession, folder: str, lines: int | None = None, own: str = OWN) -> DataFrame:
    """(part, at, line) of the log that counts in a folder, or of its last lines."""
    spark.dataSource.register(LogSource)
    reader = spark.read.format("quillon_log").option("path", folder).option("own", own)
    return (reader if lines is None else reader.option("lines", str(lines))).load()


def log_stream(spark: SparkSession, folder: str, own: str = OWN) -> DataFrame:
    """The same as a stream, from the log's begin or the checkpoint's offset."""
    spark.dataSource.register(LogSource)
    return spark.readStream.format("quillon_log").option("path", folder).option("own", own).load()
