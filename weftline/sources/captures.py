"""A streaming source over captures that grow: NDJSON or event-stream files of token streams.

``spark.readStream.format("captures").load(folder)`` gives (file, at, value): each complete line of each file with its place in
bytes. An offset is the number of bytes of complete lines of each file, so that a file may go on to grow, a restart goes on
where the last committed batch ended, and a batch that comes again has the same lines. A batch is cut into partitions of
``bytes`` (an option, 32 MB), each of which reads the lines that begin in it. Names that begin with ``.`` or ``_`` are left out.
An offset names every file: a folder of captures is meant to hold thousands of files, not millions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a partition, and of one look backwards for the last line's end.
PARTITION_BYTES, BLOCK = 32 << 20, 1 << 16


@dataclass
class Span(InputPartition):
    """The lines of ``file`` that begin in [start, end); ``first``: start is known to begin a line."""

    file: str
    start: int
    end: int
    first: bool


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def complete(handle, size: int, known: int) -> int:
    """The end of the last complete line among ``size`` bytes, of which ``known`` are known to be complete ones."""
    end = size
    while end > known:
        start = max(known, end - BLOCK)
        handle.seek(start)
        at = handle.read(end - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        end = start
    return known


class CaptureReader(DataSourceStreamReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size, self.known = path, size, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs

        store, root = _store(self.path)
        out = {}
        for f in store.get_file_info(fs.FileSelector(root, recursive=False, allow_not_found=True)):
            if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")):
                known = self.known.get(f.base_name, 0)
                if f.size > known:
                    with store.open_input_file(f.path) as h:
                        known = complete(h, f.size, known)
                if known:
                    out[f.base_name] = known
        self.known = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Span]:
        spans = []
        for file in sorted(end):
            low, high = start.get(file, 0), end[file]
            spans += [Span(file, at, min(at + self.size, high), at == low) for at in range(low, high, self.size)]
        return spans

    def read(self, partition: Span) -> Iterator[tuple]:
        store, root = _store(self.path)
        with store.open_input_file(f"{root}/{partition.file}") as h:
            at, left, ends = partition.start, b"", partition.first
            if not ends and at:  # does a line begin here?
                h.seek(at - 1)
                ends = h.read(1) == b"\n"
            h.seek(at)
            while at < partition.end and (block := h.read(BLOCK)):
                lines = (left + block).split(b"\n")
                left = lines.pop()
                for line in lines:
                    if at >= partition.end:
                        return
                    if ends:
                        yield partition.file, at, line.removesuffix(b"\r").decode("utf-8", "replace")
                    at, ends = at + len(line) + 1, True

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class Captures(DataSource):
    @classmethod
    def name(cls) -> str:
        return "captures"

    def schema(self) -> str:
        return "file string, at bigint, value string"

    def streamReader(self, schema) -> CaptureReader:
        return CaptureReader(self.options["path"].rstrip("/"), int(self.options.get("bytes", PARTITION_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Captures)
