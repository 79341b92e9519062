"""A streaming source of event lines: append-only files of a folder, a bounded number of lines a batch, resumable.

    spark.dataSource.register(EventLines)
    spark.readStream.format("event_lines").option("path", folder).option("checkpoint", checkpoint).load()

An offset is a file and a byte in it; files follow each other by name. Only whole lines count, so a line that is still being
written waits. Where a batch ends is found by reading its lines once on the driver (``limit`` at most); tasks
read byte ranges.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Lines of a batch at most; bytes of a task's range about.
LIMIT, TASK_BYTES = 2000, 4 << 20
_READ = 1 << 16


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int
    last: int  # where the batch ends in the file


class EventLines(DataSource):
    """Options: path (a folder), limit, start ('now': lines written from here on, or 'begin'), and checkpoint, the query's checkpoint
    folder, from which a restarted query learns where its last planned batch ended."""

    @classmethod
    def name(cls) -> str:
        return "event_lines"

    def schema(self) -> str:
        return "file string, at long, line string"

    def streamReader(self, schema: StructType) -> EventLinesReader:
        return EventLinesReader(dict(self.options))


class EventLinesReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.checkpoint = options["path"], options.get("checkpoint")
        self.limit, self.begins = int(options.get("limit", LIMIT)), options.get("start", "now")
        if self.limit < 1 or self.begins not in ("now", "begin"):
            raise ValueError("limit must be 1 or more, and start 'now' or 'begin'")
        self.planned: dict | None = None

    def _files(self) -> list[tuple[str, int]]:
        from pyarrow.fs import FileSelector, FileSystem, FileType

        fs, root = FileSystem.from_uri(self.path) if "://" in self.path else FileSystem.from_uri(f"file://{self.path}")
        found = [(f.base_name, f.size) for f in fs.get_file_info(FileSelector(root)) if f.type == FileType.File and not f.base_name.startswith((".", "_"))]
        return sorted(found)

    def _bytes(self, file: str, start: int, end: int) -> Iterator[bytes]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(self.path) if "://" in self.path else FileSystem.from_uri(f"file://{self.path}")
        with fs.open_input_file(f"{root}/{file}") as f:
            while start < end:
                part = f.read_at(min(_READ, end - start), start)
                if not part:
                    return
                start += len(part)
                yield part

    def _whole(self, file: str, size: int) -> int:
        """Bytes of a file up to the end of its last whole line."""
        end = size
        while end > 0:
            start = max(0, end - _READ)
            part = b"".join(self._bytes(file, start, end))
            if (at := part.rfind(b"\n")) >= 0:
                return start + at + 1
            end = start
        return 0

    def initialOffset(self) -> dict:
        files = self._files()
        if self.begins == "begin" or not files:
            return {"file": "", "byte": 0}
        file, size = files[-1]
        return {"file": file, "byte": self._whole(file, size)}

    def _resumed(self) -> dict | None:
        """The end of the last batch that the checkpoint's log has planned."""
        from pyarrow.fs import FileSelector, FileSystem

        if not self.checkpoint:
            return None
        fs, root = FileSystem.from_uri(self.checkpoint) if "://" in self.checkpoint else FileSystem.from_uri(f"file://{self.checkpoint}")
        found = fs.get_file_info(FileSelector(f"{root}/offsets", allow_not_found=True))
        numbered = [(int(f.base_name), f.path) for f in found if f.base_name.isdigit()]
        if not numbered:
            return None
        with fs.open_input_stream(max(numbered)[1]) as f:
            for line in f.read().decode().splitlines()[2:]:  # version, metadata, then an offset a source
                try:
                    offset = json.loads(line)
                except ValueError:
                    continue
                if isinstance(offset, dict) and offset.keys() == {"file", "byte"}:
                    return offset
        return None

    def latestOffset(self) -> dict:
        """The place ``limit`` lines behind the last planned one, or the end of what is written."""
        if self.planned is None:
            self.planned = self._resumed() or self.initialOffset()
        at, left = self.planned, self.limit
        for file, size in self._files():
            if file < at["file"] or not left:
                continue
            place = at["byte"] if file == at["file"] else 0
            for part in self._bytes(file, place, size):
                n = part.count(b"\n")
                if n >= left:  # the batch ends in here
                    end = -1
                    for _ in range(left):
                        end = part.index(b"\n", end + 1)
                    at, left = {"file": file, "byte": place + end + 1}, 0
                    break
                if n:
                    at, left = {"file": file, "byte": place + part.rindex(b"\n") + 1}, left - n
                place += len(part)
        self.planned = at
        return at

    def partitions(self, start: dict, end: dict) -> Sequence[Range]:
        ranges = []
        for file, size in self._files():
            if start["file"] <= file <= end["file"]:
                a = start["byte"] if file == start["file"] else 0
                # files before the last are read to their last whole line
                b = end["byte"] if file == end["file"] else self._whole(file, size)
                ranges += [Range(file, s, min(s + TASK_BYTES, b), b) for s in range(a, b, TASK_BYTES)]
        return ranges

    def read(self, partition: Range) -> Iterator[tuple[str, int, str]]:
        """Lines that begin in the range; the last may end behind it."""
        at, rest = partition.start, b""
        skip = at > 0 and b"".join(self._bytes(partition.file, at - 1, at)) != b"\n"
        for part in self._bytes(partition.file, at, partition.last):
            lines = (rest + part).split(b"\n")
            rest = lines.pop()
            for line in lines:
                if at >= partition.end:
                    return
                if not skip:
                    yield partition.file, at, line.decode("utf-8", "replace")
                skip = False
                at += len(line) + 1

    def commit(self, end: dict) -> None:
        """Nothing: the checkpoint holds what was read."""
