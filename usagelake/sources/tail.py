"""A streaming source of append-only JSONL files, resumed by byte offsets.

The offset of a file is the end of its last complete line. A line still without its line feed is emitted as it
is, but the offset stays before it, so it is read again once more of it is there; the sink drops what
it has by the event's id. A file that got shorter starts anew. Paths must be mounted on the driver and all executors.

With a byte budget (max_bytes) a micro-batch takes no more than that, but for a single line that is longer. It ends at a line feed, the
rest comes with later batches, and each batch goes on with the file after the last one that got some of the budget, so a busy file
doesn't keep others waiting. Offsets tell where each file's bytes of the batch begin, so a batch that is run again reads the same bytes.
"""

from __future__ import annotations

import bisect
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from usagelake.sources.lines import split_lines

TAIL = "path string, size bigint, mtime_ns bigint, line int, start bigint, stop bigint, value string, complete boolean"


#: A file's bytes of a batch are cut into pieces of at least so many bytes, and into no more than PIECES.
PIECE, PIECES = 4 << 20, 64


class Span(InputPartition):
    """Lines of a file from start to stop; begin is where the file's bytes of the batch begin, from which lines are counted."""

    def __init__(self, path: str, start: int, stop: int, size: int, mtime_ns: int, begin: int) -> None:
        self.path, self.start, self.stop, self.size, self.mtime_ns, self.begin = path, start, stop, size, mtime_ns, begin


def jsonl_files(root: str) -> Iterator[str]:
    if os.path.isfile(root):
        yield root
    for folder, dirs, names in os.walk(root, followlinks=False):
        dirs.sort()
        for name in sorted(names):
            path = os.path.join(folder, name)
            if name.lower().endswith(".jsonl") and not os.path.islink(path):
                yield path


def last_line_end(path: str, low: int, size: int) -> int:
    """End of the last complete line between low and size, read backwards; low without one."""
    with open(path, "rb") as f:
        at = size
        while at > low:
            first = max(low, at - 65536)
            f.seek(first)
            found = f.read(at - first).rfind(b"\n")
            if found >= 0:
                return first + found + 1
            at = first
    return low


def first_line_end(path: str, at: int, size: int) -> int:
    """End of the line that at is in; size if it has no line feed yet."""
    with open(path, "rb") as f:
        f.seek(at)
        while at < size:
            block = f.read(min(65536, size - at))
            found = block.find(b"\n")
            if found >= 0 or not block:
                return at + found + 1 if block else size
            at += len(block)
    return size


def pieces(path: str, start: int, stop: int) -> list[tuple[int, int]]:
    """start and stop of pieces that end at line feeds, but for the last."""
    size, out, at = max(PIECE, -(-(stop - start) // PIECES)), [], start
    try:
        while stop - at > size:
            end = first_line_end(path, at + size - 1, stop)
            out.append((at, end))
            at = end
    except OSError:
        pass  # gone meanwhile; its reader passes over it
    return out + [(at, stop)] * (at < stop or not out)


def lines_between(path: str, start: int, stop: int) -> int:
    found = 0
    with open(path, "rb") as f:
        f.seek(start)
        while start < stop and (block := f.read(min(1 << 20, stop - start))):
            found, start = found + block.count(b"\n"), start + len(block)
    return found


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.roots = [p for p in options.get("path", "").split(",") if p]
        self.needed = [n.encode() for n in json.loads(options.get("needed", "[]"))]
        self.budget = int(options.get("max_bytes", "0"))
        #: For each file: the end of its last complete line that was taken, the end of what was taken, the time of its last change, and
        #: where the last batch that took some of it began.
        self.seen: dict[str, list[int]] = {}
        self.last = ""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        left, now = self.budget or None, {}
        paths = sorted({path for root in self.roots for path in jsonl_files(root)})
        turn = bisect.bisect_right(paths, self.last)
        for path in paths[turn:] + paths[:turn]:
            try:
                s = os.stat(path)
                old = self.seen.get(path, [0, 0, 0, 0])
                if (s.st_size, s.st_mtime_ns) == (old[1], old[2]):
                    now[path] = old
                elif left is None or left > 0:
                    entry = self.taken(path, old[0] if s.st_size >= old[0] else 0, s, left)
                    if left is not None and entry is not None and entry[1] > entry[3]:
                        left, self.last = left - (entry[1] - entry[3]), path
                    if entry is not None or path in self.seen:
                        now[path] = entry or old
                elif path in self.seen:
                    now[path] = old
            except OSError:
                continue  # gone meanwhile: its offset goes with it
        self.seen = now
        return now

    def taken(self, path: str, begin: int, s: os.stat_result, left: int | None) -> list[int] | None:
        """The entry of a file from begin on: all of it, or as many complete lines as are left to take. None if its first line is too long
        for what is left; the first file of a batch takes that line alone."""
        if left is None or s.st_size - begin <= left:
            return [last_line_end(path, begin, s.st_size), s.st_size, s.st_mtime_ns, begin]
        stop = last_line_end(path, begin, begin + left)
        if stop == begin:
            if left < self.budget:
                return None
            stop = first_line_end(path, begin + left, s.st_size)
        if stop == s.st_size:
            return [last_line_end(path, begin, stop), stop, s.st_mtime_ns, begin]
        return [stop, stop, s.st_mtime_ns, begin]

    def partitions(self, start: dict, end: dict) -> list[Span]:
        if not self.seen:
            self.seen = dict(end)  # a restart tells the offsets that were reached this way
        out = []
        for path, (_, upto, mtime, begin) in sorted(end.items()):
            if [upto, mtime] != start.get(path, [0, 0, -1])[1:3]:
                first = min(begin, start.get(path, [0])[0])
                out += [Span(path, at, stop, upto, mtime, first) for at, stop in pieces(path, first, upto)]
        return out or [Span("", 0, 0, 0, 0, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        if not partition.path:
            return
        try:
            earlier = lines_between(partition.path, partition.begin, partition.start)
            with open(partition.path, "rb") as f:
                f.seek(partition.start)
                body = f.read(partition.stop - partition.start)
        except OSError:
            return
        for number, start, stop, line, complete in split_lines(body, partition.start):
            if all(n in line for n in self.needed):
                yield partition.path, partition.size, partition.mtime_ns, earlier + number, start, stop, line.decode("utf-8", "replace"), complete

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return TAIL

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))
