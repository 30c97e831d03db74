"""A streaming source that follows growing log files by whole entries."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import uuid
import warnings
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from sawmill.sources.lines import glob_regex

SCHEMA = "source string, block long, pos long, value string"
CHUNK = 1 << 16
#: Bytes at a file's beginning, and before the place it was read to, that tell it from others.
HEAD, TAIL = 1024, 256
#: Bytes of a head that a file met under another inode must share to count as one followed before.
ENOUGH = 64
#: Looks at the folder for which a file that is not found is remembered.
GONE = 20


def digest(path: str, begin: int, size: int) -> str:
    """A digest of some bytes of a file; of none: empty."""
    if not size:
        return ""
    with open(path, "rb") as f:
        f.seek(begin)
        return hashlib.sha1(f.read(size)).hexdigest()


@dataclass
class Followed:
    """A file by its content: its first bytes, and those before ``end``, up to which it was handed on."""

    path: str
    node: str
    end: int = 0
    head: list = field(default_factory=lambda: [0, ""])  # bytes, digest
    tail: list = field(default_factory=lambda: [0, ""])
    gone: int = 0

    def begins(self, path: str, size: int) -> bool:
        """Whether a file begins with the bytes that this one was seen to begin with."""
        return size >= self.head[0] and digest(path, 0, self.head[0]) == self.head[1]

    def same(self, path: str, size: int) -> bool:
        """Whether a file holds, as far as can be told, what was read of this one."""
        return size >= self.end and self.begins(path, size) and digest(path, self.end - self.tail[0], self.tail[0]) == self.tail[1]

    def moved(self, path: str, size: int, end: int) -> Followed:
        """This file read up to ``end``, its marks taken anew."""
        head, tail = min(HEAD, size), min(TAIL, end)
        return Followed(path, self.node, end, [head, digest(path, 0, head)], [tail, digest(path, end - tail, tail)])


@dataclass
class Range(InputPartition):
    """Bytes of a file, which is told by its head and by what comes before the range."""

    path: str
    begin: int
    end: int
    head: list = field(default_factory=lambda: [0, ""])
    tail: list = field(default_factory=lambda: [0, ""])


def last_start(path: str, begin: int, end: int, start: re.Pattern) -> int:
    """Where the last line that begins an entry starts in bytes [begin, end), looking back chunk by chunk; -1: none."""
    at, tail = end, b""
    with open(path, "rb") as f:
        while at > begin:
            low = max(begin, at - CHUNK)
            f.seek(low)
            data = f.read(at - low) + tail
            first = 0 if low == begin else data.find(b"\n") + 1
            if first == 0 and low > begin:
                tail, at = data, low
                continue
            place, found = first, -1
            for line in data[first:].split(b"\n"):
                if place < len(data) and start.search(line.decode("utf-8", "replace").rstrip("\r")):
                    found = place
                place += len(line) + 1
            if found >= 0:
                return low + found
            tail, at = data[:first], low
    return -1


def starts(path: str, begin: int, end: int, start: re.Pattern) -> Iterator[int]:
    """Where lines that begin an entry start in bytes [begin, end), in order."""
    with open(path, "rb") as f:
        f.seek(begin)
        at = begin
        while at < end:
            line = f.readline(end - at)
            if not line:
                return
            if start.search(line.decode("utf-8", "replace").rstrip("\r\n")):
                yield at
            at += len(line)


def walked(root: str) -> Iterator[tuple[str, os.stat_result]]:
    """All files below a folder, in order."""
    for folder, names, found in os.walk(root):
        names.sort()
        for name in sorted(found):
            path = os.path.join(folder, name)
            try:
                yield path, os.stat(path)
            except OSError:
                continue  # it went meanwhile


class TailReader(DataSourceStreamReader):
    """Offsets hold each file by its content (``Followed``), not by its name: a renamed file goes on, also under a name
    that no pattern takes, a copy of a file that was then cut goes on in its place, and a file with new content
    starts anew, whatever its name, inode and size. A file cut to a shorter one of the same beginning goes on at its end.

    A batch ends where the last entry of a file begins: the open entry's lines stay for later, and so no
    state is kept. It is closed once the file has not changed for ``flushSeconds``. A line without its
    end stays, too. A batch holds ``maxBytesPerBatch`` bytes and ``maxEntriesPerBatch`` entries of all files
    together (0: any number); files take turns, and only an entry that is larger by itself goes beyond.
    With ``availableNow`` the files' sizes at the first look are where the stream ends.

    Files are listed on the driver, which must know where an earlier run has ended (``known``: that run's last
    offset), and read by the tasks, a range of bytes each. A range is read from the file that has its content,
    wherever that is now; if there is none the batch fails, or is skipped if ``onLost`` says so.
    """

    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.root = options["path"].removeprefix("file://")
        patterns = lambda text: [re.compile(glob_regex(p)) for p in re.split(r",(?![^{]*\})", text) if p]
        self.include, self.exclude = patterns(options.get("include", "*")), patterns(options.get("exclude", ""))
        self.earlier = [([re.compile(glob_regex(p)) for p in i], [re.compile(glob_regex(p)) for p in e]) for i, e in json.loads(options.get("earlier", "[]"))]
        self.start = re.compile(options.get("startregex", ""))
        self.flush = float(options.get("flushseconds", "5"))
        self.limit = max(1, int(options.get("maxbytesperbatch", str(256 << 20))))
        self.entries = int(options.get("maxentriesperbatch", "0"))
        self.skips_lost = options.get("onlost", "fail") == "skip"
        self.fixed = options.get("availablenow", "false").lower() == "true"
        self.goal: dict[str, int] = {}
        self.known: dict[str, Followed] | None = None
        self.turn = ""
        self.seen: dict[str, tuple] = {}  # by file: what was looked at when its content was compared last
        if options.get("known"):
            self.known = self._parsed({"files": options["known"]})

    @staticmethod
    def _parsed(offset: dict) -> dict[str, Followed]:
        return {k: Followed(**v) for k, v in json.loads(offset["files"]).items()}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def _takes(self, path: str) -> bool:
        any_of = lambda some: any(p.search(path) for p in some)
        return any_of(self.include) and not any_of(self.exclude) and not any(any_of(i) and not any_of(e) for i, e in self.earlier)

    def _files(self) -> dict[str, tuple[str, os.stat_result]]:
        """(path, status) by key of the files to follow now; ``known`` is brought up to date with the folder."""
        known = self.known or {}
        nodes = {f.node: k for k, f in known.items()}
        now: dict[str, tuple[str, os.stat_result]] = {}
        new, others = [], []
        for path, stat in walked(self.root):
            key = nodes.get(f"{stat.st_dev}:{stat.st_ino}")
            marks = (stat.st_size, stat.st_mtime_ns)
            if key is not None and (self.seen.get(key) == marks or self._same(known[key], path, stat)):
                self.seen[key] = marks
                known[key].path, known[key].gone = path, 0
                now[key] = path, stat
            else:
                (new if self._takes(path) else others).append((path, stat))
        loose = {k: f for k, f in known.items() if k not in now}
        if loose:
            for path, stat in [*new, *others]:
                key = next((k for k, f in loose.items() if f.head[0] >= ENOUGH and f.same(path, stat.st_size)), None)
                if key is not None:
                    found = loose.pop(key)
                    found.path, found.node, found.gone = path, f"{stat.st_dev}:{stat.st_ino}", 0
                    now[key] = path, stat
            taken = {path for path, _ in now.values()}
            new = [x for x in new if x[0] not in taken]
        for key, lost in loose.items():
            lost.gone += 1
            if lost.gone > GONE or lost.node in {f"{s.st_dev}:{s.st_ino}" for _, s in new}:
                del known[key]
        for path, stat in new:
            key = uuid.uuid4().hex[:16]
            known[key] = Followed(path, f"{stat.st_dev}:{stat.st_ino}")
            now[key] = path, stat
        self.known = known
        return now

    @staticmethod
    def _same(file: Followed, path: str, stat: os.stat_result) -> bool:
        if file.same(path, stat.st_size):
            return True
        if stat.st_size < file.end and stat.st_size >= ENOUGH and file.begins(path, stat.st_size):
            warnings.warn(f"{path} was cut from {file.end} to {stat.st_size} bytes; it goes on from there", stacklevel=2)
            cut = file.moved(path, stat.st_size, stat.st_size)
            file.end, file.head, file.tail = cut.end, cut.head, cut.tail
            return True
        return False

    def _upto(self, path: str, begin: int, size: int, idle: bool, room: int, alone: bool) -> int:
        """Where the batch ends in a file: within ``room`` if an entry ends there; ``alone`` in its batch, else at the first
        doubling that one ends within."""
        while (end := self._within(path, begin, size, idle, room)) == begin and alone and begin + room < size:
            room *= 2
        return end

    def _within(self, path: str, begin: int, size: int, idle: bool, room: int) -> int:
        if idle and begin + room >= size:
            return size
        end = min(size, begin + room)
        with open(path, "rb") as f:  # back to the last line end
            at = end
            while at > begin:
                low = max(begin, at - CHUNK)
                f.seek(low)
                cut = f.read(at - low).rfind(b"\n")
                if cut >= 0:
                    end = low + cut + 1
                    break
                at = low
            else:
                end = begin
        return max(last_start(path, begin, end, self.start), begin)

    def latestOffset(self) -> dict:
        files = self._files()
        if self.fixed and not self.goal:
            self.goal = {key: stat.st_size for key, (_, stat) in files.items()}
        room, entries, planned = self.limit, self.entries, False
        order = sorted(files)
        order = [k for k in order if k > self.turn] + [k for k in order if k <= self.turn]
        for key in order:
            path, stat = files[key]
            file, size = self.known[key], stat.st_size
            if self.fixed:
                size = min(size, self.goal.get(key, 0))
            if size <= file.end or room <= 0 or self.entries and entries <= 0:
                continue
            idle = size == stat.st_size and time.time() - stat.st_mtime >= self.flush
            try:
                end = self._upto(path, file.end, size, idle, room, not planned)
                if self.entries:
                    for at in starts(path, file.end, end, self.start):
                        if entries == 0:
                            end = at
                            break
                        entries -= 1
                if end > file.end:
                    room, planned, self.turn = room - (end - file.end), True, key
                    self.known[key] = file.moved(path, stat.st_size, end)
            except FileNotFoundError:
                continue  # it was renamed meanwhile; the next look finds it
        return {"files": json.dumps({k: asdict(f) for k, f in self.known.items()}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, now = self._parsed(start), self._parsed(end)
        if self.known is None:  # a batch of an earlier run
            self.known = now
        out = []
        for key, file in now.items():
            old = before.get(key, Followed(file.path, file.node))
            if file.end > old.end:
                out.append(Range(file.path, old.end, file.end, file.head, old.tail))
        return out or [Range("", 0, 0)]

    def _place(self, part: Range) -> str | None:
        """The path of the file that has the range's content: the one it was planned from, else any in the folder."""
        seen = Followed(part.path, "", part.begin, part.head, part.tail)

        def fits(path: str) -> bool:
            try:
                size = os.stat(path).st_size
                return size >= part.end and seen.same(path, size)
            except OSError:
                return False

        if fits(part.path):
            return part.path
        return next((path for path, stat in walked(self.root) if stat.st_size >= part.end and fits(path)), None)

    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.path:
            return
        path = self._place(partition)
        if path is None:
            text = f"no file below {self.root} holds bytes {partition.begin} to {partition.end} of what {partition.path} was"
            if not self.skips_lost:
                raise FileNotFoundError(text)
            warnings.warn(text, stacklevel=2)
            return
        with open(path, "rb") as f:
            f.seek(partition.begin)
            at = partition.begin
            while at < partition.end:
                line = f.readline(partition.end - at)
                if not line:
                    break
                yield f"file://{partition.path}", partition.begin, at, line.decode("utf-8", "replace").rstrip("\r\n")
                at += len(line)

    def commit(self, end: dict) -> None:
        """Nothing: the next batch starts where the last one planned has ended."""


class TailSource(DataSource):
    """``spark.readStream.format("logtail").option("startRegex", …).load(folder)``"""

    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))
