"""Log files by time: a data source that plans the byte ranges of a time range and reads only those."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .text import DEFAULT_LAYOUT, NODE, header_pattern

#: Bytes of a task's range; bytes read by one step of the bisection, and of a read.
RANGE, STEP, BUFFER = 64 << 20, 64 << 10, 4 << 20
#: Times of lines in a file may run back by so many milliseconds at most.
SLACK_MS = 60_000
KIND = "path string, node_id string, offset long, record long, ts timestamp, line string"
_MICRO = 1_000_000


@dataclass
class Piece(InputPartition):
    """The records whose first line starts in [start, end) of a file; head tells whether lines before any record are in it."""

    path: str
    node: str | None
    start: int
    end: int


def _files(paths: Sequence[str]) -> list[tuple[str, int]]:
    """(path, size) of files, folders' files and globs of the last part of a path, in the order of their paths."""
    found = {}
    for path in paths:
        parent, _, last = path.rpartition("/")
        glob = re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in last) + r"\Z") if re.search(r"[*?]", last) else None
        store, base = fs.FileSystem.from_uri(parent if glob else path) if "://" in path else (fs.LocalFileSystem(), parent if glob else path)
        info = store.get_file_info(base)
        if info.type == fs.FileType.Directory:
            infos = [i for i in store.get_file_info(fs.FileSelector(base, recursive=glob is None)) if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")) and (not glob or glob.match(i.base_name))]
        elif info.type == fs.FileType.File and not glob:
            infos = [info]
        else:
            raise FileNotFoundError(path)
        scheme = path.partition("://")[0] + "://" if "://" in path else ""
        found |= {(i.path if not scheme else scheme + i.path.removeprefix("/") if not i.path.startswith("/") else scheme + i.path): i.size for i in infos}
    return sorted(found.items())


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Clock:
    """The time that a line's header gives, in microseconds of UTC; None for lines without a header."""

    def __init__(self, layout: str, zone: str):
        pattern, names = header_pattern(layout)
        if "ts" not in names:
            raise ValueError(f"no time in the layout {layout!r}")
        self.pattern, self.group, self.zone = re.compile(pattern), names.index("ts") + 1, ZoneInfo(zone)

    def __call__(self, line: str) -> int | None:
        m = self.pattern.match(line)
        if not m:
            return None
        try:
            at = datetime.fromisoformat(m[self.group].replace(",", "."))
        except ValueError:
            return None
        at = (at.replace(tzinfo=self.zone) if at.tzinfo is None else at) - datetime(1970, 1, 1, tzinfo=timezone.utc)
        return (at.days * 86_400 + at.seconds) * _MICRO + at.microseconds


def _first_record(file: pa.NativeFile, at: int, end: int, clock: Clock) -> tuple[int, int] | None:
    """(offset, time) of the first record that starts at `at` or later, before `end`; None if there is none. A line starts at 0
    or behind a line end, so the byte before `at` is looked at too."""
    place = max(0, at - 1)
    file.seek(place)
    rest, skip = b"", at > 0
    while place < end:
        data = file.read(STEP)
        if not data and not rest:
            return None
        lines = (rest + data).split(b"\n")
        rest = lines.pop() if data else b""
        for line in lines:
            if not skip and place < end:
                ts = clock(line.rstrip(b"\r").decode(errors="replace"))
                if ts is not None:
                    return place, ts
            skip = False
            place += len(line) + 1
        if not data:
            break
    return None


def bisect_time(file: pa.NativeFile, size: int, wanted: int, clock: Clock) -> int:
    """The offset of the first record of that time or a later one, in a file whose times rise; its size if there is none. Some
    log2(size / STEP) reads of STEP bytes."""
    low, high = 0, size  # records before low are earlier, the first record at or behind high is not
    while high - low > STEP:
        middle = (low + high) // 2
        found = _first_record(file, middle, high, clock)
        if found is None or found[1] >= wanted:
            high = middle
        else:
            low = found[0] + 1
    at = low
    while (found := _first_record(file, at, size, clock)) is not None:
        if found[1] >= wanted:
            return found[0]
        at = found[0] + 1
    return size


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["paths"].split("\n")
        self.clock = Clock(options.get("layout", DEFAULT_LAYOUT), options.get("zone", "UTC"))
        self.node = re.compile(options.get("node_pattern", NODE))
        self.slack, self.range = int(options.get("slack_ms", SLACK_MS)) * 1000, int(options.get("range_bytes", RANGE))
        self.low = self.high = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of ts narrow the bytes that are read; all filters are left to Spark as well, which makes them exact."""
        for f in filters:
            if getattr(f, "attribute", None) == ("ts",) and isinstance(getattr(f, "value", None), datetime):
                value = f.value if f.value.tzinfo else f.value.replace(tzinfo=timezone.utc)
                at = value - datetime(1970, 1, 1, tzinfo=timezone.utc)
                us = (at.days * 86_400 + at.seconds) * _MICRO + at.microseconds
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = us if self.low is None else max(self.low, us)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high = us if self.high is None else min(self.high, us)
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for path, size in _files(self.paths):
            m = self.node.search(path)
            node = (m[1] or None) if m else None
            start, end = 0, size
            if path.endswith(".gz"):
                out.append(Piece(path, node, 0, -1))
                continue
            if size and (self.low is not None or self.high is not None):
                store, own = _open(path)
                with store.open_input_file(own) as file:
                    start = bisect_time(file, size, self.low - self.slack, self.clock) if self.low is not None else 0
                    end = bisect_time(file, size, self.high + self.slack + 1, self.clock) if self.high is not None else size
            out += [Piece(path, node, at, min(at + self.range, end)) for at in range(start, end, self.range)]
        return out or [Piece("", None, 0, 0)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        """The lines of the records that start in the piece, each with its record's time and place; lines before a file's first
        record have no time."""
        if not piece.path:
            return
        store, own = _open(piece.path)
        zipped = piece.end < 0
        rows: list[tuple[int, int | None, int | None, str]] = []
        with store.open_input_stream(own, compression="gzip") if zipped else store.open_input_file(own) as file:
            place, skip = (0, False) if zipped or not piece.start else (piece.start - 1, True)
            if place:
                file.seek(place)
            now, record, inside, rest = None, None, not piece.start, b""
            while True:
                data = file.read(BUFFER)
                lines = (rest + data).split(b"\n")
                rest = lines.pop() if data else b""
                for line in lines:
                    at, place = place, place + len(line) + 1
                    if skip or (not data and not line):
                        skip = False
                        continue
                    text = line.rstrip(b"\r").decode(errors="replace")
                    ts = self.clock(text)
                    if ts is not None:
                        if not zipped and at >= piece.end:
                            yield self._batch(piece, rows)
                            return
                        now, record, inside = ts, at, True
                    if inside:
                        rows.append((at, record, now, text))
                if len(rows) >= 10_000 or not data:
                    yield self._batch(piece, rows)
                    rows = []
                if not data:
                    return

    @staticmethod
    def _batch(piece: Piece, rows: list) -> pa.RecordBatch:
        n = len(rows)
        columns = [pa.array([piece.path] * n, pa.string()), pa.array([piece.node] * n, pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()).cast(pa.timestamp("us", "UTC")), pa.array([r[3] for r in rows], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["path", "node_id", "offset", "record", "ts", "line"])


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ringwatch_logs"

    def schema(self) -> str:
        return KIND

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)


def assemble_log_records(rows: DataFrame) -> DataFrame:
    """read_log_range's lines as records (path, node_id, line_no, line, extra) for parse_header: line_no is the byte offset of the
    record's first line, extra its other lines. Lines before a file's first record are dropped."""
    rows = rows.filter("record is not null").groupBy("path", "node_id", "record").agg(F.array_sort(F.collect_list(F.struct("offset", "line"))).alias("_lines"))
    rest = F.slice("_lines", F.lit(2), F.size("_lines"))
    return rows.select("path", "node_id", F.col("record").alias("line_no"), F.element_at("_lines", 1)["line"].alias("line"), F.transform(rest, lambda x: x["line"]).alias("extra"))


def read_log_range(spark: SparkSession, paths: str | Sequence[str], layout: str = DEFAULT_LAYOUT, zone: str = "UTC", node_pattern: str = NODE, slack_ms: int = SLACK_MS, range_bytes: int = RANGE) -> DataFrame:
    """(path, node_id, offset, record, ts, line) of log files: every line with its byte offset, and the offset and time of the record it
    belongs to.

    A filter on ts reaches the files: each file is bisected for the first line of the range, on the driver, by some 20 reads of
    64 kB, and only the bytes of the range are planned, in pieces of `range_bytes`. Times in a file may run back by `slack_ms`;
    records that are further out of order than that may be missed by a filter. A piece holds the records that begin in it, so lines
    of a record stay together, and pieces of one file are read in parallel. Gzipped files are read whole, in one piece. Times without
    a zone are of `zone`. (path, offset) is the order of lines; assemble_log_records takes these rows.

    Turns on spark.sql.python.filterPushdown.enabled, without which Spark filters the whole files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LogSource)
    local = [re.sub(r"^file:/+", "/", p) for p in ([paths] if isinstance(paths, str) else paths)]
    options = {"paths": "\n".join(local), "layout": layout, "zone": zone, "node_pattern": node_pattern, "slack_ms": str(slack_ms), "range_bytes": str(range_bytes)}
    return spark.read.format(LogSource.name()).options(**options).load()
