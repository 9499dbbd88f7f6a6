"""The log data source: byte ranges of a time range, rows equal to a full read, records kept whole."""

import gzip
import random
from datetime import datetime, timedelta

import pyarrow.fs as fs
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

from ringwatch.sources import logs as L
from ringwatch.sources import text as T

START = datetime(2024, 1, 1)


def stamp(s):
    return (START + timedelta(seconds=s)).strftime("%Y-%m-%d %H:%M:%S,%f")[:-3]


def record(s, message, extra=()):
    return [f"INFO  [t:1] {stamp(s)} A.java:{int(s) % 90 + 1} - {message}", *extra]


def write(path, lines, end="\n", last=True):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes((end.join(lines) + (end if last else "")).encode())


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """Five logs: stack traces below records, lines before the first record, no last line end, times out of order, gzip."""
    root, r = tmp_path_factory.mktemp("logs"), random.Random(2)
    rows = [line for k in range(3000) for line in record(k * 10, f"m{k} é", ["java.lang.X", "  at y"] * r.randint(0, 2))]
    write(root / "10.0.0.1" / "system.log", ["no header", "none", *rows])
    write(root / "10.0.0.2" / "system.log", [x for k in range(2000) for x in record(k * 15 + r.choice([0, 0, 0, -40, 30]), f"n{k}")], "\r\n", False)
    write(root / "10.0.0.3" / "system.log", [])
    write(root / "10.0.0.4" / "system.log", record(12_000, "one"), last=False)
    (root / "10.0.0.5").mkdir()
    (root / "10.0.0.5" / "old.log.gz").write_bytes(gzip.compress("\n".join([x for k in range(500) for x in record(k * 60, f"z{k}", ["more"])]).encode()))
    return root


@pytest.mark.parametrize("range_bytes", [1 << 26, 5_000])
def test_a_range_gives_the_rows_of_the_full_read(spark, files, range_bytes):
    whole = L.read_log_range(spark, str(files), range_bytes=range_bytes)
    want = []
    for path in sorted(files.rglob("*.log*")):
        data = gzip.decompress(path.read_bytes()) if path.suffix == ".gz" else path.read_bytes()
        clock, now, at = L.Clock(T.DEFAULT_LAYOUT, "UTC"), None, 0
        for line in data.split(b"\n"):
            text = line.rstrip(b"\r").decode()
            now = clock(text) if clock(text) is not None else now
            if line or at < len(data):
                want.append((path.parent.name, at, None if now is None else now // 1000, text))
            at += len(line) + 1
    got = sorted((r.node_id, r.offset, None if r.us is None else r.us // 1000, r.line) for r in whole.withColumn("us", F.unix_micros("ts")).collect())
    assert got == sorted(want) and len(got) > 6000
    for low, high in ((0, 100), (9_000, 9_600), (11_990, 12_010), (29_000, 99_000), (-50, -10), (5, 5)):
        a, b = (F.lit(START + timedelta(seconds=s)).cast("timestamp") for s in (low, high))
        some = whole.filter((F.col("ts") >= a) & (F.col("ts") < b))
        limits = [(START + timedelta(seconds=s) - datetime(1970, 1, 1)) // timedelta(milliseconds=1) for s in (low, high)]
        expected = sorted(w for w in want if w[2] is not None and limits[0] <= w[2] < limits[1])
        assert sorted((r.node_id, r.offset, r.us // 1000, r.line) for r in some.withColumn("us", F.unix_micros("ts")).collect()) == expected


def test_a_narrow_range_reads_few_bytes(spark, tmp_path):
    write(tmp_path / "big.log", [x for k in range(200_000) for x in record(k, f"message number {k} with some more text")])
    reader = L.LogReader({"paths": str(tmp_path / "big.log")})
    bounds = [GreaterThanOrEqual(("ts",), START + timedelta(seconds=100_000)), LessThan(("ts",), START + timedelta(seconds=102_000))]
    assert list(reader.pushFilters(bounds)) == bounds
    pieces, size = reader.partitions(), (tmp_path / "big.log").stat().st_size
    assert sum(p.end - p.start for p in pieces) < 0.05 * size
    lines = [x for p in pieces for b in reader.read(p) for x in b.column("line").to_pylist()]
    assert sum("number 100000 " in x or "number 101999 " in x for x in lines) == 2
    rows = L.read_log_range(spark, str(tmp_path / "*.log")).filter((F.col("ts") >= "2024-01-02 03:46:40") & (F.col("ts") < "2024-01-02 03:46:50"))
    assert rows.count() == 10


def test_bisection_finds_the_first_record(tmp_path, monkeypatch):
    monkeypatch.setattr(L, "STEP", 64)
    clock = L.Clock(T.DEFAULT_LAYOUT, "UTC")
    lines = [x for k in range(300) for x in record(k // 3 * 2, f"m{k}", ["x" * (k % 200)])]
    write(tmp_path / "a.log", lines)
    data = (tmp_path / "a.log").read_bytes()
    starts, at = [], 0
    for line in data.split(b"\n"):
        if clock(line.decode()) is not None:
            starts.append((clock(line.decode()), at))
        at += len(line) + 1
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "a.log")) as file:
        for us in {t + d for t, _ in starts for d in (-1, 0, 1)}:
            assert L.bisect_time(file, len(data), us, clock) == next((p for t, p in starts if t >= us), len(data))


def test_records_of_a_range_are_whole(spark, files):
    rows = L.read_log_range(spark, str(files / "10.0.0.1" / "system.log"), range_bytes=3_000)
    records = T.parse_header(L.assemble_log_records(rows))
    got = {r.message: (len(r.extra), r.src_line) for r in records.collect()}
    assert len(got) == 3000 and got["m7 é"][1] == 71
    plain = T.assemble_records(T.read_log_lines(spark, str(files / "10.0.0.1" / "system.log")))
    assert sorted(len(r.extra) for r in plain.collect()) == sorted(n for n, _ in got.values())


def test_missing_files_and_layouts_without_a_time(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        L.read_log_range(spark, str(tmp_path / "nowhere.log")).collect()
    with pytest.raises(ValueError, match="no time"):
        L.Clock("%level %msg", "UTC")
    (tmp_path / "empty").mkdir()
    assert L.read_log_range(spark, str(tmp_path / "empty")).collect() == []
