"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")

#: Texts rewritten together.
CHUNK = 1_000
#: Candidate strings for the entropy test, and the window over them.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Least window entropy in bits by character class (digits and one case of letters up to f; letters of
#: one case and digits; both cases and digits, with or without base64 marks).
LEAST_BITS = {"hex": 3.0, "single_case": 3.7, "mixed_case": 3.8}
#: What looks random but is public: UUIDs, dates and times, runs of one alphabet, sample values, paths.
ALLOWED = re.compile(
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}|[0-9-]+(T[0-9-]*Z?)?"
    r"|.*(abcdefghij|ABCDEFGHIJ|0123456789|[Ee]xample|EXAMPLE|[Ll]orem|sha256-|sha384-|sha512-).*|([A-Za-z]+[-_/])+[A-Za-z]*[0-9]{0,4}=*"
)


#: c log2 c of each count in a window.
_TERMS = tuple(c * math.log2(c) if c else 0.0 for c in range(WINDOW + 1))


def window_entropy(text: str) -> float:
    """Largest Shannon entropy (bits per character) of a window of text, from counts kept while it slides."""
    n, terms = min(WINDOW, len(text)), _TERMS
    if not n:
        return 0.0
    counts: dict[str, int] = {}
    total = 0.0  # sum of c log2 c over the window's characters
    for c in text[:n]:
        k = counts.get(c, 0)
        counts[c] = k + 1
        total += terms[k + 1] - terms[k]
    least = total
    for old, new in zip(text, text[n:]):
        if old != new:
            k = counts[old]
            counts[old] = k - 1
            total += terms[k - 1] - terms[k]
            k = counts.get(new, 0)
            counts[new] = k + 1
            total += terms[k + 1] - terms[k]
            least = min(least, total)
    return math.log2(n) - least / n


def character_class(text: str) -> str | None:
    """The class whose threshold applies; None where letters or digits are missing, as in plain words and numbers."""
    digit, lower, upper = (any(f(c) for c in text) for f in (str.isdigit, str.islower, str.isupper))
    if not digit or not (lower or upper):
        return None
    if lower and upper:
        return "mixed_case"
    return "hex" if not set(text.lower()) - set("0123456789abcdef") else "single_case"


def entropy_spans(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of candidates whose window entropy reaches their class's threshold, that no taken span (sorted by start)
    touches and the allow-list doesn't name. Candidates and taken spans are swept once, side by side."""
    out, at, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while at < len(taken) and taken[at][0] < e:
            reach = max(reach, taken[at][1])
            at += 1
        kind = character_class(m[0])
        if kind is None or s < reach or ALLOWED.fullmatch(m[0]):
            continue
        if window_entropy(m[0]) >= LEAST_BITS[kind]:
            out.append((s, e))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the fixed patterns, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and these with the entropy spans."""
    base = base_spans(text)
    return base, sorted(base + [(s, 3, e) for s, e in entropy_spans(text, [(s, e) for s, _, e in base])])


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts = np.zeros((b.num_rows, 3), np.int64)
        digests, spans = [], []
        for row, t in enumerate(b.column("text")):
            base, every = all_spans(t.as_py() or "")
            for _, k, _ in base:
                counts[row, k] += 1
            digests.append(hashlib.sha256(_named(base).encode()).hexdigest())
            spans.append(_named(every))
        columns = [b.column("doc_id"), *(pa.array(counts[:, k]) for k in range(3)), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of docs (doc_id, text).

    Spans are kind:start:end in code points, end exclusive, by start and then kind. A null text counts as empty:
    counts 0, spans empty. Rows are independent, so repeated rows and null doc_ids pass through; other columns
    are ignored. Texts are scanned whole; time and memory are linear in a text's length.
    """
    kinds = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, kinds)


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span replaced by the mark; overlapping spans become one mark."""
    out, at = [], 0
    for s, _, e in all_spans(text)[1]:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]]) if at else text


def _redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            b = batch.slice(at, CHUNK)
            found = [None if t is None else redact(t) for t in b.column("text").to_pylist()]
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(found, pa.string()))


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with the secrets of `text` replaced by a mark and n_chars, where it is a column, set anew; null texts stay."""
    out = docs.withColumn("text", F.col("text").cast("string")).mapInArrow(_redact, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")) if "n_chars" in docs.columns else out


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
