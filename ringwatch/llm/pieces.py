"""SentencePiece BPE encoding and decoding by vectorised merge rounds over flat symbol arrays."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import table

SPACE = "▁"
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Symbols above which a segment is merged with a heap instead, whose time doesn't depend on the number of rounds.
LONG = 4_000
#: Segments kept with their ids; texts encoded together.
KEPT, CHUNK = 100_000, 256
NONE = np.iinfo(np.int64).max


class PieceModel:
    """The merge tables of a SentencePiece BPE model with byte fallback, a dummy prefix and no normalisation.

    A pair of adjacent symbols merges if their text is a piece; the highest score wins, the leftmost on a tie. No
    piece has the space mark after another character, so merges never cross the start of a run of space marks and
    each segment is encoded by itself.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.piece = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        ids = {self.piece[i]: i for i in plain}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in ids) or model.normalize("A  Ａ ") != f"{SPACE}A{SPACE}{SPACE}Ａ{SPACE}":
            raise ValueError("pieces that span words and models that normalise text are not supported")
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        scores = np.array([model.get_score(i) for i in plain])
        rank = dict(zip(plain, np.unique(-scores, return_inverse=True)[1].tolist(), strict=True))
        self.rank = np.zeros(n, np.int64)
        self.rank[list(rank)] = list(rank.values())
        self.char = np.full(0x110000, -1, np.int64)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        pairs = {}  # symbols that aren't pieces never merge: a piece holds only characters that are pieces, or pairs none of which exist
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = i
        self.n = n
        self._fill(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs)))
        self.pairs = pairs
        #: Pieces of which a longer merge ranks as well or better: their occurrences are merged one at a time.
        self.early = np.zeros(n, bool)
        for key, i in pairs.items():
            for part in divmod(key, n):
                self.early[part] |= self.rank[i] <= self.rank[part]
        single = [p for p in ids if len(p) > 1 and any(c not in ids for c in p)]
        if single:
            raise ValueError("pieces with characters that aren't pieces are not supported")
        self.known: dict[str, tuple[int, bytes]] = {}
        self.text = [b"%d" % i for i in range(n)]
        self.is_byte = np.isin(np.arange(n), self.byte).tolist()
        self.out = [p.replace(SPACE, " ").encode() for p in self.piece]
        for b, i in enumerate(self.byte):
            self.out[i] = bytes([b])

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Two-level hash table: keys that collide in the first level go to a sorted rest."""
        self.bits = int(np.ceil(np.log2(len(keys) * 4 + 2)))
        slot = self._slot(keys)
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        self.keys[slot], self.values[slot] = keys, values
        lost = self.keys[slot] != keys
        order = np.argsort(keys[lost])
        self.rest_keys, self.rest_values = keys[lost][order], values[lost][order]
        self.crowded = np.zeros(1 << self.bits, bool)
        self.crowded[slot[lost]] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, or -1."""
        key = np.where((a < 0) | (b < 0), -2, a * self.n + b)
        slot = self._slot(key)
        got = np.where(self.keys[slot] == key, self.values[slot], -1)
        again = np.flatnonzero((got < 0) & self.crowded[slot] & (key >= 0))
        if len(again) and len(self.rest_keys):
            at = np.minimum(np.searchsorted(self.rest_keys, key[again]), len(self.rest_keys) - 1)
            got[again] = np.where(self.rest_keys[at] == key[again], self.rest_values[at], -1)
        return got

    def symbols(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The final symbols of all segments in one array, and how many each has. A symbol is the id of a piece, or
        -1 - code point for a character without a piece."""
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        ready = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for k in np.flatnonzero(size > LONG).tolist():
            found = self._long(segments[k])
            ready.append((found, np.full(len(found), k)))
        short = np.flatnonzero(size <= LONG)
        points = np.frombuffer("".join([segments[k] for k in short.tolist()]).encode("utf-32-le"), "<u4").astype(np.int64)
        sym = self.char[points]
        sym = np.where(sym < 0, -1 - points, sym)
        word = np.repeat(short, size[short])
        made = self._pairs(sym, word)
        while len(sym):
            rank = np.where(made >= 0, self.rank[made], NONE)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            spread = np.diff(np.r_[starts, len(sym)])
            done = least == NONE
            if done.any():
                keep = ~np.repeat(done, spread)
                ready.append((sym[~keep], word[~keep]))
                sym, word, made, rank = sym[keep], word[keep], made[keep], rank[keep]
                if not len(sym):
                    break
                least, spread = least[~done], spread[~done]
            hit = rank == np.repeat(least, spread)
            at = np.flatnonzero(hit)
            first = np.r_[True, word[at[1:]] != word[at[:-1]]]  # leftmost of its word
            run = np.flatnonzero(np.r_[True, at[1:] != at[:-1] + 1])  # of touching pairs every second one merges
            odd = (np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 1
            starts = np.flatnonzero(first)
            alone = np.logical_or.reduceat(self.early[made[at]], starts)
            at = at[~odd & (first | ~np.repeat(alone, np.diff(np.r_[starts, len(at)])))]
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.zeros(len(sym), bool)
            moved[at] = True
            moved[at[at > 0] - 1] = True
            # the pair to the left of a merged one starts at the symbol kept before it
            left = at[(at > 1)]
            gone = left[~keep[left - 1]]
            moved[gone - 2] = True
            sym, word, made, moved = sym[keep], word[keep], made[keep], np.flatnonzero(moved[keep])
            nxt = np.minimum(moved + 1, len(sym) - 1)
            inside = (nxt > moved) & (word[nxt] == word[moved])
            made[moved] = np.where(inside, self.merged(sym[moved], sym[nxt]), -1)
        sym, word = (np.concatenate(x) for x in zip(*ready, strict=True))
        return sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(segments))

    def _pairs(self, sym: np.ndarray, word: np.ndarray) -> np.ndarray:
        made = np.full(len(sym), -1, np.int64)
        if len(sym) > 1:
            made[:-1] = np.where(word[1:] == word[:-1], self.merged(sym[:-1], sym[1:]), -1)
        return made

    def _long(self, segment: str) -> np.ndarray:
        """The same merges one by one, for a segment of very many symbols."""
        points = np.frombuffer(segment.encode("utf-32-le"), "<u4").astype(np.int64)
        sym = np.where(self.char[points] < 0, -1 - points, self.char[points]).tolist()
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(sym) and sym[i] >= 0 and sym[j] >= 0:
                made = self.pairs.get(sym[i] * self.n + sym[j])
                if made is not None:
                    heapq.heappush(heap, (int(self.rank[made]), i, j, sym[i], sym[j]))

        gone = [False] * len(sym)
        for i in range(len(sym) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if gone[i] or gone[j] or sym[i] != a or sym[j] != b or after[i] != j:
                continue
            sym[i], gone[j], after[i] = self.pairs[a * self.n + b], True, after[j]
            if after[j] < len(sym):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return np.array([s for s, g in zip(sym, gone, strict=True) if not g], np.int64)

    def ids(self, sym: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of final symbols, and how many each segment has; a character without a piece becomes its UTF-8 bytes."""
        odd = sym < 0
        if not odd.any():
            return sym, count
        chars = "".join(map(chr, (-1 - sym[odd]).tolist()))
        width = np.ones(len(sym), np.int64)
        width[odd] = np.fromiter((len(c.encode()) for c in chars), np.int64, len(chars))
        out = np.repeat(sym, width)
        out[np.repeat(odd, width)] = self.byte[np.frombuffer(chars.encode(), np.uint8)]
        reached = np.r_[0, np.cumsum(width)][np.r_[0, np.cumsum(count)]]
        return out, np.diff(reached)

    def encode(self, texts: list[str]) -> list[list[tuple[int, bytes, bytes]]]:
        """For each text its segments as (number of ids, ids joined by commas, decoded bytes)."""
        cut = [_SEGMENT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        words = set().union(*cut)
        new = words - self.known.keys()
        if len(self.known) + len(new) > KEPT:
            self.known.clear()
            new = words
        fresh = list(new)
        ids, count = self.ids(*self.symbols(fresh)) if fresh else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        flat = ids.tolist()
        text, out = [self.text[i] for i in flat], [self.out[i] for i in flat]
        at = 0
        for s, n in zip(fresh, count.tolist(), strict=True):
            self.known[s] = (n, b",".join(text[at : at + n]), b"".join(out[at : at + n]))
            at += n
        known = self.known
        return [[known[s] for s in segments] for segments in cut]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, space marks as spaces, runs of bytes as UTF-8 (each bad byte as U+FFFD), the
        space mark of the first piece dropped; control ids give nothing and the unknown id gives the library's mark."""
        out, run, first = [], [], True
        for i in ids:
            if self.is_byte[i]:
                run.append(self.out[i])
                first = False
                continue
            if run:
                out.append(_utf8(b"".join(run)))
                run = []
            if i in (1, 2):
                continue
            piece = " \u2047 " if i == 0 else self.piece[i].replace(SPACE, " ")
            out.append(piece[1:] if first and i and piece[0] == " " else piece)
            first = False
        return "".join([*out, _utf8(b"".join(run))])


def _utf8(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        return "".join(chr(0xFFFD) if 0xDC80 <= ord(c) <= 0xDCFF else c for c in data.decode(errors="surrogateescape"))


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(path)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                b = batch.slice(at, CHUNK)
                counts, ids, texts = [], [], []
                for segments in model.encode([t or "" for t in b.column("text").to_pylist()]):
                    counts.append(sum([s[0] for s in segments]))
                    ids.append(hashlib.sha256(b",".join([s[1] for s in segments])).hexdigest())
                    data = b"".join([s[2] for s in segments])
                    texts.append(hashlib.sha256(data[1:] if data[:1] == b" " else data).hexdigest())
                columns = [b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string()), *b.columns[2:]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *b.schema.names[2:]])

    return run


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(path)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                b = batch.slice(at, CHUNK)
                found = [np.fromiter(map(int, b",".join([s[1] for s in segments]).split(b",")), np.int32) if segments else [] for segments in model.encode([t or "" for t in b.column("text").to_pylist()])]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row of docs; null and empty texts give an empty array."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_ids(model_path), "doc_id long, ids array<int>")


def _texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(path)
        for b in batches:
            found = [model.decode(i or []) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "text"])

    return run


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of every row of (doc_id, ids); null ids give an empty text."""
    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(_texts(model_path), "doc_id long, text string")


def token_digests(docs: DataFrame, model_path: str, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs (doc_id, text), and its columns `keep`.

    A null text counts as empty: no ids, and both digests are those of the empty string. Rows are independent, so
    repeated rows and null doc_ids pass through and other columns are ignored. Texts are encoded whole; the memory
    of a task is bounded by a chunk of texts and the table of recent segments.
    """
    kinds = StructType.fromDDL("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select(F.col("doc_id").cast("long"), "text", *keep).mapInArrow(_digests(model_path), StructType([*kinds.fields, *[docs.schema[c] for c in keep]]))


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), model_path())
