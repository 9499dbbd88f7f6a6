"""Token counts behind a digest cache: only texts that no earlier run has counted are encoded, each once."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_limit, join_skewed, materialize, shared_folder, table
from .pieces import model_path

LIMIT = 4096
#: Digests of missing texts up to this size are broadcast, so that a run with few new texts shuffles only those; what
#: Spark builds of one digest, at most.
BROADCAST_BYTES, DIGEST_BYTES = 64 << 20, 128
#: Code points of texts encoded together.
CHUNK = 1 << 20
CACHE_KIND = "digest binary, n_tokens long"


def _squeezes(path: str) -> bool:
    """Whether the tokenizer itself replaces every run of white space by one space before it does anything else but composing."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        steps = (json.load(f).get("normalizer") or {}).get("normalizers", [])
    return {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} in [s for s in steps if s["type"] != "NFC"][:1]


def normalised(text: Column, path: str) -> Column:
    """The content that is counted: texts with the same normalised content have the same number of tokens.

    A null is empty. Runs of ASCII white space become one space where the tokenizer does that itself."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ") if _squeezes(path) else text


def tokenizer_version(path: str) -> str:
    """Digest of all that a count depends on besides the text: the vocabulary file, the library and its version, and the normalisation."""
    import sentencepiece
    import tokenizers

    library = tokenizers if path.endswith(".json") else sentencepiece
    with open(path, "rb") as f:
        parts = [f.read(), library.__name__.encode(), library.__version__.encode(), b"squeezed" if _squeezes(path) else b"whole"]
    return hashlib.sha256(b"".join(hashlib.sha256(p).digest() for p in parts)).hexdigest()[:32]


def token_counter(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to their numbers of tokens: the tokenizers library for .json files, sentencepiece for .model files.

    No begin, end or added special tokens, no truncation, no padding; special strings inside texts as the library's default has it."""
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        return lambda texts: [len(e.ids) for e in model.encode_batch(texts, add_special_tokens=False)]
    if not path.endswith(".model"):
        raise ValueError(f"no tokenizer library for {path}")
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: list(map(len, pieces.encode(texts, num_threads=1, add_bos=False, add_eos=False)))


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(path)
        for b in batches:
            texts, counts, at, size = b.column("text").to_pylist(), [], 0, 0
            for k, t in enumerate(texts, 1):
                size += len(t)
                if size >= CHUNK or k == len(texts):
                    counts += count(texts[at:k])
                    at, size = k, 0
            yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("rows"), pa.array(counts, pa.int64())], ["digest", "rows", "n_tokens"])

    return run


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame | None:
    """The stored counts (digest, n_tokens) of one tokenizer version, one row per digest; None where there are none yet.

    Two runs that counted the same text at the same time leave two equal rows, which become one here."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{cache}/version={version}")
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.schema(CACHE_KIND).parquet(str(folder)).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode_misses(docs: DataFrame, missing: DataFrame | None, n_missing: int, path: str) -> DataFrame:
    """(digest, rows, n_tokens) of each distinct text of docs whose digest is in `missing` (of all if that is None): encoded once,
    however many rows have it.

    Equal texts are combined before the shuffle, so a text that fills a third of all rows moves once per task."""
    texts = docs.select(F.unhex(F.sha2(normalised(F.col("text"), path), 256)).alias("digest"), normalised(F.col("text"), path).alias("text"))
    few = missing is not None and DIGEST_BYTES * n_missing <= BROADCAST_BYTES
    if few:
        texts = texts.join(F.broadcast(missing), "digest", "left_semi")
    texts = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), F.first("text").alias("text"))
    if missing is not None and not few:
        texts = texts.join(missing, "digest", "left_semi")
    return texts.mapInArrow(_encoded(path), "digest binary, rows long, n_tokens long")


def count_tokens(docs: DataFrame, path: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs (doc_id, text), through the cache in the folder `cache`.

    Documents and stored counts meet by the digest of the normalised content, within the folder of the tokenizer's
    version; texts move only where they are missing from the cache, and their counts are appended to it. Spark's file
    committer appends them: a lost executor's tasks run again, and a run that stops half-way leaves nothing or whole,
    right rows. A null text counts as empty (0 bytes, 0 tokens); repeated rows and null doc_ids give a row each; other
    columns are ignored; no rows give no rows. over_limit is n_tokens > limit."""
    spark, version = docs.sparkSession, tokenizer_version(path)
    digest = F.unhex(F.sha2(normalised(F.col("text"), path), 256))
    keys = materialize(docs.select(F.col("doc_id").cast("long"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), digest.alias("digest")))
    found, stored = keys.groupBy("digest").agg(F.count(F.lit(1)).alias("rows")), read_cache(spark, cache, version)
    found = materialize(found.withColumn("n_tokens", F.lit(None).cast("long")) if stored is None else found.join(stored, "digest", "left"))
    n = found.agg(F.count_if(F.col("n_tokens").isNull()).alias("missing"), F.count("n_tokens").alias("hits"), F.sum("rows").alias("rows")).first()
    known = found.filter(F.col("n_tokens").isNotNull())
    if n["missing"]:
        missing = found.filter(F.col("n_tokens").isNull()).select("digest") if n["hits"] else None
        fresh = materialize(encode_misses(docs, missing, n["missing"], path))
        fresh.select("digest", "n_tokens").write.mode("append").parquet(f"{cache}/version={version}")
        known = known.unionByName(fresh)
    rows = join_skewed(keys, known, ["digest"], F.col("rows") > hot_limit(n["rows"] or 0))
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


#: The session's setting for the folder of the query's cache.
CACHE_SETTING = "ringwatch.tokenCache"


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, through the cache that the session's ringwatch.tokenCache names. Where that is unset the
    cache is a new folder, so a run's time is that of all its texts and owes nothing to earlier runs."""
    cache = spark.conf.get(CACHE_SETTING, None) or f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}"
    return count_tokens(table(spark, sf_dir, "documents"), model_path(), cache)
