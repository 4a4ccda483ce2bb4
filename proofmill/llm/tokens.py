"""Token counts with a digest cache.

A cache row is (content digest, tokenizer digest, n_tokens). Documents are joined to it by the SHA-256 of
their normalised content; each distinct content without a row is encoded once, by one task, and appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm import scratch

CACHE_SCHEMA = "content binary, tokenizer string, n_tokens bigint"
#: A tokenizer file over this size is not broadcast but refused.
MAX_TOKENIZER_BYTES = 64 << 20
#: Characters that one call of the library gets at most, unless a single text is longer.
CHUNK_CHARS = 100_000
#: Rows of a batch that are Python strings at a time.
SLICE_ROWS = 128
_LOADED: dict[str, object] = {}


def normalised(text):
    """What is digested and encoded: the text itself, and the empty text for null."""
    return F.coalesce(text, F.lit(""))


def tokenizer_version(data: bytes, kind: str) -> str:
    """Digest of all that decides a count: library, its version, how it is called, and the tokenizer file."""
    if kind == "json":
        import tokenizers as library
    else:
        import sentencepiece as library
    return hashlib.sha256(f"{kind}:{library.__version__}:plain:".encode() + data).hexdigest()


def _load(version: str, data: bytes, kind: str):
    if version not in _LOADED:
        if kind == "json":
            from tokenizers import Tokenizer

            _LOADED[version] = Tokenizer.from_str(data.decode())
            _LOADED[version].no_truncation()
            _LOADED[version].no_padding()
        else:
            import sentencepiece

            _LOADED[version] = sentencepiece.SentencePieceProcessor(model_proto=data)
    return _LOADED[version]


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    held, chars = [], 0
    for text in texts:
        if held and chars + len(text) > CHUNK_CHARS:
            yield held
            held, chars = [], 0
        held.append(text)
        chars += len(text)
    if held:
        yield held


def _counts(tokenizer, kind: str, texts: list[str]) -> list[int]:
    if kind == "json":
        return [len(e.ids) for part in _chunks(texts) for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
    return [len(ids) for part in _chunks(texts) for ids in tokenizer.encode(part, num_threads=1)]


def encode_counts(texts: DataFrame, data: bytes, kind: str) -> DataFrame:
    """(content, n_tokens) of rows (content, text), each encoded in the task that holds it."""
    if len(data) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"the tokenizer has {len(data)} bytes, over {MAX_TOKENIZER_BYTES}")
    shared, version = texts.sparkSession.sparkContext.broadcast(data), tokenizer_version(data, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = _load(version, shared.value, kind)
        for batch in batches:
            column = batch.column("text")
            counts = [n for at in range(0, len(column), SLICE_ROWS) for n in _counts(tokenizer, kind, column.slice(at, SLICE_ROWS).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(counts, pa.int64())], ["content", "n_tokens"])

    return texts.select("content", "text").mapInArrow(run, "content binary, n_tokens bigint")


def count_tokens(
    docs: DataFrame, data: bytes, kind: str = "json", cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 512
) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit), one for each row of ``docs``, repeated rows included.

    ``data`` is the tokenizer file, ``kind`` "json" or "model". ``cache_path`` is a cache that may not exist yet;
    without one the call has a cache of its own. Null text counts as empty (0 tokens); null ids are kept;
    other columns are ignored whatever their names; an empty table gives no rows. Texts are encoded whole.
    Appending twice after a lost task or a race of two writers does no harm: equal keys have equal counts.
    """
    spark: SparkSession = docs.sparkSession
    version = tokenizer_version(data, kind)
    path = cache_path or scratch.new_path(spark, "token-cache")
    text = normalised(F.col(text_col))
    keyed = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("content"), F.octet_length(text).cast("long").alias("n_bytes"))
    # One row of each content carries its text on; digests alone are aggregated, so copies move no text twice.
    missing = keyed.groupBy("content").agg(F.min("id").alias("first_id"))
    if scratch.exists(spark, path):
        missing = missing.join(spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("tokenizer") == version), "content", "left_anti")
    texts = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("content"), text.alias("text"))
    wanted = missing.select("first_id", F.col("content").alias("wanted"))
    texts = texts.join(wanted, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("content") == F.col("wanted")), "left_semi")
    # A row repeated with its id is encoded again but stored once.
    counts = encode_counts(texts, data, kind).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    counts.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(path)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    return keyed.join(stored, "content").select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
