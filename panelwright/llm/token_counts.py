"""Token counts by a digest cache.

Content and tokenizer are both named by digests.  Counts already stored for a
pair of digests are joined in; only the distinct texts without one are encoded,
once each, and their counts are appended to the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from importlib.metadata import version
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store, words

CACHE = T.StructType([T.StructField("digest", T.StringType()), T.StructField("tokenizer", T.StringType()), T.StructField("n_tokens", T.LongType())])


def tokenizer_digest(path: str) -> str:
    """Digest of the tokenizer's file and of its library's version: either may change a count."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    h = hashlib.sha256(f"{library} {version(library)}\n".encode())
    h.update(Path(path).read_bytes())
    return h.hexdigest()


def _counter(path: str):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in batches:
            for part in words.blocks(batch, "text", 1 << 20):
                count = count or _counter(path)
                n = count(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.asarray(n, dtype=np.int64))], names=["digest", "n_tokens"])

    return run


def content_digest(text) -> F.Column:
    """Digest of the content as the tokenizer gets it: null reads as empty, nothing else is changed, as any other change could change the count."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, n_bytes, n_tokens, digest) for each row of docs.

    tokenizer_path: a file of the ``tokenizers`` (.json) or ``sentencepiece``
    (.model) library, at the same place on every executor.  cache_path: folder
    of the cache; without one, an empty cache in the shared folder is begun.

    Null texts count as empty: 0 bytes, and the tokens of an empty text.  Ids may
    be null or repeated: rows are joined by content, so each input row gives one
    row.  Other columns are ignored.  An empty table gives no rows and appends
    nothing.
    """
    spark = docs.sparkSession
    store.ship(spark)
    cache_path = cache_path or store.new_path(spark, "token-cache")
    tokenizer = tokenizer_digest(tokenizer_path)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", content_digest(F.col("text")))

    wanted = rows.select("digest", "text")
    if (known := _read(spark, cache_path, tokenizer)) is not None:
        wanted = wanted.join(known.select("digest"), "digest", "left_anti")
    # one text for each digest; copies within a task go before the exchange
    misses = wanted.groupBy("digest").agg(F.first("text").alias("text"))
    found = misses.mapInArrow(_encode(tokenizer_path), "digest string, n_tokens long")
    found.select("digest", F.lit(tokenizer).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)
    store.release(spark)

    # as plain files on one side Spark can split a frequent digest's rows on the other
    counts = store.materialise(_read(spark, cache_path, tokenizer), "token-counts")
    sized = rows.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    joined = sized.join(counts.hint("merge"), "digest", "left")
    return joined.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", "digest")


def _read(spark, path: str, tokenizer: str) -> DataFrame | None:
    """The stored counts of one tokenizer; an append that ran twice leaves equal rows, of which one counts."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        return None
    stored = spark.read.schema(CACHE).parquet(path).where(F.col("tokenizer") == tokenizer)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
