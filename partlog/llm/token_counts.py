"""Token counts of whole texts, with a cache of counts by digest.

A count is a function of the content and of the tokenizer, so it is stored under the digests
of both.  Every text is reduced to a digest; the distinct digests are joined to the stored
counts of this tokenizer version; only what is missing there is encoded, each content once,
and appended to the cache.  What is joined and grouped are digests of 32 bytes; a text moves
once, and only if rows that miss are too many to name them to all tasks.

Normalised content: the text as UTF-8 bytes, null as empty.  Nothing else is normalised,
since anything more, such as joining white space, could change the count of some tokenizer;
what a tokenizer normalises by itself is part of its file, and so of its digest.

The cache is a folder of Parquet files under ``tokenizer=<digest>``, which a reader prunes to
one tokenizer.  It is only ever appended to.  A run that dies leaves nothing or whole files
of right counts; two runs at a time may both append one digest, which lookups allow for.

Very long texts are encoded in pieces for byte-level tokenizers whose pattern never joins a
word to a space behind it; a cut before such a space leaves the tokens as they are.

Defined results: a null or empty text has no bytes and no tokens; bytes that are no UTF-8
count as replacement characters; repeated rows and ids each give a row; null ids stay; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from importlib.metadata import version

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partlog.llm.common import batch_bytes, written
from partlog.llm.words import chunks
from partlog.plans.bounds import at_most

LIMIT = 1024
CHUNK_BYTES = 4 << 20
PIECE = 1 << 20  # code points of a long text that are encoded at a time
NAMED_ROWS = 20_000  # digests of 32 bytes that are broadcast: under 1 MB

STORED = "digest binary, n_tokens bigint"

_BEFORE_SPACE = re.compile(r"(?<=[!-~])(?= )")


@dataclass(frozen=True)
class Tokenizer:
    """A vocabulary file of the ``tokenizers`` or ``sentencepiece`` library, and its digest."""

    model: bytes
    library: str
    digest: str

    @staticmethod
    def load(path: str) -> Tokenizer:
        """``.json`` files are read by ``tokenizers``, ``.model`` files by ``sentencepiece``."""
        library = {".json": "tokenizers", ".model": "sentencepiece"}[os.path.splitext(path)[1]]
        with open(path, "rb") as f:
            model = f.read()
        name = f"{library} {version(library)}\n".encode()
        return Tokenizer(model, library, hashlib.sha256(name + model).hexdigest())


def _cuts_at_spaces(model: bytes) -> bool:
    """Whether tokens of a text are those of its pieces, if cut before spaces."""
    spec = json.loads(model)
    how = spec.get("pre_tokenizer") or {}
    plain = how.get("type") == "ByteLevel" and how.get("use_regex") and not how.get("add_prefix_space")
    added = spec.get("added_tokens") or []
    still = all(not (t.get("lstrip") or t.get("rstrip") or " " in t["content"]) for t in added)
    return bool(plain and still and spec.get("normalizer") is None and spec.get("post_processor") is None)


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` in parts of at least ``size`` code points that begin with a space."""
    at = 0
    while at < len(text):
        cut = _BEFORE_SPACE.search(text, at + size)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


@lru_cache(maxsize=4)
def _encoder(tokenizer: Tokenizer):
    """A function from texts to their numbers of tokens."""
    if tokenizer.library == "sentencepiece":
        from sentencepiece import SentencePieceProcessor

        processor = SentencePieceProcessor(model_proto=tokenizer.model)
        return lambda texts: [len(x) for x in processor.encode(texts, num_threads=1)]

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each task
    from tokenizers import Tokenizer as Library

    library = Library.from_buffer(tokenizer.model)
    library.no_truncation()
    library.no_padding()
    count = lambda texts: [len(x) for x in library.encode_batch(texts, add_special_tokens=False)]
    if not _cuts_at_spaces(tokenizer.model):
        return count
    return lambda texts: [
        sum(n for piece in pieces(x) for n in count([piece])) if len(x) > PIECE else n
        for x, n in zip(texts, count([x if len(x) <= PIECE else "" for x in texts]))
    ]


def digested(docs: DataFrame) -> DataFrame:
    """doc_id, digest and n_bytes of each document."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
    )


class TokenCache:
    """Stored counts of all tokenizers, as a folder of Parquet files."""

    SCHEMA = f"{STORED}, tokenizer string"

    def __init__(self, path: str):
        self.path = path

    def counts(self, spark: SparkSession, tokenizer: Tokenizer) -> DataFrame:
        """The stored (digest, n_tokens) of one tokenizer version; a digest may repeat."""
        stored = spark.read.schema(self.SCHEMA).option("basePath", self.path)
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return spark.createDataFrame([], STORED)
        of_version = stored.parquet(self.path).where(F.col("tokenizer") == tokenizer.digest)
        return of_version.select("digest", "n_tokens")

    def append(self, counts: DataFrame, tokenizer: Tokenizer) -> None:
        """Add (digest, n_tokens) of one tokenizer version."""
        of_version = counts.withColumn("tokenizer", F.lit(tokenizer.digest))
        of_version.write.mode("append").partitionBy("tokenizer").parquet(self.path)


def _encoded(rows: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """(digest, n_tokens) of rows (digest, content); a task encodes a digest once."""
    shared = rows.sparkSession.sparkContext.broadcast(tokenizer)  # a vocabulary file: a few MB

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, done = _encoder(shared.value), set()
        fresh = (
            (digest, content)
            for batch in batches
            for digest, content in zip(batch["digest"], batch["content"])
            if digest not in done and not done.add(digest)
        )
        for part in chunks(fresh, lambda r: len(r[1]), CHUNK_BYTES):
            texts = [bytes(content).decode("utf-8", "replace") for _, content in part]
            yield pd.DataFrame({"digest": [d for d, _ in part], "n_tokens": count(texts)})

    return rows.mapInPandas(encode, STORED)


def count_tokens(
    docs: DataFrame, tokenizer: Tokenizer, cache: TokenCache, limit: int = LIMIT
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each document; the cache grows by misses."""
    spark = docs.sparkSession
    batch_bytes(spark, 500)
    rows = written(digested(docs), "token-digests")
    # Of the documents with one content, those with the least hash of the id are encoded.
    who = F.xxhash64(F.col("doc_id").cast("string"))
    wanted = rows.groupBy("digest").agg(F.min(who).alias("who"))
    stored = cache.counts(spark, tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    known = written(wanted.join(stored, "digest", "left"), "token-known")
    misses = known.where("n_tokens is null").select("digest", "who")
    if not misses.isEmpty():
        text = F.coalesce("text", F.lit("")).cast("binary")
        contents = docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), who.alias("who"), text.alias("content"))
        named = F.broadcast(misses) if at_most(misses, NAMED_ROWS) else misses
        fresh = _encoded(contents.join(named, ["digest", "who"], "left_semi").select("digest", "content"), tokenizer)
        fresh = written(fresh.dropDuplicates(["digest"]), "token-fresh")
        cache.append(fresh, tokenizer)
        hits = known.where("n_tokens is not null").select("digest", "n_tokens")
        known = hits.unionByName(fresh)
    counts = known.select("digest", "n_tokens")
    return rows.join(counts, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
