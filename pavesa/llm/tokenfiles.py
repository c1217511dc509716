"""Token ids as Parquet list columns, one file for each range of documents.

Files are written by Spark's own writer and commit, so a lost task leaves nothing behind. Each column has the encoding that suits it:

* ``tokens``: list of int, a dictionary for each row group (ids follow Zipf's law, so few bits are enough);
* ``doc_id``, ``at``, ``n_tokens``, ``shard``: delta encoding (pages of version 2), a few bits for each row as they rise slowly or hardly change.

Row groups and pages are small and pages have an index (least and greatest value), so a range of documents reads only its pages, and a read without
``tokens`` never touches their bytes. ``at`` is a document's place within its file; ``files.parquet`` beside the data holds one row a file with the ids of all
files before it, so the start of a document is a sum of two numbers and no pass over the tokens is needed.

A text is cut at ASCII white space, where the tokenizer always cuts (it drops white space before it merges), so ids of common words come from a
bounded memory and the library encodes the rest; a text of any length is encoded in pieces.

Defined cases: a null or empty text has the end id alone; repeated ids keep all their rows, ordered by the text's hash, then the text;
null ids come first; an empty table gives an empty folder of the right columns; other columns stay out of the files.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = 1
#: Words whose ids are remembered by a task, and their bytes at most.
MEMORY = 1_000_000
MEMORY_BYTES = 48
#: Words of a text that are looked up at once.
WORDS = 100_000
WRITER = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#tokens.list.element": "true",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "5000",
    "compression": "zstd",
}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A file of the installed tokenizer package; any other path of a tokenizer that drops white space will do as well."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as int32 bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.memory: dict[bytes, bytes] = {}
        names = map(self.library.id_to_token, range(self.library.get_vocab_size()))
        self.last = np.array([(n or "").endswith("</w>") for n in names])  # ids that end a word
        self.mark = {m: self._one(m) for m in b".,;:!?" for m in [bytes([m])]}

    def _one(self, word: bytes) -> bytes:
        return np.array(self.library.encode(word.decode(), add_special_tokens=False).ids, "<i4").tobytes()

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of new words; short ones are kept while there is room.

        A mark after a letter is a word of its own. Plain words are given to the library many at a time, and the ids that end a word tell them apart.
        """
        stems = {w: w[:-1] if w[-1:] in self.mark and w[-2:-1].isalpha() else w for w in words}
        new = {s for s in stems.values() if s not in self.memory}
        plain = [s for s in new if (t := s.decode()).isalpha() and max(t) < "\u0130"]
        found = {}
        for at in range(0, len(plain), 20_000):
            groups = [plain[i : i + 200] for i in range(at, min(at + 20_000, len(plain)), 200)]
            for group, coded in zip(groups, self.library.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(coded.ids, "<i4")
                ends = np.flatnonzero(self.last[ids]) + 1
                if len(ends) == len(group):
                    found |= {w: x.tobytes() for w, x in zip(group, np.split(ids, ends[:-1]), strict=True)}
        rest = [s for s in new if s not in found]
        for at in range(0, len(rest), 1000):
            part = rest[at : at + 1000]
            coded = self.library.encode_batch_fast([s.decode() for s in part], add_special_tokens=False)
            found |= {s: np.array(e.ids, "<i4").tobytes() for s, e in zip(part, coded, strict=True)}
        known = {w: (found[s] if s in found else self.memory[s]) + (self.mark[w[-1:]] if s is not w else b"") for w, s in stems.items()}
        for w, ids in (found | known).items():
            if len(self.memory) >= MEMORY:
                break
            if len(w) <= MEMORY_BYTES:
                self.memory[w] = ids
        return known

    def encode(self, text: bytes) -> bytes:
        words, out = text.split(), []
        for at in range(0, len(words), WORDS):
            part = words[at : at + WORDS]
            ids = [self.memory.get(w) for w in part]
            if None in ids:
                new = self._learn({w for w, i in zip(part, ids, strict=True) if i is None})
                ids = [new[w] if i is None else i for w, i in zip(part, ids, strict=True)]
            out.append(b"".join(ids))
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker, so that later tasks know the words of earlier ones."""
    return Encoder(path)


def _lists(ids: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def write(docs: DataFrame, path: str, tokenizer: str, end: int | None = END, options: dict[str, str] | None = None) -> None:
    """Files of ``doc_id`` and ``text`` in ascending order of doc_id under ``path``: ``data`` and ``files``."""
    spark = docs.sparkSession
    key = docs.schema["doc_id"]
    order = ["doc_id", "hash", "text"]
    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("text"))
    rows = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions(*order).select("doc_id", "text")
    last = b"" if end is None else np.array([end], "<i4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                ids = [coder.encode(t.as_py() or b"") + last for t in part.column("text")]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                starts = at + np.cumsum(sizes) - sizes
                at += int(sizes.sum())
                shards = pa.array(np.full(len(ids), shard, np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), shards, pa.array(starts), pa.array(sizes), _lists(ids)], names=["doc_id", "shard", "at", "n_tokens", "tokens"])

    kinds = [("shard", T.IntegerType()), ("at", T.LongType()), ("n_tokens", T.LongType()), ("tokens", T.ArrayType(T.IntegerType(), False))]
    schema = T.StructType([key, *(T.StructField(n, k) for n, k in kinds)])
    rows.mapInArrow(run, schema).write.options(**WRITER | (options or {})).parquet(f"{path}/data")
    files = spark.read.schema(schema).parquet(f"{path}/data").groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    # One row a file: a window without groups is small here.
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files.withColumn("base", before).coalesce(1).write.parquet(f"{path}/files")


def files(spark: SparkSession, path: str) -> DataFrame:
    """shard, n_tokens, n_docs, first_doc, last_doc, base: one row a file that holds documents."""
    return spark.read.parquet(f"{path}/files")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, tokens. Columns that aren't used aren't read, and a condition on doc_id reaches the pages."""
    return spark.read.parquet(f"{path}/data").join(files(spark, path).select("shard", "base"), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "tokens")


def window(spark: SparkSession, path: str, start: int, length: int) -> DataFrame:
    """Documents that have ids among those numbered ``start`` to ``start + length``, each with that part of its ids (``tokens``) and where it starts."""
    stop = start + length
    near = files(spark, path).where((F.col("base") < stop) & (F.col("base") + F.col("n_tokens") > start)).select("shard", "base")
    rows = spark.read.parquet(f"{path}/data").join(near, "shard").withColumn("start", F.col("base") + F.col("at"))
    rows = rows.where((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > start))
    skip = F.greatest(F.lit(start) - F.col("start"), F.lit(0))
    size = F.least(F.lit(stop) - F.col("start"), F.col("n_tokens")) - skip
    return rows.select("doc_id", (F.col("start") + skip).alias("start"), F.slice("tokens", (skip + 1).cast("int"), size.cast("int")).alias("tokens"))


def checksums(rows: DataFrame, ids: str = "tokens", name: str = "ids_crc32") -> DataFrame:
    """``rows`` with the crc32 of each list of ids, as little-endian unsigned 32-bit integers, in its place."""
    names = [c for c in rows.columns if c not in (ids, name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(ids)
            flat, ends = column.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), column.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sums, pa.int64())], names=[*names, name])

    return rows.select(*names, ids).mapInArrow(run, T.StructType([*(rows.schema[c] for c in names), T.StructField(name, T.LongType())]))
