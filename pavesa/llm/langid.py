"""Language identification with a bit-sliced Bloom filter of character n-grams.

A slot of the filter is a set of languages, one bit each; an n-gram has HASHES slots, and the AND of them is the set of languages that
contain it. A text asks for all of its n-grams at once; per language, the hits are counted and corrected for false positives with that
language's fill. The language with most hits decides.

Learning counts every n-gram of every training text, per task first, then by (language, n-gram) in a shuffle. An n-gram belongs to each
language in which it is at least SHARE times as frequent as in its best language, so that borrowed or mislabelled text doesn't enter, and has
at least LEAST of each MILLION n-grams. So a language has at most MILLION / LEAST n-grams whatever the corpus holds, a small one all it has,
and the same text counts as much at every input size. The slots are as many as the n-grams of the largest language need to fill a share of FILL
at most (2^21 at the bound, 16 MB for each 62 languages); the filter is folded by slot on the executors, and its size is what the driver and
each task get.

Texts are lower-cased; runs of non-letters become one space, and so does each end. Long texts are read in overlapping pieces, never cut off.

A document is accepted as text of its language if at least KNOWN of its n-grams are known in it. On the tables of the tests, pages of random
letters or base64 know 0.15 of them at most, and held-out documents of each language 0.6 at least, also when cut to 20 characters.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; if no n-gram is known, the language with most training n-grams is
given with score 0 (ties: the first by name); with nothing learned all is ``und``, and each text with a letter
is accepted, since there is no evidence against it. Rows with a null language are not learned from. Repeated
rows are judged alike. An input column that has the name of a result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pavesa.llm.common import cut_lineage

ORDERS = (2, 3, 4)
HASHES = 3
FILL = 0.5
LEAST_BITS = 16
SHARE = 0.3
LEAST = 3
MILLION = 1_000_000
PIECE = 100_000
FLUSH = 2_000_000
WORD_BITS = 62
UNKNOWN = "und"
KNOWN = 0.5

_LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> str:
    """Words of letters in lower case, a space before, between and after; no letters: empty."""
    words = _LETTERS.findall(text.lower()) if text else []
    return f" {' '.join(words)} " if words else ""


def _mixed(x: np.ndarray) -> np.ndarray:
    """A finalizer: every bit of the result depends on every bit given."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    return x * np.uint64(0xBF58476D1CE4E5B9) ^ (x >> np.uint64(32))


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, hash) of each n-gram, for some texts at a time. Texts are as ``letters`` gives them."""
    chunk: list[tuple[int, str, int]] = []
    size, reach = 0, max(ORDERS) - 1
    for i, text in enumerate(texts):
        for at in range(0, len(text), PIECE):
            part = text[at : at + PIECE + reach]
            chunk.append((i, part, min(PIECE, len(text) - at)))
            size += len(part)
            if size >= PIECE:
                yield _grams(chunk)
                chunk, size = [], 0
    if chunk:
        yield _grams(chunk)


def _grams(chunk: list[tuple[int, str, int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for _, p, _ in chunk])
    code = np.frombuffer("".join(p for _, p, _ in chunk).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left = np.repeat(sizes, sizes) - place
    own = place < np.repeat([n for _, _, n in chunk], sizes)  # n-grams that start in the overlap belong to the next piece
    owner = np.repeat([i for i, _, _ in chunk], sizes)
    out_owner, out_hash = [], []
    value = np.zeros(len(code), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        shifted = np.zeros(len(code), np.uint64)
        shifted[: len(code) - n + 1] = code[n - 1 :]
        value = value * np.uint64(0x100000001B3) + shifted + np.uint64(1)
        if n in ORDERS:
            fits = own & (left >= n)
            out_owner.append(owner[fits])
            out_hash.append(_mixed(value[fits] + np.uint64(n)))
    return np.concatenate(out_owner), np.concatenate(out_hash)


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The HASHES slots of each n-gram."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([((hashes + np.uint64(j) * step) & np.uint64((1 << bits) - 1)).astype(np.int64) for j in range(HASHES)])


def count_grams(rows: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of lang, text. A task keeps distinct n-grams only, and hands them on when they are many."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, (gram, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by.setdefault(lang, []).append(letters(text))
            for lang, texts in by.items():
                for _, found in grams(texts):
                    gram, n = np.unique(found, return_counts=True)
                    if lang in held:
                        gram, at = np.unique(np.concatenate([held[lang][0], gram]), return_inverse=True)
                        n = np.bincount(at, np.concatenate([held[lang][1], n])).astype(np.int64)
                    held[lang] = gram, n
                    if sum(len(g) for g, _ in held.values()) > FLUSH:
                        yield from flushed()
        yield from flushed()

    return rows.mapInArrow(counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Filter:
    """Learned languages in bit order, the slots (one row for each 62 languages), and each language's false-positive rate."""

    langs: list[str]
    slots: np.ndarray
    bits: int
    false_rate: np.ndarray
    fallback: str

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Sets of languages: a row for each 62 of them, a column for each n-gram."""
        at = slots(hashes, self.bits)
        found = self.slots[:, at[0]]
        for j in range(1, HASHES):
            found &= self.slots[:, at[j]]
        return found


def slot_bits(n_grams: int) -> int:
    """For a fill of FILL at most."""
    return max(LEAST_BITS, ceil(log2(max(1, n_grams) * HASHES / -log(1 - FILL))))


def learn(rows: DataFrame, share: float = SHARE, least: float = LEAST) -> Filter:
    """A filter from all rows of lang, text with a language. ``least``: how many of a MILLION n-grams of its language an n-gram must be."""
    counts = cut_lineage(count_grams(rows.select("lang", "text").where("lang is not null")), "grams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # one row for each language
    langs = sorted(totals)
    if not langs:
        return Filter([], np.zeros((1, 1), np.int64), 0, np.zeros(0), UNKNOWN)
    number = F.create_map(*(x for i, lang in enumerate(langs) for x in (F.lit(lang), F.lit(i))))
    size = F.create_map(*(x for lang in langs for x in (F.lit(lang), F.lit(float(totals[lang])))))
    enough = F.col("n") * MILLION >= least * size[F.col("lang")]
    bits = slot_bits(max((r["count"] for r in counts.where(enough).groupBy("lang").count().collect()), default=0))
    rate = F.struct((F.col("n") / size[F.col("lang")]).alias("rate"), number[F.col("lang")].alias("i"), enough.alias("enough"))
    best = counts.groupBy("gram").agg(F.collect_list(rate).alias("r"))  # at most one entry for each language
    chosen = best.withColumn("top", F.array_max(F.transform("r", lambda x: x["rate"]))).select(
        "gram", F.explode(F.filter("r", lambda x: (x["rate"] >= share * F.col("top")) & x["enough"])).alias("x")
    )
    sets = chosen.groupBy("gram", F.expr(f"x.i div {WORD_BITS}").cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, x.i % {WORD_BITS})")).alias("set"))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = slots(batch.column("gram").to_numpy().view(np.uint64), bits)
            word, given = batch.column("word").to_numpy(), batch.column("set").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(at.ravel()), pa.array(np.tile(word, HASHES)), pa.array(np.tile(given, HASHES))], names=["slot", "word", "set"])

    filled = sets.mapInArrow(placed, "slot bigint, word int, set bigint").groupBy("slot", "word").agg(F.bit_or("set").alias("set"))
    got = filled.toArrow()  # at most 2^bits rows for each 62 languages
    table = np.zeros((-(-len(langs) // WORD_BITS), 1 << bits), np.int64)
    table[got.column("word").to_numpy(), got.column("slot").to_numpy()] = got.column("set").to_numpy()
    fill = np.array([(table[i // WORD_BITS] >> (i % WORD_BITS) & 1).mean() for i in range(len(langs))])
    return Filter(langs, table, bits, fill**HASHES, max(langs, key=lambda x: totals[x]))


def weighed(texts: list[str | None], model: Filter) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and score of each text, and the share of its n-grams known in that language, corrected for false positives."""
    plain = [letters(t) for t in texts]
    seen = np.zeros(len(plain))
    hits = np.zeros((len(model.langs), len(plain)))
    if model.langs:
        for owner, hashes in grams(plain):
            seen += np.bincount(owner, minlength=len(plain))
            sets = model.hits(hashes)
            for i in range(len(model.langs)):
                hits[i] += np.bincount(owner, sets[i // WORD_BITS] >> (i % WORD_BITS) & 1, len(plain))
    true = np.maximum(0, (hits - seen * model.false_rate[:, None]) / (1 - model.false_rate[:, None]).clip(1e-9))
    total = true.sum(0)
    best = true.argmax(0) if model.langs else np.zeros(len(plain), int)
    score = np.where(total > 0, (true.max(0) if model.langs else 0) / np.where(total > 0, total, 1), 0.0)
    names = [UNKNOWN if not p else model.langs[b] if s > 0 else model.fallback for p, b, s in zip(plain, best, score, strict=True)]
    return names, score, (true.max(0) if model.langs else 0) / np.maximum(1, seen)


def judge(texts: list[str | None], model: Filter) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    names, score, _ = weighed(texts, model)
    return names, score


def accepted(texts: list[str | None], model: Filter, known: float = KNOWN) -> list[bool]:
    """Whether each text is in its language by ``known`` of its n-grams; with nothing learned, whether it has a letter."""
    if not model.langs:
        return [bool(letters(t)) for t in texts]
    names, _, share = weighed(texts, model)
    return [n != UNKNOWN and s >= known for n, s in zip(names, share.tolist(), strict=True)]


def identify(docs: DataFrame, model: Filter, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns ``keep`` (None: all) with lang_pred and score."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    rows = docs.select(*dict.fromkeys([*names, text]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = judge(batch.column(text).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    schema = T.StructType([f for c in names for f in rows.schema if f.name == c] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(judged, schema)


def with_language(docs: DataFrame, model: Filter, text: str = "text") -> DataFrame:
    """The documents that are ``accepted``, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(accepted(batch.column(text).to_pylist(), shared.value), pa.bool_()))

    return docs.mapInArrow(judged, docs.schema)
