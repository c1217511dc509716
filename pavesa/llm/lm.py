"""Language-model scoring: a gated recurrent network with class-factored softmax gives the log-probability of whole texts.

Statistics cover every training word: counts of all words give the vocabulary of the network (the MODEL_WORDS most frequent), its classes,
its first weights (so that training starts from the unigram model) and the add-one distribution of all rarer words, which the network
reaches through one class. So every text has a probability, and those of all words and the unknown word add up to one.

The network is trained in ROUNDS rounds, and each training document is met in one of them, by hash. In each, learners of about LEARNER_WORDS
words take their part of the round's documents, one split after another, train a copy from the common weights by truncated backpropagation,
and the copies are averaged by words seen, block by block, in a shuffle. So the number of copies follows from the words alone, not from splits or
cores, and a copy is small beside what it has read. Only the average reaches the driver; its size is fixed by the parameters.

Scoring carries the state of a document from window to window to its end; texts of more than LONG words wait for each other, so that one long
text does not make thousands of steps for itself. Arrow splits texts and looks up words, some SLICE bytes at once. Words of the TABLE_WORDS most frequent are looked up in the task
(the table is bounded in words and bytes); counts of all others meet the documents that hold them in a join, counted per document first.

Defined cases: a null or empty text is its end alone; no training rows give the uniform model of one unknown word, so every score is 0; repeated rows
are scored alike, each for itself; other columns are not read. A null id counts as empty text where rows are held out by id.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pavesa.llm import gru
from pavesa.llm.common import cut_lineage, numbered

END = b""
MODEL_WORDS = 4096
TABLE_WORDS = 200_000
TABLE_BYTES = 64
ROUNDS = 4
CHUNK = 500_000
LONG = 2_000
SLICE = 4_000_000
FLUSH = 1_000_000
BLOCK = 4096
LEARNER_WORDS = 2_000_000
NEAR = 32


def words_of(text: str | None) -> list[bytes]:
    return [*text.encode().lower().split(), END] if text else [END]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, some SLICE bytes of text at once."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
        edges = np.flatnonzero(np.diff(size // SLICE, prepend=-1)).tolist()
        for start, end in zip(edges, [*edges, batch.num_rows][1:], strict=True):
            yield batch.slice(start, end - start)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``words_of`` of some texts in one line, and the bounds of the texts in it."""
    own = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    own = pc.if_else(pc.equal(own, ""), "", pc.binary_join_element_wise(own, "", " "))
    words = pc.ascii_split_whitespace(own)  # a blank behind the last word leaves an empty one, the end
    return words.flatten().cast(pa.binary()), words.offsets.to_numpy()


def count_words(rows: DataFrame) -> DataFrame:
    """word, n over all texts, the end among the words. A task adds up its words and hands them on when they are many."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flushed() -> Iterator[pa.RecordBatch]:
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
                held.clear()

        for batch in batches:
            for text in batch.column("text"):
                held.update(words_of(text.as_py()))
                if len(held) > FLUSH:
                    yield from flushed()
        yield from flushed()

    return rows.select("text").mapInArrow(counted, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Counts of frequent words in falling order, sums over all words, and the network's shape and weights."""

    table: dict[bytes, int]  # word -> rank
    counts: np.ndarray
    total: int
    distinct: int
    shape: gru.Shape
    weights: np.ndarray

    @property
    def rare_mass(self) -> float:
        """Add-one mass of all words outside the network, the unknown word among them."""
        own = self.counts[: self.shape.words]
        return float(self.total - own.sum() + self.distinct - len(own) + 1)

    @cached_property
    def line(self) -> pa.Array:
        return pa.array([*self.table], pa.binary())

    def ranks(self, words: pa.Array, most: int) -> np.ndarray:
        """The rank of each word among the ``most`` most frequent, ``most`` for all others."""
        return pc.fill_null(pc.index_in(words, value_set=self.line[:most]), most).to_numpy()

    def ids(self, text: str | None) -> np.ndarray:
        return self.ranks(_split(pa.array([text], pa.string()))[0], self.shape.words)


def vocabulary(counts: DataFrame, model_words: int = MODEL_WORDS, table_words: int = TABLE_WORDS, hidden: int = gru.HIDDEN, classes: int = gru.CLASSES) -> Model:
    """The untrained model of a table of word counts."""
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    frequent = counts.where(F.octet_length("word") <= TABLE_BYTES).orderBy(F.col("n").desc(), "word").limit(table_words).toArrow()
    number = frequent.column("n").to_numpy().astype(np.int64)
    own = number[:model_words].astype(float)
    shape = gru.shape_of(own, hidden, classes)
    table = {w: i for i, w in enumerate(frequent.column("word").to_pylist())}
    return Model(table, number, sums["total"], sums["distinct"], shape, gru.start(shape, own, sums["total"] - own.sum()))


def _chunks(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[list[np.ndarray]]:
    held, size = [], 0
    for batch in _slices(batches):
        words, bounds = _split(batch.column("text"))
        for ids in np.split(model.ranks(words, model.shape.words), bounds[1:-1]):
            held.append(ids)
            size += len(held[-1])
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _mean(parts: pd.DataFrame) -> pd.DataFrame:
    """The mean of weighted blocks, and their weight."""
    words = parts["words"].to_numpy()
    mean = sum(w * np.frombuffer(v, np.float32).astype(np.float64) for w, v in zip(words, parts["mean"], strict=True)) / words.sum()
    return pd.DataFrame({"block": [parts["block"].iloc[0]], "near": [parts["near"].iloc[0]], "words": [words.sum()], "mean": [mean.astype(np.float32).tobytes()]})


def fit(rows: DataFrame, key: Column, model: Model, rounds: int = ROUNDS, rate: float = gru.RATE, learner_words: int = LEARNER_WORDS) -> Model:
    """The model after ``rounds`` averaged passes, each over rows of its own; together they are all rows."""
    if not model.shape.words:
        return model
    number = F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit(""))), F.lit(rounds))
    learners = max(1, round(model.total / rounds / learner_words))
    kinds = "block int, near int, words double, mean binary"
    for r in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def learned(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            own = shared.value
            weights, squares, seen = own.weights.copy(), np.zeros_like(own.weights), 0
            for texts in _chunks(batches, own):
                seen += gru.train(own.shape, weights, texts, squares, rate)
            if seen:
                blocks = [weights[i : i + BLOCK].tobytes() for i in range(0, len(weights), BLOCK)]
                near = TaskContext.get().partitionId() // NEAR
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(blocks)), pa.int32()), pa.array([near] * len(blocks), pa.int32()), pa.array([float(seen)] * len(blocks)), pa.array(blocks, pa.binary())],
                    names=["block", "near", "words", "mean"],
                )

        copies = rows.where(number == r).select("text").coalesce(learners).mapInArrow(learned, kinds)
        if learners > NEAR:
            copies = copies.groupBy("block", "near").applyInPandas(_mean, kinds)
        whole = copies.groupBy("block").applyInPandas(_mean, kinds).toPandas().sort_values("block")
        if len(whole):
            weights = np.concatenate([np.frombuffer(t, np.float32) for t in whole["mean"]])
            model = Model(model.table, model.counts, model.total, model.distinct, model.shape, weights)
        shared.unpersist()
    return model


def scored(docs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """n_tokens, n_known, base_score and score of each row of ``docs`` (row, text, and ``keep`` columns), by row number."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = "row bigint, n_tokens bigint, n_known bigint, base double, score double, rare array<struct<word: binary, n: int>>"
    base_of, rare_of = float(np.log10(model.total + model.distinct + 1)), float(np.log10(model.rare_mass))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        logs = np.append(np.log10(own.counts + 1.0), 0)
        k, known = own.shape.words, len(own.counts)  # words beyond the table have rank ``known``

        def flush(rows: tuple[int], ids: tuple[np.ndarray], partial: tuple[tuple], others: tuple[Counter]) -> pa.RecordBatch:
            values = gru.score(own.shape, own.weights, ids) if k else np.zeros(len(ids))
            n, seen, base, rare = (np.array(x) for x in zip(*partial, strict=True))
            words, times = pa.array([*chain.from_iterable(others)], pa.binary()), pa.array([*chain.from_iterable(o.values() for o in others)], pa.int32())
            ends = pa.array(np.cumsum([0, *map(len, others)]), pa.int32())
            rest = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([words, times], names=["word", "n"]))
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(n, pa.int64()), pa.array(seen, pa.int64()), pa.array(base), pa.array(values + rare), rest], names=["row", "n_tokens", "n_known", "base", "score", "rare"])

        held: dict[bool, list[tuple]] = {False: [], True: []}  # long texts wait for each other, so that few steps have few lanes
        size = {False: 0, True: 0}
        for batch in _slices(batches):
            words, bounds = _split(batch.column("text"))
            rank = own.ranks(words, known)
            seen, first, values = rank < known, bounds[:-1], logs[rank]
            found = np.add.reduceat(seen, first, dtype=np.int64)
            base = np.add.reduceat(values, first) - found * base_of
            rare = np.add.reduceat(np.where(seen & (rank >= k), values - rare_of, 0), first)
            unknown = np.flatnonzero(~seen)
            rest, edges = words.take(pa.array(unknown)).to_pylist(), np.searchsorted(unknown, bounds).tolist()
            texts = np.split(np.minimum(rank, k), bounds[1:-1])
            for i, (row, ids, partial) in enumerate(zip(batch.column("row").to_pylist(), texts, zip(found, base, rare, strict=True), strict=True)):
                long = len(ids) > LONG
                held[long].append((row, ids, (len(ids), *partial), Counter(rest[edges[i] : edges[i + 1]])))
                size[long] += len(ids)
                if size[long] >= CHUNK:
                    yield flush(*zip(*held[long], strict=True))
                    held[long], size[long] = [], 0
        for rest in held.values():
            if rest:
                yield flush(*zip(*rest, strict=True))

    first = cut_lineage(docs.select("row", "text").mapInArrow(judged, kinds), "scores")
    rare = first.select("row", F.inline("rare")).join(counts.withColumnRenamed("n", "c"), "word", "left")
    seen = F.coalesce(F.col("c"), F.lit(0))
    sums = rare.groupBy("row").agg(F.sum("n").alias("k"), F.sum(F.when(seen > 0, F.col("n")).otherwise(0)).alias("more"), F.sum(F.col("n") * F.log10(seen + 1)).alias("logs"))
    k, logs = F.coalesce("k", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    return first.drop("rare").join(sums, "row", "left").select(
        "row", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        (F.col("base") + logs - k * base_of).alias("base_score"), (F.col("score") + logs - k * rare_of).alias("score"),
    )


def score_documents(docs: DataFrame, held_out: Column, **options) -> DataFrame:
    """Scores of every row of doc_id, text by a model of the rows that aren't held out. ``docs`` must be a scan, so that row numbers stay."""
    rows = numbered(docs.select("doc_id", "text")).withColumn("held_out", held_out)
    training = rows.where(~F.col("held_out"))
    counts = cut_lineage(count_words(training), "words")
    model = fit(training, F.col("doc_id"), vocabulary(counts), **options)
    return rows.select("row", "doc_id", "held_out").join(scored(rows, counts, model), "row").withColumn("train_tokens", F.lit(model.total).cast("long")).drop("row")
