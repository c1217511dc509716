"""Cross-tokenizer alignment: which tokens of two tokenizers end together, and how often each pair of ids does so in the whole corpus.

Within a task everything is Arrow: token lists are flattened with their parents, byte ends are cumulative sums of token lengths for each parent, an
Acero hash join on (parent, end) finds the common ends, and ``Table.group_by`` counts the linked pairs of ids. Spark merges the partial counts by
pair. A task hands on its documents in blocks of some 32 million characters; links are places in the block's own list of pairs, so only
that list meets the corpus-wide counts, and they come back to the block in a cogroup.

Texts are cut before a space that follows anything but white space, where both tokenizers cut. Ids of the common stretches between come from
a bounded memory, the libraries encode the rest. Such a cut is a common end, so a text of any length is aligned in segments.

The second tokenizer turns U+2581 into a space, which shortens the text; a text in which it isn't spelled byte by byte has no tokens.

Defined cases: a null or empty text, or one that isn't spelled exactly, has zeros and the empty hash; repeated rows are aligned and counted each; an empty
table gives no rows; only the columns ``keep`` pass through, and one that has the name of a result is left out.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pavesa.llm.common import cut_lineage

#: Stretches whose ids are remembered, and their length at most.
MEMORY = 300_000
MEMORY_CHARS = 48
#: Characters of a segment, of the segments that are aligned at once, and of a block.
SEGMENT, TOGETHER, BLOCK = 1_000_000, 2_000_000, 32_000_000
#: White space in Unicode, plain values.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_WHITE = set(WHITE)
_ODD = re.compile(f"[{WHITE}] ")
_CUT = re.compile(f"(?<=[^{WHITE}])(?= )")
RESULTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def tokenizer_paths() -> tuple[str, str]:
    """Files of the installed tokenizer package: byte-level BPE and SentencePiece BPE."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """Byte-level spelling: printable bytes are their own letter, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers with the bytes of each id; ``ids`` gives those of stretches that stand after a space each."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        letters, size = byte_letters(), self.a.get_vocab_size()
        self.bytes_a = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in map(self.a.id_to_token, range(size))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.spaced = np.array([x.startswith(b" ") for x in self.bytes_a])
        self.size_a, self.size_b = (pa.array([len(x) for x in y], pa.int64()) for y in (self.bytes_a, self.bytes_b))
        self.name = pa.array([str(i) for i in range(max(size, len(pieces)))])
        self.space = [self.b.piece_to_id("▁")]
        self.memory: dict[str, tuple[bytes, bytes] | None] = {}

    def learn(self, new: list[str]) -> dict[str, tuple[bytes, bytes] | None]:
        found = {}
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            for x, a, b in zip(part, self._ids_a(part), self.b.encode(part, num_threads=1), strict=True):
                b = b if x else self.space
                text = f" {x}".encode()
                exact = b"".join([self.bytes_a[i] for i in a]) == text == b"".join([self.bytes_b[i] for i in b])
                found[x] = (np.array(a, "<i4").tobytes(), np.array(b, "<i4").tobytes()) if exact else None
        for x, ids in found.items():
            if len(self.memory) >= MEMORY:
                break
            if len(x) <= MEMORY_CHARS:
                self.memory[x] = ids
        return found

    def _ids_a(self, stretches: list[str]) -> list[list[int]]:
        """Stretches without a space inside go to the library many at a time: each begins at an id that begins with a space."""
        whole = {i for i, x in enumerate(stretches) if " " in x}
        simple = [x for i, x in enumerate(stretches) if i not in whole]
        out: list[list[int]] = []
        groups = [simple[i : i + 200] for i in range(0, len(simple), 200)]
        for coded in self.a.encode_batch_fast(["".join(f" {x}" for x in g) for g in groups], add_special_tokens=False):
            ids = np.array(coded.ids)
            out += [x.tolist() for x in np.split(ids, np.flatnonzero(self.spaced[ids])[1:])]
        if len(out) != len(simple):
            raise ValueError("the tokenizer doesn't begin an id at each space")
        rest = iter(out)
        return [self.a.encode(f" {x}", add_special_tokens=False).ids if i in whole else next(rest) for i, x in enumerate(stretches)]

    def ids(self, stretches: list[str]) -> tuple[bytes, bytes] | None:
        """Ids of both as int32 bytes, None if one of the stretches isn't spelled exactly."""
        try:
            entries = [self.memory[x] for x in stretches]
        except KeyError:
            found = self.learn(list({x for x in stretches if x not in self.memory}))
            entries = [found[x] if x in found else self.memory[x] for x in stretches]
        if None in entries:
            return None
        return b"".join([e[0] for e in entries]), b"".join([e[1] for e in entries])


@functools.lru_cache(maxsize=1)
def loaded(path_a: str, path_b: str) -> Pair:
    """One for each Python worker, so that later tasks know the stretches of earlier ones."""
    return Pair(path_a, path_b)


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """Parts of a text that stand after a space each (the first after the one that is put before the text)."""
    at = 0
    while len(text) - at > size:
        cut = text.rfind(" ", at + 1, at + size)
        while cut > at and text[cut - 1] in _WHITE:
            cut = text.rfind(" ", at + 1, cut)
        if cut <= at:
            cut = text.find(" ", at + size)
            while cut >= 0 and text[cut - 1] in _WHITE:
                cut = text.find(" ", cut + 1)
            if cut < 0:
                break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def stretches_of(part: str) -> list[str]:
    spaced = f" {part}"
    return [x[1:] for x in _CUT.split(spaced)] if _ODD.search(spaced) else part.split(" ")


def _ends(ids: list[bytes], sizes: pa.Array, name: str) -> pa.Table:
    """Tokens of lists as rows: parent, byte end within it, id and place."""
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x) // 4 for x in ids)]), pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
    flat, parent = lists.flatten(), pc.list_parent_indices(lists)
    total = pc.cumulative_sum(sizes.take(flat))
    firsts = lists.offsets.to_numpy()[:-1]  # every list here has tokens
    before = pa.array(np.concatenate([[0], total.to_numpy()[firsts[1:] - 1]]))
    return pa.table({"parent": parent, "end": pc.subtract(total, before.take(parent)), name: flat, f"at_{name}": pa.array(np.arange(len(flat)))})


def align(pair: Pair, ids: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Of each segment: tokens of A, tokens of B, groups and their spelling; then the linked pairs of all, in order."""
    a, b = _ends([x[0] for x in ids], pair.size_a, "a"), _ends([x[1] for x in ids], pair.size_b, "b")
    met = a.select(["parent", "end", "at_a"]).join(b.select(["parent", "end", "at_b"]), ["parent", "end"], join_type="inner", use_threads=False)
    partner = np.full(a.num_rows, -1)
    partner[met["at_a"].to_numpy()] = met["at_b"].to_numpy()  # back in order without a sort: a token has one end
    last_a = np.flatnonzero(partner >= 0)
    last_b = partner[last_a]
    id_a, id_b = (t[n].combine_chunks() if isinstance(t[n], pa.ChunkedArray) else t[n] for t, n in ((a, "a"), (b, "b")))
    spelled = [pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], last + 1]), pa.int32()), pair.name.take(x)), ",") for last, x in ((last_a, id_a), (last_b, id_b))]
    groups = pc.binary_join_element_wise(*spelled, "|")
    n_a, n_b = (np.array([len(x[i]) // 4 for x in ids]) for i in (0, 1))
    n_groups = np.diff(np.searchsorted(last_a, np.concatenate([[0], np.cumsum(n_a)])))
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_groups)]), pa.int32()), groups), ";")
    links = (id_a.to_numpy()[last_a].astype(np.int64) << 32) | id_b.to_numpy()[last_b]
    return n_a, n_b, n_groups, texts.to_pylist(), links


class Block:
    """Documents that a task has aligned, until they are handed on."""

    def __init__(self, pair: Pair, name: str):
        self.pair, self.name, self.chars = pair, name, 0
        self.rows: list[pa.RecordBatch] = []
        self.numbers: list[np.ndarray] = []  # n_a, n_b, n_links of each document of a batch
        self.hashes: list[str] = []
        self.links: list[np.ndarray] = []

    def add(self, kept: pa.RecordBatch, texts: list[str | None]) -> None:
        self.rows.append(kept)
        numbers = np.zeros((len(texts), 3), np.int64)
        spelled: list = [None] * len(texts)
        waiting: list[tuple[int, tuple[bytes, bytes]]] = []
        chars = 0

        def flush() -> None:
            if waiting:
                n_a, n_b, n_groups, groups, links = align(self.pair, [w[1] for w in waiting])
                np.add.at(numbers, [w[0] for w in waiting], np.stack([n_a, n_b, n_groups], 1))
                for (i, _), g in zip(waiting, groups, strict=True):
                    if spelled[i] is None:
                        spelled[i] = hashlib.sha256(g.encode())
                    else:
                        spelled[i].update(b";" + g.encode())
                self.links.append(links)
                waiting.clear()

        for i, text in enumerate(texts):
            if not text or "▁" in text:
                continue
            # A long text is judged as a whole before its first segment counts.
            if len(text) > SEGMENT and any(self.pair.ids(stretches_of(part)) is None for part in segments(text)):
                continue
            for part in segments(text):
                ids = self.pair.ids(stretches_of(part))
                if ids is None:
                    break
                waiting.append((i, ids))
                chars += len(part)
                if chars >= TOGETHER:
                    flush()
                    chars = 0
            self.chars += len(text)
        flush()
        self.numbers.append(numbers)
        self.hashes += ["" if s is None else s.hexdigest() for s in spelled]

    def close(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        numbers = np.concatenate(self.numbers)
        coded = pa.array(np.concatenate([np.zeros(0, np.int64), *self.links])).dictionary_encode()
        places, pairs = coded.indices, coded.dictionary
        counted = pa.table({"place": places}).group_by("place", use_threads=False).aggregate([([], "count_all")])
        count = len(counted)
        extra = {"block": pa.array([self.name] * count), "place": counted["place"].combine_chunks(), "pair": pairs.take(counted["place"].combine_chunks()), "n": counted["count_all"].combine_chunks()}
        yield pa.RecordBatch.from_arrays([extra.get(f.name, pa.nulls(count, f.type)) for f in schema], schema=schema)
        ends = np.concatenate([[0], np.cumsum(numbers[:, 2])])
        at = 0
        for kept in self.rows:
            stop = at + kept.num_rows
            lists = pa.ListArray.from_arrays(pa.array(ends[at : stop + 1] - ends[at], pa.int32()), places.slice(ends[at], ends[stop] - ends[at]))
            own = {c: kept.column(c) for c in kept.schema.names} | {
                "block": pa.array([self.name] * kept.num_rows), "n_a": pa.array(numbers[at:stop, 0]), "n_b": pa.array(numbers[at:stop, 1]),
                "n_groups": pa.array(numbers[at:stop, 2]), "groups_sha256": pa.array(self.hashes[at:stop]), "links": lists,
            }
            yield pa.RecordBatch.from_arrays([own[f.name].cast(f.type) if f.name in own else pa.nulls(kept.num_rows, f.type) for f in schema], schema=schema)
            at = stop


def _aligned(docs: DataFrame, keep: list[str], text: str, paths: tuple[str, str]) -> DataFrame:
    """Rows of two kinds by block: documents (``pair`` null), and pairs with their place and count in the block."""
    rows = docs.select(*(F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)), F.col(text).alias("text"))
    names = rows.columns[:-1]
    kinds = {"block": T.StringType(), "n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "groups_sha256": T.StringType()}
    kinds |= {"links": T.ArrayType(T.IntegerType()), "place": T.IntegerType(), "pair": T.LongType(), "n": T.LongType()}
    schema = T.StructType([*(T.StructField(c, rows.schema[c].dataType) for c in names), *(T.StructField(n, k) for n, k in kinds.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, task, number, block, out = loaded(*paths), TaskContext.get().partitionId(), 0, None, None
        plain = {"block": pa.string(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "groups_sha256": pa.string(), "links": pa.list_(pa.int32()), "place": pa.int32(), "pair": pa.int64(), "n": pa.int64()}
        for batch in batches:
            if out is None:
                out = pa.schema([*(batch.schema.field(c) for c in names), *plain.items()])
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                if block is None:
                    block, number = Block(pair, f"{task}-{number}"), number + 1
                block.add(part.select(names), part.column("text").to_pylist())
                if block.chars >= BLOCK:
                    yield from block.close(out)
                    block = None
        if block is not None:
            yield from block.close(out)

    return cut_lineage(rows.mapInArrow(run, schema), "alignment")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair, count, best: links of each pair of ids in the corpus, and whether no other partner of its B id has more."""
    counts = blocks.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF))
    counts = cut_lineage(counts, "pairs")
    top = counts.groupBy("b").agg(F.max("count").alias("top"))
    return counts.join(top, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def aligned(docs: DataFrame, keep: list[str], text: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """The columns ``keep`` with RESULTS for each row."""
    keep = [c for c in keep if c not in RESULTS]
    blocks = _aligned(docs, keep, text, paths or tokenizer_paths())
    answers = blocks.where("pair is not null").select("block", "place", "pair").join(pair_counts(blocks), "pair").select("block", "place", "count", "best")
    rows = blocks.where("pair is null").drop("place", "pair", "n")
    names = rows.columns[: len(keep)]
    schema = T.StructType([*(rows.schema[c] for c in names), *(T.StructField(c, T.StringType() if c == "groups_sha256" else T.LongType()) for c in RESULTS)])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        places = right["place"].to_numpy()
        count, best = (np.zeros(len(places), np.int64) for _ in range(2))
        count[places], best[places] = right["count"].to_numpy(), right["best"].to_numpy()
        # A few batches of documents at a time: a link becomes two numbers of 8 bytes.
        sums = []
        for batch in left.to_batches(max_chunksize=1024):
            links = batch.column("links")
            flat, ends = links.values.to_numpy(zero_copy_only=False), links.offsets.to_numpy()
            sums += [[x[flat[s:e]].sum() for x in (best, count)] for s, e in zip(ends[:-1], ends[1:], strict=True)]
        sums = np.array(sums, np.int64).reshape(-1, 2)
        own = {"n_links": left["n_groups"], "n_best": pa.array(sums[:, 0]), "count_sum": pa.array(sums[:, 1])}
        return pa.table({c: own.get(c) if c in own else left[c] for c in [*names, *RESULTS]})

    answers = answers.withColumnRenamed("block", "of_block")
    found = rows.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(finish, schema)
    return found.select(*(F.col(n).alias(c) for n, c in zip(names, keep, strict=True)), *RESULTS)
