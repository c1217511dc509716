"""Benchmark decontamination by suffix arrays over the training texts.

Each task turns its documents into shards of at most SHARD_WORDS words (a longer document is a shard of its own), builds the suffix array
of each shard, and binary-searches every suffix of every test item in it. That gives, per document, the words inside test windows, the items
they come from, and the longest verbatim match with its place.

A shard's array holds the suffixes that can matter: those that begin with as many test-vocabulary words as the shortest window. They are
sorted as deep as the longest item, since no search looks further. Documents are never shuffled. Test items are the stated query set: they
go to the tasks in blocks of at most BLOCK_BYTES of text, one pass over the documents for each block.

Defined cases: a null or empty text has no words and no hits; an item without words never matches; an item of fewer than ``window`` words is
one window; matches shorter than the shortest window aren't looked for; repeated items with one id count once; a null item id is the empty text; repeated documents are judged alike, each for itself. An
empty benchmark leaves every document clean. An input column that has the name of a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 10
SHARD_WORDS = 4_000_000
BLOCK_BYTES = 1_000_000

#: Lower case for A-Z, itself for a-z, 0-9 and every byte of a character beyond ASCII, else a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", T.IntegerType()), T.StructField("longest_at", T.IntegerType()), T.StructField("longest_item", T.StringType()),
])
_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def split_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_BYTES).split() if text else []


@dataclass
class TestBlock:
    """Test items as numbers: one array of word ids with a 0 after each item, and the distinct windows with their items."""

    vocabulary: dict[bytes, int]
    words: np.ndarray
    suffixes: np.ndarray  # starts, one for each word
    lengths: np.ndarray  # words from there to the end of the item
    owners: np.ndarray  # item number of each suffix
    window: np.ndarray  # number of the window that starts here, or -1
    window_length: np.ndarray
    window_items: list[np.ndarray]
    names: list[str]

    @classmethod
    def of(cls, items: list[tuple[str, str | None]], window: int) -> TestBlock:
        vocabulary: dict[bytes, int] = {}
        names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(names)}
        words, suffixes, lengths, owners, starts = ([np.zeros(0, np.int64)] for _ in range(5))
        known: dict[bytes, int] = {}
        window_length: list[int] = []
        members: list[set[int]] = []
        first = 0
        for name, text in items:
            ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in split_words(text)], np.int32)
            n, size = len(ids), min(window, len(ids))
            at = np.full(n, -1, np.int64)
            for i in range(n - size + 1 if n else 0):
                at[i] = w = known.setdefault(ids[i : i + size].tobytes(), len(known))
                if w == len(members):
                    members.append(set())
                    window_length.append(size)
                members[w].add(number[name])
            suffixes.append(first + np.arange(n))
            lengths.append(n - np.arange(n))
            owners.append(np.full(n, number[name], np.int64))
            starts.append(at)
            words.append(np.append(ids, 0).astype(np.int64))
            first += n + 1
        joined = [np.concatenate(x) for x in (words, suffixes, lengths, owners, starts)]
        return cls(vocabulary, *joined, np.asarray(window_length, np.int64), [np.array(sorted(m)) for m in members], names)


def suffix_array(words: np.ndarray, starts: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """``starts`` sorted by the words that follow, up to ``depth`` words. 0 ends a text. As many words as fit make one key; only ties go on."""
    per = max(1, 62 // bits)
    padded = np.concatenate([words, np.zeros(depth + per, words.dtype)])

    def key(at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for i in range(per):
            out = (out << bits) | padded[at + i]
        return out

    order = starts.copy()
    todo = np.arange(len(order))
    group = np.zeros(len(order), np.int64)
    for done in range(0, depth, per):
        keys = key(order[todo] + done)
        by = np.lexsort((keys, group[todo]))
        order[todo], keys, groups = order[todo][by], keys[by], group[todo]
        new = np.ones(len(todo), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (groups[1:] != groups[:-1])
        group[todo] = todo[np.maximum.accumulate(np.where(new, np.arange(len(todo)), 0))]
        tied = ~new
        tied[:-1] |= ~new[1:]
        todo = todo[tied]
        if not len(todo):
            break
    return order


def search(words: np.ndarray, order: np.ndarray, block: TestBlock, window: int) -> tuple[np.ndarray, ...]:
    """For each test suffix: longest match in words, its range in the suffix array, and the range at the depth of its window."""
    n, last = len(block.suffixes), len(words) - 1
    low, high = np.zeros(n, np.int64), np.full(n, len(order), np.int64)
    longest, best = np.zeros(n, np.int64), np.zeros((n, 2), np.int64)
    ranges = np.zeros((n, 2), np.int64)
    active = np.arange(n)

    def bound(active: np.ndarray, depth: int, target: np.ndarray, right: bool) -> np.ndarray:
        a, b = low[active].copy(), high[active].copy()
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            seen = words[np.minimum(order[np.minimum(mid, len(order) - 1)] + depth, last)]
            below = (seen <= target if right else seen < target) & open_
            a, b = np.where(below, mid + 1, a), np.where(open_ & ~below, mid, b)
        return a

    depth = 0
    size = np.where(block.window >= 0, block.window_length[block.window], -1) if len(block.window_length) else np.full(n, -1)
    while len(active) and len(order):
        target = block.words[block.suffixes[active] + depth]
        left, right = bound(active, depth, target, False), bound(active, depth, target, True)
        low[active], high[active] = left, right
        depth += 1
        active = active[left < right]
        longest[active], best[active] = depth, np.stack([low[active], high[active]], 1)
        full = active[size[active] == depth]
        ranges[full] = best[full]
        active = active[block.lengths[active] > depth]
    return longest, best, ranges


def _spread(ranges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each range as its numbers: (index of the range, number)."""
    count = ranges[:, 1] - ranges[:, 0]
    which = np.repeat(np.arange(len(ranges)), count)
    return which, np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(ranges[:, 0], count)


def _deepest(ranges: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank, index of the range) for each rank inside a range: the deepest range there. Ranges of a suffix array hold one another or are apart,
    and the inner one is deeper, so one walk over their ends is enough and no range is written out beside another."""
    _, keep = np.unique(ranges, axis=0, return_index=True)  # equal ranges are one match; the first suffix stands for it
    keep = keep[np.lexsort((depth[keep], -ranges[keep, 1], ranges[keep, 0]))]
    parts: list[tuple[int, int, int]] = []
    open_: list[int] = []
    at = 0

    def reach(to: int) -> None:
        nonlocal at
        while open_ and ranges[open_[-1], 1] <= to:
            end = int(ranges[open_[-1], 1])
            if end > at:
                parts.append((at, end, open_[-1]))
                at = end
            open_.pop()
        if open_ and to > at:
            parts.append((at, to, open_[-1]))
        at = max(at, to)

    for i in keep.tolist():
        reach(int(ranges[i, 0]))
        open_.append(i)
    reach(int(ranges[:, 1].max(initial=0)))
    low, high, which = (np.array(x, np.int64) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
    piece, rank = _spread(np.stack([low, high], 1))
    return rank, which[piece]


def _find(texts: list[list[int]], block: TestBlock, window: int) -> list[dict]:
    """Matches of one shard, a dict for each text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(sizes + 1) - sizes - 1
    words = np.zeros(int((sizes + 1).sum()), np.int64)
    for at, ids in zip(first, texts, strict=True):
        words[at : at + len(ids)] = ids
    out = [{"n_words": int(n), "hits": [], "items": set(), "longest": 0, "longest_at": None, "longest_item": None} for n in sizes]
    if not len(block.window_length) or not len(words):
        return out
    zeros = np.flatnonzero(words == 0)
    run = zeros[np.searchsorted(zeros, np.arange(len(words)))] - np.arange(len(words))
    starts = np.flatnonzero(run >= block.window_length.min())
    order = suffix_array(words, starts, int(block.lengths.max()), max(1, len(block.vocabulary).bit_length()))
    longest, best, ranges = search(words, order, block, window)

    known = np.flatnonzero(ranges[:, 1] > ranges[:, 0])
    known = known[np.unique(block.window[known], return_index=True)[1]]  # equal windows have one range
    which, rank = _spread(ranges[known])
    number, at = block.window[known][which], order[rank]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + block.window_length[number], -1)
    inside = np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8)])
    begins, ends = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
    doc_of = lambda x: np.searchsorted(first, x, side="right") - 1
    for d, a, b in zip(doc_of(begins), begins, ends, strict=True):
        out[d]["hits"].append({"start": int(a - first[d]), "end": int(b - first[d])})
    for pair in np.unique(doc_of(at) * len(block.window_items) + number):
        out[pair // len(block.window_items)]["items"].update(block.names[i] for i in block.window_items[pair % len(block.window_items)])

    long = np.flatnonzero(longest >= block.window_length.min())
    rank, which = _deepest(best[long], longest[long])
    at, length = order[rank], longest[long][which]
    doc = doc_of(at)
    by = np.lexsort((at, -length, doc))
    heads = by[np.flatnonzero(np.diff(doc[by], prepend=-1))]
    for d, a, n, s in zip(doc[heads], at[heads], length[heads], long[which[heads]], strict=True):
        out[d] |= {"longest": int(n), "longest_at": int(a - first[d]), "longest_item": block.names[block.owners[s]]}
    return out


def _merged(old: dict, new: dict) -> dict:
    """Matches of two blocks of items in one text."""
    spans: list[dict] = []
    for s in sorted([*old["hits"], *new["hits"]], key=lambda s: s["start"]):
        if spans and s["start"] <= spans[-1]["end"]:
            spans[-1] = {"start": spans[-1]["start"], "end": max(spans[-1]["end"], s["end"])}
        else:
            spans.append(s)
    longer = old if old["longest"] >= new["longest"] else new
    return {**longer, "n_words": new["n_words"], "hits": spans, "items": {*old["items"], *new["items"]}}


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    block, size = [], 0
    for row in benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).toLocalIterator():
        n = len((row["t"] or "").encode())
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((row["i"], row["t"]))
        size += n
    yield block


def _matched(texts: pa.Array, block: TestBlock, window: int, shard_words: int) -> list[dict]:
    """Matches of some texts, a shard at a time."""
    get = block.vocabulary.get
    results: list[dict] = []
    shard: list[list[int]] = []
    size = 0
    for text in texts:
        ids = list(map(get, split_words(text.as_py()), repeat(0)))
        if shard and size + len(ids) > shard_words:
            results += _find(shard, block, window)
            shard, size = [], 0
        shard.append(ids)
        size += len(ids)
    return results + _find(shard, block, window)


def matches(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id", keep: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """The columns ``keep`` (None: all) of each document with the columns of RESULT: words, merged hit spans, items found, longest match."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in RESULT.names]
    out = docs.select(*dict.fromkeys([*names, text]))
    for items in _blocks(benchmark, item, "text", block_bytes):
        block = docs.sparkSession.sparkContext.broadcast(TestBlock.of(items, window))
        carried = [f for f in out.schema if f.name not in RESULT.names]
        earlier = len(carried) < len(out.schema)

        def find(batches: Iterator[pa.RecordBatch], block=block, earlier=earlier, carried=tuple(f.name for f in carried)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                results = _matched(batch.column(text), block.value, window, shard_words)
                if earlier:
                    before = [dict(zip(RESULT.names, r, strict=True)) for r in zip(*(batch.column(c).to_pylist() for c in RESULT.names), strict=True)]
                    results = [_merged(a, b) for a, b in zip(before, results, strict=True)]
                columns = {
                    "n_words": pa.array([r["n_words"] for r in results], pa.int64()), "hits": pa.array([r["hits"] for r in results], _HITS),
                    "items": pa.array([sorted(r["items"]) for r in results], pa.list_(pa.string())), "longest": pa.array([r["longest"] for r in results], pa.int32()),
                    "longest_at": pa.array([r["longest_at"] for r in results], pa.int32()), "longest_item": pa.array([r["longest_item"] for r in results], pa.string()),
                }
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *columns.values()], names=[*carried, *columns])

        out = out.mapInArrow(find, T.StructType([*carried, *RESULT]))
    return out.select(*names, *RESULT.names)


def hit_words() -> Column:
    """Words inside test windows."""
    return F.aggregate("hits", F.lit(0), lambda n, s: n + s["end"] - s["start"]).cast("long")


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item: str = "item_id", block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """The documents without any test window, with their own columns."""
    for items in _blocks(benchmark, item, "text", block_bytes):
        block = docs.sparkSession.sparkContext.broadcast(TestBlock.of(items, window))

        def clean(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not r["hits"] for r in _matched(batch.column(text), block.value, window, shard_words)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
