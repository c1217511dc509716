"""Near-duplicate groups by MinHash bands and odd sketches, confirmed on full shingle sets.

A document's set holds the hashes of its distinct SHINGLE-word shingles. SAMPLES MinHash values of it make BANDS band keys of ROWS values each,
and are folded into an odd sketch: a bitmap of SKETCH_WORDS longs in which each value flips one bit. The XOR of two sketches is the sketch
of what differs, so its population count gives the similarity; precise where it is high, which is all that matters here. The shingles
themselves are folded in the same way into FULL_WORDS longs; there the population count can't exceed the number of shingles that only one
of the two has, so it excludes links with certainty.

Equal sets are one class from the start, and only a representative goes on. Then, without ever writing down all pairs of a bucket:

1. star rounds: in each bucket one document is the centre, the one that meets most others; each document tests the centre that its sketch
   likes best;
2. last round: in buckets that still hold several groups, what is outside the largest group meets the rest of the bucket, inside the
   join, and only pairs of different groups whose sketches and sizes allow a link come out.

Each pair that comes out is confirmed on both full sets with whole numbers. Pairs not tested are those already in one group, those whose
sizes or full sketches exclude a link, and those whose MinHash sketches are some four standard deviations below the threshold. A link at the threshold shares no
band with a probability of (1 - 0.75^4)^40 = 3e-7.

Defined cases: a null text, or one without words, has an empty set and is a group of its own; fewer words than a shingle are one shingle; repeated
ids stay apart as rows, and the keeper of a group is the row with the smallest (id, row); a null id sorts last. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pavesa.llm.common import cut_lineage, numbered

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 40, 4
SAMPLES = BANDS * ROWS
SKETCH_WORDS = 8
FULL_WORDS = 32
STAR_ROUNDS = 2
#: Similarity below which a sketch excludes a link: the threshold less about four standard deviations of the estimate.
DOUBT = 0.58
#: Largest population count of the XOR of two sketches at that similarity.
MOST_BITS = math.ceil(32 * SKETCH_WORDS * (1 - math.exp(-2 * (2 * SAMPLES * (1 - DOUBT)) / (64 * SKETCH_WORDS))))

_RNG = np.random.default_rng(20)
_XOR = _RNG.integers(0, 2**64, SAMPLES, np.uint64)[:, None]
_ODD = (_RNG.integers(0, 2**64, SAMPLES, np.uint64) | np.uint64(1))[:, None]
_MIX = [int(x) | 1 for x in _RNG.integers(0, 2**63, SHINGLE, np.uint64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a whole text."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        total = _mixed(total + hashes[i : len(words) - width + 1 + i] * np.uint64(_MIX[i]))
    return np.unique(total)


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """The SAMPLES minima of a non-empty set, a slice at a time."""
    out = np.full(SAMPLES, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 2048):
        out = np.minimum(out, ((hashes[at : at + 2048] ^ _XOR) * _ODD).min(1))
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in minima.reshape(BANDS, ROWS).T:
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64)


def _folded(values: np.ndarray, words: int) -> np.ndarray:
    """Parity of the values that fall on each bit."""
    parity = np.bincount((_mixed(values) % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def odd_sketch(minima: np.ndarray) -> np.ndarray:
    return _folded(minima + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), SKETCH_WORDS)


_SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]
_FULL = [f"f{i}" for i in range(FULL_WORDS)]
_TRAITS = ["n_shingles", *_SKETCH, *_FULL]


def signatures(docs: DataFrame) -> DataFrame:
    """Per row of row, doc_id, text: set size, a 128-bit digest of the set, band keys (null: empty set) and sketches."""
    names = ["row", "doc_id", "n_shingles", "d0", "d1", "bands", *_SKETCH, *_FULL]

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, bands, sketches = [], np.zeros((batch.num_rows, 2), np.int64), [], np.zeros((batch.num_rows, SKETCH_WORDS + FULL_WORDS), np.int64)
            for i, text in enumerate(batch.column("text")):
                own = shingle_set(text.as_py())
                sizes.append(len(own))
                bands.append(None)
                if len(own):
                    digests[i] = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64)
                    minima = min_hashes(own)
                    bands[-1] = band_keys(minima)
                    sketches[i] = np.concatenate([odd_sketch(minima), _folded(own, FULL_WORDS)])
            columns = [pa.array(sizes, pa.int64()), *map(pa.array, digests.T), pa.array(bands, pa.list_(pa.int64())), *map(pa.array, sketches.T.copy())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *columns], names=names)

    kinds = f"row bigint, doc_id bigint, n_shingles bigint, d0 bigint, d1 bigint, bands array<bigint>, {', '.join(f'{s} bigint' for s in [*_SKETCH, *_FULL])}"
    return docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(signed, kinds)


def _bits(a: str, b: str, words: list[str] = _SKETCH) -> Column:
    """Population count of the XOR of two sketches."""
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in words))


def _possible(a: str, b: str) -> Column:
    """Whether sizes and sketches allow a link."""
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    sizes = (100 * n >= PERCENT * m) & (100 * m >= PERCENT * n)
    return sizes & (_bits(a, b) <= MOST_BITS) & ((100 + PERCENT) * _bits(a, b, _FULL) <= (100 - PERCENT) * (n + m))


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Pairs of one centre come one after the other, so its set is made once a batch."""
    first = pairs.join(texts.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b")
    both = first.join(texts.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = None, None
        for batch in batches:
            rows = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text_a"), batch.column("text_b"), strict=True)
            out = []
            for a, b, text_a, text_b in rows:
                if a != known:
                    known, own = a, shingle_set(text_a.as_py())
                other = shingle_set(text_b.as_py())
                common = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * common >= PERCENT * (len(own) + len(other) - common):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return both.mapInArrow(checked, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """row, group (smallest row) of all linked rows, by alternating large and small stars until nothing changes."""
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = large.where("u <> v").distinct()
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = cut_lineage(small.where("u <> v").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("row")).distinct().withColumn("group", F.col("row"))
    return edges.select(F.col("u").alias("row"), F.col("v").alias("group")).unionByName(roots)


def links(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between representatives, enough to join every group. ``docs``: row, text; ``signed``: a written table."""
    reps = signed.where("n_shingles > 0").groupBy("d0", "d1").agg(F.min("row").alias("row"))
    own = signed.join(reps.select("row"), "row", "left_semi")
    keyed = own.select("row", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = cut_lineage(keyed.join(shared.select("key"), "key"), "buckets")
    members = cut_lineage(own.join(buckets.select("row").distinct(), "row", "left_semi").select("row", *_TRAITS), "members")
    # Sorted and merged at every size: a broadcast of the members would only do for small tables.
    texts = cut_lineage(docs.select("row", "text").join(members.select("row").hint("merge"), "row", "left_semi"), "texts")
    found, used = None, None
    grouped = buckets.withColumn("group", F.col("row"))
    for _ in range(STAR_ROUNDS):
        centre = cut_lineage(_hubs(grouped, used), "hubs")
        used = centre.select("hub").distinct() if used is None else used.unionByName(centre.select("hub")).distinct()
        spokes = grouped.join(centre, "key").where("group <> hub_group").select("row", "hub").distinct()
        judged = spokes.join(members.alias("x"), spokes["row"] == F.col("x.row")).join(members.alias("y"), spokes["hub"] == F.col("y.row")).where(_possible("x", "y"))
        best = judged.groupBy(F.col("x.row").alias("b")).agg(F.min(F.struct(_bits("x", "y").alias("bits"), F.col("y.row").alias("a"))).alias("m")).select(F.col("m.a").alias("a"), "b")
        good = cut_lineage(confirmed(best, texts), "links")
        found = good if found is None else found.unionByName(good)
        known = cut_lineage(components(found), "groups")
        grouped = cut_lineage(_open(buckets.join(known, "row", "left").withColumn("group", F.coalesce("group", "row"))), "open")
    return found.unionByName(confirmed(_remaining(grouped, members), texts))


def _hubs(grouped: DataFrame, used: DataFrame | None) -> DataFrame:
    """The centre of each bucket: the member that meets most documents of other groups over all its buckets.

    What others were copied from meets more of them than they meet each other. A row is a centre in one round only.
    """
    own = grouped.groupBy("key", "group").agg(F.count(F.lit(1)).alias("own"))
    whole = grouped.groupBy("key").agg(F.count(F.lit(1)).alias("whole"))
    others = grouped.join(own.join(whole, "key"), ["key", "group"]).groupBy("row").agg(F.sum(F.col("whole") - F.col("own")).alias("met"))
    free = others if used is None else others.join(used, others["row"] == used["hub"], "left_anti")
    top = grouped.join(free, "row").groupBy("key").agg(F.max(F.struct(F.col("met"), (-F.col("row")).alias("minus"), F.col("group"))).alias("c"))
    return top.select("key", (-F.col("c.minus")).alias("hub"), F.col("c.group").alias("hub_group"))


def _remaining(grouped: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs (a, b) of different groups in an open bucket that sizes and sketches allow, each from one of its buckets only."""
    sizes = grouped.groupBy("key", "group").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("group", F.struct("n", "group")).alias("main"))
    keys = grouped.groupBy("row").agg(F.collect_list("key").alias("keys"))  # at most one key for each band
    full = grouped.join(members.join(keys, "row"), "row").join(main, "key").withColumn("minor", F.col("group") != F.col("main")).drop("main")
    x, y = full.where("minor").alias("x"), full.alias("y")
    ordered = ~F.col("y.minor") | (F.col("x.row") < F.col("y.row"))
    once = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.group") != F.col("y.group")) & ordered & _possible("x", "y") & once)
    return cut_lineage(pairs.select(F.greatest("x.row", "y.row").alias("a"), F.least("x.row", "y.row").alias("b")), "pairs")


def _open(grouped: DataFrame) -> DataFrame:
    """The buckets that hold more than one group."""
    several = grouped.groupBy("key").agg(F.min("group").alias("l"), F.max("group").alias("h")).where("l <> h").select("key")
    return grouped.join(several, "key", "left_semi")


def groups(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_shingles, component_id (smallest id of the group) and keeper, for each row of row, doc_id, text."""
    signed = cut_lineage(signatures(docs), "signatures")
    reps = signed.where("n_shingles > 0").groupBy("d0", "d1").agg(F.min("row").alias("rep"))
    joined = cut_lineage(components(links(docs, signed)), "groups").select(F.col("row").alias("rep"), "group")
    placed = signed.select("row", "doc_id", "n_shingles", "d0", "d1").join(reps, ["d0", "d1"], "left").withColumn("rep", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("row")))
    placed = cut_lineage(placed.join(joined, "rep", "left").select("row", "doc_id", "n_shingles", F.coalesce("group", "rep").alias("group")), "placed")
    first = placed.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))).alias("first"))
    return placed.join(first, "group").select("row", "doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), (F.col("first.row") == F.col("row")).alias("keeper"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """groups() of any table with doc_id and text."""
    return groups(numbered(docs.select("doc_id", "text")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without all but one of each group, with their own columns. ``docs`` must be a scan, so that row numbers stay."""
    number = "_row_of_group"
    rows = numbered(docs, number)
    keepers = groups(rows.select(F.col(number).alias("row"), "doc_id", "text")).where("keeper").select(F.col("row").alias(number))
    return rows.join(keepers, number, "left_semi").select(*docs.columns)
