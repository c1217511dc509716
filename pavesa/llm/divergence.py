"""Source divergence audit: how far the terms of each (language, source) group are from its language and from the language's other sources.

Smoothed shares of a term are whole numbers, p = 1 + floor(SCALE * (count + 1) / (N + V)), and a term's distance is f = floor((p - q)^2 / q). Both
depend on counts alone, so terms are never compared one by one: terms of equal (group count, language count) form a cell, f is evaluated once a
cell, and cells are ranked by value with the running number of their terms. Cells of equal value are merged, and only the values that reach
a rank within the limit are expanded to terms, in UTF-8 order.

Two sources of a language meet in cells (count here, count there) as well. Terms of only one of them, or of none, are no joint cell: with f0 = f(0, 0),

    sum of f = V * f0 + sum over a's terms (f(a, 0) - f0) + sum over b's terms (f(0, b) - f0) + sum over joint terms (f(a, b) - f(a, 0) - f(0, b) + f0).

Terms are counted in each task before anything is shuffled, so a frequent term or a source with a third of all rows is a few rows for each task.

Defined cases: null text, lang and source are ''; a group without terms has counts of 0 throughout; a language without kept terms has pairs of
value 0 and no ranked terms; each row is one document, repeated rows count again; an empty table gives no rows; a text is counted in pieces, so its
length doesn't matter (one term is one piece); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pavesa.llm.common import cut_lineage

SCALE = 1_000_000_000
LEAST_DOCUMENTS = 3
RANKS = 200
#: Entries that a task counts before it hands them on, and bytes of a text that are counted at once.
ENTRIES = 200_000
PIECE = 1 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def pieces_of(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """Terms of a text, as lists; a term at the end of a piece goes on into the next."""
    rest = b""
    for at in range(0, len(text), size):
        part = rest + text[at : at + size].translate(_LOWER)
        end = len(part) if at + size >= len(text) else part.rfind(b" ") + 1
        rest = part[end:]
        yield part[:end].split()


def term_counts(docs: DataFrame) -> DataFrame:
    """Partial counts (lang, source, term, n, n_docs) over columns text, lang, source; one row without a term for each group met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = [(lang, source, term, n, d) for (lang, source), found in counts.items() for term, (n, d) in found.items()]
            groups = [(lang, source, None, 0, 0) for lang, source in counts]
            lang, source, term, n, d = zip(*rows, *groups, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(lang), pa.array(source), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())], names=["lang", "source", "term", "n", "n_docs"]
            )

        for batch in batches:
            for text, lang, source in zip(batch.column("text"), batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True):
                group = counts.setdefault((lang, source), {})
                before, seen = len(group), set()
                for words in pieces_of(text.as_py()):
                    for w in words:
                        entry = group.get(w)
                        if entry is None:
                            group[w] = [1, 0]
                        else:
                            entry[0] += 1
                    seen.update(words)
                for w in seen:
                    group[w][1] += 1
                size += len(group) - before
                if size >= ENTRIES:
                    yield flush()
                    counts, size = {}, 0
        if counts:
            yield flush()

    empty = F.lit("")
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source")), F.coalesce(F.col("text"), empty).cast("binary").alias("text"))
    return rows.mapInArrow(run, "lang string, source string, term string, n long, n_docs long")


def share(count: Column, total: Column, kept: Column) -> Column:
    """p of a count; decimals, since a count times SCALE may be beyond 64 bits."""
    return (F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)"), (total + kept).cast("decimal(19,0)"))).cast("long")


F_OF = "(({p} - {q}) * ({p} - {q})) div {q}"


def audit(docs: DataFrame, ranks: int = RANKS, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: other sources of the language by distance, and the terms that a group has too often."""
    by_term = Window.partitionBy("lang", "term")
    # One shuffle serves the sums by source and those by language.
    merged = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    known = merged.select("lang", "source", "term", "n", F.sum("n").over(by_term).alias("lang_n"), F.sum("n_docs").over(by_term).alias("lang_docs"))
    table = cut_lineage(known.where(F.col("term").isNull() | (F.col("lang_docs") >= least)), "terms")
    terms = table.where(F.col("term").isNotNull()).drop("lang_docs")
    groups = cut_lineage(_groups(table, terms), "groups")
    return _pairs(terms, groups).unionByName(_terms(terms, groups, ranks)).withColumn("rank", F.col("rank").cast("int"))


def _groups(table: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, source, total (N of the group), lang_total, kept (V): one row for each group that occurs."""
    own = table.groupBy("lang", "source").agg(F.coalesce(F.sum(F.when(F.col("term").isNotNull(), F.col("n"))), F.lit(0)).alias("total"))
    size = terms.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("lang_total"))
    return own.join(size, "lang", "left").fillna(0, ["kept", "lang_total"])


def _pairs(terms: DataFrame, groups: DataFrame) -> DataFrame:
    side = lambda x: groups.select("lang", "kept", F.col("source").alias(x), F.col("total").alias(f"total_{x}"))
    pairs = side("a").join(side("b").drop("kept"), "lang").where("a <> b")
    with_zero = pairs.where("kept > 0").select(
        "lang", "a", "b", "kept", "total_a", "total_b", share(F.lit(0), F.col("total_a"), F.col("kept")).alias("a0"), share(F.lit(0), F.col("total_b"), F.col("kept")).alias("b0")
    )
    count = lambda x: terms.select("lang", "term", F.col("source").alias(x), F.col("n").alias(f"n_{x}"))
    met = count("a").join(count("b"), ["lang", "term"]).where("a < b").groupBy("lang", "a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("m"))
    met = cut_lineage(met, "joint")
    turned = met.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b"), "m")
    alone = terms.groupBy("lang", F.col("source").alias("one"), "n").agg(F.count(F.lit(1)).alias("m"))
    none = F.lit(0).cast("long")
    cells = (
        met.unionByName(turned).withColumn("kind", F.lit(3)).join(with_zero, ["lang", "a", "b"])
        .unionByName(alone.join(with_zero, (alone["lang"] == with_zero["lang"]) & (alone["one"] == with_zero["a"])).drop(alone["lang"]).drop("one").withColumnsRenamed({"n": "n_a"}).withColumns({"n_b": none, "kind": F.lit(1)}))
        .unionByName(alone.join(with_zero, (alone["lang"] == with_zero["lang"]) & (alone["one"] == with_zero["b"])).drop(alone["lang"]).drop("one").withColumnsRenamed({"n": "n_b"}).withColumns({"n_a": none, "kind": F.lit(2)}))
    )
    cells = cells.withColumns({"p": share(F.col("n_a"), F.col("total_a"), F.col("kept")), "q": share(F.col("n_b"), F.col("total_b"), F.col("kept"))})
    f = lambda p, q: F.expr(F_OF.format(p=p, q=q))
    base = f("a0", "b0")
    more = F.when(F.col("kind") == 3, f("p", "q") - f("p", "b0") - f("a0", "q") + base).otherwise(f("p", "q") - base)
    sums = cells.groupBy("lang", "a", "b").agg(F.sum(F.col("m") * more).alias("more"))
    zero = with_zero.select("lang", "a", "b", (F.col("kept") * base).alias("least"))
    value = pairs.select("lang", "a", "b").join(zero, ["lang", "a", "b"], "left").join(sums, ["lang", "a", "b"], "left")
    value = value.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), (F.coalesce("least", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("long").alias("value"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return value.select("lang", "source", F.lit("pair").alias("part"), "item", "value", ranked.alias("rank"))


def _terms(terms: DataFrame, groups: DataFrame, ranks: int) -> DataFrame:
    group, cell = ["lang", "source"], ["lang", "source", "n", "lang_n"]
    cells = terms.groupBy(*cell).agg(F.count(F.lit(1)).alias("m")).join(groups, group)
    cells = cells.withColumns({"p": share(F.col("n"), F.col("total"), F.col("kept")), "q": share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))})
    cells = cells.where("p > q").withColumn("value", F.expr(F_OF.format(p="p", q="q")))
    # A cell has a term at least, so those beyond the limit by rank (ties stay) can't be reached; each task drops them before the shuffle.
    by_value = Window.partitionBy(*group).orderBy(F.desc("value"))
    top = cells.withColumn("at", F.rank().over(by_value)).where(F.col("at") <= ranks)
    top = cut_lineage(top.select(*cell, "m", "value"), "cells")
    levels = top.groupBy(*group, "value").agg(F.sum("m").alias("m"))
    levels = levels.withColumn("before", F.sum("m").over(by_value) - F.col("m")).where(F.col("before") < ranks).drop("m")
    reached = terms.join(top.drop("m").join(levels, [*group, "value"]), cell)
    # Within one value terms are in UTF-8 order; no more than the limit of each value leave a task.
    placed = reached.withColumn("at", F.row_number().over(Window.partitionBy(*group, "value").orderBy("term"))).where(F.col("at") <= ranks)
    rank = F.col("before") + F.col("at")
    return placed.where(rank <= ranks).select(*group, F.lit("term").alias("part"), F.col("term").alias("item"), "value", rank.alias("rank"))
