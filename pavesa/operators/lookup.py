"""Resolving free names against small dictionaries and against settlement names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pavesa import constants as K
from pavesa.functions import scalar as S
from pavesa.operators import series
from pavesa.operators.spatial import spread
from pavesa.session import cut_lineage

#: Tasks over which the names of one fragment are dealt.
SALTS = 32


def place_dictionary() -> Column:
    """Regions then provinces, in dictionary order, as one literal array."""
    entries = [(k, "ccaa", v) for k, v in K.PLACE_REGIONS.items()] + [(k, "provincia", v) for k, v in K.PLACE_PROVINCES.items()]
    return F.array(*[
        F.struct(
            F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.lit(fold_text(name)).alias("folded"),
            F.array(*[F.lit(float(b)) for b in box]).alias("box"),
        )
        for name, kind, box in entries
    ])


def fold_text(name: str) -> str:
    return name.strip().lower().translate(str.maketrans(K.ACCENTED, K.PLAIN))


def grams(text: Column, n: int) -> Column:
    count = F.length(text) - n + 1
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.when(count >= 1, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def find_containing(needles: DataFrame, names: DataFrame, payload: list[str], rank: Column) -> DataFrame:
    """``needles(needle)`` x ``names(name, ...)``: the best-ranked name that contains each needle.

    Both sides meet on a text fragment: each needle uses its rarest fragment, so a common fragment
    never brings everything together. The fragments in use are stored first, so that Spark knows their size when it
    chooses the join; the names of one fragment are dealt to SALTS tasks.
    """
    folded = spread(names.withColumn("_name", F.lower("name")).withColumn("salt", F.pmod(F.xxhash64(*names.columns), F.lit(SALTS)).cast("int")))
    pieces = folded.withColumn("gram", F.explode(F.concat(grams(F.col("_name"), 1), grams(F.col("_name"), 2), grams(F.col("_name"), 3))))
    common = pieces.groupBy("gram").agg(F.count("*").alias("seen"))
    wanted = needles.filter("needle IS NOT NULL AND needle <> ''").select("needle").distinct().withColumn("_needle", F.lower("needle"))
    size = F.least(F.length("_needle"), F.lit(3))
    own = F.when(size == 1, grams(F.col("_needle"), 1)).when(size == 2, grams(F.col("_needle"), 2)).otherwise(grams(F.col("_needle"), 3))
    split = wanted.withColumn("gram", F.explode(own)).join(common, "gram", "left")
    rarest = split.groupBy("needle", "_needle").agg(F.min_by("gram", F.struct(F.coalesce("seen", F.lit(0)), F.col("gram"))).alias("gram"))
    rarest = cut_lineage(rarest, "rarest").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = rarest.join(pieces, ["gram", "salt"]).filter(F.col("_name").contains(F.col("_needle")))
    return hits.groupBy("needle").agg(F.min_by(F.struct("name", *payload), rank).alias("p")).select("needle", "p.*")


def resolve_places(names: DataFrame, settlements: DataFrame) -> DataFrame:
    """``names(name)`` -> each distinct name with the place it means, or NULLs.

    Region, then province (equal or containing, first in dictionary order), then the most populous
    settlement whose name contains the text.
    """
    asked = names.select("name").distinct()
    needle = S.fold_name(F.col("name"))
    hit = F.get(F.filter(place_dictionary(), lambda p: p["folded"].contains(needle) & (needle != "")), F.lit(0))
    tiered = asked.withColumn("hit", hit)
    open_names = tiered.filter(F.col("hit").isNull() & (needle != "")).select(F.col("name").alias("needle"))
    towns = settlements.select(F.col("nombre").alias("name"), "habitantes", "settlement_id", "bbox")
    found = find_containing(
        open_names, towns, ["habitantes", "bbox"], F.struct(-F.col("habitantes"), F.col("settlement_id"))
    ).withColumnRenamed("name", "town")
    joined = tiered.join(found, tiered["name"] == found["needle"], "left")
    box = lambda i, n: F.coalesce(F.col("hit.box")[i], F.col(f"bbox.{n}"))
    return joined.select(
        tiered["name"].alias("asked"),
        F.coalesce("hit.name", "town").alias("place"),
        F.coalesce("hit.kind", F.when(F.col("town").isNotNull(), "municipio")).alias("kind"),
        box(0, "minx").alias("minx"), box(1, "miny").alias("miny"), box(2, "maxx").alias("maxx"), box(3, "maxy").alias("maxy"),
    )


GLOSSARY_FIELDS = ["key", "name", "long_name", "unit", "description", "context"]


def explain_terms(terms: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """``terms(term)`` -> the glossary entry: equal key first, then the first entry mentioning it.

    ``glossary`` has rows of ``landing.read_glossary`` (one file of terms, so one array); the result then has all of its fields, and the known
    terms where nothing was found. Without it the built-in names are used.
    """
    fold = lambda c: F.upper(F.replace(F.coalesce(c, F.lit("")), F.lit(" ")))
    own = ["key", "long_name"] if glossary is None else GLOSSARY_FIELDS
    if glossary is None:
        glossary = terms.sparkSession.createDataFrame([(i, *entry) for i, entry in enumerate(K.GLOSSARY)], "position int, key string, name string, long_name string")
    entry = F.struct(
        "position", *own, fold(F.col("key")).alias("folded"), F.array(*(fold(F.col(c)) for c in ("name", "long_name", "key"))).alias("texts")
    )
    known = glossary.agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
    rows = series.join_one_row(terms, known)
    needle = S.fold_term(F.coalesce("term", F.lit("")))
    same = F.get(F.filter("_entries", lambda e: e["folded"] == needle), F.lit(0))
    near = F.get(F.filter("_entries", lambda e: F.exists(e["texts"], lambda x: x.contains(needle))), F.lit(0))
    found = rows.withColumn("_e", F.coalesce(same, near))
    more = [] if own == ["key", "long_name"] else [F.when(F.col("_e").isNull(), F.transform("_entries", lambda e: e["key"])).alias("available_terms")]
    return found.select(*terms.columns, F.col("_e").isNotNull().alias("found"), *(F.col(f"_e.{c}").alias(c) for c in own), *more)
