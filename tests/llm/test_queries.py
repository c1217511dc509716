"""Registered queries: names, SQL twins at the smallest scale, and plain Python versions where SQL can't say it."""

import os
import zlib
from collections import Counter
from math import log10

import duckdb
import pytest

import corpus_pipeline
from pavesa.llm.queries import QUERIES, SQL
from tests.llm import plain
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(SQL) <= set(QUERIES) and [len(corpus_pipeline.STAGES), corpus_pipeline.ORACLE_SQL] == [5, None]


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_scores_against_counts(spark):
    docs = documents(spark)
    words = {i: [*(r["text"] or "").encode().lower().split(), b""] for i, r in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    count = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(count.values()), len(count)
    better = 0
    for r in QUERIES["op1_gru_scoring"](spark, SF).collect():
        ws = words[r["doc_id"]]
        base = sum(log10((count[w] + 1) / (n + v + 1)) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(ws), sum(count[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        better += r["score"] - base if held[r["doc_id"]] else 0
    assert better > 0


def test_language_of_held_out(spark):
    docs = documents(spark)
    rows = [r for r in QUERIES["op7_language_id"](spark, SF).collect() if r["held_out"]]
    assert len(rows) == sum(zlib.crc32(str(i).encode()) % 4 == 2 for i in docs)
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_articles(spark):
    import re
    from html import unescape

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    same = 0
    for r in QUERIES["op5_html_extraction"](spark, SF).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        want = " ".join(unescape(re.sub(r"</?(p|h1|br)[^>]*>", " ", re.sub(r"</?b>", "", article))).split())
        same += r["text"] == want
        assert r["n_chars"] == len(r["text"])
    assert same >= 0.98 * len(pages)


def test_pieces_round_trip(spark):
    rows = QUERIES["op8_sentencepiece"](spark, SF).collect()
    assert len(rows) == len(documents(spark)) and all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in rows)


def test_pipeline_against_plain_python(spark):
    """Quality rules, groups and benchmark hits by brute force; language ID keeps what has a letter."""
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [d for d in docs if plain.quality_ok(d["text"]) and any(c.isalpha() for c in d["text"])]
    kept = [d for d, first in zip(kept, plain.group_firsts([d["text"] for d in kept]), strict=True) if first]
    kept = [d for d in kept if not plain.hit_words(d["text"], items)]
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(out) == sorted(d["doc_id"] for d in kept)
    assert all(r["round_trip"] for r in out.values())
