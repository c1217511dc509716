"""Operators on small odd inputs: nulls, empty and long texts, ties, repeated rows, empty tables, columns with clashing names."""

import base64
import random
import tempfile
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pavesa.llm import chat, decontaminate, gru, html, langid, lm, neardup, pieces, quality, sharding, warc
from tests.llm import plain

ENGLISH = "the cat and the dog went to the house with all of them and then they came home again to eat what was left there by the people of that town"
GERMAN = "der Hund und die Katze gingen zum Haus mit allen und dann kamen sie wieder nach Hause um zu essen was dort noch von den Leuten übrig war"
ODD = [
    (1, ENGLISH, "en", 7), (2, ENGLISH, "en", 7), (2, ENGLISH, "en", 7), (None, ENGLISH + " today", "en", None), (3, None, None, None), (4, "", "en", 1), (5, " \n\t", "de", 1),
    (6, GERMAN, "de", 1), (7, "one two", "en", 1), (8, "one two", None, 1), (9, "x " * 30_000, "en", 1), (10, "y" * 50_000, "en", 1), (11, "12 34 !!", "en", 1), (12, "A\nA\nb\nA\n", "en", 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with a column for each name that an operator gives its results."""
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, n_words long")
    extra = ["fail_bits", "score", "row", "_text", "ids", "hits", "key", "shard", "group", "lang_pred", "_row", "n_shingles", "word"]
    path = tempfile.mkdtemp(prefix="run-") + "/odd"
    df.withColumns({c: F.lit("x") for c in extra}).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


def test_quality(spark, odd):
    rows = quality.ledger(odd).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        ws = plain.words(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(ws), sum(map(len, ws)), plain.repeat_words(r["text"]) if len(ws) < 1000 else len(ws))
        assert (r["fail_bits"] & 1) == (len(ws) < 20)
        assert ((r["fail_bits"] & quality.STRICT.mask) == 0) == (plain.quality_ok(r["text"]) if len(ws) < 1000 else False)
    assert quality.kept(odd, quality.STRICT).columns == odd.columns
    assert quality.kept(odd, quality.STRICT).count() == sum(plain.quality_ok(t) for _, t, _, _ in ODD if not t or len(t) < 20_000)
    found = {(r["policy"], r["rule"]): r for r in quality.ablation(quality.ledger(odd)).collect()}
    bits = [r["fail_bits"] for r in rows]
    for p in (quality.BASE, quality.STRICT):
        for rule in p.rules:
            rest = p.mask & ~quality.BITS[rule]
            r = found[p.name, rule]
            assert (r["kept"], r["kept_without"]) == (sum(not b & p.mask for b in bits), sum(not b & rest for b in bits))
            assert r["only_this"] == r["kept_without"] - r["kept"]
    assert quality.ledger(odd.limit(0)).count() == 0 and quality.ablation(quality.ledger(odd.limit(0))).first()["kept"] == 0


def test_repeated_windows(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    rows = quality.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(r["n_repeat_words"] == plain.repeat_words(r["text"]) for r in rows)


def test_near_duplicates(spark, odd):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert by[1] == by[2] == by[None] == {1} and by[8] == by[7] == {7} and by[3] == {3} and by[4] == {4} and by[5] == {5} and by[9] == {9}
    assert sum(r["keeper"] for r in rows) == 10
    kept = neardup.deduplicated(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4, 5, 6, 7, 9, 10, 11, 12]
    assert neardup.near_duplicates(odd.limit(0)).count() == 0


def test_near_duplicates_against_brute_force(spark):
    """Chains of edits around the threshold, and many texts that share half of their words without being linked."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts, common = [], [word() for _ in range(60)]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 90))]
        for _ in range(8):
            texts.append(" ".join(base))
            base = base.copy()
            for _ in range(rng.choice([1, 1, 2])):
                base[rng.randrange(len(base))] = word()
    texts += [" ".join(common + [word() for _ in range(50)]) for _ in range(40)]
    rng.shuffle(texts)
    rows = neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r["component_id"] for r in sorted(rows, key=lambda r: r["doc_id"])] == plain.groups(texts)
    assert all(r["n_shingles"] == len(plain.shingles(texts[r["doc_id"]])) for r in rows)


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    for share in (0.7, 0.8, 0.95):
        errors = []
        for _ in range(60):
            n = int(600 * 2 * share / (1 + share))
            both = rng.integers(0, 2**63, n, np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, 600 - n, np.uint64)])) for _ in range(2))
            x, y = (neardup.odd_sketch(neardup.min_hashes(s)) for s in (a, b))
            bits = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
            size = 64 * neardup.SKETCH_WORDS
            errors.append(1 + size / 2 * np.log(1 - 2 * bits / size) / (2 * neardup.SAMPLES) - share)
            assert share < 0.75 or bits <= neardup.MOST_BITS
        assert abs(np.mean(errors)) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (300, 301)]
    got = {r["row"]: r["group"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[150] == got[200] == got[100] == 100 and got[301] == 300
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sharding(spark, odd):
    limit = 200
    rows = sharding.sharded(odd, "doc_id", F.octet_length("text"), limit, look=3).collect()
    assert len(rows) == len(ODD)
    sums = {}
    for r in rows:
        sums[r["shard"]] = sums.get(r["shard"], 0) + len((r["text"] or "").encode())
    assert all(r["shard_bytes"] == sums[r["shard"]] and r["fits"] == (sums[r["shard"]] <= limit) for r in rows)
    assert all(len(s) == sharding.BITS for s, n in sums.items() if n > limit)
    shards = sorted(sums)
    assert not any(b.startswith(a) for a, b in zip(shards, shards[1:], strict=False))
    for s in shards:  # only oversized buckets were split
        parent = s[:-1]
        assert not s or sum(n for x, n in sums.items() if x.startswith(parent)) > limit
    assert {r["shard"] for r in sharding.sharded(odd, "doc_id", F.lit(1), 100).collect()} == {""}
    assert sharding.sharded(odd.limit(0), "doc_id", F.lit(1), 100).count() == 0


def test_archives(spark):
    rows = [(5, "u\r\nX: y", "abc"), (3, None, "abc"), (None, "u", "abc"), (3, "v", "abc"), (7, "w", None), (8, "w", ""), (9, "q", "x\r\n\r\nWARC/1.1\r\n\r\né"), (10, "q", " \n"), (11, "z", "long " * 50_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, row long")
    path = tempfile.mkdtemp(prefix="run-") + "/warc"
    warc.write(pages, path, archive_bytes=1000)
    read = warc.restored(warc.read(spark, path, payloads=True)).collect()
    assert sorted((r["page_id"] or 0, bytes(r["payload"])) for r in read) == sorted((i or 0, (h or "").encode()) for i, _, h in rows)
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in read}
    assert kinds == {(3, "response", None), (3, "revisit", 3), (5, "revisit", 3), (None, "revisit", 3), (7, "response", None), (8, "revisit", 7), (9, "response", None), (10, "response", None), (11, "response", None)}
    assert all(r["payload_bytes"] == len(r["payload"]) for r in read)
    again = tempfile.mkdtemp(prefix="run-") + "/warc"
    warc.write(pages, again, min_bytes=10)
    assert {r["record_type"] for r in warc.read(spark, again).where("payload_bytes < 10").collect()} == {"response"}
    assert warc.archived(pages.limit(0)).count() == 0


def test_languages(spark, odd):
    model = langid.learn(odd, least=1)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd, model).collect()}
    assert got[1][0] == "en" and got[6][0] == "de" and got[3] == got[4] == got[5] == got[11] == ("und", 0.0)
    assert langid.with_language(odd, model).columns == odd.columns and langid.with_language(odd, model).count() == len(ODD) - 4
    nothing = langid.learn(odd.limit(0))
    assert {r["lang_pred"] for r in langid.identify(odd, nothing).collect()} == {"und"}
    many = spark.createDataFrame([(f"l{i:03d}", " ".join(f"{chr(0x4E00 + 40 * i + j)}{chr(0x4E01 + 40 * i + j)}" for j in range(30))) for i in range(150)], "lang string, text string")
    model = langid.learn(many, least=1)
    assert [r["lang_pred"] for r in langid.identify(many, model).orderBy("lang").collect()] == [f"l{i:03d}" for i in range(150)]


def test_junk_is_in_no_language(spark):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    junk = ["".join(rng.choices(letters, k=400)), " ".join("".join(rng.choices(letters, k=6)) for _ in range(60)), base64.b64encode(rng.randbytes(300)).decode(), "漢字漢字 仮名"]
    clean = [ENGLISH, GERMAN, "the dog came home", "der Hund und die Katze", ENGLISH[:60] + " 123"]
    model = langid.learn(spark.createDataFrame([(ENGLISH, "en"), (GERMAN, "de")], "text string, lang string"), least=1)
    docs = spark.createDataFrame([(t,) for t in [*junk, *clean, "12 !", None]], "text string")
    assert sorted(r["text"] for r in langid.with_language(docs, model).collect()) == sorted(clean)
    nothing = langid.learn(spark.createDataFrame([(ENGLISH, None)], "text string, lang string"))
    assert langid.with_language(docs, nothing).count() == len(junk) + len(clean)


def test_learning_at_every_size(spark):
    """The same text many times over gives the same filter, a language of one short text is learned, and many n-grams leave slots empty."""
    rows = spark.createDataFrame([(ENGLISH, "en"), ("der Hund und die Katze", "de")], "text string, lang string")
    small, large = langid.learn(rows), langid.learn(rows.crossJoin(spark.range(200)).drop("id"))
    assert small.bits == large.bits and (small.slots == large.slots).all()
    assert langid.judge(["die Katze", "the house"], small)[0] == ["de", "en"]
    rng = np.random.default_rng(6)
    wide = [(" ".join("".join(map(chr, rng.integers(0x4E00, 0x9F00, 8))) for _ in range(2000)), "zh") for _ in range(6)]
    model = langid.learn(spark.createDataFrame(wide, "text string, lang string"))
    assert model.bits > langid.LEAST_BITS and model.false_rate.max() <= langid.FILL**langid.HASHES + 0.01
    assert langid.slot_bits(langid.MILLION // langid.LEAST) == 21


def test_grams_of_long_texts(monkeypatch):
    texts = [langid.letters(ENGLISH * 3), langid.letters(GERMAN), "", langid.letters("a")]
    whole = sorted((int(o), int(h)) for a, b in langid.grams(texts) for o, h in zip(a, b, strict=True))
    monkeypatch.setattr(langid, "PIECE", 37)
    assert whole == sorted((int(o), int(h)) for a, b in langid.grams(texts) for o, h in zip(a, b, strict=True))


def test_filter_without_false_negatives():
    hashes = np.random.default_rng(2).integers(0, 2**63, 5000, np.uint64)
    table = np.zeros((1, 1 << 16), np.int64)
    np.bitwise_or.at(table[0], langid.slots(hashes, 16).ravel(), 1)
    model = langid.Filter(["a"], table, 16, np.array([table.mean() ** langid.HASHES]), "a")
    assert model.hits(hashes).all()
    other = np.random.default_rng(3).integers(0, 2**63, 20_000, np.uint64)
    assert abs(model.hits(other).mean() - model.false_rate[0]) < 0.005


def test_decontamination(spark, odd):
    items = [("b", "the dog went to the house with all of them and"), ("a", "One, two!"), ("b", "x x x x x x x x x x x x"), (None, "left there by the people"), ("c", ""), ("d", None), ("b", "One two")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for block, shard in ((10**6, 10**6), (30, 50)):
        rows = decontaminate.matches(odd, bench, block_bytes=block, shard_words=shard).withColumn("n_hit", decontaminate.hit_words()).collect()
        assert len(rows) == len(ODD)
        for r in rows:
            if r["doc_id"] == 9:
                assert (r["n_hit"], r["items"], r["longest"]) == (30_000, ["b"], 12)
                continue
            assert r["n_hit"] == len(plain.hit_words(r["text"], [t for _, t in items])) and r["n_words"] == len(plain.test_words(r["text"]))
            assert r["items"] == sorted({n or "" for n, t in items if plain.hit_words(r["text"], [t])})
        one = next(r for r in rows if r["doc_id"] == 1)
        assert (one["longest"], one["longest_item"], one["longest_at"]) == (11, "b", 3)
    clean = decontaminate.decontaminated(odd, bench)
    assert clean.columns == odd.columns and {r["doc_id"] for r in clean.collect()} == {3, 4, 5, 6, 10, 11, 12}
    assert decontaminate.matches(odd, bench.limit(0)).where("size(hits) > 0").count() == 0
    assert decontaminate.matches(odd.limit(0), bench).count() == 0


def test_suffix_array_order():
    rng = np.random.default_rng(4)
    words = np.append(rng.integers(0, 4, 400), 0)
    starts = np.flatnonzero(words > 0)
    order = decontaminate.suffix_array(words, starts, 30, 2)
    padded = np.concatenate([words, np.zeros(40, int)])
    keys = [tuple(padded[i : i + 30]) for i in order]
    assert sorted(order) == sorted(starts) and keys == sorted(keys)


def test_pieces(spark, odd):
    sentencepiece = pytest.importorskip("sentencepiece")
    model = pieces.PieceModel.load(pieces.model_path())
    own = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab  theing▁éä\n😀<0x41></s>1") for _ in range(rng.randint(0, 80))) for _ in range(400)] + ["thein" * 3000 + "a" * 1000 + "的" * 500]
    for t in texts:
        ids = pieces.encode(model, t).tolist()
        assert pieces.decode(model, ids) == t and ("▁" in t or ids == own.encode(t))
    rows = pieces.encoded(odd, pieces.model_path(), verify=True).collect()
    assert len(rows) == len(ODD) and all(r["round_trip"] if r["text"] is not None else r["ids"] is None for r in rows)
    back = pieces.decoded(pieces.encoded(odd.select("doc_id", "text"), pieces.model_path(), keep=["doc_id"]), pieces.model_path())
    assert sorted(map(str, back.select("text").collect())) == sorted(map(str, odd.select("text").collect()))


def test_unigram_stream_is_the_best_way():
    scores = {"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -3.2, "aba": -5.0, "bb": -4.0}
    model = pieces.PieceModel({p: i for i, p in enumerate(scores)}, scores, [0] * 256, [], True, False, 3)

    def best(text):
        total = [0.0] + [-1e9] * len(text)
        for e in range(1, len(text) + 1):
            total[e] = max(total[s] + scores[text[s:e]] for s in range(max(0, e - 3), e) if text[s:e] in scores)
        return total[-1]

    rng = random.Random(6)
    for n in (1, 5, 40, 700):
        text = "".join(rng.choice("ab") for _ in range(n))
        stream = pieces.Stream(model)
        found, longest = [], 0
        for i in range(0, n, 7):
            found += stream.push(text[i : i + 7])
            longest = max(longest, len(stream.text))
        found += stream.close()
        assert "".join(found) == text and sum(scores[p] for p in found) == pytest.approx(best(text)) and longest < 60


def test_reply_trees(spark):
    rows = [
        ("t", 1, None, "user", "hi <s>", 0.0), ("t", 2, 1, "assistant", "a\\1 [INST]", 1.0), ("t", 3, 1, "assistant", "b", 2.0), ("t", 4, 2, "user", None, 5.0), ("t", 5, 3, None, "c", 1.0),
        ("t", 6, 3, "user\n", "d", 1.0), ("t", 9, 99, "system", "lost", 0.0), ("t", 20, 21, "user", "x", 0.0), ("t", 21, 20, "user", "y", 0.0), (None, 1, None, "assistant", "z</s>", None),
    ]
    df = spark.createDataFrame(rows, "tree string, id long, parent long, role string, text string, score double").withColumn("key", F.lit(1))
    got = {(r["tree"], r["leaf"]): r for r in chat.read_back(chat.render(chat.branches(df))).collect()}
    assert {k: (r["rank"], r["branch_score"]) for k, r in got.items()} == {("t", 4): (1, 6.0), ("t", 5): (2, 3.0), ("t", 6): (3, 3.0), ("t", 9): (1, 0.0), (None, 1): (1, 0.0)}
    turns = [(t["role"], t["text"]) for t in got["t", 4]["turns"]]
    assert turns == [("user", "hi <s>"), ("assistant", "a\\1 [INST]"), ("user", "")] and got["t", 4]["learned"] == "a\\1 [INST]" and got[None, 1]["learned"] == "z</s>"
    assert [t["role"] for t in got["t", 6]["turns"]] == ["user", "assistant", "user\n"] and [t["role"] for t in got["t", 5]["turns"]][2] == ""
    best = chat.branches(df, best=1).select("tree", "leaf").distinct().collect()
    assert {(r["tree"], r["leaf"]) for r in best} == {("t", 4), ("t", 9), (None, 1)}
    assert chat.branches(df.limit(0)).count() == 0


def test_deep_thread(spark):
    rows = spark.range(300).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    (r,) = chat.read_back(chat.render(chat.branches(chat.by_turn(rows)))).collect()
    assert r["learned"] == "".join(map(str, range(300)))


def test_language_model(spark, odd):
    held = F.coalesce(F.col("doc_id"), F.lit(0)) == 6
    rows = lm.score_documents(odd, held).collect()
    assert len(rows) == len(ODD)
    trained = sum(len(plain.words(t)) + 1 for i, t, _, _ in ODD if i != 6)
    assert {r["train_tokens"] for r in rows} == {trained}
    by = {r["doc_id"]: r for r in rows}
    assert by[3]["n_tokens"] == by[4]["n_tokens"] == by[5]["n_tokens"] == 1 and by[6]["n_known"] == 2 and by[9]["n_tokens"] == 30_001
    assert all(np.isfinite(r["score"]) and r["score"] <= 1e-6 for r in rows)
    nothing = lm.score_documents(odd, F.lit(True)).collect()
    assert {r["n_known"] for r in nothing} == {0} and {round(r["base_score"], 9) for r in nothing} == {0.0}
    assert lm.score_documents(odd.limit(0), held).count() == 0


@pytest.mark.parametrize("sf, learners", [("sf0.001", 1), ("sf0.001", 16), ("sf0.01", 1), ("sf0.01", 4), ("sf0.01", 64)])
def test_training_helps_with_any_number_of_copies(spark, sf, learners):
    """Held-out texts are likelier than by counts and than by the untrained network, whether one copy learns or many."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").repartition(64)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    rows = docs.where(~held)
    first = lm.vocabulary(lm.count_words(rows))
    learned = lm.fit(rows, F.col("doc_id"), first, learner_words=max(1, first.total // lm.ROUNDS // learners))
    texts = [first.ids(r["text"]) for r in docs.where(held).select("text").collect()]
    before, after = (gru.score(first.shape, m.weights, texts).sum() for m in (first, learned))
    words = sum(map(len, texts))
    assert after > before + 0.03 * words


def test_every_training_text_is_met(spark):
    """The weights of a word change only if the network reads it; here each word is in one text."""
    rows = spark.createDataFrame([(i, f"word{i} " * 60) for i in range(60)], "doc_id long, text string")
    first = lm.vocabulary(lm.count_words(rows))
    before, after = (m.shape.split(m.weights)["win"] for m in (first, lm.fit(rows, F.col("doc_id"), first)))
    read = [k for w, k in first.table.items() if w != lm.END]
    assert len(read) == 60 and (before[read] != after[read]).any(1).all()


def test_lanes_beside_a_long_text():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 9, n).astype(np.int32) for n in (20_000, *[40] * 300)]
    b = gru.batch_of(texts, 9)
    assert b.read.size <= 2 * gru.PADDING * sum(map(len, texts))
    assert list(np.bincount(b.owner[b.owner >= 0])) == [len(t) for t in texts]


def test_probabilities_add_up():
    counts = np.array([50.0, 30, 20, 10, 5, 5, 2, 1])
    shape = gru.shape_of(counts, hidden=4, classes=3)
    flat = gru.start(shape, counts, 7)
    flat += np.random.default_rng(0).normal(0, 0.3, len(flat)).astype(np.float32)
    for before in ([], [3], [8, 0, 2]):
        total = sum(10 ** (gru.score(shape, flat, [np.array([*before, w], np.int32)])[0] - (gru.score(shape, flat, [np.array(before, np.int32)])[0] if before else 0)) for w in range(9))
        assert total == pytest.approx(1, abs=1e-4)


def test_gradients_and_windows():
    counts = np.array([50.0, 30, 20, 10, 5, 5, 2, 1])
    shape = gru.shape_of(counts, hidden=4, classes=3)
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 9, n).astype(np.int32) for n in (5, 150, 1, 33)]
    flat = gru.start(shape, counts, 7)
    whole = gru.score(shape, flat, texts)
    assert np.allclose(whole, [gru.score(shape, flat, [t], steps=7)[0] for t in texts], atol=1e-4)
    learned, squares = flat.copy(), np.zeros_like(flat)
    one = [np.array([0, 1, 2, 3] * 60, np.int32)] * 8
    for _ in range(15):
        gru.train(shape, learned, one, squares)
    assert gru.score(shape, learned, one).sum() > 0.3 * gru.score(shape, flat, one).sum()


def test_gradients_against_differences():
    """A step of training moves each weight along the slope of the log-probability, measured by moving the weight a little."""
    counts = np.array([50.0, 30, 20, 10, 5, 5, 2, 1])
    shape = gru.shape_of(counts, hidden=4, classes=3)
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 9, n).astype(np.int32) for n in (12, 7, 9)]
    flat = gru.start(shape, counts, 7).astype(np.float64) + rng.normal(0, 0.1, sum(int(np.prod(s)) for s in shape.parts().values()))
    moved, damp, rate = flat.copy(), 1e8, 1.0
    words = gru.train(shape, moved, texts, np.full_like(flat, damp), rate)
    slope = (moved - flat) * damp**0.5 / rate * words**0.5
    most = words**0.5  # steps are cut there

    def value(i: int, by: float) -> float:
        other = flat.copy()
        other[i] += by
        return gru.score(shape, other, texts).sum() * np.log(10)

    measured = np.array([(value(i, 1e-2) - value(i, -1e-2)) / 2e-2 for i in range(len(flat))])
    for name, block in shape.split(measured).items():
        assert np.allclose(np.clip(block, -most, most), shape.split(slope)[name], atol=5e-3), name


def test_long_texts_are_cut_for_training():
    texts = [np.arange(20_000, dtype=np.int32) % 50, *(np.full(300, 3, np.int32) for _ in range(200))]
    b = gru.lesson_of(texts, 99)
    assert b.read.shape[1] == gru.LANES and (b.owner >= 0).sum() == 80_000 and b.read.shape[0] <= 80_000 // gru.LANES + gru.PIECE
    assert (b.read[b.owner >= 0] == 99).sum() == 201  # only whole texts begin with the start


def test_words_in_one_line():
    texts = ["", " ", None, "A b", "  A\tb\n", "x\x1cy\x1d z\x85w", "a\x0b\x0cb\rc\u00a0d\u2003e ÀÉ", "\n\n", "a\x00b \x00", "İ K ſ"]
    words, bounds = lm._split(pa.array(texts))
    assert [words[a:b].to_pylist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [lm.words_of(t) for t in texts]
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 3_000_000, None, "b" * 3_000_000, "c", "d" * 9_000_000, "e"]})
    parts = [p.column("text").to_pylist() for p in lm._slices(iter([batch, batch.slice(0, 0)]))]
    assert len(parts) > 1 and [t for p in parts for t in p] == batch.column("text").to_pylist()


def test_gradients_by_word():
    rng = np.random.default_rng(3)
    read = np.append(np.full(500, 7), rng.integers(0, 300, 700)).astype(np.int32)
    gates = [rng.normal(size=(len(read), 4)) for _ in range(3)]
    seen, sums = gru._by_word(read, gates)
    assert sorted(seen.tolist()) == np.unique(read).tolist()
    for gate, own in zip(gates, sums, strict=True):
        plain_sums = np.zeros((300, 4))
        np.add.at(plain_sums, read, gate)
        assert np.allclose(own, plain_sums[seen])


@pytest.mark.filterwarnings("error")
def test_large_weights_stay_finite():
    """Gates at their ends, and logits too large to be raised as they are."""
    counts = np.array([50.0, 30, 20, 10, 5, 5, 2, 1])
    shape = gru.shape_of(counts, hidden=4, classes=3)
    flat = gru.start(shape, counts, 7)
    flat += np.random.default_rng(0).normal(0, 150, len(flat)).astype(np.float32)
    texts = [np.random.default_rng(1).integers(0, 9, n).astype(np.int32) for n in (40, 3, 90)]
    small, exact = gru.score(shape, flat, texts), gru.score(shape, flat.astype(np.float64), texts)
    assert np.isfinite(small).all() and (exact < -500).any() and np.allclose(small, exact, rtol=1e-3)
    gru.train(shape, flat, texts, np.zeros_like(flat))
    assert np.isfinite(flat).all()


def test_page_trees():
    page = html.parse("<p>a<b>b<p>c</p><ul><li>x<li>y</ul><br/>t &lt; &amp;<script>if (a<b) '</p>'</script><!-- <p>no --></div>end")
    assert html.main_text(page, np.full(len(page.tags), html.ARTICLE)) == "ab c x y t < &end"
    label = html.decode([-1, 0, 1, 1, 3], np.array([0, 5.0, -6, 5, 5]), np.array([0, 0, 40.0, 40, 40]))
    assert list(label) == [0, 1, 2, 1, 1] and html.extract([None, "", "<p></p>"], None) == ["", "", ""]


def test_markup_left_open_takes_linear_time():
    pages = ["<a " * 300_000, "<a <a <a " * 100_000 + '"', '<a "' * 200_000, "<a" * 300_000, "<span>" * 12_000 + "<p>a</p><div>b</div>" * 3_000, "<!" * 300_000, "</a " * 300_000]
    began = time.monotonic()
    for page in pages:
        html.parse(page)
    assert time.monotonic() - began < 20
    assert html.extract(["<p>a < b <c \"d</p>", "<p>1 <a 'x>y'>2</a> <b =\">3</b>"], None) == ["a < b <c \"d", "1 2 <b =\">3"]


def test_html_odd_rows(spark):
    schema = "page_id long, html string, text string, url string"
    good = "<html><body><nav><a href=x>menu</a></nav><article><p>" + ENGLISH + "</p><p>" + GERMAN + "</p></article></body></html>"
    rows = [(1, None, "t", "u"), (2, "", "t", None), (None, good, None, "u"), (3, good, "t", "u"), (3, good, "t", "u"), (4, "<p>" + "long words " * 200_000 + "</p>", "t", "u"), (5, "<a " * 1000, "t", "u")]
    pages = spark.createDataFrame(rows, schema)
    for model in (None, html.learn(pages)):
        out = html.extracted(pages, model).collect()
        assert len(out) == len(rows) and {r["text"] for r in out if r["page_id"] in (1, 2)} == {""}
        assert len({r["text"] for r in out if r["page_id"] in (None, 3)}) == 1
    assert html.extracted(pages.limit(0), html.learn(pages.limit(0))).count() == 0


def test_open_head_and_formulas():
    head = "<!doctype html><html><head>\n<meta charset=utf-8><title>T</title><!-- c --><link rel=x>\n<style>p {}</style><script>1</script>"
    pages = [head + rest for rest in ("<article><p>a</p><p>b</p></article>", "a <p>b", "<body>a <p>b</body>", "</head><p>a<p>b", "</head><body>a<p>b", "&#97;<p>b", "<textarea>no</textarea>a<p>b")]
    assert html.extract(pages, None) == ["a b"] * len(pages)
    assert html.extract(["<head><title>T</title>", head + "</head>"], None) == ["", ""]
    icons = ["<svg class='i'/>", "<svg><path d='M0'/><text>no</text></svg>", "<!-->", "<!--->", "<!-- no --!>", "<!-- <p>no</p> -->"]
    assert html.extract([f"<article><p>A</p>{x}<p>B</p></article>" for x in icons], None) == ["A B"] * len(icons)
    odd = "<article><p>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then</p><object data=f><param name=a><p>film</p></object> <canvas>chart</canvas></article>"
    assert html.extract([odd], None) == ["if x=2 then film chart"]


def test_short_items_beside_long_ones_stay_in_bounds():
    """One item of one word makes every suffix a match; matches must not be written out for each of the long items."""
    rng = random.Random(3)
    texts = [[f"w{min(int(rng.paretovariate(1)), 400)}" for _ in range(300)] for _ in range(600)]
    items = [(f"i{k}", " ".join(f"w{min(int(rng.paretovariate(1)), 400)}" for _ in range(60))) for k in range(400)] + [("one", "w1"), ("copy", " ".join(texts[7][20:90]))]
    tracemalloc.start()
    block = decontaminate.TestBlock.of(items, 10)
    ids = [[block.vocabulary.get(w.encode(), 0) for w in t] for t in texts]
    out = decontaminate._find(ids, block, 10)
    assert tracemalloc.get_traced_memory()[1] < 300_000_000
    tracemalloc.stop()
    assert (out[7]["longest"], out[7]["longest_at"], out[7]["longest_item"]) == (70, 20, "copy")
    lists = [t.split() for _, t in items]
    for d in (0, 7, 300):
        want = 0
        for item in lists:
            before = [0] * (len(item) + 1)
            for w in texts[d]:
                now = [0] + [before[j] + 1 if w == v else 0 for j, v in enumerate(item)]
                want, before = max(want, *now), now
        assert out[d]["longest"] == want and "one" in out[d]["items"]
