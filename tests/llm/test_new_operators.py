"""Token files, divergence audit and tokenizer alignment against plain Python, on odd tables."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

from pavesa.llm import alignment, divergence, tokenfiles
from pavesa.session import scratch_path
from tests.llm import plain

WORDS = "the of and word Word. wörd é é ́ 's don't a.b !. 12 <|endoftext|> <|ENDOFTEXT|> </s> <unk> <0x0A> 漢字 😀 ß İ Σ \x1c \x85 \xa0x \n \t 　 x\ny ﬁ".split(" ")


def odd_texts(n, seed=3):
    rnd = random.Random(seed)
    return [rnd.choice(["", " ", "\n", "  "]) + rnd.choice([" ", "  ", "", " \n"]).join(rnd.choice(WORDS) for _ in range(rnd.randint(0, 30))) for _ in range(n)] + [None, "", " ", "▁", "a ▁", " " * 40, "x" * 5000]


@pytest.fixture(scope="module")
def odd_docs(spark):
    texts = odd_texts(150)
    rows = [(i // 2, t, [None, "en", "de"][i % 3], [None, "s1", "s2", "s3"][i % 4], i, "x", "y") for i, t in enumerate([*texts, *texts[:9]])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens long, shard string, rank string").repartition(3)


# -- token files


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenfiles.tokenizer_path())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def test_encoder_equals_library():
    texts = odd_texts(1500, 5)
    coder = tokenfiles.Encoder(tokenfiles.tokenizer_path())
    for _ in range(2):  # unknown words first, remembered ones after
        assert [list(struct.unpack(f"<{len(b) // 4}i", b)) for b in (coder.encode((x or "").encode()) for x in texts)] == [x[:-1] for x in library_ids(texts)]


def test_token_files(spark, odd_docs):
    path = scratch_path(spark, "test-tokens")
    tokenfiles.write(odd_docs, path, tokenfiles.tokenizer_path())
    rows = sorted(((r["doc_id"], r["text"]) for r in odd_docs.collect()), key=lambda r: r[0])
    want = sorted((d, zlib.crc32(struct.pack(f"<{len(x)}I", *x)), len(x)) for (d, _), x in zip(rows, library_ids([t for _, t in rows]), strict=True))
    got = tokenfiles.checksums(tokenfiles.documents(spark, path)).orderBy("start").collect()
    assert sorted((r["doc_id"], r["ids_crc32"], r["n_tokens"]) for r in got) == want
    assert [r["doc_id"] for r in got] == [d for d, _ in rows]
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    # A window has the ids of that stretch of all ids.
    every = [i for r in tokenfiles.documents(spark, path).orderBy("start").collect() for i in r["tokens"]]
    for a, n in ((0, 1), (17, 200), (start - 5, 50), (start, 3)):
        part = tokenfiles.window(spark, path, a, n).orderBy("start").collect()
        assert [i for r in part for i in r["tokens"]] == every[a : a + n] and (not part or part[0]["start"] == a)


def test_encodings_and_selective_reads(spark, odd_docs):
    path = scratch_path(spark, "test-tokens")
    tokenfiles.write(odd_docs, path, tokenfiles.tokenizer_path())
    file = spark.read.parquet(f"{path}/data").where("n_tokens > 0").inputFiles()[0].removeprefix("file:")
    group = pq.ParquetFile(file).metadata.row_group(0)
    columns = {c.path_in_schema: c for c in (group.column(i) for i in range(group.num_columns))}
    assert "RLE_DICTIONARY" in columns["tokens.list.element"].encodings
    assert all("DELTA_BINARY_PACKED" in columns[c].encodings for c in ("doc_id", "at", "n_tokens", "shard"))
    assert all(columns[c].has_column_index and columns[c].has_offset_index for c in ("doc_id", "at"))
    plan = tokenfiles.documents(spark, path).where("doc_id between 3 and 5").select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan and "GreaterThanOrEqual(doc_id,3)" in plan


def test_token_files_of_nothing(spark, odd_docs):
    path = scratch_path(spark, "test-tokens")
    tokenfiles.write(odd_docs.where("false"), path, tokenfiles.tokenizer_path())
    assert tokenfiles.documents(spark, path).columns == ["doc_id", "start", "n_tokens", "tokens"] and tokenfiles.documents(spark, path).count() == 0


# -- divergence


def plain_audit(rows):
    import re

    terms = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(lang or "", source or "", terms.findall(plain.lower(text))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(w for d in own for w in set(d[2]))
        kept = sorted((w for w in df if df[w] >= 3), key=lambda w: w.encode())
        groups = {s: Counter(w for d in own if d[1] == s for w in d[2] if df[w] >= 3) for s in {d[1] for d in own}}
        whole = sum(groups.values(), Counter())
        share = lambda c, w: 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))
        f = lambda p, q: (p - q) ** 2 // q
        for s, c in groups.items():
            pairs = [(-sum(f(share(c, w), share(d, w)) for w in kept), o.encode()) for o, d in groups.items() if o != s]
            words = [(-f(share(c, w), share(whole, w)), w.encode()) for w in kept if c[w] and share(c, w) > share(whole, w)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(words)[:200])):
                out += [(lang, s, part, x.decode(), -v, i + 1) for i, (v, x) in enumerate(found)]
    return sorted(out)


def test_audit_against_plain_python(spark, odd_docs):
    docs = odd_docs.select("text", "lang", "source", "rank").unionByName(spark.createDataFrame([(None, "empty", "s1", "r"), ("one two", "empty", "s2", "r")], "text string, lang string, source string, rank string"))
    got = sorted(map(tuple, divergence.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect()))
    assert got == plain_audit([(r["text"], r["lang"], r["source"]) for r in docs.collect()])
    assert ("empty", "s1", "pair", "s2", 0, 1) in got


def test_audit_of_many_equal_terms(spark):
    """More terms of one value than there are ranks: the first in UTF-8 order stay."""
    letters = "abcdefghijklmnopqrstuvwxyzéü漢"
    words = [a + b for a in letters for b in letters]
    text = " ".join(words)
    docs = spark.createDataFrame([(text, "x", "s1"), (text, "x", "s1"), (text + " more more", "x", "s2"), ("more", "x", "s2"), ("more", "x", "s3")], "text string, lang string, source string")
    got = sorted(map(tuple, divergence.audit(docs).collect()))
    assert got == plain_audit([tuple(r) for r in docs.collect()])
    assert max(r[5] for r in got if r[1] == "s1" and r[2] == "term") == 200


def test_audit_of_nothing(spark, odd_docs):
    assert divergence.audit(odd_docs.where("false")).count() == 0


def test_terms_in_pieces():
    text = "Ab cd1ef-gé ".encode() * 50
    whole = [w for ws in divergence.pieces_of(text) for w in ws]
    assert [w for ws in divergence.pieces_of(text, 7) for w in ws] == whole == ["ab".encode(), b"cd", b"ef", "gé".encode()] * 50


# -- alignment


def plain_alignment(texts):
    pair = alignment.Pair(*alignment.tokenizer_paths())
    found, counts = [], Counter()
    for x in texts:
        a = pair.a.encode(f" {x}", add_special_tokens=False).ids if x else []
        b = pair.b.encode(x) if x else []
        exact = x and b"".join(pair.bytes_a[i] for i in a) == f" {x}".encode() == b"".join(pair.bytes_b[i] for i in b)
        if not exact:
            found.append(None)
            continue
        ends = lambda ids, sizes: [sum(len(sizes[i]) for i in ids[: k + 1]) for k in range(len(ids))]
        ea, eb = ends(a, pair.bytes_a), ends(b, pair.bytes_b)
        links = [(i, j) for n, i in zip(ea, a, strict=True) for m, j in zip(eb, b, strict=True) if n == m]
        cuts = [0, *sorted(set(ea) & set(eb))]
        groups = [",".join(str(i) for n, i in zip(ea, a, strict=True) if s < n <= e) + "|" + ",".join(str(j) for n, j in zip(eb, b, strict=True) if s < n <= e) for s, e in zip(cuts, cuts[1:], strict=False)]
        counts.update(links)
        found.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(counts[x] == top[x[1]] for x in r[3]), sum(counts[x] for x in r[3]), r[4]) for r in found]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_against_plain_python(spark, odd_docs, small, monkeypatch):
    if small:  # many segments and blocks; executors import the module anew, so the local limits go through the driver's own run
        monkeypatch.setattr(alignment, "TOGETHER", 30)
        monkeypatch.setattr(alignment.segments, "__defaults__", (11,))
        texts = [r["text"] for r in odd_docs.collect()]
        block = alignment.Block(alignment.Pair(*alignment.tokenizer_paths()), "b")
        import pyarrow as pa

        block.add(pa.record_batch({"k": pa.array(range(len(texts)))}), texts)
        got = [(*n, h) for n, h in zip(block.numbers[0].tolist(), block.hashes, strict=True)]
        assert got == [(a, b, n, h) for a, b, n, _, _, _, h in plain_alignment(texts)]
        return
    rows = odd_docs.collect()
    got = alignment.aligned(odd_docs, keep=["doc_id", "n_tokens"]).collect()
    want = plain_alignment([r["text"] for r in rows])
    assert sorted(map(tuple, got)) == sorted((r["doc_id"], r["n_tokens"], *w) for r, w in zip(rows, want, strict=True))


def test_alignment_of_nothing(spark, odd_docs):
    empty = alignment.aligned(odd_docs.where("false"), keep=["doc_id"])
    assert empty.columns == ["doc_id", *alignment.RESULTS] and empty.count() == 0
