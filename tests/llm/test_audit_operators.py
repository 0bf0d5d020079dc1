"""Whitening, source divergence and language-model scores against plain definitions."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bibliolith.llm import divergence, ppm
from bibliolith.llm.ppm import AdaptiveTrie, adaptive_lengths, score_documents
from bibliolith.llm.whitening import block_lanczos, whiten_embeddings

VECTORS = "vec_id long, embedding array<float>, n int, component string, _x int"


def vectors(rows):
    return [(k, v, 1, "x", 2) for k, v in rows]


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 12)) * np.linspace(3, 0.5, 12)
    return np.vstack([base, np.repeat(base[:1], 150, axis=0)]).astype(np.float32)  # a third of all rows are one


def test_whitening_equals_the_decomposition_of_the_covariance(spark, cloud):
    rows = [(k, v.tolist()) for k, v in enumerate(cloud)]
    odd = [(900, None), (901, [1.0] * 11 + [None]), (902, [float("nan")] * 12), (903, [float("inf")] + [0.0] * 11), (904, [1.0]), (905, [])]
    got = whiten_embeddings(spark.createDataFrame(vectors(rows + odd), VECTORS).repartition(7), components=5, block=3).toPandas()
    x = np.floor(1024 * cloud.astype(float)).astype(np.int64) + 100_000
    n = len(x)
    assert len(got) == 5 * n and set(got["n"]) == {n} and got["vec_id"].max() == n - 1
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    deviation = ((n * x - x.sum(0)) ** 2).sum(1)
    wide = got.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    want = (x - x.mean(0)) @ axes[:, :5] / np.sqrt(values[:5])
    assert np.abs(wide * np.sign((wide * want).sum(0)) - want).max() < 1e-9
    assert np.abs(np.cov(wide.T, bias=True) - np.eye(5)).max() < 1e-9 and got["identity_error"].max() < 1e-9
    first = got[got["component"] == 1].sort_values("vec_id")
    assert [int(v) for v in first["deviation"]] == deviation.tolist()
    shares = got.groupby("component")["explained"].first().to_numpy()
    assert np.abs(shares / (values / values.sum())[:5] - 1).max() < 1e-12


def test_whitening_of_degenerate_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert whiten_embeddings(empty).count() == 0
    same = spark.createDataFrame(vectors([(k, [1.0, 2.0]) for k in range(4)]), VECTORS)
    assert whiten_embeddings(same).count() == 0  # no component has variance
    line = spark.createDataFrame(vectors([(None, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0])]), VECTORS)
    got = whiten_embeddings(line).collect()
    assert len(got) == 3 and {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1)
    large = spark.createDataFrame(vectors([(1, [1e30]), (2, [0.0])]), VECTORS)
    with pytest.raises(ArithmeticError):
        whiten_embeddings(large)
    wide = spark.createDataFrame(vectors([(1, [2.0**30]), (2, [-(2.0**30)])]), VECTORS)
    x = [2**40 + 100_000, -(2**40) + 100_000]
    assert {int(r["deviation"]) for r in whiten_embeddings(wide).collect()} == {(2 * x[0] - sum(x)) ** 2}  # beyond 64 bits


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 40), st.integers(1, 9), st.integers(1, 12), st.integers(0, 5))
def test_block_lanczos_finds_copies_of_an_eigenvalue(d, wanted, block, seed):
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = np.sort(rng.integers(0, 4, d).astype(float))[::-1]  # many copies: the Krylov space ends early
    matrix = basis * values @ basis.T
    got, axes, _ = block_lanczos(lambda q: matrix @ q, d, wanted, block)
    assert np.abs(got - values[: len(got)]).max() < 1e-9 and len(got) == min(wanted, d)
    assert np.abs(matrix @ axes - axes * got).max() < 1e-9 and np.abs(axes.T @ axes - np.eye(len(got))).max() < 1e-9


DOCS = "doc_id long, text string, lang string, source string, term string, p long, gid int"


def plain_audit(rows, min_docs, top):
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
    listed = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text))) for _, text, lang, source in rows]
    out = []
    for lang in {r[0] for r in listed}:
        own = [r for r in listed if r[0] == lang]
        df = collections.Counter(t for r in own for t in set(r[2]))
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        v = len(kept)
        counts = collections.defaultdict(collections.Counter)
        for _, source, found in own:
            counts[source].update(t for t in found if t in set(kept))
        weigh = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * v) for t in kept}
        p, q = {s: weigh(c) for s, c in counts.items()}, weigh(sum(counts.values(), collections.Counter()))
        for s in counts:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in counts if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, value, k + 1) for k, (value, i) in enumerate(ordered) if part == "pair" or k < top]
    return sorted(out)


@pytest.mark.parametrize("block", [2, 3, 256])
def test_audit_equals_its_definition(spark, block):
    rng = random.Random(5)
    words = [f"w{chr(97 + k)}" for k in range(14)] + ["É", "漢字", "The", "the"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(12))) + "1-2", rng.choice(["en", "xx", None]), f"s{min(rng.randrange(14), 9)}") for k in range(400)]
    rows += [(1, None, "en", "s0"), (None, "", None, None), (3, "wa", "lone", "only"), (4, "...", "two", "a"), (5, "z", "two", "b")] + rows[:3] * 2
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS).repartition(5)
    got = divergence.audit_sources(docs, min_docs=8, top=4, block=block)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == plain_audit(rows, 8, 4)


def test_audit_of_an_empty_table_and_of_a_term_in_many_sources(spark):
    assert divergence.audit_sources(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(k, "all " * (k + 1), "en", f"s{k:03}") for k in range(90)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS)
    got = divergence.audit_sources(docs, min_docs=30, block=16)
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, 30, 50)


def test_term_counts_of_a_long_text(spark):
    text = "Word " * 300_000
    docs = spark.createDataFrame([(1, text, "en", "a", "", 0, 0)], DOCS)
    assert [tuple(r) for r in divergence.term_counts(docs).where("term is not null").collect()] == [("en", "a", "word", 300_000, 1)]


def in_training(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 != 0


def learn():
    return F.pmod(F.crc32(F.col("_id").cast("string")), F.lit(10)) != 0


@pytest.mark.parametrize("order,block_bytes", [(2, 64 << 20), (5, 300), (7, 5_000)])
def test_scores_equal_a_trie_in_one_place(spark, order, block_bytes):
    rng = random.Random(order)
    words = ["the", "The", "theme", "at", "é", "漢字", "a" * 30]
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(25)))) for k in range(60)]
    rows += [(100, None), (101, ""), (102, " \n"), (103, "unseen §"), (104, "ab " * 900), (104, "ab " * 900), (None, "the at")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, key int, block string").repartition(4)
    got = score_documents(docs, learn(), order=order, block_bytes=block_bytes).collect()
    assert len(got) == len(rows)
    trie, seen = AdaptiveTrie(order), collections.Counter()
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
    tokens = lambda s: re.findall(r"[^\x20\x09-\x0D]+", low(s)) + [None]
    for i, text in rows:
        if in_training(i):
            trie.length(low(text).encode(), code=False)
            seen.update(tokens(text))
    n, v = sum(seen.values()), len(seen)
    want = []
    for i, text in rows:
        base = sum(math.log10((seen[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(text))
        want.append((i, in_training(i), len(tokens(text)), sum(seen[t] > 0 for t in tokens(text)), n, base, trie.length(low(text).encode(), learn=False)))
    key = lambda r: (r[0] is None, r[0] or 0)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6])


def test_probabilities_of_all_symbols_add_up_to_one():
    trie = AdaptiveTrie(3)
    trie.length(b"abracadabra abracadabra", code=False)
    for context in (b"bra", b"xra", b"xyz", b"\xff\xffa"):
        assert sum(10 ** trie.code(context, s) for s in range(256)) == pytest.approx(1, abs=0.02)  # what excluded nodes leave is escaped in full
    grams = np.array([int.from_bytes(b"abra" + bytes([s]), "big") for s in range(256)], np.uint64)
    assert np.exp(np.log(10) * ppm.string_costs(grams, [])).sum() == pytest.approx(1)


def test_scores_without_training_rows_and_of_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in score_documents(docs, F.lit(False)).collect()}
    assert got[1]["score"] == pytest.approx(-3 * math.log10(256)) and got[2]["n_tokens"] == 1 and got[2]["train_tokens"] == 0
    assert score_documents(docs.limit(0), F.lit(True)).count() == 0


def test_held_out_texts_cost_less_than_by_their_words(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = score_documents(docs.where("lang = 'en'"), learn())
    bits = -got.where("not learned").join(docs, "doc_id").agg(F.sum("score") / F.sum(F.octet_length("text"))).first()[0] * math.log2(10)
    assert bits < 2.8  # of 8 a byte


def test_a_text_of_many_stretches(spark):
    text = "abcde " * 400_000
    docs = spark.createDataFrame([(1, text), (2, "abcde abcde")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in score_documents(docs, F.col("_id") == 1, order=3).collect()}
    assert -12 < got[1] < 0 and got[2] > -20  # every byte but the first and the end is nearly certain


def test_adaptive_lengths(spark):
    docs = spark.createDataFrame([(1, "abab" * 50), (2, None), (3, "qwertyuiopasdfgh" * 1)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in adaptive_lengths(docs).collect()}
    assert got[2] == pytest.approx(-math.log10(256)) and got[1] > 3 * got[3]


def test_one_long_document_does_not_spend_the_lines_of_the_others(spark):
    from bibliolith.llm.line_labels import GROUPS, N_FEATURES, WIDTH, fit_line_labels, judge_lines

    rng = random.Random(7)
    good = lambda: "\n".join(" ".join(f"word{rng.randrange(300)}" for _ in range(14)) + "." for _ in range(6))
    bad = lambda: "\n".join(" | ".join(rng.choices(["HOME", "NEXT", "TAGS", "2024"], k=3)) for _ in range(6))
    rows = [(k, good() if k % 2 else bad()) for k in range(200)]
    long = "\n".join(good() for _ in range(700))
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(k, 1) for k in range(500, 520)], "doc_id long, quality int")
    fit = lambda extra: fit_line_labels(spark.createDataFrame(rows + extra, "doc_id long, text string"), labels, max_train_lines=1_000)
    without, among = fit([]), fit([(k, long) for k in range(500, 520)])
    assert among is not None and without["weights"].shape == (N_FEATURES, 2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shares = [{r["doc_id"]: r["content_share"] for r in judge_lines(docs, m).collect()} for m in (without, among)]
    assert all((shares[0][k] > 0.5) == (shares[1][k] > 0.5) == bool(k % 2) for k in range(200))
    gap = np.abs((among["weights"] - without["weights"])[:, 1] - (among["weights"] - without["weights"])[:, 0]).reshape(len(GROUPS), WIDTH)
    assert gap.mean() < 0.5


def test_line_labels_without_both_classes(spark):
    from bibliolith.llm.line_labels import fit_line_labels

    docs = spark.createDataFrame([(1, "a b\nc"), (2, "d")], "doc_id long, text string")
    one = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")  # the other class has no document
    assert fit_line_labels(docs, one) is None
    assert fit_line_labels(docs, one.limit(0)) is None
