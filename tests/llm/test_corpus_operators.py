import collections
import hashlib
import math
import random
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from bibliolith.llm import byte_repeats, jaccard, line_labels, textkit, toxicity, word_repeats  # noqa: E402
from bibliolith.llm.byte_repeats import remove_repeated_bytes  # noqa: E402
from bibliolith.llm.components import connected_components  # noqa: E402
from bibliolith.llm.fingerprints import Sketches, fingerprint_documents, likenesses, paragraph_keys  # noqa: E402
from bibliolith.llm.jaccard import similar_components  # noqa: E402
from bibliolith.llm.line_labels import fit_line_labels, judge_lines  # noqa: E402
from bibliolith.llm.mixing import mix_sources  # noqa: E402
from bibliolith.llm.packing import SumOfSquares, WordTokens, pack_documents  # noqa: E402
from bibliolith.llm.queries import tokenizer_file  # noqa: E402
from bibliolith.llm.sharding import shard_documents  # noqa: E402
from bibliolith.llm.store import Scratch  # noqa: E402
from bibliolith.llm.toxicity import fit_toxicity, score_toxicity  # noqa: E402
from bibliolith.llm.url_lists import filter_captures  # noqa: E402
from bibliolith.llm.word_repeats import remove_repeated_words  # noqa: E402

SCHEMA = "doc_id long, text string"
ODD = [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "ONE"), (905, "é ÷ 漢字 <|endoftext|> don't 12a"), (906, "ab " * 700), (907, "ab " * 700)]


def texts(seed, n, length):
    rng = random.Random(seed)
    vocabulary = [f"w{rng.randrange(400)}" for _ in range(400)] + ["é", "The", "the."]
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, length))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    base = texts(1, 40, 260)
    rng = random.Random(2)
    out = [(i, t) for i, t in enumerate(base)]
    for i in range(40, 70):  # near copies, pasted passages, exact copies
        own = base[rng.randrange(40)].split()
        for _ in range(rng.randrange(3)):
            own[rng.randrange(len(own))] = "changed"
        out.append((i, " ".join(own + base[rng.randrange(40)].split()[:70] * rng.randrange(2))))
    return out + ODD + [(3, base[3]), (3, base[3]), (None, base[4]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Extra columns have names that the operators use inside.
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return df.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("_id", "id", "size", "score", "kept", "sig", "_text"))]).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA + ", source string")


def counted(df):
    return collections.Counter(tuple(r) for r in df.collect())


def test_words_and_windows_against_python():
    column = pa.array([t for _, t in ODD] + ["a  b\x1fc\n\nd ", " x y"])
    data, offsets = textkit.text_buffers(column)
    found = textkit.Words(data, offsets)
    raw = data.tobytes()
    got = [raw[s:e].decode() for s, e in zip(found.start, found.end)]
    assert got == [w for t in column.to_pylist() for w in brute.words(t)]
    assert found.count.tolist() == [len(brute.words(t)) for t in column.to_pylist()]
    values = np.array([5, 3, 9, 1, 1, 7, 2], np.uint64)
    for size in range(1, 8):
        assert textkit.sliding_min(values, size).tolist() == [min(values[i : i + size]) for i in range(8 - size)]


# --- 1 -------------------------------------------------------------------------------------------


def test_shards_are_even_and_match_the_mixture(spark):
    data = [(i, "x" * (i % 50), None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 7}") for i in range(1000)]
    df = spark.createDataFrame(data, SCHEMA + ", source string").repartition(7)
    out = [r.asDict() for r in shard_documents(df, shards=8, cells=16).collect()]
    counts = collections.Counter(r["shard"] for r in out)
    assert sorted(counts) == list(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for shard in counts:
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(counts[shard]))
    source = {i: s for i, _, s in data}
    for name, total in collections.Counter(source.values()).items():
        per = collections.Counter(r["shard"] for r in out if source[r["doc_id"]] == name)
        # A cut between rows of equal rank shifts a source by less than its share of the number of sources.
        assert all(abs(per[s] - total / 8) <= 1 + total * len(set(source.values())) / 1000 for s in range(8))
    sample = next(r for r in out if r["doc_id"] == 49)
    assert sample["size"] == 50 and sample["text_crc32"] == zlib.crc32(b"x" * 49) and sample["law"] == "rows"
    assert counted(shard_documents(df, cells=16)) == counted(shard_documents(df.repartition(3), cells=16))


def test_shards_of_odd_tables(docs, rows, none):
    out = shard_documents(docs.withColumn("source", F.lit(None).cast("string")), shards=3).collect()
    assert len(out) == len(rows) and {r["size"] for r in out if r["doc_id"] == 900} == {1}
    assert shard_documents(none).isEmpty()


# --- 2 -------------------------------------------------------------------------------------------


def test_toxicity_finds_planted_words(spark):
    data, labels = [], []
    for i, t in enumerate(texts(5, 600, 60)):
        toxic = i % 4 == 0
        data.append((i, t + (" vile scum" if toxic else "")))
        labels.append((i, int(toxic)))
    df, known = spark.createDataFrame(data, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit_toxicity(df, known, learn_from=F.col("_id") % 3 != 0, l1=2.0)
    scores = {r["doc_id"]: r["score"] for r in score_toxicity(df, model).collect()}
    held = [i for i in scores if i % 3 == 0]
    assert np.mean([(scores[i] >= 0.3) == (i % 4 == 0) for i in held]) > 0.97
    assert 0 < len(model["coords"]) < 2000


def test_toxicity_without_usable_labels(docs, none, spark):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = fit_toxicity(docs, empty)
    scored = score_toxicity(docs, model).select("doc_id", "score").collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert score_toxicity(none, model).isEmpty()
    one = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, toxic int")
    assert len(fit_toxicity(docs, one)["coords"]) == 0


def plain_features(text):
    """Distinct words, and pairs of words at distances 1 to 3, of the runs of letters, digits and non-ASCII bytes."""
    found = [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())]
    return {(w,) for w in found} | {(k, a, b) for k in (1, 2, 3) for a, b in zip(found, found[k:])}


def test_features_and_ftrl_against_plain_ones():
    rng, bits = random.Random(12), 22
    words_ = [f"w{k}" for k in range(30)] + ["Bad", "bad", "ñandú", "x-y"]
    made = [" ".join(rng.choice(words_) for _ in range(rng.randrange(0, 14))) for _ in range(80)]
    labels = [int("bad" in t.lower()) for t in made]
    data, offsets = textkit.text_buffers(pa.array(made))
    row, coord = toxicity.distinct_by_row(*toxicity.feature_pairs(data, offsets, bits), bits)
    cut = np.searchsorted(row, np.arange(len(made) + 1))
    for k, t in enumerate(made):
        plain = plain_features(t)
        assert cut[k + 1] - cut[k] == len(plain)
    # One coordinate a feature: learned from the texts that have it alone in common.
    of = {}
    for k, t in enumerate(made):
        for f in plain_features(t):
            here = set(coord[cut[k] : cut[k + 1]].tolist())
            of[f] = of.get(f, here) & here
    assert all(of.values())

    alpha, beta, l1, l2 = 0.5, 1.0, 0.4, 0.1
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        free = i == "bias"
        if not free and abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (0 if free else math.copysign(l1, z[i]))) / ((beta + math.sqrt(n[i])) / alpha + l2)

    model = toxicity.Ftrl(bits, alpha, beta, l1, l2)
    for k, y in enumerate(labels):
        own = coord[cut[k] : cut[k + 1]]
        active = [*own.tolist(), "bias"]
        w = {i: weight(i) for i in active}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in active:
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
            z[i] += g - sigma * w[i]
            n[i] += g * g
        model.learn(own, y)
    for i in z:
        assert model.weights(np.array([(1 << bits) if i == "bias" else i]))[0] == pytest.approx(weight(i), abs=1e-9)
    assert any(weight(i) == 0 for i in z) and any(weight(i) != 0 for i in z if i != "bias")


# --- 3 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1024, 2])
def test_jaccard_components_equal_all_pairs(docs, rows, block):
    assert counted(similar_components(docs, block=block)) == brute.similar_components(rows)


def test_wide_sketches_bound_the_difference():
    rng = np.random.default_rng(8)
    pool = textkit.mix(rng.integers(1, 1 << 62, 9000, dtype=np.uint64))
    pairs = [(pool[:3000], pool[200:3200]), (pool[:700], pool[10:760]), (pool[:4000], pool[4000:8000]), (pool[:600], pool[3000:3600])]
    wide = lambda x: jaccard.parity_sketch(x, 1 << (2 * len(x) - 1).bit_length())
    x, y = pa.array([wide(a) for a, _ in pairs] + [None], pa.binary()), pa.array([wide(b) for _, b in pairs] + [b"x"], pa.binary())
    n, m = pa.array([len(a) for a, _ in pairs] + [9]), pa.array([len(b) for _, b in pairs] + [9])
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(range(5)), n, m, x, y], names=list("abnmxy"))
    kept = next(jaccard._close_in_wide_sketches(80)([batch])).column(0).to_pylist()
    assert kept == [0, 1, 4]


def test_jaccard_of_nothing(none):
    assert similar_components(none).isEmpty()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(0, 200), st.randoms(use_true_random=False))
def test_similar_sets_share_a_probed_signature(size, seed, rng):
    """The pigeonhole argument itself: whatever is within the allowance meets in some signature."""
    pool = np.unique(textkit.mix(np.arange(seed, seed + size + 120, dtype=np.uint64)))
    large = np.array(sorted(rng.sample(pool.tolist(), size)), np.uint64)
    most = jaccard.allowance(2 * size, 80)
    out = set(rng.sample(large.tolist(), rng.randrange(min(size, most + 1))))
    rest = [x for x in pool.tolist() if x not in set(large.tolist())]
    small = np.array(sorted((set(large.tolist()) - out) | set(rest[: max(0, min(len(out) - 1, most // 2))])), np.uint64)
    if not len(small) or len(small) > size:
        return
    both = len(np.intersect1d(large, small))
    if 100 * both < 80 * (len(large) + len(small) - both):
        return
    k = jaccard.band_of(size)
    assert jaccard.band_low(k) * 80 <= 100 * len(small)
    a = set(jaccard.signatures(large, k, 80)[0].tolist())
    assert a & set(jaccard.signatures(small, k, 80)[0].tolist())


@pytest.mark.parametrize("size", range(1, 60))
def test_what_stays_probed_exceeds_the_allowance(size):
    """The pigeonhole sum over the segments that still probe when the common ones of short sets are left out."""
    rng = random.Random(size)
    rows = [" ".join([f"r{i}", *(f"w{rng.randrange(9000)}" for _ in range(size - 1))]) for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(rows)], names=["id", "text"])
    probed = collections.defaultdict(set)
    for sent in jaccard._map_signatures(1, 80, 4)([batch]):
        for row in sent.to_pylist():
            if row["sig"] is None:
                sigs, docs = np.frombuffer(row["_sigs"], np.uint64), np.frombuffer(row["_docs"], np.int64)
                for s, d, f in zip(sigs.tolist(), docs.tolist(), row["_flags"]):
                    if f & jaccard._PROBES:
                        probed[d].add(s)
            elif row["probe"]:
                probed[row["doc"]].add(row["sig"] % (1 << 64))
    data, offsets = textkit.text_buffers(batch.column(1))
    for d, tokens in enumerate(jaccard.shingle_sets(data, offsets, 1)):
        k = jaccard.band_of(len(tokens))
        sig, seg, _ = jaccard.signatures(tokens, k, 80)
        whole = {g for s, g in zip(sig.tolist(), seg.tolist()) if s in probed[d]}
        wide = jaccard.band_scheme(k, 80).wide
        assert sum(2 if g < wide else 1 for g in whole) > jaccard.allowance(2 * len(tokens), 80)


def test_anchors_past_sixteen_million_words():
    from bibliolith.llm.word_repeats import _nodes

    passage = " ".join(f"p{k}" for k in range(80)).encode()
    data = np.frombuffer(passage + b" x" * (1 << 24) + b" " + passage, np.uint8)
    _, place, node, anchor = _nodes(data, np.array([0, len(data)]), 50, 8)
    assert place[-1] > 1 << 24 and (node[:32] == node[-32:]).all() and (anchor[:32] == anchor[-32:]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert {found[i] for i in range(1, 41)} == {1} and found[102] == 100


@pytest.mark.parametrize("least_hub", [2, 65_536])
def test_components_with_hubs(spark, least_hub):
    """Stars around the least, the largest and a middle node, chained, against a plain search."""
    rng = random.Random(5)
    edges = [(0, i) for i in range(1, 40)] + [(i, 999) for i in range(100, 160)] + [(300, rng.randrange(200, 400)) for _ in range(60)]
    edges += [(39, 100), (500, 501), (501, 502)]
    near = collections.defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for node in sorted(near):
        stack = [node]
        while stack:
            if (at := stack.pop()) not in want:
                want[at] = node
                stack += near[at]
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark), most_hubs=1000, least_hub=least_hub).collect()
    assert sorted((r["node"], r["component"]) for r in found) == sorted(want.items())


def test_edges_of_a_hub_are_spread(spark):
    from bibliolith.llm.components import _with_least

    edges = spark.range(1, 20_001).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    edges = edges.unionByName(spark.range(1, 101).select(F.col("id").alias("u"), (F.col("id") + 7).alias("v")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = _with_least(edges, 1000)
        sizes = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found.where("m <> case when u = 0 then 1 else u + 7 end or m is null").isEmpty() and sum(sizes) == 20_100
    assert max(sizes) < 2 * sum(sizes) / len(sizes)


def test_copies_are_linked_over_parts(spark):
    rows = [(i, 10, 5, 6) for i in range(3, 400)] + [(1000 + i, 10, 5, 100 + i // 2) for i in range(40)] + [(2000, 1, 1, 1)]
    links = [tuple(r) for r in jaccard._copies(spark.createDataFrame(rows, "id long, size long, f1 long, f2 long"), 16).collect()]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    assert all(found[i] == 3 for i in range(3, 400)) and all(found[1000 + i] == 1000 + i // 2 * 2 for i in range(40))
    assert 2000 not in found and len(links) == 396 + 20


# --- 4 -------------------------------------------------------------------------------------------


def test_line_counts(docs, rows, none):
    extra = [(950, "\n\n a\na\n a\n"), (951, "a\n\n\na\nb \nb"), (952, "#|<>*$%& x" * 3)]
    df = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(extra, SCHEMA))
    got = collections.Counter(tuple(r)[:7] for r in judge_lines(df, None).collect())
    assert got == collections.Counter(brute.line_counts(*r) for r in rows + extra)
    assert judge_lines(none, None).isEmpty()


def test_lines_of_shouting_are_boilerplate(spark):
    data, labels = [], []
    for i, t in enumerate(texts(9, 240, 400)):
        lines = [t[k : k + 90] for k in range(0, len(t), 90)]
        data.append((i, "\n".join(x.upper() + "!!" for x in lines) if i % 4 == 0 else "\n".join(lines)))
        labels.append((i, int(i % 4 != 0)))
    df, known = spark.createDataFrame(data, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int").where("doc_id < 160")
    model = fit_line_labels(df, known)
    judged = [r for r in judge_lines(df, model).collect() if r["doc_id"] >= 160 and not r["base_failed"]]
    assert len(judged) > 30 and np.mean([r["kept"] == (r["doc_id"] % 4 != 0) for r in judged]) > 0.95
    assert fit_line_labels(df, known.where("quality = 1")) is None


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    first = np.array([0, 1, 1, 5, 12])
    emission, transition = rng.normal(size=(12, 2)), rng.normal(size=(2, 2))
    got = line_labels.viterbi(emission, transition, first)
    for s, e in zip(first[:-1], first[1:]):
        if e > s:
            paths = [[p >> k & 1 for k in range(e - s)] for p in range(1 << (e - s))]
            value = lambda p: sum(emission[s + k, x] for k, x in enumerate(p)) + sum(transition[a, b] for a, b in zip(p, p[1:]))
            assert max(map(value, paths)) == pytest.approx(value(got[s:e].tolist()))


def test_crf_gradient_against_all_paths():
    """Loss and gradients of stretches of unlike length, from the sum over every labelling."""
    rng = np.random.default_rng(4)
    weights, transition = rng.normal(size=(line_labels.N_FEATURES, 2)), rng.normal(size=(2, 2))
    sequences = [(rng.integers(0, line_labels.N_FEATURES, (n, 3)), rng.integers(0, 2, n)) for n in (1, 4, 6, 2)]

    def loss(w, t):
        total = 0.0
        for x, y in sequences:
            value = lambda p: w[x, np.array(p)[:, None]].sum() + sum(t[a, b] for a, b in zip(p, p[1:]))
            total += np.log(sum(np.exp(value([p >> k & 1 for k in range(len(y))])) for p in range(1 << len(y)))) - value(y.tolist())
        return total

    got, of_weights, of_transition = line_labels.crf_gradient(weights, transition, *line_labels._padded(sequences))
    assert got == pytest.approx(loss(weights, transition))
    used = sorted({int(f) for x, _ in sequences for f in x.ravel()})
    for values, gradient, places in ((weights, of_weights, [(f, c) for f in used[:12] for c in (0, 1)]), (transition, of_transition, [(a, b) for a in (0, 1) for b in (0, 1)])):
        for at in places:
            change = np.zeros_like(values)
            change[at] = 1e-6
            more, less = ((weights + s * change, transition) if values is weights else (weights, transition + s * change) for s in (1, -1))
            assert gradient[at] == pytest.approx((loss(*more) - loss(*less)) / 2e-6, abs=1e-5)


def test_the_end_of_a_long_text_is_learned_from(spark):
    """Footers stand after 200 lines; every line counts, not the first of each text."""
    body = [t[:60] for t in texts(10, 200, 40)]
    data = [(i, "\n".join(body[: 150 + i] + (["| HOME | NEXT | 12 |"] * 30 if i % 2 else body[-30:]))) for i in range(30)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(30)], "doc_id long, quality int")
    model = fit_line_labels(spark.createDataFrame(data, SCHEMA), labels)
    data_, offsets = textkit.text_buffers(pa.array(["\n".join(["| HOME | NEXT | 12 |"] * 3)]))
    _, found, _, first = line_labels.measure(data_, offsets)
    assert (line_labels.viterbi(model["weights"][found].sum(axis=1), model["transition"], first) == 0).all()


# --- 5 -------------------------------------------------------------------------------------------


def test_lists_as_of_the_fetch_day(spark):
    lines = [("bad.example.org", "2024-02-01", "block"), ("bad.example.org", "2024-03-01", "drop"), ("example.com", "2024-01-01", "block")]
    lines += [("good.example.com", "2024-01-05", "allow"), ("good.example.com", "2024-01-05", "block"), (None, "2024-01-01", "block")]
    listed = spark.createDataFrame(lines, "entry string, day string, action string").withColumn("day", F.col("day").cast("date"))
    pages = [
        (1, "http://bad.example.org/x", "2024-01-31", True), (2, "http://u@BAD.example.org:80/x", "2024-02-01", False),
        (3, "http://bad.example.org", "2024-03-01", True), (4, "https://a.b.example.com?q", "2024-01-02", False),
        (5, "https://good.example.com", "2024-01-04", False), (6, "https://good.example.com", "2024-01-05", True),
        (7, None, "2024-01-05", True), (8, "no url", "2024-01-05", True), (9, "http://bad.example.org", None, True), (9, "http://bad.example.org", None, True),
    ]
    captures = spark.createDataFrame(pages, "page_id int, url string, fetched string, kept boolean").withColumn("fetched", F.col("fetched").cast("date"))
    got = filter_captures(captures, listed).collect()
    assert sorted((r["page_id"], r["kept"]) for r in got) == sorted((p[0], p[3]) for p in pages)
    assert all(r["kept"] for r in filter_captures(captures, listed.where("false")).collect())
    plan = filter_captures(captures, listed)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# --- 6 and 10 ------------------------------------------------------------------------------------


def test_word_repeats(docs, rows, none):
    assert counted(remove_repeated_words(docs, window=50)) == brute.word_repeats(rows, 50)
    assert remove_repeated_words(none).isEmpty()


def test_byte_repeats(docs, rows, none):
    assert counted(remove_repeated_bytes(docs, length=400)) == brute.byte_repeats(rows, 400)
    assert remove_repeated_bytes(none).isEmpty()


def test_paths_equal_those_of_the_whole_graph(spark):
    """Nonbranching paths of repeated edges, against a graph built in one place."""
    window, rng = 8, random.Random(9)
    vocabulary = [f"v{k}" for k in range(60)]
    word = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base = [word(rng.randrange(20, 90)) for _ in range(6)]
    data = []
    for k in range(36):
        b, c = rng.choice(base), rng.choice(base)
        i, j = rng.randrange(len(b)), rng.randrange(len(c))
        data.append((k, " ".join(b[i : i + 40] + word(rng.randrange(3)) + c[j : j + 30] + word(rng.randrange(12)))))
    data += [(50, "x " * 40), (51, "x " * 30), (52, " ".join(base[0] + base[0]))]

    where = collections.defaultdict(list)
    for d, t in data:
        w = t.split()
        for i in range(len(w) - window + 1):
            where[tuple(w[i : i + window])].append((d, i))
    own = {e: min(p) for e, p in where.items() if len({d for d, _ in p}) > 1}
    leaving, entering = collections.Counter(e[:-1] for e in own), collections.Counter(e[1:] for e in own)
    at = {p: e for e, p in own.items()}
    follows = {
        p for p, e in at.items()
        if (before := at.get((p[0], p[1] - 1))) and before[1:] == e[:-1] and leaving[e[:-1]] == entering[e[:-1]] == 1
    }
    want = set()
    for d, i in at:
        if (d, i) not in follows:
            n = 1
            while (d, i + n) in follows:
                n += 1
            want.add((d, i, n))

    rows = word_repeats.keyed(spark.createDataFrame(data, SCHEMA).repartition(5), "doc_id", "text")
    found = word_repeats.repeated_edges(rows, window, 4, 7).cache()
    pieces = found.where("_id is null").select("_s_id", "_s_sum", "_piece", "_n")
    paths = pieces.join(word_repeats.compact_paths(pieces), ["_s_id", "_s_sum", "_piece"])
    whole = paths.groupBy("_s_id", "_path").agg(F.max(F.col("_piece") + F.col("_n")).alias("end"))
    assert {(r._s_id, r._path, r.end - r._path) for r in whole.collect()} == want and len(want) > 20
    assert counted(remove_repeated_words(spark.createDataFrame(data, SCHEMA), window=window, anchor=4)) == brute.word_repeats(data, window)


def test_spans_that_do_not_agree_stay(spark, monkeypatch):
    """Should hashes collide, the words decide."""
    data = [(1, " ".join(f"a{k}" for k in range(60))), (2, " ".join(f"b{k}" for k in range(60)))]
    rows = word_repeats.keyed(spark.createDataFrame(data, SCHEMA), "doc_id", "text").collect()
    claim = [(rows[1]._id, rows[1]._sum, 3, 4, rows[0]._id, rows[0]._sum, 5, 5), (None, None, 5, 4, rows[0]._id, rows[0]._sum, 5, 5)]
    monkeypatch.setattr(word_repeats, "repeated_edges", lambda rows, *_: rows.sparkSession.createDataFrame(claim, word_repeats._FOUND))
    got = remove_repeated_words(spark.createDataFrame(data, SCHEMA), window=50)
    assert {r.n_removed for r in got.collect()} == {0}


@pytest.mark.parametrize("length", [5, 20, 200, 240, 400])
def test_a_cover_has_every_difference(length):
    v, cover = byte_repeats.difference_cover(length)
    assert {(a - b) % v for a in cover for b in cover} == set(range(v)) and length - v + 1 >= min(64, length // 2)
    naming = byte_repeats.Samples(v, cover)
    places = [p for p in range(3 * v) if p % v in cover]
    assert naming.place(np.arange(len(places))).tolist() == places
    assert naming.below(np.arange(3 * v)).tolist() == [sum(p < x for p in places) for x in range(3 * v)]


@pytest.mark.parametrize("length", [30, 200, 400])
def test_byte_repeats_of_a_common_passage(spark, length):
    """Parts of one passage at all shifts, in unlike surroundings, between documents and within one."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = word(length + 120)
    cut = lambda: shared[rng.randrange(60) : rng.randrange(length - 20, length + 121)]
    data = [(i, word(rng.randrange(400)) + cut() + word(rng.randrange(400)) + cut() * (i % 5 == 0)) for i in range(60)]
    got = remove_repeated_bytes(spark.createDataFrame(data, SCHEMA).repartition(7), length=length)
    assert counted(got) == brute.byte_repeats(data, length)


def test_byte_repeats_of_periodic_and_very_long_texts(spark, monkeypatch):
    """A long text is hashed by pieces; here they are small."""
    rng = random.Random(7)
    long = "".join(rng.choice("abc") for _ in range(30_000))
    data = [(1, long), (2, "x" + long[9_000:9_500] + "y"), (3, "z" * 3_000), (4, "z" * 399), (None, long[20_000:20_400]), (5, long[:400])]
    want = brute.byte_repeats(data, 400)
    assert counted(remove_repeated_bytes(spark.createDataFrame(data, SCHEMA), length=400)) == want
    monkeypatch.setattr(byte_repeats, "SLICE_BYTES", 1_000)
    monkeypatch.setattr(byte_repeats, "_BATCH_NAMES", 5_000)
    column = pa.array([t for _, t in data])
    batch = pa.RecordBatch.from_arrays([pa.array([d or -1 for d, _ in data]), pa.array(range(6), pa.int64()), column], names=["_id", "_sum", "_text"])
    samples = byte_repeats.Samples(*byte_repeats.difference_cover(400))
    opened = {k: [] for k in range(6)}
    ranges = lambda sort, names: [
        (k, spans) for got in byte_repeats._gather(sort(names)) for k, found in zip(*(c.to_pylist() for c in got.columns[1:]))
        for spans in np.frombuffer(found[0]["_spans"], np.int32).reshape(-1, 2).tolist()
    ]
    for k, spans in ranges(byte_repeats._sort_samples(400, samples, 1), byte_repeats._map_samples(400, samples, 1)([batch])):
        opened[k].append(spans)
    lists = [textkit.pack(np.stack(textkit.runs(*np.array(r or [(0, 0)]).T), 1).astype(np.int32)) for r in opened.values()]
    batch = pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.binary())], names=["_id", "_sum", "_text", "_open"])
    gone = {k: np.zeros(len(t), bool) for k, (_, t) in enumerate(data)}
    for k, (s, e) in ranges(byte_repeats._sort_suffixes(400, 400, 1), byte_repeats._map_suffixes(400, 400, 1)([batch])):
        gone[k][s : e + 399] = True
    assert sorted(int(g.sum()) for g in gone.values()) == sorted(r[2] for r in want)


def test_byte_repeats_report_a_shorter_length(docs, rows):
    both = remove_repeated_bytes(docs, length=400, report=200)
    shorter = remove_repeated_bytes(docs, length=200)
    assert counted(both.drop("n_repeated")) == brute.byte_repeats(rows, 400)
    assert counted(both.select("doc_id", "n_repeated")) == counted(shorter.select("doc_id", "n_removed"))
    assert counted(shorter) == brute.byte_repeats(rows, 200)


def test_byte_repeats_return_the_rest_of_the_text(spark):
    data = [(1, "é" * 300 + "a"), (2, "b" + "é" * 300), (3, "short")]
    got = {r["doc_id"]: r for r in remove_repeated_bytes(spark.createDataFrame(data, SCHEMA), rest=("text",), keep_text=True).collect()}
    assert got[1]["kept_text"] == "a" and got[2]["kept_text"] == "b" and got[3]["kept_text"] == "short" and got[1]["text"] == data[0][1]


# --- 7 -------------------------------------------------------------------------------------------


def test_mix_meets_its_targets(spark):
    rng = random.Random(4)
    sizes = {"a": 30, "b": 300, "c": 900, None: 200}
    data = [(i, " ".join(["x"] * rng.randrange(0, 40)), s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(data, SCHEMA + ", source string").repartition(6)
    out = [r.asDict() for r in mix_sources(df, cells=8).collect()]
    total = sum(r["size"] for r in out)
    by = collections.defaultdict(list)
    for r in out:
        by[(r["source_size"], r["target"])].append(r)
        assert r["taken"] <= 3 * r["size"]
    assert sum(t for _, t in by) == pytest.approx(total)
    for (size, target), group in by.items():
        assert target <= 3 * size + 1e-6 and abs(sum(r["taken"] for r in group) - target) <= 40
    assert counted(mix_sources(df, cells=8)) == counted(mix_sources(df.repartition(2), cells=8))


def test_mix_of_odd_tables(docs, rows, none):
    out = mix_sources(docs.withColumn("source", F.lit("only"))).collect()
    assert len(out) == len(rows) and sum(r["taken"] for r in out) == sum(r["size"] for r in out)
    assert mix_sources(none).isEmpty()
    blank = none.sparkSession.createDataFrame([(1, None, "a"), (2, "", None)], SCHEMA + ", source string")
    assert {r["taken"] for r in mix_sources(blank).collect()} == {0}


# --- 8 -------------------------------------------------------------------------------------------


def test_edited_texts_and_likeness(docs, rows, none):
    out = fingerprint_documents(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = collections.Counter()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, k = t or "", len(t or "") // 3
        want[(i, len(t), hashlib.sha256((t[: len(t) - k] + (after or "")[:k]).encode()).hexdigest())] += 1
    assert collections.Counter(tuple(r)[:3] for r in out) == want
    by_text = collections.defaultdict(set)
    text = collections.defaultdict(set)
    for i, t in rows:
        text[i].add(t or "")
    for r in out:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if len(text[r["doc_id"]]) == 1:
            by_text[min(text[r["doc_id"]])].add(r["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())
    assert fingerprint_documents(none).isEmpty()


def test_likeness_is_that_of_paragraph_sets(spark):
    """``near_edited`` and ``near_next`` against plain Jaccard over (digest, how many before), from the keys of each text."""
    data = list(enumerate(texts(14, 60, 300))) + [(100, ""), (101, None), (102, "a. a. a. b."), (103, "a. a. b. c.")]
    got = {r["doc_id"]: r for r in fingerprint_documents(spark.createDataFrame(data, SCHEMA)).collect()}
    order = sorted(data, reverse=True)

    def keys(text):
        return set(paragraph_keys(*textkit.text_buffers(pa.array([text])))[0].tolist())

    def likeness(a, b):
        return len(keys(a) & keys(b)) / len(keys(a) | keys(b)) if keys(a) | keys(b) else 1.0

    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        k = len(t) // 3
        assert got[i]["near_edited"] == pytest.approx(likeness(t, t[: len(t) - k] + after[:k]))
        assert got[i]["near_next"] == pytest.approx(likeness(t, after))
    # The keys themselves: sentences end a paragraph here, and equal ones are told apart by their number.
    assert len(keys("a. a. a. b.")) == 4 and len(keys("a. a. a. b.") & keys("a. a. b. c.")) == 3


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 90), st.integers(0, 60), st.integers(0, 60))
def test_peeling_recovers_the_exact_difference(shared, left, right):
    keys = textkit.mix(np.arange(1, shared + left + right + 1, dtype=np.uint64))
    a, b = keys[: shared + left], np.concatenate([keys[:shared], keys[shared + left :]])
    want = 1.0 if not len(a) and not len(b) else shared / (shared + left + right)
    assert likenesses([a], [b], 30)[0] == pytest.approx(want)


def test_peeling_gets_stuck_rather_than_guess():
    keys = textkit.mix(np.arange(500, dtype=np.uint64))
    table = Sketches(1, 30).add(keys, np.zeros(500, np.int64), np.ones(500, np.int32))
    assert table.peel().tolist() == [-1]


# --- 9 -------------------------------------------------------------------------------------------


def test_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_file())
    odd = ["", "Don't STOP it's", "é à É ×÷·… x", "ﬀ a̧,b J̌ x<|endoftext|>y", "3a4 ... --a!b", "日本語 text", "tab\tnl\x1cyy", "İ ΣΑΣ 's"]
    cases = odd + [t or "" for _, t in ODD] + texts(3, 30, 80)
    memo = WordTokens(Path(tokenizer_file()).read_text(), limit=40)
    data, offsets = textkit.text_buffers(pa.array(cases))
    for i, j in textkit.row_slices(offsets, 64):
        ids, ends = memo.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for k in range(j - i):
            assert ids[ends[k] : ends[k + 1]].tolist() == whole.encode(cases[i + k], add_special_tokens=False).ids


def test_pieces_cover_every_document_once(docs, rows, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_file())
    pieces = pack_documents(docs, tokenizer_file(), window=256, seal=8).collect()
    windows = collections.defaultdict(list)
    for p in pieces:
        windows[p["sequence_id"]].append(p)
    for group in windows.values():
        at = 0
        for p in sorted(group, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == 256 or at & (at - 1) == 0
    want = collections.Counter()
    for i, t in rows:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want[(i, len(ids))] += len(ids)
    got = collections.Counter()
    for p in pieces:
        got[(p["doc_id"], p["doc_tokens"])] += p["length"]
    assert got == want
    texts_of = dict(rows)
    for p in pieces:
        if p["doc_id"] is not None:
            ids = np.array(whole.encode(texts_of[p["doc_id"]] or "", add_special_tokens=False).ids + [2], "<u4")
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes())
    assert pack_documents(none, tokenizer_file()).isEmpty()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 31), max_size=60))
def test_the_level_is_the_best_of_all(sizes):
    """Every placement against trying all levels; ties go to the fullest window."""
    window, seal = 32, 2
    packer = SumOfSquares(window, seal, lambda pieces: None)
    for k, n in enumerate(sizes):
        if packer.gaps and n > packer.gaps[-1][0] + seal:
            packer.add(k, np.zeros(n, np.uint16))  # closes a window first, which has no choice
            continue
        before = packer.counts.copy()
        scores = []
        for level in [0, *(h for h in range(1, window - n + 1) if before[h])]:
            after = before.copy()
            after[level] -= level > 0
            after[level + n] += level + n < window
            # Nearly full windows wait aside, to be closed exactly; the rule sees them before they go.
            scores.append((int((after**2).sum()), -level, level))
        best = min(scores)[2]
        want = before.copy()
        want[best] -= best > 0
        want[best + n] += window - best - n > seal
        packer.add(k, np.zeros(n, np.uint16))
        assert packer.counts.tolist() == want.tolist()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60))
def test_sum_of_squares_keeps_every_token(sizes):
    out = []
    packer = SumOfSquares(128, 4, out.append)
    for k, n in enumerate(sizes):
        packer.add(k, np.full(n, k, np.uint16))
    packer.flush()
    lengths = [sum(len(p[2]) for p in pieces) for pieces in out]
    assert sum(lengths) == sum(sizes) and all(x == 128 or x & (x - 1) == 0 for x in lengths)
    held = collections.Counter(int(i) for pieces in out for p in pieces for i in p[2])
    assert held == collections.Counter({k: n for k, n in enumerate(sizes)})
