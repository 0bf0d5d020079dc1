import collections
import random

import brute
import corpus_pipeline
import pytest
from bibliolith.llm.queries import PASSAGE_BYTES, TOXIC_AT
from bibliolith.llm.store import Scratch
from pyspark.sql import functions as F

import __spark_entry__ as entry

STAGE = dict(corpus_pipeline.STAGES)
COLUMNS = corpus_pipeline.COLUMNS


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def as_rows(df):
    return collections.Counter(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def planted():
    """Near copies, exact copies, shared ids, null ids and texts, passages, in three sources."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    text = lambda n: [word() for _ in range(n)]
    base = [text(rng.randrange(8, 160)) for _ in range(40)]
    passage = text(60)
    rows = [(k, " ".join(t)) for k, t in enumerate(base)]
    for k in range(12):
        near = list(base[k] * 1)
        near[len(near) // 2] = "changed"
        rows += [(100 + k, " ".join(near)), (200 + k, " ".join(base[k])), (300 + k, " ".join(text(30) + passage + text(20)))]
    rows += [(5, " ".join(text(40))), (5, rows[5][1]), (None, rows[6][1]), (None, " ".join(text(30))), (None, None), (None, None)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "z" * 5_000), (904, "ab " * 9_000), (None, "z" * 5_000)]
    return [(d, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, (d, t) in enumerate(rows)]


def test_stages_hand_documents_on(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    scratch, counts = Scratch(spark), []
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
    assert counts[0] <= before and counts[1] <= counts[0] and counts[2] == counts[1] and counts[-1] > 0


@pytest.mark.parametrize("name", list(STAGE))
def test_stages_take_odd_empty_and_wide_tables(spark, sf_dir, planted, name):
    docs = table(spark, planted)
    assert STAGE[name](spark, docs.limit(0), sf_dir).isEmpty()
    names = ("_id", "id", "_text", "_node", "_shared", "_sum", "size", "score", "_toxicity", "repetitions", "_copy", "component_id")
    wide = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    plain, more = STAGE[name](spark, docs, sf_dir), STAGE[name](spark, wide, sf_dir)
    assert plain.columns == more.columns
    if name == "packing":
        assert plain.agg(F.sum("length")).first() == more.agg(F.sum("length")).first()
    else:
        assert plain.columns == COLUMNS and as_rows(plain) == as_rows(more)


def test_toxic_rows_go_and_the_others_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = {r.doc_id for r in STAGE["toxicity"](spark, docs, sf_dir).select("doc_id").collect()}
    clean = [d for d, x in labels.items() if x == 0]
    assert sum(d in kept for d in clean) >= 0.97 * len(clean) and TOXIC_AT == 0.3


def test_one_of_each_group_of_copies_stays(spark, sf_dir, planted):
    got = as_rows(STAGE["ngram_jaccard"](spark, table(spark, planted), sf_dir))
    assert not got - collections.Counter(planted), "rows are kept as they are"
    # The plain way: rows equal in id and text are one; every other row is a document of its own.
    own = list(dict.fromkeys((d, t) for d, t, *_ in planted))
    linked = brute.similar_components([(k, t) for k, (_, t) in enumerate(own)])
    groups = collections.defaultdict(set)
    for k, _, component in linked:
        groups[component].add(own[k])
    alive = collections.Counter((d, t) for d, t, *_ in got.elements())
    for members in groups.values():
        assert sum(alive[m] for m in members) == 1
    assert sum(alive.values()) == len(groups)
    ids = collections.Counter(d for d, *_ in planted)
    for members in groups.values():
        if all(d is not None and ids[d] == 1 for d, _ in members):
            assert alive[min(members, key=lambda m: m[0])] == 1


def test_repeated_strings_go(spark, sf_dir, planted):
    got = STAGE["suffix_dedup"](spark, table(spark, planted), sf_dir).collect()
    raws = [(t or "").encode() for _, t, *_ in planted]
    often = collections.Counter(b[i : i + PASSAGE_BYTES] for b in raws for i in range(len(b) - PASSAGE_BYTES + 1))
    want = collections.Counter()
    for (d, _, lang, source, _), b in zip(planted, raws):
        gone = set()
        for i in range(len(b) - PASSAGE_BYTES + 1):
            if often[b[i : i + PASSAGE_BYTES]] > 1:
                gone.update(range(i, i + PASSAGE_BYTES))
        kept = bytes(x for i, x in enumerate(b) if i not in gone).decode()
        want[(d, kept, lang, source, len(kept))] += 1
    assert collections.Counter(map(tuple, got)) == want


def test_the_mix_repeats_rows_as_told(spark, sf_dir, planted):
    got = as_rows(STAGE["mixing"](spark, table(spark, planted), sf_dir))
    size = collections.defaultdict(int)
    for _, t, _, s, _ in planted:
        size[s] += len(brute.words(t))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(size.values()))
    while open_:  # capped water-filling, round by round
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * size[s]} or None
        for s in full or open_:
            target[s] = 3.0 * size[s] if full else level * weight[s]
        left -= sum(target[s] for s in full or ())
        open_ = open_ - full if full else set()
    taken, times, there = collections.defaultdict(int), collections.Counter(planted), 0
    for row, n in got.items():
        there += 1
        assert n <= 3 * times[row]
        taken[row[3]] += n * len(brute.words(row[1]))
    longest = {s: max(len(brute.words(t)) for _, t, _, x, _ in planted if x == s) for s in order}
    assert there and all(abs(taken[s] - target[s]) <= longest[s] for s in order)


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
