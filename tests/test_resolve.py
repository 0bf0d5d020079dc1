import random

from pyspark.sql import functions as F

from bibliolith.operators import resolve


def _titles():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 9))) for _ in range(60)]
    out = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (3, 5, 8, 12, 20, 45, 90) for _ in range(3)]
    for t in list(out):
        words = t.split()
        out += ["the " + t, " ".join(["changed", *words[1:]]), "".join(c for c in t if rng.random() > 0.15), t[:1] + "x" + t[2:]]
        rng.shuffle(words)
        out.append(" ".join(words))
    return sorted(set(out)) + ["", "a", "a b"]


def test_title_pairs_equal_brute_force(spark):
    titles = spark.createDataFrame([(t,) for t in _titles()], "title string")
    every = titles.toDF("a").crossJoin(titles.toDF("b")).where(resolve.similar_titles(F.col("a"), F.col("b")))
    wanted = {tuple(r) for r in every.collect()}
    found = [tuple(r) for r in resolve.title_pairs(titles, titles).collect()]
    assert set(found) == wanted and len(found) == len(wanted)
    assert sum(x[:12] != y[:12] for x, y in wanted) > 20


def test_cascade_finds_titles_that_differ_early(spark):
    rows = spark.createDataFrame([(1, None, None, "The lungs of birds in winter"), (2, "P9", None, "x")], "key int, pmid string, doi string, title string")
    known = spark.createDataFrame([("P5", None, "Lungs of birds in winter"), ("P9", None, "unlike")], "pmid string, doi string, title string")
    assert {tuple(r) for r in resolve.resolve(rows, known).collect()} == {(1, "P5", "title"), (2, "P9", "pmid")}


def test_documents_of_similar_titles(spark):
    rows = [("D1", "Lungs of birds"), ("D2", "Lungs of birds"), ("D3", "The lungs of birds"), ("D4", "Economy"), ("D5", None)]
    found = resolve.similar_documents(spark.createDataFrame(rows, "id string, title string")).collect()
    assert {tuple(r) for r in found} == {("D1", "D2"), ("D2", "D1"), ("D3", "D1")}


def test_articles_carry_whole_texts(spark, sf_dir):
    from bibliolith.plans import catalog

    found = {r["pmid"]: r["abstract"] for r in catalog.QUERIES["scan_pubmed_texts"](spark, sf_dir).collect()}
    texts = {str(r["doc_id"]): r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert all(len(found[k].split()) == len("".join(" " if c in "<>&" else c for c in texts[k]).split()) for k in found)
    assert max(len(t) for t in found.values()) > 1000


def test_longest_common_subsequences(spark):
    import numpy as np

    def plain(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            row = _next(row, c, y)
        return row[-1]

    def _next(row, c, y):
        out = [0]
        for k, d in enumerate(y):
            out.append(row[k] + 1 if c == d else max(row[k + 1], out[-1]))
        return out

    texts = [t.encode() for t in _titles() if t]
    rng = random.Random(1)
    pairs = [(rng.randrange(len(texts)), rng.randrange(len(texts))) for _ in range(60)]
    left, right = (np.array(x) for x in zip(*pairs))
    assert list(resolve._common_order(texts, texts, left, right)) == [plain(texts[i], texts[j]) for i, j in pairs]


def test_pairs_of_one_table_are_those_of_two(spark):
    titles = spark.createDataFrame([(t,) for t in _titles()], "title string")
    alone, two = ([tuple(r) for r in x.collect()] for x in (resolve.title_pairs(titles), resolve.title_pairs(titles, titles)))
    assert sorted(alone) == sorted(two)


def _near(texts):
    import pyarrow as pa

    block = pa.table({"title": texts, "hash": list(range(len(texts)))})
    return block, resolve._near_by_letters(block, block)


def test_long_unlike_titles_do_not_reach_the_matcher():
    rng = random.Random(2)
    parts = ["tion", "th", "er", "an", "in", "the", "ou", "ed", "sh", "qu", "bly", "wh", "z", "x"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(400)]
    texts = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(60, 90))) for _ in range(120)})
    _, found = _near(texts)
    assert found.num_rows <= 2 * len(texts)  # each with itself; before, thousands of these pairs


def test_no_near_title_is_left_out_by_letters():
    import difflib

    rng = random.Random(6)
    texts = set()
    for size in (10, 60, 130, 190, 210, 260, 420, 900, 2300):
        for letters in ("abcdefghijklmnopqrstuvwxyz ", "eatn xq"):
            first = "".join(rng.choice(letters) for _ in range(size))
            texts.add(first)
            for share in (0.05, 0.12, 0.17, 0.19, 0.2, 0.21, 0.23):
                cut = "".join(c for c in first if rng.random() > share)
                texts |= {cut, "".join(c if rng.random() > share else rng.choice(letters) for c in first), first[: int(size * (1 - share))], cut[5:] + first[:9]}
                at = rng.randrange(size)
                texts.add(first[:at] + "".join(rng.choice(letters) for _ in range(int(size * share * 2.3))) + first[at:])
    texts = sorted({" ".join(t.split()) for t in texts} - {""})
    _, found = _near(texts)
    pairs = set(zip(found["a"].to_pylist(), found["b"].to_pylist()))
    near = 0
    for i, x in enumerate(texts):
        for j, y in enumerate(texts):
            if 3 * min(len(x), len(y)) >= 2 * max(len(x), len(y)):
                matcher = difflib.SequenceMatcher(None, x, y)
                if matcher.real_quick_ratio() >= 0.8 and matcher.quick_ratio() >= 0.8 and matcher.ratio() >= 0.8:
                    near += 1
                    assert (i, j) in pairs, (x, y)
    assert near > 3 * len(texts)


def test_common_order_of_all_pairs_of_two_lists():
    import numpy as np

    texts = [t.encode() for t in _titles() if t]
    a, b = texts[:40], texts[30:70]
    left, right = (x.ravel() for x in np.indices((len(a), len(b))))
    assert list(resolve._common_order_of_all(a, b).ravel()) == list(resolve._common_order(a, b, left, right))
