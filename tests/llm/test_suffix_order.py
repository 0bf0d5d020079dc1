"""Suffix ranks by difference-cover rounds, against sorted suffixes and against plain repeats."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import brute
from bibliolith.llm.store import Scratch
from bibliolith.llm.suffix_order import ordered, repeated_bytes_by_order, suffix_ranks

SCHEMA = "doc_id long, text string"


def ranks_of(spark, text, parts=3, alone=12):
    string = spark.createDataFrame(list(enumerate(text)), "pos long, name long").repartition(3)
    got = suffix_ranks(string, len(text), Scratch(spark), parts, alone).collect()
    assert len(got) == len(text)
    return [p for p, _ in sorted(((r["pos"], r["rank"]) for r in got), key=lambda x: x[1])], {r["rank"] for r in got}


@pytest.mark.parametrize("n,letters", [(46, 2), (47, 3), (48, 1), (60, 50)])
def test_ranks_equal_sorted_suffixes(spark, n, letters):
    """All lengths modulo 3, few letters (several rounds), one letter, and many letters (names unique at once)."""
    rng = random.Random(n)
    text = [rng.randint(1, letters) for _ in range(n)]
    order, ranks = ranks_of(spark, text)
    assert order == sorted(range(n), key=lambda i: text[i:]) and ranks == set(range(1, n + 1))


def test_a_run_of_equal_keys_goes_on_over_partitions(spark):
    rows = spark.createDataFrame([(i, 5 if 10 <= i < 90 else i, i) for i in range(100)], "pos long, name long, k long").orderBy(F.rand(1))
    got, distinct = ordered(rows, ["k"], ["name"], Scratch(spark), 7, F.col("pos") % 2 == 0)
    found = sorted((r["pos"], r["dense"], r["place"], r["flagged"]) for r in got.collect())
    assert distinct == 21
    assert found == [(i, i + 1 if i < 10 else 11 if i < 90 else i - 78, i + 1, (i + 1) // 2) for i in range(100)]


def test_repeats_equal_brute_force(spark):
    rng = random.Random(2)
    passage = "".join(rng.choice("abc ") for _ in range(60))
    made = lambda k: "".join(rng.choice("abc é") for _ in range(k))
    data = [(k, made(30) + (passage[: 20 + k] if k % 2 else "") + made(20)) for k in range(12)]
    data += [(50, None), (51, ""), (52, "z" * 70), (53, passage), (53, passage), (None, passage[5:40])]
    got = repeated_bytes_by_order(spark.createDataFrame(data, SCHEMA).repartition(3), length=24, alone=100)
    assert collections.Counter(tuple(r) for r in got.collect()) == brute.byte_repeats(data, 24)
    assert repeated_bytes_by_order(spark.createDataFrame([], SCHEMA)).isEmpty()
