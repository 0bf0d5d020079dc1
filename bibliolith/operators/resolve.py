"""Identifier resolution: PMID, then DOI, then similar titles, each stage for what the last one left."""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import doi_key

WIDTH = 0.21  # of a class of lengths, in logarithms: two are a bit more than half as many letters again


def plain_title(column: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(column, "<[^>]+>", " "), r"[^a-zA-Z0-9\s]", " ")
    return F.trim(F.regexp_replace(F.lower(bare), r"\s+", " "))


def _word_test(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    both = F.size(F.array_intersect(x, y))
    jaccard = both / F.size(F.array_union(x, y))
    contained = both / F.least(F.size(x), F.size(y))
    return (contained >= 0.85) & (jaccard >= 0.65)


def _similar_plain(a: Column, b: Column, least: float, by_letters: Column) -> Column:
    by_words = _word_test(a, b)
    asked = ~by_words & by_letters

    @F.pandas_udf("double")
    def matched(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, s, t).ratio() if s and t else 0.0 for s, t in zip(p, q)])

    return (a != "") & (b != "") & (F.when(by_words, 1.0).otherwise(matched(F.when(asked, a), F.when(asked, b))) >= least)


def similar_titles(left: Column, right: Column, least: float = 0.80) -> Column:
    """Alike letter by letter, or nearly one's words within the other's.

    The word test is native; only pairs that fail it reach the Arrow-batched sequence matcher.
    """
    return _similar_plain(plain_title(left), plain_title(right), least, F.lit(True))


def _letters(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of all texts one after another, the number of each one's text, and the lengths."""
    sizes = np.array([len(x) for x in texts])
    return np.frombuffer(b"".join(texts), np.uint8), np.repeat(np.arange(len(texts)), sizes), sizes


def _numbered(rows: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and codes in their order, and how many equal ones stand before each."""
    order = np.lexsort((codes, rows))
    rows, codes = rows[order], codes[order]
    starts = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])]) if len(rows) else np.zeros(0, np.int64)
    return rows, codes, np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))


def _counts(texts: list[bytes], q: int, dims: int) -> np.ndarray:
    """Numbered q-grams of each text, counted in ``dims`` bins: products of rows are never under the common q-grams."""
    letters, rows, sizes = _letters(texts)
    many = len(letters) - q + 1
    if many <= 0:
        return np.zeros((len(texts), dims), np.float32)
    grams = np.zeros(many, np.uint64)
    for i in range(q):
        grams |= letters[i : many + i].astype(np.uint64) << np.uint64(8 * i)
    inside = rows[:many] == rows[q - 1 :]
    rows, grams, nth = _numbered(rows[:many][inside], grams[inside])
    mixed = (grams * np.uint64(64_000_001) + nth.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    bins = (mixed >> np.uint64(40)).astype(np.int64) % dims
    return np.bincount(rows * dims + bins, minlength=len(texts) * dims).astype(np.float32).reshape(len(texts), dims)


def _rare_letters(texts: list[bytes], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbered letters of each text, ``most`` of one letter: all of them, and those that the matcher calls rare.

    Products of rows of the first with rows of the second are the common letters that are rare in the second text.
    """
    letters, rows, sizes = _letters(texts)
    rows, codes, nth = _numbered(rows, letters)
    held = np.bincount(rows * 128 + codes, minlength=len(texts) * 128).reshape(len(texts), 128)
    rare = held[rows, codes] <= sizes[rows] // 100 + 1
    out = []
    for taken in (nth < most, rare & (nth < most)):
        table = np.zeros((len(texts), 128 * most), np.float32)
        table[rows[taken], codes[taken].astype(np.int64) * most + nth[taken]] = 1
        out.append(table[:, [c * most + k for c in b" 0123456789abcdefghijklmnopqrstuvwxyz" for k in range(most)]])
    return out[0], out[1]


def _common_order(a: list[bytes], b: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of pairs of texts, given by their numbers; 64 letters a machine word."""
    known = np.unique(np.frombuffer(b"".join(a), np.uint8))
    code = np.full(256, len(known), np.int64)
    code[known] = np.arange(len(known))
    size = np.array([len(x) for x in a])
    words = int(-(-size.max() // 64))
    masks = np.zeros((len(a), len(known) + 1, words), np.uint64)
    for k, text in enumerate(a):
        at = np.arange(len(text))
        np.bitwise_or.at(masks[k], (code[np.frombuffer(text, np.uint8)], at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    steps = max(len(x) for x in b)
    letters = np.full((steps, len(b)), len(known), np.int64)
    for k, text in enumerate(b):
        letters[: len(text), k] = code[np.frombuffer(text, np.uint8)]
    out = np.zeros(len(left), np.int64)
    batch = max(64, (1 << 16) // words)
    for start in range(0, len(left), batch):
        i, j = left[start : start + batch], right[start : start + batch]
        free = [np.full(len(i), ~np.uint64(0)) for _ in range(words)]
        for step in range(steps):
            met = masks[i, letters[step, j]]
            carry = np.zeros(len(i), np.uint64)
            for w in range(words):
                taken = free[w] & met[:, w]
                part = free[w] + taken
                whole = part + carry
                carry = ((part < taken) | (whole < part)).astype(np.uint64)
                free[w] = whole | (free[w] - taken)
        out[start : start + batch] = sum(np.bitwise_count(~x).astype(np.int64) for x in free)
    return out


def _common_order_of_all(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Lengths of the longest common subsequences of each of some texts with each of others, as ``_common_order`` of all pairs."""
    letters, rows, sizes = _letters(a)
    at = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    words = int(-(-sizes.max() // 64))
    masks = np.zeros((words, 129, len(a)), np.uint64)  # the last one is no letter
    np.bitwise_or.at(masks, (at >> 6, letters, rows), np.uint64(1) << (at & 63).astype(np.uint64))
    out = np.zeros((len(a), len(b)), np.int64)
    batch = max(1, (1 << 15) // len(a))
    for start in range(0, len(b), batch):
        texts = b[start : start + batch]
        codes = np.full((max(map(len, texts)), len(texts)), 128, np.int64)
        for k, text in enumerate(texts):
            codes[: len(text), k] = np.frombuffer(text, np.uint8)
        free = [np.full((len(texts), len(a)), ~np.uint64(0)) for _ in range(words)]
        met, part = np.empty_like(free[0]), np.empty_like(free[0])
        for letter in codes:
            carry = None
            for w in range(words):
                np.take(masks[w], letter, axis=0, out=met, mode="clip")
                np.bitwise_and(free[w], met, out=met)
                np.add(free[w], met, out=part)
                over = part < met if w + 1 < words else None
                if carry is not None:
                    part += carry
                    if over is not None:
                        over |= part < carry
                np.subtract(free[w], met, out=free[w])
                np.bitwise_or(free[w], part, out=free[w])
                carry = over
        out[:, start : start + batch] = sum(np.bitwise_count(~x).astype(np.int64) for x in free).T
    return out


def _tiles(texts: list[bytes], rows: int, dims: int, most: int) -> list[tuple]:
    """Texts in order of length, some at a time: with their lengths, q-grams and, where the matcher goes by them, rare letters."""
    out = []
    for k in range(0, len(texts), rows):
        part = texts[k : k + rows]
        sizes = np.array([len(x) for x in part])
        grams = {q: _counts(part, q, dims) for q in ((1, 2, 4, 8) if most else (1, 2))}
        out.append((part, sizes, grams, _rare_letters(part, most) if most else None))
    return out


def _may_be_near(one: tuple, other: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of two tiles can reach the ratio: with the other's text second, and with the one's."""
    (_, n, grams, letters), (_, m, others, other_letters) = one, other
    total = n[:, None] + m[None, :]
    least = -(-2 * total // 5)
    blocks = [total - 2 * least + 1] * 2
    if letters and max(n[-1], m[-1]) >= 200:
        blocks[0] = np.where(m[None, :] < 200, blocks[0], np.minimum(blocks[0], 1 + letters[0] @ other_letters[1].T))
        blocks[1] = np.where(n[:, None] < 200, blocks[1], np.minimum(blocks[1], 1 + letters[1] @ other_letters[0].T))
    possible = [np.minimum(n[:, None], m[None, :]) >= least] * 2
    for q in grams:
        if not (possible[0].any() or possible[1].any()):
            break
        common = grams[q] @ others[q].T
        possible = [ok & (common >= least - k * (q - 1)) for ok, k in zip(possible, blocks)]
    return possible[0], possible[1]


def _near_by_letters(left: pa.Table, right: pa.Table) -> pa.Table:
    """Pairs of two blocks of titles that have enough letters in one order for a ratio of 0.80, in both directions.

    The ratio needs ``m = 2 (|a| + |b|) / 5`` letters in at most ``|a| + |b| - 2 m + 1`` blocks, and a block of n letters
    has n - q + 1 common q-grams: counts of 1-, 2-, 4- and 8-grams tell that of all pairs.  From 200 letters of the second
    text on, the matcher starts at rare letters alone: each block but the first has a common one of its own, so that blocks
    are few and long.  The blocks are a common subsequence, whose longest length is found for what is left.
    """
    titles = [sorted(zip((x.encode() for x in t["title"].to_pylist()), t["hash"].to_pylist()), key=lambda x: len(x[0])) for t in (left, right)]
    a, b = ([x for x, _ in t] for t in titles)
    names, other_names = (np.array([h for _, h in t], np.int64) for t in titles)
    longest = max(len(a[-1]), len(b[-1])) if a and b else 0
    most = longest // 100 + 1 if longest >= 200 else 0
    dims = max(2048, 1 << (4 * longest - 1).bit_length())
    rows = max(8, min(512, (1 << 20) // dims))
    found: list[tuple[np.ndarray, np.ndarray]] = [(names[:0], names[:0])]
    others = _tiles(b, rows, dims, most) if a else []
    for k, one in enumerate(_tiles(a, rows, dims, most) if b else []):
        for l, other in enumerate(others):
            (texts, n, *_), (other_texts, m, *_) = one, other
            if 3 * m[-1] < 2 * n[0] or 3 * n[-1] < 2 * m[0]:
                continue
            forth, back = _may_be_near(one, other)
            i, j = np.nonzero(forth | back)
            if not len(i):
                continue
            total = n[i] + m[j]
            least = -(-2 * total // 5)
            short = total < 600
            if 4 * short.sum() > len(n) * len(m):
                common = _common_order_of_all(texts, other_texts)[i, j]
                kept = ~short | (common >= least)
            else:
                kept = ~short
                some = np.flatnonzero(short)
                some = some[np.argsort(m[j[some]], kind="stable")]
                for part in np.array_split(some, max(1, len(some) // 4096)):  # texts of like length together
                    if len(part):
                        us, first = np.unique(i[part], return_inverse=True)
                        them, second = np.unique(j[part], return_inverse=True)
                        common = _common_order([texts[k] for k in us], [other_texts[k] for k in them], first, second)
                        kept[part] = common >= least[part]
            i, j = i[kept], j[kept]
            x, y = names[k * rows + i], other_names[l * rows + j]
            found += [(x[t], y[t]) for t in (forth[i, j],)] + [(y[t], x[t]) for t in (back[i, j],)]
    return pa.table({"a": np.concatenate([x for x, _ in found]), "b": np.concatenate([y for _, y in found])})


def _blocks(titles: DataFrame, letters: int = 1 << 18, most: int = 2048) -> tuple[DataFrame, DataFrame]:
    """Titles with a class of their length and a block of about ``letters``; and the list of blocks.

    Of titles alike by letters the longer has at most half as many letters more: their classes are two apart at most.
    """
    known = titles.withColumn("k", F.floor(F.log(F.length("title")) / WIDTH).cast("int"))
    rows = F.greatest(F.lit(8.0), F.least(F.lit(float(most)), letters / F.exp((F.col("k") + 1) * WIDTH)))
    many = known.groupBy("k").agg(F.count(F.lit(1)).alias("n")).select("k", F.ceil(F.col("n") / rows).cast("int").alias("n"))
    dealt = known.join(F.broadcast(many), "k").withColumn("i", F.pmod("hash", F.col("n")).cast("int"))
    return dealt.select("k", "i", "title", "hash"), many.select("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))


def _near_by_words(left: DataFrame, right: DataFrame, alone: bool, rows: int = 1000) -> DataFrame:
    """Pairs that share so many of their rarest words that the word test can hold; hot words are salted.

    Of x words a similar title has 65 % at least, so the two share words among the rarest 35 % and one more of each.  All
    others that they share are beyond these in one of the two, so the number found there bounds the number they share.
    """
    words = lambda t: t.select("hash", F.explode(F.array_distinct(F.split("title", " "))).alias("word"))
    often = (words(left) if alone else words(left).unionAll(words(right))).groupBy("word").agg(F.count(F.lit(1)).alias("n"))

    def prefix(t):
        rare = words(t).join(often, "word").groupBy("hash").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("w"))
        taken = F.size("w") - F.floor((F.size("w") * 65 + 99) / 100).cast("int") + 1
        sized = rare.select("hash", F.size("w").alias("size"), taken.alias("taken"), "w")
        picked = sized.select("hash", "size", (F.col("size") - F.col("taken")).alias("rest"), F.explode(F.slice("w", F.lit(1), F.col("taken"))).alias("w"))
        return picked.select("hash", "size", "rest", "w.word", F.ceil(F.col("w.n") / rows).cast("int").alias("salts"))

    one = prefix(left).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    other = prefix(right).withColumn("salt", F.pmod(F.col("hash"), F.col("salts")).cast("int")).drop("salts")
    met = one.toDF("a", "m", "p", "word", "salt").join(other.toDF("b", "n", "q", "word", "salt"), ["word", "salt"])
    met = met.where("100 * least(m, n) >= 65 * greatest(m, n)" + (" and a < b" if alone else ""))
    found = met.groupBy("a", "b", "m", "n", "p", "q").agg(F.count(F.lit(1)).alias("c"))
    return found.where("165 * (c + greatest(p, q)) >= 65 * (m + n) and 20 * (c + greatest(p, q)) >= 17 * least(m, n)").select("a", "b")


def title_pairs(left: DataFrame, right: DataFrame | None = None) -> DataFrame:
    """All pairs ``a``, ``b`` of similar plain titles (column ``title``) of the two tables, or of one with itself.

    Candidates of the word test come from rare words; those of the letter ratio from bounds, block by block
    inside tasks, over the blocks whose lengths allow it.  Neither leaves out a similar pair.  Candidates move as hashes of
    their titles; titles that share one are all tested.
    """
    alone = right is None
    left, right = (t.select("title").where("title <> ''").distinct().withColumn("hash", F.xxhash64("title")) for t in (left, left if alone else right))
    (a, a_blocks), (b, b_blocks) = _blocks(left), _blocks(right)
    cells = a_blocks.join(b_blocks.toDF("l", "j"), F.expr("abs(k - l) <= 2"))
    if alone:  # one of the two directions; pairs come in both
        cells = cells.where("k < l or (k = l and i <= j)")
    a = a.toDF("k1", "i1", "title", "hash").join(cells, F.expr("k = k1 and i = i1")).select("title", "hash", "k", "i", "l", "j")
    b = b.toDF("l1", "j1", "title", "hash").join(cells, F.expr("l = l1 and j = j1")).select("title", "hash", "k", "i", "l", "j")
    b = b.toDF("title", "hash", *(others := ["k2", "i2", "l2", "j2"]))
    # By number: the pairs of a few megabytes are work for all tasks, and would be put into one by their bytes.
    width = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = ["k", "i", "l", "j"]
    a, b = a.repartition(4 * width, *cell), b.repartition(4 * width, *others)
    letters = a.groupBy(*cell).cogroup(b.groupBy(*others)).applyInArrow(_near_by_letters, "a long, b long")
    words = _near_by_words(left, right, alone)
    if alone:
        words = words.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("w")).select("w.*")
        words = words.unionByName(left.select(F.col("hash").alias("a"), F.col("hash").alias("b")))
    # Each way proves its own test, so that what shares only words is not matched letter by letter.
    pairs = letters.withColumn("by_letters", F.lit(True)).unionByName(words.withColumn("by_letters", F.lit(False)))
    pairs = pairs.groupBy("a", "b").agg(F.max("by_letters").alias("by_letters")).toDF("_a", "_b", "by_letters")
    named = pairs.join(left.toDF("a", "_a"), "_a").join(right.toDF("b", "_b"), "_b")
    return named.repartition(width, "_a", "_b").where(_similar_plain(F.col("a"), F.col("b"), 0.80, F.col("by_letters"))).select("a", "b")


def similar_documents(docs: DataFrame) -> DataFrame:
    """``docs`` (id, title) that have another document of a similar title: id, and the least such id."""
    named = docs.select("id", plain_title(F.col("title")).alias("title"))
    ids = named.where("title <> ''").groupBy("title").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    other = ids.select(F.col("title").alias("b"), "low")
    pairs = title_pairs(named).where("a <> b").join(other, "b").groupBy("a").agg(F.min("low").alias("near"))
    own = F.when(F.col("id") != F.col("low"), F.col("low"))
    # The first of a title's documents has the second as its partner.
    second = named.join(ids, "title").where("id <> low").groupBy("title").agg(F.min("id").alias("second"))
    placed = named.join(ids, "title").join(second, "title", "left").join(pairs, F.col("title") == F.col("a"), "left")
    return placed.select("id", F.least("near", F.coalesce(own, F.col("second"))).alias("other")).where("other is not null")


def resolve(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (key, pmid, doi, title) to ``known`` (pmid, doi, title): key, the pmid found and the stage."""
    by_pmid = rows.join(known.select("pmid").distinct(), "pmid").select("key", "pmid", F.lit("pmid").alias("stage"))
    left = rows.join(by_pmid, "key", "left_anti").withColumn("_doi", doi_key(F.col("doi")))
    dois = known.where("coalesce(doi, '') <> ''").groupBy(doi_key(F.col("doi")).alias("_doi")).agg(F.min("pmid").alias("found"))
    by_doi = left.where("_doi <> ''").join(dois, "_doi").select("key", F.col("found").alias("pmid"), F.lit("doi").alias("stage"))
    rest = left.join(by_doi, "key", "left_anti").select("key", plain_title(F.col("title")).alias("title"))
    titles = known.groupBy(plain_title(F.col("title")).alias("title")).agg(F.min("pmid").alias("pmid"))
    best = title_pairs(rest, titles).join(titles.withColumnRenamed("title", "b"), "b").groupBy("a").agg(F.min("pmid").alias("pmid"))
    by_title = rest.join(best, rest.title == best.a).groupBy("key").agg(F.min("pmid").alias("pmid")).select("key", "pmid", F.lit("title").alias("stage"))
    return by_pmid.unionByName(by_doi).unionByName(by_title)


def enrich_by_doi(external: DataFrame, works: DataFrame) -> DataFrame:
    """Works of a list of external DOIs, each once."""
    wanted = external.select(doi_key(F.col("doi")).alias("_wanted")).where("_wanted <> ''").distinct()
    return works.join(wanted, doi_key(works["doi"]) == wanted["_wanted"], "left_semi").dropDuplicates(["id"])
