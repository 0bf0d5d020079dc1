"""Source divergence audit: how far the word distributions of a language's sources lie apart, exactly.

A term is a run of letters (ASCII letters and everything beyond ASCII), ASCII lower-cased.  A language keeps the terms
that stand in at least ``min_docs`` of its documents.  A group (language, source) gives each kept term the integer weight
p = 1 + floor(unit * (count + prior) / (N + prior * V)); two sources differ by the sum of |p - q| over all V kept terms.

*Baseline correction.*  Most terms are missing in most groups.  A pair starts at V * |z - y|, the difference of two groups'
weights at count zero, and the inverted index corrects it where a term occurs: what a term occurring in g adds against a
source without it depends on p alone, so it is summed over the histogram of g's weights; where g and h share a posting,
the four-point difference |p-q| - |p-y| - |q-z| + |z-y| is added.  Terms that neither has cost nothing.

*Skew.*  Counts are combined in the tasks before they move.  A posting list has an entry for each source; it is cut into
blocks of ``block`` sources, and blocks meet pairwise, each pair in a row of its own.  Pairs of a language are
salted by source.  Ranks of terms go through Spark's group limit, so a task sends its first ``top`` ones only.

Defined cases: null text, language or source is the empty string (and joins the group of that name); a document without
terms still makes its group occur; a language without kept terms has pairs of value 0 and no terms; repeated rows are
documents of their own; a text of any length is read whole; ties rank by the item's UTF-8 bytes; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import Scratch
from .textkit import LOWER, row_slices, text_buffers

SALTS = 16
SLICE = 16 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of a slice, as one array in order of the texts, and how many each row has."""
    inside = _LETTER[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    start[at] = inside[at]
    begins = np.flatnonzero(start)
    ends = np.append(np.flatnonzero(start[inside]), np.count_nonzero(inside))
    letters = LOWER[data[inside]]
    found = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(letters))
    return found.dictionary_encode(), np.diff(np.searchsorted(begins, offsets))


def _counts(group: np.ndarray, data: np.ndarray, offsets: np.ndarray):
    """Group, term, occurrences and documents of a slice of rows, each pair of group and term once."""
    terms, per_row = _terms(data, offsets)
    width = max(len(terms.dictionary), 1)
    row = np.repeat(np.arange(len(per_row)), per_row)
    in_row = np.sort(row * width + terms.indices.to_numpy())
    first = np.flatnonzero(np.diff(in_row, prepend=-1))
    times = np.diff(first, append=len(in_row))
    of_group = group[in_row[first] // width] * width + in_row[first] % width
    order = np.argsort(of_group, kind="stable")
    key = of_group[order]
    lead = np.flatnonzero(np.diff(key, prepend=-1))
    if not len(key):
        return key, terms.dictionary, key, key, key
    return key[lead] // width, terms.dictionary, key[lead] % width, np.add.reduceat(times[order], lead), np.diff(lead, append=len(key))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, count, df``: occurrences and documents of each term in each group; a group's row of null term says that it occurs."""
    named = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(f"_{k}") for k, c in enumerate((text_col, lang_col, source_col))])

    def count(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            langs, sources = batch.column(1).dictionary_encode(), batch.column(2).dictionary_encode()
            wide = len(sources.dictionary)
            group = langs.indices.to_numpy().astype(np.int64) * wide + sources.indices.to_numpy()
            named = lambda g: [langs.dictionary.take(pa.array(g // wide)), sources.dictionary.take(pa.array(g % wide))]
            there = np.unique(group)
            none = np.zeros(len(there), np.int64)
            yield pa.RecordBatch.from_arrays([*named(there), pa.nulls(len(there), pa.string()), pa.array(none), pa.array(none)], names=names)
            data, offsets = text_buffers(batch.column(0))
            for i, j in row_slices(offsets, SLICE):
                g, dictionary, term, times, rows = _counts(group[i:j], data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([*named(g), dictionary.take(pa.array(term)).cast(pa.string()), pa.array(times), pa.array(rows)], names=names)

    names = ["lang", "source", "term", "count", "df"]
    found = named.mapInArrow(count, "lang string, source string, term string, count long, df long")
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("df").alias("df"))


def _weight(count: str, total: str, terms: str, unit: int, prior: int) -> F.Column:
    """1 + floor(unit * (count + prior) / (total + prior * terms)), in decimals that can't overflow; null without terms."""
    above = f"cast({unit} as decimal(12,0)) * cast({count} + {prior} as decimal(20,0))"
    return F.expr(f"if({terms} > 0, 1 + ({above}) div cast({total} + {prior} * {terms} as decimal(20,0)), null)")


def _shared_postings(cells: DataFrame, block: int) -> DataFrame:
    """``lang_id, a, b, value``: the four-point differences of sources that share a posting, a < b, summed in the tasks."""
    most = F.floor((F.col("sources") - 1) / block)
    other = F.explode(F.sequence(F.lit(0).cast("long"), most.cast("long")))
    met = cells.withColumn("_own", F.floor(F.col("gid") / block)).withColumn("_other", other)
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    lists = met.groupBy("lang", "term", low.alias("_low"), high.alias("_high")).agg(
        F.first("lang_id").alias("lang_id"), F.collect_list(F.struct("gid", "p", "z")).alias("posting")
    )  # at most two blocks of entries
    lists = lists.where(F.size("posting") > 1).select("lang_id", "_low", "_high", "posting")

    def add(batches):
        totals: dict[tuple, np.ndarray] = {}

        def packed():
            for (lang, low, high), total in totals.items():
                a, b = np.nonzero(total)
                of = np.array([low, high])
                gid = lambda k: of[k // block] * block + k % block
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(a), lang, np.int64)), pa.array(gid(a)), pa.array(gid(b)), pa.array(total[a, b])], names=["lang_id", "a", "b", "value"]
                )
            totals.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            lang, low, high = (batch.column(k).to_numpy() for k in range(3))
            posting = batch.column(3)
            size = pc.list_value_length(posting).to_numpy()
            gid, p, z = (posting.flatten().field(k).to_numpy() for k in range(3))
            row = np.repeat(np.arange(len(size)), size)
            for key in {*zip(lang.tolist(), low.tolist(), high.tolist())}:
                own = (lang == key[0]) & (low == key[1]) & (high == key[2])
                at = np.flatnonzero(own[row])
                local = gid[at] - np.where(gid[at] // block == key[1], key[1] * block, (key[2] - 1) * block)
                width = block * (1 + (key[1] != key[2]))
                total = totals.setdefault(key, np.zeros((width, width), np.int64))
                seen = np.unique(local)
                place = np.searchsorted(seen, local)
                line = np.cumsum(own)[row[at]] - 1
                for i, j in _chunks(line, len(seen)):
                    weight = np.full((line[j - 1] - line[i] + 1, len(seen)), -1, np.int64)
                    weight[line[i:j] - line[i], place[i:j]] = p[at[i:j]]
                    zero = np.zeros(len(seen), np.int64)
                    zero[place[i:j]] = z[at[i:j]]
                    for g in range(len(seen)):
                        held = weight[weight[:, g] >= 0]
                        mine, others = held[:, g, None], slice(g + 1, None)
                        theirs = held[:, others]
                        extra = np.abs(mine - theirs) - np.abs(mine - zero[others]) - np.abs(theirs - zero[g]) + np.abs(zero[g] - zero[others])
                        sums = np.where(theirs >= 0, extra, 0).sum(axis=0)
                        if key[1] != key[2]:  # only pairs of unlike blocks: those inside one meet elsewhere
                            sums = np.where(seen[others] // block == seen[g] // block, 0, sums)
                        total[seen[g], seen[others]] += sums
            if sum(t.nbytes for t in totals.values()) > 64 << 20:
                yield from packed()
        yield from packed()

    return lists.mapInArrow(add, "lang_id long, a long, b long, value long")


def _chunks(line: np.ndarray, width: int, cells: int = 4_000_000):
    """Ranges of entries that make at most ``cells`` cells, or one line."""
    if not len(line):
        return
    step = max(cells // max(width, 1), 1)
    bounds = np.searchsorted(line, np.arange(0, line[-1] + 1 + step, step))
    yield from ((int(i), int(j)) for i, j in zip(bounds[:-1], bounds[1:]) if j > i)


def audit_sources(
    docs: DataFrame,
    min_docs: int = 30,
    top: int = 50,
    unit: int = 1_000_000_000,
    prior: int = 5,
    block: int = 256,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """``lang, source, part, item, value, rank``: for each group its other sources (part ``pair``) and its ``top`` terms over the language's weight (part ``term``)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    counts = scratch.write(term_counts(docs, text_col, lang_col, source_col))
    named = counts.where(F.col("term").isNotNull())
    kept = named.groupBy("lang", "term").agg(F.sum("count").alias("lang_count"), F.sum("df").alias("df")).where(F.col("df") >= min_docs).drop("df")
    met = scratch.write(named.drop("df").join(kept, ["lang", "term"]))

    in_lang = met.dropDuplicates(["lang", "term"]).groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_count").alias("lang_total"))
    in_group = met.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    by_lang = Window.partitionBy("lang")
    groups = counts.where(F.col("term").isNull()).select("lang", "source").join(in_group, ["lang", "source"], "left").join(in_lang, "lang", "left")
    groups = groups.na.fill(0, ["terms", "total", "lang_total"]).select(
        "lang",
        "source",
        "terms",
        "total",
        "lang_total",
        F.xxhash64("lang").alias("lang_id"),
        (F.row_number().over(by_lang.orderBy("source")) - 1).cast("long").alias("gid"),
        F.count(F.lit(1)).over(by_lang).alias("sources"),
        _weight("0", "total", "terms", unit, prior).alias("z"),
    )
    groups = scratch.write(groups)
    weighed = met.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "lang_id", "gid", "sources", "z", _weight("count", "total", "terms", unit, prior).alias("p"),
        _weight("lang_count", "lang_total", "terms", unit, prior).alias("q"),
    )
    cells = scratch.write(weighed)

    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    others = groups.select("lang", F.col("gid").alias("other"), F.col("z").alias("y"), salt.alias("_salt"))
    own = groups.select("lang", "lang_id", "gid", "z", "terms", (F.col("gid") % SALTS).cast("int").alias("_salt"))
    pair = [F.col("lang_id"), F.least("gid", "other").alias("a"), F.greatest("gid", "other").alias("b")]
    start = own.join(others, ["lang", "_salt"]).where("gid < other").select(*pair, F.coalesce(F.col("terms") * F.abs(F.col("z") - F.col("y")), F.lit(0).cast("long")).alias("value"))
    histogram = cells.groupBy("lang", "lang_id", "gid", "z", "p").agg(F.count(F.lit(1)).alias("n")).withColumn("_salt", F.pmod(F.xxhash64("gid", "p"), F.lit(SALTS)).cast("int"))
    alone = histogram.join(others, ["lang", "_salt"]).where("gid <> other")
    alone = alone.select(*pair, (F.col("n") * (F.abs(F.col("p") - F.col("y")) - F.abs(F.col("z") - F.col("y")))).alias("value"))
    values = start.unionByName(alone).unionByName(_shared_postings(cells, block)).groupBy("lang_id", "a", "b").agg(F.sum("value").alias("value"))

    name = lambda k: groups.select("lang_id", F.col("gid").alias(k), F.col("source").alias(f"{k}_source"))
    sided = values.join(name("a"), ["lang_id", "a"]).join(name("b"), ["lang_id", "b"]).join(groups.select("lang", "lang_id").distinct(), "lang_id")
    both = F.explode(F.array(F.struct(F.col("a_source").alias("source"), F.col("b_source").alias("item")), F.struct(F.col("b_source").alias("source"), F.col("a_source").alias("item"))))
    pairs = sided.select("lang", "value", both.alias("_side")).select("lang", "_side.source", F.lit("pair").alias("part"), "_side.item", "value")
    terms = cells.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionByName(ranked(terms).where(F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
