"""A positional index over titles, abstracts and keywords: terms, phrases, patterns and NEAR without scanning texts.

Four tables, each in a folder a publication year, so a year can be indexed again by itself:

* ``documents``: ids by block (a hash of the id, about ``block_docs`` works) and place in it;
* ``postings``: for a token and block its occurrences, sorted: place, field and position in one integer, the number of the
  word it stands in, and what is beside it.  Rows lie in order of their token, integers delta-packed by the file format,
  so a lookup reads the row groups of its tokens.  A frequent token is a row a block (several in a block of very long texts);
* ``terms``: the tokens of a year; ``grams``: their runs of three characters, with ``^`` and ``$`` for the ends, in order of
  the run inside each file.  A pattern becomes an intersection of runs, proved on the terms, so its cost follows the vocabulary.

A token is a run of ASCII letters and digits and of anything beyond ASCII, with ASCII capitals lowered.  Searches give the
rows of ``search.term``, ``phrase``, ``wildcard`` and ``near`` on the same works.  What positions prove (plain words, phrases
of plain words, one or two parts with ``*``, NEAR of plain words) isn't looked up in the texts; for everything else the index
names candidates, and the condition itself is asked of these works alone.  A search without any token asks all works.

Works of the null year, null ids and null texts: a null id is not indexed; a null year has a folder of its own; a null text
has no tokens.  Rows that share an id are documents of their own; their id is given once.
"""

from __future__ import annotations

import bisect
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import search

TITLE, ABSTRACT, KEYWORDS = "title", "abstract", "keywords"
# What is beside an occurrence.
FIRST, LAST, SPACED, AFTER_LINE, BEFORE_LINE = 1, 2, 4, 8, 16

_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLAIN = re.compile(r"[0-9a-z]+")
_RUN = re.compile(r"[0-9a-z\x80-\U0010FFFF]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_YEAR = "publication_year"


def _tokenize(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of rows of text: the tokens, their row, position in it, number of the blank-separated word, and surroundings."""
    edge = np.concatenate([[32], data, [32]]).astype(np.uint8)
    first, last = np.zeros(len(data), bool), np.zeros(len(data), bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = True
    before, after = np.where(first, 32, edge[:-2]), np.where(last, 32, edge[2:])
    held = _TOKEN[data]
    begin, end = np.flatnonzero(held & ~_TOKEN[before]), np.flatnonzero(held & ~_TOKEN[after])
    words = np.cumsum(~_BLANK[data] & _BLANK[before])
    row = np.searchsorted(offsets, begin, "right") - 1
    place = np.arange(len(begin)) - np.searchsorted(begin, offsets)[row]
    start = np.append(0, words)[offsets[row]]
    follow = np.minimum(end + 2, len(data) - 1) if len(data) else end
    spaced = (after[end] == 32) & ~last[end] & (end + 2 < offsets[row + 1]) & held[follow]
    beside = FIRST * _BLANK[before[begin]] + LAST * _BLANK[after[end]] + SPACED * spaced + AFTER_LINE * (before[begin] == 95) + BEFORE_LINE * (after[end] == 95)
    cut = np.append(0, np.cumsum(end - begin + 1)).astype(np.int64)
    found = pa.LargeStringArray.from_buffers(len(begin), pa.py_buffer(cut), pa.py_buffer(_LOWER[data[held]]))
    return found, row, place, words[begin] - start, beside


def _bounds(named: DataFrame, width: int) -> list[str]:
    """Tokens that cut the tokens of texts into about ``width`` ranges of like size.  A few hundred works tell them; they decide
    only which rows lie in one file."""
    words = F.explode(F.split(F.lower(F.concat_ws(" ", F.slice("fields", 1, 2))), "[^0-9a-z]+"))
    few = named.limit(400).select(F.array(F.substring(F.col("fields")[0], 1, 2000), F.substring(F.col("fields")[1], 1, 2000)).alias("fields"))
    found = sorted(r[0] for r in few.select(words).collect())
    return sorted({found[k * len(found) // width] for k in range(1, width)}) if found else []


def _lists(bounds: list[str], spans: dict[int, tuple[float, float]], year: int, block: int, terms: pa.Array, at: np.ndarray, word: np.ndarray, beside: np.ndarray) -> pa.RecordBatch:
    """Occurrences of one block, sorted by ``at``, as a row a token."""
    coded = terms.dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    known = len(coded.dictionary)
    ends = pa.array(np.searchsorted(codes[order], np.arange(known + 1)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(c[order].astype(kind))) for c, kind in ((at, np.int64), (word, np.int32), (beside, np.int32))]
    same = [pa.array(np.full(known, v, np.int32)) for v in (year, block)]
    first, share = spans[year]
    ranges = pa.array([int(first + share * bisect.bisect_right(bounds, x) / (len(bounds) + 1)) for x in coded.dictionary.to_pylist()], pa.int32())
    return pa.RecordBatch.from_arrays([same[0], coded.dictionary.cast(pa.string()), same[1], *lists, ranges], names=[_YEAR, "term", "block", *_PLACES, "range"])


def _postings(texts: DataFrame, bounds: list[str], spans: dict[int, tuple[float, float]], most: int = 1 << 21) -> DataFrame:
    """The postings of ``texts`` (year, block, place, field, text), whose rows come block by block and in order of place and field.

    ``spans`` has the first partition of each year and how many are its own, in which ``bounds`` cut the tokens.  A row a token and block, made where the texts lie, so that lists move and not occurrences.  From ``most`` occurrences
    on a block is given in parts, and a token of it may have several rows.
    """

    def run(batches):
        held, here, size = [], None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(4).cast(pa.large_string())
            _, offsets, data = column.buffers()
            ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
            raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
            years, blocks, places, fields = (batch.column(k).to_numpy() for k in range(4))
            new = np.flatnonzero((np.diff(years) != 0) | (np.diff(blocks) != 0)) + 1
            for begin, end in zip([0, *new], [*new, len(years)]):
                if here != (years[begin], blocks[begin]) or size >= most:
                    if size:
                        yield _lists(bounds, spans, *here, *map(_joined, zip(*held)))
                    held, here, size = [], (years[begin], blocks[begin]), 0
                first, last = ends[begin] - ends[0], ends[end] - ends[0]
                term, row, position, word, beside = _tokenize(raw[first:last], ends[begin : end + 1] - ends[begin])
                row = row + begin
                at = (places[row].astype(np.int64) << 48) | (fields[row].astype(np.int64) << 32) | position
                held.append((term, at, word, beside))
                size += len(at)
        if size:
            yield _lists(bounds, spans, *here, *map(_joined, zip(*held)))

    return texts.mapInArrow(run, f"{_YEAR} int, term string, block int, at array<long>, word array<int>, beside array<int>, range int")


def _joined(parts):
    return pa.concat_arrays(parts) if isinstance(parts[0], pa.Array) else np.concatenate(parts)


def _write(dealt: DataFrame, path: str, order: list[str], row_group_bytes: int) -> None:
    """In order inside the folder of each year; the second version of the format codes integers as differences."""
    writer = dealt.sortWithinPartitions(_YEAR, *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_YEAR)
    for key, value in (("compression", "zstd"), ("parquet.writer.version", "v2"), ("parquet.enable.dictionary", "false"), ("parquet.block.size", row_group_bytes)):
        writer = writer.option(key, value)
    writer.parquet(path)


def write_index(works: DataFrame, path: str, block_docs: int = 2048, row_group_bytes: int = 8 << 20) -> None:
    """Index ``works`` under ``path``.  Folders of the years that ``works`` has are replaced, others stay."""
    plain = lambda c: F.coalesce(F.col(c), F.lit(""))
    fields = F.array(plain(TITLE), plain(ABSTRACT))
    if KEYWORDS in works.columns:
        fields = F.concat(fields, F.transform(F.coalesce(F.col(KEYWORDS), F.array().cast("array<string>")), lambda k: F.coalesce(k, F.lit(""))))
    named = works.where(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id"), F.coalesce(F.col(_YEAR).cast("int"), F.lit(-1)).alias(_YEAR), fields.alias("fields"))
    blocks = named.groupBy(_YEAR).agg(F.ceil(F.count(F.lit(1)) / block_docs).cast("long").alias("blocks"))  # a row a year
    blocked = named.join(F.broadcast(blocks), _YEAR).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    in_block = Window.partitionBy(_YEAR, "block").orderBy("id")
    placed = blocked.withColumn("place", F.row_number().over(in_block) - 1)  # rows of one id may change places: it is the same id
    ids = placed.groupBy(_YEAR, "block").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("found"))
    _write(ids.select(_YEAR, "block", F.col("found.id").alias("ids")).repartitionByRange(_YEAR, "block"), f"{path}/documents", ["block"], row_group_bytes)

    texts = placed.select(_YEAR, "block", "place", F.posexplode("fields").alias("field", "text"))
    # Ranges of tokens are few enough to be dealt evenly, and known before the texts are cut: asking for a range partition
    # would cut them twice.
    width = int(works.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    years = blocks.orderBy(_YEAR).collect()
    spans, whole, before = {}, sum(r["blocks"] for r in years), 0
    for r in years:
        spans[r[_YEAR]] = (width * before / whole, width * r["blocks"] / whole)
        before += r["blocks"]
    found = _postings(texts, _bounds(named, 4 * width), spans)
    _write(found.repartitionById(width, F.col("range")).drop("range"), f"{path}/postings", ["term", "block"], row_group_bytes)

    read = lambda t: works.sparkSession.read.schema(f"{_TABLES[t]}, {_YEAR} int").parquet(f"{path}/{t}").join(F.broadcast(blocks), _YEAR, "left_semi")
    _write(read("postings").groupBy(_YEAR, "term").agg(F.sum(F.size("at")).alias("occurrences")), f"{path}/terms", ["term"], row_group_bytes)
    ended = F.concat(F.lit("^"), "term", F.lit("$"))
    runs = F.transform(F.sequence(F.lit(1), F.length(ended) - 2), lambda k: F.substring(ended, k, F.lit(3)))
    # A file has the runs of the tokens it was given: a run is looked up in a row group of each file, and none moves.
    _write(read("terms").select(_YEAR, F.explode(F.array_distinct(runs)).alias("gram"), "term"), f"{path}/grams", ["gram", "term"], row_group_bytes)


_PLACES = ("at", "word", "beside")
_TABLES = {
    "documents": "block int, ids array<string>",
    "postings": "term string, block int, at array<long>, word array<int>, beside array<int>",
    "terms": "term string, occurrences long",
    "grams": "gram string, term string",
}
_FIELD = {TITLE: lambda f: f == 0, ABSTRACT: lambda f: f == 1, KEYWORDS: lambda f: f >= 2}
_DOCUMENT = [_YEAR, "block", "place"]
_IN_FIELD = [_YEAR, "block", "line"]


class TextIndex:
    """Searches over an index and the works it was written from; each gives the ids of the works."""

    def __init__(self, spark: SparkSession, path: str, works: DataFrame, literal_terms: int = 64):
        self.works, self.literal_terms = works, literal_terms
        self.documents, self.postings, self.terms, self.grams = (spark.read.schema(f"{c}, {_YEAR} int").parquet(f"{path}/{t}") for t, c in _TABLES.items())

    # --- the dictionary ---

    def tokens(self, part: str, start: bool = False, end: bool = False) -> DataFrame:
        """Tokens that have ``part``, at their start or end if so asked, by year."""
        if start and end:
            return self.terms.where(F.col("term") == part).select(_YEAR, "term")
        ended = "^" * start + part + "$" * end
        runs = sorted({ended[k : k + 3] for k in range(len(ended) - 2)})
        if runs:
            known = self.grams.where(F.col("gram").isin(runs)).groupBy(_YEAR, "term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(runs))
        else:
            known = self.terms
        test = F.startswith if start else F.endswith if end else F.contains
        return known.where(test(F.col("term"), F.lit(part))).select(_YEAR, "term")

    def matching(self, pattern: str, part: str) -> DataFrame:
        """Tokens that have ``part`` and in which a regular expression is found."""
        return self.tokens(part).where(F.rlike("term", F.lit(pattern)))

    # --- postings ---

    def occurrences(self, pieces: list[DataFrame], columns) -> DataFrame:
        """Occurrences of the tokens of each piece (numbered from 0) in the fields: document, ``line`` (document and field), position."""
        wanted = functools.reduce(DataFrame.unionByName, [p.withColumn("piece", F.lit(k)) for k, p in enumerate(pieces)])
        few = [r["term"] for r in wanted.select("term").distinct().limit(self.literal_terms + 1).collect()]
        rows = self.postings
        if len(few) <= self.literal_terms:  # else the join with the dictionary decides alone
            rows = rows.where(F.col("term").isin(few)) if few else rows.where(F.lit(False))
        met = rows.join(wanted, [_YEAR, "term"])
        each = met.select(_YEAR, "block", "piece", "term", F.explode(F.arrays_zip(*_PLACES)).alias("o")).select(_YEAR, "block", "piece", "term", "o.*")
        field = F.shiftright("at", 32).bitwiseAND(F.lit(0xFFFF))
        inside = functools.reduce(lambda a, b: a | b, [_FIELD[c](field) for c in columns])
        return each.where(inside).select(
            _YEAR, "block", "piece", "term", F.shiftright("at", 48).alias("place"), F.shiftright("at", 32).alias("line"), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).alias("position"), "word", "beside"
        )

    def ids(self, documents: DataFrame) -> DataFrame:
        """The ids of documents given by year, block and place."""
        places = documents.select(*_DOCUMENT).distinct()
        return places.join(self.documents, [_YEAR, "block"]).select(F.get("ids", F.col("place").cast("int")).alias("id")).distinct()

    def _all_of(self, pieces: list[DataFrame], columns) -> DataFrame:
        """Documents that have an occurrence of every piece in one field."""
        found = self.occurrences(pieces, columns).groupBy(*_IN_FIELD).agg(F.min("place").alias("place"), F.count_distinct("piece").alias("n"))
        return found.where(F.col("n") == len(pieces))

    def _verified(self, documents: DataFrame | None, condition: Column) -> DataFrame:
        works = self.works if documents is None else self.works.join(self.ids(documents), "id", "left_semi")
        return works.where(condition & F.col("id").isNotNull()).select("id").distinct()

    def _parts(self, text: str, columns) -> DataFrame | None:
        """Documents with every run of token characters of ``text`` somewhere in tokens of one field."""
        runs = list(dict.fromkeys(_RUN.findall(text.translate(_LOW))))
        runs = [r for r in runs if r.isascii()]  # other letters have more than one case
        return self._all_of([self.tokens(r) for r in runs], columns) if runs else None

    # --- searches ---

    def term(self, word: str, columns=search.TOPIC) -> DataFrame:
        if re.search(r"\s", word):
            return self.phrase(word, columns)
        if re.search(r"[*?]", word):
            return self.wildcard(word, columns)
        low = word.translate(_LOW)
        if _PLAIN.fullmatch(low):
            return self.ids(self.occurrences([self.tokens(low, start=True, end=True)], columns))
        return self._verified(self._parts(word, columns), search.term(word, columns))

    def phrase(self, text: str, columns=search.TOPIC) -> DataFrame:
        words = text.translate(_LOW).split(" ")
        if not all(_PLAIN.fullmatch(w) for w in words):
            return self._verified(self._parts(text, columns), search.phrase(text, columns))
        last = len(words) - 1
        pieces = [self.tokens(w, start=k > 0, end=k < last) for k, w in enumerate(words)]
        found = self.occurrences(pieces, columns)
        spaced = (F.col("piece") == last) | (F.col("beside").bitwiseAND(F.lit(SPACED)) > 0)
        begun = found.where(spaced).withColumn("first", F.col("position") - F.col("piece"))
        runs = begun.groupBy(*_IN_FIELD, "first").agg(F.min("place").alias("place"), F.count_distinct("piece").alias("n"))
        return self.ids(runs.where(F.col("n") == len(words)))

    def wildcard(self, word: str, columns=search.TOPIC) -> DataFrame:
        low = word.translate(_LOW)
        parts = [p for p in low.split("*") if p]
        anchored = len(re.split(r"[*?]", low, maxsplit=1)[0]) < 3
        if anchored or not parts or len(parts) > 2 or not all(_PLAIN.fullmatch(p) for p in parts):
            return self._verified(self._parts(word, columns), search.wildcard(word, columns))
        if len(parts) == 1:
            return self.ids(self.occurrences([self.tokens(parts[0])], columns))
        found = self.occurrences([self.tokens(p) for p in parts], columns)
        at = lambda k: F.when(F.col("piece") == k, F.col("position"))
        both = F.col("term").rlike(f"{parts[0]}.*{parts[1]}")
        ordered = found.groupBy(*_IN_FIELD).agg(F.min("place").alias("place"), F.min(at(0)).alias("a"), F.max(at(1)).alias("b"), F.bool_or(both).alias("both"))
        return self.ids(ordered.where(F.col("both") | (F.col("a") < F.col("b"))))

    def near(self, left, right, distance: int, columns=(TITLE, ABSTRACT)) -> DataFrame:
        sides = [[o.translate(_LOW) for o in ([s] if isinstance(s, str) else s)] for s in (left, right)]
        if not all(_PLAIN.fullmatch(o) for side in sides for o in side):
            candidates = None
            for side in sides:  # a side may be any of its options
                held = [self._parts(o, columns) for o in side]
                if all(h is not None for h in held):
                    places = functools.reduce(DataFrame.unionByName, [h.select(*_DOCUMENT) for h in held])
                    candidates = places if candidates is None else candidates.join(places, _DOCUMENT, "left_semi")
            return self._verified(candidates, search.near(left, right, distance, columns))
        # A token may have other letters before or behind the word, which is a whole one for ASCII's eyes.
        pieces = [functools.reduce(DataFrame.unionByName, [self.matching(f"(^|[^0-9a-z]){o}([^0-9a-z]|$)", o) for o in side]).distinct() for side in sides]
        options = ["(?:" + "|".join(side) + ")" for side in sides]
        has = lambda flag: F.col("beside").bitwiseAND(F.lit(flag)) > 0
        # On the left a word ends before a blank, on the right it begins behind one.
        ends, begins = F.lit(False), F.lit(False)
        for k, option in enumerate(options):
            own = F.col("piece") == k
            ends = ends | (own & F.rlike("term", F.lit(f"(^|[^0-9a-z]){option}$")) & has(LAST) & (F.rlike("term", F.lit(f"[^0-9a-z]{option}$")) | ~has(AFTER_LINE)))
            begins = begins | (own & F.rlike("term", F.lit(f"^{option}([^0-9a-z]|$)")) & has(FIRST) & (F.rlike("term", F.lit(f"^{option}[^0-9a-z]")) | ~has(BEFORE_LINE)))
        found = self.occurrences(pieces, columns).withColumn("ends", ends).withColumn("begins", begins)
        before = Window.partitionBy(*_IN_FIELD).orderBy("word").rangeBetween(Window.unboundedPreceding, -1)
        for k in (0, 1):
            found = found.withColumn(f"before{k}", F.max(F.when((F.col("piece") == k) & F.col("ends"), F.col("word"))).over(before))
        other = F.when(F.col("piece") == 0, F.col("before1")).otherwise(F.col("before0"))
        return self.ids(found.where(F.col("begins") & (F.col("word") - other <= distance + 1)))
