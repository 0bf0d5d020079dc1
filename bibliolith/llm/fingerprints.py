"""Document fingerprints that can be subtracted: invertible Bloom lookup tables of paragraph digests.

A text is cut into paragraphs by content: after a line feed, after a word that ends a sentence,
and after any word whose hash is a multiple of ``1 / 32``, so that long unpunctuated runs are
cut alike in every version.  Each digest is added to one cell of each of three subtables: a
count, the exclusive or of the keys, and that of their check hashes.  The fingerprint is the
table of ``cells`` cells.

Subtracting two tables cancels what both texts have.  A cell with count one and a matching check
holds one differing digest; taking it out of its other cells frees more, until all differing
digests are recovered.  If that gets stuck, the tables were too small, and the comparison is
repeated with four times the cells.  The likeness is the Jaccard coefficient that follows from
the number of recovered digests and the two counts.

Defined cases: a null text is the empty text; two texts without words are alike (1.0), one of
them and a text with words are not (0.0); a paragraph that occurs k times is k different
entries; equal ids follow each other in the order of their texts; null ids come last; the
document after the last one is the first, which in a table of one row is the row itself.  A very
long text is sketched whole; repeated rows each have a row, with equal fingerprints; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .store import shuffle_width
from .textkit import Words, mix, word_rolling

_ENDS = np.zeros(256, bool)
_ENDS[[33, 46, 63]] = True
_TABLES = 3


def paragraph_keys(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The keys of the paragraphs of every row of a slice; the k-th copy in a row has a key of its own."""
    words = Words(data, offsets)
    if not len(words.start):
        return [np.zeros(0, np.uint64)] * (len(offsets) - 1)
    hashes = words.hashes()
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    last = np.ones(len(hashes), bool)
    last[:-1] = feeds[words.start[1:]] != feeds[words.end[:-1]]
    last |= _ENDS[data[words.end - 1]] | (hashes % np.uint64(32) == 0)
    bounds = words.first[1:][words.count > 0]
    last[bounds - 1] = True
    stop = np.flatnonzero(last) + 1
    start = np.concatenate([[0], stop[:-1]])
    digest = word_rolling(hashes).span(start, stop)
    row = np.searchsorted(words.first, start, "right") - 1
    order = np.lexsort((digest, row))
    head = np.ones(len(order), bool)
    head[1:] = (digest[order[1:]] != digest[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
    first = np.flatnonzero(head)
    turn = np.empty(len(order), np.uint64)
    turn[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    keys = mix(digest + turn * np.uint64(0xC2B2AE3D27D4EB4F))
    return np.split(keys, np.searchsorted(row, np.arange(1, len(offsets) - 1)))


class Sketches:
    """Invertible Bloom lookup tables of 64-bit keys, one for each of ``n`` owners, side by side in one array."""

    def __init__(self, n: int, cells: int):
        self.n, self.width = n, max(cells // _TABLES, 1)
        self.count = np.zeros(n * self.width * _TABLES, np.int32)
        self.key = np.zeros(len(self.count), np.uint64)
        self.check = np.zeros(len(self.count), np.uint64)

    def add(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray) -> "Sketches":
        check = _check(keys)
        for t in range(_TABLES):
            place = (mix(keys + np.uint64((t + 1) * 0x1FB21C651E98DF25)) % np.uint64(self.width)).astype(np.int64)
            at = (owner * _TABLES + t) * self.width + place
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, check)
        return self

    def peel(self) -> np.ndarray:
        """How many keys each table holds, taking them all out; -1 where that gets stuck."""
        found = np.zeros(self.n, np.int64)
        span = self.width * _TABLES
        look = np.arange(len(self.count))
        while True:
            look = look[(np.abs(self.count[look]) == 1) & (self.check[look] == _check(self.key[look]))]
            if not len(look):
                left = (self.count != 0) | (self.key != 0)
                found[left.reshape(self.n, span).any(axis=1)] = -1
                return found
            owner = look // span
            order = np.lexsort((self.key[look], owner))
            look, owner = look[order], owner[order]
            keys = self.key[look]
            new = np.ones(len(look), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            owner, keys, sign = owner[new], keys[new], self.count[look[new]].astype(np.int32)
            self.add(keys, owner, -sign)
            found += np.bincount(owner, minlength=self.n)
            touched = np.unique(owner)
            look = (touched[:, None] * span + np.arange(span)).ravel()

    def texts(self) -> list[str]:
        span = self.width * _TABLES
        parts = [self.count.astype("<i4"), self.key.astype("<u8"), (self.check & np.uint64(0xFFFFFFFF)).astype("<u4")]
        rows = np.concatenate([x.reshape(self.n, span).view(np.uint8).reshape(self.n, -1) for x in parts], axis=1)
        return [base64.b64encode(r.tobytes()).decode("ascii") for r in rows]


def _check(keys: np.ndarray) -> np.ndarray:
    return mix(keys ^ np.uint64(0xA0761D6478BD642F)) | np.uint64(1 << 63)


def sketch_texts(keys: list[np.ndarray], cells: int) -> list[str]:
    owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    return Sketches(len(keys), cells).add(flat, owner, np.ones(len(flat), np.int32)).texts()


def likenesses(left: list[np.ndarray], right: list[np.ndarray], cells: int) -> np.ndarray:
    """Jaccard likeness of each pair of key sets: their tables are subtracted and peeled, larger ones where stuck."""
    a, b = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    out = np.where(a + b == 0, 1.0, 0.0)
    open_, size = np.flatnonzero((a > 0) & (b > 0)), cells
    while len(open_):
        # Tables that could not even hold the difference of the two counts need not be tried.
        now = open_[np.abs(a[open_] - b[open_]) <= size]
        apart = Sketches(len(now), size)
        for keys, n, sign in ((left, a, 1), (right, b, -1)):
            if len(now):
                flat = np.concatenate([keys[k] for k in now])
                apart.add(flat, np.repeat(np.arange(len(now)), n[now]), np.full(len(flat), sign, np.int32))
        found = apart.peel() if len(now) else np.zeros(0, np.int64)
        done = found >= 0
        shared = ((a + b)[now[done]] - found[done]) / 2
        out[now[done]] = shared / ((a + b)[now[done]] - shared)
        open_, size = np.setdiff1d(open_, now[done]), size * 4
    return out


def _fingerprinted(id_col: str, cells: int):
    """Rows of one partition in order, own ones first; the first of the others is what follows the last own one."""

    def work(chunk: list, following: str) -> tuple[list, list]:
        texts = [text for _, text in chunk] + [following]
        edited = []
        for own, after in zip(texts, texts[1:]):
            k = len(own) // 3
            edited.append(own[: len(own) - k] + after[:k])
        keys, edited_raw = [], []
        for group, raws in ((texts, []), (edited, edited_raw)):
            raws += [t.encode("utf-8") for t in group]
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)
            keys.append(paragraph_keys(np.frombuffer(b"".join(raws), np.uint8), offsets))
        own, other = keys
        columns = [
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(r).hexdigest() for r in edited_raw]),
            pa.array(sketch_texts(own[:-1], cells)),
            pa.array(sketch_texts(other, cells)),
            pa.array(likenesses(own[:-1], other, cells)),
            pa.array(likenesses(own[:-1], own[1:], cells)),
        ]
        return [i for i, _ in chunk], columns

    def run(batches):
        chunk: list[tuple] = []
        size, kind = 0, None
        for batch in batches:
            kind = batch.column(0).type
            for i, text, follows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if chunk and (follows or size > (1 << 20)):
                    yield _named(id_col, kind, *work(chunk, text))
                    chunk, size = [], 0
                if not follows:
                    chunk.append((i, text))
                    size += len(text)
        if chunk:
            raise ValueError("a partition lacks the row that follows its last one")

    return run


def _named(id_col, kind, ids, columns):
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), *columns], names=[id_col, *_COLUMNS])


_COLUMNS = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def fingerprint_documents(
    docs: DataFrame, cells: int = 30, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row a document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The text is shuffled once, to id ranges in descending order.  The first row of each range also goes to the
    range before it, so every document meets the next one without a second shuffle or a global window.
    """
    spark = docs.sparkSession
    parts = shuffle_width(spark)
    ids = docs.select(F.col(id_col).cast("long").alias("k"))
    steps = [k / parts for k in range(1, parts)]
    cuts = np.array(sorted(set(ids.approxQuantile("k", steps, 0.2 / parts))), np.float64) if steps else np.zeros(0)

    def range_of(k: pd.Series, missing: pd.Series) -> np.ndarray:
        # Ascending cuts, descending ranges; the last range is that of the null ids.
        place = len(cuts) - np.searchsorted(cuts, k.to_numpy(np.float64), "left")
        return np.where(missing, len(cuts) + 1, place).astype(np.int32)

    key = F.coalesce("k", F.lit(0)), F.col("k").isNull()
    ranges = F.pandas_udf(lambda k, missing: pd.Series(range_of(k, missing)), "int")
    heads = ids.groupBy(ranges(*key).alias("r")).agg(F.max("k").alias("m")).orderBy("r").collect()  # a row a range
    # The head of each range follows the range before it; the head of all follows the last.
    follows = {after["m"]: before["r"] for before, after in zip([*heads[-1:], *heads], heads)}

    def targets(k: pd.Series, missing: pd.Series) -> pd.Series:
        known = [None if lost else int(x) for x, lost in zip(k, missing)]
        return pd.Series([[int(r), follows[x]] if x in follows else [int(r)] for r, x in zip(range_of(k, missing), known)])

    to = F.pandas_udf(targets, "array<int>")
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")
    )
    rows = rows.withColumn("_to", to(*key)).select("_id", "k", "_text", F.posexplode("_to").alias("_follows", "_range"))
    placed = rows.repartitionById(parts, "_range").sortWithinPartitions(
        "_range", "_follows", F.col("k").desc_nulls_last(), "_text"
    )
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("n_chars", LongType())])
    for name in _COLUMNS[1:4]:
        schema = schema.add(name, StringType())
    schema = schema.add("near_edited", DoubleType()).add("near_next", DoubleType())
    return placed.select("_id", "_text", (F.col("_follows") == 1).alias("_f")).mapInArrow(_fingerprinted(id_col, cells), schema)
