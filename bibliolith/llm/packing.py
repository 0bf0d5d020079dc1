"""Packing token sequences by the online sum-of-squares rule.

Documents arrive one by one and are placed whole into partially filled windows.  With
``N[h]`` open windows at fill level ``h``, the level is chosen that minimises the sum of
``N[h]**2`` after the placement, tracked in an array of one count a level.  A window whose
remaining gap is under ``seal`` tokens is closed with exactly that many tokens cut from the
front of the next document, so closed windows carry no padding.  A document longer than a
window is first cut into full windows.

Every Spark partition packs its own documents.  When it ends, what its open windows hold is
laid end to end into full windows, and the rest into windows whose lengths are powers of
two, which need no padding either.

Tokenising goes word by word with a bounded memo.  The tokenizer drops white space and never
joins what white space parts, so a text's ids are those of its words in turn; within plain
Latin words, runs of letters, single digits and runs of signs are independent as well.

Defined cases: a null or empty text is the closing id alone; repeated rows are packed each;
an empty table gives no piece; a text of any length is cut into windows; of levels that tie the
fullest is taken; a null id is packed like others; other columns are ignored.  Sequence ids are unique, and the
same for a rerun over the same files.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import LOWER, SPACE, Words, byte_rolling, row_slices, text_buffers

PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_LETTER, _DIGIT, _SIGN, _OTHER = 1, 2, 3, 4
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[33:127] = _SIGN
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[39] = _OTHER  # an apostrophe joins the letters after it

_MEMOS: dict[int, "WordTokens"] = {}


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Start, end and row of the independent parts of the words of a slice, and its bytes as they are looked up."""
    words = Words(data, offsets)
    kind = _KIND[data]
    # Two-byte letters of the Latin-1 range (not the signs at 0x97 and 0xB7).
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, np.int64)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    kind[SPACE[data]] = 0
    # A special token's text must stay in one part.
    bar = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C)) if len(data) else lead
    kind[bar] = _OTHER
    whole = np.maximum.reduceat(kind, words.start) == _OTHER if len(words.start) else np.zeros(0, bool)
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    inside = np.zeros(len(data) + 1, np.int32)
    np.add.at(inside, words.start[whole] + 1, 1)
    np.add.at(inside, words.end[whole], -1)
    loose = np.cumsum(inside) == 0
    cut &= loose
    cut[words.start] = cut[words.end] = True
    at = np.flatnonzero(cut)
    begin, stop = at[:-1], at[1:]
    held = kind[begin] != 0 if len(begin) else np.zeros(0, bool)
    begin, stop = begin[held], stop[held]
    # The tokenizer lowers case; doing so first for plain words lets more of them share a memo entry.
    kept = loose[:-1].copy()
    kept[words.start[whole]] = False
    folded = np.where(kept, LOWER[data], data)
    return begin, stop, np.searchsorted(offsets, begin, "right") - 1, folded


class WordTokens:
    """Ids of word parts, remembered by a 64-bit hash in sorted arrays."""

    def __init__(self, definition: str, limit: int = 3_000_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_str(definition), limit
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint16)

    def _learn(self, keys: np.ndarray, strings: list[str]) -> None:
        if len(self.keys) + len(keys) > self.limit:
            self._clear()
        got = [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int32, len(got))
        at = np.cumsum(n) - n + len(self.flat)
        self.flat = np.concatenate([self.flat, np.fromiter((i for ids in got for i in ids), np.uint16, int(n.sum()))])
        to = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n = np.insert(self.keys, to, keys), np.insert(self.at, to, at), np.insert(self.n, to, n)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a slice one after the other, and the n + 1 offsets of the rows."""
        start, end, row, plain = _pieces(data, offsets)
        key, first, inverse = np.unique(byte_rolling(plain).span(start, end), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        new = self.keys[place] != key if len(self.keys) else np.ones(len(key), bool)
        if new.any():
            if len(self.keys) + int(new.sum()) > self.limit:
                self._clear()
                new[:] = True
            raw = plain.tobytes()
            at = first[new]
            strings = [raw[s:e].decode("utf-8") for s, e in zip(start[at].tolist(), end[at].tolist())]
            self._learn(key[new], strings)
            place = np.searchsorted(self.keys, key)
        n, at = self.n[place][inverse], self.at[place][inverse]
        to = np.cumsum(n)
        ids = self.flat[np.repeat(at - (to - n), n) + np.arange(int(n.sum()))] if len(n) else np.zeros(0, np.uint16)
        ends = np.concatenate([[0], to])[np.searchsorted(row, np.arange(len(offsets)))]
        return ids, ends


def word_tokens(definition: str) -> WordTokens:
    """The memo of this Python worker, which outlives tasks where workers are reused."""
    key = hash(definition)
    if key not in _MEMOS:
        _MEMOS[key] = WordTokens(definition)
    return _MEMOS[key]


class SumOfSquares:
    """Windows of one partition.  ``emit`` gets (sequence, pieces) of each closed window."""

    def __init__(self, window: int, seal: int, emit):
        self.window, self.seal, self.emit = window, seal, emit
        self.counts = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}
        self.gaps: list[tuple[int, list]] = []

    def add(self, doc, ids: np.ndarray) -> None:
        start = 0
        while self.gaps and len(ids) - start > self.gaps[-1][0] + self.seal:
            gap, pieces = self.gaps.pop()
            pieces.append((doc, start, ids[start : start + gap], len(ids)))
            self.emit(pieces)
            start += gap
        while len(ids) - start >= self.window:
            self.emit([(doc, start, ids[start : start + self.window], len(ids))])
            start += self.window
        if start < len(ids):
            self._place((doc, start, ids[start:], len(ids)))

    def _place(self, piece) -> None:
        size = len(piece[2])
        n = self.counts
        room = self.window - size
        # Change of the sum of squares if a window at level h moves to h + size; level 0 is a new window.
        gain = 2 * n[size : self.window + 1] + 1
        gain[room] = 0
        loss = 2 * n[: room + 1] - 1
        loss[0] = 0
        change = np.where(n[: room + 1] > 0, gain - loss, np.iinfo(np.int64).max)
        change[0] = gain[0]
        level = room - int(np.argmin(change[::-1]))  # the fullest among equals
        if level:
            pieces = self.open[level].pop()
            n[level] -= 1
        else:
            pieces = []
        pieces.append(piece)
        level += size
        if level == self.window:
            self.emit(pieces)
        elif self.window - level <= self.seal:
            self.gaps.append((self.window - level, pieces))
        else:
            self.open.setdefault(level, []).append(pieces)
            n[level] += 1

    def flush(self) -> None:
        """Lay what is open end to end: full windows first, then powers of two."""
        rest = [p for _, pieces in self.gaps for p in pieces]
        rest += [p for level in sorted(self.open, reverse=True) for pieces in self.open[level] for p in pieces]
        left = sum(len(p[2]) for p in rest)
        self.gaps, self.open = [], {}
        sizes = [self.window] * (left // self.window)
        left %= self.window
        sizes += [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
        pieces: list = []
        need = sizes.pop(0) if sizes else 0
        for doc, start, ids, total in rest:
            at = 0
            while at < len(ids):
                take = min(need, len(ids) - at)
                pieces.append((doc, start + at, ids[at : at + take], total))
                at, need = at + take, need - take
                if not need:
                    self.emit(pieces)
                    pieces, need = [], sizes.pop(0) if sizes else 0


def pack_documents(
    docs: DataFrame,
    tokenizer_file: str,
    window: int = 4096,
    close_id: int = 2,
    seal: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Narrow: no shuffle.  A task keeps the open windows of its partition, at most one a fill level on average.
    The tokenizer's definition is a file of fixed size, read by Spark and broadcast.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    kind = docs.schema[id_col].dataType

    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens = word_tokens(definition.value)
        rows: list[tuple] = []
        serial = TaskContext.get().partitionId() << 32

        def emit(pieces):
            nonlocal serial
            offset = 0
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, serial, offset))
                offset += len(ids)
            serial += 1

        def table():
            columns = list(zip(*rows)) if rows else [[]] * 7
            rows.clear()
            kinds = [id_type] + [pa.int64()] * 6
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

        packer, id_type = SumOfSquares(window, seal, emit), None
        for batch in batches:
            id_type = batch.column(0).type
            docs_ids = batch.column(0).to_pylist()
            data, offsets = text_buffers(batch.column(1))
            for i, j in row_slices(offsets):
                ids, ends = tokens.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for k in range(j - i):
                    packer.add(docs_ids[i + k], np.append(ids[ends[k] : ends[k + 1]], np.uint16(close_id)))
                if len(rows) > 20_000:
                    yield table()
        packer.flush()
        if rows:
            yield table()

    schema = PIECES.format(id=kind.simpleString()).replace("doc_id", id_col, 1)
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
