"""Removal of byte strings that start anywhere else too (suffix sorting over a difference cover).

Every ``length``-byte string that starts in two places is removed with all it covers.  Suffixes
need to be told apart by their first ``length`` bytes only, so the difference-cover algorithm is
run to that depth:

1. *Sample.*  A position of a document is sampled if, modulo ``v``, it lies in a difference cover
   ``D`` of ``q + 1`` residues, ``v = q*q + q + 1``.  For any two positions p, q some shift below
   ``v`` makes both sampled.  With ``length`` 400, ``v`` is 307 and one position in 17 is sampled.
2. *Name the sampled tuples.*  The ``w = length - v + 1`` bytes at each sampled position are sorted
   over the Spark partitions; adjacent equal ones are repeated.  Suffixes whose name is unique are
   sorted already and fall out.  Two equal strings always show as two sampled tuples of one name,
   the tuples at their common shift, so only starts within ``v`` of a repeated tuple stay open.
3. *Merge the remaining suffixes.*  What is open, sampled or not, is sorted by its first ``length`` bytes: a suffix
   by its leading bytes and what stands behind them.  Suffixes that may be equal share the least hash of a short
   byte string in their prefix (their minimizer), which gives them their Spark partition; neighbours of one
   minimizer travel as one run with the bytes around them, so a suffix takes a few bytes, not its prefix.
4. *Compare adjacent prefixes.*  Equal neighbours in the sorted order are the strings that start in
   two places.  What they cover is laid on the documents and removed.

The recursion of the general algorithm ends at once here: a name of step 2 with the open bytes around it reaches
``length``, so no second string of names has to be sorted.

A map task sorts its own batch first: prefixes that are equal there are repeated, and one of them stands for all in
the shuffle, so neither a common passage nor a large group of copies meets in one task.

Prefixes are compared by 64 bits of their own and 64 of their minimizer; sampled tuples, which only decide what is
looked at again, by 32 bits and their partition.

Defined cases: a null text is empty; texts shorter than ``length`` are kept; repeated rows and equal
texts are occurrences of their own and so remove each other; rows with a null id are served like
others; ids must be integers; the order of rows doesn't matter, so there are no ties to break; a very
long text is hashed by pieces of a megabyte; columns other than id, text and ``rest`` are ignored and
their names never clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .repeats import expand, grouped_slices, keyed, partitions_for, stretches
from .store import Scratch
from .textkit import SLICE_BYTES, byte_rolling, minimizers, mix, pack, row_slices, runs, text_buffers

# Names sorted at once in a map task.
_BATCH_NAMES = 3 << 19
_NAME_BYTES = 4
# Ranges of documents, one row a partition that gathers them: n spans for each id and hash, as pairs in one array.
_RANGES = "_bucket int, _width int, _docs binary, _counts binary, _spans binary"
_BY_DOCUMENT = "_id long, _sum long, _ranges array<struct<_width:int,_spans:binary>>"
_RANGE_NAMES = [x.split()[0] for x in _RANGES.split(", ")]
_NAMED = "_part int, _ids binary, _sums binary, _first binary, _n binary, _name binary"
_SUFFIXES = "_part int, _ids binary, _sums binary, _first binary, _n binary, _mini binary, _size binary, _bytes binary"


def difference_cover(length: int) -> tuple[int, tuple[int, ...]]:
    """``v`` and ``D`` for strings of ``length``: the largest prime q that leaves tuples of 64 bytes or half the length."""
    most, best = max(length - 64, length // 2), 0
    for q in range(2, most):
        if q * q + q + 1 > most:
            break
        if all(q % k for k in range(2, q)):
            best = q
    return (best * best + best + 1, _plane(best)) if best else (1, (0,))


def _plane(q: int) -> tuple[int, ...]:
    """A perfect difference set for a prime q: the powers of a generator of GF(q**3) that lie in one plane."""
    v = q * q + q + 1
    for c, b, a in itertools.product(range(1, q), range(q), range(q)):
        x2, x1, x0, found = 0, 0, 1, []
        for k in range(v):
            if x2 == 0:
                found.append(k)
            x2, x1, x0 = (x1 + a * x2) % q, (x0 + b * x2) % q, c * x2 % q
        if len({(s - t) % v for s in found for t in found}) == v and len(found) == q + 1:
            return tuple(found)
    raise AssertionError("every prime has one")


class Samples:
    """The positions of a cover, which stand for strings that start up to ``v - 1`` bytes earlier."""

    def __init__(self, v: int, cover: tuple[int, ...]):
        self.v, self.cover = v, np.array(cover, np.int64)

    def below(self, at: np.ndarray) -> np.ndarray:
        """How many sampled positions are less than ``at``."""
        whole, rest = np.divmod(at, self.v)
        return whole * len(self.cover) + np.searchsorted(self.cover, rest)

    def place(self, k: np.ndarray) -> np.ndarray:
        whole, rest = np.divmod(k.astype(np.int64), len(self.cover))
        return whole * self.v + self.cover[rest]


def _blocks(row, first, last, step: int, size_of, hashed):
    """Walks the items ``first`` to ``last`` of rows, a piece of at most ``step`` items at a time, and joins what
    ``hashed`` makes of slices of pieces to blocks of ``_BATCH_NAMES`` items."""
    pieces = -(-np.maximum(last - first, 0) // step)
    which = np.repeat(np.arange(len(row)), pieces)
    first = first[which] + step * expand(np.zeros(len(row), np.int64), pieces)
    last, row = np.minimum(first + step, last[which]), row[which]
    size = size_of(row, first, last)
    held: list[tuple] = []
    room = 0
    for i, j in row_slices(np.append(0, np.cumsum(size))):
        held.append(hashed(row[i:j], first[i:j], last[i:j], size[i:j]))
        room += len(held[-1][0])
        if room >= _BATCH_NAMES or j == len(row):
            columns = [list(x) for x in zip(*held)]
            held, room = [], 0
            for k, column in enumerate(columns):
                columns[k] = np.concatenate(column)
            yield columns


def _named_samples(data, offsets, samples: Samples, width: int, length: int):
    """Blocks of (row, sample, name) of the tuples at sampled positions, in rows of ``length`` bytes or more."""
    size = np.diff(offsets)
    row = np.flatnonzero(size >= length)
    first, last = np.zeros(len(row), np.int64), samples.below(size[row] - width + 1)

    def size_of(row, first, last):
        return samples.place(last - 1) + width - samples.place(first)

    def hashed(row, first, last, size):
        begin = samples.place(first)
        rolling = byte_rolling(data[expand(offsets[row] + begin, size)])
        k, unit = expand(first, last - first), np.repeat(np.arange(len(row)), last - first)
        at = (np.cumsum(size) - size - begin)[unit] + samples.place(k)
        return row[unit].astype(np.int32), k.astype(np.int32), rolling.span(at, at + width)

    yield from _blocks(row, first, last, max(1, SLICE_BYTES * len(samples.cover) // samples.v), size_of, hashed)


def _open_suffixes(data, offsets, row, start, stop, length: int, longest: int):
    """Blocks of (row, place, hash of ``length`` bytes, hash of up to ``longest``, whether it has so many, minimizer)."""
    gram = max(1, min(32, length // 3))

    def size_of(row, first, last):
        return np.minimum(last - 1 + longest, offsets[row + 1] - offsets[row]) - first

    def hashed(row, first, last, size):
        part = data[expand(offsets[row] + first, size)]
        rolling = byte_rolling(part)
        at, unit = expand(first, last - first), np.repeat(np.arange(len(row)), last - first)
        end = np.cumsum(size)
        here = (end - size - first)[unit] + at
        every = np.arange(len(part) - gram + 1)
        grams = rolling.span(every, every + gram)
        mini = grams[minimizers(mix(grams), here, length - gram + 1, 32)]
        until = np.minimum(here + longest, end[unit])
        short = rolling.span(here, here + length)
        whole = short if longest == length else rolling.span(here, until)
        return row[unit].astype(np.int32), at.astype(np.int32), short, whole, until - here == longest, mini

    yield from _blocks(row, start, stop, SLICE_BYTES, size_of, hashed)


def _united(docs: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """The distinct ones of ``docs`` (rows of numbers), how many disjoint ranges each has, and these as pairs."""
    order = np.lexsort(docs.T)
    docs = docs[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]).any(axis=1)
    above = (np.cumsum(new) - 1) << 32
    start, stop = runs(above + np.maximum(start[order], 0), above + stop[order])
    n = np.diff(np.append(np.searchsorted(start, np.arange(int(new.sum())) << 32), len(start)))
    return docs[new], n, np.stack([start, stop], 1).astype(np.int32)  # without the document's rank, which is above


def _range_rows(ids, sums, width: int, start, stop, parts: int, packed: int = 0) -> pa.RecordBatch:
    """Ranges, packed for the partitions that gather them; with ``packed`` more columns before them, they ride
    to those partitions in the exchange of the names, which passes them on."""
    docs, n, spans = _united(np.stack([ids, sums], 1).astype(np.int64), start, stop)
    owner = (mix(docs[:, 0].astype(np.uint64) ^ mix(docs[:, 1].astype(np.uint64))) % np.uint64(parts)).astype(np.int64)
    by, bounds = grouped_slices(owner, parts)
    first = np.cumsum(n) - n
    rows = []
    for p in np.flatnonzero(np.diff(bounds)):
        k = by[bounds[p] : bounds[p + 1]]
        rows.append((int(p), width, pack(docs[k]), pack(n[k].astype(np.int32)), pack(spans[expand(first[k], n[k])])))
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    arrays = [pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)]
    if packed:
        arrays = [arrays[0], *[pa.nulls(len(rows), pa.binary())] * packed, *arrays]
    return pa.RecordBatch.from_arrays(arrays, names=[f"c{k}" for k in range(packed + 1)] * bool(packed) + _RANGE_NAMES)


def _gather(batches):
    """One row a document with its ranges, by width."""
    held: list[tuple] = []
    for batch in batches:
        held += zip(*(c.to_pylist() for c in batch.columns[1:]))
    if not held:
        return
    n = np.frombuffer(b"".join(x[2] for x in held), np.int32)
    docs = np.frombuffer(b"".join(x[1] for x in held), np.int64).reshape(-1, 2)
    width = np.repeat([x[0] for x in held], [len(x[2]) // 4 for x in held])
    spans = np.frombuffer(b"".join(x[3] for x in held), np.int32).reshape(-1, 2).astype(np.int64)
    held.clear()
    of = np.repeat(np.arange(len(n)), n)
    keys = np.column_stack([width, docs[:, 1], docs[:, 0]])[of]  # sorted by id, hash and then width
    keys, n, spans = _united(keys, spans[:, 0], spans[:, 1])
    until = np.cumsum(n)
    out: list[list] = [[], [], []]
    for (w, total, key), e, k in zip(keys.tolist(), until.tolist(), n.tolist()):
        if not out[0] or (out[0][-1], out[1][-1]) != (key, total):
            for c, x in zip(out, (key, total, [])):
                c.append(x)
        out[2][-1].append({"_width": w, "_spans": pack(spans[e - k : e])})
    kind = pa.list_(pa.struct([("_width", pa.int32()), ("_spans", pa.binary())]))
    arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], kind)]
    yield pa.RecordBatch.from_arrays(arrays, names=["_id", "_sum", "_ranges"])


def _packed_rows(parts_of: np.ndarray, parts: int, columns) -> pa.RecordBatch:
    """One row a partition, of packed columns; a column may be (values, begin, size), ranges of a long array."""
    by, bounds = grouped_slices(parts_of, parts)
    out: list[list] = [[] for _ in range(len(columns) + 1)]
    for p in np.flatnonzero(np.diff(bounds)):
        k = by[bounds[p] : bounds[p + 1]]
        out[0].append(int(p))
        for c, x in zip(out[1:], columns):
            c.append(pack(x[0][expand(x[1][k], x[2][k])] if isinstance(x, tuple) else x[k]))
    n = len(out[0])
    arrays = [pa.array(out[0], pa.int32()), *[pa.array(c, pa.binary()) for c in out[1:]]]
    arrays += [pa.nulls(n, k) for k in (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=[f"c{k}" for k in range(len(columns) + 1)] + _RANGE_NAMES)


def _sorted(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which items have an equal one, and which are the first of their kind, by sorting."""
    order = np.argsort(name, kind="stable")
    equal = name[order[1:]] == name[order[:-1]]
    repeated, first = np.zeros(len(name), bool), np.ones(len(name), bool)
    repeated[order[1:]] = equal
    repeated[order[:-1]] |= equal
    first[order[1:]] = ~equal
    return repeated, first


def _consecutive(row: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and length of runs of consecutive places of one row and kind."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1) | (kind[1:] != kind[:-1])
    begin = np.flatnonzero(new)
    return begin, np.diff(np.append(begin, len(row)))


def _map_samples(length: int, samples: Samples, parts: int):
    """Names of the samples of a batch, packed by partition; and what those that are repeated in the batch open."""
    width = length - samples.v + 1

    def run(batches):
        for batch in batches:
            ids, sums = (batch.column(k).to_numpy() for k in (0, 1))
            data, offsets = text_buffers(batch.column(2))
            for row, k, name in _named_samples(data, offsets, samples, width, length):
                repeated, first = _sorted(name)
                begin, last = stretches(repeated, row, k)
                at = row[begin]
                yield _range_rows(ids[at], sums[at], length, samples.place(k[begin]) - samples.v + 1, samples.place(k[last]) + 1, parts, 5)
                sent = np.flatnonzero(first)
                owner = (mix(name[sent]) % np.uint64(parts)).astype(np.int64)
                # A document's samples of one partition are a group with one header.
                order = np.argsort(owner, kind="stable")
                sent, owner = sent[order], owner[order]
                begin, n = _consecutive(row[sent], np.arange(len(sent)), owner)
                head = row[sent[begin]]
                short = name.view(np.uint8).reshape(-1, 8)[:, :_NAME_BYTES]
                columns = ids[head], sums[head], (k[sent], begin, n), n.astype(np.int32), (short[sent], begin, n)
                yield _packed_rows(owner[begin], parts, columns)

    return run


def _unpacked(batches, columns: int, kinds):
    """The joined packed columns of a partition; ranges that ride along are passed on."""
    held: list[list] = [[] for _ in range(columns)]
    for batch in batches:
        passed = batch.column(columns + 1).is_valid()
        if (rides := batch.filter(passed)).num_rows:
            yield pa.RecordBatch.from_arrays(rides.columns[columns + 1 :], names=_RANGE_NAMES)
        for k, column in enumerate(batch.filter(pc.invert(passed)).columns[1 : columns + 1]):
            held[k] += column.to_pylist()
    if held[0]:
        yield [np.frombuffer(b"".join(x), t) for x, t in zip(held, kinds)]


def _sort_samples(length: int, samples: Samples, parts: int):
    """Sorts the names of one partition; what those with an equal neighbour open."""

    def run(batches):
        for got in _unpacked(batches, 5, (np.int64, np.int64, np.int32, np.int32, np.uint32)):
            if isinstance(got, pa.RecordBatch):
                yield got
                continue
            ids, sums, k, n, name = got
            repeated, _ = _sorted(name)
            group = np.repeat(np.arange(len(n)), n)[repeated]
            at = samples.place(k[repeated])
            yield _range_rows(ids[group], sums[group], length, at - samples.v + 1, at + 1, parts)

    return run


def _map_suffixes(length: int, longest: int, parts: int):
    """The open suffixes of a batch, as runs with their bytes, packed by partition; and those repeated in the batch."""

    def run(batches):
        for batch in batches:
            ids, sums = (batch.column(k).to_numpy() for k in (0, 1))
            data, offsets = text_buffers(batch.column(2))
            size = np.diff(offsets)
            lists = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in batch.column(3).to_pylist()]
            row = np.repeat(np.arange(len(size)), [len(x) for x in lists])
            both = np.concatenate([np.zeros((0, 2), np.int32), *lists]).astype(np.int64)
            start, stop = both[:, 0], np.minimum(both[:, 1], size[row] - length + 1)
            use = start < stop
            for row, at, short, whole, full, mini in _open_suffixes(data, offsets, row[use], start[use], stop[use], length, longest):
                repeated, first = _sorted(short)
                found = [(length, repeated)]
                if longest != length:
                    repeated, first = _sorted(whole)
                    found.append((longest, repeated & full))
                for width, which in found:
                    begin, last = stretches(which, row, at)
                    r = row[begin]
                    yield _range_rows(ids[r], sums[r], width, at[begin], at[last] + 1, parts, 7)
                sent = np.flatnonzero(first)
                begin, n = _consecutive(row[sent], at[sent], mini[sent])
                head = sent[begin]
                r = row[head]
                wide = np.minimum(at[head] + n - 1 + longest, size[r]) - at[head]
                owner = (mix(mini[head]) % np.uint64(parts)).astype(np.int64)
                columns = ids[r], sums[r], at[head], n.astype(np.int32), mini[head], wide.astype(np.int32), (data, offsets[r] + at[head], wide)
                yield _packed_rows(owner, parts, columns)

    return run


def _sort_suffixes(length: int, longest: int, parts: int):
    """Sorts the open suffixes of one partition by their prefixes; the places of those with an equal neighbour."""

    def run(batches):
        for got in _unpacked(batches, 7, (np.int64, np.int64, np.int32, np.int32, np.uint64, np.int32, np.uint8)):
            if isinstance(got, pa.RecordBatch):
                yield got
                continue
            ids, sums, first, n, mini, size, data = got
            n, end = n.astype(np.int64), np.cumsum(size.astype(np.int64))
            group, at = np.repeat(np.arange(len(n)), n), expand(first.astype(np.int64), n).astype(np.int32)
            for width in sorted({length, longest}):
                # Of a run's suffixes, those of which the document has ``width`` bytes.
                have = np.minimum(n, np.maximum(size - width + 1, 0))
                key = np.zeros(int(n.sum()), np.uint64)
                base = np.cumsum(n) - n
                for i, j in row_slices(np.append(0, end)):
                    rolling = byte_rolling(data[end[i] - size[i] : end[j - 1]])
                    unit = np.repeat(np.arange(i, j), have[i:j])
                    k = expand(np.zeros(j - i, np.int64), have[i:j])
                    here = (end - size - (end[i] - size[i]))[unit] + k
                    key[base[unit] + k] = mix(rolling.span(here, here + width) + mix(mini[unit]))
                present = expand(base, have)
                repeated = np.zeros(len(key), bool)
                repeated[present] = _sorted(key[present])[0]
                begin, last = stretches(repeated, group, at)
                r = group[begin]
                yield _range_rows(ids[r], sums[r], width, at[begin], at[last] + 1, parts)

    return run


def _ranges_by_document(packed: DataFrame, parts: int, sort) -> DataFrame:
    """Sorts packed records in their partitions, and gathers what comes of it by document."""
    ranges = packed.repartitionById(parts, "_part").mapInArrow(sort, _RANGES)
    return ranges.repartitionById(parts, "_bucket").mapInArrow(_gather, _BY_DOCUMENT)


def _merged(column: pa.Array) -> list[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """For each row the union of its ranges, by width; a null has none."""
    out = []
    for k in range(len(column)):
        found: dict[int, list] = {}
        if column[k].is_valid:
            items = column[k].values
            for width, spans in zip(items.field(0).to_pylist(), items.field(1).to_pylist()):
                found.setdefault(width, []).append(spans)
        both = {w: np.frombuffer(b"".join(x), np.int32).astype(np.int64).reshape(-1, 2) for w, x in found.items()}
        out.append({w: runs(x[:, 0], x[:, 1]) for w, x in both.items()})
    return out


_MET = ["_id", "_sum", "_text", "_open", "_rest", "n_bytes", "kept_sha256"]


def _meet(keep_text: bool):
    """Documents without a repeated tuple are done; the others keep their text and what is open of it."""

    def run(batches):
        for batch in batches:
            ids, sums, texts, ranges, rest = batch.columns
            open_ = np.asarray(ranges.is_valid())
            data, offsets = text_buffers(texts)
            digests = [
                None if o else hashlib.sha256(data[s:e]).hexdigest()
                for o, s, e in zip(open_.tolist(), offsets[:-1].tolist(), offsets[1:].tolist())
            ]
            merged = [pack(np.stack(next(iter(x.values())), 1).astype(np.int32)) if x else None for x in _merged(ranges)]
            kept = texts if keep_text else pc.if_else(pa.array(open_), texts, pa.scalar(None, texts.type))
            arrays = [ids, sums, kept, pa.array(merged, pa.binary()), rest]
            arrays += [pa.array(np.diff(offsets), pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=_MET)

    return run


def _lay(length: int, report: int, keep_text: bool):
    """Cuts the strings of ``length``; counts the bytes that those of ``report`` cover."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text, found in zip(batch.column(1), _merged(batch.column(2))):
                raw = text.as_buffer().to_pybytes()
                nothing = (np.zeros(0, np.int64),) * 2
                start, stop = found.get(length, nothing)
                start, stop = runs(start, stop + length - 1)
                seen = found.get(report, nothing)
                seen = runs(seen[0], seen[1] + report - 1)
                kept, at = [], 0
                for s, e in zip(start.tolist(), stop.tolist()):
                    kept.append(raw[at:s])
                    at = e
                kept = b"".join([*kept, raw[at:]])
                values = len(raw), len(raw) - len(kept), len(start), int((seen[1] - seen[0]).sum()), hashlib.sha256(kept).hexdigest()
                for c, x in zip(out, (*values, kept.decode("utf-8", "ignore") if keep_text else None)):
                    c.append(x)
            arrays = [pa.array(c, pa.int64()) for c in out[:4]] + [pa.array(c, pa.string()) for c in out[4:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["_rest", *_LAID])

    return run


_LAID = ["n_bytes", "n_removed", "n_spans", "n_repeated", "kept_sha256", "kept_text"]


def remove_repeated_bytes(
    docs: DataFrame,
    length: int = 400,
    report: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    rest: tuple[str, ...] = (),
    keep_text: bool = False,
) -> DataFrame:
    """One row a document: id, n_bytes, n_removed, n_spans, kept_sha256, and with ``keep_text`` the remaining
    bytes as text (``kept_text``; of a character that a cut splits, nothing stays).

    ``report``: a shorter length; ``n_repeated`` counts the bytes covered by strings of that length that start
    anywhere else too.  They are not removed.  ``rest``: more columns of ``docs`` to carry along.

    The text is shuffled once, to meet its open ranges; only documents with a repeated tuple are read again.
    """
    spark = docs.sparkSession
    parts = partitions_for(docs)
    depth = min(report or length, length)
    v, cover = difference_cover(depth)
    rows = keyed(docs, id_col, text_col, rest).withColumn("_id", F.coalesce("_id", F.lit(-1)))
    samples = Samples(v, cover)
    packed = rows.select("_id", "_sum", "_text").mapInArrow(_map_samples(depth, samples, parts), f"{_NAMED}, {_RANGES}")
    scratch = Scratch(spark)
    found = scratch.write(_ranges_by_document(packed, parts, _sort_samples(depth, samples, parts)), free=True)
    joined = rows.join(found, ["_id", "_sum"], "left").select("_id", "_sum", "_text", "_ranges", "_rest")
    key, total, _, _, more = joined.schema.fields
    met = StructType([key, total, StructField("_text", StringType()), StructField("_open", BinaryType()), more])
    met = met.add("n_bytes", LongType()).add("kept_sha256", StringType())
    met = scratch.write(joined.mapInArrow(_meet(keep_text), met), free=True)
    scratch.drop(found)
    open_ = met.where(F.col("_open").isNotNull())
    packed = open_.select("_id", "_sum", "_text", "_open").mapInArrow(_map_suffixes(depth, length, parts), f"{_SUFFIXES}, {_RANGES}")
    found = _ranges_by_document(packed, parts, _sort_suffixes(depth, length, parts))
    laid = open_.join(found, ["_id", "_sum"], "left").select("_rest", "_text", "_ranges")
    result = StructType([more, *[StructField(c, LongType()) for c in _LAID[:4]], *[StructField(c, StringType()) for c in _LAID[4:]]])
    zero = F.lit(0).cast("long")
    done = met.where(F.col("_open").isNull()).select(
        "_rest", "n_bytes", *[zero.alias(c) for c in _LAID[1:4]], "kept_sha256", F.col("_text").alias("kept_text")
    )
    both = laid.mapInArrow(_lay(length, depth, keep_text), result).unionByName(done)
    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["n_repeated"] if report else []), *(["kept_text"] if keep_text else [])]
    return both.select(*[F.col(f"_rest.c{k}").alias(c) for k, c in enumerate([id_col, *rest])], *columns)
