"""Exact Jaccard self-join of word n-gram sets by partitioning the token universe.

A document's tokens are its distinct shingles.  Sets are grouped in *size bands*.  In each
band the hash universe is cut into segments, and a set's difference from a similar one, at
most ``H``, is spread over the segments: if segment ``i`` gets an allowance ``v_i`` and the
sum of ``v_i + 1`` exceeds ``H``, some segment differs by at most its allowance (pigeonhole).
Allowance 0 is met by an equal segment subset; allowance 1 by an equal one-deletion
neighbour; a segment without allowance is not probed.

The allocation is by cost.  A band chooses how many segments have one-deletion neighbourhoods
and how many are exact, so that the signatures it emits are fewest while the segments with
hardly a token, whose signatures are common, can all be left out.  A set spends what its size
leaves over on leaving out the signatures that are most common around it.

A set probes in the band of its own size, and is indexed there and in the next band if a
larger partner may be there.  What shares a signature makes a bucket:

* round 1 compares every member with the least of its bucket;
* verified links give components, and round 2 compares, in buckets that still span several
  components, the members of different ones, unless neither probes.  Only bounds are compared
  there, block by block inside a task, and just the pairs they can't exclude become rows; a large
  bucket is split into blocks, and pairs of blocks spread over tasks.

So no link between components is missed, and a bucket of copies costs one comparison a copy.
Copies of a whole set are linked by their fingerprint beforehand, and one of them in a batch
stands for the others in the index.  A pair goes through bounds on size and on parity sketches,
which never exceed the true difference, and is then verified on both texts.  Each set has a
sketch of ``SKETCH_BYTES``; a long one, on which that says little, also has a wide one of two
bits a token or more, which moves only for the pairs that the first leaves open.

Tokens are 64-bit hashes; a pair is linked if ``100 * |A and B| >= percent * |A or B|``.

Defined cases: a text of fewer words than ``n`` is one shingle of all its words; null, empty
and word-less texts have no shingle, link with nothing and are their own component; a null id
is nobody's partner and has a null component; rows with one id are one node, linked if any of
their texts is; a very long text is one set of any size, whose wide sketch grows with it; ties
for the least id can't occur, as equal ids are one node; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .repeats import expand, grouped_slices, partitions_for
from .store import Scratch
from .textkit import Words, mix, pack, row_slices, text_buffers, windows, word_rolling

SKETCH_BYTES = 128
GROWTH = 1.6
_BATCH_BYTES = 4 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a slice."""
    words = Words(data, offsets, lower=True)
    rolling = word_rolling(words.hashes())
    start, _ = windows(words.count, words.first, n)
    grams = rolling.span(start, start + n)
    count = np.maximum(words.count - n + 1, 0)
    ends = np.cumsum(count)
    short = np.flatnonzero((words.count > 0) & (words.count < n))
    out = [np.unique(grams[e - c : e]) for e, c in zip(ends.tolist(), count.tolist())]
    for k in short.tolist():
        out[k] = rolling.span(words.first[k : k + 1], words.first[k + 1 : k + 2])
    return out


def parity_sketch(mixed: np.ndarray, bits: int) -> bytes:
    """The parity of the tokens that fall on each of ``bits`` bits, a power of two."""
    odd = np.bincount((mixed & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _describe(n: int):
    """Size, fingerprint and parity sketches of every set."""

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            size, f1, f2, sketches, wide = [], [], [], [], []
            for i, j in row_slices(offsets):
                for tokens in shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n):
                    mixed = mix(tokens)
                    size.append(len(tokens))
                    f1.append(int(mixed.sum(dtype=np.uint64).view(np.int64)) if len(tokens) else 0)
                    f2.append(int(np.bitwise_xor.reduce(mix(mixed + np.uint64(1))).view(np.int64)) if len(tokens) else 0)
                    sketches.append(parity_sketch(mixed, SKETCH_BYTES * 8))
                    bits = 1 << (2 * len(tokens) - 1).bit_length() if len(tokens) else 0
                    wide.append(parity_sketch(mixed, bits) if bits > SKETCH_BYTES * 8 else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(size, pa.int64()),
                    pa.array(f1, pa.int64()),
                    pa.array(f2, pa.int64()),
                    pa.array(sketches, pa.binary()),
                    pa.array(wide, pa.binary()),
                ],
                names=["id", "size", "f1", "f2", "sketch", "wide"],
            )

    return run


class Scheme:
    """The segments of one size band: ``wide`` ones with one-deletion neighbourhoods, then exact ones."""

    def __init__(self, low: int, high: int, percent: int):
        self.low, self.high = low, high
        need = allowance(2 * high, percent) + 1
        typical, best = math.sqrt(low * high), None
        for wide in range(0, min(need, 40) // 2 + 2):
            least = max(need - 2 * wide, 0 if wide else 1)
            for exact in range(least, least + max(8, need // 4) + 1):
                m = wide + exact
                at_top = high / m
                weak = math.exp(-at_top) * (exact * (1 + at_top) + wide * (1 + at_top + at_top**2 / 2))
                common = max(0.0, weak + math.sqrt(weak) - (2 * wide + exact - need)) if m > 1 else 0.0
                cost = exact + wide * (1 + typical / m) + 1000 * common
                if best is None or cost < best[0]:
                    best = (cost, wide, exact)
        _, self.wide, self.exact = best
        self.segments = self.wide + self.exact
        self.budget = 2 * self.wide + self.exact


def allowance(total: int, percent: int) -> int:
    """The largest symmetric difference of two similar sets whose sizes sum to ``total``."""
    return total * (100 - percent) // (100 + percent)


@lru_cache(maxsize=4096)
def band_scheme(k: int, percent: int) -> Scheme:
    return Scheme(band_low(k), band_low(k + 1) - 1, percent)


@lru_cache(maxsize=4096)
def band_low(k: int) -> int:
    if k == 0:
        return 1
    before = band_low(k - 1)
    return max(before + 1, math.ceil(before * max(GROWTH, 1.0)))


def band_of(size: int) -> int:
    k = 0
    while band_low(k + 1) <= size:
        k += 1
    return k


def signatures(tokens: np.ndarray, k: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signature, segment and segment size of each signature of a sorted set in band ``k``'s scheme."""
    scheme = band_scheme(k, percent)
    m = scheme.segments
    segment = ((tokens >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    bounds = np.searchsorted(segment, np.arange(m + 1))
    mixed = mix(tokens)
    prefix = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(mixed, out=prefix[1:])
    whole = prefix[bounds[1:]] - prefix[bounds[:-1]]
    salt = mix(np.arange(m, dtype=np.uint64) + np.uint64(k << 32) + np.uint64(0x5E6))
    sizes = np.diff(bounds)
    sig, seg = mix(whole + salt), np.arange(m)
    if scheme.wide:
        near = np.arange(bounds[scheme.wide])
        s = segment[near]
        sig = np.concatenate([sig, mix(whole[s] - mixed[near] + salt[s])])
        seg = np.concatenate([seg, s])
    return sig, seg, sizes[seg]


_SHARED_NAMES = ["sig", "doc", "center", "probe"]
_SENT_NAMES = ["_part", "_sigs", "_docs", "_flags", *_SHARED_NAMES]
_SENT = "_part int, _sigs binary, _docs binary, _flags binary, sig long, doc long, center long, probe boolean"
_PROBES, _ANY, _MATES = 1, 2, 4


def _map_signatures(n: int, percent: int, parts: int):
    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j in row_slices(offsets, _BATCH_BYTES):
                seen: set[tuple] = set()
                sig, doc, seg, size, own, slack, wide = [], [], [], [], [], [], []
                for a, b in row_slices(offsets[i : j + 1]):
                    a, b = a + i, b + i
                    sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                    for r, tokens in enumerate(sets, a):
                        if not len(tokens):
                            continue
                        mark = (len(tokens), int(mix(tokens).sum(dtype=np.uint64)))
                        if mark in seen:  # a copy of a set of this batch: linked by its fingerprint
                            continue
                        seen.add(mark)
                        k = band_of(len(tokens))
                        probing = True
                        while k < 4000 and band_low(k) * percent <= 100 * len(tokens):
                            s, g, z = signatures(tokens, k, percent)
                            sig.append(s)
                            seg.append(g)
                            size.append(z)
                            doc.append(np.full(len(s), ids[r], np.int64))
                            own.append(np.full(len(s), len(own) if probing else -1, np.int64))
                            slack.append(band_scheme(k, percent).budget - allowance(2 * len(tokens), percent) - 1)
                            wide.append(band_scheme(k, percent).wide)
                            k, probing = k + 1, False
                if sig:
                    yield from _send(
                        *(np.concatenate(x) for x in (sig, doc, seg, size, own)), np.array(slack), np.array(wide), parts
                    )

    return run


def _send(sig, doc, seg, size, own, slack, wide, parts):
    order = np.lexsort((doc, sig))
    sig, doc, seg, size, own = sig[order], doc[order], seg[order], size[order], own[order]
    head = np.ones(len(sig), bool)
    head[1:] = sig[1:] != sig[:-1]
    group = np.cumsum(head) - 1
    first = np.flatnonzero(head)
    count = np.diff(np.append(first, len(sig)))

    # Each probing set leaves out its most common segments, as far as its slack goes.
    probe = own >= 0
    at = np.flatnonzero(probe)
    by = at[np.lexsort((seg[at], size[at], -count[group[at]], own[at]))]
    pair = own[by] * (1 << 32) + seg[by]
    _, lead, back = np.unique(pair, return_index=True, return_inverse=True)
    # A segment's place in the order is that of its most common signature; one with allowance 1 costs two, an empty one too.
    units = np.where(seg[by[lead]] < wide[own[by[lead]]], 2, 1)
    turn = np.argsort(lead, kind="stable")
    owner = own[by[lead[turn]]]
    spent = np.cumsum(units[turn])
    begins = np.ones(len(owner), bool)
    begins[1:] = owner[1:] != owner[:-1]
    base = np.repeat((spent - units[turn])[begins], np.diff(np.append(np.flatnonzero(begins), len(owner))))
    dropped = np.zeros(len(units), bool)
    dropped[turn] = spent - base <= slack[owner]
    probe[by] = ~dropped[back]

    any_probe = np.bitwise_or.reduceat(probe, first)
    rep = doc[first][group]
    mate = ~head & (doc != rep)
    passed = mate & any_probe[group]
    if passed.any():
        k = np.flatnonzero(passed)
        arrays = [pa.array((doc[k] & 0x7FFFFFFF).astype(np.int32))] + [pa.nulls(len(k), pa.binary())] * 3
        arrays += [pa.array(sig[k].view(np.int64)), pa.array(doc[k]), pa.array(rep[k]), pa.array(probe[k])]
        yield pa.RecordBatch.from_arrays(arrays, names=_SENT_NAMES)
    sent = np.flatnonzero(head | (mate & ~any_probe[group]))
    flags = probe * _PROBES + (head & any_probe[group]) * _ANY
    some = np.bincount(group, passed) > 0
    flags = (flags + (head & some[group]) * _MATES).astype(np.uint8)
    to = (mix(sig[sent]) % np.uint64(parts)).astype(np.int64)
    by, bounds = grouped_slices(to, parts)
    columns: list[list] = [[] for _ in range(4)]
    for p in np.flatnonzero(np.diff(bounds)):
        k = sent[by[bounds[p] : bounds[p + 1]]]
        for c, v in zip(columns, (int(p), pack(sig[k]), pack(doc[k]), pack(flags[k]))):
            c.append(v)
    n = len(columns[0])
    arrays = [pa.array(columns[0], pa.int32())] + [pa.array(c, pa.binary()) for c in columns[1:]]
    arrays += [pa.nulls(n, k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.bool_())]
    yield pa.RecordBatch.from_arrays(arrays, names=_SENT_NAMES)


def _reduce_signatures(batches):
    """Members of the buckets that several sets share and at least one probes."""
    held: list[tuple] = []
    for batch in batches:
        ready = batch.column(4).is_valid()
        passed = batch.filter(ready)
        if len(passed):
            yield pa.RecordBatch.from_arrays(passed.columns[4:], names=_SHARED_NAMES)
        for row in batch.filter(pc.invert(ready)).select(_SENT_NAMES[1:4]).to_pylist():
            held.append(tuple(row.values()))
    if not held:
        return
    sig, doc, flags = (b"".join(x) for x in zip(*held))
    held.clear()
    sig, doc, flags = np.frombuffer(sig, np.uint64), np.frombuffer(doc, np.int64), np.frombuffer(flags, np.uint8)
    order = np.argsort(sig, kind="stable")
    head = np.ones(len(order), bool)
    head[1:] = sig[order[1:]] != sig[order[:-1]]
    first = np.flatnonzero(head)
    size = np.diff(np.append(first, len(order)))
    all_flags = np.bitwise_or.reduceat(flags[order], first)
    low = np.minimum.reduceat(doc[order], first)
    high = np.maximum.reduceat(doc[order], first)
    use = ((low != high) | (all_flags & _MATES > 0)) & (all_flags & (_ANY | _PROBES) > 0)
    for g in range(0, len(first), 200_000):
        picked = np.flatnonzero(use[g : g + 200_000]) + g
        if not len(picked):
            continue
        k = order[expand(first[picked], size[picked])]
        center = np.repeat(low[picked], size[picked])
        yield pa.RecordBatch.from_arrays(
            [pa.array(sig[k].view(np.int64)), pa.array(doc[k]), pa.array(center), pa.array(flags[k] & _PROBES > 0)],
            names=_SHARED_NAMES,
        )


def _close_enough(percent: int):
    """Pairs whose sketches allow the similarity."""

    def run(batches):
        for batch in batches:
            a, b, n, m, x, y = batch.columns
            apart = _apart(_sketches(x), _sketches(y))
            near = apart <= (n.to_numpy() + m.to_numpy()) * (100 - percent) // (100 + percent)
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(near))

    return run


def _close_in_wide_sketches(percent: int):
    """Pairs whose wide sketches allow the similarity; the longer sketch is folded to the other's bits."""

    def run(batches):
        for batch in batches:
            a, b, n, m, x, y = batch.columns
            most = (n.to_numpy() + m.to_numpy()) * (100 - percent) // (100 + percent)
            keep = []
            for limit, left, right in zip(most.tolist(), x, y):
                if left.is_valid and right.is_valid:
                    left, right = (np.frombuffer(v.as_buffer(), np.uint64) for v in (left, right))
                    width = min(len(left), len(right))
                    left, right = (np.bitwise_xor.reduce(v.reshape(-1, width)) for v in (left, right))
                    keep.append(int(_apart(left, right)) <= limit)
                else:
                    keep.append(True)
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, SKETCH_BYTES // 8)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """At most the size of the symmetric difference: bits in which parity sketches differ."""
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


_OPEN_COLUMNS = ["sig", "i", "j", "block", "doc", "component", "probe", "size", "sketch"]


def _crossing(percent: int):
    """Pairs of members of one bucket in different components that the bounds on size and sketch allow.

    Rows come sorted by (sig, i, j); a group holds two blocks of a bucket, or one block alone.
    """

    def pairs_of(block, doc, component, probe, size, sketch, i, j):
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        for at in range(0, len(left), 256):
            k = left[at : at + 256, None]
            ok = (component[k] != component[right]) & (probe[k] | probe[right])
            if i == j:
                ok &= doc[k] < doc[right]
            small, large = np.minimum(size[k], size[right]), np.maximum(size[k], size[right])
            ok &= 100 * small >= percent * large
            r, c = np.nonzero(ok)
            r = left[at + r]
            c = right[c]
            near = _apart(sketch[r], sketch[c]) <= (size[r] + size[c]) * (100 - percent) // (100 + percent)
            yield np.minimum(doc[r], doc[c])[near], np.maximum(doc[r], doc[c])[near]

    def compare(table: pa.Table):
        columns = {n: table[n].combine_chunks() for n in _OPEN_COLUMNS}
        sig, i, j, block, doc, component, size = (
            columns[n].to_numpy(zero_copy_only=False) for n in ("sig", "i", "j", "block", "doc", "component", "size")
        )
        probe, sketch = columns["probe"].to_numpy(zero_copy_only=False), _sketches(columns["sketch"])
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        bounds = np.append(np.flatnonzero(new), len(sig)).tolist()
        found = []
        for s, e in zip(bounds[:-1], bounds[1:]):
            if e - s > 1:
                part = (x[s:e] for x in (block, doc, component, probe, size, sketch))
                found += pairs_of(*part, int(i[s]), int(j[s]))
        a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        both = np.unique(np.stack([a, b], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows < 65_536:
                continue
            table = pa.Table.from_batches(held)
            keys = [table[n].to_numpy() for n in ("sig", "i", "j")]
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            cut = int(np.argmax(same))  # the last group may go on in the next batch
            if cut:
                yield compare(table.slice(0, cut))
                held, rows = table.slice(cut).to_batches(), len(table) - cut
        if held:
            yield compare(pa.Table.from_batches(held))

    return run


def _similar(n: int, percent: int):
    """Pairs whose shingle sets are similar; both texts are at hand, sorted by the first id."""

    def tokens_of(text):
        data = np.frombuffer(text.as_buffer(), np.uint8)
        return shingle_sets(data, np.array([0, len(data)]), n)[0]

    def run(batches):
        known, tokens = None, None
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            keep = []
            for k, (left, right) in enumerate(zip(batch.column(2), batch.column(3))):
                if known is None or not left.equals(known):
                    known, tokens = left, tokens_of(left)
                other = tokens_of(right)
                both = len(np.intersect1d(tokens, other, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(tokens) + len(other) - both))
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, n: int, percent: int, scratch: Scratch) -> DataFrame:
    """The links among candidate pairs (``a``, ``b``), written."""
    facts = sets.select("id", "size", "f1", "f2", "sketch")
    left = facts.select(*[F.col(c).alias(f"a_{c}") for c in facts.columns])
    right = facts.select(*[F.col(c).alias(f"b_{c}") for c in facts.columns])
    near = (
        pairs.join(left, pairs.a == F.col("a_id"))
        .join(right, pairs.b == F.col("b_id"))
        .where(F.least("a_size", "b_size") * 100 >= F.greatest("a_size", "b_size") * percent)
        .where(~((F.col("a_size") == F.col("b_size")) & (F.col("a_f1") == F.col("b_f1")) & (F.col("a_f2") == F.col("b_f2"))))
        .select("a", "b", "a_size", "b_size", "a_sketch", "b_sketch")
        .mapInArrow(_close_enough(percent), "a long, b long")
    )
    near = scratch.write(near)
    left = sets.select(F.col("id").alias("a"), F.col("size").alias("a_size"), F.col("wide").alias("a_wide"))
    right = sets.select(F.col("id").alias("b"), F.col("size").alias("b_size"), F.col("wide").alias("b_wide"))
    wide = near.join(left, "a").join(right, "b").select("a", "b", "a_size", "b_size", "a_wide", "b_wide")
    closer = scratch.write(wide.mapInArrow(_close_in_wide_sketches(percent), "a long, b long").distinct())
    scratch.drop(near)
    near = closer
    needed = near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct()
    texts = scratch.write(docs.join(needed, "id", "left_semi"))
    first = texts.select(F.col("id").alias("a"), F.col("text").alias("a_text"))
    second = texts.select(F.col("id").alias("b"), F.col("text").alias("b_text"))
    full = near.join(second, "b").join(first, "a").select("a", "b", "a_text", "b_text")
    links = scratch.write(full.mapInArrow(_similar(n, percent), "a long, b long").distinct())
    scratch.drop(near, texts)
    return links


def _copies(sets: DataFrame, salts: int) -> DataFrame:
    """Links of equal sets: to the least id of their part of the group, and from there to the least of the group.

    A group of any size is dealt over ``salts`` parts; the second step has at most that many rows a group."""
    same = ["size", "f1", "f2"]
    dealt = sets.select("id", *same, F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt"))
    near = dealt.groupBy(*same, "salt").agg(F.min("id").alias("near"))
    least = near.groupBy(*same).agg(F.min("near").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = dealt.join(near, [*same, "salt"]).select(F.col("id").alias("a"), F.col("near").alias("b"))
    return first.unionByName(near.join(least, same).select(F.col("near").alias("a"), "b")).where("a <> b")


def similar_components(
    docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = 1024
) -> DataFrame:
    """One row a document: id, n_shingles, component_id."""
    spark = docs.sparkSession
    scratch, parts = Scratch(spark), partitions_for(docs)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = base.where("id is not null")
    described = scratch.write(base.mapInArrow(_describe(n), "id long, size long, f1 long, f2 long, sketch binary, wide binary"))
    sets = described.where("size > 0 and id is not null")
    copies = _copies(sets, parts)

    sent = named.mapInArrow(_map_signatures(n, percent, parts), _SENT)
    shared = scratch.write(
        sent.repartitionById(parts, "_part").mapInArrow(
            _reduce_signatures, "sig long, doc long, center long, probe boolean"
        )
    )
    stars = scratch.write(shared.where("doc <> center").select(F.col("center").alias("a"), F.col("doc").alias("b")).distinct())
    links = _verified(stars, sets, named, n, percent, scratch)
    linked = links.unionByName(copies)
    component = scratch.write(connected_components(linked, scratch))

    placed = shared.join(component, shared.doc == component.node, "left").select(
        "sig", "doc", "probe", F.coalesce("component", "doc").alias("component")
    )
    placed = scratch.write(placed)
    split = placed.groupBy("sig").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.bool_or("probe").alias("any")
    )
    split = split.where("low <> high and any").select("sig")
    facts = sets.select(F.col("id").alias("doc"), "size", "f1", "f2", "sketch")
    # Of copies in a bucket one is compared: they are of one component already.
    alike = placed.join(split, "sig").join(facts, "doc").groupBy("sig", "size", "f1", "f2")
    open_ = alike.agg(F.min("doc").alias("doc"), F.min("component").alias("component"), F.bool_or("probe").alias("probe"), F.min("sketch").alias("sketch"))
    open_ = scratch.write(open_.drop("f1", "f2"))
    many = open_.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    open_rows, open_ = open_, open_.join(many, "sig")
    own = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    open_ = open_.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    open_ = open_.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    grouped = open_.select(*_OPEN_COLUMNS).repartition(parts, "sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    crossing = grouped.mapInArrow(_crossing(percent), "a long, b long").distinct().join(stars, ["a", "b"], "left_anti")
    crossing = scratch.write(crossing)
    scratch.drop(shared, placed, stars, open_rows)
    more = _verified(crossing, sets, named, n, percent, scratch)
    if more.isEmpty():
        final = component
    else:
        stars_of = component.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        final = scratch.write(connected_components(more.unionByName(stars_of), scratch))
        scratch.drop(component)
    scratch.drop(crossing, links, more)
    out = described.join(final, described.id == final.node, "left").select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col),
        F.col("size").alias("n_shingles"),
        F.coalesce("component", "id").cast(docs.schema[id_col].dataType).alias("component_id"),
    )
    return out
