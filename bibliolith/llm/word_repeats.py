"""Removal of long word sequences that another document has already (de Bruijn compaction).

In the graph an *edge* is a window of ``window`` consecutive words and a *node* one of ``window - 1``: an edge
leads from the node of its first words to that of its last.  An edge is *repeated* if documents of several ids
have it; its *owner* is the least of them, at its first place there.

1. *Deal.*  A node belongs to the partition of its minimizer (the ``anchor``-word sequence of least hash in it), and
   an edge goes to the partitions of both its nodes.  Neighbouring nodes mostly share their minimizer, so what travels
   is a run of edges: one header and 5 bytes a node.  A map task finds what is repeated in its own batch first: there
   the least id stands for all, so a passage, however common, is sent once a batch.
2. *Degrees and pieces.*  A partition has all edges of its nodes.  It counts the distinct repeated edges that enter
   and leave each node; edges that meet at a node with one of each, on the same owner, are joined to a *piece*.
3. *Verify.*  Where a piece occurs in a document, it has two coordinates, there and on its owner.  The words at both
   are compared by SHA-256, and only what agrees is removed.
4. *Compact.*  Pieces of different partitions share the edge between them; a join of each piece's last edge with the
   first of the next glues them to nonbranching paths, named by their start on the owner's text.  Occurrences join
   their paths, and unbroken stretches of one document along one path become one long span.

So hashes (64 bits of the minimizer and 40 of a node) only propose; equal digests of source words decide.

Defined cases: a null text has no words; texts shorter than the window are kept; a null id has no rank, so such rows
are kept whole and make nothing redundant; rows with one id do not make each other redundant, also if their texts are
unlike; of several places or texts of the owner the first counts, which changes no result; ids must be integers; a very
long text is one record, of any length below 2**31 words; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .repeats import expand, grouped_slices, keyed, partitions_for, stretches
from .store import Scratch
from .textkit import Words, minimizers, mix, pack, row_slices, runs, text_buffers, word_rolling

_BATCH_BYTES = 4 << 20
_NODE_BYTES = 5
_RUNS = "_part int, _minis binary, _ids binary, _sums binary, _ats binary, _counts binary, _nodes binary"
# Edges ``x`` to ``x + n`` of a document are those from ``y`` on of the owner ``s``, inside its piece that starts at
# ``piece``; a row without a document is a piece, and its ``n`` edges start there.
_FOUND = "_id long, _sum long, _x int, _n int, _s_id long, _s_sum long, _y int, _piece int"
_RUN_NAMES, _FOUND_NAMES = ([x.split()[0] for x in columns.split(", ")] for columns in (_RUNS, _FOUND))


def _nodes(data: np.ndarray, offsets: np.ndarray, window: int, anchor: int):
    """Row, place, hash and minimizer of the nodes of a slice, in rows that have an edge."""
    words = Words(data, offsets)
    count = np.where(words.count >= window, words.count - window + 2, 0)
    row = np.repeat(np.arange(len(count)), count)
    at = expand(np.zeros(len(count), np.int64), count)
    start = words.first[row] + at
    if not len(start):
        return row, at, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    rolling = word_rolling(words.hashes())
    every = np.arange(len(words.start) - anchor + 1)
    grams = rolling.span(every, every + anchor)
    least = minimizers(mix(grams), start, window - anchor, 32)
    return row, at, rolling.span(start, start + window - 1), grams[least]


def _found_batch(ids, sums, x, n, s_ids, s_sums, y, piece) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    values = (ids, sums, x, n, s_ids, s_sums, y, piece)
    return pa.RecordBatch.from_arrays([pa.nulls(len(x), k) if v is None else pa.array(v, k) for v, k in zip(values, kinds)], names=_FOUND_NAMES)


def _map_edges(window: int, anchor: int, parts: int):
    """The edges of a batch that no smaller id of the batch has, as runs; and where the others are found there."""

    def run(batches):
        for batch in batches:
            known = np.asarray(batch.column(0).is_valid())
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = batch.column(1).to_numpy()
            data, offsets = text_buffers(batch.column(2))
            for i, j in row_slices(offsets, _BATCH_BYTES):
                got = []
                for a, b in row_slices(offsets[i : j + 1]):
                    a, b = a + i, b + i
                    row, at, node, mini = _nodes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], window, anchor)
                    use = known[row + a]
                    got.append((row[use] + a, at[use], node[use], mini[use]))
                row, at, node, mini = (np.concatenate(x) for x in zip(*got))
                if len(row):
                    yield from _batch_edges(ids, sums, row, at, node, mini, parts)

    return run


def _batch_edges(ids, sums, row, at, node, mini, parts: int):
    # Edge k leads from node tail[k] to the next one.
    tail = np.flatnonzero(row[1:] == row[:-1])
    key = mix(node[tail] + mix(node[tail + 1]))
    doc = ids[row[tail]]
    order = np.lexsort((at[tail], row[tail], doc, key))
    head = np.ones(len(order), bool)
    head[1:] = key[order[1:]] != key[order[:-1]]
    first = np.flatnonzero(head)
    group = np.cumsum(head) - 1
    least = order[first]
    redundant, sure = np.zeros(len(order), bool), np.zeros(len(order), bool)
    redundant[order] = doc[order] > doc[least][group]
    sure[least] = np.bitwise_or.reduceat(redundant[order], first)
    source = np.zeros(len(order), np.int64)
    source[order] = least[group]
    # Stretches that follow one source: of the batch's own findings.
    own = np.flatnonzero(redundant)
    if len(own):
        new = np.ones(len(own), bool)
        new[1:] = (np.diff(own) != 1) | (np.diff(source[own]) != 1) | (np.diff(row[tail[own]]) != 0) | (np.diff(row[tail[source[own]]]) != 0)
        begin = np.flatnonzero(new)
        d, s = tail[own[begin]], tail[source[own[begin]]]
        n = np.diff(np.append(begin, len(own)))
        facts = np.stack([ids[row[d]], sums[row[d]], at[d], n, ids[row[s]], sums[row[s]], at[s]], 1).astype(np.int64)
        # They ride to some partition, which passes them on.
        by, bounds = grouped_slices((sums[row[d]].view(np.uint64) % np.uint64(parts)).astype(np.int64), parts)
        to = np.flatnonzero(np.diff(bounds))
        rides = pa.array([pack(facts[by[bounds[p] : bounds[p + 1]]]) for p in to], pa.binary())
        nothing = [pa.nulls(len(to), pa.binary())] * 5
        yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), *nothing, rides], names=_RUN_NAMES)
    # A run: consecutive edges to send, all of whose inner nodes have one minimizer.  An edge between two minimizers
    # stands in both runs.
    edges = np.flatnonzero(~redundant)
    left, right = mini[tail[edges]], mini[tail[edges] + 1]
    twice = left != right
    where = np.repeat(edges, 1 + twice)
    second = np.zeros(len(where), bool)
    second[np.cumsum(1 + twice)[twice] - 1] = True
    home = np.where(second, mini[tail[where] + 1], mini[tail[where]])
    new = np.ones(len(where), bool)
    new[1:] = (np.diff(where) != 1) | (np.diff(row[tail[where]]) != 0) | (home[1:] != home[:-1]) | (sure[where[1:]] != sure[where[:-1]])
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(where)))
    f = tail[where[begin]]
    owner = (mix(home[begin]) % np.uint64(parts)).astype(np.int64)
    by, bounds = grouped_slices(owner, parts)
    # Bit 0: repeated for sure; bit 1: the last node belongs here.
    flags = sure[where[begin]] + 2 * (mini[f + n] == home[begin])
    short = node.view(np.uint8).reshape(-1, 8)[:, :_NODE_BYTES]
    columns: list[list] = [[] for _ in range(7)]
    for p in np.flatnonzero(np.diff(bounds)):
        k = by[bounds[p] : bounds[p + 1]]
        values = (
            int(p),
            pack(home[begin[k]]),
            pack(ids[row[f[k]]].astype(np.int64)),
            pack(sums[row[f[k]]].astype(np.int64)),
            pack(at[f[k]].astype(np.int32)),
            pack((n[k] * 4 + flags[k]).astype(np.int64)),
            pack(short[expand(f[k], n[k] + 1)]),
        )
        for c, v in zip(columns, values):
            c.append(v)
    arrays = [pa.array(columns[0], pa.int32())] + [pa.array(c, pa.binary()) for c in columns[1:]]
    yield pa.RecordBatch.from_arrays(arrays, names=_RUN_NAMES)


def _reduce_edges(batches):
    """Pieces of repeated edges around the nodes of one partition, and where other documents have them."""
    held: list[list] = [[] for _ in range(6)]
    for batch in batches:
        passed = batch.column(1).is_null()
        for facts in batch.filter(passed).column(6).to_pylist():
            yield _found_batch(*np.frombuffer(facts, np.int64).reshape(-1, 7).T, None)
        for k, column in enumerate(batch.filter(pc.invert(passed)).columns[1:7]):
            held[k] += column.to_pylist()
    if not held[0]:
        return
    kinds = (np.uint64, np.int64, np.int64, np.int32, np.int64, np.uint8)
    mini, ids, sums, at, n, short = (np.frombuffer(b"".join(x), t) for x, t in zip(held, kinds))
    held.clear()
    flags, n = n & 3, n >> 2
    node = np.zeros((len(short) // _NODE_BYTES, 8), np.uint8)
    node[:, :_NODE_BYTES] = short.reshape(-1, _NODE_BYTES)
    del short
    node = node.reshape(-1).view(np.uint64)
    run = np.repeat(np.arange(len(n)), n)
    tail = np.arange(len(run)) + run  # a run has one node more than edges
    node = mix(node + mix(mini)[np.repeat(np.arange(len(n)), n + 1)])
    place = at[run] + (np.arange(len(run)) - (np.cumsum(n) - n)[run]).astype(np.int32)
    key = mix(node[tail] + mix(node[tail + 1] ^ np.uint64(1)))
    doc = ids[run]
    order = np.lexsort((place, sums[run], doc, key))
    head = np.ones(len(order), bool)
    head[1:] = key[order[1:]] != key[order[:-1]]
    group = np.cumsum(head) - 1
    owner = order[head]
    later = doc[order] > doc[owner][group]
    repeated = np.bitwise_or.reduceat(later | (flags[run[order]] & 1 > 0), np.flatnonzero(head))
    edge = owner[repeated]  # one occurrence, the owner's, of each distinct repeated edge
    if not len(edge):
        return
    # Degrees of the nodes, over distinct repeated edges.
    heads, tails = node[tail[edge] + 1], node[tail[edge]]
    _, rank = np.unique(np.concatenate([tails, heads]), return_inverse=True)
    leaving = np.bincount(rank[: len(edge)], minlength=rank.max() + 1)
    entering = np.bincount(rank[len(edge) :], minlength=rank.max() + 1)
    through = (leaving == 1) & (entering == 1)
    # The head node of an edge is ours unless it is the last one of its run and marked foreign.
    ours = (tail[edge] + 1 != (np.cumsum(n + 1) - 1)[run[edge]]) | (flags[run[edge]] & 2 > 0)
    joined_ahead = through[rank[len(edge) :]] & ours
    by = np.lexsort((place[edge], sums[run[edge]], doc[edge], mini[run[edge]]))
    e = edge[by]
    new = np.ones(len(e), bool)
    new[1:] = (doc[e[1:]] != doc[e[:-1]]) | (sums[run[e[1:]]] != sums[run[e[:-1]]]) | (place[e[1:]] != place[e[:-1]] + 1)
    new[1:] |= ~joined_ahead[by][:-1] | (node[tail[e[1:]]] != node[tail[e[:-1]] + 1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(e)))
    piece = np.zeros(len(order), np.int32)
    piece[e] = place[e[begin]][np.cumsum(new) - 1]
    k = e[begin]
    yield _found_batch(None, None, place[k], size, doc[k], sums[run[k]], place[k], place[k])
    # Occurrences in documents of a later id, cut where the piece or the step along it changes.
    of = np.zeros(len(order), np.int64)
    of[order] = owner[group]
    late = np.zeros(len(order), bool)
    late[order] = later & repeated[group]
    own = np.flatnonzero(late)
    if not len(own):
        return
    s = of[own]
    new = np.ones(len(own), bool)
    new[1:] = (np.diff(own) != 1) | (run[own[1:]] != run[own[:-1]]) | (np.diff(place[s]) != 1)
    new[1:] |= (doc[s[1:]] != doc[s[:-1]]) | (sums[run[s[1:]]] != sums[run[s[:-1]]]) | (piece[s[1:]] != piece[s[:-1]])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(own)))
    d, s = own[begin], s[begin]
    yield _found_batch(doc[d], sums[run[d]], place[d], size, doc[s], sums[run[s]], place[s], piece[s])


def compact_paths(pieces: DataFrame) -> DataFrame:
    """``_s_id, _s_sum, _piece, _path``: for the start of every piece, that of the nonbranching path it lies on.

    Pieces (``_s_id, _s_sum, _piece, _n``) follow each other if the last edge of one is the first of the next, which a
    join finds.  Paths of one owner don't overlap, so a piece that follows another lies on the path that began last
    before it; an owner's pieces are bounded by its length.
    """
    key = ["_s_id", "_s_sum"]
    # Both partitions of an edge may begin a piece with it; the longer one goes on.
    pieces = pieces.groupBy(*key, "_piece").agg(F.max("_n").alias("_n"))
    ends = pieces.where("_n > 1").select(*key, (F.col("_piece") + F.col("_n") - 1).alias("_piece"), F.lit(True).alias("_follows"))
    joined = pieces.join(ends.distinct(), [*key, "_piece"], "left")
    begins = F.when(F.col("_follows").isNull(), F.col("_piece"))
    along = Window.partitionBy(*key).orderBy("_piece")
    return joined.select(*key, "_piece", F.last(begins, ignorenulls=True).over(along).alias("_path"))


def _digests(window: int, keep_text: bool):
    """SHA-256 of the words of the asked spans of each document; the words of documents without one are done with."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, asked in zip(batch.column(2), batch.column(3)):
                words = text.as_buffer().to_pybytes().split()
                open_ = asked.is_valid
                found = []
                if open_:
                    for x, n in zip(asked.values.field(0).to_pylist(), asked.values.field(1).to_pylist()):
                        found.append({"_x": x, "_n": n, "_digest": hashlib.sha256(b" ".join(words[x : x + n + window - 1])).digest()})
                whole = b" ".join(words) if not open_ else b""
                for c, v in zip(out, (open_, found, len(words), None if open_ else hashlib.sha256(whole).hexdigest(), None if open_ or not keep_text else whole.decode())):
                    c.append(v)
            kinds = [pa.bool_(), pa.list_(pa.struct([("_x", pa.int32()), ("_n", pa.int32()), ("_digest", pa.binary())])), pa.int64(), pa.string(), pa.string()]
            ids, sums, texts, _, rest = batch.columns
            text = pc.if_else(pa.array(out[0]), texts, pa.scalar(None, texts.type))
            arrays = [ids, sums, text, rest, *(pa.array(c, k) for c, k in zip(out, kinds))]
            yield pa.RecordBatch.from_arrays(arrays, names=["_id", "_sum", "_text", "_rest", "_open", "_digests", "n_words", "kept_sha256", "kept_text"])

    return run


_MET = "_open boolean, _digests array<struct<_x:int,_n:int,_digest:binary>>, n_words long, kept_sha256 string, kept_text string"


def _lay(window: int, keep_text: bool):
    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, spans in zip(batch.column(1), batch.column(2)):
                words = text.as_buffer().to_pybytes().split()
                kept, at, gone = [], 0, 0
                if spans.is_valid:
                    start = spans.values.field(0).to_numpy().astype(np.int64)
                    stop = start + spans.values.field(1).to_numpy() + window - 1
                    for s, e in zip(*(x.tolist() for x in runs(start, stop))):
                        kept += words[at:s]
                        gone += e - s
                        at = e
                kept = b" ".join(kept + words[at:])
                for c, v in zip(out, (len(words), gone, hashlib.sha256(kept).hexdigest(), kept.decode() if keep_text else None)):
                    c.append(v)
            arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in out[:2]), *(pa.array(c, pa.string()) for c in out[2:])]
            yield pa.RecordBatch.from_arrays(arrays, names=["_rest", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def repeated_edges(rows: DataFrame, window: int, anchor: int, parts: int) -> DataFrame:
    """Pieces and occurrences (see ``_FOUND``) of the repeated edges of ``rows`` (see ``keyed``)."""
    edges = rows.select("_id", "_sum", "_text").mapInArrow(_map_edges(window, anchor, parts), _RUNS)
    return edges.repartitionById(parts, "_part").mapInArrow(_reduce_edges, _FOUND)


def long_spans(found: DataFrame, paths: DataFrame) -> DataFrame:
    """``_id, _sum, _x, _n, _s_id, _s_sum, _y``: unbroken stretches of a document along one path of its owner."""
    on_path = found.join(paths, ["_s_id", "_s_sum", "_piece"]).withColumn("_step", F.col("_x") - F.col("_y"))
    line = Window.partitionBy("_id", "_sum", "_s_id", "_s_sum", "_path", "_step").orderBy("_x")
    reach = F.max(F.col("_x") + F.col("_n")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    marked = on_path.withColumn("_new", (F.coalesce(reach, F.lit(-1)) < F.col("_x")).cast("int"))
    numbered = marked.withColumn("_stretch", F.sum("_new").over(line))
    merged = numbered.groupBy("_id", "_sum", "_s_id", "_s_sum", "_path", "_step", "_stretch").agg(
        F.min("_x").alias("_x"), (F.max(F.col("_x") + F.col("_n")) - F.min("_x")).alias("_n")
    )
    return merged.select("_id", "_sum", "_x", "_n", "_s_id", "_s_sum", (F.col("_x") - F.col("_step")).alias("_y"))


def remove_repeated_words(
    docs: DataFrame, window: int = 50, anchor: int = 26, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False
) -> DataFrame:
    """One row a document: id, n_words, n_removed, kept_sha256, and with ``keep_text`` the kept words."""
    parts, scratch = partitions_for(docs), Scratch(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    found = scratch.write(repeated_edges(rows, window, anchor, parts), free=True)
    there = found.where("_id is not null")
    here, owners = ["_id", "_sum", "_x", "_n"], ["_s_id", "_s_sum", "_y", "_n"]
    asked = there.select(*here).union(there.select(*owners)).distinct()
    asked = asked.groupBy("_id", "_sum").agg(F.collect_list(F.struct("_x", "_n")).alias("_asked"))
    joined = rows.join(asked, ["_id", "_sum"], "left").select("_id", "_sum", "_text", "_asked", "_rest")
    key, total, text, _, rest = joined.schema.fields
    schema = StructType([key, total, StructField("_text", StringType()), rest, *StructType.fromDDL(_MET).fields])
    met = scratch.write(joined.mapInArrow(_digests(window, keep_text), schema), free=True)
    digests = met.where("_open").select("_id", "_sum", F.explode("_digests").alias("_d")).select("_id", "_sum", "_d.*").distinct()
    of_owners = digests.select(*[F.col(c).alias(o) for c, o in zip(here, owners)], F.col("_digest").alias("_s_digest"))
    agreed = there.join(digests, here).join(of_owners, owners).where("_digest = _s_digest")
    paths = compact_paths(found.where("_id is null").select("_s_id", "_s_sum", "_piece", "_n"))
    spans = long_spans(agreed.where("_piece is not null"), paths).select(*here)
    spans = spans.unionByName(agreed.where("_piece is null").select(*here))
    spans = spans.groupBy("_id", "_sum").agg(F.collect_set(F.struct("_x", "_n")).alias("_spans"))
    laid = met.where("_open").join(spans, ["_id", "_sum"], "left").select("_rest", "_text", "_spans")
    result = StructType([rest]).add("n_words", LongType()).add("n_removed", LongType()).add("kept_sha256", StringType()).add("kept_text", StringType())
    done = met.where("not _open").select("_rest", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", "kept_text")
    both = laid.mapInArrow(_lay(window, keep_text), result).unionByName(done)
    columns = ["n_words", "n_removed", "kept_sha256", *(["kept_text"] if keep_text else [])]
    return both.select(F.col("_rest.c0").alias(id_col), *columns)
