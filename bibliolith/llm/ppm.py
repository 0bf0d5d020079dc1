"""Language-model scores by partial matching (PPM): a trie of byte contexts, escapes and symbol exclusion.

A text, ASCII lower-cased, is coded byte by byte and closed by an end symbol.  The longest context (up to ``order`` bytes)
that the training texts have is asked first; if it hasn't seen the byte, an escape leads to the next shorter one, whose
estimate leaves out every symbol that the longer one knew; below the empty context all symbols left are equally likely.
Escapes are estimated by method D: with T occurrences and q distinct symbols that are not excluded, a symbol seen c times
has (2c - 1) / 2T, the escape q / 2T.

*The trie over Spark.*  It is not broadcast: it grows with the corpus.  It is the table of strings of order + 1 bytes with
their counts in training texts; shorter contexts are sums over it, since texts start behind ``order`` start symbols.  What a
byte costs depends on its string alone, so texts are dealt in blocks, a block asks once for each of its strings, and

1. a pass writes the texts by block, another each block's distinct strings and words with their training counts;
2. counts meet by string (partial sums first), and strings by the last two bytes of their context: there all nodes of order
   2 and more that they need lie together.  Orders 0 and 1 have at most 256 x 256 cells and are broadcast;
3. costs go back to the blocks that asked (the texts lie in buckets of blocks, and don't move), and a block looks its positions up and adds them for each document.

A unigram baseline over words is counted by the same requests: words and one end a document, additively smoothed.

``adaptive_lengths`` has the other form: each text codes itself, from an empty trie that learns byte by byte; it is a plain
loop and meant for modest tables.

Defined cases: a null text is empty and codes its end alone; repeated rows are each scored (and learned from); null ids are
scored, never learned from and not held out; without training texts all symbols are equally likely; a text of any
length is coded whole, in stretches; an empty table gives no rows; other columns are ignored.  Words are told apart by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import partitions_for
from .store import Scratch
from .textkit import LOWER, Words, row_slices, text_buffers

EDGE = 255  # stands in no UTF-8 text: starts and ends
SYMBOLS = 256
STRETCH = 1 << 20
_END_WORD = np.uint64(0)  # what an empty span hashes to; no word is empty
_U64 = np.uint64


class Coded:
    """Rows of a slice as one stream of symbols: ``order`` starts, the bytes and the end of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, order: int):
        n = len(offsets) - 1
        self.order, self.first = order, offsets + np.arange(n + 1) * (order + 1)
        self.stream = np.full(int(self.first[-1]), EDGE, np.uint8)
        held = np.ones(len(self.stream), bool)
        for k in range(order):
            held[self.first[:-1] + k] = False
        self.held = held.copy()
        held[self.first[1:] - 1] = False
        self.stream[held] = LOWER[data]

    def stretches(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Strings of order + 1 symbols as integers, the last symbol lowest, and the row each ends in."""
        for a in range(0, len(self.stream), STRETCH):
            b = min(a + STRETCH, len(self.stream))
            at = np.flatnonzero(self.held[a:b]) + a
            gram = np.zeros(len(at), _U64)
            for k in range(self.order, -1, -1):
                gram = (gram << _U64(8)) | self.stream[at - k]
            low, high = np.searchsorted(self.first, (a, b - 1), "right") - 1
            bounds = np.searchsorted(at, self.first[low : high + 2])
            yield gram, np.repeat(np.arange(low, high + 1), np.diff(bounds))


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their counts."""
    if not keys:
        return np.zeros(0, _U64), np.zeros(0, np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts)
    by = np.argsort(key)
    key = key[by]
    lead = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[lead], np.add.reduceat(count[by], lead) if len(key) else count


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    lead = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[lead], np.diff(lead, append=len(keys))


class Requests:
    """The distinct strings and words of a block and how often its training rows have them."""

    def __init__(self, order: int):
        self.order = order
        self.found: dict[int, tuple[list, list]] = {0: ([], []), 1: ([], [])}
        self.pending = 0

    def _take(self, kind: int, keys: np.ndarray, learn: bool) -> None:
        key, count = _counted(keys)
        self.found[kind][0].append(key)
        self.found[kind][1].append(count if learn else np.zeros(len(key), np.int64))
        self.pending += len(key)
        if self.pending > 4 << 20:
            self.found = {k: tuple([x] for x in _merged(*v)) for k, v in self.found.items()}
            self.pending = 0

    def add(self, data: np.ndarray, offsets: np.ndarray, learn: np.ndarray) -> None:
        for gram, row in Coded(data, offsets, self.order).stretches():
            for told in (True, False):
                self._take(0, gram[learn[row] == told], told)
        words = Words(data, offsets, lower=True)
        hashes, of_row = words.hashes(), words.row
        for told in (True, False):
            ends = np.full(np.count_nonzero(learn == told), _END_WORD, _U64)
            self._take(1, np.concatenate([hashes[learn[of_row] == told], ends]), told)

    def batch(self, block: int) -> pa.RecordBatch:
        parts = {k: _merged(*v) for k, v in self.found.items()}
        kind = np.repeat(np.array([0, 1], np.int8), [len(parts[0][0]), len(parts[1][0])])
        key, count = (np.concatenate([parts[0][k], parts[1][k]]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), block)), pa.array(kind), pa.array(key.view(np.int64)), pa.array(count)], names=["block", "kind", "key", "count"])


def _nodes(grams: np.ndarray, counts: np.ndarray, order: int, k: int) -> tuple[np.ndarray, ...]:
    """Order k of the trie: (context, symbol) cells with counts, sorted; contexts with occurrences and distinct symbols."""
    mask = _U64((1 << (8 * (k + 1))) - 1)
    cell, c = _merged([grams & mask], [counts])
    cell, c = cell[c > 0], c[c > 0]
    node, total = _merged([cell >> _U64(8)], [c])
    return cell, c, node, total, np.diff(np.searchsorted(cell >> _U64(8), node), append=len(cell))


def _look(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys and whether they are there."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


def string_costs(grams: np.ndarray, levels: list[tuple[np.ndarray, ...]]) -> np.ndarray:
    """log10 of the probability of the last symbol of each string; ``levels`` are the nodes of the orders from 0."""
    out, done = np.zeros(len(grams)), np.zeros(len(grams), bool)
    for k in range(len(levels) - 1, -1, -1):
        cell, count, node, total, distinct = levels[k]
        own = grams & _U64((1 << (8 * (k + 1))) - 1)
        if not len(node):
            continue
        at, there = _look(node, own >> _U64(8))
        t, q = total[at].astype(np.int64), distinct[at].astype(np.int64)
        if k + 1 < len(levels) and len(levels[k + 1][2]):
            # Symbols of a longer context's node are symbols of this one's: what it excludes is summed once for each node.
            longer, _, parent, _, _ = levels[k + 1]
            shorter, found = _look(cell, longer & _U64((1 << (8 * (k + 1))) - 1))
            away = np.bincount(np.searchsorted(parent, longer >> _U64(8)), np.where(found, count[shorter], 0), len(parent)).astype(np.int64)
            above, held = _look(parent, grams >> _U64(8) & _U64((1 << (8 * (k + 1))) - 1))
            t = t - np.where(held, away[above], 0)
            q = q - np.where(held, levels[k + 1][4][above], 0)
        where, seen = _look(cell, own)
        ask = there & ~done & (t > 0)
        hit, miss = ask & seen, ask & ~seen
        c, of = count[where[hit]], t[hit]
        if k == 0 and len(cell) >= SYMBOLS:  # no symbol is left to escape to
            out[hit] += np.log10(c / of)
        else:
            out[hit] += np.log10((2 * c - 1) / (2 * of))
        out[miss] += np.log10(q[miss] / (2 * t[miss]))
        done |= hit
    left = SYMBOLS - (len(levels[0][0]) if levels else 0)
    out[~done] -= np.log10(max(left, 1))
    return out


def score_documents(
    docs: DataFrame, learn_from: F.Column, order: int = 5, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 64 << 20
) -> DataFrame:
    """A row a document: id, ``learned`` (whether the model was trained on it), ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score`` (log10).  ``learn_from`` is a condition on ``_id``."""
    if not 2 <= order <= 7:
        raise ValueError("order must be 2 to 7")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    width = partitions_for(docs)

    told = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    told = told.select("_id", F.coalesce(learn_from, F.lit(False)).alias("_learn"), "_text", F.spark_partition_id().cast("long").alias("_part"))

    def deal(batches):
        """Numbers of blocks: a task's rows in turn, as far as they fill a block."""
        before = 0
        for batch in batches:
            if batch.num_rows:
                _, offsets = text_buffers(batch.column(2))
                step = (before + offsets[:-1]) // block_bytes
                before += int(offsets[-1])
                yield pa.RecordBatch.from_arrays([pa.array((batch.column(3).to_numpy() << 32) + step), *batch.columns[:3]], names=["block", "_id", "_learn", "_text"])

    dealt = told.mapInArrow(deal, f"block long, _id {id_type}, _learn boolean, _text string")
    dealt = scratch.write_buckets(dealt, "block", width)

    def ask(batches):
        held: Requests | None = None
        block = -1
        for batch in batches:
            if not batch.num_rows:
                continue
            of, learn = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            data, offsets = text_buffers(batch.column(2))
            bounds = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(bounds[:-1], bounds[1:]):
                if of[a] != block:
                    if held is not None:
                        yield held.batch(block)
                    held, block = Requests(order), int(of[a])
                for i, j in row_slices(offsets[a : b + 1]):
                    i, j = a + i, a + j
                    held.add(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], learn[i:j])
        if held is not None:
            yield held.batch(block)

    asked = scratch.write(dealt.select("block", "_learn", "_text").mapInArrow(ask, "block long, kind byte, key long, count long"))
    counts = scratch.write(asked.groupBy("kind", "key").agg(F.sum("count").alias("count")))
    total, distinct = counts.where("kind = 1").agg(F.coalesce(F.sum("count"), F.lit(0)), F.count_if(F.col("count") > 0)).first()
    low = counts.where("kind = 0 and count > 0").groupBy(F.col("key").bitwiseAND(F.lit(0xFFFF)).alias("cell")).agg(F.sum("count").alias("count")).collect()  # at most 65,536
    cells = np.array([r["cell"] for r in low], np.int64).astype(_U64), np.array([r["count"] for r in low], np.int64)
    shared = spark.sparkContext.broadcast([_nodes(*cells, order, k) for k in (0, 1)])

    def price(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            key = np.concatenate([b.column(0).to_numpy() for b in got])
            count = np.concatenate([b.column(1).to_numpy() for b in got])
            grams = key.view(_U64)
            levels = shared.value + [_nodes(grams[count > 0], count[count > 0], order, k) for k in range(2, order + 1)]
            cost = string_costs(grams, levels)
            for a in range(0, len(key), STRETCH):
                part = slice(a, a + STRETCH)
                yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(cost[part])], names=["key", "cost"])

    near = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(0xFFFF))
    strings = counts.where("kind = 0").select("key", "count").repartition(width, near).mapInArrow(price, "key long, cost double")
    smooth = F.lit(float(total) + 0.1 * (distinct + 1))
    of_word = counts.where("kind = 1").select(F.lit(1).cast("byte").alias("kind"), "key", F.log10((F.col("count") + 0.1) / smooth).alias("cost"))
    costs = scratch.write(strings.select(F.lit(0).cast("byte").alias("kind"), "key", "cost").unionByName(of_word))
    answers = asked.select("block", "kind", "key").join(costs, ["kind", "key"]).select("block", "kind", "key", "cost")
    unseen = float(np.log10(0.5 / (total + 0.1 * (distinct + 1))))  # between the cost of a word never met and of one met once

    def add(texts: pa.Table, told: pa.Table) -> pa.Table:
        kind, key = told.column("kind").to_numpy(), told.column("key").to_numpy().view(_U64)
        cost = told.column("cost").to_numpy()
        tables = []
        for k in (0, 1):
            own = np.flatnonzero(kind == k)
            own = own[np.argsort(key[own])]
            tables.append((key[own], cost[own]))
        (grams, of_gram), (hashes, of_hash) = tables
        data, offsets = text_buffers(texts.column("_text"))
        n = len(offsets) - 1
        out = {"n_tokens": np.zeros(n, np.int64), "n_known": np.zeros(n, np.int64), "base_score": np.zeros(n), "score": np.zeros(n)}
        for i, j in row_slices(offsets):
            part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            for gram, row in Coded(part, own, order).stretches():
                out["score"][i:j] += np.bincount(row, of_gram[np.searchsorted(grams, gram)], j - i)
            words = Words(part, own, lower=True)
            row = np.concatenate([words.row, np.arange(j - i)])
            at = np.searchsorted(hashes, np.append(words.hashes(), np.full(j - i, _END_WORD, _U64)))
            out["n_tokens"][i:j] = words.count + 1
            out["n_known"][i:j] = np.bincount(row, of_hash[at] > unseen, j - i)
            out["base_score"][i:j] = np.bincount(row, of_hash[at], j - i)
        return pa.table({"_id": texts.column("_id"), "_learn": texts.column("_learn"), **{k: pa.array(v) for k, v in out.items()}})

    schema = f"_id {id_type}, _learn boolean, n_tokens long, n_known long, base_score double, score double"
    scored = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add, schema)
    return scored.select(
        F.col("_id").alias(id_col), F.col("_learn").alias("learned"), "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score"
    )


class AdaptiveTrie:
    """A byte-context trie that learns each symbol after coding it; the same estimates as the trained one."""

    def __init__(self, order: int):
        self.order, self.nodes = order, {}

    def code(self, context: bytes, symbol: int) -> float:
        """log10 of the symbol's probability behind ``context``; learns nothing."""
        out, gone = 0.0, frozenset()
        for k in range(self.order, -1, -1):
            node = self.nodes.get(context[len(context) - k :])
            if node is None:
                continue
            left = {s: c for s, c in node.items() if s not in gone}
            if not left:
                continue
            total = sum(left.values())
            if symbol in left:
                full = k == 0 and len(node) >= SYMBOLS
                return out + float(np.log10(left[symbol] / total if full else (2 * left[symbol] - 1) / (2 * total)))
            out += float(np.log10(len(left) / (2 * total)))
            gone = frozenset(node)
        return out - float(np.log10(max(SYMBOLS - len(gone), 1)))

    def learn(self, context: bytes, symbol: int) -> None:
        for k in range(self.order + 1):
            node = self.nodes.setdefault(context[len(context) - k :], {})
            node[symbol] = node.get(symbol, 0) + 1

    def length(self, text: bytes, code: bool = True, learn: bool = True) -> float:
        stream = bytes([EDGE] * self.order) + text.lower() + bytes([EDGE])
        total = 0.0
        for at in range(self.order, len(stream)):
            context, symbol = stream[at - self.order : at], stream[at]
            if code:
                total += self.code(context, symbol)
            if learn:
                self.learn(context, symbol)
        return total


def adaptive_lengths(docs: DataFrame, order: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score``: log10 of the probability of each text under a trie that starts empty and learns from the text itself."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([AdaptiveTrie(order).length((t or "").encode()) for t in texts], pa.float64())], names=[id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")
