"""Quality rules from line labels: a linear-chain CRF marks each line content or boilerplate.

Every line of a document (split at line feeds) gets about a dozen binned features: length,
shares of capitals, digits, signs and separators, variety of its words, whether it repeats an
earlier line, and so on.  The CRF has two states; Viterbi decoding finds the best sequence of
labels, and the share of the document's words that stand in content lines decides.

Training is weakly supervised: the lines of a labelled document carry its quality label, but a
line that repeats an earlier one is boilerplate.  The weights, a few hundred numbers, maximise
the regularised likelihood (forward-backward, AdaGrad) on a seeded sample of about ``max_train_rows``
labelled documents, in stretches of 64 lines, ``max_train_lines`` together and at most
``max_document_lines`` of one document; decoding covers every line of every document.

Defined cases: a null text has no words; empty lines take part in the sequence and weigh
nothing; a document without words fails the base rules; without labels of both classes every
line is content; repeated rows are each judged; a text of any length is decoded whole, and is
learned from by some of its stretches; of labels that tie in Viterbi decoding boilerplate wins;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from .store import Scratch
from .textkit import LOWER, Words, byte_rolling, mix, row_slices, text_buffers, windows, word_rolling

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_LEAD = np.ones(256, bool)
_LEAD[128:192] = False

_SHARES = (0.02, 0.08, 0.2, 0.4, 0.7)
GROUPS = ("words", "upper", "digit", "mark", "symbol", "bar", "variety", "word_chars", "ending", "again", "place", "bias")
WIDTH = 10
N_FEATURES = len(GROUPS) * WIDTH
STRETCH = 64
LEAST_OF_A_CLASS = 100


class Lines:
    """Lines of the rows of a slice: byte ranges, rows, and the index of each row's first line."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        feeds = np.flatnonzero(data == 10)
        of_feed = np.searchsorted(offsets, feeds, "right") - 1
        own = np.arange(len(offsets) - 1)
        self.row = np.sort(np.concatenate([own, of_feed]))
        # Sorted by row first: rows without bytes share their offset with the next.
        starts, ends = np.concatenate([offsets[:-1], feeds + 1]), np.concatenate([feeds, offsets[1:]])
        self.start = starts[np.lexsort((starts, np.concatenate([own, of_feed])))]
        self.end = ends[np.lexsort((ends, np.concatenate([of_feed, own])))]
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))


def _inside(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[end] - total[start]


def _repeats_earlier(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether an item's key occurs earlier in its group; items are in order."""
    order = np.lexsort((key, group))
    again = np.zeros(len(order), bool)
    again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (group[order[1:]] == group[order[:-1]])
    return again


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """Base counts of each row; features, word counts and first lines of its lines."""
    words = Words(data, offsets)
    lines = Lines(data, offsets)
    hashes = words.hashes()
    n_rows = len(offsets) - 1
    row = words.row

    line_words = np.searchsorted(words.start, lines.end) - np.searchsorted(words.start, lines.start)
    again = _repeats_earlier(lines.row, byte_rolling(data).span(lines.start, lines.end)) & (line_words > 0)

    start, of = windows(words.count, words.first, 3)
    key = word_rolling(hashes).span(start, start + 3)
    order = np.lexsort((key, of))
    equal = (key[order[1:]] == key[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
    twice = np.zeros(len(order), bool)
    twice[order[1:]] |= equal
    twice[order[:-1]] |= equal
    covered = np.zeros(len(hashes), bool)
    hit = start[twice]
    for k in range(3):
        covered[hit + k] = True

    def total(at, weights):
        return np.bincount(at, weights, n_rows).astype(np.int64)

    chars = _inside(_LEAD[data], words.start, words.end)
    base = {
        "n_words": words.count.astype(np.int64),
        "word_chars": total(row, chars),
        "n_symbols": _inside(SYMBOLS[data], offsets[:-1], offsets[1:]).astype(np.int64),
        "n_dup_lines": total(lines.row, again),
        "n_repeat_words": total(row, covered),
    }

    size = np.maximum(lines.end - lines.start, 1)
    line_of = np.searchsorted(lines.start, words.start, "right") - 1
    # Lines without bytes share their start with the next one: a word belongs to the last of them.
    fresh = ~_repeats_earlier(line_of, mix(byte_rolling(LOWER[data]).span(words.start, words.end)))
    variety = np.bincount(line_of, fresh, len(size)) / np.maximum(line_words, 1)
    mean_chars = np.bincount(line_of, chars, len(size)) / np.maximum(line_words, 1)
    last = data[np.maximum(lines.end - 1, 0)] if len(data) else np.zeros(len(size), np.uint8)
    ending = np.select([last == 46, (last == 33) | (last == 63), last == 124, _MARK[last], _DIGIT[last]], [1, 2, 3, 4, 5], 0)
    place = np.arange(len(size)) - lines.first[lines.row]
    only = np.diff(lines.first)[lines.row] == 1
    bins = [
        np.minimum(np.ceil(np.log2(line_words + 1)), WIDTH - 1),
        *(np.searchsorted(_SHARES, _inside(kind[data], lines.start, lines.end) / size) for kind in (_UPPER, _DIGIT, _MARK)),
        np.searchsorted(_SHARES, _inside(SYMBOLS[data], lines.start, lines.end) / size),
        np.searchsorted(_SHARES, _inside(data == 124, lines.start, lines.end) / np.maximum(line_words, 1)),
        np.minimum((variety * 8).astype(int), WIDTH - 1),
        np.minimum(mean_chars, WIDTH - 1),
        np.where(lines.end > lines.start, ending, 6),
        again.astype(int),
        np.where(only, 2, np.where(place == 0, 0, 1)),
        np.zeros(len(size)),
    ]
    features = np.stack([b.astype(np.int16) + g * WIDTH for g, b in enumerate(bins)], axis=1)
    return base, features, line_words, lines.first


def viterbi(emission: np.ndarray, transition: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best label of every line; all rows are decoded side by side, line by line."""
    n = np.diff(first)
    score = np.zeros((len(n), 2))
    back = np.zeros((len(emission), 2), np.int8)
    order = np.argsort(-n, kind="stable")
    active = np.searchsorted(-n[order], -np.arange(int(n.max()) if len(n) else 0), "left")
    for t, k in enumerate(active.tolist()):
        rows = order[:k]
        at = first[rows] + t
        if t == 0:
            score[rows] = emission[at]
            continue
        step = score[rows][:, :, None] + transition[None]
        back[at] = step.argmax(axis=1)
        score[rows] = step.max(axis=1) + emission[at]
    label = np.zeros(len(emission), np.int8)
    for t in range(len(active) - 1, -1, -1):
        rows = order[: active[t]]
        at = first[rows] + t
        ends = n[rows] == t + 1
        label[at] = np.where(ends, score[rows].argmax(axis=1), label[at])
        if t:
            label[at - 1] = back[at, label[at]]
    return label


def crf_gradient(weights: np.ndarray, transition: np.ndarray, features: np.ndarray, labels: np.ndarray, inside: np.ndarray):
    """Negative log-likelihood of stretches of lines and its gradients, summed over lines.

    ``features`` is (stretch, line, group); ``inside`` says which lines there are, the first ones of each stretch.
    All stretches go forward and backward side by side.
    """
    emission = weights[features].sum(axis=2)
    stretches, longest = inside.shape
    ahead, behind = emission.copy(), np.zeros_like(emission)
    for t in range(1, longest):
        step = np.logaddexp(ahead[:, t - 1, :1] + transition[0], ahead[:, t - 1, 1:] + transition[1]) + emission[:, t]
        ahead[:, t] = np.where(inside[:, t, None], step, ahead[:, t - 1])
    for t in range(longest - 2, -1, -1):
        after = behind[:, t + 1] + emission[:, t + 1]
        step = np.logaddexp(transition[:, 0] + after[:, :1], transition[:, 1] + after[:, 1:])
        behind[:, t] = np.where(inside[:, t + 1, None], step, 0.0)
    log_z = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
    rows, lines = np.nonzero(inside)
    told = labels[rows, lines]
    error = np.exp((ahead + behind - log_z[:, None, None])[rows, lines])
    error[np.arange(len(told)), told] -= 1
    of_weights = np.zeros_like(weights)
    np.add.at(of_weights, features[rows, lines].ravel(), np.repeat(error, features.shape[2], axis=0))
    loss = log_z.sum() - emission[rows, lines, told].sum()
    rows, lines = np.nonzero(inside[:, 1:])
    left, right = labels[rows, lines], labels[rows, lines + 1]
    pairs = (ahead[:, :-1, :, None] + transition + (emission + behind)[:, 1:, None, :])[rows, lines]
    of_transition = np.exp(pairs - log_z[rows, None, None]).sum(axis=0)
    np.subtract.at(of_transition, (left, right), 1)
    return loss - transition[left, right].sum(), of_weights, of_transition


def _padded(sequences: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(y) for _, y in sequences])
    features = np.zeros((len(size), size.max(), sequences[0][0].shape[1]), np.int64)
    labels, inside = np.zeros(features.shape[:2], np.int64), np.arange(size.max()) < size[:, None]
    for k, (x, y) in enumerate(sequences):
        features[k, : len(y)], labels[k, : len(y)] = x, y
    return features, labels, inside


def fit_crf(sequences: list[tuple[np.ndarray, np.ndarray]], epochs: int = 12, rate: float = 0.3, l2: float = 1e-4, batch: int = 8) -> dict:
    """Maximum likelihood weights from (features, labels) of each sequence, by batches of stretches of up to 64 lines."""
    cut = [(x[i : i + STRETCH], y[i : i + STRETCH]) for x, y in sequences for i in range(0, len(y), STRETCH)]
    weights, transition = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    gw, gt = np.full_like(weights, 1e-8), np.full_like(transition, 1e-8)
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        order = rng.permutation(len(cut))
        for k in range(0, len(order), batch):
            features, labels, inside = _padded([cut[i] for i in order[k : k + batch]])
            _, of_weights, of_transition = crf_gradient(weights, transition, features, labels, inside)
            for values, total, gradient in ((weights, gw, of_weights), (transition, gt, of_transition)):
                gradient = gradient / inside.sum() + l2 * values
                total += gradient * gradient
                values -= rate * gradient / np.sqrt(total)
    return {"weights": weights, "transition": transition}


def fit_line_labels(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_train_rows: int = 3_000,
    max_train_lines: int = 300_000,
    max_document_lines: int = 1_024,
    seed: int = 13,
) -> dict | None:
    """CRF weights, or None if the documents with labels don't hold both classes.

    Learned from about ``max_train_rows`` labelled documents, and at least about ``LEAST_OF_A_CLASS`` of either class (or all
    it has).  A document offers stretches of ``STRETCH`` lines in a seeded order, up to ``max_document_lines``, so that none
    can spend the budget alone.  Its first one is always taken, of the others a seeded share, for ``max_train_lines`` in all.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    known = known.where(F.col("_id").isNotNull() & F.col("_label").isNotNull())
    every = known = known.groupBy("_id").agg((F.min("_label") > 0).cast("int").alias("_label"))
    sizes = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    if len(sizes) < 2:
        return None
    n = sum(sizes.values())
    if n > max_train_rows:
        order = F.pmod(F.xxhash64(F.lit(seed), F.col("_id")), F.lit(1 << 30))
        share = [max(max_train_rows / n, LEAST_OF_A_CLASS / sizes[c]) for c in (0, 1)]
        known = known.where(order < (F.lit(float(1 << 30)) * F.when(F.col("_label") == 1, share[1]).otherwise(share[0])))
    text = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    offered = max(max_document_lines // STRETCH, 1)

    def features(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            seeds = batch.column(3).to_numpy().view(np.uint64)
            rows: list[tuple] = []
            for i, j in row_slices(offsets):
                _, found, _, first = measure(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for k, (a, b) in enumerate(zip(first[:-1], first[1:]), i):
                    draw = mix(seeds[k] + np.arange(-(-(b - a) // STRETCH), dtype=np.uint64))
                    for place, at in enumerate(np.argsort(draw)[:offered].tolist()):
                        part = found[a + at * STRETCH : min(a + (at + 1) * STRETCH, b)]
                        rows.append((k, at, place and float(draw[at] >> np.uint64(11)) / 2**53, len(part), part.tobytes()))
            of, at, draw, size, packed = zip(*rows) if rows else [()] * 5
            of = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(of), pa.array(at, pa.int64()), pa.array(draw, pa.float64()), pa.array(size, pa.int64()), pa.array(packed, pa.binary()), batch.column(2).take(of)],
                names=["_id", "_at", "_draw", "_size", "_lines", "_label"],
            )

    # Both the ids that are broadcast and the stretches that are collected are bounded by the parameters.
    sample = text.join(F.broadcast(known), "_id").select(F.col("_id").cast("string"), "_text", "_label", F.xxhash64(F.lit(seed + 1), "_id").alias("_seed"))
    found = Scratch(docs.sparkSession).write(sample.mapInArrow(features, "_id string, _at long, _draw double, _size long, _lines binary, _label int"))
    sure, rest = found.agg(F.sum(F.when(F.col("_draw") == 0, F.col("_size"))), F.sum(F.when(F.col("_draw") > 0, F.col("_size")))).first()
    share = max(max_train_lines - (sure or 0), 0) / rest if rest else 1.0
    rows = found.where(F.col("_draw") <= share).collect()
    if rows and len({r["_label"] for r in rows}) < 2:
        there = text.select("_id").join(every, "_id").select("_label").distinct().count()
        if there > 1:
            raise ValueError("the sample of labelled documents has lost a class: raise max_train_rows")
        return None
    sequences = []
    for row in sorted(rows, key=lambda r: (r["_id"], r["_at"], r["_lines"])):
        found = np.frombuffer(row["_lines"], np.int16).reshape(-1, len(GROUPS))
        again = found[:, GROUPS.index("again")] % WIDTH == 1
        sequences.append((found, np.where(again, 0, row["_label"]).astype(np.int64)))
    return fit_crf(sequences) if sequences else None


def judge_lines(
    docs: DataFrame,
    model: dict | None,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_content: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row a document: id, the base counts, base_failed, content_share, kept.  Narrow: no row moves."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            parts: list[dict] = []
            for i, j in row_slices(offsets):
                base, features, line_words, first = measure(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                crf = shared.value
                if crf is None:
                    content = np.ones(len(line_words), bool)
                else:
                    content = viterbi(crf["weights"][features].sum(axis=1), crf["transition"], first) == 1
                row = np.repeat(np.arange(j - i), np.diff(first))
                held = np.bincount(row, line_words * content, j - i)
                base["share"] = held / np.maximum(base["n_words"], 1)
                parts.append(base)
            got = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}
            if not parts:
                continue
            failed = (got["n_words"] < min_words) | (100 * got["n_repeat_words"] > max_repeat_percent * got["n_words"])
            counts = [pa.array(got[k], pa.int64()) for k in COUNTS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(failed), pa.array(got["share"]), pa.array(~failed & (got["share"] >= min_content))],
                names=[id_col, *COUNTS, "base_failed", "content_share", "kept"],
            )

    schema = StructType([StructField(id_col, docs.schema[id_col].dataType)])
    for name in COUNTS:
        schema = schema.add(name, LongType())
    schema = schema.add("base_failed", BooleanType()).add("content_share", DoubleType()).add("kept", BooleanType())
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
