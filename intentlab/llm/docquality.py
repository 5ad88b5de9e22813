"""Document quality by histogram gradient-boosted trees over document statistics.

A text's statistics (``STATISTICS``) are counted over its whole UTF-8 bytes, its words (runs
without white space) and its lines, vectorised over chunks of texts. Trees are grown
in numpy on a bounded sample of labelled rows: each statistic is cut into at
most ``BINS`` bins at quantiles of the sample, and level by level the
gradient and hessian sums of every (node, statistic, bin) give the split of largest gain.
All trees are complete binary trees of ``DEPTH`` levels, flattened into two
arrays by tree and node, so a batch walks all trees at once, one array step a level.

The sample is the ``PER_CLASS`` labelled ids of smallest hash of each class (all,
if there are fewer), one row an id; weights restore the class shares of all labelled rows.
Statistics are taken in the tasks, so only numbers reach the driver. Scoring
runs over all rows in Arrow batches.

Defined results: null and empty texts have statistics 0 and get the score the
trees give those; without labelled rows of both classes every score is the share of label 1
(1 if there is no label); rows with null label or id are not learned from; of several
labels of an id the largest counts, of several texts that of the smallest statistics; repeated rows get equal
scores; very long texts are read whole, as a chunk of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import small_batches
from .textbytes import chunks, span_hashes, word_spans

PER_CLASS = 6000
BINS, DEPTH, TREES = 64, 4, 100
RATE, RIDGE, MIN_WEIGHT = 0.1, 1.0, 1.0
THRESHOLD = 0.3
STATISTICS = (
    "log_bytes", "log_words", "mean_word", "longest_word", "letters", "capitals", "digits", "sentence_marks", "other_marks", "spaces",
    "beyond_ascii", "capital_words", "capital_first", "digit_words", "letterless_words", "mark_ended_words", "mark_runs",
    "distinct_words", "words_a_line", "distinct_lines", "most_frequent_word", "bytes_used")

CAPITAL, SMALL, DIGIT, STOP, MARK, SPACE, HIGH = range(7)
KIND = np.full(256, MARK, np.uint8)
KIND[[0x20, *range(0x09, 0x0E)]] = SPACE
KIND[0x41:0x5B], KIND[0x61:0x7B], KIND[0x30:0x3A], KIND[0x80:] = CAPITAL, SMALL, DIGIT, HIGH
KIND[[ord(c) for c in ".,;:!?'\"()-"]] = STOP
LINE_BREAKS = np.zeros(256, bool)
LINE_BREAKS[0x0A] = True


def _distinct(text: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text the number of different hashes and how often the most frequent one occurs."""
    order = np.lexsort((hashes, text))
    t, h = text[order], hashes[order]
    first = np.ones(len(t), bool)
    first[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    starts = np.flatnonzero(first)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, t[starts], np.diff(np.append(starts, len(t))))
    return np.bincount(t[starts], minlength=n), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` a text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    kind = KIND[data]

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[offsets[1:]] - sums[offsets[:-1]]

    of_kind = [per_text(kind == k) for k in range(7)]
    s, e, text = word_spans(data, offsets)
    words = np.bincount(text, minlength=n)
    length = e - s
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, text, length)

    def words_where(flags: np.ndarray) -> np.ndarray:
        return np.bincount(text[flags], minlength=n)

    def in_word(k: tuple) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(np.isin(kind, k), dtype=np.int64)))
        return sums[e] - sums[s]

    lettered, small = in_word((CAPITAL, SMALL, HIGH)), in_word((SMALL, HIGH))
    last, first = (kind[e - 1], kind[s]) if len(e) else (kind[:0], kind[:0])
    doubled = np.zeros(len(data), bool)  # marks that repeat the byte before
    doubled[1:] = (data[1:] == data[:-1]) & ((kind[1:] == MARK) | (kind[1:] == STOP))
    distinct, most = _distinct(text, span_hashes(data, s, e), n)
    ls, le, line_text = word_spans(data, offsets, LINE_BREAKS)
    lines = np.bincount(line_text, minlength=n)
    distinct_lines, _ = _distinct(line_text, span_hashes(data, ls, le), n)
    text_of_byte = np.repeat(np.arange(n), size)
    used = np.bincount(np.unique(text_of_byte * 256 + data) >> 8, minlength=n)

    bytes_, words_, lines_ = np.maximum(size, 1), np.maximum(words, 1), np.maximum(lines, 1)
    return np.stack([
        np.log1p(size), np.log1p(words), (size - of_kind[SPACE]) / words_, longest, (of_kind[CAPITAL] + of_kind[SMALL] + of_kind[HIGH]) / bytes_,
        of_kind[CAPITAL] / bytes_, of_kind[DIGIT] / bytes_, of_kind[STOP] / bytes_, of_kind[MARK] / bytes_, of_kind[SPACE] / bytes_,
        of_kind[HIGH] / bytes_, words_where((lettered > 1) & (small == 0)) / words_, words_where(first == CAPITAL) / words_,
        words_where(in_word((DIGIT,)) > 0) / words_, words_where(lettered == 0) / words_, words_where(last == MARK) / words_,
        per_text(doubled) / words_, distinct / words_, words / lines_, distinct_lines / lines_, most / words_, used / 256.0], 1)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS,
        rate: float = RATE, ridge: float = RIDGE, min_weight: float = MIN_WEIGHT) -> dict:
    """Boosted trees on statistics ``x`` and labels ``y``: feature, threshold and leaf arrays by tree."""
    rows, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(width)], 1)
    inner, last = 2 ** depth - 1, 2 ** depth
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, last))
    share = float((weight * y).sum() / weight.sum())
    bias = float(np.log(share / (1 - share)))
    logit = np.full(rows, bias)
    column = np.arange(width) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-logit))
        gradient, hessian = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(rows, np.int64)
        for level in range(depth):
            nodes, base = 2 ** level, 2 ** level - 1
            cell = ((node - base)[:, None] * (width * bins) + column + binned).ravel()
            shape = (nodes, width, bins)
            g = np.bincount(cell, np.repeat(gradient, width), nodes * width * bins).reshape(shape).cumsum(2)
            h = np.bincount(cell, np.repeat(hessian, width), nodes * width * bins).reshape(shape).cumsum(2)
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g ** 2 / (h + ridge) + (g_all - g) ** 2 / (h_all - h + ridge) - g_all ** 2 / (h_all + ridge)
            gain[(h < min_weight) | (h_all - h < min_weight)] = 0
            for j in range(width):  # only real edges split
                gain[:, j, len(edges[j]):] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            for k in range(nodes):
                if gain[k].flat[best[k]] > 1e-9:
                    j, b = divmod(int(best[k]), bins)
                    feature[t, base + k], threshold[t, base + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(rows), feature[t, node]] > threshold[t, node])
        node -= inner
        leaf[t] = -rate * np.bincount(node, gradient, last) / (np.bincount(node, hessian, last) + ridge)
        logit += leaf[t][node]
    return {"feature": feature, "threshold": threshold, "leaf": leaf, "bias": bias}


def probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    """Label 1's probability of every row of statistics; all trees are walked together, in slices of rows."""
    feature, threshold, leaf = model["feature"], model["threshold"], model["leaf"]
    trees, inner = feature.shape
    tree = np.arange(trees)
    out = np.empty(len(x))
    for at in range(0, len(x), 512):
        part = x[at:at + 512]
        row = np.arange(len(part))[:, None]
        node = np.zeros((len(part), trees), np.int64)
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (part[row, feature[tree, node]] > threshold[tree, node])
        out[at:at + 512] = leaf[tree, node - inner].sum(1) + model["bias"]
    return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in chunks(batch.column("text")):
            part = batch.slice(row, len(offsets) - 1)
            values = statistics(data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * len(STATISTICS), pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("label"), lists], ["key", "label", "measured"])


def _constant(share: float) -> dict:
    share = min(max(share, 1e-9), 1 - 1e-9)
    return {"feature": np.zeros((0, 1), np.int64), "threshold": np.zeros((0, 1)), "leaf": np.zeros((0, 2)),
            "bias": float(np.log(share / (1 - share)))}


def train(texts: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          per_class: int = PER_CLASS, **options) -> dict:
    """Fits the trees on a bounded sample of the labelled texts."""
    small_batches(texts.sparkSession)
    marks = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    marks = marks.groupBy(F.col(doc_id).alias("key")).agg(F.max(label).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}  # at most two rows
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if not n0 or not n1:
        return _constant(n1 / (n0 + n1) if n0 + n1 else 1.0)
    # twice the ids wanted are drawn by all 64 bits of the hash, so the order is taken over few
    below = [int(min(1.0, 2 * per_class / n) * 2 ** 64) - 2 ** 63 - 1 for n in (n0, n1)]
    drawn = marks.withColumn("_hash", F.xxhash64(F.lit("quality"), F.col("key"))).where(
        F.col("_hash") <= F.when(F.col("label") == 1, F.lit(below[1])).otherwise(F.lit(below[0])))
    first = Window.partitionBy("label").orderBy("_hash", "key")
    sample = drawn.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= per_class).select("key", "label")
    rows = texts.select(F.col(doc_id).alias("key"), F.col(text).cast("string").alias("text"))
    rows = rows.join(F.broadcast(sample), "key")  # at most 2 * per_class rows
    key = texts.schema[doc_id].dataType.simpleString()
    measured = rows.mapInArrow(_measured, f"key {key}, label int, measured array<double>")
    # one row an id, whatever its number of rows
    found = measured.groupBy("key", "label").agg(F.min("measured").alias("measured")).toArrow().sort_by("key")
    y = found.column("label").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return _constant(n1 / (n0 + n1))
    x = found.column("measured").combine_chunks().values.to_numpy().reshape(len(y), -1)
    total = n0 + n1
    weight = np.where(y == 1, n1 / total / y.sum(), n0 / total / (1 - y).sum()) * len(y)
    return fit(x, y, weight, **options)


def _scorer(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in chunks(batch.column("_text")):
                part = batch.slice(row, len(offsets) - 1).drop_columns(["_text"])
                scores = probabilities(model, statistics(data, offsets))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names=[*part.schema.names, "score"])
    return run


def score(docs: DataFrame, model: dict, text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The ``keep`` columns with the score, one row per input row."""
    small_batches(docs.sparkSession)
    rows = docs.select(*[c.alias(n) for n, c in (keep or {}).items()], F.col(text).cast("string").alias("_text"))
    types = "".join(f"`{n}` {t}, " for n, t in rows.drop("_text").dtypes)
    return rows.mapInArrow(_scorer(model), f"{types}score double")
