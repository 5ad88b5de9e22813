"""Toxicity by a counterfactual-regularised linear classifier.

Features of a text are the presence of its words (runs of letters, A-Z
lower-cased) and of their first 4 and 6 bytes (``PREFIXES``), hashed, so that
inflected forms share a feature. A logistic
model is fitted in numpy on a sample of labelled rows. Beside the usual
loss, every sampled text that mentions an identity term gets
counterfactual copies, in which the term is exchanged for each other term of
its group or left out; the squared change of the logit is penalised with
weight ``PENALTY``. A neutral mention of a group thus does not raise a score.

The sample is bounded: about ``PER_CLASS`` rows a class, chosen by a
hash of the id; class weights restore the class shares of all labelled rows.
Features must differ between classes by ``MIN_Z`` standard errors; identity
terms are always features. Scoring runs over all rows in Arrow batches.

Defined results: null and empty texts get the score of a text without
features; without labelled rows of both classes every score is the share of
toxic labels (0 if there is none); rows with null label are not learned
from; of several labels of a text the largest counts; repeated rows get
equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import small_batches
from .textbytes import LOWER, chunks, span_hashes, word_spans

BITS = 20
PREFIXES = (4, 6)
PER_CLASS = 6000
MIN_Z = 4.0
RIDGE = 3e-5
PENALTY = 1.0
THRESHOLD = 0.7
STEPS, RATE = 400, 0.1
#: Identity terms by group; exchanged only within a group. A parameter, in lower case.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "lesbian", "bisexual", "straight", "transgender"), ("black", "white", "asian", "latino"),
    ("immigrants", "foreigners", "refugees", "citizens"), ("disabled", "deaf", "blind"), ("old", "young"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)
BREAKS = np.ones(256, bool)
BREAKS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature number of every word and long word's prefix (with repeats)."""
    data = LOWER[data]
    s, e, text = word_spans(data, offsets, BREAKS)
    texts, hashes = [text], [span_hashes(data, s, e)]
    for size in PREFIXES:
        long = e - s > size
        texts.append(text[long])
        hashes.append(span_hashes(data, s[long], s[long] + size) * np.uint64(2 * size + 1))
    return np.concatenate(texts), (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


def term_features(term: str) -> np.ndarray:
    raw = np.frombuffer(term.encode(), np.uint8)
    return np.unique(features(raw, np.array([0, len(raw)]))[1])


def term_words(term: str) -> np.ndarray:
    """The features of the term's whole words, without their prefixes."""
    raw = np.frombuffer(term.encode(), np.uint8)
    ends = np.array([0, len(raw)])
    return features(raw, ends)[1][:len(word_spans(raw, ends, BREAKS)[0])]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in chunks(batch.column("text")):
            n = len(offsets) - 1
            text, feature = features(data, offsets)
            pairs = np.unique(text << BITS | feature)
            ends = np.searchsorted(pairs >> BITS, np.arange(n + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((pairs & ((1 << BITS) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([lists, batch.column("toxic").slice(row, n), batch.column("key").slice(row, n)],
                                             ["features", "toxic", "key"])


def fit(texts: list[np.ndarray], toxic: np.ndarray, shares: tuple[float, float], terms=IDENTITY_TERMS,
        penalty: float = PENALTY, min_z: float = MIN_Z, ridge: float = RIDGE, steps: int = STEPS) -> dict:
    """Logistic weights of the selected features. ``shares``: class shares the sample stands for."""
    size = 1 << BITS
    lengths = np.array([len(t) for t in texts])
    flat = np.concatenate(texts) if len(texts) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(texts)), lengths)
    n1, n0 = int(toxic.sum()), int((1 - toxic).sum())
    c1 = np.bincount(flat[toxic[row] == 1], minlength=size)
    c0 = np.bincount(flat[toxic[row] == 0], minlength=size)
    p1, p0, p = c1 / n1, c0 / n0, (c1 + c0 + 1) / (n1 + n0 + 2)
    z = np.abs(p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    by_term = {t: term_features(t) for group in terms for t in group}
    chosen = np.zeros(size, bool)
    chosen[z >= min_z] = True
    for f in by_term.values():
        chosen[f] = True
    number = np.cumsum(chosen) - 1
    on = chosen[flat]
    r, c = row[on], number[flat[on]]
    k = int(chosen.sum())

    # counterfactual copies as differences of features: + the term's, - the other's (or nothing)
    diff_row, diff_col, diff_sign, n_diff = [], [], [], 0
    have = {t: set.intersection(*[set(row[flat == f]) for f in term_words(t)]) for t in by_term}
    for group in terms:
        for t in group:
            for _ in have[t]:
                for other in (*[o for o in group if o != t], None):
                    gone, come = number[by_term[t]], number[by_term[other]] if other else np.zeros(0, int)
                    diff_row += [n_diff] * (len(gone) + len(come))
                    diff_col += [*gone, *come]
                    diff_sign += [1.0] * len(gone) + [-1.0] * len(come)
                    n_diff += 1
    dr, dc, ds = np.array(diff_row, int), np.array(diff_col, int), np.array(diff_sign)

    weight = np.where(toxic == 1, shares[1] / n1, shares[0] / n0)
    w, b = np.zeros(k), float(np.log(shares[1] / shares[0]))
    m1, m2, g1, g2 = np.zeros(k + 1), np.zeros(k + 1), 0.9, 0.999
    for t in range(1, steps + 1):
        s = np.bincount(r, w[c], len(texts)) + b
        error = weight * (1 / (1 + np.exp(-np.clip(s, -40, 40))) - toxic)
        grad = np.bincount(c, error[r], k) + ridge * w
        if n_diff:
            change = np.bincount(dr, ds * w[dc], n_diff)
            grad += 2 * penalty / n_diff * np.bincount(dc, change[dr] * ds, k)
        full = np.append(grad, error.sum())
        m1, m2 = g1 * m1 + (1 - g1) * full, g2 * m2 + (1 - g2) * full ** 2
        step = RATE * (m1 / (1 - g1 ** t)) / (np.sqrt(m2 / (1 - g2 ** t)) + 1e-10)
        w, b = w - step[:-1], b - step[-1]
    return {"features": np.flatnonzero(chosen), "weights": w, "bias": float(b)}


def train(texts: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
          per_class: int = PER_CLASS, terms=IDENTITY_TERMS, penalty: float = PENALTY) -> dict:
    """Fits the model on a bounded sample of the labelled texts."""
    small_batches(texts.sparkSession)
    marks = labels.where(F.col(toxic).isin(0, 1)).groupBy(F.col(doc_id).alias("key")).agg(F.max(toxic).cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}  # at most two rows
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if not n0 or not n1:
        share = n1 / max(n0 + n1, 1)
        return {"features": np.zeros(0, int), "weights": np.zeros(0), "bias": float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))}
    drawn = F.pmod(F.xxhash64(F.lit("toxic"), F.col("key")), F.lit(1 << 20)) / (1 << 20)
    sample = marks.where(drawn < F.when(F.col("toxic") == 1, min(1.0, per_class / n1)).otherwise(min(1.0, per_class / n0)))
    sample = sample.limit(4 * per_class)
    rows = texts.select(F.col(doc_id).alias("key"), F.col(text).alias("text")).join(F.broadcast(sample), "key")
    table = rows.mapInArrow(_featured, "features array<int>, toxic int, key long").orderBy("key", "features").toArrow()
    if not len(table) or len(set(table.column("toxic").to_pylist())) < 2:
        return {"features": np.zeros(0, int), "weights": np.zeros(0), "bias": float(np.log(n1 / n0))}
    lists = [x.values.to_numpy().astype(np.int64) for x in table.column("features")]
    return fit(lists, table.column("toxic").to_numpy().astype(int), (n0 / (n0 + n1), n1 / (n0 + n1)), terms, penalty)


def scores(model: dict, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The probability of label 1 of every text of a chunk."""
    table = model.get("table")
    if table is None:
        table = model["table"] = np.zeros(1 << BITS)
        table[model["features"]] = model["weights"]
    text, feature = features(data, offsets)
    on = table[feature] != 0
    pairs = np.unique(text[on] << BITS | feature[on])
    s = np.bincount(pairs >> BITS, table[pairs & ((1 << BITS) - 1)], len(offsets) - 1) + model["bias"]
    return 1 / (1 + np.exp(-np.clip(s, -40, 40)))


def _scorer(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in chunks(batch.column("_text")):
                part = batch.slice(row, len(offsets) - 1).drop_columns(["_text"])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores(model, data, offsets), pa.float64())],
                                                 names=[*part.schema.names, "score"])
    return run


def score(docs: DataFrame, model: dict, text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The ``keep`` columns with the score, one row per input row."""
    small_batches(docs.sparkSession)
    rows = docs.select(*[c.alias(n) for n, c in (keep or {}).items()], F.col(text).alias("_text"))
    types = "".join(f"`{n}` {t}, " for n, t in rows.drop("_text").dtypes)
    return rows.mapInArrow(_scorer(model), f"{types}score double")
