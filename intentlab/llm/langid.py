"""Language identification by a byte convolutional network.

Texts are cut into windows of ``WINDOW`` bytes of UTF-8 (A-Z lower-cased,
step ``STEP``, so that every filter position is seen once; the last window is
padded with zero bytes). Each byte is embedded, filters of several widths slide over the
window, the largest response of each filter goes through a rectifier and a softmax
layer gives the window's language probabilities. A text's probabilities are
the mean over all its windows, weighted by their letters.

The network is fitted with numpy (Adam, cross-entropy) on windows drawn from
a sample of labelled rows: of each language the ``PER_LANG`` distinct rows of
smallest hash of id and text (all, if there are fewer), and
``WINDOWS_PER_TEXT`` windows spread over the whole of each text, cut in the
tasks. Everything else runs over all rows in Arrow batches.

Defined results: null texts and texts without a letter are ``und`` with score
0; so is everything if no labelled row exists. Rows with null label or text
are not learned from. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import small_batches
from .textbytes import LOWER, chunks

WINDOW, WIDTHS, FILTERS, EMBED = 64, (2, 3, 4, 5), 12, 8
SPAN = max(WIDTHS)
STEP = WINDOW - SPAN + 1
PER_LANG = 400
WINDOWS_PER_TEXT = 16
EPOCHS, BATCH, RATE, SEED = 6, 128, 0.004, 7
LETTERS = np.zeros(256, np.float32)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts as rows of bytes, and the number of windows of each text."""
    lengths = np.diff(offsets)
    counts = np.where(lengths == 0, 0, np.maximum(1, -(-(lengths - (WINDOW - STEP)) // STEP)))
    padded = np.zeros(int(counts.sum()) * STEP + WINDOW, np.uint8)
    begin = np.concatenate(([0], np.cumsum(counts)))[:-1] * STEP
    # a text's tail may reach beyond its last step; texts are laid out with that much room
    room = np.arange(len(lengths)) * (WINDOW - STEP)
    padded = np.zeros(len(padded) + len(lengths) * (WINDOW - STEP), np.uint8)
    padded[np.arange(len(data)) + np.repeat(begin + room - offsets[:-1], lengths)] = LOWER[data]
    starts = np.repeat(begin + room, counts) + (np.arange(int(counts.sum())) - np.repeat(begin // STEP, counts)) * STEP
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[starts], counts


def _columns(model: dict, x: np.ndarray) -> np.ndarray:
    e = model["embed"][x].reshape(len(x), WINDOW * EMBED)
    view = np.lib.stride_tricks.as_strided(e, (len(x), STEP, SPAN * EMBED), (e.strides[0], EMBED * 4, 4))
    return view.reshape(len(x) * STEP, SPAN * EMBED)


def probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    """Softmax of every window, in slices of bounded memory."""
    out = np.empty((len(x), len(model["langs"])), np.float32)
    for at in range(0, len(x), 512):
        part = x[at:at + 512]
        z = (_columns(model, part) @ model["kernel"]).reshape(len(part), STEP, -1).max(1)
        logits = np.maximum(z + model["bias"], 0) @ model["dense"] + model["offset"]
        p = np.exp(logits - logits.max(1, keepdims=True))
        out[at:at + 512] = p / p.sum(1, keepdims=True)
    return out


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """Trains on windows ``x`` (bytes) and classes ``y`` by gradient descent with Adam."""
    rng = np.random.default_rng(seed)
    n = FILTERS * len(WIDTHS)
    mask = np.zeros((SPAN * EMBED, n), np.float32)
    for i, width in enumerate(WIDTHS):
        mask[:width * EMBED, i * FILTERS:(i + 1) * FILTERS] = 1
    model = {"langs": langs, "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
             "kernel": (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32), "bias": np.zeros(n, np.float32),
             "dense": rng.normal(0, 0.2, (n, len(langs))).astype(np.float32), "offset": np.zeros(len(langs), np.float32)}
    names = ("embed", "kernel", "bias", "dense", "offset")
    m1, m2, t = {k: np.zeros_like(model[k]) for k in names}, {k: np.zeros_like(model[k]) for k in names}, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            pick = order[at:at + BATCH]
            b, target = len(pick), y[pick]
            cols = _columns(model, x[pick]).reshape(b, STEP, -1)
            z = cols @ model["kernel"]
            where = z.argmax(1)
            top = np.take_along_axis(z, where[:, None], 1)[:, 0] + model["bias"]
            hidden = np.maximum(top, 0)
            logits = hidden @ model["dense"] + model["offset"]
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(b), target] -= 1
            p /= b
            back = (p @ model["dense"].T) * (top > 0)
            seen = cols[np.arange(b)[:, None], where]
            to_bytes = (back[:, :, None] * model["kernel"].T[None]).reshape(-1, SPAN, EMBED)
            embed = np.zeros_like(model["embed"])
            np.add.at(embed, x[pick][np.arange(b)[:, None, None], where[:, :, None] + np.arange(SPAN)].reshape(-1, SPAN), to_bytes)
            grads = {"embed": embed, "kernel": np.einsum("bfe,bf->ef", seen, back) * mask, "bias": back.sum(0),
                     "dense": hidden.T @ p, "offset": p.sum(0)}
            t += 1
            for k in names:
                m1[k] = 0.9 * m1[k] + 0.1 * grads[k]
                m2[k] = 0.999 * m2[k] + 0.001 * grads[k] ** 2
                model[k] -= RATE * (m1[k] / (1 - 0.9 ** t)) / (np.sqrt(m2[k] / (1 - 0.999 ** t)) + 1e-8)
    return model


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data, offsets in chunks(batch.column("text")):
            all_windows, n = windows(data, offsets)
            begin = np.cumsum(n) - n
            cut = [all_windows[a + np.unique(np.linspace(0, k - 1, WINDOWS_PER_TEXT).astype(int))].tobytes() for a, k in zip(begin, n)]
            yield pa.RecordBatch.from_arrays([*batch.slice(row, len(n)).drop_columns(["text"]).columns, pa.array(cut, pa.binary())],
                                             names=["lang", "hash", "windows"])


def learning_sample(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                    per_lang: int = PER_LANG) -> DataFrame | None:
    """lang, hash, windows: the ``per_lang`` distinct rows of smallest hash of each language; None without labelled rows."""
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(lang).alias("lang"), F.xxhash64(F.lit("lang"), F.col(doc_id).cast("string"), F.col(text)).alias("hash"),
                           F.col(text).alias("text"))
    rows = rows.where("lang is not null and text is not null").where(F.col("text").rlike("\\p{L}"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("hash")).collect()  # one row a language
    if not counts:
        return None
    # twice the rows wanted are drawn, so that the estimate's error costs none; all 64 bits count
    below = {k: int(min(1.0, 2 * per_lang / max(c, 1)) * 2 ** 64) - 2 ** 63 - 1 for k, c in counts}
    limit = F.element_at(F.create_map(*[F.lit(v).cast(t) for k, b in below.items() for v, t in ((k, "string"), (b, "long"))]), F.col("lang"))
    drawn = rows.where(F.col("hash") <= limit).mapInArrow(_cut, "lang string, hash long, windows binary")
    # repeated rows count once; both limits apply before the shuffles too
    once = Window.partitionBy("lang", "hash").orderBy("windows")
    drawn = drawn.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    first = Window.partitionBy("lang").orderBy("hash")
    return drawn.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= per_lang).drop("_n")


def train(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          per_lang: int = PER_LANG) -> dict:
    """Fits the network on a bounded sample of (id, text, lang) rows."""
    sample = learning_sample(labelled, doc_id, text, lang, per_lang)
    if sample is None:
        return {"langs": []}
    table = sample.toArrow().sort_by([("lang", "ascending"), ("hash", "ascending")])
    labels = table.column("lang").to_pylist()
    langs = sorted(set(labels))
    x = [np.frombuffer(w, np.uint8).reshape(-1, WINDOW) for w in table.column("windows").to_pylist()]
    y = np.repeat([langs.index(k) for k in labels], [len(w) for w in x])
    return fit(np.concatenate(x), y, langs)


def identify(model: dict, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and probability of every text of a chunk."""
    x, counts = windows(data, offsets)
    weight = LETTERS[x].sum(1) + 1e-3
    text = np.repeat(np.arange(len(counts)), counts)
    p = probabilities(model, x) * weight[:, None]
    sums = np.stack([np.bincount(text, p[:, k], len(counts)) for k in range(p.shape[1])], 1)
    total = np.bincount(text, weight, len(counts))
    mean = sums / np.maximum(total, 1e-9)[:, None]
    best = mean.argmax(1)
    return best, np.clip(mean[np.arange(len(best)), best], 0, 1)


def _predictor(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = np.array([*model["langs"], "und"], object)
        for batch in batches:
            for row, data, offsets in chunks(batch.column("_text")):
                n = len(offsets) - 1
                part = batch.slice(row, n)
                lettered = part.column("_lettered").to_numpy(zero_copy_only=False).astype(bool)
                best, score = (identify(model, data, offsets) if model["langs"] else (np.zeros(n, int), np.zeros(n)))
                best = np.where(lettered & bool(model["langs"]), best, len(langs) - 1)
                score = np.where(best == len(langs) - 1, 0.0, score)
                yield pa.RecordBatch.from_arrays(
                    [*part.drop_columns(["_text", "_lettered"]).columns, pa.array(langs[best], pa.string()), pa.array(score, pa.float64())],
                    names=[*part.drop_columns(["_text", "_lettered"]).schema.names, "lang_pred", "score"])
    return run


def predict(docs: DataFrame, model: dict, text: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """The ``keep`` columns with lang_pred and score, one row per input row."""
    small_batches(docs.sparkSession)
    keep = keep or {}
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text).alias("_text"),
                       F.coalesce(F.col(text).rlike("\\p{L}"), F.lit(False)).alias("_lettered"))
    types = ", ".join(f"`{n}` {t}" for n, t in rows.drop("_text", "_lettered").dtypes)
    return rows.mapInArrow(_predictor(model), f"{types}{', ' if types else ''}lang_pred string, score double")
