"""Spelling variants by permuterm rotations.

A word w gets the terminator ``$`` and all its rotations w[i:] $ w[:i]. Two
words x c y and x d y that differ in one code point have the rotations
y $ x c and y $ x d: side by side in sorted order, in the range of the prefix
y $ x, which skips the edited code point. The word x y, one deletion away from
both, has the rotation y $ x: the first of that range. So every word enters a
range with each of its whole rotations (as the shorter word) and with each of
its rotations less the last code point (as the longer or equally long one). The
rotations are dealt out and sorted by range, and one scan of the sorted
ranges gives each member the number of its neighbours there and the best of
them; no pairs are made. A range holds one word a code point of the
alphabet and one shorter word, whatever the number of rows, so no range is hot.

Two equally long words meet in one range only. A deletion inside a run of equal code
points leaves the same word wherever it happens, so a pair of different lengths is counted where
the deleted code point is the first of its run.

Words are numbered in the order of n (largest first) and code points; the
number stands for the word in the ranges, and the smallest number among the
neighbours is the best one. A rotation longer than ``WHOLE`` code points
is stood for by its length, its first code points and 128 bits of polynomial hashes, so that a
word of any length needs memory in proportion to its length.

A word's form is its best neighbour if that occurs ``RATIO`` times as often.
Forms are followed by pointer doubling; as n grows by that factor at each
step, the largest n bounds the rounds.

Words are read from whole texts in slices that end where a run of letters ends, counted
in the tasks (``HELD`` words or code points at most are held) and added up after
one shuffle, so a frequent word sends one row a task and flush.

Defined results: null and empty texts give no words; repeated rows count
each time; a null id enters the hash as an empty text; a table without
words gives no rows; columns of other names are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import materialize
from .batches import small_batches
from .textbytes import mixed

LETTERS = "a-zÀ-ÿ"  # after A-Z are lower-cased
MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10
EVERY = 31
SLICE = 1 << 20
HELD = 1 << 18
WHOLE = 64
TERMINATOR = "$"
#: Two odd multipliers of the polynomial hashes.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def slices(text: str, run: re.Pattern, size: int = SLICE) -> Iterator[str]:
    """The text in parts of about ``size`` code points that cut no run of letters."""
    at = 0
    while at < len(text):
        to = at + size
        if to < len(text) and (rest := run.match(text, to)):
            to = rest.end()
        yield text[at:to]
        at = to


def _counter(every: int, min_length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, words = re.compile(f"[{LETTERS}]+"), re.compile(f"[{LETTERS}]{{{min_length},}}")
        held, size = Counter(), 0

        def flushed():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                seed = zlib.crc32(f"{doc_id or ''}:".encode())
                # bytes.lower changes A-Z only
                for part in slices((text or "").encode().lower().decode(), letters):
                    for word, n in Counter(words.findall(part)).items():
                        h = zlib.crc32(word.encode(), seed)
                        if every and h % every == 0:
                            cut = h % len(word)
                            word = word[:cut] + word[cut + 1:]
                            if len(word) < min_length:
                                continue
                        if word not in held:
                            size += len(word)
                        held[word] += n
                    if len(held) >= HELD or size >= 16 * HELD:
                        yield flushed()
                        held, size = Counter(), 0
        yield flushed()
    return run


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = EVERY,
                min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: runs of letters, one code point left out of every ``every``-th (id, run) by hash; ``every`` 0 leaves all whole."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    counted = rows.mapInArrow(_counter(every, min_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def long_rotations(word: str) -> tuple[list[str], list[str]]:
    """What stands for the whole rotations of a long word, and for those less the last code point."""
    marked = np.frombuffer((word + TERMINATOR).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    size = len(marked)
    twice = np.concatenate((marked, marked))

    def digests(length: int, count: int, base: np.uint64) -> np.ndarray:
        power = np.full(2 * size, base, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(twice * base) * power)))
        back = np.multiply.accumulate(np.full(count + 1, np.uint64(pow(int(base), -1, 1 << 64)), np.uint64))
        begin = np.arange(count)
        down = np.concatenate((np.ones(1, np.uint64), back))[:count]
        return mixed((sums[begin + length] - sums[begin]) * down)

    text = (word + TERMINATOR) * 2
    out = []
    # whole rotations begin at 0..len(word); the others at 1..len(word), which leave a letter out
    for length, first, count in ((size, 0, size), (size - 1, 1, size)):
        pairs = zip(*(digests(length, count, base)[first:].tolist() for base in BASES))
        out.append([f"{length}:{text[i:i + 16]}:{a:016x}{b:016x}" for i, (a, b) in enumerate(pairs, first)])
    return out[0], out[1]


def _rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per word and range: kind 0 is the shorter word, 1 a longer one, 2 one whose left-out code point repeats the one before."""
    def batch_of(prefix, number, kind):
        return pa.RecordBatch.from_arrays([pa.array(prefix, pa.string()), pa.array(number, pa.int64()), pa.array(kind, pa.int8())],
                                          ["prefix", "number", "kind"])
    for batch in batches:
        prefix, number, kind, size = [], [], [], 0
        for word, no in zip(batch.column("word").to_pylist(), batch.column("number").to_pylist()):
            length = len(word)
            text = word + TERMINATOR + word
            # what counts is the length of the range's prefix, so that both words of a pair agree
            digests = long_rotations(word) if length >= WHOLE else None
            whole = digests[0] if length >= WHOLE else [text[i:i + length + 1] for i in range(length + 1)]
            less = digests[1] if length > WHOLE else [text[i:i + length] for i in range(1, length + 1)]
            prefix += whole
            prefix += less
            kind += [0] * (length + 1)
            # the rotation that begins at i + 1 leaves out code point i
            kind += [1 if i == 0 or word[i - 1] != word[i] else 2 for i in range(length)]
            number += [no] * (2 * length + 1)
            size += 2 * length + 1
            if size >= HELD:
                yield batch_of(prefix, number, kind)
                prefix, number, kind, size = [], [], [], 0
        yield batch_of(prefix, number, kind)


def numbered(words: DataFrame) -> DataFrame:
    """Adds ``number``: ascending with descending n, then with the word; written, so that it stays as it is."""
    ordered = words.select("word", "n").orderBy(F.desc("n"), "word")
    return materialize(ordered.withColumn("number", F.monotonically_increasing_id()), "spelling-words")


def neighbours(words: DataFrame) -> DataFrame:
    """number, n_near, best (smallest number among the neighbours) of the words that have neighbours."""
    small_batches(words.sparkSession, 4096)
    rotations = words.select("word", "number").mapInArrow(_rotations, "prefix string, number long, kind byte")
    order = Window.partitionBy("prefix").orderBy("number")
    members = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = rotations.select(
        "number", "kind", F.row_number().over(order).alias("rank"), F.lead("number").over(order).alias("following"),
        F.first("number").over(members).alias("leader"), F.count("*").over(members).alias("size"),
        F.sum((F.col("kind") == 0).cast("int")).over(members).alias("shorter"),
        F.sum((F.col("kind") == 1).cast("int")).over(members).alias("firsts"))
    ranges = ranges.where("size > 1")
    near = (F.when(F.col("kind") == 0, F.col("firsts"))
            .otherwise(F.col("size") - F.col("shorter") - 1 + F.when(F.col("kind") == 1, F.col("shorter")).otherwise(0)))
    other = F.when(F.col("rank") == 1, F.col("following")).otherwise(F.col("leader"))
    return ranges.groupBy("number").agg(F.sum(near).cast("long").alias("n_near"), F.min(other).alias("best"))


def roots(forms: DataFrame, most: int, ratio: int = RATIO, least: int = MIN_COUNT) -> DataFrame:
    """number, root: the last of the chain number -> form. A chain has fewer steps than n can grow by ``ratio``."""
    steps, n = 0, least
    while n * ratio <= most:
        steps, n = steps + 1, n * ratio
    jumps, reach = forms.select("number", F.col("form").alias("root")), 1
    while reach < steps:
        onward = jumps.select(F.col("number").alias("root"), F.col("root").alias("further"))
        jumps = jumps.join(onward, "root", "left").select("number", F.coalesce("further", "root").alias("root"))
        jumps = materialize(jumps, "spelling-roots")
        reach *= 2
    return jumps


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ratio: int = RATIO, every: int = EVERY,
             min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = numbered(word_counts(docs, doc_id, text, every, min_length, min_count))
    most = words.agg(F.max("n")).first()[0] or 0
    near = words.join(neighbours(words), "number", "left")
    best = words.select(F.col("number").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    near = near.join(best, "best", "left")
    found = F.col("form_n") >= ratio * F.col("n")
    near = materialize(near.select(
        "word", "n", "number", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(found, F.col("form")).alias("form"),
        F.when(found, F.col("form_n")).alias("form_n"), F.when(found, F.col("best")).alias("form_number")), "spelling-near")
    chains = roots(near.where("form is not null").select("number", F.col("form_number").alias("form")), most, ratio, min_count)
    last = chains.join(words.select(F.col("number").alias("root"), F.col("word").alias("root_word")), "root").select("number", "root_word")
    return near.join(last, "number", "left").select(
        "word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b:
      CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z\x{00C0}-\x{00FF}]+')) AS w FROM documents),
counted AS (SELECT doc_id, w, count(*) AS m FROM runs WHERE length(w) >= 7 GROUP BY ALL),
coded AS (SELECT w, m, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS x FROM counted),
hashed AS (
  SELECT w, m, xor(list_reduce(list_prepend(4294967295, [CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT) FOR i IN range(length(x) // 2)]),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM coded, crc_table),
edited AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, m FROM hashed),
words AS (SELECT word, CAST(sum(m) AS BIGINT) AS n FROM edited WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2),
less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (
  SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, n, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM pairs GROUP BY word, n),
formed AS (
  SELECT w.word, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form,
    CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (
  SELECT word, word AS cur, 0 AS depth FROM formed
  UNION ALL SELECT c.word, f.form, c.depth + 1 FROM chain c JOIN formed f ON f.word = c.cur WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(cur, depth) AS root FROM chain GROUP BY word)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM formed f JOIN ends e ON e.word = f.word
"""
