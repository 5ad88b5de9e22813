"""MinHash near-duplicates by an inverted join on signature coordinates.

1. Each text's set of word shingles (64-bit hashes) is reduced, in numpy
   over the Arrow batch, to its size, a 128-bit digest and ``COORDS``
   minima, each stored as one long: coordinate, then value. Texts of equal
   digest are one node; everything below works on different sets only.
2. Every node is posted under its (coordinate, value) pairs. Two nodes are
   candidates when at least ``MATCHES`` of the pairs agree. At a
   similarity of 0.8 a link has fewer with a chance of 2e-7 (binomial,
   40 coordinates). Counting all collisions would meet in the postings of
   common shingles, so a prefix is posted: with pairs ordered from rare to
   frequent, two nodes with ``MATCHES`` common pairs share one of the
   first ``COORDS - MATCHES + 1`` of each; the frequent rest is skipped,
   and pairs that occur once need no posting.
3. First pass: the hub of a posting list is the node whose pairs are the
   most frequent altogether (the text that its copies come from), and each node
   meets the ``HUBS`` hubs with which it collides most. A group of thousands of
   copies of one text thus makes ``HUBS`` pairs a copy.
   Drawn passes: a copy too far from the hubs mostly has links to other copies. Of each
   posting list's largest component ``DRAWS`` nodes are drawn by hash, and each node of
   another component meets ``DRAWN`` of those it collides with, in up to
   ``ROUNDS`` rounds of new draws, until less than one pair in ``YIELD`` is a link. A group that
   hangs together grows into one component this way, on pairs in proportion to its nodes.
   Last pass: any two nodes of one posting list that are still not
   in one component, so that no link between components is
   lost and none is sought inside one. In lists of up to ``LIGHT`` nodes
   these pairs are joined as they are. The nodes of longer lists are joined
   on their shingles instead, by an exact prefix filter: a link shares a
   shingle among the rarest 20 % of each set, and the first of them
   must leave enough shingles for the overlap behind it in both orders.
4. Candidates whose sizes allow the similarity and whose signatures agree
   in ``MATCHES`` pairs are confirmed on their full sets.
5. Components of the confirmed links come from ``components``.

Defined results: A-Z are lower-cased; words are runs of other characters
than space and ``\\t``-``\\r``; fewer words than a shingle make one shingle;
a null or wordless text has the empty set, is linked with nothing and is its
own component; repeated rows are linked; a row without an id is linked as
any other, and where no row of a component has an id, component_id is null.
``kept`` is doc_id = component_id, two nulls being equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import materialize
from .batches import small_batches
from .components import components
from .textbytes import chunks, mixed, shingle_sets

WORDS = 5
PERCENT = 80
COORDS = 40
MATCHES = 18
LIGHT = 64
HUBS = 3
DRAWS = 2
DRAWN = 8
ROUNDS = 4
YIELD = 100
FACTORS = mixed(np.arange(1, COORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
TAGS = np.arange(COORDS, dtype=np.int64) << 32


def signature(shingles: np.ndarray) -> np.ndarray:
    """Per coordinate the smallest upper half of (factor * shingle), tagged with the coordinate."""
    least = np.full(COORDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, (shingles[at:at + 4096, None] * FACTORS).min(0))
    return (least >> np.uint64(32)).astype(np.int64) | TAGS


def _signed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in chunks(batch.column("text")):
                sets = shingle_sets(data, offsets, words)
                full = [s for s in sets if len(s)]
                tokens = iter([signature(s) for s in full])
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(row, len(sets)), batch.column("h").slice(row, len(sets)),
                    pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()),
                    pa.array([next(tokens) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    ["doc_id", "h", "n", "digest", "tokens"])
    return run


def _shingled(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in chunks(batch.column("text")):
                sets = [s.view(np.int64) for s in shingle_sets(data, offsets, words)]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(row, len(sets)), pa.array(sets, pa.list_(pa.int64()))],
                                                 ["node", "shingles"])
    return run


def _confirmed(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            left = (s for _, d, o in chunks(batch.column("text_a")) for s in shingle_sets(d, o, words))
            right = (s for _, d, o in chunks(batch.column("text_b")) for s in shingle_sets(d, o, words))
            for a, b in zip(left, right):
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _texts(used: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text) of the nodes in ``used``; repeated rows have the same text."""
    used = nodes.select("node", F.col("rep.doc_id").alias("id"), F.col("rep.h").alias("h")).join(used.select("node"), "node")
    return (texts.join(used, (texts["h"] == used["h"]) & F.col("doc_id").eqNullSafe(F.col("id")))
            .select("node", "text").dropDuplicates(["node"]))


def _pairs(lists: DataFrame, key: str, percent: int) -> DataFrame:
    """Pairs of nodes of one list and different components whose sizes allow a link."""
    if "most" not in lists.columns:
        lists = lists.withColumn("most", F.col("n"))
    a = lists.select(key, F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"), F.col("most").alias("most_a"))
    b = lists.select(key, F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("root_b"), F.col("most").alias("most_b"))
    met = (F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & _sizes_allow(F.col("n_a"), F.col("n_b"), percent) & (
        (100 + percent) * F.least("most_a", "most_b") >= percent * (F.col("n_a") + F.col("n_b")))
    return a.join(b, key).where(met).select("a", "b").distinct()


def _most(met: DataFrame, several: int) -> DataFrame:
    """The hubs ``b`` that a node met most often; a node is in no more lists than a signature has coordinates."""
    w = Window.partitionBy("node").orderBy(F.desc("hits"), "b")
    return met.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= several).select(F.col("node").alias("a"), "b")


def _across(posted: DataFrame, groups: DataFrame) -> DataFrame:
    """The posting lists that hold nodes of several components: token, node, n, root, list (its length)."""
    placed = posted.join(groups, "node", "left").select("token", "node", "n", F.coalesce("root", "node").alias("root"))
    several = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("list"))
    return materialize(placed.join(several.where("lo < hi").select("token", "list"), "token"), "dup-placed")


def _drawn(placed: DataFrame, turn: int, percent: int) -> DataFrame:
    """Pairs of a node and nodes drawn from the largest component of a list they share, which is not the node's own."""
    draws = [F.min(F.struct(F.xxhash64("token", "node", F.lit(DRAWS * turn + k)).alias("h"), "node", "n")) for k in range(DRAWS)]
    largest = placed.groupBy("token", "root").agg(F.count("*").alias("size"), F.array(*draws).alias("hubs"))
    largest = largest.groupBy("token").agg(F.max_by(F.struct("root", "hubs"), F.struct("size", "root")).alias("l"))
    met = placed.join(largest, "token").where("root <> l.root").select("node", "n", F.explode("l.hubs").alias("hub"))
    met = met.where(_sizes_allow(F.col("n"), F.col("hub.n"), percent))
    return _most(met.groupBy("node", F.col("hub.node").alias("b")).agg(F.count("*").alias("hits")), DRAWN)


def _by_shingles(heavy: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Candidate pairs among ``heavy`` nodes (node, n, root) by an exact prefix filter on their sets."""
    sets = _texts(heavy, nodes, texts).mapInArrow(_shingled(words), "node long, shingles array<long>")
    rows = materialize(sets.select("node", F.explode("shingles").alias("x")), "dup-shingles")
    shared = rows.groupBy("x").agg(F.count("*").alias("df")).where("df > 1")
    rows = rows.join(shared, "x").join(heavy, "node")
    least = F.floor((percent * F.col("n") + 99) / 100)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("df", "x"))).withColumn(
        "in_common", F.count("*").over(Window.partitionBy("node")))
    rows = rows.where((F.col("in_common") >= least) & (F.col("n") - F.col("in_common") + F.col("place") <= F.col("n") - least + 1))
    # from its first common shingle on, a pair has in common at most what each still has in common with any
    most = (F.col("in_common") - F.col("place") + 1).alias("most")
    return _pairs(rows.select("x", "node", "n", "root", most), "x", percent)


def _confirm(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The links among candidate pairs (a, b): signatures first, then full sets."""
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("tokens").alias(f"tokens_{side}")), side)
    near = pairs.where(F.size(F.array_intersect("tokens_a", "tokens_b")) >= MATCHES).select("a", "b")
    near = materialize(near, "dup-near")
    used = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    used = _texts(used, nodes, texts)
    for side in ("a", "b"):
        near = near.join(used.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), side)
    return materialize(near.mapInArrow(_confirmed(words, percent), "a long, b long"), "dup-links")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                    percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, h (xxhash64 of its text), n_shingles, component_id, root, kept."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))
    signed = materialize(texts.mapInArrow(_signed(words), "doc_id long, h long, n long, digest binary, tokens array<long>"),
                         "dup-signed")
    nodes = (signed.where("n > 0").groupBy("digest")
             .agg(F.min(F.struct("doc_id", "h")).alias("rep"), F.min("doc_id").alias("least"),
                  F.first("n").alias("n"), F.first("tokens").alias("tokens")))
    # a node's number fits 50 bits, so that 13 bits of weight can precede it
    number = F.monotonically_increasing_id()
    nodes = nodes.withColumn("node", F.shiftleft(F.shiftright(number, 33), 30) + number.bitwiseAND(F.lit((1 << 30) - 1)))
    nodes = materialize(nodes, "dup-nodes")

    posted = nodes.select("node", "n", F.explode("tokens").alias("token"))
    shared = posted.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    posted = posted.join(shared, "token")
    rare = Window.partitionBy("node").orderBy(F.desc("df"), "token")
    every = Window.partitionBy("node")
    posted = (posted.withColumn("place", F.row_number().over(rare))
              .withColumn("weight", F.least(F.sum(F.round(8 * F.log2("df"))).over(every), F.lit(8191)).cast("long"))
              .where(F.col("place") >= MATCHES))
    posted = materialize(posted.select("token", "node", "n", ((8191 - F.col("weight")) * F.lit(1 << 50) + F.col("node")).alias("rank")),
                         "dup-posted")

    hubs = posted.groupBy("token").agg(F.min("rank").alias("hub"))
    met = (posted.join(hubs, "token").where("hub <> rank")
           .groupBy("node", "hub").agg(F.count("*").alias("hits"), F.min("n").alias("n")))
    met = met.join(nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b")),
                   F.col("hub").bitwiseAND(F.lit((1 << 50) - 1)) == F.col("b")).where(_sizes_allow(F.col("n"), F.col("n_b"), percent))
    links = _confirm(_most(met, HUBS), nodes, texts, words, percent)
    # lists inside one component have nothing left to find
    placed = _across(posted, components(links, "a", "b"))
    for turn in range(ROUNDS):
        pairs = materialize(_drawn(placed, turn, percent), "dup-drawn")
        found = _confirm(pairs, nodes, texts, words, percent)
        n = found.count()
        if n:
            links = links.unionByName(found)
            placed = _across(placed.select("token", "node", "n"), components(links, "a", "b"))
        if YIELD * n < pairs.count() or not n:
            break
    heavy = placed.where(F.col("list") > LIGHT).select("node", "n", "root").distinct()
    across = _pairs(placed.where(F.col("list") <= LIGHT), "token", percent).unionByName(
        _by_shingles(heavy, nodes, texts, words, percent)).distinct()
    links = links.unionByName(_confirm(across, nodes, texts, words, percent))
    groups = components(links, "a", "b")
    named = nodes.select("node", "digest", "least").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("digest", "component_id", "root")
    out = signed.select("doc_id", "h", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "h", F.col("n").alias("n_shingles"), component.alias("component_id"), "root",
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                percent: int = PERCENT) -> DataFrame:
    """The input rows without near-duplicates: of every component the row of smallest id stays.

    Rows without words stay. Rows repeated whole count as copies: one of
    them stays; among rows of equal id and text that differ elsewhere, any.
    """
    found = near_duplicates(docs, doc_id, text, words, percent).where("kept")
    stay = found.where("root is not null").groupBy("root").agg(
        F.min(F.struct("doc_id", "h")).alias("k"), F.count("*").alias("n"))
    stay = materialize(stay.select("k.doc_id", "k.h", "n"), "dup-stay").select(F.col("doc_id").alias("_id"), F.col("h").alias("_k"), "n")
    empty = ~F.coalesce(F.col(text), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    rows = docs.withColumn("_h", F.xxhash64(F.col(text)))
    met = (F.col("_h") == F.col("_k")) & F.col(doc_id).cast("long").eqNullSafe(F.col("_id"))
    once = rows.join(stay.where("n = 1"), met, "left_semi")
    repeated = rows.join(stay.where("n > 1"), met, "left_semi").dropDuplicates([doc_id, "_h"])
    return once.unionByName(repeated).drop("_h").unionByName(docs.where(empty))
