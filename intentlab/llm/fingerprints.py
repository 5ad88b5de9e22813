"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A text's words are its runs of characters other than space and ``\\t``-``\\r``.
Every run of five successive words is a shingle (a shorter text is one
shingle, an empty one has none). A shingle's hash is ``xxhash64`` over the
``xxhash64`` of its words, cut to its upper 48 bits. The sketch keeps the
``k`` smallest different hashes, ascending. Two sketches merge into the
sketch of the union, so sketches of parts make the sketch of the whole.

From sketches A and B, with U the k smallest hashes of their union:

* resemblance  = |U in A and B| / |U|
* containment of A in B = |U in A and B| / |U in A|
* distinct shingles = the size, if below k; else (k - 1) / (largest / 2**48)

Defined results: a null text is the empty text; equal texts have equal
sketches; two empty sketches have resemblance 1, an empty and a non-empty
one 0; containment of an empty sketch is 1. Everything is built from SQL
functions inside one row, however long its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import with_next_row

K = 128
WORDS = 5
HASH_BITS = 48
HEX = HASH_BITS // 4
SPACE = "[\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """The words of a text; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def sketch_of_hashes(hashes: Column, k: int = K, n: int = WORDS) -> Column:
    """The sketch from a text's word hashes (a column, referenced often: name it first)."""
    starts = F.slice(hashes, 1, F.greatest(F.size(hashes) - (n - 1), F.lit(0)))
    shingles = F.transform(starts, lambda x, i: F.shiftrightunsigned(
        F.xxhash64(x, *[F.get(hashes, i + j) for j in range(1, n)]), 64 - HASH_BITS))
    short = F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(
        F.array(F.shiftrightunsigned(F.xxhash64(hashes), 64 - HASH_BITS)))
    return (F.when(F.size(hashes) < n, short)
            .otherwise(F.slice(F.array_distinct(F.sort_array(shingles)), 1, k)))


def add_sketch(df: DataFrame, text: str, out: str, k: int = K, n: int = WORDS) -> DataFrame:
    """``df`` with the sketch of column ``text`` as array<bigint> ``out`` (replaces a column of that name)."""
    return (df.withColumn("_word_hashes", word_hashes(F.col(text)))
            .withColumn(out, sketch_of_hashes(F.col("_word_hashes"), k, n)).drop("_word_hashes"))


def as_text(sketch: Column) -> Column:
    """Fixed-width hexadecimal form: 12 digits a hash, ascending."""
    return F.lower(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), HEX, "0")), ""))


def from_text(text: Column) -> Column:
    at = F.sequence(F.lit(0), (F.length(text) / HEX).cast("int") - 1)
    return F.when(F.length(text) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(at, lambda i: F.conv(F.substring(text, i * HEX + 1, F.lit(HEX)), 16, 10).cast("long")))


def union_sketch(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard resemblance of the texts behind two sketches, 0 to 1."""
    both = F.size(F.array_intersect(union_sketch(a, b, k), F.array_intersect(a, b)))
    n = F.least(F.size(F.array_union(a, b)), F.lit(k))
    return F.when(n == 0, F.lit(1.0)).otherwise(both / F.greatest(n, F.lit(1)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of A's shingles that B has too."""
    u = union_sketch(a, b, k)
    of_a = F.size(F.array_intersect(u, a))
    both = F.size(F.array_intersect(u, F.array_intersect(a, b)))
    return F.when(of_a == 0, F.lit(1.0)).otherwise(both / F.greatest(of_a, F.lit(1)))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of different shingles (exact below k)."""
    top = F.greatest(F.element_at(sketch, -1), F.lit(1))
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / (top / float(2 ** HASH_BITS)))


def merge(df: DataFrame, by: list[str], sketch: str, out: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per group: the k smallest different hashes of the group's sketches.

    Hashes are made distinct by a keyed aggregation (copies combine before
    the shuffle); the rank limit is applied before the shuffle as well as
    after it, so a group of any size sends k rows a task.
    """
    hashes = df.select(*by, F.explode(sketch).alias("_h")).distinct()
    w = Window.partitionBy(*by).orderBy("_h")
    least = hashes.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k)
    return least.groupBy(*by).agg(F.sort_array(F.collect_list("_h")).alias(out))


def edited_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited form, with two likenesses.

    The edited text has its last floor(n_chars / 2) code points replaced by
    the first as many (or all) of the next document by ascending id; the
    last document takes the first one's. Rows of equal id follow in the
    order of their texts. A row without an id has no next document: its
    edited form is the text without that half, and near_next is null.
    """
    named = docs.select(doc_id, text).toDF("doc_id", "text") if (doc_id, text) != ("doc_id", "text") else docs.select(doc_id, text)
    if dict(named.dtypes)["doc_id"] != "bigint":
        named = named.withColumn("doc_id", F.col("doc_id").cast("long"))
    # no alias on the id: one kept in a single branch would hinder the reuse of the exchange of texts
    base = named.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def finish(df: DataFrame) -> DataFrame:
        half = F.floor(F.col("n_chars") / 2).cast("int")
        df = df.withColumn("edited", F.concat(F.expr("substring(text, 1, int(n_chars - floor(n_chars / 2)))"),
                                              F.substring(F.coalesce(F.col("next_row.text"), F.lit("")), F.lit(1), half)))
        df = add_sketch(df, "edited", "edited_sketch", k)
        return df.select(
            "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
            as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
            resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
            F.when(F.col("next_row").isNotNull(), resemblance(F.col("sketch"), F.col("next_row.sketch"), k)).alias("near_next"),
            distinct_shingles(F.col("sketch"), k).alias("shingles"),
            containment(F.col("sketch"), F.col("edited_sketch"), k).alias("in_edited"))

    def sketched(df: DataFrame) -> DataFrame:
        return add_sketch(df.withColumn("n_chars", F.char_length("text").cast("long")), "text", "sketch", k)

    return finish(with_next_row(base.where("doc_id is not null"), "doc_id", {"text": "text", "sketch": "sketch"},
                                [F.col("text")], then=sketched)).unionByName(
        finish(sketched(base.where("doc_id is null")).withColumn(
            "next_row", F.lit(None).cast("struct<text:string,sketch:array<bigint>>"))))
