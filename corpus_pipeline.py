"""The corpus pipeline: successive stages over ``documents``, each written and read again.

Every stage takes what its predecessor kept and returns the columns of
documents; the last returns the token ids. Filters keep a document unless the
operator rejects it:

1. toxicity: rows scored 0.7 or more go. The model learns from ``labels`` of
   the documents at hand.
2. language id: rows without a letter, and rows whose predicted language has a
   probability below 0.4, go. The network learns from their ``lang``.
3. near-duplicates on five-word shingles at 0.8: of each group the row of
   smallest id stays.
4. mixing: every row occurs as often as the mix takes it (0 to 2 times); the
   copies of rows equal in id, text and source go to them in the order of
   their other columns, the most to the first.
5. SentencePiece: ids of every row, with the digest of the decoded text.

Rows with null text or id pass the stages by the operators' defined results (a
row with null text has no letter and goes in stage 2); very long texts are read whole. Further columns of
documents stay as they are, also if they bear names that the stages or operators use themselves.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from intentlab.config import materialize, scratch_path
from intentlab.llm import langid, mixing, neardup, spm, toxicity

LEAST_LANGUAGE_SCORE = 0.4
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _kept(docs: DataFrame) -> dict:
    return {c: F.col(c) for c in docs.columns}


def _own(name: str, docs: DataFrame) -> str:
    """A column name that the documents do not have (names differ regardless of case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents under positional names that no operator uses, and the way back."""
    back = {f"column_{i}_": c for i, c in enumerate(docs.columns)}
    return docs.toDF(*back), back


def _as_before(rows: DataFrame, back: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(n).alias(c) for n, c in back.items()])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, back = _renamed(docs)
    text = next(n for n, c in back.items() if c == "text")
    scored = toxicity.score(rows, model, text=text, keep=_kept(rows))
    return _as_before(scored.where(F.col("score") < toxicity.THRESHOLD), back)


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised."""
    rows, back = _renamed(docs)
    text = next(n for n, c in back.items() if c == "text")
    found = langid.predict(rows, langid.train(docs), text=text, keep=_kept(rows))
    return _as_before(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)), back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    rows, back = _renamed(docs)
    doc_id, text = (next(n for n, c in back.items() if c == name) for name in ("doc_id", "text"))
    return _as_before(neardup.one_of_each(rows, doc_id, text), back)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    h, rows_n, taken_n, n, before, copies_n, i = (_own(c, docs) for c in ("_h", "_rows", "_taken", "_n", "_before", "_copies", "_i"))
    key, source, digest = (_own(c, docs) for c in ("_id", "_s", "_k"))
    taken = mixing.mix(docs.select("doc_id", "text", "source", F.xxhash64("text").alias(h)), keep=(h,))
    # of a group's rows, how many are taken at least once, twice
    at_least = [F.sum((F.col("copies") >= k).cast("long")) for k in range(1, mixing.MAX_COPIES + 1)]
    taken = taken.groupBy("doc_id", h, "source").agg(F.count("*").alias(rows_n), F.array(*at_least).alias(taken_n)).where(F.col(taken_n)[0] > 0)
    taken = taken.select(F.col("doc_id").alias(key), F.col(h).alias(digest), F.col("source").alias(source), rows_n, taken_n)
    # read twice below: a written table has a short plan, so the driver need not plan and compile the mix once more
    taken = materialize(taken, "mix-taken")
    met = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(digest)) & F.col("source").eqNullSafe(F.col(source))
    rows = docs.join(taken, met)
    kept = [*docs.columns, digest, taken_n]
    zero, one = (F.lit(v).cast("long") for v in (0, 1))
    alone = rows.where(F.col(rows_n) == 1).select(*kept, one.alias(n), zero.alias(before))
    # rows repeated whole count together; what differs in other columns only is numbered
    several = rows.where(F.col(rows_n) > 1).groupBy(*kept).agg(F.count("*").alias(n))
    w = Window.partitionBy("doc_id", digest, "source").orderBy(*docs.columns)
    several = several.withColumn(before, F.sum(n).over(w) - F.col(n))
    rows = alone.unionByName(several)
    copies = F.aggregate(F.col(taken_n), zero, lambda a, t: a + F.greatest(
        F.least(t, F.col(before) + F.col(n)) - F.col(before), F.lit(0)))
    rows = rows.withColumn(copies_n, copies).where(F.col(copies_n) > 0)
    return rows.withColumn(i, F.explode(F.sequence(one, F.col(copies_n)))).select(docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row."""
    return spm.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", drop_toxic), ("language id", keep_identified), ("near-duplicates", drop_near_duplicates),
          ("mixing", mix_sources), ("sentencepiece", tokenise)]
#: The classifiers, and the sentencepiece library, are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; every stage reads what its predecessor wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
