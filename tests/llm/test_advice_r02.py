"""Cases of the second review: work that was cut, on small tables."""

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from intentlab.llm import ann, idfiles, langid, mixing, toxicity, urls


def test_ids_of_added_tokens_are_the_librarys(spark):
    """The library as loaded knows <|endoftext|>; other texts are cut as before."""
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["ok <|endoftext|> ok", "a<|endoftext|>b c", "<|endoftext|>", "plain words\nhere", "<|endoftext|><|endoftext|> x\n y", "<|endof text|>"]
    want, start = [], 0
    for i, text in enumerate(texts):
        ids = [*library.encode(text, add_special_tokens=False).ids, idfiles.END_ID]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert library.encode(texts[0], add_special_tokens=False).ids == [482, 220, 50256, 12876]
    got = idfiles.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    assert sorted(map(tuple, got)) == want


def test_every_language_is_learned_from(spark, monkeypatch):
    """Null ids and repeated rows: each language has its full number of distinct rows in the sample."""
    rows = [(None, f"{lang} wort {chr(97 + i % 26)}{chr(97 + i // 26)}", lang) for lang in ("de", "en", "es", "fr") for i in range(300)]
    rows += [(1, "the one", "xx")] * 300
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    seen = {}
    monkeypatch.setattr(langid, "fit", lambda x, y, langs: seen.update(x=x, y=y, langs=langs) or {"langs": langs})
    langid.train(labelled, per_lang=20)
    assert seen["langs"] == ["de", "en", "es", "fr", "xx"] and np.bincount(seen["y"]).tolist() == [20, 20, 20, 20, 1]
    assert len(np.unique(seen["x"], axis=0)) == 81


def test_probes_are_measured_for_every_length(spark):
    """Two short vectors, one of them first in the draw, leave the recall of the long ones as it is."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 24))
    ids = spark.range(0, 40000, 20).withColumn("h", F.xxhash64("id")).toPandas()
    first = int(ids[ids.id >= 900].sort_values("h").id.iloc[0])
    assert ids[ids.id == first].h.item() < ids[ids.id < 900].h.min()
    rows = [(i, [float(v) for v in x[i]]) for i in range(900)] + [(first, [1.0, 2.0, 3.0]), (first + 1, [1.0, 2.0, 2.5])]
    got = {(r.query_id, r.vec_id) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()}
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    assert np.mean([(q, i) in got for q in range(0, 900, 20) for i in np.argsort(-s[q])[:20]]) >= 0.9
    assert (first, first + 1) in got


def test_small_and_deep_branches_stand_alone(spark):
    small = [f"http://h.example.com/de/p{i}" for i in range(19)] + [f"http://h.example.com/{s}/p{i}" for s in ("en", "fr") for i in range(3)]
    deep = [f"http://deep.com/a/b/c/d/e/f/g/{s}/{i}" for s in ("bad", "good") for i in range(30)]
    rules = (*urls.RULES, *[(f"deep.com/a/b/c/d/e/f/g/bad/{i}", "block") for i in range(10, 30)])
    df = spark.createDataFrame(list(enumerate(small + deep)), "page_id long, url string")
    got = urls.judge(df, rules=rules).collect()
    assert {r.verdict for r in got if "/de/" in r.path or "/bad/" in r.path} == {"block"}
    assert {r.verdict for r in got if "/de/" not in r.path and "/bad/" not in r.path} == {"allow"}
    assert all("**" not in r.template for r in got)


def test_repeated_rows_share_what_the_mix_takes(spark):
    rows = [(i, f"text {i} " + "w " * (i % 7), lang, s, 9) for i in range(90) for s in (["abc"[i % 3]]) for lang in ("de", "de", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    taken = mixing.mix(docs.withColumn("key", F.xxhash64("text"))).groupBy("doc_id").agg(F.sum("copies").alias("n"), F.sum("taken").alias("words")).where("n > 0")
    got = corpus_pipeline.mix_sources(spark, docs, "").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum(mixing.n_words(F.col("text"))).alias("words"), F.sum((F.col("lang") == "en").cast("int")).alias("en"))
    assert sorted((r.doc_id, r.n, r.words) for r in taken.collect()) == sorted((r.doc_id, r.n, r.words) for r in got.collect())
    assert max(r.en for r in got.collect()) <= mixing.MAX_COPIES
    assert corpus_pipeline.mix_sources(spark, docs, "").dtypes == docs.dtypes


def test_a_shared_prefix_is_no_mention():
    """Words that begin like a term get no counterfactual copies; the term itself does."""
    def model(word, penalty):
        texts = [f"w{chr(97 + i % 13)} {word if i % 2 else 'calm'}" for i in range(400)]
        lists = [np.unique(toxicity.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[1]) for t in texts]
        return toxicity.fit(lists, np.arange(400) % 2, (0.5, 0.5), penalty=penalty, steps=60)["weights"]
    for word in ("strange", "straightens", "blinds", "christmas", "buddhistic"):
        assert (model(word, 0.0) == model(word, 30.0)).all(), word
    assert (model("straight", 0.0) != model("straight", 30.0)).any()
