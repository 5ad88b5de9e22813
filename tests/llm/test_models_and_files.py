"""Classifiers, search, URL templates, quotations, id files and the pipeline on small tables."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from intentlab.llm import ann, idcoder, idfiles, langid, queries as Q, quotes, toxicity, urls

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "the cat idiot", None, "a", 3),
            (4, "12 34 !!", "de", None, 5), (5, "wort " * 20000, "de", "b", 100000), (5, "wort " * 20000, "de", "b", 100000)]
    return spark.createDataFrame([(*r, "x", 0.5) for r in rows], DOCS + ", lang_pred string, score double")


def test_counterfactual_penalty_spares_neutral_mentions():
    """Toxic sentences mention one group more often; the penalty takes that out of its weight."""
    rng, texts, toxic = np.random.default_rng(0), [], []
    for i in range(1500):
        bad = i % 2
        words = list(rng.choice([f"w{chr(97 + k)}" for k in range(20)], 8))
        if bad and rng.random() < 0.6:
            words[0] = rng.choice(["vile", "scum"])
        if rng.random() < (0.7 if bad else 0.05):
            words[1] = "muslims"
        texts.append(" ".join(words))
        toxic.append(bad)
    lists = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        lists.append(np.unique(toxicity.features(raw, np.array([0, len(raw)]))[1]))

    def scored(penalty):
        model = toxicity.fit(lists, np.array(toxic), (0.5, 0.5), penalty=penalty)
        data = [s.encode() for s in ("the muslims met wa wb", "the people met wa wb", "you vile scum wa wb")]
        return toxicity.scores(model, np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    without, with_it = scored(0.0), scored(30.0)
    assert without[0] - without[1] > 0.15 and with_it[0] - with_it[1] < 0.3 * (without[0] - without[1])
    assert with_it[2] > 0.85


def test_toxicity_on_held_out_rows(spark):
    out = Q.QUERIES["op2_toxicity"](spark, MID).join(spark.read.parquet(f"{MID}/labels.parquet"), "doc_id").where("held_out").toPandas()
    ranks, pos = out.score.rank(), out.toxic == 1
    auc = (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.8 and out.predicted[~pos].mean() < 0.02 and set(out.predicted) == {0, 1}


def test_toxicity_of_odd_rows_and_without_labels(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(2, None), (5, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model, keep={"doc_id": F.col("doc_id")}).collect()
    assert len(rows) == 7 and all(0 <= r.score < 0.01 for r in rows)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_language_on_held_out_rows(spark):
    out = Q.QUERIES["op10_language_id"](spark, MID).join(spark.read.parquet(f"{MID}/documents.parquet").select("doc_id", "lang"), "doc_id")
    out = out.where("held_out").toPandas()
    assert (out.lang == out.lang_pred).mean() > 0.95 and out.score.between(0, 1).all()


def test_language_of_odd_rows(spark):
    docs = odd_documents(spark)
    rows = langid.predict(docs, langid.train(docs), keep={"doc_id": F.col("doc_id")}).collect()
    assert sorted(r.lang_pred for r in rows) == ["de"] * 3 + ["und"] * 4
    nothing = langid.predict(docs, langid.train(docs.limit(0))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}


def test_windows_cover_every_byte():
    data = np.arange(1, 200, dtype=np.uint8)
    x, n = langid.windows(data, np.array([0, 0, 3, 67, 199]))
    assert n.tolist() == [0, 1, 1, 3] and set(x[2:].ravel()) >= set(langid.LOWER[data[67:]])
    assert (x[1] == langid.LOWER[data[3:67]]).all() and (x[0][3:] == 0).all()


@pytest.fixture(scope="module")
def space(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 24))
    x[500:540] = x[20]
    rows = [(i, [float(v) for v in x[i]]) for i in range(900)]
    rows += [(900, None), (920, [0.0] * 24), (940, [float("nan")] * 24), (960, [None] + [1.0] * 23), (980, [float("inf")] + [1.0] * 23),
             (None, [1.0] * 24), (1000, [1.0] * 7), (3, rows[3][1])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).repartition(4), x


def brute(x, ids, queries, k):
    out = {}
    for q in queries:
        s = [(-float((x[q] * x[i]).sum()), i) for i in ids if i != q]
        out[q] = [(i, -v) for v, i in sorted(s)[:k]]
    return out


@pytest.mark.parametrize("probes", [None, 48])
def test_nearest_neighbours(space, probes):
    df, x = space
    rows = ann.search(df, F.col("vec_id") % 20 == 0, k=20, probes=probes).collect()
    want = brute(x, range(900), range(0, 900, 20), 20)
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() - {1000} == want.keys() and 1000 not in got
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    if probes == 48:  # all axes of all tables: the exact result, ties by id
        assert all([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in want)
        assert all(a[1] == pytest.approx(b[1], abs=1e-9) for q in want for a, b in zip(got[q], want[q]))
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_recall_on_the_given_vectors(spark):
    data = spark.read.parquet(f"{MID}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.stack(data.embedding).astype(float)
    want = brute(x, range(len(x)), range(0, len(x), 20), 20)
    got = {(r.query_id, r.vec_id) for r in Q.QUERIES["op4_nearest_neighbours"](spark, MID).collect()}
    assert np.mean([(q, i) in got for q in want for i, _ in want[q]]) >= 0.9


def test_rules_and_parts_of_urls(spark):
    cases = [("http://A.Example.NET/en/1?x=/q", "a.example.net", "/en/1", "example.net/en/", "allow"),
             ("https://example.net", "example.net", "", None, "allow"), ("x://net/", "net", "/", "net/", "block"),
             ("https://my.example.com/de/7#a", "my.example.com", "/de/7", "example.com/de/", "block"),
             ("https://notexample.com/de/7", "notexample.com", "/de/7", None, "allow"),
             ("http://a.org/fr/", "a.org", "/fr/", "org/fr/", "allow"), ("http://É.ORG/fr", "É.org", "/fr", None, "allow"),
             (None, "", "", None, "allow"), ("mailto:x", "", "", None, "allow"), ("", "", "", None, "allow"),
             ("a://b?c://d.net/", "b", "", None, "allow"), ("a://x.net/en/", "x.net", "/en/", "net/", "block")]
    df = spark.createDataFrame([(i, c[0], "h", "p") for i, c in enumerate(cases)], "page_id long, url string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(df).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}
    assert urls.judge(df.limit(0)).count() == 0


def test_templates_generalise_and_reject(spark):
    """Rules block most of a branch; its other pages go with it, its siblings stay and merge."""
    rows = [f"http://h.com/{s}/item{i}/p{i}" for s in ("bad", "good", "fine") for i in range(60)]
    paths = spark.createDataFrame([(i, u) for i, u in enumerate(rows * 2)], "page_id long, url string")
    rules = tuple((f"h.com/bad/item{i}", "block") for i in range(2, 10))
    got = urls.judge(paths, rules=rules).collect()
    assert len(got) == 360
    assert {r.verdict for r in got if "/bad/" in r.path} == {"block"} and {r.verdict for r in got if "/bad/" not in r.path} == {"allow"}
    assert {r.template for r in got if "/bad/" not in r.path} == {"/*/item{n}/p{n}"}


def test_quotation_links(spark):
    rows = [(1, 0, "user", "How do I sort a list?\nIt is long."), (1, 1, "assistant", "> how do I sort, a list?\nUse sorted()."),
            (1, 2, "user", ">> How do I sort a list?\n> Use sorted().\nAnd in place?"), (1, 3, "user", "> How do I sort a list? It\n> is long.\nAlso here."),
            (1, 4, "user", "> nobody said this\n"), (1, 5, "assistant", "> And in place?\nUse .sort()"), (1, 5, "assistant", "> And in place?\nUse .sort()"),
            (2, 0, "user", "> Use sorted().\nno"), (None, 1, "user", "> x"), (3, None, None, None), (3, 1, "user", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, thread string")
    got = {(r.conv_id, r.turn): r for r in quotes.linked(df).collect()}
    assert len(quotes.linked(df).collect()) == len(rows)
    assert [got[1, t].reply_to for t in range(6)] == [None, 0, 1, 0, None, 2] and [got[1, t].depth for t in range(6)] == [0, 1, 2, 1, 0, 3]
    assert got[1, 2].text == "And in place?" and (got[1, 2].n_quotes, got[1, 2].n_linked) == (2, 2) and got[2, 0].reply_to is None
    order = sorted(range(6), key=lambda t: got[1, t].thread)
    assert order == [0, 1, 2, 5, 3, 4] and got[None, 1].thread is None and got[3, None].text == ""
    assert quotes.in_reply_order(quotes.linked(df.limit(0))).count() == 0


def test_quotation_sql_on_quoted_conversations(spark, tmp_path):
    """The SQL on the given conversations, each message quoting the two before it."""
    from oracle_check import compare
    import duckdb
    from pyspark.sql import Window
    w = Window.partitionBy("conv_id").orderBy("turn")
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    mark = lambda c, m: F.concat(F.lit(m), F.regexp_replace(c, "\n", "\n" + m), F.lit("\n"))
    df = df.withColumn("text", F.concat(F.coalesce(mark(F.lag("text", 2).over(w), ">> "), F.lit("")), F.coalesce(mark(F.lag("text").over(w), "> "), F.lit("")), "text"))
    df.write.parquet(str(tmp_path / "conversations"))
    df = spark.read.parquet(str(tmp_path / "conversations"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations/*.parquet')")
    status, message = compare(quotes.linked(df).toPandas(), con.sql(quotes.SQL).fetchdf())
    assert status in ("exact", "close"), message
    assert quotes.linked(df).where("reply_to is not null").count() > 20


def test_coder_round_trip_and_damage():
    rng = np.random.default_rng(2)
    blocks = [np.zeros(0, np.uint16), np.array([65535], np.uint16), rng.integers(0, 65536, 3000).astype(np.uint16), np.zeros(8192, np.uint16),
              np.tile(rng.integers(0, 50000, 50), 90).astype(np.uint16), rng.zipf(1.3, 5000).clip(0, 65535).astype(np.uint16)]
    blocks += [rng.choice([0, 1, 255, 256], n).astype(np.uint16) for n in rng.integers(1, 400, 60)]
    coded = idcoder.encode_blocks(blocks)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, idcoder.decode_blocks(coded)))
    assert idcoder.encode_blocks(blocks[2:3])[0] == coded[2]  # blocks know nothing of each other
    assert len(coded[4]) < len(blocks[4]) / 4 and len(coded[3]) < 700
    for broken in (coded[2][:-1], coded[2][:9], b"XXXX" + coded[2][4:], coded[2][:40] + bytes([coded[2][40] ^ 1]) + coded[2][41:]):
        with pytest.raises(ValueError):
            idcoder.decode_blocks([broken])


def expected_ids(rows):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_id_files(spark):
    texts = [None, "", "a  b\n\nc", " x", "y ", "it's  don't\tx", "<|endoftext|> ok", "word " * 30000, "é\u00a0ü 日本\r\n", "a\nb c", "!" * 50]
    rows = list(zip([9, -4, 10**12, 3, 4, 5, 6, 7, 8, 11, 12], texts)) + [(7, "twin")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(3)
    got = idfiles.round_trip(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted(map(tuple, got)) == sorted(expected_ids(sorted(rows, key=lambda r: (r[0], r[1] or ""))))
    assert idfiles.round_trip(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_pipeline_stages(spark):
    docs = odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert [s.split()[0] for s, _ in corpus_pipeline.STAGES] == ["toxicity", "language", "near-duplicates", "mixing", "sentencepiece"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, docs, SMALL)
        assert rows.dtypes == docs.dtypes
        assert rows.join(docs, docs.columns, "left_anti").where("doc_id is not null and text is not null and source is not null").count() == 0
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SMALL)
    assert 0 < kept.count() < docs.count() and kept.where("doc_id = 5 and length(text) > 50000").count() == 1
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


def test_pipeline_run(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.count() > 100 and rows.where("n_tokens = 0").count() <= 1


def test_pipeline_stages_keep_columns_of_clashing_names(spark):
    names = ["score", "lang_pred", "_n", "_h", "_k", "_s", "_id", "_rows", "_taken", "_before", "_copies", "_i", "_scored", "key", "toxic", "n", "root", "kept"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).selectExpr("*", *[f"'{c} of ' || doc_id AS `{c}`" for c in names])
    docs.cache()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.dtypes == docs.dtypes
        rows = out.collect()
        assert rows and all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()
    docs.unpersist()
