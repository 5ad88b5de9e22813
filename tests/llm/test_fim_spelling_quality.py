"""Fill-in-middle, spelling variants and the quality classifier against brute force, on odd tables and held-out rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from intentlab.llm import docquality, fim, queries as Q, spelling

SMALL, MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, form string, n string, number int, score double"


def documents(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, "f", "n", 1, 0.5) for r in rows], DOCS).repartition(partitions)


ODD = [(1, None), (2, ""), (2, ""), (None, "one\ntwo\nthree"), (3, "no <M> marker\n"), (4, "a\r\nb\n\n\nc"), (5, "\n"),
       (5, "\n"), (6, "word ßé日本\n" * 20000), (6, "word ßé日本\n" * 20000), (6, "other text"), (-7, "x" * 100000), (8, "line 1\nline 2\nline 3\nline 4\n")]


# --- fill-in-middle ----------------------------------------------------------------------

def fim_by_hand(doc_id, text):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, t
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 50:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_fill_in_middle_of_odd_rows(spark):
    got = sorted(map(tuple, fim.digests(documents(spark, ODD)).collect()), key=repr)
    want = []
    for doc_id, text in ODD:
        *head, output = fim_by_hand(doc_id, text)
        want.append((doc_id, *head, sha(output), sha(text or "")))
    assert got == sorted(want, key=repr)


def test_fill_in_middle_outputs_restore(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    text = dict(docs.select("doc_id", "text").collect())
    rows = fim.outputs(docs).collect()
    assert len(rows) == docs.count() and {r.form for r in rows} >= {"psm", "spm"}
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == fim_by_hand(r.doc_id, text[r.doc_id])
        assert fim.restore(r.output, r.form) == (text[r.doc_id] or "")


def test_fill_in_middle_options_and_empty_table(spark):
    docs = documents(spark, ODD)
    assert fim.digests(docs.where("false")).collect() == []
    assert {r.form for r in fim.digests(docs, options=fim.Options(rate=0)).collect()} == {"plain"}
    only = fim.outputs(docs, options=fim.Options(spm_share=100, prefix="[p]", suffix="[s]", middle="[m]")).collect()
    assert {r.form for r in only if r.output} == {"spm"}
    assert sorted(fim.restore(r.output, r.form, fim.Options(prefix="[p]", suffix="[s]", middle="[m]")) for r in only) == sorted(
        t or "" for _, t in ODD)


def test_restoration_sorts_without_a_second_shuffle(spark):
    outputs = fim.assembled(documents(spark, ODD))
    again = fim._by_position(outputs.mapPartitions(fim._digested(fim.Options()), preservesPartitioning=True), outputs.getNumPartitions())
    assert again._jrdd.rdd().toDebugString().count("PairwiseRDD") == 1


def test_pieces_end_with_units_and_are_bounded():
    data = b"".join(b"%d\n" % i for i in range(20000)) + b"y" * 50000
    pieces = list(fim.cut_pieces(data, 0, len(data)))
    assert b"".join(pieces) == data and max(map(len, pieces)) <= fim.PIECE
    assert all(p.endswith(b"\n") for p in pieces[:5])


# --- spelling variants --------------------------------------------------------------------

def variants_by_hand(rows, every=31, ratio=10):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if every and h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    n = {w: c for w, c in count.items() if len(w) >= 7 and c >= 2}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[i + 1:] == b[i + 1:] if len(a) == len(b) else (a[i + 1:] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1:])
    beside = {w: [v for v in n if near(w, v)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in beside.items() if vs}
    form = {w: b for w, b in best.items() if n[b] >= ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted((w, form.get(w), root(w), c, len(beside[w]), n.get(form.get(w))) for w, c in n.items()), n


def made_texts():
    rng = np.random.default_rng(5)
    words = ["balloons", "baloons", "balloon", "straßen", "strassen", "straßens", "ballooons", "aaaaaaaa", "aaaaaaa", "aaaaaaab", "résumés",
             "resumés", "été" * 3]
    long = "lettere" * 30
    words += [long, long[:-1], long[:50] + "x" + long[50:], long[:50] + "y" + long[51:], "z" + long, "q" * 63, "q" * 64, "q" * 65, "q" * 66,
              "r" * 62 + "s", "r" * 64 + "s", "r" * 63 + "s"]
    rows = []
    for i in range(60):
        rows.append((i, " ".join(rng.choice(words, 12)) + ("," if i % 2 else " Balloons BALLOONS") * 3))
    rows += [(100 + i, "frequent " * 250 + "frequemt " * 12 + "frequemtt ") for i in range(3)]
    return rows + [(None, "Résumés 12 résumés"), (None, None), (7, ""), (200, "w" * 3000 + " v" + "w" * 2999), (201, "W" * 3000 + " v" + "w" * 2999)]


@pytest.mark.parametrize("every", [31, 0])
def test_spelling_variants_by_brute_force(spark, every):
    rows = made_texts()
    got = sorted(tuple(r) for r in spelling.variants(documents(spark, rows), every=every).collect())
    want, n = variants_by_hand(rows, every)
    assert got == want
    if not every:
        chain = {r[0]: r for r in got}
        assert chain["frequemtt"][1:3] == ("frequemt", "frequent")  # two steps
        assert chain["q" * 64][4] == 2 and chain["w" * 3000][4] == 1


def test_spelling_variants_without_words_and_slices(spark):
    assert spelling.variants(documents(spark, [(1, None), (2, "a b c"), (3, "once upon")])).collect() == []
    assert spelling.variants(documents(spark, ODD).where("false")).collect() == []
    run = re.compile(f"[{spelling.LETTERS}]+")
    text = "abc defgh  ijklmnop " * 50
    parts = list(spelling.slices(text, run, 13))
    assert "".join(parts) == text and Counter(w for p in parts for w in run.findall(p)) == Counter(run.findall(text))


def test_spelling_ranges_are_not_pairs(spark):
    """Rows of the ranges grow with the words, not with the pairs among them."""
    words = spark.createDataFrame([("abcdefg" + chr(97 + i), 2) for i in range(26)], "word string, n long")
    near = spelling.neighbours(spelling.numbered(words))
    assert sorted(near.select("n_near").distinct().collect()) == [(25,)] and near.count() == 26


# --- quality -------------------------------------------------------------------------------

def test_quality_on_held_out_rows(spark):
    out = Q.QUERIES["op13_quality"](spark, MID)
    assert out.count() == spark.read.parquet(f"{MID}/documents.parquet").count()
    out = out.join(spark.read.parquet(f"{MID}/labels.parquet"), "doc_id").where("held_out").toPandas()
    ranks, pos = out.score.rank(), out.quality == 1
    auc = (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.95 and out.predicted[pos].mean() > 0.98 and out.predicted[~pos].mean() < 0.3
    assert (out.predicted == (out.score >= 0.3)).all()


def test_quality_of_odd_rows_and_without_labels(spark):
    docs = documents(spark, ODD)
    empty = spark.createDataFrame([(2, None), (None, 1)], "doc_id long, quality int")
    model = docquality.train(docs, empty)
    scores = [r.score for r in docquality.score(docs, model, keep={"doc_id": F.col("doc_id")}).collect()]
    assert len(scores) == len(ODD) and set(scores) == {scores[0]} and scores[0] > 0.99
    one = docquality.train(docs, spark.createDataFrame([(2, 0), (5, 0)], "doc_id long, quality int"))
    assert max(r.score for r in docquality.score(docs, one).collect()) < 0.01
    both = spark.createDataFrame([(2, 0), (4, 1), (4, 0), (8, 1), (5, 0), (6, 1), (99, 1)], "doc_id long, quality int")
    model = docquality.train(docs, both, min_weight=0.1)
    rows = docquality.score(docs, model, keep={"doc_id": F.col("doc_id"), "form": F.col("form")}).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.form == "f" for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1  # null and empty texts
    assert docquality.score(docs.where("false"), model).collect() == []


def test_statistics_by_hand():
    texts = ["", "Ab  CD e1\nab", "### x### ###", "no"]
    data = [t.encode() for t in texts]
    x = docquality.statistics(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    of = {name: x[:, i] for i, name in enumerate(docquality.STATISTICS)}
    assert (x[0] == 0).all()
    assert of["log_bytes"][1] == np.log1p(12) and of["log_words"][1] == np.log1p(4)
    assert of["capital_words"][1] == 0.25 and of["digit_words"][1] == 0.25 and of["capitals"][1] == 3 / 12
    assert of["distinct_words"][1] == 1 and of["distinct_words"][2] == 2 / 3 and of["most_frequent_word"][2] == 2 / 3
    assert of["letterless_words"][2] == 2 / 3 and of["mark_ended_words"][2] == 1 and of["words_a_line"][1] == 2
    assert of["bytes_used"][3] == 2 / 256


def test_trees_equal_a_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.1)).astype(float)
    model = docquality.fit(x, y, np.ones(400), trees=20, depth=3)
    p = docquality.probabilities(model, x)
    assert ((p > 0.5) == (y == 1)).mean() > 0.97
    for i in range(0, 400, 37):
        s = model["bias"]
        for t in range(20):
            k = 0
            while k < 7:
                k = 2 * k + 1 + int(x[i, model["feature"][t, k]] > model["threshold"][t, k])
            s += model["leaf"][t, k - 7]
        assert abs(p[i] - 1 / (1 + np.exp(-s))) < 1e-12


def test_first_split_is_the_best_one():
    """The root of the first tree against a search over all values of all columns."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, (300, 4)).astype(float)
    y = (x[:, 2] + rng.normal(0, 2, 300) > 6).astype(float)
    model = docquality.fit(x, y, np.ones(300), trees=1, depth=1)
    p = y.mean()
    g, h = p - y, np.full(300, p * (1 - p))

    def gain(j, v):
        left = x[:, j] <= v
        if h[left].sum() < 1 or h[~left].sum() < 1:
            return 0
        return g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1)
    best = max((gain(j, v), j, v) for j in range(4) for v in np.unique(x[:, j]))
    assert (model["feature"][0, 0], model["threshold"][0, 0]) == best[1:]


def test_sql_of_the_new_queries(spark):
    from oracle_check import compare, duck
    con = duck(SMALL)
    for name in ("op11_fill_in_middle", "op12_spelling_variants"):
        status, message = compare(Q.QUERIES[name](spark, SMALL).toPandas(), con.sql(Q.SQL[name]).fetchdf())
        assert status == "exact", (name, message)
