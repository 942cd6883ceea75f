import random

import numpy as np
from pyspark.sql import functions as F

from bookweave.llm import langid
from bookweave.llm.queries import op3_language


def corpus(n, seed=1):
    rng = random.Random(seed)
    parts = {"aa": ["ka", "ro", "mi"], "bb": ["sch", "ung", "keit"], "cc": ["éa", "ou", "ç"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(parts))
        text = " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 40)))
        rows.append((i, text, lang if i % 9 else None, lang))
    return rows


def test_counts_cover_whole_text(monkeypatch):
    text = "Ab1 ü漢" * 50
    at, n = langid.counts(text)
    assert n.sum() == 3 * len(text) - 3
    monkeypatch.setattr(langid, "PIECE", 7)
    again = langid.counts(text)
    assert (at == again[0]).all() and (n == again[1]).all()


def test_ftrl_is_sparse_and_separates():
    rows = [(np.array([i % 2, 5]), np.array([1.0, 0.1]), i % 2) for i in range(200)]
    w, b = langid.ftrl(rows, 2)
    assert (w[6:] == 0).all()
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0]


def test_temperature_lowers_loss():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 3, 400)
    logits = rng.normal(size=(400, 3))
    logits[np.arange(400), labels] += 1
    t = langid.fit_temperature(logits * 8, labels)
    assert 3 < t < 20


def test_query_on_held_out_rows(spark, tmp_path):
    rows = corpus(600)
    rows += [(1000, None, "aa", None), (1001, "", "aa", None), (1002, "12 34 !!", "bb", None), (None, "karo miro", "aa", "aa"), (1003, "ungkeit " * 40000, None, "bb"), (5, rows[5][1], rows[5][2], rows[5][3])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string").withColumns({"score": F.lit("x"), "held_out": F.lit(1)})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = op3_language(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    truth = {r[0]: r[3] for r in rows}
    import zlib

    for r in out:
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if truth[r.doc_id] is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
    known = [r for r in out if truth[r.doc_id] and r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in known) >= 0.98 * len(known)


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows = corpus(300)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string").withColumn("held_out", langid.held_out())
    a = langid.train(df.where("not held_out"))
    b = langid.train(df.withColumn("lang", F.when(F.col("held_out"), F.lit("zz")).otherwise(F.col("lang"))).where("not held_out"))
    assert a.languages == b.languages and (a.weights == b.weights).all()


def test_empty_and_unlabelled_tables(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.predict(df, langid.train(df)).first().lang_pred == "und"
    assert langid.predict(df.limit(0), langid.train(df.limit(0))).count() == 0


def test_other_scripts_and_junk_are_not_familiar(spark):
    rows = corpus(600)
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string"))
    strange = ["Это текст на другом языке, которого здесь никто не учил", "これは学習されていない言語の文章です", "qzx jwv xqk zzkw vqj", "%&$ x ~~ y |||", None, ""]
    told = {r.text: r for r in langid.predict(spark.createDataFrame([(t,) for t in strange] + [(t,) for _, t, _, _ in rows[:200]], "text string"), model).collect()}
    assert max(told[t].familiar for t in strange) < 0.5
    assert min(told[t].familiar for _, t, _, _ in rows[:200]) > 0.9
    assert all(0.3 <= told[t].score < 1 for _, t, _, _ in rows[:200])


def test_temperature_of_rows_that_are_all_right_is_no_certainty():
    labels = np.arange(300) % 3
    logits = np.full((300, 3), -1.0)
    logits[np.arange(300), labels] = 1.0
    p = langid.softmax(logits / langid.fit_temperature(logits, labels))
    assert 0.97 < p[np.arange(300), labels].mean() < 0.999
