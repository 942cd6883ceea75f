import os
import zlib

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from bookweave.llm import bpe, decontam, pii, queries
from bookweave.llm.simhash import jaccard, shingle_set

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def small(spark, tmp_path):
    """A table whose fate is known row by row: (id, text, kept)."""
    base = [f"word{i} and the thing of it that was over there number {i} said again " + " ".join(f"w{i}x{j}" for j in range(60)) for i in range(30)]
    german = [f"das ist nicht der und die mit {i} für ein über schön " + " ".join(f"zungheit{i}k{j}" for j in range(60)) for i in range(30)]
    item = "a benchmark item that must never be in a training corpus, whatever the occasion may be"
    rows = [(i, t, "en", True) for i, t in enumerate(base)] + [(100 + i, t, "de", True) for i, t in enumerate(german)]
    rows += [(200, base[0], "en", False), (201, base[1] + " tail", "en", False), (202, None, "en", False), (203, "12 34 -- !!", "en", False), (204, "", None, False)]
    rows += [(205, base[2][::-1] + " " + item.upper() + " more", "en", False), (206, "write to someone@example.org about the thing of " + " ".join(f"u{j}" for j in range(40)), "en", True)]
    df = spark.createDataFrame([(i, t, lang, f"src{i % 3}", len(t or "")) for i, t, lang, _ in rows], SCHEMA)
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows


def test_run_on_planted_rows(spark, tmp_path):
    rows = small(spark, tmp_path)
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {i for i, _, _, kept in rows if kept}
    names = pii.Pseudonyms(queries.PSEUDONYM_KEY)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path(corpus_pipeline.VOCABULARY)), special_tokens={})
    for i, t, lang, kept in rows:
        if kept:
            want = names.replace(t)[0]
            assert out[i].text == want and out[i].n_chars == len(want) and out[i].lang == lang
            assert out[i].ids == library.encode_ordinary(want) and out[i].intact
    assert "someone@example.org" not in out[206].text and "@example.org" in out[206].text


def test_stages_keep_the_columns_of_documents_and_meet_empty_tables(spark, tmp_path):
    small(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for frame in (docs.limit(0), docs.limit(2)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, frame, str(tmp_path))
            assert out.columns[:5] == COLUMNS
            assert i == 4 or len(out.columns) == 5
            assert out.count() <= frame.count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_near_duplicate_and_decontamination_stages_on_given_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {i: shingle_set(t, 5) for i, t in texts.items()}
    label = {i: i for i in texts}
    ids = sorted(texts)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if label[i] != label[j] and jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert set(label.values()) <= kept and len(kept - set(label.values())) <= 1

    items = {r.item_id: decontam.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    clean = {r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, SF).collect()}
    held = {i for i, t in texts.items() if any(x in decontam.normal(t) for x in items.values())}
    assert not held & clean
    assert len(clean) >= len(texts) - len(held) - 2


def test_language_stage_drops_what_is_in_no_learned_language(spark, tmp_path):
    small(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    strange = ["Это текст на другом языке, которого здесь никто не учил", "これは学習されていない言語の文章です", "ΩΨΦΞ Ω ΣΔΘΛ ΠΓΨΩ ΞΦΣ"]
    foreign = spark.createDataFrame([(900 + i, t, None, "x", len(t)) for i, t in enumerate(strange)], SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(foreign), str(tmp_path)).collect()}
    assert kept == {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}


def test_hot_source_and_labels_do_not_change_what_is_kept(spark, tmp_path):
    small(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    one = corpus_pipeline.language(spark, docs, str(tmp_path)).withColumn("source", F.lit("x"))
    assert {zlib.crc32((r.text or "").encode()) for r in one.collect()} == {zlib.crc32((r.text or "").encode()) for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
