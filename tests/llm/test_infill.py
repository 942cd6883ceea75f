import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from bookweave.llm import infill
from bookweave.llm.queries import op12_infill

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def rows():
    rng = random.Random(12)
    out = [(i, "".join(rng.choice(["word", "é漢", " ", "\n\t", "\x1c", " ", "<", "P>", "a"]) for _ in range(rng.randint(0, 30)))) for i in range(300)]
    out += [(400 + i, f"holds {m} in it") for i, m in enumerate(("<P>", "<S>", "<M>"))] + [(410 + i, "ends with a< bit <S <M") for i in range(20)]
    return [*out, (500, None), (501, ""), (502, "   "), (None, "no id at all here"), (7, "other text of the same id"), (7, "other text of the same id"), (503, "long word " * 60000), (-4, "negative id is here")]


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    form = "spm" if h4 % 100 < 80 else "psm"
    whole = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, form, len(prefix), len(middle), whole


def test_output_equals_brute_force_and_restores(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").withColumns({"n": F.lit("x"), "restored": F.lit(1), "extra": F.lit(2)})
    out = infill.restore(infill.fill_in_middle(df)).collect()
    assert len(out) == len(data) and {r.form for r in out} == {"plain", "psm", "spm"}
    for r in out:
        n, form, p, m, whole = brute(r.doc_id, r.text)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == (n, form, p, m, whole)
        assert r.restored == (r.text or "") and r.extra == 2
        assert r.output_sha256 == hashlib.sha256(whole.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256(r.restored.encode()).hexdigest()
    assert infill.restore(infill.fill_in_middle(df.limit(0))).count() == 0


def test_cut_splits_descriptors():
    rng = random.Random(3)
    for _ in range(200):
        pieces = [(rng.randint(0, 1), rng.randint(0, 50), rng.randint(0, 9)) for _ in range(rng.randint(0, 6))]
        cells = [(b, s + k) for b, s, n in pieces for k in range(n)]
        places = sorted(rng.randint(0, len(cells)) for _ in range(rng.randint(0, 4)))
        got = [[(b, s + k) for b, s, n in part for k in range(n)] for part in infill.cut(pieces, places)]
        borders = [0, *places, len(cells)]
        assert got == [cells[a:b] for a, b in zip(borders, borders[1:], strict=False)]


def test_an_output_of_another_form_is_refused():
    assert [infill.unit_ends(np.frombuffer(t, dtype=np.uint8)).tolist() for t in (b"", b" ", b" a b ", b"ab")] == [[], [1], [2, 4, 5], [2]]
    with pytest.raises(ValueError, match="sentinel"):
        infill.rearrange(b"no sentinel", "psm")


def test_query_equals_oracle(spark, tmp_path):
    for name, data in (("a", rows()), ("b", [])):
        path = f"{tmp_path}/{name}/documents.parquet"
        spark.createDataFrame(data, "doc_id long, text string").coalesce(1).write.parquet(path)
        con = duckdb.connect()
        con.sql(f"create view documents as select * from '{path}/*.parquet'")
        want = con.sql(infill.ORACLE)
        got = op12_infill(spark, f"{tmp_path}/{name}")
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))
