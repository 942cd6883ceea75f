"""Files of many shapes, staged by their own headers."""

import hashlib

import pytest

from bookweave.sources import staging
from bookweave.streaming import incremental


def put(folder, **files):
    for name, data in files.items():
        path = folder / name.replace("__", "/").replace("_", ".")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_each_file_has_its_own_header(spark, tmp_path):
    put(tmp_path, a_csv="Ticker,Quantity,Account\n0007,1,x\nABC,2,\n", b_csv="Quantity,Ticker\n7,BBB\n", c_csv="\ufeffPortfolio Name,Shares,Symbol\r\n 0007 ,5,\"Q,1\"\r\n\r\nNA,6,R\r\n")
    sources, rows, issues = staging.stage_files(spark, str(tmp_path), "s")
    name = {r.source_id: r.source for r in sources.collect()}
    got = sorted((name[r.source_id], r.source_row, r.roles["ticker"], r.roles["quantity"], r.account, r.part, r.ordinal) for r in rows.collect())
    assert got == [("a.csv", 2, "0007", "1", "x", 1, 1), ("a.csv", 3, "ABC", "2", None, 2, 1), ("b.csv", 2, "BBB", "7", None, 1, 1), ("c.csv", 2, "Q,1", "5", "0007", 1, 1), ("c.csv", 3, "R", "6", "NA", 2, 1)]
    assert issues.count() == 0 and {r.account_column for r in sources.collect()} == {"Account", None, "Portfolio Name"}
    assert len({r.record_id for r in rows.collect()}) == 5
    told = staging.summary(sources, rows).first()
    assert (told.files, told.blocked, told.accounts, told.unresolved, told.rows, told.status) == (3, 0, 3, 2, 5, "review_required")
    whole = {r.source: r for r in sources.collect()}
    assert whole["b.csv"].sha256 == hashlib.sha256((tmp_path / "b.csv").read_bytes()).hexdigest() and whole["b.csv"].bytes == 22 and whole["b.csv"].rows == 1


def test_bad_files_do_not_remove_others(spark, tmp_path):
    put(
        tmp_path, good_csv="Account ID,Ticker,Quantity\nISA,A,1\n", empty_csv="", headers_csv="Ticker,Quantity\n", unknown_txt="x", wide_csv="Ticker,Quantity\nA,1\nB,2,3\n", latin_csv="Ticker\nÉ\n".encode("latin-1"),
        nul_csv="Ticker\nA\0\n", twice_csv="Ticker,Ticker\nA,B\n", two_csv="Account,Portfolio\nA,B\n", quote_csv='Ticker\n"A"x\n', long_csv="Ticker\n" + "x" * 3000 + "\n", big_csv="Ticker\n" + "row\n" * 5000,
    )
    sources, rows, issues = staging.stage_files(spark, str(tmp_path), "s", most_bytes=10_000)
    name = {r.source_id: r.source for r in sources.collect()}
    assert {name[r.source_id]: (r.issue, r.source_row) for r in issues.collect()} == {
        "empty.csv": ("no header", None), "headers.csv": ("no rows", None), "unknown.txt": ("not a CSV file", None), "wide.csv": ("row width", 3), "latin.csv": ("not UTF-8", None), "nul.csv": ("not a text file", None),
        "twice.csv": ("repeated header", None), "two.csv": ("several account columns", None), "quote.csv": ("malformed quotes", 2), "long.csv": ("cell too long", 2), "big.csv": ("file too large", None),
    }
    assert {name[r.source_id] for r in rows.collect()} == {"good.csv"}
    told = staging.summary(sources, rows).first()
    assert (told.files, told.blocked, told.rows, told.status) == (12, 11, 1, "review_required")
    (tmp_path / "none").mkdir()
    sources, rows, _ = staging.stage_files(spark, str(tmp_path / "none"), "s")
    assert staging.summary(sources, rows).first().status == "empty"


def test_equal_contents_are_sources_of_their_own(spark, tmp_path):
    put(tmp_path, one__a_csv="Ticker\nA\n", two__a_csv="Ticker\nA\n")
    (tmp_path / "a b%41.csv").write_text("")
    sources, rows, _ = staging.stage_files(spark, str(tmp_path), "s")
    assert sources.count() == 3 and len({r.source_id for r in sources.collect()}) == 3 and len({r.sha256 for r in sources.where("status = 'staged'").collect()}) == 1 and rows.count() == 2


@pytest.fixture
def drop(spark, tmp_path):
    def stage():
        return incremental.stage_new_files(spark, str(tmp_path / "drop"), str(tmp_path / "draft"), str(tmp_path / "state"))

    return tmp_path / "drop", stage


def test_new_files_are_staged_once_by_path_and_content(drop):
    folder, stage = drop
    put(folder, one__a_csv="t,q\nX,1\nY,2\n", two__a_csv="t,q\nZ,3\n", copy_csv="t,q\nX,1\nY,2\n", bad_csv="t,q\nX\n")
    draft = stage()
    values = lambda: sorted(r.cells["t"] for r in draft.rows().collect())
    assert values() == ["X", "Y", "Z"] and draft.sources().count() == 3 and draft.issues().count() == 1
    draft.confirm("me")
    assert draft.confirmed()
    stage()
    assert draft.confirmed() and values() == ["X", "Y", "Z"]
    put(folder, three__a_csv="t,q\nX,1\nY,2\n", four__a_csv="t,q\nZ,3\n")
    stage()
    assert draft.confirmed() and values() == ["X", "Y", "Z"]
    put(folder, five__a_csv="q,t\n9,W\n")
    stage()
    assert values() == ["W", "X", "Y", "Z"] and not draft.confirmed()
    draft.confirm("me")
    assert draft.confirmed()


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    put(tmp_path / "in", a_csv="t\nX\n")
    draft = staging.Draft(spark, str(tmp_path / "draft"))
    assert draft.rows().count() == 0 and not draft.confirmed()
    files = spark.read.format("binaryFile").load(str(tmp_path / "in"))
    for _ in range(2):
        draft.append(staging.parse_files(files, "s"), "00000001", each_content_once=True)
    assert draft.rows().count() == 1 and draft.sources().count() == 1


def test_a_file_system_with_a_host_has_each_file_once(spark, tmp_path):
    from bookweave.sources import staging

    (tmp_path / "a.csv").write_text("Order ID,Account\n1,x\n")
    (tmp_path / "b.csv").write_text("")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.here.link./data", f"file:{tmp_path}")
    sources, rows, issues = staging.stage_files(spark, "viewfs://here/data/*.csv", "s")
    assert sorted((r.source, r.status) for r in sources.collect()) == [("a.csv", "staged"), ("b.csv", "blocked")]
    assert rows.count() == 1 and [r.issue for r in issues.collect()] == ["no header"]


def test_a_file_is_parsed_without_a_text_of_its_size():
    import tracemalloc

    from bookweave.sources import staging

    data = b"Order ID,Account\n" + b"1,x\n" * 4_000_000
    tracemalloc.start()
    _, rows = staging.read_table(data, "a.csv")
    next(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < len(data) + (8 << 20)


def test_a_first_task_without_rows_drops_no_file(spark, monkeypatch):
    from bookweave.plans import runs
    from bookweave.sources import tables

    sparse = spark.range(0, 8, 1, 4).where("id > 2").selectExpr("id as seq", "'A' as ticker", "1.0D as q", "date'2024-01-02' as d", "id % 2 as book")
    monkeypatch.setattr(tables, "trades", lambda *a: sparse)
    got = sorted((r.account, r.n, r.ids, r.quantity, r.issues) for r in runs.src1_prj1_prj6_staged_files(spark, "").collect())
    assert got == [("a0", 2, 2, 2.0, 0), ("a1", 3, 3, 3.0, 0)]
    monkeypatch.setattr(tables, "trades", lambda *a: sparse.where("id > 9"))
    assert runs.src1_prj1_prj6_staged_files(spark, "").count() == 0


def test_a_file_dropped_twice_is_equal_in_each_byte(spark, monkeypatch, tmp_path):
    import random

    from bookweave.plans import runs
    from bookweave.sources import tables

    def in_any_order(batches):
        for rows in batches:
            at = list(range(len(rows)))
            random.shuffle(at)
            yield rows.iloc[at]

    tied = spark.range(0, 50, 1, 1).selectExpr("id as book", "concat('T', id % 3) as ticker", "date'2024-01-02' as d", "64L * (id % 2) as seq", "cast(id as double) as q")
    monkeypatch.setattr(tables, "trades", lambda *a: tied.mapInPandas(in_any_order, tied.schema))
    runs._drop_trades(spark, "", str(tmp_path / "drop"))
    one, again = ([f.read_bytes() for f in (tmp_path / "drop" / name / "file=0").glob("*.csv")] for name in ("brokerage", "again"))
    assert one == again and len(one) == 1 and len(one[0].splitlines()) == 51
