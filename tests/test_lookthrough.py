"""Look-through by identity, with figures made by hand."""

from decimal import Decimal

from pyspark.sql import functions as F

from bookweave.operators import lookthrough, review

D = Decimal
AS_OF = "2024-06-30"


def run(spark, positions, constituents, snapshots, declared, identifiers):
    p = spark.createDataFrame(positions, "book string, ticker string, value double, fund boolean, equity boolean, supported boolean")
    c = spark.createDataFrame([(a, b, D(w) if w is not None else None, e) for a, b, w, e in constituents], "parent string, security string, weight decimal(19,18), equity boolean")
    s = spark.createDataFrame(snapshots, "parent string, day string, verified boolean").withColumn("day", F.to_date("day"))
    i = spark.createDataFrame(identifiers, "security string, ids array<string>")
    securities, books, issues = lookthrough.look_through(p, c, s, spark.createDataFrame([(x,) for x in declared], "parent string"), i, AS_OF)
    return {(r.book, r.component): r for r in securities.collect()}, {r.book: r for r in books.collect()}, {tuple(r) for r in issues.collect()}


VOO = [("VOO", "v1", "0.065", True), ("VOO", "v2", "0.935", True)]
VGT = [("VGT", "g1", "0.2", True), ("VGT", "g2", "0.8", True)]
IDS = [("NVDA", ["ticker:NVDA", "isin:N"]), ("v1", ["isin:N"]), ("g1", ["ticker:NVDA", None]), ("v2", ["isin:M"]), ("g2", ["isin:A"])]
HELD = [("b", "VOO", 2500.0, True, None, True), ("b", "VGT", 2800.0, True, None, True), ("b", "NVDA", 1000.0, False, True, True)]
FRESH = [("VOO", "2024-06-01", True), ("VGT", "2024-06-01", True)]


def test_two_funds_and_one_stock(spark):
    s, b, issues = run(spark, HELD, VOO + VGT, FRESH, ["VOO", "VGT"], IDS)
    n = s["b", "NVDA"]
    assert (n.direct, n.indirect, n.total, n.funds) == (1000, D("722.5"), D("1722.5"), 2)
    assert (b["b"].eligible, b["b"].known, b["b"].residual, b["b"].complete) == (6300, 6300, 0, True) and not issues


def test_a_part_that_is_not_reported_is_unknown(spark):
    top = [("VOO", "v1", "0.15", True), ("VOO", "v2", "0.38", True)]
    s, b, issues = run(spark, HELD[:1], top, FRESH[:1], ["VOO"], IDS)
    assert (b["b"].known, b["b"].unknown, b["b"].residual, b["b"].complete) == (1325, 1175, 0, False) and s["b", "NVDA"].indirect == 375
    assert issues == {("b", "VOO", "incomplete coverage")}


def test_conflicting_identifiers_stay_unresolved(spark):
    ids = [("A", ["ticker:A", "isin:1"]), ("v1", ["ticker:A", "isin:2"]), ("v2", []), ("W", ["ticker:W"])]
    s, b, issues = run(spark, [("b", "A", 100.0, False, True, True), ("b", "W", -7.0, False, True, True), ("b", "VOO", 1000.0, True, True, True)], VOO, FRESH[:1], ["VOO"], ids)
    assert set(s) == {("b", "W")} and (b["b"].unresolved, b["b"].known, b["b"].eligible, b["b"].residual) == (1100, -7, 1093, 0)
    assert issues == {("b", "A", "identity conflict"), ("b", "v2", "identity conflict")}


def test_what_is_left_out_and_why(spark):
    held = [
        ("b", "SHORT", -5.0, True, True, True), ("b", "NONE", None, True, True, True), ("b", "ODD", 5.0, True, True, False), ("b", "UNSAID", 5.0, True, True, True), ("b", "EMPTY", 6.0, True, True, True), ("b", "BOND", 7.0, True, True, True),
        ("b", "OVER", 8.0, True, True, True), ("b", "OLD", 10.0, True, True, True), ("b", "cash", 3.0, False, False, True), ("b", "lost", None, False, True, True), ("c", "cash", 1.0, False, False, True),
    ]
    cons = [("BOND", "x", "0.5", True), ("BOND", "y", "0.5", None), ("OVER", "x", "0.9", True), ("OVER", "z", "0.2", True), ("OLD", "x", "1", True), ("UNSAID", "x", "1", True), ("SHORT", "x", "1", True)]
    days = [(p, "2024-06-01", True) for p in ("BOND", "OVER", "UNSAID", "SHORT")] + [("OLD", "2024-01-01", True)]
    s, b, issues = run(spark, held, cons, days, ["SHORT", "NONE", "ODD", "EMPTY", "BOND", "OVER", "OLD"], [("x", ["isin:x"])])
    assert issues == {
        ("b", "SHORT", "unsupported fund"), ("b", "NONE", "unsupported fund"), ("b", "ODD", "unsupported fund"), ("b", "UNSAID", "eligibility unverified"), ("b", "EMPTY", "no data"), ("b", "BOND", "composition unavailable"),
        ("b", "OVER", "composition unavailable"), ("b", "OLD", "stale"), ("b", "cash", "outside scope"), ("b", "lost", "outside scope"), ("c", "cash", "outside scope"),
    }
    assert (b["b"].eligible, b["b"].known, b["b"].unknown, b["b"].residual) == (31, 10, 21, 0) and s["b", "x"].total == 10
    assert b["c"].eligible == 0 and not b["c"].complete


def test_exact_to_the_last_digit(spark):
    third = "0.333333333333333333"
    _, b, _ = run(spark, [("b", "VOO", 0.000001, True, True, True)], [("VOO", f"s{i}", third, True) for i in range(3)], FRESH[:1], ["VOO"], [(f"s{i}", [f"isin:{i}"]) for i in range(3)])
    assert b["b"].residual == 0 and b["b"].known == D("0.000000999999999999999999") and b["b"].unknown == D("0.000000000000000000000001")


def test_identifiers_are_told_apart_exactly(spark):
    rows = spark.createDataFrame([(0, ["isin:a", "sedol:1"]), (1, ["isin:b"]), (2, ["sedol:1", "isin:b"]), (3, []), (4, None), (5, ["isin:c"])], "row_id long, ids array<string>")
    assert {r.row_id: r.component for r in review.identity(rows).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5}


def test_weights_above_ten_are_no_error(spark, tmp_path):
    from bookweave.operators import review
    from bookweave.plans import records

    part = [(k, f"Brand#{b}", "T", 50) for b in (21, 22, 25) for k in range(21000)]
    spark.createDataFrame(part, "p_partkey int, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    c = records.constituents(spark, str(tmp_path))
    assert {r.parent: (float(r.total), r.state) for r in review.coverage(c).collect()} == {"Brand#12": (21.0, "overweight"), "Brand#13": (10.5, "overweight")}
    held = spark.createDataFrame([("b", "Brand#12", 100.0), ("b", "Brand#21", 5.0)], "book string, ticker string, value double")
    assert {(r.security, r.direct, r.indirect) for r in review.look_through(held, c).collect()} == {("Brand#12", 100.0, 0.0), ("Brand#21", 5.0, 0.0)}
    p = held.selectExpr("*", "ticker = 'Brand#12' as fund", "true as equity", "true as supported")
    named = spark.createDataFrame([("Brand#21", ["ticker:Brand#21"])], "security string, ids array<string>")
    snapshots = spark.createDataFrame([("Brand#12", "1998-12-15", True)], "parent string, day string, verified boolean").selectExpr("parent", "to_date(day) as day", "verified")
    inside = c.withColumnRenamed("constituent", "security").selectExpr("*", "true as equity")
    _, books, issues = lookthrough.look_through(p, inside, snapshots, snapshots.select("parent"), named, "1999-01-01")
    assert [(float(r.eligible), float(r.unknown), float(r.residual)) for r in books.collect()] == [(105.0, 100.0, 0.0)]
    assert [r.code for r in issues.collect()] == ["composition unavailable"]
