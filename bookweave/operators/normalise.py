"""Raw text rows into holdings, trades and cash flows, with a row for every issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookweave.functions import scalars
from bookweave.plans.scratch import stage_table

# Fixed values.
LEDGER_TYPES = ("BUY", "SELL", "DEPOSIT", "WITHDRAWAL", "DIVIDEND")
PRIVATE = ("account", "account_id", "transaction_id", "source", "record_id", "file_name", "raw", "name")
UNITS = {"GBX": 0.01, "GBP": 1.0, "USD": 1.0, "EUR": 1.0, "JPY": 1.0}


def _text(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def detect_type(df: DataFrame) -> DataFrame:
    """Per source `ledger`, `holdings` or `unknown` with a confidence. All rows are looked at, not the first few hundred."""
    known = F.upper(F.trim(_text(df, "type"))).isin(*LEDGER_TYPES)
    g = df.groupBy("source").agg(
        F.coalesce(F.bool_or(known), F.lit(False)).alias("typed"), F.count(_text(df, "date")).alias("dates"),
        F.count(_text(df, "ticker")).alias("tickers"), F.count(_text(df, "quantity")).alias("quantities"),
    )
    kind = F.when((F.col("dates") > 0) & F.col("typed"), "ledger").when((F.col("tickers") > 0) & (F.col("quantities") > 0), "holdings").otherwise("unknown")
    sure = F.when(kind == "ledger", 0.99).when(kind == "holdings", F.when(F.col("dates") > 0, 0.90).otherwise(0.98))
    return g.select("source", kind.alias("kind"), sure.alias("confidence"))


def holdings(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(holdings, issues). SHORT makes a quantity negative, LONG positive; duplicate lots stay.

    The cleaned cells are staged, so text is read once for both.
    """
    t = df.select(
        "source", "row_no", scalars.ticker(_text(df, "ticker")).alias("ticker"), scalars.clean_number(_text(df, "quantity")).alias("_q"),
        F.upper(F.coalesce(_text(df, "side"), F.lit(""))).alias("_side"),
        scalars.clean_number(_text(df, "entry")).alias("entry"), scalars.clean_number(_text(df, "price")).alias("price"),
        scalars.currency(_text(df, "currency")).alias("currency"), scalars.iso_date(_text(df, "date")).alias("purchase_date"),
        scalars.missing(_text(df, "currency")).alias("_assumed"),
    )
    t = stage_table(t, "holdings")
    q, side = F.col("_q"), F.col("_side")
    t = t.withColumn("quantity", F.when(side.contains("SHORT"), -F.abs(q)).when(side.contains("LONG"), F.abs(q)).otherwise(q)).drop("_q", "_side")
    none = F.col("quantity").isNull() | (F.abs("quantity") <= 1e-15)
    found = F.array(
        F.when(F.col("ticker") == "", F.struct(F.lit("missing ticker").alias("code"), F.lit("error").alias("severity"))),
        F.when(none, F.struct(F.lit("no quantity").alias("code"), F.lit("error").alias("severity"))),
        F.when(F.col("_assumed"), F.struct(F.lit("currency assumed").alias("code"), F.lit("warning").alias("severity"))),
    )
    t = t.withColumn("_i", F.filter(found, lambda x: x.isNotNull()))
    issues = t.select("source", "row_no", F.explode("_i").alias("i")).select("source", "row_no", "i.*")
    return t.where((F.col("ticker") != "") & ~none).drop("_i", "_assumed"), issues


def ledger(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trades, cash flows, issues). A price that is absent is gross over quantity; row_no keeps the order of a day.

    The cleaned cells are staged, so text is read once for all three.
    """
    number = {c: scalars.clean_number(_text(df, c)).alias(f"_{c}") for c in ("quantity", "price", "amount", "fees")}
    t = df.select(
        "source", "row_no", F.upper(F.trim(_text(df, "type"))).alias("kind"), scalars.iso_date(_text(df, "date")).alias("d"), scalars.ticker(_text(df, "ticker")).alias("ticker"),
        *number.values(), scalars.currency(_text(df, "currency")).alias("currency"), _text(df, "transaction_id").alias("transaction_id"),
    )
    t = stage_table(t, "ledger")
    q, p, amount = F.col("_quantity"), F.col("_price"), F.col("_amount")
    t = t.select(
        "source", "row_no", "kind", "d", "ticker", q.alias("quantity"), F.coalesce(p, F.try_divide(F.abs(amount), F.abs(q))).alias("price"),
        F.coalesce(amount, F.abs(q) * p).alias("amount"), F.coalesce("_fees", F.lit(0.0)).alias("fees"), "currency", "transaction_id",
    )
    trade, cash = F.col("kind").isin("BUY", "SELL"), F.col("kind").isin("DEPOSIT", "WITHDRAWAL", "DIVIDEND")
    issue = (
        F.when(F.col("kind").isNull() | ~(trade | cash), "unsupported type").when(F.col("d").isNull(), "bad date")
        .when(trade & (F.col("ticker") == ""), "missing ticker").when(trade & (F.col("quantity").isNull() | (F.col("quantity") == 0)), "no quantity")
        .when(trade & (F.col("price").isNull() | (F.col("price") <= 0)), "no price").when(cash & F.col("amount").isNull(), "no amount")
    )
    t = t.withColumn("issue", issue)
    good = t.where("issue is null").drop("issue")
    signed = F.when(F.col("kind") == "SELL", -F.abs("quantity")).otherwise(F.abs("quantity"))
    return good.where(trade).withColumn("quantity", signed).drop("amount"), good.where(cash).select("source", "row_no", "kind", "d", F.abs("amount").alias("amount"), "currency", "transaction_id"), t.where("issue is not null").select("source", "row_no", "issue")


def capability(h: DataFrame) -> DataFrame:
    """Per source: lots, those with a day and a cost, and the last price given per ticker counted."""
    dated = F.count_if(F.col("purchase_date").isNotNull() & (F.col("entry") > 0) & ~F.col("ticker").startswith("CASH"))
    return h.groupBy("source").agg(F.count(F.lit(1)).alias("lots"), dated.alias("dated"), F.count_distinct("ticker").alias("tickers"), F.count("price").alias("priced"))


def assign_accounts(parts: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parts with corrected accounts and the original one, corrections of unknown parts)."""
    c = corrections.select("part", F.col("account").alias("_new"))
    out = parts.join(c, "part", "left").withColumns({"original": F.col("account"), "account": F.coalesce("_new", "account")}).drop("_new")
    return out, corrections.join(parts.select("part"), "part", "left_anti")


def _open_fields(kind: T.StructType) -> list[T.StructField]:
    """Fields that are not private and hold any that is not."""
    return [f for f in kind.fields if f.name not in PRIVATE and _holds_open(f.dataType)]


def _holds_open(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_open(kind.elementType)
    if isinstance(kind, T.MapType):
        return _holds_open(kind.valueType)
    return not isinstance(kind, T.StructType) or bool(_open_fields(kind))


def _open_part(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_open_part(value.getField(f.name), f.dataType).alias(f.name) for f in _open_fields(kind))))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
        return F.transform(value, lambda x: _open_part(x, kind.elementType))
    if isinstance(kind, T.MapType):
        rest = F.map_filter(value, lambda k, _: ~k.isin(*PRIVATE)) if isinstance(kind.keyType, T.StringType) else value
        return F.transform_values(rest, lambda _, v: _open_part(v, kind.valueType))
    return value


def redact(df: DataFrame) -> DataFrame:
    """df without private columns, fields and map keys, at every depth; what holds nothing else goes too."""
    return df.select(*(_open_part(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in _open_fields(df.schema)))


def field_names(kind: T.DataType, at: str = "") -> list[str]:
    """Paths of all fields that hold no others."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_names(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_names(kind.elementType, at)
    return field_names(kind.valueType, at) if isinstance(kind, T.MapType) else [at]


def reconcile_statement(rows: DataFrame, fx: DataFrame) -> DataFrame:
    """Rows of a statement with the issues found: value, profit, one quote per ticker, weights."""
    by = Window.partitionBy("book", "ticker")
    r = rows.join(fx.select("ccy", "rate"), "ccy", "left")
    value = F.col("qty") * F.col("px") * F.col("rate")
    total = F.sum("value").over(Window.partitionBy("book"))
    checks = {
        "no rate": F.col("rate").isNull(),
        "value differs": F.abs(value - F.col("value")) > F.greatest(F.lit(0.02), 1e-8 * F.abs("value")),
        "profit differs": F.abs(F.col("cost") + F.col("profit") - F.col("value")) > F.greatest(F.lit(0.02), 1e-8 * F.abs("value")),
        "several quotes": F.min("px").over(by) < F.max("px").over(by),
        "weight differs": F.abs(F.try_divide("value", total) - F.col("weight")) > 1e-5,
    }
    found = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items())), lambda x: x.isNotNull())
    return r.withColumn("issues", found)


def match_listings(holdings: DataFrame, listings: DataFrame) -> DataFrame:
    """Holdings with the listing of their currency whose issuer shares two words (one, if it has one only), and the unit factor."""
    h = holdings.withColumn("_hw", scalars.issuer_words(F.col("name")))
    x = listings.select("symbol", F.col("ccy").alias("_lc"), scalars.issuer_words(F.col("issuer")).alias("_lw"), F.col("root").alias("_root"))
    both = F.size(F.array_intersect("_hw", "_lw"))
    joined = h.join(x, h.ticker == x._root)
    units = F.create_map(*(F.lit(v) for kv in UNITS.items() for v in kv))
    factor = F.try_divide(F.element_at(units, F.col("_lc")), F.element_at(units, F.col("ccy")))
    pence = F.col("ccy").isin("GBP", "GBX") & F.col("_lc").isin("GBP", "GBX")
    ok = (both >= F.least(F.lit(2), F.size("_hw"))) & ((F.col("ccy") == F.col("_lc")) | pence)
    return joined.select("ticker", "symbol", "ccy", F.col("_lc").alias("listing_ccy"), both.alias("shared"), factor.alias("factor"), ok.alias("accepted"))


def identifier_catalog(df: DataFrame, kinds: tuple[str, ...] = ("isin", "cusip", "sedol", "id")) -> DataFrame:
    """(ticker, kind, values) of the identifiers in source rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.upper(F.trim(_text(df, k))).alias("value")) for k in kinds)))
    long = df.select(scalars.ticker(F.col("ticker")).alias("ticker"), pairs.alias("x")).select("ticker", "x.*")
    return long.where("value is not null and value <> ''").groupBy("ticker", "kind").agg(F.sort_array(F.collect_set("value")).alias("values"))


def validate_constituents(draft: DataFrame, as_of: str, max_age: int) -> DataFrame:
    """(parent, snapshot, code) of what stands against a snapshot; weight is exact, date the snapshot's."""
    g = draft.groupBy("parent", "snapshot").agg(
        F.count_if(F.col("weight").isNull()).alias("bad"), F.count(F.lit(1)).alias("n"), F.count_distinct("constituent").alias("k"),
        F.sum("weight").alias("total"), F.max("date").alias("date"), F.count_distinct("date").alias("dates"), F.count_if(F.col("constituent") == F.col("parent")).alias("own"),
    )
    age = F.datediff(F.to_date(F.lit(as_of)), "date")
    codes = {"bad weight": F.col("bad") > 0, "duplicate constituent": F.col("n") > F.col("k"), "overweight": F.col("total") > 1, "several dates": F.col("dates") > 1, "no date": F.col("date").isNull(), "future date": age < 0, "stale": age > max_age, "holds itself": F.col("own") > 0}
    found = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in codes.items())), lambda x: x.isNotNull())
    return g.select("parent", "snapshot", F.explode(found).alias("code"))
