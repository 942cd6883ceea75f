"""Risk of many tickers together, on blocks of day-aligned returns.

Correlation and covariance are products of blocks: tickers by tickers, summed over spans
of days, so no join by day makes all pairs of rows. Combinations of tickers are numbers;
a task finds the members of its own numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tickers of a block on average, and days of a span.
WIDE, LONG = 128, 512


def _blocks(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, span, block, cells): returns of about WIDE tickers on up to LONG days."""
    most = rows.groupBy(*by, "ticker").agg(F.lit(1).alias("one")).groupBy(*by).agg(F.count("one").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 1  # one row
    block = F.pmod(F.xxhash64("ticker"), F.lit(math.ceil(most / WIDE))).cast("int")
    cells = rows.where(F.col("r").isNotNull()).select(*by, F.floor(F.unix_date("d") / LONG).alias("span"), block.alias("block"), F.struct("ticker", "d", "r").alias("cell"))
    return cells.groupBy(*by, "span", "block").agg(F.collect_list("cell").alias("cells"))


def _matrix(cells: list, days: dict) -> tuple[list[str], np.ndarray]:
    names = sorted({c["ticker"] for c in cells})
    at = {n: k for k, n in enumerate(names)}
    out = np.full((len(days), len(names)), np.nan)
    for c in cells:
        out[days[c["d"]], at[c["ticker"]]] = c["r"]
    return names, out


def pair_sums(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, i, j, n, sx, sy, sxx, syy, sxy) for all pairs of tickers with a common day, each sum over those days.

    rows: (by, ticker, d, r), one row per ticker and day; null returns take no part. Sums
    of a pair are those of blocks by spans of days. Returns are taken less the first of
    their ticker, which moves no covariance and keeps the sums short of cancellation.
    """
    by = list(by)
    first = rows.where(F.col("r").isNotNull()).groupBy(*by, "ticker").agg(F.min_by("r", "d").alias("base"))
    shifted = rows.join(first, [*by, "ticker"]).select(*by, "ticker", "d", (F.col("r") - F.col("base")).alias("r"))
    blocks = _blocks(shifted, by)
    a = blocks.select(*by, "span", F.col("block").alias("block_i"), F.col("cells").alias("cells_i"))
    b = blocks.select(*by, "span", F.col("block").alias("block_j"), F.col("cells").alias("cells_j"))
    pairs = a.join(b, [*by, "span"]).where("block_i <= block_j")
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    schema = f"{kinds + ', ' if kinds else ''}i string, j string, n long, sx double, sy double, sxx double, syy double, sxy double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                days = {d: k for k, d in enumerate(sorted({c["d"] for c in (*row.cells_i, *row.cells_j)}))}
                left, x = _matrix(row.cells_i, days)
                right, y = _matrix(row.cells_j, days)
                p, q = ~np.isnan(x), ~np.isnan(y)
                x, y, p, q = np.nan_to_num(x), np.nan_to_num(y), p.astype(float), q.astype(float)
                sums = [p.T @ q, x.T @ q, p.T @ y, (x * x).T @ q, p.T @ (y * y), x.T @ y]
                i, j = np.meshgrid(np.arange(len(left)), np.arange(len(right)), indexing="ij")
                keep = sums[0] > 0
                out = pd.DataFrame({"i": np.array(left, object)[i[keep]], "j": np.array(right, object)[j[keep]], **{n: s[keep] for n, s in zip(("n", "sx", "sy", "sxx", "syy", "sxy"), sums, strict=True)}})
                out["n"] = out["n"].round().astype("int64")
                for k, c in enumerate(by):
                    out.insert(k, c, row[c])
                yield out
                if row.block_i != row.block_j:
                    yield out.rename(columns={"i": "j", "j": "i", "sx": "sy", "sy": "sx", "sxx": "syy", "syy": "sxx"})[out.columns]

    sums = ("n", "sx", "sy", "sxx", "syy", "sxy")
    return pairs.mapInPandas(run, schema).groupBy(*by, "i", "j").agg(*(F.sum(c).alias(c) for c in sums))


def covariance() -> Column:
    """Sample covariance from the columns of pair_sums."""
    n = F.col("n")
    return F.when(n > 1, (F.col("sxy") - F.col("sx") * F.col("sy") / n) / (n - 1))


def correlation(rows: DataFrame) -> DataFrame:
    """(i, j, n, corr): Pearson correlation of tickers over the days both have; null where a side does not vary or there is one day."""
    n = F.col("n")
    spread = lambda s, ss: F.col(ss) - F.col(s) * F.col(s) / n
    vx, vy = spread("sx", "sxx"), spread("sy", "syy")
    varies = (vx > 1e-14 * F.col("sxx")) & (vy > 1e-14 * F.col("syy"))
    corr = (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy)
    return pair_sums(rows.select("ticker", "d", "r")).select("i", "j", "n", F.when((n > 1) & varies, corr).alias("corr"))


def binomials(n: int, size: int) -> list[list[int]]:
    """binomials[k][m] = comb(m, k) for k up to size and m up to n."""
    return [[math.comb(m, k) for m in range(n + 1)] for k in range(size + 1)]


def members(numbers: np.ndarray, n: int, size: int) -> np.ndarray:
    """(len(numbers), size) places below n, ascending, of combinations by number, 0 to comb(n, size) - 1, in lexicographic order.

    The number from the end, in the combinatorial number system: its largest digit m has
    comb(m, size) at most, and so on with what is left.
    """
    table = [np.array(t, dtype=np.int64) for t in binomials(n, size)]
    left = math.comb(n, size) - 1 - np.asarray(numbers, dtype=np.int64)
    out = np.empty((len(left), size), dtype=np.int64)
    for place, k in enumerate(range(size, 0, -1)):
        digit = np.searchsorted(table[k], left, side="right") - 1
        left = left - table[k][digit]
        out[:, place] = n - 1 - digit
    return out


def combination_risk(rows: DataFrame, keys: DataFrame, size: int, least: int = 30, level: float = 0.95, limit: int = 100_000) -> tuple[DataFrame, dict]:
    """Metrics of the equal-weight book of every combination of `size` eligible tickers, and what was counted.

    Eligible are tickers of keys with `least` returns. All combinations are looked at on the
    same days, those on which every eligible ticker has a return; with fewer than `least`
    of them all are skipped. The counts are checked first: above `limit` combinations, or
    with too few tickers, there are no rows and a reason. The limit bounds the tickers (447
    for pairs), so the days' returns, tickers by days, are small enough to send to every
    task; combinations are numbers from a range and are never joined. Growth and drawdown are
    null where a return is -1 or less, growth also where it is beyond e ** 700.
    """
    spark = rows.sparkSession
    good = rows.where(F.col("r").isNotNull()).select("ticker", "d", "r").join(keys.select("ticker").distinct(), "ticker")
    seen = good.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    names = [r.ticker for r in seen.where(F.col("n") >= least).select("ticker").orderBy("ticker").limit(limit + 2).collect()]  # more than the limit allows end here
    total = math.comb(len(names), size)
    told = {"size": size, "eligible": len(names), "candidates": total, "evaluated": 0, "skipped": 0, "common": 0, "reason": None}
    schema = "combo string, n long, annual_return double, volatility double, var double, es double, growth double, max_drawdown double, compounds boolean"
    none = spark.createDataFrame([], schema)
    if size < 2:
        raise ValueError("a combination has two tickers at least")
    if size > len(names):
        return none, told | {"reason": "too few eligible tickers"}
    if total > limit:
        return none, told | {"reason": "more combinations than the limit"}
    full = good.where(F.col("ticker").isin(names)).groupBy("d").agg(F.map_from_entries(F.collect_list(F.struct("ticker", "r"))).alias("rs")).where(F.size("rs") == len(names))
    days = full.orderBy("d").select(F.array(*(F.col("rs")[k] for k in names)).alias("rs")).collect()  # tickers by days
    told["common"] = len(days)
    if len(days) < least:
        return none, told | {"skipped": total, "reason": "too few common days"}
    shared = spark.sparkContext.broadcast((names, np.array([r.rs for r in days])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, matrix = shared.value
        for batch in batches:
            for a in range(0, len(batch), 256):
                group = members(batch["id"].to_numpy()[a : a + 256], len(own), size)
                r = matrix[:, group].mean(axis=2)  # days by combinations
                cut = np.quantile(r, 1 - level, axis=0)
                tail = r <= cut
                compounds = (r > -1).all(axis=0)
                # wealth by its logarithm, which years of large returns do not overflow
                wealth = np.cumsum(np.log1p(np.where(compounds, r, 0.0)), axis=0)
                fall = (wealth - np.maximum(np.maximum.accumulate(wealth, axis=0), 0.0)).min(axis=0)
                yield pd.DataFrame({
                    "combo": ["+".join(own[k] for k in g) for g in group], "n": len(r), "annual_return": r.mean(axis=0) * 252, "volatility": r.std(axis=0, ddof=1) * math.sqrt(252),
                    "var": np.maximum(0.0, -cut), "es": np.maximum(0.0, -(r * tail).sum(axis=0) / tail.sum(axis=0)),
                    "growth": np.where(compounds & (wealth[-1] < 700), np.expm1(np.minimum(wealth[-1], 700)), np.nan), "max_drawdown": np.where(compounds, np.expm1(fall), np.nan), "compounds": compounds,
                })

    tasks = max(1, min(total // 256 + 1, spark.sparkContext.defaultParallelism * 4))
    out = spark.range(0, total, 1, tasks).mapInPandas(run, schema)
    finite = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
    return out.select("combo", "n", "annual_return", "volatility", "var", "es", finite("growth"), finite("max_drawdown"), "compounds"), told | {"evaluated": total}
