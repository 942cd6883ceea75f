"""Files staged as they are: each by its own header, with where every row came from and why a file was refused.

Sources are told apart by path and by SHA-256 of their content. A file that cannot be read
is blocked by itself; the others go on. Staged tables only grow, one folder per batch.
"""

from __future__ import annotations

import codecs
import csv
import hashlib
import io
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookweave.plans.scratch import stage_table
from bookweave.sources.readers import column_map

# Headers of the account column without case, spaces and signs, and limits of one file.
ACCOUNT_HEADERS = frozenset({"account", "accountid", "accountidentifier", "accountnumber", "accountname", "portfolio", "portfolioid", "portfolioidentifier", "portfolioname"})
MOST_COLUMNS, MOST_CELL = 64, 2048

SOURCE = "source_id string, path string, source string, sha256 string, bytes long, rows long, account_column string, status string"
ROW = "source_id string, source_row long, account string, part int, ordinal long, record_id string, cells map<string,string>, roles map<string,string>"
ISSUE = "source_id string, source_row long, severity string, issue string"
_BOTH = "kind string, source_id string, path string, source string, sha256 string, bytes long, rows long, account_column string, status string, source_row long, account string, part int, ordinal long, record_id string, cells map<string,string>, roles map<string,string>, severity string, issue string"


class Refused(ValueError):
    """Why a file is not staged, and the row where that is known."""

    def __init__(self, issue: str, row: int | None = None) -> None:
        super().__init__(issue)
        self.issue, self.row = issue, row


def account_column(header: list[str]) -> str | None:
    """The one header that names accounts."""
    found = [h for h in header if re.sub(r"[^a-z0-9]", "", h.lower()) in ACCOUNT_HEADERS]
    if len(found) > 1:
        raise Refused("several account columns")
    return found[0] if found else None


def read_table(data: bytes, name: str) -> tuple[list[str], Iterator[tuple[int, list[str]]]]:
    """Header and (row number in the file, cells) of a CSV file; a Refused comes up at the first row that does not fit."""
    if not name.lower().endswith(".csv"):
        raise Refused("not a CSV file")
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        for at in range(0, len(data), 1 << 20):  # no text as large as the file
            decoder.decode(data[at : at + (1 << 20)])
        decoder.decode(b"", True)
    except UnicodeDecodeError:
        raise Refused("not UTF-8") from None
    if b"\0" in data:
        raise Refused("not a text file")
    lines = csv.reader(io.TextIOWrapper(io.BytesIO(data), encoding="utf-8-sig", newline=""), strict=True)
    try:
        header = next(lines, None)
    except csv.Error:
        raise Refused("malformed quotes", 1) from None
    if not header:
        raise Refused("no header")
    if len(header) > MOST_COLUMNS:
        raise Refused("too many columns")
    if len(set(header)) < len(header):
        raise Refused("repeated header")

    def rows() -> Iterator[tuple[int, list[str]]]:
        number = 1
        while True:
            number += 1
            try:
                cells = next(lines, None)
            except csv.Error:
                raise Refused("malformed quotes", number) from None
            if cells is None:
                return
            if not cells:
                number -= 1
                continue
            if len(cells) != len(header):
                raise Refused("row width", number)
            if any(len(c) > MOST_CELL for c in cells):
                raise Refused("cell too long", number)
            yield number, cells

    return header, rows()


def _staged(path: str, data: bytes | None, size: int, session: str) -> Iterator[dict]:
    """The source, then its rows, or the issue that blocks it."""
    name = path.rsplit("/", 1)[-1]
    own = f"{session}:{hashlib.sha256(path.encode()).hexdigest()[:16]}"
    told = {"kind": "source", "source_id": own, "path": path, "source": name, "bytes": size, "rows": 0, "status": "staged"}
    try:
        if data is None:
            raise Refused("file too large")
        told["sha256"] = hashlib.sha256(data).hexdigest()
        header, rows = read_table(data, name)
        column = account_column(header)
        roles = {role: header.index(h) for role, h in column_map([h for h in header if h != column]).items()}
        for _ in rows:  # a file is whole or not at all
            told["rows"] += 1
        if not told["rows"]:
            raise Refused("no rows")
        told["account_column"] = column
        yield told
        parts: dict[str, int] = {}
        ordinals: Counter[str] = Counter()
        for number, cells in read_table(data, name)[1]:
            account = cells[header.index(column)].strip() if column else ""
            part = parts.setdefault(account, len(parts) + 1)
            ordinals[account] += 1
            yield {
                "kind": "row", "source_id": own, "source_row": number, "account": account or None, "part": part, "ordinal": ordinals[account], "record_id": f"{own}:{part}:{ordinals[account]}",
                "cells": list(zip(header, cells, strict=True)), "roles": [(r, cells[k]) for r, k in roles.items()],
            }
    except Refused as e:
        yield told | {"rows": 0, "status": "blocked"}
        yield {"kind": "issue", "source_id": own, "source_row": e.row, "severity": "error", "issue": e.issue}


def parse_files(files: DataFrame, session: str, most_bytes: int = 64 << 20) -> DataFrame:
    """Rows of kind source, row and issue from a binaryFile table.

    A file is read by one task, rows leave it in batches; its content is checked whole
    before its first row leaves. Files over most_bytes are blocked and not read here.
    """
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    fields = [f.split(" ") for f in _BOTH.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in held], kinds[t]) for n, t in fields], names=[n for n, _ in fields])
            held.clear()
            return made

        for batch in batches:
            for k in range(batch.num_rows):  # the bytes of one file at a time
                path, size, data = (c[k].as_py() for c in batch.columns)
                for row in _staged(path, data, size, session):
                    held.append(row)
                    if len(held) >= 5000:
                        yield out()
        yield out()

    content = F.when(F.col("length") <= most_bytes, F.col("content"))
    return files.select("path", F.col("length").alias("bytes"), content.alias("content")).mapInArrow(run, _BOTH)


def _columns(schema: str) -> list[str]:
    return [f.split(" ")[0] for f in schema.split(", ")]


def split_kinds(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, rows, issues) of parse_files, which is read once for each: stage it first."""
    return tuple(parsed.where(F.col("kind") == kind).select(*_columns(schema)) for kind, schema in (("source", SOURCE), ("row", ROW), ("issue", ISSUE)))


def stage_files(spark: SparkSession, path: str, session: str, most_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, rows, issues) of the files below path, all cells as text.

    A source is known by session and path; equal contents are sources of their own with
    one SHA-256, for a later review to judge. Each file has its own header: `cells` has the
    values by header, `roles` by the role that column_map finds. The account is the value
    of the one account column, null where blank; parts are numbered by an account's first
    row, ordinals by place within the part. A file that is no UTF-8, no rectangle, has a
    repeated header, several account columns or no rows has status `blocked`, an issue and
    no rows. Empty folders give three empty tables.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")
    # The scan leaves out files of no bytes; Spark's listing, which the driver holds anyway, has them.
    # Both name a file by scheme, host and path, with more or fewer slashes where there is no host.
    listed = [(re.sub(r"^([^:/]+):///+", r"\1:/", unquote(f)),) for f in files.inputFiles()]
    bare = F.regexp_replace("path", "^[^:/]+:/*", "").alias("bare")
    empty = spark.createDataFrame(listed, "path string").select("path", bare).join(files.select(bare), "bare", "left_anti").select("path")
    every = files.unionByName(empty.select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))
    return split_kinds(stage_table(parse_files(every, session, most_bytes), "staged"))


def summary(sources: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: files, blocked files, different accounts, parts without an account, rows, and the status of the whole draft."""
    files = sources.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") == "blocked").alias("blocked"))
    parts = rows.groupBy("source_id", "part").agg(F.first("account").alias("account"), F.count(F.lit(1)).alias("n"))
    told = parts.agg(F.count_distinct("account").alias("accounts"), F.count_if(F.col("account").isNull()).alias("unresolved"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    status = F.when(F.col("files") == 0, "empty").when((F.col("blocked") > 0) | (F.col("unresolved") > 0), "review_required").otherwise("staged")
    return files.crossJoin(told).withColumn("status", status)  # one row each


class Draft:
    """A folder that sources are appended to and confirmations are written beside.

    sources, rows and issues lie in a folder per batch. A confirmation holds the digest of
    the sources that it was given for, so any file that comes later ends it.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, part: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _table(self, part: str, schema: str) -> DataFrame:
        if not self._exists(part):
            return self.spark.createDataFrame([], f"{schema}, batch string")
        return self.spark.read.schema(f"{schema}, batch string").parquet(f"{self.path}/{part}")

    def sources(self) -> DataFrame:
        return self._table("sources", SOURCE)

    def rows(self) -> DataFrame:
        return self._table("rows", ROW)

    def issues(self) -> DataFrame:
        return self._table("issues", ISSUE)

    def append(self, parsed: DataFrame, batch: str, each_content_once: bool = False) -> None:
        """Add parse_files' rows as one batch; written again under its name, a batch replaces itself.

        each_content_once: of equal contents only the first path is added, and none whose
        SHA-256 an earlier batch has. Blocked files stay, they have no rows. Only the table
        of sources is read for that, a row per file.
        """
        sources, rows, issues = split_kinds(stage_table(parsed, "staged"))
        if each_content_once:
            before = self.sources().where((F.col("batch") != batch) & (F.col("status") == "staged")).select("sha256").distinct()
            good = sources.where("status = 'staged'").join(before, "sha256", "left_anti")
            first = good.groupBy("sha256").agg(F.min_by("source_id", "path").alias("source_id")).select("source_id")
            kept = stage_table(first.unionByName(sources.where("status = 'blocked'").select("source_id")), "kept")
            sources, rows, issues = (t.join(kept, "source_id", "left_semi").select(*t.columns) for t in (sources, rows, issues))
        for part, table in (("rows", rows), ("issues", issues), ("sources", sources)):  # sources last: they say that the batch is there
            table.write.mode("overwrite").parquet(f"{self.path}/{part}/batch={batch}")

    def digest(self) -> str:
        """Of all sources: their ids and contents, whatever their order."""
        marks = self.sources().select(F.sha2(F.concat_ws("|", "source_id", F.coalesce("sha256", F.lit(""))), 256).alias("s"))
        parts = [F.sum(F.conv(F.substring("s", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(8)]
        return marks.agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *parts), 256).alias("d")).first()["d"]

    def confirm(self, by: str) -> None:
        """The sources of now are reviewed."""
        self.spark.createDataFrame([(self.digest(), by)], "digest string, reviewer string").write.mode("append").parquet(f"{self.path}/confirmations")

    def confirmed(self) -> bool:
        """Whether the sources are those that were confirmed."""
        if not self._exists("confirmations"):
            return False
        return bool(self.spark.read.parquet(f"{self.path}/confirmations").where(F.col("digest") == self.digest()).limit(1).count())
