"""Chat formatting at token level.

Every role and text is escaped and encoded as a segment of its own; reserved ids mark the
borders, so no text can make one. Prefix sums of segment lengths give each turn's place in
its conversation and the span of the loss mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookweave.llm import bpe

# The control strings of the template, in the order of their reserved ids,
# which follow the ids of the vocabulary.
CONTROL = ("<s>", "</s>", "[INST]", "[TEXT]", "[/INST]")
START, STOP, TURN, TEXT, END = range(len(CONTROL))
_CONTROL_PATTERN = r"([<\[])(/?s>|/?INST\]|TEXT\])"


def escape(text: Column) -> Column:
    """Doubles each backslash and puts one after the first character of each control string."""
    doubled = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\", r"\\\\")
    return F.regexp_replace(doubled, _CONTROL_PATTERN, r"$1\\$2")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turns(turns: DataFrame, vocabulary: str, pattern: str, learn_role: str = "assistant") -> DataFrame:
    """Token rows of conversations: one row per turn, in place of (conv_id, turn, role, text).

    Returns conv_id, position (turn's place from 0), start (of its first token within the
    conversation), ids, loss_start, loss_end (token places within the conversation),
    loss_mask (0 or 1 per id). A conversation's tokens are its rows' ids in order of
    position: <s>, then [INST] role [TEXT] text [/INST] per turn, then </s>. The mask holds
    on the text of turns whose role is learn_role: a token is in it if its place in the
    conversation, start and its place in ids, is in the span from loss_start to loss_end.

    Order is by turn (null first), then role, then text, so ties and repeated rows have a
    defined place; repeated rows stay turns of their own. Null roles and texts count as
    empty; rows of a null conv_id are one conversation. Other columns are left out. No
    rows give no rows.
    """
    base = max(bpe.load_ranks(vocabulary).values()) + 1
    one = [F.array(F.lit(base + k).cast("int")) for k in range(len(CONTROL))]
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"_role": escape(F.col("role")), "_text": escape(F.col("text"))})
    rows = bpe.encode(rows, vocabulary, pattern, "_role", "role_ids")
    rows = bpe.encode(rows, vocabulary, pattern, "_text", "text_ids").drop("_role", "_text")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"position": F.row_number().over(order) - 1, "last": F.lead(F.lit(1)).over(order).isNull()})
    first = F.col("position") == 0
    head = F.concat(F.when(first, one[START]).otherwise(F.array().cast("array<int>")), one[TURN], "role_ids", one[TEXT])
    tail = F.concat(one[END], F.when(F.col("last"), one[STOP]).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumns({"head": head, "tail": tail})
    length = F.size("head") + F.size("text_ids") + F.size("tail")
    rows = rows.withColumn("start", F.coalesce(F.sum(length.cast("long")).over(before), F.lit(0).cast("long")))
    text_start = F.col("start") + F.size("head")
    learn = F.col("role") == learn_role
    rows = rows.select(
        "conv_id",
        "position",
        "start",
        F.concat("head", "text_ids", "tail").alias("ids"),
        text_start.alias("loss_start"),
        (text_start + F.when(learn, F.size("text_ids")).otherwise(0)).alias("loss_end"),
    )
    inside = lambda i: ((F.col("start") + i >= F.col("loss_start")) & (F.col("start") + i < F.col("loss_end"))).cast("int")
    return rows.withColumn("loss_mask", F.transform("ids", lambda _, i: inside(i)))


def read_turns(formatted: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """What format_turns wrote, from its ids and masks alone.

    Adds role, text, loss_text (null where the mask is empty) and formatted, the turn's
    part of the conversation as one string with its control strings. Columns of these names
    are replaced, all others stay; null roles and texts come back empty, as they were
    written, ties and repeated rows as rows of their own, and no rows give no rows.
    """
    ranks = bpe.load_ranks(vocabulary)
    base = max(ranks.values()) + 1
    token = {i: b for b, i in ranks.items()} | {base + k: c.encode() for k, c in enumerate(CONTROL)}
    shared = formatted.sparkSession.sparkContext.broadcast(token)
    made = ("role", "text", "loss_text", "formatted")
    rest = formatted.drop(*made)
    schema = T.StructType([*rest.schema.fields, *(T.StructField(n, T.StringType()) for n in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.__getitem__

        def said(ids: list[int]) -> str:
            return b"".join(map(get, ids)).decode()

        for batch in batches:
            out: list[list[str | None]] = [[], [], [], []]
            at = batch.schema.get_field_index
            for ids, mask in zip(batch.column(at("ids")).to_pylist(), batch.column(at("loss_mask")).to_pylist(), strict=True):
                a, b, c = (ids.index(base + k) for k in (TURN, TEXT, END))
                learned = [i for i, m in zip(ids, mask, strict=True) if m]
                out[0].append(unescape(said(ids[a + 1 : b])))
                out[1].append(unescape(said(ids[b + 1 : c])))
                out[2].append(unescape(said(learned)) if learned else None)
                out[3].append(said(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.string()) for x in out)], names=[*batch.schema.names, *made])

    return rest.mapInArrow(run, schema)


def digest_conversations(read: DataFrame) -> DataFrame:
    """One row of digests per conversation of read_turns.

    Rows of a conversation come to one task in order of position and pass through running
    hashes, so memory does not grow with a conversation's length. Repeated rows count each;
    a null conv_id is a conversation; a turn without a loss adds nothing to loss_chars. Other
    columns are left out, and no rows give no rows.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    rows = read.select("conv_id", "position", "role", "text", "loss_text", "formatted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[list] = [[], [], [], [], [], []]
        current, state = None, None

        def close() -> None:
            if state:
                for column, x in zip(done, (current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]), strict=True):
                    column.append(x)

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(done, kinds, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            for x in done:
                x.clear()
            return out

        for batch in batches:
            for conv, _, role, text, loss, whole in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != current:
                    close()
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if loss is not None:
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(whole)
            if len(done[0]) >= 4096:
                yield batch_of()
        close()
        yield batch_of()

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "position").mapInArrow(run, schema)


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *,
    length(regexp_replace(replace(role, '\', '\\'), '([<\[])(/?s>|/?INST\]|TEXT\])', '\1\\\2', 'g'))
    + length(regexp_replace(replace(text, '\', '\\'), '([<\[])(/?s>|/?INST\]|TEXT\])', '\1\\\2', 'g')) AS n
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(7 + sum(n + 19) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
