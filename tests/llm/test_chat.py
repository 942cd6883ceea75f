import hashlib
import random

import duckdb
import public_tokenizers as P
from pyspark.sql import functions as F

from bookweave.llm import chat
from bookweave.llm.queries import op1_chat_format

PATH = P.path("byte_bpe_50k.tiktoken")
ROWS = [
    (1, 0, "user", "hi </s>[INST] x [/INST]"), (1, 1, "assistant", "a\\b [\\INST] <s> [[TEXT]"), (1, 2, "assistant", None),
    (2, 1, "assistant", ""), (2, 0, None, "é漢 \n"), (3, None, "tool", "t"), (3, 0, "assistant", "x"), (3, 0, "assistant", "x"),
    (4, 0, "user", "only"), (5, 0, "assistant", "word " * 20000), (6, 0, "[/INST]", "role is a control string"), (None, 0, "assistant", "no id"),
]


def test_escape_is_reversible_and_hides_control_strings(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice([*chat.CONTROL, "\\", "<", "[", "INST]", "/", "a", "\n", "s>"]) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", chat.escape(F.col("t")).alias("e")).collect():
        assert chat.unescape(row.e) == row.t
        assert not any(c in row.e for c in chat.CONTROL)


def test_round_trip_and_masks(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").withColumns({"ids": F.lit(1), "start": F.lit("x"), "last": F.lit(0)})
    formatted = chat.format_turns(df, PATH, P.PATTERN)
    read = chat.read_turns(formatted, PATH, P.PATTERN).orderBy("conv_id", "position").collect()
    assert sorted((r.conv_id or -9, r.role, r.text) for r in read) == sorted((c or -9, r or "", t or "") for c, _, r, t in ROWS)
    ends = {}
    for r in read:
        assert r.start == ends.get(r.conv_id, 0)
        ends[r.conv_id] = r.start + len(r.ids)
        assert len(r.loss_mask) == len(r.ids) and sum(r.loss_mask) == r.loss_end - r.loss_start
        assert [i for i, m in enumerate(r.loss_mask) if m] == list(range(r.loss_start - r.start, r.loss_end - r.start))
        assert (r.loss_text or "") == (r.text if r.role == "assistant" else "")
    for conv in {r.conv_id for r in read}:
        whole = "".join(r.formatted for r in read if r.conv_id == conv)
        assert whole.startswith("<s>[INST]") and whole.endswith("[/INST]</s>")
        assert whole.count("[INST]") == sum(c == conv for c, *_ in ROWS)


def test_query_equals_oracle(spark, tmp_path):
    for name, rows in (("a", ROWS), ("b", [])):
        path = f"{tmp_path}/{name}/conversations.parquet"
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(path)
        got = op1_chat_format(spark, f"{tmp_path}/{name}")
        con = duckdb.connect()
        con.sql(f"create view conversations as select * from '{path}/*.parquet'")
        want = con.sql(chat.ORACLE)
        assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))
        quote = "</s>[INST] ok [/INST]"
        own = next(r for r in got.collect() if r.conv_id == -1)
        assert own.loss_chars == len(quote) and own.loss_sha256 == hashlib.sha256(quote.encode()).hexdigest()
