"""Fill-in-middle transformation on piece tables.

A document is a list of descriptors (buffer, start, length) over two buffers that never
change: its UTF-8 bytes and the sentinels. Cutting splits descriptors, an arrangement
permutes them, the inverse permutation restores the text, and hashes stream through the
descriptors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The sentinels of prefix, suffix and middle.
SENTINELS = b"<P><S><M>"
TEXT, MARKS = 0, 1
Piece = tuple[int, int, int]
PREFIX_MARK, SUFFIX_MARK, MIDDLE_MARK = (MARKS, 0, 3), (MARKS, 3, 3), (MARKS, 6, 3)

#: The order of [prefix, middle, suffix, prefix mark, suffix mark, middle mark] in each form.
ARRANGEMENTS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}


def unit_ends(data: np.ndarray) -> np.ndarray:
    """The ends of the units of UTF-8 bytes: each run of other bytes with the white space before it, and white space at the end."""
    white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    ends = np.flatnonzero(~white & np.append(white[1:], True)) + 1
    return np.append(ends, len(data)) if len(data) and white[-1] else ends


def cut(pieces: list[Piece], places: Iterable[int]) -> list[list[Piece]]:
    """The pieces between ascending places of the whole, one list more than places; a piece over a place is split."""
    out, rest, at = [[]], list(reversed(pieces)), 0
    for place in places:
        while rest and at + rest[-1][2] <= place:
            out[-1].append(rest.pop())
            at += out[-1][-1][2]
        if at < place:
            buffer, start, length = rest.pop()
            out[-1].append((buffer, start, place - at))
            rest.append((buffer, start + place - at, length - (place - at)))
            at = place
        out.append([])
    out[-1].extend(reversed(rest))
    return out


def arrange(parts: list[list[Piece]], form: str) -> list[Piece]:
    """The pieces of prefix, middle and suffix with their sentinels, in the order of the form."""
    blocks = [*parts, [PREFIX_MARK], [SUFFIX_MARK], [MIDDLE_MARK]]
    return [piece for k in ARRANGEMENTS[form] for piece in blocks[k]]


def rearrange(output: bytes | memoryview, form: str) -> list[Piece]:
    """The pieces of the text within an output of that form, by the inverse permutation; no sentinel occurs within the text."""
    data = bytes(output)
    order = ARRANGEMENTS[form]
    borders = []
    for k in order[::2]:
        at = data.find(SENTINELS[3 * (k - 3) : 3 * (k - 2)], borders[-1] if borders else 0)
        if at < 0:
            raise ValueError(f"no {form} output: a sentinel is missing")
        borders += [at, at + 3]
    blocks = cut([(TEXT, 0, len(data))], borders[1:])
    inverse = np.argsort(order)
    return [piece for k in inverse[:3] for piece in blocks[k]]


def stream(pieces: Iterable[Piece], text: memoryview) -> Iterator[memoryview]:
    """The bytes of the pieces, without a copy."""
    buffers = (text, memoryview(SENTINELS))
    for buffer, start, length in pieces:
        yield buffers[buffer][start : start + length]


def digest(parts: Iterable[memoryview]) -> str:
    h = hashlib.sha256()
    for part in parts:
        h.update(part)
    return h.hexdigest()


def _draws(seed: int, doc_id: object) -> list[int]:
    """The first four 8-digit groups of the hex SHA-256 of seed:doc_id; a null id has no digits."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]


def _chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _mapped(df: DataFrame, columns: list[str], made: list[T.StructField], row: Callable) -> DataFrame:
    """df with the made columns, from row(*values of columns); strings come as buffers of bytes, nulls as None."""
    rest = df.drop(*(f.name for f in made if f.name not in columns))
    schema = T.StructType([*rest.schema.fields, *made])
    kinds = {T.StringType(): pa.string(), T.LongType(): pa.int64()}
    names = [f.name for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            done = [row(*(_plain(c[i]) for c in cells)) for i in range(batch.num_rows)]
            arrays = [_array([d[k] for d in done], kinds[f.dataType]) for k, f in enumerate(made)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *names])

    return rest.mapInArrow(run, schema)


def _plain(cell: pa.Scalar) -> object:
    if pa.types.is_string(cell.type) or pa.types.is_large_string(cell.type):
        return memoryview(cell.as_buffer()) if cell.is_valid else None
    return cell.as_py()


def _array(values: list, kind: pa.DataType) -> pa.Array:
    """Bytes stand for strings here, as they are UTF-8 already."""
    if pa.types.is_string(kind) and any(isinstance(v, bytes) for v in values):
        return pa.array(values, pa.binary()).view(pa.string())
    return pa.array(values, kind)


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, suffix_first: int = 80, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars, output and output_sha256.

    n counts units: runs of other characters with the white space before them, and white
    space at the end. The two cuts and the form are drawn from the hash of seed:row_id, so
    repeated rows and equal ids with other texts draw alike and each row has its result. rate: of 100
    documents, how many are taken apart; suffix_first: of 100 of these, how many start
    with the suffix (spm, else psm). An empty text and one that holds a sentinel are plain,
    and their output is the text. Null texts are empty texts; a null id draws by the seed
    alone. Lengths are in code points, null where plain. Columns of these names are
    replaced, all others stay. No rows give no rows.
    """

    def row(doc_id: object, value: memoryview | None) -> tuple:
        body = value if value is not None else memoryview(b"")
        data = np.frombuffer(body, dtype=np.uint8)
        ends = unit_ends(data)
        n = len(ends)
        h1, h2, h3, h4 = _draws(seed, doc_id)
        whole = bytes(body)
        pieces = [(TEXT, 0, len(data))]
        if not n or h3 % 100 >= rate or any(SENTINELS[k : k + 3] in whole for k in (0, 3, 6)):
            return n, "plain", None, None, whole, digest(stream(pieces, body))
        form = "spm" if h4 % 100 < suffix_first else "psm"
        a, b = (int(ends[k - 1]) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
        moved = arrange(cut(pieces, (a, b)), form)
        return n, form, _chars(data[:a]), _chars(data[a:b]), b"".join(stream(moved, body)), digest(stream(moved, body))

    made = [("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string"), ("output_sha256", "string")]
    return _mapped(docs, [row_id, text], [T.StructField(n, T.LongType() if t == "long" else T.StringType()) for n, t in made], row)


def restore(changed: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """changed with restored, the text before fill_in_middle, from output and form alone, and restored_sha256.

    Plain outputs are the text; a null output is an empty text. An output without the
    sentinels of its form is refused. Columns of these names are replaced, all others stay.
    """

    def row(value: memoryview | None, kind: memoryview) -> tuple:
        body = value if value is not None else memoryview(b"")
        name = bytes(kind).decode()
        pieces = [(TEXT, 0, len(body))] if name == "plain" else rearrange(body, name)
        return b"".join(stream(pieces, body)), digest(stream(pieces, body))

    return _mapped(changed, [output, form], [T.StructField("restored", T.StringType()), T.StructField("restored_sha256", T.StringType())], row)


ORACLE = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), placed AS (
  SELECT doc_id, text, units, len(units) AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), cut AS (
  SELECT *, array_to_string(units[1:least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(units[greatest(a, b) + 1:], '') AS suffix
  FROM placed
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
"""
