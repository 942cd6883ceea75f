"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A piece of n bytes starts as n one-byte tokens. A segment tree over the byte positions
holds at each leaf the rank of the pair that starts there, joined with the position, so
that the root is the leftmost pair of the lowest rank. A merge updates three leaves: the
merged token, its dead right half and its left neighbour, each in logarithmic time.

Many short pieces are encoded together: their trees are rows of one numpy array and each
round merges one pair in every row. Long pieces have a tree of their own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pieces up to this many bytes are encoded in groups and remembered.
SHORT = 64
#: Pieces remembered in each of two generations; the older one is dropped when the younger is full.
REMEMBERED = 200_000
#: Trees that are merged together.
GROUP = 8192
_NONE = np.int64(1) << np.int64(60)


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file of lines `base64 rank`."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class BpeCodec:
    """Encodes and decodes text by the ranks of a byte-level vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.token = {i: b for b, i in ranks.items()}
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        keys, made = [], []
        for word, rank in ranks.items():
            for cut in range(1, len(word)):
                a, b = ranks.get(word[:cut]), ranks.get(word[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.pair_key = np.array(keys, dtype=np.int64)[order]
        self.pair_id = np.array(made, dtype=np.int64)[order]
        self.young: dict[str, bytes] = {}  # int32 ids
        self.old: dict[str, bytes] = {}

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_id[at], _NONE)

    def encode_long(self, piece: bytes) -> list[int]:
        """Ids of one piece of any length."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        none, token, find = int(_NONE), self.token, self.ranks.get
        ids = self.byte[np.frombuffer(piece, dtype=np.uint8)].tolist() + [0]
        after, before = list(range(1, n + 2)), list(range(-1, n))
        tree = [none] * (2 * width)
        for i in range(n - 1):
            rank = find(token[ids[i]] + token[ids[i + 1]])
            if rank is not None:
                tree[width + i] = rank * width + i
        for x in range(width - 1, 0, -1):
            tree[x] = min(tree[2 * x], tree[2 * x + 1])

        def put(i: int, value: int) -> None:
            x = width + i
            tree[x] = value
            x >>= 1
            while x:
                a, b = tree[2 * x], tree[2 * x + 1]
                low = a if a < b else b
                if tree[x] == low:
                    break
                tree[x] = low
                x >>= 1

        while tree[1] < none:
            rank, i = divmod(tree[1], width)
            j = after[i]
            k = after[j]
            ids[i], after[i] = rank, k
            if k <= n:
                before[k] = i
            put(j, none)
            right = find(token[rank] + token[ids[k]]) if k < n else None
            put(i, none if right is None else right * width + i)
            p = before[i]
            if p >= 0:
                left = find(token[ids[p]] + token[rank])
                put(p, none if left is None else left * width + p)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def _encode_group(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids, as int32 bytes, of pieces of 2 to width bytes, width a power of two."""
        m = len(pieces)
        length = np.fromiter(map(len, pieces), dtype=np.int64, count=m)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(m, width)
        ids = np.zeros((m, width + 2), dtype=np.int64)
        ids[:, :width] = self.byte[raw]
        after = np.broadcast_to(np.arange(1, width + 3), (m, width + 2)).copy()
        before = np.broadcast_to(np.arange(-1, width + 1), (m, width + 2)).copy()
        tree = np.full((m, 2 * width), _NONE)
        first = self._merged(ids[:, : width - 1], ids[:, 1:width])
        spot = np.arange(width - 1)
        ok = (first < _NONE) & (spot < length[:, None] - 1)
        tree[:, width : 2 * width - 1] = np.where(ok, first * width + spot, _NONE)
        h = width // 2
        while h:
            tree[:, h : 2 * h] = np.minimum(tree[:, 2 * h : 4 * h : 2], tree[:, 2 * h + 1 : 4 * h : 2])
            h //= 2

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray | np.int64) -> None:
            x = at + width
            tree[rows, x] = value
            x = x >> 1
            for _ in range(width.bit_length() - 1):
                tree[rows, x] = np.minimum(tree[rows, 2 * x], tree[rows, 2 * x + 1])
                x = x >> 1

        alive = np.arange(width) < length[:, None]
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            rank, i = np.divmod(tree[rows, 1], width)
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i] = rank
            after[rows, i] = k
            before[rows, k] = i
            alive[rows, j] = False
            put(rows, j, _NONE)
            right = np.where(k < length[rows], self._merged(rank, ids[rows, k]), _NONE)
            put(rows, i, np.where(right < _NONE, right * width + i, _NONE))
            p = before[rows, i]
            has = p >= 0
            r, p = rows[has], p[has]
            left = self._merged(ids[r, p], rank[has])
            put(r, p, np.where(left < _NONE, left * width + p, _NONE))
            rows = rows[tree[rows, 1] < _NONE]
        flat = ids[:, :width][alive].astype(np.int32).tobytes()
        ends = (4 * np.cumsum(alive.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _learn(self, missing: set[str]) -> None:
        groups: dict[int, list[str]] = {}
        for piece in missing:
            raw = piece.encode()
            if (whole := self.ranks.get(raw)) is not None:
                self.young[piece] = np.int32(whole).tobytes()
            elif len(raw) <= SHORT:
                groups.setdefault(1 << max(1, (len(raw) - 1).bit_length()), []).append(piece)
        for width, pieces in groups.items():
            for at in range(0, len(pieces), GROUP):
                part = pieces[at : at + GROUP]
                self.young.update(zip(part, self._encode_group([p.encode() for p in part], width), strict=True))

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, its pieces found by the pattern and encoded one by one."""
        found = [self.pattern.findall(text) for text in texts]
        missing = set().union(*found).difference(self.young)
        if missing:
            kept = missing.intersection(self.old)
            self.young.update((p, self.old[p]) for p in kept)
            missing -= kept
            self._learn(missing)
        own = {p: np.array(self.encode_long(p.encode()), np.int32).tobytes() for p in missing if p not in self.young}
        get = (lambda p: own.get(p) or self.young[p]) if own else self.young.__getitem__
        out = [np.frombuffer(b"".join(map(get, pieces)), dtype=np.int32) for pieces in found]
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0].tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_CODECS: dict[tuple[int, str], BpeCodec] = {}


def codec_of(shared, pattern: str) -> BpeCodec:
    """The codec of a broadcast vocabulary, kept as long as the Python worker lives."""
    key = (len(shared.value), pattern)
    if key not in _CODECS or _CODECS[key].ranks is not shared.value and _CODECS[key].ranks != shared.value:
        _CODECS.clear()
        _CODECS[key] = BpeCodec(shared.value, pattern)
    return _CODECS[key]


def _slices(values: list, size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about size characters together, to group the encoding of many short ones."""
    start = total = 0
    for i, v in enumerate(values):
        total += len(v)
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(values):
        yield start, len(values)


def encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with a column of token ids, array<int>, as the vocabulary's own library gives them.

    vocabulary: path of a rank file; it is read on the driver and broadcast, and is refused
    beyond 64 MB. Special tokens are never made from text. A null text counts as empty and
    has no ids; an existing column of the name `out` is replaced. Repeated rows stay.
    Every other column is kept as it is. Whole texts are encoded, whatever their length.
    """
    ranks = load_ranks(vocabulary)
    if sum(map(len, ranks)) > 64 << 20:
        raise ValueError("the vocabulary is larger than 64 MB")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    rest = docs.drop(out)
    schema = T.StructType([*rest.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shared, pattern)
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            for a, b in _slices(texts):
                ids = codec.encode_many(texts[a:b])
                ends = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in ids], out=ends[1:])
                values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                made = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, out])

    return rest.mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with the bytes of their token ids, binary. Null ids give no bytes; unknown ids raise."""
    token = {i: b for b, i in load_ranks(vocabulary).items()}
    words = [token.get(i, b"") for i in range(max(token) + 1)]
    lengths = np.array([len(w) if i in token else -1 for i, w in enumerate(words)], dtype=np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(words), dtype=np.uint8), lengths))
    rest = rows.drop(out)
    schema = T.StructType([*rest.schema.fields, T.StructField(out, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, length = shared.value
        starts = np.cumsum(length.clip(0)) - length.clip(0)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            flat = column.flatten().to_numpy(zero_copy_only=False)
            counts = np.array(column.value_lengths().fill_null(0), dtype=np.int64)
            size = length[flat]
            if (size < 0).any():
                raise ValueError("an id is not in the vocabulary")
            ends = np.concatenate([[0], np.cumsum(size)])
            values = raw[np.repeat(starts[flat] - ends[:-1], size) + np.arange(ends[-1])]
            marks = ends[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
            made = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(marks), pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    return rest.mapInArrow(run, schema)
