"""Removal of passages that also start in an earlier document, over texts as sequences of symbols.

A window of L symbols is a repeat where its symbols also start in a document of smaller id.
Every window picks an anchor, its K-gram of smallest hash, by its own content alone, so equal
windows pick equal anchors at the same offset. Neighbouring windows mostly pick the same one;
such a run of windows covers a passage of 2 * L - K symbols at most. Documents meet by the
anchors of their runs, as (anchor, hash of the passage, document) without the text. There,

- a passage that an earlier document has too is a repeat as a whole;
- where an anchor has several passages, the first document of each sends it as text to the
  anchor's task, and a solver tells which windows are in passages of earlier documents:
  suffix automata for words, bucket-pointer refinement of a suffix array for bytes;
- an anchor with more than HOT passages is not gathered: its passages are halved by the offset
  of the anchor in the window, and the halves meet by the longer stretch that all their windows
  share. These are settled or halved again; a single window has no other in its group.

Rows that agree within a batch of documents are combined before every exchange.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookweave.llm.columns import fresh
from bookweave.plans.scratch import discard, stage_table

#: Different passages of an anchor that are gathered in one task.
HOT = 1024
#: Bytes of text that are hashed at once.
PIECE = 1 << 18
#: Bytes of passages that a solver settles at once.
BATCH_BYTES = 1 << 20
#: Rows of an anchor that are held while its last passage may go on.
CARRY = 4096
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)
#: White space of ASCII.
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_PASSAGES = "key long, doc long, rid long, starts array<long>, at int, low int, high int, passage binary"


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


def eights(part: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one number; zeros follow the end."""
    return np.ndarray((len(part),), dtype="<u8", buffer=np.concatenate([part, np.zeros(8, np.uint8)]), strides=(1,))


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first to first + size - 1 of each, one after the other."""
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column without nulls, and where each starts and the last ends."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data or b"", dtype=np.uint8), at


@dataclass
class Slab:
    """Symbols of stretches of texts, one after the other."""

    symbols: np.ndarray
    #: Of each stretch: its text's row, where it starts in symbols, how many it has, and where its first is in the text.
    row: np.ndarray
    first: np.ndarray
    size: np.ndarray
    base: np.ndarray
    #: Of words: the bytes, and where each word starts and ends.
    raw: np.ndarray | None = None
    left: np.ndarray | None = None
    right: np.ndarray | None = None


@dataclass
class Runs:
    """Runs of windows that share an anchor: row, first window in the text and in the slab, windows, anchor's place in the slab and hash."""

    row: np.ndarray
    start: np.ndarray
    first: np.ndarray
    n: np.ndarray
    place: np.ndarray
    anchor: np.ndarray


class Symbols(ABC):
    """How a text is read as symbols, and the solver of gathered passages."""

    length: int
    gram: int

    @abstractmethod
    def slabs(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[Slab]:
        """All windows of all texts, each in one slab."""

    @abstractmethod
    def gram_hashes(self, symbols: np.ndarray) -> np.ndarray: ...

    @abstractmethod
    def contents(self, slab: Slab, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hashes of stretches of a slab that do not depend on those of their grams."""

    @abstractmethod
    def passages(self, slab: Slab, first: np.ndarray, size: np.ndarray) -> pa.Array:
        """Stretches of a slab as bytes."""

    @abstractmethod
    def count_in(self, passage: bytes) -> int: ...

    @abstractmethod
    def cut(self, passage: bytes, start: int, end: int) -> bytes: ...

    @abstractmethod
    def remove(self, text: str, spans: list[tuple[int, int]]) -> tuple[int, bytes]:
        """How many symbols a text has, and its bytes without those of the spans."""

    @abstractmethod
    def solve(self, groups: list[tuple[list[bytes], list[int]]]) -> list[list[np.ndarray]]:
        """For each group, of distinct passages and the smallest document of each, in rising order of the documents: a mask per passage of its windows that are in a passage of a smaller document."""

    def runs(self, slab: Slab) -> Runs:
        span = self.length - self.gram + 1
        windows = np.maximum(slab.size - self.length + 1, 0)
        s = ranges(slab.first, windows)
        if not len(s):
            none = np.zeros(0, dtype=np.int64)
            return Runs(none, none, none, none, none, none)
        h = self.gram_hashes(slab.symbols)
        low = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        stretch = np.repeat(np.arange(len(windows)), windows)
        place = (low & np.uint64(0xFFFFFF)).astype(np.int64)[s]
        new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (stretch[1:] != stretch[:-1])]))
        first, stretch, place = s[new], stretch[new], place[new]
        return Runs(slab.row[stretch], first - slab.first[stretch] + slab.base[stretch], first, np.diff(np.append(new, len(s))), place, h[place].view(np.int64))

    def read(self, column: pa.Array) -> Iterator[tuple[Slab, Runs, np.ndarray]]:
        """Slabs of a column of texts with their runs and the hashes of the runs' passages."""
        for slab in self.slabs(*text_bytes(column)):
            if len(slab.symbols) >= self.length:
                runs = self.runs(slab)
                if len(runs.row):
                    yield slab, runs, self.contents(slab, runs.first, runs.n + self.length - 1).view(np.int64)


def _anchors(symbols: Symbols):
    """(anchor, passage hash, doc, told) of the runs of texts, each once for a doc.

    Of the docs of a batch that have a passage, only the smallest goes to its anchor; the
    others are told here that the passage is a repeat, and go to a place of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            found = [(r.anchor, c, ids[r.row]) for _, r, c in symbols.read(batch.column(1))]
            if not found:
                continue
            k, c, doc = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((doc, c, k))
            k, c, doc = k[order], c[order], doc[order]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
            single = new | np.concatenate([[True], doc[1:] != doc[:-1]])
            k, c, doc, told = k[single], c[single], doc[single], ~new[single]
            k = np.where(told, mixed(doc.view(np.uint64)).view(np.int64), k)
            for a in range(0, len(k), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 17)]) for x in (k, c, doc, told)], names=["k", "c", "doc", "told"])

    return run


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows of _anchors sorted by anchor, passage and doc; gives (doc, c, whole).

    whole: the passage is a repeat as it stands. Not whole: it is the first of its kind, and
    its anchor has other kinds. Anchors of one doc give nothing.
    """
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]

    def decide(k, c, doc, seen, open_: bool) -> tuple[pa.RecordBatch, list[np.ndarray]]:
        new = np.concatenate([[True], k[1:] != k[:-1]])
        kind = new | np.concatenate([[True], c[1:] != c[:-1]])
        group, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        kinds = np.add.reduceat(kind.astype(np.int64), starts)
        shared = np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts)
        whole = doc > doc[np.maximum.accumulate(np.where(kind, np.arange(len(k)), 0))]
        part = kind & (shared | open_)[group] & (kinds > 1)[group]
        rest = [x[:0] for x in (k, c, doc, seen)]
        if open_:  # one group, which goes on: rows that tell of it stay, those not decided unseen
            last = np.flatnonzero(kind)[-1]
            stay = np.unique([0, last, int(doc.argmin()), int(doc.argmax())])
            rest = [k[stay], c[stay], doc[stay], seen[stay] | whole[stay] | part[stay]]
        give = (whole | part) & ~seen
        return pa.RecordBatch.from_arrays([pa.array(x[give]) for x in (doc, c, whole)], names=["doc", "c", "whole"]), rest

    for batch in batches:
        told = batch.column(3).to_numpy(zero_copy_only=False)
        rows = [batch.column(i).to_numpy() for i in range(3)]
        if told.any():
            yield pa.RecordBatch.from_arrays([pa.array(rows[2][told]), pa.array(rows[1][told]), pa.array(told[told])], names=["doc", "c", "whole"])
            rows = [x[~told] for x in rows]
        if not len(rows[0]):
            continue
        now = [np.concatenate(x) for x in zip(held, [*rows, np.zeros(len(rows[0]), bool)], strict=True)]
        last = int(np.searchsorted(now[0], now[0][-1]))
        if last:
            yield decide(*(x[:last] for x in now), False)[0]
        held = [x[last:] for x in now]
        if len(held[0]) > CARRY:
            out, held = decide(*held, True)
            yield out
    if len(held[0]):
        yield decide(*held, False)[0]


_SENT = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("rid", pa.int64()), ("starts", pa.list_(pa.int64())), ("at", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("passage", pa.binary())])


def _spread(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    return mixed(doc.view(np.uint64) * _A + start.view(np.uint64)).view(np.int64)


def _told(doc: np.ndarray, rid: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Repeats, in rows of the passages' form: starts holds the start and the end, passage is null."""
    n = len(doc)
    pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * n + 1, 2, dtype=np.int32)), pa.array(np.stack([start, end], axis=1).ravel()))
    none = pa.nulls(n, pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(_spread(doc, start)), pa.array(doc), pa.array(rid), pairs, none, none, none, pa.nulls(n, pa.binary())], schema=_SENT)


def _gathered(symbols: Symbols):
    """The repeats that are told, merged, and the passages that are first of their kind, of (doc, text, rid, whole, part)."""

    def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())])

    def within(runs: Runs, c: np.ndarray, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(c), dtype=bool)
        edge = np.flatnonzero(np.concatenate([[True], runs.row[1:] != runs.row[:-1], [True]]))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            row = runs.row[a]
            wanted = values[at[row] : at[row + 1]]
            if len(wanted):
                out[a:b] = np.isin(c[a:b], wanted)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rids = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            whole, part = lists(batch.column(3)), lists(batch.column(4))
            for slab, runs, c in symbols.read(batch.column(1)):
                sure = within(runs, c, *whole)
                row, start = runs.row[sure], runs.start[sure]
                end = start + runs.n[sure] + symbols.length - 1
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > end[:-1])])) if len(row) else []
                if len(new):
                    last = np.append(new[1:], len(row)) - 1
                    yield _told(ids[row[new]], rids[row[new]], start[new], end[last])
                open_ = np.flatnonzero(within(runs, c, *part))
                if len(open_):
                    open_ = open_[np.lexsort((runs.start[open_], c[open_], runs.row[open_]))]
                    row = runs.row[open_]
                    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (c[open_][1:] != c[open_][:-1])]))
                    one = open_[new]
                    starts = pa.ListArray.from_arrays(pa.array(np.append(new, len(open_)).astype(np.int32)), pa.array(runs.start[open_]))
                    n, span = len(one), symbols.length - symbols.gram + 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(runs.anchor[one]), pa.array(ids[runs.row[one]]), pa.array(rids[runs.row[one]]), starts, pa.array((runs.place - runs.first)[one].astype(np.int32)),
                         pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, span, np.int32)), symbols.passages(slab, runs.first[one], runs.n[one] + symbols.length - 1)],
                        schema=_SENT,
                    )

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, field.type) for x, field in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)


def _spans(found: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return _told(*(np.array(x, dtype=np.int64) for x in zip(*found, strict=True)))


def _settle(symbols: Symbols):
    """Streams passages sorted by key and doc; gives the repeats among them, and as they are the passages of a key that has too many kinds."""
    windows = lambda passage: symbols.count_in(passage) - symbols.length + 1

    def settle(groups: list[tuple[dict[bytes, int], list[tuple]]]) -> list[tuple[int, int, int, int]]:
        found = []
        for (kinds, rows), masks in zip(groups, symbols.solve([(list(g), list(g.values())) for g, _ in groups]), strict=True):
            mask_of = dict(zip(kinds, masks, strict=True))
            for _, doc, rid, starts, _, _, _, passage in rows:
                mask = mask_of[passage]
                if mask.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))).reshape(-1, 2).tolist()
                    found += [(doc, rid, s + a, s + b + symbols.length - 1) for s in starts for a, b in edge]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        over: list[tuple] = []
        ready: list[tuple] = []
        size, key, kinds, rows, large = 0, None, {}, [], False
        for batch in batches:
            passed = batch.filter(batch.column(7).is_null())
            if passed.num_rows:
                yield passed
                batch = batch.filter(batch.column(7).is_valid())
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != key:
                    if len(kinds) > 1:
                        ready.append((kinds, rows))
                    key, kinds, rows, large = row[0], {}, [], False
                    if size > BATCH_BYTES:
                        found += settle(ready)
                        ready, size = [], 0
                if large:
                    over.append(row)
                    continue
                doc, passage = row[1], row[7]
                first = kinds.setdefault(passage, doc)
                if doc > first:
                    n = windows(passage) + symbols.length - 1
                    found += [(doc, row[2], s, s + n) for s in row[3]]
                elif row[6] - row[5] > 1:  # a single window has no other kind in its group
                    rows.append(row)
                    size += len(passage)
                    if len(kinds) > HOT or len(rows) > 4 * HOT:
                        over += rows
                        kinds, rows, large = {}, [], True
            if found:
                yield _spans(found)
                found = []
            if over:
                yield _batch(over)
                over = []
        if len(kinds) > 1:
            ready.append((kinds, rows))
        if ready and (found := settle(ready)):
            yield _spans(found)

    return run


def _halved(symbols: Symbols):
    """Passages as two each, of the windows that have the anchor in the lower and in the upper half of its offsets; equal ones of a batch are combined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first: dict[tuple[int, bytes], tuple] = {}
            found, more = [], []
            parts = []
            for key, doc, rid, starts, at, low, high, passage in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, middle = symbols.count_in(passage) - symbols.length + 1, (low + high) // 2
                for a, b in ((low, middle), (middle, high)):
                    s, e = max(0, at - b + 1), min(n - 1, at - a)
                    if s <= e:
                        common = symbols.cut(passage, at - a, at - b + 1 + symbols.length)
                        new = xxhash.xxh3_64_intdigest(common + key.to_bytes(8, "little", signed=True), a) - (1 << 63)
                        parts.append((new, doc, rid, [x + s for x in starts], at - s, a, b, symbols.cut(passage, s, e + symbols.length)))
            for row in sorted(parts, key=lambda x: x[1]):
                kind = (row[0], row[7])
                held = first.setdefault(kind, row)
                if held is not row:
                    if row[1] > held[1]:
                        size = symbols.count_in(row[7])
                        found += [(row[1], row[2], s, s + size) for s in row[3]]
                    elif row[2] == held[2]:
                        held[3].extend(row[3])
                    else:
                        more.append(row)
            if found:
                yield _spans(found)
            if first:
                yield _batch([*first.values(), *more])

    return run


def repeated_spans(docs: DataFrame, symbols: Symbols, row_id: str, text: str) -> DataFrame:
    """(doc, rid, spans) of the rows that have a repeat; rid is a hash of the text, spans are unmerged."""
    rows = docs.select(F.col(row_id).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    met = rows.mapInArrow(_anchors(symbols), "k long, c long, doc long, told boolean").repartition("k").sortWithinPartitions("k", "c", "doc")
    kinds = met.mapInArrow(_classify, "doc long, c long, whole boolean")
    by_doc = kinds.groupBy("doc").agg(F.collect_list(F.when(F.col("whole"), F.col("c"))).alias("whole"), F.collect_list(F.when(~F.col("whole"), F.col("c"))).alias("part"))
    by_doc = stage_table(by_doc, "anchors")
    sent = rows.withColumn("rid", F.xxhash64("text")).join(by_doc, "doc").select("doc", "text", "rid", "whole", "part").mapInArrow(_gathered(symbols), _PASSAGES)
    spans, span = [], symbols.length - symbols.gram + 1
    while True:
        settled = stage_table(sent.repartition("key").sortWithinPartitions("key", "doc").mapInArrow(_settle(symbols), _PASSAGES), "spans")
        spans.append(settled.where("passage is null").select("doc", "rid", F.col("starts")[0].alias("start"), F.col("starts")[1].alias("end")))
        over = settled.where("passage is not null")
        if span == 1 or not over.limit(1).count():
            break
        sent, span = over.mapInArrow(_halved(symbols), _PASSAGES), -(-span // 2)
    discard(by_doc)
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out.groupBy("doc", "rid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of sorted or unsorted spans; spans that touch become one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, symbols: Symbols, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_symbols, removed (maximal spans, as struct of start and end) and kept (binary).

    Removes each symbol covered by a window that also starts in a row of smaller row_id.
    Windows are judged on the input. Texts shorter than a window have no repeat; null texts
    count as empty; rows of null row_id stay whole and remove nothing. Rows of equal
    row_id, repeated or not, do not remove each other's symbols and each keep their own
    result. Columns of the three names are replaced, all others stay, whatever their names.
    row_id is an integer. An empty table gives an empty table.
    """
    rest = docs.drop("n_symbols", "removed", "kept")
    spans = repeated_spans(rest, symbols, row_id, text)
    doc_, rid_, spans_ = fresh(rest.columns, "doc", "rid", "spans")
    keyed = rest.withColumns({doc_: F.col(f"`{row_id}`").cast("long"), rid_: F.xxhash64(F.col(f"`{text}`"))})
    spans = spans.select(F.col("doc").alias(doc_), F.col("rid").alias(rid_), F.col("spans").alias(spans_))
    joined = keyed.join(spans, [doc_, rid_], "left").select(*(F.col(f"`{c}`") for c in rest.columns), spans_)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([*rest.schema.fields, T.StructField("n_symbols", T.LongType()), T.StructField("removed", T.ArrayType(span)), T.StructField("kept", T.BinaryType())])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names, texts = schema.names, rest.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            for t, s in zip(batch.column(texts).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                runs = merge([(x["start"], x["end"]) for x in s or []])
                n, left = symbols.remove(t or "", runs)
                sizes.append(n)
                removed.append([{"start": a, "end": b} for a, b in runs])
                kept.append(left)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], names=names
            )

    return joined.mapInArrow(run, schema)


class Words(Symbols):
    """Words between ASCII white space, settled by suffix automata."""

    def __init__(self, length: int = 13, gram: int = 5):
        self.length, self.gram = length, min(gram, length)

    def slabs(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[Slab]:
        held: list[tuple[int, int, int, int]] = []
        total = 0
        for row, (a, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            if end - a <= PIECE:
                held.append((row, a, end, 0))
                total += end - a
                if total > PIECE:
                    yield self._slab(data, held)
                    held, total = [], 0
                continue
            base, piece = 0, PIECE
            while True:
                cut = min(end, a + piece)
                while cut < end and not (space := _SPACE[data[cut : min(end, cut + 4096)]]).any():
                    cut = min(end, cut + 4096)
                if cut < end:
                    cut += int(space.argmax())
                slab = self._slab(data, [(row, a, cut, base)])
                step = len(slab.symbols) - self.length + 1
                if step > 0 or cut == end:
                    yield slab
                    if cut == end:
                        break
                    a, base, piece = a + int(slab.left[step]), base + step, PIECE
                else:
                    piece *= 2
        if held:
            yield self._slab(data, held)

    def _slab(self, data: np.ndarray, held: list[tuple[int, int, int, int]]) -> Slab:
        raw = np.concatenate([data[a:b] for _, a, b, _ in held])
        bounds = np.concatenate([[0], np.cumsum([b - a for _, a, b, _ in held])])
        space = np.concatenate([[True], _SPACE[raw], [True]])  # of the place before each, and of that after the last
        border = np.zeros(len(raw) + 1, dtype=bool)
        border[bounds] = True
        inside = ~space[1:-1]
        left = np.flatnonzero(inside & (space[:-2] | border[:-1]))
        right = np.flatnonzero(inside & (space[2:] | border[1:])) + 1
        at = np.searchsorted(left, bounds)
        row, base = (np.array(x, dtype=np.int64) for x in list(zip(*held, strict=True))[::3])
        return Slab(self._hashed(raw, left, right), row, at[:-1], np.diff(at), base, raw, left, right)

    @staticmethod
    def _hashed(raw: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        u, n = eights(raw), right - left
        h = n.astype(np.uint64) * _A
        live, done = np.arange(len(n)), 0
        while len(live) and done < 256:
            rest = n[live] - done
            h[live] = mixed(h[live] * _A + (u[left[live] + done] & _LOW[np.minimum(rest, 8)]))
            live, done = live[rest > 8], done + 8
        for i in live.tolist():
            h[i] = xxhash.xxh64_intdigest(raw[left[i] : right[i]].tobytes())
        return h

    def gram_hashes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.zeros(len(symbols) - self.gram + 1, dtype=np.uint64)
        for j in range(self.gram):
            out = out * _A + symbols[j : j + len(out)]
        return mixed(out)

    def contents(self, slab: Slab, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        h, out = mixed(slab.symbols ^ _B), size.astype(np.uint64)
        for j in range(int(size.max())):
            live = np.flatnonzero(size > j) if j >= self.length else slice(None)
            out[live] = out[live] * _B + h[first[live] + j]
        return mixed(out)

    def passages(self, slab: Slab, first: np.ndarray, size: np.ndarray) -> pa.Array:
        word = ranges(first, size)
        n = slab.right[word] - slab.left[word] + 1
        ends = np.cumsum(n)
        places = ranges(slab.left[word], n)
        out = np.concatenate([slab.raw, np.zeros(1, np.uint8)])[np.minimum(places, len(slab.raw))]
        out[ends - 1] = 0x20
        edges = np.concatenate([[0], ends[np.cumsum(size) - 1]])
        keep = np.ones(len(out), dtype=bool)
        keep[edges[1:] - 1] = False
        return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((edges - np.arange(len(edges))).astype(np.int32)), pa.py_buffer(out[keep])])

    def count_in(self, passage: bytes) -> int:
        return passage.count(b" ") + 1

    def cut(self, passage: bytes, start: int, end: int) -> bytes:
        return b" ".join(passage.split(b" ")[start:end])

    def remove(self, text: str, spans: list[tuple[int, int]]) -> tuple[int, bytes]:
        words, out, at = text.encode().split(), [], 0
        for a, b in spans:
            out += words[at:a]
            at = b
        return len(words), b" ".join(out + words[at:])

    def solve(self, groups: list[tuple[list[bytes], list[int]]]) -> list[list[np.ndarray]]:
        out = []
        for passages, docs in groups:
            automaton, waiting, masks = SuffixAutomaton(), [], []
            for i, (passage, doc) in enumerate(zip(passages, docs, strict=True)):
                if i and doc != docs[i - 1]:
                    for w in waiting:
                        automaton.add(w)
                    waiting = []
                words = passage.split(b" ")
                masks.append(np.array(automaton.matches(words)[self.length - 1 :]) >= self.length)
                waiting.append(words)
            out.append(masks)
        return out


class SuffixAutomaton:
    """The suffix automaton of sequences; a border that nothing equals stands after each."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.last = 0

    def _extend(self, c) -> None:
        nxt, link, length = self.next, self.link, self.length
        cur, p = len(nxt), self.last
        nxt.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        self.last = cur

    def add(self, sequence: list) -> None:
        for c in sequence:
            self._extend(c)
        self._extend(len(self.next))  # an int, where symbols are bytes

    def matches(self, sequence: list) -> list[int]:
        """Matching statistics: the longest run that ends at each place and is in the automaton."""
        nxt, link, length = self.next, self.link, self.length
        state, size, out = 0, 0, []
        for c in sequence:
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                size += 1
            out.append(size)
        return out


class Bytes(Symbols):
    """UTF-8 bytes, settled by bucket-pointer refinement of a suffix array."""

    def __init__(self, length: int = 50, gram: int = 16):
        if length < gram or gram != 16:
            raise ValueError("windows of 16 bytes or more, with grams of 16")
        self.length, self.gram = length, gram

    def slabs(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[Slab]:
        held: list[tuple[int, int, int, int]] = []
        total = 0
        for row, (a, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            for s in range(a, end - self.length + 1, PIECE):
                e = min(end, s + PIECE + self.length - 1)
                held.append((row, s, e, s - a))
                total += e - s
                if total > PIECE:
                    yield self._slab(data, held)
                    held, total = [], 0
        if held:
            yield self._slab(data, held)

    @staticmethod
    def _slab(data: np.ndarray, held: list[tuple[int, int, int, int]]) -> Slab:
        row, start, end, base = (np.array(x, dtype=np.int64) for x in zip(*held, strict=True))
        size = end - start
        return Slab(np.concatenate([data[a:b] for _, a, b, _ in held]), row, np.cumsum(size) - size, size, base)

    def gram_hashes(self, symbols: np.ndarray) -> np.ndarray:
        u = eights(symbols)[: len(symbols) - 7].copy()
        return mixed(u[:-8] * _B + mixed(u[8:]))

    def contents(self, slab: Slab, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        u, out = eights(slab.symbols), size.astype(np.uint64)
        for j in range(0, int(size.max()) - 7, 8):
            live = np.flatnonzero(size >= j + 8) if j + 8 > self.length else slice(None)
            out[live] = mixed(out[live] * _A + u[first[live] + j])
        return mixed(out * _A + u[first + size - 8])

    def passages(self, slab: Slab, first: np.ndarray, size: np.ndarray) -> pa.Array:
        edges = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(edges), pa.py_buffer(slab.symbols[ranges(first, size)])])

    def count_in(self, passage: bytes) -> int:
        return len(passage)

    def cut(self, passage: bytes, start: int, end: int) -> bytes:
        return passage[start:end]

    def remove(self, text: str, spans: list[tuple[int, int]]) -> tuple[int, bytes]:
        raw, out, at = text.encode(), [], 0
        for a, b in spans:
            out.append(raw[at:a])
            at = b
        return len(raw), b"".join([*out, raw[at:]])

    def solve(self, groups: list[tuple[list[bytes], list[int]]]) -> list[list[np.ndarray]]:
        passages = [p for ps, _ in groups for p in ps]
        if not passages:
            return []
        sizes = np.array([len(p) for p in passages])
        windows = sizes - self.length + 1
        text = np.frombuffer(b"".join(passages), dtype=np.uint8)
        at = ranges(np.cumsum(sizes) - sizes, windows)
        number = self.classes(text, self.suffixes(text), at)
        owner = np.repeat(np.array([d for _, ds in groups for d in ds]), windows)
        low = np.full(number.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, number, owner)
        parts = np.split(low[number] < owner, np.cumsum(windows)[:-1])
        out, i = [], 0
        for ps, _ in groups:
            out.append(parts[i : i + len(ps)])
            i += len(ps)
        return out

    def suffixes(self, text: np.ndarray, slice_size: int = 1 << 16) -> np.ndarray:
        """Suffixes of a text in the order of their first `length` bytes at least, by bucket-pointer refinement.

        The first buckets are those of the 8-grams. A suffix's pointer is where its bucket
        starts in the array. A bucket known to agree in d bytes is sorted by the pointers of
        the suffixes d further on and falls into buckets that agree in d bytes more than
        those do. Pointers are set anew after every slice of buckets, so that buckets
        sorted later, and the same buckets in their next turn, use what is already refined.
        Buckets of one suffix, or that agree far enough, are not sorted again.
        """
        n = len(text)
        grams = eights(text).byteswap()  # first byte first in the order
        array = np.argsort(grams, kind="stable")
        sorted_ = grams[array]
        pointer, depth = np.empty(n, dtype=np.int64), np.full(n, 8, dtype=np.int64)

        def bucket_starts(new: np.ndarray, places: np.ndarray) -> np.ndarray:
            return np.maximum.accumulate(np.where(new, places, 0))

        pointer[array] = bucket_starts(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]), np.arange(n))
        live = np.arange(n)
        while True:
            bucket = pointer[array[live]]
            same = bucket[1:] == bucket[:-1]
            alone = ~(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
            live = live[~alone & (depth[array[live]] < self.length)]
            if not len(live):
                return array
            bucket = pointer[array[live]]
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            cuts = np.unique(np.append(edges[np.searchsorted(edges, np.arange(0, len(live), slice_size), side="right") - 1], len(live)))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                places = live[a:b]
                suffix = array[places]
                further = suffix + depth[suffix]
                inside = further < n
                further[~inside] = 0
                key = pointer[suffix] * np.int64(n + 1) + np.where(inside, pointer[further] + 1, 0)
                deeper = depth[suffix] + np.where(inside, depth[further], self.length)
                order = np.argsort(key, kind="stable")
                suffix, key = suffix[order], key[order]
                array[places] = suffix
                pointer[suffix] = bucket_starts(np.concatenate([[True], key[1:] != key[:-1]]), places)
                depth[suffix] = deeper[order]

    def classes(self, text: np.ndarray, array: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Numbers of the windows at the given places, equal for equal windows: neighbours in the suffix array are compared."""
        wanted = np.zeros(len(text), dtype=bool)
        wanted[at] = True
        order = array[wanted[array]]
        u = eights(text)
        new = np.zeros(len(order), dtype=bool)
        for j in [*range(0, self.length - 8, 8), self.length - 8]:
            x = u[order + j]
            new[1:] |= x[1:] != x[:-1]
        number = np.empty(len(text), dtype=np.int64)
        number[order] = np.cumsum(new)
        return number[at]


ORACLE_WORDS = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM w, unnest(range(1, len(ws) - 11)) AS t(i)
), first AS (
  SELECT g, min(doc_id) AS m FROM win GROUP BY g
), cover AS (
  SELECT DISTINCT doc_id, i + k AS p FROM win JOIN first USING (g), unnest(range(13)) AS t(k) WHERE m < doc_id
), words AS (
  SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(p)
), told AS (
  SELECT words.doc_id, count(*) AS n_words, count(cover.p) AS n_removed,
    string_agg(word, ' ' ORDER BY words.p) FILTER (cover.p IS NULL) AS kept
  FROM words LEFT JOIN cover ON cover.doc_id = words.doc_id AND cover.p = words.p GROUP BY words.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN told ON told.doc_id = d.doc_id
"""

ORACLE_BYTES = """
WITH b AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), win AS (
  SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS g FROM b, unnest(range(1, length(h) // 2 - 48)) AS t(i)
), first AS (
  SELECT g, min(doc_id) AS m FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)
), marks AS (
  SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS new
  FROM win JOIN first USING (g) WHERE m < doc_id
), runs AS (
  SELECT doc_id, i, count(*) FILTER (new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM marks
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM runs GROUP BY doc_id, r
), gaps AS (
  SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS p FROM spans
), told AS (
  SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(z) AS z,
    string_agg(substr(h, 2 * p - 1, 2 * (a - p)), '' ORDER BY a) AS kept
  FROM gaps JOIN b USING (doc_id) GROUP BY doc_id
)
SELECT b.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept || substr(h, 2 * z - 1), h))) AS kept_sha256
FROM b LEFT JOIN told ON told.doc_id = b.doc_id
"""
