"""Benchmark decontamination by q-gram lemma filtering.

A passage of m characters and its occurrence with at most k edits share at least
m - q + 1 - k * q q-grams, and these lie on at most k + 1 neighbouring diagonals. So
shared q-grams are counted in bands of 2 * (k + 1) diagonals that overlap by half; a band
with fewer cannot hold an occurrence, and the others are aligned within their diagonals.
q is Q, and less for passages so short that none of their Q-grams might be left: a passage is
cut by k edits into k + 1 parts, so one of m // (k + 1) characters always stays whole.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bookweave.llm.columns import fresh
from bookweave.plans.scratch import discard, stage_table

#: Most characters of a q-gram, and edits per character of a passage.
Q, ERROR = 8, 0.1
#: Items of more characters than LONG are sought in passages of LONG characters, one every STEP.
LONG, STEP = 160, 80
#: Characters of a text that are searched at once, and of the benchmark that are broadcast at once.
PIECE, ROUND = 1 << 17, 1 << 21
#: Characters of an item that are dealt to a round as one; longer ones come in parts that overlap.
PART = 1 << 19
_TABLE = 22
_MIX = np.uint64(0x9E3779B97F4A7C15)
LEAKS = "array<struct<item_id:long,start:long,end:long,edits:int>>"


def normal(text: str | None) -> str:
    """Lower case, with each run of white space as one space and none at the ends."""
    return " ".join((text or "").lower().split())


def places(text: str) -> np.ndarray:
    """For each character of normal(text), and for its end, the place in text that it comes from."""
    at: list[int] = []
    for m in re.finditer(r"\S+", text):
        if at:
            at.append(m.start() - 1)
        at += [m.start() + i for i, c in enumerate(m[0]) for _ in c.lower()]
    return np.array([*at, at[-1] + 1 if at else 0])


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(codes: np.ndarray, q: int = Q) -> np.ndarray:
    if len(codes) < q:
        return np.zeros(0, dtype=np.uint64)
    h = codes.astype(np.uint64)
    base, width = int(_MIX), 1
    while 2 * width <= q:
        h = h[: len(h) - width] * np.uint64(base) + h[width:]
        base, width = base * base % 2**64, 2 * width
    if width < q:  # two grams that overlap tell all of it
        h = h[: len(h) - (q - width)] * _MIX + (h[q - width :] ^ (h[q - width :] >> np.uint64(29)))
    return (h ^ (h >> np.uint64(32))) * _MIX


@dataclass
class Grams:
    """The q-grams of the passages of one q: a filter, the grams in order, and the (passage, place) of each."""

    q: int
    least: int
    table: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    passage: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, q: int, chosen: list[int], codes: list[np.ndarray], needed: np.ndarray) -> Grams:
        hashes = [gram_hashes(codes[i], q) for i in chosen]
        grams = np.concatenate(hashes)
        order = np.argsort(grams, kind="stable")
        unique, first = np.unique(grams[order], return_index=True)
        table = np.zeros(1 << _TABLE, dtype=bool)
        table[grams >> np.uint64(64 - _TABLE)] = True
        passage = np.repeat(chosen, [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes])
        return cls(q, int(needed[chosen].min()), table, unique, np.append(first, len(grams)), passage[order], place[order])


@dataclass
class Passages:
    """The passages sought: their items, characters, edit budgets and q-grams."""

    item: np.ndarray
    codes: list[np.ndarray]
    edits: np.ndarray
    needed: np.ndarray
    tables: list[Grams]
    #: Of each passage, the normal text of an item that it is from and its offset there.
    source: np.ndarray
    offset: np.ndarray
    texts: list[np.ndarray]

    @classmethod
    def of(cls, items: list[tuple[int, str | None]]) -> Passages:
        item, codes, source, offset, texts = [], [], [], [], []
        for number, text in items:
            text = normal(text)
            texts.append(codes_of(text))
            starts = [0] if len(text) <= LONG else [*range(0, len(text) - LONG, STEP), len(text) - LONG]
            for a in starts:
                if text:
                    item.append(number)
                    codes.append(codes_of(text[a : a + LONG] if len(text) > LONG else text))
                    source.append(len(texts) - 1)
                    offset.append(a)
        length = np.array([len(c) for c in codes], dtype=np.int64)
        edits = (length * ERROR).astype(np.int64)
        q = np.minimum(Q, length // (edits + 1))
        needed = length - q + 1 - q * edits
        tables = [Grams.of(x, np.flatnonzero(q == x).tolist(), codes, needed) for x in np.unique(q).tolist()]
        return cls(np.array(item, dtype=np.int64), codes, edits, needed, tables, np.array(source, dtype=np.int64), np.array(offset, dtype=np.int64), texts)

    def bands(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """(passage, lowest diagonal) of the bands that share enough q-grams with it."""
        return [x for grams in self.tables for x in self._bands(grams, codes)]

    def _bands(self, grams: Grams, codes: np.ndarray) -> list[tuple[int, int]]:
        h = gram_hashes(codes, grams.q)
        spot = np.flatnonzero(grams.table[h >> np.uint64(64 - _TABLE)])
        if len(spot) == 0 or (grams.least > 1 and len(spot) < grams.least):
            return []
        at = np.searchsorted(grams.grams, h[spot])
        at[at == len(grams.grams)] = 0
        same = grams.grams[at] == h[spot]
        spot, at = spot[same], at[same]
        times = grams.first[at + 1] - grams.first[at]
        each = np.repeat(grams.first[at] - np.cumsum(times) + times, times) + np.arange(times.sum())
        passage = grams.passage[each]
        diagonal = np.repeat(spot, times) - grams.place[each] + LONG
        band = diagonal // (self.edits[passage] + 1)
        wide = np.int64(1) << np.int64(32)
        key, n = np.unique(np.concatenate([passage * wide + band + 1, passage * wide + band]), return_counts=True)
        passage, band = np.divmod(key, wide)
        good = n >= self.needed[passage]
        if not good.any():
            return []
        # Of these, count the passage's own places, each once however often the text repeats its q-gram.
        wanted = key[good]
        own = np.concatenate([grams.passage[each] * wide + diagonal // (self.edits[grams.passage[each]] + 1) + x for x in (1, 0)])
        kept = np.isin(own, wanted)
        spots = np.concatenate([grams.place[each]] * 2)[kept]
        places_of = np.unique(np.searchsorted(wanted, own[kept]) * wide + spots) // wide
        n = np.bincount(places_of, minlength=len(wanted))
        passage, band = np.divmod(wanted[n >= self.needed[passage[good]]], wide)
        return [(p, (b - 1) * (self.edits[p] + 1) - LONG) for p, b in zip(passage.tolist(), band.tolist(), strict=True)]

    def find(self, codes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(passage, start, end, edits) of occurrences in codes, ends exclusive; one from each band, so some are found twice."""
        for p, low in self.bands(codes):
            pattern, width = self.codes[p], 2 * (int(self.edits[p]) + 1)
            hit = same(pattern, codes, int(low), width) or align(pattern, codes, int(low), width, int(self.edits[p]))
            if hit:
                yield p, *hit

    def span(self, parts: list[tuple[int, int, int, int]], codes: np.ndarray) -> tuple[int, int, int]:
        """(start, end, edits) of overlapping occurrences of one item's passages as one, edits counted once."""
        start, end, most = min(x[1] for x in parts), max(x[2] for x in parts), sum(x[3] for x in parts)
        if len(parts) == 1 or not most:
            return start, end, most
        a = min(int(self.offset[x[0]]) for x in parts)
        b = max(int(self.offset[x[0]]) + len(self.codes[x[0]]) for x in parts)
        pattern = self.texts[self.source[parts[0][0]]][a:b]
        row = _last_row(pattern, codes[start:end], -most, 2 * most + 1, most, True)
        return start, end, most if row is None else int(row.min())


def same(pattern: np.ndarray, text: np.ndarray, low: int, width: int) -> tuple[int, int, int] | None:
    """(start, end, 0) of pattern itself on diagonals low to low + width - 1."""
    for start in range(max(0, low), min(low + width, len(text) - len(pattern) + 1)):
        if text[start] == pattern[0] and np.array_equal(text[start : start + len(pattern)], pattern):
            return start, start + len(pattern), 0
    return None


def _last_row(pattern: np.ndarray, text: np.ndarray, low: int, width: int, budget: int, free: bool) -> np.ndarray | None:
    """Edits of pattern against text up to place len(pattern) + low + d, for each diagonal d; None once all exceed the budget.

    Places outside the text hold a character that equals none, which is as dear as leaving
    the pattern's character out.
    """
    m, slot = len(pattern), np.arange(width)
    held = np.full(m + width, 0xFFFFFFFF, dtype=np.uint32)
    a, b = max(0, low), min(len(text), low + m + width)
    if a < b:
        held[a - low : b - low] = text[a:b]
    other = (np.lib.stride_tricks.sliding_window_view(held, width)[:m] != pattern[:, None]).astype(np.int32)
    row = np.zeros(width, dtype=np.int32) if free else np.where(low + slot >= 0, low + slot, m + width).astype(np.int32)
    slot = slot.astype(np.int32)
    for i in range(m):
        step = row + other[i]
        np.minimum(step[:-1], row[1:] + 1, out=step[:-1])
        row = np.minimum.accumulate(step - slot) + slot
        if i % 8 == 7 and row.min() > budget:
            return None
    return row if row.min() <= budget else None


def align(pattern: np.ndarray, text: np.ndarray, low: int, width: int, budget: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the best occurrence of pattern on diagonals low to low + width - 1 within the budget."""
    row = _last_row(pattern, text, low, width, budget, True)
    if row is None:
        return None
    edits = int(row.min())
    end = min(max(0, len(pattern) + low + int(row.argmin())), len(text))
    # Backwards from the end, to find where it starts.
    a = max(0, end - len(pattern) - budget)
    back = _last_row(pattern[::-1], text[a:end][::-1], -budget, 2 * budget + 1, budget, False)
    start = end - (len(pattern) - budget + int(back.argmin())) if back is not None else end - len(pattern)
    return max(0, start), end, edits


def distinct(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of the (start, end, edits) of one passage, the best of those that cover each other by half."""
    kept: list[tuple[int, int, int]] = []  # by place
    for x in sorted(set(found), key=lambda x: (x[2], x[0], x[1])):
        i = bisect.bisect(kept, x)
        if not any(2 * (min(x[1], y[1]) - max(x[0], y[0])) > min(x[1] - x[0], y[1] - y[0]) for y in kept[max(0, i - 2) : i + 2]):
            kept.insert(i, x)
    return kept


def leaks_of(passages: Passages, text: str | None) -> list[tuple[int, int, int, int]]:
    """All occurrences of each item in a whole text: (item, start, end, edits), places in the text itself.

    Passages of a long item that overlap in the text and lie there as in the item, but for
    their edits, are one occurrence. A part of another occurrence of the item is none.
    """
    flat = normal(text)
    if not flat or not passages.codes:
        return []
    codes = codes_of(flat)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for a in range(0, len(codes), PIECE):
        for p, start, end, edits in passages.find(codes[a : a + PIECE + 2 * LONG]):
            found.setdefault(p, []).append((a + start, a + end, edits))
    if not found:
        return []
    sources: dict[int, list[tuple[int, int, int, int]]] = {}
    for p, hits in found.items():
        sources.setdefault(int(passages.source[p]), []).extend((p, *x) for x in distinct(hits))
    spans: dict[int, set[tuple[int, int, int]]] = {}
    for parts in sources.values():
        open_, chains = [], []  # chains that a later passage may go on, and all
        for x in sorted(parts, key=lambda x: (x[1], x[0])):
            open_ = [c for c in open_ if c[-1][2] > x[1]]
            for c in open_:
                p, start, _, _ = c[-1]
                drift = (x[1] - start) - int(passages.offset[x[0]] - passages.offset[p])
                if x[0] > p and abs(drift) <= passages.edits[p] + passages.edits[x[0]]:
                    c.append(x)
                    break
            else:
                chains.append([x])
                open_.append(chains[-1])
        spans.setdefault(int(passages.item[parts[0][0]]), set()).update(passages.span(c, codes) for c in chains)
    at = places(text)
    out = []
    for item, some in sorted(spans.items()):
        reach = -1
        for s, e, k in sorted(some, key=lambda x: (x[0], -x[1], x[2])):
            if e > reach:
                out.append((item, int(at[s]), int(at[e - 1]) + 1, k))
                reach = e
    return out


def _rounds(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items of the benchmark, in rounds of about ROUND characters."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("t")).where("item_id is not null and t is not null").distinct()
    step = PART - 2 * LONG
    last = F.greatest(F.lit(0), F.ceil((F.length("t") - PART) / step)).cast("int")
    parts = items.select("item_id", "t", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    parts = parts.select("item_id", "part", F.substring(F.col("t"), F.col("part") * step + 1, F.lit(PART)).alias("t"))
    total = parts.agg(F.sum(F.length("t") + 1)).first()[0] or 0
    rounds = max(1, -(-total // ROUND))
    for r in range(rounds):
        yield [(x.item_id, x.t) for x in parts.where(F.pmod(F.xxhash64("item_id", "part"), F.lit(rounds)) == r).collect()]  # about ROUND characters


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", out: str = "leaks") -> DataFrame:
    """docs with the benchmark items that each whole text holds, as an array of (item_id, start, end, edits).

    benchmark: item_id and text. Case and runs of white space make no difference. An item of
    up to LONG characters is found as a whole, a longer one by any of its passages, with up
    to one edit in ten characters, rounded down, and every occurrence is given; an item of
    fewer than ten characters is found where it stands exactly, within words too. Items
    without a character and null texts take no part. Repeated items count as one, repeated
    rows of docs stay, a column of the name `out` is replaced and all others stay, whatever
    their names. Null and empty texts hold nothing; empty tables give empty or unmarked ones.

    The benchmark is broadcast in rounds of about ROUND characters, each one pass over docs;
    between rounds the marked rows are written out, so that one round is held at a time.
    """
    spark = docs.sparkSession
    marked = docs.drop(out).withColumn(out, F.array().cast(LEAKS))
    (found_,) = fresh(marked.columns, "found")
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
    width = T.StructType([*marked.schema.fields, T.StructField(found_, T.StructType.fromDDL(f"x {LEAKS}")["x"].dataType)])
    texts, before = marked.columns.index(text), None
    for r, items in enumerate(_rounds(benchmark)):
        if r:
            table = stage_table(marked, "marked")
            shared.unpersist()
            if before is not None:
                discard(before)
            marked = before = table
        shared = spark.sparkContext.broadcast(Passages.of(items))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [leaks_of(shared.value, t) for t in batch.column(texts).to_pylist()]
                found = pa.array([[{"item_id": i, "start": s, "end": e, "edits": k} for i, s, e, k in m] for m in made], kind)
                yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, found_])

        marked = marked.mapInArrow(run, width).withColumn(out, F.concat(out, found_)).drop(found_)
    return marked
