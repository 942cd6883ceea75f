"""SimHash near-duplicates by covering locality-sensitive hashing.

A covering family gives each bit of the fingerprint a vector of radius + 1 bits, and has a
mask for each non-zero vector v: the bits whose vector has an odd product with v. The
vectors of any `radius` bits are orthogonal to a common v, so fingerprints that differ in
that many bits or fewer agree under some mask: no pair within the radius is missed. The
same construction on the bits that a mask leaves free bounds what can share a bucket.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bookweave.operators.components import connected_components
from bookweave.llm.columns import fresh
from bookweave.plans.scratch import discard, stage_table

BITS = 64
#: Words of a text whose shingles are hashed at once.
PIECE_WORDS = 1 << 16


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """Masks over the given bit places such that any `radius` of these are all outside some mask."""
    vectors = (1 << (radius + 1)) - 1
    return [sum(1 << b for i, b in enumerate(bits) if ((i % vectors + 1) & v).bit_count() & 1) for v in range(1, vectors + 1)]


def composed_masks(radius: int, levels: int, bits: int = BITS) -> list[int]:
    """Covering masks of a fingerprint of so many bits, applied again to what each leaves free."""
    masks = [0]
    for _ in range(levels):
        masks = [m | x for m in masks for x in covering_masks([b for b in range(bits) if not m >> b & 1], radius)]
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 with seed 42 of each run of `size` words joined by spaces, repeats included; of the whole sequence where it is shorter."""
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], dtype=np.uint64)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.array([digest(text[a:b], 42) for a, b in spans], dtype=np.uint64)


def majority(ones: np.ndarray, total: int) -> int:
    """The fingerprint whose bits are those set in over half of total hashes."""
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def _ones(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(BITS, dtype=np.int64)
    for a in range(0, len(hashes), 4096):
        out += np.unpackbits(hashes[a : a + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return out


def shingle_fingerprint(text: str | None, size: int) -> list[int]:
    """The fingerprint of all word shingles of a text; zero where it has no word."""
    words = words_of(text)
    ones, total = np.zeros(BITS, dtype=np.int64), 0
    for a in range(0, max(1, len(words) - size + 1), PIECE_WORDS):
        hashes = shingle_hashes(words[a : a + PIECE_WORDS + size - 1], size)
        ones, total = ones + _ones(hashes), total + len(hashes)
    return [majority(ones, total)]


def fingerprints(docs: DataFrame, make: Callable[[str | None], list[int]], row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row_id and fps, array<long>, one row per row of docs, of whole texts. A null text counts as empty."""
    rows = docs.select(F.col(row_id).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [[_signed(x) for x in make(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["id", "fps"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, fps array<long>").withColumnRenamed("id", row_id)


def _forests(radius: int, large: int):
    """Streams rows (t, key, fp, id) sorted by bucket; gives (a, b, t, key).

    a, b: each id of a bucket and the smallest id that it reaches in the bucket by links
    within the radius, so a bucket of n ids gives at most n - 1 rows. A bucket of more than
    `large` rows gives no pair but one row of its t and key.
    """

    def edges(t: np.ndarray, key: np.ndarray, fp: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (key[1:] != key[:-1])])
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        keep = np.flatnonzero(size[group] > 1)
        group, fp, ids = group[keep], fp[keep], ids[keep]
        a, b = [], []
        live, d = np.arange(len(group)), 1
        while True:
            live = live[live + d < len(group)]
            live = live[group[live] == group[live + d]]
            if not len(live):
                break
            near = live[np.bitwise_count(fp[live] ^ fp[live + d]) <= radius]
            a.append(near)
            b.append(near + d)
            d += 1
        if not a:
            return ids[:0], ids[:0]
        a, b = np.concatenate(a), np.concatenate(b)
        order = np.argsort(ids, kind="stable")
        label = np.empty(len(ids), dtype=np.int64)
        label[order] = np.arange(len(ids))
        while True:
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = np.minimum(label, label[order[label]])
            if (label == before).all():
                break
        root = ids[order[label]]
        moved = np.flatnonzero(root != ids)
        return ids[moved], root[moved]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last bucket, which may go on
        over = None  # a bucket that is known to be too large

        def out(a, b, t, key) -> pa.RecordBatch:
            n = max(len(a), len(t))
            none = pa.nulls(n, pa.int64())
            pair = (pa.array(a), pa.array(b)) if len(a) else (none, none)
            mark = (pa.array(t), pa.array(key)) if len(t) else (none, none)
            return pa.RecordBatch.from_arrays([*pair, *mark], names=["a", "b", "t", "key"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy() for i in range(4)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            t, key = now[0], now[1]
            last = len(t) - np.argmax(((t != t[-1]) | (key != key[-1]))[::-1]) if (t[0] != t[-1] or key[0] != key[-1]) else 0
            done, held = [x[:last] for x in now], [x[last:] for x in now]
            if last:
                starts = np.flatnonzero(np.concatenate([[True], (done[0][1:] != done[0][:-1]) | (done[1][1:] != done[1][:-1])]))
                sizes = np.diff(np.append(starts, last))
                if over is not None and (done[0][0], done[1][0]) == over:
                    sizes[0] = large + 1
                big = sizes > large
                if big.any():
                    s = starts[big]
                    yield out([], [], done[0][s], done[1][s])
                    fit = np.repeat(~big, sizes if over is None or (done[0][0], done[1][0]) != over else np.diff(np.append(starts, last)))
                    done = [x[fit] for x in done]
                over = None
                if len(done[0]):
                    a, b = edges(*done)
                    if len(a):
                        yield out(a, b, [], [])
            if len(held[0]) > large:  # a row of it is enough to mark it
                over = (held[0][0], held[1][0])
                held = [x[:1] for x in held]
        if held is not None and len(held[0]):
            if over is not None:
                yield out([], [], held[0][:1], held[1][:1])
            else:
                a, b = edges(*held)
                if len(a):
                    yield out(a, b, [], [])

    return run


def _buckets(rows: DataFrame, masks: list[int], radius: int, large: int) -> DataFrame:
    table = lambda i: (F.col("copy") * len(masks) + i).cast("long")
    pairs = F.array(*(F.struct(table(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)))
    dealt = rows.select(F.explode(pairs).alias("x"), "fp", "id").select("x.t", "x.key", "fp", "id")
    dealt = dealt.repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    return dealt.mapInArrow(_forests(radius, large), "a long, b long, t long, key long")


def links(rows: DataFrame, radius: int, levels: int = 2, large: int = 1 << 15, bits: int = BITS) -> DataFrame:
    """Links (a, b) that connect whatever fingerprints within the radius connect, far fewer than the pairs.

    rows: id long, fp long of so many bits and copy int, none null; an id may have a
    fingerprint in each of several copies, which are independent of each other. Rows of
    equal fingerprint are linked to the smallest id among them and then stand for one.
    Within each bucket every id is linked to the smallest id it reaches there, so links
    grow with rows and tables and not with pairs. `levels` composed coverings leave few
    bits free, so that a bucket is small by construction (at 64 bits, radius 2 and two
    levels: 12 bits, 4,096 fingerprints); a bucket over `large` is dealt out again under
    one more level.
    """
    same = rows.groupBy("copy", "fp").agg(F.min("id").alias("first"))
    equal = rows.join(same, ["copy", "fp"]).where("id > first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    heads = stage_table(same.select(F.col("first").alias("id"), "fp", "copy"), "fingerprints")
    masks = composed_masks(radius, levels, bits)
    found = stage_table(_buckets(heads, masks, radius, large), "links")
    marked = found.where("t is not null").select("t", "key").distinct()
    pairs = found.where("a is not null").select("a", "b")
    if marked.limit(1).count():
        fixed = F.element_at(F.array(*(F.lit(_signed(m)) for m in masks)), F.col("i").cast("int") + 1)
        spread = heads.select("id", "fp", "copy", F.explode(F.sequence(F.lit(0), F.lit(len(masks) - 1))).alias("i"))
        spread = spread.select("id", "fp", "copy", (F.col("copy") * len(masks) + F.col("i")).cast("long").alias("t"), F.col("fp").bitwiseAND(fixed).alias("key"))
        again = spread.join(marked, ["t", "key"], "left_semi").select("id", "fp", "copy").distinct()
        deeper = _buckets(again, composed_masks(radius, levels + 1, bits), radius, 1 << 62)
        pairs = pairs.unionByName(stage_table(deeper.where("a is not null").select("a", "b"), "links"))
    return equal.unionByName(pairs).distinct()


def near_groups(docs: DataFrame, shingle_words: int = 3, radius: int = 2, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row_id, fp (long) and component_id for every row of docs.

    Documents link where their fingerprints differ in `radius` bits or fewer; component_id
    is the smallest row_id a document reaches, itself included. Every row is returned,
    repeated rows too; null and empty texts have fingerprint zero and link like others. A
    row without row_id keeps its fingerprint and takes its group's component_id. Other
    columns are left out. No rows give no rows.
    """
    fps = fingerprints(docs, lambda t: shingle_fingerprint(t, shingle_words), row_id, text)
    fps = stage_table(fps.select(row_id, F.col("fps")[0].alias("fp")), "simhash")
    heads = fps.groupBy("fp").agg(F.min(row_id).alias("head"))
    nodes = heads.select(F.col("fp").alias("id"), "fp", F.lit(0).alias("copy"))
    groups = connected_components(links(nodes, radius))
    placed = heads.join(groups.select(F.col("node").alias("fp"), F.col("component").alias("c")), "fp", "left")
    placed = placed.withColumn("c", F.coalesce("c", "fp"))
    first = placed.groupBy("c").agg(F.min("head").alias("component_id"))
    placed = stage_table(placed.join(first, "c").select("fp", "component_id"), "groups")
    return fps.join(placed, "fp").select(row_id, "fp", "component_id")


def hex16(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


#: For SimHash of near duplicates: the words of a shingle, the bits in which fingerprints that
#: link differ at most, and the levels of the covering (15 tables). Distinct single words are
#: taken, as few edits change many longer shingles: of texts 0.8 alike by five words half
#: differ in 3 of 64 bits or fewer by words, and in 8 or 9 by five words. They set what
#: SimHash leaves to the prefix filter and so the cost, never the result.
SIMHASH_WORDS, SIMHASH_RADIUS, SIMHASH_LEVELS = 1, 3, 1
#: For near duplicates by shingle sets: texts sampled to tell common shingles, the count
#: there that makes one common, and the most of them that are broadcast. They set the order
#: of shingles and so the cost, never the result.
SAMPLE, COMMON_LEAST, COMMON_MOST = 20_000, 3, 100_000
#: How many times as many texts of a bucket are compared in a round as in the one before,
#: and the comparisons left, by row of all buckets, that are made in one round. They set
#: the rounds and so the cost, never the result.
GROWTH, LAST_ROUND = 8, 4
_EPS = 1e-6
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Parts that hashes are dealt to, whose counts bound what two sets share.
PARTS = 256
#: Pairs whose whole texts go to Python at once.
PAIR_BATCH = 50
#: Pairs whose ids are broadcast, of 16 bytes each.
FEW_PAIRS = 1 << 17
_SUMS = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Distinct hashes of the word shingles of a text."""
    return np.unique(shingle_hashes(words_of(text), size))


def set_fingerprint(text: str | None, size: int) -> list[int]:
    """The fingerprint of the distinct word shingles of a text; zero where it has no word."""
    hashes = shingle_set(text, size)
    return [majority(_ones(hashes), len(hashes))]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Shared over all distinct shingles; 1 for two texts that have none."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - both
    return both / total if total else 1.0


def common_shingles(docs: DataFrame, size: int, texts: int, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of the shingles that are common in a sample of so many distinct texts, and the place of each by frequency."""
    some = docs.select(F.coalesce(text, F.lit("")).alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(max(1, texts // SAMPLE))) == 0).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, size).view(np.int64) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))], names=["h"])

    counts = some.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= COMMON_LEAST)
    rows = counts.orderBy(F.desc("count"), "h").limit(COMMON_MOST).collect()
    hashes = np.array([r.h for r in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], len(rows) - order


def prefix(text: str | None, size: int, least: float, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, int]:
    """The first shingles of a text's set, common ones last, that no set `least` alike or more can do without, and the size of the set.

    A text without a word has one shingle of its own kind and a set of size 0.
    """
    s = shingle_set(text, size)
    if not len(s):
        return np.zeros(1, np.uint64), 0
    if len(common[0]):
        at = np.searchsorted(common[0], s)
        at[at == len(common[0])] = 0
        s = s[np.argsort(np.where(common[0][at] == s, common[1][at], 0), kind="stable")]
    return s[: len(s) - math.ceil(least * len(s) - _EPS) + 1], len(s)


def _prefixes(size: int, least: float, shared):
    """(key, id, size, place) of texts with their ids; of the equal texts of a batch one is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, one = np.unique(batch.column(0).to_numpy(), return_index=True)
            made = [prefix(t, size, least, shared.value) for t in batch.column(1).take(pa.array(one)).to_pylist()]
            n = [len(k) for k, _ in made]
            keys = np.concatenate([k for k, _ in made]) if made else np.zeros(0, np.uint64)
            place = np.concatenate([np.arange(x, dtype=np.int32) for x in n]) if made else np.zeros(0, np.int32)
            columns = [keys.view(np.int64), np.repeat(ids, n), np.repeat(np.array([x for _, x in made], dtype=np.int32), n), place]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "id", "size", "place"])

    return run


def _fits(size_a, place_a, size_b, place_b, least: float, low, high):
    """Whether sets of these sizes can be `least` alike where these places hold the first shingle they share."""
    alike = low(size_a, size_b) >= least * high(size_a, size_b) - _EPS
    return alike & (low(size_a - place_a, size_b - place_b) >= least / (1 + least) * (size_a + size_b) - _EPS)


def _collisions(least: float):
    """Streams rows (key, id, size, place) sorted by key and id; gives those of buckets that can hold a near pair.

    Of a near pair, the smaller set has the first shared shingle early: at a place where
    2 * least / (1 + least) of it is still to come. Such rows are `early`. The first early
    row of a bucket is its head, `fits` marks the rows that may be near it, and `more`
    those of buckets of three rows or more, whose other pairs are still to be compared.
    s1 and s2 are sums of hashes over the bucket's ids, and first is the place in its first
    row, which the bucket's first row here gives.
    """
    names = ["key", "id", "size", "place", "early", "head", "fits", "more", "s1", "s2", "first"]

    def settle(key, ids, size, place) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.append(starts, len(key)))
        early = (size - place) * (1 + least) >= 2 * least * size - _EPS
        head = np.minimum.reduceat(np.where(early, np.arange(len(key)), len(key)), starts)
        live = np.repeat((n > 1) & (head < len(key)), n)
        x = ids.view(np.uint64)
        sums = [np.repeat(np.add.reduceat((x ^ (x >> np.uint64(31))) * np.uint64(a) ^ (x * np.uint64(b) >> np.uint64(29)), starts), n)[live].view(np.int64) for a, b in _SUMS]
        front = np.repeat(place[starts], n)[live]
        head, n = np.repeat(head, n)[live], np.repeat(n, n)[live]
        fits = _fits(size[live], place[live], size[head], place[head], least, np.minimum, np.maximum) & (np.flatnonzero(live) != head)
        keep = fits | (n > 2)
        columns = [x[keep] for x in (key[live], ids[live], size[live], place[live], early[live], ids[head], fits, n > 2, *sums)]
        again = np.zeros(len(columns[0]), dtype=bool)
        again[1:] = columns[0][1:] == columns[0][:-1]
        return pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), pa.array(front[keep], mask=again)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # rows of the last bucket, which may go on
        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(4)]
            # Equal texts of several batches come once each; one row of them stays.
            new = np.ones(len(now[0]), dtype=bool)
            new[1:] = (now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])
            if held and len(new):
                new[0] = held[-1][0][-1] != now[0][0] or held[-1][1][-1] != now[1][0]
            if not new.any():
                continue
            now = [x[new] for x in now]
            key = now[0]
            if key[0] == key[-1] and held and held[-1][0][-1] == key[0]:
                held.append(now)
                continue
            now = [np.concatenate(x) for x in zip(*held, now, strict=True)]
            last = np.searchsorted(now[0], now[0][-1])
            if last:
                yield settle(*(x[:last] for x in now))
            held = [[x[last:] for x in now]]
        if held:
            yield settle(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _with_counts(size: int):
    """(id, text, counts) of (id, text): how many hashes of the set are in each part, as 2-byte numbers; empty if one does not fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for t in batch.column(1).to_pylist():
                n = np.bincount((shingle_set(t, size) % np.uint64(PARTS)).astype(np.int64), minlength=PARTS)
                made.append(n.astype("<u2").tobytes() if n.max() < 1 << 16 else b"")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], names=["id", "text", "counts"])

    return run


def _possible(least: float):
    """(a, b) of the pairs that can be alike by their counts: sets share no more of a part than the smaller count, so none that is alike goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.ones(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if x and y:
                    x, y = np.frombuffer(x, "<u2").astype(np.int64), np.frombuffer(y, "<u2").astype(np.int64)
                    good[i] = np.minimum(x, y).sum() * (1 + least) >= least * (x.sum() + y.sum()) - _EPS
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["a", "b"])

    return run


def _of(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """The rows of table with an id of the pairs, without a shuffle of table, where the pairs are few; else table."""
    if pairs.limit(FEW_PAIRS + 1).count() > FEW_PAIRS:
        return table
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    return table.join(F.broadcast(ids), "id", "left_semi")


def _simhash_pairs(texts: DataFrame) -> DataFrame:
    """(a, b), staged: the texts that SimHash links, at most one pair a text and table.

    texts: id, the same for equal texts, and text.
    """
    fps = fingerprints(texts, lambda t: set_fingerprint(t, SIMHASH_WORDS), "id")
    fps = stage_table(fps.select("id", F.col("fps")[0].alias("fp"), F.lit(0).alias("copy")).distinct(), "simhash")
    found = links(fps, SIMHASH_RADIUS, SIMHASH_LEVELS)
    pairs = stage_table(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    discard(fps)
    return pairs


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs that groups do not join."""
    of = lambda side: groups.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    named = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return named.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches to Python of so many rows, for what is run inside."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH)
        else:
            spark.conf.set(_BATCH, before)


def _next_pivots(left: DataFrame, groups: DataFrame, most: int) -> DataFrame:
    """left with each row's group c, and turn: whether it is compared with its bucket next.

    Buckets in one group, or whose early rows have all had their turn, go. In a bucket the
    rows of its largest group come first, as the text that the others were made from is
    often in it.
    """
    named = left.join(groups.select(F.col("node").alias("id"), "component"), "id", "left")
    named = named.withColumn("c", F.coalesce("component", "id")).drop("component")
    bucket = Window.partitionBy("key")
    free = F.col("early") & ~F.col("used")
    named = named.withColumns({"low": F.min("c").over(bucket), "high": F.max("c").over(bucket), "open": F.max(free).over(bucket)}).where("low < high and open")
    named = named.withColumn("n", F.count("*").over(Window.partitionBy("key", "c")))
    turn = free & (F.row_number().over(bucket.orderBy(free.desc(), F.desc("n"), "id")) <= most)
    return named.withColumn("turn", turn).select("key", "id", "size", "place", "early", "used", "c", "turn")


def _compared(rows: DataFrame, least: float) -> DataFrame:
    """(a, b) of the rows whose turn it is and the rows of other groups in their buckets that had none yet."""
    p = rows.where("turn").select("key", *(F.col(c).alias(f"p_{c}") for c in ("id", "size", "place", "c")))
    q = rows.where("not used").select("key", "id", "size", "place", "c", "turn")
    near = _fits(F.col("p_size"), F.col("p_place"), F.col("size"), F.col("place"), least, F.least, F.greatest)
    both = p.join(q, "key").where((F.col("c") != F.col("p_c")) & (~F.col("turn") | (F.col("p_id") < F.col("id"))) & near)
    return both.select(F.least("id", "p_id").alias("a"), F.greatest("id", "p_id").alias("b")).distinct()


def _merged(groups: DataFrame | None, found: DataFrame) -> DataFrame:
    """(node, component), staged: groups with the groups that the found edges join made one.

    Only edges between different groups go on, so a round costs by what it found. The
    component is the smallest node still, as every group is named by its smallest.
    """
    if groups is None:
        return stage_table(connected_components(found), "groups")
    named = groups.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    apart = found.join(named, "a", "left").join(named.toDF("b", "cb"), "b", "left")
    joined = connected_components(apart.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    renamed = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = groups.join(renamed, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return stage_table(old.unionByName(joined.join(groups, "node", "left_anti")), "groups")


def _verified(size: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kept = None, None  # neighbouring rows often share their second text
        for batch in batches:
            good = np.zeros(batch.num_rows, dtype=bool)
            b = batch.column(1).to_pylist()
            for i in range(batch.num_rows):
                if known != b[i]:
                    known, kept = b[i], shingle_set(batch.column(3)[i].as_py(), size)
                good[i] = jaccard(shingle_set(batch.column(2)[i].as_py(), size), kept) >= least
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), batch.column(1).filter(pa.array(good))], names=["a", "b"])

    return run


def _alike(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """(a, b), staged, of the pairs whose sets are `least` alike; their counts tell which pairs' texts are read."""
    some = _of(pairs, texts.select("id", "counts"))
    both = pairs.join(some.toDF("a", "x"), "a").join(some.toDF("b", "y"), "b").select("a", "b", "x", "y")
    near = stage_table(both.mapInArrow(_possible(least), "a long, b long"), "candidates")
    some = _of(near, texts.select("id", "text"))
    both = near.join(some.toDF("a", "text_a"), "a").join(some.toDF("b", "text_b"), "b")
    with batches_of(pairs.sparkSession, PAIR_BATCH):
        found = stage_table(both.select("a", "b", "text_a", "text_b").mapInArrow(_verified(size, least), "a long, b long"), "edges")
    discard(near)
    return found


def near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_id, text_key, group, group_key) of the rows of docs that have a row_id: near duplicates by the Jaccard similarity of word shingle sets.

    Equal texts are one node, named by their smallest row_id. SimHash with covering masks
    links texts by the fingerprints of their words, and each link is checked by the sets. An
    exact prefix filter finds the pairs beyond its radius: two sets of shingles that are
    `similarity` alike share one of the first of each in any fixed order, about a fifth of
    a set at 0.8, so texts meet in buckets by these, and no pair is missed whatever it
    differs in. Only texts that are still in different groups are compared there: in each
    bucket one with the others; then, in rounds, GROWTH times as many, until every pair of
    a bucket is compared or joined over others.

    A pair counts where the shingle sets are `similarity` alike or more, whichever way it was
    found. group is the smallest row_id that is reached over such links, and group_key the
    text_key of its row, the smallest where that row_id has several texts in the group: both
    name a group, as unlike texts of one row_id are groups of their own.

    text_key is the SHA-256 of the text; null and empty texts are equal texts. Rows of one
    row_id and several texts belong to each text's group. Other columns are left out.
    Shingles count once; a text of fewer than shingle_words words is one shingle.
    """
    rows = docs.where(F.col(row_id).isNotNull()).select(F.col(row_id).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    keyed = rows.withColumn("text_key", F.sha2("text", 256))
    first = keyed.groupBy("text_key").agg(F.min("id").alias("head"))
    members = stage_table(keyed.select("id", "text_key").join(first, "text_key"), "members")
    node = F.xxhash64("text_key")  # a text's number; texts of one row_id stay apart
    alike = _simhash_pairs(keyed.select(node.alias("id"), "text"))
    common = common_shingles(docs.where(F.col(row_id).isNotNull()), shingle_words, members.where("id = head").count(), text)
    shared = docs.sparkSession.sparkContext.broadcast(common)
    # The texts themselves are not shuffled: equal ones are told by their number.
    dealt = keyed.select(node.alias("id"), "text").mapInArrow(_prefixes(shingle_words, similarity, shared), "key long, id long, size int, place int")
    dealt = dealt.repartition("key").sortWithinPartitions("key", "id")
    met = dealt.mapInArrow(_collisions(similarity), "key long, id long, size int, place int, early boolean, head long, fits boolean, more boolean, s1 long, s2 long, first int")
    all_met = stage_table(met, "buckets")
    # Of buckets of the same texts the one with the earliest shingle has all that the others can tell.
    leading = all_met.where("first is not null").groupBy("s1", "s2").agg(F.min(F.struct("first", "key"))["key"].alias("key"))
    met = stage_table(all_met.join(leading.select("key"), "key", "left_semi").drop("s1", "s2", "first"), "buckets")
    discard(all_met)
    involved = met.select("id").unionByName(met.select(F.col("head").alias("id")))
    involved = involved.unionByName(alike.select(F.col("a").alias("id"))).unionByName(alike.select(F.col("b").alias("id"))).distinct()
    heads = members.where("id = head").select(F.col("id").alias("doc"), node.alias("id")).distinct().join(involved, "id")
    texts = keyed.select(F.col("id").alias("doc"), node.alias("node"), "text").join(heads, "doc").where("node = id")
    texts = texts.dropDuplicates(["doc", "id"]).select("id", "text")
    texts = stage_table(texts.mapInArrow(_with_counts(shingle_words), "id long, text string, counts binary"), "texts")
    found = _alike(alike, texts, shingle_words, similarity)
    groups, compared = _merged(None, found), alike
    discard(found)
    pairs = met.where("fits").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()
    pairs = _apart(pairs, groups).join(compared, ["a", "b"], "left_anti")
    left = met.where("more").select("key", "id", "size", "place", "early", (F.col("id") == F.col("head")).alias("used"))
    most, now_before = 1, None
    last = LAST_ROUND * met.count()
    while True:
        pairs = stage_table(pairs, "candidates")
        compared = compared.unionByName(pairs)
        found = _alike(pairs, texts, shingle_words, similarity)
        if found.limit(1).count():
            before, groups = groups, _merged(groups, found)
            discard(before)
        discard(found)
        sizes = left.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("early") & ~F.col("used")).alias("free"))
        work = sizes.agg(F.sum(F.col("n") * F.col("free"))).first()[0] or 0
        most = GROWTH * most if work > last else (1 << 31) - 1
        now = stage_table(_next_pivots(left, groups, most), "buckets")
        discard(now_before if now_before is not None else met)
        now_before = now
        if not now.limit(1).count():
            break
        pairs = _compared(now, similarity).join(compared, ["a", "b"], "left_anti")
        left = now.select("key", "id", "size", "place", "early", (F.col("used") | F.col("turn")).alias("used"))
    named = members.select("text_key", "head").distinct().select("text_key", "head", node.alias("node"))
    named = named.join(groups, "node", "left").withColumn("c", F.coalesce("component", "node"))
    smallest = named.groupBy("c").agg(F.min(F.struct("head", "text_key")).alias("x")).select("c", F.col("x.head").alias("group"), F.col("x.text_key").alias("group_key"))
    named = stage_table(named.join(smallest, "c").select("text_key", "group", "group_key"), "groups")
    discard(texts, groups)
    return members.join(named, "text_key").select(F.col("id").alias(row_id), "text_key", "group", "group_key")


def keep_one(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of near duplicates: that of the smallest row_id, of repeated rows one.

    Unlike texts of one row_id are groups of their own, so each of them stays. Rows without
    a row_id stay, as no group can name them. All columns stay.
    """
    groups = near_duplicates(docs, shingle_words, similarity, row_id, text)
    id_, key_ = fresh(docs.columns, "id", "key")
    kept = groups.where((F.col(row_id) == F.col("group")) & (F.col("text_key") == F.col("group_key"))).select(F.col("group").alias(id_), F.col("text_key").alias(key_)).distinct()
    keyed = docs.withColumns({id_: F.col(row_id).cast("long"), key_: F.sha2(F.coalesce(text, F.lit("")), 256)})
    out = keyed.join(kept, [id_, key_], "left_semi").dropDuplicates([id_, key_])
    return out.unionByName(keyed.where(F.col(id_).isNull())).drop(id_, key_).select(*(F.col(f"`{c}`") for c in docs.columns))
