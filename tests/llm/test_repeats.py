import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from bookweave.llm import repeats


def brute(rows, split, length):
    """Per row: its symbols and the places covered by a window that starts in a row of smaller id."""
    parts = [(i, split(t or "")) for i, t in rows]
    first = {}
    for i, p in parts:
        if i is not None:
            for a in range(len(p) - length + 1):
                w = tuple(p[a : a + length])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, p in parts:
        gone = set()
        for a in range(len(p) - length + 1):
            if i is not None and first[tuple(p[a : a + length])] < i:
                gone.update(range(a, a + length))
        out.append((i, p, gone))
    return out


def corpus(seed, words=False):
    rng = random.Random(seed)
    vocab = ["the", "of", "an", "thing", "é", "漢", "ab.c", "x"]

    def prose(n):
        return "".join(rng.choice(vocab) + rng.choice([" ", " ", "\n", "  "]) for _ in range(n))

    shared = [prose(40) for _ in range(5)]
    rows = []
    for i in range(60):
        t = prose(rng.randint(0, 60)) + rng.choice(shared)[rng.randint(0, 30) :] + prose(rng.randint(0, 30))
        if rng.random() < 0.3:
            t += rng.choice(shared) + prose(3) + rng.choice(shared)
        if rng.random() < 0.15 and rows:
            t = rng.choice(rows)[1]
        rows.append((i, t))
    rows += [(100, "a" * 700), (101, "b" + "a" * 300), (102, "w " * 200), (103, "w " * 100 + "z"), (104, None), (105, ""), (106, "short"), (None, rows[3][1]), (7, rows[7][1]), (107, rows[7][1]), (-5, rows[9][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [256, 2])
@pytest.mark.parametrize("kind", ["words", "bytes"])
def test_equal_to_brute_force(spark, monkeypatch, kind, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    if hot == 2:
        monkeypatch.setattr(repeats, "PIECE", 64)
        monkeypatch.setattr(repeats, "CARRY", 3)
        monkeypatch.setattr(repeats, "BATCH_BYTES", 500)
    rows = corpus(5)
    symbols = repeats.Words(13) if kind == "words" else repeats.Bytes(50)
    split = (lambda t: t.encode().split()) if kind == "words" else (lambda t: list(t.encode()))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kept": F.lit("x"), "doc": F.lit(1), "spans": F.lit(2), "rid": F.lit(3), "_doc": F.lit(4), "_SPANS": F.lit(5)})
    got = sorted(((r.doc_id, r.text, r.n_symbols, [tuple(x) for x in r.removed], bytes(r.kept)) for r in repeats.remove_repeats(df, symbols).collect()), key=str)
    want = []
    for (i, t), (_, p, gone) in zip(rows, brute(rows, split, symbols.length), strict=True):
        left = [x for k, x in enumerate(p) if k not in gone]
        spans = repeats.merge([(k, k + 1) for k in gone])
        want.append((i, t, len(p), spans, b" ".join(left) if kind == "words" else bytes(left)))
    assert got == sorted(want, key=str)
    assert any(w[3] for w in want)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(df, repeats.Words()).count() == 0
    assert repeats.remove_repeats(df, repeats.Bytes()).count() == 0


def test_matching_statistics():
    rng = random.Random(2)
    for _ in range(40):
        automaton = repeats.SuffixAutomaton()
        known = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 20))] for _ in range(3)]
        for k in known:
            automaton.add(k)
        text = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(30)]
        inside = {tuple(k[a:b]) for k in known for a in range(len(k)) for b in range(a + 1, len(k) + 1)}
        for i, n in enumerate(automaton.matches(text)):
            assert n == max(m for m in range(i + 2) if m == 0 or tuple(text[i + 1 - m : i + 1]) in inside)


def test_refinement_gives_equal_numbers_to_equal_windows():
    rng = np.random.default_rng(4)
    solver = repeats.Bytes(50)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    text[1000:1400] = text[200:600]
    text[2000:2300] = 97
    at = np.arange(len(text) - 50)
    for slice_size in (1, 100, 1 << 16):
        array = solver.suffixes(text, slice_size)
        windows = [text[i : i + 50].tobytes() for i in array]
        assert windows == sorted(windows) and sorted(array.tolist()) == list(range(len(text)))
        got = solver.classes(text, array, at)
        seen = {}
        for i, g in zip(at.tolist(), got.tolist(), strict=True):
            w = text[i : i + 50].tobytes()
            assert seen.setdefault(w, g) == g
        assert len(set(seen.values())) == len(seen)


def test_every_window_is_in_one_run_and_equal_windows_share_an_anchor(monkeypatch):
    texts = ["a b c d e " * 30 + "f g " * 40, "", "xy", "abcde " * 60 + "x" * 200 + " é漢 " * 30, "ab" * 300 + " q" * 90, "a b c d e " * 20]
    for piece in (1 << 18, 64):
        monkeypatch.setattr(repeats, "PIECE", piece)
        for symbols, split in ((repeats.Words(13), lambda t: t.encode().split()), (repeats.Bytes(50), lambda t: list(t.encode()))):
            parts = [split(t) for t in texts]
            anchors, seen = {}, set()
            for slab, runs, c in symbols.read(pa.array(["before", *texts])[1:]):
                passages = symbols.passages(slab, runs.first, runs.n + symbols.length - 1).to_pylist()
                for row, s, n, at, a, passage in zip(runs.row.tolist(), runs.start.tolist(), runs.n.tolist(), (runs.place - runs.first).tolist(), runs.anchor.tolist(), passages, strict=True):
                    own = parts[row][s : s + n + symbols.length - 1]
                    assert passage == (b" ".join(own) if isinstance(symbols, repeats.Words) else bytes(own)) and symbols.count_in(passage) == len(own)
                    for w in range(s, s + n):
                        assert (row, w) not in seen
                        seen.add((row, w))
                        key = tuple(parts[row][w : w + symbols.length])
                        assert anchors.setdefault(key, (a, at - (w - s))) == (a, at - (w - s))
            assert len(seen) == sum(max(0, len(p) - symbols.length + 1) for p in parts)


def test_two_documents_of_one_line(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 50)
    line = "this is one line of twenty words that two long documents hold again and again with a number after it "
    rows = [(i, "".join(f"{line}{x}\n" for x in range(i, 2001, i))) for i in (2, 1)]
    for symbols in (repeats.Words(13), repeats.Bytes(50)):
        got = {r.doc_id: r for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), symbols).collect()}
        assert not got[1].removed and sum(x.end - x.start for x in got[2].removed) > 0.9 * got[2].n_symbols
        split = (lambda t: t.encode().split()) if isinstance(symbols, repeats.Words) else (lambda t: list(t.encode()))
        want = {i: gone for i, _, gone in brute(rows, split, symbols.length)}
        assert [tuple(x) for x in got[2].removed] == repeats.merge([(k, k + 1) for k in want[2]])
