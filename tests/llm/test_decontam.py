import random

import numpy as np
from pyspark.sql import functions as F

from bookweave.llm import decontam


def distance(pattern, text):
    """Fewest edits of pattern against any part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "the", "ing", "re", "st", "ou", "ti"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def edited(rng, text, edits):
    for _ in range(edits):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + "x" + text[i:], text[:i] + "y" + text[i + 1 :]])
    return text


def test_alignment_equals_full_table():
    rng = random.Random(5)
    for _ in range(60):
        pattern = prose(rng, 6)[:60]
        k = len(pattern) // 10
        inner = edited(rng, pattern, rng.randint(0, k + 3))
        before = prose(rng, 4)
        text = before + inner + prose(rng, 4)
        codes = decontam.codes_of(text)
        best = [decontam.align(decontam.codes_of(pattern), codes, low, 2 * (k + 1), k) for low in range(-k, len(text))]
        found = [b for b in best if b]
        want = distance(pattern, text)
        assert bool(found) == (want <= k)
        if found:
            start, end, edits = min(found, key=lambda b: b[2])
            assert edits == want and distance(pattern, text[start:end]) == edits


def test_no_occurrence_within_the_budget_is_missed():
    rng = random.Random(7)
    items = [(i, prose(rng, rng.randint(3, 22))) for i in range(40)] + [(40 + j, x) for j, x in enumerate(("short", "x" * 9, "fourteen chars", "an ing re", "twenty one characters", "exactly thirty characters long", "thirty one characters, not more"))] + [(51, None), (52, "")]
    passages = decontam.Passages.of(items)
    for _ in range(120):
        number, item = rng.choice(items[:47])
        budget = len(item) // 10
        text = prose(rng, rng.randint(0, 60)) + "\n\t " + edited(rng, item.upper(), rng.randint(0, max(0, budget) + 2)) + " " + prose(rng, 20)
        found = {i: (s, e, k) for i, s, e, k in decontam.leaks_of(passages, text)}
        flat = decontam.normal(text)
        for i, t in items[:47]:
            flat_item = decontam.normal(t)
            if len(flat_item) <= decontam.LONG:
                k = len(flat_item) // 10
                assert (i in found) == (distance(flat_item, flat) <= k)
                if i in found:
                    s, e, edits = found[i]
                    assert distance(flat_item, decontam.normal(text[s:e])) <= edits + 1


def test_long_texts_and_long_items(monkeypatch):
    rng = random.Random(3)
    item = prose(rng, 90)
    passages = decontam.Passages.of([(1, item)])
    far = prose(rng, 40000)
    monkeypatch.setattr(decontam, "PIECE", 5000)
    assert len(decontam.leaks_of(passages, far + " " + item[100:360] + " " + far)) == 1
    assert decontam.leaks_of(passages, far) == []


def test_operator(spark, monkeypatch):
    rng = random.Random(11)
    items = [(i, prose(rng, 20)) for i in range(12)] + [(3, None), (None, "x" * 50)]
    bench = spark.createDataFrame(items, "item_id long, text string").unionByName(spark.createDataFrame(items[:2], "item_id long, text string"))
    rows = [(i, prose(rng, 50) + " " + (items[i % 12][1] if i % 3 == 0 else "") + " " + prose(rng, 9)) for i in range(60)] + [(100, None), (101, ""), (0, items[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"leaks": F.lit("clash"), "item_id": F.lit(9)})
    for size in (1 << 21, 300):
        monkeypatch.setattr(decontam, "ROUND", size)
        out = decontam.mark(docs, bench).collect()
        assert len(out) == len(rows)
        for r in out:
            want = {r.doc_id % 12} if r.doc_id < 60 and r.doc_id % 3 == 0 else set()
            assert {x.item_id for x in r.leaks} == want
            for x in r.leaks:
                assert decontam.normal(r.text[x.start : x.end]) == decontam.normal(items[x.item_id][1])
    assert decontam.mark(docs.limit(0), bench).count() == 0
    assert all(r.leaks == [] for r in decontam.mark(docs, bench.limit(0)).collect())


def test_places():
    for text in ("  a  B\n\tcİd ", "", "  ", "é漢 x"):
        flat, at = decontam.normal(text), decontam.places(text)
        assert len(at) == len(flat) + 1
        assert all(c == " " or c in text[at[i]].lower() for i, c in enumerate(flat))
        assert np.all(np.diff(at) >= 0)


def test_every_quotation_and_the_whole_of_a_long_item_are_given(monkeypatch):
    rng = random.Random(21)
    fill = lambda n: " ".join(f"{rng.randrange(10**9):x}" for _ in range(n))
    short, long = fill(10), fill(60)
    assert len(short) <= decontam.LONG < 3 * decontam.LONG < len(long)
    passages = decontam.Passages.of([(1, short), (2, long)])
    bent = list(long)
    for at in range(25, len(long), 50):
        bent[at] = "#"
    bent = "".join(bent)
    pieces = [fill(9), short, fill(30), long, fill(5), short.upper(), fill(7), bent, fill(4), long[: len(long) // 2], fill(6)]
    text = "  ".join(pieces)
    for size in (1 << 17, 700):
        monkeypatch.setattr(decontam, "PIECE", size)
        leaks = decontam.leaks_of(passages, text)
        assert [text[s:e] for i, s, e, k in leaks if i == 1] == [short, short.upper()]
        got = [(text[s:e], k) for i, s, e, k in leaks if i == 2]
        assert [x for x, _ in got][:2] == [long, bent] and len(got) == 3
        assert [k for _, k in got][:2] == [0, bent.count("#")]
        # Of half an item, the end that fills no passage may stay.
        assert pieces[9].startswith(got[2][0][: len(pieces[9])]) and len(got[2][0]) > len(pieces[9]) - decontam.STEP
