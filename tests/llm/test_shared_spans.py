import os
import random

import numpy as np
import pytest

from provisio.llm import shared_spans
from provisio.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, length string"


def runs(a, b, least):
    out = set()
    for d in range(-len(b) + 1, len(a)):
        i, j, n = max(0, d), max(0, -d), 0
        while True:
            if i < len(a) and j < len(b) and a[i] == b[j]:
                n += 1
            else:
                if n >= least:
                    out.add((i - n, j - n, n))
                n = 0
            if i >= len(a) or j >= len(b):
                break
            i, j = i + 1, j + 1
    return out


def docs():
    rnd = random.Random(9)
    part = lambda n: "".join(rnd.choice("abc de\n🧾é") for _ in range(n))
    shared = [part(n) for n in (29, 30, 31, 60)]
    out = []
    for i in range(40):
        text = part(rnd.randint(0, 60))
        for _ in range(rnd.randint(0, 2)):
            text += rnd.choice(shared) + part(rnd.randint(0, 20))
        out.append((i, text))
    out += [(50, "x" * 100), (51, "y" + "x" * 45 + "z"), (52, "ab" * 40), (53, "q" + "ab" * 20), (54, out[3][1] + part(40)), (55, "x" * 100), (60, None), (61, ""), (62, "x" * 29)]
    return out


@pytest.mark.parametrize(("width", "hot"), [(10, 200), (20, 200), (30, 200), (20, 1), (15, 3), (30, 1)])
def test_pairs_equal_brute_force(spark, width, hot):
    rows = docs()
    df = spark.createDataFrame([(*r, "l") for r in rows], SCHEMA).repartition(3)
    want = {(a, b) for a, x in rows for b, y in rows if a < b and x and y and runs(x, y, 30)}
    assert len(want) > 20
    got = shared_spans.sharing_pairs(df, length=30, width=width, hot_rows=hot)
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("hot", [200, 1])
def test_shares_equal_brute_force(spark, hot):
    rows = docs()
    df = spark.createDataFrame([(*r, "l") for r in rows], SCHEMA)
    got = {r.doc_id: (r.n_chars, r.shared_chars) for r in shared_spans.shared_shares(df, length=30, width=15, hot_rows=hot).collect()}
    for i, x in rows:
        if x is None or len(x) < 30:
            assert i not in got
            continue
        held = set()
        for j, y in rows:
            if i != j and y:
                for a, _, n in runs(x, y, 30):
                    held |= set(range(a, a + n))
        assert got[i] == (len(x), len(held))


def repeating():
    """Texts that repeat themselves with many periods, phases and lengths, between others and alone."""
    rnd = random.Random(5)
    phrase = "".join(rnd.choice("abcdefgh ") for _ in range(17))
    out = []
    for unit in ("-", "|-", "|-|--", phrase):
        for size in (29, 33, 41, 47, 150):
            shift = rnd.randrange(len(unit))
            body = (unit * 200)[shift : shift + size]
            out.append(rnd.choice(["", "x" + unit, "yz"]) + body + rnd.choice(["", "w", "vu" + phrase]))
        out.append(out[-1][:120] + rnd.choice("pq") + out[-1][10:90])
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("width", "hot"), [(15, 200), (20, 200), (30, 200), (20, 1), (12, 2)])
def test_repeating_texts_equal_brute_force(spark, width, hot):
    rows = repeating()
    df = spark.createDataFrame([(*r, "l") for r in rows], SCHEMA).repartition(3)
    held = {i: set() for i, _ in rows}
    want = set()
    for i, x in rows:
        for j, y in rows:
            if i != j:
                for a, _, n in runs(x, y, 30):
                    held[i] |= set(range(a, a + n))
                    want.add((min(i, j), max(i, j)))
    got = shared_spans.shared_shares(df, length=30, width=width, hot_rows=hot).collect()
    assert {r.doc_id: r.shared_chars for r in got} == {i: len(held[i]) for i, x in rows if len(x) >= 30}
    pairs = shared_spans.sharing_pairs(df, length=30, width=width, hot_rows=hot)
    assert {tuple(r) for r in pairs.collect()} == want


def test_every_place_of_a_long_stretch_is_shared(spark):
    for unit in ("-", "|-|-", "0123456789 abcdefghij 0123456789 klmnopq "):
        rows = [(1, "A" + (unit * 1200)[:1200] + "B"), (2, "C" + (unit * 1200)[2:302] + "D")]
        df = spark.createDataFrame([(*r, "l") for r in rows], SCHEMA)
        assert {r.doc_id: r.shared_chars for r in shared_spans.shared_shares(df).collect()} == {1: 1200, 2: 300}


def test_every_document_has_a_share(spark, sf):
    df = spark.createDataFrame([(1, None, "l"), (2, "", "l"), (3, "x" * 29, "l"), (4, "y" * 30, "l"), (5, "y" * 40, "l"), (None, "z", "l")], SCHEMA)
    got = {tuple(r) for r in shared_spans.document_shares(df, length=30, width=15).collect()}
    assert got == {(1, 0, 0, 0.0), (2, 0, 0, 0.0), (3, 29, 0, 0.0), (4, 30, 30, 1.0), (5, 40, 40, 1.0)}
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    ids = [r.doc_id for r in QUERIES["p8_shares"](spark, sf).collect()]
    assert sorted(ids) == sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect())


def test_empty_and_bad_width(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert shared_spans.sharing_pairs(df).count() == 0 and shared_spans.shared_shares(df).count() == 0
    with pytest.raises(ValueError):
        shared_spans.shared_spans(df, length=10, width=11)


def test_long_text_in_one_batch():
    rnd = random.Random(1)
    text = "".join(rnd.choice("abcdef ") for _ in range(50_000))
    doc, at, count, block, grams = shared_spans.stretches([text, text[20_000:20_300]], 160, 250, with_grams=True)
    assert set(block[doc == 1]) <= set(block[doc == 0]) and count[doc == 1].sum() == 51
    assert (grams[50_000:] == grams[20_000:20_051]).all()


def test_a_passage_in_many_documents_stays_linear(spark):
    rnd = random.Random(2)
    own = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = own(400)
    rows = [(i, own(300) + passage + own(200), "l") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    for hot in (20_000, 10):
        spans = shared_spans.shared_spans(df, hot_rows=hot)
        assert spans.count() < 12 * len(rows)
    # a character of what stands around the passage may be the same by chance
    assert all(400 <= r.shared_chars <= 430 for r in shared_spans.shared_shares(df).collect())


def test_periods():
    grams = np.array([9, 8, *[1, 2, 3] * 50, 1], np.uint64)
    head, tail = shared_spans.periods(grams, 20)
    assert head[:2] == (0, 2) and tail[:2] == (2, 151) and tail[2].tolist() == [1, 2, 3]
    assert shared_spans.periods(grams[:15], 20)[0][1] == 15
