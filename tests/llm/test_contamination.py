import os
import random
import re

import numpy as np
import pytest

from provisio.llm import contamination
from provisio.llm.queries import QUERIES


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


def brute(docs, items, n):
    out = set()
    for d, t in docs:
        w = words(t or "")
        for i, *fields in items:
            for f in fields:
                p = words(f or "")
                if p and i is not None:
                    k = min(n, len(p))
                    grams = {tuple(p[j : j + k]) for j in range(len(p) - k + 1)}
                    if any(tuple(w[j : j + k]) in grams for j in range(len(w) - k + 1)):
                        out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(6)
    vocab = [f"word{i}" for i in range(30)] + ["a", "of", "the", "Été", "½", "税"]
    items = [(f"q{i}", " ".join(rnd.choices(vocab, k=rnd.randint(0, 20))), rnd.choice([None, "", "Short one", "a", " ".join(rnd.choices(vocab, k=15))])) for i in range(25)]
    items.append((None, "word1 word2", None))
    docs = []
    for i in range(120):
        w = rnd.choices(vocab, k=rnd.randint(0, 60))
        if rnd.random() < 0.6:
            p = words(rnd.choice(items)[rnd.choice([1, 2])] or "")
            a = rnd.randint(0, max(0, len(p) - 1))
            k = rnd.randint(0, len(w))
            w[k:k] = p[a : a + rnd.randint(5, 20)]
        docs.append((i, "".join(x.upper() + rnd.choice([" ", ", ", "—", "\n", " (", "_"]) if rnd.random() < 0.3 else x + " " for x in w)))
    docs += [(200, None), (201, ""), (202, "\x1e")]
    d = spark.createDataFrame([(*x, "i") for x in docs], "doc_id long, text string, id string")
    q = spark.createDataFrame(items, "id string, question string, reference_answer string")
    want = brute(docs, items, 8)
    assert len(want) > 30
    for most in (20_000_000, 300):
        got = contamination.leaked_items(d, q, min_words=8, most_item_chars=most)
        assert got.columns == ["doc_id", "item_id"] and {tuple(r) for r in got.collect()} == want
    assert contamination.leaked_items(d, q.limit(0)).count() == 0 and contamination.leaked_items(d.limit(0), q).count() == 0


def edit_distance_inside(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("edits", [0, 1, 3])
def test_edits_within_the_budget(edits):
    rnd = random.Random(edits)
    text = " ".join(f"{rnd.choice('abcdefgh')}{rnd.choice('aeiou')}{rnd.choice('klmnrst')}{rnd.randint(10, 99)}" for _ in range(14))
    index = contamination.ItemIndex([("q", text)], 12, edits)
    w = words(text)
    docs = []
    for n in range(8):
        p = list(" ".join(w[1:13]))
        for _ in range(n):
            k = rnd.randrange(len(p))
            rnd.choice([lambda: p.pop(k), lambda: p.insert(k, "z"), lambda: p.__setitem__(k, "z")])()
        docs.append("some words before it " + "".join(p) + " and after it some more")
    got = {d for d, _ in contamination.leaks(index, docs)}
    passages = [" " + " ".join(w[i : i + 12]) + " " for i in range(3)]
    want = {d for d, t in enumerate(docs) if any(edit_distance_inside(p, " " + t + " ") <= edits for p in passages)}
    assert got == want and 0 in want and len(want) < 8


@pytest.mark.parametrize("edits", [0, 1, 2, 4])
def test_aligned_equals_all_cells(edits):
    rnd = random.Random(edits)
    seen = set()
    for _ in range(400):
        text = [rnd.randrange(3) for _ in range(rnd.randint(0, 30))]
        a = rnd.randint(0, len(text))
        passage = text[a : a + rnd.randint(1, 12)] or [1]
        for _ in range(rnd.randint(0, edits + 1)):
            k = rnd.randrange(len(passage))
            passage[k : k + rnd.randint(0, 1)] = [rnd.randrange(3)] * rnd.randint(0, 2)
            passage = passage or [2]
        as_array = lambda x: np.array(x, np.uint8)
        got = contamination.aligned(as_array(passage), as_array(text), 0, len(text), edits)
        assert got == (edit_distance_inside(passage, text) <= edits) == contamination._anywhere(bytes(passage), bytes(text), edits)
        seen.add(got)
    assert len(seen) == 2


def test_hits_of_template_items_are_taken_text_by_text(monkeypatch):
    words = [f"word{i}" for i in range(30)]
    index = contamination.ItemIndex([(f"q{i}", " ".join(words[: 14 + i % 5])) for i in range(40)], 12, 0)
    docs = ["x " + " ".join(words[i : i + 16]) for i in range(10)] * 3 + ["", "y " * 40]
    want = contamination.leaks(index, docs)
    monkeypatch.setattr(contamination, "MOST_HITS", 1)
    assert contamination.leaks(index, docs) == want and len(want) > 100


def test_edits_query_holds_the_exact_one(spark, sf):
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    exact, near = ({tuple(r) for r in QUERIES[n](spark, sf).collect()} for n in ("p7_found", "p7_edits"))
    assert exact and exact <= near
