import random
import re

import numpy as np
import pyarrow as pa
import pytest

from provisio.llm import near_dup
from provisio.llm.word_bytes import word_hashes, words_of

SCHEMA = "chunk_id string, text string, source_type string, jaccard string"


def shingles(text, n):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, n, t):
    seen = sorted({(i, s.strip().lower(), x) for i, x, s, *_ in rows if i is not None and x is not None and s is not None})
    out = set()
    for a in seen:
        for b in seen:
            if a[0] < b[0] and a[1] == b[1]:
                x, y = shingles(a[2], n), shingles(b[2], n)
                if x and y and len(x & y) >= t * len(x | y):
                    out.add((a[0], b[0]))
    return out


def corpus(seed, n=90):
    rnd = random.Random(seed)
    phrases = ["in the course of a trade or business", "for the convenience of the employer", "unless records show otherwise", "Étudié ½ ² où", "x_y z-w"]
    base = [" ".join(rnd.choice(phrases + [f"w{rnd.randint(0, 400)} v{rnd.randint(0, 50)}"]) for _ in range(rnd.randint(1, 25))) for _ in range(n // 3)]
    rows = []
    for i in range(n):
        words = rnd.choice(base).split()
        for _ in range(rnd.randint(0, 6)):
            k = rnd.randrange(len(words))
            words[k : k + rnd.randint(0, 2)] = [f"e{rnd.randint(0, 99)}"] * rnd.randint(0, 1)
            words = words or ["a"]
        rows.append((f"c{i:03d}", " ".join(words), rnd.choice(["s", "S ", "p"]), "j"))
    rows += [("c000", rows[0][1], rows[0][2], "j"), ("d1", rows[0][1], rows[0][2], "j"), ("d2", rows[0][1], rows[0][2], "j"), ("n1", None, "s", "j"), ("n2", rows[0][1], None, "j"), ("n3", "", "s", "j"), ("n4", "two words", "s", "j"), ("n5", "two words", "s", "j"), (None, rows[0][1], "s", "j")]
    return rows


@pytest.mark.parametrize(("num", "den", "size", "how"), [(1, 2, 3, {}), (4, 5, 5, {}), (1, 2, 3, {"cell_rows": 1}), (2, 3, 2, {"hot_rows": 3}), (1, 2, 1, {"hot_rows": 2, "cell_rows": 20, "buffer_chars": 500})])
def test_pairs_equal_brute_force(spark, num, den, size, how):
    rows = corpus(num * 10 + size)
    df = spark.createDataFrame(rows, SCHEMA)
    got = near_dup.near_duplicate_pairs(df, text_col="text", group_col="source_type", shingle=size, num=num, den=den, **how)
    assert {tuple(r) for r in got.collect()} == brute(rows, size, num / den)


def test_links_without_pairs_of_copies(spark):
    rows = corpus(5)
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.chunk_id: r for r in near_dup.near_duplicate_links(df, text_col="text", group_col="source_type", shingle=3, num=1, den=2).collect()}
    texts = {}
    for i, t, s, _ in rows:
        if i and t and s and len(shingles(t, 3)):
            texts.setdefault((s.strip().lower(), t), set()).add(i)
    for (s, t), ids in texts.items():
        near = sum(a == s and b != t and len(shingles(t, 3) & shingles(b, 3)) * 2 >= len(shingles(t, 3) | shingles(b, 3)) for a, b in texts)
        for i in ids:
            assert (out[i].class_id, out[i].copies, out[i].links) == (min(ids), len(ids), near)
    assert len(out) == len({i for ids in texts.values() for i in ids})


def met(texts, size, num, den, cells=3, hot_rows=10_000, most=50):
    """Pairs of text numbers that meet in some cell and are not ruled out there, and the bytes routed."""
    often = near_dup.frequencies(texts, size)
    by_cell, sent = {}, 0
    for a in range(0, len(texts), 40):  # as in several tasks
        part = texts[a : a + 40]
        for g, p, c, *cols in near_dup.route(np.arange(a, a + len(part)), ["g"] * len(part), part, size, num, den, often, cells, hot_rows):
            by_cell.setdefault((g, p, c), []).append(cols)
            sent += sum(map(len, cols))
    out = set()
    names = [x.split()[0] for x in near_dup.CELL.split(", ")][3:]
    for rows in by_cell.values():
        a, b = near_dup.join_cell(pa.table({n: pa.array(c, pa.binary()) for n, c in zip(names, zip(*rows))}), num, den, most=most)
        out |= set(zip(a.tolist(), b.tolist()))
    return out, sent


def words(rnd, n, vocabulary):
    return " ".join(f"w{rnd.randint(0, vocabulary)}" for _ in range(n))


@pytest.mark.parametrize(("num", "den"), [(1, 2), (4, 5), (1, 3)])
@pytest.mark.parametrize(("longest", "hot_rows"), [(30, 10_000), (30, 5), (1500, 10_000)])
def test_cells_lose_no_similar_texts(num, den, longest, hot_rows):
    rnd = random.Random(longest + num)
    texts = []
    for _ in range(60):
        base = words(rnd, rnd.randint(1, longest), 60 if longest < 100 else 5000).split()
        texts.append(" ".join(base))
        if rnd.random() < 0.7:  # some words left out
            texts.append(" ".join(w for w in base if rnd.random() < 0.8) or base[0])
    texts = list(dict.fromkeys(texts))
    sets = [set(t.split()) for t in texts]
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) * den >= num * len(sets[i] | sets[j])}
    found, _ = met(texts, 1, num, den, hot_rows=hot_rows)
    assert want <= found and len(want) > 5


def test_routed_bytes_hold_with_more_cells():
    rnd = random.Random(3)
    texts = [words(rnd, 125, 30_000) for _ in range(800)]
    sent = [met(texts, 3, 1, 2, cells=c)[1] for c in (4, 64, 4096)]
    assert sent[1] < 2 * sent[0] and sent[2] < 2.4 * sent[0]


def test_whole_shingles():
    texts = ["a b c d", "", "a b", "c d a b c", "a b a b a b"]
    got = [set(x.tolist()) for x in near_dup.whole_shingles(texts, 3)]
    assert [len(x) for x in got] == [2, 0, 0, 3, 2] and len(got[0] & got[3]) == 1
    assert all(len(x) == 0 for x in near_dup.whole_shingles(["a"], 3))


def test_words_and_hashes():
    texts = ["", "One, two_three ÉTÉ—x", "\x1e a\x1eb", "½ ² 税務 🧾 a" * 3, "w" * 3000]
    hashes, counts = word_hashes(texts)
    want = [[w.encode() for w in re.findall(r"[^\W_]+", t.lower())] for t in texts]
    assert [words_of(t) for t in texts] == want and counts.tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert len(set(hashes.tolist())) == len(set(flat)) and all((hashes[i] == hashes[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_dup.near_duplicate_pairs(df, text_col="text", group_col="source_type").count() == 0
    assert near_dup.near_duplicate_links(df, text_col="text").count() == 0
