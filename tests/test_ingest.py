import random

import pytest

from provisio.operators import html, ingest
from provisio.sources.corpus import chunks_from_json, golden_from_json, latest, registered, vectors_from_npz

PARA = "doc string, seq int, level int, label string, text string"
WORD = "doc string, page int, seq int, text string, size double, fontname string, x0 double, top double"


def test_level_paths_equal_a_loop(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for doc in "abc":
        live = {}
        for seq in range(60):
            level, label = rnd.randint(1, 5), rnd.choice(["x", "y", "z", None])
            text = rnd.choice(["t", "", " "])
            rows.append((doc, seq, level, label, text))
            live = {k: v for k, v in live.items() if k <= level}
            live[level] = label or "?"
            if text.strip():
                want[doc, seq] = [(str(k), live[k]) for k in sorted(live)]
    got = {(r.doc, r.seq): [tuple(p) for p in r.path] for r in ingest.level_paths(spark.createDataFrame(rows, PARA)).collect()}
    assert got == want


def test_level_out_of_range_fails(spark):
    with pytest.raises(Exception, match="out of range"):
        ingest.level_paths(spark.createDataFrame([("a", 1, 9, "x", "t")], PARA)).collect()


def words(spark, lines):
    """lines: (page, top, size, font, text)"""
    rows, seq = [], 0
    for page, top, size, font, text in lines:
        for x, w in enumerate(text.split()):
            rows.append(("d", page, seq, w, size, font, float(x), top))
            seq += 1
    return spark.createDataFrame(rows, WORD)


def test_body_size_ties_go_to_the_first_seen(spark):
    w = words(spark, [(1, 1.0, 12.0, "F", "a b"), (1, 2.0, 9.0, "F", "c d"), (2, 1.0, 9.0, "F", "e")])
    assert {r.page: r.body_size for r in ingest.body_sizes(w).collect()} == {1: 12.0, 2: 9.0}


def test_lines_round_half_to_even(spark):
    w = words(spark, [(1, 2.5, 10.0, "F", "a b"), (1, 2.0, 10.0, "F", "c"), (1, 3.5, 10.0, "F", "e")])
    assert sorted((r.line_top, sorted(r.text.split())) for r in ingest.lines(w).collect()) == [(2.0, ["a", "b", "c"]), (4.0, ["e"])]


def test_pdf_sections(spark):
    body = "plain words that make up the body of the page and outnumber all else here"
    w = words(spark, [
        (1, 1.0, 10.0, "F", "before any heading"), (1, 2.0, 10.0, "F", "Page 1 of 9"), (1, 3.0, 14.0, "F", "Large Heading"), (1, 4.0, 10.0, "F", body),
        (1, 5.0, 10.0, "F-Bold", "• •"), (2, 1.0, 10.0, "F", "across the page " + body), (2, 2.0, 14.0, "F", "Empty One"), (2, 3.0, 10.0, "X-Bd", "Bold One"), (2, 4.0, 10.0, "F", "tail"),
        (2, 5.0, 10.0, "F-Bold", "a bold line of thirteen words is no heading at all you see now"),
    ])
    got = [(r.heading, r.text) for r in ingest.pdf_sections(w).orderBy("section_no").collect()]
    assert got == [("Introduction", "before any heading"), ("Large Heading", body + " • • across the page " + body), ("Bold One", "tail a bold line of thirteen words is no heading at all you see now")]


STATUTE = """<html><div class="section"><div class="content">Root text.</div>
<div class="subsection x"><span class="num" value="a">(a)</span><div class="content">Own <b>a</b>.</div>
 <div class="paragraph"><div class="subparagraph"><span class="num" value="B"></span><div class="content">Deep &amp; far.</div></div></div>
 <div class="note"><div class="content">skip me</div></div><div class="continuation">After.</div></div></div></html>"""


def test_statute_tree(spark):
    got = html.statute_sections(STATUTE)
    # the label of the paragraph is the first one found anywhere below it
    assert got == [([], "Root text."), ([("subsection", "a")], "Own a . After."), ([("subsection", "a"), ("paragraph", "B"), ("subparagraph", "B")], "Deep & far.")]
    with pytest.raises(ValueError):
        html.statute_sections("<div>none</div>")
    df = spark.createDataFrame([("f", STATUTE), ("g", None)], "filename string, html string")
    assert html.parse_statutes(df).count() == 3


def test_flat_paragraphs():
    page = '<p class="psection-1"><span class="enumxml">(a)</span> one</p><p class="x psection-3">three<p class="psection-2"><span class="enumxml"> (1) </span></p><p>no</p>'
    assert html.flat_paragraphs(page) == [(1, "a", "one"), (3, None, "three"), (2, "1", "")]


REG = "filename string, doc_pos int, citation_prefix string, source_type string, authority_weight double, tax_year_start int, tax_year_end int, url string"


def test_chunks_get_ids_headers_and_positions(spark):
    registry = spark.createDataFrame([("s.html", 0, "IRC §1", "statute", 1.0, None, None, "u"), ("p.pdf", 1, "Pub. 5", "publication", 0.4, None, None, "v")], REG)
    section = "filename string, seq int, path array<struct<role:string,label:string>>, text string"
    s = spark.createDataFrame([("s.html", 0, [], "root"), ("s.html", 1, [("subsection", "a")], "own")], section)
    p = spark.createDataFrame([("p.pdf", 0, [("heading", "Rent it")], "x"), ("p.pdf", 1, [("heading", "Rent: it!")], "y")], section)
    rows = ingest.parse_corpus(s, s.limit(0), p, registry).orderBy("pos").collect()
    assert [r.chunk_id for r in rows] == ["irc-1", "irc-1-a", "pub-5-rent-it", "pub-5-rent-it-2"]
    assert [r.text for r in rows] == ["IRC §1 — root", "IRC §1 > (a) — own", "Pub. 5 > Rent it — x", "Pub. 5 > Rent: it! — y"]
    assert [r.citation for r in rows][1:3] == ["IRC §1(a)", "Pub. 5 — Rent it"] and [r.pos for r in rows] == [0, 1, 2, 3]


def test_registry_is_strict(spark):
    registry = spark.createDataFrame([("a.html", 0, "x", "statute", 1.0, None, None, "u"), ("a.txt", 1, "x", "statute", 1.0, None, None, "u")], REG)
    ok = spark.createDataFrame([("a.html",)], "filename string")
    assert registered(ok, registry).count() == 1
    for bad in ("b.html", "a.txt"):
        with pytest.raises(Exception, match="no parser"):
            registered(spark.createDataFrame([(bad,)], "filename string"), registry).collect()


def test_json_npz_and_latest(spark, tmp_path):
    import json

    import numpy as np

    (tmp_path / "c.json").write_text(json.dumps([{"chunk_id": "a", "text": "t", "authority_weight": 1.0, "tax_year_start": None}, {"chunk_id": "b"}]))
    assert [(r.chunk_id, r.pos) for r in chunks_from_json(spark, str(tmp_path / "c.json")).orderBy("pos").collect()] == [("a", 0), ("b", 1)]
    (tmp_path / "g.json").write_text(json.dumps({"questions": [{"id": f"q{i}", "category": "x", "question": "?"} for i in range(5)]}))
    assert golden_from_json(spark, str(tmp_path / "g.json")).count() == 5
    assert golden_from_json(spark, str(tmp_path / "g.json"), limit=2).count() == 2
    np.savez(tmp_path / "e.npz", chunk_ids=np.array(["a", "b"]), embeddings=np.ones((2, 3), np.float32))
    assert {r.chunk_id: list(r.embedding) for r in vectors_from_npz(spark, str(tmp_path / "e.npz")).collect()} == {"a": [1, 1, 1], "b": [1, 1, 1]}
    df = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", None, "x")], "k string, at int, v string")
    assert {r.k: r.v for r in latest(df, ["k"], "at").collect()} == {"a": "new", "b": "x"}
