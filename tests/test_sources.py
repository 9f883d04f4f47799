import json

import numpy as np
import pytest

from provisio import runtime
from provisio.operators import dense
from provisio.operators.best import Best
from provisio.sources import corpus

REGISTRY = "filename string, citation_prefix string, source_type string, doc_pos int"


def test_registered_files_in_order(spark, tmp_path):
    for name, content in (("a.html", b"<p>\xffok</p>"), ("b.PDF", b"words"), ("c.htm", b"<b>x</b>")):
        (tmp_path / name).write_bytes(content)
    reg = spark.createDataFrame([("c.htm", "C", "s", 1), ("a.html", "A", "s", 2), ("b.PDF", "B", "p", 3), ("gone.html", "G", "s", 4)], REGISTRY)
    got = corpus.scan_registered(spark, str(tmp_path), reg).orderBy("doc_pos").collect()
    assert [(r.filename, r.kind, r.citation_prefix) for r in got] == [("c.htm", "html", "C"), ("a.html", "html", "A"), ("b.PDF", "pdf", "B")]
    assert bytes(got[2].content) == b"words"
    pages = {r.filename: r.html for r in corpus.html_files(spark, f"{tmp_path}/*.htm*").collect()}
    assert pages == {"a.html": "<p>ok</p>", "c.htm": "<b>x</b>"}  # bytes that aren't UTF-8 left out
    with pytest.raises(Exception, match="no parser or registry entry for b.PDF"):
        corpus.scan_registered(spark, str(tmp_path), reg.filter("filename != 'b.PDF'")).collect()
    (tmp_path / "d.txt").write_bytes(b"x")
    more = reg.unionByName(spark.createDataFrame([("d.txt", "D", "s", 5)], REGISTRY))
    with pytest.raises(Exception, match="no parser or registry entry for d.txt"):
        corpus.scan_registered(spark, str(tmp_path), more).collect()


def test_pdf_words_by_an_extractor(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"two words")
    extract = lambda b: [(0, i, w, 10.0, "Serif", float(i), 1.0) for i, w in enumerate(b.decode().split())]
    got = corpus.pdf_words(spark, f"{tmp_path}/*.pdf", extract).orderBy("seq").collect()
    assert [(r.doc, r.page, r.seq, r.text, r.size) for r in got] == [("x.pdf", 0, 0, "two", 10.0), ("x.pdf", 0, 1, "words", 10.0)]


def test_json_sources(spark, tmp_path):
    (tmp_path / "chunks.json").write_text(json.dumps([{"chunk_id": "a", "text": "t"}, {"chunk_id": "b", "text": None, "tax_year_start": 2020}]))
    (tmp_path / "golden.json").write_text(json.dumps({"questions": [{"id": "q1", "question": "?"}, {"id": "q2", "question": "!"}]}))
    chunks = corpus.chunks_from_json(spark, str(tmp_path / "chunks.json")).orderBy("pos").collect()
    assert [(r.chunk_id, r.text, r.tax_year_start, r.pos) for r in chunks] == [("a", "t", None, 0), ("b", None, 2020, 1)]
    assert [r.id for r in corpus.golden_from_json(spark, str(tmp_path / "golden.json")).orderBy("pos").collect()] == ["q1", "q2"]
    assert [r.id for r in corpus.golden_from_json(spark, str(tmp_path / "golden.json"), limit=1).collect()] == ["q1"]


def test_vector_archive(spark, tmp_path):
    np.savez(tmp_path / "e.npz", chunk_ids=np.array(["a", "b"]), embeddings=np.array([[1.0, 2.0], [3.0, 4.0]]))
    got = {r.chunk_id: r.embedding for r in corpus.vectors_from_npz(spark, str(tmp_path / "e.npz")).collect()}
    assert got == {"a": [1.0, 2.0], "b": [3.0, 4.0]}


def test_vector_store(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = "chunk_id string, embedding array<float>, embedded_at int"
    with pytest.raises(FileNotFoundError):
        corpus.read_vectors(spark, path)
    corpus.upsert_vectors(spark.createDataFrame([("a", [1.0], 1), ("b", [2.0], 5), ("a", [0.0], 0)], schema), path)
    corpus.upsert_vectors(spark.createDataFrame([("a", [9.0], 2), ("b", [8.0], 4), ("c", None, 1)], schema), path)
    read = lambda: {r.chunk_id: r.embedding for r in corpus.read_vectors(spark, path).collect()}
    assert read() == {"a": [9.0], "b": [2.0], "c": None}
    (tmp_path / "store" / "v=3").mkdir()  # a write that broke off
    assert read() == {"a": [9.0], "b": [2.0], "c": None}
    corpus.rebuild_vectors(spark.createDataFrame([("z", [1.0], 1)], schema), path)
    assert read() == {"z": [1.0]}


def test_latest_settles_ties(spark):
    rows = [("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "n"), ("b", 1, "m")]
    df = spark.createDataFrame(rows, "id string, at int, v string")
    first = {r.id: r.v for r in corpus.latest(df, ["id"], "at").collect()}
    again = {r.id: r.v for r in corpus.latest(df.repartition(3).orderBy("v"), ["id"], "at").collect()}
    assert first == again and first["a"] in "yz" and first["b"] == "m"


def test_best_keeps_k_whatever_ties():
    rng = np.random.default_rng(1)
    score, tie = rng.integers(0, 4, (5, 300)) / 3, rng.permutation(300)
    best = Best(5, 7)
    for a in range(0, 300, 50):
        best.add(np.array([f"i{t}" for t in tie[a : a + 50]], object), tie[a : a + 50], score[:, a : a + 50])
    q, ids, kept, value = best.rows()
    for i in range(5):
        order = sorted(range(300), key=lambda j: (-round(score[i, j], 9), tie[j]))[:7]
        assert ids[q == i].tolist() == [f"i{tie[j]}" for j in order] and np.allclose(value[q == i], score[i, order])
    assert [len(x) for x in Best(3, 2).rows()] == [0, 0, 0, 0]


def test_equal_vectors_send_k_rows_of_a_task(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(500)], "id long, v array<float>").repartition(3)
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    got = dense.top_k(df, q, 4, dim=2, id_col="id", vec_col="v").orderBy("rank").collect()
    assert [(r.id, r["rank"]) for r in got] == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_checkpoint_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        class _jsc:
            sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.ensure_checkpoint_dir(Session)


def test_broadcasts_are_bounded_by_bytes(spark, monkeypatch):
    df = spark.createDataFrame([("x" * 1000,)] * 20, "t string")
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(runtime.broadcast_if_small(df, 20)) and not hinted(runtime.broadcast_if_small(df, 19))
    monkeypatch.setattr(runtime, "MAX_BROADCAST_BYTES", 15_000)
    assert not hinted(runtime.broadcast_if_small(df, 20))
