import os
import random

import pytest

from provisio.llm import tokenize
from provisio.llm.queries import TOKENIZERS

FILE = os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(FILE), reason="no vocabulary here")


def texts():
    rnd = random.Random(8)
    bits = ["word", " ", "  ", "\n", "\r\n", "\t", "'re", "don't", "12", "½", "税務", "🧾", "—", "é", "...", "x" * 40, " \n ", "'", "§"]
    out = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 400))) for _ in range(60)]
    return out + ["", None, " " * 900, "a" * 900, "'re" * 300, "\n" * 700, "a " * 600, "x" * 500 + " " + "y " * 100]


@pytest.mark.parametrize(("chunk", "overlap", "far"), [(2_048, 256, 10**6), (64, 32, 10**6), (100, 16, 10**6), (64, 32, 150), (100, 16, 100)])
def test_ids_equal_the_library_on_whole_texts(spark, chunk, overlap, far):
    from tokenizers import Tokenizer

    rows = [(i, t, "k") for i, t in enumerate(texts())]
    t = Tokenizer.from_file(FILE.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in tokenize.encode_texts(df, FILE, chunk_chars=chunk, overlap=overlap, far_chars=far).collect()}
    for i, text, _ in rows:
        assert got[i] == t.encode(text or "", add_special_tokens=False).ids, (i, text)
        assert tokenize.decode(FILE, got[i]) == (text or "").encode()


def test_special_strings_repeated_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "<|endoftext|>"), (1, "<|endoftext|>" * 20), (None, "a")], "doc_id long, text string")
    got = tokenize.encode_texts(df, FILE, chunk_chars=50, overlap=20, far_chars=60).collect()
    assert len(got) == 3 and all(50256 not in r.ids for r in got)
    assert tokenize.encode_texts(df.limit(0), FILE).count() == 0


def test_usual_texts_are_stitched():
    text = "The owner of record may deduct the supply expense, if §12(a) applies. " * 200
    got = tokenize.pieces(text, 2_048, 256)
    assert len(got) == 7 and "".join(got) == text
    assert tokenize.pieces("x" * 5_000, 2_048, 256) == ["x" * 5_000]  # chunks that never meet
    assert tokenize.pieces(None, 10, 5) == tokenize.pieces("", 10, 5) == []


def test_stitched_rows_of_the_table_equal_the_library(spark, sf):
    if not os.path.isdir(sf):
        pytest.skip("no tables here")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) > 2048")
    ids = {r.doc_id: r.ids for r in tokenize.encode_texts(docs, FILE).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(rows) > 10 and all(ids[r.doc_id] == t.encode(r.text, add_special_tokens=False).ids for r in rows)
