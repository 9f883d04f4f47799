from pyspark.sql import functions as F

from provisio.llm import site_lines


def test_hosts(spark):
    urls = {"https://WWW.A.Example:80/x": "a.example", "http://u@a.example?q": "a.example", " https://a.example ": "a.example", "a.example/x": None, "": None, None: None, "ftp://a.example": None}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert {r.u: r.s for r in df.select("u", site_lines.site_of(F.col("u")).alias("s")).collect()} == urls


def rows(spark):
    data = [(f"c{i}", f"own text number {'x' * i} here\n  Share THIS page — now! {i}\nshort", "https://s.example/a", "k") for i in range(12)]
    data += [("c0", data[0][1], "https://www.s.example:1/b", "k")]  # delivered again
    data += [(f"d{i}", "share this page now", "https://t.example", "k") for i in range(11)]
    data += [("n1", None, "https://s.example", "k"), ("n2", "share this page now", None, "k"), ("n3", "share this page now", "s.example", "k"), (None, "share this page now", "https://s.example", "k"), ("e", "", "https://s.example", None)]
    return spark.createDataFrame(data, "chunk_id string, text string, url string, line_no string")


def test_lines_found_and_removed(spark):
    df = rows(spark)
    got = {tuple(r) for r in site_lines.repeated_lines(df).collect()}
    assert got == {(f"c{i}", 2) for i in range(12)}
    assert {tuple(r) for r in site_lines.repeated_lines(df, min_docs=11).collect()} == got | {(f"d{i}", 1) for i in range(11)}
    assert site_lines.repeated_lines(df, min_docs=11, min_share=0.95).filter("chunk_id like 'c%'").count() == 0  # twelve of thirteen
    clean = site_lines.without_repeated_lines(df)
    assert clean.count() == df.count()
    by = {r.chunk_id: r for r in clean.collect()}
    assert by["c3"].clean_text == "own text number xxx here\nshort" and by["c3"].lines_removed == 1
    assert by["n1"].clean_text is None and by["n2"].clean_text == "share this page now" and by[None].lines_removed == 0
    assert site_lines.repeated_lines(df.limit(0)).count() == 0 and site_lines.without_repeated_lines(df.limit(0)).count() == 0


def test_a_text_of_site_matter_only_becomes_empty(spark):
    df = spark.createDataFrame([(f"c{i}", "Share this page now", "https://s.example") for i in range(12)], "chunk_id string, text string, url string")
    assert {r.clean_text for r in site_lines.without_repeated_lines(df).collect()} == {""}
