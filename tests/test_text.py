from pyspark.sql import functions as F

from provisio.functions import citations as cite
from provisio.functions.text import display_safe, has_real_word, is_furniture, slug, tokens


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).collect()[0][0]


def test_tokens_keep_unicode_and_drop_stopwords(spark):
    assert one(spark, tokens, "What is the Déjà-vu m² of §280A?") == ["déjà", "vu", "m²", "280a"]
    assert one(spark, tokens, None) == []
    assert one(spark, tokens, "") == []


def test_slug(spark):
    assert one(spark, slug, "IRC §280A(c)(1)") == "irc-280a-c-1"
    assert one(spark, slug, "—") == ""


def test_furniture_and_words(spark):
    assert one(spark, is_furniture, "see page 3 OF 12 here")
    assert not one(spark, is_furniture, "Pages of records")
    assert one(spark, has_real_word, "1 abc") and not one(spark, has_real_word, "• 12 ab")


def test_display_safe(spark):
    assert one(spark, display_safe, "$5 and $6") == "\\$5 and \\$6"


def parse(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(cite.section(F.col("t")), cite.path(F.col("t")), cite.provision_id(cite.section(F.col("t")), cite.path(F.col("t")))).collect()[0]
    return tuple(row)


def test_citation_quirks(spark):
    assert parse(spark, "IRC §280A(c)(1) and §5") == ("280a", ["c", "1"], "irc-280a-c-1")
    assert parse(spark, "under irc 1401(B)") == ("1401", ["b"], "irc-1401-b")
    assert parse(spark, "IRC§179") == ("179", [], "irc-179")  # through the section sign
    assert parse(spark, "§31.3402") == ("3", [], "irc-3")
    assert parse(spark, "what of §179.") == ("17", [], "irc-17")
    assert parse(spark, "§1.274-5") == (None, None, None)
    assert parse(spark, "IRC179") == (None, None, None)
    assert parse(spark, None) == (None, None, None)


def test_keys(spark):
    assert one(spark, cite.mention_key, "IRC § 280A(c)") == "§280a(c)"
    assert one(spark, cite.citation_key, "Treas. Reg. §1.274-5(a)") == "treasreg§1274-5"  # without the path
    assert one(spark, cite.citation_key, "§1.274-5") == "§1"
    assert one(spark, cite.citation_key, "Pub. 587, Using it") == "pub587"
    assert one(spark, cite.citation_key, "Schedule C Instructions — Line 9") == "schedulecinstructions—line9"
    assert one(spark, cite.mentions, "irc §1(a), Treas. Reg. §1.2-3(b) and pub. 5") == ["irc §1(a)", "Treas. Reg. §1.2-3(b)", "pub. 5"]
    assert one(spark, cite.mentions, "IRC 1401(b)") == []
    assert one(spark, cite.required, "A ; ; \tB;") == ["A", "B"]
    assert one(spark, cite.required, None) == []
