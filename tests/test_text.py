import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tipstaff.functions import detect
from tipstaff.functions import text as tx


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_clean(spark):
    assert one(spark, "person�s place", tx.clean) == "person's place"
    assert one(spark, "other than�", tx.clean) == "other than-"
    assert one(spark, "sub-\nsection", tx.clean) == "subsection"
    assert one(spark, "1 one\n2 two", tx.clean) == "1 one\n2 two"
    assert one(spark, "a  \t b \n\n\n\n c ", tx.clean) == "a b\n\n c"
    assert one(spark, "ﬁne “x” – y…", tx.clean) == 'fine "x" - y...'
    assert one(spark, None, tx.clean) == ""


def test_strip_tags(spark):
    html = "<p>One<br>two</p><script>if (a<b) x()</script><style>p{}</style><div>A &amp;lt; B&nbsp;C</div>"
    assert one(spark, html, tx.strip_tags).split() == ["One", "two", "A", "<", "B", "C"]


def test_mostly_upper(spark):
    assert one(spark, "PART Abcd", tx.is_mostly_upper) is False
    assert one(spark, "NOTES ON", tx.is_mostly_upper) is True
    assert one(spark, "ABC", tx.is_mostly_upper) is False


def test_tokens(spark):
    assert one(spark, "The owner's Boat, section 12A", tx.content_tokens) == ["owner's", "boat", "section", "12a"]
    assert one(spark, None, tx.content_tokens) == []


def test_rejoin(spark):
    text = "requirement " * 9 + "require ment may be " + "may be " * 40 + "maybe " * 9
    rows = spark.createDataFrame([(1, 1, text), (1, 2, "the requireme nt stands"), (2, 3, "requireme nt"), (3, 4, None)], "d int, k int, t string")
    got = {r["k"]: r["t"] for r in tx.rejoin(rows, "d", "k", "t").collect()}
    assert got[2] == "the requirement stands" and got[3] == "requireme nt" and got[4] is None and "may be" in got[1]


def test_detection(spark):
    rows = spark.createDataFrame([("a [s 3] b", "x.pdf"), ("x", "qld-2.pdf"), ("ComLaw", "x"), ("plain", None)], "h string, p string")
    assert [r[0] for r in rows.select(detect.profile(F.col("h"), F.col("p"))).collect()] == ["qld", "qld", "cth", "generic"]
    text = "Current as at 4 March 2032\nReprint 2 effective 1 May 2031"
    assert one(spark, text, detect.currency) == "1 May 2031"
    assert str(one(spark, "4 March 2032", detect.currency_date)) == "2032-03-04"
    assert one(spark, "no date", detect.currency) is None


def test_title_needs_three_pages(spark):
    rows = [(1, n, f"{n}  Harbour Kiosk Act 2031\ntext") for n in range(1, 4)] + [(2, 1, "Harbour Kiosk Act 2031")]
    pages = spark.createDataFrame(rows, "doc_ord int, page_no int, page_text string")
    paths = spark.createDataFrame([(1, "a/x.pdf"), (2, "a/some_act.pdf")], "doc_ord int, path string")
    got = {r["doc_ord"]: r["title"] for r in detect.guessed_titles(pages, "doc_ord", "page_no", "page_text", paths).collect()}
    assert got == {1: "Harbour Kiosk Act 2031", 2: "some act"}


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=40))
def test_nfkc_matches_the_standard(s):
    import pandas as pd

    assert tx.nfkc.func(pd.Series([s]))[0] == unicodedata.normalize("NFKC", s)
