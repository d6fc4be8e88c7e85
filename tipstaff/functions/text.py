"""Scalar text functions as Catalyst expressions; Python only where Unicode tables are needed."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words too common to index.
STOPWORDS = """
a an and are as at be been by for from has have if in into is it its may must
no not of on or shall such that the their there this to under upon was were
will with within would
""".split()
# Fixed value: a word for indexing, with at most one apostrophe suffix.
WORD = r"[a-z0-9]+(?:'[a-z]+)?"
# Typographic characters and what stands for them.
SAME = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "–": "-", "—": "-", "―": "-", "−": "-", " ": " ", " ": " ", " ": " ", " ": " "}
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]
DOT_LEADER = r"\.{4,}|(?:\. ){4,}"


def _each(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, to in steps:
        c = F.regexp_replace(c, F.lit(pattern), F.lit(to))
    return c


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility form; the one step of cleaning that Spark has no function for."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def clean_native(c: Column) -> Column:
    """Every step of clean() after normalisation, inside the JVM."""
    c = F.regexp_replace(c, F.lit(r"(?<=[\p{L}\p{N}_])�(?=[\p{L}\p{N}_])"), F.lit("'"))
    c = F.translate(c, "".join(SAME) + "�", "".join(SAME.values()) + "-")
    c = F.replace(F.replace(c, F.lit("…"), F.lit("...")), F.lit("­"), F.lit(""))
    return F.trim(_each(c, (r"\r\n?", "\n"), (r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2"), (r"[ \t]+", " "), (r" \n", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")))


def clean(c: Column) -> Column:
    """Normalised text with its line structure kept; null gives the empty string."""
    return clean_native(nfkc(F.coalesce(c, F.lit(""))))


def flat(c: Column) -> Column:
    """Text on one line with single blanks."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def collapse(c: Column) -> Column:
    """Cleaned text on one line; null gives the empty string."""
    return flat(clean(c))


def strip_tags(c: Column) -> Column:
    """Text of an HTML page: scripts and styles dropped, block ends as line ends, six entities decoded in order."""
    c = _each(c, (r"(?is)<script.*?</script>", " "), (r"(?is)<style.*?</style>", " "), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</(?:p|div|li|h[1-6]|tr)>", "\n"), (r"<[^>]*>", " "))
    for entity, to in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(to))
    return c


def tokenise(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def content_tokens(c: Column) -> Column:
    return F.filter(tokenise(c), lambda t: ~t.isin(STOPWORDS))


def is_mostly_upper(c: Column) -> Column:
    """At least four letters, more than four fifths of them capitals."""
    letters, upper = F.length(F.regexp_replace(c, "[^A-Za-z]", "")), F.length(F.regexp_replace(c, "[^A-Z]", ""))
    return (letters >= 4) & (upper > 0.8 * letters)


def has_leader(c: Column) -> Column:
    return c.rlike(DOT_LEADER)


def vocabulary(df: DataFrame, key: str, text: str) -> DataFrame:
    """Counts of the alphabetic words of each document: key, word, n."""
    words = F.explode(F.regexp_extract_all(F.lower(F.coalesce(df[text], F.lit(""))), F.lit("[a-z]+"), F.lit(0)))
    return df.select(df[key], words.alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))


def occurrences(text: Column, token: Column) -> Column:
    """How often token stands in text as a substring, without overlaps."""
    return (F.length(text) - F.length(F.replace(text, token, F.lit("")))) / F.length(token)


def rejoin(pages: DataFrame, doc: str, key: str, text: str, least: int = 5, ratio: float = 4.0) -> DataFrame:
    """Words torn by a blank joined again where the document's own counts say so: key, text.

    Only the counts of the pairs that stand in a page travel to it: one row per page, made by joining the
    page's neighbouring words with the document's vocabulary, so no document is gathered whole.
    """
    base = pages.select(pages[doc].alias("_d"), pages[key].alias("_k"), pages[text].alias("_t"))
    counts = vocabulary(base, "_d", "_t")
    words = F.regexp_extract_all(F.lower(F.coalesce("_t", F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    pairs = base.select("_d", "_k", F.explode(F.arrays_zip(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))).alias("a"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("b"))).alias("p"))
    pairs = pairs.select("_d", "_k", F.col("p.a").alias("a"), F.col("p.b").alias("b")).where("length(a) >= 2 and length(b) <= 2").distinct()
    whole = counts.select("_d", F.col("word").alias("w"), F.col("n").alias("joined"))
    head = counts.select("_d", F.col("word").alias("a"), F.col("n").alias("heads"))
    met = pairs.withColumn("w", F.concat("a", "b")).join(whole, ["_d", "w"]).join(head, ["_d", "a"])
    good = met.where((F.col("joined") >= least) & (F.col("joined") >= ratio * F.greatest("heads", F.lit(1)))).groupBy("_k").agg(F.collect_set(F.concat_ws(" ", "a", "b")).alias("good"))

    @F.pandas_udf(StringType())
    def apply(t: pd.Series, g: pd.Series) -> pd.Series:
        import re

        def one(s, good):
            if s is None or good is None or not len(good):
                return s
            ok = set(good)
            out, at, done = [], 0, -1
            found = list(re.finditer(r"[A-Za-z]+", s))
            for x, y in zip(found, found[1:]):
                if x.start() < done:
                    continue
                if s[x.end() : y.start()] == " " and f"{x[0].lower()} {y[0].lower()}" in ok:
                    out += [s[at : x.end()]]
                    at, done = y.start(), y.end()
            return "".join([*out, s[at:]])

        return pd.Series([one(a, b) for a, b in zip(t, g)])

    return base.join(good, "_k", "left").select(F.col("_k").alias(key), apply("_t", "good").alias(text))
