"""Words of everyday questions to words of drafting, and related terms from the collection itself."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .index import Index
from .search import Query

# Our own list: what people say, and the terms drafters use for it.
BRIDGE = {
    "rent": ["lease", "tenancy agreement"],
    "landlord": ["lease holder", "holder"],
    "tenant": ["lessee"],
    "boat": ["vessel", "mooring"],
    "ship": ["vessel"],
    "car": ["parking", "driveway"],
    "fine": ["penalty", "offence"],
    "crime": ["offence"],
    "rule": ["regulation"],
    "paper": ["instrument", "certificate"],
    "permission": ["permit", "licence", "consent"],
    "pay": ["fee", "levy"],
    "tax": ["levy"],
    "job": ["employment"],
    "boss": ["supervision", "director"],
    "cancel": ["revoke", "suspend"],
    "stop": ["prohibit", "suspend"],
    "house": ["tenure", "township"],
    "land": ["allotment", "easement"],
    "court": ["tribunal"],
    "judge": ["tribunal"],
    "letter": ["notice"],
    "time": ["period", "days"],
    "change": ["amend", "vary"],
    "store": ["warehouse"],
    "keep": ["retain", "preserve"],
    "check": ["inspect", "audit"],
    "ask": ["apply", "application"],
    "owner": ["proprietor", "holder"],
    "shop": ["premises", "kiosk"],
}


@dataclass
class Expansion:
    original: str
    added: list[str] = field(default_factory=list)
    reasons: dict[str, str] = field(default_factory=dict)

    @property
    def changed(self) -> bool:
        return bool(self.added)

    def as_query(self) -> str:
        return " ".join([self.original, *self.added])

    def describe(self) -> str:
        return "Also searched: " + ", ".join(f"{t} ({self.reasons[t]})" for t in self.added) if self.added else ""


def lexicon(spark: SparkSession) -> DataFrame:
    """The bridge as a table: plain, term, ord."""
    return spark.createDataFrame([(p, t, i) for p, ts in BRIDGE.items() for i, t in enumerate(ts)], "plain string, term string, ord int")


def bridged(index: Index, question: str) -> DataFrame:
    """plain, term, ord of the bridge terms a question calls for and whose first word stands in the index."""
    words = list(dict.fromkeys(Query(question).words))
    spark = index.records.sparkSession
    wanted = lexicon(spark).where(F.col("plain").isin(words) & ~F.contains(F.lit(question.lower()), F.col("term")))
    first = F.broadcast(wanted.withColumn("token", F.split("term", " ")[0]))  # a few rows of a fixed list
    present = index.frequencies().select("token")
    return present.join(first, "token").select("plain", "term", "ord")


def expand(index: Index, question: str, wider: bool = False) -> Expansion:
    """The question with the terms it stands for; wider adds up to two related terms a word from the collection."""
    out = Expansion(question)
    words = list(dict.fromkeys(Query(question).words))
    found = bridged(index, question).collect()  # at most the bridge's rows
    for r in sorted(found, key=lambda r: (words.index(r["plain"]), r["ord"])):
        if r["term"] not in out.added:
            out.added.append(r["term"])
            out.reasons[r["term"]] = f"drafting term for {r['plain']}"
    if wider:
        asked = [w for w in words if w not in BRIDGE]
        for r in sorted(related(index, asked, limit=2).collect(), key=lambda r: (words.index(r["word"]), -r["similarity"], r["token"])) if asked else []:
            if r["token"] not in out.added and not re.search(rf"\b{re.escape(r['token'])}\b", question.lower()):
                out.added.append(r["token"])
                out.reasons[r["token"]] = f"used like {r['word']}"
    return out


def related_terms(index: Index, word: str, limit: int = 4, **bounds) -> DataFrame:
    """token, similarity: terms whose company resembles the word's own, best first."""
    return related(index, [word], limit, **bounds).select("token", "similarity").orderBy(F.desc("similarity"), "token")


def related(index: Index, words: list[str], limit: int = 4, least: int = 8, share: float = 0.05, sample: int = 300, candidates: int = 30, similarity: float = 0.5) -> DataFrame:
    """word, token, similarity: for each word at most limit terms whose company resembles its own.

    The company of a word is the document frequency of its neighbours over its first `sample` records; only
    the best `candidates` neighbours are compared, which is the operator's definition and bounds its joins.
    All words are answered by one plan.
    """
    p = index.postings.select("token", "position")
    total = index.totals()[0]
    df = index.frequencies()

    def company(terms: DataFrame) -> DataFrame:
        """term, token, n: neighbours of each term (a bounded list) in its first records."""
        its = p.join(F.broadcast(terms.withColumnRenamed("token", "term")), p["token"] == F.col("term")).select("term", "position")
        first = its.withColumn("_r", F.row_number().over(Window.partitionBy("term").orderBy("position"))).where(F.col("_r") <= sample).drop("_r")
        return first.join(p, "position").where(F.col("token") != F.col("term")).groupBy("term", "token").agg(F.count(F.lit(1)).alias("n"))

    spark = index.records.sparkSession
    own = company(spark.createDataFrame([(w,) for w in words], "token string").join(df.where(F.col("df") >= least), "token", "left_semi"))
    own = own.select(F.col("term").alias("word"), "token", F.col("n").alias("m"))
    fit = own.join(df, "token").where((F.col("df") >= least) & (F.col("df") <= share * total) & (F.length("token") >= 4) & ~F.col("token").rlike("^[0-9]+$"))
    top = fit.withColumn("_r", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("m"), "token"))).where(F.col("_r") <= candidates)
    top = top.select("word", F.col("token").alias("term"), F.col("m").alias("drop"))
    theirs = company(top.select(F.col("term").alias("token")).distinct())
    # the candidate's own row and the word's row are no evidence of alike company
    pair = top.join(theirs, "term").where(F.col("token") != F.col("word")).join(own, ["word", "token"], "left")
    dot = pair.groupBy("word", "term", "drop").agg(F.sum(F.col("n") * F.coalesce("m", F.lit(0))).alias("dot"), F.sum(F.col("n") * F.col("n")).alias("b"))
    out = dot.join(own.groupBy("word").agg(F.sum(F.col("m") * F.col("m")).alias("a")), "word")
    cosine = F.round(F.col("dot") / F.sqrt((F.col("a") - F.col("drop") * F.col("drop")) * F.col("b")), 3)
    out = out.select("word", F.col("term").alias("token"), cosine.alias("similarity")).where(F.col("similarity") >= similarity)
    return out.withColumn("_r", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("similarity"), "token"))).where(F.col("_r") <= limit).drop("_r")
