"""Ranked search over an index, and lookup by citation."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, WORD, content_tokens, occurrences
from .index import Index

K1, B = 1.5, 0.75
# What a matching phrase, citation, heading or definition is worth.
PHRASE, TOGETHER, CITED, HEADING, DEFINED = 2.5, 1.6, 4.0, 0.6, 1.8
MOST_REPEATS = 3


@dataclass
class Query:
    """A question taken apart: its content words, quoted phrases and citation."""

    text: str

    @property
    def words(self) -> list[str]:
        return [w for w in re.findall(WORD, self.text.lower()) if w not in STOPWORDS]

    @property
    def phrases(self) -> list[str]:
        return [p.lower() for p in re.findall(r'"([^"]{3,80})"', self.text)]

    @property
    def section(self) -> str | None:
        m = re.search(r"(?i)\b(?:sections?|ss?)\s+(\d+[A-Za-z]{0,3})", self.text)
        return m[1] if m else None


def bm25(index: Index, query: Query, k1: float = K1, b: float = B) -> DataFrame:
    """The records that hold a word of the query, with score and first_word; weights come from all records.

    The words' frequencies (a row a word) and the two totals of the collection are read first and stand in the
    plan as numbers. Then one scan of the postings, with the words as its filter, finds the candidates, and one
    of the records scores them. The count of a word is its count as a substring of text and heading plus one.
    """
    counted = Counter(query.words)
    order = list(dict.fromkeys(query.words))
    df = {r["token"]: r["df"] for r in index.frequencies().where(F.col("token").isin(order)).collect()} if order else {}
    n, average = index.totals()
    hits = index.postings.where(F.col("token").isin(list(df)) if df else F.lit(False)).select("token", "position")
    per = hits.groupBy("position").agg(F.collect_set("token").alias("_tokens"))  # at most the query's words
    text, heading = F.lower("text"), F.lower(F.coalesce("heading", F.lit("")))
    score, first = F.lit(0.0), F.lit(len(order))
    for i, w in reversed(list(enumerate(order))):
        if w in df:
            idf = math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * min(counted[w], MOST_REPEATS)
            tf = occurrences(text, F.lit(w)) + occurrences(heading, F.lit(w)) + 1
            norm = tf + k1 * (1 - b + b * F.greatest("token_count", F.lit(1)) / F.lit(average))
            held = F.array_contains("_tokens", w)
            score = score + F.when(held, idf * tf * (k1 + 1) / norm).otherwise(0.0)
            first = F.when(held, i).otherwise(first)
    return index.records.join(per, "position").withColumn("score", score).withColumn("first_word", first).drop("_tokens")


def _filters(df: DataFrame, jurisdiction: str | None, act: str | None, kind: str | None) -> DataFrame:
    if jurisdiction:
        df = df.where(F.lower("jurisdiction") == jurisdiction.lower())
    if act:
        df = df.where(F.lower("act").contains(act.lower()))
    if kind:
        df = df.where(F.col("kind") == kind)
    return df


def boosts(query: Query) -> list[tuple[Column, Column, Column]]:
    """(condition, factor, reason) of each boost, in order, over the columns of a record."""
    text, heading = F.lower("text"), F.coalesce("heading", F.lit(""))
    words = list(dict.fromkeys(query.words))
    array = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    shared = F.size(F.array_intersect(content_tokens(heading), array))
    out = [(text.contains(p), F.lit(PHRASE), F.lit(f'phrase "{p}"')) for p in query.phrases]
    if len(query.words) > 1:
        out.append((text.contains(" ".join(query.words)), F.lit(TOGETHER), F.lit("all words together")))
    if query.section:
        out.append((F.col("section") == query.section, F.lit(CITED), F.lit(f"section {query.section}")))
    if words:
        out.append((shared >= min(2, len(words)), 1 + HEADING * shared, F.lit("heading")))
        out.append(((F.col("kind") == "definition") & F.exists(array, lambda w: F.contains(F.lower(heading), w)), F.lit(DEFINED), F.lit("definition")))
    return out


def search(index: Index, question: str, limit: int = 8, jurisdiction: str | None = None, act: str | None = None, kind: str | None = None) -> DataFrame:
    """The best records: position, address, act, heading, text, score (4 places), reasons; ties by first word, then position."""
    query = Query(question)
    rows = _filters(bm25(index, query), jurisdiction, act, kind)
    score, reasons = F.col("score"), []
    for condition, factor, reason in boosts(query):
        holds = F.coalesce(condition, F.lit(False))
        score = score * F.when(holds, factor).otherwise(1.0)
        reasons.append(F.when(holds, reason))
    words = F.array_sort(F.array_distinct(F.array(*[F.lit(w) for w in query.words]))) if query.words else F.array().cast("array<string>")
    present = F.slice(F.filter(words, lambda w: F.contains(F.lower(F.concat_ws(" ", "heading", "text")), w)), 1, 5)
    fallback = F.array(F.concat(F.lit("words: "), F.array_join(present, ", ")))
    given = F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>")
    rows = rows.withColumn("score", F.round(score, 4)).withColumn("reasons", F.when(F.size(given) > 0, given).otherwise(fallback))
    best = rows.orderBy(F.desc("score"), "first_word", "position").limit(limit)
    return best.select("position", "address", "act", "jurisdiction", "currency", "source", "context", "heading", "text", "score", "reasons")


def by_citation(records: DataFrame, act: str, section: str, subsection: str | None = None) -> DataFrame:
    """Records of the acts whose name contains act, at the section (and subsection), in index order."""
    rows = records.where(F.lower("act").contains(act.lower()) & (F.col("section") == section))
    return rows.where(F.col("subsection") == subsection) if subsection is not None else rows
