"""Inverted index as tables: records, postings, terms, sources, skipped, meta."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import content_tokens
from ..runtime import materialize, ordinal

LEAST_CHARACTERS = 12
#: How the tables of a saved index are laid out; a reader of another layout refuses it.
FORMAT = 2


@dataclass
class Index:
    """The tables of an index. records: with token_count; postings: token, position, tf; terms: token, df."""

    records: DataFrame
    postings: DataFrame
    terms: DataFrame | None = None  # once the index is stored
    sources: DataFrame | None = None
    skipped: DataFrame | None = None
    tokens: DataFrame | None = None  # position, tokens: there while the index is being built
    built: str = ""
    held: dict = field(default_factory=dict)

    @property
    def doc_len(self) -> DataFrame:
        """position and len, in words that count."""
        return self.records.select("position", F.col("token_count").alias("len"))

    def frequencies(self) -> DataFrame:
        """token and df, the number of records it stands in."""
        if self.terms is not None:
            return self.terms
        rows = self.postings.select("token") if self.tokens is None else self.tokens.select(F.explode(F.array_distinct("tokens")).alias("token"))
        return rows.groupBy("token").agg(F.count(F.lit(1)).alias("df"))

    def stats(self) -> DataFrame:
        """n and avg_len over all records, one row."""
        return self.doc_len.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg_len"))

    def totals(self) -> tuple[int, float]:
        """n and avg_len as numbers, read once an index."""
        if "totals" not in self.held:
            self.held["totals"] = tuple(self.stats().first())
        return self.held["totals"]


def indexable(records: DataFrame) -> DataFrame:
    """Records with enough text to be found by it."""
    return records.where(F.length(F.trim(F.col("text"))) >= LEAST_CHARACTERS)


def build(records: DataFrame, sources: DataFrame | None = None, skipped: DataFrame | None = None) -> Index:
    """Index over records (position, text, heading and more). One pass tokenises; postings carry the token count."""
    rows = indexable(records)
    tokens = content_tokens(F.concat_ws(" ", "heading", "text"))
    words = rows.select("position", tokens.alias("tokens"))
    # Counting within the record needs no shuffle of its own key: position and token go together.
    postings = words.select("position", F.explode("tokens").alias("token")).groupBy("token", "position").agg(F.count(F.lit(1)).alias("tf"))
    return Index(rows.withColumn("token_count", F.size(tokens)), postings, None, sources, skipped, words, datetime.now(UTC).strftime("%Y-%m-%d %H:%M UTC"))


def stored(index: Index) -> Index:
    """The index with its tables written once, for operators that read them several times: texts are taken apart once."""
    records, postings = materialize(index.records, "indexed"), materialize(_by_token(index.postings), "postings")
    return Index(records, postings, materialize(postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "terms"), index.sources, index.skipped, built=index.built)


def _by_token(postings: DataFrame) -> DataFrame:
    """Laid out by token, so that a query reads only its tokens' row groups."""
    return postings.repartitionByRange("token").sortWithinPartitions("token", "position")


def save(index: Index, path: str) -> None:
    """Writes the tables below path, with the time of building and the format."""
    spark = index.records.sparkSession
    index.records.write.mode("overwrite").parquet(f"{path}/records")
    _by_token(index.postings).write.mode("overwrite").parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("token").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(f"{path}/terms")
    spark.createDataFrame([(FORMAT, index.built)], "format int, built string").write.mode("overwrite").parquet(f"{path}/meta")
    for name in ("sources", "skipped"):
        if getattr(index, name) is not None:
            getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str) -> Index:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    meta = read("meta").first()
    if meta["format"] != FORMAT:
        raise ValueError(f"the index at {path} has format {meta['format']}, not {FORMAT}")
    out = Index(read("records"), read("postings"), read("terms"), built=meta["built"])
    for name in ("sources", "skipped"):
        try:
            setattr(out, name, read(name))
        except Exception:  # the table was not written
            pass
    return out


TABLES = ["records", "postings", "terms", "sources", "skipped"]


def export_json(index: Index, path: str) -> None:
    """Every table as JSON lines below path, one object a row, with the schemas and the time of building beside them."""
    schemas = []
    for name in TABLES:
        df = index.frequencies() if name == "terms" else getattr(index, name)
        if df is not None:
            df.write.mode("overwrite").json(f"{path}/{name}")
            schemas.append((name, df.schema.json(), index.built, FORMAT))
    spark = index.records.sparkSession
    spark.createDataFrame(schemas, "name string, schema string, built string, format int").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def import_json(spark: SparkSession, path: str) -> Index:
    """The index of an export; a field that is absent is null."""
    held, built = {}, ""
    for r in spark.read.schema("name string, schema string, built string, format int").json(f"{path}/meta").collect():  # a row a table
        if r["format"] != FORMAT:
            raise ValueError(f"the export at {path} has format {r['format']}, not {FORMAT}")
        held[r["name"]] = spark.read.schema(StructType.fromJson(json.loads(r["schema"]))).json(f"{path}/{r['name']}")
        built = r["built"]
    return Index(**held, built=built)


def index_stats(index: Index) -> DataFrame:
    """provisions, acts, distinct_terms and the time of building (built) in one row."""
    a = index.records.agg(F.count(F.lit(1)).alias("provisions"), F.count_distinct("act").alias("acts"))
    b = index.frequencies().agg(F.count(F.lit(1)).alias("distinct_terms"))
    return a.crossJoin(b).withColumn("built", F.lit(index.built))  # one row each


def count_by(index: Index, column: str) -> DataFrame:
    return index.records.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("provisions"))


def sources_of(records: DataFrame, documents: DataFrame) -> DataFrame:
    """One row per source file: act, jurisdiction, currency, profile, path, sections, indexed, warnings."""
    counts = records.groupBy(F.col("source").alias("path")).agg(F.count_if(F.col("kind") == "section").alias("sections"), F.count_if(F.length(F.trim("text")) >= LEAST_CHARACTERS).alias("indexed"))
    once = documents.withColumn("_r", F.row_number().over(Window.partitionBy("path").orderBy("doc_ord"))).where("_r = 1 and path is not null")
    return once.join(counts, "path", "left").select(
        F.col("title").alias("act"), "jurisdiction", F.col("currency_text").alias("currency"), "profile", "path", F.coalesce("sections", F.lit(0)).alias("sections"), F.coalesce("indexed", F.lit(0)).alias("indexed"), "warnings"
    )


def numbered(df: DataFrame, doc: str, *order: str) -> DataFrame:
    """df with position from 0 in the order (doc, order), by per-document numbers and prefix sums over ranges of documents."""
    before = ordinal(df.groupBy(doc).agg(F.count(F.lit(1)).alias("_n")), doc, "_before", "_n").drop("_n")
    within = F.row_number().over(Window.partitionBy(doc).orderBy(*order)) - 1
    return df.withColumn("_w", within).join(before, doc).withColumn("position", F.col("_before") + F.col("_w")).drop("_w", "_before")
