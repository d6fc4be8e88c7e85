"""The whole pipeline: files to pages, documents, provisions, records, index and edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect
from ..functions.text import rejoin
from ..operators import index as ix
from ..operators import structure, threads
from ..runtime import materialize, scratch
from ..sources import files


def documents_of(pages: DataFrame, profile: str | None = None) -> DataFrame:
    """doc_ord, path, title, profile, jurisdiction, year, act_number, currency_text, currency_date, warnings.

    profile names one layout for all documents instead of the one each shows. pages may say by changed on
    which of them torn words were joined again.
    """
    head = detect.heads(pages, "doc_ord", "page_no", "page_text")
    wide = detect.heads(pages, "doc_ord", "page_no", "page_text", 60).withColumnRenamed("head", "_wide")
    paths = pages.select("doc_ord", "path").distinct()
    joined = F.count_if("changed") if "changed" in pages.columns else F.lit(0)
    length = pages.groupBy("doc_ord").agg(F.sum(F.length("page_text")).alias("_len"), joined.alias("_joined"))
    titles = detect.guessed_titles(pages, "doc_ord", "page_no", "page_text", paths)
    rows = paths.join(head, "doc_ord").join(wide, "doc_ord").join(length, "doc_ord").join(titles, "doc_ord")
    rows = rows.withColumn("profile", F.lit(detect.profile_of(profile).key) if profile else detect.profile(F.col("head"), F.col("path")))
    rows = rows.withColumn("currency_text", F.coalesce(detect.currency(F.col("head")), detect.currency(F.col("_wide"))))
    year = F.coalesce(F.nullif(F.regexp_extract("head", detect.ACT_NUMBER, 2), F.lit("")), F.nullif(F.regexp_extract("title", rf"\b({detect.YEAR})\b", 1), F.lit("")))
    return rows.select(
        "doc_ord", "path", "title", "profile", detect.mapped(F.col("profile"), detect.JURISDICTION, "Unknown").alias("jurisdiction"), year.cast("int").alias("year"),
        F.nullif(F.regexp_extract("head", detect.ACT_NUMBER, 1), F.lit("")).alias("act_number"), "currency_text", detect.currency_date(F.col("currency_text")).alias("currency_date"),
        detect.warnings(F.col("_len"), F.col("profile"), F.col("head"), F.col("currency_text"), F.col("_joined")).alias("warnings"),
    )


def records_of(pages: DataFrame, documents: DataFrame, parity: bool = False) -> DataFrame:
    """Provisions as records; a section carries the text of its parts."""
    found = materialize(structure.provisions(pages, documents.select("doc_ord", "title", "profile"), parity), "provisions")
    full = structure.full_texts(found).withColumn("kind", F.lit("section"))
    rows = found.join(full, ["doc_ord", "address", "kind"], "left").withColumn("text", F.coalesce("full_text", "text"))
    rows = ix.indexable(rows.join(documents.select("doc_ord", "title", "jurisdiction", "currency_text", "path"), "doc_ord"))
    rows = ix.numbered(rows.withColumn("_late", F.col("kind") == "definition"), "doc_ord", "_late", "node_ord")
    return rows.select("position", F.col("position").cast("string").alias("uid"), "text", "address", F.col("title").alias("act"), "jurisdiction", "kind", "section", "subsection", "paragraph", "context", "heading", F.col("currency_text").alias("currency"), "page", F.col("path").alias("source"))


def build_index(spark: SparkSession, paths: list[str], out: str, parity: bool = False, profile: str | None = None, on_progress: Callable[[str, str, int], None] | None = None, on_skip: Callable[[str, str], None] | None = None) -> ix.Index:
    """Reads files, writes the index tables and the edges below out, and returns the index as stored.

    A file that cannot be read is set aside and never stops the others: on_skip(path, reason) is told of each, and
    on_progress(path, act, provisions indexed) of every other, file by file, once the index is written.
    """
    with scratch(spark):
        read = materialize(files.read_pages(spark, paths), "pages")
        numbered = files.with_doc_ord(read)
        whole = rejoin(numbered, "doc_ord", "page_id", "page_text").withColumnRenamed("page_text", "_whole")
        pages = numbered.join(whole, "page_id").withColumn("changed", F.col("page_text") != F.col("_whole")).drop("page_text").withColumnRenamed("_whole", "page_text")
        pages = materialize(pages, "rejoined")
        documents = materialize(documents_of(pages, profile), "documents")
        report = structure.parse_report(structure.provisions(pages, documents.select("doc_ord", "title", "profile"), parity), documents)
        told = documents.join(report.select("doc_ord", F.filter(F.split("warnings", "; "), lambda w: w != "").alias("_more")), "doc_ord")
        documents = materialize(told.withColumn("warnings", F.concat("warnings", "_more")).drop("_more"), "told")
        records = materialize(records_of(pages, documents, parity), "records")
        ix.save(ix.build(records, ix.sources_of(records, documents), files.skipped(read)), out)
        threads.edges(records).write.mode("overwrite").parquet(f"{out}/edges")
    index = ix.load(spark, out)
    if on_skip:
        for r in index.skipped.orderBy("path").toLocalIterator():
            on_skip(r["path"], r["reason"])
    if on_progress:
        for r in index.sources.orderBy("path").toLocalIterator():
            on_progress(r["path"], r["act"], r["indexed"])
    return index
