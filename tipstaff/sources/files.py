"""Files to pages: text, HTML and PDF, with unreadable files set aside and never stopping a batch."""

from __future__ import annotations

import glob
import io
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean, strip_tags
from ..runtime import ordinal, ship

PAGES = "path string, page_no int, page_text string, error string"


def kind_of(path: Column) -> Column:
    """pdf, html or text, by the lower-cased suffix; anything unknown is text."""
    name = F.lower(path)
    return F.when(name.rlike(r"\.pdf$"), "pdf").when(name.rlike(r"\.(?:html?|xhtml)$"), "html").otherwise("text")


def expand(patterns: list[str]) -> tuple[list[str], list[str]]:
    """(paths, patterns that match nothing): each pattern's matches sorted, a literal path as it is."""
    found, missing = [], []
    for p in patterns:
        hits = sorted(glob.glob(p)) or ([p] if os.path.exists(p) else [])
        found += hits
        if not hits:
            missing.append(p)
    return found, missing


def pdf_pages(content: bytes) -> list[str]:
    """Text of each page; a page that cannot be read is empty. Needs the optional pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs the optional package pypdf") from e
    out = []
    for page in PdfReader(io.BytesIO(content)).pages:
        try:
            out.append(page.extract_text() or "")
        except Exception:  # one bad page does not spoil the file
            out.append("")
    return out


def read_pages(spark: SparkSession, paths: list[str] | str, tidy: bool = True) -> DataFrame:
    """path, page_no (from 1), page_text, error of every page; a file that fails gives one row with its error.

    Text is split at form feeds, an HTML file is one page. A named file that does not exist is an error at once.
    """
    ship(spark)
    paths = [paths] if isinstance(paths, str) else list(paths)
    for p in paths:
        if "://" not in p and not glob.has_magic(p) and not os.path.exists(p):
            raise FileNotFoundError(p)
    files = spark.read.format("binaryFile").load(paths).select("path", "content").withColumn("kind", kind_of(F.col("path")))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content, kind in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    pages = pdf_pages(content) if kind == "pdf" else content.decode("utf-8", "replace").split("\f") if kind == "text" else [content.decode("utf-8", "replace")]
                    rows += [(path, i + 1, t, None) for i, t in enumerate(pages)]
                except Exception as e:
                    reason = str(e)
                    rows.append((path, None, None, "the file is encrypted" if "encrypt" in reason.lower() or "decrypt" in reason.lower() else reason))
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))], names=["path", "page_no", "page_text", "error"])

    pages = files.mapInArrow(decode, PAGES)
    text = F.when(kind_of(F.col("path")) == "html", strip_tags(F.col("page_text"))).otherwise(F.col("page_text"))
    return pages.select("path", "page_no", F.when(F.col("page_text").isNotNull(), clean(text) if tidy else text).alias("page_text"), "error")


def skipped(pages: DataFrame) -> DataFrame:
    """path and reason of the files that could not be read."""
    return pages.where("error is not null").select("path", F.col("error").alias("reason"))


def with_doc_ord(pages: DataFrame) -> DataFrame:
    """pages of readable files with doc_ord (order of paths, from 0) and page_id, which no two pages share."""
    order = ordinal(pages.where("error is null").select("path").distinct(), "path", "doc_ord").withColumn("doc_ord", F.col("doc_ord").cast("int"))
    return pages.where("error is null").join(order, "path").withColumn("page_id", F.shiftleft(F.col("doc_ord").cast("bigint"), 32) + F.col("page_no"))
