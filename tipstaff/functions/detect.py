"""What a document's own words say about it: layout, title, number, currency, warnings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Date notices in order of priority.
_DATE = r"(\d{1,2}\s+\w+\s+\d{4})"
CURRENCY = [
    r"(?i)This compilation was prepared on\s+" + _DATE,
    r"(?i)Compilation date:\s*" + _DATE,
    r"(?i)Reprint\s+\d+[A-Z]?\s+effective\s+" + _DATE,
    r"(?i)Reprinted as in force on\s+" + _DATE,
    r"(?i)Current as at\s+" + _DATE,
    r"(?i)in force (?:on|at)\s+" + _DATE,
]
# How numbers, disclaimers and titles are written.
ACT_NUMBER = r"(?i)\bAct\s+No\.\s*(\d+)\s+of\s+(\d{4})\b"
NUMBERED = r"\bAct No\.\s*\d+\s*of\s*\d{4}\b"
DISCLAIMED = r"(?i)not an authoris(?:ed|ing) copy|unauthorised version|this reprint is not"
KINDS = r"(?:Act|Regulations?|Code|Rules|Ordinance)"
YEAR = r"(?:1[89]\d{2}|20\d{2})"
TITLE = rf"^[A-Z][A-Za-z0-9_'()&,\-]*(?: [A-Za-z0-9_'()&,\-]+){{0,12}} {KINDS}(?: \(\w{{2,3}}\))? {YEAR}$"
TITLE_UNDATED = rf"^[A-Z][A-Za-z0-9_'()&,\-]*(?: [A-Za-z0-9_'()&,\-]+){{2,12}} {KINDS}$"
# What drafting offices print on a page beside the law, over lines with single blanks. All offices share the first.
PAGE_MARKS = r"Page \d+(?: of \d+)?|- \d+ -|\d{1,4}(?: \|)?|Authorised (?:copy|version|by)\b.*|Printed from .*"
OFFICE_MARKS = {
    "cth": r"Section \d+[A-Z]{0,3}|ComLaw Authoritative Act\b.*|Authorised Version\b.*|Federal Register of Legislation\b.*|Compilation No\..*|Registered:.*|Prepared by the Office of Parliamentary Counsel\b.*|This compilation was prepared\b.*",
    "qld": r"\[s ?\d+[A-Z]{0,3}\]|(?:Page \d+ )?Reprint \d+[A-Z]? effective\b.*|Page \d+ Reprint\b.*|Current as at\b.*|Authorised by the Parliamentary Counsel\b.*",
    "generic": "",
}


@dataclass(frozen=True)
class Profile:
    """The layout of one drafting office: its key, the jurisdiction it stands for, and the pattern of its page furniture."""

    key: str
    jurisdiction: str
    furniture: str


PROFILES = {k: Profile(k, j, "(?i)^(?:" + "|".join(filter(None, (PAGE_MARKS, OFFICE_MARKS[k]))) + ")$") for k, j in (("cth", "Commonwealth"), ("qld", "Queensland"), ("generic", "Unknown"))}
JURISDICTION = {k: p.jurisdiction for k, p in PROFILES.items()}


def profile_of(key: str | None) -> Profile:
    """The profile of a key in any case; generic for null, empty and unknown keys."""
    return PROFILES.get((key or "").lower(), PROFILES["generic"])


def is_furniture(line: Column, key: Column) -> Column:
    """Whether a line with single blanks is page furniture in the layout of that key."""
    known = F.lower(F.coalesce(key, F.lit("")))
    return F.when(known == "cth", line.rlike(PROFILES["cth"].furniture)).when(known == "qld", line.rlike(PROFILES["qld"].furniture)).otherwise(line.rlike(PROFILES["generic"].furniture))


# The official registers of each jurisdiction.
REGISTERS = {
    "Commonwealth": "https://www.legislation.gov.au/",
    "New South Wales": "https://legislation.nsw.gov.au/",
    "Victoria": "https://www.legislation.vic.gov.au/",
    "Queensland": "https://www.legislation.qld.gov.au/",
    "Western Australia": "https://www.legislation.wa.gov.au/",
    "South Australia": "https://www.legislation.sa.gov.au/",
    "Tasmania": "https://www.legislation.tas.gov.au/",
    "Australian Capital Territory": "https://www.legislation.act.gov.au/",
    "Northern Territory": "https://legislation.nt.gov.au/",
}


def mapped(c: Column, table: dict[str, str], otherwise: str) -> Column:
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), F.lit(otherwise))


def profile(head: Column, path: Column) -> Column:
    """The layout a document follows: qld, cth or generic. Notices count in any case, "Act No." as printed."""
    name = F.lower(F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/]*)$", 1))
    head = F.coalesce(head, F.lit(""))
    return (
        F.when(name.startswith("qld") | name.contains(" qld ") | name.contains("queensland"), "qld")
        .when(head.rlike(r"\[s\s*\d+[A-Z]{0,3}\]|(?i:Reprint\s+\d+[A-Z]?\s+effective)"), "qld")
        .when(head.rlike("(?i)ComLaw|Office of Parliamentary Counsel, Canberra|Federal Register of Legislation"), "cth")
        .when(head.rlike(NUMBERED) & head.rlike("(?i)This compilation was prepared"), "cth")
        .otherwise("generic")
    )


def currency(head: Column) -> Column:
    """The first date notice by priority, null if none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(F.coalesce(head, F.lit("")), p, 1), F.lit("")) for p in CURRENCY])


def currency_date(text: Column) -> Column:
    return F.to_date(F.try_to_timestamp(text, F.lit("d MMMM yyyy")))


def heads(pages: DataFrame, doc: str, page: str, text: str, n: int = 3) -> DataFrame:
    """doc and head: the first n pages of each document, joined by line ends."""
    ranked = pages.withColumn("_n", F.row_number().over(Window.partitionBy(doc).orderBy(page))).where(F.col("_n") <= n)
    return ranked.groupBy(doc).agg(F.expr(f"listagg(coalesce(`{text}`, ''), '\n') within group (order by `{page}`)").alias("head"))


def guessed_titles(pages: DataFrame, doc: str, page: str, text: str, path: DataFrame | None = None) -> DataFrame:
    """doc and title: the title-shaped line on most pages, dated before undated, then the longest, then the first seen.

    It must stand on at least max(3, pages/12) pages; else the file's name (path: doc, path) stands in.
    """
    total = pages.groupBy(doc).agg(F.count_distinct(page).alias("_pages"))
    lines = pages.select(doc, page, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("_at", "_line"))
    plain = F.trim(F.regexp_replace("_line", r"\s+", " "))
    lines = lines.select(doc, page, "_at", plain.alias("_line")).where(~F.col("_line").rlike(r"\.{4,}|(?:\. ){4,}") & (F.length("_line") > 5))
    tries = F.array(F.col("_line"), F.regexp_replace("_line", r"(?i)^(?:\d{1,4}|[ivxlc]{1,6}) ", ""), F.regexp_replace("_line", r"(?i) (?:\d{1,4}|[ivxlc]{1,6})$", ""))
    fits = lambda t: (t.rlike(TITLE) | t.rlike(TITLE_UNDATED)) & (F.length(F.regexp_replace(t, r"[^(]", "")) == F.length(F.regexp_replace(t, r"[^)]", "")))
    found = lines.withColumn("title", F.get(F.filter(tries, fits), 0))
    found = found.where("title is not null").withColumn("dated", F.col("title").rlike(TITLE))
    per = found.groupBy(doc, "title", "dated").agg(F.count_distinct(page).alias("n"), F.min(F.struct(page, "_at")).alias("first"))
    good = per.join(total, doc).where(F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("_pages") / 12)))
    rank = Window.partitionBy(doc).orderBy(F.desc("n"), F.desc("dated"), F.desc(F.length("title")), "first", "title")
    best = good.withColumn("_r", F.row_number().over(rank)).where("_r = 1").select(doc, "title")
    if path is None:
        return best
    stem = F.regexp_replace(F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", ""), "[_-]", " ")
    return path.join(best, doc, "left").select(doc, F.coalesce("title", stem).alias("title"))


def warnings(text_length: Column, profile_key: Column, head: Column, currency_text: Column, rejoined: Column | None = None) -> Column:
    """What a reader of the document should know before relying on it. rejoined: pages on which torn words were joined."""
    joined = F.lit(0) if rejoined is None else F.coalesce(rejoined, F.lit(0))
    return F.array_compact(
        F.array(
            F.when(joined > 0, F.concat(F.lit("torn words joined again on "), joined.cast("string"), F.lit(" pages"))),
            F.when(text_length == 0, "no text: the pages may be images"),
            F.when(profile_key == "generic", "layout not recognised"),
            F.when(head.rlike(DISCLAIMED), "the source says it is not authorised"),
            F.when(currency_text.isNull(), "no currency date found"),
        )
    )
