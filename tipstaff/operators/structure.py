"""Pages to provisions: lines are classified, then running windows per document carry what each line is under.

Precedence of the kinds: page furniture, contents pages, headings above the section, section starts,
subsections, paragraphs and subparagraphs, definitions, continuation. Differences from a plain state
machine, taken on purpose: headings come before furniture, so a one-line "Part 2 Name" sets the context; a
subparagraph keeps its own text; and a marker such as (c) or (i) that follows (b) or (h) is a paragraph.
parity=True gives the state machine's reading of such headings and markers instead. A number beside the title
is furniture by the title (see banner): as a shape alone it cannot be told from a section and its heading.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import detect
from ..functions.text import has_leader, is_mostly_upper

# How headings, sections and their parts are numbered.
LEVELS = ["chapter", "part", "division", "subdivision"]
HEADINGS = {"schedule": r"(?i)^Schedule (\w+)\b", "chapter": r"(?i)^Chapter (\w+)\b", "part": r"(?i)^Part ([\dIVXLC]+[A-Z]*)\b", "division": r"(?i)^Division (\w+)\b", "subdivision": r"(?i)^Subdivision (\w+)\b"}
SECTION = r"^(\d+[A-Z]{0,3}) ([A-Z].{2,120})$"
SUBSECTION, PARAGRAPH, ROMAN = r"^\((\d+[A-Z]{0,3})\) ?(.*)$", r"^\(([a-z]{1,3})\) ?(.*)$", r"^\([ivxlc]{1,6}\)"
DEFINITION = r"^([a-z][A-Za-z'\- ]{2,60}) (?:means|includes)\b"
RUNNING = r"^(?:Part|Division|Subdivision|Chapter|Schedule) [\dIVXLCA-Z]+ "
# Lines that stand alone on covers.
COVER = """queensland | new south wales | victoria | western australia | south australia | tasmania | australian capital territory
 | northern territory | commonwealth of australia | australia | notes | endnotes""".replace("\n", "").split(" | ")
CONTENTS = r"(?i)^(?:Contents|Table of (?:Contents|Provisions))$"
LONGEST_HEADING, FULL_TEXT = 90, 1800


def lines_of(pages: DataFrame) -> DataFrame:
    """doc_ord, page_no, line_no, line: the lines of distinct pages, blanks collapsed, empty lines left out."""
    once = pages.groupBy("page_id").agg(F.max(F.struct("doc_ord", "page_no", "page_text")).alias("p")).select("p.*")
    lines = once.select("doc_ord", "page_no", F.posexplode(F.split("page_text", "\n")).alias("line_no", "line"))
    return lines.select("doc_ord", "page_no", "line_no", F.trim(F.regexp_replace("line", r"[ \t]+", " ")).alias("line")).where("line <> ''")


def banner(line: Column, title: Column) -> Column:
    """A line that only repeats the document's title, alone or beside a page number or a part."""
    low, t = F.lower(line), F.lower(F.trim(F.coalesce(title, F.lit("?"))))
    forms = (F.trim(F.regexp_replace(low, r"^[ .,]+|[ .,]+$", "")), low, F.regexp_replace(low, r"^\d{1,4} ", ""), F.regexp_replace(low, r" \d{1,4}$", ""), F.regexp_replace(low, r"^part \d+ ", ""), F.regexp_replace(low, r"[ .,]+$", ""), F.regexp_replace(low, r" act no\. ?\d+$", ""))
    return reduce(lambda x, y: x | y, [f == t for f in forms]) | forms[0].isin(COVER)


def classified(lines: DataFrame, parity: bool = False) -> DataFrame:
    """lines (with title and, where known, profile) and their kind, before what depends on other lines is settled.

    With parity a heading that names more than its number counts as a running head, as furniture.
    """
    line = F.col("line")
    key = F.col("profile") if "profile" in lines.columns else F.lit(None).cast("string")
    marks = detect.is_furniture(line, key)
    if parity:
        marks = marks | line.rlike(RUNNING)
    section = line.rlike(SECTION) & ~is_mostly_upper(F.regexp_extract(line, SECTION, 2)) & ~line.rlike(r" \d{1,4}$")
    kind = F.when(banner(line, F.col("title")) | marks, "furniture").when(line.rlike(CONTENTS) | has_leader(line), "contents")
    for name, pattern in HEADINGS.items():
        kind = kind.when(line.rlike(pattern) & (F.length(line) < LONGEST_HEADING), name)
    kind = kind.when(section, "section").when(line.rlike(SUBSECTION), "subsection").when(line.rlike(PARAGRAPH), "paragraph").when(line.rlike(DEFINITION), "definition").otherwise("text")
    return lines.withColumn("kind", kind)


def _order(*keys: str) -> Window:
    return Window.partitionBy("doc_ord", *keys).orderBy("page_no", "line_no").rowsBetween(Window.unboundedPreceding, 0)


def placed(lines: DataFrame, parity: bool = False) -> DataFrame:
    """classified lines with contents pages dropped, markers settled, and the section, subsection, paragraph and context they are under."""
    rows = classified(lines, parity).where("kind <> 'furniture'")
    # A contents page lasts until a line that ends like a sentence and is long enough to be one.
    latch = F.when(F.col("kind") == "contents", True).when(F.col("line").rlike(r"[.;:]$") & (F.length("line") > 40), False)
    rows = rows.withColumn("_toc", F.coalesce(F.last(latch, True).over(_order()), F.lit(False))).where("not _toc and kind <> 'contents'").drop("_toc")
    rows = rows.withColumn("sec_id", F.sum(F.when(F.col("kind").isin("section", "schedule"), 1).otherwise(0)).over(_order()))
    rows = rows.withColumn("_in", F.last(F.when(F.col("kind") == "section", True).when(F.col("kind") == "schedule", False), True).over(_order()))
    number = lambda kind, pattern: F.last(F.when(F.col("kind") == kind, F.regexp_extract("line", pattern, 1)), True)
    rows = rows.withColumn("kind", F.when(F.col("kind").isin("subsection", "paragraph") & ~F.coalesce("_in", F.lit(False)), "text").otherwise(F.col("kind")))
    rows = rows.withColumn("sub_id", F.sum(F.when(F.col("kind") == "subsection", 1).otherwise(0)).over(_order("sec_id")))
    marker = F.when(F.col("kind") == "paragraph", F.regexp_extract("line", PARAGRAPH, 1))
    rows = rows.withColumn("_m", marker)
    back = Window.partitionBy("doc_ord", "sec_id", "sub_id").orderBy("page_no", "line_no").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("_m", True).over(back)
    follows = (F.length("_m") == 1) & (F.length(before) == 1) & (F.ascii("_m") == F.ascii(before) + 1)
    nested = F.col("line").rlike(ROMAN) & before.isNotNull()
    rows = rows.withColumn("kind", F.when((F.col("kind") == "paragraph") & (nested if parity else nested & ~follows), "subparagraph").otherwise(F.col("kind")))
    rows = rows.withColumn("para_id", F.sum(F.when(F.col("kind") == "paragraph", 1).otherwise(0)).over(_order("sec_id", "sub_id")))
    rows = rows.withColumn("kind", F.when((F.col("kind") == "definition") & (F.col("para_id") > 0), "text").otherwise(F.col("kind")))
    for i, name in enumerate(LEVELS):
        event = F.when(F.col("kind") == name, F.regexp_extract("line", HEADINGS[name], 1)).when(F.col("kind").isin("schedule", *LEVELS[:i]), "")
        rows = rows.withColumn(name, F.coalesce(F.last(event, True).over(_order()), F.lit("")))
    rows = rows.withColumn("schedule", F.coalesce(number("schedule", HEADINGS["schedule"]).over(_order()), F.lit("")))
    rows = rows.withColumn("section", F.when(F.col("_in"), number("section", SECTION).over(_order("sec_id"))).otherwise(""))
    rows = rows.withColumn("section", F.coalesce("section", F.lit("")))
    rows = rows.withColumn("subsection", F.coalesce(number("subsection", SUBSECTION).over(_order("sec_id")), F.lit("")))
    rows = rows.withColumn("paragraph", F.coalesce(number("paragraph", PARAGRAPH).over(_order("sec_id", "sub_id")), F.lit("")))
    own = F.col("kind").isin("section", "subsection", "paragraph", "subparagraph", "definition")
    # A definition is its own line only; what follows belongs to what was open before it.
    opened = F.when(own & (F.col("kind") != "definition"), 1).otherwise(0)
    return rows.withColumn("node", F.sum(opened).over(_order())).drop("_in", "_m")


def context_of() -> Column:
    names = [("chapter", "Chapter"), ("part", "Part"), ("division", "Division"), ("subdivision", "Subdivision"), ("schedule", "Schedule")]
    return F.concat_ws(" > ", *[F.when(F.col(c) != "", F.concat(F.lit(f"{n} "), F.col(c))) for c, n in names])


def address_of(act: Column) -> Column:
    schedule = F.when(F.col("schedule") != "", F.concat(F.lit("Schedule "), F.col("schedule"), F.lit(", "))).otherwise("")
    inner = lambda c: F.when(F.col(c) != "", F.concat(F.lit("("), F.col(c), F.lit(")"))).otherwise("")
    return F.concat(act, F.lit(" "), schedule, F.lit("s "), F.col("section"), inner("subsection"), inner("paragraph"), inner("subparagraph"))


def provisions(pages: DataFrame, titles: DataFrame, parity: bool = False) -> DataFrame:
    """doc_ord, node_ord, kind, heading, text, section, subsection, paragraph, subparagraph, context, address, page.

    titles: doc_ord, title and, where known, profile. Text before the first section is front matter and makes no provision.
    """
    lines = lines_of(pages).join(titles, "doc_ord", "left")
    rows = placed(lines, parity)
    body = F.when(F.col("kind") == "subsection", F.regexp_extract("line", SUBSECTION, 2)).when(F.col("kind").isin("paragraph", "subparagraph"), F.regexp_extract("line", PARAGRAPH, 2)).when(F.col("kind") == "text", F.col("line"))
    rows = rows.withColumn("body", body).withColumn("heading", F.when(F.col("kind") == "section", F.regexp_extract("line", SECTION, 2)))
    rows = rows.withColumn("subparagraph", F.when(F.col("kind") == "subparagraph", F.regexp_extract("line", PARAGRAPH, 1)))
    rows = rows.where("section <> ''").withColumn("at", F.struct("page_no", "line_no"))
    nodes = rows.where("kind <> 'definition'").groupBy("doc_ord", "node").agg(
        F.min_by("kind", "at").alias("kind"),
        F.first("title", True).alias("title"),
        F.first("heading", True).alias("heading"),
        F.expr(r"listagg(body, '\n') within group (order by page_no, line_no)").alias("text"),
        *[F.min_by(c, "at").alias(c) for c in ("chapter", "part", "division", "subdivision", "schedule", "section", "subsection", "paragraph")],
        F.coalesce(F.first("subparagraph", True), F.lit("")).alias("subparagraph"),
        F.min("at").alias("at"),
    )
    terms = rows.where("kind = 'definition'").select(
        "doc_ord", "node", "kind", "title", F.regexp_extract("line", DEFINITION, 1).alias("heading"), F.col("line").alias("text"),
        "chapter", "part", "division", "subdivision", "schedule", "section", "subsection", "paragraph", F.lit("").alias("subparagraph"), "at",
    )
    both = nodes.unionByName(terms)
    text = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"([\p{L}\p{N}])-\n([\p{L}\p{N}])", "$1$2"), r"\s+", " "))
    number = F.row_number().over(Window.partitionBy("doc_ord").orderBy(F.col("kind") == "definition", "at"))
    act = F.coalesce("title", F.lit(""))
    return both.select(
        "doc_ord", number.alias("node_ord"), "kind", F.coalesce("heading", F.lit("")).alias("heading"), text.alias("text"),
        "section", "subsection", "paragraph", "subparagraph", context_of().alias("context"), address_of(act).alias("address"), F.col("at.page_no").alias("page"),
    )


def full_texts(provisions: DataFrame, limit: int = FULL_TEXT) -> DataFrame:
    """doc_ord, address, full_text of each section: its own text, then its parts in order, cut at limit on a blank."""
    marker = F.concat(F.when(F.col("kind") == "subsection", F.concat(F.lit("("), F.col("subsection"), F.lit(") "))).when(F.col("kind") == "paragraph", F.concat(F.lit("("), F.col("paragraph"), F.lit(") "))).when(F.col("kind") == "subparagraph", F.concat(F.lit("("), F.col("subparagraph"), F.lit(") "))).otherwise(""), F.col("text"))
    rows = provisions.where("kind <> 'definition'")
    run = Window.partitionBy("doc_ord").orderBy("node_ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("head", F.sum(F.when(F.col("kind") == "section", 1).otherwise(0)).over(run)).withColumn("piece", F.nullif(marker, F.lit("")))
    whole = rows.groupBy("doc_ord", "head").agg(F.min_by("address", "node_ord").alias("address"), F.coalesce(F.expr("listagg(piece, ' ') within group (order by node_ord)"), F.lit("")).alias("t"))
    cut = F.concat(F.regexp_replace(F.substring("t", 1, limit), r" [^ ]*$", ""), F.lit(" [...]"))
    return whole.select("doc_ord", "address", F.when(F.length("t") > limit, cut).otherwise(F.col("t")).alias("full_text"))


def front_matter(pages: DataFrame, titles: DataFrame, most: int = 20) -> DataFrame:
    """doc_ord and front_matter: the first lines of a document that stand under no section."""
    rows = placed(lines_of(pages).join(titles, "doc_ord", "left")).where("section = '' and kind = 'text'")
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("doc_ord").orderBy("page_no", "line_no"))).where(F.col("_r") <= most)
    return first.groupBy("doc_ord").agg(F.expr("listagg(line, '\n') within group (order by page_no, line_no)").alias("front_matter"))


KINDS = ["section", "subsection", "paragraph", "subparagraph", "definition"]


def parse_report(provisions: DataFrame, documents: DataFrame) -> DataFrame:
    """Per document, also one without provisions: how many of each kind, empty sections, and warnings.

    A section is empty if neither it nor any part of it has text; a number used twice makes two sections.
    """
    run = Window.partitionBy("doc_ord").orderBy("node_ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = provisions.withColumn("_head", F.sum(F.when(F.col("kind") == "section", 1).otherwise(0)).over(run))
    alone = F.max((F.col("kind") != "definition") & ((F.col("kind") != "section") | (F.col("text") != "")))
    parts = rows.groupBy("doc_ord", "_head").agg((~alone).alias("empty"), *[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in KINDS])
    per = parts.groupBy("doc_ord").agg(F.count_if(F.col("empty") & (F.col("sections") > 0)).alias("empty_sections"), *[F.sum(f"{k}s").alias(f"{k}s") for k in KINDS])
    out = documents.select("doc_ord").distinct().join(per, "doc_ord", "left").fillna(0)
    few = F.when(F.col("sections") == 0, "no sections found")
    many = F.when(F.col("empty_sections") > 0.3 * F.col("sections"), F.concat(F.col("empty_sections").cast("string"), F.lit(" of "), F.col("sections").cast("string"), F.lit(" sections have no text")))
    return out.withColumn("warnings", F.concat_ws("; ", few, many))
