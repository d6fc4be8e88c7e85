"""Cross-references: which provision points at which act and section, and what the graph of them says.

References are found inside one record at a time by an Arrow pass that needs match offsets; everything
after that is joins and aggregates on the edges table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How references are written.
SECTION = re.compile(r"\b(?:section|sections|s|ss)\s*(\d+[A-Z]{0,3})(?:\s*\((\d+[A-Z]{0,3})\))?", re.I)
ACT = re.compile(r"\b([A-Z][\w'&\-]*(?:\s+(?:of|and|the|for|in|on|to|a|an)|\s+[A-Z][\w'&\-]*){0,10}\s+(?:Act|Regulations?|Code|Rules|Ordinance)(?:\s+\(\w{2,3}\))?\s+(?:1[89]\d{2}|20\d{2}))")
# Relations in the order they are tried.
RELATIONS = [
    ("defines", r"\b(?:means|includes|has the meaning given)\b"),
    ("applies", r"\b(?:applies to|apply to|application of)\b"),
    ("subject to", r"\bsubject to\b"),
    ("despite", r"\b(?:despite|notwithstanding)\b"),
    ("amends", r"\b(?:amend(?:s|ed|ment)?|inserted|repealed|omitted)\b"),
    ("penalty", r"\b(?:penalt(?:y|ies)|offence|guilty of)\b"),
]
AHEAD, NEAR, QUOTE = 40, 60, 130


def plain_act(name: str) -> str:
    return " ".join(re.sub(r"(?i)^the\s+", "", name or "").split())


def same_act(a: str, b: str) -> bool:
    x, y = plain_act(a).casefold(), plain_act(b).casefold()
    return bool(x and y) and (x.endswith(y) or y.endswith(x))


def same_act_column(a: Column, b: Column) -> Column:
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\s+", " "), "^ ?the ", ""))
    x, y = plain(a), plain(b)
    return (x != "") & (y != "") & (F.endswith(x, y) | F.endswith(y, x))


def relation(quote: Column) -> Column:
    out = F.lit("refers to")
    for name, pattern in reversed(RELATIONS):
        out = F.when(quote.rlike("(?i)" + pattern), name).otherwise(out)
    return out


def target_label(act: Column, section: Column, subsection: Column) -> Column:
    return F.concat(act, F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(" s "), section, F.when(F.coalesce(subsection, F.lit("")) != "", F.concat(F.lit("("), subsection, F.lit(")"))).otherwise(""))).otherwise(""))


def references(text: str | None, own_act: str, own_section: str) -> list[tuple[str, str, str, str]]:
    """(target act, section, subsection, quote) of every reference in one text, self-references left out.

    A section belongs to the act that starts within AHEAD characters after it, else to the last act named
    before it, else to the record's own act. An act with no section near it is a reference by itself.
    """
    if not text:
        return []
    acts = [(m.start(), plain_act(m[1])) for m in ACT.finditer(text)]
    refs = list(SECTION.finditer(text))
    own, out = plain_act(own_act), []

    def quote(at: int) -> str:
        low, high = max(0, at - QUOTE // 2), min(len(text), at + QUOTE // 2)
        return ("[...] " if low else "") + " ".join(text[low:high].split()) + (" [...]" if high < len(text) else "")

    for m in refs:
        ahead = next((name for at, name in acts if 0 <= at - m.end() <= AHEAD), None)
        behind = next((name for at, name in reversed(acts) if at < m.start()), None)
        target = ahead or behind or own
        if same_act(target, own):
            target = own
        if not (target == own and m[1] == (own_section or "")):
            out.append((target, m[1], m[2] or "", quote(m.start())))
    for at, name in acts:
        if not same_act(name, own) and not any(abs(m.start() - at) < NEAR for m in refs):
            out.append((name, "", "", quote(at)))
    return out


def edges(records: DataFrame, limit: int | None = None) -> DataFrame:
    """position, seq, source_address, source_act, target_act, target_section, target_subsection, relation, quote.

    Whole sections are left out: their parts are records of their own and would count twice. Null text has
    no references. With a limit only the records at the first positions are read.
    """
    if limit is not None:
        records = records.where(F.col("position") < limit)
    base = records.where(F.coalesce("kind", F.lit("")) != "section").select("position", "address", "act", "section", "text")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, address, act, section, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(p, i, address, act, *r) for i, r in enumerate(references(text, act or "", section or ""))]
            names = ["position", "seq", "source_address", "source_act", "target_act", "target_section", "target_subsection", "quote"]
            kinds = [pa.int64(), pa.int32(), *[pa.string()] * 6]
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    found = base.mapInArrow(per_batch, "position bigint, seq int, source_address string, source_act string, target_act string, target_section string, target_subsection string, quote string")
    return found.withColumn("relation", relation(F.col("quote")))


def outbound(edges: DataFrame, address: str) -> DataFrame:
    return edges.where(F.col("source_address") == address)


def inbound(edges: DataFrame, act: str, section: str) -> DataFrame:
    return edges.where((F.lower(F.trim("target_act")) == act.strip().lower()) & (F.col("target_section") == section))


def act_links(edges: DataFrame) -> DataFrame:
    """source_act, target_act, refs between different acts."""
    return edges.where(F.col("source_act") != F.col("target_act")).groupBy("source_act", "target_act").agg(F.count(F.lit(1)).alias("refs"))


def relation_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count(F.lit(1)).alias("edges"))


def thread_stats(edges: DataFrame, acts: DataFrame) -> DataFrame:
    """edges, acts, external targets (by exact name), one row. acts: the indexed acts, column act."""
    known = acts.select("act").where("act is not null").distinct()
    outside = edges.select(F.col("target_act").alias("act")).where("act is not null").distinct().join(known, "act", "left_anti")
    one = edges.agg(F.count(F.lit(1)).alias("edges"))
    return one.crossJoin(known.agg(F.count(F.lit(1)).alias("acts"))).crossJoin(outside.agg(F.count(F.lit(1)).alias("external_acts")))  # one row each


def reading_list(edges: DataFrame, acts: DataFrame, order: str = "edge_ord") -> DataFrame:
    """target_act, refs, first_seen_at (up to three source addresses): acts pointed at that no indexed act matches.

    Names are compared once per distinct name: by the suffixes of the longer name, so an equality join does
    the work of the suffix test.
    """
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower("act"), r"\s+", " "), "^ ?the ", ""))
    known = acts.select("act").where("act is not null").distinct().select(plain.alias("name")).where("name <> ''").distinct()
    names = edges.select(F.col("target_act").alias("act")).where("act is not null").distinct().select("act", plain.alias("name")).where("name <> ''")
    suffixes = lambda df: df.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring("name", i, F.length("name")))).alias("tail"))
    inside = suffixes(names).join(known.select(F.col("name").alias("tail")), "tail", "left_semi").select("act")
    longer = names.join(suffixes(known).select(F.col("tail").alias("name")), "name", "left_semi").select("act")
    outside = names.select("act").join(inside.unionByName(longer).distinct(), "act", "left_anti")
    hits = edges.join(outside.withColumnRenamed("act", "target_act"), "target_act", "left_semi")
    ranked = hits.withColumn("_r", F.row_number().over(Window.partitionBy("target_act").orderBy(order))).where("_r <= 3")
    first = ranked.groupBy("target_act").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "source_address"))), lambda x: x["source_address"]), " | ").alias("first_seen_at"))
    return hits.groupBy("target_act").agg(F.count(F.lit(1)).alias("refs")).join(first, "target_act")


def containing(acts: DataFrame, names: DataFrame) -> DataFrame:
    """name, act: the known acts whose name contains a name, in any case; names are met with the parts of distinct acts."""
    known = acts.select("act").where("act is not null").distinct().select("act", F.lower("act").alias("_low"))
    lengths = names.select(F.length("name").alias("_len")).where("_len > 0").distinct()
    fits = known.join(F.broadcast(lengths), F.length("_low") >= F.col("_len"))  # at most one row a length of a name
    parts = fits.select("act", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_low") - F.col("_len") + 1), lambda i: F.substring("_low", i, F.col("_len"))))).alias("_part"))
    asked = names.select("name", F.lower("name").alias("_part")).distinct()
    return asked.join(parts, "_part").select("name", "act").distinct()


def trace(edges: DataFrame, records: DataFrame, act: str, section: str, depth: int = 2, order: str = "edge_ord") -> DataFrame:
    """level and the columns of the edges met on a walk from a section, at most depth steps long.

    A step looks a section up in the records (acts whose name contains the one pointed at, as a citation does) and
    takes the edges out of its addresses. One edge is kept for a target act, target section and source address, the
    first in order; it stands at the level where it is met first, and a section already looked up is not looked up
    again. Each level joins the sections asked for with records and edges once; lineage is cut after it.
    """
    from ..runtime import materialize

    spark = edges.sparkSession
    places = records.select("act", "section", F.col("address").alias("source_address")).where("source_address is not null").distinct()
    first = Window.partitionBy("target_act", "target_section", "source_address").orderBy(order)
    steps = edges.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    frontier = spark.createDataFrame([(act, section)], "name string, section string")
    asked, left, out = frontier, None, None
    for level in range(1, depth + 1):
        at = frontier.join(containing(records, frontier), "name").select("act", "section").distinct()
        sources = places.join(at, ["act", "section"]).select("source_address").distinct()
        if left is not None:
            sources = sources.join(left, "source_address", "left_anti")
        sources = materialize(sources, f"sources{level}")
        found = materialize(steps.join(sources, "source_address").withColumn("level", F.lit(level)), f"trace{level}")
        out = found if out is None else out.unionByName(found)
        left = sources if left is None else left.unionByName(sources)
        goals = found.where("coalesce(target_section, '') <> '' and target_act is not null").select(F.col("target_act").alias("name"), F.col("target_section").alias("section")).distinct()
        frontier = goals.join(asked, ["name", "section"], "left_anti")
        asked = asked.unionByName(frontier)
    return out
