"""Queries of this subpackage and, where SQL can say them, their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..runtime import table

from .canonical import list_blocks, map_values
from .distinctive import distinctive_terms
from .mixing import mix, mix_report
from .near_duplicates import near_duplicate_groups, near_duplicate_pairs
from .packing import pack, pack_report
from .scan_repair import repair_collection
from .sentences import sentences


def p1_found(spark, d):
    """The words asked for: counts alone tell them, so no score is made here. p1_terms gives every word its score."""
    return distinctive_terms(table(spark, d, "records"), "position", ["heading", "text"], min_tf=3, max_df=8).select("position", "term")


def p1_terms(spark, d):
    return distinctive_terms(table(spark, d, "records"), "position", ["heading", "text"]).selectExpr("position", "term", "tf", "df", "cf", "round(llr, 3) as llr")


_P1 = r"""
WITH w AS (SELECT position, unnest(regexp_extract_all(lower(coalesce(heading, '') || ' ' || coalesce(text, '')), '[a-z]+')) AS term FROM records),
tf AS (SELECT position, term, count(*) AS tf FROM w GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY 1),
sz AS (SELECT position, sum(tf) AS size FROM tf GROUP BY 1),
al AS (SELECT sum(cf) AS total FROM df),
t AS (SELECT position, term, tf, df, cf::BIGINT AS cf, tf::DOUBLE AS a, (cf - tf)::DOUBLE AS b, (size - tf)::DOUBLE AS c, (total - size - cf + tf)::DOUBLE AS d
      FROM tf JOIN df USING (term) JOIN sz USING (position), al)
"""
_X = "(CASE WHEN {0} > 0 THEN ({0}) * ln({0}) ELSE 0 END)"
_G = "2 * (" + " + ".join(_X.format(v) for v in ("a", "b", "c", "d", "(a+b+c+d)")) + " - " + " - ".join(_X.format(v) for v in ("(a+b)", "(c+d)", "(a+c)", "(b+d)")) + ")"
SQL = {
    "p1_found": _P1 + "SELECT position, term FROM t WHERE tf >= 3 AND df <= 8",
    "p1_terms": _P1 + f"SELECT position, term, tf, df, cf, round(CASE WHEN a * (b + d) >= b * (a + c) THEN greatest({_G}, 0) ELSE -greatest({_G}, 0) END, 3) AS llr FROM t",
}

# Every pair of distinct sets is met through every run they share: for small tables.
_P3 = """
WITH w AS (SELECT position, regexp_extract_all(lower(coalesce(act, '') || ' ' || text), '[a-z0-9]+') AS l FROM records WHERE len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) >= 45),
f AS (SELECT DISTINCT position, l[g] || ' ' || l[g + 1] || ' ' || l[g + 2] AS run FROM (SELECT position, l, unnest(generate_series(1, len(l) - 2)) AS g FROM w)),
c AS (SELECT position, count(*) AS size, string_agg(run, '|' ORDER BY run) AS name FROM f GROUP BY 1),
k AS (SELECT name, min(position) AS class_id, any_value(size) AS size, count(*) AS n FROM c GROUP BY 1),
m AS (SELECT position, class_id, n FROM c JOIN k USING (name)),
r AS (SELECT class_id, run FROM f JOIN k ON class_id = position),
s AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS met FROM r a JOIN r b ON a.run = b.run AND a.class_id < b.class_id GROUP BY 1, 2),
e AS (SELECT a, b FROM s JOIN k x ON x.class_id = a JOIN k y ON y.class_id = b WHERE met >= 0.6 * (x.size + y.size - met))
"""
SQL["p3_found"] = _P3 + """SELECT least(x.position, y.position) AS position_a, greatest(x.position, y.position) AS position_b FROM e JOIN m x ON x.class_id = a JOIN m y ON y.class_id = b
UNION ALL SELECT x.position, y.position FROM m x JOIN m y ON x.class_id = y.class_id AND x.position < y.position"""
SQL["p3_groups"] = _P3 + """, n AS (SELECT class_id, count(*) AS links FROM (SELECT a AS class_id FROM e UNION ALL SELECT b FROM e) GROUP BY 1)
SELECT position, class_id, n - 1 AS copies, coalesce(links, 0) AS links FROM m LEFT JOIN n USING (class_id)"""
SQL["p6_limits"] = "SELECT spec_name, capacity_tokens, 0::BIGINT AS overfull, 0::BIGINT AS shared_slots, 0::BIGINT AS split, 0::BIGINT AS torn, (SELECT count(*) FROM documents WHERE text <> '') AS documents FROM packing_specs"
SQL["p7_limits"] = "SELECT mix_name, source, target_share, max_repeats, source IN (SELECT source FROM documents WHERE text <> '' AND source IS NOT NULL) AS met, 0::BIGINT AS too_often FROM mix_targets"


def p8_found(spark, d):
    return sentences(table(spark, d, "documents"), "doc_id", "text", "lang")


def p8_sentences(spark, d):
    return sentences(table(spark, d, "documents"), "doc_id", "text", "lang", with_text=True)


def _specs(spark, d):
    return [(r["spec_name"], r["capacity_tokens"]) for r in table(spark, d, "packing_specs").select("spec_name", "capacity_tokens").collect()]


def p6_windows(spark, d):
    return pack(table(spark, d, "documents"), "doc_id", "text", _specs(spark, d))


def p6_report(spark, d):
    return pack_report(p6_windows(spark, d), _specs(spark, d))


def _mix(spark, d):
    rows = table(spark, d, "mix_targets").select("mix_name", "source", "target_share", "max_repeats").collect()
    return mix(table(spark, d, "documents"), "doc_id", "text", "source", [tuple(r) for r in rows])


def p7_mix(spark, d):
    return _mix(spark, d)[0]


def p7_report(spark, d):
    drawn, targets = _mix(spark, d)
    return mix_report(drawn, "doc_id", targets)


def p3_found(spark, d):
    return near_duplicate_pairs(table(spark, d, "records"), "position", "act", "text").select("position_a", "position_b")


def p3_groups(spark, d):
    return near_duplicate_groups(table(spark, d, "records"), "position", "act", "text")


def _p2(spark, d):
    register = list_blocks(table(spark, d, "act_register"), "act_id", "title", "jurisdiction")
    edges = table(spark, d, "typed_edges").groupBy("edge_ord").agg(F.max("target_act").alias("target_act"))
    return map_values(edges, "edge_ord", "target_act", register)


def p6_limits(spark, d):
    """What the capacities ask of the windows: none too full, no document split that fits one, every token placed once."""
    placed, caps = p6_windows(spark, d), spark.createDataFrame(_specs(spark, d), "spec_name string, capacity_tokens int")
    full = placed.groupBy("spec_name", "window_no").agg(F.sum("tokens").alias("tokens"), F.count_distinct("slot").alias("slots"), F.count("*").alias("rows"))
    full = full.join(F.broadcast(caps), "spec_name").groupBy("spec_name", "capacity_tokens").agg(F.count_if(F.expr("tokens > capacity_tokens")).alias("overfull"), F.count_if(F.expr("slots <> rows")).alias("shared_slots"))
    whole = placed.groupBy("spec_name", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"), F.max(F.col("start_token") + F.col("tokens")).alias("last"))
    whole = whole.join(F.broadcast(caps), "spec_name").groupBy("spec_name").agg(F.count_if(F.expr("pieces > 1 and tokens <= capacity_tokens")).alias("split"), F.count_if(F.expr("last <> tokens")).alias("torn"), F.count("*").alias("documents"))
    return full.join(whole, "spec_name")


def p7_limits(spark, d):
    """Per target: whether its share is met (within 0.02, of the shares of sources that have texts), and documents repeated too often."""
    drawn, targets = _mix(spark, d)
    report = mix_report(drawn, "doc_id", targets)
    held = F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).over(Window.partitionBy("mix_name"))
    met = F.when(F.col("tokens") > 0, F.abs(F.col("actual_share") - F.col("target_share") / held) <= 0.02).otherwise(F.lit(False))
    often = drawn.groupBy("mix_name", "source", "doc_id").agg(F.count("*").alias("n")).join(F.broadcast(spark.createDataFrame(targets, "mix_name string, source string, _p double, cap int")), ["mix_name", "source"])
    often = often.groupBy("mix_name", "source").agg(F.count_if(F.expr("n > cap")).alias("too_often"))
    return report.withColumn("met", met).join(often, ["mix_name", "source"], "left").select("mix_name", "source", "target_share", "max_repeats", "met", F.coalesce("too_often", F.lit(0)).alias("too_often"))


def p2_mapped(spark, d):
    """Every typed edge once, with the entry meant."""
    return _p2(spark, d).drop("candidates")


def p2_candidates(spark, d):
    """Every entry within the distance of what was typed, for every edge."""
    return _p2(spark, d).select("edge_ord", "typed", F.explode("candidates").alias("c")).select("edge_ord", "typed", "c.entry_id", "c.distance")


def p2_found(spark, d):
    return p2_mapped(spark, d).where("status not in ('blank', 'exact')").select("edge_ord", F.col("entry_id").alias("act_id"))


def p2_unlisted(spark, d):
    """Values the list does not hold, with how often they were typed."""
    return p2_mapped(spark, d).where("status in ('unlisted', 'ambiguous')").groupBy("typed", "status").agg(F.count(F.lit(1)).alias("edges"))


def _scans(spark, d, with_text):
    return repair_collection(table(spark, d, "act_pages"), table(spark, d, "act_documents"), table(spark, d, "records"), with_text)


def p4_found(spark, d):
    return _scans(spark, d, False).select("table_name", "row_id", F.explode("edits").alias("e")).select("table_name", "row_id", "e.line_no", "e.repaired")


def p4_repaired(spark, d):
    return _scans(spark, d, True).select("table_name", "row_id", F.size("edits").alias("edits"), "repaired_text")


QUERIES = {"p1_found": p1_found, "p1_terms": p1_terms, "p2_found": p2_found, "p2_mapped": p2_mapped, "p2_candidates": p2_candidates, "p2_unlisted": p2_unlisted, "p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p4_repaired": p4_repaired, "p6_windows": p6_windows, "p6_report": p6_report, "p6_limits": p6_limits, "p7_mix": p7_mix, "p7_report": p7_report, "p7_limits": p7_limits, "p8_found": p8_found, "p8_sentences": p8_sentences}
