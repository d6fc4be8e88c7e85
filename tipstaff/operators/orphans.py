"""Problem 5: references whose target was not in the register when the reference was noted.

Plan. Deliveries of one reference are first reduced to the latest. References are then pre-aggregated per
key and period (count, first and last time), so what meets the register is one row per key and period and
not one per reference. Keys holding at least 1/HEAVY of all references (at most HEAVY keys, a bound that
does not grow with the data) are checked by broadcast, the remaining keys by a shuffle join on the key.
A group lies wholly inside a register stretch, wholly outside all of them, or across a boundary; only
groups of the last kind need their single references looked at. Counts come from the groups; the single
references are read once more only to list them, again by broadcast for heavy keys and by shuffle else.

Defined results. A null key part counts as no reference. A row of the register is there from its start
(inclusive; null start = always) to its end (exclusive; null end = still there); repeated and overlapping
rows add nothing. A reference with null time is an orphan only if its key has no row at all, and its
period is null. Of several deliveries the latest counts, of equal times the greatest row. An empty
register makes every reference an orphan; an empty reference table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

#: A key with at least 1/HEAVY of all references is checked by broadcast: at most HEAVY keys.
HEAVY = 1_000


def plain_title(c: Column) -> Column:
    """A title without regard to case, outer and repeated blanks and a leading "the"."""
    blanks = F.trim(F.regexp_replace(F.lower(c), r"[\s ]+", " "))
    return F.regexp_replace(blanks, r"^the ", "")


def latest(df: DataFrame, key: str, by: str) -> DataFrame:
    """One row per key, the one delivered last; ties are settled by the greatest remaining values."""
    rest = [c for c in df.columns if c not in (key, by)]
    best = df.groupBy(key).agg(F.max(F.struct(by, *rest)).alias("_row"))
    return best.select(key, *[F.col(f"_row.{c}").alias(c) for c in (by, *rest)])


def _stretches(register: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """One row per key with its distinct stretches of time; exact repeats are gone before they are gathered."""
    rows = register.select(*keys, F.col(start).alias("from"), F.col(end).alias("to")).where(" and ".join(f"`{k}` is not null" for k in keys)).distinct()
    return rows.groupBy(*keys).agg(F.collect_list(F.struct("from", "to")).alias("stretches"))


def _there(at: Column, stretches: str) -> Column:
    return F.exists(stretches, lambda s: (s["from"].isNull() | (s["from"] <= at)) & (s["to"].isNull() | (at < s["to"])))


def _verdict() -> Column:
    """present, absent or mixed for a group of references noted between first and last."""
    first, last = F.col("first"), F.col("last")
    around = F.exists("stretches", lambda s: (s["from"].isNull() | (s["from"] <= first)) & (s["to"].isNull() | (last < s["to"])))
    touches = F.exists("stretches", lambda s: (s["from"].isNull() | (s["from"] <= last)) & (s["to"].isNull() | (first < s["to"])))
    return (
        F.when(F.col("stretches").isNull(), "absent")
        .when(first.isNull(), "present")
        .when(around, "present")
        .when(~touches, "absent")
        .otherwise("mixed")
    )


def _split_join(rows: DataFrame, side: DataFrame, keys: list[str], heavy: DataFrame, how: str) -> DataFrame:
    """rows join side on keys (nulls equal): rows of heavy keys by broadcast of side's bounded share, the others by shuffle."""
    mark = F.broadcast(heavy.select(*[F.col(k).alias(f"_h_{k}") for k in heavy.columns], F.lit(True).alias("_heavy")))
    on_heavy = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in heavy.columns])
    drop = [f"_h_{k}" for k in heavy.columns]
    side = side.join(mark, on_heavy, "left").drop(*drop)
    rows = rows.join(mark, on_heavy, "left").drop(*drop)
    renamed = [F.col(k).alias(f"_r_{k}") for k in keys] + [c for c in side.columns if c not in (*keys, "_heavy")]
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    parts = []
    for test, small in (("_heavy", True), ("_heavy is null", False)):
        other = side.where(test).drop("_heavy").select(*renamed)
        parts.append(rows.where(test).drop("_heavy").join(F.broadcast(other) if small else other, on, how).drop(*[f"_r_{k}" for k in keys]))
    return parts[0].unionByName(parts[1])


def reference_groups(refs: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Pre-aggregation: one row per key and period with the number of references and their first and last time."""
    grouped = refs.withColumn("period", F.date_format(at, "yyyy-MM")).groupBy(*keys, "period")
    return grouped.agg(F.count(F.lit(1)).alias("refs"), F.min(at).alias("first"), F.max(at).alias("last"))


def heavy_keys(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of at least 1/HEAVY of all references, at most HEAVY of them by that definition, from the pre-aggregated groups."""
    total = groups.agg(F.sum("refs")).first()[0] or 0
    per_key = groups.groupBy(*keys).agg(F.sum("refs").alias("refs"))
    return materialize(per_key.where(F.col("refs") >= max(total / HEAVY, 2)).select(*keys), "heavy")


def group_verdicts(groups: DataFrame, keys: list[str], register: DataFrame, start: str, end: str, heavy: DataFrame, name: str) -> DataFrame:
    """groups with the columns {name} (present, absent, mixed) and {name}_stretches (only of mixed groups)."""
    per_period = groups.groupBy(*keys, "period").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    met = _split_join(per_period, _stretches(register, keys, start, end), keys, heavy, "left").withColumn(name, _verdict())
    met = met.select(*keys, "period", name, F.when(F.col(name) == "mixed", F.col("stretches")).alias(f"{name}_stretches"))
    return _split_join(groups, met, [*keys, "period"], heavy, "left")


def orphan_groups(refs: DataFrame, checks: list[tuple[str, list[str], DataFrame, str, str]], at: str) -> tuple[DataFrame, DataFrame]:
    """The pre-aggregated groups that may lack a target, and the heavy keys.

    checks are (name, keys, register, start, end) in order, each one's keys beginning with the keys before;
    a reference is checked against a later register only if the earlier ones hold its target and none of
    the later keys is null.
    """
    keys = checks[-1][1]
    groups = materialize(reference_groups(refs, keys, at), "groups")
    heavy = heavy_keys(groups, keys)
    suspect = F.lit(False)
    marked = groups
    for name, its, register, start, end in checks:
        its_heavy = heavy if its == keys else heavy_keys(groups, its)
        marked = group_verdicts(marked, its, register, start, end, its_heavy, f"_{name}")
        there = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in its])
        # Written between the checks: the groups are small, and each check then plans from a table.
        marked = materialize(marked.withColumn(f"_{name}", F.when(there, F.col(f"_{name}")).otherwise("present")), "marked")
        suspect = suspect | (F.col(f"_{name}") != "present")
    return marked.where(suspect), heavy


def orphans(refs: DataFrame, checks: list[tuple[str, list[str], DataFrame, str, str]], at: str) -> DataFrame:
    """refs whose target was not there, with the columns lacks (name of the first failed check) and period."""
    suspects, heavy = orphan_groups(refs, checks, at)
    keys = checks[-1][1]
    rows = _split_join(refs.withColumn("period", F.date_format(at, "yyyy-MM")), suspects.drop("refs", "first", "last"), [*keys, "period"], heavy, "inner")
    return rows.withColumn("lacks", _lacks(checks, at)).where("lacks is not null").drop(*[c for n, *_ in checks for c in (f"_{n}", f"_{n}_stretches")])


def _lacks(checks: list, at: str) -> Column:
    out = F.lit(None).cast("string")
    for name, *_ in reversed(checks):
        gone = (F.col(f"_{name}") == "absent") | ((F.col(f"_{name}") == "mixed") & ~_there(F.col(at), f"_{name}_stretches"))
        out = F.when(gone, F.lit(name)).otherwise(out)
    return out


def orphan_counts(refs: DataFrame, checks: list[tuple[str, list[str], DataFrame, str, str]], at: str) -> DataFrame:
    """lacks, period, orphans: groups wholly decided are counted as they are, only the others' references are read again."""
    suspects, heavy = orphan_groups(refs, checks, at)
    keys = checks[-1][1]
    undecided = reduce(lambda x, y: x | y, [F.col(f"_{n}") == "mixed" for n, *_ in checks])
    whole = suspects.where(~undecided).withColumn("lacks", _whole(checks)).groupBy("lacks", "period").agg(F.sum("refs").alias("orphans"))
    rows = _split_join(refs.withColumn("period", F.date_format(at, "yyyy-MM")), suspects.where(undecided).drop("refs", "first", "last"), [*keys, "period"], heavy, "inner")
    single = rows.withColumn("lacks", _lacks(checks, at)).where("lacks is not null").groupBy("lacks", "period").agg(F.count(F.lit(1)).alias("orphans"))
    return whole.unionByName(single).groupBy("lacks", "period").agg(F.sum("orphans").alias("orphans"))


def _whole(checks: list) -> Column:
    return F.coalesce(*[F.when(F.col(f"_{n}") == "absent", F.lit(n)) for n, *_ in checks])


def act_references(edges: DataFrame) -> DataFrame:
    """edge_ord, act_key, section, noted_at of the latest delivery of each edge that names an act."""
    blank = lambda c: F.regexp_replace(c, r"[\s ]+", "") == ""
    rows = edges.select("edge_ord", "loaded_at", "noted_at", "target_act", "target_section")
    rows = latest(rows, "edge_ord", "loaded_at").where(F.col("target_act").isNotNull() & ~blank(F.col("target_act")))
    section = F.regexp_replace("target_section", r"^[\s ]+|[\s ]+$", "")
    return rows.select("edge_ord", plain_title(F.col("target_act")).alias("act_key"), F.when(section != "", section).alias("section"), "noted_at")


def registers(acts: DataFrame, provisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two registers under the keys of act_references: by act, and by act and section."""
    by_act = acts.select(plain_title(F.col("title")).alias("act_key"), "act_id", "entered_at", "removed_at")
    rows = provisions.select("act_id", F.regexp_replace("section", r"^[\s ]+|[\s ]+$", "").alias("section"), "entered_at", "removed_at")
    return by_act.drop("act_id"), rows.join(by_act.select("act_id", "act_key").distinct(), "act_id").drop("act_id")


def _act_checks(acts: DataFrame, provisions: DataFrame) -> list[tuple[str, list[str], DataFrame, str, str]]:
    by_act, by_section = registers(acts, provisions)
    return [("act", ["act_key"], by_act, "entered_at", "removed_at"), ("section", ["act_key", "section"], by_section, "entered_at", "removed_at")]


def orphan_references(edges: DataFrame, acts: DataFrame, provisions: DataFrame) -> DataFrame:
    """Every reference whose target was not there at noted_at: edge_ord, lacks (act or section), period."""
    refs = materialize(act_references(edges), "refs")
    return orphans(refs, _act_checks(acts, provisions), "noted_at").select("edge_ord", "lacks", "period")


def orphan_report(edges: DataFrame, acts: DataFrame, provisions: DataFrame) -> DataFrame:
    """Orphans per register table and month: register, period, orphans."""
    refs = materialize(act_references(edges), "refs")
    name = F.when(F.col("lacks") == "act", "act_register").otherwise("provision_register")
    return orphan_counts(refs, _act_checks(acts, provisions), "noted_at").select(name.alias("register"), "period", "orphans")
