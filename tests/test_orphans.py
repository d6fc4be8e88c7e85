import datetime as dt
import random

import pytest

from tipstaff.operators import orphans


def when(d):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=d)


@pytest.fixture
def tables(spark):
    rng = random.Random(4)
    acts = [(i, f"Act {i % 8}" if i % 2 else f"the  ACT {i % 8} ", when(rng.randrange(60)), when(60 + rng.randrange(60)) if rng.random() < 0.5 else None) for i in range(8)] + [(9, None, None, None)]
    provisions = [(rng.randrange(8), str(rng.randrange(4)), when(rng.randrange(90)), when(90 + rng.randrange(60)) if rng.random() < 0.5 else None) for _ in range(30)]
    provisions += provisions[:5] + [(None, None, None, None)]
    edges = []
    for i in range(900):
        a = "Act 1" if rng.random() < 0.4 else rng.choice(["act 2", " Act  3", "ACT 11", "the Act 4", None, " ", "Act 5"])
        edges.append((i, a, rng.choice(["0", " 1 ", "2", "", None, "77"]), when(rng.uniform(0, 150)), when(200 + i)))
    edges += [(i, a, s, n, when(500)) for i, a, s, n, _ in edges[:40]]
    spec = "target_act string, target_section string, noted_at timestamp, loaded_at timestamp"
    return (
        spark.createDataFrame(edges, f"edge_ord bigint, {spec}").selectExpr("*", "'x' as stretches", "1 as refs", "'z' as period"),
        spark.createDataFrame(acts, "act_id bigint, title string, entered_at timestamp, removed_at timestamp"),
        spark.createDataFrame(provisions, "act_id bigint, section string, entered_at timestamp, removed_at timestamp"),
    )


def brute(edges, acts, provisions):
    plain = lambda t: " ".join(t.lower().split()).removeprefix("the ")
    there = lambda r, at: (r.entered_at is None or r.entered_at <= at) and (r.removed_at is None or at < r.removed_at)
    acts, provisions = [a for a in acts if a.title], provisions
    out = set()
    for e in {e.edge_ord: e for e in edges}.values():
        if not e.target_act or not e.target_act.strip():
            continue
        own = [a for a in acts if plain(a.title) == plain(e.target_act)]
        section = (e.target_section or "").strip()
        if not any(there(a, e.noted_at) for a in own):
            out.add((e.edge_ord, "act", e.noted_at.strftime("%Y-%m")))
        elif section and not any(p.act_id in {a.act_id for a in own} and p.section == section and there(p, e.noted_at) for p in provisions):
            out.add((e.edge_ord, "section", e.noted_at.strftime("%Y-%m")))
    return out


@pytest.mark.parametrize("heavy", [1_000, 3])
def test_against_brute_force(spark, tables, monkeypatch, heavy):
    """Also with so few heavy keys allowed that both ways of the join are taken."""
    monkeypatch.setattr(orphans, "HEAVY", heavy)
    got = [tuple(r) for r in orphans.orphan_references(*tables).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(*(t.collect() for t in tables))
    counts = {(r.register, r.period): r.orphans for r in orphans.orphan_report(*tables).collect()}
    for (register, period), n in counts.items():
        assert n == sum(p == period and (lacks == "act") == (register == "act_register") for _, lacks, p in got)
    assert sum(counts.values()) == len(got)


def test_empty_tables(spark, tables):
    edges, acts, provisions = tables
    assert orphans.orphan_references(edges.limit(0), acts, provisions).count() == 0
    got = orphans.orphan_references(edges, acts.limit(0), provisions.limit(0))
    assert {r.lacks for r in got.select("lacks").distinct().collect()} == {"act"}
