import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tipstaff.llm import distinctive, queries
from tipstaff.llm.distinctive import distinctive_terms

ROWS = [(1, "The lighthouse lighthouse", "a Lighthouse keeper"), (2, None, "the the the keeper's b9c"), (3, "", None), (4, "ÄÖ the", "" ), (5, None, "x" * 70_000 + " end"), (6, "same text", "tie tie"), (6, "same text", "tie tie")]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "id bigint, heading string, text string").selectExpr("*", "'clash' as term", "1 as tf", "2 as df")


def brute(rows):
    docs = [(i, Counter(re.findall("[a-z]+", f"{h or ''} {t or ''}".lower()))) for i, h, t in rows]
    cf, df = Counter(), Counter()
    for _, c in docs:
        cf.update(c)
        df.update(c.keys())
    total = sum(cf.values())
    x = lambda v: v * math.log(v) if v > 0 else 0.0
    out = []
    for i, c in docs:
        size = sum(c.values())
        for w, a in c.items():
            b, e = cf[w] - a, size - a
            d = total - size - b
            g = 2 * (x(a) + x(b) + x(e) + x(d) - x(a + b) - x(e + d) - x(a + e) - x(b + d) + x(total))
            out.append((i, w, a, df[w], round(max(g, 0) if a * (b + d) >= b * (a + e) else -max(g, 0), 6) + 0.0))
    return sorted(out)


def got(df):
    return sorted((r.id, r.term, r.tf, r.df, round(r.llr, 6) + 0.0) for r in df.collect())


def test_against_brute_force(spark):
    assert got(distinctive_terms(table(spark), "id", ["heading", "text"])) == brute(ROWS)


def test_heavy_and_light_terms_meet(spark, monkeypatch):
    monkeypatch.setattr(distinctive, "HEAVY", 6)
    assert got(distinctive_terms(table(spark), "id", ["heading", "text"])) == brute(ROWS)
    few = [r for r in brute(ROWS) if r[2] >= 2 and r[3] <= 2]
    assert got(distinctive_terms(table(spark), "id", ["heading", "text"], min_tf=2, max_df=2)) == few


def test_empty(spark):
    assert distinctive_terms(table(spark).limit(0), "id", ["heading", "text"]).count() == 0
    assert distinctive_terms(table(spark, [(1, None, None)]), "id", ["text"]).count() == 0


def test_found_words_rest_on_counts_and_hold_no_idle_score(spark, tmp_path, monkeypatch):
    rows = ROWS + [(7, "kelp", "kelp Kelp kelp's ropes"), (8, None, "the the the the"), (9, "dock dock", "dock the")]
    table(spark, rows).selectExpr("id as position", "heading", "text").write.parquet(f"{tmp_path}/records.parquet")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().lower()
    found, terms = queries.p1_found(spark, str(tmp_path)), queries.p1_terms(spark, str(tmp_path))
    assert "ln(" in plan(terms) and not any(x in plan(found) for x in ("ln(", "nan(", "llr"))
    wanted = sorted((i, w) for i, w, tf, df, _ in brute(rows) if tf >= 3 and df <= 8)
    assert wanted and sorted(map(tuple, found.collect())) == wanted
    scores = {(r.position, r.term): r.llr for r in terms.collect()}
    assert all(abs(scores[i, w] - x) < 2e-3 for i, w, _, _, x in brute(rows)) and set(wanted) <= set(scores)
    monkeypatch.setattr(distinctive, "log_likelihood", lambda *a: F.lit(float("nan")))  # nothing that the score does reaches the answer
    assert sorted(map(tuple, queries.p1_found(spark, str(tmp_path)).collect())) == wanted
