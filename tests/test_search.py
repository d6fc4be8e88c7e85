import math
import re

from tipstaff.functions.text import STOPWORDS
from tipstaff.operators import answer, index, lexicon, search
from tipstaff.runtime import table

ROWS = [
    (0, "The lessee must pay the levy in full before the vessel sails.", "Levy on vessels", "A Act 1999", "1", "", "subsection", "Queensland", "1 May 2020"),
    (1, "Vessel means anything that floats and is not a kiosk.", "vessel", "A Act 1999", "2", "", "definition", "Queensland", None),
    (2, "A tribunal may suspend a permit after notice to the holder.", "", "B Act 2001", "7", "1", "section", "Commonwealth", "2 May 2020"),
    (3, None, None, "B Act 2001", "8", "", "section", "Commonwealth", None),
    (4, "short", "x", "B Act 2001", "9", "", "section", None, None),
]


def built(spark):
    df = spark.createDataFrame(ROWS, "position bigint, text string, heading string, act string, section string, subsection string, kind string, jurisdiction string, currency string")
    return index.build(df.selectExpr("*", "concat(act, ' s ', section) as address", "'' as context", "'f' as source"))


def test_postings_and_lengths(spark):
    ix = built(spark)
    assert {r.position: r.len for r in ix.doc_len.collect()} == {0: 9, 1: 6, 2: 7} or ix.doc_len.count() == 3
    for token, n in ((r.token, r.df) for r in ix.frequencies().collect()):
        assert ix.postings.where(ix.postings.token == token).select("position").distinct().count() == n
    assert ix.stats().first()["n"] == 3


def test_bm25_against_brute_force(spark):
    ix = built(spark)
    got = {r.position: r.score for r in search.bm25(ix, search.Query("vessel levy vessel")).collect()}
    docs = {p: ((t or "").lower(), (h or "").lower()) for p, t, h, *_ in ROWS if t and len(t) >= 12}
    toks = {p: [w for w in re.findall(r"[a-z0-9]+(?:'[a-z]+)?", f"{h} {t}") if w not in STOPWORDS] for p, (t, h) in docs.items()}
    avg = sum(map(len, toks.values())) / len(toks)
    want = {}
    for w, times in (("vessel", 2), ("levy", 1)):
        held = [p for p in toks if w in toks[p]]
        idf = math.log(1 + (len(toks) - len(held) + 0.5) / (len(held) + 0.5))
        for p in held:
            tf = docs[p][0].count(w) + docs[p][1].count(w) + 1
            want[p] = want.get(p, 0) + times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks[p]) / avg))
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_boosts_and_filters(spark):
    ix = built(spark)
    top = search.search(ix, '"levy in full" vessel').first()
    assert top["position"] == 0 and 'phrase "levy in full"' in top["reasons"]
    assert [r.position for r in search.search(ix, "vessel", kind="definition").collect()] == [1]
    assert search.search(ix, "vessel", jurisdiction="commonwealth").count() == 0
    assert "section 7" in search.search(ix, "permit under s 7").first()["reasons"]
    assert search.search(ix, "the of and").count() == 0
    assert search.search(ix, "zebra").count() == 0


def test_citation(spark):
    rows = built(spark).records
    assert search.by_citation(rows, "b act", "7", "1").count() == 1 and search.by_citation(rows, "b act", "7", "2").count() == 0


def test_expansion(spark):
    ix = built(spark)
    wide = lexicon.expand(ix, "can the judge stop my boat")
    assert wide.added == ["tribunal", "suspend", "vessel"] and wide.reasons["vessel"] == "drafting term for boat"
    assert "vessel" in wide.as_query() and wide.describe().startswith("Also searched: tribunal")
    assert not lexicon.expand(ix, "vessel levy").changed


def test_packet(spark):
    ix = built(spark)
    packet = answer.ask(ix, "boat levy")
    assert packet.found and packet.to_dict()["extracts"][0]["register"].startswith("https://")
    assert packet.extracts[0].address in packet.as_prompt() and "A Act 1999 s 1" in packet.as_text()
    assert any("no date" in n for n in packet.notes)
    nothing = answer.ask(ix, "zebra")
    assert not nothing.found and "Nothing in the index" in nothing.as_text()
    assert answer.cite(ix, "B Act", "7").extracts[0].score == 1.0


def test_save_and_load(spark, tmp_path):
    ix = built(spark)
    index.save(ix, str(tmp_path / "ix"))
    again = index.load(spark, str(tmp_path / "ix"))
    a = [tuple(r) for r in search.search(ix, "vessel levy").collect()]
    assert a == [tuple(r) for r in search.search(again, "vessel levy").collect()] and a


def test_numbered(spark):
    df = spark.createDataFrame([(1, 5), (0, 3), (1, 4), (0, 9)], "d int, o int")
    assert [(r.d, r.o, r.position) for r in index.numbered(df, "d", "o").orderBy("position").collect()] == [(0, 3, 0), (0, 9, 1), (1, 4, 2), (1, 5, 3)]


def test_related_terms_on_data(spark, sf):
    ix = index.build(table(spark, sf, "records"))
    assert all(r.similarity >= 0.5 for r in lexicon.related_terms(ix, "tribunal").collect())
    assert lexicon.related_terms(ix, "zebra").count() == 0
