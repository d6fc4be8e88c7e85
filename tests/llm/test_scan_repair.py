import random

import pytest
from pyspark.sql import functions as F

from tipstaff.llm import scan_repair as sr
from tipstaff.runtime import table as load

FREE = sr.Marks(frozenset({"- # -", "printed from the shelf copy", "part # @", "shelf copy of @"}))


def test_furniture_by_shape_and_place():
    lines = ["Part 4   HARB�UR TENURE ACT 2022", "", "12 Dividend and dock", "A bridge is sealed in the year", "1964", "under the Harbour Tenure Act 2022.", "7", "Printed from tlie shelf copy"]
    assert sr.furniture(lines, "Harbour Tenure Act 2022", True, FREE) == [True, False, False, False, False, False, True, True]
    lines = ["river mouth", "Page 59", "Turnpike Ventilation Ordinance 1994", "xliv", "[s 3]", "(3) which", "why."]
    assert sr.furniture(lines, None, False, FREE) == [False, True, True, True, True, False, False]
    assert sr.furniture([""], None, True, FREE) == [False] and sr.furniture(["23"], "x", False, FREE) == [False]


@pytest.fixture(scope="module")
def reader():
    words = "lighthouse maximum penalty receive domestic sub-lessee well-head keeper harbour the a must certify reading turbine".split()
    known = {w: 5_000 for w in words}
    table = {("rn", "m"): 30, ("1", "l"): 60, ("cl", "d"): 40, ("c", "e"): 90, ("!", "i"): 50, ("ſ", "s"): 50, ("�", "e"): 20, ("�", "i"): 20, ("�", "a"): 20, ("ri", "n"): 30}
    editor = sr.Editor(table)
    editor.train(known)
    editor.train_gaps(known)
    return sr.Reader(known, editor)


def words(reader, text):
    lines = text.split("\n")
    stream = sr.stream_of(lines, [False] * len(lines))
    return [(stream[i][1], w) for i, _, w in reader.edits(stream)]


@pytest.mark.parametrize(
    "text, found",
    [
        ("the 1ighthouse keeper", [(1, "lighthouse")]), ("a dornestic keeper", [(1, "domestic")]), ("the rnax!mum,", [(1, "maximum")]), ("a light-\nhouse keeper", [(1, "lighthouse")]), ("a light‐ \nhouse", [(1, "lighthouse")]),
        ("the\nsub-les­\nsee must", [(2, "sub-lessee")]), ("well-\nhead", [(1, "well-head")]), ("pe nalty", [(1, "penalty")]), ("har- bour", [(1, "harbour")]), ("p�nalty", [(1, "penalty")]), ("the lighthouſe's", [(1, "lighthouse's")]),
        ("a keeper must", []), ("Plvuniqepaing 24a (3) 1961", []), ("", []), ("light-\n1ighthouse", [(2, "lighthouse")]),
    ],
)
def test_words(reader, text, found):
    assert words(reader, text) == found


def test_confusions_are_learned():
    known = {w: 1_000 for w in "maximum common member remain penalty tribunal harbour mooring market minister".split()}
    unknown = {w.replace("m", "rn", 1): 2 for w in known if "m" in w}
    assert sr.confusions(unknown, known).get(("rn", "m"), 0) >= 5


def test_a_rare_confusion_counts_by_its_own_evidence():
    """A confusion common in a hundred words does not hide one seen in three; torn parts and inflections are none."""
    often = {f"{a}e{b}{c}ing": 3_000 for a in "bdfgk" for b in "lnrst" for c in "bdgkm"}
    known = often | {w: 3_000 for w in "licence applied lantern furnace northern harbour bound treasurer under insured divided published".split()}
    unknown = {w.replace("e", "c", 1): 4 for w in often}
    unknown |= {w: 2 for w in "hcence apphed lantem fumace northem".split()} | {w: 20 for w in "bour urer insures divides publishes".split()}
    table = sr.confusions(unknown, known)
    assert table[("c", "e")] > 100 and table[("h", "li")] == 2 and table[("m", "rn")] == 3
    assert not {("r", "nd"), ("s", "d")} & set(table)
    editor = sr.Editor(table)
    editor.train(known)
    reader = sr.Reader(known, editor)
    assert [reader.fix(w) for w in ("hcence", "lantem", "insures")] == ["licence", "lantern", None]


def test_pages_join_over_furniture(spark, reader):
    pages = spark.createDataFrame(
        [(1, 0, 1, "The lighthouse keeper must cer-\n- 1 -"), (2, 0, 2, "Harbour Act 1990\ntify the harbour.\n- 2 -"), (2, 0, 2, "Harbour Act 1990\ntify the harbour.\n- 2 -"), (3, None, None, None), (4, 5, 1, ""), (5, 6, 1, "x" * 100_000), (6, 7, 1_999, "the har-"), (7, 7, 2_000, "- 2 -"), (8, 7, 2_001, None), (9, 7, 4_500, "bour")],
        "page_id bigint, doc_ord int, page_no int, page_text string",
    ).withColumn("edits", F.lit("clash"))
    docs = spark.createDataFrame([(0, "Harbour Act 1990"), (0, None)], "doc_ord int, title string")
    rows = sr.repaired_pages(sr.titled_pages(pages, docs), (reader.known, reader.editor, frozenset()), sr.Marks(frozenset({"- # -"}))).collect()
    got = {r.page_id: [(e.line_no, e.repaired) for e in r.edits] for r in rows}
    # also over pages without text, and over the blocks in which neighbours are found
    assert len(rows) == 9 and got == {1: [(2, ""), (1, "certify")], 2: [(1, ""), (3, "")], 3: [], 4: [], 5: [], 6: [(1, "harbour")], 7: [(1, "")], 8: [], 9: []}


def damage(text, rng):
    """Known damage to a clean text and what undoes it: the round trip the operator is held to."""
    out, truth = [], []
    for w in text.split():
        core = w.strip(".,;:()")
        if rng.random() < 0.06 and core.isalpha() and core.islower() and len(core) > 6:
            kind = rng.randrange(3)
            if kind == 0:
                k = rng.randrange(3, len(core) - 2)
                w = w.replace(core, f"{core[:k]} {core[k:]}")
            elif kind == 1:
                k = rng.randrange(3, len(core) - 2)
                w = w.replace(core, f"{core[:k]}- {core[k:]}")
            else:
                for a, b in rng.sample([("e", "c"), ("m", "rn"), ("i", "!"), ("d", "cl"), ("t", "f"), ("s", "5"), ("n", "ri")], 7):
                    if a in core:
                        w = w.replace(core, core.replace(a, b, 1))
                        break
                else:
                    out.append(w)
                    continue
            truth.append(core)
        out.append(w)
    return " ".join(out), truth


def test_held_out_accuracy(spark, sf):
    """Clean records damaged afresh: at least nine tenths of the words come back, and little else is touched."""
    records, pages, docs = (load(spark, sf.replace("sf0.001", "sf0.01"), t) for t in ("records", "act_pages", "act_documents"))
    texts = records.select(F.col("text").alias("t")).unionByName(pages.select(F.col("page_text").alias("t")))
    known, editor, right = sr.learn(texts, "t", records.select(F.col("act").alias("title")).unionByName(docs.select("title")))
    reader, rng = sr.Reader(known, editor, right), random.Random(5)
    clean = [r.text for r in records.where("text is not null and not text rlike '[^ -~]'").collect()]
    clean = [t for t in clean if "\n" not in t and not words(reader, t)][:500]
    hit = made = given = 0
    for t in clean:
        bad, truth = damage(t, rng)
        got = [w for _, w in words(reader, bad)]
        made, given = made + len(got), given + len(truth)
        hit += sum(min(got.count(w), truth.count(w)) for w in set(truth))
    assert given > 300 and hit >= 0.9 * given and hit >= 0.97 * made
    # Harm: right words the lexicon does not hold. Every word held out in turn from the lexicon of an editor trained
    # without it (ten parts), and made-up words of the letters of the collection.
    words_ = sorted(w for w in known if len(w) > 3 and w.isalpha())
    changed = 0
    for part in range(10):
        out = set(words_[part::10])
        kept = {w: n for w, n in known.items() if w not in out}
        blind = sr.Editor(editor.table)
        blind.train(kept)
        told = sr.Reader(kept, blind)
        changed += sum(told.fix(w) is not None for w in out)
    assert len(words_) > 500 and changed <= 0.01 * len(words_), changed
    made_up = ["".join(rng.choice("aeiou" if k % 2 else "bcdfghklmnprstvw") for k in range(rng.randrange(5, 11))) for _ in range(3_000)]
    assert sum(reader.fix(w) is not None for w in made_up) <= 3


def test_empty_collection(spark):
    pages = spark.createDataFrame([], "page_id bigint, doc_ord int, page_no int, page_text string")
    docs = spark.createDataFrame([], "doc_ord int, title string")
    records = spark.createDataFrame([], "position bigint, text string, act string")
    assert sr.repair_collection(pages, docs, records).count() == 0
    some = spark.createDataFrame([(1, None, None), (2, "a text", None)], "position bigint, text string, act string")
    assert {r.row_id: r.repaired_text for r in sr.repair_collection(pages, docs, some).collect()} == {1: "", 2: "a text"}


def test_compound_parted_at_its_own_hyphen_is_no_case(spark, reader):
    rows = spark.createDataFrame([(1, "the well-\nhead keeper\nmust cer-\ntify", None)], "position bigint, text string, act string")
    got = sr.repair(rows, "position", "text", "act", (reader.known, reader.editor, frozenset()), False).first()
    assert [(e.line_no, e.repaired) for e in got.edits] == [(3, "certify")] and got.repaired_text == "the well-head keeper must certify"


def test_letters_lost_and_added_are_learned():
    stems = "inspection harbour certify lighthouse department mooring allotment weighbridge penalty tribunal register labourer favourite honourable".split()
    known = {w: 5_000 for w in stems}
    unknown = {w.replace("t", "tt", 1): 3 for w in stems if "t" in w[1:-1]} | {w.replace("ou", "u", 1): 3 for w in stems if "ou" in w}
    table = sr.confusions(unknown, known)
    assert ("t", "") in table and ("u", "ou") in table
    editor = sr.Editor(table)
    editor.train(known)
    reader = sr.Reader(known, editor)
    assert [reader.fix(w) for w in ("inspecttion", "certtify", "harbur", "lighthuse")] == ["inspection", "certify", "harbour", "lighthouse"]
    assert reader.fix("inspection") is None and reader.fix("zebra") is None
    assert not sr.confusions({"locals": 9, "moored": 9, "fenced": 9}, {"local": 900, "moor": 900, "fence": 900, "moored": 0})  # inflections


def test_a_word_too_frequent_for_a_misreading_is_right():
    known = {w: 2_000 for w in "tender tunnel title tenant turbine statement court after".split()}
    unknown = {w.replace("t", "f", 1): 2 for w in known} | {"fender": 900}
    editor = sr.Editor({("f", "t"): 8})
    editor.train(known)
    right = sr.right_by_count(unknown, known, editor)
    assert right == {"fender"}
    reader = sr.Reader(known, editor, right)
    assert (reader.fix("fender"), reader.fix("funnel"), reader.fix("fenant")) == (None, "tunnel", "tenant")


def test_marks_of_a_collection_are_learned(spark):
    """A notice no rule knows, told by recurrence with the title put in, also where it is misread."""
    body = "The keeper must tell the officer of the harbour."
    rows = [(i, i, 1, f"Licensed text no. {i} <Kelp Works {i} Act 19{50 + i}>\n{body}\nIssued {i} May 19{50 + i}") for i in range(30)]
    rows.append((99, 99, 1, f"Liccnsed text no. 9 <Ke1p Works Act 1951>\n{body}\n{body}"))
    pages = spark.createDataFrame(rows, "page_id bigint, doc_ord int, page_no int, page_text string")
    docs = spark.createDataFrame([(i, f"Kelp Works {i} Act 19{50 + i}") for i in range(30)] + [(99, "Kelp Works Act 1951")], "doc_ord int, title string")
    marks = sr.page_marks(sr.titled_pages(pages, docs))
    assert marks.lines == {"licensed text no. # <@>", "issued # # #"}
    assert sr.furniture(rows[30][3].split("\n"), "Kelp Works Act 1951", True, marks) == [True, False, False]
    assert sr.furniture(rows[4][3].split("\n"), docs.collect()[4].title, True, marks) == [True, False, True]


def test_everything_learned_comes_from_all_words(spark):
    """More frequent unknown words than any bound on their number do not hide what rarer ones show."""
    right = "maximum common member remain harbour tribunal".split()
    letters = "zqxjkvwbdfghnpst"
    junk = ["zq" + "".join(letters[n >> s & 15] for s in (0, 4, 8, 12)) for n in range(20_500)]
    rows = [(" ".join(junk),)] * 2 + [(" ".join(right),)] * 60 + [("remain harbour tribunal maximurn cornmon mernber a",)]
    known, editor, _ = sr.learn(spark.createDataFrame(rows, "t string"), "t")
    assert set(known) == set(right) and editor.table == {("rn", "m"): 3}
    assert sr.Reader(known, editor).fix("rernain") == "remain"


def test_words_taken_as_right_are_sought_among_all(spark, monkeypatch):
    monkeypatch.setattr(sr, "WORDS_A_TASK", 3)
    known = {w: 2_000 for w in "tender tunnel title tenant turbine statement court after".split()}
    unknown = {w.replace("t", "f", 1): 2 for w in known} | {"fender": 900, "fenanf": 30, "zebra": 90, "": 50}
    editor = sr.Editor({("f", "t"): 8})
    editor.train(known)
    df = spark.createDataFrame([*unknown.items(), ("tender", 7)], "word string, n bigint").repartition(5)
    assert sr.all_right_by_count(df, known, editor) == sr.right_by_count(unknown, known, editor) == {"fender"}
    more = known | {w: 4_000 for w in "labels market locals reading".split()}
    read = {w: 3 for w in "tenfer funnel fitle labcls markct rcading local".split()}
    df = spark.createDataFrame(list(read.items()), "word string, n bigint").repartition(3)
    assert sr.all_confusions(df, more) == sr.confusions(read, more) == {("f", "t"): 2, ("c", "e"): 3}


def test_editor_is_trained_on_every_damaged_word_and_every_break(monkeypatch):
    monkeypatch.setattr(sr, "ROUNDS", 1)
    known = {f"{a}e{b}{c}e{d}": 9 for a in "bdfgklmn" for b in "lnrstvwz" for c in "bdgkmptv" for d in "nr"}
    table = {(a, "e"): 5 for a in "coauixy346890!"}
    editor, seen = sr.Editor(table), set()
    monkeypatch.setattr(sr.Editor, "features", staticmethod(lambda w, i, f=sr.Editor.features: seen.add(w) or f(w, i)))
    editor.train(known)
    damaged = {w[:i] + a + w[i + len(b) :] for w in known for a, b in table for i in range(len(w)) if w.startswith(b, i)}
    assert len(damaged) > 24_000 and damaged <= seen
    monkeypatch.undo()
    words_ = "harbour lighthouse penalty mooring".split()
    gaps, small = set(), sr.Editor({("c", "e"): 9})
    monkeypatch.setattr(sr.Reader, "gap_features", lambda self, a, b, last, f=sr.Reader.gap_features: gaps.add((a, b, last)) or f(self, a, b, last))
    small.train_gaps({w: 9 for w in words_})
    assert {(w[:i] + "-", w[i:], last) for w in words_ for i in range(2, len(w) - 1) for last in (True, False)} <= gaps
    assert {("ligh-", "thousc", True), ("lig-", "hthousc", True)} <= gaps
