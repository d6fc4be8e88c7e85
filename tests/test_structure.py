from pyspark.sql import functions as F

from tipstaff.operators import structure

ACT = [
    "Harbour Kiosk Act 2031\nAct No. 7 of 2031\nCurrent as at 4 March 2032",
    "Harbour Kiosk Act 2031\nTable of Contents\n1 Short title ........ 2\n2 Kiosk permits ........ 2",
    "Harbour Kiosk Act 2031\n[s 1]\nThis Act binds every kiosk on the harbour and its operators.\nPart 1\n1 Short title\nThis Act may be cited by its name.\nPart 2\n2 Kiosk permits\n"
    "(1) An operator must hold a permit under section 3 before trading.\n(2) A permit may be refused if-\n(a) the operator is subject to section 9 of the Tidal Works Act 1999; or\n(b) the kiosk is\nunsafe.\n(c) the fee is unpaid.\n"
    "3 Meaning of terms\nkiosk means a stall that floats.\npermit includes a renewal.",
]


def parsed(spark, pages=ACT, parity=False):
    rows = [(i + 1, 0, i + 1, t) for i, t in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id bigint, doc_ord int, page_no int, page_text string")
    titles = spark.createDataFrame([(0, "Harbour Kiosk Act 2031")], "doc_ord int, title string")
    return structure.provisions(df, titles, parity)


def test_provisions(spark):
    got = [(r.kind, r.section, r.subsection, r.paragraph, r.context, r.text) for r in parsed(spark).orderBy("node_ord").collect()]
    assert got == [
        ("section", "1", "", "", "Part 1", "This Act may be cited by its name."),
        ("section", "2", "", "", "Part 2", ""),
        ("subsection", "2", "1", "", "Part 2", "An operator must hold a permit under section 3 before trading."),
        ("subsection", "2", "2", "", "Part 2", "A permit may be refused if-"),
        ("paragraph", "2", "2", "a", "Part 2", "the operator is subject to section 9 of the Tidal Works Act 1999; or"),
        ("paragraph", "2", "2", "b", "Part 2", "the kiosk is unsafe."),
        ("paragraph", "2", "2", "c", "Part 2", "the fee is unpaid."),
        ("section", "3", "", "", "Part 2", ""),
        ("definition", "3", "", "", "Part 2", "kiosk means a stall that floats."),
        ("definition", "3", "", "", "Part 2", "permit includes a renewal."),
    ]


def test_parity_takes_c_for_a_subparagraph(spark):
    kinds = [r.kind for r in parsed(spark, parity=True).where("section = '2' and subsection = '2'").orderBy("node_ord").collect()]
    assert kinds == ["subsection", "paragraph", "paragraph", "subparagraph"]


def test_roman_inside_letters(spark):
    page = "Harbour Kiosk Act 2031\n5 Long lists here\n(1) One of:\n(a) first\n(i) inner one\n(ii) inner two\n(b) second"
    got = [(r.kind, r.paragraph, r.subparagraph) for r in parsed(spark, [page]).orderBy("node_ord").collect()]
    assert got == [("section", "", ""), ("subsection", "", ""), ("paragraph", "a", ""), ("subparagraph", "a", "i"), ("subparagraph", "a", "ii"), ("paragraph", "b", "")]


def test_address_and_full_text(spark):
    rows = parsed(spark)
    assert rows.where("paragraph = 'a'").first()["address"] == "Harbour Kiosk Act 2031 s 2(2)(a)"
    full = {r.address: r.full_text for r in structure.full_texts(rows).collect()}
    assert full["Harbour Kiosk Act 2031 s 2"].startswith("(1) An operator") and "(c) the fee is unpaid." in full["Harbour Kiosk Act 2031 s 2"]
    cut = structure.full_texts(rows, 40).where("address like '% s 2'").first()["full_text"]
    assert cut.endswith(" [...]") and len(cut) <= 47


def test_windows_agree_with_a_loop(spark, sf):
    """The running windows against one pass over the lines with open registers."""
    from tipstaff.plans.reference import _statute

    rows = structure.placed(_statute(spark, sf)).select("doc_ord", "line_no", "line", "chapter", "part", "division", "section", "subsection").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_ord, []).append(r)
    for doc in by.values():
        ch = pa = di = se = su = ""
        for r in sorted(doc, key=lambda r: r.line_no):
            w = r.line.split()
            if w[0] == "Chapter":
                ch, pa, di = w[1], "", ""
            elif w[0] == "Part":
                pa, di = w[1], ""
            elif w[0] == "Division":
                di = w[1]
            elif w[0] == "Schedule":
                ch = pa = di = se = su = ""
            elif w[0].isdigit():
                se, su = w[0], ""
            elif w[0][1:-1].isdigit() and se:
                su = w[0][1:-1]
            assert (r.chapter, r.part, r.division, r.section, r.subsection) == (ch, pa, di, se, su)


def test_empty(spark):
    assert parsed(spark, [""]).count() == 0
    docs = spark.createDataFrame([(0,), (7,)], "doc_ord int")
    report = {r.doc_ord: r for r in structure.parse_report(parsed(spark), docs).collect()}
    assert (report[0].sections, report[0].subsections, report[0].paragraphs, report[0].definitions, report[0].empty_sections) == (3, 2, 3, 2, 1)
    assert report[0].warnings == "1 of 3 sections have no text" and (report[7].sections, report[7].warnings) == (0, "no sections found")
    assert parsed(spark, [None]).select(F.count("*")).first()[0] == 0


def test_front_matter(spark):
    df = spark.createDataFrame([(i + 1, 0, i + 1, t) for i, t in enumerate(ACT)], "page_id bigint, doc_ord int, page_no int, page_text string")
    titles = spark.createDataFrame([(0, "Harbour Kiosk Act 2031")], "doc_ord int, title string")
    binds = "This Act binds every kiosk on the harbour and its operators."
    front = lambda t: structure.front_matter(df, t).first()["front_matter"].split("\n")
    assert front(titles.withColumn("profile", F.lit("QLD"))) == ["Act No. 7 of 2031", binds]
    assert front(titles) == ["Act No. 7 of 2031", "Current as at 4 March 2032", binds]  # marks of one office are text in the layout of none


def test_running_heads_and_parity(spark):
    """A heading with its name sets the context; the state machine's reading drops it as a running head."""
    pages = ["Part 3 Kiosks\n4 Fees\nA fee is due on the day named.\nQueensland\nPage 3 of 9\n- 4 -"]
    assert [(r.context, r.text) for r in parsed(spark, pages).collect()] == [("Part 3", "A fee is due on the day named.")]
    assert [r.context for r in parsed(spark, pages, parity=True).collect()] == [""]
