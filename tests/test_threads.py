from tipstaff.operators import threads
from tipstaff.operators.threads import references, same_act

OWN = ("Harbour Kiosk Act 2031", "2")


def test_references():
    got = [r[:3] for r in references("An operator must hold a permit under section 3 before trading.", *OWN)]
    assert got == [("Harbour Kiosk Act 2031", "3", "")]
    got = [r[:3] for r in references("subject to section 9(2) of the Tidal Works Act 1999; and in the way the officer in charge of it may direct see also the Reef Act 1980, which stands on its own and far from any number here", *OWN)]
    assert got == [("Tidal Works Act 1999", "9", "2"), ("Reef Act 1980", "", "")]
    assert references("under section 2 of this Act", *OWN) == []
    assert [r[:2] for r in references("the Tidal Works Act 1999 applies; " + "x " * 40 + "section 4", *OWN)] == [("Tidal Works Act 1999", "4"), ("Tidal Works Act 1999", "")]
    assert references(None, *OWN) == [] and references("", "", "") == []


def test_same_act():
    assert same_act("the Kiosk Act 2031", "Harbour Kiosk Act 2031") and not same_act("", "x") and not same_act("Reef Act 1980", "Kiosk Act 2031")


def test_edges_and_graph(spark):
    rows = [
        (0, "H s 2(1)", OWN[0], "2", "subsection", "Hold a permit under section 3."),
        (1, "H s 2(2)", OWN[0], "2", "subsection", "It is subject to section 9 of the Tidal Works Act 1999."),
        (2, "H s 3", OWN[0], "3", "section", "See section 9 of the Tidal Works Act 1999."),
        (3, "H s 4", OWN[0], "4", "paragraph", None),
    ]
    records = spark.createDataFrame(rows, "position bigint, address string, act string, section string, kind string, text string")
    edges = threads.edges(records).withColumn("edge_ord", threads.F.col("position"))
    got = [(r.source_address, r.target_act, r.target_section, r.relation) for r in edges.orderBy("position").collect()]
    assert got == [("H s 2(1)", OWN[0], "3", "refers to"), ("H s 2(2)", "Tidal Works Act 1999", "9", "subject to")]
    assert all("section" in r.quote for r in edges.collect())
    assert [tuple(r) for r in threads.reading_list(edges, records).collect()] == [("Tidal Works Act 1999", 1, "H s 2(2)")]
    assert threads.act_links(edges).collect()[0]["refs"] == 1
    assert threads.thread_stats(edges, records).first().asDict() == {"edges": 2, "acts": 1, "external_acts": 1}
    assert threads.outbound(edges, "H s 2(1)").count() == 1 and threads.inbound(edges, "tidal works act 1999", "9").count() == 1


def test_trace_ends_on_a_cycle(spark):
    rows = [(1, "Kiosk Act s 1", "Kiosk Act", "2"), (2, "Kiosk Act s 1", "Kiosk Act", "2"), (3, "Kiosk Act s 1(2)", "Kiosk Act", "2"), (4, "Kiosk Act s 2", "kiosk act", "1"), (5, "Kiosk Act s 2", "Reef", "5"), (6, "Great Reef Act s 5", None, None), (7, "Great Reef Act s 6", "Kiosk Act", "1")]
    e = spark.createDataFrame(rows, "edge_ord int, source_address string, target_act string, target_section string")
    places = [("Kiosk Act s 1", "Kiosk Act", "1"), ("Kiosk Act s 1(2)", "Kiosk Act", "1"), ("Kiosk Act s 2", "Kiosk Act", "2"), ("Great Reef Act s 5", "Great Reef Act", "5"), ("Great Reef Act s 6", "Great Reef Act", "6"), (None, None, "1")]
    records = spark.createDataFrame(places, "address string, act string, section string")
    got = sorted((r.level, r.edge_ord) for r in threads.trace(e, records, "kiosk", "1", 5).collect())
    assert got == [(1, 1), (1, 3), (2, 4), (2, 5), (3, 6)]  # the second of two parallel edges and what nothing points at stay out
    assert threads.trace(e, records, "kiosk", "1", 1).count() == 2 and threads.trace(e, records, "no such", "1").count() == 0


def test_suffix_test_without_cross_join(spark):
    acts = spark.createDataFrame([("Harbour Kiosk Act 2031",), (None,)], "act string")
    edges = spark.createDataFrame([(i, t, "s") for i, t in enumerate(["the Kiosk Act 2031", "Old Harbour Kiosk Act 2031", "Reef Act 1980", None, "REEF ACT 1980"])], "edge_ord int, target_act string, source_address string")
    assert {r.target_act for r in threads.reading_list(edges, acts).collect()} == {"Reef Act 1980", "REEF ACT 1980"}
