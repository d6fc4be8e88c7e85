from pathlib import Path

import pytest
from pyspark.sql import functions as F

from test_structure import ACT
from tipstaff.plans.build import build_index
from tipstaff.runtime import ordinal, shared_dir
from tipstaff.sources import files
from tipstaff.streaming import ingest


def test_read_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\ftwo \xff".encode("latin-1"))
    (tmp_path / "b.HTML").write_text("<p>x</p><p>y &amp; z</p>")
    (tmp_path / "c.pdf").write_bytes(b"no pdf")
    pages = files.read_pages(spark, [str(tmp_path)])
    got = {(r.path[-5:], r.page_no): r.page_text for r in pages.where("error is null").collect()}
    assert got["a.txt", 1] == "one" and got["a.txt", 2].startswith("two") and got[".HTML", 1] == "x\n y & z"
    assert files.skipped(pages).count() == 1
    with pytest.raises(FileNotFoundError):
        files.read_pages(spark, [str(tmp_path / "none.txt")])
    assert files.expand([str(tmp_path / "*.txt"), "nothing*"]) == ([str(tmp_path / "a.txt")], ["nothing*"])


def test_build_ask_and_cli(spark, tmp_path, capsys):
    from tipstaff import cli

    (tmp_path / "kiosk.txt").write_text("\f".join(ACT))
    out = str(tmp_path / "ix")
    index = build_index(spark, [str(tmp_path / "kiosk.txt")], out)
    assert index.records.count() == 9
    assert {r.address for r in index.records.where("section = '2' and paragraph = 'c'").collect()} == {"Harbour Kiosk Act 2031 s 2(2)(c)"}
    source = index.sources.first()
    assert (source.act, source.jurisdiction, source.currency, source.sections) == ("Harbour Kiosk Act 2031", "Queensland", "4 March 2032", 2)
    edges = sorted((r.source_address, r.target_act, r.target_section, r.relation) for r in spark.read.parquet(f"{out}/edges").collect())
    assert edges == [("Harbour Kiosk Act 2031 s 2(1)", "Harbour Kiosk Act 2031", "3", "refers to"), ("Harbour Kiosk Act 2031 s 2(2)(a)", "Tidal Works Act 1999", "9", "subject to")]
    for args, code in ((["ask", "who needs a permit for a kiosk"], 0), (["cite", "Harbour", "2"], 0), (["cite", "Harbour", "99"], 1), (["sources"], 0), (["cite", "Harbour", "2", "--json"], 0), (["threads", "--json"], 0), (["trace", "harbour", "2"], 0), (["trace", "harbour", "2", "--json"], 0), (["trace", "nothing", "2"], 1), (["check"], 1)):
        assert cli.main(["--index-dir", out, *args]) == code, args
    said = capsys.readouterr().out
    assert "Harbour Kiosk Act 2031 s 2" in said and '"trail": [' in said and "1 of 3 sections have no text" in said
    (tmp_path / "bad.pdf").write_bytes(b"no pdf")
    told, lost = [], []
    again = build_index(spark, [str(tmp_path / "kiosk.txt"), str(tmp_path / "bad.pdf")], out, profile="generic", on_progress=lambda *x: told.append(x), on_skip=lambda *x: lost.append(x))
    assert [(act, n) for _, act, n in told] == [("Harbour Kiosk Act 2031", 9)] and len(lost) == 1 and lost[0][0].endswith("bad.pdf") and lost[0][1]
    assert again.sources.first().profile == "generic" and again.built.endswith("UTC") and again.totals()[0] == 9
    assert not list((Path(shared_dir(spark)) / "tipstaff").glob("rejoined-*"))  # intermediate tables are gone
    assert cli.main(["--index-dir", str(tmp_path / "no"), "sources"]) == 1


def test_pdf_pages(monkeypatch):
    """With the optional package in place (here a stand-in): a page that cannot be read is empty, the others stay."""
    import sys
    import types

    class Page:
        def __init__(self, text):
            self.text = text

        def extract_text(self):
            if self.text == "bad":
                raise ValueError("broken page")
            return self.text

    class Reader:
        def __init__(self, stream):
            if stream.read() == b"locked":
                raise ValueError("File has not been decrypted")
            self.pages = [Page("one"), Page("bad"), Page(None)]

    monkeypatch.setitem(sys.modules, "pypdf", types.SimpleNamespace(PdfReader=Reader))
    assert files.pdf_pages(b"x") == ["one", "", ""]
    with pytest.raises(ValueError):
        files.pdf_pages(b"locked")
    monkeypatch.setitem(sys.modules, "pypdf", None)
    with pytest.raises(RuntimeError, match="optional package"):
        files.pdf_pages(b"x")


def test_ordinal_and_page_ids(spark):
    df = spark.createDataFrame([(f"p{i:03}", i % 5) for i in range(200)], "path string, n int").repartition(7)
    got = [(r.path, r.k, r.s) for r in ordinal(ordinal(df, "path", "k"), "path", "s", "n").collect()]
    assert sorted(got) == [(f"p{i:03}", i, sum(j % 5 for j in range(i))) for i in range(200)]
    pages = spark.createDataFrame([("a", 100_001, "x", None), ("b", 1, "y", None), ("c", None, None, "bad")], files.PAGES)
    ids = {(r.path, r.doc_ord): r.page_id for r in files.with_doc_ord(pages).collect()}
    assert set(ids) == {("a", 0), ("b", 1)} and len(set(ids.values())) == 2


def test_profiles(spark):
    from tipstaff.functions import detect

    assert [detect.profile_of(k).key for k in ("QLD", "cth", "", None, "nsw")] == ["qld", "cth", "generic", "generic", "generic"]
    heads = ["reprint 2 EFFECTIVE 1 May 2001", "[S 12]", "x [s 12] y", "comlaw", "Act No. 5 of 1990\nthis compilation was PREPARED on", "act no. 5 of 1990\nThis compilation was prepared on", "Reprinted"]
    df = spark.createDataFrame([(h,) for h in heads], "h string").select(detect.profile(F.col("h"), F.lit("x")))
    assert [r[0] for r in df.collect()] == ["qld", "generic", "qld", "cth", "cth", "generic", "generic"]


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("one two\fthree")
    stream = ingest.page_stream(spark, str(folder))
    ingest.run(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    (folder / "b.txt").write_text("four")
    ingest.run(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.page_text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["four", "one two", "three"]
    assert ingest.arrivals(spark.read.parquet(str(tmp_path / "out"))).agg(F.sum("words")).first()[0] == 4


def test_nearest_against_brute_force(spark):
    import numpy as np

    from tipstaff.operators.vectors import nearest

    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(60, None), (61, [0.0] * 8)], "vec_id bigint, e array<double>")
    got = {(r.query_id, r["rank"]): r.vec_id for r in nearest(df, df.where("vec_id % 20 = 0"), "vec_id", "e", 3).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in (0, 20, 40):
        s = np.round(u @ u[q], 4)
        s[q] = -9
        assert [got[q, k + 1] for k in range(3)] == list(np.lexsort((np.arange(60), -s))[:3])
