import random

import pytest

from tipstaff.llm import canonical
from tipstaff.llm.canonical import Entries, WordTrie, map_values

LIST = [
    (1, "Wharfage Inspection Act 1958", "Queensland"), (2, "Oyster Auctions and Ferrymen Act 1958", "Unknown"), (3, "Cistern Weighing Act 1987", "Commonwealth"), (4, "Cistern Weighing Rules 1987", "Queensland"),
    (5, "Almshouse Storage Act 1959", "Queensland"), (6, "Almshouse Storage Act 1976", "Commonwealth"), (7, "Paddock Moorings Special Provisions Regulation 2013", None), (8, "Weir Inspection Ordinance 1965", ""), (9, None, None),
]


@pytest.mark.parametrize(
    "typed, meant",
    [
        ("wharfage inspection act 1958", 1), ("Whrafage Inspction Act 1958", 1), ("Wharf. Insp. A. 1958", 1), ("1958 Wharfage Inspection Act", 1), ("Inspection Act '58, Wharfage", 1), ("Inspection (Wharfage) Act", 1),
        ("WI Act 1958", 1), ("W.I Act l958", 1), ("WharfageInspection Act 1gS8", 1), ("wharfageinspection act 1958", 1), ("Wharfage_Inspection Act 1958", 1), ("under the Wharfage Inspection Act 1958 as amended", 1),
        ("Wharfage Inspection Act 1958 (Qld)", 1), ("wHARFAGE iNSPECTION aCT 1958", 1), ("s 42, Wharfage Inspection Act 1958 - see notes", 1), ("O.A.F Act 1958", 2), ("Oyster Auctions & Ferrymen Act", 2), ("Cistern Weighing Rls 1987", 4), ("PMS Regulation 2013", 7), ("Wir Inspection Ord. 65", 8),
        ("Wharfage Inspection Act 1959", 0), ("Wharfage Inspection Regulation 1958", 0), ("Wharfage Fencing Act 1958", 0), ("Wharfage Inspection and Kiosk Act 1958", 0), ("ibid.", 0), ("n/a", 0), ("-", 0), ("the Act", 0),
    ],
)
def test_names(typed, meant):
    assert Entries(LIST).resolve(typed)[1] == meant


def test_status():
    e = Entries(LIST)
    assert e.resolve("Almshouse Storage Act")[:2] == ("ambiguous", 0)
    assert e.resolve("Almshouse Storage Act (Cth)")[:2] == ("matched", 6)
    assert e.resolve("Cistern Weighing Act 1987")[:2] == ("exact", 3)
    assert Entries([]).resolve("Cistern Weighing Act 1987")[0] == "unlisted"
    assert e.resolve("x" * 50_000)[0] == "unlisted"


def test_all_entries_within_the_distance():
    """Also where a word is typed exactly: the nearest answers, the others are candidates."""
    e = Entries([(1, "Harbor Dues Act 1958", None), (2, "Harbour Dues Act 1958", None), (3, "Harbour Dues Act 1959", None), (4, "Barrow Duties Act 1958", None)])
    assert e.resolve("harbor dues act 1958") == ("matched", 1, 0.0, [(1, 0.0), (2, 1.0)])
    assert e.resolve("Harbour Dues Act")[3] == [(2, 0.0), (3, 0.0), (1, 1.0)]
    assert e.resolve("Harbor Duties Act 1958")[:2] == ("unlisted", 0) and e.resolve("Harbor Duties Act 1958")[3]


def test_candidates_against_brute_force():
    rng = random.Random(8)
    names = sorted({f"{a} {b}" for a in ("harbour", "harbor", "arbor", "harrow", "barrow") for b in ("dues", "duties", "dukes", "tolls")})
    e = Entries([(i, f"{n} Act 1958", None) for i, n in enumerate(names, 1)])
    for _ in range(40):
        words = [w[:k] + rng.choice("abeou") + w[k + rng.randrange(2) :] for w in rng.choice(names).split() for k in [rng.randrange(len(w))]]
        got = dict(e.resolve(f"{words[0]} {words[1]} act 1958")[3])
        want = {}
        for i, n in enumerate(names, 1):
            for x, y in ((0, 1), (1, 0)):
                ds = [osa(words[x], n.split()[0]), osa(words[y], n.split()[1])]
                if all(d <= canonical._limit(len(w)) for d, w in zip(ds, (words[x], words[y]))) and sum(ds) <= 1 + sum(map(len, words)) / 5:
                    want[i] = min(want.get(i, 99), sum(ds))
        assert {i: d for i, d in got.items() if d == int(d)} == want, words


def test_time_does_not_follow_the_list():
    import time

    rng = random.Random(2)
    made = lambda: "".join(rng.choices("bcdfglmnprst", k=3)) + rng.choice(["ing", "age", "ment", "works", "field"])
    words = [made() for _ in range(700)]
    took = []
    for n in (400, 40_000):
        e = Entries([(i, f"{rng.choice(words[: max(n // 4, 60)])} {rng.choice(words[: max(n // 4, 60)])} Act {rng.randrange(1950, 2020)}", None) for i in range(n)])
        typed = [f"{w[:4]}x{w[4:]} {v} act {rng.randrange(1950, 2020)}" for w, v in (rng.sample(words[:100], 2) for _ in range(150))]
        began = time.process_time()
        for t in typed:
            e.resolve(t)
        took.append((time.process_time() - began) / len(typed))
    assert took[1] < 6 * took[0] + 0.002, took  # seven times the words; a hundredfold list


def osa(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_brute_force():
    rng = random.Random(3)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 7))) for _ in range(150)})
    trie = WordTrie(words)
    for _ in range(60):
        t = "".join(rng.choices("abc", k=rng.randint(1, 8)))
        for limit in (0, 1, 2):
            assert trie.find(t, limit, False) == {w: osa(t, w) for w in words if osa(t, w) <= limit}


def test_table(spark, monkeypatch):
    rows = [(1, "WI Act 1958"), (2, None), (3, "  \t"), (4, "Cistern Weighing Act 1987"), (5, "Almshouse Storage Act"), (6, "zzz"), (6, "zzz"), (None, "WI Act 1958")]
    df = spark.createDataFrame(rows, "edge bigint, name string").selectExpr("*", "'c' as status", "'t' as typed")
    key = lambda d: sorted(((r.edge or 0), r.typed or "", r.status, r.entry_id) for r in d.collect())
    listed = spark.createDataFrame(LIST, "id bigint, title string, place string").selectExpr("*", "1 as typed")
    mapped = lambda d: map_values(d, "edge", "name", canonical.list_blocks(listed, "id", "title", "place"))
    whole = key(mapped(df))
    full = sorted(tuple(map(str, r)) for r in mapped(df).collect())
    assert [(s, i) for _, _, s, i in whole] == [("matched", 1), ("matched", 1), ("blank", 0), ("blank", 0), ("exact", 3), ("ambiguous", 0), ("unlisted", 0), ("unlisted", 0)]
    monkeypatch.setattr(canonical, "BLOCK", 2)
    assert key(mapped(df)) == whole and sorted(tuple(map(str, r)) for r in mapped(df).collect()) == full
    assert mapped(df.limit(0)).count() == 0
    assert {r.status for r in map_values(df, "edge", "name", [[]]).collect()} == {"blank", "unlisted"}
