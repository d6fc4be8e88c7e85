"""Problem 2: mapping freely typed names to the entries of a reference list.

Method. Two tries are built from the list. The first holds the words of the entries letter by letter and is
searched with a Levenshtein automaton (insertion, deletion, replacement and exchange of neighbours): it
gives every word within a distance that grows with the length of what was typed. From any node past the
third letter an alias path leads to the ends of the words below, so "Insp." and even "Isnp" reach
"Inspection"; run-together words restart at the root. The second trie holds the entries word by word, with
alias paths for every order of the words and for their initials. Walking it with the words found gives all
entries within the length-dependent distance, each with its own; the nearest is the answer and all of them
are the candidates. Nothing is looked up by going through the list. Kind of instrument and year are read apart: spelled, cut or
misread ("Regn", "A.", "l99O", "'58"), and an entry of another kind or another year is never meant.

Each distinct value is resolved once per task (rows are not shuffled, so a value that a third of the rows
share costs no more than another). The list travels to the driver and the tasks only in blocks of about
BLOCK entries; a longer list is searched block by block and the best of the blocks' answers wins.

Defined results. status is exact (letter for letter an entry), matched, ambiguous (several entries fit
equally; none is given), unlisted or blank (null or blank). candidates holds every entry
within the distance, nearest first (only the entry itself where the value is exact). A word that stands in the
list is not taken for a slip for another one: entries near in that way are candidates and not the answer. Leading and trailing
remarks, quotation marks and jurisdictions in brackets (letters of a jurisdiction of the list, in order) are
no part of a name; a jurisdiction settles a tie. Without a year, a single
entry of the name and kind is meant. Repeated rows give one row each. An empty list leaves everything
unlisted; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of the list in one block.
BLOCK = 50_000
# Written forms of the kinds of instrument, and words that are remarks.
KINDS = {
    "act": ("act", "acts", "a"),
    "regulation": ("regulation", "regulations", "reg", "regs", "regn", "regns"),
    "rules": ("rules", "rule", "rls", "rl"),
    "code": ("code", "codes", "cd"),
    "ordinance": ("ordinance", "ordinances", "ord", "ordin", "ordce", "ords"),
}
REMARKS = set("the under as amended see notes note s ss sec section sections of in by to cited cf at".split())
MISREAD = str.maketrans({"l": "1", "i": "1", "|": "1", "!": "1", "o": "0", "s": "5", "g": "9", "z": "2", "b": "8", "q": "9"})

_TITLE = re.compile(r"^(?P<stem>.*\S)\s+(?P<kind>act|regulation|rules|code|ordinance)(?:\s+\((?P<jur>[^)]*)\))?(?:\s+(?P<year>\d{4}))?$")
_TOKEN = re.compile(r"(?:[^\W\d_]\.){1,}[^\W\d_](?![^\W\d_])\.?|'?[^\W_]+(?:[';][^\W_]+)*\.?|&")
_LEAD = re.compile(r"^\W*(?:s|ss|sec|section|sections|reg|cl)\.?\s*\d+[a-z]?(?:\(\w+\))*\s*(?:,|of)\s*", re.I)
_SWAPPED, _STUCK = re.compile(r"\b[a-z][A-Z]{2}"), re.compile(r"(?<=[a-z])(?=[A-Z][a-z])")
_BRACKET = re.compile(r"[(\[]\s*([A-Za-z.]{2,5})\s*[)\]]")


def _limit(n: int) -> int:
    """The distance allowed to a typed word of n letters."""
    return 0 if n < 3 else 1 if n < 5 else 2 if n < 9 else 3


class WordTrie:
    """Words by letters, searched with a Levenshtein automaton whose state is one row of distances."""

    def __init__(self, words):
        self.next: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.below: list[set[str]] = [set()]
        for w in words:
            at = 0
            for c in w:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.word.append(None)
                    self.below.append(set())
                at = self.next[at][c]
                self.below[at].add(w)
            self.word[at] = w

    def find(self, typed: str, limit: int, cut: bool) -> dict[str, float]:
        """Words within the limit and their distance; with cut also words of which a beginning is that near."""
        out: dict[str, float] = {}
        n = len(typed)

        def put(w: str, d: float) -> None:
            if d < out.get(w, 99):
                out[w] = d

        far = [limit + 1] * (n + 1)

        def step(node: int, depth: int, last: str, row: list[int], before: list[int] | None) -> None:
            low, high = max(1, depth + 1 - limit), min(n, depth + 1 + limit)  # cells beyond are farther than the limit
            for c, child in self.next[node].items():
                new = far[:]
                if depth < limit:
                    new[0] = depth + 1
                best = new[0]
                for j in range(low, high + 1):
                    d = row[j - 1] + (typed[j - 1] != c)
                    if new[j - 1] < d:
                        d = new[j - 1] + 1
                    if row[j] < d:
                        d = row[j] + 1
                    if before is not None and j > 1 and typed[j - 1] == last and typed[j - 2] == c and before[j - 2] < d:
                        d = before[j - 2] + 1
                    new[j] = d
                    if d < best:
                        best = d
                if self.word[child] is not None and new[n] <= limit:
                    put(self.word[child], new[n])
                if cut and depth + 1 >= 3 and new[n] <= (0 if n < 4 else 1):
                    for w in self.below[child]:  # alias path: cut off here
                        if len(w) > depth + 1:
                            put(w, new[n] + 0.5)
                if best <= limit:
                    step(child, depth + 1, c, new, row)

        step(0, 0, "", [min(j, limit + 1) for j in range(n + 1)], None)
        return out


class Entries:
    """The two tries over one block of the list."""

    def __init__(self, entries: list[tuple[int, str, str | None]]):
        self.exact = {}
        self.ids: list[tuple[int, str, str, str | None]] = []  # id, kind, year, jurisdiction
        paths: dict = {}
        self.initials: dict[str, list[int]] = defaultdict(list)
        words: set[str] = set()
        for ident, title, jurisdiction in sorted(entries, key=lambda e: (e[1] or "", e[0])):
            if not title:
                continue
            self.exact.setdefault(title, ident)
            m = _TITLE.match(" ".join(title.lower().split()))
            stem = [w for w in re.findall(r"[^\W_]+", m["stem"] if m else title.lower()) if w != "and"]
            if not stem:
                continue
            number = len(self.ids)
            self.ids.append((ident, m["kind"] if m else "", (m["year"] or "") if m else "", (jurisdiction or "").lower()))
            words.update(stem)
            letters = "".join(w[0] for w in stem)
            for n in range(min(3, len(letters)), len(letters) + 1):  # long names are also cited by their first initials
                self.initials[letters[:n]].append(number)
            orders = set(permutations(stem)) if len(stem) <= 4 else {tuple(stem[i:] + stem[:i]) for i in range(len(stem))}
            for order in orders:
                at = paths
                for w in order:
                    at = at.setdefault(w, {})
                at.setdefault(None, []).append(number)
        self.paths, self.words, self.trie = paths, words, WordTrie(words)
        self.longest = max(map(len, words), default=0) + 3  # nothing longer can be a word of the list
        kinds = {f: k for k, forms in KINDS.items() for f in forms}
        self.kinds, self.kind_trie = kinds, WordTrie([f for f in kinds if len(f) >= 4])
        self.act, self.joiner = WordTrie(["act"]), WordTrie(["and"])
        self.places = sorted({e[3] for e in self.ids if e[3]})
        self.near = lru_cache(200_000)(self._near)
        self.kind_of = lru_cache(50_000)(self._kind_of)
        self.joins = lru_cache(50_000)(self._joins)
        self.resolve = lru_cache(200_000)(self._resolve)

    def _near(self, token: str, dotted: bool) -> dict[str, float]:
        if len(token) > self.longest:
            return {}
        return self.trie.find(token, _limit(len(token)), cut=len(token) >= (3 if dotted else 4))

    def _kind_of(self, token: str, dotted: bool) -> tuple[str, float] | None:
        if token in self.kinds and (len(token) > 1 or dotted):
            return self.kinds[token], 0.0
        if len(token) > 16:
            return None
        found = self.kind_trie.find(token, 1 if len(token) < 8 else 2, cut=len(token) >= 5)
        best = min(found.items(), key=lambda x: (x[1], x[0]), default=None)
        if best:
            return self.kinds[best[0]], best[1]
        if 3 <= len(token) <= 4 and token not in self.words and self.act.find(token, 1, cut=False):
            return "act", 1.0
        return None

    def _joins(self, token: str) -> bool:
        """"and", also with one slip, unless that is a word of the list."""
        return token == "&" or 2 <= len(token) <= 4 and token.isalpha() and token not in self.words and bool(self.joiner.find(token, 1, cut=False))

    def _place(self, code: str) -> str | None:
        """The jurisdiction of the list whose letters, from the first on, a code keeps in their order."""
        found = [p for p in self.places if p[0] == code[0] and all(c in rest for rest in [iter(p)] for c in code)]
        return found[0] if len(found) == 1 and code not in self.words else None

    def _parts(self, token: str, depth: int = 3) -> list[list[str]]:
        """A run-together token as words of the list, restarting at the root after each."""
        out = []
        if len(token) > depth * self.longest:
            return out
        for i in range(min(len(token) - 2, self.longest), 2, -1):
            if (w := self.near(token[:i], False)) and min(w.values()) <= (0 if i < 6 else 1):
                rest = token[i:]
                for drop in (0, 3) if rest.startswith("and") else (0,):
                    tail = rest[drop:]
                    if len(tail) > 3 and (v := self.near(tail, False)) and min(v.values()) <= (1 if len(tail) < 10 else 2):
                        return [[token[:i], tail]]
                    if depth > 1 and len(tail) > 6 and (deep := self._parts(tail, depth - 1)):
                        return [[token[:i], *deep[0]]]
        return out

    def _resolve(self, typed: str) -> tuple[str, int, float, list[tuple[int, float]]]:
        """(status, id or 0, distance, all entries within the distance) of a value that is not blank."""
        if typed in self.exact:
            return "exact", self.exact[typed], 0.0, [(self.exact[typed], 0.0)]
        text = unicodedata.normalize("NFKC", typed)
        if _SWAPPED.search(text) and sum(c.isupper() for c in text) > sum(c.islower() for c in text):
            text = text.swapcase()
        hint = None
        for m in _BRACKET.finditer(text):
            code = m[1].replace(".", "").lower()
            place = self._place(code)
            if place or not self.near(code, False):
                hint = place or hint
                text = text.replace(m[0], " ")
        text = _LEAD.sub("", text)
        text = _STUCK.sub(" ", text).lower().replace("_", " ").replace("’", "'")
        tokens = [(t.rstrip("."), t.endswith(".")) for t in _TOKEN.findall(text)]
        year, short, words, places, dated = "", "", [], [], -1
        for place, (t, dotted) in enumerate(tokens):
            bare = t.lstrip("'")
            digits = bare.translate(MISREAD)
            if digits.isdigit() and any(c.isdigit() for c in bare):
                if len(digits) == 4 and digits[:2] in ("18", "19", "20"):
                    year, dated = year or digits, place
                    continue
                if len(digits) == 2 and (bare.isdigit() or t.startswith("'")):
                    short, dated = short or digits, place
                    continue
            if not t or self.joins(t):
                continue
            words.append((t, dotted))
            places.append(place)
        exact = [i for i, (t, dotted) in enumerate(words) if t in self.kinds and (len(t) > 1 or dotted)]
        if not exact:
            exact = [i for i, (t, dotted) in enumerate(words) if t not in self.words and t not in REMARKS and self.kind_of(t, dotted) and min(self.near(t, dotted).values(), default=9) > self.kind_of(t, dotted)[1]]
        kind, kind_cost = self.kind_of(*words[exact[-1]]) if exact else ("", 0.0)
        # Added words stand after kind and year, or before a remark ("reprint of the ..."); elsewhere they name another act.
        last = max([dated, *(places[i] for i in exact[-1:])])
        outer = [p > last >= 0 or p + 1 < len(tokens) and tokens[p + 1][0] in REMARKS for p in places]
        rest = [(*w, o) for i, (w, o) in enumerate(zip(words, outer)) if (not exact or i != exact[-1]) and not (w[0] in REMARKS and w[0] not in self.words)]

        def fits(i: int) -> bool:
            _, k, y, _ = self.ids[i]
            return (not kind or k == kind) and (not year or y == year) and (not short or y[2:] == short)

        found, others = self._walk(rest, fits) if rest else ({}, {})
        if not found and len(rest) == 1 and re.fullmatch(r"[a-z](?:\.?[a-z]){1,4}", rest[0][0]):
            letters = rest[0][0].replace(".", "")
            found = {i: 1.0 for i in self.initials.get(letters, ()) if fits(i)} if kind or year or short else {}
        nearest: dict[int, float] = {}
        for i, d in (*found.items(), *others.items()):
            nearest[self.ids[i][0]] = min(d + kind_cost, nearest.get(self.ids[i][0], 99))
        ranked = sorted(nearest.items(), key=lambda x: (x[1], x[0]))
        if not found:
            return "unlisted", 0, 0.0, ranked
        best = min(found.values())
        top = sorted(i for i, d in found.items() if d <= best)
        if len(top) > 1 and hint:
            top = [i for i in top if self.ids[i][3] == hint] or top
        if len({self.ids[i][0] for i in top}) > 1:
            return "ambiguous", 0, best + kind_cost, ranked
        return "matched", self.ids[top[0]][0], best + kind_cost, ranked

    def _walk(self, tokens: list[tuple[str, bool, bool]], fits: Callable[[int], bool]) -> tuple[dict[int, float], dict[int, float]]:
        """Entries within the whole's limit and the sum of their words' distances; those for which a word of the list must be a slip for another one apart."""
        steps: list[tuple[str, dict[str, float], bool]] = []
        for t, dotted, outer in tokens:
            near = self.near(t, dotted)
            if not near and len(t) > 7 and (parts := self._parts(t)):
                steps += [(p, self.near(p, False), False) for p in parts[0]]
            else:
                steps.append((t, near, outer and not near))
        limit = 1 + sum(len(t) for t, *_ in tokens) / 5
        out: tuple[dict[int, float], dict[int, float]] = {}, {}

        def go(at: dict, i: int, cost: float, slip: bool) -> None:
            if cost > limit:
                return
            if i == len(steps):
                for number in at.get(None, ()):
                    if cost < out[slip].get(number, 99) and fits(number):
                        out[slip][number] = cost
                return
            typed, near, foreign = steps[i]
            known = typed in self.words
            for w, d in near.items():
                if w in at:
                    go(at[w], i + 1, cost + d, slip or known and w != typed)
            if foreign:  # an added word that is no word of the list
                go(at, i + 1, cost + 1, slip)

        go(self.paths, 0, 0.0, False)
        return out


_CANDIDATES = pa.list_(pa.struct([("entry_id", pa.int64()), ("distance", pa.float64())]))


def list_blocks(entries: DataFrame, entry_id: str, title: str, jurisdiction: str) -> Iterator[list[tuple[int, str, str | None]]]:
    """The reference list in blocks of about BLOCK entries, one after the other; always one at least."""
    rows = entries.select(F.col(entry_id), F.col(title), F.col(jurisdiction))
    blocks = max(-(-rows.count() // BLOCK), 1)
    for k in range(blocks):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64(entry_id, title), F.lit(blocks)) == k).collect()]  # about BLOCK rows


def map_values(df: DataFrame, key: str, value: str, blocks: Iterable[list[tuple[int, str, str | None]]]) -> DataFrame:
    """key, typed, status, entry_id (0 if none), distance, candidates; one row per row of df. blocks: see list_blocks."""
    base = df.select(df[key], df[value].cast("string").alias("typed"))
    kind = base.schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, typed string, status string, entry_id bigint, distance double, candidates array<struct<entry_id: bigint, distance: double>>"
    parts = []
    for block in blocks:
        shared = df.sparkSession.sparkContext.broadcast(block)

        def per_batch(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Entries(shared.value)
            for batch in batches:
                got = [index.resolve(t) if t and t.strip() else ("blank", 0, 0.0, []) for t in batch.column(1).to_pylist()]
                held = pa.array([[{"entry_id": i, "distance": d} for i, d in g[3]] for g in got], _CANDIDATES)
                cols = [batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.float64()), held]
                yield pa.record_batch(cols, names=[key, "typed", "status", "entry_id", "distance", "candidates"])

        parts.append(base.mapInArrow(per_batch, schema))
    if len(parts) == 1:
        return parts[0]
    # Best over the blocks per typed value, so repeated rows stay; equal distances in two blocks are ambiguous.
    rank = F.when(F.col("status") == "exact", 0).when(F.col("status") == "matched", 1).when(F.col("status") == "ambiguous", 2).otherwise(3)
    every = None
    for part in parts:
        one = part.select("typed", "candidates", F.struct(F.when(rank == 3, 9e9).when(rank == 0, -1.0).otherwise(F.col("distance")).alias("d"), rank.alias("rank"), "status", "entry_id", "distance").alias("r")).dropDuplicates(["typed"])
        every = one if every is None else every.unionByName(one)
    every = every.groupBy("typed").agg(F.min("r").alias("r"), F.sort_array(F.collect_list("r.d")).alias("_d"), F.flatten(F.collect_list("candidates")).alias("_all"))  # one row a block
    tie = (F.col("r.rank") > 0) & (F.col("r.rank") < 3) & (F.element_at("_d", 2) == F.col("r.d"))
    order = F.transform(F.array_sort(F.transform("_all", lambda x: F.struct(x["distance"].alias("distance"), x["entry_id"].alias("entry_id")))), lambda x: F.struct(x["entry_id"].alias("entry_id"), x["distance"].alias("distance")))
    exact = F.array(F.struct(F.col("r.entry_id").alias("entry_id"), F.lit(0.0).alias("distance")))
    best = every.select(F.col("typed").alias("_typed"), F.when(tie, "ambiguous").otherwise(F.col("r.status")).alias("status"), F.when(tie, 0).otherwise(F.col("r.entry_id")).cast("bigint").alias("entry_id"), F.col("r.distance").alias("distance"), F.when(F.col("r.rank") == 0, exact).otherwise(order).alias("candidates"))
    return base.join(best, F.col("typed").eqNullSafe(F.col("_typed")), "left").select(key, "typed", "status", "entry_id", "distance", "candidates")
