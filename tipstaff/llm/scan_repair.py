"""Problem 4: repairing text that was read from scanned pages.

Three steps, each a pass over the pages or a join of small rows; whole texts throughout.

1. Lexicon. Words inside lines (not beside a line break, where words may be broken) are counted batch by
   batch and summed; words with at least SHARE of all occurrences are known. By that definition there are
   at most 1/SHARE of them, whatever the size of the collection, and only they go to every task.
2. Editor. What the collection's own unknown words differ by from known ones ("rn" for "m", "!" for "i", a letter
   lost or added) gives the confusions, each admitted by its own evidence; all unknown words are looked at, in tasks.
   Known words as they are and damaged by these confusions in every way train an averaged perceptron that scores for
   every character keep, replace, delete or insert, and for every line end, break mark or blank between two parts
   join, join with the hyphen, or split. A reading is taken only if it scores above keeping the word and is a known word:
   that exact check, and the choice to keep, leave rare but right words as they are. So does the count: an unknown
   word far more frequent than misreadings of its kind would make it is taken as right.
3. Furniture. Lines at page ends are masked (the document's title, numbers, months); what recurs there in many
   documents is a page mark of the collection. A line is told as furniture by its place from the top and the bottom
   of the page (in records, whose furniture stands inside the text, by shape alone) together with its shape, its
   likeness to a page mark with the title put in, or, where no title is known, the shape of one. What is left is
   read as one stream, so a word broken over a page end is joined with the first text word of the next page that
   has any, whichever furniture stands between.

Defined results. Null and empty texts have no edits and an empty repaired text. A page delivered twice
counts once (the greatest text of a page id); equal (doc, page_no) under two ids are both kept. Without a
title, shape and place decide alone. Rows without a document have no neighbours. Empty tables give no rows.
"""

from __future__ import annotations

import random
import re
import unicodedata
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import runs

#: A word with at least this share of all words is known, unless it is a likely misreading of one RATIO times as frequent.
SHARE, RATIO = 5e-6, 20
#: Words frequent enough to learn the confusions from.
SURE = 2e-5
#: Most rounds of the editor's training, and unknown words that one task looks at.
ROUNDS, WORDS_A_TASK = 15, 5_000
#: A masked line at a page's end that stands there in this share of the documents is furniture.
RECURS = 0.02
#: Longest masked line that can be a page mark: copies of a page have text lines in common too, which are longer.
LONGEST_MARK = 60
#: Pages of a document whose neighbours one task finds.
PAGE_BLOCK = 2_000
MARKS = "-¬‐­"
_EDGE = "\"“”„«»‘’'`.,;:()[]{}?/\\*…–—"
_REFERENCE = re.compile(r"^[(\[]?(?:\d[\d.,:/]*[a-z]{0,2}|[ivxlc]+|[a-z])[)\]]?$")
_YEARISH = re.compile(r"^[\dlOoISsgB�]{4}$")
_NUMBER = re.compile(r"^[\s\-–—|\[(]*(?=[lIO]*\d)[\dlIO]{1,4}[\s\-–—|\])]*$")
_ROMAN = re.compile(r"^m{0,2}(?:c[md]|d?c{0,3})(?:x[cl]|l?x{0,3})(?:i[xv]|v?i{0,3})$")
_MARKED = re.compile(r"^[\[({]\s*[sS5ſ]{1,2}\s+[\dlIO]+[A-Z]{0,2}\s*[\])}]?$|^[sS]{1,2}\s+\d+[A-Z]{0,2}\s*[\])}]$")
_PAGE = re.compile(r"^\W*(\S{3,5})\s+[\dlIO]{1,4}(?:\s+of\s+[\dlIO]{1,4})?\W*$")
# The months, which dates in page marks differ by.
MONTHS = "january february march april may june july august september october november december".split()
KIND = {"act", "regulation", "rules", "code", "ordinance"}


def _letters(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", s).lower() if c.isalpha())


def _near(a: str, b: str, least: float) -> bool:
    m = SequenceMatcher(None, a, b, autojunk=False)
    return m.real_quick_ratio() >= least and m.quick_ratio() >= least and m.ratio() >= least


_MONTH = re.compile(rf"\b(?:{'|'.join(MONTHS)})\b")


def masked(line: str, title: str | None = None) -> str:
    """A line in lower case with the title as @ and numbers and months as #."""
    low, name = " ".join(line.lower().split()), " ".join((title or "").lower().split())
    if len(name) > 7:
        low = low.replace(name, "@")
    return _MONTH.sub("#", re.sub(r"\d+", "#", low))


class Marks:
    """The page marks of a collection: masked lines, with the place of a title in some of them."""

    def __init__(self, lines: frozenset[str] = frozenset()):
        self.lines = lines
        self.plain = sorted(x for x in lines if "@" not in x and len(x) > 12)
        # words and letters beside a title; a title alone, or beside a number, is a running head anywhere
        self.titled = sorted({tuple(_letters(y) for y in x.split("@", 1)) for x in lines if "@" in x} | {("", "")})
        self.before = sorted({(len(y.split()), _letters(y)) for x in lines if "@" in x for y in [x.split("@", 1)[0]] if y.split()})

    def holds(self, line: str, title: str | None) -> bool:
        """Whether a line is a mark as it stands."""
        return masked(line, title) in self.lines

    def like(self, line: str) -> bool:
        """Whether a line is like a mark without a title, misread characters allowed for."""
        m = masked(line)
        return any(abs(len(m) - len(x)) < 6 and _near(m, x, 0.82) for x in self.plain)

    def like_titled(self, line: str, title: str | None) -> bool:
        """Whether a line is like a mark with the title in it, or, without a title, has the shape of one in its place."""
        if line[-1] in ".,;:" or len(line) < 8:
            return False
        letters, name = _letters(line), _letters(title or "")
        if len(name) > 6:
            for left, right in self.titled:
                wanted = left + name + right
                if abs(len(letters) - len(wanted)) <= 3 and _near(letters, wanted, 0.8):
                    return True
        core = re.sub(r"^\W*[\dlIO]{1,4}\s{2,}|\s{2,}[\dlIO]{1,4}\W*$", "", line)
        words = core.split()
        for n, left in (*self.before, (0, "")):
            head = _letters(" ".join(words[:n]))
            if len(words) > n + 2 and abs(len(head) - len(left)) <= 1 and (not n or _near(head, left, 0.7)) and _shaped(words[n:]):
                return True
        return False


NO_MARKS = Marks()


def furniture(lines: list[str], title: str | None, page: bool, marks: Marks = NO_MARKS) -> list[bool]:
    """Whether each line belongs to the page and not to the text."""
    inked = [i for i, line in enumerate(lines) if line.strip()]
    top = {i: n for n, i in enumerate(inked)}
    out = [False] * len(lines)
    if len(inked) == 1 and not page:
        return out
    for i in inked:
        line = lines[i].strip().strip("﻿​")
        end = min(top[i], len(inked) - 1 - top[i])
        if not line or page and end > 2:
            continue
        outer = not page or end <= 1
        if _NUMBER.match(line) or _MARKED.match(line):
            out[i] = True
        elif line.islower() and len(line) <= 9 and _ROMAN.match(line.replace("1", "l").replace("!", "i")) and (not page or end == 0 or _beside(out, i, inked, top)):
            out[i] = True
        elif (m := _PAGE.match(line)) and _near(_letters(m[1]) or m[1], "page", 0.6) and m[1][0] in "PpF�":
            out[i] = True
        elif outer and (page or len(line) > 12) and marks.holds(line, title):
            out[i] = True
        elif marks.like_titled(line, title):
            out[i] = True
        elif outer and line[0].isupper() and line[-1] not in ".,;:" and marks.like(line):
            out[i] = True
    return out


def _beside(out: list[bool], i: int, inked: list[int], top: dict[int, int]) -> bool:
    n = top[i]
    return any(0 <= k < len(inked) and out[inked[k]] for k in (n - 1, n + 1))


def _shaped(words: list[str]) -> bool:
    """Words that have the shape of a title: capitals, a kind of instrument and a year."""
    if len(words) < 3 or not _YEARISH.match(words[-1]) or sum(c.isdigit() for c in words[-1]) < 2:
        return False
    capital = all(w[0].isupper() or not w[0].isalpha() or len(w) <= 3 or _near(w.lower(), "and", 0.5) for w in words[:-1])
    return capital and any(_near(_letters(words[-2]), k, 0.66) for k in KIND)


def word_counts(df: DataFrame, column: str) -> DataFrame:
    """word and n over all words inside lines: neither beside a line break nor beside a break mark."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.replace_substring(pc.fill_null(batch.column(0), ""), "’", "'")
            row, start, stop, raw = runs.words(text, runs.LETTERS + "'-")
            padded = np.concatenate((np.full(3, 32, np.uint8), raw, np.full(3, 32, np.uint8)))
            plain = np.zeros(256, bool)
            plain[[ord(c) for c in " ,.;:()\"\0?"]] = True
            before, after = padded[start + 2], padded[stop + 3]
            good = plain[before] & plain[after] & (padded[start + 1] != 10) & (padded[start + 1] != 45) & (padded[start + 1] < 128) & (padded[stop + 4] != 10) & (before != 10) & (after != 10) & (stop - start > 1)
            edge = (padded[start + 3] != 39) & (padded[start + 3] != 45) & (padded[stop + 2] != 39) & (padded[stop + 2] != 45)
            keep = good & edge
            if not keep.any():
                continue
            coded = runs.word_strings(start[keep], stop[keep], raw).dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
            yield pa.record_batch([coded.dictionary, pa.array(n.astype(np.int64))], names=["word", "n"])

    return df.select(df[column].cast("string").alias("t")).mapInArrow(per_batch, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def unknown_counts(df: DataFrame, column: str, known: frozenset[str]) -> DataFrame:
    """word and n of the blank-separated words that are not known, for learning the confusions."""
    shared = df.sparkSession.sparkContext.broadcast(known)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good = set()
        for batch in batches:
            seen: Counter[str] = Counter()
            for t in batch.column(0).to_pylist():
                if t:
                    for w in set(t.split()) - good:
                        core = w.strip(_EDGE).lower()
                        if core in shared.value or _REFERENCE.match(core):
                            good.add(w)
                        elif 4 <= len(core) <= 24 and core[-1] not in MARKS:
                            seen[core] += 1
            yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return df.select(df[column].cast("string").alias("t")).mapInArrow(per_batch, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def evidence(known: dict[str, int]) -> Callable[[str, int], tuple[str, str, str, bool] | None]:
    """What an unknown word and its count show, if anything: the part read, the right one, the known word, whether before its end.

    Between letters, torn parts and right but rare inflections look like confusions too. So there an unknown word
    that begins or ends a known one is no evidence.
    """
    parts = {p for w in known for i in range(1, len(w)) for p in (w[:i], w[i:])}
    places: dict[tuple[str, str], list[str]] = defaultdict(list)
    for w in sorted(known):
        if len(w) >= 5:
            for i in range(len(w)):
                for m in (0, 1, 2):
                    if i + m <= len(w):
                        places[w[:i], w[i + m :]].append(w)

    def shown(u: str, count: int) -> tuple[str, str, str, bool] | None:
        best = None
        for i in range(len(u)):
            for m in (1, 2):
                if i + m > len(u):
                    continue
                for w in places.get((u[:i], u[i + m :]), ()):
                    k = len(w) - len(u) + m
                    a, b = u[i : i + m], w[i : i + k]
                    # replaced, or one character too many (m 1, k 0) or lost before another (m 1, k 2)
                    replaced = k >= 1 and a[0] != b[0] and a[-1] != b[-1]
                    if (replaced or m == 1 and k == 0 or m == 1 and k == 2 and a == b[1]) and (best is None or (len(a) + len(b), -known[w]) < best[0]):
                        best = ((len(a) + len(b), -known[w]), a, b, w, i + m < len(u), replaced or 0 < i and i + m < len(u))
        if best and known[best[3]] >= 10 * count and best[5]:
            letters = best[1].isascii() and best[1].isalpha()
            if not (letters and u in parts):
                return best[1], best[2], best[3], best[4] or not letters
        return None

    return shown


def admitted(seen: dict[tuple[str, str], tuple[int, bool]]) -> dict[tuple[str, str], int]:
    """Of (read, right) with the number of different known words and whether one is misread before its end: those with evidence enough.

    Each is admitted by its own evidence, however common others are: two or more different words, one of them misread
    before its end, where no inflection differs. A letter lost or added also tells inflections apart, so that takes a
    further word.
    """
    least = lambda k: 3 if k[0].isalpha() and (not k[1] or k[1][1:] == k[0]) else 2
    return {k: n for k, (n, inside) in seen.items() if n >= least(k) and inside}


def confusions(unknown: dict[str, int], known: dict[str, int]) -> dict[tuple[str, str], int]:
    """(read, right) parts by which unknown words differ from one known word, with the number of different words."""
    shown, seen, inside = evidence(known), defaultdict(set), set()
    for u, n in unknown.items():
        if got := shown(u, n):
            seen[got[:2]].add(got[2])
            if got[3]:
                inside.add(got[:2])
    return admitted({k: (len(v), k in inside) for k, v in seen.items()})


def all_confusions(unknown: DataFrame, known: dict[str, int]) -> dict[tuple[str, str], int]:
    """confusions of all rows (word, n) of a collection: words are looked at in tasks, pairs that two words show are collected."""
    shared = unknown.sparkSession.sparkContext.broadcast(known)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = evidence(shared.value)
        for batch in batches:
            found = [x for u, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (x := shown(u, n))]
            cols = [pa.array([x[k] for x in found], pa.string() if k < 3 else pa.bool_()) for k in range(4)]
            yield pa.record_batch(cols, names=["read", "meant", "word", "inside"])

    pairs = unknown.mapInArrow(per_batch, "read string, meant string, word string, inside boolean").groupBy("read", "meant").agg(F.count_distinct("word").alias("n"), F.max("inside").alias("inside"))
    return admitted({(r["read"], r["meant"]): (r["n"], r["inside"]) for r in pairs.where("n > 1").collect()})


class Editor:
    """Averaged perceptron over the characters of a word; a label is (characters read, what they mean)."""

    KEEP = (1, None)

    def __init__(self, table: dict[tuple[str, str], int]):
        self.labels: dict[str, list[tuple[int, str | None]]] = defaultdict(lambda: [self.KEEP])
        self.table = table
        for (a, b), _ in sorted(table.items()):
            self.labels[a[0]] = [*self.labels[a[0]], (len(a), b)]
        self.labels = dict(self.labels)
        self.weights: dict[tuple, float] = {}
        self.gaps: dict[tuple, float] = {}

    @staticmethod
    def features(w: str, i: int) -> tuple[str, ...]:
        p = f"^^{w}$$$"
        j = i + 2
        c, n = p[j], p[j + 1]
        return (f"{i} {w}", c, p[j - 1] + c, c + n, p[j - 1] + c + n, p[j - 2 : j] + c, c + p[j + 1 : j + 3], p[j - 2 : j] + "_" + n, p[j - 1] + "_" + p[j + 1 : j + 3], "p" + p[j - 2 : j], "n" + p[j + 1 : j + 3])

    def options(self, w: str, i: int) -> list[tuple[int, str | None]]:
        return [o for o in self.labels.get(w[i], ()) if o[1] is None or (w[i : i + o[0]], o[1]) in self.table]

    def score(self, feats: tuple[str, ...], label: tuple[int, str | None]) -> float:
        get = self.weights.get
        return sum(get((n, f, label), 0.0) for n, f in enumerate(feats))

    def train(self, known: dict[str, int], seed: int = 11) -> None:
        """Learns from every known word as it is and damaged in every way."""
        rng = random.Random(seed)
        words = sorted(w for w in known if len(w) >= 3)
        if not words or not self.table:
            return
        by_right: dict[str, list[str]] = defaultdict(list)
        for a, b in sorted(self.table):
            by_right[b].append(a)
        # A case is one number, as there may be millions: the word, the place, how many characters were replaced, and by what (0: none were).
        longest, most = max(map(len, words)) + 1, max(map(len, by_right.values())) + 1
        cases = array("Q", (x * longest * 3 * most for x in range(len(words))))
        for x, w in enumerate(words):
            for i in range(len(w)):
                for m in (0, 1, 2):
                    if i + m <= len(w) and (m or i):
                        at = ((x * longest + i) * 3 + m) * most
                        cases.extend(at + k for k, a in enumerate(by_right.get(w[i : i + m], ()), 1) if m or w[i - 1] != a)  # of two equal letters the first is the added one
        total: dict[tuple, float] = defaultdict(float)
        stamp: dict[tuple, int] = defaultdict(int)
        weights: dict[tuple, float] = defaultdict(float)
        self.weights = weights
        at = 0
        for _ in range(ROUNDS):
            rng.shuffle(cases)
            missed = 0
            for case in cases:
                case, k = divmod(case, most)
                case, m = divmod(case, 3)
                x, i = divmod(case, longest)
                w, edits = words[x], {}
                if k:
                    a, b = by_right[w[i : i + m]][k - 1], w[i : i + m]
                    w, edits = w[:i] + a + w[i + m :], {i: (len(a), b)}
                covered = {i + d for i, (n, _) in edits.items() for d in range(1, n)}
                for i in range(len(w)):
                    options = self.options(w, i)
                    if i in covered or len(options) < 2:
                        continue
                    at += 1
                    feats = self.features(w, i)
                    right = edits.get(i, self.KEEP)
                    guess = max(options, key=lambda o: self.score(feats, o))
                    if guess != right:
                        missed += 1
                        for label, step in ((right, 1.0), (guess, -1.0)):
                            for n, f in enumerate(feats):
                                k = (n, f, label)
                                total[k] += (at - stamp[k]) * weights[k]
                                stamp[k] = at
                                weights[k] += step
            if not missed:
                break
        self.weights = {k: v for k in weights if (v := (total[k] + (at - stamp[k]) * weights[k]) / max(at, 1)) != 0}

    def readings(self, w: str, most: int = 2) -> Iterator[tuple[float, str]]:
        """Other readings of a word, by number of changes and then from the best score down."""
        ops = []
        for i in range(len(w)):
            options = self.options(w, i)
            if len(options) > 1:
                feats = self.features(w, i)
                keep = self.score(feats, self.KEEP)
                ops += [(self.score(feats, o) - keep, i, o) for o in options if o[1] is not None]
        ops.sort(key=lambda x: (-x[0], x[1]))
        for s, i, (n, b) in ops:
            yield s, w[:i] + b + w[i + n :]
        if most > 1:
            two = []
            for x in range(len(ops)):
                for y in range(x + 1, len(ops)):
                    (s, i, (n, b)), (t, j, (m, d)) = sorted((ops[x], ops[y]), key=lambda o: o[1])
                    if i + n <= j:
                        two.append((s + t, w[:i] + b + w[i + n : j] + d + w[j + m :]))
            two.sort(key=lambda x: -x[0])
            yield from two


    def gap(self, feats: tuple, options: list[str]) -> str:
        """What to do between two parts; split where nothing else scores more."""
        return max(options, key=lambda o: (sum(self.gaps.get((f, o), 0.0) for f in feats), o == SPLIT))

    def train_gaps(self, known: dict[str, int], seed: int = 13) -> None:
        """Learns the labels of gaps from known words broken in every way, whole and misread, and from words that stand side by side."""
        rng = random.Random(seed)
        reader, words = Reader(known, self), sorted(w for w in known if len(w) >= 4 and w.isalpha())
        right: dict[str, list[str]] = defaultdict(list)
        for a, b in sorted(self.table):
            right[b].append(a)
        others = rng.sample(words, len(words))
        # Parts that show the same are one case, however many there are.
        cases: dict[tuple, int] = {}
        examples = array("L")

        def add(a: str, b: str, last: bool, label: str, times: int = 1) -> None:
            feats, held = reader.gap_features(a, b, last)
            if label == SPLIT or label in held:
                examples.extend([cases.setdefault((feats, (SPLIT, *held), label), len(cases))] * times)

        for n, w in enumerate(words):
            for i in range(2, len(w) - 1):
                x, y = w[:i], w[i:]
                alone = x in known and y in known
                for last in (True, False):
                    add(x + "-", y, last, JOIN)
                    add(x, y, last, SPLIT if alone else JOIN)
                    if alone:  # a word of two words: what parts it is told by the mark alone
                        add(x + "-", y, last, JOIN, 4)
                        add(x, y, last, SPLIT, 4)
                for k in range(len(y)):
                    for m in (1, 2):
                        for a in right.get(y[k : k + m], ()) if k + m <= len(y) else ():
                            add(x + "-", y[:k] + a + y[k + m :], True, JOIN)
                other = others[(n + i) % len(words)]  # beside as many other words as it has breaks
                for last in (True, False):
                    add(w, other, last, SPLIT)
                    if w + other not in known:
                        add(w + "-", other, last, HYPHEN)
            reader.read.clear()
        for w in sorted(w for w in known if "-" in w.strip("-")):
            x, y = w.split("-", 1)
            add(x + "-", y, True, HYPHEN)
        total, weights, at = defaultdict(float), defaultdict(float), 0
        self.gaps = weights
        kinds = list(cases)
        for _ in range(6):
            rng.shuffle(examples)
            for case in examples:
                feats, options, label = kinds[case]
                guess = self.gap(feats, options)
                at += 1
                if guess != label:
                    for f in feats:
                        for o, step in ((label, 1.0), (guess, -1.0)):
                            weights[f, o] += step
                            total[f, o] += at * step
        self.gaps = {k: v for k in weights if (v := weights[k] - total[k] / max(at, 1)) != 0}


JOIN, HYPHEN, SPLIT = "join", "hyphen", "split"


class Reader:
    """Known words and the trained editor: what a word of the text should read. right: unknown words to be kept."""

    def __init__(self, known: dict[str, int], editor: Editor, right: frozenset[str] = frozenset()):
        self.known, self.editor, self.right = known, editor, right
        self.read: dict[str, str | None] = {}
        self.whole: dict[str, bool] = {}

    def is_known(self, w: str) -> bool:
        if w in self.known:
            return True
        if w.endswith("'s"):
            return w[:-2] in self.known
        if w.endswith("'") and w[:-1] in self.known:
            return True
        if "-" in w:
            parts = w.split("-")
            return all(len(p) > 2 and p in self.known for p in parts)
        return False

    def fix(self, w: str) -> str | None:
        """The known word that an unknown one stands for, if one scores above keeping it."""
        if w not in self.read:
            got = None
            plain = unicodedata.normalize("NFKC", w)
            if plain != w and self.is_known(plain):
                got = plain
            elif w not in self.right:
                for score, r in self.editor.readings(plain, 2 if len(plain) > 4 else 1):
                    if score > 0 and self.is_known(r):
                        got = r
                        break
            self.read[w] = got
        return self.read[w]

    def fine(self, token: str) -> bool:
        """Whether a blank-separated token needs no look."""
        got = self.whole.get(token)
        if got is None:
            core = token.replace("’", "'").strip(_EDGE).lower()
            got = token[-1] not in MARKS and (not core or self.is_known(core) or bool(_REFERENCE.match(core)) or not any(c.isalpha() or c == "�" for c in core))
            if len(self.whole) < 1_000_000:
                self.whole[token] = got
        return got

    def _core(self, token: str) -> str:
        return token.replace("’", "'").strip(_EDGE).lower()

    def _word(self, token: str) -> str | None:
        """The right word of a token that is damaged by itself, None if it is right or beyond repair."""
        core = self._core(token)
        if not core or self.is_known(core) or _REFERENCE.match(core):
            return None
        for form in dict.fromkeys((core, token.replace("’", "'").lower().rstrip(_EDGE), token.replace("’", "'").lower().lstrip(_EDGE), token.lower())):
            if len(form) > 2 and (got := self.fix(form)):
                return got
            if form.endswith(("'s", "�s")) and len(form) > 5 and (got := self.fix(form[:-2])):
                return got + "'s"
        return None

    def gap_features(self, a: str, b: str, last: bool) -> tuple[tuple, dict[str, str]]:
        """What two neighbouring tokens show about the gap between them, and the known words that joining them makes."""
        marked = len(a) > 1 and a[-1] in MARKS
        left, right = a.replace("’", "'").lstrip(_EDGE).lower(), self._core(b)
        left = left[:-1] if marked else left
        held: dict[str, str] = {}
        if not left or not right or not any(c.isalpha() for c in right):
            return (), held
        whole, joint = left + right, f"{left}-{right}"
        exact = whole in self.known or (marked and self.is_known(whole)) or (whole.endswith("'s") and whole[:-2] in self.known)
        if exact:
            held[JOIN] = whole
        if marked and (joint in self.known or self.is_known(joint) or joint.endswith("'s") and joint[:-2] in self.known):
            held[HYPHEN] = joint
        if marked and not held:
            for label, form in ((JOIN, whole), (HYPHEN, joint)):
                if len(form) > 4 and (got := self.fix(form)):
                    held[label] = got
                    break
        ends = (marked, last, self.is_known(self._core(a[:-1] if marked else a)), self.is_known(right))
        shows = (exact, JOIN in held, HYPHEN in held)
        return (("b",), ("m", marked, *shows), ("k", *ends[2:], marked), ("all", *ends, *shows), ("n", min(len(left), 6), min(len(right), 6), marked)), held

    def _joined(self, a: str, b: str, last: bool) -> str | None:
        """The word that two parts make, if the editor joins them."""
        feats, held = self.gap_features(a, b, last)
        return held.get(self.editor.gap(feats, [SPLIT, *held])) if held else None

    def edits(self, stream: list[tuple[str, int, bool]]) -> list[tuple[int, int, str]]:
        """(index, tokens used, right word) over a stream of (token, line, last of its line)."""
        out, i, n = [], 0, len(stream)
        while i < n:
            token = stream[i][0]
            if self.fine(token) and (i + 1 >= n or self.fine(stream[i + 1][0]) or stream[i + 1][0][-1] in MARKS):
                i += 1
                continue
            marked = len(token) > 1 and token[-1] in MARKS
            if i + 1 < n and (marked or token[-1].isalpha() or token[-1] == "�"):
                if whole := self._joined(token, stream[i + 1][0], stream[i][2]):
                    out.append((i, 2, whole))
                    i += 2
                    continue
            if not self.fine(token) and not marked and (got := self._word(token)):
                out.append((i, 1, got))
            i += 1
        return out


def stream_of(lines: list[str], drop: list[bool]) -> list[tuple[str, int, bool]]:
    out = []
    for number, line in enumerate(lines):
        if not drop[number]:
            tokens = line.split()
            out += [(t, number + 1, k == len(tokens) - 1) for k, t in enumerate(tokens)]
    return out


def paragraphs(lines: list[str], drop: list[bool], stream: list[tuple[str, int, bool]], edits: list[tuple[int, int, str]]) -> str:
    """The text without furniture, words repaired, lines joined into paragraphs."""
    change = {i: (used, word) for i, used, word in edits}
    starts = set()
    fresh = True
    for number, line in enumerate(lines):
        if drop[number]:
            continue
        if not line.strip():
            fresh = True
            continue
        if fresh or re.match(r"^\s{2,}\S|^\(\w{1,3}\)\s|^\d+[A-Z]?\s+[A-Z]", line):
            starts.add(number + 1)
        fresh = bool(re.match(r"^\d+[A-Z]?\s+[A-Z][^.]*$", line)) and len(line) < 60
    out, i, seen = [], 0, set()
    while i < len(stream):
        token, line, _ = stream[i]
        if line in starts and line not in seen:
            seen.add(line)
            out.append([])
        if not out:
            out.append([])
        if i in change:
            used, word = change[i]
            last = stream[min(i + used - 1, len(stream) - 1)][0]
            head = token[: len(token) - len(token.lstrip(_EDGE))]
            tail = last[len(last.rstrip(_EDGE)) :]
            first = token.lstrip(_EDGE)[:1]
            out[-1].append(head + (word.capitalize() if first.isupper() else word) + tail)
            i += used
        else:
            out[-1].append(token)
            i += 1
    return "\n\n".join(" ".join(p) for p in out)


def single_changes(reader: Reader, w: str) -> list[tuple[str, str, str]]:
    """(reading, part read, part meant) for every one change that makes the reading of an unknown word of it."""
    got = reader.fix(w)
    if got not in reader.known:
        return []
    return [(got, w[i : i + n], b) for i in range(len(w)) for n, b in reader.editor.options(w, i) if b is not None and w[:i] + b + w[i + n :] == got]


def too_often(known: dict[str, int], editor: Editor, seen: dict[tuple[str, str], int]) -> Callable[[int, str, str, str], bool]:
    """Whether a count is far above what misreadings of a known word would make, of a change seen so often: 20 times, and 20 more."""
    spots = {b: sum(n * w.count(b) for w, n in known.items() if b in w) for b in {b for _, b in editor.table if b}}
    # a word is no evidence for itself
    return lambda n, got, a, b: bool(b) and n > 20 * (known[got] * (seen[a, b] - n) / max(spots.get(b, 0), 1) + 1)


def right_by_count(unknown: dict[str, int], known: dict[str, int], editor: Editor) -> frozenset[str]:
    """Unknown words seen far more often than misreadings of a known word would make them."""
    reader, seen = Reader(known, editor), Counter()
    held = [(w, *x) for w in unknown for x in single_changes(reader, w)]
    for w, _, a, b in held:
        seen[a, b] += unknown[w]
    often = too_often(known, editor, seen)
    return frozenset(w for w, got, a, b in held if often(unknown[w], got, a, b))


def all_right_by_count(unknown: DataFrame, known: dict[str, int], editor: Editor) -> frozenset[str]:
    """right_by_count of all rows (word, n) of a collection that are not known: words are read in tasks, only right ones are collected."""
    from ..runtime import materialize

    if not editor.table:
        return frozenset()
    sc = unknown.sparkSession.sparkContext
    learned = sc.broadcast((known, editor))

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*learned.value)
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            rows = [(w, n, *x) for w, n in pairs if w not in reader.known for x in single_changes(reader, w)]
            reader.read.clear()
            cols = [pa.array([r[k] for r in rows], pa.int64() if k == 1 else pa.string()) for k in range(5)]
            yield pa.record_batch(cols, names=["word", "n", "got", "read", "meant"])

    held = materialize(unknown.mapInArrow(changes, "word string, n bigint, got string, read string, meant string"), "changes")
    seen = {(r["read"], r["meant"]): r["n"] for r in held.groupBy("read", "meant").agg(F.sum("n").alias("n")).collect()}  # at most one row a confusion
    counted = sc.broadcast(seen)

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = too_often(*learned.value, counted.value)
        for batch in batches:
            kept = [often(*x) for x in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)))]
            yield pa.record_batch([batch.column(0).filter(pa.array(kept, pa.bool_()))], names=["word"])

    return frozenset(r["word"] for r in held.where("n > 20").mapInArrow(above, "word string").distinct().collect())


def learn(texts: DataFrame, column: str, titles: DataFrame | None = None, title: str = "title") -> tuple[dict[str, int], Editor, frozenset[str]]:
    """Known words, the trained editor and the unknown words taken as right, of a collection: from all of its words."""
    from ..runtime import materialize

    counts = word_counts(texts, column)
    if titles is not None:
        counts = counts.unionByName(word_counts(titles, title)).groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") >= max(SHARE * total, 3)).toPandas()  # at most 1/SHARE words
    often = dict(zip(rows["word"], (int(x) for x in rows["n"])))
    known = {w: n for w, n in often.items() if n >= max(SURE * total, 3)}
    unknown = materialize(unknown_counts(texts, column, frozenset(known)), "unknown")
    unknown = unknown.repartition(unknown.count() // WORDS_A_TASK + 1)
    editor = Editor(all_confusions(unknown, known))
    # A frequent word that is a likely misreading of a far more frequent one is none of the known words.
    lexicon = {w: n for w, n in often.items() if not any(often.get(r, 0) >= RATIO * n for _, r in editor.readings(w, 1))}
    editor.train(lexicon)
    editor.train_gaps(lexicon)
    right = all_right_by_count(unknown, lexicon, editor)
    return {w: n for w, n in often.items() if w in lexicon or w in right}, editor, right


_EDITS = "array<struct<line_no: int, repaired: string>>"


def _edit_array(rows: list[list[tuple[int, str]]]) -> pa.Array:
    return pa.array([[{"line_no": a, "repaired": b} for a, b in r] for r in rows], pa.list_(pa.struct([("line_no", pa.int32()), ("repaired", pa.string())])))


def repair(df: DataFrame, key: str, text: str, title: str, learned: tuple, page: bool, marks: Marks = NO_MARKS, after: str | None = None, before: str | None = None, with_text: bool = True) -> DataFrame:
    """key, edits and repaired_text of every row; after and before name the columns with the neighbours' edge words."""
    base = df.select(df[key], df[text].cast("string").alias("_t"), df[title].cast("string").alias("_n"), *[(df[c] if c else F.lit(None).cast("string")).alias(x) for c, x in ((after, "_after"), (before, "_before"))])
    shared = df.sparkSession.sparkContext.broadcast((*learned, marks))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *known, often = shared.value
        reader = Reader(*known)
        for batch in batches:
            found, texts = [], []
            for t, name, head, tail in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))):
                if not t:
                    found.append([])
                    texts.append("")
                    continue
                lines = t.split("\n")
                drop = furniture(lines, name, page, often) if len(lines) > 1 or page else [False]
                stream = stream_of(lines, drop)
                own = len(stream)
                skip = bool(tail and stream and reader._joined(tail, stream[0][0], True))
                whole = stream + ([(head, 0, False)] if head and stream and stream[-1][0][-1] in MARKS else [])
                edits = [(i + skip, used, w) for i, used, w in reader.edits(whole[skip:])]
                edits = [e for e in edits if e[0] < own]
                # A compound that the line only parts at its own hyphen is joined in the text but is no damage.
                own_hyphen = lambda i, used, w: used == 2 and whole[i][0][-1] == "-" and w.startswith(whole[i][0].lstrip(_EDGE).lower())
                found.append(list(dict.fromkeys([(i + 1, "") for i, d in enumerate(drop) if d] + [(stream[i][1], w) for i, used, w in edits if not own_hyphen(i, used, w)])))
                texts.append(paragraphs(lines, drop, stream, edits) if with_text else "")
            cols = [batch.column(0), _edit_array(found)] + ([pa.array(texts, pa.string())] if with_text else [])
            yield pa.record_batch(cols, names=[key, "edits"] + (["repaired_text"] if with_text else []))

    kind = base.schema[0].dataType.simpleString()
    return base.mapInArrow(per_batch, f"`{key}` {kind}, edits {_EDITS}" + (", repaired_text string" if with_text else ""))


def page_edges(pages: DataFrame, marks: Marks) -> DataFrame:
    """doc_ord, page_no, the first text word (first; null on a page without text) and the last one if it is broken (broken)."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, broken = [], []
            for t, name in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                lines = (t or "").split("\n")
                stream = stream_of(lines, furniture(lines, name, True, marks))
                first.append(stream[0][0] if stream else None)
                broken.append(stream[-1][0] if stream and len(stream[-1][0]) > 1 and stream[-1][0][-1] in MARKS else None)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(first, pa.string()), pa.array(broken, pa.string())], names=["doc_ord", "page_no", "first", "broken"])

    return pages.select("doc_ord", "page_no", "page_text", "title").mapInArrow(per_batch, "doc_ord int, page_no int, first string, broken string")


def neighbours(edges: DataFrame) -> DataFrame:
    """doc_ord, page_no, after (first word of the next page with text) and before (broken last word of the page with text before).

    Pages meet their neighbours in blocks of PAGE_BLOCK page numbers; only each block's ends meet those of others.
    """
    once = edges.where("doc_ord is not null and page_no is not null").groupBy("doc_ord", "page_no").agg(F.min("first").alias("first"), F.min("broken").alias("broken"))
    once = once.withColumn("block", F.floor(F.col("page_no") / PAGE_BLOCK))
    text = F.when(F.col("first").isNotNull(), F.struct("first", "broken"))  # pages without text are passed over
    ends = once.groupBy("doc_ord", "block").agg(F.min_by(text, F.when(text.isNotNull(), F.col("page_no"))).alias("head"), F.max_by(text, F.when(text.isNotNull(), F.col("page_no"))).alias("tail"))
    across = Window.partitionBy("doc_ord").orderBy("block")
    ends = ends.select("doc_ord", "block", F.first("head", True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("next"), F.last("tail", True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("last"))
    within = Window.partitionBy("doc_ord", "block").orderBy("page_no")
    rows = once.withColumn("_a", F.first(text, True).over(within.rowsBetween(1, Window.unboundedFollowing))).withColumn("_b", F.last(text, True).over(within.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.join(ends, ["doc_ord", "block"])
    return rows.select("doc_ord", "page_no", F.coalesce("_a", "next")["first"].alias("after"), F.coalesce("_b", "last")["broken"].alias("before"))


def page_marks(pages: DataFrame) -> Marks:
    """Masked lines that stand first, last or last but one on a page in at least RECURS of the documents: at most 3/RECURS a page. pages: with title."""
    lines = F.filter(F.split("page_text", "\n"), lambda x: F.trim(x) != "")
    ends = F.array_distinct(F.concat(F.slice(lines, 1, 1), F.slice(F.reverse(lines), 1, 2)))
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    rows = pages.where(F.length("page_text") > 0).select("doc_ord", flat(F.coalesce("title", F.lit(""))).alias("name"), F.explode(ends).alias("line"))
    rows = rows.withColumn("line", flat(F.col("line")))
    rows = rows.withColumn("line", F.when(F.length("name") > 7, F.replace("line", "name", F.lit("@"))).otherwise(F.col("line")))
    masked_line = F.regexp_replace(F.regexp_replace("line", r"\d+", "#"), rf"\b(?:{'|'.join(MONTHS)})\b", "#")
    rows = rows.select("doc_ord", masked_line.alias("line")).distinct()
    docs = rows.select("doc_ord").distinct().count()
    found = rows.groupBy("line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(RECURS * docs, 3))
    return Marks(frozenset(r["line"] for r in found.collect() if len(r["line"]) <= LONGEST_MARK and not r["line"].endswith((".", ",", ";"))))


def titled_pages(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Every page once, with the title of its document."""
    names = documents.groupBy("doc_ord").agg(F.max("title").alias("title"))
    once = pages.groupBy("page_id").agg(F.max(F.struct("page_text", "doc_ord", "page_no")).alias("p")).select("page_id", "p.doc_ord", "p.page_no", "p.page_text")
    return once.join(names, "doc_ord", "left").select("page_id", "doc_ord", "page_no", "page_text", "title")


def repaired_pages(pages: DataFrame, learned: tuple, marks: Marks, with_text: bool = True) -> DataFrame:
    """page_id, edits and repaired_text of every titled page, words broken over page ends joined."""
    rows = pages.join(neighbours(page_edges(pages, marks)), ["doc_ord", "page_no"], "left")
    return repair(rows, "page_id", "page_text", "title", learned, True, marks, "after", "before", with_text)


def repair_collection(pages: DataFrame, documents: DataFrame, records: DataFrame, with_text: bool = True) -> DataFrame:
    """table_name, row_id, edits (and repaired_text) of all pages and records, with one lexicon and editor for both."""
    texts = records.select(F.col("text").alias("t")).unionByName(pages.select(F.col("page_text").alias("t")))
    titles = records.select(F.col("act").alias("title")).unionByName(documents.select("title"))
    learned = learn(texts, "t", titles)
    once = titled_pages(pages, documents)
    marks = page_marks(once)
    cols = ["row_id", "edits"] + (["repaired_text"] if with_text else [])
    one = repaired_pages(once, learned, marks, with_text).withColumnRenamed("page_id", "row_id").select(F.lit("act_pages").alias("table_name"), *cols)
    two = repair(records, "position", "text", "act", learned, False, marks, with_text=with_text).withColumnRenamed("position", "row_id").select(F.lit("records").alias("table_name"), *cols)
    return one.unionByName(two)
