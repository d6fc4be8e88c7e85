"""Problem 8: sentence boundaries across languages and scripts.

Method: the standard sentence-break rules over the Unicode Sentence_Break properties, with tailorings. SB3 to
SB11 are the patterns below, so every script's terminators, closing marks, continuing marks, digits and cases
are known: no break before a digit (SB6), between capitals without a blank (SB7), before a lower-case word
(SB8) or a continuing mark or further terminator (SB8a); closing marks and blanks belong to what they follow
(SB9, SB10); else a terminator ends the sentence (SB11). The tailorings:

* A single line break is a blank; an empty line always ends a sentence (SB4).
* A number may open a sentence, so SB8 does not look past digits.
* Short forms of the language (data below) suppress a break; so do initials and a heading's number.
* Letters with stops between them ("U.S.") end a sentence only before a word that mostly opens one.
* The text is uneven: a blank may be lost after a stop, a sentence may start in lower case. Both are taken for
  a break after a plain word only.
* Inside matched quotation marks and brackets nothing ends. After a closing mark that follows a stop the
  sentence ends unless the mark was opened at its start and something goes on ("Where?" asked ...).
* The Greek question mark counts in Greek. Thai has no stops: it is split at blanks between Thai letters (not
  digits), but not after a clause that only opens a condition, nor before one that only goes on.

The language is the one tagged, unless the script contradicts it or the text's function words say clearly
otherwise. The work is row by row: one scan, no shuffle, whole texts of any length.

Defined results. Null, empty and blank texts have no sentences. Offsets count code points from 0; outer
blanks and invisible marks are outside. Repeated rows give repeated sentences; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Common short forms by language. NEVER: something always follows; MAYBE: may also end a sentence.
NEVER = {
    "en": "mr mrs ms messrs pty dr prof rev hon sr st sgt capt gen vs v cf e.g i.e viz cl cls para paras pt pts sch schs reg regs div divs subdiv ch chs art arts sec secs ss s r rr ord no nos approx fig figs vol p pp ca ed eds al".split(),
    "de": "dr prof hr fr hrn frl dipl ing z.b z u.a u d.h d v v.h vgl bzw art nr abs s bd ca evtl ggf inkl max min mio mrd rd sog st str tel zzgl i.v gem lit ziff kap anm o vorm nachm".split(),
    "fr": "m mm dr pr me mgr art al n no réf ref p pp p.ex c.-à-d c.-a-d cf chap tit sect vol fig av bd env éd v tél resp".split(),
    "es": "mm pág págs tít apdo lib ed fol sr sra srta sres d da dr dra prof art arts pár párr núm num n p pp p.ej ej ee vol cap fig av c tel apdo inc cf ss".split(),
    "it": "sig dott prof art artt n p pp cap cfr ecc es".split(),
    "ru": "т т.е т.д т.п т.к ст п пп г гг тыс руб млн млрд ул им д др проф см стр рис гл ч см".split(),
    "el": "άρθρ παρ κεφ π.χ π δηλ κ κα κ.λπ αρ σελ βλ αριθ".split(),
    "ar": ["د", "أ", "م", "ص", "ق", "هـ"],
    "hi": ["डॉ", "श्री", "प्रो", "सं", "पृ"],
    "th": [],
}
MAYBE = {
    "en": "a.m p.m etc ltd co inc corp jr m km kg cm mm ft hrs min jan feb mar apr jun jul aug sep sept oct nov dec".split(),
    "de": "usw ff f h jan feb febr apr aug sept okt nov dez".split(),
    "fr": "etc h ex min janv févr avr juil sept oct nov déc".split(),
    "es": "etc a.m p.m m uu ff h ene feb abr ago sept oct nov dic".split(),
    "it": ["ecc"],
    "ru": "др г гг руб тыс".split(),
    "el": ["κ.λπ"],
}
# The commonest function words, by which languages of the Latin script are told apart.
FUNCTION_WORDS = {
    "en": set("the of and to in that is was for on with as by at be this are or from which not an has have it must shall may".split()),
    "de": set("der die das den dem des und ist in zu mit von für auf nicht ein eine einer eines sich auch nach bei aus oder wird werden muss darf".split()),
    "fr": set("le la les du des de et est dans pour sans au aux par que qui une un sur avec ne pas ou sont doit peut".split()),
    "es": set("el la los las del de y que en por para con sin es una un se no o su al según está debe puede".split()),
    "it": set("il lo la i gli di della che per sono un una con del nel alla e è non si deve può".split()),
}
# Words that mostly open a sentence when they stand in capitals after letters with stops.
OPENERS = {
    "en": set("the this that these those he she it they we you there here if when where while but however no each every any all such in on at under".split()),
    "de": set("der die das dieser diese dieses er sie es wir wenn wer wo aber jede jeder jedes in im am".split()),
    "fr": set("le la les ce cette ces il elle ils elles nous si quand où mais chaque tout toute".split()),
    "es": set("el la los las este esta estos estas él ella ellos si cuando donde pero cada todo toda".split()),
    "it": set("il lo la gli questo questa egli ella se quando dove ma ogni".split()),
}
MONTHS = set("januar februar märz april mai juni juli august september oktober november dezember jänner".split())
# Thai words after whose clause the blank only parts the condition from its consequence, and words that go on with a sentence.
THAI_OPENERS = ("ในกรณี", "เมื่อ", "หาก", "ถ้า", "แม้", "เนื่องจาก", "เว้นแต่", "เพราะ")
THAI_CONTINUES = ("และ", "หรือ", "แต่", "โดย", "ซึ่ง", "เพื่อ", "จึง", "ทั้งนี้", "ผู้นั้น", "ฯ", "ๆ")

_BLANK = r"\s﻿​-‏  ⁠­\x1c-\x1f"
_PARAGRAPH = re.compile(rf"(?:\r\n|[\n\r\x85  ])[{_BLANK}]*?(?:\r\n|[\n\r\x85  ])[{_BLANK}]*")
_INK = re.compile(rf"[^{_BLANK}]")
_EVENT = regex.compile(r"[\p{SB=STerm}\p{SB=ATerm}…;;]+(?:[  ]?[!?…]+)*|[\"“”„«»「」『』()（）\[\]]")
_THAI = re.compile(r"[ก-ฺเ-๎]")  # letters and signs, no digits
# The standard rules: what follows a terminator, over the Sentence_Break properties.
_X = r"[\p{SB=Extend}\p{SB=Format}]*+"  # SB5
_GO = rf"{_X}(?:\p{{SB=Close}}{_X})*+(?:[\p{{SB=Sp}}\p{{SB=Sep}}\p{{SB=CR}}\p{{SB=LF}}]{_X})*+"  # SB9, SB10; a line break is a blank
SB6 = regex.compile(rf"{_X}\p{{SB=Numeric}}")
SB7 = regex.compile(rf"{_X}\p{{SB=Upper}}")
SB8 = regex.compile(rf"{_GO}[^\p{{SB=OLetter}}\p{{SB=Upper}}\p{{SB=Lower}}\p{{SB=Numeric}}\p{{SB=Sep}}\p{{SB=CR}}\p{{SB=LF}}\p{{SB=STerm}}\p{{SB=ATerm}}]*+\p{{SB=Lower}}")
SB8A = regex.compile(rf"{_GO}[\p{{SB=SContinue}}\p{{SB=STerm}}\p{{SB=ATerm}};؛；%/]")
_ATERMS = regex.compile(r"\p{SB=ATerm}+")
_CASED = regex.compile(r"[\p{SB=Upper}\p{SB=Lower}]")
_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[\s  (\[“„«\"'’‘]")
OPEN = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]"}
CLOSERS = set("”“»」』)）]\"")
INVISIBLE = set("﻿​‌‍‎‏⁠­")


_SCRIPTS = [(re.compile(f"[{low}-{high}]+"), name) for low, high, name in (("\u0400", "\u052f", "ru"), ("\u0370", "\u03ff", "el"), ("\u0600", "\u06ff", "ar"), ("\u0900", "\u097f", "hi"), ("\u0e00", "\u0e7f", "th"))]
_OTHER = re.compile("[\u0370-\u052f\u0600-\u06ff\u0900-\u097f\u0e00-\u0e7f]")


def language(text: str, lang: str | None) -> str:
    """The language tagged, unless the script or, clearly, the function words of the text contradict it."""
    if not text.isascii() and _OTHER.search(text):
        shares = {name: len(text) - len(run.sub("", text)) for run, name in _SCRIPTS}
        best = max(shares, key=lambda k: shares[k])
        if shares[best] * 3 > len(text):
            return best
    tag = (lang or "")[:2].lower()
    seen = Counter(text.lower().split())
    score = {k: sum(seen[w] for w in v) for k, v in FUNCTION_WORDS.items()}
    best = max(score, key=lambda k: score[k])
    if tag not in NEVER or tag in _OTHER_TAGS:
        return best
    return best if score[best] > 2 * score.get(tag, 0) + 1 else tag


_OTHER_TAGS = {name for _, name in _SCRIPTS}
_NEVER = {k: frozenset(v) for k, v in NEVER.items()}
_MAYBE = {k: frozenset(v) for k, v in MAYBE.items()}


def _ink(text: str, at: int, end: int) -> int:
    """Offset of the first visible character from at, or end."""
    m = _INK.search(text, at, end)
    return m.start() if m else end


def _back(text: str, start: int, end: int) -> int:
    """end moved back over blanks and invisible marks."""
    while end > start and (text[end - 1].isspace() or text[end - 1] in INVISIBLE):
        end -= 1
    return end


def _stop_ends(text: str, first: int, a: int, b: int, end: int, lang: str) -> bool:
    """Whether the full stop text[a:b], outside marks, ends the sentence that starts at first."""
    nxt = _ink(text, b, end)
    if nxt >= end:
        return True
    if SB6.match(text, b, end) or SB8A.match(text, b, end):
        return False
    c = text[nxt]
    at = a
    while at > first and not _TOKEN.match(text[at - 1]):
        at -= 1
    token = text[at:a]
    low = token.lower()
    never, maybe = low in _NEVER.get(lang, ()), low in _MAYBE.get(lang, ())
    plain = token.isalpha() and len(token) >= 3 and not never
    if nxt == b and c.isalpha():  # SB7 and its like for other cases; a lost blank is taken for one after a plain word
        return plain and token[-1].islower() and bool(SB7.match(text, b, end)) and text[nxt + 1 : nxt + 2] != "."
    if at == first and re.fullmatch(r"[\d.]*\d[A-Za-z]?|[IVXLC]+", token):  # a heading's number
        return False
    if never or len(token) == 1 and token.isupper() and lang not in ("th", "hi", "ar"):  # short forms and initials
        return False
    word = _WORD.match(text, nxt)
    follows = word.group() if word else ""
    if re.fullmatch(r"(?:\w\.)+\w", token) and not maybe:
        return c.isupper() and (not token[-1].isupper() or follows.lower() in OPENERS.get(lang, ()))
    if maybe:
        return not (c.islower() or c.isdigit())
    if token.isdigit() and lang == "de" and len(token) <= 2:  # a day before its month
        return follows.lower() not in MONTHS
    if SB8.match(text, b, end):  # a start in lower case is taken for one after a plain word, in some languages also a short one
        return plain or token.isalpha() and len(token) == 2 and lang in ("en", "el", "ru") or bool(re.search(r"[\w'’-]{3,}$", token)) and not token[-1].isdigit()
    return True


def _thai_blanks(text: str, start: int, end: int) -> list[int]:
    """Offsets of blanks between two Thai sentences in text[start:end]."""
    cuts, first, tokens = [], start, 0
    for m in re.finditer(r"[^\S]+", text[start:end]):
        at, after = start + m.start(), start + m.end()
        if at <= first or after >= end:
            continue
        tokens += 1
        prev, nxt = text[at - 1], text[after]
        if not (_THAI.match(prev) and _THAI.match(nxt)):
            continue
        word = text[after : after + 6]
        if re.match(r"[ก-ฮ]{1,2}\.", word):
            continue
        if tokens == 1 and text.startswith(THAI_OPENERS, first) or text.startswith(THAI_CONTINUES, after):
            continue
        cuts.append(at)
        first, tokens = after, 0
    return cuts


def sentence_spans(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """(start, end) of every sentence of a text, in code points."""
    if not text:
        return []
    out: list[tuple[int, int]] = []
    lang = language(text, lang)
    start, size = 0, len(text)
    for gap in [*_PARAGRAPH.finditer(text), None]:
        stop = gap.start() if gap else size
        _paragraph(text, start, stop, lang, out)
        start = gap.end() if gap else size
    return out


def _paragraph(text: str, start: int, stop: int, lang: str, out: list[tuple[int, int]]) -> None:
    first, stop = _ink(text, start, stop), _back(text, start, stop)
    if first >= stop:
        return
    if lang == "th" or _THAI.search(text, first, stop):
        for cut in [*_thai_blanks(text, first, stop), stop]:
            if _ink(text, first, cut) < cut:
                _stops(text, _ink(text, first, cut), _back(text, first, cut), lang, out)
            first = cut
        return
    _stops(text, first, stop, lang, out)


def _stops(text: str, first: int, stop: int, lang: str, out: list[tuple[int, int]]) -> None:
    stack: list[list] = []  # [closing marks, offset, opened at the sentence's start, after a colon or comma, offset past a stop inside]
    for m in _EVENT.finditer(text, first, stop):
        a, b = m.span()
        if a < first:
            continue
        mark = text[a]
        if mark in OPEN or mark in CLOSERS:
            if stack and mark in stack[-1][0]:
                closes, at, initial, led, inside = stack.pop()
                ended = inside and _back(text, inside, a) <= inside
                if stack:
                    if ended:
                        stack[-1][4] = b
                    continue
                if ended and _close_ends(text, b, stop, initial, led, mark, lang):
                    out.append((first, b))
                    first = _ink(text, b, stop)
                continue
            closing = '"' if mark == '"' else OPEN.get(mark)
            if closing and any(text.find(c, b, stop) >= 0 for c in closing):
                before = text[_back(text, first, a) - 1] if a > first else ""
                stack.append([closing, a, _ink(text, first, stop) == a, before in ":：,，،、", 0])
            elif not closing and not stack and out and out[-1][1] == a and first == a:
                out[-1] = (out[-1][0], b)  # a closing mark without an opening one belongs to the sentence before
                first = _ink(text, b, stop)
            continue
        if stack:
            if mark != ";" or lang == "el":
                stack[-1][4] = b
            continue
        run = m.group()
        if ";" in run or ";" in run:
            if lang != "el":
                continue
            ends = True
        elif run.startswith("…") or run.startswith(".."):
            nxt = _ink(text, b, stop)
            ends = nxt >= stop or not (text[nxt].islower() or text[nxt] in ",;:،、，；：") and (text[nxt].isupper() or text[nxt] in '"“„«¿¡(' or text[nxt].isdigit() or lang == "hi")
        elif run == ".":
            ends = _stop_ends(text, first, a, b, stop, lang)
        else:
            ends = _ink(text, b, stop) >= stop or not (SB8A.match(text, b, stop) or _ATERMS.fullmatch(run) and SB6.match(text, b, stop))
        if ends:
            while b < stop and text[b] in "”»」』)）]" and text.rfind(next(k for k, v in [*OPEN.items()] if text[b] in v), first, b) < 0:
                b += 1
            out.append((first, b))
            first = _ink(text, b, stop)
    if first < stop:
        out.append((first, stop))


def _close_ends(text: str, b: int, stop: int, initial: bool, led: bool, mark: str, lang: str) -> bool:
    """Whether a sentence ends with a closing mark at b that follows a stop."""
    nxt = _ink(text, b, stop)
    if nxt >= stop:
        return True
    c = text[nxt]
    if c in ",;:.،、，；：—–-!?。！？":
        return False
    bracket = mark in ")）]"
    if bracket:
        return initial
    if initial:
        return False
    if led:
        return True
    return c.isupper() or c.isdigit() or c in OPEN or c in '"¿¡'


def sentences(df: DataFrame, key: str, text: str, lang: str | None = None, with_text: bool = False) -> DataFrame:
    """One row per sentence: key, start_at, end_at (and sentence)."""
    base = df.select(df[key], df[text].cast("string").alias("text"), *([df[lang].cast("string").alias("lang")] if lang else []))
    kind = base.schema[0].dataType.simpleString()

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, starts, ends, parts = [], [], [], []
            texts = batch.column(1).to_pylist()
            langs = batch.column(2).to_pylist() if lang else [None] * len(texts)
            for i, (t, g) in enumerate(zip(texts, langs)):
                for s, e in sentence_spans(t, g):
                    row.append(i)
                    starts.append(s)
                    ends.append(e)
                    if with_text:
                        parts.append(t[s:e])
            cols = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
            yield pa.record_batch(cols + ([pa.array(parts, pa.string())] if with_text else []), names=[key, "start_at", "end_at"] + (["sentence"] if with_text else []))

    return base.mapInArrow(per_batch, f"`{key}` {kind}, start_at int, end_at int" + (", sentence string" if with_text else ""))
