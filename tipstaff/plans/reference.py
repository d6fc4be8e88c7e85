"""Queries of the core operators over the test tables, with their SQL. Each runs over its whole tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import detect
from ..functions import text as tx
from ..operators import answer, index, lexicon, search, structure, threads, vectors
from ..operators.orphans import latest
from ..runtime import shared_dir, table
from ..sources import files
from ..streaming.ingest import event_windows
from . import build

QUERIES: dict = {}
SQL: dict[str, str] = {}

WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+(?:''[a-z]+)?')"
STOP = "[" + ",".join(f"'{w}'" for w in tx.STOPWORDS) + "]"
CONTENT = "list_filter(" + WORDS + f", lambda t: NOT list_contains({STOP}, t))"
INDEX = f"""
recs AS (SELECT * FROM records WHERE length(trim(text)) >= 12),
toks AS (SELECT position, {CONTENT.format("concat_ws(' ', heading, text)")} AS tokens FROM recs),
post AS (SELECT DISTINCT position, unnest(tokens) AS token FROM toks),
dlen AS (SELECT position, len(tokens) AS len FROM toks),
stat AS (SELECT count(*) AS n, avg(len) AS avg_len FROM dlen)
"""
EDGES = "edge AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY edge_ord ORDER BY loaded_at DESC) AS rn FROM edges) WHERE rn = 1)"
PAGES = "pg AS (SELECT page_id, any_value(doc_ord) AS doc_ord, any_value(page_no) AS page_no, any_value(page_text) AS page_text FROM act_pages GROUP BY page_id)"
TITLES = "tt AS (SELECT doc_ord, max(title) AS title, max(path) AS path, max(profile) AS profile FROM act_documents GROUP BY doc_ord)"
LINES = "ln AS (SELECT * FROM (SELECT doc_ord, page_no, g - 1 AS line_no, trim(regexp_replace(l[g], '[ \\t]+', ' ', 'g')) AS line FROM (SELECT doc_ord, page_no, l, unnest(generate_series(1, len(l))) AS g FROM (SELECT doc_ord, page_no, string_split(page_text, chr(10)) AS l FROM pg))) WHERE line <> '')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _records(spark, d):
    return table(spark, d, "records")


_STORED: dict = {}


def _index(spark, d):
    """The index over a data folder, made once a session: every text is taken apart once, whatever is asked."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORED:
        _STORED[key] = index.stored(index.build(_records(spark, d)))
    return _STORED[key]


def _edges(spark, d):
    return latest(table(spark, d, "edges"), "edge_ord", "loaded_at")


def _pages(spark, d):
    return table(spark, d, "act_pages").groupBy("page_id").agg(F.max(F.struct("doc_ord", "page_no", "page_text")).alias("p")).select("page_id", "p.*")


def _titles(spark, d):
    return table(spark, d, "act_documents").groupBy("doc_ord").agg(F.max("title").alias("title"), F.max("path").alias("path"), F.max("profile").alias("profile"))


# Text


@query(f"SELECT position, len({WORDS.format('coalesce(text, ' + chr(39) * 2 + ')')}) AS tokens FROM records")
def q_tokens(spark, d):
    return _records(spark, d).select("position", F.size(tx.tokenise(F.col("text"))).cast("bigint").alias("tokens"))


@query(f"SELECT position, array_to_string({CONTENT.format('coalesce(text, ' + chr(39) * 2 + ')')}, ' ') AS words FROM records")
def q_stop_filter(spark, d):
    return _records(spark, d).select("position", F.array_join(tx.content_tokens(F.col("text")), " ").alias("words"))


@query(f"WITH {PAGES} SELECT doc_ord, word, count(*) AS n FROM (SELECT doc_ord, unnest(regexp_extract_all(lower(page_text), '[a-z]+')) AS word FROM pg) GROUP BY 1, 2")
def q_vocabulary(spark, d):
    return tx.vocabulary(_pages(spark, d), "doc_ord", "page_text")


_NFKC = "x"
for _a, _b in {"ſ": "s", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st"}.items():
    _NFKC = f"replace({_NFKC}, '{_a}', '{_b}')"
_W = r"[\p{L}\p{N}_]"
_CLEAN = f"regexp_replace(regexp_replace({_NFKC}, '({_W})\\x{{fffd}}({_W})', '\\1''\\2', 'g'), '({_W})\\x{{fffd}}({_W})', '\\1''\\2', 'g')"
for _a, _b in {**tx.SAME, "�": "-", "…": "...", "­": ""}.items():
    _CLEAN = "replace({}, '{}', '{}')".format(_CLEAN, _a, _b.replace("'", "''"))
for _p, _r in ((r"\r\n?", "\n"), (rf"({_W})-\n({_W})", r"\1\2"), (r"[ \t]+", " "), (r" \n", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '{_r}', 'g')"


@query(f"SELECT position, trim({_CLEAN}) AS cleaned FROM (SELECT position, coalesce(text, '') AS x FROM records)")
def q_clean(spark, d):
    return _records(spark, d).select("position", tx.clean(F.col("text")).alias("cleaned"))


@query(f"SELECT position, trim(regexp_replace(trim({_CLEAN}), '\\s+', ' ', 'g')) AS line FROM (SELECT position, coalesce(text, '') AS x FROM records)")
def q_collapse(spark, d):
    return _records(spark, d).select("position", tx.collapse(F.col("text")).alias("line"))


_REJOIN = """voc AS (SELECT doc_ord, word, count(*) AS n FROM (SELECT doc_ord, unnest(regexp_extract_all(lower(page_text), '[a-z]+')) AS word FROM pg) GROUP BY 1, 2),
wl AS (SELECT page_id, doc_ord, regexp_extract_all(lower(coalesce(page_text, '')), '[a-z]+') AS l FROM pg),
pr AS (SELECT DISTINCT page_id, doc_ord, l[g] AS a, l[g + 1] AS b FROM (SELECT *, unnest(generate_series(1, len(l) - 1)) AS g FROM wl) WHERE length(l[g]) >= 2 AND length(l[g + 1]) <= 2),
gd AS (SELECT page_id, list(a || ' ' || b ORDER BY a, b) AS good FROM pr JOIN voc j ON j.doc_ord = pr.doc_ord AND j.word = a || b JOIN voc h ON h.doc_ord = pr.doc_ord AND h.word = a WHERE j.n >= 5 AND j.n >= 4 * h.n GROUP BY 1),
rj AS (SELECT page_id, pg.doc_ord, page_text AS before, CASE WHEN good IS NULL THEN page_text ELSE list_reduce(list_prepend(page_text, good), lambda t, p: regexp_replace(t, '\\b(?i:(' || split_part(p, ' ', 1) || ')) (?i:(' || split_part(p, ' ', 2) || '))\\b', '\\1\\2', 'g')) END AS page_text FROM pg LEFT JOIN gd USING (page_id))"""


@query(f"WITH {PAGES}, {_REJOIN} SELECT page_id, page_text FROM rj")
def q_rejoin(spark, d):
    return tx.rejoin(_pages(spark, d), "doc_ord", "page_id", "page_text")


_HTML = "concat('<html><style>p {c: d}</style><script>if (a<b) c()</script><p>', replace(page_text, chr(10), '<br/>'), '</p><div>A &amp;lt; B&nbsp;C</div></html>')"


def _html() -> Column:
    body = F.replace(F.col("page_text"), F.lit("\n"), F.lit("<br/>"))
    return F.concat(F.lit("<html><style>p {c: d}</style><script>if (a<b) c()</script><p>"), body, F.lit("</p><div>A &amp;lt; B&nbsp;C</div></html>"))


_STRIP = _HTML
for _p, _r in ((r"(?is)<script.*?</script>", " "), (r"(?is)<style.*?</style>", " "), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</(?:p|div|li|h[1-6]|tr)>", "\n"), (r"<[^>]*>", " ")):
    _STRIP = f"regexp_replace({_STRIP}, '{_p}', '{_r}', 'g')"
for _a, _b in tx.ENTITIES:
    _STRIP = "replace({}, '{}', '{}')".format(_STRIP, _a, _b.replace("'", "''"))


@query(f"WITH {PAGES} SELECT page_id, {_STRIP} AS text FROM pg")
def q_html_strip(spark, d):
    return _pages(spark, d).select("page_id", tx.strip_tags(_html()).alias("text"))


@query(f"WITH {PAGES}, {LINES} SELECT doc_ord, count(*) FILTER (length(regexp_replace(line, '[^A-Za-z]', '', 'g')) >= 4 AND length(regexp_replace(line, '[^A-Z]', '', 'g')) > 0.8 * length(regexp_replace(line, '[^A-Za-z]', '', 'g'))) AS upper_lines, count(*) FILTER (regexp_matches(line, '\\.{{4,}}|(?:\\. ){{4,}}')) AS leader_lines, count(*) AS lines FROM ln GROUP BY 1")
def q_line_shapes(spark, d):
    lines = structure.lines_of(table(spark, d, "act_pages"))
    return lines.groupBy("doc_ord").agg(F.count_if(tx.is_mostly_upper(F.col("line"))).alias("upper_lines"), F.count_if(tx.has_leader(F.col("line"))).alias("leader_lines"), F.count(F.lit(1)).alias("lines"))


# Sources


@query("SELECT path, CASE WHEN regexp_matches(lower(path), '\\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(path), '\\.(?:html?|xhtml)$') THEN 'html' ELSE 'text' END AS format FROM act_documents")
def q_format_dispatch(spark, d):
    return table(spark, d, "act_documents").select("path", files.kind_of(F.col("path")).alias("format"))


def _shelf(spark, d) -> DataFrame:
    """The documents written as files of the kind their path names, one task a document, and read again."""
    folder = f"{shared_dir(spark)}/tipstaff/shelf-{uuid.uuid4().hex}".removeprefix("file://").removeprefix("file:")
    os.makedirs(folder, exist_ok=True)
    once = _pages(spark, d).join(_titles(spark, d), "doc_ord").where("path is not null")
    html = F.replace(_html(), F.lit("\f"), F.lit("<br/>"))
    whole = once.groupBy("doc_ord", "path").agg(F.expr("listagg(coalesce(page_text, ''), '\f') within group (order by page_no)").alias("page_text"))
    rows = whole.select("doc_ord", files.kind_of(F.col("path")).alias("kind"), F.when(files.kind_of(F.col("path")) == "html", html).otherwise(F.col("page_text")).alias("content"))

    def put(batches):
        for batch in batches:
            for doc, kind, content in zip(batch["doc_ord"], batch["kind"], batch["content"]):
                with open(f"{folder}/{doc}.{ {'text': 'txt'}.get(kind, kind) }", "w", newline="") as f:
                    f.write(content)
            yield batch[["doc_ord"]]

    rows.mapInPandas(put, "doc_ord int").count()
    return files.read_pages(spark, [folder]).withColumn("doc_ord", F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("int"))


_KINDOF = "CASE WHEN regexp_matches(lower(path), '\\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(path), '\\.(?:html?|xhtml)$') THEN 'html' ELSE 'text' END"
_WHOLE = f"wd AS (SELECT doc_ord, path, {_KINDOF} AS kind, string_agg(coalesce(page_text, ''), chr(10) ORDER BY page_no) AS page_text FROM pg JOIN tt USING (doc_ord) WHERE path IS NOT NULL GROUP BY 1, 2)"


@query(f"WITH {PAGES}, {TITLES} SELECT DISTINCT doc_ord, true AS failed FROM pg JOIN tt USING (doc_ord) WHERE {_KINDOF} = 'pdf'")
def q_skipped(spark, d):
    """Files whose reader fails: what is written with the suffix of a PDF here is none."""
    pages = _shelf(spark, d)
    return files.skipped(pages.withColumn("path", F.col("doc_ord"))).select(F.col("path").alias("doc_ord"), (F.length("reason") > 0).alias("failed"))


@query(f"""WITH {PAGES}, {TITLES}, {_WHOLE},
r AS (SELECT doc_ord, (row_number() OVER (PARTITION BY doc_ord ORDER BY page_no))::INT AS page_no, coalesce(page_text, '') AS x FROM pg JOIN tt USING (doc_ord) WHERE path IS NOT NULL AND {_KINDOF} = 'text'
 UNION ALL SELECT doc_ord, 1, {_STRIP} FROM wd WHERE kind = 'html')
SELECT doc_ord, page_no, trim({_CLEAN}) AS page_text FROM r""")
def q_read_files(spark, d):
    """Text and HTML files, taken apart into pages, cleaned."""
    return _shelf(spark, d).where("error is null").select("doc_ord", "page_no", "page_text")


# Metadata

_HEAD = "heads AS (SELECT doc_ord, string_agg(coalesce(page_text, ''), chr(10) ORDER BY page_no) AS head FROM (SELECT *, row_number() OVER (PARTITION BY doc_ord ORDER BY page_no) AS n FROM pg) WHERE n <= 3 GROUP BY 1)"
_PROFILE = r"""CASE WHEN regexp_matches(lower(regexp_extract(coalesce(path, ''), '([^/]*)$', 1)), '^qld| qld |queensland') THEN 'qld'
 WHEN regexp_matches(head, '\[s\s*\d+[A-Z]{0,3}\]|(?i:Reprint\s+\d+[A-Z]?\s+effective)') THEN 'qld'
 WHEN regexp_matches(head, '(?i)ComLaw|Office of Parliamentary Counsel, Canberra|Federal Register of Legislation') THEN 'cth'
 WHEN regexp_matches(head, '\bAct No\.\s*\d+\s*of\s*\d{4}\b') AND regexp_matches(head, '(?i)This compilation was prepared') THEN 'cth' ELSE 'generic' END"""


@query(f"WITH {PAGES}, {TITLES}, {_HEAD} SELECT doc_ord, {_PROFILE} AS profile FROM (SELECT doc_ord, CASE doc_ord % 3 WHEN 1 THEN upper(head) WHEN 2 THEN lower(head) ELSE head END AS head FROM heads) LEFT JOIN tt USING (doc_ord)")
def q_profile_detect(spark, d):
    """A third of the heads in capitals and a third in small letters: notices count in any case, markers and numbers as printed."""
    head = detect.heads(_pages(spark, d), "doc_ord", "page_no", "page_text")
    head = head.withColumn("head", F.when(F.col("doc_ord") % 3 == 1, F.upper("head")).when(F.col("doc_ord") % 3 == 2, F.lower("head")).otherwise(F.col("head")))
    return head.join(_titles(spark, d), "doc_ord", "left").select("doc_ord", detect.profile(F.col("head"), F.col("path")).alias("profile"))


_FRONT = "concat_ws(' ', 'Act No. ' || act_number || ' of ' || year, CASE doc_ord % 3 WHEN 0 THEN 'Reprint 2 effective ' WHEN 1 THEN 'Current as at ' ELSE 'This compilation was prepared on ' END || currency_text)"


def _front(spark, d) -> DataFrame:
    notice = F.when(F.col("doc_ord") % 3 == 0, "Reprint 2 effective ").when(F.col("doc_ord") % 3 == 1, "Current as at ").otherwise("This compilation was prepared on ")
    front = F.concat_ws(" ", F.concat(F.lit("Act No. "), "act_number", F.lit(" of "), F.col("year").cast("string")), F.concat(notice, "currency_text"))
    return table(spark, d, "act_documents").withColumn("front", front)


_CURR = "coalesce(" + ", ".join(f"nullif(regexp_extract(front, '{p}', 1), '')" for p in detect.CURRENCY) + ")"


@query(f"SELECT doc_ord, nullif(regexp_extract(front, '{detect.ACT_NUMBER}', 1), '') AS act_number, try_cast(nullif(regexp_extract(front, '{detect.ACT_NUMBER}', 2), '') AS INT) AS year, {_CURR} AS currency_text, try_strptime({_CURR}, '%d %B %Y')::DATE AS currency_date FROM (SELECT doc_ord, {_FRONT} AS front FROM act_documents)")
def q_currency(spark, d):
    front = _front(spark, d)
    text = detect.currency(F.col("front"))
    number = lambda i: F.nullif(F.regexp_extract("front", detect.ACT_NUMBER, i), F.lit(""))
    return front.select("doc_ord", number(1).alias("act_number"), number(2).cast("int").alias("year"), text.alias("currency_text"), detect.currency_date(text).alias("currency_date"))


def _dq(p: str) -> str:
    return p.replace("'", "''")


_FITS = f"((regexp_matches(t, '{_dq(detect.TITLE)}') OR regexp_matches(t, '{_dq(detect.TITLE_UNDATED)}')) AND length(regexp_replace(t, '[^(]', '', 'g')) = length(regexp_replace(t, '[^)]', '', 'g')))"


@query(f"""WITH {PAGES}, {TITLES}, tot AS (SELECT doc_ord, count(DISTINCT page_no) AS pages FROM pg GROUP BY 1),
l0 AS (SELECT doc_ord, page_no, g AS spot, trim(regexp_replace(l[g], '\\s+', ' ', 'g')) AS line FROM (SELECT doc_ord, page_no, l, unnest(generate_series(1, len(l))) AS g FROM (SELECT doc_ord, page_no, string_split(page_text, chr(10)) AS l FROM pg))),
l1 AS (SELECT * FROM l0 WHERE length(line) > 5 AND NOT regexp_matches(line, '\\.{{4,}}|(?:\\. ){{4,}}')),
l2 AS (SELECT doc_ord, page_no, spot, list_filter([line, regexp_replace(line, '(?i)^(?:\\d{{1,4}}|[ivxlc]{{1,6}}) ', ''), regexp_replace(line, '(?i) (?:\\d{{1,4}}|[ivxlc]{{1,6}})$', '')], lambda t: {_FITS})[1] AS title FROM l1),
per AS (SELECT doc_ord, title, regexp_matches(title, '{_dq(detect.TITLE)}') AS dated, count(DISTINCT page_no) AS n, min(page_no * 100000 + spot) AS first FROM l2 WHERE title IS NOT NULL GROUP BY 1, 2, 3)
SELECT doc_ord, coalesce(best.title, regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', ''), '[_-]', ' ', 'g')) AS title FROM tt LEFT JOIN (SELECT doc_ord, title FROM (SELECT doc_ord, title, row_number() OVER (PARTITION BY doc_ord ORDER BY n DESC, dated DESC, length(title) DESC, first, title) AS r FROM per JOIN tot USING (doc_ord) WHERE n >= greatest(3, floor(pages / 12))) WHERE r = 1) best USING (doc_ord)""")
def q_title_guess(spark, d):
    return detect.guessed_titles(_pages(spark, d), "doc_ord", "page_no", "page_text", _titles(spark, d).select("doc_ord", "path"))


@query(f"WITH {PAGES}, {TITLES}, {_HEAD}, {_REJOIN}, len AS (SELECT doc_ord, sum(length(page_text)) AS n, count(*) FILTER (page_text <> before) AS joined FROM rj GROUP BY 1) SELECT doc_ord, concat_ws('; ', CASE WHEN joined > 0 THEN 'torn words joined again on ' || joined || ' pages' END, CASE WHEN n = 0 THEN 'no text: the pages may be images' END, CASE WHEN {_PROFILE} = 'generic' THEN 'layout not recognised' END, CASE WHEN regexp_matches(head, '{detect.DISCLAIMED}') THEN 'the source says it is not authorised' END, CASE WHEN {_CURR.replace('front', 'head')} IS NULL THEN 'no currency date found' END) AS warnings FROM heads JOIN len USING (doc_ord) LEFT JOIN tt USING (doc_ord)")
def q_warnings(spark, d):
    pages = _pages(spark, d)
    whole = tx.rejoin(pages, "doc_ord", "page_id", "page_text").withColumnRenamed("page_text", "whole")
    sizes = pages.join(whole, "page_id").groupBy("doc_ord").agg(F.sum(F.length("whole")).alias("n"), F.count_if(F.col("whole") != F.col("page_text")).alias("joined"))
    head = detect.heads(pages, "doc_ord", "page_no", "page_text").join(_titles(spark, d), "doc_ord", "left").join(sizes, "doc_ord")
    found = detect.warnings(F.col("n"), detect.profile(F.col("head"), F.col("path")), F.col("head"), detect.currency(F.col("head")), F.col("joined"))
    return head.select("doc_ord", F.array_join(found, "; ").alias("warnings"))


def _noticed(head: str) -> str:
    return _CURR.replace("front", head)


@query(f"""WITH {PAGES}, {TITLES}, {_HEAD}, wide AS (SELECT doc_ord, string_agg(coalesce(page_text, ''), chr(10) ORDER BY page_no) AS wide FROM (SELECT *, row_number() OVER (PARTITION BY doc_ord ORDER BY page_no) AS n FROM pg) WHERE n <= 60 GROUP BY 1),
size AS (SELECT doc_ord, sum(length(page_text)) AS n FROM pg GROUP BY 1), guess AS ({SQL["q_title_guess"]}),
d AS (SELECT doc_ord, path, guess.title, {_PROFILE} AS profile, head, n, coalesce({_noticed("head")}, {_noticed("wide")}) AS currency_text FROM tt JOIN heads USING (doc_ord) JOIN wide USING (doc_ord) JOIN size USING (doc_ord) JOIN guess USING (doc_ord))
SELECT doc_ord, title, profile, CASE profile {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in detect.JURISDICTION.items())} END AS jurisdiction,
 try_cast(coalesce(nullif(regexp_extract(head, '{detect.ACT_NUMBER}', 2), ''), nullif(regexp_extract(title, '\\b({detect.YEAR})\\b', 1), '')) AS INT) AS year, nullif(regexp_extract(head, '{detect.ACT_NUMBER}', 1), '') AS act_number, currency_text, try_strptime(currency_text, '%d %B %Y')::DATE AS currency_date,
 concat_ws('; ', CASE WHEN n = 0 THEN 'no text: the pages may be images' END, CASE WHEN profile = 'generic' THEN 'layout not recognised' END, CASE WHEN regexp_matches(head, '{detect.DISCLAIMED}') THEN 'the source says it is not authorised' END, CASE WHEN currency_text IS NULL THEN 'no currency date found' END) AS warnings FROM d""")
def q_documents(spark, d):
    """Everything a document says about itself, put together."""
    pages = _pages(spark, d).join(_titles(spark, d).select("doc_ord", "path"), "doc_ord")
    found = build.documents_of(pages)
    return found.select("doc_ord", "title", "profile", "jurisdiction", "year", "act_number", "currency_text", "currency_date", F.array_join("warnings", "; ").alias("warnings"))


# Structure

_T = "lower(trim(coalesce(title, '?')))"
_BANNER = f"(lower(line) = {_T} OR regexp_replace(lower(line), '^\\d{{1,4}} ', '') = {_T} OR regexp_replace(lower(line), ' \\d{{1,4}}$', '') = {_T} OR regexp_replace(lower(line), '^part \\d+ ', '') = {_T} OR regexp_replace(lower(line), '[ .,]+$', '') = {_T} OR regexp_replace(lower(line), ' act no\\. ?\\d+$', '') = {_T} OR regexp_replace(lower(line), '^[ .,]+|[ .,]+$', '', 'g') = {_T} OR regexp_replace(lower(line), '^[ .,]+|[ .,]+$', '', 'g') IN ({', '.join(repr(c) for c in structure.COVER)}))"
_MARKS = "CASE lower(coalesce(profile, '')) WHEN 'cth' THEN regexp_matches(line, '{}') WHEN 'qld' THEN regexp_matches(line, '{}') ELSE regexp_matches(line, '{}') END".format(*(detect.PROFILES[k].furniture for k in ("cth", "qld", "generic")))
_UPPER = f"length(regexp_replace(regexp_extract(line, '{structure.SECTION}', 2), '[^A-Za-z]', '', 'g')) >= 4 AND length(regexp_replace(regexp_extract(line, '{structure.SECTION}', 2), '[^A-Z]', '', 'g')) > 0.8 * length(regexp_replace(regexp_extract(line, '{structure.SECTION}', 2), '[^A-Za-z]', '', 'g'))"
_KIND = (
    f"CASE WHEN {_BANNER} OR {_MARKS} THEN 'furniture' WHEN regexp_matches(line, '{structure.CONTENTS}') OR regexp_matches(line, '\\.{{4,}}|(?:\\. ){{4,}}') THEN 'contents' "
    + " ".join(f"WHEN regexp_matches(line, '{p}') AND length(line) < 90 THEN '{n}'" for n, p in structure.HEADINGS.items())
    + f" WHEN regexp_matches(line, '{structure.SECTION}') AND NOT ({_UPPER}) AND NOT regexp_matches(line, ' \\d{{1,4}}$') THEN 'section' WHEN regexp_matches(line, '{structure.SUBSECTION}') THEN 'subsection' WHEN regexp_matches(line, '{structure.PARAGRAPH}') THEN 'paragraph' WHEN regexp_matches(line, '{_dq(structure.DEFINITION)}') THEN 'definition' ELSE 'text' END"
)


@query(f"WITH {PAGES}, {TITLES}, {LINES} SELECT doc_ord, {_KIND} AS kind, count(*) AS lines FROM ln LEFT JOIN tt USING (doc_ord) GROUP BY 1, 2")
def q_line_kinds(spark, d):
    lines = structure.lines_of(table(spark, d, "act_pages")).join(_titles(spark, d), "doc_ord", "left")
    return structure.classified(lines).groupBy("doc_ord", "kind").agg(F.count(F.lit(1)).alias("lines"))


_SYN = "CASE o_orderkey % 8 WHEN 0 THEN 'Part ' || (o_orderkey % 9 + 1) WHEN 1 THEN 'Division ' || (o_orderkey % 5 + 1) WHEN 2 THEN (o_orderkey % 50 + 1) || ' Heading of a section' WHEN 3 THEN '(' || (o_orderkey % 6 + 1) || ') An owner must tell the officer.' WHEN 4 THEN '(' || chr((97 + o_orderkey % 8)::INT) || ') the matter named here;' WHEN 5 THEN 'and the rest of the matter.' WHEN 6 THEN 'Chapter ' || (o_orderkey % 3 + 1) ELSE 'Schedule ' || (o_orderkey % 4 + 1) END"


def _statute(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    n = lambda m: (k % m + 1).cast("string")
    cases = [F.concat(F.lit("Part "), n(9)), F.concat(F.lit("Division "), n(5)), F.concat(n(50), F.lit(" Heading of a section")), F.concat(F.lit("("), n(6), F.lit(") An owner must tell the officer.")), F.concat(F.lit("("), F.char(97 + k % 8), F.lit(") the matter named here;")), F.lit("and the rest of the matter."), F.concat(F.lit("Chapter "), n(3))]
    line = F.when(k % 8 == 0, cases[0])
    for i in range(1, 7):
        line = line.when(k % 8 == i, cases[i])
    orders = table(spark, d, "orders")
    return orders.select(F.col("o_custkey").alias("doc_ord"), F.lit(1).alias("page_no"), k.alias("line_no"), line.otherwise(F.concat(F.lit("Schedule "), n(4))).alias("line"), F.lit("An Act 1999").alias("title"))


def _last(event: str, over: str = "w") -> str:
    return f"coalesce(last_value({event} IGNORE NULLS) OVER {over}, '')"


@query(f"""WITH l AS (SELECT o_custkey AS doc_ord, o_orderkey AS line_no, o_orderkey % 8 AS k, {_SYN} AS line FROM orders),
e AS (SELECT *, CASE WHEN k = 6 THEN regexp_extract(line, '(\\d+)', 1) WHEN k = 7 THEN '' END AS ch, CASE WHEN k = 0 THEN regexp_extract(line, '(\\d+)', 1) WHEN k IN (6, 7) THEN '' END AS pa,
 CASE WHEN k = 1 THEN regexp_extract(line, '(\\d+)', 1) WHEN k IN (0, 6, 7) THEN '' END AS di, CASE WHEN k = 7 THEN regexp_extract(line, '(\\d+)', 1) END AS sc,
 CASE WHEN k = 2 THEN regexp_extract(line, '^(\\d+)', 1) WHEN k = 7 THEN '' END AS se, sum(CASE WHEN k IN (2, 7) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_ord ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS sid FROM l)
SELECT doc_ord, line_no, {_last('ch')} AS chapter, {_last('pa')} AS part, {_last('di')} AS division, {_last('sc')} AS schedule, {_last('se')} AS section,
 CASE WHEN {_last('se')} = '' THEN '' ELSE {_last("CASE WHEN k = 3 THEN regexp_extract(line, '(\\d+)', 1) END", 's')} END AS subsection
FROM e WINDOW w AS (PARTITION BY doc_ord ORDER BY line_no ROWS UNBOUNDED PRECEDING), s AS (PARTITION BY doc_ord, sid ORDER BY line_no ROWS UNBOUNDED PRECEDING)""")
def q_context_carry(spark, d):
    return structure.placed(_statute(spark, d)).select("doc_ord", "line_no", "chapter", "part", "division", "schedule", "section", "subsection")


_OVER = "OVER (PARTITION BY doc_ord{} ORDER BY page_no, line_no ROWS UNBOUNDED PRECEDING)"
_NUM = lambda kind, pattern, keys: f"last_value(CASE WHEN kind = '{kind}' THEN regexp_extract(line, '{pattern}', 1) END IGNORE NULLS) {_OVER.format(keys)}"
_LEVELS = ", ".join(
    f"coalesce(last_value(CASE WHEN kind = '{n}' THEN regexp_extract(line, '{structure.HEADINGS[n]}', 1) WHEN kind IN ({', '.join(repr(x) for x in ['schedule', *structure.LEVELS[:i]])}) THEN '' END IGNORE NULLS) {_OVER.format('')}, '') AS {n}"
    for i, n in enumerate(structure.LEVELS)
)
_PLACED = f"""
c0 AS (SELECT doc_ord, page_no, line_no, line, title, {_KIND} AS kind FROM ln LEFT JOIN tt USING (doc_ord)),
c1 AS (SELECT *, last_value(CASE WHEN kind = 'contents' THEN true WHEN regexp_matches(line, '[.;:]$') AND length(line) > 40 THEN false END IGNORE NULLS) {_OVER.format('')} AS toc FROM c0 WHERE kind <> 'furniture'),
c2 AS (SELECT * EXCLUDE (toc), sum(CASE WHEN kind IN ('section', 'schedule') THEN 1 ELSE 0 END) {_OVER.format('')} AS sec_id, coalesce(last_value(CASE WHEN kind = 'section' THEN true WHEN kind = 'schedule' THEN false END IGNORE NULLS) {_OVER.format('')}, false) AS ins FROM c1 WHERE NOT coalesce(toc, false) AND kind <> 'contents'),
c3 AS (SELECT * REPLACE (CASE WHEN kind IN ('subsection', 'paragraph') AND NOT ins THEN 'text' ELSE kind END AS kind) FROM c2),
c4 AS (SELECT *, sum(CASE WHEN kind = 'subsection' THEN 1 ELSE 0 END) {_OVER.format(', sec_id')} AS sub_id, CASE WHEN kind = 'paragraph' THEN regexp_extract(line, '{structure.PARAGRAPH}', 1) END AS m FROM c3),
c5 AS (SELECT *, last_value(m IGNORE NULLS) OVER (PARTITION BY doc_ord, sec_id, sub_id ORDER BY page_no, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b4 FROM c4),
c6 AS (SELECT * REPLACE (CASE WHEN kind = 'paragraph' AND b4 IS NOT NULL AND regexp_matches(line, '{structure.ROMAN}') AND NOT (length(m) = 1 AND length(b4) = 1 AND ascii(m) = ascii(b4) + 1) THEN 'subparagraph' ELSE kind END AS kind) FROM c5),
c7 AS (SELECT *, sum(CASE WHEN kind = 'paragraph' THEN 1 ELSE 0 END) {_OVER.format(', sec_id, sub_id')} AS para_id FROM c6),
c8 AS (SELECT * REPLACE (CASE WHEN kind = 'definition' AND para_id > 0 THEN 'text' ELSE kind END AS kind) FROM c7),
pl AS (SELECT *, {_LEVELS}, coalesce({_NUM('schedule', structure.HEADINGS['schedule'], '')}, '') AS schedule, CASE WHEN ins THEN coalesce({_NUM('section', structure.SECTION, ', sec_id')}, '') ELSE '' END AS section,
 coalesce({_NUM('subsection', structure.SUBSECTION, ', sec_id')}, '') AS subsection, coalesce({_NUM('paragraph', structure.PARAGRAPH, ', sec_id, sub_id')}, '') AS paragraph,
 sum(CASE WHEN kind IN ('section', 'subsection', 'paragraph', 'subparagraph') THEN 1 ELSE 0 END) {_OVER.format('')} AS node, page_no::BIGINT * 1000000 + line_no AS pos FROM c8)"""
_UNDER = ["chapter", "part", "division", "subdivision", "schedule", "section", "subsection", "paragraph"]
_PROVISIONS = rf"""
bd AS (SELECT *, CASE kind WHEN 'subsection' THEN regexp_extract(line, '{structure.SUBSECTION}', 2) WHEN 'paragraph' THEN regexp_extract(line, '{structure.PARAGRAPH}', 2) WHEN 'subparagraph' THEN regexp_extract(line, '{structure.PARAGRAPH}', 2) WHEN 'text' THEN line END AS body FROM pl WHERE section <> ''),
nd AS (SELECT doc_ord, arg_min(kind, pos) AS kind, any_value(title) AS title, max(CASE WHEN kind = 'section' THEN regexp_extract(line, '{structure.SECTION}', 2) END) AS heading, string_agg(body, chr(10) ORDER BY pos) AS text, {', '.join(f'arg_min({c}, pos) AS {c}' for c in _UNDER)},
 coalesce(max(CASE WHEN kind = 'subparagraph' THEN regexp_extract(line, '{structure.PARAGRAPH}', 1) END), '') AS subparagraph, min(pos) AS pos, arg_min(page_no, pos) AS page FROM bd WHERE kind <> 'definition' GROUP BY doc_ord, node
 UNION ALL SELECT doc_ord, kind, title, regexp_extract(line, '{_dq(structure.DEFINITION)}', 1), line, {', '.join(_UNDER)}, '', pos, page_no FROM bd WHERE kind = 'definition'),
pv AS (SELECT doc_ord, (row_number() OVER (PARTITION BY doc_ord ORDER BY kind = 'definition', pos))::INT AS node_ord, kind, coalesce(heading, '') AS heading,
 trim(regexp_replace(regexp_replace(coalesce(text, ''), '([\p{{L}}\p{{N}}])-\n([\p{{L}}\p{{N}}])', '\1\2', 'g'), '\s+', ' ', 'g')) AS text, section, subsection, paragraph, subparagraph,
 concat_ws(' > ', {', '.join(f"CASE WHEN {c} <> '' THEN '{c.capitalize()} ' || {c} END" for c in _UNDER[:5])}) AS context,
 coalesce(title, '') || ' ' || CASE WHEN schedule <> '' THEN 'Schedule ' || schedule || ', ' ELSE '' END || 's ' || section || {' || '.join(f"CASE WHEN {c} <> '' THEN '(' || {c} || ')' ELSE '' END" for c in ('subsection', 'paragraph', 'subparagraph'))} AS address, page FROM nd)"""
_PARSE = f"WITH {PAGES}, {TITLES}, {LINES}, {_PLACED}"


@query(f"{_PARSE}, {_PROVISIONS} SELECT doc_ord, node_ord, kind, heading, text, section, subsection, paragraph, subparagraph, context, address, page FROM pv")
def q_provisions(spark, d):
    return structure.provisions(table(spark, d, "act_pages"), _titles(spark, d).select("doc_ord", "title", "profile"))


@query(f"""{_PARSE}, {_PROVISIONS}, hd AS (SELECT *, sum(CASE WHEN kind = 'section' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_ord ORDER BY node_ord ROWS UNBOUNDED PRECEDING) AS head,
 nullif(CASE kind WHEN 'subsection' THEN '(' || subsection || ') ' WHEN 'paragraph' THEN '(' || paragraph || ') ' WHEN 'subparagraph' THEN '(' || subparagraph || ') ' ELSE '' END || text, '') AS piece FROM pv WHERE kind <> 'definition'),
ft AS (SELECT doc_ord, arg_min(address, node_ord) AS address, coalesce(string_agg(piece, ' ' ORDER BY node_ord), '') AS t FROM hd GROUP BY doc_ord, head)
SELECT doc_ord, address, CASE WHEN length(t) > {structure.FULL_TEXT} THEN regexp_replace(substring(t, 1, {structure.FULL_TEXT}), ' [^ ]*$', '') || ' [...]' ELSE t END AS full_text FROM ft""")
def q_full_text(spark, d):
    return structure.full_texts(q_provisions(spark, d))


@query(f"{_PARSE} SELECT doc_ord, string_agg(line, chr(10) ORDER BY pos) AS front_matter FROM (SELECT *, row_number() OVER (PARTITION BY doc_ord ORDER BY pos) AS r FROM pl WHERE section = '' AND kind = 'text') WHERE r <= 20 GROUP BY 1")
def q_front_matter(spark, d):
    return structure.front_matter(table(spark, d, "act_pages"), _titles(spark, d).select("doc_ord", "title", "profile"))


@query(f"""{_PARSE}, {_PROVISIONS}, hd AS (SELECT *, sum(CASE WHEN kind = 'section' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_ord ORDER BY node_ord ROWS UNBOUNDED PRECEDING) AS head FROM pv),
em AS (SELECT doc_ord, count(*) AS empty FROM (SELECT doc_ord, head FROM hd GROUP BY 1, 2 HAVING bool_or(kind = 'section') AND NOT bool_or(kind NOT IN ('definition', 'section') OR (kind = 'section' AND text <> ''))) GROUP BY 1),
ct AS (SELECT doc_ord, {', '.join(f"count(*) FILTER (kind = '{k}') AS {k}s" for k in structure.KINDS)} FROM pv GROUP BY 1),
al AS (SELECT DISTINCT doc_ord FROM act_documents WHERE doc_ord IS NOT NULL)
SELECT doc_ord, coalesce(empty, 0) AS empty_sections, {', '.join(f'coalesce({k}s, 0) AS {k}s' for k in structure.KINDS)}, concat_ws('; ', CASE WHEN coalesce(sections, 0) = 0 THEN 'no sections found' END, CASE WHEN coalesce(empty, 0) > 0.3 * coalesce(sections, 0) THEN empty || ' of ' || sections || ' sections have no text' END) AS warnings
FROM al LEFT JOIN ct USING (doc_ord) LEFT JOIN em USING (doc_ord)""")
def q_parse_report(spark, d):
    return structure.parse_report(q_provisions(spark, d), _titles(spark, d))


@query("SELECT position, act || ' s ' || section || CASE WHEN subsection <> '' THEN '(' || subsection || ')' ELSE '' END || CASE WHEN paragraph <> '' THEN '(' || paragraph || ')' ELSE '' END AS address FROM records")
def q_address(spark, d):
    rows = _records(spark, d).withColumn("schedule", F.lit("")).withColumn("subparagraph", F.lit(""))
    return rows.select("position", structure.address_of(F.col("act")).alias("address"))


# Index


@query(f"WITH {INDEX} SELECT token, count(*) AS df FROM post GROUP BY 1")
def q_postings_df(spark, d):
    return _index(spark, d).frequencies()


@query(f"WITH {INDEX} SELECT position, len FROM dlen")
def q_doc_len(spark, d):
    return _index(spark, d).doc_len


@query(f"WITH {INDEX} SELECT n, round(avg_len, 4) AS avg_len FROM stat")
def q_corpus_stats(spark, d):
    return _index(spark, d).stats().select("n", F.round("avg_len", 4).alias("avg_len"))


@query(f"WITH {INDEX} SELECT (SELECT count(*) FROM recs) AS provisions, (SELECT count(DISTINCT act) FROM recs) AS acts, (SELECT count(DISTINCT token) FROM post) AS distinct_terms")
def q_index_stats(spark, d):
    return index.index_stats(_index(spark, d)).drop("built")


@query(f"WITH {INDEX} SELECT token, df, n, round(avg_len, 4) AS avg_len FROM (SELECT token, count(*) AS df FROM post GROUP BY 1), stat")
def q_saved_index(spark, d):
    """Written to a folder and read again: the terms and the totals of what is read."""
    folder = f"{shared_dir(spark)}/tipstaff/saved-{uuid.uuid4().hex}"
    index.save(_index(spark, d), folder)
    read = index.load(spark, folder)
    n, average = read.totals()
    return read.frequencies().withColumn("n", F.lit(n).cast("bigint")).withColumn("avg_len", F.round(F.lit(average), 4))


@query("SELECT position, text, address, act, kind, section, heading, currency, page FROM records WHERE length(trim(text)) >= 12")
def q_json_index(spark, d):
    """The index as JSON lines, and back."""
    folder = f"{shared_dir(spark)}/tipstaff/json-{uuid.uuid4().hex}"
    index.export_json(_index(spark, d), folder)
    return index.import_json(spark, folder).records.select("position", "text", "address", "act", "kind", "section", "heading", "currency", "page")


@query(f"WITH {INDEX} SELECT kind AS value, count(*) AS provisions FROM recs GROUP BY 1")
def q_by_kind(spark, d):
    return index.count_by(_index(spark, d), "kind")


@query(f"WITH {INDEX} SELECT act AS value, count(*) AS provisions FROM recs GROUP BY 1")
def q_by_act(spark, d):
    return index.count_by(_index(spark, d), "act")


@query("WITH c AS (SELECT source AS path, count(*) FILTER (kind = 'section') AS sections, count(*) FILTER (length(trim(text)) >= 12) AS indexed FROM records GROUP BY 1), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY doc_ord) AS r FROM act_documents WHERE path IS NOT NULL) WHERE r = 1) SELECT path, profile, coalesce(sections, 0) AS sections, coalesce(indexed, 0) AS indexed FROM o LEFT JOIN c USING (path)")
def q_sources(spark, d):
    return index.sources_of(_records(spark, d), table(spark, d, "act_documents")).select("path", "profile", "sections", "indexed")


# Search


def _search_sql(question: str, limit: int = 20, where: str = "TRUE", columns: str = "position, score, reasons") -> str:
    q = search.Query(question)
    words = list(dict.fromkeys(q.words))
    values = ", ".join(f"('{w}', {min(q.words.count(w), search.MOST_REPEATS)}, {i})" for i, w in enumerate(words))
    arr = "[" + ",".join(f"'{w}'" for w in words) + "]"
    sub = lambda c: f"(length(lower({c})) - length(replace(lower({c}), token, ''))) / length(token)"
    shared = f"len(list_intersect(list_distinct({CONTENT.format('coalesce(heading, ' + chr(39) * 2 + ')')}), {arr}))"
    rules = [(f"contains(lower(text), '{p}')", str(search.PHRASE), f"'phrase \"{p}\"'") for p in q.phrases]
    if len(q.words) > 1:
        rules.append((f"contains(lower(text), '{' '.join(q.words)}')", str(search.TOGETHER), "'all words together'"))
    if q.section:
        rules.append((f"section = '{q.section}'", str(search.CITED), f"'section {q.section}'"))
    rules.append((f"{shared} >= {min(2, len(words))}", f"(1 + {search.HEADING} * {shared})", "'heading'"))
    rules.append((f"kind = 'definition' AND len(list_filter({arr}, lambda w: contains(lower(coalesce(heading, '')), w))) > 0", str(search.DEFINED), "'definition'"))
    score = " * ".join(["score0", *[f"CASE WHEN {c} THEN {f} ELSE 1.0 END" for c, f, _ in rules]])
    given = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {r} END" for c, _, r in rules) + "], lambda x: x IS NOT NULL)"
    fallback = f"'words: ' || array_to_string(list_filter({'[' + ','.join(repr(w) for w in sorted(words)) + ']'}, lambda w: contains(lower(concat_ws(' ', heading, text)), w))[1:5], ', ')"
    return f"""WITH {INDEX}, w(token, times, ord) AS (VALUES {values}), hit AS (SELECT token, position, times, ord FROM post JOIN w USING (token)), dfs AS (SELECT token, count(*) AS df FROM hit GROUP BY 1),
r AS (SELECT position, times, ord, {sub('text')} + {sub("coalesce(heading, '')")} + 1 AS tf, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, len, avg_len FROM hit JOIN dfs USING (token) JOIN recs USING (position) JOIN dlen USING (position), stat),
s AS (SELECT position, sum(idf * tf * {search.K1 + 1} / (tf + {search.K1} * (1 - {search.B} + {search.B} * greatest(len, 1) / avg_len)) * times) AS score0, min(ord) AS first_word FROM r GROUP BY 1),
o AS (SELECT recs.*, first_word, round({score}, 4) AS score, CASE WHEN len({given}) > 0 THEN array_to_string({given}, '; ') ELSE {fallback} END AS reasons FROM s JOIN recs USING (position) WHERE {where} ORDER BY score DESC, first_word, position LIMIT {limit})
SELECT {columns} FROM o"""


def _hits(spark, d, question: str, limit: int = 20, **filters) -> DataFrame:
    return search.search(_index(spark, d), question, limit, **filters).select("position", "score", F.array_join("reasons", "; ").alias("reasons"))


_QUESTIONS = {
    "q_bm25_topk": "lessee inspect lighthouse register penalty",
    "q_phrase_boost": '"registered post" warehouse notice',
    "q_together_boost": "penalty units",
    "q_citation_boost": "section 7 of the lease of a furnace",
    "q_heading_boost": "meaning of valuation power to insure easement",
    "q_definition_boost": "meaning of sluice catchment",
}
for _name, _question in _QUESTIONS.items():
    QUERIES[_name] = lambda spark, d, q=_question: _hits(spark, d, q)
    SQL[_name] = _search_sql(_question)

QUERIES["q_bm25_filtered"] = lambda spark, d: _hits(spark, d, "levy dock tribunal", 15, jurisdiction="queensland", act="inspection", kind="subsection")
SQL["q_bm25_filtered"] = _search_sql("levy dock tribunal", 15, "lower(jurisdiction) = 'queensland' AND contains(lower(act), 'inspection') AND kind = 'subsection'")


@query("SELECT position, address FROM records WHERE contains(lower(act), 'inkworks') AND section = '1A'")
def q_by_citation(spark, d):
    return search.by_citation(_records(spark, d), "Inkworks", "1A").select("position", "address")


# Lexicon

_ASKED = "can the landlord cancel my permission to keep a boat"
_VALUES = ", ".join(f"('{p}', '{t}', {i})" for p, ts in lexicon.BRIDGE.items() for i, t in enumerate(ts))


@query(f"WITH {INDEX}, lex(plain, term, ord) AS (VALUES {_VALUES}) SELECT plain, term, ord FROM lex WHERE list_contains({CONTENT.format(repr(_ASKED))}, plain) AND NOT contains('{_ASKED}', term) AND string_split(term, ' ')[1] IN (SELECT token FROM post)")
def q_expand(spark, d):
    return lexicon.bridged(_index(spark, d), _ASKED)


@query(f"""WITH {INDEX}, df AS (SELECT token, count(*) AS df FROM post GROUP BY 1),
fst AS (SELECT token AS term, position FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY position) AS r FROM post) WHERE r <= 300),
own AS (SELECT p.token, count(*) AS n FROM fst JOIN post p USING (position) WHERE term = 'lighthouse' AND p.token <> 'lighthouse' GROUP BY 1),
top AS (SELECT token FROM own JOIN df USING (token) WHERE df >= 8 AND df <= 0.05 * (SELECT n FROM stat) AND length(token) >= 4 AND NOT regexp_matches(token, '^[0-9]+$') ORDER BY own.n DESC, token LIMIT 30),
oth AS (SELECT term, p.token, count(*) AS n FROM fst JOIN post p USING (position) WHERE term IN (SELECT token FROM top) AND p.token <> term GROUP BY 1, 2),
c AS (SELECT term, sum(o.n * coalesce(own.n, 0)) AS dot, sum(o.n * o.n) AS b FROM oth o LEFT JOIN own USING (token) WHERE o.token <> 'lighthouse' GROUP BY 1),
s AS (SELECT term AS token, round(dot / sqrt(((SELECT sum(n * n) FROM own) - own.n * own.n) * b), 3) AS similarity FROM c JOIN own ON own.token = c.term)
SELECT token, similarity FROM s WHERE similarity >= 0.5 ORDER BY similarity DESC, token LIMIT 4""")
def q_related_terms(spark, d):
    return lexicon.related_terms(_index(spark, d), "lighthouse")


_TWO = SQL["q_related_terms"].removesuffix("LIMIT 4") + "LIMIT 2"


@query(f"WITH a AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, token) AS r FROM ({_TWO})) SELECT token AS term, 'used like lighthouse' AS reason, (SELECT 'Also searched: ' || string_agg(token || ' (used like lighthouse)', ', ' ORDER BY r) FROM a) AS described FROM a")
def q_wider(spark, d):
    """A question widened by the company its words keep."""
    wide = lexicon.expand(_index(spark, d), "lighthouse", wider=True)
    return spark.createDataFrame([(t, wide.reasons[t], wide.describe()) for t in wide.added], "term string, reason string, described string")


# Threads

_REF, _ACTREF = threads.SECTION.pattern, threads.ACT.pattern


@query(f"SELECT position, len(regexp_extract_all(coalesce(text, ''), '(?i){_REF}')) AS section_refs, len(regexp_extract_all(coalesce(text, ''), '{_dq(_ACTREF)}')) AS act_refs FROM records")
def q_reference_counts(spark, d):
    text = F.coalesce("text", F.lit(""))
    count = lambda p: F.size(F.regexp_extract_all(text, F.lit(p), F.lit(0))).cast("bigint")
    return _records(spark, d).select("position", count("(?i)" + _REF).alias("section_refs"), count(_ACTREF).alias("act_refs"))


_NAME = "trim(regexp_replace(regexp_replace({}, '(?i)^the\\s+', ''), '\\s+', ' ', 'g'))"
_AT = "list_sum(list_transform(p[1:g], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:g - 1], lambda x: length(x))), 0)"
_FOUND = "SELECT position, own, sec, text, m[g] AS s, ({at})::BIGINT AS spot FROM (SELECT *, unnest(generate_series(1, len(m))) AS g FROM (SELECT *, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS p FROM rc))"
_SAME = "({a} <> '' AND {b} <> '' AND (ends_with(lower({a}), lower({b})) OR ends_with(lower({b}), lower({a}))))"
_QUOTE = f"CASE WHEN spot > {threads.QUOTE // 2} THEN '[...] ' ELSE '' END || trim(regexp_replace(substring(text, greatest(0, spot - {threads.QUOTE // 2}) + 1, least(length(text), spot + {threads.QUOTE // 2}) - greatest(0, spot - {threads.QUOTE // 2})), '\\s+', ' ', 'g')) || CASE WHEN spot + {threads.QUOTE // 2} < length(text) THEN ' [...]' ELSE '' END"
_EDGES = f"""WITH rc AS (SELECT position, address, act, {_NAME.format("coalesce(act, '')")} AS own, coalesce(section, '') AS sec, text FROM records WHERE coalesce(kind, '') <> 'section' AND coalesce(text, '') <> ''),
sr AS ({_FOUND.format(at=_AT, p='(?i)' + _REF)}), ar AS (SELECT *, {_NAME.format('s')} AS name FROM ({_FOUND.format(at=_AT, p=_dq(_ACTREF))})),
ah AS (SELECT sr.position, sr.spot, arg_min(name, ar.spot) AS name FROM sr JOIN ar ON ar.position = sr.position AND ar.spot - (sr.spot + length(sr.s)) BETWEEN 0 AND {threads.AHEAD} GROUP BY 1, 2),
bh AS (SELECT sr.position, sr.spot, arg_max(name, ar.spot) AS name FROM sr JOIN ar ON ar.position = sr.position AND ar.spot < sr.spot GROUP BY 1, 2),
t0 AS (SELECT sr.*, coalesce(ah.name, bh.name, own) AS target FROM sr LEFT JOIN ah USING (position, spot) LEFT JOIN bh USING (position, spot)),
t1 AS (SELECT * REPLACE (CASE WHEN {_SAME.format(a='target', b='own')} THEN own ELSE target END AS target), regexp_extract(s, '(?i){_REF}', 1) AS tsec, regexp_extract(s, '(?i){_REF}', 2) AS tsub FROM t0),
al AS (SELECT position, 0 AS part, spot, target, tsec, tsub, {_QUOTE} AS quote FROM t1 WHERE NOT (target = own AND tsec = sec)
 UNION ALL SELECT position, 1, spot, name, '', '', {_QUOTE} FROM ar WHERE NOT {_SAME.format(a='name', b='own')} AND NOT EXISTS (SELECT 1 FROM sr WHERE sr.position = ar.position AND abs(sr.spot - ar.spot) < {threads.NEAR})),
ed AS (SELECT position, (row_number() OVER (PARTITION BY position ORDER BY part, spot) - 1)::INT AS seq, target AS target_act, tsec AS target_section, tsub AS target_subsection, quote FROM al)"""
_REL = "CASE " + " ".join(f"WHEN regexp_matches(quote, '(?i){p}') THEN '{n}'" for n, p in threads.RELATIONS) + " ELSE 'refers to' END"


@query(f"{_EDGES} SELECT position, seq, address AS source_address, act AS source_act, target_act, target_section, target_subsection, ed.quote, {_REL} AS relation FROM ed JOIN rc USING (position)")
def q_edges(spark, d):
    return threads.edges(_records(spark, d))


@query(f"WITH {EDGES} SELECT {_REL} AS relation, count(*) AS edges FROM edge GROUP BY 1")
def q_relation(spark, d):
    return threads.relation_counts(_edges(spark, d).withColumn("relation", threads.relation(F.col("quote"))))


@query(f"WITH {EDGES} SELECT source_act, target_act, count(*) AS refs FROM edge WHERE source_act <> target_act GROUP BY 1, 2")
def q_act_links(spark, d):
    return threads.act_links(_edges(spark, d))


@query(f"WITH {EDGES}, k AS (SELECT DISTINCT act FROM records WHERE act IS NOT NULL) SELECT (SELECT count(*) FROM edge) AS edges, (SELECT count(*) FROM k) AS acts, (SELECT count(DISTINCT target_act) FROM edge WHERE target_act NOT IN (SELECT act FROM k)) AS external_acts")
def q_thread_stats(spark, d):
    return threads.thread_stats(_edges(spark, d), _records(spark, d))


_PLAIN = "trim(regexp_replace(regexp_replace(lower({}), '\\s+', ' ', 'g'), '^ ?the ', ''))"


@query(f"""WITH {EDGES}, k AS (SELECT DISTINCT {_PLAIN.format('act')} AS name FROM records WHERE act IS NOT NULL), t AS (SELECT DISTINCT target_act, {_PLAIN.format('target_act')} AS name FROM edge WHERE target_act IS NOT NULL),
o AS (SELECT target_act FROM t WHERE name <> '' AND NOT EXISTS (SELECT 1 FROM k WHERE k.name <> '' AND (ends_with(k.name, t.name) OR ends_with(t.name, k.name)))),
r AS (SELECT target_act, source_address, row_number() OVER (PARTITION BY target_act ORDER BY edge_ord) AS r FROM edge WHERE target_act IN (SELECT target_act FROM o))
SELECT target_act, count(*) AS refs, string_agg(source_address, ' | ' ORDER BY r) FILTER (r <= 3) AS first_seen_at FROM r GROUP BY 1""")
def q_reading_list(spark, d):
    return threads.reading_list(_edges(spark, d), _records(spark, d))


@query(f"WITH {EDGES} SELECT edge_ord, source_address FROM edge WHERE lower(trim(target_act)) = 'granary labelling act 1967' AND target_section = '1'")
def q_inbound(spark, d):
    return threads.inbound(_edges(spark, d), "Granary Labelling Act 1967", "1").select("edge_ord", "source_address")


@query(f"WITH {EDGES} SELECT edge_ord, target_act FROM edge WHERE source_address = 'Glasshouse Bellows Act 2013 s 4'")
def q_outbound(spark, d):
    return threads.outbound(_edges(spark, d), "Glasshouse Bellows Act 2013 s 4").select("edge_ord", "target_act")


@query(f"WITH {EDGES} SELECT edge_ord, target_act || CASE WHEN coalesce(target_section, '') <> '' THEN ' s ' || target_section || CASE WHEN coalesce(target_subsection, '') <> '' THEN '(' || target_subsection || ')' ELSE '' END ELSE '' END AS label FROM edge")
def q_target_label(spark, d):
    return _edges(spark, d).select("edge_ord", threads.target_label(F.col("target_act"), F.col("target_section"), F.col("target_subsection")).alias("label"))


_UP = "SELECT DISTINCT address FROM records JOIN ({}) q ON contains(lower(act), lower(q.name)) AND records.section = q.section WHERE address IS NOT NULL"


@query(f"""WITH {EDGES}, st AS (SELECT * FROM (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY target_act, target_section, source_address ORDER BY edge_ord) AS r FROM edge) WHERE r = 1),
s1 AS ({_UP.format("SELECT 'granary labelling' AS name, '1' AS section")}), l1 AS (SELECT st.* FROM st JOIN s1 ON source_address = address),
s2 AS ({_UP.format("SELECT DISTINCT target_act AS name, target_section AS section FROM l1 WHERE coalesce(target_section, '') <> '' AND target_act IS NOT NULL")}), l2 AS (SELECT st.* FROM st JOIN s2 ON source_address = address WHERE address NOT IN (SELECT address FROM s1))
SELECT level, edge_ord, source_address, target_act, target_section, relation FROM (SELECT 1 AS level, * FROM l1 UNION ALL SELECT 2, * FROM l2)""")
def q_trace(spark, d):
    found = threads.trace(_edges(spark, d), _records(spark, d), "granary labelling", "1", 2)
    return found.select("level", "edge_ord", "source_address", "target_act", "target_section", "relation")


# Answers

_ASK, _BRIDGED = "may the court open a letter about the tax on a ship", "may the court open a letter about the tax on a ship tribunal notice levy vessel"


@query(_search_sql(_BRIDGED, 20, "TRUE", "address, printf('%.3f', score)::DOUBLE AS score, reasons, coalesce(text, '') AS text"))
def q_ask(spark, d):
    """A question in everyday words, with the bridge on: what the packet shows."""
    packet = answer.ask(_index(spark, d), _ASK, 20)
    return spark.createDataFrame([(e.address, e.score, "; ".join(e.reasons), e.text) for e in packet.extracts], "address string, score double, reasons string, text string")


_CITED = "cited AS (SELECT * FROM (SELECT * FROM records WHERE length(trim(text)) >= 12 AND contains(lower(act), 'flaxmill sureties') AND section = '4' ORDER BY position LIMIT 1000))"


def _cited(spark, d) -> answer.Packet:
    return answer.cite(_index(spark, d), "Flaxmill Sureties", "4", limit=1_000)


@query(f"WITH {_CITED} SELECT address, 1.0::DOUBLE AS score, 'looked up by address' AS reason, text FROM cited")
def q_cite(spark, d):
    return spark.createDataFrame([(e.address, e.score, e.reasons[0], e.text) for e in _cited(spark, d).extracts], "address string, score double, reason string, text string")


_RULES = "\n".join(answer.Packet("").as_prompt().split("\n")[3:])


@query(f"""WITH {_CITED} SELECT 'Question: Flaxmill Sureties s 4' || chr(10) || chr(10) || 'Provisions:' || chr(10) || string_agg('[' || r || '] ' || address || ' (' || coalesce(jurisdiction, '') || ', as at ' || coalesce(nullif(currency, ''), 'unknown date') || '): ' || coalesce(text, ''), chr(10) ORDER BY position) || chr(10)
 || replace(replace('{_dq(_RULES)}', 'an address above', arg_min(address, position)), 'the official register of the jurisdiction', coalesce(string_agg(DISTINCT nullif({{reg}}, ''), ', ' ORDER BY nullif({{reg}}, '')), 'the official register of the jurisdiction')) AS prompt FROM (SELECT *, row_number() OVER (ORDER BY position) AS r FROM cited)""".replace("{reg}", "CASE jurisdiction " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in detect.REGISTERS.items()) + " ELSE '' END"))
def q_prompt(spark, d):
    return spark.createDataFrame([(_cited(spark, d).as_prompt(),)], "prompt string")


@query("SELECT false AS found, 'Nothing in the index answers: ' || q || chr(10) || 'No answer is given rather than one without a source.' AS said FROM (VALUES ('zebra xylophone'), ('the of and'), ('')) t(q)")
def q_refusal(spark, d):
    """Questions of which no word stands in the index."""
    packets = [answer.ask(_index(spark, d), q) for q in ("zebra xylophone", "the of and", "")]
    return spark.createDataFrame([(p.found, p.as_text()) for p in packets], "found boolean, said string")


_REG = "CASE jurisdiction " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in detect.REGISTERS.items()) + " ELSE '' END"
_NOTES = f"""[CASE WHEN count(*) FILTER (coalesce(currency, '') = '') > 0 THEN count(*) FILTER (coalesce(currency, '') = '') || ' of ' || count(*) || ' extracts carry no date.' END,
 'Stated as at: ' || string_agg(DISTINCT nullif(currency, ''), '; ' ORDER BY nullif(currency, '')) || '.', CASE WHEN count(DISTINCT nullif(jurisdiction, '')) > 1 THEN 'Extracts come from several jurisdictions: ' || string_agg(DISTINCT nullif(jurisdiction, ''), ', ' ORDER BY nullif(jurisdiction, '')) || '.' END, '{answer.NOT_ADVICE}']"""
_KEYS = [("address", "address"), *((c, f"coalesce({c}, '')") for c in ("context", "heading", "text", "jurisdiction")), ("currency", "currency"), ("source", "source")]
_ONE = "'  {' || chr(10) || " + " || ',' || chr(10) || ".join(f"'   \"{k}\": ' || coalesce(to_json({v})::VARCHAR, 'null')" for k, v in _KEYS) + f""" || ',' || chr(10) || '   "score": 1.0,' || chr(10) || '   "reasons": [' || chr(10) || '    "looked up by address"' || chr(10) || '   ],' || chr(10) || '   "register": ' || to_json({_REG})::VARCHAR || chr(10) || '  }}'"""


@query(f"""WITH {_CITED}, n AS (SELECT list_filter({_NOTES}, lambda x: x IS NOT NULL) AS notes FROM cited)
SELECT '{{' || chr(10) || ' "question": "Flaxmill Sureties s 4",' || chr(10) || ' "found": true,' || chr(10) || ' "extracts": [' || chr(10) || (SELECT string_agg({_ONE}, ',' || chr(10) ORDER BY position) FROM cited) || chr(10) || ' ],' || chr(10) || ' "notes": [' || chr(10) || array_to_string(list_transform(notes, lambda x: '  ' || to_json(x)::VARCHAR), ',' || chr(10)) || chr(10) || ' ]' || chr(10) || '}}' AS packet FROM n""")
def q_packet_json(spark, d):
    return spark.createDataFrame([(_cited(spark, d).to_json(),)], "packet string")


@query(f"WITH {_CITED} SELECT unnest(list_filter({_NOTES}, lambda x: x IS NOT NULL)) AS note FROM cited")
def q_notes(spark, d):
    return spark.createDataFrame([(n,) for n in _cited(spark, d).notes], "note string")


@query(f"SELECT jurisdiction, {_REG} AS register, count(*) AS records FROM records GROUP BY 1, 2")
def q_register(spark, d):
    return answer.with_register(_records(spark, d)).groupBy("jurisdiction", "register").agg(F.count(F.lit(1)).alias("records"))


@query("WITH o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY doc_ord) AS r FROM act_documents WHERE path IS NOT NULL) WHERE r = 1) SELECT path AS subject, 'no currency date' AS problem FROM o WHERE coalesce(currency_text, '') = '' UNION ALL SELECT path, unnest(warnings) FROM o")
def q_check(spark, d):
    return answer.check(index.sources_of(_records(spark, d), table(spark, d, "act_documents")))


# Extensions


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]), 4) AS cosine FROM q, embeddings WHERE query_id <> vec_id)
SELECT query_id, vec_id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def ext_embedding_topk(spark, d):
    rows = table(spark, d, "embeddings")
    return vectors.nearest(rows, rows.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding", 5)


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def ext_event_windows(spark, d):
    return event_windows(table(spark, d, "events")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", F.round("total", 2).alias("total"))


@query("SELECT jurisdiction, act, kind, count(*) AS provisions FROM records GROUP BY ROLLUP (jurisdiction, act, kind)")
def ext_rollup(spark, d):
    return _records(spark, d).rollup("jurisdiction", "act", "kind").agg(F.count(F.lit(1)).alias("provisions"))
