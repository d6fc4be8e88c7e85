"""Answers: the stored text with its address, date and source; never generated prose."""

from __future__ import annotations

import json
import textwrap
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.detect import REGISTERS, mapped
from .index import Index
from .lexicon import expand
from .search import by_citation, search

NOT_ADVICE = "This is the text of the law as stored here, not legal advice."


@dataclass
class Extract:
    address: str
    context: str
    heading: str
    text: str
    jurisdiction: str
    currency: str | None
    source: str
    score: float
    reasons: list[str]

    @property
    def register(self) -> str:
        return REGISTERS.get(self.jurisdiction, "")


@dataclass
class Packet:
    question: str
    extracts: list[Extract] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    @property
    def found(self) -> bool:
        return bool(self.extracts)

    def to_dict(self) -> dict:
        return {"question": self.question, "found": self.found, "extracts": [asdict(e) | {"register": e.register} for e in self.extracts], "notes": self.notes}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), ensure_ascii=False, indent=1)

    def as_text(self, width: int = 78) -> str:
        if not self.found:
            return f"Nothing in the index answers: {self.question}\nNo answer is given rather than one without a source."
        out = [self.question, ""]
        for n, e in enumerate(self.extracts, 1):
            out.append(f"{n}. {e.address}" + (f"  {e.heading}" if e.heading else ""))
            out += [f"   in {e.context}"] if e.context else []
            out.append(f"   as at {e.currency or 'an unknown date'} | {e.jurisdiction}")
            out += [f"   found by {'; '.join(e.reasons)}"] if e.reasons else []
            out += textwrap.wrap(e.text or "", width, initial_indent="   ", subsequent_indent="   ") + [""]
        return "\n".join(out + [f"- {n}" for n in self.notes])

    def as_prompt(self) -> str:
        """A prompt that holds a reader to these provisions."""
        lines = [f"Question: {self.question}", "", "Provisions:"]
        for n, e in enumerate(self.extracts, 1):
            lines.append(f"[{n}] {e.address} ({e.jurisdiction}, as at {e.currency or 'unknown date'}): {e.text}")
        first = self.extracts[0].address if self.extracts else "an address above"
        where = ", ".join(sorted({e.register for e in self.extracts if e.register})) or "the official register of the jurisdiction"
        lines += [
            "", "Rules:",
            "1. Use only the provisions above.",
            f"2. Cite the address of each provision relied on, such as {first}.",
            "3. Quote exactly where the wording matters.",
            "4. Say so if the provisions do not answer the question.",
            "5. Mention the date each provision is stated at.",
            f"6. Tell the reader to check the current text at {where}; this is not legal advice.",
        ]
        return "\n".join(lines)


def notes_of(extracts: list[Extract]) -> list[str]:
    out = []
    undated = sum(not e.currency for e in extracts)
    if undated:
        out.append(f"{undated} of {len(extracts)} extracts carry no date.")
    dates = sorted({e.currency for e in extracts if e.currency})
    if dates:
        out.append("Stated as at: " + "; ".join(dates) + ".")
    places = sorted({e.jurisdiction for e in extracts if e.jurisdiction})
    if len(places) > 1:
        out.append("Extracts come from several jurisdictions: " + ", ".join(places) + ".")
    return [*out, NOT_ADVICE]


def _extracts(rows: list) -> list[Extract]:
    return [Extract(r["address"], r["context"] or "", r["heading"] or "", r["text"] or "", r["jurisdiction"] or "", r["currency"], r["source"], round(r["score"], 3), list(r["reasons"])) for r in rows]


def ask(index: Index, question: str, limit: int = 5, jurisdiction: str | None = None, act: str | None = None, bridge: bool = True, wider: bool = False) -> Packet:
    """The best provisions for a question; limit rows reach the driver."""
    wide = expand(index, question, wider) if bridge else None
    hits = search(index, wide.as_query() if wide else question, limit, jurisdiction, act)
    found = _extracts(hits.collect())
    notes = ([wide.describe()] if wide and wide.changed else []) + (notes_of(found) if found else [])
    return Packet(question, found, notes)


def cite(index: Index, act: str, section: str, subsection: str | None = None, limit: int = 50) -> Packet:
    """The provisions at an address, in index order; the packet shows at most limit of them, by_citation all."""
    rows = by_citation(index.records, act, section, subsection).orderBy("position").limit(limit)
    rows = rows.withColumn("score", F.lit(1.0)).withColumn("reasons", F.array(F.lit("looked up by address")))
    found = _extracts(rows.collect())
    return Packet(f"{act} s {section}" + (f"({subsection})" if subsection else ""), found, notes_of(found) if found else [])


def with_register(df: DataFrame, jurisdiction: str = "jurisdiction") -> DataFrame:
    return df.withColumn("register", mapped(F.col(jurisdiction), REGISTERS, ""))


def check(sources: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """subject and problem: undated sources, their warnings, and skipped files."""
    undated = sources.where(F.coalesce("currency", F.lit("")) == "").select(F.col("path").alias("subject"), F.lit("no currency date").alias("problem"))
    warned = sources.select(F.col("path").alias("subject"), F.explode("warnings").alias("problem"))
    out = undated.unionByName(warned)
    return out.unionByName(skipped.select(F.col("path").alias("subject"), F.concat(F.lit("skipped: "), "reason").alias("problem"))) if skipped is not None else out
