"""Command line: index, ask, cite, sources, threads, trace, check."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tipstaff")
    p.add_argument("--index-dir", default="tipstaff-index")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("index")
    a.add_argument("patterns", nargs="+")
    a.add_argument("--parity", action="store_true")
    a.add_argument("--profile", help="one layout for all files: cth, qld or generic")
    a = sub.add_parser("ask")
    a.add_argument("question")
    a.add_argument("--limit", type=int, default=5)
    a.add_argument("--jurisdiction")
    a.add_argument("--act")
    a.add_argument("--no-bridge", action="store_true")
    a.add_argument("--wider", action="store_true")
    a.add_argument("--format", choices=["text", "json", "prompt"], default="text")
    a = sub.add_parser("cite")
    a.add_argument("act")
    a.add_argument("section")
    a.add_argument("subsection", nargs="?")
    a.add_argument("--json", action="store_true")
    sub.add_parser("sources")
    a = sub.add_parser("threads")
    a.add_argument("--limit", type=int, default=15)
    a.add_argument("--json", action="store_true")
    a = sub.add_parser("trace")
    a.add_argument("act")
    a.add_argument("section")
    a.add_argument("--depth", type=int, default=2)
    a.add_argument("--limit", type=int, default=20)
    a.add_argument("--json", action="store_true")
    sub.add_parser("check")
    return p


def _print(rows: list, columns: list[str]) -> None:
    for r in rows:
        print("  ".join(str(r[c]) for c in columns))


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    from .operators import answer, index, threads
    from .plans.build import build_index
    from .runtime import scratch, session
    from .sources.files import expand

    spark = session()
    if args.command == "index":
        paths, missing = expand(args.patterns)
        for m in missing:
            print(f"nothing matches {m}", file=sys.stderr)
        if not paths:
            return 1
        built = build_index(spark, paths, args.index_dir, args.parity, args.profile, lambda path, act, n: print(f"{path}: {act}, {n} provisions"), lambda path, reason: print(f"skipped {path}: {reason}", file=sys.stderr))
        index.index_stats(built).show(truncate=False)
        return 0
    try:
        ix = index.load(spark, args.index_dir)
    except Exception:
        print(f"no index at {args.index_dir}; make one with the index command", file=sys.stderr)
        return 1
    if args.command == "ask":
        packet = answer.ask(ix, args.question, args.limit, args.jurisdiction, args.act, not args.no_bridge, args.wider)
        print({"text": packet.as_text, "json": packet.to_json, "prompt": packet.as_prompt}[args.format]())
        return 0 if packet.found else 1
    if args.command == "cite":
        packet = answer.cite(ix, args.act, args.section, args.subsection)
        print(packet.to_json() if args.json else packet.as_text())
        return 0 if packet.found else 1
    if args.command == "sources":
        _print(ix.sources.orderBy("act").collect(), ["act", "jurisdiction", "currency", "sections", "indexed", "path"])
        return 0
    if args.command == "check":
        rows = answer.check(ix.sources, ix.skipped).orderBy("subject").collect()
        _print(rows, ["subject", "problem"])
        return 1 if rows else 0
    edges = spark.read.parquet(f"{args.index_dir}/edges").withColumn("edge_ord", F.struct("position", "seq"))
    if args.command == "threads":
        tables = {"stats": threads.thread_stats(edges, ix.records), "by_relation": threads.relation_counts(edges), "act_links": threads.act_links(edges).orderBy(F.desc("refs")).limit(args.limit), "reading_list": threads.reading_list(edges, ix.records).orderBy(F.desc("refs")).limit(args.limit)}
        rows = {k: [r.asDict() for r in v.collect()] for k, v in tables.items()}
        print(json.dumps(rows, indent=1, default=str) if args.json else "\n".join(f"{k}: {r}" for k, rs in rows.items() for r in rs))
        return 0
    columns = ["level", "source_address", "relation", "target_act", "target_section", "target_subsection", "quote"]
    with scratch(spark):
        found = threads.trace(edges, ix.records, args.act, args.section, args.depth).orderBy("level", "edge_ord").select(*columns).limit(args.limit + 1).collect()
    shown = found[: args.limit]
    if args.json:
        print(json.dumps({"act": args.act, "section": args.section, "more": len(found) > args.limit, "trail": [r.asDict() for r in shown]}, ensure_ascii=False, indent=1))
    elif found:
        for r in shown:
            label = r["target_act"] + (f" s {r['target_section']}" if r["target_section"] else "") + (f"({r['target_subsection']})" if r["target_subsection"] else "")
            print(f"{'  ' * r['level']}{r['source_address']} --{r['relation']}--> {label}\n{'  ' * r['level']}  {r['quote']}")
        if len(found) > args.limit:
            print("there are more; raise --limit")
    else:
        print(f"no references out of {args.act} s {args.section}", file=sys.stderr)
    return 0 if found else 1
