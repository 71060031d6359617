"""``python -m quillgraph``: connect, ingest, query, stats, facts, entities, config, clear."""

from __future__ import annotations

import argparse
import getpass
import json
import sys
from pathlib import Path

from pyspark.sql import functions as F

from quillgraph.config import Config, load_user, save_user
from quillgraph.errors import EngineError
from quillgraph.operators import resolve, store
from quillgraph.plans.engine import KnowledgeBase
from quillgraph.providers import KNOWN, provider
from quillgraph.session import get_session
from quillgraph.sources.loaders import SUFFIXES


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillgraph")
    p.add_argument("--kb", help="folder of the knowledge base")
    sub = p.add_subparsers(dest="command", required=True)
    add = sub.add_parser("ingest", help="files, folders or, without any, what lies in this folder")
    add.add_argument("sources", nargs="*")
    ask = sub.add_parser("query")
    ask.add_argument("question", nargs="+")
    ask.add_argument("--at", help="as of a time, in ISO format")
    ask.add_argument("--json", action="store_true")
    sub.add_parser("stats")
    for name in ("facts", "entities"):
        s = sub.add_parser(name)
        s.add_argument("--limit", type=int, default=20)
        s.add_argument("--search", help="text in a name")
        if name == "facts":
            s.add_argument("--entity", help="name or id of the subject")
    sub.add_parser("config")
    link = sub.add_parser("connect", help="choose a provider")
    link.add_argument("provider", nargs="?", choices=sorted(KNOWN))
    link.add_argument("--model")
    gone = sub.add_parser("clear")
    gone.add_argument("--yes", action="store_true")
    return p


def settings(args) -> Config:
    chosen = {k: v for k, v in load_user().items() if k in ("provider", "model")}
    config = Config.from_dict(chosen | Config.from_env().as_mapping() if not chosen else Config.from_env().as_mapping() | chosen)
    return Config.from_dict(config.as_mapping() | ({"kb_dir": args.kb} if args.kb else {}))


def connect(args) -> int:
    name = args.provider
    if name is None:
        for i, n in enumerate(sorted(KNOWN), 1):
            print(f"{i}. {n}")
        name = sorted(KNOWN)[int(input("Provider: ")) - 1]
    key = KNOWN[name][3]
    saved = {"provider": name, "model": args.model or KNOWN[name][2]}
    if key and sys.stdin.isatty() and (said := getpass.getpass(f"{key} (empty to read it from the environment): ")):
        saved[key] = said
    print("saved to", save_user(saved))
    return 0


def run(args) -> int:
    config = settings(args)
    if args.command == "connect":
        return connect(args)
    if args.command == "config":
        print(json.dumps(config.as_mapping(), indent=2))
        return 0
    spark = get_session()
    spark.sparkContext.setLogLevel("ERROR")
    kb = KnowledgeBase(spark, config, provider(config.provider, config.model))
    if args.command == "ingest":
        found = args.sources or sorted(str(p) for p in Path.cwd().iterdir() if p.suffix.lower().lstrip(".") in SUFFIXES)
        print(json.dumps(kb.ingest(found)))
    elif args.command == "query":
        got = kb.query(" ".join(args.question), args.at)
        print(json.dumps(got) if args.json else "\n".join([got["answer"], *("  " + t for t in got["trace"])]))
    elif args.command == "stats":
        print(json.dumps(kb.stats()))
    elif args.command == "entities":
        e = kb.store.read("entities")
        rows = resolve.search(e, args.search, args.limit) if args.search else e.orderBy("name", "id").limit(args.limit)
        for r in rows.collect():
            print(r.id, r.name, r.entity_type or "", sep="\t")
    elif args.command == "facts":
        f = store.with_names(kb.store.read("facts"), kb.store.read("entities"))
        if args.entity:
            f = f.where((F.col("subject_id") == args.entity) | (F.lower("subject_name") == args.entity.lower()))
        if args.search:
            f = f.where(F.contains(F.lower("subject_name"), F.lit(args.search.lower())))
        for r in f.orderBy("subject_name", "id").limit(args.limit).collect():
            print(r.id, r.subject_name, r.predicate, r.object_value or r.object_name, r.confidence, sep="\t")
    elif args.command == "clear" and (args.yes or input(f"Delete {config.kb_dir}? [y/N] ").lower() == "y"):
        kb.delete()
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args)
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
