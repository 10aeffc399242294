"""Command line: create, remember, recall, boot, reflect, snapshot, migrate."""

from __future__ import annotations

import argparse
import json
import sys

from .agent import Agent, __version__
from .functions.text import slug_text
from .operators import migration
from .session import session
from .sources.providers import HashEmbedder


def importance(text: str) -> int:
    n = int(text)
    if not 1 <= n <= 10:
        raise argparse.ArgumentTypeError("importance is from 1 to 10")
    return n


def ocean(text: str) -> dict[str, float]:
    v = [float(x) for x in text.split(",")]
    if len(v) != 5 or not all(0 <= x <= 1 for x in v):
        raise argparse.ArgumentTypeError("five numbers from 0 to 1: O,C,E,A,N")
    return dict(zip("OCEAN", v, strict=True))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="recollect")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--root", help="folder of the store")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb in ("create", "remember", "recall", "boot", "reflect", "snapshot"):
        s = sub.add_parser(verb)
        s.add_argument("agent")
        if verb in ("remember", "recall", "reflect"):
            s.add_argument("text")
        if verb == "create":
            s.add_argument("--personality", default="")
            s.add_argument("--ocean", type=ocean)
        if verb == "remember":
            s.add_argument("--importance", type=importance, default=5)
            s.add_argument("--category", default="fact")
        if verb == "recall":
            s.add_argument("--limit", type=int, default=10)
    s = sub.add_parser("migrate", help="embed a table of memories anew")
    s.add_argument("action", choices=("run", "rollback"))
    s.add_argument("checkpoint")
    s.add_argument("--source")
    s.add_argument("--candidate")
    s.add_argument("--dimensions", type=int, default=1024)
    s.add_argument("--ranges", type=int, default=16)
    s.add_argument("--resume", action="store_true")
    s.add_argument("--dry-run", action="store_true")
    return p


def migrate(a: argparse.Namespace) -> dict:
    spark = session()
    if a.action == "rollback":
        return migration.rollback(spark, a.checkpoint)
    if not (a.source and a.candidate):
        raise ValueError("--source and --candidate are needed")
    embedder = HashEmbedder(a.dimensions)
    return migration.migrate(spark, a.source, a.candidate, a.checkpoint, lambda df: embedder.embed(df, "id", "_text").select("id", "embedding"), target=a.dimensions, ranges=a.ranges, resume=a.resume, dry_run=a.dry_run)


def main(argv: list[str] | None = None) -> int:
    """0 if all went well, 2 for wrong input, 130 if interrupted."""
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    try:
        if a.verb == "migrate":
            print(json.dumps(migrate(a)))
            return 0
        agent = Agent(session(), a.agent, a.root or f"recollect-{slug_text(a.agent)}")
        if a.verb == "create":
            agent.set_identity(a.personality, a.ocean or {})
            print(f"created {a.agent}")
        elif a.verb == "remember":
            print(*agent.remember([a.text], importance=a.importance, category=a.category))
        elif a.verb == "recall":
            for r in agent.recall(a.text, limit=a.limit).collect():
                print(f"{r['score']:.3f}\t{r['id']}\t{r['content']}")
        elif a.verb == "boot":
            print(agent.boot())
        elif a.verb == "reflect":
            print(agent.reflect(a.text))
        else:
            print(json.dumps(agent.snapshot(), ensure_ascii=False, default=str))
        return 0
    except (ValueError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
