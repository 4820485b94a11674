"""python -m quillstone DATA add|list|search|activate|update|remove|use|stats|ask|status|storage ..."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os

RULE = "=" * 60


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quillstone")
    parser.add_argument("data", help="data folder")
    commands = parser.add_subparsers(dest="command")
    texts = ("url", "name", "description", "topics", "use-cases", "tags")
    add, update = commands.add_parser("add"), commands.add_parser("update")
    update.add_argument("--id", required=True)
    for name in texts:
        add.add_argument(f"--{name}", required=name in texts[:4], default="")
        update.add_argument(f"--{name}")
    for name in ("list", "stats", "status"):
        commands.add_parser(name)
    commands.add_parser("search").add_argument("--query", required=True)
    for name in ("activate", "remove", "use"):
        commands.add_parser(name).add_argument("--id", required=True)
    ask = commands.add_parser("ask", help="the settled answer in recorded polls (a Parquet table of ts, seq, text, thinking and url)")
    ask.add_argument("--question", required=True)
    ask.add_argument("--polls", required=True)
    ask.add_argument("--url")
    ask.add_argument("--id")
    storage = commands.add_parser("storage", help="what a cleanup would delete; nothing is deleted")
    storage.add_argument("--preserve-library", action="store_true")
    storage.add_argument("--dry-run", action="store_true")
    return parser


def _items(text: str | None) -> list[str] | None:
    return None if text is None else [x.strip() for x in text.split(",")] if text else []


def _ask(spark, library, args) -> int:
    """The target's settled answer, framed; 1 where there is no target or no answer."""
    from pyspark.sql import functions as F

    from quillstone.operators import answers, catalog

    request = spark.createDataFrame([("q", args.url, args.id)], "request_id string, url string, notebook_id string")
    target = answers.resolve_targets(request, library.notebooks(), library.state()).first()
    if target.status == "unknown id":
        print(f"no notebook with the id {args.id!r}")
        return 1
    if target.target is None:
        rows = catalog.render(library.list(), library.state()).collect()
        print("\n".join(["no target; choose one with --id or activate it:", *(f"  {r.id}: {r.title}" for r in rows)] if rows else ["the catalogue is empty; add a notebook first"]))
        return 1
    polls = spark.read.parquet(args.polls).filter(F.col("url") == target.target).withColumn("key", F.lit(1))
    polls = answers.before_deadline(polls.crossJoin(polls.agg(F.min("ts").alias("started"))), F.col("started"))
    found = answers.with_suffix(answers.stable(answers.usable(polls), answers.ONE_SHOT).select(F.col("text").alias("answer"))).first()
    if found is None:
        print("no answer")
        return 1
    print("\n".join([RULE, f"Question: {args.question}", RULE, "", found.answer, "", found.reminder, "", RULE]))
    return 0


def _status(spark, paths, now: str) -> int:
    """Whether there is saved state, its age, and what was saved with it."""
    from quillstone.operators import state

    there = os.path.exists(paths.state_file)
    modified = dt.datetime.fromtimestamp(os.path.getmtime(paths.state_file), dt.timezone.utc).replace(tzinfo=None) if there else None
    row = state.age(spark.createDataFrame([(modified,)], "modified_at timestamp_ntz"), now).first()
    print(f"authenticated: {'yes' if row.authenticated else 'no'}")
    if row.state_age_hours is not None:
        print(f"state age: {row.state_age_hours} hours ({row.status})")
    try:
        with open(paths.saved_info, encoding="utf-8") as f:
            print(f"saved at: {json.load(f)['authenticated_at_iso']}")
    except (OSError, ValueError, KeyError, TypeError):
        pass  # only informs
    print(f"state file: {paths.state_file}")
    return 0


def _storage(spark, paths, args) -> int:
    from quillstone.operators import storage
    from quillstone.sources import listing

    rows = storage.preserving(storage.items(listing.files(spark, paths.data).select("path", "size")), args.preserve_library)
    if args.dry_run:
        row = storage.dry_run(rows).first()
        print(f"would delete {row.would_delete} items and free {row.would_free} bytes")
    else:
        for r in storage.preview(rows).orderBy("title").collect():
            print(f"{r.title}: {r.n_items} items, {r.size_text}")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = _parser()
    args = parser.parse_args(argv)
    if not args.command:
        parser.print_help()
        return 1

    from pyspark.sql import SparkSession

    from quillstone.library import Library
    from quillstone.operators import catalog
    from quillstone.paths import Paths

    mine = SparkSession.getActiveSession() is None
    spark = SparkSession.builder.appName("quillstone").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    paths = Paths(args.data).make()
    library = Library(spark, paths.library)
    now = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None).isoformat(sep=" ")
    try:
        if args.command == "add":
            print(library.add(args.url, args.name, args.description, _items(args.topics), now, use_cases=_items(args.use_cases), tags=_items(args.tags)))
        elif args.command == "update":
            library.update(args.id, now, url=args.url, name=args.name, description=args.description, topics=_items(args.topics), use_cases=_items(args.use_cases), tags=_items(args.tags))
        elif args.command == "list":
            catalog.render(library.list(), library.state()).show(1000, False)
        elif args.command == "search":
            found = library.search(args.query)
            print(f"{catalog.search_count(found).first().n_results} found")
            found.select("id", "name", "description").show(1000, False)
        elif args.command == "stats":
            row = library.stats().first()
            print(f"notebooks: {row.total_notebooks}\ntopics: {row.total_topics}\nuses: {row.total_use_count}")
            for title, record in (("active", row.active_record), ("most used", row.most_used_record)):
                if record is not None:
                    print(f"{title}: {record.name} ({record.use_count} uses)")
            print(f"library: {row.library_path}")
        elif args.command == "ask":
            return _ask(spark, library, args)
        elif args.command == "status":
            return _status(spark, paths, now)
        elif args.command == "storage":
            return _storage(spark, paths, args)
        elif args.command == "remove":
            if not library.remove(args.id, now):
                print(f"no notebook with the id {args.id!r}")
                return 1
        else:
            getattr(library, args.command)(args.id, now)
    except ValueError as error:
        print(error)
        return 1
    finally:
        if mine:
            spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
