"""Command line: python -m lookalike <command>. Everything that changes files is a dry run without --execute."""

from __future__ import annotations

import argparse
import sys

from . import checks
from .functions.scalars import dotted
from .plans.execute import stamp
from .schema import DEFAULT_THRESHOLD, PIPELINE_STEPS

COMMANDS = ["duplicates", "move-to-parent", "move", "rename", "sort", "fix-extensions", "convert", "metadata", "cleanup", "repair", "pipeline"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lookalike")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, **options) -> argparse.ArgumentParser:
        s = sub.add_parser(name, **options)
        s.add_argument("directory")
        s.add_argument("--execute", action="store_true", help="change files")
        s.add_argument("--no-recursive", action="store_true")
        return s

    s = command("duplicates", help="find duplicates, report, export, act")
    s.add_argument("--threshold", type=int, default=DEFAULT_THRESHOLD)
    s.add_argument("--exact-only", action="store_true")
    s.add_argument("--perceptual-only", action="store_true")
    s.add_argument("--no-cache", action="store_true")
    s.add_argument("--index", choices=["auto", "always", "never"], default="auto")
    s.add_argument("--strategy", default="quality")
    s.add_argument("--recall", type=float, help="share of the pairs at the threshold that the index finds at least")
    s.add_argument("--resolve", action="store_true", help="files that symbolic links lead to count once")
    s.add_argument("--export")
    s.add_argument("--format", choices=["txt", "csv", "json"], default="txt")
    s.add_argument("--action", choices=["delete", "move", "hardlink", "symlink"])
    s.add_argument("--trash")
    command("move-to-parent").add_argument("--extensions", nargs="*")
    s = command("move")
    s.add_argument("destination")
    s.add_argument("--overwrite", action="store_true")
    s = command("rename")
    s.add_argument("--by", choices=["random", "parent"], default="random")
    s.add_argument("--length", type=int, default=12)
    s.add_argument("--extensions", nargs="*")
    s = command("sort")
    s.add_argument("--by", choices=["alpha", "dominant", "bw", "palette", "analyze", "resolution"], default="alpha")
    s.add_argument("--copy", action="store_true")
    s.add_argument("--colors", type=int, default=3)
    command("fix-extensions")
    s = command("convert")
    s.add_argument("--delete-originals", action="store_true")
    s.add_argument("--quality", type=int, default=95)
    s = command("metadata")
    s.add_argument("--what", choices=["exif", "dates"], default="dates")
    s.add_argument("--start", type=stamp, required=True)
    s.add_argument("--end", type=stamp, required=True)
    command("cleanup")
    command("repair").add_argument("--trash", required=True)
    s = command("pipeline")
    s.add_argument("--steps", nargs="+", choices=PIPELINE_STEPS, required=True)
    s.add_argument("--start", type=stamp)
    s.add_argument("--end", type=stamp)
    s.add_argument("--trash")
    s.add_argument("--delete-originals", action="store_true")
    return p


def parse(argv: list[str]) -> argparse.Namespace:
    """A path alone means duplicates."""
    return parser().parse_args(argv if argv and (argv[0] in COMMANDS or argv[0].startswith("-")) else ["duplicates", *argv])


def run(args: argparse.Namespace, spark) -> int:
    from .config import Config
    from .engine import Engine
    from .operators import reports
    from .plans import dates, execute, moves
    from .sources import analyze, files

    problem = checks.directory(args.directory)
    if problem:
        print(problem, file=sys.stderr)
        return 1
    engine, root, dry, deep = Engine(spark, cache=f"file://{Config().path('cache')}"), args.directory, not args.execute, not args.no_recursive
    if dry:
        print("Dry run: nothing is changed.")

    def show(outcome) -> int:
        counts = {r["status"]: r["n"] for r in reports.status_counts(outcome).collect()}
        print(", ".join(f"{k}: {v}" for k, v in sorted(counts.items())) or "nothing to do")
        for r in outcome.filter("status = 'error'").limit(5).collect():
            print("  ", r.asDict().get("src") or r.asDict().get("path"), r["error"])
        return 1 if counts.get("error") else 0

    if args.command == "duplicates":
        found = engine.scan(root, args.threshold, args.exact_only, args.perceptual_only, deep, not args.no_cache, {"auto": None, "always": True, "never": False}[args.index], args.strategy, target_recall=args.recall, resolve=args.resolve)
        print(reports.console(found.members))
        if args.export:
            engine.export(found, args.export, args.format)
        return show(engine.act(found, args.action, args.trash, dry)) if args.action else 0
    if args.command == "move-to-parent":
        return show(engine.run(moves.move_to_parent(engine.listing(root), root, dotted(args.extensions)), dry))
    if args.command == "move":
        there = engine.listing(args.destination) if not checks.directory(args.destination) else spark.createDataFrame([], "path string")
        outcome = engine.run(moves.move_with_structure(engine.listing(root, deep), root, args.destination, there, args.overwrite), dry)
        code = show(outcome)
        engine.clean_folders(root, dry)
        return code
    if args.command == "rename":
        listing = engine.listing(root, deep)
        return show(engine.run(moves.rename_by_parent(listing, root) if args.by == "parent" else moves.rename_random(listing, args.length, extensions=dotted(args.extensions)), dry))
    if args.command == "sort":
        listing = engine.listing(root, False)
        if args.by == "alpha":
            return show(engine.run(moves.sort_alphabetical(listing, root), dry))
        contents = files.images(spark, root, False, content=True)
        if args.by == "resolution":
            return show(engine.run(moves.sort_by_resolution(analyze.analyze(contents, False, False), root, args.copy), dry))
        seen = analyze.colors(contents, args.colors if args.by == "palette" else 1).filter("r is not null")
        if args.by == "analyze":
            print({r["color"]: r["n"] for r in moves.color_counts(seen).collect()})
            return 0
        return show(engine.run(moves.sort_by_color(seen, root, args.by, args.copy), dry))
    if args.command == "fix-extensions":
        return show(engine.run(moves.fix_extensions(analyze.true_formats(files.files(spark, root, None, deep, content=True))), dry))
    if args.command == "convert":
        return show(engine.run(moves.convert_to_jpg(engine.listing(root, deep), args.delete_originals), dry, args.quality))
    if args.command == "metadata":
        listing = engine.listing(root, deep)
        if args.what == "exif":
            return show(execute.set_exif_dates(dates.randomize_exif_dates(listing, args.start, args.end), dry))
        return show(execute.set_times(dates.randomize_dates(listing, args.start, args.end), dry))
    if args.command == "cleanup":
        return show(engine.clean_folders(root, dry))
    if args.command == "repair":
        return show(engine.repair(root, args.trash, dry_run=dry))
    for step, outcome in engine.pipeline(root, args.steps, args.start, args.end, delete_originals=args.delete_originals, trash=args.trash, dry_run=dry).items():
        print(step)
        show(outcome)
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parse(sys.argv[1:] if argv is None else argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("lookalike").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return run(args, spark)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
