"""Command line: ``python -m metaseine FOLDER TERM…``. Exit status 0 with matches, 1 without, 2 for a search that can't be run, 130 for an interrupted one."""

from __future__ import annotations

import argparse
import os
import sys

from .functions.nodegraph import kind_name
from .operators.match import SearchError, SearchSpec


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="metaseine", description="Search what is written inside image and video files.")
    p.add_argument("folder")
    p.add_argument("terms", nargs="*", metavar="PATTERN")
    what = p.add_argument_group("what to find")
    what.add_argument("--not", dest="excluded", nargs="+", action="extend", default=[], metavar="PATTERN", help="leave out what has one of these")
    what.add_argument("--any", action="store_true", help="one of the patterns is enough")
    what.add_argument("--scope", choices=("image", "field", "node"), default="image", help="where all patterns must be")
    what.add_argument("--regex", action="store_true")
    what.add_argument("-s", "--case-sensitive", action="store_true")
    what.add_argument("--fields", nargs="+", default=[], metavar="NAME")
    what.add_argument("--only-connected", "--only_connected", action="store_true", help="leave out nodes that are wired to nothing")
    what.add_argument("--connected-mode", choices=("linked", "output"), help="linked: has a link; output: feeds an output")
    what.add_argument("--node-type", nargs="+", default=[], metavar="TYPE")
    what.add_argument("--input", nargs="+", default=[], metavar="NAME")
    what.add_argument("--saved-prompts", nargs="*", type=kind_name, metavar="KIND")
    what.add_argument("--broken", action="store_true", help="list files that can't be read")
    what.add_argument("--deep", action="store_true", help="also look behind the image data")
    where = p.add_argument_group("which files")
    where.add_argument("-r", "--recursive", action="store_true")
    where.add_argument("--ext", nargs="+", default=[])
    where.add_argument("--hidden", action="store_true")
    where.add_argument("--exclude-dir", nargs="+", action="extend", default=[], metavar="GLOB")
    where.add_argument("--since", metavar="WHEN")
    where.add_argument("--until", metavar="WHEN")
    where.add_argument("--follow-links", "--follow-symlinks", action="store_true")
    keep = p.add_argument_group("what to keep")
    keep.add_argument("--index", metavar="DIR", help="extracted metadata, for later searches")
    keep.add_argument("--results", metavar="DIR", help="log that a search can be resumed from")
    keep.add_argument("--no-resume", action="store_true", help="start the log afresh")
    keep.add_argument("--link-dir", metavar="DIR")
    keep.add_argument("--link-type", choices=("symlink", "hardlink", "copy", "auto"), default="auto")
    keep.add_argument("--flatten", choices=("name", "path"), default="name")
    keep.add_argument("--no-preserve-dates", action="store_true")
    show = p.add_argument_group("what to show")
    show.add_argument("-v", "--verbose", action="store_true")
    show.add_argument("--show", action="store_true", help="what made each image")
    show.add_argument("--errors", action="store_true", help="also list files that can't be read")
    kind = show.add_mutually_exclusive_group()
    kind.add_argument("--json", action="store_true")
    kind.add_argument("--csv", action="store_true")
    kind.add_argument("-0", "--null", action="store_true")
    return p.parse_args(args)


def specification(a: argparse.Namespace) -> SearchSpec:
    return SearchSpec(tuple(a.terms), tuple(a.excluded), a.regex, a.case_sensitive, "any" if a.any else "all", a.scope, tuple(a.fields), (a.connected_mode or "linked") if a.only_connected or a.connected_mode else None, tuple(a.node_type), tuple(a.input), None if a.saved_prompts is None else tuple(a.saved_prompts), a.broken, a.deep)


def main(args: list[str] | None = None, out=None) -> int:
    a, out = arguments(args), out or sys.stdout
    root = os.path.abspath(a.folder)
    try:
        spec = specification(a)
        if not os.path.isdir(root):
            raise SearchError(f"{root} is not a folder")
        inside = os.path.abspath(a.link_dir) if a.link_dir else None
        if inside and (inside == root or (a.recursive and inside.startswith(root + os.sep))):
            raise SearchError("links would land inside the folder that is searched")
        return _run(a, spec, root, out)
    except ValueError as x:
        print(f"metaseine: {x}", file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        from pyspark.sql import SparkSession

        if (spark := SparkSession.getActiveSession()) is not None:
            spark.sparkContext.cancelAllJobs()  # tasks that hang must not hold the exit up
        print("metaseine: interrupted", file=sys.stderr)
        return 130


def _run(a: argparse.Namespace, spec: SearchSpec, root: str, out) -> int:
    from pyspark.sql import SparkSession

    from .operators import scan, sinks
    from .sources.results_log import ResultsLog

    spark = SparkSession.builder.appName("metaseine").getOrCreate()
    log = ResultsLog(spark, a.results, {k: v for k, v in vars(a).items() if k not in ("results", "no_resume", "verbose", "errors", "json", "csv", "null")}, a.no_resume) if a.results else None
    before = log.hits().count() if log else 0
    tables = scan.scan(spark, root, spec, follow_links=a.follow_links, show=a.show, index=a.index, log=log, since=a.since, until=a.until, recursive=a.recursive, hidden=a.hidden, exclude=a.exclude_dir, ext=a.ext)
    counters = scan.report(tables).first().asDict()
    results = tables["results"]
    if a.link_dir:
        from .sources.state import written

        results = written(sinks.link_all(results, root, os.path.abspath(a.link_dir), a.link_type, a.flatten == "path", not a.no_preserve_dates))
    if a.json:
        sinks.write_json(results, counters, out, a.follow_links, a.show)
        out.write("\n")
    elif a.csv:
        sinks.write_csv(sinks.csv_rows(results, a.follow_links, a.show), out)
    elif a.null:
        sinks.write_paths(results, out, "\0")
    else:
        sinks.write_paths(results, out, verbose=a.verbose, show=a.show)
        out.write(f"{counters['matched']} of {counters['scanned']} files match\n")
        for r in tables["scanned"].where("error is not null").orderBy("path").toLocalIterator() if a.errors else ():
            out.write(f"unreadable: {r['path']}: {r['error']}\n")
        for r in scan.skipped_kinds(tables).orderBy("kind").collect():
            out.write(f"    {r['n']} skipped: {r['kind']}\n")
        for r in scan.error_kinds(tables, a.broken).orderBy("n", "kind", ascending=[False, True]).limit(3).collect():
            out.write(f"    {r['n']} {r['kind']}\n")
    return 0 if counters["matched"] or before else 1


if __name__ == "__main__":
    sys.exit(main())
