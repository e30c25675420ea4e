"""The command line: options, one project, a report, an exit code."""

from __future__ import annotations

import os
import sys
from collections.abc import Sequence
from dataclasses import dataclass, field

from .operators.audit import Options
from .report import HELP, NO_OPTION, NO_VALUE, error_message, exit_code, json_report, text_report
from .sources.files import read_json
from .sources.manifests import NOT_AN_OBJECT


@dataclass
class CliOptions:
    format: str = "text"
    check_all: bool = False
    check_peer: bool = False
    ignored: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    no_auto_detect: bool = False
    show_help: bool = False
    warnings: list[str] = field(default_factory=list)


SWITCHES = {
    "-t": ("format", "text"), "--text": ("format", "text"), "-j": ("format", "json"), "--json": ("format", "json"), "-a": ("check_all", True), "--all": ("check_all", True),
    "-p": ("check_peer", True), "--check-peer": ("check_peer", True), "-h": ("show_help", True), "--help": ("show_help", True), "--no-auto-detect": ("no_auto_detect", True),
}
LISTS = {"-i": ("--ignore", "ignored"), "--ignore": ("--ignore", "ignored"), "-e": ("--exclude", "exclude"), "--exclude": ("--exclude", "exclude")}


def parse_options(args: Sequence[str]) -> CliOptions:
    """Later switches win, lists grow, and what isn't known is a warning; words that are no options are passed over."""
    out, rest = CliOptions(), list(args)
    while rest:
        arg = rest.pop(0)
        if arg in SWITCHES:
            setattr(out, *SWITCHES[arg])
        elif arg in LISTS:
            flag, name = LISTS[arg]
            if not rest or rest[0].startswith("-"):
                out.warnings.append(NO_VALUE.format(flag=flag))
            else:
                getattr(out, name).extend(x for x in map(str.strip, rest.pop(0).split(",")) if x)
        elif arg.startswith("-"):
            out.warnings.append(NO_OPTION.format(arg=arg))
    return out


def main(args: Sequence[str] | None = None, root: str = ".") -> int:
    options = parse_options(sys.argv[1:] if args is None else args)
    if options.show_help:
        print(HELP)
        return 0
    for warning in options.warnings:
        print(f"warning: {warning}", file=sys.stderr)
    path = "./package.json" if root == "." else os.path.join(root, "package.json")
    value, error = read_json(path)
    if error is None and not isinstance(value, dict):
        error = {"type": "PARSE_ERROR", "path": path, "message": NOT_AN_OBJECT}
    if error:
        print(error_message(error), file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from .plans.projects import project_audit

    spark = SparkSession.builder.appName("tallgrass").getOrCreate()
    with project_audit(spark, {"project": root}, Options(options.check_all, options.check_peer, tuple(options.ignored)), options.exclude, not options.no_auto_detect) as report:
        result = report.first().asDict(recursive=True)
    print(json_report(result, options.ignored) if options.format == "json" else text_report(result, options.ignored, root))
    return exit_code(result)


if __name__ == "__main__":
    sys.exit(main())
