"""Command line: report on style sheets, or consolidate them in place."""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from .functions.values import declaration_key
from .operators.consolidate import dedup
from .operators.detect import analyze
from .operators.report import MODES, report
from .plans import prose
from .plans.options import Options
from .sources.sheets import STDIN, expand_targets, portable, read_files, replace_file

CONFIG = "sheetloom.config.json"
HEADER = ["Findings -f (-a)", "Savings with: -f", "-f -s", "-f -a", "-f -a -s"]
LEGEND = "Legend: -f: --fix, -a: --aggressive, -s: --savings-only"


class SetupError(Exception):
    """Something that the user can put right."""


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("sheetloom", description="Find (and optionally consolidate) duplicate CSS declarations.", allow_abbrev=False)
    p.add_argument("file", nargs="*", help="CSS files or folders; - reads from STDIN")
    p.add_argument("-f", "--fix", action="store_true", help="consolidate what is safe, in place (STDIN: to STDOUT)")
    p.add_argument("-a", "--aggressive", action="store_true", help="with --fix: also merges that are probably safe")
    p.add_argument("-s", "--savings-only", action="store_true", help="with --fix: leave files that would grow")
    p.add_argument("-i", "--ignore-selector", action="append", default=[], metavar="PATTERN", help="selectors to leave out (repeatable)")
    p.add_argument("-p", "--ignore-path", action="append", default=[], metavar="PATTERN", help="paths to leave out (repeatable)")
    p.add_argument("-n", "--no-ignore-selectors-defaults", action="store_true", help="do not leave out vendor pseudo-elements and hacks")
    p.add_argument("-z", "--exit-zero", action="store_true", help="status 0 whatever is found or skipped")
    p.add_argument("-e", "--no-exit-zero", action="store_true", help="overrule exitZero of the configuration")
    p.add_argument("-q", "--quiet", action="store_true", help="summaries only")
    p.add_argument("-c", "--config", help=f"configuration file (default: {CONFIG}, if there is one)")
    return p


def parse_args(argv: list[str]) -> argparse.Namespace:
    p = parser()
    names = {o[2:] for a in p._actions for o in a.option_strings if o.startswith("--")}
    for arg in argv:
        if re.match(r"-[^-]", arg) and arg[1:] in names:
            raise SetupError(f"Unknown option `{arg}`. Did you mean `-{arg}`?")
    args = p.parse_args(argv)
    if not args.file:
        p.print_help()
        raise SystemExit(1)
    if STDIN in args.file and len(args.file) > 1:
        raise SetupError("Cannot combine STDIN (`-`) with other file arguments.")
    for flag, why in (("savings_only", "report mode doesn’t write"), ("aggressive", "report mode already shows both variants")):
        if getattr(args, flag) and not args.fix:
            raise SetupError(f"`--{flag.replace('_', '-')}` only applies together with `--fix` ({why})")
    return args


def load_config(path: str | None) -> dict:
    """The configuration; a default one may be missing, a named one may not."""
    if not path and not os.path.exists(CONFIG):
        return {}
    try:
        with open(path or CONFIG, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError) as e:
        raise SetupError(f"Could not load config file {os.path.abspath(path or CONFIG)}: {e}") from e


def _patterns(flag: str, given: list[str], configured: list[str]) -> tuple[str, ...]:
    for pattern in given:
        try:
            re.compile(pattern)
        except re.error as e:
            raise SetupError(f"Invalid `{flag}` pattern `{pattern}`: {e}") from e
    return (*configured, *(f"(?i){p}" for p in given))


def settings(args: argparse.Namespace, config: dict) -> tuple[Options, tuple[str, ...], bool]:
    """Options, ignored paths and whether findings are forgiven; flags lie over the configuration."""
    options = Options(
        args.aggressive or config.get("aggressive", False),
        args.savings_only or config.get("savingsOnly", False),
        _patterns("--ignore-selector", args.ignore_selector, config.get("ignoreSelectors", [])),
        not args.no_ignore_selectors_defaults and config.get("ignoreSelectorsDefaults", True),
        config.get("fence", "document"),
    )
    zero = not args.no_exit_zero and (args.exit_zero or config.get("exitZero", False))
    return options, _patterns("--ignore-path", args.ignore_path, config.get("ignorePaths", [])), zero


def _scope(label: str) -> str:
    return "(root)" if label == "root" else label


def _respelt(key: str) -> str:
    base, _, important = key.partition(" !important")
    prop, found, value = base.partition(": ")
    return declaration_key(prop, value, bool(_ or important), True) if found else key


def _skipped_lines(skipped: list[Row], aggressive: set[tuple[str, str]] | None) -> list[str]:
    if not skipped:
        return []
    lines = [f"{len(skipped)} duplicate group{prose.plural(len(skipped))} considered unsafe to auto-merge:"]
    for s in skipped:
        still = aggressive is None or (s.scope, s.key) in aggressive or (s.scope, _respelt(s.key)) in aggressive
        lines.append(f"  {_scope(s.scope)}  {s.key}—{s.reason}{'' if still else ' (may merge with `--aggressive`)'}")
    return [*lines, ""]


def _finding_lines(found: list[Row]) -> list[str]:
    lines, by_scope = [], {}
    for f in found:
        by_scope.setdefault(f.scope, []).append(f)
    for scope, own in by_scope.items():
        lines.append(_scope(scope))
        for f in own:
            first = f.occurrences[0]
            if f.kind == "repeated":
                lines += [f"  repeated    {f.key}", *(f"    line {o.line}" for o in f.occurrences)]
            elif f.kind == "redundant":
                lines.append(f"  redundant   {first.prop}: {first.value}  {first.selector} (line {first.line})")
            else:
                lines += [f"  duplicate   {first.prop}: {first.value}", *(f"    {o.selector} (line {o.line})" for o in f.occurrences)]
        lines.append("")
    return lines


def _cells(row: Row | dict) -> list[str]:
    return [f"{row['n_default']} ({row['n_aggressive']})", *(prose.savings_cell(row[m]["saved"], row[m]["before"], row[m]["unavailable"]) for m in MODES)]


def _best(row: Row | dict) -> set[int]:
    """The cells of the ways that save most, of those that do anything; none if the best grows."""
    able = {k: row[m]["saved"] for k, m in enumerate(MODES, 1) if not row[m]["unavailable"]}
    best = max(able.values(), default=-1)
    return {k for k, saved in able.items() if saved == best >= 0}


def _table(header: list[str], rows: list[list[str]], of: list[Row | dict], wrap: int | None = None) -> list[str]:
    """The best ways are marked where a terminal can show it."""
    shift = len(header) - len(HEADER)
    return prose.table(header, rows, wrap=wrap, bold=[{k + shift for k in _best(r)} for r in of] if sys.stdout.isatty() else None)


def _excerpt(css: str, message: str) -> list[str]:
    """The line that a message speaks of, with a mark under its column."""
    place = re.search(r"\(line (\d+), column (\d+)\)$", message)
    lines = css.split("\n")
    if not place or int(place[1]) > len(lines):
        return []
    number, column = place[1], int(place[2])
    return [f"  {number} | {lines[int(number) - 1].rstrip()[:200]}", f"  {' ' * len(number)} | {' ' * (column - 1)}^"]


def _by_sheet(rows: list[Row]) -> dict[int, list[Row]]:
    found: dict[int, list[Row]] = {}
    for r in rows:
        found.setdefault(r.sheet_id, []).append(r)
    return found


def run_report(sheets, options: Options, names: dict[int, str], quiet: bool, errors: dict[int, str]) -> tuple[bool, list[str]]:
    """(did any sheet have findings, lines). The driver gets slim rows only, in path order."""
    rows = {r.sheet_id: r for r in report(sheets, options).collect()}
    found, skipped, harder = {}, {}, {}
    if not quiet:
        for mode in (False, True):
            o = replace(options, aggressive=mode, savings_only=False)
            for k, own in _by_sheet(analyze(sheets, o).orderBy("sheet_id", "finding_seq").collect()).items():
                found.setdefault(k, own)  # those of the default mode, if there are any
            for r in dedup(sheets, o, with_css=False).select("sheet_id", "skipped").collect():
                (harder if mode else skipped)[r.sheet_id] = r.skipped or []
    lines, failed, stats = [], False, []
    for k, name in names.items():
        if len(names) > 1 and lines:
            lines.append("")
        if len(names) > 1 and not quiet:
            lines.append(name)
        if k in errors:
            continue
        row = rows[k]
        stats.append((name, row))
        if not row["n_default"] and not row["n_aggressive"]:
            lines.append("No duplicate declarations found.")
            continue
        if not quiet:
            lines += _finding_lines(found.get(k, []))
            lines += _skipped_lines(skipped.get(k, []), {(s.scope, s.key) for s in harder.get(k, [])})
        lines += [f"Summary for {name}:", *_table(HEADER, [_cells(row)], [row]), LEGEND]
        failed |= row["n_default"] > 0
    if len(names) > 1:
        lines += ["", f"Summary for all files:{_errored(len(names) - len(stats))}"]
        table = [[label, *_cells(row)] for label, (_, row) in zip(prose.short_labels([n for n, _ in stats]), stats, strict=True)]
        if stats:
            total = {f"n_{m}": sum(r[f"n_{m}"] for _, r in stats) for m in ("default", "aggressive")}
            for m in MODES:
                total[m] = {"before": sum(r["default"]["before"] for _, r in stats), "saved": sum(r[m]["saved"] for _, r in stats), "unavailable": all(r[m]["unavailable"] for _, r in stats)}
            table.append(["Total", *_cells(total)])
        of = [row for _, row in stats] + ([total] if stats else [])
        lines += [*_table(["File", *HEADER], table, of, wrap=0), LEGEND]
    return failed, lines


def _errored(n: int) -> str:
    return f" ({n} file{prose.plural(n)} could not be processed; see errors above)" if n else ""


def run_fix(sheets, options: Options, names: dict[int, str], quiet: bool, errors: dict[int, str]) -> tuple[bool, list[str], str | None]:
    """(was anything skipped or withheld, lines, the sheet itself if it came from STDIN)."""
    # texts stay with the executors; the driver gets their hashes, and one text at a time to write
    done = dedup(sheets, options).persist(StorageLevel.DISK_ONLY)
    slim = lambda d: {r.sheet_id: r for r in d.withColumn("css_out", F.xxhash64("css_out")).collect()}
    rows, others = slim(done), slim(dedup(sheets, replace(options, aggressive=not options.aggressive)))
    piped = [k for k, name in names.items() if name == "(stdin)"]
    texts = done.where(F.col("sheet_id").isin(piped) | (F.size("applied") > 0)).select("sheet_id", "css_out")
    lines, failed, output, stats = [], False, None, []
    for r in texts.toLocalIterator():
        if r.sheet_id in piped:
            output = r.css_out
        else:
            replace_file(names[r.sheet_id], r.css_out)
    done.unpersist()
    for k, name in names.items():
        if len(names) > 1 and lines:
            lines.append("")
        if len(names) > 1 and not quiet:
            lines.append(name)
        if k in errors:
            continue
        r, other = rows[k], others[k]
        n, stdin = len(r.applied), name == "(stdin)"
        preview = None if options.aggressive else other
        if not quiet:
            lines += _skipped_lines(r.skipped, {(s.scope, s.key) for s in preview.skipped} if preview else None)
        lines.append(f"Summary for {name}:" if len(names) > 1 else "Summary:")
        if r.withheld:
            lines.append(f"* 0 declarations consolidated, {r.withheld['count']} withheld: `savingsOnly` left this file untouched—consolidating would {prose.delta(r.withheld.saved, r.withheld.before)}")
        else:
            lines.append(f"* {n} declaration{prose.plural(n)} consolidated" + (f": {prose.reduced(r.bytes.before, r.bytes.after)}" if n else ""))
        if n:
            # These sentences are part of the output that scripts match.
            if r.bytes.saved < 0:
                lines.append("* Worth it for maintainability (each declaration used once); skip `--fix` here if you care more about transfer size.")
            if options.aggressive and r.css_out != other.css_out:
                only = max(0, n - len(other.applied))
                share = f"{only} of these merges {'is' if only == 1 else 'are'}" if only else "Some of these merges are"
                lines.append(f"* {share} aggressive-only—probably, but not provably, safe. Review the diff and test the affected pages.")
            if not stdin:
                lines.append(f"* Wrote {name}")
            if r.source_map_stale:
                lines.append(f"* {'This style sheet' if stdin else name} references a source map (`sourceMappingURL`); `--fix` doesn’t regenerate it, so the map no longer describes this file and should be rebuilt.")
        if r.skipped:
            lines.append(f"* {len(r.skipped)} finding{prose.plural(len(r.skipped))} skipped (considered unsafe to auto-merge)")
        differs = bool(preview) and preview.css_out != r.css_out
        extra, extra_saved = (len(preview.applied) - n, preview.bytes.saved - r.bytes.saved) if differs else (0, 0)
        if differs:
            label = f"{extra} more declaration{prose.plural(extra)}" if extra > 0 else "Further consolidation"
            lines.append(f"* {label} in aggressive mode: {prose.reduces(extra_saved, r.bytes.before, True)} with `--fix --aggressive` ({prose.net(preview.bytes.saved, r.bytes.before)})")
        failed |= bool(r.skipped) or r.withheld is not None
        stats.append((r, differs, extra, extra_saved))
    if len(names) > 1:
        lines += ["", f"Summary for all files:{_errored(len(names) - len(stats))}", *_overall(stats)]
    return failed, lines, output


def _overall(stats: list[tuple[Row, bool, int, int]]) -> list[str]:
    before = sum(r.bytes.before for r, *_ in stats)

    def split(values: list[int]) -> tuple[tuple[int, int], tuple[int, int]]:
        down, up = [v for v in values if v > 0], [-v for v in values if v < 0]
        return (len(down), sum(down)), (len(up), sum(up))

    applied, skipped = sum(len(r.applied) for r, *_ in stats), sum(len(r.skipped) for r, *_ in stats)
    shrinks, grows = split([r.bytes.saved for r, *_ in stats])
    lines = prose.outcome(f"{applied} declaration{prose.plural(applied)} consolidated", True, shrinks, grows, before)
    if skipped:
        lines.append(f"* {skipped} finding{prose.plural(skipped)} skipped (considered unsafe to auto-merge)")
    held = [r.withheld for r, *_ in stats if r.withheld]
    if held:
        growth = sum(abs(w.saved) for w in held)
        lines.append(f"* {len(held)} file{prose.plural(len(held))} left untouched by `--savings-only`—consolidating would have made {'it' if len(held) == 1 else 'them'} {growth:,} bytes ({prose.share(growth, before)}% overall) bigger in total")
    further = [(extra, saved) for _, differs, extra, saved in stats if differs]
    if further:
        more = sum(e for e, _ in further)
        down, up = split([s for _, s in further])
        label = f"{more} more declaration{prose.plural(more)}" if more > 0 else "Further consolidation"
        total = shrinks[1] - grows[1] + down[1] - up[1]
        lines += prose.outcome(f"{label} in aggressive mode", False, down, up, before, "--fix --aggressive", "--fix --aggressive --savings-only", True, f" ({prose.net(total, before)})")
    return lines


def main(argv: list[str] | None = None, spark: SparkSession | None = None, stdin: str | None = None) -> int:
    """The exit status: 1 where something was found (report), skipped or withheld (fix), unless that
    is forgiven, and wherever a file could not be read, parsed or taken."""
    try:
        args = parse_args(sys.argv[1:] if argv is None else argv)
        options, ignored, zero = settings(args, load_config(args.config))
        try:
            targets = expand_targets(args.file, ignored)
        except OSError as e:
            raise SetupError(str(e)) from e
    except SetupError as e:
        print(e, file=sys.stderr)
        return 1
    for path in targets.unsupported:
        print(f"Skipped {path}: not a `.css` file; point at the compiled style sheet rather than at a preprocessor source.", file=sys.stderr)
    if not targets.files:
        named, n = ", ".join(args.file), targets.discovered
        print(f"All {n} `.css` file{prose.plural(n)} found under {named} {'was' if n == 1 else 'were'} excluded by `--ignore-path`/`ignorePaths`." if n else f"No `.css` files found under {named}.", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("sheetloom").getOrCreate()
    sheets = read_files(spark, targets.files, stdin).cache()
    names = {k: "(stdin)" if p == STDIN else portable(p) for k, p in enumerate(targets.files)}
    errors = {r.sheet_id: f"Could not read {names[r.sheet_id]}: {r.error}" for r in sheets.where("error IS NOT NULL").select("sheet_id", "error").collect()}
    good = sheets.where("error IS NULL")
    unread = dict(errors)
    errors |= {r.sheet_id: f"{names[r.sheet_id]}: {r.error}" for r in dedup(good, replace(options, savings_only=False), with_css=False).where("error IS NOT NULL").select("sheet_id", "error").collect()}
    broken = good.where(good.sheet_id.isin([k for k in errors if k not in unread])).select("sheet_id", "css")
    excerpts = {r.sheet_id: _excerpt(r.css, errors[r.sheet_id]) for r in broken.toLocalIterator()} if errors.keys() - unread.keys() else {}
    for k in sorted(errors):
        print("\n".join([errors[k], *excerpts.get(k, [])]), file=sys.stderr)
    good = good.where(~good.sheet_id.isin(list(errors))) if errors else good
    if args.fix:
        failed, lines, output = run_fix(good, options, names, args.quiet, errors)
        if output is not None:
            sys.stdout.write(output)
        print("\n".join(lines), file=sys.stderr if output is not None else sys.stdout)
    else:
        failed, lines = run_report(good, options, names, args.quiet, errors)
        print("\n".join(lines))
    return int(bool(errors) or bool(targets.unsupported) or failed and not zero)


if __name__ == "__main__":
    sys.exit(main())
