"""Byte figures and the sentences around them, tables for terminals."""

from __future__ import annotations

from collections import Counter


def plural(n: int) -> str:
    return "" if n == 1 else "s"


def _fixed(x: float) -> str:
    """One decimal, halves away from zero."""
    return f"{int(abs(x) * 10 + 0.5 + 1e-9) / 10:.1f}"


def share(amount: int, before: int) -> str:
    return _fixed(amount / before * 100 if before else 0)


def sign(saved: int) -> str:
    return "-" if saved >= 0 else "+"


def magnitude(amount: int, before: int, direction: str, more: bool = False) -> str:
    return f"{amount:,} {'more ' if more else ''}bytes ({direction}{share(amount, before)}%)"


def delta(saved: int, before: int, more: bool = False) -> str:
    size = magnitude(abs(saved), before, sign(saved), more)
    return f"save {size}" if saved >= 0 else f"grow by {size}"


def reduces(saved: int, before: int, more: bool = False) -> str:
    return f"Reduce duplication {'and' if saved >= 0 else 'but'} {delta(saved, before, more)}"


def reduced(before: int, after: int) -> str:
    saved = before - after
    verb = "saved" if saved >= 0 else "grew by"
    return f"Reduced duplication and {verb} {abs(saved):,} bytes ({before:,} → {after:,} bytes, {sign(saved)}{share(abs(saved), before)}%)"


def net(saved: int, before: int) -> str:
    return f"total: {sign(saved)}{abs(saved):,} bytes / {sign(saved)}{share(abs(saved), before)}%"


def size(amount: int) -> str:
    if amount >= 1_000_000:
        return f"{_fixed(amount / 1e6)} MB"
    kilo = _fixed(amount / 1000)
    return f"{amount:,} B" if kilo == "0.0" else f"{kilo} KB"


def savings_cell(saved: int, before: int, unavailable: bool = False) -> str:
    if unavailable:
        return "n/a"
    if not saved:
        return f"{size(0)} (0%)"
    return f"{sign(saved)}{size(abs(saved))} ({sign(saved)}{share(abs(saved), before)}%)"


def outcome(label: str, done: bool, shrinks: tuple[int, int], grows: tuple[int, int], before: int, flag: str = "", skip_flag: str = "", more: bool = False, note: str = "") -> list[str]:
    """Lines on how many sheets shrink and grow: (how many, by how much) each."""
    (n_shrink, shrunk), (n_grow, grown) = shrinks, grows
    verb, tail = ("Reduced", "") if done else ("Reduce", f" with `{flag}`")
    down, up = magnitude(shrunk, before, "-", more), magnitude(grown, before, "+", more)
    if n_shrink and n_grow:
        note = note or f" ({net(shrunk - grown, before)})"
        a, b = f"{n_shrink} file{plural(n_shrink)} by {down}", f"{n_grow} file{plural(n_grow)} by {up}"
        if done:
            return [f"* {label}: Reduced duplication, shrinking {a} and growing {b}{note}"]
        return [f"* {label}: Reduce duplication and shrink {a} but grow {b}{tail}{note}", f"  - Skip files that grow in size to save {magnitude(shrunk, before, '-')} in total with `{skip_flag}`"]
    if n_shrink:
        return [f"* {label}: {verb} duplication and {'saved' if done else 'save'} {down}{tail}{note}"]
    if n_grow:
        return [f"* {label}: {verb} duplication {'and grew' if done else 'but grow'} by {up}{tail}{note}"]
    return []


def short_labels(paths: list[str]) -> list[str]:
    """As few last parts of each path as tell it from the others."""
    parts = [p.split("/") for p in paths]
    depth = [1] * len(paths)
    while True:
        labels = ["/".join(x[-d:]) for x, d in zip(parts, depth, strict=True)]
        seen = Counter(labels)
        grow = [k for k, label in enumerate(labels) if seen[label] > 1 and depth[k] < len(parts[k])]
        if not grow:
            return labels
        for k in grow:
            depth[k] += 1


def table(header: list[str], rows: list[list[str]], wrap: int | None = None, width: int = 80, gutter: str = "  ", bold: list[set[int]] | None = None) -> list[str]:
    """Aligned lines; of each row, the cells in ``bold`` are printed so. The cells of column ``wrap`` are cut after a slash where the table would be
    wider than ``width``."""
    widths = [max(len(r[k]) for r in [header, *rows]) for k in range(len(header))]
    budget = None
    if wrap is not None:
        budget = max(8, width - sum(w for k, w in enumerate(widths) if k != wrap) - len(gutter) * (len(header) - 1))

        def tail(cell: str) -> str:
            return cell[cell.rfind("/", 0, budget + 1) + 1 :]

        least = max([len(header[wrap]), *(len(tail(r[wrap])) for r in rows)])
        widths[wrap] = max(least, min(widths[wrap], budget))

    def line(cells: list[str], strong: set[int] = frozenset()) -> str:
        padded = [c + " " * (w - len(c)) if k < len(cells) - 1 else c for k, (c, w) in enumerate(zip(cells, widths, strict=True))]
        return gutter.join(f"\x1b[1m{c}\x1b[22m" if k in strong else c for k, c in enumerate(padded)).rstrip()

    lines = [line(header)]
    for n, row in enumerate(rows):
        if wrap is not None and len(row[wrap]) > widths[wrap] and (cut := row[wrap].rfind("/", 0, budget + 1)) > 0:
            lines.append(row[wrap][: cut + 1])
            row = [*row[:wrap], row[wrap][cut + 1 :], *row[wrap + 1 :]]
        lines.append(line(row, bold[n] if bold else frozenset()))
    return lines
