"""One spelling for declarations that say the same: the key that duplicates are found by.

Quoted strings, url() and custom property names are taken out first and put back unchanged; the
steps between run in the order of ``_STEPS``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from decimal import Context

from .colors import same_colors
from .properties import one_name

SPACE = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# Units whose zero is a plain 0, and properties by how their values are read.
LENGTH_UNITS = (
    "px em rem ex rex ch rch ic ric cap rcap lh rlh vw svw lvw dvw vh svh lvh dvh vi svi lvi dvi vb svb lvb dvb vmin svmin"
    " lvmin dvmin vmax svmax lvmax dvmax cqw cqh cqi cqb cqmin cqmax cm mm in pt pc q fr"
).split()
PERCENT_ZERO_DIFFERS = {"height", "block-size", "max-height", "max-block-size", "flex-basis"}
ZERO_IS_NONE = {"border", "border-top", "border-right", "border-bottom", "border-left", "outline"}
CASE_COUNTS = set(
    """animation animation-name counter-reset counter-increment counter-set content container container-name
    view-transition-name timeline-scope scroll-timeline-name view-timeline-name anchor-name position-anchor position-try
    position-try-fallbacks list-style-type page grid grid-template grid-template-rows grid-template-columns
    grid-template-areas grid-row grid-column grid-area grid-row-start grid-row-end grid-column-start
    grid-column-end""".split()
)
FOUR_SIDES = {"margin", "padding", "inset", "border-width", "border-style", "border-color", "scroll-margin", "scroll-padding"}
TWO_SIDES = set(
    """margin-block margin-inline padding-block padding-inline inset-block inset-inline gap grid-gap border-spacing
    overflow overscroll-behavior place-items place-self""".split()
)
FONT_WEIGHTS = {"bold": "700", "normal": "400"}

_QUOTED = r""""(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'"""
_OPAQUE = re.compile(rf"""{_QUOTED}|url\(\s*(?:{_QUOTED}|(?:\\.|[^)\\])*)\s*\)|--[^\s,)]+""", re.I | re.S)
_HELD = re.compile("\ue000(\\d+)\ue000")
_SPACES = re.compile(f"[{SPACE}]+")
_INSIDE = re.compile(r"(?<=[(,]) | (?=[),])")
_SLASH = re.compile(" ?/ ?")
_PLUS = re.compile(r"(^|[\s(,])\+(?=[\d.])", re.A)
_DECIMAL = re.compile(r"(\d*)\.(\d+)", re.A)
_ZERO_LENGTH = re.compile(rf"(?<![\w.#])0(?:{'|'.join(LENGTH_UNITS)})\b", re.A | re.I)
_ZERO_PERCENT = re.compile(r"(?<![\w.#])0%(?!\w)", re.A)
_QUANTITY = re.compile(r"(?<![\w-])(-?(?:\d+(?:\.\d+)?|\.\d+))(ms|s|deg|grad|rad|turn)\b", re.A | re.I)
_EXACT = Context(prec=100_000, Emin=-999_999, Emax=999_999)


def trim(text: str) -> str:
    return text.strip(" \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff")


def split_top(text: str, separator: str, keep_empty: bool = False) -> list[str]:
    """Parts between separators that stand outside parentheses and comments."""
    parts, depth, begin = [], 0, 0
    for m in re.finditer(rf"/\*.*?(?:\*/|\Z)|[()]|{re.escape(separator)}", text, re.S):
        if m[0] == "(":
            depth += 1
        elif m[0] == ")":
            depth = max(0, depth - 1)
        elif m[0] == separator and not depth:
            parts.append(text[begin : m.start()])
            begin = m.end()
    parts.append(text[begin:])
    return parts if keep_empty else [p for p in parts if p]


def _times(number: str, factor: int, places: int = 0) -> str:
    """number * factor / 10**places, exactly; zero has no sign."""
    product = _EXACT.scaleb(_EXACT.multiply(_EXACT.create_decimal(number), factor), -places)
    return "0" if product.is_zero() else format(product, "f")


def same_units(value: str, aggressive: bool) -> str:
    """Seconds as milliseconds; with aggressive, angles as degrees (radians to six places)."""
    exact = {"s": (1000, 0), **({"grad": (9, 1), "turn": (360, 0)} if aggressive else {})}

    def one(m: re.Match) -> str:
        unit = m[2].lower()
        if unit in exact:
            return _times(m[1], *exact[unit]) + ("ms" if unit == "s" else "deg")
        if unit == "rad" and aggressive:
            return f"{float(m[1]) * (180 / math.pi):.6f}deg"
        return m[0]

    return _QUANTITY.sub(one, value)


def same_decimals(value: str) -> str:
    """No zeros that a decimal number can do without."""

    def one(m: re.Match) -> str:
        whole, part = m[1] or "0", m[2].rstrip("0")
        return f"{'' if whole == '0' else whole}.{part}" if part else whole

    return _DECIMAL.sub(one, value)


_CALL = re.compile(r"/\*.*?(?:\*/|\Z)|(?<![\w-])(?:min|max)\(|[()]", re.S | re.A | re.I)


def sorted_calls(value: str) -> str:
    """Arguments of min() and max(), whose order says nothing, in order; an unclosed call and what
    follows it stay."""
    open_calls: list[tuple[str, int, int]] = []  # head of the call, its start, and where its inside begins in done
    done: list[str] = []
    at = 0

    def last_to_be_kept() -> str | None:
        first = next((start for head, start, _ in open_calls if len(head) > 1), None)
        if first is None:
            return None
        mark = next(k for head, start, k in open_calls if len(head) > 1)
        return "".join(done[: mark - 1]) + value[first:]

    for m in _CALL.finditer(value):
        part = m[0]
        done.append(value[at : m.start()])
        at = m.end()
        if part.startswith("/*"):
            if not part.endswith("*/") or len(part) < 4:
                at = m.start()
                break
            done.append(part)
        elif part == ")":
            if not open_calls:
                done.append(part)
                continue
            head, _, mark = open_calls.pop()
            if len(head) > 1:
                inside = "".join(done[mark:])
                done[mark:] = [",".join(sorted(split_top(inside, ",", keep_empty=True)))]
            done.append(part)
        elif part == "(" and not any(len(head) > 1 for head, _, _ in open_calls):
            done.append(part)  # only inside min() and max() does a bracket count
        else:
            done.append(part)
            open_calls.append((part, m.start(), len(done)))
    kept = last_to_be_kept()
    return kept if kept is not None else "".join(done) + value[at:]


_REPEATS = {4: 1, 3: 0, 2: 0}


def _shortest(tokens: list[str]) -> list[str]:
    """Without the last values that the sides' rule of omission gives anyway."""
    while len(tokens) in _REPEATS and tokens[-1] == tokens[_REPEATS[len(tokens)]]:
        tokens = tokens[:-1]
    return tokens


def same_sides(prop: str, value: str) -> str:
    if prop == "border-radius":
        axes = [" ".join(_shortest(split_top(trim(axis), " "))) for axis in value.split("/")]
        return axes[0] if len(axes) == 2 and axes[0] == axes[1] else "/".join(axes)
    tokens = split_top(value, " ") if prop in FOUR_SIDES or prop in TWO_SIDES else []
    most = 4 if prop in FOUR_SIDES else 2
    return " ".join(_shortest(tokens)) if 2 <= len(tokens) <= most else value


def _case(prop: str, value: str, aggressive: bool) -> str:
    return value if prop in CASE_COUNTS else value.lower()


def _colors(prop: str, value: str, aggressive: bool) -> str:
    return value if prop in CASE_COUNTS else same_colors(value, aggressive)


_STEPS: list[Callable[[str, str, bool], str]] = [
    lambda prop, v, a: _SPACES.sub(" ", v),
    _case,
    lambda prop, v, a: _SLASH.sub("/", _INSIDE.sub("", v)),
    lambda prop, v, a: _PLUS.sub(r"\1", v),
    _colors,
    lambda prop, v, a: FONT_WEIGHTS.get(v, v) if prop == "font-weight" else v,
    lambda prop, v, a: same_decimals(v),  # first, so that 0.0px is a zero but 1.0px is not
    lambda prop, v, a: _ZERO_LENGTH.sub("0", v),
    lambda prop, v, a: v if prop in PERCENT_ZERO_DIFFERS else _ZERO_PERCENT.sub("0", v),
    lambda prop, v, a: same_decimals(same_units(v, a)),
    lambda prop, v, a: sorted_calls(v),
    lambda prop, v, a: same_sides(prop, v),
]


def one_value(prop: str, value: str, aggressive: bool = False) -> str:
    """The value's one spelling under a property; custom properties' values are only trimmed."""
    name, value = one_name(prop, aggressive), trim(value)
    if name.startswith("--"):
        return value
    held: list[str] = []

    def hold(m: re.Match) -> str:
        held.append(m[0])
        return f"\ue000{len(held) - 1}\ue000"

    value = _OPAQUE.sub(hold, value)
    for step in _STEPS:
        value = step(name, value, aggressive)
    value = _HELD.sub(lambda m: held[int(m[1])], value)
    return "none" if name in ZERO_IS_NONE and value == "0" else value


def declaration_key(prop: str, value: str, important: bool, aggressive: bool = False) -> str:
    return f"{one_name(prop, aggressive)}: {one_value(prop, value, aggressive)}{' !important' if important else ''}"
