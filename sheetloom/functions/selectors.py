"""Selector lists, and when two selectors cannot match one element.

A selector is cut into the tokens of CSS Syntax, tokens are grouped to compounds (what stands between
combinators), and a compound's nodes are attribute selectors and everything else. All that is told
about selectors is told from those nodes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

_COMMENT = re.compile(r"/\*(?:[^*]|\*(?!/))*(?:\*/)?")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"(?:[\w-]|[^\x00-\x7f])+", re.A)
_IDENTIFIER = re.compile(r"(?:--|-?(?:[^\W\d]|[^\x00-\x7f]))(?:[\w-]|[^\x00-\x7f])*|-", re.A)
#: Names and marks alone: no lists, spaces, brackets, strings, comments or escapes.
_PLAIN = re.compile(r"[\w.#:>+~*-]+", re.A)
_HEX = re.compile("[0-9a-fA-F]{1,6}")
# Selectors that are left out of comparisons: vendor pseudo-elements and old hacks.
DEFAULT_IGNORED = (r"(?i)::?-(?:moz|webkit|ms|o)-", r"(?i)\*\s*html", r"(?i)\*\s*\+\s*html")
#: How an attribute selector may compare, by the character before the equals sign.
_COMPARES = "~|^$*"


@dataclass(frozen=True)
class Token:
    """kind: name, space, string, comment, escape or mark (any other character)."""

    kind: str
    text: str


def _escape_end(text: str, at: int) -> int:
    """Where the escape ends whose backslash stands at ``at``."""
    if digits := _HEX.match(text, at + 1):
        end = digits.end()
        return end + 1 if text[end : end + 1] in (" ", "\t", "\n", "\r", "\f") else end
    return min(at + 2, len(text))


def _string_end(text: str, at: int) -> int:
    quote, end = text[at], at + 1
    while end < len(text) and text[end] != quote:
        end = _escape_end(text, end) if text[end] == "\\" else end + 1
    return min(end + 1, len(text))


def tokens(text: str) -> Iterator[Token]:
    at = 0
    while at < len(text):
        c = text[at]
        if c in "\"'":
            kind, end = "string", _string_end(text, at)
        elif c == "\\":
            kind, end = "escape", _escape_end(text, at)
        elif m := _COMMENT.match(text, at):
            kind, end = "comment", m.end()
        elif m := _SPACE.match(text, at):
            kind, end = "space", m.end()
        elif m := _NAME.match(text, at):
            kind, end = "name", m.end()
        else:
            kind, end = "mark", at + 1
        yield Token(kind, text[at:end])
        at = end


def unescape(text: str) -> str:
    """Escapes as the characters that they stand for."""
    parts, at = [], 0
    while (slash := text.find("\\", at)) >= 0 and slash + 1 < len(text):
        end = _escape_end(text, slash)
        parts.append(text[at:slash])
        if digits := _HEX.match(text, slash + 1):
            code = int(digits[0], 16)
            parts.append(chr(code) if 0 < code <= 0x10FFFF else "�")
        else:
            parts.append(text[slash + 1 : end])
        at = end
    return "".join(parts) + text[at:]


# -- lists
@dataclass(frozen=True)
class SelectorList:
    selectors: tuple[str, ...]
    key: str
    spaced: bool | None  # does white space follow the first comma


@lru_cache(1 << 15)
def _list(text: str) -> SelectorList:
    if _PLAIN.fullmatch(text):  # one selector, spelt as its key
        return SelectorList((text,), text, None)
    members: list[list[Token]] = [[]]
    depth, spaced, after_comma = 0, None, False
    for token in tokens(text):
        if after_comma and spaced is None:
            spaced = token.kind == "space"
        after_comma = False
        if token.kind == "mark":
            if token.text == "," and not depth:
                members.append([])
                after_comma = True
                continue
            depth = depth + 1 if token.text in "([" else max(0, depth - 1) if token.text in ")]" else depth
        members[-1].append(token)
    if len(members) > 1 and spaced is None:
        spaced = False
    written = ["".join(t.text for t in m).strip() for m in members]
    keys = ["".join(t.text if t.kind == "string" else _SPACE.sub(" ", t.text) for t in m).strip() for m in members]
    if not written[-1]:
        written.pop(), keys.pop()
    return SelectorList(tuple(written), ",".join(sorted(keys)), spaced)


def split_list(text: str) -> list[str]:
    return list(_list(text).selectors)


def spaced_comma(text: str) -> bool | None:
    return _list(text).spaced


def list_key(text: str) -> str:
    """The list whatever the order of its selectors and its white space."""
    return _list(text).key


@lru_cache(64)
def _searches(patterns: tuple[str, ...]) -> list:
    return [re.compile(p).search for p in patterns]


@lru_cache(1 << 15)
def ignored(selector: str, patterns: tuple[str, ...]) -> bool:
    return any(search(selector) for search in _searches(patterns))


# -- one selector
@dataclass(frozen=True)
class Attribute:
    name: str
    op: str | None
    value: str | None
    flag: str | None
    binds: bool = False  # its element stands in a fixed relation to the selector's subject


@dataclass
class Compound:
    """Nodes between two combinators: attribute selectors and other tokens, each with its depth in
    parentheses; and the combinator behind (a blank for descendants; empty after the last)."""

    nodes: list[tuple[Token | Attribute, int]] = field(default_factory=list)
    combinator: str = ""

    @property
    def one_element(self) -> bool:
        """It begins with html or :root, of which a document has one."""
        marks = [n.text.lower() for n, _ in self.nodes[:2] if isinstance(n, Token)]
        return marks[:1] == ["html"] or marks == [":", "root"]

    @property
    def source(self) -> str:
        return "".join(n.text for n, _ in self.nodes if isinstance(n, Token))


def _attribute(inner: list[Token]) -> Attribute | None:
    """An attribute selector from what stands in its brackets; None if it is something else."""
    words: list[list[Token]] = [[]]  # what white space and quotes part
    for t in inner:
        if t.kind == "space":
            words.append([])
        elif t.kind == "string":
            words += [[t], []]
        elif t.text == "=" and not any(x.text == "=" for w in words for x in w):
            before = words[-1].pop() if words[-1] and words[-1][-1].text in _COMPARES else None
            words += [[*([before] if before else []), t], []]
        else:
            words[-1].append(t)
    words = [w for w in words if w]
    if not words or len(words[0]) != 1 or not _IDENTIFIER.fullmatch(words[0][0].text) or not words[0][0].text.isascii():
        return None
    name = words[0][0].text
    if len(words) == 1:
        return Attribute(name, None, None, None)
    if len(words) not in (3, 4) or words[1][-1].text != "=":
        return None
    op, value = "".join(t.text for t in words[1]), "".join(t.text for t in words[2])
    flag = "".join(t.text for t in words[3]).lower() if len(words) == 4 else None
    if flag not in (None, "i", "s"):
        return None
    if words[2][0].kind == "string":
        if len(value) < 2 or value[-1] != value[0]:
            return None
        value = value[1:-1]
    return Attribute(name, op, unescape(value), flag)


def compounds(selector: str) -> list[Compound]:
    found, gap = [Compound()], []
    depth, inner = 0, None  # inner: the tokens since an open square bracket

    def close_gap() -> None:
        """A run of white space and combinators ends: another compound begins."""
        if gap:
            found[-1].combinator = "".join(t.text for t in gap).strip()[-1:] or " "
            found.append(Compound())
            gap.clear()

    for token in tokens(selector.strip()):
        if inner is not None:
            if token.text != "]":
                inner.append(token)
                continue
            attribute = _attribute(inner)
            nodes = [attribute] if attribute else [Token("mark", "["), *inner, token]
            found[-1].nodes += [(n, depth) for n in nodes]
            inner = None
            continue
        if not depth and (token.kind == "space" or token.kind == "mark" and token.text in ">+~"):
            gap.append(token)
            continue
        close_gap()
        if token.text == "[" and token.kind == "mark":
            inner = []
            continue
        if token.text == ")" and token.kind == "mark":
            depth = max(0, depth - 1)
        found[-1].nodes.append((token, depth))
        if token.text == "(" and token.kind == "mark":
            depth += 1
    if inner is not None:
        found[-1].nodes += [(n, depth) for n in (Token("mark", "["), *inner)]
    close_gap()
    return found


@dataclass(frozen=True)
class Parsed:
    """What is told about a selector.

    shape: its nodes, without the values that ``values`` has: those of exact comparisons of
    attributes that bind. readable: its subject, the last compound, holds nothing that hides a type,
    id or class.
    """

    shape: tuple
    values: tuple[str, ...]
    attributes: tuple[Attribute, ...]
    readable: bool
    kind: str | None
    classes: frozenset[str]
    ids: frozenset[str]


@lru_cache(1 << 15)
def parsed(selector: str) -> Parsed:
    parts = compounds(selector)
    shape, values, attributes = [], [], []
    fixed = True  # do only fixed relations lead from here to the subject
    binding = []
    for part in reversed(parts):
        fixed = fixed and part.combinator in ("", ">", "+")
        binding.append(fixed or part.one_element)
    for part, binds in zip(parts, reversed(binding), strict=True):
        for node, depth in part.nodes:
            if isinstance(node, Token):
                shape.append(node.text)
                continue
            node = Attribute(node.name, node.op, node.value, node.flag, binds and not depth)
            attributes.append(node)
            told = node.op == "=" and node.binds
            shape.append((node.name, node.op, node.flag, None if told else node.value))
            if told:
                values.append(node.value)
        shape.append((part.combinator,))
    subject = parts[-1]
    flat = [n for n, _ in subject.nodes if isinstance(n, Token)]
    inside = [n.value or "" for n, _ in subject.nodes if isinstance(n, Attribute)]
    named: dict[str, set[str]] = {".": set(), "#": set()}
    for before, after in zip(flat, flat[1:], strict=False):
        if before.text in named and after.kind == "name" and after.text.isascii():
            named[before.text].add(after.text)
    first = subject.nodes[0][0] if subject.nodes else None
    kind = first.text.lower() if isinstance(first, Token) and first.kind == "name" and first.text[0].isalpha() else None
    hidden = any(t.kind == "escape" or t.text in ("(", "|") for t in flat) or any(c in v for v in inside for c in "\\(|")
    return Parsed(tuple(shape), tuple(values), tuple(attributes), not hidden, kind, frozenset(named["."]), frozenset(named["#"]))


def exclusive(a: str, b: str) -> bool:
    """Proof that no element matches both: they are the same but for exact values of attributes
    that one and the same element would need to have. Values that differ in case alone prove
    nothing, since some attributes are compared without case."""
    x, y = parsed(a), parsed(b)
    differing = [(p, q) for p, q in zip(x.values, y.values, strict=False) if p != q]
    return x.shape == y.shape and bool(differing) and all(p.casefold() != q.casefold() for p, q in differing)


def likely_apart(a: str, b: str) -> bool:
    """Do the two subjects' types, ids or classes have nothing in common? No proof: an element can
    have both classes."""
    x, y = parsed(a), parsed(b)
    needs = [({p.kind} - {None}, p.ids, p.classes) for p in (x, y)]
    return x.readable and y.readable and any(m and n and m.isdisjoint(n) for m, n in zip(*needs, strict=True))
