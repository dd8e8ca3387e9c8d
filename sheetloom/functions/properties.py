"""Property names: one spelling, shorthands, and which properties set a common longhand."""

from __future__ import annotations

from functools import lru_cache

# Shorthands and the longhands that they set. Physical and logical sides are apart:
# which physical side a logical one is depends on the writing mode.
SHORTHANDS: dict[str, tuple[str, ...]] = {
    "margin": (
        "margin-top", "margin-right", "margin-bottom", "margin-left", "margin-block", "margin-block-start",
        "margin-block-end", "margin-inline", "margin-inline-start", "margin-inline-end",
    ),
    "padding": (
        "padding-top", "padding-right", "padding-bottom", "padding-left", "padding-block", "padding-block-start",
        "padding-block-end", "padding-inline", "padding-inline-start", "padding-inline-end",
    ),
    "inset": (
        "top", "right", "bottom", "left", "inset-block", "inset-block-start", "inset-block-end", "inset-inline",
        "inset-inline-start", "inset-inline-end",
    ),
    "margin-block": ("margin-block-start", "margin-block-end"),
    "margin-inline": ("margin-inline-start", "margin-inline-end"),
    "padding-block": ("padding-block-start", "padding-block-end"),
    "padding-inline": ("padding-inline-start", "padding-inline-end"),
    "inset-block": ("inset-block-start", "inset-block-end"),
    "inset-inline": ("inset-inline-start", "inset-inline-end"),
    "border": (
        "border-top", "border-right", "border-bottom", "border-left", "border-width", "border-style", "border-color",
        "border-top-width", "border-top-style", "border-top-color", "border-right-width", "border-right-style",
        "border-right-color", "border-bottom-width", "border-bottom-style", "border-bottom-color",
        "border-left-width", "border-left-style", "border-left-color",
    ),
    "border-top": ("border-top-width", "border-top-style", "border-top-color"),
    "border-right": ("border-right-width", "border-right-style", "border-right-color"),
    "border-bottom": ("border-bottom-width", "border-bottom-style", "border-bottom-color"),
    "border-left": ("border-left-width", "border-left-style", "border-left-color"),
    "border-width": ("border-top-width", "border-right-width", "border-bottom-width", "border-left-width"),
    "border-style": ("border-top-style", "border-right-style", "border-bottom-style", "border-left-style"),
    "border-color": ("border-top-color", "border-right-color", "border-bottom-color", "border-left-color"),
    "border-radius": (
        "border-top-left-radius", "border-top-right-radius", "border-bottom-right-radius",
        "border-bottom-left-radius",
    ),
    "border-image": (
        "border-image-source", "border-image-slice", "border-image-width", "border-image-outset",
        "border-image-repeat",
    ),
    "outline": ("outline-width", "outline-style", "outline-color"),
    "background": (
        "background-image", "background-position", "background-size", "background-repeat", "background-origin",
        "background-clip", "background-attachment", "background-color",
    ),
    "font": ("font-style", "font-variant", "font-weight", "font-stretch", "font-size", "line-height", "font-family"),
    "list-style": ("list-style-type", "list-style-position", "list-style-image"),
    "overflow": ("overflow-x", "overflow-y"),
    "gap": ("row-gap", "column-gap"),
    "grid-gap": ("grid-row-gap", "grid-column-gap"),
    "place-items": ("align-items", "justify-items"),
    "place-content": ("align-content", "justify-content"),
    "place-self": ("align-self", "justify-self"),
    "flex": ("flex-grow", "flex-shrink", "flex-basis"),
    "flex-flow": ("flex-direction", "flex-wrap"),
    "transition": ("transition-property", "transition-duration", "transition-timing-function", "transition-delay"),
    "animation": (
        "animation-name", "animation-duration", "animation-timing-function", "animation-delay",
        "animation-iteration-count", "animation-direction", "animation-fill-mode", "animation-play-state",
    ),
    "text-decoration": (
        "text-decoration-line", "text-decoration-style", "text-decoration-color", "text-decoration-thickness",
    ),
    "grid-template": ("grid-template-rows", "grid-template-columns", "grid-template-areas"),
    "grid-area": ("grid-row", "grid-column", "grid-row-start", "grid-row-end", "grid-column-start", "grid-column-end"),
    "grid-row": ("grid-row-start", "grid-row-end"),
    "grid-column": ("grid-column-start", "grid-column-end"),
    # beyond the reference's own list: more shorthands whose omission would make a merge unsafe
    "border-block": (
        "border-block-start", "border-block-end", "border-block-width", "border-block-style", "border-block-color",
    ),
    "border-inline": (
        "border-inline-start", "border-inline-end", "border-inline-width", "border-inline-style",
        "border-inline-color",
    ),
    "columns": ("column-width", "column-count"),
    "grid": (
        "grid-template", "grid-template-rows", "grid-template-columns", "grid-template-areas", "grid-auto-rows",
        "grid-auto-columns", "grid-auto-flow",
    ),
    "mask": (
        "mask-image", "mask-position", "mask-size", "mask-repeat", "mask-origin", "mask-clip", "mask-composite",
        "mask-mode",
    ),
}
# Older names that browsers take for the newer ones.
ALIASES = {"word-wrap": "overflow-wrap", "grid-gap": "gap", "grid-row-gap": "row-gap", "grid-column-gap": "column-gap"}

_SETS = {p: frozenset((p, *longhands)) for p, longhands in SHORTHANDS.items()}


def one_name(prop: str, aggressive: bool = False) -> str:
    """Lower case but for custom properties; with aggressive, newer names for older ones."""
    name = prop.strip()
    if name.startswith("--"):
        return name
    name = name.lower()
    return ALIASES.get(name, name) if aggressive else name


@lru_cache(1 << 16)
def overlap(a: str, b: str) -> bool:
    """Can setting one of two properties change a longhand that the other sets? An older name
    counts as its newer one, and ``all`` sets everything but custom properties."""
    if a == b:
        return True
    if "all" in (a, b):
        return not (a.startswith("--") or b.startswith("--"))
    a, b = ALIASES.get(a, a), ALIASES.get(b, b)
    return not _SETS.get(a, frozenset((a,))).isdisjoint(_SETS.get(b, frozenset((b,))))


def overlap_pairs() -> list[tuple[str, str]]:
    """All pairs of different known properties that overlap, both ways round: a dimension table of
    fixed size for joins."""
    known = sorted({*SHORTHANDS, *(x for s in SHORTHANDS.values() for x in s), *ALIASES})
    return [(a, b) for a in known for b in known if a != b and overlap(a, b)]
