"""What a run is asked to do."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.selectors import DEFAULT_IGNORED


@dataclass(frozen=True)
class Options:
    """aggressive: also take likely equivalences and likely disjoint selectors, and join blocks of
    the same condition. savings_only: withhold a result that is larger. fence: "document" lets
    every rule between two occurrences block a merge, "scope" only those of their own block.
    """

    aggressive: bool = False
    savings_only: bool = False
    ignore_selectors: tuple[str, ...] = ()
    ignore_selectors_defaults: bool = True
    fence: str = "document"

    def __post_init__(self) -> None:
        if self.fence not in ("document", "scope"):
            raise ValueError("fence is 'document' or 'scope'")

    @property
    def ignored(self) -> tuple[str, ...]:
        return (*(DEFAULT_IGNORED if self.ignore_selectors_defaults else ()), *self.ignore_selectors)
