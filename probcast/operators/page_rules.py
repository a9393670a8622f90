"""Rules of tracked pages: comparison, texts, limits, and how values resolve and are shown.

A registry holds one rule per page root and compiles every part of it into one conditional expression
on the root column, so a frame that mixes all pages is handled in a single projection.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from probcast import constants as C


def _number(value: Column) -> Column:
    return value.cast("string").try_cast("double")


#: When a value (null: dropped out of the page) settles its question.
RESOLVED: dict[str, Callable[[Column], Column]] = {
    "missing": lambda value: value.isNull(),
    "happened": lambda value: F.coalesce((_number(value) == 1) | (F.lower(value.cast("string")) == "yes"), F.lit(False)),
}
#: How a value is shown, as text.
SHOWN: dict[str, Callable[[Column], Column]] = {
    "as_is": lambda value: value.cast("string"),
    "yes_no": lambda value: F.when(F.coalesce(_number(value) != 0, value.cast("string") != ""), "Yes").otherwise("No"),
}
#: How a value enters a forecast, as a number.
NUMERIC: dict[str, Callable[[Column], Column]] = {
    "number": _number,
    "held": lambda value: F.when(value.isNull(), 0.0).otherwise(1.0),
}


@dataclass(frozen=True)
class PageRule:
    """Templates may name {id} and {value}; other braces stay for later filling."""

    root: str
    title: str
    comparison: str
    question: str
    explanation: str
    background: str = ""
    resolved: str = "missing"
    shown: str = "as_is"
    numeric: str = "number"
    floor: float = 0.0
    cap: float = 1.0
    backfilled: bool = False    # series begin with null days from the common start
    wide_band: bool = False     # "the same" means within one half instead of a thousandth


class PageRules:
    """A registry of rules with unique roots."""

    def __init__(self, rules: Iterable[PageRule]):
        self.rules = {}
        for rule in rules:
            if rule.root in self.rules:
                raise ValueError(f"two rules for page {rule.root!r}")
            if rule.comparison not in C.PAGE_COMPARISONS:
                raise ValueError(f"unknown comparison {rule.comparison!r}")
            if not rule.cap > rule.floor:
                raise ValueError(f"page {rule.root!r}: cap must exceed floor")
            for name, known in ((rule.resolved, RESOLVED), (rule.shown, SHOWN), (rule.numeric, NUMERIC)):
                if name not in known:
                    raise ValueError(f"unknown rule {name!r}, known: {sorted(known)}")
            self.rules[rule.root] = rule

    def choose(self, root: Column, part: Callable[[PageRule], Column | object]) -> Column:
        """The part of each row's own rule; null for pages without one. Equal parts share a branch."""
        branches: dict[str, tuple[Column, list[str]]] = {}
        for rule in self.rules.values():
            value = part(rule)
            column = value if isinstance(value, Column) else F.lit(value)
            branches.setdefault(str(column), (column, []))[1].append(rule.root)
        out = None
        for column, roots in branches.values():
            out = F.when(root.isin(roots), column) if out is None else out.when(root.isin(roots), column)
        return F.lit(None) if out is None else out

    def known(self, root: Column) -> Column:
        return root.isin(list(self.rules))

    def resolved(self, root: Column, value: Column) -> Column:
        return self.choose(root, lambda r: RESOLVED[r.resolved](value))

    def shown(self, root: Column, value: Column) -> Column:
        return self.choose(root, lambda r: SHOWN[r.shown](value))

    def numeric(self, root: Column, value: Column) -> Column:
        return self.choose(root, lambda r: NUMERIC[r.numeric](value)).cast("double")

    def text(self, root: Column, template: str, name: Column, value: Column) -> Column:
        """A template of the rule (question, background, explanation) filled from the row."""
        body = self.choose(root, lambda r: getattr(r, template)).cast("string")
        filled = F.replace(body, F.lit("{id}"), F.coalesce(name, F.lit("")))
        return F.replace(filled, F.lit("{value}"), F.coalesce(value, F.lit("")))

    def url(self, root: Column) -> Column:
        return F.concat(F.lit(C.PAGE_URL), self.choose(root, lambda r: r.title).cast("string"))
