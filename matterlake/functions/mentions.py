"""Mentions of several patterns in a text, found in one pass."""

import re
from collections.abc import Iterable
from dataclasses import dataclass

# Mentions are words: no ASCII word letter stands before or after them.
_BEFORE, _AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
_FLAGS = re.IGNORECASE | re.ASCII

# Start, end and number of the rule, from 0.
Place = tuple[int, int, int]


@dataclass(frozen=True)
class Rules:
    """Every rule by itself, and all of them as one alternation."""

    single: tuple[re.Pattern, ...]
    any: re.Pattern

    def places(self, text: str) -> list[Place]:
        """All mentions by (start, end, rule); those of one rule do not overlap."""
        found: list[Place] = []
        free = [0] * len(self.single)
        at = 0
        while at < len(text) and (met := self.any.search(text, at)):
            start = met.start()
            # The alternation stops where any rule matches; others may, too.
            for i, rule in enumerate(self.single):
                own = rule.match(text, start) if start >= free[i] else None
                if own and own.end() > start:
                    found.append((start, own.end(), i))
                    free[i] = own.end()
            at = start + 1
        return sorted(found)

    def first_places(self, text: str) -> list[Place]:
        """The first mention of each rule, in the order of the rules."""
        found = []
        for i, rule in enumerate(self.single):
            met = next((m for m in rule.finditer(text) if m.end() > m.start()), None)
            if met:
                found.append((met.start(), met.end(), i))
        return found


def compiled(patterns: Iterable[str]) -> Rules:
    patterns = list(patterns)
    single = tuple(re.compile(f"{_BEFORE}(?:{p}){_AFTER}", _FLAGS) for p in patterns)
    every = "|".join(f"(?:{p}){_AFTER}" for p in patterns)
    return Rules(single, re.compile(f"{_BEFORE}(?:{every})" if patterns else r"(?!)", _FLAGS))


def excerpts(
    text: str, places: list[Place], before: int, after: int, apart: bool
) -> list[tuple[int, str, str]]:
    """(number of the rule from 1, mention, excerpt) of each place.

    An excerpt reaches from ``before`` characters before its mention to
    ``after`` characters after the mention's start.  ``apart`` keeps the excerpts
    of ordered places from repeating each other: one begins where the excerpt
    before it ends and ends where the next mention starts, so that all excerpts
    of a text together are hardly longer than the text.
    """
    out = []
    for i, (start, end, rule) in enumerate(places):
        low, high = max(0, start - before), start + after
        if apart:
            if i:
                low = max(low, min(places[i - 1][0] + after, start))
            if i + 1 < len(places):
                high = min(high, places[i + 1][0])
            high = max(high, end)
        out.append((rule + 1, text[start:end], text[low:high]))
    return out
