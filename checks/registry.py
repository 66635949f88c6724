"""All registered queries by name."""

from __future__ import annotations

from checks import companies, entries, fleet, kept, odd, people, scalars
from checks.pairs import Pair

PAIRS: dict[str, Pair] = {}
for _module in (fleet, people, companies, entries, scalars, odd, kept):
    for _pair in _module.PAIRS:
        if _pair.key in PAIRS:
            raise ValueError(f"registered twice: {_pair.key}")
        PAIRS[_pair.key] = _pair
