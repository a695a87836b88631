"""What a column's name says about its role: tables of points, and one function that applies any of them.

A table is data only: words with their points by how they lie in a name, and patterns with points of their own."""

from __future__ import annotations

import re
from typing import NamedTuple


class Points(NamedTuple):
    """words: the likeliest first. whole, edge, inside: points of a word that is the name, an outer part of it between underscores, or anywhere in it; step: points less for each place down the list. patterns: more points, by regular expression."""

    words: tuple[str, ...]
    whole: int
    edge: int
    inside: int
    step: int = 0
    patterns: tuple[tuple[str, int], ...] = ()


#: The words that names are scored by, and their points.
DATE = Points(
    ("date", "time", "timestamp", "period"), 800, 400, 150,
    patterns=((r"date", 1000), (r"(?!date$)(?=.*date).*(start|end).*", -100)),
)
TARGET = Points(
    ("target", "y", "value", "values", "series", "sales", "revenue", "amount", "qty", "quantity", "demand", "load", "power", "traffic", "volume", "price", "count"), 1000, 500, 100,
    step=1,
)
#: Names of columns that number rows or things.
ID_NAMES = (r"id|index", r"id_.*", r".*_id", r"(?=.*(user|row|record|cust|client)).*id.*")


def points(name: str, table: Points) -> int:
    """The sum of what all words and patterns of the table give a name; letter case plays no part."""
    name = name.lower()
    parts = name.split("_")
    places = ([name], [parts[0], parts[-1]], [w for w in table.words if w in name])
    total = 0
    for down, word in enumerate(table.words):
        best = next((most for most, found in zip(table[1:4], places, strict=True) if word in found), None)
        total += 0 if best is None else best - table.step * down
    return total + sum(more for pattern, more in table.patterns if re.fullmatch(pattern, name, re.DOTALL))


def names_an_id(name: str) -> bool:
    return any(re.fullmatch(pattern, name.lower(), re.DOTALL) for pattern in ID_NAMES)
