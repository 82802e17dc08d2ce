"""CoNLL-U FEATS strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from phraseloom import constants as C

_KNOWN = [f"{c}={v}" for c, values in C.FEATS.items() for v in values.split()]


def pairs(feats: Column) -> Column:
    """``Cat=Val`` parts; ``_`` and the empty string have none, null stays null."""
    return F.filter(F.split(feats, "[|]"), lambda p: (p != "_") & (p != ""))


def as_map(feats: Column) -> Column:
    """map<category, value>."""
    return F.map_from_entries(F.transform(F.array_distinct(pairs(feats)), lambda p: F.struct(F.substring_index(p, "=", 1), F.substring_index(p, "=", -1))))


def problem(feats: Column) -> Column:
    """What is wrong with a FEATS string: missing, grammar, order (of categories, by bytes), unknown (value); null if nothing."""
    parts = pairs(feats)
    names = F.transform(parts, lambda p: F.substring_index(p, "=", 1))
    grammar = feats.rlike(r"^(_|[A-Za-z]+=[^|=]+(\|[A-Za-z]+=[^|=]+)*)$")
    return (
        F.when(feats.isNull(), "missing")
        .when(~grammar, "grammar")
        .when(names != F.array_sort(F.array_distinct(names)), "order")
        .when(F.exists(parts, lambda p: ~p.isin(*_KNOWN)), "unknown")
    )
