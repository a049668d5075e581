"""References to records that do not exist, are gone, or arrive later."""

from __future__ import annotations

from functools import reduce
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitloom.operators import skew


class Reference(NamedTuple):
    """One field that refers to another table: the key columns of the referring rows, what they refer to, and the rule."""

    keys: list[str]
    targets: DataFrame
    match: str = "simple"
    target_keys: list[str] | None = None


def find_orphans(refs: DataFrame, targets: DataFrame, keys: list[str], match: str = "simple") -> DataFrame:
    """(row_key, at, orphan_kind): :func:`find_all_orphans` for one reference whose columns have the same names in both."""
    return find_all_orphans(refs, {"": Reference(keys, targets, match)}).drop("ref_field")


def find_all_orphans(rows: DataFrame, references: dict[str, Reference], task_rows: int = skew.TASK_ROWS) -> DataFrame:
    """(ref_field, row_key, at, orphan_kind): references of one table that find no valid target, for several fields.

    ``rows`` has ``row_key``, ``at`` (a time) and the key columns; ``targets`` have the key columns, ``valid_from`` and
    ``valid_to`` (NULL: still valid). Keys are compared as they are: normalise both sides before. A key part that is
    NULL is not stated. References are grouped by their null mask, and each mask is anti-joined on the columns that it
    states:

    * ``simple``: only references that state every part are checked, all others are satisfied;
    * ``partial``: stated parts must agree with some target; a reference that states nothing is satisfied;
    * ``full``: all parts or none must be stated; a reference that states only some is ``missing``.

    A target is valid at ``at`` if ``valid_from <= at`` and ``valid_to`` is NULL or ``> at``. Kinds: ``missing`` - no
    target has the key; ``deleted`` - one was there by ``at``, but none is valid; ``late`` - all came later. With a
    NULL ``at`` nothing is known to be there, so an existing key gives ``late``. Targets may repeat, which costs nothing, as
    they are made distinct; extra columns on either side are ignored. The anti join stops at the first valid target; kinds
    are looked up for orphans only. Hot keys of all fields and masks are found in one pass over ``rows``; each is spread
    over as many tasks as its rows need at ``task_rows`` a task, so a key with a third of all references holds up none.
    """
    masks: list[tuple[str, list[str], list[str], Column]] = []  # field, own columns, target columns, which rows
    found, sets, marks = [], {}, {}
    for field, ref in references.items():
        if ref.match not in ("simple", "partial", "full"):
            raise ValueError(f"unknown match: {ref.match}")
        for mask in product((True, False), repeat=len(ref.keys)):
            stated = [i for i, s in enumerate(mask) if s]
            if not stated or (ref.match == "simple" and len(stated) < len(ref.keys)):
                continue
            own = reduce(Column.__and__, [F.col(k).isNotNull() == F.lit(s) for k, s in zip(ref.keys, mask)])
            if ref.match == "full" and len(stated) < len(ref.keys):
                found.append(rows.filter(own).select(F.lit(field).alias("ref_field"), "row_key", "at", F.lit("missing").alias("orphan_kind")))
                continue
            label = f"{field}/{''.join('01'[s] for s in mask)}"
            sets[label] = [f"__{len(masks)}_{i}" for i in stated]
            for i in stated:
                marks[f"__{len(masks)}_{i}"] = F.when(own, F.col(ref.keys[i]))
            masks.append((field, [ref.keys[i] for i in stated], [(ref.target_keys or ref.keys)[i] for i in stated], own))
    hot = skew.hot_keys_at_once(rows.select(*[c.alias(n) for n, c in marks.items()]), sets, task_rows) if sets else {}
    for (field, keys, names, own), label in zip(masks, sets):
        here, there = [f"r_{i}" for i in range(len(keys))], [f"t_{i}" for i in range(len(keys))]
        mine = rows.filter(own).select("row_key", "at", *[F.col(k).alias(h) for k, h in zip(keys, here)])
        mine = skew.salted(mine, hot.get(label), here, "row_key", "r__salt")
        to = references[field].targets.select(*[F.col(n).alias(t) for n, t in zip(names, there)], "valid_from", "valid_to")
        if label in hot:
            to = to.distinct()  # repeated targets of a hot key would be multiplied by its salts
        to = skew.repeated(to, hot.get(label), there, "t__salt")
        same = reduce(Column.__and__, [F.col(r) == F.col(t) for r, t in zip([*here, "r__salt"], [*there, "t__salt"])])
        valid = (F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("at")))
        orphans = mine.join(to, same & valid, "left_anti")
        first = to.groupBy(*there, "t__salt").agg(F.min("valid_from").alias("first"), F.lit(True).alias("there"))
        kind = F.when(F.col("there").isNull(), "missing").when(F.col("first") <= F.col("at"), "deleted").otherwise("late")
        found.append(orphans.join(first, same, "left").select(F.lit(field).alias("ref_field"), "row_key", "at", kind.alias("orphan_kind")))
    if not found:
        return rows.select(F.lit("").alias("ref_field"), "row_key", "at", F.lit("missing").alias("orphan_kind")).limit(0)
    return reduce(DataFrame.unionByName, found)


def by_period(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table, field, kind and day."""
    return orphans.groupBy("ref_table", "ref_field", "orphan_kind", "ref_period").agg(F.count(F.lit(1)).alias("n_orphans"))
