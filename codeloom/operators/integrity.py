"""References to records that do not exist."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import clean_id, period
from codeloom.session import materialize

MATCHES = ("simple", "partial", "full")


def target_states(
    targets: DataFrame, keys: Sequence[str], version: str | None = None, deleted: str | None = None, born: str | None = None
) -> DataFrame:
    """One row per complete key of the referenced table: is its latest version deleted, and when did it first appear.

    Aggregated map-side, so repeated deliveries of a key never meet in one place. Of
    rows with equal version a deleted one wins; a null version is older than any other.
    """
    gone = F.col(deleted).isNotNull() if deleted else F.lit(False)
    order = F.struct(F.col(version) if version else F.lit(0), gone)
    rows = targets.select(
        *[clean_id(k).alias(f"_t{i}") for i, k in enumerate(keys)],
        gone.alias("_gone"),
        order.alias("_order"),
        (F.col(born) if born else F.lit(None).cast("timestamp_ntz")).alias("_born"),
    )
    return (
        rows.where(reduce(Column.__and__, [F.col(f"_t{i}").isNotNull() for i in range(len(keys))]))
        .groupBy(*[f"_t{i}" for i in range(len(keys))])
        .agg(F.max_by("_gone", "_order").alias("_gone"), F.min("_born").alias("_born"))
    )


def orphan_references(
    refs: DataFrame,
    targets: DataFrame,
    keys: Sequence[tuple[str, str]],
    *,
    labels: Sequence[str] = (),
    at: str | None = None,
    match: str = "simple",
    version: str | None = None,
    deleted: str | None = None,
    born: str | None = None,
) -> DataFrame:
    """References whose target is missing, deleted or came later.

    ``keys`` pairs each referring column with the referenced one. References are first
    counted per labels, key and month (map-side, so a key that a third of all rows name
    shrinks to a row per month), then grouped by their null mask; each mask is joined on
    its non-null columns only, as ``match`` declares:

    * ``simple``  - a key with any null refers to nothing;
    * ``partial`` - the non-null columns must occur together in some target;
    * ``full``    - a key that is null in part is an orphan (reason ``partial_null``).

    A key that is null (or blank) throughout refers to nothing. Result: the labels, the
    key columns (cleaned), ``period`` (null without a time), ``reason`` (``missing``,
    ``deleted``, ``late`` or ``partial_null``) and ``n_refs``, the references of that
    key and period. ``late`` means that at least one of them precedes the target. Empty
    inputs give an empty result (empty targets: all are missing); further columns of
    either table are never read.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    k = len(keys)
    cols = [f"_r{i}" for i in range(k)]
    moment = F.col(at) if at else F.lit(None).cast("timestamp_ntz")
    grouped = (
        refs.select(
            *[F.col(x).alias(f"_l{i}") for i, x in enumerate(labels)],
            *[clean_id(r).alias(c) for c, (r, _) in zip(cols, keys)],
            moment.alias("_at"),
        )
        .where(reduce(Column.__or__, [F.col(c).isNotNull() for c in cols]))
        .withColumn("period", period("_at"))
        .groupBy(*[f"_l{i}" for i in range(len(labels))], *cols, "period")
        .agg(F.min("_at").alias("_at"), F.count("*").alias("n_refs"))
        .withColumn("_mask", sum((F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(cols)), F.lit(0)))
    )
    states = target_states(targets, [t for _, t in keys], version, deleted, born)
    if k > 1:  # both are read once per mask
        grouped, states = materialize(grouped, "refs"), materialize(states, "targets")
    found = []
    for mask in range((1 << k) - 1):  # the mask of nulls only refers to nothing
        part = grouped.where(F.col("_mask") == mask) if k > 1 else grouped
        if mask and match == "simple":
            continue
        if mask and match == "full":
            found.append(part.withColumn("reason", F.lit("partial_null")))
            continue
        held = [i for i in range(k) if not mask >> i & 1]
        known = states
        if mask:  # a wildcard matches any of several targets: gone only if all of them are
            known = states.groupBy(*[f"_t{i}" for i in held]).agg(F.min("_gone").alias("_gone"), F.min("_born").alias("_born"))
        joined = part.join(known, [part[cols[i]] == known[f"_t{i}"] for i in held], "left")
        found.append(
            joined.withColumn(
                "reason",
                F.when(F.col("_gone").isNull(), "missing").when(F.col("_gone"), "deleted").when(F.col("_at") < F.col("_born"), "late"),
            ).where(F.col("reason").isNotNull())
        )
    out = [
        d.select(
            *[F.col(f"_l{i}").alias(x) for i, x in enumerate(labels)],
            *[F.col(c).alias(r) for c, (r, _) in zip(cols, keys)],
            "period",
            "reason",
            "n_refs",
        )
        for d in found
    ]
    return reduce(DataFrame.unionByName, out)


def orphan_report(orphans: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Orphans per labels, month and reason: distinct keys and the references that name them in that month."""
    return orphans.groupBy(*labels, "period", "reason").agg(F.count("*").alias("n_keys"), F.sum("n_refs").alias("n_refs"))
