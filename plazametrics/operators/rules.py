"""Prioritised rule tables applied as column expressions.

A rule table is configuration: it is read on the driver, and compiled to one ordered
``CASE`` that the scan evaluates once per row. Distinct values are classified first and
joined back when ``factored`` is asked for, which pays when rows far outnumber values.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import as_bool
from ..functions.text import UNMAPPED, compact, nfkc

TRUE_WORDS = {"1", "true", "yes", "y"}
LAST_PRIORITY = 9999


@dataclass(frozen=True)
class Rule:
    """One row of a rule table; ``ordinal`` is its place in the file."""

    match_type: str
    pattern: str
    priority: int = LAST_PRIORITY
    ordinal: int = 0
    active: bool = True
    category_l1: str = ""
    category_l2: str = ""
    action: str = "exclude"
    field: str = ""
    reason: str = ""


def rules_from_rows(rows: Iterable[dict]) -> list[Rule]:
    """Rule rows as read from a CSV: everything is text, blanks mean the default."""
    rules = []
    for ordinal, row in enumerate(rows):
        given = row.get("active")
        rules.append(
            Rule(
                match_type=row.get("match_type") or "exact",
                pattern=row.get("pattern") or "",
                priority=int(row.get("priority") or 0) or LAST_PRIORITY,
                ordinal=ordinal,
                active=given is None or str(given).strip().lower() in TRUE_WORDS,
                category_l1=row.get("category_l1") or "",
                category_l2=row.get("category_l2") or "",
                action=row.get("action") or "exclude",
                field=row.get("field") or "",
                reason=row.get("reason") or row.get("rule_id") or "configured_exclusion",
            )
        )
    return rules


def active_rows(table: DataFrame) -> DataFrame:
    """Rows of a configuration table that are switched on; all where it has no ``active`` column."""
    return table.where(as_bool(F.coalesce("active", F.lit("TRUE")))) if "active" in table.columns else table


def in_order(rules: Iterable[Rule]) -> list[Rule]:
    return sorted((r for r in rules if r.active), key=lambda r: (r.priority, r.ordinal))


def matches(value: Column, match_type: str, pattern: str) -> Column:
    """Case-insensitive exact, substring or regular-expression test of a value in NFKC."""
    value = F.coalesce(value, F.lit(""))
    plain = unicodedata.normalize("NFKC", pattern).strip().lower()
    if match_type == "exact":
        return F.lower(value) == plain
    if match_type == "contains":
        return F.contains(F.lower(value), F.lit(plain))
    if match_type == "regex":
        return value.rlike(f"(?iu){pattern}")
    raise ValueError(f"unknown match_type: {match_type}")


def first_match(value: Column, rules: Iterable[Rule]) -> Column:
    """Struct ``(l1, l2, status, rule)`` of the first rule that fits."""
    def outcome(l1: str, l2: str, status: str, rule: str) -> Column:
        return F.struct(
            F.lit(l1).alias("category_l1"), F.lit(l2).alias("category_l2"),
            F.lit(status).alias("mapping_status"), F.lit(rule).alias("mapping_rule"),
        )

    chain = None
    for rule in in_order(rules):
        hit = outcome(rule.category_l1, rule.category_l2, "mapped", rule.pattern)
        test = matches(value, rule.match_type, rule.pattern)
        chain = F.when(test, hit) if chain is None else chain.when(test, hit)
    missing = outcome(UNMAPPED, UNMAPPED, "unmapped", "")
    return missing if chain is None else chain.otherwise(missing)


def classify(df: DataFrame, raw: str, rules: Iterable[Rule], factored: bool = False) -> DataFrame:
    """Append the four classification columns."""
    if not factored:
        tagged = df.withColumn("_plain", nfkc(raw)).withColumn("_class", first_match(F.col("_plain"), rules))
        return tagged.select(*[F.col(c) for c in df.columns], "_class.*")
    vocabulary = df.select(raw).distinct().withColumn("_plain", nfkc(raw)).withColumn("_class", first_match(F.col("_plain"), rules))
    vocabulary = vocabulary.select(F.col(raw).alias("_raw"), "_class.*")
    return df.join(vocabulary, F.col(raw).eqNullSafe(F.col("_raw"))).drop("_raw")


def exclusion_reasons(df: DataFrame, rules: Iterable[Rule]) -> Column:
    """Sorted distinct reasons of all matching rules; a matching ``keep`` clears them."""
    kept, reasons = F.lit(False), []
    for rule in in_order(rules):
        if rule.field not in df.columns:
            continue
        hit = matches(nfkc(rule.field), rule.match_type, rule.pattern)
        if rule.action == "keep":
            kept = kept | hit
        elif rule.action == "exclude":
            reasons.append(F.when(hit, F.lit(rule.reason)))
    none = F.array().cast("array<string>")
    if not reasons:
        return none
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*reasons))))
    return F.when(kept, none).otherwise(found)


def pair_exclusion_flag(df: DataFrame, manual: DataFrame, venue: str, name: str) -> DataFrame:
    """Append ``manual_excluded``: (venue, name) stands in an active row of the hand-made list."""
    listed = active_rows(manual).select(
        compact(F.col("mall_name")).alias("_venue"), compact(F.col("merchant_name")).alias("_name")
    ).distinct()
    keyed = df.withColumn("_v", compact(F.col(venue))).withColumn("_n", compact(F.col(name)))
    joined = keyed.join(
        listed.withColumn("manual_excluded", F.lit(True)),
        (F.col("_v") == F.col("_venue")) & (F.col("_n") == F.col("_name")),
        "left",
    )
    return joined.withColumn("manual_excluded", F.coalesce("manual_excluded", F.lit(False))).drop(
        "_v", "_n", "_venue", "_name"
    )
