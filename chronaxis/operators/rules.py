"""Declarative rules over route records, compiled to Columns.

The rule document is a handful of rules; it is walked on the driver and turned
into boolean expressions, so a route table of any size is audited by one narrow
projection with short-circuit CASE evaluation.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.rulebook import ACTIONS, FALLBACK, RULES

OPERATORS = ("eq", "in", "not_in")


def compile_predicate(p: dict) -> Column:
    """``all`` / ``any`` trees over eq / in / not_in leaves as one Column."""
    for branch, start, join in (("all", True, Column.__and__), ("any", False, Column.__or__)):
        if branch in p:
            if not p[branch]:
                raise ValueError(f"{branch} needs children")
            out = None
            for child in p[branch]:
                c = compile_predicate(child)
                out = c if out is None else join(out, c)
            return out
    ops = [o for o in OPERATORS if o in p]
    if len(ops) != 1:
        raise ValueError(f"one operator per leaf, got {ops}")
    col, arg = F.col(p["field"]), p[ops[0]]
    if ops[0] == "eq":
        return col == F.lit(arg)
    if not isinstance(arg, list) or not arg:
        raise ValueError("in / not_in need a non-empty list")
    return col.isin(*arg) if ops[0] == "in" else ~col.isin(*arg)


def predicate_fields(p: dict) -> list[str]:
    """Sorted distinct fields a predicate reads."""
    if "field" in p:
        return [p["field"]]
    names: set[str] = set()
    for branch in ("all", "any"):
        for child in p.get(branch, []):
            names.update(predicate_fields(child))
    return sorted(names)


def ordered(rules: Iterable[dict] = RULES, disabled: Iterable[str] = ()) -> list[dict]:
    off = set(disabled)
    return sorted((r for r in rules if r["id"] not in off), key=lambda r: r["priority"])


def winner(rules: Iterable[dict] = RULES, disabled: Iterable[str] = ()) -> Column:
    """STRUCT<action, rule_id, kind> of the first matching rule, or the fallback."""

    def verdict(action, rule_id, kind):
        return F.struct(F.lit(action).alias("action"), F.lit(rule_id).alias("rule_id"), F.lit(kind).alias("kind"))

    chain = None
    for r in ordered(rules, disabled):
        hit, out = compile_predicate(r["predicate"]), verdict(r["action"], r["id"], r["kind"])
        chain = F.when(hit, out) if chain is None else chain.when(hit, out)
    last = verdict(FALLBACK, "FALLBACK", "evidence_request")
    return last if chain is None else chain.otherwise(last)


def resolve(routes: DataFrame, rules: Iterable[dict] = RULES, disabled: Iterable[str] = ()) -> DataFrame:
    return routes.withColumn("_w", winner(rules, disabled)).select(
        "*", F.col("_w.action").alias("audited_action"), F.col("_w.rule_id").alias("matched_rule_id"),
        F.col("_w.kind").alias("matched_rule_kind")).drop("_w")


def _by_action(column: str, which: int) -> Column:
    out = None
    for action, texts in ACTIONS.items():
        hit = F.col(column) == action
        out = F.when(hit, texts[which]) if out is None else out.when(hit, texts[which])
    return out


def decide(routes: DataFrame, rules: Iterable[dict] = RULES) -> DataFrame:
    """Decision record: action, labels, rule, decisive fields and their values."""
    rules = list(rules)
    d = resolve(routes, rules)
    fields, values = None, None
    for r in rules:
        names = predicate_fields(r["predicate"])
        hit = F.col("matched_rule_id") == r["id"]
        f, v = F.array(*map(F.lit, names)), F.array(*map(F.col, names))
        fields = F.when(hit, f) if fields is None else fields.when(hit, f)
        values = F.when(hit, v) if values is None else values.when(hit, v)
    none = F.array().cast("array<string>")
    return (
        d.withColumn("audited_decision_en", _by_action("audited_action", 0))
        .withColumn("audited_decision_zh", _by_action("audited_action", 1))
        .withColumn("decisive_fields", fields.otherwise(none))
        .withColumn("decisive_values", F.map_from_arrays("decisive_fields", values.otherwise(none)))
        .withColumn("decision_changed", F.col("naive_action") != F.col("audited_action"))
    )


def trace(routes: DataFrame, rules: Iterable[dict] = RULES) -> DataFrame:
    """One row per (route, rule): matched flag, observed values, winner flag.

    The rules are literals in an array, so this is a narrow explode, no join.
    """
    rules = ordered(rules)
    steps = []
    earlier = F.lit(False)
    for r in rules:
        hit = compile_predicate(r["predicate"])
        steps.append(F.struct(
            F.lit(r["id"]).alias("rule_id"), F.lit(r["priority"]).alias("priority"), hit.alias("matched"),
            (hit & ~earlier).alias("wins"),
            F.concat_ws("|", *[F.concat(F.lit(f + "="), F.col(f)) for f in predicate_fields(r["predicate"])]).alias("observed"),
        ))
        earlier = earlier | hit
    return routes.select("id", F.explode(F.array(*steps)).alias("s")).select("id", "s.*")


def ablation(routes: DataFrame, rules: Iterable[dict] = RULES) -> DataFrame:
    """Per rule: how many routes change action when that rule is disabled.

    All ablated resolvers are columns of one pass; only counts are shuffled.
    """
    rules = list(rules)
    base = winner(rules)["action"]
    per = F.array(*[
        F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r["kind"]).alias("kind"), base.alias("base"),
                 winner(rules, [r["id"]])["action"].alias("ablated")) for r in rules])
    return (
        routes.select(F.explode(per).alias("s")).select("s.*")
        .groupBy("rule_id", "kind")
        .agg(F.count(F.lit(1)).alias("routes"), F.count_if(F.col("base") != F.col("ablated")).alias("routes_changed"))
    )


def set_field(routes: DataFrame, dotted: str, value: str) -> DataFrame:
    """Counterfactual record: replace one (possibly nested) field."""
    head, _, tail = dotted.partition(".")
    new = F.col(head).withField(tail, F.lit(value)) if tail else F.lit(value)
    return routes.withColumn(head, new)


def probe(routes: DataFrame, changes: dict[str, str], rules: Iterable[dict] = RULES) -> DataFrame:
    """Resolve every route before and after a set of field changes."""
    changed = resolve(routes, rules).withColumnsRenamed(
        {"audited_action": "before_action", "matched_rule_id": "before_rule", "matched_rule_kind": "before_kind"})
    for dotted, value in changes.items():
        changed = set_field(changed, dotted, value)
    return resolve(changed, rules).withColumnsRenamed({"audited_action": "after_action", "matched_rule_id": "after_rule"})


def rule_set_violations(rules: Iterable[dict], legal: Iterable[str], evidence: Iterable[str]) -> list[tuple[str, str]]:
    """Problems of a rule document as (rule id, problem) pairs; empty when sound."""
    rules, legal = list(rules), set(legal)
    out: list[tuple[str, str]] = []
    ids, used = [r["id"] for r in rules], set()
    priorities = [r["priority"] for r in rules]
    for r in rules:
        names = set(predicate_fields(r["predicate"]))
        used |= names
        if ids.count(r["id"]) > 1:
            out.append((r["id"], "duplicate id"))
        if priorities.count(r["priority"]) > 1:
            out.append((r["id"], "duplicate priority"))
        if r["kind"] not in ("constraint", "permission"):
            out.append((r["id"], "unknown kind"))
        if r["action"] not in ACTIONS:
            out.append((r["id"], "unknown action"))
        out.extend((r["id"], f"unknown field {n}") for n in sorted(names - legal))
    out.extend(("*", f"unused evidence field {n}") for n in sorted(set(evidence) - used))
    return out
