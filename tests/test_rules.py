"""Rule engine on worked records, every field value, ablation and malformed documents."""

import copy

import pytest
from pyspark.sql import functions as F

from chronaxis.operators import rules as R
from chronaxis.sources.rulebook import CAPABILITIES, EVIDENCE, FALLBACK, ROUTE_FIELDS, RULES, STAGES

LEGAL = ROUTE_FIELDS + [f"evidence.{e}" for e in EVIDENCE]
NAMES = [f"evidence.{e}" for e in EVIDENCE]
CASES = {
    "trace": (("OFFLINE_ESTIMATION", "AVAILABLE", "PARTIAL", "NOT_APPLICABLE", "PROXY_ONLY", "NOT_APPLICABLE", "NOT_APPLICABLE", "NOT_APPLICABLE", "NOT_TESTED", "NOT_TESTED", "NOT_ASSESSABLE"), "R1_SCOPE_MATCH"),
    "sensing": (("OPTIONAL_ACQUISITION", "AVAILABLE", "PARTIAL", "NO_DEMONSTRATED_INCREMENT", "PROXY_ONLY", "PROXIMAL_ONLY", "NOT_APPLICABLE", "PARTIAL", "NOT_TESTED", "NOT_TESTED", "NOT_ASSESSABLE"), "R2_COMPARATOR_INCREMENT"),
    "signed": (("CONSEQUENTIAL_PERSONALIZATION", "AVAILABLE", "PARTIAL", "SUPPORTED", "PROXY_ONLY", "PROXIMAL_ONLY", "NOT_TESTED", "REVERSIBLE", "NOT_TESTED", "NOT_REQUIRED", "NOT_ASSESSABLE"), "R3_CONSEQUENCE_MATCH"),
    "retention": (("RETENTION_TRANSFER", "AVAILABLE", "PARTIAL", "NOT_APPLICABLE", "NOT_TESTED", "NOT_TESTED", "NOT_TESTED", "PARTIAL", "NOT_TESTED", "NOT_TESTED", "NOT_ASSESSABLE"), "R4_RETENTION_TRANSFER"),
    "granted": (("REVERSIBLE_PERSONALIZATION", "AVAILABLE", "MATCHED", "SUPPORTED", "CASE_STUDY_IN_USE", "DIRECT_USER_EXPERIENCE", "SUPPORTED", "PARTIAL", "SUPPORTED", "SUPPORTED", "SUPPORTED"), "R5_BOUNDED_PASS"),
    "open": (("OFFLINE_ESTIMATION", "NOT_AVAILABLE", "MATCHED", "SUPPORTED", "PROXY_ONLY", "NOT_TESTED", "PARTIAL", "PARTIAL", "PARTIAL", "PARTIAL", "PARTIAL"), "FALLBACK"),
}


def frame(spark, rows):
    flat = spark.createDataFrame([(k, *v) for k, v in rows], "id string, deployment_stage string, route_capability string, " + ", ".join(f"{e} string" for e in EVIDENCE))
    return flat.select("id", "deployment_stage", "route_capability", F.struct(*EVIDENCE).alias("evidence"))


def plain(values):
    rec = dict(zip(["deployment_stage", "route_capability", *NAMES], values))

    def holds(p):
        if "all" in p:
            return all(map(holds, p["all"]))
        if "any" in p:
            return any(map(holds, p["any"]))
        return rec[p["field"]] == p["eq"] if "eq" in p else rec[p["field"]] in p["in"]

    return next((r["id"] for r in sorted(RULES, key=lambda r: r["priority"]) if holds(r["predicate"])), "FALLBACK")


def test_worked_records(spark):
    got = {r.id: r.matched_rule_id for r in R.resolve(frame(spark, [(k, v) for k, (v, _) in CASES.items()])).collect()}
    assert got == {k: want for k, (_, want) in CASES.items()}


def test_every_single_field_value(spark):
    vocab = [STAGES, CAPABILITIES, *EVIDENCE.values()]
    rows = {f"{k}:{i}:{value}": v[:i] + (value,) + v[i + 1:] for k, (v, _) in CASES.items() for i, words in enumerate(vocab) for value in words}
    got = {r.id: r.matched_rule_id for r in R.resolve(frame(spark, rows.items())).collect()}
    assert got == {k: plain(v) for k, v in rows.items()}


def test_trace_marks_one_winner_and_ablation_removes_it(spark):
    routes = frame(spark, [(k, v) for k, (v, _) in CASES.items()])
    wins = R.trace(routes).filter("wins").groupBy("id").count().collect()
    assert all(r["count"] == 1 for r in wins) and len(wins) == 5
    assert all(r.routes_changed >= 1 for r in R.ablation(routes).collect())
    gone = R.resolve(routes, disabled=["R5_BOUNDED_PASS"]).filter("id = 'granted'").first()
    assert gone.audited_action == FALLBACK


def test_rule_order_in_the_document_does_not_matter(spark):
    routes = frame(spark, [(k, v) for k, (v, _) in CASES.items()])
    a = R.resolve(routes).orderBy("id").collect()
    assert a == R.resolve(routes, list(reversed(RULES))).orderBy("id").collect()


def test_leaf_forms(spark):
    df = spark.createDataFrame([("x",), ("y",)], "f string")
    assert df.filter(R.compile_predicate({"field": "f", "not_in": ["x"]})).count() == 1
    for bad in ({"field": "f"}, {"field": "f", "eq": "x", "in": ["x"]}, {"field": "f", "in": []}, {"all": []}):
        with pytest.raises(ValueError):
            R.compile_predicate(bad)


def test_malformed_rule_sets_are_reported():
    assert R.rule_set_violations(RULES, LEGAL, NAMES) == []
    twice = copy.deepcopy(RULES)
    twice[1]["id"] = twice[0]["id"]
    assert any(p == "duplicate id" for _, p in R.rule_set_violations(twice, LEGAL, NAMES))
    magic = copy.deepcopy(RULES)
    magic[0]["predicate"] = {"field": "evidence.magic", "eq": "SUPPORTED"}
    found = [p for _, p in R.rule_set_violations(magic, LEGAL, NAMES)]
    assert "unknown field evidence.magic" in found and any(p.startswith("unused") for p in found)
