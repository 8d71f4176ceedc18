"""Rule evaluation, probes, ablation and record validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import rules as R
from ..sources.routes import routes
from ..sources.rulebook import ACTIONS, CAPABILITIES, EVIDENCE, FALLBACK, ROUTE_FIELDS, RULES, STAGES
from .registry import query


def _list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _cyc(values, expr):
    return f"list_extract({_list(values)}, CAST(({expr}) % {len(values)} AS BIGINT) + 1)"


ROUTES = f"""routes AS (
 SELECT o_orderkey AS id, 'src' || CAST(o_custkey % 6 AS VARCHAR) AS source_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'REVERSIBLE_PERSONALIZATION' WHEN '2-HIGH' THEN 'CONSEQUENTIAL_PERSONALIZATION'
   WHEN '3-MEDIUM' THEN 'OFFLINE_ESTIMATION' WHEN '4-NOT SPECIFIED' THEN 'OPTIONAL_ACQUISITION' WHEN '5-LOW' THEN 'RETENTION_TRANSFER' END AS deployment_stage,
  CASE WHEN o_orderkey % 7 = 0 THEN 'NOT_AVAILABLE' ELSE 'AVAILABLE' END AS route_capability,
  CASE o_orderstatus WHEN 'F' THEN 'MATCHED' WHEN 'O' THEN 'PARTIAL' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'NOT_TESTED' ELSE 'MATCHED' END END AS interpretation_scope,
  {_cyc(EVIDENCE['comparator_increment'], 'CAST(floor(o_totalprice) AS BIGINT)')} AS comparator_increment,
  {_cyc(EVIDENCE['evaluation_mode'], 'o_custkey')} AS evaluation_mode,
  {_cyc(EVIDENCE['user_outcome'], 'o_orderkey')} AS user_outcome,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'SUPPORTED' WHEN 'BUILDING' THEN 'PARTIAL' WHEN 'FURNITURE' THEN 'NOT_TESTED'
   WHEN 'HOUSEHOLD' THEN 'NOT_REPORTED' WHEN 'MACHINERY' THEN 'NOT_APPLICABLE' END AS user_control,
  {_cyc(EVIDENCE['safety_reversibility'], 'c_nationkey')} AS safety_reversibility,
  {_cyc(EVIDENCE['persistence'], 'o_orderkey // 4')} AS persistence,
  {_cyc(EVIDENCE['transfer'], 'o_custkey // 3')} AS transfer,
  {_cyc(EVIDENCE['reference_equity'], 'o_orderkey // 16')} AS reference_equity,
  'doi:10.' || CAST(o_custkey AS VARCHAR) || CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE '#s' END || CAST(o_orderkey AS VARCHAR) AS source_locator,
  {_cyc(list(ACTIONS), 'o_orderkey')} AS naive_action
 FROM orders JOIN customer ON o_custkey = c_custkey)"""

M = {
    "R4_RETENTION_TRANSFER": "(deployment_stage = 'RETENTION_TRANSFER' AND (persistence IN ('PARTIAL','NOT_TESTED') OR transfer IN ('PARTIAL','NOT_TESTED') OR reference_equity IN ('PARTIAL','NOT_ASSESSABLE')))",
    "R2_COMPARATOR_INCREMENT": "(comparator_increment = 'NO_DEMONSTRATED_INCREMENT')",
    "R3_CONSEQUENCE_MATCH": "(deployment_stage IN ('REVERSIBLE_PERSONALIZATION','CONSEQUENTIAL_PERSONALIZATION') AND (evaluation_mode IN ('PROXY_ONLY','VIGNETTE_ONLY','NOT_TESTED') OR user_outcome IN ('PROXIMAL_ONLY','PREFERENCE_ONLY','NOT_TESTED')))",
    "R1_SCOPE_MATCH": "(route_capability = 'AVAILABLE' AND interpretation_scope IN ('PARTIAL','NOT_TESTED'))",
    "R5_BOUNDED_PASS": "(deployment_stage = 'REVERSIBLE_PERSONALIZATION' AND route_capability = 'AVAILABLE' AND interpretation_scope = 'MATCHED' AND comparator_increment IN ('SUPPORTED','PARTIAL','NOT_APPLICABLE') AND evaluation_mode IN ('IN_CONTEXT_USER_STUDY','TECHNICAL_AND_EMPIRICAL_EVALUATION','CASE_STUDY_IN_USE','LONGITUDINAL_FIELD_USE') AND user_outcome IN ('DIRECT_TASK_AND_EXPERIENCE','DIRECT_USER_EXPERIENCE') AND (user_control = 'SUPPORTED' OR safety_reversibility IN ('USER_CONTROLLED','REVERSIBLE')))",
}
ACT = {"R4_RETENTION_TRANSFER": "WITHHOLD_RETENTION_AND_TRANSFER", "R2_COMPARATOR_INCREMENT": "RETAIN_EVALUATED_COMPARATOR",
       "R3_CONSEQUENCE_MATCH": "RUN_PREREGISTERED_USER_STUDY", "R1_SCOPE_MATCH": "BOUND_TO_EVIDENCE_SCOPE",
       "R5_BOUNDED_PASS": "PROCEED_WITHIN_EVALUATED_BOUNDARY"}
KIND = {r: ("permission" if r.startswith("R5") else "constraint") for r in M}


def case_sql(what: dict[str, str], default: str, skip: str = "") -> str:
    return "CASE " + " ".join(f"WHEN {M[r]} THEN '{what[r]}'" for r in M if r != skip) + f" ELSE '{default}' END"


RULE = case_sql({r: r for r in M}, "FALLBACK")
ACTION = case_sql(ACT, FALLBACK)
DECIDED = f"decided AS (SELECT *, {RULE} AS rule_id, {ACTION} AS action FROM routes)"
W = "WITH " + ROUTES + "\n"
WD = "WITH " + ROUTES + ",\n" + DECIDED + "\n"


@query("flt1_rule_predicates", W + "SELECT id, " + ", ".join(f"{M[r]} AS {r.lower()}" for r in M) + " FROM routes")
def _(spark, sf):
    return routes(spark, sf).select("id", *[
        R.compile_predicate(r["predicate"]).alias(r["id"].lower()) for r in R.ordered()])


@query("flt2_referenced_fields", WD + """, f AS (SELECT * FROM (VALUES
 ('R1_SCOPE_MATCH', ['evidence.interpretation_scope','route_capability']),
 ('R2_COMPARATOR_INCREMENT', ['evidence.comparator_increment']),
 ('R3_CONSEQUENCE_MATCH', ['deployment_stage','evidence.evaluation_mode','evidence.user_outcome']),
 ('R4_RETENTION_TRANSFER', ['deployment_stage','evidence.persistence','evidence.reference_equity','evidence.transfer']),
 ('R5_BOUNDED_PASS', ['deployment_stage','evidence.comparator_increment','evidence.evaluation_mode','evidence.interpretation_scope','evidence.safety_reversibility','evidence.user_control','evidence.user_outcome','route_capability']),
 ('FALLBACK', [])) v(rule_id, fields))
SELECT rule_id, array_to_string(any_value(fields), ',') AS fields, count(*) AS routes FROM decided JOIN f USING (rule_id) GROUP BY rule_id""")
def _(spark, sf):
    d = R.decide(routes(spark, sf))
    return d.groupBy(F.col("matched_rule_id").alias("rule_id")).agg(
        F.concat_ws(",", F.first("decisive_fields")).alias("fields"), F.count(F.lit(1)).alias("routes"))


@query("flt3_priority_resolver", WD + "SELECT id, action AS audited_action, rule_id AS matched_rule_id FROM decided")
def _(spark, sf):
    return R.resolve(routes(spark, sf)).select("id", "audited_action", "matched_rule_id")


@query("flt4_decision_records", WD + ", labels_t AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{a}', '{t[0]}', '{t[1]}')" for a, t in ACTIONS.items()) + f""") v(action, en, zh))
SELECT id, action AS audited_action, en AS audited_decision_en, zh AS audited_decision_zh, rule_id AS matched_rule_id,
 {case_sql(KIND, 'evidence_request')} AS matched_rule_kind, naive_action <> action AS decision_changed,
 CASE rule_id WHEN 'R2_COMPARATOR_INCREMENT' THEN 'evidence.comparator_increment=' || comparator_increment
  WHEN 'R1_SCOPE_MATCH' THEN 'evidence.interpretation_scope=' || interpretation_scope || '|route_capability=' || route_capability
  WHEN 'R3_CONSEQUENCE_MATCH' THEN 'deployment_stage=' || deployment_stage || '|evidence.evaluation_mode=' || evaluation_mode || '|evidence.user_outcome=' || user_outcome
  WHEN 'R4_RETENTION_TRANSFER' THEN 'deployment_stage=' || deployment_stage || '|evidence.persistence=' || persistence || '|evidence.reference_equity=' || reference_equity || '|evidence.transfer=' || transfer
  WHEN 'R5_BOUNDED_PASS' THEN concat_ws('|', 'deployment_stage=' || deployment_stage, 'evidence.comparator_increment=' || comparator_increment, 'evidence.evaluation_mode=' || evaluation_mode, 'evidence.interpretation_scope=' || interpretation_scope, 'evidence.safety_reversibility=' || safety_reversibility, 'evidence.user_control=' || user_control, 'evidence.user_outcome=' || user_outcome, 'route_capability=' || route_capability)
  ELSE '' END AS decisive
FROM decided JOIN labels_t USING (action)""")
def _(spark, sf):
    d = R.decide(routes(spark, sf))
    text = F.concat_ws("|", F.transform(F.map_entries("decisive_values"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return d.select("id", "audited_action", "audited_decision_en", "audited_decision_zh", "matched_rule_id",
                    "matched_rule_kind", "decision_changed", text.alias("decisive"))


PRIO = {r["id"]: r["priority"] for r in RULES}
_TRACE = " UNION ALL ".join(f"SELECT id, '{r}' AS rule_id, {PRIO[r]} AS priority, {M[r]} AS matched, rule_id = '{r}' AS wins FROM decided" for r in M)


@query("flt5_decision_trace", WD + _TRACE)
def _(spark, sf):
    return R.trace(routes(spark, sf)).select("id", "rule_id", "priority", "matched", "wins")


@query("flt6_rule_ablation", W + " UNION ALL ".join(
    f"SELECT '{r}' AS rule_id, '{KIND[r]}' AS kind, count(*) AS routes, count(*) FILTER (({ACTION}) <> ({case_sql(ACT, FALLBACK, r)})) AS routes_changed FROM routes" for r in M))
def _(spark, sf):
    return R.ablation(routes(spark, sf))


@query("flt9_record_mutation", W + f""", m AS (SELECT * REPLACE ('NO_DEMONSTRATED_INCREMENT' AS comparator_increment) FROM routes),
b AS (SELECT id, {ACTION} AS before_action FROM routes), a AS (SELECT id, {ACTION} AS after_action, {RULE} AS after_rule FROM m)
SELECT id, before_action, after_action, after_rule FROM b JOIN a USING (id)""")
def _(spark, sf):
    return R.probe(routes(spark, sf), {"evidence.comparator_increment": "NO_DEMONSTRATED_INCREMENT"}).select(
        "id", "before_action", "after_action", "after_rule")


PROBES = {
    "capability": {"route_capability": "NOT_AVAILABLE"},
    "scope": {"evidence.interpretation_scope": "PARTIAL"},
    "comparator": {"evidence.comparator_increment": "NO_DEMONSTRATED_INCREMENT"},
    "evaluation": {"evidence.evaluation_mode": "PROXY_ONLY"},
    "outcome": {"evidence.user_outcome": "PROXIMAL_ONLY"},
    "control_or_reversibility": {"evidence.user_control": "NOT_TESTED", "evidence.safety_reversibility": "NOT_TESTED"},
}


def _replace(changes):
    return "SELECT * REPLACE (" + ", ".join(f"'{v}' AS {k.split('.')[-1]}" for k, v in changes.items()) + ") FROM decided WHERE rule_id = 'R5_BOUNDED_PASS'"


@query("flt10_permission_boundary", WD + " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, count(*) AS probes, count(*) FILTER (({ACTION}) <> 'PROCEED_WITHIN_EVALUATED_BOUNDARY') AS passed FROM ({_replace(c)})"
    for d, c in PROBES.items()))
def _(spark, sf):
    base = R.resolve(routes(spark, sf)).filter(F.col("matched_rule_id") == "R5_BOUNDED_PASS")
    base = base.drop("audited_action", "matched_rule_id", "matched_rule_kind")
    # All probes of a route are literals of one pass over the permitted routes.
    parts = [R.resolve(reduce(lambda d, kv: R.set_field(d, *kv), c.items(), base)).select(
        F.lit(name).alias("dimension"), "audited_action") for name, c in PROBES.items()]
    both = reduce(lambda a, b: a.unionByName(b), parts)
    return both.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("probes"),
        F.count_if(F.col("audited_action") != "PROCEED_WITHIN_EVALUATED_BOUNDARY").alias("passed"))


PRECEDENCE = [("R2_over_R1", "R1_SCOPE_MATCH", {"evidence.comparator_increment": "NO_DEMONSTRATED_INCREMENT"}, "R2_COMPARATOR_INCREMENT"),
              ("R2_over_R3", "R3_CONSEQUENCE_MATCH", {"evidence.comparator_increment": "NO_DEMONSTRATED_INCREMENT"}, "R2_COMPARATOR_INCREMENT"),
              ("R3_over_R1", "R3_CONSEQUENCE_MATCH", {"evidence.interpretation_scope": "PARTIAL"}, "R3_CONSEQUENCE_MATCH"),
              ("R4_over_R2_and_R1", "R4_RETENTION_TRANSFER", {"evidence.comparator_increment": "NO_DEMONSTRATED_INCREMENT"}, "R4_RETENTION_TRANSFER")]


@query("flt10_precedence", WD + " UNION ALL ".join(
    "SELECT '%s' AS probe, count(*) AS probes, count(*) FILTER ((%s) = '%s') AS passed FROM (SELECT * EXCLUDE (rule_id, action) REPLACE (%s) FROM decided WHERE rule_id = '%s')"
    % (n, RULE, want, ", ".join(f"'{v}' AS {k.split('.')[-1]}" for k, v in ch.items()), start) for n, start, ch, want in PRECEDENCE))
def _(spark, sf):
    d = R.resolve(routes(spark, sf)).withColumnRenamed("matched_rule_id", "start").drop("audited_action", "matched_rule_kind")
    parts = []
    for name, start, changes, want in PRECEDENCE:
        m = reduce(lambda x, kv: R.set_field(x, *kv), changes.items(), d.filter(F.col("start") == start))
        parts.append(R.resolve(m).select(F.lit(name).alias("probe"), (F.col("matched_rule_id") == want).alias("ok")))
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("probe").agg(
        F.count(F.lit(1)).alias("probes"), F.count_if("ok").alias("passed"))


LOCALITY = [("R1_SCOPE_MATCH", "evidence.user_control", "SUPPORTED"), ("R2_COMPARATOR_INCREMENT", "evidence.user_control", "SUPPORTED"),
            ("R3_CONSEQUENCE_MATCH", "evidence.persistence", "SUPPORTED"), ("R4_RETENTION_TRANSFER", "evidence.comparator_increment", "SUPPORTED"),
            ("R5_BOUNDED_PASS", "evidence.persistence", "SUPPORTED")]


@query("flt10_locality", WD + " UNION ALL ".join(
    f"SELECT '{r}' AS rule_id, '{f}' AS field, count(*) AS probes, count(*) FILTER (({ACTION}) = old_action) AS unchanged FROM (SELECT * EXCLUDE (rule_id, action) REPLACE ('{v}' AS {f.split('.')[-1]}), action AS old_action FROM decided WHERE rule_id = '{r}')"
    for r, f, v in LOCALITY))
def _(spark, sf):
    base = routes(spark, sf)
    parts = [R.probe(base, {f: v}).filter(F.col("before_rule") == r).select(
        F.lit(r).alias("rule_id"), F.lit(f).alias("field"), (F.col("before_action") == F.col("after_action")).alias("same"))
        for r, f, v in LOCALITY]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("rule_id", "field").agg(
        F.count(F.lit(1)).alias("probes"), F.count_if("same").alias("unchanged"))


@query("st3_unknown_fields", WD + """SELECT rule_id, count(*) AS routes, CAST(0 AS BIGINT) AS unknown_fields,
 CAST(CASE rule_id WHEN 'R1_SCOPE_MATCH' THEN 8 WHEN 'R2_COMPARATOR_INCREMENT' THEN 8 WHEN 'R3_CONSEQUENCE_MATCH' THEN 7
 WHEN 'R4_RETENTION_TRANSFER' THEN 6 WHEN 'R5_BOUNDED_PASS' THEN 3 ELSE 9 END AS BIGINT) AS unread_evidence FROM decided GROUP BY rule_id""")
def _(spark, sf):
    legal = F.array(*[F.lit(f) for f in ROUTE_FIELDS + [f"evidence.{e}" for e in EVIDENCE]])
    names = F.array(*[F.lit(f"evidence.{e}") for e in EVIDENCE])
    return R.decide(routes(spark, sf)).groupBy(F.col("matched_rule_id").alias("rule_id")).agg(
        F.count(F.lit(1)).alias("routes"),
        F.max(F.size(F.array_except("decisive_fields", legal))).cast("long").alias("unknown_fields"),
        F.max(F.size(F.array_except(names, "decisive_fields"))).cast("long").alias("unread_evidence"))


@query("st5_stacked_case_sets", WD + """SELECT 'open' AS case_set, rule_id, count(*) AS routes FROM decided WHERE interpretation_scope <> 'MATCHED' GROUP BY 2
 UNION ALL SELECT 'matched', rule_id, count(*) FROM decided WHERE interpretation_scope = 'MATCHED' GROUP BY 2""")
def _(spark, sf):
    r = R.resolve(routes(spark, sf)).withColumnRenamed("matched_rule_id", "rule_id")
    a = r.filter(F.col("evidence.interpretation_scope") != "MATCHED").select(F.lit("open").alias("case_set"), "rule_id")
    b = r.filter(F.col("evidence.interpretation_scope") == "MATCHED").select("rule_id", F.lit("matched").alias("case_set"))
    return a.unionByName(b).groupBy("case_set", "rule_id").agg(F.count(F.lit(1)).alias("routes"))


@query("st6_action_sets", WD + """SELECT deployment_stage, array_to_string(list_sort(list_distinct(list(action))), ',') AS audited,
 array_to_string(list_sort(list_distinct(list(naive_action))), ',') AS naive,
 CAST(len(list_distinct(list_concat(list(action), list(naive_action)))) AS BIGINT) AS union_size FROM decided GROUP BY 1""")
def _(spark, sf):
    # collect_set over a six-value vocabulary: partial sets stay small.
    g = R.resolve(routes(spark, sf)).groupBy("deployment_stage").agg(
        F.collect_set("audited_action").alias("a"), F.collect_set("naive_action").alias("b"))
    return g.select("deployment_stage", F.concat_ws(",", F.array_sort("a")).alias("audited"),
                    F.concat_ws(",", F.array_sort("b")).alias("naive"),
                    F.size(F.array_union("a", "b")).cast("long").alias("union_size"))


def _in(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# Damaged copies of the routes: every 10th id breaks one rule of the record format.
DAMAGE = f"""damaged AS (SELECT * REPLACE (
 CASE WHEN id % 10 = 1 THEN 'ASSERTED_VALID' ELSE interpretation_scope END AS interpretation_scope,
 CASE WHEN id % 10 = 2 THEN 'LAUNCH' ELSE deployment_stage END AS deployment_stage,
 CASE WHEN id % 10 = 3 THEN 'MAYBE' ELSE route_capability END AS route_capability,
 CASE WHEN id % 10 = 4 THEN NULL ELSE user_outcome END AS user_outcome,
 CASE WHEN id % 10 = 5 THEN 'invented' ELSE source_id END AS source_id),
 CASE WHEN id % 10 = 6 THEN 'BOUND_TO_EVIDENCE_SCOPE' END AS expected_action FROM routes),
flagged AS (SELECT id, unnest([
 CASE WHEN deployment_stage NOT IN {_in(STAGES)} THEN 'unknown stage' END,
 CASE WHEN route_capability NOT IN {_in(CAPABILITIES)} THEN 'unknown capability' END,
 CASE WHEN expected_action IS NOT NULL THEN 'encodes its own answer' END,
 CASE WHEN source_id NOT IN ('src0','src1','src2','src3','src4','src5') THEN 'unknown source' END,
 CASE WHEN source_locator NOT LIKE 'doi:10.%' OR source_locator NOT LIKE '%#%' THEN 'locator form' END,
""" + ",\n".join(f" CASE WHEN {e} IS NULL OR {e} NOT IN {_in(v)} THEN 'illegal {e}' END" for e, v in EVIDENCE.items()) + """]) AS problem FROM damaged)"""


def damaged(spark, sf):
    i = F.col("id") % 10
    r = routes(spark, sf)
    e = F.col("evidence")
    return r.withColumn("evidence", e.withField(
        "interpretation_scope", F.when(i == 1, "ASSERTED_VALID").otherwise(e["interpretation_scope"])).withField(
        "user_outcome", F.when(i != 4, e["user_outcome"]))) \
        .withColumn("deployment_stage", F.when(i == 2, "LAUNCH").otherwise(F.col("deployment_stage"))) \
        .withColumn("route_capability", F.when(i == 3, "MAYBE").otherwise(F.col("route_capability"))) \
        .withColumn("source_id", F.when(i == 5, "invented").otherwise(F.col("source_id"))) \
        .withColumn("expected_action", F.when(i == 6, "BOUND_TO_EVIDENCE_SCOPE"))


def record_problems(r):
    """One row per (record, problem); a sound record gives none."""
    checks = [
        F.when(~F.col("deployment_stage").isin(STAGES), "unknown stage"),
        F.when(~F.col("route_capability").isin(CAPABILITIES), "unknown capability"),
        F.when(F.col("expected_action").isNotNull(), "encodes its own answer"),
        F.when(~F.col("source_id").isin([f"src{i}" for i in range(6)]), "unknown source"),
        F.when(~F.col("source_locator").startswith("doi:10.") | ~F.col("source_locator").contains("#"), "locator form"),
    ] + [F.when(F.col(f"evidence.{e}").isNull() | ~F.col(f"evidence.{e}").isin(v), f"illegal {e}") for e, v in EVIDENCE.items()]
    return r.select("id", F.explode(F.array_compact(F.array(*checks))).alias("problem"))


@query("dq2_record_violations", "WITH " + ROUTES + ",\n" + DAMAGE + "\nSELECT id, problem FROM flagged WHERE problem IS NOT NULL")
def _(spark, sf):
    return record_problems(damaged(spark, sf))


@query("dq3_locator_checks", W + """SELECT source_id, count(*) AS routes,
 count(*) FILTER (source_locator LIKE 'doi:10.%') AS doi_form, count(*) FILTER (source_locator LIKE '%#%') AS anchored,
 count(DISTINCT split_part(source_locator, '#', 1)) AS sources FROM routes GROUP BY source_id""")
def _(spark, sf):
    loc = F.col("source_locator")
    return routes(spark, sf).groupBy("source_id").agg(
        F.count(F.lit(1)).alias("routes"), F.count_if(loc.startswith("doi:10.")).alias("doi_form"),
        F.count_if(loc.contains("#")).alias("anchored"), F.count_distinct(F.substring_index(loc, "#", 1)).alias("sources"))


@query("dq4_malformed_audit", "WITH " + ROUTES + ",\n" + DAMAGE + """
SELECT CAST(id % 10 AS BIGINT) AS kind, count(*) AS records, count(*) FILTER (bad > 0) AS rejected FROM (
 SELECT d.id, count(problem) AS bad FROM damaged d LEFT JOIN flagged f ON f.id = d.id AND f.problem IS NOT NULL GROUP BY d.id)
GROUP BY 1""")
def _(spark, sf):
    d = damaged(spark, sf)
    bad = record_problems(d).select("id").distinct().withColumn("bad", F.lit(True))
    return d.select("id").join(bad, "id", "left").groupBy((F.col("id") % 10).alias("kind")).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("bad")).alias("rejected"))


@query("dq1_rule_set_checks", WD + """SELECT rule_id, count(*) AS routes, CAST(0 AS BIGINT) AS violations FROM decided GROUP BY rule_id""")
def _(spark, sf):
    bad = R.rule_set_violations(RULES, ROUTE_FIELDS + [f"evidence.{e}" for e in EVIDENCE], [f"evidence.{e}" for e in EVIDENCE])
    per = {r["id"]: sum(1 for b in bad if b[0] == r["id"]) for r in RULES}
    count = F.lit(0)
    for rule_id, k in per.items():
        count = F.when(F.col("rule_id") == rule_id, k).otherwise(count)
    return R.resolve(routes(spark, sf)).groupBy(F.col("matched_rule_id").alias("rule_id")).agg(
        F.count(F.lit(1)).alias("routes")).withColumn("violations", count.cast("long"))


@query("cq1_route_audit", WD + """SELECT deployment_stage, rule_id, action, count(*) AS routes,
 count(*) FILTER (naive_action <> action) AS changed, min(id) AS first_id FROM decided GROUP BY 1, 2, 3""")
def route_audit(spark, sf):
    """Validate, resolve and summarize a route table in one pass."""
    d = R.resolve(routes(spark, sf))
    return d.groupBy("deployment_stage", F.col("matched_rule_id").alias("rule_id"), F.col("audited_action").alias("action")).agg(
        F.count(F.lit(1)).alias("routes"), F.count_if(F.col("naive_action") != F.col("audited_action")).alias("changed"),
        F.min("id").alias("first_id"))


@query("uf3_trace_table_function", WD + "SELECT rule_id, count(*) AS matched FROM (" + _TRACE + ") WHERE matched GROUP BY rule_id")
def _(spark, sf):
    return spark.sql("SELECT rule_id, count(*) AS matched FROM {trace} WHERE matched GROUP BY rule_id", trace=R.trace(routes(spark, sf)))


@query("bs16_order_invariance", WD + """SELECT count(*) AS routes, CAST(0 AS BIGINT) AS differing FROM decided""")
def _(spark, sf):
    # The same records in another physical order must give the same decisions.
    base = R.resolve(routes(spark, sf)).select("id", "audited_action", "matched_rule_id")
    other = R.resolve(routes(spark, sf).orderBy(F.xxhash64("id", F.lit(7))), list(reversed(RULES))).select(
        "id", F.col("audited_action").alias("a2"), F.col("matched_rule_id").alias("r2"))
    j = base.join(other, "id", "full_outer")
    same = F.col("audited_action").eqNullSafe(F.col("a2")) & F.col("matched_rule_id").eqNullSafe(F.col("r2"))
    return j.agg(F.count(F.lit(1)).alias("routes"), F.count_if(~same).alias("differing"))
