"""The route-audit rule document: vocabularies, actions and rules.

Fixed values.  They decide the results, so they are stated as they are.
"""

from __future__ import annotations

EVIDENCE = {
    "interpretation_scope": ["MATCHED", "PARTIAL", "NOT_TESTED", "NOT_APPLICABLE"],
    "comparator_increment": ["SUPPORTED", "PARTIAL", "NO_DEMONSTRATED_INCREMENT", "NOT_TESTED", "NOT_APPLICABLE"],
    "evaluation_mode": ["IN_CONTEXT_USER_STUDY", "TECHNICAL_AND_EMPIRICAL_EVALUATION", "CASE_STUDY_IN_USE",
                        "LONGITUDINAL_FIELD_USE", "PROXY_ONLY", "VIGNETTE_ONLY", "NOT_TESTED", "NOT_APPLICABLE"],
    "user_outcome": ["DIRECT_TASK_AND_EXPERIENCE", "DIRECT_USER_EXPERIENCE", "PROXIMAL_ONLY", "PREFERENCE_ONLY",
                     "NOT_TESTED", "NOT_APPLICABLE"],
    "user_control": ["SUPPORTED", "PARTIAL", "NOT_TESTED", "NOT_REPORTED", "NOT_APPLICABLE"],
    "safety_reversibility": ["USER_CONTROLLED", "REVERSIBLE", "PARTIAL", "NOT_TESTED", "NOT_APPLICABLE"],
    "persistence": ["SUPPORTED", "PARTIAL", "NOT_TESTED", "NOT_REQUIRED"],
    "transfer": ["SUPPORTED", "PARTIAL", "NOT_TESTED", "NOT_REQUIRED"],
    "reference_equity": ["SUPPORTED", "PARTIAL", "NOT_ASSESSABLE", "NOT_REQUIRED"],
}
STAGES = ["OFFLINE_ESTIMATION", "OPTIONAL_ACQUISITION", "REVERSIBLE_PERSONALIZATION",
          "CONSEQUENTIAL_PERSONALIZATION", "RETENTION_TRANSFER"]
CAPABILITIES = ["AVAILABLE", "PARTIAL", "NOT_AVAILABLE"]
ROUTE_FIELDS = ["id", "source_id", "label_en", "label_zh", "proposed_use_en", "proposed_use_zh", "deployment_stage",
                "route_capability", "evidence", "evidence_basis_en", "evidence_basis_zh", "source_locator", "naive_action"]
ACTIONS = {
    "BOUND_TO_EVIDENCE_SCOPE": ("Use the route only inside its evaluated evidence boundary", "仅在已评估证据边界内使用该路径"),
    "RETAIN_EVALUATED_COMPARATOR": ("Retain the evaluated comparator for this route", "为该路径保留已评估的比较方案"),
    "RUN_PREREGISTERED_USER_STUDY": ("Run a preregistered in-context user study before deployment", "部署前开展预注册的情境内用户研究"),
    "WITHHOLD_RETENTION_AND_TRANSFER": ("Withhold durable retention and cross-context transfer", "不进行持久保留与跨情境迁移"),
    "PROCEED_WITHIN_EVALUATED_BOUNDARY": ("Proceed with personalization inside the evaluated boundary", "在已评估边界内实施个性化"),
    "REQUIRE_ROUTE_SPECIFIC_EVIDENCE": ("Collect the route-specific evidence named by the unresolved record", "补充未决记录所指明的路径特定证据"),
}
FALLBACK = "REQUIRE_ROUTE_SPECIFIC_EVIDENCE"


def _leaf(field: str, **op) -> dict:
    return {"field": field, **op}


RULES = [
    {"id": "R4_RETENTION_TRANSFER", "priority": 10, "kind": "constraint", "action": "WITHHOLD_RETENTION_AND_TRANSFER",
     "predicate": {"all": [
         _leaf("deployment_stage", eq="RETENTION_TRANSFER"),
         {"any": [
             _leaf("evidence.persistence", **{"in": ["PARTIAL", "NOT_TESTED"]}),
             _leaf("evidence.transfer", **{"in": ["PARTIAL", "NOT_TESTED"]}),
             _leaf("evidence.reference_equity", **{"in": ["PARTIAL", "NOT_ASSESSABLE"]})]}]}},
    {"id": "R2_COMPARATOR_INCREMENT", "priority": 20, "kind": "constraint", "action": "RETAIN_EVALUATED_COMPARATOR",
     "predicate": _leaf("evidence.comparator_increment", eq="NO_DEMONSTRATED_INCREMENT")},
    {"id": "R3_CONSEQUENCE_MATCH", "priority": 30, "kind": "constraint", "action": "RUN_PREREGISTERED_USER_STUDY",
     "predicate": {"all": [
         _leaf("deployment_stage", **{"in": ["REVERSIBLE_PERSONALIZATION", "CONSEQUENTIAL_PERSONALIZATION"]}),
         {"any": [
             _leaf("evidence.evaluation_mode", **{"in": ["PROXY_ONLY", "VIGNETTE_ONLY", "NOT_TESTED"]}),
             _leaf("evidence.user_outcome", **{"in": ["PROXIMAL_ONLY", "PREFERENCE_ONLY", "NOT_TESTED"]})]}]}},
    {"id": "R1_SCOPE_MATCH", "priority": 40, "kind": "constraint", "action": "BOUND_TO_EVIDENCE_SCOPE",
     "predicate": {"all": [
         _leaf("route_capability", eq="AVAILABLE"),
         _leaf("evidence.interpretation_scope", **{"in": ["PARTIAL", "NOT_TESTED"]})]}},
    {"id": "R5_BOUNDED_PASS", "priority": 90, "kind": "permission", "action": "PROCEED_WITHIN_EVALUATED_BOUNDARY",
     "predicate": {"all": [
         _leaf("deployment_stage", eq="REVERSIBLE_PERSONALIZATION"),
         _leaf("route_capability", eq="AVAILABLE"),
         _leaf("evidence.interpretation_scope", eq="MATCHED"),
         _leaf("evidence.comparator_increment", **{"in": ["SUPPORTED", "PARTIAL", "NOT_APPLICABLE"]}),
         _leaf("evidence.evaluation_mode", **{"in": [
             "IN_CONTEXT_USER_STUDY", "TECHNICAL_AND_EMPIRICAL_EVALUATION", "CASE_STUDY_IN_USE", "LONGITUDINAL_FIELD_USE"]}),
         _leaf("evidence.user_outcome", **{"in": ["DIRECT_TASK_AND_EXPERIENCE", "DIRECT_USER_EXPERIENCE"]}),
         {"any": [
             _leaf("evidence.user_control", eq="SUPPORTED"),
             _leaf("evidence.safety_reversibility", **{"in": ["USER_CONTROLLED", "REVERSIBLE"]})]}]}},
]
