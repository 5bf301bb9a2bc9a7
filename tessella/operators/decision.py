"""What follows from the gate: the decision with its reasons in words, who it is about, and the replay of stored decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reason codes and what users are told for each.
REASONS = {
    "unknown_intent": "无法确认问题属于当前本地中医知识库可回答的范围。",
    "no_grounded_match": "Qdrant 中没有检索到同时满足本地证据约束的条目。",
    "collection_missing": "结构化方证集合不存在或尚未完成索引。",
    "missing_required_knowledge_groups": "候选知识条目的必要证据字段没有完整命中。",
    "insufficient_knowledge_match": "当前命中的知识要点过少，不能据此形成可靠回答。",
    "translator_needs_more_info": "问题中的症状信息不足，Query Translator 要求继续追问。",
    "no_canonical_terms": "没有从原问题中识别出可由本地 payload 核验的规范术语。",
    "negative_evidence_conflict": "用户明确否认的症状与候选条目发生冲突。",
    "forbidden_evidence_conflict": "候选条目包含与当前问题相冲突的排除性症状。",
    "missing_required_symptom_groups": "候选方证的必要鉴别症状尚未确认。",
    "payload_evidence_confidence_below_threshold": "候选 payload 的证据可信度低于门控阈值。",
    "too_few_payload_matches": "命中的 payload 诊断要素数量不足。",
    "low_query_coverage": "候选条目只能解释用户问题中的少部分表征。",
    "competing_indistinguishable_matches": "存在多个证据接近的候选，当前信息不足以区分。",
    "direct_knowledge_evidence_match": "本地知识条目与查询要点直接匹配。",
    "payload_evidence_requirements_satisfied": "候选 payload 已满足当前证据门控要求。",
}
#: The wording for a failed retrieval and for codes without one, and the summaries by status.
FAILED, OTHER = "检索组件运行失败（{}），为避免无依据回答已停止生成。", "证据门控未通过（{}）。"
SUMMARIES = {
    "grounded_answer": ("answer", "本地证据满足回答条件。"),
    "clarify": ("clarify", "当前暂不提供方药或治疗结论，需要补充信息后重新检索。"),
    "no_match": ("refuse", "当前拒绝回答，以避免使用本地数据库之外的知识补全。"),
}
SATISFIED = "payload_evidence_requirements_satisfied"
POLICY = "payload_evidence_v1"
#: The first of these fields that holds something names what a payload is about.
NAMED_BY = ("formula", "herb_name", "intervention_name", "title", "entry_id")


def _worded(template: str, value: Column) -> Column:
    before, after = template.split("{}")
    return F.concat(F.lit(before), value, F.lit(after))


def explain(code: Column) -> Column:
    """The message of a reason code; ``retrieval_failure:<kind>`` names the kind, codes without a message themselves."""
    table = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    kind = F.substring_index(code, "retrieval_failure:", -1)
    failed = _worded(FAILED, F.when(kind == "", "unknown").otherwise(kind))
    return F.when(code.startswith("retrieval_failure:"), failed).otherwise(F.coalesce(F.try_element_at(table, code), _worded(OTHER, code)))


def identity(payload: dict[str, Column]) -> Column:
    """Who or what a payload is about; empty if it says nothing."""
    return F.coalesce(*[F.when(payload[f].cast("string") != "", payload[f].cast("string")) for f in NAMED_BY if f in payload], F.lit(""))


def envelope(status: Column, reasons: Column, extra: dict[str, Column] | None = None) -> Column:
    """struct(status, reasons, reason_details, response_policy, rejection, ...) of a decision.

    ``grounded`` counts as ``grounded_answer`` and says that the requirements
    are met if it has no other reason; any status but those of ``SUMMARIES``
    refuses. Empty and repeated reasons are left out; null reasons are none.
    """
    status = F.when(status == "grounded", "grounded_answer").otherwise(status)
    given = F.filter(F.array_distinct(F.array_compact(F.coalesce(reasons, F.array().cast("array<string>")))), lambda r: r != "")
    said = F.when((status == "grounded_answer") & (F.size(given) == 0), F.array(F.lit(SATISFIED))).otherwise(given)
    pick = lambda i: F.when(status == "grounded_answer", SUMMARIES["grounded_answer"][i]).when(status == "clarify", SUMMARIES["clarify"][i]).otherwise(SUMMARIES["no_match"][i])
    rejection = F.struct((status != "grounded_answer").alias("required"), pick(0).alias("mode"), F.coalesce(F.get(said, F.lit(0)), F.lit("")).alias("primary_reason"), pick(1).alias("summary"))
    details = F.transform(said, lambda r: F.struct(r.alias("code"), explain(r).alias("message")))
    more = [c.alias(name) for name, c in (extra or {}).items()]
    return F.struct(status.alias("status"), said.alias("reasons"), details.alias("reason_details"), pick(0).alias("response_policy"), rejection.alias("rejection"), *more)


def replayed(checks: Column, replayed_ok: Column, required: list[str], core: list[str], replayable: list[str]) -> Column:
    """struct(validation, ok, failed): what a stored result is worth.

    ``checks`` is a map of check to outcome. All required ones present and none
    failed: it stands as it is. Core ones passed and only replayable ones
    failed: the decision of today's gate counts (``replayed_ok``). Otherwise it
    cannot be replayed. Null outcomes count as failed.
    """
    names = F.map_keys(checks)
    passed = lambda name: F.coalesce(F.try_element_at(checks, name), F.lit(False))
    failed = F.array_sort(F.filter(names, lambda n: ~passed(n)))
    complete = F.size(F.array_except(F.array(*map(F.lit, required)), names)) == 0
    core_ok = F.size(F.filter(F.array(*map(F.lit, core)), lambda n: ~passed(n))) == 0
    only = F.size(F.array_except(failed, F.array(*map(F.lit, replayable)))) == 0
    kind = F.when(complete & (F.size(failed) == 0), "online").when(complete & core_ok & only, "replayed").otherwise("not_replayable")
    ok = F.when(kind == "online", F.lit(True)).when(kind == "replayed", F.coalesce(replayed_ok, F.lit(False))).otherwise(F.lit(False))
    return F.struct(kind.alias("validation"), ok.alias("ok"), failed.alias("failed"))
