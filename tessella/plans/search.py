"""Search over the derived entries: features, filters, local order, re-ranking and the whole gate.

Queries are the entries whose id is divisible by 20; each asks for three of
its own terms and, every third, for one of its neighbour's. Candidates are all
entries that share a catalogue term, so at most 40 a term.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import decision, gate, search
from tessella.operators.neighbours import previous
from tessella.operators.retrieval import top_k
from tessella.plans.registry import SQL, query
from tessella.plans.retrieval import ENTRIES, entries
from tessella.session import materialize
from tessella.sources.tables import load

KINDS = ["formula_syndrome", "classical_clause", "classical_acupuncture", "herb_indication", "classical_theory", "classical_acupuncture_principle"]
INTENTS = ["clinical_symptom", "herb_indication", "clinical_symptom", "classical_theory", "formula_knowledge", "unknown"]


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each query and candidate, with its features."""
    own = entries(spark, sf_dir).withColumn("kind", F.element_at(F.array(*map(F.lit, KINDS)), F.coalesce("kind", F.lit(0)) + 1))
    own = materialize(previous(own, "source", "doc_id", ["terms"]), "entries")
    part = lambda a, n, of="terms": F.slice(of, a, n)
    entry = own.select(
        F.col("doc_id").alias("key"), "source", "kind", "conf", "terms", F.array(*[part(i, 2) for i in (1, 3, 5)]).alias("groups"), part(7, 3).alias("diagnostic"), part(10, 3).alias("differential"),
        F.array_except(part(1, 3, F.coalesce("prev_terms", F.array().cast("array<string>"))), "terms").alias("forbidden"),
    )
    n = F.col("doc_id").cast("long") / 20
    n = n.cast("long")
    t = lambda i, of="terms": F.get(of, F.lit(i - 1))
    asked = F.array_compact(F.array(t(1), t(3), t(5), F.when(n % 3 == 0, t(1, "prev_terms"))))
    asks = own.where("doc_id % 20 = 0").select(
        F.col("doc_id").alias("query"), F.array_distinct(asked).alias("asked"), F.array(t(1), t(3), t(5)).alias("primary"), F.when(n % 4 == 0, F.array_compact(F.array(t(7)))).otherwise(F.array().cast("array<string>")).alias("negated"),
        F.element_at(F.array(*map(F.lit, INTENTS)), (n % 6 + 1).cast("int")).alias("intent"), (n % 7 == 0).alias("needs_more"),
    )
    found = entry.select("key", F.explode("terms").alias("term")).join(asks.select("query", F.explode("asked").alias("term")), "term").select("query", "key").distinct()
    rows = search.matched(found.join(asks, "query").join(entry, "key"))
    said = F.array_join("terms", " ")
    rows = rows.withColumn("exact", F.col("matched_terms")[0].eqNullSafe(F.col("terms")[0]).cast("int")).withColumn("overlap", search.overlap_points()).withColumn("score", F.col("conf"))
    return rows.withColumn("explanatory", search.explanatory_priority(F.col("kind"), F.col("asked"), said, F.array_join("diagnostic", " "), said, F.array_join("asked", " ")))


def fused(rows: DataFrame) -> DataFrame:
    """Candidates that no rule drops, with their places on two routes and the fused score."""
    kept = rows.where(search.ruled_out().isNull())
    for name, order in (("r1", [F.desc("overlap"), F.asc("key")]), ("r2", [F.desc("specificity"), F.asc("key")])):
        kept = search.rank_within(kept, "query", order, name)
    on = lambda r: F.when(F.col(r) <= 10, 1 / (60 + F.col(r))).otherwise(0.0)
    return kept.withColumn("rrf_score", F.round(on("r1") + on("r2"), 8)).withColumn("n_routes", (F.col("r1") <= 10).cast("int") + (F.col("r2") <= 10).cast("int"))


_kind = "case coalesce(kind, 0) " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(KINDS)) + " end"
_intent = "case (doc_id // 20) % 6 " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(INTENTS)) + " end"
_has = "list_filter({0}, lambda x: list_contains({1}, x))"
_both = _has.format
SEARCH = f"""{ENTRIES},
own as (select *, {_kind} as kname, lag(terms) over (partition by source order by doc_id) as prev from entries),
entry as (select doc_id as key, source, kname, conf, terms, [terms[1:2], terms[3:4], terms[5:6]] as groups, terms[7:9] as diagnostic, terms[10:12] as differential,
  list_filter(coalesce(prev, [])[1:3], lambda x: not list_contains(terms, x)) as forbidden from own),
asks as (select doc_id as query, list_distinct(list_filter([terms[1], terms[3], terms[5], case when (doc_id // 20) % 3 = 0 then prev[1] end], lambda x: x is not null)) as asked, [terms[1], terms[3], terms[5]] as prim,
  case when (doc_id // 20) % 4 = 0 then list_filter([terms[7]], lambda x: x is not null) else [] end as negated, {_intent} as intent, (doc_id // 20) % 7 = 0 as needs_more from own where doc_id % 20 = 0),
found as (select distinct query, key from (select key, unnest(terms) as term from entry) join (select query, unnest(asked) as term from asks) using (term)),
m as (select query, key, source, conf, terms, asked, intent, needs_more, kname, groups, {_both('asked', 'terms')} as matched, len({_both('prim', 'terms')}) as n_prim, len(prim) as n_primary, len({_both('negated', 'terms')}) as neg, len({_both('asked', 'forbidden')}) as forb,
  len(list_filter(groups, lambda g: list_has_any(g, asked))) as n_groups, len({_both('asked', 'diagnostic')}) as n_diag, len({_both('asked', 'differential')}) as n_diff, len(diagnostic) as l_diag, len(differential) as l_diff,
  case intent when 'herb_indication' then case when kname = 'herb_indication' then 6 else 0 end when 'classical_theory' then case when kname = 'classical_theory' then 6 else 0 end
    when 'formula_knowledge' then case kname when 'formula_syndrome' then 6 when 'classical_clause' then 5 else 0 end
    when 'clinical_symptom' then case kname when 'formula_syndrome' then 5 when 'classical_acupuncture' then 5 when 'classical_clause' then 4 else 0 end
    else case kname when 'formula_syndrome' then 4 when 'classical_clause' then 3 when 'classical_theory' then 1 else 0 end end as sp,
  case when kname in ('classical_acupuncture_principle', 'classical_theory') then len(list_filter(asked, lambda t: length(t) > 1 and contains(array_to_string(diagnostic, ' '), t)))
    + case when kname = 'classical_theory' and len(list_filter(asked, lambda t: length(t) > 1)) > 0 and len(list_filter(asked, lambda t: length(t) > 1 and not contains(array_to_string(terms, ' '), t))) = 0 then 4 else 0 end else 0 end as expl
  from found join asks using (query) join entry using (key)),
f as (select *, len(matched) as canon, n_prim / n_primary as cov, n_groups / 3 as gcov, case when l_diag > 0 then n_diag / l_diag else 0 end as dcov, case when l_diff > 0 then n_diff / l_diff else 0 end as fcov,
  coalesce(list_sum(list_transform(matched, lambda t: length(t))), 0) as spec, cast(matched[1] is not distinct from terms[1] as int) as exact from m),
g as (select *, round(n_prim * 10.0::double + canon * 2.0::double + cov * 5.0::double + gcov + sp, 6) as overlap,
  case when intent = 'clinical_symptom' and neg > 0 then 'negative' when intent = 'clinical_symptom' and kname in ('formula_syndrome', 'classical_clause') and forb > 0 then 'forbidden' when canon <= 0 then 'no_overlap' end as why from f),
routed as (select *, row_number() over (partition by query order by overlap desc, key) as r1, row_number() over (partition by query order by spec desc, key) as r2 from g where why is null),
fus as (select *, round(case when r1 <= 10 then 1.0::double / (60 + r1) else 0 end + case when r2 <= 10 then 1.0::double / (60 + r2) else 0 end, 8) as rrf, cast(r1 <= 10 as int) + cast(r2 <= 10 as int) as n_routes,
  case when intent = 'clinical_symptom' and neg = 0 and forb = 0 then case when n_prim >= 3 and cov >= 0.75 then 2 when gcov >= 1 and cov >= 0.5 and n_prim >= 2 then 1 else 0 end else 0 end as sig from routed),
lr as (select *, row_number() over (partition by query order by sig desc, sp desc, cast(gcov >= 1 and cov >= 0.5 as int) desc, cast(cov >= 0.75 and canon >= 3 as int) desc, cov desc, cast(gcov >= 1 as int) desc, gcov desc, canon desc, n_groups desc, n_diag desc, dcov desc,
  n_diff desc, fcov desc, spec desc, exact desc, expl desc, overlap desc, n_routes desc, rrf desc, conf desc, key) as rank from fus)"""


@query(f"with {SEARCH} select query, key, intent, kname as kind, canon::int as canonical_count, n_prim::int as primary_count, round(cov, 6) as query_coverage, round(gcov, 6) as group_coverage, spec::int as specificity, sp as source_priority, expl::int as explanatory, overlap, coalesce(why, 'kept') as verdict from g")
def hard_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every query with its features, and what rules it out."""
    rounded = [F.round(c, 6).alias(c) for c in ("query_coverage", "group_coverage")]
    return pairs(spark, sf_dir).select("query", "key", "intent", "kind", "canonical_count", "primary_count", *rounded, "specificity", "source_priority", "explanatory", "overlap", F.coalesce(search.ruled_out(), F.lit("kept")).alias("verdict"))


@query(f"with {SEARCH} select query, key, sig as signature, round(rrf, 8) as rrf_score, rank from lr where rank <= 10")
def local_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best candidates of every query in the local order of twenty components."""
    best = search.local_rank(fused(pairs(spark, sf_dir)), "query", "key", 10)
    return best.select("query", "key", search.signature().alias("signature"), "rrf_score", F.col("rank").cast("long").alias("rank"))


@query(f"with {SEARCH}, c as (select *, row_number() over (partition by query order by case when rank <= 5 then sig end desc nulls last, case when rank <= 5 then canon end desc nulls last, case when rank <= 5 then n_diag end desc nulls last, case when rank <= 5 then cast(cov >= 1 as int) end desc nulls last, case when rank <= 5 then sp end desc nulls last, case when rank <= 5 then expl end desc nulls last, case when rank <= 5 then conf end desc nulls last, rank) as new_rank from lr where rank <= 10) select query, key, rank as pre_rerank_rank, new_rank from c")
def rerank_evidence_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence-first re-ranking of the first five by all six components, then the score; the tail keeps its order."""
    from tessella.operators import retrieval

    best = search.local_rank(fused(pairs(spark, sf_dir)), "query", "key", 10)
    out = retrieval.rerank(best, "query", "rank", 5, [*search.evidence_keys(), F.col("score")])
    return out.select("query", "key", F.col("rank").cast("long").alias("pre_rerank_rank"), F.col("new_rank").cast("long").alias("new_rank"))


@query(f"""with {SEARCH}, top as (select * from lr where rank = 1), rivals as (select t.query, list(r.matched) as theirs from top t join lr r on r.query = t.query and r.rank between 2 and 4 and r.source is distinct from t.source and r.n_prim >= greatest(1, t.n_prim - 1) and r.gcov >= greatest(0, t.gcov - 0.25) group by 1),
j as (select a.query, a.intent, a.needs_more, len(a.asked) as n_terms, t.key, t.matched, t.canon, t.n_prim, t.cov, t.gcov, t.exact, t.neg, t.forb, t.conf, theirs is not null and len(list_filter(t.matched, lambda x: length(x) >= 2 and not list_contains(flatten(theirs), x))) = 0 as indistinct from asks a left join top t using (query) left join rivals using (query)),
c as (select *, list_filter([case when needs_more then 'translator_needs_more_info' end, case when n_terms = 0 then 'no_canonical_terms' end, case when neg > 0 then 'negative_evidence_conflict' end, case when forb > 0 then 'forbidden_evidence_conflict' end, case when gcov < 1 then 'missing_required_symptom_groups' end,
  case when conf < 0.5 then 'payload_evidence_confidence_below_threshold' end, case when n_prim < 2 then 'too_few_payload_matches' end, case when cov < 0.67 then 'low_query_coverage' end, case when indistinct then 'competing_indistinguishable_matches' end], lambda x: x is not null) as clinical from j)
select query, key,
  case when intent = 'unknown' then 'no_match' when key is null then case when intent = 'clinical_symptom' and n_terms > 0 then 'clarify' else 'no_match' end when intent <> 'clinical_symptom' then case when gcov < 1 then 'clarify' when exact > 0 or canon >= 2 then 'grounded' when canon > 0 then 'clarify' else 'no_match' end
    when len(clinical) > 0 then 'clarify' else 'grounded' end as status,
  case when intent = 'unknown' then 'unknown_intent' when key is null then 'no_grounded_match' when intent <> 'clinical_symptom' then case when gcov < 1 then 'missing_required_knowledge_groups' when exact > 0 or canon >= 2 then 'direct_knowledge_evidence_match' else 'insufficient_knowledge_match' end
    else array_to_string(clinical, ',') end as reasons from c""")
def search_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over the best match of every query, with rivals, exact matches, vague queries and queries that nothing answers."""
    rows = materialize(pairs(spark, sf_dir), "pairs")
    best = search.local_rank(fused(rows), "query", "key", 4)
    top = search.indistinct(best, "query", "source")
    asks = rows.groupBy("query").agg(*[F.first(c).alias(f"q_{c}") for c in ("intent", "needs_more", "asked")])
    own = asks.join(top, "query", "left")
    known = lambda c, rest: F.coalesce(c, F.lit(rest))
    knows = F.when(F.col("q_intent").isin(*search.DIRECT), "herb_knowledge").otherwise(F.col("q_intent"))
    m = {
        "intent": knows, "needs_more": F.col("q_needs_more"), "n_terms": F.size("q_asked"), "has_match": F.col("key").isNotNull(), "exact": known(F.col("exact"), 0), "canonical": F.when(knows == "herb_knowledge", F.col("canonical_count")).otherwise(F.col("primary_count")),
        "query_cov": F.col("query_coverage"), "groups_total": F.size("groups"), "groups_missing": F.size("groups") - F.size("matched_groups"), "negative": F.size("negative_conflicts"), "forbidden": F.size("forbidden_conflicts"), "confidence": F.col("conf"), "indistinct": known(F.col("indistinct"), False),
    }
    status, reasons = gate.decide(m, min_coverage=0.67, min_confidence=0.5)
    return own.select("query", "key", status.alias("status"), F.array_join(reasons, ",").alias("reasons"))


@query(f"with {SEARCH}, n as (select query, array_to_string(list(key order by rank), ',') as keys from lr where rank <= 10 and intent = 'clinical_symptom' and kname in ('formula_syndrome', 'classical_clause') and n_groups < 3 and neg = 0 and forb = 0 and cov >= 0.8 and n_prim >= 3 group by 1) select query, keys from n")
def retained_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that lack a required group but cover the query: those that may take a place in the answer."""
    best = search.local_rank(fused(pairs(spark, sf_dir)), "query", "key", 10).where(search.should_retain())
    lists = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "key"))).alias("r"))
    return lists.select("query", F.array_join(F.transform("r.key", lambda k: k.cast("string")), ",").alias("keys"))


@query(f"with {SEARCH}, o as (select *, row_number() over (partition by query order by overlap desc, sp desc, length(source) desc, key) as place from g where sp > 0 and n_prim > 0) select query, key, overlap as score, place as rank from o where place <= 10")
def payload_overlap_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlap route with its full score: primary and other terms, coverage, groups and priority."""
    rows = pairs(spark, sf_dir).where("source_priority > 0 and primary_count > 0")
    best = top_k(rows, ["query"], [F.desc("overlap"), F.desc("source_priority"), F.length("source").desc(), F.asc("key")], 10)
    return best.select("query", "key", F.col("overlap").alias("score"), F.col("rank").cast("long").alias("rank"))


STATUS_SQL = "case status when 'grounded' then 'grounded_answer' else status end"


def _message_sql(code: str) -> str:
    return "case " + code + " " + " ".join(f"when '{k}' then '{v}'" for k, v in decision.REASONS.items()) + " else '' end"


@query(f"""with sg as ({SQL["search_gate"]}), d as (select query, {STATUS_SQL} as status, case when status = 'grounded' and reasons = '' then '{decision.SATISFIED}' else reasons end as reasons, key from sg),
named as (select d.*, coalesce(doc.source, '') as top_identity from d left join documents doc on doc.doc_id = d.key)
select query, status, reasons, case status when 'grounded_answer' then 'answer' when 'clarify' then 'clarify' else 'refuse' end as policy, string_split(reasons, ',')[1] as primary_reason, {_message_sql("string_split(reasons, ',')[1]")} as message, cast(len(string_split(reasons, ',')) as int) as n_details, top_identity from named""")
def decision_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole decision on every query: status, reasons with their messages, policy and what it is about."""
    gated = materialize(search_gate(spark, sf_dir), "gated")
    about = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "source")
    rows = gated.join(about, "key", "left")
    made = decision.envelope(F.col("status"), F.split("reasons", ","), {"top_identity": decision.identity({"formula": F.lit(""), "title": F.col("source")})})
    return rows.select("query", made.alias("e")).select(
        "query", "e.status", F.array_join("e.reasons", ",").alias("reasons"), F.col("e.response_policy").alias("policy"), F.col("e.rejection.primary_reason").alias("primary_reason"),
        F.get("e.reason_details", F.lit(0))["message"].alias("message"), F.size("e.reason_details").alias("n_details"), "e.top_identity",
    )


@query(f"""with sg as ({SQL["search_gate"]}), c as (select query, status, key is not null as retrieved, query % 40 = 0 as translated, status = 'grounded' as gate, query % 60 <> 0 as ranked from sg)
select query, case when retrieved and translated and gate and ranked then 'online' when retrieved and translated then 'replayed' else 'not_replayable' end as validation,
  case when retrieved and translated and gate and ranked then true when retrieved and translated then status = 'clarify' else false end as ok,
  array_to_string(list_filter([case when not gate then 'gate' end, case when not ranked then 'ranked' end, case when not retrieved then 'retrieved' end, case when not translated then 'translated' end], lambda x: x is not null), ',') as failed from c""")
def gate_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stored results stand, which the gate of today decides, and which cannot be replayed; a clarifying gate is what replays expect."""
    gated = search_gate(spark, sf_dir)
    outcomes = {"retrieved": F.col("key").isNotNull(), "translated": F.col("query") % 40 == 0, "gate": F.col("status") == "grounded", "ranked": F.col("query") % 60 != 0}
    checks = F.create_map(*[x for name, c in outcomes.items() for x in (F.lit(name), c)])
    made = decision.replayed(checks, F.col("status") == "clarify", list(outcomes), ["retrieved", "translated"], ["gate", "ranked"])
    return gated.select("query", made.alias("r")).select("query", "r.validation", "r.ok", F.array_join("r.failed", ",").alias("failed"))
