"""Recall, fusion, ranking, the gate and their evaluation, over entries derived from documents.

An entry is a document with its 12 rarest words of document frequency 2 to 40:
six of them make three required groups, three are diagnostic, three tell it
from others. Cases are made from the entries themselves, one of each style.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import dedup, gate, lexicon, matcher, metrics, retrieval, splits
from tessella.operators.neighbours import previous
from tessella.plans.documents import COMPONENTS_SQL
from tessella.plans.registry import query
from tessella.session import materialize
from tessella.sources.tables import load

TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"


#: Frequent words that every task turns away by itself; rows of others meet the counts.
OFTEN = 100_000


def doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "source", text.words(F.col("text")).alias("w"))


def entry_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, term, df, rn): the 12 rarest catalogue words of each document."""
    # Written once: both the counts and the join read it.
    each = materialize(doc_words(spark, sf_dir).select("doc_id", "source", F.explode(F.array_distinct("w")).alias("term")), "postings")
    counts = materialize(each.groupBy("term").agg(F.count("*").alias("df")).where("df >= 2"), "counts")
    df = counts.where("df <= 40")
    # Most rows are of words far too frequent: they go before the join deals rows out by word.
    often = counts.where("df > 40").orderBy(F.desc("df")).limit(OFTEN).select("term")
    each = each.join(F.broadcast(often), "term", "left_anti")
    return retrieval.top_k(each.join(df, "term"), ["doc_id"], [F.asc("df"), F.asc("term")], 12, "rn")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, kind, terms array, conf) of documents with at least six catalogue words."""
    grouped = entry_terms(spark, sf_dir).groupBy("doc_id", "source").agg(F.array_sort(F.collect_list(F.struct("rn", "term"))).alias("t"))
    labels = load(spark, sf_dir, "labels").select("doc_id", "quality")
    out = grouped.select("doc_id", "source", F.col("t.term").alias("terms")).where(F.size("terms") >= 6).join(labels, "doc_id", "left")
    conf = F.when(F.col("quality").isNull(), 0.6).otherwise(0.45 + 0.1 * F.col("quality"))
    return out.select("doc_id", "source", (F.regexp_extract("source", r"\d+", 0).cast("int") % 6).alias("kind"), "terms", F.round(conf, 6).alias("conf"))


ENTRIES = f"""each as (select doc_id, source, unnest(list_distinct({TOK})) as term from documents),
df as (select term, count(*) as df from each group by 1 having count(*) between 2 and 40),
ranked as (select doc_id, source, term, df, row_number() over (partition by doc_id order by df, term) as rn from each join df using (term) qualify rn <= 12),
entries as (select r.doc_id, any_value(r.source) as source, cast(regexp_extract(any_value(r.source), '[0-9]+') as int) % 6 as kind, list(term order by rn) as terms,
  round(case when any_value(l.quality) is null then 0.6 else 0.45::double + 0.1::double * any_value(l.quality) end, 6) as conf
  from ranked r left join labels l on l.doc_id = r.doc_id group by 1 having count(*) >= 6)"""


@query(f"with {ENTRIES} select term, count(*) as entries, min(df) as df from ranked group by 1")
def term_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entry_terms(spark, sf_dir).groupBy("term").agg(F.count("*").alias("entries"), F.min("df").alias("df"))


@query(f"with {ENTRIES} select doc_id, source, kind, array_to_string(terms, ' ') as terms, conf from entries")
def entry_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).withColumn("terms", F.array_join("terms", " "))


BM25 = f"""tf as (select doc_id as key, token, count(*) as tf from (select doc_id, unnest({TOK}) as token from documents) group by 1, 2),
dl as (select doc_id as key, len({TOK}) as dl from documents), stat as (select count(*) as n, avg(dl) as avgdl from dl),
dfs as (select token, count(*) as df from tf group by 1),
asked as (select item_id as query, token, least(count(*), 2) as qtf from (select item_id, unnest({TOK}) as token from benchmark) group by 1, 2),
scored as (select query, key, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * qtf) as score
  from tf join asked using (token) join dfs using (token) join dl using (key), stat group by 1, 2 having score > 0)"""


def index_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' postings of the benchmark's words, written once."""
    return retrieval.bm25_index(doc_words(spark, sf_dir), "doc_id", "w", asked_words(spark, sf_dir).select("token"))


def asked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.explode(text.words(F.col("text"))).alias("token"))


def bm25_route(spark: SparkSession, sf_dir: str, k: int = 40, index: DataFrame | None = None) -> DataFrame:
    index = index_of(spark, sf_dir) if index is None else index
    asked = load(spark, sf_dir, "benchmark").select("item_id", text.words(F.col("text")).alias("q"))
    scores = retrieval.bm25_scores(index, asked, "item_id", "q").withColumn("score", F.round("score", 6))
    return retrieval.top_k(scores, ["query"], [F.desc("score"), F.asc("key")], k)


@query(f"with {BM25}, r as (select query, key, round(score, 6) as score, row_number() over (partition by query order by round(score, 6) desc, key) as rank from scored) select * from r where rank <= 5")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_route(spark, sf_dir, 5).withColumn("rank", F.col("rank").cast("long"))


@query(f"""
with q as (select item_id as query, unnest(list_distinct({TOK})) as term from benchmark), d as (select doc_id as key, unnest(list_distinct({TOK})) as term from documents),
df as (select term, count(*) as df from d group by 1 having count(*) <= 40), hits as (select query, key, count(*) as n_matched from q join d using (term) join df using (term) group by 1, 2),
r as (select *, row_number() over (partition by query order by n_matched desc, key) as rank from hits) select query, key, n_matched, rank from r where rank <= 5
""")
def payload_overlap_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap(spark, sf_dir, 5).select("query", "key", F.col("n_matched").cast("long").alias("n_matched"), F.col("rank").cast("long").alias("rank"))


def overlap(spark: SparkSession, sf_dir: str, k: int, index: DataFrame | None = None, most: int | None = 40) -> DataFrame:
    """The best k documents of each query by the number of its words that they have; of words in ``most`` documents or fewer, if that is given."""
    index = index_of(spark, sf_dir) if index is None else index
    asked = asked_words(spark, sf_dir).distinct()
    rare = index if most is None else index.where(F.col("df") <= most)
    hits = rare.join(asked, "token").groupBy("query", "key").agg(F.count("*").alias("n_matched"))
    return retrieval.top_k(hits, ["query"], [F.desc("n_matched"), F.asc("key")], k)


@query(f"""
with {BM25}, r1 as (select query, key, row_number() over (partition by query order by round(score, 6) desc, key) as rank from scored qualify rank <= 40),
q as (select item_id as query, unnest(list_distinct({TOK})) as term from benchmark), d as (select doc_id as key, unnest(list_distinct({TOK})) as term from documents),
df as (select term, count(*) as df from d group by 1 having count(*) <= 40), hits as (select query, key, count(*) as n_matched from q join d using (term) join df using (term) group by 1, 2),
r2 as (select query, key, row_number() over (partition by query order by n_matched desc, key) as rank from hits qualify rank <= 40),
fused as (select query, key, round(sum(1.0::double / (60 + rank)), 8) as rrf_score, count(*) as n_routes, min(rank) as best_rank from (select * from r1 union all select * from r2) group by 1, 2),
ranked as (select *, row_number() over (partition by query order by rrf_score desc, best_rank, key) as rank from fused) select * from ranked where rank <= 10
""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_of(spark, sf_dir)
    fused = retrieval.rrf({"bm25": bm25_route(spark, sf_dir, index=index), "overlap": overlap(spark, sf_dir, 40, index)}).withColumn("rrf_score", F.round("rrf_score", 8))
    top = retrieval.top_k(fused, ["query"], [F.desc("rrf_score"), F.asc("best_rank"), F.asc("key")], 10)
    return top.withColumn("rank", F.col("rank").cast("long")).withColumn("best_rank", F.col("best_rank").cast("long"))


ALL_HITS = f"""q as (select item_id as query, unnest(list_distinct({TOK})) as term from benchmark), d as (select doc_id as key, unnest(list_distinct({TOK})) as term from documents),
hits as (select query, key, count(*) as n_matched from q join d using (term) group by 1, 2)"""


@query(f"with {ALL_HITS}, r as (select *, row_number() over (partition by query order by n_matched desc, key) as rank from hits) select query, key, n_matched, rank from r where rank <= 5")
def payload_overlap_all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """payload_overlap_route without its limit on the document frequency of a word."""
    return overlap(spark, sf_dir, 5, most=None).select("query", "key", "n_matched", F.col("rank").cast("long").alias("rank"))


@query(f"""
with {BM25}, r1 as (select query, key, row_number() over (partition by query order by round(score, 6) desc, key) as rank from scored qualify rank <= 40), {ALL_HITS},
r2 as (select query, key, row_number() over (partition by query order by n_matched desc, key) as rank from hits qualify rank <= 40),
fused as (select query, key, round(sum(1.0::double / (60 + rank)), 8) as rrf_score, count(*) as n_routes, min(rank) as best_rank from (select * from r1 union all select * from r2) group by 1, 2),
ranked as (select *, row_number() over (partition by query order by rrf_score desc, best_rank, key) as rank from fused) select * from ranked where rank <= 10
""")
def rrf_fusion_all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = index_of(spark, sf_dir)
    fused = retrieval.rrf({"bm25": bm25_route(spark, sf_dir, index=index), "overlap": overlap(spark, sf_dir, 40, index, most=None)}).withColumn("rrf_score", F.round("rrf_score", 8))
    top = retrieval.top_k(fused, ["query"], [F.desc("rrf_score"), F.asc("best_rank"), F.asc("key")], 10)
    return top.withColumn("rank", F.col("rank").cast("long")).withColumn("best_rank", F.col("best_rank").cast("long"))


@query("with v as (select vec_id, label, embedding::double[] as e from embeddings), s as (select q.vec_id as query, c.vec_id as key, c.label, round(list_cosine_similarity(q.e, c.e), 6) as score from v q, v c where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id), r as (select *, row_number() over (partition by query order by score desc, key) as rank from s) select query, key, label, score, rank from r where rank <= 10")
def dense_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(spark, sf_dir, 10).withColumn("rank", F.col("rank").cast("long"))


def dense(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Exact cosine: a stated set of queries (every twentieth vector) against all rows."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("qv"))
    best = retrieval.dense_topk(v.select(F.col("vec_id").alias("key"), F.col("embedding").alias("v")), asked, k)
    return best.join(v.select(F.col("vec_id").alias("key"), "label"), "key").select("query", "key", "label", "score", "rank")


@query("with v as (select vec_id, label, embedding::double[] as e from embeddings), s as (select q.vec_id as query, c.vec_id as key, c.label, round(list_cosine_similarity(q.e, c.e), 6) as score from v q, v c where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id), r as (select *, row_number() over (partition by query order by score desc, key) as rank from s qualify rank <= 40) select query, label, key, score from (select *, row_number() over (partition by query, label order by score desc, key) as x from r) where x = 1")
def collapse_max_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.collapse_best(dense(spark, sf_dir, 40), ["query", "label"], "score", "key").select("query", "label", "key", "score")


STYLES = "full missing conflict shared unknown knowledge negated".split()

CASES = f"""{ENTRIES},
numbered as (select *, lag(terms) over (partition by source order by doc_id) as prev from entries),
cases as (
  select doc_id, 'full' as style, 'clinical_symptom' as intent, [terms[1], terms[3], terms[5]] as q, []::varchar[] as neg from entries
  union all select doc_id, 'missing', 'clinical_symptom', [terms[1], terms[3]], []::varchar[] from entries
  union all select doc_id, 'conflict', 'clinical_symptom', [terms[1], terms[3], terms[5], prev[1]], []::varchar[] from numbered where prev is not null
  union all select doc_id, 'unknown', 'unknown', [terms[1], terms[3], terms[5]], []::varchar[] from entries
  union all select doc_id, 'knowledge', 'herb_knowledge', [terms[1], terms[3], terms[5]], []::varchar[] from entries
  union all select doc_id, 'negated', 'clinical_symptom', [terms[1], terms[3]], [terms[5]] from entries
),
features as (
  select c.doc_id, style, intent, conf, len(q) as n_terms,
    len(list_filter(q, lambda t: list_contains(terms, t))) as canonical,
    3 as groups_total, cast(not list_has_any(terms[1:2], q) as int) + cast(not list_has_any(terms[3:4], q) as int) + cast(not list_has_any(terms[5:6], q) as int) as groups_missing,
    len(list_filter(neg, lambda t: list_contains(terms, t))) as negative,
    case when prev is null then 0 else len(list_filter(q, lambda t: list_contains(prev[1:3], t) and not list_contains(terms, t))) end as forbidden
  from cases c join numbered n using (doc_id)
)"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with their cases: style, intent, q, neg; ``prev`` are the terms of the entry before in its source."""
    own = previous(entries(spark, sf_dir), "source", "doc_id", ["terms"]).withColumnRenamed("prev_terms", "prev")
    t = lambda i: F.get("terms", F.lit(i - 1))
    none = F.array().cast("array<string>")
    one = lambda style, intent, q, neg=none: F.struct(F.lit(style).alias("style"), F.lit(intent).alias("intent"), q.alias("q"), neg.alias("neg"))
    full = F.array(t(1), t(3), t(5))
    made = F.array(
        one("full", "clinical_symptom", full), one("missing", "clinical_symptom", F.array(t(1), t(3))), F.when(F.col("prev").isNotNull(), one("conflict", "clinical_symptom", F.array(t(1), t(3), t(5), F.get("prev", F.lit(0))))),
        one("unknown", "unknown", full), one("knowledge", "herb_knowledge", full), one("negated", "clinical_symptom", F.array(t(1), t(3)), F.array(t(5))),
    )
    return own.select("*", F.explode(F.array_compact(made)).alias("c")).select("doc_id", "source", "terms", "prev", "conf", "c.*")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = F.array(*[F.slice("terms", i, 2) for i in (1, 3, 5)])
    own = cases(spark, sf_dir).withColumn("groups", groups)
    forbidden = F.array_except(F.array_intersect("q", F.slice("prev", 1, 3)), "terms")
    return own.select(
        "doc_id", "style", "intent", "conf", F.size("q").alias("n_terms"), F.size(F.filter("q", lambda x: F.array_contains("terms", x))).alias("canonical"), F.lit(3).alias("groups_total"),
        (3 - F.size(gate.covered(F.col("groups"), F.col("q")))).alias("groups_missing"), F.size(F.array_intersect("neg", "terms")).alias("negative"), F.when(F.col("prev").isNull(), 0).otherwise(F.size(forbidden)).alias("forbidden"),
    )


@query(f"with {CASES} select doc_id, style, intent, conf, n_terms::int as n_terms, canonical::int as canonical, groups_total, groups_missing, negative::int as negative, forbidden::int as forbidden from features")
def match_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir)


GATE = f"""{CASES},
coded as (select *, list_filter([
  case when n_terms = 0 then 'no_canonical_terms' end, case when negative > 0 then 'negative_evidence_conflict' end, case when forbidden > 0 then 'forbidden_evidence_conflict' end,
  case when groups_missing > 0 then 'missing_required_symptom_groups' end, case when conf < 0.6 then 'payload_evidence_confidence_below_threshold' end,
  case when canonical < 2 then 'too_few_payload_matches' end, case when canonical / n_terms < 1.0 then 'low_query_coverage' end], lambda x: x is not null) as clinical from features),
decided as (select doc_id, style,
  case when intent = 'unknown' then ['unknown_intent'] when intent = 'herb_knowledge' and groups_missing > 0 then ['missing_required_knowledge_groups'] when intent = 'herb_knowledge' and canonical >= 2 then ['direct_knowledge_evidence_match']
    when intent = 'herb_knowledge' then ['insufficient_knowledge_match'] else clinical end as reasons,
  case when intent = 'unknown' then 'no_match' when intent = 'herb_knowledge' and groups_missing > 0 then 'clarify' when intent = 'herb_knowledge' and canonical >= 2 then 'grounded'
    when intent = 'herb_knowledge' then 'clarify' when len(clinical) > 0 then 'clarify' else 'grounded' end as status from coded)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    no, zero = F.lit(False), F.lit(0)
    m = {c: F.col(c) for c in ("intent", "n_terms", "canonical", "groups_total", "groups_missing", "negative", "forbidden")}
    m |= {"needs_more": no, "has_match": ~no, "exact": zero, "query_cov": F.col("canonical") / F.col("n_terms"), "confidence": F.col("conf"), "indistinct": no}
    status, reasons = gate.decide(m)
    return f.select("doc_id", "style", status.alias("status"), reasons.alias("reasons"))


@query(f"with {GATE} select doc_id, style, status, array_to_string(reasons, ',') as reasons from decided")
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).withColumn("reasons", F.array_join("reasons", ","))


@query(f"with {GATE} select style, status, reason, count(*) as n from (select style, status, unnest(case when len(reasons) = 0 then ['none'] else reasons end) as reason from decided) group by grouping sets ((style, status, reason), (style), ())")
def gate_reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = decisions(spark, sf_dir).select("style", "status", F.explode(F.when(F.size("reasons") == 0, F.array(F.lit("none"))).otherwise(F.col("reasons"))).alias("reason"))
    return each.groupingSets([["style", "status", "reason"], ["style"], []], "style", "status", "reason").agg(F.count("*").alias("n"))


@query(f"with {ENTRIES} select doc_id, case when kind is null or len(terms) < 7 then 'quarantine' when quality = 1 and toxic = 0 then 'verified' when kind = 0 and conf >= 0.5 then 'high' else 'medium' end as tier from entries left join labels using (doc_id)")
def evidence_tiering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = entries(spark, sf_dir).join(load(spark, sf_dir, "labels"), "doc_id", "left")
    verified = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    one = F.lit(1.0)
    tier = gate.tier(F.col("kind").isNull() | (F.size("terms") < 7), verified, F.col("kind") == 0, F.col("conf") + 0.15, one, one)
    return rows.select("doc_id", tier.alias("tier"))


@query(f"with {ENTRIES}, s as (select doc_id, kind, conf, len(terms) as n, len(list_filter([1, 3, 5], lambda i: length(terms[i]) >= 4 or length(terms[i + 1]) >= 4)) / 3 as groups, len(list_filter(terms[7:9], lambda t: length(t) >= 4)) / greatest(1, len(terms[7:9])) as diag from entries) select s.doc_id, case when kind is null or n < 7 then 'quarantine' when quality = 1 and toxic = 0 then 'verified' when kind < 4 and round(conf + 0.1, 6) >= 0.65 and groups >= 1 and diag >= 0.5 then 'high' else 'medium' end as tier from s left join labels using (doc_id)")
def evidence_tiers_by_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers where the support of groups and diagnostic terms differs from entry to entry."""
    rows = entries(spark, sf_dir).join(load(spark, sf_dir, "labels"), "doc_id", "left")
    long = lambda c: F.size(F.filter(c, lambda t: F.length(t) >= 4))
    groups = sum((F.when(long(F.slice("terms", i, 2)) > 0, 1).otherwise(0) for i in (1, 3, 5)), F.lit(0)) / 3
    diagnostic = F.slice("terms", 7, 3)
    verified = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    tier = gate.tier(F.col("kind").isNull() | (F.size("terms") < 7), verified, F.col("kind") < 4, F.round(F.col("conf") + 0.1, 6), groups, long(diagnostic) / F.greatest(F.lit(1), F.size(diagnostic)))
    return rows.select("doc_id", tier.alias("tier"))


POST = "post as (select doc_id, source, kind, len(terms) as n_terms, unnest(terms) as term from entries)"
PAIRS = f"""{ENTRIES}, {POST},
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as shared, any_value(a.n_terms) as na, any_value(b.n_terms) as nb from post a join post b on a.term = b.term and a.kind = b.kind and a.doc_id <> b.doc_id and a.source <> b.source group by 1, 2),
scored as (select a, b, shared, round(shared::double / (na + nb - shared), 6) as jaccard from pairs where shared::double / (na + nb - shared) >= 0.08),
best as (select *, row_number() over (partition by a order by jaccard desc, b) as rank from scored qualify rank <= 5)"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select(F.col("doc_id").alias("key"), F.explode("terms").alias("term"), "kind", F.col("source").alias("name"), F.size("terms").alias("n_terms"))


@query(f"with {PAIRS} select a, b, shared, jaccard, rank from (select *, row_number() over (partition by least(a, b), greatest(a, b) order by a, rank) as x from best) where x = 1")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lexicon.similar_entries(postings(spark, sf_dir)).withColumn("jaccard", F.round("jaccard", 6))
    first = F.row_number().over(Window.partitionBy(F.least("a", "b"), F.greatest("a", "b")).orderBy("a", "rank"))
    return pairs.withColumn("x", first).where("x = 1").select("a", "b", "shared", "jaccard", F.col("rank").cast("long").alias("rank"))


@query(f"with {PAIRS} select a as doc_id, b as nearest, jaccard, shared from best where rank = 1")
def nearest_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lexicon.similar_entries(postings(spark, sf_dir), k=1)
    return pairs.select(F.col("a").alias("doc_id"), F.col("b").alias("nearest"), F.round("jaccard", 6).alias("jaccard"), "shared")


@query(f"with {ENTRIES}, g as (select doc_id, terms, unnest([1, 2, 3]) as omitted from entries) select doc_id, omitted, array_to_string(list_filter([case when omitted <> 1 then terms[1] end, case when omitted <> 2 then terms[3] end, case when omitted <> 3 then terms[5] end], lambda x: x is not null), ' ') as query, terms[2 * omitted - 1] || '|' || terms[2 * omitted] as missing_group from g")
def leave_one_group_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = entries(spark, sf_dir).select("doc_id", "terms", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("omitted"))
    asked = F.concat_ws(" ", *[F.when(F.col("omitted") != i, F.get("terms", F.lit(2 * i - 2))) for i in (1, 2, 3)])
    return own.select("doc_id", "omitted", asked.alias("query"), F.concat_ws("|", F.slice("terms", 2 * F.col("omitted") - 1, F.lit(2))).alias("missing_group"))


@query(f"with {ENTRIES}, s as (select doc_id, terms, len(list_filter(terms, lambda t: left(sha256('holdout' || chr(31) || t), 16) < '2666666666666600')) as dev from entries) select doc_id, case when dev = len(terms) then 'dev' when dev = 0 then 'train' else 'excluded' end as split from s")
def term_holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.term_holdout(entries(spark, sf_dir), "terms").select("doc_id", "split")


@query(f"with {ENTRIES}, s as (select terms, len(list_filter(terms, lambda t: left(sha256('holdout' || chr(31) || t), 16) < '2666666666666600')) as dev from entries), n as (select case when dev = len(terms) then 'dev' when dev = 0 then 'train' end as split, unnest(terms) as term from s) select count(*) as overlap from (select term from n where split = 'dev' intersect select term from n where split = 'train')")
def split_overlap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = splits.term_holdout(entries(spark, sf_dir), "terms").select("split", F.explode("terms").alias("term"))
    side = lambda s: each.where(F.col("split") == s).select("term")
    return side("dev").intersect(side("train")).agg(F.count("*").alias("overlap"))


SPLIT_SQL = f"""{ENTRIES}, {COMPONENTS_SQL},
post as (select doc_id, kind, len(terms) as n_terms, unnest(terms) as term from entries),
alike as (select a.doc_id as a, b.doc_id as b from post a join post b on a.term = b.term and a.kind = b.kind and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n_terms, b.n_terms having count(*)::double / (a.n_terms + b.n_terms - count(*)) >= 0.08),
edge as (select a, b from alike union select component, doc_id from components where component <> doc_id), ways as (select a, b from edge union select b, a from edge),
spread as (select a as node, a as root from ways union select ways.b, spread.root from spread join ways on ways.a = spread.node),
whole as (select node, min(root) as component from spread group by 1)"""


@query(f"with recursive {SPLIT_SQL} select node, component, case when left(sha256('pairs' || chr(31) || component), 16) < '2666666666666600' then 'dev' else 'train' end as split from whole")
def component_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that are similar, whatever their source, and near copies are one component, and so on one side."""
    # Written, as it is joined with itself.
    similar = lexicon.similar_entries(materialize(postings(spark, sf_dir), "entries"), k=None, other_names=False).where("a < b").select("a", "b")
    docs = dedup.dedupe_keys(load(spark, sf_dir, "documents"), "doc_id", "text")
    copies = dedup.near_duplicate_components(docs, "doc_id", "k").where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))
    return splits.component_split(similar.unionByName(copies), "a", "b")


@query(f"with {BM25}, r as (select query, key, row_number() over (partition by query order by round(score, 6) desc, key) as rank from scored qualify rank <= 40), f as (select b.item_id, min(rank) as rank from benchmark b left join r on r.query = b.item_id and r.key % 7 = b.item_id % 7 group by 1) select count(*) as cases, round(avg(case when rank <= 1 then 1.0 else 0.0 end), 6) as recall_1, round(avg(case when rank <= 5 then 1.0 else 0.0 end), 6) as recall_5, round(avg(case when rank <= 8 then 1.0 else 0.0 end), 6) as recall_8, round(avg(case when rank <= 8 then 1.0::double / rank else 0.0 end), 6) as mrr, round(avg(case when rank <= 8 then 1.0 / log2(rank + 1.0) else 0.0 end), 6) as ndcg from f")
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bm25_route(spark, sf_dir)
    asked = load(spark, sf_dir, "benchmark").select("item_id")
    rank = asked.join(found, (F.col("query") == F.col("item_id")) & (F.col("key") % 7 == F.col("item_id") % 7), "left").groupBy("item_id").agg(F.min("rank").alias("rank"))
    out = metrics.ranking(rank, "rank")
    return out.select("cases", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query(f"""
with {ENTRIES}, p as (select doc_id, terms[1:2] as g1, terms[3:4] as g2, list_sort(terms) as pred from entries),
r as (select doc_id, list_aggregate(list_filter([nullif(list_position(pred, g1[1]), 0), nullif(list_position(pred, g1[2]), 0)], lambda x: x is not null), 'min') as r1, list_aggregate(list_filter([nullif(list_position(pred, g2[1]), 0), nullif(list_position(pred, g2[2]), 0)], lambda x: x is not null), 'min') as r2 from p)
select count(*) as cases, round(avg(1.0::double / least(r1, r2)), 6) as mrr,
  {", ".join(f"round((sum(cast(r1 <= {k} as int)) + sum(cast(r2 <= {k} as int)))::double / (2 * count(*)), 6) as group_recall_{k}, round(avg(case when r1 <= {k} and r2 <= {k} then 1.0 else 0.0 end), 6) as case_all_{k}, round(avg(case when r1 <= {k} or r2 <= {k} then 1.0 else 0.0 end), 6) as case_any_{k}" for k in (1, 2, 3))}
from r
""")
def group_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = entries(spark, sf_dir).select(F.array(F.slice("terms", 1, 2), F.slice("terms", 3, 2)).alias("groups"), F.array_sort("terms").alias("pred"))
    out = metrics.group_recall(own, "groups", "pred")
    return out.select("cases", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query(f"""
with {BM25}, r1 as (select query, key, row_number() over (partition by query order by round(score, 6) desc, key) as rank from scored qualify rank <= 40),
r2 as (select query, key, row_number() over (partition by query order by sha256('b|' || cast(key as varchar)), key) as rank from r1), m1 as (select query, min(rank) as rank from r1 where key % 3 = 0 group by 1), m2 as (select query, min(rank) as rank from r2 where key % 3 = 0 group by 1),
j as (select coalesce(m1.rank, 999) as ra, coalesce(m2.rank, 999) as rb from m1 full join m2 using (query))
select count(*) as cases, cast(sum(cast(rb = 1 and ra <> 1 as int)) as bigint) as gained, cast(sum(cast(ra = 1 and rb <> 1 as int)) as bigint) as lost, cast(sum(cast(rb < ra as int)) as bigint) as improved, cast(sum(cast(rb > ra as int)) as bigint) as worsened, cast(sum(cast(rb = ra as int)) as bigint) as unchanged from j
""")
def ab_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = bm25_route(spark, sf_dir)
    b = retrieval.top_k(a.select("query", "key"), ["query"], [F.sha2(F.concat(F.lit("b|"), F.col("key").cast("string")), 256), F.asc("key")], 40)
    best = lambda df: df.where("key % 3 = 0").groupBy("query").agg(F.min("rank").alias("rank"))
    return metrics.compare(best(a), best(b), "query")


RANKED = f"{BM25}, r as (select query, key, round(score, 6) as score, row_number() over (partition by query order by round(score, 6) desc, key) as pos from scored qualify pos <= 40), s as (select r.*, d.source, d.n_chars from r join documents d on d.doc_id = r.key)"


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "source", "n_chars")
    return bm25_route(spark, sf_dir).withColumnRenamed("rank", "pos").join(docs, "key")


@query(f"with {RANKED}, m as (select *, row_number() over (partition by query, source order by n_chars desc, pos) as b, min(pos) over (partition by query, source) as slot0 from s), o as (select *, row_number() over (partition by query order by case when b = 1 then 0 else 1 end, case when b = 1 then slot0 else pos end, pos) as slot from m) select query, key, source, slot from o where slot <= 8")
def diversify_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.diversify(ranked(spark, sf_dir), "query", "source", "pos", [F.desc("n_chars")], 8)
    return out.select("query", "key", "source", F.col("slot").cast("long").alias("slot"))


def _reranked(order: str) -> str:
    return f"with {RANKED} select query, key, row_number() over (partition by query order by case when pos <= 20 then 0 else 1 end, {order}, pos) as new_rank from s"


@query(_reranked("case when pos <= 20 then score end desc nulls last, case when pos <= 20 then n_chars end desc nulls last"))
def rerank_score_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rerank(ranked(spark, sf_dir), "query", "pos", 20, [F.col("score"), F.col("n_chars")]).select("query", "key", F.col("new_rank").cast("long").alias("new_rank"))


@query(_reranked("case when pos <= 20 then n_chars end desc nulls last, case when pos <= 20 then score end desc nulls last"))
def rerank_evidence_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rerank(ranked(spark, sf_dir), "query", "pos", 20, [F.col("n_chars"), F.col("score")]).select("query", "key", F.col("new_rank").cast("long").alias("new_rank"))


@query(f"with {ENTRIES}, hits as (select d.doc_id, t.term, d.place from (select doc_id, unnest({TOK}) as term, generate_subscripts({TOK}, 1) - 1 as place from documents) d join (select distinct term from ranked) t using (term)) select doc_id, count(*) as hits, count(distinct term) as terms, min(place) as first_place from hits group by 1")
def lexicon_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = lexicon.match_words(load(spark, sf_dir, "documents"), "doc_id", text.words(F.col("text")), entry_terms(spark, sf_dir).select("term"))
    return hits.groupBy(F.col("key").alias("doc_id")).agg(F.count("*").alias("hits"), F.countDistinct("term").alias("terms"), F.min(F.col("place").cast("long")).alias("first_place"))


@query()
def lexicon_longest_non_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue terms of every length in the lower-case text of documents."""
    chosen = matcher.find_terms(load(spark, sf_dir, "documents"), "doc_id", F.lower(F.coalesce("text", F.lit(""))), entry_terms(spark, sf_dir))
    return chosen.select(F.col("key").alias("doc_id"), "start", "term")
