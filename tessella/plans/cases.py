"""Queries that make cases and score them, over derived entries and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import cases, search
from tessella.plans.curation import PAIRS_SQL
from tessella.plans.dialogues import qa
from tessella.plans.documents import EMAIL, PHONE
from tessella.plans.registry import query
from tessella.plans.retrieval import ENTRIES, entries, entry_terms
from tessella.plans.search import SEARCH, fused, pairs
from tessella.sources.tables import load


@query(f"with {SEARCH} select query, key, len(list_filter(groups, lambda x: list_has_any(x, asked) and list_has_any(x, matched))) = len(groups) and neg = 0 as covers from g")
def signature_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a candidate's groups are all met by the query, with nothing negated."""
    covers = cases.covers_signature(F.col("groups"), F.col("asked"), F.col("matched_terms"), F.col("negative_conflicts"))
    return pairs(spark, sf_dir).select("query", "key", covers.alias("covers"))


@query(f"with {ENTRIES}, fam as (select doc_id as key, 'required' as field, unnest(terms[1:6]) as term from entries union select doc_id, 'diagnostic', unnest(terms[7:9]) from entries union select doc_id, 'differential', unnest(terms[10:12]) from entries), ask as (select distinct doc_id as query, unnest(terms[1:4]) as term from entries where doc_id % 20 = 0), hit as (select query, key, field, min(term) as term from fam join ask using (term) group by 1, 2, 3) select query, key, field, term from hit qualify row_number() over (partition by query order by key, field) <= 30")
def term_index_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the terms of queries stand in three families of fields."""
    own = entries(spark, sf_dir)
    fields = own.select("doc_id", F.slice("terms", 1, 6).alias("required"), F.slice("terms", 7, 3).alias("diagnostic"), F.slice("terms", 10, 3).alias("differential"))
    asked = own.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query"), F.explode(F.slice("terms", 1, 4)).alias("term"))
    return cases.compact_hits(cases.term_index(fields, "doc_id", ["required", "diagnostic", "differential"]), asked)


@query(f"with {ENTRIES}, t as (select term, count(*) as n from ranked group by 1) select sha256(term)[:16] as id, term, case when n > 8 then 'low' when length(term) >= 6 then 'high' else 'medium' end as priority, array_to_string(list_filter([case when length(term) >= 6 then 'long' end, case when n > 8 then 'broad' end, case when regexp_matches(term, '[0-9]') then 'digits' end], lambda x: x is not null), ',') as flags from t")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue terms as rows for a reviewer."""
    return cases.review_rows(entry_terms(spark, sf_dir).groupBy("term").agg(F.count("*").alias("n")), "term", "n", 6, 8)


@query(f"with {ENTRIES}, gr as (select doc_id, list_concat([terms[1:2], terms[3:4], terms[5:6]], list_transform(terms[7:9], lambda t: [t]))[1:4] as groups from entries), c as (select doc_id, groups, array_to_string(list_sort(list_distinct(list_transform(groups, lambda x: x[1]))), '|') as concept from gr), u as (select distinct concept from c where doc_id % 3 = 1) select doc_id, concept, len(groups)::int as n_groups from c anti join u using (concept) where doc_id % 3 = 0 qualify row_number() over (partition by concept order by doc_id) = 1")
def unseen_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose concept no entry in use has, with their groups."""
    groups = cases.seed_groups(F.array(*[F.slice("terms", i, 2) for i in (1, 3, 5)]), F.slice("terms", 7, 3))
    own = entries(spark, sf_dir).select("doc_id", groups.alias("groups"))
    own = own.withColumn("concept", cases.concept_key(F.transform("groups", lambda g: F.get(g, F.lit(0)))))
    return cases.unused(own.where("doc_id % 3 = 0"), own.where("doc_id % 3 = 1"), "doc_id").select("doc_id", "concept", F.size("groups").alias("n_groups"))


SAMPLES = {"uncertain": "(?:maybe|perhaps|vielleicht|peut)", "negative": "(?:^| )(?:no|not|nicht|pas|sin) ", "asks": "[?]"}


@query("select conv_id, " + ", ".join(f"min(case when regexp_matches(text, '{p}') then turn end) as {k}" for k, p in SAMPLES.items()) + " from conversations group by 1")
def polarity_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turn of each conversation that is uncertain, denies or asks."""
    return cases.first_samples(load(spark, sf_dir, "conversations"), "conv_id", "turn", "text", SAMPLES)


@query(f"with r as (select conv_id || ':' || turn as key, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) as t, regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[^0-9a-z\\x{{3400}}-\\x{{9fff}}]', '', 'g') as norm from conversations) select sha256(norm) as hash, min(key) as key from r where length(t) between 8 and 300 and norm <> '' and not regexp_matches(t, '{EMAIL}') and not regexp_matches(t, '{PHONE}') and not regexp_matches(t, '^[A-Z]') group by 1")
def candidate_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that may become questions: of fair length, without personal data or a template's opening, each once."""
    rows = load(spark, sf_dir, "conversations").withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    single = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    return cases.candidate_stream(rows, "key", single, text.dedupe_key(F.col("text")), [EMAIL, PHONE, "^[A-Z]"])


@query(f"with {PAIRS_SQL}, m as (select pair_id as id, unnest([0, 1, 2]) as place, question, answer from p), k as (select id, place, case when place < 2 then 'question' else 'pair' end as kind, case place when 0 then question when 1 then answer else concat_ws(chr(9), question, answer) end as t from m) select id, place, kind, md5(t) as text_md5 from k where trim(coalesce(t, '')) <> ''")
def dataset_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a data set of pairs gives: its questions and its pairs."""
    return cases.dataset_rows(qa(spark, sf_dir).withColumn("id", F.concat_ws(":", "conv_id", "turn")), "id")


@query(f"with {SEARCH} select query, n_groups::int as covered, n_groups = 3 as all_covered, forb::int as conflicts, key = query as expected from lr where rank = 1")
def prediction_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the best candidate of each query scores: groups covered, conflicts, and whether it is the expected one."""
    top = search.local_rank(fused(pairs(spark, sf_dir)), "query", "key", 1)
    return top.select("query", F.size("matched_groups").alias("covered"), (F.size("matched_groups") == F.size("groups")).alias("all_covered"), F.size("forbidden_conflicts").alias("conflicts"), (F.col("key") == F.col("query")).alias("expected"))


@query(f"with {ENTRIES}, w as (select distinct term from ranked where length(term) = 5), c as (select a.term as a, b.term as b from w a join w b on substr(a.term, 1, 4) = substr(b.term, 1, 4) and a.term < b.term), e as (select generate_subscripts(string_split(a, ''), 1) - 1 as place, unnest(string_split(a, '')) as x, unnest(string_split(b, '')) as y from c) select place::int as place, x as a, y as b, count(*) as n from e where x <> y group by 1, 2, 3")
def confusion_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which letters stand for which others in catalogue words of five letters that begin alike."""
    w = entry_terms(spark, sf_dir).select("term").distinct().where(F.length("term") == 5)
    both = w.select(F.col("term").alias("a"), F.left("term", F.lit(4)).alias("head")).join(w.select(F.col("term").alias("b"), F.left("term", F.lit(4)).alias("head")), "head").where("a < b")
    return cases.confusions(both, "a", "b")
