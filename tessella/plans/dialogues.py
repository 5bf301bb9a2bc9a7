"""Queries over conversations: supervision, rendering, windows, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import gate, lexicon, metrics
from tessella.plans.registry import query
from tessella.plans.retrieval import ENTRIES, TOK, entry_terms
from tessella.sources.tables import load

NEGATION = "\\b(?:no|not|never|nicht|kein|keine|ne|pas|sans|sin|nunca)"
UNCERTAIN = "\\b(?:maybe|perhaps|vielleicht|peut|quizás|tal)"


@query(f"with p as (select conv_id, turn, coalesce(text, '') as text, strpos(coalesce(text, ''), ' der ') as pos from conversations), l as (select conv_id, turn, pos, case when pos > 0 then substr(text, greatest(1, pos - 10), least(10, pos - 1)) end as left_text from p) select conv_id, turn, case when pos = 0 then 'none' when regexp_matches(left_text, '(?:{NEGATION})[^.,;]{{0,2}}$') then 'absent' when regexp_matches(left_text, '(?:{UNCERTAIN})[^.,;]{{0,4}}$') then 'uncertain' else 'present' end as polarity from l")
def polarity_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    at = F.locate(" der ", F.col("text"))
    return rows.select("conv_id", "turn", F.when(at == 0, "none").otherwise(text.polarity(F.col("text"), at, NEGATION, UNCERTAIN)).alias("polarity"))


MAPPED = f"{ENTRIES}, said as (select conv_id, turn, unnest(list_distinct({TOK})) as term from conversations where role = 'user'), cat as (select term, count(*) as entries, min(doc_id) as first_entry from ranked group by 1)"


@query(f"with {MAPPED} select conv_id, turn, term as canonical_term, entries, first_entry from said join cat using (term)")
def supervision_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = entry_terms(spark, sf_dir).groupBy("term").agg(F.count("*").alias("entries"), F.min("doc_id").alias("first_entry"))
    return said(spark, sf_dir).join(catalog, "term").select("conv_id", "turn", F.col("term").alias("canonical_term"), "entries", "first_entry")


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = load(spark, sf_dir, "conversations").where("role = 'user'")
    return users.select("conv_id", "turn", F.explode(F.array_distinct(text.words(F.col("text")))).alias("term"))


@query(f"with {MAPPED}, m as (select distinct conv_id, turn from said join cat using (term)) select c.conv_id, c.turn, 'no_evidence_grounded_exact_match' as reason from conversations c anti join m on m.conv_id = c.conv_id and m.turn = c.turn where role = 'user'")
def rejected_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapped = said(spark, sf_dir).join(entry_terms(spark, sf_dir).select("term").distinct(), "term", "left_semi").select("conv_id", "turn").distinct()
    users = load(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn")
    return users.join(mapped, ["conv_id", "turn"], "left_anti").withColumn("reason", F.lit("no_evidence_grounded_exact_match"))


@query(f"with {MAPPED}, a as (select term, count(distinct conv_id) as n_queries, any_value(entries) as n_entries from said join cat using (term) group by 1) select term, n_queries, n_entries, case when n_entries > 8 then 'broad_review_only' when n_queries < 3 then 'low' when length(term) >= 5 then 'high' else 'medium' end as priority from a")
def term_priority_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = entry_terms(spark, sf_dir).groupBy("term").agg(F.count("*").alias("n_entries"))
    used = said(spark, sf_dir).groupBy("term").agg(F.countDistinct("conv_id").alias("n_queries")).join(counts, "term")
    return used.select("term", "n_queries", "n_entries", gate.priority(F.col("n_queries"), F.col("n_entries"), F.length("term")).alias("priority"))


@query("select conv_id, count(*) as turns, md5(string_agg(role || ': ' || coalesce(text, ''), chr(10) order by turn)) as rendered_md5 from conversations group by 1")
def dialog_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    grouped = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("t"))
    return grouped.select("conv_id", "turns", F.md5(F.array_join("t.line", "\n")).alias("rendered_md5"))


@query("select conv_id, turn, cast(sum(length(coalesce(text, ''))) over w as bigint) as window_chars, count(*) over w as window_turns from conversations window w as (partition by conv_id order by turn rows between 5 preceding and current row)")
def history_window6(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-5, 0)
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum(F.length(F.coalesce("text", F.lit("")))).over(w).alias("window_chars"), F.count("*").over(w).alias("window_turns"))


PAIRS = "p as (select conv_id, turn, role, text as question, lead(text) over (partition by conv_id order by turn) as answer, lead(role) over (partition by conv_id order by turn) as next_role from conversations), qa as (select * from p where role = 'user' and next_role = 'assistant')"


@query(f"with {PAIRS}, k as (select conv_id, turn, row_number() over (partition by md5(question), md5(answer) order by conv_id, turn) as x from qa where length(question) >= 8 and length(answer) >= 30) select conv_id, turn from k where x = 1")
def dialog_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = qa(spark, sf_dir).where((F.length("question") >= 8) & (F.length("answer") >= 30))
    first = F.row_number().over(Window.partitionBy(F.md5("question"), F.md5("answer")).orderBy("conv_id", "turn"))
    return good.withColumn("x", first).where("x = 1").select("conv_id", "turn")


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("text").over(w).alias("answer"), F.lead("role").over(w).alias("next_role"))
    return rows.where("role = 'user' and next_role = 'assistant'")


GRAM = "list_transform(range(1, length({0})), lambda i: substr({0}, i, 2))"
FLAT = "regexp_replace(lower(coalesce({0}, '')), '\\s+', '', 'g')"


@query(f"with {PAIRS}, t as (select conv_id || ':' || turn as key, {FLAT.format('question')} as a, {FLAT.format('answer')} as b from qa), ga as (select key, gram, count(*) as na from (select key, unnest({GRAM.format('a')}) as gram from t) group by 1, 2), gb as (select key, gram, count(*) as nb from (select key, unnest({GRAM.format('b')}) as gram from t) group by 1, 2) select key, round(2 * sum(least(coalesce(na, 0), coalesce(nb, 0)))::double / (coalesce(sum(na), 0) + coalesce(sum(nb), 0)), 4) as f1 from ga full join gb using (key, gram) group by 1")
def bigram_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = qa(spark, sf_dir).withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    return metrics.bigram_f1(rows, "key", "question", "answer").withColumn("f1", F.round("f1", 4))


@query("select b.item_id, cast(count(*) filter (where strpos(regexp_replace(lower(b.text), '\\s+', '', 'g'), t) > 0) as bigint) as exact from benchmark b, (select unnest(['the', 'der', 'que', 'les', 'and']) as t) group by 1")
def exact_match_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = F.array(*map(F.lit, ("the", "der", "que", "les", "and")))
    return load(spark, sf_dir, "benchmark").select("item_id", text.exact_match_count(F.col("text"), terms).cast("long").alias("exact"))


@query(f"with {ENTRIES}, w as (select conv_id, turn, word, place from (select conv_id, turn, unnest({TOK}) as word, generate_subscripts({TOK}, 1) as place from conversations)), n as (select distinct conv_id, turn, place + 1 as place from w where word in ('no', 'not', 'nicht', 'pas', 'sin', 'ne', 'kein')) select word as term, count(*) as n from w semi join n on w.conv_id = n.conv_id and w.turn = n.turn and w.place = n.place where word in (select term from ranked) group by 1")
def negated_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue words right after a negation, with how often."""
    words = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(text.words(F.col("text"))).alias("place", "term"))
    hits = words.join(entry_terms(spark, sf_dir).select("term").distinct(), "term")
    negations = words.where(F.col("term").isin(*"no not nicht pas sin ne kein".split())).select("conv_id", "turn", (F.col("place") + 1).alias("place"))
    return hits.join(negations, ["conv_id", "turn", "place"], "left_semi").groupBy("term").agg(F.count("*").alias("n"))
