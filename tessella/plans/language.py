"""Parsers of wordings, recursive chunks, seeds, training examples, line grammars, caches and sinks, over the documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import examples, groups, lines, phrases, recursive, rewrite, seeds, translate
from tessella.plans.registry import query
from tessella.plans.retrieval import ENTRIES, TOK, entries, entry_terms
from tessella.session import materialize, scratch_path
from tessella.sources.files import write_sinks
from tessella.sources.tables import load, load_stream
from tessella.streaming import cache, events, state

#: Statements in documents: a text's last sentence, its parts between commas, alternatives by the languages' words for "or".
SENTENCES = groups.Grammar(
    statement=r"(?P<phrase>[^.!?\n]{2,400})[.!?]",
    separator=r"[,;:]+",
    alternative=r"\s(?:or|oder|ou|o)\s",
    opening=r"(?:(?:and|und|et|y|the|der|die|das|les|le|la|el)\s+)+",
    closing=r"(?:\s(?:etc))",
    edges=" ,;:.",
    axes=(("phrase", "in", (" ",)),),
    other_axis="word",
    main_axes=("word", "phrase"),
    noise=r"[0-9]",
    longest=60,
)
#: Denial in the languages of the conversations.
DENIALS = translate.Rules(
    negation=r"(?i)\b(?:not|no|without|nicht|kein|keine|sin|sans|pas)\s+([^.,;:!?\n]{1,40})",
    connectors=r"(?i)\s(?:and|but|und|aber|y|pero|et|mais)\s",
)
#: Lines of documents: a short line without a stop opens a block if a long one follows it.
HEADED = lines.LineGrammar(name=r".{1,59}[^.,;:!?]", confirm=r".{60}", passed_over=("-", "*", "."), joint=" ")
HEADED_SQL = r"""
with raw as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as no from documents
), clean as (
  select doc_id, no, trim(regexp_replace(line, '\s+', ' ', 'g')) as line from raw where trim(line) <> ''
), near as (
  select *, lead(line) over (partition by doc_id order by no) as following from clean
), opened as (
  select *, length(line) between 2 and 60 and right(line, 1) not in ('.', ',', ';', ':', '!', '?') and length(coalesce(following, '')) >= 60 as opens from near
), placed as (
  select *, sum(cast(opens as int)) over (partition by doc_id order by no) as b from opened
)
select doc_id, cast(b - 1 as int) as block, cast(min(no) as int) as line, min_by(line, no) as name, cast(count(*) - 1 as int) as n_lines,
  md5(coalesce(string_agg(line, ' ' order by no) filter (where not opens), '')) as body_md5
from placed where b > 0 group by doc_id, b
"""
#: Pieces of benchmark texts between stops and the languages' words for "and" and "or", without numbers.
PIECES = phrases.PhraseRules(cuts=r"[,;:.!?\n]| (?:and|und|et|y|or|oder|ou|o) ", rejects=("[0-9]",), stop=("etc",), most=40)
DOUBLED = [("..", "."), ("  ", " "), ("de de", "de"), ("the the", "the"), ("die die", "die"), ("la la", "la")]
STYLES = {"plain": 2, "typos": 1, "several": 1}


def _nested(column: str, rules: list[tuple[str, str]], times: int = 16) -> str:
    for old, new in rules:
        for _ in range(times):
            column = f"replace({column}, '{old}', '{new}')"
    return column


@query()
def required_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of the last sentence of every document, its catalogue words known, with their places in the text."""
    known = entry_terms(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list("term")).alias("known"))
    docs = load(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("raw_text")).join(known, "doc_id", "left")
    none, nested = F.array().cast("array<string>"), F.array().cast("array<array<string>>")
    found = groups.required_groups(docs.select("doc_id", "raw_text", F.lit("").alias("evidence"), "known", none.alias("differential"), none.alias("forbidden"), nested.alias("existing")), "doc_id", grammar=SENTENCES)
    traced = F.transform("traces", lambda t: F.struct(t["term"], t["start"], t["end"]))
    return found.select(F.col("key").alias("doc_id"), "phrase_start", "phrase_end", "groups", traced.alias("places"), F.array_join("reasons", ",").alias("reasons"))


def word_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(alias, canonical, place): words of six letters or more of the conversations stand for the commonest one with their first five letters."""
    words = load(spark, sf_dir, "conversations").select(F.explode(text.words(F.col("text"))).alias("alias")).where("length(alias) >= 6")
    counted = words.groupBy("alias").agg(F.count("*").alias("n"))
    first = counted.groupBy(F.left("alias", F.lit(5)).alias("stem")).agg(F.min(F.struct((-F.col("n")).alias("n"), "alias")).alias("least"))
    return counted.join(first, F.left("alias", F.lit(5)) == F.col("stem")).select("alias", F.col("least.alias").alias("canonical"), F.lit(0).alias("place"))


@query()
def translate_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every user's turn says, and denies, in catalogue words."""
    turns = load(spark, sf_dir, "conversations").where("role = 'user'").select(F.struct("conv_id", "turn").alias("key"), "text")
    found = translate.translate(turns, "key", F.lower("text"), word_aliases(spark, sf_dir), DENIALS)
    return found.select("key.conv_id", "key.turn", "canonical_terms", "primary_terms", "colloquial_terms", "negative_terms", "negative_phrases", "needs_more_info")


@query()
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at most 400 characters of every document, cut at paragraphs, lines, blanks, characters."""
    found = recursive.recursive_chunks(load(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(F.col("key").alias("doc_id"), "chunk", F.length("child").alias("n_chars"), F.md5("child").alias("child_md5"))


@query()
def recursive_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents of every document: sections merged, split recursively, remains merged again."""
    found = recursive.recursive_parents(load(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select(F.col("key").alias("doc_id"), "parent_id", F.length("parent").alias("n_chars"), F.md5("parent").alias("parent_md5"))


@query(f"""with {ENTRIES}, seeds as (select doc_id, terms from entries where doc_id not in (select doc_id from labels)), used as (select distinct terms from entries where doc_id in (select doc_id from labels)),
near as (select s.doc_id, len(list_intersect(s.terms, u.terms)) as shared, len(s.terms) as a, len(u.terms) as b from seeds s join used u on list_has_any(s.terms, u.terms))
select doc_id from seeds where doc_id not in (select doc_id from near where shared >= 2 and (shared / (a + b - shared) >= 0.72 or shared / least(a, b) >= 0.85))""")
def unlike_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unlabelled entries whose terms are not too similar to those of a labelled one."""
    own = materialize(entries(spark, sf_dir).select("doc_id", "terms"), "entries")
    labelled = load(spark, sf_dir, "labels").select("doc_id").distinct()
    fresh, used = own.join(labelled, "doc_id", "left_anti"), own.join(labelled, "doc_id", "left_semi")
    return seeds.unlike(fresh, used, "doc_id", "terms").select("doc_id")


@query("""with r as (select doc_id, source, lang, n_chars, sha256('balance|' || doc_id) as h, row_number() over (partition by source, lang order by n_chars desc, sha256('balance|' || doc_id), doc_id) as round from documents),
p as (select *, row_number() over (partition by source order by round, n_chars desc, h, doc_id) as place from r) select doc_id, source, lang, round from p where place <= 12""")
def balanced_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve documents of each source, its languages as even as can be, the longest first."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return seeds.balanced(docs, "source", "lang", "n_chars", "doc_id", 12).select("doc_id", "source", "lang", "round")


@query("""with n as (select doc_id, source, lang, row_number() over (order by source, lang, sha256('style|' || doc_id), doc_id) - 1 as n from documents)
select doc_id, source, lang, ['plain', 'typos', 'several', 'plain'][cast(n % 4 as int) + 1] as style from n""")
def dealt_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A style for every document, in shares of 2, 1 and 1 over all and within each source and language."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return seeds.dealt_styles(docs, ["source", "lang"], "doc_id", STYLES)


@query(f"""with {ENTRIES}, cat as (select distinct term, doc_id as entry, source as text from ranked), own as (select term, entry, text, row_number() over (partition by term order by entry) - 1 as nth from cat),
terms as (select term, count(*) as n, row_number() over (order by term) - 1 as place from cat group by term), total as (select count(*) as t from terms),
asked as (select distinct item_id as id, trim(text) as query, unnest({TOK}) as term from benchmark), known as (select * from asked join terms using (term)),
pos as (select id, term, 1 as label, term as other, entry, text from known join own using (term) where nth = ('0x' || left(sha256(id || ':' || term), 15))::bigint % n),
steps as (select id, query, term, s.step, (('0x' || left(sha256('negative:0:' || id || ':' || term), 15))::bigint + s.step) % t as place from known, total, (values (0), (1)) as s(step)),
free as (select s.id, s.query, s.term, s.step, c.term as other, c.n from steps s join terms c using (place) anti join asked a on a.id = s.id and a.term = c.term),
neg as (select f.id, f.term, 0 as label, f.other, o.entry, o.text from (select * from free qualify row_number() over (partition by id, term order by step) = 1) f join own o on o.term = f.other where o.nth = ('0x' || left(sha256(f.query || f.other), 15))::bigint % f.n)
select * from pos union all select * from neg""")
def training_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every catalogue word of a benchmark text an entry that has it, and one of another word."""
    catalogue = entry_terms(spark, sf_dir).select("term", F.col("doc_id").alias("entry"), F.col("source").alias("text"))
    asked = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("query"), F.explode(text.words(F.col("text"))).alias("term"))
    return examples.training_examples(asked, catalogue)


@query(f"""with {ENTRIES}, cat as (select distinct term, doc_id as entry from ranked), own as (select term, entry, row_number() over (partition by term order by entry) - 1 as nth, count(*) over (partition by term) as n from cat),
first as (select trim(text) as query, term, min(item_id) as id from (select item_id, text, unnest({TOK}) as term from benchmark) group by all)
select term, id, entry from first join own using (term) where nth = ('0x' || left(sha256(id || ':' || term), 15))::bigint % n""")
def positive_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every wording of the benchmark once for each catalogue word in it, with the entry that stands for the word."""
    catalogue = entry_terms(spark, sf_dir).select("term", F.col("doc_id").alias("entry"), F.col("source").alias("text"))
    asked = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("query"), F.explode(text.words(F.col("text"))).alias("term"))
    first = asked.groupBy(F.trim("query").alias("query"), "term").agg(F.min("id").alias("id"))
    return examples.positive_groups(asked, catalogue).join(first, ["query", "term"]).select("term", "id", "entry")


@query(f"select doc_id, md5({_nested('text', DOUBLED)}) as text_md5 from documents")
def settled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without doubled stops, blanks and articles, however often they were doubled."""
    return rewrite.to_fixed_point(load(spark, sf_dir, "documents").select("doc_id", "text"), "text", DOUBLED).select("doc_id", F.md5("text").alias("text_md5"))


@query(HEADED_SQL)
def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of every document: a short line and what follows it."""
    found = lines.line_blocks(load(spark, sf_dir, "documents"), "doc_id", "text", HEADED)
    return found.select(F.col("key").alias("doc_id"), "block", "line", "name", "n_lines", F.md5("body").alias("body_md5"))


@query("""with e as (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as i from events), p as (select *, lag(i) over (partition by user_id, event_type order by i) as last from e)
select user_id as key, event_id as event, event_type as name, last is not null and (select count(distinct x.event_type) from e x where x.user_id = p.user_id and x.i > p.last and x.i < p.i) < 2 as hit from p""")
def events_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events find their type among the two their user used last: a stream over the table, run to its end."""
    return _finished(cache.lru(load_stream(spark, sf_dir, "events"), "user_id", "event_type", 2).select("key", "event", "name", "hit"), "lru")


def _finished(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives once it has read all there is: its appended rows as a table."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    stream.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, f"{name}-state")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("select user_id as key, event_id as event, row_number() over (partition by user_id order by ts, event_id) as n, row_number() over (partition by user_id order by ts, event_id) <= 20 as allowed from events")
def events_budget_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events by number, and whether they are within a budget of 20: as a stream with one number of state a user."""
    return _finished(state.budget(load_stream(spark, sf_dir, "events"), "user_id", 20), "budget")


@query("select user_id as key, event_id as event, coalesce(sum(cast(value < 50 as int)) over (partition by user_id order by ts, event_id rows between 3 preceding and 1 preceding), 0) = 3 as open from events")
def events_breaker_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a user's last three events all fell below 50: as a stream."""
    return _finished(state.breaker(load_stream(spark, sf_dir, "events"), "user_id", F.col("value") < 50), "breaker")


@query("select distinct user_id, event_type from events")
def events_dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and what they did, once each, by the state that a watermark bounds."""
    rows = load_stream(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return _finished(events.dedup(rows, ["user_id", "event_type"]).select("user_id", "event_type"), "dedup")


@query("select coalesce(lang, '') as sink, count(*) as total, least(count(*), 50) as written, count(*) > 50 as truncated from documents where lang in ('en', 'fr', 'de') group by 1 union all select 'other', count(*), 0, false from documents where lang is null or lang not in ('en', 'fr', 'de')")
def capped_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written to a sink for each of three languages, at most fifty each, and what was left out."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    seen = write_sinks(docs, scratch_path(spark, "sinks"), "lang", ["en", "fr", "de"], 50, [F.col("doc_id")])
    rows = [(k or "other", v["total"], v["written"], v["truncated"]) for k, v in seen.items() if v["total"] or k is None]
    return spark.createDataFrame(rows, "sink string, total long, written long, truncated boolean")


CHECK = "style, count(*) as rows, count(distinct source) as sources, sum(leak) as leaks, sum(again) as repeats"


@query(f"""with n as (select doc_id, source, lang, n_chars, text, row_number() over (order by source, lang, sha256('style|' || doc_id), doc_id) - 1 as n from documents),
s as (select ['plain', 'typos', 'several', 'plain'][cast(n % 4 as int) + 1] as style, source, text, cast(n_chars as varchar) as concept, lead(text) over (partition by source order by n) as answer from n),
m as (select *, cast(length(coalesce(answer, '')) >= 10 and len(list_filter(range(1, greatest(length(coalesce(answer, '')) - 8, 1)), lambda i: contains(text, substr(answer, cast(i as int), 10)))) > 0 as int) as leak,
  cast(count(*) over (partition by concept) > 1 as int) as again from s),
a as (select {CHECK} from m group by style)
select style, rows, sources, cast(leaks as bigint) as leaks, cast(repeats as bigint) as repeats, concat_ws(',', case when rows <> 100 then 'quota' end, case when sources < 2 then 'sources' end, case when leaks > 0 then 'leak' end, case when repeats > 0 then 'repeat' end) as problems from a""")
def seed_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the documents as seeds: quotas, sources, answers that show in questions, concepts used twice."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", F.col("n_chars").cast("string").alias("concept"))
    dealt = seeds.dealt_styles(docs, ["source", "lang"], "doc_id", STYLES)
    after = F.lead("text").over(Window.partitionBy("source").orderBy("lang", F.sha2(F.concat(F.lit("style|"), F.col("doc_id").cast("string")), 256), "doc_id"))
    return seeds.check_seeds(dealt.select("style", "source", "concept", after.alias("answer"), F.col("text").alias("question"), F.col("doc_id").alias("key")), dict.fromkeys(STYLES, 100))


@query(rf"""with {ENTRIES}, cat as (select distinct term from ranked), b as (select item_id, lower(coalesce(text, '')) as t from benchmark),
cut as (select item_id, regexp_replace(unnest(string_split_regex(t, '{PIECES.cuts}')), '^\s+|\s+$', '', 'g') as piece, generate_subscripts(string_split_regex(t, '{PIECES.cuts}'), 1) as i from b),
good as (select * from cut where length(piece) between 2 and 40 and not regexp_matches(piece, '[0-9]') and piece <> 'etc' and not exists (select 1 from cat where contains(piece, term) and term <> piece)),
found as (select item_id, term as phrase, 0 as o from b join cat on contains(t, term) union all select item_id, piece, i from good),
firsts as (select item_id, phrase, min(o) as o from found group by 1, 2)
select item_id, cast(count(phrase) as int) as n, md5(coalesce(string_agg(phrase, '|' order by o, phrase), '')) as phrases_md5 from b left join firsts using (item_id) group by 1""")
def benchmark_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue terms in every benchmark text, and the pieces between stops that hold none."""
    found = phrases.split_phrases(load(spark, sf_dir, "benchmark"), "item_id", F.lower("text"), entry_terms(spark, sf_dir).select("term", F.lit(0).alias("place")), PIECES)
    return found.select(F.col("key").alias("item_id"), F.size("phrases").alias("n"), F.md5(F.array_join("phrases", "|")).alias("phrases_md5"))
