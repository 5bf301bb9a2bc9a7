"""Queries that clean, check, count and select records: integrity rules, coverage, queues, rankings and small text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import hashing, payload, text
from tessella.operators import curation, retrieval, search
from tessella.plans.dialogues import qa
from tessella.plans.registry import query
from tessella.plans.retrieval import ENTRIES, TOK, entries, entry_terms
from tessella.plans.search import SEARCH, fused, pairs
from tessella.sources.tables import load


@query()
def clean_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cleaning pipeline with its counts; the patterns look behind, which this SQL cannot."""
    cleaned, counts = text.clean_record(F.col("text"))
    out = load(spark, sf_dir, "documents").select("doc_id", cleaned.alias("t"), *[F.coalesce(c, F.lit(0)).cast("long").alias(k) for k, c in counts.items()])
    return out.select("doc_id", F.length("t").cast("long").alias("n_clean"), F.md5("t").alias("clean_md5"), *counts)


FIELDS = ["source", "lang", "terms", "pair"]


@query(f"with {ENTRIES}, r as (select e.doc_id, e.source, d.lang, e.terms from entries e join documents d using (doc_id)) select doc_id, md5(source || ' ' || lang || ' ' || array_to_string(terms, ' ') || ' ' || terms[1] || ' ' || terms[2]) as lexical_md5, md5(left('source: ' || source || chr(10) || 'lang: ' || lang || chr(10) || 'terms: ' || array_to_string(terms, ' ') || chr(10) || 'pair: ' || terms[1] || ' ' || terms[2], 60)) as rerank_md5, sha256('{{\"doc_id\":' || doc_id || ',\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}}') as record_hash, contains(source || ' ' || lang || ' ' || array_to_string(terms, ' '), 'an') as has_an from r")
def payload_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records flattened, labelled for re-ranking, hashed and searched."""
    rows = entries(spark, sf_dir).join(load(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    rows = rows.withColumn("pair", F.array(F.struct(F.col("terms")[0].alias("x"), F.col("terms")[1].alias("y"))))
    lexical = payload.lexical_text(rows, FIELDS)
    return rows.select("doc_id", F.md5(lexical).alias("lexical_md5"), F.md5(payload.labelled_text(rows, FIELDS, 60)).alias("rerank_md5"), payload.record_hash(rows, ["source", "doc_id", "lang"]).alias("record_hash"), payload.contains_term(lexical, F.lit("an")).alias("has_an"))


@query(f"with {ENTRIES} select term, length(term) between 2 and 24 and not regexp_matches(term, '^[0-9.]+$') and term not in ('the', 'and', 'der') as usable, length(term) > 1 and length(term) <= 16 as rankable, term || '。' || 'df' || min(df) as search_text from ranked group by 1")
def term_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which catalogue terms may be shown, ranked and searched by."""
    rows = entry_terms(spark, sf_dir).groupBy("term").agg(F.min("df").alias("df"))
    t = F.col("term")
    return rows.select("term", payload.usable_term(t, ("the", "and", "der")).alias("usable"), payload.rankable(t, 16).alias("rankable"), payload.catalog_text(t, F.array(F.concat(F.lit("df"), F.col("df").cast("string"))), t).alias("search_text"))


@query(f"with {ENTRIES}, t as (select term, min(df) as df, count(*) as n from ranked group by 1), a as (select term, row_number() over (order by n desc, term) as rank from t qualify rank <= 200), b as (select term, row_number() over (order by length(term) desc, term) as rank from t qualify rank <= 200), f as (select term, round(sum(1.0::double / (60 + rank)), 8) as score from (select * from a union all select * from b) group by 1) select term, score, row_number() over (order by score desc, term desc) as rank from f qualify rank <= 100")
def term_rankings_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rankings of terms fused; ties to the greater term."""
    t = entry_terms(spark, sf_dir).groupBy("term").agg(F.count("*").alias("n"))
    lists = [curation.first_rows(t, order, 200) for order in ([F.desc("n"), F.asc("term")], [F.length("term").desc(), F.asc("term")])]
    return curation.fuse_terms(lists, 100)


@query(f"with {SEARCH}, r as (select key, source, 5 * 3 + 2 * len(differential) + len(diagnostic) + 3 * len(forbidden) as richness from entry) select source, key, richness::int as richness from r qualify row_number() over (partition by source order by richness desc, key) = 1")
def formula_richness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of each source that says most; of equal ones the first."""
    from tessella.operators.neighbours import previous

    own = previous(entries(spark, sf_dir), "source", "doc_id", ["terms"])
    none = F.array().cast("array<string>")
    forbidden = F.array_except(F.slice(F.coalesce("prev_terms", none), 1, 3), "terms")
    rich = curation.richness(F.array(*[F.slice("terms", i, 2) for i in (1, 3, 5)]), F.slice("terms", 10, 3), F.slice("terms", 7, 3), forbidden)
    return retrieval.collapse_best(own.select("source", F.col("doc_id").alias("key"), rich.alias("richness")), ["source"], "richness", "key")


@query(f"with {SEARCH}, o as (select query, key, intent, gcov, rank, row_number() over (partition by query order by conf desc, rank) as new_rank from lr where rank <= 10), j as (select o.*, o.key = o.query as expected from o) select count(*) as cases, cast(sum(cast(new_rank < rank as int)) as bigint) as improved, cast(sum(cast(new_rank > rank as int)) as bigint) as worsened, cast(sum(cast(new_rank = rank as int)) as bigint) as unchanged, cast((select count(*) from j a join j b on a.query = b.query and a.new_rank = 1 and b.rank = 1 where a.gcov < b.gcov) as bigint) as boundary_violations from j where expected")
def rerank_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What re-ranking by confidence does to the expected entry, and how often it puts first one that covers fewer groups than before."""
    best = search.local_rank(fused(pairs(spark, sf_dir)), "query", "key", 10)
    return curation.rerank_report(search.rank_within(best, "query", [F.desc("conf"), F.asc("rank")], "new_rank"), F.col("key") == F.col("query"))


@query(f"with {ENTRIES}, c as (select source, count(*) as entries from entries group by 1) select d.source, count(*) as docs, coalesce(any_value(c.entries), 0) as entries from documents d left join c on c.source is not distinct from d.source group by 1")
def coverage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and entries by source, sources without entries too."""
    files = load(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("docs"))
    return curation.coverage(files, entries(spark, sf_dir), "source", "entries")


@query("select doc_id, score, priority from (select d.doc_id, case when n_chars < 200 then 3 else 0 end + case when l.quality is null then 2 when l.quality = 0 then 4 else 0 end as score from documents d left join (select doc_id, max(quality) as quality from labels group by 1) l using (doc_id)) , lateral (select case when score >= 7 then 'high' when score >= 5 then 'medium' else 'low' end as priority) where score >= 3")
def quality_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose score of defects asks for review, with their priority."""
    labels = load(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = load(spark, sf_dir, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left")
    score = F.when(F.col("n_chars") < 200, 3).otherwise(0) + F.when(F.col("quality").isNull(), 2).when(F.col("quality") == 0, 4).otherwise(0)
    return curation.queue(rows.select("doc_id", score.alias("score")), "score", 3, 5, 7)


NOISE = {"script": r"<script", "comment": r"<!--", "entity": r"&[a-z]+;", "style": r"style="}


@query("select marker, cast(sum(n) as bigint) as hits, cast(sum(cast(n > 0 as int)) as bigint) as pages from (" + " union all ".join(f"select '{k}' as marker, len(regexp_extract_all(coalesce(html, ''), '{v}')) as n from pages" for k, v in NOISE.items()) + ") group by 1")
def noise_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often known noise stands in pages, and in how many."""
    return curation.marker_counts(load(spark, sf_dir, "pages"), "html", NOISE, "pages")


PAIRS_SQL = "p as (select conv_id || ':' || turn as pair_id, question, answer from (select conv_id, turn, role, text as question, lead(text) over w as answer, lead(role) over w as next_role from conversations window w as (partition by conv_id order by turn)) where role = 'user' and next_role = 'assistant')"
ROLE = "case when right(source, 1) in ('1', '3', '5', '7', '9') then 'validation_only' else 'development_only' end"
PART = "case when doc_id % 2 = 0 or doc_id % 97 = 0 then 'development_only' else 'validation_only' end"


@query(f"""
with r as (select doc_id, source, text, {ROLE} as role, {PART} as part, sha256(coalesce(text, '')) as hash, regexp_replace(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[^0-9a-z\\x{{3400}}-\\x{{9fff}}]', '', 'g') as k from documents), {PAIRS_SQL},
l as (select doc_id, toxic from labels)
select rule, cast(n as bigint) as n from (
  select 'partition_mismatch' as rule, count(*) as n from r where role <> part
  union all select 'missing_id', count(*) from r where doc_id is null
  union all select 'duplicate_id', count(*) from (select doc_id from r where doc_id is not null group by 1 having count(*) > 1)
  union all select 'bad_hash', count(*) from r where not regexp_matches(hash, '^[0-9a-f]{{64}}$')
  union all select 'missing_text', count(*) from r where coalesce(text, '') = ''
  union all select 'cross_partition_key', count(*) from (select k from r where k <> '' group by 1 having count(distinct part) > 1)
  union all select 'residual_email', count(*) from r where regexp_matches(text, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9.-]+')
  union all select 'residual_phone', count(*) from r where regexp_matches(text, '\\(?[0-9]{{3}}\\)?[ -][0-9]{{3}}-?[0-9]{{4}}')
  union all select 'residual_id_card', count(*) from r where regexp_matches(text, '[0-9]{{17}}[0-9Xx]')
  union all select 'duplicate_pair_id', count(*) from (select pair_id from p group by 1 having count(*) > 1)
  union all select 'empty_answer', count(*) from p where coalesce(trim(answer), '') = ''
  union all select 'answer_leakage', count(*) from p where length(answer) >= 10 and length(question) >= 10 and list_has_any(list_transform(range(1, length(question) - 8), lambda i: substr(question, cast(i as int), 10)), list_transform(range(1, length(answer) - 8), lambda i: substr(answer, cast(i as int), 10)))
  union all select 'orphan_label', count(*) from l where doc_id not in (select doc_id from documents where doc_id is not null)
  union all select 'conflicting_label', count(*) from (select doc_id from l group by 1 having count(distinct toxic) > 1))
""")
def processed_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen rules over records, pairs and labels; the number of offenders of each."""
    odd = F.right("source", F.lit(1)).isin("1", "3", "5", "7", "9")
    role = F.when(odd, "validation_only").otherwise("development_only")
    part = F.when((F.col("doc_id") % 2 == 0) | (F.col("doc_id") % 97 == 0), "development_only").otherwise("validation_only")
    whole = F.coalesce("text", F.lit(""))
    records = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), whole.alias("text"), role.alias("role"), part.alias("partition"), F.sha2(whole, 256).alias("hash"), text.dedupe_key(F.col("text")).alias("key"))
    pairs_ = qa(spark, sf_dir).select(F.concat_ws(":", "conv_id", "turn").alias("id"), "question", "answer")
    labels = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    from tessella.plans.documents import EMAIL, PHONE

    return curation.integrity(records, pairs_, labels, {"email": EMAIL, "phone": PHONE, "id_card": "[0-9]{17}[0-9Xx]"})


@query(f"with {SEARCH}, a as (select query, min(rank) as rank from lr where kname = 'formula_syndrome' group by 1), b as (select query, min(r1) as rank from fus where kname = 'formula_syndrome' group by 1), c as (select query, min(r2) as rank from fus where kname = 'formula_syndrome' group by 1) select a.query, a.rank as local, b.rank as overlap, c.rank as specificity, a.rank = b.rank and b.rank = c.rank as same from a join b using (query) join c using (query)")
def aligned_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rankings of the same cases side by side."""
    rows = fused(pairs(spark, sf_dir))
    rows = search.local_rank(rows, "query", "key", 2**31 - 1).where("kind = 'formula_syndrome'")
    best = lambda c: rows.groupBy("query").agg(F.min(c).cast("long").alias("rank"))
    return curation.align({"local": best("rank"), "overlap": best("r1"), "specificity": best("r2")}, "query")


WORDS = {"en": ["the", "and", "of"], "de": ["der", "die", "und"], "fr": ["les", "des", "que"], "es": ["los", "que", "una"]}


@query("with s as (select conv_id, turn, t.lang, 3 * len(list_filter(t.words, lambda w: contains(lower(text), w))) + cast(t.lang = 'en' as int) as score from conversations, (values " + ", ".join(f"('{k}', [{', '.join(repr(w) for w in v)}])" for k, v in WORDS.items()) + ") as t(lang, words)) select conv_id, turn, lang, score::int as score from s where score > 0 qualify row_number() over (partition by conv_id, turn order by score desc, lang) = 1")
def inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind that a turn's words speak for: 3 a keyword, 1 a hit of another source."""
    rows = load(spark, sf_dir, "conversations")
    ranked = curation.inferred(F.lower("text"), WORDS, F.array(F.lit("en")))
    return rows.select("conv_id", "turn", F.get(ranked, F.lit(0)).alias("b")).where("b is not null").select("conv_id", "turn", F.col("b.kind").alias("lang"), F.col("b.score").alias("score"))


@query(f"with q as (select distinct unnest({TOK}) as term from benchmark), d as (select distinct unnest({TOK}) as term from documents) select term from q semi join d using (term) where length(term) between 2 and 16")
def global_candidate_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the benchmark that stand in some document."""
    words = lambda t: load(spark, sf_dir, t).select(F.explode(text.words(F.col("text"))).alias("term"))
    return words("benchmark").where(F.length("term").between(2, 16)).distinct().join(words("documents").distinct(), "term", "left_semi")


@query(f"with {ENTRIES}, r as (select term, doc_id, rn, case when rn <= 6 then 'required' when rn <= 9 then 'diagnostic' else 'differential' end as role from ranked) select term, min_by(doc_id, doc_id * 100 + rn) as first_entry, array_to_string(list_sort(list(distinct role)), ',') as roles from r group by 1")
def term_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each term's roles in all entries, and the entry that has it first."""
    role = F.when(F.col("rn") <= 6, "required").when(F.col("rn") <= 9, "diagnostic").otherwise("differential")
    rows = entry_terms(spark, sf_dir).select("term", "doc_id", role.alias("role"), F.struct("doc_id", "rn").alias("place"))
    return curation.roles(rows, "term", "role", "place", "doc_id").select("term", F.col("first").alias("first_entry"), "roles")


@query("with c as (select conv_id, turn, trim(regexp_replace(trim(coalesce(text, '')), '[.,]?\\s*(?:Please|Answer)[^.]*\\.?$', '')) as t, coalesce(text, '') as text from conversations) select conv_id, turn, md5(regexp_replace(regexp_replace(t, '\\s+', ' ', 'g'), '^[ 。；;]+|[ 。；;]+$', '', 'g')) as query_md5, len(list_filter(regexp_split_to_array(text, '[，,。；;！!？?\\n]'), lambda x: trim(x) <> '')) as clauses from c")
def clean_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as questions, without closing instructions, and their clauses."""
    rows = load(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.md5(payload.clean_query(F.col("text"), r"[.,]?\s*(?:Please|Answer)[^.]*\.?$")).alias("query_md5"), payload.clause_count(F.col("text")).cast("long").alias("clauses"))


@query(f"with {PAIRS_SQL} select pair_id, md5(question) as question_md5, md5(answer) as answer_md5 from p where length(question) >= 8 and length(answer) >= 30 and not regexp_matches(answer, '^(?:Of|To|And) ') and regexp_matches(question, '(?:the|der|les|que)') qualify row_number() over (partition by question, answer order by pair_id) = 1")
def useful_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs long enough, without an empty opening, with a keyword; each once."""
    rows = qa(spark, sf_dir).select(F.concat_ws(":", "conv_id", "turn").alias("pair_id"), "question", "answer")
    return curation.useful_pairs(rows, "pair_id", 8, 30, "^(?:Of|To|And) ", "(?:the|der|les|que)")


@query(f"with {ENTRIES}, e as (select doc_id, terms, terms[1:6] as known from entries), t as (select doc_id, list_filter(terms, lambda v: len(list_filter(['an', 'en', 'on'], lambda x: contains(v, x) and not contains(array_to_string(known, ' '), x))) = 0) as kept from e) select doc_id, len(kept) as n_kept, array_to_string(kept, ' ') as kept from t")
def unsupported_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms without those that hold a listed part which the evidence lacks."""
    listed = F.array(*map(F.lit, ("an", "en", "on")))
    kept = payload.unsupported(F.col("terms"), listed, F.array_join(F.slice("terms", 1, 6), " "))
    return entries(spark, sf_dir).select("doc_id", kept.alias("kept")).select("doc_id", F.size("kept").cast("long").alias("n_kept"), F.array_join("kept", " ").alias("kept"))


@query("select status, count(*) as n from (select case when d.doc_id is null then 'missing' when l.quality not in (0, 1) then 'invalid' else 'read' end as status from labels l left join (select distinct doc_id from documents) d using (doc_id)) group by 1")
def manifest_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a manifest by whether their file is there and they are valid."""
    return curation.manifest_status(load(spark, sf_dir, "labels"), load(spark, sf_dir, "documents").select("doc_id").distinct(), "doc_id", F.col("quality").isin(0, 1))


@query(f"with {SEARCH}, tt as (select query, rank, place, term from (select query, rank, unnest(terms) as term, generate_subscripts(terms, 1) as place from lr where rank <= 4) where length(term) between 2 and 16), ff as (select query, term, min(rank * 1000 + place) as pos from tt group by 1, 2), nn as (select *, row_number() over (partition by query order by pos) as x from ff) select query, array_to_string(list(term order by x), ' ') as terms from nn where x <= 20 group by 1")
def candidate_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of each query's best entries in order, each once, twenty at most."""
    best = search.local_rank(fused(pairs(spark, sf_dir)), "query", "key", 4)
    return curation.candidate_terms(best, "query", "rank", "terms", 20).select("query", F.array_join("terms", " ").alias("terms"))


@query(f"with {SEARCH}, pr as (select query, list(struct_pack(term := terms[7], score := round(conf, 2)) order by rank) as ps from lr where rank <= 5 and len(terms) >= 7 group by 1), gg as (select a.query, a.asked, a.prim, list_transform(list_filter(ps, lambda p: p.score >= 0.5 and not list_contains(a.negated, p.term))[1:3], lambda p: p.term) as good from asks a join pr using (query)) select query, len(list_distinct(list_concat(asked, good))) as n_terms, len(list_distinct(list_concat(prim, good[1:greatest(0, 4 - len(prim))]))) as n_primary, len(good)::int as accepted from gg")
def merged_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted terms joined to those of a query: well scored, not negated, three at most, one of them primary."""
    best = search.local_rank(fused(pairs(spark, sf_dir)), "query", "key", 5).where(F.size("terms") >= 7)
    row = F.struct("rank", F.struct(F.col("terms")[6].alias("term"), F.round("conf", 2).alias("score")).alias("p"))
    lists = best.groupBy("query", "asked", "primary", "negated").agg(F.sort_array(F.collect_list(row)).alias("ps"))
    merged = payload.merged_terms(F.col("asked"), F.col("primary"), F.col("negated"), F.col("ps.p"), 0.5, 3, 4)
    return lists.select("query", merged.alias("m")).select("query", F.size("m.terms").cast("long").alias("n_terms"), F.size("m.primary").cast("long").alias("n_primary"), "m.accepted")


@query("select table_name, column_name, kind, n_rows from (" + " union all ".join(f"select '{t}' as table_name, '{c}' as column_name, '{k}' as kind, (select count(*) from {t}) as n_rows" for t, c, k in (("labels", "doc_id", "bigint"), ("labels", "quality", "int"), ("labels", "toxic", "int"), ("benchmark", "item_id", "bigint"), ("benchmark", "text", "string"))) + ")")
def parquet_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields, types and rows of tables."""
    return curation.table_profile({t: load(spark, sf_dir, t) for t in ("labels", "benchmark")})


@query("select doc_id, md5(case when contains(text, 'the') or contains(text, 'que') or contains(text, 'der') then 'changed' else text end) as kind from documents")
def asr_mutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with one confusable word swapped by a seeded choice: which change."""
    rows = load(spark, sf_dir, "documents").select("doc_id", "text", payload.mutated(F.col("text"), [("the", "teh"), ("que", "qeu"), ("der", "dre")], "s").alias("m"))
    return rows.select("doc_id", F.md5(F.when(F.col("m") != F.col("text"), "changed").otherwise(F.col("text"))).alias("kind"))


@query(f"with {ENTRIES} select doc_id, sha256(doc_id::varchar || chr(31) || 'q')[:24] as case_id, array_to_string(terms[1:3], ' ') as query from entries")
def public_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public side of cases: an id and a query, without what is expected."""
    rows = entries(spark, sf_dir).select("doc_id", hashing.stable_id(F.col("doc_id").cast("string"), F.lit("q")).alias("case_id"), F.array_join(F.slice("terms", 1, 3), " ").alias("query"), F.col("terms").alias("expected"))
    public, _ = curation.public_private(rows, ["doc_id", "case_id", "query"])
    return public
