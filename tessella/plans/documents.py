"""Queries that clean, profile, deduplicate and split documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import hashing, markdown, text
from tessella.operators import dedup, metrics, profile, splits
from tessella.plans.registry import query
from tessella.session import broadcast_small, materialize
from tessella.sources.tables import load

EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9.-]+"
PHONE = r"\(?[0-9]{3}\)?[ -][0-9]{3}-?[0-9]{4}"


@query("select lang, source, count(*) as docs, cast(sum(length(text)) as bigint) as chars, max(length(text)) as longest, cast(sum(case when n_chars = length(text) then 1 else 0 end) as bigint) as consistent from documents group by 1, 2")
def doc_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("text").cast("long")
    return load(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("docs"), F.sum(size).alias("chars"), F.max(size).alias("longest"), F.sum(F.when(F.col("n_chars") == size, 1).otherwise(0)).alias("consistent"))


@query(f"""
with masked as (select doc_id, regexp_replace(text, '{EMAIL}', '[EMAIL]', 'g') as t, len(regexp_extract_all(text, '{EMAIL}')) as emails from documents),
more as (select doc_id, emails, len(regexp_extract_all(t, '{PHONE}')) as phones, regexp_replace(t, '{PHONE}', '[PHONE]', 'g') as t from masked),
done as (select doc_id, emails, phones, regexp_replace(regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') as t from more)
select doc_id, cast(emails as bigint) as emails, cast(phones as bigint) as phones, length(t) as n_clean, md5(t) as clean_md5 from done
""")
def clean_text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", EMAIL, "[EMAIL]").alias("t"), F.regexp_count("text", F.lit(EMAIL)).cast("long").alias("emails"))
    masked = docs.select("doc_id", "emails", F.regexp_count("t", F.lit(PHONE)).cast("long").alias("phones"), text.clean_text(F.regexp_replace("t", PHONE, "[PHONE]")).alias("t"))
    return masked.select("doc_id", "emails", "phones", F.length("t").cast("long").alias("n_clean"), F.md5("t").alias("clean_md5"))


@query(f"select case when regexp_matches(text, '{EMAIL}') then 'email' when regexp_matches(text, '{PHONE}') then 'phone' else 'none' end as residual, count(*) as docs from documents group by 1")
def pii_residual_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").groupBy(text.first_rule(F.col("text"), [(EMAIL, "email"), (PHONE, "phone")], "none").alias("residual")).agg(F.count("*").alias("docs"))


KEY_SQL = "regexp_replace(replace(lower(text), 'ß', 'ss'), '[^0-9a-z\\x{3400}-\\x{9fff}]', '', 'g')"


@query(f"select case when length({KEY_SQL}) < 4 then 'too_short' when length(text) > 2000 then 'too_long' else 'kept' end as drop_reason, source, count(*) as docs from documents group by 1, 2")
def drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.length(text.dedupe_key(F.col("text"))) < 4, "too_short").when(F.length("text") > 2000, "too_long").otherwise("kept")
    return load(spark, sf_dir, "documents").groupBy(reason.alias("drop_reason"), "source").agg(F.count("*").alias("docs"))


@query(f"select doc_id, row_number() over (partition by {KEY_SQL} order by source, doc_id) as dup_rank from documents")
def exact_dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(text.dedupe_key(F.col("text")), 256).alias("key"))
    return dedup.keep_first(docs, "key", ["source", "doc_id"]).select("doc_id", F.col("dup_rank").cast("long").alias("dup_rank"))


GRAMS_SQL = f"keyed as (select doc_id, {KEY_SQL} as k from documents), grams as (select doc_id, unnest(case when length(k) >= 3 then list_distinct(list_transform(range(1, length(k) - 1), lambda i: substr(k, i, 3))) when k <> '' then [k] else [] end) as gram from keyed)"


@query(f"with {GRAMS_SQL} select doc_id, count(*) as n_grams, min(gram) as first_gram, max(gram) as last_gram from grams group by 1")
def shingle_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = load(spark, sf_dir, "documents").select("doc_id", text.dedupe_key(F.col("text")).alias("k"))
    grams = keyed.select("doc_id", F.explode(text.char_ngrams(F.col("k"))).alias("gram"))
    return grams.groupBy("doc_id").agg(F.count("*").alias("n_grams"), F.min("gram").alias("first_gram"), F.max("gram").alias("last_gram"))


SIMHASH_SQL = f"""{GRAMS_SQL},
digests as (select doc_id, ('0x' || substr(md5(gram), 1, 8))::bigint as hi, ('0x' || substr(md5(gram), 9, 8))::bigint as lo from grams),
bits as (select doc_id, b, 2 * sum((case when b >= 32 then hi >> (b - 32) else lo >> b end) & 1) >= count(*) as one from digests, (select unnest(range(64)) as b) group by 1, 2),
hashes as (select doc_id as id, cast(sum(case when one and b >= 32 then 1::bigint << (b - 32) else 0 end) as bigint) as hi, cast(sum(case when one and b < 32 then 1::bigint << b else 0 end) as bigint) as lo from bits group by 1)"""


@query(f"with {SIMHASH_SQL} select id as doc_id, hi, lo from hashes")
def simhash_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", text.dedupe_key(F.col("text")).alias("k"))
    return dedup.simhash64(docs, "doc_id", "k").select(F.col("id").alias("doc_id"), "hi", "lo")


@query(f"""
with {SIMHASH_SQL},
nodes as (select hi, lo, min(id) as id from hashes group by 1, 2),
bands as (select id, hi, lo, unnest([{{'band': 0, 'v': (hi >> 16) & 65535}}, {{'band': 1, 'v': hi & 65535}}, {{'band': 2, 'v': (lo >> 16) & 65535}}, {{'band': 3, 'v': lo & 65535}}]) as s from nodes)
select distinct a.id as a, b.id as b, cast(bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) as bigint) as distance from bands a join bands b on a.s = b.s and a.id < b.id where bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 7
""")
def near_dup_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", text.dedupe_key(F.col("text")).alias("k"))
    return dedup.band_pairs(dedup.simhash64(docs, "doc_id", "k")).select("a", "b", F.col("distance").cast("long").alias("distance"))


#: Components by all links of 0.93 or more between keys (a recursive query).
COMPONENTS_SQL = f"""keyed as (select doc_id, {KEY_SQL} as k from documents), keys as (select k, min(doc_id) as head from keyed where k <> '' group by 1),
grams as (select head, unnest(case when length(k) >= 3 then list_distinct(list_transform(range(1, length(k) - 1), lambda i: substr(k, i, 3))) else [k] end) as gram from keys), sized as (select head, count(*) as n from grams group by 1),
shared as (select x.head as a, y.head as b, count(*) as n from grams x join grams y on x.gram = y.gram and x.head < y.head group by 1, 2),
links as (select a, b from shared join sized sa on sa.head = a join sized sb on sb.head = b where shared.n::double / (sa.n + sb.n - shared.n) >= 0.93),
twoway as (select a, b from links union all select b, a from links), reach as (select head as node, head as root from keys union select twoway.b, reach.root from reach join twoway on twoway.a = reach.node),
parts as (select node, min(root) as part from reach group by 1), components as (select keyed.doc_id, coalesce(part, keyed.doc_id) as component from keyed left join keys on keys.k = keyed.k left join parts on node = head)"""


@query(f"with recursive {COMPONENTS_SQL} select doc_id, component from components")
def near_dup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup.dedupe_keys(load(spark, sf_dir, "documents"), "doc_id", "text")
    return dedup.near_duplicate_components(docs, "doc_id", "k").select(F.col("id").alias("doc_id"), "component")


@query(f"""
with {GRAMS_SQL}, sized as (select doc_id, count(*) as n from grams group by 1), keys as (select k, min(doc_id) as head from keyed where k <> '' group by 1),
copies as (select c.doc_id as b, keys.head as a from keyed c join keys on c.k = keys.k where c.doc_id <> keys.head)
select a, b, 1.0 as jaccard from copies
""")
def exact_copy_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", F.sha2(text.dedupe_key(F.col("text")), 256).alias("k"), (text.dedupe_key(F.col("text")) != "").alias("full")).where("full")
    heads = docs.groupBy("k").agg(F.min("doc_id").alias("a"))
    return docs.join(heads, "k").where("doc_id <> a").select("a", F.col("doc_id").alias("b"), F.lit(1.0).alias("jaccard"))


@query(f"""
with keyed as (select doc_id, {KEY_SQL} as k from documents), keys as (select k, min(doc_id) as head from keyed where k <> '' group by 1),
grams as (select head, unnest(case when length(k) >= 3 then list_distinct(list_transform(range(1, length(k) - 1), lambda i: substr(k, i, 3))) else [k] end) as gram from keys), sized as (select head, count(*) as n from grams group by 1),
shared as (select x.head as a, y.head as b, count(*) as n from grams x join grams y on x.gram = y.gram and x.head < y.head group by 1, 2)
select a, b, shared.n::double / (sa.n + sb.n - shared.n) as jaccard from shared join sized sa on sa.head = a join sized sb on sb.head = b where shared.n::double / (sa.n + sb.n - shared.n) >= 0.93
union all select head, doc_id, 1.0::double from keyed join keys using (k) where doc_id <> head
""")
def near_dup_pairs_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All links at 0.93 or more between keys, each under its least id, and of every copy to that id."""
    docs = dedup.dedupe_keys(load(spark, sf_dir, "documents"), "doc_id", "text")
    nodes, members = dedup.distinct_keys(docs, "doc_id", "k")
    copies = members.where("node <> id").select(F.col("node").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard"))
    return dedup.near_pairs(nodes).unionByName(copies)


@query()
def greedy_near_dup_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In ascending id, a document is kept unless it is linked at 0.93 or more to one kept before; without a key it is kept."""
    docs = dedup.dedupe_keys(load(spark, sf_dir, "documents"), "doc_id", "text")
    nodes, members = dedup.distinct_keys(docs, "doc_id", "k")
    gone = dedup.greedy_dropped(dedup.near_pairs(nodes)).unionByName(members.where("node <> id").select("id")).withColumn("gone", F.lit(True))
    return docs.select("doc_id").join(gone, F.col("doc_id") == F.col("id"), "left").select("doc_id", F.col("gone").isNull().alias("kept"))


TOKENS = "regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')"


@query(f"""
with dg as (select distinct doc_id, list_aggregate(w[i:i + 9], 'string_agg', ' ') as g from (select doc_id, {TOKENS.format(c="text")} as w from documents), unnest(range(1, greatest(len(w) - 8, 1))) as t(i) where len(w) >= 10),
bg as (select distinct item_id, list_aggregate(w[i:i + 9], 'string_agg', ' ') as g from (select item_id, {TOKENS.format(c="text")} as w from benchmark), unnest(range(1, greatest(len(w) - 8, 1))) as t(i) where len(w) >= 10)
select doc_id, item_id, count(*) as shared from dg join bg using (g) group by 1, 2
""")
def contamination_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    def tokens(table: str, key: str) -> DataFrame:
        return load(spark, sf_dir, table).select(key, text.words(F.col("text")).alias("w")).where(F.size("w") >= 10)

    def hashed(rows: DataFrame, key: str) -> DataFrame:
        places = F.sequence(F.lit(1), F.size("w") - 9)
        each = text.let(F.transform("w", lambda x: F.xxhash64(x)), lambda h: F.transform(places, lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(10)])))
        return rows.select(key, F.explode(F.array_distinct(each)).alias("g"))

    def grams(w: str):
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 9), lambda i: F.array_join(F.slice(w, i, F.lit(10)), " ")))

    docs, items = tokens("documents", "doc_id"), tokens("benchmark", "item_id")
    # Hashes of ten words find the pairs; only these are compared word by word. The benchmark's hashes are broadcast if counted to be few.
    known = broadcast_small(materialize(hashed(items, "item_id"), "benchmark"))
    pairs = broadcast_small(materialize(hashed(docs, "doc_id").join(known, "g").select("doc_id", "item_id").distinct(), "pairs"))
    both = docs.join(pairs, "doc_id").join(items.withColumnRenamed("w", "v"), "item_id")
    return both.select("doc_id", "item_id", F.size(F.array_intersect(grams("w"), grams("v"))).cast("long").alias("shared")).where("shared > 0")


@query("select doc_id, left(sha256(source || chr(31) || cast(doc_id as varchar)), 24) as stable_id, left(sha256('salt|' || cast(doc_id as varchar)), 16) as salted, case when left(sha256('query-split' || chr(31) || cast(doc_id as varchar)), 16) < '2666666666666600' then 'dev' else 'train' end as split from documents")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return load(spark, sf_dir, "documents").select("doc_id", hashing.stable_id(F.col("source"), d).alias("stable_id"), hashing.salted_hash("salt", d, 16).alias("salted"), hashing.stable_split(d, 0.15, "query-split").alias("split"))


@query("select doc_id, lang, place from (select doc_id, lang, row_number() over (partition by lang order by sha256('quota|' || cast(doc_id as varchar)), doc_id) as place from documents) where place <= 25")
def stratified_quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    return splits.quota_sample(docs, "lang", "doc_id", 25).select("doc_id", "lang", F.col("place").cast("long").alias("place"))


@query("select doc_id, source, place from (select doc_id, source, row_number() over (partition by source order by n_chars desc, sha256('pool|' || cast(doc_id as varchar)), doc_id) as place from documents) where place <= 10")
def bounded_pool_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return splits.pool(docs, "source", F.col("n_chars"), "doc_id", 10).select("doc_id", "source", F.col("place").cast("long").alias("place"))


SCORES_SQL = "s as (select doc_id, len(regexp_extract_all(text, '\\?')) as question, len(regexp_extract_all(text, '\\n')) as listing, n_chars as long from documents)"
_best = "{name} as (select doc_id from s where {name} > 0{without} order by {name} desc, sha256('{name}|' || cast(doc_id as varchar)), doc_id limit 40)"


@query(f"with {SCORES_SQL}, " + ", ".join(_best.format(name=n, without="".join(f" and doc_id not in (select doc_id from {t}_picked)" for t in taken)).replace(f"{n} as", f"{n}_picked as") for n, taken in (("question", []), ("listing", ["question"]), ("long", ["question", "listing"]))) + " select doc_id, 'question' as category from question_picked union all select doc_id, 'listing' from listing_picked union all select doc_id, 'long' from long_picked")
def disjoint_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    scores = {"question": F.regexp_count("text", F.lit(r"\?")), "listing": F.regexp_count("text", F.lit(r"\n")), "long": F.col("n_chars")}
    return splits.allocate(docs, "doc_id", scores, 40)


@query("select doc_id, source, lang from (select doc_id, source, lang, row_number() over (partition by source, lang order by n_chars desc, sha256('balance|' || cast(doc_id as varchar)), doc_id) as round from documents) order by round, sha256('turn|' || cast(doc_id as varchar)), doc_id limit 100")
def balanced_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return splits.balance(docs, "source", "lang", "n_chars", "doc_id", 100).select("doc_id", "source", "lang")


@query("select d.doc_id from documents d anti join labels l on d.doc_id = l.doc_id")
def unlabeled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("select l.doc_id from labels l anti join documents d on d.doc_id = l.doc_id")
def orphan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents"), "doc_id", "left_anti").select("doc_id")


@query("select coalesce(d.doc_id, l.doc_id) as doc_id, case when l.doc_id is null then 'missing' else 'extra' end as side from documents d full join labels l on d.doc_id = l.doc_id where d.doc_id is null or l.doc_id is null")
def idset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = load(spark, sf_dir, "documents").select("doc_id"), load(spark, sf_dir, "labels").select("doc_id")
    return a.exceptAll(b).select("doc_id", F.lit("missing").alias("side")).unionByName(b.exceptAll(a).select("doc_id", F.lit("extra").alias("side")))


@query("select lang, source, count(*) as docs, cast(sum(n_chars) as bigint) as chars from documents group by rollup(lang, source)")
def rollup_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


@query("select rule, n from (select 'wrong_length' as rule, count(*) as n from documents where n_chars <> length(text) union all select 'residual_email', count(*) from documents where regexp_matches(text, '" + EMAIL + "') union all select 'orphan_label', count(*) from (select doc_id from labels anti join documents using (doc_id)) union all select 'duplicate_id', count(*) from (select doc_id from documents group by 1 having count(*) > 1) union all select 'unlabelled', count(*) from (select doc_id from documents anti join labels using (doc_id)))")
def integrity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    every = F.lit(True)
    return profile.violations({
        "wrong_length": (docs, F.col("n_chars") != F.length("text")), "residual_email": (docs, F.col("text").rlike(EMAIL)), "orphan_label": (labels.join(docs, "doc_id", "left_anti"), every),
        "duplicate_id": (profile.duplicated(docs, "doc_id"), every), "unlabelled": (docs.join(labels, "doc_id", "left_anti"), every),
    })


@query("select doc_id, 5 * cast(n_chars < 100 as int) + 4 * cast(not regexp_matches(text, '[.!?]') as int) + 3 * cast(coalesce(quality, 1) = 0 as int) + 2 * cast(quality is null as int) as score, array_to_string(list_filter([case when n_chars < 100 then 'short' end, case when not regexp_matches(text, '[.!?]') then 'no_sentence' end, case when quality = 0 then 'low_quality' end, case when quality is null then 'unreviewed' end], lambda x: x is not null), ',') as reasons from documents left join labels using (doc_id)")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id", "left")
    rules = {"short": (F.col("n_chars") < 100, 5), "no_sentence": (~F.col("text").rlike("[.!?]"), 4), "low_quality": (F.coalesce(F.col("quality") == 0, F.lit(False)), 3), "unreviewed": (F.col("quality").isNull(), 2)}
    score = sum((F.when(c, w).otherwise(0) for c, w in rules.values()), F.lit(0))
    return rows.select("doc_id", score.alias("score"), F.concat_ws(",", *[F.when(c, name) for name, (c, _) in rules.items()]).alias("reasons"))


@query("select doc_id, cast(i as bigint) as chunk, substr(text, 1 + i * 320, 400) as chunk_text from documents, unnest(range(0, 1 + greatest(0, length(text) - 80 - 1) // 320)) as t(i) where length(text) > 0")
def child_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(text.windows(F.col("text"))).alias("chunk", "chunk_text")).select("doc_id", F.col("chunk").cast("long").alias("chunk"), "chunk_text")


@query()
def parent_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", text.pack(F.split("text", "\n"), 1500).alias("parts"))
    return docs.select("doc_id", F.posexplode("parts").alias("parent", "parent_text"))


@query("with lines as (select doc_id, place, line from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as place from documents)) select doc_id, cast(place as bigint) as place, last_value(case when length(line) < 60 then line end ignore nulls) over (partition by doc_id order by place) as section from lines")
def section_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line"))
    section = F.expr("last(case when length(line) < 60 then line end, true) over (partition by doc_id order by p rows between unbounded preceding and current row)")
    return lines.select("doc_id", (F.col("p") + 1).cast("long").alias("place"), section.alias("section"))


@query("select page.d, count(*) as n from (select coalesce(regexp_extract(url, '://([^/?#]*)', 1), '') as d from pages) page group by 1")
def pages_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").groupBy(F.coalesce(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit("")).alias("d")).agg(F.count("*").alias("n"))


TITLE, LINK = r"<title>([^<]*)</title>", r"<a href=\"([^\"]*)\""
DROPPED = "script style nav header footer noscript".split()


@query(f"select page_id, regexp_extract(html, '{TITLE}', 1) as title, cast(len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as bigint) as links from pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", TITLE, 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).cast("long").alias("links"))


@query("select link, count(*) as uses from (select unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) as link from pages) group by 1")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("link")).groupBy("link").agg(F.count("*").alias("uses"))


MAIN_SQL = "html"
for _tag in DROPPED:
    MAIN_SQL = f"regexp_replace({MAIN_SQL}, '(?s)<{_tag}\\b.*?</{_tag}>', ' ', 'g')"


@query(f"with t as (select page_id, trim(regexp_replace(regexp_replace({MAIN_SQL}, '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) as t from pages) select page_id, length(t) as n_chars, md5(t) as text_md5 from t")
def html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    for tag in DROPPED:
        html = F.regexp_replace(html, rf"(?s)<{tag}\b.*?</{tag}>", " ")
    t = F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"[ \t\r\n]+", " "))
    return load(spark, sf_dir, "pages").select("page_id", t.alias("t")).select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"))


@query("select key, type, count(*) as n from (select unnest(json_keys(props)) as key, props from events) e, lateral (select case json_type(props, '$.' || key) when 'VARCHAR' then 'str' when 'BIGINT' then 'int' when 'UBIGINT' then 'int' when 'DOUBLE' then 'float' when 'BOOLEAN' then 'bool' when 'NULL' then 'null' when 'ARRAY' then 'list' else 'dict' end as type) group by 1, 2")
def json_props_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.json_profile(load(spark, sf_dir, "events"), "props")


@query("with v as (select event_type, list_sort(list(value)) as s, count(*) as n from events where value is not null group by 1) select event_type, n, s[greatest(cast(ceil(n * 0.95) as bigint) - 1, 0) + 1] as p_ceil, s[cast(round_even((n - 1) * 0.95, 0) as bigint) + 1] as p_round, s[least(cast(floor(n * 0.95) as bigint), n - 1) + 1] as p_int from v")
def percentile_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.percentiles(load(spark, sf_dir, "events"), "value", 0.95, "event_type")


@query("with l as (select doc_id, string_split(text, chr(10)) as ls, text from documents), f as (select doc_id, text, ls, list_filter(ls, lambda x: trim(x) <> '') as fl from l) select doc_id, cast(len(regexp_extract_all(text, '[^\\s]+')) as bigint) as words, contains(text, '|') as tables, round(case when len(fl) > 0 then length(array_to_string(fl, ''))::double / len(fl) else 0.0 end, 4) as mean_line, round((len(ls) - len(fl))::double / len(ls), 4) as empty_ratio from f")
def markdown_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", markdown.quality(F.col("text")).alias("q")).select("doc_id", "q.words", "q.tables", "q.mean_line", "q.empty_ratio")


@query("with c as (select doc_id, len(regexp_extract_all(text, 'the')) as en, len(regexp_extract_all(text, 'der')) as de, len(regexp_extract_all(text, 'que')) as es from documents) select doc_id, case when greatest(en, de, es) = 0 then null when en >= de and en >= es then 'en' when de >= es then 'de' else 'es' end as direction from c")
def direction_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", markdown.direction(F.col("text"), {"en": ["the"], "de": ["der"], "es": ["que"]}).alias("direction"))


@query("select doc_id, cast(3 * cast(regexp_matches(text, '[0-9]{3}') as int) + 2 * cast(regexp_matches(text, '\\?') as int) + cast(regexp_matches(text, '\\n') as int) as int) as score from documents")
def category_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", text.weighted_score(F.col("text"), [("[0-9]{3}", 3), (r"\?", 2), (r"\n", 1)]).alias("score"))
