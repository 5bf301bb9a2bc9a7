"""Symptom phrases: a text divided into known terms and usable pieces, and old terms put into today's words.

Terms inside texts and pieces are found by the automaton (``operators/matcher.py``),
so a catalogue of any size costs one pass; everything that belongs to one text is
grouped by it and bounded by its length. ``terms`` and ``aliases`` are tables
whose ``place`` gives the order in which they are listed. Null texts are empty;
keys should be unique; repeated terms are one, under their least place.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import strip
from tessella.operators import matcher
from tessella.session import materialize


@dataclass(frozen=True)
class PhraseRules:
    """How a text is cut, and which pieces are no phrases; patterns are regular expressions."""

    cuts: str
    opening: str = ""  # taken from the head of a piece
    closing: str = ""  # and from its end
    rejects: tuple[str, ...] = ()  # pieces that hold one of these are dropped
    stop: tuple[str, ...] = ()
    least: int = 2
    most: int = 12


#: Cuts and rejections for phrases of classical formula texts.
CLASSICAL = PhraseRules(
    cuts=r"[，、；;。.\n]|或|及|并|而|兼见|伴",
    opening=r"^(?:黄帝曰|岐伯曰|问曰|曰)[:：]",
    closing=r"(?:者|也)$",
    rejects=(
        r"^(?:取|刺|灸|补|泻|浅刺|深刺|当刺|可刺).{0,8}$", "取之|刺之|灸之|补之|泻之", "可令|立快|主之|宜之", "方见|见上|见中焦篇",
        "^(?:下之则愈|下之则和|当发其汗|缓中补虚|五日可治|七日不可治|乃治痞|当下其癥|止逆下气)$", r"^宜.+(?:汤|丸|散|饮|方).{0,8}$", "^(?:当须|见)",
        "本方|临床应用|剂量|方宜|代表方|治疗|使用|现代|属于", "主之|可与|方用前法|如前法|不可|此误也|勿|禁", "与.+(?:汤|丸|散|饮|方)", "(?:汤|丸|散|饮|方)$", "证|主治|用于",
    ),
)


def _listed(terms: DataFrame) -> DataFrame:
    return materialize(terms.select(F.trim("term").alias("term"), "place").where("term <> ''").groupBy("term").agg(F.min("place").alias("place")), "terms")


def split_phrases(rows: DataFrame, key: str, text: Column, terms: DataFrame, rules: PhraseRules = CLASSICAL) -> DataFrame:
    """(key, phrases): the listed terms that a text holds, in their own order, then the pieces between its cuts that are usable and hold no term, in the text's."""
    known = _listed(terms)
    said = materialize(rows.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text")), "texts")
    hits = matcher.find_terms(said, "key", F.col("text"), known, "all").select("key", "term").distinct().join(known, "term")
    hits = hits.select("key", F.lit(0).alias("late"), F.col("place").cast("long").alias("at"), F.col("term").alias("phrase"))
    piece = strip(F.regexp_replace(strip(F.col("piece")), rules.opening, "") if rules.opening else F.col("piece"))
    cut = said.select("key", F.posexplode(F.split("text", rules.cuts)).alias("at", "piece")).withColumn("piece", piece)
    cut = cut.withColumn("piece", F.regexp_replace("piece", rules.closing, "") if rules.closing else F.col("piece"))
    good = F.length("piece").between(rules.least, rules.most)
    bad = reduce(lambda a, b: a | b, [F.col("piece").rlike(p) for p in rules.rejects], F.col("piece").isin(*rules.stop) if rules.stop else F.lit(False))
    cut = materialize(cut.where(good & ~bad), "pieces")
    # A piece is looked through once, however often it stands.
    holding = matcher.find_terms(cut.select("piece").distinct(), "piece", F.col("piece"), known, "all").where("key <> term").select(F.col("key").alias("piece")).distinct()
    whole = cut.join(holding, "piece", "left_anti").select("key", F.lit(1).alias("late"), F.col("at").cast("long").alias("at"), F.col("piece").alias("phrase"))
    ordered = F.array_sort(F.collect_list(F.struct("late", "at", "phrase")))
    found = hits.unionByName(whole).groupBy("key").agg(F.array_distinct(F.transform(ordered, lambda p: p["phrase"])).alias("phrases"))
    return said.select("key").join(found, "key", "left").select("key", F.coalesce("phrases", F.array().cast("array<string>")).alias("phrases"))


def modernised(rows: DataFrame, key: str, phrases: str, aliases: DataFrame, exact: int = 2, partial: int = 3) -> DataFrame:
    """(key, modern, aliases) for arrays of phrases.

    ``aliases``: term, alias, place. A phrase that is a listed term gives its
    first ``exact`` aliases; one that holds listed terms the first ``partial``
    of theirs, term by term; any other gives itself. ``aliases`` has all that
    were met. Each wording stands once, at its first place.
    """
    table = materialize(aliases.where("term <> '' and alias is not null").select("term", "alias", "place"), "aliases")
    first = table.groupBy("term").agg(F.min("place").alias("first"))
    each = rows.select(F.col(key).alias("key"), F.posexplode(phrases).alias("at", "phrase"))
    distinct = materialize(each.select("phrase").where("phrase is not null").distinct(), "phrases")
    own = distinct.join(table, F.col("phrase") == F.col("term")).select("phrase", F.lit(exact).alias("n"), F.struct(F.lit(0).alias("first"), "place", "alias").alias("a"))
    rest = distinct.join(table.select(F.col("term").alias("phrase")).distinct(), "phrase", "left_anti")
    held = matcher.find_terms(rest, "phrase", F.col("phrase"), table.select("term").where("length(term) >= 2").distinct(), "all").select(F.col("key").alias("phrase"), "term").distinct()
    inside = held.join(table, "term").join(first, "term").select("phrase", F.lit(partial).alias("n"), F.struct("first", "place", "alias").alias("a"))
    known = own.unionByName(inside).groupBy("phrase", "n").agg(F.transform(F.array_sort(F.collect_list("a")), lambda a: a["alias"]).alias("all"))
    mapped = each.join(known, "phrase", "left")
    none = F.array().cast("array<string>")
    modern = F.when(F.col("all").isNull(), F.array("phrase")).otherwise(F.slice("all", F.lit(1), F.col("n")))
    lists = F.array_sort(F.collect_list(F.struct("at", modern.alias("modern"), F.coalesce("all", none).alias("all"))))
    flat = lambda field: F.array_distinct(F.flatten(F.transform("lists", lambda p: p[field])))
    found = mapped.groupBy("key").agg(lists.alias("lists")).select("key", flat("modern").alias("modern"), flat("all").alias("aliases"))
    return rows.select(F.col(key).alias("key")).distinct().join(found, "key", "left").select("key", *[F.coalesce(c, none).alias(c) for c in ("modern", "aliases")])
