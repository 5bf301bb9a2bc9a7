"""Text functions: Column in, Column out. All are inside code generation but ``nfc`` and ``unescape``, which call Java by ``reflect``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Masks in order (fixed values: the patterns that cleaning replaces, and what stands for them).
MASKS = (
    ("email", r"(?U)(?<![\w.+-])[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}(?!\w)", "[EMAIL]"),
    ("phone", r"(?U)(?<!\d)(?:\+?86[- ]?)?1[3-9]\d{9}(?!\d)", "[PHONE]"),
    ("id_card", r"(?U)(?<!\d)\d{17}[0-9Xx](?!\d)", "[ID_CARD]"),
    ("account", r"(?U)(?i)(?:微信|wechat|QQ|账号)\s*(?:号|[:：])?\s*[A-Za-z0-9_-]{5,}", "[ACCOUNT]"),
    ("name", r"(?U)(?:我叫|姓名\s*[:：]?\s*)([\x{3400}-\x{9fff}·]{2,8})", "[NAME]"),
    ("address", r"(?U)(?:家住|住在|地址\s*(?:是|[:：])?)\s*[^，。；;\n]{3,50}", "[ADDRESS]"),
)
#: What counts as an address, and as a control character.
URL = r"(?U)(?i)https?://\S+|www\.\S+"
CONTROL = r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}]"
#: A tag begins with a letter right after its bracket, or after a slash.
TAG = r"(?s)<!--.*?-->|<[A-Za-z][^>]*>|</[A-Za-z][^>]*>|<[!?][^>]*>"
WORD = r"[\p{L}\p{N}]+"


def clean_text(text: Column) -> Column:
    """Ideographic blanks to blanks, runs of blanks and tabs to one, three or more line feeds to two, ends stripped."""
    text = F.coalesce(text, F.lit(""))
    text = F.regexp_replace(F.replace(text, F.lit("　"), F.lit(" ")), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def unique(values: Column) -> Column:
    """Cleaned values without empty ones and repeats, first kept."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), clean_text), lambda x: x != ""))


def dedupe_key(text: Column) -> Column:
    """Case folded, ASCII letters, digits and CJK only."""
    # Runs that stay are joined: to take out each of the many others costs four times as much.
    runs = F.regexp_extract_all(casefold(F.coalesce(text, F.lit(""))), F.lit(r"[0-9a-z\x{3400}-\x{9fff}]+"), F.lit(0))
    return F.array_join(runs, "")


def casefold(text: Column) -> Column:
    """Lower case in which letters that are written as several in upper case are those: \u00df, ligatures and the like."""
    # The empty text keeps the planner from dropping the step through upper case.
    return F.lower(F.concat(F.upper(F.concat(F.lower(text), F.lit(""))), F.lit("")))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, though ``body`` names it many times or inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def grams_of(text: Column, n: int) -> Column:
    """All n-grams of a text in order; a shorter text has none.

    One overlapping match of a regular expression; texts with characters
    beyond the basic plane, which that would split, look characters up in an
    array. Both are linear in the text.
    """

    def cut(chars: Column) -> Column:
        heads = F.slice(chars, F.lit(1), F.greatest(F.lit(0), F.size(chars) - (n - 1)))
        return F.transform(heads, lambda c, i: F.concat(c, *[F.get(chars, i + k) for k in range(1, n)]))

    slow = let(F.filter(F.split(text, ""), lambda c: c != ""), cut)
    return F.when(text.rlike(r"[\x{10000}-\x{10ffff}]"), slow).otherwise(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def char_ngrams(key: Column, n: int = 3) -> Column:
    """Distinct n-grams of a key; a shorter key is one gram, an empty one none."""
    none = F.array().cast("array<string>")
    return let(key, lambda k: F.when(F.length(k) >= n, F.array_distinct(grams_of(k, n))).when(k != "", F.array(k)).otherwise(none))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def tokenize(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Retrieval tokens: ASCII runs longer than one; of CJK runs the whole (2 to 8 characters) and all 2- and 3-grams."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\x{3400}-\x{9fff}\x{20000}-\x{2ffff}]+|[a-z0-9]+"), F.lit(0))

    def cut(run: Column) -> Column:
        whole = F.when(F.length(run).between(2, 8), F.array(run)).otherwise(F.array().cast("array<string>"))
        cjk = F.concat(whole, grams_of(run, 2), grams_of(run, 3))
        return F.when(run.rlike("^[a-z0-9]"), F.when(F.length(run) > 1, F.array(run)).otherwise(F.array().cast("array<string>"))).otherwise(cjk)

    tokens = F.flatten(F.transform(runs, cut))
    return F.filter(tokens, lambda t: ~t.isin(*stop)) if stop else tokens


def strip_html(text: Column) -> Column:
    """Tags, comments and declarations out; a bracket that opens none of them is text."""
    return F.when(F.contains(text, F.lit("<")) & F.contains(text, F.lit(">")), F.regexp_replace(text, TAG, "")).otherwise(text)


def nfc(text: Column) -> Column:
    """Unicode normal form C."""
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(False))


def mask(text: Column) -> tuple[Column, dict[str, Column]]:
    """The text with every mask applied in order, and how often each was."""
    counts = {}
    for name, pattern, token in MASKS:
        counts[name] = F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, token.replace("$", r"\$"))
    return text, counts


def unescape(text: Column) -> Column:
    """HTML entities as the characters they stand for."""
    return F.reflect(F.lit("org.apache.commons.text.StringEscapeUtils"), F.lit("unescapeHtml4"), F.coalesce(text, F.lit("")))


def clean_record(text: Column) -> tuple[Column, dict[str, Column]]:
    """The cleaning pipeline: entities, normal form, tags, URLs, control characters, masks, white space; with counts by rule. A null text is empty."""
    whole = nfc(unescape(text))
    bare = strip_html(whole)
    counts = {"html": (bare != whole).cast("int"), "url": F.regexp_count(bare, F.lit(URL))}
    text = F.regexp_replace(bare, URL, "[URL]")
    counts["control"] = F.regexp_count(text, F.lit(CONTROL))
    text, masked = mask(F.regexp_replace(text, CONTROL, " "))
    return F.regexp_replace(F.regexp_replace(text, r"(?U)[\s\x{1c}-\x{1f}]+", " "), "^ | $", ""), counts | masked


def polarity(text: Column, start: Column, negation: str, uncertainty: str, reach: int = 10) -> Column:
    """absent, uncertain or present, by what stands in the ``reach`` characters before ``start`` (from 1)."""
    left = F.substring(text, F.greatest(F.lit(1), start - reach), F.least(F.lit(reach), start - 1))
    return F.when(left.rlike(f"(?:{negation})[^.,;]{{0,2}}$"), "absent").when(left.rlike(f"(?:{uncertainty})[^.,;]{{0,4}}$"), "uncertain").otherwise("present")


def exact_match_count(query: Column, terms: Column) -> Column:
    """Terms of two characters or more that contain the query or stand in it, blanks apart."""
    squeeze = lambda x: F.regexp_replace(F.lower(x), r"\s+", "")
    q = squeeze(query)
    return F.size(F.filter(terms, lambda t: (F.length(squeeze(t)) >= 2) & (F.length(q) >= 2) & (F.contains(q, squeeze(t)) | F.contains(squeeze(t), q))))


def replace_in_order(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, one after another."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def terms_by_rule(text: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Terms of all patterns that match, first mention kept."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.array(none, *[F.when(text.rlike(p), F.array(*map(F.lit, terms))).otherwise(none) for p, terms in rules])))


def first_rule(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern that matches."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out


def weighted_score(text: Column, rules: list[tuple[str, int]]) -> Column:
    """Sum of the weights of the patterns that match."""
    return sum((F.when(text.rlike(p), w).otherwise(0) for p, w in rules), F.lit(0))


def split_headers(text: Column, depth: int = 3) -> Column:
    """Markdown sections: each begins with its header line."""
    return F.filter(F.split(text, rf"(?m)(?=^#{{1,{depth}}} )"), lambda s: F.trim(s) != "")


def pack(pieces: Column, limit: int, glue: str = "\n") -> Column:
    """Greedy packing of consecutive pieces into chunks of at most ``limit`` characters (one longer piece stands alone)."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, piece: Column) -> Column:
        fits = F.length(acc["open"]) + len(glue) + F.length(piece) <= limit
        return F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), piece.alias("open"))).when(
            fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit(glue), piece).alias("open"))
        ).otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), piece.alias("open")))

    return F.aggregate(pieces, zero, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def windows(text: Column, size: int = 400, overlap: int = 80) -> Column:
    """Windows of ``size`` characters, each ``overlap`` into the one before; an empty text has none."""
    step = size - overlap
    none = F.array().cast("array<string>")
    starts = lambda t: F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - overlap), F.lit(step))
    return let(text, lambda t: F.when(F.length(t) > 0, F.transform(starts(t), lambda i: F.substring(t, i, F.lit(size)))).otherwise(none))
