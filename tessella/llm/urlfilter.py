"""URL filtering: pattern rules indexed by their rarest literal token.

A URL is cut into tokens (runs of ASCII letters and digits, lower-cased). Each
rule is filed under that one of its literal tokens which the URLs at hand use
least. The tokens of a URL fetch candidate rules, and only those run their
regular expression. A rule without any literal token is filed under the empty
token, which every URL has, so no rule is ever missed.

Pattern syntax: ``||`` anchors at a host or any parent domain, ``*`` stands for
any run, ``^`` for a separator or the end; everything else is literal, and the
pattern may match anywhere. ``SiteRule`` names a host (with its subdomains) and
a path prefix; the longest site rule that fits decides. Where none fits, a
pattern that allows overrules one that blocks; where no pattern fits, the
verdict is "allow".

Defined cases: a null URL, or one without ``://``, has an empty host and path,
no site rule, and the verdict "allow" unless a pattern matches its text. Equal
rows stay equal rows. Other columns pass through unless they clash with the
output's names; those of the input are then replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules the index is a literal of the plan and is broadcast; beyond, it is joined by a shuffle.
BROADCAST_RULES = 20_000


@dataclass(frozen=True)
class SiteRule:
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    action: str
    pattern: str

    @property
    def name(self) -> str:
        return self.pattern


#: The default patterns: advertising, tracking, sign-in and session pages, adult and gambling words.
PATTERNS = tuple(
    PatternRule("block", p)
    for p in (
        "||doubleclick.net^", "||adservice.", "/ads/", "/adserver/", "/banner/*/click", "/track/pixel", "/beacon.gif", "/wp-login.php", "/wp-admin/", "/xmlrpc.php",
        "?sessionid=", "&sessionid=", ";jsessionid=", "/cart/checkout", "/logout?", "||casino.", "||casino-", "/casino/", "||adult.", "||adult-", "||spam.", "||spam-", "-pills.", "||ads.", "||ads-", "||track.", "||track-", "||porn.", "/porn/", "/xxx/", "/viagra^", "/warez/", ".exe^",
    )
) + (PatternRule("allow", "||example.com/ads/policy"),)


def _site_regex(rule: SiteRule) -> str:
    return r"^(?:[^/]*\.)?" + _quote(rule.host) + _quote(rule.path)


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_ -])", r"\\\1", text)


def _pattern_regex(pattern: str) -> str:
    head, body = "", pattern
    if body.startswith("||"):
        head, body = r"^[^:/?#]*://(?:[^/?#]*\.)?", body[2:]
    parts = {"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|$)"}
    return head + "".join(parts.get(c) or _quote(c) for c in body.translate(str.maketrans(UPPER, LOWER)))


def _literal_tokens(rule: SiteRule | PatternRule) -> list[str]:
    """Tokens that every matching URL has as whole tokens: runs that the rule itself bounds on both sides."""
    if isinstance(rule, SiteRule):
        text = f".{rule.host}{rule.path}"
        if not rule.path.startswith("/"):
            text = f".{rule.host}"[:-1] if rule.path or not rule.host else f".{rule.host}"
    else:
        text = ("." + rule.pattern[2:]) if rule.pattern.startswith("||") else rule.pattern
    found = re.findall(r"(?<=[^A-Za-z0-9*])[A-Za-z0-9]+(?=[^A-Za-z0-9*])", text)
    return sorted({t.translate(str.maketrans(UPPER, LOWER)) for t in found})


def split_url(url):
    """Columns (host, path) of a URL column."""
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_tokens(url):
    """Distinct tokens of a URL column; the empty token is always among them."""
    plain = F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(plain, "[^a-z0-9]+")))


def _rule_frame(spark, rules: list) -> DataFrame:
    """rank, kind, action, name, regex, tokens: a higher rank decides over a lower one."""
    site = sorted({r for r in rules if isinstance(r, SiteRule)}, key=lambda r: (len(r.name), r.action == "block", r.name))
    patterns = sorted({r for r in rules if isinstance(r, PatternRule)}, key=lambda r: (r.action == "allow", r.pattern))
    rows = [
        F.struct(
            F.lit(rank).alias("rank"), F.lit(isinstance(r, SiteRule)).alias("is_site"), F.lit(r.action).alias("action"), F.lit(r.name).alias("name"),
            F.lit(_site_regex(r) if isinstance(r, SiteRule) else _pattern_regex(r.pattern)).alias("regex"),
            F.array(*map(F.lit, _literal_tokens(r) or [""])).alias("literals"),
        )
        for rank, r in enumerate([*patterns, *site], 1)
    ]
    schema = "array<struct<rank:int,is_site:boolean,action:string,name:string,regex:string,literals:array<string>>>"
    return spark.range(1).select(F.inline((F.array(*rows) if rows else F.array()).cast(schema)))


def rule_index(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Rules with ``token``, the rarest of their literals among the tokens of all ``urls``."""
    literals = rules.select("rank", F.explode("literals").alias("token"))
    used = urls.select(F.explode(url_tokens(F.col(url))).alias("token")).where("token <> ''")
    counts = used.join(F.broadcast(literals.select("token").distinct()), "token", "left_semi").groupBy("token").count()
    rarest = literals.join(counts, "token", "left").groupBy("rank").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("rarest"))
    return rules.join(rarest, "rank").select("rank", "is_site", "regex", F.col("rarest.token").alias("token"))


def judge(urls: DataFrame, site_rules: list[SiteRule], patterns: list[PatternRule] | tuple = PATTERNS, url: str = "url") -> DataFrame:
    """``urls`` with host, path, rule and verdict: every row, once.

    Work per URL is its tokens and the few rules they fetch. The index holds
    one row a rule, so its size is known before it is broadcast.
    """
    spark = urls.sparkSession
    rules = [*site_rules, *patterns]
    table = _rule_frame(spark, rules)
    index = rule_index(urls, table, url)
    small = F.broadcast if len(rules) <= BROADCAST_RULES else (lambda df: df)
    kept = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = split_url(F.col(url))
    named = urls.select(F.struct(*kept).alias("_kept"), F.col(url).alias("_url"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("_row"))
    plain = F.translate(F.coalesce(F.col("_url"), F.lit("")), UPPER, LOWER)
    tokens = named.withColumn("_text", plain).withColumn("_token", F.explode(url_tokens(F.col("_url"))))
    fits = (F.col("_token") == F.col("token")) & F.expr("rlike(if(is_site, concat(host, path), _text), regex)")
    # A page's tokens stand together in its partition: the partial aggregate leaves one row a page before the shuffle.
    best = tokens.join(small(index), fits, "left").groupBy("_row", "_kept", "host", "path").agg(F.max("rank").alias("rank"))
    names = table.select("rank", F.when(F.col("is_site"), F.col("name")).alias("rule"), F.col("action").alias("verdict"))
    return best.join(small(names), "rank", "left").select("_kept.*", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
