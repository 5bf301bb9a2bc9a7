"""What crawling leaves in texts: blocks and marks to take out, lines broken into fragments, sentences. Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.text import let, pack, strip, windows

#: The prompt to log in that pages carry, and marks of truncation at the end of a line.
LOGIN = r"(?m)\n提示:\s*\n.*?(?:注册登录后，享有更多权限|当前显示\d+张图片，您需要登录).*?【\s*\n登录\s*\n】\s*\n(?:…… …… ……\s*)?"
TRUNCATED = r"(?m)\s*……[-…\s]*$"
STOPS = "。！？；"


def without(text: Column, patterns: dict[str, str]) -> tuple[Column, dict[str, Column]]:
    """The text without the matches of each pattern, one after another, and how many each had. A null text is empty."""
    text, counts = F.coalesce(text, F.lit("")), {}
    for name, pattern in patterns.items():
        counts[name] = F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, "")
    return text, counts


def join_fragments(text: Column, keep: str = r"^[#>]", letters: str = r"[\x{4e00}-\x{9fff}]", least: int = 5, glue: str = "") -> Column:
    """Lines that were broken into fragments, joined.

    Blank lines and those that begin like ``keep`` stand for themselves; of the
    others, fragments of at most ``least`` characters without ``letters`` are
    dropped, and neighbours are joined by ``glue``. Three or more line feeds in
    a row become two. A null text is empty.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    own = lambda x: (strip(x) == "") | strip(x).rlike(keep)
    kept = F.filter(lines, lambda x: own(x) | (F.length(strip(x)) > least) | strip(x).rlike(letters))
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))
    closed = lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    def step(acc: Column, line: Column) -> Column:
        alone = F.struct(F.concat(closed(acc), F.array(line)).alias("done"), F.lit(None).cast("string").alias("open"))
        longer = F.struct(acc["done"].alias("done"), F.when(acc["open"].isNull(), strip(line)).otherwise(F.concat(acc["open"], F.lit(glue), strip(line))).alias("open"))
        return F.when(own(line), alone).otherwise(longer)

    return F.regexp_replace(F.array_join(F.aggregate(kept, zero, step, closed), "\n"), r"\n{3,}", "\n\n")


def sentences(text: Column, marks: str = "[。？！]", least: int = 8) -> Column:
    """Stripped pieces between the marks, of ``least`` characters or more."""
    pieces = F.transform(F.split(F.coalesce(text, F.lit("")), marks), lambda s: strip(s))
    return F.filter(pieces, lambda s: F.length(s) >= least)


def pack_sentences(text: Column, most: int, stops: str = STOPS) -> Column:
    """Consecutive sentences, stops kept, in parts of at most ``most`` characters; a longer sentence is cut."""
    pieces = F.filter(F.split(F.coalesce(text, F.lit("")), f"(?<=[{stops}])"), lambda s: s != "")
    none = F.array().cast("array<string>")
    cut = lambda p: F.when(F.length(p) > most, windows(p, most, 0)).otherwise(F.array(p))
    return let(F.flatten(F.transform(pieces, cut)), lambda p: F.when(F.size(p) > 0, pack(p, most, "")).otherwise(none))
