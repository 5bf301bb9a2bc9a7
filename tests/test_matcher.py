"""The automaton's hits and choices against plain loops over terms."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessella.operators import matcher
from tests.test_longest_terms import brute

CJK = ["桂枝汤", "桂枝", "枝汤", "汤", "麻黄汤", "麻黄", "小柴胡汤", "柴胡", "été", "ab", "abc", "bca", "a", "ﬁ", "𝔸b", " trimmed ", "  ", ""]
TEXTS = {
    1: "伤寒桂枝汤主之，不宜麻黄汤，宜小柴胡汤方。桂枝桂枝汤", 2: "", 3: None, 4: "abcabcab étéab 𝔸bc ﬁab", 5: "trimmed aaaa", 6: "汤汤汤" * 2000, 7: "no hit: zzz",
}


def later(text, terms):
    found = [(i + 1, t) for t in terms for i in range(len(text)) if text.startswith(t, i)]
    chosen = []
    for s, t in sorted(found, key=lambda x: (len(x[1]), x[0]), reverse=True):
        if all(s + len(t) <= a or a + len(b) <= s for a, b in chosen):
            chosen.append((s, t))
    return sorted(chosen)


def once(text, terms):
    found = sorted(((m.start() + 1, -len(t), t) for t in terms for m in re.finditer(re.escape(t), text)))
    chosen, seen = [], set()
    for s, _, t in found:
        if t not in seen and all(s + len(t) <= a or a + len(b) <= s for a, b in chosen):
            chosen.append((s, t))
            seen.add(t)
    return sorted(chosen)


WANT = {"longest": lambda x, t: sorted(brute(x, t)), "longest_later": later, "leftmost_once": once, "all": lambda x, t: sorted((i + 1, w) for w in t for i in range(len(x)) if x.startswith(w, i))}


@pytest.mark.parametrize("shard_chars", [matcher.SHARD_CHARS, 12])
@pytest.mark.parametrize("how", matcher.CHOICES)
def test_choices_whole_and_in_shards(spark, how, shard_chars):
    rng = random.Random(1)
    texts = {k: (v or "")[:60] if k == 6 else v for k, v in TEXTS.items()} | {100 + i: "".join(rng.choices("abc汤桂枝 ", k=40)) for i in range(30)}
    frame = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "id long, t string, term string")
    terms = spark.createDataFrame([(t, 1) for t in [*CJK, *CJK[:3], None]], "term string, key int")
    known = sorted({t.strip() for t in CJK} - {""})
    got = matcher.find_terms(frame, "id", F.col("t"), terms, how, shard_chars=shard_chars)
    assert sorted(map(tuple, got.collect())) == sorted((k, *h) for k, v in texts.items() for h in WANT[how](v or "", known))


def test_long_texts_and_empty_catalogues(spark):
    frame = spark.createDataFrame(list(TEXTS.items()), "id long, t string")
    none = spark.createDataFrame([(" ",), (None,)], "term string")
    assert matcher.find_terms(frame, "id", F.col("t"), none).count() == 0
    one = spark.createDataFrame([("汤",), ("汤汤",)], "term string")
    assert matcher.find_terms(frame.where("id = 6"), "id", F.col("t"), one).count() == 3000
    assert matcher.find_terms(frame.limit(0), "id", F.col("t"), one).count() == 0
    with pytest.raises(ValueError):
        matcher.find_terms(frame, "id", F.col("t"), one, "shortest")


def test_context(spark):
    """Mentions count only where what stands around them prescribes."""
    rule = matcher.Context(after=("主之",), before=("宜", "可与"), refused=("不宜", "不可与"))
    frame = spark.createDataFrame([(1, TEXTS[1]), (2, "可与麻黄汤，不可与桂枝汤"), (3, "桂枝汤")], "id long, t string")
    terms = spark.createDataFrame([(t,) for t in CJK[:8]], "term string")
    got = sorted((r.key, r.start, r.term) for r in matcher.find_terms(frame, "id", F.col("t"), terms, "longest", rule).collect())
    assert got == [(1, 3, "桂枝汤"), (1, 16, "小柴胡汤"), (2, 3, "麻黄汤")]


def test_aliases_stand_for_names(spark):
    frame = spark.createDataFrame([(1, "feels hot and runs hot, very hot"), (2, None), (3, "burning hot")], "id long, t string")
    aliases = spark.createDataFrame([("hot", "fever", 2), ("hot", "heat", 1), ("very hot", "fever", 3), ("burning", "fever", 4)], "alias string, canonical string, place int")
    got = sorted(map(tuple, matcher.expand_aliases(frame, "id", F.col("t"), aliases).collect()))
    assert got == [(1, 7, "hot", "heat"), (1, 20, "hot", "heat"), (1, 25, "very hot", "fever"), (3, 1, "burning", "fever"), (3, 9, "hot", "heat")]
