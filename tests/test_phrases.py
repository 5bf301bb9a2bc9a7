"""Phrases and their modern wordings against plain loops."""

import random
import re

from pyspark.sql import functions as F

from tessella.operators import phrases

TERMS = ["头痛", "发热", "恶寒", "头", "口渴", "小便不利"]
ALIASES = [("头痛", "脑袋疼", 0), ("头痛", "头疼", 1), ("头痛", "脑壳痛", 2), ("发热", "发烧", 3), ("寒", "冷", 4), ("恶寒", "怕冷", 5), ("渴", "想喝水", 6), ("口渴", "口干", 7), ("头", "脑袋", 8)]


def plain_split(text, terms, rules):
    out = [t for t in terms if t in text]
    for piece in re.split(rules.cuts, text):
        piece = piece.strip()
        piece = re.sub(rules.opening, "", piece).strip()
        piece = re.sub(rules.closing, "", piece)
        if any(re.search(p, piece) for p in rules.rejects) or any(t in piece and t != piece for t in terms) or piece in rules.stop:
            continue
        if rules.least <= len(piece) <= rules.most:
            out.append(piece)
    return list(dict.fromkeys(out))


def plain_modern(own):
    by = {}
    for t, a, _ in ALIASES:
        by.setdefault(t, []).append(a)
    modern, met = [], []
    for p in own:
        if p in by:
            modern += by[p][:2]
            met += by[p]
            continue
        held = [a for t in by if len(t) >= 2 and t in p for a in by[t]]
        modern += held[:3] or [p]
        met += held
    return list(dict.fromkeys(modern)), list(dict.fromkeys(met))


def test_phrases_and_wordings(spark):
    rng = random.Random(3)
    words = [*TERMS, "腹满", "黄帝曰：腹满者", "取之", "刺足三里", "宜桂枝汤主之", "胸中烦而不呕", "属于", "证", "恶寒战栗", "口渴甚", "当须", "x" * 13, "y", "脉浮也", " 脉沉 "]
    texts = {i: "".join(rng.choice(words) + rng.choice(["，", "。", "或", "", "\n", "并"]) for _ in range(rng.randint(0, 9))) for i in range(250)} | {900: None, 901: ""}
    frame = spark.createDataFrame(list(texts.items()), "id long, t string")
    terms = spark.createDataFrame([(t, i) for i, t in enumerate(TERMS)] + [("头痛", 99), (None, 5), (" ", 6)], "term string, place int")
    got = phrases.split_phrases(frame, "id", F.col("t"), terms)
    found = {r.key: r.phrases for r in got.collect()}
    assert found == {k: plain_split(t or "", TERMS, phrases.CLASSICAL) for k, t in texts.items()}
    aliases = spark.createDataFrame(ALIASES, "term string, alias string, place int")
    assert {r.key: (r.modern, r.aliases) for r in phrases.modernised(got, "key", "phrases", aliases).collect()} == {k: plain_modern(own) for k, own in found.items()}


def test_nothing_listed(spark):
    frame = spark.createDataFrame([(1, "腹满，脉浮者"), (2, None)], "id long, t string")
    none = spark.createDataFrame([], "term string, place int")
    got = phrases.split_phrases(frame, "id", F.col("t"), none)
    assert {r.key: r.phrases for r in got.collect()} == {1: ["腹满", "脉浮"], 2: []}
    modern = phrases.modernised(got, "key", "phrases", spark.createDataFrame([], "term string, alias string, place int"))
    assert {r.key: (r.modern, r.aliases) for r in modern.collect()} == {1: (["腹满", "脉浮"], []), 2: ([], [])}
