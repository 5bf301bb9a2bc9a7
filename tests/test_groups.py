"""The required-group parser on worded examples, and its offsets on random statements."""

import random

from tessella.operators import groups

FIELDS = "id long, raw_text string, evidence string, known array<string>, differential array<string>, forbidden array<string>, existing array<array<string>>, key string"
BASE = ["呕吐", "胁痛", "口苦", "舌红苔黄", "脉弦数"]
TEXT = "运用\n1、辨证要点：临床应用以呕吐吞酸，胁痛口苦，舌红苔黄，脉弦数为辨证要点。\n2、加减变化：略。"
STATED = "运用\n1、辨证要点：临床应用以{}为辨证要点。"


def read(spark, *rows, **kw):
    return {r.key: r for r in groups.required_groups(spark.createDataFrame([(*r, "x") for r in rows], FIELDS), "id", **kw).collect()}


def test_statements(spark):
    got = read(
        spark,
        (1, TEXT, "呕吐口苦，胁痛，舌红苔黄，脉弦数。", BASE, ["呕吐", "吞酸"], [], [["呕吐", "干呕", "气逆欲呕"], ["absent"]]),
        (2, STATED.format("局部红肿xian痛，脉数有力"), "", BASE, None, None, None),
        (3, STATED.format("心胸烦热，口渴，口舌生疮或小便赤涩，舌红脉数"), "", ["心胸烦热", "口渴", "口舌生疮", "小便赤涩", "舌红", "脉数"], None, ["脉数"], [["口渴"]]),
        (4, STATED.format("腹痛，里急后重，舌红苔黄，脉弦数"), "", ["腹痛", "里急", "后重", "里急后重"], [], [], []),
        (5, None, None, None, None, None, None),
        (6, "无此句。", "泄泻不止，夜间咳嗽", [], ["泄泻不止", "咳嗽证", "夜间咳嗽"], [], []),
    )
    one = got[1]
    assert one.phrase == "呕吐吞酸，胁痛口苦，舌红苔黄，脉弦数" == TEXT[one.phrase_start : one.phrase_end]
    assert one.groups == [["呕吐", "干呕", "气逆欲呕"], ["吞酸"], ["胁痛"], ["口苦"], ["舌红苔黄"], ["脉弦数"]]
    assert one.reasons == [] and one.clarify == ["舌象", "脉象"]
    assert [t.axis for t in one.traces] == ["main_symptom"] * 4 + ["tongue", "pulse"]
    assert all(TEXT[t.start : t.end] == t.term for t in one.traces) and [t.in_evidence for t in one.traces] == [True, False, True, True, True, True]
    assert got[2].reasons == ["ascii_source_noise"]
    assert [t.term for t in got[3].traces] == ["口渴", "心胸烦热", "口舌生疮", "舌红", "脉数"] and got[3].groups[2] == ["口舌生疮", "小便赤涩"]
    assert got[3].reasons == ["required_forbidden_conflict"]
    assert [g for g in got[4].groups if "里急后重" in g or "里急" in g] == [["里急后重"]]
    assert got[5].groups == [] and "missing_explicit_diagnostic_phrase" in got[5].reasons and got[5].phrase_start == -1
    assert got[6].groups == [["泄泻不止"], ["夜间咳嗽"]] and got[6].traces == []


def test_synonyms_and_merging(spark):
    row = (1, STATED.format("干呕，腹痛甚，恶心"), "", ["腹痛"], [], [], [])
    got = read(spark, row, rules=[["恶心", "欲呕"]], aliases={"干呕": ["恶心"], "腹痛": ["肚子疼"]})[1]
    assert got.groups == [["干呕", "恶心", "欲呕"], ["腹痛", "肚子疼"]]


def test_offsets_of_random_statements(spark):
    """Every traced term stands where its offsets say, inside the statement, and pieces of one part do not overlap."""
    rng = random.Random(3)
    words = ["头痛", "发热", "恶寒", "汗出", "口渴", "便溏", "脉浮", "舌淡", "胸闷", "气短", "腰膝酸软", "伴有", "等", "而"]
    rows = []
    for i in range(200):
        stated = "".join(rng.choice(words) + rng.choice(["", "，", "、", "或", "；", "及"]) for _ in range(rng.randint(1, 12)))
        rows.append((i, "前文。" * rng.randint(0, 3) + STATED.format(stated), "", rng.sample(words[:11], 4), [], [], []))
    texts = {r[0]: r[1] for r in rows}
    found = read(spark, *rows)
    assert len(found) == 200
    for k, r in found.items():
        text = texts[k]
        assert text[r.phrase_start : r.phrase_end] == r.phrase
        assert all(t.start >= r.phrase_start and t.end <= r.phrase_end and text[t.start : t.end] == t.term and t.term in g for t, g in zip(r.traces, r.groups))
        assert all(not groups.overlap(a, b) or a is b for n, a in enumerate(r.groups) for b in r.groups[:n] if len(a) == len(b) == 1)
        known = sorted(rows[k][3], key=lambda t: (-len(t), t))
        for part in groups._cut(groups.CLASSICAL.separator, text, (r.phrase_start, r.phrase_end)):
            spans = sorted(groups.pieces(text, part, known, groups.CLASSICAL))
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])) and all(part[0] <= a < b <= part[1] for a, b in spans)
