from pyspark.sql import functions as F

from tessella.functions import markdown


def test_fields_and_pairs(spark):
    doc = "## One\nbody\n## Two\nmore\nlines"
    row = spark.createDataFrame([(doc, "Name: a\nb\nDose: 3\nName: c", "x\n3g\n\ny")], "d string, f string, p string").select(
        markdown.sections(F.col("d")).alias("s"), markdown.labeled_fields(F.col("f"), ["Name", "Dose"]).alias("m"), markdown.paired_lines(F.col("p")).alias("p")
    ).first()
    assert [tuple(x) for x in row.s] == [("One", "body"), ("Two", "more\nlines")]
    assert row.m == {"Name": "a\nb", "Dose": "3"}
    assert [tuple(x) for x in row.p] == [("x", "3g"), ("y", None)]


def test_json_doses_and_direction(spark):
    rows = spark.createDataFrame([('say ```json\n{"a": 1}\n``` so',), ('{"b": 2}',), ("no",), (None,)], "t string")
    assert [r.j for r in rows.select(markdown.fenced_json(F.col("t")).alias("j")).collect()] == ['{"a": 1}', '{"b": 2}', None, None]
    row = spark.range(1).select(markdown.strip_dose(F.lit("root (3 g)")).alias("d"), markdown.direction(F.lit("aab"), {"x": ["b"], "y": ["a"]}).alias("y"), markdown.direction(F.lit(""), {"x": ["b"]}).alias("n")).first()
    assert (row.d, row.y, row.n) == ("root", "y", None)
