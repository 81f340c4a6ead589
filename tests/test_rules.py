import uuid

from pyspark.sql import functions as F

from folioforge.functions import blocks as B
from folioforge.functions import text as T


def values(spark, texts, fn):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fn(F.col("t"))).collect()]


def test_text_rules_know_unicode(spark):
    assert values(spark, [" A\u00a012٣ b\u2007", None, ""], T.normalize_text) == ["a b", None, ""]
    assert values(spark, ["Contents ......... 7\nx", "Change history/Change request", "Contentsx", None], T.is_removable_section) == [True, True, False, False]
    assert values(spark, ["4.2.2 Entities", "A.1 Title", "1) Item", "Introduction", "4.2.2", "2024 was good", ""], T.heading_level) == [3, 2, None, 1, None, 1, None]
    assert values(spark, ["1) Near-RT", "RAN:", ":", "x" * 101 + ":", "a b c d e f g h i j k l m n:", "prose"], T.is_list_label) == [True, True, False, False, False, False]
    assert values(spark, ["Figure 4.1-1 a", "Fig. 2", "Figura A.1", "Figure it", "figures 1"], T.is_figure_caption) == [True, True, True, False, False]
    assert values(spark, ["Table 5.1-2: x", "table 3", "Tables 3"], T.is_table_caption) == [True, True, False]
    assert values(spark, ["__ —\u00a0-", " ", "a-"], T.is_noise) == [True, False, False]
    assert values(spark, ["One. Two?  Three\u00a0x! ", "", "no end"], T.sentences) == [["One.", "Two?", "Three\u00a0x!"], [], ["no end"]]
    assert values(spark, ["4.2 Use Cases!", "***", None], lambda c: T.section_id(F.lit(7), c)) == ["sec_0007_4-2-use-cases", "sec_0007_section", "sec_0007_section"]


def test_names(spark):
    names = ["x/O-RAN.WG1.Use-Cases-Analysis-Report-R004-v18.00.pdf", "O-RAN.SuFG.TR.A.B-v01.00.PDF", "O-RAN.wg4.TS.X-R3-v1.00.pdf", "O-RAN.WG1.TS.X-v01.00"]
    ids = {k: values(spark, names, lambda c, k=k: T.document_identity(c)[k]) for k in ("doc_group", "doc_type", "subject", "release_no", "doc_version")}
    assert ids["doc_group"] == ["WG1", "SuFG", None, None]
    assert ids["doc_type"] == ["use-cases-analysis-report", "tr", None, None]
    assert ids["subject"] == ["Use-Cases-Analysis-Report", "A-B", None, None]
    assert ids["release_no"] == ["004", None, None, None] and ids["doc_version"] == ["18.00", "01.00", None, None]
    spec = [("special", "wg1", (), ("USE-",)), ("oran", None, (), ())]
    assert values(spark, names, lambda c: T.profile_id(T.document_identity(c), spec)) == ["special", "oran", "default", "default"]
    assert values(spark, ["a.pdf", "WG1.PDF", "x.doc", "y.docx", "z.txt", "noext", ".pdf", "d/.pdf"], T.object_kind) == ["pdf", "pdf", "word", "word"] + ["unsupported"] * 4
    assert values(spark, ["a/b.c.pdf", ".x", "n"], T.path_stem) == ["b.c", ".x", "n"]
    ids = ["doc1:c0", "ü:ß"]
    assert values(spark, ids, T.point_id) == [str(uuid.uuid5(uuid.NAMESPACE_URL, i)) for i in ids]


def test_tables_and_pages(spark):
    schema = "h array<string>, r array<array<string>>"
    rows = [(["0", "1"], [["a", "b", "c"]]), (["A", " "], [["a"]]), ([], [["a"], ["b", "c"]]), (None, None), (["Col0", ""], None), (["²"], None)]
    df = spark.createDataFrame(rows, schema).select(F.struct(F.col("h").alias("headers"), F.col("r").alias("body_rows"), F.lit("Cap").alias("caption")).alias("t"))
    got = [(r[0], r[1]) for r in df.select(B.placeholder_headers(F.col("t.headers")), B.column_count(F.col("t"))).collect()]
    assert got == [(True, 3), (False, 2), (True, 2), (True, 0), (True, 2), (False, 1)]
    md = [r[0] for r in df.select(B.table_markdown(F.col("t"))).collect()]
    assert md[1] == "**Cap**\n| A |  |\n| --- | --- |\n| a |  |" and md[2] == "**Cap**\n| a |  |\n| b | c |" and md[3] == "**Cap**"
    one = spark.range(1)
    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(("x0", "y0", "x1", "y1"), v)])
    assert one.select(B.iou(box(0, 0, 2, 2), box(1, 0, 3, 2))).first()[0] == 1 / 3
    assert one.select(B.iou(box(0, 2, 2, 0), box(0, 2, 2, 0))).first()[0] == 0.0
    pages = lambda p, e: one.select(B.page_numbers(F.expr("cast(array() as array<struct<page:int>>)"), F.lit(p).cast("int"), F.lit(e).cast("string"))).first()[0]
    assert pages(3, "5") == [3, 4, 5] and pages(5, "3") == [3, 4, 5] and pages(2, "x") == [2] and pages(None, "3") == []
    assert [r[0] for r in spark.createDataFrame([("CoordOrigin.topleft",), (None,)], "c string").select(B.coord_origin(F.col("c"))).collect()] == ["TOPLEFT", "BOTTOMLEFT"]
