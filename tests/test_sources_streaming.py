import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioforge.sources import files as X
from folioforge.streaming import events as E


def envelope(**attributes):
    return json.dumps({"message": {"attributes": attributes, "data": "x"}})


BODIES = [
    (envelope(bucketId="b", objectId="docs/WG1.pdf", objectGeneration="123", eventType="OBJECT_FINALIZE"), "accepted"), (envelope(bucketId="b", objectId="docs/WG1.PDF", objectGeneration="99"), "accepted"),
    (envelope(bucketId="b", objectId="x.pdf", eventType="OBJECT_DELETE"), "ignored"), (envelope(bucketId="b", objectId="x.docx"), "rejected"), (envelope(bucketId="", objectId="x.pdf"), "rejected"), ("{}", "rejected"), ("[1]", "rejected"), ("no json", "rejected"), (None, "rejected"),
]


def test_gate(spark):
    got = E.gate(spark.createDataFrame([(i, b) for i, (b, _) in enumerate(BODIES)], "id int, body string")).orderBy("id").collect()
    assert [r.status for r in got] == [s for _, s in BODIES]
    assert got[0].doc_id == "WG1" and got[0].kind == "pdf" and got[3].kind == "word" and got[5].problem == "missing message"


def test_stream_keeps_the_latest_and_is_repeatable(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(json.dumps({"body": b}) for b, _ in BODIES if b))
    seen = []
    run = lambda: E.run_gate(spark, str(source), str(tmp_path / "ck"), lambda df, i: seen.append([(r.doc_id, r.generation) for r in df.collect()]), str(tmp_path / "bad")).awaitTermination()
    run()
    assert seen == [[("WG1", "123")]]
    run()
    assert len(seen) == 1
    (source / "b.json").write_text(json.dumps({"body": envelope(bucketId="b", objectId="n.pdf")}))
    run()
    assert seen[1] == [("n", None)]
    assert spark.read.json(str(tmp_path / "bad")).count() == 5


def test_sessions(spark):
    schema = "app string, user_id string, session_id string, state string"
    have = spark.createDataFrame([("c", "u", "s1", "old")], schema)
    want = spark.createDataFrame([("c", "u", "s1", None), ("c", "u", "s2", None), ("c", "u", "s2", None)], schema)
    assert sorted((r.session_id, r.state) for r in E.get_or_create_sessions(have, want).collect()) == [("s1", "old"), ("s2", None)]
    assert sorted((r.session_id, r.state) for r in E.reset_sessions(have, want).collect()) == [("s1", None), ("s2", None)]
    turns = spark.createDataFrame([("a", 1, True, ["x"]), ("a", 3, True, ["y", None, "z"]), ("a", 4, True, [""]), ("a", 5, False, ["no"])], "session_id string, turn int, is_final boolean, parts array<string>")
    assert [(r.session_id, r.response) for r in E.final_responses(turns).collect()] == [("a", "y\nz")]


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"hello")
    df = X.read_files(spark, str(tmp_path)).select(F.col("path"), X.reject_reason(F.col("length"), F.substring("content", 1, 5), max_bytes=100).alias("why"))
    assert {r.path[-5:]: r.why for r in df.collect()} == {"a.pdf": None, "b.pdf": "not a pdf"}
    assert [r[0] for r in spark.createDataFrame([(0, b""), (None, None), (201, b"%PDF-")], "n int, c binary").select(X.reject_reason(F.col("n"), F.col("c"), max_bytes=200)).collect()] == ["empty", "empty", "too large"]
    pdf = F.encode(F.lit("%PDF-"), "UTF-8")
    reason = lambda lo, hi: spark.range(1).select(X.reject_reason(F.lit(9), pdf, F.lit(10), F.lit(lo), F.lit(hi), max_pages=4)).first()[0]
    assert (reason(1, 4), reason(0, 3), reason(3, 2), reason(9, 11), reason(1, 5)) == (None, "bad range", "bad range", "bad range", "range too long")


def test_ranges_and_shards(spark):
    docs = spark.createDataFrame([("a", 120), ("b", 50), ("c", 0), ("d", None)], "doc_id string, n_pages int")
    ranges = X.page_ranges(docs)
    assert sorted((r.doc_id, r.first_page, r.last_page, r.shard) for r in ranges.collect()) == [("a", 1, 50, 0), ("a", 51, 100, 1), ("a", 101, 120, 2), ("b", 1, 50, 0)]

    def parse(row):
        if row["doc_id"] == "b" or row["shard"] == 1:
            raise ValueError("broken page")
        return [{"ord": 0, "text": f"{row['first_page']}"}]

    shards = X.read_shards(ranges, parse, pa.struct([("ord", pa.int32()), ("text", pa.string())]))
    got = {r.doc_id: (r.failed_shards, r.problem) for r in X.require_some(shards, ["doc_id"]).collect()}
    assert got == {"a": ("1", None), "b": ("0", "every shard failed")}
    assert sorted(b.text for r in shards.collect() for b in r.blocks or []) == ["1", "101"]


def test_other_shards_errors_end_the_job(spark):
    ranges = X.page_ranges(spark.createDataFrame([("a", 1)], "doc_id string, n_pages int"))
    with pytest.raises(Exception, match="KeyError"):
        X.read_shards(ranges, lambda row: row["nope"], pa.struct([("ord", pa.int32())])).collect()


def test_blocks_from_text_and_html(spark):
    assert [(r.ord, r.text) for r in X.line_blocks(spark.createDataFrame([(1, " a \r\n\n____\nb\rc"), (2, None)], "doc_id int, text string")).orderBy("ord").collect()] == [(0, "a"), (3, "b"), (4, "c")]
    html = "<html><head><style>p{}</style></head><h1>T <b>x</b></h1><p>one<br>two<ul><li>i1<li>i2</ul><script>var a='<p>no</p>'</script><p>  </p>"
    got = [(r.block_type, r.heading_level, r.text) for r in X.html_blocks(spark.createDataFrame([(1, html)], "doc_id int, html string")).orderBy("ord").collect()]
    assert got == [("heading", 1, "T x"), ("paragraph", None, "one two"), ("list_item", None, "i1"), ("list_item", None, "i2")]


def test_captions_and_grids(spark):
    rows = [("d", "t1", ["c1", "c2"], ["f1"], None), ("d", "c1", None, None, " "), ("d", "c2", None, None, "Cap"), ("d", "f1", None, None, "note"), ("d", "p", None, None, "x")]
    got = {r.ref: r.caption for r in X.linked_captions(spark.createDataFrame(rows, "doc_id string, ref string, captions array<string>, footnotes array<string>, text string")).collect()}
    assert got == {"t1": "Cap", "p": None}
    cell = lambda t, h=False: (t, h)
    grid = spark.createDataFrame([([[cell("A", True), cell("B", True)], [cell(" ", True), cell("2", True)], [cell("x"), cell(None)]],), ([[cell("x")]],), ([],)], "g array<array<struct<text:string,column_header:boolean>>>")
    got = [(r.t.headers, r.t.body_rows) for r in grid.select(X.grid_table(F.col("g")).alias("t")).collect()]
    assert got == [(["A", "B 2"], [["x", ""]]), ([], [["x"]]), ([], [])]
