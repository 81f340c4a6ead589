import random
import time

import pytest
from pyspark.sql import functions as F

from folioforge.operators import ordered as O
from folioforge.operators import refine as R
from folioforge.operators.tables import collapse_tables, merge_parts, table_runs

SCHEMA = (
    "block_key bigint, doc_id string, block_id string, block_type string, ord int, page int, text string, heading_level int, table_data struct<headers:array<string>,body_rows:array<array<string>>,caption:string>,"
    "image struct<uri:string,alt:string,caption:string>, bbox struct<x0:double,y0:double,x1:double,y1:double,coord_origin:string>, source_ref string, metadata map<string,string>,"
    "layout_spans array<struct<page:int,bbox:struct<x0:double,y0:double,x1:double,y1:double,coord_origin:string>,source_ref:string>>"
)


def block(i, kind, text=None, level=None, page=1, table=None, image=None, box=None, doc="d"):
    return (i, doc, f"b{i}", kind, i, page, text, level, table, image, box, None, {}, [])


def frame(spark, rows):
    rows = list(rows)
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def run(df):
    return sorted(df.collect(), key=lambda r: (r.doc_id, r.ord))


@pytest.fixture(autouse=True)
def short_segments(monkeypatch):
    """Segments of a few rows, so that every operator is tested across their edges."""
    monkeypatch.setattr(O, "SEGMENT", 5)


def test_running_values_over_segments(spark):
    rng = random.Random(5)
    rows = [(k, i * 3, rng.choice([None, rng.randrange(9)])) for k in ("a", "b") for i in range(40)]
    df = O.dense(spark.createDataFrame(rows, "k string, o int, v int"), ["k"], ["o"])
    df = O.running_last(df, ["k"], {"last": F.col("v")}, ahead={"next": F.col("v")}, before={"prev": F.col("v")})
    df = O.neighbours(O.running_sum(df, ["k"], {"total": F.coalesce("v", F.lit(0))}), ["k"], {"up": (F.col("o"), -3), "down": (F.col("o"), 2)})
    got = {(r.k, r.pos): r for r in df.collect()}
    for k in ("a", "b"):
        vs = [v for kk, _, v in rows if kk == k]
        for i in range(40):
            r, known = got[k, i], lambda xs: next((x for x in xs if x is not None), None)
            assert (r.last, r.prev, r.next, r.total) == (known(vs[i::-1]), known(vs[:i][::-1]), known(vs[i:]), sum(v or 0 for v in vs[: i + 1]))
            assert (r.up, r.down) == ((i - 3) * 3 if i >= 3 else None, (i + 2) * 3 if i < 38 else None)


def test_types(spark):
    rows = [block(0, "paragraph", " 4.2 Cells "), block(1, "heading", "Annex A", 0), block(2, "heading", "1) x"), block(3, "heading", "RAN:"), block(4, "heading", "Figure 1 x", 2), block(5, "code", "A.1 Fine"), block(6, "table"), block(7, "heading", None, 2)]
    got = [(r.block_type, r.heading_level, r.text) for r in run(R.refine_types(frame(spark, rows)))]
    assert got == [("heading", 2, "4.2 Cells"), ("heading", 1, "Annex A"), ("list_item", None, "1) x"), ("list_item", None, "RAN:"), ("paragraph", None, "Figure 1 x"), ("heading", 2, "A.1 Fine"), ("table", None, None), ("paragraph", None, None)]


def test_list_levels(spark):
    box = lambda x: (x, 0.0, 9.0, 9.0, None)
    rows = [block(0, "list_item", "a", box=box(56.6)), block(1, "list_item", "b", box=box(77.6)), block(2, "list_item", "c", box=box(99.0)), block(3, "list_item", "Label:", box=box(99.0)), block(4, "paragraph", "x"), block(5, "list_item", "d", box=box(99.0)), block(6, "list_item", "e")]
    assert [r.heading_level for r in run(R.assign_list_levels(frame(spark, rows)))] == [1, 2, 3, 1, None, 1, 1]


def test_removable_against_state_machine(spark):
    rng, rows, want = random.Random(2), [], []
    for d in range(30):
        skip = None
        for i in range(25):
            kind = rng.choice(["heading", "heading", "paragraph"])
            text, level = (rng.choice(["Contents", "1 Scope", "Foreword ... 3"]), rng.choice([1, 2, 3, None])) if kind == "heading" else ("x", None)
            rows.append(block(i, kind, text, level, doc=f"d{d:02d}"))
            if kind == "heading" and text != "1 Scope":
                skip = level or 1
            elif kind == "heading" and skip is not None and (level or 1) <= skip:
                skip = None
            if skip is None:
                want.append((f"d{d:02d}", i))
    assert [(r.doc_id, r.ord) for r in run(R.drop_removable_sections(frame(spark, rows)))] == want


def test_diagrams_against_spans(spark):
    rng, rows, want = random.Random(4), [], []
    kinds = {"S": ("code", "@startuml"), "E": ("paragraph", "@enduml"), "C": ("paragraph", "UE -> RIC: x"), "B": ("code", "@startuml x\n@enduml"), "X": ("paragraph", "plain prose here"), "T": ("table", None)}
    for d in range(60):
        seq = [rng.choice("SECCBXXT") for _ in range(12)]
        rows += [block(i, *kinds[c], page=i // 4, doc=f"d{d:02d}") for i, c in enumerate(seq)]
        covered = set()
        for i, c in enumerate(seq):
            if c in "SB":
                lo = hi = i
                while lo and seq[lo - 1] == "C":
                    lo -= 1
                while hi + 1 < len(seq) and seq[hi] not in "EB" and seq[hi + 1] in "SECB":
                    hi += 1
                covered |= set(range(lo, hi + 1))
        i = 0
        while i < len(seq):
            j = i
            while j in covered and j + 1 in covered:
                j += 1
            want.append((f"d{d:02d}", i, str(j - i + 1) if j > i else None, i in covered))
            i = j + 1
    got = [(r.doc_id, r.ord, r.metadata.get("merged_parts"), r.metadata.get("language") == "plantuml") for r in run(R.merge_diagrams(frame(spark, rows)))]
    assert got == want


def test_diagram_metadata_and_idempotence(spark):
    rows = [block(0, "paragraph", "box RIC", page=3), block(1, "code", "@startuml\nA -> B", page=3), block(2, "paragraph", "@enduml", page=4), block(3, "paragraph", "prose", page=4)]
    once = R.merge_diagrams(frame(spark, rows))
    r = run(once)[0]
    assert (r.text, r.page, r.metadata, len(r.layout_spans)) == ("box RIC\n@startuml\nA -> B\n@enduml", 3, {"language": "plantuml", "page_end": "4", "continued": "true", "merged_parts": "3"}, 3)
    assert [(x.text, len(x.layout_spans)) for x in run(R.merge_diagrams(once))] == [(x.text, len(x.layout_spans)) for x in run(once)]


def test_figure_captions(spark):
    kinds = {"I": ("image", None), "C": ("paragraph", "Figure 1 x"), "P": ("paragraph", "prose")}
    cases = {"ICIC": "I1I1", "CICI": "I1I1", "ICI": "I1I", "CI": "I1", "IC": "I1", "PCIP": "PI1P", "CPI": "CPI", "IIC": "II1"}
    rows = [block(i, *kinds[c], image=(None, "a", None) if c == "I" else None, doc=name) for name in cases for i, c in enumerate(name)]
    out = {}
    for r in run(R.attach_figure_captions(frame(spark, rows))):
        out[r.doc_id] = out.get(r.doc_id, "") + ("I" + ("1" if r.image.caption else "") if r.block_type == "image" else "C" if r.text.startswith("Fig") else "P")
    assert out == cases


def _table(kind, page):
    headers = {"A": ["A", "B", "C"], "0": ["0", "1", "2"], "N": ["A", "B", "C"]}[kind]
    return (headers, [["1", "2", "3"]], "Table 9 Own" if kind == "N" else None)


def test_table_captions_against_walk(spark):
    rng, rows, want = random.Random(6), [], []
    for d in range(80):
        seq = [rng.choice("AA0NKKP") for _ in range(9)]
        name = f"d{d:02d}"
        rows += [block(i, "table", page=i, table=_table(c, i), box=(0.0, 0.0, 9.0, 9.0, None), doc=name) if c in "A0N" else block(i, "paragraph", "Table 1 x" if c == "K" else "prose", page=i, doc=name) for i, c in enumerate(seq)]
        # parts of one table: the table before, captions left aside, unless labelled or owned
        head = {}
        for i, c in enumerate(seq):
            if c in "A0N":
                p = i - 1
                while p >= 0 and seq[p] == "K":
                    p -= 1
                linked = p >= 0 and seq[p] in "A0N" and c != "N" and not (p < i - 1 and seq[p] == "N") and (i == p + 1 or c == "A" and seq[p] in "AN")
                head[i] = head[p] if linked else i
        used, got = set(), {}
        for h in sorted(set(head.values())):
            end = max(i for i in head if head[i] == h)
            at = next((k for k in (h + 1, end + 1, h - 1) if 0 <= k < len(seq) and seq[k] == "K"), None)
            if seq[h] != "N" and at is not None and at not in used:
                used.add(at)
                got[h] = "Table 1 x"
        want += [(name, i, got.get(i, "Table 9 Own" if c == "N" else None) if c in "A0N" else None) for i, c in enumerate(seq) if i not in used]
    df = frame(spark, rows)
    assert [(r.doc_id, r.ord, r.table_data.caption if r.table_data else None) for r in run(R.attach_table_captions(df))] == want


def merged(spark, *tables):
    """merge_parts over lists of parts (headers, rows, caption)."""
    rows = [(i, parts) for i, parts in enumerate(tables)]
    df = spark.createDataFrame(rows, "id int, parts array<struct<headers array<string>, body_rows array<array<string>>, caption string>>")
    found = {r.id: r.t for r in df.select("id", merge_parts(F.col("parts")).alias("t")).collect()}
    return [(found[i].headers, found[i].body_rows, found[i].caption) for i in range(len(tables))]


def test_table_merge(spark):
    long = "a cell whose text runs on over the page and"
    cases = {
        "pieces go on in open cells, notes go to the caption": ([(["A", "B", "C"], [["1", long, long]], "Table 1 x"), (["0", "1", "2"], [["tail", "more"]], "NOTE: y")], (["A", "B", "C"], [["1", long + " tail", long + " more"]], "Table 1 x NOTE: y")),
        "a shortened header replaces the first; leading blanks take the row above": ([(["Name long", "Value"], [["1", "2"]], None), (["Name", "Value"], [["", "3"], ["4", "5"], ["6", "7"]], None)], (["Name", "Value"], [["1", "2"], ["1", "3"], ["4", "5"], ["6", "7"]], None)),
        "another header is a row": ([(["A", "B"], [["1", "2"]], None), (["C", "D"], [["3", "4"]], None)], (["A", "B"], [["1", "2"], ["C", "D"], ["3", "4"]], None)),
        "columns without names; rows padded and cut": ([(["", "1"], [["1", "2", "3"], ["4"]], None), (None, [["5"], ["6", "7", "8", "9"], ["x", "y", "z"]], "")], (["col0", "col1", "col2"], [["1", "2", "3"], ["4", "", ""], ["4", "", "5"], ["6", "7", "8"], ["x", "y", "z"]], None)),
        "more pieces than open cells go to the last columns": ([(["A", "B", "C"], [["k", "s", long]], None), ([], [["", "p", "q"]], None)], (["A", "B", "C"], [["k", "s p", long + " q"]], None)),
        "a closed row is followed by a row": ([(["A", "B"], [["k", long + "."]], None), (["A", "B"], [["A", "B"], ["", "q"]], None)], (["A", "B"], [["k", long + "."], ["k", "q"]], None)),
        "nothing at all": ([(None, None, None), ([], [], None)], ([], [], None)),
        "titles of later parts are left out": ([(["A"], [["1"]], "Table 1 x"), (["A"], [["2"]], "Table 2 y"), (["A"], [["3"]], "NOTE"), (["A"], [["4"]], "NOTE")], (["A"], [["1"], ["2"], ["3"], ["4"]], "Table 1 x NOTE")),
        "null cells and rows": ([(["A", None], [[None, "x"], None], None), (["A", None], [["", "y"]], None)], (["A", ""], [["", "x"], ["", "x"], ["", "y"]], None)),
    }
    got = merged(spark, *[parts for parts, _ in cases.values()])
    for (what, (_, want)), found in zip(cases.items(), got):
        assert found == want, what


def test_long_tables_merge_in_the_jvm(spark):
    parts = [(["A", "B"], [[str(i), str(j)] for j in range(40)], None) for i in range(200)]
    ((headers, rows, _),) = merged(spark, parts)
    assert headers == ["A", "B"] and rows == [[str(i), str(j)] for i in range(200) for j in range(40)]
    plan = spark.createDataFrame([([],)], "parts array<struct<headers array<string>, body_rows array<array<string>>, caption string>>").select(merge_parts(F.col("parts")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_collapsed_tables(spark):
    rows = [block(0, "table", page=13, table=(["A", "B"], [["1", "2"]], None)), block(1, "table", page=14, table=(["A", "B"], [["A", "B"], ["3", "4"]], None)), block(2, "paragraph", "x", page=14)]
    got = run(collapse_tables(R.with_position(frame(spark, rows))))
    assert [(r.block_type, r.table_data.body_rows if r.table_data else None, r.metadata) for r in got] == [("table", [["1", "2"], ["3", "4"]], {"merged_parts": "2", "page_end": "14", "continued": "true"}), ("paragraph", None, {})]


def test_sequence_is_idempotent_and_order_free(spark):
    rows = [block(0, "paragraph", "Contents"), block(1, "paragraph", "x"), block(2, "paragraph", "1 Scope"), block(3, "image", image=(None, "a", None)), block(4, "paragraph", "Figure 1 x"), block(5, "paragraph", "All rights reserved"), block(6, "heading", "Odd title", 3)]
    once = R.refine_sequence(frame(spark, rows))
    got = [(r.block_id, r.block_type, r.text) for r in run(once)]
    assert got == [("block_0", "heading", "1 Scope"), ("block_1", "image", None), ("block_2", "paragraph", "Odd title")]
    assert [(r.block_id, r.block_type, r.text) for r in run(R.refine_sequence(once))] == got
    assert R.refine_sequence(frame(spark, rows).limit(0)).count() == 0


def test_shards_are_refined_once(spark):
    rows = [block(0, "heading", "Contents", 1), block(1, "paragraph", "entry")], [block(0, "paragraph", "entry two"), block(1, "heading", "1 Scope", 1)]
    a, b = (frame(spark, r).withColumn("shard", F.lit(i)).withColumn("page_offset", F.lit(i)) for i, r in enumerate(rows))
    assert [(r.text, r.page) for r in run(R.merge_shards(a.unionByName(b)))] == [("1 Scope", 2)]
    assert table_runs(R.with_position(frame(spark, rows[0]))).where("head is not null").count() == 0


def odd_blocks(n_docs, rng):
    """Blocks of every kind with gaps in every column, for documents of up to 40 rows."""
    texts = ["1 Scope", "Contents", "Foreword", "Annex B (informative)", "Figure 4.1 x", "Table 5.1-2 Values", " Table 6 y\n", "@startuml", "@enduml", "UE -> RIC: report", "participant RIC", "Parts:", "1) Part:", "plain words", "All rights reserved", "", None]
    kinds = ["heading", "paragraph", "paragraph", "code", "table", "table", "table", "image", "image", "list_item", "list_item", None]
    number = lambda *own: rng.choice([*own, *own, None, float("nan")])
    for d in range(n_docs):
        for i in range(rng.randrange(1, 40)):
            kind = rng.choice(kinds)
            box = rng.choice([None, *[(number(50.0, 70.0, 310.0), number(100.0), number(300.0, 320.0), number(200.0, 210.0), None)] * 3])
            table = rng.choice([None, *[(rng.choice([None, [], ["A", "B"], ["A", "B", "C"], ["0", "1"], ["A", None]]), rng.choice([None, [], [["1", "2"]], [["1", "2", "3"], None]]), rng.choice([None, "", "Table 9 Own", "note"]))] * 4]) if kind == "table" else None
            image = rng.choice([None, (None, "alt", rng.choice([None, "", "own"]))]) if kind == "image" else None
            page = rng.choice([None, 1 + i // 4, 1 + i // 4, 2 + i // 4])
            spans = rng.choice([[], [], None, [(page, box, "ref")]])
            meta = rng.choice([{}, {}, None, {"language": "x", "page_end": "4"}, {"merged_parts": "3", "page_end": "z"}])
            yield (d * 1000 + i, f"d{d}", f"b{i}", kind, rng.choice([i, i, None]) if i == 0 else i, page, rng.choice(texts), rng.choice([None, 0, 1, 2, 3]), table, image, box, None, meta, spans)


def test_one_pass_gives_what_the_steps_give(spark):
    blocks = frame(spark, odd_blocks(120, random.Random(11))).localCheckpoint()
    want = [str(r) for r in run(R.refine_by_steps(blocks))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert [str(r) for r in run(R.refine_in_one_pass(blocks))] == want
        assert [str(r) for r in run(R.refine_sequence(blocks))] == want  # documents of up to SEGMENT rows and others
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_documents_that_fit_a_task_take_one_shuffle_and_no_table(spark, monkeypatch):
    monkeypatch.setattr(O, "SEGMENT", 1000)
    staged = []
    stage = R.stage_table
    monkeypatch.setattr(R, "stage_table", lambda df, label: staged.append(label) or stage(df, label))
    plan = R.refine_sequence(frame(spark, odd_blocks(5, random.Random(3))))._jdf.queryExecution().executedPlan().toString()
    assert staged == ["large"] and plan.count("Exchange") == 1


def test_long_texts_are_read_once_for_arrows(spark):
    """The arrow pattern took a time quadratic in the length of a text."""
    long = "a" * 100_000
    df = spark.createDataFrame([(0, long), (1, long + " > "), (2, long + " -> " + long), (3, "x -->> 'y'"), (4, "-> y"), (5, "é.->_")], "i int, t string").localCheckpoint()
    began = time.monotonic()
    assert [r.part for r in df.orderBy("i").select(R.is_diagram_fragment(F.col("t")).alias("part")).collect()] == [False, False, True, True, False, True]
    assert time.monotonic() - began < 20


def test_shards_that_fit_a_task_take_one_shuffle(spark, monkeypatch):
    monkeypatch.setattr(O, "SEGMENT", 1000)
    shards = frame(spark, odd_blocks(5, random.Random(4))).withColumn("shard", F.expr("int(ord div 10)")).withColumn("page_offset", F.expr("int(ord div 10) * 3"))
    plan = R.merge_shards(shards)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
