import json
import random

from folioforge.operators.nested import _parse_with_stack, find_document, label_nodes, link_by_interval, node_tables, parse_json, record_links, rejected_records, walk_document

DOC = {
    "schema_version": "1.0",
    "metadata": {"source_path": "a.pdf", "extra": {"a": "1", "b": {"c": [1, None, {"d": "x"}]}, "e": None, "f": []}},
    "sections": [
        {"id": "s1", "title": "One", "block_ids": ["b1", "zz"], "subsections": [{"id": "s2", "blocks": [{"id": "b2", "layout_spans": {"page": 2}}]}]},
        {"id": "s3", "parent_id": "s1", "blocks": {"b4": {"type": "table", "table": {"rows": [["x"], ["y"]]}}}},
    ],
    "blocks": {"b1": {"type": "paragraph", "layout_spans": [{"page": 1}, {"page": 2}]}, "b3": {"type": "paragraph"}},
}
LINKS = {
    ("section", "s1", ""), ("section", "s2", "s1"), ("section", "s3", "s1"), ("block", "b1", "s1"), ("block", "b2", "s2"), ("block", "b3", ""), ("block", "b4", "s3"),
    ("table_row", "b4:0", "b4"), ("table_row", "b4:1", "b4"), ("span", "b1:0", "b1"), ("span", "b1:1", "b1"), ("span", "b2:0", "b2"),
    ("extra", "a", "metadata"), ("extra", "b.c.0", "metadata"), ("extra", "b.c.2.d", "metadata"),
}
SCHEMA = "record_id bigint, payload string, kind string, at int"


def links(df):
    return {(r.record_id, r.kind, r.child_id, r.parent_id) for r in record_links(df).collect()}


def test_links_of_all_wrappings(spark):
    text = json.dumps(DOC)
    rows = [(1, text, "x", 1), (1, text, "x", 1), (2, json.dumps(text), None, None), (3, json.dumps({"event": "e", "document": DOC}), "y", 2)]
    assert links(spark.createDataFrame(rows, SCHEMA)) == {(i, *x) for i in (1, 2, 3) for x in LINKS}


def test_broken_null_and_empty(spark):
    text = json.dumps(DOC)
    rows = [(1, None, "k", 0), (2, "", "k", 0), (3, text[:-5], "k", 0), (4, "[]", "k", 0), (5, '"x"', "k", 0), (None, text, "k", 0), (6, '{"schema_version":"1.0","sections":null,"blocks":[{}]}', None, 0)]
    assert links(spark.createDataFrame(rows, SCHEMA)) == set()
    assert links(spark.createDataFrame([], SCHEMA)) == set()


def test_labels_nest_and_give_the_parents(spark):
    rng = random.Random(3)

    def section(depth, n=[0]):
        n[0] += 1
        return {"id": f"s{n[0]}", "blocks": [{"id": f"b{n[0]}_{i}"} for i in range(rng.randint(0, 3))], "subsections": [section(depth + 1) for _ in range(rng.randint(0, 3) if depth < 5 else 0)]}

    doc = {"schema_version": "1.0", "sections": [section(0) for _ in range(4)]}
    nodes = walk_document(doc)
    assert all(pre < post for pre, post, *_ in nodes)
    found = {r.node_id: r.holder_id for r in link_by_interval(label_nodes(spark.createDataFrame([(1, json.dumps(doc))], "record_id bigint, payload string"))).collect()}
    for pre, post, kind, node_id, *_ in nodes:
        around = [n for n in nodes if n[0] < pre and n[1] > post and n[2] == "section"]
        assert found[node_id] == (max(around)[3] if around else None)


def test_records_of_any_depth(spark):
    n = 100_000
    deep = '{"schema_version":"1.0","sections":[' + "".join(f'{{"id":"s{i}","subsections":[' for i in range(n)) + "]}" * n + "]}"
    assert len(walk_document(find_document(deep)[0], with_attrs=False)) == n + 1 or len(walk_document(find_document(deep)[0], with_attrs=False)) == n
    small = '{"schema_version":"1.0","metadata":{"extra":' + '{"a":' * 5_000 + "1" + "}" * 5_000 + "}}"
    df = spark.createDataFrame([(1, deep), (2, small)], "record_id bigint, payload string")
    got = link_by_interval(label_nodes(df, with_attrs=False)).where("record_id = 1 and kind = 'section' and holder_id = concat('s', cast(substr(node_id, 2) as int) - 1)").count()
    assert got == n - 1
    assert [len(r.child_id) for r in record_links(df.where("record_id = 2")).collect()] == [2 * 5_000 - 1]
    assert find_document("[" * n) == (None, "broken") and find_document("[" * n + "]" * n) == (None, "no document")


def test_wrappers_and_quotes_of_any_number(spark):
    text = json.dumps(DOC)
    for _ in range(10):
        text = json.dumps({"event": "e", "body": [None, text and json.loads(text)]})
    quoted = json.dumps(DOC)
    for _ in range(6):
        quoted = json.dumps(quoted)
    inner = json.dumps({"note": '{ "schema_version" }', "other": '{"schema_version": ', "deep": {"document": json.dumps(DOC)}})
    df = spark.createDataFrame([(1, text), (2, quoted), (3, inner)], "record_id bigint, payload string")
    assert links(df) == {(i, *x) for i in (1, 2, 3) for x in LINKS}


def test_stack_parser_equals_the_other(spark):
    rng = random.Random(8)

    def value(depth):
        if depth > 4 or rng.random() < 0.3:
            return rng.choice([None, True, False, 0, -12, 3.5, 1e-9, "", 'q"\\n\u00e9\U0001f600', "x"])
        if rng.random() < 0.5:
            return [value(depth + 1) for _ in range(rng.randint(0, 4))]
        return {rng.choice("abcd\n"): value(depth + 1) for _ in range(rng.randint(0, 4))}

    for _ in range(300):
        v = value(0)
        text = json.dumps(v, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        assert _parse_with_stack(text) == v == parse_json(text)
        cut = text[: rng.randrange(len(text))] + rng.choice(["", ",", "}", "x"])
        try:
            want = json.loads(cut)
        except ValueError:
            want = ValueError
        try:
            got = _parse_with_stack(cut)
        except ValueError:
            got = ValueError
        assert got == want, cut
    assert parse_json("1" + "0" * 9_000) == "1" + "0" * 9_000


def test_rejected_records_say_why(spark):
    rows = [(1, None), (2, "  "), (3, "{"), (4, "[1]"), (5, json.dumps(DOC)), (None, "{")]
    assert {(r.record_id, r.reason) for r in rejected_records(spark.createDataFrame(rows, "record_id bigint, payload string")).collect()} == {(1, "null"), (2, "empty"), (3, "broken"), (4, "no document")}


def test_halves_of_surrogate_pairs(spark):
    df = spark.createDataFrame([(1, '{"schema_version":"1","sections":[{"id":"a\\ud83d","title":"\\uD83D\\uDE00"}]}')], "record_id bigint, payload string")
    assert [(r.section_id, r.title) for r in node_tables(df)["sections"].collect()] == [("a\ufffd", "\U0001f600")]


def test_latest_row_of_a_record_counts(spark):
    rows = [(1, json.dumps({"schema_version": "1", "blocks": [{"id": x}]}), t) for x, t in (("old", "2024-01-01"), ("new", "2024-03-01"), ("mid", "2024-02-01"))]
    assert [r.child_id for r in record_links(spark.createDataFrame(rows, "record_id bigint, payload string, received_at string")).collect()] == ["new"]


def test_node_tables(spark):
    t = node_tables(spark.createDataFrame([(1, json.dumps(DOC))], "record_id bigint, payload string"))
    assert {(r.section_id, r.title, r.holder_id, r.parent_ref) for r in t["sections"].collect()} == {("s1", "One", None, None), ("s2", None, "s1", None), ("s3", None, None, "s1")}
    assert {(r.path, r.value) for r in t["extra"].collect()} == {("a", "1"), ("b.c.0", "1"), ("b.c.2.d", "x")}
    assert sorted(r.page for r in t["spans"].collect()) == [1, 2, 2]
    assert t["block_refs"].count() == 2 and t["table_rows"].count() == 2
