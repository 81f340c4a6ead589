"""Deeply nested records to flat tables, linked by interval labels.

One depth-first walk gives every node of a record an entry and an exit number from one clock (pre, post). Node a holds
node b exactly when a.pre < b.pre and b.post < a.post, so parent links need no paths: they are read off the intervals.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.runtime import stage_table

NODE_SCHEMA = "record_id bigint, pre int, post int, kind string, node_id string, ref string, attrs map<string,string>"
_ARROW = pa.schema([("record_id", pa.int64()), ("pre", pa.int32()), ("post", pa.int32()), ("kind", pa.string()), ("node_id", pa.string()), ("ref", pa.string()), ("attrs", pa.map_(pa.string(), pa.string()))])

_CHILD_SECTIONS = ("subsections", "children", "sections")


def _members(value: object, markers: tuple[str, ...]) -> list[tuple[str | None, dict]]:
    """(key, object) of a member given as list, object keyed by id, or single object."""
    if isinstance(value, list):
        return [(None, x) for x in value if isinstance(x, dict)]
    if isinstance(value, dict):
        if any(m in value and not isinstance(value[m], dict) for m in markers):
            return [(None, value)]
        return [(k, x) for k, x in value.items() if isinstance(x, dict)]
    return []


def _ids(value: object) -> list[str]:
    if isinstance(value, (str, int)) and not isinstance(value, bool):
        return [str(value)]
    return [str(x) for x in value if isinstance(x, (str, int)) and not isinstance(x, bool)] if isinstance(value, list) else []


_SPACE = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?|true|false|null")


def _long_int(digits: str) -> object:
    """Integers of any length; those longer than Python turns into numbers stay as their digits."""
    return int(digits) if len(digits) < 4000 else digits


def _parse_with_stack(text: str) -> object:
    """JSON of any depth, read with a stack of open lists and objects instead of recursion. ValueError if it isn't complete JSON."""
    pos, n = _SPACE.match(text, 0).end(), len(text)
    stack: list[tuple[list | dict, str | None]] = []  # open containers, each with the key that its next value gets

    def key_at(pos: int) -> tuple[str, int]:
        if text[pos : pos + 1] != '"':
            raise ValueError("a key is missing")
        key, pos = scanstring(text, pos + 1, True)
        pos = _SPACE.match(text, pos).end()
        if text[pos : pos + 1] != ":":
            raise ValueError("a colon is missing")
        return key, _SPACE.match(text, pos + 1).end()

    while True:
        mark = text[pos : pos + 1]
        opened: list | dict | None = None
        if mark in ("{", "["):
            opened = {} if mark == "{" else []
            pos = _SPACE.match(text, pos + 1).end()
            if text[pos : pos + 1] == ("}" if mark == "{" else "]"):
                value, pos = opened, pos + 1
            else:
                key = None
                if mark == "{":
                    key, pos = key_at(pos)
                stack.append((opened, key))
                continue
        elif mark == '"':
            value, pos = scanstring(text, pos + 1, True)
        elif m := _ATOM.match(text, pos):
            word, pos = m.group(), m.end()
            value = {"true": True, "false": False, "null": None}[word] if word[0] in "tfn" else _long_int(word) if word.lstrip("-").isdigit() else float(word)
        else:
            raise ValueError(f"no value at {pos}")
        while True:  # give the value to its container, and close those that end here
            pos = _SPACE.match(text, pos).end()
            if not stack:
                if pos < n:
                    raise ValueError(f"more text at {pos}")
                return value
            holder, key = stack.pop()
            if isinstance(holder, dict):
                holder[key] = value
            else:
                holder.append(value)
            mark = text[pos : pos + 1]
            pos = _SPACE.match(text, pos + 1).end()
            if mark == ",":
                key = None
                if isinstance(holder, dict):
                    key, pos = key_at(pos)
                stack.append((holder, key))
                break
            if mark != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError(f"an end is missing at {pos}")
            value = holder


def parse_json(text: str) -> object:
    """The value of a JSON text of any depth; ValueError if it isn't complete JSON."""
    try:
        return json.loads(text, parse_int=_long_int)
    except RecursionError:
        return _parse_with_stack(text)


def find_document(payload: str | None) -> tuple[dict | None, str]:
    """(document, '') of a payload: bare, quoted as a JSON string any number of times, or under wrapper members of any depth, the least
    deep first. Else (None, reason): 'null', 'empty', 'broken' (not complete JSON) or 'no document'."""
    if payload is None:
        return None, "null"
    if not payload.strip():
        return None, "empty"
    try:
        value = parse_json(payload)
        while isinstance(value, str) and value.strip():
            value = parse_json(value)
    except ValueError:
        return None, "broken"
    level = [value]
    while level:
        below: list = []
        for v in level:
            if isinstance(v, str) and '"schema_version"' in v:
                try:  # a quoted document; text that only looks like one is no error of the record
                    v = parse_json(v)
                except ValueError:
                    continue
                below.append(v)
            elif isinstance(v, dict):
                if "schema_version" in v or any(isinstance(v.get(k), (list, dict)) for k in ("sections", "blocks")):
                    return v, ""
                below += v.values()
            elif isinstance(v, list):
                below += v
        level = below
    return None, "no document"


def _scalars(obj: dict) -> list[tuple[str, str]]:
    return [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in obj.items() if v is not None and not isinstance(v, (dict, list))]


def walk_document(doc: dict, with_attrs: bool = True) -> list[tuple]:
    """Nodes (pre, post, kind, node_id, ref, attrs) of a document by one iterative depth-first traversal.

    Kinds: section (ref = parent_id member), block, block_ref (an id listed by the section around it), table_row, span
    (node_id = position), extra (node_id = path).
    """
    out: list[list] = []
    clock = 0
    # a stack entry is ("open", kind, id, ref, attrs, children) or ("close", index)
    stack: list[tuple] = []

    def block(key: str | None, b: dict) -> tuple:
        bid = b.get("id", key)
        kids: list[tuple] = []
        table = b.get("table")
        rows = table.get("rows") if isinstance(table, dict) else None
        if isinstance(rows, list):
            kids += [("open", "table_row", str(i), None, [(f"c{j}", str(c)) for j, c in enumerate(r)] if with_attrs and isinstance(r, list) else [], ()) for i, r in enumerate(rows)]
        spans = b.get("layout_spans")
        spans = [spans] if isinstance(spans, dict) else spans if isinstance(spans, list) else []
        kids += [("open", "span", str(i), None, _scalars(s) + _scalars(s.get("bbox") or {}) if with_attrs and isinstance(s, dict) else [], ()) for i, s in enumerate(spans)]
        return ("open", "block", None if bid is None else str(bid), None, _scalars(b) if with_attrs else [], kids)

    def section(key: str | None, s: dict) -> tuple:
        sid, parent = s.get("id", key), s.get("parent_id")
        kids = [("open", "block_ref", x, None, [], ()) for x in _ids(s.get("block_ids"))]
        if isinstance(s.get("blocks"), list):
            kids += [("open", "block_ref", x, None, [], ()) for x in _ids(s["blocks"])]
        kids += [("lazy", block, k, b) for k, b in _members(s.get("blocks"), ("id", "type", "text"))]
        for name in _CHILD_SECTIONS:
            kids += [("lazy", section, k, c) for k, c in _members(s.get(name), ("id", "title", "level"))]
        return ("open", "section", None if sid is None else str(sid), None if parent in (None, "") else str(parent), _scalars(s) if with_attrs else [], kids)

    def extra(value: object) -> list[tuple]:
        leaves, todo = [], [(None, value)]  # a path is (path before, last step), so that deep ones share what they have in common
        while todo:
            path, v = todo.pop()
            if isinstance(v, dict):
                todo += [((path, k), x) for k, x in reversed(v.items())]
            elif isinstance(v, list):
                todo += [((path, str(i)), x) for i, x in reversed(list(enumerate(v)))]
            elif v is not None and path:
                steps, at = [], path
                while at:
                    at, step = at
                    steps.append(step)
                leaves.append(("open", "extra", ".".join(reversed(steps)), None, [("value", v if isinstance(v, str) else json.dumps(v))] if with_attrs else [], ()))
        return leaves

    top: list[tuple] = []
    meta = doc.get("metadata")
    if isinstance(meta, dict):
        top += extra(meta.get("extra"))
    top += [("lazy", section, k, s) for k, s in _members(doc.get("sections"), ("id", "title", "level"))]
    top += [("lazy", block, k, b) for k, b in _members(doc.get("blocks"), ("id", "type", "text"))]
    stack = top[::-1]
    while stack:
        item = stack.pop()
        if item[0] == "lazy":
            item = item[1](item[2], item[3])
        if item[0] == "close":
            out[item[1]][1] = clock
        else:
            _, kind, node_id, ref, attrs, kids = item
            out.append([clock, -1, kind, node_id, ref, attrs])
            stack.append(("close", len(out) - 1))
            stack.extend(reversed(kids))
        clock += 1
    return [tuple(x) for x in out]


def _without_halves(value: object) -> object:
    """Halves of surrogate pairs in strings replaced, in nested tuples and lists too."""
    if isinstance(value, str):
        return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return type(value)(map(_without_halves, value)) if isinstance(value, (tuple, list)) else value


def _latest(records: DataFrame, id_col: str, payload_col: str, time_col: str) -> DataFrame:
    """(record_id, payload): one row per id."""
    when = F.col(time_col).cast("timestamp") if time_col in records.columns else F.lit(None).cast("timestamp")
    slim = records.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(payload_col).alias("payload"), when.alias("at")).where("record_id is not null")
    return slim.groupBy("record_id").agg(F.max(F.struct("at", "payload")).alias("r")).select("record_id", F.col("r.payload").alias("payload"))


def rejected_records(records: DataFrame, id_col: str = "record_id", payload_col: str = "payload", time_col: str = "received_at") -> DataFrame:
    """(record_id, reason) of the records that give no node: 'null', 'empty', 'broken' or 'no document'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(rid, why) for rid, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (why := find_document(p)[1])]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], names=["record_id", "reason"])

    return _latest(records, id_col, payload_col, time_col).mapInArrow(run, "record_id bigint, reason string")


def label_nodes(records: DataFrame, id_col: str = "record_id", payload_col: str = "payload", with_attrs: bool = True, time_col: str = "received_at") -> DataFrame:
    """All nodes of all payloads with their interval labels (NODE_SCHEMA).

    Of rows with the same id the latest received one counts (``time_col``, where the frame has it; else the greatest payload). Null,
    empty or broken payloads, those without a document, and rows with a null id give no node; ``rejected_records`` names them.
    """
    slim = _latest(records, id_col, payload_col, time_col).where("payload is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for rid, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc, _ = find_document(payload)
                if doc is None:
                    continue
                lone = "\\ud" in payload.lower()  # halves of surrogate pairs, which no text may hold alone
                for node in walk_document(doc, with_attrs):
                    if lone:
                        node = _without_halves(node)
                    cols[0].append(rid)
                    for c, v in zip(cols[1:], node):
                        c.append(v)
                if len(cols[0]) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)
                    cols = [[] for _ in range(7)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)

    return slim.mapInArrow(run, NODE_SCHEMA)


#: Which node kinds hold which: (holder, kinds inside).
HOLDERS = (("section", ("section", "block", "block_ref")), ("block", ("table_row", "span")))


def link_by_interval(nodes: DataFrame) -> DataFrame:
    """Add ``holder_pre`` and ``holder_id``: the innermost node of the holder kind whose interval contains the node.

    A sweep in window functions: along the clock, holders open (+1) and close (-1); the running sum is the nesting depth,
    and the innermost open holder at depth d is the last one that opened at depth d. Linear in the nodes, with no range
    join. Nodes outside of any holder get nulls.
    """
    kinds = F.create_map(*[x for holder, inside in HOLDERS for k in inside for x in (F.lit(k), F.lit(holder))])
    points = nodes.where(F.col("kind") != "extra").select("*", kinds[F.col("kind")].alias("holder"), (F.col("pre") * 2).alias("at"), F.lit(0).alias("step"))
    holders = nodes.where(F.col("kind").isin("section", "block"))
    none: Column = F.lit(None)
    edge = lambda at, step: holders.select(
        "record_id", "pre", none.cast("int").alias("post"), none.cast("string").alias("kind"), "node_id", none.cast("string").alias("ref"), none.cast("map<string,string>").alias("attrs"), F.col("kind").alias("holder"), at.alias("at"), F.lit(step).alias("step")
    )
    events = points.unionByName(edge(F.col("pre") * 2 + 1, 1)).unionByName(edge(F.col("post") * 2 + 1, -1))
    along = Window.partitionBy("record_id", "holder").orderBy("at")
    depth = events.withColumn("depth", F.sum("step").over(along))
    at_depth = Window.partitionBy("record_id", "holder", "depth").orderBy("at")
    opened = F.when(F.col("step") == 1, F.struct("pre", "node_id"))
    linked = depth.withColumn("open", F.when(F.col("depth") > 0, F.last(opened, ignorenulls=True).over(at_depth)))
    linked = linked.where("step = 0").select(*nodes.columns, F.col("open.pre").alias("holder_pre"), F.col("open.node_id").alias("holder_id"))
    return linked.unionByName(nodes.where(F.col("kind") == "extra").withColumn("holder_pre", none.cast("int")).withColumn("holder_id", none.cast("string")))


def record_links(records: DataFrame, id_col: str = "record_id", payload_col: str = "payload") -> DataFrame:
    """(record_id, kind, child_id, parent_id): distinct parent-child rows of every payload that holds a document.

    Sections link to the section around them, else to their parent_id member, else to ''. Blocks link to the section that
    holds them, else to the one that lists their id, else to ''. Nodes without any id give no row; listed ids that no
    object has give none either.
    """
    linked = stage_table(link_by_interval(stage_table(label_nodes(records, id_col, payload_col, with_attrs=False), "nodes")), "linked")
    lists = linked.where("kind = 'block_ref' and holder_id is not null").groupBy("record_id", F.col("node_id").alias("listed")).agg(F.min_by("holder_id", "pre").alias("lister"))
    blocks = linked.where("kind = 'block' and node_id is not null").select("record_id", "kind", F.col("node_id").alias("child_id"), "holder_id")
    blocks = blocks.join(lists.withColumnRenamed("listed", "child_id"), ["record_id", "child_id"], "left").select("record_id", "kind", "child_id", F.coalesce("holder_id", "lister", F.lit("")).alias("parent_id"))
    sections = linked.where("kind = 'section' and node_id is not null").select("record_id", "kind", F.col("node_id").alias("child_id"), F.coalesce("holder_id", "ref", F.lit("")).alias("parent_id"))
    parts = linked.where("kind in ('table_row', 'span') and holder_id is not null").select("record_id", "kind", F.concat_ws(":", "holder_id", "node_id").alias("child_id"), F.col("holder_id").alias("parent_id"))
    extras = linked.where("kind = 'extra'").select("record_id", "kind", F.col("node_id").alias("child_id"), F.lit("metadata").alias("parent_id"))
    return sections.unionByName(blocks).unionByName(parts).unionByName(extras).distinct()


def node_tables(records: DataFrame, id_col: str = "record_id", payload_col: str = "payload") -> dict[str, DataFrame]:
    """One flat table per node kind, each row with its labels, attributes and the labels of the node that holds it."""
    linked = link_by_interval(stage_table(label_nodes(records, id_col, payload_col), "nodes"))
    get = lambda name, kind="string": F.col("attrs")[name].try_cast(kind).alias(name)
    head = ["record_id", "pre", "post"]
    holder = ["holder_pre", "holder_id"]
    return {
        "sections": linked.where("kind = 'section'").select(*head, F.col("node_id").alias("section_id"), *holder, F.col("ref").alias("parent_ref"), get("title"), get("level", "int"), get("order", "int"), get("page_start", "int"), get("page_end", "int")),
        "blocks": linked.where("kind = 'block'").select(*head, F.col("node_id").alias("block_id"), *holder, get("type"), get("order", "int"), get("page", "int"), get("text"), get("level", "int")),
        "block_refs": linked.where("kind = 'block_ref'").select(*head, F.col("node_id").alias("block_id"), *holder),
        "table_rows": linked.where("kind = 'table_row'").select(*head, F.col("node_id").cast("int").alias("row_no"), *holder, F.col("attrs").alias("cells")),
        "spans": linked.where("kind = 'span'").select(*head, F.col("node_id").cast("int").alias("span_no"), *holder, get("page", "int"), get("x0", "double"), get("y0", "double"), get("x1", "double"), get("y1", "double"), get("source_ref")),
        "extra": linked.where("kind = 'extra'").select(*head, F.col("node_id").alias("path"), get("value")),
    }
