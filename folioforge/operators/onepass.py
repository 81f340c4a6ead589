"""All refinements of whole documents in one pass over their sorted rows.

The rules on texts are evaluated as column functions into one number of bits a row; what depends on other rows is decided in
Arrow batches of whole documents, with array operations over all documents of a batch at once; merged blocks leave with their parts
as a list, from which columns are made in the JVM again. One shuffle by document, no table in between. The pass holds
whole documents, so it is for those of up to ``ordered.SEGMENT`` rows; ``refine.refine_sequence`` sends others through the steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from folioforge.functions import blocks as B

BITS = {name: 1 << i for i, name in enumerate((
    "item", "label", "heading", "removable", "boilerplate", "image", "table", "not_part", "start", "end", "plain", "not_plain",
    "figure_caption", "table_caption", "tabled", "titled", "bare", "real", "unknown",
))}
SINGLE, DIAGRAM, TABLE = 0, 1, 2


def with_facts(typed: DataFrame, flags: dict[str, Column], captions: Column) -> DataFrame:
    """The blocks with ``_bits`` (the flags that are true) and what is compared between rows of tables."""
    bits = F.lit(0)
    for name, flag in flags.items():
        bits = bits + F.when(flag, BITS[name]).otherwise(0)
    tabled = flags["tabled"]
    pages = B.page_numbers(F.col("layout_spans"), F.col("page"), F.element_at("metadata", "page_end"))
    last = F.coalesce(F.when(F.size(pages) > 0, F.element_at(pages, -1)), F.col("page"))
    return typed.withColumns({
        "_bits": bits.cast("int"), "_body": captions, "_last": F.when(tabled, last).cast("int"),
        "_columns": F.when(tabled, B.column_count(F.col("table_data"))).cast("int"), "_headers": F.when(tabled, F.to_json("table_data.headers")),
    })


def grouped(placed: DataFrame, columns: list[str]) -> DataFrame:
    """One row per refined block: its columns, ``_kind``, ``_caption`` (the text it takes), ``_parts`` of merged blocks and ``_ord``.

    ``placed`` has the columns of with_facts and ``_place``, a window's value over doc_id, so that documents are together and in order.
    """
    fields = [S.StructField(f.name, f.dataType) for f in placed.schema if f.name in columns]
    parts = S.ArrayType(S.StructType([*fields, S.StructField("_caption", S.StringType())]))
    out = S.StructType([*fields, S.StructField("_kind", S.IntegerType()), S.StructField("_ord", S.IntegerType()), S.StructField("_caption", S.StringType()), S.StructField("_parts", parts)])
    facts = ["_bits", "_body", "_last", "_columns", "_headers", "_place"]
    return placed.select(*[f.name for f in fields], *facts).mapInArrow(_fold, out)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of whole documents; what may go on in the next batch waits for it."""
    waiting: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        doc = b.column("doc_id")
        ends = np.flatnonzero(_changes(doc))
        if waiting and (len(ends) or doc[0].as_py() != waiting[-1].column("doc_id")[-1].as_py()):
            cut = 0 if doc[0].as_py() != waiting[-1].column("doc_id")[-1].as_py() else int(ends[0]) + 1
            cut = int(ends[-1]) + 1 if len(ends) else cut
            yield _refined(_joined([*waiting, b.slice(0, cut)]))
            waiting, b = [], b.slice(cut)
        elif not waiting and len(ends):
            cut = int(ends[-1]) + 1
            yield _refined(b.slice(0, cut))
            b = b.slice(cut)
        if b.num_rows:
            waiting.append(b)
    if waiting:
        yield _refined(_joined(waiting))


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.concat_batches(batches) if len(batches) > 1 else batches[0]


def _changes(doc: pa.Array) -> np.ndarray:
    """Whether the next row is of another document."""
    codes = doc.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return codes[1:] != codes[:-1]


class _Rows:
    """The rows that are left, in order: ``at`` are their places in the batch, ``doc`` numbers their documents."""

    def __init__(self, at: np.ndarray, doc: np.ndarray):
        self.at, self.doc, self.i = at, doc[at], np.arange(len(at))

    def _same(self, j: np.ndarray) -> np.ndarray:
        inside = (j >= 0) & (j < len(self.i))
        return np.where(inside & (self.doc[np.where(inside, j, 0)] == self.doc), j, -1) if len(self.i) else j

    def last(self, mask: np.ndarray, before: bool = False) -> np.ndarray:
        """The last row of the document with the mask up to each row (or up to the one before it), -1 for none."""
        seen = np.maximum.accumulate(np.where(mask, self.i, -1))
        return self._same(np.concatenate([[-1], seen])[:-1] if before else seen)

    def next(self, mask: np.ndarray) -> np.ndarray:
        """The first row of the document with the mask from each row on, -1 for none."""
        return self._same(np.minimum.accumulate(np.where(mask, self.i, len(self.i))[::-1])[::-1])

    def near(self, k: int) -> np.ndarray:
        """The row k places on in the document, -1 for none."""
        return self._same(self.i + k)


def _has(mask: np.ndarray, j: np.ndarray) -> np.ndarray:
    return (j >= 0) & mask[j] if len(mask) else np.zeros(0, bool)


class _Number:
    """Numbers with nulls; comparisons of NaN as Spark has them (NaN is the largest)."""

    def __init__(self, a: pa.Array):
        self.null = a.is_null().to_numpy(zero_copy_only=False)
        self.v = a.fill_null(0).to_numpy(zero_copy_only=False)


def _refined(b: pa.RecordBatch) -> pa.RecordBatch:
    n = b.num_rows
    doc = np.concatenate([[0], np.cumsum(_changes(b.column("doc_id")))]) if n else np.zeros(0, int)
    bits = b.column("_bits").to_numpy(zero_copy_only=False)
    flag = lambda name: (bits & BITS[name]) != 0
    page, last_page, level, width = (_Number(b.column(c)) for c in ("page", "_last", "heading_level", "_columns"))
    bbox = b.column("bbox")
    no_box = bbox.is_null().to_numpy(zero_copy_only=False)
    box = dict(zip(("x0", "y0", "x1", "y1"), (_Number(pa.compute.struct_field(bbox, c)) for c in ("x0", "y0", "x1", "y1"))))
    headers = b.column("_headers").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    kind, group, caption = np.zeros(n, np.int32), np.full(n, -1), np.full(n, -1)

    _list_levels(_Rows(np.arange(n), doc), flag("item"), flag("label"), box["x0"], level)

    rows = _Rows(np.arange(n), doc)
    depth = np.where(level.null | (level.v == 0), 1, level.v)
    removable = flag("heading") & flag("removable")
    opened = rows.last(removable)
    closed = rows.last(flag("heading") & ~removable & (opened >= 0) & (depth <= depth[opened]))
    rows = _Rows(rows.at[((opened < 0) | (closed > opened)) & ~flag("boilerplate")], doc)

    image, table = flag("image"), flag("table")
    covered = np.zeros(len(rows.at), bool)
    for k in (-1, 1):
        other = rows.near(k)
        it = np.flatnonzero((image | flag("unknown"))[rows.at] & _has(table[rows.at], other))  # an unknown type goes with the images, as in the step
        covered[it] |= _covers(rows.at[it], rows.at[other[it]], page, box, no_box)
    rows = _Rows(rows.at[~covered], doc)

    at = rows.at
    start, plain = flag("start")[at], flag("plain")[at]
    s, x, e = rows.last(start), rows.last(flag("not_part")[at]), rows.last(flag("end")[at], before=True)
    part = (s >= 0) & (s > e) & (s > x) | plain & _has(start, rows.next(flag("not_plain")[at]))
    first = part & ~_has(part, rows.near(-1))
    head = rows.last(first)
    group[at[part]] = at[head[part]]
    kind[at[first]] = DIAGRAM
    rows = _Rows(at[~part | first], doc)

    figure, titles = flag("figure_caption") & (kind != DIAGRAM), flag("table_caption") & (kind != DIAGRAM)
    at, cap, im = rows.at, figure[rows.at], image[rows.at]
    c, i = (lambda k: _has(cap, rows.near(k))), (lambda k: _has(im, rows.near(k)))
    choice = np.where(im, np.select([c(1) & ~i(2), c(-1) & ~i(-2), c(1), c(-1) & c(-3) & ~i(-4)], [1, -1, 1, -1], 0), 0)
    chosen = np.flatnonzero(choice)
    caption[at[chosen]] = at[chosen + choice[chosen]]
    taken = _has(choice == 1, rows.near(-1)) | _has(choice == -1, rows.near(1))
    rows = _Rows(at[~(taken & (choice == 0) & cap)], doc)

    tabled, titled, real, bare = flag("tabled"), flag("titled"), flag("real"), flag("bare")

    def heads(rows: _Rows) -> np.ndarray:
        at, i, tb, tl = rows.at, rows.i, tabled[rows.at], titled[rows.at]
        before = rows.last(~titles[at], before=True)
        goes_on = tb & _has(tb, before) & ~tl & ~((before < i - 1) & _has(tl, before))
        it = np.flatnonzero(goes_on)
        goes_on[it] = _continues(at[before[it]], at[it], page, last_page, width, headers, real, box, no_box)
        return np.where(tb, rows.last(tb & ~goes_on), -1)

    at, head = rows.at, heads(rows)
    tb = np.flatnonzero(head >= 0)
    end = np.full(len(at), -1)
    np.maximum.at(end, head[tb], tb)
    cap = titles[at]
    after, ahead = (np.where(_has(cap, rows.near(k)), rows.near(k), -1) for k in (1, -1))
    own = (head == rows.i) & bare[at]
    takes = _has(bare[at], head) & ((head == rows.i) | (_has(np.ones(len(at), bool), head) & (end[head] == rows.i) & (after[head] < 0))) if len(at) else own
    choice = np.where(after >= 0, after, np.where(_has(after >= 0, end), after[end], np.where(_has(takes, rows.near(-2)), -1, ahead))) if len(at) else end
    chosen = np.flatnonzero(own & (choice >= 0))
    caption[at[chosen]] = at[choice[chosen]]
    titled = titled.copy()
    titled[at[chosen]] = True
    gone = np.zeros(len(at), bool)
    gone[choice[chosen]] = True
    rows = _Rows(at[~gone], doc)

    at, head = rows.at, heads(rows)
    tb = np.flatnonzero(head >= 0)
    many = np.bincount(head[tb], minlength=len(at)) > 1 if len(tb) else np.zeros(len(at), bool)
    merged = _has(many, head)
    group[at[merged]] = at[head[merged]]
    kind[at[many]] = TABLE
    rows = _Rows(at[~merged | (head == rows.i)], doc)
    return _written(b, rows, kind, group, caption, level)


def _list_levels(rows: _Rows, item: np.ndarray, label: np.ndarray, x: _Number, level: _Number) -> None:
    it = np.flatnonzero(item)
    if not len(it):
        return
    begins = ~_has(item, rows.near(-1))[it]
    known = np.where(x.null[it], np.nan, x.v[it])
    least = np.fmin.reduceat(known, np.flatnonzero(begins))[np.cumsum(begins) - 1]
    within = lambda by: (known <= least + by) | np.isnan(least)  # noqa: E731  # without a number in the run, all are NaN
    level.v = level.v.copy()
    level.v[it] = np.where(label[it] | x.null[it] | within(10), 1, np.where(within(35), 2, 3))
    level.null = level.null & ~item


def _covers(a: np.ndarray, o: np.ndarray, page: _Number, box: dict[str, _Number], no_box: np.ndarray) -> np.ndarray:
    """blocks.iou of at least 0.5, on the same or an unknown page."""
    def side(lo: _Number, hi: _Number) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        value = lambda x, i: np.where(x.null[i], np.nan, x.v[i])
        least = np.fmin(value(hi, a), value(hi, o))
        most = np.where(lo.null[a], value(lo, o), np.where(lo.null[o], value(lo, a), np.maximum(lo.v[a], lo.v[o])))
        unknown = hi.null[a] & hi.null[o] | lo.null[a] & lo.null[o]
        own = lambda i: np.where(hi.null[i] | lo.null[i], 0.0, np.maximum(0.0, hi.v[i] - lo.v[i]))
        return np.where(unknown, 0.0, np.maximum(0.0, least - most)), own(a), own(o)

    w, wa, wo = side(box["x0"], box["x1"])
    h, ha, ho = side(box["y0"], box["y1"])
    with np.errstate(all="ignore"):
        inter = w * h
        union = wa * ha + wo * ho - inter
        share = np.where((inter <= 0) | (union <= 0), 0.0, inter / union)
    same = page.null[a] | page.null[o] | (page.v[a] == page.v[o])
    return same & ~no_box[a] & ~no_box[o] & ~(share < 0.5)


def _continues(p: np.ndarray, c: np.ndarray, page: _Number, last: _Number, width: _Number, headers: np.ndarray, real: np.ndarray, box: dict[str, _Number], no_box: np.ndarray) -> np.ndarray:
    """Whether the tables c, which have no title, go on the tables p, as in tables.table_runs."""
    def apart(a: np.ndarray, o: np.ndarray) -> np.ndarray:
        x, y = box["x0"].v[a], box["x1"].v[o]
        known = ~(box["x0"].null[a] | box["x1"].null[o] | no_box[a] | no_box[o])
        return known & ~(~np.isnan(x) & (np.isnan(y) | (x < y)))

    overlap = ~(apart(p, c) | apart(c, p))
    next_page = ~page.null[c] & ~last.null[p] & (page.v[c] == last.v[p].astype(np.int64) + 1)
    same = real[c] & (headers[c] >= 0) & (headers[c] == headers[p])
    wp, wc = width.v[p], width.v[c]
    return (wp > 0) & (wc > 0) & np.where(same, (np.abs(wp - wc) <= 1) & (next_page | overlap), next_page & overlap & (wc <= wp))


def _written(b: pa.RecordBatch, rows: _Rows, kind: np.ndarray, group: np.ndarray, caption: np.ndarray, level: _Number) -> pa.RecordBatch:
    names = b.schema.names[: b.schema.names.index("_bits")]
    cols = {c: b.column(c) for c in names} | {"heading_level": pa.array(level.v, b.schema.field("heading_level").type, mask=level.null)}
    text = b.column("_body").take(pa.array(caption, pa.int64(), mask=caption < 0))
    whole = pa.StructArray.from_arrays([*cols.values(), text], [*cols, "_caption"])
    at = rows.at
    out = whole.take(pa.array(at, pa.int64())).flatten()
    new = np.concatenate([[True], rows.doc[1:] != rows.doc[:-1]])[: len(at)]
    order = rows.i - np.maximum.accumulate(np.where(new, rows.i, 0))
    parts = np.flatnonzero(group >= 0)
    parts = parts[np.argsort(group[parts], kind="stable")]
    sizes = np.where(kind[at] != SINGLE, np.bincount(group[parts], minlength=len(kind))[at], 0)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), whole.take(pa.array(parts, pa.int64())), mask=pa.array(kind[at] == SINGLE))
    return pa.RecordBatch.from_arrays([*out[:-1], pa.array(kind[at], pa.int32()), pa.array(order, pa.int32()), out[-1], lists], [*names, "_kind", "_ord", "_caption", "_parts"])


def placed(blocks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The blocks with ``_place``, their place in the document from 1; documents are together and in order in the partitions."""
    return blocks.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
