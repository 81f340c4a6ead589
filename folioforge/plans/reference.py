"""Queries for the document operators, with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import blocks as B
from folioforge.functions import text as T
from folioforge.operators import chunks as C
from folioforge.operators import clean as P
from folioforge.operators import document as D
from folioforge.operators import hierarchy as H
from folioforge.operators import index as I
from folioforge.operators import refine as R
from folioforge.operators import search as S
from folioforge.operators.tables import table_runs
from folioforge.plans.general import TREE as H_TREE
from folioforge.runtime import read_table, shared_dir
from folioforge.sources import canonical as J
from folioforge.sources import files as X
from folioforge.streaming import events as E

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- inputs -----------------------------------------------------------------------------------------------------------

#: White space in the SQL's regular expressions.
W = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{W}]+', ''), '[{W}]+$', '')"


def _line(x: str) -> str:
    return _strip(f"split_part({_strip(x)}, chr(10), 1)")


def _collapse(x: str) -> str:
    return f"regexp_replace({x}, '[{W}]+', ' ', 'g')"


def _named(x: str, names: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"{x} = '{n}' OR starts_with({x}, '{n}/')" for n in names) + ")"


def _level(x: str) -> str:
    line, rest = _line(x), f"[{W}]+[^{W}].+$"
    number, annex = rf"regexp_extract({line}, '^(\p{{Nd}}+(?:\.\p{{Nd}}+)*){rest}', 1)", rf"regexp_extract({line}, '^([A-Z](?:\.\p{{Nd}}+)+){rest}', 1)"
    dots = lambda n: f"length({n}) - length(replace({n}, '.', '')) + 1"
    return f"CASE WHEN {_named(_strip(f'lower({_collapse(line)})'), T.NAMED_SECTIONS)} THEN 1 WHEN {number} <> '' THEN {dots(number)} WHEN {annex} <> '' THEN {dots(annex)} END"


def _title(x: str) -> str:
    cut = rf"regexp_replace({_line(x)}, '[.…·{W}_\-]+\p{{Nd}}*[{W}]*$', '')"
    return _strip(f"lower({_collapse(cut)})")


_FIGURE = rf"'(?i)^(?:figure|fig\.|figura)[{W}]+(?:[A-Za-z](?:\.\p{{Nd}}+)+|\p{{Nd}})'"
_TABLE = rf"'(?i)^table[{W}]+[\p{{Nd}}.]+-?\p{{Nd}}*'"
_MARKER = rf"'^\p{{Nd}}+\)[{W}]*[^{W}]'"


def _label(x: str) -> str:
    line = _line(x)
    return f"({line} <> '' AND length({line}) <= 100 AND (regexp_matches({line}, {_MARKER}) OR (ends_with({line}, ':') AND length({line}) >= 2 AND length({line}) - length(replace({line}, ' ', '')) <= 12)))"


_BLOCKS = "b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block_key) AS rn FROM blocks) WHERE rn = 1)"
_SECTIONS = "s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section_key ORDER BY updated_at DESC, title DESC NULLS LAST) AS rn FROM sections) WHERE rn = 1)"
_CHUNKS = "c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_key) AS rn FROM chunks) WHERE rn = 1)"

#: Typed blocks made from order lines, in SQL that both engines read: a stand-in for parsed pages with every pattern.
SYNTHETIC = """
numbered AS (
  SELECT l_orderkey - l_orderkey % 8 AS doc, l_partkey % 13 AS k, l_suppkey % 5 AS s, l_quantity AS q, l_discount AS d,
    row_number() OVER (PARTITION BY l_orderkey - l_orderkey % 8 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS ord
  FROM lineitem),
syn AS (
  SELECT concat('doc_', doc) AS doc_id, CAST(ord AS INT) AS ord, concat('b', ord) AS block_id, CAST(doc * 1000 + ord AS BIGINT) AS block_key,
    CASE WHEN k IN (0, 1, 2, 10) THEN 'heading' WHEN k IN (4, 11) THEN 'image' WHEN k IN (5, 12) THEN 'table' WHEN k = 7 THEN 'list_item' WHEN k = 8 THEN 'code' ELSE 'paragraph' END AS block_type,
    CASE k WHEN 0 THEN concat(CAST(s + 1 AS INT), CASE WHEN s % 2 = 0 THEN '.2 Scope of part' ELSE ' Overview' END) WHEN 1 THEN CASE WHEN s < 3 THEN 'Contents ..... 3' ELSE 'Foreword' END
      WHEN 2 THEN CASE WHEN s < 2 THEN 'Annex B (informative)' ELSE 'Copyright notice' END WHEN 3 THEN concat('Figure 4.', CAST(s AS INT), '-1 Layout') WHEN 6 THEN concat('Table 5.', CAST(s AS INT), '-2 Values')
      WHEN 7 THEN CASE WHEN s = 0 THEN 'Parts:' ELSE concat('item ', CAST(s AS INT)) END WHEN 8 THEN CASE WHEN s < 2 THEN '@startuml' WHEN s = 2 THEN '@enduml' ELSE 'UE -> RIC: report' END
      WHEN 9 THEN CASE WHEN s < 2 THEN 'participant RIC' WHEN s = 2 THEN 'All rights reserved' ELSE 'Plain words about a cell.' END WHEN 10 THEN '1) Non-RT part:' END AS text,
    CASE WHEN k = 0 THEN CAST(1 + s % 3 AS INT) WHEN k = 1 THEN CAST(1 + s % 2 AS INT) WHEN k IN (2, 10) THEN 1 END AS heading_level,
    CAST(1 + floor(ord / 2.0) AS INT) AS page, 50.0 + (CAST(q AS INT) % 4) * 12 AS x0, 100.0 AS y0, 300.0 + (CAST(q AS INT) % 2) * 20 AS x1, 200.0 + CAST(d * 100 AS INT) AS y1,
    CASE WHEN k IN (5, 12) THEN CAST(s % 4 AS INT) END AS tkind
  FROM numbered)
"""


def synthetic_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks made from order lines, with the nested columns of the blocks table."""
    read_table(spark, sf_dir, "lineitem").withColumn("doc_id", F.expr("concat('doc_', l_orderkey - l_orderkey % 8)")).createOrReplaceTempView("lineitem")
    # rows are numbered by the id itself, so that what follows by doc_id needs no second shuffle
    by_id = SYNTHETIC.replace("PARTITION BY l_orderkey - l_orderkey % 8", "PARTITION BY doc_id").replace("SELECT l_orderkey - l_orderkey % 8 AS doc,", "SELECT doc_id, l_orderkey - l_orderkey % 8 AS doc,").replace("concat('doc_', doc) AS doc_id", "doc_id")
    flat = spark.sql(f"WITH {by_id} SELECT * FROM syn")
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    headers = F.when(F.col("tkind").isin(0, 3), words("A", "B", "C")).when(F.col("tkind") == 1, words("0", "1", "2")).otherwise(words("A", "B"))
    rows = F.when(F.col("tkind") == 2, F.array(words("1", "2"))).otherwise(F.array(words("1", "2", "3")))
    table = F.when(F.col("tkind").isNotNull(), F.struct(headers.alias("headers"), rows.alias("body_rows"), F.when(F.col("tkind") == 3, "Table 9.1-1 Own").alias("caption")))
    image = F.when(F.col("block_type") == "image", F.struct(F.lit(None).cast("string").alias("uri"), F.lit("alt").alias("alt"), F.lit(None).cast("string").alias("caption")))
    box = F.struct("x0", "y0", "x1", "y1", F.lit("BOTTOMLEFT").alias("coord_origin"))
    span = "array<struct<page:int,bbox:struct<x0:double,y0:double,x1:double,y1:double,coord_origin:string>,source_ref:string>>"
    return flat.select(
        "block_key", "doc_id", "block_id", "block_type", "ord", "page", "text", "heading_level", table.alias("table_data"), image.alias("image"),
        box.cast("struct<x0:double,y0:double,x1:double,y1:double,coord_origin:string>").alias("bbox"), F.lit(None).cast("string").alias("source_ref"), F.create_map().cast("map<string,string>").alias("metadata"), F.array().cast(span).alias("layout_spans"),
    )


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.distinct_blocks(read_table(spark, sf_dir, "blocks"))


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each section."""
    rows = read_table(spark, sf_dir, "sections").where("section_key is not null")
    cols = [c for c in rows.columns if c not in ("section_key", "metadata")]
    last = rows.groupBy("section_key").agg(F.max(F.struct("updated_at", "title", *[c for c in cols if c not in ("updated_at", "title")])).alias("r"))
    return last.select("section_key", *[F.col(f"r.{c}").alias(c) for c in cols])


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "chunks").where("chunk_key is not null").dropDuplicates(["chunk_key"])


# --- scalar rules -----------------------------------------------------------------------------------------------------


@query(f"WITH {_BLOCKS} SELECT block_key, {_strip(_collapse(r'''regexp_replace(lower(text), '\p{Nd}+', '', 'g')'''))} AS norm FROM b")
def normalized_texts(spark, sf_dir):
    return _blocks(spark, sf_dir).select("block_key", T.normalize_text(F.col("text")).alias("norm"))


@query(f"WITH {_SECTIONS} SELECT section_key, {_title('title')} AS norm, {_named(_title('title'), T.REMOVABLE_SECTIONS)} AS removable, {_level('title')} AS level FROM s WHERE title IS NOT NULL")
def section_titles(spark, sf_dir):
    t = F.col("title")
    return _sections(spark, sf_dir).where("title is not null").select("section_key", T.normalize_section_title(t).alias("norm"), T.is_removable_section(t).alias("removable"), T.heading_level(t).alias("level"))


@query(f"""WITH {_BLOCKS} SELECT block_key, {_level('text')} AS level, regexp_matches({_line('text')}, {_FIGURE}) AS figure_caption, regexp_matches({_strip('text')}, {_TABLE}) AS table_caption,
  regexp_matches({_line('text')}, {_MARKER}) AS marker, {_label('text')} AS label, regexp_matches(lower(text), '{T.BOILERPLATE}') AS boilerplate FROM b WHERE text IS NOT NULL""")
def text_rules(spark, sf_dir):
    t = F.col("text")
    rules = {"level": T.heading_level(t), "figure_caption": T.is_figure_caption(t), "table_caption": T.is_table_caption(t), "marker": T.is_list_marker(t), "label": T.is_list_label(t), "boilerplate": T.is_boilerplate(t)}
    return _blocks(spark, sf_dir).where("text is not null").select("block_key", *[c.alias(n) for n, c in rules.items()])


_ID = r"regexp_extract(regexp_replace(split_part(source_path, '/', -1), '(.)\.[^.]*$', '\1'), '(?i)^O-RAN\.(WG[0-9]+|[A-Za-z]+FG)((?:\.[A-Za-z0-9-]+)+)-v([0-9]{2}\.[0-9]{2})$', %d)"
_BODY = rf"regexp_replace({_ID % 2}, '(?i)-R[0-9]+$', '')"


@query(f"""SELECT doc_id, CASE WHEN {_ID % 3} <> '' THEN 'oran_default' ELSE 'default' END AS profile, nullif({_ID % 1}, '') AS doc_group, nullif(lower(split_part({_BODY}, '.', 2)), '') AS doc_type,
  nullif({_ID % 3}, '') AS doc_version, nullif(regexp_extract({_ID % 2}, '(?i)-R([0-9]+)$', 1), '') AS release_no,
  nullif(CASE WHEN len(string_split({_BODY}, '.')) > 2 THEN array_to_string(list_slice(string_split({_BODY}, '.'), 3, 99), '-') ELSE split_part({_BODY}, '.', 2) END, '') AS subject FROM doc_registry""")
def document_identities(spark, sf_dir):
    ids = T.document_identity(F.col("source_path"))
    return read_table(spark, sf_dir, "doc_registry").select("doc_id", T.profile_id(ids).alias("profile"), *[ids[n].alias(n) for n in ("doc_group", "doc_type", "doc_version", "release_no", "subject")])


@query(rf"""WITH {_SECTIONS} SELECT section_key, concat('sec_', lpad(CAST(ord AS VARCHAR), CAST(greatest(4, length(CAST(ord AS VARCHAR))) AS INT), '0'), '_', CASE WHEN coalesce(slug, '') = '' THEN 'section' ELSE slug END) AS made_id FROM
  (SELECT *, substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) AS slug FROM s)""")
def section_ids(spark, sf_dir):
    return _sections(spark, sf_dir).select("section_key", T.section_id(F.col("ord"), F.col("title")).alias("made_id"))


@query(f"""WITH {_BLOCKS}, spans AS (SELECT *, list_distinct(list_filter(list_transform(layout_spans, lambda x: x.page), lambda p: p IS NOT NULL)) AS known, coalesce(TRY_CAST(metadata['page_end'] AS INT), page) AS pe FROM b)
  SELECT block_key, CASE WHEN len(known) > 0 THEN list_max(known) WHEN page IS NOT NULL THEN greatest(page, pe) END AS last_page, CASE WHEN len(known) > 0 THEN len(known) WHEN page IS NOT NULL THEN abs(pe - page) + 1 ELSE 0 END AS n_pages FROM spans""")
def block_pages(spark, sf_dir):
    pages = B.page_numbers(F.col("layout_spans"), F.col("page"), F.element_at("metadata", "page_end"))
    return _blocks(spark, sf_dir).select("block_key", F.array_max(pages).alias("last_page"), F.size(pages).alias("n_pages"))


_HOLD = r"list_bool_and(list_transform(table_data.headers, lambda h, i: trim(h) = '' OR coalesce(TRY_CAST(regexp_extract(trim(h), '^[0-9]+$') AS INT) = i - 1, false) OR regexp_matches(lower(trim(h)), '^col[0-9]+$')))"


@query(f"""WITH {_BLOCKS} SELECT block_key, CASE WHEN len(table_data.headers) > 0 THEN {_HOLD} ELSE true END AS placeholder,
  CASE WHEN len(table_data.headers) > 0 AND NOT {_HOLD} THEN len(table_data.headers) WHEN len(table_data.body_rows) > 0 THEN list_max(list_transform(table_data.body_rows, lambda r: len(r))) ELSE coalesce(len(table_data.headers), 0) END AS n_columns
  FROM b WHERE block_type = 'table' AND table_data IS NOT NULL""")
def table_shapes(spark, sf_dir):
    t = F.col("table_data")
    return _blocks(spark, sf_dir).where("block_type = 'table' and table_data is not null").select("block_key", B.placeholder_headers(t["headers"]).alias("placeholder"), B.column_count(t).alias("n_columns"))


_CELLS = lambda r: f"array_to_string(list_transform({r}, lambda c: {_strip('coalesce(c, $$$$)')}), ' | ')"


@query(f"""WITH {_BLOCKS} SELECT block_key, CASE WHEN block_type = 'table' THEN CASE WHEN table_data IS NULL THEN '' ELSE array_to_string(list_filter(list_concat([coalesce({_strip('table_data.caption')}, '')],
    [CASE WHEN len(table_data.headers) > 0 THEN {_CELLS('table_data.headers')} ELSE '' END], coalesce(list_transform(table_data.body_rows, lambda r: {_CELLS('r')}), [])), lambda x: x <> ''), chr(10)) END
  WHEN block_type = 'image' THEN CASE WHEN coalesce({_strip('image.caption')}, '') <> '' THEN {_strip('image.caption')} ELSE coalesce({_strip('image.alt')}, '') END ELSE {_strip("coalesce(text, '')")} END AS plain FROM b""")
def plain_texts(spark, sf_dir):
    return _blocks(spark, sf_dir).select("block_key", B.render(*[F.col(c) for c in C._PARTS], fmt="plain").alias("plain"))


@query(f"""WITH {_BLOCKS}, t AS (SELECT *, {_strip("coalesce(text, '')")} AS body FROM b WHERE block_type NOT IN ('table', 'image'))
  SELECT block_key, CASE WHEN body = '' THEN '' WHEN block_type = 'heading' THEN concat(repeat('#', least(greatest(1, coalesce(heading_level, 1)), 6)), ' ', body) WHEN block_type = 'list_item' THEN concat(repeat('  ', greatest(1, coalesce(heading_level, 1)) - 1), '- ', body)
    WHEN block_type = 'code' THEN concat('```', trim(coalesce(metadata['language'], '')), chr(10), body, chr(10), '```') WHEN block_type = 'formula' THEN concat('$$', chr(10), body, chr(10), '$$') ELSE body END AS markdown FROM t""")
def markdown_texts(spark, sf_dir):
    return _blocks(spark, sf_dir).where("block_type not in ('table', 'image')").select("block_key", B.render(*[F.col(c) for c in C._PARTS]).alias("markdown"))


def _pad(row: str, width: str) -> str:
    return f"list_slice(list_concat({row}, list_transform(range(greatest({width} - len({row}), 0)), lambda i: '')), 1, {width})"


_ROW = lambda cells: f"concat('| ', array_to_string({cells}, ' | '), ' |')"
_TRIM = lambda r: f"list_transform({r}, lambda c: {_strip('coalesce(c, $$$$)')})"
_WIDTH = "CASE WHEN len(table_data.headers) > 0 THEN len(table_data.headers) ELSE coalesce(list_max(list_transform(table_data.body_rows, lambda r: len(r))), 0) END"
_MD_TABLE = f"""CASE WHEN table_data IS NULL THEN '' ELSE array_to_string(list_concat(CASE WHEN coalesce(table_data.caption, '') <> '' THEN [concat('**', {_strip('table_data.caption')}, '**')] ELSE [] END,
  CASE WHEN len(table_data.headers) > 0 THEN [{_ROW(_TRIM('table_data.headers'))}, {_ROW("list_transform(table_data.headers, lambda h: '---')")}] ELSE [] END,
  coalesce(list_transform(table_data.body_rows, lambda r: {_ROW(_pad(_TRIM('r'), _WIDTH))}), [])), chr(10)) END"""
_PLAIN_IMAGE = f"CASE WHEN coalesce({_strip('image.caption')}, '') <> '' THEN {_strip('image.caption')} ELSE coalesce({_strip('image.alt')}, '') END"
_MD_IMAGE = f"CASE WHEN {_PLAIN_IMAGE} = '' THEN '' WHEN coalesce(image.uri, '') <> '' THEN concat('![', {_PLAIN_IMAGE}, '](', image.uri, ')') ELSE {_PLAIN_IMAGE} END"
_MD = f"""CASE WHEN block_type = 'table' THEN {_MD_TABLE} WHEN block_type = 'image' THEN {_MD_IMAGE} WHEN body = '' THEN '' WHEN block_type = 'heading' THEN concat(repeat('#', least(greatest(1, coalesce(heading_level, 1)), 6)), ' ', body)
  WHEN block_type = 'list_item' THEN concat(repeat('  ', greatest(1, coalesce(heading_level, 1)) - 1), '- ', body) WHEN block_type = 'code' THEN concat('```', trim(coalesce(metadata['language'], '')), chr(10), body, chr(10), '```')
  WHEN block_type = 'formula' THEN concat('$$', chr(10), body, chr(10), '$$') ELSE body END"""
_RENDERED = f"t AS (SELECT *, {_strip("coalesce(text, '')")} AS body FROM b), md AS (SELECT *, {_MD} AS markdown FROM t)"


@query(f"WITH {_BLOCKS}, {_RENDERED} SELECT block_key, markdown FROM md WHERE block_type IN ('table', 'image')")
def markdown_tables(spark, sf_dir):
    return _blocks(spark, sf_dir).where("block_type in ('table', 'image')").select("block_key", B.render(*[F.col(c) for c in C._PARTS]).alias("markdown"))


# --- ordered operators ------------------------------------------------------------------------------------------------

_TYPED = f"""typed AS (SELECT *, {_strip("coalesce(text, '')")} AS body, {_level(_strip("coalesce(text, '')"))} AS lvl FROM %s),
low AS (SELECT *, {_strip(f"lower({_collapse(_line('body'))})")} AS ln FROM typed),
kept AS (SELECT *, block_type = 'heading' AND ln <> '' AND NOT regexp_matches(ln, {_FIGURE}) AND (ln = 'additional information' OR starts_with(ln, 'annex')) AS keep FROM low),
refined AS (SELECT * EXCLUDE (block_type, heading_level), CASE WHEN lvl IS NOT NULL OR keep THEN 'heading' WHEN block_type = 'heading' AND body <> '' AND (regexp_matches({_line('body')}, {_MARKER}) OR {_label('body')}) THEN 'list_item' WHEN block_type = 'heading' THEN 'paragraph' ELSE block_type END AS block_type,
  CASE WHEN lvl IS NOT NULL THEN lvl WHEN keep THEN coalesce(nullif(heading_level, 0), 1) WHEN block_type = 'heading' THEN NULL ELSE heading_level END AS heading_level FROM kept)"""


@query(f"WITH {_BLOCKS}, {_TYPED % 'b'} SELECT block_key, block_type, heading_level FROM refined")
def refined_types(spark, sf_dir):
    return R.refine_types(_blocks(spark, sf_dir)).select("block_key", "block_type", "heading_level")


@query(f"WITH {SYNTHETIC}, {_TYPED % 'syn'} SELECT block_key, block_type, heading_level FROM refined")
def refined_types_synthetic(spark, sf_dir):
    return R.refine_types(synthetic_blocks(spark, sf_dir)).select("block_key", "block_type", "heading_level")


@query(f"""WITH {_BLOCKS}, runs AS (SELECT *, sum(CASE WHEN block_type = 'list_item' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord, block_id) AS run FROM b), m AS (SELECT *, min(bbox.x0) OVER (PARTITION BY doc_id, run) AS x FROM runs WHERE block_type = 'list_item')
  SELECT block_key, CASE WHEN coalesce({_label("coalesce(text, '')")}, false) OR bbox.x0 IS NULL OR bbox.x0 <= x + 10 THEN 1 WHEN bbox.x0 <= x + 35 THEN 2 ELSE 3 END AS level FROM m""")
def list_levels(spark, sf_dir):
    return R.assign_list_levels(_blocks(spark, sf_dir)).where("block_type = 'list_item'").select("block_key", F.col("heading_level").alias("level"))


@query(f"""WITH {SYNTHETIC}, f AS (SELECT *, block_type = 'heading' AS h, coalesce(heading_level, 1) AS lv, block_type = 'heading' AND {_named(_title("coalesce(text, '')"), T.REMOVABLE_SECTIONS)} AS rm FROM syn),
  g AS (SELECT *, sum(CASE WHEN rm THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS grp, last_value(CASE WHEN rm THEN lv END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rl FROM f),
  e AS (SELECT *, max(CASE WHEN h AND NOT rm AND lv <= rl THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, grp ORDER BY ord) AS ended FROM g) SELECT block_key FROM e WHERE grp = 0 OR ended = 1""")
def removable_dropped(spark, sf_dir):
    return R.drop_removable_sections(synthetic_blocks(spark, sf_dir)).select("block_key")


@query(f"WITH {SYNTHETIC} SELECT block_key FROM syn WHERE NOT coalesce(page = 1 AND text <> '' AND regexp_matches(lower(text), '{T.BOILERPLATE}'), false)")
def cover_boilerplate_dropped(spark, sf_dir):
    return R.drop_cover_boilerplate(synthetic_blocks(spark, sf_dir)).select("block_key")


def _iou(o: str) -> str:
    inter = f"greatest(0, least(x1, {o}.x1) - greatest(x0, {o}.x0)) * greatest(0, least(y1, {o}.y1) - greatest(y0, {o}.y0))"
    return f"coalesce({o}.t AND page = {o}.page AND {inter} / nullif((x1 - x0) * (y1 - y0) + ({o}.x1 - {o}.x0) * ({o}.y1 - {o}.y0) - {inter}, 0) >= 0.5, false)"


@query(f"""WITH {SYNTHETIC}, n AS (SELECT *, lag({{'t': block_type = 'table', 'page': page, 'x0': x0, 'x1': x1, 'y0': y0, 'y1': y1}}) OVER w AS p, lead({{'t': block_type = 'table', 'page': page, 'x0': x0, 'x1': x1, 'y0': y0, 'y1': y1}}) OVER w AS q FROM syn WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
  SELECT block_key FROM n WHERE NOT (block_type = 'image' AND ({_iou('p')} OR {_iou('q')}))""")
def images_on_tables_dropped(spark, sf_dir):
    return R.drop_images_on_tables(synthetic_blocks(spark, sf_dir)).select("block_key")


@query(f"""WITH {SYNTHETIC}, f AS (SELECT *, block_type IN ('code', 'paragraph') AND (text IN ('@startuml', '@enduml', 'UE -> RIC: report', 'participant RIC')) AS part, block_type = 'code' AND text = '@startuml' AS st, block_type = 'code' AND text = '@enduml' AS en FROM syn),
  m AS (SELECT *, max(CASE WHEN st THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord) AS s, max(CASE WHEN NOT part THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord) AS x, max(CASE WHEN en THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e,
    first_value(CASE WHEN NOT (part AND NOT st AND NOT en) THEN st END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx FROM f),
  c AS (SELECT *, (s IS NOT NULL AND s > coalesce(e, -1) AND s > coalesce(x, -1)) OR (part AND NOT st AND NOT en AND coalesce(nx, false)) AS covered FROM m),
  i AS (SELECT *, sum(CASE WHEN covered THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS island FROM c)
  SELECT doc_id, min(ord) AS first_ord, count(*) AS n_parts, string_agg(text, chr(10) ORDER BY ord) AS text FROM i WHERE covered GROUP BY doc_id, island""")
def diagrams_merged(spark, sf_dir):
    merged = R.merge_diagrams(synthetic_blocks(spark, sf_dir)).where("metadata['language'] = 'plantuml'")
    return merged.select("doc_id", F.col("ord").alias("first_ord"), F.coalesce(F.col("metadata")["merged_parts"].cast("bigint"), F.lit(1)).alias("n_parts"), "text")


@query(f"""WITH {SYNTHETIC}, f AS (SELECT *, block_type = 'image' AS im, block_type IN ('paragraph', 'heading') AND coalesce(regexp_matches(text, {_FIGURE}), false) AS cp FROM syn),
  n AS (SELECT *, coalesce(lead(cp) OVER w, false) AS c1, coalesce(lag(cp) OVER w, false) AS cm1, coalesce(lag(cp, 3) OVER w, false) AS cm3, coalesce(lead(im, 2) OVER w, false) AS i2, coalesce(lag(im, 2) OVER w, false) AS im2, coalesce(lag(im, 4) OVER w, false) AS im4 FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
  SELECT block_key, CASE WHEN c1 AND NOT i2 THEN 1 WHEN cm1 AND NOT im2 THEN -1 WHEN c1 THEN 1 WHEN cm1 AND cm3 AND NOT im4 THEN -1 END AS choice FROM n WHERE im""")
def figure_caption_choices(spark, sf_dir):
    return R.figure_caption_choice(synthetic_blocks(spark, sf_dir)).where("block_type = 'image'").select("block_key", "choice")


@query(f"""WITH {SYNTHETIC}, f AS (SELECT *, block_type = 'image' AS im, block_type IN ('paragraph', 'heading') AND coalesce(regexp_matches(text, {_FIGURE}), false) AS cp FROM syn),
  n AS (SELECT *, coalesce(lead(cp) OVER w, false) AS c1, coalesce(lag(cp) OVER w, false) AS cm1, coalesce(lag(cp, 3) OVER w, false) AS cm3, coalesce(lead(im, 2) OVER w, false) AS i2, coalesce(lag(im, 2) OVER w, false) AS im2, coalesce(lag(im, 4) OVER w, false) AS im4, lead(text) OVER w AS dn, lag(text) OVER w AS up FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
  c AS (SELECT *, CASE WHEN im THEN CASE WHEN c1 AND NOT i2 THEN 1 WHEN cm1 AND NOT im2 THEN -1 WHEN c1 THEN 1 WHEN cm1 AND cm3 AND NOT im4 THEN -1 END END AS choice FROM n),
  t AS (SELECT *, coalesce(lag(choice) OVER w, 0) = 1 OR coalesce(lead(choice) OVER w, 0) = -1 AS taken FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY ord))
  SELECT block_key, block_type, CASE choice WHEN 1 THEN dn WHEN -1 THEN up END AS caption FROM t WHERE NOT (cp AND taken)""")
def figure_captions_attached(spark, sf_dir):
    return R.attach_figure_captions(synthetic_blocks(spark, sf_dir)).select("block_key", "block_type", F.col("image.caption").alias("caption"))


_RUNS = f"""f AS (SELECT *, block_type IN ('paragraph', 'heading') AND coalesce(regexp_matches(text, {_TABLE}), false) AS cp, block_type = 'table' AS tb, CASE WHEN tkind = 2 THEN 2 ELSE 3 END AS nc FROM syn),
  p AS (SELECT *, last_value(CASE WHEN NOT cp THEN ord END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS po FROM f),
  j AS (SELECT a.*, o.tb AS ptb, o.tkind AS pk, o.nc AS pn, o.page AS pp, o.x0 AS px0, o.x1 AS px1 FROM p a LEFT JOIN p o ON o.doc_id = a.doc_id AND o.ord = a.po),
  r AS (SELECT *, coalesce(tb AND ptb AND NOT (po < ord - 1 AND pk = 3) AND tkind <> 3 AND
    CASE WHEN tkind <> 1 AND pk <> 1 AND nc = pn THEN page = pp + 1 OR (px0 < x1 AND x0 < px1) ELSE page = pp + 1 AND px0 < x1 AND x0 < px1 AND nc <= pn END, false) AS part FROM j),
  h AS (SELECT *, max(CASE WHEN tb AND NOT part THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord) AS head FROM r)"""


@query(f"WITH {SYNTHETIC}, {_RUNS} SELECT block_key, head FROM h WHERE tb")
def table_runs_found(spark, sf_dir):
    return table_runs(R.with_position(synthetic_blocks(spark, sf_dir))).where("block_type = 'table'").select("block_key", "head")


_CAPTIONS = f"""n AS (SELECT * EXCLUDE (head), CASE WHEN tb THEN head END AS head, lead(CASE WHEN cp THEN text END) OVER w AS nx, lag(CASE WHEN cp THEN text END) OVER w AS pv FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
  g AS (SELECT doc_id, head, max(ord) AS last, arg_max(coalesce(nx, ''), ord) AS cl, arg_min(coalesce(nx, ''), ord) AS cf, arg_min(tkind, ord) <> 3 AS bare FROM n WHERE head IS NOT NULL GROUP BY doc_id, head),
  x AS (SELECT n.*, g.last, g.cl, g.cf, g.bare, coalesce(g.bare AND (n.head = n.ord OR (g.last = n.ord AND g.cf = '')), false) AS takes FROM n LEFT JOIN g ON g.doc_id = n.doc_id AND g.head = n.head),
  y AS (SELECT *, coalesce(lag(takes, 2) OVER w, false) AS lft FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
  z AS (SELECT *, CASE WHEN head = ord AND bare THEN CASE WHEN cf <> '' THEN ord + 1 WHEN cl <> '' THEN last + 1 WHEN pv IS NOT NULL AND NOT lft THEN ord - 1 END END AS place, CASE WHEN cf <> '' THEN cf WHEN cl <> '' THEN cl ELSE pv END AS txt FROM y)"""


@query(f"""WITH {SYNTHETIC}, {_RUNS}, {_CAPTIONS}
  SELECT block_key, block_type, CASE WHEN place IS NOT NULL THEN txt WHEN tkind = 3 THEN 'Table 9.1-1 Own' END AS caption FROM z LEFT JOIN (SELECT DISTINCT doc_id, place AS gone FROM z WHERE place IS NOT NULL) o ON o.doc_id = z.doc_id AND o.gone = z.ord WHERE o.gone IS NULL""")
def table_captions_attached(spark, sf_dir):
    return R.attach_table_captions(synthetic_blocks(spark, sf_dir)).select("block_key", "block_type", F.col("table_data.caption").alias("caption"))


def _merge_sql(parts: str) -> str:
    """SQL that merges tables: ``parts`` is a relation part(grp, n, headers, body_rows, caption), n counting the parts of a table from 1.

    A recursive step per part; cells are filled down by a window over unrolled cells.
    """
    cells = lambda x: f"list_transform(coalesce({x}, []), lambda c: coalesce(c, ''))"
    label = lambda x: f"lower({_strip(x)})"
    both = lambda a, b: f"list_filter(list_transform(range(len({a})), lambda i: [{label(f'{a}[i + 1]')}, {label(f'{b}[i + 1]')}]), lambda p: p[1] <> '' AND p[2] <> '')"
    drift = lambda a, b: f"(len({a}) > 0 AND len({a}) = len({b}) AND len({both(a, b)}) >= greatest(1, len({a}) // 2) AND coalesce(list_bool_and(list_transform({both(a, b)}, lambda p: starts_with(p[1], p[2]) OR starts_with(p[2], p[1]))), true))"
    held = r"(CASE WHEN len(h) = 0 THEN true ELSE list_bool_and(list_transform(h, lambda x, i: %s = '' OR coalesce(TRY_CAST(regexp_extract(%s, '^[0-9]+$') AS INT) = i - 1, false) OR regexp_matches(lower(%s), '^col[0-9]+$'))) END)" % ((_strip("x"),) * 3)
    running = f"list_filter(range(1, len(last) + 1), lambda i: length({_strip('last[i]')}) >= 20 AND NOT contains('.!?;:', right({_strip('last[i]')}, 1)))"
    pieces = f"list_filter(list_transform(coalesce(given[1], []), lambda c: {_strip('c')}), lambda c: c <> '')"
    return f"""{parts}, clean AS (SELECT grp, n, {cells('headers')} AS h, list_transform(coalesce(body_rows, []), lambda r: {cells('r')}) AS r, caption FROM part),
  real_ AS (SELECT *, NOT {held} AS real FROM clean),
  merged AS (
    SELECT grp, n, w, head, list_transform(r, lambda x: list_resize(x, w, '')) AS rows, caption AS cap FROM (SELECT *, CASE WHEN real THEN h ELSE list_transform(range(w), lambda i: concat('col', i)) END AS head FROM (SELECT *, CASE WHEN real OR len(r) = 0 THEN len(h) ELSE list_max(list_transform(r, lambda x: len(x))) END AS w FROM real_ WHERE n = 1))
    UNION ALL
    SELECT grp, n, w, CASE WHEN drifted THEN h ELSE head END, CASE WHEN goes_on THEN rows[1:len(rows) - 1] || [list_transform(last, lambda c, i: CASE WHEN list_position(slots, i) > 0 THEN {_strip("concat(rtrim(c), ' ', pieces[list_position(slots, i)])")} ELSE c END)] || given[2:] ELSE rows || given END,
      CASE WHEN coalesce(note, '') = '' THEN cap WHEN coalesce(cap, '') = '' THEN note WHEN NOT regexp_matches({_strip('note')}, '(?i)^table[{W}]+[\\p{{Nd}}.]+') AND NOT contains(cap, note) THEN {_strip(f"concat(cap, ' ', {_strip('note')})")} ELSE cap END
    FROM (SELECT *, CASE WHEN len(open_) >= len(pieces) THEN open_[len(open_) - len(pieces) + 1:] ELSE range(w - len(pieces) + 1, w + 1) END AS slots,
        last IS NOT NULL AND len(given) BETWEEN 1 AND 2 AND len(pieces) > 0 AND len(pieces) < w AND len(open_) > 0 AS goes_on
      FROM (SELECT *, {pieces} AS pieces, coalesce({running}, []) AS open_
        FROM (SELECT *, CASE WHEN list_bool_or(list_transform(data, lambda x: len(x) < w)) THEN list_transform(data, lambda x: (list_transform(range(greatest(w - len(x), 0)), lambda i: '') || x)[1:w]) ELSE list_transform(data, lambda x: list_resize(x, w, '')) END AS given
          FROM (SELECT m.grp, p.n, m.w, m.head, m.rows, m.cap, m.rows[len(m.rows)] AS last, p.h, p.caption AS note, {drift('m.head', 'p.h')} AS drifted,
              CASE WHEN NOT p.real THEN p.r WHEN p.h = m.head THEN CASE WHEN p.r[1] = p.h THEN p.r[2:] ELSE p.r END WHEN {drift('m.head', 'p.h')} THEN p.r ELSE [p.h] || p.r END AS data
            FROM merged m JOIN real_ p ON p.grp = m.grp AND p.n = m.n + 1))))),
  whole AS (SELECT * FROM merged WHERE n = (SELECT max(n) FROM real_ x WHERE x.grp = merged.grp)),
  lines AS (SELECT grp, unnest(rows) AS row_, generate_subscripts(rows, 1) AS i FROM whole),
  own AS (SELECT grp, i, unnest(row_) AS c, generate_subscripts(row_, 1) AS j, coalesce(list_position(list_transform(row_, lambda x: {_strip('x')} <> ''), true), len(row_) + 1) AS first_ FROM lines),
  full_ AS (SELECT grp, i, j, coalesce(last_value(CASE WHEN j >= first_ THEN c END IGNORE NULLS) OVER (PARTITION BY grp, j ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS c FROM own),
  texts AS (SELECT grp, string_agg(coalesce(line, ''), chr(10) ORDER BY i) AS body FROM lines LEFT JOIN (SELECT grp, i, string_agg(c, '|' ORDER BY j) AS line FROM full_ GROUP BY grp, i) USING (grp, i) GROUP BY grp)"""


def _table_text(table: str) -> list:
    """A table's members as text: headers, rows line by line, caption."""
    rows = F.array_join(F.transform(F.col(f"{table}.body_rows"), lambda r: F.array_join(r, "|")), "\n")
    return [F.array_join(F.col(f"{table}.headers"), "|").alias("headers"), rows.alias("body"), F.col(f"{table}.caption").alias("caption")]


#: Parts of tables made from order lines, with every kind of header, row and caption, in SQL that both engines read.
PARTS = """
lined AS (SELECT l_orderkey AS grp, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, l_partkey % 11 AS h, l_suppkey % 7 AS r, l_partkey % 5 AS c, l_suppkey % 3 AS k FROM lineitem),
part_src AS (SELECT grp, n, h, r, c, k, CASE h WHEN 0 THEN 'A|B|C' WHEN 1 THEN 'A|B|C' WHEN 2 THEN 'a|B' WHEN 3 THEN '0|1|2' WHEN 4 THEN 'col0||x' WHEN 6 THEN 'Name long|Value|Unit' WHEN 7 THEN 'Name|Value|Unit' WHEN 8 THEN 'A|B|Cell' WHEN 9 THEN 'X|Y|Z' WHEN 10 THEN ' a | B |c' END AS heads,
    CASE r WHEN 0 THEN '1|2|3' WHEN 1 THEN '|4|5;6|7' WHEN 2 THEN 'A|B|C;8|9|0' WHEN 3 THEN 'a cell whose text runs on over the page and|x|another cell that runs on over the page' WHEN 4 THEN '|tail' WHEN 5 THEN 'p;q|r|s|t' END AS lines,
    CASE c WHEN 0 THEN 'Table 1 x' WHEN 1 THEN 'NOTE: y' WHEN 2 THEN ' NOTE: z ' WHEN 3 THEN '' END AS caption FROM lined)
"""


@query(f"""WITH RECURSIVE {PARTS}, {_merge_sql("part AS (SELECT grp, n, string_split(heads, '|') AS headers, list_transform(string_split(lines, ';'), lambda x: string_split(x, '|')) AS body_rows, caption FROM part_src)")}
  SELECT w.grp AS order_key, array_to_string(head, '|') AS headers, coalesce(body, '') AS body, cap AS caption FROM whole w LEFT JOIN texts USING (grp)""")
def table_parts_merged(spark, sf_dir):
    """Tables put together from parts of every kind."""
    from folioforge.operators.tables import merge_parts

    read_table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    flat = spark.sql(f"WITH {PARTS} SELECT * FROM part_src")
    rows = F.transform(F.split("lines", ";"), lambda x: F.split(x, "[|]"))
    part = F.struct("n", F.struct(F.split("heads", "[|]").alias("headers"), rows.alias("body_rows"), "caption").alias("t"))
    parts = flat.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["t"]).alias("parts"))
    return parts.select(F.col("grp").alias("order_key"), merge_parts(F.col("parts")).alias("t")).select("order_key", *_table_text("t"))


#: Captions of the tables after captions have been attached, and whether a block is gone by that (see table_captions_attached).
_CAPTIONED = """, cz AS (SELECT z.*, CASE WHEN place IS NOT NULL THEN txt WHEN tkind = 3 THEN 'Table 9.1-1 Own' END AS caption FROM z LEFT JOIN (SELECT DISTINCT doc_id, place AS gone FROM z WHERE place IS NOT NULL) o ON o.doc_id = z.doc_id AND o.gone = z.ord WHERE o.gone IS NULL)"""


@query(f"""WITH RECURSIVE {SYNTHETIC}, {_RUNS}, {_CAPTIONS}{_CAPTIONED},
  f2 AS (SELECT doc_id, block_key, ord, tkind, x0, x1, page, caption, tb, block_type IN ('paragraph', 'heading') AND coalesce(regexp_matches(text, {_TABLE}), false) AS cp, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS pos, CASE WHEN tkind = 2 THEN 2 ELSE 3 END AS nc FROM cz),
  p2 AS (SELECT *, last_value(CASE WHEN NOT cp THEN pos END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS po FROM f2),
  j2 AS (SELECT a.*, o.tb AS ptb, o.tkind AS pk, o.nc AS pn, o.page AS pp, o.x0 AS px0, o.x1 AS px1, o.caption AS pc FROM p2 a LEFT JOIN p2 o ON o.doc_id = a.doc_id AND o.pos = a.po),
  r2 AS (SELECT *, coalesce(tb AND ptb AND NOT (po < pos - 1 AND coalesce(regexp_matches(pc, {_TABLE}), false)) AND NOT coalesce(regexp_matches(caption, {_TABLE}), false) AND
    CASE WHEN tkind <> 1 AND pk <> 1 AND nc = pn THEN page = pp + 1 OR (px0 < x1 AND x0 < px1) ELSE page = pp + 1 AND px0 < x1 AND x0 < px1 AND nc <= pn END, false) AS part FROM j2),
  h2 AS (SELECT *, max(CASE WHEN NOT part THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS head FROM r2 WHERE tb),
  g2 AS (SELECT *, min(block_key) OVER (PARTITION BY doc_id, head) AS grp, row_number() OVER (PARTITION BY doc_id, head ORDER BY pos) AS n FROM h2),
  {_merge_sql("part AS (SELECT grp, n, CASE WHEN tkind IN (0, 3) THEN ['A', 'B', 'C'] WHEN tkind = 1 THEN ['0', '1', '2'] ELSE ['A', 'B'] END AS headers, CASE WHEN tkind = 2 THEN [['1', '2']] ELSE [['1', '2', '3']] END AS body_rows, caption FROM g2)")},
  ends AS (SELECT grp, count(*) AS np, arg_min(page, n) AS first_, arg_max(page, n) AS last_ FROM g2 GROUP BY grp),
  alone AS (SELECT grp, array_to_string(headers, '|') AS headers, array_to_string(list_transform(body_rows, lambda x: array_to_string(x, '|')), chr(10)) AS body, caption FROM part WHERE n = 1)
  SELECT e.grp AS block_key, CASE WHEN np = 1 THEN a.headers ELSE array_to_string(w.head, '|') END AS headers, CASE WHEN np = 1 THEN a.body ELSE coalesce(t.body, '') END AS body, CASE WHEN np = 1 THEN a.caption ELSE w.cap END AS caption,
    CASE WHEN np > 1 THEN CAST(np AS VARCHAR) END AS merged_parts, CASE WHEN np > 1 THEN CAST(last_ AS VARCHAR) END AS page_end, CASE WHEN np > 1 AND first_ <> last_ THEN 'true' END AS continued, CASE WHEN np > 1 THEN np ELSE 0 END AS n_spans
  FROM ends e JOIN whole w ON w.grp = e.grp JOIN alone a ON a.grp = e.grp LEFT JOIN texts t ON t.grp = e.grp""")
def tables_collapsed(spark, sf_dir):
    from folioforge.operators.tables import collapse_tables

    merged = collapse_tables(R.with_position(R.attach_table_captions(synthetic_blocks(spark, sf_dir))))
    said = [F.col("metadata")[k].alias(k) for k in ("merged_parts", "page_end", "continued")]
    return merged.where("block_type = 'table'").select("block_key", *_table_text("table_data"), *said, F.size("layout_spans").cast("bigint").alias("n_spans"))


@query(f"WITH {_BLOCKS} SELECT block_key, CAST(row_number() OVER w - 1 AS INT) AS ord, concat('block_', row_number() OVER w - 1) AS block_id FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY ord, block_id)")
def renumbered(spark, sf_dir):
    return R.renumber(_blocks(spark, sf_dir)).select("block_key", "ord", "block_id")


@query()
def refined_sequence(spark, sf_dir):
    return R.refine_sequence(_blocks(spark, sf_dir)).select("doc_id", "block_id", "ord", "block_type", "heading_level", "page", "text")


def _refine_sql(base: str) -> str:
    """The whole refinement as relations s1 to s9 over ``base``, which has the columns of syn. Every step numbers the blocks anew."""
    columns = "doc_id, block_key, block_type, text, heading_level, page, x0, y0, x1, y1, tkind"
    place = "CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INT) AS ord"
    at = lambda k: f"{{'t': block_type = 'table', 'page': page, 'x0': x0, 'x1': x1, 'y0': y0, 'y1': y1}}" if k else ""
    removable = f"block_type = 'heading' AND {_named(_title("coalesce(text, '')"), T.REMOVABLE_SECTIONS)}"
    return f"""s1 AS (WITH {_TYPED % base} SELECT {columns}, {place} FROM refined),
  s2 AS (WITH r AS (SELECT *, sum(CASE WHEN block_type = 'list_item' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM s1), m AS (SELECT *, min(CASE WHEN block_type = 'list_item' THEN x0 END) OVER (PARTITION BY doc_id, run) AS x FROM r)
    SELECT * EXCLUDE (run, x, heading_level), CASE WHEN block_type <> 'list_item' THEN heading_level WHEN coalesce({_label("coalesce(text, '')")}, false) OR x0 IS NULL OR x0 <= x + 10 THEN 1 WHEN x0 <= x + 35 THEN 2 ELSE 3 END AS heading_level FROM m),
  s3 AS (WITH f AS (SELECT *, block_type = 'heading' AS h, coalesce(heading_level, 1) AS lv, {removable} AS rm FROM s2),
    g AS (SELECT *, sum(CASE WHEN rm THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord) AS grp, last_value(CASE WHEN rm THEN lv END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rl FROM f),
    e AS (SELECT *, max(CASE WHEN h AND NOT rm AND lv <= rl THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, grp ORDER BY ord) AS ended FROM g) SELECT {columns}, {place} FROM e WHERE grp = 0 OR ended = 1),
  s4 AS (SELECT {columns}, {place} FROM s3 WHERE NOT coalesce(page = 1 AND text <> '' AND regexp_matches(lower(text), '{T.BOILERPLATE}'), false)),
  s5 AS (WITH n AS (SELECT *, lag({at(1)}) OVER w AS p, lead({at(1)}) OVER w AS q FROM s4 WINDOW w AS (PARTITION BY doc_id ORDER BY ord)) SELECT {columns}, {place} FROM n WHERE NOT (block_type = 'image' AND ({_iou('p')} OR {_iou('q')}))),
  s6 AS (WITH f AS (SELECT *, block_type IN ('code', 'paragraph') AND (text IN ('@startuml', '@enduml', 'UE -> RIC: report', 'participant RIC')) AS part, block_type = 'code' AND text = '@startuml' AS st, block_type = 'code' AND text = '@enduml' AS en FROM s5),
    m AS (SELECT *, max(CASE WHEN st THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord) AS s, max(CASE WHEN NOT coalesce(part, false) THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord) AS x, max(CASE WHEN en THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e,
      first_value(CASE WHEN NOT coalesce(part AND NOT st AND NOT en, false) THEN coalesce(st, false) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx FROM f),
    c AS (SELECT *, (s IS NOT NULL AND s > coalesce(e, -1) AND s > coalesce(x, -1)) OR coalesce(part AND NOT st AND NOT en AND nx, false) AS covered FROM m), i AS (SELECT *, sum(CASE WHEN covered THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS island FROM c),
    u AS (SELECT {columns}, ord FROM i WHERE NOT covered UNION ALL BY NAME SELECT doc_id, min(ord) AS ord, arg_min(block_key, ord) AS block_key, 'code' AS block_type, string_agg(text, chr(10) ORDER BY ord) AS text, arg_min(heading_level, ord) AS heading_level, arg_min(page, ord) AS page, arg_min(x0, ord) AS x0, arg_min(y0, ord) AS y0, arg_min(x1, ord) AS x1, arg_min(y1, ord) AS y1, NULL AS tkind FROM i WHERE covered GROUP BY doc_id, island)
    SELECT {columns}, {place} FROM u),
  s7 AS (WITH f AS (SELECT *, block_type = 'image' AS im, block_type IN ('paragraph', 'heading') AND coalesce(regexp_matches(text, {_FIGURE}), false) AS cp FROM s6),
    n AS (SELECT *, coalesce(lead(cp) OVER w, false) AS c1, coalesce(lag(cp) OVER w, false) AS cm1, coalesce(lag(cp, 3) OVER w, false) AS cm3, coalesce(lead(im, 2) OVER w, false) AS i2, coalesce(lag(im, 2) OVER w, false) AS im2, coalesce(lag(im, 4) OVER w, false) AS im4 FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
    c AS (SELECT *, CASE WHEN im THEN CASE WHEN c1 AND NOT i2 THEN 1 WHEN cm1 AND NOT im2 THEN -1 WHEN c1 THEN 1 WHEN cm1 AND cm3 AND NOT im4 THEN -1 END END AS choice FROM n),
    t AS (SELECT *, coalesce(lag(choice) OVER w, 0) = 1 OR coalesce(lead(choice) OVER w, 0) = -1 AS taken FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY ord)) SELECT {columns}, {place} FROM t WHERE NOT (cp AND taken)),
  s8 AS (WITH syn AS (SELECT * FROM s7), {_RUNS}, {_CAPTIONS}{_CAPTIONED} SELECT {columns}, caption, {place} FROM cz),
  s9 AS (WITH f AS (SELECT *, block_type = 'table' AS tb, block_type IN ('paragraph', 'heading') AND coalesce(regexp_matches(text, {_TABLE}), false) AS cp, CASE WHEN tkind = 2 THEN 2 ELSE 3 END AS nc FROM s8),
    p AS (SELECT *, last_value(CASE WHEN NOT cp THEN ord END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS po FROM f),
    j AS (SELECT a.*, o.tb AS ptb, o.tkind AS pk, o.nc AS pn, o.page AS pp, o.x0 AS px0, o.x1 AS px1, o.caption AS pc FROM p a LEFT JOIN p o ON o.doc_id = a.doc_id AND o.ord = a.po)
    SELECT {columns}, {place} FROM j WHERE NOT coalesce(tb AND ptb AND NOT (po < ord - 1 AND coalesce(regexp_matches(pc, {_TABLE}), false)) AND NOT coalesce(regexp_matches(caption, {_TABLE}), false) AND
      CASE WHEN tkind <> 1 AND pk <> 1 AND nc = pn THEN page = pp + 1 OR (px0 < x1 AND x0 < px1) ELSE page = pp + 1 AND px0 < x1 AND x0 < px1 AND nc <= pn END, false))"""


@query(f"WITH {SYNTHETIC}, {_refine_sql('syn')} SELECT block_key, doc_id, concat('block_', ord) AS block_id, ord, block_type, heading_level, page, text FROM s9")
def refined_sequence_synthetic(spark, sf_dir):
    """All refinements on blocks of every kind."""
    return R.refine_sequence(synthetic_blocks(spark, sf_dir)).select("block_key", "doc_id", "block_id", "ord", "block_type", "heading_level", "page", "text")


@query(f"WITH {SYNTHETIC}, moved AS (SELECT * REPLACE (CAST(page + (ord // 10) * 3 AS INT) AS page) FROM syn), {_refine_sql('moved')} SELECT block_key, doc_id, concat('block_', ord) AS block_id, ord, block_type, heading_level, page, text FROM s9")
def shards_merged(spark, sf_dir):
    """Shards of ten blocks, each shifted by three pages more than the one before, joined and refined."""
    shards = synthetic_blocks(spark, sf_dir).withColumn("shard", F.expr("cast(ord div 10 as int)")).withColumn("page_offset", F.expr("cast((ord div 10) * 3 as int)"))
    return R.merge_shards(shards).select("block_key", "doc_id", "block_id", "ord", "block_type", "heading_level", "page", "text")


# --- documents --------------------------------------------------------------------------------------------------------


@query(f"""WITH {SYNTHETIC}, h AS (SELECT *, CASE WHEN block_type = 'heading' OR ord = 0 THEN 1 ELSE 0 END AS op FROM syn), n AS (SELECT *, sum(op) OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS no FROM h),
  g AS (SELECT doc_id, no, min(page) AS ps, max(page) AS pe, count(*) AS nb, arg_min(CASE WHEN block_type = 'heading' THEN coalesce(heading_level, 1) ELSE 1 END, ord) AS lv, arg_min(CASE WHEN block_type = 'heading' THEN coalesce(text, '') ELSE 'Preamble' END, ord) AS title FROM n GROUP BY doc_id, no)
  SELECT a.doc_id, CAST(a.no AS INT) AS section_no, a.title, a.lv AS level, CAST((SELECT max(b.no) FROM g b WHERE b.doc_id = a.doc_id AND b.no < a.no AND b.lv < a.lv) AS INT) AS parent_no, a.nb AS n_blocks, a.ps AS page_start, a.pe AS page_end FROM g a""")
def section_tree(spark, sf_dir):
    made = D.build_sections(synthetic_blocks(spark, sf_dir))
    return made.select("doc_id", "section_no", "title", "level", "parent_no", F.size("block_ids").cast("bigint").alias("n_blocks"), "page_start", "page_end")


@query(f"{H_TREE}, ti AS (SELECT section_key, {_strip("coalesce(title, '')")} AS title FROM (SELECT *, row_number() OVER (PARTITION BY section_key ORDER BY updated_at DESC, title DESC NULLS LAST) AS rn FROM sections WHERE section_key IS NOT NULL) WHERE rn = 1), u AS (SELECT section_key, unnest(path) AS step, generate_subscripts(path, 1) AS nth FROM tree) SELECT u.section_key, coalesce(string_agg(nullif(title, ''), ' > ' ORDER BY nth), '') AS path FROM u JOIN ti ON ti.section_key = u.step GROUP BY u.section_key")
def section_paths(spark, sf_dir):
    rows = _sections(spark, sf_dir)
    return D.section_paths(rows.join(H.section_links(read_table(spark, sf_dir, "sections")).withColumnRenamed("key", "section_key"), "section_key")).withColumnRenamed("key", "section_key")


@query(f"""WITH {_BLOCKS}, {_SECTIONS}, body AS (SELECT doc_id, block_id FROM b WHERE block_type <> 'heading' AND ((block_type NOT IN ('table', 'image') AND {_strip("coalesce(text, '')")} <> '')
    OR (block_type = 'table' AND (coalesce(table_data.caption, '') <> '' OR len(table_data.headers) > 0 OR len(table_data.body_rows) > 0)) OR (block_type = 'image' AND (coalesce(trim(image.caption), '') <> '' OR coalesce(trim(image.alt), '') <> '')))),
  kids AS (SELECT DISTINCT doc_id, parent_id FROM s WHERE parent_id <> ''), full_ AS (SELECT DISTINCT u.doc_id, u.section_id FROM (SELECT doc_id, section_id, unnest(block_ids) AS block_id FROM s) u JOIN body ON body.doc_id = u.doc_id AND body.block_id = u.block_id)
  SELECT DISTINCT s.doc_id, s.section_id FROM s JOIN kids ON kids.doc_id = s.doc_id AND kids.parent_id = s.section_id WHERE NOT EXISTS (SELECT 1 FROM full_ f WHERE f.doc_id = s.doc_id AND f.section_id = s.section_id)""")
def structural_sections(spark, sf_dir):
    return D.structural_parents(_sections(spark, sf_dir), _blocks(spark, sf_dir))


@query(f"""WITH {_BLOCKS}, x AS (SELECT *, list_distinct(list_filter(list_transform(layout_spans, lambda z: z.page), lambda p: p IS NOT NULL)) AS known, coalesce(TRY_CAST(metadata['page_end'] AS INT), page) AS pe FROM b),
  u AS (SELECT doc_id, ord, block_id, unnest(CASE WHEN len(known) > 0 THEN known WHEN page IS NOT NULL THEN generate_series(least(page, pe), greatest(page, pe)) ELSE [] END) AS number FROM x)
  SELECT doc_id, CAST(number AS INT) AS number, string_agg(block_id, ',' ORDER BY ord, block_id) AS blocks FROM u GROUP BY doc_id, number""")
def page_index(spark, sf_dir):
    return D.page_index(_blocks(spark, sf_dir)).select("doc_id", "number", F.array_join("block_ids", ",").alias("blocks"))


@query(f"""WITH {_BLOCKS}, t AS (SELECT *, {_strip("coalesce(text, '')")} AS body FROM b), us AS (SELECT *, block_type IN ('heading', 'paragraph') AND body <> '' AND NOT regexp_matches(lower(body), '{T.BOILERPLATE}') AS ok FROM t),
  fr AS (SELECT doc_id, min(ord) AS fo FROM us WHERE page = 1 AND ok GROUP BY doc_id), en AS (SELECT us.doc_id, min(ord) AS eo FROM us JOIN fr USING (doc_id) WHERE page <> 1 AND ord > fo GROUP BY us.doc_id),
  pa AS (SELECT us.doc_id, ord, block_id, body, row_number() OVER w AS i, sum(length(body) + 1) OVER w - 1 AS cum FROM us LEFT JOIN en USING (doc_id) WHERE page = 1 AND ok AND (eo IS NULL OR ord < eo) WINDOW w AS (PARTITION BY us.doc_id ORDER BY ord, block_id)),
  st AS (SELECT *, coalesce(max(CASE WHEN cum >= 120 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done, max(CASE WHEN i > 1 AND length(body) > 180 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord, block_id) AS stop FROM pa),
  co AS (SELECT doc_id, string_agg(body, ' ' ORDER BY ord, block_id) AS cover FROM st WHERE done = 0 AND stop = 0 GROUP BY doc_id),
  he AS (SELECT doc_id, arg_min(body, concat(lpad(CAST(ord AS VARCHAR), 10, '0'), block_id)) AS heading FROM t WHERE block_type = 'heading' AND body <> '' AND lower(body) NOT IN ({', '.join(f"'{x}'" for x in T.GENERIC_TITLES)}) GROUP BY doc_id)
  SELECT r.doc_id, coalesce(cover, nullif({_strip("regexp_replace(coalesce(r.subject, ''), '[-_]', ' ', 'g')")}, ''), heading, 'Untitled') AS title FROM doc_registry r LEFT JOIN co USING (doc_id) LEFT JOIN he USING (doc_id)""")
def document_titles(spark, sf_dir):
    hints = read_table(spark, sf_dir, "doc_registry").select("doc_id", F.col("subject").alias("title_hint"))
    return D.resolve_titles(_blocks(spark, sf_dir), hints)


@query(f"""WITH {_BLOCKS}, {_SECTIONS} SELECT r.doc_id, (SELECT count(*) FROM b WHERE b.doc_id = r.doc_id) AS num_blocks, (SELECT count(*) FROM s WHERE s.doc_id = r.doc_id) AS num_sections, (SELECT count(*) FROM b WHERE b.doc_id = r.doc_id AND block_type = 'table') AS num_tables,
  (SELECT count(*) FROM b WHERE b.doc_id = r.doc_id AND block_type = 'table' AND coalesce(len(table_data.body_rows), 0) = 0) AS degraded_blocks, len(list_filter(string_split(coalesce(extra['failed_shards'], ''), ','), lambda x: trim(x) <> '')) AS failed_shards FROM doc_registry r""")
def ingest_statistics(spark, sf_dir):
    stats = D.ingest_stats(_blocks(spark, sf_dir), _sections(spark, sf_dir), read_table(spark, sf_dir, "doc_registry"))
    return stats.select("doc_id", "num_blocks", "num_sections", "num_tables", "degraded_blocks", "failed_shards")


_NORM = _strip(_collapse(r"regexp_replace(lower(text), '\p{Nd}+', '', 'g')"))
_REPEATED = f"""{_BLOCKS}, z AS (SELECT *, {_NORM} AS norm, CASE WHEN bbox.y0 < 842.0 * 0.15 THEN 'top' WHEN bbox.y1 > 842.0 * 0.85 THEN 'bottom' ELSE 'body' END AS zone FROM b),
pg AS (SELECT doc_id, count(DISTINCT page) AS np FROM z WHERE page IS NOT NULL GROUP BY doc_id), rep AS (SELECT z.doc_id, norm, zone, count(DISTINCT page) AS n_pages FROM z JOIN pg ON pg.doc_id = z.doc_id WHERE page IS NOT NULL AND norm <> '' GROUP BY z.doc_id, norm, zone, np HAVING count(DISTINCT page) / np >= 0.6)"""


@query(f"WITH {_REPEATED} SELECT * FROM rep")
def repeated_texts(spark, sf_dir):
    return P.repeated_texts(_blocks(spark, sf_dir))


@query(f"WITH {_REPEATED} SELECT block_key FROM z WHERE NOT EXISTS (SELECT 1 FROM rep WHERE rep.doc_id = z.doc_id AND rep.norm = z.norm AND rep.zone = z.zone)")
def repeated_texts_removed(spark, sf_dir):
    return P.remove_repeated(_blocks(spark, sf_dir)).select("block_key")


@query(f"""WITH {_BLOCKS} SELECT block_key FROM b WHERE NOT coalesce(page = 1 AND (block_type = 'image' OR ({_strip("coalesce(text, '')")} <> '' AND (coalesce(bbox.y0 >= 842.0 * 0.15 AND bbox.y1 > 842.0 * 0.85, false) OR regexp_matches(lower(text), '{T.BOILERPLATE}')))), false)
  AND NOT coalesce(block_type = 'image' AND ((bbox.y0 + bbox.y1) / 2 < 0.15 * 842.0 OR (bbox.y0 + bbox.y1) / 2 > 0.85 * 842.0), false)""")
def covers_cleaned(spark, sf_dir):
    return P.clean_physical(_blocks(spark, sf_dir), repeated=False).select("block_key")


# --- chunks, index ----------------------------------------------------------------------------------------------------


_STRUCTURAL = ORACLE["structural_sections"]


@query(f"""WITH {_BLOCKS}, {_RENDERED}, {_SECTIONS}, st AS ({_STRUCTURAL}), u AS (SELECT s.doc_id, s.section_id, s.ord AS so, page_start, page_end, unnest(block_ids) AS block_id, generate_subscripts(block_ids, 1) AS nth FROM s WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.doc_id = s.doc_id AND st.section_id = s.section_id)),
  g AS (SELECT u.doc_id, u.section_id, so, u.page_start, u.page_end, string_agg(markdown, chr(10) || chr(10) ORDER BY nth) AS text, string_agg(u.block_id, ',' ORDER BY nth) AS block_ids FROM u JOIN md ON md.doc_id = u.doc_id AND md.block_id = u.block_id WHERE markdown <> '' GROUP BY ALL),
  al AS (SELECT doc_id, NULL AS section_id, string_agg(markdown, chr(10) || chr(10) ORDER BY ord, block_id) AS text, string_agg(block_id, ',' ORDER BY ord, block_id) AS block_ids, min(page) AS page_start, max(page) AS page_end, 0 AS chunk_index FROM md WHERE markdown <> '' AND doc_id NOT IN (SELECT doc_id FROM s WHERE doc_id IS NOT NULL) GROUP BY doc_id)
  SELECT concat(doc_id, ':', coalesce(section_id, 'orphan')) AS chunk_id, * FROM (SELECT doc_id, section_id, text, block_ids, page_start, page_end, row_number() OVER (PARTITION BY doc_id ORDER BY so NULLS FIRST, section_id) - 1 AS chunk_index FROM g UNION ALL BY NAME SELECT * FROM al)""")
def section_chunks(spark, sf_dir):
    sections, blocks = _sections(spark, sf_dir), _blocks(spark, sf_dir)
    made = C.section_chunks(sections.dropDuplicates(["doc_id", "section_id"]), blocks, D.structural_parents(sections, blocks))
    return made.withColumn("block_ids", F.array_join("block_ids", ","))


@query(f"""SELECT doc_id, string_agg(concat('<!-- ', chunk_id, ' pages ', coalesce(CAST(page_start AS VARCHAR), '?'), '-', coalesce(CAST(page_end AS VARCHAR), '?'), ' -->', chr(10), chr(10), text), chr(10) || chr(10) ORDER BY chunk_index, chunk_id) AS markdown FROM ({ORACLE['section_chunks']}) GROUP BY doc_id""")
def chunk_exports(spark, sf_dir):
    """The chunks of every document as Markdown."""
    chunks = section_chunks(spark, sf_dir)
    return J.chunks_markdown(chunks)


@query(f"""WITH {_SECTIONS}, {_BLOCKS}, u AS (SELECT doc_id, section_id, unnest(block_ids) AS block_id FROM s) SELECT u.doc_id, u.section_id, count(*) AS n_blocks, min(b.page) AS first_page, max(b.page) AS last_page FROM u JOIN b ON b.doc_id = u.doc_id AND b.block_id = u.block_id GROUP BY u.doc_id, u.section_id""")
def section_page_ranges(spark, sf_dir):
    """Blocks of every section and the range of their pages."""
    held = D.blocks_of_sections(_sections(spark, sf_dir), _blocks(spark, sf_dir))
    return held.groupBy("doc_id", "section_id").agg(F.count("*").alias("n_blocks"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


@query(f"WITH {_SECTIONS} SELECT section_key FROM s WHERE parent_id IS NULL OR parent_id = ''")
def root_sections(spark, sf_dir):
    return D.roots(_sections(spark, sf_dir)).select("section_key")


_SENT = rf"list_filter(list_transform(string_split(regexp_replace({_strip('text')}, '([.?!])[{W}]+', '\1' || chr(1), 'g'), chr(1)), lambda x: {_strip('x')}), lambda x: x <> '')"


@query(f"WITH {_BLOCKS} SELECT block_key, len({_SENT}) AS n_sentences, coalesce(list_max(list_transform({_SENT}, lambda x: length(x))), 0) AS longest, len(list_filter(regexp_split_to_array(text, '[{W}]+'), lambda x: x <> '')) AS n_tokens FROM b WHERE text IS NOT NULL")
def sentence_units(spark, sf_dir):
    s = T.sentences(F.col("text"))
    return _blocks(spark, sf_dir).where("text is not null").select("block_key", F.size(s).cast("bigint").alias("n_sentences"), F.coalesce(F.array_max(F.transform(s, lambda x: F.length(x))), F.lit(0)).cast("bigint").alias("longest"), T.token_count(F.col("text")).cast("bigint").alias("n_tokens"))


@query()
def semantic_chunks(spark, sf_dir):
    return C.semantic_chunks(_blocks(spark, sf_dir)).withColumn("block_ids", F.array_join("block_ids", ","))


_UUID = "left(sha1(concat(unhex('6ba7b8119dad11d180b400c04fd430c8'), encode(chunk_id))), 32)"


@query(f"WITH {_CHUNKS}, h AS (SELECT chunk_key, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(chunk_id)) AS x FROM c) SELECT chunk_key, concat(x[1:8], '-', x[9:12], '-5', x[14:16], '-', lower(to_hex((('0x' || x[17:18])::INT & 63) | 128)), x[19:20], '-', x[21:32]) AS point_id FROM h")
def point_ids(spark, sf_dir):
    return I.with_point_ids(_chunks(spark, sf_dir)).select("chunk_key", "point_id")


@query(f"""WITH {_CHUNKS}, t AS (SELECT chunk_key, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: t <> '') AS ts FROM c), tf AS (SELECT chunk_key, len(ts) AS l, unnest(ts) AS term FROM t), f AS (SELECT chunk_key, l, term, count(*) AS n FROM tf GROUP BY ALL)
  SELECT chunk_key, CAST(count(*) AS INT) AS n_terms, round(sum(CAST(CAST(n * 2.2 / (n + 1.2 * (0.25 + 0.75 * l / 100.0)) AS FLOAT) AS DOUBLE)), 3) AS total FROM f GROUP BY chunk_key""")
def sparse_embeddings(spark, sf_dir):
    """Sparse vectors of all chunks: terms and total weight, with so many slots that terms don't meet."""
    made = I.sparse_weights(_chunks(spark, sf_dir), "chunk_key", "text", dim=1 << 30)
    return made.select(F.col("id").alias("chunk_key"), F.size("sparse.indices").alias("n_terms"), F.round(F.aggregate("sparse.weights", F.lit(0.0), lambda a, w: a + w.cast("double")), 3).alias("total"))


_SYNC = f"{_CHUNKS}, d AS (SELECT DISTINCT doc_id FROM c WHERE doc_version >= '05.00'), p AS (SELECT doc_id, count(DISTINCT chunk_id) AS n FROM c GROUP BY doc_id)"


@query(f"WITH {_SYNC} SELECT doc_id, n AS n_points FROM p WHERE doc_id NOT IN (SELECT doc_id FROM d)")
def index_after_delete(spark, sf_dir):
    """All chunks put into an index, put in once more, then the documents of late versions deleted."""
    import uuid

    points = I.with_point_ids(_chunks(spark, sf_dir)).select("point_id", "doc_id", "chunk_id", "text", "indexed_at")
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    I.create_index(spark, path, I.latest_points(points, ["point_id"], ["indexed_at"]))
    I.upsert(spark, path, points, points.select("doc_id").distinct(), ["indexed_at"])
    gone = _chunks(spark, sf_dir).where("doc_version >= '05.00'").select("doc_id").distinct()
    I.upsert(spark, path, points.limit(0), gone, ["indexed_at"])
    return I.read_index(spark, path).groupBy("doc_id").agg(F.count("*").alias("n_points"))


@query(f"WITH {_CHUNKS}, p AS (SELECT doc_id, count(DISTINCT chunk_id) AS n FROM c WHERE doc_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY doc_id), d AS (SELECT doc_id FROM p ORDER BY doc_id LIMIT 3) SELECT doc_id, n AS n_points, CAST(0 AS BIGINT) AS n_deleted FROM p WHERE doc_id NOT IN (SELECT doc_id FROM d) UNION ALL SELECT doc_id, 0, n FROM p JOIN d USING (doc_id) UNION ALL SELECT 'no such document', 0, 0")
def documents_deleted(spark, sf_dir):
    """The three least documents deleted from an index one by one, with the number of points that each deletion reports."""
    import uuid

    points = I.latest_points(I.with_point_ids(_chunks(spark, sf_dir)).select("point_id", "doc_id", "chunk_id", "text", "indexed_at").where("doc_id is not null"), ["point_id"], ["indexed_at"])
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    I.create_index(spark, path, points)
    gone = [r.doc_id for r in points.select("doc_id").distinct().orderBy("doc_id").limit(3).collect()]
    told = spark.createDataFrame([(d, 0, I.delete_documents(spark, path, [d])) for d in [*gone, "no such document"]], "doc_id string, n_points bigint, n_deleted bigint")
    return I.read_index(spark, path).groupBy("doc_id").agg(F.count("*").alias("n_points")).withColumn("n_deleted", F.lit(0).cast("bigint")).unionByName(told)


# --- retrieval --------------------------------------------------------------------------------------------------------

QUESTION = "scheduler ticket handover barrier"
_TERMS = "list_filter(string_split_regex(lower(%s), '[^a-z0-9]+'), lambda t: t <> '')"
_BM25 = f"""{_CHUNKS}, t AS (SELECT chunk_key AS id, {_TERMS % 'text'} AS ts FROM c), st AS (SELECT count(*) AS n, avg(len(ts)) AS av FROM t WHERE len(ts) > 0),
po AS (SELECT id, len(ts) AS l, unnest(ts) AS term FROM t), tf AS (SELECT id, l, term, count(*) AS f FROM po GROUP BY ALL), df AS (SELECT term, count(*) AS d FROM tf GROUP BY term),
bm AS (SELECT id, sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * l / av))) AS score FROM tf JOIN df USING (term), st WHERE term IN (SELECT unnest({_TERMS % f"'{QUESTION}'"})) GROUP BY id)"""
_USABLE = "v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id) AS rn FROM chunk_vectors) WHERE rn = 1 AND len(dense) = 64 AND len(list_filter(dense, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(dense, lambda x: x <> 0)) > 0), q AS (SELECT dense AS qv FROM v ORDER BY vec_id LIMIT 1)"
_DENSE = f"{_USABLE}, dn AS (SELECT vec_id AS id, list_cosine_similarity(dense::DOUBLE[], qv::DOUBLE[]) AS score FROM v, q)"


def _question(spark) -> DataFrame:
    return spark.createDataFrame([(1, QUESTION)], "query_id int, query string")


def _usable(spark, sf_dir) -> DataFrame:
    v = read_table(spark, sf_dir, "chunk_vectors").where(F.size("dense") == 64)
    finite = F.forall("dense", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return v.where(finite & F.exists("dense", lambda x: x != 0)).dropDuplicates(["vec_id"])


def _first_query(spark, sf_dir) -> DataFrame:
    """The usable vector of least id as the query."""
    return _usable(spark, sf_dir).orderBy("vec_id").limit(1).select(F.lit(1).cast("bigint").alias("query_id"), F.col("dense").alias("vector"))


def _best(scores: DataFrame, limit: int) -> DataFrame:
    """Scores rounded before they are ranked, so that both engines cut alike."""
    return S.top_per_query(scores.withColumn("score", F.round("score", 6)), limit)


@query(f"WITH {_BM25} SELECT id AS chunk_key, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, id LIMIT 10")
def bm25_top10(spark, sf_dir):
    return _best(S.bm25_scores(_chunks(spark, sf_dir), _question(spark), "chunk_key"), 10).select(F.col("id").alias("chunk_key"), "score")


@query(f"WITH {_CHUNKS}, t AS (SELECT chunk_key, {_TERMS % 'text'} AS ts FROM c), po AS (SELECT DISTINCT chunk_key, unnest(ts) AS term FROM t) SELECT term, count(*) AS df FROM po GROUP BY term")
def term_statistics(spark, sf_dir):
    return S.postings(_chunks(spark, sf_dir), "chunk_key", "text").groupBy("term").agg(F.count("*").alias("df"))


@query(f"WITH {_DENSE} SELECT id AS vec_id, round(score, 6) AS score FROM dn ORDER BY round(score, 6) DESC, id LIMIT 10")
def dense_top10(spark, sf_dir):
    return S.dense_top_of_set(_usable(spark, sf_dir), _first_query(spark, sf_dir), 10).select(F.col("id").alias("vec_id"), "score")


@query(f"WITH {_DENSE}, {_CHUNKS} SELECT id AS vec_id, round(score, 6) AS score FROM dn JOIN c ON c.chunk_key = dn.id WHERE c.doc_id = (SELECT min(doc_id) FROM c) ORDER BY round(score, 6) DESC, id LIMIT 10")
def dense_top10_of_document(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    doc = chunks.agg(F.min("doc_id")).first()[0]
    rows = _usable(spark, sf_dir).join(chunks.where(F.col("doc_id") == doc).select(F.col("chunk_key").alias("vec_id"), "doc_id"), "vec_id")
    return S.dense_top_of_set(rows, _first_query(spark, sf_dir), 10).select(F.col("id").alias("vec_id"), "score")


_LEGS = f"""{_DENSE}, {_BM25}, legs AS (SELECT * FROM (SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS r FROM dn) WHERE r <= 30 UNION ALL SELECT * FROM (SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS r FROM bm) WHERE r <= 30)"""


@query(f"WITH {_LEGS} SELECT id AS chunk_key, round(sum(1.0 / (60 + r)), 6) AS score FROM legs GROUP BY id ORDER BY sum(1.0 / (60 + r)) DESC, id LIMIT 10")
def hybrid_rrf(spark, sf_dir):
    return _hybrid(spark, sf_dir, 10).select(F.col("id").alias("chunk_key"), F.round("score", 6).alias("score"))


def _hybrid(spark, sf_dir, limit: int) -> DataFrame:
    dense = S.dense_top_of_set(_usable(spark, sf_dir), _first_query(spark, sf_dir), 30)
    sparse = _best(S.bm25_scores(_chunks(spark, sf_dir), _question(spark), "chunk_key"), 30)
    return S.fuse([dense, sparse], limit)


@query(f"""WITH {_LEGS}, fu AS (SELECT id, sum(1.0 / (60 + r)) AS score FROM legs GROUP BY id ORDER BY sum(1.0 / (60 + r)) DESC, id LIMIT 30), qt AS (SELECT list_distinct({_TERMS % f"'{QUESTION}'"}) AS q),
  re AS (SELECT fu.id, score, CAST(len(list_intersect(qt.q, {_TERMS % "coalesce(c.text, '')"})) AS DOUBLE) / greatest(len(qt.q), 1) AS relevance FROM fu JOIN c ON c.chunk_key = fu.id, qt)
  SELECT id AS chunk_key, relevance, CAST(row_number() OVER (ORDER BY relevance DESC, score DESC, id) AS INT) AS rank FROM re QUALIFY rank <= 10""")
def search_reranked(spark, sf_dir):
    """Hybrid candidates, reranked."""
    texts = _chunks(spark, sf_dir).select(F.col("chunk_key").alias("id"), "text")
    return S.rerank(_hybrid(spark, sf_dir, 30), texts, _question(spark), 10).select(F.col("id").alias("chunk_key"), "relevance", "rank")


@query(f"""WITH {_LEGS}, {_SECTIONS}, fu AS (SELECT id, round(sum(1.0 / (60 + r)), 6) AS score, row_number() OVER (ORDER BY sum(1.0 / (60 + r)) DESC, id) AS rank FROM legs GROUP BY id QUALIFY rank <= 10),
  sect AS (SELECT doc_id, section_id, min(title) AS title FROM s GROUP BY doc_id, section_id)
  SELECT CAST(rank AS INT) AS rank, c.chunk_id, coalesce(c.text, '') AS text, score, coalesce(c.doc_id, '') AS doc_id, coalesce(sect.title, '') AS section_path FROM fu JOIN c ON c.chunk_key = fu.id LEFT JOIN sect ON sect.doc_id = c.doc_id AND sect.section_id = c.section_id""")
def search_hits(spark, sf_dir):
    """The hits of the hybrid search as JSON with texts and sections, read back."""
    titles = _sections(spark, sf_dir).groupBy("doc_id", "section_id").agg(F.min("title").alias("section_path"))
    c = _chunks(spark, sf_dir).select(F.col("chunk_key").alias("id"), "chunk_id", "doc_id", "section_id", "text").join(titles, ["doc_id", "section_id"], "left")
    hits = _hybrid(spark, sf_dir, 10).withColumn("score", F.round("score", 6)).join(c, "id")
    shown = F.from_json("hits", "results array<struct<text:string,score:double,doc_id:string,section_path:string>>")["results"]
    read = S.hits_json(hits).select("query_id", F.posexplode(shown).alias("at", "h")).withColumn("rank", F.col("at") + 1)
    return read.join(hits.select("query_id", "rank", "chunk_id"), ["query_id", "rank"]).select("rank", "chunk_id", "h.text", "h.score", "h.doc_id", "h.section_path")


@query("""WITH e AS (SELECT DISTINCT vec_id, embedding FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM e a, e b WHERE a.vec_id % 20 = 0)
  SELECT query_id, vec_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM p) WHERE rank <= 10""")
def dense_batch_top10(spark, sf_dir):
    """Queries: the vectors of the fixed embeddings table whose id is divisible by 20, against all of it."""
    e = read_table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector")).dropDuplicates(["query_id"])
    dim = e.agg(F.max(F.size("embedding"))).first()[0] or 1
    return S.dense_top_of_set(e, q, 10, dim, "vec_id", "embedding").select("query_id", F.col("id").alias("vec_id"), "score", "rank")


_SET_DENSE = f"""{_USABLE}, dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(a.dense::DOUBLE[], b.dense::DOUBLE[]), 6) AS score FROM v a, v b WHERE a.vec_id % 20 = 0))"""
_SET_BM25 = f"""{_CHUNKS}, t AS (SELECT chunk_key AS id, {_TERMS % 'text'} AS ts FROM c), st AS (SELECT count(*) AS n, avg(len(ts)) AS av FROM t WHERE len(ts) > 0), po AS (SELECT id, len(ts) AS l, unnest(ts) AS term FROM t), tf AS (SELECT id, l, term, count(*) AS f FROM po GROUP BY ALL), df AS (SELECT term, count(*) AS d FROM tf GROUP BY term),
br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM (SELECT w.id AS query_id, tf.id, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * tf.f * 2.2 / (tf.f + 1.2 * (1 - 0.75 + 0.75 * tf.l / av))), 6) AS score FROM tf JOIN df USING (term) JOIN tf w USING (term), st WHERE w.id % 20 = 0 GROUP BY w.id, tf.id))"""
_SET_FUSED = f"""{_SET_DENSE}, {_SET_BM25}, fu AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM (SELECT query_id, id, sum(1.0 / (60 + r)) AS score FROM (SELECT query_id, id, r FROM dr WHERE r <= 30 UNION ALL SELECT query_id, id, r FROM br WHERE r <= 30) GROUP BY query_id, id))"""


def _set_legs(spark, sf_dir, limit: int) -> list[DataFrame]:
    """Queries: the rows of chunk_vectors and chunks whose id is divisible by 20, against all of them."""
    v, c = _usable(spark, sf_dir), _chunks(spark, sf_dir)
    dense = S.dense_top_of_set(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("dense").alias("vector")), limit)
    return [dense, S.bm25_top_of_set(c, _set_queries(c), limit, "chunk_key")]


def _set_queries(chunks: DataFrame) -> DataFrame:
    return chunks.where("chunk_key % 20 = 0").select(F.col("chunk_key").alias("query_id"), F.col("text").alias("query"))


@query(f"WITH {_SET_DENSE} SELECT query_id, id AS vec_id, score, CAST(r AS INT) AS rank FROM dr WHERE r <= 10")
def dense_set_top10(spark, sf_dir):
    v = _usable(spark, sf_dir)
    return S.dense_top_of_set(v, v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("dense").alias("vector")), 10).select("query_id", F.col("id").alias("vec_id"), "score", "rank")


@query(f"WITH {_SET_BM25} SELECT query_id, id AS chunk_key, score, CAST(r AS INT) AS rank FROM br WHERE r <= 10")
def bm25_set_top10(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    return S.bm25_top_of_set(c, _set_queries(c), 10, "chunk_key").select("query_id", F.col("id").alias("chunk_key"), "score", "rank")


@query(f"WITH {_SET_FUSED} SELECT query_id, id AS chunk_key, round(score, 6) AS score, CAST(r AS INT) AS rank FROM fu WHERE r <= 10")
def hybrid_set_top10(spark, sf_dir):
    return S.fuse(_set_legs(spark, sf_dir, 30), 10).select("query_id", F.col("id").alias("chunk_key"), F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_SET_FUSED}, re AS (SELECT query_id, fu.id, score, CAST(len(list_intersect(list_distinct(q.ts), coalesce(x.ts, []))) AS DOUBLE) / greatest(len(list_distinct(q.ts)), 1) AS relevance FROM fu JOIN t x ON x.id = fu.id JOIN (SELECT id AS query_id, ts FROM t) q USING (query_id) WHERE r <= 30 AND q.ts IS NOT NULL)
  SELECT query_id, id AS chunk_key, relevance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, score DESC, id) AS INT) AS rank FROM re QUALIFY rank <= 10""")
def reranked_set_top10(spark, sf_dir):
    """Fused candidates of the query set, reranked; queries without a text have no row."""
    c = _chunks(spark, sf_dir)
    fused = S.fuse(_set_legs(spark, sf_dir, 30), 30)
    return S.rerank(fused, c.select(F.col("chunk_key").alias("id"), "text"), _set_queries(c).where("query is not null"), 10).select("query_id", F.col("id").alias("chunk_key"), "relevance", "rank")


# --- codec, sources, events -------------------------------------------------------------------------------------------


def _codec_tables(spark, sf_dir) -> tuple:
    blocks = _blocks(spark, sf_dir)
    sections = read_table(spark, sf_dir, "sections").where("section_key is not null").dropDuplicates(["section_key", "updated_at"])
    last = _sections(spark, sf_dir).select("section_key", "updated_at")
    return read_table(spark, sf_dir, "doc_registry"), blocks, sections.join(last, ["section_key", "updated_at"]), D.page_index(blocks)


def _codec(spark, sf_dir) -> DataFrame:
    return J.to_json(*_codec_tables(spark, sf_dir))


@query(f"""WITH {_BLOCKS}, {_SECTIONS}, r AS (SELECT doc_id FROM doc_registry), pg AS ({ORACLE['page_index'].replace('WITH ' + _BLOCKS + ',', 'WITH ')}), c AS (SELECT doc_id, 1 AS part, count(*) AS n FROM pg GROUP BY doc_id UNION ALL SELECT doc_id, 3, count(*) FROM s GROUP BY doc_id UNION ALL SELECT doc_id, 5, count(*) FROM b GROUP BY doc_id UNION ALL SELECT doc_id, unnest([0, 2, 4, 6]), 1 FROM r)
  SELECT doc_id, CAST(part AS INT) AS part, n AS n_pieces, n - 1 AS last_pos, CASE WHEN part % 2 = 1 THEN n - 1 ELSE 0 END AS n_commas FROM c SEMI JOIN r USING (doc_id)""")
def canonical_parts(spark, sf_dir):
    """The pieces of every document's JSON: how many a part has, and that all but the first begin with a comma."""
    parts = J.document_parts(*_codec_tables(spark, sf_dir))
    comma = F.count_if((F.col("part") % 2 == 1) & F.col("piece").startswith(","))
    return parts.groupBy("doc_id", "part").agg(F.count("*").alias("n_pieces"), F.max("pos").alias("last_pos"), comma.alias("n_commas"))


@query(f"WITH {_BLOCKS}, {_SECTIONS} SELECT r.doc_id, r.source_path, (SELECT count(*) FROM b WHERE b.doc_id = r.doc_id) AS n_blocks, (SELECT count(*) FROM s WHERE s.doc_id = r.doc_id) AS n_sections FROM doc_registry r")
def canonical_round_trip(spark, sf_dir):
    """Documents written as JSON and read back."""
    doc = J.from_json(_codec(spark, sf_dir)).where("problem is null")
    return doc.select("doc_id", F.col("doc.metadata.source_path").alias("source_path"), F.size("doc.blocks").cast("bigint").alias("n_blocks"), F.size("doc.sections").cast("bigint").alias("n_sections"))


def _read_back(spark, sf_dir) -> DataFrame:
    """Documents written as JSON and read again, without those refused."""
    return J.from_json(_codec(spark, sf_dir)).where("problem is null")


_MAP = lambda m: f"nullif(array_to_string(list_sort(list_transform(map_entries({m}), lambda e: concat(e.key, '=', e.value))), ';'), '')"


def _map_text(c):
    """A map as sorted text, null if it is empty."""
    lines = F.array_join(F.sort_array(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"].cast("string"), F.lit(""))))), ";")
    return F.when(lines != "", lines)


@query(f"""WITH {_BLOCKS} SELECT block_key, doc_id, block_id, block_type, ord, page, text, heading_level, array_to_string(table_data.headers, '|') AS headers, array_to_string(list_transform(table_data.body_rows, lambda r: array_to_string(r, '|')), chr(10)) AS body, table_data.caption AS caption,
  image.uri AS uri, image.alt AS alt, image.caption AS image_caption, bbox.x0 AS x0, bbox.y0 AS y0, bbox.x1 AS x1, bbox.y1 AS y1, bbox.coord_origin AS coord_origin, source_ref, {_MAP('metadata')} AS metadata FROM b WHERE doc_id IN (SELECT doc_id FROM doc_registry WHERE source_path <> '')""")
def canonical_blocks_read(spark, sf_dir):
    """Every field of every block after a round trip through JSON."""
    x = _read_back(spark, sf_dir).select("doc_id", F.explode("doc.blocks").alias("x"))
    keys = _blocks(spark, sf_dir).select("block_key", "doc_id", "block_id")
    read = x.select(
        "doc_id", F.col("x.id").alias("block_id"), F.col("x.type").alias("block_type"), F.col("x.order").alias("ord"), "x.page", "x.text", F.col("x.level").alias("heading_level"), F.array_join("x.table.headers", "|").alias("headers"),
        F.array_join(F.transform("x.table.rows", lambda r: F.array_join(r, "|")), "\n").alias("body"), F.col("x.table.caption").alias("caption"), "x.image.uri", "x.image.alt", F.col("x.image.caption").alias("image_caption"), "x.bbox.x0", "x.bbox.y0", "x.bbox.x1", "x.bbox.y1", "x.bbox.coord_origin", "x.source_ref", _map_text(F.col("x.metadata")).alias("metadata"),
    )
    return read.join(keys, ["doc_id", "block_id"])


@query(f"""WITH {_BLOCKS}, u AS (SELECT doc_id, block_id, page AS bp, bbox AS bb, source_ref AS br, len(layout_spans) AS n, unnest(layout_spans) AS x, generate_subscripts(layout_spans, 1) - 1 AS span_no FROM b)
  SELECT doc_id, block_id, CAST(span_no AS INT) AS span_no, x.page AS page, x.bbox.x0 AS x0, x.bbox.y0 AS y0, x.bbox.x1 AS x1, x.bbox.y1 AS y1, x.bbox.coord_origin AS coord_origin, x.source_ref AS source_ref FROM u
  WHERE doc_id IN (SELECT doc_id FROM doc_registry WHERE source_path <> '') AND NOT (n = 1 AND x.page IS NOT DISTINCT FROM bp AND x.bbox IS NOT DISTINCT FROM bb AND x.source_ref IS NOT DISTINCT FROM br)""")
def canonical_spans_read(spark, sf_dir):
    """Every layout span after a round trip through JSON; a single one that says no more than its block is not written."""
    x = _read_back(spark, sf_dir).select("doc_id", F.explode("doc.blocks").alias("b")).select("doc_id", F.col("b.id").alias("block_id"), F.posexplode("b.layout_spans").alias("span_no", "x"))
    return x.select("doc_id", "block_id", "span_no", "x.page", "x.bbox.x0", "x.bbox.y0", "x.bbox.x1", "x.bbox.y1", "x.bbox.coord_origin", "x.source_ref")


@query(f"""WITH {_SECTIONS} SELECT doc_id, section_id, coalesce(title, '') AS title, section_level AS level, ord, parent_id, nullif(array_to_string(block_ids, ','), '') AS block_ids, page_start, page_end, {_MAP('metadata')} AS metadata FROM s WHERE doc_id IN (SELECT doc_id FROM doc_registry WHERE source_path <> '')""")
def canonical_sections_read(spark, sf_dir):
    """Every field of every section after a round trip through JSON."""
    x = _read_back(spark, sf_dir).select("doc_id", F.explode("doc.sections").alias("x"))
    ids = F.array_join("x.block_ids", ",")
    return x.select("doc_id", F.col("x.id").alias("section_id"), "x.title", "x.level", F.col("x.order").alias("ord"), "x.parent_id", F.when(ids != "", ids).alias("block_ids"), "x.page_start", "x.page_end", _map_text(F.col("x.metadata")).alias("metadata"))


_PICK = lambda names, inside: f"map_from_entries(list_filter(map_entries(extra), lambda e: {'' if inside else 'NOT '}list_contains([{', '.join(repr(n) for n in names)}], e.key) AND coalesce(e.value, '') <> ''))"


@query(f"""SELECT doc_id, source_path, nullif(title, '') AS title, parser, profile_id, extra['docling_version'] AS docling_version, extra['family'] AS family, {_MAP(_PICK(J.IDENTITY, True))} AS identity,
  {_MAP(_PICK(J.STATS, True))} AS stats, {_MAP(_PICK(J.INGEST, True))} AS ingest, {_MAP(_PICK(('family', 'docling_version', *J.STATS, *J.IDENTITY, *J.INGEST), False))} AS extra FROM doc_registry WHERE source_path <> ''""")
def canonical_metadata_read(spark, sf_dir):
    """The metadata of every document after a round trip through JSON."""
    m = _read_back(spark, sf_dir).select("doc_id", "doc.metadata.*")
    return m.select("doc_id", "source_path", "title", "parser", "profile_id", "docling_version", "family", *[_map_text(F.col(c)).alias(c) for c in ("identity", "stats", "ingest", "extra")])


@query()
def canonical_json(spark, sf_dir):
    return _codec(spark, sf_dir)


@query(f"""WITH {_BLOCKS}, {_RENDERED}, {_SECTIONS}, bo AS (SELECT doc_id, count(*) AS nb, string_agg(CASE WHEN markdown <> '' THEN markdown END, chr(10) || chr(10) ORDER BY ord, block_id) AS body FROM md GROUP BY doc_id), se AS (SELECT doc_id, count(*) AS ns FROM s GROUP BY doc_id)
  SELECT r.doc_id, concat('# ', coalesce(r.title, 'Untitled'), chr(10), chr(10), '- blocks: ', coalesce(nb, 0), chr(10), '- sections: ', coalesce(ns, 0), chr(10), chr(10), coalesce(body, '')) AS markdown FROM doc_registry r LEFT JOIN bo USING (doc_id) LEFT JOIN se USING (doc_id)""")
def canonical_markdown(spark, sf_dir):
    return J.to_markdown(read_table(spark, sf_dir, "doc_registry"), _blocks(spark, sf_dir), _sections(spark, sf_dir))


@query(f"WITH {_SECTIONS} SELECT doc_id, string_agg(concat(repeat('  ', greatest(coalesce(section_level, 1), 1) - 1), '- ', {_strip("coalesce(title, '')")}), chr(10) ORDER BY ord NULLS FIRST, section_id) AS outline FROM s GROUP BY doc_id")
def section_outline(spark, sf_dir):
    return J.outline(_sections(spark, sf_dir))


@query(f"""WITH {_BLOCKS}, n AS (SELECT doc_id, max(page) AS n_pages FROM b GROUP BY doc_id) SELECT doc_id, CAST(unnest(generate_series(1, n_pages, 20)) AS INT) AS first_page, CAST(least(unnest(generate_series(1, n_pages, 20)) + 19, n_pages) AS INT) AS last_page FROM n WHERE n_pages >= 1""")
def page_ranges(spark, sf_dir):
    pages = _blocks(spark, sf_dir).groupBy("doc_id").agg(F.max("page").alias("n_pages"))
    return X.page_ranges(pages, "n_pages", 20).select("doc_id", "first_page", "last_page")


@query(rf"WITH l AS (SELECT doc_id, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS n_lines, sum(length({_strip('line')})) AS n_chars FROM l WHERE {_strip('line')} <> '' AND NOT regexp_matches({_strip('line')}, '^[_—\- \x{{a0}}]+$') GROUP BY doc_id")
def line_blocks(spark, sf_dir):
    return X.line_blocks(read_table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


_OBJECT = "concat('docs/', event_id, CASE event_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' WHEN 2 THEN '.docx' WHEN 3 THEN '.txt' ELSE '' END)"
_ETYPE = "CASE WHEN event_id % 7 = 0 THEN 'OBJECT_DELETE' WHEN event_id % 7 = 1 THEN '' ELSE 'OBJECT_FINALIZE' END"


@query(f"""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'rejected' WHEN event_id % 7 = 0 THEN 'ignored' WHEN event_id % 5 IN (0, 1) THEN 'accepted' ELSE 'rejected' END AS status,
  CASE WHEN event_id % 11 <> 0 THEN CASE WHEN event_id % 5 IN (0, 1) THEN 'pdf' WHEN event_id % 5 = 2 THEN 'word' ELSE 'unsupported' END END AS kind FROM events""")
def event_gate(spark, sf_dir):
    """Notifications made from the events table, parsed and gated."""
    e = read_table(spark, sf_dir, "events").select("event_id", F.expr(_OBJECT).alias("object"), F.expr(_ETYPE).alias("kind_"))
    attributes = F.create_map(F.lit("bucketId"), F.when(F.col("event_id") % 11 == 0, "").otherwise("mirror"), F.lit("objectId"), F.col("object"), F.lit("objectGeneration"), F.col("event_id").cast("string"), F.lit("eventType"), F.col("kind_"))
    return E.gate(e.select("event_id", F.to_json(F.struct(F.struct(attributes.alias("attributes")).alias("message"))).alias("body"))).select("event_id", "status", "kind")


@query("SELECT concat('user_', user_id) AS session_id, arg_max(concat(event_type, chr(10), props), event_id) AS response FROM events WHERE event_type <> 'view' GROUP BY user_id")
def final_responses(spark, sf_dir):
    """The last final message of each user, events standing for turns."""
    e = read_table(spark, sf_dir, "events")
    turns = e.select(F.concat(F.lit("user_"), "user_id").alias("session_id"), F.col("event_id").alias("turn"), (F.col("event_type") != "view").alias("is_final"), F.array("event_type", F.lit(""), "props").alias("parts"))
    return E.final_responses(turns)
