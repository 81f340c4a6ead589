"""Queries for sources, cleaning steps, profiles and sessions, with the SQL they are checked against.

Inputs that no test table has are made from those there are, in SQL that both engines read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import blocks as B
from folioforge.functions import text as T
from folioforge.operators import clean as P
from folioforge.operators import document as D
from folioforge.operators import index as I
from folioforge.operators import refine as R
from folioforge.plans.reference import _BLOCKS, _CHUNKS, _MAP, _REPEATED, _SECTIONS, _blocks, _chunks, _level, _map_text, _sections, _strip
from folioforge.runtime import read_table
from folioforge.sources import elements as L
from folioforge.sources import files as X
from folioforge.streaming import events as E

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


# --- files and shards -------------------------------------------------------------------------------------------------

_FILES = """files AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 0 WHEN doc_id % 9 = 1 THEN 300000000 ELSE 1000 + doc_id END AS length, CASE WHEN doc_id % 7 = 0 THEN '%PDX-1.4' WHEN doc_id % 7 = 1 THEN '%PDF' ELSE '%PDF-1.7' END AS head,
  CAST(doc_id % 120 AS INT) AS pages, CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id % 11 AS INT) END AS lo, CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id % 70 AS INT) END AS hi FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL))"""


@query(f"""WITH {_FILES} SELECT doc_id, CASE WHEN length = 0 THEN 'empty' WHEN length > 209715200 THEN 'too large' WHEN NOT starts_with(head, '%PDF-') THEN 'not a pdf' WHEN lo IS NOT NULL AND (lo < 1 OR lo > hi OR hi > pages) THEN 'bad range'
  WHEN lo IS NOT NULL AND hi - lo >= 50 THEN 'range too long' WHEN lo IS NULL AND pages > 50 THEN 'too many pages' END AS reason FROM files""")
def files_rejected(spark, sf_dir):
    """Files with sizes, first bytes, pages and ranges of every kind, and why they are refused."""
    read_table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    f = spark.sql(f"WITH {_FILES} SELECT * FROM files")
    return f.select("doc_id", X.reject_reason(F.col("length"), F.encode("head", "UTF-8"), F.col("pages"), F.col("lo"), F.col("hi"), max_pages=50).alias("reason"))


@query(f"""WITH {_BLOCKS}, n AS (SELECT doc_id, max(page) AS n_pages FROM b GROUP BY doc_id HAVING max(page) >= 1), r AS (SELECT doc_id, n_pages, CAST(unnest(generate_series(0, (n_pages - 1) // 4)) AS INT) AS shard FROM n), f AS (SELECT *, n_pages % 5 = 0 OR (shard + n_pages) % 3 = 0 AS bad FROM r)
  SELECT doc_id, coalesce(string_agg(CASE WHEN bad THEN CAST(shard AS VARCHAR) END, ',' ORDER BY shard), '') AS failed_shards, CASE WHEN bool_and(bad) THEN 'every shard failed' END AS problem, sum(CASE WHEN NOT bad THEN least(4, n_pages - shard * 4) ELSE 0 END) AS n_blocks FROM f GROUP BY doc_id""")
def shards_read(spark, sf_dir):
    """Page ranges read by a parser that fails on some: failed shards, refused documents, blocks read (one a page)."""
    pages = _blocks(spark, sf_dir).groupBy("doc_id").agg(F.max("page").alias("n_pages"))

    def parse(row: dict) -> list[dict]:
        if row["n_pages"] % 5 == 0 or (row["shard"] + row["n_pages"]) % 3 == 0:
            raise ValueError("this page range can't be read")
        return [{"page": p} for p in range(row["first_page"], row["last_page"] + 1)]

    shards = X.read_shards(X.page_ranges(pages, "n_pages", 4), parse, pa.struct([("page", pa.int32())]))
    read = shards.groupBy("doc_id").agg(F.sum(F.coalesce(F.size("blocks"), F.lit(0))).alias("n_blocks"))
    return X.require_some(shards, ["doc_id"]).join(read.select("doc_id", F.greatest("n_blocks", F.lit(0)).alias("n_blocks")), "doc_id")


@query(f"""WITH {_BLOCKS}, p AS (SELECT *, CAST(ord // 40 AS INT) AS shard, (ord // 40) * 7 AS shift FROM b)
  SELECT block_key, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY shard, ord, block_id) - 1 AS INT) AS ord, CAST(page + shift AS INT) AS page, CASE WHEN TRY_CAST(metadata['page_end'] AS INT) IS NOT NULL THEN CAST(CAST(metadata['page_end'] AS INT) + shift AS VARCHAR) ELSE metadata['page_end'] END AS page_end,
    len(map_keys(metadata)) AS n_meta, nullif(array_to_string(list_transform(layout_spans, lambda x: CAST(x.page + shift AS VARCHAR)), ','), '') AS span_pages FROM p""")
def shards_joined(spark, sf_dir):
    """Blocks cut into shards, each numbered from its own first page, joined with pages, page ends and span pages shifted."""
    cut = _blocks(spark, sf_dir).withColumn("shard", F.expr("cast(ord div 40 as int)")).withColumn("page_offset", F.expr("cast((ord div 40) * 7 as int)"))
    spans = F.array_join(F.transform("layout_spans", lambda s: s["page"].cast("string")), ",")
    return R.join_shards(cut).select("block_key", "ord", "page", F.col("metadata")["page_end"].alias("page_end"), F.size("metadata").cast("bigint").alias("n_meta"), F.when(spans != "", spans).alias("span_pages"))


# --- elements ---------------------------------------------------------------------------------------------------------

#: A parser's elements made from the blocks: every label, page furniture, captions and footnotes named by other elements.
_ELEMENTS = """one AS (SELECT block_key, min(doc_id) AS doc_id, min(block_id) AS block_id, min(block_type) AS block_type, min(ord) AS ord, min(page) AS page, min(text) AS text, min(heading_level) AS heading_level FROM blocks WHERE block_key IS NOT NULL AND doc_id IS NOT NULL GROUP BY block_key),
el AS (SELECT block_key, doc_id, ord, page, heading_level AS level, concat('#/', block_id) AS ref, CASE WHEN ord % 17 = 0 THEN 'furniture' ELSE 'body' END AS layer,
    CASE block_type WHEN 'heading' THEN CASE WHEN ord % 5 = 0 THEN 'title' ELSE 'section_header' END WHEN 'image' THEN 'picture' WHEN 'table' THEN CASE WHEN ord % 7 = 0 THEN 'document_index' ELSE 'table' END WHEN 'paragraph' THEN CASE WHEN ord % 11 = 0 THEN 'page_header' WHEN ord % 13 = 0 THEN 'Text' ELSE 'text' END ELSE block_type END AS label,
    CASE WHEN ord % 19 = 0 THEN '____' WHEN ord % 23 = 0 THEN '  ' ELSE text END AS text, CASE WHEN block_type IN ('table', 'image') THEN concat('#/', lead(block_id) OVER (PARTITION BY doc_id ORDER BY ord, block_id)) END AS caption_ref, CASE WHEN ord % 29 = 0 THEN concat('#/', lag(block_id) OVER (PARTITION BY doc_id ORDER BY ord, block_id)) END AS note_ref FROM one)"""


@query(f"""WITH {_ELEMENTS}, bd AS (SELECT * FROM el WHERE layer = 'body'), linked AS (SELECT doc_id, caption_ref AS ref FROM bd WHERE caption_ref IS NOT NULL UNION SELECT doc_id, note_ref FROM bd WHERE note_ref IS NOT NULL),
  cap AS (SELECT a.doc_id, a.ref, min({_strip("coalesce(c.text, '')")}) AS caption FROM bd a JOIN bd c ON c.doc_id = a.doc_id AND c.ref = a.caption_ref WHERE {_strip("coalesce(c.text, '')")} <> '' GROUP BY a.doc_id, a.ref),
  kept AS (SELECT b.*, cap.caption, lower(label) AS lb, {_strip("coalesce(b.text, '')")} AS body FROM bd b LEFT JOIN cap ON cap.doc_id = b.doc_id AND cap.ref = b.ref WHERE NOT EXISTS (SELECT 1 FROM linked l WHERE l.doc_id = b.doc_id AND l.ref = b.ref)),
  typed AS (SELECT *, CASE WHEN lb IN ('title', 'section_header') THEN 'heading' WHEN lb IN ('list_item', 'code', 'formula', 'table') THEN lb WHEN lb = 'picture' THEN 'image' WHEN lb = 'document_index' THEN 'table' ELSE 'paragraph' END AS kind FROM kept WHERE lb NOT IN ('page_header', 'page_footer', 'document_index')),
  shown AS (SELECT * FROM typed WHERE kind IN ('table', 'image') OR body <> '' AND NOT (kind = 'paragraph' AND regexp_matches(body, '^[_—\\- \\x{{a0}}]+$')))
  SELECT doc_id, ref AS source_ref, kind AS block_type, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord, ref) - 1 AS INT) AS ord, page, CASE WHEN kind NOT IN ('table', 'image') THEN body END AS text,
    CASE WHEN kind = 'heading' THEN coalesce({_level('body')}, CASE WHEN lb = 'section_header' AND coalesce(level, 0) <> 0 THEN level ELSE 1 END) END AS heading_level, CASE WHEN kind IN ('table', 'image') THEN caption END AS caption FROM shown""")
def elements_mapped(spark, sf_dir):
    """A parser's elements as blocks: labels, captions, furniture, rules and heading levels."""
    read_table(spark, sf_dir, "blocks").createOrReplaceTempView("blocks")
    el = spark.sql(f"WITH {_ELEMENTS} SELECT * FROM el")
    listed = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    none = F.lit(None).cast("struct<l:double,t:double,r:double,b:double,coord_origin:string>")
    shaped = el.select("doc_id", "ord", "ref", "layer", "label", "text", "level", listed("caption_ref").alias("captions"), listed("note_ref").alias("footnotes"), F.lit(None).cast("array<array<struct<text:string,column_header:boolean>>>").alias("grid"), F.array(F.struct(F.col("page").alias("page_no"), none.alias("bbox"))).alias("prov"))
    made = L.map_elements(shaped)
    return made.select("doc_id", "source_ref", "block_type", "ord", "page", "text", "heading_level", F.coalesce("table_data.caption", "image.caption").alias("caption"))


@query(f"""WITH {_BLOCKS}, t AS (SELECT block_key, [table_data.headers] || table_data.body_rows AS g, ord % 3 AS heads FROM b WHERE block_type = 'table' AND table_data IS NOT NULL AND len(table_data.headers) > 0),
  w AS (SELECT *, list_max(list_transform(g[1:heads], lambda r: len(r))) AS width FROM t)
  SELECT block_key, CASE WHEN heads = 0 THEN '' ELSE array_to_string(list_transform(range(width), lambda i: array_to_string(list_filter(list_transform(g[1:heads], lambda r: {_strip("coalesce(r[i + 1], '')")}), lambda x: x <> ''), ' ')), '|') END AS headers,
    array_to_string(list_transform(g[heads + 1:], lambda r: array_to_string(list_transform(r, lambda c: {_strip("coalesce(c, '')")}), '|')), chr(10)) AS body FROM w""")
def grids_read(spark, sf_dir):
    """Grids of cells with no, one or two header rows as tables; header rows are folded per column."""
    t = _blocks(spark, sf_dir).where("block_type = 'table' and table_data is not null and size(table_data.headers) > 0")
    rows = F.concat(F.array("table_data.headers"), "table_data.body_rows")
    grid = F.transform(rows, lambda r, i: F.transform(r, lambda c: F.struct(c.alias("text"), (i < F.col("ord") % 3).alias("column_header"))))
    return t.select("block_key", X.grid_table(grid).alias("t")).select("block_key", F.array_join("t.headers", "|").alias("headers"), F.array_join(F.transform("t.body_rows", lambda r: F.array_join(r, "|")), "\n").alias("body"))


@query(f"""WITH {_BLOCKS} SELECT block_key, CASE WHEN coalesce(upper(split_part(bbox.coord_origin, '.', -1)), '') = '' THEN 'BOTTOMLEFT' ELSE upper(split_part(bbox.coord_origin, '.', -1)) END AS origin, CASE WHEN coalesce(len(layout_spans), 0) > 0 THEN len(layout_spans) ELSE 1 END AS n_places,
  CASE WHEN coalesce(len(layout_spans), 0) > 0 THEN layout_spans[1].page ELSE page END AS first_page, CASE WHEN coalesce(len(layout_spans), 0) > 0 THEN layout_spans[1].bbox.x0 ELSE bbox.x0 END AS first_x0 FROM b""")
def block_places(spark, sf_dir):
    """Where blocks stand: their spans, or the one made of their own page and box."""
    places = B.layout(F.col("layout_spans"), F.col("page"), F.col("bbox"), F.col("source_ref"))
    return _blocks(spark, sf_dir).select("block_key", B.coord_origin(F.col("bbox.coord_origin")).alias("origin"), F.size(places).cast("bigint").alias("n_places"), places[0]["page"].alias("first_page"), places[0]["bbox"]["x0"].alias("first_x0"))


# --- cleaning ---------------------------------------------------------------------------------------------------------


_LOGOS = f"{_BLOCKS}, n AS (SELECT doc_id, count(DISTINCT page) AS n_pages FROM b WHERE page IS NOT NULL GROUP BY doc_id), im AS (SELECT b.doc_id, coalesce(image.alt, image.uri, 'none') AS image, n_pages FROM b JOIN n USING (doc_id) WHERE block_type = 'image')"


@query(f"WITH {_LOGOS} SELECT doc_id, image, count(*) AS n FROM im GROUP BY doc_id, image HAVING count(*) / max(n_pages) >= 0.02")
def repeated_logos(spark, sf_dir):
    """Images that occur on the given share of a document's pages, every occurrence counted."""
    b = _blocks(spark, sf_dir)
    pages = b.where("page is not null").groupBy("doc_id").agg(F.count_distinct("page").alias("n_pages"))
    images = b.where("block_type = 'image'").select("doc_id", F.coalesce("image.alt", "image.uri", F.lit("none")).alias("image")).join(pages, "doc_id")
    return P.repeated_images(images, 0.02)


_CLUTTER = f"coalesce(page = 1 AND (block_type = 'image' OR ({_strip("coalesce(text, '')")} <> '' AND (zone = 'bottom' OR regexp_matches(lower(text), '{T.BOILERPLATE}')))), false)"
_EDGE = "coalesce(block_type = 'image' AND ((bbox.y0 + bbox.y1) / 2 < 0.15 * 842.0 OR (bbox.y0 + bbox.y1) / 2 > 0.85 * 842.0), false)"


@query(f"""WITH {_REPEATED}, m AS (SELECT z.*, rep.norm IS NOT NULL AS again FROM z LEFT JOIN rep ON rep.doc_id = z.doc_id AND rep.norm = z.norm AND rep.zone = z.zone)
  SELECT steps, count(*) AS n_blocks, CAST(sum(block_key) AS BIGINT) AS keys FROM (SELECT unnest(['repeated', 'cover', 'edges', 'all', 'none']) AS steps) s, m WHERE NOT (steps IN ('repeated', 'all') AND again OR steps IN ('cover', 'all') AND {_CLUTTER} OR steps IN ('edges', 'all') AND {_EDGE}) GROUP BY steps""")
def cleaning_steps(spark, sf_dir):
    """What each step of the physical cleaning leaves, alone, together and switched off."""
    b, out = _blocks(spark, sf_dir), None
    for steps in ("repeated", "cover", "edges", "all", "none"):
        on = lambda name: steps in (name, "all")  # noqa: E731, B023
        left = P.clean_physical(b, on("repeated"), on("edges"), on("cover")).agg(F.count("*").alias("n_blocks"), F.sum("block_key").cast("bigint").alias("keys")).select(F.lit(steps).alias("steps"), "n_blocks", "keys")
        out = left if out is None else out.unionByName(left)
    return out


# --- profiles, navigation, sessions ------------------------------------------------------------------------------------

#: Profiles of a registry: name, group, document types, words of the subject; the first that fits counts.
SPECS = (("wg4_tables", "wg4", (), ("table", "test")), ("wg4", "WG4", (), ()), ("typed", None, ("ts", "o1"), ()), ("worded", None, (), ("ARCH", "interface")), ("oran_default", None, (), ()))
_NAME = r"(?i)^O-RAN\.(WG\d+|[A-Za-z]+FG)((?:\.[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*?)+)(?:-R(\d+))?-v(\d{2}\.\d{2})$"


@query(f"""WITH r AS (SELECT doc_id, regexp_extract(source_path, '[^/]*$') AS name FROM doc_registry), n AS (SELECT doc_id, CASE WHEN regexp_matches(name, '.\\.[^.]*$') THEN regexp_replace(name, '\\.[^.]*$', '') ELSE name END AS stem FROM r),
  p AS (SELECT *, regexp_matches(stem, '{_NAME}') AS ok, regexp_extract(stem, '{_NAME}', 1) AS grp, string_split(ltrim(regexp_extract(stem, '{_NAME}', 2), '.'), '.') AS seg FROM n),
  i AS (SELECT *, lower(seg[1]) AS typ, lower(CASE WHEN len(seg) > 1 THEN array_to_string(seg[2:], '-') ELSE seg[1] END) AS subject FROM p)
  SELECT doc_id, CASE WHEN NOT ok THEN 'default' WHEN upper(grp) = 'WG4' AND (contains(subject, 'table') OR contains(subject, 'test')) THEN 'wg4_tables' WHEN upper(grp) = 'WG4' THEN 'wg4' WHEN typ IN ('ts', 'o1') THEN 'typed' WHEN contains(subject, 'arch') OR contains(subject, 'interface') THEN 'worded' ELSE 'oran_default' END AS profile_id FROM i""")
def profiles_chosen(spark, sf_dir):
    """The profile of every document from a registry with groups, types and words of the subject."""
    return read_table(spark, sf_dir, "doc_registry").select("doc_id", T.profile_id(T.document_identity(F.col("source_path")), SPECS).alias("profile_id"))


@query(f"""WITH {_BLOCKS}, {_SECTIONS}, d AS (SELECT min(doc_id) AS doc_id FROM b), x AS (SELECT b.*, list_distinct(list_filter(list_transform(layout_spans, lambda z: z.page), lambda p: p IS NOT NULL)) AS known, coalesce(TRY_CAST(metadata['page_end'] AS INT), page) AS pe FROM b JOIN d USING (doc_id)),
  r AS (SELECT arg_min(section_id, concat(lpad(CAST(ord AS VARCHAR), 10, '0'), section_id)) AS section_id FROM s JOIN d USING (doc_id) WHERE coalesce(parent_id, '') = '')
  SELECT 'block' AS kind, block_id AS id FROM x WHERE CASE WHEN len(known) > 0 THEN list_contains(known, 2) ELSE 2 BETWEEN least(page, pe) AND greatest(page, pe) END UNION ALL SELECT 'child', s.section_id FROM s JOIN d USING (doc_id) JOIN r ON s.parent_id = r.section_id""")
def navigation(spark, sf_dir):
    """Of the least document: the blocks on page 2, and the sections below its first root."""
    b, s = _blocks(spark, sf_dir), _sections(spark, sf_dir)
    doc = b.agg(F.min("doc_id")).first()[0]
    root = D.roots(s.where(F.col("doc_id") == doc)).orderBy("ord", "section_id").first()
    page = D.blocks_of_page(b, doc, 2).select(F.lit("block").alias("kind"), F.col("block_id").alias("id"))
    return page.unionByName(D.children(s, doc, root.section_id if root else "").select(F.lit("child").alias("kind"), F.col("section_id").alias("id")))


_ASKED = "asked AS (SELECT 'app' AS app, concat('', user_id) AS user_id, concat('s', event_id % 3) AS session_id, event_id AS turn, CASE WHEN event_id % 5 = 0 THEN '  ' WHEN event_id % 5 = 1 THEN NULL ELSE event_type END AS message FROM events), old AS (SELECT DISTINCT 'app' AS app, concat('', user_id) AS user_id, 's0' AS session_id FROM events WHERE user_id % 2 = 0)"


@query(f"""WITH {_ASKED}, ok AS (SELECT *, coalesce(trim(message), '') <> '' AS good FROM asked), al AS (SELECT app, user_id, session_id, true AS was FROM old UNION ALL (SELECT app, user_id, session_id, false FROM ok WHERE good EXCEPT SELECT app, user_id, session_id, false FROM old))
  SELECT 'turn' AS kind, user_id, session_id, turn, CASE WHEN good AND message <> 'view' THEN upper(message) END AS response, CASE WHEN NOT good THEN 'blank message' WHEN message = 'view' THEN 'empty answer' END AS problem FROM ok UNION ALL SELECT 'session', user_id, session_id, NULL, NULL, NULL FROM al""")
def chat_turns(spark, sf_dir):
    """Chat turns made from events: blank messages refused, empty answers reported, sessions made as needed."""
    read_table(spark, sf_dir, "events").createOrReplaceTempView("events")
    asked, old = spark.sql(f"WITH {_ASKED} SELECT * FROM asked"), spark.sql(f"WITH {_ASKED} SELECT * FROM old")
    turns, sessions = E.chat_turns(asked, old, lambda m: F.when(m == "view", " ").otherwise(F.upper(m)))
    none = lambda c, kind="string": F.lit(None).cast(kind).alias(c)
    shown = sessions.select(F.lit("session").alias("kind"), "user_id", "session_id", none("turn", "bigint"), none("response"), none("problem"))
    return turns.select(F.lit("turn").alias("kind"), "user_id", "session_id", "turn", "response", "problem").unionByName(shown)


@query(f"""WITH {_ASKED}, w AS (SELECT DISTINCT app, user_id, session_id FROM asked WHERE turn % 10 = 0) SELECT user_id, session_id, CAST(CASE WHEN state = 'old' THEN 1 ELSE 0 END AS BIGINT) AS kept FROM (SELECT app, user_id, session_id, 'old' AS state FROM old WHERE (app, user_id, session_id) NOT IN (SELECT app, user_id, session_id FROM w) UNION ALL SELECT app, user_id, session_id, NULL FROM w)""")
def sessions_reset(spark, sf_dir):
    """Sessions of which some are deleted and made anew, without their state."""
    read_table(spark, sf_dir, "events").createOrReplaceTempView("events")
    asked, old = spark.sql(f"WITH {_ASKED} SELECT * FROM asked"), spark.sql(f"WITH {_ASKED} SELECT * FROM old")
    reset = E.reset_sessions(old.withColumn("state", F.lit("old")), asked.where("turn % 10 = 0"))
    return reset.select("user_id", "session_id", F.when(F.col("state").isNotNull(), 1).otherwise(0).cast("bigint").alias("kept"))


# --- points -------------------------------------------------------------------------------------------------------------


@query(f"""WITH {_CHUNKS}, t AS (SELECT chunk_key, coalesce(text, '') AS x, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS ts FROM c)
  SELECT CAST(chunk_key AS VARCHAR) AS id, CAST(length(x) AS DOUBLE) AS first_, CAST(length(x) - length(replace(x, 'a', '')) AS DOUBLE) AS second_, CASE WHEN len(ts) > 0 THEN CAST(len(ts) AS INT) END AS n_terms FROM t""")
def hybrid_points(spark, sf_dir):
    """Dense vectors of a stand-in encoder, in batches, with the sparse vectors beside them; chunks without a word have none."""
    chunks = _chunks(spark, sf_dir)

    def encoder(texts: list[str]) -> list[list[float]]:
        if len(texts) > 8:
            raise AssertionError("the batch is larger than said")
        return [[float(len(t)), float(t.count("a"))] for t in texts]

    dense = I.embed_texts(chunks, encoder, batch=8, id_col="chunk_key")
    sparse = I.sparse_weights(chunks, "chunk_key", "text", dim=1 << 30).withColumn("id", F.col("id").cast("string"))
    at = lambda i: F.get("dense", F.lit(i)).cast("double")
    return I.hybrid(dense, sparse).select("id", at(0).alias("first_"), at(1).alias("second_"), F.when(F.col("sparse").isNotNull(), F.size("sparse.indices")).alias("n_terms"))


@query(f"WITH {_CHUNKS} SELECT chunk_key, chunk_id, doc_id, text, nullif(array_to_string(block_ids, ','), '') AS block_ids, {_MAP('metadata')} AS metadata, page_start, page_end, section_id FROM c")
def point_payloads(spark, sf_dir):
    """The JSON payloads of all chunks, read back."""
    names = ("chunk_id", "doc_id", "text", "block_ids", "metadata", "page_start", "page_end", "section_id")
    shape = "chunk_id string, doc_id string, text string, block_ids array<string>, metadata map<string,string>, page_start int, page_end int, section_id string"
    read = _chunks(spark, sf_dir).select("chunk_key", F.from_json(I.payload({n: F.col(n) for n in names}), shape).alias("p")).select("chunk_key", "p.*")
    ids = F.array_join("block_ids", ",")
    return read.withColumn("block_ids", F.when(ids != "", ids)).withColumn("metadata", _map_text(F.col("metadata")))
