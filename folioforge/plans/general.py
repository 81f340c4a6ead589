"""Queries p1_ and p2_: nested records and hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import hierarchy as H
from folioforge.operators import nested as N
from folioforge.runtime import read_table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.record_links(read_table(spark, sf_dir, "canonical_records"))


def p1_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.node_tables(read_table(spark, sf_dir, "canonical_records"))["sections"]


def p1_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.node_tables(read_table(spark, sf_dir, "canonical_records"))["blocks"]


def p1_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.node_tables(read_table(spark, sf_dir, "canonical_records"))["table_rows"].withColumn("cells", F.to_json("cells"))


def p1_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.node_tables(read_table(spark, sf_dir, "canonical_records"))["spans"]


def p1_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.node_tables(read_table(spark, sf_dir, "canonical_records"))["extra"]


def p1_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that hold no document, with the reason."""
    return N.rejected_records(read_table(spark, sf_dir, "canonical_records"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = H.hierarchy_labels(H.section_links(read_table(spark, sf_dir, "sections")))
    return H.closure(labels).select(F.col("ancestor").alias("ancestor_key"), F.col("key").alias("section_key"))


def p2_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.hierarchy(read_table(spark, sf_dir, "sections")).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ">"))


QUERIES = {f.__name__: f for f in (p1_found, p1_sections, p1_blocks, p1_table_rows, p1_spans, p1_extra, p1_rejected, p2_found, p2_hierarchy)}

_VALID = """
WITH RECURSIVE latest AS (
  SELECT section_key, doc_id, section_id, parent_id FROM (
    SELECT *, row_number() OVER (PARTITION BY section_key ORDER BY updated_at DESC, doc_id DESC, section_id DESC, parent_id DESC NULLS LAST) AS rn
    FROM sections WHERE section_key IS NOT NULL) WHERE rn = 1),
named AS (SELECT doc_id, section_id, min(section_key) AS parent FROM latest GROUP BY doc_id, section_id),
links AS (SELECT l.section_key, n.parent FROM latest l LEFT JOIN named n ON n.doc_id = l.doc_id AND n.section_id = l.parent_id),
reach AS (
  SELECT parent AS ancestor_key, section_key FROM links WHERE parent IS NOT NULL
  UNION
  SELECT l.parent, r.section_key FROM reach r JOIN links l ON l.section_key = r.ancestor_key WHERE l.parent IS NOT NULL)
"""

#: Above, with loops cut above their smallest key: one row per section with the keys from its root on.
TREE = _VALID + """, loops AS (SELECT a.section_key, min(b.section_key) AS head FROM reach a JOIN reach b ON b.ancestor_key = a.section_key WHERE a.ancestor_key = a.section_key
  AND EXISTS (SELECT 1 FROM reach c WHERE c.ancestor_key = b.section_key AND c.section_key = a.section_key) GROUP BY a.section_key),
cut AS (SELECT l.section_key, CASE WHEN o.head = l.section_key THEN NULL ELSE l.parent END AS parent, o.section_key IS NOT NULL AS on_loop FROM links l LEFT JOIN loops o USING (section_key)),
tree AS (SELECT section_key, [section_key] AS path, on_loop FROM cut WHERE parent IS NULL
  UNION ALL
  SELECT c.section_key, list_append(t.path, c.section_key), c.on_loop FROM tree t JOIN cut c ON c.parent = t.section_key)"""

#: The nodes of every record's document by their place in the JSON tree: sections, blocks, listed ids, parts and values of extra.
_RECORDS = r"""WITH RECURSIVE r AS (SELECT DISTINCT record_id, payload FROM canonical_records WHERE record_id IS NOT NULL AND payload IS NOT NULL AND json_valid(payload)),
q AS (SELECT record_id, CAST(payload AS JSON) AS j FROM r UNION ALL SELECT record_id, CAST(j->>'$' AS JSON) FROM q WHERE json_type(j) = 'VARCHAR' AND json_valid(j->>'$')),
t AS (SELECT q.record_id, x.key, x.value, x.type, x.id, x.parent, x.fullkey FROM q, json_tree(q.j) x WHERE json_type(q.j) <> 'VARCHAR'),
f AS (SELECT record_id, parent AS id, bool_or(key IN ('id', 'title', 'level') AND type <> 'OBJECT') AS one_section, bool_or(key IN ('id', 'type', 'text') AND type <> 'OBJECT') AS one_block, bool_or(key = 'id') AS has_id, max(CASE WHEN key = 'id' THEN value->>'$' END) AS own_id,
  nullif(max(CASE WHEN key = 'parent_id' THEN value->>'$' END), '') AS ref, bool_or(key = 'schema_version') OR bool_or(key IN ('sections', 'blocks') AND type IN ('OBJECT', 'ARRAY')) AS is_doc FROM t GROUP BY record_id, parent),
n AS (SELECT t.*, coalesce(one_section, false) AS one_section, coalesce(one_block, false) AS one_block, coalesce(has_id, false) AS has_id, own_id, ref, coalesce(is_doc, false) AND type = 'OBJECT' AS is_doc FROM t LEFT JOIN f USING (record_id, id)),
doc AS (SELECT record_id, arg_min(id, len(regexp_extract_all(fullkey, '[.\[]')) * 1000000 + id) AS id FROM n WHERE is_doc GROUP BY record_id),
role AS (SELECT record_id, id, 'doc' AS kind, false AS keyed, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS UBIGINT) AS sec, CAST(NULL AS VARCHAR) AS ref FROM doc
  UNION ALL
  SELECT n.record_id, n.id, k.kind, p.kind IN ('doc', 'section') AND n.type = 'OBJECT', CASE WHEN k.kind IN ('section', 'block') THEN CASE WHEN n.has_id THEN n.own_id WHEN p.kind IN ('sections', 'blocks') AND p.keyed THEN n.key END END,
    CASE WHEN p.kind = 'section' THEN p.id ELSE p.sec END, n.ref
  FROM role p JOIN n ON n.record_id = p.record_id AND n.parent = p.id, (SELECT CASE
    WHEN p.kind IN ('doc', 'section') AND (n.key = 'sections' OR p.kind = 'section' AND n.key IN ('subsections', 'children')) AND n.type IN ('ARRAY', 'OBJECT') THEN CASE WHEN n.type = 'OBJECT' AND n.one_section THEN 'section' ELSE 'sections' END
    WHEN p.kind IN ('doc', 'section') AND n.key = 'blocks' AND n.type IN ('ARRAY', 'OBJECT') THEN CASE WHEN n.type = 'OBJECT' AND n.one_block THEN 'block' ELSE 'blocks' END
    WHEN p.kind = 'sections' AND n.type = 'OBJECT' THEN 'section' WHEN p.kind = 'blocks' AND n.type = 'OBJECT' THEN 'block'
    WHEN p.kind = 'section' AND n.key = 'block_ids' THEN 'refs' WHEN p.kind = 'block' AND n.key IN ('table', 'layout_spans') THEN n.key END AS kind) k WHERE k.kind IS NOT NULL),
holder AS (SELECT a.*, s.name AS holder FROM role a LEFT JOIN role s ON s.record_id = a.record_id AND s.id = a.sec AND s.kind = 'section'),
listed AS (SELECT a.record_id, a.sec, n.value->>'$' AS bid FROM role a JOIN n ON n.record_id = a.record_id AND (n.parent = a.id AND (a.kind = 'refs' OR a.kind = 'blocks' AND NOT a.keyed) OR n.id = a.id AND a.kind = 'refs') WHERE a.sec IS NOT NULL AND n.type IN ('VARCHAR', 'BIGINT', 'UBIGINT')),
lister AS (SELECT l.record_id, l.bid, arg_min(s.name, s.id) AS name FROM listed l JOIN role s ON s.record_id = l.record_id AND s.id = l.sec AND s.kind = 'section' WHERE s.name IS NOT NULL GROUP BY l.record_id, l.bid),
part AS (SELECT b.record_id, 'table_row' AS kind, b.name, x.key FROM role b JOIN role p ON p.record_id = b.record_id AND p.kind = 'table' JOIN n pn ON pn.record_id = p.record_id AND pn.id = p.id AND pn.parent = b.id JOIN n y ON y.record_id = p.record_id AND y.parent = p.id AND y.key = 'rows' AND y.type = 'ARRAY' JOIN n x ON x.record_id = y.record_id AND x.parent = y.id WHERE b.kind = 'block'
  UNION ALL SELECT b.record_id, 'span', b.name, CASE WHEN pn.type = 'ARRAY' THEN x.key ELSE '0' END FROM role b JOIN role p ON p.record_id = b.record_id AND p.kind = 'layout_spans' JOIN n pn ON pn.record_id = p.record_id AND pn.id = p.id AND pn.parent = b.id LEFT JOIN n x ON x.record_id = p.record_id AND x.parent = p.id WHERE b.kind = 'block' AND (pn.type = 'OBJECT' OR pn.type = 'ARRAY' AND x.id IS NOT NULL)),
ext AS (SELECT n.record_id, n.id, n.type, n.value, CAST(NULL AS VARCHAR) AS path FROM doc d JOIN n m ON m.record_id = d.record_id AND m.parent = d.id AND m.key = 'metadata' JOIN n ON n.record_id = m.record_id AND n.parent = m.id AND n.key = 'extra'
  UNION ALL SELECT n.record_id, n.id, n.type, n.value, concat_ws('.', e.path, n.key) FROM ext e JOIN n ON n.record_id = e.record_id AND n.parent = e.id)
"""

ORACLE = {
    "p1_found": _RECORDS + """SELECT DISTINCT record_id, kind, name AS child_id, coalesce(holder, ref, '') AS parent_id FROM holder WHERE kind = 'section' AND name IS NOT NULL
UNION SELECT h.record_id, h.kind, h.name, coalesce(h.holder, l.name, '') FROM holder h LEFT JOIN lister l ON l.record_id = h.record_id AND l.bid = h.name WHERE h.kind = 'block' AND h.name IS NOT NULL
UNION SELECT record_id, kind, concat(name, ':', key), name FROM part WHERE name IS NOT NULL
UNION SELECT record_id, 'extra', path, 'metadata' FROM ext WHERE type NOT IN ('OBJECT', 'ARRAY', 'NULL') AND path IS NOT NULL""",
    "p1_rejected": _RECORDS + """SELECT record_id, CASE WHEN payload IS NULL THEN 'null' WHEN trim(payload) = '' THEN 'empty' WHEN NOT json_valid(payload) THEN 'broken' ELSE 'no document' END AS reason
  FROM (SELECT DISTINCT record_id, payload FROM canonical_records WHERE record_id IS NOT NULL) WHERE record_id NOT IN (SELECT record_id FROM doc)""",
    "p2_hierarchy": TREE + """, below AS (SELECT step, count(*) - 1 AS n FROM (SELECT unnest(path) AS step FROM tree) GROUP BY step)
  SELECT section_key, path[1] AS root_key, CAST(len(path) - 1 AS INT) AS depth, array_to_string(path, '>') AS path, n AS n_descendants, on_loop FROM tree JOIN below ON step = section_key""",
    "p2_found": _VALID + "SELECT ancestor_key, section_key FROM reach",
}
