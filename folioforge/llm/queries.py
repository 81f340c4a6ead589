"""Queries p3_ to p9_."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import abuse as A
from folioforge.llm import leakage as L
from folioforge.llm import lookalikes as K
from folioforge.llm import neardup as D
from folioforge.llm import neighbours as V
from folioforge.llm import splitting as S
from folioforge.llm import tokenize as T
from folioforge.runtime import read_table, stage_table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks above 1,500 characters, by how they had to be cut."""
    return S.oversized_kinds(read_table(spark, sf_dir, "chunks"), "chunk_key").withColumnRenamed("key", "chunk_key")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of chunks above 1,500 characters, with overlap and page."""
    return S.pieces_with_pages(read_table(spark, sf_dir, "chunks"), read_table(spark, sf_dir, "blocks"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks and sections whose text or title isn't in its consistent form."""
    blocks = K.changed_rows(read_table(spark, sf_dir, "blocks"), "block_key", "text")
    sections = K.changed_rows(read_table(spark, sf_dir, "sections"), "section_key", "title")
    return blocks.select(F.lit("block").alias("row_kind"), F.col("key").alias("row_key")).unionByName(sections.select(F.lit("section").alias("row_kind"), F.col("key").alias("row_key")))


def p4_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every section title (of the latest row of each section)."""
    latest = read_table(spark, sf_dir, "sections").groupBy("section_key").agg(F.max(F.struct("updated_at", "title"))["title"].alias("title"))
    return K.canonicalize(latest, "title")


def p4_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of the text of every block."""
    blocks = read_table(spark, sf_dir, "blocks").where("block_key is not null").select("block_key", "text").dropDuplicates(["block_key"])
    return K.canonicalize(blocks, "text")


#: p5_found verifies by weighted similarity before the plain one decides. Of the 3,218 pairs of contents of a plain similarity of 0.6 or more
#: at sf0.1 and in check_s none is below 0.6.
P5_WEIGHTED = 0.5


def _p5(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    members, pairs = D.similar_contents(read_table(spark, sf_dir, "chunks"), "chunk_key", "text", n=3, least_words=40, bands=40, rows=4, weigh=False, least=P5_WEIGHTED)
    return members, stage_table(pairs.where("jaccard >= 0.6"), "near")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunks of 40 words or more whose sets of three words overlap by 0.6: candidates by sampling, verified by weighted
    similarity, cut at the plain one that the query is defined by."""
    members, near = _p5(spark, sf_dir)
    return D.spread_pairs(members, near).select(F.col("key_a").alias("chunk_a"), F.col("key_b").alias("chunk_b"))


def p5_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk of p5_found's setting with its class of equal contents (class_id: the least key) and n_links, the other classes it
    is linked with. With p5_found, which links every chunk to the first one of each class, this gives all pairs."""
    members, near = _p5(spark, sf_dir)
    first = members.groupBy("content").agg(F.min("key").alias("class_id"))
    links = near.select(F.explode(F.array("content_a", "content_b")).alias("content")).groupBy("content").agg(F.count("*").alias("n_links"))
    both = members.join(first, "content").join(links, "content", "left")
    return both.select(F.col("key").alias("chunk_key"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicate chunks by the general setting: five words, weighted similarity of 0.8. group_id is the least key."""
    members, pairs = D.similar_contents(read_table(spark, sf_dir, "chunks"), "chunk_key", "text", n=5, bands=30, rows=5, least=0.8, grouped=True)
    groups = stage_table(D.duplicate_groups(members, stage_table(pairs, "near")).select("key", "group_id"), "groups")
    heads = groups.groupBy("group_id").agg(F.min("key").alias("head"))
    return groups.join(heads, "group_id").select(F.col("key").alias("chunk_key"), F.col("head").alias("group_id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar usable vectors of every usable vector."""
    return V.all_neighbours(read_table(spark, sf_dir, "chunk_vectors")).select("vec_id", "neighbor_id")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.encode_corpus(read_table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 13 consecutive words of an evaluation item, or a shorter item whole."""
    return L.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every evaluation item the number of documents it leaked into."""
    return L.leak_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p8_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the leaked spans removed, those in look-alike letters included."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return L.remove_leaks(docs, read_table(spark, sf_dir, "eval_items"), lookalikes=True)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least one abusive, hateful or sexually explicit passage."""
    return A.score_documents(read_table(spark, sf_dir, "documents")).where("passages > 0").select("doc_id")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, kind and number of passages of every document."""
    return A.score_documents(read_table(spark, sf_dir, "documents"))


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of documents with such passages per source."""
    docs = read_table(spark, sf_dir, "documents")
    return A.source_rates(docs, A.score_documents(docs))


QUERIES = {f.__name__: f for f in (p3_found, p3_pieces, p4_found, p4_titles, p4_texts, p5_found, p5_members, p5_groups, p6_found, p7_ids, p8_found, p8_report, p8_cleaned, p9_found, p9_scores, p9_rates)}

_WORDS = r"regexp_extract_all(lower(%s), '[\p{L}\p{N}]+')"
_UNSEEN = r"[\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{2066}-\x{206f}\x{fe00}-\x{fe0f}\x{feff}]"
_SPACES = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SEEN = f"regexp_replace(text, '{_UNSEEN}', '', 'g')"

ORACLE: dict[str, str] = {
    "p3_found": f"""SELECT DISTINCT chunk_key, CASE WHEN regexp_matches(text, '[^{_SPACES}]{{1000}}[^{_SPACES}]{{501}}') THEN 'hard' ELSE 'natural' END AS cut_kind FROM chunks WHERE length(text) > 1500""",
    "p5_found": f"""WITH c AS (SELECT DISTINCT chunk_key, {_WORDS % 'text'} AS w FROM chunks WHERE text IS NOT NULL), g AS (SELECT chunk_key, list_distinct(list_transform(range(len(w) - 2), lambda i: array_to_string(w[i + 1 : i + 3], ' '))) AS s FROM c WHERE len(w) >= 40),
        u AS (SELECT chunk_key, len(s) AS n, unnest(s) AS x FROM g), p AS (SELECT a.chunk_key AS chunk_a, b.chunk_key AS chunk_b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM u a JOIN u b ON a.x = b.x AND a.chunk_key < b.chunk_key GROUP BY a.chunk_key, b.chunk_key)
        SELECT chunk_a, chunk_b FROM p WHERE k >= 0.6 * (na + nb - k)""",
    "p5_members": f"""WITH RECURSIVE c AS (SELECT DISTINCT chunk_key, {_WORDS % 'text'} AS w FROM chunks WHERE chunk_key IS NOT NULL AND text IS NOT NULL), m AS (SELECT chunk_key, w, min(chunk_key) OVER (PARTITION BY w) AS class_id FROM c WHERE len(w) >= 40),
        g AS (SELECT class_id, list_distinct(list_transform(range(len(w) - 2), lambda i: array_to_string(w[i + 1 : i + 3], ' '))) AS s FROM m WHERE chunk_key = class_id), u AS (SELECT class_id, len(s) AS n, unnest(s) AS x FROM g),
        p AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb FROM u a JOIN u b ON a.x = b.x AND a.class_id <> b.class_id GROUP BY 1, 2), l AS (SELECT a, count(*) AS n FROM p WHERE k >= 0.6 * (na + nb - k) GROUP BY a)
        SELECT chunk_key, class_id, coalesce(l.n, 0) AS n_links FROM m LEFT JOIN l ON l.a = m.class_id""",
    "p5_groups": f"""WITH RECURSIVE c AS (SELECT DISTINCT chunk_key, {_WORDS % 'text'} AS w FROM chunks WHERE chunk_key IS NOT NULL AND text IS NOT NULL), m AS (SELECT chunk_key, w, min(chunk_key) OVER (PARTITION BY w) AS k FROM c WHERE len(w) >= 5),
        o AS (SELECT chunk_key, k, unnest(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS x FROM m), df AS (SELECT x, count(DISTINCT chunk_key) AS df FROM o GROUP BY x),
        t AS (SELECT k, x, (1 + ln(count(*))) * greatest(0.5, ln(((SELECT count(*) FROM m) + 1) / (greatest(any_value(df), (SELECT count(*) FROM m) / 2000) + 1))) AS wt FROM o JOIN df USING (x) WHERE chunk_key = k GROUP BY k, x), s AS (SELECT k, sum(wt) AS total FROM t GROUP BY k),
        p AS (SELECT a.k AS a, b.k AS b, sum(least(a.wt, b.wt)) AS low FROM t a JOIN t b ON a.x = b.x AND a.k <> b.k GROUP BY 1, 2), l AS (SELECT a, b FROM p JOIN s sa ON sa.k = a JOIN s sb ON sb.k = b WHERE low >= 0.8 * (sa.total + sb.total - low)),
        r AS (SELECT k, k AS head FROM s UNION SELECT l.b, r.head FROM r JOIN l ON l.a = r.k), h AS (SELECT k, min(head) AS head FROM r GROUP BY k)
        SELECT chunk_key, head AS group_id FROM m JOIN h USING (k)""",
    "p6_found": """WITH v AS (SELECT DISTINCT ON (vec_id) vec_id, dense::DOUBLE[] AS d FROM chunk_vectors WHERE len(dense) = 64 AND len(list_filter(dense, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(dense, lambda x: x <> 0)) > 0),
        p AS (SELECT a.vec_id, b.vec_id AS neighbor_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.d, b.d), 9) DESC, b.vec_id) AS r FROM v a JOIN v b ON a.vec_id <> b.vec_id) SELECT vec_id, neighbor_id FROM p WHERE r <= 10""",
    "p8_found": f"""WITH i AS (SELECT DISTINCT item_id, {_WORDS % _SEEN} AS w FROM eval_items), d AS (SELECT DISTINCT doc_id, {_WORDS % _SEEN} AS w FROM documents WHERE text <> ''),
        ig AS (SELECT item_id, unnest(list_transform(range(len(w) - 12), lambda k: array_to_string(w[k + 1 : k + 13], ' '))) AS g FROM i WHERE len(w) >= 13), dg AS (SELECT doc_id, unnest(list_transform(range(len(w) - 12), lambda k: array_to_string(w[k + 1 : k + 13], ' '))) AS g FROM d WHERE len(w) >= 13)
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g) UNION SELECT doc_id, item_id FROM d, i WHERE len(i.w) BETWEEN 1 AND 12 AND contains(concat(' ', array_to_string(d.w, ' '), ' '), concat(' ', array_to_string(i.w, ' '), ' '))""",
}
ORACLE["p8_report"] = f"SELECT i.suite, i.item_id, count(f.doc_id) AS n_documents FROM (SELECT DISTINCT suite, item_id FROM eval_items) i LEFT JOIN ({ORACLE['p8_found']}) f USING (item_id) GROUP BY i.suite, i.item_id"
