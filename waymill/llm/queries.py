"""Queries of the training-data problems for large language models and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymill.llm import bitslice, bpe, cdc, fmindex, langid
from waymill.session import written
from waymill.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of routes with at least 0.7 of their vertices in common."""
    members, links = bitslice.near_duplicates(bitslice.route_vertices(table(spark, sf_dir, "route_edges")))
    return bitslice.similar_pairs(members, links).select(F.col("record_a").alias("route_id_a"), F.col("record_b").alias("route_id_b"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each route with its class of equal vertex sets and the number of other classes it is linked to."""
    members, links = bitslice.near_duplicates(bitslice.route_vertices(table(spark, sf_dir, "route_edges")))
    ends = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(ends, "class", "left").select(F.col("record").alias("route_id"), F.col("class").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation routes of which at least 60 % of the steps are in a training route, with that route."""
    pairs = cdc.near_overlap(table(spark, sf_dir, "sampled_eval"), table(spark, sf_dir, "sampled_train"), record=["split_name", "route_id"], source=["route_id"])
    return pairs.select("split_name", F.col("route_id").alias("eval_route_id"), "train_route_id")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and map of the evaluation route: overlapping routes, and pairs with training routes."""
    evaluation = table(spark, sf_dir, "sampled_eval")
    pairs = cdc.near_overlap(evaluation, table(spark, sf_dir, "sampled_train"), record=["split_name", "route_id"], source=["route_id"])
    maps = evaluation.groupBy("split_name", "route_id").agg(F.min("map_id").alias("map_id"))
    return pairs.join(maps, ["split_name", "route_id"]).groupBy("split_name", "map_id").agg(F.countDistinct("route_id").alias("n_routes"), F.count(F.lit(1)).alias("n_pairs"))


def p5_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation route the fraction of its steps in content-defined chunks that training routes hold unchanged."""
    return cdc.exact_overlap(table(spark, sf_dir, "sampled_eval"), table(spark, sf_dir, "sampled_train"), record=["split_name", "route_id"], source=["route_id"])


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's token ids."""
    return bpe.encode_column(table(spark, sf_dir, "documents"))


def p6_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and checksum of each document after encoding and decoding."""
    back = bpe.decode_column(bpe.encode_column(table(spark, sf_dir, "documents")))
    return back.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.leaked_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with each test item of which it holds a passage."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per leaked item: documents that hold passages of it, and the words to remove."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_docs"), F.sum("words").alias("n_words"))


def p7_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p7_found`` from stored indexes: the corpus is indexed once, written, and the items are sought in the table."""
    index = written(fmindex.stored_index(table(spark, sf_dir, "documents")), "fmindex")
    return fmindex.indexed_spans(index, table(spark, sf_dir, "benchmark_items")).select("doc_id", "item_id").distinct()


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_samples"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose label is missing or wrong, or that hold a passage in a further language."""
    return langid.label_issues(_passages(spark, sf_dir))


def p8_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language with its confidence."""
    return langid.document_languages(_passages(spark, sf_dir))


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each passage's language with its confidence and place."""
    return _passages(spark, sf_dir)


QUERIES = {
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p7_indexed": p7_indexed,
    "p8_found": p8_found,
    "p8_labels": p8_labels,
    "p8_passages": p8_passages,
    "p3_found": p3_found,
    "p3_classes": p3_classes,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p5_fractions": p5_fractions,
    "p6_ids": p6_ids,
    "p6_roundtrip": p6_roundtrip,
}

#: Steps with clean vectors, matches of steps, and pairs of routes; shared by two statements.
_P5 = """
    WITH e AS (
        SELECT DISTINCT split_name, route_id, step_id, list_transform(feature_vec, lambda x: CASE WHEN x IS NULL OR isnan(x) THEN 0 ELSE x END) AS v
        FROM sampled_eval WHERE feature_vec IS NOT NULL),
    t AS (
        SELECT DISTINCT route_id, step_id, list_transform(feature_vec, lambda x: CASE WHEN x IS NULL OR isnan(x) THEN 0 ELSE x END) AS v
        FROM sampled_train WHERE feature_vec IS NOT NULL),
    n AS (SELECT split_name, route_id, count(*) AS n FROM e GROUP BY ALL),
    m AS (
        SELECT DISTINCT e.split_name, e.route_id AS er, e.step_id, t.route_id AS tr
        FROM e JOIN t ON abs(e.v[1] - t.v[1]) <= 0.5 + 1e-9
        WHERE len(list_filter(list_zip(e.v, t.v), lambda p: abs(p[1] - p[2]) > 0.5 + 1e-9)) = 0),
    pair AS (
        SELECT m.split_name, m.er, m.tr FROM m JOIN n ON n.split_name = m.split_name AND n.route_id = m.er
        GROUP BY m.split_name, m.er, m.tr, n.n HAVING count(*) * 5 >= n.n * 3)
"""

#: Distinct vertices of routes in whole centimetres, and the pairs of routes at or above the limit.
_P3 = r"""
        WITH line AS (
            SELECT route_id, unnest(string_split(regexp_extract(geometry, '(?i)LINESTRING\s*Z?\s*\(([^()]*)\)', 1), ',')) AS p
            FROM route_edges WHERE regexp_matches(geometry, '(?i)LINESTRING\s*Z?\s*\([^()]*\)')),
        word AS (SELECT route_id, string_split_regex(trim(p), '\s+') AS w FROM line),
        v AS (
            SELECT DISTINCT route_id, CAST(round(CAST(w[1] AS DOUBLE) * 100) AS BIGINT) AS x, CAST(round(CAST(w[2] AS DOUBLE) * 100) AS BIGINT) AS y
            FROM word),
        n AS (SELECT route_id, count(*) AS n FROM v GROUP BY route_id),
        c AS (
            SELECT a.route_id AS ra, b.route_id AS rb, count(*) AS c
            FROM v a JOIN v b ON a.x = b.x AND a.y = b.y AND a.route_id < b.route_id GROUP BY ALL),
        pair AS (SELECT ra, rb FROM c JOIN n na ON ra = na.route_id JOIN n nb ON rb = nb.route_id WHERE 10 * c >= 7 * (na.n + nb.n - c))"""

#: Words of documents and items, and the places in a document where 12 words of an item begin.
_P7 = r"""
        WITH word AS (
            SELECT doc_id, regexp_extract_all(regexp_replace(replace(lower(text), '\-', ''), '\\\p{L}+', ' ', 'g'), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
        own AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark_items),
        dk AS (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM word),
        ik AS (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM own),
        ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM ik),
        dg AS (SELECT doc_id, k, array_to_string(w[k:k + 11], ' ') AS g FROM dk),
        hit AS (SELECT DISTINCT doc_id, item_id, k FROM dg JOIN ig USING (g))"""

ORACLE = {
    "p3_found": _P3 + " SELECT ra AS route_id_a, rb AS route_id_b FROM pair",
    "p3_classes": _P3
    + """,
        own AS (SELECT route_id, list(x * 4294967296 + y ORDER BY x, y) AS e FROM v GROUP BY route_id),
        class AS (SELECT route_id, min(route_id) OVER (PARTITION BY e) AS class_id FROM own),
        link AS (
            SELECT DISTINCT ka.class_id AS a, kb.class_id AS b FROM pair JOIN class ka ON ka.route_id = ra JOIN class kb ON kb.route_id = rb WHERE ka.class_id <> kb.class_id),
        ends AS (SELECT DISTINCT a, b FROM link UNION SELECT b, a FROM link)
        SELECT route_id, class_id, (SELECT count(*) FROM ends WHERE a = class_id) AS n_links FROM class""",
    "p5_found": _P5 + "SELECT split_name, er AS eval_route_id, tr AS train_route_id FROM pair",
    "p5_report": _P5
    + """
        SELECT p.split_name, k.map_id, count(DISTINCT er) AS n_routes, count(*) AS n_pairs
        FROM pair p JOIN (SELECT split_name, route_id, min(map_id) AS map_id FROM sampled_eval GROUP BY ALL) k
          ON k.split_name = p.split_name AND k.route_id = p.er
        GROUP BY ALL""",
    "p6_roundtrip": "SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, md5(coalesce(text, '')) AS digest FROM documents",
    "p7_found": _P7 + " SELECT DISTINCT doc_id, item_id FROM hit",
    "p7_indexed": _P7 + " SELECT DISTINCT doc_id, item_id FROM hit",
    "p7_report": _P7
    + """,
        step AS (SELECT *, k - coalesce(lag(k) OVER (PARTITION BY doc_id, item_id ORDER BY k), k - 100) > 12 AS fresh FROM hit),
        span AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, item_id ORDER BY k) AS s FROM step),
        long AS (SELECT doc_id, item_id, s, max(k) - min(k) + 12 AS n FROM span GROUP BY ALL)
        SELECT item_id, count(DISTINCT doc_id) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM long GROUP BY item_id""",
}
