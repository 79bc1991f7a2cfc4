"""Queries of the training-data problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.doc_pairs import doc_pairs
from codeloom.llm.encodings import damaged_words, restore
from codeloom.llm.leakage import leaked_items
from codeloom.llm.mixing import mix
from codeloom.llm.near_duplicates import NearDuplicates, near_duplicates
from codeloom.llm.secrets import find_secrets, redact
from codeloom.llm.similar_vectors import similar_vectors
from codeloom.session import table

ROUTINES = ("function", "method")


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar other patterns of each pattern, however similar."""
    return similar_vectors(table(spark, d, "patterns"), "id", "embedding", 96, k=5, least=-1.0, at="last_seen")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    near = similar_vectors(table(spark, d, "patterns"), "id", "embedding", 96, k=5, least=0.80, at="last_seen")
    return near.select(F.least("id", "other").alias("pattern_a"), F.greatest("id", "other").alias("pattern_b")).distinct()


def routines_alike(spark: SparkSession, d: str) -> NearDuplicates:
    rows = table(spark, d, "code_elements").where(F.col("type").isin(*ROUTINES))
    text = F.concat(F.coalesce("name", F.lit("")), F.lit(" "), "code")
    return near_duplicates(rows, "id", text, at="updated_at", threshold=0.6, shingle=3, min_tokens=20)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return routines_alike(spark, d).pairs()


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return routines_alike(spark, d).groups()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return find_secrets(table(spark, d, "code_elements")).where("kind <> 'continued'").select("id", "line_no").distinct()


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redact(table(spark, d, "code_elements"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return doc_pairs(table(spark, d, "code_elements")).where("position = 0").select("id").distinct()


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """One pair per id and routine in its text: repeated deliveries have the same content, of others the largest pair counts."""
    pairs = doc_pairs(table(spark, d, "code_elements"))
    return pairs.groupBy("id", "position").agg(F.max(F.struct("code", "description", "language", "name", "signature", "doc_start", "doc_end")).alias("p")).select("id", "position", "p.*")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The case is 13 words in a row: of what the edit search finds, the windows at distance 0, and no items shorter than that."""
    items = table(spark, d, "eval_items").where(F.size(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))) >= 13)
    return leaked_items(table(spark, d, "documents"), items, window=13, max_edits=2).where("edits = 0").select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Also passages that were changed by a word or two, and whole items of fewer than 13 words."""
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), window=13, max_edits=2)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return damaged_words(table(spark, d, "documents")).select("doc_id").distinct()


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return restore(docs, damaged_words(docs))


QUERIES = {"p1_found": p1_found, "p1_neighbours": p1_neighbours, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_mix": p8_mix, "p8_shares": p8_shares, "p6_found": p6_found, "p6_pairs": p6_pairs, "p3_found": p3_found, "p3_redacted": p3_redacted, "p9_found": p9_found, "p9_restored": p9_restored, "p2_found": p2_found, "p2_groups": p2_groups}

_PAIRS = """ e AS (SELECT id, arg_max(coalesce(name, '') || ' ' || code, updated_at) AS t FROM code_elements WHERE type IN ('function', 'method') AND code IS NOT NULL GROUP BY id),
w AS (SELECT id, list_transform(regexp_extract_all(t, '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM e),
s AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 20),
n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
p AS (SELECT id_a, id_b, o = x.n AND o = y.n AS same FROM o JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE o * 10 >= 6 * (x.n + y.n - o))"""
_ALIKE = "WITH" + _PAIRS + " SELECT id_a, id_b FROM p"
_GROUPS = "WITH RECURSIVE" + _PAIRS + """,
c AS (SELECT n.id, least(n.id, coalesce(min(id_a), n.id)) AS class_id FROM n LEFT JOIN p ON p.id_b = n.id AND same GROUP BY n.id),
k AS (SELECT DISTINCT x.class_id AS a, y.class_id AS b FROM (SELECT id_a, id_b FROM p UNION ALL SELECT id_b, id_a FROM p) JOIN c x ON x.id = id_a JOIN c y ON y.id = id_b WHERE x.class_id <> y.class_id),
r AS (SELECT DISTINCT class_id AS id, class_id AS far FROM c UNION SELECT r.id, k.b FROM r JOIN k ON k.a = r.far)
SELECT c.id, c.class_id, (SELECT min(far) FROM r WHERE r.id = c.class_id) AS group_id, (SELECT count(*) FROM k WHERE k.a = c.class_id) AS n_links FROM c"""

_LEAKED = """
WITH d AS (SELECT DISTINCT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM eval_items WHERE text IS NOT NULL),
iw AS (SELECT item_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) AS g FROM i WHERE len(w) >= 13),
dw AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) AS g FROM d WHERE len(w) >= 13)
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)"""

_SIMILAR = """
WITH v AS (SELECT id, CAST(arg_max(embedding, last_seen) AS DOUBLE[]) AS v FROM patterns WHERE len(embedding) = 96
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY id),
s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS s FROM v a JOIN v b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM s)
SELECT DISTINCT least(a, b) AS pattern_a, greatest(a, b) AS pattern_b FROM r WHERE n <= 5 AND s >= 0.8"""

ORACLES: dict[str, str] = {"p1_found": _SIMILAR, "p2_found": _ALIKE, "p2_groups": _GROUPS, "p7_found": _LEAKED}
