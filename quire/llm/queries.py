"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bagminhash, idfiles, langid, media, mixing, packing, secrets, tokens, toxicity, vectorgraph
from quire.llm.common import table, whole_text

TOKENIZERS = public_tokenizers.path


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), TOKENIZERS("word_bpe_49k.json"))


def op2_avi_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.media_column(table(spark, sf_dir, "documents")))


def op3_ranked_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, ranks = idfiles.write_files(table(spark, sf_dir, "documents"), TOKENIZERS("byte_bpe_50k.json"))
    return idfiles.read_files(blocks, ranks)


def op4_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), TOKENIZERS("byte_bpe_50k.json"))


def op5_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorgraph.near_vectors(table(spark, sf_dir, "embeddings"))


def op6_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a source stands for an owner, and its texts of one language for a repository
    return secrets.scan(table(spark, sf_dir, "documents"), owner=F.col("source"), repo=F.concat_ws("/", "source", "lang"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"), TOKENIZERS("piece_bpe_32k.model"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    dims = {"source": F.col("source"), "lang": F.col("lang"), "topic": mixing.topic_of(whole_text("text"))}
    return mixing.decisions(table(spark, sf_dir, "documents"), dims)


def op10_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (op1_token_counts, op2_avi_media, op3_ranked_id_files, op4_tier_packing, op5_vector_graph, op6_bag_minhash, op7_secret_ownership, op8_language_id, op9_source_mixing, op10_counterfactual_toxicity)
    return {f.__name__: f for f in all_}


#: all links of equal and near vectors by brute force, components by reachability
_OP5 = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id) AS n_links, c AS component_id, v.vec_id = c AS kept FROM v JOIN least ON least.a = v.vec_id"""

#: exact multisets of five-word shingles, all pairs that share one, components by reachability
_OP6 = """WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_transform(range(greatest(1, len(w) - 4)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS s FROM w WHERE len(w) > 0),
c AS (SELECT doc_id, s, count(*) AS n FROM s GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS n FROM c GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS k FROM c a JOIN c b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT p.a, p.b FROM p JOIN t x ON x.doc_id = p.a JOIN t y ON y.doc_id = p.b WHERE p.k >= 0.8 * (x.n + y.n - p.k) UNION SELECT x.doc_id, y.doc_id FROM w x JOIN w y ON x.text = y.text AND x.doc_id <> y.doc_id),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least AS (SELECT a, min(b) AS c, count(*) AS k FROM reach GROUP BY a)
SELECT a AS doc_id, c AS class_id, k AS n_class, a = c AS kept FROM least"""


def _spans_sql() -> str:
    """Every kind's matches with offsets by running lengths, owners by value, and the joined spans."""

    def kind(no: int, pattern: str, group: int, least: int) -> str:
        p = "'" + pattern.replace("'", "''") + "'"
        gaps = f"SELECT doc_id, regexp_extract_all(t, {p}) AS h, regexp_extract_all(t, {p}, {group}) AS v, regexp_split_to_array(t, {p}) AS g FROM d WHERE regexp_matches(t, {p})"
        rows = f"SELECT doc_id, unnest(range(len(h))) AS i, unnest(h) AS h, unnest(v) AS v, unnest(g[1:len(h)]) AS g FROM ({gaps})"
        return f"SELECT doc_id, {no} AS kind, e - length(h) AS start, e AS end_, v FROM (SELECT *, sum(length(g) + length(h)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM ({rows})) WHERE length(v) >= {least}"

    assign, looks = secrets.ASSIGN.replace(r"\x20", " "), secrets.LOOKS
    names = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "][kind + 1]"
    joined = f"coalesce(string_agg({names} || ':' || start || ':' || end_, ',' ORDER BY start, kind, end_){{}}, '')"
    return f"""WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
base AS ({kind(0, assign, 2, secrets.ASSIGN_LEAST)} UNION ALL {kind(1, secrets.ACCESS, 0, 0)} UNION ALL {kind(2, secrets.HEX, 0, 0)}),
owners AS (SELECT v, count(DISTINCT source) AS n, count(DISTINCT concat_ws('/', source, lang)) AS r FROM base JOIN d USING (doc_id) GROUP BY 1),
most AS (SELECT doc_id, max(n) AS most_owners, max(r) AS most_repos FROM base JOIN owners USING (v) GROUP BY 1),
mark AS (SELECT DISTINCT doc_id, CASE WHEN n >= {secrets.EXAMPLE_OWNERS} OR r >= {secrets.EXAMPLE_REPOS} THEN 4 ELSE 3 END AS kind, end_ - length(v) AS start, end_ FROM base JOIN owners USING (v) WHERE n >= {secrets.EXAMPLE_OWNERS} OR r >= {secrets.EXAMPLE_REPOS} OR (length(v) >= {looks[0]} AND len(list_distinct(string_split(v, ''))) >= {looks[1]} AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]'))),
every AS (SELECT doc_id, kind, start, end_ FROM base UNION ALL SELECT * FROM mark)
SELECT d.doc_id, {', '.join(f"count(*) FILTER (kind = {k}) AS n_{n}" for k, n in enumerate(secrets.KINDS))},
 sha256({joined.format(' FILTER (kind < 3)')}) AS base_sha256, {joined.format('')} AS spans,
 coalesce(any_value(most_owners), 0) AS most_owners, coalesce(any_value(most_repos), 0) AS most_repos
FROM d LEFT JOIN every USING (doc_id) LEFT JOIN most USING (doc_id) GROUP BY d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the same; the other queries are tested against brute force."""
    return {"op5_vector_graph": _OP5, "op6_bag_minhash": _OP6, "op7_secret_ownership": _spans_sql()}
