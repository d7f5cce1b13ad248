"""The queries of the operators, and their SQL where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from veracell.llm import (alignment, chat_format, classifier, contamination, context_mixing,
                          licenses, near_duplicates, nn_descent, packing, quality_rules, repeats,
                          resampling, token_counts)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(modulus: int):
    """crc32 of the id as text, modulo: the deal of rows to learning and holding out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def _sets(table_: str, key: str) -> str:
    """SQL of (key, s): the distinct shingles of a table's texts."""
    low = ("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
           "'abcdefghijklmnopqrstuvwxyz')")
    return f"""SELECT DISTINCT {key}, s FROM (SELECT {key}, unnest(CASE WHEN len(w) < 5
 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3),
 lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM (SELECT {key},
 regexp_extract_all({low}, '[^\\x20\\x09-\\x0D]+') AS w FROM {table_}) WHERE len(w) > 0)"""


NEAR_SQL = f"""WITH RECURSIVE ds AS MATERIALIZED ({_sets("documents", "doc_id")}),
 n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM ds GROUP BY 1),
 shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM ds a JOIN ds b ON a.s = b.s
 AND a.doc_id < b.doc_id GROUP BY 1, 2),
 links AS MATERIALIZED (SELECT x, y FROM shared JOIN n nx ON nx.doc_id = x JOIN n ny ON
 ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
 sides AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
 reach AS (SELECT x, y FROM sides UNION SELECT reach.x, sides.y FROM reach JOIN sides ON
 reach.y = sides.x),
 least AS (SELECT x, min(y) AS m FROM reach GROUP BY 1)
 SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id))
 AS component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
 FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least ON x = d.doc_id"""

CONTAINED_SQL = f"""WITH ds AS ({_sets("documents", "doc_id")}),
 bs AS ({_sets("benchmark", "item_id")}),
 n AS (SELECT item_id, count(*)::BIGINT AS n_item FROM bs GROUP BY 1)
 SELECT item_id, doc_id, n_item, count(*)::BIGINT AS n_shared, count(*)::DOUBLE / n_item AS
 containment FROM bs JOIN ds USING (s) JOIN n USING (item_id) GROUP BY 1, 2, 3
 HAVING 100 * count(*) >= 75 * n_item"""


# The nearest rows by an exact search; the graph search of the query finds the same on tables that
# one beam covers, and is measured by its recall beyond.
NEAREST_SQL = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id
 IS NOT NULL AND embedding IS NOT NULL),
 p AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_cosine_similarity(a.v, b.v) AS score
 FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
 SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER
 AS rank, vec_id, score FROM p QUALIFY rank <= 5"""


def _features(table_: str, key: str) -> str:
    """SQL of (key, f, n_words): every feature of a table's texts; texts without words have none."""
    low = ("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
           "'abcdefghijklmnopqrstuvwxyz')")
    return f"""SELECT {key}, len(w) AS n_words, unnest(list_concat(w, list_transform(
 range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM (SELECT {key},
 regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table_})"""


# crc32 by its table of 256 entries, over the hexadecimal digits of the bytes.
RESAMPLE_SQL = f"""WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(
 [i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
 d AS MATERIALIZED ({_features("documents", "doc_id")}),
 b AS MATERIALIZED ({_features("benchmark", "item_id")}),
 f AS MATERIALIZED (SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(0,
 strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)),
 lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS k
 FROM (SELECT f FROM d UNION SELECT f FROM b), crc),
 s AS (SELECT k, count(*) AS s FROM d JOIN f USING (f) GROUP BY 1),
 t AS (SELECT k, count(*) AS t FROM b JOIN f USING (f) GROUP BY 1),
 n AS (SELECT (SELECT count(*) FROM d)::DOUBLE + 10000 AS s, (SELECT count(*) FROM b)::DOUBLE
 + 10000 AS t),
 g AS MATERIALIZED (SELECT k, floor(1000 * ln((coalesce(t.t, 0) + 1)::DOUBLE * n.s /
 ((coalesce(s.s, 0) + 1)::DOUBLE * n.t)))::BIGINT AS g FROM s FULL JOIN t USING (k), n),
 w AS (SELECT doc_id, any_value(n_words) AS n_words, count(*) AS n_features, sum(g)::BIGINT AS g
 FROM d JOIN f USING (f) JOIN g USING (k) GROUP BY 1),
 r AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_features, 0)::BIGINT AS
 n_features, CASE WHEN n_features IS NULL THEN 0 ELSE (g - ((g % n_features) + n_features) %
 n_features) // n_features END::BIGINT AS weight, ('0x' || substr(sha256('7:' || doc_id), 1, 8)
 )::BIGINT AS h FROM documents LEFT JOIN w USING (doc_id)),
 x AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
 FROM r),
 o AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20
 ORDER BY score DESC, doc_id) END AS spot, 25 * count(*) FILTER (n_words >= 20) OVER () // 100 AS k
 FROM x)
 SELECT doc_id, n_features, weight, score, CASE WHEN spot <= k THEN spot END AS rank FROM o"""


@query("op1_packing")
def packing_query(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"),
                          public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


@query("op2_licenses")
def license_query(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


@query("op3_near_duplicates", NEAR_SQL)
def near_duplicate_query(spark, sf_dir):
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_context_mixing")
def mixing_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = context_mixing.fit(docs.where(fold(10) != 0))
    return context_mixing.score_texts(docs, model, fold(10) == 0)


@query("op5_quality_classifier")
def classifier_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    network = classifier.fit_classifier(docs, table(spark, sf_dir, "labels"), fold(4) != 2)
    return docs.select("doc_id", (fold(4) == 2).alias("held_out"),
                       classifier.quality_score(network).alias("score")).select(
        "*", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op6_repeats")
def repeat_query(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents"),
                                  passage_words=repeats.PASSAGE_WORDS)


@query("op7_chat_format")
def chat_query(spark, sf_dir):
    return chat_format.chat_digest(table(spark, sf_dir, "conversations"))


@query("op8_quality_rules")
def rule_query(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "reasons")


@query("op9_contamination", CONTAINED_SQL)
def contamination_query(spark, sf_dir):
    return contamination.contained_items(table(spark, sf_dir, "documents"),
                                         table(spark, sf_dir, "benchmark"))


@query("op10_token_counts")
def token_count_query(spark, sf_dir):
    return token_counts.count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).select(
        "*", (F.col("n_tokens") > 1024).alias("over_limit"))


@query("op11_token_alignment")
def alignment_query(spark, sf_dir):
    return alignment.alignment_digest(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"))


@query("op12_nearest_neighbours", NEAREST_SQL)
def nearest_query(spark, sf_dir):
    return nn_descent.nearest_rows(table(spark, sf_dir, "embeddings"),
                                   F.pmod("id", F.lit(50)) == 0)


@query("op13_resampling", RESAMPLE_SQL)
def resample_query(spark, sf_dir):
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
