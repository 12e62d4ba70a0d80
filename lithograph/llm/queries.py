"""The queries on text and embedding problems over a directory of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lithograph.llm import identities, neighbours, packing, personal, sources, splitting, tokens
from lithograph.tables import checkpointed, load, once

CAPACITY = 2048
NEIGHBOURS, DIM, SIMILAR = 5, 64, 0.87
VECTORS = (("adrs", "id", "embedding"), ("embedding_results", "tag", "vector"))
PIECE_TOKENS, OVERLAP_TOKENS = 512, 64


def _origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = once(load(spark, sf_dir, "files").select("id", "path", "language").where(F.col("id").isNotNull()), "id")
    # What texts show is taken where they are read, so that no text is sorted or shuffled.
    texts = sources.signs(load(spark, sf_dir, "source_texts").select(F.col("file_id").alias("id"), "content").where(F.col("id").isNotNull()))
    return sources.judged(files.join(once(texts, "id"), "id", "left"))


def p2_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, path, lang, origin, what shows it, and the layout statistics of each file."""
    return _origins(spark, sf_dir).select(F.col("id").alias("file_id"), "path", "lang", "n_chars", "n_lines", *sources.LIMITS, "origin", "evidence")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id of each file that is not hand-written."""
    return _origins(spark, sf_dir).where(F.col("origin") != "hand_written").select(F.col("id").alias("file_id"))


def _redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [load(spark, sf_dir, table).select(F.lit(table).alias("record_table"), F.col("id").alias("record_id"), F.col(column).alias("text")) for table, column in (("commits", "message"), ("pull_requests", "body"))]
    texts = once(parts[0].unionByName(parts[1]).where(F.col("record_id").isNotNull()), "record_table", "record_id")
    texts = checkpointed(texts)
    known = personal.gazetteers(texts, "text", load(spark, sf_dir, "persons").select("name"))
    texts = checkpointed(personal.marked(texts, "text", known))
    return personal.redacted(texts, "text", personal.fit(texts, "text", known))


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_table, record_id, clean_text: every message and body with placeholders for personal information."""
    return _redacted(spark, sf_dir).select("record_table", "record_id", "clean_text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_table, record_id, pii_type, found_text: each distinct text found in a record."""
    found = _redacted(spark, sf_dir).select("record_table", "record_id", F.explode("spans").alias("s"))
    return found.select("record_table", "record_id", F.col("s.pii_type").alias("pii_type"), F.col("s.found_text").alias("found_text")).distinct()


def p4_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and person (the least id of its group) of every row of persons that is not an automation account."""
    return identities.linked(load(spark, sf_dir, "persons"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id_a, id_b of each pair of rows that belong to one human."""
    return identities.pairs(identities.linked(load(spark, sf_dir, "persons")))


def _vectors(spark: SparkSession, sf_dir: str, table: str, key: str, vector: str) -> DataFrame:
    return checkpointed(neighbours.usable(load(spark, sf_dir, table), key, vector, DIM))


def _close(spark: SparkSession, sf_dir: str, table: str, key: str, vector: str) -> DataFrame:
    """id_a, id_b of the pairs of one table; what half precision leaves open is decided by the full vectors."""
    vectors = _vectors(spark, sf_dir, table, key, vector)
    near = checkpointed(neighbours.close(vectors, NEIGHBOURS, DIM, SIMILAR))
    seen = neighbours.exact(near.where("open").select("n", "other", "competes", "free"), vectors, DIM)
    place = F.row_number().over(W.partitionBy("n", "competes").orderBy(F.desc("similarity"), "other_key"))
    decided = seen.withColumn("place", place).where((F.col("similarity") >= SIMILAR) & (~F.col("competes") | (F.col("place") <= F.col("free"))))
    pairs = near.where(~F.col("open")).select("n", "other").unionByName(decided.select("n", "other")).select(F.least("n", "other").alias("n"), F.greatest("n", "other").alias("other")).distinct()
    keys = vectors.select("n", F.col("key").alias("a"))
    named = pairs.join(keys, "n").join(keys.select(F.col("n").alias("other"), F.col("a").alias("b")), "other")
    return named.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id_a, id_b of each pair of at least 0.87 of which one is among the five most similar of the other."""
    parts = [_close(spark, sf_dir, *v) for v in VECTORS]
    return parts[0].unionByName(parts[1])


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, id, other_id, similarity of the five most similar vectors of every vector; similarities are those of the full vectors."""
    found = None
    for table, key, vector in VECTORS:
        vectors = _vectors(spark, sf_dir, table, key, vector)
        near = neighbours.neighbours(vectors, NEIGHBOURS + 1, DIM)
        rows = neighbours.exact(near.where(F.col("rank") <= NEIGHBOURS).select("n", "other"), vectors, DIM)
        rows = rows.select(F.lit(table).alias("table_name"), F.col("key").alias("id"), F.col("other_key").alias("other_id"), "similarity")
        found = rows if found is None else found.unionByName(rows)
    return found


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and ids of each document."""
    return tokens.token_ids(load(spark, sf_dir, "documents"), "doc_id", "text")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(tokens.token_counts(load(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "n_tokens", CAPACITY)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, n_tokens, container_id of every text that is not empty."""
    return _packed(spark, sf_dir)


def p8_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the packing is from the lower bound."""
    return packing.certificate(_packed(spark, sf_dir), CAPACITY)


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents above 512 tokens."""
    return splitting.split_texts(load(spark, sf_dir, "documents"), "doc_id", "text", PIECE_TOKENS, OVERLAP_TOKENS)


QUERIES = {"p2_found": p2_found, "p2_origins": p2_origins, "p3_found": p3_found, "p3_redacted": p3_redacted, "p4_found": p4_found, "p4_persons": p4_persons, "p5_found": p5_found, "p5_neighbours": p5_neighbours, "p7_ids": p7_ids, "p8_containers": p8_containers, "p8_certificate": p8_certificate, "p9_pieces": p9_pieces}
def _pairs(table: str, key: str, vector: str) -> str:
    good = f"len({vector}) = {DIM} AND (list_max({vector}) <> 0 OR list_min({vector}) <> 0)"
    return f"""SELECT CASE WHEN a < b THEN a ELSE b END AS id_a, CASE WHEN a < b THEN b ELSE a END AS id_b FROM (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM (
    SELECT x.k AS a, y.k AS b, list_cosine_similarity(x.v, y.v) AS s FROM {table}_v x, {table}_v y WHERE x.k <> y.k)) WHERE n <= {NEIGHBOURS} AND s >= {SIMILAR}""", f"{table}_v AS (SELECT DISTINCT {key} AS k, CAST({vector} AS DOUBLE[]) AS v FROM {table} WHERE {good})"


def _found_sql() -> str:
    parts = [_pairs(*v) for v in VECTORS]
    return f"WITH {', '.join(c for _, c in parts)} " + " UNION ".join(q for q, _ in parts)


ORACLE = {"p5_found": _found_sql()}
