"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_cnn, hnsw, jaccard_join, packing, segment_topk, sp_lattice, substring_dedup, token_counts, token_files, url_trust
from .shared import scratch, shuffle_partitions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 1024, 512, 256 and 128 tokens; null text is one end token, repeated rows are documents of their own, an empty table gives none. See packing.pack."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", packing.ids_crc32(F.col("ids")).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all whole texts, and the longest prefix within 512 tokens; null text has none, repeated rows stay, an empty table gives none. See token_counts.count_tokens."""
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), budget=512)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), "fits_chars")


def op3_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest of each 20th id, by shards' graphs; null, zero and unfinite vectors take no part, repeated rows count once, ties go to smaller ids. See hnsw.search."""
    return hnsw.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op4_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10 best of each 100th id, exactly; null and unfinite vectors take no part, repeated rows count once, ties go to smaller ids. See segment_topk.search."""
    return segment_topk.search(table(spark, sf_dir, "embeddings"), k=10, every=100)


RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def op5_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on each page; null urls and urls without a host are allowed, a host without links stands by its own pages, repeated rows stay. See url_trust.judge."""
    return url_trust.judge(table(spark, sf_dir, "pages"), RULES)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each document; without words or id there is no link, rows of equal id are judged by their texts. See jaccard_join.cluster."""
    return jaccard_join.cluster(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without windows of 13 words that a smaller id has; null text has no words, a row without id is left whole. See substring_dedup.remove_repeats."""
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all whole texts, and the checksum of the text that they are decoded to; null text has none, repeated rows stay. See sp_lattice.encode and decode."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = sp_lattice.decode(sp_lattice.encode(table(spark, sf_dir, "documents"), path), path)
    return rows.select("doc_id", "n_pieces", "ids", F.crc32(F.encode("text", "UTF-8")).alias("decoded_crc32"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as files in ascending order of id (null first) and read back; null text is one end token, repeated rows stay side by side. See token_files.write and read."""
    path = scratch(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2, partitions=max(8, shuffle_partitions(spark)))
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def held_out(key: str = "doc_id"):
    """crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.col(key).cast("string")) % 3 == 1


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of each whole text, null ones as empty; learned from labels of ids that are not held out. See byte_cnn.fit and score."""
    docs = table(spark, sf_dir, "documents")
    model = byte_cnn.fit(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = byte_cnn.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {
    "op1_pack": op1_pack,
    "op2_token_counts": op2_token_counts,
    "op3_hnsw": op3_hnsw,
    "op4_segment_topk": op4_segment_topk,
    "op5_url_trust": op5_url_trust,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_token_files": op9_token_files,
    "op10_byte_cnn": op10_byte_cnn,
}

ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORDS = r"'[^\x20\x09-\x0D]+'"

#: Tokenizers, learned weights, ranks that settle and approximate search are beyond SQL; the tests compare those with the libraries or brute force.
ORACLES: dict[str, str] = {}
ORACLES["op4_segment_topk"] = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT DISTINCT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
ORACLES["op6_jaccard_join"] = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ABC}', '{ABC.lower()}'), {WORDS}) AS l FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(l, i, i + 3), ' ') AS s FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 3, 1) + 1)) AS i FROM w WHERE len(l) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 85 * (p.n + q.n - o)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(x, y) AS (SELECT DISTINCT x, x FROM b UNION SELECT r.x, b.y FROM r JOIN b ON b.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS c FROM r GROUP BY 1) m ON m.x = d.doc_id"""
ORACLES["op7_substring_dedup"] = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS l FROM documents),
p AS (SELECT doc_id, i, array_to_string(list_slice(l, i, i + 12), ' ') AS s FROM (SELECT doc_id, l, unnest(range(1, len(l) - 11)) AS i FROM w WHERE len(l) >= 13)),
f AS (SELECT s, min(doc_id) AS least FROM p GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM p JOIN f USING (s), range(13) t(k) WHERE least < doc_id),
k AS (SELECT a.doc_id, string_agg(x, ' ' ORDER BY a.i) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM w) a ANTI JOIN gone ON gone.doc_id = a.doc_id AND gone.i = a.i GROUP BY 1)
SELECT w.doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(len(l) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""
