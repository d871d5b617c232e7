"""The queries opN_<name>: thin forms of the operators over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, contamination, exact_dedup, licenses, near_dup, quality, records, sharding, toxicity, wordpiece
from quarry.llm.common import parquet


def op1_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(parquet(spark, sf_dir, "documents"), shards=8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )


def op2_matrix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(parquet(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_template_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(parquet(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


#: The templates' words are told to SQL as text; the SQL itself compares every line, and every run of
#: as many words as a notice has, with all of them.
OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
), w AS (
  SELECT doc_id, x, regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d
), p(phrase, label) AS (VALUES {phrases}), t(name, label, notice) AS (VALUES {templates}),
t2 AS (SELECT name, label, list_distinct(regexp_extract_all(lower(notice), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS tw, len(regexp_extract_all(lower(notice), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS n FROM t),
m AS (
  SELECT doc_id, s - 1 AS s, label FROM (SELECT doc_id, w, phrase, label, unnest(range(1, len(w) + 1)) AS s FROM w, p WHERE contains(x, string_split(phrase, ' ')[1]))
  WHERE array_to_string(w[s:s + len(string_split(phrase, ' ')) - 1], ' ') = phrase
), b AS (
  SELECT doc_id, count(*) AS n, min(s) AS a, max(s) AS z, array_to_string(list_sort(list(DISTINCT label)), ',') AS l FROM m GROUP BY doc_id
), f AS (
  SELECT doc_id, x, name, label, tw, n, ceil({threshold} * len(tw) - 1e-9) AS needed FROM w, t2 WHERE len(list_intersect(w, tw)) >= ceil({threshold} * len(tw) - 1e-9)
), lines AS (
  SELECT doc_id, ln, fw, list_distinct(fw) AS lw
  FROM (SELECT doc_id, generate_subscripts(string_split(x, chr(10)), 1) AS ln, regexp_extract_all(unnest(string_split(x, chr(10))), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS fw FROM (SELECT DISTINCT doc_id, x FROM f))
), line_hit AS (
  SELECT doc_id, name, ln, label, len(list_intersect(lw, tw)) / CAST(len(tw) AS DOUBLE) AS c FROM lines JOIN f USING (doc_id)
  WHERE len(lw) >= needed AND len(list_intersect(lw, tw)) >= needed
), lw AS (
  SELECT doc_id, flatten(list(list_transform(fw, lambda x: ln) ORDER BY ln)) AS lines, flatten(list(fw ORDER BY ln)) AS w FROM lines GROUP BY doc_id
), runs AS (
  SELECT doc_id, name, label, tw, needed, w[s:s + n - 1] AS rw, lines[s] AS a, lines[least(s + n - 1, len(w))] AS z
  FROM (SELECT doc_id, lines, w, name, label, tw, n, needed, unnest(range(1, greatest(len(w) - n + 1, 1) + 1)) AS s FROM lw JOIN f USING (doc_id))
), hit AS (
  SELECT doc_id, label, c FROM line_hit
  UNION ALL
  SELECT doc_id, label, len(list_intersect(rw, tw)) / CAST(len(tw) AS DOUBLE) AS c FROM runs r
  WHERE a < z AND len(list_intersect(rw, tw)) >= needed
    AND NOT EXISTS (SELECT 1 FROM line_hit h WHERE h.doc_id = r.doc_id AND h.name = r.name AND h.ln BETWEEN r.a AND r.z)
), ls AS (
  SELECT doc_id, array_to_string(list_sort(list(DISTINCT label)), ',') AS l FROM (SELECT doc_id, label FROM m UNION ALL SELECT doc_id, label FROM hit) GROUP BY doc_id
), sc AS (SELECT doc_id, max(c) AS c FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(z AS BIGINT) AS last_word,
       coalesce(b.l, '') AS base_labels, coalesce(ls.l, '') AS labels, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN ls USING (doc_id) LEFT JOIN sc USING (doc_id)
""".replace("{phrases}", ", ".join(f"('{a}', '{b}')" for a, b in licenses.PHRASES.items())).replace(
    "{templates}", ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(licenses.TEMPLATES))
).replace("{threshold}", str(licenses.THRESHOLD))


def op4_nb_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, of = parquet(spark, sf_dir, "documents"), toxicity.remainder
    model = toxicity.train(docs, parquet(spark, sf_dir, "labels"), of(F.col("doc_id"), 4) != 2)
    out = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", (of(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_pairwise_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, of = parquet(spark, sf_dir, "documents"), toxicity.remainder
    model = quality.train(docs, parquet(spark, sf_dir, "labels"), of(F.col("doc_id"), 3) != 1)
    out = quality.score(docs, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", (of(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.groups(parquet(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)
"""


def op7_bayes_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dup.join(parquet(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "class_id", "n_links", "kept")


#: Every pair with a shingle in common is compared; classes are what can be reached over links.
OP7_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE c * 10 >= 8 * (a.n + b.n - c)
), r(doc_id, reached) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reached = e.x
), c AS (SELECT doc_id, min(reached) AS class_id FROM r GROUP BY doc_id
), l AS (SELECT x AS doc_id, count(*) AS n_links FROM e GROUP BY x)
SELECT doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, class_id = doc_id AS kept FROM c LEFT JOIN l USING (doc_id)
"""


def op8_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = records.write(parquet(spark, sf_dir, "documents"), records.fresh_folder(spark))
    return records.read(manifest).withColumnRenamed("id", "doc_id")


def op9_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count(parquet(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination.report(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "benchmark"), slop=1)
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near",
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)
), n AS (SELECT DISTINCT n FROM bw), m AS (
  SELECT doc_id, s, dw.n, item_id
  FROM (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, n WHERE len(w) >= n)) dw
  JOIN bw USING (g, n)
), bt AS (
  SELECT g, n, unnest(string_split(g, ' ')) AS word, unnest(range(n)) AS k FROM (SELECT DISTINCT g, n FROM bw)
), dt AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d
), rare AS (
  SELECT g, n, arg_min(word, coalesce(df, 0)) AS word FROM bt LEFT JOIN (SELECT word, count(*) AS df FROM dt GROUP BY word) USING (word) GROUP BY g, n
), own AS (
  SELECT doc_id, g, n FROM (SELECT DISTINCT doc_id, g, n FROM rare JOIN dt USING (word)) JOIN d USING (doc_id) WHERE list_has_all(w, string_split(g, ' '))
), near AS (
  SELECT DISTINCT doc_id, g, n FROM own JOIN bt USING (g, n) JOIN dt USING (doc_id, word), (SELECT unnest([-1, 0, 1]) AS away)
  GROUP BY doc_id, g, n, pos - k + away HAVING count(DISTINCT k) = n
), x AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM near JOIN bw USING (g, n) GROUP BY doc_id
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items FROM m GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN x USING (doc_id)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_virtual_slots, op2_matrix_bpe, op3_template_join, op4_nb_ngrams, op5_pairwise_gam, op6_chunk_recipes, op7_bayes_jaccard, op8_record_files, op9_piece_counts, op10_positional_index)}


def oracle_sql() -> dict[str, str]:
    return {"op3_template_join": OP3_SQL, "op6_chunk_recipes": OP6_SQL, "op7_bayes_jaccard": OP7_SQL, "op10_positional_index": OP10_SQL}
