"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiforge.llm import hard_negatives, merkle, mixing, omh, perspectives, phrases, posting, secret_scan, tiling, token_files, toxicity, urls, warc
from kpiforge.llm.common import staged, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mix takes (sources weigh 5, 2, 1, repeating; 150 % of all words)."""
    rows = staged(table(spark, sf_dir, "documents").select(
        "source", F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"),
        mixing.word_count(F.col("text")).alias("size")), "mix-rows")
    return mixing.mix_sizes(rows).select(
        F.col("id").alias("doc_id"), "size", "source_size", F.col("target").cast("double").alias("target"),
        F.col("taken").cast("long").alias("taken"), "source", "copies")


@_query
def op2_toxic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain judges toxic, with the chain's probabilities."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_chain(docs, table(spark, sf_dir, "labels"))
    return toxicity.toxic_documents(docs, model)


def tokenizer_path() -> str:
    """The production tokenizer's file: the public vocabulary that the installed package names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as Simple-8b token files, read back."""
    return token_files.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@_query
def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that cover half of a benchmark item or more, in any order of its pieces."""
    return tiling.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        F.col("id").alias("doc_id"), "n_items", "best_item", F.round("coverage", 6).alias("coverage"), "n_tiles")


@_query
def op5_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back through the verified record chains."""
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    records = warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "path")
    return warc.complete(manifest, staged(records, "warc-records")).drop("path")


SQL["op5_warc_records"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h FROM p),
g AS (SELECT h, max(page_id) AS last FROM d GROUP BY h),
b AS (SELECT h, last, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), 'string_agg', '') AS digest
      FROM g)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM d JOIN b USING (h)
"""


@_query
def op6_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every speaker's side, by turns, with training masks."""
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


SQL["op6_chat_perspectives"] = """
WITH said AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM said WHERE role <> 'system'),
seg AS (
  SELECT s.conv_id, perspective, turn, role, text, role = perspective AS own,
         CASE WHEN role = perspective THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>'
              ELSE '<|user name=' || role || '|>' END || chr(10) AS head,
         md5(role || chr(10) || text) AS h
  FROM said s JOIN speakers p ON s.conv_id IS NOT DISTINCT FROM p.conv_id),
whole AS (SELECT *, head || text || '<|end|>' || chr(10) AS segment FROM seg),
placed AS (
  SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, h
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM whole)
SELECT conv_id, perspective, turn, role, segment, start,
       CASE WHEN own THEN start + length(head) END AS mask_start, CASE WHEN own THEN start + length(segment) END AS mask_end
FROM placed
"""


@_query
def op7_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known secret formats and random-looking strings of every document."""
    return secret_scan.find_secrets(table(spark, sf_dir, "documents")).drop("found")


@_query
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document: equal texts, and texts with an aligned similarity of 0.8 or more."""
    return omh.near_duplicates(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id")


@_query
def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th row by inner product."""
    return posting.nearest(table(spark, sf_dir, "embeddings"))


@_query
def op10_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule or model verdict for every page's URL."""
    return urls.judge_urls(table(spark, sf_dir, "pages"))


@_query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and check of every document against the manifest; every third id's text is lower-cased before the check."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    tampered = {"text": F.when(third, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))}
    manifest = merkle.build(table(spark, sf_dir, "documents"), tampered=tampered)
    return merkle.proofs(manifest).drop("path", "lang").withColumnRenamed("id", "doc_id")


def _merkle_sql(levels: int = 12) -> str:
    """DuckDB's manifest: one pair of steps per level (8 ** 12 leaves a language), then a fold along the siblings."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = """list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
        lambda c: list_prepend(ascii(c)::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
        lambda a, c: CASE WHEN c >= 0 THEN xor(a, c) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"""  # a digit, then its 8 bits

    def tree(name: str, leaves: str) -> str:
        """CTEs name0, name1, ...: grp, i, h of each level; a group stays when it has one node."""
        out = [f"{name}0 AS ({leaves})"]
        for k in range(1, levels + 1):
            out.append(f"{name}{k} AS (SELECT grp, i // 8 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}{k - 1} "
                       f"WHERE grp IN (SELECT grp FROM {name}{k - 1} WHERE i > 0) GROUP BY grp, i // 8)")
        return ",\n".join(out)

    def sides(name: str) -> str:
        """Siblings before and after each node that has a parent."""
        return " UNION ALL ".join(
            f"""SELECT grp, {k} AS level, i, coalesce(string_agg(h, '') OVER (PARTITION BY grp, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
            coalesce(string_agg(h, '') OVER (PARTITION BY grp, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
            FROM {name}{k} WHERE grp IN (SELECT grp FROM {name}{k} WHERE i > 0)""" for k in range(levels))

    def top(name: str) -> str:
        return " UNION ALL ".join(f"SELECT grp, h FROM {name}{k} WHERE grp NOT IN (SELECT grp FROM {name}{k} WHERE i > 0)" for k in range(levels + 1))

    return f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, lang, {leaf('text')} AS leaf,
         CASE WHEN xor({crc}, 4294967295) % 3 = 0 THEN {leaf(lowered)} ELSE {leaf('text')} END AS claimed FROM documents),
langs AS (SELECT lang, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS grp FROM (SELECT DISTINCT lang FROM documents)),
leaves AS (
  SELECT doc_id, l.grp, row_number() OVER (PARTITION BY l.grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf, claimed
  FROM docs d JOIN langs l ON d.lang IS NOT DISTINCT FROM l.lang),
{tree('t', 'SELECT grp, i, leaf AS h FROM leaves')},
subroots AS ({top('t')}),
{tree('u', 'SELECT 0 AS grp, grp AS i, h FROM subroots')},
the_root AS ({top('u')}),
t_sides AS MATERIALIZED ({sides('t')}),
u_sides AS MATERIALIZED ({sides('u')}),
up AS (
  SELECT l.doc_id, l.grp, l.i, s.level, s.before, s.after FROM leaves l JOIN t_sides s ON s.grp = l.grp AND s.i = l.i // (8 ** s.level)::BIGINT
  UNION ALL
  SELECT l.doc_id, l.grp, l.i, {levels} + s.level, s.before, s.after FROM leaves l JOIN u_sides s ON s.i = l.grp // (8 ** s.level)::BIGINT),
path AS (SELECT grp, i, list(before ORDER BY level) AS b, list(after ORDER BY level) AS a,
                sha256(string_agg(before || after, '' ORDER BY level)) AS proof FROM up GROUP BY grp, i),
folded AS (
  SELECT l.doc_id, l.grp, l.i, l.leaf, l.claimed AS h, coalesce(p.b, []) AS b, coalesce(p.a, []) AS a, coalesce(p.proof, sha256('')) AS proof, 0 AS step
  FROM leaves l LEFT JOIN path p USING (grp, i)
  UNION ALL
  SELECT doc_id, grp, i, leaf, sha256(b[step + 1] || h || a[step + 1]), b, a, proof, step + 1 FROM folded WHERE step < len(b))
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, proof AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM folded f JOIN subroots s USING (grp), the_root r WHERE f.step = len(f.b)
"""


SQL["op13_merkle_manifest"] = _merkle_sql()


@_query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives of each of the five positives of every 100th row."""
    return hard_negatives.mine(
        table(spark, sf_dir, "embeddings"), lambda x: x % 100 == 0,
        relabel=lambda x, label: F.when(x % 7 == 0, (label + 1) % 10).otherwise(label))


SQL["op12_hard_negatives"] = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY rank <= 10
"""


@_query
def op11_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stay when windows of 50 words that an earlier document holds go."""
    return phrases.without_repeats(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")
