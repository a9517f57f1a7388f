"""The registered queries of the corpus operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import archive, decontaminate, hard_negatives, language_id, license_scan, line_dedup, mixing, packing, prefix_trie, simhash_dedup, substring_dedup, token_store, winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL["op3_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS win FROM w, unnest(range(1, len(words) - 48)) AS t(i)),
f AS (SELECT win, min(doc_id) AS first_id FROM p GROUP BY win),
h AS (SELECT p.doc_id, list(p.i) AS starts FROM p JOIN f USING (win) WHERE p.doc_id > f.first_id GROUP BY p.doc_id),
c AS (SELECT h.doc_id, list(DISTINCT s.i + o.k) AS hit FROM h, unnest(h.starts) AS s(i), range(0, 50) AS o(k) GROUP BY h.doc_id),
e AS (SELECT w.doc_id, u.i, w.words[u.i] AS word FROM w, unnest(range(1, len(w.words) + 1)) AS u(i)),
x AS (SELECT c.doc_id, unnest(c.hit) AS i FROM c),
k AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) AS kept, count(*) AS n FROM e ANTI JOIN x ON e.doc_id = x.doc_id AND e.i = x.i GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(len(w.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""


@query
def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    m = decontaminate.matches(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "match.*")
    ids = F.sha2(F.concat_ws(",", "items"), 256)
    return m.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated")


ORACLE_SQL["op2_decontaminate"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
win AS (SELECT item_id, least(13, len(words)) AS n, array_to_string(words[i:i + 12], ' ') AS w
        FROM b, unnest(range(1, greatest(len(words) - 12, CASE WHEN len(words) > 0 THEN 1 ELSE 0 END) + 1)) AS t(i)),
k AS (SELECT DISTINCT n FROM win),
p AS (SELECT d.doc_id, k.n, t.i, array_to_string(d.words[t.i:t.i + k.n - 1], ' ') AS w FROM d, k, unnest(range(1, len(d.words) - k.n + 2)) AS t(i)),
h AS (SELECT p.doc_id, p.i, p.n, win.item_id FROM p JOIN win ON p.w = win.w AND p.n = win.n),
c AS (SELECT doc_id, count(DISTINCT i + o.k) AS n_hit FROM h, range(0, 13) AS o(k) WHERE o.k < h.n GROUP BY doc_id),
x AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(x.ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(x.ids, ','), '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.words) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)
"""


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of labelled documents: 2 for good ones, 0.5 for others; documents without a label weigh 1."""
    weight = F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5)
    return table(spark, sf_dir, "labels").select("doc_id", weight.alias("weight"))


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), quality_weights(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


ORACLE_SQL["op10_mixing"] = r"""
WITH q AS (SELECT doc_id, avg(CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE END) AS q FROM labels GROUP BY doc_id),
d AS (SELECT documents.doc_id, coalesce(source, '') AS s, source IS NULL AS z, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
      -ln((('0x' || substr(md5('mix:' || coalesce(CAST(documents.doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / coalesce(q.q, 1.0::DOUBLE) AS key
      FROM documents LEFT JOIN q USING (doc_id)),
src AS (SELECT s, z, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY z, s) AS rank FROM d GROUP BY s, z),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(rank - 1) % 3 + 1] AS w, source_size * 2 AS cap FROM src),
lv AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
       FROM w WINDOW b AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fin AS (SELECT arg_min(level, (cap / w, rank)) AS level FROM lv WHERE cap / w > level),
g AS (SELECT lv.s, lv.z, lv.source_size, least(lv.cap, coalesce(fin.level * lv.w, lv.cap)) AS target FROM lv LEFT JOIN fin ON true),
r AS (SELECT d.*, g.source_size, g.target, sum(size) OVER (PARTITION BY d.s, d.z ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS run FROM d JOIN g ON d.s = g.s AND d.z = g.z),
t AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM r)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, round(target, 6) AS target,
       CAST(size * (whole + CASE WHEN size > 0 AND run - size / 2.0::DOUBLE <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM t
"""


@query
def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edit_trial(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_index(*token_store.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path()))


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archive.read_archives(archive.write_archives(table(spark, sf_dir, "pages")), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op5_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first_id FROM p WHERE strlen(html) >= 100 GROUP BY html)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha256(p.html) AS payload_digest,
       CASE WHEN f.first_id IS NULL OR f.first_id = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f USING (html)
"""


def _remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3


def language_model(docs: DataFrame) -> language_id.Model:
    """Learned from labelled rows of documents whose crc32(doc_id) mod 3 is not 1; language_id.sample states the bounds."""
    return language_id.train(language_id.sample(docs, _remainder() != 1))


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs.select("doc_id", "text"), language_model(docs), with_runs=False)
    held = F.coalesce(_remainder() == 1, F.lit(False)).alias("held_out")
    return found.select("doc_id", held, F.col("language.lang").alias("lang_pred"), "language.score")


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), bands=line_dedup.BANDS)


@query
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), license_scan.known_licenses(spark))


def _license_oracle() -> str:
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in license_scan.KNOWN)
    return f"""
WITH known AS (SELECT min(id) AS license_id, digest FROM (SELECT id, sha256({license_scan.canonical_sql("body")}) AS digest FROM (VALUES {rows}) AS t(id, body)) GROUP BY digest),
d AS (SELECT doc_id, sha256({license_scan.canonical_sql("text")}) AS digest FROM documents)
SELECT d.doc_id, d.digest, known.license_id FROM d LEFT JOIN known ON d.digest = known.digest AND d.digest <> sha256('')
"""


ORACLE_SQL["op7_license_scan"] = _license_oracle()


@query
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), with_ids=False)


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", shifted), F.col("vec_id") % 100 == 0)


ORACLE_SQL["op12_hard_negatives"] = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.other AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other)
QUALIFY row_number() OVER w <= 10
"""


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_turns = F.crc32(F.col("c").cast("string").cast("binary")) % 6
    return prefix_trie.trie(*prefix_trie.rebuilt(table(spark, sf_dir, "conversations"), shared_turns))
