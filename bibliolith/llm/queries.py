"""The registered corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_repeats import remove_repeated_bytes
from .divergence import audit_sources
from .fingerprints import fingerprint_documents
from .jaccard import similar_components
from .line_labels import fit_line_labels, judge_lines
from .mixing import mix_sources
from .packing import pack_documents
from .ppm import score_documents
from .sharding import shard_documents
from .toxicity import fit_toxicity, score_toxicity
from .url_lists import filter_captures, url_host
from .whitening import whiten_embeddings
from .word_repeats import remove_repeated_words

TOXIC_AT = 0.3
FOLDS, HELD_OUT = 4, 2
# What a passage of 50 words has at least: the test texts have 6.3 bytes a word, and 5 % of such passages less than 224 bytes.
PASSAGE_BYTES = 200


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column) -> F.Column:
    return F.pmod(F.crc32(column.cast("string")), F.lit(FOLDS))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_stratified_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"), shards=8)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"), learn_from=fold(F.col("_id")) != HELD_OUT)
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"),
    )


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(_table(spark, sf_dir, "documents"), n=5, percent=80)


def op4_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return judge_lines(docs, fit_line_labels(docs, _table(spark, sf_dir, "labels")))


def dated_list(pages: DataFrame) -> DataFrame:
    """A list for the test pages, which have none: by the digits of its MD5, a host is blocked from some day
    on and dropped 60 days later or not; the domain above it may be allowed, blocked or neither."""
    hosts = pages.select(url_host(F.col("url")).alias("host")).where("host <> ''").distinct()
    above = hosts.select(F.regexp_replace("host", r"^[^.]+\.", "").alias("host")).where("host like '%.%.%'").distinct()
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.conv(F.substring("digest", 2, 2), 16, 10).cast("int"))
    known = hosts.withColumn("digest", F.md5(F.concat(F.lit("host:"), "host"))).where("substring(digest, 1, 1) < '8'")
    listed = known.select(F.col("host").alias("entry"), day.alias("day"), F.lit("block").alias("action"))
    dropped = known.where("substring(digest, 4, 1) < '8'").select(
        F.col("host").alias("entry"), F.date_add(day, 60).alias("day"), F.lit("drop").alias("action")
    )
    parents = above.withColumn("digest", F.md5(F.concat(F.lit("domain:"), "host"))).where("substring(digest, 1, 1) < '8'")
    domains = parents.select(
        F.col("host").alias("entry"),
        day.alias("day"),
        F.when(F.col("digest").substr(4, 1) < "8", "block").otherwise("allow").alias("action"),
    )
    return listed.unionByName(dropped).unionByName(domains)


def op5_temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int"))
    captures = pages.select("page_id", "url", fetched.alias("fetched"))
    return filter_captures(captures, dated_list(pages)).withColumn("fetched", F.col("fetched").cast("string"))


def op6_word_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(_table(spark, sf_dir, "documents"), window=50)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"), max_epochs=3).drop("repetitions")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_file())


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_repeated``, beyond the contract, reports passages of about 50 words: bytes in strings of 200 bytes that start anywhere else."""
    return remove_repeated_bytes(_table(spark, sf_dir, "documents"), length=400, report=PASSAGE_BYTES)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened = whiten_embeddings(_table(spark, sf_dir, "embeddings"), components=8)
    return whitened.withColumn("deviation", F.col("deviation").cast("long"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(_table(spark, sf_dir, "documents"), min_docs=30, top=50)


def op13_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenth = F.pmod(F.crc32(F.col("_id").cast("string")), F.lit(10))
    scored = score_documents(_table(spark, sf_dir, "documents"), learn_from=tenth != 0)
    held_out = F.col("doc_id").isNotNull() & ~F.col("learned")
    return scored.withColumn("held_out", held_out).drop("learned")


QUERIES = {
    f.__name__: f
    for f in (
        op1_stratified_interleaving,
        op2_toxicity,
        op3_ngram_jaccard,
        op4_line_labels,
        op5_temporal_lists,
        op6_word_repeats,
        op7_mixing,
        op8_fingerprints,
        op9_packing,
        op10_suffix_dedup,
        op11_embedding_whitening,
        op12_source_divergence,
        op13_ppm_scores,
    )
}

_OP5_SQL = r"""
WITH hosted AS (
  SELECT page_id, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1) AS host,
         DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS fetched
  FROM pages),
hosts AS (SELECT DISTINCT host FROM hosted WHERE host <> ''),
above AS (SELECT DISTINCT regexp_replace(host, '^[^.]+\.', '') AS host FROM hosts
          WHERE regexp_replace(host, '^[^.]+\.', '') LIKE '%.%.%'),
known AS (SELECT host, md5('host:' || host) AS digest FROM hosts),
parents AS (SELECT host, md5('domain:' || host) AS digest FROM above),
dated AS (
  SELECT host, digest, kind, DATE '2024-01-01' + CAST(('0x' || substr(digest, 2, 2)) AS INTEGER) AS day
  FROM (SELECT host, digest, 'host' AS kind FROM known UNION ALL SELECT host, digest, 'domain' FROM parents)
  WHERE substr(digest, 1, 1) < '8'),
lines AS (
  SELECT host AS entry, day, CASE WHEN kind = 'host' OR substr(digest, 4, 1) < '8' THEN 'block' ELSE 'allow' END AS action FROM dated
  UNION ALL
  SELECT host, day + 60, 'drop' FROM dated WHERE kind = 'host' AND substr(digest, 4, 1) < '8'),
daily AS (
  SELECT entry, day, max(CASE action WHEN 'block' THEN 1 WHEN 'allow' THEN 2 ELSE 3 END) AS strength FROM lines GROUP BY entry, day),
intervals AS (
  SELECT entry, strength, day AS valid_from, lead(day) OVER (PARTITION BY entry ORDER BY day) AS valid_to FROM daily),
keys AS (
  SELECT page_id, host, fetched, parts, unnest(CASE WHEN host = '' THEN [0] ELSE range(1, greatest(len(parts), 2)) END) AS i
  FROM (SELECT *, string_split(host, '.') AS parts FROM hosted)),
met AS (
  SELECT k.page_id, k.host, k.fetched, v.entry, v.strength, len(k.parts) - k.i AS labels
  FROM keys k LEFT JOIN intervals v
    ON v.entry = array_to_string(list_slice(k.parts, k.i, len(k.parts)), '.') AND v.strength < 3 AND k.i > 0
   AND k.fetched >= v.valid_from AND (v.valid_to IS NULL OR k.fetched < v.valid_to)),
best AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY (entry IS NULL), labels DESC) AS place FROM met)
SELECT page_id, host, CAST(fetched AS VARCHAR) AS fetched, entry,
       CASE strength WHEN 1 THEN 'block' WHEN 2 THEN 'allow' END AS action, coalesce(strength, 2) <> 1 AS kept
FROM best WHERE place = 1
"""

_OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)),
least AS (SELECT h, min(doc_id) AS d FROM windows GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i
  FROM windows JOIN least USING (h) WHERE d < doc_id),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
laid AS (
  SELECT p.doc_id, count(g.i) AS n_removed, coalesce(string_agg(p.word, ' ' ORDER BY p.i) FILTER (WHERE g.i IS NULL), '') AS kept
  FROM placed p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN laid USING (doc_id)
"""

_OP7_SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce('=' || source, '') AS src,
         CAST('0x' || substr(md5('7:' || doc_id), 1, 8) AS BIGINT) AS key
  FROM documents),
sources AS (SELECT src, sum(size)::BIGINT AS source_size FROM sized GROUP BY src),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY src = '', src) - 1) % 3) + 1 AS weight FROM sources),
levels AS (
  SELECT *, row_number() OVER by_level AS k,
         coalesce(sum(3 * source_size) OVER (by_level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS clamped,
         (sum(weight) OVER () - coalesce(sum(weight) OVER (by_level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
         (sum(source_size) OVER ())::BIGINT AS total
  FROM weighed WINDOW by_level AS (ORDER BY (3 * source_size)::DOUBLE / weight, src)),
fitting AS (SELECT *, (total - clamped)::DOUBLE / rest::DOUBLE AS level FROM levels),
first AS (SELECT k AS k0, level AS level0 FROM fitting WHERE level * weight <= (3 * source_size)::DOUBLE ORDER BY k LIMIT 1),
targets AS (
  SELECT src, source_size, CASE WHEN k0 IS NULL OR k < k0 THEN (3 * source_size)::DOUBLE ELSE level0 * weight END AS target
  FROM fitting LEFT JOIN first ON true),
ordered AS (
  SELECT s.*, t.source_size, t.target,
         coalesce(sum(size) OVER (PARTITION BY s.src ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole
  FROM sized s JOIN targets t ON s.src = t.src),
split AS (SELECT *, target - whole * source_size AS extra FROM ordered)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0
            ELSE least(whole + CASE WHEN (2 * before + size)::DOUBLE <= extra * 2 AND extra > 0 THEN 1 ELSE 0 END, 3) END::BIGINT * size AS taken
FROM split
"""

_CRC_TABLE = []
for _byte in range(256):
    for _ in range(8):
        _byte = _byte >> 1 ^ 0xEDB88320 * (_byte & 1)
    _CRC_TABLE.append(_byte)

_OP1_SQL = rf"""
WITH raw AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (
  SELECT doc_id, coalesce('=' || source, '') AS src, (n + 1)::BIGINT AS size,
    CAST('0x' || substr(md5('20:' || doc_id), 1, 8) AS BIGINT) AS key,
    CASE WHEN n = 0 THEN 0 ELSE xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(range(0, n), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
      lambda c, b: xor(c >> 8, {_CRC_TABLE}[(xor(c, b) & 255) + 1]))) END AS text_crc32
  FROM raw),
ranked AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY src ORDER BY key, doc_id) - 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY src))::DOUBLE AS f FROM sized),
placed AS (SELECT *, row_number() OVER (ORDER BY f, src, key, doc_id) - 1 AS pos, count(*) OVER () AS total FROM ranked),
cut AS (SELECT *, pos * 8 // total AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INTEGER AS shard, (pos - (shard * total + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM cut
"""

_OP3_SQL = r"""
WITH RECURSIVE listed AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM listed WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM listed
  UNION
  SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b)
SELECT l.doc_id, coalesce(n, 0) AS n_shingles, least_id AS component_id
FROM listed l LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS least_id FROM reach GROUP BY 1) USING (doc_id)
"""

_OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
said AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM said GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
groups AS (SELECT DISTINCT lang, source FROM docs),
counted AS (SELECT lang, source, term, count(*) AS n FROM said GROUP BY ALL),
filled AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n::HUGEINT AS n_lang,
         sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source)::HUGEINT AS total, count(*) OVER (PARTITION BY g.lang, g.source)::HUGEINT AS v,
         sum(k.n) OVER (PARTITION BY g.lang, g.source)::HUGEINT AS total_lang
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
weighed AS (
  SELECT *, 1 + (1000000000 * (n + 5)) // (total + 5 * v) AS p, 1 + (1000000000 * (n_lang + 5)) // (total_lang + 5 * v) AS q FROM filled),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM weighed a JOIN weighed b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM weighed WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""

ORACLES: dict[str, str] = {
    "op1_stratified_interleaving": _OP1_SQL,
    "op3_ngram_jaccard": _OP3_SQL,
    "op5_temporal_lists": _OP5_SQL,
    "op6_word_repeats": _OP6_SQL,
    "op7_mixing": _OP7_SQL,
    "op12_source_divergence": _OP12_SQL,
}
