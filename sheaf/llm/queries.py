"""Registered queries of this package, each next to its oracle SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINE_FREQUENCY_SQL = rf"""
WITH t AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), b AS (
  SELECT doc_id, source, text, w, len(w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols
  FROM t
), g AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM again, range(5) r(k) GROUP BY doc_id
), ln AS (
  SELECT doc_id, source, line, regexp_extract_all(translate(line, '{UPPER}', '{LOWER}'), '{WORD}') AS lw
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM t)
), full_ln AS (
  SELECT *, array_to_string(lw, ' ') AS norm FROM ln WHERE len(lw) > 0
), dup AS (
  SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n FROM full_ln GROUP BY doc_id
), one AS (
  SELECT min(doc_id) AS doc_id, source FROM t GROUP BY source, text
), host AS (
  SELECT source, count(*) AS docs FROM one GROUP BY source
), freq AS (
  SELECT f.source, f.norm, count(DISTINCT f.doc_id) AS n FROM full_ln f JOIN one USING (doc_id) GROUP BY ALL
), above AS (
  SELECT f.source, f.norm FROM freq f JOIN host h ON f.source IS NOT DISTINCT FROM h.source WHERE f.n > greatest(5.0, h.docs * 0.02)
), lost AS (
  SELECT f.doc_id, sum(len(f.lw))::BIGINT AS n
  FROM full_ln f JOIN above a ON f.source IS NOT DISTINCT FROM a.source AND f.norm = a.norm GROUP BY f.doc_id
), m AS (
  SELECT b.doc_id, b.n_words, b.word_chars, b.n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    coalesce(lost.n, 0) AS n_removed_words
  FROM b LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_words - n_removed_words < n_words * 0.3) AS kept
FROM m
"""


@query("op4_line_frequency", LINE_FREQUENCY_SQL)
def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_frequency import line_frequency

    return line_frequency(table(spark, sf_dir, "documents"))


SHINGLE_LINKS_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE list_slice(w, i, i + 4) END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id, d.doc_id = r.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
"""


@query("op8_similarity_sketch", SHINGLE_LINKS_SQL)
def op8_similarity_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .similarity_sketch import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("rest")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("rest", 256).alias("kept_sha256"),
    )


SIZES_SQL = rf"""
SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, coalesce(text, '') AS text FROM documents
"""

MIX_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, size,
    -ln(1.0::DOUBLE - u) / CASE WHEN length(text) = 0 THEN 1.0 ELSE greatest(length(translate(text, '#*$%&|<>{{}}[]\^~_=+@!', ''))::DOUBLE / length(text), 0.05) END AS key
  FROM (SELECT *, ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / (1::BIGINT << 52)::DOUBLE AS u FROM ({SIZES_SQL}))
), s AS (
  SELECT *, (ARRAY[5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)
), lv AS (
  SELECT *, source_size * 3 / weight AS level FROM s
), sh AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY level, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY level, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share,
    row_number() OVER (ORDER BY level, encode(source) NULLS LAST) AS turn FROM lv
), t AS (
  SELECT source, source_size, least(source_size * 3, weight * coalesce((SELECT arg_min(share, turn) FROM sh WHERE share < level), level))::DOUBLE AS target FROM sh
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS epochs FROM t
), p AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, target - epochs * source_size AS part,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id::VARCHAR, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN before < part AND before + size / 2.0 <= part THEN 1 ELSE 0 END))::BIGINT AS taken FROM p
"""


@query("op7_weighted_mixing", MIX_SQL)
def op7_weighted_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .weighted_mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_hypergeometric_shuffle")
def op9_hypergeometric_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hypergeometric_shuffle import shuffle_into

    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = shuffle_into(rows, 8, ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .best_fit_packing import pack, pieces

    cut = pieces(table(spark, sf_dir, "documents"), tokenizer_path())
    return pack(cut, ["doc_id", "piece", "ids_crc32"])


COSINE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), n AS (
  SELECT a AS vec_id, count(*)::BIGINT AS n FROM links GROUP BY a
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, r.c AS component_id, e.vec_id = r.c AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) JOIN (SELECT a AS vec_id, min(b) AS c FROM reach GROUP BY a) r USING (vec_id)
"""


@query("op10_collision_counting", COSINE_SQL)
def op10_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collision_counting import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("op6_ppm_language")
def op6_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import held_out, train_rows
    from .ppm_language import identify, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(train_rows(4, 2)))
    marked = docs.withColumn("held_out", held_out(4, 2))
    return identify(marked, model, keep=("doc_id", "held_out"))


@query("op3_compression_quality")
def op3_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import held_out, train_rows
    from .compression_quality import classify, train

    docs = table(spark, sf_dir, "documents")
    learned = train_rows(3, 1)
    model = train(docs.where(learned), table(spark, sf_dir, "labels").where(learned))
    return classify(docs.withColumn("held_out", held_out(3, 1)), model, keep=("doc_id", "held_out"))


@query("op1_suffix_tree_lm")
def op1_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import held_out, train_rows
    from .suffix_tree_lm import score, train

    docs = table(spark, sf_dir, "documents")
    tree, counts = train(docs.where(train_rows(7, 2)))
    marked = docs.withColumn("held_out", held_out(7, 2))
    return score(marked, tree, counts, keep=("doc_id", "held_out"))


@query("op11_overlap_tokens")
def op11_overlap_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import digests, periodic_runs, planted

    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", checksum.alias("checksum"))
    return digests(periodic_runs(docs, order=("checksum", planted)))


@query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_repair import damaged, report

    rows = table(spark, sf_dir, "conversations")
    return report(rows, damaged(rows))
