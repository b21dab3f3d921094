"""The registered queries of the operators in this subpackage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm.collocations import collocations
from trafficlens.llm.html_text import main_text
from trafficlens.llm.kneser_ney import judged
from trafficlens.llm.language import language_of
from trafficlens.llm.merkle import folded, leaf_digest, manifest
from trafficlens.llm.mixing import mixed
from trafficlens.llm.near_dedup import NearDuplicates, near_duplicates
from trafficlens.llm.neighbours import near_vectors
from trafficlens.llm.packing import Packing, packed
from trafficlens.llm.paragraphs import without_repeats
from trafficlens.llm.repetition import repetition
from trafficlens.llm.token_counts import TokenCounts, token_counts
from trafficlens.llm.toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_near_duplicates")
def op1(spark, d):
    return near_duplicates(table(spark, d, "documents"), NearDuplicates(shingle_words=2))


# Targets by the level at which capped shares use up the budget; then documents in order of hash.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CAST('0x' || substr(md5(concat_ws(' ', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM sized GROUP BY source),
levels AS (SELECT 2.0 * source_size / w AS level FROM per),
used AS (SELECT level, (SELECT sum(least(w * level, 2.0 * source_size)) FROM per) AS words FROM levels),
budget AS (SELECT 1.5 * sum(source_size) AS b FROM per),
low AS (SELECT coalesce(max(level), 0) AS level FROM used, budget WHERE words <= b),
targets AS (SELECT source, source_size,
    CASE WHEN 2.0 * source_size / w <= low.level THEN 2.0 * source_size
      ELSE w * (b - (SELECT coalesce(sum(2.0 * source_size), 0) FROM per WHERE 2.0 * source_size / w <= low.level))
        / (SELECT sum(w) FROM per WHERE 2.0 * source_size / w > low.level) END AS target
  FROM per, low, budget),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size + 1e-12) AS BIGINT) ELSE 0 END AS whole
  FROM targets),
ties AS (SELECT source, h, sum(size) AS words FROM sized GROUP BY ALL),
run AS (SELECT t.*, target - whole * source_size AS room,
    sum(words) OVER (PARTITION BY t.source ORDER BY h) AS total
  FROM ties t JOIN plan p ON t.source IS NOT DISTINCT FROM p.source),
edge AS (SELECT source, min(h) AS h FROM run WHERE total > room GROUP BY source),
extra AS (SELECT r.source, r.h FROM run r LEFT JOIN edge e ON r.source IS NOT DISTINCT FROM e.source
  WHERE e.h IS NULL OR r.h < e.h OR (r.h = e.h AND words <= 2 * (room - (total - words))))
SELECT doc_id, size, source_size, round(target, 6) AS target,
  CAST(size * (whole + CASE WHEN x.h IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS taken
FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
LEFT JOIN extra x ON s.source IS NOT DISTINCT FROM x.source AND s.h = x.h
"""


@query("op9_mixing", MIX_SQL)
def op9(spark, d):
    return mixed(table(spark, d, "documents")).select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken"
    )


def word_tokenizer() -> str:
    """The installed vocabulary file; its place is the only thing the operators get."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op3_packing")
def op3(spark, d):
    return packed(table(spark, d, "documents"), Packing(word_tokenizer()))


@query("op4_repetition")
def op4(spark, d):
    return repetition(table(spark, d, "documents").select("doc_id", "text")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_covered_words",
        "longest_repeat",
    )


@query("op5_language")
def op5(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    return language_of(docs).select("doc_id", "held_out", "lang_pred", "score")


@query("op2_toxicity")
def op2(spark, d):
    found = toxicity(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "labels"))
    return found.select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query("op8_perplexity")
def op8(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    found = judged(docs, table(spark, d, "labels"), with_text=False)
    return found.select("doc_id", "lang", "perplexity", "threshold", "kept")


@query("op10_near_vectors")
def op10(spark, d):
    return near_vectors(table(spark, d, "embeddings"))


@query("op7_passages")
def op7(spark, d):
    return without_repeats(table(spark, d, "documents").select("doc_id", "text"))


@query("op6_main_text")
def op6(spark, d):
    return main_text(table(spark, d, "pages")).select("page_id", "url", "text", "n_chars")


@query("op11_token_counts")
def op11(spark, d):
    return token_counts(table(spark, d, "documents"), TokenCounts(word_tokenizer()))


# All levels of each tree as lists, then the proofs and the folding of every document; the
# crc32 of the decimal doc_id is taken bit by bit.
MERKLE_SQL = r"""
WITH RECURSIVE bits AS (SELECT i, c FROM (
    WITH RECURSIVE t AS (SELECT i::UBIGINT AS i, i::UBIGINT AS c, 0 AS k FROM range(256) r(i)
      UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM t WHERE k < 8)
    SELECT i, c FROM t WHERE k = 8)),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits),
docs AS (SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, [ascii(x)::UBIGINT FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
      lambda c, x: xor(t[CAST(xor(c, x) & 255 AS BIGINT) + 1], c >> 8)), 4294967295::UBIGINT) % 7 = 0 AS tampered
  FROM documents, crc_table),
parts AS (SELECT doc_id, lang, n_chars, tampered,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS front,
    coalesce(strlen(text) || ':' || text, '-') AS back FROM docs),
leaves AS (SELECT doc_id, lang, sha256(front || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || back) AS leaf,
    sha256(front || coalesce(strlen(CAST(n_chars + CAST(coalesce(tampered, false) AS INT) AS VARCHAR)) || ':'
      || (n_chars + CAST(coalesce(tampered, false) AS INT)), '-') || back) AS claim FROM parts),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS node FROM leaves),
trees AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, list(leaf ORDER BY node) AS nodes
  FROM placed GROUP BY lang),
levels AS (SELECT tree, 0 AS level, nodes FROM trees
  UNION ALL SELECT tree, level + 1, [sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')) FOR i IN range((len(nodes) + 1) // 2)]
  FROM levels WHERE len(nodes) > 1),
subroots AS (SELECT tree, nodes[1] AS subroot FROM levels WHERE len(nodes) = 1),
tops AS (SELECT 0 AS level, (SELECT list(subroot ORDER BY tree) FROM subroots) AS nodes
  UNION ALL SELECT level + 1, [sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], '')) FOR i IN range((len(nodes) + 1) // 2)]
  FROM tops WHERE len(nodes) > 1),
-- one list of steps for each document: below its subroot, then above it
steps AS (
  SELECT p.doc_id, p.lang, p.node AS leaf_node, l.level AS step, p.node >> l.level AS place, l.nodes
  FROM placed p JOIN trees t ON p.lang IS NOT DISTINCT FROM t.lang JOIN levels l ON l.tree = t.tree WHERE len(l.nodes) > 1
  UNION ALL
  SELECT p.doc_id, p.lang, p.node, 1000 + l.level, t.tree >> l.level, l.nodes
  FROM placed p JOIN trees t ON p.lang IS NOT DISTINCT FROM t.lang JOIN tops l ON len(l.nodes) > 1),
proofs AS (SELECT lang, leaf_node,
    list({'odd': place & 1, 'other': coalesce(nodes[CAST(xor(place, 1) AS BIGINT) + 1], '')} ORDER BY step) AS path
  FROM steps GROUP BY ALL),
joined AS (SELECT p.*, s.subroot, (SELECT nodes[1] FROM tops WHERE len(nodes) = 1) AS root, coalesce(path, []) AS path
  FROM placed p JOIN trees t ON p.lang IS NOT DISTINCT FROM t.lang JOIN subroots s ON s.tree = t.tree
  LEFT JOIN proofs q ON p.lang IS NOT DISTINCT FROM q.lang AND p.node = q.leaf_node),
found AS (SELECT doc_id, leaf, subroot, root, sha256(list_reduce(list_prepend('', [x.other FOR x IN path]), lambda a, b: a || b)) AS proof_sha256,
    list_reduce(list_prepend({'odd': 0::BIGINT, 'other': claim}, path),
      lambda a, b: {'odd': 0::BIGINT, 'other': sha256(CASE WHEN b.odd = 1 THEN b.other || a.other ELSE a.other || b.other END)}).other AS folded_root
  FROM joined)
SELECT *, folded_root = root AS verified FROM found
"""


@query("op13_merkle_proofs", MERKLE_SQL)
def op13(spark, d):
    docs = table(spark, d, "documents")
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    # a decimal, so that the greatest long has a successor
    n_chars = F.col("n_chars").cast("decimal(20, 0)") + F.when(altered, 1).otherwise(0)
    claim = leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars.cast("decimal(20, 0)"), F.col("text"))
    found = folded(manifest(docs, claims={"tampered": claim}), ["tampered"])
    as_text = (F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root"))
    return found.select("doc_id", *as_text, "proof_sha256", F.col("tampered_root").alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )


PHRASE_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, unnest([w[i:i + k - 1] FOR i IN range(1, len(w) - k + 2)]) AS words
  FROM listed, range(1, 4) t(k) WHERE len(w) >= k),
counts AS (SELECT lang, words, list_aggregate(words, 'string_agg', ' ') AS phrase, len(words) AS size, count(*)::HUGEINT AS f
  FROM grams GROUP BY lang, words),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (SELECT * FROM counts WHERE size > 1 AND f >= 10),
kept AS (SELECT * FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM candidates d
  WHERE d.lang = c.lang AND d.size > c.size AND (d.words[1:2] = c.words OR d.words[2:3] = c.words) AND 100 * d.f >= 50 * c.f)),
cuts AS (SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, (1000000 * c.f * c.f) // (l.f * r.f) AS score
  FROM kept c, range(1, 3) t(k), counts l, counts r
  WHERE k < c.size AND l.lang = c.lang AND r.lang = c.lang AND l.words = c.words[1:k] AND r.words = c.words[k + 1:c.size]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op12_collocations", PHRASE_SQL)
def op12(spark, d):
    return collocations(table(spark, d, "documents"))
