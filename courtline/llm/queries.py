"""The registered queries of this subpackage: opN_<name> for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .substrings import remove_repeated_strings
from .decontaminate import benchmark_matches
from .nearjoin import near_duplicates
from .quality import classify_quality
from .fixity import archive, audit
from .wordpieces import token_counts
from .phrases import fingerprint_edits
from .packing import pack_documents
from .urlmodel import filter_urls
from .passages import remove_repeated_passages
from .divergence import divergences
from .manifest import FAN, LOWER, UPPER, manifest
from .simhash import simhash_groups


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_anchor_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_passages(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_grouped_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_strings(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_shard_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = benchmark_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, (F.col("n_hit") > 0).alias("contaminated"))


def op7_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as an archive against a replica with damaged, lost and added records."""
    left = archive(_table(spark, sf_dir, "pages"))
    of = F.coalesce("record_id", F.lit(0))
    kept = left.where(of % 193 != 7).withColumn("digest", F.when(of % 97 == 13, F.col("damaged")).otherwise(F.col("digest")))
    added = left.where(of % 211 == 3).withColumn("start", F.col("start") + 1)
    out = audit(left, kept.unionByName(added))
    return out.select(F.col("record_id").alias("page_id"), F.col("file").cast("long").alias("file"), F.col("start").alias("warc_offset"), "length", "kind")


def op1_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def op10_locally_consistent_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(_table(spark, sf_dir, "documents"))


def op3_conflict_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op5_url_markov_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(_table(spark, sf_dir, "documents"))


def op12_lag_lead_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents; a third of them are checked with lower-cased texts."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return manifest(_table(spark, sf_dir, "documents"), tampered, F.translate("text", UPPER, LOWER))


def op13_deletion_variant_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op11_source_divergence": op11_source_divergence, "op12_lag_lead_manifest": op12_lag_lead_manifest, "op13_deletion_variant_simhash": op13_deletion_variant_simhash, "op5_url_markov_ratio": op5_url_markov_ratio, "op3_conflict_best_fit": op3_conflict_best_fit, "op10_locally_consistent_parsing": op10_locally_consistent_parsing, "op1_wordpiece_counts": op1_wordpiece_counts, "op6_merkle_fixity": op6_merkle_fixity, "op4_subword_quality": op4_subword_quality, "op7_chosen_path_join": op7_chosen_path_join, "op2_shard_suffix_decontamination": op2_shard_suffix_decontamination, "op9_grouped_suffix_dedup": op9_grouped_suffix_dedup, "op8_anchor_substring_dedup": op8_anchor_substring_dedup}

def _manifest_sql(levels: int = 7) -> str:
    """The manifest level by level: a node is its lang and place, its hash, and how many nodes its level has. For up to 8**levels rows a lang."""
    leaf = "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
    step = "list_reduce(flatten(list_transform(range(strlen(CAST(doc_id AS VARCHAR))), lambda i: [ascii(substr(CAST(doc_id AS VARCHAR), i + 1, 1)), 0, 0, 0, 0, 0, 0, 0]::BIGINT[])), lambda c, x: xor(xor(c, x) >> 1, CASE WHEN xor(c, x) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295::BIGINT)"
    out = [f"""WITH d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf.format("text")} AS leaf,
  CASE WHEN xor({step}, 4294967295) % 3 = 0 THEN {leaf.format(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other FROM documents),
a0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
l0 AS (SELECT g, pos AS k, leaf AS h, n FROM a0)"""]
    climb = """
{t}{k} AS (SELECT g, k // {fan} AS k, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY k)) ELSE max(h) END AS h, (max(n) + {up}) // {fan} AS n FROM {t}{j} GROUP BY g, k // {fan}),
{t}s{j} AS (SELECT x.g, x.k, coalesce(string_agg(y.h, '' ORDER BY y.k) FILTER (y.k < x.k), '') AS l, coalesce(string_agg(y.h, '' ORDER BY y.k) FILTER (y.k > x.k), '') AS r
  FROM {t}{j} x JOIN {t}{j} y ON x.g = y.g AND x.k // {fan} = y.k // {fan} WHERE x.n > 1 GROUP BY x.g, x.k)"""
    out += [climb.format(t="l", j=j, k=j + 1, fan=FAN, up=FAN - 1) for j in range(levels)]
    out += [f"t0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS k, h, count(*) OVER () AS n, g AS lang FROM l{levels})"]
    out += [climb.format(t="t", j=j, k=j + 1, fan=FAN, up=FAN - 1) for j in range(3)]
    now, have = "f0", "f0 AS (SELECT a.doc_id, a.leaf, l.h AS subroot, t3.h AS root, a.g, a.pos, t0.k AS top, coalesce(a.other, a.leaf) AS f, '' AS p FROM a0 a JOIN l{0} l ON l.g = a.g JOIN t0 ON t0.lang = a.g CROSS JOIN t3)".format(levels)
    out.append(have)
    for n, (t, j) in enumerate([*(("l", j) for j in range(levels)), *(("t", j) for j in range(3))]):
        where, at = ("s.g = x.g", "pos") if t == "l" else ("true", "top")
        out.append(f"f{n + 1} AS (SELECT x.* EXCLUDE (f, p), CASE WHEN s.g IS NULL THEN f ELSE sha256(s.l || f || s.r) END AS f, p || coalesce(s.l || s.r, '') AS p FROM {now} x LEFT JOIN {t}s{j} s ON {where} AND s.k = x.{at} // {FAN**j})")
        now = f"f{n + 1}"
    return ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, f AS folded_root, f = root AS verified FROM {now}"


ORACLE_SQL: dict[str, str] = {
    "op12_lag_lead_manifest": _manifest_sql(),
    "op11_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM w GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
cell AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS all_n FROM g JOIN kept k USING (lang) LEFT JOIN c USING (lang, source, term)),
shares AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM cell),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
q AS (SELECT s.lang, s.source, s.term, s.n, s.p, 1 + (1000000000::HUGEINT * (s.all_n + 1)) // (l.total + l.v) AS q FROM shares s JOIN langs l USING (lang)),
terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM q WHERE n > 0 AND p > q),
ranked AS (SELECT *, 'pair' AS part, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL SELECT *, 'term', row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
""",
    "op6_merkle_fixity": r"""
WITH r AS (
  SELECT page_id, CAST(floor(page_id / 256.0) AS BIGINT) AS file,
         CAST(strlen('WARC/1.0') + 2 + strlen('WARC-Type: response') + 2 + strlen('WARC-Record-ID: <urn:page:') + strlen(CAST(page_id AS VARCHAR)) + strlen('>') + 2
           + strlen('WARC-Target-URI: ') + strlen(coalesce(url, '')) + 2 + strlen('Content-Length: ') + strlen(CAST(strlen(coalesce(html, '')) AS VARCHAR)) + 4 + strlen(coalesce(html, '')) + 4 AS BIGINT) AS length
  FROM pages),
a AS (
  SELECT page_id, file, length,
         CAST(coalesce(sum(length) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS warc_offset
  FROM r)
SELECT page_id, file, warc_offset, length, 'missing' AS kind FROM a WHERE page_id % 193 = 7
UNION ALL SELECT page_id, file, warc_offset, length, 'corrupt' FROM a WHERE page_id % 97 = 13 AND page_id % 193 <> 7
UNION ALL SELECT page_id, file, warc_offset + 1, length, 'extra' FROM a WHERE page_id % 211 = 3
""",
}
