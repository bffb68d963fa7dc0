"""The queries of this subpackage and the SQL they are checked against.

Each query reads a whole table, applies one operator with its production parameters and returns all of its result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subweave.llm import bpe, chat, imatch, licenses, linededup, ngramjoin, packing, quality, tokenfiles, urls
from subweave.store import new_path, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.clustered(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op1_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 with the number of links, which its SQL does not have."""
    return ngramjoin.clustered(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ledger, without texts: policies and ablations read no text again."""
    return stored(quality.ledger(_table(spark, sf_dir, "documents")).drop("text"), "ledger")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _ledger(spark, sf_dir)
    base = F.col("failed").bitwiseAND(F.lit(quality.BASE.mask(quality.RULES))) != 0
    return quality.applied(scored, quality.FULL).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


def op2_quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each rule of both policies what it rejects, alone and at all, and what is kept without it."""
    scored = _ledger(spark, sf_dir)
    return quality.ablations(scored, quality.BASE).unionByName(quality.ablations(scored, quality.FULL))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.round_trip(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.dedup_lines(_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = imatch.with_edits(_table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        imatch.written(F.col("hashes")).alias("fingerprint"),
        imatch.written(F.col("edited_hashes")).alias("edited_fingerprint"),
        imatch.likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        imatch.likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    tokenfiles.write_tokens(_table(spark, sf_dir, "documents"), path)
    return tokenfiles.summed(tokenfiles.read_tokens(spark, path))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return urls.judge_urls(pages, urls.fitted(pages)).select("page_id", "host", "path", "rule", "verdict")


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(_table(spark, sf_dir, "conversations"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_table(spark, sf_dir, "documents")).select("doc_id", "license", "coverage", "first_word", "n_words", F.array_join("licenses", ",").alias("licenses"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op1_ngram_jaccard_links": op1_ngram_jaccard_links,
    "op2_quality_rules": op2_quality_rules,
    "op2_quality_ablations": op2_quality_ablations,
    "op3_packing": op3_packing,
    "op4_bpe": op4_bpe,
    "op5_line_dedup": op5_line_dedup,
    "op6_document_fingerprints": op6_document_fingerprints,
    "op7_token_files": op7_token_files,
    "op8_url_filters": op8_url_filters,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_license_scans": op10_license_scans,
}

_WORD = r"[^\x20\x09-\x0D]+"
_STRIP = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_OP1 = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '{_WORD}') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
links AS MATERIALIZED (
  SELECT p.r AS a, q.r AS b FROM s p JOIN s q ON p.g = q.g AND p.r <> q.r JOIN n x ON x.r = p.r JOIN n y ON y.r = q.r
  GROUP BY p.r, q.r, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (r) JOIN (SELECT reach.a AS r, min(e.doc_id) AS c FROM reach JOIN d e ON e.r = reach.b GROUP BY reach.a) m USING (r)
"""

_LEDGER = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS MATERIALIZED (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM (
    SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2))),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY r),
l AS MATERIALIZED (
  SELECT r, x, count(*) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{_WORD}') GROUP BY r, x),
dup AS (SELECT r, CAST(sum(n - 1) AS BIGINT) AS dups, CAST(sum(n) AS BIGINT) AS lines FROM l GROUP BY r),
m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    coalesce(dups, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lines, 0) AS n_lines,
    len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '!')) AS n_exclaim
  FROM d LEFT JOIN rep USING (r) LEFT JOIN dup USING (r)),
f AS (
  SELECT *, {" + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in quality.RULES)} AS bits FROM m)
"""

_OP2 = _LEDGER + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  bits = 0 AS kept, CAST(bits AS BIGINT) AS failed FROM f
"""


def _ablation(policy: quality.Policy, rule: quality.Rule) -> str:
    mask, bit = policy.mask(quality.RULES), 1 << rule.bit
    return (
        f"SELECT '{policy.version}' AS policy, '{rule.name}' AS rule, count(*) FILTER (WHERE bits & {bit} <> 0) AS failing,"
        f" count(*) FILTER (WHERE bits & {mask} = {bit}) AS only, count(*) FILTER (WHERE bits & {mask & ~bit} = 0) AS kept_without FROM f"
    )


_ABLATIONS = _LEDGER + " UNION ALL ".join(_ablation(p, r) for p in (quality.BASE, quality.FULL) for r in quality.RULES if r.name in p.rules)

_OP5 = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS MATERIALIZED (
  SELECT r, i, x[i] AS line, translate(regexp_replace(x[i], '{_STRIP}', '', 'g'), {_LOWER}) AS k
  FROM (SELECT r, x, unnest(range(1, len(x) + 1)) AS i FROM d)),
bad AS MATERIALIZED (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10),
kept AS (SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t FROM l WHERE k NOT IN (SELECT k FROM bad) GROUP BY r)
SELECT doc_id, CAST(len(x) AS BIGINT) AS n_lines, CAST(len(x) - coalesce(n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


#: For conversations without tool calls, as the table has them; linking is tested against a brute-force version.
_OP9 = """
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, text, role) - 1 AS position,
  CAST(NULL AS BIGINT) AS call_turn, false AS linked, CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_bad_calls,
  CAST(0 AS BIGINT) AS n_repeated_ids,
  CAST(json_object('content', text, 'conv_id', conv_id, 'role', role, 'turn', turn) AS VARCHAR) AS json
FROM conversations
"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _op8() -> str:
    hosts = sorted(urls.HOSTS, key=lambda r: (-len(r.name), -len(r.host)))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    name = " ".join(f"WHEN {fits(r)} THEN '{r.name}'" for r in hosts)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in hosts)
    other = " ".join(f"WHEN regexp_matches(whole, {_quoted(r.pattern.replace(chr(92) + 'Z', chr(92) + 'z'))}, 's') THEN '{r.verdict}'" for r in urls.PATTERNS)
    return rf"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_LOWER}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, translate(host || path, {_LOWER}) AS whole FROM b)
SELECT page_id, host, path, CASE {name} END AS rule, CASE {verdict} {other} ELSE '{urls.PRODUCTION.default}' END AS verdict FROM c
"""


ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": _OP1,
    "op2_quality_rules": _OP2,
    "op2_quality_ablations": _ABLATIONS,
    "op5_line_dedup": _OP5,
    "op8_url_filters": _op8(),
    "op9_chat_formatting": _OP9,
}
