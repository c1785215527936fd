"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import decontam, language, line_dedup, media, minhash, mixing, secrets, token_store, toxicity, url_filter
from brindle.sources.shared import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup over all documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.drop_repeated_lines(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL["op3_line_dedup"] = r"""
WITH rows AS (
    SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), exploded AS (
    SELECT doc_id, r, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM rows
), keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM exploded
), repeated AS (
    SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 AND doc_id IS NOT NULL
    GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), decided AS (
    SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.first AS dropped FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM decided GROUP BY doc_id, r
"""


@_query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


SQL["op7_mixing"] = r"""
WITH sized AS (
    SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || ':7') AS u,
        len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::DOUBLE AS cap,
        [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
    FROM sized GROUP BY source
), filled AS (
    SELECT *, coalesce(sum(cap) OVER less, 0) AS fixed, sum(weight) OVER more AS open, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total
    FROM sources
    WINDOW less AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        more AS (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), level AS (
    SELECT arg_min((total - fixed) / open, cap / weight) FILTER (WHERE (total - fixed) / open <= cap / weight) AS per_weight FROM filled
), targets AS (
    SELECT source, source_size, least(cap, coalesce(weight * per_weight, cap)) AS target FROM filled, level
), needs AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets
), placed AS (
    SELECT d.doc_id, d.size, n.source_size, n.target, n.whole, n.target - n.whole * n.source_size AS need,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY u, doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM sized d JOIN needs n ON d.source IS NOT DISTINCT FROM n.source
)
SELECT doc_id, size, source_size, target,
    (size * (whole + CASE WHEN need > 0 AND before + size / 2 <= need THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""


@_query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's url."""
    judged = url_filter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


_SUFFIXES = ", ".join(f"'{s}'" for s in url_filter.DOUBLE_SUFFIXES)
_TRANSLATE = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_RULES = ", ".join(f"('{action}', '{text}', '{text.partition('/')[0]}', '/{text.partition('/')[2]}')" for action, text in url_filter.RULES)


def _rho_sql(level: str, above: str) -> str:
    return f"""{level}_parts AS (
    SELECT count(*)::DOUBLE AS g, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, sum(n::DOUBLE * n) AS nn, sum(k::DOUBLE * k / n) AS kk FROM {level} WHERE n > 0 GROUP BY {above}
), {level}_sums AS (
    SELECT sum(g - 1) AS df, sum(n - g) AS dw, sum(kk - k * k / n) / sum(g - 1) AS b, sum(k - kk) / sum(n - g) AS w, sum(n - nn / n) / sum(g - 1) AS m FROM {level}_parts
), {level}_rho AS (
    SELECT CASE WHEN coalesce(df, 0) = 0 OR dw <= 0 THEN 0.5
        ELSE least(0.99, greatest(0.01, CASE WHEN b + (m - 1) * w > 0 THEN (b - w) / (b + (m - 1) * w) ELSE 0.01 END)) END::DOUBLE AS rho FROM {level}_sums
)"""


SQL["op8_url_filter"] = rf"""
WITH parsed AS (
    SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), {_TRANSLATE}) AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), rules(action, rule, rule_host, rule_path) AS (VALUES {_RULES}
), fitted AS (
    SELECT p.host, p.path, max_by(r.rule, length(r.rule)) AS rule, max_by(r.action, length(r.rule)) AS action
    FROM (SELECT DISTINCT host, path FROM parsed) p
    JOIN rules r ON (p.host = r.rule_host OR p.host LIKE '%.' || r.rule_host) AND starts_with(p.path, r.rule_path)
    GROUP BY p.host, p.path
), ruled AS (
    SELECT p.*, f.rule, f.action, CASE WHEN array_to_string(string_split(p.host, '.')[-2:], '.') IN ({_SUFFIXES}) THEN 2 ELSE 1 END AS labels
    FROM parsed p LEFT JOIN fitted f ON p.host = f.host AND p.path = f.path
), host AS (
    SELECT host, array_to_string(string_split(host, '.')[-(labels + 1):], '.') AS domain, array_to_string(string_split(host, '.')[-labels:], '.') AS suffix,
        count(rule) AS n, count(*) FILTER (WHERE action = 'allow') AS k
    FROM ruled GROUP BY ALL
), {_rho_sql("host", "domain")}, counted AS (
    SELECT *, CASE WHEN n > 0 THEN n / (1 + (n - 1) * rho) ELSE 0 END::DOUBLE AS hn, CASE WHEN n > 0 THEN k / (1 + (n - 1) * rho) ELSE 0 END::DOUBLE AS hk FROM host, host_rho
), domain AS (
    SELECT domain, suffix, sum(n) AS n, sum(k) AS k, sum(hn) AS inn, sum(hk) AS ink FROM counted GROUP BY domain, suffix
), {_rho_sql("domain", "suffix")}, dealt AS (
    SELECT domain, suffix, inn, ink, (1 - rho) / rho AS own,
        CASE WHEN inn > 0 THEN inn / (1 + (inn - 1) * rho) ELSE 0 END::DOUBLE AS dn, CASE WHEN inn > 0 THEN ink / (1 + (inn - 1) * rho) ELSE 0 END::DOUBLE AS dk
    FROM domain, domain_rho
), beside AS (
    SELECT *, greatest(0, sum(dn) OVER (PARTITION BY suffix) - dn) AS bn, greatest(0, sum(dk) OVER (PARTITION BY suffix) - dk) AS bk FROM dealt
), domain_prior AS (
    SELECT domain, inn, ink, (bk + 1) / (bn + 2) AS mean, (bn + 2) * own / (bn + 2 + own + 1) AS weight FROM beside
), above AS (
    SELECT c.host, c.n, c.k, (1 - c.rho) / c.rho AS own, greatest(0, p.inn - c.hn) + p.weight AS weight,
        (greatest(0, p.ink - c.hk) + p.weight * p.mean) / (greatest(0, p.inn - c.hn) + p.weight) AS mean
    FROM counted c JOIN domain_prior p ON c.domain = p.domain
), host_prior AS (
    SELECT host, n, k, mean, weight * own / (weight + own + 1) AS weight FROM above
), rated AS (
    SELECT host, (k + weight * mean) / (n + weight) AS good, n + weight AS weight FROM host_prior
)
SELECT r.page_id, r.host, r.path, r.rule,
    coalesce(r.action, CASE WHEN least(1.0, good + 1.645 * sqrt(good * (1 - good) / (weight + 1.0))) < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r JOIN rated t ON r.host = t.host
"""


@_query
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


SQL["op6_minhash"] = r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS shingle FROM worded
), sized AS (
    SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM common JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), edges AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
    SELECT a, b FROM edges UNION SELECT r.a, l.b FROM reach r JOIN edges l ON r.b = l.a
), lowest AS (
    SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.low, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(l.low, d.doc_id)) AS kept
FROM documents d LEFT JOIN sized s ON d.doc_id = s.doc_id LEFT JOIN lowest l ON d.doc_id = l.doc_id
"""


@_query
def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids, written to a store and read back."""
    import public_tokenizers

    path = token_store.write_store(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_store.store_summary(spark, path)


@_query
def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and the benchmark items that they hold."""
    return decontam.benchmark_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _crc(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo a number; null counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


@_query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs.where(_crc(3) != 1).select("doc_id", "text", "lang"))
    held_out = (_crc(3) == 1).alias("held_out")
    return language.predict_language(docs, model).select("doc_id", held_out, "lang_pred", "score")


@_query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learnt from the labels that are not held out."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(_crc(4) != 2))
    held_out = (_crc(4) == 2).alias("held_out")
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out, "score", "predicted")



@_query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, with digests of the base patterns' findings."""
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "literal")
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, kind))).cast("bigint").alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@_query
def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' texts kept in progressive JPEG, read back, with features of the decoded images."""
    stored = materialize(media.store_texts(_table(spark, sf_dir, "documents")), "media")
    return media.stored_features(stored)
