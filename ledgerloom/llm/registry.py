"""The queries of this subpackage, and SQL for what it can express of them: of five operators, a query of those columns alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import audio, conversations, decontaminate, html, language, mixing, near, pii, substrings, tokens, toxicity, urls, whitening


def _url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4_urls decides by explicit rules."""
    return urls.op4_urls(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("given"))


def _audio_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op7_audio reads back, as far as SQL has it."""
    return audio.op7_audio(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes")


def _text_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of op5_near_duplicates."""
    return near.op5_near_duplicates(spark, sf_dir).select("doc_id", "text_id", "n_links")


def _mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of op1_mixing, and whether its taken words keep its limits."""
    mix = mixing.op1_mixing(spark, sf_dir)
    whole = F.col("taken") % F.greatest(F.col("size"), F.lit(1)) == 0
    return mix.select("doc_id", "size", "source_size", ((F.col("taken") <= 2 * F.col("size")) & whole).alias("within"))


def _pii_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text of op6_pii with its letters and digits as one sign each: a pseudonym has its value's format."""
    shape = lambda c: F.regexp_replace(F.regexp_replace(c, "[0-9]", "0"), "[A-Za-z]", "a")
    return pii.op6_pii(spark, sf_dir).select("doc_id", F.md5(F.regexp_replace(shape(F.col("text")), r"0+\.0+\.0+\.0+", "ip")).alias("shape"))


_URL = "CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END"
_WORDS = r"regexp_extract_all(t, '[^\s]+')"
SQL = {
    "url_rules": f"""WITH r AS (SELECT page_id, coalesce({_URL}, '') rest FROM pages), h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') host0 FROM r),
 p AS (SELECT page_id, translate(host0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(substr(rest, length(host0) + 1), '^[^?#]*') AS path FROM h),
 k(rule, name, below, verdict) AS (VALUES {", ".join(f"('{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}', '{verdict}')" for rule, verdict in urls.RULES)}),
 f AS (SELECT page_id, rule, verdict FROM p JOIN k ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, below) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) = 1)
 SELECT p.page_id, host, path, rule, verdict AS given FROM p LEFT JOIN f ON p.page_id = f.page_id""",
    "audio_payloads": """WITH b AS (SELECT doc_id, encode(coalesce(text, '')) x FROM documents), n AS (SELECT *, octet_length(x) AS n FROM b),
 p AS (SELECT *, CASE WHEN n = 0 THEN 576 ELSE (576 - n % 576) % 576 END pad FROM n)
 SELECT doc_id, n n_bytes, n + pad AS payload_bytes, sha256(x || repeat('\\xFF'::BLOB, pad)) payload_sha256, (((n + pad) // 576 + 1) * 672 + 10 + 10 + 9 + length(CAST(n AS VARCHAR)) + 128) AS media_bytes FROM p""",
    "text_links": f"""WITH d AS (SELECT doc_id, coalesce(text, '') t FROM documents), u AS (SELECT t, min(doc_id) text_id FROM d GROUP BY t), w AS (SELECT text_id, {_WORDS} w FROM u),
 g AS (SELECT DISTINCT text_id, array_to_string(w[i : i + 4], ' ') g FROM (SELECT text_id, w, unnest(range(1, greatest(2, len(w) - 3))) i FROM w WHERE len(w) > 0)),
 n AS (SELECT text_id, count(*) n FROM g GROUP BY 1), c AS (SELECT a.text_id a, b.text_id b, count(*) c FROM g a JOIN g b ON a.g = b.g AND a.text_id <> b.text_id GROUP BY 1, 2),
 l AS (SELECT a, count(*) n_links FROM c JOIN n x ON x.text_id = a JOIN n y ON y.text_id = b WHERE c >= 0.8 * (x.n + y.n - c) GROUP BY a)
 SELECT doc_id, u.text_id, coalesce(n_links, 0) n_links FROM d JOIN u ON d.t = u.t LEFT JOIN l ON u.text_id = a""",
    "mix_targets": r"""WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) size FROM documents)
 SELECT doc_id, size, CAST(sum(size) OVER (PARTITION BY source) AS BIGINT) source_size, true AS within FROM s""",
    "pii_shape": r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[0-9]', '0', 'g'), '[A-Za-z]', 'a', 'g'), '0+\.0+\.0+\.0+', 'ip', 'g')) AS shape FROM documents",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_html": html.op2_html,
        "op3_language": language.op3_language,
        "op4_urls": urls.op4_urls,
        "op5_near_duplicates": near.op5_near_duplicates,
        "op6_pii": pii.op6_pii,
        "op7_audio": audio.op7_audio,
        "op8_decontamination": decontaminate.op8_decontamination,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_substrings": substrings.op10_substrings,
        "op11_tokens": tokens.op11_tokens,
        "op12_conversations": conversations.op12_conversations,
        "op13_whitening": whitening.op13_whitening,
        "url_rules": _url_rules,
        "audio_payloads": _audio_payloads,
        "text_links": _text_links,
        "mix_targets": _mix_targets,
        "pii_shape": _pii_shape,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
