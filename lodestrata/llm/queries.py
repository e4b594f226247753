"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestrata.llm import decontam, langid, licenses, neardup, packing, pii, secrets, telephony, tokencount, toxicity
from lodestrata.llm.common import documents, held_out


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(F.col("doc_id")))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "restored")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(documents(spark, sf_dir)))


def op3_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony.to_audio(documents(spark, sf_dir), with_pcm=True)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(documents(spark, sf_dir)))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.identify(docs, langid.fit(docs, ~held_out(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(documents(spark, sf_dir))


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(documents(spark, sf_dir))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op 2 that its contract fixes."""
    return op2_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def audio_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op 3 that do not depend on the coding."""
    return telephony.to_audio(documents(spark, sf_dir)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op 6 that its contract fixes."""
    return op6_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def spans_sql(kinds: list[tuple[str, str, int, str]]) -> str:
    """SQL for counts and digest of kinds (name, pattern, group, condition on the match m and the group v)."""
    parts = " UNION ALL ".join(f"SELECT doc_id, {i} AS k, '{name}' AS kind, regexp_extract_all(t, {p}, 0) AS a, regexp_extract_all(t, {p}, {g}) AS v, regexp_split_to_array(t, {p}) AS g FROM d" for i, (name, pattern, g, _) in enumerate(kinds) for p in ["'" + pattern.replace("'", "''") + "'"])
    passes = " OR ".join(f"(k = {i} AND {condition})" for i, (*_, condition) in enumerate(kinds))
    counts = ", ".join(f"count(*) FILTER (kind = '{name}') AS n_{name}" for name, *_ in kinds)
    return (
        f"WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents), p AS ({parts.replace('SELECT doc_id, ', 'SELECT row, doc_id, ')}), "
        "s AS (SELECT row, k, kind, a, v, g, unnest(range(1, len(a) + 1)) AS i FROM p), "
        "x AS (SELECT row, k, kind, a[i] AS m, v[i] AS v, CAST(list_sum(list_transform(g[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(a[1:i - 1], lambda z: length(z))), 0) AS BIGINT) AS start FROM s), "
        f"y AS (SELECT row, k, kind, start, start + length(m) AS stop FROM x WHERE {passes}), "
        f"z AS (SELECT row, {counts}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans FROM y GROUP BY row) "
        f"SELECT d.doc_id, {', '.join(f'coalesce(n_{name}, 0) AS n_{name}' for name, *_ in kinds)}, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN z ON z.row = d.row"
    )


DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
LUHN = f"list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda j: CASE WHEN (length({DIGITS}) - j) % 2 = 0 THEN CAST(substr({DIGITS}, j, 1) AS INTEGER) ELSE 2 * CAST(substr({DIGITS}, j, 1) AS INTEGER) - CASE WHEN CAST(substr({DIGITS}, j, 1) AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_secrets, op3_telephony, op4_licenses, op5_packing, op6_pii, op7_langid, op8_decontam, op9_tokencount, op10_neardup, secrets_base, audio_payload, pii_base)}
ORACLES: dict[str, str] = {
    "secrets_base": spans_sql(
        [
            ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, "length(v) >= 6"),
            ("access", "AKIA[A-Z0-9]+", 0, "length(m) >= 20"),
            ("hex", "[0-9a-f]+", 0, "length(m) >= 24"),
        ]
    ),
    "pii_base": spans_sql(
        [
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0, "TRUE"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0, "len(list_filter(string_split(m, '.'), lambda o: length(ltrim(o, '0')) > 3 OR CAST(CASE WHEN length(ltrim(o, '0')) > 3 THEN '999' ELSE '0' || ltrim(o, '0') END AS INTEGER) > 255)) = 0"),
            ("card", r"[0-9]([\x20-]?[0-9])+", 0, f"length({DIGITS}) BETWEEN 14 AND 19 AND {LUHN}"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0, f"length({DIGITS}) BETWEEN 10 AND 15"),
        ]
    ),
    "audio_payload": "WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), p AS (SELECT doc_id, octet_length(b) AS n, CASE WHEN octet_length(b) = 0 THEN 576 ELSE (576 - octet_length(b) % 576) % 576 END AS pad, b FROM d) SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(n + pad AS BIGINT) AS payload_bytes, sha256(b || unhex(repeat('FF', CAST(pad AS INTEGER)))) AS payload_sha256 FROM p",
}
