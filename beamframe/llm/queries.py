"""The thin queries of the numbered operators and of nothing else: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from beamframe.llm import centroids, decontaminate, jaccard, language, lines, packing, pii, quality, repeats, token_files, token_spans, url_filter, vector_codes
from beamframe.llm.encode import vocabulary
from beamframe.llm.shared import materialize, new_path

URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op2_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_spans.attribute_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), ["source", "text"])


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, keep=["page_id"])


def op4_jaccard_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents"), (80, 100), 5)


def op5_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), 200)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), size=1024, end_id=2)


def op7_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.report(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "ids")
    manifest = materialize(token_files.write_token_files(table(spark, sf_dir, "documents"), folder, vocabulary("word_bpe_49k.json"), end_id=1), "manifest")
    return token_files.read_token_files(manifest, folder)


def op9_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_slice_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.report(table(spark, sf_dir, "embeddings"), dims=64, parts=4, size=256, rounds=4, scale=1024)


def op12_zone_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64)


def op13_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"), least=40, enough=5)


QUERIES = {
    "op1_pii_boosting": op1_pii_boosting,
    "op2_token_spans": op2_token_spans,
    "op3_url_filter": op3_url_filter,
    "op4_jaccard_trees": op4_jaccard_trees,
    "op5_repeated_strings": op5_repeated_strings,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_language_crf": op7_language_crf,
    "op8_token_files": op8_token_files,
    "op9_quality_outliers": op9_quality_outliers,
    "op10_decontamination": op10_decontamination,
    "op11_slice_masks": op11_slice_masks,
    "op12_zone_centroids": op12_zone_centroids,
    "op13_line_runs": op13_line_runs,
}

_URL_PARTS = """
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_replace(substr(url, strpos(url, '://') + 3), '[?#](.|\\n)*$', '') ELSE '' END AS rest FROM pages),
p AS (SELECT page_id,
        translate(CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, 1, strpos(rest, '/') - 1) ELSE rest END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM u)"""

#: Ends of a line that don't count.
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LINES_SQL = f"""
WITH doc AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM doc),
k AS (SELECT *, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, pos, line, f.key IS NOT NULL AND k.doc_id <> last AS dropped FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256 FROM j GROUP BY doc_id"""

_KEPT = "embedding IS NOT NULL AND len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"


def _codes_sql(rounds: int = 4) -> str:
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings WHERE {_KEPT})",
        "x AS MATERIALIZED (SELECT vec_id, p, q[p * 16 + 1 : p * 16 + 16] AS q FROM v, range(4) r(p))",
        "c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, q FROM x WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 256))",
    ]
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, x.p, any_value(x.q) AS q, min(struct_pack(d := list_sum([t[1] * t[1] FOR t IN [[x.q[i] - c.q[i]] FOR i IN range(1, 17)]])::BIGINT, e := c.e)) AS n FROM x JOIN c{k} c ON x.p = c.p GROUP BY vec_id, x.p)")
        if k < rounds:
            means = f"SELECT p, n.e AS e, i, CAST(floor(sum(q[i]) / count(*)) AS BIGINT) AS m FROM a{k}, range(1, 17) r(i) GROUP BY ALL"
            steps.append(f"m{k} AS MATERIALIZED (SELECT p, e, list(m ORDER BY i) AS q FROM ({means}) GROUP BY p, e)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.q, c.q) AS q FROM c{k} c LEFT JOIN m{k} m ON c.p = m.p AND c.e = m.e)")
    steps.append(f"r AS (SELECT vec_id, string_agg(printf('%02x', n.e), '' ORDER BY p) AS code, sum(n.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r JOIN v USING (vec_id), h"


def _clusters_sql(rounds: int = 3) -> str:
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings WHERE {_KEPT})",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS e, q FROM v QUALIFY e < 16)",
    ]
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, any_value(v.q) AS q, min(struct_pack(d := list_sum([t[1] * t[1] FOR t IN [[v.q[i] - c.q[i]] FOR i IN range(1, 65)]])::BIGINT, e := c.e)) AS n FROM v, c{k} c GROUP BY vec_id)")
        if k < rounds:
            means = f"SELECT n.e AS e, i, CAST(floor(sum(q[i]) / count(*)) AS BIGINT) AS m FROM a{k}, range(1, 65) r(i) GROUP BY ALL"
            steps.append(f"m{k} AS MATERIALIZED (SELECT e, list(m ORDER BY i) AS q FROM ({means}) GROUP BY e)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.e, coalesce(m.q, c.q) AS q FROM c{k} c LEFT JOIN m{k} m ON c.e = m.e)")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, n.e::INT AS cluster, n.d AS distance, (sum(n.d) OVER (PARTITION BY n.e))::BIGINT AS cluster_inertia, (sum(n.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.n.e = c.e"""


ORACLE_SQL = {
    "op3_url_filter": f"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES {", ".join(map(str, URL_RULES))}), {_URL_PARTS},
hits AS (SELECT page_id, arg_max(r_host || r_path, length(r_host) * 1000 + length(r_path)) AS rule, arg_max(r_verdict, length(r_host) * 1000 + length(r_path)) AS verdict
    FROM p JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN hits ON p.page_id = hits.page_id""",
    "op11_slice_masks": _codes_sql(),
    "op12_zone_centroids": _clusters_sql(),
    "op13_line_runs": _LINES_SQL,
}
