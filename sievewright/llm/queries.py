"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .decontam import decontaminate
from .exact_dedup import exact_dedup
from .license_scan import TEMPLATES, license_scan, most_words
from .line_dedup import dedup_lines
from .quality import quality_scores
from .segment import encoded
from .simhash import simhash_components
from .suffix_dedup import remove_repeats
from .token_count import token_counts
from .warc import archived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn

    return register


@query(
    "op10_exact_dedup",
    """
    WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
    r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
    """,
)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op9_token_count")
def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


@query("op8_simhash_near_dedup")
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read_table(spark, sf_dir, "documents"), radius=4, words=4)


@query("op4_quality_classifier")
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query(
    "op5_decontamination",
    """
    WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    iwin AS (SELECT DISTINCT item_id, least(13, len(w)) AS l, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: list_slice(w, i, i + least(13, len(w)) - 1))) AS g FROM iw WHERE len(w) > 0),
    ls AS (SELECT DISTINCT l FROM iwin),
    dwin AS (SELECT doc_id, l, unnest(range(1, len(w) - l + 2)) AS i, w FROM dw, ls WHERE len(w) >= l),
    hit AS (SELECT d.doc_id, d.i, d.l, x.item_id FROM (SELECT doc_id, l, i, list_slice(w, i, i + l - 1) AS g FROM dwin) d JOIN iwin x ON d.g = x.g AND d.l = x.l),
    words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY 1),
    its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY 1)
    SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
    """,
)
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query("op1_line_dedup")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query(
    "op2_warc",
    """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
    b AS (SELECT *, list_transform(range(40), lambda i: instr('0123456789abcdef', substr(h, i + 1, 1)) - 1) AS x FROM p),
    bits AS (SELECT *, list_transform(range(160), lambda i: (x[i // 4 + 1] >> (3 - i % 4)) & 1) AS z FROM b)
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
      list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (16 * z[5 * i + 1] + 8 * z[5 * i + 2] + 4 * z[5 * i + 3] + 2 * z[5 * i + 4] + z[5 * i + 5] + 1)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
      CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
    FROM bits
    """,
)
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(read_table(spark, sf_dir, "pages")).drop("url")


def _license_oracle(threshold: float = 0.8) -> str:
    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES.items())
    most = most_words(TEMPLATES, threshold)
    grams = "list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    return f"""
    WITH t AS (SELECT name, string_split(trim(regexp_replace(lower(s), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM (VALUES {rows}) v(name, s)),
    tg AS (SELECT name, {grams.format(w="w")} AS b FROM t),
    d AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') AS n FROM documents),
    p AS (SELECT doc_id, n, list_filter(list_transform(string_split_regex(n, '\\n *\\n'), lambda s: trim(regexp_replace(s, '[ \\n]+', ' ', 'g'))), lambda s: s <> '') AS p FROM d),
    c AS (SELECT doc_id, n, p, list_transform(range(len(p) + 1), lambda i: coalesce(list_sum(list_transform(list_slice(p, 1, i), lambda s: len(string_split(s, ' ')))), 0)) AS c FROM p),
    f AS (SELECT doc_id, p, c, unnest(range(1, len(p) + 1)) AS i FROM c),
    r AS (SELECT doc_id, p, i, unnest(list_filter(range(i + 1, len(p) + 1), lambda j: c[j + 1] - c[i] <= {most})) AS j FROM f),
    u AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(list_transform(string_split(n, chr(10)) || [n], lambda s: trim(regexp_replace(s, '[ \\n]+', ' ', 'g')))) AS s FROM d
      UNION ALL SELECT doc_id, unnest(p) FROM p UNION ALL SELECT doc_id, array_to_string(list_slice(p, i, j), ' ') FROM r)),
    uw AS (SELECT doc_id, s, string_split(s, ' ') AS w FROM u),
    ug AS (SELECT doc_id, s, {grams.format(w="w")} AS b FROM uw WHERE len(w) > 1),
    m AS (SELECT doc_id, s, max(struct_pack(dice := 2.0::DOUBLE * len(list_intersect(ug.b, tg.b)) / (len(ug.b) + len(tg.b)), name := name)) AS x FROM ug, tg
      WHERE 2.0::DOUBLE * len(list_intersect(ug.b, tg.b)) / (len(ug.b) + len(tg.b)) >= {threshold} GROUP BY 1, 2),
    best AS (SELECT doc_id, count(DISTINCT x.name) AS n_found, max(x) AS x FROM m GROUP BY 1)
    SELECT d.doc_id, coalesce(n_found, 0) AS n_found, x.name AS license, round(x.dice, 6) AS dice FROM d LEFT JOIN best USING (doc_id)
    """


@query("op3_license_scan", _license_oracle())
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents"))


@query("op7_sentencepiece_nbest")
def op7_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), n=4)


@query("op6_suffix_dedup")
def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"), width=400)
