"""The queries of these operators, over their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import spread
from ._shared import scratch_path


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_read(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "repetitions"
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_site_lines, host_of, html_text

    pages = _read(spark, sf_dir, "pages")
    return drop_site_lines(pages.select("page_id", "url", "html"), host_of(F.col("url")), html_text(F.col("html"))).select(
        "page_id", "host", "n_lines", "n_dropped", "kept_text"
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(_read(spark, sf_dir, "pages"))


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import surrogate_documents

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogate_documents(docs, key="op1").select("doc_id", "text", "entities", F.size("entities").alias("n_entities"))


def op2_pack_power_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    packed = pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, score

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, _read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op4_media_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import feature_text, with_features, with_media

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    sized = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    stored = with_media(sized).drop("text")
    f = F.col("features")
    return with_features(stored).select(
        "doc_id", "n_bytes", f["payload_bytes"].alias("payload_bytes"), f["payload_sha256"].alias("payload_sha256"),
        f["tail_crc32"].alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), feature_text(f).alias("feature"),
    )


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(_read(spark, sf_dir, "documents"))


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score_documents

    return score_documents(_read(spark, sf_dir, "documents"))


def op11_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_files import round_trip

    return round_trip(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch_path(spark, "token-files"))


def op12_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .alignment import align

    return align(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import resample

    return resample(_read(spark, sf_dir, "documents").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_surrogates, op2_pack_power_of_two, op3_toxicity, op4_media_containers, op5_nearest, op6_mix_sources, op7_ngram_jaccard, op8_line_dedup,
        op9_warc, op10_pseudo_likelihood, op11_packed_ids, op12_align_tokenizers, op13_resample,
    )
}


def _line_sql() -> str:
    from . import line_dedup as L

    q = lambda x: x.replace("'", "''")
    text = f"regexp_replace(regexp_replace(regexp_replace(html, '{L.SCRIPTS}', '', 'g'), '{L.BROKEN}', chr(10), 'g'), '{L.TAG}', '', 'g')"
    for name, char in L.ENTITIES:
        text = f"replace({text}, '{q(name)}', '{q(char)}')"
    trim = lambda x: f"trim({x}, {' || '.join(f'chr({ord(c)})' for c in L.BLANKS)})"
    return f"""WITH p AS (SELECT page_id, nullif(lower(regexp_extract(url, '{L.HOST}', 1)), '') AS host, string_split({text}, chr(10)) AS lines FROM pages),
l AS (SELECT DISTINCT page_id, host, {trim('x')} AS line FROM (SELECT page_id, host, unnest(lines) AS x FROM p) WHERE {trim('x')} <> ''),
h AS (SELECT host, count(*) AS pages FROM p GROUP BY 1),
c AS (SELECT host, line, count(*) AS n FROM l GROUP BY ALL),
d AS (SELECT c.host, list(line) AS gone FROM c JOIN h ON c.host IS NOT DISTINCT FROM h.host WHERE n >= 5 AND n > 0.1::DOUBLE * pages GROUP BY 1)
SELECT page_id, p.host, len(list_filter(lines, lambda x: {trim('x')} <> ''))::BIGINT AS n_lines,
  len(list_filter(lines, lambda x: {trim('x')} <> '' AND list_contains(coalesce(gone, []), {trim('x')})))::BIGINT AS n_dropped,
  array_to_string(list_filter(lines, lambda x: {trim('x')} = '' OR NOT list_contains(coalesce(gone, []), {trim('x')})), chr(10)) AS kept_text
FROM p LEFT JOIN d ON p.host IS NOT DISTINCT FROM d.host"""


def _warc_sql() -> str:
    from .warc import BASE32

    letters = [f"substr('{BASE32}', ((('0x' || substr(h, {g * 5 + 1}, 5))::BIGINT >> {15 - 5 * k}) & 31)::INT + 1, 1)" for g in range(8) for k in range(4)]
    return f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, payload_bytes, {' || '.join(letters)} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM p"""


def _resample_sql() -> str:
    words = r"list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
    # The 256 steps of the checksum come from its rule: eight shifts, each with the polynomial where a bit falls out.
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""WITH RECURSIVE step(i, k, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, {step} FROM step WHERE k < 8),
steps AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS words FROM documents),
w AS (SELECT r, unnest(words) AS word FROM d),
b AS (SELECT unnest({words}) AS word FROM benchmark),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(trim(regexp_replace(hex(encode(word)), '(..)', '\\1 ', 'g')), ' '),
    lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c >> 8, t[xor(c, x) % 256 + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM (SELECT word FROM w UNION ALL SELECT word FROM b)), steps),
s AS (SELECT bucket, count(*) AS n FROM w JOIN hashed USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM b JOIN hashed USING (word) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000) / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT r, sum(gain)::BIGINT AS weight FROM w JOIN hashed USING (word) JOIN g USING (bucket) GROUP BY 1),
scored AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (r)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id, n_features) AS place, count(*) FILTER (n_features >= 20) OVER () AS able FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= able * 10 // 100 THEN place END AS rank FROM placed"""


ORACLE_SQL: dict[str, str] = {"op13_resample": _resample_sql(), "op8_line_dedup": _line_sql(), "op9_warc": _warc_sql()}
