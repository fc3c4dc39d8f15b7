"""The registered queries ``opN_<name>`` of this package and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op9_token_counts")
def op9(spark, sf_dir):
    import public_tokenizers

    from logsieve.llm.tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


@query("op4_secret_scan")
def op4(spark, sf_dir):
    from logsieve.llm.secret_scan import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"), false_discoveries=0.01)


@query("op6_simhash_near_duplicates")
def op6(spark, sf_dir):
    from logsieve.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4).drop("root")


_OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
t AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri
      FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, tri) AS n FROM t) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
l AS (SELECT r, len(x) AS n, len(x) - len(list_distinct(x)) AS dup FROM (
      SELECT r, list_filter(string_split(text, chr(10)), lambda line: regexp_matches(line, '[^\x20\x09-\x0D]')) AS x FROM d)),
m AS (
  SELECT doc_id, len(w.w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, l.dup AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words, l.n AS n_lines,
         len(regexp_extract_all(text, '\p{L}[^\x20\x09-\x0D]*')) AS n_letter_words,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals
  FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN covered USING (r)),
b AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
         + 4 * (100 * n_symbols > 10 * n_words)::BIGINT + 8 * (word_chars < 2 * n_words)::BIGINT
         + 16 * (word_chars > 15 * n_words)::BIGINT + 32 * (100 * n_dup_lines > 50 * n_lines)::BIGINT
         + 64 * (100 * n_letter_words < 70 * n_words)::BIGINT + 128 * (100 * n_capitals > 50 * word_chars)::BIGINT AS failed_bits
  FROM m)
SELECT *, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept FROM b
"""


@query("op5_quality_rules", _OP5_SQL)
def op5(spark, sf_dir):
    from logsieve.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents"), "v1")


@query("op10_personal_data")
def op10(spark, sf_dir):
    from logsieve.llm.personal_data import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


_OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(no - 1) % 3 + 1] AS weight, 2::DOUBLE * source_size AS room FROM s),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size)::BIGINT FROM s) - coalesce(sum(room) OVER (
             ORDER BY room / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY room / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, no, source_size, least(room, weight * (SELECT max(level) FROM l)) AS target FROM l),
n AS (SELECT *, floor(target + 0.5)::BIGINT // greatest(source_size, 1) AS laps, floor(target + 0.5)::BIGINT % greatest(source_size, 1) AS rest FROM t),
p AS (SELECT d.*, n.* EXCLUDE (source), (sum(size) OVER (
             PARTITION BY no ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS start
      FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, source, size, source_size, target,
       laps * size + greatest(0, least(start + size, rest) - start) AS taken FROM p
"""


@query("op1_source_mix", _OP1_SQL)
def op1(spark, sf_dir):
    from logsieve.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)


#: Rules by host and path and their verdicts.
URL_RULES = {
    "com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block",
}

_OP2_SQL = r"""
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
known AS (SELECT doc_id, max(quality = 0 OR toxic = 1) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
marked AS (SELECT p.*, k.bad FROM parsed p LEFT JOIN known k
           ON k.doc_id = TRY_CAST(nullif(regexp_extract(path, '([0-9]+)', 1), '') AS BIGINT)),
paths AS (SELECT host, path, count(*) AS pages, count(bad) AS labelled, coalesce(sum(bad::INT), 0) AS bad FROM marked GROUP BY ALL),
shaped AS (
  SELECT *, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''),
            lambda s: regexp_replace(s, '^(?:[0-9]+|[0-9A-Fa-f]{8,}|[0-9A-Fa-f-]{36})(\.[A-Za-z0-9]{1,5})?\z', '*\1')) AS x FROM paths),
placed AS (SELECT host, path, pages, i, x[i] AS segment, array_to_string(x[1:i - 1], '/') AS parent
           FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM shaped)),
children AS (SELECT host, parent, i, segment, sum(pages) AS pages FROM placed GROUP BY ALL),
wild AS (SELECT host, parent, i FROM children GROUP BY ALL HAVING count(*) >= 8 AND 2 * count(*) > sum(pages)),
grown AS (SELECT p.host, p.path, list(CASE WHEN w.i IS NULL THEN segment ELSE '*' END ORDER BY p.i) AS segments
          FROM placed p LEFT JOIN wild w USING (host, parent, i) GROUP BY ALL),
templated AS (SELECT s.host, s.path, s.labelled, s.bad, coalesce(g.segments, []) AS segments FROM shaped s LEFT JOIN grown g USING (host, path)),
branches AS (
  SELECT host, segments, sum(labelled) AS n1, sum(bad) AS b1,
         coalesce(list_max(list_transform(segments, lambda s, i: CASE WHEN starts_with(s, '*') THEN 0 ELSE i END)), 0) AS last
  FROM templated GROUP BY host, segments),
own AS (SELECT *, '/' || array_to_string(segments, '/') AS own,
               '/' || array_to_string(list_transform(segments, lambda s, i: CASE WHEN i = last THEN '*' ELSE s END), '/') AS family FROM branches),
summed AS (SELECT host, family, sum(n1) AS n, sum(b1) AS b, count(*) AS kinds FROM own WHERE last > 0 GROUP BY ALL),
held AS (SELECT o.*, s.kinds, s.n - n1 AS n2, s.b - b1 AS b2, s.b::DOUBLE / nullif(s.n, 0) AS p FROM own o LEFT JOIN summed s USING (host, family)),
chosen AS (
  SELECT host, segments, n1, b1, CASE WHEN last > 0 AND kinds > 1 AND NOT coalesce(
         pow((b1 * n2 - b2 * n1)::DOUBLE, 2.0) > 1.96::DOUBLE * 1.96::DOUBLE * p * (1 - p) * (n1 + n2) * n1 * n2, false)
         THEN family ELSE own END AS template FROM held),
overall AS (SELECT coalesce(sum(b1)::DOUBLE / nullif(sum(n1), 0), 0) AS p FROM branches),
pure AS (SELECT host, template, 1 - (sum(b1) + 10::DOUBLE * (SELECT p FROM overall)) / (sum(n1) + 10::DOUBLE) AS purity FROM chosen GROUP BY ALL),
ruled AS (
  SELECT *, CASE WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                 WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
                 WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
                 WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
                 WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM parsed)
SELECT page_id, host, path, rule, host || template AS template, purity,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN purity >= 0.5 THEN 'allow' ELSE 'block' END AS verdict
FROM ruled JOIN templated USING (host, path) JOIN chosen USING (host, segments) JOIN pure USING (host, template)
"""


@query("op2_url_templates", _OP2_SQL)
def op2(spark, sf_dir):
    """The number in a page's path is the document it shows, whose label is the page's."""
    from pyspark.sql import functions as F

    from logsieve.llm.url_filters import host_and_path, url_verdicts

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.expr("try_cast(nullif(regexp_extract(path, '([0-9]+)', 1), '') AS BIGINT)")
    shown = pages.select("page_id", host_and_path(F.col("url"))[1].alias("path")).select("page_id", number.alias("doc_id"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.expr("quality = 0 OR toxic = 1").alias("bad"))
    return url_verdicts(pages, shown.join(labels, "doc_id").select("page_id", "bad"), URL_RULES)


@query("op8_quality_ranking")
def op8(spark, sf_dir):
    from logsieve.llm.quality_model import score_quality

    labels = table(spark, sf_dir, "labels").selectExpr("doc_id", "quality = 1 AS good")
    return score_quality(table(spark, sf_dir, "documents"), labels, block=20_000)


@query("op3_benchmark_passages")
def op3(spark, sf_dir):
    from logsieve.llm.decontamination import find_items

    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_line_alignment")
def op7(spark, sf_dir):
    from logsieve.llm.line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=50)


@query("op13_conversation_repair")
def op13(spark, sf_dir):
    from logsieve.llm.conversation_repair import damage, repair_digests

    conversations = table(spark, sf_dir, "conversations")
    return repair_digests(conversations, damage(conversations))


@query("op11_embedding_whitening")
def op11(spark, sf_dir):
    from logsieve.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"), components=4, scale=256, weight="one")


_OP12_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
o AS (SELECT digest, max(page_id) AS owner FROM d WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM owner AND o.digest IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM owner THEN owner END AS refers_to
FROM d LEFT JOIN o ON d.digest = o.digest
"""


@query("op12_web_archives", _OP12_SQL)
def op12(spark, sf_dir):
    from logsieve.llm.warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages"), least=1000)
