"""The corpus queries, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, hnsw, mixing, packing, pseudonyms, quality, secret_scan, simhash, source_audit, suffix_dedup, token_counts, url_filter, wht_kmeans
from .common import table

#: The session's setting that names the key of op8; where it is unset, the key of the driver's check.
KEY_SETTING, KEY = "spark.sparkbars.pseudonyms.key", "pseudonyms of the query"
#: Words in the hosts of op9's list.
LISTED_HOSTS = ("cheap-pills", "casino-win", "free-bets", "spam-farm", "adult-x", "ads-track")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document; a token across lines goes to the line with most of its characters."""
    import public_tokenizers

    return token_counts.attribute_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), packing.word_bpe_encoder(public_tokenizers.path("word_bpe_49k.json")))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of each vector whose id is divisible by 50."""
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles, linked at two bits, and their components."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts, and which of each stays."""
    return exact_dedup.mark_duplicates(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of the fixed kinds, and runs that the character models find random."""
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan_secrets(docs, secret_scan.train_markov(secret_scan.labelled_samples(docs)))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the rules learnt from the labels."""
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train_quality(docs, table(spark, sf_dir, "labels")))


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data. The key is the session's."""
    return pseudonyms.pseudonymise_documents(table(spark, sf_dir, "documents"), spark.conf.get(KEY_SETTING, KEY).encode())


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: the pages fetched by https from hosts with a listed word. Judged are all pages, in each spelling of a URL."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.select("url").filter(F.col("url").startswith("https://") & url_filter.url_host(F.col("url")).rlike("|".join(LISTED_HOSTS)))
    return url_filter.judge_urls(pages, listed)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each source's terms differ from those of the language's other sources, and from the language's own."""
    return source_audit.audit_sources(table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of the vectors after ten rounds."""
    return wht_kmeans.cluster(table(spark, sf_dir, "embeddings"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses of passages of 400 bytes and more that occur elsewhere too."""
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_token_counts, op2_packing, op3_nearest, op4_simhash, op5_exact_dedup, op6_secrets, op7_quality, op8_pseudonyms, op9_url_filter, op10_mixing, op11_source_audit, op12_centroids, op13_suffix_dedup)
    return {f.__name__: f for f in ops}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = f"""
WITH d AS (SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

OP9_SQL = rf"""
WITH p AS (
  SELECT page_id, url, {_LOWER.format("regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')")} AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
    array_to_string(list_filter(string_split(regexp_extract(coalesce(url, ''), '^[^?#]*\?([^#]*)', 1, 's'), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')), '&') AS query FROM pages),
c AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS canonical FROM p),
l AS (SELECT DISTINCT canonical FROM c WHERE canonical IS NOT NULL AND starts_with(url, 'https://') AND regexp_matches(host, '{"|".join(LISTED_HOSTS)}')),
r AS (SELECT c.*, l.canonical IS NOT NULL AS listed, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM c LEFT JOIN l ON c.canonical = l.canonical)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM r
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS key,
    CAST(coalesce(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')), 0) AS BIGINT) AS size FROM documents),
k AS (SELECT *, CAST(length(bin(size)) * 8 + ((size >> greatest(length(bin(size)) - 4, 0)) & 7) AS INT) AS cls,
    (((doc_id % 2147483648) * 2654435761) % 4294967296) % greatest(1, CAST(ceil((SELECT count(*) FROM documents) / 50000.0) AS BIGINT)) AS salt FROM d),
s AS (SELECT source, key, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1 AS weight FROM d GROUP BY source, key),
o AS (SELECT *, 3 * source_size / weight AS ratio, row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS n FROM s),
w AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS rest,
    (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS shares FROM o),
t AS (SELECT key, source_size, least(3.0::DOUBLE * source_size, coalesce((SELECT max(rest / shares) FROM w WHERE rest / shares <= ratio), 0) * weight) AS target,
    ('0x' || substr(md5('mix' || key), 1, 4))::INT / 65536.0::DOUBLE AS off FROM w),
r AS (SELECT k.*, t.source_size, t.target, t.off, row_number() OVER (PARTITION BY k.key ORDER BY cls, salt, doc_id) AS n FROM k JOIN t USING (key)),
c AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM r),
e AS (SELECT *, CAST(floor(rate * n + off) - floor(rate * (n - 1) + off) AS BIGINT) AS copies FROM c)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, copies FROM e
"""


OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, {_LOWER.format("coalesce(text, '')")} AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS item FROM d),
c AS (SELECT lang, source, item, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY lang, source, item),
k AS (SELECT lang, item, sum(n) AS n FROM c GROUP BY lang, item HAVING sum(docs) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
a AS (SELECT g.lang, g.source, k.item, coalesce(c.n, 0) AS n, k.n AS lang_n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.item = k.item),
t AS (SELECT lang, source, sum(n) AS total FROM a GROUP BY lang, source),
p AS (SELECT a.*, (1 + (1000000000 * (a.n + 1)::HUGEINT) // (t.total + v.v))::BIGINT AS p, (1 + (1000000000 * (a.lang_n + 1)::HUGEINT) // (v.total + v.v))::BIGINT AS q
  FROM a JOIN t ON a.lang = t.lang AND a.source = t.source JOIN v ON a.lang = v.lang),
f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p)::BIGINT AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.item = y.item AND x.source <> y.source GROUP BY x.lang, x.source, y.source),
e AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
    LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL SELECT lang, source, 'term', item, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM e)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 200
"""


def op12_sql(k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """The rounds written out, each over all vectors and centroids."""
    steps = [f"""
WITH r AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
x AS (SELECT r, unnest(range(64)) AS i, unnest(v)::BIGINT AS x FROM r),
s AS (SELECT r, row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c FROM r),
c0 AS (SELECT c, i, x FROM x JOIN s USING (r) WHERE c < {k})"""]
    for n in range(rounds + 1):
        steps.append(f"""
d{n} AS MATERIALIZED (SELECT r, c, sum((x.x - c{n}.x) * (x.x - c{n}.x))::BIGINT AS d FROM x JOIN c{n} USING (i) GROUP BY r, c),
a{n} AS MATERIALIZED (SELECT r, (min({{'d': d, 'c': c}})).c AS c, min(d) AS d FROM d{n} GROUP BY r)""")
        if n < rounds:
            steps.append(f"""
m{n} AS (SELECT c, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM x JOIN a{n} USING (r) GROUP BY c, i),
c{n + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN x ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS x FROM c{n} LEFT JOIN m{n} USING (c, i))""")
    return ",".join(steps) + f"""
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM r JOIN a{rounds} USING (r) JOIN (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c) USING (c)
"""


OP13_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT r, c, substr(h, 2 * c + 1, 1822) AS h FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 399, 512)) AS c FROM d WHERE length(h) >= 800)),
w AS (SELECT r, c + i AS i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT r, c, h, unnest(range(least(512, length(h) // 2 - 399))) AS i FROM p)),
f AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1),
g AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM f),
s AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS n FROM g),
b AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM s GROUP BY r, n),
l AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS e FROM b),
t AS (SELECT r, string_agg(substr(h, 2 * e + 1, 2 * (a - e)), '' ORDER BY a) AS head, max(b) AS b, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed FROM l JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(b, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN t USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op9_url_filter": OP9_SQL, "op10_mixing": OP10_SQL, "op11_source_audit": OP11_SQL, "op12_centroids": op12_sql(), "op13_suffix_dedup": OP13_SQL}
