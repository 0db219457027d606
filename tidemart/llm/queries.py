"""The operators of this subpackage as registered queries, and the SQL that those can be held against which SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemart.llm import centroids, jaccard, languages, lines, mixing, negatives, quality, shards, topk, toxicity, urls, warc, winnow
from tidemart.session import settle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record per page, written and read back: what was stored as response or revisit."""
    records = warc.round_trip(spark, _table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op2_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND (page_id <> top OR (page_id IS NULL AND top IS NOT NULL)) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND (page_id <> top OR (page_id IS NULL AND top IS NOT NULL)) THEN top END AS refers_to
FROM g
"""


@query
def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by a permutation of their row numbers; law ``rows``."""
    return shards.shard_documents(_table(spark, sf_dir, "documents"), 24, SHARD_SEED)


SHARD_SEED = 20


def _feistel_sql(x: str, source: str) -> str:
    """SQL that puts column ``x`` of ``source`` (with a, b) through the permutation, round by round."""
    step = f"SELECT *, {x} // b AS l0, {x} % b AS r0 FROM {source}"
    for i, (p, q, s) in enumerate(shards.round_keys(SHARD_SEED)):
        value, modulus = (f"l{i}", "b") if i % 2 else (f"r{i}", "a")
        t = f"(({value} * {p} + {q}) % {shards.PRIME})"
        noise = f"(({t} * {t} + {value} * {s}) % {shards.PRIME}) % {modulus}"
        left, right = (f"l{i}", f"(r{i} + {noise}) % b") if i % 2 else (f"(l{i} + {noise}) % a", f"r{i}")
        step = f"SELECT *, {left} AS l{i + 1}, {right} AS r{i + 1} FROM ({step})"
    n = shards.ROUNDS
    return f"SELECT doc_id, size, text_crc32, n, a, b, l{n} * b + r{n} AS x FROM ({step})"


ORACLE["op3_shards"] = f"""
WITH RECURSIVE bytes AS (
  SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) + 8 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS bs FROM documents),
powers AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
  lambda c, j: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
base AS (SELECT doc_id, CAST(size AS BIGINT) AS size,
  xor(4294967295, list_reduce(list_prepend(4294967295, bs), lambda c, v: xor(t[CAST(xor(c, v) & 255 AS BIGINT) + 1], c >> 8))) AS text_crc32
  FROM bytes, powers),
total AS (SELECT count(*) AS n, greatest(1, CAST(ceil(sqrt(count(*))) AS BIGINT)) AS a FROM base),
sized AS (SELECT n, a, greatest(1, (n + a - 1) // a) AS b FROM total),
numbered AS (SELECT doc_id, size, text_crc32, n, a, b,
  row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS x FROM base, sized),
walk AS (
  {_feistel_sql("x", "numbered")}
  UNION ALL
  {_feistel_sql("x", "(SELECT * FROM walk WHERE x >= n)")})
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(x % 24 AS INTEGER) AS shard, CAST(x // 24 AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM walk WHERE x < n
"""


@query
def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest inner products of every hundredth vec_id among all other rows' vectors."""
    vectors = settle(topk.quantise(_table(spark, sf_dir, "embeddings")), "topk-vectors")
    return topk.top_k(spark, vectors, vectors.filter(F.col("vec_id") % 100 == 0), 10)


ORACLE["op4_topk"] = """
WITH v AS (SELECT vec_id, min(list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query
def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest rule that fits each page's host and path, and the verdict."""
    return urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), urls.RULES).select(
        "page_id", "host", "path", "rule", "verdict")


ORACLE["op6_url_rules"] = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'),
  ('allow', 'org', '/fr/')) t(verdict, h, q)),
f AS (SELECT page_id, host, path, arg_max(struct_pack(rule := h || q, verdict := verdict), length(h || q)) AS best
  FROM (SELECT DISTINCT page_id, host, path FROM p) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)
  GROUP BY page_id, host, path)
SELECT p.page_id, p.host, p.path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict
FROM p LEFT JOIN f ON p.page_id IS NOT DISTINCT FROM f.page_id AND p.host = f.host AND p.path = f.path
"""


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text scored for toxicity, learned from labels outside the held-out fifth."""
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text scored for quality, learned from labels outside the held-out quarter."""
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside windows that a benchmark item has, and the items."""
    found = winnow.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE["op10_decontaminate"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
  WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT DISTINCT item, least(10, len(ws)) AS m, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS g
  FROM (SELECT item, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT rid, m, i, array_to_string(ws[i:i + m - 1], ' ') AS g
  FROM (SELECT rid, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM iw) WHERE len(ws) >= m)),
h AS (SELECT rid, item, i, dw.m FROM dw JOIN iw ON dw.g = iw.g AND dw.m = iw.m),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM h) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM h GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN t USING (rid)
"""


@query
def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix of all sources takes."""
    return mixing.mix_documents(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without lines of at least 20 words that stand earlier, with their offsets."""
    found = lines.deduplicate(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("removed").cast("long").alias("n_removed"), F.to_json("removed").alias("removed"), "text")


ORACLE["op5_lines"] = r"""
WITH d AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents),
o AS (SELECT *, octet_length(encode(line)) AS n,
  coalesce(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
  regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM d),
r AS (SELECT *, len(ws) >= 20 AND row_number() OVER (PARTITION BY len(ws) >= 20, array_to_string(ws, ' ') ORDER BY doc_id, start) > 1 AS gone FROM o)
SELECT doc_id, count(*) FILTER (gone) AS n_removed,
  '[' || coalesce(string_agg('{"start":' || CAST(start AS BIGINT) || ',"end":' || CAST(start + n AS BIGINT) || '}', ',' ORDER BY i) FILTER (gone), '') || ']' AS removed,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') ||
    CASE WHEN max(i) FILTER (gone) = max(i) AND count(*) FILTER (NOT gone) > 0 THEN chr(10) ELSE '' END AS text
FROM r GROUP BY doc_id
"""


@query
def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their component of near copies: four-word shingles, a similarity of 0.85 or more. A repeated row is one document."""
    groups = jaccard.jaccard_groups(_table(spark, sf_dir, "documents"), shingle=4, percent=85)
    return groups.dropDuplicates(["doc_id", "mark"]).select("doc_id", "n_shingles", "component_id")


ORACLE["op9_jaccard"] = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM d WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT l.b, r.c FROM r JOIN l ON r.doc_id = l.a)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""


@query
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 sound components in 16 clusters after three rounds, with inertias and centroids' digests."""
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def _centroids_sql() -> str:
    floor_mean = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    steps = []
    for i in range(centroids.ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT rid, vec_id, v, c, d FROM (
  SELECT v.rid, v.vec_id, v.v, c{i}.c, list_sum(list_transform(range(1, 65), lambda j: (v.v[j] - c{i}.v[j]) * (v.v[j] - c{i}.v[j]))) AS d,
    row_number() OVER (PARTITION BY v.rid ORDER BY d, c{i}.c) AS r FROM v, c{i}) WHERE r = 1)""")
        if i < centroids.ROUNDS:
            steps.append(f"""m{i} AS (SELECT c, list({floor_mean} ORDER BY j) AS v FROM (
  SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{i}) GROUP BY c, j) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} ON m{i}.c = c{i}.c)""")
    n = centroids.ROUNDS
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM v ORDER BY sha256('1:' || vec_id), v LIMIT {centroids.CLUSTERS}),
{", ".join(steps)}
SELECT vec_id, CAST(a{n}.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a{n}.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{n}.v, ',')) AS centroid_sha256
FROM a{n} JOIN c{n} ON c{n}.c = a{n}.c
"""


ORACLE["op11_centroids"] = _centroids_sql()


@query
def op12_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows outside the held-out fifth."""
    return languages.identify(_table(spark, sf_dir, "documents"))


@query
def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of five positives of every hundredth vec_id, searched among all rows."""
    vectors = negatives.labelled_vectors(_table(spark, sf_dir, "embeddings"))
    return negatives.mine(spark, vectors, F.col("vec_id") % 100 == 0)


ORACLE["op13_negatives"] = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.rid AS arid, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score, c.rid
  FROM v a JOIN v c ON a.rid <> c.rid WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY arid ORDER BY score DESC, vec_id, rid) AS no FROM s WHERE same),
n AS (SELECT p.arid, p.no, p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.arid, p.no ORDER BY s.score DESC, s.vec_id, s.rid) AS INTEGER) AS rank
  FROM p JOIN s ON s.arid = p.arid AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score WHERE p.no <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
