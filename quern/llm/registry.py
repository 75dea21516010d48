"""The registered queries of this subpackage: each applies one operator to whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm.byte_bpe import round_trip
from quern.llm.centroids import cluster_vectors
from quern.llm.hard_negatives import mine, prepared
from quern.llm.image_copies import image_copies, rendered
from quern.llm.lm_score import train_and_score
from quern.llm.mixing import mix_plan
from quern.llm.near_dedup import near_duplicates
from quern.llm.quality_classifier import classify
from quern.llm.quality_rules import judge
from quern.llm.repeats import without_repeats
from quern.llm.secret_scan import scan
from quern.llm.token_counts import token_counts
from quern.llm.url_filters import derived_captures, derived_entries, verdicts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    out = verdicts(derived_captures(pages), derived_entries(pages))
    return out.select("page_id", F.col("fetched_on").cast("string").alias("fetched_on"), "matched_key", "action", F.col("listed_on").cast("string").alias("listed_on"), "blocked")


def op2_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_copies(rendered(_table(spark, sf_dir, "embeddings")))


def op3_kneser_ney_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_and_score(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cluster_vectors(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256).alias("centroid_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = mine(prepared(vectors, "vec_id", label, "embedding"), F.col("id") % 100 == 0).negatives
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return found.select("doc_id", size.alias("n_bytes"), (size - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_image_copies": op2_image_copies,
    "op3_kneser_ney_perplexity": op3_kneser_ney_perplexity,
    "op4_quality_rules": op4_quality_rules,
    "op5_secret_scans": op5_secret_scans,
    "op6_token_counts": op6_token_counts,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_mix_to_weights": op9_mix_to_weights,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_suffix_array_dedup": op13_suffix_array_dedup,
}

#: Pieces between matches and the matches give the places of op5's findings; patterns as in secret_scan.RULES.
_SECRETS = r"""
WITH rules(ord, kind, pattern, grp, least) AS (VALUES
    (0, 'assign', '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
    (1, 'access', 'AKIA[A-Z0-9]+', 0, 20),
    (2, 'hex', '[0-9a-f]+', 0, 24),
    (3, 'github', 'gh[pousr]_[A-Za-z0-9]{36,}', 0, 1),
    (4, 'slack', 'xox[abprs]-[A-Za-z0-9-]{10,}', 0, 1),
    (5, 'google', 'AIza[0-9A-Za-z_-]{35}', 0, 1),
    (6, 'jwt', 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}', 0, 1),
    (7, 'private_key', '-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----', 0, 1)),
cut AS (%s),
parts AS (SELECT doc_id, ord, kind, least, unnest(range(1, len(found) + 1)) AS i, unnest(gaps[1:len(found)]) AS gap, unnest(found) AS found, unnest(kept) AS kept FROM cut),
placed AS (SELECT doc_id, ord, kind, sum(length(gap) + length(found)) OVER (PARTITION BY doc_id, ord ORDER BY i) AS stop, length(found) AS n, length(kept) >= least AS good FROM parts),
spans AS (SELECT doc_id, ord, kind, (stop - n)::BIGINT AS start, stop::BIGINT AS stop FROM placed WHERE good),
of_doc AS (SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN of_doc USING (doc_id)
""" % " UNION ALL ".join(
    f"SELECT doc_id, ord, kind, least, string_split_regex(text, p) AS gaps, regexp_extract_all(text, p) AS found, regexp_extract_all(text, p, {group}) AS kept FROM documents, (SELECT *, pattern AS p FROM rules WHERE ord = {n}) r"
    for n, group in enumerate((2, 0, 0, 0, 0, 0, 0, 0))
)

_RULES = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
places AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, words FROM t),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w FROM places),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT doc_id, sum(least(8, coalesce(next - i, 8)))::BIGINT AS n FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM twice) GROUP BY doc_id),
base AS (SELECT doc_id, text, words, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
counts AS (SELECT b.*, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    n_words < 20 OR 100 * coalesce(r.n, 0) > 30 * n_words AS base_failed FROM base b LEFT JOIN repeated r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 10 * n_symbols > 3 * n_words
    OR word_chars < 2 * n_words OR word_chars > 16 * n_words OR (n_lines > 3 AND 2 * n_dup_lines > n_lines)
    OR 2 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > word_chars OR 10 * length(regexp_replace(text, '[^0-9]+', '', 'g')) > 3 * word_chars
    OR 2 * length(regexp_replace(text, '[^!]+', '', 'g')) > n_words OR NOT regexp_matches(text, '[.!?\x{3002}\x{0964}]')
    OR 20 * len(list_distinct(words)) < n_words) AS kept
FROM counts
"""

_URLS = r"""
WITH raw AS (SELECT page_id, url, lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), '\.?(:[0-9]*)?$', '')) AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '') AS parts, DATE '2024-01-01' + (page_id % 500)::INT AS day FROM pages),
keyed AS (SELECT DISTINCT unnest([host, host || '/' || parts[1], CASE WHEN page_id % 20 = 0 THEN host || '/' || array_to_string(parts, '/') END]) AS key FROM raw),
numbered AS (SELECT key, ('0x' || substr(md5(key), 1, 4))::INT AS x FROM keyed WHERE key <> ''),
entries AS (SELECT key, 'block' AS action, DATE '2024-01-01' + x % 365 AS listed_on FROM numbered WHERE x % 4 <> 3
    UNION ALL SELECT key, 'allow', DATE '2024-01-01' + (x % 365 + 60) FROM numbered WHERE x % 2 = 0
    UNION ALL SELECT key, 'block', DATE '2024-01-01' + (x % 365 + 120) FROM numbered WHERE x % 5 = 0),
spans AS (SELECT *, lead(listed_on) OVER (PARTITION BY key ORDER BY listed_on) AS until FROM entries),
labels AS (SELECT *, string_split(host, '.') AS l FROM raw),
asked AS (SELECT page_id, day, unnest(list_transform(range(1, greatest(len(l), 2)), lambda i: array_to_string(l[i:], '.'))) AS key, unnest(list_transform(range(1, greatest(len(l), 2)), lambda i: len(l) - i + 1)) AS rank FROM labels WHERE host <> ''
    UNION ALL SELECT page_id, day, unnest(list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(parts[1:i], '/'))), unnest(list_transform(range(1, len(parts) + 1), lambda i: 1000000 + i)) FROM labels WHERE host <> ''),
hits AS (SELECT page_id, key, action, listed_on, row_number() OVER (PARTITION BY page_id ORDER BY rank DESC) AS n FROM asked JOIN spans USING (key) WHERE listed_on <= day AND (until IS NULL OR day < until))
SELECT r.page_id, strftime(day, '%Y-%m-%d') AS fetched_on, key AS matched_key, action, strftime(listed_on, '%Y-%m-%d') AS listed_on, coalesce(action = 'block', false) AS blocked
FROM raw r LEFT JOIN hits h ON h.page_id = r.page_id AND n = 1
"""

_ROUND = """a{n} AS (SELECT vec_id, any_value(k.v) AS v, arg_min(c, struct_pack(d := list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - m.v[i]) * (k.v[i] - m.v[i])))::BIGINT, c := c)) AS cluster,
    min(list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - m.v[i]) * (k.v[i] - m.v[i])))::BIGINT) AS distance FROM kept k, m{n} m GROUP BY vec_id)"""
_MOVE = """s{n} AS (SELECT cluster, i, sum(v[i])::BIGINT AS s, count(*) AS k FROM a{n}, (SELECT unnest(range(1, 65)) AS i) GROUP BY cluster, i),
x{n} AS (SELECT cluster, list((s - ((s % k) + k) % k) // k ORDER BY i) AS v FROM s{n} GROUP BY cluster), m{to} AS (SELECT c, coalesce(x.v, m.v) AS v FROM m{n} m LEFT JOIN x{n} x ON x.cluster = c)"""
_CENTROIDS = f"""
WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
m0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < 16),
{", ".join(part for n in range(3) for part in (_ROUND.format(n=n), _MOVE.format(n=n, to=n + 1)))}, {_ROUND.format(n=3)},
totals AS (SELECT cluster, sum(distance)::BIGINT AS t FROM a3 GROUP BY cluster)
SELECT vec_id, cluster::INT AS cluster, distance, t AS cluster_inertia, (SELECT sum(t) FROM totals)::BIGINT AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM a3 JOIN totals USING (cluster) JOIN m3 m ON m.c = cluster
"""

_NEGATIVES = """
WITH kept AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM kept a JOIN kept b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT anchor, id, score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
neg AS (SELECT p.anchor, p.id AS positive, p.score AS ps, s.id, s.score, row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS rank
    FROM pos p JOIN scores s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor AS anchor_id, positive AS positive_id, rank::INT AS rank, id AS negative_id, ps AS positive_score, score AS negative_score FROM neg WHERE rank <= 5
"""

ORACLE_SQL: dict[str, str] = {
    "op11_centroid_clusters": _CENTROIDS,
    "op12_hard_negatives": _NEGATIVES,
    "op1_url_filters": _URLS,
    "op4_quality_rules": _RULES,
    "op5_secret_scans": _SECRETS,
}
