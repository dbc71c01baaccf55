"""The queries that apply each operator to its whole table, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clusters, fingerprints, langid, licences, mixing, neardup, ngrams, packing, pages, sequences, substrings, topk, tries
from .scratch import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), learn_from=docs)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "mixing")
    slim = mixing.measured(table(spark, sf_dir, "documents")).select("doc_id", "source", "__size", "__key", "__bucket", "__skey")
    mixed = mixing.mix(scratch.keep(slim, "sizes"))
    return mixed.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln(((('0x' || substr(md5('42|mix|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
      / (1 + 3 * coalesce(length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]+', '', 'g'))::DOUBLE / nullif(length(text), 0), 0)) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::DOUBLE AS cap,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
  FROM s WINDOW o AS (ORDER BY cap / w, source IS NOT NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, coalesce(least(cap, w * arg_min(CASE WHEN cap > level * w THEN level END, CASE WHEN cap > level * w THEN cap / w END) OVER ()), cap) AS target
  FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(floor(t.target / nullif(t.source_size, 0)), 0)::BIGINT AS e,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (e + CASE WHEN 2 * before + size < 2 * (target - e * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return found.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.col("__kept_sha256").alias("kept_sha256"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    scored = ngrams.score(docs, learn_from=docs.where(~held_out), least=1)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.trie(table(spark, sf_dir, "conversations"), siblings=20, heads=4)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


def op13_best_fit_decreasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sequences.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(q.v, x.v)::BIGINT AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8_license_scan that SQL can express too."""
    return op8_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10_document_fingerprints that SQL can express too."""
    return op10_document_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6_lm_scoring that SQL can express too; sums of logarithms to four places."""
    return op6_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT r, doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE doc_id IS NOT NULL AND len(w) >= 50)),
firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM windows JOIN firsts USING (h) WHERE first < doc_id),
each AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""

OP7_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format(LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS h FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM pairs JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * common >= 85 * (a.n + b.n - common)),
reached AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reached r JOIN links l ON l.u = r.v),
least AS (SELECT u AS doc_id, min(v) AS m FROM reached GROUP BY u)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)"""

CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split({}, '')]),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT FOR k IN range(8)]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"""

LM_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({CRC_SQL.format("doc_id::VARCHAR")} % 7 = 2, false) AS held_out, list_append({WORDS.format(LOWER)}, ' end') AS w FROM documents),
c AS (SELECT t, count(*) AS c FROM (SELECT unnest(w) AS t FROM d WHERE NOT held_out) GROUP BY t),
n AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c),
e AS (SELECT r, doc_id, held_out, unnest(w) AS t FROM (SELECT *, row_number() OVER () AS r FROM d))
SELECT any_value(doc_id) AS doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n)::BIGINT AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + v + 1)::DOUBLE)), 4) AS base_score
FROM e LEFT JOIN c USING (t), n GROUP BY r"""

LICENSE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (
  SELECT r, i - 1 AS place, 'mit' AS label FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM d) WHERE w[i] = 'mit' AND w[i + 1] = 'license'
  UNION ALL SELECT r, i - 1, 'apache' FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM d) WHERE w[i] = 'apache' AND w[i + 1] = 'license'
  UNION ALL SELECT r, i - 1, 'gpl' FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d) WHERE w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license'),
f AS (SELECT r, count(*) AS n, min(place) AS a, max(place) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a AS first_word, b AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN f USING (r)"""

EDITS_SQL = """
WITH o AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS r FROM documents),
x AS (SELECT a.doc_id, a.t, b.t AS following, length(a.t) AS n FROM o a JOIN o b ON b.r = a.r % (SELECT count(*) FROM o) + 1)
SELECT doc_id, n::BIGINT AS n_chars, sha256(substr(t, 1, n - n // 2) || substr(following, 1, n // 2)) AS edited_sha256 FROM x"""


OP11_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, role, md5(length(role) || ':' || role || txt) AS m, len(regexp_extract_all(txt, '[^\x20\x09-\x0D]+'))::BIGINT AS n
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations WHERE conv_id IS NOT NULL)),
o AS (SELECT conv_id, list(m ORDER BY turn NULLS FIRST, role, m) AS m, list(n ORDER BY turn NULLS FIRST, role, m) AS n, {CRC_SQL.format("conv_id::VARCHAR")} % 4 AS h FROM t GROUP BY conv_id),
b AS (SELECT a.conv_id, list_concat(coalesce(c.m[1:a.h], []), a.m[a.h + 1:]) AS m, list_concat(coalesce(c.n[1:a.h], []), a.n[a.h + 1:]) AS n FROM o a LEFT JOIN o c ON c.conv_id = a.conv_id - a.conv_id % 20),
p AS (SELECT conv_id, d, md5(array_to_string(m[1:d], '')) AS k, CASE WHEN d > 0 THEN n[d] ELSE 0 END AS w, d = len(m) AS ends FROM (SELECT *, unnest(range(0, len(m) + 1)) AS d FROM b)),
g AS (SELECT k, d, min(conv_id) AS c, count(*) AS n, max(w) AS w, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS e FROM p GROUP BY k, d),
u AS (SELECT g.*, x.k AS up, a.c AS parent FROM g LEFT JOIN p x ON x.conv_id = g.c AND x.d = g.d - 1 LEFT JOIN g a ON a.k = x.k),
f AS (SELECT u.*, coalesce(z.n, 0) AS children FROM u LEFT JOIN (SELECT up, count(*) AS n FROM u GROUP BY up) z ON z.up = u.k),
s AS (SELECT x.k, count(*) FILTER (y.children = 0) AS leaves, sum((y.n - 1) * y.w) AS saved FROM f y JOIN p x ON x.conv_id = y.c AND x.d <= y.d GROUP BY x.k)
SELECT c AS conv_id, d AS depth, parent AS parent_conv_id, f.n AS n_convs, children AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, e AS ends_sha256 FROM f JOIN s USING (k)"""

#: Ten rounds of Lloyd's algorithm: assignments a0 .. a10 to centroids c0 .. c10.
OP12_SQL = (
    """
WITH p AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v FROM (SELECT sha256('3:' || vec_id::VARCHAR) AS h, v FROM p ORDER BY h NULLS LAST, v LIMIT 8)),"""
    + ",".join(
        f"""
a{n} AS MATERIALIZED (
  SELECT r, min(struct_pack(d := d, c := c)) AS best FROM (SELECT r, c, list_sum([(p.v[i] - k.v[i]) * (p.v[i] - k.v[i]) FOR i IN range(1, 65)])::BIGINT AS d FROM p, c{n} k) GROUP BY r)"""
        + (
            f""",
c{n + 1} AS MATERIALIZED (
  SELECT k.c, coalesce(m.v, k.v) AS v FROM c{n} k LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (
      SELECT best.c AS c, i, sum(v[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{n} JOIN p USING (r), range(1, 65) x(i) GROUP BY ALL) GROUP BY c) m USING (c))"""
            if n < 10
            else ""
        )
        for n in range(11)
    )
    + """
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string([x::VARCHAR FOR x IN c10.v], ',')) AS centroid_sha256
FROM a10 JOIN p USING (r) JOIN c10 ON c10.c = best.c"""
)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_html_extraction,
        op3_language_id,
        op4_source_mixing,
        op5_substring_dedup,
        op6_lm_scoring,
        op7_minhash_near_dedup,
        op8_license_scan,
        op9_exact_top_k,
        op10_document_fingerprints,
        op11_conversation_trie,
        op12_centroid_clustering,
        op13_best_fit_decreasing,
        license_phrases,
        fingerprint_edits,
        lm_base,
    )
}
ORACLES: dict[str, str] = {
    "op4_source_mixing": OP4_SQL,
    "op5_substring_dedup": OP5_SQL,
    "op7_minhash_near_dedup": OP7_SQL,
    "op9_exact_top_k": OP9_SQL,
    "op11_conversation_trie": OP11_SQL,
    "op12_centroid_clustering": OP12_SQL,
    "license_phrases": LICENSE_SQL,
    "fingerprint_edits": EDITS_SQL,
    "lm_base": LM_SQL,
}
