"""The subpackage's registered queries: thin digests over the operators, and SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, html_extract, langid, licenses, lm, periodic_runs, piece_bpe, quality, simhash, suffix_dedup, token_counts, whitening
from .common import table

RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "license_id", "n_matched", "n_shingles")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.cascade(table(spark, sf_dir, "documents"), carry=["doc_id"], measures=True)
    return found.select("doc_id", *quality.MEASURES, "base_failed", "kept")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.main_text(table(spark, sf_dir, "pages"), carry=["page_id", "url"])
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    ids = bpe.encode(table(spark, sf_dir, "documents"), path, pattern, carry=["doc_id"])
    back = bpe.decode(ids, path, pattern)
    return back.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = token_counts.with_sample_edits(table(spark, sf_dir, "documents"))
    return token_counts.count_edited(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, carry=["doc_id"])


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs), carry=["doc_id"])
    fold = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")) % langid.FOLDS
    return found.select("doc_id", (fold == langid.HELD_OUT).alias("held_out"), "lang_pred", "score")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors)
    white = whitening.transform(vectors, model, carry=["vec_id"])
    share = F.array(*[F.lit(float(x)) for x in (model.share if model else ())]).cast("array<double>")
    rows = white.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return rows.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n if model else None).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(share, F.col("k")).alias("explained"), F.lit(whitening.identity_error(vectors, model)).cast("double").alias("identity_error"),
    )


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(PIECES)
    back = piece_bpe.decode(piece_bpe.encode(table(spark, sf_dir, "documents"), path, carry=["doc_id"]), path)
    return back.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_runs(table(spark, sf_dir, "documents"))
    found = periodic_runs.find_runs(docs, carry=["doc_id"])
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = F.col("best")
    return found.withColumn("best", periodic_runs.longest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _op1_sql() -> str:
    """Of each document and template, the most distinct shingles in a window that starts at one of its hits."""
    rows = [(k, x) for k, t in licenses.TEMPLATES.items() for x in licenses._shingles_of(t)]
    span = max(sum(1 for x, _ in rows if x == k) for k in licenses.TEMPLATES)
    values = ", ".join(f"('{k}', '{x}', {x.count(' ') + 1})" for k, x in rows)
    return f"""
WITH t(license_id, shingle, k) AS (VALUES {values}),
n AS (SELECT license_id, count(*) AS n_shingles FROM t GROUP BY license_id),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
s AS (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 1, CASE WHEN k = {licenses.SHINGLE} THEN 1 ELSE 0 END) + 1)) AS i FROM d, (SELECT DISTINCT k FROM t) WHERE len(w) > 0),
p AS (SELECT DISTINCT doc_id, i - 1 AS pos, array_to_string(w[i:i + k - 1], ' ') AS shingle FROM s),
h AS (SELECT doc_id, license_id, pos, shingle FROM p JOIN t USING (shingle)),
c AS (SELECT a.doc_id, a.license_id, a.pos, count(DISTINCT b.shingle) AS n FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.license_id = b.license_id AND b.pos BETWEEN a.pos AND a.pos + {licenses.SPREAD * span - 1} GROUP BY ALL)
SELECT doc_id, license_id, max(n)::BIGINT AS n_matched, any_value(n_shingles)::BIGINT AS n_shingles
FROM c JOIN n USING (license_id) WHERE n >= {licenses.CONTAINED} * n_shingles GROUP BY doc_id, license_id"""


OP2_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
b AS (SELECT doc_id, t, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^!]', '', 'g')) AS n_bangs FROM w),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
p AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM p) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY doc_id),
m AS (SELECT doc_id, n_words, word_chars, n_symbols, n_bangs, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM b LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 10 * n_bangs > n_words
       OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM f"""

OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT k FROM q),
p AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k)),
h AS (SELECT doc_id, i, q.k, item_id FROM p JOIN q ON p.g = q.g AND p.k = q.k),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)"""

OP6_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, array_slice(b, p, p + 49) AS s FROM (SELECT doc_id, b, unnest(range(1, n - 48)) AS p FROM d)),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS low FROM w) WHERE low < doc_id),
e AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM f),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM e),
r AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS z FROM g GROUP BY doc_id, k),
c AS (SELECT doc_id, z AS a, lead(a, 1) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM (SELECT doc_id, a, z FROM r UNION ALL SELECT doc_id, 0, 1 FROM d)),
k AS (SELECT doc_id, string_agg(hex(array_slice(b, c.a, coalesce(c.z, n + 1) - 1)), '' ORDER BY c.a) AS h
      FROM c JOIN d USING (doc_id) WHERE c.a < coalesce(c.z, n + 1) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(x.removed, 0)::BIGINT AS n_removed, coalesce(x.spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM r GROUP BY doc_id) x USING (doc_id) LEFT JOIN k USING (doc_id)"""

# Six words at equal distance twice or more make every run of twelve words, so that pairs of equal six-word windows
# hold all of them; windows next to each other are one stretch, and of stretches over the same words that of the
# smallest period counts. crc32 runs bit by bit over the digits of the id.
OP13_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
  list_reduce(list_prepend(4294967295::UBIGINT, flatten([[(ascii(c) >> b)::UBIGINT & 1 for b in range(8)] for c in string_split(doc_id::VARCHAR, '')])),
    lambda r, x: xor(r >> 1, 3988292384::UBIGINT * (xor(r, x) & 1))) AS r FROM documents),
h AS (SELECT doc_id, w, len(w) AS n, xor(r, 4294967295::UBIGINT)::BIGINT AS h FROM d),
a AS (SELECT doc_id, w, n, h % 10 = 0 AND n > 0 AS planted, CASE WHEN n > 0 THEN (h // 10) % n END AS a, 3 + (h // 10) % 8 AS g FROM h),
t AS (SELECT doc_id, n, CASE WHEN planted THEN w[1:a] || [w[1 + a + i % (1 + (n - a) // g)] for i in range(n - a)] ELSE w END AS w FROM a),
k AS (SELECT doc_id, i, w[i + 1] || chr(10) || w[i + 2] || chr(10) || w[i + 3] || chr(10) || w[i + 4] || chr(10) || w[i + 5] || chr(10) || w[i + 6] AS k
  FROM (SELECT doc_id, w, unnest(range(n - 5)) AS i FROM t WHERE n >= 12)),
m AS (SELECT doc_id, k FROM k GROUP BY doc_id, k HAVING count(*) > 1),
p AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM (SELECT * FROM k SEMI JOIN m USING (doc_id, k)) x JOIN k y ON x.doc_id = y.doc_id AND x.k = y.k AND y.i > x.i),
s AS (SELECT doc_id, q, min(i) AS a, max(i) - min(i) + 6 + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS z FROM p) GROUP BY doc_id, q, z),
r AS (SELECT doc_id, a, len, min(q) AS q FROM s WHERE len >= greatest(12, 2 * q) GROUP BY doc_id, a, len),
b AS (SELECT doc_id, count(*) AS n_runs, string_agg(a || ',' || len || ',' || q || chr(10), '' ORDER BY a, q) AS lines, max({'len': len, 'a': -a, 'q': -q}) AS best FROM r GROUP BY doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(a + q, a + len)) AS i FROM r),
c AS (SELECT t.doc_id, string_agg(x, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(w) AS x, unnest(range(n)) AS i FROM t) t ANTI JOIN g ON t.doc_id = g.doc_id AND t.i = g.i GROUP BY t.doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, (-best.a)::BIGINT AS start, best.len::BIGINT AS length, (-best.q)::BIGINT AS period,
  (1000 * best.len // -best.q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_quality_rules, op3_html_extraction, op4_byte_bpe, op5_decontamination,
        op6_suffix_dedup, op7_lm_scoring, op8_simhash, op9_token_counts, op10_language_id,
        op11_whitening, op12_piece_bpe, op13_periodic_runs,
    )
}
SQL = {"op1_license_scan": _op1_sql(), "op2_quality_rules": OP2_SQL, "op5_decontamination": OP5_SQL, "op6_suffix_dedup": OP6_SQL, "op13_periodic_runs": OP13_SQL}
