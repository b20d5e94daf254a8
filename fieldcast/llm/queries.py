"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F  # noqa: F401

from . import fingerprints, html_text, licenses, merkle, packing, quality_classifier, quality_rules, simhash, spelling, url_filter, vectors, warc, wfst


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, language, one of 64 folders."""
    docs = _table(spark, sf_dir, "documents")
    folder = F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("string")
    return licenses.scan(docs.select("doc_id", "text", F.concat_ws("/", "source", "lang", folder, F.col("doc_id").cast("string")).alias("path")))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, _grades(spark, sf_dir)))


def _grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").select("doc_id", quality_classifier.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents")).drop("words_left")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), rules)


OP8_SQL = r"""
WITH rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
url AS (
  SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), part AS (
  SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM url
), best AS (
  SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM part JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM part LEFT JOIN best ON part.r = best.r
"""


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages
), bits AS (
  SELECT *, array_to_string(list_transform(generate_series(1, 40), lambda i: lpad(bin(strpos('0123456789abcdef', hex[i]) - 1), 4, '0')), '') AS b FROM p
)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(generate_series(1, 5), lambda j: CASE WHEN b[5 * i + j] = '1' THEN 1 << (5 - j) ELSE 0 END))::INT]), '') AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM bits
"""


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wfst.round_trip(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    docs = _table(spark, sf_dir, "documents")
    return merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "doc_id", "lang", {"n_chars": F.col("n_chars") + 1}, changed)


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), win AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c
  FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM doc WHERE len(w) >= 3)
), rep AS (
  SELECT r, sum(least(3, coalesce(nxt - i, 3))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM win WHERE c > 1) GROUP BY r
), base AS (
  SELECT doc.r, doc_id, host, text, l, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM doc LEFT JOIN rep ON doc.r = rep.r
), line AS (
  SELECT r, host, text, lower(array_to_string(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> ''), ' ')) AS t
  FROM (SELECT r, host, text, unnest(l) AS x FROM base)
), freq AS (
  SELECT k.host, k.t
  FROM (SELECT host, t, count(DISTINCT md5(text)) AS n FROM line GROUP BY host, t) k
  JOIN (SELECT host, count(DISTINCT md5(text)) AS docs FROM base GROUP BY host) h ON k.host IS NOT DISTINCT FROM h.host
  WHERE k.n > 20 AND k.n > 0.01 * h.docs
), lost AS (
  SELECT r, sum(len(string_split(line.t, ' '))) AS n FROM line JOIN freq ON line.host IS NOT DISTINCT FROM freq.host AND line.t = freq.t GROUP BY r
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - coalesce(lost.n, 0) >= 0.5 * n_words AS kept
FROM base LEFT JOIN lost ON base.r = lost.r
"""


def _crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes (code points to 255), as DuckDB SQL: bits shifted out one by one."""
    utf8 = f"flatten(list_transform(string_split({text}, ''), lambda z: CASE WHEN unicode(z) < 128 THEN [unicode(z)::BIGINT] ELSE [192::BIGINT + unicode(z) // 64, 128::BIGINT + unicode(z) % 64] END))"
    shifted = "list_reduce([xor(c, b) % 256, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {utf8}), lambda c, b: xor(c // 256, {shifted})))"


def _encoded(*columns: str) -> str:
    return " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in columns)


OP11_SQL = f"""
WITH RECURSIVE run AS (
  SELECT doc_id, w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents)
  GROUP BY doc_id, w
), hashed AS (
  SELECT w, n, {_crc32("(coalesce(doc_id::VARCHAR, '') || ':' || w)")} AS h FROM run
), word AS (
  SELECT w, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN w[: h % length(w)] || w[h % length(w) + 2 :] ELSE w END AS w, n FROM hashed)
  WHERE length(w) >= 6 GROUP BY w HAVING sum(n) >= 5
), hole AS (
  SELECT w, n, i, w[: i - 1] AS a, w[i + 1 :] AS b FROM (SELECT w, n, unnest(generate_series(1, length(w))) AS i FROM word)
), pair AS (
  SELECT x.w, x.n, y.w AS v, y.n AS m FROM hole x JOIN hole y ON x.a = y.a AND x.b = y.b WHERE x.w <> y.w
  UNION
  SELECT x.w, x.n, y.w, y.n FROM hole x JOIN word y ON x.a || x.b = y.w
  UNION
  SELECT y.w, y.n, x.w, x.n FROM hole x JOIN word y ON x.a || x.b = y.w
), best AS (
  SELECT w, n, count(*) AS n_near, max(m) AS m FROM pair GROUP BY w, n
), form AS (
  SELECT best.w, min(pair.v) AS form, best.m FROM best JOIN pair ON best.w = pair.w AND best.m = pair.m WHERE best.m >= 5 * best.n GROUP BY best.w, best.m
), walk(w, z, k) AS (
  SELECT w, w, 0 FROM word
  UNION ALL
  SELECT walk.w, form.form, k + 1 FROM walk JOIN form ON walk.z = form.w
), root AS (SELECT w, arg_max(z, k) AS root FROM walk GROUP BY w)
SELECT word.w AS word, form.form AS form, root.root AS root, word.n AS n, coalesce(best.n_near, 0)::BIGINT AS n_near, form.m AS form_n
FROM word LEFT JOIN best ON word.w = best.w LEFT JOIN form ON word.w = form.w JOIN root ON word.w = root.w
"""

OP12_SQL = f"""
WITH RECURSIVE leaf AS (
  SELECT row_number() OVER () AS r, doc_id, lang, sha256({_encoded("doc_id", "source", "lang", "n_chars", "text")}) AS leaf,
         CASE WHEN {_crc32("doc_id::VARCHAR")} % 7 = 0 THEN sha256({_encoded("doc_id", "source", "lang", "(n_chars + 1)", "text")}) ELSE sha256({_encoded("doc_id", "source", "lang", "n_chars", "text")}) END AS claimed
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaf
), low(lang, l, pos, n, d) AS (
  SELECT lang, 0, pos, n, leaf FROM placed
  UNION ALL
  SELECT lang, l + 1, pos // 2, (n + 1) // 2, sha256(d || coalesce(d2, ''))
  FROM (SELECT *, lead(d) OVER (PARTITION BY lang ORDER BY pos) AS d2 FROM low WHERE n > 1) WHERE pos % 2 = 0
), sub AS (
  SELECT lang, d, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
), high(l, pos, n, d) AS (
  SELECT 0, pos, n, d FROM sub
  UNION ALL
  SELECT l + 1, pos // 2, (n + 1) // 2, sha256(d || coalesce(d2, ''))
  FROM (SELECT *, lead(d) OVER (ORDER BY pos) AS d2 FROM high WHERE n > 1) WHERE pos % 2 = 0
), step AS (
  SELECT p.r, 0 AS part, k.l, k.pos % 2 AS side, k.d
  FROM placed p JOIN (SELECT DISTINCT lang, l FROM low WHERE n > 1) h ON p.lang IS NOT DISTINCT FROM h.lang
  JOIN low k ON k.lang IS NOT DISTINCT FROM p.lang AND k.l = h.l AND k.pos = xor((p.pos // (1 << h.l))::BIGINT, 1::BIGINT)
  UNION ALL
  SELECT p.r, 1, k.l, k.pos % 2, k.d
  FROM placed p JOIN sub s ON p.lang IS NOT DISTINCT FROM s.lang JOIN (SELECT DISTINCT l FROM high WHERE n > 1) h ON true
  JOIN high k ON k.l = h.l AND k.pos = xor((s.pos // (1 << h.l))::BIGINT, 1::BIGINT)
), lone AS (
  SELECT p.r, 0 AS part, h.l FROM placed p JOIN (SELECT DISTINCT lang, l FROM low WHERE n > 1) h ON p.lang IS NOT DISTINCT FROM h.lang
  UNION ALL
  SELECT p.r, 1, h.l FROM placed p JOIN (SELECT DISTINCT l FROM high WHERE n > 1) h ON true
), path AS (
  SELECT lone.r, list(CASE WHEN step.side = 0 THEN 'L' ELSE 'R' END || coalesce(step.d, '') ORDER BY lone.part, lone.l) AS steps
  FROM lone LEFT JOIN step USING (r, part, l) GROUP BY lone.r
)
SELECT doc_id, leaf, sub.d AS subroot, root.d AS root,
       sha256(coalesce(array_to_string(list_transform(steps, lambda x: x[2:]), ''), '')) AS proof_sha256,
       list_reduce(list_prepend('R' || claimed, coalesce(steps, [])), lambda a, b: 'R' || CASE WHEN b[1] = 'L' THEN sha256(b[2:] || a[2:]) ELSE sha256(a[2:] || b[2:]) END)[2:] AS folded_root,
       folded_root = root.d AS verified
FROM placed LEFT JOIN path USING (r) JOIN sub ON placed.lang IS NOT DISTINCT FROM sub.lang, (SELECT d FROM high WHERE n = 1) AS root
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": OP3_SQL, "op8_url_filter": OP8_SQL, "op10_quality_rules": OP10_SQL, "op11_spelling_variants": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
