"""The registered queries of the operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extract, language_id, license_scan, piece_tokenizer, quality, vector_search
from .fingerprints import fingerprints
from .line_dedup import line_dedup
from .mixing import mix_sources
from .near_dedup import near_dedup
from .prefix_trie import prefix_trie, sequences, with_heads_of
from .source_divergence import source_divergence
from .substring_dedup import substring_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> str:
    """Where the public SentencePiece model lies; read on the driver alone."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    out = quality.quality(docs, model)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op1_quality_rules that SQL can express."""
    out = quality.quality(_table(spark, sf_dir, "documents"), quality.EMPTY)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(~language_id.held_out(F.col("doc_id"))))
    out = language_id.identify(docs, model, keep=["doc_id"])
    model.close()
    return out.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.license_scan(_table(spark, sf_dir, "documents"), license_scan.known_digests(spark))
    return out.withColumn("notices", F.array_join("notices", ","))


def op4_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = piece_tokenizer.encode_decode(_table(spark, sf_dir, "documents"), piece_tokenizer.Vocabulary.load(piece_model()))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(_table(spark, sf_dir, "documents"), window=13)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_extract.extract_main_text(pages, html_extract.train(pages))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"), min_docs=10, top=10)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    heads = F.crc32(conv.cast("string").cast("binary")) % 4
    return prefix_trie(with_heads_of(sequences(_table(spark, sf_dir, "conversations")), conv - conv % 20, heads))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


def fingerprint_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op13_fingerprints that SQL can express."""
    return op13_fingerprints(spark, sf_dir).drop("fingerprint", "edited_fingerprint")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_license_scan": op3_license_scan,
    "op4_vector_search": op4_vector_search,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_mix_sources": op8_mix_sources,
    "op9_html_extract": op9_html_extract,
    "op10_line_dedup": op10_line_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_fingerprints": op13_fingerprints,
    "quality_measures": quality_measures,
    "fingerprint_measures": fingerprint_measures,
}

_WORDS = r"coalesce(regexp_extract_all({}, '[^\x20\x09-\x0D]+'), [])"



def _canonical(text: str) -> str:
    """Canonical lines of a text, in SQL."""
    x = r"' ' || regexp_replace(l, '[^\p{L}\p{N}]+', '  ', 'g') || ' '"
    for a, b in license_scan.SPELLINGS:
        x = f"replace({x}, '{license_scan._spaced(a)}', '{license_scan._spaced(b)}')"
    match = lambda pattern: f"regexp_matches(l, '^(?:{pattern})')"
    notice = f"{match(license_scan.COPYRIGHT)} OR ({match(license_scan.NO_TEXT)} AND NOT {match(license_scan.HOLDER)})"
    lines = f"list_filter(string_split(lower({text}), chr(10)), lambda l: NOT ({notice}))"
    return f"list_filter(list_transform({lines}, lambda l: trim(regexp_replace({x}, ' +', ' ', 'g'))), lambda l: l <> '')"


_KNOWN = ",\n".join(f"('{digest}', '{name}')" for digest, name in license_scan.digests())

ORACLE_SQL = {
    "quality_measures": f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("text")} AS ws FROM documents),
t AS (SELECT doc_id, p, hash(ws[p], ws[p+1], ws[p+2]) AS k, ws[p:p+2] AS three FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM w)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k, three) AS n FROM t) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(p, p + 3)) AS p FROM r) GROUP BY 1),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w JOIN l USING (doc_id) LEFT JOIN c ON c.doc_id = w.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m""",
    "op3_license_scan": f"""
WITH known(digest, license) AS (VALUES {_KNOWN}),
c AS (SELECT doc_id, coalesce({_canonical("text")}, []) AS ls FROM documents),
u AS (SELECT doc_id, true AS whole, sha256(array_to_string(ls, ' ')) AS digest FROM c WHERE len(ls) > 0
      UNION ALL SELECT doc_id, false, sha256(l) FROM (SELECT doc_id, unnest(ls) AS l FROM c)),
f AS (SELECT doc_id, min(license) FILTER (WHERE whole) AS license, string_agg(DISTINCT license, ',' ORDER BY license) FILTER (WHERE NOT whole) AS notices,
             count(*) FILTER (WHERE NOT whole) AS n_notices
      FROM u JOIN known USING (digest) GROUP BY 1)
SELECT d.doc_id, f.license, coalesce(f.notices, '') AS notices, coalesce(f.n_notices, 0)::BIGINT AS n_notices
FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id""",
    "op5_minhash_near_dedup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(doc_id, c) AS (SELECT a, b FROM u UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.c = u.a),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.c, w.doc_id)) AS component_id,
       least(w.doc_id, coalesce(m.c, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.doc_id = w.doc_id""",
    "op7_substring_dedup": f"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(ws[p:p+12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w)),
f AS (SELECT k, min(doc_id) AS d FROM win GROUP BY 1),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM win JOIN f USING (k) WHERE f.d < doc_id),
t AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
g AS (SELECT t.doc_id, count(c.p) AS n_removed, coalesce(string_agg(t.word, ' ' ORDER BY t.p) FILTER (WHERE c.p IS NULL), '') AS kept
      FROM t LEFT JOIN c ON c.doc_id = t.doc_id AND c.p = t.p GROUP BY 1)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(g.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM w LEFT JOIN g ON g.doc_id = w.doc_id""",
    "op8_mix_sources": f"""
WITH salts AS (SELECT (floor(sqrt(greatest(count(*), 1)) / 64) + 1)::BIGINT AS n FROM documents),
b AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS skey, len({_WORDS.format("text")})::BIGINT AS size, md5(coalesce(text, '')) AS digest,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 8))::BIGINT % (SELECT n FROM salts) AS salt FROM documents),
d AS (SELECT *, length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 4, 0)) AS class FROM b),
s AS (SELECT skey, min(source) AS source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
s1 AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, 3 * source_size AS cap FROM s),
s2 AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER earlier, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER earlier, 0))::DOUBLE AS level
  FROM s1 WINDOW earlier AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT skey, source_size, least(cap::DOUBLE, w * max(level) OVER ()) AS target FROM s2),
k AS (SELECT *, row_number() OVER (PARTITION BY skey ORDER BY class, salt, size, doc_id NULLS FIRST, digest) AS k FROM d),
j AS (
  SELECT k.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS each,
         ('0x' || substr(md5('mix' || k.skey), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS o
  FROM k JOIN s3 ON s3.skey = k.skey)
SELECT doc_id, size, source_size, target, (size * (floor(k * each + o) - floor((k - 1) * each + o)))::BIGINT AS taken FROM j""",
    "op10_line_dedup": r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
win AS (
  SELECT doc_id, p, ls[p] || chr(10) || ls[p+1] || chr(10) || ls[p+2] AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS p FROM l)),
o AS (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS nth FROM win WHERE regexp_matches(k, '[^\x20\x09-\x0D]')),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 3)) AS p FROM o WHERE nth > 1),
t AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS p, unnest(ls) AS line FROM l),
g AS (SELECT t.doc_id, count(c.p) AS n_removed, coalesce(string_agg(t.line, chr(10) ORDER BY t.p) FILTER (WHERE c.p IS NULL), '') AS kept
      FROM t LEFT JOIN c ON c.doc_id = t.doc_id AND c.p = t.p GROUP BY 1)
SELECT l.doc_id, coalesce(len(l.ls), 0)::BIGINT AS n_lines, coalesce(g.n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN l.text IS NOT NULL THEN sha256(g.kept) END AS kept_sha256
FROM l LEFT JOIN g ON g.doc_id = l.doc_id""",
    "op11_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
o AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM o GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
z AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
t AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY 1, 2),
p AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(t.n, 0) + 2 * z.v) AS p, 1 + (1000000000 * (k.n + 2)) // (z.n + 2 * z.v) AS q
  FROM g JOIN kept k USING (lang) JOIN z USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b USING (lang, term) GROUP BY 1, 2, 3),
u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
w AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM u)
SELECT * FROM w WHERE part = 'pair' OR rank <= 10""",
    "op12_prefix_trie": r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
o AS (
  SELECT conv_id, row_number() OVER w AS k, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')))),
h AS (
  SELECT conv_id, conv_id - conv_id % 20 AS head_of,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM o), crc),
r AS (
  SELECT h.conv_id, o.k, role, text FROM h JOIN o ON o.conv_id = head_of AND o.k <= h
  UNION ALL SELECT h.conv_id, o.k, role, text FROM h JOIN o ON o.conv_id = h.conv_id AND o.k > h),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS d FROM r),
p AS (
  SELECT conv_id, 0::BIGINT AS d, NULL::VARCHAR AS up, 'root' AS path, 0::BIGINT AS words FROM h
  UNION ALL SELECT n.conv_id, n.d, p.path, md5(p.path || ':' || length(n.role) || ':' || n.role || n.text), len(regexp_extract_all(n.text, '[^\x20\x09-\x0D]+'))::BIGINT FROM p JOIN n ON n.conv_id = p.conv_id AND n.d = p.d + 1),
l AS (SELECT conv_id, max(d) AS len FROM p GROUP BY 1),
m AS (
  SELECT path, any_value(up) AS up, any_value(d) AS depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE len = d), '')) AS ends_sha256
  FROM p JOIN l ON l.conv_id = p.conv_id GROUP BY 1),
k AS (SELECT up AS path, count(*) AS n FROM m WHERE up IS NOT NULL GROUP BY 1),
s AS (SELECT path AS top, path FROM m UNION ALL SELECT s.top, m.path FROM s JOIN m ON m.up = s.path),
a AS (SELECT s.top AS path, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, sum((m.n_convs - 1) * m.words)::BIGINT AS saved_tokens FROM s JOIN m ON m.path = s.path LEFT JOIN k ON k.path = s.path GROUP BY 1)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, coalesce(k.n, 0) AS n_children, a.n_leaves, a.saved_tokens, m.ends_sha256
FROM m JOIN a ON a.path = m.path LEFT JOIN k ON k.path = m.path LEFT JOIN m u ON u.path = m.up""",
    "fingerprint_measures": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
u AS (SELECT *, coalesce(lead(text) OVER o, first_value(text) OVER o) AS after FROM t WINDOW o AS (ORDER BY doc_id)),
e AS (SELECT *, left(text, n - n // 4) || left(after, n // 4) AS edited FROM u),
p AS (
  SELECT doc_id, n, edited, list_distinct(regexp_extract_all(text, '[^\n.!?]{1,160}[.!?]*|[.!?]+')) AS a,
         list_distinct(regexp_extract_all(edited, '[^\n.!?]{1,160}[.!?]*|[.!?]+')) AS b, list_distinct(regexp_extract_all(after, '[^\n.!?]{1,160}[.!?]*|[.!?]+')) AS c
  FROM e),
k AS (SELECT *, len(list_intersect(a, b)) AS ab, len(list_intersect(a, c)) AS ac FROM p)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, len(a)::BIGINT AS n_paragraphs, (len(a) + len(b) - 2 * ab)::BIGINT AS n_differing,
       CASE WHEN len(a) + len(b) = 0 THEN 1 ELSE ab::DOUBLE / (len(a) + len(b) - ab) END AS near_edited, CASE WHEN len(a) + len(c) = 0 THEN 1 ELSE ac::DOUBLE / (len(a) + len(c) - ac) END AS near_next
FROM k""",
}
