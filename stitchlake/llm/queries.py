"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontam import leaks
from .jaccard_join import jaccard_classes
from .language_id import identify
from .license_scan import scan_licenses
from .line_dedup import MIN_WORDS, line_dedup
from .lm_score import pseudo_likelihood
from .packing import pack
from .prefix_trie import prefix_trie
from .quality_rules import RULES, ledger, passes
from .simhash_dedup import simhash_classes
from .source_divergence import MIN_DOCS, SCALE, TOP, source_divergence
from .token_codec import read_tokens, write_tokens
from .warc import read_archives, write_archives


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs, with_counts=True).select("doc_id", "n_lines", "n_removed", "text")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger(_table(spark, sf_dir, "documents"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select(*base, (~passes("base/1")).alias("base_failed"), passes().alias("kept"), "fail_bits")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_archives(write_archives(_table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(_table(spark, sf_dir, "documents")))


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(_table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_lm_score": op1_lm_score,
    "op2_line_dedup": op2_line_dedup,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_warc": op4_warc,
    "op5_packing": op5_packing,
    "op6_token_files": op6_token_files,
    "op7_quality_rules": op7_quality_rules,
    "op8_decontamination": op8_decontamination,
    "op9_language_id": op9_language_id,
    "op10_license_scan": op10_license_scan,
    "op11_simhash_dedup": op11_simhash_dedup,
    "op12_source_divergence": op12_source_divergence,
    "op13_prefix_trie": op13_prefix_trie,
}

#: Words of a text as lower-case (A-Z) strings, and its distinct 5-word shingles, in DuckDB.
_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS_SQL = f"regexp_extract_all({_LOWER_SQL}, '[^ \\t-\\r]+')"


def _shingles_sql(table: str, key: str) -> str:
    return f"""(SELECT DISTINCT {key}, s FROM (SELECT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
        ELSE list_transform(generate_series(1, len(w) - 4), lambda i: w[i:i + 4]) END) AS s FROM (SELECT {key}, {_WORDS_SQL} AS w FROM {table})))"""


#: crc32 of c's decimal digits, bit by bit.
_CRC_SQL = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: list_transform(generate_series(0, 7), lambda i: (ascii(x) >> i::INT & 1)::BIGINT)))),
        lambda s, x: xor(s >> 1, 3988292384 * (xor(s, x) & 1))), 4294967295)"""

_P_SQL = f"(1 + {SCALE}::HUGEINT * (count + 1) // (sum(count) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)))"

ORACLES = {
    "op12_source_divergence": f"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER_SQL} AS t FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(t, '[a-zA-Z\\x{{80}}-\\x{{10FFFF}}]+')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS every FROM w GROUP BY ALL HAVING count(DISTINCT row) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
a AS (SELECT lang, source, term, coalesce(n, 0) AS count FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS MATERIALIZED (SELECT *, {_P_SQL} AS p FROM a),
q AS (SELECT lang, term, {_P_SQL} AS q FROM (SELECT lang, NULL AS source, term, every AS count FROM k)),
x AS (SELECT p.lang, p.source, o.source AS item, sum((p.p - o.p) * (p.p - o.p) // o.p) AS value FROM p JOIN p o ON o.lang = p.lang AND o.term = p.term AND o.source <> p.source GROUP BY ALL),
r AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(value, 0)::BIGINT AS value FROM g JOIN g o ON o.lang = g.lang AND o.source <> g.source LEFT JOIN x ON x.lang = g.lang AND x.source = g.source AND x.item = o.source
  UNION ALL SELECT p.lang, source, 'term', p.term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE count > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r QUALIFY part = 'pair' OR rank <= {TOP}
""",
    "op13_prefix_trie": f"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
v AS MATERIALIZED (SELECT c, list([role, text] ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || ':' || text)) AS l FROM t GROUP BY c),
h AS (SELECT c, l, {_CRC_SQL} % 9 AS h FROM v),
q AS MATERIALIZED (SELECT h.c, list_concat(list_slice(coalesce(b.l, []), 1, h.h), list_slice(h.l, h.h + 1, len(h.l))) AS l FROM h LEFT JOIN v b ON b.c = h.c - h.c % 5),
x AS MATERIALIZED (SELECT c, d, list_slice(l, 1, d) AS k, CASE WHEN d > 0 THEN list_slice(l, 1, d - 1) END AS up, CASE WHEN d > 0 THEN strlen(l[d][2]) ELSE 0 END AS bytes, len(l) AS size
      FROM (SELECT c, l, unnest(generate_series(0, len(l))) AS d FROM q)),
m AS MATERIALIZED (SELECT k, any_value(up) AS up, d, min(c) AS c, count(*) AS n, (count(*) - 1) * min(bytes) AS own, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = size) AS ends FROM x GROUP BY k, d),
p AS MATERIALIZED (SELECT m.*, o.c AS above, (SELECT count(*) FROM m z WHERE z.up = m.k) AS kids FROM m LEFT JOIN m o ON o.k = m.up),
s AS (SELECT x.k, sum(p.own) AS saved, count(*) FILTER (WHERE kids = 0) AS leaves FROM p JOIN x ON x.c = p.c AND x.d <= p.d GROUP BY x.k)
SELECT p.c AS conv_id, p.d::BIGINT AS depth, above AS parent_conv_id, n AS n_convs, kids AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM p JOIN s ON s.k = p.k
""",
    "op4_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
FROM m
""",
    "op3_jaccard_join": f"""
WITH RECURSIVE sh AS MATERIALIZED {_shingles_sql("documents", "doc_id")},
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o >= 80 * (x.n + y.n - o)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
""",
    "op7_quality_rules": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w FROM documents),
g AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM t WHERE len(w) >= 5)),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS k FROM g) WHERE k > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^ \t-\r]') GROUP BY doc_id),
m AS (SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(l.n_lines, 0)::BIGINT AS n_lines, coalesce(l.n_dup, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(t, '[A-Za-z]')) AS n_letters,
  len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '!')) AS n_exclaim, len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) AS n_alpha_words,
  len(list_filter(generate_series(2, len(w)), lambda i: w[i] = w[i - 1])) AS n_echo_words FROM t LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, (""" + " + ".join(f"CASE WHEN {condition} THEN {1 << i} ELSE 0 END" for i, (_, condition) in enumerate(RULES)) + r""")::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, fail_bits = 0 AS kept, fail_bits FROM b
""",
    "op8_decontamination": f"""
WITH d AS {_shingles_sql("documents", "doc_id")}, b AS {_shingles_sql("benchmark", "item_id")},
n AS (SELECT item_id, count(*) AS n FROM b GROUP BY item_id)
SELECT d.doc_id, b.item_id, max(n.n)::BIGINT AS n_item, count(*)::BIGINT AS n_shared, count(*) / max(n.n) AS containment
FROM d JOIN b ON d.s = b.s JOIN n ON n.item_id = b.item_id GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * max(n.n)
""",
    "op2_line_dedup": f"""
WITH raw AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM raw),
n AS (SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^ \\t-\\r]+')) AS nw FROM l),
c AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY pos) AS ce FROM n WHERE nw > 0),
b AS (SELECT *, ce - nw AS cb, max(ce) OVER (PARTITION BY doc_id) AS total FROM c),
w AS (SELECT *, list(line) OVER fw AS fl, max(pos) OVER fw AS fhi, list(line) OVER bw AS bl, min(pos) OVER bw AS blo FROM b
      WINDOW fw AS (PARTITION BY doc_id ORDER BY cb RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING),
             bw AS (PARTITION BY doc_id ORDER BY ce RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)),
s AS (SELECT doc_id, pos AS lo, fhi AS hi, fl AS ls FROM w WHERE total - cb >= {MIN_WORDS}
      UNION ALL SELECT doc_id, blo, pos, bl FROM w WHERE ce >= {MIN_WORDS}),
f AS (SELECT *, row_number() OVER (PARTITION BY ls ORDER BY doc_id, lo) AS r, first_value(doc_id) OVER (PARTITION BY ls ORDER BY doc_id, lo) AS fd,
      first_value(lo) OVER (PARTITION BY ls ORDER BY doc_id, lo) AS fp FROM s),
dead AS (SELECT DISTINCT doc_id, unnest(generate_series(lo, hi)) AS pos FROM f WHERE doc_id > fd OR (doc_id = fd AND lo > fp)),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE dead.pos IS NULL) AS text,
         count(*) AS n_lines, count(dead.pos) AS n_removed
         FROM l LEFT JOIN dead USING (doc_id, pos) GROUP BY l.doc_id)
SELECT raw.doc_id, coalesce(kept.n_lines, 0)::BIGINT AS n_lines, coalesce(kept.n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN raw.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM raw LEFT JOIN kept USING (doc_id)
""",
}
