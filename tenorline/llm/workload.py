"""Queries ``opN_<name>`` over the given tables and, where SQL can express the result, the DuckDB SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenorline.llm import adaptive_scan, chat, collocations, decontaminate, importance, jaccard, kdtree, language, mixing, secrets, spelling, token_files, warc
from tenorline.llm.runtime import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public vocabulary files of this machine are."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_and_read(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op8_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_scan.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_decontamination, op3_ngram_jaccard_join, op4_warc, op5_language_id, op6_token_output, op7_chat_formatting, op8_quality_resampling,
    op9_source_mixing, op10_topk_search, op11_spelling_variants, op12_phrase_collocations, op13_nearest_neighbours)}


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# The kinds as the contract states them: pattern, checked group and its least length.
_KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
    ("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 0),
    ("forge", r"gh[opsu]_[A-Za-z0-9]{36,}", 0, 0),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
]

_SECRETS = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(f"SELECT rid, '{k}' AS kind, {i} AS place, {least} AS least, regexp_extract_all(text, {_sql_text(p)}, 0) AS hits, regexp_extract_all(text, {_sql_text(p)}, {g}) AS parts, string_split_regex(text, {_sql_text(p)}) AS gaps FROM t WHERE regexp_matches(text, {_sql_text(p)})" for i, (k, p, g, least) in enumerate(_KINDS))}),
n AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m),
e AS (SELECT rid, kind, place, i, length(hits[i]) AS len, length(parts[i]) >= least AS kept,
             sum(length(gaps[i]) + length(hits[i])) OVER (PARTITION BY rid, kind ORDER BY i) AS stop FROM n),
s AS (SELECT rid, kind, place, stop - len AS start, kind || ':' || (stop - len)::BIGINT || ':' || stop::BIGINT AS span FROM e WHERE kept),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(span, ',' ORDER BY start, place) FILTER (place < 3) AS base, string_agg(span, ',' ORDER BY start, place) AS spans FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (rid)"""

_CHATS = """
WITH d AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM d),
c AS (SELECT conv_id, count(*) AS n_turns, list(struct_pack(r := role, t := text) ORDER BY pos) AS turns,
             string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered FROM p GROUP BY conv_id),
u AS (SELECT turns, min(n_turns) AS n_turns, min(conv_id) AS conv_id, count(*) AS n_same, min(rendered) AS rendered FROM c GROUP BY turns)
SELECT conv_id, 0 AS part, n_turns, n_same, rendered FROM u
WHERE NOT EXISTS (SELECT 1 FROM u AS longer WHERE longer.n_turns > u.n_turns AND longer.turns[1] = u.turns[1] AND longer.turns[1:u.n_turns] = u.turns)"""


def _round(before: str, after: str) -> str:
    """One round of the drawing: rows that fit, in hash order, into what is left of the quota."""
    return f""",
{after}_l AS (SELECT *, quota - sum(CASE WHEN extra THEN size ELSE 0 END) OVER (PARTITION BY source) AS still FROM {before}),
{after}_o AS (SELECT * EXCLUDE (still), still, NOT extra AND size <= still AS fits FROM {after}_l),
{after} AS (SELECT * EXCLUDE (still, fits, extra), extra OR (fits AND sum(size) OVER (PARTITION BY source, fits ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) <= still) AS extra FROM {after}_o)"""


_MIX = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS weight, 3 * source_size AS cap FROM s),
r AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER lower, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER lower, 0) AS rest_weight FROM w
      WINDOW lower AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * rest_weight < rest * weight AS clamped FROM r),
a AS (SELECT arg_min(rest, -rest_weight) AS rest, max(rest_weight) AS rest_weight FROM f WHERE NOT clamped),
t AS (SELECT f.source, source_size, CASE WHEN clamped THEN cap::DOUBLE ELSE a.rest::DOUBLE * weight / a.rest_weight::DOUBLE END AS target FROM f, a),
r0 AS (SELECT doc_id, d.source, size, draw, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
              target - CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END * source_size AS quota, FALSE AS extra
       FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source){_round("r0", "r1")}{_round("r1", "r2")}{_round("r2", "r3")}
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (whole + extra::INT))::BIGINT AS taken FROM r3"""

_JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, [x FOR x IN string_split_regex(lower(text), '[^0-9a-z_\x{80}-\x{10FFFF}]+') IF x <> ''] AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS gram FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g AS a JOIN g AS b USING (gram) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a),
m AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, least(doc_id, coalesce(c.least, doc_id)) AS class_id, coalesce(n_links, 0) AS n_links FROM documents LEFT JOIN c ON c.a = doc_id LEFT JOIN m ON m.a = doc_id"""

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS kept FROM p)
SELECT page_id, n AS payload_bytes, s AS payload_digest, CASE WHEN n >= 1000 AND page_id < kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < kept THEN kept END AS refers_to FROM g"""

_TOP_K = """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
           WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([z[1] * z[2] FOR z IN list_zip(q.v, c.v)])::BIGINT AS score
      FROM v AS q JOIN v AS c ON c.vec_id <> q.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 10"""

# CRC-32 with the usual reflected polynomial, a byte at a time over a table built by its rule.
_SPELLING = r"""
WITH RECURSIVE crc_table AS (SELECT list(x ORDER BY i) AS crcs FROM (SELECT i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS x FROM (SELECT unnest(range(256)) AS i))),
runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
         FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) WHERE length(run) >= 5 GROUP BY ALL),
summed AS (SELECT run, n, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, [('0x' || b)::BIGINT FOR b IN regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..')]),
                                                             lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1]))) AS h FROM runs, crc_table),
altered AS (SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, (h % length(run))::INT) || substring(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM summed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM altered WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cuts AS (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n FROM cuts AS a JOIN cuts AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
         UNION SELECT c.word, w.word, w.n FROM cuts AS c JOIN words AS w ON c.rest = w.word UNION SELECT w.word, c.word, c.n FROM cuts AS c JOIN words AS w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n FROM words AS w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS reached FROM forms UNION ALL SELECT c.word, f.form FROM chain AS c JOIN forms AS f ON f.word = c.reached WHERE f.form IS NOT NULL)
SELECT word, f.form, reached AS root, f.n, f.n_near, f.form_n FROM chain JOIN forms AS f USING (word) WHERE reached IN (SELECT word FROM forms WHERE form IS NULL)"""

_PHRASES = r"""
WITH pieces AS (SELECT row_number() OVER () AS piece, * FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents)),
w AS (SELECT lang, [x FOR x IN string_split_regex(t, '[\x20\x09]+') IF x <> ''] AS ws FROM pieces),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, unnest([ws[i:i + k - 1] FOR i IN range(1, len(ws) - k + 2)]) AS p FROM w, (SELECT unnest([1, 2, 3]) AS k)),
f AS (SELECT lang, p, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, p, f AS a FROM f WHERE len(p) > 1),
inside AS (SELECT lang, p, max(a) AS longer FROM (SELECT lang, p[1:2] AS p, a FROM c WHERE len(p) = 3 UNION ALL SELECT lang, p[2:3], a FROM c WHERE len(p) = 3) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inside AS i ON i.lang = c.lang AND i.p = c.p WHERE len(c.p) = 3 OR coalesce(100 * i.longer < 50 * c.a, TRUE)),
cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM kept),
scored AS (SELECT cuts.*, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.p = cuts.p[1:k] JOIN f AS y ON y.lang = cuts.lang AND y.p = cuts.p[k + 1:]),
low AS (SELECT *, array_to_string(p, ' ') AS phrase FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM low JOIN n USING (lang) QUALIFY rank <= 2000"""

ORACLES = {"op11_spelling_variants": _SPELLING, "op12_phrase_collocations": _PHRASES, "op1_secret_scan": _SECRETS, "op3_ngram_jaccard_join": _JACCARD, "op4_warc": _WARC, "op10_topk_search": _TOP_K, "op7_chat_formatting": _CHATS, "op9_source_mixing": _MIX}
