"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.oracle import matches
from . import chat_format, decontaminate, html_extract, ngram_join, packing, quality, secret_scan, sharding, token_files, url_filter
from .common import table
from .tokens import tokenizer_file


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(table(spark, sf_dir, "documents")))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chat_texts(table(spark, sf_dir, "conversations"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")).read())


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_sharding, op3_ngram_join, op4_decontaminate, op5_packing, op6_url_filter, op7_quality_rules, op8_chat_format, op9_token_files, op10_html_extract)}

SQL: dict[str, str] = {}


def _url_sql() -> str:
    u, low, edge = "coalesce(url, '')", "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')", "[^a-z0-9]"
    host = f"translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = f"regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    soft = " + ".join(f"CASE WHEN regexp_matches({low}, '(^|{edge}){t}($|{edge})') THEN 1 ELSE 0 END" for t in url_filter.SOFT)
    # a border may end one hit and begin the next, so borders are doubled before hits are counted
    strict = f"len(regexp_extract_all(regexp_replace({low}, '({edge})', '\\1\\1', 'g'), '(^|{edge})({'|'.join(url_filter.STRICT)})($|{edge})'))"
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))", h + p, say) for say, h, p in rules]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{name}'" for c, name, _ in fits) + " END"
    said = "CASE " + " ".join(f"WHEN {c} THEN '{say}'" for c, _, say in fits) + f" WHEN n_strict > 0 OR n_soft >= {url_filter.SOFT_LIMIT} THEN 'block' ELSE 'allow' END"
    return f"""WITH seen AS (SELECT page_id, {host} AS host, {path} AS path, CAST({strict} AS BIGINT) AS n_strict, CAST({soft} AS BIGINT) AS n_soft FROM pages)
SELECT page_id, host, path, {rule} AS rule, {said} AS verdict, n_strict, n_soft FROM seen"""


SQL["op6_url_filter"] = _url_sql()
SQL["op8_chat_format"] = chat_format.SQL


def _secret_sql() -> str:
    """Spans of every rule by one replacement of all its matches, as they don't overlap one another."""
    quoted = lambda pattern: pattern.replace("'", "''")
    plain = {"assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""}
    least = {"assign": "length(regexp_extract(value, '{}', 2)) >= 8", "access": "length(value) >= 16"}
    found = []
    for k, rule in enumerate(secret_scan.RULES):
        spans = matches("SELECT doc, para, text FROM texts", "()", quoted(plain.get(rule.kind, rule.pattern)), "()")
        holds = least.get(rule.kind, "true").replace("{}", quoted(rule.pattern))
        found.append(f"SELECT doc, para, {k} AS k, {'true' if rule.base else 'false'} AS base, length(lead) AS s, '{rule.kind}:' || length(lead) || ':' || length(lead) + length(value) AS told, '{rule.kind}' AS kind FROM ({spans}) WHERE {holds}")
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE kind = '{r.kind}') AS BIGINT) AS n_{r.kind}" for r in secret_scan.RULES if r.base)
    return f"""WITH texts AS MATERIALIZED (SELECT doc_id AS doc, row_number() OVER () AS para, coalesce(text, '') AS text FROM documents), found AS ({" UNION ALL ".join(found)})
SELECT any_value(t.doc) AS doc_id, {counts}, sha256(coalesce(string_agg(told, ',' ORDER BY s, k) FILTER (WHERE base), '')) AS base_sha256, coalesce(string_agg(told, ',' ORDER BY s, k), '') AS spans
FROM texts t LEFT JOIN found f ON f.para = t.para GROUP BY t.para"""


def _sharding_sql(shards: int = 24) -> str:
    """Binary search by recursion over the sorted groups' sums; the same cuts; CRC by its table."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        table.append(byte)
    octets = "list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    crc = f"xor(list_reduce({octets}, lambda c, b: xor(CAST({table}[(xor(c, b) & 255) + 1] AS BIGINT), c >> 8), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT))"
    fits = "list_reduce(bs, lambda a, x: CASE WHEN a % 1000000000000000000 + x > (lo + hi) // 2 THEN (a // 1000000000000000000 + 1) * 1000000000000000000 + x ELSE a + x END, CAST(1000000000000000000 AS HUGEINT)) // 1000000000000000000 <= " + str(shards)
    return f"""WITH RECURSIVE docs AS MATERIALIZED (SELECT doc_id, t, CAST(octet_length(encode(t)) + 8 AS BIGINT) AS size, CAST('0x' || substr(md5(t), 1, 15) AS BIGINT) AS h FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
groups AS MATERIALIZED (SELECT h, b, CAST(sum(b) OVER (ORDER BY h) AS BIGINT) AS s FROM (SELECT h, CAST(sum(size) AS HUGEINT) AS b FROM docs GROUP BY h)),
known AS MATERIALIZED (SELECT list(b ORDER BY h) AS bs, list_prepend(0, list(s ORDER BY h)) AS ends, CAST(max(s) AS BIGINT) AS total, CAST(max(b) AS BIGINT) AS largest FROM groups),
search AS (SELECT greatest((total + {shards - 1}) // {shards}, largest) AS lo, total AS hi FROM known
  UNION ALL SELECT CASE WHEN ok THEN lo ELSE (lo + hi) // 2 + 1 END, CASE WHEN ok THEN (lo + hi) // 2 ELSE hi END FROM (SELECT lo, hi, {fits} AS ok FROM search, known WHERE lo < hi)),
capacity AS MATERIALIZED (SELECT lo AS c FROM search WHERE lo = hi LIMIT 1),
rights AS (SELECT 0 AS j, total AS pos FROM known UNION ALL SELECT j + 1, list_min(list_filter(ends, lambda e: e >= greatest(0, pos - c))) FROM rights, known, capacity WHERE j < {shards - 1}),
cuts AS (SELECT {shards} AS n, CAST(0 AS BIGINT) AS pos UNION ALL SELECT n - 1, greatest(r, least(CASE WHEN even - low <= high - even THEN low ELSE high END, cap)) FROM (
  SELECT n, even, list_max(list_filter(ends, lambda e: e <= even)) AS low, list_min(list_filter(ends, lambda e: e >= even)) AS high, list_max(list_filter(ends, lambda e: e <= least(pos + c, total))) AS cap, r
  FROM (SELECT n, cuts.pos, cuts.pos + (total - cuts.pos) // n AS even, ends, total, c, rights.pos AS r FROM cuts, known, capacity, rights WHERE n > 1 AND rights.j = n - 1))),
placed AS (SELECT h, (SELECT count(*) FROM cuts WHERE n < {shards} AND cuts.pos <= groups.s - groups.b) AS shard FROM groups)
SELECT doc_id, size, CAST({crc} AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY h, doc_id) - 1 AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM docs JOIN placed USING (h)"""


_JOIN_SQL = f"""WITH RECURSIVE docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (SELECT DISTINCT r, unnest(CASE WHEN len(w) >= {ngram_join.SHINGLE} THEN list_transform(range(1, len(w) - {ngram_join.SHINGLE - 2}), lambda i: array_to_string(w[i:i + {ngram_join.SHINGLE - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM docs),
sizes AS MATERIALIZED (SELECT r, count(*) AS n FROM shingles GROUP BY r),
links AS MATERIALIZED (SELECT c.a, c.b FROM (SELECT x.r AS a, y.r AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.r <> y.r GROUP BY x.r, y.r) c JOIN sizes p ON p.r = c.a JOIN sizes q ON q.r = c.b WHERE 100 * c.c >= {ngram_join.PERCENT} * (p.n + q.n - c.c)),
reach AS (SELECT r AS a, r AS b FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT d.doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, m.component_id FROM docs d LEFT JOIN sizes z ON z.r = d.r JOIN (SELECT reach.a, min(e.doc_id) AS component_id FROM reach JOIN docs e ON e.r = reach.b GROUP BY reach.a) m ON m.a = d.r"""

SQL["op1_secret_scan"] = _secret_sql()
SQL["op2_sharding"] = _sharding_sql()
SQL["op3_ngram_join"] = _JOIN_SQL
