"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from temblor.llm import (
    chat, fingerprints, html_text, lang_id, mixing, near_dups, packing, secret_scan, sharding, url_filters, vector_codes, vector_dups, whitening,
)
from temblor.llm.registry import query, table
from temblor.session import new_work_folder

# The rules of the URL query.
URL_RULES = [
    url_filters.Rule("allow", "com"),
    url_filters.Rule("block", "example.com", "/en/"),
    url_filters.Rule("allow", "www.example.com", "/en/"),
    url_filters.Rule("block", "net", "/es/"),
    url_filters.Rule("block", "net", "/fr/"),
]


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_ADDED = "</s>[INST] ok [/INST]"

_LEVEL_SQL = """{c}0 AS (SELECT {keys}, sum(n) AS n, sum(good) AS good, any_value({p}) AS p, any_value({o}) AS o
       FROM outcomes {above} GROUP BY {keys}),
k{c} AS (SELECT round(CASE WHEN coalesce(v, 0) <= 0 THEN 1000 ELSE least(greatest(1 / v - 1, 1), 1000) END, 6) AS s FROM (
  SELECT sum((good - n * p) ** 2 - n * p * (1 - p)) / nullif(sum(n * (n - 1) * p * (1 - p)), 0) AS v FROM {c}0)),
{c}1 AS (SELECT {keys}, good + w * p AS a, n - good + w * (1 - p) AS b, CASE WHEN n = 0 THEN spread ELSE 0 END AS o
  FROM (SELECT *, CASE WHEN o = 0 THEN s ELSE 1 / spread - 1 END AS w
        FROM (SELECT *, o + (1 - o) / (s + 1) AS spread FROM {c}0, k{c}))),
"""
# Suffix, domain and host: each shrunk towards the one above it.
_LEVELS_SQL = "".join(_LEVEL_SQL.format(**level) for level in (
    {"c": "s", "keys": "suffix", "p": "p", "o": "o", "above": ", top"},
    {"c": "d", "keys": "suffix, domain", "p": "a / (a + b)", "o": "o", "above": "JOIN s1 USING (suffix)"},
    {"c": "h", "keys": "domain, host", "p": "a / (a + b)", "o": "o", "above": "JOIN d1 USING (domain)"}))

_URL_SQL = """
WITH parts AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
named AS (
  SELECT *, regexp_replace(host, ':[0-9]*$', '') AS name FROM parts),
tailed AS (
  SELECT *, split_part(name, '.', -2) || '.' || split_part(name, '.', -1) AS two FROM named),
marked AS (
  SELECT * EXCLUDE (two),
         CASE WHEN contains(name, '.') AND two IN (SUFFIXES) THEN two ELSE split_part(name, '.', -1) END AS suffix,
         CASE WHEN NOT contains(name, '.') THEN name
              WHEN two IN (SUFFIXES) AND name <> two THEN split_part(name, '.', -3) || '.' || two ELSE two END AS domain
  FROM tailed),
judged AS (
  SELECT doc_id, CAST(quality = 1 AND toxic = 0 AS INTEGER) AS g FROM labels),
outcomes AS (
  SELECT host, suffix, domain, sum(n) AS n, sum(good)::DOUBLE AS good FROM (
    SELECT host, suffix, domain, 0 AS n, 0 AS good FROM marked
    UNION ALL SELECT host, suffix, domain, 1, g FROM marked m JOIN judged j ON j.doc_id = m.page_id WHERE g IS NOT NULL)
  WHERE host <> '' GROUP BY ALL),
top AS (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) AS p,
               CASE WHEN coalesce(sum(n), 0) = 0 THEN 1 / 3.0::DOUBLE ELSE 0.0::DOUBLE END AS o FROM outcomes),
LEVELS
bounds AS (
  SELECT host, round(least(a / (a + b) + 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 1.0), 6) AS good_upper
  FROM h1),
ruled AS (
  SELECT m.*, b.good_upper,
         CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
              WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
              WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
              WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM marked m LEFT JOIN bounds b USING (host))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN good_upper < 0.7 THEN 'block' ELSE 'allow' END AS verdict,
       good_upper
FROM ruled
"""


_SUFFIX_SQL = ", ".join(f"'{s}'" for s in url_filters.TWO_LABEL_SUFFIXES)


@query("op1_url_filters", _URL_SQL.replace("SUFFIXES", _SUFFIX_SQL).replace("LEVELS", _LEVELS_SQL.strip()))
def op1(spark, sf_dir):
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")
    # Null, where the columns don't tell, is no label.
    outcomes = pages.select("page_id", "url").join(labels.select(F.col("doc_id").alias("page_id"), good.alias("good")), "page_id")
    return url_filters.judge_urls(pages, outcomes, URL_RULES)


@query("op2_near_duplicates")
def op2(spark, sf_dir):
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85, chunks=6)


@query("op3_html_text")
def op3(spark, sf_dir):
    return html_text.extract_text(table(spark, sf_dir, "pages"))


@query("op4_language_id")
def op4(spark, sf_dir):
    return lang_id.identify(table(spark, sf_dir, "documents")).drop("spans")


@query("op5_near_vectors")
def op5(spark, sf_dir):
    return vector_dups.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op6_shards")
def op6(spark, sf_dir):
    return sharding.shard_rows(table(spark, sf_dir, "documents")).withColumn("grown_shard", F.lit(None).cast("int"))


@query("op7_packing")
def op7(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())


@query("op8_fingerprints")
def op8(spark, sf_dir):
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


_CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
around AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens, lead(role) OVER w IS DISTINCT FROM role AS closes,
         regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS body, replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), chr(10), '<|line|>') AS head
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(body) + CASE WHEN opens THEN 13 + length(head) ELSE 8 END + CASE WHEN closes THEN 11 ELSE 0 END)::BIGINT AS formatted_chars
FROM around GROUP BY conv_id
"""


@query("op9_chat_format", _CHAT_SQL)
def op9(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.sql(
        f"SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, '{_ADDED}' AS text UNION ALL SELECT -7L, 1L, 'assistant', '{_ADDED}'")
    formatted = chat.format_conversations(rows.unionByName(added))
    return chat.digest_conversations(chat.read_conversations(formatted))


@query("op10_mixing")
def op10(spark, sf_dir):
    return mixing.mix_rates(table(spark, sf_dir, "documents"), mixing.domains_of(table(spark, sf_dir, "labels")))


_CODES_SQL = """
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, [CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) for c in embedding] AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0),
parts AS (
  SELECT r, p, x[p * len(x) // 16 + 1 : (p + 1) * len(x) // 16] AS v FROM kept, range(16) t(p)),
seeds AS (
  SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS e FROM kept ORDER BY vec_id NULLS LAST, x LIMIT 64),
b0 AS (SELECT p, e, v FROM parts JOIN seeds USING (r)),
ROUND0ROUND1
n2 AS (
  SELECT r, p, min(list_sum([(a.v[i] - b.v[i]) * (a.v[i] - b.v[i]) for i in range(1, len(a.v) + 1)])::BIGINT * 64 + e) AS best
  FROM parts a JOIN b2 b USING (p) GROUP BY r, p),
coded AS (
  SELECT r, string_agg(printf('%02x', (best % 64)::INTEGER), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error FROM n2 GROUP BY r),
digest AS (
  SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM (SELECT p, e, generate_subscripts(v, 1) AS i, unnest(v) AS c FROM b2))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), digest
"""

_CODES_ROUND_SQL = """n{k} AS (
  SELECT r, p, min(list_sum([(a.v[i] - b.v[i]) * (a.v[i] - b.v[i]) for i in range(1, len(a.v) + 1)])::BIGINT * 64 + e) % 64 AS e
  FROM parts a JOIN b{k} b USING (p) GROUP BY r, p),
m{k} AS (
  SELECT p, e, i, sum(c) AS s, count(*) AS n
  FROM (SELECT n.p, n.e, generate_subscripts(v, 1) AS i, unnest(v) AS c FROM n{k} n JOIN parts USING (r, p)) GROUP BY p, e, i),
b{next} AS (
  SELECT p, e, coalesce(any_value(w), any_value(v)) AS v FROM b{k} LEFT JOIN (
    SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS w FROM m{k} GROUP BY p, e) USING (p, e) GROUP BY p, e),
"""


@query("op11_vector_codes", _CODES_SQL.replace("ROUND0ROUND1", "".join(_CODES_ROUND_SQL.format(k=k, next=k + 1) for k in (0, 1)).strip()))
def op11(spark, sf_dir):
    return vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"))


@query("op12_whitening")
def op12(spark, sf_dir):
    return whitening.whiten_vectors(table(spark, sf_dir, "embeddings"))


def _secrets_sql() -> str:
    """Places from the lengths of the matches and of what is between them."""
    def literal(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    parts = [f"""SELECT r, {k} AS rank, '{rule.kind}' AS kind, {rule.least} AS least, m, p,
                        [length(regexp_extract(x, {literal(rule.pattern)}, {rule.group})) for x in m] AS g
      FROM (SELECT r, regexp_extract_all(text, {literal(rule.pattern)}) AS m, string_split_regex(text, {literal(rule.pattern)}) AS p FROM t)
      WHERE len(m) > 0""" for k, rule in enumerate(secret_scan.RULES)]
    base = ", ".join(f"'{r.kind}'" for r in secret_scan.BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in secret_scan.BASE_RULES)
    text = "kind || ':' || first || ':' || (first + long), ',' ORDER BY first, rank"
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
matched AS ({' UNION ALL '.join(parts)}),
placed AS (
  SELECT r, rank, kind, list_sum([length(x) for x in p[1:i]]) + coalesce(list_sum([length(x) for x in m[1:i - 1]]), 0) AS first,
         length(m[i]) AS long, g[i] >= least AS good
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM matched)),
found AS (
  SELECT r, {counts}, string_agg({text}) FILTER (kind IN ({base})) AS base, string_agg({text}) AS spans
  FROM placed WHERE good GROUP BY r)
SELECT doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in secret_scan.BASE_RULES)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN found USING (r)
"""


@query("op13_secret_scan", _secrets_sql())
def op13(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    root = new_work_folder(spark, "ledger")
    secret_scan.scan_versions(documents, root, "documents", "doc_id", None)
    found = secret_scan.spans_by_path(spark, root, dict(documents.dtypes)["doc_id"])
    return secret_scan.digest_spans(found)
