"""Registered queries of the operators, each over its whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, embedding_dedup, language_model, mixing, near_dedup, periodic_runs, quality_classifier, quality_rules, substring_dedup, toxicity, warc

from .native import words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


#: Words of every document by position, as SQL.
WORDS_SQL = r"""
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lists AS (
  SELECT doc_id, text,
         list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM docs)
"""


def _rule_sql() -> str:
    parts = []
    for rule in quality_rules.RULES:
        inside = [f"{rule.measure} >= {float(rule.least)!r}::DOUBLE" for _ in [0] if rule.least is not None]
        inside += [f"{rule.measure} <= {float(rule.most)!r}::DOUBLE" for _ in [0] if rule.most is not None]
        text = " AND ".join(inside)
        parts.append(f"({text})" if not rule.from_words else f"(n_words < {rule.from_words} OR ({text}))")
    return " AND ".join(parts)


QUALITY_SQL = f"""
WITH {WORDS_SQL},
tokens AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM lists),
windows AS (
  SELECT doc_id, i, w || ' ' || lead(w, 1) OVER t || ' ' || lead(w, 2) OVER t || ' ' || lead(w, 3) OVER t
         || ' ' || lead(w, 4) OVER t AS five
  FROM tokens WINDOW t AS (PARTITION BY doc_id ORDER BY i)),
repeated AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS n FROM windows WHERE five IS NOT NULL),
covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM repeated, range(5) AS r(j) WHERE n > 1 GROUP BY doc_id),
lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM docs),
counts AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words,
         len(list_filter(ws, lambda w: list_contains([{", ".join(repr(w) for w in dict.fromkeys(quality_rules.STOP_WORDS))}], w))) AS n_stop
  FROM lists JOIN lines USING (doc_id) LEFT JOIN covered c USING (doc_id)),
measures AS (
  SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(word_chars, 1) AS symbol_ratio,
         n_stop / greatest(n_words, 1) AS stop_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
         n_words / greatest(n_lines, 1) AS words_per_line,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_rule_sql()} AS kept
FROM measures
"""


@query("op4_quality_rules", QUALITY_SQL)
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality_rules.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


DECONTAMINATE_SQL = r"""
WITH low AS (
  SELECT 'd' AS side, doc_id AS id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
  UNION ALL
  SELECT 'b', item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  FROM benchmark),
strings AS (
  SELECT DISTINCT id AS item_id, m, array_to_string(ws[i : i + m - 1], ' ') AS string
  FROM (SELECT id, ws, least(10, len(ws)) AS m, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i
        FROM low WHERE side = 'b' AND len(ws) > 0)),
lengths AS (SELECT DISTINCT m FROM strings),
spots AS (
  SELECT id AS doc_id, m, unnest(range(1, len(ws) - m + 2)) AS i, ws FROM low, lengths
  WHERE side = 'd' AND len(ws) >= m),
hits AS (
  SELECT doc_id, i, s.m, item_id FROM spots p JOIN strings s
  ON s.m = p.m AND s.string = array_to_string(p.ws[i : i + p.m - 1], ' ')),
words AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT doc_id, i, m FROM hits), range(10) AS r(j) WHERE j < m GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256
  FROM hits GROUP BY doc_id)
SELECT l.id AS doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM low l LEFT JOIN words w ON w.doc_id = l.id LEFT JOIN items t ON t.doc_id = l.id WHERE side = 'd'
"""


@query("op10_decontaminate", DECONTAMINATE_SQL)
def benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    items = table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate.summary(decontaminate.mark(docs, items))


MIX_SQL = f"""
WITH {WORDS_SQL},
sized AS (
  SELECT row_number() OVER () AS row, l.doc_id, d.source, len(ws) AS size,
         ('0x' || substr(md5(l.doc_id::VARCHAR), 1, 15))::BIGINT AS place
  FROM lists l JOIN documents d USING (doc_id)),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM sized GROUP BY source),
leveled AS (
  SELECT *, 3.0::DOUBLE * source_size AS room,
         ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(3.0::DOUBLE * source_size) OVER b, 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level,
         row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS ord
  FROM sources
  WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(room, weight * (SELECT arg_min(level, ord) FROM leveled WHERE level * weight <= room)) AS target
  FROM leveled),
quotas AS (
  SELECT *, ceil(source_size / 128)::BIGINT AS n, floor(target / greatest(source_size, 1))::BIGINT AS epochs FROM targets),
extras AS (
  SELECT *, least(round((target - epochs * source_size) / 128)::BIGINT, n) AS extra FROM quotas),
streams AS (
  SELECT s.*, x.source_size, target, n, epochs, extra,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY place % 4096, place, s.doc_id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN extras x ON x.source IS NOT DISTINCT FROM s.source),
pieces AS (
  SELECT *, unnest(range(start // 128, CASE WHEN size > 0 THEN (start + size - 1) // 128 + 1 ELSE start // 128 END)) AS block
  FROM streams),
cuts AS (
  SELECT row, (least((block + 1) * 128, start + size) - greatest(block * 128, start))
              * (epochs + ((block * (2147483647 % n) + 12345) % n < extra)::BIGINT) AS words
  FROM pieces),
sums AS (SELECT row, sum(words)::BIGINT AS taken FROM cuts GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM streams LEFT JOIN sums USING (row)
"""


@query("op2_mix_sources", MIX_SQL)
def mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return mixing.taken(docs).select("doc_id", "size", "source_size", "target", "taken")


NEAR_DEDUP_SQL = r"""
WITH RECURSIVE lists AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents),
shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) > 1
           THEN list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) ELSE ws END) AS s
  FROM lists),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= 80 * (p.n + q.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
named AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT l.doc_id, coalesce(n, 0) AS n_shingles, component_id, l.doc_id = component_id AS kept
FROM lists l LEFT JOIN sizes USING (doc_id) JOIN named USING (doc_id)
"""


@query("op7_near_duplicates", NEAR_DEDUP_SQL)
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return near_dedup.group(docs, shingle=2)


@query("op1_repeated_passages")
def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(table(spark, sf_dir, "documents", "doc_id", "text")).drop("version")


CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
full_turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + 24 + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')))::BIGINT AS formatted_chars
FROM full_turns GROUP BY conv_id
"""


@query("op3_chat_formatting", CHAT_SQL)
def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    odd = "<|im_end|><|im_start|>assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], turns.schema)
    done = chat.formatted(chat.from_turns(turns.unionByName(probe)))
    back = done.withColumns({
        "__turns": chat.parsed(F.col("text")), "__learned": chat.learned(F.col("text"), F.col("loss_spans")),
    })
    return back.select(
        F.col("tree").alias("conv_id"), F.size("__turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length("__learned").cast("long").alias("loss_chars"), F.sha2("__learned", 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
    )


@query("op6_toxicity")
def toxic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, lexicon).select("doc_id", "held_out", "score", "predicted")


@query("op5_quality_classifier")
def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    network = quality_classifier.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality_classifier.score(docs, network)


@query("op8_language_model")
def language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents", "doc_id", "text"))


def crawl_of(pages: DataFrame) -> DataFrame:
    """Every page as the WARC text of its capture and of a later not-modified answer; a null page is empty.

    The answers use other spellings of the URL, and a part of them lacks validators, carries
    another entity tag or comes before the capture.
    """
    n, ten = F.col("page_id"), F.pmod(F.col("page_id"), F.lit(10))
    fetched = F.lit(1_700_000_000) + F.pmod(n * 7919, F.lit(1_000_003))
    again = fetched + F.when(ten == 7, -3600).otherwise(86400)
    stamp = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    modified = F.concat(F.lit("Last-Modified: "), stamp(fetched - 86400))
    pages = pages.withColumn("html", F.coalesce("html", F.lit("")))
    pages, tag = pages.withColumn("tag", F.md5(F.col("html").cast("binary"))), F.col("tag")
    url2 = (
        F.when(n % 4 == 1, F.regexp_replace("url", "^https?:", "https:")).when(n % 4 == 2, F.concat("url", F.lit("#again")))
        .when(n % 4 == 3, F.concat("url", F.when(F.col("url").contains("?"), "&utm_medium=mail").otherwise("?utm_medium=mail")))
        .otherwise(F.col("url"))
    )
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c.cast("string"))

    def fields(kind: str, number, url, date):
        return F.array(
            F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: <urn:page:"), number.cast("string"), F.lit(">")),
            line("WARC-Target-URI", url), line("WARC-Date", stamp(date)),
        )

    capture = warc.record_text(
        fields("response", n * 2, F.col("url"), fetched), F.lit("200 OK"),
        F.array(
            F.lit("Content-Type: text/html"), F.lit("Cache-Control: no-cache"), line("Date", stamp(fetched)), modified,
            F.concat(F.lit('ETag: "'), tag, F.lit('"')), line("Content-Length", F.octet_length("html")),
        ),
        F.col("html"),
    )
    new_tag = (
        F.when(ten == 3, F.lit('ETag: "other"')).when(ten == 5, F.concat(F.lit('ETag: W/"'), tag, F.lit('"')))
        .when(~ten.isin(4, 6), F.concat(F.lit('ETag: "'), tag, F.lit('"')))
    )
    answer = warc.record_text(
        fields("revisit", n * 2 + 1, url2, again), F.lit("304 Not Modified"),
        F.array(line("Date", stamp(again)), line("Cache-Control", F.concat(F.lit("max-age="), n % 7)), F.lit("Content-Length: 0"),
                new_tag, F.when(ten != 6, modified)),
        F.lit(""),
    )
    return pages.select(F.explode(F.array(capture, answer)).alias("record"))


WARC_SQL = r"""
WITH base AS (
  SELECT page_id AS n, page_id % 10 AS ten, url, coalesce(html, '') AS html, md5(coalesce(html, '')) AS tag,
         1700000000 + (page_id * 7919) % 1000003 AS fetched
  FROM pages),
timed AS (SELECT *, fetched + CASE WHEN ten = 7 THEN -3600 ELSE 86400 END AS again FROM base),
events AS (
  SELECT n * 2 AS record_id, 'response' AS type, url, fetched, tag, ten, n, html, again FROM timed
  UNION ALL
  SELECT n * 2 + 1, 'revisit',
         CASE n % 4 WHEN 1 THEN regexp_replace(url, '^https?:', 'https:') WHEN 2 THEN url || '#again'
                    WHEN 3 THEN url || CASE WHEN contains(url, '?') THEN '&utm_medium=mail' ELSE '?utm_medium=mail' END
                    ELSE url END, again, tag, ten, n, html, fetched
  FROM timed),
parts AS (
  SELECT *, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', ['host', 'path', 'query', 'rest']) AS u
  FROM events),
named AS (
  SELECT *, regexp_replace(regexp_replace(lower(u.host), ':(80|443)$', ''), '^www[0-9]*\.', '')
         || CASE WHEN regexp_replace(u.path, '/+$', '') = '' THEN '/' ELSE regexp_replace(u.path, '/+$', '') END
         || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(substr(u.query, 2), '&'), lambda p:
              p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|fbclid|gclid|ref|sessionid|phpsessid|jsessionid|sid)(=|$)'))), '&'), ''), '')
         AS canonical_url
  FROM parts),
found AS (
  SELECT *, last_value(CASE WHEN type = 'response' THEN {'id': record_id, 't': fetched, 'tag': tag, 'html': html} END IGNORE NULLS)
              OVER (PARTITION BY canonical_url ORDER BY fetched, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b
  FROM named),
judged AS (
  SELECT *, CASE WHEN b IS NULL THEN 'no_response' WHEN ten = 6 THEN 'unverified'
                 WHEN ten = 3 THEN 'mismatch'
                 WHEN ten = 4 THEN CASE WHEN b.t = again THEN 'resolved' ELSE 'mismatch' END
                 WHEN b.tag = tag THEN 'resolved' ELSE 'mismatch' END AS outcome
  FROM found WHERE type = 'revisit')
SELECT record_id, canonical_url, outcome,
       CASE WHEN outcome = 'resolved' THEN b.id END AS response_id,
       CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=' || n % 7 || chr(10) || 'content-length: ' || strlen(b.html) || chr(10)
         || 'content-type: text/html' || chr(10) || 'date: ' || strftime(make_timestamp(fetched * 1000000), '%Y-%m-%dT%H:%M:%SZ') || chr(10)
         || 'etag: ' || CASE WHEN ten = 4 THEN '"' || b.tag || '"' WHEN ten = 5 THEN 'W/"' || tag || '"' ELSE '"' || tag || '"' END || chr(10)
         || 'last-modified: ' || strftime(make_timestamp((again - 86400) * 1000000), '%Y-%m-%dT%H:%M:%SZ') END AS headers,
       CASE WHEN outcome = 'resolved' THEN 'sha256:' || sha256(b.html) END AS payload_digest,
       CASE WHEN outcome = 'resolved' THEN strlen(b.html) END AS payload_length
FROM judged
"""


@query("op9_warc_revisits", WARC_SQL)
def warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = crawl_of(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    done = warc.resolve(warc.records(texts))
    return done.withColumn("headers", warc.header_text(F.col("headers"))).drop("url", "fetched")


DIVERGENCE_SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM base),
counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM words GROUP BY ALL),
vocabulary AS (SELECT lang, term, sum(n) AS lang_n FROM counts GROUP BY ALL HAVING sum(docs) >= 30),
kept AS (SELECT lang, source, term, n FROM counts JOIN vocabulary USING (lang, term)),
langs AS (
  SELECT b.lang, count(v.term) AS v, coalesce(sum(lang_n), 0) AS lang_total
  FROM (SELECT DISTINCT lang FROM base) b LEFT JOIN vocabulary v USING (lang) GROUP BY b.lang),
groups AS (
  SELECT b.lang, b.source, coalesce(sum(n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM base) b LEFT JOIN kept k USING (lang, source) GROUP BY ALL),
priced AS (
  SELECT g.lang, g.source, t.term, coalesce(k.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(k.n, 0) + 5)) // (total + 5 * v) AS p,
         1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v) AS q
  FROM groups g JOIN langs USING (lang) JOIN vocabulary t USING (lang)
  LEFT JOIN kept k ON k.lang = g.lang AND k.source = g.source AND k.term = t.term),
sums AS (
  SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
  FROM priced x JOIN priced y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
pairs AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups x JOIN groups y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN sums s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM priced WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@query("op12_source_divergence", DIVERGENCE_SQL)
def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents", "lang", "source", "text"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth, chosen by id, repeats a stretch of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.withColumn("h", h).withColumn("g", F.floor(F.col("h") / 10)).withColumn(
        "ws", F.when(F.col("h") % 10 == 0, words(F.col("text")))
    ).withColumn("n", F.size("ws"))
    placed = chosen.withColumn("a", (F.col("g") % F.greatest(F.col("n"), F.lit(1))).cast("int")).withColumn(
        "p", F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("int") + 1
    )
    left = F.col("n") - F.col("a")
    times = F.ceil(left / F.col("p")).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("ws", F.col("a") + 1, F.col("p")), times)), F.lit(1), left)
    planted = F.array_join(F.concat(F.slice("ws", F.lit(1), F.col("a")), again), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def repeated_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find(with_planted_runs(table(spark, sf_dir, "documents", "doc_id", "text")))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"], r["period"])))
    return found.withColumn("top", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start"), (-F.col("top.l")).alias("length"),
        F.col("top.period"), F.expr("(-1000 * top.l) div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


EMBEDDING_SQL = """
WITH RECURSIVE flat AS (
  SELECT vec_id, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings),
norms AS (
  SELECT vec_id, sqrt(sum(x * x)) AS norm FROM flat GROUP BY vec_id
  HAVING sum(x * x) > 0 AND bool_and(isfinite(x)) AND count(x) = count(*)),
vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, norm FROM embeddings JOIN norms USING (vec_id)),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
named AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
numbers AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN named USING (vec_id) LEFT JOIN numbers USING (vec_id)
"""


@query("op13_embedding_near_duplicates", EMBEDDING_SQL)
def embedding_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.group(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
