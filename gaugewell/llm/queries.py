"""The text operators on their whole tables: a query and, where SQL can express it, its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugewell.session import scratch_path

from . import (
    decontaminate, exact_dedup, filter_audit, lexical, line_dedup, packing, pii, quality, secret_scan, simhash, token_counts,
    url_filter, warc,
)
from .common import of_kinds, spans_text, table
from .encoding import vocabulary, vocabulary_pattern


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated"
    )


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
      FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM g),
p AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
h AS (SELECT doc_id, p.n, i, item_id FROM p JOIN g ON p.n = g.n AND p.gram = g.gram),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), k=4, radius=4)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = exact_dedup.DigestIndex(spark, scratch_path(spark, "digest_index"), dict(docs.dtypes)["doc_id"], buckets=32)
    return exact_dedup.deduplicate(docs, index, "documents")


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW w AS (PARTITION BY t)
"""

def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[F.size(of_kinds("base", k)).cast("long").alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(spans_text("base"), 256).alias("base_sha256"),
        spans_text("found").alias("spans"),
    )


def _number(text: Column, below: int) -> Column:
    """A number below ``below`` that depends on the text alone."""
    return (F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("int") % below).cast("int")


def _list_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries, made from the pages' own hosts, their parents and URLs.

    An entry is listed on a day of 2024; two of three are removed later, and half
    of those are listed again.
    """
    named = pages.filter("url IS NOT NULL").select(url_filter.plain_url(F.col("url")).alias("url"), url_filter.host(F.col("url")).alias("host"))
    parent = F.regexp_replace("host", r"^[^.]*\.", "")
    names = (
        named.select(F.explode(F.array(
            F.struct(F.col("host").alias("entry"), F.lit(3).alias("each")),
            F.struct(parent.alias("entry"), F.lit(1).alias("each")),
            F.struct(F.col("url").alias("entry"), F.lit(10).alias("each")),
        )).alias("e"))
        .select("e.*").filter("entry <> ''").distinct()
    )
    listed = names.filter(_number(F.concat(F.col("entry"), F.lit("#pick")), 840) % F.col("each") == 0).select("entry").distinct()
    first = _number(F.concat(F.col("entry"), F.lit("#first")), 200)
    gone = first + 1 + _number(F.concat(F.col("entry"), F.lit("#gone")), 60)
    again = gone + 1 + _number(F.concat(F.col("entry"), F.lit("#again")), 60)
    fate = _number(F.concat(F.col("entry"), F.lit("#fate")), 3)
    event = lambda n, on, when: F.struct(F.date_add(F.lit("2024-01-01").cast("date"), n).alias("day"), F.lit(on).alias("listed"), when.alias("happens"))
    events = F.array(event(first, True, F.lit(True)), event(gone, False, fate > 0), event(again, True, fate > 1))
    return listed.select("entry", F.explode(events).alias("e")).select("entry", "e.*").filter("happens").drop("happens")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), _number(F.concat(F.col("page_id").cast("string"), F.lit("#fetched")), 365))
    found = url_filter.filter_urls(pages.select("page_id", "url", fetched.alias("fetched")), _list_entries(pages))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return found.select("page_id", "host", day("fetched"), "blocked", "entry", day("listed_from"), "n_entries")


OP6_SQL = r"""
WITH p AS (SELECT page_id, url, regexp_replace(url, '#.*$', '') AS plain,
                  lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)) AS host,
                  DATE '2024-01-01' + (('0x' || substr(md5(page_id::VARCHAR || '#fetched'), 1, 7))::BIGINT % 365)::INT AS fetched FROM pages),
n AS (SELECT DISTINCT host AS entry, 3 AS each FROM p UNION SELECT regexp_replace(host, '^[^.]*\.', ''), 1 FROM p UNION SELECT plain, 10 FROM p),
l AS (SELECT DISTINCT entry FROM n WHERE entry <> '' AND ('0x' || substr(md5(entry || '#pick'), 1, 7))::BIGINT % 840 % each = 0),
k AS (SELECT entry, ('0x' || substr(md5(entry || '#first'), 1, 7))::BIGINT % 200 AS a,
             ('0x' || substr(md5(entry || '#gone'), 1, 7))::BIGINT % 60 + 1 AS b, ('0x' || substr(md5(entry || '#again'), 1, 7))::BIGINT % 60 + 1 AS c,
             ('0x' || substr(md5(entry || '#fate'), 1, 7))::BIGINT % 3 AS fate FROM l),
i AS (SELECT entry, DATE '2024-01-01' + a::INT AS f, CASE WHEN fate > 0 THEN DATE '2024-01-01' + (a + b)::INT END AS t FROM k
      UNION ALL SELECT entry, DATE '2024-01-01' + (a + b + c)::INT, NULL FROM k WHERE fate > 1),
q AS (SELECT page_id, fetched, plain AS key FROM p UNION SELECT page_id, fetched, array_to_string(string_split(host, '.')[g:], '.')
      FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS g FROM p)),
m AS (SELECT page_id, entry, f, row_number() OVER (PARTITION BY page_id ORDER BY length(entry) DESC, entry DESC) AS r, count(*) OVER (PARTITION BY page_id) AS n
      FROM q JOIN i ON key = entry AND fetched >= f AND (t IS NULL OR fetched < t))
SELECT p.page_id, host, strftime(fetched, '%Y-%m-%d') AS fetched, m.entry IS NOT NULL AS blocked, m.entry, strftime(f, '%Y-%m-%d') AS listed_from,
       coalesce(n, 0) AS n_entries
FROM p LEFT JOIN m ON p.page_id = m.page_id AND r = 1
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rest = line_dedup.drop_common_lines(docs, counts=True)
    return rest.select("doc_id", "n_gone", "n_partners", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secret_scan.RULES[: secret_scan.BASE]]
    return found.select(
        "doc_id",
        *[F.size(of_kinds("found", k)).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(spans_text(of_kinds("found", *base)), 256).alias("base_sha256"),
        spans_text("found").alias("spans"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.section_tokens(docs, vocabulary("byte_bpe_50k.tiktoken"), vocabulary_pattern(), rule="most")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens"
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), part="lang")


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, part, CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
             || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails FROM d),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
      FROM m LEFT JOIN labels USING (doc_id) GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
o AS (SELECT p.l || q.l || r.l || s.l || u.l AS o FROM l p, l q, l r, l s, l u
      WHERE p.l NOT IN (q.l, r.l, s.l, u.l) AND q.l NOT IN (r.l, s.l, u.l) AND r.l NOT IN (s.l, u.l) AND s.l <> u.l),
k AS (SELECT o, k.k, o[k.k] AS letter FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k) k),
g AS (SELECT part, fails, n, good, toxic, o, (SELECT min(k) FROM unnest([1, 2, 3, 4, 5]) AS x(k) WHERE contains(fails, o[k])) AS gone FROM c, o),
r AS (SELECT part, g.o AS filter_order, k::INT AS step, letter,
             sum(CASE WHEN gone IS NULL OR gone > k THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN gone = k THEN n ELSE 0 END)::BIGINT AS removed,
             sum(CASE WHEN gone < k AND contains(fails, letter) THEN n ELSE 0 END)::BIGINT AS redundant,
             sum(CASE WHEN fails = letter THEN n ELSE 0 END)::BIGINT AS unique_fails,
             sum(CASE WHEN gone = k THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN gone = k THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM g JOIN k ON g.o = k.o GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r
"""


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archives = scratch_path(spark, "archives")
    warc.write_archives(pages, archives)
    records = warc.read_chunks(spark, archives, data=False)
    return records.select(
        "page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", "uri"
    )


# The SQL has the target URI only as far as urls need no percent-encoding.
OP12_SQL = """
SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN strlen(h) >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 100 AND page_id > first THEN first END AS refers_to, url AS uri
FROM (SELECT page_id, url, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
"""


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS docs, sum(len(w))::BIGINT AS terms FROM d),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
f AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
g AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM f, s GROUP BY term, docs),
m AS (SELECT doc_id, 10 + (90 * len(w) * docs) // terms AS m FROM d, s),
p AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM i JOIN f USING (term) JOIN g USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM p WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_simhash": op2_simhash,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_quality": op4_quality,
    "op5_pii": op5_pii,
    "op6_url_filter": op6_url_filter,
    "op7_line_dedup": op7_line_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_token_counts": op9_token_counts,
    "op10_packing": op10_packing,
    "op11_filter_audit": op11_filter_audit,
    "op12_warc": op12_warc,
    "op13_lexical_search": op13_lexical_search,
}
SQL = {
    "op1_decontaminate": OP1_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op6_url_filter": OP6_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_warc": OP12_SQL,
    "op13_lexical_search": OP13_SQL,
}
