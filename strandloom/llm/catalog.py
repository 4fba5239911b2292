"""Queries of the corpus operators with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import table
from strandloom.llm.license_sql import LICENSE_SQL


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm import toxicity

    return toxicity.score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def dated_list(pages: DataFrame) -> DataFrame:
    """A list for the pages' own hosts and first path levels: put on, taken off and put on again at hashed dates.

    The tables hold no list; a deployment passes its own to filter_urls.
    """
    from strandloom.llm.url_filter import host_of

    host = host_of(F.col("url"))
    level = F.concat_ws("/", host, F.regexp_extract("url", r"^[a-z]+://[^/]*/([^/?#]+)", 1))
    domains = pages.select(F.lit("domain").alias("kind"), F.regexp_replace(host, "^(www|m|blog)[.]", "").alias("pattern"))
    prefixes = pages.where(F.regexp_extract("url", r"^[a-z]+://[^/]*/([^/?#]+)", 1) != "").select(F.lit("prefix").alias("kind"), level.alias("pattern"))
    known = domains.unionByName(prefixes).where("pattern <> ''").distinct()
    draw = lambda name, n: F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(name), "kind", "pattern").cast("binary")), 1, 7), 16, 10).cast("int"), F.lit(n))
    start = F.lit("2024-01-01").cast("date")
    on = F.date_add(start, draw("on", 200))
    off, again = F.date_add(on, draw("off", 90)), F.date_add(on, F.lit(120) + draw("again", 60))
    listed = known.where(draw("listed", 3) == 0)
    events = F.array(F.struct(F.lit("add").alias("action"), on.alias("at")), F.struct(F.lit("remove").alias("action"), off.alias("at")), F.struct(F.lit("add").alias("action"), again.alias("at")))
    return listed.select("kind", "pattern", F.explode(events).alias("e")).select("kind", "pattern", "e.action", "e.at")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.url_filter import filter_urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int"))
    return filter_urls(pages.withColumn("fetched", fetched), dated_list(pages))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm import quality

    return quality.score_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.warc import round_trip

    records = round_trip(spark, table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strandloom.llm.token_count import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("text")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.decontaminate import find_contamination

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_contamination(docs, table(spark, sf_dir, "benchmark")).drop("text")


def op11_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.substring import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.llm.spelling import group_variants, words_of

    return group_variants(words_of(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_top_k": op1_top_k,
    "op2_mixing": op2_mixing,
    "op3_toxicity": op3_toxicity,
    "op4_url_filters": op4_url_filters,
    "op5_licenses": op5_licenses,
    "op6_quality": op6_quality,
    "op7_warc": op7_warc,
    "op8_token_counts": op8_token_counts,
    "op9_simhash": op9_simhash,
    "op10_decontaminate": op10_decontaminate,
    "op11_substring": op11_substring,
    "op12_spelling": op12_spelling,
}


ORACLES: dict[str, str] = {
    "op2_mixing": """
        WITH sized AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM documents GROUP BY source
        ), rates AS (SELECT source, w / (SELECT sum(w) FROM sized) * (SELECT sum(n) FROM sized) / n AS rate FROM sized
        ), cdf AS (
            SELECT source, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
            FROM rates, range(0, 120) AS t(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 30)
        ), held AS (SELECT source, list(cdf) AS cdf FROM cdf GROUP BY source
        ), keyed AS (
            SELECT d.*, held.cdf, coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, ''))) AS doc_key
            FROM documents d JOIN held ON d.source IS NOT DISTINCT FROM held.source
        ), drawn AS (
            SELECT *, len(list_filter(cdf, lambda c: c <= CAST(CAST('0x' || substr(md5('20240501|copies|' || doc_key || '|1'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0)) AS n
            FROM keyed
        ), copies AS (SELECT doc_id, text, lang, source, n_chars, doc_key, unnest(range(1, n + 1)) AS copy FROM drawn)
        SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy,
               CAST('0x' || substr(md5('20240501|order|' || doc_key || '|' || copy), 1, 15) AS BIGINT) AS mix_order
        FROM copies
    """,
    "op4_url_filters": r"""
        WITH authority AS (
            SELECT *, CASE WHEN url LIKE '%://%' THEN split_part(split_part(split_part(substr(lower(url), position('://' IN url) + 3), '/', 1), '?', 1), '#', 1) ELSE '' END AS a FROM pages
        ), place AS (SELECT *, substr(a, position('@' IN a) + 1) AS p FROM authority
        ), hosts AS (
            SELECT page_id, url, rtrim(CASE WHEN p LIKE '[%' THEN substr(p, 1, position(']' IN p)) ELSE split_part(p, ':', 1) END, '.') AS host,
                   regexp_extract(url, '^[a-z]+://[^/]*/([^/?#]+)', 1) AS level,
                   string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/') AS path,
                   CAST(DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS DATE) AS fetched
            FROM place
        ), known AS (
            SELECT 'domain' AS kind, regexp_replace(host, '^(www|m|blog)[.]', '') AS pattern FROM hosts WHERE host <> ''
            UNION SELECT 'prefix', host || '/' || level FROM hosts WHERE level <> ''
        ), drawn AS (
            SELECT *, CAST('0x' || substr(md5('listed|' || kind || '|' || pattern), 1, 7) AS INTEGER) % 3 AS listed,
                   CAST('0x' || substr(md5('on|' || kind || '|' || pattern), 1, 7) AS INTEGER) % 200 AS d1,
                   CAST('0x' || substr(md5('off|' || kind || '|' || pattern), 1, 7) AS INTEGER) % 90 AS d2,
                   CAST('0x' || substr(md5('again|' || kind || '|' || pattern), 1, 7) AS INTEGER) % 60 AS d3
            FROM known
        ), entries AS (
            SELECT kind, pattern, 'add' AS action, DATE '2024-01-01' + d1 AS at FROM drawn WHERE listed = 0
            UNION ALL SELECT kind, pattern, 'remove', DATE '2024-01-01' + (d1 + d2) FROM drawn WHERE listed = 0
            UNION ALL SELECT kind, pattern, 'add', DATE '2024-01-01' + (d1 + 120 + d3) FROM drawn WHERE listed = 0
        ), labels AS (SELECT *, string_split(host, '.') AS l, list_filter(path, lambda x: x <> '') AS s FROM hosts WHERE host <> ''
        ), asked AS (
            SELECT page_id, url, fetched, 'domain' AS kind, unnest(list_transform(range(1, len(l) + 1), lambda i: array_to_string(l[i:], '.'))) AS pattern FROM labels
            UNION SELECT page_id, url, fetched, 'prefix', unnest(list_transform(range(0, len(s) + 1), lambda i: array_to_string([host] || s[1:i], '/'))) FROM labels
        ), latest AS (
            SELECT a.page_id, a.url, a.fetched, a.kind, a.pattern, arg_max(e.action, CAST(e.at AS VARCHAR) || e.action) AS action
            FROM asked a JOIN entries e ON a.kind = e.kind AND a.pattern = e.pattern AND e.at <= a.fetched
            GROUP BY ALL
        ), hits AS (SELECT page_id, url, fetched, count(*) AS n, min(kind || ':' || pattern) AS matched FROM latest WHERE action = 'add' GROUP BY ALL)
        SELECT h.page_id, h.url, h.fetched, coalesce(n, 0) AS n_matches, matched, coalesce(n, 0) > 0 AS blocked
        FROM hosts h LEFT JOIN hits USING (page_id, url, fetched)
    """,
    "op5_licenses": LICENSE_SQL,
    "op7_warc": """
        WITH payloads AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), largest AS (SELECT payload_digest, max(page_id) AS last FROM payloads WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN last IS NULL OR page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
        FROM payloads LEFT JOIN largest USING (payload_digest)
    """,
    "op1_top_k": """
        WITH usable AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1] * z[2], 0))), 0) AS BIGINT) AS score
            FROM usable q JOIN usable c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        WHERE rank <= 20
    """,
    "op10_decontaminate": r"""
        WITH items AS (
            SELECT * FROM (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
                           FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE len(words) > 0
        ), cut AS (SELECT item_id, words, least(len(words), 10) AS m, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS i FROM items
        ), windows AS (SELECT DISTINCT item_id, m, array_to_string(words[i:i + m - 1], ' ') AS win FROM cut
        ), docs AS (
            SELECT row_number() OVER () AS row, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM documents
        ), places AS (SELECT row, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM docs, (SELECT DISTINCT m FROM windows)
        ), hits AS (SELECT row, i, p.m, item_id FROM (SELECT row, i, m, array_to_string(words[i:i + m - 1], ' ') AS win FROM places) p JOIN windows w ON p.m = w.m AND p.win = w.win
        ), hit AS (SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(i, i + m)) AS place FROM hits) GROUP BY row
        ), ids AS (SELECT row, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS digest FROM (SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY row)
        SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN hit USING (row) LEFT JOIN ids USING (row)
    """,
    "op11_substring": r"""
        WITH docs AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), cut AS (SELECT row, words, unnest(range(1, len(words) - 33)) AS i FROM docs
        ), windows AS (SELECT row, i, md5(array_to_string(words[i:i + 34], ' ')) AS win FROM cut
        ), repeated AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY win) AS n FROM windows) WHERE n > 1
        ), places AS (SELECT row, word, i FROM (SELECT row, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM docs)
        ), marked AS (
            SELECT p.row, p.i, p.word, max(r.i IS NOT NULL) OVER (PARTITION BY p.row ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
            FROM places p LEFT JOIN repeated r ON p.row = r.row AND p.i = r.i
        ), kept AS (
            SELECT row, count(*) FILTER (WHERE gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS text
            FROM marked GROUP BY row
        )
        SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (row)
    """,
    "op12_spelling": r"""
        WITH RECURSIVE shifts AS (
            SELECT n, n AS c, 0 AS k FROM range(0, 256) AS t(n)
            UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM shifts WHERE k < 8
        ), crc AS (SELECT list(c ORDER BY n) AS t FROM shifts WHERE k = 8
        ), runs AS (
            SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
            FROM documents
        ), counted AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL
        ), bytes AS (
            SELECT *, list_transform(range(0, strlen(id || ':' || run)), lambda i: CAST('0x' || substr(hex(encode(id || ':' || run)), 2 * i + 1, 2) AS BIGINT)) AS b FROM counted
        ), hashed AS (
            SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295::BIGINT) AS h FROM bytes, crc
        ), seen AS (
            SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
        ), words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM seen WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
        ), less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)
        ), near AS (
            SELECT a.word, a.n, b.word AS other, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
            UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
        ), best AS (SELECT word, n, count(*) AS n_near, min({'k': -m, 'w': encode(other)}) AS top FROM near GROUP BY word, n
        ), formed AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.k >= 10 * w.n THEN decode(top.w) END AS form, CASE WHEN -top.k >= 10 * w.n THEN -top.k END AS form_n
            FROM words w LEFT JOIN best USING (word)
        ), walk AS (
            SELECT word, word AS at, form AS next FROM formed
            UNION ALL SELECT walk.word, walk.next, f.form FROM walk JOIN formed f ON f.word = walk.next
        )
        SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN walk ON f.word = walk.word AND walk.next IS NULL
    """,
}
