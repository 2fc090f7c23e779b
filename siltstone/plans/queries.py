"""Registered queries over the given tables, and SQL that says the same.

Each query runs over its whole tables. Searches take as queries every row whose
id is divisible by 20, against all rows. Where SQL cannot say the same, the
tests compare with a plain model instead.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import html as H
from siltstone.functions import text as T
from siltstone.functions import urls as U
from siltstone.operators import crawl, dense, expand, fusion, rerank, sparse, store
from siltstone.plans import embed, retrieve, services
from siltstone.plans import ingest as ingest_plan
from siltstone.plans.settings import Settings
from siltstone.sources.tables import ensure_checkpoint_dir, latest, spread, table
from siltstone.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# ---- pieces of SQL

_SPACES = r"[ \t\n\r\f\x{0B}\x{85}\x{A0}\x{2028}\x{2029}]+"
_WORDS = rf"list_filter(regexp_split_to_array(text, '{_SPACES}'), lambda w: w <> '')"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TOKENS = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z0-9][A-Za-z0-9''_-]*'), lambda t: length(t) >= 2 AND t NOT IN ({_STOP}))"
_ID = "('0x' || md5(token)[1:8])::BIGINT"
_TRACKING = ", ".join(f"'{p}'" for p in U.TRACKING_PARAMS)
_NORMAL = rf"""
    lower(regexp_extract(trim(url), '^([A-Za-z]+)://', 1)) || '://' ||
    regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z]+://([^/?#]*)', 1)),
        CASE WHEN url ILIKE '%https:%' THEN ':443$' ELSE ':80$' END, ''), '^$', '') ||
    CASE WHEN regexp_replace(regexp_extract(trim(url), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') = '' THEN '/'
         ELSE regexp_replace(regexp_extract(trim(url), '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') END ||
    coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(trim(url), '\?([^#]*)', 1), '&'),
        lambda p: regexp_matches(p, '=.') AND lower(split_part(p, '=', 1)) NOT IN ({_TRACKING}))), '&'), ''), '')"""
_LAST_CRAWL = "(SELECT * FROM crawl_results QUALIFY row_number() OVER (PARTITION BY crawl_id ORDER BY loaded_at DESC) = 1)"
_LAST_CHUNK = "(SELECT * FROM chunk_payloads QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC) = 1)"
_POSTINGS = f"""
    tokens AS (SELECT doc_id, {_TOKENS} AS tokens FROM documents),
    terms AS (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS token FROM tokens),
    postings AS (SELECT doc_id, {_ID} AS term_id, count(*)::INT AS tf, any_value(dl)::INT AS dl FROM terms GROUP BY doc_id, term_id),
    counts AS (SELECT term_id, count(*) AS df FROM postings GROUP BY term_id),
    stats AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM (SELECT DISTINCT doc_id, dl FROM postings))"""
_DOC_WEIGHTS = """
    weighted AS (SELECT doc_id, p.term_id, tf, dl, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS weight
                 FROM postings p JOIN counts USING (term_id), stats)"""
_QUERY_WEIGHTS = f"""
    query_terms AS (SELECT query_id, {_ID} AS term_id, count(*) AS tf FROM (SELECT query_id, unnest({_TOKENS}) AS token FROM queries) GROUP BY ALL),
    query_weights AS (SELECT query_id, q.term_id, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * q.tf AS weight FROM query_terms q JOIN counts USING (term_id), stats)"""
_TITLE_QUERIES = "queries AS (SELECT doc_id AS query_id, title AS text FROM documents WHERE doc_id % 20 = 0)"
_BM25 = f"""{_POSTINGS},{_TITLE_QUERIES},{_DOC_WEIGHTS},{_QUERY_WEIGHTS},
    scored AS (SELECT query_id, doc_id, round(sum(q.weight * d.weight), 9) AS score FROM query_weights q JOIN weighted d USING (term_id) GROUP BY ALL),
    bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= 10)"""


def _words_sql(column: str) -> str:
    return f"list_filter(regexp_split_to_array({column}, '{_SPACES}'), lambda w: w <> '')"


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160) || chr(8232) || chr(8233)"


def _trim_sql(text: str) -> str:
    return f"trim({text}, {_BLANKS})"


def _clean_sql() -> str:
    """T.cleaned for texts whose only compatibility characters are the ellipsis and the ordinal sign."""
    plain = "regexp_replace(replace(replace(text, '…', '...'), 'º', 'o'), '[\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}\\x{AD}]', '', 'g')"
    for sign, new in T.PLAIN_SIGNS:
        plain = f"replace({plain}, '{sign}', '{new.replace(chr(39), chr(39) * 2)}')"
    noise = "|".join(f"(?:{x})" for x in T.BOILERPLATE).replace("\\s+", _SPACES)
    marks = T.WIKI_MARKS
    collapsed = "array_to_string(lines, chr(10))"
    for sign in "!?,;":
        collapsed = f"regexp_replace({collapsed}, '[{sign}]{{3,}}', '{sign}', 'g')"
    return rf"""
        plain AS (SELECT doc_id, regexp_replace({plain}, '(?s)\A---[ \t\n\r\f\v]*\n.*?\n---[ \t\n\r\f\v]*\n', '') AS t FROM documents),
        every AS (SELECT doc_id, list_transform(regexp_split_to_array(t, '\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: {_trim_sql("x")}) AS lines FROM plain),
        kept AS (SELECT doc_id, list_transform(list_filter(lines, lambda x: NOT regexp_matches(x, '(?i){noise}') AND NOT regexp_matches(x, '^[|\s:]+-{{2,}}[|\s:-]*$|^-{{2,}}[|\s:-]*$|^\|[|\s]*$')),
                     lambda x: CASE WHEN contains(x, '[') THEN {_trim_sql(f"regexp_replace(x, '{marks}', '', 'g')")} ELSE x END) AS lines FROM every),
        cleaned AS (SELECT doc_id, {_trim_sql(f"regexp_replace({collapsed}, chr(10) || '{{3,}}', chr(10) || chr(10), 'g')")} AS text FROM kept)"""


def _chunks_sql(size: int, overlap: int) -> str:
    """T.chunks by two recursions: sentences to segments of a long paragraph, then segments to chunks."""

    def packed(name: str, rows: str, keys: str, glue: str) -> str:
        same = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
        ours = ", ".join(f"b.{k}" for k in keys.split(", "))
        return f"""
        {name} AS (
            SELECT {keys}, r, s, n, 1 AS place FROM {rows} WHERE r = 1
            UNION ALL
            SELECT {ours}, b.r, CASE WHEN a.n + b.n <= {size} THEN a.s || {glue} || b.s ELSE b.s END, CASE WHEN a.n + b.n <= {size} THEN a.n + b.n ELSE b.n END,
                   CASE WHEN a.n + b.n <= {size} THEN a.place ELSE a.place + 1 END
            FROM {name} a JOIN {rows} b ON {same} AND b.r = a.r + 1)"""

    last = "chunk" if overlap <= 0 else f"CASE WHEN last IS NULL THEN chunk ELSE array_to_string(({_words_sql('last')})[-{overlap}:], ' ') || chr(10) || chr(10) || chunk END"
    return rf"""WITH RECURSIVE
        split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10) || chr(10)) AS p FROM documents),
        paragraphs AS (SELECT doc_id, i, p, len({_words_sql("p")}) AS n FROM (SELECT doc_id, unnest(range(len(p))) AS i, {_trim_sql("unnest(p)")} AS p FROM split) WHERE p <> ''),
        cut AS (SELECT doc_id, i, string_split(regexp_replace(p, '([.!?]){_SPACES}([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM paragraphs WHERE n > {size}),
        sentences AS (SELECT doc_id, i, j, s, {_words_sql("s")} AS w FROM (SELECT doc_id, i, unnest(range(len(s))) AS j, unnest(s) AS s FROM cut)),
        parts AS (
            SELECT doc_id, i, j, 0 AS k, s, len(w) AS n FROM sentences WHERE len(w) BETWEEN 1 AND {size}
            UNION ALL SELECT doc_id, i, j, k, array_to_string(w[k + 1:k + {size}], ' '), {size} FROM (SELECT *, unnest(range(0, len(w), {size})) AS k FROM sentences WHERE len(w) > {size})),
        numbered AS (SELECT doc_id, i, s, n, row_number() OVER (PARTITION BY doc_id, i ORDER BY j, k) AS r FROM parts),
        {packed("sentence_pack", "numbered", "doc_id, i", "' '")},
        segments AS (
            SELECT doc_id, i, 0 AS place, p AS s, n FROM paragraphs WHERE n <= {size}
            UNION ALL SELECT doc_id, i, place, s, len({_words_sql("s")}) FROM (SELECT doc_id, i, place, arg_max(s, r) AS s FROM sentence_pack GROUP BY ALL)),
        ordered AS (SELECT doc_id, s, n, row_number() OVER (PARTITION BY doc_id ORDER BY i, place) AS r FROM segments),
        {packed("pack", "ordered", "doc_id", "chr(10) || chr(10)")},
        chunks AS (SELECT doc_id, place, arg_max(s, r) AS chunk FROM pack GROUP BY ALL),
        after AS (SELECT doc_id, place, chunk, lag(chunk) OVER (PARTITION BY doc_id ORDER BY place) AS last FROM chunks)
        SELECT doc_id, (place - 1)::INT AS place, {last} AS chunk FROM after"""


def _mmr_sql(k: int, trade: float) -> str:
    """Greedy choice, one step after the other."""
    steps = [f"chosen1 AS (SELECT query_id, row_id, e, 1 AS position FROM candidates QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {trade}::DOUBLE * relevance DESC, rank) = 1)"]
    for step in range(2, k + 1):
        steps.append(f"""
        valued{step} AS (SELECT c.query_id, c.row_id, any_value(c.e) AS e, any_value(c.rank) AS rank, {trade}::DOUBLE * any_value(relevance) - (1 - {trade}::DOUBLE) * max(list_cosine_similarity(c.e, s.e)) AS value
            FROM candidates c JOIN chosen{step - 1} s ON c.query_id = s.query_id WHERE (c.query_id, c.row_id) NOT IN (SELECT (query_id, row_id) FROM chosen{step - 1}) GROUP BY c.query_id, c.row_id),
        chosen{step} AS (SELECT * FROM chosen{step - 1} UNION ALL
            SELECT * FROM (SELECT query_id, row_id, e, {step} AS position FROM valued{step} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY value DESC, rank) = 1))""")
    return f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        near AS ({_knn_sql(k=20)}),
        candidates AS (SELECT n.query_id, n.row_id, n.rank, v.e, list_cosine_similarity(q.e, v.e) AS relevance FROM near n JOIN v ON v.vec_id = n.row_id JOIN v q ON q.vec_id = n.query_id),
        {",".join(steps)}
        SELECT query_id, row_id, position::INT AS position FROM chosen{k}"""


def _knn_sql(where: str = "", k: int = 10, least: str = "") -> str:
    return f"""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
        scored AS (SELECT a.vec_id AS query_id, b.vec_id AS row_id, round(list_cosine_similarity(a.e, b.e), 9) AS score
                   FROM v a, v b WHERE a.vec_id % 20 = 0 {where})
        SELECT query_id, row_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank
        FROM scored {least} QUALIFY rank <= {k}"""


# ---- inputs


def _crawls(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named columns of the last delivery of each crawl; only they are shuffled."""
    return latest(table(spark, sf_dir, "crawl_results").select("crawl_id", *columns, "loaded_at"), "crawl_id", heavy="html" in columns)


def _chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named columns of the last delivery of each chunk; only they are shuffled."""
    return latest(table(spark, sf_dir, "chunk_payloads").select("chunk_id", *columns, "loaded_at"), "chunk_id")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def _requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The URLs of the last delivery of each ingest request."""
    return latest(table(spark, sf_dir, "ingest_requests").select("request_id", "urls", "loaded_at"), "request_id").select(F.explode("urls").alias("url"))


def _title_queries(documents: DataFrame) -> DataFrame:
    return documents.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query"))


def _shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, for what a stream writes."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}_{uuid.uuid4().hex}"


def _arrivals(spark: SparkSession, rows: DataFrame, root: str, order: str = "loaded_at") -> DataFrame:
    """A table as a stream of files that arrive in ``order``, in at least three batches of equal files."""
    files = 4 * max(1, spark.sparkContext.defaultParallelism // 4)
    rows.repartitionByRange(files, order).write.parquet(f"{root}/arrivals")
    return jobs.folder(spark, f"{root}/arrivals", rows, files_a_batch=files // 4)


# ---- URLs and pages


@query(f"SELECT crawl_id, {_NORMAL} AS normal_url FROM {_LAST_CRAWL}")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crawls(spark, sf_dir, "url").select("crawl_id", U.normalize_url(F.col("url")).alias("normal_url"))


@query(f"SELECT crawl_id, sha256({_NORMAL}) AS url_key FROM {_LAST_CRAWL}")
def url_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crawls(spark, sf_dir, "url").select("crawl_id", U.url_key(F.col("url")).alias("url_key"))


@query(f"SELECT crawl_id, url FROM {_LAST_CRAWL} QUALIFY row_number() OVER (PARTITION BY {_NORMAL} ORDER BY crawl_id) = 1")
def url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.distinct_urls(_crawls(spark, sf_dir, "url"), order="crawl_id").select("crawl_id", "url")


@query("SELECT lower(regexp_extract(trim(url), '^[A-Za-z]+://([^/?#]*)', 1)) AS domain, count(DISTINCT id) AS n FROM crawl_state GROUP BY 1")
def url_domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "crawl_state").groupBy(U.domain(U.stripped(F.col("url"))).alias("domain")).agg(F.count_distinct("id").alias("n"))


@query(
    r"""SELECT id, regexp_matches(trim(url), '(?i)^https?://[^/?#]+') AS valid FROM crawl_state
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC) = 1"""
)
def url_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(table(spark, sf_dir, "crawl_state").select("id", "url", "loaded_at"), "id").select("id", U.is_valid_url(U.stripped(F.col("url"))).alias("valid"))


@query()
def html_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = _crawls(spark, sf_dir, "html").where("html <> ''").select("crawl_id", H.parsed(F.col("html")).alias("page"))
    return page.select("crawl_id", "page.title", "page.text", T.word_count(F.col("page.text")).alias("word_count"))



_LINKS = rf"""
    hrefs AS (SELECT crawl_id, final_url AS base, regexp_extract(final_url, '^[A-Za-z]+://[^/?#]*') AS origin, regexp_extract(lower(final_url), '^[a-z]+://([^/?#]*)', 1) AS host,
                     regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(?:script|style)[ >].*?(?:</(?:script|style)>|$)', '', 'g'), '(?is)<a\s(?:[^>]*\s)?href\s*=\s*["'']([^"'']*)["'']', 1) AS hrefs
              FROM {_LAST_CRAWL} WHERE html <> ''),
    found AS (SELECT crawl_id, origin, host, unnest(range(len(hrefs))) AS i, trim(replace(unnest(hrefs), '&amp;', '&')) AS href FROM hrefs),
    joined AS (SELECT crawl_id, host, i, regexp_replace(CASE WHEN href LIKE '/%' THEN origin || href ELSE href END, '#.*$', '') AS link FROM found
               WHERE href <> '' AND NOT regexp_matches(href, '^(#|mailto:|tel:|javascript:)')),
    links AS (SELECT crawl_id, link, min(i) AS i FROM joined WHERE regexp_extract(lower(link), '^[a-z]+://([^/?#]*)', 1) = host GROUP BY ALL)"""


@query(f"WITH {_LINKS} SELECT crawl_id, (row_number() OVER (PARTITION BY crawl_id ORDER BY i) - 1)::INT AS place, link FROM links")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.page_links(_crawls(spark, sf_dir, "html", "final_url").where("html <> ''").select(F.col("crawl_id").alias("url"), F.col("final_url").alias("base"), "html")).withColumnRenamed("url", "crawl_id")


@query(
    f"""WITH asked AS (SELECT request_id, unnest(urls) AS url FROM ingest_requests QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY loaded_at DESC) = 1),
        normal AS (SELECT {_NORMAL} AS url FROM asked),
        pages AS (SELECT final_url, status_code FROM {_LAST_CRAWL} QUALIFY row_number() OVER (PARTITION BY sha256({_NORMAL.replace("url", "final_url")}) ORDER BY crawl_id DESC) = 1)
        SELECT coalesce(p.status_code, -1) AS status, p.final_url IS NULL AS failed, count(*) AS n
        FROM normal n LEFT JOIN pages p ON p.final_url = n.url GROUP BY ALL"""
)
def crawl_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _requested(spark, sf_dir)
    # the count needs no html
    pages = _crawls(spark, sf_dir, "status_code", "final_url").withColumn("html", F.lit(None).cast("string")).withColumn("url_key", U.url_key(F.col("final_url")))
    got = crawl.crawl(asked, store.last_in_order(pages, "url_key", "crawl_id"))
    return got.groupBy(F.coalesce("status_code", F.lit(-1)).alias("status"), F.col("error").isNotNull().alias("failed")).agg(F.count("*").alias("n"))


_EDGES = f"""{_LINKS},
        named AS (SELECT crawl_id, url FROM (SELECT crawl_id, {_NORMAL.replace("url", "final_url")} AS url FROM {_LAST_CRAWL} WHERE html <> '') QUALIFY row_number() OVER (PARTITION BY url ORDER BY crawl_id DESC) = 1),
        placed AS (SELECT n.url AS page, l.link AS url, row_number() OVER (PARTITION BY crawl_id ORDER BY l.i) - 1 AS place FROM links l JOIN named n USING (crawl_id) QUALIFY place < 25),
        edges AS (SELECT page, {_NORMAL} AS target, min(place) AS place FROM placed GROUP BY ALL),
        asked AS (SELECT unnest(urls) AS url FROM ingest_requests QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY loaded_at DESC) = 1)"""


@query(
    f"""WITH RECURSIVE {_EDGES},
        walk AS (SELECT DISTINCT {_NORMAL} AS url, 0 AS level FROM asked WHERE url IS NOT NULL
                 UNION SELECT e.target, w.level + 1 FROM walk w JOIN edges e ON e.page = w.url WHERE w.level < 50),
        firsts AS (SELECT url, min(level) AS level FROM walk GROUP BY url)
        SELECT level, count(*) AS n FROM firsts GROUP BY level"""
)
def crawl_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages on each level of the walk from the requested URLs, until no level has a new page; URLs are compared normalised.

    Of a page the first LINKS_A_PAGE links are followed.
    """
    asked = _requested(spark, sf_dir).select(U.normalize_url(F.col("url")).alias("url"))
    return crawl.walk(asked, _site_links(spark, sf_dir), depth=None, budget=None).groupBy("level").agg(F.count("*").alias("n"))


def _site_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url, place, link) of the last crawl of each page, URLs normalised; parsed once."""
    pages = store.last_in_order(_crawls(spark, sf_dir, "html", "final_url").where("html <> ''").withColumn("url", U.normalize_url(F.col("final_url"))), "url", "crawl_id")
    links = crawl.page_links(pages.select("url", F.col("final_url").alias("base"), "html"), most=crawl.LINKS_A_PAGE)
    ensure_checkpoint_dir(spark)
    return links.withColumn("link", U.normalize_url(F.col("link"))).checkpoint()


@query(
    f"""SELECT crawl_id, status_code IN (403, 406, 429) OR status_code = 0 OR status_code IS NULL
               OR length(coalesce(html, '')) BETWEEN 1 AND 499 AS again FROM {_LAST_CRAWL}"""
)
def crawl_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _crawls(spark, sf_dir, "status_code", "html").select("crawl_id", crawl.needs_browser(F.col("status_code"), F.col("html")).alias("again"))


@query(
    f"""WITH {_EDGES},
        seeds AS (SELECT DISTINCT {_NORMAL} AS url FROM asked WHERE url IS NOT NULL),
        level0 AS (SELECT url, row_number() OVER (ORDER BY url) - 1 AS place FROM seeds QUALIFY place < 400),
        met AS (SELECT e.target AS url, min((s.place, e.place)) AS met_at FROM level0 s JOIN edges e ON e.page = s.url WHERE e.target NOT IN (SELECT url FROM seeds) GROUP BY e.target),
        level1 AS (SELECT url, row_number() OVER (ORDER BY met_at, url) - 1 AS place FROM met QUALIFY place < 400 - (SELECT count(*) FROM level0))
        SELECT url, 0 AS level, place FROM level0 UNION ALL SELECT url, 1, place FROM level1"""
)
def crawl_budgeted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One level below the requested URLs within a budget of 400 pages, which is the feature."""
    asked = _requested(spark, sf_dir).select(U.normalize_url(F.col("url")).alias("url"))
    return crawl.walk(asked, _site_links(spark, sf_dir), depth=1, budget=400)


@query(
    rf"""WITH pages AS (SELECT crawl_id, {_NORMAL.replace("url", "final_url")} AS url FROM {_LAST_CRAWL} WHERE final_url IS NOT NULL),
        parsed AS (SELECT crawl_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*(/[^/?#]*)', 1) AS start FROM pages),
        rules AS (SELECT host, min(start) AS closed FROM parsed WHERE start <> '/' GROUP BY host),
        kept AS (SELECT url FROM pages QUALIFY row_number() OVER (PARTITION BY url ORDER BY crawl_id) = 1)
        SELECT url, CASE WHEN starts_with(regexp_extract(url, '^[a-z]+://[^/?#]*(/.*)$', 1), closed) THEN 'blocked by robots.txt' END AS error
        FROM kept JOIN parsed USING (url) LEFT JOIN rules USING (host) GROUP BY ALL"""
)
def crawl_robots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetching of all known pages where every site closes one path, its first by name, to robots."""
    pages = _crawls(spark, sf_dir, "final_url", "status_code").where("final_url is not null").withColumn("html", F.lit(None).cast("string")).withColumn("url", U.normalize_url(F.col("final_url")))
    start = F.regexp_extract("url", r"^[a-z]+://[^/?#]*(/[^/?#]*)", 1)
    closed = pages.select(U.domain(F.col("url")).alias("netloc"), start.alias("start")).where("start <> '/'").groupBy("netloc").agg(F.min("start").alias("start"))
    robots = closed.select("netloc", F.concat(F.lit("User-agent: *\nDisallow: "), "start").alias("robots"))
    known = store.last_in_order(pages.withColumn("url_key", U.url_key(F.col("final_url"))), "url_key", "crawl_id")
    return crawl.crawl(pages.select("url").distinct(), known, robots).select("url", "error")


# ---- texts


@query("SELECT doc_id, sha256(lower(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(160)))) AS text_hash, sha1(text)[1:16] AS fp FROM documents")
def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", T.text_hash(F.col("text")).alias("text_hash"), T.fingerprint(F.col("text")).alias("fp"))


@query(
    f"""WITH digests AS (SELECT chunk_id, sha1(unhex('{T.POINT_NAMESPACE}') || encode(url || ':' || chunk_index)) AS d FROM {_LAST_CHUNK})
        SELECT chunk_id, d[1:8] || '-' || d[9:12] || '-5' || d[14:16] || '-' ||
               substr('89ab', ('0x' || d[17])::INT % 4 + 1, 1) || d[18:20] || '-' || d[21:32] AS point_id FROM digests"""
)
def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir, "url", "chunk_index").select("chunk_id", T.point_id(F.col("url"), F.col("chunk_index")).alias("point_id"))


@query(f"WITH {_clean_sql()} SELECT doc_id, text FROM cleaned")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", T.cleaned(F.col("text")).alias("text"))


@query(
    f"""SELECT doc_id, len({_WORDS}) AS n_words, floor(len({_WORDS}) * 1.3)::INT AS n_tokens,
               CASE WHEN len({_WORDS}) <= 50 THEN text ELSE array_to_string(({_WORDS})[1:50], ' ') END AS head FROM documents"""
)
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _documents(spark, sf_dir).select("doc_id", T.word_count(text).alias("n_words"), T.estimated_tokens(text).alias("n_tokens"), T.truncated(text, 50).alias("head"))


@query(
    rf"""WITH parts AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?]){_SPACES}([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM documents)
        SELECT doc_id, unnest(range(len(s)))::INT AS place, unnest(s) AS sentence FROM parts"""
)
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("place", "sentence"))


@query(
    f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        starts AS (SELECT doc_id, w, unnest(range(0, len(w), 64)) AS i FROM w)
        SELECT doc_id, (i // 64)::INT AS place, array_to_string(w[i + 1:i + 64], ' ') AS chunk FROM starts"""
)
def chunk_fixed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(T.fixed_windows(F.col("text"), 64)).alias("place", "chunk"))


@query(_chunks_sql(64, 0))
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(T.chunks(F.col("text"), 64, 0)).alias("place", "chunk"))


@query(_chunks_sql(128, 16))
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.posexplode(T.chunks(F.col("text"), 128, 16)).alias("place", "chunk"))


# ---- sparse retrieval


@query(f"SELECT doc_id, len({_TOKENS}) AS n, array_to_string({_TOKENS}, ' ') AS tokens FROM documents")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.size(T.tokens(F.col("text"))).alias("n"), F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


@query(f"WITH {_POSTINGS} SELECT * FROM postings")
def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.postings(_documents(spark, sf_dir))


@query(f"WITH {_POSTINGS} SELECT term_id, df, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)), 9) AS idf FROM counts, stats")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    posted = sparse.postings(_documents(spark, sf_dir))
    counted = sparse.term_counts(posted).crossJoin(F.broadcast(sparse.collection_stats(posted)))
    return counted.select("term_id", "df", F.round(sparse.idf(F.col("n_docs"), F.col("df")), 9).alias("idf"))


@query(f"WITH {_POSTINGS} SELECT n_docs, round(avgdl, 9) AS avgdl FROM stats")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each language and of documents without one, merged as if they came in batches."""
    documents = _documents(spark, sf_dir)
    english = sparse.collection_stats(sparse.postings(documents.where("lower(lang) = 'en'")))
    rest = sparse.collection_stats(sparse.postings(documents.where("lang is null or lower(lang) <> 'en'")))
    return sparse.merged_stats(english, rest).select("n_docs", F.round("avgdl", 9).alias("avgdl"))


@query(f"WITH {_POSTINGS} SELECT term_id, df FROM counts")
def merged_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document counts of two disjoint batches together."""
    documents = _documents(spark, sf_dir)
    english, rest = documents.where("lower(lang) = 'en'"), documents.where("lang is null or lower(lang) <> 'en'")
    return sparse.merged_counts(sparse.term_counts(sparse.postings(english)), sparse.term_counts(sparse.postings(rest)))


@query(f"WITH {_POSTINGS},{_DOC_WEIGHTS} SELECT doc_id, term_id, tf, dl, round(weight, 9) AS weight FROM weighted WHERE weight > 0")
def bm25_doc_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    posted = sparse.postings(_documents(spark, sf_dir))
    return sparse.document_weights(posted, sparse.term_counts(posted), sparse.collection_stats(posted)).withColumn("weight", F.round("weight", 9))


@query(f"WITH {_POSTINGS},{_TITLE_QUERIES},{_QUERY_WEIGHTS} SELECT query_id, term_id, round(weight, 9) AS weight FROM query_weights WHERE weight > 0")
def bm25_query_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    posted = sparse.postings(documents)
    return sparse.query_weights(_title_queries(documents), sparse.term_counts(posted), sparse.collection_stats(posted)).withColumn("weight", F.round("weight", 9))


@query(f"WITH {_BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm25")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    return sparse.search(_title_queries(documents), documents).withColumn("score", F.round("score", 6))


def _stored_sparse(chunks: DataFrame) -> DataFrame:
    pairs = F.arrays_zip(F.col("sparse_indices").alias("i"), F.col("sparse_values").alias("v"))
    return chunks.select("chunk_id", "collection", F.explode(pairs).alias("p")).select("chunk_id", "collection", F.col("p.i").alias("term_id"), F.col("p.v").alias("weight"))


_SPARSE_TERMS = f"terms AS (SELECT chunk_id, collection, unnest(sparse_indices) AS term_id, unnest(sparse_values) AS weight FROM {_LAST_CHUNK})"
_SPARSE_LIST = f"""{_SPARSE_TERMS},
    products AS (SELECT q.chunk_id AS query_id, d.chunk_id AS row_id, round(sum(q.weight * d.weight), 9) AS score
                 FROM terms q JOIN terms d USING (term_id, collection) WHERE q.chunk_id % 20 = 0 GROUP BY ALL),
    sparse_list AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM products QUALIFY rank <= 10)"""


def _sparse_list(chunks: DataFrame) -> DataFrame:
    stored = _stored_sparse(chunks)
    asked = stored.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    scored = sparse.dot_products(asked, stored.withColumnRenamed("chunk_id", "row_id"), ["term_id", "collection"], key="row_id").withColumn("score", F.round("score", 9))
    return sparse.top_k(scored, 10, key="row_id")


@query(f"WITH {_SPARSE_LIST} SELECT query_id, row_id, round(score, 6) AS score, rank FROM sparse_list")
def sparse_dot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sparse_list(_chunks(spark, sf_dir, "collection", "sparse_indices", "sparse_values")).withColumn("score", F.round("score", 6))


# ---- dense retrieval


def _knn(spark: SparkSession, sf_dir: str, k: int = 10, by: list[str] | None = None, least: float | None = None) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"), "label")
    asked = rows.where("row_id % 20 = 0").withColumnRenamed("row_id", "query_id")
    return dense.search(asked, rows, k, by, least).withColumn("score", F.round("score", 6))


@query(_knn_sql())
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir)


@query(_knn_sql(k=50, least="WHERE score >= 0.2"))
def knn_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, 50, least=0.2)


@query(_knn_sql("AND a.label = b.label"))
def knn_filter_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, by=["label"])


_DENSE_LIST = f"""
    v AS (SELECT chunk_id, collection, embedding::DOUBLE[] AS e FROM {_LAST_CHUNK}
          WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0),
    cosines AS (SELECT a.chunk_id AS query_id, b.chunk_id AS row_id,
                       round(CASE WHEN list_dot_product(a.e, a.e) = 0 OR list_dot_product(b.e, b.e) = 0 THEN 0
                             ELSE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) END, 9) AS score
                FROM v a JOIN v b ON a.collection = b.collection AND len(a.e) = len(b.e) WHERE a.chunk_id % 20 = 0),
    dense_list AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM cosines QUALIFY rank <= 10)"""


def _dense_list(chunks: DataFrame) -> DataFrame:
    rows = chunks.select(F.col("chunk_id").alias("row_id"), F.col("embedding").alias("vector"), "collection")
    return dense.search(rows.where("row_id % 20 = 0").withColumnRenamed("row_id", "query_id"), rows, 10, ["collection"])


@query(f"WITH {_DENSE_LIST} SELECT query_id, row_id, round(score, 6) AS score, rank FROM dense_list")
def knn_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense_list(_chunks(spark, sf_dir, "collection", "embedding")).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_DENSE_LIST},{_SPARSE_LIST},
        lists AS (SELECT query_id, row_id, rank, 0 AS list_id, 1.0::DOUBLE AS weight FROM dense_list
                  UNION ALL SELECT query_id, row_id, rank, 1, 0.7::DOUBLE FROM sparse_list),
        fused AS (SELECT query_id, row_id, sum(weight / (60 + rank) ORDER BY list_id) AS score, min(list_id * 1000 + rank) AS first FROM lists GROUP BY ALL)
        SELECT query_id, row_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, row_id) AS rank
        FROM fused QUALIFY rank <= 10"""
)
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir, "collection", "embedding", "sparse_indices", "sparse_values")
    near = _dense_list(chunks).select("query_id", "row_id", "rank", F.lit(0).alias("list_id"), F.lit(fusion.FIRST_WEIGHT).alias("weight"))
    terms = _sparse_list(chunks).select("query_id", "row_id", "rank", F.lit(1).alias("list_id"), F.lit(fusion.SPARSE_WEIGHT).alias("weight"))
    return fusion.reciprocal_rank_fusion(near.unionByName(terms)).where("rank <= 10").withColumn("score", F.round("score", 9))


@query(_mmr_sql(5, 0.7))
def mmr_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))
    near = _knn(spark, sf_dir, 20).join(vectors, "row_id").join(vectors.select(F.col("row_id").alias("query_id"), F.col("vector").alias("query_vector")), "query_id")
    return fusion.maximal_marginal_relevance(near, 5, 0.7)


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
        SELECT a.vec_id AS one, b.vec_id AS two, round(list_cosine_similarity(a.e, b.e), 9) AS cosine FROM v a JOIN v b ON b.vec_id = a.vec_id + 1"""
)
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the one that follows it."""
    v = table(spark, sf_dir, "embeddings")
    two = v.select(F.col("vec_id").alias("two"), F.col("embedding").alias("other"), (F.col("vec_id") - 1).alias("one"))
    return v.select(F.col("vec_id").alias("one"), "embedding").join(two, "one").select("one", "two", F.round(dense.cosine(F.col("embedding"), F.col("other")), 9).alias("cosine"))


# ---- reranking and answers


_RERANKED = f"""{_BM25},
    pairs AS (SELECT b.query_id, b.doc_id, b.rank, b.score, d.url, d.title, d.text AS body, q.text FROM bm25 b JOIN documents d USING (doc_id) JOIN queries q USING (query_id)),
    asked AS (SELECT *, list_distinct({_TOKENS}) AS a FROM pairs),
    body AS (SELECT query_id, doc_id, rank, score, url, title, a, {_TOKENS} AS b FROM (SELECT * EXCLUDE (text), body AS text FROM asked)),
    rescored AS (SELECT query_id, doc_id, rank, score, url, title,
                        CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(a) END AS rerank_score FROM body),
    reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS position FROM rescored QUALIFY position <= 5)"""


def _reranked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    # both results are bounded lists for each query, and used several times
    documents = _documents(spark, sf_dir)
    asked = _title_queries(documents)
    found = sparse.search(asked, documents).checkpoint()
    # texts are scored where they are read: no answer here shows them
    best = rerank.rerank_where_read(found, asked, documents.select("doc_id", "url", "title", "text"), 5)
    return asked, found, best.withColumn("text", F.lit(None).cast("string"))


@query(f"WITH {_RERANKED} SELECT query_id, doc_id, position, round(rerank_score, 6) AS rerank_score FROM reranked WHERE rerank_score >= 0.8")
def rerank_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = rerank.gate(_reranked(spark, sf_dir)[2], 0.8)
    return kept.select("query_id", "doc_id", "position", F.round("rerank_score", 6).alias("rerank_score"))


@query(
    f"""WITH {_RERANKED},
        tops AS (SELECT query_id, max(rerank_score) AS top, count(*) FILTER (rerank_score >= 0.8) AS kept FROM reranked GROUP BY query_id)
        SELECT q.query_id, coalesce(kept, 0) = 0 AS refused, coalesce(kept, 0) AS total_reranked, round(top, 6) AS top_relevance,
               (SELECT count(*) FROM bm25 b WHERE b.query_id = q.query_id) AS total_retrieved
        FROM queries q LEFT JOIN tops t USING (query_id)"""
)
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, found, best = _reranked(spark, sf_dir)
    answers = rerank.responses(asked, best, rerank.gate(best, 0.8), found, 0.8)
    return answers.select("query_id", "refused", "total_reranked", F.round("top_relevance", 6).alias("top_relevance"), "total_retrieved")


@query(
    f"""WITH {_RERANKED},
        tops AS (SELECT query_id, max(rerank_score) AS top, count(*) FILTER (rerank_score >= 0.8) AS kept FROM reranked GROUP BY query_id)
        SELECT q.query_id, CASE WHEN kept > 0 THEN NULL
               WHEN NOT EXISTS (SELECT 1 FROM bm25 b WHERE b.query_id = q.query_id) THEN 'no_candidates: the collection returned no results for this query (empty collection, or filters excluded everything)'
               ELSE printf('below_threshold: top rerank score %s is under the min_relevance gate of 0.800 — the corpus does not contain sufficiently relevant information to answer this query',
                           CASE WHEN top IS NULL THEN 'n/a' ELSE printf('%.3f', top) END) END AS refusal_reason
        FROM queries q LEFT JOIN tops t USING (query_id)"""
)
def refusal_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, found, best = _reranked(spark, sf_dir)
    return rerank.responses(asked, best, rerank.gate(best, 0.8), found, 0.8).select("query_id", "refusal_reason")


@query(
    f"""WITH {_RERANKED}
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY position) AS index, coalesce(nullif(url, ''), 'unknown') AS source, title,
               round(rerank_score, 4) AS relevance FROM reranked WHERE rerank_score >= 0.8"""
)
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, found, best = _reranked(spark, sf_dir)
    answers = rerank.responses(asked, best, rerank.gate(best, 0.8), found, 0.8)
    return answers.select("query_id", F.explode("citations").alias("c")).select("query_id", "c.*")


@query()
def retrieve_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    embedder = embed.hashed()
    points = documents.select(F.col("doc_id").alias("row_id"), "url", "title", "text", embedder(F.col("text")).alias("embedding"))
    return retrieve.retrieve(_title_queries(documents), points, embedder, Settings(top_k=10, rerank_top_k=3, use_mmr=True))


# ---- expansion


def _list_sql(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


_SYNONYM_SQL = "list_filter([" + ", ".join(
    f"CASE WHEN contains(lower(q), '{term}') THEN replace(lower(q), '{term}', '{new}') END" for term, news in expand.SYNONYMS.items() for new in news[:2]
) + "], lambda x: x IS NOT NULL AND x <> lower(q))"
_LEAD_SQL = expand.LEADS


@query(
    rf"""WITH asked AS (SELECT doc_id, title AS q, CASE WHEN regexp_matches(title, '{_LEAD_SQL}') AND trim(regexp_replace(title, '{_LEAD_SQL}', '')) <> ''
                              THEN trim(regexp_replace(title, '{_LEAD_SQL}', '')) END AS d FROM documents WHERE title IS NOT NULL),
        every AS (SELECT doc_id, [q] || CASE WHEN d IS NULL THEN [] ELSE [d] END || {_SYNONYM_SQL}
                  || list_transform({_list_sql(expand.QUALIFIERS)}, lambda x: coalesce(d, q) || ' ' || x) AS v FROM asked),
        firsts AS (SELECT doc_id, list_filter(v, lambda x, i: list_position(v, x) = i) AS v FROM every)
        SELECT doc_id, unnest(range(len(v[1:5])))::INT AS place, unnest(v[1:5]) AS variant FROM firsts"""
)
def expand_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    titled = _documents(spark, sf_dir).where("title is not null")
    return titled.select("doc_id", F.posexplode(expand.keyword_variants(F.col("title"), 5)).alias("place", "variant"))


def _answers_sql() -> str:
    """The first hypothetical answers for the topic t, and the topic of the query q."""
    texts = []
    for template in expand.ANSWERS:
        said = "'" + template.replace("'", "''") + "'"
        texts.append(f"replace(replace({said}, '{{topic}}', t), '{{topic_lower}}', lower(t))")
    return "[" + ", ".join(texts) + "]"


_BARE_SQL = r"trim(regexp_replace({}, '[?!.\s]+$', ''))"


@query(
    rf"""WITH asked AS (SELECT doc_id, title AS q, CASE WHEN regexp_matches(title, '{_LEAD_SQL}') AND trim(regexp_replace(title, '{_LEAD_SQL}', '')) <> ''
                              THEN trim(regexp_replace(title, '{_LEAD_SQL}', '')) END AS d,
                              regexp_replace(trim(regexp_replace({_BARE_SQL.format("title")}, '{expand.TOPIC_LEADS}', '')), '\s+', ' ', 'g') AS t0 FROM documents WHERE title IS NOT NULL),
        topics AS (SELECT doc_id, q, d, CASE WHEN t0 = '' THEN trim(q) ELSE t0 END AS t1 FROM asked),
        topic AS (SELECT doc_id, q, d, CASE WHEN {_BARE_SQL.format("t1")} = '' THEN trim(q) ELSE {_BARE_SQL.format("t1")} END AS t FROM topics),
        heads AS (SELECT doc_id, q, CASE WHEN d IS NULL THEN [q] ELSE [q, d] END AS head, {_answers_sql()} AS answers FROM topic),
        every AS (SELECT doc_id, head || answers[1:greatest(4 - len(list_distinct(head)), 0)] || {_SYNONYM_SQL} AS v FROM heads),
        firsts AS (SELECT doc_id, list_filter(v, lambda x, i: list_position(v, x) = i) AS v FROM every)
        SELECT doc_id, unnest(range(len(v[1:4])))::INT AS place, unnest(v[1:4]) AS variant FROM firsts"""
)
def expand_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    titled = _documents(spark, sf_dir).where("title is not null")
    return titled.select("doc_id", F.posexplode(expand.retrieval_variants(F.col("title"), 4)).alias("place", "variant"))


@query(
    rf"""WITH asked AS (SELECT doc_id, title AS q, regexp_replace(trim(regexp_replace({_BARE_SQL.format("title")}, '{expand.TOPIC_LEADS}', '')), '\s+', ' ', 'g') AS t0 FROM documents WHERE title IS NOT NULL),
        topics AS (SELECT doc_id, q, CASE WHEN t0 = '' THEN trim(q) ELSE t0 END AS t1 FROM asked),
        topic AS (SELECT doc_id, CASE WHEN {_BARE_SQL.format("t1")} = '' THEN trim(q) ELSE {_BARE_SQL.format("t1")} END AS t FROM topics)
        SELECT doc_id, unnest(range(4))::INT AS place, unnest({_answers_sql()}) AS answer FROM topic"""
)
def expand_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    titled = _documents(spark, sf_dir).where("title is not null")
    return titled.select("doc_id", F.posexplode(expand.hypothetical_answers(F.col("title"))).alias("place", "answer"))


# ---- collections, states and caches


@query(
    """WITH fresh AS (SELECT * FROM chunk_payloads WHERE ingest_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY loaded_at DESC) = 1),
        kept AS (SELECT * FROM chunk_payloads WHERE ingest_id IS NULL AND (point_id IS NULL OR point_id NOT IN (SELECT point_id FROM fresh WHERE point_id IS NOT NULL)))
        SELECT collection, count(*) AS n, count(DISTINCT point_id) AS n_points FROM (SELECT collection, point_id FROM fresh UNION ALL SELECT collection, point_id FROM kept) GROUP BY collection"""
)
def upsert_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunk_payloads").select("chunk_id", "point_id", "collection", "url", "ingest_id", "loaded_at")
    merged = store.upsert(chunks.where("ingest_id is null"), chunks.where("ingest_id is not null"), "point_id", "loaded_at")
    return merged.groupBy("collection").agg(F.count("*").alias("n"), F.count_distinct("point_id").alias("n_points"))


@query(
    f"""WITH fresh AS (SELECT c.* FROM {_LAST_CHUNK} c JOIN (SELECT DISTINCT request_id FROM ingest_requests WHERE replace_old) r ON c.ingest_id = r.request_id),
        old AS (SELECT * FROM {_LAST_CHUNK} WHERE url IS NULL OR url NOT IN (SELECT url FROM fresh WHERE url IS NOT NULL)),
        points AS (SELECT chunk_id, url FROM fresh UNION ALL SELECT chunk_id, url FROM old)
        SELECT url, count(*) AS n FROM points GROUP BY url"""
)
def replace_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir, "url", "ingest_id").select("chunk_id", "url", "ingest_id", "loaded_at")
    replacing = table(spark, sf_dir, "ingest_requests").where("replace_old").select(F.col("request_id").alias("ingest_id"))
    points = store.replace_by_url(chunks, chunks.join(replacing, "ingest_id", "left_semi"), "loaded_at", key="chunk_id")
    return points.groupBy("url").agg(F.count("*").alias("n"))


@query(
    f"""SELECT chunk_id, url FROM {_LAST_CHUNK}
        WHERE url IS NULL OR url NOT IN (SELECT url FROM crawl_state WHERE status = 'failed' AND url IS NOT NULL)"""
)
def delete_by_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = table(spark, sf_dir, "crawl_state").where("status = 'failed'").select("url")
    return store.delete_by(_chunks(spark, sf_dir, "url").select("chunk_id", "url"), failed, "url")


@query(
    f"""SELECT chunk_id FROM {_LAST_CHUNK} WHERE collection = 'handbook' AND language = 'en' AND chunk_index = 0"""
)
def payload_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir, "collection", "chunk_index", "language").select("chunk_id", "collection", "chunk_index", F.create_map(F.lit("language"), "language").alias("extra"))
    return store.payload_filter(chunks, {"collection": "handbook", "language": "en", "chunk_index": 0}).select("chunk_id")


_CRAWL_STATE = """
    SELECT url_hash, arg_min(url, (updated_at, url)) AS url, arg_max(status, (updated_at, status)) AS status,
           max(CASE WHEN latest THEN http_status END) AS http_status, max(CASE WHEN latest THEN error END) AS error,
           max(CASE WHEN latest AND status IN ('crawled', 'failed') THEN epoch_us(updated_at) END) AS crawled_us
    FROM (SELECT *, row_number() OVER (PARTITION BY url_hash ORDER BY updated_at DESC, status DESC) = 1 AS latest FROM crawl_state WHERE url_hash IS NOT NULL)
    GROUP BY url_hash"""


def _state_columns(state: DataFrame) -> DataFrame:
    return state.select("url_hash", "url", "status", "http_status", "error", F.unix_micros(F.col("crawled_at").cast("timestamp")).alias("crawled_us"))


@query(_CRAWL_STATE)
def crawl_state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state_columns(store.crawl_state(table(spark, sf_dir, "crawl_state")))


@query(_CRAWL_STATE)
def streaming_crawl_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream of files, a few a batch; arrivals and state lie in the shared folder."""
    columns = ["url_hash", "url", "status", "http_status", "error", "updated_at"]
    root = _shared_folder(spark, "crawl_state")
    stream = _arrivals(spark, table(spark, sf_dir, "crawl_state").select(*columns, "loaded_at"), root)

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        every = new.select(*columns) if old is None else old.unionByName(new.select(*columns))
        # per URL the first and the last change are all that the state needs
        ends = every.where("url_hash is not null").groupBy("url_hash").agg(
            F.min_by(F.struct(*columns[1:]), F.struct("updated_at", "url")).alias("first"), F.max_by(F.struct(*columns[1:]), F.struct("updated_at", "status")).alias("last")
        )
        return ends.select("url_hash", F.explode(F.array_distinct(F.array("first", "last"))).alias("row")).select("url_hash", "row.*")

    jobs.keep_state(stream, f"{root}/state", f"{root}/progress", merge).awaitTermination()
    return _state_columns(store.crawl_state(jobs.current(spark, f"{root}/state")))


@query(
    """SELECT user_id AS job_id, arg_min(event_type, ts) AS job_type, arg_max(event_type, (ts, event_type)) AS status, count(*) AS n FROM events GROUP BY user_id"""
)
def job_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), F.col("event_type").alias("job_type"), F.col("event_type").alias("status"), F.col("props").alias("result"), F.lit(None).cast("string").alias("error"), F.col("ts").alias("at")
    )
    return store.job_state(log).select("job_id", "job_type", "status").join(log.groupBy("job_id").agg(F.count("*").alias("n")), "job_id")


@query(
    """WITH writes AS (SELECT user_id AS key, ts AS written_at, event_id, value,
                              ts + to_microseconds(CASE WHEN event_id % 3 = 0 THEN 3600 ELSE 86400 END::BIGINT * 1000000) AS expires_at FROM events WHERE event_type <> 'view'),
        reads AS (SELECT event_id AS read_id, user_id AS key, ts AS read_at FROM events WHERE event_type = 'view')
        SELECT read_id, r.key, coalesce(w.expires_at > r.read_at, false) AS hit, CASE WHEN w.expires_at > r.read_at THEN w.value END AS value
        FROM reads r ASOF LEFT JOIN writes w ON r.key = w.key AND r.read_at >= w.written_at"""
)
def cache_ttl_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    entries = events.where("event_type <> 'view'").select(
        F.col("user_id").alias("key"), "value", F.col("ts").alias("written_at"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(86400).alias("ttl")
    )
    reads = events.where("event_type = 'view'").select(F.col("event_id").alias("read_id"), F.col("user_id").alias("key"), F.col("ts").alias("read_at"))
    return store.cache_lookup(reads, store.written(entries))


@query(
    """WITH keyed AS (SELECT *, 'user ' || user_id AS query, sha256('user ' || user_id || ':10:a,b:1') AS key FROM events),
        writes AS (SELECT key, ts AS written_at, value::VARCHAR AS value, ts + to_microseconds(3600000000) AS expires_at FROM keyed WHERE event_type = 'click'),
        reads AS (SELECT event_id AS read_id, key, query, ts AS read_at FROM keyed WHERE event_type = 'view')
        SELECT read_id, coalesce(w.expires_at > r.read_at, false) AS cached, CASE WHEN w.expires_at > r.read_at THEN 'kept' ELSE 'found ' || query END AS value
        FROM reads r ASOF LEFT JOIN writes w ON r.key = w.key AND r.read_at >= w.written_at"""
)
def cached_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches answered from stored answers where they have not expired; the others are searched once for each key."""
    events = table(spark, sf_dir, "events").withColumn("query", F.concat(F.lit("user "), F.col("user_id").cast("string")))
    key = services.search_key(F.col("query"), F.lit(10), F.array(F.lit("b"), F.lit("a")), F.lit(1))
    entries = store.written(events.where("event_type = 'click'").select(key.alias("key"), F.lit("kept").alias("value"), F.col("ts").alias("written_at"), F.lit(0).alias("ttl")))
    reads = events.where("event_type = 'view'").select(
        F.col("event_id").alias("read_id"), "query", F.lit(10).alias("n"), F.array(F.lit("a"), F.lit("b")).alias("engines"), F.lit(1).alias("safe"), F.col("ts").alias("read_at")
    )
    found = services.cached_search(reads, entries, lambda missing: missing.select("key", F.concat(F.lit("found "), "query").alias("value")))
    return found.select("read_id", "cached", "value")


@query(f"SELECT DISTINCT sha256({_NORMAL}) AS url_key FROM crawl_results WHERE url IS NOT NULL")
def streaming_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by their first sight in a stream of crawls; the watermark outlasts the table."""
    root = _shared_folder(spark, "first_seen")
    stream = _arrivals(spark, table(spark, sf_dir, "crawl_results").select("url", "loaded_at").where("url is not null"), root)
    seen = jobs.first_seen(stream, "loaded_at", within="3650 days").select("url_key")
    seen.writeStream.format("parquet").option("path", f"{root}/seen").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("url_key string").parquet(f"{root}/seen")


@query(
    """WITH known AS (SELECT DISTINCT text FROM documents WHERE lower(trim(source)) = 'docs')
        SELECT d.text IN (SELECT text FROM known) AS was_cached, count(*) AS n, count(DISTINCT d.text) AS n_texts FROM documents d WHERE d.text IS NOT NULL GROUP BY 1"""
)
def embedding_cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir).where("text is not null")
    embedder = embed.hashed()
    cache = documents.where("lower(trim(source)) = 'docs'").select(embed.cache_key(F.col("text"), "hashed").alias("text_key"), embedder(F.col("text")).alias("vector"))
    done = embed.embedded(documents, cache, embedder)
    return done.groupBy("was_cached").agg(F.count("*").alias("n"), F.count_distinct("text").alias("n_texts"))


@query(
    """WITH services AS (SELECT netloc AS service, bool_or(status = 'crawled') AS up FROM crawl_state GROUP BY netloc)
        SELECT CASE WHEN count(*) FILTER (up) = count(*) THEN 'healthy' WHEN count(*) FILTER (up) = 0 THEN 'unhealthy' ELSE 'degraded' END AS status,
               count(*) FILTER (up) AS n_up, count(*) - count(*) FILTER (up) AS n_down FROM services"""
)
def health_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = table(spark, sf_dir, "crawl_state")
    return store.health(state.groupBy(F.col("netloc").alias("service")).agg(F.bool_or(F.col("status") == "crawled").alias("up")))


# ---- plans


@query()
def ingest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _crawls(spark, sf_dir, "final_url", "status_code", "html").select(F.col("crawl_id").alias("page_id"), F.col("final_url").alias("url"), "status_code", "html")
    return ingest_plan.ingest(None, pages, embed.hashed()).drop("embedding")


@query()
def streaming_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of ingest_points, from a stream of the pages in several batches; see the tests for their equality."""
    pages = _crawls(spark, sf_dir, "final_url", "status_code", "html").select(F.col("crawl_id").alias("page_id"), F.col("final_url").alias("url"), "status_code", "html")
    root = _shared_folder(spark, "ingest")
    jobs.keep_ingested(_arrivals(spark, pages, root, "page_id"), f"{root}/state", f"{root}/progress", embed.hashed()).awaitTermination()
    return jobs.current(spark, f"{root}/state").drop("embedding")


@query()
def search_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of the pages that the requested URLs lead to."""
    pages = store.last_in_order(_crawls(spark, sf_dir, "final_url", "status_code", "html").withColumn("url_key", U.url_key(F.col("final_url"))), "url_key", "crawl_id")
    return services.search_and_ingest(_requested(spark, sf_dir), pages, None, embed.hashed()).drop("embedding")


@query()
def extract_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = store.last_in_order(_crawls(spark, sf_dir, "final_url", "status_code", "html").withColumn("url_key", U.url_key(F.col("final_url"))), "url_key", "crawl_id")
    asked = table(spark, sf_dir, "extract_requests").select("request_id", "html", "url", "loaded_at")
    return services.extract(latest(asked, "request_id", heavy=True), pages)


@query(
    f"""WITH pieces AS (SELECT url, chunk_index, chunk_id, text, len({_WORDS}) AS n FROM {_LAST_CHUNK} WHERE text IS NOT NULL)
        SELECT url, sum(n)::BIGINT AS word_count, count(*) AS n_chunks, sha256(string_agg(text, chr(10) || chr(10) ORDER BY chunk_index, chunk_id)) AS text_hash
        FROM pieces GROUP BY url"""
)
def rejoined_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of each URL joined again in order, and the sum of their words.

    The digest needs the whole text in order, but no task holds it: the rows of
    a URL are sorted, on disk if need be, and hashed as they pass.
    """
    pieces = _chunks(spark, sf_dir, "url", "chunk_index", "text").where("text is not null").withColumn("n", T.word_count(F.col("text")))
    in_order = pieces.repartition("url").sortWithinPartitions(F.col("url").asc_nulls_first(), F.col("chunk_index").asc_nulls_last(), "chunk_id")
    return in_order.select("url", "n", "text").mapInArrow(_digests, "url string, word_count bigint, n_chunks bigint, text_hash string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of equal urls: sums, and the hash of the texts joined by blank lines."""
    done: list[tuple] = []
    url, words, chunks, digest = None, 0, 0, hashlib.sha256()

    def taken() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pylist([dict(zip(("url", "word_count", "n_chunks", "text_hash"), row)) for row in done], schema=pa.schema([("url", pa.string()), ("word_count", pa.int64()), ("n_chunks", pa.int64()), ("text_hash", pa.string())]))
        done.clear()
        return batch

    for batch in batches:
        for at, n, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if chunks and at != url:
                done.append((url, words, chunks, digest.hexdigest()))
                words, chunks, digest = 0, 0, hashlib.sha256()
            if chunks:
                digest.update(b"\n\n")
            digest.update(text.encode())
            url, words, chunks = at, words + n, chunks + 1
        if done:
            yield taken()
    if chunks:
        done.append((url, words, chunks, digest.hexdigest()))
        yield taken()
