"""The pN_ queries and, where SQL can say the same over whole tables, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import boilerplate, language, leakage, mixing, nearcopies, neighbours, privacy, splitting
from siltstone.sources.tables import ensure_checkpoint_dir, spread, table


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.pages_of(table(spark, sf_dir, "crawl_results"), table(spark, sf_dir, "extract_requests"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.page_blocks(_pages(spark, sf_dir)).where("is_main").select("src", "row_id", "block_no")


def p1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.main_text(_pages(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbour_pairs(neighbours.neighbours(table(spark, sf_dir, "chunk_payloads"), least=0.85))


def p3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "extract_results"), table(spark, sf_dir, "lang_samples"))


def p3_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.segments(table(spark, sf_dir, "extract_results"), table(spark, sf_dir, "lang_samples"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_languages(spark, sf_dir).where("line_no >= 0 or not right_label").select("result_id", "line_no", "lang")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.pairs(*nearcopies.near_copies(table(spark, sf_dir, "chunk_payloads")))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.groups(*nearcopies.near_copies(table(spark, sf_dir, "chunk_payloads")))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(splitting.oversized_chunks(table(spark, sf_dir, "chunk_payloads"), table(spark, sf_dir, "ingest_requests")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pieces(spark, sf_dir).where("piece_no = 0").select("chunk_id", "cut")


def p6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "eval_items"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_leaks(spark, sf_dir).select("doc_id", "item_id")


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.without_leaks(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "eval_items"))


def _mix(spark: SparkSession, sf_dir: str, size) -> tuple[DataFrame, DataFrame]:
    # sizes are used several times; they are counted once
    ensure_checkpoint_dir(spark)
    documents = mixing.sized(spread(table(spark, sf_dir, "documents")), size).checkpoint()
    return documents, mixing.solve(documents, table(spark, sf_dir, "mix_targets"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = mixing.sized(table(spark, sf_dir, "documents"), mixing.word_size())
    return mixing.solve(documents, table(spark, sf_dir, "mix_targets")).where("not reachable").select("source")


def p7_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source has and is to give, in words."""
    documents = mixing.sized(table(spark, sf_dir, "documents"), mixing.word_size())
    plan = mixing.solve(documents, table(spark, sf_dir, "mix_targets"))
    return plan.select("source", "n_docs", "size", F.round("target_size", 3).alias("target_size"), "reachable")


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(*_mix(spark, sf_dir, mixing.token_count()("text")))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, plan = _mix(spark, sf_dir, mixing.token_count()("text"))
    return mixing.shares(mixing.mixture(documents, plan), plan)


def p8_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.personal_data(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "given_names"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_mentions(spark, sf_dir).where("kind <> 'term'")


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.cleaned(table(spark, sf_dir, "documents"), p8_mentions(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_main_text, p2_found, p3_found, p3_languages, p3_segments, p4_found, p4_groups, p5_found, p5_pieces, p6_found, p6_leaks, p6_clean, p7_found, p7_plan, p7_mixture, p7_shares, p8_found, p8_mentions, p8_clean)
}

_SHARED = r"""latest_chunk AS (
            SELECT chunk_id, text FROM chunk_payloads WHERE chunk_id IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC) = 1),
        words AS (SELECT chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM latest_chunk),
        runs AS (SELECT DISTINCT chunk_id, w[i:i+2] AS run FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
        sizes AS (SELECT chunk_id, count(*) AS n FROM runs GROUP BY chunk_id),
        shared AS (
            SELECT a.chunk_id AS chunk_a, b.chunk_id AS chunk_b, count(*) AS n
            FROM runs a JOIN runs b ON a.run = b.run AND a.chunk_id < b.chunk_id GROUP BY ALL)"""
_LEAKS = r"""item_words AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM eval_items),
        item_places AS (SELECT item_id, i, w[i:i+4] AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM item_words)),
        item_runs AS (SELECT DISTINCT item_id, run FROM item_places),
        doc_words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS w FROM documents),
        doc_places AS (SELECT doc_id, i, w[i:i+4] AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM doc_words)),
        doc_runs AS (SELECT DISTINCT doc_id, run FROM doc_places),
        totals AS (SELECT item_id, count(*) AS total FROM item_runs GROUP BY item_id)"""
_SIZES = r"""words AS (
            SELECT lower(trim(source, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS source,
                   coalesce(len(regexp_extract_all(text, '[^ \t\n\r\x{00A0}]+')), 0) AS n FROM documents),
        sizes AS (SELECT t.source, t.target_share, t.max_repeats, coalesce(sum(n), 0) AS n, count(n) AS n_docs
                  FROM mix_targets t LEFT JOIN words USING (source) GROUP BY ALL)"""

ORACLE_SQL: dict[str, str] = {
    "p2_found": r"""
        WITH latest_chunk AS (
            SELECT chunk_id, collection, embedding::DOUBLE[] AS e FROM chunk_payloads WHERE chunk_id IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC) = 1),
        usable AS (
            SELECT chunk_id, coalesce(collection, '') AS collection, e, sqrt(list_dot_product(e, e)) AS norm FROM latest_chunk
            WHERE len(e) = 96 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(e, e) > 0),
        scored AS (
            SELECT a.chunk_id AS a, b.chunk_id AS b, list_dot_product(a.e, b.e) / (a.norm * b.norm) AS s
            FROM usable a JOIN usable b ON a.collection = b.collection AND a.chunk_id <> b.chunk_id),
        top AS (SELECT a, b, s FROM scored WHERE s >= 0.84 QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 10)
        SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM top WHERE s >= 0.85""",
    "p4_found": rf"""
        WITH {_SHARED}
        SELECT chunk_a, chunk_b FROM shared s JOIN sizes x ON x.chunk_id = chunk_a JOIN sizes y ON y.chunk_id = chunk_b
        WHERE s.n >= 0.6 * (x.n + y.n - s.n)""",
    "p4_groups": rf"""
        WITH RECURSIVE {_SHARED},
        sets AS (SELECT chunk_id, list_sort(list(run)) AS runs FROM runs GROUP BY chunk_id),
        classes AS (SELECT chunk_id, min(chunk_id) OVER (PARTITION BY runs) AS class_id, count(*) OVER (PARTITION BY runs) AS n_copies FROM sets),
        links AS (SELECT chunk_a AS a, chunk_b AS b FROM shared s JOIN sizes x ON x.chunk_id = chunk_a JOIN sizes y ON y.chunk_id = chunk_b
                  WHERE s.n >= 0.6 * (x.n + y.n - s.n) AND chunk_a IN (SELECT class_id FROM classes) AND chunk_b IN (SELECT class_id FROM classes)),
        both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reached AS (SELECT DISTINCT class_id AS node, class_id AS other FROM classes
                    UNION SELECT r.node, e.b FROM reached r JOIN both_ways e ON e.a = r.other),
        named AS (SELECT node, min(other) AS group_id FROM reached GROUP BY node),
        degree AS (SELECT a AS node, count(*) AS n_links FROM both_ways GROUP BY a)
        SELECT chunk_id, class_id, group_id, n_copies, coalesce(n_links, 0) AS n_links
        FROM classes c JOIN named n ON n.node = c.class_id LEFT JOIN degree d ON d.node = c.class_id""",
    "p5_found": r"""
        WITH latest_request AS (
            SELECT request_id, chunk_size FROM ingest_requests QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY loaded_at DESC) = 1),
        latest_chunk AS (
            SELECT chunk_id, text, ingest_id FROM chunk_payloads WHERE chunk_id IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at DESC) = 1),
        limited AS (
            SELECT c.chunk_id, c.text, coalesce(r.chunk_size, 512) AS size_limit
            FROM latest_chunk c LEFT JOIN latest_request r ON c.ingest_id = r.request_id),
        long AS (
            SELECT * FROM limited WHERE len(regexp_extract_all(text, '[^ \t\n\r\x{00A0}]+')) > size_limit),
        sentences AS (
            SELECT chunk_id, size_limit,
                   unnest(string_split(replace(regexp_replace(text, '([.!?])([ \t\n\r\x{00A0}]+)([A-Z])', '\1' || chr(1) || '\3', 'g'), chr(10) || chr(10), chr(1)), chr(1))) AS sentence
            FROM long)
        SELECT chunk_id, CASE WHEN max(len(regexp_extract_all(sentence, '[^ \t\n\r\x{00A0}]+'))) > any_value(size_limit) THEN 'forced' ELSE 'natural' END AS cut
        FROM sentences GROUP BY chunk_id""",
    "p6_found": rf"""
        WITH {_LEAKS}
        SELECT d.doc_id, i.item_id FROM doc_runs d JOIN item_runs i USING (run) JOIN totals t USING (item_id)
        GROUP BY d.doc_id, i.item_id HAVING count(*) >= 0.3 * any_value(t.total)""",
    "p6_leaks": rf"""
        WITH {_LEAKS},
        leaks AS (SELECT d.doc_id, i.item_id, count(*)::INT AS shared, any_value(t.total)::INT AS total
                  FROM doc_runs d JOIN item_runs i USING (run) JOIN totals t USING (item_id) GROUP BY d.doc_id, i.item_id HAVING count(*) >= 0.3 * any_value(t.total)),
        -- the longest stretch of the document that any item holds and that ends with a run of this item
        ends AS (SELECT DISTINCT l.doc_id, l.item_id, x.i + 4 AS last FROM leaks l JOIN doc_places x USING (doc_id) JOIN item_runs r ON r.item_id = l.item_id AND r.run = x.run),
        hits AS (SELECT DISTINCT x.doc_id, x.i AS place, y.item_id, y.i - x.i AS shift FROM doc_places x JOIN item_places y USING (run)),
        islands AS (SELECT doc_id, place, place - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY place) AS island, item_id, shift FROM hits),
        stretches AS (SELECT doc_id, place + 4 AS last, row_number() OVER (PARTITION BY doc_id, item_id, shift, island ORDER BY place) + 4 AS words FROM islands),
        longest AS (SELECT doc_id, last, max(words) AS words FROM stretches GROUP BY ALL)
        SELECT l.doc_id, l.item_id, any_value(shared) AS shared, any_value(total) AS total, max(words)::INT AS longest
        FROM leaks l JOIN ends USING (doc_id, item_id) JOIN longest USING (doc_id, last) GROUP BY l.doc_id, l.item_id""",
    "p7_found": rf"""
        WITH {_SIZES}
        SELECT source FROM sizes WHERE max_repeats * n < target_share * (SELECT sum(n) FROM sizes)""",
    "p7_plan": rf"""
        WITH {_SIZES},
        told AS (SELECT *, max_repeats * n >= target_share * (SELECT sum(n) FROM sizes) AS reachable FROM sizes),
        short AS (SELECT nullif(sum(max_repeats * n), 0) / sum(target_share) AS total FROM told WHERE NOT reachable),
        total AS (SELECT CASE WHEN (SELECT total FROM short) IS NULL THEN (SELECT sum(n) FROM sizes)
                              ELSE greatest(0.2 * (SELECT sum(n) FROM sizes), (SELECT total FROM short)) END AS total)
        SELECT source, n_docs, n::BIGINT AS size, round(target_share * total, 3) AS target_size, reachable FROM told, total""",
}
