"""Splitting of oversized texts at natural boundaries.

The separators form a hierarchy: section (a blank line before a Markdown
heading), paragraph (two line feeds), sentence, word. Every gap between two
words has the strongest separator found in it. A stretch of text above the
limit is cut at its strongest separators first, and each part that is still too
long at the next weaker ones; the parts are then packed greedily, and each
piece opens with the last words of the piece before it, always as many as the
overlap says: a sentence that does not fit beside them is cut. With ``measure='chars'``
the hierarchy goes one level further down, to the character.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources.tables import free_name, latest

WORD = re.compile("[^ \t\n\r ]+")
HEADING = re.compile("#{1,6}$")
SECTION, PARAGRAPH, SENTENCE, PLAIN = 3, 2, 1, 0
DEFAULT_SIZE, DEFAULT_OVERLAP = 512, 64

#: The number of words, in Spark SQL.
WORD_COUNT = "size(regexp_extract_all({}, '[^ \\\\t\\\\n\\\\r\\\\u00a0]+', 0))"


def words_in(column: str):
    return F.coalesce(F.expr(WORD_COUNT.format(column)), F.lit(0))


def gap_levels(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Level of the gap after each word but the last."""
    levels = []
    for (start, end), (after, stop) in zip(spans, spans[1:]):
        if "\n\n" in text[end:after]:
            levels.append(SECTION if HEADING.match(text[after:stop]) else PARAGRAPH)
        elif text[end - 1] in ".!?" and "A" <= text[after] <= "Z":
            levels.append(SENTENCE)
        else:
            levels.append(PLAIN)
    return levels


def units(levels: list[int], first: int, last: int, limit: int, level: int, out: list[tuple[int, int]]) -> None:
    """Word ranges [first, last) of at most ``limit`` words, cut at the strongest separators that do."""
    if last - first <= limit or level < PLAIN:
        out.append((first, last))
        return
    if level == PLAIN:
        out.extend((i, i + 1) for i in range(first, last))
        return
    begin = first
    for i in range(first, last):
        if i == last - 1 or levels[i] >= level:
            units(levels, begin, i + 1, limit, level - 1, out)
            begin = i + 1


def pack(
    parts: list[tuple[int, int]], limit: int, overlap: int, finer: Callable[[int, int], list[int]], last_end: Callable[[int, int], int] = lambda first, upto: upto
) -> list[tuple[int, int, int]]:
    """(first word with overlap, first new word, end) of each piece.

    Every piece but the first opens with ``overlap`` words of the piece before it,
    or all of them if it has fewer. A part that does not fit beside them is cut at
    the places that ``finer`` gives for it; where there are none, within one
    sentence, at ``last_end``, the last place up to where the piece is full.
    """
    pieces: list[tuple[int, int, int]] = []
    start = new = end = 0
    left = parts[::-1]
    while left:
        first, last = left.pop()
        if end > new and last - start > limit:
            if last - max(first - overlap, start) > limit and (cuts := finer(first, last)):
                left.extend(list(zip([first, *cuts], [*cuts, last]))[::-1])
                continue
            pieces.append((start, new, end))
            new, start = first, max(first - overlap, start)
            if last - start > limit:
                full = last_end(first, start + limit)
                left.append((full, last))
                last = full
        end = last
    if end > new:
        pieces.append((start, new, end))
    return pieces


def split_words(text: str, limit: int, overlap: int) -> tuple[str, list[tuple[int, int, int, int, int]]]:
    """'natural', 'forced' or 'whole', and (start, start of the new part, end, words, repeated words) of each piece.

    Positions are code points of ``text``. A limit under 1 counts as 1, an
    overlap is held between 0 and limit - 1.
    """
    limit = max(limit, 1)
    overlap = min(max(overlap, 0), limit - 1)
    spans = [m.span() for m in WORD.finditer(text)]
    if len(spans) <= limit:
        return "whole", [(0, 0, len(text), len(spans), 0)]
    levels = gap_levels(text, spans)
    longest = run = 1
    for level in levels:
        run = 1 if level else run + 1
        longest = max(longest, run)
    parts: list[tuple[int, int]] = []
    units(levels, 0, len(spans), limit, SECTION, parts)

    def finer(first: int, last: int) -> list[int]:
        strongest = max(levels[first : last - 1], default=PLAIN)
        return [i + 1 for i in range(first, last - 1) if levels[i] == strongest] if strongest >= SENTENCE else []

    return ("forced" if longest > limit else "natural"), [
        (spans[start][0], spans[new][0], spans[end - 1][1], end - start, new - start) for start, new, end in pack(parts, limit, overlap, finer)
    ]


def split_chars(text: str, limit: int, overlap: int) -> tuple[str, list[tuple[int, int, int, int, int]]]:
    """As split_words, with size and overlap in characters; a word above the limit is cut between characters."""
    limit = max(limit, 1)
    overlap = min(max(overlap, 0), limit - 1)
    if len(text) <= limit:
        return "whole", [(0, 0, len(text), len(text), 0)]
    spans = [m.span() for m in WORD.finditer(text)]
    levels = gap_levels(text, spans)
    cuts = {above: [spans[i + 1][0] for i, level in enumerate(levels) if level >= above] for above in range(SECTION + 1)}

    def down(first: int, last: int, level: int, out: list[tuple[int, int]]) -> None:
        if last - first <= limit:
            out.append((first, last))
        elif level < 0:
            out.extend((i, i + 1) for i in range(first, last))
        else:
            begin = first
            for at in [*cuts[level][bisect_right(cuts[level], first) : bisect_left(cuts[level], last)], last]:
                down(begin, at, level - 1, out)
                begin = at

    parts: list[tuple[int, int]] = []
    down(0, len(text), SECTION, parts)

    def finer(first: int, last: int) -> list[int]:
        for level in (SECTION, PARAGRAPH, SENTENCE):
            if inside := cuts[level][bisect_right(cuts[level], first) : bisect_left(cuts[level], last)]:
                return inside
        return []

    def last_end(first: int, upto: int) -> int:
        at = cuts[PLAIN][bisect_right(cuts[PLAIN], upto) - 1] if cuts[PLAIN] else first
        return at if at > first else upto

    forced = any(b - a > limit for a, b in spans)
    return ("forced" if forced else "natural"), [(s, n, e, e - s, n - s) for s, n, e in pack(parts, limit, overlap, finer, last_end)]


PIECE_SCHEMA = "chunk_id bigint, piece_no int, cut string, start_pos int, new_pos int, end_pos int, size int, repeated int, piece string"


def split_oversized(rows: DataFrame, measure: str = "words") -> DataFrame:
    """Pieces of each row of ``rows(chunk_id, text, size_limit, size_overlap)``.

    One row for each piece: ``piece`` is ``text[start_pos:end_pos]``, of which
    the part before ``new_pos`` repeats the piece before; the new parts together
    with the white space between them are the whole text. A text within its
    limit is one piece with cut 'whole'; a null text gives no row, an empty one
    an empty piece. Extra columns are ignored.
    """
    cut_text = split_words if measure == "words" else split_chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in PIECE_SCHEMA.split(", ")]
        types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for key, text, limit, overlap in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if text is None:
                    continue
                cut, pieces = cut_text(text, limit, overlap)
                for no, (start, new, end, size, repeated) in enumerate(pieces):
                    for column, value in zip(out, (key, no, cut, start, new, end, size, repeated, text[start:end])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return rows.select(
        "chunk_id", "text", F.coalesce("size_limit", F.lit(DEFAULT_SIZE)).cast("int"), F.coalesce("size_overlap", F.lit(DEFAULT_OVERLAP)).cast("int")
    ).mapInArrow(run, PIECE_SCHEMA)


def oversized_chunks(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """The chunks above the limit of their ingest request, as input of split_oversized.

    The limit is ``chunk_size`` of the last loaded row of the request that
    ``ingest_id`` names, else 512; the overlap likewise, else 64. Each chunk
    counts in its last loaded delivery. Texts without words, null texts and null
    keys give no row. Chunks without request are spread over 64 salts, so that
    they do not meet in one task; a hot request is left to adaptive skew joins.
    """
    limits = latest(requests.select("request_id", "loaded_at", "chunk_size", "chunk_overlap"), "request_id").select(
        F.col("request_id").alias("ingest_id"), F.lit(0).alias("salt"), F.col("chunk_size").alias("size_limit"), F.col("chunk_overlap").alias("size_overlap")
    )
    seen = chunks.select("chunk_id", "loaded_at", "ingest_id", "text").where("chunk_id is not null")
    long = (
        seen.where("text is not null")
        .withColumn("n_words", words_in("text"))
        .withColumn("salt", F.when(F.col("ingest_id").isNull(), F.pmod(F.xxhash64("chunk_id"), F.lit(64)).cast("int")).otherwise(0))
        .join(limits, ["ingest_id", "salt"], "left")
        .where(F.col("n_words") > F.coalesce("size_limit", F.lit(DEFAULT_SIZE)))
    )
    last = seen.groupBy("chunk_id").agg(F.max("loaded_at").alias("last_at"))
    rank = free_name(long, "of_key")
    return (
        long.join(last, "chunk_id")
        .where(F.col("loaded_at").eqNullSafe(F.col("last_at")))
        .groupBy("chunk_id")
        .agg(F.max(F.struct("n_words", "text", "size_limit", "size_overlap")).alias(rank))
        .select("chunk_id", f"{rank}.*")
    )
