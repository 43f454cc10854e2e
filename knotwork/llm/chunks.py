"""Oversized texts cut into balanced pieces at natural boundaries, with a given overlap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions.sizes import small_side

PARAGRAPH, SENTENCE, LINE = 3, 2, 1
_STOPS = np.array([ord(c) for c in ".!?。！？…;；:"], dtype=np.uint32)
_CLOSERS = np.array([ord(c) for c in "\"')]}»”’」』）】"], dtype=np.uint32)


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of characters other than blank, tab, CR and LF, and how strong the text's break after it is."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    blank = (codes == 32) | (codes == 9) | (codes == 10) | (codes == 13)
    inside = np.concatenate(([False], ~blank, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, dtype=np.int8)
    lines = np.concatenate(([0], np.cumsum(codes == 10)))
    feeds = lines[np.append(starts[1:], len(codes))] - lines[ends]
    last = codes[ends - 1]
    for _ in range(2):
        closer = np.isin(last, _CLOSERS) & (ends - starts > 2)
        last = np.where(closer, codes[np.maximum(ends - 2, 0)], last)
    strength = np.where(feeds > 1, PARAGRAPH, np.where(np.isin(last, _STOPS[:7]), SENTENCE, np.where(feeds == 1, LINE, 0)))
    strength[-1] = PARAGRAPH
    return starts, ends, strength.astype(np.int8)


MORE = 3  # pieces over the least number that are tried for the sake of natural ends


def cut_points(strength: np.ndarray, size: int, overlap: int) -> list[tuple[int, int]]:
    """Token ranges of the pieces: the least number of pieces that keeps the size, ends at equal-length targets, each
    snapped to the strongest break near its target that still lets the rest keep the size. Where an end finds no break
    at all, up to MORE pieces more are tried, as they leave more room; of equal results the fewest pieces are taken."""
    n = len(strength)
    if n <= size:
        return [(0, n)]
    least = 1 + -(-(n - size) // (size - overlap))
    best, missed = _ends(strength, size, overlap, least)
    if missed and strength[: n - 1].any():
        for k in range(least + 1, least + 1 + MORE):
            ends, bad = _ends(strength, size, overlap, k)
            if bad < missed:
                best, missed = ends, bad
            if not missed:
                break
    return [(max(0, a - overlap), b) for a, b in zip([0, *best[:-1]], best)]


def _ends(strength: np.ndarray, size: int, overlap: int, k: int) -> tuple[list[int], int]:
    """Ends of k pieces and how many of them are at no break. Piece i holds its overlap and the tokens up to its end."""
    n, step = len(strength), size - overlap
    length = (n + (k - 1) * overlap) / k  # of every piece, overlaps counted twice
    ends, end, missed = [], 0, 0
    for i in range(1, k):
        low = max(end + 1, n - (k - i) * step)  # what is left must fit into the pieces left
        high = min(end + step if i > 1 else size, n - (k - i))
        target = min(max(math.ceil(i * length - (i - 1) * overlap - 0.5), low), high)
        spread = max(step // 4, 1)
        at = _nearest(strength, max(low, target - spread), min(high, target + spread), target) or _nearest(strength, low, high, target)
        missed += at is None
        end = target if at is None else at
        ends.append(end)
    return [*ends, n], missed


def _nearest(strength: np.ndarray, low: int, high: int, target: int) -> int | None:
    """The end (tokens before it) in [low, high] with the strongest break, the nearest to the target among those."""
    part = strength[low - 1 : high]
    if not len(part) or not part.max():
        return None
    places = np.flatnonzero(part == part.max()) + low
    return int(places[np.argmin(np.abs(places - target))])


def split_oversized(documents: DataFrame, settings: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, piece_no, n_pieces, start_token, end_token, tokens, break_after and, if asked for, text.

    settings: source, chunk_token_size, chunk_overlap_token_size; null sizes and unknown or null sources take the row
    `default`. Sources are compared trimmed and in lower case. An overlap of the size or more counts as size - 1; a
    size below 1 counts as 1. A text within the size comes out whole as one piece; null and blank texts give no piece;
    a single token is never cut. Repeated doc_ids are split once each.
    """
    rows = settings.select(F.lower(F.trim("source")).alias("knot_source"), "chunk_token_size", "chunk_overlap_token_size").dropDuplicates(["knot_source"])
    default = rows.where("knot_source = 'default'").agg(F.coalesce(F.first("chunk_token_size"), F.lit(1200)), F.coalesce(F.first("chunk_overlap_token_size"), F.lit(100))).first()
    own = rows.select("knot_source", F.coalesce("chunk_token_size", F.lit(default[0])).alias("size"), F.coalesce("chunk_overlap_token_size", F.lit(default[1])).alias("overlap"))
    docs = documents.where("text is not null").select("doc_id", "text", F.coalesce(F.lower(F.trim("source")), F.lit("default")).alias("knot_source"))
    sized = docs.join(small_side(own), "knot_source", "left").select("doc_id", "text", F.greatest(F.coalesce("size", F.lit(default[0])), F.lit(1)).alias("size"), F.coalesce("overlap", F.lit(default[1])).alias("overlap"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, size, overlap in batch.itertuples(index=False, name=None):
                starts, ends, strength = boundaries(text)
                if not len(starts):
                    continue
                pieces = cut_points(strength, size, min(max(overlap, 0), size - 1))
                for i, (a, b) in enumerate(pieces):
                    out.append((doc_id, i, len(pieces), a, b, b - a, int(strength[b - 1]), *([text[starts[a] : ends[b - 1]]] if with_text else [])))
            yield pd.DataFrame(out, columns=names)

    schema = "doc_id bigint, piece_no int, n_pieces int, start_token int, end_token int, tokens int, break_after int" + ", text string" * with_text
    names = [c.split()[0] for c in schema.split(", ")]
    return sized.mapInPandas(run, schema)
