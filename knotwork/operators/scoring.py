"""Scores of evidence rows for claims in Arrow batches: the words of all claims counted over blocks of evidence, exact scores only for rows that can be among the best."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP = 131_072  # evidence rows that a task holds at once; more follow as groups of their own
BLOCK, CELLS = 32_768, 96_000_000  # rows of a block; bytes of its table of words by rows
# Weights of words, names, conditions, measurements, relation and arity.
HYBRID, PLAIN = (0.45, 0.25, 0.15, 0.10, 0.05, 0.01), (0.75, 0.25, 0.0, 0.0, 0.0, 0.0)


class Finder:
    """Which of many strings occur in a text, by their first four characters and the lengths known for these."""

    def __init__(self, keys: list[str]) -> None:
        self.index = {s: i for i, s in enumerate(keys)}
        self.short = sorted({len(s) for s in keys if len(s) < 4})
        lengths: dict[str, set[int]] = {}
        for s in keys:
            if len(s) >= 4:
                lengths.setdefault(s[:4], set()).add(len(s))
        self.lengths = {s: sorted(n) for s, n in lengths.items()}

    def find(self, text: str) -> list[int]:
        out, index, lengths = set(), self.index, self.lengths
        for i in range(len(text)):
            for n in lengths.get(text[i : i + 4], ()):
                if (at := index.get(text[i : i + n])) is not None:
                    out.add(at)
            for n in self.short:
                if (at := index.get(text[i : i + n])) is not None:
                    out.add(at)
        return list(out)


class Named:
    """Vertices by the strings that stand for them: `keys` are the distinct strings, each vertex has a row and any number of keys."""

    def __init__(self, column: pa.Array) -> None:
        nested = pa.types.is_list(column.type.value_type)
        self.count = np.diff(column.offsets.to_numpy())
        flat = column.flatten()
        self.row = np.repeat(np.arange(len(column)), self.count)
        self.several = nested
        if nested:
            inner = np.diff(flat.offsets.to_numpy())
            vertex, flat, self.several = np.repeat(np.arange(len(flat)), inner), flat.flatten(), bool((inner > 1).any())
        else:
            vertex = np.arange(len(flat))
        coded = flat.dictionary_encode()
        self.keys = coded.dictionary.to_pylist()
        self.key, self.vertex = coded.indices.to_numpy(), vertex
        self.finder = Finder(self.keys)

    def block(self, lo: int, hi: int) -> None:
        """The vertices of the rows lo to hi by key, for `hits`."""
        a, b = np.searchsorted(self.vertex, np.searchsorted(self.row, [lo, hi]))
        order = np.argsort(self.key[a:b], kind="stable")
        self.posted = self.vertex[a:b][order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.key[a:b], minlength=len(self.keys)))])
        self.lo, self.size = lo, hi - lo

    def hits(self, found: list[int]) -> np.ndarray | None:
        """For each row of the block how many of its vertices have one of the keys; None if no row has."""
        parts = [self.posted[self.starts[f] : self.starts[f + 1]] for f in found]
        parts = [p for p in parts if len(p)]
        if not parts:
            return None
        vertices = parts[0] if len(parts) == 1 else np.concatenate(parts)
        if self.several:
            vertices = np.unique(vertices)
        return np.bincount(self.row[vertices] - self.lo, minlength=self.size)


def millionths(scores: np.ndarray) -> np.ndarray:
    """Scores in millionths, half up on their shortest decimal form as Spark rounds."""
    x = scores * 1e6
    out = np.floor(x + 0.5)
    for i in np.flatnonzero(np.abs(x - np.floor(x) - 0.5) < 1e-4):
        out[i] = int((Decimal(repr(float(scores[i]))) * 1_000_000).to_integral_value(ROUND_HALF_UP))
    return out.astype(np.int64)


def _words(norm: pa.Array, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets and tokens of the rows, and for each distinct token the offsets and numbers of the words within it. Words have no blanks, so a text contains one if one of its tokens does."""
    split = pc.split_pattern(norm, " ")
    coded = split.flatten().dictionary_encode()
    index, lengths = {w: i for i, w in enumerate(words)}, sorted({len(w) for w in words})
    inside, ends = [], [0]
    for token in coded.dictionary.to_pylist():
        here = {at for n in lengths if n <= len(token) for i in range(len(token) - n + 1) if (at := index.get(token[i : i + n])) is not None}
        inside += here
        ends.append(len(inside))
    return split.offsets.to_numpy(), coded.indices.to_numpy(), np.array(ends), np.array(inside, dtype=np.int64)


def _group(table: pa.Table, claims: pa.Table, k: int, weights: tuple[float, ...]) -> pa.Table:
    """cid, evidence_id, score: the k best rows of the table for each claim; of equal (rounded) scores those of the least ids."""
    table = table.sort_by("evidence_id").combine_chunks()  # so of equal scores the earlier row is the better
    column = lambda name: table.column(name).chunk(0)
    w_words, w_names, w_conditions, w_measures, w_relation, w_arity = weights
    norms, relations = claims.column("claim_norm").to_pylist(), claims.column("claim_relation").to_pylist()
    coded = claims.column("claim_terms").combine_chunks()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    ends, coded = coded.offsets.to_numpy(), coded.flatten().dictionary_encode()
    words, terms = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    sizes = np.diff(ends)
    offsets, tokens, word_ends, inside = _words(column("norm"), words)
    names, conditions, measures = Named(column("parts")), Named(column("conditions")), Named(column("measures"))
    kinds = [(w_names, names)] + [(w, x) for w, x in ((w_conditions, conditions), (w_measures, measures)) if w and x.keys]
    found = [[names.finder.find(t) for t in norms]]
    for w, x in kinds[1:]:  # the conditions' strings are looked for in the claim run together, and begin alike
        found.append([(x.finder.find(t.replace(" ", "")) if "condition:" in t.replace(" ", "") else []) if x is conditions else x.finder.find(t) for t in norms])
    vertices = {id(x): np.maximum(1, x.count) for _, x in kinds}
    arity = np.minimum(column("arity").to_numpy(), 6) * w_arity
    by_relation = column("relation_type").dictionary_encode()
    shown, kind_of = by_relation.dictionary.to_pylist(), by_relation.indices.to_numpy()
    bonus = {r: w_relation * np.array([float(r != "" and any(t in s for t in r.split("|"))) for s in shown])[kind_of] for r in set(relations)} if w_relation else {}
    count_type = np.uint8 if sizes.max(initial=0) < 256 else np.uint16
    step = int(min(BLOCK, max(1024, CELLS // max(1, len(words) * np.dtype(count_type).itemsize))))
    none = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
    best = [none] * len(norms)
    for lo in range(0, len(table), step):
        hi = min(len(table), lo + step)
        for _, x in kinds:
            x.block(lo, hi)
        cells = np.zeros((len(words), hi - lo), count_type)
        spread = tokens[offsets[lo] : offsets[hi]]
        many = word_ends[spread + 1] - word_ends[spread]
        at = np.repeat(word_ends[spread] - np.cumsum(many) + many, many) + np.arange(many.sum())
        cells[inside[at], np.repeat(np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1])), many)] = 1
        most, least = arity[lo:hi].max(), arity[lo:hi].min()
        counts = np.empty(hi - lo, count_type)
        highest = {r: b[lo:hi].max() for r, b in bonus.items()}
        for c in range(len(norms)):
            n = max(1, int(sizes[c]))
            counts.fill(0)
            for t in terms[ends[c] : ends[c + 1]]:
                np.add(counts, cells[t], out=counts)
            hits = [(w, x, h) for (w, x), f in zip(kinds, found, strict=True) if f[c] and (h := x.hits(f[c])) is not None]
            more = bonus.get(relations[c])

            def scores(rows: np.ndarray) -> np.ndarray:
                out = w_words * (counts[rows] / n)  # noqa: B023
                for w, x, h in hits:  # noqa: B023
                    out = out + w * (h[rows] / vertices[id(x)][lo + rows])  # noqa: B023
                return out + (more[lo + rows] if more is not None else 0.0) + arity[lo + rows]  # noqa: B023

            top, kept, ids = best[c]
            if len(top) == k:  # a later row must exceed the k-th score
                bar = top[-1] / 1e6 + 4e-7
            elif hi - lo < k:
                bar = -1.0
            else:  # the k-th score of some of the rows with the most words is reached by k rows
                below = np.cumsum(np.bincount(counts)[::-1])
                first = np.flatnonzero(counts >= len(below) - 1 - int(np.searchsorted(below, k)))[:256]
                bar = (np.partition(scores(first), -k)[-k] if len(first) >= k else -1.0) - 2e-6
            need = ceil((bar - most - (highest[relations[c]] if more is not None else 0.0)) * n / w_words - 1e-9)
            can = counts >= need if need > 0 else np.ones(hi - lo, bool)
            for _, _, h in hits:
                can |= h > 0
            rows = np.flatnonzero(can)
            if not len(rows):
                continue
            s = scores(rows)
            over = s > bar
            rows, s = rows[over], s[over]
            if len(rows):
                top, kept, ids = np.concatenate([top, millionths(s)]), np.concatenate([kept, s]), np.concatenate([ids, rows + lo])
                order = np.argsort(-top, kind="stable")[:k]
                best[c] = top[order], kept[order], ids[order]
    rows = np.concatenate([b[2] for b in best]) if best else none[2]
    cid = claims.column("cid").take(pa.array(np.repeat(np.arange(len(best)), [len(b[2]) for b in best])))
    return pa.table({"cid": cid, "evidence_id": column("evidence_id").take(pa.array(rows)), "score": pa.array(np.concatenate([b[1] for b in best]) if best else none[1])})


def best_rows(batches: Iterator[pa.RecordBatch], claims: pa.Table, k: int, weights: tuple[float, ...]) -> Iterator[pa.RecordBatch]:
    """The k best rows for each claim of each group of a task's evidence rows."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= GROUP:
            yield from _group(pa.Table.from_batches(held), claims, k, weights).to_batches()
            held, size = [], 0
    if held:
        yield from _group(pa.Table.from_batches(held), claims, k, weights).to_batches()
