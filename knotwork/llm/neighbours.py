"""The k most similar vectors of every vector, by score-aware anisotropic quantisation.

Vectors (scaled to length one) fall into cells: a centre, and where there are more vectors than the centres of the
sample can share out, a second centre for what the first leaves over, so that cells stay small at any number of vectors.
What a cell's centre leaves over is coded in four bits for every four-number part, with codebooks and codes chosen so that the error along the vector itself, which changes inner
products most, costs more than the error across it. Each vector is a query against its own cell and the next nearest
ones: tables of the query's products with the codebook give approximate scores, the best of which are reranked exactly. Equal vectors enter the index
once and get their neighbours from their class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.sizes import join_hot
from knotwork.session import durable

PART = 4  # numbers of a vector to one four-bit code
SAMPLE = 65_536  # bound of the sample that centres and codebooks are fitted on
CELL = 400  # vectors a cell should hold
PROBES = 3  # cells a query looks into, its own among them
RERANK = 48  # candidates of a cell that are compared exactly
BLOCK = 4_000  # vectors of one cell handled in one task
ASKING = 16_000  # queries of one cell handled in one task
ROWS_A_TASK = 100_000  # vectors and queries that one search task reads
BOOK_ROWS = 6_000  # rows of the sample that the codebooks are fitted on
FINER = 4  # by how much more cells are probed where cells have a second centre
T = 0.2  # threshold of the score-aware loss: errors matter for products above T


def usable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with `dim` finite numbers that are not all zero, scaled to length one, and which rows they are."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    keep = np.flatnonzero(lengths == dim)
    if not len(keep):
        return np.zeros((0, dim), np.float32), keep
    flat = column.take(pa.array(keep)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
    x, keep = x[good], keep[good]
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32), keep


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = (x @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres, dtype=np.float64)
        np.add.at(total, at, x)
        length = np.linalg.norm(total, axis=1)
        full = length > 1e-9
        centres[full] = (total[full] / length[full, None]).astype(np.float32)
    return centres


def _centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    if k <= 512 or len(x) <= 512:
        return _means(x, k, 8, rng)
    top = _means(x, int(np.sqrt(k)), 8, rng)
    at = (x @ top.T).argmax(axis=1)
    parts = [_means(x[at == i], max(1, round(k * (at == i).mean())), 6, rng) for i in range(len(top)) if (at == i).any()]
    return np.concatenate(parts)


def _residual_centres(rest: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """Plain k-means of what the first centres leave over; one centre is zero."""
    if k <= 1:
        return np.zeros((1, rest.shape[1]), np.float32)
    centres = rest[rng.choice(len(rest), size=min(k, len(rest)), replace=False)].copy()
    for _ in range(rounds):
        at = (rest @ centres.T - 0.5 * (centres**2).sum(1)[None]).argmax(axis=1)
        n = np.bincount(at, minlength=len(centres))
        total = np.zeros_like(centres, dtype=np.float64)
        np.add.at(total, at, rest)
        centres[n > 0] = (total[n > 0] / n[n > 0, None]).astype(np.float32)
    return centres


@dataclass
class Quantiser:
    centres: dict[str, np.ndarray]
    second: dict[str, np.ndarray]  # centres of what the first ones leave over; one of zeros where cells need none
    first: dict[str, int]  # number of a namespace's first cell
    books: np.ndarray  # (parts, 16, PART)
    eta: float
    exact: frozenset[int] = frozenset()  # cells whose vectors are compared one by one

    def own(self, name: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector within its namespace and what the cell's centres leave over."""
        one, two = self.centres[name], self.second[name]
        at = (x @ one.T).argmax(axis=1)
        rest = x - one[at]
        if len(two) == 1:
            return at, rest
        near = (rest @ two.T - 0.5 * (two**2).sum(1)[None]).argmax(axis=1)
        return at * len(two) + near, rest - two[near]

    def probed(self, name: str, x: np.ndarray, own: np.ndarray, probes: int) -> np.ndarray:
        """(vectors, probes) cells a query looks into, its own first."""
        one, two = self.centres[name], self.second[name]
        close = x @ one.T
        many = min(probes, len(one))
        best = np.argpartition(-close, many - 1, axis=1)[:, :many]
        if len(two) == 1:
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(close, best, axis=1), axis=1), axis=1)
            return best  # the nearest centre is the own cell
        finer = min(probes * FINER, many * len(two))
        score = (np.take_along_axis(close, best, axis=1)[:, :, None] + (x @ two.T)[:, None, :]).reshape(len(x), -1)
        cells = (best[:, :, None] * len(two) + np.arange(len(two))[None, None]).reshape(len(x), -1)
        score[cells == own[:, None]] = np.inf
        top = np.argpartition(-score, finer - 1, axis=1)[:, :finer]
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, axis=1), axis=1), axis=1)
        return np.take_along_axis(cells, top, axis=1)

    def centre_of(self, cell: int) -> np.ndarray:
        name = max((n for n in self.first if self.first[n] <= cell), key=self.first.get)
        one, two = divmod(cell - self.first[name], len(self.second[name]))
        return self.centres[name][one] + self.second[name][two]

    def encode(self, x: np.ndarray, rest: np.ndarray, rounds: int = 1) -> np.ndarray:
        """Codes of what the centres leave, by coordinate descent on |r|^2 + (eta - 1) (r.x)^2."""
        parts = self.books.shape[0]
        xs, rs = x.reshape(len(x), parts, PART), rest.reshape(len(x), parts, PART)
        codes = np.empty((len(x), parts), dtype=np.uint8)
        along = np.zeros((len(x), parts), dtype=np.float32)
        for m in range(parts):
            codes[:, m] = (((self.books[m] ** 2).sum(1))[None] - 2 * rs[:, m] @ self.books[m].T).argmin(axis=1)
            along[:, m] = ((rs[:, m] - self.books[m][codes[:, m]]) * xs[:, m]).sum(1)
        total = along.sum(axis=1)
        for _ in range(rounds):
            for m in range(parts):
                others = total - along[:, m]
                lean = (rs[:, m] * xs[:, m]).sum(1)[:, None] - xs[:, m] @ self.books[m].T  # r.x of this part for each code
                plain = (self.books[m] ** 2).sum(1)[None] - 2 * rs[:, m] @ self.books[m].T
                pick = (plain + (self.eta - 1) * (others[:, None] + lean) ** 2).argmin(axis=1)
                codes[:, m], along[:, m] = pick, lean[np.arange(len(x)), pick]
                total = others + along[:, m]
        return codes

    def fit_books(self, x: np.ndarray, rest: np.ndarray, rounds: int = 4) -> None:
        parts = self.books.shape[0]
        xs, rs = x.reshape(len(x), parts, PART).astype(np.float64), rest.reshape(len(x), parts, PART).astype(np.float64)
        weight = self.eta - 1
        for _ in range(rounds):
            codes = self.encode(x, rest)
            chosen = self.books[np.arange(parts)[None], codes]
            along = ((rs - chosen) * xs).sum(axis=2)
            total = along.sum(axis=1)
            for m in range(parts):
                others = total - along[:, m]
                for c in range(16):
                    at = codes[:, m] == c
                    if not at.any():
                        continue
                    v, r = xs[at, m], rs[at, m]
                    a = at.sum() * np.eye(PART) + weight * v.T @ v
                    b = r.sum(0) + weight * ((others[at] + (r * v).sum(1))[:, None] * v).sum(0)
                    self.books[m, c] = np.linalg.solve(a, b)


def fit(names: np.ndarray, x: np.ndarray, rows: dict[str, int], dim: int, seed: int = 5) -> Quantiser:
    """Centres for each namespace and shared codebooks, from the sample; `rows` are the namespaces' sizes.

    A namespace that needs no second cell, or that the sample holds nothing of, is one cell that is compared exactly.
    """
    rng = np.random.default_rng(seed)
    centres, second, first, at, rest, whole = {}, {}, {}, 0, np.zeros_like(x), set()
    for name in sorted(rows):
        mine = np.flatnonzero(names == name)
        if not len(mine) or rows[name] < 2 * CELL:
            whole.add(at)
        if not len(mine):
            centres[name], second[name], first[name] = np.zeros((1, dim), np.float32), np.zeros((1, dim), np.float32), at
            at += 1
            continue
        k = int(np.clip(rows[name] // CELL, 1, max(1, len(mine) // 8)))
        centres[name], first[name] = _centres(x[mine], k, rng), at
        left = x[mine] - centres[name][(x[mine] @ centres[name].T).argmax(axis=1)]
        finer = int(np.clip(round(rows[name] / (CELL * len(centres[name]))), 1, max(1, len(mine) // 8))) if rows[name] > 1.5 * CELL * len(centres[name]) else 1
        second[name] = _residual_centres(left, finer, rng)
        at += len(centres[name]) * len(second[name])
        rest[mine] = left - second[name][(left @ second[name].T - 0.5 * (second[name] ** 2).sum(1)[None]).argmax(axis=1)]
    few = rng.choice(len(x), size=min(len(x), BOOK_ROWS), replace=False)
    x, rest = x[few], rest[few]
    parts = dim // PART
    books = np.stack([rest[rng.choice(len(rest), 16, replace=len(rest) < 16), m * PART : (m + 1) * PART] for m in range(parts)]).astype(np.float32) if len(x) else np.zeros((parts, 16, PART), np.float32)
    eta = max(1.0, (dim - 1) * T * T / (1 - T * T))
    out = Quantiser(centres, second, first, books, eta, frozenset(whole))
    if len(x):
        out.fit_books(x, rest)
        out.books = out.books.astype(np.float32)
    return out


def _scan(tables: np.ndarray, codes: np.ndarray, queries: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Approximate scores (queries, vectors): products with the centre plus sums of table entries, two four-bit codes a lookup."""
    parts = tables.shape[0]
    by_code = np.einsum("qmd,mcd->mqc", queries.reshape(len(queries), parts, PART), tables, optimize=True)
    score = np.repeat((queries @ centre)[:, None], len(codes), axis=1)
    for m in range(0, parts, 2):
        pair = (by_code[m][:, :, None] + by_code[m + 1][:, None, :]).reshape(len(queries), 256)
        score += np.take(pair, codes[:, m].astype(np.intp) * 16 + codes[:, m + 1], axis=1)
    return score


def _classes(source: DataFrame, dim: int, k: int) -> DataFrame:
    """h1, h2, members: the k + 1 smallest ids of each vector that more than one id of a namespace has."""
    rank = F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    few = _keyed(source, dim).select("vec_id", "h1", "h2").withColumn("rank", rank).where(F.col("rank") <= k + 1)
    return few.groupBy("h1", "h2").agg(F.sort_array(F.collect_set("vec_id")).alias("members")).where("size(members) > 1")


def most_similar(vectors: DataFrame, k: int = 10, least: float | None = None, dim: int = 96, probes: int = PROBES, rerank: int = RERANK) -> DataFrame:
    """query, other, similarity: the k nearest others of every vector in its namespace, by cosine similarity.

    vectors: vec_id, namespace, embedding. Rows without a usable vector (null, wrong length, not finite, all zero) and
    null ids or namespaces are left out; redelivered ids count once; ties go to the smaller id; with `least`, only
    neighbours that similar are given. Every vector is indexed and every vector is a query; namespaces of less than
    two cells' rows, or without a row in the fitting sample, are compared exactly; in others what is approximate is
    which cells a query looks into and which candidates of a cell are reranked. Equal vectors are one entry of the
    index, whose members (the smallest ids first) and neighbours all of them get. Crowded cells are split into blocks of
    vectors and of queries, each of which meet in one task.
    """
    spark = vectors.sparkSession
    source = vectors.where("vec_id is not null and namespace is not null").select("vec_id", "namespace", "embedding")
    sizes = {r[0]: r[1] for r in source.groupBy("namespace").count().collect()}
    total = sum(sizes.values())
    cells = sum(max(1, n // CELL) for n in sizes.values())
    share = min(1.0, min(SAMPLE, max(8_000, 24 * cells)) / max(total, 1))
    part = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    sample = source.where(part < share).select("namespace", "embedding").toArrow()
    x, keep = usable(sample.column("embedding"), dim)
    names = np.array(sample.column("namespace").to_pylist(), dtype=object)[keep]
    model = spark.sparkContext.broadcast(fit(names, x, sizes, dim))  # at most SAMPLE / 8 centres of either kind and two a namespace, of 4 * dim bytes
    if not sizes:
        return spark.createDataFrame([], "query bigint, other bigint, similarity double")
    classes = durable(_classes(source, dim, k))
    copied = classes.limit(1).count() > 0

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser = model.value
        for batch in batches:
            x, keep = usable(batch.column(2), dim)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[keep]
            spaces = np.array(batch.column(1).to_pylist(), dtype=object)[keep]
            for name in set(spaces):
                at = np.flatnonzero(spaces == name)
                v = x[at]
                own, rest = quantiser.own(name, v)
                best = quantiser.probed(name, v, own, probes)
                codes = quantiser.encode(v, rest)
                packed = codes[:, ::2] << 4 | codes[:, 1::2]
                raw = v.astype("<f4").tobytes()
                whole = [raw[i : i + 4 * dim] for i in range(0, len(raw), 4 * dim)]
                tight = packed.tobytes()
                width = packed.shape[1]
                held = [tight[i : i + width] for i in range(0, len(tight), width)]
                for p in range(best.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(best[:, p] + quantiser.first[name], pa.int64()), pa.array(ids[at], pa.int64()), pa.array(whole, pa.binary()), pa.array(held if p == 0 else [None] * len(at), pa.binary())], names=["cell", "id", "v", "codes"])

    entries = source
    if copied:  # of equal vectors the smallest id stands for all
        entries = _representatives(source, classes, dim)
    rows = entries.mapInArrow(assign, "cell bigint, id bigint, v binary, codes binary")
    rows = _blocks(rows) if _crowded(model.value, names, x, sizes) else rows.withColumns({"block": F.lit(0), "asking": F.lit(0), "asks": F.lit(True)})

    def search(table: pa.Table) -> pa.Table:
        quantiser = model.value
        table = table.combine_chunks()
        ids = table.column("id").to_numpy()
        _, once = np.unique(ids * 2 + np.asarray(table.column("codes").is_null()), return_index=True)  # a vector that both is in the cell and asks it stays twice
        table, ids = table.take(pa.array(once)), ids[once]
        base = ~np.asarray(table.column("codes").is_null())
        everything = np.frombuffer(b"".join(table.column("v").to_pylist()), dtype="<f4").reshape(-1, dim)
        tight = np.frombuffer(b"".join(table.column("codes").filter(pa.array(base)).to_pylist()), dtype=np.uint8).reshape(int(base.sum()), quantiser.books.shape[0] // 2)
        out_q, out_o, out_s = [], [], []
        if base.any():
            codes = np.empty((len(tight), tight.shape[1] * 2), dtype=np.uint8)
            codes[:, ::2], codes[:, 1::2] = tight >> 4, tight & 15
            vectors_, base_ids = everything[base], ids[base]
            asks = np.asarray(table.column("asks"))
            q_all, q_ids = everything[asks], ids[asks]  # a cell's own vectors ask it too, unless they come as queries of their own
            cell = table.column("cell")[0].as_py()
            centre = quantiser.centre_of(cell)
            wide = min(rerank + k, len(base_ids))
            for low in range(0, len(q_ids), 256):
                q, own = q_all[low : low + 256], q_ids[low : low + 256]
                if cell in quantiser.exact:
                    cand = np.broadcast_to(np.arange(len(base_ids)), (len(q), len(base_ids)))
                    exact = np.einsum("qd,cd->qc", q.astype(np.float64), vectors_.astype(np.float64), optimize=False)
                else:
                    score = _scan(quantiser.books, codes, q, centre)
                    cand = np.argpartition(-score, wide - 1, axis=1)[:, :wide]
                    exact = np.einsum("qd,qcd->qc", q.astype(np.float64), vectors_[cand].astype(np.float64), optimize=False)
                exact[base_ids[cand] == own[:, None]] = -2.0
                order = np.lexsort((base_ids[cand], -exact), axis=1)[:, :k]
                s = np.take_along_axis(exact, order, axis=1)
                good = s >= (-1.5 if least is None else least)
                out_q.append(np.repeat(own, good.sum(axis=1)))
                out_o.append(base_ids[np.take_along_axis(cand, order, axis=1)[good]])
                out_s.append(s[good])
        join = lambda a, t: pa.array(np.concatenate(a) if a else np.zeros(0), t)
        return pa.table({"query": join(out_q, pa.int64()), "other": join(out_o, pa.int64()), "similarity": join(out_s, pa.float64())})

    # Tasks keep their size as the table grows: each gets about ROWS_A_TASK rows, of some 400 bytes.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * probes // ROWS_A_TASK))
    found = rows.repartition(tasks, "cell", "block", "asking").groupBy("cell", "block", "asking").applyInArrow(search, "query bigint, other bigint, similarity double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "other"))
    near = found.dropDuplicates(["query", "other"]).withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
    return _with_copies(durable(near), _members(source, classes, dim), classes, k) if copied else near


def _keyed(source: DataFrame, dim: int) -> DataFrame:
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, keep = usable(batch.column(2), dim)
            kept = batch.take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([v.tobytes() for v in x.astype("<f4")], pa.binary())], names=["vec_id", "namespace", "embedding", "v"])

    whole = source.mapInArrow(hashed, "vec_id bigint, namespace string, embedding array<float>, v binary")
    return whole.select("vec_id", "namespace", "embedding", F.xxhash64("namespace", "v").alias("h1"), F.xxhash64("v", F.lit(17), "namespace").alias("h2"))


def _representatives(source: DataFrame, classes: DataFrame, dim: int) -> DataFrame:
    """The source without the ids that an equal vector with a smaller id stands for."""
    joined = join_hot(_keyed(source, dim), classes.select("h1", "h2", F.col("members")[0].alias("rep")), ["h1", "h2"], "left")
    return joined.where("rep is null or rep = vec_id").select("vec_id", "namespace", "embedding")


def _members(source: DataFrame, classes: DataFrame, dim: int) -> DataFrame:
    """vec_id, rep: every id of a class of equal vectors."""
    keys = _keyed(source, dim).select("vec_id", "h1", "h2").distinct()
    return join_hot(keys, classes.select("h1", "h2", F.col("members")[0].alias("rep")), ["h1", "h2"]).select("vec_id", "rep")


def _with_copies(near: DataFrame, members: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """Neighbours of representatives carried over to all members of their classes.

    A class needs only its k + 1 nearest ids (its own smallest ones first), of which each member leaves out itself.
    """
    listed = classes.select(F.col("members")[0].alias("rep"), "members")
    others = near.join(listed.select(F.col("rep").alias("other"), "members"), "other", "left").select("query", "similarity", F.explode(F.coalesce("members", F.array("other"))).alias("other"))
    inside = listed.select(F.col("rep").alias("query"), F.lit(1.0).alias("similarity"), F.explode("members").alias("other"))
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "other"))
    best = durable(others.unionByName(inside).withColumn("rank", order).where(F.col("rank") <= k + 1).drop("rank"))
    alone = best.join(listed.select(F.col("rep").alias("query")), "query", "left_anti")
    shared = best.join(listed.select(F.col("rep").alias("query")), "query").groupBy("query").agg(F.collect_list(F.struct("similarity", "other")).alias("near"))  # k + 1 at most
    spread = join_hot(members.withColumnRenamed("rep", "query"), shared, ["query"]).select("vec_id", F.explode("near").alias("n")).select(F.col("vec_id").alias("query"), F.col("n.other").alias("other"), F.col("n.similarity").alias("similarity"))
    every = alone.select("query", "other", "similarity").unionByName(spread).where("query <> other")
    return every.withColumn("rank", order).where(F.col("rank") <= k).drop("rank")


def _crowded(model: Quantiser, names: np.ndarray, x: np.ndarray, sizes: dict[str, int]) -> bool:
    """Whether the sample says that a cell holds more than a block (then the cells are counted)."""
    for name in model.centres:
        mine = x[names == name]
        if not len(mine):
            if sizes[name] > BLOCK * 0.75:
                return True
            continue
        share = np.bincount(model.own(name, mine)[0]).max() / len(mine)
        if share * sizes[name] > BLOCK * 0.75:
            return True
    return False


def _blocks(rows: DataFrame) -> DataFrame:
    """Cells of more than BLOCK vectors or ASKING queries split: each vector is in one block of its cell, each query in one
    part of those that ask it, and every block meets every part."""
    cells = rows.groupBy("cell").agg(F.ceil(F.count("codes") / BLOCK).cast("int").alias("n_blocks"), F.ceil(F.count("*") / ASKING).cast("int").alias("n_asking"))
    crowded = cells.where("n_blocks > 1 or n_asking > 1")
    joined = join_hot(rows, crowded, ["cell"], "left").withColumns({"n_blocks": F.coalesce("n_blocks", F.lit(1)), "n_asking": F.coalesce("n_asking", F.lit(1))})
    block, asking = F.pmod(F.xxhash64("id", F.lit(3)), F.col("n_blocks")).cast("int"), F.pmod(F.xxhash64("id", F.lit(5)), F.col("n_asking")).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    one = (F.col("n_blocks") == 1) & (F.col("n_asking") == 1)
    plain = joined.where(one).select("cell", "id", "v", "codes", F.lit(0).alias("block"), F.lit(0).alias("asking"), F.lit(True).alias("asks"))
    # In a split cell a vector is sent as a vector to the parts that ask its block and as a query to the blocks its part asks.
    base = joined.where(~one & F.col("codes").isNotNull()).select("cell", "id", "v", "codes", block.alias("block"), F.explode(upto("n_asking")).alias("asking"), F.lit(False).alias("asks"))
    ask = joined.where(~one).select("cell", "id", "v", F.lit(None).cast("binary").alias("codes"), F.explode(upto("n_blocks")).alias("block"), asking.alias("asking"), F.lit(True).alias("asks"))
    return plain.unionByName(base).unionByName(ask)
