"""Nearest neighbours by a permutation index: footrule distance ranks, inner products rerank.

A vector is represented by the numbers of its ``prefix`` nearest pivots, nearest first, and posted in the inverted file of
its nearest one. A query visits the files of the ``visits`` share of pivots nearest to it. There its footrule distance to
every posting is added up (the sum over pivots of how far apart their two positions are, a pivot outside a prefix standing
at its end), and only postings within the query's footrule bound are reranked by inner product in double precision.

The bound is the query's own: it asks for that share of all rows, by footrule, that held ``coverage`` of the k nearest of
sampled queries as crowded as itself (crowding is the mean of the k least footrule distances to the sample; shares are
fitted in ranges of it), and reads the bound off its distances to the sample. So it holds as many candidates for a lone
vector as its loneliness asks for. The k nearest of a table are nearer than those of a sample of it, so recall grows.

What a query visits may hold fewer than k rows; such queries meet all rows, in blocks. With ``exact`` each query is made
exact by a second pass: rows are also dealt in cells, by their nearest anchor (the first pivots) and the angle to it; of a cell the ranges of
its rows' angles to all anchors and the longest vector are known. As angles obey the triangle inequality, they bound the
scores of a query in a cell, and the query meets all rows of each cell whose bound reaches its k-th score: few cells on
clustered vectors, all of them on vectors without structure.

Files, and cells, are dealt in chunks of ``chunk_rows`` at most (and in 16 at least), small ones together and large ones in
several, and chunks meet queries in blocks, so no task holds more. Pivots (as many as the root of the number of rows, 256 at least, 4,096 at most)
and shares are fitted on at most ``sample_rows`` vectors, those whose ids hash lowest. Every row is posted.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do those with
a null id or of another length than the sample's commonest; rows with the query's id are the query's own; a query id that
occurs twice is one query, of its least vector; ties go to smaller ids. An empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import cut
from tideline.llm.embedding_dedup import usable

PIVOTS = (256, 4096)
#: Queries and rows of a tile that footrule distances are added up in, so that it stays in a cache.
TILE_QUERIES, TILE_ROWS = 64, 1024
#: Cells of the exact pass: pivots that anchor them and ranges of the angle to the nearest.
ANCHORS, BANDS = 64, 16
#: As many chunks at least; a query has k rows of each that it meets, so this must not grow with a small table.
LEAST_CHUNKS = 16
#: Ranges of crowding that have shares of their own.
RANGES = 8


def permutations(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of each row's nearest pivots, nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int16)


def positions(perms: np.ndarray, n_pivots: int) -> np.ndarray:
    """(pivots, rows): where each pivot stands in each row's permutation; past its end if it isn't there."""
    n, m = perms.shape
    out = np.full((n_pivots, n), m, np.int32 if m > 180 else np.uint16)
    out[perms.T, np.arange(n)] = np.arange(m)[:, None]
    return out


def footrules(queries: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(queries, rows) footrule distances of permutations to rows of known positions. With i and p the positions of a
    pivot of the query, |i - p| and what the row's own pivots add come to 2 max(i, p) and a constant."""
    m = queries.shape[1]
    out = np.zeros((len(queries), at.shape[1]), at.dtype)
    for i in range(m):
        p = at[queries[:, i]]
        out += np.maximum(p, at.dtype.type(i), out=p)
    return 2 * out.astype(np.int32) - (m * (m - 1) // 2 + m * m - m * (m + 1) // 2)


@dataclass
class Index:
    """What is fitted on the sample."""

    pivots: np.ndarray  # of length 1
    perms: np.ndarray  # of the sample
    ids: np.ndarray
    edges: np.ndarray  # of the ranges of crowding
    shares: np.ndarray  # one more
    k: int

    @property
    def prefix(self) -> int:
        return self.perms.shape[1]

    def bounds(self, perms: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The footrule bound of each query."""
        out = np.empty(len(perms), np.int32)
        at = positions(self.perms, len(self.pivots))
        for low in range(0, len(perms), TILE_QUERIES):
            far = np.sort(np.where(self.ids[None, :] == ids[low : low + TILE_QUERIES, None], 1 << 30, footrules(perms[low : low + TILE_QUERIES], at)), axis=1)
            share = self.shares[np.searchsorted(self.edges, far[:, : self.k].mean(axis=1))]
            place = np.minimum(np.ceil(share * far.shape[1]).astype(int), far.shape[1] - 1)
            out[low : low + len(far)] = far[np.arange(len(far)), place]
        return out


def fit(x: np.ndarray, ids: np.ndarray, n_pivots: int, prefix: int, k: int, coverage: float, asked: int = 384) -> Index:
    """Pivots, and the shares of rows by footrule that hold ``coverage`` of the k nearest of sampled queries."""
    pivots = x[:n_pivots] / np.linalg.norm(x[:n_pivots], axis=1, keepdims=True)
    perms = permutations(x, pivots, min(prefix, len(pivots)))
    at, n = positions(perms, len(pivots)), len(x)
    crowding, shares = [], []
    for i in range(min(asked, n)):
        others = np.flatnonzero(ids != ids[i])
        if not len(others):
            continue
        far = footrules(perms[i : i + 1], at)[0][others]
        best = others[np.argsort(-(x[others] @ x[i]), kind="stable")[:k]]
        ranks = np.searchsorted(np.sort(far), footrules(perms[i : i + 1], at[:, best])[0], "right") / len(others)
        crowding.append(np.sort(far)[:k].mean())
        shares.append(ranks)
    if not shares:
        return Index(pivots, perms, ids, np.empty(0), np.ones(1), k)
    edges = np.unique(np.quantile(crowding, np.arange(1, RANGES) / RANGES))
    place = np.searchsorted(edges, crowding)
    held = [np.concatenate([s for s, p in zip(shares, place, strict=True) if p == r] or [np.ones(1)]) for r in range(len(edges) + 1)]
    return Index(pivots, perms, ids, edges, np.array([np.quantile(h, coverage) for h in held]), k)


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """(rows, pivots) angles; pivots have length 1."""
    return np.arccos(np.clip((x @ pivots.T) / np.linalg.norm(x, axis=1, keepdims=True), -1, 1))


def cells_of(angle: np.ndarray) -> np.ndarray:
    """The number of each row's cell: its nearest anchor and the band of its angle to it."""
    first = angle.argmin(axis=1).astype(np.int32)
    band = (angle[np.arange(len(first)), first] * (BANDS / np.pi)).astype(np.int32)
    return first * BANDS + np.minimum(band, BANDS - 1)


def _reach(x: np.ndarray, least: np.ndarray, angle: np.ndarray, long: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(queries, cells): whether some vector within the cell's ranges may score least or more. The slack covers rounding."""
    gap = np.zeros((len(x), len(long)))
    for p in range(angle.shape[1]):
        a = angle[:, p : p + 1]
        np.maximum(gap, np.maximum(low[None, :, p] - a, a - high[None, :, p]), out=gap)
    most = np.linalg.norm(x, axis=1)[:, None] * long[None, :]
    return most * (np.maximum(np.cos(np.clip(gap - 1e-6, 0, np.pi)), 0) + 1e-9) + 1e-9 >= least[:, None]


def best_of(q: np.ndarray, r: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best pairs of each query; ties to smaller ids."""
    order = np.lexsort((ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    own = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[own], r[own], score[own]


def meet(queries: dict[str, np.ndarray], rows: dict[str, np.ndarray], index: Index, visits: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, row, score) of each query's k nearest candidates among the rows of one chunk, and how many were reranked."""
    found: list[tuple[np.ndarray, ...]] = []
    reranked = 0
    n = len(index.pivots)
    order = np.argsort(rows["file"], kind="stable")
    visited = permutations(queries["x"], index.pivots, max(visits, index.prefix))
    perms = visited[:, : index.prefix]
    goes = positions(visited[:, :visits], n) < visits
    edges = np.flatnonzero(np.diff(rows["file"][order], prepend=-1, append=n))
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        who = np.flatnonzero(goes[rows["file"][order[low]]])
        for a in range(low, high, TILE_ROWS) if len(who) else ():
            r = order[a : min(a + TILE_ROWS, high)]
            x, ids = rows["x"][r], rows["ids"][r]
            at = positions(permutations(x, index.pivots, index.prefix), n)
            for b in range(0, len(who), TILE_QUERIES):
                q = who[b : b + TILE_QUERIES]
                i, j = np.nonzero((footrules(perms[q], at) <= queries["bound"][q, None]) & (queries["ids"][q, None] != ids[None, :]))
                reranked += len(i)
                score = np.einsum("ij,ij->i", queries["x"][q[i]], x[j])  # one way of summing, so equal vectors tie
                i, j, score = best_of(i, j, score, ids, k)
                found.append((q[i], r[j], score))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), 0
    return *best_of(*(np.concatenate(f) for f in zip(*found, strict=True)), rows["ids"], k), reranked


def scan_block(queries: dict[str, np.ndarray], rows: dict[str, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """As meet(), of all rows that score the query's least or more."""
    found: list[tuple[np.ndarray, ...]] = []
    for b in range(0, len(queries["ids"]), 128):
        q = slice(b, b + 128)
        rough = np.where(queries["ids"][q, None] != rows["ids"][None, :], queries["x"][q] @ rows["x"].T, -np.inf)
        least = np.maximum(queries["least"][q], np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else -np.inf)
        slack = 1e-9 * np.maximum(1, np.abs(np.where(np.isfinite(least), least, 0)))
        i, j = np.nonzero((rough >= (least - slack)[:, None]) & np.isfinite(rough))
        i, j, score = best_of(i, j, np.einsum("ij,ij->i", queries["x"][q][i], rows["x"][j]), rows["ids"], k)
        found.append((i + b, j, score))
    return *(np.concatenate(f) for f in zip(*found, strict=True)), len(queries["ids"]) * len(rows["ids"])


def dealt(sizes: dict[int, int], chunk_rows: int) -> tuple[dict[int, int], dict[int, int], int]:
    """The first chunk of each group and how many it is dealt in, and the number of chunks: small groups share one."""
    chunk_rows = max(1, min(chunk_rows, -(-sum(sizes.values()) // LEAST_CHUNKS)))
    firsts, spans, chunks, filled = {}, {}, 0, chunk_rows
    for g in sorted(sizes):
        spans[g] = -(-sizes[g] // chunk_rows)
        if filled + sizes[g] > chunk_rows:
            firsts[g], chunks, filled = chunks, chunks + spans[g], 0
        else:
            firsts[g] = chunks - 1
        filled = chunk_rows if spans[g] > 1 else filled + sizes[g]
    return firsts, spans, chunks


def _unpack(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), dim)


def _number(of: dict[int, int], n: int, group: str) -> Column:
    return F.element_at(F.array(*(F.lit(of.get(g, 0)) for g in range(n))), F.col(group).cast("int") + 1)


def _place(n: Column | int) -> Column:
    return F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(n) if isinstance(n, int) else n).cast("int")


FOUND = "query_id long, vec_id long, score double"


def _meetings(held: DataFrame, asked: DataFrame, dim: int, down: int, run, counter: Accumulator | None) -> DataFrame:  # noqa: ANN001
    """held (vec_id, vector, file, chunk) meets asked (vec_id, vector, bound, least, chunks), chunk by chunk and in ``down``
    blocks of queries."""
    own = held.select("vec_id", "vector", "file", F.lit(None).cast("int").alias("bound"), F.lit(None).cast("double").alias("least"), "chunk", F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("d"))
    sent = asked.select("vec_id", "vector", F.lit(-1).alias("file"), "bound", "least", F.explode("chunks").alias("chunk"), _place(down).alias("d"))

    def group(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        one = lambda c: t.column(c).combine_chunks()
        whole = {"ids": one("vec_id").to_numpy(), "x": _unpack(one("vector"), dim), "file": one("file").to_numpy()}
        asks = one("bound").is_valid().to_numpy(zero_copy_only=False)
        i, j, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        rows, queries = ({c: v[own] for c, v in whole.items()} for own in (~asks, asks))
        if asks.any() and not asks.all():
            queries |= {"bound": t.column("bound").to_numpy()[asks].astype(np.int32), "least": t.column("least").to_numpy()[asks]}
            i, j, score, products = run(queries, rows)
            if counter is not None:
                counter.add(products)
        return pa.table({"query_id": pa.array(queries["ids"][i], pa.int64()), "vec_id": pa.array(rows["ids"][j], pa.int64()), "score": pa.array(score, pa.float64())})

    return own.union(sent).groupBy("chunk", "d").applyInArrow(group, FOUND)


def search(
    table: DataFrame, is_query: Column, k: int = 20, prefix: int = 96, visits: float = 0.75, coverage: float = 0.985, sample_rows: int = 2048, chunk_rows: int = 65536, query_rows: int = 65536,
    exact: bool = False, counter: Accumulator | None = None, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows of table to each of its rows that is_query holds of. counter
    adds up the inner products of queries and rows (of the index, not of fitting it)."""
    rows = table.where(usable(vector_col) & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    sample = rows.select("vec_id", F.col("vector").cast("array<double>").alias("vector")).orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(sample_rows).collect()
    if not sample:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = [len(r["vector"]) for r in sample]
    dim = max(set(sizes), key=lambda d: (sizes.count(d), -d))
    rows = rows.where(F.size("vector") == dim)
    sample = [r for r in sample if len(r["vector"]) == dim]
    n_pivots = max(PIVOTS[0], min(PIVOTS[1], int(rows.count() ** 0.5)))
    index = fit(np.array([r["vector"] for r in sample], np.float64), np.array([r["vec_id"] for r in sample]), n_pivots, prefix, k, coverage)
    pivots, n_pivots = index.pivots, len(index.pivots)
    n_visits = max(1, round(visits * n_pivots))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _unpack(batch.column("vector"), dim)
            file, cell = (v @ pivots.T).argmax(axis=1), cells_of(angles(v, pivots[:ANCHORS]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(file, pa.int32()), pa.array(cell, pa.int32())], ["vec_id", "vector", "asks", "file", "cell"])

    kind = rows.schema["vector"].dataType.simpleString()
    posted = cut(rows.mapInArrow(post, f"vec_id long, vector {kind}, asks boolean, file int, cell int"))
    queries = posted.where("asks").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    counts = {r["file"]: r["n"] for r in posted.groupBy("file").agg(F.count("*").alias("n")).collect()}  # a row a pivot
    firsts, spans, chunks = dealt(counts, chunk_rows)
    held = posted.withColumn("chunk", _number(firsts, n_pivots, "file") + _place(F.greatest(_number(spans, n_pivots, "file"), F.lit(1))))
    members = np.zeros((n_pivots, chunks), bool)
    for f in counts:
        members[f, firsts[f] : firsts[f] + spans[f]] = True

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = permutations(_unpack(batch.column("vector"), dim), pivots, max(n_visits, index.prefix))
            bound = pa.array(index.bounds(p[:, : index.prefix], batch.column("vec_id").to_numpy()), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, bound, pa.nulls(len(batch), pa.float64()), _lists([np.flatnonzero(members[x].any(axis=0)) for x in p[:, :n_visits]])], ["vec_id", "vector", "bound", "least", "chunks"])

    asked = cut(queries.mapInArrow(route, f"vec_id long, vector {kind}, bound int, least double, chunks array<int>"))
    down = -(-asked.count() // query_rows) or 1
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    met = _meetings(held, asked, dim, down, lambda q, r: meet(q, r, index, n_visits, k), counter)
    found = cut(top(met).select("query_id", "vec_id", "score"))
    least = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    again = asked.drop("least", "chunks").join(least, "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    again = cut(again if exact else again.where(F.col("least") == float("-inf")))
    if not again.isEmpty():
        whole = _scan_cells(posted, again, kind, pivots[:ANCHORS], k, chunk_rows, query_rows, counter)
        found = found.join(again.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").union(whole)
    return top(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _lists(parts: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)]).astype(np.int32), pa.array(np.concatenate([*parts, np.empty(0)]), pa.int32()))


def _scan_cells(posted: DataFrame, asked: DataFrame, kind: str, pivots: np.ndarray, k: int, chunk_rows: int, query_rows: int, counter: Accumulator | None) -> DataFrame:
    """(query_id, vec_id, score): the k nearest rows, and ties, of each query of asked, whose ``least`` some k rows reach."""
    n_pivots, dim = pivots.shape
    n_cells = n_pivots * BANDS

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, long = np.zeros(n_cells, np.int64), np.zeros(n_cells)
        low, high = np.full((n_cells, n_pivots), np.inf), np.full((n_cells, n_pivots), -np.inf)
        for batch in batches:
            v, cell = _unpack(batch.column(1), dim), batch.column(0).to_numpy()
            a = angles(v, pivots)
            np.add.at(n, cell, 1)
            np.maximum.at(long, cell, np.linalg.norm(v, axis=1))
            np.minimum.at(low, cell, a)
            np.maximum.at(high, cell, a)
        at = np.flatnonzero(n)
        lists = [pa.array(list(side[at]), pa.list_(pa.float64())) for side in (low, high)]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(long[at]), *lists], ["cell", "n", "long", "low", "high"])

    def merge(t: pa.Table) -> pa.Table:
        low, high = (np.array(t.column(c).to_pylist()) for c in ("low", "high"))
        return pa.table({"cell": t.column("cell")[:1], "n": [sum(t.column("n").to_pylist())], "long": [max(t.column("long").to_pylist())], "low": [low.min(axis=0)], "high": [high.max(axis=0)]})

    ranges = "cell int, n long, long double, low array<double>, high array<double>"
    cells = posted.select("cell", "vector").mapInArrow(measure, ranges).groupBy("cell").applyInArrow(merge, ranges).collect()  # a row a cell
    cells.sort(key=lambda r: r["cell"])
    long, low, high = np.array([r["long"] for r in cells]), np.array([r["low"] for r in cells]), np.array([r["high"] for r in cells])
    firsts, spans, chunks = dealt({r["cell"]: r["n"] for r in cells}, chunk_rows)
    members = np.zeros((len(cells), chunks), bool)
    for i, r in enumerate(cells):
        members[i, firsts[r["cell"]] : firsts[r["cell"]] + spans[r["cell"]]] = True

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, least = _unpack(batch.column("vector"), dim), batch.column("least").to_numpy()
            to = [np.flatnonzero(x) for x in _reach(v, least, angles(v, pivots), long, low, high) @ members] if len(batch) else []
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(to)], [*batch.schema.names, "chunks"])

    held = posted.select("vec_id", "vector", F.col("cell").alias("file"), (_number(firsts, n_cells, "cell") + _place(F.greatest(_number(spans, n_cells, "cell"), F.lit(1)))).alias("chunk"))
    sent = asked.select("vec_id", "vector", "bound", "least").mapInArrow(route, f"vec_id long, vector {kind}, bound int, least double, chunks array<int>")
    down = -(-asked.count() // query_rows) or 1
    return _meetings(held, sent, dim, down, lambda q, r: scan_block(q, r, k), counter)
