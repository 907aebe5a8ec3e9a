"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified pairs.

Equal vectors of a label are one vector with a number of copies. Each table hashes a vector ``hashes`` times: signs are
flipped and a Hadamard transform applied, three times over, and the hash is the axis, with its sign, nearest to the
result. A vector stands in the bucket of its nearest axes and, for each hash, in the one where that hash takes its second
nearest axis. A bucket is known by its label, dimension, table and code, never by a hash of them. Only buckets with company
carry vectors, with all their codes; in a bucket, blocks of vectors are multiplied, and pairs at or above the threshold are
counted in the first bucket they share, so none counts twice and no pair is ever a row. Buckets of over ``cell_rows``
vectors are dealt in pairs of chunks.

More vectors take more hashes a table, so that buckets stay small, and more tables, so that a pair at the threshold is found
as surely: over 64 dimensions a pair at cosine 0.93 with probability 0.9999 (2 hashes find it in a table with 0.72, 3 with
0.56, 4 with 0.41, measured; so 8, 12 and 18 tables).

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label,
link with nothing and are their own component; labels of any type that Spark can group by are compared as they are; vectors
of different lengths are never linked; equal rows count as vectors of their own; a null id takes part and counts, though a
component is named by the smallest id that is not null. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import components, cut
from tideline.llm.simhash_dedup import _unite

BLOCK = 512
#: Tables for each number of hashes, and how full the buckets of a label may become before one more hash is taken.
TABLES = {2: 8, 3: 12, 4: 18}
FULL = 4096


def usable(vector: str) -> F.Column:
    """Whether a vector has components, all of them finite, and not all of them zero."""
    v = F.col(vector).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # else squares may overflow
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and a fast Hadamard transform; the width is a power of two."""
    n, d = x.shape
    rng = np.random.default_rng(seed)
    for _ in range(3):
        x = x * rng.choice((-1.0, 1.0), d)
        h = 1
        while h < d:
            x = x.reshape(n, d // (2 * h), 2, h)
            x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
            h *= 2
    return x


def buckets(x: np.ndarray, tables: int, hashes: int) -> np.ndarray:
    """(rows, tables, 1 + hashes) bucket codes of unit vectors: the main one, then one for each hash's second axis."""
    n, d = x.shape
    wide = 1 << max(1, (d - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, wide - d)))
    out = np.empty((n, tables, 1 + hashes), np.int64)
    for t in range(tables):
        best, second = [], []
        for h in range(hashes):
            y = rotate(x, 1000 * t + h)
            size = np.abs(y)
            for axes in (best, second):
                axis = size.argmax(axis=1)
                axes.append(axis * 2 + (y[np.arange(n), axis] < 0))
                size[np.arange(n), axis] = -1
        for p in range(1 + hashes):
            code = np.zeros(n, np.int64)
            for h in range(hashes):
                code = code * 2 * wide + (second if p == h + 1 else best)[h]
            out[:, t, p] = code
    return out


def _first_shared(codes: np.ndarray, i: np.ndarray, j: np.ndarray, table: int, code: int) -> np.ndarray:
    """Whether (table, code) is the first bucket that both rows of each pair stand in."""
    ok = np.ones(len(i), bool)
    for t in range(table):
        live = np.flatnonzero(ok)
        if not len(live):
            return ok
        ok[live] = ~(codes[i[live], t][:, :, None] == codes[j[live], t][:, None, :]).any(axis=(1, 2))
    live = np.flatnonzero(ok)
    a, b = codes[i[live], table], codes[j[live], table]
    shared = np.where((a[:, :, None] == b[:, None, :]).any(axis=2), a, np.iinfo(np.int64).max).min(axis=1)
    ok[live] = shared == code
    return ok


def plan(n: int, dim: int) -> tuple[int, int]:
    """(tables, hashes) for so many vectors of one label."""
    axes = 2 << max(1, (dim - 1).bit_length())
    hashes = next((h for h in sorted(TABLES) if n * (1 + h) <= FULL * axes**h), max(TABLES))
    return TABLES[hashes], hashes


def link(vectors: DataFrame, threshold: float, tables: int, hashes: int, cell_rows: int) -> DataFrame:
    """vectors (rep, label, vector, copies), each vector once: (a, b, n) rows, which are n links of a where b is null,
    else an edge of a forest over the links."""
    kind = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    each = tables * (1 + hashes)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy().astype(np.float64)
            starts = np.cumsum(sizes) - sizes
            out = np.empty((len(batch), each), np.int64)
            for d in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == d)
                out[own] = buckets(unit(flat[starts[own][:, None] + np.arange(d)]), tables, hashes).reshape(len(own), each)
            made = pa.ListArray.from_arrays(np.arange(0, out.size + 1, each, dtype=np.int32), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "codes"])

    hashed = cut(vectors.select("rep", "label", "vector", "copies").mapInArrow(codes, f"rep long, label {kind['label']}, vector {kind['vector']}, copies long, codes array<long>"))
    rows = hashed.select("rep", "label", F.size("vector").alias("dim"), F.posexplode("codes").alias("at", "code"))
    rows = rows.select("rep", "label", "dim", F.expr(f"at div {1 + hashes}").cast("int").alias("tab"), "code")
    key = ["label", "dim", "tab", "code"]
    crowd = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.ceil(F.col("n") / cell_rows).cast("int").alias("chunks"))
    rows = rows.join(crowd, key).withColumn("own", F.expr("pmod(xxhash64(rep, 7), chunks)").cast("int"))
    rows = rows.select("*", F.expr("explode(CASE WHEN chunks = 1 THEN array(0) ELSE filter(sequence(0, chunks - 1), x -> x <> own) END)").alias("other"))
    rows = rows.withColumn("low", F.least("own", "other")).withColumn("high", F.when(F.col("chunks") > 1, F.greatest("own", "other")).otherwise(0))
    within = ((F.col("own") + 1) % F.col("chunks") == F.col("other")).alias("within")
    cell = [*key, "low", "high"]
    rows = rows.join(hashed.select("rep", "vector", "copies", "codes"), "rep").select(*cell, "rep", "vector", "copies", "codes", "own", within)

    def changes(t: pa.Table) -> np.ndarray:
        """Where a row's cell is not that of the row before it."""
        new = np.zeros(len(t), bool)
        new[:1] = True
        for c in cell:
            v = t.column(c).combine_chunks()
            v = (v.dictionary_encode().indices if c == "label" else v).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return new

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= 1 << 14:
                whole = pa.Table.from_batches(held)
                end = int(np.flatnonzero(changes(whole))[-1])
                if end:
                    yield cells(whole.slice(0, end))
                    held = whole.slice(end).to_batches()
        if held:
            yield cells(pa.Table.from_batches(held))

    def cells(t: pa.Table) -> pa.RecordBatch:
        t = pa.Table.from_batches(t.combine_chunks().to_batches()) if len(t) else t
        column = lambda c: t.column(c).combine_chunks()
        reps, tab, code, copies, own, sizes = (column(c).to_numpy() for c in ("rep", "tab", "code", "copies", "own", "dim"))
        within = column("within").to_numpy(zero_copy_only=False)
        standing = column("codes").flatten().to_numpy().reshape(len(t), tables, 1 + hashes)
        flat = column("vector").flatten().to_numpy().astype(np.float64)
        starts = np.cumsum(sizes.astype(np.int64)) - sizes
        edges = np.append(np.flatnonzero(changes(t)), len(t))
        out: list[list[np.ndarray]] = [[], [], []]
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            d, m = int(sizes[low]), high - low
            if m < 2:
                continue
            x = unit(flat[starts[low] : starts[low] + m * d].reshape(m, d))
            pairs = []
            for at in range(0, m, BLOCK):
                near = x[at : at + BLOCK] @ x[at:].T >= threshold
                i, j = np.nonzero(np.triu(near, 1))
                i, j = i + at + low, j + at + low
                keep = (own[i] != own[j]) | within[i]
                pairs.append((i[keep], j[keep]))
            i, j = (np.concatenate(p) - low for p in zip(*pairs, strict=True))
            if not len(i):
                continue
            new = _first_shared(standing[low:high], i, j, int(tab[low]), int(code[low]))
            i, j = i[new], j[new]
            n = np.bincount(i, copies[low:high][j], m) + np.bincount(j, copies[low:high][i], m)
            parent = _unite(np.arange(m), i, j)
            hit, child = np.flatnonzero(n), np.flatnonzero(parent != np.arange(m))
            out[0] += [reps[low + hit], reps[low + child]]
            out[1] += [np.full(len(hit), -1), reps[low + parent[child]]]
            out[2] += [n[hit].astype(np.int64), np.zeros(len(child), np.int64)]
        a, b, n = (np.concatenate(o) if o else np.empty(0, np.int64) for o in out)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "n"])

    return rows.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(compare, "a long, b long, n long")


def near_duplicates(table: DataFrame, threshold: float = 0.93, tables: int | None = None, hashes: int | None = None, cell_rows: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of table."""
    kind = table.schema[vector_col].dataType
    vector = F.col(vector_col) if kind.simpleString() in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), vector.alias("vector"), (usable(vector_col) & F.col(label_col).isNotNull()).alias("part"))
    rows = rows.select("*", F.when(F.col("part"), F.xxhash64("label", "vector")).alias("h1"), F.when(F.col("part"), F.xxhash64(F.lit(1), "label", "vector")).alias("h2"))
    # the nodes of the graph are numbered by the smallest id of equal vectors; those whose ids are all null, below zero
    rep = F.coalesce(F.min("vec_id"), F.lit(-2) - F.abs(F.col("h1") % (1 << 62)))
    distinct = cut(rows.where("part").groupBy("h1", "h2").agg(rep.alias("rep"), F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector")))
    most = distinct.groupBy("label", F.size("vector").alias("dim")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "dim")).alias("x")).first()["x"]
    made = plan(most["n"], most["dim"]) if most else plan(0, 1)
    found = cut(link(distinct, threshold, tables or made[0], hashes or made[1], cell_rows))
    counts = found.where("b = -1").groupBy("a").agg(F.sum("n").alias("n")).select(F.col("a").alias("rep"), "n")
    roots = components(found.where("b <> -1").select("a", "b")).select(F.col("node").alias("rep"), "root")
    of = distinct.select("h1", "h2", "rep", "least", "copies").join(counts, "rep", "left").join(roots, "rep", "left")
    of = of.withColumn("root", F.coalesce("root", "rep"))
    named = of.groupBy("root").agg(F.min("least").alias("component"))
    of = of.join(named, "root").select("h1", "h2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component")
    out = rows.select("vec_id", "part", "h1", "h2").join(of, ["h1", "h2"], "left")
    component = F.when(F.col("part"), F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
