"""Near-duplicates by SimHash: bit-sliced comparison of fingerprints.

A fingerprint has 64 bits: bit b is 1 if bit b is set in over half the XXH64 (seed 42) of the document's shingles.
Fingerprints within ``radius`` bits are linked. Two that differ in at most r bits agree on g - r of any g groups of
bits, so every pair meets in one of C(g, r) tables keyed by g - r groups; g grows with the number of fingerprints, which
changes the work and never the links. In a bucket the 64 bit planes stand as packed columns over the rows; row i is held
against row i + d for all i at once, the differing bits are counted by carry-save adders on whole machine words, and
words in which every lane has exceeded the radius are abandoned. Buckets of over ``cell_rows`` fingerprints are dealt in
pairs of chunks, so none must fit one task. Only a spanning forest of a bucket's links leaves it.

Defined results: null and empty texts have fingerprint zero, linked like any other; fewer words than a shingle make one
shingle; ids are taken as unique, and equal rows give equal rows; a row with a null id shares the component of its
fingerprint's other rows (null if there is none). An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import components, cut, whole_row

SEED = 42


def fingerprint(text: str | None, words: int = 4) -> int:
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(w) < words:
        hashes = [digest(join(w), SEED)]
    else:
        hashes = [digest(join(s), SEED) for s in zip(*(w[i:] for i in range(words)), strict=False)]
    total = np.zeros(64, np.int64)
    h = np.array(hashes, np.uint64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    bits = total * 2 > len(h)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hooks larger roots to smaller ones until every pair has one root."""
    while True:
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            return parent
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def near_pairs(run: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, i + d) of rows of one run whose fingerprints differ in at most ``radius`` < 8 bits. run ascends."""
    n = len(fp)
    if n < 2:
        return
    bits = np.unpackbits(fp.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    wide = (n + 63) // 64
    planes = np.zeros((64, 2 * wide + 2), np.uint64)
    planes[:, :wide] = np.ascontiguousarray(np.packbits(np.pad(bits.T, ((0, 0), (0, wide * 64 - n))), axis=1, bitorder="little")).view(np.uint64)
    edges = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1], [True])))
    for d in range(1, int(np.diff(edges).max())):
        same = np.zeros(wide * 64, np.uint8)
        same[: n - d] = run[:-d] == run[d:]
        valid = np.packbits(same, bitorder="little").view(np.uint64)
        at = np.flatnonzero(valid)
        lanes = valid[at]
        q, r = divmod(d, 64)
        left, right = np.uint64(64 - r), np.uint64(r)
        start = 7 - radius  # so that the fourth bit appears when the radius is exceeded
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        c0, c1, c2 = (np.full(len(at), full if start >> k & 1 else np.uint64(0)) for k in range(3))
        over = np.zeros(len(at), np.uint64)
        for b in range(64):
            p = planes[b]
            x = p[at] ^ ((p[at + q] >> right) | (p[at + q + 1] << left) if r else p[at + q])
            t = c0 & x
            c0 ^= x
            u = c1 & t
            c1 ^= t
            over |= c2 & u
            c2 ^= u
            if b % 8 == 7:
                alive = (lanes & ~over) != 0
                if not alive.any():
                    at = at[:0]
                    break
                if alive.mean() < 0.7:
                    at, lanes, c0, c1, c2, over = (v[alive] for v in (at, lanes, c0, c1, c2, over))
        if len(at):
            near = np.unpackbits((lanes & ~over).view(np.uint8), bitorder="little").reshape(-1, 64)
            word, lane = np.nonzero(near)
            i = at[word] * 64 + lane
            yield i, i + d


def _forest(cell: np.ndarray, fp: np.ndarray, doc: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    pair = cell[1:] == cell[:-1]
    some = np.concatenate(([False], pair)) | np.concatenate((pair, [False]))
    cell, fp, doc = cell[some], fp[some], doc[some]
    parent, held, size = np.arange(len(fp)), [], 0
    for i, j in near_pairs(cell, fp, radius):
        held.append((i, j))
        size += len(i)
        if size > 1 << 20:
            parent, held, size = _unite(parent, *map(np.concatenate, zip(*held, strict=True))), [], 0
    if held:
        parent = _unite(parent, *map(np.concatenate, zip(*held, strict=True)))
    child = np.flatnonzero(parent != np.arange(len(parent)))
    return doc[child], doc[parent[child]]


def _tables(fp: Column, groups: int, radius: int) -> list[Column]:
    edges = [round(i * 64 / groups) for i in range(groups + 1)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(groups)]
    out = []
    for k, kept in enumerate(combinations(range(groups), groups - radius)):
        mask = sum(masks[i] for i in kept)
        out.append(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return out


def link(prints: DataFrame, radius: int = 4, cell_rows: int = 4096) -> DataFrame:
    """(fp, component_id) for every fingerprint of prints (doc_id, fp): the smallest id reachable by links."""
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("doc")))
    n = distinct.count()
    groups = next((g for g in range(radius + 1, 2 * radius) if n >> (64 * (g - radius) // g) < 128), 2 * radius)
    rows = distinct.where("doc IS NOT NULL").select("fp", "doc", F.explode(F.array(*_tables(F.col("fp"), groups, radius))).alias("cell"))
    hot = rows.groupBy("cell").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("chunks")).where("chunks > 1")
    rows = rows.join(hot, "cell", "left").withColumn("own", F.expr("pmod(xxhash64(fp, 7), coalesce(chunks, 1))").cast("int"))
    other = F.expr("explode(CASE WHEN chunks IS NULL THEN array(0) ELSE filter(sequence(0, chunks - 1), x -> x <> own) END)")
    rows = rows.select("fp", "doc", "cell", "chunks", "own", other.alias("other"))
    pair = F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.select(F.when(F.col("chunks").isNull(), F.col("cell")).otherwise(pair).alias("cell"), "fp", "doc")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(part: list[np.ndarray]) -> pa.RecordBatch:
            a, b = _forest(part[0], part[1].view(np.uint64), part[2], radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate((h, batch.column(i).to_numpy())) for i, h in enumerate(held)]
            if len(held[0]) >= 1 << 17:
                whole = int(np.searchsorted(held[0], held[0][-1]))  # what follows may belong to a run that goes on
                if whole:
                    yield edges([h[:whole] for h in held])
                    held = [h[whole:] for h in held]
        yield edges(held)

    found = rows.repartition("cell").sortWithinPartitions("cell", "doc").mapInArrow(compare, "a long, b long")
    roots = components(found)
    return distinct.join(roots, distinct["doc"] == roots["node"], "left").select("fp", F.coalesce("root", "doc").alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    prints = cut(fingerprints(docs, words, id_col, text_col))
    return prints.join(link(prints, radius), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group: that of the smallest id, and of rows with that id the one whose text's hash is
    least. Rows with a null id name no group and stay."""
    kept = near_duplicates(docs, words, radius, id_col, text_col).where("doc_id = component_id").select(F.col("doc_id").alias("kept")).distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), whole_row(docs))
    rows = rows.join(kept, F.col("id") == F.col("kept"), "left").where(F.col("kept").isNotNull() | F.col("id").isNull())
    place = F.when(F.col("id").isNotNull(), F.row_number().over(Window.partitionBy("id", F.when(F.col("id").isNull(), F.col("mark"))).orderBy("mark")))
    return rows.withColumn("place", place).where("place IS NULL OR place = 1").select("row.*")
