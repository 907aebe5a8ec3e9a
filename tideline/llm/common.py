"""What several operators share: checkpoints, word hashes, byte packing, connected components."""

from __future__ import annotations

import tempfile

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of the white space that separates words; everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEGMENT = 1 << 18


def scan(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the folder the cluster names; local tests, where none is named,
    get one of their own."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tideline-checkpoint-"))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder for written tables: the one the cluster names, else that of local tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        cut(spark.range(0))
    return spark.conf.get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().get()


def whole_row(df: DataFrame) -> Column:
    """A row as one column, ``row``, so that columns added beside it meet no other of their name."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")


def deflate(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def inflate(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; base is odd and so has an inverse."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    out = []
    for b in (base, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def cached_powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, (n - 1).bit_length())
    key = (int(base), size)
    if key not in _tables:
        if size > 1 << 18:  # workers live long and shouldn't hold much
            return powers(base, n)
        _tables[key] = powers(base, size)
    return _tables[key]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; starts ascend and spans don't overlap. Works in segments that fit a cache."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, low + _SEGMENT, "right")))
        high = int(ends[j - 1])
        up, down = cached_powers(_BASE, high - low + 1)
        sums = np.empty(high - low + 1, np.uint64)
        sums[0] = 0
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[e] - sums[s]) * down[s])
        i = j
    return out


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive words, given the hashes of the words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = cached_powers(np.uint64(0xD6E8FEB86659FD93), len(hashes) + 1)
    sums = np.empty(len(hashes) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[:n])


def _with_least(edges: DataFrame, least: DataFrame, hot: int) -> DataFrame:
    """edges (a, b) with the ``m`` of least (a, m, n) for each a. Of a node of over ``hot`` edges the least is broadcast
    (there are at most 2 |edges| / hot such nodes), so its edges stay where they are; the others meet by a."""
    many = F.broadcast(least.where(F.col("n") > hot).select(F.col("a").alias("_hot"), F.col("m").alias("_m")))
    tagged = edges.join(many, F.col("a") == F.col("_hot"), "left")
    few = tagged.where("_hot IS NULL").select("a", "b").join(least.where(F.col("n") <= hot).select("a", "m"), "a")
    return tagged.where("_hot IS NOT NULL").select("a", "b", F.col("_m").alias("m")).union(few.select("a", "b", "m"))


def components(edges: DataFrame, most: int = 40, hot: int | None = None) -> DataFrame:
    """(node, root) for every node of edges (a, b), root the smallest node reachable. Alternates large-star and
    small-star; each round's minima combine before the shuffle. Nodes of over ``hot`` edges (100,000 and a ten-thousandth
    of all, at least) are met by broadcast, so none of them is a task's load."""
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    size = e.count()
    hot = hot or max(100_000, size // 10_000)
    before = None
    for _ in range(most):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        # no node has more edges than there are, so a small graph has no hot ones
        meet = _with_least if 2 * size > hot else lambda edges, least, _: edges.join(least.drop("n"), "a")
        large = meet(both, low, hot).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = (
            meet(large, low, hot).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
            .select("x.*").where("a <> b").distinct()
        )
        e = cut(small)
        after = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before, size = after, after[0]
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").union(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
