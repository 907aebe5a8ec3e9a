"""Best-fit packing of tokenised documents into sequences of bounded length: large-item matching.

Documents become ids and an end id; only those over the capacity are cut, into full pieces and a shorter last one. Full
pieces are sequences of their own. The others are dealt by hash into shards of about ``shard_pieces``; in a shard, pieces
above a third of the capacity, of which a sequence holds two at most, are matched greedily, the longest first, each with
the longest other that fits; smaller ones then go, the longest first, where they leave the smallest gap. The sequences a
shard leaves at most half full (two or three) are taken apart and packed once more, together, so that sharding costs next
to nothing. No task holds more than a shard.

Words, cut at white space as the tokenizer itself does, are encoded once per worker and held in a bounded table; the ids
are those of the whole text.

Defined results: a null or empty text is the end id alone; rows with equal or null ids are packed as documents of their
own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import cut

CAPACITY = 4096
END_ID = 1
#: What a worker's table of words holds until it is emptied: words, and bytes in them.
MOST_WORDS, MOST_BYTES = 800_000, 32 << 20
_TOGETHER = 256
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_encoders: dict[str, "_Words"] = {}


class _Numbers(dict):
    """Numbers words as they come; fresh holds those that have no ids yet."""

    def __init__(self) -> None:
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class _Lists:
    """Lists of ids by number."""

    def __init__(self) -> None:
        self.ids, self.starts, self.sizes = (np.empty(0, t) for t in (np.uint32, np.int64, np.uint32))

    def reserve(self, n: int) -> None:
        self.starts, self.sizes = (np.concatenate((x, np.zeros(n - len(x), x.dtype))) for x in (self.starts, self.sizes))

    def put(self, at: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.starts[at] = len(self.ids) + np.cumsum(sizes) - sizes
        self.sizes[at] = sizes
        self.ids = np.concatenate((self.ids, ids))

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the lists numbered ``at``, one after the other, and the lists' sizes."""
        sizes = self.sizes[at].astype(np.int64)
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes


#: A word that ends in marks, none of them an apostrophe, after a letter or digit: the tokenizer parts the two there.
_MARKED = re.compile(rb"(.*[a-zA-Z0-9\x80-\xff])([!-&(-/:-@\[-`{-~]+)", re.S)


class _Words:
    """The ids of words by a tokenizer of the tokenizers library, from a table that is emptied when full."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self._encode(["0"])[0]
        self.clear()

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def clear(self) -> None:
        self.numbers, self.lists, self.size = _Numbers(), _Lists(), 0

    def _code(self, fresh: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words without marks, and how many each has. They are encoded many at a time: a digit that always is
        one id of its own stands between any two."""
        alone = len(self.mark) != 1
        ids, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for low in range(0, len(fresh), _TOGETHER * 32):  # what the tokenizer returns is many times its ids
            part = fresh[low : low + _TOGETHER * 32]
            groups = [part[i : i + _TOGETHER] for i in range(0, len(part), _TOGETHER)]
            together = self._encode(["" if alone else b" 0 ".join(g).decode("utf-8", "replace") for g in groups])
            for group, own in zip(groups, together, strict=True):
                a = np.array(own, np.uint32)
                at = np.flatnonzero(a == self.mark[0])
                if alone or len(at) != len(group) - 1:  # some word holds that digit
                    each = self._encode([w.decode("utf-8", "replace") for w in group])
                    ids.append(np.array([i for e in each for i in e], np.uint32))
                    sizes.append(np.array([len(e) for e in each], np.int64))
                else:
                    ids.append(np.delete(a, at))
                    sizes.append(np.diff(np.concatenate(([-1], at, [len(a)]))) - 1)
        return np.concatenate(ids), np.concatenate(sizes)

    def _parts(self, word: bytes) -> tuple[bytes, bytes]:
        m = _MARKED.fullmatch(word)
        if not m or b"<|" in word:
            return word, b""
        stem = m[1]
        if stem[-1] >= 128:
            last = stem.decode("utf-8", "replace")[-1]
            if not last.isalpha() or len(last.lower()) > 1:  # a letter that lower case spells with a mark
                return word, b""
        return stem, m[2]

    def _learn(self) -> None:
        """Gives ids to the fresh words. One that ends in marks has those of its stem and of its marks, which are words
        of the same table."""
        fresh, self.numbers.fresh = self.numbers.fresh, []
        if not fresh:
            return
        low = len(self.numbers) - len(fresh)
        marked, pairs, plain = [], [], []
        for n, w in enumerate(fresh, low):
            stem, marks = self._parts(w)
            if marks:
                marked.append(n)
                pairs += (self.numbers[stem], self.numbers[marks])
            else:
                plain.append(n)
        plain += range(low + len(fresh), len(self.numbers))
        fresh += self.numbers.fresh
        self.numbers.fresh.clear()
        self.size += sum(map(len, fresh))
        self.lists.reserve(len(self.numbers))
        plain.sort(key=lambda n: b"0" in fresh[n - low])  # words with a zero would spoil the groups of others
        self.lists.put(np.array(plain, np.int64), *self._code([fresh[n - low] for n in plain]))
        ids, sizes = self.lists.gather(np.array(pairs, np.int64))
        self.lists.put(np.array(marked, np.int64), ids, sizes.reshape(-1, 2).sum(axis=1))

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by end_id, and the edges between texts."""
        if len(self.numbers) > MOST_WORDS or self.size > MOST_BYTES:
            self.clear()
        words = []
        for t in texts:
            raw = t.encode("utf-8", "replace") if t else b""
            words.append((raw if b"<|" in raw else raw.lower()).split())  # the tokenizer lowers letters, but not its marks
        n = np.array([len(w) for w in words], np.int64)
        at = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
        self._learn()
        ids, sizes = self.lists.gather(at)
        edges = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(n)))]
        return np.insert(ids, edges[1:], np.uint32(end_id)), edges + np.arange(len(edges))


def tokens(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, and with_ids its ids as little-endian 32-bit words.
    tokenizer: a path that every executor can open."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, _Words(tokenizer))
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            size, low = 0, 0
            for high in range(1, len(texts) + 1):
                size += len(texts[high - 1].as_py() or "")
                if size < 1 << 21 and high < len(texts):
                    continue
                ids, edges = words.encode(texts.slice(low, high - low).to_pylist(), end_id)
                rows: list[list] = [[] for _ in names]
                for key, a, b in zip(keys[low:high], edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    for piece, start in enumerate(range(a, b, capacity)):
                        raw = ids[start : min(b, start + capacity)].astype("<u4").tobytes()
                        for r, v in zip(rows, (key, piece, start - a, len(raw) // 4, zlib.crc32(raw), raw), strict=False):
                            r.append(v)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=False)], names)
                size, low = 0, high

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PIECES + ", ids binary" * with_ids)


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each length, by large-item matching."""
    order = np.argsort(-lengths, kind="stable").tolist()
    size = lengths.tolist()
    bins: list[list[int]] = []
    large = [i for i in order if size[i] * 3 > capacity]
    rising = large[::-1]
    keys = [size[i] for i in rising]
    taken = [False] * len(rising)
    free = list(range(-1, len(rising)))  # free[p + 1]: the last place up to p that may be untaken

    def last(p: int) -> int:
        while p >= 0 and taken[p]:
            free[p + 1] = free[free[p + 1] + 1] if free[p + 1] != p else p - 1
            p = free[p + 1]
        return p

    for p in range(len(rising) - 1, -1, -1):
        if taken[p]:
            continue
        taken[p] = True
        mate = last(bisect.bisect_right(keys, capacity - keys[p]) - 1)
        bins.append([rising[p]])
        if mate >= 0:
            taken[mate] = True
            bins[-1].append(rising[mate])
    gaps: dict[int, list[int]] = {}
    sizes: list[int] = []  # the gaps that some bin has, ascending

    def put(b: int, gap: int) -> None:
        if gap:
            if not gaps.get(gap):
                bisect.insort(sizes, gap)
            gaps.setdefault(gap, []).append(b)

    for b, own in enumerate(bins):
        put(b, capacity - sum(size[i] for i in own))
    for i in order[len(large) :]:
        at = bisect.bisect_left(sizes, size[i])
        if at < len(sizes):
            gap = sizes[at]
            b = gaps[gap].pop()
            if not gaps[gap]:
                sizes.pop(at)
        else:
            gap, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        put(b, gap - size[i])
    where, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
    for b, own in enumerate(bins):
        at = 0
        for i in own:
            where[i], offset[i] = b, at
            at += size[i]
    return where, offset


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = 2048) -> DataFrame:
    """pieces (with doc_id, piece, length <= capacity) with sequence_id and offset."""
    pieces = cut(pieces.withColumn("lot", F.monotonically_increasing_id()))  # the lot tells equal rows apart
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long, full boolean"

    def shards(df: DataFrame, n: int, seed: int) -> DataFrame:
        return df.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "lot"), F.lit(n)))

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].to_numpy(np.int64)
        where, offset = pack(lengths, capacity)
        group = group.drop(columns="shard")
        full = np.bincount(where, lengths)[where] * 2 > capacity
        return group.assign(sequence_id=(int(key[0]) << 24) + where, offset=offset, full=full)

    short = pieces.where(F.col("length") < capacity)
    n = max(1, -(-short.count() // shard_pieces))
    first = cut(shards(short, n, 1).groupBy("shard").applyInPandas(fit, fields))
    left = first.where("NOT full").drop("sequence_id", "offset", "full")
    again = shards(left, max(1, n // 512), 2).groupBy("shard").applyInPandas(fit, fields)
    kind = lambda df, k: df.select(*pieces.columns, (F.col("sequence_id") * 4 + k).alias("sequence_id"), "offset")
    whole = pieces.where(F.col("length") == capacity).select("*", (F.col("lot") * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.union(kind(first.where("full"), 1)).union(kind(again, 2)).drop("lot")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return best_fit(tokens(docs, tokenizer, capacity, end_id, with_ids, id_col, text_col), capacity)
