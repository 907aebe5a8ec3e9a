"""Removal of passages that an earlier document holds: super-k-mer partitioning over words.

Documents are gathered into blocks of a few MB. In a block, consecutive windows of ``window`` words whose smallest hash
of ``minimiser`` words is the same form one super-k-mer, which travels as one packed string to the bucket of that hash;
equal strings of a block travel once, with their smallest document. A bucket sorts the hashes of all its windows,
compares the words of windows with equal hashes, and answers each block with the windows that a smaller document starts.
A passage shared by a third of all documents costs a bucket one string a block, not one a copy.

There are as many buckets as the blocks' bytes ask for. Where many different windows share a minimiser (a stock phrase in
changing context), its bucket would grow with the corpus: buckets measured to be over ``bucket_bytes`` are dealt anew, by a
minimiser of ``longer`` words within the first one, still in packed strings; those that stay too large are dealt window by
window, by the hash of the whole window. Equal windows take the same way at each step, so the counts stay exact. Sizes are
measured in all blocks, or in one of every m where there are over 4,096 m; they decide where strings travel, never what is
removed.

Defined results: a null text has no words; a text of fewer words than a window is kept whole; repeated ids count as one
document, so they never remove from one another; a window that occurs twice in one document alone stays; ties cannot
arise, as only a strictly smaller id removes; a null id counts as one id above all others. An empty table gives an empty
result. Other columns pass through; those named as a column added here are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tideline.llm.common import cut, deflate, inflate, mix, parallelism, run_hashes, span_hashes

BLOCK_BYTES = 2 << 20
#: Compressed bytes of documents for each bucket; blocks that sizes are measured in.
BYTES_A_BUCKET, MEASURED = 2 << 20, 4096
#: A null id comes after every other.
NO_ID = (1 << 63) - 1


def _pack(**arrays: np.ndarray) -> bytes:
    head = ";".join(f"{k},{v.dtype.str},{len(v)}" for k, v in arrays.items()).encode()
    return deflate(len(head).to_bytes(4, "little") + head + b"".join(np.ascontiguousarray(v).tobytes() for v in arrays.values()), 5)


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    raw = inflate(data)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = {}
    for part in raw[4:at].decode().split(";"):
        name, kind, n = part.split(",")
        out[name] = np.frombuffer(raw, kind, int(n), at)
        at += out[name].nbytes
    return out


def _spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text in which one space or line feed stands between any two."""
    gaps = np.flatnonzero((data == 32) | (data == 10))
    return np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _super_kmers(ids: list[int], counts: list[int], lines: list[bytes], window: int, minimiser: int) -> bytes:
    """The packed table of a block's super-k-mers: first word, windows, bucket key, representative and document."""
    data = np.frombuffer(b"\n".join(lines), np.uint8)
    starts, ends = _spans(data)
    doc = np.repeat(np.arange(len(counts)), counts)
    grams = run_hashes(span_hashes(data, starts, ends), minimiser)
    least = _least(grams, window - minimiser + 1)
    inside = doc[window - 1 :] == doc[: len(least)]
    at = np.flatnonzero(inside)
    new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])))
    first = at[new]
    n = np.diff(np.concatenate((np.flatnonzero(new), [len(at)])))
    low, high = starts[first], ends[first + n + window - 2]
    raw, seen, reps = data.tobytes(), {}, np.empty(len(first), np.int64)
    ids_of = np.array(ids, np.int64)[doc[first]]
    for i in np.argsort(ids_of, kind="stable").tolist():  # the smallest document represents its block
        reps[i] = seen.setdefault(raw[low[i] : high[i]], i)
    key = (mix(least[first]) >> np.uint64(33)).astype(np.uint32)
    return _pack(first=first.astype(np.uint32), n=n.astype(np.uint32), key=key, rep=reps.astype(np.uint32), doc=ids_of, size=(high - low).astype(np.uint32))


class _Dealer:
    """Where the strings of a block travel: bucket, string, its first window among the string's, windows."""

    def __init__(self, window: int, longer: int, buckets: tuple[int, int, int], hot: tuple[frozenset[int], frozenset[int]]) -> None:
        self.window, self.longer, self.buckets, self.hot = window, longer, buckets, hot

    def deal(self, k: dict[str, np.ndarray], words: np.ndarray, only_hot: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """k: a block's strings; words: the hashes of its words."""
        first, second, third = self.buckets
        own = np.flatnonzero(k["rep"] == np.arange(len(k["rep"])))
        bucket, n = (k["key"][own] % first).astype(np.int64), k["n"][own].astype(np.int64)
        parts = [(bucket, own, np.zeros(len(own), np.int64), n)]
        if self.hot[0]:
            many = np.isin(bucket, np.fromiter(self.hot[0], np.int64))
            parts = [tuple(x[~many] for x in parts[0])] if not only_hot else []
            string, n = own[many], n[many]
            of = np.repeat(np.arange(len(string)), n)
            at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            window = k["first"][string].astype(np.int64)[of] + at  # its first word
            least = _least(run_hashes(words, self.longer), self.window - self.longer + 1)[window] if len(of) else np.empty(0, np.uint64)
            new = np.concatenate(([True], (of[1:] != of[:-1]) | (least[1:] != least[:-1])))[: len(of)]
            runs = np.flatnonzero(new)
            bucket = first + (mix(least[runs]) % np.uint64(second)).astype(np.int64)
            length = np.diff(np.append(runs, len(of)))
            alone = np.isin(bucket, np.fromiter(self.hot[1], np.int64)) if self.hot[1] else np.zeros(len(runs), bool)
            parts.append((bucket[~alone], string[of[runs[~alone]]], at[runs[~alone]], length[~alone]))
            single = np.flatnonzero(np.repeat(alone, length))
            whole = run_hashes(words, self.window)[window[single]] if len(single) else np.empty(0, np.uint64)
            parts.append((first + second + (whole % np.uint64(third)).astype(np.int64), string[of[single]], at[single], np.ones(len(single), np.int64)))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _lines(texts: list[str | None], window: int) -> tuple[list[list[bytes]], list[int]]:
    words = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
    return words, [i for i, w in enumerate(words) if len(w) >= window]


def _table_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return deflate(sink.getvalue().to_pybytes(), 7)


def _table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(inflate(data)).read_all()


def remove_repeats(docs: DataFrame, window: int = 50, minimiser: int = 4, longer: int = 12, bucket_bytes: int = 48 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with ``text_col`` replaced by its kept words joined by one space, and n_words, n_removed, kept_sha256."""
    spark = docs.sparkSession
    added = ("n_words", "n_removed", "kept_sha256")
    docs = docs.select(*(c for c in docs.columns if c not in added))
    kept_type = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    kept_arrow = to_arrow_schema(kept_type)
    longer = min(longer, window)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            sizes = np.cumsum(_sizes(batch.column(text_col)))
            low = 0
            while low < len(batch):
                done = sizes[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(sizes, done + BLOCK_BYTES, "right")))
                part = batch.slice(low, high - low)
                words, long = _lines(part.column(text_col).to_pylist(), window)
                ids = [NO_ID if i is None else i for i in part.column(id_col).to_pylist()]
                table = _super_kmers([ids[i] for i in long], [len(words[i]) for i in long], [b" ".join(words[i]) for i in long], window, minimiser) if long else b""
                yield pa.RecordBatch.from_pydict({"block": [task << 32 | made], "docs": [_table_bytes(part)], "kmers": [table]}, pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("kmers", pa.binary())]))
                made, low = made + 1, high

    def text_of(docs_: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        words, long = _lines(_table(docs_).column(text_col).to_pylist(), window)
        raw = b"\n".join(b" ".join(words[i]) for i in long)
        return raw, *_spans(np.frombuffer(raw, np.uint8))

    def parts_of(dealer: _Dealer):  # noqa: ANN202
        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, docs_, kmers in zip(*(batch.column(c).to_pylist() for c in ("block", "docs", "kmers")), strict=True):
                    if not kmers:
                        continue
                    k = _unpack(kmers)
                    raw, starts, ends = text_of(docs_)
                    hashes = span_hashes(np.frombuffer(raw, np.uint8), starts, ends) if dealer.hot[0] else np.empty(0, np.uint64)
                    bucket, string, at, n = dealer.deal(k, hashes)
                    order = np.argsort(bucket, kind="stable")
                    bucket, string, at, n = bucket[order], string[order], at[order], n[order]
                    first = k["first"][string].astype(np.int64) + at
                    low, high = starts[first].tolist(), ends[first + n + window - 2].tolist()
                    edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)])).tolist()
                    out = {"bucket": [], "block": [], "packed": []}
                    for a, b in zip(edges[:-1], edges[1:], strict=True):
                        text = b"\n".join([raw[x:y] for x, y in zip(low[a:b], high[a:b], strict=True)])
                        out["bucket"].append(int(bucket[a]))
                        out["block"].append(block)
                        out["packed"].append(_pack(rep=string[a:b].astype(np.uint32), at=at[a:b].astype(np.uint32), n=n[a:b].astype(np.uint32), doc=k["doc"][string[a:b]], text=np.frombuffer(text, np.uint8)))
                    yield pa.RecordBatch.from_pydict(out, pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("packed", pa.binary())]))

        return parts

    def sizes_of(dealer: _Dealer):  # noqa: ANN202
        def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Bytes of the strings by bucket; past the first dealing, of the anew dealt ones alone."""
            for batch in batches:
                total: dict[int, int] = {}
                for docs_, kmers in zip(*(batch.column(c).to_pylist() for c in ("docs", "kmers")), strict=True):
                    if not kmers:
                        continue
                    k = _unpack(kmers)
                    hashes, mean = np.empty(0, np.uint64), k["size"].sum() / (k["n"].astype(np.int64) + window - 1).sum()
                    if dealer.hot[0]:
                        raw, starts, ends = text_of(docs_)
                        hashes = span_hashes(np.frombuffer(raw, np.uint8), starts, ends)
                    bucket, _, _, n = dealer.deal(k, hashes, only_hot=True)
                    name, place = np.unique(bucket, return_inverse=True)
                    for x, y in zip(name.tolist(), np.bincount(place, (n + window - 1) * mean).tolist(), strict=True):
                        total[x] = total.get(x, 0) + int(y)
                yield pa.RecordBatch.from_pydict({"bucket": list(total), "bytes": list(total.values())}, pa.schema([("bucket", pa.int32()), ("bytes", pa.int64())]))

        return sizes

    def count(group: pd.DataFrame) -> pd.DataFrame:
        block, answer = _count(group["block"].tolist(), group["packed"].tolist(), window)
        return pd.DataFrame({"block": pd.Series(block, dtype="int64"), "answer": pd.Series(answer, dtype=object)})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs_, kmers, answers in zip(*(batch.column(c).to_pylist() for c in ("docs", "kmers", "answers")), strict=True):
                table = _table(docs_)
                texts = table.column(text_col).to_pylist()
                words, long = _lines(texts, window)
                gone = {}
                if kmers:
                    flags = _covered(_unpack(kmers), [_unpack(a) for a in answers or []], sum(len(words[i]) for i in long), window)
                    cuts = np.cumsum([0] + [len(words[i]) for i in long])
                    gone = {i: flags[a:b] for i, a, b in zip(long, cuts[:-1], cuts[1:], strict=True)}
                kept, removed, sums = [], [], []
                for i, w in enumerate(words):
                    out = gone.get(i)
                    removed.append(int(out.sum()) if out is not None else 0)
                    left = b" ".join([x for x, y in zip(w, out.tolist(), strict=True) if not y] if removed[-1] else w)
                    sums.append(hashlib.sha256(left).hexdigest())
                    kept.append(left.decode("utf-8", "surrogatepass"))
                for c, v in ((text_col, kept), ("n_words", [len(w) for w in words]), ("n_removed", removed), ("kept_sha256", sums)):
                    v = pa.array(v, kept_arrow.field(c).type)
                    table = table.set_column(table.schema.get_field_index(c), c, v) if c in table.schema.names else table.append_column(c, v)
                yield from table.cast(kept_arrow).combine_chunks().to_batches()

    held = cut(docs.mapInArrow(blocks, "block long, docs binary, kmers binary"))
    n_blocks, packed = held.agg(F.count("*"), F.coalesce(F.sum(F.length("docs")), F.lit(0))).first()
    every = -(-n_blocks // MEASURED) or 1
    least = 4 * parallelism(spark)
    dealer = _Dealer(window, longer, (max(least, packed // BYTES_A_BUCKET), 1, 1), (frozenset(), frozenset()))
    for step in (0, 1):
        texts = F.col("docs") if step else F.lit(None).cast("binary").alias("docs")  # sizes need them only to deal anew
        some = held.where(F.pmod(F.xxhash64("block"), F.lit(every)) == 0).select(texts, "kmers")
        sizes = some.mapInArrow(sizes_of(dealer), "bucket int, bytes long").groupBy("bucket").agg((F.sum("bytes") * every).alias("bytes"))
        hot = {r["bucket"]: r["bytes"] for r in sizes.where(F.col("bytes") > bucket_bytes).collect()}  # at most all bytes / bucket_bytes
        if not hot:
            break
        room = max(least, 4 * sum(hot.values()) * (window // 2 if step else 1) // bucket_bytes)
        own = frozenset(hot)
        buckets, hot_ = dealer.buckets, dealer.hot
        dealer = _Dealer(window, longer, (buckets[0], room, 1) if not step else (*buckets[:2], room), (own, frozenset()) if not step else (hot_[0], own))
    answers = held.mapInArrow(parts_of(dealer), "bucket int, block long, packed binary").groupBy("bucket").applyInPandas(count, "block long, answer binary")
    answers = answers.groupBy("block").agg(F.collect_list("answer").alias("answers"))  # one from each bucket at most
    return held.join(answers, "block", "left").select("docs", "kmers", "answers").mapInArrow(finish, kept_type)


def _sizes(texts: pa.Array) -> np.ndarray:
    """The bytes of each text."""
    if texts.type != pa.string():
        return np.array([len(x.as_py() or "") for x in texts], np.int64)
    return np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset :][: len(texts) + 1])


def _count(blocks: list[int], packed: list[bytes], window: int) -> tuple[list[int], list[bytes]]:
    """Of one bucket: for each block, the runs of windows that a smaller document starts."""
    parts = [_unpack(p) for p in packed]
    raw = b"\n".join(p["text"].tobytes() for p in parts)
    n, docs = (np.concatenate([p[c] for p in parts]).astype(np.int64) for c in ("n", "doc"))
    starts, ends = _spans(np.frombuffer(raw, np.uint8))
    base = np.concatenate(([0], np.cumsum(n + window - 1)))[:-1]
    string = np.repeat(np.arange(len(n)), n)
    within = np.arange(len(string)) - np.repeat(np.cumsum(n) - n, n)
    at = base[string] + within  # first word of each window
    hashes = run_hashes(span_hashes(np.frombuffer(raw, np.uint8), starts, ends), window)[at]
    low, high = starts[at], ends[at + window - 1]
    doc = docs[string]
    order = np.lexsort((doc, hashes))
    fresh = np.concatenate(([True], hashes[order][1:] != hashes[order][:-1]))
    group = np.cumsum(fresh) - 1
    leader = np.empty(len(order), np.int64)
    leader[order] = order[np.flatnonzero(fresh)][group]  # a window of the group's smallest document
    later = np.flatnonzero(doc > doc[leader])
    gone = np.zeros(len(doc), bool)
    gone[later] = True
    if len(later):
        lead = leader[later]
        split = np.concatenate(([True], (np.diff(later) != 1) | (np.diff(lead) != 1) | (np.diff(string[later]) != 0) | (np.diff(string[lead]) != 0)))
        a = np.flatnonzero(split)
        b = np.concatenate((a[1:], [len(later)])) - 1
        wrong = [i for i, (p, q, r, s) in enumerate(zip(low[later[a]].tolist(), high[later[b]].tolist(), low[lead[a]].tolist(), high[lead[b]].tolist(), strict=True)) if raw[p:q] != raw[r:s]]
        if wrong:  # equal hashes of different words: those groups are settled by their words
            bad = np.isin(hashes, np.unique(np.concatenate([hashes[later[a[i] : b[i] + 1]] for i in wrong])))
            least: dict[bytes, int] = {}
            slow = np.flatnonzero(bad).tolist()
            for i in slow:
                w = raw[low[i] : high[i]]
                least[w] = min(least.get(w, doc[i]), doc[i])
            for i in slow:
                gone[i] = least[raw[low[i] : high[i]]] < doc[i]
    # runs of removed windows, cut where a string ends
    hit = np.flatnonzero(gone)
    starts_at = np.concatenate([p["at"] if "at" in p else np.zeros(len(p["n"]), np.uint32) for p in parts]).astype(np.int64)
    within = within + starts_at[string]
    out_blocks, out = [], []
    if len(hit):
        split = np.concatenate(([True], (np.diff(hit) != 1) | (np.diff(string[hit]) != 0)))
        a = hit[split]
        b = hit[np.concatenate((np.flatnonzero(split)[1:], [len(hit)])) - 1]
        of = np.repeat(np.arange(len(parts)), [len(p["rep"]) for p in parts])[string[a]]
        rep = np.concatenate([p["rep"] for p in parts])[string[a]]
        for i in np.unique(of).tolist():
            own = of == i
            out_blocks.append(blocks[i])
            out.append(_pack(rep=rep[own], low=within[a[own]].astype(np.uint32), high=within[b[own]].astype(np.uint32)))
    return out_blocks, out


def _covered(k: dict[str, np.ndarray], answers: list[dict[str, np.ndarray]], n_words: int, window: int) -> np.ndarray:
    """For each word of a block whether a removed window covers it."""
    first, n, rep, doc = (k[c].astype(np.int64) for c in ("first", "n", "rep", "doc"))
    rise = np.zeros(n_words + 1, np.int64)
    copies = np.flatnonzero(doc > doc[rep])  # the block itself holds them in a smaller document
    np.add.at(rise, first[copies], 1)
    np.add.at(rise, first[copies] + n[copies] + window - 1, -1)
    if answers:
        of, low, high = (np.concatenate([a[c] for a in answers]).astype(np.int64) for c in ("rep", "low", "high"))
        again = np.flatnonzero((doc == doc[rep]) & (rep != np.arange(len(rep))))  # repeats within a document share its answer
        more = pd.DataFrame({"rep": of, "low": low, "high": high}).merge(pd.DataFrame({"rep": rep[again], "own": again}), on="rep")
        own = np.concatenate((of, more["own"].to_numpy(np.int64)))
        low, high = np.concatenate((low, more["low"].to_numpy(np.int64))), np.concatenate((high, more["high"].to_numpy(np.int64)))
        np.add.at(rise, first[own] + low, 1)
        np.add.at(rise, first[own] + high + window, -1)
    return np.cumsum(rise)[:-1] > 0
