"""Every operator against brute force on small fixtures: planted copies, nulls, empty and long texts, ties, repeated rows,
empty tables, clashing columns."""

import hashlib
import html
import random
import re
import textwrap
import tracemalloc
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import embedding_dedup, html_extraction, licenses, mixing, ordinal, packing, permutation_index, queries, simhash_dedup, substring_dedup
from tideline.llm.common import components, mix, run_hashes, span_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(7)
WORDS = [f"w{i}" for i in range(400)]


def passage(n, rng=RNG):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    shared = passage(70, rng)
    texts = [passage(rng.randrange(5, 200), rng) for _ in range(40)]
    texts += [texts[0], texts[1] + " tail", f"{passage(20, rng)} {shared} {passage(9, rng)}", f"{shared}\n{shared}", "same " * 130, "same " * 90, None, "", "  \t ", "one", "É \x0b x\xa0y ümlaut", passage(6000, rng)]
    data = [(i, t, "en", f"src{i % 3}" if i % 7 else None, 0) for i, t in enumerate(texts)]
    return [*data, data[3], data[41], (None, texts[2], "en", "src1", 0), (None, passage(60, rng), None, None, None)]


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text):
    return text.encode().split() if text else []


def test_span_and_run_hashes():
    raw = b"aa bb aa bb aa cc aa bb"
    data = np.frombuffer(raw, np.uint8)
    gaps = np.flatnonzero(data == 32)
    h = span_hashes(data, np.r_[0, gaps + 1], np.r_[gaps, len(data)])
    assert h[0] == h[2] == h[4] == h[6] and h[1] == h[3] and len(set(h.tolist())) == 3
    r = run_hashes(h, 2)
    assert r[0] == r[2] == r[6] and r[1] == r[3] and len(set(r.tolist())) == 4
    assert len(run_hashes(h, 9)) == 0 and len(np.unique(mix(np.arange(1000, dtype=np.uint64)))) == 1000


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 200), (300, 200), (5, 5)] + [(1000 + i, 1000) for i in range(50)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(31)) and found[300] == 100 and all(found[1000 + i] == 1000 for i in range(50))
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def brute_repeats(rows, k=50):
    top = 1 << 62
    first = {}
    for i, t, *_ in rows:
        w = words_of(t)
        for j in range(len(w) - k + 1):
            s = tuple(w[j : j + k])
            first[s] = min(first.get(s, top), top if i is None else i)
    out = []
    for i, t, *_ in rows:
        w, own = words_of(t), top if i is None else i
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < own:
                gone[j : j + k] = [True] * k
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup(spark, docs, rows, empty, monkeypatch):
    got = substring_dedup.remove_repeats(docs.withColumn("n_words", F.lit("clash"))).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows)
    assert substring_dedup.remove_repeats(empty).isEmpty()


@pytest.mark.parametrize("bucket_bytes", [1, 3000, 20_000])
def test_substring_dedup_deals_large_buckets_anew(spark, rows, bucket_bytes):
    """A stock phrase in changing context, a stock passage, and a text of one word: whatever is dealt anew, the same is removed."""
    rng = random.Random(8)
    phrase, stock = passage(45, rng), passage(120, rng)
    more = [(1000 + i, f"{passage(30, rng)} {phrase} {passage(40, rng)} {stock if i % 3 == 0 else ''} {passage(20, rng)}", "en", "s", 0) for i in range(60)]
    more += [(2000 + i, "same " * (100 + i), "en", "s", 0) for i in range(5)]
    data = rows + more
    got = substring_dedup.remove_repeats(spark.createDataFrame(data, DOCS).repartition(5), bucket_bytes=bucket_bytes).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(data)


def test_a_hot_minimiser_is_spread_over_buckets():
    """Windows that share a stock phrase of 30 words: one bucket at first, many once dealt anew."""
    rng = random.Random(9)
    phrase = [f"p{i}" for i in range(30)]
    words = [[*passage(30, rng).split(), *phrase, *passage(30, rng).split()] for _ in range(200)]
    lines = [" ".join(w).encode() for w in words]
    k = substring_dedup._unpack(substring_dedup._super_kmers(list(range(200)), [len(w) for w in words], lines, 50, 4))
    raw = np.frombuffer(b"\n".join(lines), np.uint8)
    hashes = span_hashes(raw, *substring_dedup._spans(raw))
    first = substring_dedup._Dealer(50, 12, (64, 1, 1), (frozenset(), frozenset()))
    load = lambda d: np.bincount(d[0], d[3])
    one = load(first.deal(k, hashes))
    two = load(substring_dedup._Dealer(50, 12, (64, 512, 1), (frozenset([int(one.argmax())]), frozenset())).deal(k, hashes))
    hot = int(two[64:].argmax()) + 64
    three = load(substring_dedup._Dealer(50, 12, (64, 512, 4096), (frozenset([int(one.argmax())]), frozenset([hot]))).deal(k, hashes))
    assert one.sum() == two.sum() == three.sum() and two[64:].max() <= one.max() and three[64 + 512 :].max() < one.max() / 20 and one.max() > one.sum() / 20


def test_substring_dedup_settles_hash_collisions(monkeypatch):
    monkeypatch.setattr(substring_dedup, "run_hashes", lambda h, k: np.zeros(max(0, len(h) - k + 1), np.uint64))
    text = [b"a b c", b"a b d", b"a b c"]
    packed = [substring_dedup._pack(rep=np.array([0], np.uint32), n=np.array([1], np.uint32), doc=np.array([i]), text=np.frombuffer(t, np.uint8)) for i, t in enumerate(text)]
    assert substring_dedup._count([10, 11, 12], packed, 3)[0] == [12]


def brute_components(n, linked):
    root = list(range(n))
    while True:
        new = [min([root[i], *(root[j] for j in range(n) if linked[i][j])]) for i in range(n)]
        if new == root:
            return root
        root = new


def test_simhash(spark, docs, rows, empty):
    def brute(text):
        w = (text or "").encode().lower().split()
        if not w:
            return 0
        s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [brute(r[1]) for r in rows]
    got = simhash_dedup.near_duplicates(docs).collect()
    key = lambda i, fp: (str(i), fp)
    assert sorted(key(r["doc_id"], r["fp"] % (1 << 64)) for r in got) == sorted(key(r[0], f) for r, f in zip(rows, fps, strict=True))
    known = sorted({(r[0], f) for r, f in zip(rows, fps, strict=True) if r[0] is not None})
    root = brute_components(len(known), [[(a[1] ^ b[1]).bit_count() <= 4 for b in known] for a in known])
    want = {k[0]: known[r][0] for k, r in zip(known, root, strict=True)}
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert simhash_dedup.near_duplicates(empty).isEmpty()
    kept = [r["doc_id"] for r in simhash_dedup.one_of_each(docs).collect()]
    assert sorted(i for i in kept if i is not None) == sorted({i for i, c in want.items() if i == c}) and kept.count(None) == 2


@pytest.mark.parametrize("cell_rows", [4096, 16])
def test_simhash_links_lose_none(spark, cell_rows):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = list({f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 7))) for f in base for _ in range(5)})
    prints = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "doc_id long, fp long")
    got = {r["fp"] % (1 << 64): r["component_id"] for r in simhash_dedup.link(prints, 4, cell_rows).collect()}
    assert [got[f] for f in fps] == brute_components(len(fps), [[(a ^ b).bit_count() <= 4 for b in fps] for a in fps])


def test_near_pairs_within_runs():
    rng = np.random.default_rng(1)
    run = np.sort(rng.integers(0, 6, 300))
    fp = (rng.integers(0, 1 << 63, 8, dtype=np.uint64)[rng.integers(0, 8, 300)]) ^ np.left_shift(np.uint64(1), rng.integers(0, 64, 300).astype(np.uint64))
    found = {(a, b) for i, j in simhash_dedup.near_pairs(run, fp, 4) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert found == {(a, b) for a in range(300) for b in range(a + 1, 300) if run[a] == run[b] and int(fp[a] ^ fp[b]).bit_count() <= 4}


def brute_targets(sizes):
    """sizes by source in order; excess reshared until none is above its cap."""
    weight = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    total, target, open_ = 1.5 * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(target[i] for i in range(len(sizes)) if i not in open_)
        share = {i: left * weight[i] / sum(weight[j] for j in open_) for i in open_}
        over = {i for i in open_ if share[i] > 2 * sizes[i]}
        for i in over or open_:
            target[i] = 2 * sizes[i] if over else share[i]
        open_ -= over or open_
    return target


def test_mixing(spark, docs, rows, empty):
    got = queries_mix(docs)
    assert sorted(map(str, got)) == sorted(map(str, queries_mix(docs)))
    by = {}
    for i, t, _, s, _ in rows:
        by[s] = by.get(s, 0) + len(words_of(t))
    order = sorted((s for s in by if s is not None)) + [None] * (None in by)
    want = dict(zip(order, brute_targets([by[s] for s in order]), strict=True))
    taken = {}
    for r in got:
        assert r["source_size"] == by[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in order) and len(got) == len(rows)
    assert mixing.plan(empty).isEmpty() and mixing.mixed_documents(empty).isEmpty()
    unique = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).withColumn("shard", F.lit("clash"))
    total = unique.select(F.sum(F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)))).first()[0]
    mixed = mixing.mixed_documents(unique).collect()
    assert abs(sum(len(words_of(r["text"])) for r in mixed) - 1.5 * total) <= 4 and {type(r["shard"]) for r in mixed} == {int}


def test_the_mix_holds_the_words_of_its_plan(spark, docs, rows):
    """With repeated and null ids, equal rows, and a source whose last pass ends among equal rows."""
    more = spark.createDataFrame([(i % 3 if i % 2 else None, "one two three four five", "en", "copies", i) for i in range(40)] + [(900, "six seven", "en", "copies", 0)], DOCS)
    for table in (docs, docs.union(more), more):
        table = table.withColumn("shard", F.lit("clash")).withColumn("_pass", F.lit(5)).drop("_pass")
        want = {}
        for r in mixing.plan(table).withColumn("taken", F.expr("passes * size + extra")).collect():
            want[r["doc_id"], r["source"], r["mark"]] = want.get((r["doc_id"], r["source"], r["mark"]), 0) + r["taken"]
        got, texts = {}, {}
        for r in table.select("doc_id", "source", "text").collect():
            if r["text"] is not None:
                texts.setdefault((r["doc_id"], r["source"]), {})[hashlib.md5(r["text"].encode()).hexdigest()] = words_of(r["text"])
        for r in mixing.mixed_documents(table).collect():
            w = words_of(r["text"])
            mark = next(m for m, whole in texts[r["doc_id"], r["source"]].items() if whole[: len(w)] == w and (r["doc_id"], r["source"], m) in want)
            got[r["doc_id"], r["source"], mark] = got.get((r["doc_id"], r["source"], mark), 0) + len(w)
        assert got == {k: v for k, v in want.items() if v}


def queries_mix(docs):
    return mixing.plan(docs).withColumn("taken", F.expr("passes * size + extra")).collect()


def test_mixing_shards_split_evenly(spark):
    big = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"))
    shards = mixing.plan(big, levels=2).select(F.explode("shards").alias("s")).groupBy("s").count().collect()
    assert len(shards) == 4 and max(r["count"] for r in shards) < 1.5 * min(r["count"] for r in shards)


def test_packing(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, with_ids=True).collect()
    pieces = []
    for i, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        pieces += [(i, p, a, len(c), zlib.crc32(c.tobytes()), c.tobytes()) for p, a in enumerate(range(0, len(ids), 4096)) for c in [np.array(ids[a : a + 4096], "<u4")]]
    own = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"]))
    assert sorted(map(str, map(own, got))) == sorted(map(str, pieces))
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= -(-sum(p[3] for p in pieces) // 4096) + 1
    assert packing.pack_documents(empty, path).isEmpty()


def test_encoding_by_words_is_that_of_whole_texts():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    t, rng = Tokenizer.from_file(path), random.Random(2)
    texts = ["it's, don't. X's! 10,000.50 <|endoftext|> <|ENDOFTEXT|>, é. É, ½. ²! a\xa0b, foo$$$ $$$ 'tis' we'll, 0 00. İ, İ.", "", None, *("".join(rng.choice("aB0.,'$ ́é½<|>stSİ ") for _ in range(50)) for _ in range(300))]
    ids, edges = packing._Words(path).encode(texts, 1)
    assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def test_packing_holds_few_bytes_a_word():
    """The table that each worker keeps: its bytes add to every executor's, whatever stage runs."""
    words = packing._Words(queries.tokenizer_path("word_bpe_49k.json"))
    texts = [" ".join(f"word{i}{'.' * (i % 3 == 0)}" for i in range(low, low + 1000)) for low in range(0, 60_000, 1000)]
    words.encode(["a b."], 1)
    tracemalloc.start()
    try:
        for low in range(0, 60, 10):
            words.encode(texts[low : low + 10], 1)
        assert tracemalloc.get_traced_memory()[0] < 240 * 60_000
    finally:
        tracemalloc.stop()


def test_packing_empties_its_table_by_bytes(monkeypatch):
    monkeypatch.setattr(packing, "MOST_BYTES", 1 << 20)
    words = packing._Words(queries.tokenizer_path("word_bpe_49k.json"))
    for i in range(30):  # 2 MB of words, all of them different
        text = " ".join(f"{'abcde'[j]}{i}" * 6_000 + "!" * (j % 2) for j in range(5))
        ids, edges = words.encode([text], 1)
        whole = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == [*whole, 1] and edges.tolist() == [0, len(whole) + 1]
        assert sum(map(len, words.numbers)) < 3 << 19


@pytest.mark.parametrize("lengths", [[4096], [1], [3000, 1096, 2000, 2000, 96], [1400] * 7 + [100] * 9, list(range(1, 1500, 7))])
def test_pack(lengths):
    where, offset = packing.pack(np.array(lengths), 4096)
    fill = np.bincount(where, lengths)
    assert fill.max() <= 4096 and len(fill) <= max(-(-sum(lengths) // 4096) + 1, sum(x * 3 > 4096 for x in lengths) / 2 + 1) and len(offset) == len(lengths)


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 64))
    x = np.concatenate([x, x[:30] + rng.normal(size=(30, 64)) * 0.3, x[:10], x[:8] * 2])
    out = [(i, [float(np.float32(c)) for c in v], int(i % 3) if i < 150 else int((i - 150) % 3) if i < 180 else int((i - 180) % 3) if i < 190 else int((i - 190) % 3)) for i, v in enumerate(x)]
    bad = [(200, None, 1), (201, [0.0] * 64, 1), (202, [float("nan")] + [1.0] * 63, 1), (203, [None] + [1.0] * 63, 1), (204, out[0][1], None), (205, [], 1), (206, [1.0] * 32, 1), (207, [float("inf")] * 64, 1)]
    return out + bad


@pytest.mark.parametrize("cell_rows", [2048, 8])
def test_embedding_dedup(spark, vectors, cell_rows):
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(vectors, VECTORS), cell_rows=cell_rows).collect()}
    good = [v for v in vectors if v[0] < 200]
    x = np.array([v[1] for v in good], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([v[2] for v in good])
    linked = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    root = brute_components(len(good), linked)
    assert [got[v[0]]["n_links"] for v in good] == linked.sum(axis=1).tolist() and linked.sum() > 60
    assert [got[v[0]]["component_id"] for v in good] == root and len(got) == len(vectors)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(200, 208))
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).isEmpty()


def nearest(vectors, k):
    good = [v for v in vectors if v[0] not in (200, 201, 202, 203, 205, 206, 207)]
    x, ids = np.array([v[1] for v in good], np.float64), np.array([v[0] for v in good])
    out = {}
    for q in range(len(good)):
        if ids[q] % 20 == 0:
            s = x @ x[q]
            order = [j for j in np.lexsort((ids, -np.round(s, 9))) if j != q][:k]
            out[int(ids[q])] = [int(ids[j]) for j in order]
    return out


def test_permutation_index_is_exact_if_asked(spark, vectors):
    table = spark.createDataFrame(vectors, VECTORS)
    got = {}
    for r in permutation_index.search(table, F.col("vec_id") % 20 == 0, exact=True).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == nearest(vectors, 20)
    few = permutation_index.search(table.where("vec_id IN (0, 3, 5)"), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"]) for r in few] == [(0, 1), (0, 2)]
    assert permutation_index.search(table.limit(0), F.col("vec_id") % 20 == 0).isEmpty()


def test_permutation_index_recall(spark):
    x = np.random.default_rng(8).normal(size=(3000, 32)).astype(np.float32)
    data = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = {}
    for r in permutation_index.search(spark.createDataFrame(data, VECTORS), F.col("vec_id") % 20 == 0, sample_rows=500, chunk_rows=256, query_rows=64).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    s = x.astype(np.float64) @ x.astype(np.float64).T
    np.fill_diagonal(s, -np.inf)
    want = {i: set(np.argsort(-s[i])[:20].tolist()) for i in range(0, 3000, 20)}
    assert np.mean([len(got[q] & w) / 20 for q, w in want.items()]) >= 0.9


def test_permutation_index_finds_all_on_clustered_vectors(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([np.repeat(rng.normal(size=(14, 32)), 200, axis=0) + rng.normal(size=(2800, 32)) * 0.05, rng.normal(size=(200, 32))])
    x = x[rng.permutation(3000)].astype(np.float32)
    got = {}
    for r in permutation_index.search(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS), F.col("vec_id") % 10 == 0, sample_rows=500, chunk_rows=256, query_rows=64, exact=True).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    s = x.astype(np.float64) @ x.astype(np.float64).T
    np.fill_diagonal(s, -np.inf)
    assert got.keys() == set(range(0, 3000, 10)) and all(len(set(v)) == len(v) == 20 for v in got.values())
    assert min(len(set(v) & set(np.argsort(-s[q])[:20].tolist())) for q, v in got.items()) == 20


PAGE = '<html><head><title>t</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">{0}</a></li></ul></nav><div class="ad">Buy {0}</div><article><h1>T {1}</h1><p><b>One &amp; {1}<br>two</p><p>In<i>li</i>ne {2}<p>Last</article><section id="comments"><p>nice</p></section><footer>f {0}</footer></body></html>'


def test_html(spark):
    pages = [(i, f"http://h{i % 2}.example/{i}", PAGE.format(i, i * 3, "x" * i)) for i in range(20)]
    odd = [(50, None, None), (51, "no url", ""), (52, "http://h0.example/z", "<p>un<b>closed &lt; &#233; <script>x<y</script> text<!-- no --> end"), (53, "http://deep/", "<div>" * 3000 + "deep" + "</div>" * 3000), pages[0], (None, "http://h9/", "just text")]
    table = spark.createDataFrame(pages + odd, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html_extraction.main_text(table).collect()]
    by = {r[0]: r[2] for r in got}
    for i in range(20):
        assert by[i] == f"T {i * 3} One & {i * 3} two Inline {'x' * i} Last".replace("  ", " ")
    assert (by[50], by[51], by[52], by[53], by[None]) == ("", "", "unclosed < é text end", "deep", "just text")
    assert len(got) == len(pages) + len(odd) and all(len(r[2]) == r[3] for r in got)
    assert html_extraction.main_text(table.limit(0)).isEmpty()


def test_template_is_learned_without_articles(spark):
    pages = [(i, "http://a.example/", f"<body><div>Welcome to our site</div><div><p>Story number {i} of many</p><p>{html.escape('<' + str(i) * 9)}</p></div><div>All about us</div></body>") for i in range(9)]
    got = {r["page_id"]: r["text"] for r in html_extraction.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[4] == "Story number 4 of many <444444444"


def test_template_is_counted_over_all_pages_of_a_host(spark):
    """Two layouts, an index page and an error page without the boilerplate, copies of a page, a host of two pages."""
    one = "<body><div>Welcome to our site</div><section><p>Story number {0} of many that were told on this site, {0}</p></section><div>All about us</div></body>"
    two = "<body><div>Bienvenue chez nous</div><table><tr><td>Table number {0} of many that were told on this site, {0}</td></tr></table><div>Tout sur nous</div></body>"
    inside = "<body><article><p>Read our other papers</p><p>Report number {0} with all of its findings</p></article></body>"
    pages = [(i, "http://a.example/", (two if i % 3 == 0 else one).format(i)) for i in range(90)]
    pages += [(100, "http://a.example/", "<body><ul><li>Index</li></ul></body>"), (101, "http://a.example/", "<body><p>Not found</p></body>")]
    pages += [(200 + i, "http://b.example/", one.format(i)) for i in range(2)] + [(300 + i, "http://c.example/", inside.format(max(i, 8))) for i in range(24)]
    got = {r["page_id"]: r["text"] for r in html_extraction.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == (f"Table number {i} of many that were told on this site, {i}" if i % 3 == 0 else f"Story number {i} of many that were told on this site, {i}") for i in range(90))
    assert (got[100], got[101]) == ("Index", "Not found") and all(got[200 + i] == f"Story number {i} of many that were told on this site, {i}" for i in range(2))
    assert all(got[300 + i] == f"Report number {max(i, 8)} with all of its findings" for i in range(24))


@pytest.mark.parametrize("region", ["article", "main"])
def test_linked_lists_in_articles_stay(spark, region):
    links = "<{0}><a href='/a'>Adams 1979</a> <a href='/b'>Brown 1983</a></{0}>"
    page = f"<body>{links.format('div')}<{region}><p>Text.</p><ul><li><a href='/c'>Clark 1990</a></li><li><a href='/d'>Davis 1991</a></li></ul>{links.format('section')}</{region}></body>"
    table = spark.createDataFrame([(1, "http://a.example/", page), (2, "http://b.example/", f"<body>{links.format('div')}<p>Text.</p></body>")], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extraction.main_text(table).collect()} == {1: "Text. Clark 1990 Davis 1991 Adams 1979 Brown 1983", 2: "Text."}


def test_tree_matching():
    a, b = html_extraction.parse("<ul><li>1<li>2<li>3</ul>"), html_extraction.parse("<ul><li>1</li><p>x</p><li>3</li></ul>")
    assert len(list(html_extraction.align(a, b))) == 4 == html_extraction._score(a, b, {})


def test_licenses(spark):
    lines = {
        "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "All rights reserved.": "proprietary",
        "This work is licensed under the GNU General Public License, version 3.": "gpl", "This work is licensed under the GNU Affero General Public License, version 3.": "agpl", "Licensed under CC BY-SA 4.0.": "cc-by-sa",
        "Licensed under the Acme Terms.": "unknown", "The weather was fine that day.": "none", "": "none", "A driver must carry a license at all times.": "none",
    }
    data = [(i, f"{passage(30)}\n{line}\n{passage(5)}") for i, line in enumerate(lines)] + [(None, None), (3, ""), (4, "Released under the MIT License.\nAll rights reserved."), (5, "x " * 5000 + "\nReleased under the MIT License.")]
    got = [(r["doc_id"], r["family"], r["n_paragraphs"]) for r in licenses.licences(spark.createDataFrame(data, "doc_id long, text string").withColumn("family", F.lit("clash"))).collect()]
    assert [g[1] for g in got[: len(lines)]] == list(lines.values())
    assert got[len(lines)][1:] == ("none", 0) and got[len(lines) + 1][1] == "none" and got[len(lines) + 2][2] == 2 and got[-1][1] == "mit"
    assert licenses.licences(spark.createDataFrame([], "doc_id long, text string")).isEmpty()


@pytest.mark.parametrize("width", [40, 72, 80])
@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_wrapped_licences(spark, width, mark):
    wrapped = lambda text: "\n".join(mark + line for line in textwrap.wrap(text, width))
    wanted = {"mit": 2, "bsd": 0, "gpl": 2, "agpl": 1, "apache-2.0": 1}
    data = [(f, 0, wrapped(licenses.TEMPLATES[f][i])) for f, i in wanted.items()]
    data += [(f, 1, f"Copyright 2020 A. Author\n{text}\n{passage(12)}\n\n{passage(30)}") for f, _, text in data]
    data += [("none", 2, wrapped(passage(200))), ("none", 3, wrapped("A driver must carry a license at all times and the weather was fine that day on the way to the public library."))]
    got = licenses.licences(spark.createDataFrame([(i, text) for i, (_, _, text) in enumerate(data)], "doc_id long, text string")).collect()
    assert [(r["family"], r["confirmed"]) for r in got] == [(f, f != "none") for f, _, _ in data]
    assert all(r["n_paragraphs"] == 1 for r, (f, k, _) in zip(got, data, strict=True) if k == 0 and f != "apache-2.0")  # its first line has a template of its own


@pytest.mark.parametrize("grades", [2, 4])
def test_ordinal_fit(grades):
    rng = np.random.default_rng(0)
    w = rng.normal(size=30)
    x = rng.normal(size=(3000, 30))
    s = x @ w
    y = np.searchsorted(np.quantile(s, np.arange(1, grades) / grades), s + rng.logistic(size=3000) * 0.3).astype(float)
    rows, cols = np.divmod(np.arange(2000 * 30), 30)
    m = ordinal.fit(rows, cols, x[:2000].ravel(), y[:2000], 30, 0, 1.0)
    r, c = np.divmod(np.arange(1000 * 30), 30)
    expected, tail = m.grade(m.score(r, c, x[2000:].ravel(), 1000))
    assert np.abs(expected - y[2000:]).mean() < 0.35 and (np.diff(m.thresholds) > 0).all()
    assert ((tail > 0.5) == (y[2000:] >= 1)).mean() > 0.9


def found_and_right(rows, held, kind, flagged):
    """Recall and precision of the flagged rows."""
    n = rows.join(held, "doc_id").agg(F.count_if(F.expr(f"{flagged} AND {kind}")).alias("hit"), F.count_if(F.expr(kind)).alias("all"), F.count_if(F.expr(flagged)).alias("told")).first()
    return n["hit"] / n["all"], n["hit"] / max(1, n["told"])


@pytest.mark.parametrize(("sf", "bars"), [("sf0.01", (0.99, 0.75, 0.4, 0.9)), ("sf0.1", (0.99, 0.9, 0.8, 0.95))])
def test_quality_and_toxicity_on_held_out_rows(spark, sf, bars):
    """Fitted on every second label, judged on the others: good documents kept and bad ones rejected, toxic ones found and
    rightly so. The 182 labels of sf0.01 are few for toxicity."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    half, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    quality, toxic = ordinal.quality(docs, half), ordinal.toxicity(docs, half)
    kept = found_and_right(quality, held, "quality = 1", "decided")[0]
    rejected = found_and_right(quality, held, "quality = 0", "NOT decided")[0]
    found, right = found_and_right(toxic, held, "toxic = 1", "decided")
    assert (kept >= bars[0], rejected >= bars[1], found >= bars[2], right >= bars[3]) == (True,) * 4, (kept, rejected, found, right)


def brute_span(b):
    h, power = 0, 1
    for c in b:
        h, power = h + (c + 1) * power, power * 0x9E3779B97F4A7C15 % (1 << 64)
    return int(mix(np.array([h % (1 << 64)], np.uint64))[0])


def brute_toxic(text):
    out = set()
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    for w in re.findall(rb"[a-z\x80-\xff]+", low):
        for kind, part in ((0, w), (1, w[:4] if len(w) > 4 else None), (2, w[:5] if len(w) > 5 else None)):
            if part is not None:
                out.add(int(mix(np.array([(brute_span(part) + kind) % (1 << 64)], np.uint64))[0]) >> 44)
    return {i: 1.0 for i in out}


def brute_quality(text):
    b = (text or "").encode()
    if len(b) < 3:
        return {}
    n = {}
    for x, y, z in zip(b, b[1:], b[2:], strict=False):
        at = ((x * 0x9E3779B1 ^ y * 0x85EBCA77 ^ z * 0xC2B2AE3D) & 0xFFFFFFFF) >> 18
        n[at] = n.get(at, 0) + 1
    size = sum(np.log1p(c) ** 2 for c in n.values()) ** 0.5
    w = text.split()
    dims = ordinal.QUALITY_DIMS
    share = lambda f: sum(map(f, b)) / len(b)
    return {at: np.log1p(c) / size for at, c in n.items()} | {
        dims: sum(x == y for x, y in zip(w, w[1:], strict=False)) / max(1, len(w) - 1), dims + 1: share(lambda c: 65 <= c <= 90),
        dims + 2: 1 - share(lambda c: 97 <= c | 32 <= 122 or c >= 128 or c == 32), dims + 3: len(set(w)) / max(1, len(w)),
    }


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_scores_of_a_fitted_model_by_loops(spark, docs, rows, kind):
    docs_, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    features, brute, dims = (ordinal.quality_features, brute_quality, ordinal.QUALITY_DIMS + 4) if kind == "quality" else (ordinal.toxic_features, brute_toxic, 1 << ordinal.TOXIC_BITS)
    model = ordinal.train(docs_, labels, kind, features, dims, 0.01, 1.0, 0.9)
    weight = dict(zip(model.at.tolist(), model.weights.tolist(), strict=True))
    texts = [r[1] for r in rows] + [r["text"] for r in docs_.limit(60).collect()] + ["Äbc déf " * 2000, "aaaaa aaaaaa AAAAA\x00b", "\ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16")]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in ordinal.score(table, model, features, dims).collect()}
    assert len(weight) > 5
    for i, t in enumerate(texts):
        s = sum(weight.get(at, 0) * v for at, v in brute(t).items())
        tail = 1 / (1 + np.exp(model.thresholds[0] - s))
        assert got[i]["tail"] == pytest.approx(tail, abs=1e-9) and got[i]["expected"] == pytest.approx(tail, abs=1e-9) and got[i]["decided"] == (got[i]["tail"] >= model.decide)


def test_training_is_bounded(spark, monkeypatch):
    """A repeated id trains once a grade, a long text with the features that hash lowest."""
    seen = []
    real = ordinal.fit
    monkeypatch.setattr(ordinal, "fit", lambda rows, index, value, grade, *a, **k: seen.append((len(grade), np.bincount(rows).max())) or real(rows, index, value, grade, *a, **k))
    docs = spark.createDataFrame([(i % 30, " ".join("".join(RNG.choices("abcdefgh", k=7)) for _ in range(200)) + (" good" if i % 2 else " bad")) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] * 3, "doc_id long, toxic int")
    ordinal.toxicity(docs, labels, most_labels=40, most_features=100).count()
    assert seen[-1] == (seen[-1][0], 100) and seen[-1][0] <= 30


def test_ordinal_edges(spark, empty):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x y z"), (3, "ab"), (3, "ab")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(3, 1, 0), (None, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        assert ordinal.quality(docs, labels).where("decided").count() == 5 and ordinal.toxicity(docs, labels).where("decided").isEmpty()
        assert ordinal.good_documents(docs, labels, docs).count() == 5
    assert ordinal.quality(empty, one).isEmpty()


def test_pipeline(spark, monkeypatch):
    """What run() hands from stage to stage, and its pieces, against brute force."""
    from tokenizers import Tokenizer

    sf, seen = "/root/testdata/sf0.001", []
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns

    def noted(stage):
        return lambda spark, docs, sf_dir: seen.append((docs.columns, docs.collect())) or stage(spark, docs, sf_dir)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, noted(stage)) for name, stage in corpus_pipeline.STAGES])
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert all(c == columns for c, _ in seen)
    documents, quality, near, repeats, mixed = (rows for _, rows in seen)

    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    scored = ordinal.quality(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert sorted(r["doc_id"] for r in quality) == sorted(r["doc_id"] for r in scored if r["decided"])
    kept = {r["doc_id"] for r in quality}
    assert sum(i in kept for i, q in labels.items() if q == 1) >= 0.95 * sum(q == 1 for q in labels.values())
    assert sum(i in kept for i, q in labels.items() if q == 0) <= 0.2 * sum(q == 0 for q in labels.values()) and len(kept) < len(documents)

    fps = [simhash_dedup.fingerprint(r["text"]) for r in quality]
    order = sorted(range(len(quality)), key=lambda i: quality[i]["doc_id"])
    root = brute_components(len(quality), [[(fps[a] ^ fps[b]).bit_count() <= 4 for b in order] for a in order])
    assert sorted(map(tuple, near), key=str) == sorted((tuple(quality[order[i]]) for i in set(root)), key=str)

    want = {i: s for i, n, g, s in brute_repeats([tuple(r) for r in near]) if g < n or not n}
    assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in repeats} == want
    assert all(r["n_chars"] == len(r["text"]) for r in repeats + mixed)

    by, texts, taken = {}, {r["doc_id"]: words_of(r["text"]) for r in repeats}, {}
    for r in repeats:
        by[r["source"]] = by.get(r["source"], 0) + len(texts[r["doc_id"]])
    names = sorted(s for s in by if s is not None) + [None] * (None in by)
    targets = dict(zip(names, brute_targets([by[s] for s in names]), strict=True))
    words, cuts = {}, {}
    for r in mixed:
        w = words_of(r["text"])
        assert w == texts[r["doc_id"]][: len(w)] and w
        cuts[r["source"]] = cuts.get(r["source"], 0) + (len(w) < len(texts[r["doc_id"]]))
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(w)
        taken[r["source"]] = taken.get(r["source"], 0) + len(w)
    assert all(abs(taken.get(s, 0) - targets[s]) <= 1 for s in names) and all(n <= 1 for n in cuts.values())
    assert all(n <= 2 * len(texts[i]) for i, n in words.items())

    t, own = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json")), []
    for r in mixed:
        ids = [*t.encode(r["text"], add_special_tokens=False).ids, 1]
        own += [(r["doc_id"], p, a, len(c), zlib.crc32(c.tobytes())) for p, a in enumerate(range(0, len(ids), 4096)) for c in [np.array(ids[a : a + 4096], "<u4")]]
    assert sorted(own) == sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces)
    placed = {}
    for r in pieces:
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in placed.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [a for a, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 4096
    assert len(placed) <= -(-sum(p[3] for p in own) // 4096) + 2


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages_on_odd_rows(spark, docs, rows, empty, k):
    """Nulls, repeated rows, clashing columns and an empty table: each stage returns what it is to."""
    name, stage = corpus_pipeline.STAGES[k]
    sf = "/root/testdata/sf0.001"
    odd = docs.union(docs.limit(4)).withColumn("n_words", F.lit("clash")).withColumn("shard", F.lit(1.5)).withColumn("_kept", F.lit("x")).withColumn("piece", F.lit(None).cast("string"))
    out = stage(spark, odd, sf)
    got = out.collect()
    assert stage(spark, empty, sf).isEmpty()
    if name == "packing":
        assert sum(r["piece"] == 0 for r in got) == odd.count() and out.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"]
        return
    assert out.columns == odd.columns and out.schema["shard"].dataType == odd.schema["shard"].dataType and {r["n_words"] for r in got} <= {"clash"}
    texts = {r[1] for r in rows}
    if name in ("quality", "simhash_dedup"):
        assert {r["text"] for r in got} <= texts and got
        assert name != "simhash_dedup" or len({r["doc_id"] for r in got if r["doc_id"] is not None}) == sum(r["doc_id"] is not None for r in got)
    if name == "mixing":
        plan = mixing.plan(odd, levels=1).agg(F.expr("sum(passes * size + extra)")).first()[0]
        assert sum(len(words_of(r["text"])) for r in got) == plan


def test_pipeline_leaves_only_its_result(spark, monkeypatch, tmp_path):
    import os

    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda spark: str(tmp_path))
    corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    (home,) = tmp_path.iterdir()
    assert sorted(os.listdir(home)) == ["4-packing"]


def test_every_operator_is_registered():
    assert [sum(q.startswith(f"op{n}_") for q in queries.QUERIES) for n in range(1, 11)] == [1] * 10


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    con.execute(queries.ORACLES[name])
    names = [c[0] for c in con.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(str(tuple(r[c] for c in names)) for r in df.collect()) == sorted(map(str, con.fetchall()))
