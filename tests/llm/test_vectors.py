"""The permutation index by its footrule ranking, and embedding links under collisions, hot nodes and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import embedding_dedup
from tideline.llm import permutation_index as P

VECTORS = "vec_id long, embedding array<float>, label int"
ASKS = "vec_id % 20 = 0"


def table_of(spark, x):
    return spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x.astype(np.float32))], VECTORS)


def recalls(rows, x, step=20, k=20):
    x = x.astype(np.float32).astype(np.float64)
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    out = []
    for q in range(0, len(x), step):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(np.argsort(-s, kind="stable")[:k].tolist())
        own = sorted(got[q])
        assert [r for r, *_ in own] == list(range(1, min(k, len(x) - 1) + 1))
        assert all(s[v] == pytest.approx(c, abs=1e-12) for _, v, c in own) and [c for *_, c in own] == sorted((c for *_, c in own), reverse=True)
        out.append(len(best & {v for _, v, _ in own}) / len(best))
    return np.array(out)


def test_footrule_against_its_definition():
    rng = np.random.default_rng(0)
    perms = P.permutations(rng.normal(size=(30, 8)), rng.normal(size=(20, 8)), 7)
    far = P.footrules(perms, P.positions(perms, 20))
    place = lambda p, v: p.index(v) if v in p else 7
    for i, a in enumerate(perms.tolist()):
        assert far[i].tolist() == [sum(abs(place(a, v) - place(b, v)) for v in {*a, *b}) for b in perms.tolist()]


def test_footrule_ranks_and_saves_products(spark):
    """On sf0.1, by the production parameters: recall of at least 0.9 from under a quarter of a scan's products."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    counter = spark.sparkContext.accumulator(0)
    rows = P.search(table, F.expr(ASKS), counter=counter).collect()
    x = np.array([r["embedding"] for r in table.orderBy("vec_id").collect()], np.float32)
    found = recalls(rows, x)
    assert found.mean() >= 0.9 and found.min() >= 0.5
    assert 0 < counter.value < 0.25 * len(x) * len(found)


def test_lone_vectors_among_groups_of_copies(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([np.repeat(rng.normal(size=(14, 32)), 200, axis=0) + rng.normal(size=(2800, 32)) * 0.05, rng.normal(size=(200, 32))])
    x = x[rng.permutation(3000)]
    found = recalls(P.search(table_of(spark, x), F.expr(ASKS), sample_rows=1000, chunk_rows=256, query_rows=64).collect(), x)
    assert found.mean() >= 0.9 and found.min() > 0


def test_queries_that_visit_too_few_rows_are_completed(spark):
    x = np.random.default_rng(3).normal(size=(400, 16))
    found = recalls(P.search(table_of(spark, x), F.expr(ASKS), prefix=2, visits=0.001, coverage=0.1, chunk_rows=64, query_rows=8).collect(), x)
    assert len(found) == 20  # recalls() holds each to twenty rows in order


def test_odd_rows(spark):
    x = np.random.default_rng(4).normal(size=(60, 8)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(None, x[3].tolist(), 0), rows[20], rows[21], (90, None, 0), (91, [0.0] * 8, 0), (92, [1.0], 0), (100, x[5].tolist(), 0)]
    got = P.search(spark.createDataFrame(rows + odd, VECTORS).withColumn("rank", F.lit("clash")), F.expr(ASKS), exact=True).orderBy("query_id", "rank").collect()
    assert {r["query_id"] for r in got} == {0, 20, 40, 100} and len(got) == 80
    of = [r["vec_id"] for r in got if r["query_id"] == 100]
    assert 5 in of and 100 not in of and not {90, 91, 92, None} & set(of)
    assert [r["vec_id"] for r in got if r["query_id"] == 20].count(20) == 0
    assert P.search(spark.createDataFrame(odd[3:6], VECTORS), F.col("vec_id") == 92).isEmpty()


def brute_links(data):
    from test_llm import brute_components

    x = np.array([v for _, v, _ in data], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.93
    linked &= np.array([[a[2] is not None and a[2] == b[2] for b in data] for a in data])
    np.fill_diagonal(linked, False)
    return linked, brute_components(len(data), linked)


def near(rng, groups, each, dim=64):
    x = np.repeat(rng.normal(size=(groups, dim)), each, axis=0)
    return (x + rng.normal(size=x.shape) * 0.15).astype(np.float32)


@pytest.mark.parametrize("label", ["string", "date", "double"])
def test_labels_of_any_type(spark, label):
    x = near(np.random.default_rng(1), 10, 6)
    made = {"string": lambda i: "ab"[i % 2], "date": lambda i: f"2026-07-0{1 + i % 2}", "double": lambda i: str(0.5 + i % 2)}[label]
    data = [(i, v.tolist(), made(i)) for i, v in enumerate(x)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>, label string").withColumn("label", F.col("label").cast(label))
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(table).collect()}
    linked, root = brute_links(data)
    assert [got[i]["n_links"] for i in range(60)] == linked.sum(axis=1).tolist() and [got[i]["component_id"] for i in range(60)] == root


def test_buckets_that_collide_are_kept_apart(spark, monkeypatch):
    """With one code for all vectors every bucket holds all of a label and dimension; with one hash for all keys nothing changes."""
    monkeypatch.setattr(embedding_dedup, "buckets", lambda x, tables, hashes: np.tile(np.arange(1 + hashes), (len(x), tables, 1)))
    rng = np.random.default_rng(2)
    data = [(i, v.tolist(), i % 3) for i, v in enumerate(near(rng, 8, 9))] + [(100 + i, v.tolist(), i % 3) for i, v in enumerate(near(rng, 4, 6, 32))]
    for cell_rows in (2048, 4):
        got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(data, VECTORS), cell_rows=cell_rows).collect()}
        for part in (data[:72], data[72:]):
            linked, root = brute_links(part)
            assert [got[v[0]]["n_links"] for v in part] == linked.sum(axis=1).tolist()
            assert [got[v[0]]["component_id"] for v in part] == [part[r][0] for r in root]


@pytest.mark.parametrize("hashes", [2, 3, 4])
def test_every_plan_finds_pairs_at_the_threshold(hashes):
    assert [embedding_dedup.plan(n, 64)[1] for n in (0, 10_000, 1 << 24, 1 << 31)] == [2, 2, 2, 3]
    rng = np.random.default_rng(hashes)
    a = embedding_dedup.unit(rng.normal(size=(3000, 64)))
    b = rng.normal(size=a.shape)
    b = embedding_dedup.unit(b - (b * a).sum(axis=1, keepdims=True) * a)
    tables = embedding_dedup.TABLES[hashes]
    own, other = (embedding_dedup.buckets(x, tables, hashes) for x in (a, 0.93 * a + np.sqrt(1 - 0.93**2) * b))
    assert (own[:, :, :, None] == other[:, :, None, :]).any(axis=(1, 2, 3)).mean() > 0.998


def test_null_ids_and_labels(spark):
    x = near(np.random.default_rng(5), 2, 3)
    data = [(7, x[0].tolist(), 1), (None, x[1].tolist(), 1), (None, x[1].tolist(), 1), (3, x[2].tolist(), 1), (9, x[0].tolist(), None), (None, x[3].tolist(), 1)]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(data, VECTORS)).collect()), key=str)
    assert got == sorted([(7, 3, 3, False), (None, 3, 3, False), (None, 3, 3, False), (3, 3, 3, True), (9, 0, 9, True), (None, 0, None, False)], key=str)


def test_a_node_of_a_million_edges(spark):
    """Its edges don't meet in one task: they are joined by broadcast, the rest by node."""
    from tideline.llm import common

    n = 1_000_000
    star = spark.range(1, n).select(F.col("id").alias("a"), F.lit(n).cast("long").alias("b")).union(spark.range(10).select((F.col("id") + 2 * n).alias("a"), (F.col("id") + 2 * n + 1).alias("b")))
    low = star.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n")).withColumnRenamed("b", "a")
    text = common._with_least(star.select(F.col("b").alias("a"), F.col("a").alias("b")), low, 100_000)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text
    got = common.components(star).groupBy("root").agg(F.count("*").alias("n")).collect()
    assert {(r["root"], r["n"]) for r in got} == {(1, n), (2 * n, 11)}


@pytest.mark.parametrize("hot", [1, 3, 100])
def test_components_by_either_way(spark, hot):
    rng = np.random.default_rng(hot)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(500, i) for i in range(400, 420)]
    from tideline.llm.common import components

    parent = {x: x for e in edges for x in e}
    while True:
        new = {x: min([parent[x], *(parent[b] for a, b in edges if a == x), *(parent[a] for a, b in edges if b == x)]) for x in parent}
        if new == parent:
            break
        parent = new
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), hot=hot).collect()}
    assert got == {x: r for x, r in parent.items() if any(a != b for a, b in edges if x in (a, b))}
