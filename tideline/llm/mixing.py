"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over blocks of documents.

A document's size is its number of words. Sources take their weights in code-point order (null last); the mix takes
``share`` times all words, dealt by weight, where no source gives over ``most`` times its own words and what it leaves
is dealt again by weight among the others. Each source's documents stand in a seeded random order, cut into blocks. A
target is met by whole passes over the source and a last pass over as many blocks, in that order, as its rest needs; the
last document drawn is cut, so the words taken are the rounded target. The drawn blocks go down a binary tree: at each
node a uniform half of its blocks goes left, which makes the blocks a child has of each source a multivariate
hypergeometric draw from its parent's quotas. Leaves are output shards; a shard is shuffled by a seeded key.
Blocks are never over 65,536 plus one a source, whatever the input, so the tree is small; no text is shuffled.

Defined results: null texts and texts without words have size 0 and are never taken; a null source is a source of its
own, the last; rows with one id, or null ids, are documents of their own; equal rows may be taken unequally often. A source without words has target 0.
An empty table gives an empty result. Other columns pass through mixed_documents(), whose own columns win over
columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.common import WORD, cut, whole_row

WEIGHTS = (3, 1, 2)
MOST_BLOCKS = 65_536
LEAST_DOCS = 256
#: Documents, one a source at most, that may be broadcast.
MOST_BROADCAST = 10_000


def _hash28(*parts: object) -> F.Column:
    text = F.concat_ws(":", *(F.coalesce(F.col(p).cast("string"), F.lit("null")) if isinstance(p, str) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2, levels: int = 4, seed: int = 1, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, source, size, mark (of its text), source_size, target, passes, extra (words of the last
    pass), shards (of each whole pass, then of the last one if any)."""
    words = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words.alias("size"), F.md5(F.col(text_col).cast("string")).alias("mark"))
    sizes = cut(sizes.withColumn("key", _hash28(seed, "doc_id", "mark")))

    every = W.partitionBy().orderBy(F.asc_nulls_last("source"))
    rising = W.partitionBy().orderBy("ratio", F.asc_nulls_last("source")).rowsBetween(W.unboundedPreceding, -1)
    onward = W.partitionBy().orderBy("ratio", F.asc_nulls_last("source")).rowsBetween(0, W.unboundedFollowing)
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))).cast("int") + 1))
    sources = sources.withColumn("ratio", F.col("source_size").cast("double") / F.col("weight"))
    whole = W.partitionBy()
    sources = sources.select(
        "*", F.sum("source_size").over(whole).alias("all_words"), F.sum("docs").over(whole).alias("all_docs"),
        F.coalesce(F.sum("source_size").over(rising), F.lit(0)).alias("capped"), F.sum("weight").over(onward).alias("open"),
    )
    level = (F.lit(share[0]) * F.col("all_words") - F.lit(share[1] * most) * F.col("capped")).cast("double") / (F.lit(share[1]) * F.col("open")).cast("double")
    level = F.when(level * F.col("weight") <= (F.lit(most) * F.col("source_size")).cast("double"), level)
    sources = sources.withColumn("level", F.max(level).over(whole))
    target = F.least((F.lit(most) * F.col("source_size")).cast("double"), F.coalesce(F.col("level") * F.col("weight"), (F.lit(most) * F.col("source_size")).cast("double")))
    sources = sources.withColumn("target", target).withColumn("quota", F.round("target").cast("long"))
    per = F.greatest(F.lit(LEAST_DOCS), F.ceil(F.col("all_docs") / MOST_BLOCKS))
    sources = sources.select(
        "source", "source_size", "target", F.ceil(F.col("docs") / per).cast("long").alias("blocks"),
        F.expr("CASE WHEN source_size > 0 THEN quota div source_size ELSE 0 END").alias("passes"),
        F.expr("CASE WHEN source_size > 0 THEN quota % source_size ELSE 0 END").alias("rest"),
    )
    sources = cut(sources)

    def with_source(df: DataFrame) -> DataFrame:
        s = sources.withColumnRenamed("source", "of")
        return df.join(s, df["source"].eqNullSafe(s["of"])).drop("of")

    placed = with_source(sizes).withColumn("block", F.expr("(key * blocks) div 268435456"))
    before = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = placed.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    blocks = blocks.withColumn("left", F.col("rest") - F.coalesce(F.sum("words").over(before), F.lit(0)))
    drawn = blocks.select(
        "source", "block", F.expr("explode(CASE WHEN left > 0 AND words > 0 THEN sequence(0L, passes) WHEN passes > 0 THEN sequence(0L, passes - 1) ELSE array() END)").alias("pass"))
    drawn = drawn.withColumn("node", F.lit(0).cast("long"))
    for depth in range(levels):
        node = W.partitionBy("node")
        lot = node.orderBy(_hash28(seed, depth, "source", "block", "pass"), F.asc_nulls_last("source"), "block", "pass")
        drawn = drawn.select("source", "block", "pass", (F.col("node") * 2 + (F.row_number().over(lot) * 2 > F.count("*").over(node) + F.col("node") % 2).cast("long")).alias("node"))
    shards = drawn.groupBy("source", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "node"))), lambda x: x["node"]).alias("shards"))
    shards = shards.select(F.col("source").alias("s"), F.col("block").alias("b"), "shards")
    blocks = blocks.select("source", "block", "left").join(shards, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    blocks = blocks.select(F.col("source").alias("s"), F.col("block").alias("b"), "left", F.coalesce("shards", F.array().cast("array<long>")).alias("shards"))

    within = W.partitionBy("source", "block").orderBy("key", F.asc_nulls_last("doc_id"), "size").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.join(blocks, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.coalesce(F.sum("size").over(within), F.lit(0))))
    return placed.withColumn("extra", extra).select("doc_id", "source", "size", "mark", "source_size", "target", "passes", "extra", "shards")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options: object) -> DataFrame:
    """The mix: the rows of docs as often as it takes them, the last one of a source cut to the words taken, with shard
    and shuffle_key; sort by these to read a shard in its order.

    A row meets what the plan takes of it by id, source and a hash of its text. Rows equal in all three are alike to the
    plan and stand side by side in it, so they are taken alike but where a source's last pass ends among them: there (once
    a source) they are numbered, and the first ones are taken."""
    seed = options.get("seed", 1)
    whole = plan(docs, id_col=id_col, source_col=source_col, text_col=text_col, **options).where("passes * size + extra > 0")
    whole = whole.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("mark").alias("_mark")).agg(
        F.first("passes").alias("_passes"), F.first("size").alias("_size"), F.first("shards").alias("_shards"), F.count("*").alias("_n"), F.count_if(F.col("extra") >= F.col("size")).alias("_full"), F.max(F.when(F.col("extra") < F.col("size"), F.col("extra"))).alias("_part")
    )
    whole = cut(whole.withColumn("_part", F.coalesce("_part", F.lit(0))).withColumn("_ends", (F.col("_full") < F.col("_n")) & ((F.col("_full") > 0) | (F.col("_part") > 0))))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.md5(F.col(text_col).cast("string")).alias("of"), whole_row(docs)).where("of IS NOT NULL")
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("of") == F.col("_mark"))
    ends = whole.where("_ends")
    ends = F.broadcast(ends) if ends.count() <= MOST_BROADCAST else ends
    place = F.row_number().over(W.partitionBy("_id", "_source", "_mark").orderBy(F.lit(0)))
    extra = F.when(F.col("place") <= F.col("_full"), F.col("_size")).when(F.col("place") == F.col("_full") + 1, F.col("_part")).otherwise(0)
    alike = rows.join(whole.where("NOT _ends"), same).withColumn("extra", F.when(F.col("_full") > 0, F.col("_size")).otherwise(0))
    rows = alike.union(rows.join(ends, same).withColumn("place", place).withColumn("extra", extra).drop("place"))
    rows = rows.select("*", F.expr("explode(CASE WHEN extra > 0 THEN sequence(0L, _passes) WHEN _passes > 0 THEN sequence(0L, _passes - 1) ELSE array() END)").alias("pass"))
    whole_text = F.col(f"row.`{text_col}`").cast("string")
    part = F.array_join(F.slice(F.regexp_extract_all(whole_text, F.lit(f"({WORD})"), F.lit(1)), 1, F.col("extra").cast("int")), " ")
    text = F.when((F.col("pass") == F.col("_passes")) & (F.col("extra") < F.col("_size")), part).otherwise(whole_text).alias(text_col)
    own = [text if c == text_col else F.col(f"row.`{c}`") for c in docs.columns if c not in ("shard", "shuffle_key")]
    return rows.select(*own, F.get("_shards", F.col("pass").cast("int")).alias("shard"), _hash28(seed, 28, "id", "_mark", "pass").alias("shuffle_key"))
