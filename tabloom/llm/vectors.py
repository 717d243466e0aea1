"""Embedding near-duplicates by a pivot-permutation index (operator 2).

Each vector is described by its nearest reference points (pivots). Vectors meet in the inverted list of every
pair of pivots that both have among their nearest, and are verified there if they share enough pivots: exact
cosine in double precision. Long lists are dealt out as blocks against blocks, so that no task grows with a list.
Equal vectors meet once, with their number.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialize, numbered, ship, table, unique_ids

#: Members of an inverted list that one block holds.
BLOCK = 1024


def reference_points(vectors: DataFrame, count: int) -> list[list[float]]:
    """count distinct vectors drawn by a hash of their id: a bounded, reproducible sample."""
    return [list(r[0]) for r in vectors.select("v", F.xxhash64(F.lit(7), "rep").alias("o")).orderBy("o").limit(count).collect()]


def _index(reps: DataFrame, pivots: list[list[float]], nearest: int) -> DataFrame:
    """(rep, label, dim, mask, key, v): one row per pair of a vector's nearest pivots; mask has a bit per near pivot."""
    raw = [[float(x) for x in p] for p in pivots]

    def describe(batches) -> Iterator:
        from itertools import combinations

        import numpy as np
        import pyarrow as pa

        by_dim: dict[int, object] = {}
        for batch in batches:
            out: list[tuple] = []
            for rep, label, v in zip(batch.column("rep").to_pylist(), batch.column("label").to_pylist(), batch.column("v").to_pylist(), strict=True):
                x = np.array(v, np.float64)
                if len(x) not in by_dim:
                    m = np.zeros((len(raw), len(x)))
                    for i, p in enumerate(raw):
                        m[i, : min(len(p), len(x))] = p[: len(x)]
                    most = np.abs(m).max(axis=1, keepdims=True)
                    m = m / np.where(most > 0, most, 1)
                    norm = np.linalg.norm(m, axis=1, keepdims=True)
                    by_dim[len(x)] = m / np.where(norm > 0, norm, 1)
                scores = by_dim[len(x)] @ (x / np.abs(x).max())
                near = sorted(np.argsort(-scores, kind="stable")[:nearest].tolist())
                mask = sum(1 << i for i in near)
                for i, j in combinations(near, 2) if len(near) > 1 else [(near[0], near[0])]:
                    out.append((rep, label, len(x), mask, 64 * i + j, x.tobytes()))
            if out:
                types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["rep", "label", "dim", "mask", "key", "v"])

    return reps.select("rep", "label", "v").mapInArrow(describe, "rep long, label string, dim int, mask long, key int, v binary")


def _verify(blocks: DataFrame, threshold: float, min_shared: int) -> DataFrame:
    """Links (a, b) with a < b, each found once: in the list of the two lowest pivots that they share."""

    def compare(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def close(key, rows):
            x = np.frombuffer(b"".join(r[1] for r in rows), np.float64).reshape(len(rows), -1)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            ids, mask, side = (np.array([r[i] for r in rows], np.int64) for i in (0, 2, 3))
            lo, hi = key[3], key[4]
            left, right = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
            i, j = np.nonzero(x[left] @ x[right].T >= threshold)
            i, j = left[i], right[j]
            common = mask[i] & mask[j]
            first = common & -common
            rest = common ^ first
            second = rest & -rest
            p, q = divmod(key[2], 64)
            shared = np.array([int(c).bit_count() for c in common.view(np.uint64)]) if len(common) else np.empty(0, int)
            want = np.int64(1 << p) | (np.int64(1 << q) if p != q else 0)
            ok = ((first | second) == want) & (shared >= min(min_shared, 1 if p == q else min_shared)) & ((ids[i] < ids[j]) if lo == hi else True)
            return np.minimum(ids[i], ids[j])[ok], np.maximum(ids[i], ids[j])[ok]

        def batch_of(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        at, rows = None, []
        for batch in batches:
            for *key, rep, v, mask, side in zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "key", "lo", "hi", "rep", "v", "mask", "side")), strict=True):
                if key != at:
                    if len(rows) > 1:
                        yield batch_of(*close(at, rows))
                    at, rows = key, []
                rows.append((rep, v, mask, side))
        if len(rows) > 1:
            yield batch_of(*close(at, rows))

    return blocks.mapInArrow(compare, "a long, b long")


def label_text(df: DataFrame, label: str) -> Column:
    """A label of any type as text: equal labels have equal texts, different ones different texts."""
    c = F.col(label)
    return (F.when(c == 0, F.lit(0.0)).otherwise(c) if dict(df.dtypes)[label] in ("double", "float") else c).cast("string")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, pivots: int = 60, nearest: int = 7, min_shared: int = 2, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for every row of vectors.

    Two vectors are compared only if their labels (of any type) are equal and not null and they have the same length. A vector that is
    null, empty, zero, or has a null or non-finite component links with nothing. Rows that repeat an id, or have none, are
    vectors of their own; component_id is the smallest id of the component (null if no member has one), and kept tells the one
    row of it that stays. Other columns are not read; an empty table gives an empty result. Links are exact; the index may
    miss some (recall is measured in the tests), never invents one.
    """
    if unique_ids(vectors, vec_id):
        return _near(vectors.select(F.col(vec_id).alias("vec_id"), embedding, label), threshold, pivots, nearest, min_shared, "vec_id", embedding, label)
    rows = numbered(vectors, vec_id, embedding, label)
    found = _near(rows, threshold, pivots, nearest, min_shared, "key", embedding, label).select(F.col("vec_id").alias("key"), "n_links", F.col("component_id").alias("c"))
    found = materialize(found.join(rows.select("key", F.col(vec_id).alias("vec_id")), "key"), "found")
    first = found.groupBy("c").agg(F.min(F.struct(F.col("vec_id").isNull().alias("none"), "vec_id", "key")).alias("x"))
    return found.join(first, "c").select("vec_id", "n_links", F.col("x.vec_id").alias("component_id"), (F.col("key") == F.col("x.key")).alias("kept"))


def _near(vectors: DataFrame, threshold: float, pivots: int, nearest: int, min_shared: int, vec_id: str, embedding: str, label: str) -> DataFrame:
    ship(vectors.sparkSession)
    spark = vectors.sparkSession
    inf = float("inf")
    v = F.col(embedding).cast("array<double>")
    fit = F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < inf), F.lit(False))) & F.exists(v, lambda x: x != 0)
    every = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), label_text(vectors, label).alias("label"), v.alias("v"), F.coalesce(fit, F.lit(False)).alias("fit"))
    usable = every.where("fit").select("vec_id", "label", "v", F.xxhash64("label", "v").alias("h"), F.xxhash64(F.lit(1), "label", "v").alias("g"))
    reps = materialize(usable.groupBy("label", "h", "g").agg(F.min("vec_id").alias("rep"), F.count("*").alias("same"), F.min_by("v", "vec_id").alias("v")), "reps")
    points = reference_points(reps, pivots)
    if not points:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    index = materialize(_index(reps, points, min(nearest, len(points))), "index")
    sizes = materialize(index.groupBy("label", "dim", "key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("m")).where("m > 1").drop("m"), "lists")
    dealt = index.join(sizes, ["label", "dim", "key"]).withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    blocks = other.select("label", "dim", "key", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "rep", "v", "mask", "side")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    group = ["label", "dim", "key", "lo", "hi"]
    links = materialize(_verify(blocks.repartition(parts, *group).sortWithinPartitions(*group), threshold, min_shared), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weight = reps.select(F.col("rep").alias("b"), "same")
    partners = both.join(weight, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("same").alias("partners"))
    comp = connected_components(reps.select("rep"), links, "rep")
    per_rep = materialize(reps.select("rep", "label", "h", "g", "same").join(partners, "rep", "left").join(comp, "rep").select("h", "g", "label", (F.col("same") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"), "component"), "result")
    mine = materialize(usable.select("vec_id", "label", "h", "g"), "members")
    found = mine.join(per_rep, ["label", "h", "g"]).select("vec_id", "n_links", F.col("component").alias("component_id"))
    rest = every.where(~F.col("fit")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op2_embedding_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
