"""Resampling of training rows by neighbours: cleaning by removing rows, and synthetic rows between neighbours.

Synthetic rows have key null, the label of their class, synthetic true and numeric features between a row and one of its
nearest rows of the class; draws are hashes of seed, key and number, so they are the same in any order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stages import keep
from .neighbors import nearest


def _draw(seed: int, what: str, *key: str | Column) -> Column:
    """Uniform in [0, 1), by hash."""
    h = F.xxhash64(F.lit(f"{seed}|{what}"), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key])
    return F.pmod(h, F.lit(1 << 52)) / float(1 << 52)


def _sizes(train: DataFrame, label: str) -> dict:
    """Rows of each class; classes are few, or it is no classification."""
    found = train.where(F.col(label).isNotNull()).groupBy(label).count().limit(1001).collect()
    if len(found) > 1000:
        raise ValueError(f"{label} has more than 1000 classes")
    return {r[0]: r[1] for r in found}


def _majority(sizes: dict):
    """The largest class; ties: the first in order."""
    return min(sizes, key=lambda c: (-sizes[c], str(c)))


def tomek_links(train: DataFrame, label: str, key: str, features: list[str] | str) -> DataFrame:
    """(a, b): pairs a < b of different classes that are each other's nearest row (ties by key)."""
    one = nearest(train, train, key, features, 1).select(F.col("query").alias("a"), F.col("key").alias("b"))
    mutual = one.join(one.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"]).where("a < b")
    labels = train.select(F.col(key).alias("k"), F.col(label).alias("l"))
    both = mutual.join(labels.withColumnsRenamed({"k": "a", "l": "la"}), "a").join(labels.withColumnsRenamed({"k": "b", "l": "lb"}), "b")
    return both.where("la <> lb").select("a", "b")


def _drop(train: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    return train.join(gone, key, "left_anti")


def tomek(train: DataFrame, label: str, key: str, features: list[str] | str) -> DataFrame:
    """train without the majority members of Tomek links: those of the classes that are not the smallest."""
    sizes = _sizes(train, label)
    least = min(sizes, key=lambda c: (sizes[c], str(c)))
    links = tomek_links(train, label, key, features)
    ends = links.select(F.explode(F.array("a", "b")).alias(key)).distinct()
    return _drop(train, key, train.where(F.col(label) != least).select(key).join(ends, key, "left_semi"))


def enn(train: DataFrame, label: str, key: str, features: list[str] | str, k: int = 3) -> DataFrame:
    """train without the rows of classes other than the smallest of whose k nearest rows not all are of their class."""
    sizes = _sizes(train, label)
    least = min(sizes, key=lambda c: (sizes[c], str(c)))
    labels = train.select(F.col(key).alias("key"), F.col(label).alias("l"))
    other = nearest(train.where(F.col(label) != least), train, key, features, k).join(labels, "key").join(labels.select(F.col("key").alias("query"), F.col("l").alias("own")), "query").where("not l <=> own")
    return _drop(train, key, other.select(F.col("query").alias(key)).distinct())


def near_miss(train: DataFrame, label: str, key: str, features: list[str] | str, k: int = 3) -> DataFrame:
    """Every class cut to the size of the smallest: the rows with the least mean distance to the k nearest rows of the smallest class (ties by key)."""
    sizes = _sizes(train, label)
    least = min(sizes, key=lambda c: (sizes[c], str(c)))
    far = nearest(train.where(F.col(label) != least), train.where(F.col(label) == least), key, features, k).groupBy(F.col("query").alias(key)).agg(F.avg("distance").alias("_far"))
    rows = train.join(far, key)
    kept = rows.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy("_far", key))).where(F.col("_r") <= sizes[least]).drop("_far", "_r")
    return train.where(F.col(label) == least).unionByName(kept.select(*train.columns))


def _towards(seeds: DataFrame, pool: DataFrame, key: str, features: list[str], k: int, seed: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """Each row of seeds (key, _copy, features) with one of its k nearest rows of the pool: its distance, its values under _ and _u in [0, 1)."""
    near = nearest(seeds.select(key, *features).distinct(), pool, key, features, k)
    count = near.groupBy("query").agg(F.count(F.lit(1)).alias("_k"))
    chosen = seeds.join(count, seeds[key] == count["query"]).withColumn("place", (1 + F.floor(_draw(seed, "neighbour", key, "_copy") * F.col("_k"))).cast("int"))
    to = pool.select(F.col(key).alias("_to"), *[F.col(f).cast("double").alias(f"_{f}") for f in [*features, *carry]])
    return chosen.join(near.select("query", "place", F.col("key").alias("_to"), F.col("distance").alias("_distance")), ["query", "place"]).join(to, "_to").withColumn("_u", _draw(seed, "way", key, "_copy"))


def _between(seeds: DataFrame, pool: DataFrame, key: str, features: list[str], k: int, seed: int) -> DataFrame:
    """A synthetic row for each row of seeds (key, _copy, features): from the row towards one of its k nearest rows of the pool."""
    joined = _towards(seeds, pool, key, features, k, seed)
    return joined.withColumns({f: F.col(f).cast("double") + F.col("_u") * (F.col(f"_{f}") - F.col(f).cast("double")) for f in features})


def _quota(rows: DataFrame, key: str, n: int, total: int, seed: int) -> DataFrame:
    """n copies of total rows as evenly as it goes, the rest by a shuffled order: (_copy from 1)."""
    from ..functions.columns import shuffled_rank

    each, rest = divmod(n, total)
    ranked = shuffled_rank(rows, seed, key, name="_rank").withColumn("_n", F.lit(each) + (F.col("_rank") <= rest).cast("int"))
    return ranked.where("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("_rank", "_n")


def _made(train: DataFrame, new: DataFrame, key: str, features: list[str], label: str, value) -> DataFrame:
    """Synthetic rows in the columns of train: the key and all other columns are null."""
    kinds = {f.name: f.dataType for f in train.schema}
    double = {c: "double" for c in features}
    cols = [F.col(c).alias(c) if c in features else F.lit(value).cast(kinds[c]).alias(c) if c == label else F.lit(None).cast(double.get(c, kinds[c])).alias(c) for c in train.columns]
    return new.select(*cols, F.lit(True).alias("synthetic"))


def smote(train: DataFrame, label: str, key: str, features: list[str], k: int = 5, seed: int = 0, danger: str | None = None) -> DataFrame:
    """train (features as doubles) with synthetic false, and synthetic rows that bring every class to the size of the largest.

    danger: None seeds from every row of a class; 'borderline' only from rows of whose k nearest rows at least half, but not all, are of
    other classes; 'adaptive' in proportion to the share of other classes among the k nearest rows. A class where no row
    qualifies is seeded from all of its rows; a class of one row cannot be interpolated and is refused.
    """
    if danger not in (None, "borderline", "adaptive"):
        raise ValueError("danger must be None, borderline or adaptive")
    sizes = _sizes(train, label)
    most = max(sizes.values(), default=0)
    base = train.withColumns({f: F.col(f).cast("double") for f in features})
    out = base.withColumn("synthetic", F.lit(False))
    labels = base.select(F.col(key).alias("key"), F.col(label).alias("l"))
    for c, n in sorted(sizes.items(), key=lambda x: str(x[0])):
        if n == most:
            continue
        pool = base.where(F.col(label) == F.lit(c)).dropna(subset=features)
        usable = pool.count()
        if usable < 2:
            raise ValueError(f"class {c} has fewer than two rows with known features")
        seeds, add = pool, most - n
        if danger:
            near = nearest(pool, base, key, features, k).join(labels, "key")
            share = near.groupBy(F.col("query").alias(key)).agg(F.avg((~F.col("l").eqNullSafe(F.lit(c))).cast("double")).alias("_share"))
            seeds = keep(pool.join(share, key).where((F.col("_share") >= 0.5) & (F.col("_share") < 1) if danger == "borderline" else F.col("_share") > 0))
            found = seeds.agg(F.count(F.lit(1)), F.sum("_share")).first()
            if danger == "adaptive" and found[0]:
                counted = seeds.withColumn("_n", F.round(F.col("_share") / F.lit(found[1]) * add).cast("int")).where("_n > 0")
                new = _between(counted.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n", "_share"), pool, key, features, k, seed)
                out = out.unionByName(_made(base, new, key, features, label, c))
                continue
            seeds, usable = (seeds.drop("_share"), found[0]) if found[0] else (pool, usable)
        new = _between(_quota(seeds, key, add, usable, seed), pool, key, features, k, seed)
        out = out.unionByName(_made(base, new, key, features, label, c))
    return out


def smote_clean(train: DataFrame, label: str, key: str, features: list[str], how: str = "enn", k: int = 5, seed: int = 0) -> DataFrame:
    """smote(), then enn or tomek over all rows with numbers of their own; of these rows any class may go."""
    if how not in ("enn", "tomek"):
        raise ValueError("how must be enn or tomek")
    made = keep(smote(train, label, key, features, k, seed).withColumn("_row", F.monotonically_increasing_id()))
    if how == "tomek":
        gone = tomek_links(made, label, "_row", features).select(F.explode(F.array("a", "b")).alias("_row")).distinct()
    else:
        labels = made.select(F.col("_row").alias("key"), F.col(label).alias("l"))
        near = nearest(made, made, "_row", features, 3).join(labels, "key").join(labels.select(F.col("key").alias("query"), F.col("l").alias("own")), "query")
        gone = near.where("not l <=> own").select(F.col("query").alias("_row")).distinct()
    return _drop(made, "_row", gone).drop("_row")
