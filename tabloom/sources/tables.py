"""Reading, writing and editing tables: delimited files, snapshots, the library, row updates."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import finite, is_numeric, shuffle_key


def sniff_delimiter(lines: list[str]) -> str:
    """The separator that occurs equally often, and most often, in the first lines."""
    best = max(",;\t|", key=lambda d: (min(x.count(d) for x in lines), d == ",")) if lines else ","
    return best if lines and lines[0].count(best) else ","


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """A delimited text file with a header: UTF-8 or cp1251, separator found from its first lines; ragged rows are refused."""
    raw = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 65536).alias("c")).first()["c"]
    try:
        head, encoding = bytes(raw[: len(raw) - (len(raw) > 65000) * 4]).decode("utf-8-sig"), "UTF-8"
    except UnicodeDecodeError:
        head, encoding = bytes(raw).decode("cp1251"), "windows-1251"
    lines = [x for x in head.splitlines() if x.strip()][:20]
    sep = sniff_delimiter(lines)
    names = [c.strip().strip('"') for c in lines[0].split(sep)] if lines else []
    if not names or any(not c for c in names) or len(set(names)) != len(names):
        raise ValueError("the header needs names that differ")
    schema = ", ".join(f"`{c}` string" for c in names)
    return spark.read.csv(path, schema=schema, sep=sep, header=True, encoding=encoding, mode="FAILFAST", enforceSchema=True)


def coerce(df: DataFrame) -> DataFrame:
    """Text columns become numbers where every value is one, with a point or else with a comma for decimals; columns with texts for NaN or infinities stay text."""
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    if not texts:
        return df
    cast = lambda c: c.try_cast("double")
    number = lambda c: F.when(~F.isnan(cast(c)) & (F.abs(cast(c)) < float("inf")), cast(c))
    aggs: list[Column] = []
    for c in texts:
        x = F.trim(F.col(f"`{c}`"))
        x = F.when(x == "", None).otherwise(x)
        aggs += [F.count(x).alias(f"{c}|n"), F.count(number(x)).alias(f"{c}|p"), F.count(number(F.replace(x, F.lit(","), F.lit(".")))).alias(f"{c}|c")]
    row = df.agg(*aggs).first()
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if f.name in texts:
            x = F.when(F.trim(c) == "", None).otherwise(F.trim(c))
            if row[f"{f.name}|n"] and row[f"{f.name}|n"] == row[f"{f.name}|p"]:
                c = x.try_cast("double")
            elif row[f"{f.name}|n"] and row[f"{f.name}|n"] == row[f"{f.name}|c"]:
                c = F.replace(x, F.lit(","), F.lit(".")).try_cast("double")
            else:
                c = x
        out.append(c.alias(f.name))
    return df.select(*out)


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return coerce(spark.createDataFrame(rows))


def write_snapshot(df: DataFrame, root: str, name: str, parent: str | None = None, tags: list[str] | None = None, tasks: list[str] | None = None, source: str = "custom", target: str | None = None) -> str:
    """Writes an immutable table with row ids under a new id and adds its row to the library."""
    spark, new = df.sparkSession, uuid.uuid4().hex
    kept = df.select(*[(finite(F.col(f.name)) if f.dataType.simpleString() in ("double", "float") else F.col(f.name)).alias(f.name) for f in df.schema])
    if "row_id" not in kept.columns:
        kept = kept.withColumn("row_id", F.monotonically_increasing_id())
    kept.write.parquet(f"{root}/{new}")
    meta = [(new, name, parent, source, tags or [], tasks or [], target)]
    row = spark.createDataFrame(meta, "id string, name string, parent_id string, source string, tags array<string>, tasks array<string>, target string")
    row.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(f"{root}/library")
    return new


def read_snapshot(spark: SparkSession, root: str, snapshot: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{root}/{snapshot}")
    return df.select(*columns) if columns else df


def viewport(df: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    """Rows with keys from offset on; a filter on the stored key, so only files that hold them are read."""
    return df.where((F.col(key) >= offset) & (F.col(key) < offset + min(limit, 500))).orderBy(key)


def update_rows(df: DataFrame, key: str, changes: DataFrame | None = None, additions: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """A new version of df: changes has the key and new values of some columns, additions whole rows, deletes keys.

    Every key may be edited once; a key both changed and deleted is refused.
    """
    if changes is not None:
        if changes.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError("a row is changed twice")
        if deletes is not None and changes.join(deletes, key, "left_semi").limit(1).count():
            raise ValueError("a row is both changed and deleted")
        new = changes.select(F.col(key), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c != key])
        df = df.join(new, key, "left").select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if f"_new_{c}" in new.columns else F.col(c) for c in df.columns])
    if deletes is not None:
        df = df.join(deletes.select(key), key, "left_anti")
    if additions is not None:
        if sorted(additions.columns) != sorted(df.columns):
            raise ValueError("added rows need exactly the columns of the table")
        df = df.unionByName(additions)
    return df


def list_library(library: DataFrame, query: str = "", tags: list[str] | None = None, task: str | None = None, source: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """Rows that meet all filters, newest first."""
    cond = [F.lower(F.concat_ws(" ", "name", F.concat_ws(" ", "tags"))).contains(query.casefold())] if query else []
    cond += [F.array_contains("tags", t) for t in tags or []]
    cond += [F.array_contains("tasks", task)] if task else []
    cond += [F.col("source") == source] if source else []
    df = library.where(reduce(lambda a, b: a & b, cond)) if cond else library
    return df.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def export_predictions(scored: DataFrame, path: str, reveal_test: bool = False) -> None:
    """Predictions by split; the test part stays hidden until it is revealed."""
    (scored if reveal_test else scored.where(F.col("split") != "test")).write.option("header", True).csv(path)


def sample_limit(df: DataFrame, key: str, count: int, seed: int = 0) -> DataFrame:
    """A reproducible uniform sample; a top-k by hash, so no row order is needed."""
    h = shuffle_key(seed, key)
    return df.orderBy(h, F.col(key)).limit(count)


def resolve(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """The chosen columns, after the checks a fit needs."""
    kinds = {f.name: f for f in df.schema}
    if target in features or not is_numeric(kinds[target]):
        raise ValueError("the target must be numeric and no feature")
    texts = [c for c in features if not is_numeric(kinds[c])]
    row = df.agg(F.count_if(finite(F.col(target)).isNull()).alias("bad"), *[F.count(c).alias(f"n|{c}") for c in features], *[F.countDistinct(c).alias(f"d|{c}") for c in texts]).first()
    if row["bad"] or any(row[f"n|{c}"] == 0 for c in features) or any(row[f"d|{c}"] > 512 for c in texts):
        raise ValueError("the target has unknown values, or a feature has none or too many")
    return df.select(*features, target)
