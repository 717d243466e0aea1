"""Harmonic packing (operator 4).

A document is cut into full sequences and a rest. Rests go by reciprocal-capacity classes: class j takes
pieces of at most capacity/j tokens and puts exactly j of them in a bin, whatever they are, so each worker
fills bins without seeing the others. Where a rest would leave too much of its slot empty, it is cut at
the size of a smaller slot and what remains is classified again. Only pieces of bins that a worker could not
fill are dealt out: by ranks over all workers, so that at most one bin per class is not full; those few are joined at the end.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, ship, table, text_of
from .tokens import encoder, vocabulary

#: Pieces per bin, by class (fixed values; their slots are capacity // j).
CLASSES = [1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 128, 256, 512, 1024]


def cut(n: int, capacity: int, slack: float = 0.05) -> list[tuple[int, int]]:
    """(length, class) of a document's pieces, in order."""
    pieces = [(capacity, 1)] * (n // capacity)
    rest = n % capacity
    classes = [j for j in CLASSES if j <= capacity]
    while rest:
        j = max(j for j in classes if rest <= capacity // j)
        slot = capacity // j
        if slot - rest <= slack * capacity / j or rest <= 4 or j == classes[-1]:
            pieces.append((rest, j))
            break
        smaller = next(k for k in classes if k > j)
        size = capacity // smaller
        pieces.append((size, smaller))
        rest -= size
    return pieces


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int | None, capacity: int = 1024, slack: float = 0.05, with_ids: bool = True, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row, start, length, ids_crc32, doc_tokens, class, sequence_id, offset, used[, ids]) for each piece; null text is empty.

    Each task fills its own bins, class by class, and numbers them by its partition. Pieces of bins that a task could not
    fill (fewer than the sum of CLASSES) have a null sequence_id, offset and used: assign() places those of all tasks.
    """
    ship(docs.sparkSession)
    tail = b"" if end_id is None else struct.pack("<I", end_id)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_of(text).alias("text"))
    schema = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long, class int, sequence_id long, offset long, used long" + (", ids binary" if with_ids else "")

    def pieces(batches):
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        enc = encoder(tokenizer_path)
        names = [x.split()[0] for x in schema.split(", ")]
        types = [pa.int64()] * 6 + [pa.int32()] + [pa.int64()] * 3 + [pa.binary()]
        sequence = TaskContext.get().partitionId() << 33
        waiting: dict[int, list[tuple]] = {}
        ids_of = (lambda x: (x,)) if with_ids else (lambda x: ())

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=False)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for key, row, ids in zip(part.column("doc_id").to_pylist(), part.column("row").to_pylist(), enc.encode(part.column("text").to_pylist()), strict=True):
                    data, start = ids + tail, 0
                    total = len(data) // 4
                    for length, j in cut(total, capacity, slack):
                        x = data[4 * start : 4 * (start + length)]
                        bin_ = waiting.setdefault(j, [])
                        bin_.append((key, row, start, length, zlib.crc32(x), total, j, ids_of(x)))
                        start += length
                        if len(bin_) == j:
                            used, offset = sum(p[3] for p in bin_), 0
                            for p in bin_:
                                out.append((*p[:7], sequence, offset, used, *p[7]))
                                offset += p[3]
                            sequence += 1
                            bin_.clear()
                if out:
                    yield batch_of(out)
        for bin_ in waiting.values():
            if bin_:
                yield batch_of([(*p[:7], None, None, None, *p[7]) for p in bin_])

    return rows.mapInArrow(pieces, schema)


def assign(pieces: DataFrame, capacity: int = 1024, parts: int = 64) -> DataFrame:
    """Pieces without a bin, with sequence_id (below 0), offset and used.

    parts: shares of a class; ranks inside a share plus the counts before it number the bins.
    """
    share = F.pmod(F.xxhash64("doc_id", "row", "start"), F.lit(parts)).cast("int")
    df = pieces.drop("sequence_id", "offset", "used").withColumn("share", share)
    rest = df.withColumn("rank", F.row_number().over(Window.partitionBy("class", "share").orderBy("doc_id", "row", "start")) - 1)
    counts = df.groupBy("class", "share").count()
    # At most len(CLASSES) x parts rows.
    before = counts.select("class", "share", (F.sum("count").over(Window.partitionBy("class").orderBy("share")) - F.col("count")).alias("before"), F.sum("count").over(Window.partitionBy("class")).alias("all"))
    ranked = rest.join(F.broadcast(before), ["class", "share"]).withColumn("rank", F.col("rank") + F.col("before"))
    bin_no = F.floor(F.col("rank") / F.col("class"))
    # The last bin of a class may lack pieces; all such pieces (fewer than the sum of CLASSES) are packed once more, by size.
    open_bin = (bin_no + 1) * F.col("class") > F.col("all")
    placed = ranked.withColumns({"open": open_bin, "bin": F.struct(F.col("class").cast("long").alias("c"), bin_no.alias("b"))})
    closed = placed.where(~F.col("open")).drop("rank", "before", "all", "open")
    few = placed.where("open").drop("rank", "before", "all", "open", "bin")
    order = Window.orderBy(F.desc("length"), "doc_id", "row", "start")
    # Next fit by falling size over this bounded rest.
    few = few.withColumn("item", F.row_number().over(order))
    listed = F.sort_array(F.collect_list(F.struct("item", "length")))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("bin"), F.expr("cast(array() as array<struct<item:int,bin:long>>)").alias("out"))

    def step(a: Column, x: Column) -> Column:
        fits = a["used"] + x["length"] <= capacity
        bin_ = F.when(fits, a["bin"]).otherwise(a["bin"] + 1)
        return F.struct(F.when(fits, a["used"] + x["length"]).otherwise(x["length"]).alias("used"), bin_.alias("bin"), F.concat(a["out"], F.array(F.struct(x["item"].alias("item"), bin_.alias("bin")))).alias("out"))

    bins = few.agg(listed.alias("l")).select(F.explode(F.aggregate("l", zero, step, lambda a: a["out"])).alias("x")).select("x.item", F.struct(F.lit(0).cast("long").alias("c"), F.col("x.bin").alias("b")).alias("bin"))
    few = few.join(F.broadcast(bins), "item").drop("item")
    both = closed.unionByName(few)
    inside = Window.partitionBy("bin")
    ordered = inside.orderBy("doc_id", "row", "start")
    # Numbers below 0: a task numbers its own bins from 0 on, and a class is at most 1024.
    number = F.lit(-1) - F.col("bin.b") * 2048 - F.col("bin.c")
    return both.withColumns({"offset": F.sum("length").over(ordered) - F.col("length"), "used": F.sum("length").over(inside), "sequence_id": number}).drop("bin", "share")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int | None, capacity: int = 1024, slack: float = 0.05, with_ids: bool = True) -> DataFrame:
    """One row per piece with its place. Each id of each row of docs lies in exactly one piece.

    Null or empty text still has its end id; rows that repeat a doc_id or have none are packed each by itself. Other columns are
    not read, and empty docs give no pieces.
    """
    pieces = materialize(token_pieces(docs, tokenizer_path, end_id, capacity, slack, with_ids), "pieces")
    parts = max(64, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = pieces.where("sequence_id is not null").unionByName(assign(pieces.where("sequence_id is null"), capacity, parts))
    power = F.col("used").bitwiseAND(F.col("used") - 1) == 0
    return placed.withColumn("padded_length", F.when(power, F.col("used")).otherwise(F.lit(capacity).cast("long"))).drop("used")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"), 0, with_ids=False)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded_length")
