"""Repeated byte strings across whole documents (operator 8).

Finds every byte that lies in a string of ``length`` bytes which also starts somewhere else. The column-wise
construction of a collection's Burrows-Wheeler transform takes one distributed round per symbol of the longest
document, so it is not used here (see the README); the same exact result comes from sampled anchors:

* every window of ``length`` bytes has one anchor, the smallest hash among its ``GRAM``-byte strings, so equal windows
  have equal anchors at equal places;
* the windows of one anchor are a run; a run whose whole content occurs twice is repeated as a whole;
* only the rest, runs that share an anchor but differ somewhere, is compared window by window, or, where one anchor has many
  such runs, by pieces that are split until they are settled.

Whole texts that are equal take part once. Equality is that of 64-bit hashes of strings found at equal anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, materialize, numbered, ship, table, text_of, unique_ids

GRAM = 100
#: Differing runs of one anchor that one task compares by itself; beyond, Spark compares pieces of them.
GROUP = 512
_MASK, _BASE = (1 << 64) - 1, 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple] = {}


def _tables(n: int):
    """Random numbers for bytes, powers of the base and of its inverse; grown by doubling."""
    import numpy as np

    size = max(1 << 16, 1 << (n + 1).bit_length())
    if not _POWERS or next(iter(_POWERS)) < n + 1:
        _POWERS.clear()
        ones = np.full(size, _BASE, np.uint64)
        back = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        ones[0] = back[0] = 1
        random = np.random.default_rng(12345).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        _POWERS[size] = (random, np.cumprod(ones, dtype=np.uint64), np.cumprod(back, dtype=np.uint64))
    return next(iter(_POWERS.values()))


def _mix(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Sums:
    """Hashes of any substring of data from running sums."""

    def __init__(self, data: bytes):
        import numpy as np

        self.random, self.up, self.down = _tables(len(data))
        x = self.random[np.frombuffer(data, np.uint8)] * self.up[: len(data)]
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])

    def of(self, start, end):
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def _sliding_min(x, w: int):
    import numpy as np

    n = len(x)
    full = -(-n // w) * w
    a = np.full(full, np.uint64(_MASK))
    a[:n] = x
    a = a.reshape(-1, w)
    left = np.minimum.accumulate(a, axis=1).ravel()
    right = np.minimum.accumulate(a[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def runs(data: bytes, length: int):
    """(anchor hash, run hash, place of the anchor, first and last window) arrays; together they hold every window once.

    A text is taken in overlapping pieces of a million bytes; the windows of a piece are its own.
    """
    import numpy as np

    gram, bits = min(GRAM, length), 20
    out = []
    step = (1 << bits) - length
    for base in range(0, max(1, len(data) - length + 1), step):
        piece = data[base : base + step + length - 1]
        if len(piece) < length:
            break
        s = Sums(piece)
        at = np.arange(len(piece) - gram + 1)
        h = s.of(at, at + gram)
        low = np.uint64((1 << bits) - 1)
        place = (_sliding_min((h & ~low) | at.astype(np.uint64), length - gram + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(place) - 1]])
        p = place[first]
        whole = s.of(first, last + length) ^ _mix((p - first).astype(np.uint64) * np.uint64(1000003) + (last - first).astype(np.uint64))
        out.append((h[p], whole, p + base, first + base, last + base))
    return tuple(np.concatenate([x[i] for x in out]) for i in range(5)) if out else tuple(np.empty(0, np.int64) for _ in range(5))


def _anchors(docs: DataFrame, length: int) -> DataFrame:
    def scan(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            ids, parts, size = [], [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                r = runs(text.encode(), length)
                ids.append(np.full(len(r[0]), doc, np.int64))
                parts.append(r)
                size += len(r[0])
                if size > 50_000:
                    yield _batch(pa, np, ids, parts)
                    ids, parts, size = [], [], 0
            if size:
                yield _batch(pa, np, ids, parts)

    return docs.mapInArrow(scan, "doc_id long, anchor long, run long, place int, first int, last int")


def _batch(pa, np, ids, parts):
    cols = [np.concatenate([p[i] for p in parts]) for i in range(5)]
    arrays = [pa.array(np.concatenate(ids)), *(pa.array(c.astype(np.uint64).view(np.int64)) for c in cols[:2]), *(pa.array(c.astype(np.int32)) for c in cols[2:])]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "anchor", "run", "place", "first", "last"])


def _windows(docs: DataFrame, open_runs: DataFrame, length: int) -> DataFrame:
    """(doc_id, anchor, crowd, place, first, last, body): the bytes of runs that must be compared."""
    wanted = open_runs.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "crowd", "place", "first", "last")).alias("runs"))
    rows = wanted.join(docs, "doc_id").select("doc_id", "text", "runs")

    def cut(batches) -> Iterator:
        import pyarrow as pa

        names = ["doc_id", "anchor", "crowd", "place", "first", "last", "body"]
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            out = []
            for doc, text, items in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                data = text.encode()
                out += [(doc, r["anchor"], r["crowd"], r["place"], r["first"], r["last"], data[r["first"] : r["last"] + length]) for r in items]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return rows.mapInArrow(cut, "doc_id long, anchor long, crowd boolean, place int, first int, last int, body binary")


def _hashes(body: bytes, place: int, first: int, last: int, length: int):
    """Hash of each window with its offset from the anchor."""
    import numpy as np

    at = np.arange(last - first + 1)
    return Sums(body).of(at, at + length) ^ _mix((place - first - at).astype(np.uint64) + np.uint64(77))


def _compare_groups(cut: DataFrame, length: int, parts: int) -> DataFrame:
    """Repeated windows (doc_id, first, last) of small groups, one anchor after another."""

    def compare(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def close(rows):
            h = [_hashes(r[5], r[2], r[3], r[4], length) for r in rows]
            flat = np.concatenate(h)
            _, where, counts = np.unique(flat, return_inverse=True, return_counts=True)
            again, at, out = counts[where] > 1, 0, []
            for r, x in zip(rows, h, strict=True):
                mine = np.concatenate([[False], again[at : at + len(x)], [False]]).astype(np.int8)
                at += len(x)
                edge = np.diff(mine)
                out += [(r[0], int(a) + r[3], int(b) - 1 + r[3]) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
            return out

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int32(), pa.int32()], strict=True)], names=["doc_id", "first", "last"])

        key, rows, out = None, [], []
        for batch in batches:
            for doc, anchor, place, first, last, body in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "anchor", "place", "first", "last", "body")), strict=True):
                if anchor != key:
                    out += close(rows) if len(rows) > 1 else []
                    key, rows = anchor, []
                rows.append((doc, anchor, place, first, last, body))
            if out:
                yield batch_of(out)
                out = []
        out = close(rows) if len(rows) > 1 else []
        if out:
            yield batch_of(out)

    small = cut.where(~F.col("crowd")).select("doc_id", "anchor", "place", "first", "last", "body")
    return small.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(compare, "doc_id long, first int, last int")


def _split(rows: DataFrame, length: int, width: int) -> DataFrame:
    """Pieces of runs: the windows whose distance before the anchor lies in one block of ``width`` distances.

    ``core`` is the hash of the bytes that every window of such a block has, ``whole`` that of all bytes of the piece's windows.
    """

    def split(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["doc_id", "open", "place", "first", "last", "core", "whole", "body"]
        types = [pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            out = [[] for _ in names]
            for doc, new, place, first, last, body in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "open", "place", "first", "last", "body")), strict=True):
                block = np.arange((place - last) // width, (place - first) // width + 1)
                low, high = np.maximum(block * width, place - last), np.minimum(block * width + width - 1, place - first)
                starts, ends, s = place - high, place - low, Sums(body)
                at = place - first - block * width
                core = s.of(at, at - width + 1 + length) ^ _mix(block.astype(np.uint64) + np.uint64(77))
                whole = s.of(starts - first, ends - first + length) ^ _mix(low.astype(np.uint64) * np.uint64(1000003) + high.astype(np.uint64))
                bodies = [body[x - first : y - first + length] for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(block)
                for column, values in zip(out, ([doc] * n, [new] * n, [place] * n, starts.tolist(), ends.tolist(), core.view(np.int64).tolist(), whole.view(np.int64).tolist(), bodies), strict=True):
                    column += values
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)

    return rows.select("doc_id", "open", "place", "first", "last", "body").mapInArrow(split, "doc_id long, open boolean, place int, first int, last int, core long, whole long, body binary")


def _compare_crowds(cut: DataFrame, length: int) -> DataFrame:
    """The same for anchors with many differing runs, by ever shorter pieces; rows grow with the runs, not with their windows.

    Equal windows have equal cores. A piece whose whole content occurs twice is repeated; one of each content goes on as a partner
    of others. A piece whose core no other content has is not repeated. Only what is left is split again, down to single windows.
    """
    store, found, done = Scratch(cut.sparkSession), None, []
    rows, width = cut.where("crowd").withColumn("open", F.lit(True)), 1 << max(0, (length - min(GRAM, length) + 1).bit_length() - 2)
    while True:
        pieces = store.keep(_split(rows, length, width), "pieces")
        store.drop(*done)
        kinds = store.keep(pieces.groupBy("core", "whole").agg(F.count("*").alias("same"), F.min(F.struct("doc_id", "first")).alias("x")), "kinds")
        again = pieces.where("open").join(kinds.where("same > 1").select("core", "whole"), ["core", "whole"]).select("doc_id", "first", "last")
        again, done = materialize(again, "again"), [pieces, kinds]
        found = again if found is None else found.unionByName(again)
        several = kinds.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
        ahead = kinds.join(several, "core").select("x.doc_id", "x.first", (F.col("same") == 1).alias("single"))
        rows = pieces.join(ahead, ["doc_id", "first"]).withColumn("open", F.col("open") & F.col("single"))
        if width == 1 or not rows.limit(1).count():
            store.drop(*done)
            return found
        width = max(1, width // 4)


def repeated_bytes(docs: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept), a row for every row of docs: kept is what is left of the text's UTF-8 bytes.

    Strings are judged on the input and never cross documents. Null text is empty. Rows that repeat an id, or have none, are
    documents of their own (equal long texts repeat each other as a whole). Other columns are not read; empty docs give no rows.
    """
    if not unique_ids(docs, doc_id):
        rows = numbered(docs, doc_id, text)
        found = _repeated(rows.select(F.col("key").alias("doc_id"), text_of(text).alias("text")), length)
        return found.withColumnRenamed("doc_id", "key").join(rows.select("key", F.col(doc_id).alias("doc_id")), "key").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    return _repeated(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")), length)


def _repeated(docs: DataFrame, length: int) -> DataFrame:
    ship(docs.sparkSession)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long_docs = docs.where(F.octet_length("text") >= length)
    copies = materialize(long_docs.groupBy(F.md5("text").alias("m"), F.octet_length("text").alias("n")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("same")), "copies")
    firsts = copies.select("doc_id", (F.col("same") > 1).alias("copied"))
    anchors = materialize(_anchors(long_docs, length).join(firsts, "doc_id"), "anchors")
    by_run = materialize(anchors.groupBy("anchor", "run").agg(F.count("*").alias("same"), F.min(F.struct("doc_id", "place", "first", "last", "copied")).alias("x")), "runs")
    shared = materialize(by_run.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "shared")
    whole = anchors.where("not copied").join(by_run.where("same > 1").select("anchor", "run"), ["anchor", "run"]).select("doc_id", "first", "last")
    # One run of each content is enough: a content that occurs twice is settled, but still a partner of others.
    open_runs = by_run.join(shared, "anchor").select("x.doc_id", "anchor", (F.col("kinds") > GROUP).alias("crowd"), "x.place", "x.first", "x.last")
    cut = materialize(_windows(docs, open_runs, length), "bodies")
    found = whole.unionByName(_compare_groups(cut, length, parts)).unionByName(_compare_crowds(cut, length))
    spans = found.groupBy("doc_id").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    once = firsts.where("not copied").select("doc_id")
    marked = docs.join(once.join(spans, "doc_id", "left").withColumn("once", F.lit(True)), "doc_id", "left")

    def remove(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out = {"doc_id": batch.column("doc_id").to_pylist(), "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
            for text, once, spans in zip(batch.column("text").to_pylist(), batch.column("once").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data = text.encode()
                # A long text that is not the only one of its content is repeated as a whole.
                cover = [(0, len(data))] if len(data) >= length and not once else sorted((s["first"], s["last"] + length) for s in spans or [])
                kept, at, removed, n = [], 0, 0, 0
                for a, b in cover:
                    if a > at or not n:
                        n += 1
                        kept.append(data[at:a])
                        removed += b - a
                        at = b
                    elif b > at:
                        removed += b - at
                        at = b
                kept.append(data[at:])
                for k, x in (("n_bytes", len(data)), ("n_removed", removed), ("n_spans", n), ("kept", b"".join(kept))):
                    out[k].append(x)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]))

    return marked.select("doc_id", "text", "once", "spans").mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
