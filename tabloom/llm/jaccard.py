"""N-gram Jaccard join in metric space (operator 10).

Documents are points, their distance is 1 - |A & B| / |A | B| over sets of word shingles, and a link is a distance of at
most r = 1 - percent / 100. The join recurses over regions:

* Regions. A region is cut by pivots, which are documents of it. Two unrelated texts are at distance 1, so the pivots near
  a document cannot be found by distances alone; they are found through shingles. In any total order of the shingles, a
  link of a set of n has one of its first ``n - ceil(t n) + 1`` shingles (its keys) in common with its partner. All
  documents of the region with a common key form a list, the first of a list is its pivot, and a document belongs to
  the cells of the pivots of all its lists: both ends of every link meet in a cell.
* Small cells are joined by one task: keys, in the one order of the region, bound distances from below, which leaves few
  members, and only the texts of these are sent there, each once, and compared exactly.
* Large cells become regions of the next turn. Every member is compared with the pivot and a few more. Rings of width 2r around
  the pivot divide the cell, and by the triangle inequality it suffices to replicate the documents in the outer half of a
  ring to the next ring. Documents linked to the pivot are in one component already; they stay only if another document lies
  within their window. Inside a ring the keys are drawn anew, with the shingles that no pivot has first: what
  the cell had in common, such as a passage of many documents, no longer brings documents together, unless one of them
  lies in the pivots almost wholly.
* What is large and dense even so, near copies of one text just out of reach of each other, is joined block against block.

Pivots leave their cell with the turn, so recursion ends. Every link between different sets is found or lies inside a
component that other links have formed. Equal sets are joined first and take part once. Shingles are compared as 64-bit
hashes, sets as sizes and two 64-bit sums.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, materialize, reachable, remove, ship, table, text_of
from .shingles import mix, shingle_sets

#: Members of a cell that one task joins in the first turn (four times as many in each later one, up to LARGEST), and members x shingles of all of them.
SMALL, LARGEST, WORK = 256, 1024, 200_000_000
#: Shingles that come first in more sets than that are marked as frequent.
OFTEN = 64
#: After the first turn, cells of up to BLOCKED members with at most WIDE shingles each on average are joined block by block.
BLOCK, BLOCKED, WIDE = 512, 16_384, 4000
#: Pivots of a large cell, besides the first of its lists.
PIVOTS = 8
#: Rows of a few numbers that may be broadcast (about 80 bytes each).
FEW = 1_000_000
#: Members of a large cell that are compared with its pivot in one go.
RUN = 512


def window(n: int, percent: int) -> int:
    """How many keys a set of n has."""
    return n - (percent * n + 99) // 100 + 1 if n else 0


def most_different(a, b, percent: int):
    """The largest symmetric difference of two linked sets of these sizes."""
    both = -(-percent * (a + b) // (100 + percent))
    return a + b - 2 * both


class Order:
    """The total order of the shingles: those marked as frequent come last. The marks change which keys a set has, never a result."""

    def __init__(self, marks: bytes | None):
        import numpy as np

        self.late = np.unpackbits(np.frombuffer(marks, np.uint8), bitorder="little") if marks else None

    def keys(self, h, percent: int, apart=None) -> tuple[bytes, int]:
        """The keys of a sorted set, packed as ordered numbers, and how many are not in apart; these come before all others."""
        import numpy as np

        k = h >> np.uint64(1)
        if self.late is not None:
            k |= self.late[(h & np.uint64(len(self.late) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(63)
        w = window(len(h), percent)
        if apart is None:
            return (np.sort(np.partition(k, w - 1)[:w]) if 0 < w < len(k) else np.sort(k)[:w]).tobytes(), w
        at = np.searchsorted(apart, h)
        at[at == len(apart)] = 0
        own = apart[at] != h if len(apart) else np.ones(len(h), bool)
        first = np.sort(k[own])[:w]
        return np.concatenate([first, np.sort(k[~own])[: w - len(first)]]).tobytes(), len(first)


def _frequent(docs: DataFrame, size: int, percent: int) -> bytes | None:
    """Marks of shingles that come first in many sets, as a bitmap of at most 2 MB by their last bits.

    Counted are repetitions inside blocks of documents, over all documents: a shingle that is frequent in the corpus is repeated
    in its blocks. The first 2w shingles of a set are looked at, since that is where its keys come from.
    """

    def scan(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held, size_ = [], 0

        def out():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            often = n > 1
            return pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(n[often])], names=["key", "n"])

        for batch in batches:
            for h in shingle_sets(batch.column("text"), size):
                held.append(h[: 2 * window(len(h), percent)])
                size_ += len(held[-1])
                if size_ > 4_000_000:
                    yield out()
                    held, size_ = [], 0
        if held:
            yield out()

    often = docs.select("text").mapInArrow(scan, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > OFTEN)
    often = materialize(often.select("key"), "often")
    n = often.count()
    bits = 1 << max(16, min(24, (16 * n).bit_length()))
    place = F.col("key").bitwiseAND(bits - 1)
    # At most 2^18 rows.
    words = often.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((key & {bits - 1}) & 63 as int))")).alias("x")).collect() if n else []
    remove(docs.sparkSession, often.inputFiles()[0].rpartition("/")[0]) if n else None
    if not words:
        return None
    import numpy as np

    marks = np.zeros(bits // 64, np.int64)
    marks[[r["word"] for r in words]] = [r["x"] for r in words]
    return marks.tobytes()


def _sets(docs: DataFrame, size: int, percent: int, marks) -> DataFrame:
    """(doc_id, text_hash, n, s1, s2, keys) of every row; s1 and s2 are sums that identify the set."""

    def scan(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        order = Order(marks.value)
        names = ["doc_id", "text_hash", "n", "s1", "s2", "keys"]
        for batch in batches:
            ns, s1, s2, keys = [], [], [], []
            for h in shingle_sets(batch.column("text"), size):
                ns.append(len(h))
                mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0xA0761D6478BD642F)
                s1.append(int(h.sum().astype(np.int64)))
                s2.append(int((mixed ^ (mixed >> np.uint64(30))).sum().astype(np.int64)))
                keys.append(order.keys(h, percent)[0])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(ns, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(keys, pa.binary())], names=names)

    return docs.mapInArrow(scan, "doc_id long, text_hash long, n long, s1 long, s2 long, keys binary")


def _exploded(points: DataFrame) -> DataFrame:
    """(region, list, row, label, inner) for every key of points; a list is a key in a region, and whether the last pivot has it.

    inner: two documents that share nothing but shingles of the last pivot can only be linked if one of them has so many of
    these that it is inner; for keys that the pivot lacks it is always true.
    """

    def spread(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            raw = batch.column("keys").to_pylist()
            counts = np.array([len(k) // 8 for k in raw], np.int64)
            region, row, label = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), counts) for c in ("region", "row", "label"))
            own = np.repeat(batch.column("own").to_numpy(zero_copy_only=False), counts)
            theirs = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) >= own
            inner = ~theirs | np.repeat(batch.column("inner").to_numpy(zero_copy_only=False), counts)
            lists = mix(np.frombuffer(b"".join(raw), np.uint64) ^ mix(region.view(np.uint64) ^ theirs.astype(np.uint64))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(region), pa.array(lists), pa.array(row), pa.array(label), pa.array(inner)], names=["region", "list", "row", "label", "inner"])

    return points.select("region", "row", "label", "keys", "own", "inner").mapInArrow(spread, "region long, list long, row long, label long, inner boolean")


def _cells(points: DataFrame, store: Scratch) -> DataFrame:
    """(region, pivot, row): the members of the cells, pivots included. Lists within one component have nothing to find."""
    keys = _exploded(points)
    lists = store.keep(keys.groupBy("list").agg(F.min("row").alias("pivot"), F.min("label").alias("l0"), F.max("label").alias("l1"), F.max("inner").alias("_inner")).where("l0 <> l1 and _inner").select("list", "pivot"), "lists")
    out = store.keep(keys.select("region", "list", "row").join(lists, "list").select("region", "pivot", "row").distinct(), "cells")
    store.drop(lists)
    return out


def _intersections(lists: list):
    """Sizes of the intersections of all pairs of a bounded number of sorted sets."""
    import numpy as np

    m = len(lists)
    flat, owner = np.concatenate(lists), np.repeat(np.arange(m), [len(x) for x in lists])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    column = np.cumsum(np.concatenate([[0], flat[1:] != flat[:-1]]))[: len(flat)]
    often = np.bincount(column)[column] > 1 if len(column) else np.empty(0, bool)
    column, owner = np.unique(column[often], return_inverse=True)[1], owner[often]
    shared = np.zeros((m, m), np.int32)
    cuts = np.searchsorted(column, np.arange(0, (int(column[-1]) if len(column) else -1) + 2048, 2048))
    grid = np.zeros((m, 2048), np.float32)
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        grid[:] = 0
        grid[owner[a:b], column[a:b] - 2048 * k] = 1
        np.add(shared, grid @ grid.T, out=shared, casting="unsafe")
    return shared


def _near(cells: DataFrame, points: DataFrame, percent: int, parts: int) -> DataFrame:
    """(region, pivot, row) of the members of small cells that may have a link there, by the upper halves of their keys alone.

    The order of a region has shingles outside its pivots first. Halves that agree by chance make a member stay that need not;
    they never make one go.
    """

    def halve(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            short = []
            for raw, own in zip(batch.column("keys").to_pylist(), batch.column("own").to_pylist(), strict=True):
                k = np.frombuffer(raw, np.uint64) >> np.uint64(1)
                k[own:] |= np.uint64(1 << 63)
                short.append((k >> np.uint64(32)).astype(np.uint32).tobytes())
            columns = [pa.array(short, pa.binary()) if c == "keys" else batch.column(c) for c in ("region", "row", "n", "keys", "label")]
            yield pa.RecordBatch.from_arrays(columns, names=["region", "row", "n", "keys", "label"])

    def close(rows):
        import numpy as np

        n = np.array([r[1] for r in rows], np.int32)
        lists = [np.unique(np.frombuffer(r[2], np.uint32)) for r in rows]
        shared = _intersections(lists)
        # Two lists of keys in the one order of their region are complete below the smaller of their last keys, also as upper halves.
        last = np.array([x[-1] if len(x) < k else 1 << 32 for x, k in zip(lists, n, strict=True)], np.uint64)
        known = np.stack([np.searchsorted(x, last).astype(np.int32) for x in lists])
        differ = known + known.T - 2 * shared
        fit = (shared > 0) & (differ <= most_different(n[:, None], n[None, :], percent)) & (100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :]))
        label = np.array([r[3] for r in rows])
        fit &= label[:, None] != label[None, :]
        return [rows[i][0] for i in np.flatnonzero(fit.any(axis=1))]

    def compare(batches) -> Iterator:
        import pyarrow as pa

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["region", "pivot", "row"])

        at, rows, found = None, [], []
        for batch in batches:
            for region, pivot, row, n, keys, label in zip(*(batch.column(c).to_pylist() for c in ("region", "pivot", "row", "n", "keys", "label")), strict=True):
                if (region, pivot) != at:
                    if len(rows) > 1:
                        found += [(*at, r) for r in close(rows)]
                    at, rows = (region, pivot), []
                rows.append((row, n, keys, label))
            if found:
                yield out(found)
                found = []
        if len(rows) > 1:
            found += [(*at, r) for r in close(rows)]
        if found:
            yield out(found)

    short = points.select("region", "row", "n", "keys", "label", "own").mapInArrow(halve, "region long, row long, n long, keys binary, label long")
    rows = cells.join(short, ["region", "row"]).select("region", "pivot", "row", "n", "keys", "label")
    return rows.repartition(parts, "region", "pivot").sortWithinPartitions("region", "pivot", "row").mapInArrow(compare, "region long, pivot long, row long")


def _texts(wanted: DataFrame, reps: DataFrame, docs: DataFrame, store: Scratch) -> DataFrame:
    """wanted (with row) and the text of each row; up to FEW rows are broadcast, so that texts are not shuffled for them."""
    found = wanted.join(reps.select("row", F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")), "row")
    found = store.keep(found, "wanted")
    found = F.broadcast(found) if found.count() <= FEW else found
    return found.join(docs, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash"))).drop("_id", "_hash", "doc_id", "text_hash")


def _linked(both: int, a: int, b: int, percent: int) -> bool:
    return both > 0 and 100 * both >= percent * (a + b - both)


def _both(a, b) -> int:
    """Size of the intersection of two sorted sets."""
    import numpy as np

    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _join_small(rows: DataFrame, size: int, percent: int, parts: int, by: list[str]) -> DataFrame:
    """(a, b) links inside small groups of rows, as many as tie their members together."""

    def close(rows):
        import numpy as np

        if len(rows) == 2:
            (x, its, g), (row, label, h) = rows
            return [(x, row)] if its != label and _linked(_both(g, h), len(g), len(h), percent) else []
        n, label = np.array([len(r[2]) for r in rows], np.int32), np.array([r[1] for r in rows])
        both = _intersections([r[2] for r in rows])
        tied = (both > 0) & (100 * both >= percent * (n[:, None] + n[None, :] - both))
        tied |= label[:, None] == label[None, :]
        out, seen = [], np.zeros(len(rows), bool)
        for start in range(len(rows)):
            stack = [] if seen[start] else [start]
            seen[start] = True
            while stack:
                u = stack.pop()
                new = np.flatnonzero(tied[u] & ~seen)
                seen[new] = True
                stack += new.tolist()
                out += [(rows[u][0], rows[v][0]) for v in new.tolist() if label[u] != label[v]]
        return out

    def compare(batches) -> Iterator:
        import pyarrow as pa

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(2)], names=["a", "b"])

        at, held, found = None, [], []
        for batch in batches:
            for *key, row, label, h in zip(*(batch.column(c).to_pylist() for c in (*by, "row", "label")), shingle_sets(batch.column("text"), size), strict=True):
                if key != at:
                    found += close(held) if len(held) > 1 else []
                    at, held = key, []
                held.append((row, label, h))
            if found:
                yield out(found)
                found = []
        found = close(held) if len(held) > 1 else []
        if found:
            yield out(found)

    return rows.select(*by, "row", "label", "text").repartition(parts, *by).sortWithinPartitions(*by, "row").mapInArrow(compare, "a long, b long")


def _blocks(cells: DataFrame) -> DataFrame:
    """Members of cells (with m) dealt to blocks of about BLOCK, with a row for each pair of blocks they take part in."""
    count = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = cells.withColumn("count", count).withColumn("side", F.pmod(F.xxhash64("row"), F.col("count")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    return dealt.withColumn("lo", F.least("side", "other")).withColumn("hi", F.greatest("side", "other")).drop("count", "side", "other", "m")


def _around_pivots(rows: DataFrame, size: int, percent: int, parts: int, marks) -> DataFrame:
    """(region, pivot, row, n, distance, links, keys, own, inner) of the members of large cells that are no pivots themselves, and
    of pivots with distance null; rows of a run with member = 0 are its pivots and come first, that of the cell before the others."""

    def compare(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        names = ["region", "pivot", "row", "n", "distance", "links", "keys", "own", "inner"]
        types = [pa.int64()] * 4 + [pa.float64(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.bool_()]
        at, pivots, union, order = None, {}, None, Order(marks.value)
        for batch in batches:
            out = []
            for region, pivot, run, member, row, h in zip(*(batch.column(c).to_pylist() for c in ("region", "pivot", "run", "member", "row")), shingle_sets(batch.column("text"), size), strict=True):
                if (region, pivot, run) != at:
                    at, pivots, union = (region, pivot, run), {}, None
                if not member:
                    pivots[row] = h
                    continue
                if union is None:
                    union = np.unique(np.concatenate(list(pivots.values())))
                shared = {p: _both(h, g) for p, g in pivots.items() if p != row}
                links = [p for p, both in shared.items() if _linked(both, len(h), len(pivots[p]), percent)]
                distance = None if row in pivots else 1 - shared[pivot] / (len(h) + len(pivots[pivot]) - shared[pivot])
                # If x and y share only shingles of the pivots, min(both_x, both_y) >= t (n_x + n_y) / (1 + t): one of them is inner.
                inner = _both(h, union) * (100 + percent) >= 2 * percent * len(h)
                out.append((region, pivot, row, len(h), distance, links, *order.keys(h, percent, union), inner))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    by = ["region", "pivot", "run", "member", "row"]
    ordered = rows.select(*by, "text").repartition(parts, "region", "pivot", "run").sortWithinPartitions(*by)
    return ordered.mapInArrow(compare, "region long, pivot long, row long, n long, distance double, links array<long>, keys binary, own long, inner boolean")


def _next_points(tested: DataFrame, comp: DataFrame | None, percent: int) -> DataFrame:
    """Points of the next turn: (region, row, label, n, keys, own, inner); the rings of a large cell, with the windows between them.

    label: the component so far. Documents of the pivot's own component stay only where one of another is within their window.
    """
    r = 1 - percent / 100
    tested = tested.where("distance is not null")
    if comp is not None:
        tested = tested.join(comp.select(F.col("v").alias("row"), F.col("c").alias("label")), "row", "left").join(comp.select(F.col("v").alias("pivot"), F.col("c").alias("its")), "pivot", "left")
        tested = tested.withColumn("label", F.coalesce("label", "row")).withColumn("its", F.coalesce("its", "pivot"))
    else:
        tested = tested.withColumn("label", F.col("row")).withColumn("its", F.col("pivot"))
    other = F.col("label") != F.col("its")
    nearest = tested.groupBy("region", "pivot").agg(F.min(F.when(other, F.col("distance"))).alias("nearest")).where("nearest is not null")
    open_ = tested.join(nearest, ["region", "pivot"]).where(other | (F.col("distance") >= F.col("nearest") - r - 1e-9))
    ring = F.floor(F.col("distance") / (2 * r)).cast("int")
    outer = F.col("distance") - 2 * r * ring >= r - 1e-9
    rings = F.when(outer, F.array(ring, ring + 1)).otherwise(F.array(ring))
    placed = open_.select("region", "pivot", "row", "label", "n", "keys", "own", "inner", F.explode(rings).alias("ring"))
    # Region 0 is that of the first turn, whose keys are in one order for all.
    name = F.xxhash64("region", "pivot", "ring")
    return placed.select(F.when(name == 0, F.lit(1).cast("long")).otherwise(name).alias("region"), "row", "label", "n", "keys", "own", "inner")


def _merged(comp: DataFrame | None, links: DataFrame, store: Scratch) -> DataFrame | None:
    """comp (v, c) after more links (a, b): only links between components are followed, with these as vertices."""
    if comp is None:
        return reachable(links, store)
    to = lambda v, c: comp.select(F.col("v").alias(v), F.col("c").alias(c))
    between = links.join(to("a", "ca"), "a", "left").join(to("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    more = reachable(between, store)
    if more is None:
        return comp
    moved = comp.withColumnRenamed("c", "was").join(more.select(F.col("v").alias("was"), "c"), "was", "left").select("v", F.coalesce("c", "was").alias("c"))
    out = store.keep(moved.unionByName(more.join(comp.select("v"), "v", "left_anti").select("v", "c")), "components")
    store.drop(comp, more)
    return out


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for every row of docs.

    Two documents are linked when 100 x intersection >= percent x union of their shingle sets; components are the transitive
    closure and carry their smallest doc_id. Null, empty and blank texts have no shingles, are linked with nothing and keep
    their own id. Repeated rows and repeated ids give a row each, and a row without an id takes part like any other (its
    component_id is null if no member has an id). Empty docs give an empty result; other columns are not read.
    """
    return _components(docs, size, percent, doc_id, text).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _components(docs: DataFrame, size: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """(row, doc_id, text_hash, n, component_id, first) of every row; first: it is the one that stays of its component."""
    ship(docs.sparkSession)
    spark, store = docs.sparkSession, Scratch(docs.sparkSession)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    marks = spark.sparkContext.broadcast(_frequent(docs, size, percent))  # at most 2 MB
    keyed = store.keep(_sets(docs, size, percent, marks).withColumn("row", F.monotonically_increasing_id()), "sets")
    least = keyed.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("row").alias("row"))
    reps = store.keep(keyed.join(least.select("row"), "row", "left_semi"), "reps")
    sets = store.keep(keyed.drop("keys"), "sets")
    store.drop(keyed)
    if sets.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count():
        docs = store.keep(docs.dropDuplicates(["doc_id", "text_hash"]), "docs")
    points = reps.select(F.lit(0).cast("long").alias("region"), "row", F.col("row").alias("label"), "n", "keys", (F.length("keys") / 8).cast("long").alias("own"), F.lit(True).alias("inner"))
    comp, turn = None, 0
    while True:
        cells = _cells(points, store)
        few = min(LARGEST, SMALL << 2 * turn)
        known = points.select("region", "row", "label", "n")
        facts = cells.join(known, ["region", "row"]).groupBy("region", "pivot").agg(F.count("*").alias("m"), F.sum("n").alias("shingles"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1")
        size_class = F.when((F.col("m") <= few) & (F.col("m") * F.col("shingles") <= WORK), "small").when(F.lit(turn > 0) & (F.col("m") <= BLOCKED) & (F.col("shingles") <= WIDE * F.col("m")), "dense").otherwise("large")
        facts = store.keep(facts.withColumn("how", size_class).select("region", "pivot", "m", "how"), "facts")
        of = lambda how: cells.join(facts.where(F.col("how") == how).select("region", "pivot", "m"), ["region", "pivot"])  # noqa: B023, E731  used in this turn only
        near = store.keep(_near(of("small").drop("m"), points, percent, parts), "near")
        rows = _texts(near.join(known, ["region", "row"]), reps, docs, store)
        links = store.keep(_join_small(rows, size, percent, parts, ["region", "pivot"]), "links")
        if facts.where("how = 'dense'").limit(1).count():
            rows = _texts(_blocks(of("dense").join(known.drop("n"), ["region", "row"])), reps, docs, store)
            links = links.unionByName(store.keep(_join_small(rows, size, percent, parts, ["region", "pivot", "lo", "hi"]), "dense"))
        if not facts.where("how = 'large'").limit(1).count():
            comp = _merged(comp, links, store)
            break
        runs = F.ceil(F.col("m") / RUN).cast("int")
        members = of("large").withColumn("runs", runs)
        drawn = members.groupBy("region", "pivot", F.pmod(F.xxhash64(F.lit(9), "row"), F.lit(PIVOTS)).alias("draw")).agg(F.min("row").alias("row"), F.first("runs").alias("runs"))
        drawn = drawn.select("region", "pivot", "row", "runs").where("row <> pivot").unionByName(members.where("row = pivot").select("region", "pivot", "row", "runs"))
        pivots = drawn.select("region", "pivot", "row", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.lit(0).alias("member"))
        members = members.select("region", "pivot", "row", F.pmod(F.xxhash64("row"), F.col("runs")).cast("int").alias("run"), F.lit(1).alias("member"))
        tested = store.keep(_around_pivots(_texts(members.unionByName(pivots), reps, docs, store), size, percent, parts, marks), "tested")
        comp = _merged(comp, links.unionByName(tested.select(F.col("row").alias("a"), F.explode("links").alias("b"))), store)
        after = store.keep(_next_points(tested, comp, percent), "points")
        store.drop(cells, facts, near, links, tested, *([points] if turn else []))
        points, turn = after, turn + 1
    found = reps.select("row", "n", "s1", "s2")
    found = found.withColumn("component", F.col("row")) if comp is None else found.join(comp.withColumnRenamed("v", "row"), "row", "left").withColumn("component", F.coalesce("c", "row"))
    mine = store.keep(found.select("n", "s1", "s2", "component"), "mine")
    # The broad side keeps its rows without words: they are components of their own.
    joined = store.keep(sets.select("row", "doc_id", "text_hash", "n", "s1", "s2").join(mine, ["n", "s1", "s2"], "left").select("row", "doc_id", "text_hash", "n", F.coalesce("component", "row").alias("component")), "labels")
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row")
    least = joined.groupBy("component").agg(F.min(order).alias("x")).select("component", F.col("x.doc_id").alias("component_id"), F.col("x.row").alias("first"))
    out = joined.join(least, "component").select("row", "doc_id", "text_hash", "n", "component_id", (F.col("row") == F.col("first")).alias("first"))
    out = store.keep(out, "result")
    store.drop(all_but=[out])
    return out


def keep_one(docs: DataFrame, size: int = 4, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs but one of each component: that with the smallest doc_id stays, a row without an id only if none has one.

    Documents without words stay. Of rows that repeat both id and text one stays; the columns are those of docs.
    """
    names = docs.columns
    found = _components(docs, size, percent, doc_id, text)
    id_, hash_ = F.col(doc_id).cast("long"), F.xxhash64(text_of(text))
    gone = found.where("not first and n > 0").select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash"))
    stay = found.where("first and n > 0").select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash"))
    again = stay.intersect(gone)
    if not again.limit(1).count():
        match = id_.eqNullSafe(F.col("_gone_id")) & (hash_ == F.col("_gone_hash"))
        return docs.join(gone, match, "left_anti").select(*names)
    # Some rows repeat both: number the equal ones and let only the first stay.
    marked = docs.select(*names, id_.alias("_jid"), hash_.alias("_jhash"))
    match = F.col("_jid").eqNullSafe(F.col("_gone_id")) & (F.col("_jhash") == F.col("_gone_hash"))
    ours = marked.join(stay.distinct(), match, "left_semi").dropDuplicates(["_jid", "_jhash"])
    rest = marked.join(stay.unionByName(gone).distinct(), match, "left_anti")
    return ours.unionByName(rest).select(*names)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
