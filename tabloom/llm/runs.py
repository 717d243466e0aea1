"""Periodic runs of words (operator 13) as maximal pairs of equal word sequences.

A run of period q and length m is a pair of equal sequences of m - q words, q apart, that neither the words before nor those
after extend: a maximal pair. With m >= 4q the pair is at most a third of its own length apart. So the suffixes of a text's
words are sorted, neighbours get their longest common prefix, and the LCP intervals are merged bottom up. An interval
keeps its positions in a list for each word to the left. When two children meet, each position of the smaller one is
looked up in the lists of other left words of the larger one: the nearest partner on each side, if it is near enough for the
interval's prefix length, is a maximal pair and thereby a run, with its ends. A pair that skips a partner in between has a
multiple of the run's period; the smallest period of each stretch is kept.

Only suffixes that share three words with another can hold a pair of length 3q, so the others are left out of the tree.
A text is one record and meets in one task; texts are handled together up to a number of words, and nothing is shuffled.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table, text_of

#: Least length and least length in periods of a run: fixed values of the contract.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words that are sorted in one go; a longer text is sorted alone.
WORDS = 400_000
RUNS = "array<struct<start: long, length: long, period: long>>"


def repeated_suffixes(ids, ends):
    """Positions that share three words with another of the same text, in suffix order, and the group of equal three words of each.

    ids: word numbers from 1, different between texts; ends: where the text of each position ends. By doubling: suffixes that
    are alone leave the next rounds.
    """
    import numpy as np

    n = len(ids)
    following = np.append(ids[1:], 0)
    following[ends - 1] = 0
    key = (ids << 32) | following
    order = np.argsort(key, kind="stable")
    rank, active, new = np.empty(n, np.int64), order, np.ones(n, bool)
    np.not_equal(key[order][1:], key[order][:-1], out=new[1:])
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]

    def crowded(new):
        """Members of groups of two or more, of sorted elements with their first ones marked."""
        return ~new | np.append(~new[1:], False)

    active, step, top = order[crowded(new)], 1, None
    while len(active):
        there = active + step
        later = np.where(there < ends[active], rank[np.minimum(there, n - 1)] + 1, 0)
        base = rank[active]
        key = (base << 32) | later
        order = np.argsort(key, kind="stable")
        active, key, base = active[order], key[order], base[order]
        new, group = np.ones(len(key), bool), np.ones(len(key), bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        np.not_equal(base[1:], base[:-1], out=group[1:])
        first, start = np.flatnonzero(new)[np.cumsum(new) - 1], np.flatnonzero(group)[np.cumsum(group) - 1]
        rank[active] = base + first - start
        active = active[crowded(new)]
        if top is None:
            top, groups, step = active, rank[active], 3
        else:
            step *= 2
    if top is None:
        return order[:0], order[:0]
    order = np.argsort(rank[top], kind="stable")
    return top[order], groups[order]


def common_prefixes(ids: list[int], order: list[int], groups: list[int]) -> list[int]:
    """Words that each position of order shares with the one before; 0 where a group of equal three words begins.

    In the order of the text: a suffix shares at least one word less than the one a word earlier did. ids ends with a 0.
    """
    at = dict(zip(order, range(len(order)), strict=True))
    out, before, shared = [0] * len(order), -2, 0
    for i in sorted(order):
        k = at[i]
        if k and groups[k] == groups[k - 1]:
            j = order[k - 1]
            shared = shared - 1 if i == before + 1 and shared > 4 else 3
            while ids[i + shared] == ids[j + shared]:
                shared += 1
            out[k] = shared
        else:
            shared = 0
        before = i
    return out


def _meet(large: dict, small: dict, prefix: int, ids: list[int], found: dict) -> None:
    """Maximal pairs of two children of an interval of that prefix length, at most a third of it apart; then small joins large."""
    reach = prefix // (LEAST_PERIODS - 1)

    def pair(i: int, j: int) -> None:
        stretch = (i, j - i + prefix)
        if j - i < found.get(stretch, prefix):
            found[stretch] = j - i

    for left, positions in small.items():
        if len(large) > 2 * reach:
            # More left words than places in reach: the places are looked up instead.
            for x in positions:
                for step in (1, -1):
                    for y in range(x + step, x + step * (reach + 1), step):
                        other = ids[y - 1] if 0 <= y < len(ids) else left
                        others = large.get(other, ()) if other != left else ()
                        k = bisect_left(others, y)
                        if k < len(others) and others[k] == y:
                            pair(min(x, y), max(x, y))
                            break
            continue
        for other, others in large.items():
            if other == left:
                continue
            for x in positions:
                k = bisect_left(others, x)
                if k < len(others) and others[k] - x <= reach:
                    pair(x, others[k])
                if k and x - others[k - 1] <= reach:
                    pair(others[k - 1], x)
    for left, positions in small.items():
        have = large.get(left)
        if have is None:
            large[left] = positions
        elif positions[0] > have[-1]:
            have += positions
        else:
            large[left] = sorted(have + positions)


def _climb(order: list[int], shared: list[int], ids: list[int], found: dict) -> None:
    """The LCP intervals of one group, bottom up; shared[0] is 0."""
    open_: list[tuple[int, int, dict]] = []
    size, node = 1, {ids[order[0] - 1]: [order[0]]}
    for k in range(1, len(order) + 1):
        prefix = shared[k] if k < len(order) else 0
        while open_ and open_[-1][0] >= prefix:
            depth, others, lists = open_.pop()
            if others >= size:
                _meet(lists, node, depth, ids, found)
                node = lists
            else:
                _meet(node, lists, depth, ids, found)
            size += others
            if depth == prefix:
                break
        if k < len(order):
            open_.append((prefix, size, node))
            size, node = 1, {ids[order[k] - 1]: [order[k]]}


def find_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each list of words, by start, then period."""
    import numpy as np

    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    if not cuts[-1]:
        return out
    ids, first = np.empty(cuts[-1], np.int64), 1
    for a, words in zip(cuts.tolist(), texts, strict=False):
        distinct = {*words}
        number = dict(zip(distinct, range(first, first + len(distinct)), strict=True))
        ids[a : a + len(words)] = [*map(number.__getitem__, words)]
        first += len(distinct)
    order, groups = repeated_suffixes(ids, np.repeat(cuts[1:], sizes))
    if not len(order):
        return out
    plain = [*ids.tolist(), 0]
    shared = np.array(common_prefixes(plain, order.tolist(), groups.tolist()), np.int64)
    # A group whose longest common prefix is below three times its nearest distance holds no pair.
    starts = np.flatnonzero(shared == 0)
    longest = np.maximum.reduceat(shared, starts)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    by_place = np.lexsort((order, group))
    gaps = np.diff(order[by_place], prepend=0)
    gaps[starts] = cuts[-1]
    nearest = np.minimum.reduceat(gaps, starts)
    found: dict[tuple[int, int], int] = {}
    sizes_of = np.diff(np.append(starts, len(order)))
    for k in np.flatnonzero(longest >= (LEAST_PERIODS - 1) * nearest).tolist():
        a = int(starts[k])
        b = a + int(sizes_of[k])
        _climb(order[a:b].tolist(), shared[a:b].tolist(), plain, found)
    runs = sorted((start, period, length) for (start, length), period in found.items() if length >= max(LEAST_WORDS, LEAST_PERIODS * period))
    where = np.searchsorted(cuts, [r[0] for r in runs], "right") - 1
    for doc, (start, period, length) in zip(where.tolist(), runs, strict=True):
        out[doc].append((start - int(cuts[doc]), length, period))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that some run contains after its first period, with single blanks between."""
    if not runs:
        return b" ".join(words)
    keep = bytearray(b"\x01") * len(words)
    for start, length, period in runs:
        keep[start + period : start + length] = bytes(length - period)
    return b" ".join([w for w, k in zip(words, keep, strict=True) if k])


def plant(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """A tenth of the documents, by checksum of the id, repeat a stretch of their words to their end."""
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * ((n - a) // p + 1))[: n - a]


def periodic_runs(docs: DataFrame, change: Callable[[list[bytes], int | None], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): all runs of the words of each text, and the text with each run cut to one period.

    change: applied to the words and the id first. Words are maximal runs without blanks and \\x09-\\x0D; case counts. Null and
    empty texts have no words, no runs and an empty collapsed text. Null and repeated ids stay, a row for a row; other columns
    are not read; an empty table gives an empty one. Runs are in order of start, then period.
    """
    ship(docs.sparkSession)

    def work(batches) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

        def flush():
            runs = find_runs(texts)
            texts_out = [collapse(t, r).decode() for t, r in zip(texts, runs, strict=True)]
            rows = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(rows, kind), pa.array(texts_out, pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

        ids, texts, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = text.as_py().encode().split()
                words = change(words, doc) if change else words
                if texts and size + len(words) > WORDS:
                    yield flush()
                    ids, texts, size = [], [], 0
                ids.append(doc)
                texts.append(words)
                size += len(words)
        if texts:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(work, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), plant)
    # Longest first, then smallest start and period: the smallest of these structs.
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.minus")).alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * -best.minus) div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
