"""Spelling variants by reduced-alphabet generation (operator 11).

Letters are hashed to a few symbols. The full one-edit neighbourhood of every distinct reduced word is generated over that
small alphabet and joined with the reduced vocabulary; words whose reduced words meet are verified as they are written. Two
words within one edit have reduced words within one edit, so no pair is lost. A pair of reduced words finds each other from
both sides; it is kept on the side of the smaller hash. Reduced words travel as 64-bit hashes: a collision adds a candidate
for the check on the words themselves, nothing else.

The alphabet grows with the eighth root of the vocabulary, so that reduced words of usual length stay about as many as words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ship, table, text_of

#: Letters of a word: the ranges are fixed values of the contract.
LETTERS = "[A-Za-zÀ-ÿ]"
LEAST_LENGTH, LEAST_COUNT, RATIO, TYPO = 7, 2, 10, 31
#: Distinct words that a task counts before it passes them on.
HELD = 200_000
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def with_typo(doc_id: object, run: str, every: int = TYPO) -> str:
    """The run without one letter if the checksum of `<doc_id>:<run>` is a multiple of every."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, least_length: int = LEAST_LENGTH, typos: int | None = None) -> DataFrame:
    """(word, n): the maximal runs of letters of at least least_length code points in all texts, A-Z in lower case.

    typos: delete a letter as with_typo() does before words are told apart. Null texts have no words, null ids read as empty
    in with_typo(); repeated rows count again, other columns are not read, an empty table gives an empty one. Tasks count
    before the shuffle, so that a frequent word is one row a task.
    """
    ship(docs.sparkSession)

    def count(batches) -> Iterator:
        import pyarrow as pa

        find, held = re.compile(f"{LETTERS}{{{least_length},}}").findall, Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array([*held.keys()], pa.string()), pa.array([*held.values()], pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                runs = find(text.as_py().encode().lower().decode())
                if typos is None:
                    held.update(runs)
                else:
                    for run, n in Counter(runs).items():
                        word = with_typo(doc, run, typos)
                        if len(word) >= least_length:
                            held[word] += n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), text_of().alias("text"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Symbols(dict):
    """For str.translate: every code point to one of a few letters, by a hash."""

    def __init__(self, size: int):
        self.size = size

    def __missing__(self, code: int) -> str:
        self[code] = chr(97 + zlib.crc32(code.to_bytes(4, "little")) % self.size)
        return self[code]


def symbols_for(words: int) -> int:
    """Symbols of the reduced alphabet: the eighth root of the vocabulary, 2 to 26."""
    return min(26, max(2, int(words ** (1 / 8)) + 1))


def _mix(h, length: int):
    import numpy as np

    h = h + np.uint64((length * 0xD6E8FEB86659FD93) & _MASK)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _powers(length: int):
    import numpy as np

    return np.array([pow(_BASE, i, 1 << 64) for i in range(length)], np.uint64)


def _values(reduced: list[str]):
    """A row per reduced word, all of one length: a number per symbol."""
    import numpy as np

    codes = np.frombuffer("".join(reduced).encode(), np.uint8).reshape(len(reduced), len(reduced[0])).astype(np.uint64) - np.uint64(96)
    return codes * np.uint64(0xBF58476D1CE4E5B9)


def _hashes(values):
    length = values.shape[1]
    return _mix((values * _powers(length)).sum(axis=1, dtype=values.dtype), length)


def neighbourhoods(reduced: list[str], size: int) -> Iterator:
    """(own hash, hash of a neighbour) arrays: the full one-edit neighbourhoods over size symbols, as far as they follow the own hash, which is among them; reduced words all of one length."""
    import numpy as np

    v = _values(reduced)
    m, n = v.shape
    up = _powers(n + 1)
    letters = _values([chr(97 + k) for k in range(size)])[:, 0]
    terms = v * up[:n]
    before = np.concatenate([np.zeros((m, 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)
    after = before[:, -1:] - before
    own = _mix(before[:, -1], n)
    down = np.uint64(pow(_BASE, -1, 1 << 64))
    deleted = _mix(before[:, :-1] + after[:, 1:] * down, n - 1)
    replaced = _mix((before[:, -1:] - terms)[:, :, None] + letters * up[:n, None], n).reshape(m, -1)
    inserted = _mix((before + after * np.uint64(_BASE))[:, :, None] + letters * up[: n + 1, None], n + 1).reshape(m, -1)
    near = np.sort(np.concatenate([deleted, replaced, inserted], axis=1), axis=1)
    keep = near >= own[:, None]
    keep[:, 1:] &= near[:, 1:] != near[:, :-1]
    yield np.repeat(own, keep.sum(axis=1)), near[keep]


def reduce_words(words: DataFrame, size: int) -> DataFrame:
    """words (word, n) with their reduced word and its hash."""
    ship(words.sparkSession)

    def reduce(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        symbols = Symbols(size)
        for batch in batches:
            reduced = [w.translate(symbols) for w in batch.column("word").to_pylist()]
            hashes = np.empty(len(reduced), np.int64)
            lengths = np.fromiter(map(len, reduced), np.int64, len(reduced))
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                hashes[at] = _hashes(_values([reduced[i] for i in at]))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(reduced, pa.string()), pa.array(hashes)], names=["word", "n", "reduced", "h"])

    return words.select("word", "n").mapInArrow(reduce, "word string, n long, reduced string, h long")


def near_pairs(words: DataFrame, store: Scratch | None = None) -> DataFrame:
    """(a, a_n, b, b_n): each pair of words of (word, n) that differ by exactly one inserted, deleted or replaced code point, once.

    Words are distinct and not null. Candidates are checked inside the join that finds them, so that only pairs leave it.
    """
    store = store or Scratch(words.sparkSession)
    size = symbols_for(words.count())
    reduced = store.keep(reduce_words(words.where("word is not null"), size), "reduced")

    def generate(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            groups: dict[int, list[str]] = {}
            for w in batch.column("reduced").to_pylist():
                groups.setdefault(len(w), []).append(w)
            for length, group in groups.items():
                step = max(1, 200_000 // ((2 * length + 1) * size + length + 1))
                for at in range(0, len(group), step):
                    for own, near in neighbourhoods(group[at : at + step], size):
                        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(near)], names=["h", "near"])

    classes = reduced.select("reduced", "h").distinct()
    met = classes.mapInArrow(generate, "h long, near long").join(classes.select(F.col("h").alias("near")).distinct().hint("shuffle_hash"), "near")
    a, b = (reduced.select(F.col("word").alias(x), F.col("n").alias(f"{x}_n"), F.col("h").alias(f"{x}_h")) for x in "ab")
    one_side = (F.col("a_h") != F.col("b_h")) | (F.col("a") < F.col("b"))
    found = met.join(a, F.col("h") == F.col("a_h")).join(b, (F.col("near") == F.col("b_h")) & one_side & (F.levenshtein("a", "b", 1) == 1))
    return found.select("a", "a_n", "b", "b_n").distinct()


def _better(n: Column, word: Column) -> Column:
    """Smallest for the largest n, then for the first word in code-point order."""
    return F.struct((-n).alias("minus"), word.alias("word"))


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a table of distinct words (word, n); rows with a null word go.

    n_near: words one edit away. form: the one of them with the largest n (ties: the first in code-point order) if that n is at
    least ratio times the word's; else null. root: the word that following forms ends at, the word itself without a form. Forms
    are more frequent by ratio > 1 at each step, so there are no cycles and few steps; steps double until all have ended.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    store = Scratch(words.sparkSession)
    words = store.keep(words.where("word is not null").select("word", F.col("n").cast("long").alias("n")), "words")
    pairs = store.keep(near_pairs(words, store), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))
    )
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(_better(F.col("other_n"), F.col("other"))).alias("best"))
    frequent = -F.col("best.minus") >= ratio * F.col("n")
    formed = store.keep(best.select("word", "n_near", F.when(frequent, F.col("best.word")).alias("form"), F.when(frequent, -F.col("best.minus")).alias("form_n")), "forms")
    roots = store.keep(formed.where("form is not null").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while roots.where("moved").limit(1).count():
        to = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = store.keep(roots.join(to, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        store.drop(roots)
        roots = after
    out = words.join(formed, "word", "left").join(roots.select("word", "root"), "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = count_words(table(spark, sf_dir, "documents"), typos=TYPO).where(F.col("n") >= LEAST_COUNT)
    return group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")
