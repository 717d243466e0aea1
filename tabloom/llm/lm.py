"""Hashed maximum-entropy language model (operator 6).

P(word | history) = P(class | history) x P(word | class). The class of a word is a hash of its last letters, so no table is
needed to know it. P(class | history) is a softmax over hashed features of the history: the previous word, the one
before it (a skip feature), and both together. P(word | class) is the softmax of the smoothed log counts inside the class,
with one entry for all unseen words of the class.

Weights are trained by rounds of distributed gradient updates: in a round every task runs gradient steps over its own
documents from the common weights, and the tasks' results are averaged by tokens; each round takes its own share of the
documents, so that all training tokens are used. The buckets grow with the distinct words of the training documents. Counts are gathered per block of documents, summed over the corpus, and
returned to the blocks that use the words, so that a block holds only its own vocabulary, whatever the corpus has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, ship, table, text_of

CLASSES = 32
#: Least buckets of a feature; see buckets_for().
BUCKETS = 1 << 12
FEATURES = 3
STEP = 8192
#: Characters of text in a block.
BLOCK_CHARS = 8_000_000
#: Words that a worker remembers between batches.
REMEMBERED = 400_000
END, START = 0x1234567, 0x7654321


class Words:
    """Hashes and classes of words by position; the empty word, at 0, is the end token."""

    def __init__(self):
        import numpy as np

        self.at = {b"": 0}
        self.hashes, self.classes = np.full(1 << 16, END, np.uint64), np.zeros(1 << 16, np.int64)

    def add(self, words: list[bytes]) -> None:
        import numpy as np
        import xxhash

        old, new = len(self.at), len(self.at) + len(words)
        while len(self.hashes) < new:
            self.hashes, self.classes = np.concatenate([self.hashes, self.hashes]), np.concatenate([self.classes, self.classes])
        self.hashes[old:new] = [xxhash.xxh3_64_intdigest(w) for w in words]
        self.classes[old:new] = [1 + xxhash.xxh32_intdigest(w[-2:]) % (CLASSES - 1) for w in words]
        self.at.update(zip(words, range(old, new), strict=True))


_SEEN: list[Words] = []


def tokens(texts: list[str]):
    """Word hashes, classes and document starts: words in lower-case A-Z, each document closed by an end token (class 0)."""
    import numpy as np

    if not _SEEN or len(_SEEN[0].at) > REMEMBERED:
        _SEEN[:] = [Words()]
    seen = _SEEN[0]
    split = [[*t.encode().lower().split(), b""] for t in texts]
    seen.add([w for w in {*chain.from_iterable(split)} if w not in seen.at])
    ends = np.cumsum([0, *map(len, split)]).astype(np.int64)
    where = np.fromiter(map(seen.at.__getitem__, chain.from_iterable(split)), np.int64, ends[-1])
    return seen.hashes[where], seen.classes[where], ends


def buckets_for(words: int) -> int:
    """Buckets of each feature for a corpus of so many distinct words: a power of two, at least eight times the square root."""
    return max(BUCKETS, 1 << math.ceil(math.log2(8 * max(1, words) ** 0.5)))


def buckets_of(weights) -> int:
    return (len(weights) - 1) // FEATURES


def histories(h, starts, buckets: int = BUCKETS):
    """Feature buckets of each token: (tokens, FEATURES)."""
    import numpy as np

    one = np.concatenate([[START], h[:-1]]).astype(np.uint64)
    one[starts[:-1]] = START
    two = np.concatenate([[START], one[:-1]]).astype(np.uint64)
    two[starts[:-1]] = START
    mix = lambda x, k: ((x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD + 2 * k) >> np.uint64(40)) % np.uint64(buckets) + np.uint64(k * buckets)
    return np.stack([mix(one, 0), mix(two, 1), mix(one * np.uint64(0x9E3779B97F4A7C15) + two, 2)], axis=1).astype(np.int64)


def class_scores(weights, features):
    """Unnormalised log probabilities of the classes, 0 for the likeliest; weights[-1] is the bias."""
    z = weights.take(features[:, 0], axis=0)
    for k in range(1, features.shape[1]):
        z += weights.take(features[:, k], axis=0)
    z += weights[-1]
    z -= z.max(axis=1, keepdims=True)
    return z


def class_log_probs(weights, features):
    """Log softmax over classes."""
    import numpy as np

    z = class_scores(weights, features)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def log_prob_of(weights, features, classes):
    """The same, for the given class of each token only."""
    import numpy as np

    z = class_scores(weights, features)
    own = z[np.arange(len(z)), classes]
    return own - np.log(np.exp(z, out=z).sum(axis=1))


def descend(weights, h, c, starts, rate: float):
    """One pass of damped gradient steps over the tokens, in place."""
    import numpy as np

    buckets = buckets_of(weights)
    feats = histories(h, starts, buckets)
    for at in range(0, len(h), STEP):
        f, y = feats[at : at + STEP], c[at : at + STEP]
        g = class_scores(weights, f)
        np.exp(g, out=g)
        g /= g.sum(axis=1, keepdims=True)
        g[np.arange(len(y)), y] -= 1
        weights[-1] -= rate * g.mean(axis=0)
        for k in range(FEATURES):
            # While the buckets of a feature fit 16 bits, numpy sorts them by digits.
            bucket = (f[:, k] - k * buckets).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            share = rate / (np.diff(first, append=len(bucket)) + 4.0)
            weights[bucket[first].astype(np.int64) + k * buckets] -= np.add.reduceat(g.take(order, axis=0), first, axis=0) * share[:, None].astype(weights.dtype)


def _train_round(docs: DataFrame, weights, rate: float):
    """The average of the tasks' weights after one pass over docs, by tokens; docs has few enough tasks for what they return."""
    import numpy as np

    start, chunk = weights.astype(np.float32), 256
    shared = docs.sparkSession.sparkContext.broadcast(start.tobytes())  # (FEATURES * buckets + 1) x CLASSES, which grows as the square root of the distinct words

    def run(batches) -> Iterator:
        import pyarrow as pa

        w = np.frombuffer(shared.value, np.float32).reshape(-1, CLASSES).copy()
        total = 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 256):
                h, c, s = tokens(texts[at : at + 256])
                descend(w, h, c, s, rate)
                total += len(h)
        if total:
            w = w * np.float32(total)
            yield pa.RecordBatch.from_pydict({"part": list(range(0, len(w), chunk)), "tokens": [total] * len(range(0, len(w), chunk)), "w": [w[i : i + chunk].tobytes() for i in range(0, len(w), chunk)]}, schema=pa.schema([("part", pa.int32()), ("tokens", pa.int64()), ("w", pa.binary())]))

    def add(batches) -> Iterator:
        import pyarrow as pa

        parts: dict[int, list] = {}
        for batch in batches:
            for part, n, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "tokens", "w")), strict=True):
                x = np.frombuffer(raw, np.float32).astype(np.float64)
                old = parts.get(part)
                parts[part] = [n, x] if old is None else [old[0] + n, old[1] + x]
        if parts:
            yield pa.RecordBatch.from_pydict({"part": list(parts), "tokens": [v[0] for v in parts.values()], "w": [v[1].tobytes() for v in parts.values()]}, schema=pa.schema([("part", pa.int32()), ("tokens", pa.int64()), ("w", pa.binary())]))

    schema = "part int, tokens long, w binary"
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = docs.select("text").mapInArrow(run, schema).repartition(n, "part").mapInArrow(add, schema).collect()
    shared.unpersist()
    result = weights.copy()
    for r in out:
        x = np.frombuffer(r["w"], np.float64).reshape(-1, CLASSES) / r["tokens"]
        result[r["part"] : r["part"] + len(x)] = x
    return result


def train(docs: DataFrame, rounds: int = 2, rate: float = 1.0, buckets: int = BUCKETS, chars: int | None = None):
    """Class weights from training documents; zero weights (uniform classes) without any.

    chars: the characters of docs, if known. Then so few tasks take part that the weights they return stay below an eighth of that.
    """
    import numpy as np

    weights = np.zeros((FEATURES * buckets + 1, CLASSES))
    if chars is not None:
        docs = docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, chars // (8 * 4 * weights.size)))
    for k in range(rounds):
        weights = _train_round(docs.where(F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(rounds)) == k), weights, rate / (k + 1) ** 0.5)
    return weights


def _block_counts(blocks: DataFrame) -> DataFrame:
    """(block, word, class, n): distinct words of each block and how often its training documents have them."""

    def count(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held: dict[int, list] = {}
        size = 0

        def merged():
            for block, parts in held.items():
                w = np.concatenate([p[0] for p in parts])
                words, first, where = np.unique(w, return_index=True, return_inverse=True)
                n = np.bincount(where, np.concatenate([p[2] for p in parts]), len(words)).astype(np.int64)
                yield block, words, np.concatenate([p[1] for p in parts])[first], n

        for batch in batches:
            ids = np.array(batch.column("block").to_pylist(), np.int64)
            learn = np.array(batch.column("held_out").to_pylist(), bool)
            texts = batch.column("text").to_pylist()
            for at in range(0, len(texts), 256):
                h, c, s = tokens(texts[at : at + 256])
                lengths = np.diff(s)
                block, weight = np.repeat(ids[at : at + 256], lengths), np.repeat(~learn[at : at + 256], lengths).astype(np.float64)
                for b in np.unique(ids[at : at + 256]):
                    m = block == b
                    words, first, where = np.unique(h[m], return_index=True, return_inverse=True)
                    held.setdefault(int(b), []).append((words, c[m][first], np.bincount(where, weight[m], len(words))))
                    size += len(words)
            if size > 4_000_000:
                held = {b: [(w, c, n.astype(np.float64))] for b, w, c, n in merged()}
                size = sum(len(p[0][0]) for p in held.values()) // 2
        for block, words, classes, n in merged():
            for at in range(0, len(words), 100_000):
                part = slice(at, at + 100_000)
                k = len(words[part])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, block, np.int32)), pa.array(words[part].view(np.int64)), pa.array(classes[part].astype(np.int32)), pa.array(n[part])], names=["block", "word", "class", "n"])

    return blocks.select("block", "held_out", "text").mapInArrow(count, "block int, word long, class int, n long")


def score_documents(docs: DataFrame, rounds: int = 2, doc_id: str = "doc_id", text: str = "text", held_out: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs.

    held_out: a boolean column; without it, documents whose crc32(doc_id as text) mod 10 is 0 are held out. Null text is
    empty and has its end token only. Rows that repeat a doc_id, or have
    none, are scored each by itself, and do not crowd one block; other columns are not read; an empty table gives no rows. A text is
    scored in one task.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    out_of = F.col(held_out) if held_out else F.crc32(F.col(doc_id).cast("string").cast("binary")) % 10 == 0
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(out_of, F.lit(False)).alias("held_out"), text_of(text).alias("text"))
    size = rows.agg(F.sum(F.length("text") + 1).alias("n")).first()["n"] or 0
    blocks = max(32, -(-size // BLOCK_CHARS))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks // 4)
    placed = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    local = materialize(_block_counts(placed.repartition(parts, "block")), "blockwords")
    counts = materialize(local.groupBy("word", "class").agg(F.sum("n").alias("c")), "words")
    known = counts.where("c > 0").groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()  # CLASSES rows
    train_tokens, vocabulary = sum(r["n"] for r in known), sum(r["v"] for r in known)
    per_class = {r["class"]: (r["n"], r["v"]) for r in known}
    weights = train(rows.where(~F.col("held_out")), rounds, buckets=buckets_for(vocabulary), chars=size)
    shared = spark.sparkContext.broadcast(weights.astype("float32").tobytes())  # as large as in training
    words = local.select("block", "word").join(counts.select("word", "c"), "word").select("block", "word", "c")

    def score(key, texts, own):
        import numpy as np
        import pandas as pd

        w = np.frombuffer(shared.value, np.float32).reshape(-1, CLASSES)
        own = own.sort_values("word")
        vocab, c_of = own["word"].to_numpy(), own["c"].to_numpy().astype(np.float64)
        base_all = train_tokens + 0.1 * (vocabulary + 1)
        class_all = np.array([per_class.get(k, (0, 0))[0] + 0.1 * (per_class.get(k, (0, 0))[1] + 1) for k in range(CLASSES)])
        frames = []
        for at in range(0, len(texts), 256):
            part = texts.iloc[at : at + 256]
            h, c, s = tokens(part["text"].tolist())
            n = c_of[np.searchsorted(vocab, h.view(np.int64))]
            feats, logp = histories(h, s, buckets_of(w)), np.empty(len(h))
            for i in range(0, len(h), STEP):
                logp[i : i + STEP] = log_prob_of(w, feats[i : i + STEP], c[i : i + STEP])
            full = logp / np.log(10) + np.log10((n + 0.1) / class_all[c])
            frames.append(pd.DataFrame({
                "doc_id": part["doc_id"].to_numpy(), "held_out": part["held_out"].to_numpy(), "n_tokens": np.diff(s), "n_known": np.add.reduceat((n > 0).astype(np.int64), s[:-1]),
                "train_tokens": train_tokens, "base_score": np.add.reduceat(np.log10((n + 0.1) / base_all), s[:-1]), "score": np.add.reduceat(full, s[:-1]),
            }))
        return pd.concat(frames) if frames else pd.DataFrame({k: [] for k in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return placed.groupBy("block").cogroup(words.groupBy("block")).applyInPandas(score, schema)


def op6_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
