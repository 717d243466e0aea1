"""BPE encoding and decoding by prefix-sharing trie traversal (operator 12).

The encoding of a word is known from its prefixes: it ends with the one token t that is a suffix of the word and that merging
would leave apart from the last token of the encoding of what precedes t. Words enter a trie, which is held as their sorted
list: a branch is where a word leaves the one before it. Depth first, every node gets the last token of its prefix from the
nodes above it, so that a prefix shared by many words is encoded once. The last symbol of a word carries the mark of a word's end,
if the file has one, and is a leaf of its own.

Whether two tokens stay apart is read off their merges: y|x is merged across if some token L at the right edge of y's merge tree
and some R at the left edge of x's have a merge of a rank at which both still stand by themselves.

Texts are cut into words as the file's normalizer and pre-tokenizer say; words that a worker has met are remembered, up to a limit.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, table, text_of
from .tokens import LIMIT, Encoder, vocabulary

#: Characters of text encoded in one go.
CHARS = 3_000_000
#: Verdicts on token pairs that a worker remembers.
PAIRS = 500_000
NEVER = 1 << 60
_LOADED: dict[str, TrieEncoder] = {}


class Merges:
    """Tokens and merges of a BPE file, and the encodings of words in its symbols."""

    def __init__(self, model: dict):
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("only plain BPE files are supported")
        ids, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        products = {a + b for a, b in pairs}
        if len(products) < len(pairs):
            raise ValueError("a token has two merges")
        #: Text of each token as (symbols, whether it ends a word), by id.
        shape = {i: (t.removesuffix(suffix) if suffix else t, bool(suffix) and t.endswith(suffix) and t != suffix) for t, i in ids.items() if t not in products}
        self.split: dict[int, tuple[int, int, int]] = {}
        self.rank: dict[int, int] = {}
        self.size = max(ids.values()) + 1
        for rank, (a, b) in enumerate(pairs):
            a, b, t = ids[a], ids[b], ids[a + b]
            if a not in shape or b not in shape:
                raise ValueError("a merge comes before those of its parts")
            self.split[t], self.rank[a * self.size + b] = (a, b, rank), rank
            shape[t] = (shape[a][0] + shape[b][0], shape[b][1])
        self.known: dict[int, bool] = {}
        usable = [t for t in shape if len(shape[t][0]) == 1 or (t in self.split and self._apart(*self.split[t]))]
        self.inner = {shape[t][0]: t for t in usable if not shape[t][1]}
        self.final = {shape[t][0]: t for t in usable if shape[t][1]} if suffix else self.inner
        self.longest = max(len(s) for s, _ in shape.values())
        missing = [c for c in _byte_symbols() if c not in self.inner or c not in self.final]
        if missing:
            raise ValueError("the file has no token for some bytes")

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens along an edge of a token's merge tree, each with the rank at which it is merged into the next."""
        out = [(token, NEVER)]
        while token in self.split:
            rank = self.split[token][2]
            token = self.split[token][side]
            out.append((token, rank))
        return out

    def _apart(self, y: int, x: int, until: int = NEVER) -> bool:
        """Whether no merge crosses from y to x before rank until. At equal ranks the left one is merged first."""
        right = self._edge(x, 0)
        for a, gone in self._edge(y, 1):
            for b, used in right:
                rank = self.rank.get(a * self.size + b)
                if rank is not None and rank < until and rank < gone and rank <= used:
                    return False
        return True

    def stay_apart(self, y: int, x: int) -> bool:
        key = y * self.size + x
        out = self.known.get(key)
        if out is None:
            if len(self.known) > PAIRS:
                self.known.clear()
            out = self.known[key] = self._apart(y, x)
        return out

    def encode(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Token ids of distinct words (in symbols of the file), depth first through the trie of the words."""
        out, before, have = {}, "", 0
        inner, final, longest, known, size = self.inner, self.final, self.longest, self.known, self.size
        last, start = [0], [0]  # by depth: the last token of the prefix, and where it starts
        for word in sorted(words):
            n = len(word)
            if not n:
                out[word] = []
                continue
            t = final.get(word)
            if t is not None:
                # A token by itself; the path stays at the word before.
                out[word] = [t]
                continue
            while len(last) <= n:
                last.append(0)
                start.append(0)
            depth, most = 0, min(have, n - 1)
            if word[:most] == before[:most]:
                depth = most
            else:
                while word[depth] == before[depth]:
                    depth += 1
            for d in range(depth + 1, n + 1):
                tokens = inner if d < n else final
                for at in range(max(0, d - longest), d):
                    t = tokens.get(word[at:d])
                    if t is not None:
                        if not at:
                            break
                        apart = known.get(last[at] * size + t)
                        if apart if apart is not None else self.stay_apart(last[at], t):
                            break
                else:
                    raise ValueError(f"no token ends {word[:d]!r}")
                if d < n:
                    last[d], start[d] = t, at
            ids = [t]
            while at:
                ids.append(last[at])
                at = start[at]
            ids.reverse()
            out[word], before, have = ids, word, n - 1
        return out


def _byte_symbols() -> list[str]:
    from tokenizers.pre_tokenizers import ByteLevel

    return ByteLevel.alphabet()


class TrieEncoder(Encoder):
    """Encoder whose words are encoded by Merges; the library only normalizes and cuts texts into words."""

    def __init__(self, path: str, limit: int = LIMIT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        file = json.loads(tokenizer.to_str())
        odd = [t for t in file["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or (t["normalized"] and file["normalizer"])]
        if odd:
            raise ValueError("added tokens that take blanks, single words or normalized text are not supported")
        self.bpe = Merges(file["model"])
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.normalizer, self.pre_tokenizer = tokenizer.normalizer, tokenizer.pre_tokenizer
        super().__init__(path, limit)
        self.batch = 40_000

    def _words(self, text: str) -> list[str]:
        """The words that the file cuts a text into, in its symbols."""
        text = self.normalizer.normalize_str(text) if self.normalizer else text
        return [w for w, _ in self.pre_tokenizer.pre_tokenize_str(text)] if self.pre_tokenizer else [text]

    def _directly(self, text: str) -> bytes:
        import numpy as np

        parts = self.at_special.split(text) if self.at_special else [text]
        ids: list[int] = []
        for part in parts:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                words = self._words(part)
                known = self.bpe.encode({*words})
                for w in words:
                    ids += known[w]
        return np.array(ids, "<u4").tobytes()

    def _remember(self, parts: list[str]) -> None:
        import numpy as np

        mark = self.between.strip(" ") or self.between
        cut: dict[str, list[str]] = {}
        if self.quick and self.quick.folds:
            # In such a file a run of ASCII letters is a word of its own, in these letters.
            cut = {p: [p.lower()] for p in parts if p.isascii() and p.isalpha()}
        lines = [p for p in parts if p not in cut and mark not in p] if self.line is not None else []
        if lines:
            words = self._words(self.between.join(lines))
            alone = self._words(mark)
            at = [i for i, w in enumerate(words) if w == alone[0]] if len(alone) == 1 else []
            if len(at) == len(lines) - 1:
                cut |= {p: words[a:b] for p, a, b in zip(lines, [0, *[i + 1 for i in at]], [*at, len(words)], strict=True)}
        for p in parts:
            if p not in cut:
                cut[p] = self._words(p)
        ids = self.bpe.encode({w for words in cut.values() for w in words})
        packed = dict(zip(ids, _packed([*ids.values()], np), strict=True))
        self.parts.update([(p, packed[w[0]] if len(w) == 1 else b"".join([packed[x] for x in w])) for p, w in cut.items()])


def _packed(lists: list[list[int]], np) -> list[bytes]:
    """Each list as little-endian unsigned 32-bit integers."""
    ends = (4 * np.cumsum([0, *map(len, lists)])).tolist()
    data = np.array([i for x in lists for i in x], "<u4").tobytes()
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def trie_encoder(path: str) -> TrieEncoder:
    """One per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = TrieEncoder(path)
    return _LOADED[path]


class Decoder:
    """Texts from ids, as the file's decoder says: tokens with blanks between where it has none, else bytes. Unknown ids are left out."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        kind = (json.loads(tokenizer.to_str())["decoder"] or {}).get("type")
        if kind not in (None, "ByteLevel"):
            raise ValueError(f"a decoder of type {kind} is not supported")
        self.bytes = kind == "ByteLevel"
        tokens = {i: t for t, i in tokenizer.get_vocab(with_added_tokens=True).items()}
        if self.bytes:
            kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
            symbol = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in {*kept})}
            special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
            whole = lambda t: t in special or any(c not in symbol for c in t)
            self.tokens = {i: t.encode() if whole(t) else bytes(symbol[c] for c in t) for i, t in tokens.items()}
        else:
            self.tokens = tokens

    def decode(self, ids: bytes) -> str:
        import numpy as np

        try:
            found = [*map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())]
        except KeyError:
            found = [self.tokens[i] for i in np.frombuffer(ids, "<u4").tolist() if i in self.tokens]
        return b"".join(found).decode("utf-8", "replace") if self.bytes else " ".join(found)


_DECODERS: dict[str, Decoder] = {}


def _chunks(batches, column: str) -> Iterator:
    """(doc_ids, values) of some rows, by the size of the values."""
    for batch in batches:
        docs, values = batch.column("doc_id").to_pylist(), batch.column(column)
        a = size = 0
        for b in range(len(docs)):
            size += len(values[b].as_buffer() or b"")
            if size > CHARS or b == len(docs) - 1:
                yield docs[a : b + 1], values.slice(a, b + 1 - a).to_pylist()
                a, size = b + 1, 0


def _encode(batches, path: str) -> Iterator:
    """(doc_id, ids) batches of (doc_id, text) batches."""
    import pyarrow as pa

    for ids, texts in _chunks(batches, "text"):
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(trie_encoder(path).encode(texts), pa.binary())], names=["doc_id", "ids"])


def _decode(batches, path: str) -> Iterator:
    """(doc_id, ids, text) batches of (doc_id, ids) batches."""
    import pyarrow as pa

    if path not in _DECODERS:
        _DECODERS[path] = Decoder(path)
    for docs, ids in _chunks(batches, "ids"):
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ids, pa.binary()), pa.array([*map(_DECODERS[path].decode, ids)], pa.string())], names=["doc_id", "ids", "text"])


def encode_texts(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """(doc_id, ids) of (doc_id, text): the ids of each whole text, packed as little-endian unsigned 32-bit integers.

    decoded: also text, what the ids decode to, in the same pass. The ids are those of the tokenizers library without special
    tokens added; strings of the file's special tokens in a text are those tokens, as there. Null and empty texts have no ids.
    Null and repeated doc_ids stay, a row for a row; other columns are not read; an empty table gives an empty one. A text is
    encoded in one task, a few million characters of texts at a time.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    if decoded:
        return rows.mapInArrow(lambda batches: _decode(_encode(batches, path), path), "doc_id long, ids binary, text string")
    return rows.mapInArrow(lambda batches: _encode(batches, path), "doc_id long, ids binary")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text) of (doc_id, ids): the texts that the tokenizers library decodes ids to, special tokens included.

    Null ids are empty, unknown ones are left out; null and repeated doc_ids stay; other columns are not read.
    """
    ship(encoded.sparkSession)
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("ids", F.lit(b"")).alias("ids"))
    return rows.mapInArrow(lambda batches: _decode(batches, path), "doc_id long, ids binary, text string")


def op12_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("word_bpe_49k.json")
    out = encode_texts(table(spark, sf_dir, "documents"), path, decoded=True)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
