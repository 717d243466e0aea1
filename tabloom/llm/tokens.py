"""Encoding whole texts with a public tokenizer file, many words at a time, inside Spark tasks."""

from __future__ import annotations

import gc
import os
import re
from collections.abc import Callable, Iterable
from functools import wraps

#: Unicode White_Space (fixed values): what the tokenizers' patterns call \\s.
WHITE = "\t-\r \x85\xa0  -     　"
_LOADED: dict[str, Encoder] = {}
#: Bytes of words and ids, with ENTRY for each, that an encoder remembers of parts of words; of whole words twice as much.
LIMIT, ENTRY = 90_000_000, 240


#: Texts on which a file must give the same ids by words as by whole texts, or else it is used on whole texts only.
PROBES = [
    "Plain words, and more; it's John's, we'll (see) 12.5% of #7 -- A/B? yes! \"quoted.\" e.g. x.y.z.", "a  b", " a   b", "tail ", "\ttab\n\nlines\r\n x\x0b\x0cy", "!.. ?! .,", "don't 'S 's", "é ünï Straße ΑΣ. ﬁ",
    "x\u00a0y\u2003z\u3000w.", "日本語 テキスト。 русский текст, слово.", "🙂🙂 a🙂.", "e\u0301 a\u0308. \u0301x", "\x1c!\x1d a\x1e\x85b", "A" * 40 + "! " + "0123456789" * 4, "", " ", "\n",
]
#: Words that may part others in one text to encode, if they have an id of their own.
SEPARATORS = ["\n", "Ж", "中", "ß", "ø", "♥"]


def _byte_symbols() -> dict[str, int]:
    """The byte of each symbol of byte-level files."""
    from tokenizers.pre_tokenizers import ByteLevel

    cut = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    out = {s: b for code in [*range(128), *range(128, 2048, 32), *range(128, 192)] for s, b in zip(cut(chr(code))[0][0], chr(code).encode(), strict=True)}
    return out | dict(zip(sorted({*ByteLevel.alphabet()} - {*out}), sorted({*range(256)} - {*out.values()}), strict=True))


class Quick:
    """A merger without offsets for the parts of byte-level BPE files that are cut in a known way: all of lower characters, on whose
    kinds older and newer tables agree, or, in files that fold case, words of letters only. Raises ValueError for other files.

    A file with a mark at word ends has it as a line end here: its merge with a word's last byte comes before all others.
    """

    def __init__(self, tokenizer):
        import json

        import numpy as np
        import tiktoken

        file = json.loads(tokenizer.to_str())
        model, cutter, suffix = file["model"], file["pre_tokenizer"] or {}, file["model"].get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
            raise ValueError("not a plain BPE file")
        self.folds = bool(suffix)
        letters = "".join(c for c in map(chr, range(256)) if c.isalpha() and c == c.lower())
        if self.folds:
            steps = [n["type"] for n in (file["normalizer"] or {}).get("normalizers", [])]
            if steps != ["NFC", "Replace", "Lowercase"] or len(tokenizer.pre_tokenizer.pre_tokenize_str(letters)) != 1:
                raise ValueError("words of letters are not words of the file")
        elif file["normalizer"] or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
            raise ValueError("not a plain byte-level file")
        symbols, ids = _byte_symbols(), model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        spelled = {c: bytes([b]) for c, b in symbols.items()}
        order = [*spelled] if not suffix else [*spelled, *[c + suffix for c in spelled]]
        spelled |= {c + suffix: b + b"\n" for c, b in spelled.items()} if suffix else {}
        for x, y in merges:
            spelled[x + y] = spelled[x] + spelled[y]
            order.append(x + y)
        ranks = {spelled[t]: i for i, t in enumerate(order)}
        if len(ranks) < len(order):
            raise ValueError("a token has two merges")
        #: By rank: the file's id, and whether a line ends there.
        self.ids = np.array([ids[t] for t in order], "<u4")
        self.ends = np.array([spelled[t].endswith(b"\n") for t in order])
        pattern = r"[^\n]*\n" if suffix else r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.encode = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def takes(self, part: str) -> bool:
        if self.folds:
            return part.isalpha() and (part.isascii() or max(part) < "\u0100")
        return "\n" not in part and not part[-1].isspace() and (part.isascii() or max(part) < "\u0250")

    def lines(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that it takes."""
        import numpy as np

        text = "\n".join(parts) + "\n"
        found = self.encode(text.lower() if self.folds else text)
        ends = np.flatnonzero(self.ends[found]) + 1
        data, cuts = self.ids[found].tobytes(), (4 * ends).tolist()
        starts = [0, *cuts[:-1]]
        return [data[a:b] for a, b in zip(starts, cuts if self.folds else [c - 4 for c in cuts], strict=True)]


def _uncollected(work: Callable) -> Callable:
    """work without searches for cycles: it makes none, and each search would go through its many small lists."""

    @wraps(work)
    def run(*args):
        if not gc.isenabled():
            return work(*args)
        gc.disable()
        try:
            return work(*args)
        finally:
            gc.enable()

    return run


class Encoder:
    """Ids of a text as packed little-endian unsigned 32-bit integers: those that tokenizer.encode gives for the whole text.

    The usual files cut a text before every run of white space that follows another character, and never merge across such a
    cut, so a text is the sequence of its words' ids. Words repeat: each is encoded once per worker and remembered, up to
    ``limit`` bytes of parts of words, and twice as much of words, at a time. A mark of ``MARKS`` after an ASCII letter at the end of a word is cut off too. Whether a file does
    so is tried on PROBES; texts that hold one of its added tokens, and all texts of other files, are encoded whole.
    """

    MARKS = ".,!?"

    def __init__(self, path: str, limit: int = LIMIT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: For parts of words: a word that becomes an added token by lower-casing is none.
        self.inner = Tokenizer.from_file(path)
        self.inner.encode_special_tokens = True
        self.largest_id = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        #: Lower-casing files drop white space too: then words need neither case nor the blank before them.
        self.folds = "Lowercase" in repr(self.tokenizer.normalizer)
        self.words = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        self.blanks = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c))
        #: In texts with none of these, every blank stands by itself before a word.
        self.odd = ["  ", "\t", "\n ", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", *[c for c in self.blanks if c > "~"]]
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.limit, self.known_bytes, self.parts_bytes = limit, 0, 0
        #: Words that are encoded at once.
        self.batch = 4096
        self.between, self.line = self._separator()
        try:
            self.quick = Quick(self.tokenizer)
        except (ValueError, KeyError):
            self.quick = None
        self.whole = any(t.normalized or not t.special for t in added)
        self.whole = self.whole or self.encode(PROBES) != [self._directly(t) for t in PROBES]

    def _directly(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _separator(self) -> tuple[str, int | None]:
        """A word with an id of its own between others; then many words are encoded as one text."""
        for c in SEPARATORS:
            alone = self.inner.encode(c, add_special_tokens=False).ids
            between = f" {c} " if self.folds else c
            ids = self.inner.encode(between.join(["ab.", "cd", "ef" if self.folds else " ef"]), add_special_tokens=False).ids
            if len(alone) == 1 and ids.count(alone[0]) == 2:
                return between, alone[0]
        return "", None

    def _split(self, word: str) -> list[str]:
        """A word, as cut out of a text, as the parts that are encoded by themselves."""
        out = []
        for w in self.words(word):
            if self.folds:
                w = w.strip(self.blanks)
                w = w.lower() if w.isascii() else w
            if len(w) > 1 and w[-1] in self.MARKS and w[-2].isascii() and w[-2].isalpha():
                out += [w[:-1], w[-1]]
            elif w:
                out.append(w)
        return out

    def _remember(self, parts: list[str]) -> None:
        """Encodes parts and keeps their ids."""
        import numpy as np

        if self.quick:
            usual = [p for p in parts if self.quick.takes(p)]
            found = self.quick.lines(usual) if usual else []
            if len(found) == len(usual):
                self.parts.update(zip(usual, found, strict=True))
                done = {*usual}
                parts = [p for p in parts if p not in done]
        mark = self.between.strip(" ") or self.between
        lines = [p for p in parts if mark not in p] if self.line is not None else []
        if lines:
            ids = np.array(self.inner.encode_batch_fast([self.between.join(lines)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * np.flatnonzero(ids == self.line)).tolist()
            if len(cuts) == len(lines) - 1:
                data = ids.tobytes()
                self.parts.update(zip(lines, [data[a:b] for a, b in zip([0, *[c + 4 for c in cuts]], [*cuts, len(data)], strict=True)], strict=True))
                parts = [p for p in parts if mark in p]
        for p, e in zip(parts, self.inner.encode_batch_fast(parts, add_special_tokens=False), strict=True):
            self.parts[p] = np.array(e.ids, "<u4").tobytes()

    def _learn(self, words: set[str], plain: bool) -> None:
        """plain: white space in words is one blank in front, or line ends; none in files that fold."""
        if self.parts_bytes > self.limit:
            self.parts.clear()
            self.parts_bytes = 0
        split, cut, alone = [], [], []
        if plain:
            marks = self.MARKS
            lined = [] if self.folds else [w for w in words if "\n" in w or w == " "]
            words = words.difference(lined) if lined else words
            split = [(w, self._split(w)) for w in lined]
            folded = [(w, w.lower() if w.isascii() else w) for w in words] if self.folds else zip(words, words, strict=True)
            for x in folded:
                p = x[1]
                (cut if p[-1] in marks and len(p) > 1 and p[-2].isascii() and p[-2].isalpha() else alone).append(x)
            new = {p[:-1] for _, p in cut}
            new.update([p[-1] for _, p in cut])
            new.update([p for _, p in alone])
            new.update([p for _, x in split for p in x])
        else:
            split = [(w, self._split(w)) for w in words]
            new = {p for _, x in split for p in x}
        parts, known = self.parts, self.known
        new = [*new.difference(parts)]
        for at in range(0, len(new), self.batch):
            self._remember(new[at : at + self.batch])
        self.parts_bytes += ENTRY * len(new) + sum(map(len, new)) + sum([len(parts[p]) for p in new])
        known.update([(w, parts[p]) for w, p in alone])
        known.update([(w, parts[p[:-1]] + parts[p[-1]]) for w, p in cut])
        known.update([(w, parts[x[0]] if len(x) == 1 else b"".join([parts[p] for p in x])) for w, x in split])

    @_uncollected
    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """Ids of each text; null is empty."""
        texts = [t or "" for t in texts]
        out: list = [None] * len(texts)
        split, plain = {}, {}
        for i, text in enumerate(texts):
            if self.whole or any(a in text for a in self.added):
                out[i] = self._directly(text)
            elif any(c in text for c in (self.odd[:10] if text.isascii() else self.odd)):
                split[i] = self.words(text)
            elif self.folds:
                plain[i] = text.split()
            elif text:
                first, *rest = text.split(" ")
                plain[i] = [first, *[f" {w}" for w in rest]] if first else [f" {w}" for w in rest]
            else:
                out[i] = b""
        for lists, easy in ((plain, True), (split, False)):
            seen = set().union(*lists.values())
            new = seen.difference(self.known)
            if new and self.known_bytes > 2 * self.limit:
                self.known.clear()
                self.known_bytes, new = 0, seen
            if new:
                self._learn(new, easy)
                self.known_bytes += ENTRY * len(new) + sum(map(len, new)) + sum([len(self.known[w]) for w in new])
            for i, words in lists.items():
                out[i] = b"".join([*map(self.known.__getitem__, words)])
        return out


def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def vocabulary(name: str) -> str:
    """The place of a public tokenizer file; operators take any path instead."""
    import public_tokenizers

    return public_tokenizers.path(name)
