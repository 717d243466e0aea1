"""Operators 11 to 13 against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from tabloom.llm import bpe, runs, variants
from tabloom.llm.bpe import Decoder, TrieEncoder
from tabloom.llm.tokens import PROBES, vocabulary

SF = "/root/testdata/sf0.001"


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q):
                found.setdefault((i, length), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def by_start(found):
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(5)
    texts = [[], [b"a"], [b"a"] * 6, [b"a"] * 400, [b"a", b"b"] * 150 + [b"c"] + [b"b", b"a"] * 9]
    for _ in range(800):
        text = []
        while len(text) < rng.randrange(1, 90):
            unit = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(1, 7))]
            text += unit * rng.randrange(1, 7)
        texts.append(text)
    for _ in range(30):
        unit = [b"%d" % rng.randrange(9) for _ in range(rng.randrange(1, 60))]
        texts.append([b"x"] * rng.randrange(9) + unit * 7 + unit[: rng.randrange(len(unit))] + [b"y"])
    got = runs.find_runs(texts)
    assert [runs.find_runs([t])[0] for t in texts] == got
    for t, g in zip(texts, got, strict=True):
        assert g == by_start(brute_runs(t)), t


def test_many_left_words_within_reach():
    rng = random.Random(6)
    text = []
    for k in range(300):
        text += [b"%d" % k] + [b"very"] * rng.randrange(3, 9)
    assert runs.find_runs([text])[0] == by_start(brute_runs(text))


def brute_op13(doc, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = by_start(brute_runs(w))
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc, len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op13_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text or "") < 12_000}
    got = {r[0]: tuple(r) for r in runs.op13_periodic_runs(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for doc, text in texts.items():
        assert got[doc] == brute_op13(doc, text)


def test_runs_take_the_edge_table(spark):
    rows = [(None, None), (None, "a a a a a a"), (1, ""), (1, "a a a a a a"), (1, "a a a a a a"), (2, "x " * 30_000), (3, " \t\n")]
    docs = spark.createDataFrame([(a, b, 7, "z") for a, b in rows], "doc_id long, text string, runs int, collapsed string")
    got = [(r.doc_id, r.n_words, r.collapsed, [tuple(x) for x in r.runs]) for r in runs.periodic_runs(docs).collect()]
    six = [(0, 6, 1)]
    want = [(None, 0, "", []), (None, 6, "a", six), (1, 0, "", []), (1, 6, "a", six), (1, 6, "a", six), (2, 30_000, "x", [(0, 30_000, 1)]), (3, 0, "", [])]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute_variants(n, ratio=10):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] is not None else None, root))
    return sorted(out)


@pytest.mark.parametrize("letters", ["ab", "abcdeé", "abcdefghijklmnopqrstuvwxyzéüß"])
def test_variants_equal_brute_force(spark, letters):
    rng = random.Random(len(letters))
    n = {}
    for _ in range(150):
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 9)))
        n[w] = rng.choice([1, 2, 30, 500, 60_000])
        for _ in range(3):
            i = rng.randrange(len(w) + 1)
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :], w + "漢🙂"])
            n.setdefault(v, rng.choice([1, 3, 40]))
    df = spark.createDataFrame([(w, k, "x") for w, k in n.items()] + [(None, 5, "x")], "word string, n int, h string")
    got = variants.group_variants(df).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted(map(tuple, got), key=lambda t: t[0]) == brute_variants(n)
    assert variants.group_variants(df.limit(0)).count() == 0


def test_neighbourhoods_are_full():
    for size, words in ((2, ["a", "ab", "babab"]), (5, ["abcde", "aaaaa"]), (3, ["", "c"])):
        letters = [chr(97 + k) for k in range(size)]
        for w in words:
            full = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
            hashes = {int(variants._hashes(variants._values([x]))[0]) for x in full}
            own = int(variants._hashes(variants._values([w]))[0])
            got = [(int(a), int(b)) for x, y in variants.neighbourhoods([w], size) for a, b in zip(x, y, strict=True)]
            assert len(got) == len(set(got)) and set(got) == {(own, h) for h in hashes if h >= own}


def test_op11_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    n = Counter()
    for r in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{r.doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    got = sorted(map(tuple, variants.op11_spelling_variants(spark, SF).select("word", "n", "n_near", "form", "form_n", "root").collect()))
    assert got == brute_variants(n)


def test_words_of_the_edge_table(spark):
    rows = [(None, None), (None, "Letters éa×b abcdefg"), (1, ""), (1, "abcdefG abcdefg1abcdefg"), (1, "abcdefG abcdefg1abcdefg"), (2, "longword " * 30_000)]
    docs = spark.createDataFrame([(a, b, "q", 3) for a, b in rows], "doc_id long, text string, word string, n int")
    assert {tuple(r) for r in variants.count_words(docs).collect()} == {("letters", 1), ("abcdefg", 7), ("longword", 30_000)}
    assert {tuple(r) for r in variants.count_words(docs, least_length=4).collect()} == {("letters", 1), ("abcdefg", 7), ("longword", 30_000), ("éa×b", 1)}
    assert variants.count_words(docs.limit(0), typos=31).count() == 0


@pytest.mark.parametrize("file", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_trie_encoder_equals_the_library(file):
    from tokenizers import Tokenizer

    path = vocabulary(file)
    whole, rng = Tokenizer.from_file(path), random.Random(7)
    alphabets = ["ab", "aeiourstln", "é ü ß a's ", "ABC abc 'll 've 's 12 ", "日本 語🙂 é ", "!?.,-- \t\n", "".join(map(chr, range(1, 400)))]
    texts = ["", "a", "aaaaaaaaaaaaaaaaaaaa", "lolololololo banana", "x" * 700, "<|endoftext|>", "a <|endoftext|>b<|startoftext|> <|ENDOFTEXT|>", "</w> a</w>b", *PROBES]
    texts += ["".join(rng.choice(a) for _ in range(rng.randrange(1, 60))) for a in alphabets for _ in range(300)]
    texts += [r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    texts += [" ".join(w for w, _ in rng.sample(sorted(whole.get_vocab().items()), 40)) for _ in range(100)]
    got, back = TrieEncoder(path).encode(texts), Decoder(path)
    for text, ids in zip(texts, got, strict=True):
        want = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert back.decode(ids) == whole.decode(want, skip_special_tokens=False)
    again = TrieEncoder(path, limit=50)
    assert again.encode(texts[:1500]) == got[:1500]


def test_op12_query(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op12_trie_bpe(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        ids = whole.encode(text, add_special_tokens=False).ids
        assert got[doc] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_bpe_takes_the_edge_table(spark):
    path = vocabulary("word_bpe_49k.json")
    rows = [(None, None), (None, "one two"), (1, ""), (1, " \n"), (1, "one two"), (1, "one two"), (2, "word " * 30_000 + "y" * 50_000)]
    docs = spark.createDataFrame([(a, b, 1, "q") for a, b in rows], "doc_id long, text string, ids int, n_tokens string")
    out = bpe.decode_ids(bpe.encode_texts(docs, path), path).collect()
    assert sorted(bpe.encode_texts(docs, path, decoded=True).collect(), key=str) == sorted(out, key=str)
    assert sorted([(r.doc_id, r.text) for r in out if len(r.text) < 99], key=str) == sorted([(None, ""), (None, "one</w> two</w>"), (1, ""), (1, ""), (1, "one</w> two</w>"), (1, "one</w> two</w>")], key=str)
    assert max(len(r.text) for r in out) > 150_000
    assert bpe.encode_texts(docs.limit(0), path).count() == 0


def test_runs_of_letters_are_not_cut_by_the_library(monkeypatch):
    """Words of ASCII letters are words of the file as they are, and cycles are searched for again afterwards."""
    import gc

    enc, asked = TrieEncoder(vocabulary("word_bpe_49k.json")), []
    words = enc._words
    monkeypatch.setattr(enc, "_words", lambda text: asked.append(text) or words(text))
    texts = ["Plain words zyxqvwk tHe end", "x" * 70 + " don't 12ab"]
    got = enc.encode(texts)
    assert got == [enc._directly(t) for t in texts] == [np.array(enc.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert asked and not any("zyxqvwk" in a for a in asked[:1]) and gc.isenabled()
