import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabloom.llm import chat, jaccard, lm, mixing, packing, pii, quality, repeats, sstable, vectors
from tabloom.llm.common import scratch
from tabloom.llm.shingles import shingle_sets
from tabloom.llm.tokens import Encoder, vocabulary

SF = "/root/testdata/sf0.001"
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 2
TEXTS = [
    None, "", " \n\t", "a", "a b c", "Same text here " * 5, "Same text here " * 5, BASE, BASE + "extra", BASE.upper(),
    "line\nline\nother\nline", "# * $ % & | < > plain", "mail me: ab.c@ex.org, or 10.0.0.1 and 300.1.1.1", "card 4111 1111 1111 1111 tel +1 (415) 555-2671.",
    "é" * 30 + " ünï codé x@y.de " + "é" * 500, ("x" * 450 + " ") * 2, "1.2.3.4.5.6.7.8 +12 a@b a@b.c.d", "w " * 3000,
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if i % 3 else None, "s", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_quality_counts(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int")
    for r in quality.apply_rules(docs, labels).collect():
        t = TEXTS[r.doc_id] or ""
        w = words(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(grams)
        covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if words(x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed)
        assert not (r.kept and failed)
    assert quality.apply_rules(empty, labels).count() == 0
    assert quality.filter_documents(docs, labels).columns == docs.columns


def test_binomial_bound_is_exact():
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    p = quality.upper_bound(3, 50, 0.1)
    assert sum(math.comb(50, i) * p**i * (1 - p) ** (50 - i) for i in range(4)) == pytest.approx(0.1, abs=1e-9)
    assert quality.upper_bound(5, 5, 0.1) == 1.0


def rule_values(spark, good, spam=()):
    """(features, labels): good gives the documents of each language, spam the languages of labelled symbol spam."""
    rows = [(lang, 1, 0.0) for lang, n in good.items() for _ in range(n)] + [(lang, 0, 0.31) for lang in spam]
    rows = [(i, lang, q, x) for i, (lang, q, x) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, quality int, symbol_share double")
    feats = df.select("doc_id", "lang", "symbol_share", *[F.lit(0.0).alias(r) for r in quality.RULES if r != "symbol_share"], F.lit(False).alias("base_failed"))
    return feats, df.select("doc_id", "quality")


def test_pooled_strata_get_the_pooled_cutoffs(spark):
    feats, labels = rule_values(spark, {f"l{i:02}": 4000 if i < 32 else 600 for i in range(40)})
    cutoffs = quality.calibrate(feats, labels)
    assert cutoffs[""]["symbol_share"] <= 0.3 and "l39" not in cutoffs
    spam = spark.createDataFrame([("l00",), ("l39",), ("new",), ("",), (None,)], "lang string").select("lang", F.lit(0.31).alias("symbol_share"), *[F.lit(0.0).alias(r) for r in quality.RULES if r != "symbol_share"])
    assert spam.where(quality.verdict(cutoffs)).count() == 0


def test_planted_symbol_spam_is_rejected(spark):
    """As on sf0.1: too few good documents for a quarter of alpha for each rule, or for es alone."""
    feats, labels = rule_values(spark, {"en": 2027, "fr": 498, "de": 493, "es": 312}, ["en", "fr", "de", "es"] * 20)
    report = quality.certificates(feats, labels)
    assert all(c["cutoffs"]["symbol_share"] == 0.05 and c["rejected"] == 0 and c["bound"] <= 0.01 for c in report)
    assert sum(c["good"] for c in report) == 3330 and sum(c["delta"] for c in report) == pytest.approx(0.05)
    kept = feats.where(quality.verdict({c["stratum"]: c["cutoffs"] for c in report}))
    assert kept.where("symbol_share > 0").count() == 0 and kept.count() == 3330


def test_symbol_spam_of_the_tables_is_rejected(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    labelled = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id", "quality"), "doc_id")
    out = quality.features(labelled).drop("text").cache()
    judged = out.where("not base_failed").withColumn("kept", quality.verdict(quality.calibrate(out, labels)))
    share = lambda where: judged.where(where).agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert share("quality = 0 and symbol_share >= 0.15") == 0
    assert share("quality = 1") >= 0.99


def test_sequence_goes_on_after_a_failure():
    by = {(0, 0, 0, 0): 98_000, (0, 1, 0, 0): 2_000}
    cutoffs, rejected, bound = quality._certify(by, [1, 0, 2, 3], 0.01, 0.05)
    assert "symbol_share" not in cutoffs and set(cutoffs) == {"upper_share", "repeat_share", "bang_share"}
    assert rejected == 0 and bound <= 0.01
    assert quality._certify({(0, 0, 0, 0): 200}, [1, 0, 2, 3], 0.01, 0.05) == ({}, 0, None)


def base_spans(t):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def ok(k, v):
        d = [int(c) for c in v if c.isdigit()]
        luhn = sum(x if i % 2 == 0 else (2 * x - 9 * (x > 4)) for i, x in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[k]

    return sorted((m.start(), pii.KINDS.index(k), m.end()) for k, p in plain.items() for m in re.finditer(p, t or "") if ok(k, m[0]))


def test_pii_base_spans_and_mask(docs, empty):
    for r in pii.find_pii(docs).collect():
        assert [(s.start, s.kind, s.end) for s in r.base] == base_spans(TEXTS[r.doc_id])
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}
    masked = {r.doc_id: r.text for r in pii.mask_pii(docs).collect()}
    assert masked[0] is None and "[EMAIL]" in masked[12] and "ab.c@" not in masked[12] and "[CARD]" in masked[13] and masked[7] == TEXTS[7]
    assert pii.find_pii(empty).count() == 0


def test_jaccard_components(docs, empty):
    sets = []
    for t in TEXTS:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(t)]
        sets.append(frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else []))
    root = list(range(len(TEXTS)))
    for _ in TEXTS:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}
    assert jaccard.jaccard_components(empty).count() == 0


def brute_components(texts, size, percent):
    """Smallest index reachable over links, by all pairs."""
    sets = []
    for t in texts:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(t)]
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sets, [find(i) for i in range(len(texts))]


def crowded(rng, n=80):
    """Texts that share a passage, with chains of near copies among them and near copies of one text."""
    common, base = [f"c{i}" for i in range(60)], [f"b{i}" for i in range(80)]
    texts = []
    for i in range(n):
        own = [f"w{x}" for x in rng.integers(0, 10**9, 6 if i % 2 else 40)]
        texts.append(" ".join(common + own))
    for i in range(n // 2):
        t = list(base)
        for j in rng.integers(0, 80, i % 6):
            t[j] = f"v{rng.integers(0, 9)}"
        texts.append(" ".join(t))
    for i in range(0, n, 5):
        t = texts[i].split()
        t[int(rng.integers(0, len(t)))] = "changed"
        texts.append(" ".join(t))
    return texts


@pytest.mark.parametrize(("size", "percent", "small"), [(5, 80, 64), (4, 85, 3)])
def test_jaccard_crowded_regions(spark, monkeypatch, size, percent, small):
    """Small limits send every cell through the recursion: pivots, rings, runs, blocks."""
    if small < 64:
        monkeypatch.setattr(jaccard, "PIVOTS", 2)
        monkeypatch.setattr(jaccard, "BLOCK", 6)
        monkeypatch.setattr(jaccard, "BLOCKED", 25)
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "LARGEST", 4 * small)
    monkeypatch.setattr(jaccard, "RUN", 20)
    texts = crowded(np.random.default_rng(3))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets, root = brute_components(texts, size, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, size, percent).collect()}
    assert got == {i: (len(s), root[i]) for i, s in enumerate(sets)}


def test_jaccard_repeated_and_missing_ids(spark):
    t = "a b c d e f g h"
    rows = [(1, t), (1, t), (1, t + " x y z u v w"), (None, t), (None, t), (2, None), (2, None), (3, ""), (None, None), (4, t.upper()), (5, "q " * 9)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, row int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()), key=str)
    assert got == sorted([(1, 5, 1), (1, 5, 1), (1, 11, 1), (None, 5, 1), (None, 5, 1), (2, 0, 2), (2, 0, 2), (3, 0, 3), (None, 0, None), (4, 5, 1), (5, 1, 5)], key=str)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, t), (1, t + " x y z u v w"), (2, None), (2, None), (3, ""), (None, None), (5, "q " * 9)], key=str)


def test_repeated_bytes(docs, empty):
    data, length = [(t or "").encode() for t in TEXTS], 120
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    for r in repeats.repeated_bytes(docs, length).collect():
        b = data[r.doc_id]
        cover = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                cover[i] += 1
                cover[i + length] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), gone.sum(), (np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert bytes(r.kept) == bytes(np.frombuffer(b, np.uint8)[~gone])
    assert repeats.repeated_bytes(empty, length).count() == 0


@pytest.mark.parametrize("length", [120, 160, 400])
def test_repeated_bytes_of_crowded_anchors(spark, monkeypatch, length):
    """Every anchor with two differing runs counts as crowded; near copies, a common line in unlike texts, and plain copies."""
    monkeypatch.setattr(repeats, "GROUP", 1)
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    base, line = [word() for _ in range(300)], " ".join(word() for _ in range(22))
    texts = []
    for i in range(30):
        near = list(base)
        for at in rng.integers(0, 300, i % 4):
            near[at] = word()
        texts.append(" ".join(near[rng.integers(0, 40) :]))
    texts += [" ".join([*(word() for _ in range(40)), line, *(word() for _ in range(i))]) for i in range(25)]
    texts += [texts[3], texts[40], line + line, "é" * length, ""]
    data = [t.encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    for r in repeats.repeated_bytes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), length).collect():
        b = data[r.doc_id]
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        assert r.n_removed == gone.sum() and bytes(r.kept) == bytes(np.frombuffer(b, np.uint8)[~gone])


def test_vectors_find_links_and_skip_bad_ones(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(base)]
    rows += [(100 + i, (v + 0.05 * rng.normal(size=16)).tolist(), i % 3) for i, v in enumerate(base[:30])]
    rows += [(200, base[0].tolist(), 0), (201, base[0].tolist(), 1), (300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] + [1.0] * 15, 0), (303, base[0].tolist(), None), (304, [None] + [1.0] * 15, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    good = {r[0]: (np.array(r[1]), r[2]) for r in rows if r[0] < 300}
    near = {a: [b for b in good if b != a and good[a][1] == good[b][1] and good[a][0] @ good[b][0] / np.linalg.norm(good[a][0]) / np.linalg.norm(good[b][0]) >= 0.93] for a in good}
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    found = sum(got[a].n_links for a in good)
    assert len(got) == len(rows) and all(got[a].n_links <= len(near[a]) for a in good)
    assert found >= 0.9 * sum(map(len, near.values()))
    assert got[200].component_id == 0 and all(got[i].n_links == 0 and got[i].kept for i in range(300, 305))


def plain_ids(name, texts):
    """What the library gives for whole texts with the file as it is."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


HARD = ["a  b", " a   b", "\x1c!\x1c! a", "it's 'S", "a\n\n b.!? c.", "a <|endoftext|> b", "<|startoftext|>x", "<|ENDOFTEXT|>", "Á Σσ. 12.5,", "x.\ny!\nz", "tail ", "\n", "ø ø a ♥", "word, " * 50 + "\t."]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_tokenizer(name):
    e = Encoder(vocabulary(name), limit=50)
    assert not e.whole
    hard = [t or "" for t in TEXTS] + HARD
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(hard)] == plain_ids(name, hard)


def test_encoder_takes_whole_texts_where_a_file_does_not_cut_at_blanks(tmp_path):
    from tokenizers import Tokenizer, models, normalizers

    t = Tokenizer(models.BPE(vocab={"a": 0, " ": 1, "b": 2, "a b": 3, "a ": 4}, merges=[("a", " "), ("a ", "b")]))
    t.normalizer = normalizers.NFC()
    t.save(str(tmp_path / "t.json"))
    e = Encoder(str(tmp_path / "t.json"))
    assert e.whole and np.frombuffer(e.encode(["a b"])[0], "<u4").tolist() == [3]


def test_shards_round_trip(spark, docs, empty):
    path = scratch(spark, "sst")
    shards = sstable.write_shards(docs, path, vocabulary("word_bpe_49k.json"), 2, splits=3)
    want = {i: np.array([*x, 2], "<u4").tobytes() for i, x in enumerate(plain_ids("word_bpe_49k.json", TEXTS))}
    assert {r.doc_id: bytes(r.ids) for r in sstable.read_shards(spark, path).collect()} == want
    assert shards.agg(F.sum("docs")).first()[0] == len(TEXTS)
    assert sstable.write_shards(empty, scratch(spark, "sst"), vocabulary("word_bpe_49k.json"), 2).count() == 0


def test_shards_refuse_missing_keys_and_wide_ids(spark, tmp_path):
    from pyspark.errors import PySparkException

    df = spark.createDataFrame([(None, "a"), (1, "b")], "doc_id long, text string")
    with pytest.raises(PySparkException, match="doc_id"):
        sstable.write_shards(df, scratch(spark, "sst"), vocabulary("word_bpe_49k.json"), 2)
    w = sstable.ShardWriter(2)
    with pytest.raises(ValueError, match="70000"):
        w.add(1, np.array([70000], "<u4").tobytes())
    w = sstable.ShardWriter(4)
    w.add(1, np.array([70000], "<u4").tobytes())
    assert sstable.ShardReader(w.bytes()).get(1)[0].tolist() == [70000]


def test_shard_lookup():
    w = sstable.ShardWriter()
    keys = [-5, 0, 0, *range(10, 40000, 3)]
    for k in keys:
        w.add(k, np.array([k % 100 + 100, 2], "<u4").tobytes())
    r = sstable.ShardReader(w.bytes())
    assert len(r.blocks) > 2 and len(r.get(0)) == 2 and r.get(11) == [] and r.get(13)[0].tolist() == [113, 2] and r.get(-5)[0].tolist() == [195, 2]


@pytest.mark.parametrize("n", [1, 5, 511, 512, 513, 1023, 1024, 1025, 5000])
def test_cuts_cover_a_document(n):
    pieces = packing.cut(n, 1024)
    assert sum(x for x, _ in pieces) == n and all(0 < x <= 1024 // j for x, j in pieces)


def test_packing(spark, docs, empty):
    rows = packing.pack(docs.unionByName(docs.where("doc_id = 7")), vocabulary("byte_bpe_50k.json"), 0).collect()
    ids = {i: np.array([*x, 0], "<u4").tobytes() for i, x in enumerate(plain_ids("byte_bpe_50k.json", TEXTS))}
    seqs, count = {}, Counter()
    for r in rows:
        assert bytes(r.ids) == ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)] and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        count[r.doc_id] += r.length
    assert count == {i: len(x) // 4 * (2 if i == 7 else 1) for i, x in ids.items()}
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
    assert packing.pack(empty, vocabulary("byte_bpe_50k.json"), 0).count() == 0


def test_chat_round_trip(spark):
    hard = r"\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", hard), (-7, 1, "assistant", hard), (1, 2, "assistant", "b:c"), (1, 0, "user", None), (1, 3, "user", "tail"), (2, 0, None, "x"), (2, 0, None, "x"), (None, 0, "user", "lost")]
    ex = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    turns = {-7: [("user", hard), ("assistant", hard)], 1: [("user", ""), ("assistant", "b:c"), ("user", "tail")], 2: [("", "x"), ("", "x")]}
    for r in ex.collect():
        assert chat.parse(r.text) == turns[r.conv_id][: r.n_turns]
    for r in chat.digests(ex).collect():
        t = turns[r.conv_id]
        loss = "".join(x for role, x in t if role == "assistant")
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(t), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_language_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: (r.text or "").encode().lower().split() + [None] for r in docs.collect()}
    out = zlib.crc32
    train = Counter(w for d, ws in texts.items() if out(str(d).encode()) % 10 for w in ws)
    n, v = sum(train.values()), len(train)
    for r in lm.score_documents(docs).collect():
        ws = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(str(r.doc_id).encode()) % 10 == 0, len(ws), sum(train[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert r.score < 0


def test_class_probabilities_sum_to_one():
    w = np.random.default_rng(0).normal(size=(lm.FEATURES * lm.BUCKETS + 1, lm.CLASSES))
    h, c, s = lm.tokens(["a b c", ""])
    assert len(h) == 5 and s.tolist() == [0, 4, 5]
    assert np.exp(lm.class_log_probs(w, lm.histories(h, s))).sum(axis=1) == pytest.approx(np.ones(5))


def test_buckets_grow_with_the_words(spark):
    sizes = [lm.buckets_for(v) for v in (0, 1, 262_144, 262_145, 10**8, 10**10)]
    assert sizes == [4096, 4096, 4096, 8192, 131_072, 1_048_576]
    h, c, s = lm.tokens(["to be or not to be", "to be"] * 20)
    for buckets in (lm.BUCKETS, 1 << 17):
        w = np.zeros((lm.FEATURES * buckets + 1, lm.CLASSES), np.float32)
        f = lm.histories(h, s, buckets)
        assert all((f[:, k] // buckets == k).all() for k in range(lm.FEATURES))
        before = lm.log_prob_of(w, f, c).sum()
        for _ in range(20):
            lm.descend(w, h, c, s, 1.0)
        assert lm.log_prob_of(w, f, c).sum() > before / 2
    docs = spark.createDataFrame([(1, "to be or not to be")] * 3, "doc_id long, text string")
    assert lm.train(docs, buckets=1 << 13, chars=54).shape == (lm.FEATURES * (1 << 13) + 1, lm.CLASSES)


def test_mixture_meets_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = mixing.mixture(docs, spark.read.parquet(f"{SF}/labels.parquet"), {"good": 0.9, "low": 0.1}).cache()
    token = lambda k: out.agg(F.sum(F.col("rate") * F.col("n_tokens") * F.get("posterior", F.lit(k)))).first()[0]
    sums = [token(k) for k in range(3)]
    assert out.count() == docs.count() and out.where("rate < 0 or copies < 0").count() == 0
    assert sums[0] / sum(sums) == pytest.approx(0.9, abs=0.05)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert mixing.mixture(docs.limit(5), none).where("rate > 0").count() == 5


def test_small_domains_reach_their_targets(spark):
    """Toxic has 2 % of the tokens, low 10 %; posteriors are soft and certain in turn."""
    rows = [(1000, [0.0, 0.02, 0.98] if i % 100 < 2 else [0.03, 0.97, 0.0] if i % 100 < 12 else [0.99, 0.01, 0.0] if i % 2 else [1.0, 0.0, 0.0]) for i in range(2000)]
    weighed = spark.createDataFrame(rows, "n_tokens long, posterior array<double>").cache()
    rate, seen = mixing.fit_rates(weighed, mixing.TARGETS)
    total = 2_000_000
    token = lambda k, r: weighed.agg(F.sum(r * F.col("n_tokens") * F.get("posterior", F.lit(k)))).first()[0] / total
    size = token(0, F.lit(1.0)) / 0.96
    for k, name in enumerate(mixing.DOMAINS):
        residual = token(k, rate) - mixing.TARGETS[name] * size
        assert abs(residual) < 5e-4 and residual == pytest.approx(seen[-1][name], abs=1e-9), name


def test_missed_targets_are_told(spark):
    docs = spark.createDataFrame([(i, "a b c") for i in range(5)], "doc_id long, text string")
    none, missed = spark.createDataFrame([], "doc_id long, quality int, toxic int"), {}
    with pytest.warns(UserWarning, match="misses its targets"):
        mixing.mixture(docs, none, residuals=missed)
    assert missed["low"] == pytest.approx(-0.04 / 0.96)


CLASH = ["_t", "_w", "n_words", "spans", "base", "_features", "_words", "_spans", "_found", "_row", "_text", "_copies", "kept", "rate", "label", "text_hash", "key", "row"]


@pytest.fixture(scope="module")
def edge(spark):
    """Null and repeated ids and rows, null, empty and very long texts, ties, and columns with the names that operators use inside."""
    long = "word and more words, 12 of 345; " * 60_000
    rows = [(None, "A lonely row without an id has ten words in it here."), (None, None), (1, "Same text here, twice, with enough words to pass the rule."), (1, "Same text here, twice, with enough words to pass the rule."), (1, "Other text under one id, mail a.b@c.org or +49 170 1234567 now please."), (2, None), (3, ""), (4, long), (5, long + "x"), (6, "é" * 500), (7, " \n\t ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    return df.select("*", *[F.lit(f"mine {c}").alias(c) for c in CLASH])


def test_stages_keep_clashing_columns_and_rows_without_ids(spark, edge):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    stages = [lambda d: quality.filter_documents(d, labels), lambda d: jaccard.keep_one(d, 5, 80), pii.mask_pii, lambda d: mixing.mix(d, labels)]
    for stage in stages:
        out = stage(edge)
        assert out.columns == edge.columns
        rows = out.collect()
        assert rows and all(r[c] == f"mine {c}" for r in rows for c in CLASH)
        assert any(r.doc_id is None and (r.text or "").startswith("A lonely") for r in rows)
        assert stage(edge.limit(0)).count() == 0
    masked = {r.text for r in pii.mask_pii(edge).collect() if r.doc_id == 1}
    assert any("[EMAIL] or [PHONE] now" in t for t in masked)


def test_operators_take_the_edge_table(spark, edge):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    n = edge.count()
    for out in (mixing.mixture(edge, labels), quality.apply_rules(edge, labels), pii.find_pii(edge), repeats.repeated_bytes(edge), jaccard.jaccard_components(edge), lm.score_documents(edge)):
        assert out.count() == n
    pieces = packing.pack(edge, vocabulary("byte_bpe_50k.json"), 0, with_ids=False)
    assert pieces.select("doc_id", "row").distinct().count() == n
    for op in (lambda d: mixing.mixture(d, labels), lm.score_documents, repeats.repeated_bytes):
        assert op(edge.limit(0)).count() == 0


def test_repeats_with_missing_and_repeated_ids(spark):
    t = "abcdefghij" * 50
    rows = [(None, t), (None, "x" + t), (1, t + "y"), (1, "short"), (1, "short"), (2, None)]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in repeats.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([("None", 500, 500), ("None", 501, 500), ("1", 501, 500), ("1", 5, 0), ("1", 5, 0), ("2", 0, 0)])


def test_vectors_with_missing_and_repeated_ids(spark):
    v, w = [1.0, 0.0, 0.5], [0.0, 1.0, 0.0]
    rows = [(None, v, 0), (5, v, 0), (5, v, 0), (3, w, 0), (None, w, 0), (None, None, 0)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()), key=str)
    assert got == sorted([(None, 2, 5, False), (5, 2, 5, True), (5, 2, 5, False), (3, 1, 3, True), (None, 1, 3, False), (None, 0, None, True)], key=str)
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_chat_null_turns_come_first(spark):
    rows = [(1, -9, "user", "second"), (1, None, "user", "first"), (1, 0, "assistant", "third")]
    ex = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [x for _, x in chat.parse(ex[-1].text)] == ["first", "second", "third"]
    assert chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
