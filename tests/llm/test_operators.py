"""Every operator against brute force, an exact round trip or held-out accuracy, and with odd inputs."""

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from trialframe.llm import (
    bit_mixing, byte_bpe, chat_format, hnsw, html_text, language_id, line_dedup, near_copies, quality_rules, queries, simhash,
    source_mixing,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, doc string, kept int, `key` int, ids int, `n_tokens` string, component int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n)) + "."


def rows_of(texts, langs=("en", "de")):
    return [(i, t, langs[i % len(langs)], f"s{i % 3}", len(t or ""), "x", 1, 2, 3, "t", 4) for i, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, very long, repeated and tied rows, and columns whose names the operators use inside."""
    rng = random.Random(1)
    one = "\n".join(prose(rng, 30) for _ in range(3))
    texts = [(0, one), (0, one), (1, None), (2, ""), (3, " \n\t\n "), (4, one + " more"), (5, prose(rng, 30000)), (6, "#" * 50000), (None, one),
             (7, "a"), (8, one), (9, "\n".join([prose(rng, 60)] * 4)), (10, "é　ß \x1c日本 \U0001f600 " * 30)]
    data = rows_of([(i or 0, t) for i, t in texts])
    data = [(i, *r[1:]) for (i, _), r in zip(texts, data, strict=True)]
    data.append((None, None, None, None, None, None, None, None, None, None, None))
    return spark.createDataFrame(data, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# --- 6 -----------------------------------------------------------------------------------------------------------


def figures(t):
    w = words(t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {k for i, g in enumerate(grams) if n[g] > 1 for k in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), failed


def test_quality_figures(spark, odd):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) + rng.choice(["", "\n", "\na b\na b"]) for _ in range(200)]
    df = spark.createDataFrame(rows_of(list(enumerate(texts))), DOCS).unionAll(odd)
    for r in quality_rules.judged(df).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert got == figures(r.doc.text)


def test_quality_verdict(spark, odd, empty):
    good = "This is a plain sentence that ends as it should, with several words in it."
    nav = "Home | News | Sport | Weather | Shop | Contact"
    texts = [good + "\nAnother line follows here, and it is about quite different things.", good + "\n" + nav, nav + "\n" + nav + "x\n" + good.replace("This", "It"),
             good + "\nAll rights reserved.", "WORD!! " * 3 + "\n" + " ".join(f"w{i}!!" for i in range(30))]
    df = spark.createDataFrame(rows_of(list(enumerate(texts))), DOCS)
    kept = {r.doc_id: r.text for r in quality_rules.cleaned(df).collect()}
    assert kept[0] == texts[0] and kept[1] == good and kept[3] == good and 4 not in kept and 2 not in kept
    out = quality_rules.cleaned(odd)
    assert out.columns == odd.columns and all(r.n_chars == len(r.text) for r in out.collect() if r.text != "")
    assert quality_rules.cleaned(empty).collect() == []


def test_quality_wrapped_prose(spark):
    import textwrap
    rng = random.Random(13)
    names = "Anna Berlin saw the old house near a small river and Peter told him about Marie while they went home".split()
    says = lambda n: " ".join(rng.choice(names) + rng.choice(["", "s", "t", "n", "ly"]) for _ in range(n)) + "."
    plain = "\n\n".join(" ".join(says(17) for _ in range(6)) for _ in range(3))
    wrapped = "\n\n".join(textwrap.fill(x, 80) for x in plain.split("\n\n"))
    marks = ["\n".join(says(15)[:-1] + m for _ in range(5)) for m in "।؟۔"]
    heaps = "\n".join(says(15)[:-1].capitalize() + " x" * rng.randint(0, 90) for _ in range(8))
    df = spark.createDataFrame(rows_of(list(enumerate([wrapped, *marks, heaps]))), DOCS)
    assert {r.doc_id: r.text for r in quality_rules.cleaned(df).collect()} == dict(enumerate([wrapped, *marks]))
    assert not any(r.kept for r in quality_rules.judged(df).collect())


# --- 4 -----------------------------------------------------------------------------------------------------------


def deleted(texts, least):
    """Texts without the pieces in a run of worded pieces with `least` words or more whose equal stands earlier."""
    cut = {i: re.findall(line_dedup.PIECE, t) for i, t in texts.items()}
    assert all("".join(cut[i]) == t for i, t in texts.items())
    docs = {i: [(k, x.strip(line_dedup.BLANKS), len(words(x))) for k, x in enumerate(c) if words(x)] for i, c in cut.items()}
    seen, out = {}, {}
    for i in sorted(docs):
        for a in range(len(docs[i])):
            total = 0
            for b in range(a, len(docs[i])):
                total += docs[i][b][2]
                if total >= least:
                    key = tuple(x[1] for x in docs[i][a : b + 1])
                    if seen.setdefault(key, (i, a)) != (i, a):
                        out.setdefault(i, set()).update(range(docs[i][a][0], docs[i][b][0] + 1))
    return {i: "".join(x for k, x in enumerate(c) if k not in out.get(i, ())) for i, c in cut.items()}


@pytest.mark.parametrize("ends", [["\n"], ["\n", ". ", ", ", ".", "! \n", "\n\n", ".) "]])
def test_line_dedup_is_exact(spark, ends):
    rng = random.Random(3)
    pool = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 4))) for _ in range(7)]
    texts = {i: "".join(rng.choice(pool) + rng.choice(ends) for _ in range(rng.randint(1, 14))) for i in range(60)}
    df = spark.createDataFrame(rows_of(list(texts.items())), DOCS)
    got = {r.doc.doc_id: r.clean_text for r in line_dedup.deduplicated(df, min_words=6).collect()}
    assert got == deleted(texts, 6)


def test_line_dedup_inside_lines(spark):
    rng = random.Random(5)
    passage = " ".join(prose(rng, 12) for _ in range(5))
    own = [" ".join(prose(rng, 9) for _ in range(8)) for _ in range(4)]
    texts = [(0, passage), (1, f"{own[0]} {passage} {own[1]}"), (2, own[2]), (3, f"{own[3]} {passage}"), (4, f"{passage} {prose(rng, 9)}")]
    got = {r.doc.doc_id: (r.clean_text, r.n_removed) for r in line_dedup.deduplicated(spark.createDataFrame(rows_of(texts), DOCS)).collect()}
    assert got[0] == (passage, 0) and got[1] == (f"{own[0]} {own[1]}", 5) and got[2] == (own[2], 0)
    assert got[3] == (own[3] + " ", 5) and got[4][1] == 5
    assert {i: t for i, (t, _) in got.items()} == deleted(dict(texts), line_dedup.MIN_WORDS)


def test_line_dedup_cuts_as_its_pattern_says(spark):
    """The pattern for Java cuts every text as PIECE does, and words are counted as WORD says."""
    rng = random.Random(8)
    signs = "ab é日\n\t\r.,!?;:…।؟。！？，、；：()\"'”’»]\u00a0\u0100😀-/9<>@\x00\x0b"
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["aé日" * 100_000, "日a" * 200_000 + ".", ".…" * 200_000, ". " + "”)" * 200_000, "a" * 1_000_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).cache()
    found = df.select("i", line_dedup.pieces(F.col("t")).alias("p")).collect()
    assert all(r.p == re.findall(line_dedup.PIECE, texts[r.i]) for r in found)
    counted = df.select("i", F.transform(line_dedup.pieces(F.col("t")), lambda x: F.trim(x, F.lit(line_dedup.BLANKS))).alias("p"), (~F.col("t").rlike(r"[\x09\x0B-\x0D]")).alias("plain"))
    counted = counted.select("p", F.transform("p", lambda x: line_dedup._n_words(x, F.col("plain"))).alias("n"))
    assert all(r.n == [len(words(x)) for x in r.p] for r in counted.filter("i < 3000").collect())


def test_line_dedup_takes_on_only_documents_with_a_copied_window(spark):
    """A long piece that stands in many documents is no fingerprint by itself; each copied window is one."""
    common = "a b c d e f g h i. "
    texts = {i: f"x{i} y. {common}z{i} w{i}. " for i in range(5)} | {7: "k l m n o. p q r. s t", 8: "u v. k l m n o. p q r. s t"}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    rows = line_dedup._pieces(docs, "doc_id", "text", 10).select("key.id", "prints", "n_pieces").collect()
    prints = {r.id: set(r.prints) for r in rows}
    assert [(a, b) for a in prints for b in prints if a < b and prints[a] & prints[b]] == [(7, 8)]
    assert {r.id: len(r.prints) for r in rows} == {0: 2, 1: 2, 2: 2, 3: 2, 4: 2, 7: 1, 8: 2}
    assert {r.n_pieces for r in rows} == {3, 4}


def test_line_dedup_compares_only_windows_from_shared_places(spark):
    docs = spark.createDataFrame([(1, "a b. c d. e. f g h. i. j k. l m.")], "doc_id long, text string")
    rows = line_dedup._pieces(docs, "doc_id", "text", 4).select("key", "pieces")
    windows = lambda *starts: sorted((r["from"], r["to"]) for r in line_dedup._windows(
        rows.withColumn("starts", F.array(*[F.lit(x) for x in starts])), 4).collect())
    assert windows(2) == [(2, 3)]
    assert windows(1, 3) == [(1, 3), (3, 4), (3, 5)]
    assert windows(*range(6)) == [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (3, 5), (4, 6), (5, 6)]


def test_line_dedup_odd(odd, empty):
    got = line_dedup.deduplicated(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r.doc.doc_id, []).append(r)
    assert [r.n_removed for r in by[0]] == [3, 3] and by[8][0].clean_text == "" and by[1][0].clean_text is None
    assert by[9][0].n_removed == 3 and by[2][0].clean_text == "" and by[3][0].clean_text == " \n\t\n "
    assert line_dedup.cleaned(odd).columns == odd.columns
    assert line_dedup.cleaned(empty).collect() == []


# --- 10 ----------------------------------------------------------------------------------------------------------


def classes_of(texts):
    def fp(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(len(w) - 2, 1))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {i: fp(t) for i, t in texts}
    parent = {i: i for i in fps}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= 3 and top(a) != top(b):
                parent[max(top(a), top(b))] = min(top(a), top(b))
    return {i: (fps[i], top(i)) for i in ids}


@pytest.mark.parametrize("tree", [simhash.TREE, 4])
def test_simhash_classes(spark, tree, monkeypatch):
    rng = random.Random(4)
    texts = [prose(rng, rng.randint(0, 60)) for _ in range(60)]
    long = prose(rng, 900).split()
    for _ in range(60):
        copy = list(long)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = rng.choice(WORDS)
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    monkeypatch.setattr(simhash.links, "__defaults__", (3, tree))
    df = spark.createDataFrame(rows_of(list(enumerate(texts))), DOCS)
    got = {r.id: (r.fp & (2**64 - 1), r.component) for r in simhash.classes(df).collect()}
    assert got == classes_of(list(enumerate(texts)))


def test_simhash_odd(odd, empty):
    found = simhash.classes(odd).collect()
    assert len(found) == odd.count()
    by = {r.id: r.component for r in found}
    assert by[0] == by[8] == 0 and by[1] == by[2] == by[3] == 1 and by[None] is None
    out = simhash.deduplicated(odd)
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == odd.columns and sorted(i for i in ids if i is not None) == sorted({c for i, c in by.items() if i is not None})
    assert ids.count(None) == 2
    assert simhash.classes(empty).collect() == [] and simhash.deduplicated(empty).collect() == []


def test_near_copies_are_exact(spark, odd, empty, monkeypatch):
    rng = random.Random(12)
    texts = []
    for _ in range(25):
        w = [f"w{rng.randint(0, 999)}" for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 6)):
            texts.append(" ".join(w))
            w = list(w)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "edited"
    texts = dict(enumerate(rng.sample(texts, len(texts))))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts.items()}
    root = {i: i for i in texts}
    for i in texts:
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    df = spark.createDataFrame(rows_of(list(texts.items())), DOCS)
    assert {r.id: r.component for r in near_copies.classes(df).collect()} == root
    monkeypatch.setattr(near_copies, "PART", 3)
    for rounds in (0, 1):  # all or most links by the comparison inside tasks
        monkeypatch.setattr(near_copies, "ROUNDS", rounds)
        assert {r.id: r.component for r in near_copies.classes(df).collect()} == root
    stage = dict(corpus_pipeline.STAGES)["near duplicates"]
    assert {r.doc_id for r in stage(spark, df, "").collect()} == set(root.values())
    assert {r.doc_id for r in simhash.deduplicated(df).collect()} != set(root.values())
    got = near_copies.deduplicated(odd)
    assert got.columns == odd.columns and {r.doc_id for r in got.collect()} == {None, 0, 1, 5, 6, 7, 9, 10}
    assert near_copies.deduplicated(empty).collect() == []


def test_near_copies_take_the_links_of_the_fingerprints(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(40):
        w = [f"w{rng.randint(0, 999)}" for _ in range(400)]
        texts.append(" ".join(w))
        for k in rng.sample(range(400), rng.choice([1, 1, 30])):
            w[k] = "edited"
        texts.append(" ".join(w))
    texts.append("z " * 300 + texts[0])
    df = spark.createDataFrame(rows_of(list(enumerate(texts))), DOCS)
    signed = near_copies._signed(df, "doc_id", "text").collect()
    assert all(r.fp % 2**64 == simhash.fingerprint(texts[r.id], near_copies.SHINGLE) for r in signed)
    want = set()
    for a in signed:
        for b in signed:
            x, y = set(near_copies.shingles(texts[a.id])), set(near_copies.shingles(texts[b.id]))
            if a.h < b.h and ((a.fp ^ b.fp) % 2**64).bit_count() <= simhash.RADIUS and len(x & y) >= 0.8 * len(x | y):
                want.add((a.h, b.h))
    nodes = spark.createDataFrame([(r.h, r.fp) for r in signed], "node long, fp long")
    pairs, found = near_copies._by_fingerprint(df, "text", nodes)
    assert want and {tuple(r) for r in found.collect()} == want <= {tuple(r) for r in pairs.collect()}


# --- 3 -----------------------------------------------------------------------------------------------------------


def copies(rate, doc_id, text, seed=source_mixing.SEED):
    steps = max(math.ceil(rate / source_mixing.STEP), 1)
    own = hashlib.md5(text.encode()).hexdigest()
    n = 0
    for j in range(1, steps + 1):
        u = int(hashlib.md5(f"{seed}:{doc_id}:{own}:{j}".encode()).hexdigest()[:12], 16) / 2**48
        p = total = math.exp(-rate / steps)
        k = 0
        while total <= u:
            k += 1
            p *= rate / steps / k
            total += p
        n += k
    return n


@pytest.mark.parametrize("broadcast", [source_mixing.BROADCAST, 0])
def test_mixing_counts(spark, broadcast, monkeypatch):
    monkeypatch.setattr(source_mixing, "BROADCAST", broadcast)
    rows = [(i, f"t{i}", "en", "big" if i % 10 else ("small" if i else None), 2, "x", 1, 2, 3, "t", 4) for i in range(3000)]
    df = spark.createDataFrame(rows, DOCS)
    weights = {"big": 0.2, "small": 0.8}
    got = Counter(r.doc_id for r in source_mixing.replicated(df, weights=weights).collect())
    n = Counter(r[3] for r in rows)
    rate = {s: weights.get(s, 0.0) * 3000 / n[s] for s in n}
    assert got == Counter({r[0]: c for r in rows if (c := copies(rate[r[3]], r[0], r[1]))})
    share = sum(c for i, c in got.items() if i % 10) / sum(got.values())
    assert abs(share - 0.2) < 0.03 and abs(sum(got.values()) - 3000) < 300


def test_mixing_large_mean_and_odd(spark, odd, empty):
    df = spark.createDataFrame(rows_of([(1, "a")]), DOCS)
    assert source_mixing.replicated(df, epochs=500.0).count() == copies(500.0, 1, "a")
    out = source_mixing.replicated(odd, epochs=3.0)
    assert out.columns == odd.columns and out.count() > 0
    assert source_mixing.replicated(empty).collect() == []


@pytest.mark.parametrize("seed", [17, 20, 23])
def test_mixing_without_ids(spark, seed):
    df = spark.createDataFrame([(None, f"t{i}", "en", "s", 2, "x", 1, 2, 3, "t", 4) for i in range(4000)], DOCS)
    rows = source_mixing.mixed(df, seed=seed).select("doc.text", "copy", F.spark_partition_id().alias("p")).collect()
    assert abs(len(rows) - 4000) < 300 and len({(r.text, r.copy) for r in rows}) == len(rows)
    assert Counter(r.copy for r in rows)[0] == len({r.text for r in rows}) < 2800
    assert max(Counter(r.p for r in rows).values()) < 2 * len(rows) / len({r.p for r in rows})


def test_mixing_is_shuffled(spark):
    df = spark.createDataFrame(rows_of([(i, "a") for i in range(400)]), DOCS)
    ids = [r.doc.doc_id for r in source_mixing.mixed(df).collect()]
    assert ids != sorted(ids)


# --- 9 -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    path = public_tokenizers.path(corpus_pipeline.VOCABULARY)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("block", [byte_bpe.BLOCK, 40])
def test_bpe_equals_library(vocabulary, block, monkeypatch):
    monkeypatch.setattr(byte_bpe, "BLOCK", block)
    path, library = vocabulary
    rng = random.Random(5)
    texts = ["", "a" * 3000, "ab" * 2000, "  \n\n x", "I'm you'LL we'd", "日本語" * 200, "<|endoftext|>"]
    texts += ["".join(rng.choice(" \n\t'ab stréñ12.,!?　日\x1c\x85\U0001f600") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    codec = byte_bpe.codec(path, public_tokenizers.PATTERN)
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids == library.encode_ordinary(t) and codec.decode(ids) == t.encode()


def test_bpe_tables(vocabulary, odd, empty):
    path, library = vocabulary
    args = (path, public_tokenizers.PATTERN)
    for r in byte_bpe.digests(odd.withColumnRenamed("n_tokens", "other"), *args).unionAll(byte_bpe.digests(empty, *args)).collect():
        assert r.n_tokens >= 0
    want = sorted((r.doc_id or -1, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect())
    assert sorted((r.doc_id or -1, r.decoded_sha256) for r in byte_bpe.digests(odd, *args).collect()) == want
    back = byte_bpe.decoded(byte_bpe.encoded(odd, *args), *args)
    assert all(bytes(r.decoded) == (r.text or "").encode() and r.ids == library.encode_ordinary(r.text or "") for r in back.collect())


# --- 5 -----------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(6)
    bits = ["\\", "<turn>", "</turn>", "</turn>\n", "<part>", "\\l", "\n", "<", "### Assistant:", "x", "é", "\\n", ""]
    rows = []
    for c in range(60):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "a<turn>\nb\\", ""]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 6))), 1))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    done = chat_format.format_conversations(df)
    got = done.select("conv_id", chat_format.parsed(F.col("formatted")).alias("t"), chat_format.trained_text(F.col("segments")).alias("loss"), "formatted", "segments")
    for r in got.collect():
        want = [(x[2], x[3]) for x in rows if x[0] == r.conv_id]
        assert [tuple(x) for x in r.t] == want
        assert r.loss == "".join(t for role, t in want if role == "assistant")
        assert r.formatted == "".join(s.text for s in r.segments)


def test_chat_odd(spark):
    kind = "conv_id long, turn long, role string, text string"
    rows = [(1, 2, None, None), (1, None, "user", "early"), (1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (None, 1, "assistant", "z")]
    got = {r.conv_id: [tuple(x) for x in r.t] for r in chat_format.format_conversations(spark.createDataFrame(rows, kind)).select(
        "conv_id", chat_format.parsed(F.col("formatted")).alias("t")).collect()}
    assert got[None] == [("assistant", "z")]
    assert got[1] == [("user", "early"), ("user", "a"), ("user", "a"), ("user", "b"), ("", "")]
    assert chat_format.format_conversations(spark.createDataFrame([], kind)).collect() == []


# --- 1 -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("html", "text"), [
    ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("a<br>b", "a\nb"), ("x &lt; y&nbsp;&amp; z", "x < y & z"),
    ("<ul><li>a<li>b<ol><li>c</ol></ul>", "- a\n- b\n  1. c"),
    ("<table><tr><th>N<th>Long<tr><td>aaa<td>1</table>", "N   | Long\naaa | 1"),
    ("<div>a<div hidden>b</div><p style='display: none'>c</p><script>d<p></script>e</div>", "ae"),
    ("<head><title>t</title><style>p{}</style></head><body>a", "a"), ("<pre>a\n  b</pre>", "a\n  b"),
    ("<b>a <i>b</b> c</i>", "a b c"), ("a < b", "a < b"), ("<a href='x>y'>l</a>", "l"), ("a<!-- b -->c", "ac"), ("a<!-- b", "a"),
    ("<details><summary>s</summary>h</details>", "s"), ("<td>a</p>b", "a\n\nb"), ("</div>a</td>", "a"), ("  a \n  b  ", "a b"),
])
def test_html(html, text):
    assert html_text.visible_text(html) == text


@pytest.mark.parametrize("quote", ['"', "'"])
def test_html_long_values(quote):
    long = "x" * 5000
    assert html_text.visible_text(f"a<div data-props={quote}{long}<b>leak</b>{quote} hidden>secret</div>b") == "ab"
    assert html_text.visible_text(f"<p title = {quote}{long}>{quote}>shown</p>") == "shown"
    assert html_text.visible_text(f"<p title={quote}open>shown</p>{long}") == "shown\n\n" + long
    assert html_text.visible_text("<p it's>a<p>it's b") == "a\n\nit's b"


@pytest.mark.parametrize(("html", "text"), [
    ("a <math><mi>x</mi><mo>=</mo><mn>2</mn></math> b", "a x=2 b"),
    ("<math><semantics><mi>x</mi><annotation encoding='t'>\\x</annotation><annotation-xml>y</annotation-xml></semantics></math>", "x"),
    ("<svg><g><text>Sales</text><path d='M0'/><text>2024</text></g></svg>", "Sales 2024"),
    ("<svg><title>t</title><text>a</text></svg>b", "a b"), ("<svg><desc>d</desc><text>a</text></svg>", "a"),
    ("<svg><defs><text>d</text></defs><text>a</text></svg>", "a"), ("<svg><metadata>m</metadata><text>a</text></svg>", "a"),
    ("<svg><defs/><text>a</text></svg>", "a"), ("<svg viewBox='0 0 1 1'/>after", "after"), ("<svg>loose<path></svg>after", "after"),
    ("<svg><text>a</text><p>b</p>", "a\n\nb"), ("<svg><foreignObject><p>in</p></foreignObject></svg>", "in"),
    ("<desc>d</desc><text>t</text>", "dt"), ("<svg hidden><text>a</text></svg>b", "b"),
])
def test_html_formulas_and_drawings(html, text):
    assert html_text.visible_text(html) == text


@pytest.mark.parametrize(("html", "text"), [
    ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A | B\n  | C"),
    ("<table><tr><td rowspan=0>A<td>B<tr><td>C<tbody><tr><td>D<td>E</table>", "A | B\n  | C\nD | E"),
    ("<table><tr><td rowspan=2>A<br>a<td>B<tr><td>C</table>", "A | B\na | C"),
    ("<table><tr><td rowspan=2>1<br>2<br>3<td>B<tr><td>C</table>", "1 | B\n2 | C\n3"),
    ("<table><tr><td>x<td rowspan=2>y<tr><td colspan=2>w</table>", "x | y\n  |   | w"),
    ("<table><tr><td colspan=2>wide head<tr><td>a<td>b<td>c</table>", "wide head\na | b     | c"),
    ("<table><tr><td>a|<td>||<td> <tr><td>b</table>", "a| | ||\nb"), ("<table><tr><td><td>b</table>", " | b"),
    ("<table><tr><td>\u4e2d\u6587<td>x<tr><td>abcd<td>y</table>", "\u4e2d\u6587 | x\nabcd | y"),
    ("<table><tr><td>e\u0301<td>x<tr><td>a<td>y</table>", "e\u0301 | x\na | y"),
    ("<table><tr><td><table><tr><td>p<td>q<tr><td>rr</table><td>z</table>", "p  | q | z\nrr"),
    ("<div style='visibility:hidden'>a<b style='visibility: visible'>b</b>c<br>d</div>e", "b\ne"),
    ("<p style='visibility:hidden;visibility:visible'>a", "a"), ("<p style='content-visibility:hidden'>a", "a"),
    ("<p style='display:none;display:block'>a", "a"), ("<p style='display:block;DISPLAY:None'>a</p>b", "b"),
    ("<ol><li value=5>a<li>b</ol>", "5. a\n6. b"), ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"),
    ("<ol start=7 reversed><li>a<li>b</ol>", "7. a\n6. b"), ("<ol><li value=x>a<li>b</ol>", "1. a\n2. b"),
    ("<select><option>a<option selected>b<option>c</select>", "b"), ("<select><option>a<option>b</select>", "a"),
])
def test_html_spans_visibility_and_numbers(html, text):
    assert html_text.visible_text(html) == text


def test_html_grid_matches_a_plain_one():
    """Every cell of random tables stands at the place that a plain grid of taken slots gives it."""
    rng = random.Random(5)
    for _ in range(200):
        rows = [[(f"w{rng.randrange(10 ** rng.randint(1, 8))}x{k}y{c}", rng.randint(1, 3), rng.randint(1, 4)) for c in range(rng.randint(1, 4))]
                for k in range(rng.randint(1, 6))]
        html = "<table>" + "".join("<tr>" + "".join(f"<td colspan={w} rowspan={h}>{t}" for t, w, h in row) for row in rows) + "</table>"
        taken, column = set(), {}
        for k, row in enumerate(rows):
            at = 0
            for t, w, h in row:
                while any((k, at + x) in taken for x in range(w)):
                    at += 1
                column[t] = at
                taken |= {(k + y, at + x) for x in range(w) for y in range(h)}
                at += w
        lines = html_text.visible_text(html).split("\n")
        assert [[x.strip() for x in line.split("|") if x.strip()] for line in lines] == [[t for t, _, _ in row] for row in rows]
        places = {}
        for line, row in zip(lines, rows, strict=True):
            for t, _, _ in row:
                places.setdefault(column[t], set()).add(line.index(t))
        assert all(len(x) == 1 for x in places.values())
        assert sorted(places) == [c for c, _ in sorted(places.items(), key=lambda x: min(x[1]))]


@pytest.mark.parametrize("html", [
    "<a " * 300_000, "<a " * 300_000 + '="' + ">" + '"', '<a b="' * 150_000, '<a b="' * 150_001 + ">", '<a b=">"' * 120_000, "</x" * 300_000,
    "<!x" * 300_000, "<select>" + "<option>o" * 100_000, "<ul><li>a" * 100_000, "<table><tr><td>" * 30_000 + "x" * 500_000,
    "<table>" + "<tr><td rowspan=65534>a" * 40_000, "<table><tr><td>" + "x" * 500_000 + "<tr><td>a<td>b" * 30_000,
    "<table>" + "<tr>" * 500 + "<td colspan=1000 rowspan=9>a" * 30_000, "<x" + "y" * 1_000_000, "a " + "<a href='" * 100_000,
])
def test_html_megabytes(html):
    """Time and output stay in proportion to the page."""
    start = time.process_time()
    assert len(html_text.visible_text(html)) <= 20 * len(html) + (1 << 17)
    assert time.process_time() - start < 20


def test_html_pages(spark):
    rows = [(1, "u", "<p>a</p>", "t"), (1, "u", "<p>a</p>", "t"), (2, None, None, None), (3, "u", "<div>" * 20000 + "x", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r.page_id, r.text) for r in html_text.extracted(df).collect()) == [(1, "a"), (1, "a"), (2, ""), (3, "x")]
    assert html_text.extracted(df.limit(0)).collect() == []


# --- 7 -----------------------------------------------------------------------------------------------------------


def spoken(rng, lang, n):
    parts = {"en": ["th", "ing", "er", "wh"], "de": ["sch", "ung", "ei", "tz"], "fr": ["eau", "é", "oi", "que"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)) + "."


def test_language(spark, odd, empty):
    rng = random.Random(7)
    rows = [(i, spoken(rng, lang, rng.randint(20, 200)), lang, "s", 1, "x", 1, 2, 3, "t", 4) for i, lang in enumerate(["en", "de", "fr"] * 80)]
    df = spark.createDataFrame(rows, DOCS)
    net = language_id.train(language_id.sample(df.filter("doc_id % 4 != 0")))
    got = language_id.predicted(df, net, keep=("doc_id", "lang")).filter("doc_id % 4 = 0").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) and all(0 <= r.score <= 1 for r in got)
    more = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predicted(odd, net).collect()}
    assert more[1] == more[2] == more[3] == more[6] == ("und", 0.0) and more[0][0] in ("en", "de", "fr")
    nothing = language_id.train(language_id.sample(empty))
    assert nothing is None and {r.lang_pred for r in language_id.predicted(odd, nothing).collect()} == {"und"}
    assert language_id.predicted(empty, net).collect() == []


# --- 8 -----------------------------------------------------------------------------------------------------------


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(hnsw.index, "__defaults__", (300,))
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 24)) * rng.uniform(0.5, 2, size=(900, 1))
    x[100:140] = x[100]
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]
    rows += [(2000, None, 0), (2001, [0.0] * 24, 0), (2020, [float("nan")] * 24, 0), (2040, [1.0, None], 0), (2060, [1.0, 2.0], 0), (2061, [2.0, 2.0], 0), rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in hnsw.nearest(df, df.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    x = x.astype(np.float32).astype(float)
    good = 0
    for q in range(0, 900, 20):
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(900), -s)).tolist() if i != q][:20]
        mine = [got[q][k][0] for k in range(1, 21)]
        assert all(abs(s[i] - got[q][k + 1][1]) < 1e-9 for k, i in enumerate(mine))
        good += len(set(mine) & set(order))
    assert good >= 0.9 * 45 * 20
    assert set(got) == set(range(0, 900, 20)) | {2060} and got[2060] == {1: (2061, 6.0)}
    assert hnsw.nearest(df.limit(0), df.limit(0)).collect() == []


# --- 2 -----------------------------------------------------------------------------------------------------------


def test_scores(spark, odd, empty):
    rng = random.Random(9)
    texts = [(i, prose(rng, rng.randint(0, 80))) for i in range(150)]
    df = spark.createDataFrame(rows_of(texts), DOCS).unionAll(odd.withColumn("doc_id", F.col("doc_id") + 1000))
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = bit_mixing.scores(df, held).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    counts = Counter()
    for r in df.collect():
        if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            counts.update(tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    want = sorted((r.doc_id or -1, len(tokens(r.text)), sum(counts[w] > 0 for w in tokens(r.text)),
                   round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(r.text)), 5)) for r in df.collect())
    assert sorted((r.id or -1, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 and r.bits_per_byte > 0 for r in got)
    assert bit_mixing.scores(empty, held).collect() == []


def test_topics_are_learned_from_training_texts(spark, monkeypatch):
    seen = []
    follow = bit_mixing._following
    monkeypatch.setattr(bit_mixing, "_following", lambda docs, text: seen.extend(docs.collect()) or follow(docs, text))
    df = spark.createDataFrame(rows_of([(i, "a b c") for i in range(30)]), DOCS)
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    assert len(bit_mixing.scores(df, held).collect()) == 30
    assert {r.id for r in seen} == {i for i in range(30) if zlib.crc32(str(i).encode()) % 7 != 2}


def test_scores_are_probabilities(spark):
    """Over all bytes that can follow, the probabilities of a decision path add up to one."""
    pairs = spark.createDataFrame([(bytearray(w.encode()), 1, 3, 3) for w in WORDS], "token binary, topic int, n long, c long")
    model = bit_mixing.fit(pairs)
    total = sum(0.5 ** int(k) for k in model.tree.length)
    assert total == pytest.approx(1)
    import pyarrow as pa
    seen = 10 ** model.scores(pa.array([w.encode() for w in WORDS], pa.binary()), np.ones(len(WORDS), int))
    unseen = 10 ** model.scores(pa.array([b"qqqq", b"zyx"], pa.binary()), np.ones(2, int))
    assert seen.sum() < 1 and seen.min() > unseen.max()
    nothing = bit_mixing.fit(pairs.limit(0))
    assert np.isfinite(nothing.scores(pa.array([b"a"], pa.binary()), np.ones(1, int))).all()


# --- pipeline ------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, odd, empty):
    for start in (odd, empty):
        docs = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, "")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == odd.columns
                docs = out
        assert out.columns[0] == "doc_id"
        out.collect()


def test_pipeline_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert got and {r.doc_id for r in got} <= set(docs)
    stages = dict(corpus_pipeline.STAGES)
    kept = {r.doc_id for r in stages["quality rules"](spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "").collect()}
    assert all(i in kept or figures(t)[5] or len(t) for i, t in docs.items()) and kept


def test_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLE) <= set(queries.QUERIES)
