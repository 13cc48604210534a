"""Spelling variants, token files and phrases against brute force, with odd inputs."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trialframe.llm import phrases, queries, spelling, token_files

DOCS = "doc_id long, text string, lang string, word string, n int, `key` int, shard string, phrase string, name string"
VOCABULARY = public_tokenizers.path(queries.TOKENIZER)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, 2, "s", "p", "q") for i, t, lang in rows], DOCS)


def lowered(text):
    return (text or "").encode().lower().decode()


# --- 11 ----------------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows, slip=spelling.SLIP):
    n = Counter()
    for i, text, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", lowered(text)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % slip == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: sorted([x for x in n if one_edit(w, x)], key=lambda x: (-n[x], x)) for w in n}
    form = {w: x[0] if x and n[x[0]] >= 5 * n[w] else None for w, x in near.items()}
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n.get(form[w]))
    return out


def found_variants(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


@pytest.mark.parametrize("letters", ["ab", "abé", "abcdefghÿ×"])
def test_sorted_scan_finds_all_pairs(letters):
    rng = random.Random(len(letters))
    for _ in range(60):
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(70)})
        assert set(spelling.neighbours(words)) == {(i, j) for i, j in itertools.combinations(range(len(words)), 2) if one_edit(words[i], words[j])}


def test_variants_against_brute_force(spark, monkeypatch):
    """Chains of forms, ties, slips, letters beyond ASCII, null and repeated rows; with groups that are cut again and again."""
    rng = random.Random(7)
    base = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 9))) for _ in range(40)] + ["gleichung", "gleichüng", "Straßen", "ÀÉÎÕÜ×÷"]
    rows = []
    for i in range(60):
        words = []
        for w in rng.choices(base, [3 ** (k % 7) for k in range(len(base))], k=60):
            if rng.random() < 0.2:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "a", "q" + w[k]]) + w[k + 1 :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, " ".join(words), "en"))
    rows += [(None, rows[0][1], None), (3, rows[3][1], "en"), (70, None, "en"), (71, "", None), (72, "1 2 3 _ \n", "de"), (73, "gleichung " * 30000, "de")]
    rows += [(80 + k, ("z" * 3000 + "y " + "z" * 3000 + " ") * (3 if k else 20), "en") for k in range(3)]
    want = plain_variants(rows, 7)
    assert sum(1 for x in want.values() if x[0]) > 20 and any(want[x[0]][0] for x in want.values() if x[0])
    docs = frame(spark, rows)
    assert found_variants(spelling.variants(spelling.written(spelling.counts(docs, slip=7)))) == want
    monkeypatch.setattr(spelling, "GROUP", 3)
    assert found_variants(spelling.variants(spelling.written(spelling.counts(docs, slip=7)))) == want


def test_variants_of_nothing(spark):
    assert found_variants(spelling.grouped(frame(spark, []))) == {}
    assert found_variants(spelling.grouped(frame(spark, [(None, None, None), (1, "short words", "en")]))) == {}


# --- 12 ----------------------------------------------------------------------------------------------------------

ODD = ["a", "word", "Zß", "é", " ", "  ", "\n", "\n\n", "\t", "'s", "'", "n't", ".", ",", "-", "(", '"', "12", "日本", "́", "\x1c", "\x85", " ", "　", "😀", "×", "_", "\r\n"]


def test_units_equal_the_library():
    rng = random.Random(3)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["x" * 5000, " " * 3000]
    units = token_files.units(VOCABULARY)
    for text, raw in zip(texts, units.encode(texts), strict=True):
        assert np.frombuffer(raw, units.kind).tolist() == units.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_perfect_hash_is_minimal_and_knows_strangers():
    names = [f"={k}" for k in range(5000)]
    h = token_files._hashed(names)
    made = token_files.PerfectHash.of(h)
    assert sorted(made.slots(h).tolist()) == list(range(5000))
    assert made.slots(token_files._hashed([])).tolist() == [] and token_files.PerfectHash.of(token_files._hashed([])).levels == []
    assert sum(len(x) for x in made.levels) * 8 < 5000 * 6


def test_files_hold_every_document(spark, tmp_path, monkeypatch):
    """Several shards and buckets, null and repeated keys, null, empty and long texts: order, places, ids and lookups."""
    rng = random.Random(5)
    rows = [(i * 7, " ".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))), "en") for i in range(300)]
    rows += [(None, "no key", "en"), (None, None, None), (14, "again", "en"), (14, "again", "en"), (21, None, "en"), (-5, "", "en"), (9999, "long text " * 20000, "en")]
    rows += [(700, "hot", "en")] * 200
    monkeypatch.setattr(token_files, "SHARD", 20000)
    monkeypatch.setattr(token_files, "BUCKET", 64)
    folder = str(tmp_path / "files")
    docs = frame(spark, rows)
    token_files.write(docs, folder, VOCABULARY)
    assert len(list((tmp_path / "files").glob("ids-*.bin"))) > 3 and len(list((tmp_path / "files").glob("index-*.mph"))) > 3
    tokenizer = Tokenizer.from_file(VOCABULARY)
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for _, t, _ in rows]
    got = token_files.digests(docs, folder).orderBy("start").collect()
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert Counter((r["key"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(x), crc(x)) for (i, _, _), x in zip(rows, ids, strict=True))
    assert [r["key"] for r in got] == sorted([r[0] for r in rows], key=lambda i: (i is not None, i))
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    payload = b"".join(p.read_bytes() for p in sorted((tmp_path / "files").glob("ids-*.bin")))
    assert len(payload) == 2 * sum(map(len, ids))
    some = spark.createDataFrame([(7,), (14,), (None,), (123456,), (700,)], "doc_id long")
    found = defaultdict(list)
    for r in token_files.lookup(some, folder).collect():
        found[r["key"]].append(r["ids"])
    want = defaultdict(list)
    for (i, _, _), x in zip(rows, ids, strict=True):
        if i in (7, 14, None, 700):
            want[i].append(x)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}


def test_files_of_nothing(spark, tmp_path):
    folder = str(tmp_path / "none")
    docs = frame(spark, [])
    token_files.write(docs, folder, VOCABULARY)
    assert token_files.digests(docs, folder).collect() == [] and token_files.digests(frame(spark, [(1, "a", "b")]), folder).collect() == []


# --- 13 ----------------------------------------------------------------------------------------------------------


def plain_phrases(rows, often, longest=5, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", lowered(text)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = set()
    for lang, found in f.items():
        often_ones = {p: a for p, a in found.items() if len(p) > 1 and a >= often}
        inside = defaultdict(int)
        for p, a in often_ones.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        scored = []
        for p, a in often_ones.items():
            if 100 * inside[p] < 100 * a:
                score, k = min((1000 * a * n[lang] // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), a, found[p[:k]], found[p[k:]], n[lang], score))
        for rank, x in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, x[2].decode(), *x[3:]))
    return out


def mixed_texts():
    rng = random.Random(11)
    words = ["the", "The", "of", "a b", "Ünder", "x\x01", "x", "é", "日", "c-d", "New", "York", "\x00", "end"]
    fixed = ["new york city hall park", "as well as", "x x x x x x"]
    rows = []
    for i in range(200):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else " ".join(rng.choices(words, [5, 1, 5, 1, 1, 1, 3, 1, 1, 1, 2, 2, 1, 1], k=rng.randint(1, 6))) for _ in range(20)]
        rows.append((i, rng.choice([", ", "\n", " \t ", ". "]).join(parts), ["en", "de", None, "und"][i % 4] if i % 3 else "en"))
    return rows + [(None, rows[0][1], "en"), (5, rows[5][1], "en"), (900, None, "en"), (901, "", None), (902, " .,;\t\n", "fr"), (903, "to be " * 30000, "en")]


def test_phrases_against_brute_force(spark, monkeypatch):
    rows = mixed_texts()
    docs = frame(spark, rows).withColumnsRenamed({"n": "a", "shard": "size", "name": "rank"})
    want = plain_phrases(rows, 10)
    got = [tuple(r) for r in phrases.collocations(docs, often=10).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 100
    for name, value in {"BURST": 8, "HELD": 64, "KNOWN": 40, "BLOCK": 16, "PAIRS": 100, "HOT": 20}.items():
        monkeypatch.setattr(phrases, name, value)
    assert {tuple(r) for r in phrases.collocations(docs, often=10).collect()} == want
    few = {tuple(r) for r in phrases.collocations(docs, often=10, top=3).collect()}
    assert few == {x for x in want if x[1] <= 3}


def test_phrases_of_nothing(spark):
    assert phrases.collocations(frame(spark, [])).collect() == []
    assert phrases.collocations(frame(spark, [(1, None, None), (2, "a b", "en")])).collect() == []


def test_scores_are_exact(spark):
    """Products beyond 64 bits."""
    big = 9_007_199_254_740_993
    known = spark.createDataFrame([("en", "a", 1, big // 3), ("en", "b", 1, big // 7), ("en", "a b", 2, big // 11)], "lang string, phrase string, size int, n long")
    totals = spark.createDataFrame([("en", big)], "lang string, total long")
    (row,) = phrases.ranked(known, totals).collect()
    assert row["score"] == 1000 * (big // 11) * big // ((big // 3) * (big // 7))


def test_trie_spills_whole_subtrees():
    trie = phrases.Trie("en")
    rng = random.Random(2)
    want = Counter()
    for _ in range(20000):
        ids = tuple(trie.numbered([b"w%d" % min(rng.randrange(1, 40), rng.randrange(1, 40)) for _ in range(rng.randint(2, 5))]).tolist())
        want[ids] += 1
        trie.root.add(ids, 1)
    assert trie.root.children is not None and trie.root.size() == len(want)
    part = list(trie.spilled(trie.root.size() // 2))
    assert trie.root.size() <= len(want) // 2 and not {k[0] for _, _, k in part} & set(trie.root.children)
    rest = list(trie.spilled(0))
    assert Counter({k: n for _, n, k in part + rest}) == want and len(part) + len(rest) == len(want)


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op13_phrase_collocations"])
def test_new_queries_match_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = queries.QUERIES[name](spark, sf)
    want = con.execute(queries.ORACLE[name])
    names = [d[0] for d in want.description]
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    assert got == sorted(want.fetchall(), key=repr) and set(names) == set(df.columns)


def test_query_token_files(spark):
    df = queries.QUERIES["op12_token_files"](spark, "/root/testdata/sf0.001")
    tokenizer = Tokenizer.from_file(VOCABULARY)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).orderBy("doc_id").collect()
    at, want = 0, set()
    for d in docs:
        ids = tokenizer.encode(d["text"], add_special_tokens=False).ids + [2]
        want.add((d["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert {tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()} == want
