"""Resampling, fingerprints and lexical search against plain definitions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import lexical, resample, walks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def grams(text, least, most):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(least, most + 1) for i in range(len(w) - n + 1)]


def plain_resample(docs, target, least=1, most=1, buckets=10_000, percent=10, least_words=20):
    """(doc_id, n_features, weight, score, rank) of each (doc_id, text)."""
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = collections.Counter(bucket(g) for _, t in docs for g in grams(t, least, most))
    t = collections.Counter(bucket(g) for x in target for g in grams(x, least, most))
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (ss + buckets) / ((s[b] + 1.0) * (tt + buckets))))
    out = []
    for d, text in docs:
        f = grams(text, least, most)
        weight = sum(gain(bucket(g)) for g in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words(text))])
    able = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = i + 1
    return collections.Counter(tuple(r[:5]) for r in out)


@pytest.fixture(scope="module")
def benchmark(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join("".join(rnd.choice("aeioustr") for _ in range(rnd.randint(1, 4))) for _ in range(12))) for i in range(12)]
    rows += [(20, None), (21, ""), (22, "x" * 50_000), (23, "a b A B c"), (None, "e o i"), (24, "nowhere-to-be-found-zzz"), (25, "i o u"), (25, "e a")]
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "item_id long, text string, doc_id string")


@pytest.mark.parametrize(("least", "most", "percent"), [(1, 1, 10), (1, 2, 60), (2, 3, 100)])
def test_resampling_equals_plain_scores(spark, docs, benchmark, monkeypatch, least, most, percent):
    monkeypatch.setattr(resample, "RUN", 3)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    target = [r["text"] for r in benchmark.collect()]
    found = resample.resampled(docs, benchmark, ["doc_id"], percent=percent, least=least, most=most)
    assert collections.Counter(map(tuple, found.collect())) == plain_resample(rows, target, least, most, percent=percent)


def test_resampling_of_repeated_rows_and_clashing_names(spark, docs, empty, benchmark):
    # One row repeated: nothing but the place in the written table tells its copies apart.
    text = "one two three four five six seven eight nine ten " * 3
    copies = spark.range(400).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"), F.col("id").alias("rank"), F.lit("s").alias("Score"), F.lit(1).alias("a`b c"))
    found = resample.resampled(copies, benchmark, percent=25)
    assert found.columns == ["doc_id", "text", "rank", "Score", "a`b c", "n_features", "weight", "__score", "__rank"]
    got = sorted(r["__rank"] for r in found.collect() if r["__rank"] is not None)
    assert got == list(range(1, 101))
    kept = resample.drawn(copies, benchmark, percent=25)
    assert kept.columns == copies.columns and kept.count() == 100
    assert resample.resampled(empty, benchmark).count() == 0
    bare = resample.resampled(docs, benchmark.limit(0), ["doc_id"])
    assert collections.Counter(map(tuple, bare.collect())) == plain_resample([(r["doc_id"], r["text"]) for r in docs.collect()], [])


def test_a_walk_is_the_step_by_step_definition():
    e = walks.Embedding()
    rnd = random.Random(4)
    for text in ("a", "ab", "é🙂x" * 5, "".join(rnd.choice("abcdef \n") for _ in range(3000))):
        codes = walks.codes_of(text)
        classes = ((codes * e.class_factor) >> 27).tolist()
        begins, at, step = [0], 0, 0
        while at < len(text):
            moves = e.bits[step % walks.PERIOD, classes[at]]
            step += 1
            if moves:
                at += 1
                begins.append(step)
        assert e.walk(codes).tolist() == begins
        half = len(text) // 2
        assert e.walk(codes, e.walk(codes[:half])).tolist() == begins
        mark = e.fingerprint(text)
        assert set(mark) <= set("0123456789abcdef.") and walks.likeness(mark, mark) == 1.0


def test_likeness_falls_with_edits():
    e = walks.Embedding()
    rnd = random.Random(6)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(500)]
    few, many, other, half = [], [], [], []
    for _ in range(30):
        text = " ".join(rnd.choice(vocabulary) for _ in range(300))
        unlike = " ".join(rnd.choice(vocabulary) for _ in range(300))
        mark = e.fingerprint(text)

        def edits(n, text=text):
            letters = list(text)
            for _ in range(n):
                letters[rnd.randrange(len(letters))] = rnd.choice(["", "x", "yz"])
            return "".join(letters)

        few.append(walks.likeness(mark, e.fingerprint(edits(2))))
        many.append(walks.likeness(mark, e.fingerprint(edits(60))))
        other.append(walks.likeness(mark, e.fingerprint(unlike)))
        half.append(walks.likeness(mark, e.fingerprint(walks.edited(text, unlike))))
    mean = lambda v: sum(v) / len(v)
    assert mean(few) > 0.8 and mean(few) > mean(many) + 0.2 and mean(other) < 0.1 and 0.35 < mean(half) < 0.65
    assert walks.likeness("", "") == 1.0 and walks.likeness("", e.fingerprint("a")) == 0.0


@pytest.mark.parametrize("slice_bytes", [32_000_000, 20_000])
def test_each_document_is_paired_with_the_next(spark, docs, empty, monkeypatch, slice_bytes):
    monkeypatch.setattr(walks, "SLICE_BYTES", slice_bytes)
    e = walks.Embedding()
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).orderBy(F.col("doc_id").desc_nulls_last(), "h", "text").collect()]
    wanted = []
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        changed = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        a, b, c = map(e.fingerprint, (text, changed, following))
        wanted.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), a, b, walks.likeness(a, b), walks.likeness(a, c)))
    found = walks.op12_query(docs)
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(wanted)
    assert walks.op12_query(empty).count() == 0
    one = walks.op12_query(docs.where("doc_id = 100")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_near_pairs_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(walks, "BLOCK", 4)
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(500)]
    texts = []
    for _ in range(12):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(40, 250))]
        for copy in range(10):
            changed = list(base)
            for _ in range(copy // 4):
                changed[rnd.randrange(len(changed))] = rnd.choice(vocabulary)
            texts.append(" ".join(changed))
    frame = spark.createDataFrame([*enumerate(texts), (1000, ""), (1001, None)], "doc_id long, text string")
    members, links = walks.near_pairs(frame)
    cls = {r["doc_id"]: r["class"] for r in members.collect()}
    e = walks.Embedding()
    marks = {i: e.fingerprint(t) for i, t in enumerate(texts)}
    assert all((marks[i] == marks[j]) == (cls[i] == cls[j]) for i in marks for j in marks) and cls[1000] == 1000
    found = {(r["a"], r["b"]) for r in links.collect()}
    distinct = sorted({cls[i] for i in marks})
    wanted = {(a, b) for a in distinct for b in distinct if a < b and walks.likeness(marks[a], marks[b]) >= walks.NEAR}
    assert found <= wanted and len(found) >= 0.9 * len(wanted) > 0


def plain_search(docs, items, k=10):
    held = [(d, collections.Counter(words(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(w for _, c in held for w in c)
    out = collections.Counter()
    asked = collections.defaultdict(collections.Counter)
    for item, text in items:
        asked[item].update(words(text))
    for item, terms in asked.items():
        scores = []
        for d, c in held:
            m = 25 + 75 * sum(c.values()) * n // length
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m)) for w, times in terms.items() if c[w])
            if score > 0:
                scores.append((-score, d is None, d or 0))
        for rank, (score, null, d) in enumerate(sorted(scores)[:k]):
            out[item, rank + 1, None if null else d, -score] += 1
    return out


@pytest.mark.parametrize(("shard", "postings", "block"), [(16_000_000, 4_096, 4_000_000), (3_000, 4, 500)])
def test_lexical_search_equals_scoring_everything(spark, docs, empty, benchmark, monkeypatch, shard, postings, block):
    for name, value in (("SHARD_BYTES", shard), ("POSTINGS", postings), ("BLOCK_BYTES", block)):
        monkeypatch.setattr(lexical, name, value)
    monkeypatch.setattr(lexical.write_index, "__defaults__", (shard,))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    found = lexical.op13_query(docs, benchmark)
    assert collections.Counter(map(tuple, found.collect())) == plain_search(rows, items)
    assert lexical.op13_query(empty, benchmark).count() == 0 and lexical.op13_query(docs, benchmark.limit(0)).count() == 0


def test_postings_blocks_round_trip():
    rnd = random.Random(3)
    for top in (10, 300, 70_000, 2**33):
        rows = sorted(rnd.sample(range(top), min(top, 50)))
        tf = [rnd.choice([1, 2, 300, 2**17]) for _ in rows]
        a, b = lexical.unpack(lexical.pack(np.array(rows), np.array(tf)))
        assert a.tolist() == rows and b.tolist() == tf


def test_rare_terms_are_packed_together(monkeypatch):
    """Lists that stay plain are not packed one by one, and their bytes are those of ``pack``."""
    packed = []
    one = lexical.pack
    monkeypatch.setattr(lexical, "pack", lambda rows, tf: packed.append(len(rows)) or one(rows, tf))
    texts = [b" ".join([b"all", b"t%d" % i, b"u%d" % (i // 3), b"v%d" % (i % 40)] + [b"w%d" % i] * (300 if i % 100 == 0 else 2)) for i in range(1_000)]
    made = lexical.build(list(range(1_000)), texts)
    assert packed == [1_000]
    where = {}
    for i, text in enumerate(texts):
        for term in dict.fromkeys(text.split()):
            where.setdefault(term, []).append((i, text.split().count(term)))
    terms, sizes, at = lexical.zstandard.ZstdDecompressor().decompress(made["terms"]).split(b"\n"), lexical._numbers(made["sizes"]), 0
    assert terms == list(where)
    for term, size in zip(terms, sizes.tolist(), strict=True):
        rows, tf = map(np.array, zip(*where[term], strict=True))
        data, at = made["postings"][at : at + size], at + size
        if term != b"all":
            assert data == lexical.struct.pack("<IB", len(one(rows, tf)) + 1, 0) + one(rows, tf)
    assert at == len(made["postings"])
