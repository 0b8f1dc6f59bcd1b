import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
import tiktoken
from conftest_llm import MULTI, PATTERN, prefix_table
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.llm import bpe, cutter, decontaminate, langid, lm, rans, secrets


def brute_windows(docs, items, n=13):
    windows = {}
    for item, text in items:
        words = decontaminate.words_of(text.encode() if text is not None else None)
        size = min(n, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(str(item))
    out = []
    for doc, text in docs:
        words = decontaminate.words_of(text.encode() if text is not None else None)
        hit, found = set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                owners = windows.get(tuple(words[i : i + size]))
                if owners:
                    hit |= set(range(i, i + size))
                    found |= owners
        out.append((str(doc), len(words), len(hit), len(found), decontaminate.digest(list(found)), bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out)


def test_decontamination_equals_brute_force(spark, docs, empty):
    texts = [r["text"] for r in docs.orderBy("doc_id").collect() if r["text"]]
    long_ = next(t for t in texts if 400 < len(t) < 700).split()
    items = [(1, " ".join(long_[5:40])), (2, " ".join(long_[20:60])), (3, "a b c d"), (4, None), (5, ""), (6, " ".join(long_[5:40])), (7, "b c"), (8, " ".join(long_[50:62]))]
    frame = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_windows(rows, items)
    got = lambda df: sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect())
    assert got(decontaminate.op1_query(docs, frame)) == want
    assert sum(w[5] for w in want) >= 3
    several = decontaminate.judged(decontaminate.match_spans(docs.select("doc_id", "text"), frame, max_words=40))
    several = several.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
    assert got(several) == want
    cut_up = decontaminate.judged(decontaminate.match_spans(docs.select("doc_id", "text"), frame, max_words=26))
    assert {(str(r["doc_id"]), r["n_hit"], len(r["items"])) for r in cut_up.collect()} == {(w[0], w[2], w[3]) for w in want}
    kept = decontaminate.keep_uncontaminated(docs, frame)
    assert kept.columns == docs.columns and kept.count() == sum(not w[5] for w in want)
    assert decontaminate.keep_uncontaminated(docs, frame, max_words=40).count() == kept.count()
    assert decontaminate.op1_query(docs, frame.limit(0)).where("contaminated").count() == 0
    assert decontaminate.op1_query(empty, frame).count() == 0
    cut = {r["doc_id"]: r["text"] for r in decontaminate.cut_spans(docs.where("doc_id = 204"), frame, longest_kept=1).collect()}
    assert cut[204].strip() == ""


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=5), st.lists(st.sampled_from("abcd"), max_size=30))
@settings(max_examples=150, deadline=None)
def test_automaton_equals_brute_force(items, words):
    listed = [(str(i), " ".join(w)) for i, w in enumerate(items)]
    automaton = decontaminate.ItemAutomaton([(i, decontaminate.words_of(t.encode())) for i, t in listed], 4)
    spans, found, _ = automaton.scan([w.encode() for w in words])
    want = brute_windows([(0, " ".join(words))], listed, 4)[0]
    assert (sum(e - b for b, e in spans), decontaminate.digest(list(found))) == (want[2], want[4])


def test_language_identification(spark, docs, empty):
    rows = [(i, t, lang) for i in range(60) for lang, t in (("aa", f"abba babab abab{'ab' * (i % 5)} ba"), ("zz", f"zyzz yzyz zyzy{'zy' * (i % 5)} yz"))]
    train = spark.createDataFrame([(2 * i + (lang == "zz"), t, lang) for i, t, lang in rows], "doc_id long, text string, lang string")
    model = langid.fit(train)
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, model).collect()}
    assert out[200] == out[201] == out[203] == ("und", 0.0) and all(0 <= s <= 1 for _, s in out.values())
    unseen = spark.createDataFrame([(1, "bbaabb"), (2, "zzyyzz"), (3, "abba")], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.identify(unseen, model).orderBy("doc_id").collect()] == ["aa", "zz", "aa"]
    assert langid.identify(docs, langid.fit(train.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert langid.op4_query(docs).count() == docs.count() and langid.op4_query(empty).count() == 0
    assert {r["held_out"] for r in langid.op4_query(docs).where("doc_id is null").collect()} == {False}


def test_language_votes_equal_brute_force(spark):
    """Every word's votes and every text's score recomputed from the labelled texts, without the model's tables."""
    import math
    import unicodedata
    from collections import Counter, defaultdict

    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    letter = lambda c: unicodedata.category(c)[0] == "L"
    words_of = lambda t: "".join(c if letter(c) else " " for c in t.lower()).split()
    grams = lambda w, n: [m[i : i + n] for m in [f"<{w}>" if n > 1 else w] for i in range(len(m) - n + 1)]
    counts = defaultdict(Counter)
    for text, lang in {(t, x) for d, t, x in rows if t and x and zlib.crc32(str(d).encode()) % 4 != 2}:
        for word in words_of(text):
            counts[lang, 0][word] += 1
            for n in range(1, 5):
                counts[lang, n].update(grams(word, n))
    languages = sorted({lang for lang, _ in counts})
    share = lambda lang, n, g: math.log((counts[lang, n][g] + 0.1) / counts[lang, n].total())

    def vote(word):
        for n in range(5, 0, -1):
            known = [g for g in ([word] if n == 5 else grams(word, n)) if any(counts[lang, n % 5][g] for lang in languages)]
            if known:
                return [sum(share(lang, n % 5, g) for g in known) / len(known) for lang in languages]
        return [0.0] * len(languages)

    got = {r["doc_id"]: r for r in langid.op4_query(frame).collect()}
    for d, text, _ in rows:
        votes = [vote(w) for w in words_of(text or "")]
        if not votes:
            assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0)
            continue
        total = [sum(v[i] for v in votes) for i in range(len(languages))]
        best = max(range(len(languages)), key=lambda i: total[i])
        assert got[d]["score"] == pytest.approx(1 / sum(math.exp(t - total[best]) for t in total), abs=1e-3)
        assert got[d]["lang_pred"] == languages[best] or got[d]["score"] < 0.51


def test_letters_and_languages(spark):
    assert langid.LETTERS.findall("½ ² ① Ⅷ 12 _ aé日") == ["aé日"]
    rows = [(i, f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]} x", f"l{i:03}") for i in range(520)] + [(9_999, "½ ²", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(langid.fit(frame).languages) == 520
    assert [r["lang_pred"] for r in langid.op4_query(frame).where("doc_id = 9999").collect()] == ["und"]
    # The commonest labels are learnt, ties by name; a noisy label column is no error.
    noisy = frame.unionByName(spark.createDataFrame([(20_000, "again x", "l519")], frame.schema))
    assert langid.fit(noisy, most_languages=3).languages == ["l000", "l001", "l519"]
    # A text that is repeated takes one place of the sample.
    copies = spark.createDataFrame([(i, "copy copy", "aa") for i in range(50)] + [(100 + i, f"other{'abcde'[i]}", "aa") for i in range(5)], "doc_id long, text string, lang string")
    assert len(langid.fit(copies, rows_per_language=6).index[0]) == 6


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.op4_query(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.where("lang_pred = lang").count() >= 0.95 * out.count()


@pytest.fixture(scope="module")
def encoder():
    return bpe.TextEncoder(bpe.read_ranks(None, MULTI), PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(None, MULTI), special_tokens={})


@given(st.one_of(st.text(max_size=60), st.text(alphabet="etaoin shrdlu'\n 12é.", max_size=80)))
@settings(max_examples=300, deadline=None)
def test_bpe_equals_library(encoder, library, text):
    ids = encoder.encode(text)
    assert ids == library.encode_ordinary(text) and encoder.decode(ids) == text.encode()


@given(st.text(alphabet="etaoinshr", min_size=1, max_size=60), st.text(alphabet="etao", max_size=8), st.data())
@settings(max_examples=150, deadline=None)
def test_bpe_appends_and_edits(encoder, piece, new, data):
    e = encoder.encoder
    old = piece.encode()
    begin = data.draw(st.integers(0, len(old)))
    end = data.draw(st.integers(begin, len(old)))
    edited, table = e.edited(old, prefix_table(e, old), begin, end, new.encode())
    assert edited == old[:begin] + new.encode() + old[end:] and table == prefix_table(e, edited)
    grown = e.extend(old + new.encode(), prefix_table(e, old))
    assert grown == prefix_table(e, old + new.encode())


def test_bpe_rows(docs, empty, library):
    out = bpe.digests(docs, MULTI, PATTERN, with_ids=True)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    assert out.count() == docs.count() and bpe.digests(empty, MULTI, PATTERN).count() == 0
    for r in out.where("doc_id < 300").collect():
        text = texts[r["doc_id"]][0]
        ids = library.encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    odd = docs.withColumn("c`d", F.lit("kept")).withColumn("a.b", F.lit(1))
    assert bpe.decode(bpe.encode(odd, MULTI, PATTERN), MULTI).where("`c``d` = 'kept' and `a.b` = 1").count() == docs.count()
    both = bpe.decode(bpe.encode(docs, MULTI, PATTERN), MULTI)
    assert both.where("decoded <> cast(coalesce(text, '') as binary)").count() == 0 and both.columns[: len(docs.columns)] == docs.columns


def test_narrow_cut_equals_wide():
    c = cutter.Cutter(PATTERN)
    for x in range(cutter.NARROW):
        text = f"a{chr(x)}b 1{chr(x)}2 !{chr(x)}? {chr(x)}  {chr(x)}"
        assert c._few(text) == c._any(text), x


@given(st.lists(st.lists(st.integers(0, 300), max_size=40), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_rans_round_trip(lists):
    ids = [np.array([*x, 2], np.uint32) for x in lists]
    names = [None if i % 3 == 2 else i for i in range(len(ids))]
    back, found = rans.unpack_segment(rans.pack_segment(names, ids))
    assert back == names and all((a == b).all() for a, b in zip(ids, found, strict=True))


def test_rans_blocks_checkpoints_and_checksums():
    ids = (np.random.default_rng(3).zipf(1.2, 3 * rans.LANES * 40 + 17) % 50_000).astype(np.uint32)
    table = rans.Table.of(ids)
    block = rans.encode_block(table.codes(ids), table)
    assert (rans.decode_block(block, table, table.slots()) == ids).all()
    for k in (1, 2, 3):
        assert (rans.decode_block(block, table, table.slots(), k) == ids[k * rans.CHECKPOINT * rans.LANES :]).all()
    frame = bytearray(rans.pack_segment([1], [ids]))
    frame[len(frame) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.unpack_segment(bytes(frame))
    assert rans.frequencies(np.array([1] * 1000 + [10**12])).sum() == 1 << rans.SCALE


def test_rans_files(spark, docs, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.where("doc_id is not null").collect()))
    assert rans._shards(docs) == spark.sparkContext.defaultParallelism
    rans.write(docs.where("doc_id is not null"), str(tmp_path / "f"), path, PATTERN, 2, shards=3, segment_ids=500)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rans.read(spark, str(tmp_path / "f")).collect())
    start, want = 0, []
    for doc, text in rows:
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    one = lambda x: [w for w in x if w[0] not in (300, 301)]  # noqa: E731  repeated ids: their order is by text
    assert one(got) == one(sorted(want)) and len(got) == len(want) and sum(g[2] for g in got) == start
    assert rans.op9_query(docs, path, PATTERN).count() == docs.count()
    assert rans.op9_query(empty, path, PATTERN).count() == 0


def test_secret_queries():
    q = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert q["hex"] == secrets.ANY and frozenset({"tok", "oke", "ken"}) in q["assign"] and q["access"] == (frozenset({"aki", "kia"}),)
    assert secrets.trigram_query("ab|xyzw") == secrets.ANY and secrets.trigram_query("(abc|xyz)[0-9]+") == (frozenset({"abc"}), frozenset({"xyz"}))


def test_secret_scan_equals_sql(spark, docs, empty):
    frame = docs.where("doc_id is not null and doc_id < 300 or doc_id >= 400").select("doc_id", "text").toPandas()
    c = duckdb.connect()
    c.register("documents", frame)
    want = c.sql(secrets.op5_sql())
    rows = lambda columns, found: sorted(tuple(str(r[columns.index(n)]) for n in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")) for r in found)
    got = secrets.op5_query(docs.where("doc_id is not null and doc_id < 300 or doc_id >= 400"))
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
    spans = {r["doc_id"]: r["spans"] for r in got.collect()}
    assert spans[400].startswith("assign:0:") and "access:" in spans[400] and "hex:" in spans[400]
    assert spans[401].count("assign") == 1 and "github:" in spans[401]
    assert secrets.op5_query(docs).count() == docs.count() and secrets.op5_query(empty).count() == 0
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(docs).collect()}
    assert "Abcdefghij12345" not in clean[400] and "AKIA" not in clean[400] and clean[200] is None and clean[204] == "a b c d"
    plan = secrets.op5_query(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_language_model(spark, docs, empty):
    import math
    from collections import Counter

    out = {}
    for r in lm.scored(docs, MULTI, PATTERN).collect():
        out.setdefault(r["doc_id"], []).append(r)
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter()
    for d, t in rows:
        if not held(d):
            counts.update([*t.lower().split(), b""])
    total, distinct = sum(counts.values()), len(counts)
    for d, t in rows:
        words = [*t.lower().split(), b""]
        want = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        assert any(r["n_tokens"] == len(words) and r["train_tokens"] == total and r["n_known"] == sum(counts[w] > 0 for w in words) and r["held_out"] == held(d) and r["base_score"] == pytest.approx(want, rel=1e-9) and math.isfinite(r["score"]) and r["score"] < 0 for r in out[d]), d
    assert lm.scored(empty, MULTI, PATTERN).count() == 0


def test_language_model_scores_equal_brute_force(spark, docs, monkeypatch):
    """Every subword's probability by a plain loop over its window, and the mixture with the base, word by word."""
    import math
    from collections import Counter

    monkeypatch.setattr(lm, "STEPS", 40)
    learnt, fitted = lm.learnt, []
    monkeypatch.setattr(lm, "learnt", lambda *args: fitted.append(learnt(*args)) or fitted[-1])
    rows = [r for r in docs.collect() if r["doc_id"] is not None and len(r["text"] or "") < 2_000]
    frame = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
    got = Counter((r["doc_id"], round(r["score"], 3)) for r in lm.scored(frame, MULTI, PATTERN).collect())
    net, vocabulary = fitted[-1], lm.subwords(MULTI, PATTERN)
    counts = Counter()
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            counts.update([*lm.words_of((r["text"] or "").encode()), b""])
    total, distinct = sum(counts.values()), len(counts)
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    place = np.append(net.place, net.end)

    def spelled(raw, i):
        inputs = [net.start, *place[raw[:-1]]]
        x = p["x"][inputs[max(0, (i // lm.STRIDE - 1) * lm.STRIDE) : i + 1]]
        query = x[-1] @ p["q"] * lm.WIDTH**-0.5
        attention = np.exp(np.clip([query @ (y @ p["k"]) + p["r"][len(x) - 1 - j] for j, y in enumerate(x)], -60, 60))
        mixed = sum(a * (y @ p["v"]) for a, y in zip(attention / attention.sum(), x, strict=True))
        logits = np.clip(np.maximum(mixed @ p["o"] + x[-1] @ p["s"] + p["b"], 0) @ p["w"] + p["c"], -60, 60)
        return logits[net.class_of[raw[i]]] - math.log(np.exp(logits).sum()) + net.share[raw[i]]

    want = Counter()
    for r in rows:
        words = [*lm.words_of((r["text"] or "").encode()), b""]
        parts = [np.frombuffer(vocabulary.of(w), "<i4") if w else np.array([vocabulary.size], "<i4") for w in words]
        raw, at, score = np.concatenate(parts), 0, 0.0
        for word, part in zip(words, parts, strict=True):
            by_letters = math.exp(sum(spelled(raw, i) for i in range(at, at + len(part))))
            score += math.log10(lm.MIX * (counts[word] + 1) / (total + distinct + 1) + (1 - lm.MIX) * by_letters)
            at += len(part)
        want[(r["doc_id"], score)] += 1
    assert len(got) == len(want)
    for (d, a), (e, b) in zip(sorted(got), sorted(want), strict=True):
        assert d == e and a == pytest.approx(b, abs=2e-3 + 1e-4 * abs(b)), d


def test_network_gradients_and_windows():
    texts = [b"ab cd ef gh ab cd ef gh ab cd " * 5, b"xy zw ab cd"] * 4
    lm_steps, lm.STEPS = lm.STEPS, 60
    try:
        net = lm.train(texts, MULTI, PATTERN)
    finally:
        lm.STEPS = lm_steps
    vocabulary = lm.subwords(MULTI, PATTERN)
    ids = np.frombuffer(b"".join(map(vocabulary.of, lm.words_of(texts[0]))), "<i4")
    raw = np.append(ids, vocabulary.size)
    whole = lm.subword_scores(net, raw, np.array([len(raw)]), vocabulary.size)
    small = lm.subword_scores(net, raw, np.array([len(raw)]), vocabulary.size, at_once=2)
    assert np.allclose(whole, small, atol=1e-4) and (whole < 0).all() and len(whole) == len(raw)
    changed = raw.copy()
    changed[-2] = raw[0] if raw[-2] != raw[0] else raw[1]
    assert np.allclose(lm.subword_scores(net, changed, np.array([len(raw)]), vocabulary.size)[:-2], whole[:-2], atol=1e-5)  # nothing looks ahead
    inputs, target, lead = lm.laid_out(net, np.append(net.place, net.end)[raw], np.array([len(raw)]))
    assert sorted(target[target >= 0].tolist()) == list(range(len(raw))) and lead.sum() == 1
    own = np.flatnonzero(~lead)[:4]
    goal = net.class_of[np.append(raw, 0)][target[own]]
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    loss, grad = net.step(inputs[own], inputs[own - 1], goal, target[own] >= 0)
    rng = np.random.default_rng(0)
    for name in net.p:
        at = tuple(rng.integers(0, s) for s in net.p[name].shape) if name != "x" else (int(inputs[own][0][1]), 3)
        kept, eps = net.p[name][at], 1e-4
        net.p[name][at] = kept + eps
        up = net.step(inputs[own], inputs[own - 1], goal, target[own] >= 0)[0]
        net.p[name][at] = kept - eps
        down = net.step(inputs[own], inputs[own - 1], goal, target[own] >= 0)[0]
        net.p[name][at] = kept
        assert grad[name][at] == pytest.approx((up - down) / (2 * eps), abs=2e-3), name


def test_language_model_learns_from_the_whole_corpus(spark, monkeypatch):
    """Statistics are exact sums over all training rows, weights come from windows of distinct texts, as many as the input has."""
    vocabulary = lm.subwords(MULTI, PATTERN)
    monkeypatch.setattr(lm, "STEPS", 3)
    monkeypatch.setattr(lm, "SAMPLE_ROWS", 2)
    seen, windows = {}, {}
    prepared, summed = lm.prepared, lm._summed
    texts = [f"alpha word{i} beta gamma delta word{i * 7} " * 6 for i in range(60)]

    def spy(counts, near, ends, seed=7):
        seen.update(counts=counts, near=near, ends=ends)
        return prepared(counts, near, ends, seed)

    def spied(vectors):
        found = summed(vectors)
        windows["n"] = found[1]
        return found

    monkeypatch.setattr(lm, "prepared", spy)
    monkeypatch.setattr(lm, "_summed", spied)

    def run(rows):
        frame = spark.createDataFrame([(7 * 10**6 + i, t) for i, t in enumerate(rows)], "doc_id long, text string").repartition(5)
        got = lm.scored(frame, MULTI, PATTERN)
        kept = [r["text"].encode() for r in frame.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2]
        return got, kept

    _, kept = run(texts)
    raw, ends = lm.raw_ids(kept, vocabulary)
    counts = np.bincount(raw[raw < vocabulary.size], minlength=vocabulary.size)
    assert (seen["counts"] == counts).all() and seen["ends"] == len(kept)
    net = lm.Network(counts.astype(float))
    sequence = np.append(net.place, net.end)[np.append(vocabulary.size, raw)]
    near, sign = np.zeros_like(seen["near"]), net.signs()
    np.add.at(near[:, : lm.SIGNS], sequence[1:], sign[sequence[:-1]])
    np.add.at(near[:, lm.SIGNS :], sequence[:-1], sign[sequence[1:]])
    assert (seen["near"] == near).all()
    few = windows["n"]
    _, kept = run(texts + [t + " more" for t in texts])
    more = windows["n"]
    assert more > 1.5 * few
    # Copies add nothing to the windows.
    rows = texts + [texts[0]] * 300
    got, kept = run(rows)
    lengths = [len(lm.raw_ids([t], vocabulary)[0]) for t in set(kept)]
    if len(set(kept)) <= lm.LEARN_EVERY * lm.SAMPLE_ROWS:
        assert windows["n"] == sum(-(-n // lm.STRIDE) for n in lengths)
    else:
        assert windows["n"] <= sum(-(-n // lm.STRIDE) for n in lengths)
    assert got.count() == len(rows)


def test_rans_added_tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, mine = Tokenizer.from_file(path), rans.LibraryTokenizer(path, PATTERN, 2)
    assert mine.added
    for text in ["a <|endoftext|> b", *(f"x{c}{c} é\n{c}y" for c in mine.added), "<|endoftext", "plain text"]:
        assert mine.encode(text).tolist() == [*library.encode(text, add_special_tokens=False).ids, 2], text
    assert 50256 in mine.encode("a <|endoftext|> b").tolist()


def test_language_model_does_not_depend_on_partitions(spark, monkeypatch):
    """Scores follow from the rows: learners and their texts are the same whatever the tasks."""
    monkeypatch.setattr(lm, "STEPS", 20)
    monkeypatch.setattr(lm, "LEARNER_TEXTS", 40)
    rnd = random.Random(3)
    words = ["".join(rnd.choice("aeioustr") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(5, 60)))) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    held = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for partitions, parts in ((2, 1), (8, 5)):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        found.append({r["doc_id"]: r["score"] for r in lm.scored(frame.repartition(parts), MULTI, PATTERN).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", held)
    assert found[0].keys() == found[1].keys() and max(abs(found[0][d] - found[1][d]) for d in found[0]) < 1e-6


def test_language_model_learns_from_every_distinct_text(spark, monkeypatch):
    """No text is left out, however many more there are than the start takes."""
    monkeypatch.setattr(lm, "STEPS", 3)
    monkeypatch.setattr(lm, "SAMPLE_ROWS", 1)
    monkeypatch.setattr(lm, "LEARNER_TEXTS", 30)
    windows, summed = [], lm._summed
    monkeypatch.setattr(lm, "_summed", lambda vectors: windows.append(summed(vectors)) or windows[-1])
    texts = [f"alpha word{i} beta gamma word{i * 7} " * (1 + i % 9) for i in range(80)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts[:20])], "doc_id long, text string").repartition(3)
    assert lm.scored(frame, MULTI, PATTERN).count() == 100
    kept = {t.encode() for i, t in enumerate(texts + texts[:20]) if zlib.crc32(str(i).encode()) % 7 != 2}
    vocabulary = lm.subwords(MULTI, PATTERN)
    assert windows[-1][1] == sum(-(-len(lm.raw_ids([t], vocabulary)[0]) // lm.STRIDE) for t in kept)
