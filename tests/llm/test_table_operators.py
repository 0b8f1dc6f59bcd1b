import collections
import random

import duckdb
import numpy as np
import pytest

from tickloom.llm import catalog, fixity, jaccard, topk, urlrules
from tickloom.llm.components import components


def brute_components(rows):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)]) if words else frozenset())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return collections.Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


def test_jaccard_equals_brute_force(spark, docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = collections.Counter(tuple(r) for r in jaccard.op6_query(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(rows)
    assert jaccard.op6_query(empty).count() == 0
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and kept.where("doc_id between 100 and 107").count() == 1
    assert kept.where("doc_id in (200, 201, 202)").count() == 3 and kept.where("doc_id = 300").count() == 1


def test_jaccard_families_and_split_lists(spark, monkeypatch):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for family in range(4):
        base = [rnd.choice(words) for _ in range(60)]
        for _ in range(25):
            changed = list(base)
            for _ in range(rnd.randint(0, 2)):
                changed[rnd.randrange(60)] = rnd.choice(words)
            if rnd.random() < 0.3:
                changed += base[:6]
            rows.append((len(rows), " ".join(changed)))
    passage = " ".join(rnd.choice(words) for _ in range(40))
    rows += [(1000 + i, passage + " " + " ".join(rnd.choice(words) for _ in range(12 + i % 9))) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    monkeypatch.setattr(jaccard, "FEW_ROWS", 0)  # the paths without broadcasts
    assert collections.Counter(tuple(r) for r in jaccard.op6_query(frame).collect()) == want
    monkeypatch.setattr(jaccard, "SALT_ROWS", 5)  # lists of many salts, in every round
    monkeypatch.setattr(jaccard, "LONG_LIST", 3)
    assert collections.Counter(tuple(r) for r in jaccard.op6_query(frame).collect()) == want


def test_texts_whose_polynomials_agree_are_told_apart(spark):
    """Thue-Morse words and their complements agree under any polynomial modulo a power of two; their shingles do not."""
    for length in (1024, 2048, 4096):
        one = "".join("ab"[bin(i).count("1") % 2] for i in range(length))
        other = one.translate(str.maketrans("ab", "ba"))
        assert not np.array_equal(jaccard.shingle_set(one.encode()), jaccard.shingle_set(other.encode()))
    frame = spark.createDataFrame([(1, one), (2, other), (3, one)], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.op6_query(frame).collect()) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_bitmaps_bound_the_overlap_when_folded():
    rnd = np.random.default_rng(3)
    for n, m in ((500, 530), (513, 512), (1000, 1100), (3000, 2400), (60, 50)):
        pool = rnd.integers(0, 2**64, n + m, dtype=np.uint64)
        x, y = np.unique(pool[:n]), np.unique(pool[n // 3 : n // 3 + m])
        a, b = jaccard.bitmap(x), jaccard.bitmap(y)
        while len(a) != len(b):
            long, short = (a, b) if len(a) > len(b) else (b, a)
            a, b = long[: len(long) // 2] ^ long[len(long) // 2 :], short
        differing = sum(bin(int(v) & (2**64 - 1)).count("1") for v in a ^ b)
        assert len(np.intersect1d(x, y)) <= (len(x) + len(y) - differing) / 2


def test_levels_keep_the_order_of_counts():
    counts = np.concatenate([np.arange(2**16), 2 ** np.arange(15, 47), 2 ** np.arange(15, 47) * 5 // 4]).astype(np.int64)
    counts.sort()
    levels = jaccard.level(counts)
    assert (np.diff(levels.astype(int)) >= 0).all() and (levels[: 2**15] == counts[: 2**15]).all()
    assert (np.abs(jaccard.at_level(levels) - counts) <= counts / 500).all()


def test_filter_holds_every_key(spark):
    rnd = np.random.default_rng(1)
    keys = rnd.integers(-(2**63), 2**63, 5000)
    bits = jaccard._filter(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    held = lambda k: (bits[(p := jaccard._places(k)) >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).all(axis=0)
    assert held(keys).all() and held(rnd.integers(-(2**63), 2**63, 5000)).sum() < 5


def test_shingles_do_not_depend_on_chunks(monkeypatch):
    text = " ".join(f"w{i % 50}" for i in range(500)).encode()
    whole = jaccard.shingle_set(text)
    monkeypatch.setattr(jaccard, "CHUNK", 64)
    assert (jaccard.shingle_set(text) == whole).all()
    assert len(jaccard.shingle_set(b"a b c")) == 1 and len(jaccard.shingle_set(b"")) == 0 and len(jaccard.shingle_set(None)) == 0
    a, b = jaccard.shingle_set(b"a b c d e f g"), jaccard.shingle_set(b"b c d e f g h")
    assert len(np.intersect1d(a, b)) == 2
    assert all(jaccard.prefix_length(n) == n - -(-3 * n // 4) + 1 for n in range(1, 50))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r["u"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def run_sql(spark, name, **frames):
    c = duckdb.connect()
    for k, f in frames.items():
        c.register(k, f.toArrow())
    return c.sql(catalog.oracle_sql()[name])


def cells(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(round(r[i], 6)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


def test_search_equals_scoring_everything(spark, docs, monkeypatch):
    frame = docs.select("doc_id", "text").where("doc_id is not null")
    want = run_sql(spark, "op2_topk", documents=frame)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    got = topk.op2_query(frame)
    assert cells(got.columns, got.collect()) == cells(want.columns, want.fetchall())
    queries = topk.op2_query(docs)
    assert sorted(queries.columns) == sorted(want.columns) and queries.count() >= len(got.collect())
    assert topk.op2_query(docs.limit(0)).count() == 0


def test_search_skips_blocks():
    rnd = random.Random(1)
    texts = [(" ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(9)) + (" needle needle" if i < 12 else "")).encode() for i in range(2_000)]
    shard = topk.Shard(topk.build(list(range(2_000)), texts), 10.0)
    light = shard.search(topk.term_hashes([b"needle"]), np.array([5e-9]), 5)  # a term that nearly every row of a huge table has
    assert len(light[0]) == 5 and (light[1] > 0).all()
    ids, scores = shard.search(np.sort(topk.term_hashes([b"needle", b"alpha"])), np.array([4.0, 4.0]), 5)
    assert len(ids) == 5 and (np.diff(scores) <= 0).all() and shard.opened < shard.held


def asked_of(texts, df, rows):
    sets = [np.unique(topk.term_hashes(t.split())) for t in texts]
    weights = [np.log(1 + (rows - d + 0.5) / (d + 0.5)) for d in (np.array([df[int(h)] for h in s], float) for s in sets)]
    return topk.Asked(list(range(len(texts))), np.array([len(s) for s in sets]), np.concatenate(sets), np.concatenate(weights))


@pytest.mark.parametrize("limits", [{}, {"CELLS": 2_000, "POSTINGS": 50}, {"COMMON": 10_000, "DEAR": 1e9}, {"DEAR": 0, "FEW": 0, "BATCH": 7}])
def test_scores_of_whole_texts_above_a_bound(monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(topk, name, value)
    rnd = random.Random(2)
    words = [f"w{i}".encode() for i in range(400)]
    texts = [b" ".join(rnd.choice(words[: rnd.choice([4, 20, 400])]) for _ in range(rnd.choice([1, 3, 30, 90]))) for _ in range(300)]
    texts += texts[:40] + [b"w0 " * 300, b""]  # copies tie
    df = collections.Counter(int(h) for t in texts for h in np.unique(topk.term_hashes(t.split())))
    lengths = np.array([len(t.split()) for t in texts])
    asked = asked_of(texts[:60], df, len(texts))
    shard = topk.Shard(topk.build(list(range(len(texts))), texts), lengths.mean())
    want = {}
    for at, i in enumerate(asked.ids):
        mine = slice(asked.cuts[at], asked.cuts[at + 1])
        weight = dict(zip(asked.terms[asked.which[mine]].tolist(), asked.weights[asked.which[mine]].tolist(), strict=True))
        scores = []
        for n, text in enumerate(texts):
            tf = collections.Counter(topk.term_hashes(text.split()).tolist())
            scores.append((-round(sum(w * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * lengths[n] / lengths.mean())) for t, w in weight.items() if t in tf), 9), n))
        want[at] = [(n, -s) for s, n in sorted(scores)[:10] if s < 0]
        assert i == asked.ids[at]
    for share in (None, 0.0, 0.9, 1.0, 1.01):  # of the tenth best score
        tenth = np.array([w[-1][1] if len(w) == 10 else 0.0 for _, w in sorted(want.items())])
        least = np.full(len(asked.ids), -1.0) if share is None else tenth * share
        query, ids, scores = shard.search_many(asked, 10, least)
        for at, best in want.items():
            got = list(zip(ids[query == at].tolist(), scores[query == at].tolist(), strict=True))
            expected = [(n, s) for n, s in best if s >= least[at] - 1e-9]
            assert [n for n, _ in got] == [n for n, _ in expected] and np.allclose([s for _, s in got], [s for _, s in expected], atol=2e-9, rtol=0)


def test_copies_in_several_shards_tie(monkeypatch):
    monkeypatch.setattr(topk, "PLACES", 14)  # differences by the order of summing show
    rnd = random.Random(4)
    words = [f"w{i}".encode() for i in range(2_000)]
    make = lambda: b" ".join(rnd.choice(words[: rnd.choice([5, 100, 2_000])]) for _ in range(rnd.choice([2, 60, 150])))
    copies = [make() for _ in range(60)]
    df = collections.Counter(int(h) for t in copies for h in np.unique(topk.term_hashes(t.split())))
    asked, got = asked_of(copies, df, 5_000), []
    for others, dear in ((200, 0), (1_500, 1e9)):  # all by postings, and common terms by a product
        monkeypatch.setattr(topk, "DEAR", dear)
        texts = copies + [make() for _ in range(others)]
        query, ids, scores = topk.Shard(topk.build(list(range(len(texts))), texts), 70.0).search_many(asked, len(texts), np.full(60, -1.0))
        got.append({(q, i): s for q, i, s in zip(query.tolist(), ids.tolist(), scores.tolist(), strict=True) if i < 60})
    assert len(got[0]) > 2_000 and got[0] == got[1]


def test_shards_return_only_rows_above_what_others_have(spark, monkeypatch):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rnd.choice(words[: rnd.choice([5, 50, 300])]) for _ in range(rnd.choice([8, 40])))) for i in range(1_500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    folders = {}
    monkeypatch.setattr(topk, "new_folder", lambda session, name, make=topk.new_folder: folders.setdefault(name, make(session, name)))
    index = topk.new_folder(spark, "bm25-index")
    topk.write_index(docs, index, 4_000)
    shards = spark.read.parquet(index).count()
    got = topk.search(spark, index, docs.where("doc_id % 100 = 0").selectExpr("doc_id as query_id", "text"))
    want = run_sql(spark, "op2_topk", documents=docs)
    assert cells(got.columns, got.collect()) == cells(want.columns, want.fetchall())
    # Each shard returned its ten best rows of each query before, so the rows to merge grew with queries times shards.
    assert shards > 30 and spark.read.parquet(folders["bm25-found"]).count() < shards * 15 * 10 / 2


def test_fixity_finds_the_damage(spark):
    records = spark.createDataFrame([(i, f"record {i}") for i in range(9_000)] + [(None, "x"), (5, "again"), (9_999, None)], "id long, payload string")
    second = records.where("id is null or id not in (17, 4097)").selectExpr("id", "case when id = 8000 then 'changed' else payload end as payload")
    second = second.union(spark.createDataFrame([(9_500, "more")], "id long, payload string"))
    a, b = fixity.audited_tree(records, "id", "payload", "ta"), fixity.audited_tree(second, "id", "payload", "tb")
    got = {(r["file"], r["key"]): r["status"] for r in fixity.audit(a, b).collect()}
    assert got == {(0, 17): "missing", (1, 1): "missing", (1, 8000 - 4096): "changed", (2, 9500 - 8192): "extra"}
    assert fixity.audit(a, a).count() == 0 and a[-1].count() == 4
    assert fixity.audit(fixity.audited_tree(records.limit(0), "id", "payload", "e"), fixity.audited_tree(records.limit(0), "id", "payload", "e")).count() == 0


def test_fixity_of_repeated_null_and_text_ids(spark):
    rows = [(None, f"p{i % 40}") for i in range(200)] + [(7, f"q{i}") for i in range(30)] + [(8, "same")] * 5 + [(9, None)]
    pages = spark.createDataFrame([(i, f"http://h/{p}", p) for i, p in rows], "page_id long, url string, html string")
    got = fixity.op3_query(pages).collect()
    assert len(got) == len(rows) and sum(r["page_id"] is None for r in got) == 200 and sum(r["page_id"] == 7 for r in got) == 30
    named = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z"), ("a", "x2")], "`a.b` string, payload string")
    lost = named.where("payload <> 'x2'")
    trees = [fixity.audited_tree(frame, "a.b", "payload", "named") for frame in (named, lost, named)]
    assert [r["status"] for r in fixity.audit(trees[0], trees[1]).collect()] == ["changed"] and fixity.audit(trees[0], trees[2]).count() == 0


def test_fixity_of_records_that_share_a_leaf(spark):
    """Equal records are ok, whatever became of others of their id or leaf; held against a comparison of all records."""
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "p"), (2, "p"), (2, "p"), (3, "k"), (None, "n"), (None, "m")], "id long, payload string")
    b = spark.createDataFrame([(1, "x"), (1, "damaged"), (2, "p"), (3, "k"), (3, "more"), (None, "n")], "id long, payload string")
    sides = [fixity.placed(f, "id", "payload") for f in (a, b)]
    trees = [fixity.tree_of(f, f"share{i}") for i, f in enumerate(sides)]
    found = fixity.findings(*map(fixity.counted, sides), fixity.audit(*trees))
    got = collections.Counter()
    for r in found.collect():
        for status in ("ok", "changed", "missing", "extra"):
            got[r["name"], status] += r[status]
    assert +got == collections.Counter({("1", "ok"): 1, ("1", "changed"): 1, ("2", "ok"): 1, ("2", "missing"): 2, ("3", "ok"): 1, ("3", "extra"): 1, ("", "missing"): 1})
    moved = fixity.with_offsets(fixity.leaves(sides[0])), fixity.with_offsets(fixity.leaves(sides[0].where("id = 2")))
    plain, placed = ([fixity.tree(m, p) for m in moved] for p in (False, True))
    status = lambda t: {(r["file"], r["key"]): r["status"] for r in fixity.audit(*t).collect()}
    assert (0, 2) not in status(plain) and status(placed)[0, 2] == "changed"


def test_fixity_of_many_text_ids(spark):
    """Text ids that share leaves: every damaged record is found and no other."""
    rnd = random.Random(1)
    rows = [(f"id-{rnd.randrange(8_000)}", f"body {rnd.randrange(3)}") for _ in range(10_000)]
    other = [(i, p + "!" if k % 97 == 3 else p) for k, (i, p) in enumerate(rows) if k % 89]
    sides = [fixity.placed(spark.createDataFrame(r, "id string, payload string"), "id", "payload", 2) for r in (rows, other)]
    trees = [fixity.tree_of(f, f"text{i}") for i, f in enumerate(sides)]
    found = fixity.findings(*map(fixity.counted, sides), fixity.audit(*trees)).groupBy("name").sum("changed", "missing", "extra").collect()
    got = {r["name"]: tuple(r)[1:] for r in found if any(tuple(r)[1:])}
    left, right = collections.Counter(rows), collections.Counter(other)
    over, under = collections.Counter(), collections.Counter()
    for record in left | right:
        over[record[0]] += max(0, left[record] - right[record])
        under[record[0]] += max(0, right[record] - left[record])
    want = {i: (pairs := min(over[i], under[i]), over[i] - pairs, under[i] - pairs) for i in over | under if over[i] or under[i]}
    assert got == want and len(want) > 150


def test_fixity_offsets_of_copies(spark, monkeypatch):
    monkeypatch.setattr(fixity, "COPIES", 3)
    pages = spark.createDataFrame([(8, "u", "same")] * 10 + [(8, "u", "other"), (9, "u", None)], "page_id long, url string, html string")
    got = sorted((r["offset"], r["length"]) for r in fixity.op3_query(pages).collect())
    assert len(got) == 12 and all(a + n == b for (a, n), (b, _) in zip(got, got[1:], strict=False)) and got[0][0] == 0
    assert fixity.files_for(10) == fixity.HASH_FILES and fixity.files_for(10**9) == 2**20


def test_fixity_query_equals_sql(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>é{i}</p>") for i in range(400)], "page_id long, url string, html string")
    want, got = run_sql(spark, "op3_fixity", pages=pages), fixity.op3_query(pages)
    assert cells(got.columns, got.collect()) == cells(want.columns, want.fetchall())
    assert got.where("status = 'missing'").count() > 0 and got.where("status = 'changed'").count() > 0


def test_warc_files_are_read(spark, tmp_path):
    body = b"".join(b"WARC/1.0\r\nContent-Length: %d\r\n\r\n" % len(b) + b + b"\r\n\r\n" for b in (b"one", b"", b"three"))
    (tmp_path / "a.warc").write_bytes(body)
    rows = fixity.read_warc(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [bytes(r["block"]) for r in rows] == [b"one", b"", b"three"] and rows[-1]["offset"] + rows[-1]["length"] == len(body)
    import gzip

    (tmp_path / "a.warc").write_bytes(gzip.compress(body[:-6]))
    cut = fixity.read_warc(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [r["header"] is None for r in cut] == [False, False, True] and sum(r["length"] for r in cut) == len(body) - 6


URLS = ["http://example.org/es/x", "https://a.example.org/en/12?page=2&ref=x", "http://Example.COM/de/1", "http://x.com/fr/", "http://notexample.org/es/1", "nourl", "", None, "http://m.x.net/a#top", "http://b.net/t?page=2&x=1&ref=y", "https://blog.x.net/en/123.html", "http://host", "http://h.net/a?page=1", "a://b://c.org/", "http://h.net/login", "http://h.net/xlogin", "http://h.org:80/", "http://h.net/p?UTM_SOURCE=1"]


def test_url_rules_equal_sql(spark):
    pages = spark.createDataFrame([*enumerate(URLS), (0, URLS[0]), (None, URLS[1])], "page_id long, url string")
    want, got = run_sql(spark, "op10_urlrules", pages=pages), urlrules.op10_query(pages)
    assert cells(got.columns, got.collect()) == cells(want.columns, want.fetchall())
    assert urlrules.op10_query(pages.limit(0)).count() == 0
    verdicts = {r["page_id"]: (r["rule"], r["verdict"]) for r in got.collect()}
    assert verdicts[0] == ("example.org/es/", "block") and verdicts[2] == ("com/de/", "block") and verdicts[4] == ("org/", "allow") and verdicts[9][1] == "block"
    tokens = spark.createDataFrame([("page",), ("page",), ("ref",), ("tag",), ("utm",), ("source",)], "token string")
    index = {r["name"]: r["token"] for r in urlrules.filed(tokens, urlrules.rule_table(spark, urlrules.PATTERNS)).collect()}
    assert len(index) == len(urlrules.PATTERNS) and index["paged-referral"] == "ref" and index["first-page"] == "1" and index["campaign"] == "source"
    assert {r["url"]: r["patterns"] for r in urlrules.judged(pages).collect()}[URLS[8]] == ["mobile-top"]
    assert urlrules.judged(pages, patterns=()).count() == pages.count()


def test_many_url_rules(spark):
    rules = tuple(urlrules.PatternRule(f"r{i}", "block", (f"word{i}", "net"), rf"net/(?:page/)?word{i}(?:/|$)") for i in range(50_000))
    pages = spark.createDataFrame([(1, "http://a.net/word77/"), (2, "http://a.net/word77x/"), (3, "http://a.net/page/word49999"), (4, None)], "page_id long, url string")
    got = {r["page_id"]: (r["patterns"], r["verdict"]) for r in urlrules.judged(pages, patterns=rules).collect()}
    assert got == {1: (["r77"], "block"), 2: ([], "allow"), 3: (["r49999"], "block"), 4: ([], "allow")}


@pytest.mark.parametrize("rule", urlrules.PATTERNS, ids=lambda r: r.name)
def test_every_match_holds_the_rules_tokens(rule):
    import re

    samples = ["http://x.net/a?page=12&ref=q", "http://x/?utm_source=a", "http://x/?fbclid=1", "http://x/;sessionid=1a", "http://x/print", "http://x/login", "http://x/cart/add", "http://x/tag/a/page/3", "http://x/feed", "https://blog.a.b/en/123.html", "https://m.a.b/x#top", "http://x/?page=1"]
    samples += [s + more for s in samples for more in ("5", "x", "&x", "/y", "?page=1")]
    matched = [s for s in samples if re.search(rule.pattern, s)]
    assert matched
    for s in matched:
        assert set(rule.tokens) <= set(re.findall("[a-z0-9]+", s))
