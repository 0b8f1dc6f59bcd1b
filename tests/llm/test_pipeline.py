import corpus_pipeline
import regex
from pyspark.sql import functions as F

from tickloom.llm import catalog, decontaminate, jaccard, langid, secrets
from tickloom.llm.common import table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf).cache()
        assert after.columns == columns and after.dtypes == docs.dtypes, name
        kept = {r["doc_id"] for r in after.select("doc_id").collect()}
        assert kept <= {r["doc_id"] for r in before.select("doc_id").collect()}
        if name == "language_id":
            judged = langid.identify(before, langid.fit(before.where(~langid.held_out())))
            assert kept == {r["doc_id"] for r in judged.where("lang_pred <> 'und' and score >= 0.5").collect()}
        elif name == "near_duplicates":
            assert kept == {r["component_id"] for r in jaccard.op6_query(before).collect()}
        elif name == "decontamination":
            bad = {r["doc_id"] for r in decontaminate.op1_query(before, table(spark, sf, "benchmark")).where("contaminated").collect()}
            assert bad and kept == {r["doc_id"] for r in before.collect()} - bad
        else:
            found = {r["doc_id"]: r["spans"] for r in secrets.op5_query(before).collect()}
            texts = {r["doc_id"]: r["text"] for r in before.collect()}
            assert any(found.values()) and kept == set(texts)
            assert all((r["text"] == texts[r["doc_id"]]) == (not found[r["doc_id"]]) for r in after.collect())
            assert after.where(F.length("text") != F.col("n_chars")).count() == before.where(F.length("text") != F.col("n_chars")).count()
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    assert out.count() == before.count() and out.where("n_tokens <> size(ids)").count() == 0
    assert corpus_pipeline.run(spark, sf).count() == out.count()


def test_empty_and_awkward_documents(spark, sf, docs, empty):
    """Against brute force: with one language only what has no letter goes; of each component of links the smallest id stays."""
    for given in (docs, empty):
        frame = given.withColumn("lang", F.lit("en"))
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, sf)
        texts = given.select("doc_id", "text").collect()
        lettered = sorted(((r["doc_id"], r["text"]) for r in texts if r["text"] and langid.LETTERS.search(r["text"])), key=lambda r: (r[0] is None, r[0] or 0))
        sets = [brute_shingles(text) for _, text in lettered]
        groups: list[set[int]] = []
        for i, mine in enumerate(sets):
            linked = [g for g in groups if any(100 * len(mine & sets[j]) >= 75 * len(mine | sets[j]) for j in g)]
            groups = [g for g in groups if g not in linked] + [set().union({i}, *linked)]
        assert sorted(map(str, (r["doc_id"] for r in frame.collect()))) == sorted(str(lettered[min(g)][0]) for g in groups)


def brute_shingles(text):
    words = regex.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def test_stages_keep_columns_of_any_name(spark, sf, docs):
    """Columns named like helpers, with dots or back-ticks, come out of every stage as they went in."""
    odd = ["score", "lang_pred", "ids", "__text", "__text_hash", "__hash", "__before", "__spans", "__merged", "__m_hex", "__id", "secret_spans", "a.b", "c`d"]
    frame = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).withColumn("lang", F.lit("en"))
    for name in odd:
        frame = frame.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, sf)
        assert frame.columns == columns, name
        for r in frame.collect():
            assert all(r[c] == f"{c}{r['doc_id']}" for c in odd), name
    assert corpus_pipeline.STAGES[-1][1](spark, frame, sf).count() == frame.count() > 5
    queries = {"op1_decontaminate": lambda d: decontaminate.op1_query(d, table(spark, sf, "benchmark")), "op4_langid": langid.op4_query, "op5_secrets": secrets.op5_query, "op6_jaccard": jaccard.op6_query}
    for name, query in queries.items():
        assert query(frame).count() == frame.count(), name


def test_catalogue_is_complete():
    names = set(catalog.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(catalog.oracle_sql()) <= names
