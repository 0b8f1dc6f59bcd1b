"""Resampling documents towards a target distribution: hashed n-gram importance weights and an exact draw without replacement.

Words are those of decontaminate.words_of. A document's features are its runs of ``least`` to ``most`` consecutive words, joined by one
space, repeats counted; a feature's bucket is the CRC-32 of its UTF-8 bytes modulo ``buckets``. A bucket's gain compares its share of
the target texts with its share of all documents (both plus one), as a floored integer; the gains are one array, and a document's
weight is the floored mean of the array over its features. A Gumbel draw from a hash of the document's id is added, so that the
highest scores are a sample without replacement in proportion to the weights' exponentials.

The draw is exact and sorts nothing as a whole. Scores are integers, so all of them fit in a histogram: weights and draws have a few
tens of thousands of values each way (a gain is a logarithm), whatever the number of documents. Counts summed from the top give each
score the number of documents above it, and the score at which the draw ends. Only documents from that score up are placed: by id
within their score, plus the score's offset. Rows of one score and id are told apart by their place in the written table and counted
in runs of ``RUN`` first, so no place is found by sorting many equal rows in one task.

What the driver holds: two arrays of ``buckets`` counts, and the histogram of scores.

Defined results: null and empty texts have no features and weight 0; a null id is drawn with the hash of an empty id and comes last
among equal scores; repeated rows are rows of their own, each with its own rank; equal scores go to the smaller id, and of
rows with one id to the one with fewer features; an empty target or table gives gains all the same (counts plus one), and an empty
table no rows; very long texts are counted whole; other columns, whatever their names, are kept, and an added column of a kept one's
name gets underscores before it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import arrow_rows, free_names, mapped, quoted, worker_keeps, written
from tickloom.llm.decontaminate import words_of

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
ADDED = ("n_features", "weight", "score", "rank")

#: Rows of equal score and id are counted in runs of so many places of the written table.
RUN = 65_536
ARROW_ROWS = 1_000
#: A worker forgets the buckets of words when it knows so many.
KNOWN = 1_000_000


class _Buckets(dict):
    """Buckets of features, found once each."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[feature] = found = zlib.crc32(feature) % self.buckets
        return found


def features_of(words: list[bytes], least: int, most: int) -> list[bytes]:
    """All runs of ``least`` to ``most`` consecutive words, joined by one space."""
    if least == most == 1:
        return words
    return [b" ".join(words[i : i + n]) for n in range(least, most + 1) for i in range(len(words) - n + 1)]


def _bucketed(texts: pa.Array, known: _Buckets, least: int, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each text: its number of words, and its features' buckets."""
    for text in texts:
        words = words_of(text.as_py())
        features = features_of(words, least, most)
        yield len(words), np.fromiter(map(known.__getitem__, features), np.int64, len(features))


def histogram(texts: DataFrame, buckets: int = BUCKETS, least: int = 1, most: int = 1) -> np.ndarray:
    """How often each bucket occurs in (text): counted in each task first, ``buckets`` rows a task at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_keeps(("resample", buckets), lambda: _Buckets(buckets))
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, at in _bucketed(batch.column(0), known, least, most):
                counts += np.bincount(at, minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["bucket", "n"])

    with arrow_rows(texts.sparkSession, ARROW_ROWS):
        found = texts.select(F.col("text").cast("binary")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for row in found:
        out[row["bucket"]] = row["n"]
    return out


def gains_of(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Each bucket's floored log ratio of shares, in thousandths."""
    t, s, size = float(target.sum()), float(source.sum()), float(len(source))
    return np.array([math.floor(1000 * math.log((a + 1.0) * (s + size) / ((b + 1.0) * (t + size)))) for a, b in zip(target.tolist(), source.tolist(), strict=True)], np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, n_words: str, n_features: str, weight: str, least: int = 1, most: int = 1) -> DataFrame:
    """All columns and three more: words, features, and the floored mean of the gains of the features."""
    buckets, place = len(gains), docs.columns.index("text")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_keeps(("resample", buckets), lambda: _Buckets(buckets))
        for batch in batches:
            texts = batch.column(place)
            held = [(words, len(at), int(gains[at].sum()) // len(at) if len(at) else 0) for words, at in _bucketed(texts.cast(pa.binary()), known, least, most)]
            added = [pa.array([h[i] for h in held], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [f"c{i}" for i in range(batch.num_columns + 3)])

    return mapped(docs, weigh, **{n_words: "long", n_features: "long", weight: "long"})


def gumbel(doc_id: F.Column, seed: int = SEED) -> F.Column:
    """A document's draw in thousandths, from the first eight hex digits of a SHA-256 of the seed and its id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, draw: int, counts: dict[int, int]) -> DataFrame:
    """Adds ``rank``, null beyond the first ``draw``, to rows with score, doc_id, n_features, eligible and their place ``at``.

    counts: how many eligible rows have each score.
    """
    spark, above, offsets = scored.sparkSession, 0, []
    for score in sorted(counts, reverse=True):
        if above >= draw:
            break
        offsets.append((score, above))
        above += counts[score]
    cutoff = offsets[-1][0] if offsets else 0
    reaches = F.col("eligible") & (F.col("score") >= cutoff) if offsets else F.lit(False)
    rest = scored.where(~reaches).withColumn("rank", F.lit(None).cast("long"))
    shared = F.broadcast(spark.createDataFrame(offsets, "score long, above long"))  # no more rows than scores
    run = (F.col("at") / RUN).cast("long").alias("run")
    key = ["score", "doc_id", "n_features", "run"]
    upper = scored.where(reaches).withColumn("run", run)
    # Runs of rows that nothing but their place tells apart: few more than the rows' ids, and fewer where ids repeat.
    order = [F.col("doc_id").asc_nulls_last(), "n_features", "run"]
    before = Window.partitionBy("score").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    runs = upper.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    runs = runs.join(shared, "score").withColumnsRenamed({c: f"__{c}" for c in key})
    met = upper.join(runs, [upper[c].eqNullSafe(runs[f"__{c}"]) for c in key])
    place = F.row_number().over(Window.partitionBy(*key).orderBy("at"))
    rank = F.col("above") + F.col("before") + place
    placed = met.withColumn("rank", F.when(rank <= draw, rank).cast("long"))
    return rest.unionByName(placed.select(*rest.columns))


def resampled(
    docs: DataFrame, target: DataFrame, columns: list[str] | None = None, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, least: int = 1, most: int = 1, seed: int = SEED,
) -> DataFrame:
    """Every row of (doc_id, text, ...) with n_features, weight, score and rank: 1, 2, 3... for the drawn, else null.

    target: (text). columns: what to keep of the rows, all without it. ``drawn`` gives the drawn rows alone.
    """
    spark = docs.sparkSession
    gains = gains_of(histogram(target, buckets, least, most), histogram(docs, buckets, least, most))
    keep = list(columns or docs.columns)
    wanted = [c for c, name in zip(quoted(docs), docs.columns, strict=True) if name in keep]
    plain = docs.select("doc_id", "text", *wanted).toDF("doc_id", "text", *[f"k{i}" for i in range(len(wanted))])
    with arrow_rows(spark, ARROW_ROWS):
        found = weighted(plain, gains, "words", "n_features", "weight", least, most)
        found = found.withColumns({"score": F.col("weight") + gumbel(F.col("doc_id"), seed), "eligible": F.col("words") >= least_words, "at": F.monotonically_increasing_id()})
        held = written(found.drop("text", "words"), "resample")
    counts = {r["score"]: r["n"] for r in held.where("eligible").groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()}
    placed = ranked(held, sum(counts.values()) * percent // 100, counts)
    names = [name for name in docs.columns if name in keep]
    return placed.select(*[F.col(f"k{i}").alias(name) for i, name in enumerate(names)], *[F.col(c).alias(name) for c, name in zip(ADDED, added_names(docs, names), strict=True)])


def added_names(docs: DataFrame, keep: list[str]) -> list[str]:
    """What the added columns are called beside those kept."""
    held, free = {c.lower() for c in keep}, free_names(docs, *ADDED)
    return [other if name in held else name for name, other in zip(ADDED, free, strict=True)]


def drawn(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows as they were, in no order."""
    found = resampled(docs, target, **options)
    return found.where(F.col(found.columns[-1]).isNotNull()).select(*quoted(found)[: -len(ADDED)])


def op11_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resampled(docs, benchmark, ["doc_id"])


def op11_sql() -> str:
    """The same from word counts; CRC-32 by its table of 256 values, made from the polynomial."""
    word = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    turn = "case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end"
    table = "select b, b as a, 0 as k from (select cast(unnest(range(256)) as bigint) as b)"
    return f"""
with recursive r as ({table} union all select b, {turn}, k + 1 from r where k < 8),
c as (select list(a order by b) as t from r where k = 8),
d as (select row_number() over () as r, doc_id, coalesce({word}, []) as ws from documents),
dw as (select r, unnest(ws) as w from d),
sw as (select w, count(*) as n from dw group by w),
tw as (select w, count(*) as n from (select unnest({word}) as w from benchmark) group by w),
u as (select w, hex(encode(w)) as h from (select w from sw union select w from tw)),
b as (select w, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(h) // 2 + 1), lambda i: cast('0x' || substr(h, 2 * i - 1, 2) as bigint))),
  lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295) % {BUCKETS} as bucket from u, c),
s as (select bucket, sum(n) as n from sw join b using (w) group by bucket),
t as (select bucket, sum(n) as n from tw join b using (w) group by bucket),
z as (select cast((select coalesce(sum(n), 0) from s) as double) as s, cast((select coalesce(sum(n), 0) from t) as double) as t),
g as (select bucket, cast(floor(1000 * ln((coalesce(t.n, 0) + 1.0::double) * (z.s + {BUCKETS}) / ((coalesce(s.n, 0) + 1.0::double) * (z.t + {BUCKETS})))) as bigint) as gain from s left join t using (bucket), z),
m as (select r, cast(sum(gain) as bigint) as gains, count(*) as n from dw join b using (w) join g using (bucket) group by r),
p as (select d.r, doc_id, coalesce(n, 0) as n_features, coalesce(cast(floor(gains / n) as bigint), 0) as weight,
  cast(('0x' || substr(sha256('{SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, 8)) as bigint) as h from d left join m using (r)),
q as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))) as bigint) as score from p),
o as (select r, row_number() over (order by score desc, doc_id nulls last, n_features) as rank, count(*) over () as n from q where n_features >= {LEAST_WORDS})
select doc_id, n_features, weight, score, case when rank <= {PERCENT} * n // 100 then rank end as rank from q left join o using (r)
"""
