"""Ranked lexical search: document-at-a-time merging of compressed postings in each shard, merged exactly over shards.

A shard is up to ``SHARD_BYTES`` of consecutive texts of one input partition, so indexing moves no texts. Its documents are numbered in
order of doc_id. A term's postings are blocks of up to ``POSTINGS`` documents: the gaps of their numbers and their frequencies, each
packed in the least whole number of bytes, compressed together. A shard is one row: terms, offsets, postings, and the documents'
ids and lengths.

Search. Every term of an item is a cursor that holds one decoded block of its list. The cursors lie in a heap by the last document of
their blocks. The heap's first names the document up to which every list is decoded: all cursors' postings up to it are scored,
document by document in order, and the cursors at their blocks' ends read the next one. The ``k`` best so far lie in a heap of bounded
size, its worst on top; since documents come in order of doc_id, a later one takes a place by a higher score only. All arithmetic is that of the
scoring rule, in 64-bit integers. Each shard gives its ``k`` best for every item, by global document frequencies, numbers and lengths, so the
best of all shards' best are exact.

Items pass the driver as terms and weights in blocks of about ``BLOCK_BYTES`` (an item is not cut, so a block holds one very large item at
least), and only one block is broadcast at a time.

Terms are the words of decontaminate.words_of. Defined results: a null or empty document has no terms: it counts nowhere and is never
found; an item without terms, or without any in the documents, has no rows; rows of one item_id are one item with all their terms, and
rows without an item_id are one too; repeated documents are found as often as they occur; a null doc_id comes last among equal scores; very
long texts are indexed whole; empty tables give no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import arrow_rows, new_folder, only, worker_keeps, written
from tickloom.llm.decontaminate import words_of

K = 10
#: The scoring rule's constants.
B_PERCENT, TF_SCALE, TF_STEP, M_STEP = 75, 1_000_000_000, 1_000, 8

SHARD_BYTES = 16_000_000
POSTINGS = 4_096
BLOCK_BYTES = 4_000_000
#: Blocks of more bytes are compressed.
PLAIN_BYTES = 64
ARROW_ROWS = 500
NULL_ID = 2**63 - 1


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers in the least number of bytes, 1, 2, 4 or 8, named by the first byte."""
    most = int(values.max(initial=0))
    size = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def _wide(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    size = data[at]
    return np.frombuffer(data, f"<u{size}", n, at + 1).astype(np.int64), at + 1 + n * size


def pack(rows: np.ndarray, tf: np.ndarray) -> bytes:
    """One block of postings: its number, rows as gaps, frequencies."""
    gaps = np.diff(rows, prepend=rows[0])
    gaps[0] = rows[0]
    return struct.pack("<I", len(rows)) + _narrow(gaps) + _narrow(tf)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    (n,) = struct.unpack_from("<I", data)
    gaps, at = _wide(data, 4, n)
    return np.cumsum(gaps), _wide(data, at, n)[0]


def _bytes_of(most: np.ndarray) -> np.ndarray:
    """The least numbers of bytes that ``_narrow`` packs values in, by the largest of each list."""
    return 1 << np.searchsorted([1 << 8, 1 << 16, 1 << 32], most, "right")


def posting_lists(row: np.ndarray, tf: np.ndarray, df: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All terms' lists one after another, and their sizes; ``row`` and ``tf`` term by term, ``df`` how many of them each term has.

    A list is blocks of ``POSTINGS``, each with its size and whether it is compressed: short ones cost more compressed than plain. Most terms are
    rare, so short lists of the same shape are packed together, as the rows of one array.
    """
    if not len(df):
        return b"", df
    starts = np.concatenate(([0], np.cumsum(df)))
    gaps = np.diff(row, prepend=0)
    gaps[starts[:-1]] = row[starts[:-1]]
    wide_gap, wide_tf = _bytes_of(np.maximum.reduceat(gaps, starts[:-1])), _bytes_of(np.maximum.reduceat(tf, starts[:-1]))
    sizes = 11 + df * (wide_gap + wide_tf)
    short = (sizes - 5 <= PLAIN_BYTES) & (df <= POSTINGS)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    long = {}
    for i in np.flatnonzero(~short).tolist():
        blocks = [pack(row[a : min(a + POSTINGS, starts[i + 1])], tf[a : min(a + POSTINGS, starts[i + 1])]) for a in range(starts[i], starts[i + 1], POSTINGS)]
        blocks = [b"\1" + squeeze(b) if len(b) > PLAIN_BYTES else b"\0" + b for b in blocks]
        long[i] = b"".join(struct.pack("<I", len(b)) + b for b in blocks)
        sizes[i] = len(long[i])
    at = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(at[-1], np.uint8)
    for i, data in long.items():
        out[at[i] : at[i + 1]] = np.frombuffer(data, np.uint8)
    some = np.flatnonzero(short)
    shape = (df[some] * 16 + wide_gap[some]) * 16 + wide_tf[some]
    some = some[np.argsort(shape, kind="stable")]
    _, counts = np.unique(shape, return_counts=True)
    for terms in np.split(some, np.cumsum(counts)[:-1]) if len(some) else []:
        n, g, f = int(df[terms[0]]), int(wide_gap[terms[0]]), int(wide_tf[terms[0]])
        held = starts[terms][:, None] + np.arange(n)
        block = np.empty((len(terms), 11 + n * (g + f)), np.uint8)
        block[:, :10] = np.frombuffer(struct.pack("<IBIB", 7 + n * (g + f), 0, n, g), np.uint8)
        block[:, 10 : 10 + n * g] = gaps[held].astype(f"<u{g}").view(np.uint8)
        block[:, 10 + n * g] = f
        block[:, 11 + n * g :] = tf[held].astype(f"<u{f}").view(np.uint8)
        out[at[terms][:, None] + np.arange(block.shape[1])] = block
    return out.tobytes(), sizes


def build(ids: list[int | None], texts: list[bytes]) -> dict[str, object]:
    """A shard's row, or an empty one where no text has a term."""
    codes: dict[bytes, int] = {}
    number = codes.setdefault
    held = [[number(w, len(codes)) for w in words_of(t)] for t in texts]
    some = [i for i, h in enumerate(held) if h]
    some.sort(key=lambda i: NULL_ID if ids[i] is None else ids[i])
    lengths = np.array([len(held[i]) for i in some], np.int64)
    flat = np.fromiter(itertools.chain.from_iterable(held[i] for i in some), np.int64, int(lengths.sum()))
    del held
    # Term by term, and in it row by row: the key's order is the postings' order.
    key, tf = np.unique(flat * max(len(some), 1) + np.repeat(np.arange(len(some)), lengths), return_counts=True)
    del flat
    term, row = key // max(len(some), 1), key % max(len(some), 1)
    df = np.bincount(term, minlength=len(codes))
    squeeze = zstandard.ZstdCompressor(level=1).compress
    postings, sizes = posting_lists(row, tf, df)
    given = np.array([NULL_ID if ids[i] is None else ids[i] for i in some], np.int64)
    nulls = np.array([ids[i] is None for i in some], bool)
    return {
        "rows": len(some), "length": int(lengths.sum()), "terms": squeeze(b"\n".join(codes)), "df": squeeze(df.astype("<i8").tobytes()), "sizes": squeeze(sizes.astype("<i8").tobytes()),
        "postings": postings, "documents": squeeze(given.tobytes() + lengths.tobytes() + nulls.tobytes()),
    }


INDEX = "rows long, length long, terms binary, df binary, sizes binary, postings binary, documents binary"


def write_index(docs: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> None:
    """Indexes every row of (doc_id, text) into ``folder``."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps("lexical")
        ids: list[int | None] = []
        texts: list[bytes] = []
        held = 0

        def shard() -> pa.RecordBatch:
            made = build(ids, texts)
            return pa.RecordBatch.from_pylist([made], pa.schema([("rows", pa.int64()), ("length", pa.int64()), *[(n, pa.binary()) for n in ("terms", "df", "sizes", "postings", "documents")]]))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_py()
                if data:
                    ids.append(doc_id)
                    texts.append(data)
                    held += len(data)
                if held >= shard_bytes:
                    yield shard()
                    ids, texts, held = [], [], 0
        if texts:
            yield shard()

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        plain.mapInArrow(index, INDEX).where("rows > 0").write.parquet(folder)


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i8")


class Cursor:
    """A term's list in a shard, one block decoded at a time."""

    def __init__(self, data: bytes, at: int, end: int, weight: int, times: int, m: np.ndarray):
        self.data, self.at, self.end, self.factor, self.m = data, at, end, weight * times, m
        self.next_block()

    def next_block(self) -> bool:
        """Decodes the next block; false at the list's end."""
        if self.at >= self.end:
            self.rows = self.scores = None
            return False
        (size,) = struct.unpack_from("<I", self.data, self.at)
        block = self.data[self.at + 5 : self.at + 4 + size]
        if self.data[self.at + 4]:
            block = zstandard.ZstdDecompressor().decompress(block)
        self.rows, tf = unpack(block)
        self.scores = self.factor * ((TF_SCALE * tf) // (TF_STEP * tf + M_STEP * self.m[self.rows]))
        self.at += 4 + size
        return True

    def take(self, last: int) -> tuple[np.ndarray, np.ndarray]:
        """The block's postings up to a row; what is beyond stays."""
        n = len(self.rows) if self.rows[-1] <= last else int(np.searchsorted(self.rows, last, "right"))
        rows, scores = self.rows[:n], self.scores[:n]
        self.rows, self.scores = self.rows[n:], self.scores[n:]
        return rows, scores


class Shard:
    """An index row, opened for search by the corpus's numbers."""

    def __init__(self, row: dict[str, object], total_rows: int, total_length: int):
        self.place = {t: i for i, t in enumerate(zstandard.ZstdDecompressor().decompress(row["terms"]).split(b"\n"))}
        self.ends = np.concatenate(([0], np.cumsum(_numbers(row["sizes"]))))
        self.data = row["postings"]
        n = row["rows"]
        documents = zstandard.ZstdDecompressor().decompress(row["documents"])
        self.ids, lengths = np.frombuffer(documents, np.int64, n), np.frombuffer(documents, np.int64, n, 8 * n)
        self.nulls = np.frombuffer(documents, bool, n, 16 * n)
        # The rule's product leaves 64 bits where a text's length times the number of texts is very large.
        exact = lengths if int(lengths.max(initial=0)) * total_rows * B_PERCENT < 2**63 else lengths.astype(object)
        self.m = (100 - B_PERCENT + (B_PERCENT * exact * total_rows) // max(total_length, 1)).astype(np.int64)

    def search(self, terms: list[tuple[bytes, int, int]], k: int = K) -> list[tuple[int, int]]:
        """(score, row) of the k best for (term, weight, times), best first."""
        cursors = []
        for term, weight, times in terms:
            i = self.place.get(term)
            if i is not None:
                cursors.append(Cursor(self.data, int(self.ends[i]), int(self.ends[i + 1]), weight, times, self.m))
        ends = [(int(c.rows[-1]), i) for i, c in enumerate(cursors)]
        heapq.heapify(ends)
        best: list[tuple[int, int]] = []  # (score, -row): the worst on top
        done = -1
        while ends:
            last = ends[0][0]
            parts = [c.take(last) for c in cursors if c.rows is not None and len(c.rows)]
            while ends and ends[0][0] == last:
                _, i = heapq.heappop(ends)
                if cursors[i].next_block():
                    heapq.heappush(ends, (int(cursors[i].rows[-1]), i))
            sums = np.zeros(last - done, np.int64)
            for rows, scores in parts:
                sums[rows - done - 1] += scores  # a list has a row once
            least = best[0][0] if len(best) == k else 0
            better = np.flatnonzero(sums > least)
            if len(better) > k:
                better = np.sort(better[np.lexsort((better, -sums[better]))[:k]])
            for at in better.tolist():
                found = (int(sums[at]), -(done + 1 + at))
                if len(best) < k:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)
            done = last
        return [(score, -row) for score, row in sorted(best, reverse=True)]


def _terms_of(items: DataFrame) -> DataFrame:
    """(item, term, times) of each (item_id, text); item is the id as text."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(text.as_py())
                if words:
                    yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(words), pa.string()), pa.array(words, pa.binary())], ["item", "term"])

    plain = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text"))
    return plain.mapInArrow(terms, "item string, term binary").groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))


def search(folder: str, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of the index for each (item_id, text)."""
    spark = items.sparkSession
    index = spark.read.schema(INDEX).parquet(folder)
    total = index.agg(F.sum("rows").alias("rows"), F.sum("length").alias("length")).first()
    rows, length = total["rows"] or 0, total["length"] or 0
    asked = written(_terms_of(items), "lexical-terms")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, df in zip(batch.column(0), batch.column(1), strict=True):
                words = zstandard.ZstdDecompressor().decompress(terms.as_py()).split(b"\n")
                counts = _numbers(df.as_py())
                for i in range(0, len(words), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 50_000], pa.binary()), pa.array(counts[i : i + 50_000])], ["term", "df"])

    wanted = asked.select("term").distinct()
    df = index.select("terms", "df").mapInArrow(frequencies, "term binary, df long").join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2 * rows + 2).cast("double")) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighted = asked.join(df.select("term", weight.alias("weight")), "term")
    size = asked.agg(F.sum(F.octet_length("term") + 24)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    listed = written(weighted.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("term", "weight", "times"))).alias("terms")).withColumn("block", block), "lexical-items")
    found = new_folder(spark, "lexical-found")
    schema = "item string, doc_id long, score long"
    for b in range(blocks):
        shared = spark.sparkContext.broadcast([(r["item"], [(bytes(t["term"]), t["weight"], t["times"]) for t in r["terms"]]) for r in listed.where(F.col("block") == b).toLocalIterator()])

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            worker_keeps("lexical")
            for batch in batches:
                for row in batch.to_pylist():
                    shard = Shard(row, rows, length)
                    out = [(item, None if shard.nulls[at] else int(shard.ids[at]), score) for item, terms in shared.value for score, at in shard.search(terms, k)]
                    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())], ["item", "doc_id", "score"])

        with arrow_rows(spark, 4):
            index.select("rows", "terms", "sizes", "postings", "documents").mapInArrow(best, schema).write.mode("append").parquet(found)
        shared.destroy()
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    ranked = spark.read.schema(schema).parquet(found).withColumn("rank", rank).where(F.col("rank") <= k)
    kind = items.schema["item_id"].dataType
    return ranked.select(F.col("item").cast(kind).alias("item_id"), "rank", "doc_id", "score")


def op13_query(docs: DataFrame, benchmark: DataFrame, k: int = K) -> DataFrame:
    folder = new_folder(docs.sparkSession, "lexical-index")
    write_index(docs, folder)
    return search(folder, only(benchmark, "item_id", "text"), k)


def op13_sql(k: int = K) -> str:
    """The same by scoring every document that shares a term with an item."""
    words = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
with d as (select row_number() over () as r, doc_id, {words} as ws from documents),
l as (select r, doc_id, len(ws) as n from d where len(ws) > 0),
z as (select cast(count(*) as bigint) as nn, cast(sum(n) as bigint) as ll from l),
t as (select r, w, count(*) as tf from (select r, unnest(ws) as w from d) group by all),
f as (select w, cast(floor(1000 * ln((2 * (select nn from z) + 2)::double / (2 * count(*) + 1)::double)) as bigint) as weight from t group by w),
q as (select item_id, w, count(*) as times from (select item_id, unnest({words}) as w from benchmark) group by all),
s as (select item_id, r, cast(sum(times * weight * (({TF_SCALE} * tf) // ({TF_STEP} * tf + {M_STEP} * ({100 - B_PERCENT} + ({B_PERCENT} * n * nn) // ll)))) as bigint) as score
  from q join t using (w) join f using (w) join l using (r), z group by all),
o as (select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank, doc_id, score from s join l using (r) where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from o where rank <= {k}
"""
