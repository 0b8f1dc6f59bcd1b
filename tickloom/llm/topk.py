"""Exact BM25 top-k search: sharded inverted indexes, scores by products and postings above a known bound, merged exactly.

Rows are dealt by hash into shards of about ``SHARD_BYTES`` of text. A shard's index is one compressed row of arrays: its
terms (64-bit hashes), their postings (row numbers and frequencies), and the rows' ids and lengths. Rows of a shard are
numbered so that rows with the same commonest word and like length lie together, which makes blocks of rows uneven, and
so worth skipping. Document frequencies, the number of rows and the mean length are summed over all shards first, so each
shard's scores are the global ones and the k best of all shards' k best are exact.

Search, for queries in a shard. Whole texts as queries hold words of nearly every row, and bounds of blocks save them nothing
(93 % of their postings lay in blocks that had to be opened, even with the final k-th best score known). So all their
terms are added up, as cheaply as may be: for a batch of queries with like terms, those in a ``COMMON``-th of the
rows or more that the batch asks for often enough (a posting costs about ``DEAR`` multiplications) are one product in single precision; postings of
all others are added at once. Rows that can reach the bound, with ``SINGLE`` to spare, are scored again in double precision, the terms
in the order of their hashes, so every score that is returned is exact and copies of a text tie. Tables by row are bounded by ``CELLS``.
Queries of at most ``FEW`` terms go by block maxima: each (term, block of ``BLOCK`` rows) has the largest impact of the term in the
block; a block's bound is the best common part of its rows plus the sum of the terms' maxima. Blocks are
opened from the highest bound down, in growing batches, and postings of blocks whose bound is below the k-th best
score so far are never read.

What a row must reach: as many shards as the square root of their number are searched first, and the k-th best score that they have for a
query bounds what the other shards look for, as does the k-th best of the shards that a task has searched before. So most shards return
nothing for most queries. Queries come in blocks of about ``QUERY_BLOCK`` queries and
``QUERY_TERMS`` terms at most; the index is read once a block, and only one block is broadcast at a time. The work is still queries
times rows, so it grows with the square of a table whose queries grow with it.

Terms are the words of decontaminate.words_of. A query is its text's set of terms. Scores are rounded to 9 places; ties go
to the smaller id. Defined results: null and empty texts are rows without terms: they count in N and the mean length, never
match, and as queries have no results; repeated rows are found as often as they occur; queries of one id are one query with the
terms of all of them; a null id sorts last; very long texts are indexed and asked whole; an empty table has no results. Ids are
numbers (another type that casts to long will do).
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import new_folder, worker_keeps, written
from tickloom.llm.decontaminate import words_of

K1, B = 1.2, 0.75
SHARD_BYTES = 12_000_000
QUERY_BLOCK = 8_192
QUERY_TERMS = 2_000_000
BLOCK = 64
DENSE, COMMON = 1_024, 24
BATCH = 256
DEAR = 240  # what adding up a posting costs, in multiplications of a product
POSTINGS = 50_000
CELLS = 4_000_000
FEW = 4
SINGLE = 1e-4  # more than single precision loses over DENSE terms, relatively
PLACES = 9
NULL_ID = 2**63 - 1


def _pack(arrays: list[np.ndarray]) -> bytes:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    parts = [squeeze(a.tobytes()) for a in arrays]
    return struct.pack("<I", len(parts)) + b"".join(struct.pack("<4sQ", a.dtype.str.encode().ljust(4), len(p)) for a, p in zip(arrays, parts, strict=True)) + b"".join(parts)


def _unpack(data: bytes) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<I", data)
    heads = [struct.unpack_from("<4sQ", data, 4 + 12 * i) for i in range(n)]
    at, out = 4 + 12 * n, []
    for kind, size in heads:
        out.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at : at + size]), np.dtype(kind.decode().strip())))
        at += size
    return out


def term_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def build(ids: list[int | None], texts: list[bytes | None]) -> bytes:
    """A shard's index."""
    held = [term_hashes(words_of(t)) for t in texts]
    lengths = np.array([len(h) for h in held], np.int64)
    flat = np.concatenate(held) if held else np.zeros(0, np.uint64)
    terms, inverse = np.unique(flat, return_inverse=True)
    del flat, held[:]
    rows = len(lengths)
    inverse += np.repeat(np.arange(rows), lengths) * max(len(terms), 1)
    pairs, tf = np.unique(inverse, return_counts=True)
    del inverse
    row, term = pairs // max(len(terms), 1), pairs % max(len(terms), 1)
    del pairs
    df = np.bincount(term, minlength=len(terms))
    # Rows with the same commonest term (by frequency in the row, then in the shard), then of like length, come together.
    lead = np.zeros(rows, np.int64)
    often = tf * (rows + 1) + df[term]
    begins = np.flatnonzero(np.diff(row, prepend=-1))
    if len(begins):
        most = np.flatnonzero(often == np.repeat(np.maximum.reduceat(often, begins), np.diff(begins, append=len(row))))
        first = most[np.flatnonzero(np.diff(row[most], prepend=-1))]
        lead[row[first]] = term[first] + 1
    del often
    order = np.lexsort((lengths, lead))
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    row = number[row]
    at = np.argsort(term * max(rows, 1) + row)  # a term is once in a row, so no two are equal
    row, tf = row[at], tf[at]
    starts = np.concatenate(([0], np.cumsum(df)))
    gaps = np.diff(row, prepend=0)
    gaps[starts[:-1][df > 0]] = row[starts[:-1][df > 0]]
    ids_ = np.array([NULL_ID if d is None else d for d in ids], np.int64)
    return _pack([terms, df.astype(np.int32), gaps.astype(np.int32), tf.astype(np.int32), ids_[order], lengths[order].astype(np.int32)])


class Asked:
    """Queries as arrays: the distinct terms and their weights, and for each query (``ids``) the numbers of its terms, those of query i at ``cuts[i]:cuts[i + 1]``.

    The first ``few`` queries have at most ``FEW`` terms. The others lie so that a batch of them shares many common terms: by
    the weight of the commonest term, which tells languages apart, then by length.
    """

    def __init__(self, ids: list[int | None], sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray):
        self.terms, first, which = np.unique(terms, return_index=True, return_inverse=True)
        self.weights = weights[first]
        begins = np.cumsum(sizes) - sizes
        order = np.lexsort((sizes, np.minimum.reduceat(weights, begins), sizes > FEW)) if len(sizes) else np.zeros(0, np.int64)
        self.few = int((sizes <= FEW).sum())
        at, _ = _ragged(begins[order], (begins + sizes)[order])
        self.ids, self.which = [ids[i] for i in order.tolist()], which[at].astype(np.int32)
        self.cuts = np.concatenate(([0], np.cumsum(sizes[order], dtype=np.int64)))


class Shard:
    """An index unpacked for search with the global mean length."""

    def __init__(self, data: bytes, mean: float):
        self.terms, df, gaps, tf, self.ids, lengths = _unpack(data)
        self.df = df.astype(np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.df)))
        self.row = self._rows(gaps.astype(np.int64))
        self.blocks = -(-len(self.ids) // BLOCK)
        self.norm = np.full(self.blocks * BLOCK, K1)
        self.norm[: len(lengths)] = K1 * (1 - B + B * lengths / mean)
        self.impact = _impact(tf, self.norm[self.row])
        most = min(DENSE, CELLS // max(len(self.norm), 1))  # short texts make many rows
        common = np.argpartition(-df, most)[:most] if len(df) > most else np.arange(len(df))
        self.common = np.sort(common[df[common] >= max(2, len(self.ids) / COMMON)])
        self.column = np.full(len(df) + 1, -1, np.int64)
        self.column[self.common] = np.arange(len(self.common))
        self.spans = [slice(a, b) for a, b in zip(self.starts[self.common].tolist(), self.starts[self.common + 1].tolist(), strict=True)]
        self.dense = np.zeros((len(self.common), self.blocks * BLOCK), np.min_scalar_type(int(tf.max(initial=0))))
        for i, span in enumerate(self.spans):
            self.dense[i, self.row[span]] = tf[span]
        self.entries = self.by_row = None
        self.opened = self.held = 0

    def _rows(self, gaps: np.ndarray) -> np.ndarray:
        run = np.cumsum(gaps)
        begins = self.starts[:-1]
        some = self.starts[1:] > begins
        before = np.zeros(len(begins), np.int64)
        before[some] = run[begins[some]] - gaps[begins[some]]
        return run - np.repeat(before, np.diff(self.starts))

    def _make_entries(self) -> None:
        """One for each term and block that meet; the term's postings in the block lie together."""
        term = np.repeat(np.arange(len(self.df)), self.df)
        key = term * max(self.blocks, 1) + self.row // BLOCK
        self.first = np.flatnonzero(np.diff(key, prepend=-1))
        self.past = np.append(self.first[1:], len(key))
        self.block = self.row[self.first] // BLOCK
        self.most = np.maximum.reduceat(self.impact, self.first) if len(self.first) else self.impact
        self.entries = np.searchsorted(self.first, self.starts)

    def _exact(self, terms: np.ndarray, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Scores of rows for a query's terms, each row's terms added up in the order of their hashes: copies of a text get the same score in all shards."""
        if self.by_row is None:
            at = np.argsort(self.row.astype(np.min_scalar_type(len(self.norm))), kind="stable")
            self.by_row = np.repeat(np.arange(len(self.df), dtype=np.int32), self.df)[at], self.impact[at]
            self.row_starts = np.concatenate(([0], np.cumsum(np.bincount(self.row, minlength=len(self.norm)))))
            self.asked = np.zeros(len(self.df))
        begins, ends = self.row_starts[rows], self.row_starts[rows + 1]
        at, _ = _ragged(begins, ends)
        self.asked[terms] = weight[terms]
        parts = self.asked[self.by_row[0][at]]
        self.asked[terms] = 0
        parts *= self.by_row[1][at]
        return np.add.reduceat(parts, np.cumsum(ends - begins) - (ends - begins))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows for one query's terms and idf weights."""
        _, ids, scores = self.search_many(Asked([0], np.array([len(terms)]), terms, weights), k, np.full(1, -1.0))
        return ids, scores

    def search_many(self, asked: Asked, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of queries, ids and scores: for each query the k best rows among those that score ``least`` of it or more."""
        at = np.searchsorted(self.terms, asked.terms)
        at[at == len(self.terms)] = 0
        there = self.terms[at] == asked.terms if len(self.terms) else np.zeros(len(at), bool)
        at[~there] = -1
        weight = np.zeros(len(self.df))
        weight[at[there]] = asked.weights[there]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i in range(asked.few):
            term = at[asked.which[asked.cuts[i] : asked.cuts[i + 1]]]
            term = term[term >= 0]
            whole = self.column[term] >= 0
            base = weight[term[whole]] @ _impact(self.dense[self.column[term[whole]]], self.norm)
            ids, scores = self._search(base, term, weight, k, least[i])
            out.append((np.full(len(ids), i), ids, scores))
        if asked.few < len(asked.ids):
            # A posting's row and score lie in one item of 16 bytes, so that taking many postings reads memory once.
            scored = np.empty(len(self.row), np.complex128)
            scored.view(np.int64)[::2] = self.row
            score = scored.view(np.float64)[1::2]
            np.multiply(self.impact, np.repeat(weight, self.df), out=score)
            light = np.zeros(self.dense.shape, np.float32)
            for i, span in enumerate(self.spans):
                light[i, self.row[span]] = score[span]
            batch = max(1, min(BATCH, CELLS // 4 // max(len(self.norm), 1)))
            for begin in range(asked.few, len(asked.ids), batch):
                cuts = asked.cuts[begin : begin + batch + 1]
                term, of = at[asked.which[cuts[0] : cuts[-1]]], np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
                met = np.flatnonzero(term >= 0)
                for query, ids, scores in self._scored(term[met], of[met], weight, scored, light, k, least[begin : begin + batch]):
                    out.append((query + begin, ids, scores))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _scored(self, term: np.ndarray, of: np.ndarray, weight: np.ndarray, scored: np.ndarray, light: np.ndarray, k: int, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The best rows of a batch of queries (numbers of queries, ids and scores, some queries at a time), whose terms are ``term`` and of which query ``of``; ``scored`` has each posting's row and score, ``light`` the common terms' scores by row."""
        size, width = len(least), self.blocks * BLOCK
        column = self.column[term]
        whole = column >= 0
        factor = np.zeros((size, len(light)), np.float32)
        factor[of[whole], column[whole]] = 1
        used = factor.sum(axis=0) * self.df[self.common] * DEAR > size * width
        product = np.flatnonzero(used)
        factor = factor[:, product]
        base = factor @ light[product]
        every, every_cuts = term, np.searchsorted(of, np.arange(size + 1))
        sparse = np.flatnonzero(~np.append(used, False)[column])
        term, of = term[sparse], of[sparse]
        reach = np.cumsum(np.bincount(of, self.df[term], size))
        begin = 0
        while begin < size:
            end = max(begin + 1, int(np.searchsorted(reach, (reach[begin - 1] if begin else 0) + POSTINGS, side="right")))
            mine = slice(*np.searchsorted(of, (begin, end)))
            df = self.df[term[mine]]
            posting = np.repeat(self.starts[term[mine]] - (np.cumsum(df) - df), df)
            posting += np.arange(len(posting))
            met = scored[posting]
            place = np.repeat((of[mine] - begin) * width, df)
            place += met.view(np.int64)[::2]
            total = np.bincount(place, met.view(np.float64)[1::2], (end - begin) * width).reshape(end - begin, width).astype(np.float64, copy=False)  # whole numbers where nothing was met
            near = total + base[begin:end]
            limit = least[begin:end].copy()
            new = np.flatnonzero(limit < 0)
            if len(new) and width >= k:  # k rows reach this
                limit[new] = np.partition(near[new], width - k, axis=1)[:, width - k] * (1 - SINGLE) - 1e-8
            query, row = np.divmod(np.flatnonzero(near >= np.maximum((limit - 1e-8) * (1 - SINGLE), 5e-324)[:, None]), max(width, 1))
            exact, found = np.zeros(len(row)), np.searchsorted(query, np.arange(end - begin + 1)).tolist()
            for i in range(end - begin):
                if found[i] < found[i + 1]:
                    some = slice(found[i], found[i + 1])
                    exact[some] = self._exact(every[every_cuts[begin + i] : every_cuts[begin + i + 1]], row[some], weight)
            rounded = np.round(exact, PLACES)
            keep = np.flatnonzero((exact > 0) & (rounded > limit[query] - 1e-12))
            query, ids, rounded = query[keep], self.ids[row[keep]], rounded[keep]
            order = np.lexsort((ids, -rounded, query))
            query, ids, rounded = query[order], ids[order], rounded[order]
            first = np.flatnonzero(np.arange(len(query)) - np.searchsorted(query, query) < k)
            yield query[first] + begin, ids[first], rounded[first]
            begin = end

    def _search(self, base: np.ndarray, terms: np.ndarray, weight: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        if self.entries is None:
            self._make_entries()
        at = terms[self.column[terms] < 0]
        best = base.reshape(self.blocks, BLOCK).max(axis=1) if self.blocks else np.zeros(0)
        entry, of = _ragged(self.entries[at], self.entries[at + 1])
        block = self.block[entry]
        bound = best + np.bincount(block, self.most[entry] * weight[at][of], self.blocks) if len(entry) else best
        ranked = np.argsort(-bound, kind="stable")
        ids, scores = np.zeros(0, np.int64), np.zeros(0)
        done, batch = 0, 4
        self.held += self.blocks
        while done < len(ranked):
            take = ranked[done : done + batch]
            take = take[(bound[take] > 0) & (bound[take] + 1e-8 >= least)]  # every match has a bound above 0, however light its terms
            if not len(take):
                break
            score = np.zeros(len(base))
            chosen = np.zeros(self.blocks, bool)
            chosen[take] = True
            for term in terms.tolist():  # in one order for all shards, as above
                if self.column[term] >= 0:
                    score += _impact(self.dense[self.column[term]], self.norm) * weight[term]
                else:
                    met = np.arange(self.entries[term], self.entries[term + 1])
                    met = met[chosen[self.block[met]]]
                    posting, _ = _ragged(self.first[met], self.past[met])
                    score[self.row[posting]] += self.impact[posting] * weight[term]
            rows = (take[:, None] * BLOCK + np.arange(BLOCK)).reshape(-1)
            exact = score[rows]
            score = np.round(exact, PLACES)
            keep = np.flatnonzero((exact > 0) & (score > least - 1e-12))
            ids, scores = np.concatenate((ids, self.ids[rows[keep]])), np.concatenate((scores, score[keep]))
            first = np.lexsort((ids, -scores))[:k] if len(ids) < 4 * k else _best(ids, scores, k)
            ids, scores = ids[first], scores[first]
            least = max(least, scores[-1]) if len(scores) == k else least
            done += len(take)
            self.opened += len(take)
            if len(take) < batch:
                break
            batch *= 4
        return ids, scores


def _impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return tf * (K1 + 1) / (tf + norm)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    edge = np.partition(scores, len(scores) - k)[len(scores) - k]
    near = np.flatnonzero(scores >= edge)
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _ragged(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, one range after another, and the range of each."""
    sizes = ends - begins
    of = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(of)) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes), of


def write_index(docs: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> None:
    """Indexes every row of (doc_id, text) into ``folder``: shard, rows, length, index."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = [None if pd.isna(d) else int(d) for d in pdf["doc_id"]]
        data = build(ids, [None if t is None else bytes(t) for t in pdf["text"]])
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "rows": [len(pdf)], "length": [int(_unpack(data)[5].sum())], "index": [data]})

    # The shard follows from the row alone, so a repeated task deals alike; rows equal in id and text share one.
    dealt = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int"))
    dealt.repartition(shards, "shard").groupBy("shard").applyInPandas(index, "shard int, rows long, length long, index binary").write.parquet(folder)


def search(spark, folder: str, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, doc_id, score of the k best rows of the index for each of (query_id, text)."""
    index = spark.read.parquet(folder)
    of = index.agg(F.sum("rows").alias("rows"), F.sum("length").alias("length"), F.max("shard").alias("last")).first()
    rows, mean = of["rows"] or 0, max((of["length"] or 0) / max(of["rows"] or 1, 1), 1e-9)

    def termed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(term_hashes(words_of(t.as_py()))).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["query_id", "terms"])

    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("text").cast("binary").alias("text")).mapInArrow(termed, "query_id long, terms array<long>")
    asked = written(asked.where(F.size("terms") > 0), "bm25-queries")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                terms, df = _unpack(data.as_py())[:2]
                for i in range(0, len(terms), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(terms[i : i + 100_000].view(np.int64)), pa.array(df[i : i + 100_000].astype(np.int64))], ["term", "df"])

    wanted = asked.select(F.explode("terms").alias("term")).distinct()
    df = index.select("index").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).join(wanted, "term")
    idf = F.log(1 + (F.lit(float(rows)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.select("query_id", F.explode("terms").alias("term")).join(df.select("term", idf.alias("idf")), "term")
    sizes = asked.agg(F.count("*").alias("queries"), F.sum(F.size("terms")).alias("terms")).first()
    blocks = max(1, -(-sizes["queries"] // QUERY_BLOCK), -(-(sizes["terms"] or 0) // QUERY_TERMS))
    listed = weighted.groupBy("query_id").agg(F.sort_array(F.collect_set(F.struct("term", "idf"))).alias("t"))
    grouped = written(listed.select("query_id", F.col("t.term").alias("terms"), F.col("t.idf").alias("weights"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")), "bm25-weighted")
    found, kind = new_folder(spark, "bm25-found"), "query_id long, doc_id long, score double"
    seeds = F.col("shard") % max(1, math.isqrt((of["last"] or 0) + 1)) == 0
    for block in range(blocks):
        held = grouped.where(F.col("block") == block).select("query_id", "terms", "weights").toArrow()
        terms, weights = (pa.concat_arrays([c.flatten() for c in held.column(name).chunks]) if held.num_rows else pa.array([], t) for name, t in (("terms", pa.int64()), ("weights", pa.float64())))
        lengths = pc.list_value_length(held.column("terms")).to_numpy().astype(np.int64)
        asked_now = Asked(held.column("query_id").to_pylist(), lengths, terms.to_numpy().view(np.uint64), weights.to_numpy())
        shared = spark.sparkContext.broadcast(asked_now)
        known: dict[int | None, float] = {}
        for step, part in enumerate((seeds, ~seeds)):
            least = spark.sparkContext.broadcast(np.array([known.get(i, -1.0) for i in asked_now.ids]))

            def best(batches: Iterator[pa.RecordBatch], shared=shared, least=least) -> Iterator[pa.RecordBatch]:
                worker_keeps("topk")
                asked, bounds = shared.value, least.value.copy()
                ids, top = pa.array(asked.ids, pa.int64()), np.full((len(asked.ids), k), -1.0)
                for batch in batches:
                    for data in batch.column(0):
                        query, doc, score = Shard(data.as_py(), mean).search_many(asked, k, bounds)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(query)), pa.array(doc), pa.array(score)], ["query_id", "doc_id", "score"])
                        # The k best of the shards so far bound what the next one must reach.
                        some, first = np.unique(query, return_index=True)
                        for i, begin, end in zip(some.tolist(), first.tolist(), [*first[1:].tolist(), len(query)], strict=bool(len(query))):
                            top[i] = np.sort(np.append(top[i], score[begin:end]))[-k:]
                        bounds = np.maximum(bounds, top[:, 0])

            path = f"{found}/block={block}/step={step}"
            index.where(part).select("index").mapInArrow(best, kind).write.parquet(path)
            if not step:
                # A row that is below the k-th best of some shards is not among the k best of all.
                place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
                reached = spark.read.schema(kind).parquet(path).withColumn("place", place).where(F.col("place") == k).select("query_id", "score").toArrow()
                known = dict(zip(reached.column(0).to_pylist(), reached.column(1).to_pylist(), strict=True))
            least.destroy()
        shared.destroy()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    ranked = spark.read.schema(kind).parquet(found).withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "score")


def op2_query(docs: DataFrame, k: int = 10) -> DataFrame:
    """Every row whose id is divisible by 100 as a query, by its whole text, against all rows."""
    folder = new_folder(docs.sparkSession, "bm25-index")
    write_index(docs, folder)
    queries = docs.where(F.col("doc_id") % 100 == 0).select(F.col("doc_id").alias("query_id"), "text")
    return search(docs.sparkSession, folder, queries, k)


def op2_sql(k: int = 10) -> str:
    """The same by scoring every row that shares a term with a query."""
    return f"""
with w as (select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents),
l as (select r, doc_id, coalesce(len(ws), 0) as n from w),
s as (select count(*) as total, sum(n) / count(*) as mean from l),
t as (select r, doc_id, term, count(*) as tf from (select r, doc_id, unnest(ws) as term from w) group by all),
f as (select term, ln(1 + ((select total from s) - count(*) + 0.5) / (count(*) + 0.5)) as idf from t group by term),
q as (select distinct doc_id as query_id, term from t where doc_id % 100 = 0),
m as (select query_id, t.r, t.doc_id, round(sum(idf * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * n / (select mean from s)))), {PLACES}) as score
  from q join t using (term) join f using (term) join l on l.r = t.r group by all),
o as (select query_id, row_number() over (partition by query_id order by score desc, doc_id) as rank, doc_id, score from m)
select query_id, cast(rank as integer) as rank, doc_id, score from o where rank <= {k}
"""
