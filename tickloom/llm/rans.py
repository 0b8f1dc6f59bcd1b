"""Token ids in files coded by a static range asymmetric numeral system (rANS).

Layout. Documents are put in ascending id order and dealt into shards, one per task, whose number follows from the texts' bytes
(``SHARD_BYTES``; at least one for each core); a shard is cut into segments of
whole documents and about ``SEGMENT_IDS`` ids. A segment is one frame (one Parquet row): the segment's frequency table,
shared by all its blocks, its documents' ids and lengths, and blocks of ``LANES * STEPS`` ids. In a block, id number i
belongs to lane i % LANES; the lanes' coder states are interleaved over one stream of 32-bit words. Blocks are independent;
each has a crc32 of its ids, and every ``CHECKPOINT`` steps the lanes' states and the place in the stream are noted, so
parts of a block can be decoded alone and blocks can be decoded in parallel. Frames are Spark rows, so a task that is
run again replaces its frames whole, and any store that Spark writes to can hold the files.

A frequency table covers all ids of its segment (nothing is sampled) and is exact for what it codes.

Defined results: a null text is an empty text (just the end id); an empty table gives no frames; repeated rows are
documents of their own, in order of id, then text; a null id sorts first; ids are whole numbers or texts of such (others end the job
in Spark's cast error, or are null where ANSI mode is off); only doc_id and text are read, so other columns can't clash. Memory: a segment's ids, and the longest text.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import new_folder, small_batches, worker_keeps
from tickloom.llm.cutter import Cutter

LANES, STEPS, CHECKPOINT = 1024, 128, 32
SEGMENT_IDS = 2_000_000
SCALE = 20
LOW = 1 << 31
MAGIC = b"rANSseg1"
SHARD_BYTES = 64_000_000
CACHE_PIECES = 400_000


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2**SCALE; what occurs keeps at least 1."""
    total = int(counts.sum())
    scaled = np.maximum((counts.astype(np.float64) * ((1 << SCALE) / total)).astype(np.int64), counts > 0)
    over = int(scaled.sum()) - (1 << SCALE)
    order = np.argsort(-scaled, kind="stable")
    at = 0
    while over > 0:  # take from the most frequent first
        i = order[at % len(order)]
        take = min(over, int(scaled[i]) - 1, max(1, int(scaled[i]) // 8))
        scaled[i] -= take
        over -= take
        at += 1
    scaled[order[0]] -= over if over < 0 else 0
    return scaled


class Table:
    """A frequency table: the symbols that occur, their frequencies and starts, and the symbol of each slot."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols.astype(np.uint32), freq.astype(np.uint64)
        self.start = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        return cls(symbols, frequencies(counts[symbols]))

    def codes(self, ids: np.ndarray) -> np.ndarray:
        """Places of ids in the table."""
        place = np.zeros(int(self.symbols[-1]) + 1, np.int64)
        place[self.symbols] = np.arange(len(self.symbols))
        return place[ids]

    def pack(self) -> bytes:
        steps = np.diff(self.symbols.astype(np.int64), prepend=0).astype(np.uint32)
        return zlib.compress(steps.tobytes() + self.freq.astype(np.uint32).tobytes(), 6)

    @classmethod
    def unpack(cls, data: bytes) -> Table:
        both = np.frombuffer(zlib.decompress(data), np.uint32)
        n = len(both) // 2
        return cls(np.cumsum(both[:n].astype(np.int64)), both[n:])

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.symbols), dtype=np.uint32), self.freq.astype(np.int64))


def encode_block(codes: np.ndarray, table: Table) -> bytes:
    """One block: codes are places in the table. The last step may be partial; absent lanes stand still."""
    shift, low_bits = np.uint64(32), np.uint64(0xFFFFFFFF)
    states = np.full(LANES, LOW, np.uint64)
    freq, start = table.freq[codes], table.start[codes]
    limit = freq << np.uint64(31 - SCALE + 32)
    steps = -(-len(codes) // LANES)
    words: list[np.ndarray] = []
    marks: list[tuple[int, int, bytes]] = []
    written = 0
    for step in range(steps - 1, -1, -1):
        begin, end = step * LANES, min((step + 1) * LANES, len(codes))
        x = states[: end - begin]
        f = freq[begin:end]
        full = x >= limit[begin:end]
        if full.any():
            out = x[full]
            words.append((out & low_bits).astype(np.uint32))
            written += len(out)
            x[full] = out >> shift
        quotient = x // f
        x[:] = (quotient << np.uint64(SCALE)) + (x - quotient * f) + start[begin:end]
        if step and step % CHECKPOINT == 0:
            marks.append((step, written, states.tobytes()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    checkpoints = b"".join(struct.pack("<II", step, written - before) + held for step, before, held in reversed(marks))
    return struct.pack("<IIIII", len(codes), zlib.crc32(table.symbols[codes].astype("<u4").tobytes()), len(marks), len(stream), LANES) + states.tobytes() + checkpoints + stream.tobytes()


def decode_block(data: bytes, table: Table, slots: np.ndarray, first: int = 0) -> np.ndarray:
    """Ids of a block, from the checkpoint ``first`` on (0: its start). Whole blocks are held against their checksum."""
    n, crc, marks, n_words, lanes = struct.unpack_from("<IIIII", data)
    at = 20
    states = np.frombuffer(data, np.uint64, lanes, at).copy()
    at += 8 * lanes
    step = place = 0
    if first:
        step, place = struct.unpack_from("<II", data, at + (first - 1) * (8 + 8 * lanes))
        states = np.frombuffer(data, np.uint64, lanes, at + (first - 1) * (8 + 8 * lanes) + 8).copy()
    stream = np.frombuffer(data, np.uint32, n_words, at + marks * (8 + 8 * lanes)).astype(np.uint64)
    out = np.empty(n, np.uint32)
    mask, scale, low, shift = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(LOW), np.uint64(32)
    for begin in range(step * lanes, n, lanes):
        x = states[: min(lanes, n - begin)]
        slot = x & mask
        code = slots[slot]
        out[begin : begin + len(x)] = code
        x[:] = table.freq[code] * (x >> scale) + slot - table.start[code]
        need = x < low
        k = int(need.sum())
        if k:
            x[need] = (x[need] << shift) | stream[place : place + k]
            place += k
    ids = table.symbols[out[step * lanes :]]
    if not first and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block's ids don't match its checksum")
    return ids


def pack_segment(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A frame: header, table, documents, blocks with their lengths; a crc32 of all of it comes last."""
    flat = np.concatenate(ids)
    table = Table.of(flat)
    codes = table.codes(flat)
    packed = table.pack()
    documents = zlib.compress(
        np.array([d if d is not None else 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes() + np.array([len(x) for x in ids], "<u8").tobytes(), 6
    )
    size = LANES * STEPS
    blocks = [encode_block(codes[i : i + size], table) for i in range(0, len(codes), size)]
    head = MAGIC + struct.pack("<QIIII", len(flat), len(doc_ids), len(packed), len(documents), len(blocks)) + np.array([len(b) for b in blocks], "<u4").tobytes()
    body = b"".join([head, packed, documents, *blocks])
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_segment(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """Documents' ids and token ids of a frame."""
    if data[:8] != MAGIC or struct.unpack_from("<I", data, len(data) - 4)[0] != zlib.crc32(data[:-4]):
        raise ValueError("not a whole frame")
    _, n_docs, n_table, n_documents, n_blocks = struct.unpack_from("<QIIII", data, 8)
    at = 8 + 24
    sizes = np.frombuffer(data, "<u4", n_blocks, at)
    at += 4 * n_blocks
    table = Table.unpack(data[at : at + n_table])
    at += n_table
    held = zlib.decompress(data[at : at + n_documents])
    at += n_documents
    doc_ids, absent, counts = np.frombuffer(held, "<i8", n_docs), np.frombuffer(held, np.uint8, n_docs, 8 * n_docs), np.frombuffer(held, "<u8", n_docs, 9 * n_docs)
    slots = table.slots()
    parts = []
    for size in sizes.tolist():
        parts.append(decode_block(data[at : at + size], table, slots))
        at += size
    flat = np.concatenate(parts)
    return [None if a else int(d) for d, a in zip(doc_ids, absent, strict=True)], np.split(flat, np.cumsum(counts.astype(np.int64))[:-1])


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 stands for itself, the other bytes, in order, for the letters from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class LibraryTokenizer:
    """Ids as the tokenizers library gives them; pieces met before come from a bounded cache of two generations.

    The vocabulary's own cut into pieces is made here by the same pattern; the library's model encodes each new piece, and
    pieces are encoded independently of each other, as in the library's own pipeline.
    A text that holds the content of an added token (few do) is encoded whole by the library, which cuts such tokens out first.
    """

    def __init__(self, path: str, pattern: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.find = Cutter(pattern).find
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.end = struct.pack("<I", end_id)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            tokens = self.library.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
            found = np.array([t.id for t in tokens], "<u4").tobytes()
        self.young[piece] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        """The text's ids and the end id."""
        if text and any(content in text for content in self.added):
            return np.append(np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4"), np.frombuffer(self.end, "<u4"))
        if len(self.young) >= CACHE_PIECES:
            self.old, self.young = self.young, {}
        get, make = self.young.get, self._piece
        return np.frombuffer(b"".join([get(p) or make(p) for p in self.find(text or "")] + [self.end]), "<u4")


def library_tokenizer(*key) -> LibraryTokenizer:
    """This Python worker's tokenizer for a vocabulary, pattern and end id."""
    return worker_keeps(("rans", *key), lambda: LibraryTokenizer(*key))


def _shards(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))


def write(docs: DataFrame, folder: str, tokenizer: str, pattern: str, end_id: int, shards: int | None = None, segment_ids: int = SEGMENT_IDS) -> None:
    """Encodes documents (doc_id, text) in ascending id order and writes their frames to ``folder``."""
    shards = shards or _shards(docs)
    ordered = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "text").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_tokenizer(tokenizer, pattern, end_id).encode
        shard, segment, held = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal segment, held
            row = [pa.array([v], t) for v, t in ((shard, pa.int32()), (segment, pa.int32()), (len(doc_ids), pa.int64()), (held, pa.int64()), (pack_segment(doc_ids, ids), pa.binary()))]
            segment, held = segment + 1, 0
            doc_ids.clear()
            ids.clear()
            return pa.RecordBatch.from_arrays(row, ["shard", "segment", "n_docs", "n_ids", "frame"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                doc_ids.append(doc_id)
                ids.append(encode(text.as_py()))
                held += len(ids[-1])
                if held >= segment_ids:
                    yield flush()
        if doc_ids:
            yield flush()

    ordered.mapInArrow(frames, "shard int, segment int, n_docs long, n_ids long, frame binary").write.parquet(folder)


def read(spark, folder: str, with_ids: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids if asked for."""
    files = spark.read.parquet(folder)
    # One row per shard (a task's output) meets in one window; segments are numbered within their shard.
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select("shard", before.alias("shard_start"))
    segments = files.select("shard", "segment", F.coalesce(F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("segment_start"))
    starts = segments.join(shards, "shard").select("shard", "segment", (F.col("shard_start") + F.col("segment_start")).alias("first"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, segment, frame in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                doc_ids, ids = unpack_segment(frame)
                counts = np.array([len(x) for x in ids], np.int64)
                arrays = [pa.array([shard] * len(ids), pa.int32()), pa.array([segment] * len(ids), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(np.cumsum(counts) - counts), pa.array(counts), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())]
                if with_ids:
                    arrays.append(pa.array(ids, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, ["shard", "segment", "doc_id", "offset", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    found = files.select("shard", "segment", "frame").mapInArrow(documents, "shard int, segment int, doc_id long, offset long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))
    out = found.join(starts, ["shard", "segment"])
    return out.select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def op9_query(docs: DataFrame, tokenizer: str, pattern: str, end_id: int = 2) -> DataFrame:
    """Writes the files, then returns the contract's rows as read back from them."""
    folder = new_folder(docs.sparkSession, "rans")
    write(docs, folder, tokenizer, pattern, end_id)
    return read(docs.sparkSession, folder)
