"""Byte-level BPE by prefix dynamic programming.

Every prefix of a piece has exactly one valid encoding, so it is enough to store each prefix's last token: token t is
the last of prefix i if it ends there and the prefix before it is empty and t merges to itself, or (last token of that
prefix, t) stays two tokens when merged. Appending bytes only adds entries; after an edit, entries are recomputed from
the edit on, until a token's greatest length of entries agrees with the old ones, and the rest is taken over.

Texts are cut by the vocabulary's pattern, each match is encoded separately, and a match that is itself a token is that
token. No special tokens.

Defined results: a null text is the empty text, with no tokens; repeated rows each give a row. Memory: a text, its
tokens, and two generations of at most ``CACHE_PIECES`` cached pieces.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.common import mapped, small_batches, worker_keeps
from tickloom.llm.cutter import Cutter

CACHE_PIECES = 120_000
CACHE_PAIRS = 300_000
#: Longer pieces are not cached.
LONGEST_CACHED = 64
#: Vocabularies are broadcast; this bounds them.
MAX_VOCABULARY = 1_000_000


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks from a file of base64 tokens and numbers, one pair a line."""
    lines = open(path, "rb").read().split(b"\n")
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"{path} has {len(ranks)} tokens; at most {MAX_VOCABULARY} are broadcast")
    return ranks


class PrefixEncoder:
    """Encodes pieces, appends to them and re-encodes them near an edit; see the module's text."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        lengths: dict[int, set[int]] = {}
        for token in ranks:
            lengths.setdefault(token[-1], set()).add(len(token))
        self.lengths = {last: sorted(held) for last, held in lengths.items()}
        self.longest = max(map(len, ranks), default=0)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The definition: join the adjacent pair of lowest rank, leftmost first, until none is a token."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def stays(self, token: int) -> bool:
        """Whether the token's bytes merge to the token."""
        found = self.whole.get(token)
        if found is None:
            found = self.whole[token] = self.merged(self.bytes_of[token]) == [token]
        return found

    def stay(self, left: int, right: int) -> bool:
        """Whether the two tokens' bytes merge to just these two."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            found = self.pairs[left, right] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return found

    def last_of(self, piece: bytes, i: int, last: list[int]) -> int:
        """The last token of the prefix of i bytes; ``last`` has those of the shorter ones (entry 0 is none)."""
        rank_of = self.ranks.get
        for n in self.lengths[piece[i - 1]]:
            if n > i:
                break
            token = rank_of(piece[i - n : i])
            if token is not None and (self.stays(token) if n == i else self.stay(last[i - n], token)):
                return token
        raise ValueError("a byte of the text is not in the vocabulary")

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Adds the entries of the bytes beyond those that ``last`` covers; a new table starts as [-1]."""
        for i in range(len(last), len(piece) + 1):
            last.append(self.last_of(piece, i, last))
        return last

    def edited(self, old: bytes, last: list[int], begin: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """The piece with bytes begin to end replaced, and its table."""
        piece = old[:begin] + new + old[end:]
        shift = len(piece) - len(old)
        table, agree = last[: begin + 1], 0
        for i in range(begin + 1, len(piece) + 1):
            table.append(self.last_of(piece, i, table))
            beyond = i > begin + len(new)
            agree = agree + 1 if beyond and table[i] == last[i - shift] else 0
            if agree >= self.longest:
                return piece, table + last[i - shift + 1 :]
        return piece, table

    def tokens(self, piece: bytes, last: list[int]) -> list[int]:
        """The encoding that a table stands for, read from its end."""
        out, i = [], len(piece)
        while i:
            out.append(last[i])
            i -= len(self.bytes_of[last[i]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        token = self.ranks.get(piece)
        return [token] if token is not None else self.tokens(piece, self.extend(piece, [-1]))


class TextEncoder:
    """Whole texts, with a cache of pieces in two generations: what is still used moves to the young one."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.encoder = PrefixEncoder(ranks)
        self.find = Cutter(pattern).find
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.decimal = {rank: str(rank) for rank in ranks.values()}

    def _miss(self, piece: str) -> tuple[int, ...]:
        found = self.old.get(piece)
        if found is None:
            found = tuple(self.encoder.encode(piece.encode()))
        if len(piece) <= LONGEST_CACHED:
            if len(self.young) >= CACHE_PIECES:
                self.old, self.young = self.young, {}
            self.young[piece] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        miss = self._miss
        return list(chain.from_iterable([self.young.get(p) or miss(p) for p in self.find(text)])) if text else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.encoder.bytes_of.__getitem__, ids))


def text_encoder(key: str, ranks: dict[bytes, int], pattern: str) -> TextEncoder:
    """This worker's encoder."""
    return worker_keeps(("bpe", key, pattern), lambda: TextEncoder(ranks, pattern))


def _shared(docs: DataFrame, path: str):
    ranks = read_ranks(small_batches(docs).sparkSession, path)
    key = hashlib.sha256(b"".join(token + b"%d" % rank for token, rank in ranks.items())).hexdigest()
    return docs.sparkSession.sparkContext.broadcast(ranks), key


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``ids array<int>`` to documents; all other columns pass through."""
    shared, key = _shared(docs, path)
    kept = docs.drop("ids")
    names = kept.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = text_encoder(key, shared.value, pattern)
        for batch in batches:
            ids = pa.array([held.encode(t) for t in batch.column(at).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], [f"c{i}" for i in range(len(names) + 1)])

    return mapped(kept, run, ids="array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded binary`` to rows with ``ids``."""
    shared, _ = _shared(encoded, path)
    kept = encoded.drop("decoded")
    names = kept.columns
    at = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {rank: token for token, rank in shared.value.items()}
        for batch in batches:
            out = [b"".join(map(bytes_of.__getitem__, ids or [])) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [f"c{i}" for i in range(len(names) + 1)])

    return mapped(kept, run, decoded="binary")


def digests(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Per document, digests of its ids and of the bytes that they decode to (and the ids); encodes and decodes in one pass."""
    shared, key = _shared(docs, path)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = text_encoder(key, shared.value, pattern)
        decimal = held.decimal.__getitem__
        for batch in batches:
            counts, ids_sha, decoded_sha, kept = [], [], [], []
            for text in batch.column(1):
                ids = held.encode(text.as_py())
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(held.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(pa.array(ids, pa.int32()))
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                ends = pa.array([0, *accumulate(counts)], pa.int32())
                arrays.append(pa.ListArray.from_arrays(ends, pa.concat_arrays(kept) if kept else pa.array([], pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
