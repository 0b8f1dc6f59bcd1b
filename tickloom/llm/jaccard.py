"""N-gram Jaccard join by grouped prefixes.

Words: A-Z lower-cased, then runs of ``[^\\x20\\x09-\\x0D]``. A document's set holds its distinct shingles of five words, as
64-bit hashes; with fewer words the whole sequence is the one shingle; without words the set is empty and links with
nothing. Two documents link when ``den * intersection >= num * union``; the result is each document's component.

1. Sets. One pass writes each row's set size and 128-bit set digest; equal digests are one *node*. The same pass fills a
   count sketch of all shingles: ``BUCKETS`` counters of fixed size, summed over all tasks. It orders shingles from rare
   to common (any fixed order gives exact results; this one keeps common passages out of the prefixes).
2. Prefixes. A set of n shingles keeps its n - ceil(num/den * n) + 1 rarest as prefix: linked sets share one of them. Nodes with
   the same prefix and size form a *group*. Groups are filed under each prefix token; tokens that only one group has can
   link nothing across groups and go. A token that the sketch says may be very common is split by salt.
3. Rounds. In each token's list (and among each group's members) one node of each present component is compared with a
   leader: a star, not all pairs. A pair first passes a bitmap filter (the parities of 1024 hash buckets bound the overlap
   from above), then is verified on whole sets; links merge components, and lists whose groups have all met go. Lists with
   more than LONG_LIST entries left take further rounds with other leaders, salts and size bands as long as they link
   anything, so a large family of near copies collapses in a few rounds, each linear in its lists.
4. Rest. Group pairs that share a token, lie in different components, and pass the size and the position filter are
   expanded to the members in different components, and all of these pairs are filtered and verified. No pair is capped or
   skipped, so the components are those of the full join; within one component no more links are needed.

Defined results: null text, empty text and text without words: size 0, a component of its own. Repeated rows and repeated
ids are rows of their own (a row is its id and its text's hash). A component is named by its smallest id; nulls are
never the smallest unless all are null. The 64-bit and 128-bit hashes stand for what they hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import free_names, new_folder, only, quoted, removed, small_batches, worker_keeps, written
from tickloom.llm.components import components

WORDS = 5
NUM, DEN = 75, 100
BUCKETS = 1 << 22
SHIFT = 64 - 22
SLICES = 1 << 10
#: Entries of one token, or components of one list, that are dealt to one salt.
SALT_ROWS = 2_000
#: Bytes hashed at once.
CHUNK = 1 << 20
MOST_ROUNDS = 3
#: Entries up to which a list's pairs are left to the last step.
LONG_LIST = 24
#: Parity bits of the bitmap filter, at least; keys are broadcast up to this many rows, and by a filter of so many bits beyond.
BITS = 1024
FEW_ROWS = 300_000
FILTER_BITS = 1 << 27

_SEED = 20_240_229
#: Odd multipliers of a 64-bit mixer.
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def _hashes(words: list[bytes], n: int) -> np.ndarray:
    """A hash of each n consecutive words: the words' seeded hashes, mixed one after another, so that no sums or products cancel."""
    word = np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(_SEED)), np.uint64, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        h = _mixed(h * _MIX[1] + word[i : i + len(h)])
    return h


def shingle_set(text: bytes | None, n: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a UTF-8 text."""
    words = text.lower().split() if text else []
    if len(words) <= n:
        return _hashes(words, len(words)) if words else np.zeros(0, np.uint64)
    step = max(1, CHUNK * len(words) // len(text))
    return np.unique(np.concatenate([_hashes(words[i : i + step + n - 1], n) for i in range(0, len(words) - n + 1, step)]))


def _digest(held: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(held.tobytes()) if len(held) else None


def _packed(counts: np.ndarray) -> bytes:
    """Counters by byte planes: the higher planes are nearly all zero, the lowest has few values."""
    coder = zlib.compressobj(6, zlib.DEFLATED, zlib.MAX_WBITS, 8, zlib.Z_RLE)
    return coder.compress(counts.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()) + coder.flush()


def _unpacked(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").reshape(-1)


def _sets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, text_hash, n, node; and, in rows of their own, the sketch's slices of each task."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps("jaccard")
        counts, kept, schema = np.zeros(BUCKETS, np.int32), [], None
        for batch in batches:
            sizes, nodes = [], []
            for text in batch.column(2).cast(pa.binary()):
                held = shingle_set(text.as_py())
                sizes.append(len(held))
                nodes.append(_digest(held))
                kept.append(held >> np.uint64(SHIFT))
                if len(kept) >= 2000:
                    counts += np.bincount(np.concatenate(kept).astype(np.int64), minlength=BUCKETS).astype(np.int32)
                    kept = []
            out = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())],
                ["doc_id", "text_hash", "n", "node", "slice", "counts"],
            )
            schema = out.schema
            yield out
        if kept:
            counts += np.bincount(np.concatenate(kept).astype(np.int64), minlength=BUCKETS).astype(np.int32)
        if schema is not None and counts.any():
            parts = counts.reshape(SLICES, -1)
            some = np.flatnonzero(parts.any(axis=1))
            columns = [pa.nulls(len(some), schema.field(0).type), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.binary()), pa.array(some, pa.int32()), pa.array([_packed(parts[i]) for i in some], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash long, n long, node binary, slice int, counts binary")


def level(counts: np.ndarray) -> np.ndarray:
    """Counts as 16-bit levels in the same order: numbers below 2**15 as they are, larger ones (to 2**48) by their logarithm, a thousand levels a power of two."""
    large = np.maximum(counts, 2**15)
    return np.where(counts < 2**15, counts, 2**15 + np.floor(992 * (np.log2(large) - 15))).astype("<u2")


def at_level(levels: np.ndarray) -> np.ndarray:
    """The least count of each level, about."""
    held = levels.astype(np.int64)
    return np.where(held < 2**15, held, np.exp2(15 + (np.maximum(held, 2**15) - 2**15) / 992).astype(np.int64))


def _summed(parts: DataFrame) -> np.ndarray:
    """The levels of the summed counters of all tasks (slice, counts): a table of fixed size, whatever the corpus. Parts are added up one at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[at] = sums.get(at, np.int64(0)) + _unpacked(packed.as_py())
        numbers = [level(held).tobytes() for held in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(numbers, pa.binary())], ["slice", "counts"])

    out = np.zeros((SLICES, BUCKETS // SLICES), np.uint16)
    for row in parts.repartition("slice").mapInArrow(add, "slice int, counts binary").collect():
        out[row["slice"]] = np.frombuffer(row["counts"], "<u2")
    return out.reshape(-1)


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    """Shingles of a set of n that any linked set must meet."""
    return n + (-num * n) // den + 1 if n else 0


def bitmap(held: np.ndarray) -> np.ndarray:
    """Parities of the shingles' low bits, two a shingle and BITS at least: two sets' overlap is at most (n + m - differing bits) / 2.

    The number of bits is a power of two, so a longer bitmap is folded to a shorter one by XOR of its halves.
    """
    bits = max(BITS, 1 << (2 * len(held) - 1).bit_length())
    odd = np.bincount((held & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefixes(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """Per distinct set of a task: node, n, gid, bitmap, its prefix tokens and how often each is split."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps("jaccard")
        sketch, seen = shared.value, set()
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for text in batch.column(0).cast(pa.binary()):
                held = shingle_set(text.as_py())
                node = _digest(held)
                if node is None or node in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(node)
                levels = sketch[held >> np.uint64(SHIFT)]
                order = np.lexsort((held, levels))[: prefix_length(len(held))]
                tokens = held[order]
                gid = xxhash.xxh3_64_intdigest(tokens.tobytes(), len(held)) - (1 << 63)
                for column, value in zip(rows, (node, len(held), gid, bitmap(held), tokens.view(np.int64), (at_level(levels[order]) // SALT_ROWS).astype(np.int32) + 1), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())), strict=True)], ["node", "n", "gid", "bits", "tokens", "splits"])

    return docs.select("text").mapInArrow(run, "node binary, n int, gid long, bits array<long>, tokens array<long>, splits array<int>")


def _key(identity: str = "doc_id", text_hash: str = "text_hash") -> Column:
    return F.xxhash64(identity, text_hash)


def _places(keys: np.ndarray) -> np.ndarray:
    """Three places in the filter for each 64-bit key."""
    keys = keys.view(np.uint64)
    low, high = keys & np.uint64(FILTER_BITS - 1), keys >> np.uint64(32) | np.uint64(1)
    return ((low + np.arange(3, dtype=np.uint64)[:, None] * high) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of the keys (key long), of fixed size, made slice by slice in the tasks."""
    width = FILTER_BITS // SLICES

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.sort(_places(batch.column(0).to_numpy()).reshape(-1))
            slices, first = np.unique(at // width, return_index=True)
            parts = np.split((at % width).astype("<i4"), first[1:]) if len(at) else []
            yield pa.RecordBatch.from_arrays([pa.array(slices.astype(np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], ["slice", "places"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(i, np.zeros(width, bool))[np.frombuffer(places, "<i4")] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(h).tobytes() for h in held.values()], pa.binary())], ["slice", "bits"])

    out = np.zeros((SLICES, width // 8), np.uint8)
    for row in keys.mapInArrow(place, "slice int, places binary").repartition("slice").mapInArrow(fill, "slice int, bits binary").collect():
        out[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def _candidate_sets(docs: DataFrame, wanted: DataFrame, repeats: bool, few: bool) -> DataFrame:
    """node, held (sorted shingles) of the wanted rows (doc_id, text_hash, node), and perhaps of some more.

    ``repeats``: some row is in the table more than once; ``few``: the wanted rows were counted to be few. Texts are never shuffled:
    many wanted rows are known by a filter of fixed size. Where it is too full it lets texts through that nobody asks for.
    """
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").where(F.col("text").isNotNull())
    bits = None
    if few:
        wanted = F.broadcast(wanted.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")))
        texts = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["__id"]) & (texts["text_hash"] == wanted["__hash"]), "left_semi")
    else:
        bits = docs.sparkSession.sparkContext.broadcast(_filter(wanted.select(_key().alias("key"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps("jaccard")
        for batch in batches:
            at = range(batch.num_rows)
            if bits is not None:
                places = _places(batch.column(1).to_numpy())
                at = np.flatnonzero((bits.value[places >> 3] >> (7 - (places & 7)).astype(np.uint8) & 1).all(axis=0)).tolist()
            texts = batch.column(0).cast(pa.binary())
            sets = [shingle_set(texts[i].as_py()) for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(map(_digest, sets), pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "held"])

    made = texts.select("text", _key().alias("key")).mapInArrow(run, "node binary, held array<long>").where(F.col("node").isNotNull())
    return made.dropDuplicates(["node"]) if repeats else made


def _band(n: Column, shift: float = 0.0) -> Column:
    """Sizes by powers of 4/3: linked sets lie in the same or in neighbouring bands."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(DEN / NUM)) + shift).cast("int")


class _Join:
    """The state of one join: postings, members, sets, and the components found so far."""

    def __init__(self, docs: DataFrame):
        self.docs = docs
        spark = small_batches(docs).sparkSession
        rows = written(_sets(docs), "jaccard-rows")
        self.paths: dict[str, str] = {}
        self.listed = rows.where(F.col("slice").isNull()).select("doc_id", "text_hash", "n", "node")
        base = self._filed(_prefixes(docs, _summed(rows.where(F.col("slice").isNotNull()).select("slice", "counts"))))
        self.postings = base.where(F.col("token").isNotNull()).select("token", "split", "gid", "n", "pos", "lead_gid", "lead_n")
        members = base.where(F.col("token").isNull()).select("gid", "node", "n", "bits")
        shared = members.groupBy("gid").count().where(F.col("count") > 1).select("gid").union(self.postings.select("gid")).distinct()
        self.members = written(members.join(shared, "gid", "left_semi"), "jaccard-members")
        self.labels = self.kept("labels", self.members.select("node", F.col("node").alias("comp")).distinct())
        self.first = written(self.listed.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"), F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids")), "jaccard-first")
        self.repeats = not self.first.where(F.col("rows") > F.col("ids")).isEmpty()
        self.sets: DataFrame | None = None
        self.tested: DataFrame | None = None

    def _filed(self, prefixes: DataFrame) -> DataFrame:
        """Postings that may link something and, with null tokens, the nodes themselves: one pass, one exchange, one written table.

        A posting's size and position travel as one number, after its token and before its group: rows of one set follow each other
        in an exchange's blocks, which then hold little besides tokens.
        """
        entries = F.concat(F.array(F.lit(None).cast("long")), "tokens")
        filed = prefixes.select("gid", "n", "node", "bits", "splits", F.posexplode(entries).alias("at", "token"))
        posting = F.col("token").isNotNull()
        split = F.when(posting, F.get("splits", F.col("at") - 1)).otherwise(F.lit(1))
        place = F.shiftleft(F.col("n").cast("long"), 32) + F.greatest(F.col("at") - 1, F.lit(0))
        salt = F.when(posting, F.pmod(F.col("gid"), split)).otherwise(F.col("gid"))  # nodes are dealt by their groups
        own = lambda c: F.when(~posting, F.col(c)).alias(c)
        filed = filed.select("token", place.alias("place"), "gid", split.alias("split"), salt.alias("salt"), own("node"), own("bits"))
        filed = filed.repartition("token", "salt").dropDuplicates(["token", "salt", "gid", "node"])
        filed = filed.select("token", "salt", "split", "gid", F.shiftright("place", 32).cast("int").alias("n"), F.col("place").bitwiseAND(F.lit(2**31 - 1)).cast("int").alias("pos"), "node", "bits")
        list_of = Window.partitionBy("token", "salt")
        several = filed.withColumns({"rows": F.count(F.lit(1)).over(list_of), "m": F.sum("n").over(list_of) - F.col("n"), "p": F.sum("pos").over(list_of) - F.col("pos")})
        # Most lists have two entries, so each knows the other's size and position: pairs that can't link go at once.
        pair = (F.col("rows") == 2) & (DEN * F.least("n", "m") >= NUM * F.greatest("n", "m")) & ((NUM + DEN) * F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("p")) >= NUM * (F.col("n") + F.col("m")))
        left = several.where(F.col("token").isNull() | (F.col("split") > 1) | (F.col("rows") > 2) | pair).withColumn("band", _band(F.col("n")))
        # The first round's leaders are found here, where each list is together: groups stand for themselves. A small position means few
        # rarer shingles before this one: that member has least of its own, and links best.
        lead = F.min(F.struct("pos", F.xxhash64("gid").alias("at"), "gid", "n")).over(Window.partitionBy("token", "salt", "band"))
        left = left.withColumn("lead", F.when(F.col("token").isNotNull(), lead))
        return self.kept("postings", left.select("token", "split", "gid", "n", "pos", "node", "bits", F.col("lead.gid").alias("lead_gid"), F.col("lead.n").alias("lead_n")))

    def kept(self, name: str, df: DataFrame) -> DataFrame:
        """Writes the state's newest version of a table and removes the one before, from which it was made."""
        spark = df.sparkSession
        path = new_folder(spark, f"jaccard-{name}")
        df.write.parquet(path)
        if name in self.paths:
            removed(spark, self.paths[name])
        self.paths[name] = path
        return spark.read.schema(df.schema).parquet(path)

    def entities(self, least: int = 0) -> DataFrame:
        """Postings (of lists with more than ``least`` entries) by component: token, split, gid, n, pos, comp, and one member of it."""
        present = self.members.select("gid", "node").join(self.labels, "node").groupBy("gid", "comp").agg(F.min("node").alias("node"))
        postings = self.postings.where(F.col("entries") > least) if least else self.postings
        return postings.join(present, "gid")

    def star_pairs(self, turn: int) -> DataFrame:
        """In each list, by salt and size band: one node of each component with that of a leading one."""
        if turn:
            # First comes who has a small position, or any: turns take different leaders.
            first = F.col("pos") if turn % 2 == 0 else F.xxhash64("node", F.lit(turn))
            placed = self.entities(LONG_LIST).select("token", _band(F.col("n"), 0.5 * turn).alias("band"), "comp", F.struct(first.alias("first"), F.col("n"), F.col("node")).alias("x"))
            once = placed.groupBy("token", "band", "comp").agg(F.min("x").alias("x"), F.count(F.lit(1)).alias("size"))
            # A list's salts follow the number of components that it has left.
            large = once.groupBy("token", "band").agg((F.floor(F.count(F.lit(1)) / SALT_ROWS) + 1).alias("salts"))
            once = once.join(large, ["token", "band"]).withColumn("salt", F.pmod(F.xxhash64("comp", F.lit(turn)), "salts"))
            lead = F.min(F.struct((-F.col("size")).alias("size"), F.col("x.first").alias("first"), F.xxhash64("x.node").alias("at"), F.col("x.n").alias("n"), F.col("x.node").alias("node")))
            led = once.withColumn("lead", lead.over(Window.partitionBy("token", "salt", "band")))
            pairs = led.where(F.col("lead.node") != F.col("x.node")).select(F.col("lead.node").alias("p"), F.col("x.node").alias("q"), F.col("lead.n").alias("m"), F.col("x.n").alias("n"))
        else:  # no components yet: groups stand for themselves
            pairs = self.postings.where(F.col("lead_gid") != F.col("gid")).select(F.col("lead_gid").alias("p"), F.col("gid").alias("q"), F.col("lead_n").alias("m"), "n")
        pairs = pairs.where(DEN * F.least("m", "n") >= NUM * F.greatest("m", "n")).groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.min("p").alias("hub"))
        if turn:
            return pairs
        heads = self.members.groupBy("gid").agg(F.min("node").alias("head"))
        for side in "ab":
            pairs = pairs.join(heads.select(F.col("gid").alias(side), F.col("head").alias(f"{side}_")), side)
        across = pairs.select(F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b"), F.when(F.col("hub") == F.col("a"), F.col("a_")).otherwise(F.col("b_")).alias("hub"))
        inside = self.members.select("gid", "node").join(heads, "gid").where(F.col("node") != F.col("head")).select(F.col("head").alias("a"), F.col("node").alias("b"), F.col("head").alias("hub"))
        return across.unionByName(inside).groupBy("a", "b").agg(F.min("hub").alias("hub"))

    def narrow(self) -> None:
        """Keeps the lists in which more than one component is left, and notes how long they are. Components are told apart by a 64-bit hash."""
        here = self.entities().select("token", "split", "gid", "n", "pos", F.xxhash64("comp").alias("comp"))
        here = here.withColumn("salt", F.pmod("gid", "split").cast("int"))
        list_of = Window.partitionBy("token", "salt")
        marks = {"least": F.min("comp").over(list_of), "most": F.max("comp").over(list_of), "entries": F.count(F.lit(1)).over(list_of)}
        marked = lambda df: df.repartition("token", "salt").withColumns(marks)
        names = ["token", "split", "gid", "n", "pos", "entries"]
        once = lambda df: df.where(F.col("least") != F.col("most")).dropDuplicates(["token", "salt", "gid"]).select(*names)
        out = once(marked(here.where(F.col("split") == 1)))
        if not self.postings.where(F.col("split") > 1).isEmpty():
            # A list of several salts is long or short, mixed or not, by all of them: one row a salt is put together.
            hot = written(marked(here.where(F.col("split") > 1)).select("token", "salt", "split", "gid", "n", "pos", "least", "most", "entries"), "jaccard-hot")
            whole = hot.groupBy("token", "salt").agg(F.first("least").alias("least"), F.first("most").alias("most"), F.first("entries").alias("entries"))
            whole = whole.groupBy("token").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("entries").alias("entries"))
            out = out.unionByName(once(hot.drop("least", "most", "entries").join(whole, "token")))
        self.postings = self.kept("postings", out)

    def rest_pairs(self) -> DataFrame:
        """All pairs of nodes that share a token or a group, lie in different components and pass the filters.

        Short lists are joined by token alone, so both sides are one exchange; long ones by token, size band and salt: one side is
        dealt over the salts, the other goes to all of them. Components are told apart by a 64-bit hash.
        """
        labels = self.labels.select("node", F.xxhash64("comp").alias("comp"))
        held = self.members.select("gid", "node", "n").join(labels, "node")
        present = held.select("gid", "n", "comp").distinct()
        here = self.postings.select("token", "gid", "pos", "entries").join(present, "gid").select("token", "gid", "n", "pos", "comp", "entries")
        several = present.groupBy("gid").count().where(F.col("count") > 1).select("gid")
        inside = present.join(several, "gid", "left_semi").select((-F.col("gid")).alias("token"), "gid", "n", F.lit(0).alias("pos"), "comp")
        side = lambda df, s, *keys: df.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in ("gid", "n", "pos", "comp")])
        short = here.where(F.col("entries") <= LONG_LIST).drop("entries").unionByName(inside)
        long_ = here.where(F.col("entries") > LONG_LIST).withColumns({"band": _band(F.col("n")), "salts": F.floor(F.col("entries") / SALT_ROWS)})
        ahead = long_.withColumn("band", F.explode(F.array("band", F.col("band") - 1))).withColumn("salt", F.pmod(F.xxhash64("gid"), F.col("salts") + 1))
        long_ = long_.withColumn("salt", F.explode(F.sequence(F.lit(0), "salts")))
        open_ = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
        test = (F.struct("n_a", "gid_a", "comp_a") < F.struct("n_b", "gid_b", "comp_b")) & (F.col("comp_a") != F.col("comp_b")) & (NUM * F.col("n_b") <= DEN * F.col("n_a")) & ((NUM + DEN) * open_ >= NUM * (F.col("n_a") + F.col("n_b")))
        named = ["gid_a", "comp_a", "gid_b", "comp_b"]
        pairs = side(short, "a", "token").join(side(short, "b", "token"), "token").where(test).select(*named)
        pairs = pairs.unionByName(side(long_, "a", "token", "band", "salt").join(side(ahead, "b", "token", "band", "salt"), ["token", "band", "salt"]).where(test).select(*named)).distinct()
        ends = [held.select(F.col("gid").alias(f"gid_{s}"), F.col("comp").alias(f"comp_{s}"), F.col("node").alias(f"node_{s}")) for s in "ab"]
        expanded = pairs.join(ends[0], ["gid_a", "comp_a"]).join(ends[1], ["gid_b", "comp_b"])
        return expanded.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct().withColumn("hub", F.col("a"))

    def passing(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and bitmaps leave room for a link."""
        of = lambda s: self.members.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))
        both = pairs.join(of("a"), "a").join(of("b"), "b")
        size = F.least(F.size("bits_a"), F.size("bits_b"))  # sizes of linked sets differ by a third at most: one fold is enough
        xor = lambda x, y: x.bitwiseXOR(y)
        folded = lambda c: F.when(F.size(c) > size, F.zip_with(F.slice(c, F.lit(1), size), F.slice(c, size + 1, size), xor)).otherwise(F.col(c))
        both = both.where(DEN * F.least("n_a", "n_b") >= NUM * F.greatest("n_a", "n_b"))
        differing = F.aggregate(F.zip_with(folded("bits_a"), folded("bits_b"), lambda x, y: F.bit_count(xor(x, y))), F.lit(0), lambda acc, x: acc + x)
        total = (F.col("n_a") + F.col("n_b")).cast("long")
        return both.where((NUM + DEN) * (total - differing) >= 2 * NUM * total).select("a", "b", "hub")

    def fetch(self, nodes: DataFrame, few: bool) -> None:
        """Sees to it that ``sets`` has these nodes: sets made before are there, the others are made from the texts and written."""
        new = nodes if self.sets is None else nodes.join(self.sets.select("node"), "node", "left_anti")
        wanted = self.first.join(F.broadcast(new) if few else new, "node", "left_semi").select("row.doc_id", "row.text_hash", "node")
        made = written(_candidate_sets(self.docs, wanted, self.repeats, few), "jaccard-sets")
        self.sets = made if self.sets is None else self.sets.unionByName(made)

    def link(self, pairs: DataFrame, name: str) -> bool:
        """Verifies pairs that were not tested before and merges what links; whether anything did."""
        if self.tested is not None:
            pairs = pairs.join(self.tested.select("a", "b"), ["a", "b"], "left_anti")
        pairs = written(self.passing(pairs), f"jaccard-{name}")
        self.tested = pairs if self.tested is None else self.tested.unionByName(pairs)
        count = pairs.count()
        if not count:
            return False
        few = 2 * count <= FEW_ROWS  # counted: neither the pairs nor their nodes are more; a shuffle joins them otherwise
        if_few = F.broadcast if few else lambda df: df
        self.fetch(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), few)
        # Every pair brings the set of its other end to its hub: a star's sets move once, its centre's set is read once.
        ends = if_few(pairs.withColumn("node", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a"))))
        centres = self.sets.join(if_few(pairs.select(F.col("hub").alias("node")).distinct()), "node", "left_semi").select(F.col("node").alias("hub"), F.col("held").alias("x"))
        both = self.sets.select("node", F.col("held").alias("y")).join(ends, "node").join(centres, "hub")
        met = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("met"), (F.size("x") + F.size("y")).cast("long").alias("sum"))
        links = written(met.where(DEN * F.col("met") >= NUM * (F.col("sum") - F.col("met"))).select("a", "b"), f"jaccard-{name}-links")
        if links.isEmpty():
            return False
        of = lambda side: self.labels.select(F.col("node").alias(side), F.col("comp").alias(f"comp_{side}"))
        edges = links.join(of("a"), "a").join(of("b"), "b").select(F.col("comp_a").alias("u"), F.col("comp_b").alias("v")).distinct()
        roots = components(edges).select(F.col("u").alias("comp"), "root")
        self.labels = self.kept("labels", self.labels.join(roots, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")))
        return True

    def run(self) -> DataFrame:
        self.link(self.star_pairs(0), "star0")
        self.narrow()
        for turn in range(1, MOST_ROUNDS):
            if self.postings.where(F.col("entries") > LONG_LIST).isEmpty() or not self.link(self.star_pairs(turn), f"star{turn}"):
                break
            self.narrow()
        self.link(self.rest_pairs(), "rest")
        rows = self.listed
        firsts = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("known"), F.min("text_hash").alias("any"))
        named = firsts.join(self.labels, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), F.coalesce("known", F.struct(F.lit(None).cast(dict(rows.dtypes)["doc_id"]).alias("doc_id"), F.col("any").alias("text_hash"))).alias("row"))
        heads = named.groupBy("comp").agg(F.min(F.when(F.col("row.doc_id").isNotNull(), F.col("row"))).alias("known"), F.min("row.text_hash").alias("any"))
        head = named.select("node", "comp").join(heads, "comp").select("node", F.col("known.doc_id").alias("head_id"), F.coalesce("known.text_hash", "any").alias("head_hash"))
        out = rows.join(head, "node", "left")
        return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("head_id")).otherwise(F.col("doc_id")).alias("component_id"), F.when(F.col("n") > 0, F.col("head_hash")).otherwise(F.col("text_hash")).alias("head_hash"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of documents (doc_id, text): doc_id, text_hash, n_shingles, component_id, and the text hash of the component's first row."""
    return _Join(docs.select("doc_id", "text")).run()


def one_of_each(docs: DataFrame) -> DataFrame:
    """Documents, all columns, with one row kept of each component: that with the smallest id (ties: the smaller text hash)."""
    join = _Join(only(docs, "doc_id", "text"))
    wordless = join.listed.where(F.col("node").isNull()).groupBy("doc_id", "text_hash").count()
    repeats = join.repeats or not wordless.where(F.col("count") > 1).isEmpty()
    heads = join.run().where(F.col("component_id").eqNullSafe(F.col("doc_id")) & F.col("head_hash").eqNullSafe(F.col("text_hash")))
    key, known = free_names(docs, "hash", "id")
    heads = heads.select(F.col("doc_id").alias(known), F.col("text_hash").alias(key)).distinct()
    marked = docs.withColumn(key, F.xxhash64("text"))
    kept = marked.join(heads, marked["doc_id"].eqNullSafe(heads[known]) & (marked[key] == heads[key]), "left_semi")
    if repeats:  # rows of one id and one text are one document
        kept = kept.dropDuplicates(["doc_id", key])
    return kept.select(*quoted(docs))


def op6_query(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


def op6_sql() -> str:
    """The same by counting every pair's shared shingles, for tables whose ids are unique."""
    return f"""
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + {WORDS - 1}], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - {WORDS - 1}, 1) + 1)) as i from d where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as met from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where {DEN} * met >= {NUM} * (x.n + y.n - met)),
r as (select a, b from l union select r.a, l.b from r join l on r.b = l.a)
select doc_id, coalesce(n, 0) as n_shingles, least(doc_id, (select min(b) from r where a = doc_id)) as component_id from d left join n using (doc_id)
"""
