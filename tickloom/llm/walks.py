"""Document fingerprints by a randomised edit embedding, with bit-sampled banding and verification.

The embedding. A walk reads a text from its start. At each step it writes down the character that it stands on and, by a shared random
bit of (step, character), stays or moves on; so a text of n characters becomes a string of about 2n. Walks over two texts that differ by few
edits fall into step again soon after each, so the edit distance becomes a Hamming distance of the embedded strings. Here the
random bits repeat after ``PERIOD`` steps and characters share them by classes, which makes the walk a chain of table lookups; and what is
written down for a step is a digit hashed from the ``GRAM`` characters from there on, so that unlike texts agree by chance alone.

The fingerprint samples the embedding at fixed random steps: ``SAMPLES`` of each doubling of its length (all of them where there are fewer), one hex
digit a step, and ``.`` for a step past the end. Doublings count by their length, so the share of equal digits estimates the share of equal steps, whatever the lengths;
the chance of equal digits is taken off: ``likeness`` is 1 for equal fingerprints and about 0 for unlike texts. Equal texts have equal
fingerprints.

``near_pairs`` finds documents with like fingerprints: equal fingerprints are one class; each of ``BANDS`` bands samples ``BAND`` digits, and classes that
agree in a band are candidates, whose likeness is verified. In a band's bucket, members are compared by blocks of their order; a bucket larger than a block is
compared block against block, in tasks of their own.

Pairing with the next document (``paired``): rows are dealt by ranges of falling doc_id and sorted in their range, so one pass over a range
has each row's next at hand. Only the rows at the ranges' ends wait, and are put together afterwards: two rows a range.

Defined results: a null text is empty; an empty text has an empty fingerprint, like only to another empty one (1) and unlike any other
(0); null ids come last in falling order; rows of one id are ordered by their text's hash, then by the text; equal rows are rows of their own,
each the next of another; a single row is its own next; an empty table gives no rows; very long texts are walked whole; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate
from operator import getitem, itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import arrow_rows, worker_keeps, written

SEED = 12
PERIOD = 1_024
CLASSES = 32
GRAM = 4
SAMPLES = 64
LONGEST = 48  #: doublings of an embedding's length that have samples; none is longer

BANDS, BAND = 64, 6
BLOCK = 256
NEAR = 0.75

SLICE_BYTES = 32_000_000
MOST_SLICES = 20_000
ARROW_ROWS = 500

_DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)
_PAST = ord(".")


class Embedding:
    """The shared random bits and sampled steps, made from a seed."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        bits = rng.integers(0, 2, (PERIOD, CLASSES), np.uint8)
        bits[-1] = 1  # no walk stays for a whole period
        self.bits = bits
        # From each step, the step after the next one that moves on.
        after = np.empty((PERIOD, CLASSES), np.int64)
        first = np.argmax(bits == 1, axis=0) + PERIOD
        for step in range(PERIOD - 1, -1, -1):
            first = np.where(bits[step] == 1, step, first)
            after[step] = (first + 1) % PERIOD
        # A step is a list of the steps that follow it by class, its own number last: a walk is then one chain of lookups.
        self.steps: list[list] = [[] for _ in range(PERIOD)]
        for number, step in enumerate(self.steps):
            step.extend(self.steps[i] for i in after[number].tolist())
            step.append(number)
        parts = [np.arange(2**k - 1, 2 ** (k + 1) - 1) if 2**k <= SAMPLES else np.sort(rng.integers(2**k - 1, 2 ** (k + 1) - 1, SAMPLES)) for k in range(LONGEST)]
        self.samples, self.ends = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        self.factors = rng.integers(1, 2**63, GRAM).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.class_factor = np.uint32(rng.integers(1, 2**31) * 2 + 1)

    def walk(self, codes: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """The step at which each character's stay begins, and the embedding's length. known: the same of the first characters."""
        known = np.zeros(1, np.int64) if known is None else known
        rest = codes[len(known) - 1 :]
        classes = ((rest * self.class_factor) >> np.uint32(32 - CLASSES.bit_length() + 1)).astype(np.uint8).tobytes()
        numbers = np.fromiter(map(itemgetter(CLASSES), accumulate(classes, getitem, initial=self.steps[int(known[-1]) % PERIOD])), np.int16, len(rest) + 1)
        begins = np.empty(len(codes) + 1, np.int64)
        begins[: len(known)] = known
        np.cumsum(np.diff(numbers) % PERIOD, out=begins[len(known) :])
        begins[len(known) :] += known[-1]
        return begins

    def sampled(self, codes: np.ndarray, begins: np.ndarray) -> str:
        """The fingerprint of a walk over some characters."""
        steps = self.samples[: self.ends[int(begins[-1]).bit_length()]]
        inside = steps[: np.searchsorted(steps, begins[-1])]
        at = np.searchsorted(begins, inside, "right") - 1
        padded = np.concatenate((codes.astype(np.uint64) + np.uint64(1), np.zeros(GRAM, np.uint64)))
        hashed = np.zeros(len(at), np.uint64)
        for i, factor in enumerate(self.factors):
            hashed = (hashed ^ padded[at + i]) * factor
            hashed ^= hashed >> np.uint64(29)
        digits = np.full(len(steps), _PAST, np.uint8)
        digits[: len(inside)] = _DIGITS[(hashed >> np.uint64(40)) & np.uint64(15)]
        return digits.tobytes().decode("ascii")

    def fingerprint(self, text: str | None) -> str:
        if not text:
            return ""
        codes = codes_of(text)
        return self.sampled(codes, self.walk(codes))


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _weights(n: int) -> np.ndarray:
    """How many steps each digit of a fingerprint stands for."""
    sizes, total, k = [], 0, 0
    while total < n:
        held = min(2**k, SAMPLES)
        sizes.append(np.full(held, 2**k / held))
        total, k = total + held, k + 1
    return np.concatenate(sizes) if sizes else np.zeros(0)


_WEIGHTS = _weights(2 * SAMPLES - 1 + LONGEST * SAMPLES)


def likeness(a: str, b: str) -> float:
    """The estimated share of equal steps beyond chance, 0 to 1."""
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    x, y = (np.frombuffer(s.ljust(n, ".").encode("ascii"), np.uint8) for s in (a, b))
    weights = _WEIGHTS[:n] * ((x != _PAST) | (y != _PAST))
    share = float(weights[x == y].sum() / weights.sum())
    return max(0.0, (share - 1 / 16) / (1 - 1 / 16))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many characters, or all, of the start of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n_chars, fingerprint of each (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedding = worker_keeps(("walks", seed), lambda: Embedding(seed))
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(embedding.fingerprint, texts), pa.string())], ["doc_id", "n_chars", "fingerprint"])

    with arrow_rows(docs.sparkSession, ARROW_ROWS):
        kind = docs.schema["doc_id"].dataType.simpleString()
        return written(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_chars long, fingerprint string"), "walks")


#: What a row becomes: finished, or waiting at an end of its range with its text.
_PAIRED = "doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, range long, place string, text string"


class _Pairs:
    """Finished rows of texts and their next ones; each text is walked once, and an edited one from where it differs."""

    def __init__(self, embedding: Embedding):
        self.embedding = embedding

    def read(self, text: str) -> tuple[str, np.ndarray, str]:
        """A text with its walk and fingerprint."""
        codes = codes_of(text)
        walk = self.embedding.walk(codes)
        return text, walk, self.embedding.sampled(codes, walk) if text else ""

    def row(self, doc_id: object, text: str, walk: np.ndarray, mark: str, following: str, next_mark: str) -> dict[str, object]:
        changed, same = edited(text, following), len(text) - len(text) // 2
        edited_mark = mark
        if changed != text:
            codes = codes_of(changed)
            edited_mark = self.embedding.sampled(codes, self.embedding.walk(codes, walk[: same + 1]))
        return {
            "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(), "fingerprint": mark, "edited_fingerprint": edited_mark,
            "near_edited": likeness(mark, edited_mark), "near_next": likeness(mark, next_mark),
        }


def paired(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Each (doc_id, text) with its own fingerprint, that of its edited text (``edited`` by the next document in falling doc_id), and its likeness to that and to the next document's."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = min(max(1, -(-size // SLICE_BYTES)), MOST_SLICES)
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = plain.repartitionByRange(slices, *order).sortWithinPartitions(*order, "text").withColumn("range", F.spark_partition_id().cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = worker_keeps(("walks-pairs", seed), lambda: _Pairs(Embedding(seed)))
        schema = None
        before: tuple | None = None
        for batch in batches:
            schema = schema or pa.schema([("doc_id", batch.schema.field(0).type), ("n_chars", pa.int64()), *[(n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64()), ("range", pa.int64()), ("place", pa.string()), ("text", pa.string())])
            out: list[dict[str, object]] = []
            for doc_id, text, part in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                text, walk, mark = pairs.read(text.as_py())
                if before is None:
                    out.append({"range": part, "place": "first", "text": text, "fingerprint": mark})
                else:
                    out.append(pairs.row(*before, text, mark))
                before = (doc_id, text, walk, mark)
            yield pa.RecordBatch.from_pylist(out, schema)
        if before is not None:
            yield pa.RecordBatch.from_pylist([{"doc_id": before[0], "text": before[1], "fingerprint": before[3], "range": part, "place": "last"}], schema)

    with arrow_rows(spark, ARROW_ROWS):
        held = written(dealt.mapInArrow(run, _PAIRED.format(kind=kind)), "walks-ranges", "zstd")  # digits have half a byte each, and zstd finds it
    finished = held.where(F.col("place").isNull()).drop("range", "place", "text")
    # The ranges that have rows: one number each.
    ranges = sorted(r["range"] for r in held.where("place = 'last'").select("range").collect())
    if not ranges:
        return finished
    following = spark.createDataFrame(list(zip(ranges, ranges[1:] + ranges[:1], strict=True)), "range long, following long")
    firsts = held.where("place = 'first'").select(F.col("range").alias("following"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_mark"))
    waiting = held.where("place = 'last'").select("doc_id", "text", "fingerprint", "range").join(following, "range").join(firsts, "following")

    names = finished.columns

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = worker_keeps(("walks-pairs", seed), lambda: _Pairs(Embedding(seed)))
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                one = pairs.row(None, *pairs.read(row["text"]), row["next_text"], row["next_mark"])
                rest = pa.RecordBatch.from_pylist([{k: v for k, v in one.items() if k != "doc_id"}])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *rest.columns], names)

    with arrow_rows(spark, ARROW_ROWS):
        done = written(waiting.select("doc_id", "text", "fingerprint", "next_text", "next_mark").mapInArrow(end, ", ".join(f"{n} {k}" for n, k in finished.dtypes)), "walks-ends")
    return finished.unionByName(done)


def band_keys(marks: DataFrame, bands: int = BANDS, band: int = BAND, seed: int = SEED) -> DataFrame:
    """(class, band, key) of each (class, fingerprint): in each band, digits sampled by the steps they stand for.

    Digits are drawn in the upper half of a text's doublings or a band of the same rule for the doubling before it, so that texts whose
    lengths lie on both sides of a power of two still meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps("walks-bands")
        drawn: dict[int, np.ndarray] = {}
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for cls, mark in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                ends = _ends(len(mark))
                for top in {len(ends), len(ends) - 1} - {0}:
                    if top not in drawn:
                        n = ends[top - 1]
                        drawn[top] = np.random.default_rng(seed * 1_000 + top).choice(n, (bands, band), p=_WEIGHTS[:n] / _WEIGHTS[:n].sum())
                    held = np.frombuffer(mark.encode("ascii"), np.uint8)
                    for b, at in enumerate(drawn[top]):
                        digits = held[at]
                        if (digits != _PAST).all():
                            out[0].append(cls.as_py())
                            out[1].append(top * bands + b)
                            out[2].append(digits.tobytes().decode("ascii"))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.column(0).type), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], ["class", "band", "key"])

    kind = marks.schema["class"].dataType.simpleString()
    return marks.select("class", "fingerprint").mapInArrow(run, f"class {kind}, band long, key string")


def _ends(n: int) -> list[int]:
    """Where each doubling of a fingerprint of so many digits ends."""
    out, total, k = [], 0, 0
    while total < n:
        total, k = total + min(2**k, SAMPLES), k + 1
        out.append(total)
    return out


def near_pairs(docs: DataFrame, least: float = NEAR, bands: int = BANDS, band: int = BAND, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Classes and links of (doc_id, text): (doc_id, class), where documents of one fingerprint share a class, called after the smallest id; and
    (a, b, likeness) of classes a < b that share a band and are at least so alike.

    Null ids have no class name and take no part; empty texts link with nothing.
    """
    marks = fingerprints(docs.where(F.col("doc_id").isNotNull()), seed)
    some = marks.where(F.length("fingerprint") > 0)
    classes = written(some.groupBy("fingerprint").agg(F.min("doc_id").alias("class")), "walks-classes")
    members = marks.join(classes, "fingerprint", "left").select("doc_id", F.coalesce("class", "doc_id").alias("class"))
    keys = written(band_keys(classes, bands, band, seed), "walks-keys")
    # A bucket's members in blocks: a member meets the members of its own block and, by block numbers, those of each other block.
    sizes = keys.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    held = keys.join(sizes, ["band", "key"]).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
    left = held.select("band", "key", "block", F.col("class").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    right = held.select("band", "key", F.col("block").alias("other"), F.col("class").alias("b"))
    met = left.join(right, ["band", "key", "other"]).where("a < b").select("a", "b").distinct()
    side = lambda name: classes.select(F.col("class").alias(name), F.col("fingerprint").alias(f"{name}_mark"))
    both = met.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_mark", "b_mark")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [likeness(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["a", "b", "likeness"])

    kind = classes.schema["class"].dataType.simpleString()
    links = both.mapInArrow(verify, f"a {kind}, b {kind}, likeness double").where(F.col("likeness") >= least)
    return members, links


def op12_query(docs: DataFrame) -> DataFrame:
    return paired(docs)
