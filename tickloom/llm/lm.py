"""Language-model scores: corpus-wide word counts, and a small causal self-attention model over subword ids.

Words: A-Z lower-cased, runs of ``[^\\x20\\x09-\\x0D]``, then one end. The base score is the add-one unigram over exact counts of
all training rows. The model's probability of a word given what precedes it is

    mix * (c + 1) / (N + V + 1)  +  (1 - mix) * product of its subwords' probabilities,

the first part being the base's. So a word that training has not seen keeps the base's fixed share, however it is spelled, and like
the base the score adds up to one only where all unseen words count as one. A subword's probability is that of its class given the context, from one layer of
masked self-attention, times its share of the class. Texts are cut into blocks of ``STRIDE`` subwords; a window is a block
and the block before it; each window scores its own block, so every subword is scored once with STRIDE to 2 * STRIDE - 1
subwords (and itself) in view.

Scale. Rows are dealt by hash into parts of about ``PART_BYTES`` of text. A part's distinct words (not its tokens) go
through the one shuffle that sums counts, are written with their totals, and come back to the part; a word that every text
has costs one row a part. Nothing of the vocabulary is broadcast.

Learning. The subword counts (which subwords are frequent, their shares of a class; taken from the distinct words and their
totals) and the counts of neighbours that the classes come from are exact sums over all training rows. The weights start from ``STEPS`` steps of one task on at most
``SAMPLE_ROWS`` distinct texts (``SAMPLE_TEXT`` bytes of each), which spares each learner its first steps; then every distinct text is learnt
from whole, at any size: texts are dealt by hash to learners, about ``LEARNER_TEXTS`` each; a learner goes once through its texts' windows
in order of hash, and the learners' weights are averaged by their numbers of windows. Sums are of whole numbers, so neither their order nor the number of tasks and
partitions matters. What is broadcast is the network, of fixed size.

Defined results: a null text is the empty text: one end token. Without training rows all counts are 0 and the score is
the base score. Repeated rows each give a row; a null id is not held out; very long texts are scored whole, block by block; an empty
table gives no rows; only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import pickle
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import as_strided
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import new_folder, remainder, removed, small_batches, worker_keeps, written

PART_BYTES = 16_000_000
SAMPLE_ROWS, SAMPLE_TEXT = 1_000, 60_000
LEARN_EVERY, LEARN_IDS, LEARN_RATE = 1, 2_000_000, 0.001  # every distinct text is learnt from
LEARNER_TEXTS, TEXTS_AT_ONCE = 8_000, 500
SIGNS, PAIRS, CHUNK, FIXED_POINT = 48, 4_000_000, 4_096, 2.0**24
STRIDE, WIDTH, HIDDEN, CLASSES, FREQUENT = 16, 16, 16, 64, 8_000
MIX = 0.4
STEPS, BATCH = 1_500, 192
END = b""  # no word is empty


class Subwords(dict):
    """Subword ids of words (as 32-bit numbers, for the word after a space) by a public vocabulary; looked-up words are kept for two generations."""

    def __init__(self, path: str, pattern: str, cached: int = 300_000):
        import tiktoken

        super().__init__()
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb").read().split(b"\n") if line.strip())}
        self.size = max(ranks.values()) + 1
        self.encode = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cached = cached
        self.old: dict[bytes, bytes] = {}
        self.of = self.__getitem__

    def __missing__(self, word: bytes) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = array("i", self.encode(" " + word.decode())).tobytes()
        if len(self) >= self.cached:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


def subwords(path: str, pattern: str) -> Subwords:
    """This Python worker's vocabulary."""
    return worker_keeps(("lm", path, pattern), lambda: Subwords(path, pattern))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: only A-Z are lower-cased, and only ASCII white space parts words."""
    return text.lower().split() if text else []


def _total(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, by a product: faster than a reduction where the axis is short."""
    return (x @ np.ones(x.shape[-1], x.dtype))[..., None]


#: By query and key of a window, and what a query may see: itself and what lies before.
DISTANCE = np.arange(STRIDE)[:, None] + STRIDE - np.arange(2 * STRIDE)[None, :]
SEEN = (DISTANCE >= 0).astype(np.float32)


class Network:
    """The attention model. Ids 0..FREQUENT-1 are frequent subwords, then one for all rare ones, the end, the start and the blank."""

    def __init__(self, counts: np.ndarray, seed: int = 7):
        size = len(counts)
        order = np.argsort(-counts, kind="stable")
        frequent = order[: min(FREQUENT, int((counts > 0).sum()))]
        self.rare, self.end, self.start, self.blank = (len(frequent) + i for i in range(4))
        self.place = np.full(size, self.rare, np.int32)
        self.place[frequent] = np.arange(len(frequent))
        self.n = len(frequent) + 4
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        d, h = WIDTH, HIDDEN
        self.p = {"x": normal(self.n, d, scale=0.3), "q": normal(d, d, scale=d**-0.5), "k": normal(d, d, scale=d**-0.5), "v": normal(d, d, scale=d**-0.5), "o": normal(d, h, scale=d**-0.5), "s": normal(d, h, scale=d**-0.5), "b": np.zeros(h, np.float32), "w": normal(h, CLASSES, scale=h**-0.5), "c": np.zeros(CLASSES, np.float32), "r": np.zeros(2 * STRIDE, np.float32)}
        self.classes = np.zeros(self.n, np.int64)
        self.share = np.zeros(size + 1, np.float64)
        self.class_of = np.zeros(size + 1, np.int64)

    def signs(self, seed: int = 7) -> np.ndarray:
        """A random vector of -1 and 1 for each id."""
        return np.random.default_rng(seed).integers(0, 2, (self.n, SIGNS)) * 2 - 1

    def group(self, near: np.ndarray, counts: np.ndarray, ends: int) -> None:
        """Classes by k-means over the signs of what precedes and follows a subword; shares by smoothed counts."""
        near = near.astype(np.float32)
        seen = np.bincount(self.place, counts, self.n)
        seen[self.end] = ends
        seen = np.maximum(seen, 1).astype(np.float32)
        near /= np.sqrt(seen)[:, None]
        near /= np.linalg.norm(near, axis=1, keepdims=True) + 1e-6
        usual = CLASSES - 2  # the last two: the end, and rare subwords
        centres = near[np.argsort(-seen, kind="stable")[:usual]].copy()
        for _ in range(12):
            to = (near @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, to, near * np.sqrt(seen)[:, None])
            centres = sums / (np.linalg.norm(sums, axis=1, keepdims=True) + 1e-6)
        self.classes = to.astype(np.int64)
        self.classes[self.end], self.classes[[self.rare, self.start, self.blank]] = CLASSES - 2, CLASSES - 1
        weights = np.append(counts + 0.5, 1.0)  # the end, in its own class, comes last
        self.class_of = np.append(self.classes[self.place], CLASSES - 2)
        self.share = np.log(weights / np.bincount(self.class_of, weights, CLASSES)[self.class_of])

    def tables(self) -> None:
        """What depends on a subword alone is computed once for each."""
        p = self.p
        self.t = {"q": p["x"] @ p["q"] * np.float32(WIDTH**-0.5), "k": p["x"] @ p["k"], "v": p["x"] @ p["v"], "s": p["x"] @ p["s"] + p["b"]}

    def bias(self) -> np.ndarray:
        """By query and key of a window: the learnt bias of their distance."""
        return self.p["r"][np.clip(DISTANCE, 0, 2 * STRIDE - 1)]

    def class_scores(self, rows: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Log probability of the targets' classes for consecutive blocks (m + 1, STRIDE), the first of which is only context.

        Keys and values are looked up once a block; a block's window is the slice of it and the one before. Scores and logits
        beyond -60 and 60 count as these, instead of being shifted by their maximum: exp stays in range, passes are saved.
        """
        top = np.float32(60)
        windows = lambda x: as_strided(x, (len(x) - 1, 2 * STRIDE, WIDTH), x.strides)  # noqa: E731  (each block with the one before it, in place)
        key, value = windows(self.t["k"][rows]), windows(self.t["v"][rows])
        scores = np.matmul(self.t["q"][rows[1:]], key.transpose(0, 2, 1))
        scores += self.bias()
        np.clip(scores, -top, top, out=scores)
        np.exp(scores, out=scores)
        scores *= SEEN
        blank = rows == self.blank
        some = np.flatnonzero(blank[:-1].any(axis=1) | blank[1:].any(axis=1))
        if len(some):
            scores[some] *= ~np.concatenate((blank[some], blank[some + 1]), axis=1)[:, None, :]
        mixed = np.matmul(scores, value)
        mixed /= np.maximum(_total(scores), np.float32(1e-30))
        hidden = mixed.reshape(-1, WIDTH) @ self.p["o"]
        hidden += self.t["s"][rows[1:].reshape(-1)]
        np.maximum(hidden, 0, out=hidden)
        logits = hidden @ self.p["w"]
        logits += self.p["c"]
        np.clip(logits, -top, top, out=logits)
        picked = logits[np.arange(len(logits)), targets.reshape(-1)]
        np.exp(logits, out=logits)
        return (picked - np.log(_total(logits)[:, 0])).reshape(targets.shape)

    def step(self, own: np.ndarray, before: np.ndarray, targets: np.ndarray, wanted: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of the wanted targets and its gradients."""
        p, d = self.p, np.float32(WIDTH**-0.5)
        both = np.concatenate((before, own), axis=1)
        xo, xb = p["x"][own], p["x"][both]
        q, k, v = xo @ p["q"] * d, xb @ p["k"], xb @ p["v"]
        a = np.exp(np.clip(np.matmul(q, k.transpose(0, 2, 1)) + self.bias(), -60, 60)) * (SEEN * (both != self.blank)[:, None, :])
        a /= np.maximum(_total(a), np.float32(1e-30))
        mixed = np.matmul(a, v)
        pre = mixed @ p["o"] + xo @ p["s"] + p["b"]
        hidden = np.maximum(pre, 0)
        logits = hidden @ p["w"] + p["c"]
        np.clip(logits, -60, 60, out=logits)
        e = np.exp(logits)
        total = _total(e)
        n = max(1, int(wanted.sum()))
        at = np.take_along_axis(logits, targets[..., None], 2)[..., 0] - np.log(total[..., 0])
        g = e / total
        np.put_along_axis(g, targets[..., None], np.take_along_axis(g, targets[..., None], 2) - 1, 2)
        g *= (wanted / np.float32(n))[..., None].astype(np.float32)
        flat = lambda z: z.reshape(-1, z.shape[-1])
        grad = {"w": flat(hidden).T @ flat(g), "c": flat(g).sum(0)}
        gh = (g @ p["w"].T) * (pre > 0)
        grad["o"], grad["s"], grad["b"] = flat(mixed).T @ flat(gh), flat(xo).T @ flat(gh), flat(gh).sum(0)
        gm = gh @ p["o"].T
        ga = np.matmul(gm, v.transpose(0, 2, 1))
        gv = np.matmul(a.transpose(0, 2, 1), gm)
        gs = a * (ga - np.einsum("ijk,ijk->ij", ga, a)[..., None])
        gq, gk = np.matmul(gs, k) * d, np.matmul(gs.transpose(0, 2, 1), q)
        grad["q"], grad["k"], grad["v"] = flat(xo).T @ flat(gq), flat(xb).T @ flat(gk), flat(xb).T @ flat(gv)
        grad["r"] = np.bincount(np.clip(DISTANCE, 0, 2 * STRIDE - 1).reshape(-1), gs.sum(axis=0).reshape(-1), 2 * STRIDE).astype(np.float32)
        # Inputs occur often: their gradients are sorted by id and added up in runs.
        ids, parts = np.concatenate((own.reshape(-1), both.reshape(-1))), np.concatenate((flat(gh @ p["s"].T + gq @ p["q"].T), flat(gk @ p["k"].T + gv @ p["v"].T)))
        order = np.argsort(ids.astype(np.uint16) if self.n < 2**16 else ids, kind="stable")
        first = np.flatnonzero(np.diff(ids[order], prepend=-1))
        grad["x"] = np.zeros_like(p["x"])
        grad["x"][ids[order[first]]] = np.add.reduceat(parts[order], first, axis=0)
        return float(-(at * wanted).sum() / n), grad


def laid_out(network: Network, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts' subwords as blocks: inputs (blocks, STRIDE), the place in ``ids`` that each input predicts (-1: none), and whether a block is a text's lead.

    ``ids`` holds all texts one after another, each closed by its end; ``ends`` has the place after each. An input row is the text's
    ids behind a start. Before each text lies a block of blanks.
    """
    begins = np.concatenate(([0], ends[:-1]))
    lengths = ends - begins
    blocks = -(-lengths // STRIDE) + 1
    first = np.cumsum(blocks) - blocks
    inputs = np.full(int(blocks.sum()) * STRIDE, network.blank, np.int32)
    target = np.full(len(inputs), -1, np.int64)
    at = np.repeat((first + 1) * STRIDE - begins, lengths) + np.arange(len(ids))
    target[at] = np.arange(len(ids))
    shifted = np.empty(len(ids), np.int32)
    shifted[1:] = ids[:-1]
    shifted[begins] = network.start
    inputs[at] = shifted
    lead = np.zeros(len(inputs) // STRIDE, bool)
    lead[first] = True
    return inputs.reshape(-1, STRIDE), target.reshape(-1, STRIDE), lead


class Neighbours:
    """Sums of the signs of what precedes and what follows each id; pairs are counted before they are added up."""

    def __init__(self, network: Network, seed: int = 7):
        self.n, self.sign = network.n, network.signs(seed).astype(np.int32)
        self.near = np.zeros((network.n, 2 * SIGNS), np.int64)
        self.pairs: list[np.ndarray] = []
        self.held = 0

    def add(self, sequence: np.ndarray) -> None:
        for i in range(0, len(sequence) - 1, PAIRS):  # a pair's code fits 32 bits: ids are few
            part = sequence[i : i + PAIRS + 1].astype(np.uint32)
            self.pairs.append(part[:-1] * np.uint32(self.n) + part[1:])
            self.held += len(self.pairs[-1])
            if self.held > PAIRS:
                self.settle()

    def settle(self) -> np.ndarray:
        """Adds the pairs to the sums; a number of a sum within a call stays below the number of pairs."""
        codes, times = np.unique(np.concatenate(self.pairs or [np.zeros(0, np.uint32)]), return_counts=True)
        times = times.astype(np.int32)
        before, after = (codes // np.uint32(self.n)).astype(np.uint16), (codes % np.uint32(self.n)).astype(np.uint16)
        for of, other, order, side in ((before, after, np.arange(len(codes)), slice(SIGNS, None)), (after, before, np.argsort(after, kind="stable"), slice(0, SIGNS))):
            for i in range(0, len(order), 16_384):
                some = order[i : i + 16_384]
                first = np.flatnonzero(np.diff(of[some].astype(np.int32), prepend=-1))
                self.near[of[some[first]], side] += np.add.reduceat(self.sign[other[some]] * times[some, None], first, axis=0)
        self.pairs.clear()
        self.held = 0
        return self.near


def raw_ids(texts: list[bytes], vocabulary: Subwords) -> tuple[np.ndarray, np.ndarray]:
    """Subwords of all texts, each closed by its end (``vocabulary.size``), and the place after each text."""
    end = np.array([vocabulary.size], "<i4").tobytes()
    parts = [b"".join(map(vocabulary.of, words_of(text))) + end for text in texts]
    return np.frombuffer(b"".join(parts), "<i4"), np.cumsum([len(part) // 4 for part in parts])


def prepared(counts: np.ndarray, near: np.ndarray | None, ends: int, seed: int = 7) -> Network:
    """An untrained network with the corpus's frequent subwords, and with its classes if the neighbours are given."""
    network = Network(counts, seed)
    if near is not None:
        network.group(near, counts, ends)
    return network


class Learner:
    """Adam on a network's random windows."""

    def __init__(self, network: Network, seed: int = 7):
        self.network, self.rng, self.steps = network, np.random.default_rng(seed), 0
        self.moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}

    def windows(self, raw: np.ndarray, ends: np.ndarray) -> None:
        """The windows to learn from, from now on."""
        network = self.network
        self.inputs, self.target, lead = laid_out(network, np.append(network.place, network.end)[raw], ends)
        self.own = np.flatnonzero(~lead)
        self.classes = network.class_of[np.append(raw, 0)]

    def learn(self, pick: np.ndarray, rate: float) -> None:
        place = self.target[pick]
        _, grad = self.network.step(self.inputs[pick], self.inputs[pick - 1], self.classes[place], place >= 0)
        self.steps += 1
        for name, g in grad.items():
            m, s = self.moment[name]
            m += np.float32(0.1) * (g - m)
            s += np.float32(0.01) * (g * g - s)
            self.network.p[name] -= np.float32(rate) * (m / np.float32(1 - 0.9**self.steps)) / (np.sqrt(s / np.float32(1 - 0.99**self.steps)) + np.float32(1e-7))


def train(texts: list[bytes], path: str, pattern: str, seed: int = 7, network: Network | None = None) -> Network:
    """A network fitted to texts by random windows; its statistics come from the texts unless a prepared network is given."""
    vocabulary = subwords(path, pattern)
    raw, ends = raw_ids(texts, vocabulary)
    if network is None:
        counts = np.bincount(raw[raw < vocabulary.size], minlength=vocabulary.size).astype(np.float64)
        network = Network(counts, seed)
        if len(raw) > 1:
            near = Neighbours(network, seed)
            near.add(np.append(network.place, network.end)[np.append(vocabulary.size, raw)])
            network.group(near.settle(), counts, len(texts))
    if len(raw) > 1:
        learner = Learner(network, seed)
        learner.windows(raw, ends)
        for i in range(STEPS):
            learner.learn(learner.rng.choice(learner.own, BATCH), 0.02 * (1 - i / STEPS) + 0.0005)
    network.tables()
    return network


def flat_weights(network: Network) -> np.ndarray:
    return np.concatenate([network.p[k].reshape(-1) for k in sorted(network.p)]).astype(np.float64)


def with_weights(network: Network, flat: np.ndarray) -> Network:
    at = 0
    for k in sorted(network.p):
        size = network.p[k].size
        network.p[k] = flat[at : at + size].reshape(network.p[k].shape).astype(np.float32)
        at += size
    network.tables()
    return network


def _chunks(flat: np.ndarray, weight: int) -> pa.RecordBatch:
    """A vector of whole numbers in pieces."""
    pieces = [flat[i : i + CHUNK].astype("<i8").tobytes() for i in range(0, len(flat), CHUNK)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([weight] * len(pieces), pa.int64()), pa.array(pieces, pa.binary())], ["chunk", "weight", "numbers"])


def _summed(vectors: DataFrame) -> tuple[np.ndarray, int] | None:
    """The sum of all tasks' vectors and of their weights; pieces are added up where they meet, one at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for chunk, weight, numbers in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held = sums.setdefault(chunk, [0, 0])
                held[0] += weight
                held[1] = held[1] + np.frombuffer(numbers, "<i8")
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s[0] for s in sums.values()], pa.int64()), pa.array([s[1].astype("<i8").tobytes() for s in sums.values()], pa.binary())], ["chunk", "weight", "numbers"])

    rows = sorted(vectors.repartition("chunk").mapInArrow(add, vectors.schema).collect(), key=lambda r: r["chunk"])
    return (np.concatenate([np.frombuffer(r["numbers"], "<i8") for r in rows]), rows[0]["weight"]) if rows else None


VECTOR = "chunk int, weight long, numbers binary"


def learnt(docs: DataFrame, network: Network, distinct: int, path: str, pattern: str) -> Network:
    """The network fitted to training rows (text): a start by one task, then the average of all learners' weights, each distinct text learnt from by one."""
    spark = docs.sparkSession
    small = pickle.dumps(network)
    at = F.xxhash64("text")
    edge = int(-(2**63) + 2 * SAMPLE_ROWS / distinct * (2**64 - 1)) if distinct > 2 * SAMPLE_ROWS else 2**63 - 1
    sample = docs.where(at <= edge).select(at.alias("at"), F.substring("text", 1, SAMPLE_TEXT).alias("text")).dropDuplicates(["at"]).orderBy("at").limit(SAMPLE_ROWS)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = [bytes(text) for pdf in batches for text in pdf["text"]]
        # A text that was cut may end within a letter or a word.
        texts = [text if len(text) < SAMPLE_TEXT else (text.rsplit(None, 1) or [b""])[0].decode("utf-8", "ignore").encode() for text in texts]
        yield pd.DataFrame({"network": [pickle.dumps(train(texts, path, pattern, network=pickle.loads(small)))]})

    start = spark.sparkContext.broadcast(bytes(sample.coalesce(1).mapInPandas(fit, "network binary").first()["network"]))

    def go_through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, mark = subwords(path, pattern), None
        one: _Learning | None = None
        for batch in batches:
            for of, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if one is None or of != mark:
                    if one is not None:
                        yield one.result()
                    mark, one = of, _Learning(pickle.loads(start.value), vocabulary)
                one.add(text.as_py())
        if one is not None:
            yield one.result()

    # Learners are as many as the corpus asks for, and each one's texts and their order follow from the texts: tasks and partitions change nothing.
    learners = max(1, -(-distinct // LEARNER_TEXTS))
    dealt = docs.select(at.alias("at"), "text").dropDuplicates(["at"]).withColumn("learner", F.pmod(F.shiftright("at", 16), F.lit(learners))).repartition(learners, "learner").sortWithinPartitions("learner", "at").select("learner", "text")
    found = _summed(dealt.mapInArrow(go_through, VECTOR))
    network = pickle.loads(start.value)
    if not found:
        return network
    high, low = found[0].reshape(2, -1).astype(np.float64)
    return with_weights(network, (high * 2.0**32 + low) / found[1] / FIXED_POINT)


class _Learning:
    """One learner's pass over its texts, in pieces of its own: they do not depend on how rows come in batches."""

    def __init__(self, network: Network, vocabulary: Subwords):
        self.learner, self.vocabulary, self.windows = Learner(network), vocabulary, 0
        self.texts: list[bytes] = []
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, text: bytes) -> None:
        self.texts.append(text)
        if len(self.texts) == TEXTS_AT_ONCE:
            self._read()

    def _read(self) -> None:
        if self.texts:
            self.held.append(raw_ids(self.texts, self.vocabulary))
            self.size += len(self.held[-1][0])
            self.texts = []
        if self.size > LEARN_IDS:
            self._learn()

    def _learn(self) -> None:
        before = np.cumsum([0, *(len(raw) for raw, _ in self.held)])
        self.learner.windows(np.concatenate([raw for raw, _ in self.held]), np.concatenate([ends + b for (_, ends), b in zip(self.held, before, strict=False)]))
        order = self.learner.rng.permutation(self.learner.own)
        for i in range(0, len(order), BATCH):
            self.learner.learn(order[i : i + BATCH], LEARN_RATE)
        self.windows += len(order)
        self.held, self.size = [], 0

    def result(self) -> pa.RecordBatch:
        """The weights times the windows learnt from, as whole numbers in two halves: sums of the halves stay in 64 bits at any number of learners."""
        self._read()
        if self.size:
            self._learn()
        whole = np.rint(flat_weights(self.learner.network) * FIXED_POINT).astype(np.int64) * self.windows
        return _chunks(np.concatenate([whole >> 32, whole & (2**32 - 1)]), self.windows)


def subword_scores(network: Network, raw: np.ndarray, ends: np.ndarray, size: int, at_once: int = 256) -> np.ndarray:
    """Natural log probability of each subword (``size`` is the end's id) in its text."""
    ids = np.append(network.place, network.end)[raw]
    inputs, target, _ = laid_out(network, ids, ends)
    classes = network.class_of[np.append(raw, 0)]
    out = np.zeros(len(raw) + 1, np.float64)
    for i in range(1, len(inputs), at_once):
        place = target[i : i + at_once]
        out[place.reshape(-1)] = network.class_scores(inputs[i - 1 : i + at_once], classes[place]).reshape(-1)
    return out[:-1] + network.share[raw]


def _judge(docs: pa.Table, words: pa.Table, network: Network, vocabulary: Subwords, total: int, distinct: int, mix: float = MIX) -> pa.Table:
    """Scores of one part's texts, from its words' corpus counts, all tokens' and the number of distinct words."""
    listed = words["word"].to_pylist()
    c = words["c"].to_numpy().astype(np.float64)
    index = {w: i for i, w in enumerate(listed)}
    parts = [vocabulary.of(w) if w else np.array([vocabulary.size], "<i4").tobytes() for w in listed]
    lengths = np.array([len(p) for p in parts], np.int64) // 4
    flat = np.frombuffer(b"".join(parts), "<i4")
    begins = np.cumsum(lengths) - lengths
    end = index[END]
    base = np.log10((c + 1) / (total + distinct + 1))
    rows = []
    batch: list[np.ndarray] = []

    def flush() -> None:
        tokens = np.concatenate(batch)
        n = lengths[tokens]
        place = np.repeat(begins[tokens] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        per_text = np.array([len(b) for b in batch])
        ends = np.cumsum(n)[np.cumsum(per_text) - 1]
        by_subword = subword_scores(network, flat[place], ends, vocabulary.size)
        spelled = np.add.reduceat(by_subword, np.cumsum(n) - n)
        plain = base[tokens]
        mixed = np.logaddexp(np.log(mix) + plain * np.log(10), np.log(1 - mix) + spelled) / np.log(10) if total else plain
        at = np.cumsum(per_text) - per_text
        rows.append(np.column_stack([per_text, np.add.reduceat((c[tokens] > 0).astype(np.float64), at), np.add.reduceat(plain, at), np.add.reduceat(mixed, at)]))
        batch.clear()

    held = 0
    get = index.__getitem__
    texts = docs["text"].to_pylist()
    order = sorted(range(len(texts)), key=texts.__getitem__)  # texts are put together alike however the rows came, so that sums round alike
    for i in order:
        found = words_of(texts[i])
        batch.append(np.fromiter((*map(get, found), end), np.int64, len(found) + 1))
        held += len(found) + 1
        if held > 400_000:
            flush()
            held = 0
    if batch:
        flush()
    table = np.concatenate(rows)[np.argsort(order)]
    numbers = [pa.array(table[:, i].astype(np.int64)) for i in (0, 1)]
    return pa.Table.from_arrays([docs["doc_id"], docs["held_out"], *numbers, pa.array([total] * len(table), pa.int64()), pa.array(table[:, 2]), pa.array(table[:, 3])], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def scored(docs: DataFrame, path: str, pattern: str, modulus: int = 7, kept: int = 2, mix: float = MIX) -> DataFrame:
    """Per row of (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score, score; see the module's text."""
    docs = small_batches(docs).select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    docs = docs.withColumn("held_out", F.coalesce(remainder("doc_id", modulus) == kept, F.lit(False)))

    tasks = 4 * docs.sparkSession.sparkContext.defaultParallelism  # as many vectors are added up, whatever the input
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    dealt = docs.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")).repartition(max(parts, 1), "part")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[Counter, set]] = {}  # of a part: words with their counts in training rows, and all words of the others
        for batch in batches:
            for mark, text, out in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if mark not in held:
                    held[mark] = Counter(), set()
                held[mark][out].update(words_of(text.as_py()))
                held[mark][out].update((END,))
        for mark, (counts, others) in held.items():
            for word in others.difference(counts):
                counts[word] = 0
            yield pa.RecordBatch.from_arrays([pa.array([mark] * len(counts), pa.int32()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["part", "word", "n"])

    words = dealt.select("part", "text", "held_out").mapInArrow(count, "part int, word binary, n long")
    # Totals are summed in the tasks first and joined: a word of all texts is a row a part, and none of them is gathered in a window.
    counted = new_folder(docs.sparkSession, "lm-counts")
    words.write.parquet(counted)
    words = docs.sparkSession.read.schema(words.schema).parquet(counted)
    words = words.join(words.groupBy("word").agg(F.sum("n").alias("c"), F.min("part").alias("least")), "word")
    words = written(words.select("part", "word", "c", ((F.col("least") == F.col("part")) & (F.col("c") > 0)).alias("new")), "lm-words")
    removed(docs.sparkSession, counted)

    def subword_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = subwords(path, pattern)
        found, distinct, tokens, rows = np.zeros(vocabulary.size, np.int64), 0, 0, 0
        for batch in batches:
            listed, times = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            distinct, tokens = distinct + len(listed), tokens + int(times.sum())
            rows += sum(c for word, c in zip(listed, times.tolist(), strict=True) if word == END)
            parts = [vocabulary.of(word) if word else b"" for word in listed]
            np.add.at(found, np.frombuffer(b"".join(parts), "<i4"), np.repeat(times, [len(part) // 4 for part in parts]))
        ids = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, -3, *ids.tolist()], pa.int32()), pa.array([distinct, tokens, rows, *found[ids].tolist()], pa.int64())], ["id", "n"])

    once = words.where("new").select("word", "c").coalesce(tasks)
    of = {r["id"]: r["n"] for r in once.mapInArrow(subword_counts, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    distinct, total, rows = of.get(-1, 0), of.get(-2, 0), of.get(-3, 0)
    counts = np.zeros(subwords(path, pattern).size, np.float64)
    for i, n in of.items():
        if i >= 0:
            counts[i] = n

    learning = docs.where(~F.col("held_out")).select("text")
    if rows:
        blank = pickle.dumps(prepared(counts, None, rows))

        def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, of = subwords(path, pattern), pickle.loads(blank)
            near, place = Neighbours(of), np.append(of.place, of.end)
            for batch in batches:
                raw, _ = raw_ids(batch.column(0).to_pylist(), vocabulary)
                near.add(place[np.append(vocabulary.size, raw)])
            yield _chunks(near.settle().reshape(-1), 1)

        near, _ = _summed(learning.coalesce(tasks).mapInArrow(neighbours, VECTOR))
        texts = learning.agg(F.approx_count_distinct(F.xxhash64("text"))).first()[0]
        fitted = learnt(learning, prepared(counts, near.reshape(-1, 2 * SIGNS), rows), texts, path, pattern)
    else:
        fitted = train([], path, pattern)
    network = docs.sparkSession.sparkContext.broadcast(pickle.dumps(fitted))

    def judge(docs: pa.Table, words: pa.Table) -> pa.Table:
        return _judge(docs, words, _network(network.value), subwords(path, pattern), total, distinct, mix)

    kind = dict(docs.dtypes)["doc_id"]
    return dealt.groupBy("part").cogroup(words.select("part", "word", "c").groupBy("part")).applyInArrow(judge, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


_NETWORK: dict[int, Network] = {}


def _network(data: bytes) -> Network:
    """The network of these bytes; a Python worker keeps the last one."""
    key = hash(data)
    if key not in _NETWORK:
        _NETWORK.clear()
        _NETWORK[key] = pickle.loads(data)
    return _NETWORK[key]
