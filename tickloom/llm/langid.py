"""Language identification by word-first backoff.

A known word votes with its smoothed log frequency in each language. A word that no language has seen votes with its
character n-grams: those of the longest length at which any n-gram is known, progressively shorter ones otherwise.

Learning uses text and label of the learning rows only. The classifier is fitted on a bounded sample: at most
``ROWS_PER_LANGUAGE`` distinct texts of each language, those with the smallest hash; all words and n-grams of these texts are kept.
The sample holds the ``MOST_LANGUAGES`` labels that most learning rows have (ties to the first in order), so a noisy label column
costs nothing but its rare labels, and the broadcast model is bounded by the sample.

Defined results: a null text, or one without any letter (Unicode category L), is ``und`` with score 0; without any learnt
language every text is ``und``; ties between languages go to the first name in order; repeated rows each give a row; very long
texts are read whole; an empty table gives no rows. Added columns take the place of the table's own of these names;
callers that must keep those choose other names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import mapped, only, remainder, small_batches, worker_keeps

ROWS_PER_LANGUAGE = 500
MOST_LANGUAGES = 1_000
LONGEST_GRAM = 4
UNKNOWN = "und"
#: Words held by a task's cache of votes.
CACHE_WORDS = 150_000

LETTERS = regex.compile(r"\p{L}+")


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with its ends marked."""
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _counted(pdf: pd.DataFrame) -> pd.DataFrame:
    """The words and n-grams of one language's texts with their counts: a row for each length; one table is held at a time."""
    words: Counter = Counter()
    for text in pdf["text"]:
        words.update(LETTERS.findall(text.lower()))
    parts = []
    for n in range(LONGEST_GRAM + 1):
        counts = words if n == 0 else Counter()
        for word, c in words.items() if n else ():
            for g in grams(word, n):
                counts[g] += c
        parts.append({"lang": pdf["lang"].iloc[0], "n": n, "grams": list(counts), "counts": list(counts.values())})
    return pd.DataFrame(parts)


class Model:
    """Log frequencies by language: one table for words (n = 0) and one for each n-gram length."""

    def __init__(self, rows: list[tuple[str, int, list[str], list[int]]]):
        self.languages = sorted({r[0] for r in rows})
        column = {lang: i for i, lang in enumerate(self.languages)}
        self.index: list[dict[str, int]] = [{} for _ in range(LONGEST_GRAM + 1)]
        self.votes: list[np.ndarray] = []
        for n, index in enumerate(self.index):
            mine = sorted(r for r in rows if r[1] == n)
            places = [np.fromiter((index.setdefault(g, len(index)) for g in listed), np.int64, len(listed)) for _, _, listed, _ in mine]
            held = np.full((len(index), len(self.languages)), 0.1, np.float32)
            for (lang, _, _, counts), at in zip(mine, places, strict=True):
                held[at, column[lang]] = np.array(counts, np.float64) + 0.1
                held[:, column[lang]] /= max(sum(counts), 1)
            self.votes.append(np.log(held))

    def votes_of(self, words: Collection[str]) -> np.ndarray:
        """Log frequencies of words, a row each: a word's own, else the mean of its longest known n-grams, else zeros."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        found: list[tuple[list[int], list[int], list[int]]] = [([], [], []) for _ in self.index]  # by length: words, their numbers of entries, entries
        for place, word in enumerate(words):
            for n in (0, *range(LONGEST_GRAM, 0, -1)):
                known = [i for i in map(self.index[n].get, grams(word, n) if n else (word,)) if i is not None]
                if known:
                    found[n][0].append(place)
                    found[n][1].append(len(known))
                    found[n][2].extend(known)
                    break
        for votes, (places, sizes, entries) in zip(self.votes, found, strict=True):
            if places:
                out[places] = np.add.reduceat(votes[entries], np.cumsum([0, *sizes[:-1]]), axis=0) / np.array(sizes, np.float32)[:, None]
        return out


class Scorer:
    """Votes of whole texts, with a bounded cache of words."""

    def __init__(self, model: Model):
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.at: dict[str, int] = {}
        self.held = np.zeros((1024, len(self.model.languages)), np.float32)

    def _learn(self, words: Collection[str]) -> None:
        first = len(self.at)
        self.at.update(zip(words, range(first, first + len(words)), strict=True))
        if len(self.at) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros((max(len(self.held), len(words)), self.held.shape[1]), np.float32)])
        self.held[first : len(self.at)] = self.model.votes_of(words)

    def score(self, text: str | None) -> tuple[str, float]:
        words = LETTERS.findall(text.lower()) if text else []
        if not words or not self.model.languages:
            return UNKNOWN, 0.0
        if len(self.at) > CACHE_WORDS:
            self._reset()
        get = self.at.get
        rows = list(map(get, words))
        if None in rows:  # new words are looked up together
            self._learn(dict.fromkeys(word for word, row in zip(words, rows, strict=True) if row is None))
            rows = list(map(get, words))
        total = self.held[rows].sum(axis=0, dtype=np.float64)
        best = int(total.argmax())
        return self.model.languages[best], float(1.0 / np.exp(total - total[best]).sum())


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> Model:
    """A model from labelled rows (text, lang); unlabelled and textless rows are not used."""
    labelled = only(docs, "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull()).withColumn("at", F.xxhash64("text"))
    # Texts whose hash can't be among the first of their language go before the ranking; twice the expected share of distinct ones stays.
    share = F.least(F.lit(1.0), F.lit(2.0 * rows_per_language) / F.col("texts"))
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct("at").alias("texts"), F.count(F.lit(1)).alias("rows"))
    edge = F.when(F.col("texts") > 2 * rows_per_language, (share * 2.0**64 - 2.0**63).cast("long")).otherwise(F.lit(2**63 - 1))
    learnt = sizes.orderBy(F.desc("rows"), "lang").limit(most_languages).select("lang", edge.alias("edge"))
    found = learnt.collect()
    if not found:
        return Model([])
    edges = docs.sparkSession.createDataFrame(found, learnt.schema)
    first = labelled.join(F.broadcast(edges), "lang").where(F.col("at") <= F.col("edge")).dropDuplicates(["lang", "at"])
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("at"))).where(F.col("rank") <= rows_per_language)
    counted = first.select("lang", "text").groupBy("lang").applyInPandas(_counted, "lang string, n int, grams array<string>, counts array<long>")
    return Model([tuple(r) for r in counted.toLocalIterator()])


def identify(docs: DataFrame, model: Model, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the predicted language and its score to documents; reads ``text`` only, all other columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps("langid")
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.score(t) for t in batch.column(at).to_pylist()]
            columns = [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    kept = small_batches(docs.drop(pred, score))
    at = kept.columns.index("text")
    return mapped(kept, predict, **{pred: "string", score: "double"})


def held_out(modulus: int = 4, kept: int = 2):
    """Whether a document is held out: crc32 of its id as text leaves this remainder (a null id is not held out)."""
    return F.coalesce(remainder("doc_id", modulus) == kept, F.lit(False))


def op4_query(docs: DataFrame) -> DataFrame:
    """The contract's rows: every document judged by a model of the rows that are not held out."""
    marked = only(docs, "doc_id", "text", "lang").withColumn("held_out", held_out())
    model = fit(marked.where(~F.col("held_out")))
    return identify(marked.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score")
