"""Benchmark decontamination with a generalised suffix automaton over normalised test items.

Words: A-Z lower-cased, then runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``. A window is ``window`` consecutive words of
an item; an item with fewer words, but not none, is one window. A document word inside any occurrence of a window is hit.

The automaton recognises every substring of every item. A document's words are streamed through it; after each word the
state and its matching length give the longest run that ends here and occurs in an item. Words outside the items'
vocabulary reset the automaton, so the stream is cut into runs of known words first and short runs are never walked.

Size of what is broadcast: an automaton has at most two states per item word. Items are dealt into automata of at most
``max_words`` words each, whatever the sizes of the items: a longer one is cut into pieces that overlap by a window less a word, so that each of
its windows lies in a piece. Where there are several automata, each is built, broadcast, streamed over the documents and let go
before the next one is made; the passes' spans are written and united. So any number of items works with bounded memory.

Defined results: a null or empty text has no words, no hits and is not contaminated; a null item text is no window;
repeated item texts all count as items; a null item_id is an item whose id is the empty string; repeated document rows each give a row (rows are told apart by their text and
id, so equal rows have equal results); an empty benchmark leaves every document clean; very long texts are walked whole; an empty
table gives no rows; helper columns take names that the table does not have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import free_names, mapped, only, quoted, small_batches, worker_keeps, written

WINDOW = 13
MAX_WORDS = 250_000

#: Word bytes kept (A-Z lower-cased), all others blanked: digits, letters and every byte of a non-ASCII character.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """The normalised words of a UTF-8 text."""
    return text.translate(_FOLD).split() if text else []


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the items that own each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]) for item, words in items if words]
        for _, codes in coded:
            last = 0
            for code in codes:
                last = self._extend(last, code)
        #: state -> {window length: items}; a state can own the full window and shorter whole items
        self.owners: dict[int, dict[int, set[str]]] = {}
        for item, codes in coded:
            self._own(item, codes)
        self.shortest = min([window, *(len(codes) for _, codes in coded)])
        self.marks = self._marks()

    def _extend(self, last: int, code: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        known = nexts[last].get(code)
        if known is not None:
            return known if length[known] == length[last] + 1 else self._clone(last, code, known)
        state = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and code not in nexts[at]:
            nexts[at][code] = state
            at = link[at]
        if at >= 0:
            known = nexts[at][code]
            link[state] = known if length[known] == length[at] + 1 else self._clone(at, code, known)
        return state

    def _clone(self, at: int, code: int, known: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        clone = len(nexts)
        nexts.append(dict(nexts[known]))
        link.append(link[known])
        length.append(length[at] + 1)
        link[known] = clone
        while at >= 0 and nexts[at].get(code) == known:
            nexts[at][code] = clone
            at = link[at]
        return clone

    def _holder(self, state: int, n: int) -> int:
        """The state on the suffix chain that holds the suffix of n words."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _own(self, item: str, codes: list[int]) -> None:
        state, n = 0, min(self.window, len(codes))
        for i, code in enumerate(codes):
            state = self.next[state][code]
            if i + 1 >= n:
                self.owners.setdefault(self._holder(state, n), {}).setdefault(n, set()).add(item)

    def _marks(self) -> list[tuple[int, ...]]:
        """For each state, the owned (state, length) pairs on its suffix chain, longest first."""
        marks: list[tuple] = [()] * len(self.next)
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            own = tuple((state, n) for n in sorted(self.owners.get(state, ()), reverse=True))
            marks[state] = own + marks[self.link[state]]
        return marks

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit spans (disjoint, ascending, end exclusive), the items whose windows occur, and the longest match."""
        if len(words) < self.shortest:
            return [], set(), 0
        codes = np.fromiter(map(self.vocabulary.get, words, [0] * len(words)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (codes > 0).view(np.int8), [0]))))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        longest = 0
        for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - begin >= self.shortest:
                longest = max(longest, self._walk(codes[begin:end].tolist(), begin, spans, items))
        return spans, items, longest

    def _walk(self, codes: list[int], offset: int, spans: list[tuple[int, int]], items: set[str]) -> int:
        nexts, link, length, marks = self.next, self.link, self.length, self.marks
        state = matched = longest = 0
        seen: set[tuple[int, int]] = set()
        for i, code in enumerate(codes, offset + 1):
            follow = nexts[state].get(code)
            while follow is None and state:
                state = link[state]
                matched = length[state]
                follow = nexts[state].get(code)
            if follow is None:
                continue
            state, matched = follow, matched + 1
            longest = max(longest, matched)
            reach = 0
            for mark in marks[state]:
                if mark[1] <= matched:
                    reach = reach or mark[1]
                    if mark not in seen:
                        seen.add(mark)
                        items |= self.owners[mark[0]][mark[1]]
            if reach:
                begin = i - reach
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, i))
        return longest


def _item_groups(items: DataFrame, window: int, max_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items as word lists, in groups of at most ``max_words`` words, made as they are asked for; at least one group."""
    group: list[tuple[str, list[bytes]]] = []
    held, most = 0, max(max_words, 2 * window)
    for row in items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text")).toLocalIterator():
        words = words_of(bytes(row.text) if row.text is not None else None)
        for begin in range(0, max(len(words) - window + 1, 1), most - window + 1):
            piece = words[begin : begin + most]
            if group and held + len(piece) > most:
                yield group
                group, held = [], 0
            group.append((row.item, piece))
            held += len(piece)
    yield group


def match_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS, keep_text: bool = False) -> DataFrame:
    """Per document: words, disjoint hit word spans, item ids (sorted), the longest match (in a piece of an item); with ``text`` if asked for."""
    groups = _item_groups(items, window, max_words)
    first, second = next(groups), next(groups, None)
    if second is None:
        return _scanned(docs.select("doc_id", "text"), ItemAutomaton(first, window), keep_text)[0]
    return _united(docs, chain([first, second], groups), window, keep_text).drop("__row")


def _scanned(docs: DataFrame, automaton: ItemAutomaton, keep_text: bool = False):
    """The documents' spans by one automaton (doc_id, text and, where it has one, ``__row``), and the broadcast that they read."""
    kinds = dict(small_batches(docs).dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    through = [name for name in ("text", "__row") if name in kinds and (keep_text or name != "text")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps("decontaminate")
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = words_of(text)
                spans, found, longest = shared.value.scan(words)
                for column, value in zip(out, (len(words), [s[0] for s in spans], [s[1] for s in spans], sorted(found), longest), strict=True):
                    column.append(value)
            arrays = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], pa.list_(pa.string())), pa.array(out[4], pa.int32())]
            yield pa.RecordBatch.from_arrays([*arrays, *[batch.column(batch.schema.get_field_index(name)) for name in through]], ["doc_id", "n_words", "begins", "ends", "items", "longest", *through])

    schema = f"doc_id {kinds['doc_id']}, n_words long, begins array<int>, ends array<int>, items array<string>, longest int"
    held = docs.select("doc_id", "text", *[name for name in through if name != "text"])
    return held.mapInArrow(scan, ", ".join([schema, *[f"{name} {kinds[name]}" for name in through]])), shared


def _united(docs: DataFrame, groups: Iterator[list[tuple[str, list[bytes]]]], window: int, keep_text: bool = False) -> DataFrame:
    """The spans of several automata, one pass after another; rows are told apart by ``__row``, a hash of id and text."""
    source = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("__row"))
    united, passes = None, 0
    for group in groups:
        found, shared = _scanned(source, ItemAutomaton(group, window), keep_text and not passes)
        part = written(found, "spans")
        shared.destroy()
        united = part if united is None else united.unionByName(part, allowMissingColumns=True)
        passes += 1
    return _unite(united, passes, keep_text)


def _unite(parts: DataFrame, passes: int, keep_text: bool) -> DataFrame:
    """One row per document from the rows of several passes; equal documents are counted and given back as often."""
    grouped = parts.groupBy("doc_id", "__row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_set(F.arrays_zip("begins", "ends")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.max("longest").alias("longest"),
        (F.count(F.lit(1)) / passes).cast("int").alias("copies"),
        *([F.max("text").alias("text")] if keep_text else []),
    )
    merge = F.aggregate(
        "spans",
        F.expr("cast(array() as array<struct<begins:int,ends:int>>)"),
        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1).ends >= s.begins), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1).begins.alias("begins"), F.greatest(F.element_at(acc, -1).ends, s.ends).alias("ends"))))).otherwise(F.concat(acc, F.array(s))),
    )
    merged = grouped.withColumn("spans", F.when(F.size("spans") > 0, merge).otherwise(F.expr("cast(array() as array<struct<begins:int,ends:int>>)")))
    out = merged.withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select("doc_id", "n_words", F.col("spans.begins").alias("begins"), F.col("spans.ends").alias("ends"), "items", "longest", *(["text"] if keep_text else []), "__row")


def judged(spans: DataFrame, numerator: int = 1, denominator: int = 20) -> DataFrame:
    """Adds n_hit and contaminated: some word is hit, and the hit words are at least numerator/denominator of all."""
    hit = F.aggregate(F.zip_with("ends", "begins", lambda e, b: (e - b).cast("long")), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return spans.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * denominator >= F.col("n_words") * numerator))


def cut_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, longest_kept: int = WINDOW - 1) -> DataFrame:
    """Documents (doc_id, text) whose hit spans of more than ``longest_kept`` words are cut out of the text.

    A cut goes from the first to the last byte of the span's words; what lies around them stays.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            out = [_without(t, [(b, e) for b, e in zip(begins, ends, strict=True) if e - b > longest_kept]) for t, begins, ends in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    kind = dict(docs.dtypes)["doc_id"]
    return match_spans(docs, items, window, keep_text=True).select("doc_id", "text", "begins", "ends").mapInArrow(cut, f"doc_id {kind}, text string")


def _without(text: bytes | None, spans: list[tuple[int, int]]) -> bytes | None:
    if not text or not spans:
        return text
    folded = np.frombuffer(text.translate(_FOLD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], folded.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for begin, end in spans:
        out.append(text[at : starts[begin]])
        at = int(ends[end - 1])
    return b"".join([*out, text[at:]])


def keep_uncontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, numerator: int = 1, denominator: int = 20, max_words: int = MAX_WORDS) -> DataFrame:
    """Documents, all columns, without the contaminated ones. Texts are judged in place: no row is shuffled."""
    groups = _item_groups(items.select("item_id", "text"), window, max_words)
    first, second = next(groups), next(groups, None)
    docs = small_batches(docs)
    at = docs.columns.index("text")
    if second is not None:  # a document's hits of several automata must be united before they are judged
        bad = judged(_united(only(docs, "doc_id", "text"), chain([first, second], groups), window), numerator, denominator).where("contaminated")
        mark, key, known = free_names(docs, "mark", "hash", "id")
        bad = bad.select(F.col("doc_id").alias(known), F.col("__row").alias(key)).distinct()
        marked = docs.withColumn(mark, F.xxhash64("doc_id", "text"))
        return marked.join(bad, marked["doc_id"].eqNullSafe(bad[known]) & (marked[mark] == bad[key]), "left_anti").select(*quoted(docs))
    shared = docs.sparkSession.sparkContext.broadcast(ItemAutomaton(first, window))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps("decontaminate")
        for batch in batches:
            clean = []
            for text in batch.column(at).cast(pa.binary()):
                words = words_of(text.as_py())
                hit = sum(e - b for b, e in shared.value.scan(words)[0])
                clean.append(not hit or denominator * hit < numerator * len(words))
            yield batch.filter(pa.array(clean, pa.bool_()))

    return mapped(docs, keep)


def op1_query(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's digest of ``match_spans``."""
    spans = judged(match_spans(only(docs, "doc_id", "text"), only(items, "item_id", "text")))
    return spans.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def digest(ids: list[str]) -> str:
    """items_sha256 of these ids, for tests."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def op1_sql() -> str:
    """The same by joining every window of every document with every window of the items."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
with d as (select row_number() over () as r, doc_id, {words} as ws from documents),
b as (select coalesce(cast(item_id as varchar), '') as item, {words} as ws from benchmark),
v as (select distinct item, n, array_to_string(ws[i:i + n - 1], ' ') as g from (
  select item, ws, least({WINDOW}, len(ws)) as n, unnest(range(1, len(ws) - least({WINDOW}, len(ws)) + 2)) as i from b where len(ws) > 0)),
p as (select r, n, i, array_to_string(ws[i:i + n - 1], ' ') as g from (
  select r, ws, n, unnest(range(1, greatest(len(ws) - n + 2, 1))) as i from d cross join (select distinct n from v))),
m as (select r, p.n, i, item from p join v using (n, g)),
h as (select r, count(distinct spot) as n_hit from (select r, unnest(range(i, i + n)) as spot from m) group by r),
t as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from m) group by r)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated from d left join h using (r) left join t using (r)
"""
