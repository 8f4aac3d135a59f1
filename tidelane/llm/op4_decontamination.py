"""Benchmark decontamination with a generalised suffix automaton.

The normalised items are put into one automaton over word ids. A document's words stream through it; the
automaton keeps the longest suffix read so far that occurs in any item, so every place where WINDOW words in
a row (or a whole shorter item) come from an item is found in one pass, whatever the items' number. Runs that hold a
word of no item, or two words that follow each other in no item, are skipped before the automaton is entered.

A benchmark of any size is answered exactly: the items stream to the driver, and for every MAX_ITEM_WORDS words of them one automaton is
built, turned into flat sorted arrays (about 40 bytes a word) and broadcast. A longer item is cut into pieces that
overlap by a window less one word, so that no window is lost. A worker keeps up to MAX_HELD automata; of more, each batch
of documents meets one after another, so that memory is bounded and only time grows with the benchmark. Documents are never shuffled.

Defined cases: a null or wordless text has no words and no hits; a null or wordless item has no window; items
with the same id count once, a null item id as the text ``null``; a window that several items share counts for
each; repeated documents are each judged; texts of any length are read whole; an empty benchmark hits nothing; an empty table gives no rows; only
the id and text columns are read by ``scan``, and ``decontaminate`` returns the documents' own columns, whatever their names. A text
that was cut is looked through again, until no window is left, as words on both sides of a cut may make one.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm.common import plain_names, small_batches

WINDOW = 8
#: Words of items in one automaton.
MAX_ITEM_WORDS = 500_000
#: Automata that a worker holds at once.
MAX_HELD = 4
#: Words that a worker remembers the ids of.
MAX_SEEN = 300_000
#: A document with hits from so many items counts as contaminated as a whole.
LEAST_ITEMS = 2
#: Spans of so many words are cut out of documents that stay.
SPAN_LIMIT = 8
#: A document of which a larger share is hit does not stay.
COVERAGE_LIMIT = 0.5

#: A-Z lower-cased, 0-9, a-z and every byte of a non-ASCII letter kept, all else a space: words as the contract has them.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


class Automaton:
    """Generalised suffix automaton of word-id sequences, with the items of every window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ids = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(self.ids)}
        ends: list[tuple[int, int]] = []  # state after each full window, item
        shorts: list[tuple[list[int], int]] = []
        sequences = []
        for item, words in items:
            if words:
                sequences.append((number[item], [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]))
        for _, ids in sequences:
            last = 0
            for w in ids:
                last = self._extend(last, w)
        self.shortest = min([window, *(len(ids) for _, ids in sequences)])
        for item, ids in sequences:
            if len(ids) < window:
                shorts.append((ids, item))
                continue
            state, n = 0, 0
            for w in ids:
                state, n = self.step(state, n, w)
                if n >= window:
                    ends.append((self._window_state(state), item))
        # one state for each class of windows that end at the same places of the items
        self.at_window: dict[int, frozenset[int]] = {}
        found: dict[int, set[int]] = {}
        for state, item in ends:
            found.setdefault(state, set()).add(item)
        self.at_window = {s: frozenset(x) for s, x in found.items()}
        self.at_short: dict[int, list[tuple[int, int]]] = {}
        for ids, item in shorts:
            state = 0
            for w in ids:
                state = self.next[state][w]
            self.at_short.setdefault(state, []).append((len(ids), item))

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = self._state({}, length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link = self.next, self.link
        copy = self._state(dict(nxt[q]), self.length[p] + 1)
        link[copy], link[q] = link[q], copy
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def _state(self, edges: dict[int, int], length: int) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def step(self, state: int, n: int, w: int) -> tuple[int, int]:
        """The state and length of the longest suffix, read on by one word, that occurs in an item."""
        nxt = self.next
        while state and w not in nxt[state]:
            state = self.link[state]
            n = self.length[state]
        if w in nxt[state]:
            return nxt[state][w], n + 1
        return 0, 0

    def _window_state(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state


def _listed(found: dict[int, list]) -> tuple[array, array, list]:
    """States in order, where each one's entries begin, and the entries."""
    states = sorted(found)
    entries = [x for s in states for x in found[s]]
    starts = np.cumsum([0, *(len(found[s]) for s in states)])
    return array("q", states), array("q", starts.tolist()), entries


class Flat:
    """An automaton as sorted arrays: what is broadcast, and scans."""

    def __init__(self, built: Automaton):
        self.window, self.shortest, self.ids = built.window, built.shortest, built.ids
        words = sorted((xxhash.xxh3_64_intdigest(w), w, k) for w, k in built.vocabulary.items())
        self.hashes, self.numbers = np.array([h for h, _, _ in words], np.uint64), np.array([k for _, _, k in words], np.int64)
        self.blob, self.cuts = b"".join(w for _, w, _ in words), np.cumsum([0, *(len(w) for _, w, _ in words)])
        edges = sorted((s << 32 | w, t) for s, out in enumerate(built.next) for w, t in out.items())
        self.keys, self.targets = array("Q", [k for k, _ in edges]), array("q", [t for _, t in edges])
        self.link, self.length = array("q", built.link), array("q", built.length)
        self.at_window = _listed({s: sorted(x) for s, x in built.at_window.items()})
        self.at_short = _listed(built.at_short)
        # What can follow a word: the ends of paths of length two, from states that are single words.
        pairs = {first << 32 | second for first, state in built.next[0].items() for second in built.next[state]}
        self.pairs = np.array(sorted(pairs), np.uint64)
        self.seen: dict[bytes, int] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "seen": {}}

    def _known(self, words: list[bytes]) -> Iterator[tuple[bytes, int]]:
        """The words of the vocabulary with their ids; bytes are compared, so that equal hashes do no harm."""
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        at = np.searchsorted(self.hashes, h)
        for k in np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] == h).tolist():
            place = int(at[k])
            while place < len(self.hashes) and self.hashes[place] == h[k]:
                if self.blob[self.cuts[place] : self.cuts[place + 1]] == words[k]:
                    yield words[k], int(self.numbers[place])
                place += 1

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """The words' ids, 0 for those of no item: by a dictionary of the vocabulary if it is small, else of the words seen last."""
        if len(self.hashes) <= MAX_SEEN // 4:
            if not self.seen:
                self.seen = {self.blob[a:z]: int(k) for a, z, k in zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), self.numbers, strict=True)}
            return np.fromiter(map(self.seen.get, words, repeat(0)), np.int64, len(words))
        out = np.fromiter(map(self.seen.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(out < 0).tolist()
        if missing:
            new = list({words[k] for k in missing})
            if len(self.seen) + len(new) > MAX_SEEN:
                self.seen.clear()
            own = dict.fromkeys(new, 0) | dict(self._known(new))
            self.seen.update((w, k) for w, k in own.items() if len(w) <= 64)
            for k in missing:
                out[k] = own[words[k]]
        return out

    def _edge(self, state: int, word: int) -> int:
        key = state << 32 | word
        at = bisect_left(self.keys, key)
        return self.targets[at] if at < len(self.keys) and self.keys[at] == key else -1

    def step(self, state: int, n: int, word: int) -> tuple[int, int]:
        """The state and length of the longest suffix, read on by one word, that occurs in an item."""
        to = self._edge(state, word)
        while to < 0 and state:
            state = self.link[state]
            n = self.length[state]
            to = self._edge(state, word)
        return (to, n + 1) if to >= 0 else (0, 0)

    @staticmethod
    def _entries(listed: tuple[array, array, list], state: int) -> list:
        states, starts, entries = listed
        at = bisect_left(states, state)
        return entries[starts[at] : starts[at + 1]] if at < len(states) and states[at] == state else []

    def _runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """[start, stop) of the words that can hold an occurrence."""
        fits = np.zeros(len(ids) + 1, bool)  # between a word and the one before it
        if len(ids) > 1 and len(self.pairs):
            pair = ids[:-1].astype(np.uint64) << np.uint64(32) | ids[1:].astype(np.uint64)
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            fits[1 : len(ids)] = (self.pairs[at] == pair) & (ids[:-1] != 0) & (ids[1:] != 0)
        starts = np.flatnonzero((ids != 0) & ~fits[:-1])
        stops = np.flatnonzero((ids != 0) & ~fits[1:]) + 1
        long = stops - starts >= self.shortest
        return list(zip(starts[long].tolist(), stops[long].tolist(), strict=True))

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """[start, stop) of every occurrence, and the ids of the items."""
        hit: list[tuple[int, int]] = []
        items: set[int] = set()
        if not len(self.hashes) or len(words) < self.shortest:
            return hit, set()
        ids = self._numbers(words)
        for start, stop in self._runs(ids):
            state, n = 0, 0
            for at, w in enumerate(ids[start:stop].tolist(), start):
                state, n = self.step(state, n, w)
                if n >= self.window:
                    hit.append((at + 1 - self.window, at + 1))
                    s = state
                    while self.length[self.link[s]] >= self.window:
                        s = self.link[s]
                    items.update(self._entries(self.at_window, s))
                s = state if self.at_short[2] else 0
                while s > 0:
                    for k, item in self._entries(self.at_short, s):
                        if k <= n:
                            hit.append((at + 1 - k, at + 1))
                            items.add(item)
                    s = self.link[s]
        return hit, {self.ids[k] for k in items}


def merged(hit: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(hit):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


class Index:
    """The broadcast automata of a benchmark, as a worker uses them."""

    def __init__(self, sent: list, max_held: int = MAX_HELD):
        self.sent, self.held = sent, [b.value for b in sent] if len(sent) <= max_held else None

    def spans(self, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """Per text the merged [start, stop) word spans inside occurrences, and the ids of their items."""
        found: list[tuple[list, set]] = [([], set()) for _ in texts]
        for automaton in self.held if self.held is not None else (b.load_from_path(b._path) for b in self.sent):
            for (hit, items), words in zip(found, texts, strict=True):
                more, of = automaton.hits(words)
                hit += more
                items |= of
        return [(merged(hit), items) for hit, items in found]


def pieces(items: Iterable[tuple[str, list[bytes]]], window: int, most: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in lots of about ``most`` words; longer items in pieces that overlap by a window less one word."""
    lot: list[tuple[str, list[bytes]]] = []
    n = 0
    for item, words in items:
        step = max(1, most - window + 1)
        for at in range(0, max(1, len(words) - window + 1), step):
            piece = words[at : at + step + window - 1]
            if lot and n + len(piece) > most:
                yield lot
                lot, n = [], 0
            lot.append((item, piece))
            n += len(piece)
    if lot:
        yield lot


def build(benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_ITEM_WORDS) -> list:
    """Broadcast automata of ``benchmark`` (item_id, text), one for every ``max_words`` words; items stream through the driver."""
    context = benchmark.sparkSession.sparkContext
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), "text").where(F.col("text").isNotNull())
    items = ((r["i"], words_of(r["text"])) for r in rows.toLocalIterator())
    return [context.broadcast(Flat(Automaton(lot, window))) for lot in pieces(((i, w) for i, w in items if w), window, max_words)]


SCAN_SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, item_ids array<string>, spans array<struct<start:int,stop:int>>"


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_ITEM_WORDS, max_held: int = MAX_HELD) -> DataFrame:
    """Per document: words, words inside window occurrences, the items they come from and the merged spans, as word positions."""
    small_batches(docs.sparkSession)
    sent = build(benchmark, window, max_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(sent, max_held)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            texts = [words_of(t) for t in batch.column(1).to_pylist()]
            for words, (spans, items) in zip(texts, index.spans(texts), strict=True):
                for column, x in zip(out, (len(words), sum(b - a for a, b in spans), len(items), sorted(items), [{"start": a, "stop": b} for a, b in spans]), strict=True):
                    column.append(x)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=["doc_id", "n_words", "n_hit", "n_items", "item_ids", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCAN_SCHEMA)


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given word spans; what stands between two cut words goes with them, the rest stays as it is."""
    raw = text.encode()
    places = [m.span() for m in _WORD.finditer(raw)]
    kept, at = [], 0
    for start, stop in spans:
        kept.append(raw[at : places[start][0]])
        at = places[stop - 1][1]
    return b"".join([*kept, raw[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, span_limit: int = SPAN_LIMIT, coverage_limit: float = COVERAGE_LIMIT, least_items: int = LEAST_ITEMS) -> DataFrame:
    """The documents' columns: those contaminated as a whole (hits of ``least_items`` items, or a share of words over
    ``coverage_limit``) go; from the others, spans of ``span_limit`` words or more are cut out, and those shorter than a window, which are whole short items."""
    small_batches(docs.sparkSession)
    sent = build(benchmark, window)
    at = docs.columns.index("text")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(sent)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            split = [words_of(t) for t in texts]
            found = index.spans(split)
            keep = [len(items) < least_items and sum(b - a for a, b in spans) <= coverage_limit * len(words) for (spans, items), words in zip(found, split, strict=True)]
            todo = [(k, spans) for k, (spans, _) in enumerate(found) if keep[k] and spans]
            while todo:
                cut = [(k, some) for k, spans in todo if (some := [x for x in spans if x[1] - x[0] >= span_limit or x[1] - x[0] < window])]
                for k, spans in cut:
                    texts[k] = without_spans(texts[k], spans)
                todo = [(k, spans) for (k, _), (spans, _) in zip(cut, index.spans([words_of(texts[k]) for k, _ in cut]), strict=True) if spans]
            columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep, pa.bool_()))

    return plain_names(docs).mapInArrow(run, docs.schema)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_items") >= LEAST_ITEMS).alias("contaminated"))


QUERIES = {"op4_decontamination": op4_decontamination}
ORACLE_SQL = {
    "op4_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + least(8, len(w)) - 1) AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT len(g) AS k FROM windows),
grams AS (
  SELECT doc_id, i, k, list_slice(w, i, i + k - 1) AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, lengths WHERE len(w) >= k)
), hits AS (
  SELECT g.doc_id, g.i, g.k, w.item_id FROM grams g JOIN windows w ON g.g = w.g
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
}
