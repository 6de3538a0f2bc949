"""Benchmark decontamination: guaranteed rare seeds, then Smith-Waterman alignment on words.

Words are lower-cased (A-Z) and stripped of punctuation at their ends. Seeds are single words and pairs of
neighbouring words of an item, the rarest by the corpus counts of its words first, as many as it takes: an
alignment that matches no seed must leave seed words out and break seed pairs, and the best score it can still
have (``spared_score``) lies below the score asked for. So every passage that qualifies holds a seed, whatever
the size of the corpus; the counts only decide how often seeds hit by chance. Passages around seed hits are
aligned with the item; the score is the alignment score over the score of a perfect copy.

Test items are handled in blocks of at most ``BLOCK_CHARS`` characters, each sent to all tasks; the corpus
streams past, is never shuffled, and only hits come back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import _ODD, WordHash, mix, stored

MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.6
BLOCK_CHARS = 32_000_000
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SIEVE = 22
#: Bytes of text whose words are looked up at once.
SLICE_BYTES = 500_000
_PLAIN = bytes(32 if c in b" \t\n\v\f\r" else c for c in bytes(range(256)).lower())
_IS_PUNCTUATION = np.isin(np.arange(256), list(_PUNCTUATION))
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

SCHEMA = "doc_id long, row_key long, item_id long, score double, doc_start long, doc_end long"


def bare(word: bytes) -> bytes:
    """A word without punctuation at its ends; a word of punctuation only stays as it is."""
    return word.strip(_PUNCTUATION) or word


class BareWordHash(WordHash):
    """Hash of a word without punctuation at its ends; a word of punctuation only stays as it is."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(bare(word))
        return h


def words_in(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Vocabulary:
    """Numbers of bare words, for many texts at once: 1, 2, ... for those of the test items, 0 for all others.

    A word of up to 16 bytes is told by its length, its first and its last 8 bytes. Longer ones that agree in these with a
    word of the items are compared as a whole.
    """

    def __init__(self, words: list[bytes]):
        self.size = len(words) + 1
        self.long = {w: k for k, w in enumerate(words, 1) if len(w) > 16}
        data = b"".join(words) + bytes(8)
        end = np.cumsum([len(w) for w in words], dtype=np.int64)
        start = end - np.array([len(w) for w in words], np.int64)
        first, last, length = marks = _marks(data, start, end)
        number = np.where(length > 16, -1, np.arange(1, self.size))
        kept = np.unique(np.stack([*marks, number.astype(np.uint64)]), axis=1, return_index=True)[1]  # long ones may agree
        self.salt = 0
        while True:
            keys = _keys(first[kept], last[kept], length[kept], self.salt)
            if len(np.unique(keys)) == len(kept):
                break
            self.salt += 1
        kept = kept[np.argsort(keys)]
        self.keys, self.marks, self.number = np.sort(keys), [m[kept] for m in marks], number[kept]
        self.shift = np.uint64(64 - min(_SIEVE, max(12, self.size.bit_length() + 4)))
        self.sieve = np.zeros(1 << 64 - int(self.shift), bool)
        self.sieve[self.keys >> self.shift] = True

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts (UTF-8) in order, A-Z lower-cased, and where the words of each text begin."""
        data = b" ".join(texts).translate(_PLAIN) + bytes(8)
        inside = np.frombuffer(data, np.uint8, len(data) - 7) != 32
        inside[-1] = False
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edges = np.concatenate([[0], edges])
        start, end = edges[::2], edges[1::2]
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        bounds = np.searchsorted(start, begins)
        start, end = _bare_ends(data, start, end)
        first, last, length = _marks(data, start, end)
        out = np.zeros(len(start), np.int64)
        if not len(self.keys):
            return out, bounds
        keys = _keys(first, last, length, self.salt)
        some = np.flatnonzero(self.sieve[keys >> self.shift])
        at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        same = np.ones(len(some), bool)
        for known, mark in zip(self.marks, (first, last, length), strict=True):
            same &= known[at] == mark[some]
        some, at = some[same], at[same]
        out[some] = self.number[at]
        for i in some[self.number[at] < 0].tolist():
            out[i] = self.long.get(data[start[i]:end[i]], 0)
        return out, bounds


def _marks(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First 8 bytes, last 8 bytes (0 if there are no others) and length of words in ``data``, which goes on for 8 bytes."""
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    length = end - start
    first, last = eight[start] & _FIRST[np.minimum(length, 8)], np.zeros(len(start), np.uint64)
    more = np.flatnonzero(length > 8)
    last[more] = eight[end[more] - 8]
    return first, last, length.astype(np.uint64)


def _keys(first: np.ndarray, last: np.ndarray, length: np.ndarray, salt: int) -> np.ndarray:
    x = first * _ODD[salt % 60] + mix(last + length) * _ODD[salt % 60 + 1]
    return (x ^ (x >> np.uint64(32))) * _ODD[salt % 60 + 2]


def _bare_ends(data: bytes, start: np.ndarray, end: np.ndarray, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Where ``bare`` words begin and end."""
    letters = np.frombuffer(data, np.uint8)
    lo, hi = start.copy(), end.copy()
    at = np.flatnonzero(_IS_PUNCTUATION[letters[lo]])
    for _ in range(rounds):
        lo[at] += 1
        at = at[lo[at] < end[at]]
        at = at[_IS_PUNCTUATION[letters[lo[at]]]]
    for i in at.tolist():
        lo[i] = end[i] - len(data[lo[i]:end[i]].lstrip(_PUNCTUATION))
    none = lo == end
    at = np.flatnonzero(_IS_PUNCTUATION[letters[hi - 1]] & ~none)
    for _ in range(rounds):
        hi[at] -= 1
        at = at[_IS_PUNCTUATION[letters[hi[at] - 1]]]
    for i in at.tolist():
        hi[i] = lo[i] + len(data[lo[i]:hi[i]].rstrip(_PUNCTUATION))
    lo[none] = start[none]
    return lo, hi


def text_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[list[bytes]]:
    """The texts of a binary column, about ``size`` bytes or one text at a time; NULL is empty."""
    part, held = [], 0
    for text in column:
        part.append(text.as_py() or b"")
        held += len(part[-1])
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def best_alignments(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman score of every pair (a[i], b[i]) with a linear gap cost, and where it ends in b[i]."""
    rows, width = max(map(len, a)), max(map(len, b))
    x, y = np.zeros((len(a), rows), np.int64), np.zeros((len(b), width), np.int64)
    inside_x, inside_y = np.zeros(x.shape, bool), np.zeros(y.shape, bool)
    for i, (p, q) in enumerate(zip(a, b, strict=True)):
        x[i, :len(p)], inside_x[i, :len(p)], y[i, :len(q)], inside_y[i, :len(q)] = p, True, q, True
    h = np.zeros((len(a), width + 1), np.int32)
    score, end = np.zeros(len(a), np.int32), np.zeros(len(a), np.int64)
    slope = np.arange(width + 1, dtype=np.int32) * -GAP
    for r in range(rows):
        same = (y == x[:, r, None]) & inside_y & inside_x[:, r, None]
        t = np.maximum(h + GAP, 0)
        t[:, 1:] = np.maximum(t[:, 1:], h[:, :-1] + np.where(same, MATCH, MISMATCH))
        h = np.maximum.accumulate(t + slope, axis=1) - slope  # a gap along b costs the same for each word
        h[:, 1:] *= inside_y
        top = h.max(1)
        better = top > score
        score[better], end[better] = top[better], h.argmax(1)[better]
    return score, end


def _align(pairs: list[tuple], items: list[np.ndarray], cells: int = 2_000_000) -> list[tuple[int, int]]:
    """(score, end in the passage) of (item, passage) pairs, in blocks of bounded memory."""
    out: list[tuple[int, int]] = [(0, 0)] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda i: len(pairs[i][1]))
    at = 0
    while at < len(order):
        n = max(1, cells // (len(pairs[order[-1]][1]) + 1))
        part, at = order[at:at + n], at + n
        score, end = best_alignments([items[pairs[i][0]] for i in part], [pairs[i][1] for i in part])
        for i, s, e in zip(part, score.tolist(), end.tolist(), strict=True):
            out[i] = (s, e)
    return out


def least_score(words: int, min_score: float) -> int:
    """Smallest alignment score of a qualifying passage of an item of so many words."""
    return math.ceil(min_score * MATCH * words - 1e-9)


def spared_score(words: list[bool], pairs: list[bool]) -> int:
    """Best score of an alignment that matches none of the marked words and keeps none of the marked pairs.

    A marked word has to be replaced or left out; two words of a marked pair, if both match, need an insertion between.
    """
    best, matched, skipped, lost = 0, -math.inf, -math.inf, max(MISMATCH, GAP)
    for j, seed in enumerate(words):
        here = -math.inf if seed else MATCH + max(0, skipped, matched + (GAP if j and pairs[j - 1] else 0))
        matched, skipped = here, max(matched, skipped) + lost
        best = max(best, here)
    return best


def chosen_seeds(log_p: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words and which pairs of neighbours of an item are its seeds: no alignment of score ``least`` avoids them all.

    ``log_p`` are the logarithms of the words' shares of the corpus. A seed word costs an alignment ``MATCH`` and the
    replacement, a seed pair the insertion; seeds go by chance hits over that cost.
    """
    n = len(log_p)
    order = np.argsort(np.concatenate([log_p - np.log((MATCH - MISMATCH) / -GAP), log_p[:-1] + log_p[1:]]), kind="stable")

    def first(count: int) -> tuple[np.ndarray, np.ndarray]:
        use = np.zeros(2 * n - 1, bool)
        use[order[:count]] = True
        return use[:n], use[n:]

    lo, hi = 1, len(order)
    while lo < hi:
        count = (lo + hi) // 2
        if spared_score(*(use.tolist() for use in first(count))) < least:
            hi = count
        else:
            lo = count + 1
    words, pairs = first(lo)
    return words, pairs & ~(words[:-1] | words[1:])  # a pair with a seed word is broken without that


class Seeds:
    """Seeds of a block of test items (arrays of word numbers, from 1 on), for look-up by word and by pair of words."""

    def __init__(self, items: list[np.ndarray], chosen: list[tuple[np.ndarray, np.ndarray]],
                 min_score: float = MIN_SCORE):
        self.items = items
        self.least = [least_score(len(item), min_score) for item in items]
        # as many insertions as a qualifying passage can have
        self.pad = [(MATCH * len(item) - least) // -GAP for item, least in zip(items, self.least, strict=True)]
        self.size = max((int(item.max()) for item in items if len(item)), default=0) + 1
        rows: dict[int, list[tuple[int, int, int]]] = {1: [], 2: []}
        for k, (item, (words, pairs)) in enumerate(zip(items, chosen, strict=True)):
            rows[1] += [(int(item[j]), k, int(j)) for j in np.flatnonzero(words)]
            rows[2] += [(int(item[j]) * self.size + int(item[j + 1]), k, int(j)) for j in np.flatnonzero(pairs)]
        self.tables = {n: [np.array(c, np.int64) for c in zip(*sorted(x), strict=True)] if x else [np.empty(0, np.int64)] * 3
                       for n, x in rows.items()}
        self.is_seed = np.zeros(self.size, bool)
        self.is_seed[self.tables[1][0]] = True
        self.begins = np.zeros(self.size, bool)  # words that begin a seed pair
        self.begins[self.tables[2][0] // self.size] = True
        self.sieve = np.zeros(1 << _SIEVE, bool)
        self.sieve[self._sifted(self.tables[2][0])] = True
        self.marked = np.zeros(self.size, bool)

    @staticmethod
    def _sifted(pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SIEVE)

    def _shared(self, words: np.ndarray, others: np.ndarray) -> int:
        """How many of the words are among the others."""
        self.marked[others] = True
        n = np.count_nonzero(self.marked[words])
        self.marked[others] = False
        return n

    def may_reach(self, k: int, passage: np.ndarray) -> bool:
        """Whether enough words of the item and of the passage occur in the other one for the score asked for."""
        item, least = self.items[k], self.least[k]
        return MATCH * self._shared(passage, item) >= least and MATCH * self._shared(item, passage) >= least

    def passages(self, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, item, from, to) of the passages around seed hits; those of a text and an item do not overlap.

        Text i is ``words[bounds[i]:bounds[i + 1]]``.
        """
        found = []
        single = np.flatnonzero(self.is_seed[words])
        begins = self.begins[words[:-1]]
        begins[bounds[(bounds > 0) & (bounds < len(words))] - 1] = False  # the next word is another text's
        double = np.flatnonzero(begins)
        pairs = words[double] * self.size + words[double + 1]
        some = np.flatnonzero(self.sieve[self._sifted(pairs)])
        for n, at, grams in ((1, single, words[single]), (2, double[some], pairs[some])):
            keys, item, place = self.tables[n]
            lo, hi = np.searchsorted(keys, grams), np.searchsorted(keys, grams, "right")
            count = hi - lo
            if count.any():
                hit = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
                text = np.searchsorted(bounds, at, "right") - 1
                found.append(np.column_stack([np.repeat(text, count), item[hit], np.repeat(at - bounds[text], count) - place[hit]]))
        if not found:
            return []
        hits = np.unique(np.concatenate(found), axis=0)
        lengths = np.diff(bounds).tolist()
        out: list[tuple[int, int, int, int]] = []
        for text, k, diagonal in hits.tolist():
            lo, hi = max(0, diagonal - self.pad[k]), min(lengths[text], diagonal + len(self.items[k]) + self.pad[k])
            if out and out[-1][0] == text and out[-1][1] == k and lo < out[-1][3]:
                out[-1] = (text, k, out[-1][2], hi)
            else:
                out.append((text, k, lo, hi))
        return out


def _word_counter(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = vocabulary.value, np.zeros(vocabulary.value.size, np.int64)
        for batch in batches:
            for texts in text_slices(batch.column(0)):
                counts += np.bincount(words.of(texts)[0], minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["at", "n"])
    return run


def rare_seeds(items: list[np.ndarray], docs: DataFrame, vocabulary, min_score: float = MIN_SCORE
               ) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every item, its seed words and seed pairs, the rare ones by the word counts of all documents first."""
    rows = (docs.select("text").mapInArrow(_word_counter(vocabulary), "at long, n long")
            .groupBy("at").agg(F.sum("n").alias("n")).collect())  # a row per word of the block at most
    total = max(1, sum(r["n"] for r in rows))
    log_p = np.full(vocabulary.value.size, -np.log(total))
    for r in rows:
        log_p[r["at"]] = np.log(max(r["n"], 1) / total)
    return [chosen_seeds(log_p[item], least_score(len(item), min_score)) for item in items]


def _searcher(seeds_of, item_ids: list[int], min_score: float, vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, vocabulary_of_items = seeds_of.value, vocabulary.value
        for batch in batches:
            pairs, where, first = [], [], 0
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            for texts in text_slices(batch.column(2)):
                words, bounds = vocabulary_of_items.of(texts)
                for i, k, lo, hi in seeds.passages(words, bounds):
                    passage = words[bounds[i] + lo:bounds[i] + hi]
                    if seeds.may_reach(k, passage):
                        pairs.append((k, passage.copy()))
                        where.append((first + i, lo))
                first += len(texts)
            rows = []
            while pairs:  # the best of every passage, then of what lies before and after it
                keep = [(k, passage, i, lo, score, end) for (k, passage), (i, lo), (score, end)
                        in zip(pairs, where, _align(pairs, seeds.items), strict=True)
                        if score and score / (MATCH * len(seeds.items[k])) >= min_score]
                # the alignment from its end backwards gives the start
                starts = _align([(n, passage[:end][::-1]) for n, (_, passage, _, _, _, end) in enumerate(keep)],
                                [seeds.items[k][::-1] for k, *_ in keep]) if keep else []
                pairs, where = [], []
                for (k, passage, i, lo, score, end), (_, back) in zip(keep, starts, strict=True):
                    rows.append((*keys[i], item_ids[k], score / (MATCH * len(seeds.items[k])), lo + end - back, lo + end))
                    for part, at in ((passage[:end - back], lo), (passage[end:], lo + end)):
                        if len(part) and seeds.may_reach(k, part):
                            pairs.append((k, part))
                            where.append((i, at))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.float64()] + [pa.int64()] * 2, strict=True)],
                names=["doc_id", "row_key", "item_id", "score", "doc_start", "doc_end"])
    return run


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE,
                      block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Passages of the rows of ``docs`` that align with a test item: doc_id, row_key, item_id, score, doc_start, doc_end (words).

    Passages of one row and item do not overlap; the best goes first.

    NULL or wordless texts and items match nothing. Repeated
    items give a row each, repeated documents too; ``row_key`` hashes id and text. Empty tables give no rows.
    """
    spark = docs.sparkSession
    corpus = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row_key"),
                         F.col("text").cast("binary").alias("text"))
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = chars // block_chars + 1
    out = spark.createDataFrame([], SCHEMA)
    for b in range(blocks):
        rows = (benchmark.filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b))
                .select(F.col("item_id").cast("long"), "text").collect())  # about block_chars characters
        items = [(r["item_id"], [bare(w) for w in words_in(r["text"])]) for r in rows]
        items = [(i, words) for i, words in items if words]
        if not items:
            continue
        numbers = {w: k for k, w in enumerate(sorted({w for _, words in items for w in words}), 1)}
        vocabulary = spark.sparkContext.broadcast(Vocabulary(list(numbers)))  # as large as the block
        coded = [np.array([numbers[w] for w in words], np.int64) for _, words in items]
        seeds = spark.sparkContext.broadcast(Seeds(coded, rare_seeds(coded, corpus, vocabulary, min_score), min_score))
        out = out.union(corpus.mapInArrow(_searcher(seeds, [i for i, _ in items], min_score, vocabulary), SCHEMA))
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a benchmark passage, all columns as they are."""
    hits = stored(benchmark_matches(docs, benchmark, **options), "benchmark-hits")
    hits = hits.select("doc_id", "row_key").distinct()
    return docs.join(hits.hint("shuffle_hash"),
                     F.xxhash64(docs["doc_id"], docs["text"]).eqNullSafe(hits["row_key"])
                     & docs["doc_id"].cast("long").eqNullSafe(hits["doc_id"]), "left_anti")
