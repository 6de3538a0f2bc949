"""Best-fit packing improved by a swap-based local search.

A document's ids are cut from its end into pieces of the sequence length, so only its first piece may be shorter.
Full pieces are sequences of their own. The others are laid by best fit, longest first, and the sequences that are
left underfull are searched: moving a document, exchanging one for one, two for one or one for two between two of
them, whenever that increases the sum of squared fills, until no exchange does; a sequence that runs empty goes.
Every task packs the documents of its own partition, of which only lengths and checksums are held; the underfull
sequences of all tasks are then opened and packed once more, many tasks' in one.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored

SEQUENCE, END_ID = 1024, 2
#: Documents packed together, remembered words of a worker.
CHUNK_ITEMS, CACHED_UNITS = 200_000, 1_200_000

SCHEMA = ("doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, `offset` long, fill long")
#: Sequences of the second packing are numbered from here on.
SECOND_ROUND = 1 << 62

#: White space as the tokenizer sees it.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A run of white space but for the character that goes to the next word; a word with its space; a lone white space.
UNIT = re.compile(f"[{SPACES}]+(?![^{SPACES}])| ?[^{SPACES}]+|[{SPACES}]")
_RARE = (b"\t", b"\x0b", b"\x0c", b"\r", b"\xff")
_WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_PAIRS = (b"  ", b" \n", b"\n ", b"\n\n")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def units(text: bytes) -> list[bytes]:
    """Pieces of a text (UTF-8) whose ids do not depend on what stands beside them."""
    odd = any(x in text for x in _RARE) or not text.isascii() and any(x in text for x in _WIDE)
    if not odd and any(x in text for x in _PAIRS):
        odd = text.endswith(_PAIRS) or any(x + y in text for x in _PAIRS for y in (b" ", b"\n"))
    if odd:
        return [u.encode() for u in UNIT.findall(text.decode("utf-8", "replace"))]
    return text.replace(b" ", b"\xff ").replace(b"\n", b"\xff\n\xff").split(b"\xff")


class ByteEncoder:
    """Ids of texts (UTF-8) under a byte-level tokenizer, as little-endian uint32 bytes.

    Texts are cut into units, and every distinct unit is encoded once. ``limit`` bounds the remembered units; later
    ones are encoded again for every slice of texts that holds them. Texts that hold a special token of the tokenizer
    are encoded whole.
    """

    def __init__(self, path: str, limit: int = CACHED_UNITS):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.limit, self.known = Tokenizer.from_file(path), limit, {b"": b""}
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _learn(self, fresh: dict[bytes, bytes]) -> None:
        marked: dict[bytes, list[bytes]] = {}  # a full stop or comma after a letter is a token of its own
        plain = {}
        for u in fresh:
            if u[-1:] in (b".", b",") and u[-2:-1].isalpha():
                marked.setdefault(u[:-1], []).append(u)
            else:
                plain[u] = b""
        for u in (*marked, b".", b","):
            if u not in self.known:
                plain[u] = b""
        new = list(plain)
        for at in range(0, len(new), 500):
            part = new[at:at + 500]
            encoded = self.tokenizer.encode([u.decode("utf-8", "replace") for u in part], is_pretokenized=True,
                                            add_special_tokens=False)
            ids = np.array(encoded.ids, "<u4").tobytes()
            cuts = (4 * np.searchsorted(np.array(encoded.word_ids, np.int64), np.arange(1, len(part) + 1))).tolist()
            for unit, lo, hi in zip(part, [0, *cuts[:-1]], cuts, strict=True):
                plain[unit] = ids[lo:hi]
        for word, ends in marked.items():
            for u in ends:
                fresh[u] = (plain.get(word) or self.known[word]) + (plain.get(u[-1:]) or self.known[u[-1:]])
        fresh.update(plain)
        if len(self.known) < self.limit:
            self.known.update(fresh)

    def _whole(self, text: bytes) -> bytes:
        ids = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def __call__(self, texts: list[bytes | None], slice_bytes: int = 100_000) -> Iterator[bytes]:
        lo = 0
        while lo < len(texts):
            cut, fresh, size = [], {}, 0
            while lo < len(texts) and size < slice_bytes:
                text, lo = texts[lo] or b"", lo + 1
                size += len(text)
                if any(s in text for s in self.special):
                    cut.append(([self._whole(text)], [], ()))
                    continue
                names = units(text)
                ids, gaps, at = list(map(self.known.get, names)), [], -1
                for _ in range(ids.count(None)):
                    at = ids.index(None, at + 1)
                    gaps.append(at)
                    fresh[names[at]] = b""
                cut.append((ids, names, gaps))
            if fresh:
                self._learn(fresh)
            for ids, names, gaps in cut:
                for at in gaps:
                    ids[at] = fresh[names[at]]
                yield b"".join(ids)


@lru_cache(1)
def shared_encoder(path: str) -> ByteEncoder:
    """The encoder of this Python worker; later tasks find the units of earlier ones."""
    return ByteEncoder(path)


def best_fit(sizes: list[int], capacity: int = SEQUENCE) -> list[list[int]]:
    """Bins of item numbers: the longest item first, each into the fullest bin that holds it."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = 0  # bit g: a bin with gap g is open
    for k in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        n = sizes[k]
        if open_bins := gaps >> n:
            gap = n + (open_bins & -open_bins).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps ^= 1 << gap
            bins[b].append(k)
        else:
            gap, b = capacity, len(bins)
            bins.append([k])
        if left := gap - n:
            by_gap[left].append(b)
            gaps |= 1 << left
    return bins


class _Index:
    """For each size, the bins that hold it (one item or the sum of two) by what else they hold, least first."""

    def __init__(self, capacity: int):
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.least = np.full(capacity + 1, capacity + 1, np.int64)

    def add(self, size: int, rest: int, b: int) -> None:
        insort(self.bins[size], (rest, b))
        self.least[size] = self.bins[size][0][0]

    def drop(self, size: int, rest: int, b: int) -> None:
        held = self.bins[size]
        del held[bisect_left(held, (rest, b))]
        self.least[size] = held[0][0] if held else len(self.least)

    def largest(self, above: int, most: int, rest: int) -> int:
        """The largest size in (above, most] that lies beside less than ``rest``; 0 if none does."""
        found = np.flatnonzero(self.least[above + 1:most + 1] < rest)
        return int(found[-1]) + above + 1 if len(found) else 0


def local_search(bins: list[list[int]], sizes: list[int], capacity: int = SEQUENCE) -> list[list[int]]:
    """Exchanges between underfull bins until none increases the sum of squared fills; without the emptied ones.

    The bin gives nothing, one item or two (of sum y) for an item, or for one item two items of one bin, of sum x > y.
    It fits if x is at most the capacity less the rest of the bin, and the squares grow if and only if that rest is
    larger than the rest of the other bin. Every exchange adds to a bounded whole number, so the search ends.
    """
    full = [b for b in bins if sum(sizes[k] for k in b) == capacity]
    left = [list(b) for b in bins if sum(sizes[k] for k in b) < capacity]
    fill = [sum(sizes[k] for k in b) for b in left]
    one, two = _Index(capacity), _Index(capacity)

    def choices(b: int) -> tuple[set[int], dict[int, tuple[int, int]]]:
        """Sizes of a bin's items, and the sums of two of them."""
        counts = Counter(sizes[k] for k in left[b])
        pairs = {x + y: (x, y) for x, y in combinations(counts, 2)}
        return set(counts), pairs | {2 * x: (x, x) for x, n in counts.items() if n > 1}

    def enter(b: int, add: bool) -> None:
        singles, pairs = choices(b)
        for index, some in ((one, singles), (two, pairs)):
            for x in some:
                (index.add if add else index.drop)(x, fill[b] - x, b)

    def take(b: int, wanted: tuple[int, ...]) -> list[int]:
        out = []
        for x in wanted:
            at = next(i for i, k in enumerate(left[b]) if sizes[k] == x)
            out.append(left[b].pop(at))
        return out

    def exchange(b: int) -> bool:
        """The exchange that fills the bin most; the bin itself is not in the indexes meanwhile."""
        singles, pairs = choices(b)
        best = (0, None, (), 0)
        for index, given in ((one, [()]), (one, [(y,) for y in singles]), (two, [(y,) for y in singles]), (one, pairs.values())):
            for own in given:
                y = sum(own)
                x = index.largest(y + best[0], capacity - fill[b] + y, fill[b] - y)
                if x:
                    best = (x - y, index, own, x)
        gain, index, own, x = best
        if not gain:
            return False
        a = index.bins[x][0][1]
        theirs = (x,) if index is one else choices(a)[1][x]
        enter(a, False)
        mine, got = take(b, own), take(a, theirs)
        left[b] += got
        left[a] += mine
        fill[b] += gain
        fill[a] -= gain
        if left[a]:
            enter(a, True)
        return True

    for b in range(len(left)):
        enter(b, True)
    changed = len(left) > 1
    while changed:
        changed = False
        for b in sorted(range(len(left)), key=lambda i: -fill[i]):
            if not left[b] or fill[b] == capacity:
                continue
            enter(b, False)
            while fill[b] < capacity and exchange(b):
                changed = True
            if fill[b] < capacity:  # a full bin takes no more part
                enter(b, True)
    return full + [b for b in left if b]


def pack(sizes: list[int], capacity: int = SEQUENCE) -> list[list[int]]:
    """Bins of item numbers: best fit, then local search."""
    return local_search(best_fit(sizes, capacity), sizes, capacity)


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 6]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "fill"]
    for at in range(0, len(rows), 10_000):
        cols = zip(*rows[at:at + 10_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def _laid(items: list[tuple], capacity: int, first: int) -> list[tuple]:
    """Rows of the items (doc_id, piece, start, length, crc) in their sequences, numbered from ``first``."""
    rows, sizes = [], [x[3] for x in items]
    for number, members in enumerate(pack(sizes, capacity), first):
        fill, offset = sum(sizes[k] for k in members), 0
        for k in members:
            rows.append((*items[k], number, offset, fill))
            offset += sizes[k]
    return rows


def _cutter(path: str, capacity: int, chunk_items: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = shared_encoder(path), np.array([END_ID], "<u4").tobytes()
        number = TaskContext.get().partitionId() << 40
        items, rows = [], []
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                data += end
                n = len(data) // 4
                at, piece = (n - 1) % capacity + 1, 1
                items.append((doc_id, 0, 0, at, zlib.crc32(data[:4 * at])))
                while at < n:
                    rows.append((doc_id, piece, at, capacity, zlib.crc32(data[4 * at:4 * (at + capacity)]), number, 0, capacity))
                    at, piece, number = at + capacity, piece + 1, number + 1
            if len(items) >= chunk_items:
                rows += _laid(items, capacity, number)
                number, items = rows[-1][5] + 1, []
            yield from _batches(rows)
            rows = []
        if items:
            yield from _batches(_laid(items, capacity, number))
    return run


def _repacker(capacity: int, chunk_items: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, items = SECOND_ROUND + (TaskContext.get().partitionId() << 40), []
        for batch in batches:
            items += zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
            if len(items) >= chunk_items:
                rows = _laid(items, capacity, number)
                number, items = rows[-1][5] + 1, []
                yield from _batches(rows)
        if items:
            yield from _batches(_laid(items, capacity, number))
    return run


def pack_best_fit(docs: DataFrame, tokenizer: str | None = None, capacity: int = SEQUENCE,
                  chunk_items: int = CHUNK_ITEMS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the fill of its sequence.

    NULL or empty text is the end id alone. Rows that repeat an id are packed each for itself, NULL ids too; an
    empty table gives no rows; other columns are not read. Sequence numbers are unique, not consecutive.
    """
    laid = stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(
        _cutter(tokenizer or default_tokenizer(), capacity, chunk_items), SCHEMA), "best-fit")
    open_ = laid.filter(F.col("fill") < capacity)
    # by a hash of what the rows hold: the same rows lie in the same task when one is run again
    tasks = open_.count() // chunk_items + 1
    again = (open_.select("doc_id", "piece", "start", "length", "ids_crc32")
             .repartition(tasks, F.xxhash64("doc_id", "ids_crc32", "length", "sequence_id"))
             .mapInArrow(_repacker(capacity, chunk_items), SCHEMA))
    return laid.filter(F.col("fill") == capacity).unionByName(again)
