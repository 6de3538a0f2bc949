"""Removal of byte strings that already occur in an earlier document, by suffix arrays.

A 50-byte window is dealt by its minimizer, the smallest hash among the 20-byte strings in it, so equal
windows always meet. Four steps, each streaming over partitions:

1. Every shard lists the runs of windows with one minimizer. Minimizers met in two documents (of the shard,
   or of two shards, which meet in hash buckets of a few MB) are candidates; all other windows are unique.
2. Documents with candidates keep their text, all others are done.
3. The candidate runs go as byte strings to buckets by minimizer. A string that a shard has in several
   documents is sent for the first only; the later ones are known to be copies.
4. A bucket is cut into shards of bounded size. Each gets a suffix array by Larsson-Sadakane refinement
   (only groups that are still tied are sorted again) and common prefixes by Kasai's bound; suffixes that share
   50 bytes form a class with its smallest document. The strings of a minimizer lie in one shard; only of a minimizer
   that fills more than one are the classes of its shards merged, by one sort of their keys.
   Equal strings are taken together before, and a string whose minimizer no other string has needs no array.

A passage in a third of all documents costs a record per shard and string, not per document. Shards and buckets grow with
the square root of the text, so a shard has about as much for a bucket at any size and records grow with the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import mix, stored

LENGTH, GRAM = 50, 20
#: Bytes of text per shard of the first steps, of a suffix-array shard, and of text behind a bucket.
SHARD_BYTES, SUFFIX_BYTES, BUCKET_BYTES = 3_000_000, 500_000, 4_000_000
#: Bytes of text in all up to which shards and buckets have these sizes, and documents whose strings are sent together.
FIXED_BYTES, SENT_DOCS = 1_000_000_000, 1000
_LAST = (1 << 63) - 1  # order of a NULL id: after all others
_BASE = {1 << k: np.uint64(pow(0x9E3779B97F4A7C15, 1 << k, 1 << 64)) for k in range(16)}
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


# --- minimizers ---

def _gram_hashes(a: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from every position on (meaningless within ``gram`` of the end)."""
    h, width = _TABLE[a], 1

    def joined(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
        out = left * _BASE[shift]  # a polynomial in the bytes' random numbers
        out[:-shift] += right[shift:]
        return out

    parts = {1: h}
    while width * 2 <= gram:
        if len(a) <= width:
            break
        h = joined(h, h, width)
        width *= 2
        parts[width] = h
    done, left = width, gram - width
    while left and len(a) > done:
        width = 1 << (left.bit_length() - 1)
        out = h * _BASE[width]
        out[:-done] += parts[width][done:]
        h = out
        done, left = done + width, left - width
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _minima(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest value in the ``width`` positions from every one on."""
    m, w = h.copy(), 1
    while w * 2 <= width:
        m[:-w] = np.minimum(m[:-w], m[w:])
        w *= 2
    if width > w and len(m) > width - w:
        out = m.copy()
        out[:-(width - w)] = np.minimum(m[:-(width - w)], m[width - w:])
        m = out
    return m


def _runs(data: np.ndarray, lengths: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    begins = np.cumsum(lengths) - lengths
    windows = np.maximum(lengths - length + 1, 0)
    n = int(windows.sum())
    if not n:
        return np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))
    m = _minima(_gram_hashes(data, gram), length - gram + 1)
    firsts = np.cumsum(windows) - windows
    m = m[np.repeat(begins - firsts, windows) + np.arange(n)]  # no window crosses the end of a document
    new = np.ones(n, bool)
    new[1:] = m[1:] != m[:-1]
    new[firsts[windows > 0]] = True
    first = np.flatnonzero(new)
    doc = np.searchsorted(firsts, first, "right") - 1
    return m[first], doc, first - firsts[doc], np.diff(np.append(first, n))


def runs_of(texts: list[bytes], length: int, gram: int, block: int = 150_000) -> tuple[np.ndarray, ...]:
    """Runs of windows with one minimizer: (minimizer, text number, start in the text, windows), in blocks that fit a cache."""
    out, lo = [], 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and size < block:
            size += len(texts[hi])
            hi += 1
        lengths = np.fromiter(map(len, texts[lo:hi]), np.int64, hi - lo)
        m, doc, start, n = _runs(np.frombuffer(b"".join(texts[lo:hi]), np.uint8), lengths, length, gram)
        out.append((m, doc + lo, start, n))
        lo = hi
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else _runs(np.empty(0, np.uint8), np.zeros(0, np.int64), length, gram)


# --- suffix arrays ---

def _words(text: np.ndarray, extra: int = 0) -> np.ndarray:
    """The eight bytes from every position on as one number, zeros behind the end; ``extra`` more positions."""
    wide = np.append(text, np.zeros(extra + 8, np.uint8))
    n = len(text) + extra
    pair = wide[:-1].astype(np.uint16) << 8 | wide[1:]
    four = pair[:-2].astype(np.uint32) << 16 | pair[2:]
    return (four[:n].astype(np.uint64) << np.uint64(32)) | four[4:n + 4]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorted suffixes: by eight bytes at once, then Larsson-Sadakane doubling of what is still tied.

    The sort is complete, as Kasai's bound does not hold for suffixes that are tied at some depth.
    """
    n = len(text)
    key = _words(text)
    sa = n - 1 - np.argsort(key[::-1], kind="stable")  # of equal numbers the shorter suffix first
    rank = np.full(n + 1, -1, np.int64)
    same = key[sa]
    head = np.ones(n, bool)
    head[1:] = (same[1:] != same[:-1]) | (sa[:-1] > n - 8)  # the end of the text differs from zeros
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h = 8
    while True:
        single = head & np.append(head[1:], True)
        at = np.flatnonzero(~single)
        if not len(at):
            return sa
        suffix = sa[at]
        group, nxt = rank[suffix], rank[np.minimum(suffix + h, n)]
        order = np.lexsort((nxt, group))
        sa[at] = suffix[order]
        group, nxt = group[order], nxt[order]
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])
        head[at] = new
        rank[sa[at]] = np.maximum.accumulate(np.where(new, at, 0))
        h *= 2


def common_prefixes(text: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix, up to ``cap``, of every suffix with the one before it in ``sa``.

    Every eighth position is compared from the start; the others begin at Kasai's bound (a suffix shares at most one
    byte less than the suffix one position earlier) and go on from there, eight bytes at a time.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    word = _words(text, cap + 8)
    lcp = np.zeros(n, np.int64)
    every = np.arange(n)
    for at in (every[::8], every[every % 8 > 0]):
        back = at % 8
        known = np.maximum(lcp[at - back] - back, 0)
        go = before[at] >= 0
        at, known = at[go], known[go]
        other = before[at]
        live = np.flatnonzero(known < cap)
        while len(live):
            k = known[live]
            differ = word[at[live] + k] ^ word[other[live] + k]
            same = differ == 0
            known[live[same]] += 8
            differ = differ[~same]
            known[live[~same]] += sum((differ < np.uint64(1 << 64 - 8 * j)).astype(np.int64) for j in range(1, 8))
            live = live[same]
            live = live[known[live] < cap]
        lcp[at] = np.minimum(np.minimum(known, cap), n - np.maximum(at, other))
    return lcp[sa]


def _classes(strings: list[bytes], orders: np.ndarray, length: int, with_keys: bool) -> tuple[np.ndarray, ...]:
    """Windows of the strings (one shard): (text, place and hash of a window of every class, smallest order of each, and
    for the windows in text order: class, string)."""
    text = np.frombuffer(b"\0".join(strings), np.uint8)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    begins = np.cumsum(sizes + 1) - sizes - 1
    counts = sizes - length + 1
    window = np.repeat(begins - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    of = np.repeat(np.arange(len(strings)), counts)
    sa = suffix_array(text)
    lcp = common_prefixes(text, sa, length)
    string_at = np.full(len(text), -1, np.int64)
    string_at[window] = of
    # between two windows that share 50 bytes every suffix shares them, so a break ends the class
    number = np.cumsum(lcp < length)
    mine = string_at[sa] >= 0
    sorted_at, sorted_class = sa[mine], number[mine]
    new = np.append(True, sorted_class[1:] != sorted_class[:-1])
    heads = np.flatnonzero(new)
    smallest = np.minimum.reduceat(orders[string_at[sorted_at]], heads)
    hashes = _gram_hashes(text, length)[sorted_at[heads]] if with_keys else np.empty(0, np.uint64)
    class_at = np.empty(len(text), np.int32)
    class_at[sorted_at] = np.cumsum(new) - 1
    return text, sorted_at[heads], hashes, smallest, class_at[window], of.astype(np.int32)


def _merge(parts: list[tuple[np.ndarray, ...]], length: int) -> list[np.ndarray]:
    """Smallest order of each class of the shards ``parts`` over all of them: classes meet by hash, then by their bytes."""
    counts = [len(p[1]) for p in parts]
    hashes, smallest = (np.concatenate([p[k] for p in parts]) for k in (2, 3))
    by = np.argsort(hashes, kind="stable")
    tie = hashes[by][1:] == hashes[by][:-1]
    by = by[np.append(tie, False) | np.append(False, tie)]  # classes whose hash another one has
    if len(by):
        ends = np.cumsum(counts)
        shard = np.searchsorted(ends, by, "right")
        keys = np.empty(len(by), f"S{length}")
        for k in np.unique(shard):
            text, place = parts[k][:2]
            mine = np.flatnonzero(shard == k)
            at = place[by[mine] - ends[k] + counts[k]]
            keys[mine] = np.lib.stride_tricks.sliding_window_view(text, length)[at].copy().view(f"S{length}").ravel()
        new = np.append(True, hashes[by][1:] != hashes[by][:-1])
        if (keys[1:] == keys[:-1])[~new[1:]].all():
            number = np.cumsum(new) - 1
        else:  # different windows of one hash
            number = np.unique(keys, return_inverse=True)[1]
        least = np.full(number.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, number, smallest[by])
        smallest[by] = least[number]
    return np.split(smallest, np.cumsum(counts)[:-1])


def _stretches(hit: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of the runs of hits that stay in one string."""
    at = np.flatnonzero(hit)
    if len(at):
        new = np.append(True, (at[1:] != at[:-1] + 1) | (of[at[1:]] != of[at[:-1]]))
        first = at[new]
        yield from zip(first.tolist(), np.append(at[np.flatnonzero(new)[1:] - 1], at[-1]) + 1, strict=True)


def _families(sizes: np.ndarray, groups: np.ndarray, limit: int) -> Iterator[list[tuple[int, int]]]:
    """Shards, as (first, end) of the strings, of up to ``limit`` bytes: each by itself, as it has whole groups, or
    all shards of a group that is larger."""
    ends = np.cumsum(sizes + 1)
    begins = ends - sizes - 1
    cuts = np.flatnonzero(np.append(True, groups[1:] != groups[:-1])).tolist()
    first = 0
    for a, b in zip(cuts, [*cuts[1:], len(groups)], strict=True):
        if a > first and ends[b - 1] - begins[first] > limit:
            yield [(first, a)]
            first = a
        if ends[b - 1] - begins[a] > limit:
            shard = (begins[a:b] - begins[a]) // limit
            inner = (a + np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))).tolist()
            yield list(zip(inner, [*inner[1:], b], strict=True))
            first = b
    if first < len(groups):
        yield [(first, len(groups))]


def earlier_windows(strings: list[bytes], orders: np.ndarray, length: int = LENGTH, shard_bytes: int = SUFFIX_BYTES,
                    groups: np.ndarray | None = None) -> list[list[tuple[int, int]] | None]:
    """For distinct strings with their documents' order: (first, end) of the windows that also occur in a string of
    smaller order, None where there are none. Only strings of one group, which follow each other, can share a window;
    without ``groups`` any can."""
    if not strings:
        return []
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    out: list[list[tuple[int, int]] | None] = [None] * len(strings)
    for shards in _families(sizes, np.zeros(len(strings), np.int64) if groups is None else groups, shard_bytes):
        parts = [_classes(strings[a:b], orders[a:b], length, len(shards) > 1) for a, b in shards]
        best = _merge(parts, length) if len(shards) > 1 else [parts[0][3]]
        for (first, end), (*_, cls, of), least in zip(shards, parts, best, strict=True):
            hit = least[cls] < orders[first:end][of]
            firsts = np.searchsorted(of, np.arange(end - first))
            for a, b in _stretches(hit, of):
                k = int(of[a])
                out[first + k] = [*(out[first + k] or ()), (int(a - firsts[k]), int(b - firsts[k]))]
    return out


# --- the steps on Spark ---

def _columns(names: str, *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names.split())


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[list]]:
    """Columns of the rows, gathered up to ``limit`` bytes of text (column 2)."""
    held, size = [[], [], []], 0
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            for column, value in zip(held, row, strict=True):
                column.append(value)
            size += len(row[2] or b"")
            if size >= limit:
                yield held
                held, size = [[], [], []], 0
    if held[0]:
        yield held


def _ids(values: list[int | None]) -> np.ndarray:
    return np.array([_LAST if v is None else v for v in values], np.int64)


def _span(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    return start.astype(np.int64) << 32 | n


def _merged(spans: list[int]) -> list[tuple[int, int]]:
    """(start, end) of the windows in ``spans``, overlapping and touching ones as one."""
    out: list[tuple[int, int]] = []
    for span in sorted(spans):
        start, end = span >> 32, (span >> 32) + (span & 0xFFFFFFFF)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def bucket_edges(buckets: int, length: int, gram: int) -> np.ndarray:
    """First minimizers of all buckets but the first. Buckets are ranges of minimizers with about equally many bytes of
    strings behind them: the smallest of w = ``length - gram + 1`` random hashes is x (of 1) for w (1 - x)^(w-1) of the windows, and
    (1 - x)^(w-1) (1 + (w-1) x) of the positions begin a run, which has ``length - 1`` bytes besides its windows."""
    w, more = length - gram + 1, length - 1
    x = np.linspace(0, 1, 1 << 18)
    left = (1 - x) ** w * (1 + more / w + more * (w - 1) * (x / w + (1 - x) / (w * (w + 1))))  # share from x on
    at = np.interp(np.arange(1, buckets) / buckets, 1 - left / left[0], x)
    return np.minimum(at * 2.0 ** 64, 2.0 ** 64 - 2048).astype(np.uint64)


def _bucket(m: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, m, "right")


def _slices(sorted_values: np.ndarray) -> Iterator[tuple[int, slice]]:
    heads = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else []
    for lo, hi in zip(heads, [*heads[1:], len(sorted_values)], strict=True):
        yield int(sorted_values[lo]), slice(lo, hi)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, the first byte of all numbers before the second and so on, compressed."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8").tobytes()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes))


def _unpack(data: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    sizes, at, out = np.frombuffer(raw, "<i8", n, 8), 8 * (n + 1), []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(np.dtype(kind).itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size
    return out


def _shard_number(made: int) -> int:
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() << 16) + made


def _lister(edges: np.ndarray, length: int, gram: int, shard_bytes: int = SHARD_BYTES):
    """Step 1, in the shards: runs by bucket of their minimizer; what the shard itself shares passes in a bucket of its own."""
    buckets = len(edges) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made, (ids, keys, texts) in enumerate(_shards(batches, shard_bytes)):
            shard = _shard_number(made)
            order_of = _ids(ids)
            m, doc, start, n = runs_of(texts, length, gram)
            if not len(m):
                continue
            # stable, so the runs of a minimizer stay in the order of the text
            by = np.argsort(m, kind="stable")
            m, doc, start, n = m[by], doc[by], start[by], n[by]
            heads = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
            size = np.diff(np.append(heads, len(m)))
            order = order_of[doc]
            many = np.minimum.reduceat(order, heads) != np.maximum.reduceat(order, heads)
            shared = np.repeat(many, size)
            # neighbouring shared runs of a document are one stretch; with them go the documents themselves
            at = np.flatnonzero(shared)
            at = at[np.lexsort((start[at], doc[at]))]
            new = np.append(True, (doc[at][1:] != doc[at][:-1]) | (start[at][1:] != start[at][:-1] + n[at][:-1]))[:len(at)]
            total = np.add.reduceat(n[at], np.flatnonzero(new)) if len(at) else n[at]
            first = at[new]
            used = np.unique(doc)
            yield _columns("bucket shard payload", [buckets + shard], [shard],
                           [_pack(doc[first].astype("u4"), _span(start[first], total), used.astype("u4"), order_of[used],
                                  np.array(keys, np.int64)[used])])
            # of a minimizer of several documents the buckets get a mark only (document 2^32 - 1)
            keep = ~shared
            keep[heads[many]] = True
            mark = shared[keep]
            m, doc, start, n = m[keep], doc[keep].astype("u4"), start[keep].astype("u4"), n[keep].astype("u4")
            doc[mark] = 0xFFFFFFFF
            start[mark] = n[mark] = 0
            short = m >> np.uint64(16)
            out = [(b, shard, _pack(np.diff(short[part], prepend=np.uint64(0)), doc[part], start[part], n[part]))
                   for b, part in _slices(_bucket(m, edges))]
            for lo in range(0, len(out), 200):
                yield _columns("bucket shard payload", *map(list, zip(*out[lo:lo + 200], strict=True)))
    return run


def _sharer(buckets: int):
    """Step 1, in a bucket: the runs whose minimizer two documents hold; the documents of a shard as they are."""
    def table_of(doc, span, order=None, key=None) -> pa.Table:
        none = pa.nulls(len(doc), pa.int64())
        return pa.table({"doc": doc, "span": none if span is None else span, "ord": none if order is None else order,
                         "row_key": none if key is None else key})

    def run(table: pa.Table) -> pa.Table:
        shards = table.column("shard").to_pylist()
        payloads = table.column("payload").to_pylist()
        if table.column("bucket")[0].as_py() >= buckets:
            doc, span, used, order, key = _unpack(payloads[0], "u4", "i8", "u4", "i8", "i8")
            base = np.int64(shards[0]) << 24
            return pa.concat_tables([table_of(base + doc, span), table_of(base + used, None, order, key)])
        parts = []
        for shard, payload in zip(shards, payloads, strict=True):
            m, doc, start, n = _unpack(payload, "u8", "u4", "u4", "u4")
            uid = (np.int64(shard) << 24) + doc.astype(np.int64)
            uid[doc == 0xFFFFFFFF] = -1
            parts.append((np.cumsum(m, dtype=np.uint64), uid, _span(start, n)))
        m, uid, span = map(np.concatenate, zip(*parts, strict=True))
        by = np.argsort(m, kind="stable")
        m, uid, span = m[by], uid[by], span[by]
        heads = np.flatnonzero(np.append(True, m[1:] != m[:-1]))
        low, high = np.minimum.reduceat(uid, heads), np.maximum.reduceat(uid, heads)
        use = np.repeat((low != high) | (low < 0), np.diff(np.append(heads, len(m)))) & (uid >= 0)
        return table_of(uid[use], span[use])
    return run


def _sender(edges: np.ndarray, length: int, gram: int, docs: int = SENT_DOCS):
    """Step 3, in the shards: candidate runs as strings to their buckets; copies inside the shard are verdicts."""
    buckets = len(edges) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, docs):
                piece = batch.slice(lo, docs)
                pieces, owner, place = [], [], []
                for k, (text, spans) in enumerate(zip(piece.column(2).to_pylist(), piece.column(3).to_pylist(), strict=True)):
                    for a, b in _merged(spans):
                        pieces.append(text[a:b + length - 1])
                        owner.append(k)
                        place.append(a)
                m, part, start, n = runs_of(pieces, length, gram)
                owner = np.array(owner, np.int64)[part]
                strings = np.empty(len(m), object)
                strings[:] = [pieces[p][a:a + c + length - 1] for p, a, c in zip(part.tolist(), start.tolist(), n.tolist(), strict=True)]
                order = piece.column(0).to_numpy(zero_copy_only=False)[owner]
                key = piece.column(1).to_numpy(zero_copy_only=False)[owner]
                span = _span(start + np.array(place, np.int64)[part], n)
                least: dict[bytes, int] = {}
                for x, o in zip(strings, order.tolist(), strict=True):
                    if o < least.get(x, _LAST + 1):
                        least[x] = o
                first = np.fromiter(map(least.__getitem__, strings), np.int64, len(strings)) == order
                if not first.all():
                    copy = ~first
                    yield _columns("bucket payload", [buckets + (_shard_number(0) << 20) + made],
                                   [_pack(order[copy], key[copy], span[copy], np.empty(0, np.uint64), np.empty(0, np.uint8))])
                    made += 1
                at = np.flatnonzero(first)
                at = at[np.argsort(m[at], kind="stable")]
                short = m[at] >> np.uint64(16)
                out = [(b, _pack(order[at[q]], key[at[q]], span[at[q]], np.diff(short[q], prepend=np.uint64(0)),
                                 np.frombuffer(b"".join(strings[at[q]]), np.uint8)))
                       for b, q in _slices(_bucket(m[at], edges))]
                for i in range(0, len(out), 200):
                    yield _columns("bucket payload", *map(list, zip(*out[i:i + 200], strict=True)))
    return run


def _judge(buckets: int, length: int):
    """Step 4, in a bucket: stretches of windows that an earlier document holds."""
    def run(table: pa.Table) -> pa.Table:
        parts, strings, minimizers = [], [], []
        for payload in table.column("payload"):
            *part, short, text = _unpack(payload.as_py(), "i8", "i8", "i8", "u8", "u1")
            parts.append(part)
            minimizers.append(np.cumsum(short, dtype=np.uint64))
            if len(text):
                ends, raw = np.cumsum((part[2] & 0xFFFFFFFF) + length - 1).tolist(), text.tobytes()
                strings += [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        order, key, span = map(np.concatenate, zip(*parts, strict=True))
        if table.column("bucket")[0].as_py() < buckets:
            numbers: dict[bytes, int] = {}
            of = np.fromiter((numbers.setdefault(x, len(numbers)) for x in strings), np.int64, len(strings))
            distinct = list(numbers)
            del numbers, strings
            least = np.full(len(distinct), _LAST)
            np.minimum.at(least, of, order)
            # strings can share a window only if they share the minimizer; one that no other string has is done
            m = np.empty(len(distinct), np.uint64)
            m[of] = np.concatenate(minimizers)
            by = np.argsort(m, kind="stable")
            same = m[by][1:] == m[by][:-1]
            by = by[np.append(same, False) | np.append(False, same)] if len(by) > 1 else by[:0]
            found = earlier_windows([distinct[k] for k in by.tolist()], least[by], length, groups=m[by])
            hits = {k: hit for k, hit in zip(by.tolist(), found, strict=True) if hit is not None}
            copy = order > least[of]
            cut_in = np.zeros(len(distinct), bool)
            cut_in[list(hits)] = True
            at, cut = np.flatnonzero(copy).tolist(), span[copy].tolist()
            for i in np.flatnonzero(cut_in[of] & ~copy).tolist():
                w = int(span[i])
                cut += [((w >> 32) + a << 32) + b - a for a, b in hits[int(of[i])]]
                at += [i] * (len(cut) - len(at))
            order, key, span = order[at], key[at], np.array(cut, np.int64)
        return pa.table({"ord": order, "row_key": key, "span": span})
    return run


def _cutter(length: int, with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                size, cuts, at = len(text), [], 0
                if gone:
                    for a, b in _merged(gone):
                        end = b + length - 1
                        if cuts and a <= cuts[-1][1]:
                            cuts[-1] = (cuts[-1][0], end)
                        else:
                            cuts.append((a, end))
                    left = []
                    for a, b in cuts:
                        left.append(text[at:a])
                        at = b
                    text = b"".join([*left, text[at:]])
                rows.append((size, size - len(text), len(cuts), sha256(text).hexdigest(), text if with_bytes else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of ``docs``; with ``with_bytes`` the bytes left, too.

    A byte goes if a ``length``-byte string that covers it also starts in a document with a smaller id. NULL text is
    empty; texts shorter than ``length`` stay whole. Rows that repeat an id are not smaller than each other; NULL ids
    come after all others. Empty input gives an empty result.
    """
    corpus = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("ord"),
                         F.xxhash64("doc_id", "text").alias("row_key"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    total = corpus.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wider = max(1.0, (total / FIXED_BYTES) ** 0.5)
    buckets = max(16, int(total / (wider * BUCKET_BYTES)))
    edges = bucket_edges(buckets, length, gram)
    listed = corpus.select("doc_id", "row_key", "text").mapInArrow(
        _lister(edges, length, gram, int(wider * SHARD_BYTES)), "bucket long, shard long, payload binary")
    runs = listed.groupBy("bucket").applyInArrow(_sharer(buckets), "doc long, span long, ord long, row_key long")
    candidates = stored(
        runs.groupBy("doc").agg(F.collect_list("span").alias("spans"), F.max("ord").alias("ord"), F.max("row_key").alias("row_key"))
        .filter(F.size("spans") > 0).groupBy("ord", "row_key").agg(F.flatten(F.collect_list("spans")).alias("spans")), "candidates")
    # both joins deal the documents in the same way, so they share one shuffle of the texts
    sent = (corpus.join(candidates.hint("shuffle_hash"), ["ord", "row_key"])
            .select("ord", "row_key", "text", "spans", "doc_id")
            .mapInArrow(_sender(edges, length, gram, int(wider * SENT_DOCS)), "bucket long, payload binary"))
    gone = (sent.groupBy("bucket").applyInArrow(_judge(buckets, length), "ord long, row_key long, span long")
            .groupBy("ord", "row_key").agg(F.collect_list("span").alias("gone")))
    out = (corpus.join(gone.hint("shuffle_hash"), ["ord", "row_key"], "left").select("doc_id", "text", "gone").mapInArrow(
        _cutter(length, with_bytes),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))
    return out if with_bytes else out.drop("kept")
