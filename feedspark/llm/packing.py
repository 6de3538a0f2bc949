"""Hierarchical packing of tokenized documents into sequences of several context sizes.

A document's ids are routed to the smallest tier that holds them; what exceeds the longest tier is cut off
in whole windows. Going from the longest tier down, every routed document opens a window of its tier, and
the gap is filled with whole documents of shorter tiers, longest first, then with a piece cut to size.
What is left when shorter documents run out is laid end to end into the longest windows, and the last of
those is split at powers of two, so no sequence has padding at all. Sequences of one tier are dealt into
step groups of equal token counts. Every task packs the documents of its own partition in bounded chunks.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_right, insort
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
#: Tokens held before they are packed, tokens of a step group, remembered words of a worker, rows taken out of a batch at once.
CHUNK_TOKENS, STEP_TOKENS, CACHED_UNITS, SLICE_ROWS = 1_500_000, 65_536, 500_000, 200

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "`offset` long, tier long, step_group long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Known(dict):
    """Ids of units; units not in it are noted in ``fresh``."""

    def __init__(self):
        super().__init__({b"": b""})
        self.fresh: dict[bytes, bytes] = {}

    def __missing__(self, unit: bytes) -> bytes:
        return self.fresh.setdefault(unit, b"")


class Encoder:
    """Ids of texts (UTF-8) as little-endian uint32 bytes.

    The tokenizer lower-cases, drops white space and never looks across it, so texts are lower-cased (A-Z, unless they
    may hold a special token), cut at spaces and newlines, and every distinct unit is encoded once. A run of a-z is a word
    of the tokenizer as it stands and goes to its model at once. ``limit`` bounds the remembered units and with them the
    memory of a worker; later ones are encoded again for every slice of texts that holds them.
    """

    def __init__(self, path: str, limit: int = CACHED_UNITS):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.limit, self.known = Tokenizer.from_file(path), limit, _Known()
        self.model = self.tokenizer.model

    def _word(self, letters: bytes) -> bytes:
        """Ids of a run of a-z."""
        return array("I", [t.id for t in self.model.tokenize(letters.decode())]).tobytes()

    def _learn(self, units: dict[bytes, bytes]) -> None:
        """Encodes new units, many in one call; the tokenizer says which unit a token is of."""
        new = []
        for u in units:  # a full stop or comma after a letter is a token of its own
            if u.isalpha() and u.islower():
                units[u] = self._word(u)
                continue
            stem, mark = u[:-1], self.known.get(u[-1:]) if u[-1:] in b".," and u[-2:-1].isalpha() else None
            word = mark and (self.known.get(stem) or (self._word(stem) if stem.isalpha() and stem.islower() else None))
            if word:
                units[u] = word + mark
            else:
                new.append(u)
        for at in range(0, len(new), 500):
            part = new[at:at + 500]
            encoded = self.tokenizer.encode([u.decode("utf-8", "surrogatepass") for u in part], is_pretokenized=True,
                                            add_special_tokens=False)
            ids = np.array(encoded.ids, "<u4").tobytes()
            cuts = (4 * np.searchsorted(np.array(encoded.word_ids, np.int64), np.arange(1, len(part) + 1))).tolist()
            for unit, lo, hi in zip(part, [0, *cuts[:-1]], cuts, strict=True):
                units[unit] = ids[lo:hi]
        self.known.update(islice(units.items(), max(0, self.limit - len(self.known))))

    def __call__(self, texts: list[bytes | None], slice_bytes: int = 100_000) -> Iterator[bytes]:
        known, lo = self.known, 0
        while lo < len(texts):
            cut, size = [], 0
            while lo < len(texts) and size < slice_bytes:
                text, lo = texts[lo] or b"", lo + 1
                size += len(text)
                cut.append((text if b"<|" in text else text.lower()).replace(b"\n", b" ").split(b" "))
            known.fresh = {}
            for units in cut:
                deque(map(known.__getitem__, units), 0)
            if known.fresh:
                self._learn(known.fresh)
            for units in cut:
                yield b"".join(map(known.__getitem__, units))


@lru_cache(1)
def shared_encoder(path: str) -> Encoder:
    """The encoder of this Python worker; later tasks find the units of earlier ones."""
    return Encoder(path)


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that cover every document; each sum is a power of two."""
    longest = tiers[-1]
    out: list[list[tuple[int, int, int]]] = []
    stock: list[tuple[int, int, int]] = []  # (length, document, start), sorted: documents and what is left of them
    for k, n in enumerate(lengths):
        whole = n // longest * longest
        out += [[(k, at, longest)] for at in range(0, whole, longest)]
        if n > whole:
            stock.append((n - whole, k, whole))
    stock.sort()
    rest = []  # windows that found no filling
    while stock:
        n, k, at = stock.pop()
        tier = next(t for t in tiers if t >= n)
        if tier == tiers[0] and n < tier:
            stock.append((n, k, at))
            break
        pieces, gap = [(k, at, n)], tier - n
        while gap and stock:
            fit = bisect_right(stock, (gap, len(lengths), 0)) - 1
            if fit >= 0:
                m, j, s = stock.pop(fit)
                pieces.append((j, s, m))
                gap -= m
            else:
                m, j, s = stock.pop(0)
                pieces.append((j, s, gap))
                insort(stock, (m - gap, j, s + gap))
                gap = 0
        (rest if gap else out).append(pieces)
    line = [p for pieces in rest for p in pieces] + [(k, at, n) for n, k, at in reversed(stock)]
    left = sum(p[2] for p in line)
    sizes = [longest] * (left // longest) + [1 << b for b in reversed(range(longest.bit_length() - 1)) if left % longest >> b & 1]
    at = 0
    for size in sizes:
        pieces = []
        while size:
            k, start, n = line[at]
            m = min(n, size)
            pieces.append((k, start, m))
            size -= m
            line[at] = (k, start + m, n - m)
            at += m == n
        out.append(pieces)
    return out


def _packer(path: str, tiers: tuple[int, ...], chunk_tokens: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = shared_encoder(path)
        first = TaskContext.get().partitionId() << 40
        made, steps, open_steps = 0, 0, {}

        def flush(ids: list[int | None], parts: list[bytes]) -> Iterator[pa.RecordBatch]:
            nonlocal made, steps
            rows = []
            for pieces in pack([len(p) // 4 for p in parts], tiers):
                tokens = sum(p[2] for p in pieces)
                step, room = open_steps.get(tokens, (0, 0))
                if room < tokens:
                    step, room, steps = steps, max(STEP_TOKENS, tokens), steps + 1
                open_steps[tokens] = (step, room - tokens)
                offset = 0
                for k, start, n in pieces:
                    rows.append((ids[k], start, n, zlib.crc32(parts[k][4 * start:4 * (start + n)]), len(parts[k]) // 4,
                                 first + made, offset, tokens, first + step))
                    offset += n
                made += 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"]
            for at in range(0, len(rows), 10_000):
                cols = zip(*rows[at:at + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        ids, parts, held = [], [], 0
        end = np.array([END_ID], "<u4").tobytes()
        for part in (batch.slice(at, SLICE_ROWS) for batch in batches for at in range(0, batch.num_rows, SLICE_ROWS)):
            for doc_id, data in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                ids.append(doc_id)
                parts.append(data + end)
                held += len(parts[-1]) // 4
                if held >= chunk_tokens:
                    yield from flush(ids, parts)
                    ids, parts, held = [], [], 0
        yield from flush(ids, parts)
    return run


def pack_documents(docs: DataFrame, tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS,
                   chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """One row per piece of a document: where its ids lie in which sequence, the tier and the step group.

    NULL or empty text is the end id alone. Rows that repeat an id are packed each for itself, NULL ids too;
    an empty table gives no rows. ``tiers`` are powers of two; sequence and step numbers are unique over all tasks.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(tiers):
        raise ValueError("tiers must be ascending powers of two")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(
        _packer(tokenizer or default_tokenizer(), tiers, chunk_tokens), SCHEMA)
