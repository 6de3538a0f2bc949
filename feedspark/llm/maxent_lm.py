"""Hashed maximum-entropy language model with class-factored softmax, scored in sparse numpy batches.

P(word | context) = P(class | context) * P(word | class). The class distribution is a softmax over hashed
features of the context: the word before, the word before that (skip), both, and the word before with the one
three back (skip pair). Classes come from the corpus too: the most frequent words and the text end have
their own, other frequent words are clustered by the frequent words next to them and split by frequency, the rest
of the head falls into frequency bins and all words beyond the head share one class.

Passes over the corpus: (1) counts of all training words, summed by a shuffle; (2) the texts as head ranks,
written once, with neighbour counts of the training texts; (3) ``ROUNDS`` gradient rounds, each over its own slice of
the training documents, so every one is used: tasks send observed and expected counts of features and
classes in blocks, the blocks are summed on the executors and the step is taken on the driver, which holds only
the weights; (4) scoring. Words beyond the head get their counts by a join on the word hash.

Bounds: ``HEAD`` words are broadcast, ``CLUSTERED`` of them clustered, ``ROWS`` x classes weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import mix, stored

HEAD, CLUSTERED, ANCHORS, CLUSTERS, BINS, SINGLE = 1 << 19, 1 << 15, 64, 8, 3, 24
#: Feature templates: rows of the weights of each.
TEMPLATES = (4096, 2048, 8192, 2048)
ROWS = sum(TEMPLATES)
ROUNDS, RATE, SMOOTH = 4, 0.3, 10.0
BATCH_TOKENS, TASK_TOKENS, BLOCKS = 20_000, 2_000_000, 16
CACHED = 1000  # tokens whose class distributions stay in a core's cache while they are made
HELD_OUT_MOD, HELD_OUT = 7, 2
END = xxhash.xxh64_intdigest(b"\x00end of text")  # no word holds this byte sequence by itself


def held_out(doc_id) -> F.Column:
    """Documents that the model does not learn from; a NULL id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % HELD_OUT_MOD == HELD_OUT


class Words(dict):
    """Word (bytes) -> number of a row in ``hashes``; bounded, forgets everything when full."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit, self.hashes = limit, np.empty(limit + 1, np.uint64)
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.hashes[0] = END

    def __missing__(self, word: bytes) -> int:
        k = len(self) + 1
        if k > len(self.hashes) - 1:  # one text may hold more words than the limit
            self.hashes = np.append(self.hashes, np.empty(len(self.hashes), np.uint64))
        self.hashes[k] = xxhash.xxh64_intdigest(word)
        self[word] = k
        return k

    def numbers(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        out = np.zeros(len(words) + 1, np.int64)
        out[:-1] = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return out

    def room(self) -> bool:
        """Forgets everything when full; whether it did."""
        if len(self) >= self.limit:
            self.reset()
            return True
        return False


# --- (1) counts ---

def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    counts = np.zeros(len(words.hashes), np.int64)

    def out() -> pa.RecordBatch:
        at = np.flatnonzero(counts)
        batch = pa.RecordBatch.from_arrays([pa.array(words.hashes[at].view(np.int64)), pa.array(counts[at])], names=["word", "n"])
        counts[:] = 0
        return batch

    for batch in batches:
        for text in batch.column(0):
            numbers = words.numbers(text.as_py())
            if len(counts) < len(words.hashes):
                counts.resize(len(words.hashes), refcheck=False)
            np.add.at(counts, numbers, 1)
            if len(words) >= words.limit:
                yield out()
                words.room()
    yield out()


def word_counts(training: DataFrame) -> DataFrame:
    """word (64-bit hash), n: counts over all ``training`` texts, text ends included."""
    return training.select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_of(counts: DataFrame, limit: int) -> DataFrame:
    """The most frequent words, ``limit`` at most: all words from the smallest count on that allows it.

    Counts are told apart up to an eighth of a power of two, so the driver reads a few hundred numbers, sorts nothing.
    """
    step = F.floor(F.log2("n") * 8)
    sizes = sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True)
    total, least = 0, None
    for at, n in sizes:
        total += n
        if total > limit:
            break
        least = at
    return counts.filter(step >= least) if least is not None else counts.limit(0)


# --- (2) ranks and neighbours ---

def _blocks(cells: np.ndarray, size: int) -> Iterator[tuple[int, bytes]]:
    """A dense array in ``BLOCKS`` compressed blocks; blocks of zeros are left out."""
    for k in range(BLOCKS):
        part = cells[k * size // BLOCKS:(k + 1) * size // BLOCKS]
        if part.any():
            yield k, zstandard.ZstdCompressor(level=1).compress(part.tobytes())


def _summed(kind: str):
    def run(table: pa.Table) -> pa.Table:
        total = 0
        for p in table.column("payload"):
            total = total + np.frombuffer(zstandard.ZstdDecompressor().decompress(p.as_py()), kind).astype("f8")
        return pa.table({"block": [table.column("block")[0].as_py()], "payload": [total.astype("f8").tobytes()]})
    return run


def _gathered(blocks: DataFrame, size: int, kind: str) -> np.ndarray:
    """Blocks summed on the executors; the driver gets one array of ``size`` numbers, a bound set by parameters."""
    out = np.zeros(size)
    for row in blocks.groupBy("block").applyInArrow(_summed(kind), "block long, payload binary").collect():
        k = row["block"]
        out[k * size // BLOCKS:(k + 1) * size // BLOCKS] = np.frombuffer(row["payload"], "f8")
    return out


def _ranker(head):
    """Texts as head ranks (len(head): beyond it), the hashes of the words beyond, neighbour counts of training texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hashes, rank_of = head.value
        words, ranks, known = Words(), np.zeros(0, np.uint32), 0
        near = np.zeros(CLUSTERED * ANCHORS, np.int32)
        packer, made = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 36
        names = ["row", "doc_id", "held", "n_tokens", "ranks", "beyond", "block", "payload"]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            rows = []
            for doc_id, held, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                if words.room():
                    known = 0
                numbers = words.numbers(text.as_py())
                if len(words) + 1 > known:
                    if len(ranks) < len(words.hashes):
                        ranks = np.append(ranks, np.zeros(len(words.hashes) - len(ranks), np.uint32))
                    new = words.hashes[known:len(words) + 1]
                    at = np.minimum(np.searchsorted(hashes, new), max(len(hashes) - 1, 0))
                    ranks[known:len(words) + 1] = np.where(hashes[at] == new, rank_of[at], len(hashes)) if len(hashes) else 0
                    known = len(words) + 1
                r = ranks[numbers]
                beyond = words.hashes[numbers[r == len(hashes)]]
                if not held.as_py():
                    for x, y in ((r[:-1], r[1:]), (r[1:], r[:-1])):
                        use = (x < CLUSTERED) & (y < ANCHORS) & (x < len(hashes)) & (y < len(hashes))
                        np.add.at(near, x[use].astype(np.int64) * ANCHORS + y[use], 1)
                rows.append((made, doc_id.as_py(), held.as_py(), len(r), packer.compress(r.tobytes()), beyond.tobytes(), None, None))
                made += 1
            yield batch_of(rows)
        yield batch_of([(None,) * 6 + b for b in _blocks(near, len(near))])
    return run


# --- classes ---

def cluster(near: np.ndarray, counts: np.ndarray, k: int, steps: int = 25) -> np.ndarray:
    """k-means on the square roots of neighbour shares, weighted by counts; ties go to the lower cluster."""
    x = np.sqrt(near / np.maximum(near.sum(1, keepdims=True), 1))
    centres = x[[0]]
    while len(centres) < min(k, len(x)):  # the heaviest far word is the next centre
        gap = 1 - (x @ centres.T).max(1)
        centres = np.vstack([centres, x[[np.argmax(gap * np.sqrt(counts))]]])
    for _ in range(steps):
        of = (x @ centres.T).argmax(1)
        for c in range(len(centres)):
            if (of == c).any():
                m = (x[of == c] * counts[of == c, None]).sum(0)
                centres[c] = m / max(np.linalg.norm(m), 1e-9)
    return (x @ centres.T).argmax(1)


def word_classes(counts: np.ndarray, near: np.ndarray, end_rank: int) -> np.ndarray:
    """Class of every head rank; the class of all words beyond the head is the highest number, given once more at the end."""
    n = len(counts)
    out = np.zeros(n + 1, np.int64)
    m = min(CLUSTERED, n)
    label = np.zeros(n, np.int64)
    if m:
        label[:m] = cluster(near.reshape(CLUSTERED, ANCHORS)[:m], counts[:m], CLUSTERS) + 1
    group = np.full(n, -1)
    for c in range(CLUSTERS + 1):  # 0: head words that are not clustered
        at = np.flatnonzero(label == c)
        mass = np.cumsum(np.sqrt(counts[at]))
        group[at] = SINGLE + 1 + c * BINS + np.minimum(BINS * mass // (mass[-1] + 1), BINS - 1) if len(at) else 0
    group[:SINGLE] = np.arange(min(n, SINGLE))
    if end_rank >= 0:
        group[end_rank] = SINGLE
    _, out[:n] = np.unique(group, return_inverse=True)
    out[n] = out[:n].max() + 1 if n else 0
    return out


# --- features, training, scoring ---

def features(ranks: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    """Rows of the weights for every token of texts laid end to end (``begins``: where each starts)."""
    n = len(ranks)
    place = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
    before = []
    for back in (1, 2, 3):
        w = np.full(n, 0xFFFFFFFF, np.uint64)
        w[back:] = ranks[:max(n - back, 0)]
        w[place < back] = 0xFFFFFFFF - back
        before.append(w)
    a, b, c = before

    def own(w: np.ndarray, size: int) -> np.ndarray:  # frequent words have a row each, others share
        plain = np.uint64(size * 3 // 4)
        return np.where(w < plain, w, plain + mix(w) % np.uint64(size // 4)).astype(np.int64)

    out = [own(a, TEMPLATES[0]), own(b, TEMPLATES[1]),
           (mix(a * np.uint64(0x9E3779B1) + b) % np.uint64(TEMPLATES[2])).astype(np.int64),
           (mix(a * np.uint64(0x85EBCA77) + c + np.uint64(7)) % np.uint64(TEMPLATES[3])).astype(np.int64)]
    start = 0
    for f, size in zip(out, TEMPLATES, strict=True):
        f += start
        start += size
    return out


def _logits(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Sums of the weights of every token's features, the greatest of a token moved to 0."""
    z = weights[rows[0]]
    for f in rows[1:]:
        z += weights[f]
    z += bias
    z -= z.max(1, keepdims=True)
    return z


def class_logs(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Natural log of the class distribution of every token."""
    z = _logits(weights, bias, rows)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z


def target_logs(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    """``class_logs`` of one class per token only."""
    z = _logits(weights, bias, rows)
    of = z[np.arange(len(z)), target]
    return of - np.log(np.exp(z, out=z).sum(1))


def _batches(batches: Iterator[pa.RecordBatch], column: int, limit: int):
    """Texts of about ``limit`` tokens at a time: (arrow rows, ranks end to end, begins); a longer text comes in one."""
    plain = zstandard.ZstdDecompressor()
    for batch in batches:
        lo, held, total = 0, [], 0
        for k in range(batch.num_rows):
            held.append(np.frombuffer(plain.decompress(batch.column(column)[k].as_py()), np.uint32))
            total += len(held[-1])
            if total >= limit or k + 1 == batch.num_rows:
                sizes = np.array([len(x) for x in held])
                yield batch.slice(lo, k + 1 - lo), np.concatenate(held), np.cumsum(sizes) - sizes
                lo, held, total = k + 1, [], 0


def _pieces(n: int, size: int) -> Iterator[slice]:
    for lo in range(0, n, size):
        yield slice(lo, min(n, lo + size))


def _gradient(model):
    """Observed and expected counts of (feature, class) over the texts of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, class_of = model.value
        c = weights.shape[1]
        seen, expected = np.zeros(ROWS * c), np.zeros((c, ROWS))  # expected: a class at a time over the features of a template
        p, ends = np.empty((c, BATCH_TOKENS)), np.cumsum(TEMPLATES).tolist()
        ranges = list(zip([0, *ends[:-1]], ends, strict=True))
        for _, ranks, begins in _batches(batches, 0, BATCH_TOKENS):
            target, rows = class_of[ranks], features(ranks, begins)
            for f in rows:
                np.add.at(seen, f * c + target, 1.0)
            for part in _pieces(len(ranks), BATCH_TOKENS):
                here = [f[part] for f in rows]
                n = len(here[0])
                for few in _pieces(n, CACHED):
                    z = class_logs(weights, bias, [f[few] for f in here])
                    p[:, few] = np.exp(z, out=z).T
                for f, (lo, hi) in zip(here, ranges, strict=True):
                    at = f - lo
                    for k in range(c):
                        expected[k, lo:hi] += np.bincount(at, p[k, :n], hi - lo)
        both = np.concatenate([seen, expected.T.ravel()]).astype(np.float32)
        out = list(_blocks(both, len(both)))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([p for _, p in out], pa.binary())],
                                         names=["block", "payload"])
    return run


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, class_of, in_class, base = model.value
        log10 = 1 / np.log(10)
        for batch, ranks, begins in _batches(batches, 4, BATCH_TOKENS):
            target, rows = class_of[ranks], features(ranks, begins)
            logs = np.empty(len(ranks))
            for part in _pieces(len(ranks), CACHED):
                logs[part] = target_logs(weights, bias, [f[part] for f in rows], target[part]) * log10
            logs += in_class[ranks]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(4)), pa.array(np.add.reduceat(logs, begins)),
                 pa.array(np.add.reduceat(base[ranks], begins)),
                 pa.array(np.add.reduceat((ranks < len(base) - 1).astype(np.int64), begins)), batch.column(5)],
                names=["row", "doc_id", "held", "n_tokens", "score", "base", "n_head", "beyond"])
    return run


def _beyond(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, data in zip(batch.column(0), batch.column(1), strict=True):
            words, n = np.unique(np.frombuffer(data.as_py(), np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), row.as_py())), pa.array(words), pa.array(n)],
                                             names=["row", "word", "times"])


def score_documents(docs: DataFrame, head_words: int = HEAD, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of ``docs``.

    Scores are log10 probabilities of all words and the text end. A word that training does not know is one
    event, as in the base score. NULL text is empty; rows that repeat an id are scored each for itself. Without
    training documents every word is unknown. Empty input gives an empty result.
    """
    spark = docs.sparkSession
    corpus = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), "text")
    counts = stored(word_counts(corpus.filter(~F.col("held"))), "word-counts")
    n_all, v_all = counts.agg(F.sum("n"), F.count("*")).first()
    n_all = n_all or 0
    top = head_of(counts, head_words).toArrow()  # head_words rows of two longs at most
    order = np.lexsort((top.column("word").to_numpy(), -top.column("n").to_numpy()))
    head_counts = top.column("n").to_numpy()[order].astype(np.float64)
    hashes = top.column("word").to_numpy()[order].view(np.uint64)
    by_hash = np.argsort(hashes)
    head = spark.sparkContext.broadcast((hashes[by_hash], by_hash.astype(np.uint32)))
    table = stored(corpus.mapInArrow(
        _ranker(head), "row long, doc_id long, held boolean, n_tokens long, ranks binary, beyond binary, block int, payload binary"), "ranks")
    texts = table.filter(F.col("row").isNotNull())
    near = _gathered(table.filter(F.col("row").isNull()).select("block", "payload"), CLUSTERED * ANCHORS, "i4")
    end_rank = np.flatnonzero(hashes == np.uint64(END))
    class_of = word_classes(head_counts, near, int(end_rank[0]) if len(end_rank) else -1)

    # words in their class; unknown words share one event of the last class
    n_classes = int(class_of.max()) + 1
    head_total = head_counts.sum()
    mass = np.bincount(class_of[:-1], head_counts, n_classes)
    size = np.bincount(class_of[:-1], minlength=n_classes).astype(float)
    mass[-1] += n_all - head_total
    size[-1] += v_all - len(head_counts) + 1
    in_class = np.zeros(len(class_of))
    in_class[:-1] = np.log10((head_counts + 1) / (mass + size)[class_of[:-1]])
    base = np.zeros(len(class_of))
    base[:-1] = np.log10((head_counts + 1) / (n_all + v_all + 1))
    bias = np.log((mass + 1) / (mass.sum() + n_classes)).astype(np.float32)
    weights = np.zeros((ROWS, n_classes), np.float32)
    training = texts.filter(~F.col("held"))
    tasks = max(1, int(n_all // rounds // TASK_TOKENS) + 1)
    for r in range(rounds if n_all else 0):
        slice_of = training.filter(F.pmod(F.xxhash64("row"), F.lit(rounds)) == r).select("ranks")
        model = spark.sparkContext.broadcast((weights, bias, class_of))
        sent = slice_of.coalesce(max(tasks, spark.sparkContext.defaultParallelism)).mapInArrow(
            _gradient(model), "block int, payload binary")
        seen, expected = _gathered(sent, 2 * ROWS * n_classes, "f4").reshape(2, ROWS, n_classes)
        prior = SMOOTH * np.exp(bias.astype(float)) + 1e-3
        weights = (weights + RATE * np.log((seen + prior) / (expected + prior))).astype(np.float32)
        model.unpersist()

    model = spark.sparkContext.broadcast((weights, bias, class_of, in_class, base))
    scored = stored(texts.select("row", "doc_id", "held", "n_tokens", "ranks", "beyond").mapInArrow(
        _scorer(model), "row long, doc_id long, held boolean, n_tokens long, score double, base double, n_head long, beyond binary"),
        "scores")
    rare = (scored.filter(F.octet_length("beyond") > 0).select("row", "beyond")
            .mapInArrow(_beyond, "row long, word long, times long"))
    least = float(head_counts.min()) if len(head_counts) else 0.0
    counted = rare.join(counts.filter(F.col("n") <= least), "word", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    extra = counted.groupBy("row").agg(
        F.sum(F.col("times") * F.log10((n + 1) / F.lit(float(n_all + v_all + 1)))).alias("more_base"),
        F.sum(F.col("times") * F.log10((n + 1) / F.lit(float(mass[-1] + size[-1])))).alias("more"),
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.drop("beyond").join(extra, "row", "left").select(
        "doc_id", F.col("held").alias("held_out"), "n_tokens",
        (F.col("n_head") + zero("more_known")).cast("long").alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base")).alias("base_score"), (F.col("score") + zero("more")).alias("score"))
