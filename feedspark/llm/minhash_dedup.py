"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidate edges.

One hash per shingle fills ``BINS`` bins (the top bits choose the bin, the smallest hash stays); empty bins
are filled by optimal densification, each from a bin that a fixed pseudo-random walk finds. ``ROWS`` bins
make a band, a band value is a bucket. Equal sets are joined first, so buckets hold different sets only.

In a bucket only a centre is paired with the other members, never all pairs: the member with the most company
over all its buckets, as a rule the original of a group of edited copies. Links are confirmed on the full sets.

A bucket whose members are not in one component then may hide links that miss the centre. Its members are all
compared with one centre c and met again by D(x), the shingles in which x and c differ. If x and y are similar,
|x ^ y| = |D(x)| + |D(y)| - 2 |D(x) & D(y)| is at most (|x| + |y|) / 9, while |D(x)| > (|x| + |c|) / 9 for an x that is not
linked to c. So two documents, not both linked to c, are similar only if they share a known part of their
differences, and so have one of the rarest of them in common (prefix filter). With N(x) the shingles that x has and c
has not, documents with 4 |N(x)| > |x| must share some of N, too, which leaves out what all copies lack or have:
  use 0: one of the two has 4 |N| > |x|: meet by the rarest of N, (N + |x| / 4) / 2 + 1 of them, the other by N / 2;
  use 1: neither, both not linked to c: by the rarest of D, (|D| + (|x| - |c|) / 9) / 2 of them;
  use 2: neither, one linked to c: as before, the one that is not by (|D| + (|x| + |c|) / 9) / 2 + 1.
These groups are small as a rule. Each is worked off with one centre first. What is left of groups of up to ``FEW``
members is worked off with 4, 16 ... centres until the members are in one component or all of them were centres. What
is left of larger ones (many copies edited to just about the threshold, whose differences do not tell them apart) is
cut into tiles, and every two tiles are compared as a whole: the members' differences from their common centre as
rows of a matrix, one product for all overlaps, of which only a spanning forest of the links leaves the task. So within
the buckets no link between components is lost, no bucket is capped, and no list of a large group's pairs is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .tables import _ODD, WordHash, mix, sized, stored, window_hashes

WORDS, NUMERATOR, DENOMINATOR = 4, 4, 5  # words of a shingle; similarity of at least 4/5
BINS, ROWS = 128, 4
#: Members of a group that is worked off by further centres; members of a tile; columns of a product.
FEW, TILE_ROWS, COLUMNS = 32, 256, 8192
_WALK = mix(np.arange(BINS * 1024, dtype=np.uint64) + np.uint64(99)).reshape(BINS, 1024) % np.uint64(BINS)
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(57)


def shingle_set(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingles; a shorter text is one shingle, no words give none."""
    if 0 < len(hashes) < words:
        return window_hashes(hashes, len(hashes)) ^ np.uint64(len(hashes))
    return np.unique(window_hashes(hashes, words))


def signature(shingles: np.ndarray) -> np.ndarray:
    """One-permutation signature of a non-empty sorted set, densified."""
    first = np.searchsorted(shingles, _EDGES)
    filled = np.diff(first, append=len(shingles)) > 0
    out = shingles[np.minimum(first, len(shingles) - 1)]
    if not filled.all():
        empty = np.flatnonzero(~filled)
        for reach in (32, 1024):
            steps = filled[_WALK[empty, :reach]]
            if steps.any(1).all():
                break
        source = _WALK[empty, steps.argmax(1)].astype(np.int64)
        lost = ~steps.any(1)
        if lost.any():  # the walk missed every filled bin: the next one in a circle
            at = np.flatnonzero(filled)
            source[lost] = at[np.searchsorted(at, empty[lost]) % len(at)]
        out[empty] = out[source]
    return out


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    table = mix(sig).reshape(-1, rows)
    key = np.arange(len(table), dtype=np.uint64) * _ODD[40]
    for k in range(rows):
        key = key + table[:, k] * _ODD[k]
    return mix(key).view(np.int64)


def _sketcher(words: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_hash = WordHash()
        for batch in batches:
            rows = []
            for text in batch.column(1):
                s = shingle_set(word_hash.of(text.as_py()), words)
                if len(s):
                    rows.append((len(s), int(mix(s).sum(dtype=np.uint64).view(np.int64)),
                                 int(np.bitwise_xor.reduce(mix(s * _ODD[7])).view(np.int64)), band_keys(signature(s))))
                else:
                    rows.append((0, 0, 0, None))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "s1", "s2", "bands"])
    return sketch


def sketches(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, s1, s2 (a 128-bit hash of the whole set) and the band keys of every row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _sketcher(words), "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>")


def _set_writer(words: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_hash = WordHash()
        for batch in batches:
            sets = [shingle_set(word_hash.of(t.as_py()), words).tobytes() for t in batch.column(1)]
            for at in range(0, len(sets), 500):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 500), pa.array(sets[at:at + 500], pa.binary())], names=["doc_id", "shingles"])
    return write


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        inter = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            a, b = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
            a, b = (a, b) if len(a) < len(b) else (b, a)
            at = np.searchsorted(b, a)
            inter.append((int((b[np.minimum(at, len(b) - 1)] == a).sum()), len(a) + len(b)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([i for i, _ in inter], pa.int64()),
             pa.array([n - i for i, n in inter], pa.int64())], names=["a", "b", "inter", "union"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets overlap enough."""
    both = (pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
            .join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a"))
    scored = both.select("a", "b", "sa", "sb").mapInArrow(_overlaps, "a long, b long, inter long, `union` long")
    return scored.filter(DENOMINATOR * F.col("inter") >= NUMERATOR * F.col("union")).select("a", "b").distinct()


class _State:
    """Pairs that were compared, and the component of every document with company."""

    def __init__(self, sets: DataFrame, docs: DataFrame):
        self.sets, self.nodes = sets, docs.count()
        self.label = docs.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("component"))
        self.checked: DataFrame | None = None

    def star(self, groups: DataFrame, centres: int) -> DataFrame:
        """Pairs the first ``centres`` members of every group with those of other components; the centres."""
        n = groups.count()
        order = Window.partitionBy("bucket").orderBy(F.col("company").desc(), "doc_id")
        chosen = stored(sized(groups.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= centres)
                              .select("bucket", F.col("doc_id").alias("centre"), F.col("company").alias("weight")), n), "centres")
        known = sized(groups.join(self.label.withColumnRenamed("node", "doc_id"), "doc_id"), n)
        centred = sized(chosen.join(self.label.select(F.col("node").alias("centre"), F.col("component").alias("other")), "centre"), n)
        pairs = sized((known.join(centred, "bucket").filter("component <> other")
                       .select(F.least("centre", "doc_id").alias("a"), F.greatest("centre", "doc_id").alias("b"))), n)
        self.compare(pairs, n)
        return chosen

    def compare(self, pairs: DataFrame, n: int) -> None:
        """Compares pairs (a < b), about ``n``, that were not compared yet, and joins the components of similar ones."""
        if self.checked is not None:
            pairs = sized(pairs.distinct().join(self.checked, ["a", "b"], "left_anti"), n)
        pairs = stored(sized(pairs.distinct(), n), "pairs")
        self.checked = pairs if self.checked is None else self.checked.union(pairs)
        self.join(stored(sized(confirmed(pairs, self.sets), n), "links"), n)

    def join(self, new: DataFrame, n: int) -> None:
        """Joins the components of the links (a, b), which are stored."""
        if not new.isEmpty():
            # only components that new links join change
            named = self.label.select(F.col("node").alias("a"), F.col("component").alias("x"))
            joined = sized(new.join(named, "a"), n).join(named.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
            parts = components(joined).withColumnRenamed("component", "least")
            self.label = stored(sized(
                self.label.join(parts.withColumnRenamed("node", "component"), "component", "left")
                .select("node", F.coalesce("least", "component").alias("component")), self.nodes), "labels")

    def unresolved(self, groups: DataFrame) -> DataFrame:
        """The groups with members in different components."""
        n = groups.count()
        known = sized(groups.join(self.label.withColumnRenamed("node", "doc_id"), "doc_id"), n)
        split = known.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y")
        return stored(sized(groups.join(sized(split.select("bucket"), n), "bucket", "left_semi"), n), "groups")

    def settle(self, groups: DataFrame, differences: DataFrame) -> None:
        """Works groups off: a centre that met every member leaves, one component ends a group."""
        groups, centres = self.unresolved(groups), 1
        while not groups.isEmpty():
            chosen = self.star(groups, centres)
            left = chosen.select("bucket", F.col("centre").alias("doc_id"))
            groups, centres = self.unresolved(stored(groups.join(left, ["bucket", "doc_id"], "left_anti"), "groups")), centres * 4
            if centres == 4 and not groups.isEmpty():
                sizes = groups.groupBy("bucket").agg(F.count("*").alias("size"))
                large = sizes.filter(F.col("size") > FEW)
                self.compare_tiles(groups.join(large, "bucket"), differences)
                groups = self.unresolved(stored(groups.join(large.select("bucket"), "bucket", "left_anti"), "groups"))

    def compare_tiles(self, groups: DataFrame, differences: DataFrame) -> None:
        """Compares all members of each group, tile by tile."""
        n = groups.count()
        if not n:
            return
        # groups with the same members are one
        alike = groups.groupBy("bucket", "of", "size").agg(F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("members"))
        one = alike.groupBy("of", "size", "members").agg(F.min("bucket").alias("bucket")).select("bucket")
        tiles = F.ceil(F.col("size") / TILE_ROWS).cast("int")
        dealt = (groups.join(one, "bucket", "left_semi").select("bucket", "doc_id", "of", tiles.alias("tiles"))
                 .withColumn("tile", F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int")))
        filled = (dealt.join(differences.select(F.col("centre").alias("of"), "doc_id", "n", "diff"), ["of", "doc_id"])
                  .groupBy("bucket", "tiles", "tile").agg(F.collect_list(F.struct("doc_id", "n", "diff")).alias("rows")))
        filled = stored(filled, "tiles")
        met = filled.select("bucket", "tile", "rows", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("with"))
        pairs = met.groupBy("bucket", F.least("tile", "with").alias("x"), F.greatest("tile", "with").alias("y")).agg(
            F.collect_list(F.struct("tile", "rows")).alias("sides"))
        links = pairs.select("sides").mapInArrow(_tile_links, "a long, b long").distinct()
        self.join(stored(sized(links, n), "links"), n)


def similar(a: list[dict], b: list[dict]) -> np.ndarray:
    """Which of the documents (n shingles, differences from one centre) are similar: a matrix, a by b.

    |x ^ y| = |D(x)| + |D(y)| - 2 |D(x) & D(y)|, and 5 |x & y| >= 4 |x | y| is 9 |x ^ y| <= |x| + |y|.
    """
    da, db = ([np.frombuffer(r["diff"], np.int64) for r in side] for side in (a, b))
    shared = np.intersect1d(np.concatenate(da), np.concatenate(db))
    overlap = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, len(shared), COLUMNS):
        some = shared[at:at + COLUMNS]
        sides = []
        for d in (da, db):
            m = np.zeros((len(d), len(some)), np.float32)
            for k, x in enumerate(d):
                place = np.searchsorted(some, x)
                place[place == len(some)] = 0
                m[k, place[some[place] == x]] = 1
            sides.append(m)
        overlap += sides[0] @ sides[1].T
    na, nb = (np.array([r["n"] for r in side], np.int64) for side in (a, b))
    apart = np.array([len(x) for x in da])[:, None] + np.array([len(x) for x in db])[None, :] - 2 * overlap.astype(np.int64)
    return (2 * DENOMINATOR - 1) * apart <= na[:, None] + nb[None, :]


def _tile_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links between two tiles, or inside one."""
    for batch in batches:
        for sides in batch.column(0).to_pylist():
            a, b = sides[0]["rows"], sides[-1]["rows"]
            near, out = similar(a, b), []
            ids = [r["doc_id"] for r in a] + ([r["doc_id"] for r in b] if len(sides) > 1 else [])
            label = np.arange(len(ids))
            for i in range(len(a)):
                others = np.flatnonzero(near[i]) + (len(a) if len(sides) > 1 else 0)
                apart, first = np.unique(label[others], return_index=True)
                apart, first = apart[apart != label[i]], first[apart != label[i]]
                out += [(min(ids[i], ids[j]), max(ids[i], ids[j])) for j in others[first].tolist()]
                label[np.isin(label, apart)] = label[i]
            cols = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])


def _delta(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles in which a document differs from its centre, and how many of them a similar document must meet."""
    names = ["centre", "doc_id", "company", "n", "n_new", "in_new", "in_all", "in_far", "kind", "diff"]
    for batch in batches:
        rows = []
        for centre, doc, weight, own, theirs in zip(*(batch.column(k) for k in range(5)), strict=True):
            x, c = (np.frombuffer(v.as_py(), np.uint64) for v in (own, theirs))
            new, gone = np.setdiff1d(x, c, assume_unique=True), np.setdiff1d(c, x, assume_unique=True)
            a, n, d = len(new) + len(gone), len(x), len(x) - len(c)
            rich = 4 * len(new) > n
            numbers = ((4 * len(new) + n) // 8 + 1 if rich else len(new) - len(new) // 2,
                       0 if rich else a - (9 * a - d) // 18,
                       0 if rich else (9 * a + n + len(c)) // 18 + 1,
                       2 if rich else int(9 * a > n + len(c)))
            keys = mix(np.concatenate([new, ~gone]) + mix(np.array([centre.as_py()], np.int64).view(np.uint64)))
            rows.append((centre.as_py(), doc.as_py(), weight.as_py(), n, len(new), *numbers, keys.tobytes()))
        for at in range(0, len(rows), 500):
            cols = list(zip(*rows[at:at + 500], strict=True))
            types = [pa.int64()] * 4 + [pa.int32()] * 5 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


_DELTA = ("centre long, doc_id long, company long, n long, n_new int, in_new int, in_all int, in_far int, kind int, diff binary")


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per shingle of the differences."""
    names = ["centre", "doc_id", "company", "in_new", "in_all", "in_far", "kind"]
    for batch in batches:
        at = {k: batch.column(batch.schema.get_field_index(k)) for k in (*names, "n_new", "diff")}
        for i in range(batch.num_rows):
            keys = np.frombuffer(at["diff"][i].as_py(), np.int64)
            new = np.arange(len(keys)) < at["n_new"][i].as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), pa.array(new), *(pa.array(np.full(len(keys), at[k][i].as_py()), at[k].type) for k in names)],
                names=["element", "is_new", *names])


_ELEMENTS = ("element long, is_new boolean, centre long, doc_id long, company long, "
             "in_new int, in_all int, in_far int, kind int")


def _differences(state: _State, centres: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (bucket, doc_id, company, of) of members that differ from a common centre ``of`` in the same shingle, and
    the differences (centre, doc_id, n, diff).

    The members of a bucket are all set against one centre: of the centres that any of them met, the one with the
    most company. Those that did not meet it are compared with it first.
    """
    n = groups.count()
    met = sized(groups.join(centres, "bucket"), n)
    primary = met.groupBy("doc_id").agg(F.max(F.struct("weight", (-F.col("centre")).alias("c"))).alias("top"))
    of = stored(sized(groups.join(primary, "doc_id"), n), "primary")
    best = of.groupBy("bucket").agg(F.max("top").alias("best"))
    pairs = (of.join(best, "bucket").select((-F.col("best.c")).alias("centre"), "doc_id", "company", (F.col("best") == F.col("top")).alias("met"))
             .groupBy("centre", "doc_id").agg(F.max("company").alias("company"), F.max("met").alias("met")).filter("centre <> doc_id"))
    pairs = stored(sized(pairs, n), "references")
    state.compare(pairs.filter(~F.col("met")).select(F.least("centre", "doc_id").alias("a"), F.greatest("centre", "doc_id").alias("b")), n)
    both = (pairs.join(state.sets.select("doc_id", F.col("shingles").alias("own")), "doc_id")
            .join(state.sets.select(F.col("doc_id").alias("centre"), F.col("shingles").alias("theirs")), "centre"))
    found = stored(both.select("centre", "doc_id", "company", "own", "theirs").mapInArrow(_delta, _DELTA), "differences")
    rows = stored(found.select("centre", "doc_id", "company", "n_new", "in_new", "in_all", "in_far", "kind", "diff")
                  .mapInArrow(_elements, _ELEMENTS).distinct(), "elements")
    often = rows.groupBy("element").agg(F.count("*").alias("often"))
    by = [F.col("often"), F.col("element")]
    ranked = (rows.join(often, "element")
              .withColumn("place", F.row_number().over(Window.partitionBy("centre", "doc_id").orderBy(*by)))
              .withColumn("place_new", F.row_number().over(Window.partitionBy("centre", "doc_id", "is_new").orderBy(*by)))
              .filter("often > 1"))
    uses = F.filter(F.array(
        F.when(F.col("is_new") & (F.col("place_new") <= F.col("in_new")), F.lit(0)),
        F.when((F.col("kind") == 1) & (F.col("place") <= F.col("in_all")), F.lit(1)),
        F.when(F.col("place") <= F.when(F.col("kind") == 1, F.col("in_far")).otherwise(F.col("in_all")), F.lit(2))),
        lambda u: u.isNotNull())
    dealt = stored(ranked.select(F.explode(uses).alias("use"), "element", "doc_id", "company", "kind", "centre")
                   .select(F.xxhash64("use", "element").alias("bucket"), "use", "doc_id", "company", "kind", F.col("centre").alias("of")), "dealt")
    worth = dealt.groupBy("bucket", "use").agg(F.count("*").alias("n"), F.min("kind").alias("low"), F.max("kind").alias("high")).filter(
        (F.col("n") > 1) & F.when(F.col("use") == 0, F.col("high") == 2).when(F.col("use") == 2, F.col("low") < F.col("high")).otherwise(True))
    return stored(dealt.join(worth.select("bucket"), "bucket", "left_semi").select("bucket", "doc_id", "company", "of").distinct(), "groups"), found


def near_duplicate_components(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept per row of ``docs``.

    Rows that repeat an id are one document with several texts: linked if any of them is. NULL ids and
    texts without words are linked with nothing and kept; a NULL id has a NULL component. Empty input gives
    an empty result; columns other than doc_id and text are not looked at.
    """
    table = stored(sketches(docs, words), "sketches")
    linkable = table.filter(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    key = ["n_shingles", "s1", "s2"]
    classes = linkable.groupBy(*key).agg(F.min("doc_id").alias("rep"))
    members = stored(linkable.select("doc_id", *key).join(classes, key).select("doc_id", "rep").distinct(), "members")

    # a row of a class's first document stands for the class; equal sets of one id fall together below
    firsts = linkable.join(classes.select(*key, F.col("rep").alias("doc_id")), [*key, "doc_id"], "left_semi")
    buckets = firsts.select("doc_id", F.explode("bands").alias("bucket")).distinct()
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    full = stored(buckets.join(shared, "bucket"), "buckets")
    company = full.groupBy("doc_id").agg(F.sum("size").alias("company"))
    left = stored(full.select("bucket", "doc_id").join(company, "doc_id"), "buckets")
    met = stored(company.select("doc_id"), "company")
    texts = (docs.select(F.col("doc_id").cast("long"), "text")
             .join(met.hint("shuffle_hash"), "doc_id", "left_semi"))
    sets = stored(texts.mapInArrow(_set_writer(words), "doc_id long, shingles binary").filter("length(shingles) > 0"), "sets")

    # ids that stand for several classes or follow another one are linked from the start
    links = members.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b")
    state = _State(sets, met)
    first = state.star(left, 1)
    mixed = state.unresolved(left)
    if not mixed.isEmpty():
        state.settle(*_differences(state, first, mixed))
    # labels are stars already: with the copies of each set they make the whole graph
    whole = components(links.union(state.label.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    return (table.select("doc_id", "n_shingles")
            .join(whole.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its component, all columns as they are."""
    gone = near_duplicate_components(docs, **options).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
