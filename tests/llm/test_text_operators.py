"""Near duplicates, suffix arrays, decontamination, packing and the language model against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from feedspark.llm import decontaminate, maxent_lm, minhash_dedup, packing, suffix_dedup
from feedspark.llm.components import components
from feedspark.llm.tables import WordHash

from .helpers import awkward, documents, prose, rows, with_clashes


# --- near duplicates ---

def shingles(text, words=4):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < words else [tuple(w[i:i + words]) for i in range(len(w) - words + 1)])


def brute_components(docs, words=4):
    parent = {i: i for i, _ in docs if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(set)
    for i, t in docs:
        if i is not None:
            for s in shingles(t, words):
                held[s].add((i, t))
    common = Counter(p for v in held.values() for p in combinations(sorted(v, key=repr), 2))
    for ((a, x), (b, y)), n in common.items():
        if 5 * n >= 4 * (len(shingles(x, words)) + len(shingles(y, words)) - n):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return {i: find(i) for i in parent}


def edited(text, n, seed):
    draw, words = random.Random(seed), text.split()
    for _ in range(n):
        words[draw.randrange(len(words))] = f"edit{draw.random()}"
    return " ".join(words)


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 400)] + [(500, 500), (600, 601), (601, 600), (None, 3), (41, 20)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(42)}, **{k: 100 for k in range(100, 400)}, 600: 600, 601: 600}


def test_near_duplicates_against_brute_force(spark):
    base, chain = prose(1, 150), prose(2, 300)
    docs = [(10 + k, edited(base, k % 9, k)) for k in range(60)]  # a crowd around the threshold
    docs += [(200 + k, " ".join(chain.split()[: 300 - 18 * k])) for k in range(10)]  # neighbours linked, ends not
    docs += [(300 + k, prose(50 + k, 80)) for k in range(80)]
    docs += [(400, "a b c"), (401, "A B C"), (402, "a b"), (403, None), (404, ""), (405, base.upper()), (None, base), (10, docs[0][1])]
    got = minhash_dedup.near_duplicate_components(with_clashes(documents(spark, docs)))
    expected = brute_components(docs)
    assert rows(got, *got.columns) == sorted(
        ((i, len(shingles(t)), expected.get(i), i is None or expected[i] == i) for i, t in docs), key=repr)


def test_near_duplicates_on_awkward_rows(spark):
    docs = with_clashes(awkward(spark))
    kept = minhash_dedup.keep_one_of_each(docs, words=5)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    assert minhash_dedup.near_duplicate_components(docs.limit(0)).count() == 0


def test_signatures_estimate_the_similarity():
    hashes = WordHash()
    a = minhash_dedup.shingle_set(hashes.of(prose(1, 1000, 4000)))
    b = np.unique(np.append(a[: len(a) * 9 // 10], minhash_dedup.shingle_set(hashes.of(prose(2, 90, 4000)))))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((minhash_dedup.signature(a) == minhash_dedup.signature(b)).mean() - true) < 0.15
    assert len(set(minhash_dedup.signature(a[:1]).tolist())) == 1  # one element fills all bins


# --- suffix arrays ---

@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=400).map(lambda b: bytes(x % 3 for x in b)), st.sampled_from([8, 10, 50]))
def test_suffix_array_and_common_prefixes(text, depth):
    data = np.frombuffer(text, np.uint8)
    sa = suffix_dedup.suffix_array(data)
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    lcp = suffix_dedup.common_prefixes(data, sa, depth)
    for k in range(1, len(sa)):
        a, b = text[sa[k]:], text[sa[k - 1]:]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == min(n, depth)


def brute_removal(docs, length):
    order = lambda i: math.inf if i is None else i
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            first[w] = min(first.get(w, math.inf), order(i))
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < order(i):
                gone[p:p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not h for g, h in zip(gone, b"\0" + bytes(gone)))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_removal_against_brute_force(spark):
    draw = random.Random(4)
    pool = [prose(k, 25) for k in range(8)]
    docs = [(k, " ".join(draw.choice(pool) if draw.random() < 0.4 else prose(100 + 10 * k + j, draw.randint(1, 30)) for j in range(4))) for k in range(80)]
    docs += [(90, "x" * 49), (91, "x" * 50), (92, "x" * 51), (93, "x" * 500), (94, None), (95, ""), (None, pool[0]), (None, pool[0]),
             (5, docs[5][1]), (6, pool[1]), (96, "ü" * 60), (97, "\0" * 80 + pool[2]), (98, "\0" * 90)]
    got = suffix_dedup.remove_repeats(with_clashes(documents(spark, docs)).repartition(5))
    assert rows(got, *got.columns) == brute_removal(docs, 50)


def test_removal_in_many_small_shards(spark, monkeypatch):
    draw = random.Random(5)
    docs = [(k, "".join(draw.choices("ab", k=draw.randint(0, 120)))) for k in range(40)]
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 100)
    got = suffix_dedup.remove_repeats(documents(spark, docs), length=12, gram=5)
    assert rows(got, *got.columns) == brute_removal(docs, 12)
    strings = sorted({t.encode() for _, t in docs if len(t) >= 12})
    orders = np.array([draw.randrange(9) for _ in strings])
    assert suffix_dedup.earlier_windows(strings, orders, 12, 100) == suffix_dedup.earlier_windows(strings, orders, 12, 10 ** 6)


def test_removal_edges(spark):
    docs = with_clashes(awkward(spark))
    got = suffix_dedup.remove_repeats(docs)
    assert rows(got, *got.columns) == brute_removal([(r["doc_id"], r["text"]) for r in docs.collect()], 50)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0
    one = suffix_dedup.remove_repeats(documents(spark, [(1, "y" * 60), (2, "ab" + "y" * 55 + "z")]), with_bytes=True)
    assert {r["doc_id"]: bytes(r["kept"]) for r in one.collect()} == {1: b"y" * 60, 2: b"abz"}


def test_earlier_windows_by_groups_and_shards(monkeypatch):
    draw = random.Random(6)
    ends = [bytes(draw.choices(b"abcd", k=40)) for _ in range(4)]
    # shared passages, each time with other text behind, as the strings of a minimizer are
    made = sorted({(g, ends[g] + bytes(draw.choices(b"xy", k=draw.randint(0, 20)))) for g in draw.choices(range(4), [8, 1, 1, 1], k=300)})
    groups, strings = np.array([g for g, _ in made]), [s for _, s in made]
    orders = np.array([draw.randrange(60) for _ in strings])
    brute = []
    for s, o, g in zip(strings, orders, groups):
        earlier = {t[a:a + 25] for t, p, h in zip(strings, orders, groups) if p < o and h == g for a in range(len(t) - 24)}
        spans = []
        for a in range(len(s) - 24):
            if s[a:a + 25] in earlier:
                if spans and spans[-1][1] == a:
                    spans[-1] = (spans[-1][0], a + 1)
                else:
                    spans.append((a, a + 1))
        brute.append(spans or None)
    for limit in (100, 2000, 10 ** 6):
        assert suffix_dedup.earlier_windows(strings, orders, 25, limit, groups) == brute
    # different windows of one hash
    monkeypatch.setattr(suffix_dedup, "_gram_hashes", lambda a, n: np.zeros(len(a), np.uint64))
    assert suffix_dedup.earlier_windows(strings, orders, 25, 100, groups) == brute


def test_merging_shards_grows_with_their_number(monkeypatch):
    draw = random.Random(7)
    end = bytes(draw.choices(b"abcd", k=40))
    strings = [end + bytes(draw.choices(b"abcdefgh", k=20)) for _ in range(400)]
    looked_up, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *rest, **kw: looked_up.append(np.size(v)) or search(a, v, *rest, **kw))
    suffix_dedup.earlier_windows(strings, np.arange(400), 25, 200)
    shards = sum(map(len, strings)) // 200
    assert shards > 100 and sum(looked_up) < 20 * sum(map(len, strings))


def test_buckets_of_minimizers_are_of_about_one_size():
    draw = random.Random(8)
    text = bytes(draw.choices(b"abcdefghijklmnopqrstuvwxyz ", k=400_000))
    m, _, _, n = suffix_dedup.runs_of([text], 50, 20)
    edges = suffix_dedup.bucket_edges(40, 50, 20)
    held = np.bincount(suffix_dedup._bucket(m, edges), n + 49, 40)
    assert len(held) == 40 and held.max() < 1.3 * held.mean() and held.min() > 0.7 * held.mean()


def test_records_of_the_lister_grow_with_the_text(spark, monkeypatch):
    rows_listed = []
    lister = suffix_dedup._lister

    def counted(edges, length, gram, shard_bytes):
        rows_listed.append((len(edges) + 1, shard_bytes))
        return lister(edges, length, gram, shard_bytes)

    monkeypatch.setattr(suffix_dedup, "_lister", counted)
    monkeypatch.setattr(suffix_dedup, "FIXED_BYTES", 100)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 100)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 100)
    pool = [prose(k, 25) for k in range(8)]
    made = []
    for size in (20, 80):
        draw = random.Random(9)
        docs = [(k, " ".join(draw.choices(pool, k=3)) + prose(k + 50, 30)) for k in range(size)]
        got = suffix_dedup.remove_repeats(documents(spark, docs))
        assert rows(got, *got.columns) == brute_removal(docs, 50)
        made.append(sum(len(t) for _, t in docs) / rows_listed[-1][1] * rows_listed[-1][0] / size)
    assert made[1] < 1.5 * made[0]  # shards x buckets a document


# --- decontamination ---

def brute_alignment(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_scores_equal_plain_dynamic_programming():
    draw = random.Random(6)
    pairs = [([draw.randrange(1, 6) for _ in range(draw.randint(1, 30))], [draw.randrange(1, 6) for _ in range(draw.randint(1, 40))]) for _ in range(60)]
    score, _ = decontaminate.best_alignments(*([np.array(p[k], np.uint64) for p in pairs] for k in (0, 1)))
    assert score.tolist() == [brute_alignment(*p) for p in pairs]


ITEMS = "item_id long, text string"


def test_leaks_are_found_and_clean_documents_stay(spark):
    items = [(k, prose(1000 + k, 15 + k, 3000).replace(" ", ", ", 2)) for k in range(30)] + [(50, None), (51, ""), (52, "solo"), (53, "two words")]
    docs, leaks = [], {}
    for k in range(150):
        text = prose(k, 200, 3000)
        if k % 3 == 0:
            item = k % 30
            text = f"{prose(k, 50, 3000)} {edited(items[item][1], (k // 30) % 4, k).upper()} {text}"
            leaks[k] = item
        docs.append((k, text))
    benchmark = spark.createDataFrame(items, ITEMS)
    for block in (10 ** 6, 500):  # in one block and in many
        got = decontaminate.benchmark_matches(with_clashes(documents(spark, docs)), benchmark, block_chars=block).collect()
        assert {r["doc_id"]: r["item_id"] for r in got} == leaks and len(got) == len(leaks)
        exact = {r["doc_id"]: r for r in got}[0]
        assert (exact["score"], exact["doc_start"], exact["doc_end"]) == (1.0, 50, 65)
    left = decontaminate.clean_documents(with_clashes(documents(spark, docs)), benchmark)
    assert sorted(r["doc_id"] for r in left.collect()) == [k for k in range(150) if k % 3]


def test_decontamination_edges(spark):
    docs, none = with_clashes(awkward(spark)), spark.createDataFrame([], ITEMS)
    whole = spark.createDataFrame([(1, prose(1, 120)), (1, prose(1, 120)), (2, "one"), (None, prose(2, 20_000)[:4000])], ITEMS)
    got = decontaminate.benchmark_matches(docs, whole)
    assert rows(got, "doc_id", "item_id") == sorted([(i, 1) for i in (1, 1, 2, 2, 2, 2, None, None)] + [(7, 2), (6, None)], key=repr)
    assert decontaminate.benchmark_matches(docs, none).count() == 0
    assert decontaminate.clean_documents(docs, none).count() == docs.count()
    assert decontaminate.benchmark_matches(docs.limit(0), whole).count() == 0
    assert decontaminate.clean_documents(docs, whole).columns == docs.columns


def aligned(items, texts):
    """(doc_id, item_id) of the matches, by alignment of every document with every item."""
    def ids(t):
        return decontaminate.BareWordHash().of(t).tolist()
    return sorted((d, k) for d, t in texts for k, i in items if brute_alignment(ids(i), ids(t)) >= 1.2 * len(ids(i)))


def found(spark, items, texts):
    got = decontaminate.benchmark_matches(documents(spark, texts), spark.createDataFrame(items, ITEMS)).collect()
    return sorted({(r["doc_id"], r["item_id"]) for r in got})


def test_every_edited_copy_is_found_as_by_full_alignment(spark):
    draw = random.Random(9)
    items = [(k, prose(500 + k, (1, 2, 5, 6, 15, 22, 30, 45)[k % 8], 400)) for k in range(24)]
    texts = [(0, "")]
    for k, item in items:
        words = item.split()
        spaced = [w for j, v in enumerate(words) for w in ([v, "zzgap"] if j % 2 else [v])]  # no three words in a row
        every = [w if j % 4 != 3 else "zzother" for j, w in enumerate(words)]  # the words 4, 8, 12 ... replaced
        for copy in (spaced, every, [w for w in words if draw.random() > 0.15], [w if draw.random() > 0.2 else "zzx" for w in words]):
            texts.append((len(texts), f"{prose(len(texts), 60, 400)} {' '.join(copy)} {prose(900 + len(texts), 60, 400)}"))
    texts += [(len(texts) + k, prose(3000 + k, 150, 60)) for k in range(40)]  # many frequent words
    want = aligned(items, texts)
    assert found(spark, items, texts) == want
    assert {(1 + 4 * k + c, k) for k, _ in items if k % 8 >= 4 for c in (0, 1)} <= set(want)


def test_a_copy_with_long_insertions_is_one_passage(spark):
    words = prose(77, 30, 3000).split()
    texts = [(d, " ".join([*prose(d, 40, 3000).split(), *words[:cut], *["zzin"] * 18, *words[cut:], "zzend"]))
             for d, cut in enumerate((5, 15, 25))]
    got = decontaminate.benchmark_matches(documents(spark, texts), spark.createDataFrame([(1, " ".join(words))], ITEMS))
    assert rows(got, "doc_id", "item_id", "score", "doc_start", "doc_end") == [
        (0, 1, 50 / 60, 63, 88), (1, 1, 0.7, 40, 88), (2, 1, 50 / 60, 40, 65)]


def test_every_copy_in_a_document_is_a_passage(spark):
    item = prose(78, 20, 3000)
    texts = [(1, " ".join([item, item, prose(5, 8, 3000), item, prose(6, 300, 3000), item]))]
    got = decontaminate.benchmark_matches(documents(spark, texts), spark.createDataFrame([(1, item)], ITEMS))
    assert sorted((r["score"], r["doc_start"], r["doc_end"]) for r in got.collect()) == [(1.0, s, s + 20) for s in (0, 20, 48, 368)]


def test_words_of_many_texts_are_numbered_at_once():
    draw = random.Random(3)
    letters = ["a", "b", "Z", ".", ",", '"', "-", "é", "漢", "\x00", "\x1c", "\x85", "\xa0", "~", "1"]
    pool = ["".join(draw.choices(letters, k=draw.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 24, 40]))) for _ in range(600)]
    pool += ["-" * 30, "." * 9 + "a" + "." * 9, "x" * 20 + "y" + "x" * 20, "x" * 20 + "z" + "x" * 20, "x" * 41]
    texts = ["".join(draw.choice(pool) + draw.choice([" ", "  ", "\t", "\n", "\x0b", "\x0c", "\r"]) for _ in range(draw.choice([0, 1, 9, 40])))
             for _ in range(300)] + ["", " ", "a", "\n", None]
    words = sorted({decontaminate.bare(w) for t in [*draw.sample(pool, 300), "x" * 20 + "y" + "x" * 20] for w in decontaminate.words_in(t)})
    vocabulary, numbers = decontaminate.Vocabulary(words), {w: k for k, w in enumerate(words, 1)}
    column = pa.array([None if t is None else t.encode() for t in texts], pa.binary())
    for size in (1, 500, 10 ** 6):
        got = []
        for part in decontaminate.text_slices(column, size):
            codes, bounds = vocabulary.of(part)
            assert len(bounds) == len(part) + 1
            got += [codes[lo:hi].tolist() for lo, hi in zip(bounds, bounds[1:])]
        assert got == [[numbers.get(decontaminate.bare(w), 0) for w in decontaminate.words_in(t)] for t in texts]
    assert decontaminate.Vocabulary([]).of([b"a b", b""])[0].tolist() == [0, 0]


def test_passages_stay_within_their_text(spark):
    item = prose(79, 20, 3000)
    words = item.split()
    texts = [(1, " ".join(words[:10])), (2, " ".join(words[10:])), (3, item), (4, ""), (5, " ".join(words[10:])), (6, None), (7, item)]
    got = decontaminate.benchmark_matches(documents(spark, texts).coalesce(1), spark.createDataFrame([(1, item)], ITEMS))
    assert rows(got, "doc_id", "score", "doc_start", "doc_end") == [(3, 1.0, 0, 20), (7, 1.0, 0, 20)]


# --- packing ---

@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 60), st.integers(1, 5000)), max_size=60))
def test_packs_cover_every_token_once_without_padding(lengths):
    sequences = packing.pack(lengths)
    seen = [bytearray(n) for n in lengths]
    for pieces in sequences:
        total = sum(n for _, _, n in pieces)
        assert total <= 4096 and total & (total - 1) == 0
        for k, start, n in pieces:
            assert n > 0 and not any(seen[k][start:start + n]) and start + n <= lengths[k]
            seen[k][start:start + n] = b"\1" * n
    assert all(all(s) for s in seen)


def test_long_tiers_are_filled_from_shorter_ones():
    sequences = packing.pack([3000, 1500, 900, 300, 250, 200])
    assert [sum(p[2] for p in s) for s in sequences][0] == 4096 and sequences[0][0] == (0, 0, 3000)


def test_encoder_equals_the_tokenizer():
    texts = ["<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|> X", "Ångström İstanbul ΣΣ ß", "it's I'LL don't 's. x, y., ,.", "\x1c a\x85b c d\te\r\nf",
             " ́x é ﬁ", "a  b\n\n c", "\U0001F600\U0001F600 ok", "x" * 3000, "", "\x00 \x01", prose(1, 500)]
    for limit in (10 ** 6, 20):
        encoder = packing.Encoder(packing.default_tokenizer(), limit)
        for _ in range(2):
            got = [np.frombuffer(g, "<u4").tolist() for g in encoder([t.encode() for t in texts], 300)]
            assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_remembered_words_of_the_encoder_are_bounded():
    encoder = packing.Encoder(packing.default_tokenizer())
    assert encoder.limit <= 500_000  # about 140 MB; two workers of an executor hold that much each
    encoder.limit = 50
    texts = [" ".join(f"{prose(k, 30, 5000)}, é{k}ß. word{k}" for k in range(20 * j, 20 * j + 20)) for j in range(5)]
    for _ in range(2):
        got = [np.frombuffer(g, "<u4").tolist() for g in encoder([t.encode() for t in texts], 300)]
        assert got == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.known) <= 50


def test_batches_are_encoded_in_short_parts(monkeypatch):
    import pyspark

    taken = []

    class Plain:
        def __call__(self, texts):
            taken.append(len(texts))
            return [b"\1\0\0\0" * len(t or b"") for t in texts]

    monkeypatch.setattr(packing, "shared_encoder", lambda path: Plain())
    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: 0})()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1001), pa.int64()), pa.array([b"abc"] * 1000 + [None], pa.binary())], names=["doc_id", "text"])
    out = pa.Table.from_batches(packing._packer("", packing.TIERS, 500)(iter([batch, batch.slice(0, 0)])))
    assert sum(taken) == 1001 and max(taken) <= 200
    assert sum(out["length"].to_pylist()) == 4001


def test_packed_documents(spark):
    docs = with_clashes(awkward(spark)).repartition(3)
    tokenizer = packing.Encoder(packing.default_tokenizer()).tokenizer
    got = packing.pack_documents(docs, chunk_tokens=500).collect()
    expected = Counter()
    for r in docs.collect():
        ids = np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [packing.END_ID], "<u4")
        expected[r["doc_id"], len(ids)] += len(ids)
        for p in got:
            if (p["doc_id"], p["doc_tokens"]) == (r["doc_id"], len(ids)):
                assert p["ids_crc32"] == zlib.crc32(ids[p["start"]:p["start"] + p["length"]].tobytes())
    found = Counter()
    for p in got:
        found[p["doc_id"], p["doc_tokens"]] += p["length"]
    assert found == expected
    by = defaultdict(list)
    for p in got:
        by[p["sequence_id"]].append((p["offset"], p["length"]))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at & (at - 1) == 0 and at <= 4096
    assert packing.pack_documents(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(docs, tiers=(512, 1000))


# --- language model ---

def test_model_scores(spark):
    draw = random.Random(7)
    languages = [[f"{tag}{k}" for k in range(300)] for tag in "abc"]
    docs = []
    for i in range(600):
        words = draw.choice(languages)
        docs.append((i, " ".join(words[min(299, int(draw.expovariate(0.03)))] for _ in range(draw.randint(0, 60)))))
    docs += [(700, None), (701, ""), (702, "never seen before"), (None, "a1 a2"), (3, "a1 A1 zzz")]
    got = maxent_lm.score_documents(with_clashes(documents(spark, docs)).repartition(3), head_words=500).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter(w for i, t in docs if not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    expected = sorted(((i, held(i), len(tokens(t)), sum(w in counts for w in tokens(t)), n,
                        round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in docs), key=key)
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got), key=key) == expected
    assert all(r["score"] < 0 for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > 1.1 * sum(r["base_score"] for r in out)  # learns the three languages
    assert maxent_lm.score_documents(documents(spark, docs).limit(0)).count() == 0
    alone = maxent_lm.score_documents(documents(spark, [(i, "x y") for i in range(30) if held(i)])).collect()
    assert all((r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0) for r in alone)


def test_class_distribution_sums_to_one():
    rng = np.random.default_rng(1)
    weights, bias = rng.normal(size=(maxent_lm.ROWS, 7)).astype(np.float32), rng.normal(size=7).astype(np.float32)
    rows_ = maxent_lm.features(rng.integers(0, 9000, 500).astype(np.uint32), np.array([0, 1, 120]))
    logs = maxent_lm.class_logs(weights, bias, rows_)
    assert np.exp(logs).sum(1) == pytest.approx(np.ones(500), rel=1e-4)
    target = rng.integers(0, 7, 500)
    assert np.array_equal(maxent_lm.target_logs(weights, bias, rows_, target), logs[np.arange(500), target])
    counts = np.sort(rng.integers(1, 1000, 800))[::-1].astype(float)
    near = rng.integers(0, 4, maxent_lm.CLUSTERED * maxent_lm.ANCHORS).astype(float)
    classes = maxent_lm.word_classes(counts, near, 30)
    mass = np.bincount(classes[:-1], counts, classes.max() + 1)
    size = np.bincount(classes[:-1], minlength=classes.max() + 1)
    inside = (counts + 1) / (mass + size)[classes[:-1]]
    assert np.bincount(classes[:-1], inside)[: classes.max()] == pytest.approx(1)


def test_gradient_counts_equal_a_plain_sum(monkeypatch):
    """Observed and expected counts of a task against one token, feature and class at a time."""
    monkeypatch.setattr(maxent_lm, "BATCH_TOKENS", 40)
    monkeypatch.setattr(maxent_lm, "CACHED", 16)
    rng = np.random.default_rng(4)
    c, texts = 5, [rng.integers(0, 30, n).astype(np.uint32) for n in (1, 90, 25, 3)]
    weights, bias = rng.normal(size=(maxent_lm.ROWS, c)).astype(np.float32), rng.normal(size=c).astype(np.float32)
    class_of = rng.integers(0, c, 31)
    packed = [zstandard.ZstdCompressor().compress(t.tobytes()) for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["ranks"])
    size = 2 * maxent_lm.ROWS * c
    got = np.zeros(size)
    for sent in maxent_lm._gradient(SimpleNamespace(value=(weights, bias, class_of)))(iter([batch])):
        for k, payload in zip(sent.column(0).to_pylist(), sent.column(1).to_pylist(), strict=True):
            part = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), "f4")
            got[k * size // maxent_lm.BLOCKS:(k + 1) * size // maxent_lm.BLOCKS] = part
    seen, expected = np.zeros((maxent_lm.ROWS, c)), np.zeros((maxent_lm.ROWS, c))
    for t in texts:
        found = maxent_lm.features(t, np.array([0]))
        for i, word in enumerate(t):
            z = sum(weights[f[i]] for f in found) + bias
            for f in found:
                seen[f[i], class_of[word]] += 1
                expected[f[i]] += np.exp(z) / np.exp(z).sum()
    assert np.array_equal(got[:size // 2].reshape(-1, c), seen)
    assert got[size // 2:].reshape(-1, c) == pytest.approx(expected, rel=1e-4, abs=1e-5)


def test_a_large_vocabulary_has_all_classes():
    rng = np.random.default_rng(3)
    counts = np.sort(rng.zipf(1.3, maxent_lm.CLUSTERED + 5000).clip(max=10 ** 6))[::-1].astype(float)
    near = rng.integers(0, 4, maxent_lm.CLUSTERED * maxent_lm.ANCHORS).astype(float)
    classes = maxent_lm.word_classes(counts, near, 30)
    assert classes.max() + 1 > 40  # 24 single words, the text end, 3 for each of 8 clusters and the rest, unknown words
