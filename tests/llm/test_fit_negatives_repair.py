"""Best-fit packing, hard negatives and conversation repair against brute force and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedspark.llm import best_fit, hard_negatives, turn_repair

from .helpers import DOCS, awkward, documents, prose, rows, with_clashes

# ---- best fit ------------------------------------------------------------------------------------------------------


def fewest(sizes, capacity):
    """The least number of bins, by trying everything."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def place(at, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if at == len(sizes):
            best = len(gaps)
            return
        for k in {g: k for k, g in enumerate(gaps) if g >= sizes[at]}.values():
            place(at + 1, gaps[:k] + [gaps[k] - sizes[at]] + gaps[k + 1:])
        place(at + 1, [*gaps, capacity - sizes[at]])

    place(0, [])
    return best


def test_local_search_never_worse_and_close_to_the_fewest():
    draw = random.Random(5)
    extra = 0
    for _ in range(60):
        sizes = [draw.randint(*draw.choice([(1, 100), (20, 60), (30, 45)])) for _ in range(draw.randint(1, 9))]
        start = best_fit.best_fit(sizes, 100)
        bins = best_fit.local_search(start, sizes, 100)
        assert sorted(k for b in bins for k in b) == list(range(len(sizes)))
        assert all(sum(sizes[k] for k in b) <= 100 for b in bins) and len(bins) <= len(start)
        extra += len(bins) - fewest(sizes, 100)
    assert extra <= 1


def test_local_search_empties_bins_that_best_fit_leaves():
    draw = random.Random(1)
    sizes = [draw.randint(200, 500) for _ in range(2000)]
    start = best_fit.best_fit(sizes)
    bins = best_fit.local_search(start, sizes)
    squares = [sum(sum(sizes[k] for k in b) ** 2 for b in x) for x in (start, bins)]
    assert squares[1] > squares[0] and len(bins) < len(start)


def test_nothing_is_left_to_exchange():
    """After the search no move, one-for-one or two-for-one exchange increases the squared fills."""
    draw = random.Random(9)
    sizes = [draw.randint(10, 60) for _ in range(40)]
    bins = best_fit.pack(sizes, 100)
    fills = [sum(sizes[k] for k in b) for b in bins]
    for a, b in product(range(len(bins)), repeat=2):
        if a == b or 100 in (fills[a], fills[b]):
            continue
        own = [(), *((x,) for x in bins[b]), *((x, y) for x in bins[b] for y in bins[b] if x < y)]
        theirs = [*((x,) for x in bins[a]), *((x, y) for x in bins[a] for y in bins[a] if x < y)]
        for given, taken in product(own, theirs):
            if len(given) + len(taken) > 3 or not given and len(taken) > 1:
                continue
            gain = sum(sizes[k] for k in taken) - sum(sizes[k] for k in given)
            new = fills[b] + gain, fills[a] - gain
            assert max(new) > 100 or new[0] ** 2 + new[1] ** 2 <= fills[a] ** 2 + fills[b] ** 2


TEXTS = ["a  b", "a   b", "x \n\n y  ", "\n\n\nfoo", "don't, it's.", "tab\there \t x", "  foo bar  ", "a<|endoftext|> b", "", "  ", "e.g. x1. 3.5, ü. ß,",
         "a\r\nb", "foo \n", "x y　z   w", "\U0001F600 ok — “q”", "a\n \n b", "1,234.5 a.b.c."]


@pytest.mark.parametrize("limit", [best_fit.CACHED_UNITS, 3])
def test_byte_encoder_is_the_tokenizer(limit):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(best_fit.default_tokenizer())
    texts = [*TEXTS, prose(3, 3000), *TEXTS]
    found = list(best_fit.ByteEncoder(best_fit.default_tokenizer(), limit)([t.encode() for t in texts], slice_bytes=50))
    for text, ids in zip(texts, found, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def check_packing(docs, out, capacity=best_fit.SEQUENCE):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(best_fit.default_tokenizer())
    want = defaultdict(int)
    for r in docs.select("doc_id", "text").collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, best_fit.END_ID]
        cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
        for piece, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[r.doc_id, piece, lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes())] += 1
    got, sequences = defaultdict(int), defaultdict(list)
    for r in out.collect():
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        sequences[r.sequence_id].append((r.offset, r.length, r.fill))
    assert got == want
    for pieces in sequences.values():
        at = 0
        for offset, length, fill in sorted(pieces):
            assert offset == at and fill == sum(p[1] for p in pieces) <= capacity
            at += length
    return len(sequences), sum(k[3] * n for k, n in want.items())


def test_packing_of_awkward_documents(spark):
    docs = with_clashes(awkward(spark).union(documents(spark, [(100 + k, t) for k, t in enumerate(TEXTS)])))
    sequences, tokens = check_packing(docs, best_fit.pack_best_fit(docs))
    assert sequences <= -(-tokens // best_fit.SEQUENCE) + 1
    assert best_fit.pack_best_fit(spark.createDataFrame([], DOCS)).count() == 0


def test_packing_over_many_tasks_and_small_chunks(spark):
    docs = documents(spark, [(k, prose(k, 20 + 37 * k % 900)) for k in range(150)]).repartition(12)
    sequences, tokens = check_packing(docs, best_fit.pack_best_fit(docs, chunk_items=7))
    assert sequences <= 1.1 * tokens / best_fit.SEQUENCE + 1
    few, _ = check_packing(docs, best_fit.pack_best_fit(docs))
    assert few <= tokens // best_fit.SEQUENCE + 2  # the underfull sequences of twelve tasks meet


# ---- hard negatives ------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_negatives(data):
    fit = [(i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, [math.floor(256 * float(np.float32(x))) for x in v], k)
           for k, (i, v, lab) in enumerate(data)
           if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, label, v, k in fit:
        if i is None or i % 50:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), math.inf if j is None else j, m, lab == label) for j, lab, w, m in fit if m != k))
        for score, j, _, _ in [s for s in scored if s[3]][:5]:
            fits = [s for s in scored if not s[3] and 50 * -score <= 100 * -s[0] <= 95 * -score][:3]
            out += [(i, None if j == math.inf else j, rank, None if n[1] == math.inf else n[1], -score, -n[0]) for rank, n in enumerate(fits, 1)]
    return sorted(out, key=repr)


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def vectors(seed, n, dims=6, labels=4, spread=0.4):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(labels, dims))
    picked = draw.integers(0, labels, n)
    return [(k, [float(x) for x in (centres[c] + spread * draw.normal(size=dims)).astype(np.float32)], int(c)) for k, c in enumerate(picked)]


@pytest.mark.parametrize("spread", [0.05, 0.4, 2.0])
def test_negatives_against_all_pairs(spark, spread):
    data = vectors(int(spread * 100), 700, spread=spread)
    df = spark.createDataFrame(data, VECTORS).repartition(5)
    got = hard_negatives.hard_negatives(df, chunk_rows=64, tree_rows=5)
    assert rows(got, *COLUMNS) == brute_negatives(data)


def test_negatives_of_awkward_rows(spark):
    data = vectors(3, 300)
    data += [(50, data[3][1], 1), (50, data[3][1], 1), (100, None, 1), (150, data[5][1], None), (200, [1.0, None], 2), (250, [1.0, float("nan")], 2),
             (300, [float("inf")], 1), (350, [], 1), (400, [0.0] * 6, 2), (None, data[9][1], 3), (450, [1.0, 2.0], 3), (-50, data[7][1], 2), (-7, data[7][1], 9)]
    data += [(1000 + k, data[20][1], 1) for k in range(40)]  # copies tie by id
    df = with_clashes(spark.createDataFrame(data, VECTORS)).withColumns({c: F.lit(0) for c in ("id", "vector", "chunk", "lane", "anchor", "score")})
    assert rows(hard_negatives.hard_negatives(df, chunk_rows=32, tree_rows=4), *COLUMNS) == brute_negatives(data)
    assert hard_negatives.hard_negatives(spark.createDataFrame([], VECTORS)).count() == 0


def test_scores_beyond_floating_point_are_exact(spark):
    data = [(50 * k, [3e4 + k, 2e5 * k + 0.3], k % 2) for k in range(12)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    fit = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [math.floor(256 * x) for x in v]) for i, v, lab in data]
    scores = {(a[0], b[0]): sum(x * y for x, y in zip(a[2], b[2], strict=True)) for a in fit for b in fit}
    assert 2 ** 53 < max(scores.values()) < 2 ** 63
    got = hard_negatives.hard_negatives(df, chunk_rows=4, tree_rows=3).collect()
    assert got and all(scores[r.anchor_id, r.positive_id] == r.positive_score and scores[r.anchor_id, r.negative_id] == r.negative_score for r in got)


def test_bounds_leave_most_candidates_alone():
    """On clustered vectors the walk scores few candidates again, and its bounds always hold the score."""
    draw = np.random.default_rng(4)
    base = draw.normal(size=(2, 16)) * 400
    points = np.floor(base[draw.integers(0, 2, 600)] + 3 * draw.normal(size=(600, 16))).astype(np.int64)
    order, parents, edges = hard_negatives.spanning_tree(points[:40])
    anchors = points[:40][order]
    walk = hard_negatives.Walk({"ids": list(range(600)), "dims": 16, "matrix": points.tobytes()},
                               {"ids": list(range(40)), "dims": 16, "matrix": anchors.tobytes(), "parents": parents, "edges": edges})
    asked = 0

    def wanted(k, low, high):
        exact = points @ anchors[k]
        assert (low <= exact).all() and (exact <= high).all()
        return np.flatnonzero((high >= exact.max() * 0.99) & (low <= exact.max()))

    def take(k, found, scores):
        nonlocal asked
        asked += len(found)
        assert (scores == (points @ anchors[k])[found]).all()

    walk.visit(wanted, take)
    assert asked < 0.8 * 600 * 40


def test_spanning_tree_is_shortest():
    points = np.random.default_rng(2).integers(-50, 50, (9, 3))
    order, parents, edges = hard_negatives.spanning_tree(points)
    assert sorted(order) == list(range(9)) and parents[0] == -1 and all(p < k for k, p in enumerate(parents))
    gaps = sorted((float(np.linalg.norm(points[a] - points[b])), a, b) for a in range(9) for b in range(a))
    group, total = list(range(9)), 0.0
    for gap, a, b in gaps:  # Kruskal
        if group[a] != group[b]:
            total += gap
            group = [group[a] if g == group[b] else g for g in group]
    assert abs(total - sum(edges)) < 1e-9


# ---- conversation repair -------------------------------------------------------------------------------------------


def best_repair(codes):
    """Every edit at every place, whole audits compared, from the end."""
    after = {0: 2, 1: 2, 2: 3, 3: 2}

    @lru_cache(None)
    def best(i, state, inserted):
        out = []
        if i == len(codes):
            if state in (0, 3):
                out.append((0, ""))
        else:
            cost, audit = best(i + 1, state, 0)
            out.append((cost + 4, "D" + audit))
            if codes[i] != turn_repair.GO:
                more, char = 3 if codes[i] & 8 else 0, "uas?"[codes[i] & 3]
                cost, audit = best(i + 1, after[state], 0)
                out += [(cost + more, "K" + audit)] if char == ("a" if state == 2 else "u") else []
                out.append((cost + 3 + more, "R" + audit))
                if char == "s" and state == 0:
                    cost, audit = best(i + 1, 1, 0)
                    out.append((cost + more, "K" + audit))
        if inserted < 3:
            cost, audit = best(i, after[state], inserted + 1)
            out.append((cost + 3, "I" + audit))
        return min(out, default=(1 << 40, ""))

    for i in range(len(codes), 0, -100):  # so that the recursion stays shallow
        for state in (3, 2, 1, 0):
            best(i, state, 0)
    return best(0, 0, 0)


@pytest.mark.parametrize("block", [1, 2, 3, 32])
def test_alignment_against_every_repair(monkeypatch, block):
    monkeypatch.setattr(turn_repair, "BLOCK_ROWS", block)
    draw = random.Random(block)
    for _ in range(300):
        weights = draw.choice([[6, 6, 1, 1, 2, 1, 1, 1], [1] * 8, [8, 2, 0, 0, 1, 2, 1, 0], [0, 0, 3, 1, 3, 0, 0, 2]])
        codes = draw.choices([0, 1, 2, 3, 4, 8, 9, 10], weights, k=draw.choice([1, 2, 3, 5, 8, 13, 40]))
        assert turn_repair.cheapest(turn_repair.table_of(codes)) == best_repair(tuple(codes))


TURNS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def brute_damage(data):
    out = []
    for conv, turn, role, text in data:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute_report(data):
    groups = defaultdict(list)
    for row in brute_damage(data):
        groups[row[0]].append(row[1:])
    out = []
    for conv in {r[0] for r in data}:
        said = sorted(groups[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, codes, faults = set(), [], defaultdict(int)
        for _, role, text in said:
            tail = text.strip(SPACE)[-1:]
            fault = "blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            codes.append(4 if fault in ("blank", "duplicate") else {"u": 0, "a": 1, "s": 2}.get(role[:1], 3) + 8 * (fault == "truncated"))
        cost, audit = best_repair(tuple(codes))
        lines, state, at = [], 0, 0
        for letter in audit:
            want = "assistant" if state == 2 else "user"
            if letter == "K":
                lines.append(f"{said[at][1]}:{said[at][2]}")
                want = {"u": "user", "a": "assistant", "s": "s"}[said[at][1][0]]
            elif letter == "R":
                lines.append(f"{want}:{said[at][2]}")
            elif letter == "I":
                lines.append(f"{want}:")
            at += letter != "I"
            state = state if letter == "D" else {"user": 2, "assistant": 3, "s": 1}[want]
        turns = [t for t, _, _ in said if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:], strict=False))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"],
                    illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


REPORT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def dialogues(seed, n, most=9):
    draw, out = random.Random(seed), []
    for conv in range(n):
        for turn in range(draw.randint(1, most)):
            role = draw.choice(["user", "assistant", "assistant" if turn % 2 else "user", "system" if not turn else "user", "tool"])
            out.append((conv, turn + draw.choice([0, 0, 0, 1]), role, draw.choice(["Yes.", "No!", "well", "", " \t", f"Text {draw.random()}.", "ünï?"])))
    return out


def test_repair_against_every_repair(spark):
    data = dialogues(1, 120)
    assert rows(turn_repair.repair_report(spark.createDataFrame(data, TURNS).repartition(5)), *REPORT) == brute_report(data)


def test_repair_of_awkward_rows(spark):
    data = [(None, None, None, None), (None, 3, "user", "Hi."), (1, None, "user", "Hi."), (1, None, "assistant", "Yes."), (1, 1, None, "No."), (2, 5, "", "Yes."),
            (2, 6, "", "Yes."), (2, 7, "user", None), (3, 1, "user", "x" * 70_000 + "."), (4, 2, "user", "a."), (4, 2, "user", "b."), (4, 2, "assistant", "a."),
            (5, 1, "ünknown", "?"), (5, 2, "system", "S."), (6, -5, "assistant", "A."), (6, 4, "user", "U."), *[(7, 1, "user", "Same.")] * 9]
    df = spark.createDataFrame(data, TURNS).withColumns({c: F.lit("x") for c in ("piece", "digest", "copies", "kind", "key", "position", "first", "state")})
    assert rows(turn_repair.repair_report(df), *REPORT) == brute_report(data)
    assert turn_repair.repair_report(spark.createDataFrame([], TURNS)).count() == 0


def test_one_long_conversation_in_many_ranges(spark, monkeypatch):
    data = [(9, k, "user" if k % 3 else "assistant", f"Text {k % 700}." if k % 11 else "cut") for k in range(1500)] + dialogues(2, 5)
    df = spark.createDataFrame(data, TURNS).repartition(4)
    assert rows(turn_repair.repair_report(df), *REPORT) == brute_report(data)


def test_repaired_rows_follow_the_grammar(spark):
    repaired, _ = turn_repair.repair(spark.createDataFrame(dialogues(3, 60), TURNS))
    import re

    by = defaultdict(list)
    for r in repaired.collect():
        by[r.conv_id].append((r.position, r.edit, r.role, r.text))
    for said in by.values():
        said.sort()
        assert [p for p, *_ in said] == list(range(len(said)))
        assert re.fullmatch(r"(s?(ua)+)?", "".join(role[0] for _, _, role, _ in said))
        assert all(text == "" for _, edit, _, text in said if edit == "I")
