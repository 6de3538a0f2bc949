"""Quality rules, line de-duplication and chat views against brute force, and on awkward rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from feedspark.llm import chat_views, line_dedup, quality_rules
from feedspark.llm.queries import ORACLES, QUERIES

from .helpers import awkward, documents, prose, rows, with_clashes

LABELS = "doc_id long, quality long, toxic long"
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    cursor = duck.cursor()
    cursor.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    order = [names.index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=repr)
    assert rows(got, *columns) == expected


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_counts_on_awkward_rows(spark):
    docs = with_clashes(awkward(spark)).union(with_clashes(documents(spark, [(20, "a b c d e f " * 9), (21, "p q r s t " + prose(3, 60) + " p q r s t")])))
    empty = spark.createDataFrame([], LABELS)
    out = quality_rules.quality_verdicts(docs, empty).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    expected = []
    for r in docs.collect():
        c = base_counts(r["text"])
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        expected.append((r["doc_id"], *c, failed, not failed))
    assert rows(out, *out.columns) == sorted(expected, key=repr)
    kept = quality_rules.keep_good(docs, empty)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not e[6] for e in expected)
    assert quality_rules.quality_verdicts(docs.limit(0), empty).count() == 0


def test_binomial_cdf_is_exact(spark):
    cases = [(n, k) for n in (1, 7, 600, 5000, 40_000) for k in (0, 1, 3, 12, 60)]
    df = spark.createDataFrame(cases, "n long, k long").select("n", "k", quality_rules.binomial_cdf(F.col("n"), F.col("k"), 0.0075).alias("p"))
    for n, k, p in df.collect():
        if k > n * 0.0075:
            assert p == 1
        else:
            log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.0075) + (n - i) * math.log1p(-0.0075)
            assert p == pytest.approx(sum(math.exp(log(i)) for i in range(k + 1)), rel=1e-9)


def test_cutoffs_hold_their_risk_per_stratum(spark):
    draw = random.Random(5)
    clean = [(i, prose(i, 40), "en" if i % 2 else "de") for i in range(3000)]
    noisy = [(i, " ".join(w + "###" for w in prose(i, 40).split()), "en") for i in range(3000, 3200)]
    rare = [(i, " ".join(w + "###" for w in prose(i, 40).split()), "fr") for i in range(3200, 3210)]
    docs = documents(spark, clean + noisy + rare)
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in clean] + [(i, 0, 0) for i, _, _ in noisy[:50]] + [(7, 1, 0), (None, 1, 0)], LABELS)
    out = {r["doc_id"]: r["kept"] for r in quality_rules.quality_verdicts(docs, labels).collect()}
    assert all(out[i] for i, _, _ in clean)
    assert not any(out[i] for i, _, _ in noisy)
    assert all(out[i] for i, _, _ in rare)  # no labels, no cutoff
    # with good documents above every cutoff nothing is certified
    mixed = spark.createDataFrame([(i, 1, 0) for i, _, _ in noisy + clean[:draw.randint(200, 400)]], LABELS)
    assert all(r["kept"] for r in quality_rules.quality_verdicts(docs, mixed).filter("stratum = 'en'").collect())


def brute_lines(docs, min_docs=5):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(strip))
    holders = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders[key(x)].add(-1 if i is None else i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < 40 or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == (-1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_lines_against_brute_force(spark):
    draw = random.Random(2)
    pool = [prose(100 + i, 12) for i in range(30)] + ["short", "", "   "]
    docs = []
    for i in range(120):
        lines = [draw.choice(pool) if draw.random() < 0.5 else prose(1000 * i + k, 9) for k in range(draw.choice([1, 5, 150]))]
        docs.append((i, "\n".join(draw.choice([x, x.upper(), "  " + x + "\t"]) for x in lines)))
    docs += [(None, pool[0]), (None, pool[1]), (200, None), (201, ""), (5, docs[5][1]), (6, pool[0] + "\n" + pool[0])]
    got = line_dedup.line_report(with_clashes(documents(spark, docs)))
    assert rows(got, *got.columns) == brute_lines(docs)


def test_lines_edges(spark):
    docs = with_clashes(awkward(spark))
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.filter("text is null").count() == docs.filter("text is null").count()
    assert line_dedup.line_report(docs.limit(0)).count() == 0
    long = documents(spark, [(i, "\n".join(["same line " * 6] * 5000)) for i in range(6)])
    dropped = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_report(long).collect()}
    assert dropped == {0: 5000, 1: 5000, 2: 5000, 3: 5000, 4: 5000, 5: 0}


TURNS = "conv_id long, turn long, role string, text string"


def brute_views(turns):
    out = []
    for conv in {t[0] for t in turns}:
        said = sorted(((t[1] is not None, t[1] or 0, t[2] or "", (t[3] or "").replace("<|", "<\\|")) for t in turns if t[0] == conv))
        for me in {s[2] for s in said} - {"system"}:
            at = 0
            for k, (_, _, who, text) in enumerate(said):
                role = "system" if who == "system" else "assistant" if who == me else "user"
                opening = f"<|{role}{':' + who if role == 'user' else ''}|>\n"
                segment = opening + text + "<|end|>\n"
                mask = (at + len(opening), at + len(segment) - 1) if role == "assistant" else (None, None)
                out.append((conv, me, k, role, who if role == "user" else None, segment, at, at + len(segment), *mask))
                at += len(segment)
    return sorted(out, key=repr)


def test_views_against_brute_force(spark):
    draw = random.Random(3)
    turns = [(c, t, draw.choice(["ann", "bob", "cid", "system"]), prose(c * 100 + t, draw.randint(0, 9))) for c in range(30) for t in range(draw.randint(1, 9))]
    turns += [(None, 1, "ann", "no id"), (None, 0, None, None), (50, None, "ann", "x"), (50, 1, "bob", "a <|end|> b"), (50, 1, "bob", "a <|end|> b"),
              (51, 0, "system", "alone"), (52, 0, "ann", prose(9, 5000))]
    turns += [(60, t, ("ann", "bob")[t % 2], f"turn {t}") for t in range(3000)]  # half of all rows in one conversation
    df = spark.createDataFrame(turns, TURNS).withColumns({c: F.lit("x") for c in ("name", "size", "perspective", "position")})
    got = chat_views.chat_views(df)
    assert rows(got, *got.columns) == brute_views(turns)
    assert chat_views.chat_views(df.limit(0)).count() == 0
