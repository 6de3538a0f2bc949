"""WARC archives, HTML extraction and the pipeline."""

import random
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from feedspark.llm import decontaminate, html_crf, packing, warc
from feedspark.llm.html_blocks import leaf_blocks
from feedspark.llm.queries import ORACLES, QUERIES
from feedspark.llm.tables import read

from .helpers import prose, with_clashes
from .test_native_operators import base_counts, brute_lines
from .test_text_operators import brute_components

PAGES = "page_id long, url string, html string"
SF = "/root/testdata/sf0.001"


# --- WARC ---

def archive(*records, dictionary=b"", lead=b""):
    packer = zstandard.ZstdCompressor(**({"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}))
    return lead + b"".join(packer.compress(r) for r in records)


RECORD = warc.encode_record(7, "http://a.example/ä%20b\n", b"payload " * 40, __import__("hashlib").sha256(b"payload " * 40).hexdigest(), False, None)


def test_round_trip_of_awkward_pages(spark):
    long = "<p>" + "x" * 300_000
    pages = [(5, "http://x/1", "same " * 30), (3, None, "same " * 30), (9, "u\r\nWARC-Type: evil", "same " * 30), (9, "u", "same " * 30), (4, "u", "tiny"),
             (6, "u", "tiny"), (None, "%41 ü", None), (None, "u", "same " * 30), (11, "u", ""), (12, "u", long), (13, "u", long), (14, "u", "a\r\n\r\nb \0" + "é" * 60)]
    df = with_clashes(spark.createDataFrame(pages, PAGES)).repartition(3)
    manifest = warc.write_archives(df, archive_bytes=2000)
    assert manifest.agg(F.sum("records")).first()[0] == len(pages)
    got = sorted((tuple(r) for r in warc.read_archives(manifest).collect()), key=repr)
    expected = []
    for i, url, html in pages:
        b = (html or "").encode()
        first = {"same " * 30: 3, long: 12}.get(html)
        again = first is not None and i != first
        expected.append((i, url, len(b), __import__("hashlib").sha256(b).hexdigest(), "revisit" if again else "response", first if again else None, None if again else bytearray(b)))
    assert got == sorted(expected, key=repr)
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_reader_takes_plain_and_packed_dictionaries():
    samples = [RECORD[:k] for k in range(50, len(RECORD), 3)]
    words = warc.train_dictionary(samples * 5, 2000)
    for stored in (words, zstandard.ZstdCompressor().compress(words)):
        lead = struct.pack("<II", warc.DICT_FRAME, len(stored)) + stored
        (page, url, size, _, kind, refers, payload), = warc.read_archive(archive(RECORD, dictionary=words, lead=lead))
        assert (page, url, size, kind, refers, payload) == (7, "http://a.example/ä%20b\n", 320, "response", None, b"payload " * 40)
    skipped = struct.pack("<II", 0x184D2A50, 3) + b"abc"
    assert len(list(warc.read_archive(skipped + archive(RECORD, RECORD) + skipped))) == 2
    streamed = zstandard.ZstdCompressor(write_content_size=False).compressobj()
    assert len(list(warc.read_archive(streamed.compress(RECORD) + streamed.flush()))) == 1
    assert list(warc.read_archive(b"")) == []


@pytest.mark.parametrize("broken", [
    archive(RECORD)[:-5], archive(RECORD) + b"junk", archive(RECORD[:-1]), archive(RECORD.replace(b"payload payload", b"payload Payload")),
    archive(RECORD.replace(b"WARC/1.1", b"WARC/9")), archive(RECORD.replace(b"Content-Length: ", b"Content-Length: 1", 1)),
    archive(RECORD.replace(b"WARC-Date", b"WARC-Dato")), archive(RECORD.replace(b"response", b"resource", 1)), archive(RECORD.replace(b"<urn:page:7>", b"<urn:x>")),
    archive(RECORD, dictionary=b"payload " * 500), archive(RECORD.replace(b"\r\nWARC-Date", b"\r\nWARC-Type: response\r\nWARC-Date"))])
def test_reader_refuses_broken_archives(broken):
    with pytest.raises(ValueError):
        list(warc.read_archive(broken))


# --- HTML ---

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p>";</script></head><body class=x>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav><!-- <p>gone</p> --><div class="ad">Buy this now.</div>
<article><h1>The &quot;title&quot; &am</h1><p>First <b>bold</b>&nbsp;text,
 two lines.<p>Second para<wbr>graph with <a href="/l">a link</a> &#233;&lt;x&gt; inside.<ul><li>item one.<li>item two.</ul><form><label>Mail</label><input><button>Go</button></form>
<aside>See also this.</aside></article><div id="comments"><h3>Comments</h3><div class="comment"><p>I like it very much.</p></div></div>
<div class="sidebar"><p>Other things to read.</p></div><footer>&copy; 2020 Somebody</footer></body></html><p"""


def test_a_page():
    model = html_crf.train(html_crf.labelled_pages())
    assert model.extract(PAGE) == ('The "title" &am First bold text, two lines. Second paragraph with a link é<x> inside. item one. item two.')


def test_blocks_of_odd_markup():
    texts = lambda h: [b.text for b in leaf_blocks(h)]
    assert texts(None) == texts("") == texts("<p></p><script>x") == []
    assert texts("a<br>b<p>c</div>d<table><tr><td>e<td>f<tr><td>g</table>") == ["a b", "cd", "e", "f", "g"]
    assert texts("1 < 2 & 3 &gt; 2<p title='>'>x<a href=\"it's\">y</a></p><SCRIPT>p</SCRIPT >z") == ["1 < 2 & 3 > 2", "xy", "z"]
    # a plain element is no reason to drop text, and a tag that is not closed does not swallow the page
    assert texts("<p>before</p><object data=x><p>Article goes on.</p><p>And on.</p>") == ["before", "Article goes on.", "And on."]
    assert texts("<noscript><p>a</p></noscript><p>b<svg><text>c</text></svg><canvas>d</canvas><iframe src=y>e</iframe></p><math>f") == ["a", "bcde", "f"]
    assert texts("<p>a</p><style>b{}<p>c</p><title>d<p>e</p><template><p>f</p></template><p>g") == ["a", "c", "e", "g"]
    assert texts("<div>" * 3000 + "deep") == ["deep"]
    assert texts("<p>" + "w " * 200_000)[0].count("w") == 200_000


def test_held_out_accuracy():
    model = html_crf.train(html_crf.labelled_pages())
    pages = html_crf.labelled_pages(200, seed=99)
    errors = sum(a != b for blocks, labels in pages for a, b in zip(model.decode(blocks), labels, strict=True))
    assert errors / sum(len(b) for b, _ in pages) < 0.01


def test_viterbi_is_the_best_labelling():
    model = html_crf.train(html_crf.labelled_pages(60), epochs=10)
    for blocks, _ in html_crf.labelled_pages(40, seed=5):
        blocks = blocks[:9]
        scores = [model.emission(b) for b in blocks]

        def total(labels):
            return model.start[labels[0]] + sum(s for s, y in zip(scores, labels) if y) + sum(model.change[a][b] for a, b in zip(labels, labels[1:]))

        if blocks:
            best = max(total([n >> k & 1 for k in range(len(blocks))]) for n in range(1 << len(blocks)))
            assert total([int(x) for x in model.decode(blocks)]) == pytest.approx(best)


def test_extraction_of_awkward_rows(spark):
    df = with_clashes(spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, None, ""), (3, "u", "<nav>menu</nav>")], PAGES))
    got = {(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in html_crf.extract_pages(df).collect()}
    assert got[None, None] == got[2, None] == got[3, "u"] == ("", 0)
    assert got[1, "u"][1] == len(got[1, "u"][0]) > 50
    assert html_crf.extract_pages(df).count() == 5 and html_crf.extract_pages(df.limit(0)).count() == 0


# --- pipeline ---

def test_pipeline_stage_by_stage(spark):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    kept, seen = {}, None
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, SF)
        if name == "packing":
            tokens = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
            assert {r["doc_id"] for r in tokens} == set(before) and all(r["n"] == r["m"] for r in tokens)
            seen = len(before)
            break
        assert out.columns == columns
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        kept[name] = len(after)
        if name == "quality_rules":  # too few labels here for a cutoff: the base rules decide
            good = {i for i, t in before.items() if (c := base_counts(t))[0] >= 10 and 100 * c[4] <= 20 * c[0]}
            assert set(after) == good and all(after[i] == before[i] for i in after)
        elif name == "line_dedup":
            expected = {i: d for i, _, _, d in brute_lines(list(before.items()))}
            assert {i: __import__("hashlib").sha256(t.encode()).hexdigest() for i, t in after.items()} == expected
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        elif name == "minhash_dedup":
            assert set(after) == {i for i, c in brute_components(list(before.items()), 5).items() if i == c}
        else:
            items = [r["text"] for r in read(spark, SF, "benchmark").collect()]
            leaked = {i for i, t in before.items() if any(x.lower() in t.lower() for x in items)}
            assert not leaked & set(after)
            assert len(before) - len(after) - len(leaked) <= 0.01 * len(before)
        docs = out
    assert seen > 0.8 * kept["quality_rules"]
    got = corpus_pipeline.run(spark, SF)
    assert got.select("doc_id").distinct().count() == seen


def test_registry():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [k for n in range(1, 11) if len([k for k in names if k.startswith(f"op{n}_")]) == 1 for k in [n]] == list(range(1, 11))
    assert "pipeline" in names and set(ORACLES) <= set(QUERIES) <= set(names)
    assert random.Random(1) and prose(1, 3) and decontaminate.MIN_SCORE and packing.TIERS
