"""The registered queries of the training-data operators, over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from . import (best_fit, chat_views, decontaminate, hard_negatives, html_crf, line_dedup, maxent_lm, minhash_dedup,
               packing, quality_rules, suffix_dedup, turn_repair, warc)
from .tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            checkpoint_dir(spark)
            return fn(spark, sf_dir)

        build.__name__, build.__doc__ = name, fn.__doc__
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = oracle
        return fn

    return deco


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_STATS = f"""
base AS (SELECT doc_id, coalesce(lang, '') stratum, coalesce(text, '') t, {_WORDS} w FROM documents),
rows AS (SELECT *, row_number() OVER () rid FROM base),
grams AS (SELECT rid, i, list_slice(w, i, i + 4) g FROM rows, unnest(range(1, greatest(len(w) - 3, 1))) u(i)),
marked AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) n FROM grams),
spans AS (SELECT rid, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5)) s FROM marked WHERE n > 1),
repeats AS (SELECT rid, sum(s)::BIGINT n_repeat_words FROM spans GROUP BY rid),
counts AS (
  SELECT doc_id, rid, stratum, len(w)::BIGINT n_words, length(array_to_string(w, ''))::BIGINT word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) l,
    length(regexp_replace(t, '\\P{{Lu}}', '', 'g'))::BIGINT n_upper
  FROM rows),
sig AS (
  SELECT c.*, (len(l) - len(list_distinct(l)))::BIGINT n_dup_lines, coalesce(n_repeat_words, 0) n_repeat_words,
    n_symbols / greatest(word_chars, 1) symbol_ratio,
    coalesce(n_repeat_words, 0) / greatest(n_words, 1) repeat_ratio,
    (len(l) - len(list_distinct(l))) / greatest(len(l), 1) dup_line_ratio,
    n_upper / greatest(word_chars, 1) upper_ratio,
    (n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words) base_failed
  FROM counts c LEFT JOIN repeats USING (rid))
"""

_ALPHA = quality_rules.ALPHA / len(quality_rules.SIGNALS)
_QUALITY_SQL = f"""
WITH {_STATS},
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
  HAVING min(quality) = 1 AND coalesce(max(toxic), 0) = 0),
long AS (SELECT stratum, signal, v FROM (
  UNPIVOT (SELECT stratum, {', '.join(quality_rules.SIGNALS)} FROM sig SEMI JOIN good USING (doc_id))
  ON {', '.join(quality_rules.SIGNALS)} INTO NAME signal VALUE v)),
grid AS (SELECT unnest(range({len(quality_rules.GRID)})) step, unnest({list(quality_rules.GRID)}) cut),
tests AS (SELECT stratum, signal, step, cut, count(*) n, count(*) FILTER (v > cut) k
  FROM long, grid GROUP BY ALL),
proofs AS (SELECT *, CASE WHEN k > n * {_ALPHA} THEN 1.0 ELSE list_sum(list_transform(range(k + 1), lambda i:
    exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_ALPHA}) + (n - i) * ln(1 - {_ALPHA})))) END p
  FROM tests),
stops AS (SELECT stratum, signal, coalesce(min(step) FILTER (
    p > {quality_rules.DELTA} / ((SELECT count(DISTINCT stratum) FROM tests) * {len(quality_rules.SIGNALS)})),
    {len(quality_rules.GRID)}) stop FROM proofs GROUP BY ALL),
cuts AS (SELECT stratum, signal, cut FROM stops JOIN grid ON step = stop - 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT EXISTS (SELECT 1 FROM cuts c WHERE c.stratum = sig.stratum AND CASE signal
    {' '.join(f"WHEN '{s}' THEN {s}" for s in quality_rules.SIGNALS)} END > cut) kept
FROM sig
"""


@query("op10_quality_rules", _QUALITY_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts of every document, and the verdict of base rules and certified cutoffs."""
    out = quality_rules.quality_verdicts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept")


_LINES_SQL = f"""
WITH base AS (SELECT doc_id, row_number() OVER () rid, string_split(coalesce(text, ''), chr(10)) l FROM documents),
lines AS (SELECT doc_id, rid, i, l[i] line, translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    '{line_dedup.UPPER}', '{line_dedup.LOWER}') k FROM base, unnest(range(1, len(l) + 1)) u(i)),
frequent AS (SELECT k, max(doc_id) owner FROM lines WHERE length(k) >= {line_dedup.MIN_CHARS}
  GROUP BY k HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCS}),
marked AS (SELECT lines.*, coalesce(doc_id <> owner, false) gone FROM lines LEFT JOIN frequent USING (k))
SELECT doc_id, count(*) n_lines, count(*) FILTER (gone) n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) kept_sha256
FROM marked GROUP BY doc_id, rid
"""


@query("op7_line_dedup", _LINES_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that repeat across documents, dropped by bitmap; digest of what stays."""
    return line_dedup.line_report(read(spark, sf_dir, "documents"))


@query("op5_minhash_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by 4-word shingles."""
    return minhash_dedup.near_duplicate_components(read(spark, sf_dir, "documents"))


@query("op3_decontaminate")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document passage that aligns with a test item."""
    out = decontaminate.benchmark_matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "score", "doc_start", "doc_end")


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packing.pack_documents(read(spark, sf_dir, "documents"))


@query("op4_suffix_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that repeat a 50-byte string of an earlier document, removed."""
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))


@query("op1_maxent_lm")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under the base counts and under the maximum-entropy model."""
    return maxent_lm.score_documents(read(spark, sf_dir, "documents"))


_WARC_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT payload_bytes, sha256(b) payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY payload_digest) END first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END record_type,
  CASE WHEN first <> page_id THEN first END refers_to
FROM f
"""


@query("op2_warc", _WARC_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives and read back."""
    records = warc.read_archives(warc.write_archives(read(spark, sf_dir, "pages")), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_CHAT_SQL = f"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') speaker, replace(coalesce(text, ''), '<|', '<\\|') content FROM conversations),
people AS (SELECT DISTINCT conv_id c, speaker perspective FROM said WHERE speaker <> '{chat_views.SYSTEM}'),
views AS (SELECT *, CASE WHEN speaker = '{chat_views.SYSTEM}' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END r
  FROM said JOIN people ON conv_id IS NOT DISTINCT FROM c),
tagged AS (SELECT *, '<|' || r || CASE WHEN r = 'user' THEN ':' || speaker ELSE '' END || '|>' || chr(10) o FROM views),
placed AS (SELECT *, length(o) + length(content) + {len(chat_views.END) + 1} n,
    row_number() OVER w - 1 pos, sum(length(o) + length(content) + {len(chat_views.END) + 1}) OVER w e FROM tagged
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, content ROWS UNBOUNDED PRECEDING))
SELECT conv_id, perspective, pos AS position, r AS role, CASE WHEN r = 'user' THEN speaker END AS name,
  o || content || '{chat_views.END}' || chr(10) AS segment, (e - n)::BIGINT seg_start, e::BIGINT seg_end,
  CASE WHEN r = 'assistant' THEN e - n + length(o) END::BIGINT mask_start,
  CASE WHEN r = 'assistant' THEN e - 1 END::BIGINT mask_end
FROM placed
"""


@query("op9_chat_views", _CHAT_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's point of view, with learning masks."""
    return chat_views.chat_views(read(spark, sf_dir, "conversations"))


@query("op6_html_crf")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_crf.extract_pages(read(spark, sf_dir, "pages"))


@query("op11_best_fit")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed by best fit and local search into sequences of at most 1024 tokens."""
    return best_fit.pack_best_fit(read(spark, sf_dir, "documents"))


_NEGATIVES_SQL = f"""
WITH fit AS (SELECT vec_id, row_number() OVER () r, CASE WHEN vec_id % {hard_negatives.MOVED_STEP} = 0 THEN (label + 1) % {hard_negatives.LABELS} ELSE label END AS label,
    list_transform(embedding, lambda x: floor({hard_negatives.SCALE} * x::DOUBLE)::BIGINT) v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.r a, a.vec_id anchor_id, b.r b, b.vec_id, a.label = b.label same,
    coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: coalesce(p[1] * p[2], 0))), 0)::BIGINT score
  FROM fit a JOIN fit b ON a.vec_id % {hard_negatives.ANCHOR_STEP} = 0 AND a.r <> b.r),
pos AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) <= {hard_negatives.POSITIVES}),
neg AS (SELECT p.a, p.anchor_id, p.b, p.vec_id positive_id, p.score positive_score, n.vec_id negative_id, n.score negative_score,
    row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.vec_id, n.b) AS rank
  FROM pos p JOIN scored n ON n.a = p.a AND NOT n.same
    AND {hard_negatives.LEAST} * p.score <= 100 * n.score AND 100 * n.score <= {hard_negatives.MOST} * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= {hard_negatives.NEGATIVES}
"""


@query("op12_hard_negatives", _NEGATIVES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor's positives, from all embeddings."""
    return hard_negatives.hard_negatives(read(spark, sf_dir, "embeddings"))


#: CRC-32 of an ASCII text: every byte is one exclusive or and eight shifts of the register.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::UBIGINT, flatten(list_transform(string_split({0}, ''),
    lambda c: [ascii(c)::UBIGINT, 256, 256, 256, 256, 256, 256, 256, 256]))),
    lambda r, e: CASE WHEN e < 256 THEN xor(r, e) WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END))"""

_REPAIR_SQL = f"""
WITH RECURSIVE keyed AS (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') key FROM conversations),
kinds AS (SELECT *, {_CRC32.format("key")} % 20 kind FROM keyed),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) copy FROM kinds WHERE kind <> 0),
placed AS (SELECT *, dense_rank() OVER (ORDER BY conv_id) g,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) i FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 again,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) tail, lead(role) OVER (PARTITION BY g ORDER BY i) next_role,
    count(*) OVER (PARTITION BY g) n FROM placed),
rows AS (SELECT g, i, n, conv_id, turn, role, text, next_role, role[1] c, CASE WHEN tail = '' THEN 'blank' WHEN again THEN 'duplicate'
    WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END fault FROM seen),
-- cheapest way to the end of a conversation from row i in each state (nothing, after s, after u, after a): cost, audit, lines
way AS (
  SELECT g, max(i) + 1 AS i, {{'k': 0, 'a': '', 't': ''}} v0, {{'k': 6, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} v1,
    {{'k': 3, 'a': 'I', 't': chr(10) || 'assistant:'}} v2, {{'k': 0, 'a': '', 't': ''}} v3 FROM rows GROUP BY g
  UNION ALL
  SELECT g, i, list_sort([w0, {{'k': w2.k + 3, 'a': 'I' || w2.a, 't': chr(10) || 'user:' || w2.t}}])[1],
    list_sort([w1, {{'k': w2.k + 3, 'a': 'I' || w2.a, 't': chr(10) || 'user:' || w2.t}},
      {{'k': w3.k + 6, 'a': 'II' || w3.a, 't': chr(10) || 'user:' || chr(10) || 'assistant:' || w3.t}}])[1],
    list_sort([w2, {{'k': w3.k + 3, 'a': 'I' || w3.a, 't': chr(10) || 'assistant:' || w3.t}}])[1],
    list_sort([w3, {{'k': w2.k + 3, 'a': 'I' || w2.a, 't': chr(10) || 'user:' || w2.t}}])[1]
  FROM (SELECT g, i,
      list_sort([{{'k': v0.k + 4, 'a': 'D' || v0.a, 't': v0.t}}, {{'k': v2.k + u, 'a': CASE WHEN c = 'u' THEN 'K' ELSE 'R' END || v2.a, 't': tu || v2.t}},
        {{'k': v1.k + s, 'a': 'K' || v1.a, 't': own || v1.t}}])[1] w0,
      list_sort([{{'k': v1.k + 4, 'a': 'D' || v1.a, 't': v1.t}}, {{'k': v2.k + u, 'a': CASE WHEN c = 'u' THEN 'K' ELSE 'R' END || v2.a, 't': tu || v2.t}}])[1] w1,
      list_sort([{{'k': v2.k + 4, 'a': 'D' || v2.a, 't': v2.t}}, {{'k': v3.k + a, 'a': CASE WHEN c = 'a' THEN 'K' ELSE 'R' END || v3.a, 't': ta || v3.t}}])[1] w2,
      list_sort([{{'k': v3.k + 4, 'a': 'D' || v3.a, 't': v3.t}}, {{'k': v2.k + u, 'a': CASE WHEN c = 'u' THEN 'K' ELSE 'R' END || v2.a, 't': tu || v2.t}}])[1] w3
    FROM (SELECT w.g, r.i, v0, v1, v2, v3, c, chr(10) || r.role || ':' || r.text own,
        chr(10) || CASE WHEN c = 'u' THEN r.role ELSE 'user' END || ':' || r.text tu,
        chr(10) || CASE WHEN c = 'a' THEN r.role ELSE 'assistant' END || ':' || r.text ta,
        CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 WHEN fault = 'truncated' THEN 3 ELSE 0 END + CASE WHEN c = 'u' THEN 0 ELSE 3 END u,
        CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 WHEN fault = 'truncated' THEN 3 ELSE 0 END + CASE WHEN c = 'a' THEN 0 ELSE 3 END a,
        CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 WHEN fault = 'truncated' THEN 3 ELSE 0 END + CASE WHEN c = 's' THEN 0 ELSE 1000000000 END s
      FROM way w JOIN rows r ON r.g = w.g AND r.i = w.i - 1))),
done AS (SELECT g, v0 FROM way WHERE i = 1),
told AS (SELECT g, any_value(conv_id) conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) gaps,
    count(*) FILTER (fault = 'blank') blank, count(*) FILTER (fault = 'duplicate') duplicate, count(*) FILTER (fault = 'truncated') truncated,
    count(*) FILTER (i < n AND c || next_role[1] NOT IN ('su', 'ua', 'au')) illegal FROM rows GROUP BY g)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT gaps, coalesce(blank, 0)::BIGINT blank, coalesce(duplicate, 0)::BIGINT duplicate,
  coalesce(truncated, 0)::BIGINT truncated, coalesce(illegal, 0)::BIGINT illegal, coalesce(v0.k, 0)::BIGINT AS cost, coalesce(v0.a, '') audit,
  sha256(coalesce(v0.t[2:], '')) repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN (told JOIN done USING (g)) ON o.conv_id IS NOT DISTINCT FROM told.conv_id
"""


@query("op13_turn_repair", _REPAIR_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations repaired at the least cost: what was wrong, the audit, the digest of what came out."""
    return turn_repair.repair_report(read(spark, sf_dir, "conversations"))
