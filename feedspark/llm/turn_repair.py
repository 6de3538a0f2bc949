"""Repair of conversation structure by alignment to the alternating grammar ``(s?(ua)+)?`` of role initials.

Turns that are blank or repeat an earlier one must go. The others are kept, given the role that the grammar wants, or
deleted, and missing turns are inserted, at the least cost; of the cheapest repairs the one whose audit (the edits'
initials) comes first in ASCII is taken. The rows are aligned by Wagner and Fischer's table to the target strings of
every feasible length, inside Ukkonen's band of the cost that a greedy repair reaches, and the audits of the lengths
are traced back and compared.

A conversation of any length is cut into blocks. A block is aligned for every state of the grammar at its start and
end; two neighbouring blocks make one by the cheapest state between them, and this is exact: an audit of given rows
decides its cost, so of two audits of one cost neither begins with the other, and first differences settle
comparisons inside the blocks. Blocks lie in ranges of (conversation, turn), so one conversation's rows may lie in
many tasks, of which only audits meet. Texts take no part in this; they join the edits that keep them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
#: A truncated turn that stays costs so much more.
TRUNCATED = 3
#: Rows aligned in one table, rows of a piece: what lies in one row of the tables of pieces.
BLOCK_ROWS, PIECE_ROWS = 32, 1024

#: States of the grammar: nothing yet, after s, after u, after a. Repairs end in nothing or after a.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
BLANK = r"[^\x20\x09-\x0D]"

#: A row as a code: 4 must go; else 0 u, 1 a, 2 s, 3 other initial, and 8 more if truncated.
GO, CUT_OFF = 4, 8
_WANTED = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}

#: No alignment.
NONE = 1 << 40

Table = dict[tuple[int, int], tuple[int, str]]


def _replace(code: int, char: str) -> int | None:
    """Cost of having a row in the place of a character of the target."""
    if code == GO:
        return None
    more = TRUNCATED if code & CUT_OFF else 0
    if "uas?"[code & 3] == char:
        return KEEP + more
    return None if char == "s" else REROLE + more


def _fill(codes: tuple[int, ...], target: str, live: list[int], wide: int, deep: int) -> list[list[int]]:
    """Wagner and Fischer's table, its columns at most ``wide`` above and ``deep`` below the count of live rows."""
    n, most = len(codes), len(target)
    table = [[NONE] * (most + 1) for _ in range(n + 1)]
    table[0][0] = 0
    for i in range(n + 1):
        row, over = table[i], table[i - 1]
        for j in range(max(0, live[i] - deep), min(most, live[i] + wide) + 1):
            best = row[j]
            if i:
                best = over[j] + DELETE
                if j and (own := _replace(codes[i - 1], target[j - 1])) is not None:
                    best = min(best, over[j - 1] + own)
            if j and target[j - 1] != "s":
                best = min(best, row[j - 1] + INSERT)
            row[j] = min(best, NONE)
    return table


def align(codes: tuple[int, ...], target: str, groups: dict[int, int]) -> dict[int, tuple[int, str]]:
    """Cheapest (cost, audit) per group of target lengths; ``groups`` gives the group of each length.

    One table serves all lengths, as its last row holds the cost of all rows against each prefix of ``target``. A
    narrow band finds an incumbent for every group (wider ones follow until it does); the band of the dearest
    incumbent's cost then holds every alignment that is not dearer: one that is k columns off has k inserts or deletes
    beside the rows that must go.
    """
    n = len(codes)
    live = [0]
    for code in codes:
        live.append(live[-1] + (code != GO))
    must = DELETE * (n - live[n])
    wide = deep = 2
    while True:
        table = _fill(codes, target, live, wide, deep)
        least: dict[int, int] = {}
        for j, group in groups.items():
            least[group] = min(least.get(group, NONE), table[n][j])
        dearest = max(least.values())
        if dearest == NONE:
            wide, deep = 2 * wide, 2 * deep
        elif wide * INSERT < dearest - must or deep * DELETE < dearest - must:
            wide, deep = (dearest - must) // INSERT + 1, (dearest - must) // DELETE + 1
        else:
            break
    out: dict[int, tuple[int, str]] = {}
    for j, group in groups.items():
        if table[n][j] == least[group]:
            found = (least[group], _trace(codes, target, table, j))
            out[group] = min(out.get(group, found), found)
    return out


def _trace(codes: tuple[int, ...], target: str, table: list[list[int]], length: int) -> str:
    """The ASCII-least audit of the cheapest alignments to the first ``length`` characters of the target."""
    n = len(codes)
    onward: dict[tuple[int, int], list[tuple[str, tuple[int, int]]]] = {}  # cells of cheapest alignments, and the ways out
    todo, seen = [(n, length)], {(n, length)}
    while todo:
        cell = i, j = todo.pop()
        cost, back = table[i][j], []
        if i and table[i - 1][j] + DELETE == cost:
            back.append(("D", (i - 1, j)))
        if i and j and (own := _replace(codes[i - 1], target[j - 1])) is not None and table[i - 1][j - 1] + own == cost:
            back.append(("K" if "uas?"[codes[i - 1] & 3] == target[j - 1] else "R", (i - 1, j - 1)))
        if j and target[j - 1] != "s" and table[i][j - 1] + INSERT == cost:
            back.append(("I", (i, j - 1)))
        for letter, before in back:
            onward.setdefault(before, []).append((letter, cell))
            if before not in seen:
                seen.add(before)
                todo.append(before)
    audit, cell = [], (0, 0)
    while cell != (n, length):
        letter, cell = min(onward[cell])
        audit.append(letter)
    return "".join(audit)


@lru_cache(100_000)
def block_table(codes: tuple[int, ...]) -> Table:
    """Cheapest (cost, audit) of a block of rows for every state at its start and end that a repair may have."""
    n = len(codes)
    most = 2 * n + 3
    out: Table = {(q, q): (DELETE * n, "D" * n) for q in range(4)}

    def offer(start: int, end: int, found: tuple[int, str]) -> None:
        out[start, end] = min(out.get((start, end), found), found)

    parity = {j: 2 - j % 2 for j in range(1, most + 1)}
    for target, starts, ends in (("ua" * most, (START, SYSTEM, ASSISTANT), (USER, ASSISTANT)), ("au" * most, (USER,), (ASSISTANT, USER))):
        for group, found in align(codes, target[:most], parity).items():
            for start in starts:
                offer(start, ends[group - 1], found)
    systems = [(code & CUT_OFF, -i) for i, code in enumerate(codes) if code != GO and code & 3 == 2]
    if systems:
        cut, at = min(systems)  # the cheapest, then the last: D comes before K
        offer(START, SYSTEM, (DELETE * (n - 1) + (TRUNCATED if cut else 0), "D" * -at + "K" + "D" * (n + at - 1)))
        for group, found in align(codes, ("s" + "ua" * most)[:most], {j: 2 - (j - 1) % 2 for j in range(2, most + 1)}).items():
            offer(START, (USER, ASSISTANT)[group - 1], found)
    return out


def joined(first: Table, second: Table) -> Table:
    """The table of two neighbouring blocks."""
    out: Table = {}
    for (start, middle), (cost, audit) in first.items():
        for (other, end), (more, rest) in second.items():
            if other == middle and ((start, end) not in out or cost + more <= out[start, end][0]):
                found = (cost + more, audit + rest)
                out[start, end] = min(out.get((start, end), found), found)
    return out


class Chain:
    """Tables of neighbouring blocks, put together in a balanced way as they come."""

    def __init__(self):
        self.parts: list[tuple[int, Table]] = []

    def add(self, table: Table) -> None:
        size = 1
        while self.parts and self.parts[-1][0] <= size:
            held, before = self.parts.pop()
            size, table = held + size, joined(before, table)
        self.parts.append((size, table))

    def whole(self) -> Table:
        return reduce(lambda right, left: joined(left, right), [t for _, t in reversed(self.parts)])


def cheapest(table: Table) -> tuple[int, str]:
    return min(table[START, end] for end in ENDS if (START, end) in table)


def table_of(codes: list[int]) -> Table:
    chain = Chain()
    for at in range(0, len(codes), BLOCK_ROWS):
        chain.add(block_table(tuple(codes[at:at + BLOCK_ROWS])))
    return chain.whole()


def steps(audit: str, initials: list[str], state: int) -> tuple[list[tuple[str, str, int | None]], int]:
    """(edit, role given or '', row) for every edit but deletions, and the state after them."""
    out, row = [], 0
    for letter in audit:
        if letter == "D":
            row += 1
            continue
        char = initials[row] if letter == "K" else _WANTED[state]
        role = "" if letter == "K" else {"u": "user", "a": "assistant"}[char]
        out.append((letter, role, None if letter == "I" else row))
        row += letter != "I"
        state = {"u": USER, "a": ASSISTANT, "s": SYSTEM}[char]
    return out, state


def faulty(turns: DataFrame) -> DataFrame:
    """Rows without their texts: conv_id, turn, role, digest of the text, look ('blank', 'truncated' or ''), how many
    such rows there are, and whether an earlier turn has the role and text."""
    text = F.coalesce("text", F.lit(" "))
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.unhex(F.md5(text.cast("binary"))).alias("digest"),
                        F.when(last == "", F.lit("blank")).when(last.isin(".", "!", "?"), F.lit("")).otherwise(F.lit("truncated")).alias("look"))
    kinds = rows.groupBy("conv_id", "turn", "role", "digest", "look").agg(F.count("*").alias("copies"))
    place = F.struct(F.col("turn").isNotNull(), "turn")
    again = (kinds.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"), F.count("*").alias("turns")).filter("turns > 1")
             .select(*(F.col(c).alias(f"of_{c}") for c in ("conv_id", "role", "digest")), "first"))
    same = F.col("conv_id").eqNullSafe(F.col("of_conv_id")) & (F.col("role") == F.col("of_role")) & (F.col("digest") == F.col("of_digest"))
    return kinds.join(again, same, "left").select(
        "conv_id", "turn", "role", "digest", "look", "copies", F.coalesce(place > F.col("first"), F.lit(False)).alias("later"))


_PIECE = ("piece long, n int, first_initial string, last_initial string, illegal long, blank long, duplicate long, truncated long, "
          "ways array<struct<start:int,end:int,cost:long,audit:string>>, initials array<string>, roles array<string>, "
          "digests array<binary>")


def _piece(conv, number: int, rows: list[tuple]) -> tuple:
    """One row of the table of pieces. rows: (initial, role, digest, fault)."""
    codes = [GO if fault in ("blank", "duplicate") else {"u": 0, "a": 1, "s": 2}.get(initial, 3) + (CUT_OFF if fault == "truncated" else 0)
             for initial, _, _, fault in rows]
    initials = [r[0] for r in rows]
    table = table_of(codes)
    return (conv, number, len(rows), initials[0], initials[-1], illegal_pairs(initials),
            *(sum(r[3] == kind for r in rows) for kind in ("blank", "duplicate", "truncated")),
            [{"start": a, "end": b, "cost": cost, "audit": audit} for (a, b), (cost, audit) in table.items()],
            initials, [r[1] for r in rows], [r[2] for r in rows])


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _aligner(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        conv, rows, out, size = None, [], [], 0

        def cut() -> None:
            nonlocal number, rows, size
            if rows:
                out.append(_piece(conv, number, rows))
                number, size, rows = number + 1, size + len(rows), []

        for batch in batches:
            for c, _, role, digest, look, copies, later in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if c != conv:
                    cut()
                    conv = c
                for k in range(copies):
                    if len(rows) >= PIECE_ROWS:
                        cut()
                    rows.append((role[:1], role, digest, "blank" if look == "blank" else "duplicate" if later or k else look))
                    if size >= 50_000:
                        yield _batch(out, schema)
                        out, size = [], 0
        cut()
        if out:
            yield _batch(out, schema)
    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _settler(schema: pa.Schema):
    """One row per piece with its share of the audit, and one per conversation (piece NULL) with the whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held, out = None, [], []

        def settle() -> None:
            chain, places, state, place, at = Chain(), [], START, 0, 0
            for x in held:
                chain.add({(w["start"], w["end"]): (w["cost"], w["audit"]) for w in x["ways"]})
            cost, audit = cheapest(chain.whole())
            for x in held:
                end, left = at, x["n"]
                while left:
                    left -= audit[end] != "I"
                    end += 1
                if x is held[-1]:
                    end = len(audit)
                done, after = steps(audit[at:end], x["initials"], state)
                places.append((conv, x["piece"], state, place, audit[at:end], *[None] * 5))
                state, place, at = after, place + len(done), end
            illegal = sum(x["illegal"] for x in held) + sum(a["last_initial"] + b["first_initial"] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
            out.extend(places)
            out.append((conv, None, None, None, audit, illegal, cost, *(sum(x[k] for x in held) for k in ("blank", "duplicate", "truncated"))))

        for batch in batches:
            for x in batch.to_pylist():
                if held and x["conv_id"] != conv:
                    settle()
                    held = []
                conv = x["conv_id"]
                held.append(x)
            if len(out) >= 500:
                yield _batch(out, schema)
                out = []
        if held:
            settle()
        if out:
            yield _batch(out, schema)
    return run


_SETTLED = "piece long, state int, place long, audit string, illegal long, cost long, blank long, duplicate long, truncated long"
_EDITS = "position long, edit string, role string, old_role string, digest binary"


def _teller(schema: pa.Schema):
    """The edits of pieces, one row each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                for k, (letter, role, row) in enumerate(steps(x["audit"], x["initials"], x["state"])[0]):
                    old = None if row is None else x["roles"][row]
                    out.append((x["conv_id"], x["place"] + k, letter, role or old, old, None if row is None else x["digests"][row]))
            for at in range(0, len(out), 10_000):
                yield _batch(out[at:at + 10_000], schema)
    return run


def _typed(df: DataFrame, columns: str) -> tuple[str, pa.Schema]:
    """Schema of ``columns`` behind the conversation's id, for Spark and Arrow."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ddl = f"conv_id {df.schema['conv_id'].dataType.simpleString()}, {columns}"
    from pyspark.sql.types import StructType

    return ddl, to_arrow_schema(StructType.fromDDL(ddl))


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The repaired conversations, and what was found and done in each.

    ``turns``: conv_id, turn, role, text; other columns are not read. Rows go by turn, NULL turns first, rows of one
    turn by role and then by the digest of their text; NULL roles and texts are one space, NULL conv_ids one
    conversation. Faults of a row, the first counts: blank (no character but ASCII white space), duplicate (role and
    text were there before), truncated (does not end in ``.!?``). An empty role has no initial and can only be changed.

    First table: conv_id, position, edit (K, R, I), role, text, one row per repaired turn. Second: conv_id, gaps,
    blank, duplicate, truncated, illegal, cost, audit, one row per conversation. Empty tables give no rows.
    """
    pieces_ddl, pieces_arrow = _typed(turns, _PIECE)
    rows = faulty(turns)
    cut = rows.repartitionByRange("conv_id", "turn", "role", "digest").sortWithinPartitions("conv_id", "turn", "role", "digest")
    pieces = stored(cut.mapInArrow(_aligner(pieces_arrow), pieces_ddl), "pieces")
    ddl, arrow = _typed(turns, _SETTLED)
    settled = stored(pieces.drop("roles", "digests").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
                     .mapInArrow(_settler(arrow), ddl), "settled")
    found = settled.filter(F.col("piece").isNull())
    shares = settled.filter(F.col("piece").isNotNull()).select("piece", "state", "place", "audit")
    ddl, arrow = _typed(turns, _EDITS)
    edits = pieces.select("conv_id", "piece", "initials", "roles", "digests").join(shares, "piece").mapInArrow(_teller(arrow), ddl)

    text = F.coalesce("text", F.lit(" "))
    texts = turns.select(F.col("conv_id").alias("of_conv"), F.coalesce("role", F.lit(" ")).alias("of_role"), text.alias("text"),
                         F.unhex(F.md5(text.cast("binary"))).alias("of_digest")).dropDuplicates(["of_conv", "of_role", "of_digest"])
    repaired = edits.join(texts, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("old_role") == F.col("of_role"))
                          & (F.col("digest") == F.col("of_digest")), "left").select(
        "conv_id", "position", "edit", "role", F.coalesce("text", F.lit("")).alias("text"))
    gaps = turns.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).alias("gaps"))
    summary = (found.select("conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.lit(None).cast("long").alias("gaps"))
               .unionByName(gaps.select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps")), allowMissingColumns=True)
               .groupBy("conv_id").agg(*(F.max(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"))))
    return repaired, summary


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults, by crc32 of ``conv_id:turn`` modulo 20: 0 dropped, 1 emptied, 2 without ``.!?``,
    3 twice, 4 by the user. NULLs are one space, in the checksum as well; a NULL turn stays NULL as a place."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def _hasher(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, out = None, None, []
        for batch in batches:
            for c, role, text in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                line = f"{role}:{text}".encode("utf-8", "surrogatepass")
                if digest is None or c != conv:
                    if digest is not None:
                        out.append((conv, digest.hexdigest()))
                    conv, digest = c, hashlib.sha256(line)
                else:
                    digest.update(b"\n" + line)
            if len(out) >= 5000:
                yield _batch(out, schema)
                out = []
        if digest is not None:
            out.append((conv, digest.hexdigest()))
        if out:
            yield _batch(out, schema)
    return run


def repair_report(turns: DataFrame) -> DataFrame:
    """One row per conversation of ``turns``: what the repair of its damaged rows found, cost and did, and the digest of
    the repaired lines ``role:text``. The digest is one stream over a conversation, never a list of it."""
    repaired, summary = repair(stored(damaged(turns), "damaged"))
    ddl, arrow = _typed(turns, "repaired_sha256 string")
    digests = (repaired.repartition("conv_id").sortWithinPartitions("conv_id", "position").select("conv_id", "role", "text")
               .mapInArrow(_hasher(arrow), ddl))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    rows = (turns.select("conv_id").distinct().unionByName(summary, allowMissingColumns=True)
            .unionByName(digests, allowMissingColumns=True))
    return rows.groupBy("conv_id").agg(
        *(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
