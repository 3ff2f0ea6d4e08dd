"""Repair of conversations by weighted finite-state composition (operator 12).

The rows of a conversation are an input acceptor, the edits a transducer, and the order of roles an acceptor. Their
composition is made as far as it is visited. Its states are sorted by row and by insertions since that row, and a shortest
path to the end is found from the last to the first over weights (cost, edits as a string): a string that gets a letter in
front keeps its place among others, so strings are compared by that letter and the place of the rest, never in full.

A conversation may be longer than a task can hold. Rows are dealt by ranges of (conversation, turn); a conversation that
lies within a task is repaired there. One that doesn't is cut into blocks, each summed up as the cheapest paths between any
two states of the role acceptor, by cost and place among the strings, and the sums choose the states between blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, partial
from itertools import count, groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import bounded_batches, lookup, staged, table, tidy

# What edits cost, and an undeleted truncated row besides; the order of roles, its states and final ones.
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
GRAMMAR: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
SPACE, STOPS = " \t\n\x0b\x0c\r", (".", "!", "?")

#: First faults of a row.
SOUND, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3
#: Rows and characters of a block of a conversation that doesn't lie within a task, or is longer.
BLOCK_ROWS, BLOCK_CHARS = 4096, 4 << 20

#: Of a state: cost, and place of its string among those of all states there; None: no path.
Weight = tuple[int, int] | None
#: An edit of a row: cost, letter, initial of the role that is given out, if any. A row: (initial, cut) or GONE.
Kind = tuple[str, bool] | None
GONE: Kind = None


def edits(kind: Kind) -> Iterator[tuple[int, str, str | None]]:
    """The edit transducer's arcs that read a row."""
    yield DELETE, "D", None
    if kind is not GONE:
        initial, cut = kind
        yield CUT * cut, "K", initial
        for role in NAMES:
            yield REROLE + CUT * cut, "R", role


def layer(rows: list[list[tuple[int, str, int]]], ahead: tuple[Weight, ...]) -> tuple[tuple[Weight, ...], tuple]:
    """Shortest paths from each state of the role acceptor, before insertions and one more arc, given those after it.

    rows: for each state the arcs (cost, letter, state) that go ahead. ahead has one or more columns of a weight for each
    state. Returns weights alike, and for each the letters taken and the state then. A shortest path doesn't come to a
    composed state twice, so fewer insertions than the acceptor has states stand between two rows.
    """
    n = len(GRAMMAR)
    deeper: tuple[Weight, ...] = (None,) * len(ahead)
    taken: tuple = (None,) * len(ahead)
    for _ in range(n):
        best, chosen = [], []
        for at in range(len(ahead)):
            column, g = at - at % n, at % n
            ways = [(w[0] + cost, letter, w[1], letter, to) for cost, letter, to in rows[g] if (w := ahead[column + to])]
            for role in NAMES:
                to = GRAMMAR[g].get(role)
                if to is not None and (w := deeper[column + to]):
                    ways.append((w[0] + INSERT, "I", w[1], "I" + taken[column + to][0], taken[column + to][1]))
            way = min(ways, default=None)
            best.append(way and way[:3])
            chosen.append(way and way[3:])
        places = {key: k for k, key in enumerate(sorted({b[1:] for b in best if b}))}
        deeper, taken = tuple(b and (b[0], places[b[1:]]) for b in best), tuple(chosen)
    return deeper, taken


@lru_cache(1 << 14)
def before(kind: Kind, ahead: tuple[Weight, ...]) -> tuple[int, tuple[Weight, ...], tuple]:
    """One row of the composition: what all weights have in common, the rest, and the choices."""
    rows = [[(cost, letter, g if role is None else GRAMMAR[g][role]) for cost, letter, role in edits(kind) if role is None or role in GRAMMAR[g]] for g in range(len(GRAMMAR))]
    weights, chosen = layer(rows, ahead)
    least = min(w[0] for w in weights if w)
    return least, tuple(w and (w[0] - least, w[1]) for w in weights), chosen


@lru_cache(1)
def at_end() -> tuple[tuple[Weight, ...], tuple]:
    """After the last row: insertions up to a final state."""
    return layer([[(0, "", g)] if g in FINAL else [] for g in range(len(GRAMMAR))], ((0, 0),) * len(GRAMMAR))


def identity() -> tuple[Weight, ...]:
    """A column for each state in which a path may end."""
    n = len(GRAMMAR)
    return tuple((0, 0) if column == g else None for column in range(n) for g in range(n))


def backwards(kinds: Iterable[tuple[Kind, int]], ahead: tuple[Weight, ...]) -> tuple[int, tuple[Weight, ...], list[tuple[tuple, int]]]:
    """Shortest paths over rows (kind, how often): a common cost, weights, and the choices from the last row to the first,
    each with the number of equal rows that it is for."""
    base, choices = 0, []
    for kind, times in reversed(list(kinds)):
        while times:
            cost, weights, chosen = before(kind, ahead)
            k = times if weights == ahead else 1
            base, times, ahead = base + cost * k, times - k, weights
            choices.append((chosen, k))
    return base, ahead, choices


def forwards(choices: list[tuple[tuple, int]], g: int, column: int = 0) -> Iterator[str]:
    """The letters of the rows from state g on, in a column; equal rows that change no state come at once."""
    for chosen, k in reversed(choices):
        while k:
            letters, to = chosen[column * len(GRAMMAR) + g]
            n = k if to == g else 1
            g, k = to, k - n
            yield letters * n


@dataclass
class Row:
    turn: int | None
    role: str
    text: str
    times: int
    fault: int

    def kinds(self) -> list[tuple[Kind, int]]:
        if self.fault in (BLANK, DUPLICATE):
            return [(GONE, self.times)]
        return [((self.role[:1], self.fault == TRUNCATED), min(1, self.times)), (GONE, max(0, self.times - 1))]


@dataclass
class Facts:
    """What is counted in a stretch of a conversation, and what its neighbours need to know."""

    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    first_role: str | None = None
    last_role: str | None = None
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0

    def then(self, other: Facts) -> Facts:
        """Of this stretch and the next one."""
        return Facts(
            self.turns + other.turns - (self.last_turn is not None and self.last_turn == other.first_turn),
            other.first_turn if self.first_turn is None else self.first_turn, self.last_turn if other.last_turn is None else other.last_turn,
            other.first_role if self.first_role is None else self.first_role, self.last_role if other.last_role is None else other.last_role,
            self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated,
            self.illegal + other.illegal + (self.last_role is not None and other.first_role is not None and self.last_role + other.first_role not in LEGAL),
        )

    @property
    def gaps(self) -> int:
        return 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns


def facts(rows: list[Row]) -> Facts:
    out = Facts()
    for r in rows:
        if r.times:
            i, blank, known = r.role[:1], r.fault == BLANK, r.fault == DUPLICATE
            copies = (r.times - 1) * (i + i not in LEGAL)
            out = out.then(Facts(int(r.turn is not None), r.turn, r.turn, i, i, r.times * blank, r.times * known + (r.times - 1) * (not blank and not known), int(r.fault == TRUNCATED), copies))
    return out


def repaired(rows: list[Row], letters: Iterator[str], g: int, last: bool) -> tuple[str, list[tuple[str, str]], int]:
    """The edits of rows as they are told, the rows then, and the state of the role acceptor; last: insertions may follow."""
    audit, out = [], []

    def take(found: str, row: Row | None) -> None:
        nonlocal g
        for x in found.rstrip("D") if row else found:
            if x != "D":
                role = row.role[:1] if x == "K" else next(i for i in NAMES if i in GRAMMAR[g])
                out.append((row.role if x == "K" else NAMES[role], "" if x == "I" else row.text))
                g = GRAMMAR[g][role]
        audit.append(found)

    for r in rows:
        left = r.times
        while left:
            found = next(letters)
            take(found, r)
            left -= sum(map(found.count, "KRD"))
    if last:
        take(at_end()[1][g][0], None)
    return "".join(audit), out, g


def faults(rows: DataFrame) -> DataFrame:
    """rows with fault and digest. A row is a duplicate if a row of an earlier turn, nulls first, has its role and text."""
    trimmed = F.rtrim("text", F.lit(SPACE))
    own = rows.withColumn("digest", F.unhex(F.md5("text"))).withColumn("own", F.when(trimmed == "", BLANK).when(F.right(trimmed, F.lit(1)).isin(*STOPS), SOUND).otherwise(TRUNCATED))
    keys = ["conv_id", "role", "digest"]
    first = own.where("times > 0").groupBy(*keys).agg(F.max(F.col("turn").isNull()).alias("from_null"), F.min("turn").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = lookup(own, staged(first, "conversation-texts"), keys, "n")
    again = F.when(F.col("from_null"), F.col("turn").isNotNull()).otherwise(F.coalesce(F.col("turn").isNull() | (F.col("turn") > F.col("least")), F.lit(False)))
    known = F.col("from_null").isNotNull() & again
    return met.withColumn("fault", F.when(F.col("own") == BLANK, BLANK).when(known, DUPLICATE).otherwise(F.col("own"))).drop("own", "from_null", "least")


#: Columns of rows on their way, by which rows are equal.
EQUAL = ["conv_id", "turn", "role", "digest", "text", "fault"]
ROWS = "conv_id long, turn long, role string, digest binary, text string, fault int, times long"


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch become one, so that a group of equal rows doesn't meet in one task."""
    for batch in batches:
        yield from pa.Table.from_batches([batch]).group_by(EQUAL).aggregate([("times", "sum")]).select([*EQUAL, "times_sum"]).rename_columns([*EQUAL, "times"]).combine_chunks().to_batches()


FACTS = "turns long, first_turn long, last_turn long, first_role string, last_role string, blank long, duplicate long, truncated long, illegal long"
FACT_NAMES = [x.split()[0] for x in FACTS.split(", ")]
#: A whole conversation has edits and repaired rows; a block has its rows and, for each pair of states, cost and place.
CUTS = f"conv_id long, part int, block int, whole boolean, {FACTS}, cost long, audit string, repaired array<struct<role:string,text:string>>, rows array<struct<turn:long,role:string,text:string,times:long,fault:int>>, costs array<long>, places array<int>"
_text = pa.struct([("role", pa.string()), ("text", pa.string())])
_row = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("times", pa.int64()), ("fault", pa.int32())])
_FACTS_ARROW = [(n, pa.string() if n in ("first_role", "last_role") else pa.int64()) for n in FACT_NAMES]
CUTS_ARROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("whole", pa.bool_()), *_FACTS_ARROW, ("cost", pa.int64()), ("audit", pa.string()), ("repaired", pa.list_(_text)), ("rows", pa.list_(_row)), ("costs", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])


@dataclass
class Open:
    """A conversation that is being read."""

    conv: int | None
    first: bool
    rows: list[Row] = field(default_factory=list)
    chars: int = 0
    cut: bool = False
    key: tuple | None = None


@tidy
def _cut(batches: Iterator[pa.RecordBatch], block_rows: int, block_chars: int) -> Iterator[pa.RecordBatch]:
    """Rows in order to conversations or blocks of them. The first and the last of a task may go on in another one."""
    part, numbers, now, out, size = TaskContext.get().partitionId(), count(), None, [], 0

    def head(o: Open, whole: bool) -> dict:
        return {"conv_id": o.conv, "part": part, "block": next(numbers), "whole": whole, **vars(facts(o.rows))}

    def block(o: Open) -> dict:
        base, weights, _ = backwards((k for r in o.rows for k in r.kinds()), identity())
        found = {**head(o, False), "rows": [vars(r) for r in o.rows], "costs": [w and w[0] + base for w in weights], "places": [w and w[1] for w in weights]}
        o.rows, o.chars, o.cut = [], 0, True
        return found

    def whole(o: Open) -> dict:
        base, weights, choices = backwards((k for r in o.rows for k in r.kinds()), at_end()[0])
        audit, texts, _ = repaired(o.rows, forwards(choices, 0), 0, True)
        return {**head(o, True), "cost": base + weights[0][0], "audit": audit, "repaired": [{"role": r, "text": t} for r, t in texts]}

    for batch in batches:
        for conv, turn, role, digest, text, fault, times in zip(*(batch.column(k).to_pylist() for k in (*EQUAL[:4], "text", "fault", "times")), strict=True):
            if now is None or conv != now.conv:
                if now is not None:
                    out.append(block(now) if now.first or now.cut else whole(now))
                now = Open(conv, now is None)
            if now.key == (turn, role, digest):
                now.rows[-1].times += times
                continue
            if len(now.rows) >= block_rows or now.chars >= block_chars:
                out.append(block(now))
            now.rows.append(Row(turn, role, text, times, fault))
            now.chars, now.key, size = now.chars + len(text), (turn, role, digest), size + len(text)
            if size >= block_chars and out:
                yield pa.RecordBatch.from_pylist(out, CUTS_ARROW)
                out, size = [], 0
    if now is not None:
        out.append(block(now))
    if out:
        yield pa.RecordBatch.from_pylist(out, CUTS_ARROW)


CHOICES = f"conv_id long, part int, block int, enters int, leaves int, last boolean, {FACTS}, cost long"
CHOICES_ARROW = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("enters", pa.int32()), ("leaves", pa.int32()), ("last", pa.bool_()), *_FACTS_ARROW, ("cost", pa.int64())])


def by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Runs of rows of one conversation; each is read before the next one."""
    yield from groupby((row for batch in batches for row in batch.to_pylist()), key=lambda row: row["conv_id"])


@tidy
def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states between the blocks of a conversation, whose sums come in order. Facts and cost stand at its first block."""
    n = len(GRAMMAR)
    for conv, rows in by_conversation(batches):
        ids, sums, total = [], [], Facts()
        for r in rows:
            ids.append((r["part"], r["block"]))
            sums.append(tuple(c if c is None else (c, p) for c, p in zip(r["costs"], r["places"], strict=True)))
            total = total.then(Facts(**{k: r[k] for k in FACT_NAMES}))
        ahead, ways = at_end()[0], []
        for weights in reversed(sums):
            best = []
            for g in range(n):
                best.append(min(((w[0] + a[0], w[1], a[1], c) for c in range(n) if (w := weights[c * n + g]) and (a := ahead[c])), default=None))
            places = {key: k for k, key in enumerate(sorted({b[1:3] for b in best if b}))}
            ahead = tuple(b and (b[0], places[b[1:3]]) for b in best)
            ways.append([b and b[3] for b in best])
        g, out = 0, []
        for k, (part, block) in enumerate(ids):
            to = ways[-1 - k][g]
            out.append({"conv_id": conv, "part": part, "block": block, "enters": g, "leaves": to, "last": k + 1 == len(ids)} | ({**vars(total), "cost": ahead[0][0]} if k == 0 else {}))
            g = to
            if len(out) == BLOCK_ROWS or k + 1 == len(ids):
                yield pa.RecordBatch.from_pylist(out, CHOICES_ARROW)
                out = []


PIECES = f"conv_id long, part int, block int, {FACTS}, cost long, audit string, repaired array<struct<role:string,text:string>>"
PIECES_ARROW = pa.schema([f for f in CUTS_ARROW if f.name not in ("whole", "rows", "costs", "places")])


@tidy
def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the states at both ends to their edits and repaired rows."""
    for batch in batches:
        for b in batch.to_pylist():
            rows = [Row(**r) for r in b["rows"]]
            _, _, choices = backwards((k for r in rows for k in r.kinds()), identity())
            audit, texts, _ = repaired(rows, forwards(choices, b["enters"], b["leaves"]), b["enters"], b["last"])
            yield pa.RecordBatch.from_pylist([{**{k: b[k] for k in ("conv_id", "part", "block", "cost", *FACT_NAMES)}, "audit": audit, "repaired": [{"role": r, "text": t} for r, t in texts]}], PIECES_ARROW)


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, DataFrame]:
    """PIECES of the repaired conversations of rows(conv_id, turn, role, text, times): those that are one piece, and those
    that are several, in order of part and block. The counts of a conversation and its cost stand in its first piece.

    times: how often the row stands there, one copy after the other; a conversation whose rows all have 0 is empty. Rows
    are taken by turn, nulls first, then by role and digest of the text; equal rows of a turn stand together. Null roles
    and texts are an error of the caller; a null id is a conversation of its own. Other columns don't matter. No rows give
    no rows. An empty role has no legal place. What a task holds follows its longest text and a block.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    order = ["conv_id", "turn", "role", "digest"]
    known = faults(rows.select("conv_id", "turn", "role", "text", "times")).select(*(F.col(x.split()[0]).cast(x.split()[1]) for x in ROWS.split(", ")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = known.mapInArrow(_combine, ROWS).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    cuts = staged(dealt.mapInArrow(partial(_cut, block_rows=block_rows, block_chars=block_chars), CUTS), "conversation-cuts")
    pieces = [x.split()[0] for x in PIECES.split(", ")[:-1]] + ["repaired"]
    blocks = cuts.where("NOT whole")
    sums = blocks.select("conv_id", "part", "block", *FACT_NAMES, "costs", "places").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    chosen = sums.mapInArrow(_choose, CHOICES).drop("conv_id")
    # part and block name a block; rows come from one side, facts of the whole conversation from the other.
    several = blocks.select("conv_id", "part", "block", "rows").join(chosen, ["part", "block"]).mapInArrow(_apply, PIECES)
    return cuts.where("whole").select(*pieces), several


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
RESULT_ARROW = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.split() for x in RESULT.split(", "))])


@tidy
def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for conv, pieces in by_conversation(batches):
        sha, audit, begun, first = hashlib.sha256(), [], False, None
        for p in pieces:
            first = first or p
            audit.append(p["audit"])
            for r in p["repaired"]:
                sha.update(("\n" * begun + f"{r['role']}:{r['text']}").encode())
                begun = True
        total = Facts(**{k: first[k] for k in FACT_NAMES})
        yield pa.RecordBatch.from_pylist([{"conv_id": conv, "gaps": total.gaps, "blank": total.blank, "duplicate": total.duplicate, "truncated": total.truncated, "illegal": total.illegal, "cost": first["cost"], "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], RESULT_ARROW)


def digests(one: DataFrame, several: DataFrame) -> DataFrame:
    """RESULT of repair(): of conversations in one piece by an expression, of others piece by piece, as a digest is read from
    start to end; no task holds more than a piece and the edits' letters."""
    text = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    plain = one.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(text.cast("binary"), 256).alias("repaired_sha256"))
    return plain.unionByName(several.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").mapInArrow(_put_together, RESULT))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of conversations with nulls as one space and, by the CRC of conversation and turn, a damage: dropped, emptied,
    without stops, twice, by a user."""

    def plain(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    how = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    text = F.when(how == 1, "").when(how == 2, F.translate(plain("text"), ".!?", "")).otherwise(plain("text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(how == 4, "user").otherwise(plain("role")).alias("role"), text.alias("text"),
        F.when(how == 0, 0).when(how == 3, 2).otherwise(1).cast("long").alias("times"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(*repair(damaged(table(spark, sf_dir, "conversations"))))
