"""Repair of the structure of conversations by scalar big-integer weights.

A conversation is to read ``(system? (user assistant)+)?``.  Its turns may be kept,
given another role, deleted, and empty turns inserted; each edit has a cost and a
letter, and among the cheapest repairs that with the least audit (the letters in order)
is taken.  One integer stands for both: its high digits are the cost, its low digits
the letters by position, three bits each, first letter on top, zeros behind the last
one.  The smaller integer is the cheaper repair, or the one whose audit comes first, so
an ordinary minimum over a DAG (turns left to go x roles seen) decides everything.

A conversation may hold any share of the turns.  It is cut into blocks of ``BLOCK``
turns.  Letters decide a tie at the first edit in which two repairs differ, and each
letter leads to one role, so what follows a block matters by its cost alone: a block
needs the cost of the rest for each role it may end in.  These are found from the end:
every block gives the costs from each role to each, one row a block, and a scan from
the last block to the first adds them up.  Then each block is decided for each role it
may begin in, and a scan from the first block picks the one that happens.  Turns are
numbered, and repeats found, by counts of blocks too.

Defined cases: in keys, roles and texts a null is one space; the turns of a null
conversation are a conversation; null turns come first; turns of one number are ordered
by role and text; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

BLOCK = 256
# Roles seen: none, then the last one.
NONE, SYSTEM, USER, ASSISTANT = range(4)
INSERTED = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEEPS = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LETTERS = ".DIKR"  # by code; 0 ends an audit
CODE = {letter: code for code, letter in enumerate(LETTERS)}
COST = {"K": 0, "R": 2, "D": 3, "I": 2}
FAR = 1 << 40  # no way
# What the end of a conversation costs: a last user wants an answer, a lone system turn
# a user and an answer.
END = (0, 2 * COST["I"], COST["I"], 0)
MATRIX = "array<array<long>>"
CHOICE = "array<struct<ends:int,audit:string>>"


class Weights:
    """Cost and audit of up to ``most`` letters as one integer."""

    def __init__(self, most: int):
        self.top = 3 * (most - 1)
        self.bits = 3 * most
        self.low = (1 << self.bits) - 1

    def of(self, cost: int) -> int:
        return cost << self.bits

    def cost(self, weight: int) -> int:
        return weight >> self.bits

    def edit(self, letter: str, more: int, rest: int) -> int:
        """``letter`` before the edits of ``rest``; their letters move one place on."""
        return self.of(self.cost(rest) + COST[letter] + more) | CODE[letter] << self.top | (rest & self.low) >> 3

    def audit(self, weight: int) -> str:
        out, left = [], weight & self.low
        while left:
            out.append(LETTERS[left >> self.top])
            left = left << 3 & self.low
        return "".join(out)


def moves(turn: str, role: int) -> Iterator[tuple[str, int, int]]:
    """(letter, extra cost, role after) of the edits of a turn.

    ``turn`` is its initial, upper case if it is cut short, or ``x`` if it must go.
    """
    yield "D", 0, role
    if turn != "x":
        short = int(turn.isupper())
        if (role, turn.lower()) in KEEPS:
            yield "K", short, KEEPS[role, turn.lower()]
        yield "R", short, INSERTED[role]


@lru_cache(maxsize=1 << 14)
def least(turns: str, ends: tuple[int, ...]) -> tuple[tuple[int, str], ...]:
    """(cost, audit) of the best edits of a block by the role before it, given the cost
    of the rest by the role after it."""
    weights = Weights(3 * len(turns) + 3)
    after = [weights.of(min(e, FAR)) for e in ends]
    for turn in reversed(turns):
        before = [min(weights.edit(letter, more, after[to]) for letter, more, to in moves(turn, role)) for role in range(4)]
        # Inserts in front of the turn; more than two never pay.
        one = [weights.edit("I", 0, before[INSERTED[role]]) for role in range(4)]
        two = [weights.edit("I", 0, one[INSERTED[role]]) for role in range(4)]
        after = [min(ways) for ways in zip(before, one, two)]
    return tuple((weights.cost(w), weights.audit(w)) for w in after)


def replay(turns: str, audit: str, role: int) -> int:
    """The role after the edits of a block."""
    at = 0
    for letter in audit:
        if letter in "IR":
            role = INSERTED[role]
        elif letter == "K":
            role = KEEPS[role, turns[at].lower()]
        at += letter != "I"
    return role


def costs(turns: str) -> list[list[int]]:
    """Least cost of a block from each role (rows) to each."""
    columns = [[cost for cost, _ in least(turns, tuple(0 if e == to else FAR for e in range(4)))] for to in range(4)]
    return [[min(column[role], FAR) for column in columns] for role in range(4)]


def choices(turns: str, ends: tuple[int, ...]) -> list[dict]:
    return [{"ends": replay(turns, audit, role), "audit": audit} for role, (_, audit) in enumerate(least(turns, ends))]


def column_map(names: list[str], fn, out: str, kind: pa.DataType):
    """Batches with one more column, a function of each row's ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fn(*row) for row in zip(*(batch.column(n).to_pylist() for n in names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, kind)], names=[*batch.schema.names, out])

    return run


def from_the_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost of what follows each block; blocks come sorted by conversation, last first."""
    key, ends = None, END
    for batch in batches:
        out = []
        for name, matrix in zip(batch.column("_conv").to_pylist(), batch.column("matrix").to_pylist()):
            if name != key:
                key, ends = name, END
            out.append(list(ends))
            ends = tuple(min(FAR, *(row[to] + ends[to] for to in range(4))) for row in matrix)
        yield pa.RecordBatch.from_arrays([batch.column("_conv"), batch.column("_block"), pa.array(out, pa.list_(pa.int64()))], names=["_conv", "_block", "ends"])


def from_the_start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The role before each block; blocks come sorted by conversation, first first."""
    key, role = None, NONE
    for batch in batches:
        out = []
        for name, ends in zip(batch.column("_conv").to_pylist(), batch.column("to").to_pylist()):
            if name != key:
                key, role = name, NONE
            out.append(role)
            role = ends[role]
        yield pa.RecordBatch.from_arrays([batch.column("_conv"), batch.column("_block"), pa.array(out, pa.int32())], names=["_conv", "_block", "role"])


def conversation_key(conv_id: str) -> Column:
    return F.when(F.col(conv_id).isNull(), "").otherwise(F.concat(F.lit("="), F.col(conv_id).cast("string")))


def numbered(turns: DataFrame) -> DataFrame:
    """``_at``: place in the conversation, from 0, by turn, role, text and copy.

    Turns are dealt by ranges of this order, so that a conversation, a turn number or a
    repeated turn may hold any share of them; ranges are counted first.
    """
    order = [F.col("turn").asc_nulls_first(), *[F.col(c).asc() for c in ("role", "text", "_copy", "_tie")]]
    dealt = turns.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange("_conv", *order)
    dealt = C.stash(dealt.withColumn("_range", F.spark_partition_id()), "turns")
    sizes = dealt.groupBy("_conv", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_conv").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_conv", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_conv", "_range").orderBy(*order)
    placed = dealt.join(starts, ["_conv", "_range"]).withColumn("_at", (F.col("_start") + F.row_number().over(inside) - 1).cast("long"))
    return placed.drop("_range", "_start", "_tie")


def faults(turns: DataFrame) -> DataFrame:
    """Turns (``_conv``, ``turn``, ``role``, ``text``, ``_copy``) with place ``_at``,
    ``fault`` and ``_code``, what an edit must know of the turn."""
    placed = C.stash(numbered(turns), "places")
    first = placed.groupBy("_conv", "role", F.sha2(F.col("text").cast("binary"), 256).alias("_t")).agg(F.min("_at").alias("_at"))
    known = placed.join(first.select("_conv", "_at", F.lit(True).alias("_first")), ["_conv", "_at"], "left")
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(last == "", "blank").when(F.col("_first").isNull(), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    code = F.when(fault.isin("blank", "duplicate"), "x").when(fault == "truncated", F.upper(letter)).otherwise(letter)
    return known.select("_conv", "turn", "role", "text", "_at", fault.alias("fault"), code.alias("_code"))


def edits(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(_conv, _block, role, audit): the edits of each block of each conversation.

    ``turns`` has ``_conv``, ``_at`` and ``_code``.
    """
    letters = F.sort_array(F.collect_list(F.struct("_at", "_code")))  # at most ``block`` of them
    coded = turns.groupBy("_conv", F.floor(F.col("_at") / block).cast("long").alias("_block")).agg(letters.alias("l"))
    blocks = C.stash(coded.select("_conv", "_block", F.concat_ws("", "l._code").alias("turns")), "blocks")
    last = blocks.groupBy("_conv").agg(F.max("_block").alias("_last")).where("_last > 0")
    many = C.stash(blocks.join(last, "_conv"), "long")
    matrix = column_map(["turns"], costs, "matrix", pa.list_(pa.list_(pa.int64())))
    costed = many.select("_conv", "_block", "turns").mapInArrow(matrix, f"_conv string, _block long, turns string, matrix {MATRIX}").drop("turns")
    ends = costed.repartition("_conv").sortWithinPartitions("_conv", F.desc("_block")).mapInArrow(from_the_end, "_conv string, _block long, ends array<long>")
    whole = F.array(*[F.lit(e).cast("long") for e in END])
    known = blocks.join(ends, ["_conv", "_block"], "left").select("_conv", "_block", "turns", F.coalesce("ends", whole).alias("ends"))
    choose = column_map(["turns", "ends"], lambda turns, ends: choices(turns, tuple(ends)), "choice", pa.list_(pa.struct([("ends", pa.int32()), ("audit", pa.string())])))
    chosen = C.stash(known.mapInArrow(choose, f"_conv string, _block long, turns string, ends array<long>, choice {CHOICE}"), "choices")
    linked = chosen.select("_conv", "_block", F.col("choice.ends").alias("to")).join(many.select("_conv", "_block"), ["_conv", "_block"], "left_semi")
    roles = linked.repartition("_conv").sortWithinPartitions("_conv", "_block").mapInArrow(from_the_start, "_conv string, _block long, role int")
    found = chosen.join(roles, ["_conv", "_block"], "left").withColumn("role", F.coalesce("role", F.lit(NONE)))
    mine = F.col("choice")[F.col("role")]
    closing = F.when(F.lead("_block").over(Window.partitionBy("_conv").orderBy("_block")).isNull(), F.element_at(F.array(*[F.lit("I" * (e // COST["I"])) for e in END]), mine["ends"] + 1))
    return found.select("_conv", "_block", "role", F.concat(mine["audit"], F.coalesce(closing, F.lit(""))).alias("audit"), "turns")


def spelled(turns: str, audit: str, role: int) -> list[dict]:
    """The edits of a block one by one: letter, turn of the block, role given."""
    out, at = [], 0
    for letter in audit:
        given = None
        if letter in "IR":
            role = INSERTED[role]
            given = NAMES[role]
        elif letter == "K":
            role = KEEPS[role, turns[at].lower()]
        out.append({"edit": letter, "turn": None if letter == "I" else at, "role": given})
        at += letter != "I"
    return out


def repair(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """The edits of every conversation in order: ``_conv``, ``_block``, ``_place``,
    ``edit``, ``turn``, ``role``, ``text`` and ``fault``.

    ``turns`` are those of ``faults``.  Deleted turns are rows too; inserted ones have an
    empty text and no turn number.
    """
    kind = pa.list_(pa.struct([("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string())]))
    spell = column_map(["turns", "audit", "role"], spelled, "e", kind)
    each = edits(turns, block).select("_conv", "_block", "turns", "audit", "role")
    rows = each.mapInArrow(spell, "_conv string, _block long, turns string, audit string, role int, e array<struct<edit:string,turn:long,role:string>>")
    rows = rows.select("_conv", "_block", F.posexplode("e").alias("_place", "e"))
    rows = rows.select("_conv", "_block", "_place", F.col("e.edit").alias("edit"), (F.col("_block") * block + F.col("e.turn")).alias("_at"), F.col("e.role").alias("_given"))
    # Inserted turns meet no other, each under a number of its own.
    rows = rows.withColumn("_key", F.coalesce("_at", -1 - (F.col("_block") * 3 * (block + 1) + F.col("_place"))))
    own = turns.select(F.col("_conv").alias("_c"), F.col("_at").alias("_turn"), "turn", "role", "text", "fault")
    joined = rows.join(own, (F.col("_conv") == F.col("_c")) & (F.col("_key") == F.col("_turn")), "left")
    role = F.coalesce("_given", "role")
    return joined.select("_conv", "_block", "_place", "edit", "_at", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"), "fault")


def hashed_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and SHA-256 of each conversation's lines, which come in order."""
    import hashlib

    key, digest, letters, lines = None, None, [], 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (key, "".join(letters), digest.hexdigest())], names=["_conv", "audit", "repaired_sha256"])

    for batch in batches:
        for name, edit, role, text in zip(*(batch.column(c).to_pylist() for c in ("_conv", "edit", "role", "text"))):
            if digest is None or name != key:
                if digest is not None:
                    yield done()
                key, digest, letters, lines = name, hashlib.sha256(), [], 0
            letters.append(edit)
            if edit != "D":
                digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                lines += 1
    if digest is not None:
        yield done()


def report(conversations: DataFrame, turns: DataFrame, conv_id: str = "conv_id", block: int = BLOCK) -> DataFrame:
    """One row per conversation of ``conversations``: gaps, faults, cost, audit and the
    checksum of the repaired lines.

    A checksum over the lines of a conversation has to see them one after another: they
    stream through a task in order, and nothing but the state of the hash is held.
    """
    seen = faults(turns)
    follows = F.concat(F.substring(F.lag("role").over(Window.partitionBy("_conv", "_b").orderBy("_at")), 1, 1), F.substring("role", 1, 1))
    # Neighbours across blocks: the last turn of a block is also the first of the next.
    twice = seen.select("_conv", "_at", "role", F.explode(F.array_distinct(F.array(F.floor(F.col("_at") / block), F.floor((F.col("_at") + 1) / block)))).alias("_b"))
    illegal = twice.withColumn("_pair", follows).where(~F.col("_pair").isin("su", "ua", "au")).groupBy("_conv").agg(F.count(F.lit(1)).alias("illegal"))
    kinds = [F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")]
    span = seen.groupBy("_conv", "turn").agg(*kinds).groupBy("_conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    done = C.stash(repair(seen, block), "edits")
    price = F.element_at(F.create_map(*[F.lit(x) for pair in COST.items() for x in pair]), F.col("edit"))
    short = F.when((F.col("fault") == "truncated") & (F.col("edit") != "D"), 1).otherwise(0)
    cost = done.groupBy("_conv").agg(F.sum(price + short).cast("long").alias("cost"))
    lines = done.repartition("_conv").sortWithinPartitions("_conv", "_block", "_place").select("_conv", "edit", "role", "text")
    hashed = lines.mapInArrow(hashed_lines, "_conv string, audit string, repaired_sha256 string")
    every = conversations.groupBy(conv_id).agg(F.lit(1).alias("_one")).select(F.col(conv_id), conversation_key(conv_id).alias("_conv"))
    out = every
    for part in (span, illegal, cost, hashed):
        out = out.join(part, "_conv", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(conv_id, *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def blank(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def as_turns(conversations: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """The columns ``faults`` reads."""
    return conversations.select(conversation_key(conv_id).alias("_conv"), "turn", blank("role").alias("role"), blank("text").alias("text"), F.lit(0).alias("_copy"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The same of turns of which every twentieth each is dropped, emptied, robbed of its
    ends of sentences, repeated, and given to the user."""
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select(kind.alias("_kind"), conversation_key("conv_id").alias("_conv"), "turn", blank("role").alias("role"), blank("text").alias("text"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("_kind <> 0").select("_conv", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy"))
