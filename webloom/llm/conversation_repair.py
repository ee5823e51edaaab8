"""Repair of conversation structure by lazy weighted determinisation.

A conversation should be one optional system turn and then pairs of a user and an assistant turn. The edits
that may make it so (keep, give another role, delete, insert) are a weighted automaton of four states.
Reading a conversation gives each state a cost; the cost vector less its least cost is a state of a
deterministic automaton, which is found when it is first met and kept in a transition table, so most turns
cost one look into the table. What such vectors can be is finite: a state that another one beats for certain
is left out. A second pass from the end follows the arcs whose costs are tight, through a table of its own,
and keeps the states of cheapest repairs with each one's first edit in ASCII order; reading off the
edits from the start gives the audit.

Conversations are dealt by a hash and streamed in order. One with too many turns for a task is cut into
blocks by range: a block's costs from each state to each are a matrix, the matrices are multiplied along the
conversation, which gives the costs before each block and the states alive behind it, and blocks are
then traced in tasks of their own. Only the digest of the repaired text is sequential by its nature:
blocks write that text in parts, and one task streams them through the hash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.core.scratch import Scratch
from webloom.llm.memory import tidy

#: Turns and characters of a conversation that one task handles; longer ones are cut into blocks of as many.
HOT_TURNS, HOT_CHARS = 20_000, 1 << 25
#: Characters of a text that take part in range partitioning, and of repaired text that a row holds.
HEAD, PART = 256, 1 << 20
#: Costs of edits, and of keeping a truncated turn in whatever role.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FAR = 1 << 50

WHITE = "\x20\x09-\x0d"
FILLED = re.compile(rf"[^{WHITE}]")
LAST = re.compile(rf"([^{WHITE}])[{WHITE}]*\Z")
ROLES = {"u": "user", "a": "assistant"}

# states: nothing yet; behind the system turn; a user turn waits; behind an assistant turn
START, SYSTEM, WAITING, DONE = range(4)
STATES, ENDS = 4, (START, DONE)
#: The state behind a turn of an initial, and the initial that each state may insert.
NEXT = {(START, "s"): SYSTEM, (START, "u"): WAITING, (SYSTEM, "u"): WAITING, (WAITING, "a"): DONE, (DONE, "u"): WAITING}
MISSING = {START: "u", SYSTEM: "u", WAITING: "a", DONE: "u"}
INITIALS = ("s", "u", "a", "", "?")
#: Symbols: an initial, whether truncated; and a turn that has to go.
GONE = 2 * len(INITIALS)


def symbol(role: str, truncated: bool) -> int:
    first = role[:1]
    return 2 * (INITIALS.index(first) if first in INITIALS else 4) + truncated


def _edits(x: int) -> list[tuple[int, int, int, str]]:
    """(state, next state, cost, letter) of a symbol."""
    out = [(q, q, DELETE, "D") for q in range(STATES)]
    if x != GONE:
        initial, extra = INITIALS[x // 2], TRUNCATED * (x % 2)
        for q in range(STATES):
            kept = q if not initial else NEXT.get((q, initial))
            if kept is not None:
                out.append((q, kept, extra, "K"))
            out.append((q, NEXT[q, MISSING[q]], REROLE + extra, "R"))
    return out


EDITS = [_edits(x) for x in range(GONE + 1)]


def closed(costs: list[int]) -> tuple[int, ...]:
    """Costs when turns may be inserted, without states that are beaten for certain: what can be done from
    START can be done from DONE for a deletion more, and from SYSTEM for nothing more."""
    out = list(costs)
    for _ in range(STATES):
        for q in range(STATES):
            to = NEXT[q, MISSING[q]]
            out[to] = min(out[to], out[q] + INSERT)
    if out[START] > out[DONE] + DELETE:
        out[START] = FAR
    if out[SYSTEM] > out[DONE]:
        out[SYSTEM] = FAR
    return tuple(min(c, FAR) for c in out)


def tail(q: int) -> str:
    """The inserts that complete a conversation from a state."""
    return {START: "", SYSTEM: "II", WAITING: "I", DONE: ""}[q]


class Repairer:
    """The deterministic automaton, as far as it has been met."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.steps: list[list[tuple[int, int] | None]] = []
        self.backs: dict[tuple[int, int, int], tuple[int, tuple]] = {}

    def state(self, costs: tuple[int, ...]) -> tuple[int, int]:
        """(number of the vector less its least cost, that cost) of closed costs."""
        least = min(costs)
        vector = tuple(c - least if c < FAR else FAR for c in costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.steps.append([None] * (GONE + 1))
        return self.number[vector], least

    def step(self, v: int, x: int) -> tuple[int, int]:
        found = self.steps[v][x]
        if found is None:
            costs, vector = [FAR] * STATES, self.vectors[v]
            for q, to, cost, _ in EDITS[x]:
                costs[to] = min(costs[to], vector[q] + cost)
            found = self.steps[v][x] = self.state(closed(costs))
        return found

    def scan(self, costs: tuple[int, ...], symbols: bytes) -> tuple[list[int], tuple[int, ...]]:
        """Vector numbers before each symbol, and the costs behind the last one."""
        v, total = self.state(costs)
        met, steps = [], self.steps
        for x in symbols:
            met.append(v)
            v, more = steps[v][x] or self.step(v, x)
            total += more
        return met, tuple(c + total if c < FAR else FAR for c in self.vectors[v])

    def back(self, v: int, x: int, alive: int) -> tuple[int, tuple]:
        """States before a symbol from which tight arcs lead to those of the mask `alive` behind it: their
        mask, and for each one the letters of its first edits in ASCII order, through the symbol, and the state behind it."""
        found = self.backs.get((v, x, alive))
        if found is None:
            before = self.vectors[v]
            n, more = self.step(v, x)
            after = [c + more if c < FAR else FAR for c in self.vectors[n]]
            picked: list[tuple[str, int] | None] = [None] * STATES
            for q, to, cost, letter in EDITS[x]:
                if alive >> to & 1 and before[q] < FAR and before[q] + cost == after[to] and (picked[q] is None or letter < picked[q][0]):
                    picked[q] = letter, to
            for _ in range(STATES):  # an insert leads to a state before the same symbol
                for q in range(STATES):
                    to = NEXT[q, MISSING[q]]
                    if picked[to] and before[q] < FAR and before[q] + INSERT == before[to] and (picked[q] is None or picked[q][0] > "I"):
                        picked[q] = "I" + picked[to][0], picked[to][1]
            found = self.backs[v, x, alive] = sum(1 << q for q in range(STATES) if picked[q]), tuple(picked)
        return found

    def trace(self, met: list[int], symbols: bytes, alive: int) -> tuple[int, list[tuple]]:
        """The mask before the first symbol, and for each symbol what back() says."""
        out: list = [None] * len(symbols)
        for i in range(len(symbols) - 1, -1, -1):
            alive, out[i] = self.back(met[i], symbols[i], alive)
        return alive, out

    def cheapest(self, symbols: bytes) -> tuple[int, list[str], int]:
        """(cost, letters for each symbol, last state) of a whole conversation."""
        met, costs = self.scan(ORIGIN, symbols)
        _, picks = self.trace(met, symbols, mask_of(costs))
        letters, q = read(picks, START)
        return min(costs[e] for e in ENDS), letters, q


ORIGIN = closed([0, FAR, FAR, FAR])


def mask_of(costs: tuple[int, ...]) -> int:
    """States behind a whole conversation from which it ends at the least cost."""
    total, at = min(costs[e] for e in ENDS), {START: 0, SYSTEM: 2 * INSERT, WAITING: INSERT, DONE: 0}
    return sum(1 << q for q in range(STATES) if costs[q] + at[q] == total)


def read(picks: list[tuple], q: int) -> tuple[list[str], int]:
    """Letters for each symbol from state q on, and the state behind the last one."""
    out = []
    for pick in picks:
        letters, q = pick[q]
        out.append(letters)
    return out, q


def repaired(rows: Iterator[tuple[str, str, str]], q: int) -> Iterator[str]:
    """Lines `role:text` of (role, text, letters) rows read from state q on."""
    for role, text, letters in rows:
        for letter in letters:
            if letter == "D":
                continue
            if letter == "K":
                yield f"{role}:{text}"
                q = q if not role else NEXT[q, role[0]]
            else:
                yield f"{ROLES[MISSING[q]]}:{'' if letter == 'I' else text}"
                q = NEXT[q, MISSING[q]]


def fault(role: str, text: str, seen: bool) -> str:
    if not FILLED.search(text):
        return "blank"
    if seen:
        return "duplicate"
    return "" if LAST.search(text)[1] in ".!?" else "truncated"


def damaged(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, n) after the damage that the hash of a row's place deals; n is how often the row
    stands there, 0 if it was dropped. Nulls in role and text, and in what is hashed, are one space."""
    conv, turn, role, text = (F.col(f"`{c}`") for c in (conv_col, turn_col, role_col, text_col))
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(conv), F.lit(":"), space(turn))) % 20
    hurt = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space(text), "[.!?]", "")).otherwise(space(text))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select(conv.alias("conv"), turn.alias("turn"), F.when(kind == 4, "user").otherwise(space(role)).alias("role"), hurt.alias("text"), times.alias("n"))


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def _schema(conv: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("conv", conv), *(T.StructField(c, T.LongType()) for c in RESULT[:6]), *(T.StructField(c, T.StringType()) for c in RESULT[6:])])


def _whole(repairer: Repairer, turns: list, roles: list[str], texts: list[str]) -> tuple:
    """RESULT of one conversation's rows in order."""
    counts, symbols, seen, illegal, before = {"": 0, "blank": 0, "duplicate": 0, "truncated": 0}, bytearray(), set(), 0, None
    for role, text in zip(roles, texts, strict=True):
        key = role, text
        kind = fault(role, text, key in seen)
        seen.add(key)
        counts[kind] += 1
        symbols.append(GONE if kind in ("blank", "duplicate") else symbol(role, kind == "truncated"))
        if before is not None:
            illegal += before[:1] + role[:1] not in ("su", "ua", "au")
        before = role
    cost, letters, q = repairer.cheapest(bytes(symbols))
    told = [t for t in turns if t is not None]
    gaps = max(told) - min(told) + 1 - len(set(told)) if told else 0
    lines = repaired(zip([*roles, ""], [*texts, ""], [*letters, tail(q)], strict=True), START)
    sha = hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, "".join(letters) + tail(q), sha


def _streamed(rows: DataFrame) -> DataFrame:
    """Results of conversations that a task can hold, each streamed in order."""
    schema = _schema(rows.schema["conv"].dataType)
    arrow = pa.schema([(c, pa.int64()) for c in RESULT[:6]] + [(c, pa.string()) for c in RESULT[6:]])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer, none = Repairer(), object()
        conv, kind, held, done = none, None, ([], [], []), []

        def flush() -> pa.RecordBatch:
            keys, results = [k for k, _ in done], [dict(zip(RESULT, r, strict=True)) for _, r in done]
            done.clear()
            rest = pa.RecordBatch.from_pylist(results, schema=arrow)
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), *rest.columns], names=names)

        for b in batches:
            kind = b.schema.field(0).type
            for c, turn, role, text, n in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if c != conv or conv is none:
                    if conv is not none:
                        done.append((conv, _whole(repairer, *held)))
                    conv, held = c, ([], [], [])
                for column, value in zip(held, (turn, role, text), strict=True):
                    column += [value] * n
                if len(done) == 5000:
                    yield flush()
        if conv is not none:
            done.append((conv, _whole(repairer, *held)))
        if done:
            yield flush()

    order = ["conv", "turn", "role", "text"]  # nulls first
    return rows.select(*order, "n").repartition("conv").sortWithinPartitions(*order).mapInArrow(tidy(run), schema)


def _blocks(hot: DataFrame, size: int, chars: int, scratch: Scratch) -> DataFrame:
    """(conv, part, pos, turn, role, text, n, kind) of long conversations' rows in order: equal rows are one of n
    copies, kind is the first copy's fault, and part numbers the blocks."""
    rows = scratch.write(hot.where("n > 0").groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n")), "distinct")
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = rows.withColumn("sha", F.sha2("text", 256)).groupBy("conv", "role", "sha").agg(F.min(turn).alias("first"))
    first = first.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("sha").alias("s"), F.col("first.turn").alias("t"))
    first = scratch.write(first, "first")
    rows = rows.join(first, rows["conv"].eqNullSafe(F.col("c")) & (rows["role"] == F.col("r")) & (F.sha2(rows["text"], 256) == F.col("s")))
    body = F.regexp_replace("text", rf"[{WHITE}]+\z", "")
    kind = F.when(body == "", "blank").when(~F.col("turn").eqNullSafe(F.col("t")), "duplicate").when(F.right(body, F.lit(1)).isin(".", "!", "?"), "").otherwise("truncated")
    rows = rows.select("conv", "turn", "role", "text", "n", kind.alias("kind"))
    told = rows.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    parts = int(max(1, told[0] // size, (told[1] or 0) // chars)) + 1
    rows = rows.repartitionByRange(parts, "conv", "turn", "role", F.substring("text", 1, HEAD)).sortWithinPartitions("conv", "turn", "role", "text")
    rows = rows.withColumn("pos", F.monotonically_increasing_id())
    return scratch.write(rows.withColumn("part", F.shiftright("pos", 33)), "ordered")


def _symbols(block: pd.DataFrame) -> tuple[bytes, list[int]]:
    """Symbols of a block's copies, and where each row's copies end."""
    out, ends = bytearray(), []
    for role, kind, n in zip(block["role"], block["kind"], block["n"], strict=True):
        out.append(GONE if kind in ("blank", "duplicate") else symbol(role, kind == "truncated"))
        out += bytes([GONE]) * (n - 1)
        ends.append(len(out))
    return bytes(out), ends


def _long(hot: DataFrame, size: int, chars: int, scratch: Scratch) -> DataFrame:
    """Results of conversations that are cut into blocks."""
    kind = hot.schema["conv"].dataType
    conv, part = T.StructField("conv", kind), T.StructField("part", T.LongType())
    longs, text = T.ArrayType(T.LongType()), T.StringType()
    rows = _blocks(hot, size, chars, scratch)

    def costs_of(keys: tuple, block: pd.DataFrame) -> pd.DataFrame:
        symbols, _ = _symbols(block.sort_values("pos"))
        repairer = Repairer()
        matrix = [c for q in range(STATES) for c in repairer.scan(closed([0 if p == q else FAR for p in range(STATES)]), symbols)[1]]
        return pd.DataFrame([(*keys, symbols, matrix)], columns=["conv", "part", "symbols", "matrix"])

    fields = [T.StructField("symbols", T.BinaryType()), T.StructField("matrix", longs)]
    costs = scratch.write(rows.select("conv", "part", "pos", "role", "kind", "n").groupBy("conv", "part").applyInPandas(costs_of, T.StructType([conv, part, *fields])), "costs")

    def along(keys: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        """Costs before each block of a conversation and the mask behind it; a row of 16 numbers a block."""
        blocks = blocks.sort_values("part")
        matrices, before = [np.array(m, np.int64).reshape(STATES, STATES) for m in blocks["matrix"]], [np.array(ORIGIN, np.int64)]
        for m in matrices:
            before.append(np.minimum((before[-1][:, None] + m).min(axis=0), FAR))
        total = min(before[-1][list(ENDS)])
        after = [np.array([0, 2 * INSERT, INSERT, 0], np.int64)]
        for m in reversed(matrices[1:]):
            after.append(np.minimum((m + after[-1][None, :]).min(axis=1), FAR))
        masks = [sum(1 << q for q in range(STATES) if b[q] + a[q] == total) for b, a in zip(before[1:], reversed(after), strict=True)]
        return pd.DataFrame({"conv": [keys[0]] * len(masks), "part": blocks["part"].to_numpy(), "before": [b.tolist() for b in before[:-1]], "mask": masks, "cost": [int(total)] * len(masks)})

    fields = [T.StructField("before", longs), T.StructField("mask", T.LongType()), T.StructField("cost", T.LongType())]
    placed = scratch.write(costs.select("conv", "part", "matrix").groupBy("conv").applyInPandas(along, T.StructType([conv, part, *fields])), "placed")

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The letters of each block from each state that is alive before it, and the state behind it."""
        repairer = Repairer()
        for b in batches:
            for i, (symbols, before, mask) in enumerate(zip(*(b.column(c).to_pylist() for c in ("symbols", "before", "mask")), strict=True)):
                met, _ = repairer.scan(tuple(before), symbols)
                alive, picks = repairer.trace(met, symbols, mask)
                for q in range(STATES):
                    if alive >> q & 1:
                        letters, to = read(picks, q)
                        values = [pa.array([q]), pa.array([to]), pa.array([letters], pa.list_(pa.string()))]
                        yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), *values], names=["conv", "part", "q", "next", "letters"])

    fields = [T.StructField("q", T.LongType()), T.StructField("next", T.LongType()), T.StructField("letters", T.ArrayType(text))]
    same = lambda a, b: a["conv"].eqNullSafe(b["conv"]) & (a["part"] == b["part"])
    blocks = costs.join(placed, same(costs, placed)).select(costs["conv"], costs["part"], "symbols", "before", "mask")
    pieces = scratch.write(blocks.mapInArrow(tidy(traced), T.StructType([conv, part, *fields])), "pieces")

    def chained(keys: tuple, steps: pd.DataFrame) -> pd.DataFrame:
        """The state in which each block of a conversation begins, and what it ends with."""
        q, out = START, []
        to = {(p, a): z for p, a, z in zip(steps["part"], steps["q"], steps["next"], strict=True)}
        parts = sorted(set(steps["part"]))
        for p in parts:
            out.append((keys[0], p, q, tail(to[p, q]) if p == parts[-1] else ""))
            q = to[p, q]
        return pd.DataFrame(out, columns=["conv", "part", "q", "tail"])

    chain = pieces.select("conv", "part", "q", "next").groupBy("conv").applyInPandas(chained, T.StructType([conv, part, fields[0], T.StructField("tail", text)]))
    chain = scratch.write(chain, "chain")
    taken = pieces.join(chain, same(pieces, chain) & (pieces["q"] == chain["q"])).select(pieces["conv"], pieces["part"], pieces["q"], "letters", "tail")
    taken = scratch.write(taken, "taken")

    def written(keys: tuple, block: pd.DataFrame, piece: pd.DataFrame) -> pd.DataFrame:
        """The repaired text of a block, each line behind a line break, in parts of bounded size."""
        block, piece = block.sort_values("pos"), piece.iloc[0]
        _, ends = _symbols(block)
        letters, at, given = list(piece["letters"]), 0, []
        for end in ends:
            given.append("".join(letters[at:end]))
            at = end
        out, held, size_ = [], [], 0
        # of a row's copies only the first can be kept, and nothing else of the row is in their letters
        for line in repaired(zip([*block["role"], ""], [*block["text"], ""], [*given, piece["tail"]], strict=True), int(piece["q"])):
            held.append(("\n" + line).encode("utf-8", "surrogatepass"))
            size_ += len(held[-1])
            if size_ >= PART:
                out.append(b"".join(held))
                held, size_ = [], 0
        out.append(b"".join(held))
        return pd.DataFrame({"conv": [keys[0]] * len(out), "part": [keys[1]] * len(out), "nth": range(len(out)), "raw": out})

    fields = [T.StructField("nth", T.LongType()), T.StructField("raw", T.BinaryType())]
    parts = rows.select("conv", "part", "pos", "role", "text", "kind", "n").groupBy("conv", "part").cogroup(taken.groupBy("conv", "part"))
    parts = scratch.write(parts.applyInPandas(written, T.StructType([conv, part, *fields])), "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        now, sha, begun, done = none, None, False, []
        field = None
        for b in batches:
            field = b.schema.field(0).type
            for c, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if now is none or c != now:
                    if now is not none:
                        done.append((now, sha.hexdigest()))
                    now, sha, begun = c, hashlib.sha256(), False
                if raw:
                    sha.update(raw if begun else raw[1:])  # the first line break has no line before it
                    begun = True
        if now is not none:
            done.append((now, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], field), pa.array([s for _, s in done], pa.string())], names=["conv", "repaired_sha256"])

    digests = parts.repartition("conv").sortWithinPartitions("conv", "part", "nth").select("conv", "raw").mapInArrow(tidy(hashed), T.StructType([conv, T.StructField("repaired_sha256", text)]))
    audits = taken.select("conv", "part", F.concat(F.array_join("letters", ""), "tail").alias("audit")).groupBy("conv")
    audits = audits.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda r: r["audit"]), "").alias("audit"))
    return _joined(_counted(rows, kind), [placed.groupBy("conv").agg(F.max("cost").alias("cost")), audits, digests])


def _counted(rows: DataFrame, kind: T.DataType) -> DataFrame:
    """Counts of long conversations: faults, gaps and pairs of roles that do not follow each other."""
    of = lambda name: F.sum(F.when(F.col("kind") == name, 1).otherwise(0))
    more = F.sum(F.col("n") - 1)  # copies behind the first are blank if it is, and else repeat it
    blank = F.sum(F.when(F.col("kind") == "blank", F.col("n")).otherwise(0))
    extra = F.sum(F.when(F.col("kind") == "blank", 0).otherwise(F.col("n") - 1))
    told = rows.groupBy("conv").agg(blank.alias("blank"), (of("duplicate") + extra).alias("duplicate"), of("truncated").alias("truncated"), more.alias("copies"))
    turns = rows.where("turn is not null").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv")
    turns = turns.agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))

    def pairs(keys: tuple, block: pd.DataFrame) -> pd.DataFrame:
        initials = block.sort_values("pos")["role"].str[:1].tolist()
        bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))  # noqa: B905, RUF007
        return pd.DataFrame([(*keys, bad, initials[0], initials[-1])], columns=["conv", "part", "bad", "first", "last"])

    text = T.StringType()
    fields = [T.StructField("part", T.LongType()), T.StructField("bad", T.LongType()), T.StructField("first", text), T.StructField("last", text)]
    ends = rows.select("conv", "part", "pos", "role").groupBy("conv", "part").applyInPandas(pairs, T.StructType([T.StructField("conv", kind), *fields]))

    def across(keys: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("part")
        seams = sum(a + b not in ("su", "ua", "au") for a, b in zip(blocks["last"], blocks["first"][1:]))  # noqa: B905
        return pd.DataFrame([(keys[0], int(blocks["bad"].sum()) + seams)], columns=["conv", "illegal"])

    illegal = ends.groupBy("conv").applyInPandas(across, T.StructType([T.StructField("conv", kind), T.StructField("illegal", T.LongType())]))
    out = _joined(told, [turns, illegal])
    return out.select("conv", F.coalesce("gaps", F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + F.col("copies")).alias("illegal"))


def _joined(first: DataFrame, others: list[DataFrame]) -> DataFrame:
    for other in others:
        other = other.withColumnRenamed("conv", "_conv")
        first = first.join(other, first["conv"].eqNullSafe(other["_conv"]), "left").drop("_conv")
    return first


def repair(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    hurt: bool = True,
    hot_turns: int = HOT_TURNS,
    hot_chars: int = HOT_CHARS,
) -> DataFrame:
    """One row per conversation: its id and RESULT.

    hurt: rows are damaged first, as damaged() says; else they are taken as they are. Turns are read in order
    of (turn, role, text), nulls first, so rows of one turn have a defined order. Nulls in role and text are
    one space, which is a role that cannot stay; an empty role has no initial, so it can stay anywhere; a null
    conversation id is a conversation of its own. Repeated rows are duplicates. A conversation without rows
    has zeros, an empty audit and the digest of nothing. An empty table gives no rows; other columns are not
    read. Conversations of more than hot_turns turns or hot_chars characters are cut into blocks, whose number
    grows with them; the audit and a text are each one value, which a task must hold.
    """
    scratch = Scratch(rows.sparkSession, "repair")
    if hurt:
        rows = damaged(rows, conv_col, turn_col, role_col, text_col)
    else:
        space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
        rows = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), F.lit(1).alias("n"))
    sizes = rows.groupBy("conv").agg(F.sum("n").alias("turns"), F.sum(F.length("text") * F.col("n")).alias("chars"))
    hot = scratch.write(sizes.where((F.col("turns") > hot_turns) | (F.col("chars") > hot_chars)).select(F.col("conv").alias("c")), "hot")
    if hot.isEmpty():
        out = _streamed(rows)
    else:
        is_hot: Column = rows["conv"].eqNullSafe(hot["c"])  # a row for each hot_turns rows or hot_chars characters at most
        long = _long(rows.join(hot, is_hot, "left_semi"), hot_turns, hot_chars, scratch)
        out = _streamed(rows.join(hot, is_hot, "left_anti")).unionByName(long.select("conv", *RESULT))
    return out.withColumnRenamed("conv", conv_col)
