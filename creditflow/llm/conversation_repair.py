"""Faults of conversations, and the cheapest edits that make their roles alternate.

A conversation must read ``(s?(ua)+)?`` by its roles' initials.  Turns are retained, as they are or under another role, or
deleted; missing turns are inserted.  The cheapest repair is found over the retained turns alone: prefix sums of
deletions price every gap between two of them, running minima per role of the next retained turn make that one step a
turn, and the pair of roles says what must be inserted.  Of equally cheap repairs the one whose letters (Delete < Insert
< Keep < Rerole) come first is read off from the front.

Turns are sorted by conversation and time and cut into segments of bounded size, wherever that falls.  A segment's part of
a conversation is a 4 x 4 table of costs between roles, so the parts of a long conversation are solved apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creditflow.llm.shared import crc32_text, small_batches, written

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
NOT_SPACE = r"[^\x20\x09-\x0D]"
NEVER = 1 << 60
#: States: the initial of the last retained or inserted turn; the first stands for none yet.
BEGIN, INITIALS = 0, "?sua"
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: What must be inserted between two states, and after the last one.
BETWEEN = {(0, 1): "", (0, 2): "", (0, 3): "u", (1, 2): "", (1, 3): "u", (2, 2): "a", (2, 3): "", (3, 2): "", (3, 3): "u"}
AFTER = ("", "ua", "a", "")
FINAL = [INSERT * len(x) for x in AFTER]


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of damaged conversations, by crc32 of ``conv_id:turn`` modulo 20.

    0 drops a turn, 1 empties its text, 2 takes its full stops, question and exclamation marks, 3 repeats it, 4 makes it the
    user's.  A null role or text is one space, and so is a null id or turn in the hashed string.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = crc32_text(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    rows = turns.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), k.alias("k")).where("k <> 0")
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


@dataclass
class Turn:
    """A turn, and how many more of the very same follow it; ``gone``: it is blank or a duplicate."""

    initial: str
    gone: bool
    truncated: bool
    more: int = 0

    def retained(self, state: int) -> int:
        """What it costs to retain the turn under a state's role."""
        if self.gone or (state == 1 and self.initial != "s"):
            return NEVER
        return (0 if self.initial == INITIALS[state] else REROLE) + (TRUNCATED if self.truncated else 0)


def costs(turns: list[Turn], after: list[int]) -> list[list[int]]:
    """Least cost of what follows, for every place and state of the last retained turn; ``after`` is that of the end."""
    n = len(turns)
    deleted = [0] * (n + 1)
    for i, t in enumerate(turns):
        deleted[i + 1] = deleted[i] + DELETE * (1 + t.more)
    to_end = [deleted[n] + x for x in after]
    out = [list(after)]
    least = [NEVER] * 4  # per state of the next retained turn: deletions before it, itself and what follows
    for i in range(n - 1, -1, -1):
        t, then = turns[i], out[-1]
        for r in (1, 2, 3):
            own = t.retained(r)
            if own < NEVER:
                least[r] = min(least[r], deleted[i] + own + DELETE * t.more + then[r])
        row = to_end[:]
        for (q, r), needed in BETWEEN.items():
            row[q] = min(row[q], INSERT * len(needed) + least[r])
        out.append([x - deleted[i] if x < NEVER else NEVER for x in row])
    return out[::-1]


def table(turns: list[Turn]) -> list[list[int]]:
    """Least cost from each state before the turns to each state after them."""
    columns = [costs(turns, [0 if q == end else NEVER for q in range(4)])[0] for end in range(4)]
    return [[min(columns[end][q], NEVER) for end in range(4)] for q in range(4)]


@dataclass
class Repair:
    """Per turn its letters, the roles inserted before it and its own new role (None: deleted); the state after."""

    letters: list[str] = field(default_factory=list)
    lead: list[str] = field(default_factory=list)
    roles: list[str | None] = field(default_factory=list)
    state: int = BEGIN


def choose(turns: list[Turn], after: list[int], state: int = BEGIN) -> Repair:
    """The cheapest edits whose letters come first."""
    out, ahead = Repair(state=state), costs(turns, after)
    for i, t in enumerate(turns):
        q, now, then = out.state, ahead[i], ahead[i + 1]
        if DELETE * (1 + t.more) + then[q] == now[q]:
            best = ("D", q, "")
        else:
            found = []
            for r in (1, 2, 3):
                needed, own = BETWEEN.get((q, r)), t.retained(r)
                if needed is not None and own < NEVER and INSERT * len(needed) + own + DELETE * t.more + then[r] == now[q]:
                    found.append(("I" * len(needed) + ("K" if t.initial == INITIALS[r] else "R"), r, needed))
            best = min(found)
        letters, out.state, needed = best
        out.letters.append(letters + "D" * t.more)
        out.lead.append(needed)
        out.roles.append(None if letters == "D" else "" if letters[-1] == "K" else ROLES[INITIALS[out.state]])
    return out


LIGHT = ("at", "conv_id", "turn", "role", "text_key", "initial", "blank", "seen", "truncated", "times")


def _parts(t: pa.Table) -> list[tuple[int, int]]:
    """[from, to) of each conversation in sorted rows."""
    ids = t["conv_id"].to_pylist()
    cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
    return list(zip(cuts, cuts[1:], strict=False))


def _turns(t: pa.Table) -> list[Turn]:
    c = {n: t[n].to_pylist() for n in ("initial", "blank", "seen", "truncated", "times")}
    return [Turn(x, b or s, u, n - 1) for x, b, s, u, n in zip(c["initial"], c["blank"], c["seen"], c["truncated"], c["times"], strict=True)]


@dataclass(frozen=True)
class Carry:
    """What a segment must know of the rest of a conversation that it shares."""

    after: tuple[int, ...]
    state: int = BEGIN
    before: str | None = None
    ends: bool = True


def _carries(light: DataFrame) -> dict[tuple[int, bool], Carry]:
    """Carries by (segment, whether it is its last conversation) of conversations that go over segment borders.

    At most two rows of 16 numbers a segment come to the driver.
    """
    ends = T._parse_datatype_string("seg int, first boolean, last boolean, costs array<array<long>>, head string, tail string")
    schema = T.StructType([light.schema["conv_id"], *ends.fields])

    def sides(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        parts, turns, out = _parts(t), _turns(t), []
        for a, b in {parts[0], parts[-1]}:
            own = turns[a:b]
            out.append((t["conv_id"][a].as_py(), t["seg"][0].as_py(), (a, b) == parts[0], (a, b) == parts[-1], table(own), own[0].initial, own[-1].initial))
        return pa.Table.from_pydict(dict(zip(schema.names, map(list, zip(*out, strict=True)), strict=True)), schema=_arrow(schema))

    rows = {(r["seg"], r["last"]): r for r in light.groupBy("seg").applyInArrow(sides, schema).collect()}
    whole = {k[0]: r for k, r in rows.items() if r["first"] and r["last"]}
    first = lambda s: whole.get(s) or rows.get((s, False))
    segments = sorted({k[0] for k in rows})
    chains: list[list] = []
    for a, b in zip(segments, segments[1:], strict=False):
        left, right = rows[a, True], first(b)
        if left["conv_id"] == right["conv_id"]:
            if chains and chains[-1][-1] is left:
                chains[-1].append(right)
            else:
                chains.append([left, right])
    if not chains:
        return {}
    after: dict[tuple[int, bool], tuple[int, ...]] = {}
    for chain in chains:
        end = FINAL
        for r in reversed(chain):
            after[r["seg"], r["last"]] = tuple(end)
            end = [min(x + e for x, e in zip(row, end, strict=True)) for row in r["costs"]]
    steps = T._parse_datatype_string("seg int, last boolean, states array<int>")

    def leave(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        parts, turns, seg, out = _parts(t), _turns(t), t["seg"][0].as_py(), []
        for a, b in {parts[0], parts[-1]}:
            key = (seg, (a, b) == parts[-1])
            if key in after:
                out.append((*key, [choose(turns[a:b], list(after[key]), q).state for q in range(4)]))
        return pa.Table.from_pydict(dict(zip(steps.names, map(list, zip(*out, strict=True)), strict=True)) if out else {n: [] for n in steps.names}, schema=_arrow(steps))

    states = {(r["seg"], r["last"]): r["states"] for r in light.groupBy("seg").applyInArrow(leave, steps).collect()}
    out: dict[tuple[int, bool], Carry] = {}
    for chain in chains:
        state, before = BEGIN, None
        for r in chain:
            key = (r["seg"], r["last"])
            out[key] = Carry(after[key], state, before, r is chain[-1])
            state, before = states[key][state], r["tail"]
    return out


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


LETTERS = "at long, seg int, letters string, lead string, new_role string, tail string, blanks long, duplicates long, cut_off long, illegal long, cost long"


def _edits(light: DataFrame, carries: dict[tuple[int, bool], Carry]) -> DataFrame:
    """Per distinct turn what happens to it, with the faults and costs that it stands for; no texts."""
    keys = ["conv_id", "turn", "role", "text_key"]
    schema = T.StructType([light.schema[c] for c in keys] + T._parse_datatype_string(LETTERS).fields)

    def edit(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        turns, parts, seg = _turns(t), _parts(t), t["seg"][0].as_py()
        blank, cut = t["blank"].to_pylist(), t["truncated"].to_pylist()
        c: dict[str, list] = {n: [] for n in schema.names[len(keys) :]}
        for a, b in parts:
            carry = carries.get((seg, (a, b) == parts[-1]), Carry(tuple(FINAL))) if (a, b) in (parts[0], parts[-1]) else Carry(tuple(FINAL))
            own = turns[a:b]
            made, before = choose(own, list(carry.after), carry.state), carry.before
            c["letters"] += made.letters
            c["lead"] += made.lead
            c["new_role"] += made.roles
            c["tail"] += [""] * (b - a - 1) + [AFTER[made.state] if carry.ends else ""]
            for i, x in enumerate(own):
                legal = before is None or before + x.initial in ("su", "ua", "au")
                before = x.initial
                n, is_blank, gone = x.more + 1, blank[a + i], x.gone
                c["illegal"].append((not legal) + x.more)  # a turn and its own copy never alternate
                c["blanks"].append(n if is_blank else 0)
                c["duplicates"].append(0 if is_blank else n if gone else x.more)
                c["cut_off"].append(int(cut[a + i] and not gone))
                letters, added = made.letters[i], INSERT * (len(made.lead[i]) + len(c["tail"][a + i]))
                c["cost"].append(DELETE * letters.count("D") + REROLE * letters.count("R") + TRUNCATED * (made.roles[i] is not None and cut[a + i]) + added)
        columns = {k: t[k] for k in keys} | {"at": t["at"], "seg": t["seg"]} | {n: v for n, v in c.items() if n not in ("at", "seg")}
        return pa.Table.from_pydict({n: columns[n] for n in schema.names}, schema=_arrow(schema))

    return light.groupBy("seg").applyInArrow(edit, schema)


SUMS = ("blank", "duplicate", "truncated", "illegal", "cost")


def _told(edits: DataFrame, keep_text: bool) -> DataFrame:
    """One row a conversation from its edits in order, as a stream: sums, letters and the repaired text's digest."""
    schema = T.StructType([edits.schema["conv_id"]] + T._parse_datatype_string(", ".join(f"{s} long" for s in SUMS) + ", audit string, repaired_sha256 string, repaired string").fields)
    arrow = _arrow(schema)
    numbers = ("blanks", "duplicates", "cut_off", "illegal", "cost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = run  # no conversation yet
        done: list[tuple] = []

        def close() -> None:
            if now is not run:
                done.append((now, *sums, "".join(letters), digest.hexdigest(), "\n".join(lines) if keep_text else None))

        for batch in batches:
            for r in batch.to_pylist():
                if now is run or r["conv_id"] != now:
                    close()
                    now, sums, letters, digest, lines, any_line = r["conv_id"], [0] * 5, [], hashlib.sha256(), [], False
                sums = [x + r[n] for x, n in zip(sums, numbers, strict=True)]
                letters.append(r["letters"] + "I" * len(r["tail"]))
                own = [f"{r['new_role'] or r['role']}:{r['text']}"] if r["new_role"] is not None else []
                for line in [*(f"{ROLES[x]}:" for x in r["lead"]), *own, *(f"{ROLES[x]}:" for x in r["tail"])]:
                    digest.update(("\n" if any_line else "").encode() + line.encode())
                    any_line = True
                    if keep_text:
                        lines.append(line)
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*done, strict=True)), strict=True)) if done else {n: [] for n in schema.names}, schema=arrow)
            done.clear()
        close()
        yield pa.RecordBatch.from_pydict(dict(zip(schema.names, map(list, zip(*done, strict=True)), strict=True)) if done else {n: [] for n in schema.names}, schema=arrow)

    return edits.mapInArrow(run, schema)


def repair(turns: DataFrame, ids: DataFrame | None = None, segment_rows: int = 250_000, keep_text: bool = False) -> DataFrame:
    """Faults and the cheapest repair of every conversation of ``turns`` (conv_id, turn, role, text; none but the ids null).

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, repaired (where ``keep_text``).
    ``ids`` (conv_id) adds conversations without turns: zeros, an empty audit, the digest of nothing.

    Turns of a conversation are taken by turn, nulls first; where turns are equal, by role, then by the text's digest.  A null
    conv_id is a conversation of its own.  Equal rows are one with a count, so that very many copies are no load.
    Nothing of a conversation but its letters, which the result holds, is gathered in one place; its texts pass as a stream.
    """
    small_batches(turns.sparkSession)
    spark = turns.sparkSession
    keys = ["conv_id", "turn", "role", "text_key"]
    rows = turns.select("conv_id", "turn", "role", "text", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("text_key"))
    rows = written(rows.groupBy(*keys).agg(F.any_value("text").alias("text"), F.count(F.lit(1)).alias("times")), "turns")
    ends_well: Column = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    rows = rows.withColumns({"initial": F.substring("role", 1, 1), "blank": ~F.col("text").rlike(NOT_SPACE), "truncated": ~ends_well})
    when = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    again = rows.where("NOT blank").groupBy("conv_id", "role", "text_key").agg(F.min(when).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same = lambda a, b, *names: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names]
    light = rows.drop("text").alias("l").join(again.alias("r"), same("l", "r", "conv_id", "role", "text_key"), "left")
    seen = F.coalesce(F.struct(F.col("l.turn").isNotNull(), F.col("l.turn")) > F.col("r.first"), F.lit(False))
    light = light.select("l.*", seen.alias("seen"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // segment_rows)
    light = light.repartitionByRange(tasks, *[F.col(c).asc_nulls_first() for c in keys]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in keys])
    light = written(light.withColumn("at", F.monotonically_increasing_id()).withColumn("seg", F.shiftright("at", 33).cast("int")).select(*LIGHT, "seg"), "segments")
    edits = _edits(light, _carries(light))
    texts = edits.alias("e").join(rows.select(*keys, "text").alias("t"), same("e", "t", *keys) + [F.col("e.new_role").isNotNull()], "left").select("e.*", "t.text")
    told = _told(texts.repartition("conv_id").sortWithinPartitions("conv_id", "at"), keep_text)
    gaps = light.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    every = turns.select("conv_id") if ids is None else ids.select("conv_id")
    out = every.distinct().alias("i").join(told.alias("o"), same("i", "o", "conv_id"), "left").join(gaps.alias("g"), same("i", "g", "conv_id"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    nothing = hashlib.sha256().hexdigest()
    return out.select("i.conv_id", zero("gaps"), *[zero(c) for c in SUMS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"), "repaired")
