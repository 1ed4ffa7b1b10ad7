"""Repair of conversations by the cheapest edits, by survivor-coalescence Viterbi.

1. Turns get positions over the whole table (conversation, turn, role, text): one range exchange,
   written. A conversation is then a run of neighbouring positions.
2. Faults of a turn: blank and truncated on the row; duplicate from the first position of each
   (conversation, role, text) mark, combined before the exchange.
3. Blocks of BLOCK neighbouring turns are solved in tasks (`survivors`), without the texts.
   A conversation inside a block is done. Of one that reaches over a block's edge the block first
   gives a 4 by 4 matrix of costs between states; folded from the last block to the first they
   say what each block's end still costs; then each block is solved with these.
4. One streaming pass per conversation applies the edits to the turns in order. It holds one
   block's letters at a time; a conversation of any length is a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sitelore.llm.files import parallelism, whole_texts
from sitelore.llm.positions import number_rows
from sitelore.llm.runs import runs
from sitelore.llm.survivors import END_COSTS, START, Survivors, transfer
from sitelore.session import materialize

BLOCK = 4096
DAMAGES = 20
ROLES = ("user", "assistant")
SPACE = r"[^\x20\x09-\x0D]"


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults put in by crc32 of `conv_id:turn` modulo 20: 0 drops the
    turn, 1 empties its text, 2 takes out its `.!?`, 3 repeats it, 4 makes it the user's.

    Nulls in role and text, and in the two parts of the key, are one space; conv_id and turn
    themselves stay null."""
    blank = F.lit(" ")
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)
    )
    text = F.coalesce(F.col("text").cast("string"), blank)
    rows = df.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), blank).alias("role"), text.alias("text"),
        (F.crc32(F.encode(key, "UTF-8")) % DAMAGES).alias("_c"),
    ).where("_c <> 0")
    copies = F.when(F.col("_c") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("_c") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_c") == 1, "").when(F.col("_c") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(copies).alias("_copy"),
    ).drop("_copy")


def _placed(df: DataFrame) -> DataFrame:
    blank = F.lit(" ")
    rows = df.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), blank).alias("role"),
        F.coalesce(F.col("text").cast("string"), blank).alias("text"),
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]
    return materialize(number_rows(rows, order, "_pos"), "turns")


def _faults(placed: DataFrame) -> DataFrame:
    """_pos, conv_id, initial, fault of every turn; fault: b, d, t or a point."""
    last = F.regexp_extract("text", rf"({SPACE})[\x20\x09-\x0D]*\z", 1)
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    mark = F.md5(F.encode(F.concat_ws("\0", F.length(conv).cast("string"), F.length("role").cast("string"), conv, F.col("role"), F.col("text")), "UTF-8"))
    rows = placed.select(
        "_pos", "conv_id", F.substring("role", 1, 1).alias("initial"), last.alias("last"), mark.alias("mark")
    )
    rows = materialize(rows, "marks")
    firsts = rows.groupBy("mark").agg(F.min("_pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    joined = rows.join(firsts.select("mark", "first"), "mark", "left")
    fault = (
        F.when(F.col("last") == "", "b").when(F.col("_pos") > F.col("first"), "d")
        .when(~F.col("last").isin(".", "!", "?"), "t").otherwise(".")
    )
    return materialize(joined.select("_pos", "conv_id", "initial", fault.alias("fault")), "faults")


def _spans(table: pa.Table) -> Iterator[tuple[int, int]]:
    """Row ranges of equal conv_id in a table sorted by position."""
    ids = table["conv_id"].to_pylist()
    start = 0
    for i in range(1, len(ids) + 1):
        if i == len(ids) or ids[i] != ids[start]:
            yield start, i
            start = i


def _by_block(rows: DataFrame, block: int) -> DataFrame:
    at = rows.withColumn("_block", F.floor(F.col("_pos") / block).cast("long"))
    return at.repartition(parallelism(rows.sparkSession), "_block").sortWithinPartitions("_block", "_pos")


def _open_ends(faults: DataFrame, block: int, kind: str) -> DataFrame:
    """conv_id, _block, costs (4), last: what the end of each block of a conversation that touches
    a block's edge still costs, by state."""

    def matrices(batches):
        for _, table in runs(batches, ["_block"]):
            pos, initial, fault = (table[c].to_pylist() for c in ("_pos", "initial", "fault"))
            for a, b in _spans(table):
                if pos[a] % block == 0 or pos[b - 1] % block == block - 1:
                    costs = sum(transfer(zip(initial[a:b], fault[a:b])), [])
                    yield pa.RecordBatch.from_arrays(
                        [table["conv_id"].slice(a, 1).combine_chunks(), pa.array([pos[a] // block], pa.int64()),
                         pa.array([costs], pa.list_(pa.int64()))], ["conv_id", "_block", "costs"],
                    )

    def fold(batches):
        now, after = (), []
        for batch in batches:
            ids, blocks, costs = (batch.column(c).to_pylist() for c in ("conv_id", "_block", "costs"))
            ends, last = [], []
            for conv, m in zip(ids, costs):
                last.append((conv,) != now)
                after = list(END_COSTS) if last[-1] else after
                now = (conv,)
                ends.append(after)
                after = [min(m[4 * s + t] + after[t] for t in range(4)) for s in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("_block"), pa.array(ends, pa.list_(pa.int64())), pa.array(last)],
                ["conv_id", "_block", "costs", "last"],
            )

    open_ = _by_block(faults, block).mapInArrow(matrices, f"conv_id {kind}, _block long, costs array<long>")
    ordered = open_.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("_block"))
    return ordered.mapInArrow(fold, f"conv_id {kind}, _block long, costs array<long>, last boolean")


_PART = "_pos long, faults string, edits array<string>, exits array<int>, cost array<long>"


def _solved(faults: DataFrame, block: int, kind: str) -> DataFrame:
    """conv_id and, at the position of its first turn there, a conversation's letters in one
    block, for each state it may be entered in (only the first for one inside its block)."""
    ends = materialize(_open_ends(faults, block, kind), "ends")
    rows = faults.select("conv_id", "_pos", "initial", "fault", F.lit(None).cast("array<long>").alias("costs"), F.lit(None).cast("boolean").alias("last"))
    carried = ends.select(
        "conv_id", (F.col("_block") * block).alias("_pos"), F.lit("").alias("initial"), F.lit(None).cast("string").alias("fault"), "costs", "last"
    )
    both = rows.unionByName(carried).withColumn("_block", F.floor(F.col("_pos") / block).cast("long"))
    dealt = both.repartition(parallelism(faults.sparkSession), "_block").sortWithinPartitions(
        "_block", F.col("fault").isNotNull(), "_pos"
    )

    def solve(batches):
        for _, table in runs(batches, ["_block"]):
            fault = table["fault"].to_pylist()
            n = fault.index(next(f for f in fault if f is not None))
            exits = {c: (v, last) for c, v, last in zip(*(table[k].slice(0, n).to_pylist() for k in ("conv_id", "costs", "last")))}
            table, fault = table.slice(n), fault[n:]
            pos, initial = table["_pos"].to_pylist(), table["initial"].to_pylist()
            out = {k: [] for k in ("_pos", "faults", "edits", "exits", "cost")}
            firsts = []
            for a, b in _spans(table):
                edge = pos[a] % block == 0 or pos[b - 1] % block == block - 1
                costs, last = exits[table["conv_id"][a].as_py()] if edge else (END_COSTS, True)
                found = Survivors(costs) if last else Survivors(costs, {s: str(s) for s in range(4)})
                for i in range(b - 1, a - 1, -1):
                    found.before(initial[i], fault[i])
                letters = [found.edits(s) for s in (range(4) if edge else (START,))]
                firsts.append(a)
                out["_pos"].append(pos[a])
                out["faults"].append("".join(fault[a:b]))
                out["edits"].append(letters if last else [e[:-1] for e in letters])
                out["exits"].append([START] * len(letters) if last else [int(e[-1]) for e in letters])
                out["cost"].append(found.costs[: len(letters)])
            ids = table["conv_id"].combine_chunks().take(pa.array(firsts))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(out["_pos"], pa.int64()), pa.array(out["faults"]), pa.array(out["edits"], pa.list_(pa.string())),
                 pa.array(out["exits"], pa.list_(pa.int32())), pa.array(out["cost"], pa.list_(pa.int64()))], ["conv_id", *out],
            )

    return dealt.mapInArrow(solve, f"conv_id {kind}, {_PART}")


class _Walk:
    """Applies the letters of one conversation to its turns, one after the other."""

    def __init__(self):
        self.state = START
        self.waiting, self.letter, self.faults, self.at = "", 0, "", 0
        self.cost: int | None = None
        self.role = ""  # of the repaired turn before

    def part(self, faults: str, edits: list[str], exits: list[int], cost: list[int]) -> list[tuple[str, str]]:
        """Letters of the next block; returns turns inserted behind the block before."""
        trailing = self.rest()
        if self.cost is None:
            self.cost = cost[0]
        self.waiting, self.letter, self.faults, self.at = edits[self.state], 0, faults, 0
        self.state = exits[self.state]
        return trailing

    def rest(self) -> list[tuple[str, str]]:
        """Turns inserted behind the last turn of the block."""
        out = []
        while self.letter < len(self.waiting):
            out.append(("I", self._next_role()))
            self.letter += 1
        return out

    def _next_role(self) -> str:
        self.role = ROLES[self.role[:1] == "u"]
        return self.role

    def turn(self, role: str) -> tuple[str, str, list[tuple[str, str]]]:
        """(fault, role or nothing when deleted, edits in order as (letter, role))."""
        done, fault = [], self.faults[self.at]
        self.at += 1
        while self.waiting[self.letter] == "I":
            done.append(("I", self._next_role()))
            self.letter += 1
        letter = self.waiting[self.letter]
        self.letter += 1
        if letter == "K":
            self.role = role
        elif letter == "R":
            self._next_role()
        done.append((letter, role if letter == "D" else self.role))
        return fault, letter, done


def _streams(df: DataFrame, block: int, originals: DataFrame | None) -> tuple[DataFrame, str, str]:
    """All rows a conversation's pass needs, together and in order: its id, letters, turns."""
    kind, turn_kind = df.schema["conv_id"].dataType.simpleString(), df.schema["turn"].dataType.simpleString()
    placed = _placed(df)
    parts = materialize(_solved(_faults(placed), block, kind), "edits")
    none = {"turn": turn_kind, "role": "string", "text": "string", "faults": "string", "edits": "array<string>",
            "exits": "array<int>", "cost": "array<long>"}
    empty = lambda keep: [F.lit(None).cast(t).alias(c) for c, t in none.items() if c not in keep]
    turns = ("turn", "role", "text")
    letters = ("faults", "edits", "exits", "cost")
    rows = placed.select("conv_id", "_pos", F.lit(2).alias("_kind"), *turns, *empty(turns))
    rows = rows.unionByName(parts.select("conv_id", "_pos", F.lit(1).alias("_kind"), *letters, *empty(letters)))
    if originals is not None:
        ids = originals.select("conv_id").distinct()
        rows = rows.unionByName(ids.select("conv_id", F.lit(-1).cast("long").alias("_pos"), F.lit(0).alias("_kind"), *empty(())))
    dealt = whole_texts(rows).repartition(parallelism(df.sparkSession), "conv_id")
    return dealt.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "_pos", "_kind"), kind, turn_kind


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


_FIELDS = ("conv_id", "_kind", "turn", "role", "text", "faults", "edits", "exits", "cost")


def repaired_turns(df: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, place (from 0), turn, role, text, edit of every turn of the repaired conversations.

    `df` has conv_id, turn, role, text; other columns are not read, whatever their names. Turns are
    taken by turn (nulls first), ties by role and text; nulls in role and text are one space. A null
    conv_id is a conversation of its own. The edits are the cheapest that leave no blank or
    duplicate turn and role initials `(s?(ua)+)?`; of equally cheap ones the ASCII-least. edit:
    K kept, R given the other role, I inserted (turn null, empty text). Texts of any length are
    compared and kept whole. An empty table gives no rows.
    """
    rows, kind, turn_kind = _streams(df, block, None)

    def write(batches):
        now, walk, place = (), None, 0
        for batch in batches:
            out = {k: [] for k in ("conv_id", "place", "turn", "role", "text", "edit")}

            def put(conv, edits, turn, text):
                nonlocal place
                for letter, role in edits:
                    if letter != "D":
                        own = letter != "I"
                        for k, v in zip(out, (conv, place, turn if own else None, role, text if own else "", letter)):
                            out[k].append(v)
                        place += 1

            for conv, k, turn, role, text, *part in zip(*(batch.column(c).to_pylist() for c in _FIELDS)):
                if now != (conv,):
                    if walk:
                        put(now[0], walk.rest(), None, "")
                    now, walk, place = (conv,), _Walk(), 0
                if k == 1:
                    put(conv, walk.part(*part), None, "")
                else:
                    put(conv, walk.turn(role)[2], turn, text)
            yield pa.RecordBatch.from_pydict(out, schema)
        if walk:
            last = [(now[0], place + i, None, role, "", "I") for i, (_, role) in enumerate(walk.rest())]
            yield pa.RecordBatch.from_pydict({f.name: [r[i] for r in last] for i, f in enumerate(schema)}, schema)

    ddl = f"conv_id {kind}, place long, turn {turn_kind}, role string, text string, edit string"
    schema = _arrow(ddl)
    return rows.mapInArrow(write, ddl)


_REPORT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


def repair_report(df: DataFrame, originals: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, one row for
    each conversation of `df` and of `originals` (one without turns in `df` has zeros, an empty audit and
    the hash of an empty string).

    Faults, ties, nulls and empty tables are as in `repaired_turns`. The hash runs over the repaired
    `role:text` lines as they pass, so no conversation is held; the audit, one letter an edit, is.
    """
    rows, kind, _ = _streams(df, block, originals)

    def report(batches):
        now, walk = (), None
        for batch in batches:
            done = []
            for conv, k, turn, role, text, *part in zip(*(batch.column(c).to_pylist() for c in _FIELDS)):
                if now != (conv,):
                    if walk:
                        done.append((now[0], *walk.report()))
                    now, walk = (conv,), _Report()
                if k == 1:
                    walk.start(*part)
                elif k == 2:
                    walk.take(turn, role, text)
            yield _batch(done)
        if walk:
            yield _batch([(now[0], *walk.report())])

    schema = _arrow(f"conv_id {kind}, {_REPORT}")
    names = schema.names

    def _batch(done):
        return pa.RecordBatch.from_pydict({n: [d[i] for d in done] for i, n in enumerate(names)}, schema)

    return rows.mapInArrow(report, f"conv_id {kind}, {_REPORT}")


class _Report(_Walk):
    """Counts of one conversation, its audit and the hash of its repaired lines."""

    def __init__(self):
        super().__init__()
        self.counts = {"b": 0, "d": 0, "t": 0, ".": 0}
        self.illegal, self.audit, self.lines = 0, [], 0
        self.first = self.last_turn = self.initial = None
        self.turns = 0
        self.hash = hashlib.sha256()

    def start(self, *part) -> None:
        self._put(self.part(*part), "")

    def take(self, turn, role: str, text: str) -> None:
        fault, _, done = self.turn(role)
        self.counts[fault] += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None and turn != self.last_turn:
            self.first = turn if self.first is None else self.first
            self.last_turn, self.turns = turn, self.turns + 1
        self._put(done, text)

    def _put(self, done: list[tuple[str, str]], text: str) -> None:
        for letter, role in done:
            self.audit.append(letter)
            if letter != "D":
                line = f"{role}:{'' if letter == 'I' else text}"
                self.hash.update(("\n" * (self.lines > 0) + line).encode("utf-8", "surrogatepass"))
                self.lines += 1

    def report(self) -> tuple:
        self._put(self.rest(), "")
        gaps = 0 if self.first is None else int(self.last_turn) - int(self.first) + 1 - self.turns
        return (
            gaps, self.counts["b"], self.counts["d"], self.counts["t"], self.illegal, self.cost or 0,
            "".join(self.audit), self.hash.hexdigest(),
        )
