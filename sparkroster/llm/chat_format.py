"""Chat formatting: a hidden Markov model over speaker markers and line features recovers the roles of a
transcript by Viterbi; turns are then rendered in one form."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import SMALL_LIST
from .common import materialised

ROLES = ("system", "user", "assistant")
PART_TURNS = 512
# Names that transcripts give their speakers.
NAMES = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "q", "customer", "prompter"),
    "assistant": ("assistant", "ai", "bot", "a", "agent", "model"),
}
STYLES = (("System: ", "User: ", "Assistant: "), ("Instructions: ", "Human: ", "AI: "), ("[system] ", "[user] ", "[bot] "), ("Context: ", "Q: ", "A: "))
ROLE_OF = {name: role for role, names in NAMES.items() for name in names}
MARKER = re.compile(r"\s*(?:\[(\w{1,12})\]|<\|?(\w{1,12})\|?>|(?:#+ *)?(\w{1,12}) ?:)[ \t]*", re.ASCII)
FEATURES = ("marker", "after_blank", "question", "length", "lower")


def marker_of(line: str) -> tuple[str, int]:
    """The role that the line's speaker marker names, `none` or `other`, and where the line's text begins."""
    m = MARKER.match(line)
    if not m:
        return "none", 0
    role = ROLE_OF.get(next(g for g in m.groups() if g is not None).lower())
    return (role, m.end()) if role else ("other", 0)


def line_features(lines: list[str]) -> list[tuple[str, ...]]:
    """FEATURES of each line that is not blank, with its number first left to the caller."""
    out = []
    blank = True
    for line in lines:
        if not line.strip():
            blank = True
            continue
        role, begin = marker_of(line)
        text = line[begin:].strip()
        size = str(min(6, int(math.log2(len(text) + 1)) // 2))
        out.append((role, str(blank), str(text.endswith("?")), size, str(text[:1].islower())))
        blank = False
    return out


@dataclass
class RoleModel:
    """Log-probabilities of the states (role, begins a turn): 0 to 2 begin a turn of a role, 3 to 5 go on with it."""

    first: np.ndarray
    move: np.ndarray
    emit: tuple[dict[tuple[int, str], float], ...]
    unseen: tuple[float, ...]

    def line(self, seen: tuple[str, ...]) -> np.ndarray:
        out = np.zeros(2 * len(ROLES))
        for k, value in enumerate(seen):
            out += [self.emit[k].get((s, value), self.unseen[k]) for s in range(len(out))]
        return out

    def states(self, seen: list[tuple[str, ...]], entry: int | None = None, leave: int | None = None) -> list[int]:
        """The likeliest states of the lines, by Viterbi; of equals the lowest numbers. `entry` is the state of the
        line before them, if there is one, and `leave` that of the last line, if it is known."""
        if not seen:
            return []
        known: dict[tuple[str, ...], np.ndarray] = {}
        best = (self.first if entry is None else self.move[entry]) + self.line(seen[0])
        back = []
        for line in seen[1:]:
            if line not in known:
                known[line] = self.line(line)
            ways = best[:, None] + self.move
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + known[line]
        path = [int(best.argmax()) if leave is None else leave]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return path[::-1]


    def passage(self, seen: list[tuple[str, ...]]) -> np.ndarray:
        """Best scores of the lines by the state of the line before them (last row: there is none) and of the last."""
        scores = np.vstack([self.move, self.first])
        for i, line in enumerate(seen):
            scores = scores if not i else (scores[:, :, None] + self.move).max(axis=1)
            scores = scores + self.line(line)
        return scores


def lines_of(text: str) -> list[str]:
    return re.split(r"\r\n|\n|\r", text)


def parse(text: str, model: RoleModel, entry: int | None = None, leave: int | None = None) -> list[tuple[str, str]]:
    """`(role, text)` of each turn of a transcript, markers taken off; blank lines around a turn are not its own.
    For `entry` and `leave` see `RoleModel.states`."""
    lines = lines_of(text)
    states = iter(model.states(line_features(lines), entry, leave))
    turns: list[tuple[str, list[str]]] = []
    for line in lines:
        if not line.strip():
            if turns:
                turns[-1][1].append("")
            continue
        state = next(states)
        role = ROLES[state % len(ROLES)]
        if state < len(ROLES) or not turns:
            turns.append((role, []))
            role_marked, begin = marker_of(line)
            line = line[begin:] if role_marked in ROLES else line
        turns[-1][1].append(line)
    return [(role, "\n".join(body).strip("\n")) for role, body in turns]


def rendered(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in turns)


def train_roles(transcripts: DataFrame) -> RoleModel:
    """Count states, moves and features of the lines of `transcripts(turns)`, turns being an array of
    `(role, line)` with the marker in the line. The counts, some hundred rows, come to the driver; all have
    one added. Turns of other roles count as the user's."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            for turns in batch.column(0).to_pylist():
                lines: list[str] = []
                states: list[int] = []
                for turn in turns or []:
                    role = ROLES.index(turn["role"]) if turn["role"] in ROLES else 1
                    body = re.split(r"\r\n|\n|\r", turn["line"] or "")
                    full = [i for i, line in enumerate(body) if line.strip()]
                    states += [role if i == full[0] else role + len(ROLES) for i in full]
                    lines += [*body, ""]
                for state, seen in zip(states, line_features(lines), strict=True):
                    total.update((f"feature{k}", state, value) for k, value in enumerate(seen))
                total.update(("move", a, str(b)) for a, b in zip(states, states[1:], strict=False))
                if states:
                    total["first", states[0], ""] += 1
            rows = sorted(total)
            yield pa.RecordBatch.from_pydict({"kind": pa.array([r[0] for r in rows], pa.string()), "state": pa.array([r[1] for r in rows], pa.int32()), "value": pa.array([r[2] for r in rows], pa.string()), "n": pa.array([total[r] for r in rows], pa.int64())})

    counts = transcripts.select("turns").mapInArrow(counted, "kind string, state int, value string, n long")
    rows = counts.groupBy("kind", "state", "value").agg(F.sum("n").alias("n")).collect()
    size = 2 * len(ROLES)
    first, move = np.ones(size), np.ones((size, size))
    # A continued turn keeps its role, and no transcript begins inside a turn.
    for a in range(size):
        for role in range(len(ROLES)):
            if role != a % len(ROLES):
                move[a, len(ROLES) + role] = 0
    first[len(ROLES) :] = 0
    seen: list[Counter] = [Counter() for _ in FEATURES]
    for r in rows:
        if r["kind"] == "first":
            first[r["state"]] += r["n"]
        elif r["kind"] == "move":
            move[r["state"], int(r["value"])] += r["n"]
        else:
            seen[int(r["kind"].removeprefix("feature"))][r["state"], r["value"]] += r["n"]
    with np.errstate(divide="ignore"):
        first, move = np.log(first / first.sum()), np.log(move / move.sum(axis=1, keepdims=True))
    emit, unseen = [], []
    for counter in seen:
        values = {v for _, v in counter} | {"?"}
        totals = [sum(counter[s, v] for v in values) + len(values) for s in range(size)]
        emit.append({(s, v): math.log((counter[s, v] + 1) / totals[s]) for s in range(size) for v in values})
        unseen.append(math.log(1 / max(totals)))
    return RoleModel(first, move, tuple(emit), tuple(unseen))


TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def parsed(text: Column, model: RoleModel, entry: Column | None = None, leave: Column | None = None) -> Column:
    """`array<struct<role, text>>` of a transcript column; empty for null and blank texts. `entry` and `leave` are columns
    with the states around and at the end of a part of a longer transcript, null where not known."""

    @F.arrow_udf(TURNS)
    def turns(texts: pa.Array, before: pa.Array, last: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        rows = zip(texts.to_pylist(), before.to_pylist(), last.to_pylist(), strict=True)
        return pa.array([[{"role": r, "text": t} for r, t in parse(x, model, a, b)] for x, a, b in rows], kind)

    none = F.lit(None).cast("int")
    return turns.asNondeterministic()(F.coalesce(text, F.lit("")), none if entry is None else entry, none if leave is None else leave)


AROUND = "part long, piece long, entry int, leave int"


def part_states(parts: DataFrame, model: RoleModel) -> DataFrame:
    """`conv_id, part, piece, entry, leave` for `parts(conv_id, part, piece, transcript)` of conversations that have several:
    the states before the first and at the last line of each, as Viterbi over the whole conversation has them.

    Every part becomes a small matrix, its best scores by the states around it. The matrices of a conversation
    pass one after the other through a task, which keeps six numbers of each for the way back."""
    size = 2 * len(ROLES)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def passages(texts: pa.Array) -> pa.Array:
        rows = [model.passage(line_features(lines_of(x))) if x.strip() else np.empty((0, size)) for x in texts.to_pylist()]
        ends = np.cumsum([0, *(r.size for r in rows)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0), *(r.ravel() for r in rows)])))

    kind = parts.schema["conv_id"].dataType.simpleString()

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, best, held = None, None, []

        def settled() -> pa.RecordBatch:
            out, leave = [], None if best is None else int(best.argmax())
            for part, piece, back in reversed(held):
                entry = None if back is None or leave is None else int(back[leave])
                entry = None if entry is None or entry == size else entry
                out.append((part, piece, entry, leave if back is not None else None))
                leave = leave if back is None else entry
            columns = list(zip(*reversed(out), strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            ids = pa.array([conv] * len(out), schema)
            return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["conv_id", "part", "piece", "entry", "leave"])

        schema = None
        for batch in batches:
            schema = batch.schema.field("conv_id").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "piece")), batch.column("scores"), strict=True):
                if held and row[0] != conv:
                    yield settled()
                    best, held = None, []
                conv, part, piece, scores = row
                matrix = scores.values.to_numpy().reshape(-1, size)
                if not len(matrix):
                    held.append((part, piece, None))
                    continue
                ways = matrix[-1:] if best is None else best[:, None] + matrix[:-1]
                held.append((part, piece, np.full(size, size, np.int8) if best is None else ways.argmax(axis=0).astype(np.int8)))
                best = ways.max(axis=0)
        if held:
            yield settled()

    rows = parts.select("conv_id", "part", "piece", passages.asNondeterministic()("transcript").alias("scores"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return rows.mapInArrow(chained, f"conv_id {kind}, {AROUND}")


def canonical(turns: Column) -> Column:
    """The turns in one form: a role line, the text, an end line."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n<|end|>\n"))), "")


def in_pieces(rows: DataFrame) -> DataFrame:
    """`rows(conv_id, part, turn, role, text)` with `piece`: 0, but parts of over `PART_TURNS` rows are cut by row
    number, in order of turn, role, the first 100 characters and a hash of the text.

    The rows of such parts are dealt out by ranges of that order, whatever part they are of, and numbered
    within a range; the counts of the ranges before give the offsets. No task gets a whole hot part."""
    part = ["conv_id", "part"]
    large = rows.groupBy(part).count().where(F.col("count") > PART_TURNS)
    large = materialised(large.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part")), "large-parts")
    n_large = large.count()
    if not n_large:
        return rows.withColumn("piece", F.lit(0).cast("long"))
    listed = F.broadcast(large) if n_large <= SMALL_LIST else large
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))
    small = rows.join(listed, same, "left_anti").withColumn("piece", F.lit(0).cast("long"))
    # Rows alike in all else are told apart by a running number, so that they too can be dealt out.
    order = ["turn", "role", "_start", "_hash", "_row"]
    dealt = rows.join(listed, same, "left_semi").withColumns({"_start": F.substring("text", 1, 100), "_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    dealt = materialised(dealt.repartitionByRange(*part, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    numbered = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("_range", *part).orderBy(*order)))
    before = F.sum("count").over(Window.partitionBy(part).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = dealt.groupBy("_range", *part).count().withColumn("_before", F.coalesce(before, F.lit(0)))
    offsets = offsets.select(F.col("_range").alias("_at"), F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), "_before")
    placed = numbered.join(offsets, same & (F.col("_range") == F.col("_at")))
    piece = F.floor((F.col("_before") + F.col("_n") - 1) / PART_TURNS)
    return small.unionByName(placed.select(*rows.columns, piece.alias("piece")))


def transcripts_of(conversations: DataFrame) -> DataFrame:
    """`conv_id, part, piece, turns, transcript`: the turns of `conversations(conv_id, turn, role, text)` in order, as
    one text in which a fifth of the turns has lost its speaker marker.

    A conversation is written in parts of `PART_TURNS` turn numbers, and these in pieces of as many rows, so
    that no row grows without bound. Repeated rows are turns like any other; turns of one number stand in order
    of role and text. Null texts are empty, a null turn stands first; a null conversation id is a conversation of its own.
    """
    part = F.coalesce(F.floor(F.col("turn") / PART_TURNS), F.lit(0)).alias("part")
    rows = conversations.select("conv_id", part, "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = in_pieces(materialised(rows, "turns"))
    style = F.pmod(F.xxhash64(F.lit(11), "conv_id"), F.lit(len(STYLES)))
    names = F.lit([list(s) for s in STYLES])[style.cast("int")]
    place = F.when(F.col("role") == "system", 0).when(F.col("role") == "assistant", 2).otherwise(1)
    silent = F.pmod(F.xxhash64(F.lit(13), "conv_id", "turn"), F.lit(5)) == 0
    line = F.concat(F.when(silent, "").otherwise(F.element_at(names, place + 1)), "text")
    turns = rows.select("conv_id", "part", "piece", F.struct("turn", "role", "text", line.alias("line")).alias("t"))
    grouped = turns.groupBy("conv_id", "part", "piece").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return grouped.withColumn("transcript", F.array_join(F.transform("turns", lambda t: t["line"]), "\n\n"))


def formatted_conversations(conversations: DataFrame) -> DataFrame:
    """`conv_id, part, piece, held_out, n_turns, n_found, n_right, rendered`: the transcripts of `conversations`, parsed
    without their role column by a model trained on the others four fifths of the conversations.

    Parts of a long conversation are parsed as one chain of states: each starts from the state that the part before
    it ends in. `n_right` counts the turns found at their place with their role and text. Very long texts are
    worked on whole, a part in a task. Empty tables give an empty result, and a table without a turn
    outside the held-out fold an untrained model.
    """
    rows = transcripts_of(conversations).withColumn("held_out", F.pmod(F.xxhash64(F.lit(17), "conv_id"), F.lit(5)) == 0)
    rows = materialised(rows, "transcripts")
    model = train_roles(rows.where("NOT held_out"))
    several = rows.groupBy("conv_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("conv_id").alias("_conv"))
    several = materialised(several, "long-conversations")
    none = F.lit(None).cast("int")
    if several.isEmpty():
        placed = rows.withColumns({"entry": none, "leave": none})
    else:
        same = F.col("conv_id").eqNullSafe(F.col("_conv"))
        parts = rows.select("conv_id", "part", "piece", "transcript").join(several, same, "left_semi")
        around = part_states(parts, model).withColumnsRenamed({c: f"_{c}" for c in ("conv_id", "part", "piece")})
        at = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("part") == F.col("_part")) & (F.col("piece") == F.col("_piece"))
        placed = rows.join(around, at, "left").drop("_conv_id", "_part", "_piece")
    found = placed.withColumn("found", parsed(F.col("transcript"), model, F.col("entry"), F.col("leave")))
    same = F.zip_with("turns", "found", lambda a, b: (a["role"] == b["role"]) & (F.trim(a["text"]) == F.trim(b["text"])))
    right = F.size(F.filter(same, lambda s: F.coalesce(s, F.lit(False))))
    return found.select("conv_id", "part", "piece", "held_out", F.size("turns").alias("n_turns"), F.size("found").alias("n_found"), right.alias("n_right"), canonical(F.col("found")).alias("rendered"))
