"""Structure repair of conversations: cheapest edits of role order by Dial's bucket-queue shortest paths.

A place in the graph is (rows consumed, state of the output); arcs are the edits. Costs are small integers, so distances
to the end come from a circular queue of buckets, and a walk along tight arcs that takes the ASCII-least letter at each
place spells the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, Scratch, map_arrow, partitions, table

#: Costs of edits, and what a truncated row adds that is not deleted.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: What the output ends in: nothing yet, a system turn, a user's, an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or assistant turn, whichever may follow; states that it may follow on.
STEP = (USER, USER, ASSISTANT, USER)
FROM = ((), (), (START, SYSTEM, ASSISTANT), (USER,))
NAMES = ("", "system", "user", "assistant")
#: Costs and letters of what completes an output in each state.
TAIL_COSTS, TAILS = (0, 2 * INSERT, INSERT, 0), ("", "I" * 2, "I", "")
#: Faults of rows; those of the first two must be deleted.
BLANK, DUPLICATE, TRUNCATED, SOUND = range(4)
#: Neighbouring initials that are legal.
LEGAL = frozenset(("su", "ua", "au"))
#: Rows of a conversation over several tasks that are one piece of work.
CHUNK = 4096
FAR = 1 << 60

Row = tuple[str, int]


def _keeps(state: int, initial: str) -> int | None:
    """The state after keeping a row, None where its role can't follow."""
    if initial == "s":
        return SYSTEM if state == START else None
    return STEP[state] if initial == NAMES[STEP[state]][0] else None


def distances(rows: list[Row], exits: tuple[int, ...]) -> list[int]:
    """Least cost from each place 4 * row + state to the end, where leaving in a state costs what exits has for it.

    Dial's queue, backwards from the exits: a bucket holds the places of one distance; as no arc costs more than 6 and
    exits lie in a narrow range, a ring of few buckets does. Inserting after the last row is left to what follows.
    """
    end = 4 * len(rows)
    found = [FAR] * (end + 4)
    seeds = {end + s: c for s, c in enumerate(exits) if c < FAR}
    at = min(seeds.values())
    ring: list[list[int]] = [[] for _ in range(max(seeds.values()) - at + max(INSERT, REROLE + CUT_OFF, DELETE) + 1)]
    size, waiting = len(ring), len(seeds)
    for place, cost in seeds.items():
        found[place] = cost
        ring[cost % size].append(place)

    while waiting:
        bucket = ring[at % size]
        while bucket:
            place = bucket.pop()
            waiting -= 1
            if found[place] != at:
                continue
            row, state = place >> 2, place & 3
            arcs = [(4 * row + s, INSERT) for s in FROM[state]] if place < end else []
            if row:
                initial, fault = rows[row - 1]
                before = 4 * row - 4
                arcs.append((before + state, DELETE))
                if fault >= TRUNCATED:
                    extra = CUT_OFF if fault == TRUNCATED else 0
                    arcs += [(before + s, REROLE + extra) for s in FROM[state]]
                    if state == SYSTEM and initial == "s":
                        arcs.append((before + START, extra))
                    elif state > SYSTEM and initial == NAMES[state][0]:
                        arcs += [(before + s, extra) for s in FROM[state]]
            for other, cost in arcs:
                if at + cost < found[other]:
                    found[other] = at + cost
                    ring[(at + cost) % size].append(other)
                    waiting += 1
        at += 1
    return found


def walk(rows: list[Row], found: list[int], state: int) -> tuple[str, int]:
    """The ASCII-least letters along tight arcs from the first row in a state, and the state that they end in."""
    letters, row = [], 0
    while row < len(rows):
        here, after = found[4 * row + state], 4 * row + 4
        initial, fault = rows[row]
        if here == DELETE + found[after + state]:
            letters.append("D")
            row += 1
            continue
        if here == INSERT + found[4 * row + STEP[state]]:
            letters.append("I")
            state = STEP[state]
            continue
        to = _keeps(state, initial) if fault >= TRUNCATED else None
        if to is not None and here == (CUT_OFF if fault == TRUNCATED else 0) + found[after + to]:
            letters.append("K")
            state = to
        else:
            letters.append("R")
            state = STEP[state]
        row += 1
    return "".join(letters), state


@lru_cache(1 << 16)
def _short(rows: tuple[Row, ...]) -> tuple[int, str]:
    found = distances(list(rows), TAIL_COSTS)
    letters, state = walk(list(rows), found, START)
    return found[START], letters + TAILS[state]


def cheapest(rows: list[Row]) -> tuple[int, str]:
    """Cost and audit of a whole conversation; those of short ones, of which few kinds exist, are kept."""
    return _short(tuple(rows)) if len(rows) <= 64 else _short.__wrapped__(tuple(rows))


def own_fault(text: str) -> int:
    """A row's fault but for being a duplicate."""
    seen = text.rstrip(SPACES)
    return BLANK if not seen else SOUND if seen[-1] in ".!?" else TRUNCATED


class _Output:
    """Applies letters to rows: yields (letter, role, text) of each edit in order."""

    def __init__(self, state: int = START):
        self.state = state

    def inserts(self, letters: Iterator[str]) -> Iterator[tuple[str, str, str]]:
        for _ in letters:
            self.state = STEP[self.state]
            yield "I", NAMES[self.state], ""

    def row(self, letter: str, role: str, text: str) -> tuple[str, str, str]:
        if letter == "D":
            return letter, role, text
        self.state = STEP[self.state] if letter == "R" or role[:1] != "s" else SYSTEM
        return letter, NAMES[self.state] if letter == "R" else role, text


def edits(letters: str, rows: Iterator[tuple[str, str]], state: int = START) -> Iterator[tuple[str, str, str]]:
    """(letter, role, text) of each edit; a deleted row has its own role and text."""
    out = _Output(state)
    at = 0
    for role, text in rows:
        stop = at
        while letters[stop] == "I":
            stop += 1
        yield from out.inserts(letters[at:stop])
        yield out.row(letters[stop], role, text)
        at = stop + 1
    yield from out.inserts(letters[at:])


class _Digest:
    """SHA-256 of the repaired lines, fed one by one."""

    def __init__(self):
        self.sha, self.first = hashlib.sha256(), True

    def add(self, letter: str, role: str, text: str) -> None:
        if letter != "D":
            self.sha.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
            self.first = False


def _gaps(turns: list) -> int:
    known = [t for t in turns if t is not None]
    return max(known) - min(known) + 1 - len(set(known)) if known else 0


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_EDIT = "step long, edit string, role string, text string"
_PIECE = "turn long, old_role string, old_text string, digest binary, chunk long, place long, fault int"


def _batch(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) for c, k in kinds.items()], list(kinds))


class _Collector:
    """Rows as dicts, handed on as batches of bounded size."""

    def __init__(self, schema: list[str], kinds: dict[str, pa.DataType]):
        self.names, self.kinds = schema, kinds
        self.columns: dict[str, list] = {c: [] for c in schema}
        self.bytes = 0

    def add(self, **row) -> None:
        for c in self.names:
            self.columns[c].append(row.get(c))
        self.bytes += 100 + len(row.get("text") or "") + len(row.get("old_text") or "") + len(row.get("audit") or "")

    def full(self) -> bool:
        return self.bytes > 4 << 20

    def take(self) -> pa.RecordBatch:
        out = _batch(self.columns, self.kinds)
        self.columns, self.bytes = {c: [] for c in self.names}, 0
        return out


def _arrow(schema) -> dict[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return {f.name: to_arrow_type(f.dataType) for f in schema}


def _stream(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            yield from zip(*(batch.slice(start, 1024).column(c).to_pylist() for c in names))


def _whole_or_pieces(names: list[str], kinds: dict[str, pa.DataType], texts: bool):
    """Conversations that lie inside a task are repaired there; the first and the last, which may go on in its
    neighbours, are handed on as rows with their places (chunk, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Collector(names, kinds)
        task = TaskContext.get().partitionId() << 33
        position = 0

        def piece(conv, turn, role, text, times) -> None:
            nonlocal position
            for _ in range(max(1, times)):
                digest = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest() if times else None
                out.add(whole=False, conv_id=conv, turn=turn, old_role=role, old_text=text, digest=digest, chunk=task + position // CHUNK, place=position % CHUNK, fault=own_fault(text) if times else None)
                position += 1

        def finish(conv, held: list[tuple]) -> None:
            rows, turns, symbols, seen, counts = [], [], [], set(), [0, 0, 0, 0]
            for turn, role, text, times in held:
                for _ in range(times):
                    fault = own_fault(text)
                    if fault != BLANK and (role, text) in seen:
                        fault = DUPLICATE
                    seen.add((role, text))
                    rows.append((role, text))
                    turns.append(turn)
                    symbols.append((role[:1], fault))
                    counts[fault] += 1
            cost, audit = cheapest(symbols)
            done = edits(audit, iter(rows))
            if texts:
                for step, (letter, role, text) in enumerate(done):
                    out.add(whole=True, conv_id=conv, step=step, edit=letter, role=role, text=text)
                return
            sha = _Digest()
            for edit in done:
                sha.add(*edit)
            illegal = sum(a + b not in LEGAL for (a, _), (b, _) in zip(symbols, symbols[1:]))
            out.add(whole=True, conv_id=conv, gaps=_gaps(turns), blank=counts[BLANK], duplicate=counts[DUPLICATE], truncated=counts[TRUNCATED], illegal=illegal, cost=cost, audit=audit, repaired_sha256=sha.sha.hexdigest())

        number, current, held = -1, None, []
        for conv, *row in _stream(batches, ["conv_id", "turn", "role", "text", "times"]):
            if number < 0 or conv != current:
                if number > 0:
                    finish(current, held)
                number, current, held = number + 1, conv, []
            if number == 0:
                piece(conv, *row)
            else:
                held.append(tuple(row))
            if out.full():
                yield out.take()
        for row in held:
            piece(current, *row)
            if out.full():
                yield out.take()
        yield out.take()

    return run


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs through each chunk from every state to every state, and the counts of its rows."""
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("conv", "chunk", "symbols", "costs", "counts")}
        for conv, chunk, rows in zip(batch.column("conv").to_pylist(), batch.column("chunk").to_pylist(), batch.column("rows").to_pylist()):
            symbols = [(r["initial"], r["fault"]) for r in rows]
            columns = [distances(symbols, tuple(0 if s == to else FAR for s in range(4)))[:4] for to in range(4)]
            out["conv"].append(conv)
            out["chunk"].append(chunk)
            out["symbols"].append([{"initial": i, "fault": f} for i, f in symbols])
            out["costs"].append([columns[to][s] for s in range(4) for to in range(4)])
            out["counts"].append([sum(f == k for _, f in symbols) for k in range(3)] + [sum(a + b not in LEGAL for (a, _), (b, _) in zip(symbols, symbols[1:]))])
        yield pa.RecordBatch.from_arrays([pa.array(out["conv"], pa.string()), pa.array(out["chunk"], pa.int64()), pa.array(out["symbols"], _SYMBOLS), pa.array(out["costs"], pa.list_(pa.int64())), pa.array(out["counts"], pa.list_(pa.int64()))], list(out))


_SYMBOLS = pa.list_(pa.struct([("initial", pa.string()), ("fault", pa.int32())]))


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk of a conversation, what leaving it in each state costs up to the end."""
    for batch in batches:
        for conv, chunks in zip(batch.column("conv").to_pylist(), batch.column("chunks").to_pylist()):
            cost, ids, exits = list(TAIL_COSTS), [], []
            for c in reversed(chunks):
                ids.append(c["chunk"])
                exits.append(cost)
                cost = [min(c["costs"][4 * s + to] + cost[to] for to in range(4)) for s in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array([conv] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(exits, pa.list_(pa.int64())), pa.array([cost[START]] * len(ids), pa.int64())], ["conv", "chunk", "exits", "cost"])


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk, the letters and the state at its end for every state at its beginning."""
    for batch in batches:
        letters, ends = [], []
        for rows, exits in zip(batch.column("symbols").to_pylist(), batch.column("exits").to_pylist()):
            symbols = [(r["initial"], r["fault"]) for r in rows]
            found = distances(symbols, tuple(exits))
            both = [walk(symbols, found, s) for s in range(4)]
            letters.append([b[0] for b in both])
            ends.append([b[1] for b in both])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv", "chunk", "cost")), pa.array(letters, pa.list_(pa.string())), pa.array(ends, pa.list_(pa.int32()))], ["conv", "chunk", "cost", "letters", "ends"])


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The letters of each chunk along the conversation, those that complete it in the last one's."""
    for batch in batches:
        for conv, chunks in zip(batch.column("conv").to_pylist(), batch.column("chunks").to_pylist()):
            state, begins, letters = START, [], []
            for c in chunks:
                begins.append(state)
                letters.append(c["letters"][state])
                state = c["ends"][state]
            letters[-1] += TAILS[state]
            yield pa.RecordBatch.from_arrays([pa.array([conv] * len(chunks), pa.string()), pa.array([c["chunk"] for c in chunks], pa.int64()), pa.array(begins, pa.int32()), pa.array(letters, pa.string())], ["conv", "chunk", "begin", "letters"])


def _apply(names: list[str], kinds: dict[str, pa.DataType], texts: bool):
    """Streams rows in order, each chunk's letters before its rows, to edits or to one digest a conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Collector(names, kinds)
        current, sha, step, output, letters, at = None, None, 0, None, "", 0

        def put(edit: tuple[str, str, str]) -> None:
            nonlocal step
            if texts:
                out.add(conv=current, step=step, edit=edit[0], role=edit[1], text=edit[2])
            else:
                sha.add(*edit)
            step += 1

        def inserts() -> None:
            nonlocal at
            while at < len(letters) and letters[at] == "I":
                for edit in output.inserts("I"):
                    put(edit)
                at += 1

        for conv, place, begin, new, role, text in _stream(batches, ["conv", "place", "begin", "letters", "old_role", "old_text"]):
            if place < 0:
                inserts()
                if conv != current:
                    if sha is not None and not texts:
                        out.add(conv=current, repaired_sha256=sha.sha.hexdigest())
                    current, sha, step = conv, _Digest(), 0
                output, letters, at = _Output(begin), new, 0
            else:
                inserts()
                put(output.row(letters[at], role, text))
                at += 1
            if out.full():
                yield out.take()
        inserts()
        if sha is not None and not texts:
            out.add(conv=current, repaired_sha256=sha.sha.hexdigest())
        yield out.take()

    return run


def _over_tasks(pieces: DataFrame, scratch: Scratch, texts: bool, parts: int) -> DataFrame:
    """Conversations that may lie in several tasks, by chunks of CHUNK rows.

    Costs through each chunk are found side by side; a fold over a conversation's chunks (16 numbers each) gives what
    leaving each of them costs, with which their letters are found side by side again. Only the digest of a
    conversation's text, a chain by its nature, streams through one task, one row at a time.
    """
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    rows = pieces.withColumn("conv", conv)
    there = rows.filter("digest is not null")
    repeated = there.groupBy("conv", "digest").agg(F.count("*").alias("n"), F.min(F.struct("chunk", "place")).alias("first")).filter("n > 1").drop("n")
    later = F.coalesce(F.struct("chunk", "place") > F.col("first"), F.lit(False)) & (F.col("fault") != BLANK)
    judged = there.join(repeated, ["conv", "digest"], "left").select("conv", "chunk", "place", F.substring("old_role", 1, 1).alias("initial"), F.when(later, DUPLICATE).otherwise(F.col("fault")).alias("fault"))
    # an aggregate's list is never null: a chunk of dropped rows only keeps an empty one
    kept = judged.unionByName(rows.filter("digest is null").select("conv", "chunk", "place", F.lit(None).cast("string").alias("initial"), F.lit(None).cast("int").alias("fault")))
    listed = F.sort_array(F.collect_list(F.when(F.col("fault").isNotNull(), F.struct("place", "initial", "fault"))))
    grouped = kept.repartition(parts, "conv", "chunk").groupBy("conv", "chunk").agg(listed.alias("rows"))
    chunks = scratch.save(map_arrow(grouped, _matrices, "conv string, chunk long, symbols array<struct<initial string, fault int>>, costs array<long>, counts array<long>"), "chunks")
    by_conv = chunks.select("conv", "chunk", "costs").groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("chunk", "costs"))).alias("chunks"))
    exits = map_arrow(by_conv, _exits, "conv string, chunk long, exits array<long>, cost long")
    walked = map_arrow(chunks.select("conv", "chunk", "symbols").join(exits, ["conv", "chunk"]), _walks, "conv string, chunk long, cost long, letters array<string>, ends array<int>")
    walked = scratch.save(walked, "walked")
    ways = walked.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("chunk", "letters", "ends"))).alias("chunks"))
    chosen = scratch.save(map_arrow(ways, _chosen, "conv string, chunk long, begin int, letters string"), "chosen")

    marks = chosen.select("conv", "chunk", F.lit(-1).cast("long").alias("place"), "begin", "letters", F.lit(None).cast("string").alias("old_role"), F.lit(None).cast("string").alias("old_text"))
    lines = there.select("conv", "chunk", "place", F.lit(None).cast("int").alias("begin"), F.lit(None).cast("string").alias("letters"), "old_role", "old_text")
    order = ["conv", "chunk", "place"]
    sorted_ = marks.unionByName(lines).repartition(parts, "conv").sortWithinPartitions(*order)
    schema = f"conv string, {_EDIT}" if texts else "conv string, repaired_sha256 string"
    kinds = _arrow(scratch.spark.createDataFrame([], schema).schema)
    applied = map_arrow(sorted_, _apply(list(kinds), kinds, texts), schema)
    ids = rows.groupBy("conv").agg(F.first("conv_id").alias("conv_id"))
    if texts:
        return applied.join(ids, "conv").select("conv_id", *kinds.keys() - {"conv"})
    turns = there.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    ends = chunks.select("conv", F.struct("chunk", F.get("symbols", 0)["initial"].alias("first"), F.try_element_at(F.col("symbols"), F.lit(-1))["initial"].alias("last")).alias("end"), "counts", F.size("symbols").alias("n"))
    sums = ends.groupBy("conv").agg(*(F.sum(F.col("counts")[k]).alias(name) for k, name in enumerate(("blank", "duplicate", "truncated", "illegal"))), F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.col("end")))).alias("ends"))
    crossing = F.expr("size(filter(sequence(1, greatest(size(ends), 1)), i -> i < size(ends) and concat(ends[i - 1].last, ends[i].first) not in ('su', 'ua', 'au')))")
    sums = sums.withColumn("illegal", F.col("illegal") + crossing).drop("ends")
    audit = chosen.groupBy("conv").agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("chunk", "letters"))), lambda c: c["letters"])).alias("audit"))
    cost = walked.groupBy("conv").agg(F.first("cost").alias("cost"))
    found = ids.join(sums, "conv").join(audit, "conv").join(cost, "conv").join(applied, "conv").join(turns, "conv", "left")
    return found.select("conv_id", F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"), *(F.col(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), "audit", "repaired_sha256")


def _repair(rows: DataFrame, texts: bool) -> DataFrame:
    times = F.col("times") if "times" in rows.columns else F.lit(1)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), times.cast("int").alias("times"))
    scratch, parts = Scratch(rows.sparkSession), partitions(rows)
    placed = rows.withColumns({"_start": F.substring("text", 1, 64), "_hash": F.xxhash64("text"), "_place": F.xxhash64(F.monotonically_increasing_id())})
    order = ["conv_id", "turn", "role", "_start", "_hash", "_place"]
    placed = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_start", "_hash", "_place")
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"whole boolean, conv_id {kind}, {_EDIT if texts else _REPORT}, {_PIECE}"
    kinds = _arrow(rows.sparkSession.createDataFrame([], schema).schema)
    found = scratch.save(map_arrow(placed, _whole_or_pieces(list(kinds), kinds, texts), schema), "repaired")
    columns = ["conv_id", *(c.split()[0] for c in (_EDIT if texts else _REPORT).split(", "))]
    over = _over_tasks(found.filter("not whole").select("conv_id", *(c.split()[0] for c in _PIECE.split(", "))), scratch, texts, parts)
    return found.filter("whole").select(columns).unionByName(over.select(columns))


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation: gaps in its turns, rows of each fault, illegal neighbours, the cheapest edits and what they give.

    rows: conv_id, turn, role, text, and optionally times, how often a row stands there (0: dropped; a conversation of
    dropped rows alone is reported as empty). Null roles and texts count as one space; a null conv_id is a conversation of
    its own; null turns come first. Rows alike in turn are ordered by role, then by the first 64 characters of the text, then by its
    hash; rows alike in all are repeats. Further columns are ignored; an empty table gives no rows.

    Rows are dealt by ranges of (conv_id, turn, ...), so a conversation of any length is spread over tasks. Those that lie
    in one task, all but two a task, are repaired there in one pass; the others by chunks (_over_tasks).
    """
    return _repair(rows, False)


def repaired(rows: DataFrame) -> DataFrame:
    """Every edit in order: conv_id, step from 0, edit (K, R, D or I), and the role and text that it leaves (of D: removes)."""
    return _repair(rows, True)


def damage(rows: DataFrame) -> DataFrame:
    """rows with faults by the hash of `conv_id:turn`, nulls one space: of 20 remainders, 0 drops a row, 1 empties its text, 2
    removes `.!?`, 3 repeats it and 4 makes it the user's."""

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(text("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text")).alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"),
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations")))
