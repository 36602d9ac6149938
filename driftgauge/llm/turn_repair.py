"""Repair of conversation structure by an auction for shortest paths.

The rows of a conversation and the roles that may come next span a lattice: layer ``i`` stands before row ``i``, and each layer has the
states "nothing yet", "after system", "after user", "after assistant". Its arcs are the edits (keep, rerole, delete, insert) with integer costs.

The auction keeps a price for each node and a path from an origin. At the end of the path the cheapest way on (arc cost plus
the price of its head) is compared with the node's own price: if it is dearer, the price rises to it and the path
contracts by a node, otherwise the path extends along that arc. When it reaches a destination, the origin's price is its
exact distance. Layers are auctioned in blocks from the last to the first, each with the converged prices of the next as
destinations, so the work grows with the number of rows. An arc is tight when its cost is the difference of the converged prices; every
path of tight arcs is a cheapest repair, and the trace takes the tight arc with the least initial.

Conversations of up to ``chunk_rows`` rows and ``chunk_chars`` characters are repaired whole, one after the other in a sorted partition. Longer ones
are cut into chunks that are auctioned in parallel; see :func:`_long`.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftgauge.llm.storage import stored
from driftgauge.llm.text import BLANKS
from driftgauge.session import measured_broadcast

REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
STATES, BLOCK = 4, 16
NOTHING, SYSTEM, USER, ASSISTANT = range(STATES)
ROLES = {USER: "user", ASSISTANT: "assistant"}
# what a row's code says: its role's initial, and whether it must go or ends too early
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
TRUNCATED, DOOMED = 4, 8
FIELDS = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"

# (initial of the edit, cost, head)
Arc = tuple[str, float, int]


def _next(state: int) -> int:
    return ASSISTANT if state == USER else USER


@lru_cache(maxsize=64)
def _row_arcs(code: int) -> tuple[tuple[tuple[str, int, int, int], ...], ...]:
    """Per state: (initial, cost, layers forward, state after) of the edits at a row."""
    out = []
    for state in range(STATES):
        after, extra = _next(state), CUT_OFF if code & TRUNCATED else 0
        arcs = [("D", DELETE, 1, state), ("I", INSERT, 0, after)]
        if not code & DOOMED:
            if code & 3 == SYSTEM and state == NOTHING:
                arcs.append(("K", extra, 1, SYSTEM))
            arcs.append(("K", extra, 1, after) if code & 3 == after else ("R", REROLE + extra, 1, after))
        out.append(tuple(sorted(arcs)))
    return tuple(out)


def converge(arcs: list[list[Arc]], price: list[float], origin: int) -> None:
    """Raise ``price`` until that of ``origin`` is its distance to the nodes without arcs, whose prices stay."""
    path = [origin]
    while arcs[path[-1]]:
        node = path[-1]
        best, head = min((cost + price[to], to) for _, cost, to in arcs[node])
        if price[node] < best or best == math.inf:
            price[node] = best
            if len(path) > 1:
                path.pop()
            elif best == math.inf:
                return
        else:
            path.append(head)


def _block(codes: bytes, start: int, stop: int, beyond: list[float], last: bool) -> tuple[list[list[Arc]], list[float]]:
    """Arcs and first prices of the layers from ``start`` to ``stop``; ``beyond`` holds the prices of what follows.

    Within a conversation the layer ``stop`` is the destination. In the ``last`` block its nodes have arcs too: insertions, and
    free ones from "nothing yet" and "after assistant" to the end.
    """
    arcs: list[list[Arc]] = []
    for i in range(start, stop):
        at = STATES * (i - start)
        for row in _row_arcs(codes[i]):
            arcs.append([(initial, cost, at + STATES * ahead + state) for initial, cost, ahead, state in row])
    at = len(arcs)
    if last:
        end = at + STATES
        for state in range(STATES):
            arcs.append([("", 0, end)] * (state in (NOTHING, ASSISTANT)) + [("I", INSERT, at + _next(state))])
        arcs.append([])
        beyond = [0.0]
    else:
        arcs += [[] for _ in range(STATES)]
    price = [min(beyond)] * (len(arcs) - len(beyond)) + beyond
    if not last and beyond[USER] == beyond[ASSISTANT] == math.inf:
        # no way on from these states, and insertions would lead round in a circle
        for node in range(at):
            if node % STATES in (USER, ASSISTANT):
                price[node] = math.inf
    return arcs, price


class Lattice:
    """Converged prices of a run of rows, given the prices ``beyond`` its end, or none where the conversation ends."""

    def __init__(self, codes: bytes, beyond: list[float] | None = None) -> None:
        self.blocks = []
        n, last = len(codes), beyond is None
        for start in reversed(range(0, max(n, 1), BLOCK)):
            stop = min(start + BLOCK, n)
            arcs, price = _block(codes, start, stop, beyond or [0.0], last and stop == n)
            for state in range(STATES):
                converge(arcs, price, state)
            self.blocks.append((arcs, price))
            beyond = price[:STATES]
        self.blocks.reverse()
        self.prices = beyond

    def trace(self, state: int) -> tuple[str, int]:
        """The initials of the cheapest edits from ``state``, the least in ASCII order, and the state after them.

        Equal initials lead to the same state, so one node has to be followed.
        """
        audit = []
        for arcs, price in self.blocks:
            node = state
            while arcs[node]:
                for initial, cost, to in arcs[node]:
                    if price[node] == cost + price[to]:
                        converge(arcs, price, to)
                        if price[node] == cost + price[to]:
                            audit.append(initial)
                            node = to
                            break
                else:
                    raise AssertionError("no tight arc")
            state = node % STATES
        return "".join(audit), state


@lru_cache(maxsize=1 << 15)
def _short(codes: bytes) -> tuple[int, str]:
    lattice = Lattice(codes)
    return int(lattice.prices[NOTHING]), lattice.trace(NOTHING)[0]


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """Cost and initials of the cheapest edits of a conversation."""
    return _short(codes) if len(codes) <= 64 else _short.__wrapped__(codes)


def repaired(audit: str, codes: bytes, state: int = NOTHING) -> Iterator[tuple[int | None, str | None]]:
    """(row, new role) of each line that stays or comes in: the row is None for an insertion, the role None for a kept row."""
    row = 0
    for edit in audit:
        if edit == "K" and state == NOTHING and codes[row] & 3 == SYSTEM:
            state = SYSTEM
            yield row, None
        elif edit != "D":
            state = _next(state)
            yield None if edit == "I" else row, None if edit == "K" else ROLES[state]
        row += edit != "I"


def _illegal(codes: bytes) -> int:
    pairs = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
    return sum((a & 3, b & 3) not in pairs for a, b in zip(codes, codes[1:]))


def _repair(rows: list[tuple[int | None, int, str, str]]) -> tuple:
    """The fields of ``FIELDS`` for rows (turn, code, role, text) in order; a code is doomed here only if the row is blank."""
    seen: set[bytes] = set()
    codes, repeats = bytearray(), 0
    for _, code, role, text in rows:
        digest = hashlib.md5(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
        if not code & DOOMED and digest in seen:
            repeats += 1
            code = code & 3 | DOOMED
        seen.add(digest)
        codes.append(code)
    coded = bytes(codes)
    blank = sum(code & DOOMED > 0 for _, code, _, _ in rows)
    turns = {t for t, _, _, _ in rows if t is not None}
    cost, audit = cheapest_edits(coded) if rows else (0, "")
    lines = "\n".join(f"{role or rows[at][2]}:{rows[at][3] if at is not None else ''}" for at, role in repaired(audit, coded))
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, blank, repeats, sum(c & TRUNCATED > 0 for c in coded), _illegal(coded), cost, audit,
        hashlib.sha256(lines.encode("utf-8", "surrogatepass")).hexdigest(),
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, gone, turn, copy, code, role, text, tie): the rows with the faults put in; a dropped row stays with ``gone`` set.

    ``code`` holds the initial of the role and whether the row is blank or ends too early. Rows of one turn are ordered by ``tie``, a digest of role and text.
    """
    said = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(said("role"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    rows = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("bigint").alias("turn"), "role", "text", fault.alias("fault"))
    rows = rows.select("conv", (F.col("fault") == 0).alias("gone"), "turn", role.alias("role"), text.alias("text"), copies)
    body = F.rtrim("text", F.lit(BLANKS))
    first = F.substring("role", 1, 1)
    initial = F.lit(0)
    for letter, number in INITIALS.items():
        initial = F.when(first == letter, number).otherwise(initial)
    fault = F.when(body == "", DOOMED).when(F.instr(F.lit(".!?"), F.substring(body, -1, 1)) == 0, TRUNCATED).otherwise(0)
    tie = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    return rows.select("conv", "gone", "turn", "copy", (initial + fault).cast("int").alias("code"), "role", "text", tie.alias("tie"))


def _ordered() -> list[Column]:
    return [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("tie").asc(), F.col("copy").asc()]


def _whole(rows: DataFrame, kind: str) -> DataFrame:
    """Conversations one after the other; a task holds one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current, done = [], None, []

        def packed() -> pa.RecordBatch:
            columns = list(zip(*done))
            types = [key_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", *(f.split()[0] for f in FIELDS.split(", "))])

        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            for conv, gone, turn, code, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None or current[0] != conv:
                    if current is not None:
                        done.append((current[0], *_repair(held)))
                        held = []
                    if len(done) >= 5000:
                        yield packed()
                        done = []
                    current = (conv,)
                if not gone:
                    held.append((turn, code, role, text))
        if current is not None:
            done.append((current[0], *_repair(held)))
            yield packed()

    ordered = rows.repartition("conv").sortWithinPartitions(*_ordered())
    return ordered.select("conv", "gone", "turn", "code", "role", "text").mapInArrow(run, f"conv_id {kind}, {FIELDS}")


def _chunk_costs(chunks: DataFrame) -> DataFrame:
    """(conv, chunk, costs): for each chunk the cheapest cost from each state before it to each state after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            costs = []
            for codes in batch.column("codes").to_pylist():
                exits = [Lattice(codes, [0.0 if q == to else math.inf for q in range(STATES)]).prices for to in range(STATES)]
                costs.append([exits[to][q] for q in range(STATES) for to in range(STATES)])
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("chunk"), pa.array(costs, pa.list_(pa.float64()))], ["conv", "chunk", "costs"])

    return chunks.select("conv", "chunk", "codes").mapInArrow(run, f"{_kind(chunks, 'conv')}, chunk bigint, costs array<double>")


def _exits(costs: DataFrame) -> DataFrame:
    """(conv, chunk, beyond): prices of the states after each chunk, by the same auction over the lattice of chunks."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        steps = table.column("costs").to_pylist()
        beyond, out = Lattice(b"").prices, []
        for start in reversed(range(0, len(steps), BLOCK)):
            part = steps[start : start + BLOCK]
            arcs = [[("", m[STATES * q + to], STATES * (i + 1) + to) for to in range(STATES)] for i, m in enumerate(part) for q in range(STATES)]
            arcs += [[] for _ in range(STATES)]
            price = [min(beyond)] * (STATES * len(part)) + list(beyond)
            for node in range(STATES * len(part)):
                converge(arcs, price, node)
            out += [price[STATES * (i + 1) : STATES * (i + 2)] for i in reversed(range(len(part)))]
            beyond = price[:STATES]
        return pa.table({"conv": table.column("conv"), "chunk": table.column("chunk"), "beyond": pa.array(out[::-1], pa.list_(pa.float64()))})

    return costs.groupBy("conv").applyInArrow(run, f"{_kind(costs, 'conv')}, chunk bigint, beyond array<double>")


def _kind(df: DataFrame, name: str) -> str:
    return f"{name} {df.schema[name].dataType.simpleString()}"


def _traced(chunks: DataFrame, entered: bool) -> DataFrame:
    """Chunks with the state that each state before them leads to or, once it is known, with their edits and the lines these give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for codes, beyond, n, last, state in zip(*(batch.column(c).to_pylist() for c in ("codes", "beyond", "start", "last", "state"))):
                lattice = Lattice(codes, None if last else beyond)
                if not entered:
                    out.append([lattice.trace(q)[1] if lattice.prices[q] < math.inf else q for q in range(STATES)])
                    continue
                audit, _ = lattice.trace(state)
                head, lines = "", []
                for row, role in repaired(audit, codes, state):
                    if row is None:
                        head += f"{role}:\n"
                    else:
                        lines.append({"pos": n + row, "head": head, "role": role})
                        head = ""
                if head:
                    lines.append({"pos": n + len(codes), "head": head, "role": "\n"})
                out.append({"audit": audit, "cost": float(lattice.prices[state]), "lines": lines})
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("chunk"), pa.array(out, kind)], ["conv", "chunk", "traced"])

    line = pa.struct([("pos", pa.int64()), ("head", pa.string()), ("role", pa.string())])
    kind = pa.struct([("audit", pa.string()), ("cost", pa.float64()), ("lines", pa.list_(line))]) if entered else pa.list_(pa.int32())
    text = "struct<audit:string,cost:double,lines:array<struct<pos:bigint,head:string,role:string>>>" if entered else "array<int>"
    return chunks.mapInArrow(run, f"{_kind(chunks, 'conv')}, chunk bigint, traced {text}")


def _entries(steps: DataFrame) -> DataFrame:
    """(conv, chunk, state) with the state before each chunk, following ``traced`` from chunk to chunk."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        state, out = NOTHING, []
        for after in table.column("traced").to_pylist():
            out.append(state)
            state = after[state]
        return pa.table({"conv": table.column("conv"), "chunk": table.column("chunk"), "state": pa.array(out, pa.int32())})

    return steps.groupBy("conv").applyInArrow(run, f"{_kind(steps, 'conv')}, chunk bigint, state int")


def _digests(lines: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the lines (conv, pos, head, role, text) in order; a task holds one line at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, key_type = None, None, None
        put = lambda: pa.RecordBatch.from_arrays([pa.array([current[0]], key_type), pa.array([digest.hexdigest()])], ["conv", "repaired_sha256"])
        for batch in batches:
            key_type = batch.schema.field(0).type
            for conv, head, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None or current[0] != conv:
                    if current is not None:
                        yield put()
                    current, digest, begun = (conv,), hashlib.sha256(), False
                # a line of insertions alone has no text of its own
                line = head[:-1] if role == "\n" else f"{head}{role}:{text}"
                digest.update((("\n" if begun else "") + line).encode("utf-8", "surrogatepass"))
                begun = True
        if current is not None:
            yield put()

    ordered = lines.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "pos")
    return ordered.select("conv", "head", "role", "text").mapInArrow(run, f"{_kind(lines, 'conv')}, repaired_sha256 string")


def _beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal ``keys``, null equal to null."""
    renamed = right.select(*(F.col(c).alias(f"right_{c}" if c in keys else c) for c in right.columns))
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"right_{c}"))
    return left.join(renamed, same, how).drop(*(f"right_{c}" for c in keys))


def _long(rows: DataFrame, kind: str, chunk_rows: int) -> DataFrame:
    """Long conversations, cut into chunks of ``chunk_rows`` rows.

    Rows are sorted by ranges and numbered from the counts of each range, so no task meets a whole conversation. Chunks are auctioned once for
    each state after them, which gives their cost from state to state; the lattice of chunks is auctioned for each conversation (a few numbers a chunk:
    as the audit is one cell of under 2^31 characters, there are at most 2^31 / ``chunk_rows``); then chunks are traced with
    the prices beyond them. The digest of the repaired text alone has to read a conversation in order: its rows stream through one task.
    """
    numbered = rows.where("not gone").withColumn("row", F.monotonically_increasing_id())
    numbered = stored(numbered, "turn-rows")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    ranged = numbered.repartitionByRange(parts, *_ordered(), "row").sortWithinPartitions(*_ordered(), "row")
    ranged = stored(ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "turn-ranges")
    # one row for each conversation and range
    sizes = ranged.groupBy("conv", "part").agg(F.count("*").alias("n"), F.min("at").alias("least"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("conv").alias("of"), F.col("part").alias("in_part"), (before - F.col("least")).alias("shift"))
    placed = ranged.join(measured_broadcast(offsets, 128), F.col("conv").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in_part")))
    pos = F.col("at") + F.col("shift")
    placed = stored(placed.select("conv", "turn", "code", "role", "text", "tie", pos.alias("pos"), F.floor(pos / chunk_rows).alias("chunk")), "turn-places")
    # equal rows: the earliest is the one that may stay
    firsts = placed.groupBy("conv", "tie").agg(F.min("pos").alias("first")).select("conv", "first", F.floor(F.col("first") / chunk_rows).alias("chunk"))
    keep = firsts.groupBy("conv", "chunk").agg(F.collect_list("first").alias("firsts"))
    coded = placed.groupBy("conv", "chunk").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("coded"))
    marked = _beside(coded, keep, ["conv", "chunk"], "left").withColumn("firsts", F.coalesce("firsts", F.array().cast("array<bigint>")))
    most = marked.groupBy("conv").agg(F.max("chunk").alias("final"))
    marked = _beside(marked, most, ["conv"]).withColumn("last", F.col("chunk") == F.col("final"))
    chunks = stored(_coded(marked), "turn-chunks")
    exits = _exits(stored(_chunk_costs(chunks), "turn-costs"))
    priced = stored(_beside(chunks, exits, ["conv", "chunk"]).withColumn("state", F.lit(NOTHING)), "turn-prices")
    entered = _beside(priced.drop("state"), _entries(stored(_traced(priced, False), "turn-steps")), ["conv", "chunk"])
    traced = stored(_traced(entered, True), "turn-edits")
    lines = traced.select(F.col("conv").alias("of"), F.explode("traced.lines").alias("l")).select("of", F.col("l.pos").alias("line"), "l.head", F.col("l.role").alias("new_role"))
    kept = lines.join(placed.select("conv", "pos", "role", "text"), F.col("of").eqNullSafe(F.col("conv")) & (F.col("line") == F.col("pos")) & ~F.col("new_role").eqNullSafe("\n"), "left")
    digests = _digests(kept.select(F.col("of").alias("conv"), F.col("line").alias("pos"), "head", F.coalesce("new_role", "role").alias("role"), "text"))
    turns = placed.groupBy("conv", "turn").agg(F.count("*").alias("n")).groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    )
    # pairs of neighbours across chunks are counted from the first and last code of each
    across = W.partitionBy("conv").orderBy("chunk")
    pair = F.concat(F.lag("ending").over(across).cast("string"), F.col("beginning").cast("string"))
    joints = chunks.select("conv", "chunk", "beginning", "ending").withColumn("joint", F.when(~pair.isin("12", "23", "32"), 1).otherwise(0))
    sums = chunks.groupBy("conv").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "inner")))
    audits = traced.groupBy("conv").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", F.col("traced.audit").alias("audit")))), lambda x: x["audit"]), "").alias("audit"),
        F.min(F.struct("chunk", F.col("traced.cost").alias("cost")))["cost"].cast("bigint").alias("cost"),
    )
    joint = joints.groupBy("conv").agg(F.sum("joint").alias("joint"))
    out = audits
    for more in (turns, sums, joint, digests):
        out = _beside(out, more, ["conv"], "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        F.col("conv").cast(kind).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", (F.col("inner") + F.col("joint")).alias("illegal"), "cost", "audit",
        F.coalesce("repaired_sha256", empty).alias("repaired_sha256"),
    )


def _coded(marked: DataFrame) -> DataFrame:
    """Chunks (conv, chunk, start, last, codes) with the numbers of their faults, the codes at their ends and illegal pairs inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for coded, firsts in zip(batch.column("coded").to_pylist(), batch.column("firsts").to_pylist()):
                earliest, codes, blank, repeats = set(firsts), bytearray(), 0, 0
                for c in coded:
                    code = c["code"]
                    blank += code & DOOMED > 0
                    if not code & DOOMED and c["pos"] not in earliest:
                        repeats += 1
                        code = code & 3 | DOOMED
                    codes.append(code)
                coded_as = bytes(codes)
                rows.append((coded[0]["pos"], coded_as, blank, repeats, sum(c & TRUNCATED > 0 for c in coded_as), _illegal(coded_as), coded_as[0] & 3, coded_as[-1] & 3))
            types = [pa.int64(), pa.binary(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("chunk"), batch.column("last"), *(pa.array(c, t) for c, t in zip(zip(*rows), types))],
                ["conv", "chunk", "last", "start", "codes", "blank", "duplicate", "truncated", "inner", "beginning", "ending"],
            )

    fields = "chunk bigint, last boolean, start bigint, codes binary, blank bigint, duplicate bigint, truncated bigint, inner bigint, beginning bigint, ending bigint"
    return marked.select("conv", "chunk", "last", "coded", "firsts").mapInArrow(run, f"{_kind(marked, 'conv')}, {fields}")


def repair_conversations(conversations: DataFrame, chunk_rows: int = 4096, chunk_chars: int = 1 << 25) -> DataFrame:
    """One row per conv_id of ``conversations(conv_id, turn, role, text)`` after damage by :func:`damaged`: its faults and its cheapest repair.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Where several repairs cost the same,
    the one with the least audit in ASCII order is taken.

    Null conv_ids are one conversation. Null turns come first and count for no gap; null roles and texts are one space. Rows of the same turn are
    ordered by a digest of role and text, so repeated rows are neighbours and all but the first are duplicates. Texts of any length are
    compared and hashed whole. A conversation without rows after damage has zeros, an empty audit and the digest of the empty text; an empty table gives
    no rows. Other columns are not read, so their names cannot clash.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = damaged(conversations)
    chars = F.sum(F.coalesce(F.length(F.col("text").cast("string")), F.lit(1)) + 1)
    sizes = conversations.groupBy("conv_id").agg(F.count("*").alias("n"), chars.alias("chars"))
    large = stored(sizes.where((F.col("n") * 2 > chunk_rows) | (F.col("chars") * 2 > chunk_chars)).select(F.col("conv_id").alias("large")), "long-conversations")
    if not large.take(1):
        return _whole(rows, kind)
    large = measured_broadcast(large, 64)
    same = F.col("conv").eqNullSafe(F.col("large"))
    long = stored(rows.join(large, same, "left_semi"), "long-turns")
    gone = long.groupBy("conv").agg(F.min(F.col("gone").cast("int")).alias("none")).where("none = 1").select("conv")
    short = rows.join(large, same, "left_anti")
    # a long conversation whose rows are all dropped has nothing to cut
    absent = gone.select("conv", F.lit(True).alias("gone"), *(F.lit(None).cast(short.schema[c].dataType).alias(c) for c in short.columns[2:]))
    return _whole(short.unionByName(absent), kind).unionByName(_long(long, kind, chunk_rows))
