import hashlib
import random
import re
import zlib
from collections import defaultdict

from driftgauge.llm.turn_repair import repair_conversations

BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
SCHEMA = "conv_id bigint, turn bigint, role string, text string, gone string, copy int"


def damage(rows):
    out = defaultdict(list)
    said = lambda v: " " if v is None else str(v)
    for conv, turn, role, text, *_ in rows:
        out[conv]
        role, text = said(role), said(text)
        h = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        if h == 0:
            continue
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * (2 if h == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest())
    return {c: sorted(r, key=order) for c, r in out.items()}


def brute(rows):
    """Forward dynamic programme that carries whole (cost, audit, lines) tuples for each automaton state."""
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(BLANK)
        if not body:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    grammar = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"0": (0, "", ())}

    def relax(into, state, value):
        if state not in into or value < into[state]:
            into[state] = value
            return True
        return False

    def insert(at):
        again = True
        while again:
            again = False
            for state, (cost, audit, lines) in list(at.items()):
                for new in ("user", "assistant"):
                    to = grammar.get((state, new[0]))
                    if to:
                        again |= relax(at, to, (cost + 5, audit + "I", lines + (f"{new}:",)))
        return at

    insert(best)
    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit, lines) in best.items():
            relax(after, state, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 if fault == "truncated" else 0
            if to := grammar.get((state, role[:1])):
                relax(after, to, (cost + extra, audit + "K", lines + (f"{role}:{text}",)))
            for new in ("user", "assistant"):
                if to := grammar.get((state, new[0])):
                    relax(after, to, (cost + 1 + extra, audit + "R", lines + (f"{new}:{text}",)))
        best = insert(after)
    cost, audit, lines = min(best[s] for s in ("0", "a") if s in best)
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


def conversations(seed=3):
    rng = random.Random(seed)
    rows = []
    for conv in range(150):
        texts = [f"say {rng.randrange(6)}{rng.choice(['.', '!', '?', '', ' ', '. '])}" for _ in range(6)] + ["", " \t", None]
        for turn in range(rng.randrange(1, 30)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, rng.choice(texts), "x", 1))
    for turn in range(200):
        rows.append((1000, turn, ["user", "assistant"][turn % 2], f"part {turn}" + "." * (turn % 5 > 0), "x", 1))
    rows += [(1001, None, "user", "all null turns.", "x", 1), (None, 1, "user", "no id.", "x", 1), (None, None, "assistant", "no id?", "x", 1)]
    rows += [(1002, 5, "user", "same row.", "x", 1)] * 7 + [(1003, i, "system", "Be brief.", "x", 1) for i in range(4)]
    rows += [(1004, 1, "user", "long " * 50_000 + ".", "x", 1), (1004, 2, "assistant", "ok.", "x", 1)]
    # every row dropped
    rows += [(c, 0, "user", "gone.", "x", 1) for c in range(2000, 2100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    rng.shuffle(rows)
    return rows


def compare(spark, rows, **options):
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in repair_conversations(table, **options).collect()}
    want = {c: brute(r) for c, r in damage(rows).items()}
    assert got == want


def test_against_a_dynamic_programme(spark):
    compare(spark, conversations())


def test_long_conversations_are_cut_into_chunks(spark):
    compare(spark, conversations(), chunk_rows=7)
    compare(spark, conversations(4), chunk_rows=40, chunk_chars=2000)


def test_empty_table(spark):
    assert repair_conversations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_audits_keep_to_the_pattern(spark):
    rows = conversations(9)
    after = damage(rows)
    for r in repair_conversations(spark.createDataFrame(rows, SCHEMA)).collect():
        assert len(r.audit.replace("I", "")) == len(after[r.conv_id])
