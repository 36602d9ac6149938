import random
import re

from driftgauge.llm.line_dedup import drop_repeated_lines
from tests.llm.data import SCHEMA, empty, messy


def brute_units(text):
    """(start, stop, words) by looking at every character."""
    out, start, i = [], 0, 0
    while i < len(text):
        stop = None
        if text[i] == "\n":
            stop = i + 1
        elif text[i] in ".!?" and (i + 1 == len(text) or text[i + 1] in " \t\n\x0b\f\r"):
            stop = i + 1
            while stop < len(text) and text[stop] in " \t\x0b\f\r":
                stop += 1
            if stop < len(text) and text[stop] == "\n":
                stop += 1
        i = stop or i + 1
        if stop or i == len(text):
            words = re.findall("[^\x20\x09-\x0D]+", text[start:i])
            words = "".join(c.lower() if "A" <= c <= "Z" else c for c in " ".join(words)).rstrip(".!?").split(" ")
            words = [w for w in words if w]
            if words:
                out.append((start, i, words))
            start = i
    return out


def brute(rows, least):
    docs = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    seen, gone = {}, {}
    cut_of = {}
    # the order of texts of one doc_id is by a hash, so tests have one text for each doc_id
    for unknown, i, text in docs:
        runs, run = [], []
        for at, (start, stop, words) in enumerate(brute_units(text)):
            key = " ".join(words)
            if key in seen:
                run.append((start, stop, len(words), seen[key]))
            else:
                seen[key] = None if unknown else i
                runs.append(run)
                run = []
        spans = [(r[0][0], r[-1][1], r[0][3]) for r in [*runs, run] if r and sum(u[2] for u in r) >= least]
        for start, stop, _ in reversed(spans):
            gone.setdefault((unknown, i), []).append(text[start:stop])
        kept = text
        for start, stop, _ in reversed(spans):
            kept = kept[:start] + kept[stop:]
        cut_of[None if unknown else i] = (kept, spans)
    return cut_of


def test_against_brute_force(spark):
    rng = random.Random(4)
    sentence = lambda n: " ".join("W%d" % rng.randrange(300) for _ in range(n)) + rng.choice([".", "!", "?", "", "..."])
    pool = [sentence(rng.randrange(1, 14)) for _ in range(60)]
    rows = []
    for i in range(120):
        text = "".join(rng.choice([rng.choice(pool), sentence(rng.randrange(1, 12)), ""]) + rng.choice([" ", "\n", "  ", "\n\n", "\t"]) for _ in range(rng.randrange(0, 25)))
        rows.append((i, text.replace("W1", "é" if i % 3 else "W1"), "en", "s", None, "x"))
    rows += [(200, rows[5][1], "en", "s", None, "x"), (None, rows[5][1] + "tail", "en", "s", None, "x"), (201, None, "en", "s", None, "x"), rows[7]]
    for least in (1, 20):
        want = brute(rows, least)
        for r in drop_repeated_lines(spark.createDataFrame(rows, SCHEMA).repartition(3), least_words=least).collect():
            text, spans = want[r.doc_id]
            assert (r.text or "", [tuple(s) for s in r.removed]) == (text, spans)


def test_passages_inside_longer_lines_and_across_short_ones(spark):
    passage = ". ".join(" ".join(f"p{s}x{i}" for i in range(9)) for s in range(6)) + "."
    rows = [(1, f"Some intro here. {passage} And an end", "en", "s", 1, "x"), (2, "Other start. " + passage.upper(), "en", "s", 1, "x"), (3, passage.replace(". ", "\n") + "\nlast", "en", "s", 1, "x")]
    got = {r.doc_id: r.text for r in drop_repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: rows[0][1], 2: "Other start. ", 3: "last"}


def test_clashing_names(spark):
    names = "doc_id bigint, text string, id int, hash int, repeats int, removed string, row string, text_hash int, h int, g int, at int, n int, first int"
    line = " ".join(f"w{i}" for i in range(30))
    rows = [(i, line, *[7] * 3, "mine", "r", *[8] * 6) for i in range(3)]
    out = drop_repeated_lines(spark.createDataFrame(rows, names))
    assert out.columns == [*[c.split()[0] for c in names.split(", ")], "removed_"]
    assert sorted((r.doc_id, r.text, r.removed, r.row, r.first, len(r.removed_)) for r in out.collect()) == [(0, line, "mine", "r", 8, 0), (1, "", "mine", "r", 8, 1), (2, "", "mine", "r", 8, 1)]


def test_later_occurrences_go(spark):
    line = " ".join("p%d" % i for i in range(25))
    other = " ".join("q%d" % i for i in range(20))
    short = "just a few words"
    rows = [
        (5, f"intro\n{line}\n{short}", "en", "s", 1, "x"), (3, f"{line.upper()}\nend", "en", "s", 1, "x"), (9, f"{short}\n  {line}  \n{other}\n{line}\n{other}", "en", "s", 1, "x"),
        (7, line, "en", "s", 1, "x"), (8, "clean text", "en", "s", 77, "x"), (None, f"é{other}\n{other}", "en", "s", 1, "x"), (4, None, None, None, None, None), (3, f"{line.upper()}\nend", "en", "s", 1, "x"),
    ]
    out = drop_repeated_lines(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == [*SCHEMA.replace(" bigint", "").replace(" string", "").split(", "), "removed"]
    got = {(r.doc_id, r.text): [tuple(s) for s in r.removed] for r in out.collect()}
    a, b = len(line), len(other)
    assert got == {
        (3, f"{line.upper()}\nend"): [], (4, None): [], (5, f"intro\n{short}"): [(6, 7 + a, 3)], (7, ""): [(0, a, 3)], (8, "clean text"): [],
        # the first line of 9 is short, but next to a long one that goes
        (9, f"{other}\n"): [(0, 17 + a + 5, 5), (17 + a + 5 + b + 1, 17 + 2 * a + 2 * b + 7, 3)],
        (None, f"é{other}\n"): [(b + 2, 2 * b + 2, 9)],
    }
    assert {r.doc_id: r.n_chars for r in out.where("doc_id in (5, 8)").collect()} == {5: len(f"intro\n{short}"), 8: 77}
    assert out.where("doc_id = 3").count() == 2


def test_every_unit_survives_once(spark):
    df, rows = messy(spark)
    out = drop_repeated_lines(df, least_words=1)
    assert out.count() == len(rows)
    norm = lambda t: [" ".join(w) for _, _, w in brute_units(t or "")]
    before = {l for r in rows for l in norm(r[1])}
    distinct = {(r.doc_id, r.text, tuple(r.removed)) for r in out.collect()}
    after = [l for _, t, _ in distinct for l in norm(t)]
    assert len(after) == len(set(after)) and set(after) == before


def test_empty(spark):
    assert drop_repeated_lines(empty(spark)).collect() == []
