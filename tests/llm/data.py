"""Small awkward tables for the tests of this folder."""
import random

from pyspark.sql import types as T

# the last column's name is used inside several operators
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string"


def prose(rng, n, vocabulary=60):
    return " ".join("w%d%s" % (rng.randrange(vocabulary), rng.choice(["", "", "", ".", ","])) for _ in range(n))


def messy_rows(seed=5):
    rng = random.Random(seed)
    long_line = prose(rng, 60, 1000)
    rows = []
    for i in range(40):
        text = "\n".join(prose(rng, rng.randrange(1, 50), 400) for _ in range(rng.randrange(1, 6)))
        if i % 4 == 0:
            text += "\n" + long_line.upper() + "\n" + prose(rng, 5)
        rows.append((i * 3 + 1, text, rng.choice(["en", "de"]), "src%d" % (i % 3), len(text), "x"))
    first = rows[0][1]
    rows += [
        (200, first, "en", "src0", None, None), (201, first, None, None, len(first), "x"), (202, first.replace("w1", "w2"), "en", "src0", 1, "x"),
        (203, "", "en", "src1", 0, "x"), (204, None, None, None, None, None), (None, "lost words " * 70, "en", "src1", 3, "x"), (None, None, None, None, None, None),
        (205, " \t\n ", "en", "src1", 3, "x"), (206, "Ünïcödé ﬀ ſ 日本語 \x1c\x85 mixed\x0bspaces\x0chere\rend", "fr", "src2", 5, "x"), (207, "one", "en", "src2", 3, "x"),
        (208, "a" * 5000 + " " + "#$%" * 800 + "\n\n\n" + " " * 900, "en", "src2", 3, "x"), (209, prose(rng, 20_000, 5000), "de", "src2", 3, "x"),
        (210, "same line here\n" * 40, "en", "src2", 3, "x"), (1, first, rows[0][2], "src0", rows[0][4], "x"), (1, first, rows[0][2], "src0", rows[0][4], "x"),
        (1, "another text of the same id.", "en", "src0", 3, "x"),
    ]
    return rows


def messy(spark):
    rows = messy_rows()
    return spark.createDataFrame(rows, SCHEMA).repartition(4), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def schema(text):
    return T._parse_datatype_string(text)
