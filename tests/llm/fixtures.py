"""Rows that every document operator must survive, beside the small test table."""

import random

import pyarrow.parquet as pq

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, shard int, id long"


def documents(sf: str) -> list[tuple]:
    """Real rows, then nulls, empty and very long texts, ties, repeated rows, near copies and shared passages."""
    table = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    rows = list(zip(table["doc_id"], table["text"]))
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgéñüß") for _ in range(rnd.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    base, passage = text(300), text(110)
    near = base.split()
    for i in range(4):
        copy = list(near)
        copy[40 * i + 7] = word()
        rows.append((900_000 + i, " ".join(copy)))
    rows += [(900_010 + i, f"{text(30 + i)}\n{passage}\n{text(20)}") for i in range(3)]
    rows += [
        (900_020, None), (900_021, ""), (900_022, " \t\n "), (900_023, "One"), (900_024, "one"), (900_025, "ONE two"), (900_026, "one TWO"),
        (900_027, "\n".join(["The same long line here"] * 30)), (900_028, "  the SAME long line here \nother line of words\n\n"), (900_029, text(40_000)),
        (900_030, base), (900_030, base), (900_031, base.upper()), (900_032, "x" * 30_000), (900_033, "ab" * 900), (900_034, "a  b   c   d e\x0b\x0cf \n\n g"),
        (900_035, "<|endoftext|> it's 12 o'clock’s <|endoftext|>"), (900_036, "Released under the MIT License. See the GNU General Public License, or Apache License."),
        (None, "a text without an id that is long enough to count"), (None, "a text without an id that is long enough to count"),
        (900_037, "a text without an id that is long enough to count"), (-5, "negative id " * 40), (900_038, "é" * 500 + " " + "é" * 500),
        (900_039, text(1) + " \U0001f600 " * 700),
    ]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", 3, 4) for i, t in rows], SCHEMA)
