import pytest

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango".split()
LONG = " ".join(f"{WORDS[i % 20]}{i % 97}" for i in range(20_000))
#: id, text: nulls, blanks, marks, a very long text, ties, a repeated row, and a row without id.
EDGE = [
    (1, None), (2, ""), (3, " \n\n "), (4, "!!! ... ---"), (5, LONG), (6, "one two three four five six seven eight nine ten eleven"),
    (6, "one two three four five six seven eight nine ten eleven"), (7, "one two three four five six seven eight nine ten eleven"), (None, "no id at all here"), (8, "x"), (9, "Ünïcode 日本語 🎉 text"),
]
#: Further columns with names that operators use inside.
CLASHING = ("id", "h", "key", "n", "dropped", "items", "unit", "ids", "class", "rejected", "lang_pred", "pos", "words", "v", "c")


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(i, t, "en", *("x" for _ in CLASHING)) for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string" + "".join(f", `{c}` string" for c in CLASHING)).repartition(3)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)
