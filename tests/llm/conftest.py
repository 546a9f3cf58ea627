import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # names that operators use within
    "host string, word string, words string, runs int, count int, kept boolean, row int, node long, frequent int, "
    "`left` string, own int, `a.b` int"
)


def rows(seed: int = 1) -> list[tuple[int | None, str | None, str | None]]:
    """(doc_id, text, source): copies, near copies, shared lines and passages, odd texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeioubcdst") for _ in range(r.randint(2, 6))) for _ in range(400)] + ["the", "of"] * 30

    def line(n: int) -> list[str]:
        return [r.choice(vocabulary) for _ in range(n)]

    def text(k: int) -> list[list[str]]:
        return [line(r.randint(3, 40)) for _ in range(k)]

    def flat(lines: list[list[str]]) -> str:
        return "\n".join(" ".join(x) for x in lines)

    out: list[tuple[int | None, str | None, str | None]] = []
    common, passage = line(12), line(45)
    for i in range(40):
        own = text(r.randint(1, 8))
        if i % 3 == 0:
            own.insert(r.randrange(len(own) + 1), common)
        if i % 5 == 0:
            own[0] = own[0] + passage
        out.append((i, flat(own), f"s{i % 3}"))
    for i in range(40, 60):  # near copies of one text, some with edits of a whole line
        base = [x.split() for x in (out[4][1] or "").split("\n")]
        k = r.randrange(len(base))
        base[k] = [r.choice(vocabulary) if r.random() < 0.08 else w for w in base[k]]
        out.append((i, flat(base), "s1"))
    out += [
        (60, out[7][1], "s0"),
        (61, out[7][1], None),
        (62, None, "s0"),
        (63, "", "s0"),
        (64, " \t\n\x0b\x0c\r ", "s0"),
        (65, "one two  three", "s0"),
        (66, "One TWO\tthree", "s0"),
        (67, "É\x1cx   y z é́ naïve\x85 end\x1f", "s2"),
        (68, "so so " * 300, "s2"),
        (69, flat(text(60)), "s2"),
        (70, "a " * 19 + "b", "s2"),
        (70, "a " * 19 + "b", "s2"),  # a repeated row
    ]
    return out


@pytest.fixture(scope="session")
def table(spark):
    def make(found: list) -> object:
        full = [(i, t, "en", s, len(t or ""), "h", "w", "x", 1, 2, True, 3, 4, 5, "l", 6, 7) for i, t, s in found]
        return spark.createDataFrame(full, SCHEMA).repartition(3, "doc_id")

    return make


@pytest.fixture(scope="session")
def fixture_rows():
    return rows()


@pytest.fixture(scope="session")
def docs(table, fixture_rows):
    found = table(fixture_rows).persist()
    found.count()
    return found


@pytest.fixture(scope="session")
def empty(table):
    return table([])
