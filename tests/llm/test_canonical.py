import random

import pytest

from lexweave.llm import canonical as C
from tests.conftest import rows

LISTS = [
    ("A", 1, "1. Naamloze vennootschap", ["public limited company"]),
    ("A", 2, "2. Stichting", ["foundation"]),
    ("A", 3, "3. Buitenlands filiaal", []),
    ("B", 1, "Nimbovar", None),
    ("B", 2, "Kestralis Cloud", []),
    ("B", 3, "Ørnebæk", []),
    ("B", 4, "Kestralis Cloud Noord", []),
]


@pytest.fixture(scope="module")
def lists():
    by = {}
    for code, no, text, alternatives in LISTS:
        by.setdefault(code, []).append((no, text, alternatives))
    return {code: C.ClosedList(items) for code, items in by.items()}


@pytest.mark.parametrize(
    "code, entry, item",
    [
        ("A", "2", 2), ("A", " 02. ", 2), ("A", "nr. 3", 3), ("A", "9", 0), ("B", "2", 0),
        ("A", "1. Naamloze vennootschap", 1), ("A", "NAAMLOZE_VENNOOTSCHAP", 1), ("A", "Naamloze  vennootschap (zie contract)", 1), ("A", "Foundation", 2),
        ("A", "\tStichtnig / ongewijzigd ", 2), ("A", "Naaml. venn.", 1), ("A", "vennootschap, Naamloze", 1), ("A", "Buitenlandsf iliaal", 3),
        ("A", "Stichting of Buitenlands filiaal", 3), ("A", "mail van 3-2", 0), ("A", "n.v.t.", 0), ("A", "Vereniging", 0), ("A", "???", 0),
        ("B", "kestralis cloud", 2), ("B", "Kestralis Cloud Noord", 4), ("B", "ornebaek", 3), ("B", "Nimbo", 1), ("B", "Yottabase", 0), ("B", "€ 12.500", 0), ("B", "06-2023 tot 06-2027", 0),
    ],
)
def test_entries(lists, code, entry, item):
    assert lists[code].find(entry)[0] == item


def slow_edits(a, b):
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_edits_against_the_full_table():
    rnd = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(8))) for _ in "ab")
        for most in (0, 1, 2, 5):
            assert C.edits(a, b, most) == min(slow_edits(a, b), most + 1)


def test_mentions_against_brute_force(lists):
    names = {"nimbovar", "kestralis cloud", "kestralis cloud noord", "ornebaek"}
    rnd = random.Random(5)
    for _ in range(400):
        text = rnd.choice(["", " "]).join(rnd.choice(["nimbovar", "kestralis", "cloud", "kestralis cloud", "noord", "x"]) + rnd.choice(["", " ", ","]) for _ in range(5))
        spots = [
            (len(n), i) for n in names for i in range(len(text)) if text.startswith(n, i) and (i == 0 or not text[i - 1].isalnum()) and not text[i + len(n) : i + len(n) + 1].isalnum()
        ]
        kept = []
        for n, i in sorted(spots, key=lambda x: (-x[0], x[1])):
            if all(i + n <= j or j + m <= i for m, j in kept):
                kept.append((n, i))
        assert [(n, i) for n, i, _ in lists["B"].mentions(text)] == kept


def test_rows(spark):
    closed = spark.createDataFrame(LISTS, "column_code string, item_no int, official_text string, alt_texts array<string>")
    long = "x" * 50_000
    arrangements = spark.createDataFrame([(1, {"A": "2", "B": None, "C": "2"}), (1, {"A": "2"}), (2, None), (3, {"A": " \n", "B": long}), (None, {"A": "Stichting"})], "arr_row long, manual map<string,string>")
    got = C.canonical_items(C.manual_entries(arrangements), closed)
    assert rows(got, "row_key", "column_code", "item_no") == sorted([(1, "A", 2), (1, "A", 2), (3, "B", 0), (None, "A", 2)], key=repr)
    assert rows(C.unmatched(got), "column_code", "n_rows") == [("B", 1)]
    assert rows(C.canonical_items(C.manual_entries(arrangements.limit(0)), closed)) == []
    assert rows(C.canonical_items(C.manual_entries(arrangements), closed.limit(0))) == []
    with pytest.raises(ValueError):
        C.bounded_lists(closed, 3)
