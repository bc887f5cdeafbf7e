import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkwright.functions import metrics as m
from linkwright.functions import normalize as n

WORD = st.text(alphabet="abcd", max_size=8)


@pytest.mark.parametrize(("a", "b", "want"), [("marhta", "martha", 0.944444), ("jons", "watkins", 0.0), ("leland", "lindaa", None), ("a", "a", 1.0), ("", "", 1.0), ("", "x", 0.0), ("ab", "cd", 0.0), ("farmville", "farmvelel", None)])
def test_jaro_values(a, b, want):
    v = m.jaro_value(a, b)
    assert 0 <= v <= 1
    if want is not None:
        assert abs(v - want) < 1e-5


def test_jaro_whole_and_fraction():
    assert m.jaro_value("abcd", "abdc") == m.jaro_value("abcd", "abdc", False)
    rng = random.Random(0)
    words = ["".join(rng.choice("abc") for _ in range(7)) for _ in range(60)]
    assert any(m.jaro_value(a, b) > m.jaro_value(a, b, False) for a in words for b in words)


def test_winkler_values():
    assert m.winkler_value("abc", "abcdef") == 0.2
    j = m.jaro_value("martha", "marhta")
    assert abs(m.winkler_value("martha", "marhta") - (j + 0.3 * (1 - j))) < 1e-12


@settings(max_examples=200, deadline=None)
@given(WORD, WORD)
def test_osa_bounds(a, b):
    def lev(s, t):
        row = list(range(len(t) + 1))
        for i, x in enumerate(s, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    d = m.osa_value(a, b)
    assert d == m.osa_value(b, a) and d <= lev(a, b) <= 2 * d
    assert m.osa_value("ca", "abc") == 3 and m.osa_value("ab", "ba") == 1


def one(spark, a, b, column):
    return spark.createDataFrame([(a, b)], "a string, b string").select(column.alias("v")).first()[0]


def test_columns(spark):
    assert one(spark, "kitten", "sitting", m.edit_distance("a", "b")) == 3
    assert one(spark, "kitten", "sitting", m.edit_within("a", "b", 2)) == -1
    assert one(spark, "kitten", "sitting", m.edit_or_far("a", "b", 2)) == 100
    assert one(spark, None, "ab", m.edit_distance("a", "b")) == 2
    assert one(spark, "abc", "abd", m.hamming("a", "b")) == 1
    assert one(spark, "", "abd", m.hamming("a", "b")) == 0
    assert one(spark, "abcd", "abcd", m.qgram_dice("a", "b")) == 1.0
    assert one(spark, "abcd", "abcdefg", m.qgram_jaccard("a", "b")) == 0.0
    assert one(spark, "abcd", "abcd", m.hausdorff("a", "b")) == 1.0
    assert one(spark, "martha", "marhta", m.jaro("a", "b")) == pytest.approx(0.944444, abs=1e-5)
    assert one(spark, None, None, m.jaro("a", "b")) == 1.0
    assert one(spark, "abcdefghij", "x", m.jaro_at_least("a", "b", 0.9)) == 0.0
    with pytest.raises(ValueError, match="no metric"):
        m.by_number(99, "a", "b")


def test_bound_is_above_jaro(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("abc") for _ in range(rng.randint(0, 6))), "".join(rng.choice("abc") for _ in range(rng.randint(0, 6)))) for _ in range(200)]
    df = spark.createDataFrame(rows, "a string, b string").select(m.jaro("a", "b").alias("j"), m.jaro_bound("a", "b").alias("top"))
    assert all(r.j <= r.top + 1e-12 for r in df.collect())


def test_sql_names(spark):
    m.register(spark)
    assert spark.sql("SELECT jaro_sim('martha', 'marhta') > 0.94 AND osa_distance('ab', 'ba') = 1").first()[0]


def test_normalise(spark):
    df = spark.createDataFrame([("O'Neil-Smith 3rd", None)], "a string, b string")
    r = df.select(n.strip_punct("a"), n.strip_digits_punct("a"), n.letters_only("a"), n.alnum_only("a"), n.strip_punct("b"), n.headless("a")).first()
    assert tuple(r) == ("oneilsmith 3rd", "oneilsmith rd", "oneilsmithrd", "ONeilSmith3rd", "", "'Neil-Smith 3rd0")


@pytest.mark.parametrize("whole", [True, False])
def test_jaro_of_many_pairs(whole):
    rng = random.Random(4)
    strings = ["", "a", "é" * 64, "ab" * 40, *{"".join(rng.choice("abcde"[: rng.randint(1, 5)]) for _ in range(rng.randint(0, 70))) for _ in range(150)}]
    strings = list(dict.fromkeys(strings))
    t = m.JaroTable(strings)
    pairs = [(rng.randrange(len(strings)), rng.randrange(len(strings))) for _ in range(4000)]
    got = t.compare(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]), whole)
    for (a, b), v in zip(pairs, got, strict=True):
        assert abs(v - m.jaro_value(strings[a], strings[b], whole)) < 1e-12


@pytest.mark.parametrize("whole", [True, False])
def test_long_strings(whole):
    rng = random.Random(8)
    strings = ["", "a", "é" * 200, "ab" * 100, "日本" * 40]
    strings += ["".join(rng.choice("abcdeéß日"[: rng.randint(1, 8)]) for _ in range(rng.choice([0, 3, 63, 64, 65, 100, 150, 200]))) for _ in range(120)]
    strings = list(dict.fromkeys(strings))
    t = m.JaroTable(strings)
    a, b = (np.array([rng.randrange(len(strings)) for _ in range(1500)]) for _ in range(2))
    for i, j, v, w, d in zip(a, b, t.compare(a, b, whole), t.winkler(a, b), t.osa(a, b), strict=True):
        assert abs(v - m.jaro_value(strings[i], strings[j], whole)) < 1e-12
        assert abs(w - m.winkler_value(strings[i], strings[j])) < 1e-12
        if i % 4 == 0:
            assert d == m.osa_value(strings[i], strings[j])
    got = t.compare(a, b, whole, 0.6)
    assert all(v == (w if w >= 0.6 else v) for v, w in zip(got, t.compare(a, b, whole), strict=True))


def test_all_pairs_jaro(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abc") for _ in range(8)) for _ in range(80)] + [None]
    df = spark.createDataFrame(list(enumerate(words)), "id long, v string")
    want = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if i < j and m.jaro_value(a or "", b or "") >= 0.8}
    for block in (7, 2000):
        got = [(r.l, r.r) for r in m.all_pairs_jaro(df, "v", 0.8, block=block).collect()]
        assert set(got) == want and len(got) == len(want)
