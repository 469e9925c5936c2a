import random
import re
import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.functions import scalar as X

NAMES = st.text(st.characters(codec="utf-8", exclude_characters="/\\\0%"), min_size=1, max_size=8).filter(lambda s: s not in (".", ".."))
PATHS = st.lists(NAMES, min_size=1, max_size=4).map("/".join)


def encoded(char, times):
    """A character percent-encoded so many times."""
    out = char
    for k in range(times):
        out = "".join(f"%{b:02x}" for b in out.encode()) if not k else out.replace("%", "%25")
    return out


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, x {kind}")


def out(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


@given(PATHS, st.integers(0, 4))
def test_plain_paths_are_valid(path, times):
    assert X.valid_path(path)
    assert X.valid_path(path + encoded(" ", times) + "x") and X.valid_path(f"{path}/half%2 and %G1")


@given(PATHS, st.sampled_from(["/", "\\", "\0"]), st.integers(1, 4))
def test_hidden_separators_are_refused(path, char, times):
    assert not X.valid_path(f"{path}x{encoded(char, times)}y")


@given(PATHS, st.sampled_from([".", ".."]), st.integers(0, 4), st.booleans())
def test_dot_components_are_refused(path, dots, times, front):
    part = "".join(encoded(c, times) for c in dots)
    assert not X.valid_path(f"{part}/{path}" if front else f"{path}/{part}")


@given(PATHS)
def test_odd_separators_are_refused(path):
    assert X.valid_path("")
    for bad in ("/" + path, path + "/", path + "//" + path, path + "\\x", "\0" + path, path + "/%fe%ff"):
        assert not X.valid_path(bad), bad


def test_paths_as_columns(spark):
    paths = ["", "a b/c.d", "a/../b", "a/./b", "/a", "a/", "a\\b", "x%2fy", "x%252fy", "50% off", None]
    want = [None if p is None else X.valid_path(p) for p in paths]
    assert out(column(spark, paths), X.is_valid_path(F.col("x"))) == want
    plain = [p for p in paths if p is not None and "%" not in p]
    assert out(column(spark, plain), X.is_valid_plain_path(F.col("x"))) == [X.valid_path(p) for p in plain]


def test_terms():
    assert X.normalize_search_terms("\u3000Gro\u00dfe \uff27\uff32\uff2f\uff33\uff33\uff25 \t \u6771\u4eac \u6771\u4eac") == ("grosse", "\u6771\u4eac")
    assert X.normalize_search_terms("One/Two.PNG one/two.png") == ("one/two.png",)
    for bad in ("", " \n", "y" * 300, "b\0c"):
        with pytest.raises(ValueError):
            X.normalize_search_terms(bad)


@given(st.text(max_size=20))
def test_folding_is_stable(s):
    assert X.fold(X.fold(s)) == X.fold(X.fold(X.fold(s)))


def test_search_key(spark):
    words = ["Ｓtraße", "café", None, "", "ABC"]
    assert out(column(spark, words), X.search_text_key(F.col("x"))) == [None if w is None else unicodedata.normalize("NFKC", w).casefold() for w in words]


def test_natural_order(spark):
    names = ["Roll 12", "Roll 3", "Roll 1", "roll 003", "z", "Roll 3x"]
    df = column(spark, names)
    keys = out(df, X.natural_name_key(F.col("x")))
    assert keys == out(df, X.natural_name_key_any(F.col("x")))
    assert [n for _, n in sorted(zip(keys, names))][:2] == ["Roll 1", "Roll 3"] and keys[1] == keys[3]
    assert out(column(spark, ["Na\u00efve"]), X.natural_name_key_any(F.col("x"))) == ["naive"]


def test_natural_order_is_the_collation(spark, duck):
    """Order and equality are those of the root collation's first level, digit runs by value, on mixed scripts and marks."""
    rng = random.Random(2)
    parts = ["a", "B", "é", "e\u0301", "E", "ß", "ss", "Æ", "ae", "Ｚ", "z", "я", "Ё", "е", "Ω", "上", "海", "ア", "あ", " ", "-", "_", ".", "#", "٣", "3", "12", "007", "7", "४", "\u0300", "ﬁ", "fi", "²"]
    names = sorted({"".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(1500)})
    df = spark.createDataFrame([(n,) for n in names], "x string").withColumn("k", X.natural_name_key(F.col("x")))
    groups = [sorted(r["s"]) for r in df.groupBy("k").agg(F.collect_list("x").alias("s")).orderBy("k").collect()]
    text = lambda n: "".join("0" + f"{len(d):04}" + d if (d := m.lstrip("0٠०") or m[-1:]) and m[0].isdecimal() else m for m in re.findall(r"\d+|\D+", n))
    want = {}
    for n in names:
        full = duck.execute("SELECT icu_sort_key(?, 'und')", [text(n).lower()]).fetchall()[0][0]
        first = full[: next((i for i in range(0, len(full), 2) if full[i : i + 2] == "01"), len(full))]
        want.setdefault(first, []).append(n)
    assert groups == [sorted(want[k]) for k in sorted(want)]


def test_instants(spark):
    texts = ["1970-01-01T00:00:00Z", "2024-02-29T23:59:59.25Z", "2023-02-29T00:00:00Z", "2024-01-01T00:00:00+01:00", "2024-01-01T00:00:00-00:00", "2024-01-01 00:00:00Z", "2024-13-01T00:00:00Z", "2024-01-01T24:00:00Z", "1969-12-31T23:59:59.999999999Z", "9999-01-01T00:00:00Z", None]
    assert out(column(spark, texts), X.utc_instant_ns(F.col("x"))) == [0, 1_709_251_199_250_000_000, None, None, 1_704_067_200_000_000_000, None, None, None, -1, None, None]


def test_storyboards(spark):
    df = column(spark, [2000, 4999, 5000, 19_999, 10**15], "long")
    for ms, times in zip([2000, 4999, 5000, 19_999, 10**15], out(df, X.storyboard_times(F.col("x")))):
        n = 4 if ms < 5000 else 10
        assert times == [ms * i // (n + 1) for i in range(1, n + 1)]
    cell = spark.range(1).select(X.storyboard_cell(F.lit(1920), F.lit(1080)).alias("a"), X.storyboard_cell(F.lit(100), F.lit(50)).alias("b"), X.storyboard_cell(F.lit(32768), F.lit(1)).alias("c")).first()
    assert (tuple(cell.a), tuple(cell.b), tuple(cell.c)) == ((320, 180), (100, 50), (320, 1))


def test_ranges_and_versions(spark):
    got = out(column(spark, ["bytes=0-9", "bytes=5-", "bytes=-3", "bytes=20-", "bytes=-", "items=0-1", "bytes=7-3", "bytes=0-99", "bytes=99999999999999999999-"]), X.byte_range(F.col("x"), F.lit(10)))
    assert [g and tuple(g) for g in got] == [(0, 9), (5, 9), (7, 9), None, None, None, None, (0, 9), None]
    assert out(column(spark, ["1.2.4", "v1.10.0", "1.2.3", "1.2", "0.9.9"]), X.semver_newer(F.lit("1.2.3"), F.col("x"))) == [True, True, False, None, False]
    assert out(column(spark, ["ast_7", "ast_0", "ast_x", "lib_7", "ast_99999999999999999999"]), X.parse_resource_id("ast", F.col("x"))) == [7, None, None, None, None]
