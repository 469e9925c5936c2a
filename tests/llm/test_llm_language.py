import collections
import re
import zlib

from oddities import none, odd

from shelfmark.llm import language_bitmask as M


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    got = {r["doc_id"]: r for r in M.op2_language_bitmask(spark, sf_dir).collect()}
    assert len(got) == docs.count()
    judged = [(r["lang"], got[r["doc_id"]]) for r in docs.collect() if r["lang"] and got[r["doc_id"]]["held_out"] and len(r["text"] or "") > 40]
    right = sum(lang == g["lang_pred"] for lang, g in judged)
    assert len(judged) > 20 and right >= 0.9 * len(judged), (right, len(judged))
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_more_than_eight_languages(spark):
    rows = [(i, " ".join(f"{chr(97 + k)}{chr(97 + k)}{chr(97 + j)}" for j in range(12)), f"l{k}") for i, k in enumerate(list(range(12)) * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = M.identify(df, M.fit(df), keys=("doc_id", "lang")).collect()
    assert all(r["lang"] == r["lang_pred"] for r in got)


def test_oddities(spark):
    f = M.fit(odd(spark))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in M.identify(odd(spark), f).collect()}
    assert all(got[i] == ("und", 0.0) for i in (2, 3, 4, 5))
    assert got[1] == got[7] and got[6][0] == "en" and got[6][1] > 0.9
    kept = M.with_language(odd(spark), f)
    assert kept.columns == odd(spark).columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({2, 3, 4, 5})
    empty = M.fit(none(spark))
    assert empty.languages == () and M.identify(none(spark), empty).isEmpty()
    assert {r["lang_pred"] for r in M.identify(odd(spark), empty).collect()} == {"und"}
    assert M.with_language(odd(spark), empty).isEmpty()


def test_copies_leave_the_sample_whole(spark):
    alone = [f"{w}{w[::-1]} {w}" * 2 for w in ("".join(chr(97 + (7 * i + 3 * j * j + i * j) % 26) for j in range(12)) for i in range(40))]
    rows = [(n, t, "xx") for n, t in enumerate(t for t in alone for _ in range(50))] + [(10_000, "one two one two", "yy")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    f = M.fit(df, p=M.Params(per_language=40))
    got = M.identify(df, f, keys=("lang",)).collect()
    assert all(r["score"] > 0.9 and r["lang_pred"] == r["lang"] for r in got if r["lang"] == "xx")
    assert f.prior[0] == 2000 / 2001


def _grams(text):
    """Four bytes at every place, folded, with one space for a run of spaces and spaces around."""
    folded = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in text.encode())
    line = re.sub(b" +", b" ", b" " + folded)
    return [(line + b"   ")[i : i + 4] for i in range(len(line))]


def test_is_brute_force_without_hashing(spark, sf_dir):
    """Every document against plain sets of n-grams: the filter's false positives move no clear decision."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    train = [r for r in rows if r["text"] is not None and r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    counts = collections.defaultdict(collections.Counter)
    for r in train:
        counts[r["lang"]].update(_grams(r["text"]))
    known = {k: {g for g, n in c.items() if n > 1 and n >= 1e-5 * c.total()} for k, c in counts.items()}
    got = {r["doc_id"]: r for r in M.op2_language_bitmask(spark, sf_dir).collect()}
    clear = 0
    for r in rows:
        mine = got[r["doc_id"]]
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (mine["lang_pred"], mine["score"]) == ("und", 0.0)
            continue
        grams = _grams(r["text"])
        (best, name), *others = sorted(((sum(g in s for g in grams) / len(grams), k) for k, s in known.items()), reverse=True)
        assert abs(mine["score"] - best) <= 0.05
        if not others or best - others[0][0] > 0.1:
            clear += 1
            assert mine["lang_pred"] == name
    assert clear >= 0.8 * len(rows)
