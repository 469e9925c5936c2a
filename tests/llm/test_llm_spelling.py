import random
import re
import zlib
from collections import Counter

from oddities import ROWS, none, odd
from parity import same

from shelfmark.llm import letter_parity as M


def near(a, b):
    """Whether one inserted, deleted or replaced code point parts two words."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def lower(s):
    return re.sub("[A-Z]", lambda m: m.group().lower(), s)


def brute(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    out = {}
    for w in n:
        others = [x for k in (-1, 0, 1) for x in by_size.get(len(w) + k, ()) if near(w, x)]
        top = min(others, key=lambda x: (-n[x], x), default=None)
        out[w] = (top if top and n[top] >= 2 * n[w] else None, len(others))
    rows = []
    for w, (form, m) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n[w], m, n[form] if form else None))
    return sorted(rows)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_is_brute_force(spark):
    """Families of words one edit apart, in letters with and without marks, with ties of counts and long chains of forms."""
    rng = random.Random(5)
    letters = "abcdeéèüÿ×ÀÖstuvwxyz"
    words = []
    for _ in range(60):
        w = "".join(rng.choice(letters) for _ in range(rng.choice([4, 5, 6, 9, 14])))
        for step in range(7):
            words += [w] * rng.choice([1, 2, 3, 3, 6, 12, 25, 60])
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :]])
    words += [f"chain{'abcdefghij'[:k]}" for k in range(10) for _ in range(3 * 2**k)]
    rng.shuffle(words)
    rows = [(k, " ".join(w.upper() if rng.random() < 0.2 else w for w in words[a : a + 50])) for k, a in enumerate(range(0, len(words), 50))]
    got = M.variants(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows_of(got) == brute(rows)


def test_documents(spark, sf_dir, duck):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert rows_of(M.op11_letter_parity(spark, sf_dir)) == brute([tuple(r) for r in docs.collect()])
    assert same(M.op11_letter_parity(spark, sf_dir), duck, M.OP11_SQL) is None


def test_one_edit_shares_a_key(spark):
    """Any two words that one edit parts share a key, of words of one letter repeated too."""
    rng = random.Random(8)
    pairs = [("aaaaa", "aaaaaa"), ("aaaaa", "aaaab"), ("ÿÿÿÿÿ", "ÀÿÿÿÿÿÿÿÿÀ"[1:7]), ("abcde", "bcde"), ("x" * 5000, "x" * 5001)]
    for _ in range(3000):
        w = "".join(rng.choice("abcdezéü×") for _ in range(rng.randrange(4, 12)))
        i = rng.randrange(len(w) + 1)
        pairs.append((w, rng.choice([w[:i] + "q" + w[i:], w[:i] + "b" + w[i:], w[: i - 1] + w[i:] if i else "y" + w, w[: i - 1] + "ö" + w[i:] if i else w + "y"])))
    pairs = [p for p in pairs if near(*p)]
    long = "".join(rng.choice("abcé") for _ in range(1000))
    pairs += [(long, long[:i] + "q" + long[i + k :]) for i in (0, 1, 499, 500, 998, 999) for k in (0, 1)] + [(long, long[1:]), (long, long[:-1]), (long, long[:377] + long[378:])]
    words = spark.createDataFrame([(w, 3) for w in sorted({w for p in pairs for w in p})], "word string, n long")
    found = {(r["a"], r["b"]) for r in M.near_pairs(words).collect()}
    assert len(pairs) > 2900
    for a, b in pairs:
        assert (a, b) in found or (b, a) in found, (a, b)
    assert all(near(a, b) for a, b in found)


def test_common_head(spark):
    """Many words that begin alike: keys hold few of them each."""
    rng = random.Random(3)
    words = sorted({"prefix" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30_000)})
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    key = df.selectExpr("word").withColumn("m", M.mask(df["word"]))
    held = key.select(M.F.explode(M.keys(M.F.col("word"), M.F.col("m"), M.F.length("word"))).alias("key")).groupBy("key").count()
    pairs_met = held.selectExpr("sum(count * count)").first()[0]
    assert pairs_met < 40 * 12 * len(words)


def test_oddities(spark):
    got = M.variants(odd(spark))
    assert rows_of(got) == brute([r[:2] for r in ROWS])
    assert M.variants(none(spark)).isEmpty()
    huge = "z" * 200_000
    rows = [(1, f"{huge} {huge}y "), (2, f"{huge} {huge}y "), (3, f"{huge} {huge}y ")]
    assert {(r["word"][-1], r["n_near"]) for r in M.variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {("z", 1), ("y", 1)}


def test_nothing_is_broadcast(spark, monkeypatch):
    """Keys are many times the words that they come from: no join sends a side through the driver, however small its files are."""
    plans, write = [], M.written

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, name)

    monkeypatch.setattr(M, "written", seen)
    rows = [(k, f"{w} " * n) for k, (w, n) in enumerate([("harbour", 40), ("harbor", 12), ("harbo", 5), ("lantern", 9)])]
    out = M.variants(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(out) == brute(rows)
    plans.append(("out", out._jdf.queryExecution().executedPlan().toString()))
    assert [name for name, plan in plans if "Join" in plan] == ["forms", *[name for name, _ in plans if name == "roots"][1:], "out"]
    assert not [name for name, plan in plans if "Broadcast" in plan]
