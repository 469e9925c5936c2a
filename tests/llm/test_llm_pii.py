import hashlib
import math
import random
import re
import sys

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from oddities import ROWS, none, odd
from pyspark.sql import functions as F

from shelfmark.llm import span_crf as M


def brute(text):
    t, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.-+0123456789 ()é_%", max_size=60))
def test_base_spans(text):
    assert M.base_spans(text) == brute(text)


def test_emails_back_to_back():
    for t in ("a@b.c@d.e", "a@@b.c", "a@b@c.d", "x@y.z.@q.r", "a@b.c-@d.ef", "@a.b", "a@-.-", "a@b..c x@y.z"):
        assert M.base_spans(t) == brute(t), t


DIGITS = ["0" * 5000 + "1.2.3.4", "1.2.3." + "0" * 5000, "9" * 10**6, ".".join(["1" * 9000] * 4), "+" + "7" * 10**5, "4 " * 10**5, "1.2." + "0" * 5000 + "25.0", "x@" + "a." * 10**4 + "b"]


def test_long_runs_of_digits(spark):
    """No run of digits, however long, ends the operator; leading zeros count as what they are."""
    for t in DIGITS[:2] + DIGITS[6:]:
        sys.set_int_max_str_digits(0)
        want = brute(t)
        sys.set_int_max_str_digits(4300)
        assert M.base_spans(t) == want
    assert M.base_spans(DIGITS[2]) == M.base_spans(DIGITS[3]) == []
    docs = spark.createDataFrame([(i, f"call {t} now, or mail me@example.org") for i, t in enumerate(DIGITS)], "doc_id long, text string")
    field = M.fit(docs)
    found = {r["doc_id"]: r for r in M.find_spans(docs, field).collect()}
    kinds = {i: [x["kind"] for x in r["base"]] for i, r in found.items()}
    assert all("email" in x for x in kinds.values()) and len(kinds) == len(DIGITS)
    assert [kinds[i].count("ip") for i in (0, 1, 2, 3, 6)] == [1, 1, 0, 0, 1]
    texts = {r["doc_id"]: r["text"] for r in M.redacted(docs, field).collect()}
    assert len(texts) == len(DIGITS) and "0000" not in texts[0] + texts[1]
    assert M._no_datum(1, DIGITS[1], np.random.default_rng(0))


def test_documents(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = M.op6_span_crf(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = brute(texts[r["doc_id"]])
        told = [f"{M.KINDS[k]}:{s}:{e}" for s, k, e in spans]
        assert tuple(r[f"n_{k}"] for k in M.KINDS) == tuple(sum(x[1] == i for x in spans) for i in range(4))
        assert r["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert set(told) <= set(r["spans"].split(",")) | ({""} if not told else set())


def planted(rng, kind):
    """A datum that no pattern finds, in a spelling of the tests' own."""
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "email":
        at = rng.choice([" @ ", "[at]", " (at) "])
        return f"{rng.choice(['ann', 'j.doe', 'x_7', 'info'])}{at}{rng.choice(['mail', 'web-3', 'a1'])}.{rng.choice(['example.com', 'org', 'co.uk'])}"
    if kind == "ip":
        return rng.choice(["[.]", " . ", "(.)"]).join(str(rng.randrange(10, 256)) for _ in range(4))
    if kind == "card":
        digits = next(d for d in iter(lambda: "4" + number(15), "") if M.luhn(d))
        return rng.choice("./_").join(digits[k : k + 4] for k in (0, 4, 8, 12))
    return rng.choice(["({}) {}-{}", "00{}/{}/{}", "1.{}.{}.{}"]).format(number(3), number(3), number(4))


def test_field_finds_other_spellings(spark):
    """Of spans that no pattern finds, at least 0.85 of each kind in bounds and kind; hardly any where there are none."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    field = M.fit(docs.filter("doc_id % 2 = 0"))
    rng = random.Random(7)
    for k, kind in enumerate(M.KINDS):
        found = 0
        for n in range(60):
            head, what = f"Please note {'so ' * (n % 4)}that ", planted(rng, kind)
            text = f"{head}{what} is what we have."
            base, every = M.all_spans(text, field)
            assert not base, text
            found += every == [(len(head), k, len(head) + len(what))]
        assert found >= 51, (kind, found)
    held_out = [r["text"] for r in docs.filter("doc_id % 2 = 1").collect()]
    wrong = sum(len(every) - len(base) for base, every in (M.all_spans(t, field) for t in held_out))
    assert wrong <= 0.005 * len(held_out)
    for text in ("In 1999 there were 12 apples and 7 pears, 3.5 kg each, on page 42 of 300.", "On 2024-01-02 10:11:12 it was 1,234,567.89, by v1.2.3-4.", "4111.1111.1111.1112 and 300 . 2 . 3 . 4 and 12 @ 3"):
        assert M.all_spans(text, field) == ([], []), text
    base, every = M.all_spans("write to me@example.org or call 0049 30 1234567 now", field)
    assert len(base) == 1 and {k for _, k, _ in every} == {0, 3}


def test_fit_hangs_on_rows_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(400)
    one, two = M.fit(docs.repartition(7)), M.fit(docs.orderBy(F.xxhash64("text")).repartition(3))
    assert one.weights == two.weights and one.weights


def test_training_is_the_gradient():
    """Probabilities of segments by the batched recursions are those of all segmentations, one by one."""
    rows = [(["12", ".", "3", " ", "45"], [(0, 1, 3)]), (["7", "@", "b", ".", "c"], [(0, 0, 5)]), (["9", " ", "9"], [])]
    p = M.Params(longest=4, steps=1, rate=1.0, ridge=0.0)
    got = M.train(rows, p)
    first = M.Field({name: -0.05 for name in got.weights}, 4)
    grad = dict.fromkeys(got.weights, 0.0)

    def every(pieces, i):
        if i == len(pieces):
            yield 0.0, []
            return
        for s, x in every(pieces, i + 1):
            yield s, x
        for j in range(i + 1, min(len(pieces), i + 4) + 1):
            if (own := first.scores(pieces, i, j)) is not None:
                for s, x in every(pieces, j):
                    for k in range(4):
                        yield s + own[k], [(i, k, j), *x]

    for pieces, gold in rows:
        all_of = list(every(pieces, 0))
        z = sum(math.exp(s) for s, _ in all_of)
        for weight, spans in [(-math.exp(s) / z, x) for s, x in all_of] + [(1.0, [g for g in gold if first.scores(pieces, g[0], g[2]) is not None and g[2] - g[0] <= 4])]:
            for i, k, j in spans:
                for f in M.segment_features(pieces, i, j):
                    grad[f, k] += weight
    for name, g in grad.items():
        assert abs(got.weights[name] - (-0.05 + g / math.sqrt(1e-6 + g * g))) < 1e-6, name


def test_decoding_is_the_best_segmentation():
    field = M.Field({(f"digits={d}", k): 0.4 * d - 0.3 * k for d in range(6) for k in range(4)}, 4)
    pieces = ["12", "-", "345", " ", "6789", ".", "1"]
    n, kinds = len(pieces), range(4)

    def best(i):
        if i == n:
            return 0.0
        out = best(i + 1)
        for j in range(i + 1, min(n, i + field.longest) + 1):
            if (s := field.scores(pieces, i, j)) is not None:
                out = max(out, max(s[k] for k in kinds) + best(j))
        return out

    got = sum(field.scores(pieces, i, j)[k] for i, k, j in field.decode(pieces))
    assert abs(got - best(0)) < 1e-9


def test_oddities(spark):
    field = M.fit(odd(spark))
    got = {r["doc_id"]: r for r in M.find_spans(odd(spark), field).collect()}
    assert got[2]["spans"] == [] and got[3]["spans"] == []
    assert {s["kind"] for s in got[8]["base"]} == set(M.KINDS)
    out = M.redacted(odd(spark), field)
    assert out.columns == odd(spark).columns and out.count() == len(ROWS)
    text = out.filter("doc_id = 8").first()["text"]
    assert all(f"[{k.upper()}]" in text for k in M.KINDS) and "example" not in text and "4111" not in text
    assert out.filter("doc_id = 2").first()["text"] is None
    assert M.find_spans(none(spark), M.fit(none(spark))).isEmpty() and M.redacted(none(spark), field).isEmpty()
