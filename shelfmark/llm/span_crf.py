r"""Personal data: pattern spans, and more spans from a semi-Markov conditional random field.

Base spans are the leftmost non-overlapping matches of one pattern per kind. The random field works on islands, the runs
of tokens with a digit or a sign for "at": features of whole spans score every candidate segment of bounded length, and
dynamic programming chooses boundaries and kinds jointly. It is trained here, by conditional likelihood, on a bounded
sample of islands. Base spans are the only labels there are, and what they look like is what the patterns find anyway. So
each labelled island is learned from in other spellings too (other separators, no plus sign, an exit code, spelt-out
signs), and beside spellings that are none (a digit changed so that the check fails, a part over 255, too few digits,
dates, versions, amounts). The field therefore finds spans that no pattern matches. What overlaps a base span is dropped;
base spans stay. The fit depends on the rows alone, not on their order or partitions.

Offsets are code points. Null and empty texts have no spans. Whole texts are searched, of any length: a pattern takes
time in proportion to the text. An island starts at most 64 characters before its first digit or sign; islands of over 60
pieces are decoded, but not learned from. Repeated rows and ties get equal results. Empty tables give empty results and a
field of prior weights. `find_spans` reads the keys and the text alone, whatever else there is; `redacted` keeps all columns.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import table

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Islands: tokens with a digit or a sign for "at", the neighbours of a sign that stands alone, and what joins them.
_AT = r"(?:@|\[at\]|\(at\))"
_TOKEN = rf"[^\s0-9@]{{0,64}}?(?:[0-9]|{_AT})\S*"
_BEHIND = r"(?:(?<=@)|(?<=[\[(]at[\])]))"
_ISLAND = re.compile(rf"(?:[^\s0-9@]{{1,64}}[ \t](?={_AT}))?{_TOKEN}(?:[ \t]{{1,2}}{_TOKEN}|[ \t][^\s0-9@]{{1,64}}(?=[ \t]{_AT})|{_BEHIND}[ \t][^\s0-9@]{{1,64}}|[ \t][./:_-]{{1,2}}(?=[ \t][0-9]))*")
_PIECES = re.compile(r"[0-9]+|[A-Za-z]+|[ \t]+|.", re.S)
_SIGN = re.compile(r"\[at\]|\(at\)")
_LOOSE = re.compile(r"[\s\[\]()]+")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign with the local characters before it, back to the last match, and the domain behind it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        else:
            done = at + 1 if start == at else max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    out = [(s, 0, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in m.group().split("."))):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 9 <= len(_DIGIT.findall(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


@dataclass(frozen=True)
class Params:
    """longest: pieces of a segment at most, and so the entity bound. sample: islands to learn from at most, of distinct shapes; spellings: how many islands with a kind are added in other spellings, and as many with none, at least."""

    longest: int = 24
    sample: int = 300
    spellings: int = 120
    steps: int = 60
    rate: float = 0.3
    ridge: float = 0.0005


def _chained(pieces: list[str]) -> str:
    """The mark that joins a span to the next digits, if one does."""
    mark = ""
    for x in pieces:
        if x[0] in "0123456789":
            return mark
        if x[0].isalpha() or (mark and not x.isspace() and x not in "[]()"):
            return ""
        mark = mark or (x if x in "./:_-," else "")
    return ""


def segment_features(pieces: list[str], i: int, j: int) -> tuple[str, ...]:
    """Of the whole span pieces[i:j] and its two neighbours; empty if it can't be an entity."""
    first, last = pieces[i], pieces[j - 1]
    if not (first[0].isalnum() or first[0] in "+(") or not (last[-1].isalnum() or last[-1] == ")"):
        return ()
    body = pieces[i:j]
    text = "".join(body)
    groups = [p for p in body if p[0] in "0123456789"]
    digits = "".join(groups)
    letters = any(p[0].isalpha() for p in body)
    sign = "@" in text or (letters and _SIGN.search(text) is not None)
    if not digits and not sign:
        return ()
    before, after = pieces[i - 1][-1:] if i else " ", pieces[j][:1] if j < len(pieces) else " "
    ahead, back = _chained(pieces[j : j + 4]), _chained(pieces[max(0, i - 4) : i][::-1])
    out = [f"ahead={ahead}", f"back={back}", f"inside={'a' if before.isalnum() else '-'}{'a' if after.isalnum() else '-'}", f"begins={first[0] if first[0] in '+(' else '0' if first[0] == '0' else 'x'}"]
    if sign:
        whole = _EMAIL.fullmatch(_LOOSE.sub("", _SIGN.sub("@", text)))
        out += [f"address={whole is not None}", f"words={min(len(text.split()), 4)}", f"edge={before in '._%+-@'}{after in '.@-[('}"]
    elif letters:
        out.append("letters")
    else:
        between = [p for p in body if p[0] not in "0123456789"]
        marks = sorted(set("".join(between)) - {"+"})
        n = len(digits)
        out += [f"digits={n if n < 20 else 20}", f"groups={min(len(groups), 7)}", f"marks={min(len(marks), 4)}", *(f"mark={c}" for c in marks[:4]), f"longest={min(max(map(len, groups)), 13)}", f"least={min(min(map(len, groups)), 5)}"]
        out.append(f"closed={text.count('(') == text.count(')')}")
        if 12 <= n <= 19:
            out += [f"luhn={luhn(digits)}", f"luhn={luhn(digits)}{'one' if len(groups) == 1 else 'even' if len(set(map(len, groups[:-1]))) == 1 else 'uneven'}"]
        if len(groups) == 4:
            out.append(f"octets={all(len(g) <= 3 and int(g) <= 255 for g in groups)}{text.count('.') == 3}")
        if 9 <= n <= 15 and len(groups) > 1:
            out.append(f"phone={'one mark' if len(marks) < 2 else 'more'}{min(len(groups[-1]), 5)}")
    return tuple(out)


class Field:
    """Weights of (feature, kind); a segment outside any span is one piece and scores 0."""

    def __init__(self, weights: dict[tuple[str, int], float], longest: int):
        self.weights, self.longest, self.memo = weights, longest, {}

    def scores(self, pieces: list[str], i: int, j: int):
        feats = segment_features(pieces, i, j)
        if not feats:
            return None
        if feats not in self.memo:
            if len(self.memo) > 50_000:
                self.memo.clear()
            self.memo[feats] = np.array([sum(self.weights.get((f, k), -0.05) for f in feats) - 1.0 for k in range(len(KINDS))])
        return self.memo[feats]

    def decode(self, pieces: list[str]) -> list[Span]:
        """The best segmentation's entities, as piece indices."""
        n = len(pieces)
        best, back = [0.0] + [-np.inf] * n, [None] * (n + 1)
        for i in range(n):
            if best[i] >= best[i + 1]:
                best[i + 1], back[i + 1] = best[i], (i, -1)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                if (s := self.scores(pieces, i, j)) is not None and best[i] + s.max() > best[j]:
                    best[j], back[j] = best[i] + float(s.max()), (i, int(s.argmax()))
        out = []
        while n:
            i, k = back[n]
            if k >= 0:
                out.append((i, k, n))
            n = i
        return out[::-1]


def islands(text: str) -> Iterator[tuple[int, list[str]]]:
    for m in _ISLAND.finditer(text):
        yield m.start(), _PIECES.findall(m.group())


def _other_spelling(kind: int, text: str, pick: np.random.Generator) -> str:
    """A datum of the kind, written as no pattern has it; numbers of addresses and phones are drawn anew, so that any length is met."""
    digits = "".join(_DIGIT.findall(text))
    one = lambda *of: of[int(pick.integers(len(of)))]
    some = lambda n: "".join(map(str, pick.integers(0, 10, n)))
    if kind == 0:
        local, _, domain = text.partition("@")
        return local + one(" @ ", "[at]", "(at)", " [at] ", " (at) ") + (domain.replace(".", "[.]") if pick.random() < 0.3 else domain)
    if kind == 1:
        top = one(10, 100, 256, 256)
        return one("[.]", "(.)", " . ").join(str(int(x)) for x in pick.integers(0, top, 4))
    if kind == 2:
        return one(".", "/", "_", ":", " / ").join(digits[k : k + 4] for k in range(0, len(digits), 4))
    mark, country = one("-", ".", " ", "/"), str(int(pick.integers(1, one(10, 100, 1000))))
    if pick.random() < 0.6:  # three, three and four digits, with or without a country
        area, rest = some(3), mark.join((some(3), some(4)))
        return one(f"{area}{mark}{rest}", f"({area}) {rest}", f"{country}{mark}{area}{mark}{rest}", f"{country} ({area}) {rest}", f"00{country}{mark}{area}{mark}{rest}")
    area, rest = str(int(pick.integers(10, 10_000))), mark.join(one((some(7),), (some(3), some(4)), (some(4), some(4)), (some(3), some(2), some(2))))
    return one(f"00{country} {area} {rest}", f"00{country}{mark}{area}{mark}{rest}", f"00{country} ({area}) {rest}")


def _no_datum(kind: int, text: str, pick: np.random.Generator) -> str:
    """Something like it that is none."""
    digits = "".join(_DIGIT.findall(text))
    one = lambda *of: of[int(pick.integers(len(of)))]
    if kind == 0:
        return one(f"{text.partition('@')[0]} @ noon", "3 @ 20", f"v{digits or 2}[at]x")
    if kind == 1:
        parts = text.split(".")
        return one("[.]", " . ", ".").join(one([*parts[:3], str(256 + int(parts[3].lstrip("0") or 0))], parts[:3], [*parts, "7"]))
    if kind == 2:
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + int(pick.integers(8))) % 10)
        return one(".", "/", "_", ":", " ").join(wrong[k : k + 4] for k in range(0, len(wrong), 4))
    a, b, c = (int(x) for x in pick.integers([1950, 1, 1], [2050, 13, 29]))
    return one(f"{a}-{b:02d}-{c:02d}", f"{c}.{b}.{a}", f"{b}/{c}/{a} {b:02d}:{c:02d}", f"{digits[:3]}-{digits[3:7]}", f"{c},{digits[:3]},{digits[3:6]}.{digits[:2]}", f"{b}.{c}.{digits[0]}", f"{a}-{a + b}")


def _labelled(text: str, spans: list[Span]) -> Iterator[tuple[list[str], list[Span]]]:
    """The islands of a text with the spans in them as piece indices; not those with a span that isn't of whole pieces."""
    for at, pieces in islands(text):
        pos = np.concatenate([[0], np.cumsum([len(x) for x in pieces])]) + at
        where = {int(x): i for i, x in enumerate(pos)}
        inside = [x for x in spans if x[0] < pos[-1] and at < x[2]]
        if 1 < len(pieces) <= 60 and all(a in where and b in where for a, _, b in inside):
            free, gold = 0, []
            for a, k, b in inside:
                if a >= free:
                    gold, free = [*gold, (where[a], k, where[b])], b
            yield pieces, gold


def respelt(rows: list[tuple[list[str], list[Span]]], p: Params = Params()) -> list[tuple[list[str], list[Span]]]:
    """The islands, each span also in other spellings and beside spellings that are none; the choices hang on the texts alone."""
    out = list(rows)
    held = [sum(any(x[1] == k for x in gold) for _, gold in rows) for k in range(len(KINDS))]
    for pieces, gold in rows:
        pick = np.random.default_rng(list(hashlib.sha256("".join(pieces).encode("utf-8", "surrogatepass")).digest()))
        share = -(-p.spellings // min(held[k] for _, k, _ in gold)) if gold else 0
        for true in (True, False) * share:
            text, spans, done = "", [], 0
            for i, k, j in gold:
                text += "".join(pieces[done:i])
                new = (_other_spelling if true else _no_datum)(k, "".join(pieces[i:j]), pick)
                spans += [(len(text), k, len(text) + len(new))] if true else []
                text, done = text + new, j
            out += _labelled(text + "".join(pieces[done:]), spans)
    return out


def train(rows: list[tuple[list[str], list[Span]]], p: Params = Params()) -> Field:
    """By gradient ascent on the conditional likelihood, all islands at once; rows: (pieces, entities as piece indices)."""
    names: dict[str, int] = {}
    kept: dict[tuple[str, ...], int] = {}  # many segments have the same features
    segs, feats, same, gold = [], [], [], []
    for r, (pieces, spans) in enumerate(rows):
        kind = {(i, j): k for i, k, j in spans}
        for i in range(len(pieces)):
            for j in range(i + 1, min(len(pieces), i + p.longest) + 1):
                if of := segment_features(pieces, i, j):
                    segs.append((r, i, j))
                    if of not in kept:
                        kept[of] = len(kept)
                        feats.append([names.setdefault(x, len(names)) for x in of])
                    same.append(kept[of])
                    gold.append(kind.get((i, j), -1))
    if not segs:
        return Field({}, p.longest)
    kinds, none, wide = len(KINDS), len(names), max(map(len, feats))
    r, i, j = np.array(segs).T
    same = np.array(same)
    of = np.array([x + [none] * (wide - len(x)) for x in feats])
    target = (np.array(gold)[:, None] == np.arange(kinds)).astype(float)
    n, most = max(len(x) for x, _ in rows), p.longest
    w, square = np.full((none + 1, kinds), -0.05), np.full((none + 1, kinds), 1e-6)
    w[none] = 0.0
    for _ in range(p.steps):
        score = (w[of].sum(axis=1) - 1.0)[same]
        total = np.logaddexp.reduce(score, axis=1)
        ends, starts = np.full((n + 1, len(rows), most + 1), -np.inf), np.full((n + 1, len(rows), most + 1), -np.inf)
        ends[j, r, j - i] = starts[i, r, j - i] = total
        alpha, beta = np.full((len(rows), n + 1), -np.inf), np.full((len(rows), n + 1), -np.inf)
        alpha[:, 0] = beta[:, n] = 0.0
        for x in range(1, n + 1):  # pieces behind an island's end are outside of spans and cost nothing
            d = min(x, most)
            alpha[:, x] = np.logaddexp(alpha[:, x - 1], np.logaddexp.reduce(alpha[:, x - d : x][:, ::-1] + ends[x, :, 1 : d + 1], axis=1))
        for x in range(n - 1, -1, -1):
            d = min(n - x, most)
            beta[:, x] = np.logaddexp(beta[:, x + 1], np.logaddexp.reduce(beta[:, x + 1 : x + d + 1] + starts[x, :, 1 : d + 1], axis=1))
        step = target - np.exp(score + (alpha[r, i] + beta[r, j] - alpha[r, n])[:, None])
        each = [np.bincount(same, step[:, k], len(of)) for k in range(kinds)]
        grad = np.stack([np.bincount(of.ravel(), np.repeat(x, wide), none + 1) for x in each], axis=1) - p.ridge * len(rows) * w
        grad[none] = 0.0
        square += grad**2
        w += p.rate * grad / np.sqrt(square)
    return Field({(name, k): float(w[x, k]) for name, x in names.items() for k in range(kinds)}, p.longest)


def _examples(batches):
    """Islands of the texts with their base spans, the least of each shape and batch."""
    for batch in batches:
        least = {}
        for text in batch.column(0).to_pylist():
            if not text or not ("@" in text or _DIGIT.search(text) or _SIGN.search(text)):
                continue
            for pieces, gold in _labelled(text, base_spans(text)):
                shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]", "9", "".join(pieces)))
                one = ("".join(str(k) for _, k, _ in gold) or "-", "".join(pieces), json.dumps(gold))
                if shape not in least or one < least[shape]:
                    least[shape] = one
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.string()), *[pa.array([x[c] for x in least.values()], pa.string()) for c in range(3)]], names=["shape", "kinds", "island", "gold"])


def fit(docs: DataFrame, text: str = "text", p: Params = Params()) -> Field:
    """From at most p.sample islands of distinct shapes, those with the least hashes, in equal parts by the kinds they hold.

    The least of each of 16 parts of a kind's shapes are found first, so that no task holds all shapes of a kind; the
    driver gets 16 * p.sample islands at most, whatever the rows.
    """
    found = docs.select(text).mapInArrow(_examples, "shape string, kinds string, island string, gold string")
    one = found.groupBy("shape").agg(F.min(F.struct("kinds", "island", "gold")).alias("x")).select("shape", "x.*")
    each = one.withColumn("group", F.when(F.length("kinds") > 1, "many").otherwise(F.col("kinds"))).withColumn("hash", F.xxhash64("shape"))
    order = Window.partitionBy("group", F.pmod("hash", F.lit(16))).orderBy("hash", "shape")
    rows = each.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= p.sample // 6).select("group", "hash", "shape", "island", "gold").collect()
    taken: dict[str, list] = {}
    for x in sorted(rows, key=lambda x: (x["group"], x["hash"], x["shape"])):
        if len(of := taken.setdefault(x["group"], [])) < p.sample // 6:
            of.append((_PIECES.findall(x["island"]), [tuple(g) for g in json.loads(x["gold"])]))
    return train(respelt([x for of in taken.values() for x in of], p), p)


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    if not text or not ("@" in text or _DIGIT.search(text) or _SIGN.search(text)):
        return [], []
    base = base_spans(text)
    more, used = [], 0
    for at, pieces in islands(text):
        got = field.decode(pieces)
        if got:
            pos = np.concatenate([[0], np.cumsum([len(x) for x in pieces])]) + at
            for i, k, j in got:
                s, e = int(pos[i]), int(pos[j])
                while used < len(base) and max(b[2] for b in base[used : used + 1]) <= s:
                    used += 1
                if not any(b[0] < e and s < b[2] for b in base[max(0, used - 4) : used + 8]):
                    more.append((s, k, e))
    return base, sorted(base + more)


def _told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_spans(docs: DataFrame, field: Field, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys of docs with `base` and `spans`, arrays of (kind, start, end) in order."""
    sent = docs.sparkSession.sparkContext.broadcast((field.weights, field.longest))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        own = Field(*sent.value)
        for batch in batches:
            *rest, column = batch.columns
            found = [all_spans(t, own) for t in column.to_pylist()]
            told = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in f[i]] for f in found], span) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*rest, *told], names=[*keys, "base", "spans"])

    kinds, kind = dict(docs.dtypes), "array<struct<kind:string,start:long,end:long>>"
    return docs.select(*keys, F.col(text).alias("__text")).mapInArrow(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], f"base {kind}", f"spans {kind}"]))


def redact(text: str | None, spans: list[Span]) -> str | None:
    """Each span, or run of overlapping spans, replaced by its first kind in brackets."""
    if not spans:
        return text
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """docs with all spans replaced in `text`; other columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast((field.weights, field.longest))
    at = docs.columns.index(text)

    def run(batches):
        own = Field(*sent.value)
        for batch in batches:
            new = pa.array([redact(t, all_spans(t, own)[1]) for t in batch.column(at).to_pylist()], pa.string())
            yield batch.set_column(at, text, new)

    return docs.mapInArrow(run, docs.schema)


def op6_span_crf(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_spans(docs, fit(docs))
    said = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [of(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"))
