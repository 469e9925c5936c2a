import hashlib
import random
import zlib

import pytest
from parity import same
from pyspark.sql import functions as F

from shelfmark.llm import prefix_trie as M

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Rows of the trie by dictionaries of whole prefixes."""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            digest = hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest()
            own.setdefault(c, []).append((t is not None, t or 0, r, digest[:32], x))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        built[c] = tuple(own.get(first, [])[:h] + v[h:])
    members = {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for s in members:
        if s:
            children[s[:-1]] += 1
    for s, m in members.items():
        own_saved = (len(m) - 1) * len(s[-1][1].encode()) if s else 0
        for d in range(len(s) + 1):
            saved[s[:d]] += own_saved
            leaves[s[:d]] += not children[s]
    out = []
    for s, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(s))))
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), children[s], leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.collect()), key=str)


def talk(rng, n):
    """Conversations that share beginnings, some whole, one of them by a third."""
    common = [("user" if k % 2 == 0 else "assistant", f"turn {k} é" * 3) for k in range(12)]
    rows = []
    for c in range(n):
        kind = rng.random()
        turns = list(common[: rng.randrange(13)]) if kind < 0.5 else list(common[:4]) if kind < 0.8 else []
        turns += [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", None, "", f"x{rng.randrange(9)}"])) for _ in range(rng.randrange(3))]
        rows += [(c * 3 - 40 * (c % 7 == 0), k, r, x) for k, (r, x) in enumerate(turns)]
    rows += [(9001, k, "user", f"deep {k}") for k in range(700)] + [(9006, k, "user", f"deep {k}" if k < 690 else "other") for k in range(700)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("p", [M.Params(), M.Params(range_bytes=2000, fan=2), M.Params(range_bytes=9000, fan=3)])
def test_is_brute_force(spark, p):
    """In one part; in many parts, whose borders are closed over several levels."""
    rows = talk(random.Random(3), 500)
    assert rows_of(M.trie(spark.createDataFrame(rows, SCHEMA), p)) == brute(rows)


def test_merge_is_a_sort():
    """Sequences and LCPs of the loser tree are those of one sort, for any number of runs."""
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 8, 40):
        seqs = list({b"".join(bytes([rng.randrange(3)]) * M.WIDE for _ in range(rng.randrange(9))) for _ in range(12 * k)})
        runs = [sorted(seqs[i::k]) for i in range(k)]
        merged = list(M.merged([[(s, M.common(r[i - 1], s, 0) if i else 0, s) for i, s in enumerate(r)] for r in runs]))
        want = sorted(seqs)
        assert [m[0] for m in merged] == want == [m[2] for m in merged]
        assert [m[1] for m in merged][1:] == [M.common(a, b, 0) for a, b in zip(want, want[1:], strict=False)]


def test_common():
    rng = random.Random(2)
    for _ in range(300):
        n, at = rng.randrange(0, 200), rng.randrange(0, 200)
        a = bytearray(rng.randbytes(n * M.WIDE))
        b = bytearray(a) + rng.randbytes(M.WIDE * rng.randrange(3))
        if at < n:
            b[at * M.WIDE + 5] ^= 1
        for start in {0, min(at, n) // 2, min(at, n)}:
            assert M.common(bytes(a), bytes(b), start) == min(at, n)


def test_turns_are_not_compared_again():
    """Merging runs that share a long beginning compares it once for each run, not for each sequence."""
    beginning = b"\1" * M.WIDE * 400
    seqs = sorted(beginning + bytes([a, b]) * (M.WIDE // 2) for a in range(40) for b in range(40))
    runs = [[(s, 400 if i else 0, None) for i, s in enumerate(seqs[k::8])] for k in range(8)]
    seen, plain = [], M.common
    M.common = lambda a, b, start: seen.append(plain(a, b, start) - start) or start + seen[-1]
    try:
        assert len(list(M.merged(runs))) == 1600
    finally:
        M.common = plain
    assert sum(seen) <= 400 * 8


def test_conversations(spark, sf_dir, duck):
    got = M.op13_prefix_trie(spark, sf_dir)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(got) == brute(rows)
    assert same(got, duck, M.OP13_SQL) is None


def test_oddities(spark):
    rows = [(1, None, None, None), (1, None, None, None), (1, 0, "user", None), (1, 0, "user", "x" * 10**6), (None, 0, "user", "lost"), (0, 5, "", ""), (0, 5, "", ""), (2, 1, "a", "b"), (3, 1, "a", "b"), (7, 0, None, "z"), (-3, 0, "user", "minus"), (-1, 0, "user", "minus")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("first", "head", "node", "n", "depth", "seq", "sizes", "turns", "key")})
    assert rows_of(M.trie(df)) == brute(rows)
    assert M.trie(df.limit(0)).isEmpty()
    assert M.trie(df.filter("conv_id is null")).isEmpty()
