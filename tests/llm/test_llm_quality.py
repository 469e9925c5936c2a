import re
import unicodedata

import regex
from oddities import ROWS, none, odd
from pyspark.sql import functions as F

from shelfmark.llm import line_quality as M

SPACE = " \t\n\x0b\x0c\r"


def base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if x.strip(SPACE)]
    seen, hit = {}, set()
    for k in range(len(w) - 4):
        seen.setdefault(tuple(w[k : k + 5]), []).append(k)
    for at in seen.values():
        if len(at) > 1:
            hit |= {j for k in at for j in range(k, k + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def ended(c):
    return unicodedata.category(c) in ("Po", "Pe", "Pf") and c not in "#%&*@/\\\u00b7\u2022"


def long(line):
    dense, longer = (len(regex.findall(p, line)) for p in (r"[\p{Han}\p{Hiragana}\p{Katakana}]", r"[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]"))
    return dense > 8 or longer > 20 or len(regex.findall(r"\p{L}", line)) > 40


def failing(text):
    """Which lines fail, by the rules as they are stated."""
    lines = text.split("\n")
    words = [re.findall(r"[^\x20\x09-\x0D]+", x) for x in lines]
    short = [0 < len(w) <= 3 and not ended(w[-1][-1]) and not long(x) for x, w in zip(lines, words)]
    out = []
    for k, (line, w) in enumerate(zip(lines, words)):
        low, solid = line.lower(), "".join(w)
        letters = sum(c.isalpha() for c in solid)
        bars = any(len(parts := line.split(f" {b} ")) >= 3 and all(1 <= len(re.findall(r"[^\x20\x09-\x0D]+", x)) <= 4 and not long(x) for x in parts) for b in M.BARS)
        run = any(all(short[j : j + 4]) and len(short[j : j + 4]) == 4 for j in range(max(0, k - 3), k + 1))
        notice = any(b in low for b in M.BOILERPLATE) or re.search(r"(\(c\)|copyright)[ \t]*[12][0-9]{3}", low)
        out.append(bool((solid and 2 * letters < len(solid)) or bars or run or (len(line) <= 40 and low.strip(" ") in M.MENU) or notice))
    return out


def verdict(text):
    t = text or ""
    solid = lambda x: len(re.sub(r"[\x20\x09-\x0D]", "", x))
    clean = "\n".join(x for x, gone in zip(t.split("\n"), failing(t)) if not gone)
    return solid(t) > 0 and 1 - solid(clean) / solid(t) <= 0.3 and len(re.findall(r"[^\x20\x09-\x0D]+", clean)) >= 5


def test_documents(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = M.op3_line_quality(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        b = base(texts[r["doc_id"]])
        assert tuple(r)[1:7] == b and r["kept"] == (not b[5] and verdict(texts[r["doc_id"]])), r


SCRIPTS = {
    "Chinese": "\u4eca\u5929\u5929\u6c14\u5f88\u597d\uff0c\u6211\u4eec\u53bb\u516c\u56ed\u8d70\u4e86\u4e00\u8d9f\uff01",
    "Chinese without marks": "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb\u516c\u56ed\u8d70\u4e86\u4e00\u8d9f",
    "Japanese": "\u304d\u3087\u3046\u306f\u5929\u6c17\u304c\u3044\u3044\u306e\u3067\u516c\u5712\u306b\u884c\u304d\u307e\u3057\u305f\u3002",
    "Thai": "\u0e27\u0e31\u0e19\u0e19\u0e35\u0e49\u0e2d\u0e32\u0e01\u0e32\u0e28\u0e14\u0e35\u0e21\u0e32\u0e01\u0e40\u0e23\u0e32\u0e08\u0e36\u0e07\u0e44\u0e1b\u0e40\u0e14\u0e34\u0e19\u0e40\u0e25\u0e48\u0e19\u0e43\u0e19\u0e2a\u0e27\u0e19",
    "Hindi": "\u0906\u091c \u092e\u094c\u0938\u092e \u0905\u091a\u094d\u091b\u093e\u0964",
}


def test_lines_of_any_script(spark):
    """Sentences of scripts without spaces, and with end marks of their own, stay; menus in them go."""
    rows = [(k, "\n".join([line] * 6)) for k, line in SCRIPTS.items()]
    menus = {"Chinese": "\u9996\u9875\n\u65b0\u95fb\n\u8054\u7cfb\u6211\u4eec\n\u767b\u5f55\n\u5e2e\u52a9", "Thai": "\u0e2b\u0e19\u0e49\u0e32\u0e41\u0e23\u0e01\n\u0e02\u0e48\u0e32\u0e27\n\u0e15\u0e34\u0e14\u0e15\u0e48\u0e2d\n\u0e40\u0e02\u0e49\u0e32\u0e2a\u0e39\u0e48\u0e23\u0e30\u0e1a\u0e1a"}
    rows += [(f"menu {k}", x) for k, x in menus.items()]
    got = {r["k"]: r for r in M.clean_lines(spark.createDataFrame(rows, "k string, text string")).collect()}
    for k, text in rows:
        assert got[k]["lost"] == (1.0 if k.startswith("menu") else 0.0), k
        assert [x for x, gone in zip(text.split("\n"), failing(text)) if not gone] == (got[k]["clean_text"].split("\n") if got[k]["clean_text"] else []), k
    assert got["Chinese"]["lines_kept"] and got["Thai"]["lines_kept"] and got["Hindi"]["lines_kept"]


def test_lines(spark):
    page = "Home | News | About\nThis is a long sentence of the story that matters here.\nIt goes on for a while with many more words.\nAll rights reserved 2020\n---- 123 ----\nLogin"
    r = M.clean_lines(spark.createDataFrame([(page,)], "text string")).first()
    assert r["clean_text"] == "\n".join(page.split("\n")[1:3]) and r["lost"] > 0.3 and not r["lines_kept"]


def test_lines_of_any_language(spark):
    story = "Der Zug h\u00e4lt heute nicht in diesem Ort, weil das Gleis gesperrt ist."
    gone = ["Inicio \u00bb Noticias \u00bb Deportes", "== 12 / 7 == ab", "(c) 2019 Verlag", "Tous droits r\u00e9serv\u00e9s.", "Accueil", "Qui sommes-nous", "Nos produits", "Contact"]
    kept = [story, "Ein kurzer Satz.", "Kapitel eins", "a | b", "The first long cell of a table row here | the second long cell of this row | third"]
    text = "\n".join([kept[0], *gone[:4], kept[1], *gone[4:], kept[0], kept[2], *kept[3:]])
    r = M.clean_lines(spark.createDataFrame([(text,)], "text string")).first()
    assert r["clean_text"].split("\n") == [kept[0], kept[1], kept[0], kept[2], *kept[3:]]


def test_oddities(spark):
    got = M.clean_lines(M.base_counts(odd(spark))).collect()
    assert len(got) == len(ROWS)
    want = sorted((base(r[1]) for r in ROWS))
    assert sorted((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert M.clean_lines(M.base_counts(none(spark))).isEmpty()
    out = M.clean_lines(M.base_counts(odd(spark)))
    theirs = odd(spark).drop("lost")
    assert out.select(theirs.columns).exceptAll(theirs).isEmpty()
    clash = odd(spark).select("text", *[F.lit(7).alias(c) for c in ("_row", "_whole", "_runs", "_failed", "lost")])
    got = M.clean_lines(clash)
    assert got.filter("_row = 7 AND _whole = 7 AND _runs = 7 AND _failed = 7").count() == len(ROWS) and got.filter("lost > 1").isEmpty()


def test_no_python_in_the_plan(spark, sf_dir):
    plan = M.op3_line_quality(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
