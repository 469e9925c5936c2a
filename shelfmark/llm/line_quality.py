r"""Quality rules, line first, in DataFrame expressions only.

Every line is judged by itself, and by how it is built rather than by its language: punctuation (no letter, or more marks
and digits than letters), navigation (short labels between bars, a menu's word, and short lines without an end mark, four or
more in a row), boilerplate (a copyright sign with a year, and phrases of licence, copyright and
cookie notices in several languages). Lines that fail are removed; a document that loses too large a part of its text, or
has little left, is rejected.

Short is what has few words and few letters: in scripts that set no spaces a line is one word, so their letters count, as
many as few words have. An end mark is any closing or other punctuation of Unicode, but for signs that labels end with. The
phrases of notices are a list and not learned from lines that recur: whole copies recur as well, and their lines are no
notices; which copies there are is what near-duplicate operators find, and not known line by line.

Null and empty texts have no words and are not kept. Long texts are judged whole; repeated rows get equal results; empty
tables give empty results. Every column of the rows stays, but for those named as the results, which are replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import SPACE, table

SYMBOLS = "#*$%&|<>"
#: What navigation and boilerplate lines hold, in lower case.
MENU = ("home", "menu", "next", "previous", "back to top", "login", "log in", "sign up", "share", "read more", "skip to content")
BOILERPLATE = (
    "all rights reserved", "copyright (c)", "\u00a9", "cookie policy", "privacy policy", "terms of use", "terms of service", "apache license", "gnu general public license", "public license, version", "permission is hereby granted",
    "javascript is required", "lorem ipsum", "alle rechte vorbehalten", "tous droits r\u00e9serv\u00e9s", "todos los derechos reservados", "tutti i diritti riservati",
)
#: What stands between labels, with a space on both sides.
BARS = ("|", "\u00bb", "\u203a", ">", "\u00b7", "\u2022", "::")
#: A label has four words at most.
LABEL = r"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){1,4}$"
#: Letters of scripts that set no spaces: those of which a word has about two, and about five.
DENSE, LONGER = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}", r"\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}"
#: No label has more letters than this.
LONG = rf"^(?:[^{DENSE}]*+[{DENSE}]){{9}}|^(?:[^{LONGER}]*+[{LONGER}]){{21}}|^(?:\P{{L}}*+\p{{L}}){{41}}"
#: What a line ends with that isn't a label.
END = r"[\p{Po}\p{Pe}\p{Pf}&&[^#%&*@/\\\u00b7\u2022]]"
#: A line of three words at most without an end mark, short if it isn't LONG; RUN finds those that are four or more in a row.
SHORT = rf"^[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){{0,2}}[^\x20\x09-\x0D]++(?<!{END})[\x20\x09-\x0D]*+$"
RUN = "s(?=sss)|(?<=s)s(?=ss)|(?<=ss)s(?=s)|(?<=sss)s"
NOTICE = r"(?:\(c\)|copyright)[ \t]*[12][0-9]{3}"


def let(value: Column, body) -> Column:
    """body of value, computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words that stand in a window of `width` words found twice or more in the text, the first included.

    Windows are compared as whole strings; only texts with two windows of one hash pay for that.
    """

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def runs(rows: Column) -> Column:
            back = F.concat(F.array(F.lit(None).cast("string")), F.transform(F.slice(rows, F.lit(1), F.size(rows) - 1), lambda r: r["w"]))
            ahead = F.concat(F.transform(F.slice(rows, F.lit(2), F.size(rows) - 1), lambda r: r["w"]), F.array(F.lit(None).cast("string")))
            sided = F.zip_with(rows, F.zip_with(back, ahead, lambda x, y: F.struct(x.alias("back"), y.alias("ahead"))), lambda r, s: F.when(r["w"].eqNullSafe(s["back"]) | r["w"].eqNullSafe(s["ahead"]), r["i"]))
            return F.sort_array(F.filter(sided, lambda i: i.isNotNull()))

        total = lambda at: F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(width), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
        return let(let(placed, runs), total)

    n = F.size(words)
    strings = F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.array_join(F.slice(words, i, width), " "))
    one = F.transform(words, lambda w: F.xxhash64(w))
    hashes = let(one, lambda h: F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[h[i + k] for k in range(width)])))
    alike = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when((n > width) & alike, let(strings, covered)).otherwise(F.lit(0)).cast("long")


def any_of(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(or_, [text.contains(p) for p in parts])


def beside(docs: DataFrame, text: str, results: tuple[str, ...], add) -> DataFrame:
    """docs with the results that add puts beside `_whole`, their texts; all other columns pass by in a struct, whatever their names."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_whole"))
    old = [F.col("_row").getField(c).alias(c) for c in docs.columns if c not in results]
    return add(packed).select(*old, *results)


def clean_lines(docs: DataFrame, text: str = "text", most_lost: float = 0.3, least_words: int = 5) -> DataFrame:
    """docs with `clean_text` (the lines that pass), `lost` (share of non-space characters removed) and `lines_kept` (the verdict).

    The needles are sought in the whole text first; only texts that hold one have them sought line by line.
    """
    whole, lines = F.col("_whole"), F.col("_lines")
    solid = lambda x: F.length(F.regexp_replace(x, SPACE, ""))
    barred = lambda x: reduce(or_, [x.contains(f" {b} ") for b in BARS])

    def labels(line: Column, bar: str) -> Column:
        return line.contains(f" {bar} ") & let(F.split(line, rf"\Q {bar} \E", -1), lambda parts: (F.size(parts) >= 3) & F.forall(parts, lambda x: x.rlike(LABEL) & ~x.rlike(LONG)))

    def fails(line: Column, run: Column, of: Column) -> Column:
        wordless = ~line.rlike(r"\p{L}") & line.rlike(r"[^\x20\x09-\x0D]")
        marks = line.rlike(r"[^\p{L}\x20\x09-\x0D]") & (2 * F.length(F.regexp_replace(line, r"\P{L}+", "")) < solid(line))
        navigation = of["barred"] & reduce(or_, [labels(line, b) for b in BARS])
        menu = (F.length(line) <= 40) & F.lower(F.trim(line)).isin(*MENU)
        legal = of["legal"] & let(F.lower(line), lambda x: any_of(x, BOILERPLATE) | x.rlike(NOTICE))
        return wordless | marks | navigation | menu | legal | run.eqNullSafe("n")

    def add(packed: DataFrame) -> DataFrame:
        legal = let(F.lower(whole), lambda x: any_of(x, BOILERPLATE) | x.rlike(NOTICE))
        out = packed.withColumn("_lines", F.split(whole, "\n", -1))
        short = F.array_join(F.transform(lines, lambda x: F.when(x.rlike(SHORT) & ~x.rlike(LONG), "s").otherwise("x")), "")
        runs = F.when(F.size(lines) > 3, F.split(F.regexp_replace(short, RUN, "n"), "")).otherwise(F.array().cast("array<string>"))
        # what the lines are judged by is made once a text, and not in the function of a line
        failed = let(F.struct(legal.alias("legal"), barred(whole).alias("barred")), lambda of: F.zip_with(lines, runs, lambda x, run: fails(x, run, of)))
        out = out.withColumn("_failed", F.slice(failed, F.lit(1), F.size(lines)))
        some = F.exists("_failed", lambda x: x)
        passed = F.filter(lines, lambda x, i: ~F.col("_failed")[i])
        out = out.withColumn("clean_text", F.when(some, F.array_join(passed, "\n")).otherwise(F.col("_row").getField(text)))
        out = out.withColumn("lost", F.when(~whole.rlike(r"[^\x20\x09-\x0D]"), F.lit(1.0)).when(some, 1 - solid(F.col("clean_text")) / solid(whole)).otherwise(F.lit(0.0)))
        enough = F.coalesce(F.col("clean_text").rlike(r"([^\x20\x09-\x0D]++[\x20\x09-\x0D]++){%d}[^\x20\x09-\x0D]" % (least_words - 1)), F.lit(False))
        return out.withColumn("lines_kept", (F.col("lost") <= most_lost) & enough)

    return beside(docs, text, ("clean_text", "lost", "lines_kept"), add)


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    whole = F.col("_whole")
    solid = F.filter(F.split(whole, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.regexp_replace(whole, SPACE, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(whole, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": let(solid, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(F.col("_words")),
    }
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return beside(docs, text, (*counts, "base_failed"), lambda packed: packed.withColumn("_words", words_of(whole)).withColumns(counts).withColumn("base_failed", failed))


def op3_line_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = clean_lines(base_counts(docs)).withColumn("kept", ~F.col("base_failed") & F.col("lines_kept"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost")
