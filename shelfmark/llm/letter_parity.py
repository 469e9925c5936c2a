"""Spelling variants: words that one edit parts, and the commoner form that each may stand for.

Every word has a mask with a bit for each letter (letters of a large alphabet share bits): whether the word holds it an
odd number of times. One edit flips at most two bits, so of three bands of the mask one is equal in words that one edit
parts. Pairs are those of an equal band, and of lengths that differ by one at most. A band alone has few values and would
bring all words of a language together, so the join asks for more that such a pair must share: an edit touches one of the
four parts of a word, and the other three are equal. The key of the join is a band, the length of the shorter word, and
those three parts; it holds words that differ in one part and have the same parity in a band, which are few however many
words there are. Every pair that meets is verified by its edit distance.

All joins are by sorting, as their hints ask: Spark would size what is read from the compressed files, or is exploded into
keys, many times too low, and broadcast it through the driver.

Forms chain upwards: a form is at least twice as common as its word, so a chain of forms has at most as many steps as n
can be doubled. Roots are found by pointer doubling, in the logarithm of that many rounds.

Null and empty texts have no words. Repeated rows count again, as rows; a row with a null id is hashed as if its id were
the empty text. Texts and runs may be of any length. Other columns are not looked at, whatever their names. Of near words
that are equally common the first by code points is the form. Empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import crc_sql, table, written


@dataclass(frozen=True)
class Params:
    """shortest: code points of a word at least. least: occurrences at least. slip: one in so many occurrences loses a letter by its hash, which stands for typing errors. over: how much commoner a form is."""

    shortest: int = 5
    least: int = 3
    slip: int = 97
    over: int = 2


#: A run of letters, A to Z in either case and the block of Latin letters with marks.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BANDS, BITS, PARTS = 3, 21, 4


def slipped(doc: Column, run: Column, slip: int) -> Column:
    """The run, without the code point that the hash of document and run names where it names one."""
    h = F.crc32(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % slip == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def counted(docs: DataFrame, text: str = "text", key: str = "doc_id", p: Params = Params()) -> DataFrame:
    """(word, n): words of whole texts with their occurrences. Spark adds up within tasks before it shuffles."""
    run = F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{p.shortest},}}"), F.lit(0)))
    runs = docs.select(F.col(key).alias("id"), run.alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    words = runs.select(slipped(F.col("id"), F.col("run"), p.slip).alias("word")).filter(F.length("word") >= p.shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= p.least)


def mask(word: Column) -> Column:
    """Parity of letters in BANDS * BITS bits; neighbours in the alphabet go to different bands, so that each band has common letters."""
    letters = F.regexp_extract_all(word, F.lit("(?s)."), F.lit(0))
    point = lambda c: F.ascii(c)  # noqa: E731  the code point
    bit = lambda c: (point(c) % BANDS) * BITS + F.floor(point(c) / BANDS).cast("int") % BITS
    return F.aggregate(letters, F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit(c))))


def keys(word: Column, parity: Column, shorter: Column) -> Column:
    """A key for each band and part: of the band, and of all but the part. shorter: length of the shorter word of a pair, the word's own or one less."""
    length, bounds = F.length(word), [F.floor(shorter * q / PARTS).cast("int") for q in range(PARTS + 1)]
    rest = [F.struct(F.substring(word, F.lit(1), bounds[q]).alias("head"), F.substring(word, length - shorter + bounds[q + 1] + 1, length).alias("tail")) for q in range(PARTS)]
    band = lambda b: F.shiftrightunsigned(parity, b * BITS).bitwiseAND(F.lit(2**BITS - 1))
    return F.array(*[F.xxhash64(F.lit(b), band(b), shorter, F.lit(q), rest[q]) for b in range(BANDS) for q in range(PARTS)])


def one_edit(a: Column, b: Column) -> Column:
    """Whether one edit parts words, b as long as a or by one longer. Long words are halved about the edit first, as edit distance takes the square of the length."""

    def halved(s: Column, _: Column) -> Column:
        half = F.floor(F.length(s["a"]) / 2).cast("int")
        rest = F.length(s["a"]) - half
        x, y = F.substring(s["a"], F.lit(1), half), F.substring(s["b"], F.lit(1), half)
        behind = F.struct(F.substring(s["a"], half + 1, rest).alias("a"), F.substring(s["b"], half + 1, F.length(s["b"])).alias("b"))
        before = F.struct(x.alias("a"), F.substring(s["b"], F.lit(1), F.length(s["b"]) - rest).alias("b"))
        same_tail = behind["a"] == F.substring(s["b"], F.length(s["b"]) - rest + 1, rest)
        return F.when(x == y, behind).when(same_tail, before).otherwise(F.struct(F.lit("").alias("a"), F.lit("..").alias("b")))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.length(a))).cast("int"))
    left = F.aggregate(steps, F.struct(a.alias("a"), b.alias("b")), halved)
    return F.when(F.length(a) > 64, F.levenshtein(left["a"], left["b"], 1)).otherwise(F.levenshtein(a, b, 1)) == 1


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b) of words (word, n) that one edit parts; each pair once."""
    masked = words.withColumn("m", mask(F.col("word")))
    same = masked.select("word", "n", F.lit(False).alias("longer"), F.explode(keys(F.col("word"), F.col("m"), F.length("word"))).alias("key"))
    longer = masked.select("word", "n", F.lit(True).alias("longer"), F.explode(keys(F.col("word"), F.col("m"), F.length("word") - 1)).alias("key"))
    left = same.select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = same.unionByName(longer).select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), "longer")
    fits = F.when(F.col("longer"), F.length("b") == F.length("a") + 1).otherwise((F.length("b") == F.length("a")) & (F.col("a") < F.col("b")))
    met = left.join(right.hint("merge"), "key").filter(fits & one_edit(F.col("a"), F.col("b")))
    return met.groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))


def forms(words: DataFrame, pairs: DataFrame, p: Params = Params()) -> DataFrame:
    """(word, n, n_near, form, form_n): how many near words each has, and the commonest of them if it is p.over times as common."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n_other"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("n_other")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("minus"), "near")).alias("best"))
    out = words.join(best.hint("merge"), "word", "left")
    common = -F.col("best.minus") >= p.over * F.col("n")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(common, F.col("best.near")).alias("form"), F.when(common, -F.col("best.minus")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: pointers are doubled until none moves."""
    now = written(formed.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("above"))
        joined = written(now.join(up.hint("merge"), "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        now = joined.select("word", "root")
        if joined.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, text: str = "text", key: str = "doc_id", p: Params = Params()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of docs."""
    words = written(counted(docs, text, key, p), "words")
    formed = written(forms(words, near_pairs(words), p), "forms")
    out = formed.join(roots(formed).hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_letter_parity(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: Near words by their texts with one code point left out; roots by recursion.
OP11_SQL = f"""
WITH RECURSIVE runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]{{5,}}')), '{UPPER}', '{LOWER}') AS run FROM documents
), hashed AS (SELECT run, {crc_sql("(id || ':' || run)")} AS h FROM runs),
slipped AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, count(*) AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING count(*) >= 3),
cut AS (SELECT word, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (
    SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT cut.word, words.word FROM cut JOIN words ON cut.rest = words.word
    UNION SELECT words.word, cut.word FROM cut JOIN words ON cut.rest = words.word
),
best AS (
    SELECT near.word, count(*) AS n_near, first(w.word ORDER BY w.n DESC, w.word) AS top, max(w.n) AS top_n
    FROM near JOIN words w ON w.word = near.other GROUP BY near.word
),
formed AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 2 * w.n THEN top END AS form, CASE WHEN top_n >= 2 * w.n THEN top_n END AS form_n
    FROM words w LEFT JOIN best USING (word)
),
up AS (
    SELECT word, word AS place, 0 AS step FROM formed
    UNION ALL SELECT up.word, f.form, step + 1 FROM up JOIN formed f ON f.word = up.place WHERE f.form IS NOT NULL
),
top AS (SELECT word, max_by(place, step) AS root FROM up GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN top USING (word)
"""
