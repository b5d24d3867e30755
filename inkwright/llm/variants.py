"""Operator 11, spelling variants by anagram hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize

#: The letters of a word, after A-Z are lower-cased: a-z, then U+00C0 to U+00FF.
RUN = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of an anagram key that are compared with each other; larger keys are split by letter order.
BUCKET = 32


def vocabulary(df: DataFrame, key: str = "doc_id", text: str = "text", min_length: int = 7, min_count: int = 2, noise: int = 31) -> DataFrame:
    """word, n: how often each word stands in all texts, at least ``min_count`` times.

    Maximal runs of letters are lower-cased (A-Z only). Where ``noise`` divides the CRC-32 of
    "<key>:<run>", the run loses its code point number crc % length; None leaves all runs as they
    are. Results shorter than ``min_length`` code points don't count. Null texts have no runs, a
    null key is written as nothing, repeated rows count each. An empty table gives no words; extra
    columns play no part. Texts are read whole; counts are summed before the exchange.
    """
    # no run shorter than the least length can give a word, as runs only ever lose letters
    runs = df.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"{RUN}{{{min_length},}}"), F.lit(0))).alias("run"))
    word = F.translate("run", UPPER, LOWER)
    if noise:
        runs = runs.select("k", word.alias("run")).withColumn("h", F.crc32(F.concat("k", F.lit(":"), "run").cast("binary")))
        at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
        word = F.when(F.col("h") % noise == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).filter(F.char_length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def letter_power(c: Column) -> Column:
    """Fifth power of the letter's number from 1 to 90; 0 for no letter.

    No two pairs of such powers have equal sums, so a difference of two tells which letters they were.
    A sum stays within a long for any text that Spark can hold.
    """
    code = F.ascii(c)
    powers = F.array(*[F.lit(i**5).cast("long") for i in range(91)])
    return F.get(powers, F.when(code == 0, 0).when(code < 128, code - 96).otherwise(code - 165))


def anagram_key(letters: Column) -> Column:
    """The sum of the powers of a word's letters: equal for anagrams, and for nothing else of their length in practice."""
    return F.aggregate(letters, F.lit(0).cast("long"), lambda a, c: a + letter_power(c))


def near_pairs(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """word, n, other, other_n for all words that differ by exactly one inserted, deleted or replaced letter, both ways.

    words: distinct words of letters with a count n. Each word stands under its key, and under its
    key less each of its letters: words whose keys differ by one letter's value, or by the exchange
    of one value for another, meet there once, as pairs of powers have different sums. Letter order
    is then verified. Where over ``bucket`` rows share a key (many anagrams), the key is joined by a
    hash of the letters that remain, in order, so a group is as large as its true pairs; that
    writes a row for each place of a letter. Words of any length; no words give no pairs.
    """
    letters = F.split("word", "")
    rows = words.select("word", "n", anagram_key(letters).alias("key"), F.explode(F.array_union(F.array(F.lit("")), letters)).alias("letter"))
    rows = materialize(rows.select((F.col("key") - letter_power(F.col("letter"))).alias("key"), "letter", "word", "n"), "variant-keys")
    heavy = rows.groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > bucket).select("key")
    heavy = materialize(heavy, "variant-heavy")

    def pairs(side: DataFrame, on: list[str]) -> DataFrame:
        theirs = side.select(*on, F.col("letter").alias("l2"), F.col("word").alias("other"), F.col("n").alias("other_n"))
        return side.join(theirs, on).filter((F.col("letter") != F.col("l2")) & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other", "other_n")

    light = pairs(rows.join(heavy, "key", "left_anti"), ["key"])
    places = F.filter(F.sequence(F.lit(1), F.char_length("word")), lambda p: F.substring("word", p, F.lit(1)) == F.col("letter"))
    rest = lambda p: F.xxhash64(F.concat(F.substring("word", F.lit(1), p - 1), F.substring("word", p + 1, F.char_length("word"))))
    rests = F.when(F.col("letter") == "", F.array(F.xxhash64("word"))).otherwise(F.array_distinct(F.transform(places, rest)))
    dense = rows.join(heavy, "key", "left_semi").withColumn("rest", F.explode(rests))
    return light.union(pairs(dense, ["key", "rest"]).distinct())


def word_forms(words: DataFrame, ratio: int = 10, bucket: int = BUCKET) -> DataFrame:
    """word, n, form, root, n_near, form_n for every word of a vocabulary (distinct words with n).

    n_near: how many words are near, by one letter inserted, deleted or replaced. form: the near word
    of largest n (ties: the smallest in code-point order), if its n is at least ``ratio`` times the
    word's; else null, as form_n. root: the word that forms lead to, the word itself without a form;
    counts grow by the ratio at each step, so ways are short and can't turn back. Words without near
    ones have n_near 0. No words give no rows.
    """
    words = materialize(words.select("word", "n"), "variant-words")
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    near = near_pairs(words, bucket).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    taken = -F.col("best.n") >= ratio * F.col("n")
    near = materialize(near.select("word", "n_near", F.when(taken, F.col("best.word")).alias("form"), F.when(taken, -F.col("best.n")).alias("form_n")), "variant-near")
    # each word points at its form; pointers jump to their pointer's pointer until none moves
    at = materialize(near.filter("form is not null").select("word", F.col("form").alias("at")), "variant-roots")
    moved = at.limit(1).count()
    while moved:
        on = materialize(at.join(at.select(F.col("word").alias("at"), F.col("at").alias("next")), "at", "left").select("word", F.coalesce("next", "at").alias("at"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        drop_scratch(at)
        moved = on.filter("moved").limit(1).count()
        at = on.select("word", "at")
    out = words.join(near, "word", "left").join(at, "word", "left")
    return out.select("word", "n", "form", F.coalesce("at", "word").alias("root"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


_CRC = "xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split({s}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x)::BIGINT >> 6), 128 + (unicode(x)::BIGINT & 63)] END))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"
ORACLE_SQL = f"""
WITH RECURSIVE crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i::BIGINT], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
found AS (SELECT coalesce(doc_id::VARCHAR, '') AS k, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
runs AS (SELECT k, run, count(*) AS n FROM found WHERE length(run) >= 7 GROUP BY k, run),
hashed AS (SELECT run, n, {_CRC.format(s="k || ':' || run")} AS h FROM runs, crc_table),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN run[:(h % length(run))] || run[(h % length(run)) + 2:] ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gaps AS (SELECT word, n, p, word[:p - 1] || word[p + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
 UNION SELECT g.word, g.n, w.word, w.n FROM gaps g JOIN words w ON w.word = g.rest
 UNION SELECT w.word, w.n, g.word, g.n FROM gaps g JOIN words w ON w.word = g.rest),
ranked AS (SELECT word, n, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS r FROM near),
forms AS (SELECT w.word, w.n, coalesce(k.n_near, 0) AS n_near, CASE WHEN k.other_n >= 10 * w.n THEN k.other END AS form, CASE WHEN k.other_n >= 10 * w.n THEN k.other_n END AS form_n FROM words w LEFT JOIN ranked k ON k.word = w.word AND k.r = 1),
chains AS (SELECT word, word AS at, form AS next FROM forms UNION ALL SELECT c.word, f.word, f.form FROM chains c JOIN forms f ON f.word = c.next)
SELECT f.word, f.n, f.form, c.at AS root, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n FROM forms f JOIN chains c ON c.word = f.word AND c.next IS NULL
"""
