"""Quality rules, with DataFrame functions only.

Base rules count words, symbols, repeated lines and repeated three-word windows
inside each row. The method's verdict is a hashed n-gram log-likelihood ratio:
word unigrams and bigrams are hashed to ``BUCKETS`` buckets, as many whatever
the corpus; a trusted-target multinomial (texts labelled as good, a sample
bounded by ``MOST_TRUSTED``) and a raw-corpus
multinomial (all texts) give each bucket the logarithm of how much more often
trusted texts hold it than raw ones would, one count added to either; a
document's score is the mean over its n-grams, and it is kept where the score
is at least ``THRESHOLD - SLACK / sqrt(n-grams)``: one fixed rule for every
document, with room for the spread of short texts.

Repeated windows are found by sorting, inside the row, 64-bit numbers of which
the high bits are the window's hash and the low 24 its place; neighbours of
equal high bits are compared by their whole 64-bit hashes.

Defined results. Null or empty text: no words, base_failed, not kept. Without
any label of good quality the ratio is 0 everywhere and base rules decide.
doc_id may be null or repeat: each row is judged by itself. Further columns are
not read. An empty table gives an empty result. A text of more than 2**24 words
sorts pairs of hash and place instead.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.llm._tables import table

#: Buckets of n-grams; their ratios stand in the plan as one literal of about 0.6 MB, parsed once a task.
BUCKETS = 1 << 16
MOST_TRUSTED = 10_000
SMOOTH = 1.0
THRESHOLD = -0.04
SLACK = 0.5
_SEPARATORS = " \t\n\x0b\f\r"
_SPLIT = r"[\x20\x09-\x0D]+"
_PLACE = 24


def word_array(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SEPARATORS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _SPLIT))


def _span(n: Column) -> Column:
    """0 … n - 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _repeat_words(words: Column) -> tuple[Column, Column]:
    """Words that stand in three-word windows found twice or more, and the sorted keys that tell."""
    hashes = F.col("_h3")
    high = F.lit(-(1 << _PLACE))
    keys = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(high).bitwiseOR(i.cast("long"))))
    place = lambda k: k.bitwiseAND(F.lit((1 << _PLACE) - 1)).cast("int")

    def same(keys: Column, a: Column, b: Column) -> Column:
        x, y = F.get(keys, a), F.get(keys, b)
        return (x.bitwiseXOR(y).bitwiseAND(high) == 0) & (F.get(hashes, place(x)) == F.get(hashes, place(y)))

    def covered(starts: Column) -> Column:
        return F.aggregate(F.sort_array(starts), F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, s: F.struct((a["n"] + F.least(F.lit(3), s - a["last"])).alias("n"), s.alias("last")), lambda a: a["n"].cast("long"))

    def starts(keys: Column) -> Column:
        twice = F.filter(_span(F.size(keys)), lambda j: F.coalesce(same(keys, j, j - 1), F.lit(False)) | F.coalesce(same(keys, j, j + 1), F.lit(False)))
        return F.transform(twice, lambda j: place(F.get(keys, j)))

    # a text of more words than places fit takes pairs of hash and place
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    like = lambda p, j: F.coalesce(F.get(p, j)["h"] == F.get(p, j - 1)["h"], F.lit(False)) | F.coalesce(F.get(p, j)["h"] == F.get(p, j + 1)["h"], F.lit(False))
    long_starts = F.transform(F.array(pairs), lambda p: F.transform(F.filter(_span(F.size(p)), lambda j: like(p, j)), lambda j: F.get(p, j)["i"]))[0]
    wide = F.size(hashes) > (1 << _PLACE)
    count = F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).when(wide, covered(long_starts)).otherwise(covered(starts(F.col("_keys"))))
    return count, F.when(~wide, keys)


def with_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, _words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_SEPARATORS)) != "")
    repeat, keys = _repeat_words(F.col("_words"))
    # explode of one-element arrays: what stands above (a filter on kept, say) cannot be
    # pushed below and so cannot copy these expressions into lambdas that run once a word
    out = docs.select(
        *keep,
        F.explode(F.array(word_array(F.col("text")))).alias("_words"),
        F.length(F.translate(text, _SEPARATORS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    )
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    out = out.withColumn("_h3", F.transform(_span(F.size("_words") - 2), lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))))
    out = out.select("*", F.explode(F.array(F.struct(F.col("_h3").alias("h"), keys.alias("k")))).alias("_s")).drop("_h3").select("*", F.col("_s.h").alias("_h3"), F.col("_s.k").alias("_keys")).drop("_s")
    out = out.select("*", F.explode(F.array(repeat)).alias("n_repeat_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("_h3", "_keys")


def gram_buckets(words: Column, buckets: int) -> Column:
    """Buckets of all unigrams and bigrams of a word array; the last word's bigram is with nothing."""
    return F.flatten(F.transform(words, lambda w, i: F.array(F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"), F.pmod(F.xxhash64(w, F.coalesce(F.get(words, i + 1), F.lit(""))), F.lit(buckets)).cast("int"))))


def train(docs: DataFrame, trusted_ids: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """The log-likelihood ratio of each bucket: log((trusted + 1) / (expected + 1))."""
    n = trusted_ids.count()
    part = 1_000_000 if n <= MOST_TRUSTED else MOST_TRUSTED * 1_000_000 // n
    # about MOST_TRUSTED ids at most, so sending them to every task is bounded by that parameter
    sample = trusted_ids.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000)) < part).select("doc_id").distinct().withColumn("_good", F.lit(1))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id", "left")
    rows = rows.select(F.coalesce("_good", F.lit(0)).alias("good"), word_array(F.col("text")).alias("_words"))  # once a row, not once a lambda call
    grams = rows.select("good", F.explode(gram_buckets(F.col("_words"), buckets)).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good")).collect()  # one row for each bucket
    all_raw, all_good = sum(r["raw"] for r in counts), sum(r["good"] for r in counts)
    ratio = [0.0] * buckets
    for r in counts if all_good else ():
        ratio[r["bucket"]] = math.log(r["good"] + SMOOTH) - math.log(all_good * r["raw"] / all_raw + SMOOTH)
    return ratio


def verdicts(counted: DataFrame, ratio: list[float]) -> DataFrame:
    """counted with llr, the mean log-likelihood ratio of a text's n-grams, and kept."""
    # one literal that Spark folds to an array once, not a join
    weights = F.from_json(F.lit(json.dumps([round(x, 5) for x in ratio])), "array<double>")
    weight = lambda *w: F.get(weights, F.pmod(F.xxhash64(*w), F.lit(len(ratio))).cast("int"))
    each = F.transform("_words", lambda w, i: weight(w) + weight(w, F.coalesce(F.get("_words", i + 1), F.lit(""))))
    total = F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x)
    out = counted.withColumn("llr", F.when(F.col("n_words") > 0, total / (2 * F.col("n_words"))))
    enough = F.col("llr") >= F.lit(THRESHOLD) - F.lit(SLACK) / F.sqrt(2 * F.col("n_words"))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(enough, F.lit(False))).drop("_words")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1 and doc_id is not null").select("doc_id")
    return verdicts(with_counts(docs), train(docs, good))


QUERIES = {"op4_quality": op4_quality}
ORACLE_SQL: dict[str, str] = {}
