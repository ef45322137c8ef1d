"""Spelling variants: words one edit apart, found in the sorted rotations of all words (a permuterm index).

A word is marked with an end and rotated so that one of its letters comes last. What stands before that letter says all
but the letter itself: words whose rotations agree there differ by a replacement, and a shorter word whose whole rotation
is just that lacks the letter. So rotations are sorted by what comes before the skipped letter, and each run of equal
ones is a group of neighbours: one row for each letter of the alphabet and one shorter word at most. A pair that differs by
one letter in a run of equal ones would meet several times; only the run's first letter may be skipped then.

Rotations are rows of a key and a word's number. Numbers follow the order of the words, so that ties need no text.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from maskline.llm.common import id_and_text, release, slices
from maskline.session import materialize

#: Runs of these are words.
LETTERS = "[A-Za-zÀ-ÿ]+"
END = "$"
#: Rotations of more letters stand as two fingerprints modulo this prime, as all of their text would grow with the square.
LONG, PRIME = 64, 2**61 - 1
ROTATIONS = pa.schema([("key", pa.string()), ("whole", pa.bool_()), ("first", pa.bool_()), ("wid", pa.int64()), ("n", pa.int64())])


def lowered(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def worn_words(docs: DataFrame, wear: int) -> DataFrame:
    """(word) for each run of letters of docs (doc_id, text), A to Z lowered. Where `wear` divides the checksum of id and
    run, the letter at checksum modulo length is left out; a row without an id has the id 'null'. wear = 0 leaves all."""
    runs = id_and_text(docs).select("doc_id", F.explode(F.regexp_extract_all(lowered(F.col("text")), F.lit(LETTERS), F.lit(0))).alias("word"))
    if not wear:
        return runs.select("word")
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("word")))
    at = (F.col("h") % F.char_length("word")).cast("int")
    worn = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))
    return runs.withColumn("h", h).select(F.when(F.col("h") % wear == 0, worn).otherwise(F.col("word")).alias("word"))


def _prefixes(codes: list[int], base: int) -> tuple[list[int], list[int]]:
    sums, powers = [0], [1]
    for c in codes:
        sums.append((sums[-1] * base + c) % PRIME)
        powers.append(powers[-1] * base % PRIME)
    return sums, powers


def rotations(word: str, bases: tuple[int, int]) -> Iterator[tuple[str, bool, bool]]:
    """(rotation, is it whole, may the letter be skipped for a shorter word): for each letter the rest of the word from
    behind it round to it, then the whole rotations of the marked word."""
    n = len(word)
    tables = [(base, *_prefixes([ord(c) for c in word], base)) for base in bases] if n > LONG else []

    def key(start: int, until: int) -> str:
        if n - start + until <= LONG:
            return word[start:] + END + word[:until]
        out = []
        for base, sums, powers in tables:
            tail = (sums[n] - sums[start] * powers[n - start]) % PRIME
            out.append(((tail * base + ord(END)) * powers[until] + sums[until]) % PRIME)
        return f"{n - start + until}{END}{out[0]:x}{END}{out[1]:x}"

    for i in range(n):
        yield key(i + 1, i), False, i == 0 or word[i - 1] != word[i]
    for i in range(n + 1):
        yield key(i, i), True, False


def _sorted_rotations(words: DataFrame) -> DataFrame:
    """(key, whole, first, wid, n) for each rotation of words (wid, word, n)."""
    bases = tuple(2**32 + secrets.randbelow(2**60) for _ in range(2))  # drawn anew, so that no text can be made to collide

    def turn(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts):
            out: list[tuple] = []
            for word, wid, n in zip(*(part[c].to_pylist() for c in ("word", "wid", "n")), strict=True):
                for key, whole, first in rotations(word, bases):
                    out.append((key, whole, first, wid, n))
                    if len(out) == 1 << 14:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ROTATIONS, strict=True)], schema=ROTATIONS)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ROTATIONS, strict=True)], schema=ROTATIONS)
        release()

    return words.mapInArrow(turn, "key string, whole boolean, first boolean, wid bigint, n bigint")


def near_words(words: DataFrame) -> DataFrame:
    """(wid, n_near, best) of the words (wid, word, n) that have near ones; best is (-n, wid) of the most frequent."""
    group = W.partitionBy("key")
    order = group.orderBy("whole", "less", "wid").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    one = F.struct("less", "wid")
    scanned = _sorted_rotations(words).withColumn("less", -F.col("n")).select(
        "*",
        F.count("*").over(group).alias("size"),
        F.count_if(~F.col("whole")).over(group).alias("edited"),
        F.count_if(F.col("first")).over(group).alias("longer"),
        F.min(F.when(F.col("whole"), one)).over(group).alias("shorter"),
        F.min(F.when(F.col("first"), one)).over(group).alias("best_longer"),
        F.first(one).over(order).alias("top"),
        F.nth_value(F.struct("less", "wid", "whole"), 2).over(order).alias("next"),
    ).where("size > 1")
    # The first of the others that differ by the letter.
    replaced = F.when(F.col("top.wid") != F.col("wid"), F.col("top")).when(~F.col("next.whole"), F.struct("next.less", "next.wid"))
    skipped = F.when(F.col("first"), F.col("shorter"))
    told = scanned.select(
        "wid",
        F.when(F.col("whole"), F.col("longer")).otherwise(F.col("edited") - 1 + F.when(skipped.isNotNull(), 1).otherwise(0)).alias("near"),
        F.when(F.col("whole"), F.col("best_longer")).otherwise(F.least(replaced, skipped)).alias("best"),
    )
    return told.where("near > 0").groupBy("wid").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(wid, root) for forms (wid, form): where the forms of forms end. Steps double, and n at least doubles from a word to
    its form, so that six rounds reach the end of any chain; no more are run than are needed."""
    now = forms.select("wid", F.col("form").alias("root"))
    while True:
        further = now.select(F.col("wid").alias("root"), F.col("root").alias("next"))
        joined = materialize(now.join(further, "root", "left").select("wid", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = joined.select("wid", "root")
        if joined.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, shortest: int = 5, least: int = 3, times: int = 2, wear: int = 0) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each word of docs (doc_id, text): a run of letters with at least `shortest`
    code points that occurs `least` times.

    n_near is how many words differ from it by one inserted, deleted or replaced code point. Its form is the most frequent
    of them (ties: the first in code-point order) if that is at least `times` (2 or more) as frequent, else null; root is
    the last of the forms of forms, the word itself if there is none. Null texts have no words; repeated rows count each;
    wear is the share of worn words (`worn_words`). Other columns are ignored.
    """
    words = worn_words(docs, wear).where(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    # Numbered in order of the words: ranges come in order, and so do the rows of each.
    words = materialize(
        words.where(F.col("n") >= least).repartitionByRange("word").sortWithinPartitions("word").withColumn("wid", F.monotonically_increasing_id())
    )
    near = materialize(words.join(near_words(words), "wid").select("wid", "n", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.wid").alias("form")))
    forms = near.where(F.col("best_n") >= times * F.col("n"))
    told = near.select("wid", "n_near").join(
        forms.select("wid", "form", F.col("best_n").alias("form_n")).join(_roots(forms), "wid"), "wid", "left"
    )
    named = lambda of, name: words.select(F.col("wid").alias(of), F.col("word").alias(name))
    told = told.join(named("form", "form_word"), "form", "left").join(named("root", "root_word"), "root", "left").select(
        "wid", "n_near", F.col("form_word").alias("form"), "form_n", F.col("root_word").alias("root")
    )
    return words.join(told, "wid", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root")
    )
