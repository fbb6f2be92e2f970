"""Grouping of spelling variants: words one edit apart, each following its commoner form.

Words are found, counted and compared by Spark's own functions. A word's mask has two bits
a letter, the parities of half its count rounded up and rounded down: together the letter's
parity and one bit more. Adding or taking away one letter flips exactly one of the two, so
one edit flips at most two bits of the mask. The bits are split into three bands of about
equal entropy; two flips leave at least one band as it was, so words one edit apart agree
in a band, and their lengths differ by at most one.

Masks meet, not words: words of one mask and length are one row of the band join, which is
an equi-join on band and length, and a pair counts only in its first equal band. Pairs of
masks at the right distance bring their words together, and the edit distance verifies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, required

RUN = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Slots of two bits: one a letter, and six that other letters share by their number.
SLOTS = [*_LOWER, *["[" + "".join(chr(c) for c in range(0xC0, 0x100) if c % 6 == k) + "]" for k in range(6)]]
#: One run in so many loses a letter; least code points and occurrences of a word, and how much commoner a form is.
PERIOD, LEAST_LENGTH, LEAST_N, FACTOR = 199, 6, 5, 5


def words(docs: DataFrame, period: int = PERIOD, length: int = LEAST_LENGTH, least: int = LEAST_N) -> DataFrame:
    """(word, n) of ``docs(doc_id, text)``: runs of letters, one in ``period`` without one of its letters."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")).where(F.length("run") >= length)
    ascii_ = F.octet_length("run") == F.length("run")
    runs = runs.withColumn("run", F.when(ascii_, F.lower("run")).otherwise(F.translate("run", _UPPER, _LOWER)))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % period == 0, cut).otherwise(F.col("run"))
    every = runs.withColumn("h", h).select(word.alias("word")).where(F.length("word") >= length)
    return every.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def mask(word: Column) -> Column:
    """The word's letter counts as 64 bits, two a slot, of which one more or less flips one."""
    bits = F.lit(0).cast("long")
    for k, slot in enumerate(SLOTS):
        taken = F.replace(word, F.lit(slot)) if len(slot) == 1 else F.regexp_replace(word, slot, "")
        n = F.length(word) - F.length(taken)
        two = (F.shiftright(n + 1, 1) % 2) + (F.shiftright(n, 1) % 2) * 2
        bits = bits.bitwiseOR(F.shiftleft(two.cast("long"), 2 * k))
    return bits


def bands(classes: DataFrame) -> list[int]:
    """Three masks that split the 64 bits, so that each band has about a third of their entropy.

    What reaches the driver is one row of 64 sums, however many words there are.
    """
    n, *ones = classes.agg(F.count(F.lit(1)), *[F.sum(F.getbit("mask", F.lit(k)).cast("long")) for k in range(64)]).first()
    shares = [(x or 0) / max(n, 1) for x in ones]
    entropy = [-sum(p * math.log2(p) for p in (s, 1 - s) if p > 0) for s in shares]
    out, filled = [0, 0, 0], [0.0, 0.0, 0.0]
    for k in sorted(range(64), key=lambda k: -entropy[k]):
        least = filled.index(min(filled))
        out[least] |= 1 << k
        filled[least] += entropy[k]
    return [b - (1 << 64) if b >> 63 else b for b in out]


def near(counted: DataFrame) -> DataFrame:
    """(left_id, right_id) of words exactly one edit apart, each pair once.

    ``counted(id, word, mask, size)``.
    """
    classes = materialize(counted.groupBy("mask", "size").agg(F.bool_or(F.octet_length("word") > F.length("word")).alias("accents")), "classes")
    split = bands(classes)
    banded = lambda rows, length: rows.select("mask", "size", F.posexplode(F.array(*[F.col("mask").bitwiseAND(F.lit(b).cast("long")) for b in split])).alias("band", "bits"), length)
    left = banded(classes.withColumn("meets", F.explode(F.array("size", F.col("size") - 1))), F.col("meets"))
    right = banded(classes, F.col("size").alias("meets"))
    l, r = left.alias("l"), right.alias("r")  # noqa: E741
    apart = F.col("l.mask").bitwiseXOR(F.col("r.mask"))
    same = F.col("l.size") == F.col("r.size")
    close = F.when(same, (F.bit_count(apart) == 2) & (F.col("l.mask") < F.col("r.mask"))).otherwise(F.bit_count(apart) == 1)
    first = F.lit(True)
    for k, b in enumerate(split[:2]):  # not equal in an earlier band
        first = first & ((F.col("l.band") <= k) | (apart.bitwiseAND(F.lit(b).cast("long")) != 0))
    on = (F.col("l.band") == F.col("r.band")) & (F.col("l.bits") == F.col("r.bits")) & (F.col("l.meets") == F.col("r.meets"))
    met = l.join(r, on & close & first).select(*[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "lr" for c in ("mask", "size")])
    # Letters of one slot may replace each other and leave the mask as it is.
    own = classes.where("accents").select(*[F.col(c).alias(f"{s}_{c}") for s in "lr" for c in ("mask", "size")])
    side = lambda s: counted.select(F.col("id").alias(f"{s}_id"), F.col("word").alias(f"{s}_word"), F.col("mask").alias(f"{s}_mask"), F.col("size").alias(f"{s}_size"))
    pairs = met.unionByName(own).join(side("l"), ["l_mask", "l_size"]).join(side("r"), ["r_mask", "r_size"])
    twice = (F.col("l_mask") == F.col("r_mask")) & (F.col("l_size") == F.col("r_size")) & (F.col("l_word") >= F.col("r_word"))
    return pairs.where(~twice & (F.levenshtein("l_word", "r_word", 1) == 1)).select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms(word, form)``: the last form reached, by pointer doubling.

    Forms grow commoner by a factor at each step, so a handful of rounds suffices; a
    written table ends the lineage of each. No form has very many words one edit from it.
    """
    at = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        further = materialize(at.join(step, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        discard(at)
        at = further
        if at.where("moved").isEmpty():
            return at.select("word", "root")


def spelling_variants(docs: DataFrame, period: int = PERIOD, length: int = LEAST_LENGTH, least: int = LEAST_N, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs(doc_id, text)``.

    ``form`` is the commonest word one edit away, the first in code-point order of equals,
    where it is at least ``factor`` times as common; else null. ``root`` is the end of the
    chain of forms. Null texts have no words; a null doc_id is written as nothing before the
    colon; rows that repeat count as often as they stand; an empty table gives an empty
    result, and other columns are ignored.
    """
    base = required(docs, "doc_id", "text")
    found = words(base, period, length, least).withColumns({"mask": mask(F.col("word")), "size": F.length("word"), "id": F.monotonically_increasing_id()})
    counted = materialize(found, "words")
    pairs = materialize(near(counted), "near")
    both = pairs.unionByName(pairs.select(F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id")))
    other = both.join(counted.select(F.col("id").alias("right_id"), (-F.col("n")).alias("less"), "word"), "right_id")
    best = other.groupBy(F.col("left_id").alias("id")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct("less", "word")).alias("best"))
    common = F.coalesce(-F.col("best.less") >= factor * F.col("n"), F.lit(False))
    shaped = counted.join(best, "id", "left").select("word", F.when(common, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(common, -F.col("best.less")).alias("form_n"))
    table = materialize(shaped, "variants")
    discard(pairs, counted)
    ends = roots(table.where("form IS NOT NULL"))
    return table.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
