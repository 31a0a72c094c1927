"""How filters interact: what each removes in every order, from the counts of what documents fail.

A document fails a set of the filters, its mask. A part's removal polynomial is the multilinear extension of
"documents removed by a set of filters": with x_i the probability that filter i is used, the number of documents that fall. It
follows from the counts of masks alone. Its corners (all x_i 0 or 1) are what a set of filters removes; a filter's Shapley
value is the integral of its partial derivative along the diagonal.
"""

from __future__ import annotations

import itertools
import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, looked_up, written

#: The five filters, in the order of the bits of a mask: few words, repeated words, capitals, marks, copies.
FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT = 100, 80, 10
COUNTS = ("docs", "good", "toxic")
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


class RemovalPolynomial:
    """sum over sets T of filters, none empty, of coef[T] * product of x_i for i in T."""

    def __init__(self, counts: dict[int, int], k: int):
        """counts: mask -> documents with that mask; k filters."""
        self.k = k
        failing_all = [counts.get(m, 0) for m in range(1 << k)]
        for i in range(k):  # sums over supersets: documents that fail all of T
            for m in range(1 << k):
                if not m >> i & 1:
                    failing_all[m] += failing_all[m | 1 << i]
        self.coef = [0] + [failing_all[m] * (-1) ** (m.bit_count() + 1) for m in range(1, 1 << k)]

    def corner(self, used: int) -> int:
        """What the filters of a set remove together."""
        total, part = 0, used
        while part:
            total += self.coef[part]
            part = (part - 1) & used
        return total

    def derivative(self, i: int) -> list[int]:
        """Partial derivative by x_i where all x are t, as coefficients of 1, t, t^2, ..."""
        out = [0] * self.k
        for m in range(1 << self.k):
            if m >> i & 1:
                out[m.bit_count() - 1] += self.coef[m]
        return out

    def shapley(self, i: int) -> Fraction:
        """Mean over all orders of what filter i removes: the integral of the derivative from 0 to 1."""
        return sum((Fraction(c, d + 1) for d, c in enumerate(self.derivative(i))), Fraction(0))


def audit_part(counts: dict[int, tuple[int, int, int]], letters: str = FILTERS) -> list[tuple]:
    """Rows (filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of one part.

    counts: mask -> number of documents, of good and of toxic ones.
    """
    k = len(letters)
    docs, good, toxic = (RemovalPolynomial({m: c[j] for m, c in counts.items()}, k) for j in range(3))
    total = sum(c[0] for c in counts.values())
    gone = {p: [p.corner(m) for m in range(1 << k)] for p in (docs, good, toxic)}
    sums = [p * math.factorial(k) for p in map(docs.shapley, range(k))]
    assert all(s.denominator == 1 for s in sums)
    rows = []
    for order in itertools.permutations(range(k)):
        used = 0
        for step, i in enumerate(order, 1):
            now, alone = used | 1 << i, 1 << i
            removed, good_lost, toxic_lost = (gone[p][now] - gone[p][used] for p in (docs, good, toxic))
            unique = counts.get(alone, (0, 0, 0))[0]
            rows.append(("".join(letters[j] for j in order), step, total - gone[docs][now], removed, gone[docs][alone] - removed, unique, good_lost, toxic_lost, int(sums[i])))
            used = now
    return rows


def conditions(text: str, words: str) -> dict[str, Column]:
    """What a text fails by itself, A to D. text: a column that is never null; words: its words."""
    n_words, n_distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.regexp_count(F.col(text), F.lit("[A-Z]")).cast("long")
    return {
        "A": n_words < MIN_WORDS,
        "B": 100 * n_distinct < DISTINCT_PERCENT * n_words,
        "C": 100 * capitals > CAPITALS_PERCENT * F.length(text).cast("long"),
        "D": F.col(text).rlike("[#$%&*|]"),
    }


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) for every row of docs.

    docs: doc_id, text, lang; labels: doc_id, quality, toxic; other columns are ignored. Texts are compared by SHA-256: one
    pass counts copies (partly before they are shuffled, so a text that a third of all documents share is no matter),
    and only texts that occur more than once are looked up.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bits = [F.when(failed, 1 << FILTERS.index(f)).otherwise(0) for f, failed in conditions("text", "words").items()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = written(rows.select("doc_id", "part", sum(bits[1:], bits[0]).alias("own"), F.unhex(F.sha2("text", 256)).alias("digest")), "judged")
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = looked_up(rows, written(copies, "copies"), "digest")
    mask = F.col("own") + F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    rows = rows.select("doc_id", "part", mask.alias("mask"))
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    flags = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null and (quality = 1 or toxic = 1)")
    rows = looked_up(rows, written(flags.groupBy("doc_id").agg(flag("quality"), flag("toxic")), "flags"), "doc_id")
    return rows.select("part", "mask", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def audit(judged: DataFrame, letters: str = FILTERS) -> DataFrame:
    """For each part, order of the filters and step: what is kept, removed and lost (see `filter_audit`).

    judged: part, mask (bit i: fails letters[i]), good and toxic (0 or 1). Only counts of masks, 2^k a part at most, meet in one task.
    """
    counts = judged.groupBy("part", "mask").agg(F.count("*").alias("docs"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    names = [c.split()[0] for c in RESULT.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        columns = [table.column(c).to_pylist() for c in ("mask", *COUNTS)]
        rows = audit_part({m: c for m, *c in zip(*columns, strict=True)}, letters)
        kinds = [pa.string(), pa.int32()] + [pa.int64()] * 7
        return pa.table([pa.array([part] * len(rows), pa.string()), *(pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    return counts.groupBy("part").applyInArrow(run, RESULT)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters A to E in all 120 orders: one row for each part (lang, null as ''), order and step.

    kept: documents left after the step; removed: what the step's filter takes; redundant: what fails it but went earlier; unique_fails:
    what fails it alone; good_lost, toxic_lost: of the removed, those labelled quality = 1 and toxic = 1; shapley: the filter's removed
    documents, summed over all orders. A null text is an empty one (it fails A, and E after another); a null id is no smaller and has no
    smaller one; rows that repeat an id and its text are not copies of each other; an id with several labels counts as good or toxic
    if one says so. Every row of docs counts. An empty table has no parts.
    """
    return audit(judge(docs, labels))
