"""Spelling variants: words one edit apart, found in forward and reversed sorted dictionaries.

One inserted, deleted or replaced code point leaves one half of a word intact. So
each word stands in a forward dictionary under its first half and in a reversed
one under its last half; words near each other share a block of one of the two.
Blocks are ranges of the sorted keys, which a sort-merge join of the dictionary
with itself scans. A block of more than ``BLOCK`` words is subdivided: the edit
lies in one half of what the block leaves open, so the words share another
quarter, eighth and so on, before or behind it. At the last step one place is
open, and all words of a block are near each other.

Replacements and insertions have blocks of their own, by the length of the
shorter word. A pair meets once: in the block that leaves its place of edit open
(of several such places, as of a doubled letter, the last). Everything is
DataFrame expressions; nothing passes the driver but counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentrail.llm.common import hashed, settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a block beyond which it is subdivided.
BLOCK = 128


def noisy(run: Column, id_column: Column, rate: int) -> Column:
    """``run`` without one code point, where ``rate`` divides the crc32 of ``<id>:<run>``; whole where the id is null."""
    h = F.crc32(F.concat(id_column.cast("string"), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(F.pmod(h, F.lit(rate)) == 0, cut).otherwise(run)


def dictionary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2, rate: int = 31) -> DataFrame:
    """``word, n``: the words of whole texts with at least ``least_length`` code points and ``least_count`` occurrences.

    Words are maximal runs of letters, A-Z lower-cased; ``rate`` as in ``noisy``.
    Shorter runs are passed over by the pattern: none of them can be a word.
    """
    pattern = f"[a-z\\u00C0-\\u00FF]{{{least_length},}}"
    runs = docs.select(F.col(id_col).alias("id"), F.explode(F.regexp_extract_all(F.translate(text_col, UPPER, LOWER), F.lit(pattern), F.lit(0))).alias("run"))
    words = runs.select(noisy(F.col("run"), F.col("id"), rate).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _key() -> Column:
    """What a block's words share: all but the places from ``lo`` to ``hi`` of the shorter word (and the one behind it, for insertions).

    The start of the word as the forward dictionary has it, then that of the reversed one.
    """
    behind = F.greatest(F.col("c") - F.col("hi") + F.col("longer"), F.lit(0))
    return F.concat_ws("|", F.substring("word", F.lit(1), F.col("lo")), F.substring(F.reverse("word"), F.lit(1), behind), "c", "longer")


def _placed(words: DataFrame) -> DataFrame:
    """Each word by the halves that it keeps: among words of its length (longer = 0), and of its length and the next or the last (longer = 1)."""
    size = F.length("word")
    roles = F.array(*(F.struct((size - F.lit(s)).alias("c"), F.lit(k).alias("longer"), F.lit(bool(s)).alias("is_longer")) for k, s in ((0, 0), (1, 0), (1, 1))))
    of = words.select("word", "n", F.explode(roles).alias("r")).select("word", "n", "r.*").withColumn("places", F.col("c") + F.col("longer"))
    half = F.floor(F.col("places") / 2).cast("int")
    halves = F.array(F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), F.col("places").alias("hi")))
    return of.withColumn("s", F.explode(halves)).select("word", "n", "c", "longer", "is_longer", "s.lo", "s.hi").where("hi > lo").withColumn("key", _key())


def _subdivided(members: DataFrame) -> DataFrame:
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi")))
    return members.withColumn("s", F.explode(halves)).select("word", "n", "c", "longer", "is_longer", "s.lo", "s.hi").withColumn("key", _key())


def _met(members: DataFrame) -> DataFrame:
    """Pairs of a block that are one edit apart, where this block leaves the place of the edit open: the words differ before ``hi``."""
    x, y = members.alias("x"), members.alias("y")
    order = F.when(F.col("x.longer") == 0, F.col("x.word") < F.col("y.word")).otherwise(~F.col("x.is_longer") & F.col("y.is_longer"))
    here = F.substring("x.word", F.lit(1), F.col("x.hi")) != F.substring("y.word", F.lit(1), F.col("y.hi"))
    near = x.join(y, (F.col("x.key") == F.col("y.key")) & order & here & (F.levenshtein("x.word", "y.word", 1) == 1))
    return near.select(F.col("x.word").alias("a"), F.col("x.n").alias("n_a"), F.col("y.word").alias("b"), F.col("y.n").alias("n_b"))


def near_pairs(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """``a, n_a, b, n_b``: each pair of distinct words (``word``, ``n``) that are one edit apart, once. ``words`` must not repeat a word."""
    members, found = _placed(words), None
    while True:
        sizes = members.groupBy("key").agg(F.count("*").alias("size"), F.max(F.col("hi") - F.col("lo")).alias("open"))
        # A block with one place open is all near pairs, of an alphabet's size at most; a word alone in a block meets none.
        sizes = settle(sizes.where("size > 1").select("key", ((F.col("size") > block) & (F.col("open") > 1)).alias("wide")))
        counts = {row["wide"]: row["count"] for row in sizes.groupBy("wide").count().collect()}
        if counts.get(False):
            part = settle(_met(members.join(hashed(sizes.where("not wide").select("key"), counts[False]), "key", "left_semi")))
            found = part if found is None else found.unionAll(part)
        if not counts.get(True):
            break
        members = _subdivided(settle(members.join(hashed(sizes.where("wide").select("key"), counts[True]), "key", "left_semi")))
    return found if found is not None else _met(members).limit(0)


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where following ``form`` ends. Each step multiplies the count, so paths are short; each round doubles the steps taken."""
    now = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = settle(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not after.where("moved").limit(1).count():
            return after.select("word", "root")
        now = after.select("word", "root")


def spelling_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_count: int = 2, ratio: int = 10, rate: int = 31, block: int = BLOCK) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``dictionary``.

    A word's ``form`` is its near word of largest ``n`` (ties: the smallest in
    code-point order), if that is at least ``ratio`` times its own; ``root`` is
    where forms end (the word itself, without one).

    Defined cases: null and empty texts have no words; runs of any length are
    taken whole; rows that repeat an id are counted each; rows without an id keep
    all letters; other columns are not looked at, whatever their names; an empty
    table gives no rows.
    """
    words = settle(dictionary(docs, id_col=id_col, text_col=text_col, least_length=least_length, least_count=least_count, rate=rate))
    pairs = near_pairs(words, block)
    ways = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))
    near = pairs.select(F.explode(ways).alias("p")).select("p.*")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    has = -F.col("best.minus") >= ratio * F.col("n")
    formed = settle(
        words.join(best, "word", "left")
        .select("word", F.when(has, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, -F.col("best.minus")).alias("form_n"))
    )
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
