"""Spelling variants: words one edit apart, the rarer one a variant of a much commoner one.

Words are maximal runs of letters of whole texts, with A-Z in lower case, counted over all
documents.  Two words are near if exactly one inserted, deleted or replaced code point tells
them apart.  A word's form is its near word with the largest count, if that is at least
``RATIO`` times its own; following forms ends at its root.

Near words by asymmetric chunks.  A word of length L contributes two disjoint chunks, its
halves.  The other word, of length L or L - 1, contributes its positional grams of the length
of a chunk.  One edit lies in one half, so the other half is a gram of the other word, at the
same place from the front (first half) or from the end (second half), which is within shift
one.  Grams elsewhere cannot belong to one edit and are not made.  Words that share a chunk
are candidates, and their distance is verified.

A chunk that very many words share, such as a common stem, is cut further: the half that may
hold the edit has two halves again, and one of them is kept as well.  After the last cut the
words of a group agree in all but one place, so a group has at most one word for each letter.
Only groups of at most ``MOST_PAIRS`` pairs are compared, so candidates grow with the number
of words, whatever their chunks.

Noise is added on purpose before counting when ``noise`` is given: an occurrence loses a
letter if a checksum of its document and run says so, the same one each time.

Defined results: null and empty texts have no words; a null id counts as an empty one in the
checksum; repeated rows count as often as they stand; a word without near words has none as
its form and is its own root; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlog.llm.common import ascii_lower, written
from partlog.plans.bounds import at_most

LEAST_LENGTH, LEAST_COUNT = 6, 5
RATIO = 5
NOISE = 199
#: One place may hold any of 90 letters, and the shorter word has none: 90 * 91 is less.
MOST_PAIRS = 1 << 14
NAMED_GROUPS = 20_000

GROUP = ["length", "low", "high", "rest"]


def _without(word: Column, at: Column) -> Column:
    """``word`` without the code point at ``at``, from 0."""
    return F.concat(word.substr(F.lit(1), at), word.substr(at + 2, F.length(word)))


def count_words(
    docs: DataFrame,
    noise: int | None = None,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
) -> DataFrame:
    """word and n of each word that is long and common enough."""
    # Shorter runs never become words: noise only takes letters away.
    letters = F.lit(f"[a-zÀ-ÿ]{{{least_length},}}")
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), letters, F.lit(0))).alias("run"),
    )
    if noise is None:
        words = runs.select(F.col("run").alias("word"))
    else:
        check = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
        at = (F.col("check") % F.length("run")).cast("int")
        noisy = F.when(F.col("check") % noise == 0, _without(F.col("run"), at))
        words = runs.withColumn("check", check).select(F.coalesce(noisy, "run").alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    return counted.where((F.length("word") >= least_length) & (F.col("n") >= least_count))


def _grouped(rows: DataFrame) -> DataFrame:
    """Add what a word has outside the gap from ``low`` to ``high`` of a word of ``length``."""
    tail = F.col("length") - F.col("high")
    size = F.length("word")
    rest = F.concat(
        F.col("word").substr(F.lit(1), F.col("low")), F.col("word").substr(size - tail + 1, tail)
    )
    return rows.withColumn("rest", rest)


def _halves(rows: DataFrame) -> DataFrame:
    """Both halves of the gap in which the edit may be."""
    middle = F.expr("(low + high) div 2").cast("int")
    gaps = F.array(
        F.struct(middle.alias("low"), F.col("high").alias("high")),
        F.struct(F.col("low").alias("low"), middle.alias("high")),
    )
    cut = rows.select("word", "n", "length", F.explode(gaps).alias("gap"))
    return _grouped(cut.select("word", "n", "length", "gap.*"))


def _compared(rows: DataFrame) -> DataFrame:
    """Pairs (a, n_a, b, n_b) of one group that are one edit apart; a is the longer one."""
    whole = F.length("word") == F.col("length")
    a = rows.where(whole).select(*GROUP, F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = rows.select(*GROUP, F.col("word").alias("b"), F.col("n").alias("n_b"))
    ordered = (F.length("b") < F.col("length")) | (F.col("a") < F.col("b"))
    near = F.levenshtein("a", "b", 1) == 1
    return a.join(b, GROUP).where(ordered & near).select("a", "n_a", "b", "n_b")


def near_pairs(words: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Each pair (a, n_a, b, n_b) of ``words`` (word, n) that is one edit apart, once."""
    lengths = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("length")
    given = words.where("word <> ''").select("word", "n", lengths)
    rows = _halves(given.withColumn("low", F.lit(0)).withColumn("high", F.col("length")))
    found = None
    while True:
        rows = written(rows, "spelling-chunks")
        whole = F.count_if(F.length("word") == F.col("length"))
        sizes = rows.groupBy(*GROUP).agg((whole * F.count("*")).alias("pairs"))
        # A gap of one place is never cut again, whatever the alphabet of the words.
        large = (F.col("pairs") > most_pairs) & (F.col("high") - F.col("low") > 1)
        hot = written(sizes.where(large).select(*GROUP), "spelling-large")
        if hot.isEmpty():
            last = written(_compared(rows), "spelling-pairs")
            return (last if found is None else found.unionByName(last)).distinct()
        named = F.broadcast(hot) if at_most(hot, NAMED_GROUPS) else hot
        pairs = written(_compared(rows.join(named, GROUP, "left_anti")), "spelling-pairs")
        found = pairs if found is None else found.unionByName(pairs)
        rows = _halves(rows.join(named, GROUP, "left_semi"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form, by doubling the steps of each round.

    Counts grow by ``RATIO`` with each step, so there are few rounds and no circles.
    """
    roots = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        met = written(roots.join(further, "root", "left"), "spelling-steps")
        if met.where("_further is not null").isEmpty():
            return roots
        roots = met.select("word", F.coalesce("_further", "root").alias("root"))


def group_variants(
    docs: DataFrame, noise: int | None = None, ratio: int = RATIO, most_pairs: int = MOST_PAIRS
) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of ``docs``."""
    words = written(count_words(docs, noise), "spelling-words")
    pairs = written(near_pairs(words, most_pairs), "spelling-near")
    side = lambda x, y: pairs.select(
        F.col(x).alias("word"), F.col(y).alias("other"), F.col(f"n_{y}").alias("n_other")
    )
    # The smallest of (-n, word) is the largest n, and of those the first in code points.
    best = F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best")
    near = side("a", "b").unionByName(side("b", "a")).groupBy("word").agg(F.count("*").alias("n_near"), best)
    common = -F.col("best.less") >= ratio * F.col("n")
    found = written(
        words.join(near, "word", "left").select(
            "word",
            F.when(common, F.col("best.other")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(common, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
