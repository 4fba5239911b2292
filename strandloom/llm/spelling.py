"""Spelling variants: words that differ by one code point, found in forward and reversed sorted dictionaries.

One edit leaves at least half of a word intact: with T code points left untouched (all but one of two words of equal
length, all of the shorter of two whose lengths differ by one), the words share the first ceil(T/2) or the last
ceil(T/2) of them. So every pair meets in a block of a shared prefix (forward dictionary) or of a shared suffix
(reversed dictionary). Equal lengths and lengths that differ have blocks of their own, by length.

A block of more than MOST words is subdivided: of what is not yet shared, half is intact again, next to the shared
prefix or to the shared suffix, so its words go into blocks with more of either. In the end only the edit's place is
left, and a block has one word for each letter that can stand there. Words of a common stem so never meet all at once.
A pair is verified in one block only: the one that its true common prefix leads to.

Blocks are dealt by a shuffle on their key and read there as sorted runs by a merge join; no task holds a dictionary.

Defined cases: null texts have no words, a null doc_id counts as empty text; repeated rows count each; words are
compared by code points. A table without words gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import materialize

c = F.col
LETTERS = "A-Za-zÀ-ÿ"
#: Least code points and occurrences of a word; how many times more often its form occurs.
LENGTH, TIMES, OFTENER = 7, 2, 10
#: One of so many occurrences loses a code point.
DROP = 31
#: Words of a block beyond which it is subdivided.
MOST = 48
_KEY = ["kind", "size", "head", "tail", "below"]
_FAR = 1 << 30


def words_of(docs: DataFrame, text: str = "text", length: int = LENGTH, times: int = TIMES) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z taken as a-z, with one code point gone from hashed occurrences."""
    # shorter runs cannot become words, so they are not even cut out
    runs = docs.select(F.coalesce(c("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(c(text), F.lit(f"[{LETTERS}]{{{length},}}"), F.lit(0))).alias("run"))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length("run") == F.length("run")
    runs = runs.select("id", F.when(plain, F.lower("run")).otherwise(F.translate("run", upper, upper.lower())).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (c("h") % F.length("run")).cast("int")
    word = F.when(c("h") % DROP == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(c("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(c("n") >= times)


def _side(kind: str, size: Column, intact: Column, forward: bool) -> Column:
    half = F.ceil(intact / 2).cast("int")
    head, tail = (half, F.lit(0)) if forward else (F.lit(0), half)
    below = F.lit(_FAR) if forward else half
    return F.struct(F.lit(kind).alias("kind"), size.alias("size"), head.alias("p"), tail.alias("s"), below.alias("below"), (intact - half).alias("left"))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with p and s -> the same with head and tail, the first p and the last s code points of the word."""
    return rows.withColumns({"head": F.substring("word", F.lit(1), c("p")), "tail": F.substring("word", F.length("word") - c("s") + 1, c("s"))})


def _first_blocks(words: DataFrame) -> DataFrame:
    size = F.length("word")
    sides = [_side(kind, of, intact, forward) for kind, of, intact in (("equal", size, size - 1), ("longer", size, size), ("longer", size - 1, size - 1)) for forward in (True, False)]
    return _keyed(words.select("word", "n", F.explode(F.array(*sides)).alias("b")).select("word", "n", "b.*"))


def _parts(rows: DataFrame) -> DataFrame:
    """Rows of blocks that are too large -> rows of their parts: more of the prefix is shared, or else more of the suffix."""
    half = F.ceil(c("left") / 2).cast("int")
    grown = lambda p, s, below: F.struct((c("p") + p).alias("p"), (c("s") + s).alias("s"), below.alias("below"), (c("left") - half).alias("left"))
    both = F.array(grown(half, F.lit(0), c("below")), grown(F.lit(0), half, c("p") + half))
    return _keyed(rows.select("word", "n", "kind", "size", F.explode(both).alias("b")).select("word", "n", "kind", "size", "b.*"))


def _pairs(rows: DataFrame) -> DataFrame:
    """Rows of blocks -> (word, n, other, m), each pair of near words once."""
    right = rows.select(*_KEY, c("word").alias("other"), c("n").alias("m"))
    left = rows.where((c("kind") == "equal") | (F.length("word") == c("size"))).drop("p", "s", "left")
    met = left.join(right, _KEY).where(F.when(c("kind") == "equal", c("word") < c("other")).otherwise(F.length("word") < F.length("other")))
    mine = F.substring("word", F.lit(1), c("below")) != F.substring("other", F.lit(1), c("below"))
    return met.where(mine & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other", "m")


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n), words distinct -> (word, n, other, m): each pair of words that differ by one code point, once."""
    rows, found = materialize(_first_blocks(words), "spelling-blocks"), None
    while True:
        sizes = materialize(rows.groupBy(*_KEY).agg(F.count("*").alias("words"), F.max("left").alias("rest")).where("words > 1"), "spelling-sizes")
        large = (c("words") > most) & (c("rest") > 0)
        pairs = materialize(_pairs(rows.join(sizes.where(~large).select(*_KEY), _KEY, "left_semi")), "spelling-pairs")
        found = pairs if found is None else found.unionByName(pairs)
        if not sizes.where(large).take(1):
            return found
        rows = materialize(_parts(rows.join(sizes.where(large).select(*_KEY), _KEY, "left_semi")), "spelling-blocks")


def follow(links: DataFrame, most: int) -> DataFrame:
    """(word, form) -> (word, root): where a chain of at most so many forms ends, by doubling what is followed."""
    roots = links.select("word", c("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, most))))):
        roots = materialize(roots, "spelling-roots")
        on = roots.select(c("word").alias("at"), c("root").alias("next"))
        roots = roots.join(on, c("root") == c("at"), "left").select("word", F.coalesce("next", "root").alias("root"))
    return roots


def group_variants(words: DataFrame, oftener: int = OFTENER, most: int = MOST) -> DataFrame:
    """(word, n) -> (word, form, root, n, n_near, form_n) of every word.

    form: the near word of largest n (ties: the smallest) if that is at least oftener times the word's; root: the last
    of the forms from it on, the word itself if it has none.
    """
    words = materialize(words, "spelling-words")
    near = near_words(words, most)
    both = near.unionByName(near.select(c("other").alias("word"), c("m").alias("n"), c("word").alias("other"), c("n").alias("m")))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-c("m")).alias("k"), "other")).alias("top"))
    oft = -c("top.k") >= oftener * c("n")
    best = materialize(best.select("word", "n_near", F.when(oft, c("top.other")).alias("form"), F.when(oft, -c("top.k")).alias("form_n")), "spelling-best")
    largest = words.agg(F.max("n")).first()[0] or 1
    # each form occurs so many times as often as the word before, which bounds the chain
    roots = follow(best.where("form is not null").select("word", "form"), int(math.log(largest, oftener)) + 1)
    out = words.join(best, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n")
