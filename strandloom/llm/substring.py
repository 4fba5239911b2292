"""Repeated passages: relative Lempel-Ziv parsing of documents against indexed reference blocks.

A window is WINDOW consecutive words of one document. Words of a window whose word sequence also starts anywhere
else (another row, or another place of the same one) are removed; all windows are judged on the input.

Which blocks a document meets: each window has an anchor, the least hash of its GRAM-word sequences (the leftmost
of equals), which depends on its words alone. So equal windows have equal anchors at equal offsets, and a window
need only be looked for in the block that holds its anchor. A phrase is what the windows of one anchor cover, at
most 2 * WINDOW - GRAM words. Anchors of a single place fall away; equal phrases of an anchor are one, with the
number of their places, so thousands of copies cost what one does.

Parsing: a reference block holds the phrases of neighbouring anchors with a suffix order over all their words. Each
phrase is factored greedily: the longest stretch from here on that occurs elsewhere in the block, then on from its
end. A factor of WINDOW words or more gives repeated windows. A repeated window holds no whole factor and the word
behind it (that factor would have been longer), so every other one lies across a single border of two factors; these
are looked up one by one.

Anchors with more than MOST phrases (a common line in ever new surroundings) would make one block of any size. Their
windows are dealt by a hash of all their words instead, and counted before the shuffle.

Defined cases: words are what white space separates, compared unchanged; null texts have no words; rows of equal id
and text are two places; texts of fewer words than a window lose nothing. Word sequences are compared by 64-bit
hashes of words within a block, and phrases of an anchor by another 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import MIX_A, MIX_B, materialize, mixed, release, short_batches, text_slices
from strandloom.llm.simhash import row_key

WINDOW = 35
GRAM = 12
#: Bytes of words of a reference block, and phrases of one anchor beyond which its windows are dealt singly.
BLOCK_BYTES, MOST = 2_500_000, 2_000
_SPACE = np.zeros(256, np.bool_)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base % 2**64))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a run of texts, and each text's offset in words."""
    inside = ~_SPACE[raw]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < len(raw)]
    opens[begins] = inside[begins]
    starts = np.flatnonzero(opens)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    letters = np.flatnonzero(inside)
    first = np.searchsorted(letters, starts)
    size = np.diff(np.append(first, len(letters)))
    place = np.arange(len(letters)) - np.repeat(first, size)
    terms = _BYTE[raw[letters]] * _powers(_BASE, int(size.max()))[place]
    return mixed(np.add.reduceat(terms, first) + size.astype(np.uint64)), np.searchsorted(starts, offsets)


def spans_of(words: np.ndarray, low: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the word sequences [low, end), wherever they lie."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_BASE, len(words)), dtype=np.uint64)])
    return mixed((total[end] - total[low]) * _powers(pow(_BASE, -1, 2**64), len(words) + 1)[low] + (end - low).astype(np.uint64))


def phrases_of(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of a run of texts: text, first and last window start, anchor and phrase hash of each anchor's place."""
    n = len(words) - WINDOW + 1
    if n < 1:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    gram = np.zeros(len(words) - GRAM + 1, np.uint64)
    for j in range(GRAM):
        gram = (gram + words[j : len(gram) + j]) * MIX_A + MIX_B
    gram = mixed(gram)
    least, span, asked = np.arange(len(gram)), 1, WINDOW - GRAM + 1
    while span < asked:  # place of the least hash in ever longer stretches, the leftmost of equals
        step = min(span, asked - span)
        left, right = least[:-step], least[step:]
        least, span = np.where(gram[right] < gram[left], right, left), span + step
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    start = np.flatnonzero(np.arange(n) + WINDOW <= at[text[:n] + 1])
    if not len(start):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    place, text = least[start], text[start]
    new = np.ones(len(start), np.bool_)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    low, high = start[first], start[np.append(first[1:], len(start)) - 1]
    return text[first], low, high, gram[place[first]], spans_of(words, low, high + WINDOW)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple]]:
    """(first row of the run, words, each row's offset in words, places of anchors)."""
    for a, _, raw, offsets in text_slices(batch.column("text").cast(pa.string())):
        words, at = words_of(raw, offsets)
        yield a, words, at, phrases_of(words, at)


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, _, found in _slices(batch):
            yield pa.RecordBatch.from_pydict({"anchor": found[3].view(np.int64)})
    release()


def _place_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, _, at, (text, low, high, anchor, phrase) in _slices(batch):
            rows = pa.array(text + a)
            numbers = [(low - at[text]).astype(np.int32), (high - low).astype(np.int32), anchor.view(np.int64), phrase.view(np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column("row_id").take(rows), batch.column("row_text").take(rows), *map(pa.array, numbers)], ["row_id", "row_text", "low", "more", "anchor", "phrase"])
    release()


def _wanted(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, int, tuple, np.ndarray, np.ndarray]]:
    """Each row with the places whose starts its 'lows' name: (row, words, offset, places, which of them, whose start is odd there)."""
    lists = batch.column("lows")
    for a, words, at, found in _slices(batch):
        cuts = np.searchsorted(found[0], np.arange(len(at)))
        for i in range(len(at) - 1):
            asked = lists[a + i].values.to_numpy()
            starts = found[1][cuts[i] : cuts[i + 1]] - at[i]
            take = np.flatnonzero(np.isin(starts, asked >> 1))
            yield a + i, words, int(at[i]), found, take + cuts[i], np.isin(starts[take], asked[asked & 1 == 1] >> 1)


def _phrase_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with 'lows', twice the start of each wanted phrase and one more if it has several places -> its words."""
    names = ["anchor", "phrase", "several", "words"]
    for batch in batches:
        for row, _, offset, (_, low, high, anchor, phrase), take, several in _wanted(batch):
            split = batch.column("text")[row].as_py().encode().split()
            texts = [b" ".join(split[low[j] - offset : high[j] - offset + WINDOW]) for j in take]
            yield pa.RecordBatch.from_arrays([pa.array(anchor[take].view(np.int64)), pa.array(phrase[take].view(np.int64)), pa.array(several), pa.array(texts, pa.binary())], names)
    release()


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with 'lows', twice the start of each wanted place -> all its windows by the hash of their words."""
    names = ["row_id", "row_text", "start", "anchor", "window"]
    for batch in batches:
        for row, words, offset, (_, low, high, anchor, _), take, _ in _wanted(batch):
            count = high[take] - low[take] + 1
            start = np.arange(int(count.sum())) + np.repeat(low[take] - np.cumsum(count) + count, count)
            own = words[offset : int(start[-1]) + WINDOW] if len(start) else words[:0]
            hashes = spans_of(own, start - offset, start - offset + WINDOW)
            rows = pa.array(np.full(len(start), row))
            yield pa.RecordBatch.from_arrays([batch.column("row_id").take(rows), batch.column("row_text").take(rows), pa.array((start - offset).astype(np.int32)), pa.array(np.repeat(anchor[take], count).view(np.int64)), pa.array(hashes.view(np.int64))], names)
    release()


def longest_elsewhere(words: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of each place in a block: how many words from there on occur elsewhere in it too.

    end: where the phrase of each place ends; matches stay within phrases.
    """
    n = len(words)
    at = np.arange(n)
    ranks, span = [np.unique(words, return_inverse=True)[1] + 1], 1
    while span < 2 * WINDOW:  # ranks of stretches of double length; a phrase's end comes before all words
        follow = np.where(at + span < end, ranks[-1][np.minimum(at + span, n - 1)], 0)
        ranks.append(np.unique(ranks[-1] * (n + 1) + follow, return_inverse=True)[1] + 1)
        span *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n - 1, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        step = 1 << k
        fits = (a + step <= end[order[:-1]]) & (b + step <= end[order[1:]])
        same = np.flatnonzero(fits)
        same = same[ranks[k][a[same]] == ranks[k][b[same]]]
        shared[same] += step
        a[same] += step
        b[same] += step
    out = np.zeros(n, np.int64)
    out[order[1:]] = shared
    np.maximum.at(out, order[:-1], shared)
    return out


def factor(first: np.ndarray, end: np.ndarray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy parse of phrases [first, end) of a block: starts and lengths of their factors, in order of place.

    A word that occurs nowhere else is a factor of its own.
    """
    starts, sizes, at = [], [], first
    while len(at):
        size = np.maximum(longest[at], 1)
        starts.append(at)
        sizes.append(size)
        going = at + size < end
        at, end = (at + size)[going], end[going]
    starts, sizes = np.concatenate(starts), np.concatenate(sizes)
    order = np.argsort(starts, kind="stable")
    return starts[order], sizes[order]


def repeated_windows(first: np.ndarray, end: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """Starts in the block of windows that occur elsewhere: those in long factors, and those across a border of two."""
    start, size = factor(first, end, longest)
    inside = np.maximum(size - WINDOW + 1, 0) * (longest[start] >= WINDOW)
    found = np.repeat(start, inside) + np.arange(int(inside.sum())) - np.repeat(np.cumsum(inside) - inside, inside)
    border = np.flatnonzero((start[1:] == start[:-1] + size[:-1]) & ~np.isin(start[1:], first))
    low = np.maximum(start[border] + 1, start[border + 1] - WINDOW + 1)
    high = np.minimum(start[border + 1] - 1, start[border + 1] + size[border + 1] - WINDOW)
    count = np.maximum(high - low + 1, 0)
    across = np.repeat(low, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return np.unique(np.concatenate([found, across[longest[across] >= WINDOW]]))


def _parse(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One reference block: phrases of whole anchors -> the runs of their windows that occur elsewhere."""
    table = pa.Table.from_batches(rows).combine_chunks()
    column = lambda name: table.column(name).combine_chunks()
    keys = np.stack([column("anchor").to_numpy(), column("phrase").to_numpy()])
    new = np.ones(keys.shape[1], np.bool_)
    new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)  # a repeated row gives its phrase twice
    table, keys = table.filter(pa.array(new)), keys[:, new]
    several = column("several").to_numpy(zero_copy_only=False)
    texts = column("words").cast(pa.string())
    parts = [words_of(raw, offsets) for _, _, raw, offsets in text_slices(texts, 1 << 30)]
    words, at = parts[0]
    end = np.repeat(at[1:], np.diff(at))
    longest = longest_elsewhere(words, end)
    # a phrase of several places occurs elsewhere as a whole
    copied = np.repeat(several, np.diff(at))
    longest[copied] = (end - np.arange(len(end)))[copied]
    found = repeated_windows(at[:-1], at[1:], longest)
    new = np.ones(len(found), np.bool_)
    owner = np.searchsorted(at, found, side="right") - 1
    new[1:] = (found[1:] != found[:-1] + 1) | (owner[1:] != owner[:-1])
    low = np.flatnonzero(new)
    high = np.append(low[1:], len(found)) - 1
    own = owner[low]
    return pa.RecordBatch.from_pydict({"anchor": keys[0][own], "phrase": keys[1][own], "skip": (found[low] - at[own]).astype(np.int32), "upto": (found[high] - at[own]).astype(np.int32)}) if len(low) else None


def _block_batches(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Phrases sorted by anchor -> runs; a block is closed where an anchor ends once it has so many bytes of words."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        anchors = batch.column("anchor").to_numpy()
        opens = np.flatnonzero(np.concatenate([[last is None or anchors[0] != last], anchors[1:] != anchors[:-1]]))
        bytes_ = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column("words")).to_numpy())])
        begin, last = 0, anchors[-1]
        for at in opens:
            if size + bytes_[at] - bytes_[begin] >= block_bytes:
                held.append(batch.slice(begin, at - begin))
                if (out := _parse(held)) is not None:
                    yield out
                held, size, begin = [], 0, at
        held.append(batch.slice(begin))
        size += bytes_[-1] - bytes_[begin]
    if held and (out := _parse(held)) is not None:
        yield out
    release()


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, marks: [(start, upto)]) -> (row, cuts): ends of the stretches of covered words, low and high in turn."""
    for batch in batches:
        cuts = []
        for marks in batch.column("marks"):
            starts, uptos = (marks.values.field(i).to_numpy().astype(np.int64) for i in (0, 1))
            order = np.argsort(starts, kind="stable")
            low, high = starts[order], np.maximum.accumulate(uptos[order] + WINDOW)
            new = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
            cuts.append(np.stack([low[new], high[np.append(new[1:], len(low)) - 1]], axis=1).ravel().astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("row_text"), pa.array(cuts, pa.list_(pa.int32()))], ["row_id", "row_text", "cuts"])
    release()


def _kept_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        for text, cuts in zip(batch.column("text"), batch.column("cuts"), strict=True):
            words = (text.as_py() or "").encode().split()
            left, cuts = [], cuts.as_py() or []
            for low, high in zip([0, *cuts[1::2]], [*cuts[::2], len(words)], strict=True):
                left += words[low:high]
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left))
        out = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "n_removed", "kept"])
    release()


def shared_places(rows: DataFrame) -> DataFrame:
    """(row_id, row_text, low, more, anchor, phrase) of all places of anchors that have several."""
    shared = rows.select("text").mapInArrow(_anchor_batches, "anchor bigint").groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    places = rows.mapInArrow(_place_batches, "row_id bigint, row_text bigint, low int, more int, anchor bigint, phrase bigint")
    return materialize(places.join(materialize(shared, "substring-anchors"), "anchor", "left_semi"), "substring-places")


def repeats(rows: DataFrame, most: int = MOST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row_id, row_text, text) -> (row_id, row_text, cuts): the stretches of words that repeated windows cover."""
    places = shared_places(rows)
    at = F.min(F.struct("row_id", "row_text", "low")).alias("at")
    phrases = materialize(places.groupBy("anchor", "phrase").agg(F.count("*").alias("n"), at), "substring-phrases")
    large = materialize(phrases.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > most).select("anchor"), "substring-large")
    of_row = lambda found, low: found.groupBy("row_id", "row_text").agg(F.collect_list(low.cast("int")).alias("lows"))

    blocks = phrases.join(large, "anchor", "left_anti").select("at.*", "n")
    asked = materialize(of_row(blocks, 2 * F.col("low") + (F.col("n") > 1).cast("int")), "substring-asked")
    texts = rows.join(asked, ["row_id", "row_text"]).select("text", "lows").mapInArrow(_phrase_batches, "anchor bigint, phrase bigint, several boolean, words binary")
    dealt = texts.repartition("anchor").sortWithinPartitions("anchor", "phrase")
    runs = materialize(dealt.mapInArrow(lambda batches: _block_batches(batches, block_bytes), "anchor bigint, phrase bigint, skip int, upto int"), "substring-runs")
    marks = places.join(runs, ["anchor", "phrase"]).select("row_id", "row_text", (F.col("low") + F.col("skip")).alias("start"), (F.col("low") + F.col("upto")).alias("upto"))

    if large.take(1):
        asked = materialize(of_row(places.join(large, "anchor", "left_semi"), 2 * F.col("low")), "substring-asked")
        windows = rows.join(asked, ["row_id", "row_text"]).select("row_id", "row_text", "text", "lows").mapInArrow(_window_batches, "row_id bigint, row_text bigint, start int, anchor bigint, window bigint")
        windows = materialize(windows, "substring-windows")
        several = materialize(windows.groupBy("anchor", "window").agg(F.count("*").alias("n")).where("n > 1").select("anchor", "window"), "substring-several")
        marks = marks.unionByName(windows.join(several, ["anchor", "window"], "left_semi").select("row_id", "row_text", "start", F.col("start").alias("upto")))

    of_rows = marks.groupBy("row_id", "row_text").agg(F.collect_list(F.struct("start", "upto")).alias("marks"))
    return materialize(of_rows.mapInArrow(_merge_batches, "row_id bigint, row_text bigint, cuts array<int>"), "substring-cuts")


def remove_repeats(docs: DataFrame, text: str = "text", most: int = MOST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row of docs; kept: the words left, joined by one space, as UTF-8."""
    short_batches(docs.sparkSession)
    rows = docs.select("doc_id", *row_key(F.col("doc_id"), F.col(text)), F.col(text).cast("string").alias("text"))
    cuts = repeats(rows.drop("doc_id"), most, block_bytes)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.join(cuts, ["row_id", "row_text"], "left").select("doc_id", "text", "cuts").mapInArrow(_kept_batches, f"doc_id {kind}, n_words bigint, n_removed bigint, kept binary")
