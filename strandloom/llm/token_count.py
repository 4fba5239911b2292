"""Token counts of a sentence-piece BPE vocabulary by the whole-token shortcut.

A vocabulary whose pieces never hold the word mark after another character cannot merge across the
start of a word, so a text is the sequence of its pre-tokens: a run of spaces with what follows up to
the next space. Offline, once on the driver, every vocabulary string that has the form of a pre-token is
encoded by the library; those that come back as one token form the shortcut table, which is broadcast (it
is bounded by the vocabulary). Pre-tokens in the table count as one token without merging; only the others go
through the library's merges, each distinct one once for a run of texts, and once per worker as long as the
memo has room.

The proof also holds the rules that the split relies on: the library must give texts with runs of spaces,
line breaks, marks, full-width letters and spaces at either end the tokens of their pre-tokens.

Defined cases: a null text counts as empty: 0 bytes, 0 tokens. Empty text has 0 tokens. Very long texts
are processed whole. Special strings inside texts are ordinary text, as in the library's default.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import short_batches

MARK = "▁"
#: Distinct pre-tokens that a worker remembers before it starts afresh.
MEMO_ENTRIES = 400_000
#: Characters of text that are counted together.
RUN_CHARACTERS = 1_000_000
#: Texts for which the split must give the library's tokens.
PROBES = ["a", " a", "a ", "  a  b   c ", "a\nb\n\nc\t d", f"{MARK}a {MARK}{MARK}b", "ﬁ Ａｂｃ ① é e\u0301", "a\u00a0b\u3000c", "<s> </s> <unk>", "x" * 300, " ", "   ", "日本 語", "\U0001f600 \U0001f600"]


def pre_tokens(text: str) -> list[str]:
    """Split a text into pre-tokens, the first with the mark that the library puts before a text.

    Spaces stand for the mark, and the mark itself inside a text is the same as a space to the library. Each pre-token is given without its first space or mark; "" stands for a
    lone one.
    """
    parts = text.replace(MARK, " ").split(" ")
    if "" not in parts:
        return parts
    out, spaces = [], 0
    for part in parts[:-1]:
        if part:
            out.append(" " * spaces + part)
            spaces = 0
        else:
            spaces += 1
    out.append(" " * spaces + parts[-1])
    return out


def load(model_file: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_file)


def prove(model_file: str) -> list[str]:
    """The pre-tokens that the library encodes alone as one token; an error if pre-tokens cannot be counted alone."""
    library = load(model_file)
    pieces = [library.id_to_piece(i) for i in range(library.get_piece_size())]
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("the vocabulary merges across words: pre-tokens cannot be counted alone")
    shortcut = [p[1:].replace(MARK, " ") for p in pieces if p.startswith(MARK)]
    proved = library.encode(shortcut, num_threads=1)
    # a lone mark between two texts' ends cannot come from encode(""): the library gives nothing for it
    words = sorted({w for w, ids in zip(shortcut, proved, strict=True) if len(ids) == 1 and w} | {""})
    counter = Counter(library, words)
    for text in PROBES:
        if counter.counts([text]) != [len(library.encode(text))]:
            raise ValueError(f"the library does not split {text!r} as assumed")
    return words


class Counter(dict):
    """Pre-token -> number of tokens; filled from the proved table, then by the library."""

    def __init__(self, library, words: list[str]):
        super().__init__()
        self.library, self.table = library, dict.fromkeys(words, 1)
        self.update(self.table)

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; what the memo lacks goes to the library in one call."""
        split = [pre_tokens(t) if t else [] for t in texts]
        fresh = list({w for words in split for w in words}.difference(self))
        if fresh:
            self.update(zip(fresh, map(len, self.library.encode(fresh, num_threads=1)), strict=True))
        out = [sum(map(self.__getitem__, words)) for words in split]
        if len(self) > MEMO_ENTRIES:
            self.clear()
            self.update(self.table)
        else:
            for w in fresh:
                if len(w) > 64:
                    del self[w]
        return out


_counters: dict[str, Counter] = {}


def counter(model_file: str, words: list[str]) -> Counter:
    """One counter for each model and worker."""
    if model_file not in _counters:
        _counters[model_file] = Counter(load(model_file), words)
    return _counters[model_file]


def runs(texts: list[str | None]) -> Iterator[list[str]]:
    """Texts in runs of about RUN_CHARACTERS; nulls are empty."""
    held, n = [], 0
    for text in texts:
        held.append(text or "")
        n += len(held[-1])
        if n >= RUN_CHARACTERS:
            yield held
            held, n = [], 0
    if held:
        yield held


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, text: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit; input columns of these names are replaced.

    model_file must be readable under the same path on the driver and every executor.
    """
    spark = docs.sparkSession
    short_batches(spark)
    proved = spark.sparkContext.broadcast(prove(model_file))

    @F.arrow_udf("bigint")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = counter(model_file, proved.value)
        for batch in batches:
            yield pa.array([n for run in runs(batch.to_pylist()) for n in own.counts(run)], pa.int64())

    return docs.withColumns(
        {
            "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint"),
            "n_tokens": tokens(F.col(text)),
        }
    ).withColumn("over_limit", F.col("n_tokens") > limit)
