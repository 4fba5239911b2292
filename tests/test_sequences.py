"""FASTA files without an index, by spans of bytes, against a plain reader."""

import random
import re

import pytest

from strandloom.sources import text


def plain(raw: str, size: int):
    """[(contig, chunk, sequence)] of one file."""
    out = []
    for record in re.split(r"(?m)^>", raw)[1:]:
        title, _, body = record.partition("\n")
        bases = re.sub(r"\s", "", body)
        out += [(re.split(r"\s", title)[0], i // size, bases[i : i + size]) for i in range(0, max(len(bases), 1), size)]
    return sorted(out)


def got(spark, path, size, span):
    return sorted((r.contig, r.chunk, r.sequence) for r in text.sequence_chunks(spark, str(path), size, span).collect())


def sample(seed: int) -> str:
    rng = random.Random(seed)
    parts = []
    for i in range(25):
        parts.append(f">c{i % 20} about > it{'x' * rng.choice([0, 3, 200])}\n")  # some names occur twice
        width, end = rng.choice([1, 7, 60, 5000]), rng.choice(["\n", "\r\n", "\n\n"])
        bases = "".join(rng.choices("ACGTN", k=rng.choice([0, 1, 59, 60, 61, 700])))
        parts.append("".join(bases[j : j + width] + end for j in range(0, len(bases), width)))
    return "".join(parts)


@pytest.mark.parametrize("span", [1, 13, 64, 1000, 1 << 22])
def test_spans_of_any_length_give_the_same_chunks(spark, tmp_path, span):
    raw = sample(span)[: 400 if span == 1 else None].rstrip("\n")
    (tmp_path / "a.fa").write_bytes(raw.encode())
    assert got(spark, tmp_path / "a.fa", 50, span) == plain(raw, 50)


def test_several_files_odd_and_empty_ones(spark, tmp_path):
    (tmp_path / "a.fa").write_text("\n\n>one\nACGT\n>\nGG\n>last")
    (tmp_path / "b.fa").write_text("")
    (tmp_path / "c.fa").write_text(">one\n" + "A" * 120)
    want = sorted([("one", 0, "ACGT"), ("", 0, "GG"), ("last", 0, ""), *[("one", i, "A" * 50) for i in (0, 1)], ("one", 2, "A" * 20)])
    assert got(spark, tmp_path, 50, 16) == want
    (tmp_path / "bad.fa").write_text("ACGT\n>x\nA\n")
    with pytest.raises(Exception, match="before its first header"):
        got(spark, tmp_path / "bad.fa", 50, 16)


def test_one_long_record_is_read_by_many_tasks(spark, tmp_path):
    bases = "".join(random.Random(1).choices("ACGT", k=600_000))
    for name, width in (("lines", 60), ("one", 600_000)):
        (tmp_path / f"{name}.fa").write_text(">c\n" + "\n".join(bases[i : i + width] for i in range(0, len(bases), width)))
        assert "".join(s for _, _, s in got(spark, tmp_path / f"{name}.fa", 10_000, 50_000)) == bases
