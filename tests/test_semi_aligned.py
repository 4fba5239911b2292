"""Reads whose clipped edge disagrees with the reference: brute force on odd reads, long edges, and no rows written between."""

import os
import random
import re
import time

from pyspark.sql import functions as F

from strandloom.operators import shortreads

READ = """ord bigint, contig string, start bigint, end bigint, cigar string, seq string, qual string, sa string, mc string, mate_contig string, mate_start bigint, query_length bigint,
    is_paired boolean, is_unmapped boolean, mate_unmapped boolean, is_reverse boolean, is_supplementary boolean, left_reference string, right_reference string"""


def match(a, b):
    return a == "N" or b == "N" or a.upper() == b.upper()


def mismatch(sequence, reference, contiguous=5):
    run = 0
    for i, (a, b) in enumerate(zip(sequence or "", reference or "")):
        run = run + 1 if match(a, b) else 0
        if run == contiguous:
            return i + 1 - contiguous
    return -1


def spoilt(r, sequence, n):
    """The sequence with other bases in n places from its start on, some letters in lower case or unknown."""
    out = ["ACGT"[("ACGT".index(x.upper()) + 1) % 4] if i < n and x.upper() in "ACGT" else x for i, x in enumerate(sequence)]
    return "".join(r.choice((x, x, x.lower(), "N" if r.random() < 0.05 else x)) for x in out)


def letters(r, n):
    return "".join(r.choice("ACGTACGTacgtNn") for _ in range(n))


def test_edges_by_brute_force(spark):
    r = random.Random(4)
    near = shortreads.NEAR
    pairs = []
    for _ in range(400):
        sequence = letters(r, r.choice((0, 1, 4, 5, 6, 30, near - 1, near, near + 1, near + 5, 3 * near)))
        reference = spoilt(r, sequence, r.choice((0, 1, 29, 30, near - 5, near - 4, near - 1, near, near + 1, 2 * near)))
        cut = r.choice((0, 0, 3, near))
        pairs.append((sequence[cut:], reference) if r.random() < 0.5 else (sequence, reference[: len(reference) - cut]))
    pairs += [("", ""), ("A", "A"), ("ACGTA", "ACGTA"), ("aé€𐍈x", "AÉ€𐍈X"), (None, None), ("ACGTACGT", None), (None, "ACGTACGT")]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    for contiguous in (1, 5):
        got = {x.i: x.at for x in rows.select("i", shortreads.edge_mismatch(F.col("a"), F.col("b"), contiguous).alias("at")).collect()}
        assert got == {i: mismatch(a, b, contiguous) for i, (a, b) in enumerate(pairs)}


def test_a_long_edge_takes_time_by_its_length(spark):
    # by places in the string each letter cost a walk of its own: 67 s for these rows, 1.3 s now
    n = 40_000
    rows = spark.range(0, 4, 1, 4).select(F.repeat(F.lit("AC"), F.lit(n // 2)).alias("a"), F.concat(F.repeat(F.lit("G"), F.lit(n - 5)), F.lit("ACACA")).alias("b"), F.repeat(F.lit("I"), F.lit(n)).alias("q"))
    began = time.time()
    got = rows.select(shortreads.edge_mismatch(F.reverse("a"), F.col("b")).alias("x"), shortreads.edge_mismatch(F.col("a"), F.repeat(F.lit("G"), F.lit(n))).alias("y"), shortreads.good_share(F.col("q"), F.lit(n)).alias("z")).collect()
    assert [tuple(x) for x in got] == [(n - 5, -1, True)] * 4
    assert time.time() - began < 20


def overlapping(read):
    if not read["is_paired"] or read["is_unmapped"] or read["mate_unmapped"] or read["contig"] != read["mate_contig"]:
        return False
    start, end, mate = read["start"], read["end"], read["mate_start"]
    if read["mc"] is not None:
        return start < mate + sum(int(n) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", read["mc"]) if op in "MDN=X") and mate < end
    return start <= mate < end or mate <= start < mate + read["query_length"]


def candidates(read, least=30, offset=100, length=5000):
    if read["sa"] is not None or not read["seq"] or read["is_unmapped"] or read["cigar"] is None:
        return []
    ops = [(int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", read["cigar"])]
    left = ops[0][0] if ops and ops[0][1] == "S" else 0
    right = ops[-1][0] if len(ops) > 1 and ops[-1][1] == "S" else 0
    seq, qual = read["seq"], read["qual"]
    leading = max(0, mismatch(seq, read["left_reference"])) if left else 0
    trailing = max(0, mismatch(seq[::-1], read["right_reference"])) if right else 0
    if leading + trailing >= len(seq):
        return []
    good = lambda q, n: q is None or sum(ord(x) - 33 >= 20 for x in q[:n]) >= n * 0.8
    free = not overlapping(read) or read["is_supplementary"]
    found = []
    if leading >= least and (free or not read["is_reverse"]) and good(qual, leading):
        found.append(("leading", read["start"] - left + leading, leading, trailing))
    if trailing >= least and (free or read["is_reverse"]) and good(qual and qual[::-1], trailing):
        found.append(("trailing", read["end"] + right - trailing, leading, trailing))
    end = lambda at: (max(0, at - offset), min(length, at + offset) if read["contig"] == "c1" else at + offset)
    return [(read["ord"], edge, left, right, a, b, *end(at), *end(at)) for edge, at, a, b in found]


def test_reads_by_brute_force_and_nothing_is_written(spark):
    r = random.Random(7)
    names = [part.split()[0] for part in READ.split(",")]
    reads = []
    for i in range(600):
        seq = letters(r, r.choice((60, 120, 120, 200)))
        left, right = spoilt(r, seq, r.choice((0, 10, 29, 30, 31, 50, 70))), spoilt(r, seq[::-1], r.choice((0, 29, 30, 40, 66, 90)))
        start = r.randrange(0, 5000)
        cigar = r.choice(("40S80M", "80M40S", "40S40M40S", "120M", "5H30S90M", "30S", "0S120M", "60M5I20S60M", "40S80M30N40S3H", "*", None))
        seq = r.choice((seq, seq, seq, seq, seq, None))
        qual = r.choice((None, "".join(r.choice("I5III#") for _ in seq or ""), "I" * len(seq or ""), "I" * 20))
        reads.append((i, r.choice(("c1", "c1", "c2")), start, start + 120, cigar, seq, qual, r.choice((None, None, None, "c2,5,+,30M,60,0;")), r.choice((None, "100M", "20S60M40D")), r.choice(("c1", "c2", None)), start + r.randrange(-200, 200), 120,
                      r.random() < 0.9, r.random() < 0.1, r.random() < 0.1, r.random() < 0.5, r.random() < 0.1, r.choice((left, left, left, left[:40], None)), right))
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/strandloom"
    held = lambda: set(os.listdir(folder.removeprefix("file:"))) if os.path.isdir(folder.removeprefix("file:")) else set()
    before = held()
    lengths = spark.createDataFrame([("c1", 5000)], "contig string, length bigint")
    found = shortreads.semi_aligned(spark.createDataFrame(reads, READ), lengths).select("ord", "edge", "a.softclip_left", "a.softclip_right", "leading", "trailing", "bp1_begin", "bp1_end", "bp2_begin", "bp2_end")
    got = sorted(tuple(x) for x in found.collect())
    wanted = sorted(x for read in reads for x in candidates(dict(zip(names, read))))
    assert got == wanted and len({x[1] for x in wanted}) == 2
    assert held() == before
