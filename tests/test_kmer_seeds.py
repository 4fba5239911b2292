"""Occurrences of wanted k-mers found by seeds against a plain search; the panel reads its reads once."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from jobs import kmer_panel
from jobs.common import load_config
from strandloom.functions import kmers


def some_texts(seed):
    r = random.Random(seed)
    texts = ["".join(r.choices("acgT" if i % 3 else "acgtNü€😀", k=r.choice([0, 1, 20, 31, 32, 158, 159, 700, 2100]))) for i in range(60)]
    return [*texts, "".join(r.choices("ACGT", k=17_000)), "ü" + "".join(r.choices("ACGT", k=17_000)), "acgt" * 90, None]


@pytest.mark.parametrize("k", [1, 4, 21, 31])
@pytest.mark.parametrize("limit", [1_000_000, 1])
def test_wanted_rows_are_all_occurrences(spark, monkeypatch, k, limit):
    texts, r = some_texts(k), random.Random(k)
    plain = lambda t: [t[i : i + k].translate(kmers_upper) for i in range(len(t) - k + 1)] if t else []
    kmers_upper = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    every = [(i, x) for i, t in enumerate(texts) for x in plain(t) if "N" not in x]
    wanted = {x for _, x in r.sample(every, min(len(every), 300))} | {x for t in (texts[-4][-k - 3 :], texts[-3][:60], texts[-2][:80]) for x in plain(t) if "N" not in x}
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    monkeypatch.setattr(kmers, "BROADCAST_KMERS", limit)
    found = kmers.wanted_rows(rows, ["id"], "text", spark.createDataFrame([(x,) for x in wanted], "kmer string"), k)
    assert Counter((x.id, x.kmer) for x in found.collect()) == Counter((i, x) for i, x in every if x in wanted)


def test_the_panel_reads_its_reads_once(spark, tmp_path):
    reads = spark.createDataFrame([("l", "1", "ACGT" * 20)], "library string, id string, sequence string")
    reads.write.parquet(f"{tmp_path}/reads")
    known = spark.createDataFrame([("t", "ACGT" * 12)], "target string, sequence string")
    out = kmer_panel.screen(spark.read.parquet(f"{tmp_path}/reads"), known, load_config("kmer_panel"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    assert [tuple(x) for x in out.select("target", "n_kmers", "n_seen", "n_supported", "n_reads").collect()] == [("t", 4, 4, 4, 1)]
    assert out.where(F.col("is_match")).count() == 1
