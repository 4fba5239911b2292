"""The jobs on small inputs: brute force, two runs over growing input, runs again after a failure, edge cases."""

import logging
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from jobs import coverage, kmer_panel
from jobs.common import load_config

READS = "l_returnflag string, l_suppkey bigint, l_linenumber int, l_partkey bigint, l_quantity double, haplotype string"


def depth_of(rows, width=100):
    out = Counter()
    for flag, supp, line, part, quantity, _ in rows:
        if None in (flag, supp, line, part, quantity):
            continue
        low = part * 100 + line * 10
        for b in range(low // width, (low + int(quantity) * 20) // width + 1):
            out["normal" if flag == "R" else "tumor", f"chr{supp % 24 + 1}", line % 3 or None, b] += 1
    return out


def as_counter(df):
    rows = df.collect()
    out = Counter({(r["sample"], r.contig, r.haplotype, r.bin): r.depth for r in rows})
    assert len(out) == len(rows)
    return out


def some_reads(seed, n=200):
    return [("R" if (i * seed) % 3 else "A", (i * seed) % 40, i % 5 + 1, (i * 7 + seed) % 90, float((i * seed) % 50), "x") for i in range(n)]


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


def test_coverage_takes_only_new_files(spark, folder, caplog):
    caplog.set_level(logging.INFO)
    inbox, out, mark = f"{folder}/in", f"{folder}/out", f"{folder}/mark"
    run = lambda: as_counter(coverage.run(spark, inbox, out, mark))
    add = lambda rows: spark.createDataFrame(rows, READS).coalesce(1).write.mode("append").parquet(inbox)
    first, second = some_reads(3), some_reads(5, 90) + [("R", None, 1, 1, 1.0, "x"), ("A", 1, 2, None, 3.0, "x")]
    add(first)
    assert run() == depth_of(first)
    assert run() == depth_of(first)
    add(second)
    add(first[:10])
    assert run() == depth_of(first + second + first[:10])
    assert run() == depth_of(first + second + first[:10])
    messages = [r.getMessage() for r in caplog.records if r.name == "strandloom.jobs"]
    assert [int(m.split()[2]) for m in messages if "rows read" in m] == [len(first), len(second) + 10]
    assert [int(m.split()[1]) for m in messages if "of new files" in m] == [1, 0, 1, 0]


def test_a_batch_that_runs_again_counts_once(spark, folder):
    config, path = load_config("coverage"), f"{folder}/depths"
    parts = [spark.createDataFrame(some_reads(s, 60), READS) for s in (2, 3, 4)]
    coverage.add_batch(parts[0], 0, path, config)
    coverage.add_batch(parts[1], 1, path, config)
    coverage.add_batch(parts[1], 1, path, config)  # its commit was lost
    coverage.add_batch(parts[2], 2, path, config)
    coverage.add_batch(parts[2], 2, path, config)
    got = as_counter(coverage.last_sums(spark, path).drop("batch", "turn"))
    assert got == depth_of(some_reads(2, 60) + some_reads(3, 60) + some_reads(4, 60))
    # a commit that failed half way: some contigs are of the new batch, the others of the one two before
    coverage.add_batch(parts[0].where("l_suppkey % 24 < 3"), 3, path, config)
    coverage.add_batch(parts[0], 3, path, config)
    assert as_counter(coverage.last_sums(spark, path).drop("batch", "turn")) == got + depth_of(some_reads(2, 60))


def test_coverage_of_no_reads(spark, folder):
    spark.createDataFrame([], READS).write.parquet(f"{folder}/in")
    assert coverage.run(spark, f"{folder}/in", f"{folder}/out", f"{folder}/mark").collect() == []
    assert coverage.run(spark, f"{folder}/in", f"{folder}/out", f"{folder}/mark").columns == ["sample", "haplotype", "bin", "depth", "contig"]


def brute_panel(reads, targets, k=31, least=3, share=0.85):
    cut = lambda s: [x for x in ((s or "").upper()[i : i + k] for i in range(len(s or "") - k + 1)) if "N" not in x]
    known = {t: set(cut(s)) for t, s in targets if t is not None}
    counts, holders = defaultdict(Counter), defaultdict(set)
    for library, id_, s in reads:
        for x in cut(s):
            counts[library][x] += 1
            if id_ is not None:
                holders[library, x].add(id_)
    out = []
    for library, seen in counts.items():
        for t, ks in known.items():
            if both := [x for x in ks if x in seen]:
                supported = sum(seen[x] >= least for x in both)
                ids = set().union(*(holders[library, x] for x in both))
                out.append((t, len(ks), len(both), supported, len(ids), supported / len(ks) > share, library))
    return sorted(out, key=str)


def test_panel_equals_brute_force(spark, folder):
    bases = lambda n, seed: "".join("ACGT"[(i * i * seed + i * seed + i // 3) % 4] for i in range(n))
    targets = [("1", bases(90, 3)), ("2", bases(60, 7) + "n" + bases(40, 11)), ("3", "ACG"), (None, bases(50, 3)), ("4", None), ("5", bases(500, 13))]
    reads = [("a", i, bases(90, 3)[i : i + 50]) for i in range(30)] + [("a", 31, bases(90, 3))] * 3
    reads += [(None, i, bases(60, 7)) for i in (1, 1, None)] + [("b", 5, None), ("b", 6, ""), ("b", None, bases(300, 13).lower()), ("c", 9, "T" * 40)]
    spark.createDataFrame([(i, s, src, 1) for src, i, s in reads], "doc_id bigint, text string, source string, kmer int").repartition(3).write.parquet(f"{folder}/reads")
    spark.createDataFrame([(t, s, "x") for t, s in targets], "item_id string, text string, library string").write.parquet(f"{folder}/targets")
    run = lambda: sorted((tuple(r) for r in kmer_panel.run(spark, f"{folder}/reads", f"{folder}/targets", f"{folder}/out").collect()), key=str)
    want = brute_panel([(a, i, s) for a, i, s in reads], targets)
    assert run() == want
    assert run() == want and any(r[5] for r in want)
    assert {x.split("=")[-1] for x in (f.name for f in __import__("pathlib").Path(folder, "out").iterdir()) if "=" in x} == {"a", "b", "__HIVE_DEFAULT_PARTITION__"}


def test_panel_without_targets_or_reads(spark, folder):
    spark.createDataFrame([], "doc_id bigint, text string, source string").write.parquet(f"{folder}/reads")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{folder}/targets")
    assert kmer_panel.run(spark, f"{folder}/reads", f"{folder}/targets", f"{folder}/out").collect() == []


def test_configs(tmp_path):
    (tmp_path / "c.json").write_text('{"bin": 5}')
    assert load_config("coverage", str(tmp_path / "c.json"))["bin"] == 5 and load_config("coverage")["bin"] == 100
    (tmp_path / "c.json").write_text('{"bins": 5}')
    with pytest.raises(ValueError):
        load_config("coverage", str(tmp_path / "c.json"))


def test_command_lines_end_with_a_written_output(tmp_path, sf_dir):
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    args = ["-m", "jobs.coverage", "--reads", f"{sf_dir}/lineitem*", "--output", f"{tmp_path}/o", "--checkpoint", f"{tmp_path}/c"]
    done = subprocess.run([sys.executable, *args], cwd=root, capture_output=True, text=True, timeout=170)
    assert done.returncode == 0, done.stderr[-2000:]
    assert (tmp_path / "o" / "coverage" / "_SUCCESS").exists() and "1 batches of new files" in done.stderr


def test_jobs_know_nothing_of_the_corpus_operators():
    import pathlib

    for file in [*pathlib.Path(__file__).parent.parent.glob("jobs/*.py"), pathlib.Path(__file__)]:
        imported = [x for x in file.read_text().splitlines() if x.strip().startswith(("import ", "from "))]
        assert not any(word in x for x in imported for word in ("llm", "corpus"))


def test_depth_is_that_of_the_library(spark, sf_dir, folder):
    got = coverage.run(spark, f"{sf_dir}/lineitem.parque[t]", f"{folder}/out", f"{folder}/mark")
    total = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.sum(F.lit(1))).first()[0]
    assert got.agg(F.sum("depth")).first()[0] >= total


def test_coverage_tasks_grow_with_the_rows(spark, tmp_path, monkeypatch):
    from jobs import coverage

    rows = [(None, 1, s, s + 95) for s in range(0, 40_000, 20)]
    spark.createDataFrame([("t", "a", *r) for r in rows], "sample string, contig string, haplotype int, h int, start bigint, end bigint").drop("h").write.parquet(f"{tmp_path}/reads")
    config = {"bin": 10, "files_per_batch": 200, "columns": {x: f"`{x}`" for x in ("sample", "contig", "haplotype", "start", "end")}}
    got = {}
    for most in (2_000_000, 500):
        monkeypatch.setattr(coverage, "TASK_ROWS", most)
        out = coverage.run(spark, f"{tmp_path}/reads", f"{tmp_path}/{most}/out", f"{tmp_path}/{most}/mark", config)
        got[most] = {(r.bin, r.depth) for r in out.collect()}
        files = out.groupBy(F.input_file_name()).count().collect()
        assert max(r["count"] for r in files) <= 2 * most
    assert got[500] == got[2_000_000] and len(got[500]) == 4008
    state = spark.read.schema(coverage.SUMS).parquet(f"{tmp_path}/500/out/depths")
    assert 0 < state.count() < 4008 and state.agg(F.sum(F.col("next_bin") - F.col("bin"))).first()[0] == 4008
