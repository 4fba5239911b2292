"""Optional refinement: end clusters taken apart where the tumor reads' alignments disagree.

Reads of a cluster are parts if a chain of similar reads joins them. Reads with the same events are one node. Two
nodes can be similar only if they share an event, so they meet in blocks of event starts; every pair of starts within
the tolerance has a block in common. All members of a block first meet its few most frequent ones; then, while a block
holds members of several parts, those outside its largest part meet all. Pairs within a part need no test, so a pile-up
of like reads costs tests in proportion to its size, and no pair that joins parts is lost.

Clusters of at most SMALL reads take none of these steps: their reads meet in one array, which a fold takes apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.config import DEFAULT, Config
from strandloom.functions import cigar
from strandloom.operators.components import components
from strandloom.operators.stages import settle

c = F.col
#: Least bases of an event that is compared, reach beyond the cluster's ends, least span of a cluster to refine.
LEAST, MARGIN, SPAN = 2, 500, 100
#: Bases between like events, and members of a block that all others meet, round by round; then what is left meets.
TOLERANCE, ROUNDS = 50, (2, 16)
#: Reads of a cluster that one array holds.
SMALL = 128


def cluster_extents(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, extent_start, extent_end): from the smallest start to the greatest end of each cluster's rows."""
    return rows.groupBy(*keys).agg(F.min(F.least("start_loc", "end_loc")).alias("extent_start"), F.max(F.greatest("start_loc", "end_loc")).alias("extent_end"))


def member_events(members: DataFrame, reads: DataFrame, keys: list[str], gap: int = DEFAULT.cigar_gap) -> DataFrame:
    """(keys, read_name, deletions, insertions) of the alignments of member reads around their cluster.

    members: (keys, read_name, contig, extent_start, extent_end). Of several alignments of a read there, the first counts.
    """
    near = members.select(*keys, F.col("read_name").alias("member"), F.col("contig").alias("on"), (F.col("extent_start") - MARGIN).alias("lo"), (F.col("extent_end") + MARGIN).alias("hi"))
    # dealt by name once: the join and the groups need no further shuffle
    near = near.repartition("member").distinct()
    reads = reads.select("read_name", "contig", "start", "end", "cigar").repartition("read_name")
    found = lambda ops, kind: cigar.merge(cigar.events(ops, F.col("start"), kind, LEAST), gap)
    # the text is parsed once for both kinds
    both = F.element_at(F.transform(F.array(cigar.operations(F.col("cigar"))), lambda ops: F.struct(found(ops, "D").alias("deletions"), found(ops, "I").alias("insertions"))), 1)
    met = reads.join(near, (F.col("read_name") == F.col("member")) & (F.col("contig") == F.col("on")) & (F.col("start") < F.col("hi")) & (F.col("end") > F.col("lo")))
    first = met.groupBy(*keys, "read_name").agg(F.min(F.struct("start", "cigar")).alias("a")).select(*keys, "read_name", F.col("a.start").alias("start"), F.col("a.cigar").alias("cigar"))
    return first.select(*keys, "read_name", both.alias("e")).select(*keys, "read_name", "e.deletions", "e.insertions")


def varied(events: DataFrame, least: int = 30):
    """Whether a read has an event that is large enough to tell clusters apart."""
    return cigar.has_large(F.col("deletions"), least) | cigar.has_large(F.col("insertions"), least)


def _plain(found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["len"].alias("len")))


def _blocks(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(block, node, weight): each node at its blocks; a block has a cluster's events of one kind that start in a stretch of 2 * TOLERANCE."""
    starts = lambda name: F.transform(name, lambda x: F.struct(F.lit(name).alias("kind"), F.floor(x["start"] / TOLERANCE).alias("cell")))
    cells = nodes.select(*keys, "node", "weight", F.explode(F.concat(starts("deletions"), starts("insertions"))).alias("e"))
    return cells.select(*keys, "node", "weight", c("e.kind").alias("kind"), F.explode(F.array(c("e.cell"), c("e.cell") + 1)).alias("at")).select(F.struct(*keys, "kind", "at").alias("block"), "node", "weight").distinct()


def _similar(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Those of (u, v) whose events are similar, in an order that two of their reads' names have."""
    side = lambda name, end: nodes.select(c("node").alias(name), c("deletions").alias(f"d{end}"), c("insertions").alias(f"i{end}"), c("first").alias(f"first{end}"), c("last").alias(f"last{end}"))
    met = pairs.join(side("u", 1), "u").join(side("v", 2), "v")
    ahead = (c("first1") < c("last2")) & (cigar.similarity(c("d1"), c("i1"), c("d2"), c("i2"), TOLERANCE) >= threshold)
    behind = (c("first2") < c("last1")) & (cigar.similarity(c("d2"), c("i2"), c("d1"), c("i1"), TOLERANCE) >= threshold)
    return met.where(ahead | behind).select("u", "v")


def _like(a: Column, b: Column, threshold: float) -> Column:
    """Whether member a is similar to a member b of a greater name; events are compared only if starts are near."""
    none = lambda x: F.size(x["deletions"]) + F.size(x["insertions"]) == 0
    alike = (a["deletions"] == b["deletions"]) & (a["insertions"] == b["insertions"])
    close = F.when(F.arrays_overlap(a["cells"], b["cells"]), alike | (cigar.similarity(a["deletions"], a["insertions"], b["deletions"], b["insertions"], TOLERANCE) >= threshold))
    return F.when(none(a) | none(b), none(a) & none(b)).otherwise(F.coalesce(close, F.lit(False)))


def small_parts(events: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """parts_of clusters whose reads one array can hold: one group for each cluster, and nothing is written."""
    cell = lambda x, kind: F.floor(x["start"] / TOLERANCE) * 2 + kind
    cells = lambda name, kind: F.flatten(F.transform(name, lambda x: F.array(cell(x, kind), cell(x, kind) + 2)))
    member = F.struct("read_name", _plain(c("deletions")).alias("deletions"), _plain(c("insertions")).alias("insertions"), F.concat(cells("deletions", 0), cells("insertions", 1)).alias("cells"))
    held = events.groupBy(*keys).agg(F.array_sort(F.collect_list(member)).alias("members"))

    def step(labels: Column, at: Column) -> Column:
        # the parts before that hold a similar read become one with this read, under their least place
        new = c("members")[at]
        met = F.array_distinct(F.filter(F.transform(labels, lambda x, i: F.when(_like(c("members")[i], new, threshold), x)), lambda x: x.isNotNull()))
        join = lambda m: F.concat(F.transform(labels, lambda x: F.when(F.array_contains(m, x), F.array_min(m)).otherwise(x)), F.array(F.array_min(m)))
        return F.element_at(F.transform(F.array(met), lambda m: F.when(F.size(m) == 0, F.concat(labels, F.array(at))).otherwise(join(m))), 1)

    none = F.array().cast("array<int>")
    labelled = held.withColumn("labels", F.aggregate(F.sequence(F.lit(0), F.size("members") - 1), none, step))
    rows = F.transform("members", lambda x, i: F.struct(x["read_name"].alias("read_name"), c("members")[c("labels")[i]]["read_name"].alias("part")))
    return labelled.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.read_name", "r.part")


def parts_of(events: DataFrame, keys: list[str], threshold: float, small: int = SMALL) -> DataFrame:
    """(keys, read_name, deletions, insertions), a row for each read -> (keys, read_name, part).

    part: the least name of the reads that a chain of similar reads of the cluster joins. events is read several
    times: settle what is costly. The keys must not be null.
    """
    sizes = events.groupBy(*keys).agg(F.count("*").alias("__n"))
    few, many = (events.join(sizes.where(at), keys, "left_semi") for at in (c("__n") <= small, c("__n") > small))
    parts = small_parts(few, keys, threshold)
    if sizes.where(c("__n") > small).isEmpty():
        return parts
    return parts.unionByName(large_parts(many, keys, threshold))


def large_parts(events: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """parts_of clusters of any size, by blocks of event starts."""
    plain = events.select(*keys, "read_name", _plain(c("deletions")).alias("deletions"), _plain(c("insertions")).alias("insertions"))
    alike = [*keys, "deletions", "insertions"]
    nodes = plain.groupBy(*alike).agg(F.min("read_name").alias("first"), F.max("read_name").alias("last"), F.count("*").alias("weight"))
    nodes = settle(nodes.withColumn("node", F.struct(*keys, "first")), "refine-nodes")
    blocks = settle(_blocks(nodes, keys), "refine-blocks")
    found, labels = None, None
    for most in (*ROUNDS, None):
        rows = blocks.withColumn("root", c("node")) if labels is None else blocks.join(labels.select("node", c("root").alias("r")), "node", "left").withColumn("root", F.coalesce("r", "node")).drop("r")
        rows = settle(rows, "refine-round")
        # blocks of one part are done
        open_ = rows.groupBy("block").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("block")
        rows = rows.join(open_, "block", "left_semi")
        if most is None:
            sizes = rows.groupBy("block", "root").agg(F.count("*").alias("n"))
            largest = sizes.groupBy("block").agg(F.max_by("root", F.struct("n", "root")).alias("largest"))
            few = rows.join(largest, "block").where("root <> largest")
        else:
            few = rows.withColumn("rank", F.row_number().over(Window.partitionBy("block").orderBy(c("weight").desc(), "node"))).where(c("rank") <= most)
        hubs = few.select("block", c("node").alias("hub"), c("root").alias("hub_root"))
        pairs = rows.join(hubs, "block").where("root <> hub_root").select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct()
        new = settle(_similar(pairs, nodes, threshold), "refine-links")
        found = new if found is None else found.unionByName(new)
        labels = components(found)
    named = nodes.join(labels, "node", "left").select(*alike, F.coalesce("root.first", "first").alias("part"))
    same = [plain[x].eqNullSafe(named[x]) for x in alike]
    return plain.join(named, same).select(*[plain[k] for k in keys], "read_name", "part")


def alignment_parts(ends: DataFrame, reads: DataFrame, keys: list[str], config: Config = DEFAULT) -> DataFrame:
    """(keys, read_name, part) of the tumor reads of clusters that are wide enough and have two reads with large events."""
    wide = cluster_extents(ends, keys).where(F.col("extent_end") - F.col("extent_start") >= SPAN)
    tumor = ends.where("sample = 'tumor'").select(*keys, "read_name", F.col("start_chr").alias("contig")).join(wide, keys)
    events = settle(member_events(tumor, reads, keys, config.cigar_gap).select(*keys, "read_name", _plain(c("deletions")).alias("deletions"), _plain(c("insertions")).alias("insertions")), "refine-events")
    open_ = events.groupBy(*keys).agg(F.count_if(varied(events)).alias("n")).where("n >= 2").select(*keys)
    return parts_of(events.join(open_, keys, "left_semi"), keys, config.refine_similarity)


def refine(ends: DataFrame, reads: DataFrame, keys: list[str], config: Config = DEFAULT) -> DataFrame:
    """ends with part: rows of a cluster whose tumor reads fall into groups of similar alignments get their group's.

    Clusters of a span under SPAN or with fewer than two reads with large events keep part 0, as do reads
    without an alignment there. Rows of the normal sample are repeated for every part of their cluster.
    """
    ends = settle(ends, "refine-rows")
    parts = settle(alignment_parts(ends, reads, keys, config).withColumn("part", F.xxhash64("part")), "refine-parts")
    mine = ends.where("sample <> 'normal'").join(parts, [*keys, "read_name"], "left").withColumn("part", F.coalesce("part", F.lit(0).cast("bigint")))
    every = parts.select(*keys, "part").distinct()
    normal = ends.where("sample = 'normal'").join(every, keys, "left").withColumn("part", F.coalesce("part", F.lit(0).cast("bigint")))
    return mine.select(*ends.columns, "part").unionByName(normal.select(*ends.columns, "part"))
