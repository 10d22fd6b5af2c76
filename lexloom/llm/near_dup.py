"""Operator 8: near-duplicates by a chosen-path set similarity join over minwise tokens.

A document is its set of distinct k-word shingles; equal sets are one from the start. ``coordinates`` minwise
tokens are drawn from each set. In each of ``trees`` independent trees a set descends along chosen
coordinates: its node is the path of its minwise tokens there, so two sets of similarity s share a node of
depth d with chance s^d, and no node is shared in any of t trees with chance (1 - s^d)^t (below 1e-9 at the
defaults for s = 0.8, taking trees as independent). Nodes of one set end, and nodes of the same sets are one.

The sets of a node are compared exhaustively by their minwise tokens: pairs that agree in fewer than five standard
deviations below what the threshold lets expect are ruled out, so that chance meetings of unlike documents
chain nothing together; nodes of more than ``node_sets`` sets keep all their members joined. What remains
joined, directly or through others, is a group, and is compared on full sets: exhaustively, where its shingles fit
``node_shingles``, and otherwise block by block. Larger groups are first compared within their nodes, which are
branched (further coordinates chosen by the node) and dealt in blocks that hold the node's pivots; this links most
copies cheaply. Then the sets of their oversized nodes are compared exhaustively, block against block, in tasks
of bounded size, leaving out only pairs that are linked already or whose sizes rule them out. So every pair that
shares a node and was not ruled out is settled, whatever the node's size. Comparison is a breadth-first search that
leaves out what is linked already, so that copies cost a pass each, not all pairs. Every link is confirmed on
whole sets.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import chunks, only, shingle_sets, table, written
from .components import components

DEFAULTS = {"shingle": 5, "percent": 80, "coordinates": 48, "trees": 30, "depth": 3, "levels": 4, "node_sets": 2_000, "node_shingles": 3_000_000}


def _plan(coordinates: int, trees: int, depth: int) -> list[list[int]]:
    """The coordinates of each tree's first levels; every coordinate serves about equally often."""
    rng, out, deck = random.Random(8), [], []
    for _ in range(trees):
        if len(deck) < depth:
            deck = rng.sample(range(coordinates), coordinates)
        out.append([deck.pop() for _ in range(depth)])
    return out


def sketches(docs: DataFrame, shingle: int, coordinates: int) -> DataFrame:
    """doc_id, n_shingles, set_key (16 bytes; null for an empty set), sketch (minwise tokens, 4 bytes each)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        rng = random.Random(88)
        mult = np.array([rng.getrandbits(64) | 1 for _ in range(coordinates)], np.uint64)
        flip = np.array([rng.getrandbits(64) for _ in range(coordinates)], np.uint64)
        for b in batches:
            for at, texts in chunks(b.column(1)):
                sets = shingle_sets([t.lower() for t in texts], shingle)
                full = [s for s in sets if len(s)]
                sketch = np.zeros((len(full), coordinates), np.uint32)
                if full:
                    every = np.concatenate(full)
                    starts = np.cumsum([0, *[len(s) for s in full[:-1]]])
                    for j in range(coordinates):
                        sketch[:, j] = np.minimum.reduceat((every ^ flip[j]) * mult[j], starts) >> np.uint64(32)
                rows = iter(sketch)
                packed = [next(rows).tobytes() if len(s) else None for s in sets]
                keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], ["doc_id", "n_shingles", "set_key", "sketch"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sketch binary")


def _first_nodes(sets: DataFrame, plan: list[list[int]]) -> DataFrame:
    """tree, path, rep: the node of every set in every tree after the first levels."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .common import mixed

        for b in batches:
            if not b.num_rows:
                continue
            s = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(b.num_rows, -1).astype(np.uint64)
            for t, chosen in enumerate(plan):
                path = np.full(b.num_rows, t + 1, np.uint64)
                for j in chosen:
                    path = mixed(path * np.uint64(0x9E3779B97F4A7C15) + s[:, j] + np.uint64(j << 32))
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), b.column(0)], ["path", "rep"])

    return sets.select("rep", "sketch").mapInArrow(run, "path long, rep long")


def least_agreement(coordinates: int, threshold: float, deviations: float = 5.0) -> int:
    """Minwise tokens in which a pair at the threshold agrees with all but negligible chance."""
    return max(0, math.floor(coordinates * threshold - deviations * math.sqrt(coordinates * threshold * (1 - threshold))))


def joined_by_tokens(tokens, least: int) -> list[int]:
    """The index of each row's component (its least index): rows that agree in at least ``least`` columns are joined."""
    import numpy as np

    root = np.arange(len(tokens))
    rest = np.arange(len(tokens))
    while len(rest):
        seed, rest = rest[0], rest[1:]
        queue = [seed]
        while queue and len(rest):
            hit = (tokens[rest] == tokens[queue.pop()]).sum(1) >= least
            root[rest[hit]] = seed
            queue += rest[hit].tolist()
            rest = rest[~hit]
    return root.tolist()


def _candidate_links(near: DataFrame, sets: DataFrame, o: dict) -> DataFrame:
    """a, b: sets of a node that agree in enough minwise tokens, each with the least of those joined there. near: path, rep, low, n."""
    least = least_agreement(o["coordinates"], o["percent"] / 100)
    once = near.groupBy("path").agg(F.first("n").alias("n"), F.first("low").alias("low"), F.bit_xor(F.xxhash64("rep")).alias("who")).groupBy("n", "low", "who").agg(F.min("path").alias("path")).select("path")
    members = near.join(once, "path")
    wide = members.where(F.col("n") > o["node_sets"]).select(F.col("rep").alias("a"), F.col("low").alias("b"))
    held = members.where(F.col("n") <= o["node_sets"]).join(sets.select("rep", "sketch"), "rep").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("rep", "sketch"))).alias("m"))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            m = b.column(0)
            off = m.offsets.to_numpy() - m.offsets[0].as_py()
            rows = m.flatten()
            reps = rows.field("rep").to_numpy()
            tokens = np.frombuffer(b"".join(rows.field("sketch").to_pylist()), np.uint32).reshape(len(reps), -1)
            root = np.arange(len(reps))
            pair = np.flatnonzero(np.diff(off) == 2)  # most nodes: at once
            first = off[pair]
            hit = first[(tokens[first] == tokens[first + 1]).sum(1) >= least]
            root[hit + 1] = hit
            for k in np.flatnonzero(np.diff(off) > 2).tolist():
                x, y = int(off[k]), int(off[k + 1])
                root[x:y] = x + np.array(joined_by_tokens(tokens[x:y], least))
            at = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(reps[at]), pa.array(reps[root[at]])], ["a", "b"])

    return held.select("m").mapInArrow(run, "a long, b long").union(wide)


def _children(members: DataFrame, coordinates: int, threshold: float) -> DataFrame:
    """path, rep, weight, sketch one level down: each coordinate is chosen by the node with chance 1 / (threshold x coordinates)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from .common import mixed

        limit = np.uint64(int(2**64 / (threshold * coordinates)))
        for b in batches:
            if not b.num_rows:
                continue
            path = b.column(0).to_numpy().view(np.uint64)
            s = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint32).reshape(b.num_rows, -1).astype(np.uint64)
            for j in range(coordinates):
                at = np.flatnonzero(mixed(path + np.uint64((j + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1)) < limit)
                if len(at):
                    child = mixed(path[at] * np.uint64(0x9E3779B97F4A7C15) + s[at, j] + np.uint64(j << 32))
                    picked = pa.table([b.column(1), b.column(2), b.column(3)], ["rep", "weight", "sketch"]).take(pa.array(at))
                    for x in picked.combine_chunks().to_batches():
                        yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), *x.columns], ["path", "rep", "weight", "sketch"])

    return members.select("path", "rep", "weight", "sketch").mapInArrow(run, "path long, rep long, weight long, sketch binary")


def _weighed(members: DataFrame) -> DataFrame:
    """members with their node's n, total and least rep; nodes of one set end here."""
    nodes = members.groupBy("path").agg(F.count("*").alias("n"), F.sum("weight").alias("total"), F.min("rep").alias("low")).where("n > 1")
    return members.join(nodes, "path")


def linked(sets: list, percent: int, label: list | None = None, side: list | None = None) -> list[int]:
    """The index of each set's component within the list (its least index), by breadth-first search.

    A set is compared once with all sets that are not linked yet: 100 x intersection >= percent x union.
    Sets of one label are linked from the start; where there are two sides, only sets of different sides are compared.
    """
    import numpy as np

    n = len(sets)
    root = list(range(n))
    size = np.array([len(s) for s in sets], np.int64)
    token, at = np.unique(np.concatenate(sets), return_inverse=True) if n else (None, None)
    start = np.concatenate([[0], np.cumsum(size)])
    own = [at[start[i] : start[i + 1]] for i in range(n)]
    mark = np.zeros(len(token) if n else 0, bool)
    rest = np.arange(n)  # not linked yet
    name = np.unique(label, return_inverse=True)[1] if label else np.arange(n)
    of = np.split(np.argsort(name, kind="stable"), np.cumsum(np.bincount(name))[:-1]) if n else []
    side = np.asarray(side) if side and len(set(side)) > 1 else None
    seed = 0
    while seed < n:
        if root[seed] != seed or not len(rest):
            seed += 1
            continue
        queue = of[name[seed]].tolist()
        for i in queue:
            root[i] = seed
        rest = rest[name[rest] != name[seed]]
        while queue and len(rest):
            x = queue.pop()
            # by size alone
            near = rest[(100 * np.minimum(size[rest], size[x]) >= percent * np.maximum(size[rest], size[x])) & (size[rest] > 0)]
            if side is not None:
                near = near[side[near] != side[x]]
            if not len(near) or not size[x]:
                continue
            mark[own[x]] = True
            both = np.add.reduceat(mark[np.concatenate([own[i] for i in near])].astype(np.int64), np.concatenate([[0], np.cumsum(size[near])[:-1]]))
            mark[own[x]] = False
            hit = near[100 * both >= percent * (size[near] + size[x] - both)]
            for j in np.unique(name[hit]).tolist():
                new = of[j].tolist()
                for i in new:
                    root[i] = seed
                queue += new
            rest = rest[~np.isin(name[rest], name[hit])]
        seed += 1
    return root


def _compared(units: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """a, b: each set of a unit with the least rep of its component there. units: unit, rep, set_key, perhaps label and side."""
    more = [c for c in ("label", "side") if c in units.columns]
    # merged at every size: which texts travel, and how, does not depend on how many units there are
    texts = docs.join(units.hint("merge"), docs["doc_id"] == units["rep"]).select("unit", "rep", "set_key", "text", *more)

    def run(t):
        import pyarrow as pa
        import xxhash

        seen, sets, reps, at = set(), [], [], []
        order = t.column("rep").to_pylist()
        raw, keys = t.column("text"), t.column("set_key").to_pylist()
        for i in sorted(range(len(order)), key=order.__getitem__):
            if order[i] in seen:
                continue
            s = shingle_sets([(raw[i].as_py() or "").encode().lower()], shingle)[0]
            if xxhash.xxh3_128_digest(s.tobytes()) == keys[i]:  # of rows that share a doc_id, the one that is meant
                seen.add(order[i])
                sets.append(s)
                reps.append(order[i])
                at.append(i)
        root = linked(sets, percent, *[[c[i] for i in at] for c in (t.column(m).to_pylist() for m in more)])
        return pa.table({"a": pa.array(reps, pa.int64()), "b": pa.array([reps[r] for r in root], pa.int64())})

    return texts.groupBy("unit").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; options: see DEFAULTS.

    Words are split at ASCII white space, A-Z lower-cased. Fewer words than a shingle are one shingle; a null
    or wordless text is an empty set, linked with nothing. A row with null doc_id is linked with nothing,
    has no component and is kept. Rows that share a doc_id are each judged by their own text; the component
    is then the least doc_id that any text of it has. Other columns are ignored.
    """
    o = DEFAULTS | options
    docs = only(docs, doc_id="long", text="string")
    found = written(sketches(docs, o["shingle"], o["coordinates"]), "sketches")
    full = found.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    sets = full.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("weight"), F.first("sketch").alias("sketch"))
    sets = written(sets, "sets")
    # a doc_id that stands for several sets (rows that share it) is one node of the graph
    members = _first_nodes(sets, _plan(o["coordinates"], o["trees"], o["depth"]))
    nodes = members.groupBy("path").agg(F.count("*").alias("n"), F.min("rep").alias("low")).where("n > 1")
    near = written(members.join(nodes, "path").select("path", "rep", "low", "n"), "nodes")
    group = components(_candidate_links(near, sets, o))
    grouped = written(sets.join(group, sets["rep"] == group["node"]).select("rep", "set_key", "weight", F.col("component").alias("group")), "groups")
    size = grouped.groupBy("group").agg(F.sum("weight").alias("total"))
    placed = written(grouped.join(size, "group"), "placed")
    small = placed.where(F.col("total") <= o["node_shingles"]).select(F.col("group").alias("unit"), "rep", "set_key")
    links = written(_compared(small, docs, o["shingle"], o["percent"]), "links").where("a <> b")
    large = placed.where(F.col("total") > o["node_shingles"])
    if large.limit(1).count():
        units, oversized = _units_of_large(large.select("rep", "set_key", "weight"), near, sets, o)
        more = written(_compared(units, docs, o["shingle"], o["percent"]), "links-large").where("a <> b")
        found_in_large = written(components(more), "linked")
        if oversized.limit(1).count():
            units = _units_across(oversized, large.select("rep", "set_key", "weight"), found_in_large, o)
            across = written(_compared(units, docs, o["shingle"], o["percent"]), "links-across").where("a <> b")
            found_in_large = components(across.union(found_in_large.select("node", "component")))
        links = links.union(found_in_large.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b"))
    final = sets.select("set_key", "rep").join(links.select(F.col("a").alias("rep"), F.col("b").alias("root")), "rep", "left").select("set_key", F.coalesce("root", "rep").alias("root"))
    out = found.join(final, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _units_of_large(large: DataFrame, near: DataFrame, sets: DataFrame, o: dict) -> tuple[DataFrame, DataFrame]:
    """For groups beyond node_shingles: unit, rep, set_key (their nodes, branched until they fit, then blocks with pivots),
    and rep, low of the nodes that did not fit before they were branched."""
    sketch = sets.select("rep", "sketch")
    at = near.select("path", "rep").join(large.select("rep", "weight"), "rep").join(sketch, "rep").select("path", "rep", "weight", "sketch")
    units = oversized = None
    for level in range(o["levels"] + 1):
        now = written(_weighed(at), "branch")
        fits = now.where(F.col("total") <= o["node_shingles"]).select(F.col("path").alias("unit"), "rep")
        units = fits if units is None else units.union(fits)
        at = now.where(F.col("total") > o["node_shingles"])
        oversized = at.select("rep", "low") if oversized is None else oversized
        if not at.limit(1).count():
            break
        if level < o["levels"]:
            at = _children(at, o["coordinates"], o["percent"] / 100)
    else:
        blocks = F.ceil(F.col("total") * 2 / o["node_shingles"]).cast("long")
        pick = F.xxhash64("path", "rep")
        dealt = at.select(F.xxhash64("path", F.pmod(F.xxhash64("rep", "path"), blocks)).alias("unit"), "rep")
        pivot = (F.col("rep") == F.col("low")) | (F.pmod(pick, F.greatest(F.floor(F.col("n") / 32), F.lit(1)).cast("long")) == 0)
        shared = at.where(pivot).select("path", "rep", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("k")).select(F.xxhash64("path", "k").alias("unit"), "rep")
        units = units.union(dealt).union(shared)
    return units.distinct().join(large.select("rep", "set_key"), "rep").select("unit", "rep", "set_key"), oversized


def _units_across(oversized: DataFrame, large: DataFrame, label: DataFrame, o: dict) -> DataFrame:
    """unit, rep, set_key, label, side: all pairs of blocks of the sets whose oversized nodes share members.

    Blocks hold about half of node_shingles, of similar sizes; sets of a label (what is linked already) that fills
    blocks have their own. Left out are pairs of blocks of one label, and those whose sizes rule out the similarity.
    """
    half = max(o["node_shingles"] // 2, 1)
    joint = components(oversized.select(F.col("rep").alias("a"), F.col("low").alias("b"))).withColumnRenamed("component", "joint")
    sets = (
        oversized.select("rep").distinct().join(large, "rep")
        .join(joint, F.col("rep") == joint["node"], "left").drop("node")
        .join(label.withColumnRenamed("component", "label"), F.col("rep") == label["node"], "left")
        .select("rep", "set_key", "weight", F.coalesce("joint", "rep").alias("joint"), F.coalesce("label", "rep").alias("label"))
        .withColumn("step", F.floor(F.log("weight") / F.log(F.lit(100 / o["percent"]) + 1e-9)) if o["percent"] < 100 else F.col("weight"))
    )
    sets = written(sets, "across")
    many = sets.groupBy("joint", "step", "label").agg(F.sum("weight").alias("own")).withColumn("alone", F.col("own") > half)
    few = many.where("NOT alone").groupBy("joint", "step").agg(F.sum("own").alias("others"))
    dealt = (
        sets.join(many, ["joint", "step", "label"]).join(few, ["joint", "step"], "left")
        .withColumn("n", F.ceil(F.when(F.col("alone"), F.col("own")).otherwise(F.col("others")) / half))
        .withColumn("block", F.xxhash64("step", F.when(F.col("alone"), F.col("label")), F.pmod(F.xxhash64("rep", "set_key"), F.col("n"))))
        .select("joint", "block", "rep", "set_key", "weight", "label")
    )
    dealt = written(dealt, "blocks")
    block = dealt.groupBy("joint", "block").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("weight").alias("w0"), F.max("weight").alias("w1"))
    x, y = block.alias("x"), block.alias("y")
    near = (100 * F.col("x.w1") >= o["percent"] * F.col("y.w0")) & (100 * F.col("y.w1") >= o["percent"] * F.col("x.w0"))
    one = F.least("x.l0", "y.l0") == F.greatest("x.l1", "y.l1")
    pairs = x.join(y, (F.col("x.joint") == F.col("y.joint")) & (F.col("x.block") <= F.col("y.block")) & near & ~one)
    pairs = pairs.select(F.col("x.joint").alias("joint"), F.array_distinct(F.array("x.block", "y.block")).alias("both"))
    pairs = written(pairs.select("joint", F.xxhash64("joint", "both").alias("unit"), F.explode("both").alias("block")), "pairs")
    return dealt.join(pairs, ["joint", "block"]).select("unit", "rep", "set_key", "label", F.col("block").alias("side"))


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """The table's rows, one document of each group: the one with the least doc_id (rows that repeat it stay
    with it). Wordless documents and rows without doc_id stay. All columns are kept."""
    judged = near_duplicates(docs, **options).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(judged, docs["doc_id"].cast("long").eqNullSafe(judged["_id"]), "left_semi")


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)
