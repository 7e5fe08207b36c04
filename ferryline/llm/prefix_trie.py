"""The prefix trie of conversations, built as a z-fast trie.

A conversation is a path of turns; a node of the trie is a distinct sequence of first turns. Paths stand for themselves by
digests of their prefixes: the digest at depth d is the exclusive or of a hash of each turn and its depth, 128 bits in all.
Exclusive ors of a stretch of turns compose, so a conversation of any length is cut into chunks of ``CHUNK`` turns
and no task ever holds a whole one; texts stay behind at the first scan.

The compacted trie is a table of nodes, each an edge (above, below] of depths on the path of its ``owner``. A node is kept
under its handle, the prefix of that path whose length is the two-fattest number of the edge (the multiple of the
highest power of two), and under its entry, the prefix of length above + 1. Conversations are inserted in batches:

* all paths that are not in yet look for their exit node by fat binary search, at most log2(length) - ``LAST_BITS`` look-ups
  of a handle each, and a last one of the entries at the few depths that are left; a join with the owner's digests says at
  what depth they leave and for which turn;
* of the paths that leave an edge at one depth for one next turn, one is the batch's: it adds its leaf, and edges are
  split where paths leave them. The others find that leaf in the next batch.

Equal conversations are one path, so copies cost nothing. A batch takes a path for each way out of the trie, and which
one is left to a hash, so the number of batches grows with the logarithm of the paths.

Counts are summed over the compacted nodes that lie on each path, by joins with map-side combine; what a subtree sums up
comes from running sums along the paths, each node being counted on its owner's path. At last each edge is expanded into its turns.

Defined cases: rows without an id belong to no conversation and are left out; null roles and texts are empty; turns go by
number, a null one first, and turns of one number by the hash of role and text; repeated turns count each; an empty
table has no node; texts may have any length; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferryline.operators.ordinal import with_ordinal
from ferryline.session import checked_broadcast, materialise

CHUNK = 4_096
# Ids of one ending in one row of text at most.
IDS_A_ROW = 65_536
MAX_BATCHES = 200
# The search by two-fattest numbers ends where fewer than 2 ** LAST_BITS depths are left; those are looked up at once.
LAST_BITS = 4
ROOT = "0" * 32
GROUP, MOST_SHARED = 100, 6



def digested(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, one, two, size): two hashes of role and text, and the text's code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    hashes = [F.xxhash64(F.lit(seed), role, text).alias(name) for seed, name in ((1, "one"), (2, "two"))]
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *hashes, F.char_length(text).cast("long").alias("size"))
    return rows.filter("conv_id is not null")


def ordered(turns: DataFrame) -> DataFrame:
    """The turns of each conversation with their 0-based ``place``."""
    return with_ordinal(turns.withColumn("_known", F.col("turn").isNotNull()).fillna(0, ["turn"]), ["_known", "turn", "one", "two"], ["conv_id"], "place")


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes over from the first one of its group."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(MOST_SHARED)).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, one, two, size) of each conversation: the first h turns of its group's first one, then its own after h.

    Depth 0, without a turn, is there for every conversation, also for one without turns.
    """
    places = materialise(ordered(digested(conversations)), "turns")
    sizes = places.groupBy("conv_id").agg(F.count("*").alias("n"))
    first = F.col("conv_id") - F.col("conv_id") % GROUP
    convs = sizes.select("conv_id", first.alias("first"), shared_turns(F.col("conv_id")).alias("h"))
    bases = sizes.select(F.col("conv_id").alias("first"), F.col("n").alias("base_n"))
    convs = materialise(convs.join(bases, "first", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0)))).drop("base_n"), "conversations")
    heads = places.filter(F.col("place") < MOST_SHARED).withColumnRenamed("conv_id", "first")
    taken = heads.join(convs.select("conv_id", "first", "h"), "first").filter("place < h")
    own = places.join(checked_broadcast(convs.select("conv_id", "h", "taken")), "conv_id").filter("place >= h")
    depth = (F.col("taken") + F.col("place") - F.col("h") + 1).alias("depth")
    none = F.lit(0).cast("long")
    roots = convs.select("conv_id", none.alias("depth"), none.alias("one"), none.alias("two"), none.alias("size"))
    return (
        roots.unionByName(taken.select("conv_id", (F.col("place") + 1).alias("depth"), "one", "two", "size"))
        .unionByName(own.select("conv_id", depth, "one", "two", "size"))
    )


def running(df: DataFrame, key: str, place: str, sums: dict[str, Column], step: int = CHUNK) -> DataFrame:
    """``df`` with the running aggregate of each of ``sums`` along ``place`` within ``key``; no task orders more than ``step`` places of a key.

    ``sums`` maps a name to an aggregate (a sum, an exclusive or) of which the parts can be put together by the same aggregate.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col(place) / step))
    within = Window.partitionBy(key, "_chunk").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    inner = chunked.select("*", *(agg(F.col(of)).over(within).alias(f"_in_{name}") for name, (agg, of, _) in sums.items()))
    wholes = chunked.groupBy(key, "_chunk").agg(*(agg(F.col(of)).alias(f"_all_{name}") for name, (agg, of, _) in sums.items()))
    wholes = wholes.select(key, "_chunk", *(F.coalesce(agg(F.col(f"_all_{name}")).over(before), F.lit(0)).alias(f"_to_{name}") for name, (agg, _, _) in sums.items()))
    joined = inner.join(wholes, [key, "_chunk"])
    return joined.select(*df.columns, *(put(F.col(f"_to_{name}"), F.col(f"_in_{name}")).alias(name) for name, (_, _, put) in sums.items()))


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def _add(a: Column, b: Column) -> Column:
    return a + b


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, at, size, total): the digest of each prefix, the code points of its last turn and of all its turns."""
    mixed = [
        F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(seed), F.col(name), F.col("depth"))).alias(f"mixed_{name}")
        for seed, name in ((3, "one"), (4, "two"))
    ]
    rows = turns.select("conv_id", "depth", "size", *mixed)
    sums = {"first": (F.bit_xor, "mixed_one", _xor), "second": (F.bit_xor, "mixed_two", _xor), "total": (F.sum, "size", _add)}
    at = F.concat(*(F.lpad(F.hex(F.col(c)), 16, "0") for c in ("first", "second")))
    return running(rows, "conv_id", "depth", sums).select("conv_id", "depth", at.alias("at"), "size", "total")


def fattest(low: Column, high: Column) -> Column:
    """The two-fattest number of (low, high]; null where that is empty."""
    bits = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.when(low < high, F.call_function("shiftleft", F.call_function("shiftright", high, bits), bits))


def _keyed(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """Edges (owner, above, below) with the digests of their end, handle, entry and start."""
    depths = F.array("above", "below", fattest(F.col("above"), F.col("below")), F.col("above") + 1)
    names = F.array(*(F.lit(n) for n in ("start", "end", "handle", "entry")))
    wanted = edges.select("owner", "above", "below", F.explode(F.arrays_zip(names.alias("name"), depths.alias("depth"))).alias("w"))
    found = wanted.select("owner", "above", "below", F.col("w.name").alias("name"), F.col("w.depth").alias("depth")).join(
        steps.select(F.col("path").alias("owner"), "depth", "at"), ["owner", "depth"]
    )
    chosen = [F.max(F.when(F.col("name") == n, F.col("at"))).alias(n) for n in ("start", "end", "handle", "entry")]
    return found.groupBy("owner", "above", "below").agg(*chosen)


def locate(paths: DataFrame, nodes: DataFrame, steps: DataFrame, longest: int) -> DataFrame:
    """(path, n, owner, above, below, leaves, next): the edge on which each path leaves the trie, at what depth, and for which prefix.

    A path that leaves at the end of a node, or at the root, has that node's edge and ``leaves = below``; the root's is (0, 0].
    ``next`` is the digest of the prefix one turn further than where a path leaves; null at its end.
    """
    edge = [F.col("owner").alias("o"), F.col("above").alias("a"), F.col("below").alias("b")]
    handles, entries = (nodes.select(F.col(c).alias("probe_at"), *edge) for c in ("handle", "entry"))
    here = steps.select("path", F.col("depth").alias("probe"), F.col("at").alias("probe_at"))
    zero, hit = F.lit(0).cast("long"), F.col("b").isNotNull()
    state = paths.select("path", "n", zero.alias("low"), F.col("n").alias("high"), F.lit(None).cast("long").alias("owner"), zero.alias("above"), zero.alias("below"))
    # Each probe takes at least one factor of two from all numbers that are left between low and high.
    for _ in range(max(0, longest.bit_length() - LAST_BITS)):
        probed = state.withColumn("probe", fattest(F.col("low"), F.col("high"))).join(here, ["path", "probe"], "left")
        state = probed.join(handles, "probe_at", "left").select(
            "path", "n",
            F.when(hit, F.least("b", "high")).otherwise(F.col("low")).alias("low"),
            F.when(hit | F.col("probe").isNull(), F.col("high")).otherwise(F.col("probe") - 1).alias("high"),
            *(F.when(hit, F.col(new)).otherwise(F.col(old)).alias(old) for new, old in (("o", "owner"), ("a", "above"), ("b", "below"))),
        )
    # Of the edges that a path enters at the depths left, the lowest is its last; without any it is the one found so far.
    depths = here.withColumnRenamed("path", "p")
    left = state.join(depths, (F.col("path") == F.col("p")) & (F.col("probe") > F.col("low")) & (F.col("probe") <= F.col("high") + 1), "left")
    found = F.max(F.when(hit, F.struct("a", "b", "o")))
    on = left.join(entries, "probe_at", "left").groupBy("path", "n", "owner", "above", "below").agg(found.alias("last"))
    met = F.col("last").isNotNull()
    on = on.select("path", "n", *(F.when(met, F.col(f"last.{new}")).otherwise(F.col(old)).alias(old) for new, old in (("o", "owner"), ("a", "above"), ("b", "below"))))
    own = on.join(steps.select("path", "depth", "at"), "path").filter("depth > above and depth <= below + 1")
    theirs = steps.select(F.col("path").alias("owner"), "depth", "at", F.lit(True).alias("same"))
    same = F.col("same").isNotNull() & (F.col("depth") <= F.col("below"))
    return own.join(theirs, ["owner", "depth", "at"], "left").groupBy("path", "n", "owner", "above", "below").agg(
        F.coalesce(F.max(F.when(same, F.col("depth"))), F.col("above")).alias("leaves"),
        F.min(F.when(~same, F.struct("depth", "at")))["at"].alias("next"),
    )


def build(paths: DataFrame, steps: DataFrame) -> DataFrame:
    """The compacted nodes (owner, above, below, start, end, handle, entry) of the trie over ``paths`` (path, n).

    ``steps`` (path, depth, at) holds the digests of all prefixes. Ends of paths are ends of nodes.
    """
    spark = paths.sparkSession
    edge = "owner long, above long, below long"
    nodes = spark.createDataFrame([], f"{edge}, start string, end string, handle string, entry string")
    waiting, left = paths, None
    for _ in range(MAX_BATCHES):
        state = waiting.agg(F.count("*").alias("n"), F.max("n").alias("longest")).head()
        if state["n"] == 0:
            return nodes
        if state["n"] == left:
            raise RuntimeError("a batch added no path")
        left = state["n"]
        exits = materialise(locate(waiting, nodes, steps, state["longest"]), "located")
        way = ["owner", "above", "below", "leaves", "next"]
        order = F.struct(F.xxhash64("path").alias("by"), F.col("path"), F.col("n"))
        batch = materialise(exits.groupBy(*way).agg(F.min(order).alias("one")).select(*way[:4], "one.path", "one.n"), "batch")
        leaves = batch.filter("n > leaves").select(F.col("path").alias("owner"), F.col("leaves").alias("above"), F.col("n").alias("below"))
        cuts = batch.filter("owner is not null and leaves < below and leaves > above").select("owner", "above", "below", "leaves").distinct()
        whole = cuts.groupBy("owner", "above", "below").agg(F.count("*").alias("cuts"))
        ends = cuts.unionByName(whole.select("owner", "above", "below", F.col("below").alias("leaves")))
        along = Window.partitionBy("owner", "above", "below").orderBy("leaves")
        pieces = ends.select("owner", F.coalesce(F.lag("leaves").over(along), F.col("above")).alias("above"), F.col("leaves").alias("below"))
        kept = nodes.join(whole.drop("cuts"), ["owner", "above", "below"], "left_anti").select(*nodes.columns)
        added = _keyed(leaves.unionByName(pieces), steps).select(*nodes.columns)
        nodes = materialise(kept.unionByName(added), "nodes")
        waiting = materialise(waiting.join(batch.select("path"), "path", "left_anti"), "waiting")
    raise RuntimeError("the paths did not all find their place")


def _ends_sha256(members: DataFrame) -> DataFrame:
    """(at, ends_sha256) of (at, conv_id): the ids of each ``at`` in ascending order, parted by commas.

    Ids are put together in rows of at most ``IDS_A_ROW``. A digest has to see its text in order, so the rows of one ``at`` pass
    through one task, one batch at a time, and nothing but the digest is kept of them.
    """
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    chunks = members.groupBy("at", F.floor(F.col("conv_id") / IDS_A_ROW).alias("chunk")).agg(listed.alias("ids"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            done: list[tuple[str, str]] = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if key != at:
                    if digest is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.as_py().encode())
            yield _digest_rows(done)
        if digest is not None:
            yield _digest_rows([(at, digest.hexdigest())])

    in_order = chunks.repartition("at").sortWithinPartitions("at", "chunk").select("at", "ids")
    return in_order.mapInArrow(emit, "at string, ends_sha256 string")


def _digest_rows(done: list[tuple[str, str]]) -> pa.RecordBatch:
    columns = list(zip(*done, strict=True)) or [(), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["at", "ends_sha256"])


def trie(conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of the rebuilt conversations."""
    every = materialise(prefixes(rebuilt(conversations)), "prefixes")
    last = every.groupBy("conv_id").agg(F.max(F.struct("depth", "at")).alias("last"))
    last = materialise(last.select("conv_id", F.col("last.depth").alias("n"), F.col("last.at").alias("at")), "ends")
    same = last.groupBy("at", "n").agg(F.min("conv_id").alias("path"), F.count("*").alias("copies"))
    paths = materialise(same.select("path", "n", "at", "copies"), "paths")
    steps = materialise(every.join(paths.select(F.col("path").alias("conv_id")), "conv_id").withColumnRenamed("conv_id", "path"), "steps")
    nodes = build(paths.filter("n > 0").select("path", "n"), steps.select("path", "depth", "at"))
    compact = materialise(_summed(nodes, paths, steps), "trie")
    return _expanded(compact, steps, _ends_sha256(last.select("at", "conv_id")))


def _summed(nodes: DataFrame, paths: DataFrame, steps: DataFrame) -> DataFrame:
    """The compacted nodes, the root included, with their counts; ``below_tokens``: saved in the subtree, the node's own edge included."""
    root = paths.groupBy().agg(F.count("*").alias("any")).filter("any > 0").select(
        F.lit(None).cast("long").alias("owner"), F.lit(0).cast("long").alias("above"), F.lit(0).cast("long").alias("below"),
        F.lit(None).cast("string").alias("start"), F.lit(ROOT).alias("end"),
    )
    table = nodes.select("owner", "above", "below", "start", "end").unionByName(root)
    children = table.filter("start is not null").groupBy(F.col("start").alias("end")).agg(F.count("*").alias("n_children"))
    table = table.join(children, "end", "left").fillna(0, ["n_children"])
    leaves = paths.join(table.filter("n_children = 0").select(F.col("end").alias("at"), F.lit(1).alias("leaf")), "at", "left").fillna(0, ["leaf"])
    # The compacted nodes on each path; rows of a path that are no node's end drop out before the sums.
    on_path = steps.select("path", "at", "depth").join(table.select(F.col("end").alias("at"), "owner", "above"), "at")
    on_path = materialise(on_path.join(leaves.select("path", "copies", "leaf"), "path"), "on-path")
    counts = on_path.groupBy("at").agg(F.sum("copies").alias("n_convs"), F.min("path").alias("conv_id"), F.sum("leaf").alias("n_leaves"))
    table = table.join(counts.withColumnRenamed("at", "end"), "end")
    for depth, name in (("above", "to_start"), ("below", "to_end")):
        totals = steps.select(F.col("path").alias("owner"), F.col("depth").alias(depth), F.col("total").alias(name))
        table = table.join(totals, ["owner", depth], "left").fillna(0, [name])
    own = (F.col("n_convs") - 1) * (F.col("to_end") - F.col("to_start"))
    table = materialise(table.withColumn("edge_tokens", own), "counted")
    # A node's own sum stands on its owner's path alone, so that the sums of the paths through a node hold each once.
    weighed = on_path.join(table.select(F.col("end").alias("at"), "edge_tokens"), "at").select(
        "path", "at", F.when(F.col("owner") == F.col("path"), F.col("edge_tokens")).otherwise(0).alias("mine"), (-F.col("depth")).alias("from_end")
    )
    summed = running(weighed, "path", "from_end", {"further": (F.sum, "mine", _add)})
    below = summed.groupBy(F.col("at").alias("end")).agg(F.sum("further").alias("below_tokens"))
    return table.join(below, "end")


def _expanded(compact: DataFrame, steps: DataFrame, ends: DataFrame) -> DataFrame:
    """Each edge as its turns, from the top one to the node's end."""
    parents = compact.select(F.col("end").alias("start"), F.col("conv_id").alias("upper_id"))
    edges = compact.join(parents, "start", "left")
    along = edges.filter("owner is not null").join(
        steps.select(F.col("path").alias("owner"), "depth", F.col("total").alias("to_here"), F.col("size").alias("own_size")), "owner"
    ).filter("depth > above and depth <= below")
    top = edges.filter("owner is null").select("*", F.col("below").alias("depth"), F.lit(0).cast("long").alias("to_here"), F.lit(0).cast("long").alias("own_size"))
    rows = along.select(*top.columns).unionByName(top)
    at_end = F.col("depth") == F.col("below")
    passed = F.col("to_here") - F.col("own_size") - F.col("to_start")
    nothing = hashlib.sha256(b"").hexdigest()
    digests = ends.withColumnRenamed("at", "end_at")
    return rows.withColumn("end_at", F.when(at_end, F.col("end"))).join(digests, "end_at", "left").select(
        "conv_id", "depth",
        F.when(F.col("depth") > F.col("above") + 1, F.col("conv_id")).otherwise(F.col("upper_id")).alias("parent_conv_id"),
        "n_convs", F.when(at_end, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves",
        (F.col("below_tokens") - (F.col("n_convs") - 1) * passed).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
