"""Prefix trie of conversations: subtree sums from an Euler tour that is list-ranked over all partitions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.llm.common import Scratch, fan_out, join_groups

STRETCH = 4_096  # turns of one conversation, and ids of one node's ends, that are taken together
NODES = 250_000  # of the trie that one task holds
NO_ENDS = hashlib.sha256(b"").hexdigest()
KEY = ["depth", "h1", "h2"]


def numbered(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, pos from 1, a, b, chars) of each turn: two 64-bit hashes of role and text, and the text's code points.

    Turns go by number (null first), then by role and text. All rows are sorted together, so that a conversation which
    holds a third of them lies in as many partitions; its turns are then counted from the counts of these. Null roles and
    texts count as empty; rows without a conv_id take no part.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    both = [F.xxhash64(F.lit(k), "role", "text").alias(c) for k, c in ((1, "a"), (2, "b"))]
    placed = rows.repartitionByRange(fan_out(conversations), *order).sortWithinPartitions(*order).select("conv_id", F.monotonically_increasing_id().alias("at"), *both, F.length("text").cast("long").alias("chars"))
    placed = scratch.keep(placed, "turns").withColumn("part", F.shiftright("at", 33))
    runs = placed.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("conv_id", "part", (F.col("first") - before - 1).alias("from"))
    return scratch.keep(placed.join(runs, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("from")).alias("pos"), "a", "b", "chars"), "numbered")


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths and conversations of numbered turns, for trie()."""
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))
    total = turns.count()
    return join_groups(turns, convs, ["conv_id"], "length", total).withColumnRenamed("pos", "depth"), convs


def rebuilt(turns: DataFrame, scratch: Scratch, block: int = 100, shares: int = 6) -> tuple[DataFrame, DataFrame]:
    """Paths and conversations, each conversation c begun as the first of its block: the first h turns of c - c % block (all if
    fewer), then c's own after its first h; h = crc32(c) % shares. c % block has c's sign."""
    c = F.col("conv_id")
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).withColumns({"h": F.crc32(c.cast("string").cast("binary")) % shares, "base": c - c % block})
    convs = scratch.keep(convs, "conversations")
    lent = convs.select(c.alias("base"), F.col("own").alias("there"))
    convs = convs.join(lent, "base", "left").withColumn("lent", F.least("h", F.coalesce("there", F.lit(0))))
    convs = scratch.keep(convs.select("conv_id", "base", "h", "own", "lent", (F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    own = join_groups(turns, convs.drop("base"), ["conv_id"], "own", turns.count()).where("pos > h").withColumn("depth", F.col("pos") - F.col("h") + F.col("lent"))
    heads = turns.where(F.col("pos") < shares).withColumnsRenamed({"conv_id": "base", "pos": "depth"})
    taken = convs.where("lent > 0").select("conv_id", "base", "lent", "length").join(heads, "base").where("depth <= lent")
    columns = ["conv_id", "depth", "length", "a", "b", "chars"]
    return own.select(*columns).unionByName(taken.select(*columns)), convs.select("conv_id", "length")


def prefixes(paths: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, depth, length, chars, (h1, h2): the 128-bit key of the path so far, (p1, p2): its parent's.

    A key is the exclusive or of the hashes of (depth, turn) up to its depth, so that it needs no chain along a
    conversation: stretches of a bounded number of turns are summed apart and begin from the sums before them.
    """
    terms = paths.withColumns({"t1": F.xxhash64("a", "depth", F.lit(1)), "t2": F.xxhash64("b", "depth", F.lit(2)), "stretch": F.floor((F.col("depth") - 1) / STRETCH)})
    sums = terms.where(F.col("length") > STRETCH).groupBy("conv_id", "stretch").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    before = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "stretch", *(F.bit_xor(s).over(before).alias(s) for s in ("s1", "s2")))
    w = Window.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    inside = terms.withColumns({"x1": F.bit_xor("t1").over(w), "x2": F.bit_xor("t2").over(w)}).join(sums, ["conv_id", "stretch"], "left")
    keys = inside.withColumns({f"h{k}": F.col(f"x{k}").bitwiseXOR(F.coalesce(f"s{k}", F.lit(0))) for k in (1, 2)})
    return scratch.keep(keys.select("conv_id", "depth", "length", "chars", "h1", "h2", *(F.col(f"h{k}").bitwiseXOR(F.col(f"t{k}")).alias(f"p{k}") for k in (1, 2))), "prefixes")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, from chunks in order: one chunk is held at a time."""
    now, digest = None, None

    def row():
        return pa.record_batch([pa.array([x]) for x in (*now, digest.hexdigest())], ["depth", "h1", "h2", "ends_sha256"])

    for batch in batches:
        keys, sums = [], []
        for *key, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if key == now:
                digest.update(b"," + ids.encode())
                continue
            if now is not None:
                keys.append(now)
                sums.append(digest.hexdigest())
            now, digest = key, hashlib.sha256(ids.encode())
        if keys:
            yield pa.record_batch([*(pa.array(x, pa.int64()) for x in zip(*keys, strict=True)), pa.array(sums)], ["depth", "h1", "h2", "ends_sha256"])
    if now is not None:
        yield row()


def end_digests(ends: DataFrame, parts: int) -> DataFrame:
    """depth, h1, h2, ends_sha256 of the nodes at which conversations end. ends: depth, h1, h2, conv_id, distinct.

    Ids come together by ranges of STRETCH, so that no list is longer; the chunks of a node are hashed in order, as a stream.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    chunks = ends.groupBy(*KEY, F.floor(F.col("conv_id") / STRETCH).alias("chunk")).agg(ids.alias("ids"))
    chunks = chunks.repartition(parts, *KEY).sortWithinPartitions(*KEY, "chunk").select(*(F.col(c).cast("long") for c in KEY), "ids")
    return chunks.mapInArrow(_hashed, "depth long, h1 long, h2 long, ends_sha256 string")


def siblings(nodes: DataFrame, scratch: Scratch, parts: int) -> DataFrame:
    """(conv_id, depth, next): the sibling with the next higher conv_id, for nodes that have one. A parent with a third of all
    nodes as children has them sorted over many partitions; only each partition's first is looked up by those before it."""
    order = ["parent_conv_id", "depth", "conv_id"]
    rows = nodes.where("siblings > 1").select(*order).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    rows = scratch.keep(rows, "siblings")
    group = ["parent_conv_id", "depth"]
    firsts = rows.groupBy(*group, "part").agg(F.min("conv_id").alias("first"))
    firsts = firsts.select(*group, "part", F.lead("first").over(Window.partitionBy(*group).orderBy("part")).alias("later"))
    lead = F.lead("conv_id").over(Window.partitionBy(*group, "part").orderBy("conv_id"))
    return rows.withColumn("lead", lead).join(firsts, [*group, "part"]).select("conv_id", "depth", F.coalesce("lead", "later").alias("next")).where("next is not null")


def _find(conv: np.ndarray, depth: np.ndarray):
    """A function from (conv_id, depth) to the row that has both, or -1."""
    ids, at = np.unique(conv, return_inverse=True)
    width = int(depth.max()) + 2
    code = at * width + depth
    order = np.argsort(code)
    code = code[order]

    def find(c: np.ndarray, d: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(ids, c), len(ids) - 1)
        known = (ids[i] == c) & (d >= 0) & (d < width)
        want = np.where(known, i * width + d, -1)
        j = np.minimum(np.searchsorted(code, want), len(code) - 1)
        return np.where(known & (code[j] == want), order[j], -1)

    return find


def contract(conv: np.ndarray, depth: np.ndarray, child: np.ndarray, sibling: np.ndarray, parent: np.ndarray, weights: np.ndarray):
    """The stretches of the tour that run inside a set of nodes.

    Arc 2i enters node i, arc 2i + 1 leaves it; -1 as child or sibling: none. An enter arc is followed by that of the first child, or the
    node's own exit; an exit arc by the enter arc of the next sibling, or the parent's exit. weights: rows of (arcs, leaves, saved) for
    each arc. Returns each arc's stretch and the weights before it in the stretch, and per stretch its first arc, its whole
    weights, and the (conv_id, arc code) that follows; the code is 2 * depth, and one more for an exit.
    """
    m = len(conv)
    find = _find(conv, depth)
    next_conv = np.empty(2 * m, np.int64)
    next_code = np.empty(2 * m, np.int64)
    has_child, has_next = child >= 0, sibling >= 0
    next_conv[0::2], next_code[0::2] = np.where(has_child, child, conv), np.where(has_child, 2 * depth + 2, 2 * depth + 1)
    next_conv[1::2], next_code[1::2] = np.where(has_next, sibling, parent), np.where(has_next, 2 * depth, 2 * depth - 1)
    node = find(next_conv, next_code // 2)
    follows = np.where(node >= 0, 2 * node + next_code % 2, -1)
    back = np.arange(2 * m)
    inner = np.flatnonzero(follows >= 0)
    back[follows[inner]] = inner
    before = np.where((back != np.arange(2 * m))[:, None], weights[back], 0)
    while True:  # each step doubles how far an arc looks back
        further = back[back]
        if (further == back).all():
            break
        before, back = before + before[back], further
    tails = np.flatnonzero(follows < 0)
    heads = back[tails]
    stretch = np.empty(2 * m, np.int64)
    stretch[heads] = np.arange(len(heads))
    return stretch[back], before, heads, before[tails] + weights[tails], next_conv[tails], next_code[tails]


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, ends_sha256 string"
STRETCHES = "head_conv long, head_code long, next_conv long, next_code long"
SUMS = ("arcs", "leaves", "saved")
CONTRACTED = f"part int, {NODE}, enter long, enter_arcs long, enter_leaves long, enter_saved long, exit long, exit_arcs long, exit_leaves long, exit_saved long, stretch long, {STRETCHES}, arcs long, leaves long, saved long"


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition's nodes with the stretches of both arcs, then rows of its stretches."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    t = pa.Table.from_batches(batches)
    long = lambda c: t[c].to_numpy()
    conv, depth = long("conv_id"), long("depth")
    weights = np.zeros((2 * len(conv), 3), np.int64)
    weights[:, 0] = 1
    weights[0::2, 1], weights[0::2, 2] = long("n_children") == 0, long("saved")
    # Ids may be negative: what is missing is told by flags, and -1 stands for it after numbering within the partition only.
    ids = np.unique(np.concatenate([conv, long("child"), long("sibling"), long("parent")]))
    number = lambda c: np.searchsorted(ids, c)
    child = np.where(long("has_child"), number(long("child")), -1)
    sibling = np.where(long("has_sibling"), number(long("sibling")), -1)
    stretch, before, heads, whole, next_conv, next_code = contract(number(conv), depth, child, sibling, number(long("parent")), weights)
    part = TaskContext.get().partitionId()
    schema = pa.schema([(f.split()[0], pa.int32() if f.endswith(" int") else pa.string() if f.endswith("string") else pa.int64()) for f in CONTRACTED.split(", ")])

    def filled(n: int, **columns) -> pa.RecordBatch:
        columns["part"] = np.full(n, part, np.int32)
        return pa.record_batch([c if isinstance(c := columns.get(f.name), pa.Array) else pa.nulls(n, f.type) if c is None else pa.array(c, f.type) for f in schema], schema=schema)

    own = {c: t[c].combine_chunks() for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "ends_sha256")}
    sums = {f"{arc}_{s}": before[k::2, i] for k, arc in enumerate(("enter", "exit")) for i, s in enumerate(SUMS)}
    nodes = filled(len(conv), **own, enter=stretch[0::2], exit=stretch[1::2], **sums)
    for at in range(0, len(conv), 10_000):
        yield nodes.slice(at, 10_000)
    last = next_code < 0  # the root's exit
    links = {"next_conv": pa.array(ids[next_conv], pa.int64(), mask=last), "next_code": pa.array(next_code, pa.int64(), mask=last)}
    stretches = filled(len(heads), stretch=np.arange(len(heads)), head_conv=conv[heads // 2], head_code=2 * depth[heads // 2] + heads % 2, **links, **{s: whole[:, i] for i, s in enumerate(SUMS)})
    for at in range(0, len(heads), 10_000):
        yield stretches.slice(at, 10_000)


def rank(stretches: DataFrame, scratch: Scratch) -> DataFrame:
    """arcs, leaves and saved of each stretch become the sums from its first arc to the end of the tour.

    Pointer jumping: each round adds what the stretch pointed to has gathered, and takes over its pointer. Every stretch is pointed to by
    one other at most, so that no join is skewed; rounds grow with the logarithm of the number of stretches.
    """
    now = scratch.keep(stretches, "stretches")
    while not now.where("next_conv is not null").limit(1).isEmpty():
        there = now.select(F.col("head_conv").alias("next_conv"), F.col("head_code").alias("next_code"), F.col("next_conv").alias("then_conv"), F.col("next_code").alias("then_code"), *(F.col(s).alias(f"then_{s}") for s in SUMS))
        joined = now.join(there, ["next_conv", "next_code"], "left")
        sums = [(F.col(s) + F.coalesce(f"then_{s}", F.lit(0))).alias(s) for s in SUMS]
        new = scratch.keep(joined.select("part", "stretch", "head_conv", "head_code", F.col("then_conv").alias("next_conv"), F.col("then_code").alias("next_code"), *sums), "stretches")
        scratch.drop(now)
        now = new
    return now


RESULT = f"{NODE}, n_leaves long, saved_tokens long, enter_at long, exit_at long"


def _resolved(total: int):
    def run(nodes: pa.Table, stretches: pa.Table) -> pa.Table:
        after = np.zeros((stretches.num_rows, 3), np.int64)
        at = stretches["stretch"].to_numpy()
        for i, s in enumerate(SUMS):
            after[at, i] = stretches[s].to_numpy()
        # What lies from an arc to the end of the tour: its stretch's, without what comes before it there.
        enter, exit_ = (after[nodes[arc].to_numpy()] - np.stack([nodes[f"{arc}_{s}"].to_numpy() for s in SUMS], 1) for arc in ("enter", "exit"))
        subtree = enter - exit_
        own = {f.split()[0]: nodes[f.split()[0]] for f in NODE.split(", ")}
        return pa.table({**own, "n_leaves": subtree[:, 1], "saved_tokens": subtree[:, 2], "enter_at": total - enter[:, 0], "exit_at": total - exit_[:, 0]})

    return run


def trie(paths: DataFrame, convs: DataFrame, scratch: Scratch, parts: int, nodes_per_task: int = NODES) -> DataFrame:
    """One row per node of the trie of all paths: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and where the Euler tour enters and leaves it (enter_at, exit_at, from 0).

    paths: conv_id, depth (1 to length, without gaps), length, a, b, chars; convs: conv_id, length, conversations without turns too. Nodes are known
    by the 128-bit keys of their paths. Children come by conv_id. No conversations, no rows: not even a root.
    """
    rows = prefixes(paths, scratch)
    grouped = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(*(zero.alias(c) for c in KEY), "conv_id", "n_convs", zero.alias("chars"), *(F.lit(None).cast("long").alias(c) for c in ("p1", "p2")))
    nodes = scratch.keep(grouped.unionByName(root), "nodes")
    total = nodes.count()
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(F.count(F.lit(1)).alias("n_children"), F.min("conv_id").alias("child"))
    ends = rows.where("depth = length").select(*KEY, "conv_id").unionByName(convs.where("length = 0").select(*(zero.alias(c) for c in KEY), "conv_id"))
    nodes = nodes.join(kids, KEY, "left").join(end_digests(ends, parts), KEY, "left").withColumns({"n_children": F.coalesce("n_children", zero), "ends_sha256": F.coalesce("ends_sha256", F.lit(NO_ENDS))})
    nodes = scratch.keep(nodes, "nodes")
    up = [F.col("depth").alias("up"), F.col("h1").alias("p1"), F.col("h2").alias("p2")]
    parents = nodes.where("n_children > 0").select(*up, F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"))
    nodes = scratch.keep(join_groups(nodes.withColumn("up", F.col("depth") - 1), parents, ["up", "p1", "p2"], "siblings", total), "nodes")
    nodes = nodes.join(siblings(nodes, scratch, parts), ["conv_id", "depth"], "left")
    or_own = lambda c: F.coalesce(c, "conv_id")
    arcs = nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "ends_sha256",
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), or_own("child").alias("child"), F.col("child").isNotNull().alias("has_child"), or_own("next").alias("sibling"), F.col("next").isNotNull().alias("has_sibling"), or_own("parent_conv_id").alias("parent"),
    )
    by_place = arcs.repartitionByRange(max(parts, -(-total // nodes_per_task)), "conv_id", "depth")
    contracted = scratch.keep(by_place.mapInArrow(_contracted, CONTRACTED), "contracted")
    ranked = rank(contracted.where("stretch is not null").select("part", "stretch", "head_conv", "head_code", "next_conv", "next_code", *SUMS), scratch)
    own = contracted.where("stretch is null")
    return own.groupBy("part").cogroup(ranked.groupBy("part")).applyInArrow(_resolved(2 * total), RESULT)


def prefix_trie(conversations: DataFrame, block: int | None = 100, shares: int = 6) -> DataFrame:
    """The trie of all conversations (conv_id, turn, role, text), each rebuilt on the first one of its block; block None: as they are.

    Null roles and texts are empty, null turns come first, turns of one number go by role and text, repeated rows count as
    turns of their own, rows without conv_id take no part. Other columns are not read.
    """
    scratch = Scratch(conversations.sparkSession, "trie")
    turns = numbered(conversations, scratch)
    paths, convs = as_they_are(turns) if block is None else rebuilt(turns, scratch, block, shares)
    return trie(paths, convs, scratch, fan_out(conversations))
