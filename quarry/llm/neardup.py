"""Near copies by a chosen-path set similarity join.

A document's set holds the hashes of its distinct k-word shingles. Documents with one set form a class first, so
exact copies take part once. A class has `T` minwise values and a 128-bit sketch (one bit of each). In each of
several independent trees a class walks down from the root: a node picks one of the T values, and with
probability 1 / threshold - 1 a second, and the class goes to the child of that value. Nodes few classes reach
are compared exhaustively by sketch; in the others all are compared with the node's least member. What the
sketches let through is confirmed on full sets, the least candidate of each class first: most groups are then joined.
Where members of a node are still apart, only pairs across components are looked at, and of those only pairs that may
reach the threshold given how many shingles of each no other of these sets has (own shingles are never shared, so a
class with too many of them has no link at all). Where that is still much work, the
same sets are joined on their rarest shingles instead (a prefix filter, exact at the threshold); nothing is capped.

The depth grows with the logarithm of the number of classes; the number of trees is the smallest with which a pair
at the threshold meets with probability `recall`; over the chance of its T minwise values it misses more often (7e-6
at a million classes, computed).

Edge cases: fewer words than k make the whole sequence one shingle; no words or null text make an empty set,
linked with nothing; rows of one doc_id are one document, linked if any of its texts is (n_shingles is the row's own); a null doc_id is linked with nothing
and has a null component; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, stored, texts, word_hashes
from .graph import components

T = 128
LEAF = 24
NEAREST = 3
WORK, WORK_EACH = 50_000_000, 500
BROADCAST_IDS = 20_000
_rng = np.random.Generator(np.random.PCG64(20240229))
FACTORS = _rng.integers(1, 1 << 63, T, np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(1, 1 << 63, T, np.uint64)
C1, C2, C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
SIGNATURES = "doc_id long, n_shingles long, h1 long, h2 long, s0 long, s1 long, mins binary"


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The sorted distinct hashes of the k-word shingles, A-Z lower-cased."""
    h = word_hashes(text.lower())
    if not len(h):
        return h
    n = len(h) - k + 1
    if n < 1:
        n, k = 1, len(h)
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out = mix(out * C1 + h[j : j + n])
    return np.unique(out)


def minwise(values: np.ndarray) -> np.ndarray:
    """The T minwise values of a set, 32 bits each."""
    least = np.full(T, np.uint64((1 << 64) - 1))
    for a in range(0, len(values), 4096):
        part = values[a : a + 4096]
        np.minimum(least, ((part[None, :] ^ SHIFTS[:, None]) * FACTORS[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        names = ["doc_id", "n_shingles", "h1", "h2", "s0", "s1", "mins"]
        for batch in batches:
            sizes, h1, h2, sketches, mins = [], [], [], [], []
            for text in texts(batch.column(1)):
                values = shingle_set(text, k)
                sizes.append(len(values))
                h1.append(int(values.sum(dtype=np.uint64).view(np.int64)))
                h2.append(int(np.bitwise_xor.reduce(mix(values ^ C2), initial=np.uint64(0)).view(np.int64)))
                least = minwise(values)
                sketches.append(np.packbits((least & 1).astype(bool)).view(np.int64))
                mins.append(least.tobytes() if len(values) else b"")
            s = np.array(sketches, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array(mins, pa.binary())], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SIGNATURES)


def meet_probability(threshold: float, depth: int) -> float:
    """That a pair at the threshold shares a node at this depth of one tree."""
    second, f = 1 / threshold - 1, 1.0
    for _ in range(depth):
        q = threshold * f
        f = (1 - second) * q + second * (1 - (1 - q) ** 2)
    return f


def plan_trees(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(depth, trees) for n classes."""
    depth = max(1, math.ceil(math.log(max(n, 2) / 64, 16)))
    return depth, math.ceil(math.log(1 - recall) / math.log(1 - meet_probability(threshold, depth)))


def branch(nodes: np.ndarray, mins: np.ndarray, owner: np.ndarray, second: float) -> tuple[np.ndarray, np.ndarray]:
    """The children of nodes that their owners go to, and the owners; mins has a row per owner."""
    u = np.uint64
    i1 = (mix(nodes ^ C1) % u(T)).astype(np.int64)
    more = np.flatnonzero(mix(nodes ^ C2) < u(int(second * 2.0**63) * 2))
    i2 = (i1[more] + 1 + (mix(nodes[more] ^ C3) % u(T - 1)).astype(np.int64)) % T
    at, i = np.r_[np.arange(len(nodes)), more], np.r_[i1, i2]
    return mix(nodes[at] * C1 + mix(mins[owner[at], i].astype(np.uint64) * C3 + i.astype(np.uint64))), owner[at]


def _signs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def walk(classes: DataFrame, levels: int, threshold: float, trees: int) -> DataFrame:
    """(node, id, s0, s1) after so many levels from the roots of the trees."""
    second = 1 / threshold - 1

    def run(batches):
        for whole in batches:
            for a in range(0, len(whole), 2048):
                batch = whole.slice(a, 2048)
                n = len(batch)
                if not n:
                    continue
                mins = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).reshape(n, T)
                owner = np.repeat(np.arange(n), trees)
                nodes = mix(np.tile(np.arange(1, trees + 1, dtype=np.uint64), n) * C2)
                for _ in range(levels):
                    nodes, owner = branch(nodes, mins, owner, second)
                pick = [batch.column(c).to_numpy(zero_copy_only=False)[owner] for c in range(3)]
                yield pa.RecordBatch.from_arrays([_signs(nodes), *map(pa.array, pick)], ["node", "id", "s0", "s1"])

    return classes.select("id", "s0", "s1", "mins").mapInArrow(run, "node long, id long, s0 long, s1 long")


def differing(a0, a1, b0, b1) -> np.ndarray:
    return np.bitwise_count((a0 ^ b0).view(np.uint64)) + np.bitwise_count((a1 ^ b1).view(np.uint64))  # of signed numbers it would count the absolute value's


def sketch_limit(threshold: float) -> int:
    """Bits of 128 that may differ: the mean at the threshold and four and a half deviations."""
    p = (1 - threshold) / 2
    return math.ceil(T * p + 4.5 * math.sqrt(T * p * (1 - p)))


def attach(rows: DataFrame, per_node: DataFrame) -> DataFrame:
    """rows joined with a table of one row per node: broadcast while that is small, else dealt in a way that lets Spark split a hot node."""
    per_node = stored(per_node, "nodes")
    return rows.join(F.broadcast(per_node) if per_node.count() <= BROADCAST_IDS else per_node.hint("merge"), "node")


def compare(rows: DataFrame, limit: int) -> DataFrame:
    """Candidates (a, b) of nodes, and as (null, id, node, s0, s1) the members of nodes above LEAF.

    Members of a large node need its least member only, so its rows are dealt like any join's and may be split; only nodes
    of at most LEAF rows are brought together.
    """
    rows = stored(rows, "reached")
    met = stored(attach(rows, rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")), "met")
    large = met.where(F.col("n") > LEAF)
    least = large.groupBy("node").agg(F.min(F.struct("id", "s0", "s1")).alias("p"))
    names = ["a", "b", "node", "s0", "s1"]
    schema = "a long, b long, node long, s0 long, s1 long"

    def candidates(a, b):
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), none, none, none], names)

    def members(node, ids, s0, s1):
        return pa.RecordBatch.from_arrays([pa.nulls(len(ids), pa.int64()), pa.array(ids), pa.array(node), pa.array(s0), pa.array(s1)], names)

    def of_large(batches):
        for batch in batches:
            node, ids, s0, s1, p, p0, p1 = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            close = np.flatnonzero((differing(s0, s1, p0, p1) <= limit) & (ids != p))
            yield candidates(p[close], ids[close])
            yield members(node, ids, s0, s1)

    def of_small(batches):
        held = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            if len(now[0]):
                start = int(np.flatnonzero(now[0] == now[0][-1])[0])  # the last node may go on in the next batch
                held = [x[start:] for x in now]
                yield from out(*(x[:start] for x in now))
        if held is not None:
            yield from out(*held)

    def out(node, ids, s0, s1):
        near = [np.empty((3, 0), np.int64)]
        for k in range(1, LEAF):
            same = np.flatnonzero(node[k:] == node[:-k]) if len(node) > k else np.empty(0, np.int64)
            if not len(same):
                break
            bits = differing(s0[same], s1[same], s0[same + k], s1[same + k])
            near.append(np.stack([same + k, same, bits])[:, bits <= limit].astype(np.int64))
        kept = np.concatenate(near, axis=1)
        kept = kept[:, np.lexsort((kept[2], kept[0]))]
        close_by = np.arange(kept.shape[1]) - np.searchsorted(kept[0], kept[0], "left")
        yield candidates(ids[kept[0, close_by < NEAREST]], ids[kept[1, close_by < NEAREST]])
        more = np.flatnonzero(np.isin(node, node[kept[0, close_by >= NEAREST]]))  # not all close pairs of these nodes go out: their members do
        yield members(node[more], ids[more], s0[more], s1[more])

    small = met.where(F.col("n") <= LEAF).select("node", "id", "s0", "s1").repartition("node").sortWithinPartitions("node")
    seen = attach(large, least).select("node", "id", "s0", "s1", F.col("p.id").alias("p_id"), F.col("p.s0").alias("p0"), F.col("p.s1").alias("p1"))
    return seen.mapInArrow(of_large, schema).unionByName(small.mapInArrow(of_small, schema))


def full_sets(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(id, form, values) of the documents of a stored table of ids; rows of one id with different sets stay apart by form."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, k).view(np.int64) for t in texts(batch.column(1))]
            offsets = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            forms = pa.array([int(x.sum()) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), forms, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64)))], ["id", "form", "values"])

    return stored(rows.mapInArrow(run, "id long, form long, values array<bigint>").where(F.size("values") > 0).groupBy("id", "form").agg(F.first("values").alias("values")), "sets")


def confirm(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    percent = round(100 * threshold)

    def check(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = []
            for i in range(len(batch)):
                u, v = (c[i].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in (x, y))
                both = len(np.intersect1d(u, v, assume_unique=True)) if 100 * min(len(u), len(v)) >= percent * max(len(u), len(v)) else 0
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("values").alias("x")), "a")
    return stored(left.join(sets.select(F.col("id").alias("b"), F.col("values").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long").distinct(), "confirmed")


def own_shingles(sets: DataFrame) -> DataFrame:
    """(id, form, n, own): the size of each set, and how many of its shingles no other of these sets has."""
    single = sets.select("id", "form", F.explode("values").alias("value")).groupBy("value").agg(F.count("*").alias("c"), F.min(F.struct("id", "form")).alias("of")).where("c = 1")
    return sets.select("id", "form", F.size("values").cast("long").alias("n")).join(single.groupBy("of.id", "of.form").agg(F.count("*").alias("own")), ["id", "form"], "left").select("id", "form", "n", F.coalesce("own", F.lit(0)).alias("own"))


def common_shingles(sets: DataFrame) -> DataFrame:
    """(id, form, common): the shingles that some other of these sets has too; two sets share nothing else."""
    each = sets.select("id", "form", F.explode("values").alias("value"))
    several = each.groupBy("value").agg(F.count("*").alias("c")).where("c > 1").select("value")
    return each.join(several, "value").groupBy("id", "form").agg(F.collect_list("value").alias("common"))


def can_reach(a: str, b: str, percent: int):
    """Whether two sets may reach the threshold: what they share leaves out what is their own, what they span holds it."""
    c = lambda t, f: F.col(f"{t}.{f}")
    shared = F.least(c(a, "n") - c(a, "own"), c(b, "n") - c(b, "own"))
    spanned = F.greatest(c(a, "n") + c(b, "own"), c(b, "n") + c(a, "own"))
    return 100 * shared >= percent * spanned


def prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of members (id, form, component, n, own) across components that may reach the threshold: of the shingles of a set in
    one order, rarest first, two such sets share one of the first n - ceil(n * threshold) + 1."""
    each = sets.join(members.select("id").distinct(), "id", "left_semi").select("id", "form", F.size("values").alias("size"), F.explode("values").alias("value"))
    shared = each.groupBy("value").agg(F.count("*").alias("c")).where("c > 1")
    ranked = each.join(shared, "value", "left").withColumn("rank", F.row_number().over(Window.partitionBy("id", "form").orderBy(F.coalesce("c", F.lit(1)), "value")))
    first = ranked.where(F.col("c").isNotNull() & (F.col("rank") <= F.col("size") - F.ceil(F.col("size") * percent / 100 - 1e-9) + 1)).select("id", "form", "value")
    first = stored(first.join(members, ["id", "form"]), "prefixes")
    x, y = first.alias("x"), first.alias("y")
    met = x.join(y, (F.col("x.value") == F.col("y.value")) & (F.col("x.component") < F.col("y.component")) & can_reach("x", "y", percent))
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def same_document(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """The links (a, b) between classes that rows of one doc_id with different texts belong to."""
    key = ["h1", "h2", "n_shingles"]
    rows = signed.where("n_shingles > 0 and doc_id is not null").select("doc_id", F.struct(*key).alias("form"))
    several = rows.groupBy("doc_id").agg(F.min("form").alias("least"), F.max("form").alias("most")).where("least <> most").select("doc_id")
    of = rows.join(several, "doc_id").distinct().select("doc_id", "form.*").join(classes.select(*key, "id"), key)
    return of.join(of.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b")).where("a <> b")


def across(members: DataFrame) -> DataFrame:
    """The members (node, component, ..) of nodes that hold more than one component; the nodes' extremes are joined back, so a hot node may be split."""
    ends = members.groupBy("node").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("node")
    return attach(members, ends)


def near_copies(docs: DataFrame, k: int = 5, threshold: float = 0.8, recall: float = 1 - 1e-6) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text)."""
    signed = stored(signatures(docs, k), "signatures")
    grouped = signed.where("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2", "n_shingles").agg(F.min(F.struct("doc_id", "s0", "s1", "mins")).alias("m"))
    classes = stored(grouped.select(F.col("m.doc_id").alias("id"), "h1", "h2", "n_shingles", "m.s0", "m.s1", "m.mins"), "classes")
    limit, n, percent = sketch_limit(threshold), classes.count(), round(100 * threshold)
    depth, trees = plan_trees(n, threshold, recall)
    level = stored(compare(walk(classes, depth, threshold, trees), limit), "level")
    close = lambda x, y: F.bit_count(F.col(f"{x}.s0").bitwiseXOR(F.col(f"{y}.s0"))) + F.bit_count(F.col(f"{x}.s1").bitwiseXOR(F.col(f"{y}.s1"))) <= limit

    def apart(pairs):
        """Pairs whose ends lie in different components."""
        a, b = comps.select(F.col("id").alias("a"), F.col("component").alias("ca")), comps.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    # First each class with its least candidate only: that joins most groups, and leaves few pairs to confirm between them.
    pairs = stored(level.where("a <> b").select("a", "b").distinct(), "pairs")
    first = stored(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
    ids = lambda p: p.select(F.col("a").alias("id")).union(p.select(F.col("b").alias("id")))
    links = confirm(first, full_sets(stored(ids(first), "ids"), docs, k), threshold).unionByName(same_document(signed, classes))
    comps = stored(components(links), "components")
    rest = stored(apart(pairs.join(first, ["a", "b"], "left_anti")), "rest")
    members = level.where("a is null").select("node", F.col("b").alias("id"), "s0", "s1").join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = stored(across(stored(members, "members")), "open")
    wanted = stored(ids(rest).union(open_.select("id")).distinct(), "ids")
    if not wanted.isEmpty():
        sets = full_sets(wanted, docs, k)
        own = stored(own_shingles(sets), "own")
        # A set b that can be near a has at most (n - own) / threshold - own shingles: a needs such a member in its node.
        sized = stored(open_.join(own, "id"), "sized")
        shortest = sized.groupBy("node").agg(F.min("n").alias("shortest"))
        reached = percent * (F.col("shortest") + F.col("own")) <= 100 * (F.col("n") - F.col("own"))
        open_ = stored(across(stored(attach(sized, shortest).where(reached).drop("shortest"), "members")), "open")
        per = open_.groupBy("node", "component").agg(F.count("*").alias("m")).groupBy("node").agg((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))).alias("work"))
        work = per.agg(F.sum("work")).first()[0] or 0
        ends = [own.select(F.col("id").alias(c), F.struct("n", "own").alias(of)) for c, of in (("a", "x"), ("b", "y"))]
        found = rest.join(ends[0], "a").join(ends[1], "b").where(can_reach("x", "y", percent)).select("a", "b").distinct()
        if work > WORK + WORK_EACH * n:
            met = prefix_pairs(open_.select("id", "form", "component", "n", "own").distinct(), sets, percent)
        elif work:
            common = common_shingles(sets.join(open_.select("id").distinct(), "id", "left_semi"))
            nodes = open_.groupBy("id", "form").agg(F.collect_set("node").alias("nodes"))
            listed = stored(open_.join(nodes.join(common, ["id", "form"]), ["id", "form"]), "listed")
            x, y = listed.alias("x"), listed.alias("y")
            once = F.array_min(F.array_intersect("x.nodes", "y.nodes")) == F.col("x.node")  # a pair that shares several nodes is met in the least
            both = F.size(F.array_intersect("x.common", "y.common"))
            linked = 100 * both >= percent * (F.col("x.n") + F.col("y.n") - both)  # the cheap tests before it leave few pairs to this one
            cross = x.join(y, (F.col("x.node") == F.col("y.node")) & (F.col("x.component") < F.col("y.component")) & close("x", "y") & can_reach("x", "y", percent) & once & linked)
            met = cross.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
        confirmed = confirm(stored(found.unionByName(met).distinct() if work else found, "found"), sets, threshold)
        if not confirmed.isEmpty():
            comps = stored(components(comps.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(confirmed)), "components")

    of_class = classes.select("h1", "h2", "n_shingles", "id").join(comps, "id", "left").select("h1", "h2", "n_shingles", F.coalesce("component", "id").alias("component"))
    named = signed.select("doc_id", "n_shingles", "h1", "h2").join(of_class, ["h1", "h2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")))
    return named.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents that are the least of their group, with all their columns; rows of one doc_id and text stay together."""
    names = docs.columns
    dropped = near_copies(docs, k, threshold).where("not kept").select("doc_id").distinct()
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)]).withColumn("_id", F.col(f"c{names.index('doc_id')}").cast("long"))
    return inner.join(dropped, inner["_id"] == dropped["doc_id"], "left_anti").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
