"""Operator 3: near-duplicate vectors by NN-descent.

1.  Equal vectors fold into one class, with a count, by a fingerprint of 128 bits.
2.  Leaves of a few random-hyperplane trees give each class its first neighbours.  A leaf that holds
    more than its share is split by hash, so no task gathers more than LEAF vectors.
3.  Rounds of the local join: each class looks at its neighbours and reverse neighbours, compares
    those that are new with the others, and proposes each to the other if it beats the worst one there.
    Lists hold K, and four times as many where they are saturated with links.  Links that a list has no room for
    still join components: each step hands on chains through the groups that all links it saw make up.
4.  Edges at or above the threshold and chains give components.  Inside a component the lists are enlarged to the
    whole component: tiles of bounded size count, in double precision, the links of each class; pairs are not emitted.
5.  The recall is audited: the links of a sample of classes are counted against all classes.  It is the mean over
    linked classes, for those of few and of many links apart, so a large group outweighs nothing; the sample grows until
    it holds LINKED classes of few links, or AUDIT classes.  While less than the goal was found, more trees and rounds
    follow; after the last attempt, all classes are compared with all, in tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempora.llm.common import components, contracted, cut, forest, parallelism, prepare, reads, release, tidied

K, LEAF, TILE, AUDIT, LINKED = 10, 512, 2048, 4096, 64
#: Rows that one pass of the comparison of all classes deals out.
PASS_ROWS = 20_000_000


def _unit(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors in double precision) of a list column, for each length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    out = []
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        m = flat[(starts[rows][:, None] + np.arange(d)).ravel()].reshape(len(rows), d)
        m = m / np.abs(m).max(1, keepdims=True)
        out.append((rows, m / np.linalg.norm(m, axis=1, keepdims=True)))
    return out


def _codes(trees: int, bits: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.zeros((batch.num_rows, trees), np.int64)
            for rows, m in _unit(batch.column("embedding")):
                planes = np.random.default_rng([seed, m.shape[1]]).standard_normal((m.shape[1], trees * bits))
                on = (m @ planes > 0).reshape(len(rows), trees, bits)
                codes[rows] = (on << np.arange(bits)).sum(2) * 4096 + m.shape[1] % 4096
            tree = np.tile(np.arange(trees), batch.num_rows)
            at = np.repeat(np.arange(batch.num_rows), trees)
            yield pa.RecordBatch.from_arrays([batch.column("cid").take(pa.array(at)), pa.array(tree.astype(np.int32)), pa.array(codes.ravel())], names=["cid", "tree", "code"])

    return run


def _best(u: np.ndarray, v: np.ndarray, sim: np.ndarray, k: int, threshold: float) -> np.ndarray:
    """Rows of the k nearest of each u (4 k of them while they are links)."""
    order = np.lexsort((v, -sim, u))
    u = u[order]
    first = np.ones(len(u), bool)
    first[1:] = u[1:] != u[:-1]
    rank = np.arange(len(u)) - np.maximum.accumulate(np.where(first, np.arange(len(u)), 0))
    return order[(rank < k) | ((sim[order] >= threshold) & (rank < 4 * k))]


def _chains(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges along each component of the edges (a, b), at most two at an id."""
    root, member = forest(a, b)
    order = np.lexsort((member, root))
    root, member = root[order], member[order]
    before = root.copy()
    same = np.flatnonzero(root[1:] == root[:-1]) + 1
    before[same] = member[same - 1]
    return before, member


def _edges(us: list[np.ndarray], vs: list[np.ndarray], sims: list[np.ndarray], a: list[np.ndarray], b: list[np.ndarray]) -> pa.Table:
    """Proposals (u, v, sim), and chains (chain is true) through what the links (a, b) join."""
    x, y = _chains(np.concatenate(a), np.concatenate(b)) if a else (np.array([], np.int64),) * 2
    u, v, sim = (np.concatenate([*z, e]) for z, e in ((us, x), (vs, y), (sims, np.ones(len(x)))))
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "sim": pa.array(sim, pa.float64()), "chain": pa.array(np.arange(len(u)) >= len(u) - len(x))})


def _leaf(k: int, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        ids, us, vs, sims, left, right = table.column("cid").to_numpy(), [], [], [], [], []
        leaf = table.column("leaf").to_numpy()
        order = np.lexsort((ids, leaf))
        for rows in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
            if len(rows) < 2:
                continue
            for inner, m in _unit(table.column("embedding").take(pa.array(rows))):
                own = ids[rows][inner]
                s = m @ m.T
                np.fill_diagonal(s, -2)
                n = min(k, len(own) - 1)
                if n < 1:
                    continue
                top = np.argpartition(-s, n - 1, axis=1)[:, :n]
                us.append(np.repeat(own, n))
                vs.append(own[top].ravel())
                sims.append(np.take_along_axis(s, top, 1).ravel())
                a, b = np.nonzero(np.triu(s >= threshold, 1))
                if len(a):
                    a, b = _chains(a, b)
                    left.append(own[a])
                    right.append(own[b])
        return _edges(us, vs, sims, left, right)

    return run


def _local_join(k: int, threshold: float):
    """Of one bucket of classes: compare each one's neighbours with each other, and propose what may be nearer."""

    def run(table: pa.Table) -> pa.Table:
        u, v = table.column("u").to_numpy(), table.column("v").to_numpy()
        new, worst = table.column("fresh").to_numpy(zero_copy_only=False).astype(bool), table.column("worst").to_numpy()
        linked = table.column("sim").to_numpy() >= threshold
        us, vs, sims, left, right = [], [], [], [], []
        for kind, m in _unit(table.column("embedding")):
            order = kind[np.argsort(u[kind], kind="stable")]
            place = np.empty(len(u), np.int64)
            place[kind] = np.arange(len(kind))
            for rows in np.split(order, np.flatnonzero(np.diff(u[order])) + 1):
                if len(rows) < 2 or not new[rows].any():
                    continue
                x = m[place[rows]]
                s = x @ x.T
                wanted = (new[rows][:, None] | new[rows][None, :]) & (s > worst[rows][:, None]) & (v[rows][:, None] != v[rows][None, :])
                a, b = np.nonzero(wanted)
                us.append(v[rows][a])
                vs.append(v[rows][b])
                sims.append(s[a, b])
                far = np.flatnonzero(~linked[rows])  # links of u are joined by u itself
                a, b = np.nonzero((s[far] >= threshold) & (v[rows][far][:, None] != v[rows][None, :]))
                if len(a):
                    left.append(v[rows][far[a]])
                    right.append(v[rows][b])
        if not us:
            return _edges([], [], [], left, right)
        a, b, s = np.concatenate(us), np.concatenate(vs), np.concatenate(sims)
        order = np.lexsort((b, a))
        a, b, s = a[order], b[order], s[order]
        single = np.ones(len(a), bool)
        single[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b, s = a[single], b[single], s[single]
        keep = _best(a, b, s, k, threshold)
        return _edges([a[keep]], [b[keep]], [s[keep]], left, right)

    return run


def _count_links(threshold: float):
    """Links of the classes of one pair of tiles (side 0 and 1; one tile: side 0 only), weighted by copies."""

    def run(table: pa.Table) -> pa.Table:
        ids, side, copies, comp = (table.column(c).to_numpy() for c in ("cid", "side", "copies", "comp"))
        order = np.argsort(comp, kind="stable")
        out_id, out_n = [], []
        for rows in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
            for inner, m in _unit(table.column("embedding").take(pa.array(rows))):
                r = rows[inner]
                a, b = np.flatnonzero(side[r] == 0), np.flatnonzero(side[r] == 1)
                for x, y in ((a, b), (b, a)) if len(b) else ((a, a),):
                    hit = m[x] @ m[y].T >= threshold
                    if x is y:
                        np.fill_diagonal(hit, False)
                    out_id.append(ids[r][x])
                    out_n.append(hit @ copies[r][y])
        return pa.table({"cid": pa.array(np.concatenate(out_id) if out_id else [], pa.int64()), "links": pa.array(np.concatenate(out_n) if out_n else [], pa.int64())})

    return run


def _tile_chains(threshold: float):
    """Chains through what the links of one pair of tiles join."""

    def run(table: pa.Table) -> pa.Table:
        ids, side = table.column("cid").to_numpy(), table.column("side").to_numpy()
        left, right = [], []
        for r, m in _unit(table.column("embedding")):
            a = np.flatnonzero(side[r] == 0)
            b = np.flatnonzero(side[r] == 1) if (side == 1).any() else a
            x, y = np.nonzero(m[a] @ m[b].T >= threshold)
            x, y = a[x], b[y]
            if (x != y).any():
                x, y = _chains(x[x != y], y[x != y])
                left.append(ids[r][x])
                right.append(ids[r][y])
        return pa.table({"src": pa.array(np.concatenate(left) if left else [], pa.int64()), "dst": pa.array(np.concatenate(right) if right else [], pa.int64())})

    return run


def _queries(sample, threshold: float):
    """Links of the sample's vectors with all of one partition, counted in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, groups = sample.value
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            copies, own = batch.column("copies").to_numpy(), batch.column("cid").to_numpy()
            for rows, m in _unit(batch.column("embedding")):
                for which, x in groups:
                    if x.shape[1] != m.shape[1]:
                        continue
                    for at in range(0, len(which), 512):
                        q = which[at : at + 512]
                        total[q] += copies[rows] @ ((m @ x[at : at + 512].T >= threshold) & (own[rows][:, None] != ids[q][None, :]))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids[some], pa.int64()), pa.array(total[some])], names=["cid", "links"])

    return run


def audited(classes: DataFrame, n: int, threshold: float, few: int) -> dict[int, int]:
    """True links of a sample of about AUDIT classes at most; it grows until LINKED of them have some links, but no more than few.

    Classes are drawn by a hash of their vectors, so the sample is the same however they lie.
    """
    spark, real, size, low = classes.sparkSession, {}, 256, 0
    while True:
        high = (1 << 40) if size >= n else int(size / n * (1 << 40))
        place = F.pmod(F.xxhash64("fp_a", "fp_b"), F.lit(1 << 40))
        drawn = sorted(classes.where((place >= low) & (place < high)).select("cid", "embedding").collect())  # about AUDIT vectors at most
        groups = _unit(pa.array([r.embedding for r in drawn], pa.list_(pa.float64()))) if drawn else []
        sample = spark.sparkContext.broadcast((np.array([r.cid for r in drawn], np.int64), groups))
        truth = classes.select("cid", "copies", "embedding").repartition(parallelism(spark)).mapInArrow(_queries(sample, threshold), "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))
        real |= {r.cid: 0 for r in drawn} | {r.cid: r.links for r in truth.collect()}  # about AUDIT rows at most
        if size >= min(n, AUDIT) or sum(0 < x <= few for x in real.values()) >= LINKED:
            return real
        size, low = min(size * 4, AUDIT), high


def recall(real: dict[int, int], got: dict[int, int], few: int) -> float:
    """The mean share of a linked class's links that was found: of classes with few or with more links, the lower one."""
    found = [(x, min(got.get(c, 0), x) / x) for c, x in real.items() if x]
    kinds = [[r for x, r in found if x <= few], [r for x, r in found if x > few]]
    return min((sum(r) / len(r) for r in kinds if r), default=1.0)


def enough_trees(bits: int, threshold: float, goal: float) -> int:
    """Trees of which one at least has both ends of a link, at the threshold, in one leaf with the probability goal."""
    together = (1 - np.arccos(np.clip(threshold, -1, 1)) / np.pi) ** bits
    return int(np.ceil(np.log(1 - goal) / np.log1p(-np.clip(together, 1e-9, 1 - 1e-9))))


def _tiled(members: DataFrame) -> DataFrame:
    """members (cid, comp, ...) with tiles: how many tiles a component of more than one is cut into, null for all others.

    A large component meets its number of tiles in as many places as there are partitions, so no task has all of it.
    """
    spread = parallelism(members.sparkSession)
    sizes = members.groupBy("comp").agg(F.ceil(F.count("*") / TILE).alias("tiles")).where("tiles > 1")
    sizes = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return members.withColumn("_salt", F.pmod(F.xxhash64("cid"), F.lit(spread)).cast("int")).join(sizes, ["comp", "_salt"], "left").drop("_salt")


def _dealt(members: DataFrame, packs: int, low: int = 0, high: int | None = None) -> DataFrame:
    """(cid, comp, copies, task, side) of the pairs of tiles of components of members (cid, comp, copies, tiles), first tiles from low to high.

    Components of one tile come with the first pass, several to a task.
    """
    size = members.where("tiles is not null").select("comp", "tiles").distinct()
    firsts = F.sequence(F.lit(low).cast("long"), F.col("tiles") - 1 if high is None else F.least(F.col("tiles") - 1, F.lit(high - 1).cast("long")))
    pairs = size.where(F.col("tiles") > low).select("comp", "tiles", F.explode(firsts).alias("a")).select("comp", "tiles", "a", F.explode(F.sequence(F.col("a"), F.col("tiles") - 1)).alias("b"))
    one = lambda tile, side: F.struct(F.col(tile).alias("salt"), F.lit(side).alias("side"))
    sides = pairs.select("comp", F.concat_ws("-", "comp", "a", "b").alias("task"), F.explode(F.when(F.col("a") == F.col("b"), F.array(one("a", 0))).otherwise(F.array(one("a", 0), one("b", 1)))).alias("x")).select("comp", "task", "x.salt", "x.side")
    large = members.where("tiles is not null").withColumn("salt", F.pmod(F.xxhash64("cid"), "tiles")).join(sides, ["comp", "salt"]).select("cid", "comp", "copies", "task", "side")
    if low:
        return large
    return large.unionByName(members.where("tiles is null").select("cid", "comp", "copies", F.pmod(F.xxhash64("comp"), F.lit(packs)).cast("string").alias("task"), F.lit(0).alias("side")))


def passes(members: DataFrame) -> Iterator[tuple[int, int]]:
    """Ranges of first tiles such that a pass deals about PASS_ROWS rows at most, and one tile of each component at least."""
    large = members.where("tiles is not null").agg(F.max("tiles").alias("tiles"), F.count("*").alias("n")).first()
    step = max(1, PASS_ROWS // (2 * large.n)) if large.n else 1
    for low in range(0, large.tiles or 1, step):
        yield low, low + step


def all_links(classes: DataFrame, n: int, threshold: float, packs: int) -> DataFrame:
    """Edges (src, dst) that join what the links of all classes join: every pair of tiles, in passes of bounded disk."""
    whole, edges = cut(_tiled(classes.select("cid", "copies", F.lit(0).cast("long").alias("comp"))), "vectors"), None
    for low, high in passes(whole):
        found = _dealt(whole, packs, low, high).join(classes.select("cid", "embedding"), "cid").groupBy("task").applyInArrow(tidied(_tile_chains(threshold)), "src long, dst long")
        both = cut(contracted(found if edges is None else found.unionByName(edges)), "vectors")
        if edges is not None:
            release(edges)
        edges = both
    release(whole)
    return edges


def counted_links(classes: DataFrame, members: DataFrame, threshold: float, packs: int) -> DataFrame:
    """(cid, links): links of each class inside its component of members (cid, comp, copies, tiles), counted in passes of bounded disk."""
    total = None
    for low, high in passes(members):
        found = _dealt(members, packs, low, high).join(classes.select("cid", "embedding"), "cid").groupBy("task").applyInArrow(tidied(_count_links(threshold)), "cid long, links long")
        both = cut((found if total is None else found.unionByName(total)).groupBy("cid").agg(F.sum("links").alias("links")), "vectors")
        if total is not None:
            release(total)
        total = both
    return total


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9, k: int = K, trees: int | None = None, rounds: int = 2, goal: float = 0.97, attempts: int = 3, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, ...).

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing; vectors of
    different lengths never link; vectors of any length are compared whole, in double precision.  Equal rows are separate
    vectors; rows with one vec_id too; rows without vec_id come after all others.  Components are named by their smallest
    vec_id.  Of neighbours that are equally near those made first are held, which decides no link.  Trees, if not given, grow with the table until a pair at the threshold meets in a
    leaf with the probability goal (or comparing all would cost no more).  A recall below the goal is never returned:
    after the last attempt all classes are compared with all, which costs the square of the table.  Extra columns are ignored; an empty table gives an empty result.
    """
    spark = prepare(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.withColumn("fp_a", F.xxhash64("embedding")).withColumn("fp_b", F.xxhash64(F.lit(1), "embedding"))
    sound = F.expr("embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)")
    classes = cut(rows.where(sound).groupBy("fp_a", "fp_b").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding")).withColumn("cid", F.monotonically_increasing_id()), "vectors")
    n = classes.count()
    parts = parallelism(spark)
    bits = int(np.clip(np.ceil(np.log2(max(n, 2) / 100)), 1, 40))
    trees = trees or max(4, min(enough_trees(bits, threshold, goal), n // LEAF))
    real = audited(classes, n, threshold, k)

    edge = "u long, v long, sim double, chain boolean"
    near = Window.partitionBy("u", "chain").orderBy(F.desc("sim"), "v")

    def shortened(e: DataFrame) -> DataFrame:
        return e.withColumn("rank", F.row_number().over(near)).where(F.col("chain") | (F.col("rank") <= k) | ((F.col("sim") >= threshold) & (F.col("rank") <= 4 * k)))

    packs = max(parts, n // 2000)

    def settled(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members (cid, rep, copies, comp, tiles) of the components of edges, and (cid, links), counted inside them."""
        comps = components(edges)
        members = cut(_tiled(classes.select("cid", "rep", "copies").join(comps, classes["cid"] == comps["id"]).select("cid", "rep", "copies", F.col("component_id").alias("comp"))), "vectors")
        release(comps)
        return members, counted_links(classes, members, threshold, packs)

    def found(links: DataFrame) -> float:
        return recall(real, {r.cid: r.links for r in links.where(F.col("cid").isin(list(real))).collect()} if real else {}, k)  # at most AUDIT rows

    graph = None
    for attempt in range(attempts):
        codes = cut(classes.mapInArrow(_codes(trees, bits, seed + attempt), "cid long, tree int, code long"), "vectors")
        full = codes.groupBy("tree", "code").count().where(F.col("count") > 1).select("tree", "code", F.ceil(F.col("count") / LEAF).alias("salts"))
        leaves = codes.join(full, ["tree", "code"]).select("cid", F.xxhash64("tree", "code", F.pmod(F.xxhash64("cid", "tree"), "salts")).alias("leaf"))
        first = leaves.join(classes.select("cid", "embedding"), "cid").withColumn("pack", F.pmod("leaf", F.lit(max(parts, n * trees // 5000)))).groupBy("pack").applyInArrow(tidied(_leaf(k, threshold)), edge).withColumn("fresh", F.lit(True))
        if graph is not None:
            first = first.unionByName(graph.select("u", "v", "sim", "chain", "fresh"))
        merged = first.groupBy("u", "v", "chain").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
        nxt = cut(shortened(merged), "vectors")
        if graph is not None:
            release(graph)
        graph = nxt
        release(codes)
        for _ in range(rounds):
            lists = graph.where(~F.col("chain"))
            back = lists.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim", "chain", "fresh")
            around = lists.select("u", "v", "sim", "fresh").unionByName(shortened(back).select("u", "v", "sim", "fresh")).groupBy("u", "v").agg(F.max("sim").alias("sim"), F.max("fresh").alias("fresh"))
            worst = lists.groupBy("u").agg(F.count("*").alias("held"), F.min("sim").alias("low")).select(F.col("u").alias("cid"), F.when(F.col("held") < k, -2.0).otherwise(F.col("low")).alias("worst"))
            nodes = classes.select("cid", "embedding").join(worst, "cid", "left").select(F.col("cid").alias("v"), "embedding", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
            buckets = max(parts, n // 2000)
            proposed = around.join(nodes, "v").withColumn("bucket", F.pmod(F.xxhash64("u"), F.lit(buckets))).groupBy("bucket").applyInArrow(tidied(_local_join(k, threshold)), edge)
            both = graph.select("u", "v", "sim", "chain", F.lit(False).alias("fresh")).unionByName(proposed.withColumn("fresh", F.lit(True)))
            nxt = cut(shortened(both.groupBy("u", "v", "chain").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))), "vectors")
            release(graph)
            graph = nxt
            if not graph.where("fresh and not chain").limit(1).count():
                break
        members, links = settled(graph.where(F.col("chain") | (F.col("sim") >= threshold)).select(F.col("u").alias("src"), F.col("v").alias("dst")))
        if found(links) >= goal:
            break
        release(members)
        release(links)
    else:
        edges = all_links(classes, n, threshold, packs)
        members, links = settled(edges)
        release(edges)
    release(graph)
    low = members.groupBy("comp").agg(F.min("rep").alias("component_id"))
    known = classes.select("cid", "fp_a", "fp_b", "copies", "rep").join(links, "cid", "left").join(members.select("cid", "comp"), "cid", "left").join(low, "comp", "left")
    known = known.select("fp_a", "fp_b", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    good = rows.where(sound).select("vec_id", "fp_a", "fp_b").join(known, ["fp_a", "fp_b"]).select("vec_id", "n_links", "component_id")
    bad = rows.where(~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return reads(good.unionByName(bad).withColumn("kept", F.col("vec_id") == F.col("component_id")), classes, members, links)
