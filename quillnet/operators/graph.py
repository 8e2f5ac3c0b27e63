"""Graphs as two tables: nodes (id) and edges (src, dst, weight) with src < dst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillnet.operators import blocks
from quillnet.operators.components import connected_components
from quillnet.operators.relational import join_checked, percentile, percentile_of_score, rank_all, rank_sum
from quillnet.session import cut, discard


def _members(members: DataFrame, group: str, item: str) -> DataFrame:
    return members.select(F.col(group).alias("g"), F.col(item).alias("i")).where("g is not null and i is not null")


def _sizes(m: DataFrame) -> tuple[int, float, int, bool]:
    """Members, pairs, the members of the largest group, and whether items are long numbers that fit into 32 bits; repeated members count again."""
    size, low = F.col("n").cast("double"), F.abs("i") < 2**31 if dict(m.dtypes)["i"] == "bigint" else F.lit(False)
    found = m.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min(low).alias("low")).agg(F.sum("n"), F.sum(size * (size - 1) / 2), F.max("n"), F.min("low"))
    return tuple(x or 0 for x in found.first())


def _crowded(m: DataFrame, pairs: int, sizes: tuple | None = None) -> bool:
    """Whether groups are so large that pairs should not be moved: more than ``pairs`` of them, and 64 times as many as members."""
    rows, most = (sizes or _sizes(m))[:2]
    return most > max(pairs, 64 * rows) and dict(m.dtypes)["i"] in ("tinyint", "smallint", "int", "bigint", "string", "date")


def _by_lists(m: DataFrame, rows: int, pairs: float, many: int = 1_000_000, share: float = 0.005, parts: int = 32) -> DataFrame:
    """(src, dst, weight) of groups that fit a row: each member moves with the list of those after it, and pairs are made where all
    lists of a member have met. Lists of members with more than ``share`` of the rows, found in a sample, are dealt over ``parts`` tasks."""
    sets = m.repartition("g").groupBy("g").agg(F.sort_array(F.collect_set("i")).alias("a")).where(F.size("a") > 1)
    at = sets.select(F.posexplode("a").alias("k", "src"), "a").select("src", F.slice("a", F.col("k") + 2, F.size("a")).alias("dst")).where(F.size("dst") > 0)
    some = min(1.0, many / rows) if rows > many else 0.0
    hubs = [r["i"] for r in m.sample(some, 7).groupBy("i").count().where(F.col("count") > share * some * rows).collect()] if some else []
    keys = ["src"]
    if hubs:
        keys = ["src", "part"]
        at = at.select("src", "dst", F.explode(F.when(F.col("src").isin(hubs), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))).alias("part"))
        own = F.filter("dst", lambda x: F.pmod(F.xxhash64(x), F.lit(parts)) == F.col("part"))
        at = at.withColumn("dst", F.when(F.col("src").isin(hubs), own).otherwise(F.col("dst")))
    n = int(pairs / many)
    dealt = at.repartition(n, *keys) if n > int(m.sparkSession.conf.get("spark.sql.shuffle.partitions")) else at.repartition(*keys)
    return dealt.select(*keys, F.explode("dst").alias("dst")).groupBy(*keys, "dst").agg(F.count(F.lit(1)).alias("weight")).select("src", "dst", "weight")


#: Pairs from which crowded groups are counted by blocks.
CROWDED = 50_000_000


def cooccurrence(members: DataFrame, group: str, item: str, hot: int = 2000, crowded: int = CROWDED) -> DataFrame:
    """How many groups hold both ends of each pair. Repeated members count once.

    Where no group has more than ``hot`` members, members move with lists of those after them. A larger group is dealt over several tasks: each
    takes a part of its left ends and all right ones. More than ``crowded`` pairs in large groups are counted by blocks of items (``operators.blocks``).
    """
    m = _members(members, group, item)
    sizes = _sizes(m)
    if _crowded(m, crowded, sizes):
        return blocks.edges(*blocks.blocked(m.distinct()))
    if sizes[2] <= hot:
        if sizes[3]:
            e = _by_lists(m.withColumn("i", F.col("i").cast("int")), *sizes[:2])
            return e.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "weight")
        return _by_lists(m, *sizes[:2])
    m = m.distinct()
    large = m.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot)
    on = [F.col("a.g") == F.col("b.g"), F.col("a.i") < F.col("b.i")]
    a = b = m
    if large.limit(1).count():
        m = cut(m.join(large, "g", "left").select("g", "i", F.coalesce(F.ceil(F.col("n") / hot), F.lit(1)).cast("int").alias("parts")))
        a = m.select("g", "i", F.pmod(F.xxhash64("i"), "parts").cast("int").alias("part"))
        b = m.select("g", "i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        on.append(F.col("a.part") == F.col("b.part"))
    pairs = a.alias("a").join(b.alias("b"), on)
    return pairs.groupBy(F.col("a.i").alias("src"), F.col("b.i").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


def named_cooccurrence(members: DataFrame, group: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) over names as identities: those who share a name are one, and who stands alone in every group is a node too."""
    m = members.where(F.col(name).isNotNull() & (F.col(name) != ""))
    return m.select(F.col(name).alias("id")).distinct(), cooccurrence(m, group, name)


def shared_contributors(links: DataFrame, node: str, contributor: str, min_degree: int = 300, block: int = 2000) -> DataFrame:
    """(src, dst, weight) between nodes of more than min_degree neighbours; neighbours share a contributor, weight is how many.

    A node has at most as many neighbours as its contributors have other nodes. Nodes for which that is too few go before any pair
    is made. The pairs of a contributor are dealt in blocks: no key meets more than ``block`` times ``block`` of them.
    """
    m = cut(links.select(F.col(node).alias("n"), F.col(contributor).alias("c")).where("n is not null and c is not null").distinct())
    size = m.groupBy("c").agg(F.count(F.lit(1)).alias("size"))
    sized = cut(m.join(size, "c").withColumn("parts", F.ceil(F.col("size") / block).cast("int")))
    able = cut(sized.groupBy("n").agg(F.sum(F.col("size") - 1).alias("most")).where(F.col("most") > min_degree).select("n"))
    own = F.pmod(F.xxhash64("n"), F.col("parts")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        a = left.select("c", F.col("n").alias("src"), own.alias("i"), every.alias("j"))
        b = right.select("c", F.col("n").alias("dst"), own.alias("j"), every.alias("i"))
        return a.join(b, ["c", "i", "j"]).where("src <> dst")

    first = sized.join(able, "n", "left_semi")
    degree = pairs(first, sized).select("src", "dst").distinct().groupBy(F.col("src").alias("n")).agg(F.count(F.lit(1)).alias("degree"))
    kept = cut(degree.where(F.col("degree") > min_degree).select("n"))
    last = cut(sized.join(kept, "n", "left_semi"))
    return pairs(last, last).where("src < dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def ends(edges: DataFrame) -> DataFrame:
    """Each edge from both of its ends: (id, other, weight)."""
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other")))).alias("e"), "weight").select("e.id", "e.other", "weight")


def degree_strength(edges: DataFrame) -> DataFrame:
    return ends(edges).groupBy("id").agg(
        F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("rss")
    )


def root_degree(nodes: DataFrame, edges: DataFrame, d: int = 3, isolated: float = 0.001) -> DataFrame:
    """(id, size): (sum of w^(d-1))^(1/(d-1)) + 1e-5 of each node, ``isolated`` for one without edges."""
    s = ends(edges).groupBy("id").agg((F.pow(F.sum(F.pow(F.col("weight").cast("double"), d - 1)), 1 / (d - 1)) + 1e-5).alias("size"))
    return nodes.join(s, "id", "left").select("id", F.coalesce("size", F.lit(isolated)).alias("size"))


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count(F.lit(1)).alias("_n"))
    d = ends(edges).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    return nodes.join(d, "id", "left").join(F.broadcast(n)).select("id", F.try_divide(F.coalesce("d", F.lit(0)), F.col("_n") - 1).alias("centrality"))


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def prune(edges: DataFrame, min_degree: int = 2, min_weight: int = 2) -> DataFrame:
    """One pass: edges lighter than min_weight, and those at nodes whose degree was below min_degree before, go."""
    keep = ends(edges).groupBy("id").count().where(F.col("count") >= min_degree)
    return induced(keep, edges.where(F.col("weight") >= min_weight))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    c = connected_components(edges)
    return nodes.join(c, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def giant(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes of the largest component; the smallest id decides a tie."""
    c = cut(components(nodes, edges))
    best = c.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1)
    return c.join(F.broadcast(best.select("component")), "component", "left_semi").select("id")


def pagerank(
    nodes: DataFrame, edges: DataFrame, weighted: bool = True, damping: float = 0.85, tol: float = 1e-6, max_iter: int = 100, fixed_iters: int | None = None, small: int = 400_000
) -> DataFrame:
    """(id, rank). Power iteration from 1/N; what nodes without edges hold is spread evenly.

    Ranks of a graph of at most ``small`` nodes go to all tasks, so that its edges never move; else both are dealt by node.

    Stops when the ranks move by less than N * tol in all, or after fixed_iters rounds. The number of nodes is the only thing that
    the driver learns in fixed rounds; each fifth round is written down, and the one written before goes.
    """
    w = F.col("weight").cast("double") if weighted else F.lit(1.0)
    e = ends(edges).select("id", "other", w.alias("w"))
    out = e.groupBy("id").agg(F.sum("w").alias("s"))
    p = cut(e.join(out, "id").select("id", "other", (F.col("w") / F.col("s")).alias("p")))
    nodes = cut(nodes.join(out, "id", "left").select("id", F.col("s").isNull().alias("dangling")))
    n = nodes.count()
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    ranks = ranks_written = nodes.select("id", "dangling", F.lit(1.0 / n).alias("rank"))
    lonely = nodes.where("dangling").limit(1).count() > 0
    for k in range(fixed_iters or max_iter):
        flow = p.join(F.broadcast(ranks) if n <= small else ranks, "id").groupBy(F.col("other").alias("id")).agg(F.sum(F.col("rank") * F.col("p")).alias("in"))
        new = nodes.join(flow, "id", "left")
        spread = F.lit(0.0)
        if lonely:
            new = new.join(F.broadcast(ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0)).alias("_d"))))
            spread = F.col("_d") / n
        new = new.select("id", "dangling", (damping * (F.coalesce("in", F.lit(0.0)) + spread) + (1 - damping) / n).alias("rank"))
        if fixed_iters:
            if k % 5 == 4:
                ranks, written = cut(new), ranks_written
                ranks_written = ranks
                discard(written)
            else:
                ranks = new
            continue
        new = cut(new)
        moved = new.alias("a").join(ranks.alias("b"), "id").agg(F.sum(F.abs(F.col("a.rank") - F.col("b.rank")))).first()[0]
        discard(ranks)
        ranks = new
        if moved < n * tol:
            break
    else:
        if not fixed_iters:
            raise RuntimeError(f"PageRank did not settle in {max_iter} rounds")
    return ranks.select("id", "rank")


def _alpha(digits: int) -> Column:
    nw = F.col("weight") / F.col("strength")
    nw = F.when(nw >= 1, F.lit(0.9999)).otherwise(nw)
    return F.when(F.col("degree") > 1, F.round(F.pow(1 - nw, F.col("degree") - 1), digits)).otherwise(0.0)


def disparity(nodes: DataFrame, edges: DataFrame, digits: int = 12) -> tuple[DataFrame, DataFrame]:
    """(edges with alpha and alpha_ptile, population of alphas).

    alpha = (1 - w / strength)^(degree - 1) at each end; an end of degree 1 gives 0 and stays out of the population. The
    end that comes last in node order decides. Alphas are rounded, so that equal ones stay equal however they were computed.
    """
    ds = degree_strength(edges).select("id", "degree", F.col("strength").cast("double").alias("strength"))
    e = ends(edges).join(ds, "id")
    e = cut(e.select("id", "other", "weight", "degree", _alpha(digits).alias("alpha")))
    population = e.where("degree > 1").select("alpha")
    last = e.groupBy(F.least("id", "other").alias("src"), F.greatest("id", "other").alias("dst")).agg(
        F.first("weight").alias("weight"), F.max_by("alpha", "id").alias("alpha")
    )
    scored = percentile_of_score(cut(last), "alpha", population, "alpha")
    return scored.select("src", "dst", "weight", "alpha", (F.col("ptile") / 100).alias("alpha_ptile")), population


def _block_scores(items: DataFrame, parts: int, digits: int = 12) -> DataFrame:
    """(id, weight, alpha, alpha_ptile): what ``disparity`` gives an edge by its weight and its later end, from the counts of weights alone."""
    w = cut(blocks.weights(items, parts))
    ds = w.groupBy("id").agg(F.sum("n").alias("degree"), F.sum(F.col("n") * F.col("weight")).cast("double").alias("strength"))
    e = w.join(ds, "id").select("id", "weight", "n", "degree", _alpha(digits).alias("alpha"))
    e = cut(e.withColumn("counts", F.when(F.col("degree") > 1, F.col("n")).otherwise(0)))
    at = rank_sum(e.groupBy(F.col("alpha").alias("v")).agg(F.sum("counts").alias("n"))).withColumnRenamed("v", "alpha").withColumnRenamed("n", "k")
    total = e.agg(F.sum("counts").alias("_all"))
    return cut(e.join(at, "alpha").join(F.broadcast(total)).select("id", "weight", "alpha", (percentile("k") / 100).alias("alpha_ptile")))


def member_percentiles(members: DataFrame, group: str, item: str, digits: int = 9, crowded: int = CROWDED) -> DataFrame:
    """(src, dst, alpha_ptile) of the co-occurrence graph, rounded to digits; of crowded groups no edge is written or moved."""
    m = _members(members, group, item)
    if _crowded(m, crowded):
        items, parts = blocks.blocked(m.distinct())
        scores = _block_scores(items, parts)
        return blocks.scored(items, parts, scores.select("id", "weight", F.round("alpha_ptile", digits).alias("x")), "alpha_ptile")
    e = cut(cooccurrence(members, group, item, crowded=crowded))
    return disparity(e, e)[0].select("src", "dst", F.round("alpha_ptile", digits).alias("alpha_ptile"))


def member_backbone(members: DataFrame, group: str, item: str, cutoff: float, min_degree: int, keep: str = "high_alpha", crowded: int = CROWDED) -> DataFrame:
    """(src, dst, weight): ``backbone_cut`` of the co-occurrence graph; of crowded groups no edge is written or moved."""
    m = _members(members, group, item)
    if _crowded(m, crowded):
        items, parts = blocks.blocked(m.distinct())
        scores = _block_scores(items, parts).select("id", "weight", F.col("alpha_ptile").alias("x"))
        low, high = (cutoff, float("inf")) if keep == "high_alpha" else (float("-inf"), cutoff)
        return blocks.backbone(items, parts, scores, low, high, min_degree)
    e = cut(cooccurrence(members, group, item, crowded=crowded))
    return backbone_cut(cut(disparity(e, e)[0]), cutoff, min_degree, keep).select("src", "dst", "weight")


def backbone_cut(scored: DataFrame, cutoff: float, min_degree: int, keep: str = "high_alpha") -> DataFrame:
    """Edges whose alpha percentile reaches the cutoff (or, keep="significant", stays within it), less those at nodes left below min_degree."""
    ok = F.col("alpha_ptile") >= cutoff if keep == "high_alpha" else F.col("alpha_ptile") <= cutoff
    e = scored.where(ok)
    return induced(ends(e).groupBy("id").count().where(F.col("count") >= min_degree), e)


def ego_members(edges: DataFrame, centres: DataFrame) -> DataFrame:
    """(ego, id) of radius 1, all egos in one job."""
    near = ends(edges).join(centres.select(F.col("id")), "id").select(F.col("id").alias("ego"), F.col("other").alias("id"))
    return near.unionByName(centres.select(F.col("id").alias("ego"), "id")).distinct()


def ego_nodes(members: DataFrame, attributes: DataFrame, centre_rank: float = 10.0) -> DataFrame:
    """(ego, id, label, partition, pr): members with their node attributes; the centre's own rank is a constant that stands out."""
    pr = F.when(F.col("id") == F.col("ego"), F.lit(centre_rank)).otherwise(F.col("pr"))
    return members.join(attributes.select("id", "label", "partition", "pr"), "id").select("ego", "id", "label", "partition", pr.alias("pr"))


def ego_edges(edges: DataFrame, members: DataFrame) -> DataFrame:
    a = members.select("ego", F.col("id").alias("src"))
    b = members.select("ego", F.col("id").alias("dst"))
    return edges.join(a, "src").join(b, ["ego", "dst"]).select("ego", "src", "dst", "weight")


def ego_links(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Ego edges by position of their ends within the ego."""
    # A hub's members are ranked with all others, and counted from its first one.
    ranked = cut(rank_all(members.select("ego", "id"), ["ego", "id"], "_r"))
    first = ranked.groupBy("ego").agg(F.min("_r").alias("_first"))
    at = ranked.join(first, "ego").select("ego", "id", (F.col("_r") - F.col("_first")).cast("int").alias("k"))
    e = ego_edges(edges, members)
    return (
        e.join(at.select("ego", F.col("id").alias("src"), F.col("k").alias("source")), ["ego", "src"])
        .join(at.select("ego", F.col("id").alias("dst"), F.col("k").alias("target")), ["ego", "dst"])
        .select("ego", "source", "target", F.col("weight").alias("value"))
    )


def ego_json(edges: DataFrame, members: DataFrame) -> DataFrame:
    """One document for each ego: nodes and links."""
    nodes = members.groupBy("ego").agg(F.sort_array(F.collect_list(F.struct(F.col("id").alias("name")))).alias("nodes"))
    link = F.struct("source", "target", "value")
    found = ego_links(edges, members).groupBy("ego").agg(F.sort_array(F.collect_list(link)).alias("links"))
    return nodes.join(found, "ego", "left").select("ego", F.to_json(F.struct("nodes", "links")).alias("json"))


def adjacency_coo(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """(i, j, weight, same): matrix cells with nodes ordered by community, then id."""
    at = rank_all(partition.select("id", "community"), ["community", "id"], "_r").withColumn("k", F.col("_r") - 1)
    a = at.select(F.col("id").alias("src"), F.col("k").alias("i"), F.col("community").alias("_a"))
    b = at.select(F.col("id").alias("dst"), F.col("k").alias("j"), F.col("community").alias("_b"))
    return edges.join(a, "src").join(b, "dst").select("i", "j", "weight", (F.col("_a") == F.col("_b")).alias("same"))


def modularity(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """One row: the sum over communities of inner weight / m - (strength / 2m)^2."""
    p = partition.select("id", "community")
    s = ends(edges).join(p, "id").groupBy("community").agg(F.sum("weight").cast("double").alias("d"))
    inner = (
        edges.join(p.select(F.col("id").alias("src"), F.col("community").alias("ca")), "src")
        .join(p.select(F.col("id").alias("dst"), F.col("community").alias("cb")), "dst")
        .where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").cast("double").alias("l"))
    )
    m = edges.agg(F.sum("weight").cast("double").alias("m"))
    q = F.coalesce("l", F.lit(0.0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)
    return s.join(inner, "community", "left").join(F.broadcast(m)).agg(F.sum(q).alias("modularity"))


def _local_moves(nodes: DataFrame, edges: DataFrame, max_rounds: int, min_gain: float) -> tuple[DataFrame, float, bool]:
    """(partition, modularity, whether a node moved): in each round a half of the nodes, drawn by hash, join the neighbouring community of the
    largest gain; four rounds in a row that do not raise modularity end it. Edges may be loops."""
    part = cut(nodes.select("id", F.col("id").alias("community")))
    strength = cut(ends(edges).groupBy("id").agg(F.sum("weight").cast("double").alias("k")))
    m = strength.agg(F.sum("k")).first()[0] or 0.0
    best, stale, moved = modularity(edges, part).first()[0] or 0.0, 0, False
    between = cut(ends(edges.where("src <> dst")))
    for r in range(max_rounds):
        total = part.join(strength, "id").groupBy("community").agg(F.sum("k").alias("tot"))
        to = between.join(part.select(F.col("id").alias("other"), "community"), "other").groupBy("id", "community").agg(F.sum("weight").cast("double").alias("w"))
        own = part.select("id", F.col("community").alias("own"))
        gain = F.col("w") - F.col("k") * (F.col("tot") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)) / m
        moves = to.join(total, "community").join(strength, "id").join(own, "id").withColumn("gain", gain)
        pick = moves.groupBy("id").agg(F.max(F.struct("gain", (F.col("community") == F.col("own")).alias("_stay"), "community")).alias("b"))
        # Another half in each round, and of two nodes that stand alone only the larger joins the smaller: none change places for ever.
        alone = part.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
        pick = pick.join(alone.select(F.col("community").alias("_c"), F.col("size").alias("there")), F.col("b.community") == F.col("_c"))
        pick = pick.join(own, "id").join(alone.select(F.col("community").alias("own"), F.col("size").alias("here")), "own").drop("own")
        chase = (F.col("there") == 1) & (F.col("here") == 1) & (F.col("b.community") > F.col("community"))
        mine = (F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0) & F.col("b").isNotNull() & (F.col("b.gain") > 0) & ~chase
        new = cut(part.join(pick, "id", "left").select("id", F.when(mine, F.col("b.community")).otherwise(F.col("community")).alias("community")))
        q = modularity(edges, new).first()[0]
        stale = 0 if q > best + min_gain else stale + 1
        if q > best:
            discard(part)
            best, part, moved = q, new, True
        else:
            discard(new)
        if stale == 4:
            break
    return part, best, moved


def _moves_by_arrays(nodes: DataFrame, edges: DataFrame, max_rounds: int, min_gain: float) -> tuple[DataFrame, float, bool]:
    """What ``_local_moves`` gives. Lists of neighbours are written once; a round is one pass over them, with the communities of all nodes as arrays in
    every task, and only moves come back. A list is a row."""
    import numpy as np
    import pyarrow as pa

    spark = nodes.sparkSession
    numbers = cut(rank_all(nodes.select("id"), ["id"], "_r").select("id", (F.col("_r") - 1).cast("int").alias("v")))
    count = numbers.count()
    e = join_checked(ends(edges), numbers, "id", "inner").select("v", "other", F.col("weight").cast("double").alias("w"))
    e = join_checked(e, numbers.select(F.col("id").alias("other"), F.col("v").alias("u")), "other", "inner").select("v", "u", "w").repartition("v")
    other = lambda c: F.collect_list(F.when(F.col("u") != F.col("v"), F.col(c)))
    near = cut(e.groupBy("v").agg(F.sum("w").alias("k"), other("u").alias("u"), other("w").alias("w")))
    strength, k = np.zeros(count), near.select("v", "k").toArrow()
    strength[k["v"].to_numpy()] = k["k"].to_numpy()
    m = strength.sum()

    def look(part, r):
        """Modularity of part, and the moves from it of the half that round r draws."""
        drawn, found = np.zeros(count, bool), numbers.where(F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0).select("v").toArrow()
        drawn[found["v"].to_numpy()] = True
        total, size = np.bincount(part, strength, count), np.bincount(part, minlength=count)
        sent = spark.sparkContext.broadcast((part, strength, total, size, drawn))

        def go(batches):
            part, strength, total, size, drawn = sent.value
            inner = 0.0
            for batch in batches:
                v = batch.column(0).to_numpy().astype(np.int64)
                n = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
                u, w = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (1, 2))
                row, to = np.repeat(np.arange(len(v)), n), part[u].astype(np.int64)
                # Loops are in the strength and in no list.
                inner += w[to == part[v[row]]].sum() + strength[v].sum() - w.sum()
                mine = drawn[v[row]]
                key, back = np.unique(row[mine] * len(part) + to[mine], return_inverse=True)
                if not len(key):
                    continue
                w, row, to = np.bincount(back, w[mine]), key // len(part), key % len(part)
                own, k = part[v[row]], strength[v[row]]
                gain = w - k * (total[to] - np.where(to == own, k, 0.0)) / m
                order = np.lexsort((to, to == own, gain, row))
                best = order[np.append(row[order][1:] != row[order][:-1], True)]
                row, to, own, gain = row[best], to[best], own[best], gain[best]
                # Of two nodes that stand alone only the larger joins the smaller.
                moves = (gain > 0) & (to != own) & ~((size[to] == 1) & (size[own] == 1) & (to > own))
                yield pa.RecordBatch.from_arrays([pa.array(v[row[moves]]), pa.array(to[moves]), pa.array(np.zeros(moves.sum()))], ["v", "c", "x"])
            yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([-1]), pa.array([float(inner)])], ["v", "c", "x"])

        back = near.select("v", "u", "w").mapInArrow(go, "v long, c long, x double").toArrow()
        sent.destroy()
        v, c = back["v"].to_numpy(), back["c"].to_numpy()
        return back["x"].to_numpy().sum() / m - ((total / m) ** 2).sum(), v[v >= 0], c[v >= 0]

    part, stale, moved = np.arange(count, dtype=np.int32), 0, False
    best, v, c = look(part, 0)
    for r in range(max_rounds):
        new = part.copy()
        new[v] = c
        q, *ahead = look(new, r + 1)
        stale = 0 if q > best + min_gain else stale + 1
        if q > best:
            best, part, moved = q, new, True
        elif len(v) and stale < 4:
            _, *ahead = look(part, r + 1)
        if stale == 4:
            break
        v, c = ahead
    discard(near)
    to = spark.createDataFrame(pa.table({"v": pa.array(np.arange(count, dtype=np.int32)), "c": pa.array(part)}))
    named = numbers.join(to, "v").select("id", "c").join(numbers.select(F.col("id").alias("community"), F.col("v").alias("c")), "c")
    return cut(named.select("id", "community")), best, moved


def louvain(nodes: DataFrame, edges: DataFrame, max_rounds: int = 20, min_gain: float = 1e-6, max_levels: int = 10, small: int = 1_000_000) -> DataFrame:
    """(id, community): local moves (by arrays in every task where a level has at most ``small`` nodes, else by joins), then each community becomes one node, whose inner weight is a loop, and moves again, level after
    level, until none moves. A community bears one of its nodes' ids."""
    found = cut(nodes.select("id", F.col("id").alias("community")))
    if not edges.limit(1).count():
        return found
    level, now = nodes, edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    for _ in range(max_levels):
        moves = _moves_by_arrays if level.count() <= small else _local_moves
        part, _, moved = moves(level, now, max_rounds, min_gain)
        if not moved:
            break
        to = part.select(F.col("id").alias("community"), F.col("community").alias("_to"))
        found = cut(found.join(to, "community").select("id", F.col("_to").alias("community")))
        a = part.select(F.col("id").alias("src"), F.col("community").alias("_a"))
        b = part.select(F.col("id").alias("dst"), F.col("community").alias("_b"))
        now = cut(now.join(a, "src").join(b, "dst").groupBy(F.least("_a", "_b").alias("src"), F.greatest("_a", "_b").alias("dst")).agg(F.sum("weight").alias("weight")))
        level = cut(part.select(F.col("community").alias("id")).distinct())
    return found


def _paths_from(sources, first, near, w, count):
    """Sums over sources of each node's dependency (Brandes), by whole levels: nodes whose distance is below the least open one plus the least weight
    are settled at once, one by one where a weight is zero. first, near, w: neighbours of node v stand at first[v] to first[v + 1]."""
    import numpy as np

    total, least = np.zeros(count), w.min() if len(w) else 1.0
    ends_ = np.repeat(np.arange(count, dtype=near.dtype), np.diff(first))
    for s in sources:
        dist, level, k = np.full(count, np.inf), np.full(count, -1, np.int32), 0
        dist[s], open_ = 0.0, np.array([s])
        while len(open_):
            low = dist[open_].min()
            now = open_[dist[open_] < low + least * (1 - 1e-9)] if least > 1e-12 else open_[dist[open_].argmin()][None]
            level[now] = k
            size = first[now + 1] - first[now]
            at = np.arange(size.sum()) + np.repeat(first[now] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            to, far = near[at], np.repeat(dist[now], size) + w[at]
            closer = (level[to] < 0) & (far < dist[to] - 1e-12)
            np.minimum.at(dist, to[closer], far[closer])
            open_ = np.flatnonzero((level < 0) & np.isfinite(dist))
            k += 1
        with np.errstate(invalid="ignore"):
            on = np.flatnonzero((level[ends_] >= 0) & (level[ends_] < level[near]) & (np.abs(dist[ends_] + w - dist[near]) <= 1e-12))
        on = on[np.argsort(level[ends_[on]], kind="stable")]
        a, b = ends_[on], near[on]
        cut_at = np.searchsorted(level[a], np.arange(k + 1))
        sigma, delta = np.zeros(count), np.zeros(count)
        sigma[s] = 1.0
        for i in range(k):
            x = slice(cut_at[i], cut_at[i + 1])
            np.add.at(sigma, b[x], sigma[a[x]])
        for i in range(k - 1, -1, -1):
            x = slice(cut_at[i], cut_at[i + 1])
            np.add.at(delta, a[x], sigma[a[x]] / sigma[b[x]] * (1 + delta[b[x]]))
        delta[s] = 0.0
        total += delta
    return total


def _path_rounds(keep: DataFrame, edges: DataFrame, batch: int) -> DataFrame:
    """(id, b): what ``_paths_from`` sums, as joins over tables for ``batch`` sources at a time; no task holds the graph. Weights are positive."""
    step = cut(ends(edges).select("id", "other", F.col("weight").cast("double").alias("w")))
    if step.where("w <= 1e-9").limit(1).count():
        raise ValueError("weights must be positive")
    numbered = cut(rank_all(keep, ["id"], "_k"))
    sums = None
    for k in range(0, numbered.count(), batch):
        own = numbered.where((F.col("_k") > k) & (F.col("_k") <= k + batch)).select(F.col("id").alias("s"), "id", F.lit(0.0).alias("d"))
        state = front = cut(own)
        while front.limit(1).count():
            found = front.join(step, "id").groupBy("s", F.col("other").alias("id")).agg(F.min(F.col("d") + F.col("w")).alias("n"))
            both = cut(state.join(found, ["s", "id"], "full").select("s", "id", "d", "n", (F.col("n").isNotNull() & (F.col("d").isNull() | (F.col("n") < F.col("d") - 1e-12))).alias("new")))
            state, front = both.select("s", "id", F.when(F.col("new"), F.col("n")).otherwise(F.col("d")).alias("d")), both.where("new").select("s", "id", F.col("n").alias("d"))
        b = state.select("s", F.col("id").alias("other"), F.col("d").alias("e"))
        on = cut(state.join(step, "id").join(b, ["s", "other"]).where(F.abs(F.col("d") + F.col("w") - F.col("e")) <= 1e-12).select("s", "id", "other"))
        # Numbers of paths, and then dependencies, are sums over the lengths of paths: each round is one step further.
        walk = cut(own.select("s", "id", F.lit(1.0).alias("x")))
        sigma = walk
        while walk.limit(1).count():
            walk = cut(walk.join(on, ["s", "id"]).groupBy("s", F.col("other").alias("id")).agg(F.sum("x").alias("x")))
            sigma = sigma.unionByName(walk)
        sigma = cut(sigma.groupBy("s", "id").agg(F.sum("x").alias("x")))
        share = on.join(sigma, ["s", "id"]).join(sigma.select("s", F.col("id").alias("other"), F.col("x").alias("y")), ["s", "other"])
        share = cut(share.select("s", "id", "other", (F.col("x") / F.col("y")).alias("c")))
        back = share.groupBy("s", "id").agg(F.sum("c").alias("x"))
        while True:
            back = cut(back)
            if not back.limit(1).count():
                break
            part = back.where("s <> id").groupBy("id").agg(F.sum("x").alias("b"))
            sums = part if sums is None else sums.unionByName(part)
            back = share.join(back.select("s", F.col("id").alias("other"), "x"), ["s", "other"]).groupBy("s", "id").agg(F.sum(F.col("c") * F.col("x")).alias("x"))
        sums = cut(sums.groupBy("id").agg(F.sum("b").alias("b"))) if sums is not None else None
    return sums if sums is not None else keep.select("id", F.lit(0.0).alias("b"))


def betweenness(nodes: DataFrame, edges: DataFrame, min_degree: int = 1, small: int = 4_000_000, batch: int = 500) -> DataFrame:
    """(id, betweenness): shortest weighted paths from every source, sources dealt over tasks.

    A graph of at most ``small`` edges goes to every task as arrays, 12 bytes an end of an edge; paths over a larger one are found by joins, for
    ``batch`` sources at a time. Either way the work is that of all sources over all edges.
    """
    keep = cut(ends(edges).groupBy("id").count().where(F.col("count") >= min_degree).select("id"))
    e = cut(induced(keep, edges).select("src", "dst", F.col("weight").cast("double").alias("weight")))
    n = keep.count()
    if e.count() <= small:
        sums = _paths_by_arrays(keep, e)
    else:
        sums = _path_rounds(keep, e, batch)
    scale = 1.0 / max(1, (n - 1) * (n - 2))
    return keep.join(sums.groupBy("id").agg(F.sum("b").alias("b")), "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def _paths_by_arrays(keep: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, b): what tasks sum over their sources, from the graph as arrays."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    spark, kind = keep.sparkSession, dict(keep.dtypes)["id"]
    e = edges.toArrow()
    ids = pc.unique(pa.chunked_array([*e["src"].chunks, *e["dst"].chunks], e["src"].type)) if len(e) else pa.array([], e["src"].type)
    src, dst = (pc.index_in(e[c], ids).to_numpy().astype(np.int32) for c in ("src", "dst"))
    w = e["weight"].to_numpy()
    a, b, w = np.concatenate([src, dst]), np.concatenate([dst, src]), np.concatenate([w, w])
    order, count = np.argsort(a, kind="stable"), len(ids)
    first = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=count))]).astype(np.int64)
    sent = spark.sparkContext.broadcast((first, b[order], w[order], ids))
    del e, src, dst, a, b, w, order
    parts = max(1, min(count // 50, max(64, 4 * spark.sparkContext.defaultParallelism)))

    def paths(batches):
        first, near, w, ids = sent.value
        mine = [k for x in batches for k in x.column(0).to_pylist()]
        total = _paths_from(mine, first, near, w, len(ids))
        on = np.flatnonzero(total)
        for k in range(0, len(on), 10_000):
            some = on[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array(total[some])], ["id", "b"])

    # Sources are dealt by turns, so that no task gets a row of hubs.
    return spark.range(0, count, 1, parts).repartition(parts).mapInArrow(paths, f"id {kind}, b double")
