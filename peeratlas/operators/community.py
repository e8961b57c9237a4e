"""Communities of the coauthor graph."""

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.colors import FIELD_HUES, community_color, field_color
from ..sources.storage import cut, drop
from . import blocks


def both_ways(edges: DataFrame) -> DataFrame:
    """Each undirected edge seen from either end."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight").union(edges.select("dst", "src", "weight"))


def weighted_degree(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), "weight")  # edges are read once
    return ends.groupBy("node").agg(F.sum("weight").alias("degree"), F.count("*").alias("neighbours"))


def edge_modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row with the modularity of the partition labels(node, label)."""
    met = edges.select("src", "dst", "weight").join(labels.toDF("src", "ls"), "src").join(labels.toDF("dst", "ld"), "dst")
    between = met.groupBy("ls", "ld").agg(F.sum("weight").alias("weight"))  # edges are read and joined once
    inner = F.when(F.col("ls") == F.col("ld"), F.col("weight"))
    ends = between.select(F.explode(F.array(F.struct(F.col("ls").alias("label"), "weight", inner.alias("inner")), F.struct(F.col("ld").alias("label"), "weight", F.lit(None).cast("double").alias("inner")))).alias("e")).select("e.*")
    totals = ends.groupBy("label").agg(F.sum("weight").alias("total"), F.sum("inner").alias("inside"))
    sums = totals.agg(F.sum(F.coalesce("inside", F.lit(0.0))).alias("inside"), F.sum(F.col("total") * F.col("total")).alias("squares"), F.sum("total").alias("twice"))
    m = F.col("twice") / 2
    return sums.select((F.col("inside") / m - F.lit(resolution) * F.col("squares") / (4 * m * m)).alias("modularity"))


def vote_round(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """One round: a node takes the label with the largest weight among its neighbours,
    ties the smallest. Weights per label are pre-aggregated, so a hub's neighbours meet as a
    row a label; rounding makes sums equal in whatever order they were added. The labels of
    a bucket's nodes are hashed, so that its edges aren't sorted anew each round. This shuffles
    a vote for nearly every edge; propagate_labels() makes the same rounds in blocks."""
    nearest = F.rint(F.sum("weight") * 1e9)  # a billionth; round() would go through decimals
    votes = pairs.join(labels.toDF("other", "label").hint("shuffle_hash"), "other").groupBy("node", "label").agg(nearest.alias("w"))
    return votes.repartition("node").groupBy("node").agg(F.min(F.struct((-F.col("w")).alias("w"), "label"))["label"].alias("label"))


def _vote(parts: int, p: int, own: dict, seen: dict, rows) -> pa.Table:
    """A part's step of label_round()."""
    node, label = [np.zeros(0, int)], [np.zeros(0, int)]
    for place, others, w in rows:
        place, value, _, added = blocks.sums(place, seen["value"][others], w)
        at = blocks.best(place, np.rint(added * 1e9))  # of equal ones the first is the smallest
        node.append(p + parts * place[at])
        label.append(value[at])
    return blocks.table("node int, label int", np.concatenate(node), np.concatenate(label))


def label_round(graph: blocks.Blocks, labels: DataFrame) -> DataFrame:
    """vote_round() in blocks: labels(node, label) are numbers of nodes."""
    return graph.round(labels.select("node", F.col("label").alias("value")), _vote, "node int, label int")


def propagate_labels(edges: DataFrame, rounds: int = 3, names: DataFrame | None = None) -> DataFrame:
    """node, label after a fixed number of rounds of weighted label propagation. Rounds
    are written to the shared folder: a lost executor costs at most one round. Edges are
    written once, in blocks, so rounds shuffle labels only. With names(number, node) the
    edges' ends are such numbers, in the order of the nodes; the weights of repeated edges
    are added up."""
    edges, names = (edges, names) if names is not None else blocks.numbered(edges)
    graph = blocks.Blocks(edges, blocks.part_count(2 * edges.count()))
    labels = cut(graph.nodes().select("node", F.col("node").alias("label")), "labels")
    for _ in range(rounds):
        after = cut(label_round(graph, labels), "labels")
        drop(labels)
        labels = after
    graph.drop()
    return blocks.named(labels, names, "node", "label").select("node", "label")


#: Weights are whole numbers of this part of one, so that sums don't depend on their order.
WEIGHT_UNIT = 1e-6


def as_text(node: Column) -> Column:
    return node.cast("string")


def takes_in(community: Column, salt: int, text: Callable[[Column], Column] = as_text) -> Column:
    """Whether a community takes in members in this round; the others may give some away."""
    drawn = F.substring(F.md5(F.concat_ws(":", text(community), F.lit(salt)).cast("binary")), 1, 8)
    return F.conv(drawn, 16, 10).cast("long") % 2 == 1


def move_choices(pairs: DataFrame, state: DataFrame, twice: int, resolution: float = 1.0) -> DataFrame:
    """node, community, degree, wants: where each node moves in this round, or stays.

    pairs(node, other, w, degree) bucketed by other; state(node, community, degree, total,
    open), where total is the community's sum of degrees. Moving a node
    changes modularity in proportion to twice * (its weight to the new community less that
    to the old one) - degree * (the new total less the old total without it). Only members
    of communities that aren't open move, and only into open ones, so no two nodes swap and
    no community loses and gains in one round: gains are computed against members that
    stay. Ties go to the smallest community. wants: a gain is to be had, if not in this round.

    Weights to a community are summed before they are shuffled and again before they are
    dealt by node, so a hub's neighbours meet as one row a community, and edges are read
    where they lie.
    """
    # a vote is five numbers: totals of closed communities and degrees of own rows are negative
    signed = F.when(F.col("open"), F.col("total")).otherwise(-F.col("total")).alias("total")
    seen = pairs.join(state.select(F.col("node").alias("other"), "community", signed).hint("shuffle_hash"), "other")
    votes = seen.select("node", "community", "total", "w", "degree")
    votes = votes.union(state.select("node", "community", signed, F.lit(0).cast("long"), -F.col("degree")))
    sums = votes.groupBy("node", "community").agg(F.sum("w").alias("w"), F.first("total").alias("total"), F.min("degree").alias("degree")).repartition("node")
    sums = sums.select("node", "community", "w", F.abs("total").alias("total"), (F.col("total") > 0).alias("open"), F.abs("degree").alias("degree"), (F.col("degree") < 0).alias("own"))
    others = F.col("total") - F.when(F.col("own"), F.col("degree")).otherwise(0)
    score = F.lit(float(twice)) * F.col("w").cast("double") - F.lit(float(resolution)) * F.col("degree").cast("double") * others.cast("double")
    best = F.min(F.when(~F.col("own") & F.col("open"), F.struct((-F.col("score")).alias("lost"), "community")))
    own = lambda c: F.max(F.when(F.col("own"), F.col(c))).alias(c)
    found = sums.withColumn("score", score).groupBy("node").agg(own("community"), own("open"), own("degree"), own("score").alias("stay"), best.alias("best"), F.max(F.when(~F.col("own"), F.col("score"))).alias("any"))
    gains = ~F.col("open") & (-F.col("best.lost") > F.col("stay"))
    to = F.when(gains, F.col("best.community")).otherwise(F.col("community"))
    return found.select("node", to.alias("community"), "degree", F.coalesce(F.col("any") > F.col("stay"), F.lit(False)).alias("wants"))


def _move(unit: float, twice: float, resolution: float, full: bool, parts: int, p: int, own: dict, seen: dict, rows) -> pa.Table:
    """A part's step of a round, as move_choices() has it; of nodes that can't move only
    when full, for whether they want to."""
    community, to = own["value"], own["value"].copy()
    wants = np.zeros(len(community), bool)
    stay = -resolution * own["degree"].astype(float) * (own["total"] - own["degree"]).astype(float)
    for place, others, w in rows:
        w = blocks.in_units(w, unit)
        here, at = w > 0, np.zeros(0, int)
        mine = seen["value"][others] == community[place]
        if not full:
            here &= ~own["open"][place] & (mine | seen["open"][others])
        place, others, w = place[here], others[here], w[here]
        place, value, at, w = blocks.sums(place, seen["value"][others], w)
        others = others[at]
        mine = value == community[place]
        total, degree = seen["total"][others], own["degree"][place].astype(float)
        score = twice * w.astype(float) - resolution * degree * (total - np.where(mine, own["degree"][place], 0)).astype(float)
        home = place[mine]
        stay[home] = twice * w[mine].astype(float) - resolution * own["degree"][home].astype(float) * (own["total"][home] - own["degree"][home]).astype(float)
        away = ~mine
        wants[place[away & (score > stay[place])]] = True
        gains = np.flatnonzero(away & seen["open"][others] & ~own["open"][place])
        gains = gains[blocks.best(place[gains], score[gains])]
        gains = gains[score[gains] > stay[place[gains]]]
        to[place[gains]] = value[gains]
    at = own["place"]
    return blocks.table(MOVED, p + parts * at.astype(np.int64), to[at], own["degree"][at], to[at] != community[at], wants[at])


MOVED = "node int, community int, degree long, moved boolean, wants boolean"


def _merge(unit: float, keys: list[int], parts: int, p: int, own: dict, seen: dict, rows) -> pa.Table:
    """A part's edges between different communities, with weights in units, dealt to theirs;
    summed up by and by, so that a part's sums aren't held at once."""
    tables, found, size = [blocks.dealt(parts, keys, *[np.zeros(0, int)] * 3)], [], 0
    for place, others, w in rows:
        w, a, b = blocks.in_units(w, unit), own["value"][place], seen["value"][others]
        here = (w > 0) & (a != b)
        found.append((a[here], b[here], w[here]))
        size += len(w)
        if size >= blocks.DEAL:
            tables.append(_summed(parts, keys, found))
            found, size = [], 0
    if found:
        tables.append(_summed(parts, keys, found))
    return pa.concat_tables(tables)


def _summed(parts: int, keys: list[int], found: list) -> pa.Table:
    a, b, _, w = blocks.sums(*(np.concatenate(c) for c in zip(*found, strict=True)))
    return blocks.dealt(parts, keys, a, b, w)


def _inside(parts: int, p: int, own: dict, seen: dict, rows) -> pa.Table:
    """community, inside, total: the weights of a part's edges from labelled nodes, to those of
    the same label and to all that are labelled."""
    inside, total = np.zeros(len(own["value"])), np.zeros(len(own["value"]))
    for place, others, w in rows:
        a, b = own["value"][place], seen["value"][others]
        if len(place):
            first, size = place[0], place[-1] - place[0] + 1
            total[first : first + size] += np.bincount(place - first, w * (b >= 0), size)
            inside[first : first + size] += np.bincount(place - first, w * (a == b), size)
    at = own["place"]
    return blocks.table("community int, inside double, total double", own["value"][at], inside[at], total[at])


def move_rounds(graph: blocks.Blocks, members: DataFrame, names: DataFrame, unit: float, twice: int, rounds: int, salt: int, resolution: float = 1.0, text: Callable[[Column], Column] = as_text) -> tuple[DataFrame, int]:
    """members(node, community, degree) after rounds of moves, and how many were needed:
    they end when no node has a gain to make, which is looked at after a round without a move.
    Each round is one job: it sums up the communities' totals, sends the nodes' communities
    to the parts of their neighbours and writes the nodes' communities anew. It shuffles rows of
    nodes and their values, never edges or votes, and a lost executor costs one round. A
    community that holds a third of all nodes is one row of totals, met by a join that AQE
    can split."""
    full, done = False, 0
    for n in range(rounds):
        totals = members.groupBy("community").agg(F.sum("degree").alias("total"))
        totals = blocks.named(totals.withColumn("id", F.col("community")), names, "id")
        totals = totals.select("community", "total", takes_in(F.col("id"), salt + n, text).alias("open"))
        state = members.join(totals, "community").select("node", F.col("community").alias("value"), "open", "total", "degree")
        seen = Observation()
        choices = graph.round(state, partial(_move, unit, float(twice), float(resolution), full), MOVED, full)
        after = cut(choices.observe(seen, *[F.count(F.when(F.col(c), 1)).alias(c) for c in ("moved", "wants")]), "choices")
        found = seen.get
        done = n + 1 if found["moved"] else done
        if full and found["wants"] == 0:
            drop(after)
            break
        full = found["moved"] == 0
        drop(members)
        members = after.drop("moved", "wants")
        members._shared_path = after._shared_path
    return members, done


def found_communities(edges: DataFrame, levels: int = 2, rounds: int = 12, refine: int = 12, resolution: float = 1.0, parts: int | None = None, text: Callable[[Column], Column] = as_text, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """modularity_communities(), and one row with their modularity at resolution 1."""
    edges, names = (edges, names) if names is not None else blocks.numbered(edges)
    parts = parts or blocks.part_count(2 * edges.count())
    first = graph = blocks.Blocks(edges.where("src <> dst"), parts)
    nodes = cut(first.nodes(WEIGHT_UNIT), "nodes")
    twice, unit = nodes.agg(F.sum("degree")).first()[0] or 0, WEIGHT_UNIT  # twice is the same on all levels
    start = lambda nodes: cut(nodes.select("node", F.col("node").alias("community"), "degree"), "members")
    members, mapping = start(nodes), None
    for level in range(levels):
        members, used = move_rounds(graph, members, names, unit, twice, rounds, level * rounds, resolution, text)
        found = members.select("node", "community")
        mapping = cut(found if mapping is None else mapping.join(found.toDF("community", "next"), "community").select("node", F.col("next").alias("community")), "mapping")
        if used == 0 or level + 1 == levels:
            break
        between = graph.round(found.toDF("node", "value"), partial(_merge, unit, graph.keys), blocks.DEALT)
        merged, unit = blocks.Blocks(between, parts), 1.0
        if graph is not first:
            graph.drop()
        graph = merged
        members = start(members.groupBy(F.col("community").alias("node")).agg(F.sum("degree").alias("degree")))
    if levels > 1:
        if graph is not first:
            graph.drop()
        drop(members)
        members, _ = move_rounds(first, cut(mapping.join(nodes, "node").select("node", "community", "degree"), "members"), names, WEIGHT_UNIT, twice, refine, levels * rounds, resolution, text)
    by = first.round(members.select("node", F.col("community").alias("value")), _inside, "community int, inside double, total double")
    by = by.groupBy("community").agg(F.sum("inside").alias("inside"), F.sum("total").alias("total"))
    sums = by.agg(F.sum("inside").alias("inside"), F.sum("total").alias("twice"), F.sum(F.col("total") * F.col("total")).alias("squares"))
    modularity = cut(sums.select((F.col("inside") / F.col("twice") - F.col("squares") / (F.col("twice") * F.col("twice"))).alias("modularity")), "modularity")
    first.drop()
    smallest = members.groupBy("community").agg(F.min("node").alias("label"))
    labels = members.join(smallest, "community").select("node", "label")
    return blocks.named(labels, names, "node", "label").select("node", "label"), modularity


def modularity_communities(edges: DataFrame, levels: int = 2, rounds: int = 12, refine: int = 12, resolution: float = 1.0, buckets: int | None = None, text: Callable[[Column], Column] = as_text) -> DataFrame:
    """node, label: communities by rounds of moves that raise modularity, then the same on
    the graph of communities (levels in all), and at last rounds of single nodes between
    the communities found; label is a community's smallest node.

    Weights are rounded to WEIGHT_UNIT, so that sums and with them the result don't depend
    on the order of rows; edges without weight or with equal ends are left out, as are
    nodes without another edge. The weights of repeated edges are added up first. Other
    columns are ignored; no edges give no rows. text: the id of a node that is given as a
    code, in the order of the ids (communities are drawn by their ids).
    """
    return found_communities(edges, levels, rounds, refine, resolution, buckets, text)[0]


def community_count(labels: DataFrame, column: str = "label") -> DataFrame:
    return labels.agg(F.count_distinct(column).alias("communities"))


def community_coverage(coords: DataFrame, least: int = 1000) -> DataFrame:
    """How many communities have at least so many members, and the share they hold."""
    sizes = coords.groupBy("community").agg(F.count("*").alias("n"))
    big = F.when(F.col("n") >= least, F.col("n"))
    return sizes.agg(F.count(big).alias("communities"), (F.coalesce(F.sum(big), F.lit(0)) / F.sum("n")).alias("share"))


def community_size(coords: DataFrame) -> DataFrame:
    """coords with comm_n. A window would put a community's rows in one task."""
    sizes = coords.groupBy("community").agg(F.count("*").alias("comm_n"))
    return coords.join(sizes.withColumnRenamed("community", "_of"), F.col("community").eqNullSafe(F.col("_of"))).drop("_of")


def community_stats(web: DataFrame) -> DataFrame:
    """community, majority_field, members, cx, cy. The majority field may be null; ties go
    to the first by name, null last. One exchange by field, one by community."""
    fields = web.groupBy("community", "field").agg(F.count("*").alias("c"), F.sum("xw").alias("sx"), F.sum("yw").alias("sy"))
    # of equal counts: not null before null, then the smallest name
    fields = fields.withColumn("rank", F.struct(-F.col("c"), F.col("field").isNull(), F.col("field")))
    sums = fields.groupBy("community").agg(F.min("rank")["field"].alias("majority_field"), F.sum("c").alias("members"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"))
    return sums.select("community", "majority_field", "members", (F.col("sx") / F.col("members")).alias("cx"), (F.col("sy") / F.col("members")).alias("cy"))


def community_palette(stats: DataFrame, least: int = 1000) -> DataFrame:
    """community, r, g, b in 0..1."""
    color = community_color("community", "members", "cx", "cy", F.lit(least))
    return stats.select("community", color.alias("c")).select("community", "c.r", "c.g", "c.b")


def color_lut(stats: DataFrame, least: int = 1000) -> DataFrame:
    """Export colours in bytes: small communities, and authors without one, share the grey
    of community 0."""
    small = (F.col("members") < least) | F.col("community").isNull()
    like = stats.select("community", F.when(small, F.lit(0)).otherwise(F.col("community")).alias("k"), F.when(small, F.lit(0)).otherwise(F.col("members")).alias("m"), "cx", "cy")
    color = community_color("k", "m", "cx", "cy", F.lit(least))
    byte = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), F.rint(F.col(f"c.{c}") * 255).cast("int"))).alias(c)
    return like.select("community", color.alias("c")).select("community", byte("r"), byte("g"), byte("b"))


def field_palette(rows: DataFrame) -> DataFrame:
    """community, field, r, g, b of the older palette by field."""
    hues = F.create_map(*[F.lit(x) for pair in FIELD_HUES.items() for x in pair])
    colored = rows.select("community", "field", field_color(F.try_element_at(hues, F.coalesce("field", F.lit(""))), "community").alias("c"))
    return colored.select("community", "field", "c.r", "c.g", "c.b")


def legend(stats: DataFrame, regions: DataFrame, least: int = 1000) -> DataFrame:
    """community, name, field, members, color of large communities, names from regions."""
    big = stats.where(F.col("members") >= least)
    colored = big.join(community_palette(big, least), "community")
    hexed = F.format_string("#%02x%02x%02x", *[F.floor(F.col(c) * 255).cast("int") for c in "rgb"])
    named = colored.join(regions.select("community", "name"), "community", "left")
    return named.select("community", "name", F.col("majority_field").alias("field"), "members", hexed.alias("color"))
