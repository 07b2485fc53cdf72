"""Exact similarity self-join of documents under the Jaccard distance, a metric.

A document is the set of its `width`-word shingles. Two documents link when their similarity is
`threshold` or more, that is, when their distance is eps = 1 - threshold or less. Every link is
found: each document learns with how many others it links, and the smallest id that links reach.

1. Sets. Equal sets are one node, known by a digest of the set, with the number of its documents.
2. Candidates. Distances between unrelated documents are all close to 1, where no pivot tells them
   apart. Of any order of all shingles, a node's first n - ceil(threshold n) + L must hold L of any
   partner's. In the order of hashes, nodes whose first shingles hardly occur elsewhere are settled at
   once. Among the rest, shingles are counted, and in the order from rare to frequent a node's first
   n - ceil(threshold n) + 1 shingles are its anchors: partners share one. Nodes that anchors connect
   are a space of their own, in which distances differ.
3. Voronoi regions. Pivots of a region get their exact distances to all its members. A node within
   2 eps of its nearest pivot is at home there; the others form the remote region. All partners of a
   node at home at P lie within r + eps of P, r being the largest distance of a node at home, and within
   2 eps of their own least distance: these two windows of the triangle inequality say which boundary
   nodes visit the region. A remote node's partners lie beyond eps of every pivot. Links are counted at
   home, so that no pair counts twice. Pivots leave, as all their pairs are known, and regions are
   divided again, recursively and exactly: in rounds of the whole cluster while a region holds more than
   `room` shingles, in the memory of a task below that.
4. Where division no longer tells nodes apart, those at home meet the members in cells: blocks that hold
   no more than `room` shingles and about PAIRS pairs, so that one region is shared by many tasks. There
   distances to the pivots settle most pairs (d(x,p) + d(p,y) <= eps: a link; |d(x,p) - d(p,y)| > eps:
   none), and the rest are compared.

Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; a text of fewer than `width` words has
one shingle, the whole sequence; a text without words (or null) has none and links with nothing.
Equal rows are equal sets and link; very long texts are large sets, taken whole; rows without an id
take part and are counted, and don't count as smallest id; an empty table gives an empty result; other
columns are ignored. Shingles and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Spans, words_of
from .chunks import Answered, Chunk, answers, chunked, mapped, shards_for
from .components import components
from .repeats import by_shard
from .scratch import Workspace, unused, workspace

WIDTH, PERCENT = 5, 80
#: L of the first filter as a share of a node's shingles.
_DEPTH = 0.1
#: Shingles that a task holds of a region, and pairs that a cell looks at.
ROOM, PAIRS = 2_000_000, 4_000_000
#: Pivots of a region in a round of the whole cluster, at most, and in a task; parts that rows meeting pivots are dealt to.
PIVOTS, FEW, SALT = 64, 8, 16
_SLACK = 1e-9
_SETS = "chunk long, bundle long, nodes binary, sizes binary, shingles binary"


def shingle_sets(chunk: Chunk, width: int) -> list[np.ndarray]:
    """The sorted hashes of each document's shingles."""
    _, _, hashes, words = words_of(chunk.data, chunk.offsets, lower=True)
    spans = Spans(hashes)
    every = spans.every(width)
    out = []
    for a, b in zip(words[:-1].tolist(), words[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(every[a : b - width + 1]))
        else:
            out.append(spans.hash(np.arange(a, min(a + 1, b)), np.full(min(1, b - a), b)))
    return out


def digest(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True) if len(shingles) else 0


def least_overlap(n, percent: int):
    """How many shingles a set of n shares with any partner, at least."""
    return -(-n * percent // 100)


def _depth(n):
    return np.maximum(1, np.ceil(_DEPTH * n)).astype(np.int64)


class _Sets(Answered):
    """Distinct sets of a chunk: nodes, sizes, and all shingles one after another."""

    def __init__(self, row: dict, answers=None):
        super().__init__(row, answers)
        self.nodes = np.frombuffer(row["nodes"], np.int64)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.shingles = np.frombuffer(row["shingles"], np.uint64)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)


def _distinct(sets: list[np.ndarray]) -> tuple[list[int], np.ndarray]:
    """The rows of the first of equal nonempty sets, and the digests of all."""
    nodes, seen, rows = np.array([digest(s) for s in sets], np.int64), set(), []
    for i, node in enumerate(nodes.tolist()):
        if len(sets[i]) and node not in seen:
            seen.add(node)
            rows.append(i)
    return rows, nodes


def _by_shard(owner: np.ndarray, tokens: np.ndarray, shards: int):
    """For each shard: places of its tokens, in order, and the owners and numbers of each run."""
    for s, places in by_shard(tokens, shards):
        head = np.flatnonzero(np.diff(owner[places], prepend=-1))
        yield s, places, owner[places[head]], np.diff(np.append(head, len(places)))


def _ask(nodes: np.ndarray, owner: np.ndarray, tokens: np.ndarray, shards: int):
    """Nodes, their numbers of tokens, and the tokens."""
    for s, places, who, sizes in _by_shard(owner, tokens, shards):
        yield s, np.int64(len(who)).tobytes() + nodes[who].tobytes() + sizes.astype(np.int32).tobytes() + tokens[places].tobytes()


def _counted(asked: list[bytes]):
    """For each token asked, the number of distinct nodes that hold it; and the runs."""
    heads = [int(np.frombuffer(x, np.int64, 1)[0]) for x in asked]
    sizes = [np.frombuffer(x, np.int32, n, 8 + 8 * n) for x, n in zip(asked, heads, strict=True)]
    node = np.concatenate([np.repeat(np.frombuffer(x, np.int64, n, 8), z) for x, n, z in zip(asked, heads, sizes, strict=True)])
    token = np.concatenate([np.frombuffer(x[8 + 12 * n :], np.uint64) for x, n in zip(asked, heads, strict=True)])
    order = np.lexsort((node, token))
    t, d = token[order], node[order]
    new_t = np.ones(len(t), bool)
    new_t[1:] = t[1:] != t[:-1]
    new = new_t.copy()
    new[1:] |= d[1:] != d[:-1]
    group = np.cumsum(new_t) - 1
    times = np.empty(len(t), np.int64)
    times[order] = np.bincount(group, new)[group].astype(np.int64)
    return times, sizes


def _answer_shared(asked: list[bytes]) -> list[bytes]:
    """How many of each node's tokens other nodes hold too."""
    times, sizes = _counted(asked)
    every = np.concatenate(sizes)
    shared = np.add.reduceat((times > 1).astype(np.int32), np.cumsum(every) - every)
    return [x.astype(np.int32).tobytes() for x in np.split(shared, np.cumsum([len(z) for z in sizes])[:-1])]


def _answer_frequency(asked: list[bytes]) -> list[bytes]:
    """The class of each token's frequency: twice its binary logarithm; 0 for a single node."""
    times, sizes = _counted(asked)
    classes = np.minimum(255, np.floor(2 * np.log2(times))).astype(np.uint8)
    return [x.tobytes() for x in np.split(classes, np.cumsum([z.sum() for z in sizes])[:-1])]


def _first_tokens(sets: list[np.ndarray], percent: int):
    sizes = np.array([len(s) for s in sets], np.int64)
    take = np.minimum(sizes, sizes - least_overlap(sizes, percent) + _depth(sizes))
    return np.repeat(np.arange(len(sets)), take), np.concatenate([s[:k] for s, k in zip(sets, take.tolist(), strict=True)]) if sets else np.zeros(0, np.uint64)


def _candidates(work: Workspace, chunks: DataFrame, width: int, percent: int, shards: int) -> DataFrame:
    """Rows of _Sets: the nodes that the first filter leaves."""

    def ask(chunk, n):
        sets = shingle_sets(chunk, width)
        rows, nodes = _distinct(sets)
        owner, tokens = _first_tokens([sets[i] for i in rows], percent)
        yield from _ask(nodes[rows], owner, tokens, n)

    def left(chunk):
        sets = shingle_sets(chunk, width)
        rows, nodes = _distinct(sets)
        own = [sets[i] for i in rows]
        owner, tokens = _first_tokens(own, percent)
        shared, told = np.zeros(len(rows), np.int64), chunk.answers()
        for s, _, who, _ in _by_shard(owner, tokens, shards):
            shared[who] += np.frombuffer(told[s], np.int32)
        sizes = np.array([len(s) for s in own], np.int64)
        keep = np.flatnonzero(shared >= _depth(least_overlap(sizes, percent)))
        raw = b"".join(own[i].tobytes() for i in keep)
        return pa.RecordBatch.from_arrays([pa.array([chunk.id]), pa.array([chunk.bundle]), *(pa.array([x], pa.binary()) for x in (nodes[rows][keep].tobytes(), sizes[keep].tobytes(), raw))], ["chunk", "bundle", "nodes", "sizes", "shingles"])

    told = answers(work, chunks, ask, _answer_shared, shards)
    return work.written(mapped(chunks, left, _SETS, [told]), "candidates")


def _anchored(work: Workspace, candidates: DataFrame, percent: int, shards: int) -> DataFrame:
    """node, n, shingles, anchors of the nodes that share an anchor with another."""

    def ask(sets, n):
        yield from _ask(sets.nodes, sets.owner(), sets.shingles, n)

    def anchors(sets):
        owner, told = sets.owner(), sets.answers()
        classes = np.zeros(len(owner), np.uint8)
        for s, places, _, _ in _by_shard(owner, sets.shingles, shards):
            classes[places] = np.frombuffer(told[s], np.uint8)
        order = np.lexsort((sets.shingles, classes, owner))
        begin = np.cumsum(sets.sizes) - sets.sizes
        rank = np.arange(len(order)) - np.repeat(begin, sets.sizes)
        take = sets.sizes - least_overlap(sets.sizes, percent) + 1
        chosen = order[(rank < np.repeat(take, sets.sizes)) & (classes[order] > 0)]
        signed, n = sets.shingles.view(np.int64), np.bincount(owner[chosen], minlength=len(sets.nodes))
        ends, stop = np.cumsum(n).tolist(), np.cumsum(sets.sizes).tolist()
        rows = np.flatnonzero(n).tolist()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(sets.nodes[rows]), pa.array(sets.sizes[rows]),
                pa.array([signed[stop[i] - int(sets.sizes[i]) : stop[i]] for i in rows], pa.list_(pa.int64())),
                pa.array([signed[chosen[ends[i] - int(n[i]) : ends[i]]] for i in rows], pa.list_(pa.int64())),
            ],
            ["node", "n", "shingles", "anchors"],
        )

    told = answers(work, candidates, ask, _answer_frequency, shards, kind=_Sets)
    found = mapped(candidates, anchors, "node long, n long, shingles array<long>, anchors array<long>", [told], _Sets)
    return work.written(found.dropDuplicates(["node"]), "anchored")


class Region:
    """The metric join of sets in memory: links of those at home with the members."""

    def __init__(self, sets: list[np.ndarray], percent: int, weights: np.ndarray | None = None):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.percent, self.eps = percent, 1 - percent / 100
        _, token = np.unique(np.concatenate(sets), return_inverse=True)
        self.begin = np.concatenate([[0], np.cumsum(self.sizes)])
        self.token = token
        order = np.argsort(token, kind="stable")
        self.holders = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(token))])
        self.mark = np.zeros(len(self.at) - 1, bool)
        self.weights = np.ones(len(sets), np.int64) if weights is None else weights
        self.label, self.links = np.arange(len(sets)), np.zeros(len(sets), np.int64)
        #: pairs that regions and their windows kept apart, that bounds settled, that were compared
        self.apart = self.bounded = self.compared = 0

    def common(self, x: int, others: np.ndarray) -> np.ndarray:
        """How many shingles x shares with each of the others."""
        mine = self.token[self.begin[x] : self.begin[x + 1]]
        starts, n = self.at[mine], self.at[mine + 1] - self.at[mine]
        sizes = self.sizes[others]
        if n.sum() <= sizes.sum():
            places = np.arange(int(n.sum())) + np.repeat(starts - (np.cumsum(n) - n), n)
            return np.bincount(self.holders[places], minlength=len(self.sizes))[others]
        self.mark[mine] = True
        begin = np.cumsum(sizes) - sizes
        held = self.mark[self.token[np.arange(int(sizes.sum())) + np.repeat(self.begin[others] - begin, sizes)]]
        self.mark[mine] = False
        return np.add.reduceat(held.astype(np.int64), begin)

    def distances(self, x: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From x to each of the others; and which of them link."""
        common = self.common(x, others)
        union = self.sizes[others] + self.sizes[x] - common
        return 1 - common / union, common * 100 >= union * self.percent

    def _met(self, x: int, partners: np.ndarray) -> None:
        if len(partners):
            labels = np.unique(self.label[np.append(partners, x)])
            if len(labels) > 1:
                self.label[np.isin(self.label, labels)] = labels[0]

    def join(self, homes: np.ndarray | None = None, members: np.ndarray | None = None) -> Region:
        every = np.arange(len(self.sizes))
        stack = [(every if homes is None else homes, every if members is None else members)]
        while stack:
            homes, members = stack.pop()
            if not len(homes) or not len(members):
                continue
            pivots = self._pivots(homes)
            d = np.empty((len(pivots), len(members)))
            at_home, leaves = np.zeros(len(self.sizes), bool), np.isin(members, pivots)
            at_home[homes] = True
            for i, p in enumerate(pivots):
                d[i], link = self.distances(p, members)
                self.compared += len(members)
                link &= members != p
                partners = members[link]
                self.links[p] += self.weights[partners].sum()
                # a pivot of another's member list: those at home that are no pivots count it now, as it leaves
                if leaves.any() and (members == p).any():
                    other = members[link & ~leaves]
                    self.links[other[at_home[other]]] += self.weights[p]
                self._met(p, partners)
            homes, members, d = np.setdiff1d(homes, pivots, assume_unique=True), members[~leaves], d[:, ~leaves]
            if not len(homes) or not len(members):
                continue
            parts = self._parts(homes, members, d)
            size = sum(len(h) * len(m) for h, m in parts)
            if len(homes) * len(members) > 64 and size <= 0.7 * len(homes) * len(members):
                self.apart += len(homes) * len(members) - size
                stack += parts
            else:
                self._compare(homes, members, d, pivots)
        return self

    def _pivots(self, homes: np.ndarray) -> np.ndarray:
        """Up to FEW of those at home, each the farthest from those before it."""
        if len(homes) <= FEW:
            return homes
        chosen, least = [int(homes[0])], np.full(len(homes), np.inf)
        while len(chosen) < FEW:
            least = np.minimum(least, self.distances(chosen[-1], homes)[0])
            chosen.append(int(homes[least.argmax()]))
            if least.max() <= self.eps / 2:
                break
        return np.unique(chosen)

    def _parts(self, homes, members, d) -> list[tuple[np.ndarray, np.ndarray]]:
        """Homes and members of each pivot's region, and of the remote one."""
        place = np.full(len(self.sizes), -1)
        place[members] = np.arange(len(members))
        if (place[homes] < 0).any():  # homes of a cell whose members are others
            return [(homes, members)]
        mine, least = d[:, place[homes]], d.min(axis=0)
        home, near = mine.argmin(axis=0), mine.min(axis=0)
        remote = near > 2 * self.eps + _SLACK
        parts = [(homes[remote], members[least > self.eps - _SLACK])]
        for p in range(len(d)):
            here = ~remote & (home == p)
            if here.any():
                visit = (d[p] <= near[here].max() + self.eps + _SLACK) & (d[p] <= least + 2 * self.eps + _SLACK)
                parts.append((homes[here], members[visit]))
        return [(h, m) for h, m in parts if len(h) and len(m)]

    def _compare(self, homes, members, d, pivots) -> None:
        """Each of the homes with all members, but for the pairs that the pivots settle."""
        place = np.full(len(self.sizes), -1)
        place[members] = np.arange(len(members))
        for x in homes.tolist():
            mine = d[:, [place[x]]] if place[x] >= 0 else np.array([[self.distances(int(p), np.array([x]))[0][0]] for p in pivots])
            link = (d + mine).min(axis=0, initial=np.inf) <= self.eps - _SLACK
            open_ = ~link & (np.abs(d - mine).max(axis=0, initial=0) <= self.eps + _SLACK)
            rows = np.flatnonzero(open_)
            self.compared += len(rows)
            self.bounded += len(members) - len(rows)
            if len(rows):
                link[rows] = self.distances(x, members[rows])[1]
            if place[x] >= 0:
                link[place[x]] = False
            partners = members[link]
            self.links[x] += self.weights[partners].sum()
            self._met(x, partners)


def _joined_in_cells(anchored: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """node, label, links of those at home in each cell (cell, node, home, member); labels connect what links."""

    def run(table):
        nodes, weights = table.column("node").to_numpy(), table.column("weight").to_numpy()
        home, member = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("home", "member"))
        region = Region([x.values.to_numpy() for x in table.column("shingles").combine_chunks()], percent, weights).join(np.flatnonzero(home), np.flatnonzero(member))
        label = nodes[region.label]
        rows = home | (label != nodes)
        return pa.table({"node": nodes[rows], "label": label[rows], "links": np.where(home, region.links, 0)[rows]}, schema=pa.schema([("node", pa.int64()), ("label", pa.int64()), ("links", pa.int64())]))

    return cells.join(anchored.select("node", "shingles", "weight"), "node").groupBy("cell").applyInArrow(run, "node long, label long, links long")


def _cells(members: DataFrame, sized: DataFrame, room: int) -> DataFrame:
    """cell, node, home, member: blocks of those at home by blocks of members."""
    across = F.greatest(F.lit(1), F.ceil(2 * F.col("shingles") / room)).cast("int")
    across = F.when(F.col("shingles") <= room, 1).otherwise(across)
    down = F.greatest(across, F.ceil(F.col("homes") * F.col("size") / across / PAIRS).cast("int"))
    rows = members.join(sized.select("region", down.alias("down"), across.alias("across")), "region")
    draw = F.xxhash64("node", F.lit(7))
    mine, theirs = F.pmod(draw, F.col("down")).cast("int"), F.pmod(draw, F.col("across")).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    as_home = F.when(F.col("home"), F.transform(every(F.col("across")), lambda j: F.struct(F.col("region"), mine.alias("i"), j.alias("j"))))
    as_member = F.transform(every(F.col("down")), lambda i: F.struct(F.col("region"), i.alias("i"), theirs.alias("j")))
    at = F.array_distinct(F.concat(F.coalesce(as_home, F.array().cast("array<struct<region:bigint,i:int,j:int>>")), as_member))
    rows = rows.select("node", "home", F.explode(at).alias("cell"), mine.alias("mine"), theirs.alias("theirs"))
    return rows.select("cell", "node", (F.col("home") & (F.col("cell.i") == F.col("mine"))).alias("home"), (F.col("cell.j") == F.col("theirs")).alias("member"))


def _sized(members: DataFrame, anchored: DataFrame) -> DataFrame:
    """region, size, homes, shingles."""
    return members.join(anchored.select("node", "n"), "node").groupBy("region").agg(F.count("*").alias("size"), F.count_if("home").alias("homes"), F.sum("n").alias("shingles"))


def metric_links(work: Workspace, anchored: DataFrame, percent: int, room: int = ROOM) -> tuple[DataFrame, DataFrame]:
    """node, label: the components of all links among the anchored nodes (node, n, weight, shingles,
    anchors); and node, links: the documents that each links with, but for those of its own set."""
    spread = anchored.select("node", F.explode("anchors").alias("anchor"))
    least = spread.groupBy("anchor").agg(F.min("node").alias("least"))
    touching = spread.join(least, "anchor").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    members = components(work, touching).select(F.col("label").alias("region"), "node", F.lit(True).alias("home"))
    found, ready, wanted = [], [], 4
    while True:
        members = work.written(members, "members")
        sized = work.written(_sized(members, anchored), "regions")
        large = sized.filter(F.col("shingles") > room)
        ready.append(_cells(members, sized.filter(F.col("shingles") <= room), room))
        if not large.limit(1).count():
            break
        met = _met(work, anchored, members.join(large.select("region"), "region", "left_semi"), percent, wanted)
        divided = work.written(_divided(met, 1 - percent / 100), "divided")
        after = _sized(divided, anchored).withColumn("pairs", F.col("homes") * F.col("size")).join(divided.select("region", "parent").distinct(), "region").groupBy("parent").agg(F.sum("pairs").alias("pairs"))
        good = large.join(after, large["region"] == after["parent"], "left").filter(F.coalesce("pairs", F.lit(0)) <= 0.7 * F.col("homes") * F.col("size")).select("region")
        good = work.written(good, "good")
        found.append(work.written(_pivot_links(met.join(good, "region", "left_semi")), "links"))
        whole = large.join(good, "region", "left_anti")
        ready.append(_cells(members.join(whole.select("region"), "region", "left_semi"), whole, room))
        members = divided.join(good.withColumnRenamed("region", "parent"), "parent", "left_semi").select("region", "node", "home")
        wanted = min(2 * wanted, PIVOTS)
    found.append(work.written(_joined_in_cells(anchored, reduce(DataFrame.union, ready), percent), "links"))
    every = reduce(DataFrame.unionByName, found)
    labels = components(work, every.filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")))
    return labels, every.groupBy("node").agg(F.sum("links").alias("links"))


def _met(work: Workspace, anchored: DataFrame, members: DataFrame, percent: int, wanted: int) -> DataFrame:
    """region, node, home, weight, pivot, p_weight, link, d: the members of large regions and up to
    `wanted` pivots of each. Pivots are few: their sets go to the members, which are dealt by a salt."""
    # pivots: of those at home the smallest of each class of hashes
    draw = F.xxhash64("node", F.lit(wanted))
    chosen = members.filter("home").groupBy("region", F.pmod(draw, F.lit(wanted)).alias("class")).agg(F.min(F.struct(draw.alias("draw"), "node")).alias("p")).select("region", F.col("p.node").alias("node"))
    about = anchored.select("node", "n", "weight", "shingles")
    pivots = chosen.join(about, "node").select("region", F.col("node").alias("pivot"), F.col("n").alias("p_n"), F.col("weight").alias("p_weight"), F.col("shingles").alias("p_shingles"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    rows = members.join(about, "node").withColumn("salt", F.pmod(F.xxhash64("node", F.lit(3)), F.lit(SALT)).cast("int"))
    common = F.size(F.array_intersect("shingles", "p_shingles")).cast("long")
    met = rows.join(pivots, ["region", "salt"]).select("region", "node", "home", "weight", "pivot", "p_weight", (F.col("n") + F.col("p_n")).alias("both"), common.alias("common"))
    union = F.col("both") - F.col("common")
    return work.written(met.select("region", "node", "home", "weight", "pivot", "p_weight", (F.col("common") * 100 >= union * percent).alias("link"), (1 - F.col("common") / union).alias("d")), "met")


def _pivot_links(met: DataFrame) -> DataFrame:
    """node, label, links: all links of pivots, and those of others at home with pivots."""
    pairs = met.filter(F.col("link") & (F.col("node") != F.col("pivot")))
    own = pairs.groupBy("region", F.col("pivot").alias("node")).agg(F.min("node").alias("label"), F.sum("weight").alias("links"))
    leaders = met.select("region", F.col("pivot").alias("node")).distinct()
    others = pairs.filter("home").join(leaders, ["region", "node"], "left_anti").groupBy("region", "node").agg(F.min("pivot").alias("label"), F.sum("p_weight").alias("links"))
    edges = pairs.select("node", F.col("pivot").alias("label"), F.lit(0).cast("long").alias("links"))
    return own.unionByName(others).select("node", "label", "links").unionByName(edges)


def _divided(met: DataFrame, eps: float) -> DataFrame:
    """parent, region, node, home of the next round, from the distances to the pivots of this one."""
    leaders = met.select("region", F.col("pivot").alias("node")).distinct()
    rest = met.join(leaders, ["region", "node"], "left_anti")  # pivots leave
    least = rest.groupBy("region", "node").agg(F.min(F.struct("d", "pivot")).alias("least")).select("region", "node", F.col("least.d").alias("near"), F.col("least.pivot").alias("nearest"))
    rest = rest.join(least, ["region", "node"])
    remote = F.col("near") > 2 * eps + _SLACK
    inside = F.col("home") & ~remote & (F.col("nearest") == F.col("pivot"))
    reach = rest.filter(inside).groupBy("region", "pivot").agg(F.max("d").alias("reach"))
    visits = rest.join(reach, ["region", "pivot"]).filter((F.col("d") <= F.col("reach") + eps + _SLACK) & (F.col("d") <= F.col("near") + 2 * eps + _SLACK))
    visits = visits.select(F.col("region").alias("parent"), F.xxhash64("region", "pivot").alias("region"), "node", inside.alias("home"))
    far = rest.filter((F.col("near") > eps - _SLACK) & (F.col("nearest") == F.col("pivot"))).select(F.col("region").alias("parent"), F.xxhash64("region", F.lit(-1)).alias("region"), "node", (F.col("home") & remote).alias("home"))
    lived = far.groupBy("region").agg(F.bool_or("home").alias("some")).filter("some").select("region")
    return visits.unionByName(far.join(lived, "region", "left_semi"))


def text_key(text: bytes) -> int:
    """The number that xxhash64 of a text column gives."""
    return xxhash.xxh64(text, seed=42).intdigest() - (1 << 64 if xxhash.xxh64(text, seed=42).intdigest() >> 63 else 0)


def linked(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, room: int = ROOM, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach), n_links (the other
    documents that it links with), text_key (xxhash64 of the text) and label (of the component; null
    without words) of every row."""
    if not 67 <= percent <= 100:
        raise ValueError("percent lies between 67 and 100, so that three distances stay under 1")

    def described(chunk):
        sets, ends = shingle_sets(chunk, width), chunk.offsets.tolist()
        keys = [text_key(chunk.data[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(chunk.doc_ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.int64()), pa.array(keys, pa.int64())], ["doc_id", "n_shingles", "node", "text_key"])

    with workspace(docs.sparkSession) as work:
        chunks = chunked(work, docs, doc_id, text)
        shards = shards_for(chunks)
        rows = work.written(mapped(chunks, described, "doc_id long, n_shingles long, node long, text_key long"), "sets", stay=True)
        nodes = work.written(rows.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("weight")), "nodes")
        anchored = _anchored(work, _candidates(work, chunks, width, percent, shards), percent, shards)
        anchored = work.written(anchored.join(nodes.select("node", "weight"), "node"), "weighed")
        labels, links = metric_links(work, anchored, percent, room)
        named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        groups = named.groupBy("label").agg(F.min("first").alias("component_id"))
        told = named.join(groups, "label").join(links, "node", "left").select(F.col("node").alias("key"), "label", "component_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
        told = work.written(told, "components", stay=True)
    match = (F.col("node") == F.col("key")) & (F.col("n_shingles") > 0)
    return rows.join(told, match, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "text_key", "label")


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_key", "label")


OP3_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM split WHERE len(ws) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.n >= 80 * (x.n + y.n - c.n)
), reach AS (
  SELECT a AS start, b AS node FROM links UNION SELECT start, b FROM reach JOIN links ON node = a
), least AS (
  SELECT start, min(node) AS least FROM reach GROUP BY start
), met AS (
  SELECT a, count(*) AS n_links FROM links GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(least, d.doc_id)) AS component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM split d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON start = d.doc_id LEFT JOIN met ON a = d.doc_id
"""


def one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage: of each component of linked documents one row, with all its columns: that with the
    smallest id (rows without an id last; of equal ids the text with the smallest digest). Documents
    without words stay. A repeated row (equal id and text) stays once."""
    rows = linked(docs)
    if rows.groupBy("doc_id", "text_key").count().filter("count > 1").limit(1).count():
        docs = docs.dropDuplicates(["doc_id", "text"])
    first = rows.filter("label IS NOT NULL").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("k")).select("k.doc_id", "k.text_key")
    kept = first.unionByName(rows.filter("label IS NULL").select("doc_id", "text_key")).distinct()
    names = unused(docs, "_kept_id", "_kept_key")
    kept = kept.toDF(*names)
    match = F.col("doc_id").eqNullSafe(F.col(names[0])) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(names[1]))
    return docs.join(kept, match, "left_semi")
