"""Operator 2: n-gram Jaccard self-join by a count-vector R-tree.

A document is the set of its distinct word shingles. Shingles are hashed into groups;
a document's counts per group are a point. For two documents the sum over the groups of the
smaller count bounds their overlap from above, so points whose bound is too small for
the wanted similarity need no comparison: an R-tree over the points prunes whole boxes by the
same bound (summed minima of the query and the box's upper corner). What is left is verified
on the sets.

One tree over everything would be one task, so the points are first dealt out without
losing a link. Two sets of a and b shingles with the wanted similarity t differ in at most
r = (a + b) (1 - t) / (1 + t) shingles, so of m groups at least m - r hold the same shingles in
both. A group's key is its size class, its number and the digest of its shingles. In a fixed order
of all keys (groups with more shingles first, as these are shared least by chance) the first
r + 1 keys of both then have one in common, and the first r + T have T: these are emitted, somewhat more than an
eighth as many as shingles at 0.9, a third at 0.8. Sets that share fewer than T keys with all others are left
alone, and of a set's shared keys the T - 1 that are most frequent are not used, so that a common line
does not tie strangers together. Documents that share keys, directly or by
others, form a candidate cluster (connected components of a star per key, so the number
of edges is linear), and each cluster has its own tree. Inside a task a
breadth-first search compares a document only with those not yet reached, so copies are
never expanded into all pairs; tasks return a component label per document.

A cluster beyond ``unit_docs`` or ``unit_shingles`` is cut into parts that are linked one by one; then
some documents of every part's components are compared with each other. What remains to be
compared are the documents outside the cluster's largest component: with each other, as pairs of
parts, and with that component's parts, each of which has a tree that only they ask. Documents that are
in one component already are not compared again, so a group of near copies that holds a fixed
share of all documents costs about as many tasks as it has parts.

A key that very many documents share (more than ``KEY_ROWS``, told from a hashed sample) is dealt out by a salt, the
salted parts' smallest nodes being tied in a second step, so no task sees much more than that of one key.

Equal sets (copies) are one node throughout. A node is named by 64 bits of its digest; sets that share
these but not the next 64 are told apart and renamed. Nothing is dropped or capped.

Defined results: null, empty and blank texts have the empty set, no link, and are their own
component; so has a row with a null id (its component is null). Equal texts under several
ids share the smallest of them; repeated rows give repeated result rows. An empty table gives no
rows. Very long texts are read whole. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import marked, materialise, small_batches, table
from ledgerloom.llm.components import connected_components
from ledgerloom.llm.shingles import mix, set_digest, shingle_sets, shingle_sets_and_words

GROUPS = 32
LEAF = 32
BROADCAST_ROWS = 500_000
KEY_ROWS = 20_000
SPOKESMEN = 32  # documents of a component of a part that are compared between parts first


# --- dealing out -------------------------------------------------------------------------------


CLASSES = 1 << np.arange(33, dtype=np.int64)  # lower bounds of the size classes
CLASS_BITS = 63  # the lowest bits of a key hold its size class


def most_differing(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Shingles in which sets of a and b differ at most if they are similar enough."""
    return (a + b) * (100 - percent) // (100 + percent)


def spare_keys(most: np.ndarray) -> np.ndarray:
    """How many keys beyond the first r + 1 are emitted in a class whose sets differ in ``most`` shingles at most."""
    return np.minimum(most // 4, np.maximum(3, most // 8))


def shared_least(percent: int) -> list[int]:
    """By size class: how many emitted keys two linked sets share at least."""
    top = CLASSES - 1
    return (1 + spare_keys(most_differing(top, top, percent))).tolist()


def join_keys(sets: list[np.ndarray], percent: int) -> list[np.ndarray | None]:
    """All keys of every non-empty set, for its own size class and, if it can meet larger sets there, the next.

    All sets' groups lie behind one another in one array, so that a batch costs a few array operations."""
    n = np.array([len(s) for s in sets], np.int64)
    out: list[np.ndarray | None] = [None] * len(sets)
    if not len(n):
        return out
    flat = np.concatenate(sets)
    scrambled = mix(flat)
    own = np.searchsorted(CLASSES, n, side="right") - 1
    for step in (0, 1):
        low, top = CLASSES[own + step], CLASSES[own + step + 1] - 1
        r = most_differing(n, np.minimum(top, n * 100 // percent), percent)
        rows = np.flatnonzero((r > 0) & ((step == 0) | (n * 100 >= low * percent)))  # with r = 0 only equal sets are similar enough
        if not len(rows):
            continue
        most = most_differing(top, top, percent)[rows]
        m = most + 1 + most // 4
        begin = np.concatenate([[0], np.cumsum(m)])
        mine = np.zeros(len(sets), bool)
        mine[rows] = True
        mine = np.repeat(mine, n)
        at = np.repeat(begin[:-1], n[rows]) + (flat[mine] % np.repeat(m, n[rows]).astype(np.uint64)).astype(np.int64)
        digest = np.zeros(begin[-1], np.uint64)
        np.add.at(digest, at, scrambled[mine])
        size = np.minimum(np.bincount(at, minlength=begin[-1]), 255).astype(np.uint64)
        number = (np.arange(begin[-1]) - np.repeat(begin[:-1], m)).astype(np.uint64)
        classes = np.repeat(own[rows] + step + 1, m).astype(np.uint64)
        key = (mix(digest ^ mix((number << np.uint64(8)) + classes)) & ~np.uint64(CLASS_BITS)) | classes
        order = ((np.uint64(255) - size) << np.uint64(56)) | (key >> np.uint64(8))  # large groups first
        last = r[rows] + spare_keys(most)
        for i, a, b, k in zip(rows.tolist(), begin[:-1].tolist(), begin[1:].tolist(), last.tolist(), strict=True):
            first = key[a:b][np.argpartition(order[a:b], k)[: k + 1]]
            out[i] = first if out[i] is None else np.concatenate([out[i], first])
    return out


# --- one tree ----------------------------------------------------------------------------------


class CountTree:
    """An R-tree over count vectors, built by splitting at the coordinate that varies most."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, percent: int, rows: np.ndarray | None = None, fan: int = 8) -> None:
        self.counts, self.sizes, self.percent, self.fan = counts, sizes, percent, fan
        self.root = self._node(np.arange(len(sizes)) if rows is None else rows)

    def _node(self, rows: np.ndarray) -> dict:
        node = {"hi": self.counts[rows].max(axis=0), "least": int(self.sizes[rows].min()), "most": int(self.sizes[rows].max())}
        if len(rows) <= LEAF:
            return node | {"rows": rows}
        x = np.column_stack([self.counts[rows], self.sizes[rows]])
        order = rows[np.argsort(x[:, x.var(axis=0).argmax()], kind="stable")]
        kids = [self._node(part) for part in np.array_split(order, min(self.fan, -(-len(rows) // LEAF)))]
        return node | {"kids": kids, "his": np.stack([k["hi"] for k in kids])}

    def needed(self, n: int, m: np.ndarray | int) -> np.ndarray | int:
        """The smallest overlap of sets of n and m shingles that are similar enough."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def near(self, i: int, open_rows: np.ndarray) -> np.ndarray:
        """Rows still open whose bound allows a link with row i."""
        q, n = self.counts[i], int(self.sizes[i])
        low, high = -(-n * self.percent // 100), n * 100 // self.percent
        found, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if node["most"] < low or node["least"] > high:
                continue
            if "rows" in node:
                rows = node["rows"][open_rows[node["rows"]]]
                if len(rows):
                    sizes = self.sizes[rows]
                    bound = np.minimum(self.counts[rows], q).sum(axis=1)
                    found.append(rows[(bound >= self.needed(n, sizes)) & (sizes >= low) & (sizes <= high)])
                continue
            bounds = np.minimum(node["his"], q).sum(axis=1)
            for kid, bound in zip(node["kids"], bounds.tolist(), strict=True):
                if bound >= self.needed(n, max(kid["least"], low)):
                    stack.append(kid)
        return np.concatenate(found) if found else np.zeros(0, np.int64)


class Sets:
    """Shingle sets with their count vectors; ``linked`` verifies what a tree has found."""

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.percent, self.sizes = percent, np.array([len(s) for s in sets], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        flat = np.concatenate(sets)
        _, self.local = np.unique(flat, return_inverse=True)
        self.counts = np.zeros((len(sets), GROUPS), np.int32)
        np.add.at(self.counts, (np.repeat(np.arange(len(sets)), self.sizes), (flat >> np.uint64(59)).astype(np.int64)), 1)
        self.mark = np.zeros(len(self.local) + 1, bool)

    def linked(self, i: int, near: np.ndarray) -> np.ndarray:
        """Those of ``near`` that are similar enough to set i."""
        if not len(near):
            return near
        at, sizes, mine = self.at, self.sizes, self.local[self.at[i] : self.at[i + 1]]
        self.mark[mine] = True
        flat = np.concatenate([self.local[at[j] : at[j + 1]] for j in near.tolist()])
        overlap = np.add.reduceat(self.mark[flat].astype(np.int64), np.concatenate([[0], np.cumsum(sizes[near])[:-1]]))
        self.mark[mine] = False
        return near[100 * overlap >= self.percent * (sizes[i] + sizes[near] - overlap)]


def link_labels(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Component of every set under links of at least ``percent`` Jaccard similarity."""
    own = Sets(sets, percent)
    tree = CountTree(own.counts, own.sizes, percent)
    open_rows, label = np.ones(len(sets), bool), np.full(len(sets), -1)
    for seed in range(len(sets)):
        if not open_rows[seed]:
            continue
        open_rows[seed], label[seed], queue = False, seed, deque([seed])
        while queue:
            i = queue.popleft()
            linked = own.linked(i, tree.near(i, open_rows))
            open_rows[linked], label[linked] = False, seed
            queue.extend(linked.tolist())
    return label


def links_into(sets: list[np.ndarray], known: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """For every set outside ``known`` (a mask of sets of one component) one link into it, if there is any."""
    own = Sets(sets, percent)
    tree, every, out = CountTree(own.counts, own.sizes, percent, np.flatnonzero(known)), np.ones(len(sets), bool), []
    for i in np.flatnonzero(~known).tolist():
        near = tree.near(i, every)
        for some in np.array_split(near, -(-len(near) // 64) or 1):
            linked = own.linked(i, some)
            if len(linked):
                out.append((i, int(linked[0])))
                break
    return out


def joined(seed: np.ndarray, old: list) -> np.ndarray:
    """Seeds of components after those that share an ``old`` one (null: none) are put together."""
    first: dict = {}
    top = np.arange(len(seed))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    for s, o in zip(seed.tolist(), old, strict=True):
        if not pd.isna(o):
            a, b = find(s), find(first.setdefault(o, s))
            top[max(a, b)] = min(a, b)
    return np.array([find(s) for s in seed.tolist()], np.int64)


# --- the operator ------------------------------------------------------------------------------


MOST_HOT = 50_000
HOT = 1 << 40
SAMPLE = 64


def hot_keys(rows: DataFrame) -> list[int]:
    """Keys that more than about ``KEY_ROWS`` rows hold, told from one row in ``SAMPLE``; at most ``MOST_HOT``.

    It only decides how keys are dealt out: a key that is missed or named in vain changes no link."""
    some = rows.where("keys is not null").where(F.pmod(F.xxhash64("node", F.lit("hot")), F.lit(SAMPLE)) == 0)
    counts = some.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * SAMPLE > KEY_ROWS)
    return [r["key"] for r in counts.orderBy(F.desc("n"), "key").limit(MOST_HOT).collect()]


def held_by_two(keyed: DataFrame) -> DataFrame:
    """The rows of (node, key, ..) whose key more than one node holds, with ``d``: how many rows have the key."""
    every = Window.partitionBy("key")
    counted = keyed.withColumns({"low": F.min("node").over(every), "high": F.max("node").over(every), "d": F.count("*").over(every)})
    return counted.where("low <> high").select("node", "key", "d")


def ties(keyed: DataFrame, hot: list[int], percent: int) -> DataFrame:
    """(node, key, d): those of the emitted keys that linked sets can meet by.

    Linked sets share ``shared_least`` keys of a class. A node with fewer keys there that others hold too has no
    link in it, so its keys go. Of the T and more that stay to it the T - 1 that most rows have are not
    needed: the rarest key that linked sets share is never among them. ``d`` of hot keys is ``HOT``."""
    least = F.element_at(F.array(*[F.lit(n) for n in shared_least(percent)]), F.col("class") + 1)
    cold = lambda df: held_by_two(df.where(F.col("d") < HOT)).unionByName(df.where(F.col("d") >= HOT)) if hot else held_by_two(df)

    if hot:
        keyed = marked(keyed, "key", hot, "hot").select("node", "key", F.when(F.col("hot"), F.lit(HOT)).otherwise(0).cast("long").alias("d"))
    by = cold(keyed).groupBy("node", F.col("key").bitwiseAND(CLASS_BITS).cast("int").alias("class"))
    own = by.agg(F.sort_array(F.collect_set(F.struct("d", "key"))).alias("keys")).where(F.size("keys") >= least)
    rare = own.select("node", F.explode(F.slice("keys", F.lit(1), F.size("keys") - least + 1)).alias("k"))
    return materialise(cold(rare.select("node", "k.key", "k.d")), "ngram-ties")


def near_duplicates(
    docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
    unit_shingles: int = 2_000_000, unit_docs: int = 3_000,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_words): the components of links with at least ``percent`` similarity."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()  # a copy within the partition adds no keys
        for pdf in batches:
            sets, counts = shingle_sets_and_words(list(pdf["t"]), words)
            out, new = [], []
            for i, h, m in zip(pdf["id"], sets, counts, strict=True):
                node, check = set_digest(h)
                if len(h) and not pd.isna(i) and (node, check) not in seen:
                    if len(seen) < 1_000_000:
                        seen.add((node, check))
                    new.append(len(out))
                out.append([i, len(h), m, node, check, None])
            for k, keys in zip(new, join_keys([sets[k] for k in new], percent), strict=True):
                out[k][-1] = None if keys is None else keys.view(np.int64)
            yield pd.DataFrame(out, columns=["id", "n", "words", "node", "check", "keys"]).astype({"id": "Int64"})

    rows = materialise(texts.mapInPandas(sketch, "id long, n long, words long, node long, check long, keys array<long>"), "ngram-sketch")
    named = lambda df: df.where("n > 0 and id is not null").groupBy("node").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.min("check").alias("check"), F.max("check").alias("other"))
    nodes = materialise(named(rows), "ngram-nodes")
    if shared := nodes.where("check <> other").count():  # different sets of one name: some in 10^10
        twins = nodes.where("check <> other").select(F.col("node").alias("twin"))
        twins = F.broadcast(twins) if shared <= BROADCAST_ROWS else twins
        renamed = F.when(F.col("twin").isNotNull(), F.xxhash64("node", "check")).otherwise(F.col("node"))
        rows = materialise(rows.join(twins, F.col("node") == F.col("twin"), "left").withColumn("node", renamed).drop("twin"), "ngram-sketch")
        nodes = materialise(named(rows), "ngram-nodes")
    nodes = nodes.drop("other")

    # A star per key: its smallest node is tied to the others. A node without a shared key has no edge.
    keyed = rows.where("keys is not null").select("node", F.explode("keys").alias("key"))
    tied = lambda df, *by: df.withColumn("hub", F.first("node").over(Window.partitionBy(*by).orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    hot = hot_keys(rows)
    keyed = ties(keyed, hot, percent)
    if hot:
        keyed = keyed.withColumn("hot", F.col("d") >= HOT)
        salt = F.pmod(F.xxhash64("node", F.lit("salt")), F.lit(-(-nodes.count() // KEY_ROWS)))
        salted = tied(keyed.where("hot").withColumn("salt", salt), "key", "salt")
        tops = tied(salted.select("key", F.col("hub").alias("node")).distinct(), "key")
        near = tied(keyed.where("not hot"), "key").select("node", "hub").unionByName(salted.select("node", "hub")).unionByName(tops.select("node", "hub"))
    else:
        near = tied(keyed, "key")
    edges = near.select(F.col("node").alias("u"), F.col("hub").alias("v")).where("u <> v").distinct()
    clusters = connected_components(edges, "ngram-clusters").select("node", F.col("label").alias("cluster"))
    clusters = materialise(clusters.join(nodes, "node"), "ngram-members")

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        """(u, v, turn): u belongs to the component of v. Members of an ``old`` component (of a part) keep together;
        with ``known`` ones there, which are one component, one link into it is told of each of the others."""
        own = pdf.drop_duplicates(["cluster", "node", "t"]).sort_values(["cluster", "node"])
        clusters: dict[int, dict[int, tuple]] = {}
        for c, node, check, k, o, h in zip(own["cluster"], own["node"], own["check"], own["known"], own["old"], shingle_sets(list(own["t"]), words), strict=True):
            if set_digest(h)[1] == check:  # another text may go by the same id
                clusters.setdefault(c, {})[node] = (h, bool(k), o)
        out: list[tuple[int, int, int]] = []
        for members in clusters.values():
            names = list(members)
            sets, known, old = zip(*members.values(), strict=True)
            if any(known):
                out += [(names[i], names[j], 0) for i, j in links_into(list(sets), np.array(known), percent)]
            else:
                turns: Counter = Counter()
                for i, seed in enumerate(joined(link_labels(list(sets), percent), list(old)).tolist()):
                    out.append((names[i], names[seed], turns[seed]))
                    turns[seed] += 1
        return pd.DataFrame(out, columns=["u", "v", "turn"]).astype("int64")

    def links_of(placed: DataFrame, name: str) -> DataFrame:
        """Links inside every group of (unit, a, b)."""
        placed = placed.select("rep", "node", "check", "cluster", "unit", "a", "b", "known", "old")
        if placed.count() <= BROADCAST_ROWS:
            placed = F.broadcast(placed)
        members = texts.join(placed, F.col("id") == F.col("rep")).select("node", "check", "cluster", "unit", "a", "b", "known", "old", "t")
        return materialise(members.groupBy("unit", "a", "b").applyInPandas(link, "u long, v long, turn long"), name)

    parts = lambda n, docs: F.greatest(F.ceil(n / unit_shingles), F.ceil(docs / unit_docs)).cast("int")
    dealt = lambda n, salt, by="node": F.pmod(F.xxhash64(by, F.lit(salt)), n).cast("int")
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    none, zero = F.lit(None).cast("long").alias("old"), F.lit(0)

    # Small clusters together, the parts of large ones each for itself.
    sizes = clusters.groupBy("cluster").agg(F.sum("n").alias("total"), F.count("*").alias("docs"))
    sizes = materialise(sizes.withColumn("parts", parts(F.col("total"), F.col("docs"))).where("parts > 1").select("cluster", "parts"), "ngram-sizes")
    total, split = clusters.agg(F.sum("n")).first()[0] or 0, sizes.limit(1).count() > 0
    units = max(24, -(-total // unit_shingles))
    placed = clusters.join(few(sizes), "cluster", "left").withColumn("a", F.when(F.col("parts").isNotNull(), dealt(F.col("parts"), "part")).otherwise(-1))
    unit = F.when(F.col("parts").isNotNull(), F.col("cluster")).otherwise(F.pmod(F.xxhash64("cluster", F.lit("unit")), F.lit(units)))
    placed = materialise(placed.withColumn("unit", unit), "ngram-placed")
    links = links_of(placed.withColumns({"b": zero, "known": F.lit(False), "old": none}), "ngram-links")
    # Groups are disjoint, so without large clusters the labels are final: v is the seed of u's component.
    labels = links.select(F.col("u").alias("node"), F.col("v").alias("label"))
    if split:
        large = placed.where("parts is not null").select("rep", "node", "check", "cluster", "n", F.col("cluster").alias("unit")).join(links.withColumnsRenamed({"u": "node", "v": "part_label"}), "node")
        large = materialise(large, "ngram-large")
        # Some documents of every part's components, those of one component together in one group.
        some = large.where(F.col("turn") < SPOKESMEN)
        groups = some.groupBy("cluster").agg(parts(F.sum("n"), F.count("*")).alias("groups"))
        some = some.join(few(materialise(groups, "ngram-groups")), "cluster").withColumns({"a": dealt(F.col("groups"), "some", "part_label"), "b": F.lit(-2), "known": F.lit(False), "old": F.col("part_label")})
        some = links_of(some, "ngram-links").where("u <> v").join(large.select(F.col("node").alias("u"), F.col("part_label").alias("old_label")), "u")
        some = some.groupBy("old_label").agg(F.min("v").alias("new_label"))
        large = large.join(some, F.col("part_label") == F.col("old_label"), "left").withColumn("label", F.coalesce("new_label", "part_label")).drop("old_label", "new_label")
        large = materialise(large, "ngram-large")
        # What is outside the largest component of its cluster, with each other and with that component.
        by_label = large.groupBy("cluster", "label").agg(F.count("*").alias("docs"), F.sum("n").alias("n"))
        shape = by_label.groupBy("cluster").agg(F.max_by(F.struct("label", "docs", "n"), F.struct("docs", "label")).alias("g"), F.sum("docs").alias("docs"), F.sum("n").alias("n"))
        shape = shape.select("cluster", F.col("g.label").alias("top"), parts(F.col("g.n"), F.col("g.docs")).alias("g"), parts(F.col("n") - F.col("g.n"), F.col("docs") - F.col("g.docs")).alias("r"))
        rest = large.join(few(materialise(shape.where("r > 0"), "ngram-shape")), "cluster").withColumns({"known": F.col("label") == F.col("top"), "old": F.col("label")})
        count = lambda n: F.sequence(zero, n - 1)
        i, k = dealt(F.col("r"), "rest"), dealt(F.col("g"), "top")
        pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
        tasks = F.when(F.col("known"), F.transform(count(F.col("r")), lambda x: pair(x, -3 - k))).otherwise(
            F.concat(F.transform(count(F.col("g")), lambda x: pair(i, -3 - x)), F.transform(count(F.col("r")), lambda x: pair(F.least(x, i), F.greatest(x, i))))
        )
        rest = rest.withColumn("task", F.explode(tasks)).select("rep", "node", "check", "cluster", "unit", "task.a", "task.b", "known", "old")
        more = links_of(rest, "ngram-links").select("u", "v").where("u <> v")
        of = lambda c: large.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
        more = more.join(of("u"), "u").join(of("v"), "v").select(F.col("u_label").alias("u"), F.col("v_label").alias("v"))
        last = connected_components(more, "ngram-labels").withColumnsRenamed({"node": "last_node", "label": "last_label"})
        large = large.join(last, F.col("label") == F.col("last_node"), "left").select("node", F.coalesce("last_label", "label").alias("label"))
        small = links.join(placed.where("parts is null").select(F.col("node").alias("u")), "u").select(F.col("u").alias("node"), F.col("v").alias("label"))
        labels = small.unionByName(large)
    named = nodes.join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    component = named.join(least, "label").select("node", "component_id")
    return (
        rows.select("id", "n", "words", "node").join(component, "node", "left")
        .select(
            F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
            F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
            F.col("words").alias("n_words"),
        )
    )


def text_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A name for a row's id and text, where ids may be null or repeated."""
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.col(text_col), F.lit("")))


def row_name(twins: list[int]) -> Column:
    """``text_key`` of the documents' rows; of the rare keys that name two different rows a key by both hashes."""
    check = F.xxhash64(F.lit("check"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.col("text"), F.lit("")))
    return F.when(text_key().isin(twins), F.xxhash64(text_key(), check)).otherwise(text_key()) if twins else text_key()


def keep_one(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of every component: that with the smallest id (rows without an id last, then by a hash of the text).

    Rows are told apart by id and text, so an id that is used for several texts loses only the copies; a row that
    repeats id and text counts once. Texts without words are linked with nothing: all stay. A row's name is one hash, checked by another: where
    two rows share the first (three times in 10^10 rows) both go by the two together."""
    check = F.xxhash64(F.lit("check"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(F.col("text"), F.lit("")))
    named = docs.select(text_key().alias("key"), check.alias("check"), F.col("doc_id").cast("long").alias("doc_id"))
    marks = materialise(named.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.min("check").alias("check"), F.max("check").alias("other")), "ngram-marks")
    twins = [r["key"] for r in marks.where("check <> other").select("key").collect()]
    if twins:
        named = docs.select(row_name(twins).alias("key"), F.col("doc_id").cast("long").alias("doc_id"))
        marks = materialise(named.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "ngram-marks")
    found = near_duplicates(docs.select(row_name(twins).alias("key"), "text"), words=words, percent=percent, id_col="key")
    found = found.select(F.col("doc_id").alias("key"), F.col("component_id").alias("component")).distinct()
    ranked = materialise(marks.select("key", "doc_id", "n").join(found, "key"), "ngram-ranked")
    first = ranked.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key"))["key"].alias("first")).select("first")
    gone = materialise(ranked.join(first, F.col("key") == F.col("first"), "left_anti").select(F.col("key").alias("__gone")), "ngram-gone")
    if ranked.where("n > 1").limit(1).count():
        rows = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        docs = docs.select(rows.alias("__row"), row_name(twins).alias("__key")).dropDuplicates(["__key"]).select("__row.*")
    few = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, row_name(twins) == F.col("__gone"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' components under links of Jaccard similarity 0.9 or more on three-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=90).select("doc_id", "n_shingles", "component_id")


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n_shingles FROM s),
x AS MATERIALIZED (SELECT doc_id, unnest(sh) AS g FROM s),
p AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE 100 * least(na.n_shingles, nb.n_shingles) >= 90 * greatest(na.n_shingles, nb.n_shingles)
  GROUP BY a.doc_id, b.doc_id, na.n_shingles, nb.n_shingles
  HAVING 100 * count(*) >= 90 * (na.n_shingles + nb.n_shingles - count(*))),
e AS MATERIALIZED (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.doc_id)
SELECT n.doc_id, CAST(n.n_shingles AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n_shingles
"""
