"""Operator 7: approximate nearest neighbours by a permutation index.

Every vector is represented by the order of its nearest pivots. It is posted, with that order,
in the inverted files of its ``posts`` nearest pivots. A query reads the files of its own
``probes`` nearest pivots, ranks what is posted there by the footrule distance between the pivot orders
and keeps what is not above the query's cut; only these vectors are fetched and ranked anew by exact
Euclidean distance in double precision. A vector that several of the files hold counts in the first.

The cut is the footrule distance below which the share ``keep`` of all vectors lies (``least_kept``
vectors at least), told from a hashed sample of ``sample`` vectors; ties at the cut stay. It
does not depend on how files are split.

Members of a tight group share nearly one permutation, so the footrule cannot rank them. There
the k-th distance found is a sharp bound: by the triangle inequality a vector can only win if
its distance to its nearest pivot, which is stored, differs from the query's by no more. Where
that bound leaves at most ``second_share`` of all vectors (or fewer than k were found), every
vector that it leaves is ranked by exact distance and the query's result is that of brute force.
Elsewhere (near-uniform vectors, where the bound excludes nothing) the result is approximate.

Scale: pivots and the sample are bounded by parameters; every vector is indexed. A file with
more than ``file_rows`` vectors is split by a hash of the id, and so are the vectors themselves and
more than ``query_rows`` queries: a hot pivot or vector makes more groups, not larger ones.
Vectors are copied once per block of queries; each group gives at most k rows per query.

Defined results: vectors that are null, zero, of another length than most or hold null, NaN or
infinite components are neither found nor asked for. Ties go to the smaller id. With
fewer than k candidates all are returned. Repeated ids are candidates of their
own, except for the query of the same id. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialise, table

RESULT = "query_id long, vec_id long, score double"
MOST_PIVOTS = 256  # a rank takes one byte


def usable(v: Column) -> Column:
    inf = F.lit(float("inf"))
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists(v, lambda x: x != 0)


def choose_pivots(vectors: DataFrame, most: int) -> np.ndarray:
    """Distinct vectors of a hashed sample, bounded by four times ``most`` rows."""
    rows = vectors.orderBy(F.xxhash64("id", F.lit("pivot")), "id").limit(4 * most).collect()
    seen = dict.fromkeys(tuple(r["v"]) for r in rows)
    return np.array(list(seen)[:most], np.float64)


def pivot_orders(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Pivot numbers of every vector, nearest first, then by number."""
    return np.argsort((pivots**2).sum(axis=1)[None] - 2 * x @ pivots.T, axis=1, kind="stable")


def rows_of(cells: pd.Series, kind: type) -> np.ndarray:
    """A matrix from a column of equally long binary cells."""
    return np.frombuffer(b"".join(cells), kind).reshape(len(cells), -1)


def footrule(ranks: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Sum over the pivots of the difference in rank, between every row and one query."""
    return (np.maximum(ranks, own) - np.minimum(ranks, own)).sum(axis=1, dtype=np.int32)


def nearest(ids: np.ndarray, x: np.ndarray, q: int, v: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest of rows in order of id, without the query's own."""
    other = ids != q
    ids, dist = ids[other], np.sqrt(((x[other] - v) ** 2).sum(axis=1))
    best = np.argsort(dist, kind="stable")[:k]
    return pd.DataFrame({"query_id": q, "vec_id": ids[best], "score": dist[best]})


def together(found: list[pd.DataFrame]) -> pd.DataFrame:
    none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
    return pd.concat(found, ignore_index=True) if found else none


def slack(size: np.ndarray | float) -> np.ndarray | float:
    """What rounding may cost a bound on distances of this size."""
    return 1e-9 * size


@dataclass
class PermutationIndex:
    """``rows``: id, v and ranks as binary, home (nearest pivot), away (its distance), vblock, files (where it is posted)."""

    rows: DataFrame
    points: np.ndarray
    total: int
    vblocks: int
    file_rows: int


def build(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = 256, posts: int = 8, file_rows: int = 4_096) -> PermutationIndex | None:
    """The index over every usable vector; None if there is none."""
    if not 0 < pivots <= MOST_PIVOTS:
        raise ValueError(f"pivots must be 1 to {MOST_PIVOTS}")
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return None
    good = good.where(F.size("v") == sizes[0]["n"])
    total = sizes[0]["count"]
    points = choose_pivots(good, pivots)
    vblocks = -(-total // file_rows)

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["v"].to_numpy())
                order = pivot_orders(x, points)
                ranks = np.empty(order.shape, np.uint8)
                np.put_along_axis(ranks, order, np.broadcast_to(np.arange(order.shape[1]).astype(np.uint8), order.shape), axis=1)
                away = np.sqrt(((x - points[order[:, 0]]) ** 2).sum(axis=1))
                yield pd.DataFrame({
                    "id": pdf["id"], "v": [r.tobytes() for r in x], "ranks": [r.tobytes() for r in ranks], "home": order[:, 0].astype(np.int32), "away": away,
                    "files": list(order[:, :posts].astype(np.int32)), "vblock": pdf["vblock"],
                })

    dealt = good.withColumn("vblock", F.pmod(F.xxhash64("id", F.lit("vectors")), F.lit(vblocks)).cast("int"))
    rows = dealt.mapInPandas(index, "id long, v binary, ranks binary, home int, away double, files array<int>, vblock int")
    return PermutationIndex(materialise(rows, "permutation-index"), points, total, vblocks, file_rows)


def cuts(index: PermutationIndex, keep: float, least_kept: int, sample: int):  # noqa: ANN201
    """For a query's ranks the footrule distance that the kept share of all vectors does not exceed."""
    rows = index.rows.select("id", "ranks").orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(sample).collect()
    known = np.frombuffer(b"".join(r["ranks"] for r in rows), np.uint8).reshape(len(rows), -1)
    place = min(len(rows), max(1, round(max(keep, (least_kept + 1) / index.total) * len(rows)))) - 1

    def cut(own: np.ndarray) -> int:
        return int(np.partition(footrule(known, own), place)[place])

    return cut


def ranked(index: PermutationIndex, asked: DataFrame, *, posts: int, probes: int, keep: float, least_kept: int, sample: int, blocks: int) -> DataFrame:
    """(id, block, vblock, vids): per query the vectors that its inverted files hold and that the footrule keeps."""
    posted = index.rows.select("id", "ranks", "vblock", F.explode("files").alias("file"))
    parts = {r["file"]: -(-r["n"] // index.file_rows) for r in posted.groupBy("file").agg(F.count("*").alias("n")).collect()}  # one row per pivot
    cut = cuts(index, keep, least_kept, sample)

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row per query and (part of a) file that it reads."""
        for pdf in batches:
            rows = []
            for q, block, r in zip(pdf["id"], pdf["block"], pdf["ranks"], strict=True):
                own = np.frombuffer(r, np.uint8)
                most = cut(own)
                for turn, f in enumerate(np.argsort(own)[:probes].tolist()):
                    rows += [(q, block, r, most, turn, f, p) for p in range(parts.get(f, 0))]
            yield pd.DataFrame(rows, columns=["id", "block", "ranks", "most", "turn", "file", "part"])

    def keep_near(vecs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vecs) and len(queries):
            ids, vblock, ranks = vecs["id"].to_numpy(), vecs["vblock"].to_numpy(), rows_of(vecs["ranks"], np.uint8)
            for q, block, r, most, turn in zip(queries["id"], queries["block"], queries["ranks"], queries["most"], queries["turn"], strict=True):
                own = np.frombuffer(r, np.uint8)
                before = np.argsort(own)[:turn]
                new = np.flatnonzero((ranks[:, before] >= posts).all(axis=1)) if turn else np.arange(len(ids))
                near = new[footrule(ranks[new], own) <= most]
                order = near[np.argsort(vblock[near], kind="stable")]
                at = np.flatnonzero(np.diff(vblock[order], prepend=-1))
                out += [(q, block, vblock[g[0]], ids[g]) for g in np.split(order, at[1:]) if len(g)]
        return pd.DataFrame(out, columns=["id", "block", "vblock", "vids"])

    split = F.create_map(*[F.lit(x) for f, n in parts.items() for x in (f, n)])
    readers = asked.select("id", "block", "ranks").mapInPandas(files, "id long, block int, ranks binary, most int, turn int, file int, part int")
    posted = posted.withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), F.element_at(split, F.col("file"))).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    keys = ("file", "part", "block")
    return posted.groupBy(*keys).cogroup(readers.groupBy(*keys)).applyInPandas(keep_near, "id long, block int, vblock int, vids array<long>")


def search(
    vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = 10, pivots: int = 256, posts: int = 12, probes: int = 48,
    keep: float = 0.25, least_kept: int = 256, sample: int = 4_096, second_share: float = 0.4, file_rows: int = 4_096, query_rows: int = 2_048,
) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``; (query_id, rank, vec_id, score)."""
    index = build(vectors, id_col=id_col, vec_col=vec_col, pivots=pivots, posts=posts, file_rows=file_rows)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    points = index.points
    asked = index.rows.where(F.col("id") % every == 0)
    blocks = max(1, -(-asked.count() // query_rows))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)).cast("int"))
    pairs = ranked(index, asked, posts=posts, probes=probes, keep=keep, least_kept=least_kept, sample=sample, blocks=blocks)
    stored = index.rows.select("id", "v", "home", "away", "vblock").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(index.vblocks - 1))).alias("vblock")

    def by_id(vecs: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(vecs["id"].to_numpy(), kind="stable")
        return order, vecs["id"].to_numpy()[order], rows_of(vecs["v"], np.float64)[order]

    def rerank(vecs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        """Exact distances of the kept vectors. ``queries`` has a row with v per query and rows with vids."""
        wanted = {q: list(own) for q, own in queries[queries["v"].isna()].groupby("id")["vids"]}
        if not len(vecs) or not wanted:
            return together([])
        _, ids, x = by_id(vecs)
        own = queries[queries["v"].notna()].drop_duplicates("id")
        out = []
        for q, v in zip(own["id"], own["v"], strict=True):
            if q in wanted:
                near = np.flatnonzero(np.isin(ids, np.concatenate(wanted[q])))
                out.append(nearest(ids[near], x[near], q, np.frombuffer(v, np.float64), k))
        return together(out)

    keys = ("vblock", "block")
    own = asked.select("id", "block", everywhere, "v", F.lit(None).cast("array<long>").alias("vids"))
    rows = own.unionByName(pairs.select("id", "block", "vblock", F.lit(None).cast("binary").alias("v"), "vids"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    first = stored.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(rerank, RESULT)
    first = materialise(first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "permutation-first")

    # Which queries the bound serves: told by the quantiles of the distances to each pivot.
    steps = [i / 64 for i in range(65)]
    told = index.rows.groupBy("home").agg(F.count("*").alias("n"), F.percentile_approx("away", steps, 1_000).alias("steps")).collect()  # one row per pivot
    spread = [(r["home"], r["n"], np.array(r["steps"])) for r in told]
    total = index.total

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            serves = []
            for v, reach in zip(pdf["v"], pdf["reach"], strict=True):
                away = np.sqrt(((points - np.frombuffer(v, np.float64)) ** 2).sum(axis=1))
                left = sum(n * max(0, np.searchsorted(s, away[f] + reach, side="right") - np.searchsorted(s, away[f] - reach, side="left") + 1) / 65 for f, n, s in spread)
                serves.append(bool(np.isinf(reach) or left <= second_share * total))
            yield pdf[serves]

    kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("reach"))
    reaches = asked.join(kth, "id", "left").select("id", "block", "v", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
    again = materialise(reaches.mapInPandas(bounded, "id long, block int, v binary, reach double"), "permutation-reach")

    def reachable(vecs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vecs) or not len(queries):
            return together([])
        order, ids, x = by_id(vecs)
        home, away, out = vecs["home"].to_numpy()[order], vecs["away"].to_numpy()[order], []
        for q, v, reach in zip(queries["id"], queries["v"], queries["reach"], strict=True):
            v = np.frombuffer(v, np.float64)
            own = np.sqrt(((points - v) ** 2).sum(axis=1))[home]
            near = np.flatnonzero(np.abs(away - own) <= reach + slack(own + away))
            out.append(nearest(ids[near], x[near], q, v, k))
        return together(out)

    second = stored.groupBy(*keys).cogroup(again.select("id", "block", "v", "reach", everywhere).groupBy(*keys)).applyInPandas(reachable, RESULT)
    found = first.drop("rank").join(again.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(second)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth vector."""
    return search(table(spark, sf_dir, "embeddings"))
