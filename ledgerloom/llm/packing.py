"""Operator 4: conflict-constrained best-fit packing.

Pieces of documents go into bins of ``capacity`` words. Bins are kept in the order of their
residual room and carry two bitmaps: of the sources and of the duplicate clusters that they hold.
A piece goes to the tightest bin whose bitmaps share no bit with its own: the successor
search starts at the first bin with enough room and goes on until a compatible one is
found; if there is none, a new bin is opened. Longer pieces go first.

Scale: rows are dealt by a hash to shards of about ``shard_rows`` rows, whose number follows the row
count, so a hot source or cluster is spread over all shards and no task grows with the input. The hash is of
all that packing knows of a row, and rows that are equal in all of it are counted first and dealt one by one:
very many null ids or repeats of an id are spread like other rows. Only ids, lengths and cluster hashes are
shuffled, not texts. Bins belong to one shard. ``pack_stored`` deals by the order in which documents are
stored instead (the mix of sources that the stage before it wrote): a shard is ``shard_rows`` documents that follow one another, and
shards are numbered in that order. Places are counted by files, whose rows are numbered by the reader.

Defined results: a document longer than the capacity is cut into full pieces and a rest;
null and texts without words are one piece of no words. A null source conflicts with
no other null source. Clusters are copies of one text or given by ``cluster_col``;
``pack_apart`` takes the components of near copies.
Repeated rows are documents of their own, and so never share a bin (equal
clusters). An empty table gives no rows. Very long texts are cut into pieces, none is left out. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialise, table
from ledgerloom.llm.ngram_join import near_duplicates, text_key


class Bins:
    """Open bins in order of residual room; a bin that changes moves within arrays that are kept."""

    def __init__(self, capacity: int, words: int) -> None:
        self.capacity, self.open, self.opened = capacity, 0, 0
        self._room, self._ids, self._maps = np.zeros(64, np.int64), np.zeros(64, np.int64), np.zeros((64, words), np.uint64)

    room = property(lambda self: self._room[: self.open])
    ids = property(lambda self: self._ids[: self.open])
    maps = property(lambda self: self._maps[: self.open])

    def successor(self, need: int, bits: np.ndarray) -> int:
        """Place of the tightest compatible bin, -1 if there is none."""
        at, step = int(self.room.searchsorted(need)), 64
        while at < self.open:
            clash = (self.maps[at : at + step] & bits).any(axis=1)
            free = int(clash.argmin())
            if not clash[free]:
                return at + free
            at, step = at + step, step * 2
        return -1

    def put(self, need: int, bits: np.ndarray) -> int:
        """The bin that the piece goes to."""
        at = self.successor(need, bits)
        if at < 0:
            bin_id, room, maps = self.opened, self.capacity - need, bits
            self.opened += 1
            if room <= 0:
                return bin_id
            if self.open == len(self._room):
                self._room, self._ids = np.resize(self._room, 2 * self.open), np.resize(self._ids, 2 * self.open)
                self._maps = np.resize(self._maps, (2 * self.open, self._maps.shape[1]))
            at, self.open = self.open, self.open + 1
            to = int(self._room[:at].searchsorted(room))
        else:
            bin_id, room, maps = int(self.ids[at]), int(self.room[at]) - need, self.maps[at] | bits
            if room <= 0:  # a full bin takes nothing any more
                for x in (self._room, self._ids, self._maps):
                    x[at : self.open - 1] = x[at + 1 : self.open]
                self.open -= 1
                return bin_id
            to = int(self.room[: at + 1].searchsorted(room))
        for x, new in ((self._room, room), (self._ids, bin_id), (self._maps, maps)):
            x[to + 1 : at + 1] = x[to:at]
            x[to] = new
        return bin_id


def pack_shard(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Best fit over one shard of (shard, doc_id, source, cluster, n_words)."""
    pieces = []
    for i, n in enumerate(pdf["n_words"].to_numpy()):
        for k in range(max(1, -(-int(n) // capacity))):
            pieces.append((min(capacity, int(n) - k * capacity), i, k))
    doc, key = pdf["doc_id"].to_numpy(), pdf["cluster"].to_numpy()
    pieces.sort(key=lambda p: (-p[0], key[p[1]], pd.isna(doc[p[1]]), 0 if pd.isna(doc[p[1]]) else doc[p[1]], p[2]))
    sources = pdf["source"].to_numpy()
    # Bits: one per source, and one per cluster with more than one row here (others can clash with none).
    source_bit = {s: i for i, s in enumerate(sorted({s for s in sources if s is not None}))}
    shared = {c: i for i, c in enumerate(sorted(c for c, n in pd.Series(key).value_counts().items() if n > 1))}
    words = (len(source_bit) + len(shared)) // 64 + 1
    bins, out = Bins(capacity, words), []
    for need, i, k in pieces:
        bits = np.zeros(words, np.uint64)
        own = [source_bit[sources[i]]] if sources[i] is not None else []
        if key[i] in shared:
            own.append(len(source_bit) + shared[key[i]])
        for b in own:
            bits[b // 64] |= np.uint64(1 << (b % 64))
        out.append((doc[i], k, k * capacity, need, bins.put(need, bits)))
    out = pd.DataFrame(out, columns=["doc_id", "piece", "start_word", "n_words", "bin"])
    out.insert(0, "shard", pdf["shard"].iloc[0])
    return out


def measures(text_col: str, source_col: str, cluster_col: str | None) -> list[Column]:
    """doc_id, source, cluster and n_words: all that packing needs of a document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.xxhash64(text if cluster_col is None else F.col(cluster_col)).alias("cluster"),
        F.regexp_count(text, F.lit(r"\S+")).cast("int").alias("n_words"),
    ]


def in_shards(rows: DataFrame, shard_rows: int) -> DataFrame:
    """Adds ``shard`` to (doc_id, source, cluster, n_words): a hash of the row and of its number among equal rows."""
    own = ("doc_id", "source", "cluster", "n_words")
    counted = materialise(rows.groupBy(*own).agg(F.count("*").alias("n")), "pack-rows")
    total = counted.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_rows))
    dealt = counted.select(*own, F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    return dealt.select(*own, F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1).cast("long")), "cluster", "n_words", F.coalesce("source", F.lit("")), "copy"), F.lit(shards)).cast("int").alias("shard"))


def packed(rows: DataFrame, capacity: int) -> DataFrame:
    """Best fit over every shard of (shard, doc_id, source, cluster, n_words)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pack_shard(pdf, capacity)

    rows = rows.select("shard", "doc_id", "source", "cluster", "n_words")
    out = rows.groupBy("shard").applyInPandas(one, "shard int, doc_id long, piece int, start_word int, n_words int, bin long")
    return out.select(F.concat_ws("-", "shard", "bin").alias("bin_id"), "doc_id", "piece", "start_word", "n_words")


def pack(
    docs: DataFrame, *, capacity: int = 2_048, shard_rows: int = 2_048, text_col: str = "text", source_col: str = "source", cluster_col: str | None = None
) -> DataFrame:
    """(bin_id, doc_id, piece, start_word, n_words): the pieces that each bin holds."""
    rows = docs.select(*measures(text_col, source_col, cluster_col))
    return packed(in_shards(rows, shard_rows), capacity)


def pack_apart(
    docs: DataFrame, *, words: int = 5, percent: int = 80, capacity: int = 2_048, shard_rows: int = 2_048, text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """``pack`` with the components of near copies as clusters.

    Rows are named by a hash of id and text, so that repeated and null ids keep their texts apart. Texts
    without words have no near copies; their cluster is the exact text."""
    key = text_key("doc_id", text_col)
    found = near_duplicates(docs.select(key.alias("key"), text_col), words=words, percent=percent, id_col="key", text_col=text_col)
    component = F.min(F.when(F.col("n_shingles") > 0, F.col("component_id"))).alias("component")
    found = found.groupBy(F.col("doc_id").alias("key")).agg(component, F.min("n_words").cast("int").alias("n_words"))
    doc_id, source, cluster, _ = measures(text_col, source_col, None)
    rows = docs.select(key.alias("key"), doc_id, source, cluster).join(found, "key").withColumn("cluster", F.coalesce("component", "cluster"))
    return packed(in_shards(rows, shard_rows), capacity)


def places(docs: DataFrame) -> DataFrame:
    """``docs``, read from files, with ``place``: how many rows precede a row in the order of the files and of the rows in them."""
    name = F.col("_metadata.file_name")
    # part-<task>-<id>.c<file of the task>: by number, as names only sort while numbers have five digits.
    number = lambda pattern: F.coalesce(F.regexp_extract("file", pattern, 1).try_cast("long"), F.lit(-1).cast("long"))
    rows = docs.select("*", name.alias("file"), F.col("_metadata.row_index").alias("row"))
    files = materialise(rows.groupBy("file").agg(F.count("*").alias("n")), "pack-files")
    order = Window.partitionBy(F.lit(1)).orderBy(number(r"part-(\d+)"), number(r"[-.]c(\d+)\."), "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    return rows.join(starts, "file").withColumn("place", F.col("before") + F.col("row")).drop("file", "row", "before")


def pack_stored(docs: DataFrame, *, capacity: int = 2_048, shard_rows: int = 2_048, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``pack`` with shards that are ranges of the order in which documents are stored (a mix of sources, say); ``mix_from`` is the
    place at which a bin's shard begins.

    ``docs`` are read from Parquet files whose numbers and rows give the order, as a sorted table is written; other DataFrames
    are written first, in the order of their partitions."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.col(f"`{text_col}`").alias("text"))
    stored = bool(docs.inputFiles()) and "_metadata" not in docs.columns
    if stored:
        try:
            docs.select("_metadata.row_index")
        except AnalysisException:  # files, but joined or sorted since they were read
            stored = False
    own = docs if stored else materialise(own, "pack-stored")
    text, source = (text_col, source_col) if stored else ("text", "source")
    rows = materialise(places(own).select("place", *measures(text, source, None)), "pack-rows")
    out = packed(rows.withColumn("shard", F.floor(F.col("place") / shard_rows).cast("int")), capacity)
    return out.withColumn("mix_from", F.split("bin_id", "-")[0].cast("long") * shard_rows)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in bins of 2,048 words, no two of one source or near copies (five words, 0.8) together."""
    return pack_apart(table(spark, sf_dir, "documents"))
