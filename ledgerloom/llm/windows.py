"""Operator 13: bounded-space online packing of token ids into sequences.

Every partition of the input keeps at most ``open_windows`` windows of ``size`` ids. A document's full
windows go out at once; its rest goes to the fullest window that still has room for it (best fit) or
to a new one. Where none fits and no more may be opened, the fullest window goes out: a gap of at most
``slack`` ids is padded, a larger one is filled with the beginning of the rest, which goes on without it.
The windows left open at the end of the partitions are merged in rounds of ``fan_in`` groups: whole
windows by best fit, then ids from the emptiest to the fullest, until one is left; the very last is cut
into powers of two, which need no padding. So a sequence has at most ``slack`` ids of padding.

Scale: texts are read once and never shuffled; a task holds one Arrow batch, the open windows and its
worker's table of words. Only open windows (at most ``open_windows`` of each partition, 8 KB each) are
shuffled, and a merging task holds ``fan_in`` partitions' worth of them at most. A hot source or a group of copies changes nothing.

Ids are those of the ``tokenizers`` library for the whole text, then ``end_id``. White space never joins
the token of a character before it (the pre-tokenizer's rule), so texts are cut before white space and
equal pieces are looked up, not encoded again; the table is per worker, and emptied at ``Encoder.MOST`` pieces.

Defined results: null and empty texts are the one id ``end_id``; null ids and repeated rows are documents of
their own; very long texts are encoded in parts of about a million characters and cut into windows, no id is left
out; an empty table gives no rows. Other columns are not read, whatever their names. Which documents share
a sequence follows the input's partitions; the pieces' ids do not.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import materialise, small_batches, spread, table

# The characters that the pre-tokenizer takes for white space; letters of Latin-1.
SPACE = "\t-\r \x85\xa0  -     　"
LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"


def byte_symbols() -> list[str]:
    """The symbol that byte-level vocabularies write for each byte: printable Latin-1 as it is, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + other.index(b)) for b in range(256)]


class Encoder(dict):
    """Numbers of text pieces, and the ids of each number."""

    MOST, PART = 1_000_000, 1_000_000

    UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
    UNLIKE = re.compile(f"[{SPACE}]{{2}}|[\t\x0b-\r\x85\xa0  -     　\0]")
    WORD = re.compile(f"(\n?)( ?)([{LETTER}]+)([.,;:!?]*)")
    CUT = re.compile(f"(?<=[^{SPACE}])[{SPACE}]")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.plain = self.tokenizer.model.tokenize
        self.symbols = byte_symbols()
        self.marks = lru_cache(maxsize=10_000)(lambda marks: self.whole([marks])[0])
        self.line = self.whole(["\n"])[0]
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.new: list[str] = []
        self.ids, self.first, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), 0

    def __missing__(self, unit: str) -> int:
        self[unit] = number = len(self)
        self.new.append(unit)
        return number

    def units(self, text: str) -> list[str]:
        """The text cut before white space that follows something else."""
        if self.UNLIKE.search(text):
            return self.UNIT.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self) -> None:
        """Encodes the pieces that are new. White space, a word and the marks after it are three pre-tokens at most, so the model is asked directly."""
        found, rest = [], []
        for i, unit in enumerate(self.new):
            m = self.WORD.fullmatch(unit)
            if m is None:
                rest.append(i)
                found.append([])
                continue
            line, blank, word, marks = m.groups()
            if not word.isascii():
                word = "".join([self.symbols[b] for b in word.encode()])
            ids = [t.id for t in self.plain(self.symbols[32] + word if blank else word)]
            found.append((self.line if line else []) + ids + (self.marks(marks) if marks else []))
        for i, ids in zip(rest, self.whole([self.new[i] for i in rest]), strict=True):
            found[i] = ids
        ends = self.used + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        from_, to = len(self) - len(found) + 1, len(self) + 1
        self.first = grown(self.first, to)
        self.ids = grown(self.ids, int(ends[-1]))
        self.first[from_:to] = ends
        self.ids[self.used : ends[-1]] = [x for ids in found for x in ids]
        self.used, self.new = int(ends[-1]), []

    def parts(self, text: str) -> Iterator[str]:
        """A long text in parts that can be encoded apart."""
        at = 0
        while len(text) - at > self.PART and (m := self.CUT.search(text, at + self.PART)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def encode(self, parts: list[str]) -> list[np.ndarray]:
        """The ids of each part of a text."""
        if len(self) > self.MOST:
            self.clear()
        units = [self.units(part) for part in parts]
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(units)), np.int64, sum(map(len, units)))
        if self.new:
            self.learn()
        first = self.first[numbers]
        size = self.first[numbers + 1] - first
        ends = np.cumsum(size)
        ids = self.ids[np.arange(ends[-1]) + np.repeat(first - ends + size, size)]
        return np.split(ids, ends[np.cumsum([len(u) for u in units])[:-1] - 1])

    def encode_texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of every text. What is encoded at once is bounded: texts of a batch, or a part of a long one."""
        at = 0
        while at < len(texts):
            if len(texts[at]) > self.PART:
                yield np.concatenate([self.encode([part])[0] for part in self.parts(texts[at])])
                at += 1
                continue
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= self.PART):
                size += len(texts[to])
                to += 1
            yield from self.encode(texts[at:to])
            at = to


def grown(array: np.ndarray, size: int) -> np.ndarray:
    """The array with room for ``size`` entries."""
    return array if size <= len(array) else np.concatenate([array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One table of pieces for all tasks of a worker."""
    return Encoder(path)


Piece = tuple[int | None, int, np.ndarray, int]  # doc_id, start, ids, doc_tokens


def split(piece: Piece, n: int) -> tuple[Piece, Piece]:
    doc, start, ids, total = piece
    return (doc, start, ids[:n], total), (doc, start + n, ids[n:], total)


class Windows:
    """Open windows in order of their room; ``out`` holds the rows of what is finished."""

    def __init__(self, size: int, slack: int, most: int | None, base: int) -> None:
        self.size, self.slack, self.most, self.next = size, slack, most, base
        self.room: list[int] = []
        self.held: list[list[Piece]] = []
        self.out: list[tuple] = []

    def finish(self, pieces: list[Piece]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, at, None, None))
            at += len(ids)
        self.next += 1

    def keep(self, room: int, pieces: list[Piece]) -> None:
        """A window with this room: finished if full, open otherwise."""
        if room == 0:
            return self.finish(pieces)
        at = bisect_left(self.room, room)
        self.room.insert(at, room)
        self.held.insert(at, pieces)

    def put(self, piece: Piece) -> None:
        """The rest of a document."""
        while True:
            need = len(piece[2])
            at = bisect_left(self.room, need)
            if at < len(self.room):
                return self.keep(self.room.pop(at) - need, [*self.held.pop(at), piece])
            if self.most is None or len(self.room) < self.most:
                return self.keep(self.size - need, [piece])
            gap, fullest = self.room.pop(0), self.held.pop(0)
            if gap > self.slack:
                head, piece = split(piece, gap)
                fullest = [*fullest, head]
            self.finish(fullest)

    def document(self, doc: int | None, ids: np.ndarray) -> None:
        piece = (doc, 0, ids, len(ids))
        while len(piece[2]) >= self.size:
            head, piece = split(piece, self.size)
            self.finish([head])
        if len(piece[2]):
            self.put(piece)

    def merge(self, windows: list[list[Piece]]) -> None:
        """Windows of several partitions: best fit of whole ones, then ids from the emptiest to the fullest, until one is left."""
        fill = [sum(len(p[2]) for p in w) for w in windows]
        for i in sorted(range(len(windows)), key=lambda i: -fill[i]):
            at = bisect_left(self.room, fill[i])
            if at < len(self.room):
                self.keep(self.room.pop(at) - fill[i], [*self.held.pop(at), *windows[i]])
            else:
                self.keep(self.size - fill[i], windows[i])
        while len(self.room) > 1:
            gap, fullest = self.room.pop(0), self.held.pop(0)
            if gap <= self.slack:
                self.finish(fullest)
                continue
            room, emptiest = self.room.pop(), self.held.pop()
            while gap and emptiest:
                head, tail = split(emptiest.pop(), gap)
                fullest = [*fullest, head]
                gap, room = gap - len(head[2]), room + len(head[2])
                if len(tail[2]):
                    emptiest.append(tail)
            self.keep(gap, fullest)
            if emptiest:
                self.keep(room, emptiest)

    def end(self) -> None:
        """The windows that are still open, cut into powers of two."""
        for pieces in self.held:
            left, pieces = sum(len(p[2]) for p in pieces), list(pieces)
            while left:
                want = 1 << (left.bit_length() - 1)
                own: list[Piece] = []
                left -= want
                while want:
                    head, tail = split(pieces.pop(0), want)
                    own.append(head)
                    want -= len(head[2])
                    if len(tail[2]):
                        pieces.insert(0, tail)
                self.finish(own)
        self.room, self.held = [], []

    def leave(self) -> None:
        """Rows for the windows that are still open; nearly full ones are finished."""
        for room, pieces in zip(self.room, self.held, strict=True):
            if room <= self.slack:
                self.finish(pieces)
                continue
            for at, (doc, start, ids, total) in enumerate(pieces):
                self.out.append((doc, start, len(ids), None, total, self.next, at, ids.tobytes(), None))
            self.next += 1
        self.room, self.held = [], []


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, part long"
ARROW = pa.schema([(name, pa.binary() if kind == "binary" else pa.int64()) for name, kind in (c.split() for c in SCHEMA.split(", "))])
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def arrow(rows: list[tuple], part: int) -> pa.Table:
    """Rows as Arrow; those that are still open carry ``part``."""
    columns = list(zip(*rows, strict=True)) or [()] * len(ARROW)
    columns[8] = [None if ids is None else part for ids in columns[7]]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


def place_documents(path: str, size: int, open_windows: int, slack: int, end_id: int) -> Callable:
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        code, windows = encoder(path), Windows(size, slack, open_windows, part << 32)
        last = np.array([end_id], np.uint32)
        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), code.encode_texts(texts), strict=True):
                windows.document(doc, np.concatenate([ids, last]))
            yield from arrow(windows.out, part).to_batches()
            windows.out = []
        windows.leave()
        yield from arrow(windows.out, part).to_batches()

    return one


def merge_group(size: int, slack: int, level: int, last: bool) -> Callable:
    def one(key: tuple, rows: pa.Table) -> pa.Table:
        group = key[0].as_py()
        held: dict[int, list[tuple[int, Piece]]] = {}
        for doc, start, total, window, at, ids in zip(*(rows[c].to_pylist() for c in ("doc_id", "start", "doc_tokens", "sequence_id", "offset", "ids")), strict=True):
            held.setdefault(window, []).append((at, (doc, start, np.frombuffer(ids, np.uint32), total)))
        windows = Windows(size, slack, None, (level << 58) | (group << 28))
        windows.merge([[p for _, p in sorted(held[w], key=lambda x: x[0])] for w in sorted(held)])
        windows.end() if last else windows.leave()
        return arrow(windows.out, group)

    return one


def pack_tokens(
    docs: DataFrame, tokenizer: str, *, size: int = 2_048, open_windows: int = 64, slack: int = 8, end_id: int = 1, fan_in: int = 64, text_col: str = "text"
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): the pieces of all documents.

    ``tokenizer`` is the path of a vocabulary file that every worker can open. Up to 2^26 partitions, and 2^28 merged windows a group."""
    small_batches(docs.sparkSession)
    rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col))
    placed = materialise(rows.mapInArrow(place_documents(tokenizer, size, open_windows, slack, end_id), SCHEMA), "windows-placed")
    done, level = placed.where(F.col("ids").isNull()).select(*NAMES), 0
    while (top := placed.agg(F.max("part")).first()[0]) is not None:
        level += 1
        group, last = F.floor(F.col("part") / fan_in).cast("long").alias("group"), top < fan_in
        merged = placed.where(F.col("ids").isNotNull()).groupBy(group).applyInArrow(merge_group(size, slack, level, last), SCHEMA)
        placed = materialise(merged, "windows-merged")
        done = done.unionByName(placed.where(F.col("ids").isNull()).select(*NAMES))
    return done


def op13_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2,048 ids of the byte-level vocabulary."""
    import public_tokenizers

    return pack_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
