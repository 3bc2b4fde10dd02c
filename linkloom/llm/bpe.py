"""Byte-level BPE encoding with recursive DuckDB queries inside Spark partitions, and decoding.

A text is cut into pieces by the tokenizer's pattern. Pieces that a partition
has not met before become rows ``(piece, i, j, l, r)``: the token ``l`` at byte
``i``, the byte ``j`` where its successor ``r`` starts (-1 after the last). A
recursive query joins them with the merge table and contracts, in every piece,
the leftmost pair of the lowest rank, until no pair can be merged. Documents are
then put together from the pieces' ids. Decoding looks the ids of a document up
in the vocabulary, an Arrow column, and joins the bytes in the order of the list.

Defined results: a null text encodes as the empty list, as an empty text does;
an id outside the vocabulary cannot be decoded and raises. Repeated rows, extra
columns and texts of any length are ordinary input. Nothing is shuffled.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count, islice, repeat
from operator import itemgetter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Pieces handed to one recursive query, and from how many bytes on a piece
# takes the query that contracts all equal pairs at once.
PIECES_PER_QUERY = 16_000
LONG_PIECE = 256
# Bounds on what a task holds: remembered pieces, tokens decoded at once.
REMEMBERED_PIECES = 400_000
TOKENS_AT_ONCE = 100_000

# One contraction per piece and round. The smallest key of a piece is its
# leftmost pair of the lowest rank; the three fields have 20 bits or more.
_SHORT = """
WITH RECURSIVE step(n, w, i, j, l, r) AS (
  SELECT 0, w, i, j, l, r FROM start
  UNION ALL
  SELECT s.n + 1, s.w,
    CASE WHEN s.i = b.j THEN b.i ELSE s.i END, s.j,
    CASE WHEN s.i = b.j THEN b.id ELSE s.l END,
    CASE WHEN s.j = b.i THEN b.id ELSE s.r END
  FROM step s JOIN (
    SELECT w, (k >> 40)::INT AS id, ((k >> 20) & 1048575)::INT AS i, (k & 1048575)::INT AS j
    FROM (
      SELECT t.w, min((m.rank::BIGINT << 40) + (t.i::BIGINT << 20) + t.j) AS k
      FROM step t JOIN merges m ON m.l = t.l AND m.r = t.r
      GROUP BY t.w)) b
  ON s.w = b.w AND s.i <> b.i)
SELECT s.w, s.l
FROM step s JOIN (SELECT w, max(n) AS n FROM step GROUP BY w) USING (w, n)
ORDER BY s.w, s.i
"""

# All pairs of the lowest rank in one round, every other one where they overlap.
# That equals one at a time, leftmost first, as long as no token that contains
# the merged one has a lower rank; else only the leftmost is contracted. A call
# runs a bounded number of rounds and says whether it was the last.
_LONG = """
WITH RECURSIVE step(n, w, i, j, l, r) AS (
  SELECT 0, w, i, j, l, r FROM start
  UNION ALL
  (WITH hit AS (
    SELECT w, i, j, rank AS id, single, min(i) OVER (PARTITION BY w) AS leftmost,
      row_number() OVER o AS k, lag(j) OVER o AS before
    FROM (
      SELECT t.w, t.i, t.j, m.rank, m.single, min(m.rank) OVER (PARTITION BY t.w) AS best
      FROM step t JOIN merges m ON m.l = t.l AND m.r = t.r WHERE t.n < 64)
    WHERE rank = best WINDOW o AS (PARTITION BY w ORDER BY i)),
  pick AS (
    SELECT w, i, j, id FROM (
      SELECT *, max(CASE WHEN before IS DISTINCT FROM i THEN k END)
        OVER (PARTITION BY w ORDER BY i) AS first FROM hit)
    WHERE CASE WHEN single THEN i = leftmost ELSE (k - first) % 2 = 0 END)
  SELECT s.n + 1, s.w, coalesce(a.i, s.i), s.j, coalesce(a.id, s.l), coalesce(b.id, s.r)
  FROM step s
  SEMI JOIN pick p ON s.w = p.w
  ANTI JOIN pick d ON s.w = d.w AND s.i = d.i
  LEFT JOIN pick a ON s.w = a.w AND s.i = a.j
  LEFT JOIN pick b ON s.w = b.w AND s.j = b.i))
SELECT s.w, s.n, s.i, s.j, s.l, s.r
FROM step s JOIN (SELECT w, max(n) AS n FROM step GROUP BY w) USING (w, n)
ORDER BY s.w, s.i
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class _Tables:
    """A worker's merge table and vocabulary, and a task's in-process database with them.

    The database lives as long as the task: an idle worker keeps no more than the tables.
    """

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        merges = [
            (self.ranks[t[:k]], self.ranks[t[k:]], rank)
            for t, rank in self.ranks.items()
            for k in range(1, len(t))
            if t[:k] in self.ranks and t[k:] in self.ranks
        ]
        single = {x for left, right, rank in merges for x in (left, right) if rank < x}
        table = np.array(merges, dtype="int32").reshape(-1, 3)
        self.merges = {
            "l": table[:, 0],
            "r": table[:, 1],
            "rank": table[:, 2],
            "single": np.array([rank in single for *_, rank in merges], dtype=bool),
        }
        by_id = sorted(self.ranks.items(), key=itemgetter(1))
        self.vocabulary = pa.array([t for t, _ in by_id], pa.binary())
        # By id the row of the vocabulary, -1 for ids outside it; the last place stands for all larger and smaller ids.
        self.place = np.full(by_id[-1][1] + 2, -1, dtype="int32")
        self.place[[k for _, k in by_id]] = np.arange(len(by_id), dtype="int32")
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype="int32")

    def __enter__(self) -> _Tables:
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        self.put("merges", **self.merges)
        return self

    def __exit__(self, *error) -> None:
        self.con.close()
        pa.default_memory_pool().release_unused()

    def put(self, name: str, **columns: np.ndarray | pa.Array) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece."""
        sizes, ids = self.encode_flat(pieces)
        return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] if pieces else []

    def encode_flat(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each piece, and the ids of all pieces end to end."""
        rank = np.fromiter(map(self.ranks.get, pieces, repeat(-1)), dtype="int32", count=len(pieces))
        at, ids = [np.flatnonzero(rank >= 0)], [rank[rank >= 0]]
        left = np.flatnonzero(rank < 0).tolist()
        short = [k for k in left if len(pieces[k]) < LONG_PIECE]
        for begin in range(0, len(short), PIECES_PER_QUERY):
            some = np.array(short[begin : begin + PIECES_PER_QUERY])
            self._start([pieces[k] for k in some.tolist()])
            rows = self.con.execute(_SHORT).fetchnumpy()
            at.append(some[rows["w"]])
            ids.append(rows["l"])
        for k in left:
            if len(pieces[k]) >= LONG_PIECE:
                ids.append(np.array(self._encode_long(pieces[k]), dtype="int32"))
                at.append(np.full(len(ids[-1]), k))
        piece = np.concatenate(at)
        return np.bincount(piece, minlength=len(pieces)), np.concatenate(ids)[np.argsort(piece, kind="stable")]

    def _start(self, pieces: list[bytes]) -> None:
        lengths = np.fromiter(map(len, pieces), dtype="int64", count=len(pieces))
        ends = np.cumsum(lengths)
        ids = self.of_byte[np.frombuffer(b"".join(pieces), dtype="uint8")]
        at = (np.arange(len(ids)) - np.repeat(ends - lengths, lengths)).astype("int32")
        after = np.append(ids[1:], np.int32(-1))
        after[ends - 1] = -1
        number = np.repeat(np.arange(len(pieces), dtype="int32"), lengths)
        self.put("start", w=number, i=at, j=at + np.int32(1), l=ids, r=after)

    def _encode_long(self, piece: bytes) -> list[int]:
        self._start([piece])
        while True:
            rows = np.array(self.con.execute(_LONG).fetchall(), dtype="int64")
            if rows[0, 1] < 64:
                return rows[:, 4].tolist()
            w, i, j, left, right = (rows[:, k].astype("int32") for k in (0, 2, 3, 4, 5))
            self.put("start", w=w, i=i, j=j, l=left, r=right)

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """The bytes of each list of ids; ``offsets`` delimit the lists."""
        at = self.place[np.clip(ids, -1, len(self.place) - 1)]
        if len(at) and at.min() < 0:
            raise ValueError(f"ids outside the vocabulary: {np.unique(ids[at < 0])[:5].tolist()}")
        count = len(offsets) - 1
        out = [b""] * count
        first = 0
        while first < count:
            # A single document may hold more tokens than are taken at once:
            # its parts are decoded one after the other.
            last = int(np.searchsorted(offsets, offsets[first] + TOKENS_AT_ONCE, "right")) - 1
            last = min(max(last, first + 1), count)
            begin, end = int(offsets[first]), int(offsets[last])
            for part in range(begin, end, TOKENS_AT_ONCE):
                stop = min(end, part + TOKENS_AT_ONCE)
                cuts = pa.array(np.clip(offsets[first : last + 1], part, stop) - part, pa.int32())
                lists = pa.ListArray.from_arrays(cuts, self.vocabulary.take(pa.array(at[part:stop])))
                for d, data in enumerate(pc.binary_join(lists, b"").to_pylist(), first):
                    out[d] += data
            first = last
        return out


@lru_cache(maxsize=2)
def _tables(path: str) -> _Tables:
    return _Tables(path)


class _Memory:
    """Ids of the pieces a task has met, stored end to end."""

    def __init__(self, tables: _Tables):
        self.tables = tables
        self.clear()

    def clear(self) -> None:
        # A new piece gets the next number when it is looked up.
        self.number: defaultdict[str, int] = defaultdict(count().__next__)
        self.ids = np.empty(0, dtype="int32")
        self.begin = np.empty(0, dtype="int64")
        self.count = np.empty(0, dtype="int64")

    def learn(self, pieces: list[str]) -> None:
        """Keep the ids of the pieces numbered last, in the order of their numbers."""
        sizes, ids = self.tables.encode_flat([p.encode() for p in pieces])
        self.begin = np.append(self.begin, len(self.ids) + np.cumsum(sizes) - sizes)
        self.ids = np.append(self.ids, ids)
        self.count = np.append(self.count, sizes)


def _encoded(batch: pa.RecordBatch, memory: _Memory, pieces_of, text: str) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """Rows of the batch, and offsets and values of their lists of ids."""
    texts = batch.column(text)
    for rows in _slices(texts):
        if len(memory.number) > REMEMBERED_PIECES:
            memory.clear()
        number = memory.number
        found = [pieces_of(t) if t else [] for t in texts.slice(rows.start, len(rows)).to_pylist()]
        sizes = np.fromiter(map(len, found), dtype="int64", count=len(found))
        use = np.fromiter(map(number.__getitem__, chain.from_iterable(found)), dtype="int32", count=int(sizes.sum()))
        if new := len(number) - len(memory.count):
            memory.learn(list(islice(reversed(number), new))[::-1])
        held = memory.count[use]
        ends = np.cumsum(held)
        total = int(ends[-1]) if len(ends) else 0
        ids = memory.ids[np.repeat(memory.begin[use] - (ends - held), held) + np.arange(total)]
        yield rows, np.append(0, ends)[np.append(0, np.cumsum(sizes))].astype("int32"), ids


def _slices(texts: pa.Array, size: int = 1_000_000) -> Iterator[range]:
    """Ranges of rows of about ``size`` bytes, whole rows each."""
    first, held = 0, 0
    for row, length in enumerate(pc.binary_length(texts).to_pylist()):
        held += length or 0
        if held >= size:
            yield range(first, row + 1)
            first, held = row + 1, 0
    if first < len(texts):
        yield range(first, len(texts))


def encode(
    docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", decoded: bool = False
) -> DataFrame:
    """``key`` and ``ids``, the token ids of the whole text, for every row.

    With ``decoded`` the ids are decoded again in the same pass over the data, as
    ``decode`` would, into a column of that name.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces_of = regex.compile(pattern).findall
        with _tables(path) as tables:
            memory = _Memory(tables)
            for batch in batches:
                for rows, offsets, ids in _encoded(batch, memory, pieces_of, text):
                    out = [batch.column(key).slice(rows.start, len(rows)), pa.ListArray.from_arrays(offsets, ids)]
                    if decoded:
                        out.append(pa.array(tables.decode(offsets, ids), pa.binary()))
                    yield pa.RecordBatch.from_arrays(out, names=schema.names)

    docs = docs.select(docs[key], docs[text])
    schema = T.StructType([docs.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])
    if decoded:
        schema = schema.add("decoded", T.BinaryType(), False)
    return docs.mapInArrow(work, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns and ``decoded``, the bytes that the ids stand for (null: none)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _tables(path) as tables:
            for batch in batches:
                lists = batch.column(ids)
                lists = lists.fill_null([]) if lists.null_count else lists
                offsets = lists.offsets.to_numpy()
                values = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
                found = tables.decode(offsets - offsets[0], values)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "decoded"]
                )

    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType(), False)])
    return encoded.mapInArrow(work, schema)
