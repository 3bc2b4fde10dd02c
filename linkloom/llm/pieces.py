"""SentencePiece encoding and decoding with merge-type vocabularies.

A text gets a blank in front and is cut before every run of blanks. No piece of
the vocabulary holds a blank behind another character (checked when the model is
read), so no merge crosses such a cut, and each word is encoded by itself, once per task as
long as it is remembered.

A word starts as its characters. The agenda holds every pair of adjacent symbols whose
concatenation is a piece, ordered by the piece's score, the leftmost first among equals. The
top pair is merged, the pairs it was part of leave the agenda, and the new symbol's
pairs with its neighbours enter it, until the agenda is empty. The agendas of many words of up to ``WIDE``
characters are kept side by side as rows of a table, where one step merges the
top pair of every row; a longer word has a heap of its own, so its time grows with n log n. A character that
is no piece becomes the pieces of its UTF-8 bytes, or the unknown id in a vocabulary without them.

The words learned from an Arrow batch are encoded by the sentencepiece library too, and a
difference raises. Decoding is the library's.

Defined results: a null text encodes as the empty list, as an empty text does; ids outside the vocabulary
cannot be decoded and raise, a null list of ids decodes as none. Repeated rows, extra columns and texts of any length are ordinary
input. Models that are not merge-type or that normalise texts raise. Nothing is shuffled.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2

from linkloom.llm.bpe import _slices

# Characters of a word whose agenda is a row of a table, in tables of these widths.
WIDTHS = (6, 10, 16, 32)
WIDE = WIDTHS[-1]
# Rows of a table, and characters of words that a task remembers.
ROWS = 50_000
REMEMBERED = 6_000_000

BLANK = "▁"
_WORD = re.compile(" *[^ ]+| +$")


class Vocabulary:
    """The pieces of a model, and what two adjacent symbols merge into.

    Symbols are numbered like the pieces; characters that only occur inside pieces come
    after them, and -1 is any other character.
    """

    def __init__(self, path: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        _check(model)
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        normal = {p.piece: k for k, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.unknown = next(k for k, p in enumerate(model.pieces) if p.type == kind.UNKNOWN)
        self.of_byte = {int(p.piece[3:-1], 16): k for k, p in enumerate(model.pieces) if p.type == kind.BYTE}
        if any(BLANK in p.lstrip(BLANK) for p in normal):
            raise ValueError("a piece holds a blank behind another character")
        symbols = dict(normal)
        for c in sorted({c for p in normal for c in p}):
            symbols.setdefault(c, len(model.pieces) + len(symbols))
        self.count = len(model.pieces)
        self.character = np.full(0x110000, -1, dtype="int32")
        for s, k in symbols.items():
            if len(s) == 1:
                self.character[ord(s)] = k
        # Ranks by falling score: equal scores share a rank.
        scores = sorted({-model.pieces[k].score for k in normal.values()})
        rank_of = {s: r for r, s in enumerate(scores)}
        merges = {
            (symbols[p[:at]], symbols[p[at:]]): (rank_of[-model.pieces[k].score], k)
            for p, k in normal.items()
            for at in range(1, len(p))
            if p[:at] in symbols and p[at:] in symbols
        }
        self.merges = merges
        self.none = len(scores)
        self.width = self.count + len(symbols) + 1
        pairs = np.array([left * self.width + right for left, right in merges], dtype="int64")
        found = np.array(list(merges.values()), dtype="int64").reshape(-1, 2)
        order = np.argsort(pairs)
        self.pairs = np.append(pairs[order], np.iinfo("int64").max)
        self.ranks = np.append(found[order, 0], self.none).astype("int32")
        self.merged = np.append(found[order, 1], -1).astype("int32")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of every word, and the ids of all words end to end.

        A word's leading blanks are plain spaces.
        """
        lengths = np.fromiter(map(len, words), dtype="int64", count=len(words))
        points = np.frombuffer("".join(words).replace(" ", BLANK).encode("utf-32-le", "surrogatepass"), dtype="uint32")
        symbols = self.character[points]
        begins = np.cumsum(lengths) - lengths
        # Where no pair of a word merges, its symbols are its characters.
        final = symbols.copy()
        kept = np.ones(len(points), dtype=bool)
        lowest = 0
        for width in WIDTHS:
            rows = np.flatnonzero((lengths > lowest) & (lengths <= width))
            for at in range(0, len(rows), ROWS):
                some = rows[at : at + ROWS]
                self._agendas(begins[some], lengths[some], width, final, kept)
            lowest = width
        for k in np.flatnonzero(lengths > WIDE).tolist():
            span = slice(int(begins[k]), int(begins[k] + lengths[k]))
            final[span], kept[span] = self._agenda(symbols[span].tolist())
        # A symbol that is no piece stands for a single character.
        spelled = kept & ((final < 0) | (final >= self.count))
        spellings = [self._spelled(chr(c)) for c in points[spelled].tolist()]
        times = kept.astype("int64")
        times[spelled] = np.fromiter(map(len, spellings), dtype="int64", count=len(spellings))
        ids = np.repeat(final, times)
        ids[np.repeat(spelled, times)] = np.fromiter(chain.from_iterable(spellings), dtype="int32")
        count = np.bincount(np.repeat(np.arange(len(words)), lengths), times, minlength=len(words))
        return count.astype("int64"), ids

    def _spelled(self, character: str) -> list[int]:
        if not self.of_byte:
            return [self.unknown]
        return [self.of_byte[b] for b in character.encode("utf-8", "surrogatepass")]

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of the merge of each pair; the rank ``none`` where there is no such piece."""
        wanted = left.astype("int64") * self.width + right
        wanted[(left < 0) | (right < 0)] = -1
        at = np.searchsorted(self.pairs, wanted)
        hit = self.pairs[at] == wanted
        return np.where(hit, self.ranks[at], self.none).astype("int32"), self.merged[at]

    def _agendas(self, begins: np.ndarray, lengths: np.ndarray, width: int, final: np.ndarray, kept: np.ndarray) -> None:
        """Merge the words of one table; ``final`` and ``kept`` get the symbol at each character where one starts."""
        columns = np.arange(width)
        inside = columns < lengths[:, None]
        place = np.where(inside, begins[:, None] + columns, 0)
        symbol = np.where(inside, final[place], -1)
        # The columns of the symbols before and after each one; -1 and the width stand for none.
        after = np.where(columns + 1 < lengths[:, None], columns + 1, width)
        before = np.tile(columns - 1, (len(begins), 1))
        rank = np.full((len(begins), width), self.none, dtype="int32")
        piece = np.full((len(begins), width), -1, dtype="int32")
        rank[:, :-1], piece[:, :-1] = (x.reshape(len(begins), -1) for x in self._look_up(symbol[:, :-1].ravel(), symbol[:, 1:].ravel()))
        alive = inside.copy()
        rows = np.arange(len(begins))
        while True:
            top = rank[rows].argmin(axis=1)
            busy = rank[rows, top] < self.none
            rows, top = rows[busy], top[busy]
            if not len(rows):
                break
            gone = after[rows, top]
            symbol[rows, top] = piece[rows, top]
            alive[rows, gone] = False
            rank[rows, gone] = self.none
            onward = after[rows, gone]
            after[rows, top] = onward
            has = onward < width
            before[rows[has], onward[has]] = top[has]
            rank[rows[~has], top[~has]] = self.none
            self._enter(rows[has], top[has], onward[has], symbol, rank, piece)
            back = before[rows, top]
            has = back >= 0
            self._enter(rows[has], back[has], top[has], symbol, rank, piece)
        final[place[inside]] = symbol[inside]
        kept[place[inside]] = alive[inside]

    def _enter(self, rows, left, right, symbol, rank, piece) -> None:
        rank[rows, left], piece[rows, left] = self._look_up(symbol[rows, left], symbol[rows, right])

    def _agenda(self, symbols: list[int]) -> tuple[list[int], list[bool]]:
        """The same for one long word, with a heap."""
        last = len(symbols) - 1
        before, after = list(range(-1, last)), [*range(1, last + 1), -1]
        alive = [True] * len(symbols)
        merges, heap = self.merges, []

        def enter(left: int, right: int) -> None:
            found = merges.get((symbols[left], symbols[right]))
            if found:
                heapq.heappush(heap, (found[0], left, right, symbols[left], symbols[right], found[1]))

        for k in range(last):
            enter(k, k + 1)
        while heap:
            _, left, right, was_left, was_right, piece = heapq.heappop(heap)
            # Pairs that an earlier merge took a symbol from have left the agenda.
            if not (alive[left] and alive[right]) or after[left] != right:
                continue
            if symbols[left] != was_left or symbols[right] != was_right:
                continue
            symbols[left], alive[right] = piece, False
            onward = after[right]
            after[left] = onward
            if onward >= 0:
                before[onward] = left
                enter(left, onward)
            if before[left] >= 0:
                enter(before[left], left)
        return symbols, alive

    def check(self, words: list[str], count: np.ndarray, ids: np.ndarray) -> None:
        """Raise if the library encodes one of the words otherwise. It adds the first blank itself."""
        found = self.library.encode([w[1:] for w in words], num_threads=1)
        if " " in words:
            # For the library a single blank is the empty text, which has no ids.
            found[words.index(" ")] = [int(self.character[ord(BLANK)])]
        expected = np.fromiter(map(len, found), dtype="int64", count=len(found))
        flat = np.fromiter(chain.from_iterable(found), dtype="int64", count=int(expected.sum()))
        if np.array_equal(expected, count) and np.array_equal(flat, ids):
            return
        at = np.append(0, np.cumsum(count)).tolist()
        bad = next(w for k, w in enumerate(words) if found[k] != ids[at[k] : at[k + 1]].tolist())
        raise ValueError(f"the sentencepiece library encodes {bad[:100]!r} otherwise")

    def decode(self, lists: list[list[int]]) -> list[str]:
        return self.library.decode(lists, num_threads=1) if lists else []


def _check(model) -> None:
    norm, trainer = model.normalizer_spec, model.trainer_spec
    merge_type = trainer.model_type == sentencepiece_model_pb2.TrainerSpec.BPE
    plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces
    blanks = norm.add_dummy_prefix and norm.escape_whitespaces and not trainer.treat_whitespace_as_suffix
    kind = sentencepiece_model_pb2.ModelProto.SentencePiece
    special = any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces)
    if not (merge_type and plain and blanks) or special:
        raise ValueError("not a merge-type model over texts as they are")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class _Memory:
    """Ids of the words a task has met, stored end to end."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.characters = 0
        self.ids = np.empty(0, dtype="int32")
        self.begin = np.empty(0, dtype="int64")
        self.count = np.empty(0, dtype="int64")

    def learn(self, words: list[str]) -> None:
        count, ids = self.vocabulary.encode(words)
        self.vocabulary.check(words, count, ids)
        self.begin = np.append(self.begin, len(self.ids) + np.cumsum(count) - count)
        self.ids = np.append(self.ids, ids.astype("int32"))
        self.count = np.append(self.count, count)
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        self.characters += sum(map(len, words))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and values of the lists of ids of the texts."""
        if self.characters > REMEMBERED:
            self.clear()
        found = [_WORD.findall(" " + t.replace(BLANK, " ")) if t else [] for t in texts]
        new = set(chain.from_iterable(found)).difference(self.number)
        if new:
            self.learn(list(new))
        sizes = np.fromiter(map(len, found), dtype="int64", count=len(found))
        use = np.fromiter(map(self.number.__getitem__, chain.from_iterable(found)), dtype="int64", count=int(sizes.sum()))
        count = self.count[use]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.begin[use] - (ends - count), count) + np.arange(total)]
        return np.append(0, ends)[np.append(0, np.cumsum(sizes))].astype("int32"), ids


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """``key`` and ``ids``, the token ids of the whole text, for every row.

    With ``decoded`` the ids are decoded again in the same pass over the data, as
    ``decode`` would, into a column of that name.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Memory(vocabulary(path))
        for batch in batches:
            texts = batch.column(text)
            for rows in _slices(texts):
                offsets, ids = memory.encode(texts.slice(rows.start, len(rows)).to_pylist())
                out = [batch.column(key).slice(rows.start, len(rows)), pa.ListArray.from_arrays(offsets, ids)]
                if decoded:
                    out.append(pa.array(memory.vocabulary.decode(out[1].to_pylist()), pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    docs = docs.select(docs[key], docs[text])
    schema = T.StructType([docs.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])
    if decoded:
        schema = schema.add("decoded", T.StringType(), False)
    return docs.mapInArrow(work, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns and ``decoded``, the text that the ids stand for (null: the empty text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = vocabulary(path).decode
        for batch in batches:
            found = library([x or [] for x in batch.column(ids).to_pylist()])
            columns = [*batch.columns, pa.array(found, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "decoded"])

    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType(), False)])
    return encoded.mapInArrow(work, schema)
