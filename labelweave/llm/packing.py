"""Bounded-space online packing (operator 2).

Each partition reads its documents as a stream and keeps at most
``open_windows`` unfinished sequences. A document's full-length pieces become
sequences of their own; the rest goes whole into the open window with the least
room that still fits. When none fits and no more windows may be opened, the
fullest is emitted; if it would be padded by more than ``max_gap`` tokens, the
head of the document fills it first. At the end the unfinished windows of
``MERGE`` neighbouring partitions (a bounded number of tokens) are merged: their
pieces are laid end to end and cut at the sequence length, so each such group
leaves at most one padded sequence.

A piece is a row: document id, ``start`` in the document's ids, ``length``,
``ids`` (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id`` and
``offset`` there. The pieces are written once to the shared folder, compressed;
tokenising happens once. A partition's result depends on its rows and its
number only, so a task that is run again gives the same pieces.

Tokenising a text equals tokenising its blank-separated chunks one by one (this
tokenizer's rules never join across white space), so each distinct chunk of a
slice of texts is tokenised once and the ids are gathered in numpy.

Defined cases: a null or empty text is the end id alone; repeated rows are
packed as often as they occur; a document longer than the sequence is cut, a
text of any length is taken whole; a null id is kept; of windows that fit a
document equally well the older one takes it; an empty table gives an empty
result. Extra columns are ignored, whatever their names; an id column named like
a result column is an error.
"""

from __future__ import annotations

import itertools
import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from labelweave.llm import textkit as T
from labelweave.llm.common import cut, table
from labelweave.llm.registry import query

SEQUENCE = 2048
END_ID = 1
OPEN_WINDOWS = 64
MAX_GAP = 16
MERGE = 16
SLICE_BYTES = 32 << 20      # text of one dictionary
CHUNKS_AT_ONCE = 300_000    # chunks gathered at a time
TEXTS_AT_ONCE = 200
WORDS_AT_ONCE = 500
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def gather(ids: np.ndarray, size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the entries ``code`` one after the other, and where each ends; entry i has ``size[i]`` of ``ids``."""
    each = size[code]
    ends = np.cumsum(each)
    at = np.repeat((np.cumsum(size) - size)[code] - ends + each, each)
    at += np.arange(len(at))
    return ids[at], ends


class TextIds:
    """Ids of whole texts, a slice of a batch at a time; nothing is kept between slices.

    The blank-separated chunks of a slice are dictionary-encoded, each distinct
    chunk is tokenised once, and the ids are gathered with the chunks' offsets. A chunk that is
    letters and then punctuation is tokenised as these two; distinct runs of letters go to the tokenizer as lines of
    many words, and the vocabulary's word-end marks tell where each word's ids end.
    All this needs a tokenizer that drops white space and marks word ends; for another one whole texts are tokenised."""

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        mark = getattr(self.tok.model, "end_of_word_suffix", None)
        self.word_end = None
        if mark:
            vocab = self.tok.get_vocab()
            self.word_end = np.zeros(max(vocab.values()) + 1, bool)
            self.word_end[[i for t, i in vocab.items() if t.endswith(mark)]] = True

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        found = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), "<u4", int(size.sum())), size

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for runs of letters, many to a line."""
        starts = [*range(0, len(words), WORDS_AT_ONCE), len(words)]
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), words), " ").to_pylist()
        ids, _ = self._encode(lines)
        ends = np.flatnonzero(self.word_end[ids]) + 1
        if len(ends) != len(words):      # a word of several pieces or of none
            return self._encode(words.to_pylist())
        return ids, np.diff(ends, prepend=0)

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for distinct blank-separated chunks."""
        stems = pc.utf8_rtrim(chunks, PUNCTUATION)
        plain = pc.utf8_is_alpha(stems)
        stems = pc.if_else(plain, stems, chunks)
        tails = pa.array([c[len(s):] for c, s in zip(chunks.to_pylist(), stems.to_pylist(), strict=True)], pa.string()).dictionary_encode()
        stems = pc.if_else(plain, pc.ascii_lower(stems), stems).dictionary_encode()
        letters = pc.utf8_is_alpha(stems.dictionary)
        a_ids, a_size = self._words(stems.dictionary.filter(letters))
        b_ids, b_size = self._encode(stems.dictionary.filter(pc.invert(letters)).to_pylist())
        t_ids, t_size = self._encode(tails.dictionary.to_pylist())
        # one table of entries: letters, other stems, tails
        is_word = letters.to_numpy(zero_copy_only=False)
        place = np.where(is_word, np.cumsum(is_word) - 1, len(a_size) + np.cumsum(~is_word) - 1)
        code = np.empty(2 * len(chunks), np.int64)
        code[0::2] = place[stems.indices.to_numpy()]
        code[1::2] = len(a_size) + len(b_size) + tails.indices.to_numpy()
        ids, ends = gather(np.concatenate([a_ids, b_ids, t_ids]), np.concatenate([a_size, b_size, t_size]), code)
        return ids, np.diff(ends[1::2], prepend=0)

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first text, ids of some texts one after the other, each with the end id; where each starts, one more at the end)."""
        texts = texts.fill_null("")
        if self.word_end is None:
            for at in range(0, len(texts), TEXTS_AT_ONCE):
                ids, size = self._encode(texts.slice(at, TEXTS_AT_ONCE).to_pylist())
                yield at, *self._with_end(ids, np.cumsum(size))
            return
        chunks = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        off = chunks.offsets.to_numpy() - chunks.offsets[0].as_py()
        coded = chunks.flatten().dictionary_encode()
        del chunks
        ids, size = self._chunks(coded.dictionary)
        code = coded.indices.to_numpy()
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(off, off[at] + CHUNKS_AT_ONCE, "right")) - 1)
            got, ends = gather(ids, size, code[off[at]: off[to]])
            yield at, *self._with_end(got, np.concatenate([[0], ends])[off[at + 1: to + 1] - off[at]])
            at = to

    @staticmethod
    def _with_end(ids: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (np.insert(ids, stops, np.uint32(END_ID)),
                np.concatenate([[0], stops + np.arange(1, len(stops) + 1)]))


class Windows:
    """The open windows of one partition."""

    def __init__(self, size: int, most: int, max_gap: int) -> None:
        self.size, self.most, self.max_gap = size, most, max_gap
        self.room: list[tuple[int, int]] = []       # (free tokens, window), sorted
        self.held: dict[int, list[tuple]] = {}
        self.next = 0

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def put(self, doc, n: int) -> Iterator[tuple]:
        """Place ``n`` tokens of a document; yields finished (doc, start, length, window, offset)."""
        at = 0
        while n - at >= self.size:
            yield doc, at, self.size, self._new(), 0
            at += self.size
        while at < n:
            rest = n - at
            k = bisect_left(self.room, (rest, -1))
            if k < len(self.room):
                free, w = self.room.pop(k)
                self.held[w].append((doc, at, rest, w, self.size - free))
                at = n
                if free > rest:
                    insort(self.room, (free - rest, w))
                else:
                    yield from self.held.pop(w)
            elif len(self.room) < self.most:
                w = self._new()
                self.held[w] = []
                insort(self.room, (self.size, w))
            else:
                free, w = self.room.pop(0)
                if free > self.max_gap:
                    self.held[w].append((doc, at, free, w, self.size - free))
                    at += free
                yield from self.held.pop(w)


_PIECE = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _pack_partition(spec, id_col: str, text_col: str, size: int, most: int, max_gap: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        text_ids = TextIds(spec.value)
        windows = Windows(size, most, max_gap)
        rows: list[tuple] = []

        def batch(left: bool) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            rows.clear()
            n = len(cols[0])
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(cols, schema, strict=False)]
                + [pa.array([left] * n, pa.bool_()), pa.array([part // MERGE] * n, pa.int32())], schema=schema)

        def out(piece) -> None:
            (doc_id, ids, total), at, n, w, offset = piece
            rows.append((doc_id, at, n, ids[at: at + n].tobytes(), total, (part << 40) + w, offset))

        for whole in batches:
            for b in T.slices(whole, text_col, SLICE_BYTES):
                doc_ids = b.column(id_col).to_pylist()
                for first, ids, off in text_ids(b.column(text_col)):
                    for k, (at, to) in enumerate(itertools.pairwise(off.tolist()), first):
                        # a copy: an open window must not hold the ids of the whole slice
                        for piece in windows.put((doc_ids[k], ids[at:to].copy(), to - at), to - at):
                            out(piece)
                    if rows:
                        yield batch(False)
        yield batch(False)
        for w in sorted(windows.held):
            for piece in windows.held[w]:
                out(piece)
        yield batch(True)
        pa.default_memory_pool().release_unused()       # the worker serves other tasks next

    return run


def _merge(size: int, id_col: str, schema: pa.Schema):
    """Lay the unfinished pieces of one group end to end and cut at the sequence length."""
    def run(key, rows):
        rows = rows.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        cols = [rows.column(c).to_pylist() for c in (id_col, "start", "length", "ids", "doc_tokens")]
        out, filled = [], 0
        first = (1 << 62) + (key[0].as_py() << 40)
        for doc_id, start, length, ids, total in zip(*cols, strict=True):
            at = 0
            while at < length:
                n = min(length - at, size - filled % size)
                out.append((doc_id, start + at, n, ids[4 * at: 4 * (at + n)], total, first + filled // size, filled % size))
                at += n
                filled += n
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text",
         size: int = SEQUENCE, open_windows: int = OPEN_WINDOWS, max_gap: int = MAX_GAP) -> DataFrame:
    """Pieces of the packed sequences. ``tokenizer``: path of a tokenizer file of the ``tokenizers`` library."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    with open(tokenizer, encoding="utf-8") as f:     # a file of the driver, of fixed size
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    if id_col.lower() in StructType.fromDDL(_PIECE).names + ["unfinished", "part"]:
        raise ValueError(f"the id column has the name of a result column: {id_col}")
    docs = docs.select(id_col, text_col)
    piece = StructType([StructField(id_col, docs.schema[id_col].dataType)] + StructType.fromDDL(_PIECE).fields)
    full = StructType(piece.fields + StructType.fromDDL("unfinished boolean, part int").fields)
    from pyspark.sql.pandas.types import to_arrow_schema

    placed = cut(docs.mapInArrow(_pack_partition(spec, id_col, text_col, size, open_windows, max_gap,
                                                 to_arrow_schema(full)), full), "pieces", compression="zstd")
    done = placed.filter("NOT unfinished").drop("unfinished", "part")
    merged = placed.filter("unfinished").drop("unfinished").groupBy("part").applyInArrow(
        _merge(size, id_col, to_arrow_schema(piece)), piece)
    return done.unionByName(merged)


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of the packed documents."""
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
