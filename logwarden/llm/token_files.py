"""Token files of independent Zstandard frames with a trailing seek table.

Layout of a file: data frames, one skippable frame with the documents of each data
frame, and a skippable frame that is the seek table of the public seekable format
(sizes of each frame and the low 32 bits of the XXH64 of its content). A reader
takes the tail of the file, finds the frames that hold the wanted documents, and
decompresses only those, checking each.

Documents are dealt out by ranges of ``doc_id`` and sorted, so files and the frames
in them ascend. The table of files (one row per file) carries the totals from which
a window over files derives each file's first token number.

Defined results: a null or empty text holds the end token only; rows without id
come first, repeated ids stand next to each other in either order; an empty table gives no
documents; other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logwarden.llm.bpe import byte_letters
from logwarden.llm.common import scratch, settle, text_groups, worker_tool
from logwarden.llm.shared_files import attempt_name, create, open_file

FRAME_BYTES = 1 << 20  # token bytes per frame; a longer document has a frame of its own
CACHE = 200_000  # words, and pieces of words, a worker remembers
# fixed values: magic numbers of the public frame formats
SEEK_SKIPPABLE, SEEK_FOOTER, OWN_SKIPPABLE = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
_CHECKSUMS = 0x80
_ODD = "\x1c\x1d\x1e\x1f"  # str.split() takes these for white space, the tokenizer does not


# letters and numbers of the first 256 characters after lower-casing, in the splitting pattern of the vocabulary
_LETTER, _NUMBER = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER} ]+| ")
_PLAIN = re.compile(r"[\x00-\xff]*\Z")


def regroup(values: pa.LargeBinaryArray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """Neighbouring values put together: entry i reaches from the end before to ``ends[i]``."""
    if not len(values):
        return pa.array([b""] * len(ends), pa.large_binary())
    starts = np.frombuffer(values.buffers()[1], np.int64)
    cuts = starts[values.offset + np.concatenate(([0], ends)).astype(np.int64)]
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(cuts), values.buffers()[2]])


class IdTable:
    """Ids of strings, computed once per distinct string and dealt out by Arrow.

    As in ``WordTable`` strings that came more than once in a lookup are kept until the
    table is full; ``learn`` gives the ids of all others in the order it got them.
    """

    def __init__(self, learn: Callable[[list[str]], pa.LargeBinaryArray], limit: int) -> None:
        self.learn, self.limit = learn, limit
        self.kept: dict[str, bytes] = {}

    def lookup(self, groups: Iterable[list[str]]) -> pa.LargeBinaryArray:
        """Ids of every string of ``groups``, one after the other."""
        strings = list(chain.from_iterable(groups))
        at = pa.array(strings, pa.string()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        # distinct strings are numbered as they come, so each first stands where the highest number grows
        first = np.flatnonzero(np.diff(np.maximum.accumulate(at), prepend=-1))
        names = list(map(strings.__getitem__, first.tolist()))
        found = list(map(self.kept.get, names))
        fresh = np.array([x is None for x in found], bool)
        new = [n for n, x in zip(names, found) if x is None]
        learned = self.learn(new)
        room = self.limit - len(self.kept)
        if room > 0:
            often = np.flatnonzero(np.bincount(at, minlength=len(names))[fresh] > 1)[:room]
            self.kept.update(zip(map(new.__getitem__, often.tolist()), learned.take(pa.array(often)).to_pylist()))
        # known ids first, then those learned
        place = np.where(fresh, np.cumsum(fresh) - 1 + len(found) - len(new), np.cumsum(~fresh) - 1)
        every = pa.concat_arrays([pa.array([x for x in found if x is not None], pa.large_binary()), learned])
        return every.take(pa.array(place[at]))


class WordEncoder:
    """Encodes with the tokenizers library, each distinct piece once.

    The tokenizer drops white space and never looks across it, so the ids of a text
    are those of its words in a row, and those of a word the ids of the pieces it is
    split into. Words of the first 256 characters are split here, where neither
    normal forms nor lower-casing depend on neighbours; any other word goes to the
    library whole. New pieces go to the merges of the library.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.letters = {b: c for c, b in byte_letters().items()} | {ord(" "): " "}
        self.words = IdTable(self._join, CACHE)
        self.pieces = IdTable(self._ask, CACHE)

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ask(self, pieces: list[str]) -> pa.LargeBinaryArray:
        # a piece is in normal form, in lower case and cut already: what is left of the library's way is its model;
        # no piece holds a blank, so all are spelled in letters of bytes at once
        spelled = " ".join(pieces).encode().decode("latin-1").translate(self.letters)
        merge = self.library.model.tokenize
        ids = [[t.id for t in merge(p)] for p in spelled.split(" ")] if pieces else []
        ends = np.cumsum([0, *map(len, ids)], dtype=np.int64) * 4
        data = np.fromiter(chain.from_iterable(ids), "<u4", int(ends[-1]) // 4)
        return pa.Array.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(ends), pa.py_buffer(data)])

    def _join(self, words: list[str]) -> pa.LargeBinaryArray:
        every = " ".join(words)
        if _PLAIN.match(every) and "<|" not in every:
            split, plain = np.ones(len(words), bool), words
        else:
            split = np.array([bool((w.isascii() or _PLAIN.match(w)) and "<|" not in w) for w in words], bool)
            plain = [w for w, own in zip(words, split) if own]
        # no piece goes across a blank, so all words are split at once
        cut = _PIECES.findall(" ".join(plain).lower())
        blank = np.array([p == " " for p in cut], bool)
        ids = self.pieces.lookup([[p for p in cut if p != " "]])
        ends = np.append(np.cumsum(~blank)[blank], len(ids))[: len(plain)]
        rest = pa.array([self._whole(w) for w, own in zip(words, split) if not own], pa.large_binary())
        place = np.where(split, np.cumsum(split) - 1, np.cumsum(~split) - 1 + len(plain))
        return pa.concat_arrays([regroup(ids, ends), rest]).take(pa.array(place))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        whole = [not t or any(c in t for c in _ODD) for t in texts]
        split = [[] if odd else t.split() for t, odd in zip(texts, whole)]
        joined = regroup(self.words.lookup(split), np.cumsum(list(map(len, split)), dtype=np.int64))
        return [self._whole(t or "") if odd else ids for t, odd, ids in zip(texts, whole, joined.to_pylist())]


@worker_tool
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pack(docs: list[tuple[int | None, bytes]]) -> bytes:
    """Content of one frame: count, ids with a mark for null, token counts, tokens."""
    ids = np.array([0 if d is None else d for d, _ in docs], "<i8").tobytes()
    marks = bytes(d is not None for d, _ in docs)
    counts = np.array([len(t) // 4 for _, t in docs], "<u4").tobytes()
    return b"".join([struct.pack("<I", len(docs)), ids, marks, counts, *(t for _, t in docs)])


def unpack(content: bytes) -> list[tuple[int | None, bytes]]:
    (n,) = struct.unpack_from("<I", content)
    ids = np.frombuffer(content, "<i8", n, 4).tolist()
    marks = content[4 + 8 * n : 4 + 9 * n]
    counts = np.frombuffer(content, "<u4", n, 4 + 9 * n).astype(np.int64) * 4
    ends = (4 + 13 * n + np.cumsum(counts)).tolist()
    starts = [4 + 13 * n, *ends]
    return [(i if m else None, content[a:b]) for i, m, a, b in zip(ids, marks, starts, ends)]


def write_file(stream, docs: Iterable[tuple[int | None, bytes]]) -> dict:
    """Write documents in order; returns the totals of the file."""
    tool = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
    seek, index = [], []
    held: list[tuple[int | None, bytes]] = []
    size = 0
    totals = {"n_docs": 0, "n_tokens": 0, "first_doc": None, "last_doc": None}

    def flush() -> None:
        content = pack(held)
        frame = tool.compress(content)
        stream.write(frame)
        seek.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        known = [d for d, _ in held if d is not None]
        index.append((min(known, default=0), max(known, default=-1)))

    for doc, tokens in docs:
        if held and size + len(tokens) > FRAME_BYTES:
            flush()
            held, size = [], 0
        held.append((doc, tokens))
        size += len(tokens)
        totals["n_docs"] += 1
        totals["n_tokens"] += len(tokens) // 4
        if doc is not None:
            totals["first_doc"] = doc if totals["first_doc"] is None else totals["first_doc"]
            totals["last_doc"] = doc
    if held:
        flush()
    spans = b"".join(struct.pack("<qq", *x) for x in index)
    stream.write(struct.pack("<II", OWN_SKIPPABLE, len(spans)) + spans)
    table = b"".join(struct.pack("<III", *x) for x in seek)
    table += struct.pack("<IBI", len(seek), _CHECKSUMS, SEEK_FOOTER)
    stream.write(struct.pack("<II", SEEK_SKIPPABLE, len(table)) + table)
    return totals


def read_frames(file, wanted: set[int] | None = None) -> Iterator[list[tuple[int | None, bytes]]]:
    """Documents of each frame; with ``wanted`` only of frames that may hold one of them."""
    end = file.size()
    file.seek(end - 9)
    count, marks, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEK_FOOTER or not marks & _CHECKSUMS:
        raise ValueError("no seek table with checksums at the end of the file")
    start = end - 9 - 12 * count
    file.seek(start)
    seek = list(struct.iter_unpack("<III", file.read(12 * count)))
    file.seek(start - 8 - 16 * count)
    spans = list(struct.iter_unpack("<qq", file.read(16 * count)))
    tool, at = zstandard.ZstdDecompressor(), 0
    for (packed, size, checksum), (low, high) in zip(seek, spans):
        if wanted is None or any(low <= d <= high for d in wanted):
            file.seek(at)
            content = tool.decompress(file.read(packed), max_output_size=size)
            if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
                raise ValueError(f"checksum of the frame at byte {at} differs")
            yield unpack(content)
        at += packed


FILES = "part int, file string, n_docs bigint, n_tokens bigint, first_doc bigint, last_doc bigint"


def write_documents(
    docs: DataFrame, vocabulary: str, end_id: int, folder: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode and write all documents in ascending id order; returns the table of files."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, name = word_encoder(vocabulary), attempt_name(".tokens")
        end = end_id.to_bytes(4, "little")

        def encoded() -> Iterator[tuple[int | None, bytes]]:
            for batch in rows:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, b in text_groups(texts):
                    for doc, tokens in zip(ids[a:b], tool.encode(texts[a:b])):
                        yield doc, tokens + end

        with create(folder, name) as stream:
            totals = write_file(stream, encoded())
        row = {"part": TaskContext.get().partitionId(), "file": name, **totals}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([
            ("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()),
            ("first_doc", pa.int64()), ("last_doc", pa.int64()),
        ]))

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return settle(ordered.mapInArrow(run, FILES).filter("n_docs > 0"), "token-files")


def read_documents(files: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, ids`` of every document in the listed files; ``start`` counts the ids before it."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in batch.to_pylist():
                start = row["start"]
                with open_file(folder, row["file"]) as file:
                    for docs in read_frames(file):
                        counts = np.array([len(t) // 4 for _, t in docs], np.int64)
                        starts = start + np.cumsum(counts) - counts
                        start += int(counts.sum())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([d for d, _ in docs], pa.int64()), pa.array(starts),
                             pa.array([t for _, t in docs], pa.binary())], ["doc_id", "start", "ids"])

    # one row per file: the window and the dealing are bounded by the number of files
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("part", "file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    dealt = placed.repartitionByRange(max(1, files.count()), "part")
    return dealt.select("file", "start").mapInArrow(run, "doc_id bigint, start bigint, ids binary")


def fetch_documents(files: DataFrame, folder: str, wanted: list[int]) -> DataFrame:
    """``doc_id, ids`` of some documents, from their frames alone."""
    ids = set(wanted)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for name in batch.column(0).to_pylist():
                with open_file(folder, name) as file:
                    for docs in read_frames(file, ids):
                        hit = [(d, t) for d, t in docs if d in ids]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([d for d, _ in hit], pa.int64()), pa.array([t for _, t in hit], pa.binary())],
                            ["doc_id", "ids"])

    holds = F.exists(F.array(*[F.lit(i).cast("bigint") for i in wanted]),
                     lambda d: (d >= F.col("first_doc")) & (d <= F.col("last_doc")))
    return files.filter(holds).select("file").mapInArrow(run, "doc_id bigint, ids binary")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write all documents to a fresh folder and read them back: ``doc_id, start, ids``."""
    folder = scratch(docs.sparkSession, "tokens")
    return read_documents(write_documents(docs, vocabulary, end_id, folder), folder)
