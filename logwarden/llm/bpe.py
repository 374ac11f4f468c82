"""Byte-level BPE by a pair occurrence index, and decoding.

The pieces that a batch of texts needs and the task has not met yet are laid out
as one array of symbols with links to the next and previous symbol of the piece.
An index maps every mergeable pair to all its positions. Active ranks are applied
in ascending order: a rank merges all its positions at once, and only the pairs on
both sides of a merge are looked up again and added to the lists of their ranks.
Finished pieces are kept in a bounded table per worker, so frequent words are
encoded once.

Spark deals out the rows; nothing is shuffled. A lost executor repeats its rows.

Defined results: a null or empty text has no tokens; the string of a special token
becomes its id, as in the library; any other text decodes to itself; repeated rows
and rows without id are encoded like any other; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import WordTable, batch_groups, worker_tool

CACHE = 200_000  # words, and pieces of words, a worker remembers
LAYOUT = 4_000_000  # bytes of new pieces indexed together
_SPACES = r"\t-\r \x85\xa0  -     　"
# fixed values: the published splitting pattern of the vocabulary
PIECES = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACES}\p{{L}}\p{{N}}]+"
    rf"|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)
# a blank beside another blank or at an end does not simply start the next word
_UNEVEN = regex.compile(rf"\A | \z|[{_SPACES}] | [{_SPACES}]")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable ones themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, ids = byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * self.size
        for token, i in ids.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_ids = np.zeros(256, np.int32)
        for letter, byte in letters.items():
            self.byte_ids[byte] = ids[letter]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int32)
        self.right = np.array([ids[b] for _, b in pairs], np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        keys = self.left.astype(np.int64) * (self.size + 1) + self.right
        self._order = np.argsort(keys, kind="stable")
        self._keys = keys[self._order]
        names = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        self.splitter = regex.compile(f"({names})") if names else None

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where no merge exists."""
        keys = a.astype(np.int64) * (self.size + 1) + b
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._order[at], -1)


class PairIndex:
    """Symbols of many pieces and, for each active rank, the positions of its pair."""

    def __init__(self, vocabulary: Vocabulary, pieces: list[bytes]) -> None:
        self.vocabulary, self.none = vocabulary, vocabulary.size
        data = np.frombuffer(b"".join(pieces), np.uint8)
        count = len(data)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        self.starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        # one place behind the last stands for "no symbol"
        self.symbols = np.full(count + 1, self.none, np.int32)
        self.symbols[:count] = vocabulary.byte_ids[data]
        self.next = np.arange(1, count + 2, dtype=np.int32)
        self.next[ends - 1] = count
        self.next[count] = count
        self.previous = np.arange(-1, count, dtype=np.int32)
        self.previous[self.starts] = count
        self.positions: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self._add(np.arange(count, dtype=np.int32))

    def _add(self, places: np.ndarray) -> None:
        """Look up the pairs that start at ``places`` and file them under their ranks."""
        ranks = self.vocabulary.ranks(self.symbols[places], self.symbols[self.next[places]])
        found = ranks >= 0
        places, ranks = places[found], ranks[found]
        if not len(places):
            return
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, part in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(places, cuts)):
            if rank in self.positions:
                self.positions[rank].append(part)
            else:
                self.positions[rank] = [part]
                heapq.heappush(self.active, rank)

    def _apply(self, rank: int) -> None:
        lists, v = self.positions.pop(rank), self.vocabulary
        places = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        after = self.next[places]
        valid = (self.symbols[places] == v.left[rank]) & (self.symbols[after] == v.right[rank])
        places, after = places[valid], after[valid]
        if v.left[rank] == v.right[rank] and len(places) > 1:
            # in a row of equal symbols every second pair is taken, from the left
            at = np.arange(len(places))
            begins = np.concatenate(([True], after[:-1] != places[1:]))
            take = (at - np.maximum.accumulate(np.where(begins, at, 0))) % 2 == 0
            places, after = places[take], after[take]
        if not len(places):
            return
        beyond = self.next[after]
        self.symbols[places] = v.merged[rank]
        self.symbols[after] = self.none
        self.next[places] = beyond
        self.previous[beyond] = places
        before = self.previous[places]
        self._add(np.concatenate((before, places)))

    def encode(self) -> list[bytes]:
        """Ids of every piece as little-endian unsigned 32-bit integers."""
        while self.active:
            self._apply(heapq.heappop(self.active))
        alive = self.symbols[:-1] != self.none
        ids = self.symbols[:-1][alive].astype("<u4").tobytes()
        ends = (np.cumsum(np.add.reduceat(alive, self.starts, dtype=np.int64)) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]


class Encoder:
    """Texts to ids, with bounded tables of finished pieces and words."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self.pieces = WordTable(self._index, CACHE)
        self.words = WordTable(self._join, CACHE)

    def _split(self, text: str) -> list[str]:
        """Parts of a text whose ids do not depend on their neighbours: words with the blank before them."""
        if _UNEVEN.search(text):
            return PIECES.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]] if first else [" " + w for w in rest]

    def _index(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of new pieces, indexed together in layouts of bounded size."""
        done: dict[str, bytes] = {}
        start = size = 0
        for i, piece in enumerate(pieces):
            size += len(piece)
            if size >= LAYOUT or i + 1 == len(pieces):
                part = pieces[start : i + 1]
                done.update(zip(part, PairIndex(self.vocabulary, [p.encode() for p in part]).encode()))
                start, size = i + 1, 0
        return done

    def _join(self, words: list[str]) -> dict[str, bytes]:
        """Ids of new words from those of their pieces."""
        cut = [PIECES.findall(w) for w in words]
        ids = self.pieces.lookup(cut)
        return {w: b"".join([ids[p] for p in parts]) for w, parts in zip(words, cut)}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        v = self.vocabulary
        sections: list[list] = []
        for text in texts:
            parts = v.splitter.split(text or "") if v.splitter else [text or ""]
            sections.append([p if p in v.special else self._split(p) for p in parts if p])
        ids = self.words.lookup(part for text in sections for part in text if isinstance(part, list))
        special = {t: i.to_bytes(4, "little") for t, i in v.special.items()}
        return [
            b"".join([special[p] if isinstance(p, str) else b"".join(map(ids.__getitem__, p)) for p in text])
            for text in sections
        ]

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, numbers)).decode("utf-8", "replace")


@worker_tool
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_documents(
    docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", decode: bool = False
) -> DataFrame:
    """``doc_id, ids`` (binary, little-endian unsigned 32-bit) of every row; with ``decode`` also ``decoded``."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        for batch in rows:
            for part in batch_groups(batch):
                ids = tool.encode(part.column(1).to_pylist())
                columns = [part.column(0), pa.array(ids, pa.binary())]
                names = ["doc_id", "ids"]
                if decode:
                    columns.append(pa.array([tool.decode(x) for x in ids], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, ids binary" + ", decoded string" * decode)


def decode_documents(tokens: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, decoded`` from ``doc_id, ids``."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(vocabulary)
        for batch in rows:
            texts = [None if x is None else tool.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    kind = dict(tokens.dtypes)["doc_id"]
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded string")
