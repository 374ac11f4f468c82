"""WARC archives of pages, and their index by an external merge of sorted runs.

Every task writes its pages as one capture run: gzip members sorted by URL key and
timestamp, and beside them the run's index in blocks of sorted entries. Of pages
with equal payloads of at least ``REVISIT_BYTES`` bytes the largest page_id holds
the payload, the others are revisits of it. The runs' indexes are then merged: the
first keys of all blocks split the key space into even ranges, and for each range a
task streams the blocks of all runs that reach into it through a loser tree. That
gives histories in global order of (URL key, timestamp, page_id), with memory for
one block of each run only; one URL with a third of all captures is split between
ranges, since ranges are cut by the whole key.

Files are named by attempt and listed in the tables of runs, so what a lost
executor left is never read.

Defined results: a null html is an empty payload, a null url an empty one, a null
page_id never holds a payload for others if any page with an id has it; rows that
repeat the largest page_id are responses alike; an empty table gives an empty
index; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logwarden.llm.common import scratch, settle
from logwarden.llm.shared_files import attempt_name, create, open_file

REVISIT_BYTES = 1_000
BLOCK = 500  # index entries per block
RANGE = 100_000  # index entries per merge task
BROADCAST_ROWS = 100_000  # digests of about 60 bytes; more are joined by shuffle
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels reversed and joined by commas, then path and query."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), "^www[0-9]*\\.|:(80|443)$", "")
    rest = F.regexp_extract(bare, "^[^/?]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


def capture_rows(pages: DataFrame) -> DataFrame:
    """Pages with payload, digest, URL key, and the page that holds the payload of a revisit.

    Captures carry no time of their own: a page stands at ``EPOCH`` plus its id in seconds.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("urlkey", url_key(F.col("url")))
    large = F.octet_length("payload") >= REVISIT_BYTES
    copies = (
        rows.filter(large).groupBy("digest")
        .agg(F.max("page_id").alias("holder"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    )
    copies = settle(copies, "copies")
    small = copies.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(copies) if small else copies, "digest", "left")
    holder = F.when(large & F.col("holder").isNotNull() & ~F.col("holder").eqNullSafe(F.col("page_id")), F.col("holder"))
    return joined.select("page_id", "url", "urlkey", "payload", "digest", holder.alias("holder"))


def _stamp(page: int | None) -> datetime:
    return EPOCH + timedelta(seconds=(page or 0) % (1 << 35))


def _record_id(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def record(page: int | None, url: str, payload: bytes, digest: str, holder: int | None) -> bytes:
    """One record as a gzip member of its own."""
    safe = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if holder is not None else http + payload
    head = {
        "WARC-Type": "response" if holder is None else "revisit",
        "WARC-Record-ID": _record_id(page),
        "WARC-Date": _stamp(page).strftime("%Y-%m-%dT%H:%M:%SZ"),
        "WARC-Target-URI": safe,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
    }
    if holder is not None:
        head |= {"WARC-Refers-To": _record_id(holder), "WARC-Profile": PROFILE}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(body))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> dict:
    """Page, payload size, digest, type and reference of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")).split(b": ")[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    page = lambda name: int(v) if (v := fields[name].removeprefix("<urn:page:").rstrip(">")) else None
    response = fields["WARC-Type"] == "response"
    if version != "WARC/1.1" or response and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return {"page_id": page("WARC-Record-ID"), "payload_bytes": size, "payload_digest": digest,
            "record_type": fields["WARC-Type"], "refers_to": None if response else page("WARC-Refers-To")}


Entry = tuple[str, int, int, str, int, int]  # URL key, seconds, page (null: -1), file, offset, length


def _pack(entries: list[Entry]) -> bytes:
    return zlib.compress(json.dumps(entries).encode(), 3)


def _unpack(data: bytes) -> list[Entry]:
    return [tuple(e) for e in json.loads(zlib.decompress(data))]


BLOCKS = ("run string, block int, first struct<urlkey:string,stamp:bigint,page:bigint>, n int, offset bigint, length bigint")
_FIRST = pa.struct([("urlkey", pa.string()), ("stamp", pa.int64()), ("page", pa.int64())])


def write_runs(captures: DataFrame, folder: str) -> DataFrame:
    """Write each partition as an archive with a sorted index beside it; returns the blocks of all indexes."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, index, at, entries, blocks, offset = attempt_name(".warc.gz"), None, 0, [], [], 0
        with create(folder, name) as archive, create(folder, name + ".index") as index:

            def flush() -> None:
                nonlocal offset
                data = _pack(entries)
                index.write(data)
                key = dict(zip(("urlkey", "stamp", "page"), entries[0]))
                blocks.append({"run": name, "block": len(blocks), "first": key, "n": len(entries), "offset": offset,
                               "length": len(data)})
                offset += len(data)
                entries.clear()

            for batch in rows:
                for page, url, key, payload, digest, holder in zip(*(c.to_pylist() for c in batch.columns)):
                    member = record(page, url, payload, digest, holder)
                    archive.write(member)
                    seconds = int((_stamp(page) - EPOCH).total_seconds())
                    entries.append((key, seconds, -1 if page is None else page, name, at, len(member)))
                    at += len(member)
                    if len(entries) == BLOCK:
                        flush()
            if entries:
                flush()
        if blocks:
            yield pa.RecordBatch.from_pylist(blocks, schema=pa.schema([
                ("run", pa.string()), ("block", pa.int32()), ("first", _FIRST), ("n", pa.int32()),
                ("offset", pa.int64()), ("length", pa.int64())]))

    # the page is the clock, so (URL key, page) is the order of (URL key, timestamp, page)
    ordered = captures.select("page_id", "url", "urlkey", "payload", "digest", "holder").sortWithinPartitions(
        "urlkey", F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(1 << 35)), F.coalesce("page_id", F.lit(-1)))
    return settle(ordered.mapInArrow(run, BLOCKS), "runs")


class LoserTree:
    """Merges sorted streams: each step replays one path of matches from the winner's leaf."""

    def __init__(self, streams: list[Iterator]) -> None:
        self.streams, self.size = streams, len(streams)
        self.heads = [next(s, None) for s in streams]
        self.losers = [-1] * max(1, self.size)  # the node 0 holds the winner
        for leaf in range(self.size):
            self._replay(leaf)

    def _beats(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None and (self.heads[a] is not None or a < b)
        return (self.heads[a], a) < (self.heads[b], b)

    def _replay(self, leaf: int) -> None:
        node, winner = (leaf + self.size) // 2, leaf
        while node > 0:
            if self.losers[node] < 0:  # first to arrive while the tree is built
                self.losers[node] = winner
                return
            if self._beats(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.size and self.heads[self.losers[0]] is not None:
            best = self.losers[0]
            yield self.heads[best]
            self.heads[best] = next(self.streams[best], None)
            self._replay(best)


def _stream(folder: str, run: str, blocks: Iterable[tuple[int, int]], low, high) -> Iterator[Entry]:
    """Entries of one run within [low, high), block by block."""
    with open_file(folder, run + ".index") as file:
        for offset, length in blocks:
            file.seek(offset)
            for entry in _unpack(file.read(length)):
                if (low is None or entry[:3] >= low) and (high is None or entry[:3] < high):
                    yield entry


INDEX = "part int, position bigint, urlkey string, stamp bigint, page_id bigint, file string, offset bigint, length bigint"


def merge_runs(blocks: DataFrame, folder: str) -> DataFrame:
    """All index entries; ``part, position`` give the global order of (URL key, stamp, page)."""
    ranges = max(1, -(-(blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // RANGE))
    # one key per merge task: the first block of each even share of the ordered blocks
    dealt = blocks.select("first").repartitionByRange(ranges, "first").withColumn("_p", F.spark_partition_id())
    cuts = [tuple(r[0]) for r in dealt.groupBy("_p").agg(F.min("first").alias("f")).orderBy("f").select("f").collect()][1:]
    bounds = list(zip([None, *cuts], [*cuts, None]))

    # a block reaches into every range from its first key to the next block's
    key = lambda c: F.struct(F.lit(c[0]).alias("urlkey"), F.lit(c[1]).cast("bigint").alias("stamp"),
                             F.lit(c[2]).cast("bigint").alias("page"))
    after = F.lead("first").over(Window.partitionBy("run").orderBy("block"))
    edges = F.array(*[key(c) for c in cuts]) if cuts else F.array().cast("array<struct<urlkey:string,stamp:bigint,page:bigint>>")
    begin = F.size(F.filter(edges, lambda e: e <= F.col("first")))
    end = F.when(F.col("after").isNull(), F.lit(len(cuts))).otherwise(F.size(F.filter(edges, lambda e: e <= F.col("after"))))
    reach = blocks.withColumn("after", after).withColumn("part", F.explode(F.sequence(begin, end)))

    def merge(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        low, high = bounds[part]
        runs: dict[str, list] = {}
        for r in sorted(table.select(["run", "block", "offset", "length"]).to_pylist(), key=lambda r: (r["run"], r["block"])):
            runs.setdefault(r["run"], []).append((r["offset"], r["length"]))
        entries = list(LoserTree([_stream(folder, run, b, low, high) for run, b in runs.items()]))
        keys, stamps, pages, files, offsets, lengths = zip(*entries) if entries else ((),) * 6
        page = pa.array(pages, pa.int64())
        return pa.table({
            "part": pa.array([part] * len(entries), pa.int32()), "position": pa.array(range(len(entries)), pa.int64()),
            "urlkey": pa.array(keys, pa.string()), "stamp": pa.array(stamps, pa.int64()),
            "page_id": pc.if_else(pc.equal(page, -1), pa.scalar(None, pa.int64()), page),
            "file": pa.array(files, pa.string()), "offset": pa.array(offsets, pa.int64()),
            "length": pa.array(lengths, pa.int64())})

    return settle(reach.groupBy("part").applyInArrow(merge, INDEX), "index")


RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Every indexed record, read from its place in the archives."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        try:
            for batch in rows:
                out = []
                for path, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                    if path != name:
                        if file:
                            file.close()
                        name, file = path, open_file(folder, path)
                    file.seek(offset)
                    out.append(parse_record(file.read(length)))
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([
                    ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                    ("record_type", pa.string()), ("refers_to", pa.int64())]))
        finally:
            if file:
                file.close()

    near = index.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return near.select("file", "offset", "length").mapInArrow(run, RECORDS)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write archives, merge their indexes, read every record back."""
    folder = scratch(pages.sparkSession, "warc")
    return read_records(merge_runs(write_runs(capture_rows(pages), folder), folder), folder)
