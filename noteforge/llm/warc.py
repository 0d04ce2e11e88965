"""WARC archives: written by Spark's text sink, read back by boundary-chain verification.

Writing. Each page is one record; of pages with equal payloads of at least
``min_bytes`` bytes the one with the largest id is a ``response``, the others are
``revisit`` records that name it and carry no payload.

Reading. The text source cuts the files at every magic line, in splits, so a large
archive is read by many tasks. Each piece is a *candidate* record: its header gives
the offset of its successor. Offsets are running sums of piece lengths, first inside
a split, then over the splits of a file. A task contracts the candidates of its
split to where their chains leave the split; pointer jumping over these exits, from
the start of each file, finds the one true entry of every split; the walk from there
keeps the reachable records. Magic lines inside payloads are never reached.

Defined results: a null payload is empty; a null url gives no target header; line
breaks in a url are percent-encoded. A null page id is smaller than any other and
is written as no id. Rows with equal id and payload are all responses. An empty
table makes an archive without records, which reads back as an empty table.
Other columns of the input are not written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noteforge.llm.common import map_arrow
from noteforge.operators.joins import lookup_join
from noteforge.runtime import scratch_path, stage_table

#: Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
BREAK = "\r\n\r\n"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
BASE32_PLAIN, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 40 bits at a time, so that each part fits a long."""
    hexa = F.sha1(payload)
    parts = [
        F.translate(F.lpad(F.conv(F.substring(hexa, 1 + 10 * i, 10), 16, 32), 8, "0"), BASE32_PLAIN, BASE32)
        for i in range(4)
    ]
    return F.concat(*parts)


def with_record_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Rows ``page_id, url, html`` with ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumns(
        {"payload_bytes": F.octet_length("html").cast("bigint"), "payload_digest": sha1_base32(F.col("html"))}
    )
    repeated = (
        rows.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select("payload_digest", "_first", F.lit(True).alias("_repeats"))
    )
    rows = lookup_join(rows, repeated, "payload_digest", "left", spread_by=["page_id", "url"])
    revisit = F.coalesce(F.col("_repeats"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.withColumns({
        "record_type": F.when(revisit, "revisit").otherwise("response"),
        "refers_to": F.when(revisit, F.col("_first")),
    }).drop("_first", "_repeats")


def _line(name: str, value: Column) -> Column:
    """A header line; none where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """One archive file per task of the input."""
    rows = with_record_types(pages, min_bytes)
    body = F.when(F.col("record_type") == "response", F.col("html")).otherwise("")
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    record = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:md5:"), F.md5(F.concat_ws("|", "page_id", "url")), F.lit(">"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", target),
        _line("WARC-Page-ID", F.col("page_id")),
        _line("WARC-Refers-To-Page-ID", F.col("refers_to")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _line("WARC-Payload-Length", F.col("payload_bytes")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(body) + len(HTTP_HEAD)),
        F.lit("\r\n"), F.lit(HTTP_HEAD), body,
    )
    rows.select(record.alias("value")).write.option("lineSep", BREAK).text(path)


PIECES = "path string, block bigint, rel bigint, size bigint, piece binary"
CANDIDATES = (
    "path string, block bigint, rel bigint, taken bigint, length bigint, left_at bigint, page_id bigint, url string, "
    "record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, whole boolean, sound boolean, "
    "head bigint"
)


def archive_pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between magic lines, split by split, in file order within a split."""
    return (
        spark.read.option("lineSep", MAGIC).text(path)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.col("value").cast("binary").alias("piece"),
        )
    )


def parse_head(piece: bytes) -> tuple[int, dict[str, str]] | None:
    """(bytes of the header with its blank line, fields) or None where no record can start."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in piece[:end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(": ")
        if not colon:
            return None
        fields[name.lower()] = value
    return (end + 4, fields) if fields.get("content-length", "").isdigit() else None


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP header."""
    head, blank, body = block.partition(b"\r\n\r\n")
    return body if blank else block


def digest_of(payload: bytes) -> str:
    from base64 import b32encode

    return b32encode(hashlib.sha1(payload).digest()).decode()


class Split:
    """The candidates of one split, and the bytes that a record still waits for."""

    def __init__(self, path: str, block: int):
        self.path, self.block, self.at = path, block, 0
        self.rows: list[dict] = []
        self.waiting: list[dict] = []
        self.buffer, self.buffer_at = bytearray(), 0

    def add(self, piece: bytes) -> None:
        start = self.at - len(MAGIC)  # of the magic line before the piece, from the first piece of the split
        if self.waiting:
            self.buffer += MAGIC.encode() + piece
        parsed = parse_head(piece)
        if parsed:
            head, x = parsed
            content = int(x["content-length"])
            row = {
                "path": self.path, "block": self.block, "rel": start, "taken": len(piece) + len(MAGIC),
                "length": len(MAGIC) + head + content + len(BREAK), "left_at": 0,
                "page_id": _number(x.get("warc-page-id")), "url": x.get("warc-target-uri"),
                "record_type": x.get("warc-type"), "refers_to": _number(x.get("warc-refers-to-page-id")),
                "payload_bytes": _number(x.get("warc-payload-length")),
                "payload_digest": x.get("warc-payload-digest", "").removeprefix("sha1:"),
                "whole": False, "sound": None, "head": head,
            }
            if len(piece) >= head + content:
                self.settle(row, piece[head : head + content])
            else:
                if not self.waiting:
                    self.buffer, self.buffer_at = bytearray(piece), self.at
                self.waiting.append(row)
        else:  # takes room, but no record starts here
            row = dict.fromkeys(["length", "page_id", "url", "record_type", "refers_to", "payload_bytes",
                                 "payload_digest", "sound", "head"])
            row |= {"path": self.path, "block": self.block, "rel": start, "taken": len(piece) + len(MAGIC),
                    "left_at": None, "whole": False}
        self.rows.append(row)
        self.at += len(piece) + len(MAGIC)
        have = self.buffer_at + len(self.buffer)
        for w in [w for w in self.waiting if w["rel"] + w["length"] - len(BREAK) <= have]:
            end = w["rel"] + w["length"] - len(BREAK) - self.buffer_at
            self.settle(w, bytes(self.buffer[w["rel"] + len(MAGIC) + w["head"] - self.buffer_at : end]))
            self.waiting.remove(w)

    def settle(self, row: dict, block: bytes) -> None:
        row["whole"] = True
        payload = payload_of(block)
        row["sound"] = row["record_type"] != "response" or (
            digest_of(payload) == row["payload_digest"] and len(payload) == row["payload_bytes"]
        )

    def end(self) -> dict[str, list]:
        """Contract: where the chain from each candidate leaves the split."""
        leaves: dict[int, int] = {}
        for row in reversed(self.rows):
            if row["length"] is not None:
                after = row["rel"] + row["length"]
                row["left_at"] = leaves[row["rel"]] = leaves.get(after, after)
        names = [c.split()[0] for c in CANDIDATES.split(", ")]
        return {n: [r[n] for r in self.rows] for n in names}


def candidates(pieces: DataFrame) -> DataFrame:
    def run(batches) -> Iterator[dict[str, list]]:
        split = None
        for batch in batches:
            for path, block, piece in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if split is None or (path, block) != (split.path, split.block):
                    if split:
                        yield split.end()
                    split = Split(path, block)
                split.add(piece)
        if split:
            yield split.end()

    return map_arrow(pieces, run, CANDIDATES)


def _entries(found: DataFrame) -> DataFrame:
    """``(path, at)``: the offset at which the true chain enters each split, by pointer jumping.

    Every jump doubles the splits that are passed, so the rounds are the binary
    logarithm of the most splits in one file.
    """
    splits = found.groupBy("path").agg(F.countDistinct("block").alias("n")).agg(F.max("n")).first()[0] or 0
    jump = found.where("length IS NOT NULL").select("path", "at", F.col("leaves").alias("to"))
    reached = jump.where("at = 0").select("path", "at")
    passed = 1
    while passed < splits:
        step = reached.join(jump, ["path", "at"]).select("path", F.col("to").alias("at"))
        reached = stage_table(reached.unionByName(step).distinct(), "warc-reached")
        passed *= 2
        if passed < splits:
            further = jump.select("path", F.col("at").alias("to"), F.col("to").alias("far"))
            jump = stage_table(
                jump.join(further, ["path", "to"], "left").select("path", "at", F.coalesce("far", "to").alias("to")),
                "warc-jump",
            )
    return reached


def _walk(group: pa.Table) -> pa.Table:
    """Records of one split that the chain from its entry passes."""
    after = dict(zip(group["at"].to_pylist(), group["length"].to_pylist()))
    at = next((e for e in group["entry"].to_pylist() if e is not None), None)
    keep = []
    while at in after:
        keep.append(at)
        at += after[at]
    return group.filter(pc.is_in(group["at"], pa.array(keep, pa.int64()))).drop_columns("entry")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per reachable record: file, offset, length and the header's fields.

    ``sound`` tells whether a response's payload has the length and digest that
    its header states.
    """
    pieces = archive_pieces(spark, path)
    local = stage_table(candidates(pieces), "warc-candidates")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (  # a row per split
        local.groupBy("path", "block").agg(F.sum("taken").alias("t"))
        .select("path", "block", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    )
    found = stage_table(
        local.join(starts, ["path", "block"]).withColumns({
            "at": F.col("base") + F.col("rel"), "leaves": F.col("base") + F.col("left_at"),
        }).drop("base", "rel", "left_at", "taken"),
        "warc-found",
    )
    entry = _entries(found).select("path", "at", F.col("at").alias("entry"))
    marked = found.where("length IS NOT NULL").drop("leaves").join(entry, ["path", "at"], "left")
    columns = [c for c in marked.columns if c != "entry"]
    kept = marked.groupBy("path", "block").applyInArrow(_walk, marked.drop("entry").schema).select(*columns)
    cut = kept.where("NOT whole")
    if cut.isEmpty():
        return kept
    # At most one reachable record for each end of a split: its bytes lie in later splits.
    kept = stage_table(kept, "warc-kept")
    return kept.where("whole").unionByName(
        kept.where("NOT whole").drop("sound")
        .join(_soundness(pieces, starts, kept.where("NOT whole")), ["path", "at"], "left")
        .select(*columns)
    )


def _soundness(pieces: DataFrame, starts: DataFrame, cut: DataFrame) -> DataFrame:
    """``(path, at, sound)`` of records whose payload goes on in another split."""

    def run(batches) -> Iterator[dict[str, list]]:
        key, at = None, 0
        for batch in batches:
            paths, blocks, texts = (batch.column(i).to_pylist() for i in range(3))
            rels = []
            for path, block, piece in zip(paths, blocks, texts):
                if (path, block) != key:
                    key, at = (path, block), 0
                rels.append(at)
                at += len(piece) + len(MAGIC)
            yield {"path": paths, "block": blocks, "rel": rels, "size": [len(t) for t in texts], "piece": texts}

    placed = map_arrow(pieces, run, PIECES).join(starts, ["path", "block"]).withColumn("pos", F.col("base") + F.col("rel"))
    wanted = F.broadcast(cut.select("path", "at", "length", "head", "payload_digest", "payload_bytes"))  # a row per split at most
    parts = placed.join(wanted, "path").where("pos >= at AND pos < at + length")
    fields = ["path", "at", "length", "head", "payload_digest", "payload_bytes"]

    def check(group: pd.DataFrame) -> pd.DataFrame:
        x = group.iloc[0]
        pieces_in_order = group.sort_values("pos")["piece"]
        record = MAGIC.encode().join(pieces_in_order)[: int(x["length"]) - len(MAGIC) - len(BREAK)]
        payload = payload_of(record[int(x["head"]) :])
        sound = digest_of(payload) == x["payload_digest"] and len(payload) == x["payload_bytes"]
        return pd.DataFrame({"path": [x["path"]], "at": [x["at"]], "sound": [bool(sound)]})

    return parts.select(*fields, "pos", "piece").groupBy("path", "at").applyInPandas(
        check, "path string, at bigint, sound boolean"
    )


def intact(records: DataFrame) -> DataFrame:
    """The records as they are; one whose payload isn't what its header states fails the job."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("without an id"))
    damaged = F.raise_error(F.concat(F.lit("damaged payload of page "), page))
    sound = F.coalesce(F.col("sound"), F.lit(False))
    return records.withColumn("payload_bytes", F.when(sound, F.col("payload_bytes")).otherwise(damaged))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the archives into the shared folder and read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(spark, path)
