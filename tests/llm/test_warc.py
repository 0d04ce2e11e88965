"""Round trips, also with magic lines inside payloads and over many splits."""

import base64
import glob
import hashlib
import os

import pytest

from noteforge.llm.warc import intact, read_archives, round_trip, write_archives
from noteforge.runtime import scratch_path

PAGES = "page_id bigint, url string, html string, record_type string"
TRAP = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Page-ID: 999\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\n"


def brute(rows, min_bytes=0):
    first = {}
    for i, _, html in rows:
        h = html or ""
        if i is not None and (h not in first or first[h] is None or i > first[h]):
            first[h] = i
        first.setdefault(h, None)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = len(data) >= min_bytes and i != first[html or ""]
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response",
                    first[html or ""] if revisit else None))
    return sorted(out, key=repr)


def awkward():
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 40)) for i in range(120)]
    rows += [(200 + i, "u", TRAP * (1 + i)) for i in range(12)]
    rows += [(300, None, None), (301, "a\r\nb: c", ""), (302, "é\n", "日本 é"), (303, "u", "same"), (304, "u", "same"), (304, "u", "same"),
             (None, "u", "same"), (None, None, "only null"), (305, "u", "WARC/1.1\r\n"), (306, "u", "\r\n\r\n"), (307, "u", "x" * 300_000)]
    return rows


@pytest.mark.parametrize("split", ["128m", "700", "5k"])
def test_round_trip(spark, split):
    rows = awkward()
    pages = spark.createDataFrame([(*r, "clash") for r in rows], PAGES).repartition(3)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    path = scratch_path(spark, "warc-test")
    write_archives(pages, path)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = read_archives(spark, path).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == brute(rows)
    assert all(r["sound"] for r in got)


def test_threshold(spark):
    rows = awkward()
    got = round_trip(spark.createDataFrame([(*r, "clash") for r in rows], PAGES), min_bytes=1).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=repr) == brute(rows, 1)


def test_empty_table(spark):
    assert round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_a_damaged_payload_fails_the_job(spark):
    path = scratch_path(spark, "warc-damaged")
    write_archives(spark.createDataFrame([(i, "u", f"<p>page {i}</p>", "") for i in range(20)], PAGES).repartition(2), path)
    assert intact(read_archives(spark, path)).count() == 20
    for name in glob.glob(f"{path}/part-*"):
        with open(name, "rb") as f:
            data = f.read()
        with open(name, "wb") as f:
            f.write(data.replace(b"<p>page 7</p>", b"<p>page 8</p>"))
        if os.path.exists(crc := os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc")):
            os.remove(crc)
    assert [r["page_id"] for r in read_archives(spark, path).collect() if not r["sound"]] == [7]
    with pytest.raises(Exception, match="damaged payload of page 7"):
        intact(read_archives(spark, path)).collect()
