"""Archives read back, and the package directory against zipfile."""

import hashlib
import io
import struct
import zipfile

import pyarrow as pa
import pytest

from riskspark.llm import warc

ROWS = "page_id long, url string, html string, payload string, payload_digest string, first_id string, uri string, record_type int"


def table(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], ROWS)


BIG = "é" * 600
CASES = [
    (1, "http://a/\r\nX: y", BIG), (2, None, BIG), (5, "http://b", BIG), (5, "http://b", BIG), (3, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""),
    (None, "u", BIG), (8, "u", "z" * 3_000_000), (9, "u", "a\r\n\r\nWARC/1.1\r\n" * 100), (None, "n", "q" * 2000), (None, "n", "q" * 2000), (10, "u", "x" * 999), (11, "u", "x" * 999),
]


def brute(rows):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == data and j is not None]
        first = max(same) if same and len(data) >= 1000 else None
        again = first is not None and i != first
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.digests(df).collect()), key=str)


def test_round_trip(spark, tmp_path):
    records = warc.read(warc.write(table(spark, CASES), f"file://{tmp_path}/w"))
    assert got(records) == brute(CASES)
    kept = {r["page_id"]: r["payload"] for r in records.collect() if r["record_type"] == "response" and r["page_id"]}
    assert bytes(kept["8"]) == b"z" * 3_000_000 and bytes(kept["9"]).decode() == CASES[10][2] and bytes(kept["6"]) == b""


def test_given_pages(spark, sf, tmp_path):
    df = spark.read.parquet(f"{sf}/pages.parquet")
    packages = warc.write(df.repartition(3), f"file://{tmp_path}/w", member_bytes=20_000)
    assert got(warc.read(packages)) == brute([(r["page_id"], r["url"], r["html"]) for r in df.collect()])
    with zipfile.ZipFile(packages.first()["uri"].removeprefix("file://")) as package:
        assert package.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in package.infolist())


def test_members_are_read_by_many_tasks(spark, tmp_path):
    rows = [(k, "u", hashlib.sha256(str(k).encode()).hexdigest() * 40) for k in range(400)]
    packages = warc.write(table(spark, rows).coalesce(1), f"file://{tmp_path}/w", member_bytes=10_000)
    records = warc.read(packages, task_bytes=1)
    per_task = records.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([sum(b.num_rows for b in batches)])], names=["n"]) for _ in (0,)), "n long")
    sizes = [r["n"] for r in per_task.collect()]
    assert sum(sizes) == 400 and len([n for n in sizes if n]) > 8 and max(sizes) < 100
    assert packages.count() == 1 and got(records) == brute(rows)


def test_empty_table(spark, tmp_path):
    none = table(spark, CASES).limit(0)
    assert warc.digests(warc.read(warc.write(none, f"file://{tmp_path}/w"))).count() == 0


class Held:
    def __init__(self, data):
        self.data, self.size = data, len(data)

    def read(self, at, size):
        return self.data[at:at + size]


def packed(names, comment=b"", big=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, name in enumerate(names):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=big) as f:
                f.write(str(k).encode() * 3)
        z.comment = comment
    return Held(out.getvalue())


@pytest.mark.parametrize("count,comment,big", [(0, b"", False), (3, b"", False), (3, b"PK\5\6 in a comment" + b"\0" * 30, True), (66_000, b"note", False)])
def test_directory(count, comment, big):
    names = [f"m/é{k}" for k in range(count)]
    held = packed(names, comment, big)
    found = warc.members(held)
    assert [m["name"] for m in found] == names
    for k in (0, count - 1) if count else ():
        at = warc.data_offset(held, found[k])
        assert held.read(at, found[k]["size"]) == str(k).encode() * 3


def test_zip64_fields_of_a_large_member():
    name = b"archive/0.warc.gz"
    extra = struct.pack("<HHQQQ", 1, 24, 5 << 32, 5 << 32, 6 << 32)
    entry = b"PK\1\2" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra) + 4, 0, 0, 0, 0, 0xFFFFFFFF)
    entry += name + struct.pack("<HH", 99, 0) + extra
    end64 = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), 0)
    data = entry + end64 + b"PK\6\7" + struct.pack("<IQI", 0, len(entry), 1) + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 1, 1, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert warc.members(Held(data)) == [{"name": name.decode(), "method": 0, "size": 5 << 32, "header": 6 << 32}]


def test_damage_is_an_error():
    held = packed(["a"])
    with pytest.raises(ValueError):
        warc.members(Held(held.data[:-5]))
    with pytest.raises(ValueError):
        warc.data_offset(held, warc.members(held)[0] | {"method": 8})
    good = warc.record(1, "u", b"payload", "response", None, hashlib.sha1(b"payload").hexdigest())
    assert warc.parse(good)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"payload", "response", None, "00" * 20))
