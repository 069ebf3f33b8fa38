"""The folder walk, extraction, snapshots and the audit stream."""

import hashlib
import os

from pyspark.sql import functions as F


def test_walk(spark, tmp_path):
    from heliograph.sources.walk import FolderWalk

    for name in ("a.jpg", "sub/b.PNG", "sub/c.txt", ".hidden/d.jpg", ".e.jpg", "sub/noext"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(name.encode())
    os.symlink(tmp_path, tmp_path / "sub" / "loop")
    os.symlink(tmp_path / "a.jpg", tmp_path / "link.jpg")
    spark.dataSource.register(FolderWalk)
    rows = spark.read.format("folder_walk").option("roots", f"{tmp_path},{tmp_path}/nowhere").load().collect()
    found = {r.path: r for r in rows if r.error is None}
    assert set(found) == {f"{tmp_path}/a.jpg", f"{tmp_path}/sub/b.PNG"}
    assert found[f"{tmp_path}/a.jpg"].size_bytes == 5 and found[f"{tmp_path}/a.jpg"].mtime_ns == os.stat(tmp_path / "a.jpg").st_mtime_ns
    assert [r.path for r in rows if r.error] == [f"{tmp_path}/nowhere"]


def test_extract(spark, tmp_path):
    from heliograph.sources.extract import coerce_json, decoded, hashed

    (tmp_path / "x.jpg").write_bytes(b"good")
    (tmp_path / "y.jpg").write_bytes(b"bad")
    got = {r.path: r for r in hashed(spark, str(tmp_path)).collect()}
    assert got[f"{tmp_path}/x.jpg"].sha256 == hashlib.sha256(b"good").hexdigest()

    def decode(content):
        if content == b"bad":
            raise ValueError("no picture")
        return {"width": 3, "height": 4, "phash": 5}

    files = spark.createDataFrame([("x", b"good"), ("y", b"bad")], "path string, content binary")
    rows = {r.path: r for r in decoded(files, decode).collect()}
    assert (rows["x"].width, rows["x"].error) == (3, None) and (rows["y"].width, rows["y"].error) == (None, "no picture")
    assert coerce_json(["a\0", None, 1, object()]) == ["a", 1] and coerce_json(object()) is None and len(coerce_json("x" * 999)) == 256


def test_snapshots(spark, tmp_path):
    from heliograph.sources.snapshots import Snapshots

    s = Snapshots(spark, f"file://{tmp_path}/catalog")
    s.publish(spark.range(5).toDF("id"), "photos", "id")
    s.publish(s.read("photos").where("id > 1"), "photos")
    assert sorted(r.id for r in s.read("photos").collect()) == [2, 3, 4]


def test_audit_stream_equals_batch(spark, tmp_path, data):
    from heliograph.plans.proxies import operations
    from heliograph.streaming.audit import operations_stream, tallies

    own = operations(spark, data).withColumn("performed_at", F.col("performed_at").cast("timestamp"))
    own.orderBy("performed_at").coalesce(1).write.parquet(f"{tmp_path}/ops")
    stream = tallies(operations_stream(spark, f"{tmp_path}/ops", own.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tallies").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.start, r.op, r.n, r.bytes)
    assert sorted(map(key, spark.table("tallies").collect())) == sorted(map(key, tallies(own).collect()))


def jpeg(tiff=b"", size=(640, 480), end=b"\xff\xd9"):
    import struct

    exif = b"\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff if tiff else b""
    return b"\xff\xd8\xff\xfe\x00\x04hi" + exif + b"\xff\xff\xc2\x00\x0b\x08" + struct.pack(">HH", size[1], size[0]) + b"\x01\x01\x11\x00\xff\xda\x00\x02pixels" + end


def test_headers_of_odd_files():
    import struct

    import pytest

    from heliograph.sources.headers import Damaged, read_header

    assert (read_header(jpeg())["width"], read_header(jpeg())["exif"]) == (640, "{}")
    loop = b"II*\0\x08\0\0\0" + struct.pack("<H", 1) + struct.pack("<HHII", 34665, 4, 1, 8) + b"\0\0\0\0"  # the directory below is itself
    assert read_header(jpeg(loop))["captured_at"] is None
    far = b"II*\0\x08\0\0\0" + struct.pack("<H", 2) + struct.pack("<HHII", 271, 2, 100, 5000) + struct.pack("<HHI4s", 272, 2, 4, b"a\0b ") + b"\0\0\0\0"
    assert (read_header(jpeg(far))["camera_make"], read_header(jpeg(far))["camera_model"]) == (None, "ab")  # a value outside the block is left out
    assert read_header(jpeg(b"nonsense"))["width"] == 640  # damaged metadata is as none
    assert read_header(b"RIFF\x16\0\0\0WEBPVP8L\x0a\0\0\0\x2f" + struct.pack("<I", 99 | 49 << 14) + b"\0" * 5)["height"] == 50
    assert read_header(b"RIFF\x16\0\0\0WEBPVP8 \x0a\0\0\0\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 300, 200))["width"] == 300
    for bad in (b"", b"\xff\xd8", jpeg()[:30], jpeg(end=b""), b"\x89PNG\r\n\x1a\n" + b"\0" * 4, b"GIF89a\0", b"plain words", b"\0\0\0\x10ftypheic\0\0\0\0", b"MM\0*\0\0\0\x08\0\0"):
        with pytest.raises(Damaged):
            read_header(bad)


def test_a_scan_survives_unreadable_and_damaged_files(spark, tmp_path):
    from heliograph.operators.reconcile import split_errors
    from heliograph.sources.headers import scanned
    from heliograph.sources.walk import FolderWalk

    (tmp_path / "good.jpg").write_bytes(jpeg())
    (tmp_path / "bad.jpg").write_bytes(b"not a picture")
    (tmp_path / "gone.jpg").write_bytes(b"x")
    spark.dataSource.register(FolderWalk)
    found = spark.read.format("folder_walk").option("roots", f"{tmp_path},{tmp_path}/nowhere").load().cache()
    assert found.count() == 4
    os.remove(tmp_path / "gone.jpg")  # between the walk and the scan
    rows = {os.path.basename(r.path): r for r in scanned(found).collect()}
    assert (rows["good.jpg"].width, rows["good.jpg"].error, rows["good.jpg"].mtime_ns) == (640, None, os.stat(tmp_path / "good.jpg").st_mtime_ns)
    assert rows["bad.jpg"].sha256 == hashlib.sha256(b"not a picture").hexdigest() and "Damaged" in rows["bad.jpg"].error
    assert rows["gone.jpg"].sha256 is None and rows["gone.jpg"].error and rows["nowhere"].error
    usable, errors = split_errors(scanned(found), 7)
    assert sorted(os.path.basename(r.path) for r in usable.collect()) == ["bad.jpg", "good.jpg"]
    assert sorted(os.path.basename(r.path) for r in errors.collect()) == ["bad.jpg", "gone.jpg", "nowhere"]


def test_perceptual_hash_against_a_plain_transform(spark):
    import numpy as np

    from heliograph.functions.pictures import with_perceptual_hash

    rng = np.random.default_rng(3)
    pics = [rng.integers(0, 256, 1024).tolist() for _ in range(20)] + [[7] * 1024, None, [1, 2], [None] * 1024]
    got = [r.h for r in spark.createDataFrame([(i, p) for i, p in enumerate(pics)], "i int, p array<int>").transform(with_perceptual_hash, "p", "h").orderBy("i").collect()]
    assert got[20:] == [-(1 << 63), None, None, None]  # a flat picture has its mean only
    for p, h in zip(pics[:20], got[:20], strict=True):
        a = np.array(p, float).reshape(32, 32)
        c = lambda k: np.cos(np.pi * k * (2 * np.arange(32) + 1) / 64)
        low = np.array([[4 * c(u) @ a @ c(v) for v in range(8)] for u in range(8)]).ravel()
        bits = int("".join("1" if x > np.median(low) else "0" for x in low), 2)
        assert h == (bits - (1 << 64) if bits >> 63 else bits)
    near = np.clip(np.array(pics[0]) + rng.integers(-3, 4, 1024), 0, 255).tolist()
    a, b = (r.h & (1 << 64) - 1 for r in spark.createDataFrame([(pics[0],), (near,)], "p array<int>").transform(with_perceptual_hash, "p", "h").collect())
    assert (a ^ b).bit_count() <= 4
