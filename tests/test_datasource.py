"""Files: header-only reads, partitions by size, and writes that are committed or leave the folder as it was."""

import os

import numpy as np
import pytest

from rasterlake import rasters
from rasterlake.sources import datasource, dib


def table(spark, ids, value=7):
    return spark.createDataFrame([(i, 4, 3, bytearray(np.full((3, 4, 4), (value, i % 256, 0, 255), np.uint8).tobytes())) for i in ids], rasters.IMAGES)


def names(path):
    return sorted(os.listdir(path))


def test_headers_are_read_without_pixels(spark, tmp_path):
    out = str(tmp_path / "a")
    dib.save_images(table(spark, [1, 2, 3]), out, "rgb24")
    dib.save_images(table(spark, [4]), out, "bitfields32", "V5")
    core = dib.write(dib.encode(np.zeros((2, 5, 4), np.uint8), "rgb8", "CORE"))
    for name, data in (("core.bmp", core), ("cut.bmp", core[:20]), ("empty.bmp", b""), ("no.bmp", b"BM" + bytes(40))):
        (tmp_path / "a" / name).write_bytes(data)
    sparse = tmp_path / "a" / "large.bmp"
    sparse.write_bytes(dib.write(dib.encode(np.zeros((2, 2, 4), np.uint8), "rgb32"))[:54])
    os.truncate(sparse, 3 << 30)  # 3 GB that nobody may read
    got = {os.path.basename(r.path): r for r in dib.read_headers(spark, out).collect()}
    want = {os.path.basename(r.path): r for r in dib.parse_containers(dib.read_files(spark, out + "/[1-4].bmp")).collect()}
    assert set(want) == {"1.bmp", "2.bmp", "3.bmp", "4.bmp"}
    for name, w in want.items():
        assert all(got[name][c] == w[c] for c in ("variant", "file_size", "pixel_data_offset", "width", "height", "bit_count", "compression"))
    assert (got["core.bmp"].variant, got["core.bmp"].width, got["core.bmp"].height, got["core.bmp"].bit_count, got["core.bmp"].compression) == ("CORE", 5, 2, 8, None)
    assert got["large.bmp"].length == 3 << 30 and got["large.bmp"].width == 2 and got["large.bmp"].error is None
    assert (got["cut.bmp"].error, got["empty.bmp"].error, got["no.bmp"].error) == ("structural:Io", "structural:Io", "structural:UnsupportedStructure")
    by_uri = dib.read_headers(spark, f"file://{out}")
    assert by_uri.count() == len(got)


def test_files_are_dealt_by_size(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "b")
    dib.save_images(table(spark, range(20)), out)
    monkeypatch.setattr(datasource, "FILE_BYTES", 10)
    monkeypatch.setattr(datasource, "PARTITION_BYTES", 450)  # a file has 102 bytes
    parts = datasource._Reader({"path": out}).partitions()
    assert [len(p.value) for p in parts] == [4] * 5
    assert [len(p.value) for p in datasource._Reader({"path": out, "pixels": "false"}).partitions()] == [20]
    (tmp_path / "none").mkdir()
    assert spark.read.format("dib").load(str(tmp_path / "none")).count() == 0


def test_failed_overwrite_leaves_the_old_files(spark, tmp_path):
    from pyspark.sql import functions as F

    out = str(tmp_path / "c")
    dib.save_images(table(spark, [1, 2]), out)
    before = {n: (tmp_path / "c" / n).read_bytes() for n in names(out)}
    broken = dib.encode_images(table(spark, range(1, 40), 9).repartition(4)).select("image_id", "content")
    broken = broken.withColumn("content", F.when(F.col("image_id") == 30, F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        broken.write.format("dib").mode("overwrite").save(out)
    assert {n: (tmp_path / "c" / n).read_bytes() for n in names(out)} == before
    dib.save_images(table(spark, [2, 5], 9), out, mode="overwrite")
    assert names(out) == ["2.bmp", "5.bmp"] and (tmp_path / "c" / "2.bmp").read_bytes() != before["2.bmp"]
    dib.save_images(table(spark, [6]), out)
    assert names(out) == ["2.bmp", "5.bmp", "6.bmp"]
