import pytest
from pyspark.sql import functions as F

from corpusloom.functions import images as I


def jpeg(width, height, marker=0xC0, extra=b"\xff\xe0\x00\x06abcd"):
    return b"\xff\xd8" + extra + bytes([0xFF, marker, 0, 11, 8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x01\x01\x11\x00"


def test_jpeg_size(spark):
    rows = [jpeg(640, 480), jpeg(1, 65535, 0xC2), jpeg(5, 6, 0xC1, b"\xff\xff\xff\xd0"), b"png", b"", None, b"\xff\xd8\xff\xe0\x00\x10", b"\xff\xd8\xff\xc0\x00"]
    got = spark.createDataFrame([(i, bytearray(x) if x is not None else None) for i, x in enumerate(rows)], "i int, x binary").select("i", I.jpeg_size("x").alias("s")).orderBy("i").collect()
    assert [(r.s.width, r.s.height) for r in got] == [(640, 480), (1, 65535), (5, 6)] + [(None, None)] * 5


def test_scaled_width(spark):
    rows = [(100, 64), (10, 3200), (9000, 32), (None, 5), (5, 0)]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, w int, h int").select("i", I.scaled_width(F.col("w"), F.col("h"))).orderBy("i").collect()
    assert [r[1] for r in got] == [50, 1, 320, 160, 160]


def test_regions(spark):
    for frames, regions in ((10, 3), (7, 7), (3, 5)):
        bounds = spark.range(1).select(I.region_bounds(F.lit(frames), regions).alias("b")).first().b
        assert [(b.first, b.end) for b in bounds] == [(u * frames // regions, max((u + 1) * frames // regions, u * frames // regions + 1)) for u in range(regions)]
    got = [r[0] for r in spark.range(10).orderBy("id").select(I.region(F.col("id"), F.lit(10), 3)).collect()]
    assert got == [next(u for u in range(3) if u * 10 // 3 <= f < (u + 1) * 10 // 3) for f in range(10)]


def test_budget():
    assert I.budget((100, 30), (200, 50), 100) == 425
    with pytest.raises(ValueError):
        I.budget((100, 30), (200, 30), 100)


def test_ink_pixels(spark):
    rows = [([255.0] * 5 + [0.0] * 3 + [255.0], 3), ([10.0, 40.0], 2), ([10.0, 41.0, 10.0, 10.0], 2), ([], 0), ([5.0], 1)]
    got = spark.createDataFrame(rows, "g array<double>, w int").select(I.ink_pixels(F.col("g"), F.col("w")).alias("n")).collect()
    assert [r.n for r in got] == [3, 0, 1, 0, 0]
