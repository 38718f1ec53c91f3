from pyspark.sql import functions as F

from granary.sources import files


def test_byte_windows(spark):
    text = "a\u00e9" * 400_000  # 1,200,000 bytes
    cases = [
        ("bytes=0-1", text, 206, 0, 1), ("bytes=1-", text, 206, 1, 1 << 20), ("bytes=-3", text, 206, 0, 3), ("-", "abc", 206, 0, 2),
        ("bytes=3-", "abc", 416, None, None), ("bytes=0-3", "abc", 416, None, None), ("bytes=2-1", "abc", 416, None, None), ("bytes=-", "", 416, None, None),
        (None, "abc", 200, None, None), ("", "abc", 200, None, None), ("bytes=x", "abc", 400, None, None), ("bytes=0-1", None, None, None, None), (None, None, None, None, None),
    ]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, header string, text string")
    got = df.select("i", files.byte_window(F.encode("text", "UTF-8"), F.col("header")).alias("w")).orderBy("i").collect()
    for (header, t, status, first, last), r in zip(cases, got, strict=True):
        assert (r.w.status, r.w.start, r.w.last) == (status, first, last), header
        raw = t and t.encode()
        assert r.w.part == (bytearray(raw[first : last + 1]) if status == 206 else bytearray(raw) if status == 200 else None)
