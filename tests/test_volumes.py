"""Files of pages: a part is cut into files of bounded size, in many tasks, and its pages are whole and numbered through."""

import re
import sys

from pyspark.sql import functions as F

from granary import session as S
from granary.catalog import records
from granary.sources import files


def _plain(rows):
    out, at = [], {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        part = None if i is None else i % 16 if i >= 0 else -(-i % 16)
        page = None if text is None else "\n".join(x for x in text.split("\n") if not re.match(r"\s*Page\s+\d+\s+of\s+\d+", x))
        out.append((part, at.get(part, 0), page))
        at[part] = at.get(part, 0) + 1
    return sorted(out, key=repr)


def _documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def _written(monkeypatch):
    paths, make = [], files.shared_path
    monkeypatch.setattr(files, "shared_path", lambda *a: paths.append(make(*a)) or paths[-1])
    return paths


def test_a_large_part_is_many_files_of_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "VOLUME_BYTES", 2000, raising=False)
    paths = _written(monkeypatch)
    rows = [(16 * i, f"page {i} " * (i % 40)) for i in range(400)] + [(3, "long " * 1000), (19, "after"), (35, "after that")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else this little is one task
    try:
        got = records.scan_pdf(spark, _documents(spark, tmp_path, rows))
        assert sorted(map(tuple, got.collect()), key=repr) == _plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    made = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(paths[0]).select("path", "length").collect()
    assert sum(r.length > 2000 for r in made) == 1 and len(made) > 20  # the long page is a file of its own
    assert len({re.search(r"part-(\d+)", r.path)[1] for r in made if "part=0/" in r.path}) > 1


def test_pages_of_any_text_and_key(spark, tmp_path):
    rows = [(1, "a\f\nb\f"), (17, "\f\f\n\f"), (33, ""), (49, None), (65, "Page 3 of 4"), (81, "x\r\ny\n"), (2, None), (-3, "minus"), (-19, "minus too"), (None, "no key"), (5, "é\U0001f600")]
    got = records.scan_pdf(spark, _documents(spark, tmp_path, rows))
    assert dict(got.dtypes) == {"part": "bigint", "page_no": "bigint", "page": "string"}
    assert sorted(map(tuple, got.collect()), key=repr) == _plain(rows)


def test_no_pages(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert records.scan_pdf(spark, str(tmp_path)).collect() == []


def test_a_worker_has_few_files_at_once(spark, tmp_path):
    before = {k: spark.conf.get(k) for k in S.BATCH}
    for k, v in {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": "64m", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}.items():
        spark.conf.set(k, v)
    for i in range(6):
        (tmp_path / f"{i}.txt").write_bytes(b"x" * (1 << 21))
    try:
        rows = files.read_pages(spark, f"file://{tmp_path}", lambda data: [str(sys._getframe(1).f_locals["b"].num_rows)]).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"):
            spark.conf.unset(k)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == 6 and len({r.task for r in rows}) == 1
    assert {r.content for r in rows} == {"1"}  # a batch for each file
