"""The landed feed as a data source, and collection with a bounded state."""

import glob
import json
import os

import pytest

from changelens.sources import landed_feed
from changelens.streaming import collect_stream


def land(folder, pages):
    os.makedirs(folder, exist_ok=True)
    for (q, p), body in pages.items():
        with open(f"{folder}/{q}-{p}.json", "wb") as f:
            f.write(body if isinstance(body, bytes) else body.encode())


def item(k):
    return {"법령ID": str(k), "법령명한글": f"법 {k}", "공포일자": "20260101"}


def answer(law):
    return json.dumps({"LawSearch": {"law": law}}, ensure_ascii=False)


@pytest.fixture
def folder(tmp_path):
    at = f"{tmp_path}/feed"
    land(at, {(0, 1): answer([item(1), item(2)]), (0, 2): answer(item(3)), (1, 1): "<html>busy</html>", (1, 2): "", (1, 3): '{"LawSearch": ', (2, 1): b"\xff\xfe", (2, 2): answer([])})
    open(f"{at}/notes.txt", "w").close()
    return at


def test_items_and_bad_pages(spark, folder):
    items, bad = landed_feed.feed(spark, folder, pages=2)
    assert [r.law_id for r in items.orderBy("ord").collect()] == ["1", "2", "3"]
    assert {(r.query_ord, r.page): r.error for r in bad.collect()} == {(1, 1): "a page of markup", (1, 2): "empty", (1, 3): "not JSON", (2, 1): "not UTF-8"}


def test_conditions_open_no_other_page(spark, folder):
    """What is ruled out isn't opened: the pages are directories, which can't be read."""
    landed_feed.register(spark)
    for p in (7, 8):
        os.makedirs(f"{folder}/5-{p}.json")
    df = spark.read.format("landed_feed").load(folder)
    assert df.where("query_ord = 0 AND page = 2").count() == 1
    assert df.where("query_ord < 5 AND page IN (1, 3)").count() == 4
    with pytest.raises(Exception, match="5-7|irectory"):
        df.where("query_ord = 5").count()


def test_reader_partitions(folder):
    r = landed_feed.FeedReader(folder, 3)
    assert [len(p.names) for p in r.partitions()] == [3, 3, 1]
    assert len(landed_feed.FeedReader(f"file://{folder}", 100).partitions()) == 1


def test_empty_folder(spark, tmp_path):
    os.makedirs(f"{tmp_path}/none")
    landed_feed.register(spark)
    assert spark.read.format("landed_feed").load(f"{tmp_path}/none").count() == 0


# ------------------------------------------------------------------------------------------ streams
def row(i, d, o):
    return i, "n", d, d, "law", "tax", o


def test_redelivery_and_restart(spark, tmp_path, monkeypatch):
    """Items come again within what is remembered, after it, and after a crash between the write and the checkpoint."""
    land_, table, mark = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/mark"
    deliver = lambda *rows: spark.createDataFrame(list(rows), collect_stream.ITEMS).write.mode("append").json(land_)
    run = lambda **kw: collect_stream.collect(spark, land_, table, mark, **kw).awaitTermination()
    got = lambda: sorted((r.law_id, r.promulgation_date, r.ord) for r in spark.read.parquet(table).collect())
    deliver(row("a", "20260101", 2), row("a", "20260101", 1), row("b", "20260201", 3), row("c", None, 4))
    run()
    assert got() == [("a", "20260101", 1), ("b", "20260201", 3), ("c", None, 4)]
    before = sorted(glob.glob(f"{table}/**/*.parquet", recursive=True))

    def broken(new):
        raise RuntimeError("killed")

    deliver(row("a", "20260101", 5), row("d", "20260301", 6))
    with pytest.raises(Exception):
        run(detail=broken)
    assert sorted(glob.glob(f"{table}/**/*.parquet", recursive=True)) == before
    run()
    assert got() == [("a", "20260101", 1), ("b", "20260201", 3), ("c", None, 4), ("d", "20260301", 6)]
    # a state that has forgotten: a new checkpoint sees all deliveries again, and the months already hold them
    collect_stream.collect(spark, land_, table, f"{tmp_path}/mark2").awaitTermination()
    assert len(got()) == 4


def test_a_batch_reads_its_own_months_alone(spark, tmp_path):
    land_, table = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([row("a", "20260101", 1)], collect_stream.ITEMS).write.json(land_)
    collect_stream.collect(spark, land_, table, f"{tmp_path}/mark").awaitTermination()
    for f in glob.glob(f"{table}/month=202601/**/*.parquet", recursive=True):  # history that can't be read any more
        with open(f, "wb") as out:
            out.write(b"x")
    spark.createDataFrame([row("b", "20260201", 2)], collect_stream.ITEMS).write.mode("append").json(land_)
    collect_stream.collect(spark, land_, table, f"{tmp_path}/mark").awaitTermination()
    assert [r.law_id for r in spark.read.parquet(f"{table}/month=202602").collect()] == ["b"]
