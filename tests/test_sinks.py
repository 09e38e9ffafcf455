"""O5–O7 sinks: stamps, flattened CSV, JSON/XML, one-file stats."""

import glob
import json

from placeweave.sources import sinks


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame(
        [("Cafe", ["Monday: 9-5", "Tuesday: 9-5"], {"Monday": "9-5"}, "2024-01-02 03:04:05")],
        "name string, hours array<string>, hoursDetail map<string,string>, ts string") \
        .selectExpr("name", "hours", "hoursDetail", "cast(ts as timestamp) as timestamp")
    stamped = sinks.stamp(df.drop("timestamp"), query="cafe", ts="2024-01-02 03:04:05")
    assert stamped.columns[-2:] == ["query", "timestamp"]
    kept = sinks.stamp(df.withColumnRenamed("name", "query"), query="other")
    assert kept.first().query == "Cafe"                     # record fields win over stamps

    sinks.write_businesses(df, str(tmp_path / "csv"), fmt="csv")
    lines = [ln for f in sorted(glob.glob(str(tmp_path / "csv" / "*.csv")))
             for ln in open(f, encoding="utf-8").read().splitlines()]
    assert set(lines) == {"name,hours,hoursDetail,timestamp",
                          'Cafe,Monday: 9-5; Tuesday: 9-5,"{""Monday"":""9-5""}",2024-01-02T03:04:05.000Z'}

    sinks.write_businesses(df, str(tmp_path / "json"), fmt="json")
    row = [json.loads(ln) for f in glob.glob(str(tmp_path / "json" / "*.json"))
           for ln in open(f, encoding="utf-8") if ln.strip()][0]
    assert row["timestamp"] == "2024-01-02T03:04:05.000Z" and row["hours"] == ["Monday: 9-5", "Tuesday: 9-5"]

    sinks.write_businesses(df.select("name"), str(tmp_path / "xml"), fmt="xml")
    back = spark.read.format("xml").option("rowTag", "business").load(str(tmp_path / "xml"))
    assert back.first().name == "Cafe"

    stats = spark.createDataFrame([(3, 7, 1, 2, "67%")], "total_searches long, total_results long, "
                                  "failed_searches long, avg_results_per_search long, success_rate string")
    sinks.write_stats(stats, str(tmp_path / "stats"))
    files = glob.glob(str(tmp_path / "stats" / "*.json"))
    assert len(files) == 1 and json.loads(open(files[0]).readline())["success_rate"] == "67%"


def test_o8_read_loose_pages(spark, tmp_path):
    from placeweave.operators.pages import page_links
    from placeweave.sources.tables import read_pages

    (tmp_path / "a.html").write_text('<html><body><a href="/x">x</a>\n<a href="y">y</a></body></html>')
    (tmp_path / "b.html").write_text("<p>no links</p>")
    pages = read_pages(spark, str(tmp_path), fmt="text")
    rows = {r.url.rsplit("/", 1)[-1]: r for r in pages.collect()}
    assert set(rows) == {"a.html", "b.html"} and "\n" in rows["a.html"].html   # whole file per page
    assert page_links(pages).count() == 2


def test_checkpoint_folder_from_session(spark):
    from placeweave.session import checkpoint_dir, scratch_path

    base = checkpoint_dir(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:                                   # the cluster's setting is used as is
        assert base == configured.rstrip("/")
    assert scratch_path(spark, "x").startswith(base + "/placeweave/x-")
    assert spark.sparkContext.getCheckpointDir() is not None
