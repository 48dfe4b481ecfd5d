import pytest
from pyspark.sql import functions as F

from tallyline.sources import FEEDS, export_csv, export_schema, ingest, read_feed, read_file

REVIEWS = (
    "review_id,order_id,review_score,review_comment_title,review_comment_message,"
    "review_creation_date,review_answer_timestamp\n"
    '"r1","o1",5,,"two\nlines, a comma and ""quotes""",2018-01-01 00:00:00,2018-01-02 00:00:00\n'
    "r2,o2,abc,,,2018-01-01 00:00:00,\n"
)
SELLERS = "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,01037,sao paulo,SP\n"


@pytest.fixture
def csv_dir(tmp_path):
    (tmp_path / "reviews.csv").write_text(REVIEWS)
    (tmp_path / "sellers.csv").write_text(SELLERS)
    return tmp_path


def test_ingest(spark, csv_dir, tmp_path):
    out = str(tmp_path / "out")
    feeds = {
        "olist_order_reviews": str(csv_dir / "reviews.csv"),
        "olist_sellers": str(csv_dir / "sellers.csv"),
    }
    assert ingest(spark, feeds, out) == {"olist_order_reviews": 2, "olist_sellers": 1}
    assert ingest(spark, feeds, out)["olist_order_reviews"] == 2  # replaced, not appended
    reviews = {r.review_id: r for r in read_feed(spark, out, "olist_order_reviews").collect()}
    assert reviews["r1"].review_comment_message == 'two\nlines, a comma and "quotes"'
    assert reviews["r2"].review_score == "abc" and reviews["r2"].review_comment_message is None
    assert read_feed(spark, out, "olist_sellers").first().seller_zip_code_prefix == "01037"


def test_ingest_stops_at_the_first_failure(spark, csv_dir, tmp_path):
    bad = csv_dir / "bad.csv"
    bad.write_text("seller_id,seller_zip_code_prefix,seller_city,seller_state\na,b\n")
    with pytest.raises(Exception):
        ingest(spark, {"olist_sellers": str(bad)}, str(tmp_path / "out"))
    with pytest.raises(Exception):
        ingest(spark, {"olist_sellers": str(csv_dir / "none.csv")}, str(tmp_path / "out"))
    with pytest.raises(KeyError):
        ingest(spark, {"no_such_feed": str(bad)}, str(tmp_path / "out"))


def test_ingest_rejects_other_columns(spark, csv_dir, tmp_path):
    other = csv_dir / "other.csv"
    other.write_text("a,b,c,d\n1,2,3,4\n")
    with pytest.raises(Exception):
        ingest(spark, {"olist_sellers": str(other)}, str(tmp_path / "out"))


def test_read_feed_checks_columns(spark, tmp_path):
    spark.range(1).write.parquet(str(tmp_path / "olist_sellers.parquet"))
    with pytest.raises(ValueError, match="lacks columns"):
        read_feed(spark, str(tmp_path), "olist_sellers")
    with pytest.raises(KeyError):
        read_feed(spark, str(tmp_path), "sellers")


def test_read_file(spark, csv_dir, tmp_path):
    assert read_file(spark, str(csv_dir / "sellers.csv")).first().seller_city == "sao paulo"
    (tmp_path / "rows.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert read_file(spark, str(tmp_path / "rows.json"), schema="a int").count() == 2
    spark.range(3).write.parquet(str(tmp_path / "r.parquet"))
    assert read_file(spark, str(tmp_path / "r.parquet")).count() == 3
    with pytest.raises(ValueError):
        read_file(spark, "x.orc")


def test_export_csv_goes_on_after_a_failure(spark, tmp_path):
    good = spark.createDataFrame([(1, 'say "hi",\nthen go'), (2, None)], "id int, note string")
    bad = spark.sql("SELECT raise_error('broken') AS x")
    status = export_csv(spark, {"a": good, "b": bad, "c": good}, str(tmp_path))
    got = {r.table: (r.rows, r.status) for r in status.collect()}
    assert got == {"a": (2, "ok"), "b": (None, "failed"), "c": (2, "ok")}
    back = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", True)
        .csv(str(tmp_path / "a.csv"))
    )
    assert {r.id: r.note for r in back.collect()} == {"1": 'say "hi",\nthen go', "2": None}


def test_export_schema(spark, tmp_path):
    assert export_schema(spark, "no_such_db", str(tmp_path)).count() == 0
    spark.sql("CREATE DATABASE IF NOT EXISTS some_marts")
    assert export_schema(spark, "some_marts", str(tmp_path)).count() == 0
    spark.range(4).write.mode("overwrite").saveAsTable("some_marts.four")
    got = [(r.table, r.rows) for r in export_schema(spark, "some_marts", str(tmp_path)).collect()]
    assert got == [("four", 4)]


def test_every_feed_has_a_staging_table():
    from tallyline.plans import STAGING

    assert {s.feed for s in STAGING.values()} == set(FEEDS)
    for s in STAGING.values():
        assert list(s.columns) == FEEDS[s.feed].columns


def test_export_of_empty_tables(spark, tmp_path):
    empty = {
        "constant": spark.sql("SELECT 1 AS a WHERE false"),
        "filtered": spark.range(5).filter("id > 9"),
        "joined": spark.range(5).join(spark.range(9, 12), "id").groupBy("id").count(),
    }
    got = {r.table: (r.rows, r.status) for r in export_csv(spark, empty, str(tmp_path)).collect()}
    assert got == {name: (0, "ok") for name in empty}


def test_read_csv_file_with_line_breaks(spark, csv_dir):
    got = {r.review_id: r for r in read_file(spark, str(csv_dir / "reviews.csv")).collect()}
    assert got["r1"].review_comment_message == 'two\nlines, a comma and "quotes"' and len(got) == 2


def test_export_keeps_values(spark, tmp_path):
    values = [12345678.9, 1e7, 1e-4, -2.5e9, 1.5, 1e300, float("nan"), None]
    texts = ["  padded  ", 'a "quote"', "two\nlines", "", None, ",", "x", "y"]
    df = spark.createDataFrame(list(zip(texts, values)), "s string, v double").withColumn(
        "t", F.lit("2018-01-02 03:04:05").cast("timestamp_ntz")
    )
    export_csv(spark, {"a": df}, str(tmp_path))
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
    back = reader.csv(str(tmp_path / "a.csv"), schema="s string, v string, t string").collect()
    want = ["12345678.9", "10000000.0", "0.0001", "-2500000000.0", "1.5", "1.0E300", "NaN", None]
    # Spark reads an empty text as NULL; the file tells the two apart
    got = {r.v: r.s for r in back}
    assert got == {v: s or None for s, v in zip(texts, want)}
    lines = "".join(f.read_text() for f in (tmp_path / "a.csv").glob("part-*")).splitlines()
    assert any(line.startswith('"",-2500000000.0,') for line in lines)
    assert any(line.startswith(",1.5,") for line in lines)
    assert {r.t for r in back} == {"2018-01-02 03:04:05"}


def test_failed_ingest_keeps_the_old_table(spark, csv_dir, tmp_path):
    out = str(tmp_path / "out")
    ingest(spark, {"olist_sellers": str(csv_dir / "sellers.csv")}, out)
    (csv_dir / "bad.csv").write_text(SELLERS.splitlines()[0] + "\na,b\n")
    with pytest.raises(Exception):
        ingest(spark, {"olist_sellers": str(csv_dir / "bad.csv")}, out)
    assert read_feed(spark, out, "olist_sellers").first().seller_id == "s1"


def test_export_in_gzip(spark, tmp_path):
    import gzip

    df = spark.createDataFrame([(1, 'say "hi",\nthen go'), (2, None), (3, " x ")], "id int, note string")
    status = export_csv(spark, {"a": df.coalesce(1)}, str(tmp_path), compression="gzip")
    export_csv(spark, {"b": df.coalesce(1)}, str(tmp_path))
    assert [(r.rows, r.status) for r in status.collect()] == [(3, "ok")]
    (packed,), (plain,) = tmp_path.glob("a.csv/*.csv.gz"), tmp_path.glob("b.csv/*.csv")
    assert gzip.decompress(packed.read_bytes()) == plain.read_bytes()


def test_gzip_is_written_at_its_fastest(spark, tmp_path, monkeypatch):
    import gzip
    import zlib

    rows = "".join(f"{i % 977},{i % 31 * 7919}\n" for i in range(60_000))
    text = spark.createDataFrame([tuple(map(int, r.split(","))) for r in rows.split()], "a int, b int")
    export_csv(spark, {"a": text.coalesce(1)}, str(tmp_path), compression="gzip")
    (packed,) = tmp_path.glob("a.csv/*.csv.gz")
    assert gzip.decompress(packed.read_bytes()).decode() == "a,b\n" + rows
    fast, usual = (len(zlib.compress(f"a,b\n{rows}".encode(), level)) for level in (1, 6))
    assert abs(packed.stat().st_size - fast) < abs(packed.stat().st_size - usual)
