from knownat.sources import ingest as ing


def test_long_addresses_hosts_and_titles_stay_whole(spark):
    host, title = "h" * 260 + ".example", "제목 " * 300
    url = f"https://{host}/" + "p" * 1500
    items = spark.createDataFrame([(url, "", title, "Tue, 02 Jan 2024 03:04:05 +0900")], "originallink string, link string, title string, pub_date string")
    row = ing.news_rows(items).first()
    assert row["url"] == url and row["publisher_host"] == host and row["title"] == title.strip()
