"""Pages reach Python in short Arrow batches."""

from pyspark.sql import functions as F

from sitelore.operators.extract import extract_pages

ARROW = "spark.sql.execution.arrow."


def page_rows(spark):
    html = F.format_string(
        "<title>Page %1$d</title><h1>Head %1$d</h1><p>one two three %1$d</p><details><summary>Why %1$d?</summary><p>So.</p></details>"
        "<a href='https://www.instagram.com/p%1$d'>In</a>", "id",
    )
    return spark.range(4).select(
        F.col("id").alias("page_ord"), F.lit("s").alias("website_id"), F.lit("https://a.example").alias("website_url"),
        F.concat(F.lit("https://a.example/"), "id").alias("page_url"), html.alias("html"),
    )


def test_extraction_shortens_arrow_batches(spark):
    before = {k: spark.conf.get(ARROW + k) for k in ("maxRecordsPerBatch", "maxBytesPerBatch")}
    try:
        spark.conf.set(ARROW + "maxRecordsPerBatch", "10000")
        spark.conf.set(ARROW + "maxBytesPerBatch", str(64 << 20))
        assert extract_pages(page_rows(spark)).count() == 4
        assert int(spark.conf.get(ARROW + "maxRecordsPerBatch")) == 1000
        assert int(spark.conf.get(ARROW + "maxBytesPerBatch")) == 4 << 20
    finally:
        for k, v in before.items():
            spark.conf.set(ARROW + k, v)
