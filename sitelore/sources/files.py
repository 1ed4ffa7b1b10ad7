"""File formats of the jobs: knowledge JSON, question banks, results, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelore import fixed
from sitelore.functions import urls
from sitelore.operators.knowledge import upgrade_knowledge
from sitelore.schemas import KNOWLEDGE, QUESTION


# --- readers ----------------------------------------------------------------
def read_knowledge(spark: SparkSession, path: str, fallback_url: str = "") -> DataFrame:
    """Knowledge JSON documents of any age, completed. Malformed JSON fails the read."""
    docs = spark.read.schema(KNOWLEDGE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return upgrade_knowledge(docs, fallback_url)


def read_questions(
    spark: SparkSession, path: str, category: str | None = None, limit: int | None = None
) -> DataFrame:
    """Question bank, optionally one category, optionally the first `limit` questions."""
    bank = spark.read.schema(QUESTION).option("multiLine", True).json(path)
    bank = bank.withColumn("position", F.monotonically_increasing_id())
    if category:
        bank = bank.where(F.col("category") == category)
    if limit is not None:
        bank = bank.orderBy("position").limit(max(0, int(limit)))
    return bank


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation results from `.csv` or `.jsonl`."""
    lower = path.lower()
    if lower.endswith(".jsonl"):
        return spark.read.json(path)
    if lower.endswith(".csv"):
        return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raise ValueError("Only .csv and .jsonl evaluation result files are supported")


def find_cached(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Which stored document answers each requested URL: the normalised name, else the
    legacy name, else null. `catalog` lists file names in column `name`."""
    wanted = requests.withColumns(
        {
            "primary_name": urls.cache_name(urls.cache_url(F.col("url"))),
            "legacy_name": urls.legacy_cache_name(F.col("url")),
        }
    )
    names = catalog.select("name").distinct()
    first = names.select(F.col("name").alias("primary_name"), F.col("name").alias("_primary"))
    second = names.select(F.col("name").alias("legacy_name"), F.col("name").alias("_legacy"))
    return (
        wanted.join(first, "primary_name", "left")
        .join(second, "legacy_name", "left")
        .withColumn("cached_name", F.coalesce("_primary", "_legacy"))
        .drop("_primary", "_legacy")
    )


# --- writers ----------------------------------------------------------------
def write_knowledge(docs: DataFrame, path: str) -> None:
    """Knowledge documents as JSON lines; `cache_name` names each site's document."""
    named = docs.withColumn("cache_name", urls.cache_name(F.col("metadata.normalized_url")))
    named.write.mode("overwrite").json(path)


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def chat_log(answers: DataFrame) -> DataFrame:
    """Log rows of answered questions."""
    have = answers.columns
    return answers.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
        "question", "answer", "provenance",
        (F.col("user") if "user" in have else F.lit(None).cast("string")).alias("user"),
    )


def job_log(jobs: DataFrame) -> DataFrame:
    """Log rows of finished jobs; absent or unreadable numbers count as zero."""
    have = jobs.columns

    def number(name: str, kind: str):
        value = F.col(name).cast("string").try_cast(kind) if name in have else F.lit(None).cast(kind)
        return F.coalesce(value, F.lit(0).cast(kind)).alias(name)

    hit = F.coalesce(F.col("cache_hit"), F.lit(False)) if "cache_hit" in have else F.lit(False)
    return jobs.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
        "url", hit.alias("cache_hit"), number("tcr_seconds", "double"), number("searches_run", "int"),
        number("pages_scraped", "int"), number("gaps_found", "int"),
        (F.col("user_id") if "user_id" in have else F.lit(None).cast("string")).alias("user_id"),
    )


def csv_rows(results: DataFrame) -> DataFrame:
    """Evaluation records as the fixed CSV columns; lists joined by '; '."""

    def of_sources(field: str):
        values = F.filter(F.transform("sources", lambda s: s[field]), lambda v: F.coalesce(v, F.lit("")) != "")
        return F.coalesce(F.array_join(values, "; "), F.lit(""))

    special = {
        "expected_entities": F.coalesce(F.array_join("expected_entities", "; "), F.lit("")),
        "source_titles": of_sources("page_title"),
        "source_urls": of_sources("source_url"),
        "source_types": of_sources("chunk_type"),
        "warnings": F.coalesce(F.array_join("warnings", "; "), F.lit("")),
        "flags": F.array_join("flags", "; "),
    }
    return results.select(
        *[special.get(name, F.col(name)).alias(name) for name in fixed.RESULT_CSV_FIELDS]
    )


def write_results(results: DataFrame, prefix: str) -> dict[str, str]:
    """JSON lines (sorted keys), CSV and Markdown sections under `prefix`."""
    from sitelore.operators.evaluate import markdown_report

    paths = {kind: f"{prefix}.{kind}" for kind in ("jsonl", "csv", "md")}
    results.select(*sorted(results.columns)).write.mode("overwrite").json(paths["jsonl"])
    csv_rows(results).write.mode("overwrite").option("header", True).option("escape", '"').csv(paths["csv"])
    report = markdown_report(results).repartitionByRange("category", "question_id")
    report.sortWithinPartitions("category", "question_id").select("section").write.mode("overwrite").text(
        paths["md"]
    )
    return paths
