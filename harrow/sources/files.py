"""State files. Reading fails on broken lines instead of taking history for empty, which would notify everything again."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow import schemas
from harrow.config import Config, sources


#: Folders of documents.
BUCKETS = 256


def load_urls(spark: SparkSession, path: str) -> DataFrame:
    """(url) of a JSON array of strings, each once."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "array<string>", {"mode": "FAILFAST"})).alias("url")).dropDuplicates()


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def load_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Jobs of an NDJSON file; the order column, if the file has one, is `seq`."""
    return _lines(spark, path, f"{schemas.JOB}, seq bigint")


def load_opportunities(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path, f"{schemas.OPPORTUNITY}, seq bigint")


def load_companies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.COMPANY).json(path, multiLine=True, mode="FAILFAST")


def load_document(spark: SparkSession, folder: str, ident: int) -> DataFrame:
    """(kind, id, text) of a document that save_documents wrote; one bucket is read."""
    docs = spark.read.parquet(folder)
    return docs.where((F.col("bucket") == int(ident) % BUCKETS) & (F.col("id") == int(ident))).select("kind", "id", "text")


def load_document_file(spark: SparkSession, folder: str, ident: int) -> DataFrame:
    """A document that lies in a file of its own."""
    return spark.read.text(f"{folder}/{int(ident)}.txt", wholetext=True).withColumnRenamed("value", "text")


def load_payload(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def load_landed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LANDED).json(path)


def load_config(path: str) -> Config:
    return Config.of(json.loads(Path(path).read_text()))


def source_table(spark: SparkSession, config: Config) -> DataFrame:
    """The registry of community lists; those whose category isn't a target are disabled."""
    return spark.createDataFrame([tuple(s.values()) for s in sources(config)], schemas.SOURCE)


def one_job(spark: SparkSession, company: str, role: str, link: str, location: str) -> DataFrame:
    return spark.createDataFrame([(None, company, role, link, location, None)], schemas.JOB)


def issue_field(body: Column, label: str, required: bool = False) -> Column:
    """The text under a '### label' heading, without comments; '_No response_' is none. A required one that is missing raises."""
    found = F.regexp_extract(body, rf"(?s)(?:\A|\n)###\s+{re.escape(label)}\s*\n(.*?)(?=\n###\s|\z)", 1)
    found = F.trim(F.regexp_replace(F.regexp_replace(found, r"(?s)<!--.*?-->", ""), r"\A\s+|\s+\z", ""))
    found = F.when(~found.isin("", "_No response_"), found)
    return F.coalesce(found, F.raise_error(F.lit(f"missing field: {label}")).cast("string")) if required else found


def submitted_jobs(issues: DataFrame, body: str = "body") -> DataFrame:
    """One job of each issue form; valid says whether the link is a web address and no field is blank."""
    f = {k: issue_field(F.col(body), label) for k, label in (("company", "Company"), ("role", "Role"), ("link", "Link"), ("location", "Location"))}
    out = issues.select(*(c.alias(k) for k, c in f.items()))
    ok = F.lit(True)
    for k in f:
        ok = ok & F.col(k).isNotNull()
    return out.withColumn("valid", F.coalesce(ok & F.col("link").rlike(r"\Ahttps?://[^\s/]+"), F.lit(False)))


# writers


def save_urls(urls: DataFrame, path: str) -> None:
    """A sorted JSON array, a URL a line, which load_urls reads. The set is sorted by tasks; one file, so one task writes it. Nulls are left out."""
    each = urls.select("url").where("url is not null").distinct()
    first = each.agg(F.min("url")).first()[0]
    text = F.expr("substring(to_json(array(url)), 2, length(to_json(array(url))) - 2)")
    lines = each.orderBy("url").select(F.concat(F.when(F.col("url") == first, "[").otherwise(","), text).alias("value"))
    end = each.sparkSession.range(1, numPartitions=1).select(F.lit("[]" if first is None else "]").alias("value"))
    lines.union(end).coalesce(1).write.mode("overwrite").text(path)


def append_jobs(jobs: DataFrame, path: str) -> None:
    jobs.write.mode("append").json(path)


def save_documents(docs: DataFrame, path: str) -> None:
    """(id, text), whether JSON or plain text, in BUCKETS folders by id, which load_document reads."""
    kind = F.when(F.try_parse_json("text").isNotNull(), "json").otherwise("txt")
    rows = docs.select(F.pmod("id", F.lit(BUCKETS)).cast("int").alias("bucket"), kind.alias("kind"), F.col("id").cast("long").alias("id"), "text")
    rows.write.mode("append").partitionBy("bucket").parquet(path)


def save_companies(companies: DataFrame, path: str) -> None:
    companies.orderBy(F.collate(F.col("name"), "UNICODE")).write.mode("overwrite").json(path)


def append_errors(errors: DataFrame, path: str) -> None:
    errors.write.mode("append").json(path)


def save_config(config: dict, path: str) -> None:
    """A checked configuration as JSON; a wrong one raises and leaves the file as it is."""
    Config.of(config)
    save_text(json.dumps(config, indent=2) + "\n", path)


def save_text(text: str, path: str) -> None:
    """A small rendered file, whole or not at all."""
    part = f"{path}.part"
    Path(part).write_text(text)
    os.replace(part, path)
