"""Labelled cases, ingest requests, model answers: JSON with schemas that are always given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clamp, strip_fence

EXPECTED = "array<struct<file:string,line:int,title_contains:string,stage:string>>"
FINDING = "struct<file:string,line:int,category:string,severity:string,confidence:double,title:string,quoted_code:string>"
CASE = f"name string, track string, about string, diff string, head_sources map<string,string>, base_sources map<string,string>, expected_findings {EXPECTED}, expect_gated {EXPECTED}, recorded struct<review:struct<findings:array<{FINDING}>>,skeptic:string>"
ENTRY = "struct<fingerprint:string,file:string,line:int,category:string,severity:string,confidence:double,title:string,quoted_code:string,proof:string,dropped_at:string,reason:string>"
INGEST = f"platform string, repo string, pr_number string, base_sha string, head_sha string, started_at timestamp, finished_at timestamp, outcome struct<findings:array<{ENTRY}>,dropped:array<{ENTRY}>,review_incomplete:boolean,estimated_cost_usd:double>, feedback array<struct<fingerprint:string,kind:string,source:string,count:int>>"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of one file or a folder with ord by file name."""
    made = spark.read.schema(CASE).option("multiLine", True).json(path).withColumn("file", F.col("_metadata.file_name"))
    return made.orderBy("file")


def keywords(title_contains: Column) -> Column:
    """A string, or a JSON array of strings, as lower-cased words without empty ones."""
    listed = F.from_json(title_contains, "array<string>")
    many = F.when(F.trim(title_contains).startswith("["), listed).otherwise(F.array(title_contains))
    return F.filter(F.transform(F.coalesce(many, F.array().cast("array<string>")), lambda x: F.lower(x)), lambda x: x.isNotNull() & (x != ""))


def recorded_answers(skeptic: Column) -> Column:
    """A recorded answer, or a list of (match, response), as array<struct<match, response>>."""
    listed = F.from_json(skeptic, "array<struct<match:string,response:string>>")
    return F.when(F.trim(skeptic).startswith("["), listed).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("match"), skeptic.alias("response"))))


def replay(answers: Column, prompt: Column) -> Column:
    """The response of the first entry whose match is a part of the prompt, else of the last entry without one."""
    hit = F.filter(answers, lambda a: a["match"].isNotNull() & prompt.contains(a["match"]))
    rest = F.filter(answers, lambda a: a["match"].isNull())
    return F.when(F.size(hit) > 0, F.get(hit, F.lit(0))["response"]).otherwise(F.get(rest, F.size(rest) - 1)["response"])


def parse_findings(answer: Column) -> Column:
    """Findings of a model's JSON answer; malformed items are left out, confidence is clamped, severity lowered."""
    loose = "struct<findings:array<struct<file:string,line:string,category:string,severity:string,confidence:string,title:string,quoted_code:string>>>"
    items = F.from_json(strip_fence(answer), loose)["findings"]
    made = F.transform(
        items,
        lambda f: F.struct(
            f["file"].alias("file"), f["line"].try_cast("int").alias("line"), F.coalesce(f["category"], F.lit("")).alias("category"), F.lower(f["severity"]).alias("severity"),
            clamp(f["confidence"].try_cast("double")).alias("confidence"), f["title"].alias("title"), F.coalesce(f["quoted_code"], F.lit("")).alias("quoted_code"),
        ),
    )
    whole = lambda f: f["file"].isNotNull() & f["line"].isNotNull() & f["confidence"].isNotNull() & f["title"].isNotNull() & f["severity"].isin("critical", "high", "medium", "low")
    return F.coalesce(F.filter(made, whole), F.array().cast(f"array<{FINDING}>"))


def parse_verdict(answer: Column) -> Column:
    """is_real, is_actionable, confidence, reason of a verifier's answer; what is missing is false, 0, ''."""
    got = F.from_json(strip_fence(answer), "struct<is_real:boolean,is_actionable:boolean,confidence:double,reason:string>")
    return F.struct(
        F.coalesce(got["is_real"], F.lit(False)).alias("is_real"), F.coalesce(got["is_actionable"], F.lit(False)).alias("is_actionable"),
        clamp(F.coalesce(got["confidence"], F.lit(0.0))).alias("confidence"), F.coalesce(got["reason"], F.lit("")).alias("reason"),
    )


def read_ingest(spark: SparkSession, path: str) -> DataFrame:
    """Ingest requests, one JSON object a line; lines that aren't JSON give no row."""
    return spark.read.schema(INGEST).option("mode", "DROPMALFORMED").json(path)


def ingest_findings(requests: DataFrame) -> DataFrame:
    """Posted and dropped findings of requests as one relation with a flag."""
    key = ["platform", "repo", "pr_number", "head_sha"]
    posted = requests.select(*key, F.lit(True).alias("posted"), F.posexplode("outcome.findings").alias("ord", "f"))
    dropped = requests.select(*key, F.lit(False).alias("posted"), F.posexplode("outcome.dropped").alias("ord", "f"))
    return posted.unionByName(dropped).select(*key, "posted", "ord", "f.*")
