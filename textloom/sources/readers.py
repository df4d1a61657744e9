"""Sources: file trees, findings, rules, audit logs, compile databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as px

MAX_FILE_BYTES = 200_000


def walk_files(spark: SparkSession, root: str, ignore: list[str] | None = None, keep_vcs: bool = False) -> DataFrame:
    """``path, size, content`` of all files below ``root``, version control and ignored ones left out."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.split(":", 1)[-1].strip("/")
    below = F.regexp_replace("path", rf"^[a-z]*:?/*\Q{base}\E/", "")
    df = df.select(below.alias("path"), F.col("length").alias("size"), "content")
    if not keep_vcs:
        df = df.where(~px.is_vcs(F.col("path")))
    if ignore:
        df = df.where(~F.col("path").rlike(px.glob_regex(ignore)))
    return df


def load_text(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Adds ``language, sha256, loc, text``; text is null for what isn't UTF-8, isn't read (too large), or isn't code or markup."""
    lang = px.detect_language(F.col("path"))
    readable = (F.col("size") <= max_bytes) & F.expr("is_valid_utf8(CAST(content AS STRING))")
    text = F.when(readable, F.col("content").cast("string"))
    loc = F.when(F.length("text") == 0, 0).otherwise(F.size(F.split("text", "\n")) - F.when(F.col("text").endswith("\n"), 1).otherwise(0))
    return files.withColumns({"language": lang, "sha256": F.sha2("content", 256), "text": text}).withColumn("loc", F.coalesce(loc, F.lit(0)).cast("int")).drop("content")


SARIF = (
    "runs array<struct<results:array<struct<ruleId:string,level:string,message:struct<text:string>,"
    "locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int>>>>,"
    "stacks:array<struct<frames:array<struct<location:struct<message:struct<text:string>>>>>>>>>>"
)


def sarif_findings(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """``checker, status, file, line, column, message, called_from`` of SARIF 2.1.0 texts; proven-safe results are left out."""
    r = docs.select(F.from_json(json_col, SARIF).alias("j")).select(F.explode("j.runs").alias("run")).select(F.explode("run.results").alias("r"))
    place = F.get("r.locations", 0)["physicalLocation"]
    frame = F.get(F.get("r.stacks", 0)["frames"], 0)["location"]["message"]["text"]
    return r.where(~F.lower(F.coalesce("r.level", F.lit("warning"))).isin("none", "ok", "safe")).select(
        F.col("r.ruleId").alias("checker"), F.coalesce("r.level", F.lit("warning")).alias("status"), place["artifactLocation"]["uri"].alias("file"),
        place["region"]["startLine"].alias("line"), place["region"]["startColumn"].alias("column"), F.col("r.message.text").alias("message"),
        F.regexp_replace(F.coalesce(frame, F.lit("")), "^Call from ", "").alias("called_from"),
    )


def tolerant_findings(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """Findings of a JSON list, or of an object's results, findings, reports, checks or items; with fallback keys per field."""
    v = docs.select(F.try_parse_json(json_col).alias("v"))
    lists = F.coalesce(*(F.try_variant_get("v", p, "array<variant>") for p in ("$", "$.results", "$.findings", "$.reports", "$.checks", "$.items")))
    each = v.select(F.explode(lists).alias("i"))
    get = lambda *keys, kind="string": F.coalesce(*(F.try_variant_get("i", f"$.{k}", kind) for k in keys))
    out = each.select(get("checker", "check", "rule", "id").alias("checker"), get("status", "result", "level").alias("status"), get("file", "path", "filename").alias("file"), get("line", "lineno", kind="int").alias("line"), get("message", "msg", "text").alias("message"))
    return out.where(~F.coalesce(F.lower("status"), F.lit("")).isin("ok", "safe"))


def compile_commands(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """``path, flags`` of compile databases, the first entry of a path; flags without compiler, inputs and outputs."""
    schema = "array<struct<directory:string,file:string,command:string,arguments:array<string>>>"
    e = docs.select(F.posexplode(F.from_json(json_col, schema)).alias("pos", "e"))
    path = F.when(F.col("e.file").startswith("/"), F.col("e.file")).otherwise(F.concat_ws("/", "e.directory", "e.file"))
    words = F.coalesce("e.arguments", F.split("e.command", r"\s+"))
    flags = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: w.startswith("-") & ~w.isin("-c", "-o"))
    return e.groupBy(path.alias("path")).agg(F.min_by(flags, F.col("pos")).alias("flags"))


AUDIT = "v int, ts string, run_id string, seq int, principal string, end_user string, action string, target string, model string, endpoint string, outcome string, detail string, cui boolean, prev_hash string, hash string"


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON-lines audit log; broken lines become null records."""
    return spark.read.schema(AUDIT).json(path)


def load_rules(spark: SparkSession, text: str) -> DataFrame:
    """Rules of a YAML list with flat keys; entries without an id are skipped, defaults filled in."""
    rules, item = [], None
    for raw in text.splitlines():
        line = raw.rstrip()
        if line.lstrip().startswith("- "):
            item = {}
            rules.append(item)
            line = line.replace("- ", "  ", 1)
        if item is not None and ":" in line and not line.lstrip().startswith("#"):
            k, _, v = line.strip().partition(":")
            item[k.strip()] = v.strip().strip("\"'")
    rows = [(r["id"], r.get("title", r["id"]), r.get("category", "general"), r.get("severity", "medium"), r.get("guidance", "")) for r in rules if r.get("id")]
    return spark.createDataFrame(rows, "id string, title string, category string, severity string, guidance string")
