"""JSON texts: canonical records, objects in free text, and what a model meant to write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as fx

#: Ranks of severities, and that of unknown ones and of an unknown threshold (fixed values).
SEVERITIES = ("critical", "high", "medium", "low", "info")
UNKNOWN, UNKNOWN_THRESHOLD = 9, 3


def _escaped(c: Column) -> Column:
    """A character beyond the tilde as one or two escapes of UTF-16 units, in lower case."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))
    code = F.ascii(c).cast("long")
    high, low = F.lit(0xD800) + F.shiftright(code - 0x10000, 10), F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(0x3FF))
    return F.when(code < 127, c).when(code < 0x10000, unit(code)).otherwise(F.concat(unit(high), unit(low)))


def canonical_json(text: Column) -> Column:
    """A record in one form, whatever the order of its keys: keys sorted at every depth, no spaces, ASCII only. Null if ``text`` isn't JSON.

    A variant holds the fields of an object in the order of their names, which
    does the sorting at every depth.
    """
    flat = F.to_json(F.try_parse_json(text))
    for digit in "01":
        for letter in "ABCDEF":  # escapes of control characters, after an even number of backslashes
            flat = F.regexp_replace(flat, rf"(?<!\\)((?:\\\\)*+)\\u00{digit}{letter}", rf"$1\\u00{digit}{letter.lower()}")
    return F.when(flat.rlike(r"[^\x00-\x7E]"), F.array_join(F.transform(F.split(flat, ""), _escaped), "")).otherwise(flat)


def json_object(text: Column) -> Column:
    """The first balanced object of free text, or what a fence marked as JSON holds; null if there is none.

    Braces in strings don't count. One fold over strings, braces and what lies
    between them: linear in the text.
    """
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*+(\{.*?\})\s*```", 1)
    rest = F.substring(text, F.instr(text, "{"), F.length(text))
    tokens = F.regexp_extract_all(rest, F.lit(r'"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+(?:"|\\?\z)|[{}]|[^"{}]++'), F.lit(0))

    def step(s: Column, t: Column) -> Column:
        depth = s["depth"] + F.when(t == "{", 1).when(t == "}", -1).otherwise(0)
        return F.when(s["done"], s).otherwise(F.struct(depth.alias("depth"), (s["n"] + F.length(t)).alias("n"), ((t == "}") & (depth == 0)).alias("done")))

    n = F.aggregate(tokens, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("done")), step, lambda s: F.when(s["done"], s["n"]))
    return F.when(fenced != "", fenced).when(F.instr(text, "{") > 0, F.substring(rest, F.lit(1), n))


def lenient_variant(blob: Column) -> Column:
    """A blob as a variant, else with commas before closing brackets dropped and single quotes made double, else null."""
    repaired = F.replace(F.regexp_replace(blob, r",\s*+([}\]])", "$1"), F.lit("'"), F.lit('"'))
    return F.coalesce(F.try_parse_json(blob), F.try_parse_json(repaired))


def _rank(severity: Column, otherwise: int) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity), F.lit(0)) - 1, F.lit(otherwise))


def model_findings(outputs: DataFrame, rules: DataFrame, file: str, text: str, min_severity: str, most: int) -> DataFrame:
    """Findings that models wrote as a JSON array in free text: ``file, rule_id, category, severity, line, message, pos``.

    ``rules(rule_id, category, severity)``. What isn't an array, and items that
    aren't objects, give no rows. A severity is the item's own, else the rule's,
    else medium; findings below ``min_severity`` or of an unknown severity are
    dropped. Of a file's findings the ``most`` most severe stay, ties in the
    order of writing.
    """
    get = lambda name, kind="string": F.try_variant_get("it", f"$.{name}", kind)
    first = lambda *names: F.coalesce(*(F.nullif(get(n), F.lit("")) for n in names))
    listed = outputs.select(F.col(file).alias("file"), F.posexplode(F.try_variant_get(F.try_parse_json(fx.json_array(F.col(text))), "$", "array<variant>")).alias("pos", "it"))
    items = listed.where(F.schema_of_variant("it").startswith("OBJECT")).select(
        "file", F.col("pos").cast("long").alias("pos"), F.trim(F.coalesce(first("rule", "rule_id", "id"), F.lit(""))).alias("rule_id"), F.nullif(get("severity"), F.lit("")).alias("own"),
        get("category").alias("named"), get("line", "int").alias("line"), F.trim(F.coalesce(first("message", "explanation"), F.lit(""))).alias("message"),
    )
    known = rules.select(F.col("rule_id").alias("r"), F.col("category").alias("rule_category"), F.col("severity").alias("rule_severity"), F.lit(True).alias("ruled"))
    joined = items.join(known, items["rule_id"] == known["r"], "left")
    severity = F.lower(F.coalesce("own", "rule_severity", F.lit("medium")))
    category = F.when(F.col("ruled"), F.col("rule_category")).otherwise(F.coalesce("named", F.lit("general")))
    found = joined.select("file", F.when(F.col("rule_id") == "", "UNKNOWN").otherwise(F.col("rule_id")).alias("rule_id"), category.alias("category"), severity.alias("severity"), "line", "message", "pos")
    least = SEVERITIES.index(min_severity) if min_severity in SEVERITIES else UNKNOWN_THRESHOLD
    place = F.row_number().over(Window.partitionBy("file").orderBy("rank", "pos"))
    return found.withColumn("rank", _rank(F.col("severity"), UNKNOWN)).where(F.col("rank") <= least).withColumn("place", place).where(F.col("place") <= most).drop("rank", "place")
