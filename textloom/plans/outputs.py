"""Comments, canonical records and model outputs over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import comments, records
from ..operators import chain
from .derived import derived, with_derived
from .registry import query

_PIECES = r"""'(?s)"[^"\\]*(?:\\.[^"\\]*)*(?:"|\\?\z)|''[^''\\]*(?:\\.[^''\\]*)*(?:''|\\?\z)|//[^\n]*|#[^\n]*|/\*(?:[^*]|\*+[^*/])*(?:\*+/|\**\z)'"""


def _stripped(text: str) -> str:
    return (
        f"array_to_string(list_transform(list_zip(string_split_regex({text}, {_PIECES}), list_append(regexp_extract_all({text}, {_PIECES}), '')), lambda x: x[1] || CASE WHEN starts_with(x[2], '/*') "
        r"THEN regexp_replace(CASE WHEN ends_with(x[2], '*/') AND length(x[2]) >= 4 THEN x[2][3:length(x[2]) - 2] ELSE x[2][3:] END, '[^\n]', ' ', 'g') WHEN starts_with(x[2], '/') OR starts_with(x[2], '#') THEN '' ELSE x[2] END), '')"
    )


@query(f"SELECT page_id, sha256({_stripped('html')}) AS bare FROM pages")
def stripped_pages(t):
    """SF-11: pages without what a source scanner takes for comments, as hashes of what is left."""
    return t("pages").select("page_id", F.sha2(comments.strip_comments(F.col("html")), 256).alias("bare"))


@query(f"SELECT doc_id, sha256({_stripped('text')}) AS bare FROM (SELECT doc_id, replace(replace(text, ', ', ' /* '), '. ', ' */ // ') AS text FROM documents)")
def stripped_documents(t):
    """SF-11: documents whose commas open and whose full stops close comments."""
    text = F.replace(F.replace("text", F.lit(", "), F.lit(" /* ")), F.lit(". "), F.lit(" */ // "))
    return t("documents").select("doc_id", F.sha2(comments.strip_comments(text), 256).alias("bare"))


@query(r"""
SELECT page_id, strlen(html) = strlen(b) AND length(html) = length(b) OR html <> b AS placed, len(regexp_extract_all(b, '[A-Za-z]')) AS letters
FROM (SELECT page_id, html, array_to_string(list_transform(list_zip(string_split_regex(html, p), list_append(regexp_extract_all(html, p), '')), lambda x: x[1] || CASE WHEN starts_with(x[2], '/') THEN regexp_replace(x[2], '[^\n]', ' ', 'g') ELSE regexp_replace(x[2], '[^"''\n]', ' ', 'g') END), '') AS b
FROM pages, (SELECT '/\*(?:[^*]|\*+[^*/])*(?:\*+/|\**\z)|//[^\n]*|"[^"\\\n]*(?:\\.[^"\\\n]*)*"?|''[^''\\\n]*(?:\\.[^''\\\n]*)*''?' AS p))
""")
def blanked_pages(t):
    """SF-12: comments and strings of pages blanked in place: whether every character kept its place, and the letters left."""
    b = comments.blank_comments(F.col("html"))
    same = (F.length("html") == F.length(b)) & (F.length(F.regexp_replace("html", r"[^\n]", "")) == F.length(F.regexp_replace(b, r"[^\n]", "")))
    return t("pages").select("page_id", same.alias("placed"), F.size(F.regexp_extract_all(b, F.lit("[A-Za-z]"), F.lit(0))).cast("long").alias("letters"))


_RECORD = "'{\"action\":\"' || event_type || '\",\"id\":' || event_id || ',\"target\":{\"k\":' || json_extract_string(props, '$.k') || ',\"who\":\"\\u00e9' || user_id || '\"}}'"


def _records(t):
    """Records whose keys stand in an order that depends on the row."""
    who = F.concat(F.lit('"who": "é'), F.col("user_id"), F.lit('"'))
    k = F.concat(F.lit('"k": '), F.get_json_object("props", "$.k"))
    target = F.concat(F.lit('"target": {'), F.when(F.col("event_id") % 2 == 0, F.concat(who, F.lit(", "), k)).otherwise(F.concat(k, F.lit(","), who)), F.lit("}"))
    action, number = F.concat(F.lit('"action" : "'), F.col("event_type"), F.lit('"')), F.concat(F.lit('"id":'), F.col("event_id"))
    parts = [F.concat(F.lit("{"), F.array_join(F.array(*p), ", "), F.lit(" }")) for p in ((target, action, number), (number, target, action), (action, number, target))]
    return t("events").withColumn("record", F.when(F.col("event_id") % 3 == 0, parts[0]).when(F.col("event_id") % 3 == 1, parts[1]).otherwise(parts[2]))


@query(f"SELECT event_id, {_RECORD} AS record, sha256({_RECORD}) AS hash FROM events")
def canonical_records(t):
    """JS-1: records in one form whatever their key order, with their hashes."""
    c = records.canonical_json(F.col("record"))
    return _records(t).select("event_id", c.alias("record"), F.sha2(c, 256).alias("hash"))


@query(f"""
WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, {_RECORD} AS payload FROM events),
c AS (SELECT user_id, seq, sha256(repeat('0', 64) || '|' || payload) AS hash FROM e WHERE seq = 0
UNION ALL SELECT e.user_id, e.seq, sha256(c.hash || '|' || e.payload) FROM c JOIN e ON e.user_id = c.user_id AND e.seq = c.seq + 1)
SELECT user_id, seq, hash FROM c
""")
def canonical_chain(t):
    """WN-6, JS-1: hash chains of canonical records."""
    return chain.build(_records(t), "user_id", "event_id", records.canonical_json(F.col("record"))).select("user_id", "seq", "hash")


_SEVERITY = "CASE user_id % 6 WHEN 0 THEN 'Critical' WHEN 1 THEN 'high' WHEN 2 THEN NULL WHEN 3 THEN 'low' WHEN 4 THEN 'odd' ELSE 'info' END"


@query(f"""
{with_derived("rules")},
i AS (SELECT 'f' || (event_id // 20) || '.c' AS file, event_id, 'R' || json_extract_string(props, '$.k') AS rule_id, lower({_SEVERITY}) AS own, (user_id % 90)::INT AS line FROM events WHERE event_type <> 'error'),
j AS (SELECT file, event_id, rule_id, CASE WHEN r.rule_id IS NOT NULL THEN r.category ELSE 'general' END AS category, coalesce(own, severity, 'medium') AS severity, line FROM i LEFT JOIN rules r USING (rule_id)),
k AS (SELECT *, list_position(['critical', 'high', 'medium', 'low', 'info'], severity) AS rank FROM j),
n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY rank, event_id) AS place FROM k WHERE rank <= 4)
SELECT file, rule_id, category, severity, line, 'seen {{' || event_id || '}}' AS message FROM n WHERE place <= 3
""")
def model_findings(t):
    """EX-9: findings in model outputs, of which each holds twenty events as items between prose and a fence."""
    severity = F.expr(f"coalesce(concat('\"severity\": \"', {_SEVERITY}, '\",'), '')")
    item = F.concat(F.lit('{"rule'), F.when(F.col("event_id") % 2 == 0, "").otherwise("_id"), F.lit('": " R'), F.get_json_object("props", "$.k"), F.lit(' ", '), severity, F.lit(' "line": '), F.col("user_id") % 90, F.lit(', "message": "seen {'), F.col("event_id"), F.lit('}"}'))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.when(F.col("event_type") == "error", F.lit('"no item"')).otherwise(item).alias("i")))), lambda x: x["i"]), ",\n")
    outputs = t("events").groupBy(F.concat(F.lit("f"), F.floor(F.col("event_id") / 20), F.lit(".c")).alias("file")).agg(F.concat(F.lit("Here you are [see below]:\n```json\n["), listed, F.lit("]\n```\nDone.")).alias("text"))
    return records.model_findings(outputs, derived(t, "rules"), "file", "text", "low", 3).drop("pos")


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL ELSE 'v}' || page_id END AS v, CASE WHEN page_id % 4 = 0 THEN NULL ELSE length(url) END::BIGINT AS n FROM pages")
def model_objects(t):
    """SF-23, SF-24: the objects that model outputs hold, made of the pages' columns: fenced, bare, with stray commas and single quotes, or cut off."""
    inner = F.concat(F.lit('"a": "v}'), F.col("page_id"), F.lit('", "b": {"n": '), F.length("url"), F.lit("}"))
    fenced = F.concat(F.lit("So:\n```json\n{"), inner, F.lit("}\n```\n{}"))
    bare = F.concat(F.lit("I say {"), inner, F.lit(", } and } more"))
    single = F.concat(F.lit("{"), F.replace(inner, F.lit('"'), F.lit("'")), F.lit("}"))
    single = F.replace(single, F.lit("v}"), F.lit("v)"))
    text = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("{"), inner)).when(F.col("page_id") % 4 == 1, fenced).when(F.col("page_id") % 4 == 2, bare).otherwise(single)
    v = records.lenient_variant(records.json_object(text))
    return t("pages").select("page_id", F.replace(F.try_variant_get(v, "$.a", "string"), F.lit(")"), F.lit("}")).alias("v"), F.try_variant_get(v, "$.b.n", "long").alias("n"))
