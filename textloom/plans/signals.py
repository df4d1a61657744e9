"""Signals and summaries of files that are rendered from the parts, and of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import comments
from ..functions import paths as px
from ..functions import signals as sg
from .files import over
from .registry import query

COLUMNS = ("endpoints", "outbound_calls", "datastores", "messaging", "sockets", "env_vars")
#: Languages of prose, which no signals are taken from (fixed values).
PROSE = ("Markdown", "reStructuredText")


def _summaries(files):
    """EX-8: a file's summary row: signals of its text without comments, and sentences; prose has none."""
    code = F.when(px.detect_language(F.col("path")).isin(*PROSE), "").otherwise(comments.strip_comments(F.col("text")))
    # a column of its own: written into each signal, the scan would run for every pattern
    found = files.withColumn("__code", code).withColumns(sg.io_signals(F.col("__code"))).drop("__code")
    return found.withColumn("side_effects", sg.side_effects({c: F.col(c) for c in COLUMNS}))


_EFFECTS = "CASE k WHEN 0 THEN 'exposes 1 HTTP endpoint(s)|makes outbound network calls|accesses PostgreSQL|reads 1 env var(s)' WHEN 1 THEN 'uses sockets: UDP socket' WHEN 2 THEN 'makes outbound network calls|uses messaging: Kafka' ELSE '' END"


@over("""
SELECT path, CASE k WHEN 0 THEN '/a' || p_size ELSE '' END AS endpoints, CASE k WHEN 0 THEN 'h' || p_size || ':9000' WHEN 2 THEN 'b' || p_size || '.internal' ELSE '' END AS outbound_calls, CASE k WHEN 0 THEN 'PostgreSQL' ELSE '' END AS datastores,
CASE k WHEN 2 THEN 'Kafka' ELSE '' END AS messaging, CASE k WHEN 1 THEN 'UDP socket' ELSE '' END AS sockets, CASE k WHEN 0 THEN 'K' || p_size ELSE '' END AS env_vars FROM signal_files
""", "signal_files")  # fmt: skip
def io_signals(t):
    """SF-5 to SF-10, EX-7: signals of files, some of which are comments only in part."""
    noisy = F.concat(F.lit('/* @app.get("/no") */ // os.getenv("NO")\n'), F.col("text"), F.lit('# requests.get("https://no:1/x")'))
    return _summaries(t("signal_files").withColumn("text", noisy)).select("path", *(F.array_join(c, ",").alias(c) for c in COLUMNS))


@over(f"SELECT path, {_EFFECTS} AS effects FROM signal_files", "signal_files")
def side_effect_sentences(t):
    """PJ-3: sentences on what files do."""
    return _summaries(t("signal_files")).select("path", F.array_join("side_effects", "|").alias("effects"))


@over(f"""
SELECT path, CASE k WHEN 1 THEN 'C' WHEN 2 THEN 'Go' ELSE 'Python' END AS language, CASE k WHEN 0 THEN 'api' ELSE '(root)' END AS component, CASE k WHEN 0 THEN 4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS loc,
CASE WHEN k = 3 THEN 0 ELSE len(string_split({_EFFECTS}, '|')) END AS effects FROM signal_files
""", "signal_files")  # fmt: skip
def file_summaries(t):
    """EX-8, PL-1: the index's row of each file."""
    p = F.col("path")
    lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("int")
    return _summaries(t("signal_files")).select("path", px.detect_language(p).alias("language"), px.component_for(p).alias("component"), lines.alias("loc"), F.size("side_effects").alias("effects"))


@query(r"""
SELECT component, count(*) AS files, sum(lines)::BIGINT AS loc, count(*) FILTER (WHERE stores > 0) AS with_stores FROM (
SELECT source AS component, length(text) - length(replace(text, chr(10), '')) + 1 AS lines,
len(regexp_extract_all(regexp_replace(text, '"[A-Za-z][A-Za-z0-9]{0,23}[-_]"', '""', 'g'), '(?i)\b(redis|motor|diesel|sqlite|postgres)\b')) AS stores FROM documents) GROUP BY component
""")
def index_documents(t):
    """PL-1, AG-1, AG-2: components of the documents with files, lines, and files that name a store."""
    d = t("documents").select("source", "text", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("lines"), F.size(F.array_intersect(sg.datastores(F.col("text")), F.array(*map(F.lit, ("Redis", "MongoDB", "Diesel (ORM)", "SQLite", "PostgreSQL"))))).alias("stores"))
    return d.groupBy(F.col("source").alias("component")).agg(F.count("*").alias("files"), F.sum("lines").cast("long").alias("loc"), F.count_if(F.col("stores") > 0).alias("with_stores"))
