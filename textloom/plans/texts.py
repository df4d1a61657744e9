"""Queries over documents, conversations and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import caps, coverage, pack, rank
from .registry import query

QUERY = "license token permission"
TERMS = ["license", "token", "permission", "secret", "copyright", "user", "the", "und", "les", "password"]
_RANKED = r"""
WITH d AS (SELECT source || '/' || lang || '_' || doc_id AS path, text AS body FROM documents),
t AS (SELECT unnest(['license', 'token', 'permission']) AS t),
x AS (SELECT path, t, lower(path || ' ' || body || ' ') AS h, regexp_extract_all(lower(split_part(path, '/', -1)), '[A-Za-z0-9_]+') AS stem FROM d, t),
c AS (SELECT path, t, (length(h) - length(replace(h, t, ''))) / length(t) AS c, list_contains(stem, t) AS s FROM x),
f AS (SELECT t, ln(1 + (count(*) - count(*) FILTER (WHERE c > 0) + 0.5::DOUBLE) / (count(*) FILTER (WHERE c > 0) + 0.5::DOUBLE)) AS w FROM c GROUP BY t),
s AS (SELECT path, round(sum(CASE WHEN c > 0 THEN (1 + ln(c)) * w ELSE 0 END + CASE WHEN s THEN 25 * w ELSE 0 END), 6) AS score FROM c JOIN f USING (t) GROUP BY path)
SELECT path, score FROM s WHERE score > 0 ORDER BY score DESC, path LIMIT 15
"""
_TOK = r"CASE WHEN length({t}) = 0 THEN 0 ELSE floor(greatest(len(regexp_extract_all({t}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'))::DOUBLE, strlen({t}) / 4.0::DOUBLE) * 1.1::DOUBLE)::BIGINT + 1 END"


def _path():
    """A document's path in the file model."""
    return F.concat("source", F.lit("/"), "lang", F.lit("_"), F.col("doc_id").cast("string"))


@query(_RANKED)
def search_documents(t):
    """Relevance ranking: top 15."""
    return rank.relevance_rank(t("documents"), _path(), F.col("text"), QUERY).orderBy(F.desc("score"), "path").limit(15)


@query(f"""
WITH t AS (SELECT unnest({TERMS}) AS term), n AS (SELECT count(*) AS n FROM documents),
c AS (SELECT term, count(*) FILTER (WHERE contains(lower(text), term)) AS df FROM documents, t GROUP BY term)
SELECT term, df, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM c, n
""")
def doc_frequency(t):
    """Texts that hold a term, and its weight."""
    return rank.document_frequency(t("documents"), F.lower("text"), TERMS)


@query(f"SELECT doc_id, {_TOK.format(t='text')} AS tokens FROM documents")
def token_estimate_docs(t):
    """Token estimate of each document."""
    return t("documents").select("doc_id", fx.token_estimate(F.col("text")).alias("tokens"))


@query(f"SELECT conv_id, (sum(4 + {_TOK.format(t='text')}) + 2)::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def conversation_tokens(t):
    """Message tokens of each conversation."""
    return t("conversations").groupBy("conv_id").agg((F.sum(4 + fx.token_estimate(F.col("text"))) + 2).alias("tokens"))


_PACK = """
WITH d AS (SELECT doc_id, {extra} coalesce(quality, 0) AS q, {tok} AS tokens FROM documents LEFT JOIN labels USING (doc_id)),
r AS (SELECT *, sum(tokens) OVER ({part} ORDER BY q DESC, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM d),
f AS (SELECT *, running <= {budget} AS fits, coalesce(lag(running) OVER ({part} ORDER BY q DESC, doc_id), 0) AS before FROM r)
SELECT doc_id, {extra} tokens, running, fits, NOT fits AND {budget} - before > 50 AS cut FROM f WHERE fits OR before <= {budget} AND NOT fits
"""


def _ranked_blocks(t):
    d = t("documents").select("doc_id", "source", fx.token_estimate(F.col("text")).alias("tokens"))
    return d.join(t("labels").select("doc_id", "quality"), "doc_id", "left").withColumn("q", F.coalesce("quality", F.lit(0)))


@query(_PACK.format(extra="", part="", budget=20000, tok=_TOK.format(t="text")))
def budget_pack(t):
    """Documents in rank order within 20,000 tokens, and the one that overflows."""
    return pack.budget_pack(_ranked_blocks(t), [F.desc("q"), F.asc("doc_id")], "tokens", 20_000).select("doc_id", "tokens", "running", "fits", "cut")


@query(_PACK.format(extra="source,", part="PARTITION BY source", budget=20000, tok=_TOK.format(t="text")))
def budget_pack_per_source(t):
    """The same for each source."""
    return pack.budget_pack(_ranked_blocks(t), [F.desc("q"), F.asc("doc_id")], "tokens", 20_000, key="source").select("doc_id", "source", "tokens", "running", "fits", "cut")


_LINES = r"regexp_split_to_array(regexp_replace(x.text, '(\r\n|\n|\r)$', ''), '\r\n|\n|\r')"
_CUT = f"""
WITH d AS (SELECT doc_id, source, text, {{cost}} AS tokens FROM documents),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM d),
x AS (SELECT *, running - tokens AS before FROM r WHERE running - tokens <= {{budget}}),
l AS (SELECT doc_id, before, i, line, sum(t + 1) OVER (PARTITION BY doc_id ORDER BY i) AS used FROM (SELECT *, {{line}} AS t FROM (SELECT doc_id, before, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS i FROM x WHERE running > {{budget}} AND {{budget}} - before > {{room}}))),
c AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE used <= {{budget}} - before), '') AS head, count(*) FILTER (WHERE used <= {{budget}} - before) AS kept, count(*) AS n FROM l GROUP BY doc_id),
b AS (SELECT x.doc_id, source, running, x.text, running <= {{budget}} AS fits, c.doc_id IS NOT NULL AS cut, CASE WHEN kept = n THEN head WHEN kept = 0 THEN '{{mark}}' ELSE head || chr(10) || '{{mark}}' END AS clipped FROM x LEFT JOIN c USING (doc_id))
"""


@query(_CUT.format(line=_TOK.format(t="line"), cost=_TOK.format(t="text"), budget=3000, room=50, mark="… (truncated)") + "SELECT doc_id, source, running, cut, sha256(CASE WHEN fits THEN text ELSE clipped END) AS block_sha FROM b")
def packed_blocks(t):
    """RK-7: each source's texts within 3,000 tokens; the one that overflows is cut by lines."""
    d = t("documents").select("doc_id", "source", fx.token_estimate(F.col("text")).alias("tokens"))
    packed = pack.budget_pack(d, [F.asc("doc_id")], "tokens", 3000, key="source")
    return pack.packed_texts(packed, t("documents"), "doc_id", "text", "tokens", 3000).select("doc_id", "source", "running", "cut", F.sha2("block", 256).alias("block_sha"))


_WRAPPED = "chr(10) || '### f' || doc_id || chr(10) || '```diff' || chr(10) || text || chr(10) || '```' || chr(10)"
_OMITTED = "_(remaining diffs omitted to fit context budget)_"  # fixed, with the frame and both marks


@query(_CUT.format(line=_TOK.format(t="line"), cost=_TOK.format(t=f"({_WRAPPED})"), budget=4000, room=80, mark="... (truncated)") + f"""
SELECT doc_id, source, running, sha256(CASE WHEN fits THEN {_WRAPPED} ELSE CASE WHEN cut THEN chr(10) || '### f' || doc_id || chr(10) || '```diff' || chr(10) || clipped || chr(10) || '```' ELSE '' END || chr(10) || '{_OMITTED}' END) AS block_sha FROM b
""")
def review_diffs(t):
    """RK-8: each source's diffs within 4,000 tokens, framed; the one that overflows is cut by lines, and a note says that more was left out."""
    head = F.concat(F.lit("\n### f"), F.col("doc_id").cast("string"), F.lit("\n```diff\n"))
    d = t("documents").select("doc_id", "source", fx.token_estimate(F.concat(head, F.col("text"), F.lit("\n```\n"))).alias("tokens"))
    packed = pack.budget_pack(d, [F.asc("doc_id")], "tokens", 4000, key="source", room=80)
    blocks = pack.packed_texts(packed, t("documents"), "doc_id", "text", "tokens", 4000, "... (truncated)")
    left_out = F.concat(F.coalesce(F.concat(head, F.col("block"), F.lit("\n```")), F.lit("")), F.lit("\n" + _OMITTED))
    return blocks.select("doc_id", "source", "running", F.sha2(F.when(F.col("fits"), F.concat(head, F.col("block"), F.lit("\n```\n"))).otherwise(left_out), 256).alias("block_sha"))


@query("""
WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)
SELECT doc_id, source, rn, row_number() OVER (ORDER BY rn, source) AS pick FROM r ORDER BY rn, source LIMIT 300
""")
def round_robin_cap(t):
    """300 documents, one of each source a round."""
    return caps.fair_cap(t("documents").select("doc_id", "source"), "source", [F.asc("doc_id")], 300).select("doc_id", "source", F.col("rn").cast("long").alias("rn"), F.col("pick").cast("long").alias("pick"))


@query("""
WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY lang <> 'en', doc_id) AS k FROM documents)
SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM r WHERE k <= 5
""")
def types_first_clip(t):
    """Five of each source, English first, in the order of ids."""
    return caps.clip_in_order(t("documents").select("doc_id", "source", "lang"), "source", [(F.col("lang") != "en").asc(), F.asc("doc_id")], [F.asc("doc_id")], 5).withColumn("pos", F.col("pos").cast("long"))


@query("""
WITH c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS first, lang IN ('de', 'es') AS code FROM documents GROUP BY source, lang),
s AS (SELECT source, coalesce(sum(n) FILTER (WHERE code), 0)::BIGINT AS c, sum(n)::BIGINT AS t FROM c GROUP BY source),
r AS (SELECT c.*, s.c, s.t, row_number() OVER (PARTITION BY source ORDER BY (s.c / s.t >= 0.1::DOUBLE AND NOT code), n DESC, first) AS k FROM c JOIN s USING (source))
SELECT source, lang, c, t FROM r WHERE k = 1
""")
def dominant_language(t):
    """Main language of each source; German and Spanish play code."""
    return rank.dominant(t("documents").withColumn("ord", F.col("doc_id")), "source", "lang", F.col("lang").isin("de", "es"))


@query("SELECT lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang")
def language_histogram(t):
    """Documents and characters by language."""
    return t("documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY lang")
def fair_language_bins(t):
    """Sorted sources of each language."""
    return t("documents").groupBy(F.coalesce(F.nullif("lang", F.lit("")), F.lit("Other")).alias("lang")).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


@query("""
WITH s AS (SELECT source, CASE WHEN quality IS NULL THEN 'skipped' WHEN toxic = 1 THEN 'failed' WHEN quality = 0 THEN 'partial' ELSE 'succeeded' END AS st FROM documents LEFT JOIN labels USING (doc_id)),
c AS (SELECT source, count(*) FILTER (WHERE st = 'succeeded') AS succeeded, count(*) FILTER (WHERE st = 'partial') AS partial, count(*) FILTER (WHERE st = 'failed') AS failed, count(*) FILTER (WHERE st = 'skipped') AS skipped FROM s GROUP BY source)
SELECT *, succeeded + partial + failed AS attempted, succeeded + partial + failed + skipped AS eligible, partial = 0 AND failed = 0 AND skipped = 0 AS complete FROM c
""")
def coverage_block(t):
    """Coverage of labelling by source."""
    state = F.when(F.col("quality").isNull(), "skipped").when(F.col("toxic") == 1, "failed").when(F.col("quality") == 0, "partial").otherwise("succeeded")
    return coverage.coverage(t("documents").select("doc_id", "source").join(t("labels"), "doc_id", "left"), "source", state)


@query("""
SELECT source, sum(toxic)::BIGINT AS killed, sum(quality)::BIGINT AS total, CASE WHEN sum(quality) > 0 THEN round(sum(toxic) / sum(quality)::DOUBLE, 3) END AS score
FROM documents JOIN labels USING (doc_id) GROUP BY source
""")
def mutation_score(t):
    """Killed over valid, null without valid ones."""
    g = t("documents").select("doc_id", "source").join(t("labels"), "doc_id").groupBy("source").agg(F.sum("toxic").alias("killed"), F.sum("quality").alias("total"))
    return g.withColumn("score", F.round(F.try_divide(F.col("killed").cast("double"), F.col("total").cast("double")), 3))


@query("""
WITH v AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'uncompilable' WHEN doc_id % 5 = 0 THEN 'unrunnable' WHEN quality = 0 THEN 'wrong' WHEN doc_id % 3 <= 0 THEN 'unverifiable' WHEN toxic > 0 THEN 'useful' ELSE 'vacuous' END AS verdict FROM labels)
SELECT verdict, count(*) AS n FROM v GROUP BY verdict
""")
def verdict_ladder(t):
    """Histogram of verdicts."""
    v = coverage.verdict(F.col("doc_id") % 7 != 0, F.col("doc_id") % 5 != 0, F.col("quality") != 0, F.col("doc_id") % 3, F.col("toxic"))
    return t("labels").groupBy(v.alias("verdict")).agg(F.count("*").alias("n"))


@query("SELECT sha256(text) AS sha, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(t):
    """Groups of equal texts by digest."""
    d = t("documents").select(F.sha2("text", 256).alias("sha"), "doc_id")
    return d.groupBy("sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


LICENSE = r"(?i)\b(license|licensed|copyright|all rights reserved)\b"


@query(r"""
SELECT doc_id, count(*) FILTER (WHERE regexp_matches(l, '(?i)\b(license|licensed|copyright|all rights reserved)\b')) AS dropped, count(*) AS lines
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id HAVING dropped > 0
""")
def license_block_filter(t):
    """Lines of licence blocks that a purpose never starts from."""
    lines = F.split("text", "\n")
    hit = F.size(F.filter(lines, lambda line: line.rlike(LICENSE)))
    return t("documents").select("doc_id", hit.cast("long").alias("dropped"), F.size(lines).cast("long").alias("lines")).where("dropped > 0")


SECRET_KINDS = {"aws_key": "AKIA[0-9A-Z]{16}", "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "hex_token": "[0-9a-fA-F]{32,}", "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"}


@query("SELECT kind, count(*) AS docs, sum(n)::BIGINT AS hits FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, len(regexp_extract_all(text, '{p}')) AS n FROM documents" for k, p in SECRET_KINDS.items()) + ") WHERE n > 0 GROUP BY kind")
def secret_scan(t):
    """Texts and hits of secret-like patterns."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.regexp_count("text", F.lit(p)).alias("n")) for k, p in SECRET_KINDS.items()))).alias("p")
    return t("documents").select(each).where("p.n > 0").groupBy("p.kind").agg(F.count("*").alias("docs"), F.sum("p.n").alias("hits"))


SPECIFIC = {"apache": "Apache License", "gpl": "GNU General Public License", "mit": "MIT License", "cc": "CC BY"}
GENERIC = {"license": "(?i)licen[cs]e", "rights": "(?i)all rights reserved"}


def _flags(names: dict[str, str]) -> str:
    return "list_sort(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in names.items()) + "], lambda x: x IS NOT NULL))"


@query(f"SELECT doc_id, array_to_string(CASE WHEN len({_flags(SPECIFIC)}) > 0 THEN {_flags(SPECIFIC)} ELSE {_flags(GENERIC)} END, ',') AS names FROM documents")
def named_pattern_flags(t):
    """Sorted names of matched patterns; specific ones suppress generic ones."""
    return t("documents").select("doc_id", F.array_join(fx.specific_first(F.col("text"), SPECIFIC, GENERIC), ",").alias("names"))


@query(r"""
WITH f AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents)
SELECT doc_id, left(CASE WHEN instr(f, '. ') > 0 THEN split_part(f, '. ', 1) || '.' ELSE f END, 200) AS sentence FROM f
""")
def first_sentence(t):
    """First sentence, at most 200 characters."""
    return t("documents").select("doc_id", fx.first_sentence(F.col("text")).alias("sentence"))


@query("""
SELECT doc_id, coalesce(string_agg(i || ': ' || l, chr(10) ORDER BY i) FILTER (WHERE i BETWEEN 2 AND 5), '') AS lines
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) GROUP BY doc_id
""")
def line_slice(t):
    """Lines 2 to 5, numbered."""
    return t("documents").select("doc_id", fx.line_slice(F.col("text"), 2, 5).alias("lines"))


@query("""
SELECT doc_id, left(text, 500) AS head, length(text) AS total, length(text) > 500 AS truncated FROM documents
""")
def capped_load(t):
    """A prefix with the full count."""
    head, total = fx.capped(F.col("text"), 500)
    return t("documents").select("doc_id", head.alias("head"), total.alias("total"), (total > 500).alias("truncated"))


@query(r"""
WITH u AS (SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT conv_id, lower(regexp_extract(trim(text), '^(\S+)', 1)) AS verb, trim(regexp_replace(trim(text), '^\S+', '')) AS rest FROM u
""")
def chat_commands(t):
    """Verb and rest of the last user turn."""
    u = t("conversations").where("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    return u.select("conv_id", F.lower(F.regexp_extract(F.trim("text"), r"^(\S+)", 1)).alias("verb"), F.trim(F.regexp_replace(F.trim("text"), r"^\S+", "")).alias("rest"))
