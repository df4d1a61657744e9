"""Surrogates for personal data, all in DataFrame expressions.

Detected entities (mail addresses, phone numbers, IPv4 addresses, card and
account numbers, social security numbers, secrets, names after a title) are
replaced by surrogates of their own type and shape: digits stay digits, letters
keep case and script, hexadecimal stays hexadecimal, card numbers keep network
and check-digit status, addresses stay valid, names keep the gender of their
title. A surrogate is drawn from key, type and canonical form and then laid into
the format of each mention, so all mentions of an entity get the same one
whatever their format (coreference). A full name is one entity for each gender
of its titles; mentions with a neutral title belong to the gender that the name
has elsewhere in the corpus (the female one if it has both).

Distinctness is checked over the whole corpus, on canonical forms: entities of a
type (domains of mail addresses are one) that share a surrogate, or whose surrogate
is an entity of the corpus itself, are drawn again until none is left; where a space
is full, as of one-letter mail names, surrogates grow. Only those redrawn, and names whose gender
other mentions tell, travel back to the documents, as a literal map while they are
few, else by a join on the text's name.

Texts without a digit, an at sign, the beginning of a secret or a title are not
searched at all.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: More redrawn entities than this are joined, not written into the plan.
LITERAL_ENTITIES = 1000
#: Setting of the session that holds the key of the queries.
KEY_CONF = "spark.textloom.surrogateKey"
#: From this draw on, surrogates of mail names, domains and names grow by a character or syllable a draw, and others may be real values elsewhere.
GROW = 6

#: Titles by gender (fixed values).
MALE = "Mr|Sir|Herr|Señor|Sr|Monsieur|Don"
FEMALE = "Mrs|Ms|Miss|Madam|Frau|Señora|Señorita|Sra|Mme|Madame|Mademoiselle|Doña"
NEUTRAL = "Dr|Prof|Mx"
TITLE = rf"\b(?:{MALE}|{FEMALE}|{NEUTRAL})\.? (?=\p{{Lu}})"

#: Characters of a mail address before the at sign, and a label of its domain.
_LOCAL, _LABEL = r"[\p{L}\p{N}._%+-]", r"[\p{L}\p{N}-]{1,253}+"
#: Pattern by type; earlier ones win where several match at a place. Repeated groups have bounds (a domain has at most 127 labels), as Java
#: recurses once a repetition, and an address is tried at the beginning of a run only, so that a search is linear in the text.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}{{1,320}}+@{_LABEL}(?:\.{_LABEL}){{0,126}}\.\p{{L}}{{2,63}}+(?!\p{{L}})",
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?i:token|secret|password|passwd|api[_-]?key) ?[=:] ?[\"']?[A-Za-z0-9_/+-]{8,}",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}[.-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?!\d)",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "name": rf"{TITLE}\p{{Lu}}[\p{{L}}'’-]{{1,100}}+(?: \p{{Lu}}[\p{{L}}'’-]{{1,100}}+)?",
}
SEARCH = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a match looks like from inside, by type: the first that fits.
SHAPES = {
    "email": "@",
    "secret": r"^AKIA[0-9A-Z]{16}$|^(?i:token|secret|password|passwd|api)",
    "ip": r"^\d+\.\d+\.\d+\.\d+$",
    "iban": r"^[A-Z]{2}\d{2}",
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
    "phone": r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$",
    "card": r"^\d",
    "name": r"",
}
#: Letters that surrogates draw from, by script and case, and syllables of given and family names (fixed values).
ALPHABETS = [
    ("[0-9]", "0123456789"), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("[\\u00DF-\\u00FF]", "àáâäåæçèéêëìíîïñòóôöøùúûüý"), ("[\\u00C0-\\u00DE]", "ÀÁÂÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÖØÙÚÛÜÝ"),
    ("[\\u03B1-\\u03C9]", "αβγδεζηθικλμνξοπρστυφχψω"), ("[\\u0391-\\u03A9]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    ("[\\u0430-\\u044F]", "абвгдежзиклмнопрстуфхцчшэюя"), ("[\\u0410-\\u042F]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
]
SYLLABLES = "ba be bo da de do fa fe ga ge ka ke ki la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si ta te ti to va ve vi".split()
MALE_ENDS, FEMALE_ENDS, FAMILY_ENDS = "n s r l d rik mon".split(), "a na ra lia nia isa ella".split(), "n r s ng nd rt ler man ton berg".split()


def session_key(spark: SparkSession) -> str:
    """The session's key; without one a new random key, so that nobody can work surrogates out again."""
    return spark.conf.get(KEY_CONF, None) or secrets.token_hex(16)


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _type(m: str) -> str:
    return "CASE " + " ".join(f"WHEN {m} rlike {_q(p)} THEN '{t}'" for t, p in SHAPES.items() if p) + " ELSE 'name' END"


def _canonical(kind: str, m: str) -> str:
    """What makes two mentions the same entity."""
    value = rf"regexp_replace({m}, '^(?i:token|secret|password|passwd|api[_-]?key) ?[=:] ?[\"\']?', '')"
    return (
        f"CASE {kind} WHEN 'email' THEN lower({m}) WHEN 'secret' THEN {value} WHEN 'ip' THEN {m} WHEN 'iban' THEN replace({m}, ' ', '') "
        rf"WHEN 'name' THEN lower(regexp_replace({m}, {_q(TITLE)}, '')) WHEN 'phone' THEN right(regexp_replace({m}, '[^0-9]', ''), 10) ELSE regexp_replace({m}, '[^0-9]', '') END"
    )


def _pick(letters: str, r: str) -> str:
    return f"substr({_q(letters)}, 1 + CAST(pmod({r}, {len(letters)}) AS INT), 1)"


def _from(words: list[str], r: str) -> str:
    return f"element_at(split({_q(' '.join(words))}, ' '), CAST(pmod({r}, {len(words)}) AS INT) + 1)"


def _chars(s: str, seed: str, hexadecimal: bool = False) -> str:
    """Each character of ``s`` drawn anew in its own alphabet, counted from the end so that prefixes don't matter."""
    cases = " ".join(f"WHEN c rlike {_q(p)} THEN {_pick(a, 'r')}" for p, a in ALPHABETS)
    if hexadecimal:
        cases = f"WHEN h = 1 THEN {_pick('0123456789abcdef', 'r')} WHEN h = 2 THEN {_pick('0123456789ABCDEF', 'r')} {cases}"
    kind = "CASE WHEN s rlike '^[0-9a-f]+$' THEN 1 WHEN s rlike '^[0-9A-F]+$' THEN 2 ELSE 0 END" if hexadecimal else "0"
    one = f"get(transform(array(xxhash64({seed}, of_s - i)), r -> CASE {cases} ELSE c END), 0)"
    return f"get(transform(array({s}), s -> get(transform(array({kind}), h -> get(transform(array(length(s)), of_s -> array_join(transform(split(s, ''), (c, i) -> {one}), '')), 0)), 0)), 0)"


def _luhn(digits: str) -> str:
    """Sum of a digit string without its check digit, by the Luhn rule."""
    return f"aggregate(transform(split(reverse({digits}), ''), (c, i) -> CASE WHEN i % 2 = 1 THEN CAST(c AS INT) ELSE CAST(c AS INT) * 2 - IF(CAST(c AS INT) > 4, 9, 0) END), 0, (a, x) -> a + x)"


def _mod97(s: str) -> str:
    """Remainder by 97 of a string of digits and capitals, which count 10 to 35."""
    return f"aggregate(split({s}, ''), 0, (a, c) -> CAST((CASE WHEN c rlike '[A-Z]' THEN a * 100 + ascii(c) - 55 ELSE a * 10 + CAST(c AS INT) END) % 97 AS INT))"


def _gender(kind: str, m: str, canon: str) -> str:
    """Of a full name's title: m, f, or n; nothing for other entities."""
    title = f"regexp_extract({m}, {_q('^' + TITLE)}, 0)"
    return f"CASE WHEN {kind} <> 'name' OR {canon} NOT LIKE '% %' THEN '' WHEN {title} rlike '^(?:{MALE})[. ]' THEN 'm' WHEN {title} rlike '^(?:{FEMALE})[. ]' THEN 'f' ELSE 'n' END"


def _domain(canon: str) -> str:
    return f"substring_index({canon}, '@', -1)"


def _drawn(kind: str, canon: str, gender: str, seed: str, attempt: str, domain: str | None = None) -> str:
    """Canonical form of an entity's surrogate; Latin names are capitalised. A mail address has ``domain`` (its own if none is given)."""
    more = f"repeat('x', greatest(0, {attempt} - {GROW}))"
    own = f"concat(CASE WHEN {kind} = 'email' THEN substring_index({canon}, '@', 1) ELSE regexp_replace({canon}, '[.][^.]*$', '') END, {more})"
    email = f"concat({_chars(own, seed)}, CASE WHEN {kind} = 'email' THEN concat('@', {domain or _domain(canon)}) ELSE concat('.', substring_index({canon}, '.', -1)) END)"
    lead = f"regexp_extract({canon}, '^AKIA(?=[0-9A-Z]{{16}}$)', 0)"
    secret = f"concat({lead}, {_chars(f'substr({canon}, length({lead}) + 1)', seed, hexadecimal=True)})"
    ip = f"array_join(transform(split({canon}, '[.]'), (o, i) -> CAST(CASE WHEN i IN (0, 3) THEN 1 + pmod(xxhash64({seed}, i), 223) ELSE pmod(xxhash64({seed}, i), 256) END AS STRING)), '.')"
    # card: network digit kept, the others drawn, the last set so that the check sum stays right or wrong
    body = f"concat(substr({canon}, 1, 1), {_chars(f'substr({canon}, 2, length({canon}) - 2)', seed)})"
    off = f"pmod(CAST(right({canon}, 1) AS INT) + {_luhn(f'left({canon}, length({canon}) - 1)')}, 10)"
    card = f"transform(array({body}), b -> concat(b, CAST(pmod({off} - {_luhn('b')}, 10) AS STRING)))[0]"
    r = f"xxhash64({seed}, 91)"
    ends = f"CASE {gender} WHEN 'm' THEN {_from(MALE_ENDS, r)} WHEN 'f' THEN {_from(FEMALE_ENDS, r)} ELSE {_from(MALE_ENDS + FEMALE_ENDS, r)} END"
    stem = lambda a: f"{_from(SYLLABLES, f'xxhash64({seed}, {a})')}, {_from(SYLLABLES, f'xxhash64({seed}, {a + 1})')}, {_from(SYLLABLES, f'xxhash64({seed}, {a + 2})')}"
    grown = f"array_join(transform(IF({attempt} > {GROW}, sequence(1, {attempt} - {GROW}), CAST(array() AS array<int>)), g -> {_from(SYLLABLES, f'xxhash64({seed}, 200 + g)')}), '')"
    given, family = f"initcap(concat({stem(70)}, {ends}))", f"initcap(concat({stem(80)}, {grown}, {_from(FAMILY_ENDS, f'xxhash64({seed}, 92)')}))"
    latin = f"concat(CASE WHEN {canon} LIKE '% %' THEN concat({given}, ' ') ELSE '' END, {family})"
    # what is drawn character by character: local parts and most types
    plain = _chars(f"CASE WHEN {kind} = 'iban' THEN substr({canon}, 3) WHEN {kind} = 'name' THEN concat({canon}, repeat(right({canon}, 1), greatest(0, {attempt} - {GROW}))) ELSE {canon} END", seed)
    # account number: a right check number stays right
    right = f"{_mod97(f'concat(substr({canon}, 5), left({canon}, 4))')} = 1"
    checked = f"get(transform(array(substr(p, 3)), b -> concat(lpad(CAST(98 - {_mod97(f'concat(b, left({canon}, 2), \'00\')')} AS STRING), 2, '0'), b)), 0)"
    iban = f"concat(left({canon}, 2), get(transform(array({plain}), p -> CASE WHEN {right} THEN {checked} ELSE p END), 0))"
    return (
        f"CASE WHEN {kind} IN ('email', 'domain') THEN {email} WHEN {kind} = 'secret' THEN {secret} WHEN {kind} = 'ip' THEN {ip} WHEN {kind} = 'card' THEN {card} "
        rf"WHEN {kind} = 'name' AND {canon} rlike '^[\\u0041-\\u024F ’\'-]+$' THEN {latin} WHEN {kind} = 'iban' THEN {iban} ELSE {plain} END"
    )


def _laid(kind: str, m: str, canon: str, drawn: str, seed: str) -> str:
    """The surrogate ``drawn`` in the format of the mention ``m``."""
    # separators stay, the others are counted from the end; of a phone number's digits before the canonical ones, a country code stays
    rest = f"substr({m}, i + 1)"
    place = f"length({drawn}) + 1 - length(CASE WHEN {kind} = 'iban' THEN replace({rest}, ' ', '') ELSE regexp_replace({rest}, '[^0-9]', '') END)"
    lead = f"length(regexp_extract({m}, '^[+][0-9]{{1,3}}(?=[ .(-])', 0))"
    early = f"CASE WHEN i < {lead} THEN c ELSE CAST(pmod(xxhash64({seed}, p), 10) AS STRING) END"
    digits = f"array_join(transform(split({m}, ''), (c, i) -> CASE WHEN c = ' ' OR {kind} <> 'iban' AND NOT c rlike '[0-9]' THEN c ELSE get(transform(array({place}), p -> CASE WHEN p > 0 THEN substr({drawn}, p, 1) ELSE {early} END), 0) END), '')"
    title = f"regexp_extract({m}, {_q('^' + TITLE)}, 0)"
    cased = f"get(transform(array(CASE WHEN {kind} = 'name' THEN substr({m}, length({title}) + 1) ELSE {m} END), b -> array_join(transform(split({drawn}, ''), (c, i) -> CASE WHEN substr(b, i + 1, 1) = substr({canon}, i + 1, 1) THEN c ELSE upper(c) END), '')), 0)"
    return (
        f"CASE WHEN {kind} = 'ip' THEN {drawn} WHEN {kind} = 'secret' THEN concat(left({m}, length({m}) - length({canon})), {drawn}) WHEN {kind} = 'email' THEN {cased} "
        f"WHEN {kind} = 'name' THEN concat({title}, CASE WHEN {drawn} <> lower({drawn}) THEN {drawn} ELSE {cased} END) ELSE {digits} END"
    )


def _seed(kind: str, canon: str, gender: str, attempt: str, key: str) -> str:
    return f"sha2(concat({key}, '|', {kind}, '|', {canon}, '|', {gender}, '|', CAST({attempt} AS STRING)), 256)"


def _mentions(t: Column) -> Column:
    """Matches of a text; none where no digit, at sign, beginning of a secret or title is."""
    return F.when(t.rlike(rf"[0-9@]|AKIA|(?i:token|secret|password|passwd|api[_-]?key) ?[=:]|\b(?:{MALE}|{FEMALE}|{NEUTRAL})\.? \p{{Lu}}"), F.regexp_extract_all(t, F.lit(SEARCH), F.lit(0))).otherwise(F.array().cast("array<string>"))


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct entities of the corpus as their mentions tell them: ``kind, canon, gender``."""
    found = docs.select(F.explode(_mentions(docs[text_col].cast("string"))).alias("m")).groupBy("m").agg(F.lit(1).alias("one"))
    named = found.select("m", F.expr(_type("m")).alias("kind")).select("m", "kind", F.expr(_canonical("kind", "m")).alias("canon"))
    each = named.select("kind", "canon", F.expr(_gender("kind", "m", "canon")).alias("gender"))
    return each.select(F.explode(F.expr(f"array_compact(array(struct(kind, canon, gender), IF(kind = 'email', struct('domain' AS kind, {_domain('canon')} AS canon, '' AS gender), NULL)))")).alias("e")).select("e.*").distinct()


def redrawn(docs: DataFrame, key: str, text_col: str = "text", rounds: int = 50) -> DataFrame:
    """``kind, canon, gender, as_gender, attempt`` of the entities whose first surrogates collide or whose gender other mentions tell.

    Mail addresses are compared within their own domain, domains among each
    other. A type whose values fill more than about half of their space may
    still hold equal surrogates after ``rounds`` draws. That concerns types of a
    fixed format alone, and only the few of them that are left then: 10^9 social
    security numbers, 10^10 phone numbers, 3.2 * 10^9 addresses, and secrets, cards
    and accounts of their own length. Mail addresses, domains and names grow.
    """
    k = _q(key)
    every = cut(entities(docs, text_col))
    known = every.where("gender in ('m', 'f')").groupBy("kind", "canon").agg(F.min("gender").alias("known"))
    every = cut(every.join(known, ["kind", "canon"], "left").select("kind", "canon", "gender", F.expr("IF(gender = 'n', coalesce(known, 'n'), gender)").alias("as_gender")))
    drawn = every.select("kind", "canon", F.col("as_gender").alias("gender")).distinct().withColumn("attempt", F.lit(0))
    for attempt in range(1, rounds + 1):
        seeded = drawn.withColumn("seed", F.expr(_seed("kind", "canon", "gender", "attempt", k)))
        made = cut(seeded.select("kind", "canon", "gender", "attempt", F.expr(_drawn("kind", "canon", "gender", "seed", "attempt")).alias("s")))  # the long expression is in one plan only
        made = made.withColumn("s", F.expr("IF(kind = 'name', lower(s), s)"))
        first = made.groupBy("kind", "s").agg(F.min(F.struct("attempt", "canon", "gender")).alias("best"), F.count("*").alias("n")).where("n > 1").select("kind", "s", F.col("best.canon").alias("stays"), F.col("best.gender").alias("as"))
        clash = made.join(first, ["kind", "s"]).where("canon <> stays or gender <> as").select("kind", "canon", "gender")
        real = made.where(f"attempt < {GROW} or kind in ('email', 'domain', 'name')").join(every.select("kind", F.col("canon").alias("s")), ["kind", "s"], "left_semi").select("kind", "canon", "gender")
        again = cut(clash.union(real).distinct())
        if again.isEmpty() or attempt == rounds:
            last = drawn.withColumnRenamed("gender", "as_gender")
            return every.join(last, ["kind", "canon", "as_gender"]).where("attempt > 0 or gender <> as_gender").select("kind", "canon", "gender", "as_gender", "attempt")
        drawn = cut(drawn.join(again.withColumn("again", F.lit(True)), ["kind", "canon", "gender"], "left").select("kind", "canon", "gender", F.when(F.col("again"), F.lit(attempt)).otherwise(F.col("attempt")).alias("attempt")))
    raise ValueError("rounds must be positive")


def replace_personal_data(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in its text, and ``n_entities`` (mentions replaced).

    Null and empty texts stay as they are, with 0 mentions. Repeated rows are
    treated alike; other columns are kept (``n_entities`` is replaced). An empty
    table gives no rows.
    """
    k = _q(key)
    again = redrawn(docs, key, text_col)
    few = again.limit(LITERAL_ENTITIES + 1).collect()
    names = [c for c in docs.columns if c != "n_entities"]
    df = docs.select(*names).withColumn("__t", F.col(text_col).cast("string"))
    df = df.withColumn("__m", _mentions(F.coalesce("__t", F.lit(""))))
    found = lambda name: "CAST(NULL AS STRING)"
    if 0 < len(few) <= LITERAL_ENTITIES:
        pairs = ", ".join(f"{_q(f'{r.kind}|{r.canon}|{r.gender}')}, {_q(f'{r.as_gender}|{r.attempt}')}" for r in few)
        found = lambda name: f"element_at(map({pairs}), {name})"
    elif few:
        df = df.withColumns({"__k1": F.xxhash64(F.coalesce("__t", F.lit(""))), "__k2": F.xxhash64(F.lit(3), F.coalesce("__t", F.lit("")))})
        each = df.select("__k1", "__k2", F.explode("__m").alias("m")).distinct().select("__k1", "__k2", "m", F.expr(_type("m")).alias("kind"))
        each = each.withColumn("canon", F.expr(_canonical("kind", "m"))).withColumn("gender", F.expr(_gender("kind", "m", "canon"))).drop("m")
        each = each.unionByName(each.where("kind = 'email'").select("__k1", "__k2", F.lit("domain").alias("kind"), F.expr(_domain("canon")).alias("canon"), "gender")).distinct().join(again, ["kind", "canon", "gender"])
        per_text = each.groupBy("__k1", "__k2").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "canon", "gender"), F.concat_ws("|", "as_gender", "attempt")))).alias("__again"))
        df = df.join(per_text, ["__k1", "__k2"], "left")
        found = lambda name: f"element_at(__again, {name})"
    # mention -> kind -> canon -> gender -> (gender and attempt) -> seed -> domain -> drawn: one lambda variable after the other, each worked out once
    step = "transform(__m, m -> named_struct('m', m, 'kind', " + _type("m") + "))"
    had = ["m", "kind"]
    drawn_domain = f"get(transform(array(coalesce({found('concat(\'domain|\', {0}, \'|\')')}, '|0')), n -> get(transform(array({_seed(_q('domain'), '{0}', _q(''), 'substring_index(n, \'|\', -1)', k)}), z -> {_drawn(_q('domain'), '{0}', _q(''), 'z', 'CAST(substring_index(n, \'|\', -1) AS INT)')}), 0)), 0)".replace("{0}", "x.host")
    for name, value in (
        ("canon", _canonical("x.kind", "x.m")),
        ("gender", _gender("x.kind", "x.m", "x.canon")),
        ("found", f"coalesce({found('concat(x.kind, \'|\', x.canon, \'|\', x.gender)')}, concat(x.gender, '|0'))"),
        ("seed", _seed("x.kind", "x.canon", "substring_index(x.found, '|', 1)", "substring_index(x.found, '|', -1)", k)),
        ("host", _domain("x.canon")),
        ("domain", f"CASE WHEN x.kind = 'email' THEN {drawn_domain} END"),
        ("drawn", _drawn("x.kind", "x.canon", "substring_index(x.found, '|', 1)", "x.seed", "CAST(substring_index(x.found, '|', -1) AS INT)", "x.domain")),
    ):
        step = f"transform({step}, x -> named_struct({', '.join(f'{_q(h)}, x.{h}' for h in had)}, {_q(name)}, {value}))"
        had.append(name)
    made = f"transform({step}, x -> {_laid('x.kind', 'x.m', 'x.canon', 'x.drawn', 'x.seed')})"
    new = F.when(F.size("__m") > 0, F.expr(f"array_join(zip_with(split(__t, {_q(SEARCH)}, -1), {made}, (gap, s) -> concat(gap, coalesce(s, ''))), '')")).otherwise(F.col("__t"))
    df = df.withColumns({text_col: new, "n_entities": F.size("__m").cast("long")})
    return df.select(*names, "n_entities")
