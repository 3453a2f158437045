"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Everything is a column expression on the row itself: no shuffle, no state, any partitioning. The text is cut at the
matches of a pattern; the running sums of the lengths of the pieces are the positions. Quantifiers are possessive and a
pattern starts only where a run starts, so a long run without a match costs one pass.

Odd input: a null or empty text has no spans; overlapping spans of different kinds are all reported; equal rows give
equal results; other columns pass through, and an output column replaces an input column of its name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainwright.llm.common import attach, hex_digest, release, starts

LOCAL = r"[A-Za-z0-9._%+-]"
#: Characters before and after a span in which context words count.
NEAR_BEFORE, NEAR_AFTER = 40, 20
KEEP = 0.5


@dataclass(frozen=True)
class Kind:
    """A kind of span: ``gate`` is a text that every match holds; ``base`` spans are kept whatever their score."""

    name: str
    pattern: str
    gate: str
    prior: float
    words: str
    base: bool = False


KINDS = (
    Kind("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact", True),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, r"\bip\b|host|address|server", True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.7, "card|visa|credit|payment", True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, "phone|tel|call|mobile", True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", 0.6, "iban|account|bank", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, "ssn|social security|tax id", False),
)
ORDER = [k.name for k in KINDS]


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Luhn check of a string of digits: every second digit from the right is doubled and its digits are summed."""
    marks = F.split(F.reverse(number), "")
    total = F.aggregate(
        F.transform(marks, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.translate(d, "0123456789", "0246813579")).cast("int")), F.lit(0), lambda a, d: a + d
    )
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """ISO 7064 check: the first four characters go last, letters count from 10, the remainder is 1."""
    moved = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))
    codes = F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    return F.aggregate(codes, F.lit(0), lambda a, v: F.when(v < 10, a * 10 + v).otherwise(a * 100 + v) % 97) == 1


def confirmed(kind: str, text: Column) -> Column:
    """Whether the checks of the kind hold for a match."""
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[1-9])?(?<=[0-9])"
        return text.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        number = digits(text)
        return F.when(F.char_length(number).between(12, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.char_length(digits(text)).between(9, 15)
    if kind == "iban":
        account = F.regexp_replace(text, " ", "")
        return F.when(F.char_length(account).between(15, 34), mod97(account)).otherwise(False)
    if kind == "ssn":
        return ~text.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _pieces(df: DataFrame, kind: Kind) -> DataFrame:
    """Columns ``_gaps`` and ``_hits``: the text between the matches, one more than the matches themselves."""
    text = F.coalesce("_text", F.lit(""))
    worth = text.contains(kind.gate) if kind.gate else text.rlike("[0-9]{2}|[0-9][ -][0-9]")
    return df.withColumn("_gaps", F.when(worth, F.split(text, kind.pattern, -1)).otherwise(F.array(F.lit("")))).withColumn(
        "_hits", F.when(worth, F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    )


def _of_kind(df: DataFrame, kind: Kind, out: str) -> DataFrame:
    df = _pieces(df, kind)
    df = df.withColumn("_lengths", F.transform("_hits", lambda h, i: (F.char_length(F.get("_gaps", i)) + F.char_length(h)).cast("long")))
    df = starts(df, "_lengths", "_from")
    near = lambda i: F.lower(F.concat(F.right(F.get("_gaps", i), F.lit(NEAR_BEFORE)), F.lit(" "), F.left(F.get("_gaps", i + 1), F.lit(NEAR_AFTER))))
    span = lambda h, i: F.struct(
        (F.get("_from", i) + F.char_length(F.get("_gaps", i))).alias("start"),
        F.lit(ORDER.index(kind.name)).alias("order"),
        (F.get("_from", i) + F.char_length(F.get("_gaps", i)) + F.char_length(h)).alias("end"),
        F.lit(kind.name).alias("kind"),
        h.alias("text"),
        F.when(near(i).rlike(kind.words), F.lit(min(1.0, kind.prior + 0.3))).otherwise(F.lit(kind.prior)).alias("score"),
        confirmed(kind.name, h).alias("ok"),
    )
    kept = F.filter(F.transform("_hits", span), lambda s: s["ok"] & (F.lit(kind.base) | (s["score"] >= KEEP)))
    bare = F.transform(kept, lambda s: s.dropFields("ok"))
    return df.withColumn(out, bare).drop("_gaps", "_hits", "_lengths", "_from")


def find_pii(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Add ``out``: the spans as array of (start, order, end, kind, text, score), by start and then kind.

    Positions are code points, the end exclusive.
    """
    work = attach(df, [text]).withColumnRenamed("_0", "_text")
    for k in KINDS:
        work = _of_kind(work, k, f"_{k.name}")
    return release(work, {out: F.array_sort(F.concat(*[F.col(f"_{k}") for k in ORDER]))})


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace every span by its kind in angle brackets, one kind after the other; a null text stays null.

    A pass writes the pieces between the matches and the marks one after the other, so it needs no positions. A span
    that overlaps one of an earlier kind is gone with it, up to characters that no longer match.
    """
    work = attach(df, [text]).withColumnRenamed("_0", "_text")
    for k in (*[k for k in KINDS if k.name == "iban"], *[k for k in KINDS if k.name != "iban"]):
        work = _pieces(work, k)
        mark = F.lit(f"<{k.name.upper()}>")
        near = lambda i: F.lower(F.concat(F.right(F.get("_gaps", i), F.lit(NEAR_BEFORE)), F.lit(" "), F.left(F.get("_gaps", i + 1), F.lit(NEAR_AFTER))))
        sure = lambda h, i, k=k: confirmed(k.name, h) & (F.lit(k.base or k.prior >= KEEP) | near(i).rlike(k.words))
        marked = F.transform("_hits", lambda h, i: F.concat(F.get("_gaps", i), F.when(sure(h, i), mark).otherwise(h)))
        whole = F.concat(F.array_join(marked, ""), F.element_at("_gaps", -1))
        work = work.withColumn("_text", F.when(F.size("_hits") > 0, whole).otherwise(F.col("_text"))).drop("_gaps", "_hits")
    return release(work, {text: F.col("_text")})


def digest(df: DataFrame, key: str = "doc_id", pii: str = "pii") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and the joined spans of ``find_pii``."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = [k.name for k in KINDS if k.base]
    count = lambda kind: F.size(F.filter(pii, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return df.select(
        key,
        *[count(k) for k in base],
        hex_digest(joined(F.filter(pii, lambda s: s["order"] < len(base)))).alias("base_sha256"),
        joined(F.col(pii)).alias("spans"),
    )


def op1_pii(spark, folder: str) -> DataFrame:
    """All spans of personal data in every text of ``documents``."""
    return digest(find_pii(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")))


def _sql() -> str:
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
        "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    }
    number = "regexp_replace(h, '[^0-9]', '', 'g')"
    account = "replace(h, ' ', '')"
    luhn_sql = (
        f"list_sum(list_transform(range(1, len({number}) + 1), lambda j: CASE WHEN (len({number}) - j) % 2 = 0 THEN {number}[j]::INT "
        f"ELSE (2 * {number}[j]::INT) // 10 + (2 * {number}[j]::INT) % 10 END)) % 10 = 0"
    )
    ends = f"({account}[5:] || {account}[1:4])"
    mod_sql = (
        f"list_reduce(list_prepend(0, list_transform(string_split({ends}, ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), "
        "lambda a, v: CASE WHEN v < 10 THEN (a * 10 + v) % 97 ELSE (a * 100 + v) % 97 END) = 1"
    )
    ok = {
        "email": "true",
        "ip": "len(list_filter(string_split(h, '.'), lambda q: length(ltrim(q, '0')) > 3 OR TRY_CAST(q AS INT) > 255)) = 0",
        "card": f"CASE WHEN len({number}) BETWEEN 12 AND 19 THEN {luhn_sql} ELSE false END",
        "phone": f"len({number}) BETWEEN 9 AND 15",
        "iban": f"CASE WHEN len({account}) BETWEEN 15 AND 34 THEN {mod_sql} ELSE false END",
        "ssn": "NOT regexp_matches(h, '^(000|666|9)|-00-|-0000$') AND near",
    }
    parts = []
    for i, k in enumerate(KINDS):
        p = patterns[k.name]
        parts.append(
            f"""SELECT r, {i} AS o, '{k.name}' AS kind, s AS "start", s + length(h) AS "end" FROM (
            SELECT r, h, list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda g: length(g))), 0) AS s,
              regexp_matches(lower(right(gaps[i], {NEAR_BEFORE}) || ' ' || left(gaps[i + 1], {NEAR_AFTER})), '{k.words}') AS near
            FROM (SELECT r, gaps, hits, i, hits[i] AS h FROM (
              SELECT r, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS hits FROM d
            ), unnest(range(1, len(hits) + 1)) AS u(i))) WHERE {ok[k.name]}"""
        )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(parts)}),
g AS (SELECT r, count(*) FILTER (o = 0) AS e, count(*) FILTER (o = 1) AS i, count(*) FILTER (o = 2) AS c, count(*) FILTER (o = 3) AS p,
  coalesce(string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", o) FILTER (o < 4), '') AS b,
  string_agg(kind || ':' || "start" || ':' || "end", ',' ORDER BY "start", o) AS a FROM s GROUP BY r)
SELECT doc_id, coalesce(e, 0) AS n_email, coalesce(i, 0) AS n_ip, coalesce(c, 0) AS n_card, coalesce(p, 0) AS n_phone,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans
FROM d LEFT JOIN g USING (r)"""


SQL = _sql()
