"""Secret scan: assignments are lexed to name-literal pairs, constants are propagated, names and literals are scored.

Patterns give the base spans. Beyond them a lexer reads lines that hold an assignment or a key with a value, in source
or configuration syntax: ``name = "literal"``, ``"name": 'literal'``, ``export NAME=value``, ``name: value``. The right
side may join literals and earlier names by ``+``; a name stands for the literals it was given, so a literal that
reaches a sensitive name through other names is reported where it is written. The score of a literal is the weight of
the most sensitive target name and how random its characters are.

Each text is scanned alone in Arrow batches, line by line; memory is bounded by the longest text and its constants.

Odd input: a null or empty text has no spans; rows repeat as they come; other columns pass through, and an output column
replaces an input column of its name.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainwright.llm.batches import append
from chainwright.llm.common import hex_digest

KINDS = ("assign", "access", "hex", "literal")
BASE = 3
KEEP = 0.6
#: Characters of text in one batch.
BATCH_CHARS = 4_000_000
MIN_LITERAL = 6
SPAN = T.ArrayType(
    T.StructType(
        [T.StructField(n, k) for n, k in (("start", T.IntegerType()), ("order", T.IntegerType()), ("end", T.IntegerType()), ("kind", T.StringType()), ("name", T.StringType()), ("score", T.DoubleType()))]
    )
)

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: A run of 20 and of 24 characters at least is the same as a longest run that is tested afterwards.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

NAME = re.compile(r"""(?<![A-Za-z0-9_$.\-])(?P<quote>["']?)(?P<name>[A-Za-z_$][A-Za-z0-9_$.\-]*+)(?P=quote)(?:\x20*:\x20*[A-Za-z_][A-Za-z0-9_\[\], ]{0,60}?)?\x20*(?P<sign>:=|=(?![=>])|:(?![:/]))\x20*""")
TERM = re.compile(r"""\x20*(?:[fFrRbBuU]{0,2}(?P<quote>["'`])(?P<text>(?:[^"'`\\\n]|\\.|(?!(?P=quote))["'`])*)(?P=quote)|(?P<word>[A-Za-z0-9_$+/.=~-]+))""")
JOIN = re.compile(r"\x20*[+.]\x20*")
#: Parts of names and how sensitive they are.
WEIGHTS = {
    "password": 0.6, "passwd": 0.6, "passphrase": 0.6, "pwd": 0.5, "secret": 0.6, "token": 0.5, "apikey": 0.6, "credential": 0.5, "privatekey": 0.6,
    "accesskey": 0.6, "auth": 0.4, "signature": 0.3, "bearer": 0.5, "cookie": 0.3, "session": 0.3, "key": 0.3, "salt": 0.3,
}


def name_weight(name: str) -> float:
    """The weight of the most sensitive part of a name, whatever its case and separators."""
    flat = re.sub(r"[^a-z]", "", name.lower())
    return max((w for part, w in WEIGHTS.items() if part in flat), default=0.0)


def randomness(literal: str) -> float:
    """0 to 0.4: entropy of the characters, less for words, paths and placeholders."""
    if len(literal) < MIN_LITERAL or re.search(r"(?i)example|changeme|placeholder|your[_-]|xxxx|\$\{|<|\s", literal):
        return 0.0
    n = len(literal)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    kinds = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return 0.4 * min(1.0, bits / 3.5) * (1.0 if kinds >= 2 else 0.5)


def lex(text: str) -> list[tuple[int, int, str, float]]:
    """Literals as (start, end, target name, score), each with its best-scoring name.

    An assignment is a node that points to the literals and the earlier assignments on its right side. Going back over
    the nodes hands the best name of each to what it points to, so the work is linear in the text.
    """
    latest: dict[str, int] = {}
    names: list[tuple[float, str]] = []
    uses: list[list[int]] = []
    literals: list[list[tuple[int, int, str]]] = []
    after = 0
    for line in text.split("\n"):
        base, at, after = after, 0, after + len(line) + 1
        while ("=" in line or ":" in line) and (p := NAME.search(line, at)):
            at = p.end()
            used, written = [], []
            while m := TERM.match(line, at):
                if m["quote"]:
                    written.append((base + m.start("text"), base + m.end("text"), m["text"]))
                elif m["word"] in latest:
                    used.append(latest[m["word"]])
                else:
                    written.append((base + m.start("word"), base + m.end("word"), m["word"]))
                at = m.end()
                if not (j := JOIN.match(line, at)):
                    break
                at = j.end()
            latest[p["name"]] = len(names)
            names.append((name_weight(p["name"]), p["name"]))
            uses.append(used)
            literals.append(written)
    best: dict[tuple[int, int], tuple[float, str]] = {}
    for i in range(len(names) - 1, -1, -1):
        weight, name = names[i]
        if weight:
            for j in uses[i]:
                names[j] = max(names[j], names[i], key=lambda x: x[0])
            for start, end, literal in literals[i]:
                random = randomness(literal)
                if random and weight + random > best.get((start, end), (0.0, ""))[0]:
                    best[start, end] = (weight + random, name)
    return [(s, e, name, score) for (s, e), (score, name) in best.items()]


def scan(text: str | None) -> list[dict]:
    """All spans of one text by start and kind; base spans first by rule, literals if their score reaches KEEP."""
    if not text:
        return []
    spans = [(m.start(), 0, m.end(), "assign", m[0], 1.0) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    spans += [(m.start(), 1, m.end(), "access", "", 1.0) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end(), "hex", "", 0.8) for m in HEX.finditer(text)]
    if "=" in text or ":" in text:
        spans += [(s, 3, e, "literal", name, round(score, 3)) for s, e, name, score in lex(text) if score >= KEEP]
    spans.sort()
    return [dict(zip(("start", "order", "end", "kind", "name", "score"), s, strict=True)) for s in spans]


def find_secrets(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """Add ``out``: spans in code points as array of (start, order, end, kind, name, score)."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("order", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("score", pa.float64())]))
    return append(df, text, [T.StructField(out, SPAN)], lambda values: [pa.array([scan(x) for x in values.to_pylist()], kind)], BATCH_CHARS)


def digest(found: DataFrame, key: str = "doc_id", secrets: str = "secrets") -> DataFrame:
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(secrets, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        key,
        *[count(k) for k in KINDS[:BASE]],
        hex_digest(joined(F.filter(secrets, lambda s: s["order"] < BASE))).alias("base_sha256"),
        joined(F.col(secrets)).alias("spans"),
    )


def op4_secrets(spark, folder: str) -> DataFrame:
    """Secrets in every text of ``documents``."""
    return digest(find_secrets(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")).drop("text"))
