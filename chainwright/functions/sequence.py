"""Column expressions on sequences, identifiers and dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the composition features.
BASES = ("A", "U", "G", "C")
DINUCLEOTIDES = ("AU", "UA", "GC", "CG", "GU", "UG", "AA", "UU", "GG", "CC")

# Fixed patterns: a run unfit for file names, and the id in a FASTA header.
UNSAFE_RUN = r"[^A-Za-z0-9_.-]+"
HEADER_ID = r">([0-9][A-Za-z0-9]{3})_"


def split_row_id(row_id: Column) -> tuple[Column, Column]:
    """Target and residue number of ``<target>_<number>``; the target may hold underscores."""
    return F.regexp_extract(row_id, "^(.*)_([0-9]+)$", 1), F.regexp_extract(row_id, "^(.*)_([0-9]+)$", 2).cast("long")


def first_token_target(row_id: Column) -> Column:
    """The other convention: everything before the first underscore."""
    return F.substring_index(row_id, "_", 1)


def normalize_seq(text: Column) -> Column:
    """Upper case without whitespace or gap marks, T read as U."""
    return F.translate(F.regexp_replace(F.upper(text), r"[\s-]", ""), "T", "U")


def seq_digest(text: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def cluster_id(text: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), seq_digest(text, 16))


def safe_name(name: Column) -> Column:
    """Identifier usable as a file name; fails the job when nothing is left."""
    cleaned = F.regexp_replace(F.regexp_replace(name, UNSAFE_RUN, "_"), r"^[._]+|[._]+$", "")
    return F.when(F.length(cleaned) > 0, cleaned).otherwise(
        F.raise_error(F.concat(F.lit("identifier has no usable characters: "), F.coalesce(name, F.lit("NULL"))))
    )


def temporal_gate(release: Column, cutoff: Column) -> Column:
    """Strictly earlier than the cutoff; a missing or malformed date never passes."""
    return F.coalesce(F.try_to_date(release.cast("string")) < F.try_to_date(cutoff.cast("string")), F.lit(False))


def date_gate(release: Column, cutoff: Column) -> Column:
    """``temporal_gate`` for DATE columns, without the text parse, so that it can be pushed down."""
    return F.coalesce(release < cutoff, F.lit(False))


def length_gate(a: Column, b: Column) -> Column:
    """Relative length difference within 0.6 / 0.2 / 0.4 for short / long / other pairs."""
    difference = F.abs(a - b) / F.greatest(a, b)
    limit = (
        F.when(F.least(a, b) < 50, F.lit(0.6)).when(F.greatest(a, b) > 1000, F.lit(0.2)).otherwise(F.lit(0.4))
    )
    return difference <= limit


def kmers(seq: Column, k: int) -> Column:
    """All overlapping k-mers in order, in one linear pass over the text."""
    return F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def count_of(seq: Column, piece: str) -> Column:
    """Occurrences of a piece that cannot overlap itself."""
    return (F.length(seq) - F.length(F.replace(seq, F.lit(piece), F.lit("")))) / len(piece)


def overlapping_pair_count(seq: Column, pair: str) -> Column:
    """Overlapping occurrences of two letters; a run of n equal letters holds n - 1."""
    if pair[0] != pair[1]:
        return count_of(seq, pair)
    return count_of(seq, pair[0]) - count_of(F.regexp_replace(seq, f"{pair[0]}+", pair[0]), pair[0])


def composition(seq: Column) -> dict[str, Column]:
    """The composition features of a sequence except the repeat share."""
    n = F.greatest(F.length(seq), F.lit(1)).cast("double")
    share = {base: count_of(seq, base) / n for base in BASES}
    features = {f"f_{base.lower()}": share[base] for base in BASES}
    for pair in DINUCLEOTIDES:
        features[f"f_{pair.lower()}"] = F.when(
            F.length(seq) > 1, overlapping_pair_count(seq, pair) / (F.length(seq) - 1)
        ).otherwise(0.0)
    features["f_gc_share"] = (count_of(seq, "G") + count_of(seq, "C")) / n
    features["f_au_share"] = (count_of(seq, "A") + count_of(seq, "U")) / n
    features["f_purine"] = (count_of(seq, "A") + count_of(seq, "G")) / n
    features["f_pyrimidine"] = (count_of(seq, "U") + count_of(seq, "C")) / n
    features["f_length"] = F.least(F.length(seq) / 1000.0, F.lit(1.0))
    entropy = F.lit(0.0)
    for base in BASES:
        entropy = entropy - F.when(share[base] > 0, share[base] * F.log2(share[base])).otherwise(0.0)
    features["f_entropy"] = entropy / 2
    return features


def kmer_jaccard(a: Column, b: Column, k: int = 3) -> Column:
    """Shared over all distinct k-mers; 0 when either side has none."""
    left, right = F.array_distinct(kmers(a, k)), F.array_distinct(kmers(b, k))
    shared = F.size(F.array_intersect(left, right))
    return F.when(
        (F.size(left) > 0) & (F.size(right) > 0), shared / (F.size(left) + F.size(right) - shared)
    ).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays; NULL for a zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return dot / F.nullif(size(a) * size(b), F.lit(0.0))


def template_confidence(identity: Column, coverage: Column, completeness: Column) -> dict[str, Column]:
    """Product confidence and its ablations."""
    return {
        "conf_full": identity * coverage * completeness,
        "conf_no_completeness": identity * coverage,
        "conf_identity": identity,
        "conf_coverage": coverage,
    }


def stable_seed(*parts: Column) -> Column:
    """32-bit seed from the parts, equal in every process."""
    digest = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def draw(bound: Column, *parts: Column | str) -> Column:
    """Reproducible integer in [0, bound) from the parts; the same for any partitioning."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), bound)


def soft_label(a: Column, b: Column, scale: float, width: float) -> tuple[Column, Column]:
    """Sigmoid of the clipped, scaled difference a - b, and its confidence weight."""
    difference = a - b
    z = F.least(F.greatest(difference / scale, F.lit(-12.0)), F.lit(12.0))
    return 1.0 / (1.0 + F.exp(-z)), 0.25 + F.least(F.abs(difference) / width, F.lit(1.0))


def header_ids(text: Column) -> Column:
    """Distinct, sorted, upper-case four-character ids from FASTA headers."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(HEADER_ID), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda v: F.upper(v))))


def listed_ids(text: Column) -> Column:
    """Distinct, sorted, upper-case members of a ; or , separated list."""
    pieces = F.transform(F.split(F.coalesce(text, F.lit("")), "[;,]"), lambda p: F.upper(F.trim(p)))
    return F.array_sort(F.array_distinct(F.filter(pieces, lambda p: F.length(p) > 0)))


def not_excluded(own: Column, excluded: Column) -> Column:
    return ~F.array_contains(excluded, F.upper(own))


def bins(value: Column, edges: Sequence[float], labels: Sequence[str], right_closed: bool = True) -> Column:
    """Label of the first edge not exceeded; the last label takes the rest."""
    result = None
    for edge, label in zip(edges, labels):
        hit = value <= edge if right_closed else value < edge
        result = F.when(hit, F.lit(label)) if result is None else result.when(hit, F.lit(label))
    return result.otherwise(F.lit(labels[len(edges)])) if len(labels) > len(edges) else result
