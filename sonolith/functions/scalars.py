"""Column functions: missing values, labels, text keys, vectors, portable pseudo-random draws. Built-in expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("control", "mild", "moderate", "severe")  # fixed values: the ordinal scale, from 0


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def present(c: Column) -> Column:
    """Text or null: empty, blank and ``nan`` (any case) mean missing."""
    text = F.trim(c.cast("string"))
    return F.when(~F.lower(text).isin("", "nan"), text)


def number(c: Column) -> Column:
    """Double or null: what is missing, unparsable or NaN is null."""
    x = present(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def null_if_missing(df: DataFrame, numbers: list[str] = (), texts: list[str] = (), unknown_levels: list[str] = ()) -> DataFrame:
    """All spellings of a missing value turned into null; in ``unknown_levels`` also negative codes."""
    new = {c: number(F.col(c)) for c in numbers} | {c: present(F.col(c)) for c in texts}
    new |= {c: let(number(F.col(c)), lambda x: F.when(x >= 0, x.cast("int"))) for c in unknown_levels}
    return df.withColumns(new)


def severity_from_pct(pct: Column) -> Column:
    """Level by intelligibility in per cent; null stays null."""
    return F.when(pct > 94, "control").when(pct >= 85, "mild").when(pct >= 70, "moderate").when(pct.isNotNull(), "severe")


def canonical_severity(raw: Column, pct: Column, names: dict[str, str]) -> Column:
    """The level of ``pct`` if there is one; else the raw label mapped (case and outer blanks ignored), unmapped labels as they are, missing ones ``unknown``."""
    folded = F.lower(present(raw))
    mapped = reduce(lambda acc, kv: F.when(folded == kv[0], kv[1]).otherwise(acc), names.items(), F.trim(raw)) if names else F.trim(raw)
    return F.coalesce(severity_from_pct(pct), F.when(present(raw).isNotNull(), mapped), F.lit("unknown"))


def severity_ordinal(label: Column) -> Column:
    """Place on ``LEVELS``; null for every other label."""
    folded = F.lower(F.trim(label))
    return reduce(lambda acc, kv: acc.when(folded == kv[1], kv[0]), enumerate(LEVELS), F.when(F.lit(False), 0))


def clean_transcript(text: Column) -> Column:
    """Without ``.,;:!?"()[]{}`` and dashes; apostrophes stay; runs of blanks become one."""
    return F.trim(F.regexp_replace(F.translate(text, '.,;:!?"()[]{}—–-', ""), r"\s+", " "))


def stem(path: Column) -> Column:
    """File name without folders and without its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def safe_key(key: Column) -> Column:
    """For file names only; joins use the key itself."""
    return F.regexp_replace(key, r"[/\\ ]", "_")


def normalise_group(group: Column, is_control: Column) -> Column:
    """Upper case; missing is UNKNOWN; controls are CONTROL."""
    return F.when(is_control, "CONTROL").otherwise(F.upper(F.coalesce(present(group), F.lit("unknown"))))


def composite(cols: list[Column], min_present: int = 3) -> Column:
    """Mean of the values that are there; null where fewer than ``min_present`` are."""
    return let(F.filter(F.array(*cols), lambda x: x.isNotNull() & ~F.isnan(x)), lambda xs: F.when(F.size(xs) >= min_present, F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)))


def dot(a: Column, b: Column) -> Column:
    """In double precision whatever the elements are."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_sum(vectors: Column) -> Column:
    """Element-wise sum of an array of arrays, in double precision; null of none."""
    first = F.transform(F.get(vectors, F.lit(0)), lambda x: x.cast("double"))
    return F.aggregate(F.slice(vectors, F.lit(2), F.size(vectors)), first, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, guard: float = 1e-8) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + guard)


def unit(a: Column, least: float = 1e-8) -> Column:
    """Null where the norm is under ``least``."""
    return let(norm(a), lambda n: F.when(n >= least, F.transform(a, lambda x: x / n)))


def cosine_complete(a: Column, b: Column, min_dims: int = 3) -> Column:
    """Cosine over the dimensions that both sides have; null where fewer than ``min_dims`` do, or where a side is zero."""
    pairs = F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    total = lambda p, f: F.aggregate(p, F.lit(0.0), lambda s, q: s + f(q))
    return let(pairs, lambda p: F.when(F.size(p) >= min_dims, F.try_divide(total(p, lambda q: q["x"] * q["y"]), F.sqrt(total(p, lambda q: q["x"] * q["x"])) * F.sqrt(total(p, lambda q: q["y"] * q["y"])))))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def heron_area(p1: Column, p2: Column, p3: Column) -> Column:
    """Area of the triangle of three points in any number of dimensions."""

    def area(t: Column) -> Column:
        s = (t["a"] + t["b"] + t["c"]) / 2
        return F.sqrt(F.greatest(F.lit(0.0), s * (s - t["a"]) * (s - t["b"]) * (s - t["c"])))

    return let(F.struct(distance(p1, p2).alias("a"), distance(p2, p3).alias("b"), distance(p3, p1).alias("c")), area)


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p.isNotNull(), "ns")


#: Where effect sizes change their name.
ETA_CUTS = ((0.14, "large"), (0.06, "medium"))
DELTA_CUTS = ((0.474, "large"), (0.33, "medium"), (0.147, "small"))


def magnitude(x: Column, cuts: tuple[tuple[float, str], ...], least: str, inclusive: bool = True) -> Column:
    """Name of the first cut that ``abs(x)`` reaches (``inclusive``) or passes; ``least`` under all of them."""
    size = F.abs(x)
    over = (lambda c: size >= c) if inclusive else (lambda c: size > c)
    out = F.when(x.isNull(), None)
    for cut, name in cuts:
        out = out.when(over(cut), name)
    return out.otherwise(least)


MODULUS = 2_147_483_647


def draw(a: Column | int, b: Column | int, seed: int = 0) -> Column:
    """Pseudo-random integer below ``MODULUS`` from two keys: the same in any engine and any order of rows.

    A linear step, then the fifth power, which permutes the residues; twice, so that both keys are mixed.
    """

    def once(x: Column) -> Column:
        y = (x * 48_271 + 11) % MODULUS
        square = (y * y) % MODULUS
        return ((square * square) % MODULUS * y) % MODULUS

    key = lambda c: c.cast("long") if isinstance(c, Column) else F.lit(c).cast("long")
    return once((once(key(a) * 131 + seed) + key(b) * 1_000_003) % MODULUS)


def draw_sql(a: str, b: str, seed: int = 0) -> str:
    """The same number in DuckDB SQL."""
    once = lambda x: f"(SELECT q * q % {MODULUS} * y % {MODULUS} FROM (SELECT y, y * y % {MODULUS} AS q FROM (SELECT (({x}) * 48271 + 11) % {MODULUS} AS y)))"
    return once(f"({once(f'CAST({a} AS BIGINT) * 131 + {seed}')} + CAST({b} AS BIGINT) * 1000003) % {MODULUS}")
