r"""Personal data by regular expressions, checksum validators and context words, in DataFrame functions only.

Patterns propose spans, validators confirm them (address parts, Luhn, mod-97, digit counts), and words near a span
move its score. Matching is leftmost and non-overlapping per kind; a span that fails its validator is dropped and
its characters are not tried again. Offsets are code points, end exclusive.

Offsets without a UDF: ``split`` and ``regexp_extract_all`` on the same pattern give the pieces between matches and
the matches, so the start of match i is the length of all pieces up to i and all matches before i. Prefix sums are
taken over blocks, so that a text with very many matches does not cost their square.

Repetitions are possessive where what follows cannot match inside them (this changes no match, and keeps the
matcher from recursing or backtracking on very long runs), and a run of address characters is entered only at its
start or where the last match ended, which is where a leftmost match can begin.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_of, let

BLOCK = 64
CONTEXT_CHARS = 40


@dataclass(frozen=True)
class Kind:
    """``hint``: a cheap pattern without which there can be no valid span. ``valid``: of the matched string. ``base``: kept at any score."""

    name: str
    pattern: str
    hint: str
    valid: object
    base: bool
    score: float
    context: str


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn check of a string of at least one ASCII digit."""
    n = F.length(digits)
    place = lambda i: F.substr(digits, n - i, F.lit(1)).cast("int")  # noqa: E731  i-th digit from the right
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 1, twice(place(i))).otherwise(place(i)))
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """ISO 13616: country and check digits moved to the end, letters as two digits (A = 10), remainder 1 modulo 97."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return let(turned, lambda t: F.aggregate(
        F.sequence(F.lit(1), F.length(t)), F.lit(0),
        lambda acc, i: let(value(F.substr(t, i, F.lit(1))), lambda v: (acc * F.when(v < 10, 10).otherwise(100) + v) % 97),
    )) == 1


PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: In the order in which spans with the same start are listed.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@[A-Za-z0-9-]", lambda m: F.lit(True), True, 0.9, "mail|contact|write|kontakt|correo|courriel"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", lambda m: m.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$"), True, 0.6, r"\bip\b|address|host|server|adresse|direcci"),
    Kind("card", "[0-9](?:[\x20-]?[0-9])++", "[0-9](?:[\x20-]?[0-9]){13}", lambda m: let(_digits(m), lambda d: F.length(d).between(14, 19) & luhn(d)), True, 0.7, "card|visa|credit|payment|karte|carte|tarjeta"),
    Kind("phone", "\\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", lambda m: F.length(_digits(m)).between(10, 15), True, 0.6, "phone|call|tel|mobile|fax|anruf|appel"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4} ?[A-Z0-9]{4}", lambda m: F.length(F.regexp_replace(m, " ", "")).between(15, 34) & mod97(m), False, 0.6, "iban|account|bank|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), False, 0.3, r"\bssn\b|social security"),
)
CONTEXT_GAIN, LEAST_SCORE = 0.3, 0.5
SPAN = "array<struct<start:int,kind_no:int,end:int,kind:string,score:double>>"


def _total(lengths: Column, n: Column) -> Column:
    return F.aggregate(F.slice(lengths, F.lit(1), n), F.lit(0), lambda acc, x: acc + x)


def _ends(lengths: Column) -> Column:
    """Running totals of an array of integers, by blocks: element i is the sum of the first i elements (i from 0)."""
    n_blocks = F.floor(F.size(lengths) / BLOCK).cast("int") + 1
    sums = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: F.aggregate(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda acc, x: acc + x))
    before = lambda s: F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: _total(s, b))

    def at(starts: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(lengths)), lambda i: let(F.floor(i / BLOCK).cast("int"), lambda b: F.get(starts, b) + F.aggregate(F.slice(lengths, b * BLOCK + 1, i % BLOCK), F.lit(0), lambda acc, x: acc + x)))

    return let(let(sums, before), at)


def _spans_of(text: Column, kind: Kind, no: int) -> Column:
    """All valid spans of one kind; an empty array without the hint, so that most texts cost one scan."""
    pattern = F.lit(kind.pattern)

    def build(x: Column) -> Column:
        lengths = F.flatten(F.zip_with(x["pieces"], x["found"], lambda p, m: F.array(F.length(p), F.coalesce(F.length(m), F.lit(0)))))
        chosen = F.filter(F.transform(x["found"], lambda m, i: F.when(kind.valid(m), i)), lambda i: i.isNotNull())

        def spans(y: Column) -> Column:
            def one(i: Column) -> Column:
                start, end = F.get(y["ends"], 2 * i + 1), F.get(y["ends"], 2 * i + 2)
                near = F.concat_ws(" ", F.right(F.get(x["pieces"], i), F.lit(CONTEXT_CHARS)), F.left(F.get(x["pieces"], i + 1), F.lit(CONTEXT_CHARS)))
                score = F.lit(kind.score) + F.when(F.lower(near).rlike(kind.context), CONTEXT_GAIN).otherwise(0.0)
                return F.struct(start.alias("start"), F.lit(no).alias("kind_no"), end.alias("end"), F.lit(kind.name).alias("kind"), F.least(score, F.lit(1.0)).alias("score"))

            return F.transform(y["chosen"], one)

        found = let(F.struct(chosen.alias("chosen")), lambda c: F.when(F.size(c["chosen"]) == 0, F.array().cast(SPAN)).otherwise(let(F.struct(c["chosen"].alias("chosen"), let(lengths, _ends).alias("ends")), spans)))
        return found if kind.base else F.filter(found, lambda s: s["score"] >= LEAST_SCORE)

    both = F.struct(F.split(text, kind.pattern, -1).alias("pieces"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"))
    return F.when(text.rlike(kind.hint), let(both, build)).otherwise(F.array().cast(SPAN))


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``doc_id`` and ``found``: all spans by start, then kind, each with its score (base kinds at any score, the others from 0.5).

    One row per input row, ids may repeat or be null; a null text is empty and has no spans; an empty table gives no
    rows. Only the id and the text are read. No shuffle: one scan, every text whole.
    """
    spans = [_spans_of(F.col("text"), k, no) for no, k in enumerate(kinds)]
    return documents_of(docs, id_col, text_col).select("doc_id", F.array_sort(F.concat(*spans)).alias("found"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by its kind in angle brackets (overlapping spans: the earlier one wins).

    One row per input row with all columns; null texts become empty ones, texts without a span stay as they are, empty
    ones too. An empty table gives an empty table.
    """
    plain = F.coalesce(F.col(text_col), F.lit(""))
    spans = F.array_sort(F.concat(*[_spans_of(plain, k, no) for no, k in enumerate(KINDS)]))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(F.concat(acc["out"], F.substr(plain, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">")).alias("out"), s["end"].alias("at")))
    return docs.withColumn(text_col, F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(plain, acc["at"] + 1))))


def personal_data_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts of the base kinds, the hash of the listed base spans, and all spans listed as kind:start:end."""
    base = [k.name for k in KINDS if k.base]
    found = find_personal_data(docs, id_col, text_col)
    of = lambda name: F.size(F.filter("found", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    return found.select("doc_id", *[of(k) for k in base], F.sha2(_listed(F.filter("found", lambda s: s["kind"].isin(base))).cast("binary"), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"))
