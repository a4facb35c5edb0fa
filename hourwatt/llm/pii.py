"""Personal data by pattern, checksum and context, in column expressions only.

Patterns propose spans, validators confirm them (octet range, digit counts, Luhn, mod-97), and words next to a
span move its score. Spans of the four base kinds that pass their validator always stay, whatever their score;
the kinds this method adds (bank account numbers, social security numbers) need a score of ``KEEP`` or more.

Defined results: a null or empty text has no spans and stays as it is; repeated rows are treated row by row; every
other column of the input passes through untouched, except one called as the output is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourwatt.llm.scratch import without

# Kinds in their order, patterns, start scores and context words.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
# Possessive repeats and the look-behinds only keep the matcher from trying positions that cannot match; the
# leftmost non-overlapping matches are those of the plain patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?+[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
CONTEXT = {
    "email": "mail|contact|write|schreib|correo|courriel",
    "ip": "ip|server|host|address|adresse",
    "card": "card|visa|credit|karte|carte|tarjeta|pay",
    "phone": "phone|tel|call|mobile|fax|anruf|appel",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security",
}
START_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.3}
CONTEXT_BONUS = 0.3
CONTEXT_CHARS = 40
KEEP = 0.5


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def luhn_valid(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check; other characters must be gone already."""

    def weighed(place: Column) -> Column:
        digit = digits.substr(place, F.lit(1)).cast("int")
        twice = digit * 2
        doubled = F.when(twice > 9, twice - 9).otherwise(twice)
        return F.when((F.length(digits) - place) % 2 == 1, doubled).otherwise(digit)

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), lambda a, place: a + weighed(place))
    return (F.length(digits) > 0) & (total % 10 == 0)


def mod97_valid(value: Column) -> Column:
    """Whether an account number of capitals and digits leaves 1 modulo 97 once its first four signs are moved last."""
    plain = F.regexp_replace(value, " ", "")
    moved = F.concat(plain.substr(F.lit(5), F.length(plain)), plain.substr(F.lit(1), F.lit(4)))
    signs = F.transform(F.sequence(F.lit(1), F.length(moved)), lambda i: F.ascii(moved.substr(i, F.lit(1))))
    step = lambda rest, sign: F.when(sign < 58, (rest * 10 + sign - 48) % 97).otherwise((rest * 100 + sign - 55) % 97)
    return F.aggregate(signs, F.lit(0), step) == 1


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        small = lambda part: (F.length(F.regexp_replace(part, "^0+", "")) <= 3) & (F.regexp_replace(part, "^0+", "0").try_cast("int") <= 255)
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn_valid(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return mod97_valid(value) if kind == "iban" else F.lit(True)


def _proposed(text: Column, kind: str) -> Column:
    """Matches of one kind with their places and score: the gaps between matches give places and context."""
    found, gaps = F.col(f"__m_{kind}"), F.split(text, PATTERNS[kind], -1)
    parts = F.arrays_zip(found.alias("value"), F.slice(gaps, F.lit(1), F.size(found)).alias("before"), F.slice(gaps, F.lit(2), F.size(found)).alias("after"))

    def add(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["before"])
        end = start + F.length(part["value"])
        near = F.concat_ws(" ", F.right(part["before"], F.lit(CONTEXT_CHARS)), F.left(part["after"], F.lit(CONTEXT_CHARS)))
        hint = near.rlike(rf"(?i)(?<![\p{{L}}])(?:{CONTEXT[kind]})")
        score = F.lit(START_SCORE[kind]) + F.when(hint, CONTEXT_BONUS).otherwise(0.0)
        good = _valid(kind, part["value"]) & (F.lit(kind in BASE_KINDS) | (score >= KEEP))
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("order"), end.alias("end"), score.alias("score"))
        return F.struct(end.alias("at"), F.when(good, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,order:int,end:int,score:double>>").alias("spans"))
    spans = F.aggregate(parts, empty, add, lambda acc: acc["spans"])
    return F.when(F.size(found) > 0, spans).otherwise(empty["spans"])


def find_spans(docs: DataFrame, text: str = "text", out: str = "pii_spans") -> DataFrame:
    """Add ``out``: an array of (start, order, end, score) in code points, by start and then kind.

    ``order`` is the kind's place in ``KINDS``. Nothing is shuffled: the work of a row depends on its text only.
    """
    docs = without(docs, out)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    proposed = docs.select(*columns, *[F.regexp_extract_all(whole, F.lit(PATTERNS[k]), F.lit(0)).alias(f"__m_{k}") for k in KINDS])
    return proposed.select(*columns, F.array_sort(F.concat(*[_proposed(whole, k) for k in KINDS])).alias(out))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["order"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; a span inside an earlier one adds nothing."""
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        put = F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.element_at(tags, s["order"] + 1))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, put).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    body = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, body).otherwise(text)
