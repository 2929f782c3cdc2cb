"""Personal data in whole texts, by DataFrame functions alone.

Regular expressions propose spans; checksums (Luhn, mod 97), number ranges and digit counts confirm them; words just before a
span raise its score. A kind's spans are its leftmost non-overlapping matches; a match that isn't confirmed is dropped without
another try. Offsets are code points, ends exclusive. A null text is an empty one.

The patterns are written with possessive repeats and with a look-behind where a run of characters could otherwise be tried from
each of its characters, so that time is linear in the length of a text and no match recurses; the matches stay the same.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswire.llm.quality_rules import let

SPAN = "array<struct<kind:string,start:int,end:int,text:string,score:double>>"
#: A span is kept from this score on.
KEEP = 0.5
#: Code points before a span in which context words count.
CONTEXT = 40


@dataclass(frozen=True)
class Kind:
    """``maybe``: a cheap test that any text with a match passes; ``score``: of a confirmed match, plus 0.4 after a context word."""

    name: str
    pattern: str
    maybe: Callable[[Column], Column]
    valid: Callable[[Column], Column] = lambda m: F.lit(True)
    score: float = 0.9
    context: str = ""


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(number)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number passes the check of ISO 7064 mod 97-10: rearranged, letters as 10 to 35, the remainder is 1."""
    plain = F.replace(code, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(rest: Column, c: Column) -> Column:
        value = F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return (F.length(plain).between(15, 34)) & (F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), add) == 1)


def _octets(m: Column) -> Column:
    def small(x: Column) -> Column:
        short = F.regexp_replace(x, "^0+(?=.)", "")
        return (F.length(short) <= 3) & (short.cast("int") <= 255)

    return F.forall(F.split(m, r"\."), small)


BASE_KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@")),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", lambda t: t.rlike(r"[0-9]\.[0-9]"), _octets, 0.6, r"\b(?:ip|host|server|addr)"),
    Kind("card", r"[0-9](?:[ \-]?[0-9]){15,}+", lambda t: t.rlike(r"[0-9][ \-]?[0-9][ \-]?[0-9][ \-]?[0-9][ \-]?[0-9]"), lambda m: F.length(digits(m)).between(16, 19) & luhn(digits(m)), 0.8, r"\b(?:card|visa|credit|karte|carte|tarjeta)"),
    Kind("phone", r"\+[0-9][ ().0-9\-]+[0-9]", lambda t: t.rlike(r"\+[0-9]"), lambda m: F.length(digits(m)).between(8, 15), 0.8, r"\b(?:tel|phone|call|fax|mobile)"),
)
#: Kinds of the method itself: account numbers by mod 97, keys of well-known forms, and three kinds that only context words confirm.
METHOD_KINDS = (
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda t: t.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), mod97, 0.8, r"\b(?:iban|account|konto|compte|cuenta)"),
    Kind("ssn", r"(?<![0-9\-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9\-])", lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), score=0.3, context=r"\b(?:ssn|social security)"),
    Kind("phone_local", r"(?<![0-9+(])\(?[0-9]{3}\)?[ .\-][0-9]{3}[ .\-][0-9]{4}(?![0-9])", lambda t: t.rlike(r"[0-9]{3}[ .\-][0-9]{4}"), score=0.3, context=r"\b(?:tel|phone|call|fax|mobile)"),
    Kind("access_key", r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36})(?![A-Za-z0-9_])", lambda t: t.rlike(r"A[KS]IA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}")),
    Kind("secret", r"(?<![A-Za-z0-9_+/\-])[A-Za-z0-9_+/\-]{16,}+", lambda t: t.rlike(r"(?i)(?:token|secret|passw|pwd|key|bearer)\W{1,8}[A-Za-z0-9_+/\-]{16}"), lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"), 0.3, r"(?:token|secret|password|passwd|pwd|key|bearer)\W{1,8}$"),
)


def spans_of(text: Column, kind: Kind) -> Column:
    """The confirmed spans of one kind in a text, as ``SPAN``."""
    none = F.array().cast(SPAN)

    def place(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["found"])
        return F.struct(end.alias("at"), F.array_append(state["out"], F.struct(start.alias("start"), end.alias("end"), x["found"].alias("text"))).alias("out"))

    gaps, found = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pairs = let(found, lambda m: F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda g, x: F.struct(g.alias("gap"), x.alias("found"))))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))
    placed = F.aggregate(pairs, first, place, lambda s: s["out"])

    def scored(s: Column) -> Column:
        before = F.substring(text, F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT)))
        plus = F.when(before.rlike(f"(?i){kind.context}"), 0.4).otherwise(0.0) if kind.context else F.lit(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), F.least(F.lit(1.0), F.lit(kind.score) + plus).alias("score"))

    good = F.filter(F.transform(F.filter(placed, lambda s: kind.valid(s["text"])), scored), lambda s: s["score"] >= KEEP)
    return F.when(kind.maybe(text), good.cast(SPAN)).otherwise(none)


def with_spans(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = BASE_KINDS + METHOD_KINDS) -> DataFrame:
    """(row, text, found): each row of ``docs`` as a struct, so that no name can clash, its text, and a struct with the spans of each kind.

    Null and empty texts have no spans; repeated rows each have theirs; an empty table gives one.
    """
    found = F.struct(*(spans_of(F.col("text"), k).alias(k.name) for k in kinds))
    plain = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return plain.select("row", "text", F.explode(F.array(found)).alias("found"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans in their order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; spans that overlap become one, under the kind of the first."""
    in_order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def put(state: Column, s: Column) -> Column:
        kept = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        out = F.when(s["start"] >= state["at"], F.concat(state["out"], kept, F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    rest = F.aggregate(in_order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), put, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(rest)


def without_pii(docs: DataFrame, text_col: str = "text", kinds: tuple[Kind, ...] = BASE_KINDS + METHOD_KINDS) -> DataFrame:
    """``docs`` with personal data masked in its text; a null text stays null, other columns are as they were."""
    full = with_spans(docs, text_col, kinds)
    every = F.concat(*(F.col(f"found.{k.name}") for k in kinds))
    clean = F.when(F.col(f"row.`{text_col}`").isNotNull(), masked(F.col("text"), every))
    return full.select(*(clean.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))
