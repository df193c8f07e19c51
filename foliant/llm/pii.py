"""Personal data: patterns propose, checksums confirm, nearby words adjust the score.

Built-in expressions only, in one pass over whole texts: no shuffle, no Python. For each kind
``regexp_extract_all`` gives the matches and ``split`` the text between them; running sums of
their lengths give positions in code points.

The patterns use possessive groups, which the regex engine runs as loops: the usual form
recurses once a repetition and overflows the stack on long digit runs. They match the same
strings, since what follows a group can never start with what the group takes. Look-behinds
keep a failed run from being tried again at each of its characters, which would take time
with the square of its length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of the base rules, in the order of their spans; these spans are always reported.
BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that the method adds, reported at a score of MIN_SCORE or more.
EXTRA_KINDS = ("iban", "ssn", "phone_local", "secret")
MIN_SCORE = 0.5
CONTEXT_CHARS = 40

_PATTERN = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone_local": r"(?<![0-9+()-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9-])",
    "secret": r"(?i)(?<![a-z0-9])(?:token|api[_-]?key|secret|password|passwd)[\"']?\x20?[=:]\x20?[\"']?[A-Za-z0-9+/_-]{16,}+",
}
_SECRET_NAME = r"(?i)^[a-z_-]+[\"']?\x20?[=:]\x20?[\"']?"
#: Score without context, score added by a context word near the match.
_SCORE = {"email": (0.9, 0.1), "ip": (0.6, 0.3), "card": (0.8, 0.2), "phone": (0.7, 0.2), "iban": (0.9, 0.1), "ssn": (0.4, 0.5), "phone_local": (0.4, 0.4), "secret": (0.9, 0.1)}
_CONTEXT = {
    "email": r"(?i)mail|contact|write|@",
    "ip": r"(?i)\bip\b|address|host|server|login",
    "card": r"(?i)card|visa|master|amex|payment|carte|karte|tarjeta",
    "phone": r"(?i)phone|\btel|call|mobile|fax|anruf|telefon|appel",
    "iban": r"(?i)iban|account|konto|compte|cuenta",
    "ssn": r"(?i)\bssn\b|social security|tax",
    "phone_local": r"(?i)phone|\btel|call|mobile|fax|telefon|appel",
    "secret": r"(?i)key|auth|credential|login",
}
# Length of an account number by country code (public IBAN registry).
_IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 "
    "GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 "
    "ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 "
    "TR26 UA29 VA22 VG24 XK20"
).split()

_SPAN = "struct<kind:string,start:int,end:int,score:double>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def luhn_ok(digits: Column) -> Column:
    """Luhn's check of a string of ASCII digits."""

    def worth(d: Column, i: Column) -> Column:
        n = d.cast("int") * (i % 2 + 1)
        return n - F.when(n > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), worth), F.lit(0), lambda a, n: a + n) % 10 == 0


def mod97_ok(compact: Column) -> Column:
    """The mod-97 check of an account number without spaces."""

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    moved = F.concat(F.substring(compact, 5, 60), F.substring(compact, 1, 4))
    return F.aggregate(F.split(moved, "(?!^)(?!$)"), F.lit(0), step) == 1


def _part_ok(p: Column) -> Column:
    value = F.regexp_replace(p, "^0+", "")
    return (F.length(value) <= 3) & (F.coalesce(value.try_cast("int"), F.lit(0)) <= 255)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _judge(kind: str, m: Column) -> tuple[Column, Column, Column]:
    """Whether a match is confirmed, and the start and length in it of the span."""
    whole = F.lit(0), F.length(m)
    if kind == "ip":
        return F.forall(F.split(m, "\\."), _part_ok), *whole
    if kind == "card":
        d = _digits(m)
        return F.length(d).between(13, 19) & luhn_ok(d), *whole
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15), *whole
    if kind == "iban":
        lengths = F.create_map(*(F.lit(v) for x in _IBAN_LENGTHS for v in (x[:2], int(x[2:]))))
        n = F.coalesce(F.try_element_at(lengths, F.substring(m, 1, 2)), F.lit(0))
        pattern = F.concat(F.lit("^(?:\\x20?[A-Z0-9]){"), n.cast("string"), F.lit("}(?![A-Z0-9])"))
        taken = F.call_function("regexp_extract", m, pattern, F.lit(0))
        compact = F.regexp_replace(taken, " ", "")
        return (n > 0) & (F.length(compact) == n) & mod97_ok(compact), F.lit(0), F.length(taken)
    if kind == "secret":
        value = F.regexp_replace(m, _SECRET_NAME, "")
        return F.length(value) >= 16, F.length(m) - F.length(value), F.length(value)
    return F.lit(True), *whole


def _spans_of(text: Column, kind: str) -> Column:
    """array<struct<kind,start,end,score>> of one kind, in order."""
    plain, more = _SCORE[kind]
    least = 0.0 if kind in BASE_KINDS else MIN_SCORE

    def judged(found: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            gap = found["gaps"][i]
            near = F.right(gap, F.lit(CONTEXT_CHARS)).rlike(_CONTEXT[kind]) | F.left(found["gaps"][i + 1], F.lit(CONTEXT_CHARS)).rlike(_CONTEXT[kind]) | (m.rlike(_CONTEXT[kind]) if kind == "secret" else F.lit(False))
            ok, at, size = _judge(kind, m)
            score = F.when(ok, F.lit(plain) + F.when(near, more).otherwise(0.0))
            return F.struct(F.length(gap).alias("gap"), F.length(m).alias("n"), score.alias("score"), at.cast("int").alias("at"), size.cast("int").alias("size"))

        return F.transform(found["matches"], one)

    def laid_out(found: Column) -> Column:
        def step(acc: Column, m: Column) -> Column:
            start = acc["pos"] + m["gap"] + m["at"]
            span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + m["size"]).alias("end"), m["score"].alias("score"))
            return F.struct((acc["pos"] + m["gap"] + m["n"]).alias("pos"), F.when(m["score"] >= least, F.concat(acc["out"], F.array(span).cast(f"array<{_SPAN}>"))).otherwise(acc["out"]).alias("out"))

        start = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<{_SPAN}>").alias("out"))
        return F.aggregate(judged(found), start, step, lambda acc: acc["out"])

    matches = F.regexp_extract_all(text, F.lit(_PATTERN[kind]), F.lit(0))
    none = F.array().cast(f"array<{_SPAN}>")
    return _let(
        F.struct(matches.alias("matches"), text.alias("text")),
        lambda f: F.when(F.size(f["matches"]) == 0, none).otherwise(_let(F.struct(f["matches"].alias("matches"), F.split(f["text"], _PATTERN[kind], -1).alias("gaps")), laid_out)),
    )


def pii_spans(text: Column) -> Column:
    """All spans of a text by kind, then start: array<struct<kind,start,end,score>>; code points, end exclusive."""
    return _let(F.coalesce(text.cast("string"), F.lit("")), lambda t: F.concat(*(_spans_of(t, k) for k in (*BASE_KINDS, *EXTRA_KINDS))))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans merge."""

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, acc["pos"] + 1, F.greatest(s["start"] - acc["pos"], F.lit(0)))
        tag = F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.when(s["end"] <= acc["pos"], acc).otherwise(F.struct(s["end"].alias("pos"), F.concat(acc["out"], kept, tag).alias("out")))

    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    masked = F.aggregate(by_start, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, masked).otherwise(text)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in whole texts.

    Returns one row per input row: ``id_col``, n_email, n_ip, n_card, n_phone, base_sha256,
    spans (kind:start:end, comma-joined, by kind then start), found (array of spans with
    scores). A null or empty text has no spans; repeated rows give repeated results; null
    ids stay null; other columns are not read.
    """
    out = df.select(F.col(id_col), pii_spans(F.col(text_col)).alias("found"))
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in BASE_KINDS]
    return out.select(id_col, *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("found")).alias("spans"), "found")


def redact_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The input with personal data in ``text_col`` replaced; all other columns, rows and nulls stay."""
    return df.withColumn(text_col, F.when(F.col(text_col).isNotNull(), _let(F.col(text_col), lambda t: _let(F.struct(t.alias("t"), pii_spans(t).alias("s")), lambda x: redact(x["t"], x["s"])))))
