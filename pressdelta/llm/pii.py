"""Personal data spans with native column expressions only.

Regular expressions propose spans. Checksums confirm the kinds that have one: Luhn for
cards, mod-97 for account numbers. Words near a span move its score up or down, and a
kind whose pattern alone proves little needs such a word. The four base kinds are kept
whatever their score; the kinds added here must reach ``THRESHOLD``.

Offsets are code points, end exclusive. A span's start is carried along while the
pieces between matches are folded from left to right, so a text costs one pass for
each pattern. All patterns are written with possessive quantifiers, and ``\\G`` keeps
"leftmost, non-overlapping" exact where a look-behind stops repeated rescans of a run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import required

#: Characters before and after a span in which context words count.
CONTEXT = 40
#: Score that an added span must reach.
THRESHOLD = 0.5


@dataclass(frozen=True)
class Kind:
    """A kind of span: its pattern, cheap test, validator and context words."""

    name: str
    pattern: str
    hint: str  # a pattern that any text with a match has
    base: bool
    prior: float
    checksum: str | None = None
    context: str | None = None
    against: str | None = None


#: Countries with the lengths of their account numbers, of the ISO 13616 register.
LENGTHS = "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"

KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True, 0.9, None, r"(?i)\b(?:e-?mail|contact|write|courriel|correo)", r"(?i)example\.(?:com|org|net)"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", True, 0.6, "ip", r"(?i)\b(?:ip|host|server|address|adresse|login)\b", r"(?i)\b(?:version|release|section)\b"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][0-9\x20-]{11}", True, 0.7, "luhn", r"(?i)\b(?:card|visa|mastercard|amex|carte|karte|tarjeta|credit)", r"(?i)\b(?:order|tracking|isbn)\b"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", True, 0.6, "phone", r"(?i)\b(?:phone|tel|call|fax|mobile|telefon|llame)", r"(?i)\b(?:order|invoice)\b"),
    Kind("iban", r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?))[A-Z]{2}[0-9]{2}", r"[A-Z]{2}[0-9]{2}", False, 0.3, "mod97", r"(?i)\b(?:iban|bank|account|konto|compte|cuenta)", None),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]", False, 0.3, None, r"(?i)\b(?:ssn|social security|sozialversicherung|sécurité sociale|seguridad social)", r"(?i)\b(?:part|model|serial)\b"),
)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """13 to 19 digits whose Luhn sum ends in zero; alternate digits count double, less nine."""
    back = F.reverse(_digits(value))
    doubled = "0246813579"
    places = F.sequence(F.lit(1), F.length(back))
    total = F.aggregate(
        places,
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 0, F.substring(F.lit(doubled), back.substr(i, F.lit(1)).cast("int") + 1, 1).cast("int")).otherwise(back.substr(i, F.lit(1)).cast("int")),
    )
    return F.length(back).between(13, 19) & (total % 10 == 0)


def _mod97(value: Column) -> Column:
    """ISO 13616: first four characters to the end, letters as 10 to 35, remainder 1 by 97."""
    flat = F.regexp_replace(value, " ", "")
    moved = F.concat(flat.substr(F.lit(5), F.length(flat)), flat.substr(F.lit(1), F.lit(4)))
    code = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    rest = F.aggregate(
        F.sequence(F.lit(1), F.length(moved)),
        F.lit(0),
        lambda acc, i: (acc * F.when(code(moved.substr(i, F.lit(1))) > 9, 100).otherwise(10) + code(moved.substr(i, F.lit(1)))) % 97,
    )
    return F.length(flat).between(15, 34) & (rest == 1)


def _iban_length(value: Column) -> Column:
    """Length of the account number that ``value`` begins with; null if there is none.

    ``value`` may go on with words and numbers after it, so every end before a space and
    the end of ``value`` is tried: the country's own length first, else the longest.
    """
    head = lambda k: value.substr(F.lit(1), k)
    ends = F.filter(
        F.sequence(F.lit(15), F.length(value)),
        lambda k: F.when((k == F.length(value)) | (value.substr(k + 1, F.lit(1)) == " "), head(k).rlike("^[A-Z0-9 ]+$") & _mod97(head(k))).otherwise(False),
    )
    size = lambda k: F.length(F.regexp_replace(head(k), " ", "")).cast("string")
    own = lambda k: F.instr(F.lit(LENGTHS), F.concat(value.substr(1, 2), size(k))) > 0
    return F.array_max(F.transform(ends, lambda k: F.struct(own(k).alias("own"), k.alias("length"))))["length"]


def _iban_spans(kind: Kind, text: Column) -> Column:
    """array<struct<start,end>>; a match is the first four characters, its group what may follow."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(1))
    between = F.split(text, kind.pattern, -1)
    empty = F.lit([]).cast("array<struct<start:int,end:int>>")
    lengths = F.transform(found, _iban_length)

    def fold(acc, pair):
        start = acc["at"] + F.length(pair["between"])
        end = start + pair["length"]
        fresh = F.struct((start + 4).alias("at"), end.alias("until"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"))).alias("out"))
        skipped = F.struct((start + 4).alias("at"), acc["until"].alias("until"), acc["out"].alias("out"))
        return F.when(pair["length"].isNotNull() & (start >= acc["until"]), fresh).otherwise(skipped)

    pairs = F.arrays_zip(between.alias("between"), lengths.alias("length"))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.lit(0).alias("until"), empty.alias("out")), fold, lambda acc: acc["out"])


def _ip(value: Column) -> Column:
    """All four parts at most 255, leading zeros or not, whatever their length."""
    return ~F.exists(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{4,}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])$"))


def _valid(kind: Kind, value: Column) -> Column:
    if kind.checksum == "luhn":
        return F.when(F.length(_digits(value)).between(13, 19), _luhn(value)).otherwise(False)
    if kind.checksum == "ip":
        return _ip(value)
    if kind.checksum == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _score(kind: Kind, text: Column, start: Column, end: Column) -> Column:
    """The prior, plus 0.4 for a checksum, plus or minus 0.3 for nearby words, within 0 to 1."""
    first = F.greatest(start - CONTEXT, F.lit(0))
    near = F.concat_ws(" ", text.substr(first + 1, start - first), text.substr(end + 1, F.lit(CONTEXT)))
    score = F.lit(kind.prior + (0.4 if kind.checksum in ("luhn", "mod97") else 0.0))
    if kind.context:
        score = score + F.when(near.rlike(kind.context), 0.3).otherwise(0.0)
    if kind.against:
        score = score - F.when(near.rlike(kind.against), 0.3).otherwise(0.0)
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def _checked(kind: Kind, text: Column) -> Column:
    """array<struct<start,end>> of the matches that are valid whole."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    between = F.split(text, kind.pattern, -1)
    empty = F.lit([]).cast("array<struct<start:int,end:int>>")

    def fold(acc, pair):
        start = acc["at"] + F.length(pair["between"])
        end = start + F.length(pair["match"])
        kept = F.when(_valid(kind, pair["match"]), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end")))).otherwise(acc["out"])
        return F.when(pair["match"].isNull(), acc).otherwise(F.struct(end.alias("at"), kept.alias("out")))

    pairs = F.arrays_zip(between.alias("between"), found.alias("match"))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), fold, lambda acc: acc["out"])


def _spans(kind: Kind, text: Column) -> Column:
    """array<struct<kind,start,end,score>> of one kind, failing matches dropped."""
    spans = _iban_spans(kind, text) if kind.checksum == "mod97" else _checked(kind, text)
    scored = F.transform(spans, lambda s: F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _score(kind, text, s["start"], s["end"]).alias("score")))
    if not kind.base:
        scored = F.filter(scored, lambda s: s["score"] >= THRESHOLD)
    return F.when(text.rlike(kind.hint), scored).otherwise(F.lit([]).cast("array<struct<kind:string,start:int,end:int,score:double>>"))


def pii_spans(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, text and one span array a kind.

    Null text is empty and has no spans. Repeated rows and ids, null ids and an empty
    table need no care: every row is judged alone. Other columns are ignored.
    """
    base = required(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return base.select("doc_id", "text", *[_spans(k, F.col("text")).alias(k.name) for k in KINDS])


def _joined(kinds: list[Kind]) -> Column:
    spans = F.concat(*[F.col(k.name) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans as a string."""
    base = [k for k in KINDS if k.base]
    return pii_spans(docs).select(
        "doc_id",
        *[F.size(k.name).cast("long").alias(f"n_{k.name}") for k in base],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(list(KINDS)).alias("spans"),
    )


def mask_pii(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``[KIND]``; other columns stay.

    Overlapping spans are masked once, under the kind that starts first, or on a tie
    the longer one. n_chars, where present, follows the new text; null texts stay null.
    Rows travel as one struct, so columns of any name may stand beside ``text``. Repeated
    rows are each masked; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = F.array_sort(
        F.concat(*[_spans(k, text) for k in KINDS]),
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]),
    )

    def fold(acc, s):
        gap = F.col("text").substr(acc["at"] + 1, s["start"] - acc["at"])
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(gap, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))).alias("parts"))
        longer = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(longer)

    state = F.struct(F.lit(0).alias("at"), F.lit([]).cast("array<string>").alias("parts"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text", spans.alias("spans"))
    folded = rows.select("row", "text", F.when(F.size("spans") > 0, F.aggregate("spans", state, fold)).alias("folded"))
    tail = F.col("text").substr(F.col("folded.at") + 1, F.length("text"))
    masked = F.when(F.col("folded").isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.col("folded.parts"), ""), tail))
    out = folded.select("row", masked.alias("masked"))
    columns = [F.col("masked").alias("text") if c == "text" else F.length("masked").cast(t).alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c, t in docs.dtypes]
    return out.select(*columns)
