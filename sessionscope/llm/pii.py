"""Personal data in texts: patterns propose, checksums confirm, context adjusts the score.

Everything is a column expression: no shuffle, no Python on executors. Positions come from splitting the
text at the matches of the same pattern and adding up lengths, which count code points.

Secrets have no checksum. A long run of letters and digits is one if its characters are spread as in random ones and a word
such as token or password stands just before it; keys with an issuer's fixed form need no such word.

The patterns are the plain ones of the contract, written so that Java's matcher neither recurses nor
rescans a long run: repeats are possessive where nothing after them could give back, and a match may only
start where a run of its characters starts (or where the last match ended).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base kinds in their order, then the kinds this method adds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret", "key")
BASE_KINDS = KINDS[:4]

_LOCAL = "A-Za-z0-9._%+-"
_RUN = "A-Za-z0-9+/_-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a whole run of digits with single separators; runs of other lengths are consumed by not starting inside them
    "card": r"[0-9](?<![0-9][ -]?[0-9])(?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": rf"(?<![{_RUN}])[{_RUN}]{{16,}}+={{0,2}}+",
    # Forms of issued keys, and the head line of a private key
    "key": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)(?![A-Za-z0-9])|-----BEGIN (?:[A-Z]{1,12} ){0,2}PRIVATE KEY-----",
}
# What a text must hold, as is or in lower case, to have a match of the kind; most texts hold none of it.
GATES = {"email": ("@",), "phone": ("+",), "key": ("AKIA", "ASIA", "xox", "eyJ", "PRIVATE KEY")}
LOWER_GATES = {"secret": ("token", "secret", "passw", "pwd", "bearer", "credential", "key")}
GATE_PATTERNS = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]{2}-[0-9]"}
#: Kinds whose matches all hold a digit: one look for digits serves them together.
WITH_DIGITS = ("ip", "card", "phone", "iban", "ssn", "secret")


@dataclass(frozen=True)
class PiiConfig:
    """Scores before context, what a context word adds, how far it may stand, and what added kinds must reach."""

    base_score: dict[str, float] = field(default_factory=lambda: {"email": 0.85, "ip": 0.6, "card": 0.75, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "secret": 0.3, "key": 0.9})
    context_bonus: float = 0.25
    secret_entropy: float = 3.0  # bits a character that a secret has at least
    before: int = 48
    after: int = 24
    threshold: float = 0.5
    context: dict[str, str] = field(
        default_factory=lambda: {
            "email": "mail|contact|write|reach",
            "ip": "ip|host|server|address|client|login",
            "card": "card|visa|master|credit|debit|pay|karte|carte|tarjeta",
            "phone": "phone|tel|call|mobile|fax|anruf|appel|llam",
            "iban": "iban|bank|account|konto|compte|cuenta|transfer",
            "ssn": "ssn|social|security|tax",
            # the word, at most two others or a mark of assignment, then the value itself
            "secret": r"(?:token|secret|passw(?:or)?d|pwd|bearer|credentials?|(?:api|access|private|secret)[ _-]?key|key(?=\W{0,3}[:=]))(?:\W{1,4}\w{1,12}){0,2}\W{0,6}\z",
            "key": "key|token|secret",
        }
    )


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, also where the body is a function of array elements."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, combine: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """What ``combine`` (associative, 0 neutral) makes of the values before each one. In two levels, for an array that grows inside
    ``aggregate`` is copied at each step, so blocks of bounded length keep the work near linear."""
    none = F.array().cast("array<int>")

    def scan(items: Column) -> Column:
        add = lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(items, F.struct(F.lit(0).alias("at"), none.alias("out")), add)

    def blocked(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(v) - 1, F.lit(block)), lambda i: scan(F.slice(v, i + 1, F.lit(block))))
        joined = _bound(blocks, lambda bs: F.flatten(F.zip_with(scan(F.transform(bs, lambda b: b["at"]))["out"], bs, lambda o, b: F.transform(b["out"], lambda x: combine(o, x)))))
        return F.when(F.size(v) > 0, joined).otherwise(none)

    return _bound(values, blocked)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """Luhn: from the right, every second digit doubled; the digit sum is a multiple of ten."""
    each = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(F.filter(each, lambda d: d != ""), lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int"))),
        F.lit(0),
        lambda a, d: a + d,
    )
    return total % 10 == 0


def mod97_ok(value: Column) -> Column:
    """IBAN check: country and check digits moved to the end, letters as 10 to 35, remainder 1 by 97."""
    compact = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))
    each = F.filter(F.split(turned, ""), lambda c: c != "")

    def step(acc: Column, c: Column) -> Column:
        letter = c.rlike("[A-Z]")
        v = F.when(letter, F.ascii(c) - 55).otherwise(c.cast("int"))
        return (acc * F.when(letter, 100).otherwise(10) + v) % 97

    return F.aggregate(each, F.lit(0), step) == 1


def _spread(value: Column) -> Column:
    """Entropy of the characters in bits."""
    n = F.char_length(value)
    share = lambda c: (n - F.char_length(F.replace(value, c, F.lit("")))) / n
    each = F.filter(F.array_distinct(F.split(value, "")), lambda c: c != "")
    return F.aggregate(F.transform(each, lambda c: -share(c) * F.log2(share(c))), F.lit(0.0), lambda a, x: a + x)


def _confirmed(kind: str, value: Column, config: PiiConfig) -> Column:
    digits = _digits(value)
    if kind in ("email", "key"):
        return F.lit(True)
    if kind == "ip":
        part = "0*+(?:|[1-9][0-9]?|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
        return value.rlike(rf"\A{part}(?:\.{part}){{3}}\z")
    if kind == "card":
        return F.char_length(digits).between(14, 19) & luhn_ok(digits)
    if kind == "phone":
        return F.char_length(digits).between(10, 15)
    if kind == "iban":
        return mod97_ok(value)
    if kind == "secret":
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (_spread(value) >= config.secret_entropy)
    return ~value.rlike(r"\A(?:000|666|9[0-9]{2})") & ~value.rlike("-00-") & ~value.rlike(r"0000\z")


def _gate(text: Column, kind: str) -> Column:
    """Whether the text may hold a match, by byte searches where they tell."""
    holds = lambda t, words: reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words])
    if kind in LOWER_GATES:
        return _bound(F.lower(text), lambda t: holds(t, LOWER_GATES[kind]))
    if kind in GATE_PATTERNS:
        return text.rlike(GATE_PATTERNS[kind])
    gate = holds(text, GATES[kind])
    return gate | (F.contains(text, F.lit("_")) & text.rlike("gh[pousr]_")) if kind == "key" else gate


def pii_spans(text: Column, kind: str, config: PiiConfig, digits: Column | None = None) -> Column:
    """Confirmed spans of one kind: (start, end, rank, kind, score); added kinds must also reach the threshold.

    ``digits``: whether the text holds an ASCII digit, if that is known already. The text is cut at its matches once, and
    only if one of them is confirmed. Starts by code point are running sums of the pieces' lengths, and the text around a
    match comes from the pieces beside it, so the work is near linear in the number of matches.
    """
    pattern = PATTERNS[kind]
    reach = 2 * (config.before // 4 + 1)  # a match has four characters at least, so these pieces fill the space looked at

    def cut(p: Column) -> Column:
        heads = F.slice(p["gaps"], 1, F.size(p["found"]))
        ends = _running(F.zip_with(heads, p["found"], lambda g, m: F.char_length(g) + F.char_length(m)), lambda a, b: a + b)
        starts = F.zip_with(ends, heads, lambda e, g: e + F.char_length(g))
        pieces = F.flatten(F.zip_with(p["gaps"], p["found"], lambda g, m: F.array(g, F.coalesce(m, F.lit("")))))
        tails = F.transform(pieces, lambda x: F.right(x, F.lit(config.before)))
        begins = F.transform(pieces, lambda x: F.left(x, F.lit(config.after)))
        places = F.transform(F.arrays_zip(starts.alias("start"), p["found"].alias("value")), lambda m, i: F.struct(i.alias("i"), m["start"].alias("start"), m["value"].alias("value")))
        kept = F.filter(places, lambda m: _confirmed(kind, m["value"], config))
        return _bound(F.struct(kept.alias("kept"), tails.alias("tails"), begins.alias("begins")), lambda s: F.transform(s["kept"], lambda m: scored(s, m)))

    def scored(s: Column, m: Column) -> Column:
        until = 2 * m["i"] + 2  # one behind the gap before the match, from 1
        first = F.greatest(until - reach, F.lit(1))
        before = F.right(F.array_join(F.slice(s["tails"], first, until - first), ""), F.lit(config.before))
        after = F.left(F.array_join(F.slice(s["begins"], until + 1, F.lit(reach)), ""), F.lit(config.after))
        near = before if kind == "secret" else F.concat_ws(" ", before, after)
        bonus = F.when(F.lower(near).rlike(config.context[kind]), config.context_bonus).otherwise(0.0)
        score = F.least(F.lit(1.0), F.lit(config.base_score[kind]) + bonus)
        end = m["start"] + F.char_length(m["value"])
        return F.struct(m["start"].alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), score.alias("score"))

    none = F.array().cast("array<struct<start:int,end:int,rank:int,kind:string,score:double>>")

    def spans_of(found: Column) -> Column:
        some = F.exists(found, lambda m: _confirmed(kind, m, config))
        return F.when(some, _bound(F.struct(found.alias("found"), F.split(text, pattern, -1).alias("gaps")), cut)).otherwise(none)

    gate = _gate(text, kind)
    if kind in WITH_DIGITS:
        gate = (text.rlike("[0-9]") if digits is None else digits) & gate
    spans = F.when(gate, _bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans_of)).otherwise(none)
    return spans if kind in BASE_KINDS else F.filter(spans, lambda x: x["score"] >= config.threshold)


def find_pii(docs: DataFrame, *, text_col: str = "text", out_col: str = "pii", config: PiiConfig = PiiConfig()) -> DataFrame:  # noqa: B008
    """Add ``out_col``: spans of personal data, by start and then kind. A null text counts as empty and has none.

    Spans of one kind never overlap; spans of different kinds may. An existing ``out_col`` is replaced; all
    other columns pass through.
    """
    tmp = {k: f"__pii_{k}" for k in KINDS}
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.withColumn("__pii_text", text).withColumn("__pii_digits", F.col("__pii_text").rlike("[0-9]"))
    found = found.withColumns({tmp[k]: pii_spans(F.col("__pii_text"), k, config, F.col("__pii_digits")) for k in KINDS})
    return found.withColumn(out_col, F.array_sort(F.concat(*[F.col(tmp[k]) for k in KINDS]))).drop("__pii_text", "__pii_digits", *tmp.values())


def span_list(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, *, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """Replace every span by its kind in brackets; of overlapping spans the first (then the listed kind) names the whole.

    Texts without spans, null texts too, stay as they are.
    """
    text, spans = F.col(text_col), F.col(spans_col)
    size = 1024  # characters of a chunk: what lies between two spans is found without counting from the text's start

    def between(chunks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / size).cast("int")
        there = F.slice(chunks, first + 1, F.greatest(F.floor((end - 1) / size).cast("int") - first + 1, F.lit(0)))
        return F.when(end > start, F.substr(F.array_join(there, ""), start - first * size + 1, end - start)).otherwise("")

    def put(s: Column) -> Column:
        def piece(x: Column) -> Column:
            named = F.concat(between(s["chunks"], x["reached"], x["span"]["start"]), F.lit("["), F.upper(x["span"]["kind"]), F.lit("]"))
            return F.when(x["span"]["start"] < x["reached"], F.lit("")).otherwise(named)

        pairs = F.zip_with(s["reached"], s["spans"], lambda r, x: F.struct(r.alias("reached"), x.alias("span")))
        rest = between(s["chunks"], F.array_max(F.transform(s["spans"], lambda x: x["end"])), s["length"])
        return F.concat(F.array_join(F.transform(pairs, piece), ""), rest)

    reached = _running(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    whole = _bound(F.struct(chunks.alias("chunks"), spans.alias("spans"), reached.alias("reached"), F.char_length(text).alias("length")), put)
    return docs.withColumn(text_col, F.when(F.size(spans) > 0, whole).otherwise(text))
