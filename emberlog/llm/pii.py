"""Personal data: candidates, boosted trees, thresholds, redaction.

Generators with high recall propose spans, which may overlap. Format and context make the features of each candidate:
digits, groups, checksum, separators, words before it. Boosted trees score the candidates, and for each kind a threshold,
calibrated by isotonic regression, selects. Spans of the four base kinds that pass their format's own test always stay; the
trees add spans of other formats (secrets, national phone numbers, social security numbers, bank account numbers, IPv6,
spelled-out addresses) that overlap no base span. Of two added spans that meet, the one of higher score stays (of equal ones
the first), from left to right.

The trees are trained here on TRAIN_ROWS made-up candidates (seeded), a bounded sample, and calibrated on CALIBRATION_ROWS of
another generator, with other names, formats and contexts; scanning covers whole texts and all rows, in the JVM, without a
shuffle. Work is near linear in a text's length and in its spans.

Null text counts as empty; repeated rows are scanned each for itself; an empty table gives an empty table; the added columns
replace input columns of the same name.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.boosting import Boosted, calibrated, train
from emberlog.llm.native import let, pieces_of, running_starts, swept

TRAIN_ROWS, CALIBRATION_ROWS = 4000, 3000
#: A kind's candidates are taken from this calibrated probability on; a missed secret costs more than a wrong one.
LEAST_PROBABILITY = {"secret": 0.4, "tel": 0.5, "ssn": 0.5, "iban": 0.5, "ipv6": 0.5, "email_spelled": 0.5}
#: Code points before and after a candidate that count as its context.
NEAR = 32

#: Kinds and patterns of the base spans, in the order of the digest. The patterns find what the plain ones
#: do; lookbehind and possessive repeats keep the time linear on long runs.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a base kind.
SIGN = {"email": "@", "ip": ".", "card": "", "phone": "+"}

#: Kinds and patterns of the generators that the trees judge.
LOOSE = {
    "secret": r"(?i)(?<![a-z0-9_])[a-z0-9_]{3,}+\s?[=:]\s?[\"']?[A-Za-z0-9+/_-]{16,}+[\"']?",
    "tel": r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "email_spelled": r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{2,32} ?[\[(]at[\])] ?[a-z0-9-]{2,32}(?: ?[\[(]dot[\])] ?[a-z]{2,10})+",
}
#: What a text must hold, as a pattern, for a kind that is searched in few texts.
LOOSE_SIGN = {"email_spelled": r"[\[(][aA][tT][\])]", "ipv6": ":"}
#: The start of a candidate that counts as its context, too: a name of any length, or so many code points.
HEAD = r"^(?:[A-Za-z0-9_]{20,}|(?s:.{0,20}))"
#: Words before a candidate that speak for it.
CUES = "token|secret|key|passw|pwd|auth|phone|call|tel|mobile|fax|ssn|social|iban|account|bank|ipv6|address|host|mail|contact"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""

    def part(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + part(i))
    return total % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(x, "\\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        return let(_digits(x), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(x)).between(8, 15)
    return F.lit(True)


def _test(kind: str) -> Callable[[Column], Column]:
    return lambda s: _valid(kind, s["text"])


_SPAN = "array<struct<kind: string, start: int, end: int, text: string, before: string, after: string>>"


def _matches(text: Column, kind: str, pattern: str, sign: str) -> Column:
    """All leftmost matches that don't overlap, with their places in code points; nothing is searched without the sign (a character, or a pattern)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(ms: Column) -> Column:
        def of(pieces: Column) -> Column:
            steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(ms)), ms, lambda p, m: F.length(p) + F.length(m))
            return let(
                running_starts(steps),
                lambda s: F.transform(
                    ms,
                    lambda m, i: F.struct(
                        F.lit(kind).alias("kind"),
                        (F.get(s, i) + F.length(F.get(pieces, i))).alias("start"),
                        (F.get(s, i) + F.length(F.get(pieces, i)) + F.length(m)).alias("end"),
                        m.alias("text"),
                        F.right(F.get(pieces, i), F.lit(NEAR)).alias("before"),
                        F.left(F.get(pieces, i + 1), F.lit(NEAR)).alias("after"),
                    ),
                ),
            )

        return F.when(F.size(ms) == 0, F.array().cast(_SPAN)).otherwise(let(F.split(text, pattern, -1), of))

    none = F.array().cast(_SPAN)
    return F.when(text.contains(sign) if len(sign) == 1 else text.rlike(sign), let(found, placed)).otherwise(none) if sign else let(found, placed)


def base_spans(text: Column) -> Column:
    """Spans of the base kinds that pass their format's test, by kind as listed, then start."""
    has_digit = text.rlike("[0-9]")
    found = []
    for kind, pattern in BASE.items():
        spans = F.filter(_matches(text, kind, pattern, SIGN[kind]), _test(kind))
        found.append(spans if kind == "email" else F.when(has_digit, spans).otherwise(F.array().cast(_SPAN)))
    return F.concat(*found)


# Features: each is given twice, as a column for scanning and as a function of strings for training.
def _columns(s: Column) -> dict[str, Column]:
    digits = _digits(s["text"])
    return {
        "kind": F.coalesce(F.array_position(F.array(*[F.lit(k) for k in LOOSE]), s["kind"]), F.lit(0)).cast("double"),
        "digits": F.length(digits).cast("double"),
        "length": F.length(s["text"]).cast("double"),
        "groups": F.size(F.split(s["text"], "[^A-Za-z0-9]+")).cast("double"),
        "tail": F.length(F.coalesce(F.try_element_at(F.array_remove(F.split(s["text"], "[^A-Za-z0-9]+"), ""), F.lit(-1)), F.lit(""))).cast("double"),
        "cue": F.concat(s["before"], F.regexp_extract(s["text"], HEAD, 0)).rlike(f"(?i){CUES}").cast("double"),
        "varied": F.size(F.array_distinct(F.split(F.lower(s["text"]), ""))).cast("double"),
        "glued": s["after"].rlike("^[A-Za-z0-9]").cast("double"),
        "year": s["text"].rlike("(?:^|[^0-9])(?:19|20)[0-9]{2}(?:[^0-9]|$)").cast("double"),
    }


def _numbers(kind: str, text: str, before: str, after: str) -> dict[str, float]:
    return {
        "kind": float(list(LOOSE).index(kind) + 1),
        "digits": float(len(re.sub("[^0-9]", "", text))),
        "length": float(len(text)),
        "groups": float(len(re.split("[^A-Za-z0-9]+", text))),
        "tail": float(len(re.findall("[A-Za-z0-9]+", text)[-1])) if re.search("[A-Za-z0-9]", text) else 0.0,
        "cue": float(bool(re.search(CUES, before[-NEAR:] + re.match(HEAD, text)[0], re.I))),
        "varied": float(len(set(text.lower()))),
        "glued": float(bool(re.match("[A-Za-z0-9]", after))),
        "year": float(bool(re.search("(?:^|[^0-9])(?:19|20)[0-9]{2}(?:[^0-9]|$)", text))),
    }


def made_candidates(rows: int = TRAIN_ROWS, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """(kind, text, before, after, label): personal data in and out of telling contexts, and look-alikes."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    year = lambda: rng.choice(["19", "20"]) + digits(2)
    plain = ["the report of ", "it was in ", "see also ", "chapter ", "about ", ""]
    out = []
    for n in range(rows):
        kind, good = list(LOOSE)[n % len(LOOSE)], rng.random() < 0.5
        before, after = rng.choice(plain), rng.choice([" and so", ".", "", "\n"])
        if kind == "secret":
            name = rng.choice(["token", "secret", "api_key", "password", "auth", "TOKEN", "oauth2_token", "aws_secret_access_key"]) if good else rng.choice(["title", "name", "page", "color", "class", "html5_title", "background_image_position"])
            long = rng.randint(60, 600)
            value = rng.choice([hexes(40), hexes(32), letters(8) + digits(12), hexes(long)]) if good else rng.choice([letters(20), "a" * 20, letters(6) + "_" + letters(12), "-" * 20, "-" * long, letters(long)])
            text = f'{name} {rng.choice("=:")} "{value}"'
        elif kind == "tel":
            text = f"({digits(3)}) {digits(3)}-{digits(4)}" if rng.random() < 0.5 else f"{digits(3)}-{digits(3)}-{digits(4)}"
            before = rng.choice(["call me at ", "phone: ", "tel ", "", "reach "]) if good else before
            if not good:
                text = rng.choice([f"{year()} {digits(3)} {digits(3)}", f"{digits(2)} {digits(3)} {digits(3)}", f"{digits(2)}-{digits(3)}-{year()}"])
        elif kind == "ssn":
            text = f"{digits(3)}-{digits(2)}-{digits(4)}"
            before = rng.choice(["ssn ", "social security number ", "SSN: ", "my number is "]) if good else before
            if not good:
                text, before = f"{digits(3)}-{digits(2)}-{year()}", rng.choice(["part no ", "order ", "ref "])
        elif kind == "iban":
            text = "".join(rng.choice(["DE", "FR", "ES", "GB"])) + digits(2) + " " + " ".join(digits(4) for _ in range(rng.randint(4, 5)))
            before = rng.choice(["iban ", "account ", "bank: ", ""]) if good else before
            if not good:
                text = rng.choice(["AB", "XX"]) + digits(2) + " " + " ".join(rng.choice(["WORD", "THIS", "THAT", "ONLY", "WITH"]) for _ in range(4))
        elif kind == "ipv6":
            text = ":".join(hexes(4) for _ in range(8))
            if not good:
                text = ":".join(digits(2) for _ in range(rng.choice([5, 6])))
        else:
            text = f"{letters(rng.randint(2, 12))}{{}}{letters(rng.randint(3, 12))}{{}}{rng.choice(['com', 'org', 'net', 'de', 'info'])}"
            if not good:
                text = f"{rng.choice(['we', 'they', 'it', 'arrived'])}{{}}{letters(rng.randint(2, 9))}{{}}{letters(rng.randint(7, 10))}"
            text = text.format(*rng.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " (dot) "), ("[at]", "[dot]")]))
        out.append((kind, text, before, after, int(good)))
    return out


def other_candidates(rows: int = CALIBRATION_ROWS, seed: int = 23) -> list[tuple[str, str, str, str, int]]:
    """As made_candidates(), by other names, formats and contexts; some can't be told by what surrounds them."""
    rng = random.Random(seed)
    some = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    digits, hexes, letters = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"
    base64 = digits + letters + letters.upper() + "+/"
    year = lambda: str(rng.randint(1930, 2039))
    idle = ["", "he said ", "\n", "of the ", "line: ", "see ", "with ", "- "]
    out = []
    for n in range(rows):
        kind, good = list(LOOSE)[n % len(LOOSE)], rng.random() < 0.5
        before, after = rng.choice(idle), rng.choice(["", " or so", ",", ".\n", "; then", ")"])
        if kind == "secret":
            if good:
                name = rng.choice(["client_secret", "SESSION_KEY", "auth_token", "x_api_key", "db_password", "private_key_id", "pwd", "bearer_token"])
                value = rng.choice([some(base64, rng.randint(20, 90)), some(hexes, rng.choice([32, 40, 64])), some(digits + letters, rng.randint(18, 30))])
            else:
                name = rng.choice(["description", "file_name", "heading", "section_title", "path", "style", "label_text", "body"])
                value = rng.choice([some(letters, rng.randint(16, 40)), "/".join(some(letters, 6) for _ in range(4)), "_" * 30, "-".join(some(letters, 5) for _ in range(5)), "/" * 18])
            text = name + rng.choice(["=", ": ", " =", ":"]) + rng.choice(["", "'", '"']) + value
        elif kind == "tel":
            if good:
                before = rng.choice(["ring ", "Tel. ", "mobile: ", "fax ", "phone ", "", "our number: "])
                text = rng.choice([f"{some(digits, 3)}.{some(digits, 3)}.{some(digits, 4)}", f"({some(digits, 3)}) {some(digits, 3)} {some(digits, 4)}", f"{some(digits, 4)} {some(digits, 3)} {some(digits, 4)}"])
            else:
                text = rng.choice([f"{rng.randint(10, 99)} {some(digits, 3)} {some(digits, 3)}", f"{year()}-{some(digits, 4)}-{some(digits, 3)}", f"{year()} {year()} {year()}"])
        elif kind == "ssn":
            text = f"{some(digits, 3)}-{some(digits, 2)}-{some(digits, 4) if good else year()}"
            before = rng.choice(["Social Security: ", "SSN ", "ssn no. ", "id "]) if good else rng.choice(["item ", "invoice ", "case ", "code "])
        elif kind == "iban":
            text = rng.choice(["NL", "IT", "AT", "CH"]) + some(digits, 2) + "".join(some(digits, 4) for _ in range(rng.randint(3, 5)))
            before = rng.choice(["to account ", "IBAN: ", "bank ", ""]) if good else before
            if not good:
                text = rng.choice(["OK", "NO", "TO"]) + some(digits, 2) + "".join(rng.choice(["HIGH", "LOWS", "DATA", "NODE"]) for _ in range(rng.randint(3, 5)))
        elif kind == "ipv6":
            text = ":".join(some(hexes, rng.randint(3, 4)) for _ in range(8)) if good else ":".join(some(digits, 2) for _ in range(rng.choice([5, 6, 7])))
        else:
            text = f"{some(letters, rng.randint(4, 9))}(at){some(letters, 6)}(dot){rng.choice(['de', 'com', 'fr', 'io'])}"
            if not good:
                text = f"{rng.choice(['look', 'stay', 'was'])} [at] {some(letters, 4)} [dot] {some(letters, 10)}"
        out.append((kind, text, before, after, int(good)))
    return out


def feature_table(made: list[tuple[str, str, str, str, int]]) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Features, labels and kinds of candidates."""
    table = [_numbers(*r[:4]) for r in made]
    return {k: np.array([t[k] for t in table]) for k in table[0]}, np.array([r[4] for r in made]), np.array([r[0] for r in made])


@functools.lru_cache(maxsize=1)
def model(rows: int = TRAIN_ROWS) -> Boosted:
    features, label, _ = feature_table(made_candidates(rows))
    return calibrated(train(features, label), *feature_table(other_candidates()), LEAST_PROBABILITY)


def added_spans(text: Column, base: Column, boosted: Boosted | None = None) -> Column:
    """Candidates of the loose generators that the trees accept and no base span meets, each with its score."""
    boosted = boosted or model()
    span = "struct<start: int, end: int, kind: string, score: double>"
    state = f"struct<clear: int, now: {span}>"
    found = F.concat(*[_matches(text, k, p, LOOSE_SIGN.get(k, "")) for k, p in LOOSE.items()])
    scored = lambda s: let(F.struct(*[c.alias(k) for k, c in _columns(s).items()]), lambda f: boosted.score(lambda name: f[name]))
    told = F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("at"), s["end"].alias("end"), s["kind"].alias("kind"), scored(s).alias("score")))
    chosen = F.filter(told, lambda s: s["score"] >= boosted.least(s["kind"]))
    fixed = F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("at"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(0.0).alias("score")))
    ordered = let(chosen, lambda c: F.when(F.size(c) > 0, F.array_sort(F.concat(fixed, c))).otherwise(c))
    none, nothing = F.lit(None).cast(span), F.array().cast(f"array<{span}>")

    def step(a: Column, s: Column) -> Column:
        # clear: where the base spans met so far end; now: the candidate that stays so far.
        mine = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["score"].alias("score")).cast(span)
        meets = a["now"].isNotNull() & (s["start"] < a["now"]["end"])
        passed = F.when(a["now"].isNull() | meets, nothing).otherwise(F.array(a["now"]).cast(f"array<{span}>"))
        give = lambda clear, now, out: F.struct(F.struct(clear.alias("clear"), now.alias("now")).cast(state).alias("st"), out.alias("out"))
        return (
            F.when(s["at"] == 0, give(F.greatest(a["clear"], s["end"]), none, passed))
            .when(s["start"] < a["clear"], give(a["clear"], a["now"], nothing))
            .when(meets & (s["score"] <= a["now"]["score"]), give(a["clear"], a["now"], nothing))
            .otherwise(give(a["clear"], mine, passed))
        )

    # A mark behind all spans gives out the last.
    _, out = swept(F.concat(ordered, F.array(F.struct(F.lit(2147483647).alias("start"), F.lit(0).alias("at"), F.lit(2147483647).alias("end"), F.lit("").alias("kind"), F.lit(0.0).alias("score")))), F.struct(F.lit(0).alias("clear"), none.alias("now")).cast(state), step, state, span)
    return F.when(text.rlike("[0-9=:]|" + LOOSE_SIGN["email_spelled"]), out).otherwise(nothing)


def spans_of(text: Column, boosted: Boosted | None = None) -> Column:
    """struct<base, added>: arrays of struct<kind, start, end> in code points, end exclusive."""
    slim = lambda xs: F.transform(xs, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    def of(t: Column) -> Column:
        return let(base_spans(t), lambda b: F.struct(slim(b).alias("base"), slim(added_spans(t, b, boosted)).alias("added")))

    return let(F.coalesce(text, F.lit("")), of)


def find(df: DataFrame, text: str = "text", boosted: Boosted | None = None) -> DataFrame:
    """df with base and added, as of spans_of()."""
    out = df.withColumn("__spans", spans_of(F.col(text), boosted))
    return out.withColumns({"base": F.col("__spans.base"), "added": F.col("__spans.added")}).drop("__spans")


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with each run of overlapping spans replaced by '<KIND>' of its first span."""
    run = "struct<start: int, end: int, kind: string>"
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    closed = F.array(F.struct(F.lit(2147483647).alias("start"), F.lit(2147483647).alias("end"), F.lit("").alias("kind")))
    none, nothing = F.lit(None).cast(run), F.array().cast(f"array<{run}>")

    def step(a: Column, s: Column) -> Column:
        longer = F.struct(a["start"].alias("start"), F.greatest(a["end"], s["end"]).alias("end"), a["kind"].alias("kind")).cast(run)
        fresh = F.struct(s.cast(run).alias("st"), F.when(a.isNull(), nothing).otherwise(F.array(a).cast(f"array<{run}>")).alias("out"))
        return F.when(a.isNotNull() & (s["start"] < a["end"]), F.struct(longer.alias("st"), nothing.alias("out"))).otherwise(fresh)

    _, runs = swept(F.concat(ordered, closed), none, step, run, run)

    def built(r: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(0), F.size(r)), lambda i: F.struct(F.coalesce(F.get(r, i - 1)["end"], F.lit(0)).alias("start"), F.coalesce(F.get(r, i)["start"], F.length(text)).alias("end")))
        marks = F.concat(F.transform(r, lambda x: F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">"))), F.array(F.lit("")))
        return F.array_join(F.zip_with(pieces_of(text, gaps), marks, lambda p, m: F.concat(p, m)), "")

    return F.when(F.size(spans) == 0, text).otherwise(let(runs, built))


def redact(df: DataFrame, text: str = "text", boosted: Boosted | None = None) -> DataFrame:
    """df with all spans in text replaced; null stays null, and no other column changes."""
    out = df.withColumn("__spans", spans_of(F.col(text), boosted))
    whole = let(F.concat("__spans.base", "__spans.added"), lambda s: redacted(F.col(text), s))
    return out.withColumn(text, F.when(F.col(text).isNotNull(), whole)).drop("__spans")
