"""Personal data by candidate gradient boosting, in built-in Spark functions.

Base matches of each kind are exact patterns with their checks and always stay. High-recall generators,
several for each kind, propose further spans, which overlap, nest and are shifted against each other:
addresses spelled out, numbers without a country code or with an extension, cards with any separators,
unchecked runs of digits, network addresses in other notations, and secrets (a kind of its own, as it has no
base pattern). Boosted trees score each by its format and the text around it; candidates over their kind's
calibrated threshold are taken by score, each that overlaps none taken before. The trees are fitted on the
driver to spans planted in written sentences, read by the same generators and feature expressions, and
compiled into one expression.

Positions come from running sums in blocks, overlaps from running maxima, so that time grows with a text's
length and matches. Only candidates that chain into each other are compared with all others of the chain.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting

KINDS = ("email", "ip", "card", "phone")
#: Kinds of candidates; the last has no base pattern.
ALL = (*KINDS, "secret")
SECRET = ALL.index("secret")
#: Base patterns, with possessive loops where a shorter match cannot succeed either, so that long texts
#: need neither stack nor quadratic time; the starts left out by the look-behinds cannot match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:\x20?[(\[{<]\x20?(?:at|@)\x20?[)\]}>]\x20?|\x20at\x20|\x20{1,2}@\x20{0,2}|@\x20{1,2})", r"(?:\x20?[(\[{<]\x20?(?:dot|\.)\x20?[)\]}>]\x20?|\x20dot\x20|\x20?\.\x20?)"
_NAMED = r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|key|auth|bearer|credentials?)"
#: Generators of candidates by name: kind, pattern, and what a text must match for the pattern to be tried.
GENERATORS = {
    "email_spelled": ("email", rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{{1,64}}{_AT}[a-z0-9-]{{1,63}}(?:{_DOT}[a-z0-9-]{{2,24}}){{1,4}}", r"(?i)[(\[{<]\x20?(?:at|@)\x20?[)\]}>]|\x20dot\x20|\x20@|@\x20|\x20at\x20[a-z0-9-]+\."),
    "email_short": ("email", rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{{1,64}}{_AT}[a-z0-9-]{{1,63}}{_DOT}(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|ch|at|it|nl)(?![a-z0-9-])", r"(?i)[(\[{<]\x20?(?:at|@)\x20?[)\]}>]|\x20dot\x20|\x20@|@\x20|\x20at\x20[a-z0-9-]+\."),
    "ip_other": ("ip", r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9]{1,3}(?:\x20?[(\[]\.[)\]]\x20?[0-9]{1,3}|\x20\.\x20[0-9]{1,3}){3})(?![0-9A-Za-z:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]|[0-9]\x20?[(\[]?\.[)\]]?\x20?[0-9]|[0-9]\x20\.\x20[0-9]"),
    "ip_short": ("ip", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){1,6}:(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?(?![0-9A-Za-z:])", "::"),
    "ip_dashed": ("ip", r"(?<![0-9.-])[0-9]{1,3}(?:-[0-9]{1,3}){3}(?![0-9-])", r"[0-9]-[0-9]"),
    "card_groups": ("card", r"(?<![0-9])[0-9]{3,6}(?:[\x20._/-]{1,3}[0-9]{3,6}){2,4}(?![0-9])", "[0-9]{3}"),
    "card_digits": ("card", r"(?<![0-9])[0-9](?:[\x20._-]?[0-9]){12,18}(?![0-9])", "[0-9]"),
    "phone_groups": ("phone", r"(?<![0-9A-Za-z+])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20./-]{1,2}[0-9]{2,5}){1,4}(?![0-9A-Za-z])", r"[0-9][\x20./)-]"),
    "phone_extension": ("phone", r"(?i)(?<![0-9A-Za-z+])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20./-]{1,2}[0-9]{2,5}){1,4}\x20?(?:x|ext\.?)\x20?[0-9]{1,5}(?![0-9A-Za-z])", r"(?i)[0-9]\x20?(?:x|ext\.?)\x20?[0-9]"),
    "phone_local": ("phone", r"(?<![0-9A-Za-z+])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z])", "[0-9][.-][0-9]"),
    "secret_value": ("secret", rf"(?i)(?<={_NAMED}[\x22']?\x20{{0,2}}[:=]\x20{{0,2}}[\x22']?)[^\s\x22',;:=][^\s\x22',;]{{4,126}}[^\s\x22',;.)]", rf"(?i){_NAMED}[\x22']?\x20{{0,2}}[:=]"),
    "secret_run": ("secret", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]{0,127}[0-9])[A-Za-z0-9+/_-]{24,128}={0,2}(?![A-Za-z0-9+/_=-])", "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24}"),
    "secret_prefix": ("secret", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|sk[_-](?:live|test)[_-][A-Za-z0-9]{16,64}|xox[abpr]-[A-Za-z0-9-]{10,64}|eyJ[A-Za-z0-9_-]{8,255}\.[A-Za-z0-9_-]{8,255}\.[A-Za-z0-9_-]{8,255})(?![A-Za-z0-9])", "AKIA|gh[opsu]_|sk[_-](?:live|test)|xox[abpr]-|eyJ"),
}
#: Code points before and after a candidate that its features see.
BEFORE, AFTER = 32, 2
CONTEXTS = {
    "phone": "phone|tel|call|mobile|cell|fax|ring|text me|contact|telefon|anruf|handy|appele|portable|llam|m[oó]vil|numero|number",
    "card": "card|visa|master|amex|credit|debit|payment|karte|kredit|carte|paiement|tarjeta|pago",
    "email": "mail|write|contact|reach|schreib|kontakt|[eé]cri|correo|escrib|adress",
    "ip": r"\bip\b|host|server|address|adress|ping|node|router|servidor|serveur|client",
    "secret": f"(?:{_NAMED})\\W{{0,6}}$",
    "other": "isbn|issn|version|date|order|invoice|page|pages|section|rfc|article|score|total|price|ratio|between|from|seit|datum|commit|sha|hash|id\\b",
}
FEATURES = (
    "kind", "length", "digits", "letters", "groups", "first", "last", "paren", "luhn", "brand", "dashes", "dots", "spaces", "slashes", "colons", "date", "spelled", "ending", "zero", "distinct", "hex", "cases", "quoted", "assigned",
    *(f"near_{k}" for k in CONTEXTS), "joined", "percent",
)
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
DATE = r"^(?:(?:1[89]|20)[0-9]{2}[ ./-][0-9]{1,2}[ ./-][0-9]{1,2}|[0-3]?[0-9][ ./-][01]?[0-9][ ./-](?:1[89]|20)[0-9]{2})|^(?:1[89]|20)[0-9]{2}\s*[-/]\s*(?:1[89]|20)[0-9]{2}$"
SPELLED, ENDING = r"(?i)[(\[{<]\x20?(?:at|@|dot|\.)\x20?[)\]}>]|\x20dot\x20", r"(?i)(?:\b|\W)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|ch|at|it|nl)$"
BRAND = r"^(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})$"
SPAN = "array<struct<kind:int,start:int,end:int,value:string,before:string,after:string,score:double>>"
#: Values of an array that are folded one after another; blocks of them are joined by their last ones.
BLOCK = 256
#: Spans of a text up to which redaction cuts the text itself; beyond, an array of its characters.
FEW = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, though it stands in it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, merge: Callable[[Column, Column], Column], none: Column) -> Column:
    """The values of an array each merged with all before it (``none`` is neutral), in blocks: a fold copies what it has."""

    def folded(some: Column) -> Column:
        return F.aggregate(some, F.array(none), lambda a, x: F.concat(a, F.array(merge(F.element_at(a, -1), x))))

    def blocked(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: F.slice(folded(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))), F.lit(2), F.lit(BLOCK)))
        return let(blocks, lambda x: F.flatten(F.zip_with(x, F.slice(folded(F.transform(x, lambda y: F.element_at(y, -1))), F.lit(1), F.size(x)), lambda y, o: F.transform(y, lambda z: merge(o, z)))))

    return let(values, lambda v: F.when(F.size(v) > BLOCK, blocked(v)).otherwise(F.slice(folded(v), F.lit(2), F.size(v) + 1)))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def part(i: Column) -> Column:
        d = F.substr(number, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda a, i: a + part(i)) % 10 == 0


def base_holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(OCTETS)
    number = digits(value)
    if kind == "card":
        return F.when(F.length(number).between(13, 19), luhn(number)).otherwise(F.lit(False))
    return F.length(number).between(9, 15) if kind == "phone" else F.lit(True)


def located(found: list[tuple[int, Column, Column]]) -> Column:
    """Spans, in code points, of (kind, matches, what stands between them), in this order, by start."""

    def spans(p: Column) -> Column:
        n, last = F.size(p["found"]), F.concat(F.array(F.lit("")), p["found"])  # the match before, if any
        around = F.zip_with(F.slice(p["gaps"], F.lit(1), n), F.slice(last, F.lit(1), n), lambda g, m: F.struct((F.length(g) + F.length(m)).alias("step"), F.right(F.concat(m, g), F.lit(BEFORE)).alias("before")))

        def made(x: Column) -> Column:
            starts = running(F.transform(x, lambda y: y["step"]), lambda a, b: a + b, F.lit(0))
            placed = F.zip_with(p["found"], starts, lambda m, s: F.struct(m.alias("value"), s.alias("start")))
            contexts = F.zip_with(x, F.slice(p["gaps"], F.lit(2), n), lambda y, g: F.struct(y["before"].alias("before"), F.left(g, F.lit(AFTER)).alias("after")))
            return F.zip_with(placed, contexts, lambda v, c: F.struct(p["kind"].alias("kind"), v["start"].alias("start"), (v["start"] + F.length(v["value"])).alias("end"), v["value"].alias("value"), c["before"].alias("before"), c["after"].alias("after"), F.lit(2.0).alias("score")))

        return let(around, made).cast(SPAN)

    each = F.array(*(F.struct(F.lit(kind).alias("kind"), matches.alias("found"), gaps.alias("gaps")) for kind, matches, gaps in found))
    return F.flatten(F.transform(F.filter(each, lambda p: F.size(p["found"]) > 0), spans))


def free_of(loose: Column, base: Column) -> Column:
    """The spans ``loose`` that no span of ``base`` overlaps, by start: from the last end before and the next start after each."""
    far = F.lit(2**31 - 1)
    event = lambda spans, which: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(which).alias("loose"), s.alias("s")))

    def kept(events: Column) -> Column:
        ends = running(F.transform(events, lambda e: F.when(e["loose"] == 0, e["end"]).otherwise(F.lit(-1))), F.greatest, F.lit(-1))
        starts = F.reverse(running(F.reverse(F.transform(events, lambda e: F.when(e["loose"] == 0, e["start"]).otherwise(far))), F.least, far))
        bounds = F.zip_with(ends, starts, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        apart = F.zip_with(events, bounds, lambda e, b: F.struct(e["s"].alias("s"), ((e["loose"] == 1) & (b["x"] <= e["start"]) & (b["y"] >= e["end"])).alias("keep")))
        return F.transform(F.filter(apart, lambda p: p["keep"]), lambda p: p["s"])

    return let(F.sort_array(F.concat(event(base, 0), event(loose, 1))), kept)


def proposed(docs: DataFrame) -> DataFrame:
    """``docs`` (with a column ``text`` that is not null) with ``base`` (checked spans by kind and start) and ``loose`` (candidates by start).

    What a pattern matches and what stands between its matches give the positions, without a user
    function. Each pattern has a cheap test that the text can match at all.
    """
    digit, at = F.col("digit"), F.contains(F.col("text"), F.lit("@"))
    gates = {"email": at, "ip": digit, "card": digit, "phone": digit & F.contains(F.col("text"), F.lit("+"))}
    tried = {f"base_{k}": (i, BASE[k], gates[k]) for i, k in enumerate(KINDS)}
    # what any match has in it; the tests proper are tried on what has that only, and equal tests once
    has = lambda *parts: reduce(lambda a, b: a | b, (F.contains(F.col("text"), F.lit(x)) for x in parts))
    needs = {"secret_value": has("=", ":"), "secret_prefix": has("_", "AKIA", "xox", "eyJ", "sk-")}
    tests = {test: f"t_{i}" for i, test in enumerate(dict.fromkeys(t for *_, t in GENERATORS.values()))}
    first = {t: needs.get(n, F.lit(True) if kind == "email" else digit) for n, (kind, _, t) in GENERATORS.items()}
    tried |= {n: (ALL.index(kind), p, F.col(tests[t])) for n, (kind, p, t) in GENERATORS.items()}
    none = F.array().cast("array<string>")
    docs = docs.withColumn("digit", F.col("text").rlike("[0-9]")).withColumns({c: first[t] & F.col("text").rlike(t) for t, c in tests.items()})
    docs = docs.withColumns({f"m_{n}": F.when(gate, F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none) for n, (_, p, gate) in tried.items()})
    docs = docs.withColumns({f"g_{n}": F.when(F.size(f"m_{n}") > 0, F.split("text", p, -1)) for n, (_, p, _) in tried.items()})
    spans = lambda names: located([(tried[n][0], F.col(f"m_{n}"), F.col(f"g_{n}")) for n in names])
    docs = docs.withColumns({"base": spans([f"base_{k}" for k in KINDS]), "any": spans(GENERATORS)}).drop("digit", *tests.values(), *(f"{x}_{n}" for x in "mg" for n in tried))
    holds = lambda s: reduce(lambda rest, i: rest.when(s["kind"] == i, base_holds(KINDS[i], s["value"])), range(2, len(KINDS)), F.when(s["kind"] == 1, base_holds("ip", s["value"]))).otherwise(F.lit(True))
    docs = docs.withColumn("base", F.filter("base", holds))
    # equal spans of several generators count once; a candidate that a base span overlaps is not needed
    return docs.withColumn("loose", F.when(F.size("any") == 0, F.col("any")).otherwise(free_of(F.array_distinct("any"), F.col("base")))).drop("any")


def features(span: Column) -> list[Column]:
    """The columns named in FEATURES, all double, of a candidate."""
    value, number, before = span["value"], digits(span["value"]), F.lower(span["before"])
    count = lambda c: F.length(value) - F.length(F.translate(value, c, ""))
    parts = F.filter(F.split(value, "[^0-9A-Za-z]+"), lambda p: p != "")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    columns = {
        "kind": span["kind"],
        "length": F.length(value),
        "digits": F.length(number),
        "letters": F.length(F.regexp_replace(value, "[^A-Za-z]", "")),
        "groups": F.size(parts),
        "first": F.length(F.get(parts, F.lit(0))),
        "last": F.length(F.get(parts, F.size(parts) - 1)),
        "paren": flag(F.contains(value, F.lit("("))),
        "luhn": F.when(F.length(number).between(13, 19), flag(luhn(number))).otherwise(0.0),
        "brand": flag(number.rlike(BRAND)),
        "dashes": count("-"),
        "dots": count("."),
        "spaces": count(" "),
        "slashes": count("/_"),
        "colons": count(":"),
        "date": flag(value.rlike(DATE)),
        "spelled": flag(value.rlike(SPELLED)),
        "ending": flag(value.rlike(ENDING)),
        "zero": flag(number.startswith("0")),
        "distinct": F.size(F.array_distinct(F.split(value, ""))),
        "hex": flag(value.rlike("^[0-9a-f]+$")),
        "cases": flag(value.rlike("[a-z]")) + flag(value.rlike("[A-Z]")) + flag(value.rlike("[0-9]")),
        "quoted": flag(before.rlike(r"[\x22']$")),
        "assigned": flag(before.rlike(r"[:=]\x20{0,2}[\x22']?$")),
        **{f"near_{k}": flag(before.rlike(p)) for k, p in CONTEXTS.items()},
        "joined": flag(before.rlike(r"[0-9A-Za-z][./_+-]?$")) + flag(span["after"].rlike(r"^[./_+-]?[0-9A-Za-z]")),
        "percent": flag(span["after"].rlike(r"^[\x20]?[%€$£]|^[,.][0-9]")),
    }
    return [columns[k].cast("double") for k in FEATURES]


@dataclass
class Model:
    trees: boosting.Boosted
    thresholds: tuple[float, ...]  # of the margin, by kind


#: Words of the written sentences, some of several languages, beside made-up ones.
WORDS = (
    "the and of to in that was for on with as by we they from have this but not are which one you all her there been their more about time would people only new over some could"
    " der die und das ist nicht mit auf ein haben wir sie von für auch nach bei aber le la les des est pas pour dans une avec sur plus mais nous vous el los las que con por una para más pero como muy"
).split()


def written_sentences(n: int = 3000, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """(text, kind or -1, start, end): sentences with one planted span, or with something like one that is none."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    run = lambda k: "".join(str(int(d)) for d in rng.integers(0, 10, k))
    of = lambda chars, k: "".join(pick(chars) for _ in range(k))
    made = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(2, 9))))
    word = lambda: pick(WORDS) if rng.random() < 0.6 else made()
    prose = lambda k: " ".join(word().capitalize() if rng.random() < 0.1 else word() for _ in range(k))
    low, hexa, mixed = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def checked(size: int, lead: str) -> str:
        body = lead + run(size - 1 - len(lead))
        total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(body))))
        return body + str(-total % 10)

    def unchecked(size: int) -> str:
        while True:
            body = run(size)
            if sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(body)))) % 10:
                return body

    def grouped(number: str, by: str) -> str:
        return by.join(number[i : i + 4] for i in range(0, len(number), 4))

    def email() -> str:
        at, dot = pick([(" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "), (" (at) ", "."), ("[at]", "."), (" @ ", "."), (" @ ", " . "), ("@ ", "."), (" {at} ", " {dot} "), (" at ", ".")])
        return made() + pick(["", "." + made(), str(int(rng.integers(100)))]) + at + made() + dot + pick(["com", "org", "net", "de", "fr", "es", "io", "co" + dot + "uk"])

    def ip() -> str:
        kind = int(rng.integers(3))
        if kind == 0:
            return ":".join(of(hexa, int(rng.integers(1, 5))) for _ in range(8))
        if kind == 1:
            return ":".join(of(hexa, int(rng.integers(2, 5))) for _ in range(int(rng.integers(2, 5)))) + "::" + of(hexa, int(rng.integers(1, 5)))
        return pick(["[.]", "(.)", " . "]).join(str(int(rng.integers(1, 255))) for _ in range(4))

    def card() -> str:
        return grouped(checked(16, pick(["4", "51", "53", "2221", "6011"])), pick([".", "/", "_", "  ", " - ", "--"]))

    def phone() -> str:
        by = pick([" ", "-", ".", "/"])
        number = pick([f"({run(3)}) {run(3)}{pick('-. ')}{run(4)}", by.join((run(3), run(3), run(4))), f"0{run(3)}{by}{run(3)}{by}{run(4)}", f"00{run(2)} {run(3)} {run(3)} {run(4)}", f"({run(4)}) {run(3)} {run(3)}"])
        return number + (pick([" x", " ext ", " ext. ", "x"]) + run(int(rng.integers(2, 5))) if rng.random() < 0.15 else "")

    def secret() -> str:
        return pick([of(hexa, int(rng.choice([32, 40, 64]))), of(hexa, 40), of(mixed, int(rng.integers(20, 60))), f"AKIA{of('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 16)}", f"ghp_{of(mixed, 36)}", f"sk_live_{of(mixed, 24)}", f"eyJ{of(mixed, 20)}.{of(mixed, 40)}.{of(mixed, 30)}", of(mixed + "!#$%&*", int(rng.integers(8, 16)))])

    leads = (
        ("mail me at", "write to", "contact", "email:", "schreib an", "correo", "écrivez à", "reach us"), ("server", "ip", "host", "address", "ping", "the node"), ("card", "visa number", "credit card:", "pay with card", "Karte", "tarjeta", "carte"),
        ("call", "phone:", "tel.", "mobile", "fax", "Telefon", "llame al", "appelez le", "my number is"), ("token =", "token:", "api_key=", "password:", "secret =", "access_key =", "pwd =", '"auth":', "bearer:"),
    )
    makers = (email, ip, card, phone, secret)

    def other() -> str:
        year = str(int(rng.integers(1800, 2030)))
        return pick(
            [
                f"{year}-{run(2)}-{run(2)}", f"{run(2)}.{run(2)}.{year}", f"{run(2)}/{run(2)}/{year}", f"{year}-{int(year) + int(rng.integers(1, 9))}", f"{run(3)} {run(3)}", f"{run(2)} {run(3)} {run(3)}", f"978-{run(1)}{run(2)}-{run(5)}-{run(3)}", f"{run(3)}-{run(2)}",
                grouped(unchecked(16), " "), grouped(unchecked(16), "."), unchecked(16), unchecked(16), unchecked(16), unchecked(14), run(int(rng.integers(20, 30))), f"{run(3)}.{run(2)}", f"{run(5)}-{run(4)}", f"{run(2)}-{run(3)}-{run(4)}", f"{run(3)} - {run(3)}", f"{run(2)}-{run(2)}-{run(2)}-{run(2)}",
                f"meet at {word()}.{word()} now", f"look at {word()} dot {word()}", f"{word()} @ {word()}. {word()}", f"{run(2)} . {run(2)}", f"{run(3)}/{run(3)}/{run(2)}", f"{run(4)} {run(3)} {run(4)} {run(5)}", f"{run(3)} {run(2)} {run(4)} {run(2)}", f"{run(3)}-{run(4)}", f"{run(2)}:{run(2)}:{run(2)}", f"std::{word()}",
                "-".join(made() for _ in range(6)) + run(1), f"/{made()}/{made()}{run(2)}/{made()}/{made()}/{made()}/{made()}", f"key: {word()} {word()}", f"the key = {word()}", f"password: {word()}", f"{made().upper()}_{made().upper()}_{made().upper()}_{made().upper()}_{run(2)}", f"commit {of(hexa, 40)}", f"sha {of(hexa, 40)}", "abc" * 9 + run(1),
            ]
        )

    rows = []
    for _ in range(n):
        before, after = prose(int(rng.integers(0, 9))), prose(int(rng.integers(0, 8)))
        if rng.random() < 0.5:
            kind = int(rng.integers(len(makers)))
            value = makers[kind]()
            plain = kind == SECRET and not value.startswith(("AKIA", "ghp_", "sk_", "eyJ"))  # what only its name tells
            lead = pick(leads[kind]) if rng.random() < 0.8 or kind == 2 or plain else word()
            quote = pick(["", "", '"', "'"]) if kind == SECRET and lead in leads[kind] else ""
        else:
            kind, value, quote = -1, other(), ""
            lead = pick(["version", "on", "order", "isbn", "pages", "total", "between", "from", word(), word(), word(), *leads[int(rng.integers(2))][:2]])
        head = f"{before} {lead} ".lstrip() + quote
        rows.append((f"{head}{value}{quote or pick(['', '.', ',', ''])}{pick(['', ' ' + after])}", kind, len(head), len(head) + len(value)))
    return rows


def fit(spark: SparkSession, precision: float = 0.97) -> Model:
    """Model of the written sentences' candidates: one that is a planted span of its kind, but for a character at its ends, is right.

    Of the third of the sentences that the trees do not see, overlapping candidates are resolved by margin. A
    kind's threshold lies between the lowest margin down to which what is left reaches ``precision`` and the
    next lower one, and never below even odds.
    """
    rows = [(i, *r) for i, r in enumerate(written_sentences())]
    table = spark.createDataFrame(rows, "n int, text string, kind int, start int, `end` int")
    found = proposed(table).select("n", "kind", "start", "end", F.explode("loose").alias("s"))
    right = (F.col("kind") == F.col("s.kind")) & (F.abs(F.col("s.start") - F.col("start")) <= 1) & (F.abs(F.col("s.end") - F.col("end")) <= 1)
    got = sorted(tuple(r) for r in found.select("n", F.col("s.start"), F.col("s.kind"), F.col("s.end"), right.cast("int"), *features(F.col("s"))).collect())  # as many as the sentences have
    x, y, n = np.array([r[5:] for r in got]), np.array([r[4] for r in got], float), np.array([r[0] for r in got])
    seen = n % 3 != 2
    trees = boosting.fit(x[seen], y[seen], trees=40, depth=4)
    margin, taken = trees.margin(x), {}
    for i in sorted(np.flatnonzero(~seen), key=lambda i: (-margin[i], got[i][1:4])):
        here = taken.setdefault(n[i], [])
        if all(got[i][3] <= got[j][1] or got[i][1] >= got[j][3] for j in here):
            here.append(i)
    left = np.array(sorted(i for here in taken.values() for i in here), int)
    thresholds = []
    for k in range(len(ALL)):
        of = left[x[left, 0] == k]
        of = of[np.argsort(-margin[of], kind="stable")]
        m, exact = margin[of], np.cumsum(y[of]) / np.arange(1, len(of) + 1)
        last = np.append(m[1:] < m[:-1], True)[: len(m)]  # equal margins pass together
        good = np.flatnonzero((exact >= precision) & last)
        thresholds.append(max(0.0, float(m[good[-1]] + m[min(good[-1] + 1, len(m) - 1)]) / 2) if len(good) else np.inf)
    return Model(trees, tuple(thresholds))


@lru_cache(1)
def _default(application: str) -> Model:
    return fit(SparkSession.active())


def default_model(spark: SparkSession) -> Model:
    """The model, fitted once an application."""
    return _default(spark.sparkContext.applicationId)


def chains(spans: Column) -> Column:
    """Of spans by start: for each chain of overlapping ones a struct of the number of its first (``first``) and its last end (``last``)."""

    def cut(ends: Column) -> Column:
        """``ends``: the last end up to each span. A chain ends before a span that begins at or after it."""
        n = F.size(ends)
        begin = F.zip_with(spans, F.slice(F.concat(F.array(F.lit(-1)), ends), F.lit(1), n), lambda s, e: s["start"] >= e)
        return let(begin, lambda b: F.zip_with(
            F.filter(F.transform(b, lambda x, i: F.when(x, i)), lambda i: i.isNotNull()),
            F.filter(F.zip_with(ends, F.concat(F.slice(b, F.lit(2), n), F.array(F.lit(True))), lambda e, x: F.when(x, e)), lambda e: e.isNotNull()),
            lambda i, e: F.struct(i.alias("first"), e.alias("last")),
        ))

    return let(running(F.transform(spans, lambda s: s["end"]), F.greatest, F.lit(-1)), cut)


def find(docs: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` with ``base``, ``spans`` and ``secrets``: arrays of (kind, start, end, value, score) by kind, then start.

    Positions count code points, ends are exclusive; base spans score 2. Added spans overlap no base span
    and no other added one: they are taken by score (at equal scores by kind, then start), each that overlaps
    none taken before. ``spans`` has the base spans and those added of the same kinds, ``secrets`` the added
    ones of the kind without base. A null text counts as empty and has no spans. Texts are read whole;
    repeated rows get equal spans; an empty table gives an empty one; other columns stay, whatever their
    names, but for ones named ``base``, ``spans`` or ``secrets``.
    """
    model = default_model(docs.sparkSession) if model is None else model
    docs = docs.drop("base", "spans", "secrets")
    # columns are set aside in one, so that their names cannot clash with those used here
    found = proposed(docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text")))

    def measured(s: Column) -> Column:
        return F.struct(s.alias("s"), F.array(*features(s)).alias("f"))

    def scored(m: Column) -> Column:
        score = model.trees.column([F.get(m["f"], F.lit(i)) for i in range(len(FEATURES))])
        return F.struct(*(m["s"][c].alias(c) for c in ("kind", "start", "end", "value")), score.alias("score"))

    def passes(s: Column) -> Column:
        return reduce(lambda rest, k: rest | ((s["kind"] == k) & (s["score"] >= F.lit(float(model.thresholds[k])))), range(len(ALL)), F.lit(False))

    plain = "array<struct<kind:int,start:int,end:int,value:string,score:double>>"
    bare = lambda spans: F.transform(spans, lambda s: F.struct(*(s[c].alias(c) for c in ("kind", "start", "end", "value", "score"))))
    none = F.array().cast(plain)
    found = found.withColumn("passing", F.when(F.size("loose") == 0, none).otherwise(F.filter(F.transform(F.transform("loose", measured), scored), passes).cast(plain)))

    def by_rank(a: Column, b: Column) -> Column:
        return F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).when(a["kind"] != b["kind"], a["kind"] - b["kind"]).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["end"] - b["end"])

    def take(taken: Column, s: Column) -> Column:
        return F.when(F.exists(taken, lambda o: (o["start"] < s["end"]) & (o["end"] > s["start"])), taken).otherwise(F.concat(taken, F.array(s)))

    found = found.withColumn("first", F.when(F.size("passing") > 1, F.transform(chains(F.col("passing")), lambda c: c["first"])))
    each = F.zip_with("first", F.concat(F.slice("first", F.lit(2), F.size("first")), F.array(F.size("passing"))), lambda a, b: F.slice("passing", a + 1, b - a))
    taken = F.flatten(F.transform(each, lambda chain: F.when(F.size(chain) == 1, chain).otherwise(F.aggregate(F.array_sort(chain, by_rank), none, take))))
    found = found.withColumn("added", F.when(F.size("passing") < 2, F.col("passing")).otherwise(taken))
    by_kind = lambda a, b: F.when(a["kind"] != b["kind"], a["kind"] - b["kind"]).otherwise(a["start"] - b["start"])
    spans = F.concat(bare(F.col("base")), F.filter("added", lambda s: s["kind"] != SECRET))
    return found.select("row.*", bare(F.col("base")).alias("base"), F.when(F.size(spans) < 2, spans).otherwise(F.array_sort(spans, by_kind)).alias("spans"), F.filter("added", lambda s: s["kind"] == SECRET).alias("secrets"))


def of_kind(spans: str, kind: int) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def listed(spans: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, ALL))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` of :func:`find` with ``redacted``: the text with each span or secret, or run of overlapping ones, replaced by [KIND] of its first."""
    found = find(docs, text, model)
    found = found.select(F.struct(*(c for c in found.columns if c != "redacted")).alias("row"), F.col(text).alias("text"), F.sort_array(F.transform(F.concat("spans", "secrets"), lambda s: F.struct(s["start"], s["kind"], s["end"]))).alias("all"))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in ALL))
    runs = F.transform(chains(F.col("all")), lambda c: F.struct(F.get("all", c["first"])["start"].alias("start"), c["last"].alias("end"), F.get("all", c["first"])["kind"].alias("kind")))
    found = found.withColumn("runs", F.when(F.size("all") > 0, runs)).withColumn("chars", F.when(F.size("runs") > FEW, F.split("text", "")))
    befores = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["end"]))

    def filled(cut: Callable[[Column, Column], Column]) -> Column:
        """Pieces between the runs, by (start, length), each with the mark that follows it; then the rest."""
        marked = F.zip_with("runs", F.slice(befores, F.lit(1), F.size("runs")), lambda r, b: F.concat(cut(b, r["start"] - b), F.get(names, r["kind"])))
        return F.concat(F.array_join(marked, ""), cut(F.element_at("runs", -1)["end"], F.length("text")))

    short = filled(lambda start, n: F.substr(F.col("text"), start + 1, n))
    long = filled(lambda start, n: F.array_join(F.slice("chars", start + 1, n), ""))
    redacted = F.when(F.size("all") == 0, F.col("text")).when(F.size("runs") <= FEW, short).otherwise(long)
    return found.select("row.*", redacted.alias("redacted"))
