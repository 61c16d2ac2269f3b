"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod-97 for account numbers), and words
shortly before a span adjust its score; spans that reach the threshold are kept. Kinds in order: email, ip, card,
phone, iban, ssn. The base spans (email, ip, card, phone with a country prefix) score the threshold by themselves.
Account numbers need their checksum and no context; each length that one may have is tried, as words after it may
look like more of it. National phone numbers and social security numbers, which
have no checksum, need a context word; a national phone number inside a base phone span is part of it.

Positions: splitting a text by a pattern gives what lies between its matches; lengths of both, added up, give each
match's place in code points. The patterns take whole runs possessively and start only where a run starts, so each
reads a text once, however long its runs are; they match what the plain patterns match. Places are added up in lots
(running), and what stands around a span is read from the text's pieces, so that neither grows with the
square of a text's matches nor walks the text from its start for each.

Rows: a null or empty text has no spans. Null ids and repeated rows are kept as they are. An empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}"
CARD = r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?+[0-9]){15,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Where an account number may start, and its text if it has n letters and digits.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?: ?[A-Z0-9]){11})"
IBAN_OF = r"^[A-Z0-9](?: ?[A-Z0-9]){%d}(?![A-Za-z0-9])"
#: Lengths of account numbers by country (the registry's); others may have 15 to 34.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
NATIONAL = r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"
#: A text without any of these has no ip, card, iban, ssn or national phone number.
LIKELY = r"(?=[0-9A-Z])(?:[0-9](?:[ -]?[0-9]){15}|[0-9](?:\.[0-9]++){3}|[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11})"
PART = "0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
#: Words that speak for a kind, in the characters before a span.
NEAR = 40
PHONE_WORDS = "(^|[^a-z])(phone|telephone|tel|call|mobile|cell|fax|telefon|teléfono|téléphone)([^a-z]|$)"
SSN_WORDS = "(^|[^a-z])(ssn|social security|social-security)([^a-z]|$)"
IBAN_WORDS = "(^|[^a-z])(iban|account|bank|konto|cuenta|compte)([^a-z]|$)"
THRESHOLD = 0.5
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")


#: Matches that are placed in one lot, and characters of a piece of text.
LOT, PIECE = 128, 1024
SPAN = "struct<start:int,end:int,what:string>"
NONE = f"cast(array() as array<{SPAN}>)"


# Expressions are written as SQL: a tree of this size, built call by call, takes the driver seconds.


def let(name: str, value: str, use: str) -> str:
    """use with name standing for value, which is worked out once: inside a lambda it would be for each element."""
    return f"get(transform(array({value}), {name} -> {use}), 0)"


def running(items: str, zero: str, after: str, out: str) -> str:
    """array<SPAN>: a fold over items that gives something for each. after and out are the next state and an array of
    what comes out, of the state t.state and the item x. A fold copies what it has gathered at every step, so it
    gathers lots, and then the lots."""
    lot = f"aggregate(part, named_struct('state', s.state, 'out', {NONE}), (t, x) -> named_struct('state', {after}, 'out', concat(t.out, {out})))"
    add = let("r", lot, "named_struct('state', r.state, 'out', concat(s.out, array(r.out)))")
    parts = f"transform(sequence(0, cast((size(given) - 1) div {LOT} as int)), i -> slice(given, i * {LOT} + 1, {LOT}))"
    lots = f"flatten(aggregate({parts}, named_struct('state', {zero}, 'out', cast(array() as array<array<{SPAN}>>)), (s, part) -> {add}, s -> s.out))"
    return let("given", items, f"if(size(given) > 0, {lots}, {NONE})")


def matches(pattern: str) -> str:
    """array<SPAN> of a pattern's matches in column text, in code points, end exclusive."""
    both = f"zip_with(m, slice(split(text, r'{pattern}', -1), 1, size(m)), (w, g) -> named_struct('what', w, 'gap', g))"
    end = "t.state + length(x.gap) + length(x.what)"
    placed = running(both, "0", end, f"array(named_struct('start', t.state + length(x.gap), 'end', {end}, 'what', x.what))")
    return let("m", f"regexp_extract_all(text, r'{pattern}', 0)", f"if(size(m) > 0, {placed}, {NONE})")


def around(start: str, length: str) -> str:
    """length (under a piece) characters of the text from start (from 0) on, fewer at its end, read from the row's
    column pieces: the text itself would be walked from its beginning."""
    two = f"concat(get(pieces, cast(({start}) div {PIECE} as int)), coalesce(get(pieces, cast(({start}) div {PIECE} as int) + 1), ''))"
    return f"if(({length}) > 0, coalesce(substring({two}, ({start}) % {PIECE} + 1, {length}), ''), '')"


def digits(what: str) -> str:
    return f"regexp_replace({what}, '[^0-9]', '')"


def luhn(number: str) -> str:
    """Whether a string of digits passes Luhn's check."""
    d = "cast(substring(turned, i, 1) as int)"
    total = f"aggregate(sequence(1, length(turned)), 0, (sum, i) -> sum + if(i % 2 = 1, {d}, if({d} > 4, 2 * {d} - 9, 2 * {d})))"
    return let("turned", f"reverse({number})", f"{total} % 10 = 0")


def mod97(what: str) -> str:
    """Whether an account number, blanks aside, leaves 1: its first four characters go last, letters count 10 to 35."""
    c = "ascii(substring(turned, i, 1))"
    rest = f"aggregate(sequence(1, length(turned)), 0, (rest, i) -> cast(if({c} >= 65, (rest * 100 + {c} - 55) % 97, (rest * 10 + {c} - 48) % 97) as int))"
    whole = let("turned", "concat(substring(plain, 5), substring(plain, 1, 4))", f"{rest} = 1")
    return let("plain", f"replace({what}, ' ', '')", f"length(plain) between 15 and 34 and {whole}")


def account_numbers(heads: str) -> str:
    """array<SPAN> of the account numbers that start at heads, none over another. Every length that ends with a word
    is held against the checksum; the country's own goes first, then the longest."""
    of = {n: f"regexp_extract(tail, r'{IBAN_OF % (n - 1)}', 0)" for n in range(34, 14, -1)}
    own = " ".join(f"when substring(h.what, 1, 2) in ({', '.join(repr(c) for c in countries.split())}) then {of[n]}" for n, countries in IBAN_LENGTHS.items())
    number = let("tail", around("h.start", "68"), f"get(filter(array(case {own} else '' end, {', '.join(of.values())}), w -> w <> '' and {mod97('w')}), 0)")
    tried = f"transform({heads}, h -> {let('w', number, "named_struct('start', h.start, 'end', h.start + length(w), 'what', w)")})"
    free = "x.what is not null and x.start >= t.state"
    return running(tried, "0", f"if({free}, x.end, t.state)", f"if({free}, array(x), {NONE})")


def near(words: str) -> str:
    """1 if one of the words stands in the characters before span x, else 0."""
    before = f"lower({around(f'greatest(0, x.start - {NEAR})', f'least({NEAR}, x.start)')})"
    return f"if(x.start > 0 and {before} rlike '{words}', 1.0D, 0.0D)"


def bare(kind: str) -> str:
    """No character of the kind right before or after span x."""
    before = f"if(x.start > 0, {around('x.start - 1', '1')}, '')"
    return f"not {before} rlike '{kind}' and not {around('x.end', '1')} rlike '{kind}'"


def _scored(kind: str, spans: str, base: bool, keep: str = "true", score: str = "1.0D") -> str:
    return f"transform(filter({spans}, x -> {keep}), x -> named_struct('kind', '{kind}', 'start', x.start, 'end', x.end, 'score', {score}, 'base', {base}))"


def proposals() -> dict[str, str]:
    """Scored spans of each proposal, array<struct<kind, start, end, score, base>>, of columns text (not null),
    likely and pieces."""
    where = lambda condition, pattern: f"if({condition}, {matches(pattern)}, {NONE})"
    if_digits = lambda pattern: where("likely", pattern)
    long = lambda lo, hi: f"length({digits('x.what')}) between {lo} and {hi}"
    return {
        "email": _scored("email", where("contains(text, '@')", EMAIL), True),
        "ip": _scored("ip", if_digits(IP), True, rf"x.what rlike r'^{PART}(\.{PART}){{3}}$'"),
        "card": _scored("card", if_digits(CARD), True, f"{long(16, 19)} and {luhn(digits('x.what'))}"),
        "phone": _scored("phone", where("contains(text, '+')", PHONE), True, long(8, 15)),
        "iban": _scored("iban", account_numbers(if_digits(IBAN)), False, score=f"0.7D + 0.3D * {near(IBAN_WORDS)}"),
        "ssn": _scored("ssn", if_digits(SSN), False, f"{bare('[A-Za-z0-9-]')} and not x.what rlike '^(000|666|9)|-00-|-0000$'", f"0.2D + 0.5D * {near(SSN_WORDS)}"),
        "national": _scored("phone", if_digits(NATIONAL), False, bare("[0-9+]"), f"0.2D + 0.5D * {near(PHONE_WORDS)}"),
    }


def outside() -> str:
    """Base and proposed phone spans in order, without proposed ones that overlap a base one. Neither kind overlaps
    its own, and a base span of 15 digits meets two proposed ones of ten at most, so three neighbours decide."""
    reaching = f"filter(national, x -> x.score >= {THRESHOLD})"
    over = [let("y", f"if(i + {by} >= 0, get(every, i + {by}), null)", "coalesce(y.base and y.start < x.end and x.start < y.end, false)") for by in (-3, -2, -1, 1, 2)]
    kept = f"filter(every, (x, i) -> x.base or not ({' or '.join(over)}))"
    return f"if(size(national) > 0, {let('every', f'array_sort(concat(phone, {reaching}), (a, b) -> a.start - b.start)', kept)}, phone)"


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, and spans array<struct<kind, start, end, score, base>>, ordered by kind as
    listed, then start."""
    source = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    source = source.withColumn("likely", F.col("text").rlike("[0-9]") & F.col("text").rlike(LIKELY))
    # a Generate stands between, so that the pieces are cut once a row and not for each place that is read
    cut = f"explode(array(if(likely, regexp_extract_all(text, r'(?s).{{1,{PIECE}}}', 0), cast(array() as array<string>)))) as pieces"
    found = source.selectExpr("*", cut).selectExpr("doc_id", *[f"{c} as {k}" for k, c in proposals().items()])
    reach = lambda c: f"filter({c}, x -> x.score >= {THRESHOLD})"
    return found.selectExpr("doc_id", f"concat(email, ip, card, {outside()}, {reach('iban')}, {reach('ssn')}) as spans")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans, base_sha256, and all spans as kind:start:end, comma-joined."""
    joined = lambda a: f"array_join(transform({a}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    counts = [f"cast(size(filter(spans, x -> x.base and x.kind = '{k}')) as long) as n_{k}" for k in KINDS[:4]]
    return found.selectExpr("doc_id", *counts, f"sha2(cast({joined('filter(spans, x -> x.base)')} as binary), 256) as base_sha256", f"{joined('spans')} as spans")
