"""Text normalisation as Column expressions: everything stays in the JVM and under code generation where it can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from kindred.functions import lexicon as L

def lookup(mapping: dict[str, str], key: Column) -> Column:
    """The mapped word, or the word itself."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.when(key.isin(*mapping), F.element_at(table, key)).otherwise(key)


def among(words: list[str], key: Column) -> Column:
    return key.isin(*words)


def ascii_fold(text: Column) -> Column:
    """Lower case without accents; & becomes 'and'; dotted initials meet; other marks become single blanks."""
    t = F.translate(F.lower(F.coalesce(text, F.lit(""))), L.ACCENTED, L.PLAIN)
    for a, b in (("ß", "ss"), ("œ", "oe"), ("æ", "ae"), ("&", " and "), ("'", "")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, r"(?<=\b[a-z])\.(?=[a-z]\b)", "")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def tokens(folded: Column) -> Column:
    return F.filter(F.split(folded, " "), lambda t: t != "")


def join_initials(toks: Column) -> Column:
    """Neighbouring single letters become one token."""
    single = lambda t: t.rlike("^[a-z]$")
    before = lambda i: F.get(toks, i - 1)
    glued = F.transform(toks, lambda t, i: F.when(i == 0, t).when(single(t) & single(before(i)), t).otherwise(F.concat(F.lit(" "), t)))
    return tokens(F.array_join(glued, ""))


def fix_ocr(tok: Column) -> Column:
    """Digits in a token of two letters or more are letters misread."""
    letters = F.length(F.regexp_replace(tok, "[^a-z]", ""))
    return F.when((letters >= 2) & tok.rlike("[0-9]"), F.translate(tok, "0136", "oieg")).otherwise(tok)


def squeeze(tok: Column) -> Column:
    return F.regexp_replace(tok, r"(.)\1+", "$1")


def skeleton(tok: Column) -> Column:
    """Consonants by sound: sound-alikes folded, vowels after the first letter dropped, repeats squeezed."""
    for a, b in L.SOUNDS:
        tok = F.replace(tok, F.lit(a), F.lit(b))
    return squeeze(F.regexp_replace(tok, "(?<=.)[aeiouy]", ""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once for the row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def name_views(raw: Column) -> Column:
    """struct(clean, core, skel, nospace, alt) of a business name; core is without designators."""
    site = lambda c: F.regexp_replace(c, L.SITE, " $1 ")
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), L.ID_TAG, " ")

    def halved(halves: Column) -> Column:
        bar = F.coalesce(F.get(halves, F.lit(1)), F.lit(""))
        return let(F.split(F.get(halves, F.lit(0)), L.ALIAS, 2), lambda sides: turned(sides, bar))

    def turned(sides: Column, bar: Column) -> Column:
        before, after = F.get(sides, F.lit(0)), F.coalesce(F.get(sides, F.lit(1)), F.lit(""))
        named = F.when(F.size(sides) > 1, ascii_fold(after) != "").otherwise(F.lit(False))
        both = F.when(named, F.struct(after.alias("first"), before.alias("other"))).otherwise(F.struct(before.alias("first"), bar.alias("other")))
        return let(both, lambda x: let(words(x["first"]), lambda toks: let(core(toks), lambda c: views(toks, c, x["other"]))))

    def words(first: Column) -> Column:
        fixed = let(F.transform(tokens(ascii_fold(site(first))), fix_ocr), join_initials)
        return F.transform(fixed, lambda t: lookup(L.NAME_FORMS, t))

    def core(toks: Column) -> Column:
        kept = F.filter(toks, lambda t: ~among(L.LEGAL, t) & ~among(L.LEGAL_SKELETONS, skeleton(t)))
        return let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(toks))

    def views(toks: Column, core: Column, other: Column) -> Column:
        alt = F.when(other == "", F.lit("")).otherwise(F.array_join(F.filter(tokens(ascii_fold(site(other))), lambda t: ~among(L.LEGAL, t)), " "))
        return F.struct(F.array_join(toks, " ").alias("clean"), F.array_join(core, " ").alias("core"), F.array_join(F.transform(core, skeleton), " ").alias("skel"), F.array_join(core, "").alias("nospace"), alt.alias("alt"))

    return let(F.split(text, r"\s\|\s", 2), halved)


def address_views(raw: Column) -> Column:
    """struct a(clean, postal, nums, landmarks) of an address: its words in short forms, postal codes, digit runs, and
    the words after a landmark's word."""
    plain = F.coalesce(raw, F.lit(""))
    distinct = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), " ")
    postal = F.transform(F.regexp_extract_all(plain, F.lit(L.POSTAL), F.lit(1)), lambda p: F.regexp_replace(p, r"\s", ""))

    def views(toks: Column) -> Column:
        marks = F.flatten(F.transform(toks, lambda t, i: F.when(among(L.LANDMARKS, t), F.slice(toks, i + 2, F.lit(3))).otherwise(F.array().cast("array<string>"))))
        return F.struct(F.array_join(toks, " ").alias("clean"), distinct(postal).alias("postal"), distinct(F.regexp_extract_all(plain, F.lit("[0-9]+"), F.lit(0))).alias("nums"), distinct(F.filter(marks, lambda t: ~among(L.LANDMARKS, t))).alias("landmarks"))

    short = F.transform(tokens(ascii_fold(raw)), lambda t: lookup(L.ADDRESS_FORMS, t))
    return let(F.filter(short, lambda t: t != ""), views).alias("a")


def acronym(core: Column) -> Column:
    toks = tokens(core)
    return F.when(F.size(toks) >= 2, F.array_join(F.transform(toks, lambda t: F.substring(t, 1, 1)), "")).otherwise("")


def stem(tok: Column) -> Column:
    return F.when(tok.endswith("ies") & (F.length(tok) > 4), F.regexp_replace(tok, "ies$", "y")).when(tok.endswith("s") & ~tok.endswith("ss") & (F.length(tok) > 3), F.regexp_replace(tok, "s$", "")).otherwise(tok)


def ocr_fold(text: Column) -> Column:
    """Letters that scanners confuse become one."""
    for a, b in (("rn", "m"), ("cl", "d"), ("vv", "w")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.translate(text, "gl", "bi")


def has_indic(text: Column) -> Column:
    return text.rlike("[\\u0900-\\u0DFF]")


def legal_family(toks: Column) -> Column:
    """The family of the last designator, or ''."""
    hits = F.filter(toks, lambda t: among(list(L.LEGAL_FAMILY), t))
    return F.coalesce(lookup(L.LEGAL_FAMILY, F.try_element_at(hits, F.lit(-1))), F.lit(""))


def legal_set(toks: Column) -> Column:
    """The designators in one spelling, sorted."""
    hits = F.filter(toks, lambda t: among([*L.LEGAL_FAMILY, "public"], t))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda t: lookup(L.LEGAL_ONE, t)))), " ")


def us_state(part: Column) -> Column:
    """The code of a comma part that is a state's name or code, else null."""
    letters = F.regexp_replace(F.lower(part), "[^a-z]", "")
    table = F.create_map(*[F.lit(x) for kv in L.US_STATES.items() for x in kv])
    code = F.when(F.trim(F.lower(part)).isin(*L.US_STATES.values()), F.trim(F.lower(part)))
    return F.when(~part.rlike("[0-9]"), F.coalesce(F.element_at(table, letters), code))


def host_name(url: Column) -> Column:
    """The registered name in a web address: www.x.com gives x."""
    return F.regexp_extract(url, r"(?i)([a-z0-9-]+)\.(?:com|net|org|in|co|fr|us|biz|info|io)(?:[/?#:]|$)", 1)


def digit_deletions(number: Column) -> Column:
    """A number of three digits or more, and that number without any one digit; as numbers."""
    n = F.length(number)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(number, F.lit(1), i - 1), F.substring(number, i + 1, n)).cast("bigint"))
    own = F.array(number.cast("bigint"))
    return F.when(n >= 3, F.array_distinct(F.concat(own, cut))).otherwise(own)


def one_digit_less(number: Column, least: int = 3) -> Column:
    """A number, and from `least` digits on that number without any one digit; as text without leading zeros, so
    however long."""
    n = F.length(number)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.regexp_replace(F.concat(F.substring(number, F.lit(1), i - 1), F.substring(number, i + 1, n)), "^0+(?=.)", ""))
    return F.when(n >= least, F.array_distinct(F.concat(F.array(number), cut))).otherwise(F.array(number))


def skeleton_2(tok: Column, voiced: bool = False) -> Column:
    """Consonants by sound for words of any origin: -tion and soft c and g first, a leading vowel as _, a plural's s
    dropped; voiced: d, b and g as t, p and k."""
    w = F.regexp_replace(F.regexp_replace(tok, "[^a-z]", ""), "[ts]ion", "sn")
    w = F.regexp_replace(F.regexp_replace(F.replace(w, F.lit("tur"), F.lit("cur")), "c(?=[eiy])", "s"), "g(?=[eiy])", "j")
    for a, b in L.SOUNDS_2:
        w = F.replace(w, F.lit(a), F.lit(b))
    if voiced:
        w = F.translate(w, "dbg", "tpk")
    w = squeeze(F.regexp_replace(F.regexp_replace(w, "^[aeiou]", "_"), "(?<=.)[aeiou]", ""))
    return F.regexp_replace(w, "(?<=..)s$", "")
