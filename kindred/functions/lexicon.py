"""Word lists and tables. They are fixed values: results depend on these very words."""

from __future__ import annotations

from string import ascii_lowercase
from unicodedata import combining, normalize

# Designators and filler words that a name's core leaves out.
LEGAL = ["pvt", "private", "ltd", "limited", "llc", "llp", "lp", "inc", "incorporated", "corp", "corporation", "co", "company", "plc", "ltda", "gmbh", "opc", "pllc", "pc", "pa", "sarl", "sas", "sasu", "sa", "eurl", "snc", "sci", "scop", "cie", "the", "and", "of", "le", "la", "les", "de", "du", "des", "et", "l", "d", "ms", "m/s", "mrs", "sri", "shri"]

# Short and variant forms in names.
NAME_FORMS = {"intl": "international", "mfg": "manufacturing", "svcs": "services", "svc": "services", "bros": "brothers", "assoc": "associates", "assocs": "associates", "ent": "enterprises", "enterprise": "enterprises", "tech": "technologies", "technology": "technologies", "sys": "systems", "mgmt": "management", "natl": "national", "ctr": "center", "centre": "center", "grp": "group", "inds": "industries", "industry": "industries", "solution": "solutions", "service": "services", "product": "products", "st": "saint", "ste": "sainte", "mt": "mount", "ft": "fort", "dr": "doctor", "hosp": "hospital", "univ": "university"}

# Forms in addresses; an empty one drops the word.
ADDRESS_FORMS = {"road": "rd", "street": "st", "str": "st", "saint": "st", "avenue": "ave", "av": "ave", "boulevard": "blvd", "bd": "blvd", "bld": "blvd", "lane": "ln", "drive": "dr", "court": "ct", "place": "pl", "square": "sq", "highway": "hwy", "parkway": "pkwy", "circle": "cir", "terrace": "ter", "trail": "trl", "suite": "ste", "floor": "fl", "flr": "fl", "apartment": "apt", "building": "bldg", "north": "n", "south": "s", "east": "e", "west": "w", "near": "nr", "opposite": "opp", "market": "mkt", "nagar": "ngr", "sector": "sec", "extension": "extn", "ext": "extn", "number": "no", "num": "no", "district": "dist", "chemin": "ch", "che": "ch", "impasse": "imp", "allee": "all", "faubourg": "fg", "fbg": "fg", "route": "rte", "rue": "r", "quai": "qu", "cite": "cte", "residence": "res", "resid": "res", "batiment": "bat", "bt": "bat", "lieu": "", "dit": "", "cedex": "", "cross": "crs", "main": "mn", "unit": "ste", "house": "hse", "city": "", "town": "", "cp": "", "null": "", "po": "", "box": "", "first": "1st", "second": "2nd", "third": "3rd", "fourth": "4th"}

# Words before a landmark.
LANDMARKS = ["nr", "opp", "behind", "beside", "next", "adjacent", "pres", "face", "landmark"]

# Sound-alike letters, folded in this order.
SOUNDS = [("bh", "v"), ("w", "v"), ("ph", "f"), ("sh", "s"), ("th", "t"), ("dh", "d"), ("kh", "k"), ("gh", "g"), ("ch", "c"), ("ck", "k"), ("q", "k"), ("z", "j"), ("x", "ks")]

# Designators that are known by their sound, and one sound more.
LEGAL_SOUNDS = ["private", "limited", "incorporated", "corporation", "company", "pvt", "ltd", "llp"]
LEGAL_SOUND_MORE = "elp"


def sound(word: str) -> str:
    """The skeleton of a word, as text.skeleton gives it for a column."""
    for a, b in SOUNDS:
        word = word.replace(a, b)
    kept = word[:1] + "".join(c for c in word[1:] if c not in "aeiouy")
    return "".join(c for i, c in enumerate(kept) if not i or c != kept[i - 1])


LEGAL_SKELETONS = sorted({sound(w) for w in LEGAL_SOUNDS} | {LEGAL_SOUND_MORE})

# Families of designators.
LEGAL_FAMILY = {"corp": "corp", "corporation": "corp", "inc": "inc", "incorporated": "inc", "ltd": "ltd", "limited": "ltd", "pc": "pc", "pllc": "pc", "plc": "pc", "pa": "pc", "psc": "pc", "llc": "llc", "llp": "llp", "lp": "llp", "lllp": "llp", "co": "co", "company": "co", "cos": "co", "pvt": "other", "private": "other", "gmbh": "other", "ag": "other", "sa": "other", "sarl": "other", "sas": "other", "sasu": "other", "eurl": "other", "sci": "other", "snc": "other"}

# One spelling for each designator in an order-free set.
LEGAL_ONE = {"pvt": "private", "private": "private", "ltd": "limited", "limited": "limited", "corp": "corporation", "corporation": "corporation", "inc": "incorporated", "incorporated": "incorporated", "co": "company", "company": "company", "cos": "company", "public": "public"}

# States by their letters.
US_STATES = {"alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de", "districtofcolumbia": "dc", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "newhampshire": "nh", "newjersey": "nj", "newmexico": "nm", "newyork": "ny", "northcarolina": "nc", "northdakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "rhodeisland": "ri", "southcarolina": "sc", "southdakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "westvirginia": "wv", "wisconsin": "wi", "wyoming": "wy"}

# Lower-case Latin letters with marks, and the letters that they are without: by Unicode's decomposition.
_MARKED = [(c, d[0]) for c in map(chr, [*range(0xE0, 0x250), *range(0x1E00, 0x1F00)]) if c == c.lower() and (d := normalize("NFKD", c))[0] in ascii_lowercase and all(map(combining, d[1:])) and len(d) > 1]
ACCENTED, PLAIN = "".join(c for c, _ in _MARKED), "".join(d for _, d in _MARKED)

# Fixed values of the second normaliser: designators, honorifics, credentials and fillers that names drop.
LEGAL_FORMS = ["llc", "inc", "incorporated", "corp", "corporation", "co", "company", "cos", "ltd", "limited", "pvt", "private", "llp", "lp", "lllp", "pc", "pllc", "plc", "pa", "psc", "gmbh", "ag", "sa", "sarl", "sas", "sasu", "eurl", "sci", "snc"]
HONORIFICS = ["mr", "mrs", "ms", "smt", "shri", "sri", "dr", "the", "a", "an", "of", "and"]
CREDENTIALS = ["md", "do", "dds", "dmd", "phd", "cpa", "esq", "rn", "dc", "od", "dpm", "dvm", "lcsw"]
NAME_FILLERS = ["center", "centre", "services", "service", "india", "partners", "partner"]

# Designators in Indic scripts: those for limited, private and the partnership.
INDIC_LIMITED = ["लिमिटेड", "लि", "లిమిటెడ్", "ಲಿಮಿಟೆಡ್", "லிமிடெட்", "লিমিটেড", "લિમિટેડ", "ലിമിറ്റഡ്", "ଲିମିଟେଡ୍"]
INDIC_PRIVATE = ["प्राइवेट", "प्रा", "ప్రైవేట్", "ಪ್ರೈವೇಟ್", "பிரைவேட்", "প্রাইভেট", "પ્રાઇવેટ", "പ്രൈവറ്റ്", "ପ୍ରାଇଭେଟ୍"]
INDIC_PARTNERSHIP = ["एलएलपी"]

# Words of an address that say what the number beside them is, or nothing.
UNIT_WORDS = ["unit", "apt", "apartment", "appt", "appartement", "suite", "flat", "room", "rm", "bldg", "building", "apto"]
FLOOR_WORDS = ["floor", "flr", "flor", "etage", "fl"]
BOX_WORDS = ["po", "box", "pmb", "bp", "cs", "cedex"]
NUMBER_WORDS = ["no", "h", "hno", "house", "door", "plot", "shop", "sr", "survey", "s", "hn"]
ADDRESS_STOPS = ["de", "la", "le", "les", "du", "des", "d", "l", "of", "the", "and", "city", "town", "village", "township", "cdp", "county", "region", "corporation", "null", "na", "nan", "none"]
STREET_FORMS = {"street": "st", "str": "st", "saint": "st", "road": "rd", "drive": "dr", "drv": "dr", "avenue": "av", "ave": "av", "lane": "ln", "court": "ct", "circle": "cir", "place": "pl", "boulevard": "bd", "blvd": "bd", "trail": "trl", "terrace": "ter", "highway": "hwy", "parkway": "pkwy", "square": "sq", "rue": "r", "impasse": "imp", "allee": "all", "chemin": "ch", "chem": "ch", "route": "rte", "sainte": "ste", "north": "n", "south": "s", "east": "e", "west": "w", "mount": "mt", "fort": "ft", "point": "pt", "heights": "hts", "junction": "jct", "quai": "q", "cours": "crs"}

# Number words.
ORDINALS = ["first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth"]
CARDINALS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
TENTHS = ["twentieth", "thirtieth", "fortieth", "fiftieth", "sixtieth", "seventieth", "eightieth", "ninetieth"]

# Indian states by code: names, and names in their own script.
INDIA_STATES = {
    "mh": ["maharashtra", "महाराष्ट्र"], "up": ["uttar pradesh", "उत्तर प्रदेश"], "wb": ["west bengal", "পশ্চিমবঙ্গ"], "gj": ["gujarat", "ગુજરાત"], "tn": ["tamil nadu", "தமிழ்நாடு"], "ka": ["karnataka", "ಕರ್ನಾಟಕ"],
    "aptg": ["telangana", "andhra pradesh", "తెలంగాణ", "ఆంధ్రప్రదేశ్"], "hr": ["haryana", "हरियाणा"], "rj": ["rajasthan", "राजस्थान"], "br": ["bihar", "बिहार"], "kl": ["kerala", "keralam", "കേരളം"], "mp": ["madhya pradesh", "मध्य प्रदेश"],
    "pb": ["punjab", "ਪੰਜਾਬ"], "od": ["odisha", "orissa", "ଓଡ଼ିଶା"], "dl": ["delhi", "दिल्ली"], "as": ["assam", "অসম"], "jh": ["jharkhand", "झारखंड"], "cg": ["chhattisgarh", "छत्तीसगढ़"], "uk": ["uttarakhand", "उत्तराखंड"],
    "hp": ["himachal pradesh", "हिमाचल प्रदेश"], "ga": ["goa", "गोवा"], "jk": ["jammu and kashmir", "jammu kashmir"], "ch": ["chandigarh"], "py": ["puducherry", "pondicherry"],
}
#: Codes that stand for another one in addresses.
INDIA_CODES = {"tg": "aptg", "ap": "aptg", "ts": "aptg", "or": "od"}

# Syllables that invented names are made of, to begin with.
SYLLABLES = ["pyra", "lyra", "jax", "nexa", "nex", "wex", "zeph", "orbi", "kelo", "belo", "tavo", "drex", "flux", "halo", "brix", "onyx", "riza", "zeta", "yuma", "delta", "vio", "veo", "mira", "faye", "quo", "iri", "cira", "avi", "lum", "syn", "umbra", "kor", "ecto", "nyla", "xylo", "evo", "sol", "arc", "vera", "calo"]

# Indic letters by their place in a script's block (all nine scripts are laid out alike).
INDIC_BLOCKS = {0x0900: "devanagari", 0x0980: "bengali", 0x0A00: "gurmukhi", 0x0A80: "gujarati", 0x0B00: "oriya", 0x0B80: "tamil", 0x0C00: "telugu", 0x0C80: "kannada", 0x0D00: "malayalam"}
INDIC_VOWELS = {0x05: "a", 0x06: "a", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0B: "ri", 0x0E: "e", 0x0F: "e", 0x10: "ai", 0x12: "o", 0x13: "o", 0x14: "au"}
INDIC_CONSONANTS = {
    0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "n", 0x1A: "c", 0x1B: "ch", 0x1C: "j", 0x1D: "jh", 0x1E: "n", 0x1F: "t", 0x20: "th", 0x21: "d", 0x22: "dh", 0x23: "n", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n", 0x29: "n",
    0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x31: "r", 0x32: "l", 0x33: "l", 0x34: "l", 0x35: "v", 0x36: "s", 0x37: "s", 0x38: "s", 0x39: "h",
}
INDIC_SIGNS = {0x3E: "a", 0x3F: "i", 0x40: "i", 0x41: "u", 0x42: "u", 0x43: "ri", 0x46: "e", 0x47: "e", 0x48: "ai", 0x4A: "o", 0x4B: "o", 0x4C: "au"}
INDIC_MARKS = {0x01: "m", 0x02: "n", 0x03: ""}
INDIC_VIRAMA = 0x4D
#: Letters read as others first: short open vowels, and Malayalam consonants without a vowel.
INDIC_READ_AS = {"ऑ": "ओ", "ॉ": "ो", "ऍ": "ए", "ॅ": "े", "ઑ": "ઓ", "ૉ": "ો", "ൽ": "ല്", "ർ": "ര്", "ൻ": "ന്", "ൺ": "ണ്", "ൾ": "ള്", "ൿ": "ക്"}

# The second skeleton's sound-alikes, folded in this order, after "tion" and "sion" and soft c and g.
SOUNDS_2 = [("ph", "f"), ("bh", "b"), ("dh", "d"), ("th", "t"), ("kh", "k"), ("gh", "g"), ("sh", "s"), ("ch", "c"), ("jh", "j"), ("ck", "k"), ("w", "v"), ("q", "k"), ("x", "ks"), ("z", "j"), ("c", "k"), ("y", "i")]

# What a web address, an id, or a word for another name looks like in a name.
ID_TAG = r"(?i)\(\s*id\s*[:#]?\s*\d+\s*\)"
SITE = r"(?i)(?:https?://)?(?:www\.)?([a-z0-9-]+)\.(?:com|net|org|in|co\.in|co|fr|us|biz|info|io)\b"
ALIAS = r"(?i)\b(?:fka|f/k/a|aka|a/k/a|dba|d/b/a|t/a|formerly|trading as)\b"
POSTAL = r"\b(\d{3}\s?\d{3}|\d{5})\b"

# What the second normaliser cuts out of a name: ids, web suffixes, "m/s", words for another name;
# dotted initials, which meet; and what marks a name as a web address.
NAME_ID = r"\(?\bid\s*[:#]?\s*\d+\s*\)?"
NAME_SITE = r"\bwww\.|\.(com|net|org|in|co|biz|info|us|fr|eu)\b"
NAME_MS = r"\bm\s*/\s*s\b"
NAME_ALIAS = r"\b(d\s*/?\s*b\s*/?\s*a|a\s*/?\s*k\s*/?\s*a|f\s*/?\s*k\s*/?\s*a|nee|t\s*/\s*a|formerly(\s+known\s+as)?|doing\s+business\s+as|also\s+known\s+as|known\s+as|trading\s+as)\b"
DOTTED = r"\b(?:[a-z]\s*\.\s*){2,}(?:[a-z]\b)?"
MARKS = r"[^\w\sऀ-෿]|_"
SITE_FLAG = r"(?i)\.(com|net|org|in|co|biz|info|us|fr|eu)\b|www\.|^\s*[@#]"
#: Digits in words as scanners misread them.
MISREAD = ("01568", "olsbg")
ORDINAL_END = r"^(\d+)(st|nd|rd|th|er|e|eme|re)$"
EMPTY_PARTS = ["null", "na", "none", "nan"]
#: Transliterated designators besides those known by their skeleton.
LEGAL_SHORT, LEGAL_LETTERS, LEGAL_LONGEST = ["pra", "li", "pi", "el"], "aeilpbh", 12
LEGAL_SOUNDS_2 = ["limited", "private", "pvt", "ltd", "llp"]

# What is checked in names and addresses field by field.
FIELD_CHECKS = {
    "name_empty": ("name", r"^\s*$"), "addr_empty": ("addr", r"^\s*$"), "name_devanagari": ("name", r"[\x{0900}-\x{097F}]"), "name_other_indic": ("name", r"[\x{0980}-\x{0DFF}]"), "name_accents": ("name", r"[À-ÿ]"), "addr_indic": ("addr", r"[\x{0900}-\x{0DFF}]"),
    "name_domain": ("name", r"(?i)\.(com|in|net|org|co|biz)\b|www\."), "name_dba": ("name", r"(?i)\b(dba|d/b/a|aka|t/a)\b"), "name_junk": ("name", r"#|\||--|\*|@|\$"), "name_legal_first": ("name", r"(?i)^\s*(llc|inc|ltd|pvt|private|limited|corp|co)\b"),
    "name_legal_any": ("name", r"(?i)\b(llc|inc|ltd|pvt|private|limited|corp|corporation|company|co|llp|plc)\b"), "addr_zip5": ("addr", r"\b\d{5}(-\d{4})?\b"), "addr_pin6": ("addr", r"\b\d{6}\b|\b\d{3}\s\d{3}\b"), "addr_has_digit": ("addr", r"\d"),
    "addr_landmark": ("addr", r"(?i)\b(near|nr|opp|opposite|behind|beside|next to|adj)\b"), "addr_po_box": ("addr", r"(?i)\bp\.?\s?o\.?\s?box\b"),
}
