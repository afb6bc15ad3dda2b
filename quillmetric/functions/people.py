"""Column functions over names, companies, headlines, degrees, mutual connections and status text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmetric.functions.text import bind, literal_array, strip
from quillmetric.functions.urls import profile_handle

# Role abbreviations and their long forms.
ROLE_WORDS = {
    "swe": "software engineer",
    "sde": "software engineer",
    "mle": "machine learning engineer",
    "sre": "site reliability engineer",
    "pe": "principal engineer",
    "de": "data engineer",
    "ds": "data scientist",
    "qa": "quality assurance engineer",
    "fe": "frontend engineer",
    "be": "backend engineer",
    "fs": "full stack engineer",
    "devops": "development operations engineer",
    "secops": "security operations engineer",
    "em": "engineering manager",
    "mngr": "manager",
    "mgr": "manager",
    "dir": "director",
    "vp": "vice president",
    "svp": "senior vice president",
    "evp": "executive vice president",
    "cto": "chief technology officer",
    "cmo": "chief marketing officer",
    "ceo": "chief executive officer",
    "coo": "chief operating officer",
    "cpo": "chief product officer",
    "cro": "chief revenue officer",
    "pm": "product manager",
    "tpm": "technical program manager",
    "pdm": "product manager",
    "pgm": "program manager",
    "ae": "account executive",
    "se": "solutions engineer",
    "tam": "technical account manager",
    "am": "account manager",
    "sdr": "sales development representative",
    "bdr": "business development representative",
    "csm": "customer success manager",
    "sr": "senior",
    "jr": "junior",
    "eng": "engineer",
    "engr": "engineer",
    "dev": "developer",
    "tech": "technical",
}

# Trailing words that are not part of a company's name.
COMPANY_TAIL_WORDS = (
    "inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "company",
    "technologies", "technology", "tech", "platforms", "platform", "software", "systems",
    "solutions", "services", "holdings", "holding", "group", "enterprises", "enterprise",
    "labs", "lab", "ai", "io", "com", "gmbh", "plc", "sa", "ag", "bv", "nv",
)

# Tail of a company name as shown to people.
DISPLAY_TAIL = (
    r"(?i)(?:[,\s]+(?:inc|llc|ltd|corp|corporation|co|gmbh|plc|incorporated|limited)\.?"
    r"|\.(?:com|io|ai|co|app|dev|net|org))\s*$"
)

# Title words of people who can hire.
LEADERSHIP = (
    "head of", "head", "vp", "vice president", "director", "engineering manager", "manager", "lead",
    "team lead", "chief", "founder", "co-founder", "partner", "principal", "hiring",
)

# Outreach status words, tested group by group in this order.
OUTREACH_STATUS_WORDS = (
    ("archived", ("closed", "declined", "archived", "re-pitching")),
    ("replied", ("screen", "replied", "booked", "active contact", "confirmed", "scheduled", "touch 2")),
    ("messaged", ("sent", "messaged", "applied", "email sent")),
    ("connected", ("connection request sent", "connected")),
    ("drafted", ("drafted", "deferred")),
)

# Patterns of the five contact states.
TOUCH_STATES = (
    ("closed", "closed|declined|archived|do not contact|withdrawn"),
    ("replied", "replied|booked|scheduled|confirmed|active contact|screen"),
    ("sent", "sent|messaged|applied|connection request sent"),
    ("drafted", "drafted"),
)

DEGREES = ("1st", "2nd", "3rd+", "Unknown")


def clean_company(name: Column) -> Column:
    """Matching key of a company: no web suffix, no punctuation, no legal or descriptive tail."""
    flat = F.regexp_replace(F.coalesce(name, F.lit("")), r"(?i)\.(com|ai|io|net|org|co)\b", "")
    words = strip(F.regexp_replace(F.regexp_replace(F.lower(flat), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))
    return F.regexp_replace(words, "(?<=\\S)(?: (?:" + "|".join(COMPANY_TAIL_WORDS) + "))+$", "")


def display_company(name: Column) -> Column:
    """Shown form of a company: up to four tails dropped, then a leading 'the'; null when nothing is left."""
    out = F.regexp_replace(F.regexp_replace(name, r"(?U)\s+", " "), r"^[ \t\-|,.;:]+|[ \t\-|,.;:]+$", "")
    for _ in range(4):
        shorter = F.regexp_replace(F.regexp_replace(out, DISPLAY_TAIL, ""), r"^[ \t\-|,.;:]+|[ \t\-|,.;:]+$", "")
        out = F.when(shorter == "", out).otherwise(shorter)
    out = F.when(F.length(out) > 4, F.regexp_replace(out, r"(?i)^the\s+", "")).otherwise(out)
    return F.nullif(out, F.lit(""))


def org_key(name: Column) -> Column:
    """Lower-case words of a name without brackets, punctuation and the words inc, llc and ai."""
    flat = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\(.*?\)", " ")
    words = F.regexp_replace(flat, "[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(words, "(?<![a-z0-9])(?:inc|llc|ai)(?![a-z0-9]) ?", ""))


def org_aliases(name: Column) -> Column:
    """Distinct keys of the parts around '/' and ' via ', and of the whole name."""
    separator = r"(?i)\s*/\s*|\s+via\s+"
    parts = F.split(name, separator)
    keys = F.when(name.rlike(separator), F.array_append(F.transform(parts, org_key), org_key(name))).otherwise(F.array(org_key(name)))
    return F.array_distinct(F.array_remove(keys, ""))


def expand_roles(text: Column) -> Column:
    """Replace role abbreviations that stand as whole words."""
    # pieces alternate between words and everything else, so joining them gives the text back
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\w+|\W+"), 0)
    pairs: list[Column] = []
    for short, full in ROLE_WORDS.items():
        pairs += [F.lit(short), F.lit(full)]
    lookup = F.create_map(*pairs)
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(lookup, F.lower(p)), p)), "")


def segments(text: Column) -> Column:
    """Parts of a headline between separators and ' at ', plus the whole text."""
    raw = F.split(text, r"(?U)[-@|•·–—/:\n,()\[\]{}]|\bat\b")
    found = F.struct(F.filter(F.transform(raw, strip), lambda s: s != "").alias("parts"), strip(text).alias("whole"))
    return bind(found, lambda f: F.when(F.array_contains(f["parts"], f["whole"]), f["parts"]).otherwise(
        F.array_append(f["parts"], f["whole"])))


def employer(headline: Column) -> Column:
    """Employer after 'at' or '@' unless a word before it marks a past job."""
    pattern = r"(?is)^(.*?)(?:\bat\b|@)\s*([^|•·\n,]+)"
    before = F.regexp_extract(headline, pattern, 1)
    name = F.regexp_replace(strip(F.regexp_extract(headline, pattern, 2)), r"[.,\-]+$", "")
    return F.when(~before.rlike(r"(?i)\b(?:ex|former|past|prev)\b") & (F.length(name) > 1), name)


def employer_loose(headline: Column) -> Column:
    """Employer after a free-standing 'at' or '@', else the part after the last ' | '."""
    found = strip(F.regexp_extract(headline, r"(?i)(?:^|\s)(?:at|@)\s+([^,|·•\n()]+)", 1))
    found = strip(F.regexp_replace(found, "[.,;]+$", ""))
    last = strip(F.element_at(F.split(headline, r" \| "), -1))
    return F.when(found != "", found).when(F.contains(headline, F.lit(" | ")), last)


def degree_badge(text: Column) -> Column:
    """1st / 2nd / 3rd+ from a badge text."""
    found = F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)\b(1st|2nd|3rd)\b", 1))
    return F.when(found == "3rd", "3rd+").when(found != "", found).otherwise("Unknown")


def degree_code(text: Column) -> Column:
    """Degree from a network-distance code, else from a badge text."""
    code = F.upper(strip(F.coalesce(text, F.lit(""))))
    return (F.when(code.isin("1ST", "1", "DISTANCE_1", "FIRST_DEGREE"), "1st")
            .when(code.isin("2ND", "2", "DISTANCE_2", "SECOND_DEGREE"), "2nd")
            .when(code.isin("3RD", "3RD+", "3", "DISTANCE_3", "THIRD_DEGREE", "OUT_OF_NETWORK"), "3rd+")
            .otherwise(degree_badge(code)))


def degree_mention(text: Column) -> Column:
    """Degree from any mention inside a note, words included."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (F.when(low.rlike("1st|first"), "1st").when(low.rlike("2nd|second"), "2nd")
            .when(low.rlike("3rd|third"), "3rd+").otherwise("Unknown"))


def degree_word(text: Column) -> Column:
    """First whole-word degree in a relationship cell: 1st, 2nd, 3rd or unknown."""
    found = F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)\b(1st|2nd|3rd|first|second|third)\b", 1))
    return (F.when(found.isin("1st", "first"), "1st").when(found.isin("2nd", "second"), "2nd")
            .when(found.isin("3rd", "third"), "3rd").otherwise("unknown"))


def _names(text: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(text, separator), strip), lambda n: n != "")


def mutuals_proof(text: Column) -> Column:
    """struct(count, sample) of a social-proof line such as 'Ann Lee and 3 other mutual connections'."""
    body = strip(F.coalesce(text, F.lit("")))
    lead = strip(F.regexp_extract(body, r"^([A-Z][a-zA-Z\s.'\-]+?)\s+(?:and|,|is)", 1))
    named = (lead != "") & ~lead.rlike(r"(?i)\d|mutual")
    sample = F.when(named, F.array(lead)).otherwise(literal_array([]))
    others = F.regexp_extract(body, r"(?i)(\d+)\s+other\s+mutual", 1).try_cast("int")
    total = F.regexp_extract(body, r"(?i)(\d+)\s+mutual", 1).try_cast("int")
    single = F.when(F.contains(F.lower(body), F.lit("is a mutual connection")), 1).otherwise(0)
    count = F.coalesce(others + F.size(sample), total, F.greatest(F.size(sample), single))
    return F.struct(count.alias("count"), sample.alias("sample"))


def mutuals_insight(text: Column) -> Column:
    """struct(count, sample) of an insight such as '12 mutual connections: Ann Lee, Bo Chu and 2 others'."""
    body = F.coalesce(text, F.lit(""))
    stated = F.regexp_extract(body, r"(?i)(\d+)\s+mutual\s+connection", 1).try_cast("int")
    count = F.coalesce(stated, F.when(body.rlike(r"(?i)\bmutual\s+connection"), 1), F.lit(0))
    after = strip(F.regexp_extract(body, "(?s)^[^:]*:(.*)$", 1))
    named = F.regexp_replace(after, r"(?i)\s+and\s+\d+\s+others?", "")
    sample = F.filter(_names(named, r",\s*|\s+and\s+"), lambda n: ~n.rlike(r"(?i)^\d+\s+other"))
    return F.struct(count.alias("count"), sample.alias("sample"))


def mutuals_note(text: Column) -> Column:
    """struct(count, sample) of a note: a bracketed list wins over a list after a colon."""
    body = F.coalesce(text, F.lit(""))
    stated = F.coalesce(F.regexp_extract(body, r"(?i)(\d+)\s+mutual", 1).try_cast("int"), F.lit(0))
    bracket = F.regexp_extract(body, r"(?i)mutual(?:s|\s+connections)?\s*\(([^)]+)\)", 1)
    colon = F.regexp_extract(body, r"(?i)mutuals?:\s*([^\n;]+)", 1)
    in_bracket = F.filter(_names(bracket, ","), lambda n: ~F.lower(n).startswith("etc"))
    in_colon = F.filter(_names(colon, ","), lambda n: ~n.startswith("+"))
    sample = F.when(bracket != "", in_bracket).otherwise(in_colon)
    count = F.when((bracket == "") & (stated == 0), F.size(in_colon)).otherwise(stated)
    return F.struct(count.alias("count"), sample.alias("sample"))


def mutual_names(*texts: Column) -> Column:
    """Distinct clean names of mutual connections listed in several cells."""
    found = []
    for text in texts:
        body = F.coalesce(text, F.lit(""))
        found.append(F.regexp_extract_all(body, F.lit(r"(?i)mutuals?\s*:\s*([^;]*)"), 1))
        found.append(F.regexp_extract_all(body, F.lit(r"(?i)\d+\s+mutuals?\s*\(([^)]*)\)"), 1))
    parts = F.flatten(F.transform(F.concat(*found), lambda t: F.split(t, ",")))

    def clean(name: Column) -> Column:
        out = F.regexp_replace(F.regexp_replace(name, r"\(.*?\)", ""), r"\+\d+.*$", "")
        out = F.regexp_replace(out, r"^[ .]+|[ .]+$", "")
        return strip(F.regexp_replace(out, r"^(and|etc)\s+", ""))

    return F.array_distinct(F.filter(F.transform(parts, clean),
                                     lambda n: (n != "") & ~F.lower(n).isin("etc", "others")))


def outreach_status(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit("discovered")
    for state, words in reversed(OUTREACH_STATUS_WORDS):
        test = F.contains(low, F.lit(words[0]))
        for word in words[1:]:
            test = test | F.contains(low, F.lit(word))
        out = F.when(test, F.lit(state)).otherwise(out)
    return out


def first_word_status(text: Column) -> Column:
    return F.lower(F.regexp_extract(strip(F.coalesce(text, F.lit(""))), "^([A-Za-z]+)", 1))


def touch_state(text: Column) -> Column:
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\b(not sent|unsent)\b", "")
    out = F.lit("none")
    for state, pattern in reversed(TOUCH_STATES):
        out = F.when(low.rlike(pattern), F.lit(state)).otherwise(out)
    return out


def unified_urn(urn: Column, profile_url: Column) -> Column:
    """Person, member and profile ids follow the public handle wherever one is known."""
    handle = profile_handle(profile_url)
    generic = (F.coalesce(urn, F.lit("")) == "") | urn.rlike("^urn:li:(person|member|fsd_profile):")
    return F.when(handle.isNotNull() & generic, F.concat(F.lit("urn:li:member:"), handle)).otherwise(urn)


def allowed_or(value: Column, allowed, default: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))
