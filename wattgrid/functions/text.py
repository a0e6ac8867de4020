"""Column expressions over names, texts and urls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattgrid.functions.lists import COMPARISON_PAGES

# Patterns and word lists that results depend on.
ERROR_RULES = [
    ("403_forbidden", ["403", "forbidden"]),
    ("404_not_found", ["404"]),
    ("5xx_server_error", ["500", "502", "503"]),
    ("timeout", ["timeout", "timed out"]),
    ("ssl_certificate", ["ssl", "certificate"]),
    ("dns_failed", ["name or service not known", "nodename", "getaddrinfo"]),
    ("connection_error", ["connect", "refused"]),
    ("empty_content", ["empty content"]),
    ("auth_required", ["401", "unauthorized"]),
    ("redirect_error", ["redirect"]),
]
DISCRIMINATORS = (
    "single multi multiphase polyphase three threephase 1ph 3ph primary secondary transmission subtransmission small medium large summer winter seasonal "
    "tou flat tiered demand flex flexible block declining optional experimental pilot trial interruptible curtailable controlled controllable load management "
    "lighting heating heater irrigation agricultural farm rural urban inside outside second water additional auxiliary supplemental timeofuse timeofday tod "
    "ev solar wind renewable metering net plugin vehicle charging pev evse lifeline subsidized low income senior dual fuel limited without no non"
).split()
NAME_STOPWORDS = "and or for the of in to a an is by as on at with rate plan schedule service".split()
BLURB_HINTS = "for with applies applicable whose when that including".split()
GAS_NAMES = r"(?i)\b(natural\s+gas|gas\s+distribution|gas\s+delivery|gas\s+supply|gas\s+service|gas\s+transmission|gds[\s\-]\d)\b"
ELECTRIC_NAMES = r"(?i)\belectric|\bgas\s+turbine\b"
RATE_SCHEDULES = (
    r"(?i)rate\s*#|rate\s*no\.?\s*\d|basic\s*customer\s*charge|energy\s*charge.*\$|per\s+k[wW]h.*\$|\$.*per\s+k[wW]h|minimum\s+(monthly\s+)?bill|"
    r"service\s*charge.*\d+\.\d{2}|domestic\s+service|general\s+service\s+\d|residential\s+service|commercial\s+service"
)
RATE_WORDS = r"(?i)kwh|per month|energy charge|customer charge|basic charge|demand charge|cents per|kilowatt|service charge|monthly charge|minimum bill"
RATE_AMOUNTS = r"\$\s*\d+\.?\d*|\d+\.\d+\s*(?:cents|¢)"


# What urls and titles of explainers, regulators' filings and superseded tariffs hold.
EXPLAINERS = [
    r"understanding[-_]", r"how[-_]it[-_]works", r"how[-_]is[-_]", r"how[-_]your[-_]bill", r"comment[-_](?:fonctionne|calculer|lire)", r"learn[-_]about", r"about[-_]your[-_](?:bill|rates?|electricity)",
    r"glossary", r"explanation", r"explained\.", r"demystify", r"comprendre", r"deposit[-_]payment", r"estimate[-_]electric", r"power[-_]demand", r"//energized\.edison\.com/", r"/stories/", r"/newsroom/",
    r"/news[-_]?releases?/", r"/press[-_]?releases?/", r"/media[-_]?releases?/", r"/blog/", r"/blogs/",
]
FILINGS = [
    r"://[a-z]{2,4}\.dps\.ny\.gov", r"/rate[-_]case[-_]", r"/rate[-_]case/", r"[-_]rate[-_]case[-_]filing", r"[-_]rate[-_]case[-_]summary", r"[-_]rate[-_]case[-_]staff", r"[-_]filing[-_]memo",
    r"[-_]staff[-_]broadcast[-_]memo", r"/dockets?/", r"/proceedings?/", r"docket[-_]?no[-_\.]?\d",
]
SUPERSEDED = r"cancell?ed|superse[dt]ed|historic(?:al)?|archive[ds]?|withdrawn|expired|obsolete|rescinded"
IRRELEVANT = (
    r"(?i)natural.gas|gas.rate|gas.tariff|gas.bill|gas.*submission|our.gas.utility|gas.bcuc|gas.marketer|propane|operating.agreement|annual.report|investor|careers|job|press.release|news.event|media.centre|"
    r"contact.us|login|sign.in|my.account|rebate|incentive|conservation|energy.saving|outage|storm|safety|emergency"
)


def _url_or_title(pattern: str, url: Column, title: Column | None) -> Column:
    hit = F.coalesce(F.coalesce(F.try_url_decode(url), url).rlike(pattern), F.lit(False))
    return hit if title is None else hit | F.coalesce(title.rlike(pattern), F.lit(False))


def is_explainer(url: Column, title: Column | None = None) -> Column:
    """News and customer education, not rates."""
    return _url_or_title("(?i)" + "|".join(EXPLAINERS), url, title)


def is_filing(url: Column, title: Column | None = None) -> Column:
    """A regulator's docket or memo, not a tariff."""
    return _url_or_title("(?i)" + "|".join(FILINGS), url, title)


def is_superseded(url: Column, title: Column | None = None) -> Column:
    """A cancelled or replaced tariff, by a word of its own between separators or word boundaries."""
    return _url_or_title(rf"(?i)(?:[/_\-\s]|%20)(?:{SUPERSEDED})(?:[/_\-\s]|%20|$)|\b(?:{SUPERSEDED})\b", url, title)


def normalized_page(text: Column) -> Column:
    """Page text as it is hashed: white space collapsed, lower case, d/m/y and ISO dates dropped."""
    t = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.regexp_replace(F.regexp_replace(t, r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", ""), r"\b\d{4}-\d{2}-\d{2}\b", "")


def compressed(text: Column) -> Column:
    """Runs of blanks to one, runs of empty lines to one, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" ?\n ?", "\n"), r"\n{3,}", "\n\n"))


def error_category(message: Column, url: Column) -> Column:
    """Category of a failed check: a placeholder url first, then the first rule with a word in the message."""
    low = F.lower(message)
    out = F.when(F.lower(url).contains("placeholder"), "placeholder_url").when(message.isNull() | (message == ""), "other")
    for category, words in ERROR_RULES:
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        out = out.when(hit, category)
    return out.otherwise("other")


def host(url: Column) -> Column:
    """Host of a url, lower case, without one leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def is_homepage(url: Column) -> Column:
    return path(url).rlike(r"^/?$")


def host_suffixes(h: Column) -> Column:
    """All suffixes of a host, itself first, as an array."""
    labels = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def is_comparison_page(url: Column, title: Column | None = None) -> Column:
    pattern = "(?i)" + "|".join(COMPARISON_PAGES)
    hit = F.coalesce(F.try_url_decode(url), url).rlike(pattern)
    return hit if title is None else hit | F.coalesce(title.rlike(pattern), F.lit(False))


def is_gas_only(name: Column) -> Column:
    return name.rlike(GAS_NAMES) & ~name.rlike(ELECTRIC_NAMES)


def page_priority(text: Column) -> Column:
    """0 rate schedules, 1 amounts with rate words, 2 rate words alone, 3 the rest."""
    return F.when(text.rlike(RATE_SCHEDULES), 0).when(text.rlike(RATE_AMOUNTS) & text.rlike(RATE_WORDS), 1).when(text.rlike(RATE_WORDS), 2).otherwise(3)


def plain_name(name: Column) -> Column:
    """Letters, digits and single blanks, lower case; punctuation dropped."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9\s]", ""), r"\s+", " "))


def match_name(name: Column) -> Column:
    """As plain_name, but dashes, slashes and underscores become blanks first."""
    return plain_name(F.regexp_replace(F.coalesce(name, F.lit("")), r"[\-–—/_]+", " "))


def without_blurb(name: Column) -> Column:
    """The name without a tail after ' - ' that is over six words long or reads like a description."""
    out = F.trim(name)
    for sep in (" — ", " - "):
        tail = F.split(F.trim(F.lower(F.regexp_extract(name, f"(?s)^.*?{sep}(.*)$", 1))), r"\s+")
        blurb = (F.instr(name, sep) > 0) & ((F.size(tail) > 6) | F.arrays_overlap(tail, F.array(*map(F.lit, BLURB_HINTS))))
        out = F.when(blurb, F.trim(F.regexp_extract(name, f"(?s)^(.*?){sep}", 1))).otherwise(out)
    return out


def rate_codes(name: Column) -> Column:
    """Short tokens with a letter and a digit, as they stand and without inner punctuation, and the compact forms of spelt-out ones."""
    low = F.lower(F.coalesce(name, F.lit("")))
    tokens = F.transform(F.split(low, r"[\s()\[\]{}/:,;]+"), lambda t: F.regexp_replace(t, r"^[-.]+|[-.]+$", ""))
    mixed = lambda t: F.length(t).between(2, 6) & t.rlike("[0-9]") & t.rlike("[a-z]")
    tokens = F.filter(tokens, mixed)
    squeezed = F.transform(tokens, lambda t: F.regexp_replace(t, r"[-.]+", ""))
    classes = F.transform(F.regexp_extract_all(low, F.lit(r"service classification\s*(?:no\.?|number)?\s*([0-9]+[a-z]?)"), 1), lambda t: F.concat(F.lit("sc"), t))
    schedules = F.transform(F.regexp_extract_all(low, F.lit(r"\b(?:rate\s+)?schedule\s+([a-z]+[\-.]?[0-9]+[a-z]?)"), 1), lambda t: F.regexp_replace(t, r"[-.]+", ""))
    short = F.filter(F.concat(squeezed, schedules), lambda t: F.length(t).between(2, 6))
    return F.array_distinct(F.concat(tokens, classes, short))


def codes_share(a: Column, b: Column) -> Column:
    """Whether a code of one list is equal to, or with a digit inside, a code of the other."""
    inside = lambda x, y: F.contains(y, x) & x.rlike("[0-9]") & (F.length(x) >= 2)
    return F.exists(a, lambda x: F.exists(b, lambda y: (x == y) | inside(x, y) | inside(y, x)))


def likely_same(a: Column, b: Column) -> Column:
    """Whether two tariff names describe one product: equal names or heads, shared rate codes, or 60 % of the tokens with equal discriminators and a shared short code."""
    full_a, full_b = match_name(a), match_name(b)
    head_a, head_b = match_name(without_blurb(a)), match_name(without_blurb(b))
    tokens = lambda head, full: F.array_distinct(F.split(F.when(head != "", head).otherwise(full), " "))
    ta, tb = tokens(head_a, full_a), tokens(head_b, full_b)
    marks = F.array(*map(F.lit, DISCRIMINATORS))
    plain = F.array(*map(F.lit, DISCRIMINATORS + NAME_STOPWORDS))
    short = lambda t: F.filter(t, lambda x: F.length(x).between(1, 4) & x.rlike("[a-z]") & ~F.array_contains(plain, x))
    da, db = F.sort_array(F.array_intersect(ta, marks)), F.sort_array(F.array_intersect(tb, marks))
    ca, cb = short(ta), short(tb)
    overlap = F.size(F.array_intersect(ta, tb)) / F.least(F.size(ta), F.size(tb)) >= 0.6
    codes_fit = ((F.size(ca) == 0) & (F.size(cb) == 0)) | F.arrays_overlap(ca, cb)
    same = (full_a == full_b) | ((head_a != "") & (head_a == head_b)) | codes_share(rate_codes(a), rate_codes(b)) | (overlap & (da == db) & F.coalesce(codes_fit, F.lit(False)))
    return (full_a != "") & (full_b != "") & same


def freshness(verified: Column, effective: Column, as_of: Column) -> Column:
    """current to 730 days, aging to 1825, else (and without a date) stale; the date of verification goes before the effective one."""
    age = F.datediff(as_of, F.coalesce(verified, effective))
    return F.when(age <= 730, "current").when(age <= 1825, "aging").otherwise("stale")
