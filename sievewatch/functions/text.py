"""Normalizing projections for company, contact, network and document fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal suffixes stripped repeatedly for the company core name.
CORE_SUFFIXES = (
    "inc", "incorporated", "corp", "corporation", "co", "company", "llc", r"l\.l\.c", "ltd",
    "limited", "lp", "llp", "plc", "pllc", "pc",
)
# One trailing legal form removed for the sanctions company key, longest first.
SANCTIONS_SUFFIXES = (
    "private limited", "public limited company", "incorporated", "corporation",
    "limited liability company", "gesellschaft mit beschr[aä]nkter haftung",
    "sociedad an[oó]nima", "limited partnership", r"ltd\.?", r"llc\.?", r"inc\.?", r"corp\.?",
    r"plc\.?", r"gmbh\.?", r"s\.?a\.?", r"co\.?", r"lp\.?", r"llp\.?",
)
# Words ignored when comparing company names as token sets.
ENTITY_STOP_WORDS = (
    "inc", "ltd", "llc", "corp", "co", "the", "and", "of", "a", "an", "company", "group",
    "holdings", "gmbh", "ag", "plc", "bv", "sas", "sa", "sl",
)
# Free and disposable mail hosts.
FREE_EMAIL_DOMAINS = (
    "gmail.com", "yahoo.com", "yahoo.co.uk", "hotmail.com", "hotmail.co.uk", "outlook.com",
    "live.com", "icloud.com", "me.com", "mac.com", "aol.com", "protonmail.com", "proton.me",
    "tutanota.com", "mailinator.com", "guerrillamail.com", "throwam.com", "temp-mail.org",
    "yopmail.com", "sharklasers.com", "guerrillamailblock.com", "grr.la", "guerrillamail.info",
    "guerrillamail.biz", "guerrillamail.de", "guerrillamail.net", "guerrillamail.org", "spam4.me",
    "trashmail.com", "trashmail.me", "trashmail.net", "dispostable.com",
)
TRUTHY = ("true", "1", "yes")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def squeeze(c: Column) -> Column:
    """Trim and collapse white space."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def core_name(c: Column) -> Column:
    """Company name without trailing legal suffixes, lower case, punctuation as spaces."""
    suffix = "|".join(CORE_SUFFIXES)
    bare = F.regexp_replace(
        F.trim(c), rf"(?iU)^(.+?)(?:\s*,?\s*\b(?:{suffix})\.?\s*)+$", "$1"
    )
    return squeeze(F.regexp_replace(F.lower(F.coalesce(bare, F.lit(""))), r"(?U)[^\w\s]", " "))


def names_match(a: Column, b: Column) -> Column:
    """Equal, non-empty core names."""
    return F.coalesce((core_name(a) != "") & (core_name(a) == core_name(b)), F.lit(False))


def sanctions_key(c: Column) -> Column:
    """Company key of the sanctions lists: one legal suffix off, lower case, single spaces."""
    suffix = "|".join(SANCTIONS_SUFFIXES)
    bare = F.trim(F.regexp_replace(c, rf"(?iuU)\b(?:{suffix})\s*$", ""))
    return squeeze(F.lower(F.trim(F.regexp_replace(bare, r",+$", ""))))


def entity_tokens(c: Column) -> Column:
    """Distinct company-name words minus stop words, unless nothing would be left."""
    words = F.array_distinct(
        F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w]+", " "), " "),
                 lambda t: t != "")
    )
    kept = F.array_except(words, F.array(*[F.lit(w) for w in ENTITY_STOP_WORDS]))
    return F.when(F.size(kept) == 0, words).otherwise(kept)


def doc_key(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^A-Za-z0-9]", ""))


def domain(c: Column) -> Column:
    """Host of a submitted domain or URL: no scheme, path, query, fragment or port."""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"^(?:https://)?(?:http://)?", "")
    return F.nullif(F.regexp_extract(bare, r"^([^/?#:]*)", 1), F.lit(""))


def bare_host(c: Column) -> Column:
    """Host without scheme, ``www.``, path or port."""
    host = F.regexp_extract(F.regexp_replace(F.lower(F.trim(c)), r"^[a-z]+://", ""), r"^([^/:]*)", 1)
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def page_url(c: Column) -> Column:
    """Canonical company-page URL, NULL for anything else."""
    slug = F.regexp_extract(c, r"(?i)linkedin\.com/company/([^/?#\s]+)", 1)
    return F.when(slug != "", F.concat(F.lit("https://www.linkedin.com/company/"), F.lower(slug)))


def person_key(c: Column) -> Column:
    return squeeze(F.lower(F.coalesce(c, F.lit(""))))


def email(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def is_free_email(c: Column) -> Column:
    host = F.try_element_at(F.split(F.lower(c), "@", 2), F.lit(2))
    return F.coalesce(host.isin(*FREE_EMAIL_DOMAINS), F.lit(False))


def fein(c: Column) -> Column:
    """Nine digits of a federal tax id, else NULL."""
    digits = F.regexp_replace(c, r"\D", "")
    return F.when(F.length(digits) == 9, digits)


def debtor_name(c: Column) -> Column:
    """Case caption without a trailing "et al."."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)[\s,]+et\.?\s+al\.?\s*$", ""))


def truthy(normalized: Column, raw: Column) -> Column:
    value = F.lower(F.coalesce(F.nullif(normalized, F.lit("")), raw, F.lit("")))
    return value.isin(*TRUTHY)


def numbered(c: Column) -> Column:
    """"(1) A (2) B" -> [A, B]; a plain value -> [value]; blank -> []."""
    value = F.trim(F.coalesce(c, F.lit("")))
    parts = F.filter(F.transform(F.split(value, r"\(\d+\)"), lambda v: F.trim(v)), lambda p: p != "")
    return (
        F.when(value == "", F.array().cast("array<string>"))
        .when(~value.startswith("("), F.array(value))
        .otherwise(parts)
    )


def like_pattern(c: Column) -> Column:
    """Escape the LIKE wildcards of user text and wrap it for a substring search."""
    return F.concat(F.lit("%"), F.regexp_replace(c, r"([\\%_])", r"\\$1"), F.lit("%"))


def substring_match(haystack: Column, needle: str) -> Column:
    """Case-insensitive substring test that treats ``% _`` as plain characters."""
    return F.contains(F.lower(haystack), F.lit(needle.lower()))


def truncate_ip(c: Column) -> Column:
    """IPv4 to its /24, IPv6 to its /48, anything unparsable to NULL."""
    v = F.trim(c)
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    v4 = F.when(
        v.rlike(rf"^{octet}(?:\.{octet}){{3}}$"),
        F.concat(F.substring_index(v, ".", 3), F.lit(".0/24")),
    )
    return F.coalesce(v4, _truncate_ipv6(F.lower(v)))


def _truncate_ipv6(v: Column) -> Column:
    """Expand ``::``, keep three groups, print the zero-compressed network."""
    group = r"[0-9a-f]{1,4}"
    # An embedded dotted quad stands for the last two groups, outside the kept prefix.
    v = F.regexp_replace(v, r":\d{1,3}(?:\.\d{1,3}){3}$", ":0:0")
    halves = F.split(v, "::")

    def groups(part: Column) -> Column:
        return F.filter(F.split(part, ":"), lambda g: g != "")

    left = groups(F.element_at(halves, 1))
    right = groups(F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit("")))
    compressed = F.size(halves) == 2
    known = F.size(left) + F.when(compressed, F.size(right)).otherwise(0)
    shape = rf"^(?:{group}(?::{group}){{7}}|(?:{group}(?::{group})*)?::(?:{group}(?::{group})*)?)$"
    valid = v.rlike(shape) & F.when(compressed, known <= 7).otherwise(known == 8)
    full = F.when(
        compressed, F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - known, F.lit(0))), right)
    ).otherwise(left)
    head = F.transform(F.slice(full, 1, 3), lambda g: F.regexp_replace(g, r"^0+(?=.)", ""))
    # Trailing zero groups vanish into "::"; an inner zero stays because the tail run is longer.
    text = F.regexp_replace(F.array_join(head, ":"), r"(?:^|:)0(?::0)*$", "")
    return F.when(valid, F.concat(text, F.lit("::/48")))


# USPS codes of states, the district and the territories.
US_STATES = tuple(
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO "
    "MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY "
    "DC PR GU VI AS MP".split()
)


def us_state(jurisdictions: Column, address: Column) -> Column:
    """Registry or tax jurisdiction ``US-XX`` first, else the last state before a ZIP."""
    registered = F.filter(
        F.transform(jurisdictions, lambda j: F.regexp_extract(F.upper(j), r"^US[_\-]([A-Z]{2})$", 1)),
        lambda s: s.isin(*US_STATES),
    )
    mailed = F.filter(
        F.regexp_extract_all(F.upper(F.coalesce(address, F.lit(""))),
                             F.lit(r"\b([A-Z]{2})\s+\d{5}(?:-\d{4})?\b"), F.lit(1)),
        lambda s: s.isin(*US_STATES),
    )
    return F.coalesce(F.try_element_at(registered, F.lit(1)), F.try_element_at(mailed, F.lit(-1)))
