"""Contact and branding extraction from page text, as regular-expression Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists of the contact extractor.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = r"\+?\d[\d\s\-\.\(\)]{7,}\d"
ADDRESS = (
    r"(?i)\b\d{1,5}\s+[A-Za-z][A-Za-z0-9\s,\.]{2,50}?\s(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|"
    r"Drive|Dr|Lane|Ln|Court|Ct|Place|Pl|Way)\b"
)
PLACEHOLDER_DOMAINS = (
    "example.com", "example.org", "example.net", "domain.com", "email.com", "yourcompany.com",
    "yourdomain.com", "company.com", "test.com", "sentry.io",
)
ASSET_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp")


def strip_tags(html: Column) -> Column:
    """Tags become spaces; the common entities are decoded."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"<[^>]+>", " ")
    for entity, plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&#160;", " ")):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def find_emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))


def find_phones(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PHONE), F.lit(0))


def find_addresses(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ADDRESS), F.lit(0)), lambda v: F.trim(v)))


def mail_domain(e: Column) -> Column:
    """Everything after the first ``@``."""
    return F.try_element_at(F.split(e, "@", 2), F.lit(2))


def on_domain(e: Column, company: Column) -> Column:
    host = mail_domain(e)
    return (host == company) | host.endswith(F.concat(F.lit("."), company))


def clean_emails(found: Column, company: Column) -> Column:
    """Lower case, distinct, no placeholders or asset names; company addresses first, else page order."""
    lowered = F.array_distinct(F.transform(found, lambda e: F.rtrim(F.lower(e), F.lit("."))))
    kept = F.filter(
        lowered,
        lambda e: ~mail_domain(e).isin(*PLACEHOLDER_DOMAINS)
        & ~e.rlike(r"\.(?:" + "|".join(s[1:] for s in ASSET_SUFFIXES) + r")$"),
    )
    own = F.coalesce(company, F.lit(""))
    return F.concat(F.filter(kept, lambda e: on_domain(e, own)), F.filter(kept, lambda e: ~on_domain(e, own)))


def clean_phones(found: Column) -> Column:
    """10 to 15 digits, not a bare digit run, more than two different digits."""
    def ok(p: Column) -> Column:
        digits = F.regexp_replace(p, r"\D", "")
        varied = F.size(F.array_distinct(F.split(digits, ""))) > 2
        return F.length(digits).between(10, 15) & ~p.rlike(r"^\d+$") & varied

    return F.filter(F.array_distinct(F.transform(found, lambda v: F.trim(v))), ok)


def _meta(html: Column, name: str) -> Column:
    name = name.replace(".", r"\.")
    forward = rf"(?is)<meta[^>]+(?:property|name)\s*=\s*[\"']{name}[\"'][^>]+content\s*=\s*[\"']([^\"']+)[\"']"
    backward = rf"(?is)<meta[^>]+content\s*=\s*[\"']([^\"']+)[\"'][^>]+(?:property|name)\s*=\s*[\"']{name}[\"']"
    return F.coalesce(_first(html, forward), _first(html, backward))


def _first(html: Column, pattern: str) -> Column:
    """Trimmed first group, NULL when the pattern does not occur."""
    found = F.regexp_extract(html, pattern, 1)
    return F.when(found != "", F.trim(found))


def page_brand(html: Column) -> Column:
    """og:site_name, og:title, <title>, first <h1>; the first that is not blank."""
    parts = (
        _meta(html, "og:site_name"), _meta(html, "og:title"),
        _first(html, r"(?is)<title[^>]*>([^<]+)</title>"), _first(html, r"(?is)<h1[^>]*>([^<]+)</h1>"),
    )
    return F.coalesce(*[F.nullif(p, F.lit("")) for p in parts])
