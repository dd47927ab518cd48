"""Registered queries: company normalizers, evidence producers, comparisons and public records."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewatch.functions import contacts, geo, text
from sievewatch.operators import consistency, ownership, people, public_records, resolve
from sievewatch.plans.base import AS_OF, dealt, pick, query, sql_list, sql_pick, table
from sievewatch.plans.inputs import CITIES, COUNTRY_CODE, COUNTRY_TEXT, FAMILY, GIVEN, ISO
from sievewatch.sources import evidence as producers

A = ("Harbor", "North Star", "Blue Ridge", "Keystone", "Acorn", "Silver Oak", "Granite", "Delta", "Juniper", "Lantern", "Meridian", "The Copper")
B = ("Lines", "Holdings", "Logistics", "Systems", "Trading Company", "Foods", "Energy", "Group", "Partners & Sons", "Works")
SUFFIX = (" Inc.", ", LLC", " Corporation Inc.", " GmbH", "", " Ltd", " Co., Ltd.", ", Private Limited", " L.L.C.", " plc")
COUNTRIES_IN = ("US", "germany", " uk ", "Atlantis", "United States", "FR", "south korea", "de")
COUNTRIES_OUT = ("US", "DE", "GB", None, "US", "FR", "KR", "DE")


def company(k):
    return F.concat(pick(A, k % 12), F.lit(" "), pick(B, k % 10), pick(SUFFIX, (k * 3 + 1) % 10))


def company_sql(k: str) -> str:
    return f"({sql_pick(A, f'({k}) % 12')} || ' ' || {sql_pick(B, f'({k}) % 10')} || {sql_pick(SUFFIX, f'(({k}) * 3 + 1) % 10')})"


def core_sql(x: str) -> str:
    bare = rf"regexp_replace(trim({x}), '^(.+?)(?:\s*,?\s*\b(?:{'|'.join(text.CORE_SUFFIXES)})\.?\s*)+$', '\1', 'i')"
    return rf"trim(regexp_replace(regexp_replace(lower({bare}), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def key_sql(x: str) -> str:
    bare = rf"trim(rtrim(trim(regexp_replace({x}, '\b(?:{'|'.join(text.SANCTIONS_SUFFIXES)})\s*$', '', 'i')), ','))"
    return rf"trim(regexp_replace(lower({bare}), '\s+', ' ', 'g'))"


def submissions(spark, sf_dir):
    """One normalized submission per customer."""
    k = F.col("c_custkey")
    addr = F.concat((k % 900 + 1).cast("string"), F.lit(" Main Street, "), pick(CITIES, k % 5), F.lit(", "), pick(("TX", "CA", "ZZ", "NY"), k % 4), F.lit(" 78701"))
    return dealt(table(spark, sf_dir, "customer"), "c_custkey").select(
        k.alias("run_id"), k.alias("submission_id"), company(k).alias("company_name"), F.concat(F.lit("c"), (k % 300).cast("string"), F.lit(".example.com")).alias("domain"),
        F.when(k % 4 == 3, "DE").otherwise("US").alias("country_iso"), F.concat(F.lit("u"), k.cast("string"), pick(("@gmail.com", "@c.example.com", "@proton.me", "@corp.example"), k % 4)).alias("email"),
        F.when(k % 6 != 0, addr).alias("billing_address"), F.when(k % 5 != 4, F.concat((k % 90 + 10).cast("string"), F.lit("-"), F.lpad((k % 400).cast("string"), F.when(k % 7 == 0, 6).otherwise(7), "0"))).alias("tax_id"),
        F.when(k % 3 == 0, F.concat(F.lit("https://LinkedIn.com/company/Co-"), (k % 200).cast("string"), F.lit("/about"))).alias("linkedin_url"),
        F.concat(pick(GIVEN, k % 24), F.lit("  "), pick(FAMILY, k % 40)).alias("requester_full_name"),
        F.concat_ws(".", F.lit("10"), (k % 20).cast("string"), F.lit("1"), (k % 250).cast("string")).alias("source_ip"))


SUBS_SQL = f"""
sub AS (SELECT c_custkey AS k, c_custkey AS run_id, {company_sql('c_custkey')} AS company_name, 'c' || (c_custkey % 300) || '.example.com' AS domain,
  CASE WHEN c_custkey % 4 = 3 THEN 'DE' ELSE 'US' END AS country_iso,
  CASE WHEN c_custkey % 6 <> 0 THEN (c_custkey % 900 + 1) || ' Main Street, ' || {sql_pick(CITIES, 'c_custkey % 5')} || ', ' || (['TX', 'CA', 'ZZ', 'NY'])[c_custkey % 4 + 1] || ' 78701' END AS billing_address,
  CASE WHEN c_custkey % 5 <> 4 THEN (c_custkey % 90 + 10) || '-' || lpad((c_custkey % 400)::VARCHAR, CASE WHEN c_custkey % 7 = 0 THEN 6 ELSE 7 END, '0') END AS tax_id,
  '10.' || (c_custkey % 20) || '.1.' || (c_custkey % 250) AS source_ip FROM customer)"""


@query("company_name_keys", f"""SELECT p_partkey AS k, {core_sql(company_sql('p_partkey'))} AS core, {key_sql(company_sql('p_partkey'))} AS sanctions_key FROM part""")
def company_name_keys(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("k"), text.core_name(company(k)).alias("core"), text.sanctions_key(company(k)).alias("sanctions_key"))


@query("entity_name_tokens", rf"""
SELECT k, array_to_string(list_sort(CASE WHEN len(kept) = 0 THEN w ELSE kept END), ' ') AS tokens FROM (
 SELECT k, w, list_filter(w, lambda t: NOT list_contains({sql_list(text.ENTITY_STOP_WORDS)}, t)) AS kept FROM (
  SELECT p_partkey AS k, list_distinct(list_filter(string_split(regexp_replace(lower({company_sql('p_partkey')}), '[^\w]+', ' ', 'g'), ' '), lambda t: t <> '')) AS w FROM part))""")
def entity_name_tokens(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("k"), F.array_join(F.array_sort(text.entity_tokens(company(k))), " ").alias("tokens"))


@query("field_normalizers", f"""
SELECT p_partkey AS k, ({'[' + ', '.join('NULL' if c is None else f"'{c}'" for c in COUNTRIES_OUT) + ']'})[p_partkey % 8 + 1] AS country,
  ({sql_list(COUNTRY_CODE[:10] + ('',))})[p_partkey % 11 + 1] AS list_country,
  CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE lpad((p_partkey % 1000)::VARCHAR, 9, '1') END AS fein,
  lower(p_brand) || '.example' AS domain, upper(replace(p_brand, '#', '')) AS doc, p_partkey % 2 = 0 AS free_mail FROM part""")
def field_normalizers(spark, sf_dir):
    k = F.col("p_partkey")
    fein = F.lpad((k % 1000).cast("string"), 9, "1")
    dashed = F.concat(F.substring(fein, 1, 2), F.lit("-"), F.substring(fein, 3, 7), F.when(k % 7 == 0, "9").otherwise(""))
    host = F.regexp_replace("p_brand", "#", "%23")
    return table(spark, sf_dir, "part").select(
        k.alias("k"), geo.company_country(pick(COUNTRIES_IN, k % 8)).alias("country"), F.coalesce(geo.iso2(pick(COUNTRY_TEXT, k % 11)), F.lit("")).alias("list_country"),
        text.fein(dashed).alias("fein"),
        F.replace(text.domain(F.concat(F.lit(" HTTPS://"), F.upper(host), F.lit(".Example:8080/a?b=c"))), F.lit("%23"), F.lit("#")).alias("domain"),
        text.doc_key(F.concat(F.lit(" "), F.col("p_brand"), F.lit("-"))).alias("doc"),
        text.is_free_email(F.when(k % 2 == 0, "a@GMAIL.com").otherwise("a@corp.example")).alias("free_mail"))


@query("country_dimension_join", f"SELECT p_partkey AS k, nullif(({sql_list(COUNTRY_CODE[:10] + ('',))})[p_partkey % 11 + 1], '') AS iso2 FROM part")
def country_dimension_join(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("k"), pick(COUNTRY_TEXT, k % 11).alias("country"))
    return geo.with_iso2(rows, "country", geo.country_dim(spark)).select("k", "iso2")


@query("page_hosts", r"""
SELECT page_id, regexp_extract(regexp_replace(lower(url), '^(https?://)', ''), '^([^/?#:]*)', 1) AS domain,
  regexp_replace(regexp_extract(regexp_replace(lower(url), '^[a-z]+://', ''), '^([^/:]*)', 1), '^www\.', '') AS host FROM pages""")
def page_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.domain(F.col("url")).alias("domain"), text.bare_host(F.col("url")).alias("host"))


_TEXT_SQL = r"replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '&#160;', ' ')"



def _contact_sql(source: str, key: str, body: str) -> str:
    """Cleaned e-mails in page order: positions are kept with a window instead of an ordered distinct."""
    return rf"""
m AS (SELECT {key} AS id, rtrim(lower(unnest(regexp_extract_all({body}, '{contacts.EMAIL}'))), '.') AS e, generate_subscripts(regexp_extract_all({body}, '{contacts.EMAIL}'), 1) AS pos FROM {source}),
f AS (SELECT id, e, min(pos) AS pos FROM m WHERE NOT list_contains({sql_list(contacts.PLACEHOLDER_DOMAINS)}, regexp_replace(e, '^[^@]*@', ''))
      AND NOT regexp_matches(e, '\.(png|jpg|jpeg|gif|svg|webp)$') GROUP BY ALL)"""


@query("document_contacts", f"""WITH {_contact_sql('documents', 'doc_id', 'text')}
SELECT doc_id, string_agg(e, ' ' ORDER BY (NOT (regexp_replace(e, '^[^@]*@', '') = 'mail3.example.com' OR ends_with(regexp_replace(e, '^[^@]*@', ''), '.mail3.example.com'))), pos) AS emails
FROM documents LEFT JOIN f ON id = doc_id GROUP BY doc_id""")
def document_contacts(spark, sf_dir):
    mails = contacts.clean_emails(contacts.find_emails(F.col("text")), F.lit("mail3.example.com"))
    return table(spark, sf_dir, "documents").select("doc_id", F.nullif(F.array_join(mails, " "), F.lit("")).alias("emails"))


@query("document_phones", rf"""
WITH m AS (SELECT doc_id, trim(unnest(regexp_extract_all(text, '{contacts.PHONE}')), ' ' || chr(10) || chr(9) || chr(13)) AS p FROM documents)
SELECT doc_id, string_agg(DISTINCT p, '|' ORDER BY p) AS phones FROM m
WHERE length(regexp_replace(p, '\D', '', 'g')) BETWEEN 10 AND 15 AND NOT regexp_matches(p, '^\d+$') AND len(list_distinct(string_split(regexp_replace(p, '\D', '', 'g'), ''))) > 2 GROUP BY doc_id""")
def document_phones(spark, sf_dir):
    phones = F.array_sort(contacts.clean_phones(contacts.find_phones(F.col("text"))))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(phones, "|").alias("phones")).filter("phones <> ''")


def _found_sql(pattern: str) -> str:
    """Every match of a pattern in the pages' text with its place."""
    found = "regexp_extract_all(body, '" + pattern.replace("'", "''") + "')"
    return f"SELECT page_id AS id, trim(unnest({found}), ' ' || chr(10) || chr(9) || chr(13)) AS v, generate_subscripts({found}, 1) AS pos FROM p"


@query("web_page_evidence", f"""
WITH p AS (SELECT page_id, html, {_TEXT_SQL} AS body FROM pages), {_contact_sql('p', 'page_id', 'body')},
n AS (SELECT id, count(*) AS n FROM f GROUP BY id)
SELECT page_id AS run_id, 'web_brand' AS field, trim(coalesce(nullif(regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1), ''), regexp_extract(html, '(?i)<h1[^>]*>([^<]+)</h1>', 1))) AS normalized_value FROM p
UNION ALL SELECT page_id, CASE WHEN n IS NULL THEN 'web_thin_footprint' ELSE 'web_employee_footprint' END, coalesce(n::VARCHAR, 'true') FROM p LEFT JOIN n ON id = page_id
UNION ALL SELECT id, 'web_contacts_email', arg_min(e, pos) FROM f GROUP BY id
UNION ALL SELECT id, 'web_contacts_phone', arg_min(v, pos) FROM ({_found_sql(contacts.PHONE)})
  WHERE length(regexp_replace(v, '\\D', '', 'g')) BETWEEN 10 AND 15 AND NOT regexp_matches(v, '^\\d+$') AND len(list_distinct(string_split(regexp_replace(v, '\\D', '', 'g'), ''))) > 2 GROUP BY id
UNION ALL SELECT id, 'web_contacts_address', arg_min(v, pos) FROM ({_found_sql(contacts.ADDRESS)}) GROUP BY id""")
def web_page_evidence(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    host = text.bare_host(F.col("url"))
    subs = pages.select(F.col("page_id").alias("run_id"), F.concat_ws("#", host, "page_id").alias("domain"))
    landed = pages.select(F.concat_ws("#", host, "page_id").alias("domain"), "url", "html")
    return producers.web_evidence(subs, landed, AS_OF).select("run_id", "field", "normalized_value")


@query("free_email_evidence", "SELECT c_custkey AS run_id, 'free_email_domain' AS field FROM customer WHERE c_custkey % 4 IN (0, 2)")
def free_email_evidence(spark, sf_dir):
    return producers.free_email_evidence(submissions(spark, sf_dir), AS_OF).select("run_id", "field")


def _registry(spark, sf_dir):
    """Two landed registry companies per run, as JSON search responses."""
    p = dealt(table(spark, sf_dir, "part"), "p_partkey")
    k = F.col("p_partkey")
    run = F.floor(k / 2)
    addr = F.concat((run % 900 + 1).cast("string"), F.lit(" Main Road "), pick(CITIES, k % 5))
    body = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(
        F.when(k % 5 == 4, F.lit("Other Firm")).otherwise(company(run)).alias("name"), F.concat(F.lit("N"), F.when(k % 6 == 3, run).otherwise(k).cast("string")).alias("company_number"),
        F.when(k % 3 == 0, "Active").when(k % 3 == 1, "Dissolved").alias("current_status"), F.when(k % 3 == 2, "https://reg.example/x").alias("registry_url"),
        pick(("us_tx", "us_ca", "de", "us"), k % 4).alias("jurisdiction_code"), F.when(k % 2 == 0, addr).alias("registered_address_in_full")).alias("company"))).alias("companies")).alias("results")))
    return producers.read_registry(p.select(run.alias("run_id"), body.alias("body")))


REG_SQL = f"""
reg AS (SELECT p_partkey // 2 AS run_id, p_partkey AS k, CASE WHEN p_partkey % 5 = 4 THEN 'Other Firm' ELSE {company_sql('p_partkey // 2')} END AS name,
  'N' || CASE WHEN p_partkey % 6 = 3 THEN p_partkey // 2 ELSE p_partkey END AS number, CASE p_partkey % 3 WHEN 0 THEN 'Active' WHEN 1 THEN 'Dissolved' ELSE 'https://reg.example/x' END AS status,
  (['us_tx', 'us_ca', 'de', 'us'])[p_partkey % 4 + 1] AS jur, CASE WHEN p_partkey % 2 = 0 THEN (p_partkey // 2 % 900 + 1) || ' Main Road ' || {sql_pick(CITIES, 'p_partkey % 5')} END AS addr FROM part)"""


@query("registry_evidence", f"""WITH {REG_SQL}
SELECT run_id, 'company_name' AS field, name AS normalized_value FROM reg UNION ALL SELECT run_id, 'registration_number', number FROM reg
UNION ALL SELECT run_id, 'registration_status', status FROM reg UNION ALL SELECT run_id, 'jurisdiction', upper(jur) FROM reg UNION ALL SELECT run_id, 'legal_address', addr FROM reg WHERE addr IS NOT NULL""")
def registry_evidence(spark, sf_dir):
    return producers.registry_evidence(_registry(spark, sf_dir), AS_OF).select("run_id", "field", "normalized_value")


@query("registry_identity_conflicts", f"""WITH {SUBS_SQL},{REG_SQL}
SELECT s.run_id FROM sub s JOIN reg r ON s.run_id = r.run_id AND {key_sql('s.company_name')} = {key_sql('r.name')} GROUP BY s.run_id HAVING count(DISTINCT number) >= 2""")
def registry_identity_conflicts(spark, sf_dir):
    return producers.identity_conflicts(submissions(spark, sf_dir), _registry(spark, sf_dir), AS_OF).select("run_id")


@query("company_sanctions", f"""WITH {SUBS_SQL}, lst AS (SELECT s_suppkey AS id, {company_sql('s_suppkey * 7')} AS name FROM supplier),
h AS (SELECT run_id, name FROM sub JOIN lst ON {key_sql('company_name')} = {key_sql('name')})
SELECT run_id, 'sanctions_hit' AS field, upper(name) AS normalized_value FROM h UNION ALL SELECT DISTINCT run_id, 'sanctions_risk_flag', 'true' FROM h
UNION ALL SELECT run_id, 'sanctions_screened', 'no_hit' FROM sub WHERE run_id NOT IN (SELECT run_id FROM h)""")
def company_sanctions(spark, sf_dir):
    k = F.col("s_suppkey")
    listed = table(spark, sf_dir, "supplier").select(k.alias("entry_id"), company(k * 7).alias("name"))
    return producers.company_sanctions(submissions(spark, sf_dir), listed, AS_OF).select("run_id", "field", "normalized_value")


_ORGS = ("AS1 Amazon Web", "AS22 Rural Telecom", "AS333", "", "AS4 HostPro hosting", "AS5 Oak Fiber")


@query("ip_evidence", f"""WITH {SUBS_SQL},
ip AS (SELECT DISTINCT source_ip, split_part(source_ip, '.', 2)::INT AS b, split_part(source_ip, '.', 4)::INT AS d FROM sub),
j AS (SELECT run_id, country_iso, nullif({sql_pick(_ORGS, 'd % 6')}, '') AS org, CASE WHEN b % 3 = 0 THEN 'us' WHEN b % 3 = 1 THEN 'DE' END AS c, d % 5 = 0 AS vpn FROM sub JOIN ip USING (source_ip)),
g AS (SELECT *, coalesce(regexp_matches(lower(org), 'amazon|hosting|tor|vpn'), false) AS kw FROM j)
SELECT run_id, 'ip_country' AS field, c AS normalized_value FROM g WHERE c IS NOT NULL UNION ALL SELECT run_id, 'ip_organization', org FROM g WHERE org IS NOT NULL
UNION ALL SELECT run_id, 'ip_asn', split_part(org, ' ', 1) FROM g WHERE org IS NOT NULL
UNION ALL SELECT run_id, 'ip_isp', CASE WHEN contains(org, ' ') THEN substr(org, instr(org, ' ') + 1) ELSE org END FROM g WHERE org IS NOT NULL
UNION ALL SELECT run_id, 'ip_vpn', 'true' FROM g WHERE vpn UNION ALL SELECT run_id, 'ip_hosting', 'true' FROM g WHERE kw AND NOT vpn
UNION ALL SELECT run_id, 'ip_anonymized_network', 'true' FROM g WHERE kw OR vpn UNION ALL SELECT run_id, 'ip_suspicious_asn', 'true' FROM g WHERE kw
UNION ALL SELECT run_id, 'ip_country_match', CASE WHEN upper(c) = country_iso THEN 'true' ELSE 'false' END FROM g WHERE c IS NOT NULL
UNION ALL SELECT run_id, 'ip_country_mismatch', 'true' FROM g WHERE c IS NOT NULL AND upper(c) <> country_iso""")
def ip_evidence(spark, sf_dir):
    subs = submissions(spark, sf_dir)
    b, d = F.split("ip", r"\.")[1].cast("int"), F.split("ip", r"\.")[3].cast("int")
    body = F.to_json(F.struct("ip", F.when(b % 3 == 0, "us").when(b % 3 == 1, "DE").alias("country"), pick(_ORGS, d % 6).alias("org"), F.struct((d % 5 == 0).alias("vpn")).alias("privacy")))
    landed = subs.select(F.col("source_ip").alias("ip")).distinct().select("ip", body.alias("body"))
    return producers.ip_evidence(subs, landed, AS_OF).select("run_id", "field", "normalized_value")


@query("domain_evidence", f"""WITH {SUBS_SQL}, d AS (SELECT run_id, substr(domain, 2, instr(domain, '.') - 2)::INT AS n FROM sub), e AS (SELECT *, n * 9 AS age FROM d)
SELECT run_id, 'whois_status' AS field, 'unavailable' AS normalized_value FROM e WHERE n % 10 = 0 UNION ALL SELECT run_id, 'domain_age_days', age::VARCHAR FROM e WHERE n % 10 <> 0
UNION ALL SELECT run_id, 'recently_registered', 'true' FROM e WHERE n % 10 <> 0 AND age < 180 UNION ALL SELECT run_id, 'mx_present', CASE WHEN n % 4 = 0 THEN 'false' ELSE 'true' END FROM e
UNION ALL SELECT run_id, 'no_mx', 'true' FROM e WHERE n % 4 = 0 UNION ALL SELECT run_id, 'spf_present', CASE WHEN n % 3 = 0 THEN 'true' ELSE 'false' END FROM e
UNION ALL SELECT run_id, 'dkim_present', CASE WHEN n % 6 = 1 THEN 'true' ELSE 'false' END FROM e WHERE n % 2 = 1 UNION ALL SELECT run_id, 'ssl_issuer', 'CA' || n FROM e WHERE n % 5 <> 0
UNION ALL SELECT run_id, 'domain_registrar', 'Reg ' || (n % 7) FROM e WHERE n % 10 <> 0 UNION ALL SELECT run_id, 'mx_records', CASE WHEN n % 4 = 0 THEN 'none' ELSE 'mx' || n END FROM e
UNION ALL SELECT run_id, 'domain_creation_date', strftime(TIMESTAMP '{AS_OF}' - to_days(age), '%Y-%m-%dT%H:%M:%S') FROM e WHERE n % 10 <> 0
UNION ALL SELECT run_id, 'domain_expiry_date', strftime(TIMESTAMP '{AS_OF}' + to_days(age), '%Y-%m-%dT%H:%M:%S') FROM e WHERE n % 10 <> 0
UNION ALL SELECT run_id, 'spf_record', CASE WHEN n % 3 = 0 THEN 'V=SPF1 -all' ELSE 'none' END FROM e UNION ALL SELECT run_id, 'ssl_subject', 'CN' || n FROM e WHERE n % 6 <> 0
UNION ALL SELECT run_id, 'ssl_not_before', '2001-01-0' || (n % 9 + 1) FROM e UNION ALL SELECT run_id, 'ssl_not_after', '2003-01-0' || (n % 9 + 1) FROM e WHERE n % 7 <> 0""")
def domain_evidence(spark, sf_dir):
    subs = submissions(spark, sf_dir)
    n = F.regexp_extract("domain", r"^c(\d+)", 1).cast("int")
    created = F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(n * 9)
    expires = F.lit(AS_OF).cast("timestamp") + F.make_dt_interval(n * 9)
    no_text = F.array().cast("array<string>")
    numbered = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    landed = subs.select("domain").distinct().select(
        "domain", F.when(n % 10 != 0, F.struct(created.alias("creation_date"), expires.alias("expiration_date"), F.concat(F.lit("Reg "), (n % 7).cast("string")).alias("registrar"))).alias("whois"),
        F.when(n % 4 == 0, no_text).otherwise(F.array(numbered("mx", n), F.lit("other"))).alias("mx"), F.when(n % 3 == 0, F.array(F.lit("x"), F.lit("V=SPF1 -all"))).otherwise(no_text).alias("txt"),
        F.when(n % 2 == 1, F.when(n % 6 == 1, F.array(F.lit("k"))).otherwise(no_text)).alias("dkim"),
        F.struct(F.when(n % 5 != 0, F.concat(F.lit("CA"), n.cast("string"))).alias("issuer"), F.when(n % 6 != 0, numbered("CN", n)).alias("subject"),
                 numbered("2001-01-0", n % 9 + 1).alias("not_before"), F.when(n % 7 != 0, numbered("2003-01-0", n % 9 + 1)).alias("not_after")).alias("cert"))
    return producers.domain_evidence(subs, landed, AS_OF).select("run_id", "field", "normalized_value")


@query("social_evidence", f"""WITH {SUBS_SQL}, pg AS (SELECT s_suppkey AS n, 'c' || (s_suppkey % 50) || '.example.com' AS site FROM supplier), byurl AS (SELECT n FROM pg),
bysite AS (SELECT site, arg_min(n, 'https://linkedin.com/company/CO-' || n) AS n FROM pg GROUP BY site),
r AS (SELECT run_id, k % 3 = 0 AS u, CASE WHEN k % 3 = 0 THEN byurl.n ELSE bysite.n END AS n FROM sub LEFT JOIN byurl ON k % 3 = 0 AND byurl.n = k % 200 LEFT JOIN bysite ON site = domain)
SELECT run_id, 'linkedin_presence' AS field, CASE WHEN n IS NULL THEN 'not_found' ELSE 'found' END AS normalized_value FROM r WHERE u OR n IS NOT NULL
UNION ALL SELECT run_id, 'linkedin_company_url', 'https://www.linkedin.com/company/co-' || n FROM r WHERE n IS NOT NULL UNION ALL SELECT run_id, 'linkedin_employee_count', (n % 30)::VARCHAR FROM r WHERE n IS NOT NULL
UNION ALL SELECT run_id, 'linkedin_website', 'c' || (n % 50) || '.example.com' FROM r WHERE n IS NOT NULL
UNION ALL SELECT run_id, 'linkedin_requester_match', CASE WHEN run_id % 24 = n % 24 AND run_id % 40 = n % 40 THEN 'true' ELSE 'false' END FROM r WHERE n IS NOT NULL""")
def social_evidence(spark, sf_dir):
    n = F.col("s_suppkey")
    none = F.lit(None).cast("string")
    pages = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("https://linkedin.com/company/CO-"), n.cast("string")).alias("url"), none.alias("name"), (n % 30).cast("int").alias("employee_count"), none.alias("followers"),
        none.alias("founded_year"), F.concat(F.lit("https://www.c"), (n % 50).cast("string"), F.lit(".example.com/x")).alias("website"), none.alias("page_created"),
        F.array(F.concat(F.upper(pick(GIVEN, n % 24)), F.lit(" "), pick(FAMILY, n % 40))).alias("associated_people"))
    return producers.social_evidence(submissions(spark, sf_dir), pages, AS_OF).select("run_id", "field", "normalized_value")


@query("tax_evidence", f"""WITH {SUBS_SQL}, q AS (SELECT run_id, company_name, regexp_replace(tax_id, '\\D', '', 'g') AS f FROM sub WHERE tax_id IS NOT NULL AND country_iso = 'US'),
t AS (SELECT DISTINCT ON (fein) lpad(((p_partkey % 90 + 10) * 10000000 + p_partkey % 400)::VARCHAR, 9, '0') AS fein, p_partkey % 3 AS st, p_partkey AS pk FROM part ORDER BY fein, pk),
j AS (SELECT run_id, company_name, fein, st, pk FROM q LEFT JOIN t ON fein = f AND length(f) = 9)
SELECT run_id, 'tax_id_status' AS field, CASE WHEN fein IS NULL THEN 'not_found' WHEN st < 2 THEN 'verified' ELSE 'inactive' END AS normalized_value FROM j
UNION ALL SELECT run_id, 'tax_id_name_match', CASE WHEN {core_sql('company_name')} = {core_sql(company_sql('pk + st // 2'))} THEN 'match' ELSE 'mismatch' END FROM j WHERE fein IS NOT NULL
UNION ALL SELECT run_id, 'tax_id_registered_name', {company_sql('pk + st // 2')} FROM j WHERE fein IS NOT NULL
UNION ALL SELECT run_id, 'tax_id_entity_type', 'corporation' FROM j WHERE pk % 2 = 0 UNION ALL SELECT run_id, 'tax_id_jurisdiction', {sql_pick(CITIES, 'pk % 5')} FROM j WHERE fein IS NOT NULL""")
def tax_evidence(spark, sf_dir):
    k = F.col("p_partkey")
    records = table(spark, sf_dir, "part").select(
        ((k % 90 + 10) * 10000000 + k % 400).cast("string").alias("fein"), pick(("Active", " good standing", "dissolved"), k % 3).alias("status"),
        company(k + F.floor((k % 3) / 2)).alias("registered_name"), F.when(k % 2 == 0, "corporation").alias("entity_type"), pick(CITIES, k % 5).alias("jurisdiction"), k.alias("k"))
    records = records.groupBy("fein").agg(F.min_by(F.struct("status", "registered_name", "entity_type", "jurisdiction"), "k").alias("r")).select("fein", "r.*")
    return producers.tax_evidence(submissions(spark, sf_dir), records, AS_OF).select("run_id", "field", "normalized_value")


def _discovered(spark, sf_dir):
    """Registry evidence with a total order for 'first' rows."""
    rows = producers.registry_evidence(_registry(spark, sf_dir), AS_OF)
    return rows


_NOISE = sql_list(consistency.ADDRESS_NOISE)


@query("field_comparisons", rf"""WITH {SUBS_SQL},{REG_SQL},
n AS (SELECT s.run_id, bool_or(contains(lower(company_name), lower(name)) OR contains(lower(name), lower(company_name))) AS ok FROM sub s JOIN reg r USING (run_id) GROUP BY ALL),
c AS (SELECT s.run_id, bool_or(starts_with(upper(jur), country_iso) OR starts_with(country_iso, upper(jur))) AS ok FROM sub s JOIN reg r USING (run_id) GROUP BY ALL),
t AS (SELECT s.run_id, list_filter(string_split(lower(coalesce(billing_address, '')), ' '), lambda w: NOT list_contains({_NOISE}, w)) AS a,
       list_filter(string_split(lower(addr), ' '), lambda w: NOT list_contains({_NOISE}, w)) AS b, billing_address IS NOT NULL AS has FROM sub s JOIN reg r USING (run_id) WHERE addr IS NOT NULL),
d AS (SELECT run_id, bool_or(has AND len(list_intersect(a, b))::DOUBLE / least(len(list_distinct(a)), len(list_distinct(b))) >= 0.4) AS ok FROM t GROUP BY ALL)
SELECT run_id, 'company_name' AS field_name, CASE WHEN ok IS NULL THEN 'unverified' WHEN ok THEN 'match' ELSE 'mismatch' END AS match_status FROM sub LEFT JOIN n USING (run_id)
UNION ALL SELECT run_id, 'country_iso', CASE WHEN ok IS NULL THEN 'unverified' WHEN ok THEN 'match' ELSE 'mismatch' END FROM sub LEFT JOIN c USING (run_id)
UNION ALL SELECT run_id, 'billing_address', CASE WHEN ok IS NULL THEN 'unverified' WHEN ok THEN 'match' ELSE 'mismatch' END FROM sub LEFT JOIN d USING (run_id)
UNION ALL SELECT run_id, unnest(['tax_id', 'tax_id_registered_name', 'linkedin_website']), 'unverified' FROM sub""")
def field_comparisons(spark, sf_dir):
    return consistency.compare_fields(submissions(spark, sf_dir), _discovered(spark, sf_dir)).select("run_id", "field_name", "match_status")


@query("headquarters_evidence", f"""WITH {SUBS_SQL}, r AS (SELECT p_partkey // 2 AS run_id, (p_partkey // 2 % 900 + 1) || ' Main Road ' || {sql_pick(CITIES, 'p_partkey % 5')} AS addr FROM part WHERE p_partkey % 2 = 0),
j AS (SELECT run_id, addr, billing_address, coalesce(addr, billing_address) AS a FROM sub LEFT JOIN r USING (run_id))
SELECT run_id, 'hq_address_source' AS field, CASE WHEN addr IS NULL THEN 'submitted' ELSE 'registry' END AS normalized_value FROM j WHERE a IS NOT NULL
UNION ALL SELECT run_id, 'hq_address_confidence', CASE WHEN addr IS NOT NULL AND run_id % 3 = 0 THEN 'high' WHEN addr IS NOT NULL AND run_id % 3 = 1 THEN 'medium' ELSE 'low' END FROM j WHERE a IS NOT NULL
UNION ALL SELECT run_id, 'hq_latitude', length(a) || '.5' FROM j WHERE a IS NOT NULL UNION ALL SELECT run_id, 'hq_longitude', '-' || length(a) FROM j WHERE a IS NOT NULL
UNION ALL SELECT run_id, 'hq_display_name', CASE WHEN length(a) % 2 = 0 THEN 'at ' || a ELSE a END FROM j WHERE a IS NOT NULL""")
def headquarters_evidence(spark, sf_dir):
    subs = submissions(spark, sf_dir)
    cmp = subs.select("run_id", F.lit("billing_address").alias("field_name"), pick(("match", "unverified", "mismatch"), F.col("run_id") % 3).alias("match_status"))
    ev = _discovered(spark, sf_dir)
    places = ev.filter(F.col("field") == "legal_address").select(F.col("normalized_value").alias("address")).union(subs.select("billing_address")).filter("address IS NOT NULL").distinct()
    n = F.length("address")
    places = places.select("address", F.concat(n.cast("string"), F.lit(".5")).alias("lat"), F.concat(F.lit("-"), n.cast("string")).alias("lon"), F.when(n % 2 == 0, F.concat(F.lit("at "), "address")).alias("display_name"))
    return producers.hq_evidence(subs, ev, cmp, places, AS_OF).select("run_id", "field", "normalized_value")


_TOK = rf"list_distinct(list_filter(string_split(regexp_replace(lower(NAME), '[^\w]+', ' ', 'g'), ' '), lambda t: t <> ''))"


def _tok_sql(x: str) -> str:
    w = _TOK.replace("NAME", x)
    kept = f"list_filter({w}, lambda t: NOT list_contains({sql_list(text.ENTITY_STOP_WORDS)}, t))"
    return f"CASE WHEN len({kept}) = 0 THEN {w} ELSE {kept} END"


@query("entity_resolution", f"""WITH {SUBS_SQL},
s AS (SELECT run_id, {_tok_sql('company_name')} AS st, domain AS sh FROM sub), h AS (SELECT s_suppkey AS cid, {_tok_sql(company_sql('s_suppkey * 5'))} AS ct, 'www.x' || s_suppkey || '.example.org' AS raw FROM supplier),
p AS (SELECT run_id, cid::VARCHAR AS cid, len(list_intersect(st, ct))::DOUBLE / least(len(st), len(ct)) AS ns FROM s, h WHERE len(list_intersect(st, ct)) > 0),
a AS (SELECT run_id, cid, round(0.6 * ns, 4) AS score FROM p WHERE round(0.6 * ns, 4) >= 0.4 UNION ALL SELECT run_id, '', 1.0 FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, cid) AS n FROM a)
SELECT run_id, CASE WHEN count(*) = 1 THEN 'single_match' ELSE 'ambiguous' END AS status, count(*) AS n_candidates, false AS conflict_signal, max(score) AS top_score FROM r GROUP BY run_id""")
def entity_resolution(spark, sf_dir):
    k = F.col("s_suppkey")
    hints = table(spark, sf_dir, "supplier").select(k.cast("string").alias("candidate_id"), company(k * 5).alias("name"), F.concat(F.lit("www.x"), k.cast("string"), F.lit(".example.org")).alias("domain"))
    _ranked, status = resolve.resolve_entities(submissions(spark, sf_dir), hints)
    return status.drop("top_candidate")


def _varied(k: str, longer: str) -> str:
    """Name of company ``k`` as SQL of both engines; two words are common to a fifth of all, one to a twelfth."""
    return (f"CASE WHEN {k} % 11 = 0 THEN concat('Solo', floor({k} / 20)::INT) ELSE concat('{longer}Line', {k} % 12, ' Ward', floor({k} / 4)::INT, ' Berth', floor({k} / 24)::INT, "
            f"CASE WHEN {k} % 5 = 0 THEN ' North Trading' ELSE '' END) END")


def _site(k: str, first: str) -> str:
    return f"CASE WHEN {k} % 3 = 0 THEN NULL ELSE concat('{first}', CASE WHEN {k} % 3 = 1 THEN '' ELSE 'mail.' END, 'r', floor({k} / 8)::INT, '.example') END"


@query("resolved_candidates", f"""WITH
s AS (SELECT c_custkey AS run_id, name, domain, {_tok_sql('name')} AS t FROM (SELECT c_custkey, {_varied('c_custkey', '')} AS name, {_site('c_custkey', '')} AS domain FROM customer)),
h AS (SELECT p_partkey AS cid, name, domain, {_tok_sql('name')} AS t FROM (SELECT p_partkey, {_varied('p_partkey', 'The ')} AS name, {_site('p_partkey', 'WWW.')} AS domain FROM part)),
p AS (SELECT run_id, cid::VARCHAR AS candidate_id, h.name, len(list_intersect(s.t, h.t))::DOUBLE / least(len(s.t), len(h.t)) AS ns,
  CASE WHEN s.domain IS NULL OR h.domain IS NULL THEN 0 WHEN s.domain = substr(h.domain, 5) THEN 1 WHEN array_to_string(string_split(s.domain, '.')[-2:], '.') = array_to_string(string_split(h.domain, '.')[-2:], '.') THEN 0.8 ELSE 0 END::DOUBLE AS ds FROM s, h),
a AS (SELECT run_id, candidate_id, name, round(ns, 4) AS name_score, round(ds, 4) AS domain_score, round(0.6 * ns + 0.4 * ds, 4) AS overall_score FROM p WHERE round(0.6 * ns + 0.4 * ds, 4) >= 0.4
  UNION ALL SELECT run_id, '', name, 1.0, CASE WHEN domain IS NULL THEN 0.0 ELSE 1.0 END, CASE WHEN domain IS NULL THEN 0.6 ELSE 1.0 END FROM s)
SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY overall_score DESC, candidate_id) AS rank FROM a""")
def resolved_candidates(spark, sf_dir):
    subs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.expr(_varied("c_custkey", "")).alias("company_name"), F.expr(_site("c_custkey", "")).alias("domain"))
    hints = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("candidate_id"), F.expr(_varied("p_partkey", "The ")).alias("name"), F.expr(_site("p_partkey", "WWW.")).alias("domain"))
    ranked, _status = resolve.resolve_entities(subs, hints)
    return ranked.select("run_id", "candidate_id", "name", "name_score", "domain_score", "overall_score", "rank")


# Orders as court dockets and exclusions of companies.
def _hits(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        F.col("o_custkey").alias("run_id"), F.when(k % 2 == 0, "bankruptcy").otherwise("federal_civil").alias("kind"), k.alias("pos"),
        F.when(k % 3 == 0, F.concat(company(F.col("o_custkey")), F.lit(", et al."))).when(k % 3 == 1, F.concat(F.lit("Big "), company(F.col("o_custkey")), F.lit(" Realty"))).otherwise("Someone Else").alias("caseName"),
        F.lit("11").alias("chapter"), F.lit("Court").alias("court"), F.concat(F.lit("c"), (k % 4).cast("string")).alias("court_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("dateFiled"),
        F.when(k % 5 == 0, "2001-01-01").alias("dateTerminated"), F.when(k % 7 != 0, F.concat(F.lit("n"), (k % 50).cast("string"))).alias("docketNumber"), k.alias("docket_id"),
        F.lit("").alias("suitNature"), F.when(k % 4 == 1, F.array(F.lit("Bob"), company(F.col("o_custkey")))).alias("party"))


HITS_SQL = f"""
hit AS (SELECT o_custkey AS run_id, CASE WHEN o_orderkey % 2 = 0 THEN 'bankruptcy' ELSE 'federal_civil' END AS kind, o_orderkey AS pos, o_orderkey AS k, {company_sql('o_custkey')} AS co,
  o_orderdate::DATE AS filed, o_orderkey % 3 AS cap, CASE WHEN o_orderkey % 7 <> 0 THEN 'n' || o_orderkey % 50 END AS num, 'c' || o_orderkey % 4 AS court FROM orders),
uni AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, kind, court, coalesce(num, '#' || pos) ORDER BY pos) AS n FROM hit) WHERE n = 1)"""


@query("unique_dockets", f"WITH {HITS_SQL} SELECT run_id, k AS docket_id FROM uni")
def unique_dockets(spark, sf_dir):
    return public_records.unique_dockets(_hits(spark, sf_dir)).select("run_id", "docket_id")


@query("bankruptcy_records", f"""WITH {HITS_SQL},
b AS (SELECT *, CASE WHEN cap = 0 THEN 'strong' ELSE 'weak' END AS m, k % 5 = 0 AS closed, date_diff('day', filed, DATE '2002-01-01') <= 1080 AS recent FROM uni WHERE kind = 'bankruptcy' AND cap IN (0, 1)
      AND (cap = 0 OR contains({core_sql("'Big ' || co || ' Realty'")}, {core_sql('co')}))),
e AS (SELECT *, m = 'strong' AND NOT closed AND recent AS needs FROM b),
f AS (SELECT *, CASE WHEN NOT needs OR k % 11 = 0 THEN 'not_needed' WHEN k % 13 = 0 THEN 'unknown' WHEN k % 2 = 0 AND k % 4 = 0 THEN 'fresh' ELSE 'out_of_date' END AS freshness FROM e)
SELECT run_id, k AS docket_id, CASE WHEN freshness IN ('unknown', 'out_of_date') THEN 'weak' ELSE m END AS match,
  CASE WHEN closed OR (needs AND k % 11 = 0) THEN 'closed' ELSE 'open' END AS status, freshness FROM f""")
def bankruptcy_records(spark, sf_dir):
    k = F.col("o_orderkey")
    details = table(spark, sf_dir, "orders").select(
        k.alias("docket_id"), F.when(k % 11 == 0, "2001-12-01").alias("date_terminated"), F.when(k % 4 == 0, "2001-11-01").otherwise("2000-01-01").alias("date_last_filing"),
        F.when((k % 13 == 0) & (k % 11 != 0), "timeout").otherwise("success").alias("outcome"))
    out = public_records.bankruptcy_records(submissions(spark, sf_dir), _hits(spark, sf_dir), details, AS_OF)
    return out.select("run_id", "docket_id", "match", "status", "freshness")


@query("civil_records", f"""WITH {HITS_SQL}
SELECT run_id, k AS docket_id, CASE WHEN k % 4 = 1 OR (cap = 0 AND {core_sql("co || ', et al.'")} = {core_sql('co')}) THEN 'strong' ELSE 'weak' END AS match FROM uni WHERE kind = 'federal_civil'""")
def civil_records(spark, sf_dir):
    return public_records.civil_records(submissions(spark, sf_dir), _hits(spark, sf_dir)).select("run_id", "docket_id", "match")


def _exclusions(spark, sf_dir):
    k = F.col("p_partkey")
    alias = F.when(k % 3 == 0, F.concat(company(k + 1), F.lit(" (AKA); Old "), company(k), F.lit(" | ")))
    day = F.date_add(F.lit("1999-01-01").cast("date"), (k % 900).cast("int"))
    none = F.lit("")
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("S"), k.cast("string")).alias("sam_number"), F.when(k % 10 == 7, "Individual").otherwise("Firm").alias("classification"), company(k).alias("name"),
        none.alias("first"), none.alias("last"), text.core_name(company(k)).alias("core_name"), none.alias("city"), pick(("TX", "CA", "", "NY"), k % 4).alias("state"),
        pick(("USA", "US", "DEU"), k % 3).alias("country"), none.alias("uei"), none.alias("cage"), none.alias("exclusion_program"), none.alias("excluding_agency"),
        none.alias("exclusion_type"), day.alias("active_date"), F.when(k % 5 != 0, F.date_add(day, 1000)).alias("termination_date"), (k % 5 == 0).alias("termination_indefinite"),
        alias.alias("cross_reference"))


EXCL_SQL = f"""
ex AS (SELECT p_partkey AS k, 'S' || p_partkey AS sam_number, {core_sql(company_sql('p_partkey'))} AS core, (['TX', 'CA', '', 'NY'])[p_partkey % 4 + 1] AS state, (['USA', 'US', 'DEU'])[p_partkey % 3 + 1] AS country,
  DATE '1999-01-01' + (p_partkey % 900)::INT AS active, CASE WHEN p_partkey % 5 <> 0 THEN DATE '1999-01-01' + (p_partkey % 900)::INT + 1000 END AS ended FROM part),
al AS (SELECT DISTINCT sam_number, alias FROM (SELECT sam_number, {core_sql(company_sql('k + 1') + " || '  '")} AS alias FROM ex WHERE k % 3 = 0 UNION ALL SELECT sam_number, {core_sql("'Old ' || " + company_sql('k'))} FROM ex WHERE k % 3 = 0)),
st AS (SELECT run_id, {core_sql('company_name')} AS core, CASE WHEN billing_address IS NOT NULL THEN nullif((['TX', 'CA', '', 'NY'])[k % 4 + 1], '') END AS mine FROM sub)"""


@query("exclusion_aliases", f"WITH {SUBS_SQL},{EXCL_SQL} SELECT sam_number, alias FROM al")
def exclusion_aliases(spark, sf_dir):
    return public_records.explode_aliases(_exclusions(spark, sf_dir))


@query("exclusion_matches", f"""WITH {SUBS_SQL},{EXCL_SQL},
h AS (SELECT run_id, mine, sam_number, max(w) AS matched_on FROM (SELECT run_id, mine, sam_number, 'name' AS w FROM st JOIN ex USING (core) UNION ALL SELECT run_id, mine, sam_number, 'alias' FROM st JOIN al ON alias = core) GROUP BY ALL),
r AS (SELECT run_id, sam_number, matched_on, CASE WHEN k % 10 <> 7 AND mine IS NOT NULL AND state = mine AND country IN ('USA', 'US') THEN 'strong' ELSE 'weak' END AS match,
  CASE WHEN ended < DATE '2002-01-01' THEN 'terminated' ELSE 'active' END AS status, mine IS NOT NULL AND state <> '' AND state <> mine AS state_conflict, active FROM h JOIN ex USING (sam_number)),
q AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY match = 'weak', active DESC, sam_number) AS rank, count(*) OVER (PARTITION BY run_id) AS total FROM r)
SELECT run_id, sam_number, matched_on, match, status, state_conflict, rank, total FROM q""")
def exclusion_matches(spark, sf_dir):
    ex = _exclusions(spark, sf_dir)
    nothing = producers.free_email_evidence(submissions(spark, sf_dir), AS_OF)
    subs = public_records.with_state(submissions(spark, sf_dir), nothing)
    out = public_records.exclusion_matches(subs, ex, public_records.explode_aliases(ex), AS_OF)
    return out.select("run_id", "sam_number", "matched_on", "match", "status", "state_conflict", "rank", "total")


def _mentions(spark, sf_dir):
    """Orders as people named by a company: the first half declared, the rest from the registry."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    rows = o.select(
        F.col("o_custkey").alias("run_id"), (k % 2).cast("int").alias("origin"), k.alias("pos"), F.concat(pick(GIVEN, k % 3), F.lit(" "), pick(FAMILY, k % 2)).alias("name"),
        F.when(k % 3 == 0, "owner").otherwise("officer").alias("relationship"), F.when(k % 4 == 0, "director").alias("role"),
        F.when(k % 5 == 0, "1970").when(k % 5 == 1, "1970-02").when(k % 5 == 2, "1971").alias("dob"), F.when(k % 7 == 0, "US").alias("nationality"), F.when(k % 6 == 0, 25.0).alias("ownership_pct"),
        F.when(k % 2 == 0, "declared").otherwise("registry").alias("source"), none.alias("provider"), none.alias("locator"))
    return rows.filter("origin = 0"), rows.filter("origin = 1")


_NAME_KEY = f"lower({sql_pick(GIVEN[:3], 'o_orderkey % 3')} || ' ' || {sql_pick(FAMILY[:2], 'o_orderkey % 2')})"


@query("merged_people", f"""WITH RECURSIVE m AS (SELECT o_custkey AS run_id, {_NAME_KEY} AS nk, CASE o_orderkey % 5 WHEN 0 THEN '1970' WHEN 1 THEN '1970-02' WHEN 2 THEN '1971' ELSE '' END AS dob,
  row_number() OVER (PARTITION BY o_custkey, {_NAME_KEY} ORDER BY o_orderkey % 2, o_orderkey) AS i FROM orders),
f AS (SELECT run_id, nk, 1 AS i, [dob] AS people, [1] AS cnt FROM m WHERE i = 1
 UNION ALL SELECT run_id, nk, i, CASE WHEN hit_at > 0 THEN list_transform(people, lambda p, j: CASE WHEN j = hit_at AND p = '' THEN dob ELSE p END) ELSE list_append(people, dob) END,
   CASE WHEN hit_at > 0 THEN list_transform(cnt, lambda c, j: CASE WHEN j = hit_at THEN c + 1 ELSE c END) ELSE list_append(cnt, 1) END
 FROM (SELECT f.run_id, f.nk, m.i, m.dob, people, cnt, coalesce(list_position(list_transform(people, lambda p: p = '' OR m.dob = '' OR starts_with(p, m.dob) OR starts_with(m.dob, p)), true), 0) AS hit_at
       FROM f JOIN m ON m.run_id = f.run_id AND m.nk = f.nk AND m.i = f.i + 1)),
l AS (SELECT run_id, nk, arg_max(people, i) AS people, arg_max(cnt, i) AS cnt FROM f GROUP BY ALL)
SELECT run_id, nk AS person_key, unnest(people) AS dob, unnest(cnt) AS n_sources FROM l""")
def merged_people(spark, sf_dir):
    return people.merge_people(*_mentions(spark, sf_dir)).select("run_id", "person_key", F.coalesce("dob", F.lit("")).alias("dob"), F.size("sources").alias("n_sources"))


@query("linked_people", f"""WITH m AS (SELECT o_custkey AS run_id, o_custkey % 100 AS entity_id, {_NAME_KEY} AS nk, arg_min(CASE o_orderkey % 5 WHEN 0 THEN '1970' WHEN 1 THEN '1970-02' WHEN 2 THEN '1971' ELSE '' END, o_orderkey) AS dob FROM orders GROUP BY ALL),
k AS (SELECT s_suppkey AS sid, s_suppkey % 100 AS entity_id, lower({sql_pick(GIVEN[:3], 's_suppkey % 3')} || ' ' || {sql_pick(FAMILY[:2], 's_suppkey % 2')}) AS nk, CASE WHEN s_suppkey % 4 = 0 THEN '1971-05' ELSE '' END AS dob FROM supplier)
SELECT run_id, m.nk AS person_key, min(sid) AS known_subject FROM m LEFT JOIN k ON k.entity_id = m.entity_id AND k.nk = m.nk AND (k.dob = '' OR m.dob = '' OR starts_with(k.dob, m.dob) OR starts_with(m.dob, k.dob)) GROUP BY ALL""")
def linked_people(spark, sf_dir):
    o, s = table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier")
    k, n = F.col("o_orderkey"), F.col("s_suppkey")
    dob = F.when(k % 5 == 0, "1970").when(k % 5 == 1, "1970-02").when(k % 5 == 2, "1971").otherwise("")
    name = F.concat(pick(GIVEN, k % 3), F.lit(" "), pick(FAMILY, k % 2))
    found = o.groupBy(F.col("o_custkey").alias("run_id"), name.alias("name")).agg(F.nullif(F.min_by(dob, k), F.lit("")).alias("dob")).withColumns({
        "person_key": people.person_key(F.col("name")), "nationality": F.lit(None).cast("string"), "relationships": F.array(F.lit("officer")),
        "person_id": F.concat_ws("|", "run_id", "name")})
    known = s.select((n % 100).alias("entity_id"), n.alias("subject_id"), F.concat(pick(GIVEN, n % 3), F.lit(" "), pick(FAMILY, n % 2)).alias("name"),
                     F.when(n % 4 == 0, "1971-05").alias("dob"), F.lit(AS_OF).cast("timestamp").alias("created_at"))
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), (F.col("c_custkey") % 100).alias("entity_id"))
    linked, _new = people.link_people(found, known, runs)
    return linked.select("run_id", "person_key", F.when(~F.col("is_new"), F.col("subject_id").cast("long")).alias("known_subject"))


@query("ownership_proofs", """
SELECT o_orderkey AS challenge_id, CASE o_orderkey % 3 WHEN 0 THEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey % 1000 = o_orderkey % 1000 AND l_partkey % 50 = o_custkey % 50)
  WHEN 1 THEN o_custkey % 4 = 0 ELSE o_totalprice > 200000 END AS proved FROM orders""")
def ownership_proofs(spark, sf_dir):
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    k = F.col("o_orderkey")
    token = F.concat(F.lit("t"), (F.col("o_custkey") % 50).cast("string"), F.lit("x"))
    challenges = o.select(k.alias("challenge_id"), k.alias("run_id"), (k % 1000).alias("domain"), pick(("dns_txt", "html_meta", "email"), k % 3).alias("method"),
                          F.when(k % 3 == 1, F.concat(F.lit("w"), (k % 1000).cast("string"), F.when(F.col("o_custkey") % 4 == 0, "").otherwise("no"))).otherwise(token).alias("token"))
    txt = li.select((F.col("l_orderkey") % 1000).alias("domain"), F.concat(F.lit('"'), F.lit(ownership.TXT_PREFIX), F.lit("t"), (F.col("l_partkey") % 50).cast("string"), F.lit('x"')).alias("value")).distinct()
    pages = o.select((k % 1000).alias("domain")).distinct().select(
        "domain", F.concat(F.lit(f"<html><meta name='{ownership.META_NAME}' content='w"), F.col("domain").cast("string"), F.lit("'></html>")).alias("html"), F.lit(1).alias("fetched_at"))
    mail = o.filter("o_totalprice > 200000").select(k.alias("challenge_id"), token.alias("token"))
    return ownership.verify_ownership(challenges, txt, pages, mail).select("challenge_id", "proved")
