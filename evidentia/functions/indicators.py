"""Indicators in texts: defanged spellings restored, then addresses, names, hashes and numbers found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings that hide an indicator, in the order in which they are undone.
DEFANGED = [(r"\[\s*\.\s*\]", "."), (r"\(\s*\.\s*\)", "."), (r"\{\s*\.\s*\}", "."), (r"\[\s*:\s*\]", ":"), (r"\bhxxp(s?)\b", "http$1"), (r"\bmeow(s?)\b(?=://)", "http$1"), (r"\[\s*at\s*\]", "@"), (r"\[\s*dot\s*\]", ".")]
# What an indicator looks like, and the words before a number that make it a version.
CVE, URL, HASH = r"\bCVE-\d{4}-\d{4,7}\b", r"\bhttps?://[^\s<>\"'\)\]]+", r"\b[0-9a-fA-F]{32,128}\b"
IPV4, DOMAIN = r"\b(?:\d{1,3}\.){3}\d{1,3}(?:/\d{1,2})?\b", r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,24}\b"
VERSION = r"(?:version|ver\.?|v|release|firmware|build|patch|update|prior to|before|through|upgrade to|fixed in)\s*"
HASHES = {32: "md5", 40: "sha1", 64: "sha256", 128: "sha512"}
# File endings that look like a top-level domain, and domains that texts cite.
FILE_ENDINGS = """
exe dll sys bin dat log txt md pdf doc docx xls xlsx ppt pptx csv json xml yaml yml
zip tar gz bz2 7z rar iso img png jpg jpeg gif svg webp mp4 avi
py js ts jsx tsx java c cpp h hpp go rs rb php sh ps1 bat cmd
conf cfg ini toml env lock sql db sqlite html htm css scss
""".split()
CITED = """
cisa.gov nvd.nist.gov nist.gov mitre.org attack.mitre.org cve.mitre.org
hhs.gov fda.gov cert.org us-cert.gov first.org
github.com microsoft.com google.com apache.org kb.cert.org
""".split()


def refang(text: Column) -> Column:
    return reduce(lambda t, rule: F.regexp_replace(t, f"(?i){rule[0]}", rule[1]), DEFANGED, text)


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _named(kind, values: Column) -> Column:
    """Structs of a kind (or of a value's own) and the value."""
    return F.transform(values, lambda v: F.struct((kind(v) if callable(kind) else F.lit(kind)).alias("kind"), v.alias("value")))


def cves(text: Column) -> Column:
    found = F.transform(_found(text, f"(?i){CVE}"), lambda v: F.upper(v))
    return _named("cve", F.filter(found, lambda v: F.substr(v, F.lit(5), F.lit(4)).cast("int").between(1999, 2100)))


def urls(text: Column) -> Column:
    return F.transform(_found(text, f"(?i){URL}"), lambda v: F.regexp_replace(v, "[.,;:]+$", ""))


def hosts(text: Column) -> Column:
    """The lower-case hosts of the text's URLs."""
    return F.transform(urls(text), lambda v: F.lower(F.regexp_replace(F.regexp_replace(v, "(?i)^https?://", ""), "[/:].*$", "")))


def hashes(text: Column) -> Column:
    kind = lambda v: F.element_at(F.create_map(*[F.lit(x) for kv in HASHES.items() for x in kv]), F.length(v))
    return _named(kind, F.filter(F.transform(_found(text, HASH), lambda v: F.lower(v)), lambda v: F.length(v).isin(list(HASHES))))


def addresses(text: Column) -> Column:
    """IPv4 addresses and blocks; a number that a version word stands before is taken with it, and dropped."""
    octets = lambda v: F.split(F.regexp_replace(v, "/.*$", ""), "[.]")
    bad = lambda o: ((F.length(o) > 1) & o.startswith("0")) | (o.cast("int") > 255)
    found = F.filter(_found(text, f"(?i)(?:{VERSION})?{IPV4}"), lambda v: F.regexp_like(v, F.lit("^[0-9]")))
    return _named("ipv4", F.filter(found, lambda v: ~F.exists(octets(v), bad)))


def domains(text: Column) -> Column:
    """Domains that are neither file names, nor cited, nor hosts of the text's URLs."""
    found = F.transform(_found(text, DOMAIN), lambda v: F.lower(v))
    plain = F.filter(found, lambda v: ~F.regexp_replace(v, r"^.*\.", "").isin(FILE_ENDINGS) & ~v.isin(CITED))
    return _named("domain", F.array_except(plain, hosts(text)))


def indicators(text: Column) -> Column:
    """Distinct structs (kind, value) of a text that is refanged already."""
    return F.array_distinct(F.concat(cves(text), _named("url", urls(text)), hashes(text), addresses(text), domains(text)))
