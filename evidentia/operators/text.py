"""Text operators that have no plain SQL spelling: chunks for scoring, and IPv6 addresses."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP = 500, 80
IPV6 = r"\b(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}\b"


def chunks(docs: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, paragraph, place, chunk): paragraphs, those beyond ``size`` packed from sentences.

    A packed chunk begins with the last ``overlap`` characters of the one before it.  The carry runs
    inside one row's array, so the packing stays in the JVM.  Blank or null texts give no rows.
    """
    blank = F.expr(r"filter(transform(split(text, r'\n\s*\n'), p -> trim(BOTH '\n\t\r ' FROM p)), p -> p <> '')")
    paragraphs = docs.where("text is not null").select("doc_id", F.posexplode(blank).alias("paragraph", "body"))
    packed = F.expr(
        rf"""CASE WHEN length(body) <= {size} THEN array(body) ELSE aggregate(
          filter(split(body, r'(?<=[.!?])\s+'), s -> trim(s) <> ''),
          named_struct('done', slice(array(body), 1, 0), 'cur', ''),
          (a, s) -> CASE WHEN a.cur <> '' AND length(a.cur) + length(trim(s)) + 1 > {size}
            THEN named_struct('done', concat(a.done, array(a.cur)), 'cur', concat(right(a.cur, {overlap}), ' ', trim(s)))
            WHEN a.cur <> '' THEN named_struct('done', a.done, 'cur', concat(a.cur, ' ', trim(s)))
            ELSE named_struct('done', a.done, 'cur', trim(s)) END,
          a -> CASE WHEN a.cur <> '' THEN concat(a.done, array(a.cur)) ELSE a.done END) END"""
    )
    return paragraphs.select("doc_id", "paragraph", F.posexplode(packed).alias("place", "chunk"))


def ipv6(docs: DataFrame) -> DataFrame:
    """(doc_id, value) of the distinct valid IPv6 addresses in each text, in their shortest form.

    Colons alone are punctuation, not an address.

    Candidates are found in the JVM; only texts that have any go through the Arrow-batched parser.
    """

    @F.pandas_udf("array<string>")
    def valid(found: pd.Series) -> pd.Series:
        def parse(values):
            out = set()
            for v in values:
                if not v.strip(":"):
                    continue
                try:
                    out.add(ipaddress.IPv6Address(v).compressed)
                except ValueError:
                    continue
            return sorted(out)

        return found.map(parse)

    found = F.regexp_extract_all("text", F.lit(IPV6), F.lit(0))
    some = docs.where("text is not null").select("doc_id", found.alias("found")).where(F.size("found") > 0)
    return some.select("doc_id", F.explode(valid("found")).alias("value")).distinct()
