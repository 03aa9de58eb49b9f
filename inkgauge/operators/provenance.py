"""Audit of provenance markers: they are counted and told, never removed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and markers as the formats write them.
META_NAMES = r"generator|provenance|c2pa(?:[.:][\w.\-]+)?|ai-generated|ai:generated|digitalSourceType|iptc:digitalSourceType|creds|contentcredentials"
LINK_KINDS = "provenance|c2pa|content-credentials|describedby"
ASCII_MARKERS = ("c2pa", "c2pa.claim", "c2pa.assertion", "jumb", "jumbf", "c2pc")
HTML_META = rf"(?i)<meta\b[^>]*(?:name|property)\s*=\s*['\"](?:{META_NAMES})['\"][^>]*>"
HTML_LINK = rf"(?i)<link\b[^>]*rel\s*=\s*['\"](?:{LINK_KINDS})['\"][^>]*>"
JSON_LD = r"(?is)<script[^>]+type=['\"]application/ld\+json['\"][^>]*>.*?</script>"
XMP = r"(?is)<\?xpacket begin=.*?<\?xpacket end=['\"]w['\"]\s*\?>"


def html_meta(c: Column) -> Column:
    return F.regexp_count(c, F.lit(HTML_META))


def html_link(c: Column) -> Column:
    return F.regexp_count(c, F.lit(HTML_LINK))


def json_ld(c: Column) -> Column:
    """Blocks of linked data that speak of provenance, in any case."""
    blocks = F.regexp_extract_all(c, F.lit(JSON_LD), F.lit(0))
    told = lambda b: F.lower(b).rlike("c2pa|contentcredentials|digitalsourcetype|prov:")
    return F.size(F.filter(blocks, told))


def xmp_packets(c: Column) -> Column:
    return F.regexp_count(c, F.lit(XMP))


def markers(c: Column) -> Column:
    """Which ASCII markers occur, in any case; they are present, whatever a tool may say of them."""
    return F.array_compact(F.array(*[F.when(F.contains(F.lower(c), F.lit(m)), m) for m in ASCII_MARKERS]))


def suffix_kind(path: Column) -> Column:
    """What a file is by its name."""
    end = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(end.isin("html", "htm"), "html").when(end.isin("jpg", "jpeg", "png", "webp", "tif", "tiff"), "image").when(end == "pdf", "pdf").when(end.isin("md", "markdown", "txt", "rst", "org"), "text").otherwise("other")
