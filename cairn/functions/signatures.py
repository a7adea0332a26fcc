"""Formats told by their first and last bytes, as column expressions.

A signature is a pattern in hexadecimal with ?? for any byte, at an offset from
the start or before the end; a format may need several, and may take precedence
over others, as a document in a ZIP does over ZIP. Only the first and last bytes
of a body are looked at, once for all formats.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes at either end that are looked at.
REACH = 1024


@dataclass(frozen=True)
class Mark:
    """Bytes at one of the offsets from least to most: from the start, or with end before the last byte."""

    bytes: str
    least: int = 0
    most: int = 0
    end: bool = False

    def pattern(self) -> str:
        """A regular expression over hexadecimal text, in which every byte is two digits."""
        own = "".join("[0-9A-F]{2}" if b == "??" else b.upper() for b in (self.bytes[i : i + 2] for i in range(0, len(self.bytes), 2)))
        gap = f"(?:[0-9A-F]{{2}}){{{self.least},{self.most}}}" if self.most else ""
        return f"{own}{gap}$" if self.end else f"^{gap}{own}"


@dataclass(frozen=True)
class Format:
    name: str
    mime: str
    marks: tuple[Mark, ...]
    over: tuple[str, ...] = ()


#: Formats by the signatures that their specifications give. Fixed values.
FORMATS = (
    Format("pdf", "application/pdf", (Mark("255044462D", 0, 1019),)),
    Format("png", "image/png", (Mark("89504E470D0A1A0A"),)),
    Format("jpeg", "image/jpeg", (Mark("FFD8FF"),)),
    Format("gif87a", "image/gif", (Mark("474946383761"),)),
    Format("gif89a", "image/gif", (Mark("474946383961"),)),
    Format("tiff", "image/tiff", (Mark("49492A00"),)),
    Format("tiff-be", "image/tiff", (Mark("4D4D002A"),)),
    Format("riff", "application/octet-stream", (Mark("52494646"),)),
    Format("webp", "image/webp", (Mark("52494646????????57454250"),), ("riff",)),
    Format("wav", "audio/x-wav", (Mark("52494646????????57415645"),), ("riff",)),
    Format("mp4", "video/mp4", (Mark("66747970", 4, 4),)),
    Format("ogg", "audio/ogg", (Mark("4F676753"),)),
    Format("mp3", "audio/mpeg", (Mark("494433"),)),
    Format("zip", "application/zip", (Mark("504B0304"),)),
    Format("epub", "application/epub+zip", (Mark("504B0304"), Mark("6D696D65747970656170706C69636174696F6E2F657075622B7A6970", 30, 30)), ("zip",)),
    Format("gzip", "application/gzip", (Mark("1F8B08"),)),
    Format("warc", "application/warc", (Mark("574152432F"),)),
    Format("rtf", "application/rtf", (Mark("7B5C727466"), Mark("7D", 0, 4, end=True))),
    Format("xml", "application/xml", (Mark("3C3F786D6C", 0, 3),)),
    Format("xhtml", "application/xhtml+xml", (Mark("3C3F786D6C", 0, 3), Mark("687474703A2F2F7777772E77332E6F72672F313939392F7868746D6C", 20, 500)), ("xml",)),
)


def matches(body: Column, formats: Sequence[Format] = FORMATS, reach: int = REACH) -> Column:
    """Names of the formats whose signatures a body has, without those that another of them takes precedence over."""
    data = body.cast("binary")
    head = F.hex(F.substring(data, 1, reach))
    tail = F.hex(F.substring(data, F.greatest(F.octet_length(data) - reach + 1, F.lit(1)), F.lit(reach)))

    def has(f: Format) -> Column:
        tests = [(tail if m.end else head).rlike(m.pattern()) for m in f.marks]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    found = F.array_compact(F.array(*[F.when(has(f), F.lit(f.name)) for f in formats]))
    weaker = F.create_map(*[x for f in formats for x in (F.lit(f.name), F.array(*map(F.lit, f.over)).cast("array<string>"))])
    return F.array_except(found, F.flatten(F.transform(found, lambda n: weaker[n])))


def identified(body: Column, served: Column, formats: Sequence[Format] = FORMATS) -> Column:
    """struct(format, mime, by): the format of the type that was served if its signature is there, else the first found; null without any."""
    mimes = F.create_map(*[F.lit(x) for f in formats for x in (f.name, f.mime)])
    found = matches(body, formats)
    plain = F.lower(F.trim(F.split_part(F.coalesce(served, F.lit("")), F.lit(";"), F.lit(1))))
    agreed = F.get(F.filter(found, lambda n: mimes[n] == plain), F.lit(0))
    name = F.coalesce(agreed, F.get(found, F.lit(0)))
    return F.when(name.isNotNull(), F.struct(name.alias("format"), mimes[name].alias("mime"), F.when(agreed.isNotNull(), "served").otherwise("signature").alias("by")))
