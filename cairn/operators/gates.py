"""Which records an index analyses, and what it keeps of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Beginnings of the types that each analyser takes. Fixed values.
ANALYSERS = {"html": ("text", "application/xhtml+xml"), "xml": ("application/xml", "text/xml"), "pdf": ("application/pdf",)}


def parsed(mime: Column, excluded: tuple[str, ...] = ()) -> Column:
    """Whether a body of this type is parsed at all: it has a type, in which none of the excluded patterns is."""
    out = mime.isNotNull()
    for pattern in excluded:
        out = out & ~F.coalesce(mime.rlike(pattern), F.lit(False))
    return out


def taken_by(mime: Column, analyser: str) -> Column:
    """Whether an analyser of ANALYSERS takes a body of this type."""
    out = F.lit(False)
    for start in ANALYSERS[analyser]:
        out = out | F.coalesce(F.startswith(mime, F.lit(start)), F.lit(False))
    return out


def empty_answer(record_type: Column, served: Column, length: Column) -> Column:
    """Whether a response is an API's that came back without a body."""
    return F.coalesce((record_type == "response") & (length == 0) & F.startswith(F.lower(F.trim(served)), F.lit("application/json")), F.lit(False))


def last_modified(created: Column, stated: Column, modified: Column) -> Column:
    """The time of a document's last change: as the file says, else as its metadata say, else when it was made; empty values don't count."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in (modified, stated, created)])


def with_stored_text(docs: DataFrame, keep: Column | bool = True, stored: Column | bool = True) -> DataFrame:
    """docs with content as an index takes it: none unless keep, and in the column text, which is searched but not shown, unless stored."""
    keep, stored = (x if isinstance(x, Column) else F.lit(x) for x in (keep, stored))
    content = F.when(F.coalesce(keep, F.lit(False)), F.col("content"))
    return docs.withColumn("text", F.when(~stored, content)).withColumn("content", F.when(stored, content))


def without_revisits(docs: DataFrame) -> DataFrame:
    """docs in which revisits have no length (theirs is of nothing) and no content, and the type that was served as their type."""
    again = F.lower("record_type") == "revisit"
    first = {c: F.when(~again, F.col(c)).alias(c) for c in ("content_length", "content") if c in docs.columns}
    typed = {"content_type": F.when(again, F.col("content_type_served")).otherwise(F.col("content_type")).alias("content_type")}
    return docs.select(*[{**first, **typed}.get(c, F.col(c)) for c in docs.columns])


def memento(docs: DataFrame, integers: tuple[str, ...] = ("content_length", "status_code")) -> DataFrame:
    """docs as flat records: of lists the first value, whole numbers where they are such, empty texts as null, times as 14 digits."""
    kinds = dict(docs.dtypes)

    def one(c: str) -> Column:
        value = F.get(F.col(c), F.lit(0)) if kinds[c].startswith("array") else F.col(c)
        if c in integers:
            return value.cast("string").try_cast("long").alias(c)
        if kinds[c] in ("timestamp", "timestamp_ntz"):
            return F.date_format(value, "yyyyMMddHHmmss").alias(c)
        return F.nullif(value.cast("string"), F.lit("")).alias(c)

    return docs.select(*map(one, docs.columns))


def posts_with_media(posts: DataFrame, media: DataFrame, key: str) -> DataFrame:
    """posts without their raw payloads, with the files of their media in order; media: (key, position, file)."""
    files = media.where("file IS NOT NULL").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "file"))), lambda x: x["file"]).alias("media_files"))
    return posts.drop("raw").join(files, key, "left").withColumn("media_files", F.coalesce("media_files", F.array().cast("array<string>")))
