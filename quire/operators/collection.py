"""Small relational operators over the tables of a collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def items_of_type(manifest: DataFrame, prefix: str) -> DataFrame:
    """The items whose media type begins with ``prefix``."""
    return manifest.where(F.startswith("media_type", F.lit(prefix)))


def linear_items(spine: DataFrame) -> DataFrame:
    return spine.where("linear")


def without_items(spine: DataFrame, gone: DataFrame) -> DataFrame:
    """The spine without the items ``gone`` (book_id, idref), renumbered."""
    kept = spine.join(gone.select("book_id", "idref").distinct(), ["book_id", "idref"], "left_anti")
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("book_id").orderBy("pos")) - 1).select(*spine.columns)


def put_references(guide: DataFrame, new: DataFrame) -> DataFrame:
    """The guide with the references ``new`` (book_id, ref_type, title, href) in place of those of their
    types, at the end; of two new ones of a type the one first by address counts."""
    one = new.groupBy("book_id", "ref_type").agg(F.min_by(F.struct("title", "href"), "href").alias("r"))
    kept = guide.join(one, ["book_id", "ref_type"], "left_anti").select("book_id", "pos", "ref_type", "title", "href")
    rows = kept.unionByName(one.select("book_id", F.lit(1 << 30).alias("pos"), "ref_type", "r.title", "r.href"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("book_id").orderBy("pos", "ref_type")) - 1)


def totals(manifest: DataFrame) -> DataFrame:
    """``book_id``, ``n_items``, ``n_images`` and the bytes of both: ``item_bytes``, ``image_bytes``."""
    size = F.coalesce(F.octet_length("text"), F.octet_length("data"), F.lit(0)).cast("long")
    image = F.startswith(F.coalesce("media_type", F.lit("")), F.lit("image/"))
    return manifest.groupBy("book_id").agg(
        F.count("*").alias("n_items"), F.count_if(image).alias("n_images"), F.sum(size).alias("item_bytes"), F.sum(F.when(image, size).otherwise(0)).alias("image_bytes")
    )


def decoded(raw: Column) -> Column:
    """Bytes as text: by their mark (UTF-8, UTF-16), as UTF-8 if they are that, else as Windows-1252."""
    mark = lambda n: F.hex(F.substring(raw, 1, n))
    rest = lambda at: F.substring(raw, F.lit(at), F.octet_length(raw))
    even = lambda b: F.substring(b, F.lit(1), F.octet_length(b) - F.octet_length(b) % 2)
    return (
        F.when(mark(3) == "EFBBBF", F.coalesce(F.try_validate_utf8(rest(4).cast("string")), F.decode(rest(4), "windows-1252")))
        .when(mark(2) == "FEFF", F.decode(even(rest(3)), "UTF-16BE"))
        .when(mark(2) == "FFFE", F.decode(even(rest(3)), "UTF-16LE"))
        .otherwise(F.coalesce(F.try_validate_utf8(raw.cast("string")), F.decode(raw, "windows-1252")))
    )
