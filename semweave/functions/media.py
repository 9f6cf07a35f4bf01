"""References to local images as values: a struct whose reserved field name survives nesting, Parquet and SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "__sem_media"
MEDIA = T.StructType([T.StructField(MARK, T.StringType()), T.StructField("path", T.StringType())])
REFERENCE = "sem-media-"


def media(kind: str, source: Column | str | None) -> Column:
    """``media('image', path)``; a null path gives null."""
    if kind != "image":
        raise ValueError("the media type must be 'image'")
    path = F.lit(source) if source is None else F.col(source) if isinstance(source, str) else source
    path = path.cast("string")
    return F.when(path.isNotNull(), F.struct(F.lit(kind).alias(MARK), path.alias("path")))


def is_media(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and kind.names == [MARK, "path"]


def has_media(kind: T.DataType) -> bool:
    if is_media(kind):
        return True
    if isinstance(kind, T.StructType):
        return any(has_media(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return has_media(kind.elementType)
    return False


def reference(value: Column) -> Column:
    """What stands for the image in texts: paths never leave the process, and equal paths are one image."""
    return F.when(value.isNotNull(), F.concat(F.lit(REFERENCE), F.sha2(value.getField("path"), 256)))
