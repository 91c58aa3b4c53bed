"""Struct fields with protobuf tags, and their uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import globs
from . import symbols as S


def proto_name(tag: Column) -> Column:
    """The ``name=`` part of a raw or quoted tag's protobuf key; null if it has none."""
    bare = F.regexp_extract(tag, r"^(?:`([^`]*)`|\"(.*)\")$", 1)
    inner = F.when(tag.startswith("`"), bare).otherwise(F.regexp_replace(F.regexp_extract(tag, r"^\"(.*)\"$", 1), r"\\\\\"", "\""))
    key = F.regexp_extract(inner, r"(?:^|\s)protobuf:\"([^\"]*)\"", 1)
    return F.when(key.rlike(r"(?:^|,)name="), F.regexp_extract(key, r"(?:^|,)name=([^,]*)", 1))


def fields(struct_fields: DataFrame, package_glob: str = "") -> DataFrame:
    """proto_message, proto_field, go_field, pkg_path, struct_qname, field_qname, obj_id of exported tagged fields."""
    rows = struct_fields.where(F.col("exported")).where(globs.package_glob(F.col("pkg_path"), package_glob)).withColumn("proto_field", proto_name(F.col("tag")))
    return rows.where("proto_field is not null").select(
        F.regexp_extract("struct_qname", r"([^./]*)\z", 1).alias("proto_message"), "proto_field", "go_field", "pkg_path", "struct_qname",
        F.concat_ws(".", "struct_qname", "go_field").alias("field_qname"), "obj_id", "load_order",
    )


def field_of(found: DataFrame, message: str, field: str) -> DataFrame:
    """The first field loaded that has the message and, as proto or Go name, the field."""
    rows = found.where((F.col("proto_message") == message) & ((F.col("proto_field") == field) | (F.col("go_field") == field)))
    return S.first_by(rows, ["proto_message"], [F.col("load_order"), F.col("field_qname")])


def uses_of(field: DataFrame, uses: DataFrame, package_glob: str = "") -> DataFrame:
    """file, line, col of the workspace's uses of the field's object."""
    from .. import model

    rows = uses.where(F.col("tier_rank") == model.WORKSPACE).where(globs.package_glob(F.col("pkg_path"), package_glob))
    return rows.join(field.select("obj_id"), "obj_id", "left_semi").select("file", "line", "col").distinct()
