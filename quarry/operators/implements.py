"""Interface satisfaction as relational division."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import globs


def implementers(method_sets: DataFrame, iface_methods: DataFrame, types: DataFrame, interfaces: DataFrame) -> DataFrame:
    """iface (type_id), type_id: concrete types whose value or pointer method set has all methods.

    Candidates of an interface are the types that have its rarest method; the other methods are checked
    on those, and the matches are counted against the required number.  So what is joined follows the
    rarest methods, not the common ones.  The pointer's method set holds the value's, so one count of the
    union decides.  Interfaces without methods are satisfied by every concrete type.
    """
    wanted = iface_methods.join(interfaces.select("type_id").distinct(), "type_id", "left_semi").select(F.col("type_id").alias("iface"), "name", "signature").distinct()
    need = wanted.groupBy("iface").agg(F.count("*").alias("need"))
    own = method_sets.select("type_id", "name", "signature").distinct()
    concrete = types.where(~F.col("is_interface")).select("type_id").distinct()
    own = own.join(wanted.select("name", "signature").distinct(), ["name", "signature"], "left_semi").join(concrete, "type_id", "left_semi")
    held = wanted.join(own.groupBy("name", "signature").agg(F.count("*").alias("types")), ["name", "signature"], "left")
    rarest = held.groupBy("iface").agg(F.min(F.struct(F.coalesce("types", F.lit(0)).alias("types"), "name", "signature")).alias("r")).select("iface", "r.name", "r.signature")
    candidates = own.join(rarest, ["name", "signature"]).select("iface", "type_id")
    met = candidates.join(wanted, "iface").join(own, ["type_id", "name", "signature"], "left_semi").groupBy("iface", "type_id").agg(F.count("*").alias("got"))
    full = met.join(need, "iface").where("got = need").select("iface", "type_id")
    free = interfaces.select(F.col("type_id").alias("iface")).distinct().join(need, "iface", "left_anti")
    return full.select("iface", "type_id").unionByName(free.crossJoin(concrete).select("iface", "type_id"))


def implementations(facts: dict[str, DataFrame], iface_qname: str, package_glob: str = "", scope: str | None = None) -> DataFrame:
    """Symbol hits of the types that satisfy an interface; only types in the symbol table."""
    from .symbols import HIT

    hits = implementing_types(facts, iface_qname, package_glob, scope)
    return facts["symbols"].join(hits.select("qname").distinct(), "qname", "left_semi").select(*HIT)


def implementing_types(facts: dict[str, DataFrame], iface_qname: str, package_glob: str = "", scope: str | None = None, loaded: bool = False) -> DataFrame:
    """qname, pkg_path, file, line, col of the satisfying types themselves (structural search)."""
    types = facts["named_types"]
    iface = types.where((F.col("qname") == iface_qname) & F.col("is_interface"))
    rank = globs.in_loaded_scope if loaded else globs.in_scope
    inside = types.where(rank(F.col("tier_rank"), scope)).where(globs.package_glob(F.col("pkg_path"), package_glob))
    found = implementers(facts["method_sets"], facts["iface_methods"], inside, iface)
    return inside.join(found.select("type_id"), "type_id", "left_semi").select("qname", "pkg_path", "file", "line", "col").distinct()
