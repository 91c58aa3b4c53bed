"""Facts made from the driver's star-schema tables: an analogue that exercises the operators at scale.

The mapping is deterministic and uses whole tables.  It proves the algebra, not Go semantics; those
come from ``source_tree``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import globs

KINDS = ("func", "method", "type", "var", "const")


class DriverFacts(dict):
    """Fact tables by name, each made on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __missing__(self, name: str) -> DataFrame:
        self[name] = getattr(self, f"_{name}")()
        return self[name]

    def _packages(self) -> DataFrame:
        n = self.table("nation")
        region = F.col("n_regionkey")
        rank = F.when(region == 0, 4).when(region == 1, 3).when(region == 2, 2).when(region == 3, 1).otherwise(0)
        return n.select(
            F.concat(F.lit("example.com/r"), region, F.lit("/n"), F.col("n_nationkey")).alias("pkg_path"),
            F.lit("regular").alias("variant"),
            F.when(region < 3, F.concat(F.lit("example.com/r"), region)).alias("module_path"),
            (region == 0).alias("module_main"),
            (region == 2).alias("module_indirect"),
            globs.tier_label(rank).alias("tier"), rank.alias("tier_rank"), F.col("n_nationkey").cast("int").alias("load_order"),
        )

    def _imports(self) -> DataFrame:
        p = self["packages"]
        a, b = p.select(F.col("pkg_path").alias("src_pkg"), F.col("load_order").alias("i")), p.select(F.col("pkg_path").alias("dst_pkg"), F.col("load_order").alias("j"))
        pairs = a.withColumn("j", F.explode(F.array(F.pmod(F.col("i") * 2 + 1, F.lit(25)), F.pmod(F.col("i") * 3 + 5, F.lit(25))))).where("i % 4 <> 3")
        return pairs.join(b, "j").select("src_pkg", "dst_pkg", F.lit("").alias("alias"))

    def _symbols(self) -> DataFrame:
        part, pkg = self.table("part"), self["packages"].select("pkg_path", "tier", "tier_rank", "load_order")
        key = F.col("p_partkey")
        rows = part.join(F.broadcast(pkg), (key % 25).cast("int") == pkg["load_order"])  # a package a nation: 25
        return rows.select(
            F.concat(F.lit("p"), key).alias("obj_id"),
            F.element_at(F.array(*map(F.lit, KINDS)), (key % 5 + 1).cast("int")).alias("kind"),
            F.concat(F.lit("m/"), key % 7, F.lit("."), F.col("p_name")).alias("qname"),
            F.col("p_name").alias("sname"), "pkg_path",
            F.concat(F.col("pkg_path"), F.lit("/"), F.col("p_brand"), F.lit(".go")).alias("file"),
            F.col("p_size").alias("line"), (key % 80 + 1).cast("int").alias("col"), "tier", "tier_rank", key.cast("int").alias("load_order"),
        )

    def _placed(self) -> DataFrame:
        """Line items with the package of the customer's nation."""
        pkg = self["packages"].select("pkg_path", "tier_rank", F.col("load_order").alias("n"))
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        customer = self.table("customer").select("c_custkey", "c_nationkey").join(F.broadcast(pkg), F.col("c_nationkey") == F.col("n")).drop("n")
        return self.table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))

    def _uses(self) -> DataFrame:
        return self["placed"].select(
            F.concat(F.lit("p"), F.col("l_partkey")).alias("obj_id"), F.concat(F.lit("o"), F.col("l_orderkey"), F.lit(".go")).alias("file"),
            F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("int").alias("col"), "pkg_path", "tier_rank", F.lit(True).alias("resolved"),
        )

    def _ast_nodes(self) -> DataFrame:
        part = self.table("part").select("p_partkey", "p_name")
        callee = F.concat(F.lit("m/"), F.col("p_partkey") % 7, F.lit("."), F.col("p_name"))
        rows = self["placed"].join(part, F.col("l_partkey") == F.col("p_partkey"))
        return rows.select(
            F.when(F.col("l_returnflag") == "R", "typeassert").otherwise("call").alias("kind"), "pkg_path",
            F.concat(F.lit("o"), F.col("l_orderkey"), F.lit(".go")).alias("file"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("int").alias("col"),
            F.col("l_suppkey").cast("int").alias("visit_seq"), callee.alias("callee_qname"), (F.col("l_suppkey") % 4).cast("int").alias("n_args"),
            (F.col("p_partkey") % 5 == 2).alias("fun_is_type"), callee.alias("target_qname"), (F.col("l_linestatus") == "O").alias("target_is_ptr"),
            F.concat(F.lit("c"), F.col("o_custkey")).alias("enclosing_fn"), "tier_rank",
        )

    def _idents(self) -> DataFrame:
        return self["uses"].select(
            "file", "line", "col", (F.col("col") + 2 + F.substring("obj_id", 2, 9).cast("int") % 9).alias("end_col"), "obj_id",
            F.concat(F.lit("local."), F.col("obj_id")).alias("qname"), F.lit("var").alias("kind"), F.lit(False).alias("is_def"),
        )

    def _call_edges(self) -> DataFrame:
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        line = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"))
        file = F.concat(F.lit("o"), F.col("l_orderkey"), F.lit(".go")).alias("file")
        one = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), F.col("o_custkey")), F.concat(F.lit("p"), F.col("l_partkey")), file, "l_linenumber", "q", F.lit("static"))
        two = line.select(F.concat(F.lit("p"), F.col("l_partkey")), F.concat(F.lit("s"), F.col("l_suppkey")), file, "l_linenumber", "q", F.lit("static"))
        # A supplier calls the functions of two customers, found by key, which closes cycles.
        calls = self.table("supplier").select("s_suppkey", F.explode(F.array(F.col("s_suppkey") * 13, F.col("s_suppkey") * 7 + 1)).alias("c_custkey"))
        back = calls.join(self.table("customer").select("c_custkey"), "c_custkey", "left_semi")
        three = back.select(F.concat(F.lit("s"), F.col("s_suppkey")), F.concat(F.lit("c"), F.col("c_custkey")), F.lit("back.go"), F.lit(1), F.lit(1), F.lit("static"))
        return one.union(two).union(three).toDF("caller", "callee", "file", "line", "col", "dispatch")

    def _named_types(self) -> DataFrame:
        """Customers are concrete types; iface0 to iface3, and one of each supplier, are interfaces."""
        pkg = self["packages"].select("pkg_path", "tier_rank", "load_order")
        c = self.table("customer").join(F.broadcast(pkg), F.col("c_nationkey") == F.col("load_order"))
        concrete = c.select(F.concat(F.lit("t"), F.col("c_custkey")), F.concat(F.col("pkg_path"), F.lit(".T"), F.col("c_custkey")), "pkg_path", F.lit(False), F.lit("types.go"), F.col("c_custkey").cast("int"), F.lit(6), "tier_rank")
        ifaces = self.spark.range(4).select(F.concat(F.lit("iface"), F.col("id")), F.concat(F.lit("example.com/r0/n0.I"), F.col("id")), F.lit("example.com/r0/n0"), F.lit(True), F.lit("ifaces.go"), F.col("id").cast("int"), F.lit(6), F.lit(4))
        own = self.table("supplier").select(F.concat(F.lit("isup"), F.col("s_suppkey")), F.concat(F.lit("example.com/r0/n0.S"), F.col("s_suppkey")), F.lit("example.com/r0/n0"), F.lit(True), F.lit("sups.go"), F.col("s_suppkey").cast("int"), F.lit(6), F.lit(4))
        return concrete.union(ifaces).union(own).toDF("type_id", "qname", "pkg_path", "is_interface", "file", "line", "col", "tier_rank")

    def _method_sets(self) -> DataFrame:
        """A customer's methods: the types of parts it bought, and the parts; a pointer method where no order key is even."""
        orders, part = self.table("orders").select("o_orderkey", "o_custkey"), self.table("part").select("p_partkey", "p_type")
        rows = self.table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
        rows = rows.select("o_custkey", "l_orderkey", F.explode(F.array("p_type", F.concat(F.lit("M"), F.col("l_partkey")))).alias("name"))
        return rows.groupBy("o_custkey", "name").agg((F.min(F.col("l_orderkey") % 2) == 1).alias("via_pointer")).select(
            F.concat(F.lit("t"), F.col("o_custkey")).alias("type_id"), "via_pointer", "name", F.lit("func()").alias("signature"),
            F.concat(F.lit("(t"), F.col("o_custkey"), F.lit(")."), F.col("name")).alias("fn_qname"),
        )

    def _iface_methods(self) -> DataFrame:
        """iface0: all part types; iface1: those that begin with E or S; iface2: STANDARD alone; iface3: none.

        A supplier's interface: one part, and STANDARD if its key is even.
        """
        names = self.table("part").select(F.col("p_type").alias("name")).distinct()
        kinds = [("iface0", F.lit(True)), ("iface1", F.substring("name", 1, 1).isin("E", "S")), ("iface2", F.col("name") == "STANDARD")]
        parts = [names.where(cond).select(F.lit(k).alias("type_id"), "name", F.lit("func()").alias("signature")) for k, cond in kinds]
        key = F.col("s_suppkey")
        one = F.concat(F.lit("M"), key * 2)
        own = self.table("supplier").select(F.concat(F.lit("isup"), key).alias("type_id"), F.explode(F.when(key % 2 == 0, F.array(one, F.lit("STANDARD"))).otherwise(F.array(one))).alias("name"), F.lit("func()").alias("signature"))
        return parts[0].union(parts[1]).union(parts[2]).union(own)

    def _dyn_sites(self) -> DataFrame:
        """Every supplier calls a part's method through its interface."""
        key = F.col("s_suppkey")
        return self.table("supplier").select(
            F.concat(F.lit("s"), key).alias("caller"), F.concat(F.lit("isup"), key).alias("iface_type_id"),
            F.concat(F.lit("M"), key * 2).alias("method"), F.lit("func()").alias("signature"), F.lit("dyn.go").alias("file"), key.cast("int").alias("line"), F.lit(3).alias("col"),
        )

    def _func_values(self) -> DataFrame:
        """Every customer takes the function of the part of its number as a value."""
        key = F.col("c_custkey")
        return self.table("customer").select(F.concat(F.lit("c"), key).alias("taker"), F.concat(F.lit("p"), key).alias("fn"), F.concat(F.lit("func("), key, F.lit(")")).alias("signature"))

    def _func_sites(self) -> DataFrame:
        """Every supplier calls a value of the signature of three times its number."""
        key = F.col("s_suppkey")
        return self.table("supplier").select(F.concat(F.lit("s"), key).alias("caller"), F.concat(F.lit("func("), key * 3, F.lit(")")).alias("signature"), F.lit("val.go").alias("file"), key.cast("int").alias("line"), F.lit(9).alias("col"))

    def _functions(self) -> DataFrame:
        """Parts are functions; those of one qualified name are its variants, every eleventh is synthetic."""
        key = F.col("p_partkey")
        return self.table("part").select(F.concat(F.lit("p"), key).alias("fn_id"), F.concat(F.lit("m/"), key % 7, F.lit("."), F.col("p_name")).alias("qname"), F.concat(F.lit("v"), key % 3).alias("variant"), (key % 11 == 0).alias("synthetic"))

    def _instantiations(self) -> DataFrame:
        """A customer's function instantiates the type of the customer after it."""
        return self.table("customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("fn"), F.concat(F.lit("t"), F.col("c_custkey") + 1).alias("type_id"))

    def _texts(self) -> DataFrame:
        return self.table("documents").select(F.concat(F.lit("vendor/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".txt")).alias("path"), "text")

    def _struct_fields(self) -> DataFrame:
        key, name = F.col("p_partkey"), F.initcap("p_name")
        snake = F.regexp_replace("p_name", " ", "_")
        tag = F.when(key % 3 == 2, F.lit('`json:"x"`')).otherwise(F.concat(F.lit('`protobuf:"varint,'), key % 9, F.lit(",opt,name="), snake, F.lit(',proto3" json:"a,omitempty"`')))
        pkg = self["packages"].select("pkg_path", "tier_rank", "load_order")
        rows = self.table("part").join(F.broadcast(pkg), (key % 25).cast("int") == pkg["load_order"])
        return rows.select(
            F.concat(F.col("pkg_path"), F.lit(".Msg"), key % 10).alias("struct_qname"), F.regexp_replace(name, " ", "").alias("go_field"), tag.alias("tag"),
            (key % 4 != 3).alias("exported"), F.concat(F.lit("p"), key).alias("obj_id"), "pkg_path", "tier_rank", key.cast("int").alias("load_order"),
        )

    def _fs_events(self) -> DataFrame:
        """Events as file changes: Go files, hidden ones, module files and others."""
        e = self.table("events")
        u = F.col("user_id")
        path = (
            F.when(F.col("event_type") == "click", F.concat(F.lit("pkg/u"), u, F.lit(".go")))
            .when(F.col("event_type") == "view", F.concat(F.lit("docs/u"), u, F.lit(".txt")))
            .when(F.col("event_type") == "error", F.concat(F.lit("pkg/.u"), u, F.lit(".go")))
            .when(F.col("event_type") == "signup", F.lit("go.mod"))
            .otherwise(F.concat(F.lit("vendor/u"), u, F.lit(".go")))
        )
        op = F.when(F.col("event_id") % 7 == 0, "chmod").when(F.col("event_id") % 7 == 1, "create").otherwise("write")
        return e.select(F.col("ts").cast("timestamp").alias("ts"), path.alias("path"), op.alias("op"))
