"""The queries over the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treegate.functions.udfs import sample_library
from treegate.operators.filtering import parse
from treegate.plans.arrow import register_format
from treegate.sources import proto

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: What a query returns of each table.
KEYS = {
    "lineitem": ["l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"],
    "orders": ["o_orderkey", "o_orderpriority"],
    "part": ["p_partkey", "p_size", "p_brand"],
    "customer": ["c_custkey", "c_name", "c_mktsegment"],
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "events": ["event_id", "event_type", "props"],
    "documents": ["doc_id"],
    "embeddings": ["vec_id"],
}
#: Columns that the grammar sees; dates have no label, so grammars over all fields leave them out.
_NO_LABEL = {"l_shipdate", "o_orderdate", "ts"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _typed(key: str, name: str, grammar: str, where: str, functions=None, columns: list[str] | None = None, **derived: str) -> None:
    """A grammar over a table's rows, with further columns by name, and its predicate in SQL."""
    keys = columns or KEYS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, name).withColumns({c: F.expr(sql) for c, sql in derived.items()})
        return parse(grammar, functions).filter(df.drop(*_NO_LABEL)).select(*keys)

    QUERIES[key] = run
    ORACLES[key] = f"select {', '.join(keys)} from {name} where {where}"


# comparisons
_typed("eq_int", "lineitem", ".l_linenumber == 1", "l_linenumber = 1")
_typed("eq_string", "lineitem", '.l_returnflag == "R"', "l_returnflag = 'R'")
_typed("ne_string", "lineitem", '.l_returnflag != "R"', "l_returnflag <> 'R'")
_typed("lt_double", "lineitem", ".l_quantity < double(10)", "l_quantity < 10")
_typed("le_double", "lineitem", ".l_quantity <= double(10)", "l_quantity <= 10")
_typed("gt_double", "lineitem", ".l_quantity > double(45)", "l_quantity > 45")
_typed("ge_double", "lineitem", ".l_quantity >= double(45)", "l_quantity >= 45")
_typed("ge_int", "part", ".p_size >= 25", "p_size >= 25")
# strings
_typed("prefix", "orders", '.o_orderpriority ^= "1"', "starts_with(o_orderpriority, '1')")
_typed("suffix", "orders", '.o_orderpriority $= "LOW"', "ends_with(o_orderpriority, 'LOW')")
_typed("substr", "orders", '.o_orderpriority *= "GENT"', "contains(o_orderpriority, 'GENT')")
_typed("regex", "part", '.p_brand ~= "[12]$"', "regexp_matches(p_brand, '[12]$')")
_typed("lower", "customer", '.c_mktsegment->eq(toLower($string), "building")', "lower(c_mktsegment) = 'building'")
_typed("upper", "customer", '.c_mktsegment->eq(toUpper($string), "BUILDING")', "upper(c_mktsegment) = 'BUILDING'")
_typed("length_str", "documents", ".text->gt(length($string), 5000)", "length(text) > 5000")
# lists, types, logic
_typed("length_list", "lineitem", ".l_linenumber->eq($int, length([]int{1,2}))", "l_linenumber = 2")
_typed("elem_list", "lineitem", ".l_linenumber->eq($int, elem([]int{1,3},1))", "l_linenumber = 3")
_typed("member", "lineitem", '.l_returnflag->contains($string, []string{"R","A"})', "l_returnflag in ('R', 'A')")
_typed("type_double", "events", ".value :: $double", "value is not null")
_typed("type_mismatch", "events", ".value :: $int", "false")
_typed("expr_and", "part", ".p_size->and(ge($int,10), lt($int,20))", "p_size >= 10 and p_size < 20")
_typed("expr_or", "part", ".p_size->or(lt($int,5), gt($int,45))", "p_size < 5 or p_size > 45")
_typed("expr_not", "part", ".p_size->not(lt($int,25))", "not p_size < 25")
# wide filters
_typed("wide_or", "part", "(" + "|".join(f".p_size == {i}" for i in range(1, 50, 2)) + ")", "p_size % 2 = 1 and p_size < 50")
_typed("wide_not", "part", "!((" + "|".join(f".p_size == {i}" for i in range(1, 50, 2)) + "))", "not (p_size % 2 = 1 and p_size < 50)")
_typed("wide_and", "lineitem", "(" + "&".join(f".c{i} == {i}" for i in range(1, 13)) + ")", "l_linenumber = 1", **{f"c{i}": f"l_linenumber * {i}" for i in range(1, 13)})
_typed("wide_interleave", "lineitem", "{" + ";".join(f"c{i} == {i}" for i in range(1, 13)) + ";(_:*)*}", "l_linenumber = 1", **{f"c{i}": f"l_linenumber * {i}" for i in range(1, 13)})
# booleans
_BIG = {"big": "p_size > 25"}
_typed("eq_bool", "part", ".big == true", "p_size > 25", **_BIG)
_typed("ne_bool", "part", ".big != true", "p_size <= 25", **_BIG)
_typed("bool_variable", "part", ".big->not($bool)", "p_size <= 25", **_BIG)
_typed("bool_and", "part", ".big->and($bool, true)", "p_size > 25", **_BIG)
_typed("elem_bools", "part", ".big->eq($bool, elem([]bool{true,false},1))", "p_size <= 25", **_BIG)
_typed("type_bool", "part", ".big :: $bool", "true", **_BIG)
# unsigned numbers
_U = {"u": "cast(l_linenumber as decimal(20,0))"}
_typed("eq_uint", "lineitem", ".u == uint(3)", "l_linenumber = 3", **_U)
_typed("ne_uint", "lineitem", ".u != uint(3)", "l_linenumber <> 3", **_U)
_typed("order_uint", "lineitem", ".u->and(gt($uint, uint(1)), le($uint, uint(3)))", "l_linenumber in (2, 3)", **_U)
_typed("member_uint", "lineitem", ".u->contains($uint, []uint{uint(1),uint(4)})", "l_linenumber in (1, 4)", **_U)
_typed("elem_uints", "lineitem", ".u->eq($uint, elem([]uint{uint(1),uint(4)},1))", "l_linenumber = 4", **_U)
_typed("type_uint", "lineitem", ".u :: $uint", "true", **_U)
# doubles and ints in lists
_typed("eq_double", "lineitem", ".l_quantity == double(17)", "l_quantity = 17")
_typed("elem_doubles", "lineitem", ".l_quantity->eq($double, elem([]double{double(1),double(17)},1))", "l_quantity = 17")
_typed("member_int", "lineitem", ".l_linenumber->contains($int, []int{2,5})", "l_linenumber in (2, 5)")
_typed("lengths_of_lists", "lineitem", ".l_linenumber->eq($int, length([]bool{true,false,true}))", "l_linenumber = 3")
# bytes
_BRAND = ",".join(str(x) for x in b"Brand#2")
_B = {"code": "encode(p_brand, 'UTF-8')"}
_typed("eq_bytes", "part", f".code == []byte{{{_BRAND}}}", "p_brand = 'Brand#2'", **_B)
_typed("ne_bytes", "part", f".code != []byte{{{_BRAND}}}", "p_brand <> 'Brand#2'", **_B)
_typed("order_bytes", "part", f".code->and(ge($[]byte, []byte{{{_BRAND}}}), lt($[]byte, []byte{{{_BRAND[:-2]}52}}))", "p_brand >= 'Brand#2' and p_brand < 'Brand#4'", **_B)
_typed("length_bytes", "part", ".code->gt(length($[]byte), 7)", "octet_length(encode(p_brand)) > 7", **_B)
_typed("elem_bytes", "part", f".code->eq($[]byte, elem([][]byte{{[]byte{{1}},[]byte{{{_BRAND}}}}},1))", "p_brand = 'Brand#2'", **_B)
_typed("type_bytes", "part", ".code :: $[]byte", "true", **_B)
_typed("type_string", "part", ".p_brand :: $string", "p_brand is not null")
# patterns
_typed("pat_and", "lineitem", '(.l_returnflag == "R" & .l_quantity > double(45))', "l_returnflag = 'R' and l_quantity > 45")
_typed("pat_or", "lineitem", '(.l_returnflag == "R" | .l_quantity > double(45))', "l_returnflag = 'R' or l_quantity > 45")
_typed("pat_not", "lineitem", '!(.l_returnflag == "R")', "l_returnflag <> 'R' or l_returnflag is null")
_typed("concat", "region", '[r_regionkey:*, r_name == "ASIA"]', "r_name = 'ASIA'")
_typed("concat_wrong_order", "region", "[r_name:*, r_regionkey:*]", "false")
_typed("interleave", "region", '{r_name == "ASIA"; r_regionkey:*}', "r_name = 'ASIA'")
_typed("interleave_missing", "nation", "{n_name:*; n_regionkey:*}", "false")
_typed("contains_sequence", "nation", '.[n_nationkey >= 5, n_regionkey == 1]', "n_nationkey >= 5 and n_regionkey = 1")
_typed("star", "embeddings", ".embedding:(_:->lt($double, double(0.2)))*", "len(list_filter(embedding, lambda x: x >= 0.2::float)) = 0")
_typed("optional", "region", "[r_regionkey:*, r_name:*, (zzz:*)?]", "true")
_typed("exists_array", "embeddings", ".embedding._ > double(0.3)", "len(list_filter(embedding, lambda x: x > 0.3::double)) > 0")
_typed("index_array", "embeddings", ".embedding.0 > double(0)", "embedding[1] > 0")
_typed("sequence_array", "embeddings", ".embedding:[_ > double(0), _ < double(0), *]", "embedding[1] > 0 and embedding[2] < 0")
_typed("empty", "region", "<empty>", "false")
_typed("any", "region", "*", "true")
_typed("never", "region", "!(*)", "false")
_typed("name_any", "customer", '._ == "BUILDING"', "c_mktsegment = 'BUILDING' or c_name = 'BUILDING'")
_typed("name_not", "customer", '.!(c_name) == "BUILDING"', "c_mktsegment = 'BUILDING'")
_typed("name_choice", "customer", '.(c_name|c_mktsegment) == "BUILDING"', "c_name = 'BUILDING' or c_mktsegment = 'BUILDING'")
_typed("ref", "orders", '#main = .o_orderpriority:@u  #u = ^= "1"', "starts_with(o_orderpriority, '1')")
_typed("err_abort", "customer", '._ ^= "Cust"', "false")
# user functions
_PRIMES = ", ".join(str(n) for n in range(2, 51) if all(n % d for d in range(2, n)))
_typed("udf_prime", "part", ".p_size->isPrime($int)", f"p_size in ({_PRIMES})", sample_library())
_typed("udf_inc", "part", ".p_size->eq(inc($int), 26)", "p_size = 25", sample_library())
_typed("udf_concat", "part", '.p_brand->eq(concat($string, "!"), "Brand#1!")', "p_brand = 'Brand#1'", sample_library())


_typed("udf_falls_through", "part", ".p_size->eq(length($int), 2)", "p_size >= 10", sample_library().register("length", ["int"], "int", lambda x: len(str(x)), column=lambda c: F.length(c.cast("string")).cast("long")))
_typed("udf_without_column", "part", '(.p_size->odd($int) & .p_brand == "Brand#2")', "p_size % 2 = 1 and p_brand = 'Brand#2'", sample_library().register("odd", ["int"], "bool", lambda x: x % 2 == 1))


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _json(key: str, grammar: str, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return parse(grammar).filter(table(spark, sf_dir, "events").select(*KEYS["events"]), on="props", format="json")

    QUERIES[key] = run
    ORACLES[key] = f"select {', '.join(KEYS['events'])} from events where {where}"


_K = "cast(json_extract(props, '$.k') as bigint)"
_json("json_eq", ".k > 50", f"{_K} > 50")
_json("json_exact", "k > 50", f"{_K} > 50")
_json("json_not", "!(.k > 50)", f"not {_K} > 50")


def _orders_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order and its lines as one JSON text."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("flag"))).alias("lines"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.select("o_orderkey", F.to_json(F.struct(F.struct(F.col("o_orderpriority").alias("priority")).alias("head"), "lines")).alias("body"))


@query
def json_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse('.head.priority == "1-URGENT"').filter(_orders_json(spark, sf_dir), on="body", format="json").select("o_orderkey")


ORACLES["json_nested"] = "select o_orderkey from orders where o_orderpriority = '1-URGENT' and o_orderkey in (select l_orderkey from lineitem)"


@query
def json_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse('.lines:(_:{n:*; flag == "N"})*').filter(_orders_json(spark, sf_dir), on="body", format="json").select("o_orderkey")


ORACLES["json_array"] = "select l_orderkey as o_orderkey from lineitem where l_orderkey in (select o_orderkey from orders) group by 1 having bool_and(l_returnflag = 'N')"


@query
def typed_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same nesting as typed columns: structs and arrays as predicates."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("flag"))).alias("lines"))
    return parse('.lines._:{n:*; flag == "R"}').filter(lines).select("l_orderkey")


ORACLES["typed_nested"] = "select distinct l_orderkey from lineitem where l_returnflag = 'R'"


@query
def json_recursion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of n_regionkey links that ends in a leaf."""
    chain = F.concat(F.expr("repeat('{\"next\":', n_regionkey)"), F.lit('{"leaf":'), F.col("n_nationkey") % 2, F.lit("}"), F.expr("repeat('}', n_regionkey)"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", chain.alias("body"))
    return parse("#main = (.leaf == 1 | .next:@main)").filter(nations, on="body", format="json").select("n_nationkey")


ORACLES["json_recursion"] = "select n_nationkey from nation where n_nationkey % 2 = 1"


@query
def xml_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").withColumn("body", F.concat(F.lit("<r><a>"), "n_regionkey", F.lit("</a></r>")))
    return parse("r:a == 1").filter(nations, on="body", format="xml").select(*KEYS["nation"])


ORACLES["xml_leaf"] = "select n_nationkey, n_name, n_regionkey from nation where n_regionkey = 1"


def nation_descriptors() -> bytes:
    """A FileDescriptorSet of one message: nation.Nation with key (uint64), name (string) and region (int32)."""
    fields = b""
    for number, (name, kind) in enumerate((("key", proto.UINT64_T), ("name", proto.STRING_T), ("region", proto.INT32_T)), 1):
        f = proto.encode_field(1, proto.STRING_T, name) + proto.encode_field(3, proto.INT32_T, number) + proto.encode_field(4, proto.INT32_T, 1) + proto.encode_field(5, proto.INT32_T, kind)
        fields += proto.encode_field(2, proto.MESSAGE_T, f)
    message = proto.encode_field(1, proto.STRING_T, "Nation") + fields
    file = proto.encode_field(1, proto.STRING_T, "nation.proto") + proto.encode_field(2, proto.STRING_T, "nation") + proto.encode_field(4, proto.MESSAGE_T, message)
    return proto.encode_field(1, proto.MESSAGE_T, file)


@query
def proto_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    # keys under 128 and names under 128 bytes: one-byte numbers
    body = F.concat(F.unhex(F.lit("08")), F.unhex(F.lpad(F.hex("n_nationkey"), 2, "0")), F.unhex(F.lit("12")), F.unhex(F.lpad(F.hex(F.length("n_name")), 2, "0")), F.encode("n_name", "UTF-8"), F.unhex(F.lit("18")), F.unhex(F.lpad(F.hex("n_regionkey"), 2, "0")))
    nations = table(spark, sf_dir, "nation").withColumn("body", body)
    grammar = parse("(.region == 1 & .key >= uint(5))")
    return grammar.filter(nations, on="body", format="protobuf", descriptors=nation_descriptors(), message="nation.Nation").select(*KEYS["nation"])


ORACLES["proto_leaf"] = "select n_nationkey, n_name, n_regionkey from nation where n_regionkey = 1 and n_nationkey >= 5"


@query
def xml_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements in elements, with a prolog, comments and attributes, which give no node, and numbers as ints."""
    text = F.concat(F.lit('<?xml version="1.0"?><!-- all --><r id="7"><n key="1"><name>'), "n_name", F.lit("</name><!-- then --><region><![CDATA["), "n_regionkey", F.lit("]]></region></n><n><name>x</name></n></r>"))
    nations = table(spark, sf_dir, "nation").withColumn("body", text)
    return parse("r:[n:[name:*, region >= 2], n:name == \"x\"]").filter(nations, on="body", format="xml").select(*KEYS["nation"])


ORACLES["xml_nested"] = "select n_nationkey, n_name, n_regionkey from nation where n_regionkey >= 2"


def _hex(c: F.Column, bytes_: int = 1) -> F.Column:
    """Little-endian hex digits of a number under 256."""
    return F.concat(F.lpad(F.hex(c), 2, "0"), F.lit("00" * (bytes_ - 1)))


def _message(name: str, fields: list[tuple]) -> bytes:
    """A DescriptorProto: fields are (name, number, type, repeated[, type name])."""
    out = proto.encode_field(1, proto.STRING_T, name)
    for field, number, kind, repeated, *of in fields:
        f = proto.encode_field(1, proto.STRING_T, field) + proto.encode_field(3, proto.INT32_T, number) + proto.encode_field(4, proto.INT32_T, 3 if repeated else 1) + proto.encode_field(5, proto.INT32_T, kind)
        out += proto.encode_field(2, proto.MESSAGE_T, f + b"".join(proto.encode_field(6, proto.STRING_T, x) for x in of))
    return out


def _descriptors(*messages: bytes) -> bytes:
    file = proto.encode_field(1, proto.STRING_T, "map.proto") + proto.encode_field(2, proto.STRING_T, "map") + b"".join(proto.encode_field(4, proto.MESSAGE_T, m) for m in messages)
    return proto.encode_field(1, proto.MESSAGE_T, file)


@query
def proto_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested messages in a repeated field, whose runs between other fields are nodes of their own."""
    nation = F.concat(F.lit("08"), _hex(F.col("n_nationkey")), F.lit("12"), _hex(F.length("n_name")), F.hex(F.encode("n_name", "UTF-8")))
    sent = F.concat(F.lit("1A"), _hex(F.length(nation) / 2), nation)
    nations = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(sent)).alias("sent"))
    # all nations but the first, the name, then the first: two runs
    body = F.concat(F.array_join(F.slice("sent", F.lit(2), F.size("sent")), ""), F.lit("12"), _hex(F.length("r_name")), F.hex(F.encode("r_name", "UTF-8")), F.element_at("sent", 1))
    regions = table(spark, sf_dir, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey")).withColumn("body", F.unhex(body))
    given = _descriptors(_message("Nation", [("key", 1, proto.INT32_T, False), ("name", 2, proto.STRING_T, False)]), _message("Region", [("name", 2, proto.STRING_T, False), ("nations", 3, proto.MESSAGE_T, True, ".map.Nation")]))
    how = {"on": "body", "format": "protobuf", "descriptors": given, "message": "map.Region"}
    grammars = {"in_first_run": "[nations:._:.key == 7, name:*, nations:0:*]", "in_some_run": ".nations:._:.key == 7", "shape": "[nations:(_:{key:*;name:*})*, name:*, nations:0:*]"}
    for name, text in grammars.items():
        regions = parse(text).validate(regions, name, **how)
    return regions.select("r_regionkey", *grammars)


ORACLES["proto_repeated"] = """
with n as (select n_regionkey, n_nationkey, row_number() over (partition by n_regionkey order by length(n_name), n_nationkey) as place, count(*) over (partition by n_regionkey) as many from nation)
select r_regionkey, bool_or(n_nationkey = 7 and place > 1) as in_first_run, bool_or(n_nationkey = 7) as in_some_run, min(many) > 1 as shape
from region join n on r_regionkey = n_regionkey group by 1
"""


@query
def proto_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field of each wire form: zigzag, fixed, float, double, bool, bytes and packed numbers."""
    k = F.col("n_regionkey")
    parts = ["08", _hex(k * 2), "15", _hex(k, 4), "19", _hex(k, 8), "25", "0000C03F", "29", "000000000000F83F", "30", _hex(k % 2), "3A", "02", "FF", _hex(k), "42", "03", _hex(k), "01", "02"]
    body = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    nations = table(spark, sf_dir, "nation").withColumn("body", F.unhex(body))
    kinds = [("zig", 1, proto.SINT32_T, False), ("four", 2, proto.FIXED32_T, False), ("eight", 3, proto.SFIXED64_T, False), ("float", 4, proto.FLOAT_T, False), ("double", 5, proto.DOUBLE_T, False), ("flag", 6, proto.BOOL_T, False), ("raw", 7, proto.BYTES_T, False), ("packed", 8, proto.UINT32_T, True)]
    grammar = parse("[zig >= 2, four >= uint(2), eight >= 2, float_:*, double_:*, flag == true, raw == []byte{255,3}, packed:[0 == uint(3), 1 == uint(1), 2 == uint(2)]]".replace("float_:*", '"float" == double(1.5)').replace("double_:*", '"double" == double(1.5)'))
    return grammar.filter(nations, on="body", format="protobuf", descriptors=_descriptors(_message("Scalars", kinds)), message="map.Scalars").select(*KEYS["nation"])


ORACLES["proto_scalars"] = "select n_nationkey, n_name, n_regionkey from nation where n_regionkey = 3"


def _pairs(text: str) -> list:
    """A format of one's own: "name=number;name=number"."""
    return [(("string", name), [(("int", int(value)), [])]) for name, value in (x.split("=") for x in text.split(";"))]


@query
def own_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads in a format that the caller brings."""
    register_format("pairs", _pairs)
    nations = table(spark, sf_dir, "nation").withColumn("body", F.concat(F.lit("key="), "n_nationkey", F.lit(";region="), "n_regionkey"))
    return parse("{region == 1; key >= 5}").filter(nations, on="body", format="pairs").select(*KEYS["nation"])


ORACLES["own_format"] = "select n_nationkey, n_name, n_regionkey from nation where n_regionkey = 1 and n_nationkey >= 5"


def _by_engine(key: str, engine: str) -> None:
    """JSON records by another engine than plans use."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return parse("!(.k <= 50)").filter(table(spark, sf_dir, "events").select(*KEYS["events"]), on="props", format="json", engine=engine)

    QUERIES[key] = run
    ORACLES[key] = f"select {', '.join(KEYS['events'])} from events where {_K} > 50"


_by_engine("engine_derivative", "derivative")
_by_engine("engine_shared_derivative", "shared derivative")
_by_engine("engine_automaton", "automaton")


@query
def json_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of JSON value, an unreadable label and a broken text, as a validity column."""
    k = F.col("n_nationkey") % 6
    values = ["true", "1.5", '"a\\u0062"', "null", '[1,{"b":[]}]', "{broken"]
    value = F.element_at(F.array(*map(F.lit, values)), k.cast("int") + 1)
    nations = table(spark, sf_dir, "nation").withColumn("body", F.concat(F.lit('{"v":'), value, F.lit("}")))
    grammar = parse('(v == true|(v == double(1.5)|(v == "ab"|(v:<empty>|v:[_ == 1, _:b:<empty>]))))')
    some = parse('.v ^= "a"').validate(grammar.validate(nations, "all", on="body", format="json"), "prefix", on="body", format="json")
    return some.select("n_nationkey", F.col("all").alias("all_kinds"), "prefix")


ORACLES["json_kinds"] = """select n_nationkey, case when n_nationkey % 6 < 5 then true end as all_kinds, case when n_nationkey % 6 < 5 then n_nationkey % 6 = 2 end as prefix from nation"""


@query
def typed_recursion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recursive grammar over nested structs: as deep as the schema."""
    nations = table(spark, sf_dir, "nation").withColumn("next", F.expr("named_struct('leaf', 0, 'next', named_struct('leaf', n_regionkey, 'next', cast(null as int)))"))
    return parse("#main = (.leaf == 1 | .next:@main)").filter(nations).select(*KEYS["nation"])


ORACLES["typed_recursion"] = "select n_nationkey, n_name, n_regionkey from nation where n_regionkey = 1"


@query
def validate_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse('.r_name == "ASIA"').validate(table(spark, sf_dir, "region")).select("r_regionkey", "valid")


ORACLES["validate_col"] = "select r_regionkey, r_name = 'ASIA' as valid from region"


@query
def row_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed frame through the automaton instead of predicates."""
    part = table(spark, sf_dir, "part")
    return part.filter(parse(".p_size >= 25").plan(part, how="automaton").column).select(*KEYS["part"])


ORACLES["row_automaton"] = "select p_partkey, p_size, p_brand from part where p_size >= 25"


@query
def compose_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = parse(".l_quantity > double(45)").filter(table(spark, sf_dir, "lineitem"))
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("n"))


ORACLES["compose_agg"] = "select l_returnflag, count(*) as n from lineitem where l_quantity > 45 group by 1"


@query
def streaming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, filtered by a JSON grammar into files of the shared folder."""
    from treegate.shared import shared_folder
    from treegate.streaming.filtering import filter_to_files, read_stream

    schema = table(spark, sf_dir, "events").schema
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = read_stream(spark, sf_dir, schema, pathGlobFilter="events.parquet")
    filter_to_files(parse(".k > 50"), stream, f"{at}/kept", f"{at}/checkpoint", on="props", format="json").awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/kept").select(*KEYS["events"])


ORACLES["streaming"] = f"select {', '.join(KEYS['events'])} from events where {_K} > 50"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines."""
    return QUERIES["eq_string"](spark, os.fspath(sf_dir))
