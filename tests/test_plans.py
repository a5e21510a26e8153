"""Predicates over typed frames against the derivative, row by row, and what reaches the scan."""

import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from treegate import GrammarError, RecordError, naive, parse, sample_library
from treegate.plans import planner, symbolic
from treegate.sources.rows import forest_builder

SCHEMA = "a int, b string, c array<int>, d struct<a: bigint, b: string, c: array<string>>, e double, f map<string,int>, g boolean, h decimal(20,0), k binary, l array<struct<a: int, b: string>>"
NAN = float("nan")
ROWS = [
    (1, "x", [1, 2], (1, "x", ["x", "xy"]), 0.5, {"a": 1}, True, Decimal(1), bytearray(b"a"), [(1, "x")]),
    (2, "xy", [], (2, None, []), 2.0, {}, False, Decimal(2**63), bytearray(b""), []),
    (None, None, None, None, None, None, None, None, None, None),
    (3, "", [None, 1], (None, "yx", None), NAN, {"b": 2, "a": 1}, None, None, bytearray(b"\xff"), [None, (2, None)]),
    (1, "yx", [1, 1, 1], (7, "x", [None]), -1.5, {"c": None}, True, Decimal(0), None, [(1, "y"), (2, "x")]),
    (5, "x\ny", [7], (1, "", ["y"]), 1.5, {"a": 2, "b": 1}, False, Decimal(1), bytearray(b"b"), [(None, None)]),
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, SCHEMA).coalesce(1).withColumn("n", F.monotonically_increasing_id())


def expected(grammar, frame):
    build = forest_builder(frame.schema)

    def one(row):
        try:
            return naive.derive(grammar.compiled, build(row)).nullable
        except RecordError:
            return False

    return [one(r.asDict(recursive=True)) for r in frame.orderBy("n").collect()]


FIXED = [
    ".a == 1", ".a != 1", "!(.a == 1)", "!(.a != 1)", ".b == \"x\"", "!(.b == \"x\")", '.b ^= "x"', '!(.b ^= "x")', '(.a == 1 & .b == "x")', '(.a == 1 | .b == "xy")', '!((.a == 1 | .b == "xy"))', '._ == "x"', "._ == 1", '!(._ == "x")',
    "[a:*, b:*, *]", "[a == 1, *]", "[b:*, a:*, *]", "{b:*; a:*; *}", "{a == 1; *}", "(_:*)*", "(_:!(== 1))*", ".a:<empty>", ".a:*", "!(.a:<empty>)", ".e > double(1)", ".e < double(1)", ".e != double(2)", "!(.e > double(1))", ".e >= double(-2)", ".e == double(2)",
    ".c._ == 1", ".c:(_ == 1)*", "!(.c._ == 1)", ".c.0 == 1", ".c.1 == 1", "!(.c.0 == 1)", ".c:[0 == 1, 1 == 2]", ".c:[_ == 1, *]", ".c:<empty>", ".c:(_:*)*", ".c.[_ == 1, _ == 1]", ".c:[*, _ == 1]", ".c:{_ == 1; (_ == 2)?}", ".c.0:<empty>", ".c:[(_ == 1)*, _ > 5]",
    ".d.a == 1", ".d{a == 1; *}", ".d:[a:*, b == \"x\", *]", "!(.d.a == 1)", ".d:<empty>", ".d.c._ == \"x\"", ".d.c._ ^= \"x\"", ".d.c:(_ ^= \"x\")*", ".d:!(.b == \"x\")", ".f.a == 1", ".f.(a|b) == 1", ".f._ == 2", ".f:(_ == 1)*", ".f:!(.a == 1)", ".f:[a:*, *]", ".f:[b:*, a:*]",
    ".g == true", ".g->not($bool)", ".g->not(eq($int, 1))", ".g->and($bool, true)", ".h == uint(1)", ".h > uint(100)", ".h == 1", ".k == []byte{'a'}", ".k->gt(length($[]byte), 0)", ".k >= []byte{98}", ".a == \"x\"", '._ ^= "x"', '.a ^= "x"', '!(.a ^= "x")', "<empty>", "*", "!(*)", ".a->type($int)", ".a :: $string",
    ".l._:{a == 1; b:*}", ".l._.b == \"x\"", ".l:(_:{a:*; b:*})*", ".l.0.a == 1", ".l:[_.a == 1, _.b == \"x\"]", "#main = .d:@r #r = .a == 1", ".b ~= \"^y$\"", ".b->eq(length($string), 2)", ".b->eq(toUpper($string), \"XY\")", ".b->contains($string, []string{\"x\",\"yx\"})", ".a->contains($int, []int{1,5})", ".a->or(lt($int, 2), gt($int, 4))",
    ".!(a) == 1", "(.a == 1 | (.b == \"x\" | .e > double(1)))", "((.a == 1 & .e > double(0)) | !(.b == \"x\"))", ".[a == 1, e == double(0.5)]", ".n >= 0",
]


def batches(texts, size=40):
    return [texts[i : i + size] for i in range(0, len(texts), size)]


def compare(frame, texts):
    wrong, lowered = [], 0
    for part in batches(texts):
        grammars = [parse(t) for t in part]
        columns = {}
        for i, g in enumerate(grammars):
            try:
                columns[i] = F.coalesce(planner.plan_rows(g.compiled, frame, planner.PREDICATE).column, F.lit(False)).alias(f"r{i}")
            except (symbolic.NoPlan, planner.bdd.TooLarge):
                continue
        lowered += len(columns)
        rows = frame.select("n", *columns.values()).orderBy("n").collect()
        for i in columns:
            got, want = [r[f"r{i}"] for r in rows], expected(grammars[i], frame)
            if got != want:
                wrong.append((part[i], got, want))
    assert not wrong, wrong[:5]
    return lowered


def test_fixed_grammars(frame):
    assert compare(frame, FIXED) == len(FIXED)


def _random(rng, depth=3):
    leafs = ["== 1", "!= 1", '== "x"', '^= "x"', "> 1", "< double(1.5)", "== true", ":: $int", "->not(eq($int, 1))", "*", "<empty>", '->and(type($string), eq($string, "x"))', "== uint(1)"]
    name = lambda: rng.choice(["a", "b", "c", "d", "e", "f", "g", "l", "_", "!(a)", "(a|b)", "0", "1"])
    if depth == 0:
        return f"{rng.choice(['', '.'])}{name()}:{rng.choice(leafs)}" if rng.random() < 0.8 else rng.choice(leafs)
    p = lambda: _random(rng, depth - 1)
    return rng.choice(
        [lambda: f"{name()}:{p()}", lambda: f".{p()}", lambda: f".{name()}:{p()}", lambda: f".{name()}:{p()}", lambda: f"({p()})*", lambda: f"({p()})?", lambda: f"!({p()})", lambda: f"({p()}|{p()})", lambda: f"({p()}&{p()})", lambda: f"[{p()},{p()}]", lambda: f"[{p()},*]", lambda: f"{{{p()};{p()}}}", lambda: f"{{{p()};*}}", p]
    )()


def test_random_grammars(frame):
    rng = random.Random(7)
    texts = [_random(rng) for _ in range(140)]
    assert compare(frame.select("a", "b", "c", "d", "e", "f", "n"), texts) > 115


def test_the_automaton_agrees_on_rows(frame):
    for text in FIXED[::6]:
        g = parse(text)
        rows = frame.withColumn("r", planner.plan_rows(g.compiled, frame, planner.AUTOMATON).column).orderBy("n").collect()
        assert [r.r for r in rows] == expected(g, frame), text


def test_user_functions_as_columns(frame):
    library = sample_library()
    for text, want in ((".a->isPrime($int)", [2, 3, 5]), (".a->eq(inc($int), 4)", [3])):
        g = parse(text, library)
        assert g.plan(frame).how == planner.PREDICATE
        assert sorted(r.a for r in g.filter(frame).collect()) == want
    library.register("odd", ["int"], "bool", lambda x: x % 2 == 1)
    g = parse(".a->odd($int)", library)
    assert g.plan(frame).how == planner.AUTOMATON
    assert sorted(r.a for r in g.filter(frame).collect()) == [1, 1, 3, 5]


def test_types_without_a_label(spark):
    df = spark.sql("select 1 a, timestamp'2020-01-01 00:00:00' t, cast(null as void) v")
    assert parse(".t:*").filter(df).count() == 1
    assert parse(".a == 1").filter(df).count() == 1
    with pytest.raises(GrammarError, match="cast it"):
        parse('.t == "2020"').filter(df)


def test_clashing_names(spark):
    df = spark.sql("select 1 a").join(spark.sql("select 2 a"))
    with pytest.raises(GrammarError, match="one name"):
        parse(".a == 1").filter(df)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("text", "pushed"),
    [
        ('(.r == "R" & .q > double(45))', ["IsNotNull(r)", "EqualTo(r,R)", "GreaterThan(q,45.0)"]),
        ('(.r == "R" | .q > double(45))', ["Or(EqualTo(r,R)"]),
        ('!(.r == "R")', ["Or(Not(EqualTo(r,R)),IsNull(r))"]),
        ('._ == "R"', ["EqualTo(r,R)"]),
        ('[r == "R", *]', ["EqualTo(r,R)"]),
        ('{r == "R"; q:*; s:*}', ["EqualTo(r,R)"]),
        ('(.q > double(1) & !(.r == "R"))', ["GreaterThan(q,1.0)"]),
    ],
)
def test_predicates_reach_the_scan(spark, tmp_path, text, pushed):
    path = str(tmp_path / "t")
    spark.sql("select 'R' r, 46.0D q, 's' s").write.parquet(path)
    kept = parse(text).filter(spark.read.parquet(path))
    found = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan_of(kept))[1].replace(" ", "")
    assert all(p in found for p in pushed), found
    assert "Python" not in plan_of(kept) and "Arrow" not in plan_of(kept)


def test_only_named_columns_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("select 1 a, 2 b, named_struct('x', 3, 'y', 4) c").write.parquet(path)
    kept = parse("(.a == 1 & .c.x == 3)").filter(spark.read.parquet(path)).select("a")
    assert "ReadSchema: struct<a:int,c:struct<x:int>>" in plan_of(kept)


def test_shapes_over_arrays(frame):
    for text, shape in ((".c._ == 1", "exists"), (".c:(_ == 1)*", "forall"), (".c.0 == 1", "get"), (".c:[_ == 1, _ == 2]", "aggregate")):
        assert shape in str(parse(text).plan(frame).column), text


def test_no_shuffle(frame):
    assert "Exchange" not in plan_of(parse('(.a == 1 | ._ == "x")').filter(frame))


def _wide(width, sign, name=lambda i: f"c{i}"):
    return "(" + sign.join(f".{name(i)} == {i}" for i in range(width)) + ")"


@pytest.mark.parametrize(
    ("text", "sql", "pushed"),
    [
        (_wide(50, "|", lambda i: "c0"), "c0 between 0 and 49", ["In(c0,[0,1,10,"]),
        (_wide(10, "&"), " and ".join(f"c{i} = {i}" for i in range(10)), [f"EqualTo(c{i},{i})" for i in range(10)]),
        (_wide(30, "&"), " and ".join(f"c{i} = {i}" for i in range(30)), [f"EqualTo(c{i},{i})" for i in range(30)]),
        (_wide(30, "|"), " or ".join(f"c{i} = {i}" for i in range(30)), ["EqualTo(c0,0)", "EqualTo(c29,29)", "Or("]),
        (f"!({_wide(50, '|', lambda i: 'c0')})", "not coalesce(c0 between 0 and 49, false)", ["Or(Not(In(c0,", "IsNull(c0)"]),
        (f"!({_wide(30, '&')})", "not coalesce(" + " and ".join(f"c{i} = {i}" for i in range(30)) + ", false)", ["Or(Not(EqualTo(c0,0)),IsNull(c0))"]),
        ("(" + "&".join(f"._ == {i}" for i in range(12)) + ")", " and ".join(f"array_contains(array({', '.join(f'c{j}' for j in range(30))}), {i})" for i in range(12)), ["EqualTo(c29,11)"]),
        ("{" + ";".join([f"c{i} == {i}" for i in range(0, 30, 2)] + ["(_:*)*"]) + "}", " and ".join(f"c{i} = {i}" for i in range(0, 30, 2)), ["EqualTo(c0,0)", "EqualTo(c28,28)"]),
        ("(" + "&".join(f".c0->ge($int, {-i})" for i in range(12)) + "&" + _wide(9, "|", lambda i: "c3") + ")", "c0 >= 0 and c3 between 0 and 8", ["In(c3,"]),
    ],
)
def test_wide_filters_stay_predicates(spark, tmp_path, text, sql, pushed):
    rng = random.Random(3)
    rows = [[i if rng.random() < 0.97 else rng.choice([None, 7, 60]) for i in range(30)] for _ in range(200)]
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, ", ".join(f"c{i} int" for i in range(30))).write.parquet(path)
    df = spark.read.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "20000")
    g = parse(text)
    assert g.plan(df).how == planner.PREDICATE
    kept = g.filter(df)
    found = plan_of(kept).split("PushedFilters: [")[1].split("], ReadSchema")[0].replace(" ", "")
    assert all(p in found for p in pushed), found
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.where(sql).collect()))


def test_thousands_of_alternatives(spark):
    g = parse(_wide(3_000, "|", lambda i: "a"))
    assert [r.a for r in g.filter(spark.range(5_000).select((F.col("id") + 2_990).cast("int").alias("a"))).collect()] == list(range(2_990, 3_000))


def test_a_part_without_predicate_sees_few_rows(frame):
    library = sample_library()
    library.register("odd", ["int"], "bool", lambda x: x % 2 == 1)
    g = parse('(.a->odd($int) & .b == "x")', library)
    with pytest.warns(planner.PythonPlan, match="odd"):
        plan = g.plan(frame)
    assert plan.how == planner.MIXED and "rows go through Python" in g.explain(frame)
    text = plan_of(frame.filter(plan.column))
    assert text.index("(b#") < len(text) and [r.n for r in frame.filter(plan.column).collect()] == [0]
    below = text.split("ArrowEvalPython")[1]
    assert "= x" in below  # the predicate is under the Python node
