"""Decoders: JSON, XML, protobuf; and filters over payload columns, batch and streaming."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from treegate import GrammarError, parse, register_format
from treegate.catalogue import nation_descriptors
from treegate.plans import necessary
from treegate.sources import jsontree, proto, xmltree
from treegate.streaming.filtering import filter_to_files, read_stream

from .forests import grammars, json_texts


def leaf(kind, value):
    return (kind, value), []


def node(name, *children):
    return ("string", name), list(children)


JSON = [
    ("null", []), ("{}", []), ("[]", []), ("true", [leaf("bool", True)]), ("1", [leaf("int", 1)]), ("1.0", [leaf("int", 1)]), ("1e2", [leaf("int", 100)]), ("-10e-1", [leaf("int", -1)]), ("0.5", [leaf("double", 0.5)]), ("1e-500", [leaf("double", 0.0)]), ("0e999999999", [leaf("int", 0)]), ("1e999999999", [leaf("int", 0)]),
    ("18446744073709551617", [leaf("int", 1)]), ("9223372036854775808", [leaf("int", -(2**63))]), ('"a\\u0041"', [leaf("string", "aA")]), ("[true,null]", [(("int", 0), [leaf("bool", True)]), (("int", 1), [])]), ('{"b":1,"a":{},"b":2}', [node("b", leaf("int", 1)), node("a"), node("b", leaf("int", 2))]),
]


@pytest.mark.parametrize(("text", "want"), JSON)
def test_json(text, want):
    assert jsontree.decode(text) == want
    assert jsontree._deep(text) == want


@pytest.mark.parametrize("text", ["", "{", "[1,]", '{"a":}', "NaN", "1 2", "{1:2}", "[1 2]", "]", '"a', "[" * 50_000, "[" * 50_000 + "}" * 50_000])
def test_broken_json(text):
    for decode in (jsontree.decode, jsontree._deep):
        with pytest.raises(jsontree.JsonError):
            decode(text)


values = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(), st.floats(allow_nan=False, allow_infinity=False), st.text(max_size=3)), lambda v: st.one_of(st.lists(v, max_size=3), st.dictionaries(st.text(max_size=2), v, max_size=3)), max_leaves=8)


@given(values, st.sampled_from([None, 1]))
def test_deep_json_reads_alike(value, indent):
    text = json.dumps(value, indent=indent)
    assert jsontree._deep(text) == jsontree.decode(text)


XML = [
    ("<a/>", [node("a")]), ("<a>x</a>", [node("a", leaf("string", "x"))]), ("<a>12</a>", [node("a", leaf("int", 12))]), ("<a>-0x1f</a>", [node("a", leaf("int", -31))]), ("<a>(3)</a>", [node("a", leaf("int", 3))]), ("<a>1.5</a>", [node("a", leaf("string", "1.5"))]),
    ("<n:a xmlns:n='u' k='v'><n:b/></n:a>", [node("a", node("b"))]), ("<a> <b/>\n</a>", [node("a", leaf("string", " "), node("b"), leaf("string", "\n"))]), ("<a>x<![CDATA[<y>]]></a>", [node("a", leaf("string", "x"), leaf("string", "<y>"))]), ("<?xml version='1.0'?><!-- c --><a/>\n", [node("a")]), ("<a>&lt;&#65;</a>", [node("a", leaf("string", "<A"))]),
]


@pytest.mark.parametrize(("text", "want"), XML)
def test_xml(text, want):
    assert xmltree.decode(text) == want


@pytest.mark.parametrize("text", ["", "<a>", "<a></b>", "x"])
def test_broken_xml(text):
    with pytest.raises(xmltree.XmlError):
        xmltree.decode(text)


def people() -> proto.Descriptors:
    F, M = proto.Field, proto.Message
    phone = M("PhoneNumber", [F("Number", 1, 1, proto.STRING_T)])
    address = M("PersonAddress", [F("Street", 1, 1, proto.STRING_T), F("Number", 2, 1, proto.UINT64_T)])
    person = M("Person", [F("Name", 1, 1, proto.STRING_T), F("Address", 2, 1, proto.MESSAGE_T, ".person.Person.PersonAddress"), F("PhoneNumbers", 3, proto.REPEATED, proto.MESSAGE_T, ".phone.PhoneNumber")], [address])
    return proto.Descriptors([("phone", [phone]), ("person", [person])])


def test_descriptor_indexes():
    d = people()
    assert [name for name, _ in d.messages] == [".phone.PhoneNumber", ".person.Person", ".person.Person.PersonAddress"]
    assert d.tag_to_field == [{10: 0}, {10: 1, 18: 2, 26: 3}, {10: 4, 16: 5}]
    assert d.field_to_message == {2: 2, 3: 0}
    with pytest.raises(proto.ProtoError):
        d.message("person.Nobody")


def test_messages():
    d = people()
    e = proto.encode_field
    phone = lambda n: e(3, proto.MESSAGE_T, e(1, proto.STRING_T, n))
    name, address = e(1, proto.STRING_T, "Simon"), e(2, proto.MESSAGE_T, e(1, proto.STRING_T, "Dalsig Road") + e(2, proto.UINT64_T, 9))
    person = d.message("person.Person")
    want = [node("Name", leaf("string", "Simon")), node("Address", node("Street", leaf("string", "Dalsig Road")), node("Number", leaf("uint", 9)))]
    phones = lambda *ns: node("PhoneNumbers", *[(("int", i), [node("Number", leaf("string", n))]) for i, n in enumerate(ns)])
    assert proto.decode(d, person, name) == want[:1]
    assert proto.decode(d, person, name + address) == want
    assert proto.decode(d, person, name + address + phone("021") + phone("022")) == [*want, phones("021", "022")]
    # runs that are not neighbours stay apart; unknown fields go
    assert proto.decode(d, person, phone("1") + name + e(9, proto.STRING_T, "?") + phone("2")) == [phones("1"), want[0], phones("2")]


SCALARS = [
    (proto.INT32_T, -1, "int", -1), (proto.INT64_T, -(2**63), "int", -(2**63)), (proto.UINT32_T, 2**32 - 1, "uint", 2**32 - 1), (proto.UINT64_T, 2**64 - 1, "uint", 2**64 - 1), (proto.ENUM_T, 3, "uint", 3), (proto.BOOL_T, True, "bool", True), (proto.SINT32_T, -5, "int", -5), (proto.SINT64_T, -(2**62), "int", -(2**62)),
    (proto.FLOAT_T, 0.5, "double", 0.5), (proto.FIXED32_T, 7, "uint", 7), (proto.SFIXED32_T, -7, "int", -7), (proto.DOUBLE_T, -2.25, "double", -2.25), (proto.FIXED64_T, 2**63, "uint", 2**63), (proto.SFIXED64_T, -9, "int", -9), (proto.BYTES_T, b"\xff", "bytes", b"\xff"), (proto.STRING_T, "é", "string", "é"),
]


@pytest.mark.parametrize(("kind", "value", "label", "want"), SCALARS)
def test_scalars(kind, value, label, want):
    d = proto.Descriptors([("", [proto.Message("M", [proto.Field("x", 1, 1, kind), proto.Field("r", 2, proto.REPEATED, kind)])])])
    assert proto.decode(d, 0, proto.encode_field(1, kind, value)) == [node("x", leaf(label, want))]
    if kind not in (proto.BYTES_T, proto.STRING_T):
        one = proto.encode_field(1, kind, value)[1:]
        packed = proto.put_varint(2 << 3 | 2) + proto.put_varint(2 * len(one)) + one + one
        assert proto.decode(d, 0, packed) == [node("r", (("int", 0), [leaf(label, want)]), (("int", 1), [leaf(label, want)]))]


@pytest.mark.parametrize("data", [b"\x08", b"\x0b", b"\x0a\x05a", b"\x0a\x01\xff", b"\x80" * 11])
def test_broken_messages(data):
    d = proto.Descriptors([("", [proto.Message("M", [proto.Field("x", 1, 1, proto.STRING_T)])])])
    with pytest.raises(proto.ProtoError):
        proto.decode(d, 0, data)


@given(st.integers(-(2**63), 2**63 - 1))
def test_numbers_round_trip(n):
    assert proto.unzigzag(proto.zigzag(n)) == n
    assert proto.signed(proto.get_varint(proto.put_varint(n), 0)[0]) == n
    assert proto.word_to_double(proto.double_to_word(float(n))) == float(n)


def test_descriptor_sets_are_read():
    d = proto.Descriptors.from_bytes(nation_descriptors())
    assert [f.name for f in d.fields] == ["key", "name", "region"]
    assert d.tag_to_field[d.message("nation.Nation")] == {8: 0, 18: 1, 24: 2}


def test_payload_columns(spark):
    df = spark.createDataFrame([(1, '{"k": 60}'), (2, '{"k": 1}'), (3, "{broken"), (4, None)], "id int, props string")
    g = parse(".k > 50")
    assert [r.id for r in g.filter(df, on="props", format="json").collect()] == [1]
    marked = {r.id: r.valid for r in g.validate(df, on="props", format="json").collect()}
    assert marked == {1: True, 2: False, 3: None, 4: None}
    with pytest.raises(Exception, match="JsonError"):
        g.filter(df, on="props", format="json", on_error="raise").collect()
    with pytest.raises(GrammarError):
        g.filter(df, on="props", format="yaml")
    with pytest.raises(GrammarError):
        g.filter(df, on="props")


def test_a_stream_gives_what_the_batch_gives(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(100).selectExpr("id", "concat('{\"k\":', id % 7, '}') props").repartition(3).write.parquet(path)
    batch = spark.read.parquet(path)
    for grammar, how in ((".k > 3", {"on": "props", "format": "json"}), (".id >= 40", {})):
        g = parse(grammar)
        out = str(tmp_path / g.compiled.key())
        for _ in range(2):  # started again it finds nothing new
            filter_to_files(g, read_stream(spark, path, batch.schema), f"{out}/kept", f"{out}/checkpoint", **how).awaitTermination()
        assert sorted(r.id for r in spark.read.parquet(f"{out}/kept").collect()) == sorted(r.id for r in g.filter(batch, **how).collect())


def test_a_format_of_ones_own(spark):
    def decode(text, sep=";"):
        return [node(k, leaf("int", int(v))) for k, v in (x.split("=") for x in text.split(sep))]

    register_format("pairs-test", decode)
    df = spark.createDataFrame([(1, "a=1;b=2"), (2, "b=2;a=3"), (3, "a=x"), (4, None)], "n int, t string")
    g = parse(".a == 1")
    assert [r.n for r in g.filter(df, on="t", format="pairs-test").collect()] == [1]
    assert [r.valid for r in g.validate(df, on="t", format="pairs-test").orderBy("n").collect()] == [True, False, None, None]
    assert [r.n for r in g.filter(df.selectExpr("n", "replace(t, ';', '/') t"), on="t", format="pairs-test", sep="/").collect()] == [1]
    with pytest.raises(GrammarError):
        register_format("json", decode)


def test_texts_without_what_is_needed_do_not_reach_python(spark):
    texts = ['{"head":{"p":"1-URGENT"}}', '{"head":{"p":"2-HIGH"}}', '{"h\\u0065ad":{"p":"1\\u002dURGENT"}}', '{"p":"1-URGENT"}', "broken head p 1-URGENT", '{"head":{"p":"2","p":"1-URGENT"}}']
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    g = parse('.head.p == "1-URGENT"')
    assert necessary.strings(g.compiled) == ["1-URGENT", "head", "p"]
    kept = g.filter(df, on="t", format="json")
    assert [r.n for r in kept.collect()] == [0, 2, 5]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Contains(t#" in plan.split("ArrowEvalPython")[1]
    for text, want in (('(.a == 1 | .b == "x")', []), ('(.a == "xyz" | .b:.a:*)', ["a"]), ("!(.a == 1)", []), ("(a:*)?", []), ("#main = (.leaf == 1 | .next:@main)", []), ("#main = .next:(.leaf == 1 | @r) #r = .next:@main", ["next"]), ('.a->and(hasPrefix($string, "pre"), hasSuffix($string, "é"))', ["pre", "a"])):
        assert necessary.strings(parse(text).compiled) == want


@settings(max_examples=300, deadline=None)
@given(grammars(), json_texts)
def test_necessary_strings_are_necessary(grammar, text):
    g = parse(grammar)
    if g.accepts(jsontree.decode(text)):
        assert all(s in text or "\\u" in text for s in necessary.strings(g.compiled))


def test_validate_of_rows(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    assert [r.ok for r in parse('.b == "x"').validate(df, "ok").orderBy("a").collect()] == [True, False]


def test_folders_of_cases(spark, tmp_path, capsys):
    from treegate import cases
    from treegate.catalogue import nation_descriptors

    body = proto.encode_field(1, proto.UINT64_T, 5) + proto.encode_field(2, proto.STRING_T, "X")
    made = {"json/one/valid.json": b'{"a":1}', "json/two/invalid.json": b'{"a":2}', "xml/one/valid.xml": b"<a>1</a>", "pb/one/valid.pb": body, "json/wrong/valid.json": b'{"a":3}'}
    for name, data in made.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True)
        path.write_bytes(data)
        (path.parent / "grammar.txt").write_text(".key == uint(5)" if name.startswith("pb") else "a == 1")
    (tmp_path / "pb/nation.desc").write_bytes(nation_descriptors())
    (tmp_path / "pb/one/message").write_text("nation.Nation\n")
    assert cases.main(str(tmp_path)) == 1
    said = capsys.readouterr().out
    assert "json/wrong: valid, but not to automaton, derivative" in said and "5 cases, 1 wrong" in said
    assert [(r.case, r.format, r.valid) for r in cases.table(spark, tmp_path).collect()] == [("one", "json", True), ("two", "json", False), ("wrong", "json", True), ("one", "xml", True), ("one", "pb", True)]
    assert cases.main(str(tmp_path / "json")) == 0


def test_a_cluster_needs_a_shared_folder():
    from unittest.mock import MagicMock

    from treegate.shared import shared_folder

    session = MagicMock()
    session.conf.get.return_value = None
    session.sparkContext._jsc.sc().getCheckpointDir().isDefined.return_value = False
    session.sparkContext.master = "spark://somewhere:7077"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(session)
    session.conf.get.return_value = "hdfs://shared/"
    assert shared_folder(session) == "hdfs://shared"
