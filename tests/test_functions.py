"""Column functions against values worked out by hand."""

import math
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.catalog import fields as catalog
from loomwork.functions import arithmetic as ar
from loomwork.functions import encoding as en
from loomwork.functions import frames as fr
from loomwork.functions import json_policy as js
from loomwork.functions import lists as li
from loomwork.functions import records as re_
from loomwork.operators import canonical as ca
from loomwork.operators import workloads as wl

MIN, MAX = -(1 << 31), (1 << 31) - 1


def values(spark, inputs, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame([(i, *x) for i, x in enumerate(inputs)], "i int, " + schema).orderBy("i").select(*columns).collect()]


def test_guarded_and_wrapping_integers(spark):
    pairs = [(7, 2), (-7, 2), (7, -2), (MIN, -1), (5, 0), (MAX, 1), (MIN, MIN), (MAX, MAX), (123456789, 987654321)]
    wrap = lambda x: (x + (1 << 31)) % (1 << 32) - (1 << 31)
    a, b = F.col("a"), F.col("b")
    got = values(spark, pairs, "a int, b int", ar.wrapping_add(a, b), ar.wrapping_subtract(a, b), ar.wrapping_multiply(a, b), ar.safe_divide(a, b), ar.safe_modulus(a, b))
    for (x, y), r in zip(pairs, got):
        none = y == 0 or (x, y) == (MIN, -1)
        assert r == (wrap(x + y), wrap(x - y), wrap(x * y), MAX if none else int(math.trunc(x / y)), MAX if none else int(math.fmod(x, y)))


def test_numbers_from_text(spark):
    texts = ["+5", "0X10", "-+5", "0x", "00042", "0x00ff", "0", "42", "-42", "0xff", "-0x10", "1_000", "18446744073709551615", "18446744073709551616", "9223372036854775807", "-9223372036854775808", "9223372036854775808", "1, other = 2", "", "1.5", None]
    got = values(spark, [(t,) for t in texts], "t string", ar.parse_unsigned(F.col("t")).cast("string"), ar.parse_signed(F.col("t")))
    want = [("5", 5), (None, None), (None, None), (None, None), ("42", 42), ("255", 255), ("0", 0), ("42", 42), (None, -42), ("255", 255), (None, -16), ("1000", 1000), ("18446744073709551615", None), (None, None), ("9223372036854775807", 2**63 - 1), (None, -(2**63)), ("9223372036854775808", None), *[(None, None)] * 4]
    assert got == want
    floats = [("1_000.5", 1000.5), ("+inf", math.inf), ("1e3", 1000.0), ("INF", math.inf), ("-Infinity", -math.inf), (".5", 0.5), ("1.", 1.0), ("x", None), ("1e", None)]
    assert [r[0] for r in values(spark, [(t,) for t, _ in floats], "t string", ar.parse_float(F.col("t")))] == [v for _, v in floats]
    assert math.isnan(values(spark, [("NaN",)], "t string", ar.parse_float(F.col("t")))[0][0])


def test_floats_as_text(spark):
    cases = [(3.5, "3.5", "3.5"), (1e200, "1" + "0" * 200, "1e200"), (1.25e100, "125" + "0" * 98, "1.25e100"), (-0.0, "-0", "-0"), (0.0, "0", "0"), (1e21, "1" + "0" * 21, "1e21"), (1e20, "1" + "0" * 20, "1" + "0" * 20), (1e-6, "0.000001", "0.000001"),
             (1e-7, "0.0000001", "1e-7"), (-1234.5, "-1234.5", "-1234.5"), (0.1, "0.1", "0.1"), (2.0, "2", "2"), (1.1807e21, "1180700000000000000000", "1.1807e21"), (math.inf, "inf", '"Infinity"'), (-math.inf, "-inf", '"-Infinity"'), (math.nan, "nan", '"NaN"'), (5e-324, "0." + "0" * 323 + "5", "5e-324")]
    got = values(spark, [(c[0],) for c in cases], "x double", en.float_text(F.col("x")), en.float_json(F.col("x")))
    assert got == [c[1:] for c in cases]


def test_quoting_hex_and_base64(spark):
    texts = ["", "plain", 'say "hi"', "back\\slash \\n", "line\nbreak\ttab'", "λ \\\\"]
    quoted = en.quote(F.col("t"))
    assert [r[0] for r in values(spark, [(t,) for t in texts], "t string", en.unquote(quoted))] == texts
    assert values(spark, [('a"b\n',)], "t string", quoted)[0][0] == '"a\\"b\\n"'
    control = "a\x01b\x7f\x85ü"
    assert values(spark, [(control,)], "t string", en.quote(F.col("t")), en.unquote(en.quote(F.col("t"))))[0] == ('"a\\001b\\177\\302\\205ü"', control)
    raws = [b"", b"plain", bytes(range(256)), b"\\'\"\n"]
    got = values(spark, [(r,) for r in raws], "b binary", en.quote_bytes(F.col("b")), en.unquote_bytes(en.quote_bytes(F.col("b"))))
    assert [bytes(r[1]) for r in got] == raws and got[1][0] == '"plain"' and got[3][0] == '"\\\\\\\'\\"\\n"' and got[2][0].startswith('"\\000\\001')
    escapes = ['"\\x41\\101"', '"\\9"', '"\\"', "plain", '"\\377"', None]
    assert [r[0] for r in values(spark, [(t,) for t in escapes], "t string", en.unquote(F.col("t")))] == ["AA", None, None, None, None, None]
    bad = ["A==A", "QQ", "QR==", "QQ==\n", "QQ==", "", None]
    assert [r[0] for r in values(spark, [(t,) for t in bad], "t string", en.from_base64(F.col("t")))] == [None, None, None, None, b"A", b"", None]
    assert [r[0] for r in values(spark, [("abc",), ("0g",), ("DEad",)], "t string", en.from_hex(F.col("t")))] == [None, None, b"\xde\xad"]


def test_little_endian_and_bits(spark):
    ints = [0, 1, -1, 255, -129, (1 << 56) + 5, -(1 << 63), (1 << 63) - 1, -5]
    x = F.col("x")
    for width in range(1, 9):
        got = values(spark, [(i,) for i in ints], "x long", en.read_little_endian(en.little_endian(x, width), 1, width), en.read_little_endian(en.little_endian(x, width), 1, width, signed=True))
        size = 1 << (8 * width)
        signed = lambda n: n - size if n >= size // 2 else n  # noqa: B023, E731
        assert got == [(signed(i % size) if width == 8 else i % size, signed(i % size)) for i in ints]
    doubles = [0.0, -0.0, 1.0, -2.5, 0.1, 1e308, 5e-324, -2.2250738585072014e-308, 2.225073858507201e-308, 123456.789, math.inf, -math.inf, math.pi]
    got = values(spark, [(d,) for d in doubles], "x double", en.double_bits(x), en.bits_double(en.double_bits(x)))
    assert [r[0] for r in got] == [struct.unpack("<q", struct.pack("<d", d))[0] for d in doubles]
    assert [str(r[1]) for r in got] == [str(d) for d in doubles]
    assert math.isnan(values(spark, [(math.nan,)], "x double", en.bits_double(en.double_bits(x)))[0][0])


def test_frames(spark):
    for n in (1, 2, 3, 4):
        segments = [bytes(range(8)) * k for k in range(n)]
        frame = struct.pack(f"<{n + 1}I", n - 1, *(len(s) // 8 for s in segments))
        frame += b"\0" * (-len(frame) % 8) + b"".join(segments)
        df = spark.createDataFrame([(segments, frame)], "s array<binary>, f binary")
        r = df.select(fr.encode_frame(F.col("s")).alias("e"), fr.parse_frame(F.col("f")).alias("p"), fr.table_size(F.size("s")).alias("t")).first()
        assert bytes(r.e) == frame and [bytes(x) for x in r.p] == segments and r.t == len(frame) - sum(map(len, segments))
    odd = spark.createDataFrame([([b"12345"], b"\1\0\0\0"), ([], b""), ([b""], struct.pack("<II", 600, 0)), ([b""], struct.pack("<II", 0, 9))], "s array<binary>, f binary")
    assert [(r[0], r[1]) for r in odd.select(fr.encode_frame(F.col("s")), fr.parse_frame(F.col("f"))).collect()] == [(None, None), (None, None), (struct.pack("<II", 0, 0), None), (struct.pack("<II", 0, 0), None)]


# Packed forms of words.
PACKED = [
    ([], []), ([0] * 8, [0, 0]), ([0, 0, 12, 0, 0, 34, 0, 0], [36, 12, 34]), ([1, 3, 2, 4, 5, 7, 6, 8], [255, 1, 3, 2, 4, 5, 7, 6, 8, 0]),
    ([8, 0, 100, 6, 0, 1, 1, 2] + [0] * 26 + [1, 0, 2, 0, 3, 1], [237, 8, 100, 6, 1, 1, 2, 0, 2, 212, 1, 2, 3, 1]), ([0] * 8 * 257, [0, 255, 0, 0]),
]


@pytest.mark.parametrize("raw,packed", PACKED)
def test_packing(raw, packed):
    assert fr.pack_words(bytes(raw)) == bytes(packed) and fr.unpack_words(bytes(packed)) == bytes(raw)


def plain_pack(raw):
    """A word at a time."""
    words, out, i = [raw[k : k + 8] for k in range(0, len(raw), 8)], bytearray(), 0
    while i < len(words):
        w = words[i]
        out.append(sum(1 << k for k in range(8) if w[k]))
        out += bytes(b for b in w if b)
        i += 1
        if w.count(0) in (0, 8):
            run, most = i, w.count(0)
            while run < min(len(words), i + 255) and (words[run].count(0) == 8 if most else words[run].count(0) <= 1):
                run += 1
            out.append(run - i)
            out += b"" if most else b"".join(words[i:run])
            i = run
    return bytes(out)


def test_packing_many_at_once():
    import random

    rng = random.Random(2)
    kinds = [bytes(8), bytes(range(1, 9)), bytes([0, *range(1, 8)]), bytes([5, 0, 0, 0, 0, 0, 0, 9])]
    raws = [b"".join(rng.choice(kinds) * rng.choice([1, 1, 2, 300]) for _ in range(rng.randint(0, 6))) for _ in range(80)]
    assert fr.pack_many(raws) == [plain_pack(r) for r in raws] and fr.pack_many([]) == [] and fr.pack_many([b""]) == [b""]
    assert [fr.unpack_words(p) for p in fr.pack_many(raws)] == raws


def test_packing_round_trips(spark):
    import random

    rng = random.Random(1)
    raws = [bytes(rng.choice([0, 0, 0, 1, 255]) if k % 3 else rng.randrange(256) for k in range(8 * rng.randint(0, 400))) for _ in range(20)] + [bytes(range(1, 9)) * 300]
    got = spark.createDataFrame([(r,) for r in raws], "r binary").select(fr.unpack(fr.pack(F.col("r")))).collect()
    assert [bytes(x[0]) for x in got] == raws
    assert fr.unpack_words(b"\xff\1") is None and fr.unpack_words(b"\0") is None and fr.unpack_words(bytes([255, *range(8), 3, 1])) is None


def test_source_reads_what_it_writes(spark, tmp_path):
    from loomwork.sources.frames import FramedSource, read_frames

    spark.dataSource.register(FramedSource)
    rows = [("", 0, [bytes([k]) * 8, bytes(8 * k)]) for k in range(1, 20)]
    df = spark.createDataFrame(rows, "file string, seq long, segments array<binary>").repartition(3)
    for framing in ("standard", "packed"):
        at = f"{tmp_path}/{framing}"
        df.write.format("framed").option("framing", framing).mode("append").save(at)
        back = spark.read.format("framed").option("framing", framing).load(at)
        assert sorted([bytes(s) for s in r.segments] for r in back.collect()) == sorted(r[2] for r in rows)
        again = read_frames(spark, at, framing)
        assert sorted([bytes(s) for s in r.segments] for r in again.collect()) == sorted(r[2] for r in rows)
    df.limit(5).write.format("framed").mode("overwrite").save(f"{tmp_path}/standard")
    assert spark.read.format("framed").load(f"{tmp_path}/standard").count() == 5
    stale = tmp_path / "standard" / "_temporary" / "old"
    stale.mkdir(parents=True)
    (stale / "part-0.frames").write_bytes(b"half a frame")
    assert spark.read.format("framed").load(f"{tmp_path}/standard").count() == 5
    bad = spark.createDataFrame([("", 0, [b"12345"])], df.schema)
    with pytest.raises(PySparkException):
        df.unionByName(bad).write.format("framed").mode("append").save(f"{tmp_path}/standard")
    assert spark.read.format("framed").load(f"{tmp_path}/standard").count() == 5
    (tmp_path / "flat").write_bytes(b"12345678")
    assert [bytes(s) for s in spark.read.format("framed").option("framing", "flat").load(f"{tmp_path}/flat").first().segments] == [b"12345678"]
    (tmp_path / "short").write_bytes(b"\0\0\0\0\2\0\0\0half")
    with pytest.raises(PySparkException):
        spark.read.format("framed").load(f"{tmp_path}/short").collect()


def test_lists(spark):
    df = spark.createDataFrame([([1, 2, 3],)], "v array<int>")
    assert df.select(li.get_checked(F.col("v"), 2)).first()[0] == 3
    for k in (-1, 3):
        with pytest.raises(PySparkException):
            df.select(li.get_checked(F.col("v"), k)).collect()
    assert df.select(li.as_structs(F.col("v"), "value", label="")).first()[0][1].asDict() == {"value": 2, "label": ""}
    assert li.upgrades("int", "struct<value:int>") and not li.upgrades("boolean", "struct<value:boolean>") and not li.upgrades("int", "string")
    assert df.select(li.set_at(F.col("v"), 1, F.lit(9))).first()[0] == [1, 9, 3]
    with pytest.raises(PySparkException):
        df.select(li.set_at(F.col("v"), 3, F.lit(9))).collect()
    for slot in (-1, 2):
        with pytest.raises(PySparkException):
            li.build_sparse_list(spark.createDataFrame([(1, slot, "a")], "k int, slot int, v string"), ["k"], "slot", "v", 2).collect()
    assert li.build_sparse_list(spark.createDataFrame([(1, 1, "a")], "k int, slot int, v string"), ["k"], "slot", "v", 3).first()["items"] == [None, "a", None]
    twice = spark.createDataFrame([(1, 0, "a"), (1, 0, "b")], "k int, slot int, v string")
    with pytest.raises(PySparkException):
        li.build_sparse_list(twice, ["k"], "slot", "v", 2).collect()


def test_unions_keep_unknown_tags(spark):
    u = re_.union_value(F.col("t"), {"a": F.lit(1), "b": F.lit("x")})
    got = values(spark, [(0,), (1,), (9,)], "t int", u.alias("u"), re_.which(u, ["a", "b"]))
    assert [(r[0].tag, r[0].a, r[0].b, r[1]) for r in got] == [(0, 1, None, "a"), (1, None, "x", "b"), (9, None, None, "unknown(9)")]


def test_defaults_compare_floats_by_bits(spark):
    got = values(spark, [(0.0,), (-0.0,), (1.5,)], "x double", re_.unless_default(F.col("x"), 0.0))
    assert [str(r[0]) for r in got] == ["None", "-0.0", "1.5"]


def test_json(spark):
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.BooleanType())])
    texts = ['{"a":"7","b":true}', '{"a":"1, b = 2"}', '{"a":1.5,"c":0}', '{"a":9007199254740993}', '{"a":1,"a":2}', "nonsense"]
    got = values(spark, [(t,) for t in texts], "t string", js.decode(F.col("t"), schema), js.unknown_fields(F.col("t"), schema), js.has_duplicate_keys(F.col("t")))
    assert [r[0].a for r in got[:4]] == [7, None, None, 9007199254740993] and got[0][0].b is True and got[4][0] is None and got[5][0] is None
    nested = T.StructType([T.StructField("d", T.DoubleType()), T.StructField("raw", T.BinaryType()), T.StructField("in", T.StructType([T.StructField("l", T.ArrayType(T.LongType()))])), T.StructField("f", T.FloatType())])
    rows = [(1e21, b"\x00\xff", (([1, None],)), 0.1), (-0.0, b"", None, None), (None, None, (None,), float("inf"))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], T.StructType([T.StructField("i", T.IntegerType()), *nested.fields])).orderBy("i")
    record = F.struct(*nested.fieldNames())
    text = [r[0] for r in df.select(js.encode(record, nested)).collect()]
    assert text == ['{"d":1e21,"raw":[0,255],"in":{"l":["1",null]},"f":0.1}', '{"d":-0,"raw":[]}', '{"in":{},"f":"Infinity"}']
    for form in (js.decode(js.encode(record, nested), nested), js.from_literal(js.literal(record, nested), nested)):
        back = [r[0] for r in df.select(form).collect()]
        assert back[0].d == 1e21 and bytes(back[0].raw) == b"\x00\xff" and abs(back[0].f - 0.1) < 1e-6 and back[1].raw == b"" and back[2].f == math.inf and back[1]["in"] is None
    upper = {"a": F.upper, T.BooleanType: lambda x: F.lit("1")}
    assert spark.range(1).select(js.encode(F.struct(F.lit("x").alias("a"), F.lit("y").alias("c"), F.lit(True).alias("b")), T.StructType([T.StructField("a", T.StringType()), T.StructField("c", T.StringType()), T.StructField("b", T.BooleanType())]), upper)).first()[0] == '{"a":X,"c":"y","b":1}'
    assert got[2][1] == ["c"] and [r[2] for r in got][:5] == [False, False, False, False, True]


def test_car_value_by_hand(spark):
    car = F.expr("""named_struct('seats', 4, 'doors', 5, 'wheels', array(named_struct('diameter', 25, 'snowTires', true), named_struct('diameter', 26, 'snowTires', false)),
      'length', 170, 'width', 90, 'height', 7, 'engine', named_struct('horsepower', 100, 'usesGas', false, 'usesElectric', true),
      'hasPowerWindows', true, 'hasPowerSteering', false, 'hasCruiseControl', true, 'hasNavSystem', true, 'cupHolders', 3)""")
    want = 800 + 1750 + 625 + 100 + 676 + 170 * 90 * 7 // 50 + 4000 + 3000 + 100 + 400 + 2000 + 75
    assert spark.range(1).select(wl.total_value(F.array(car, car))).first()[0] == 2 * want
    assert spark.range(1).select(wl.total_value(F.lit(None).cast("array<struct<seats:int,doors:int,wheels:array<struct<diameter:int,snowTires:boolean>>,length:int,width:int,height:int,engine:struct<horsepower:int,usesGas:boolean,usesElectric:boolean>,hasPowerWindows:boolean,hasPowerSteering:boolean,hasCruiseControl:boolean,hasNavSystem:boolean,cupHolders:int>>"))).first()[0] == 0


def test_trees_by_hand(spark):
    nodes = [(1, 1, None, None, "subtract", None), (1, 2, 1, "left", "multiply", None), (1, 3, 1, "right", None, 5), (1, 4, 2, "left", None, 1 << 30), (1, 5, 2, "right", None, 4), (2, 1, None, None, None, 7), (3, 1, None, None, "divide", None), (3, 2, 1, "left", None, 9), (3, 3, 1, "right", None, 0)]
    df = spark.createDataFrame(nodes, "tree int, node int, parent int, side string, op string, value int")
    assert {r.tree: r.value for r in wl.evaluate_trees(df).collect()} == {1: -5, 2: 7, 3: MAX}


def test_reading_other_versions(spark):
    new = spark.createDataFrame([(1, [("a", 1)], "n")], "id int, items array<struct<value:string,k:int>>, name string")
    old = T.StructType([T.StructField("id", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("state", T.StringType(), True, {"default": "ready"})])
    assert catalog.read_as(new, old).first().asDict() == {"id": 1, "items": ["a"], "state": "ready"}


def test_a_cluster_needs_a_shared_folder():
    from loomwork.plans.staging import shared_dir

    class Session:
        def __init__(self, **conf):
            self.conf = {k.replace("_", "."): v for k, v in conf.items()}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session(spark_master="spark://host:7077", spark_app_id="a"))
    assert shared_dir(Session(spark_master="yarn", spark_checkpoint_dir="hdfs:///x/")) == "hdfs:///x"
    assert shared_dir(Session(spark_master="local[2]", spark_app_id="b")) == shared_dir(Session(spark_master="local[2]", spark_app_id="b"))


def test_nodes_and_enumerants(spark):
    df = spark.createDataFrame([("b", (1, "x")), ("a", (2, "y")), (None, None), ("b", None)], "kind string, home struct<n:int,name:string>")
    assert [tuple(r)[:5] for r in catalog.nodes(df, "t", "f00dfeedf00dfeed").orderBy("path").collect()] == [("t", None, 2, 0, 2), ("t.home", "t", 2, 1, 1)]
    assert [tuple(r) for r in catalog.enumerants(df, "kind", "kind").orderBy("ordinal").collect()] == [("kind", 0, "a"), ("kind", 1, "b")]


def test_calculations(spark):
    rows = [(1, 1, "multiply", (2.0, None), (3.0, None)), (1, 2, "subtract", (None, 1), (1.5, None)), (1, 3, "divide", (None, 2), (None, 1)), (1, 4, "power", (1.0, None), (1.0, None)), (1, 5, "add", (None, 9), (1.0, None)), (2, 1, "divide", (1.0, None), (0.0, None))]
    df = spark.createDataFrame(rows, "calc int, step int, op string, left struct<value:double,ref:int>, right struct<value:double,ref:int>").repartition(3)
    got = {(r.calc, r.step): r.result for r in wl.calculate(df).collect()}
    assert got == {(1, 1): 6.0, (1, 2): 4.5, (1, 3): 0.75, (1, 4): None, (1, 5): None, (2, 1): None}
    own = {"add": lambda a, b: F.greatest(a, b)}
    assert {r.result for r in wl.calculate(df.where("step = 4").withColumn("op", F.lit("add")), own).collect()} == {1.0}


_TWO = T.StructType([T.StructField("key", T.LongType()), T.StructField("rate", T.DoubleType())])
_WIDE = T.StructType([T.StructField(f"f{k}", kind) for k, kind in enumerate([T.LongType(), T.StringType(), T.DoubleType(), T.ArrayType(T.LongType())] * 3)])


@pytest.mark.parametrize("made", [
    lambda t: js.decode(t, _WIDE), lambda t: js.encode(js.decode(t, _WIDE), _WIDE), lambda t: fr.frame_of(js.decode(t, _TWO), _TWO),
    lambda t: js.literal(js.decode(t, _WIDE), _WIDE), lambda t: js.from_literal(js.literal(js.decode(t, _WIDE), _WIDE), _WIDE), lambda t: ca.is_canonical(t, _WIDE),
    en.quote, en.unquote,
])
def test_expressions_name_their_input_once(spark, made):
    """However many fields there are: expressions in each other would grow as the power of their depth."""
    assert str(made(F.concat(F.col("t"), F.lit("mark")))).count("mark") <= 2  # is_canonical compares with its text


def test_nested_records_through_all_forms(spark):
    inner = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.ArrayType(T.StructType([T.StructField("c", T.StringType())])))])
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("i", inner)])
    text = '{"n":"-9223372036854775808","x":"-Infinity","i":{"a":"7","b":[{"c":"é \\"q\\""},{}]}}'
    d = spark.createDataFrame([(text,), ("none",), (None,)], "t string").select("t", js.decode(F.col("t"), schema).alias("r"))
    got = d.select(js.encode(F.col("r"), schema).alias("json"), js.encode(js.from_literal(js.literal(F.col("r"), schema), schema), schema).alias("again")).collect()
    assert [tuple(r) for r in got] == [(text, text), (None, None), (None, None)]


def test_backslashes_before_other_escapes(spark):
    """Runs of backslashes, control characters next to each other, and codes beside escapes."""
    plain = ["\\n", "\\\n", "\\\\", "\\\"", "\\\x01\x02\x85", "", "\n\\", "é\x7fé\\001", "\\x41"]
    quoted = ['"\\\\n"', '"\\\\\\n"', '"\\\\\\\\"', '"\\\\\\""', '"\\\\\\001\\002\\302\\205"', '""', '"\\n\\\\"', '"é\\177é\\\\001"', '"\\\\x41"']
    got = values(spark, [(t,) for t in plain], "t string", en.quote(F.col("t")), en.unquote(en.quote(F.col("t"))))
    assert got == list(zip(quoted, plain))
    bad = ['"\\\\\\"', '"\\q"', '"\\1"', '"\\x4"', '"', 'ab', '"\\777"']
    assert [r[0] for r in values(spark, [(t,) for t in bad], "t string", en.unquote(F.col("t")))] == [None] * len(bad)


def test_unpacking_of_long_inputs_at_once():
    import random

    rng = random.Random(3)
    word = lambda: bytes(rng.choice((0, 0, 7, 255)) if kind == 2 else 255 * kind for kind in [rng.choice((0, 1, 2))] for _ in range(8))
    raw = b"".join(word() * rng.choice((1, 1, 2, 300)) for _ in range(3000))
    packed = fr.pack_words(raw)
    assert fr.unpack_many(packed) == (raw, len(packed))
    # What is cut off is left for the next call.
    for cut in rng.sample(range(len(packed)), 50):
        out, used = fr.unpack_many(packed[:cut])
        assert used <= cut and raw.startswith(out) and out + fr.unpack_words(packed[used:]) == raw


def test_frames_are_read_and_written_many_at_once(monkeypatch):
    """Chunks end anywhere in a frame, and packing takes many frames in a call."""
    import io

    import pyarrow as pa

    from loomwork.sources import frames as so

    calls = []
    pack_many = fr.pack_many
    monkeypatch.setattr(so, "pack_many", lambda frames: calls.append(len(frames)) or pack_many(frames))
    rows = [[bytes([k % 7, 0, 0, k % 5, 1, 2, 3, 4]) * (k % 4), bytes(8 * (k % 3))][: 1 + k % 2] for k in range(25_000)]
    table = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.binary()))], ["segments"])
    for framing in ("packed", "standard"):
        raw = b"".join(so.packed_frames([table], framing))
        for chunk in (11, 1 << 20):
            monkeypatch.setattr(so, "CHUNK", chunk)
            got = list(so.batches_of(io.BytesIO(raw), framing, "f"))
            assert [s for b in got for s in b["segments"].to_pylist()] == rows and [n for b in got for n in b["seq"].to_pylist()] == list(range(len(rows)))
    assert len(calls) == 1


def test_evaluated_nodes_are_not_read_again(spark, monkeypatch):
    """A deep tree among shallow ones: after the first round only waiting nodes are read."""
    seen, staged = [], wl.staged

    def watched(df, name):
        seen.append((name, df.inputFiles(), df.count()))
        return staged(df, name)

    monkeypatch.setattr(wl, "staged", watched)
    leaf = lambda t, n, p, side, v: (t, n, p, side, None, v)
    rows = [x for t in range(1, 9) for x in (leaf(t, 1, 3, "left", t), leaf(t, 2, 3, "right", None if t == 8 else 2), (t, 3, None, None, "add", None))]
    rows += [leaf(0, 0, 11, "left", 1)] + [x for k in range(11, 16) for x in (leaf(0, k + 100, k, "right", 1), (0, k, k + 1 if k < 15 else None, "left" if k < 15 else None, "add", None))]
    df = spark.createDataFrame(rows, "tree int, node int, parent int, side string, op string, value int")
    assert {r.tree: r.value for r in wl.evaluate_trees(df).collect()} == {0: 6, 8: None, **{t: t + 2 for t in range(1, 8)}}
    levels = [(files, n) for name, files, n in seen if name == "tree-level"]
    assert [n for _, n in levels] == [13, 4, 3, 2, 1]
    assert not any("tree-nodes" in f for files, _ in levels[1:] for f in files)


def test_trees_that_lack_an_operand_are_refused(spark):
    rows = [(1, 1, 3, "left", None, 5), (1, 3, None, None, "add", None)]
    with pytest.raises(ValueError, match="1 trees have no value, 1 operands"):
        wl.evaluate_trees(spark.createDataFrame(rows, "tree int, node int, parent int, side string, op string, value int"))
