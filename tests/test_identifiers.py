"""Known identifiers, times and small functions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from watchfold.functions import ids, net, text, times


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def lit(v):
    return F.lit(v)


def test_alert_correlation(spark):
    pod = "shop-frontend-7c4d-x2k9q"
    con = "c0ffee15600d4a8a08f09d37b73795649038408b5f338277e0910d750195b448"
    row = one(spark, c=ids.corr_id(lit(con), lit(60100), lit(pod), lit("2030-11-05T21:08:47Z")))
    assert row.c == "301105T210847Zc0ffee15600d000601003921529a2234"
    assert row.c.endswith(hashlib.md5(pod.encode()).hexdigest()[:12])


def test_kernel_correlation_prefix(spark):
    con = "containerd://5b7e0c4d9a1f0cc175b9c0f1b6a831c399e26977266192eb5ffee6ae2fec3ad7"
    row = one(
        spark,
        exact=ids.corr_id(lit(con), lit(31415), lit("n"), lit("2031-02-11T07:45:09.118273645Z"),
                          kernel=True),
        odd=ids.corr_id(lit("docker://88a1"), lit(1), lit("n"),
                        lit("2031-02-11T07:45:09.118273645Z"), kernel=True),
        old=ids.corr_id_v1(lit("docker://88a1"), lit(1), lit("n"),
                           lit("2031-02-11T07:45:09.118273645Z"), "kernel"),
    )
    assert row.exact.startswith("310211T074509115b7e0c4d9a1f00031415")
    assert row.odd.startswith("310211T07450911unknown00000001")
    assert row.old is None


def test_process_id_keeps_one_host_character(spark):
    row = one(spark, p=ids.process_id(lit("310211T074509275b7e0c4d9a1f00027182worker-blue")),
              none=ids.process_id(lit("")))
    assert row.p == "process--310211T074509275b7e0c4d9a1f00027182w"
    assert row.none is None


@pytest.mark.parametrize("pid,filled", [
    ("7", "00000007"), ("-1", "-0000001"), ("1234567890", "1234567890"), ("", "00000000"),
])
def test_zero_fill_is_sign_aware(spark, pid, filled):
    assert one(spark, z=ids.zero_fill(lit(pid), 8)).z == filled == pid.zfill(8)


def test_unknown_host(spark):
    row = one(spark, c=ids.corr_id(lit("abc"), lit(None).cast("bigint"), lit("UnknownHost"),
                                   lit("2030-11-05T21:08:47Z")))
    assert row.c == "301105T210847Zabc0000None0UnknownHost"


def test_process_id_from_exec(spark):
    import base64

    name = "worker-blue-07:4711:31415"
    row = one(spark, ok=ids.process_id_from_exec(lit(base64.b64encode(name.encode()).decode())),
              bad=ids.process_id_from_exec(lit("%%%")),
              binary=ids.process_id_from_exec(lit(base64.b64encode(b"\xff\xfe").decode())))
    assert row.ok == "process--" + name[-36:]
    assert row.bad is None and row.binary is None


def test_iso_to_ns(spark):
    row = one(spark, ns=times.iso_to_ns(lit("2034-08-19T03:12:43.716253948Z")),
              us=times.iso_to_ns(lit("2034-08-19T03:12:43.716253")),
              s=times.iso_to_ns(lit("2034-08-19T03:12:43Z")), bad=times.iso_to_ns(lit("nope")),
              strict=times.iso_to_ns_micro_only(lit("2034-08-19T03:12:43.716253948Z")))
    assert row.ns == 2039569963716253948
    assert row.us == 2039569963716253000
    assert row.s == 2039569963000000000
    assert row.bad is None and row.strict is None


def test_nanoseconds_stay_exact(spark):
    """Odd nanoseconds that a double cannot hold."""
    values = [1920143327412007009, 1920143327412006977, -1, 0, 999]
    df = spark.createDataFrame([(v,) for v in values], "ns bigint")
    got = [r[0] for r in df.select(F.unix_micros(times.ns_to_ts(F.col("ns")))).collect()]
    assert got == [v // 1000 for v in values]


def test_epoch_units(spark):
    ms = 1919191919191
    row = one(spark, strict=times.epoch_to_iso(lit(ms)), loose=times.epoch_to_iso(lit(ms), False),
              bound=times.start_bound_ns(lit(ms)), wrong=times.start_bound_ns(lit(ms), False))
    assert row.strict == "2030-10-25T20:51:59Z"
    assert row.loose == "1970-01-01T00:31:59Z"
    assert row.bound == ms * 10**6 and row.wrong == ms * 10**3


def test_trace_time(spark):
    assert one(spark, t=times.ns_to_iso_millis(lit(1920143327412007009))).t == (
        "2030-11-05T21:08:47.412Z")


def test_flatten_nested_arguments(spark):
    df = spark.createDataFrame(
        [([("flags", "list", '["a","b"]'), ("addr", "object", '{"ip":"1.2.3.4","p":{"q":1}}'),
           ("plain", "string", "x")],)],
        "args array<struct<name:string,type:string,value:string>>")
    got = df.select(text.flatten_trace_args(F.col("args"))).first()[0]
    assert got == {
        "0_name": "flags", "0_type": "list", "0_value[0]": "a", "0_value[1]": "b",
        "1_name": "addr", "1_type": "object", "1_value_ip": "1.2.3.4", "1_value_p_q": "1",
        "2_name": "plain", "2_type": "string", "2_value": "x",
    }


def test_bytes_wrapper(spark):
    row = one(spark, a=text.strip_bytes_wrapper(lit("b'x y'")), b=text.strip_bytes_wrapper(lit("b'")),
              c=text.strip_bytes_wrapper(lit("plain")), d=text.strip_bytes_wrapper(lit("b''")))
    assert (row.a, row.b, row.c, row.d) == ("x y", "b'", "plain", "")


def test_swap_port(spark):
    assert one(spark, p=text.swap_port(lit(0x1F90))).p == 0x901F


@pytest.mark.parametrize("block,inside,outside", [
    ("10.1.0.0/20", "10.1.15.255", "10.1.16.0"), ("172.16.0.0/28", "172.16.0.15", "172.16.0.16"),
    ("127.0.0.1", "127.0.0.1", "127.0.0.2"), ("0.0.0.0/0", "255.255.255.255", "1.2.3"),
])
def test_blocks(spark, block, inside, outside):
    row = one(spark, a=net.in_blocks(net.ipv4(lit(inside)), [block]),
              b=net.in_blocks(net.ipv4(lit(outside)), [block]))
    assert row.a is True and row.b is False


def test_addresses_are_validated(spark):
    row = one(spark, a=net.ipv4(lit("256.1.1.1")), b=net.ipv4(lit("::1")),
              c=net.ipv4(lit("10.0.0.1")))
    assert row.a is None and row.b is None and row.c == 167772161
    with pytest.raises(ValueError):
        net.cidr_bounds("10.0.0.300/8")


def test_subset_and_superset(spark):
    row = one(spark, a=net.is_subset(lit("10.1.0.0/24"), "10.0.0.0/8"),
              b=net.is_subset(lit("10.0.0.0/7"), "10.0.0.0/8"),
              c=net.is_superset(lit("10.0.0.0/7"), "10.0.0.0/8"),
              d=net.is_superset(lit("not an address"), "10.0.0.0/8"))
    assert (row.a, row.b, row.c, row.d) == (True, False, True, None)


def test_json_or_self(spark):
    df = spark.createDataFrame([("null",), ("{\"b\": 1, \"a\": 2}",), ("word",), (None,)], "c string")
    got = [r[0] for r in df.select(text.json_or_text(F.col("c"))).collect()]
    assert got == [None, '{"a":2,"b":1}', "word", None]


def test_flatten_to_the_leaves(spark):
    values = ['{"a":{"b":[1,{"c":2}],"e":{}},"a2":[[1,[2]],null,"x{y"],"d":"{\\"k\\":1}","t":true}', "{not json", "[]", None]
    df = spark.createDataFrame([([("n", "t", v) for v in values],)],
                               "args array<struct<name:string,type:string,value:string>>")
    got = df.select(text.flatten_trace_args(F.col("args"))).first()[0]
    assert {k: v for k, v in got.items() if "value" in k} == {
        "0_value_a_b[0]": "1", "0_value_a_b[1]_c": "2", "0_value_a2[0]_0": "1", "0_value_a2[0]_1_0": "2",
        "0_value_a2[1]": None, "0_value_a2[2]": "x{y", "0_value_d": '{"k":1}', "0_value_t": "true",
        "1_value": "{not json", "3_value": None,
    }


def test_flatten_equal_keys(spark):
    deep = '{"a":1,"a":2}'
    df = spark.createDataFrame([([("n", "t", deep), ("n", "t", "[" * 40 + "7" + "]" * 40)],)],
                               "args array<struct<name:string,type:string,value:string>>")
    got = df.select(text.flatten_trace_args(F.col("args"))).first()[0]
    assert got["0_value_a"] == "2" and got["1_value[0]" + "_0" * 39] == "7"


def test_object_fingerprints_are_equal_where_the_objects_are(spark):
    """Both ways to the fingerprint, the cut and the one field by field, against parsed objects."""
    import json

    from watchfold.functions.fingerprints import IGNORED_OBJECT_FIELDS, with_object_fingerprint

    texts = [
        '{"type":"a","id":"1","x":1}', '{"x":1.0,"id":"2","type":"a"}', '{ "type" : "a", "x" : 1 }', '{"x":"1","type":"a"}',
        '{"x":true,"type":"a"}', '{"type":"a","id":"1","x":1,"y":null}', '{"type":"a","in":{"id":"7"},"id":"7"}',
        '{"type":"a","in":{"id":"7"},"id":"8"}', '{"id":"9","type":"a","in":{"id":"7"}}', '{"type":"a","in":{"id":"8"},"id":"8"}',
        '{"id":1,"n":{"id":12},"type":"b"}', '{"id":2,"n":{"id":12},"type":"b"}', '{"id":"only"}', '{}', '{"created":"t"}',
        '{"a":":null","id":"1"}', '{"a":":null","id":"2"}', '{"x":1,"x":2,"type":"a"}', '{"x":2,"type":"a","modified":5}',
        '{"s":"\\u00e9 \\" ,\\"id\\":\\"1\\"","id":"1"}', '{"s":"é \\" ,\\"id\\":\\"1\\"","id":"3"}',
        '{"x":1e5,"id":"1"}', '{"x":1e5}', '{"l":[{"id":"1"},null],"id":"1"}', '{"l":[{"id":"1"},null]}',
        '{"id":null,"x":[]}', '{"x":[]}', '{"id":{"id":"1"},"q":0}', '{"q":0}', '{"spec_version":"2.1","id":"1","q":0,"created":"a","modified":"b"}',
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "no json", "[1]"])], "i int, t string")
    got = {r.i: (r.f, r.k) for r in with_object_fingerprint(rows, "t", "f", "k").collect()}

    def core(text):
        fields = {k: v for k, v in json.loads(text).items() if k not in IGNORED_OBJECT_FIELDS and v is not None}
        return json.dumps(fields, sort_keys=True).replace("1.0", "1").replace("100000.0", "100000")

    for i, a in enumerate(texts):
        assert got[i][1] == json.loads(a).get("type")
        for j, b in enumerate(texts):
            assert (got[i][0] == got[j][0]) == (core(a) == core(b)), (a, b)
    assert all(got[i][0] is None for i in range(len(texts), len(texts) + 3))


def test_the_cases_show_every_policy():
    from watchfold.operators.policies import POLICIES
    from watchfold.plans import oracles, standins

    shown = {"list-syscalls" if n == "L" else n for names in oracles.TAKEN.values() for n in names.split()}
    assert shown == {p.name for p in POLICIES} and len(shown) == 32 and len(standins.POLICY_CASES) == 66


def test_objects_of_plain_fields_are_not_parsed(spark):
    from watchfold.functions import fingerprints

    plain = {
        '{"type":"process","id":"p","pid":7}': '{"pid":7,"type":"process"}',
        '{"spec_version":"2","b":true,"a-b":-12,"type":"x y","a":"","created":"c","modified":"m"}':
            '{"a":"","a-b":-12,"b":true,"type":"x y"}',
        '{"id":"1","type":"i","id":"2"}': '{"type":"i"}',
        '{"id_":"type","type":"id","ids":0}': '{"id_":"type","ids":0,"type":"id"}',
    }
    other = {
        '{"type":"a", "n":1}': '{"n":1,"type":"a"}',
        '{"type":"a","n":1.50}': '{"n":1.5,"type":"a"}',
        '{"type":"a","n":-0}': '{"n":0,"type":"a"}',
        '{"type":"\\u0061","l":[1,2]}': '{"l":[1,2],"type":"a"}',
        '{"type":"a","n":null}': '{"type":"a"}',
        '{"n":1,"type":"a","n":2}': '{"n":2,"type":"a"}',
        '{"type":"b","type":"a"}': '{"type":"a"}',
    }
    rows = spark.createDataFrame([(t, p) for t, p in [*plain.items(), *other.items()]], "t string, p string")
    got = fingerprints.with_object_fingerprint(rows, "t", "f", "kind").withColumn(
        "print", fingerprints._plain_fields(F.col("t"))).collect()
    for r in got:
        assert r.f == hashlib.md5(r.p.encode()).hexdigest(), r.t
        if r.t in plain:
            assert "{" + r.print + "}" == r.p
    assert [r.kind for r in got] == ["process", "x y", "i", "id", *["a"] * 5, "a", "b"]
    long = "{" + ",".join(f'"f{i:05d}":{i}' for i in range(20_000)) + ',"type":"t"}'
    rows = spark.createDataFrame([(long,)], "t string")
    assert fingerprints.with_object_fingerprint(rows, "t", "f", "kind").first().f == hashlib.md5(long.encode()).hexdigest()
