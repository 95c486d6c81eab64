import itertools

from pyspark.sql import functions as F

from palimpsest.functions.values import Value, equal, literal, stored_text, truth


def plain_equal(a, b):
    """The language's equality on Python values."""
    if a is None or b is None:
        return a is None and b is None
    if type(a) is not type(b):
        if {type(a), type(b)} == {int, str}:
            s, n = (a, b) if isinstance(a, str) else (b, a)
            body = s[1:] if s[:1] in ("+", "-") else s
            return body.isascii() and body.isdigit() and int(s) == n
        return False
    if isinstance(a, float):
        return abs(a - b) < 2.220446049250313e-16
    if isinstance(a, str):
        low = lambda s: "".join(c.lower() if c.isascii() else c for c in s)
        long = lambda s: len(s.encode()) >= 6
        return a == b or long(a) and low(b).startswith(low(a)) or long(b) and low(a).startswith(low(b))
    return a == b


TEXTS = ["", "running", "RUNNING-late", "runni", "RUNNI", "abcdef", "ABCDEF", "Éabcde", "éabcde", "éÉé", "ÉÉÉ", "5", "+5", "-5", " 5", "5.0", "true", "１", "99999999999999999999", None]


def test_text_equality(spark):
    pairs = list(itertools.product(TEXTS, TEXTS))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", equal(Value("string", F.col("a")), Value("string", F.col("b"))).alias("e"))
    assert all(r.e is plain_equal(r.a, r.b) for r in df.collect())


def test_literal_equality(spark):
    literals = [("null", None), ("bool", True), ("int", 5), ("int", -5), ("int", 0), ("float", 5.0), ("float", 0.1), ("string", "5")]
    df = spark.createDataFrame([(t,) for t in TEXTS], "a string")
    for kind, value in literals:
        got = df.select("a", equal(Value("string", F.col("a")), literal(kind, value)).alias("e"), equal(literal(kind, value), Value("string", F.col("a"))).alias("f")).collect()
        for r in got:
            assert r.e is r.f is plain_equal(r.a, value), (r.a, value)
    for (k, x), (m, y) in itertools.product(literals, literals):
        assert spark.range(1).select(equal(literal(k, x), literal(m, y))).first()[0] is plain_equal(x, y), (x, y)


def test_truth(spark):
    df = spark.createDataFrame([("",), ("x",), (None,)], "a string")
    assert [r[0] for r in df.select(truth(Value("string", F.col("a")))).collect()] == [False, True, False]
    for kind, value, expected in [("null", None, False), ("bool", False, False), ("int", 0, False), ("int", 2, True), ("float", 0.0, False), ("float", 0.5, True)]:
        assert spark.range(1).select(truth(literal(kind, value))).first()[0] is expected


def test_stored_text():
    cases = [("null", None, ""), ("bool", True, "true"), ("int", -3, "-3"), ("float", 1.0, "1"), ("float", 1e21, "1000000000000000000000"), ("float", 1.5e-7, "0.00000015"), ("float", -0.25, "-0.25"), ("string", "é", "é")]
    for kind, value, expected in cases:
        assert stored_text(kind, value) == expected
