from burnish import operators as op


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_names(spark):
    df = spark.createDataFrame(
        [("  ANNA maria ", "o'NEIL"), ("\tx", ""), (None, "élodie ÉMILE")], "first string, last string"
    )
    assert rows(op.standardize_names(df, ["first", "last"])) == [
        ("Anna Maria", "O'neil"), ("\tx", ""), (None, "Élodie Émile"),
    ]


def test_missing_is_null_and_optionally_blank(spark):
    df = spark.createDataFrame([(None,), ("",), ("  ",), ("a",)], "email string")
    assert [r[1] for r in rows(op.flag_missing(df, "email", "m"))] == [True, False, False, False]
    assert [r[1] for r in rows(op.flag_missing(df, "email", "m", blank_is_missing=True))] == [True, True, True, False]


def test_phone(spark):
    df = spark.createDataFrame(
        [("(555) 010-0042x17",), ("12345",), ("0123456789012",), ("555 X 1",), ("x9",), ("",), (None,)],
        "phone string",
    )
    found = op.normalize_phone(df, "phone").select("phone_digits", "phone_clean")
    assert rows(found) == [
        ("5550100042", "5550100042"), ("12345", "12345"), ("0123456789012", "3456789012"),
        ("5551", "5551"), ("", ""), ("", ""), (None, None),
    ]


def test_split_multivalue(spark):
    df = spark.createDataFrame([("d1;d2",), ("d9;",), (";",), ("",), (None,)], "`device_id(s)` string")
    found = op.split_multivalue(df, "device_id(s)").drop("device_id(s)")
    assert rows(found) == [
        (["d1", "d2"], 2, "d1"), (["d9"], 1, "d9"), ([], 0, None), ([], 0, None), (None, 0, None),
    ]
    literal = op.split_multivalue(df, "device_id(s)", keep_empty=True).drop("device_id(s)")
    assert rows(literal)[1:3] == [(["d9", ""], 2, "d9"), (["", ""], 2, "")]


def test_separator_is_no_pattern(spark):
    df = spark.createDataFrame([("a.b|c",)], "v string")
    assert rows(op.split_multivalue(df, "v", sep="."))[0][1] == ["a", "b|c"]
    assert rows(op.split_multivalue(df, "v", sep="|"))[0][1] == ["a.b", "c"]


def test_label_missing(spark):
    df = spark.createDataFrame([(None,), ("",), ("a",)], "c string")
    assert rows(op.label_missing(df, "c", "(unmapped)")) == [("(unmapped)",), ("",), ("a",)]
