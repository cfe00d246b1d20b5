import datetime as dt

import pytest
from pyspark.sql import functions as F

from lettermill.functions import (
    attrs_to_map, binary_newlines, imap_date, imap_quote, maildir_name, message_hash,
    message_length, normalise_newlines, plural, seconds_to_ns, split_message,
)


def one(spark, column, **values):
    schema = ", ".join(
        f"{k} {'binary' if isinstance(v, bytes) else 'bigint' if isinstance(v, int) else 'date' if isinstance(v, dt.date) else 'array<string>' if isinstance(v, list) else 'string'}"
        for k, v in values.items()
    )
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_quote(spark):
    assert one(spark, imap_quote(F.col("s")), s='a"b\\c') == '"a\\"b\\\\c"'


@pytest.mark.parametrize("day,text", [
    (dt.date(1970, 1, 1), "1-Jan-1970"), (dt.date(2024, 9, 14), "14-Sep-2024"),
])
def test_date(spark, day, text):
    assert one(spark, imap_date(F.col("d")), d=day) == text


@pytest.mark.parametrize("text,ns", [
    ("1700000000.123456789", 1700000000123456789), ("1706000000.5", 1706000000500000000),
    ("1.9999999999", 1999999999), ("-1.9999999999", -1999999999), ("0", 0), (" 5 ", 5 * 10**9),
    ("soon", None), ("", None),
])
def test_seconds_to_ns(spark, text, ns):
    assert one(spark, seconds_to_ns(F.col("s")), s=text) == ns


def test_newlines_keep_every_byte(spark):
    raw = bytes(range(256)) + b"\r\n\r\r\n\xff\xfe"
    assert one(spark, binary_newlines(F.col("b")), b=raw) == raw.replace(b"\r\n", b"\n")
    assert one(spark, normalise_newlines(F.col("s")), s="a\r\nb\rc\n") == "a\nb\rc\n"


def test_hash_length_and_name(spark):
    import hashlib

    df = spark.createDataFrame([("é: \n", "body")], "h string, b string")
    row = df.select(
        message_hash(F.col("h"), F.col("b")).alias("hash"),
        message_length(F.col("h"), F.col("b")).alias("length"),
    ).select("*", maildir_name(F.col("hash"), F.lit(2), F.lit("host"), F.col("length")).alias("name")).first()
    digest = hashlib.sha256("é: \nbody".encode()).hexdigest()
    assert (row["hash"], row["length"]) == (digest, 9)
    assert row["name"] == f"IAH_{digest}_2.host,S=9"


@pytest.mark.parametrize("raw,header,body", [
    (b"A: b\n\nbody\xff", b"A: b\n\n", b"body\xff"),
    (b"A: b\r\n\r\nbody\n\nx", b"A: b\r\n\r\n", b"body\n\nx"),
    (b"A: b\n\nx\r\n\r\ny", b"A: b\n\n", b"x\r\n\r\ny"),
    (b"\nbody", b"\n", b"body"), (b"\r\nbody", b"\r\n", b"body"),
    (b"only header\n", b"only header\n", b""), (b"", b"", b""),
])
def test_split_message(spark, raw, header, body):
    got = one(spark, split_message(F.col("r")), r=raw)
    assert (got["header"], got["body"]) == (header, body)


def test_attribute_map(spark):
    got = one(spark, attrs_to_map(F.col("a")), a=["uid", "1", "BODY[HEADER]", "x", "UID", "123"])
    assert got == {"UID": "123", "BODY[HEADER]": "x"}
    assert one(spark, attrs_to_map(F.col("a")), a=[]) == {}
    with pytest.raises(Exception, match="odd number"):
        one(spark, attrs_to_map(F.col("a")), a=["UID"])


def test_plural(spark):
    text = plural(F.col("n"), "%d message", "%d messages")
    assert [one(spark, text, n=n) for n in (0, 1, 2)] == ["0 messages", "1 message", "2 messages"]
