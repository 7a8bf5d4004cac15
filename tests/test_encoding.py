import pytest
from pyspark.sql import functions as F

from pagesift.functions import encoding as enc

BODY = "<html>hello world</html>"


def detect(spark, contents, **options):
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "i int, c binary")
    detected = enc.detect_encoding(F.col("c"), **options)
    df = df.withColumn("e", detected)
    df = df.withColumn("n", enc.narrow_encoding(F.col("c"), F.col("e")))
    return [(r["e"], bytes(r["n"])) for r in df.orderBy("i").collect()]


@pytest.mark.parametrize(
    "codec, name",
    [
        ("utf-16-be", enc.UTF_16_BE),
        ("utf-16-le", enc.UTF_16_LE),
        ("utf-32-be", enc.UTF_32_BE),
        ("utf-32-le", enc.UTF_32_LE),
        ("ascii", enc.UNKNOWN),
    ],
)
def test_wide_content_is_narrowed(spark, codec, name):
    assert detect(spark, [BODY.encode(codec)]) == [(name, BODY.encode())]


def test_default_strip_set_holds_backslash_and_s_but_no_space(spark):
    assert detect(spark, [b"\\s\t\r\nscript", b" s"]) == [
        (enc.UNKNOWN, b"cript"),
        (enc.UNKNOWN, b" s"),
    ]


def test_short_and_empty_content_stays_unknown(spark):
    assert [e for e, _ in detect(spark, [b"", b"\0", b"\0a", b"a\0"])] == [enc.UNKNOWN] * 4


def test_byte_marks_count_only_on_request(spark):
    content = b"\xff\xfe" + "x".encode("utf-16-le")
    assert detect(spark, [content])[0][0] == enc.UNKNOWN
    assert detect(spark, [content], bom=True)[0][0] == enc.UTF_16_LE


def test_ragged_tail_keeps_the_stride(spark):
    content = BODY.encode("utf-32-be") + b"\0\0"
    assert detect(spark, [content])[0][1] == content[3::4]
    content = BODY.encode("utf-16-le") + b"z"
    assert detect(spark, [content])[0][1] == content[0::2]
