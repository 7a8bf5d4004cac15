"""Triage: a pattern cascade, then a type lookup for the samples it leaves open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesift.functions.text import bind, decode_lossy
from pagesift.operators.joins import BROADCAST_BYTES, equi_join, measured_bytes
from pagesift.session import materialise, stored

# The folder of each triage code and of each lookup result.
ROUTES = {
    3: "html/script",
    22: "html/html_script",
    23: "html/html_head",
    24: "html/html_body",
    12: "html/doctype_html",
    1: "html/doctype",
    2: "lookup",
    0: "no_html/no_match_by_re",
}
LOOKUP_NO_FILE = "uncertain/no_file"
LOOKUP_NO_TYPE = "uncertain/no_type"
LOOKUP_HTML = "html/judge_by_vt"
LOOKUP_NO_HTML = "no_html/judge_by_vt"

CODE_LOOKUP = 2
CODE_SCRIPT = 3


def _find(needle: str, text: Column, start: Column | int) -> Column:
    begin = start if isinstance(start, Column) else F.lit(start)
    return F.position(F.lit(needle), text, begin)


def _has_element(lowered: Column, tag: str) -> Column:
    """An opening tag, a later > and a later closing tag, found in linear time."""
    opened = _find(f"<{tag}", lowered, 1)
    closed = _find(">", lowered, opened + len(tag) + 1)
    return (opened > 0) & (closed > 0) & (_find(f"</{tag}>", lowered, closed + 1) > 0)


def _unquoted(tag: str) -> str:
    """The tag, not directly after a quote or slash."""
    return rf"""(?:^|[^"'/]){tag}"""


def _cascade(lowered: Column) -> Column:
    html_tag = lowered.rlike(_unquoted(r"<html[^\n>]*+>"))
    first_close = _find(">", lowered, _find("<script", lowered, 1) + 7)
    is_script = (
        lowered.rlike(r"^[ \t\n\x0B\f\r]*+<script")
        & (first_close > 0)
        & (_find("</script>", lowered, first_close + 2) > 0)
    )
    return (
        F.when(
            lowered.rlike(_unquoted("<!doctype html")),
            F.when(html_tag, 12).otherwise(1),
        )
        .when(
            html_tag,
            F.when(_has_element(lowered, "script"), 22)
            .when(_has_element(lowered, "head"), 23)
            .when(_has_element(lowered, "body"), 24)
            .otherwise(CODE_LOOKUP),
        )
        .when(is_script, CODE_SCRIPT)
        .otherwise(0)
    )


def with_triage_code(samples: DataFrame, content: str = "content") -> DataFrame:
    """Adds `code`. Null content is code 0."""
    text = F.col(content)
    if samples.schema[content].dataType.simpleString() == "binary":
        text = decode_lossy(text)
    return samples.withColumn("code", bind(F.lower(text), _cascade))


def route_of_code(code: Column) -> Column:
    chosen = F
    for value, route in ROUTES.items():
        chosen = chosen.when(code == value, F.lit(route))
    return chosen.otherwise(F.lit(None).cast("string"))


def lookup_routes(types: DataFrame) -> DataFrame:
    """(sha1, routes): the distinct routes a type table gives each SHA1, at most three."""
    route = (
        F.when(F.col("file_type") == "", LOOKUP_NO_TYPE)
        .when(F.col("file_type") == "HTML", LOOKUP_HTML)
        .otherwise(LOOKUP_NO_HTML)
    )
    return (
        types.filter(F.col("sha1").isNotNull())
        .withColumn("file_type", F.coalesce("file_type", F.lit("")))
        .groupBy("sha1")
        .agg(F.sort_array(F.collect_set(route)).alias("routes"))
    )


def _looked_up(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., code, route) of rows joined with their lookup routes."""
    routes = F.when(
        F.col("code") == CODE_LOOKUP,
        F.coalesce(F.col("routes"), F.array(F.lit(LOOKUP_NO_FILE))),
    ).otherwise(F.array(route_of_code(F.col("code"))))
    return rows.select(*keep, "code", F.explode_outer(routes).alias("route"))


def triage_routes(
    samples: DataFrame,
    types: DataFrame,
    keep: list[str],
    sha1: str = "sha1",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """(keep..., code, route). A sample whose SHA1 has several types gets several routes.

    A type table of measured small size is broadcast and no sample is shuffled. A larger one
    is first reduced to the SHA1s of samples that need it, one row each on both sides, which
    usually makes it small. If not, only the samples that need the lookup are shuffled.
    """
    coded = with_triage_code(samples).select(*keep, "code", F.col(sha1).alias("_sha1"))
    routes = lookup_routes(types).withColumnRenamed("sha1", "_sha1")
    open_rows = coded.filter(F.col("code") == CODE_LOOKUP)
    if measured_bytes(types) > broadcast_bytes:
        # several jobs need the codes: the cascade reads the samples once
        coded = stored(coded, "coded")
        open_rows = coded.filter(F.col("code") == CODE_LOOKUP)
        wanted = open_rows.select("_sha1").distinct()
        routes = materialise(routes.join(wanted, "_sha1", "left_semi"))
        if measured_bytes(routes) > broadcast_bytes:
            found = equi_join(open_rows, routes, "_sha1", "left", keep[0], broadcast_bytes)
            settled = coded.filter(F.col("code") != CODE_LOOKUP)
            return _looked_up(found, keep).unionByName(
                settled.select(*keep, "code", route_of_code(F.col("code")).alias("route"))
            )
    key = F.when(F.col("code") == CODE_LOOKUP, F.col("_sha1"))
    joined = coded.withColumn("_sha1", key).join(F.broadcast(routes), "_sha1", "left")
    return _looked_up(joined, keep)


def triage_summary(routed: DataFrame) -> DataFrame:
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("samples"))


def script_count(coded: DataFrame) -> DataFrame:
    return coded.agg(F.count_if(F.col("code") == CODE_SCRIPT).alias("script_count"))
