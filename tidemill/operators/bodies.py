"""Message headers, part decoding and the choice of the body text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.codec import with_base64_text
from tidemill.functions.markup import LINES, MAIL_DROPPED, texts_of_each

# Record column -> header name.
HEADER_COLUMNS = {
    "sender": "from",
    "recipient": "to",
    "subject": "subject",
    "date": "date",
    "list_unsubscribe": "list-unsubscribe",
    "list_id": "list-id",
}
PLAIN, HTML = "text/plain", "text/html"


def header_map(headers: Column) -> Column:
    """Lower-cased names to values, the last of a repeated name kept."""
    lowered = F.transform(
        F.coalesce(headers, F.array().cast("array<struct<name:string,value:string>>")),
        lambda header: F.struct(F.lower(header["name"]).alias("name"), header["value"].alias("value")),
    )
    named = F.filter(lowered, lambda header: header["name"].isNotNull())
    names = F.array_distinct(F.transform(named, lambda header: header["name"]))
    last = F.transform(
        names,
        lambda name: F.element_at(F.filter(named, lambda header: header["name"] == name), -1)["value"],
    )
    return F.map_from_arrays(names, last)


def normalise_headers(messages: DataFrame) -> DataFrame:
    """Replace ``headers`` (array of name/value) by one column per header in use, "" when missing."""
    mapped = messages.withColumn("_headers", header_map(F.col("headers")))
    values = {
        column: F.coalesce(F.try_element_at("_headers", F.lit(name)), F.lit(""))
        for column, name in HEADER_COLUMNS.items()
    }
    return mapped.withColumns(values).drop("headers", "_headers")


ROOT_MISSING, PARENT_MISSING, REPEATED, NO_ID = "missing root", "missing parent", "repeated part", "missing id"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, within a lambda as well."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _messages(parts: DataFrame, with_text: bool = True) -> DataFrame:
    """One row per message with id: its parts in path order, those to use and the others with a cause.

    The causes follow from the paths; without texts no data is decoded or shuffled.
    """
    kind = F.when((F.length("data") > 0) & F.col("mime_type").isin(PLAIN, HTML), F.col("mime_type"))
    leaves = parts.filter(F.col("message_id").isNotNull()).withColumn("_kind", kind)
    # Only the data of text parts goes any further.
    if with_text:
        decoded = with_base64_text(leaves.withColumn("data", F.when(F.col("_kind").isNotNull(), F.col("data"))), "data", "_own")
    else:
        decoded = leaves.withColumn("_own", F.lit(None).cast("string"))
    node = F.struct(
        F.coalesce("path", F.array().cast("array<int>")).alias("path"),
        F.col("_kind").alias("kind"),
        F.when(F.col("_kind").isNotNull(), F.col("_own")).alias("text"),
    )
    grouped = decoded.groupBy("message_id").agg(F.array_sort(F.collect_list(node)).alias("_nodes"))
    # In path order what a part lies in comes before it: a path is sound if it is the root's or the one it lies in is.
    every = F.array_distinct(F.transform("_nodes", lambda node: node["path"]))
    sound = F.aggregate(
        every, F.array().cast("array<array<int>>"),
        lambda held, path: F.when(
            (F.size(path) == 0) | F.array_contains(held, F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))),
            F.concat(held, F.array(path)),
        ).otherwise(held),
    )
    # One-element inlines: neither the paths nor the test of the root is computed again for each part.
    paths = grouped.select("message_id", "_nodes", F.inline(F.array(F.struct(sound.alias("_sound")))))

    def cause(node: Column, at: Column) -> Column:
        again = (at > 0) & (F.try_element_at("_nodes", at)["path"] == node["path"])
        return (
            F.when(F.size("_sound") == 0, ROOT_MISSING)
            .when(~F.array_contains("_sound", node["path"]), PARENT_MISSING)
            .when(again, REPEATED)
        )

    judged = F.transform("_nodes", lambda node, at: F.struct(node.alias("node"), cause(node, at).alias("cause")))
    return paths.select("message_id", judged.alias("_judged"))


def select_body(parts: DataFrame) -> DataFrame:
    """(message_id, body) from the part tree of each message.

    ``parts`` holds message_id, path (array<int>, [] for the message itself), mime_type
    and data. A plain or html leaf with data is its own text. Otherwise plain children
    and what nested parts resolve to are joined by a newline, in part order; only when
    there are none are the html children joined and converted; else the body is "".

    One shuffle brings a message's parts together; trees of any depth are folded within the row, in the JVM.
    Html alone leaves it, and only what may make the body: that of a part without plain parts beside it. A
    message whose body is html the parser rejects gets NULL. What cannot be used is left out here and listed by
    ``part_rejects``: parts without id, all of a message without root, parts below a missing part, and a part
    delivered again (the first in order of type and text counts).
    """
    usable = F.filter("_judged", lambda item: item["cause"].isNull())
    trees = _messages(parts).withColumn("_used", F.transform(usable, lambda item: item["node"])).filter(F.size("_used") > 0)
    told = trees.withColumn("_parts", _with_html("_used"))
    html = F.transform("_parts", lambda part: part["html"])
    # A message without html to convert sends nothing.
    asked = F.when(F.exists("_parts", lambda part: part["html"].isNotNull()), html)
    return told.withColumn("_texts", texts_of_each(asked, MAIL_DROPPED, LINES)).select("message_id", _folded("_parts", "_texts").alias("body"))


def _with_html(nodes: str) -> Column:
    """Parts in path order: depth, kind, text, whether there are parts below, and the html that may have to be converted."""

    def told(node: Column) -> Column:
        depth = F.size(node["path"])
        inside = F.filter(nodes, lambda other: (F.size(other["path"]) == depth + 1) & (F.slice(other["path"], F.lit(1), depth) == node["path"]))
        return _bound(inside, lambda below: with_parts(node, depth, below))

    def with_parts(node: Column, depth: Column, below: Column) -> Column:
        plain = F.exists(below, lambda other: other["kind"].eqNullSafe(PLAIN))
        markup = F.filter(below, lambda other: other["kind"].eqNullSafe(HTML))
        own = node["kind"].eqNullSafe(HTML) & ((depth == 0) | (F.size(below) > 0))
        joined = node["kind"].isNull() & ~plain & (F.size(markup) > 0)
        return F.struct(
            depth.alias("depth"), node["kind"].alias("kind"), node["text"].alias("text"), (F.size(below) > 0).alias("inner"),
            F.when(own, node["text"]).when(joined, F.array_join(F.transform(markup, lambda other: other["text"]), "\n")).alias("html"),
        )

    return F.transform(nodes, told)


def _folded(parts: str, texts: str) -> Column:
    """The body from parts in path order and the converted html of each: a stack machine from the last part to the first.

    Read backwards, all parts below a part come before it. ``levels`` holds, for each depth, the texts of the parts
    read since the last part one level up: what that part will join.
    """
    none = F.array().cast("array<string>")
    start = F.struct(
        F.create_map().cast("map<int,array<string>>").alias("levels"), F.lit("").alias("body"), F.lit(False).alias("unreadable")
    )
    backwards = F.reverse(F.transform(parts, lambda part, at: F.struct(part.alias("part"), F.get(F.col(texts), at).alias("converted"))))

    def given_below(state: Column, depth: Column) -> Column:
        return F.coalesce(F.try_element_at(state["levels"], depth + 1), none)

    def step(state: Column, item: Column) -> Column:
        part, depth = item["part"], item["part"]["depth"]
        below = given_below(state, depth)
        by_html = part["kind"].eqNullSafe(HTML) & part["html"].isNotNull() | (part["kind"].isNull() & (F.size(below) == 0))
        result = (
            F.when(part["kind"] == PLAIN, part["text"])
            .when(by_html, F.coalesce(item["converted"], F.lit("")))
            .when(part["kind"].isNull(), F.array_join(below, "\n")).otherwise(F.lit(""))
        )
        return _bound(result, lambda result: moved(state, item, result))

    def moved(state: Column, item: Column, result: Column) -> Column:
        part, depth = item["part"], item["part"]["depth"]
        by_html = part["kind"].eqNullSafe(HTML) & part["html"].isNotNull() | (part["kind"].isNull() & (F.size(given_below(state, depth)) == 0))
        given = F.concat(
            F.when(part["kind"].eqNullSafe(PLAIN), F.array(part["text"])).otherwise(none),
            F.when(part["inner"] & (result != ""), F.array(result)).otherwise(none),
        )
        beside = F.coalesce(F.try_element_at(state["levels"], depth), none)
        others = F.map_filter(state["levels"], lambda level, _: (level != depth) & (level != depth + 1))
        return F.struct(
            F.map_concat(others, F.create_map(depth, F.concat(given, beside))).alias("levels"),
            result.alias("body"),
            (state["unreadable"] | (by_html & part["html"].isNotNull() & item["converted"].isNull())).alias("unreadable"),
        )

    return F.aggregate(backwards, start, step, lambda state: F.when(~state["unreadable"], state["body"]))


def part_rejects(parts: DataFrame) -> DataFrame:
    """(message_id, path, cause) of the parts that ``select_body`` cannot use."""
    bad = F.filter("_judged", lambda item: item["cause"].isNotNull())
    nameless = parts.filter(F.col("message_id").isNull()).select("message_id", "path", F.lit(NO_ID).alias("cause"))
    return (
        _messages(parts, with_text=False).select("message_id", F.explode(bad).alias("_item"))
        .select("message_id", "_item.node.path", "_item.cause").unionByName(nameless)
    )
