"""Files that hold ONE JSON object, as ``json.dump(..., indent=...)`` writes them (SRC4, SNK5).

Reading (``read_members``): such a file has a member per line or, for nested
values, per run of lines, and a string never holds a raw line break. So a line
break, the indentation of the outermost level and a quote stand only where a
member begins. That string is given to the text source as its record separator:
the scan stays splittable, each record is one member, and no task holds the
object. The first record is the opening brace, the last one ends with the closing
brace; parts of a file that was cut between members are read alike.

Writing (``write_nested``): lists of values below nested keys, as many levels
as there are key columns. Rows are range-partitioned by keys and value; a row
writes the brackets that open where its keys differ from the row before it, and
those that close where they differ from the row after it. For the first and last
row of a task's range these neighbours come from a table of one row per range. Every range
is a part file; the parts one after the other are the object. ``read_nested``
reads it back the same way: keys are carried on from the lines that name them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalframe.operators.ranking import numbered
from evalframe.session import materialize

INDENT = 2


def _place() -> list[Column]:
    """Order of records in a file: the split they were read from, then the order in it."""
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]


def read_members(spark: SparkSession, path: str, value_type: T.DataType | str, indent: int = INDENT) -> DataFrame:
    """SRC4: ``(file, block, at, key, value)`` of the members of all objects below ``path``, as they stand there.

    ``value_type`` is the declared type of the values. ``(block, at)`` orders the members of a file. A record
    that is no member of that type raises, as does an object that is not indented.
    """
    if isinstance(value_type, str):
        value_type = T._parse_datatype_string(value_type)
    raw = spark.read.option("lineSep", "\n" + " " * indent + '"').text(path).select(*_place(), "value")
    body = F.regexp_replace("value", "^ {%d}\"(?!: )" % indent, "")  # the first member of a part has no line break before it
    body = F.regexp_replace(F.regexp_replace(body, r"\n\}\s*$", ""), r",?\s*$", "")
    members = raw.select("file", "block", "at", body.alias("body")).filter(~F.col("body").rlike(r"^\s*(\{\s*\}?|\})?\s*$"))
    parsed = F.map_entries(F.from_json(F.concat(F.lit('{"'), F.col("body"), F.lit("}")), T.MapType(T.StringType(), value_type), {"mode": "FAILFAST"}))
    whole = F.when(F.size(parsed) == 1, F.get(parsed, F.lit(0))).otherwise(
        F.raise_error(F.concat(F.lit("no member of an indented object: "), F.col("body"))))
    return members.select("file", "block", "at", whole.alias("m")).select("file", "block", "at", "m.key", "m.value")


def read_object(spark: SparkSession, path: str, value_type: T.DataType | str, indent: int = INDENT) -> DataFrame:
    """``(key, value)`` with the last member of each key, as a dictionary keeps it."""
    m = read_members(spark, path, value_type, indent)
    return m.groupBy("key").agg(F.max_by("value", F.struct("file", "block", "at")).alias("value"))


def _quoted(c: Column) -> Column:
    """A string as JSON text; characters beyond ASCII stay, null is ``null``."""
    one = F.to_json(F.struct(c.alias("s")), {"ignoreNullFields": "false"})
    return F.substring(one, F.lit(len('{"s":') + 1), F.length(one) - len('{"s":}'))


def _with_neighbours(x: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Numbered rows with the keys of the row ``before`` and the row ``after`` each (null at either end)."""
    x = x.withColumn("own", F.struct(*keys))
    ends = x.groupBy("part").agg(F.min_by("own", "at").alias("first"), F.max_by("own", "at").alias("last"))
    along = Window.orderBy("part")  # one row per range
    ends = ends.select("part", F.lag("last").over(along).alias("prior"), F.lead("first").over(along).alias("next"))
    inside = Window.partitionBy("part").orderBy("at")  # a range of rows, not a group
    return x.join(ends, "part").withColumn("before", F.coalesce(F.lag("own").over(inside), "prior")).withColumn(
        "after", F.coalesce(F.lead("own").over(inside), "next"))


def _write_parts(lines: DataFrame, path: str) -> None:
    """A folder per range, named so that names sort as ranges do, each with one file of its lines in order."""
    if lines.isEmpty():
        lines = lines.sparkSession.createDataFrame([(0, 0, "{}")], "part int, at long, value string")
    named = lines.select(F.format_string("%07d", "part").alias("part"), "at", "value")
    (named.repartition("part").sortWithinPartitions("part", "at").select("part", "value")
     .write.mode("overwrite").partitionBy("part").text(path))


def write_object(df: DataFrame, path: str, key: str, value: str, indent: int = INDENT) -> None:
    """One object ``key -> value``, a member per line, ordered by key. A repeated key raises; an empty table gives ``{}``."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    text = _quoted(F.col(value)) if isinstance(df.schema[value].dataType, T.StringType) else F.to_json(value, {"ignoreNullFields": "false"})
    x = _with_neighbours(numbered(df.select(name.alias("k"), text.alias("text")), ["k"]), ["k"])
    line = F.concat(F.when(F.col("before").isNull(), "{\n").otherwise(""), F.lit(" " * indent), _quoted(F.col("k")), F.lit(": "),
                    F.coalesce("text", F.lit("null")), F.when(F.col("after").isNull(), "\n}").otherwise(","))
    line = F.when(F.col("after.k") == F.col("k"), F.raise_error(F.concat(F.lit("repeated key: "), F.col("k")))).otherwise(line)
    _write_parts(x.select("part", "at", line.alias("value")), path)


def write_nested(df: DataFrame, path: str, levels: Sequence[str], value: str, indent: int = INDENT) -> None:
    """SNK5: one object ``level -> level -> ... -> [values]``, laid out as ``json.dump(..., indent=indent)`` does.

    Keys are ordered by their bytes, values within their list too; null keys are
    named ``null``, null values are ``null``, repeated rows stay. An empty table
    gives ``{}``. No list, however long, is in one row or one task.
    """
    n, names = len(levels), [f"k{i}" for i in range(len(levels))]
    rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(k) for c, k in zip(levels, names)], F.col(value).cast("string").alias("v"))
    x = _with_neighbours(numbered(rows, [*names, "v"]), names)

    def pad(depth: int) -> str:
        return " " * (indent * depth)

    def differs(other: str) -> Column:
        """The first level at which a neighbour differs, ``n`` if none does, 0 without a neighbour."""
        c = F.when(F.col(other).isNull(), 0)
        for i, k in enumerate(names):
            c = c.when(F.col(f"{other}.{k}") != F.col(k), i)
        return c.otherwise(n)

    def only(cond: Column, *text) -> Column:
        return F.when(cond, F.concat(*[F.lit(t) if isinstance(t, str) else t for t in text])).otherwise("")

    x = x.withColumn("up", differs("before")).withColumn("down", differs("after"))
    up, down, more = F.col("up"), F.col("down"), F.col("after").isNotNull()
    parts = [only(F.col("before").isNull(), "{\n")]
    parts += [only(up <= i, pad(i + 1), _quoted(F.col(k)), ": {\n" if i < n - 1 else ": [\n") for i, k in enumerate(names)]
    parts += [F.lit(pad(n + 1)), _quoted(F.col("v")), only(down == n, ",")]
    parts += [only(down <= i, "\n" + pad(i + 1) + ("}" if i < n - 1 else "]"), only((down == i) & more, ",")) for i in reversed(range(n))]
    parts.append(only(~more, "\n}"))
    _write_parts(x.select("part", "at", F.concat(*parts).alias("value")), path)


def read_nested(spark: SparkSession, path: str, levels: Sequence[str], value: str, indent: int = INDENT) -> DataFrame:
    """The rows ``(*levels, value)`` of such an object, whole or in parts, from any splits of its lines."""
    n = len(levels)
    lines = spark.read.text(path).select(*_place(), "value")

    def text(depth: int, after: str) -> Column:
        found = F.regexp_extract("value", '^ {%d}("(?:[^"\\\\]|\\\\.)*"|null)%s$' % (indent * depth, after), 1)
        return F.get(F.from_json(F.concat(F.lit("["), F.nullif(found, F.lit("")), F.lit("]")), "array<string>"), F.lit(0))

    is_value = F.col("value").rlike('^ {%d}("|null)' % (indent * (n + 1)))
    named = [text(i + 1, r": [\{\[]").alias(f"k{i}") for i in range(n)]
    x = materialize(lines.select("file", "block", "at", *named, is_value.alias("is_value"), text(n + 1, ",?").alias("v")), "json-lines")
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    along = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    ends = x.groupBy("file", "block").agg(*[F.max_by(f"k{i}", F.when(F.col(f"k{i}").isNotNull(), F.col("at"))).alias(f"k{i}") for i in range(n)])
    ends = ends.select("file", "block", *[F.last(f"k{i}", ignorenulls=True).over(along).alias(f"c{i}") for i in range(n)])
    own = x.select("file", "block", "is_value", "v", *[F.last(f"k{i}", ignorenulls=True).over(inside).alias(f"k{i}") for i in range(n)])
    own = own.filter("is_value").join(ends, ["file", "block"])
    return own.select(*[F.coalesce(f"k{i}", f"c{i}").alias(c) for i, c in enumerate(levels)], F.col("v").alias(value))
