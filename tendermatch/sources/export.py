"""Typed feature export, inspection and search.

Each row becomes ``map<feature, struct<kind, ints, floats, bytes>>``:

* integral / boolean -> kind ``int64``; float / double -> ``float``;
* array columns and strings holding a JSON list: all integral or boolean ->
  ``int64`` (exact over all 64 bits), all numeric -> ``float``, otherwise the
  list text as ``bytes``; a string
  that looks like a list but does not parse stays a string (``bytes``);
* other strings -> ``bytes`` (never parsed as numbers); other types, decimals
  among them -> their text as ``bytes``;
* NULL, NaN and empty lists are omitted.

The map is built JVM-side with ``map_filter``; it is written as Parquet/JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURE_TYPE = "struct<kind:string,ints:array<bigint>,floats:array<double>,bytes:string>"


def _null_feature() -> Column:
    return F.lit(None).cast(FEATURE_TYPE)


def _feature(kind: str | Column, ints=None, floats=None, text=None) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
                    (ints if ints is not None else F.lit(None)).cast("array<bigint>").alias("ints"),
                    (floats if floats is not None else F.lit(None)).cast("array<double>").alias("floats"),
                    (text if text is not None else F.lit(None)).cast("string").alias("bytes"))


def _list_feature(ints: Column, nums: Column) -> Column:
    """Feature of a parsed numeric list: 64-bit integers where all elements are, floats where one is not."""
    exact = ints.isNotNull() & F.forall(ints, lambda x: x.isNotNull())
    whole = F.forall(nums, lambda x: (x == F.floor(x)) & (F.abs(x) <= 2 ** 53))
    return (F.when(F.size(nums) == 0, _null_feature())
            .when(exact, _feature("int64", ints=ints))
            .when(whole, _feature("int64", ints=F.transform(nums, lambda x: x.cast("long"))))
            .otherwise(_feature("float", floats=nums)))


def _nums_col(col: str) -> str:
    return f"_tm_{col}_nums"


def _ints_col(col: str) -> str:
    return f"_tm_{col}_ints"


def typed_value(col: str, dtype: T.DataType) -> Column:
    """V14 for one column (string columns need ``parse_lists`` first)."""
    c = F.col(col)
    if isinstance(dtype, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.when(c.isNotNull(), _feature("int64", ints=F.array(c.cast("long"))))
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        d = c.cast("double")
        return F.when(d.isNotNull() & ~F.isnan(d), _feature("float", floats=F.array(d)))
    if isinstance(dtype, T.ArrayType):
        el = dtype.elementType
        if isinstance(el, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return F.when(F.size(c) > 0, _feature("int64", ints=c))
        if isinstance(el, (T.FloatType, T.DoubleType)):
            nums = c.cast("array<double>")
            ok = F.forall(nums, lambda x: x.isNotNull())
            return F.when((F.size(c) > 0) & ok, _list_feature(F.lit(None).cast("array<bigint>"), nums)).when(
                F.size(c) > 0, _feature("bytes", text=F.to_json(c)))
        return F.when(F.size(c) > 0, _feature("bytes", text=F.to_json(c)))
    if isinstance(dtype, T.StringType):
        nums = F.col(_nums_col(col))
        numeric = nums.isNotNull() & F.forall(nums, lambda x: x.isNotNull())
        # an empty list parses as an empty numeric list -> omitted
        return (F.when(c.isNull(), _null_feature())
                .when(numeric, _list_feature(F.col(_ints_col(col)), nums))
                .otherwise(_feature("bytes", text=c)))
    return F.when(c.isNotNull(), _feature("bytes", text=c.cast("string")))


def parse_lists(df: DataFrame, cols: list[str]) -> DataFrame:
    """Parse list-looking strings once per row (only rows that start with '[' and end with ']'): as 64-bit integers,
    which stay exact, and as doubles. In a list without strings true and false are the integers 1 and 0."""
    def parsed(c: str, kind: str) -> Column:
        s = F.trim(F.col(c))
        bare = F.when(s.contains('"'), s).otherwise(F.regexp_replace(F.regexp_replace(s, r"\btrue\b", "1"), r"\bfalse\b", "0"))
        return F.when(s.startswith("[") & s.endswith("]"), F.from_json(bare, f"array<{kind}>"))
    return df.select("*", *[parsed(c, "double").alias(_nums_col(c)) for c in cols], *[parsed(c, "bigint").alias(_ints_col(c)) for c in cols])


def typed_features(df: DataFrame, exclude: tuple = ()) -> DataFrame:
    """One ``features`` map per row (NULL features dropped)."""
    cols = [f for f in df.schema.fields if f.name not in exclude]
    df = parse_lists(df, [f.name for f in cols if isinstance(f.dataType, T.StringType)])
    m = F.map_from_arrays(F.array(*[F.lit(f.name) for f in cols]),
                          F.array(*[typed_value(f.name, f.dataType) for f in cols]))
    return df.select(*[F.col(c) for c in exclude], F.map_filter(m, lambda k, v: v.isNotNull()).alias("features"))


def typed_long(df: DataFrame, exclude: tuple = ()) -> DataFrame:
    """S16 in long form: one row per (record, present feature) with its typed value.

    One typed struct column per feature, then ``unpivot`` (codegen'd Expand)
    and a filter on absent features: cheaper than exploding per-row maps or
    arrays when features are inspected in bulk.
    """
    cols = [f for f in df.schema.fields if f.name not in exclude]
    df = parse_lists(df, [f.name for f in cols if isinstance(f.dataType, T.StringType)])
    wide = df.select(*[F.col(c) for c in exclude],
                     *[typed_value(f.name, f.dataType).cast(FEATURE_TYPE).alias(f.name) for f in cols])
    long = wide.unpivot(list(exclude), [f.name for f in cols], "feature", "v")
    return long.where(F.col("v").isNotNull()).select(*exclude, "feature", "v.*")


def write_typed(df: DataFrame, path: str, exclude: tuple = (), compression: str = "gzip") -> None:
    """The typed records as compressed Parquet, one ``features`` map per record."""
    typed_features(df, exclude).write.mode("overwrite").option("compression", compression).parquet(path)


def long_form(records: DataFrame, exclude: tuple = ()) -> DataFrame:
    """Records (as written by ``write_typed``) as one row per present feature."""
    return records.select(*exclude, F.explode("features").alias("feature", "v")).select(*exclude, "feature", "v.*")


def untyped(feature: str | Column) -> Column:
    """Single element unwrapped, lists kept, bytes decoded as text."""
    f = F.col(feature) if isinstance(feature, str) else feature
    ints, floats = f["ints"], f["floats"]
    return (F.when(f["kind"] == "int64", F.when(F.size(ints) == 1, ints[0].cast("string")).otherwise(F.to_json(ints)))
            .when(f["kind"] == "float", F.when(F.size(floats) == 1, floats[0].cast("string"))
                  .otherwise(F.to_json(floats)))
            .otherwise(f["bytes"]))


def inspect_schema(long: DataFrame, rec_col: str = "rec_no") -> DataFrame:
    """S17 over ``typed_long`` output: feature name, first-seen kind (in record order), records carrying it."""
    return long.groupBy("feature").agg(F.min_by(F.col("kind"), F.col(rec_col)).alias("kind"),
                                       F.count(F.lit(1)).alias("n_records"))


def inspect_records(records: DataFrame, n: int = 5, width: int = 50, rec_col: str = "rec_no") -> DataFrame:
    """The features of the first ``n`` records (by record number) as text clipped to ``width`` characters."""
    first = records.orderBy(rec_col).limit(n)
    text = untyped(F.col("v"))
    shown = F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)
    return first.select(rec_col, F.explode("features").alias("feature", "v")).select(
        rec_col, "feature", F.col("v.kind").alias("kind"), shown.alias("shown"))


def search(records: DataFrame, key: str, value: bool | int | float | str, max_results: int = 10, rec_col: str = "rec_no") -> DataFrame:
    """First ``max_results`` records (by record number) whose feature ``key`` equals ``value``. Values compare with
    their type: an integer only with integers, a float with floats, text with text."""
    f = F.col("features")[key]
    if isinstance(value, (bool, int)):
        hit = (f["kind"] == "int64") & (F.size(f["ints"]) == 1) & (f["ints"][0] == F.lit(int(value)))
    elif isinstance(value, float):
        hit = (f["kind"] == "float") & (F.size(f["floats"]) == 1) & (f["floats"][0] == F.lit(value))
    else:
        hit = (f["kind"] == "bytes") & (f["bytes"] == F.lit(value))
    return records.where(hit).orderBy(rec_col).limit(max_results)
