"""Arrow-batched UDFs for what has no built-in: Unicode folding, numbering plans, name relations."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import names, phones

NAME_KEY = T.StructType([T.StructField(n, T.StringType()) for n in names.NameKey._fields])
PHONE_KEY = T.StructType([T.StructField("key", T.StringType()), T.StructField("display", T.StringType()), T.StructField("has_country", T.BooleanType())])


@F.pandas_udf(T.StringType())
def fold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: names.fold(t or ""))


def each(function: Callable, kind: T.DataType = T.StringType()) -> Callable[[Column], Column]:
    """A plain function of one value, or of a struct's fields as a dictionary, over Arrow batches; null stays null."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else function(v))

    @F.pandas_udf(kind)
    def run_rows(values: pd.DataFrame) -> pd.Series:
        return pd.Series([function(r) for r in values.to_dict("records")])

    return lambda column, struct=False: (run_rows if struct else run)(column)


@F.pandas_udf(NAME_KEY)
def _name_key(given: pd.Series, family: pd.Series, formatted: pd.Series, org: pd.Series) -> pd.DataFrame:
    rows = [names.name_key(*(x or "" for x in r)) for r in zip(given, family, formatted, org, strict=True)]
    return pd.DataFrame(rows, columns=["kind", "given", "family", "org"])


def name_key(name: Column, formatted: Column, org: Column) -> Column:
    return _name_key(name["given"], name["family"], formatted, org)


def phone_keys(values: Column, region: str) -> Column:
    """For an array of numbers as saved: keys in the same order, null for what isn't a number."""

    @F.pandas_udf(T.ArrayType(PHONE_KEY))
    def keys(lists: pd.Series) -> pd.Series:
        as_dict = lambda p: None if p is None else p._asdict()
        return lists.map(lambda xs: [as_dict(phones.phone(x or "", region)) for x in xs] if xs is not None else [])

    return keys(values)


@F.pandas_udf(T.StringType())
def _compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
    fields = ["kind", "given", "family", "org"]
    left, right = (list(map(names.NameKey._make, d[fields].itertuples(index=False, name=None))) for d in (a, b))
    known: dict = {}
    out = []
    for pair in zip(left, right, strict=True):
        if pair not in known:
            known[pair] = names.compare(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype=object)


def compare_names(a: Column, b: Column) -> Column:
    return _compare(a, b)


@F.pandas_udf(T.IntegerType())
def damerau_levenshtein(a: pd.Series, b: pd.Series) -> pd.Series:
    from .distance import damerau_levenshtein as distance

    return pd.Series([distance(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    from .distance import jaro_winkler as likeness

    return pd.Series([likeness(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
