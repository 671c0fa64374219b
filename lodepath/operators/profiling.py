"""Column profiles per load, from unpivoted column-value counts, and comparisons between loads.

Everything is derived from one aggregate, (load, column, value) -> count, which is partially aggregated
before its only shuffle: a hot value or a hot load moves one row per task. Frequencies, distincts, ranges,
medians and shares are then exact and cost no second pass over the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import number_text
from ..session import fits, materialise, small_join, spread

#: Texts longer than this are counted by length and digest, which the profile shows as the most frequent value; ranges are those of the texts themselves.
LONG_TEXT = 128

#: Rows of value counts up to which ranks are taken by a plain window.
RANKED_ROWS = 2_000_000
#: What no value of any column should hold: blanks at an end, control characters, the mark of a character that was lost.
VIOLATION = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ufffd]"
BLANKS = " \t\n\x0b\x0c\r"

_WS, _STR = r"[ \t\n\r]*+", r'"(?:[^"\\\x00-\x1f]++|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+"'
#: A JSON array of strings, by the grammar; from_json() alone also takes single quotes, trailing commas and the like.
STRING_ARRAY = rf"^{_WS}\[{_WS}(?:{_STR}{_WS}(?:,{_WS}{_STR}{_WS})*+)?\]{_WS}$"


def _whole_text(df: DataFrame, c: str) -> Column:
    kind = dict(df.dtypes)[c]
    return F.col(c).cast("string") if kind not in ("binary",) and not kind.startswith(("array", "map", "struct")) else F.xxhash64(c).cast("string")


def _as_text(df: DataFrame, c: str) -> Column:
    text = _whole_text(df, c)
    if dict(df.dtypes)[c] != "string":
        return text
    return F.when(F.length(text) > LONG_TEXT, F.concat(F.lit("#"), F.length(text).cast("string"), F.lit(":"), F.sha2(text, 256))).otherwise(text)


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")]


def value_counts(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by..., column_name, value, n): how often each value, null too, stands in each column. One scan, one shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), _as_text(df, c).alias("value")) for c in columns])
    counted = spread(df.select(*dict.fromkeys([*by, *columns]))).select(*by, F.explode(pairs).alias("_p")).groupBy(*by, "_p.column_name", "_p.value").agg(F.count(F.lit(1)).alias("n"))
    doubles = [c for c in columns if dict(df.dtypes)[c] in ("double", "float")]  # each distinct value is written out once
    return counted.withColumn("value", F.when(F.col("column_name").isin(doubles), number_text(F.col("value").try_cast("double"))).otherwise(F.col("value"))) if doubles else counted


def value_ranges(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by..., column_name, min_value, max_value, violations) of whole texts, however long; one row a group and task moves.

    violations: non-null values that are empty, or have blanks at an end, control characters or U+FFFD.
    """
    named = {f"_{i}": _whole_text(df, c) for i, c in enumerate(columns)}
    odd = lambda c: F.coalesce((c == "") | F.substring(c, 1, 1).isin(list(BLANKS)) | F.substring(c, -1, 1).isin(list(BLANKS)) | c.rlike(VIOLATION), F.lit(False))
    texts = spread(df.select(*dict.fromkeys([*by, *columns]))).select(*by, *[c.alias(n) for n, c in named.items()])
    # an aggregate with a list is hashed, not sorted, whatever it holds beside: so no wide row is ever sorted
    all_ = texts.groupBy(*by).agg(F.collect_list(F.lit(None).cast("int")).alias("_none"), *[f(F.col(n)).alias(n + k) for n in named for k, f in (("l", F.min), ("h", F.max), ("v", lambda c: F.count_if(odd(c))))])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(n + "l").alias("min_value"), F.col(n + "h").alias("max_value"), F.col(n + "v").alias("violations")) for n, c in zip(named, columns, strict=True)]))
    return all_.filter(F.size("_none") == 0).select(*by, each.alias("_p")).select(*by, "_p.*")


def profile(df: DataFrame, by: list[str], columns: list[str], numeric: list[str] = ()) -> DataFrame:
    """One row for each group and column: rows, nulls, null_rate, distincts, min, max, pattern violations and the most frequent value.

    Numeric columns get their range by number (in min_number, max_number; NaN counts as a value and is not in
    the range), others by their whole texts (in min_value, max_value); only the latter have violations. Numbers are shown as 10000000.0 and 1e-05. Ties of the most frequent value go to the smaller one; a long one is
    shown by length and digest. A column without values has nulls for the range. Null groups are groups.
    """
    number = F.when(F.col("column_name").isin(list(numeric)), F.when(F.lower("value") != "nan", F.col("value").try_cast("double")))
    counted = (
        value_counts(df, by, columns)
        .withColumn("number", number)
        .groupBy(*by, "column_name")
        .agg(
            F.sum("n").alias("rows"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
            F.count("value").alias("distincts"),
            F.min("number").alias("min_number"),
            F.max("number").alias("max_number"),
            F.max(F.when(F.col("value").isNotNull(), F.struct("n"))).getField("n").alias("top_count"),
            F.min_by("value", F.when(F.col("value").isNotNull(), F.struct(-F.col("n"), "value"))).alias("top_value"),
        )
        .withColumn("null_rate", F.col("nulls") / F.col("rows"))
    )
    ranges = value_ranges(df, by, [c for c in columns if c not in numeric])
    left, right = counted.alias("a"), ranges.alias("b")
    same = reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "column_name"]])
    return left.join(right, same, "left").select("a.*", "b.min_value", "b.max_value", F.coalesce("b.violations", F.lit(0)).alias("violations"))


def ranked(counts: DataFrame, by: list[str], value: str, n: str = "n", rows: int = RANKED_ROWS) -> DataFrame:
    """counts with _upto, the rows of the group up to and with each value in order, and _all, the rows of the group.

    counts: (by..., value, n), one row for each value. Up to `rows` rows, a plain window. Beyond, the counts are
    cut into ranges, so that no group stays in one task: sums of ranges are added up (as many as there are ranges), and
    windows run within ranges.
    """
    if fits(counts, rows):
        return counts.withColumn("_upto", F.sum(n).over(Window.partitionBy(*by).orderBy(value))).withColumn("_all", F.sum(n).over(Window.partitionBy(*by)))
    parts = max(2, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cut = materialise(counts.repartitionByRange(parts, *by, value).withColumn("_part", F.spark_partition_id()))
    sums = cut.groupBy(*by, "_part").agg(F.sum(n).alias("_own"))
    before = F.sum("_own").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_own")
    sums = sums.withColumn("_before", before).withColumn("_all", F.sum("_own").over(Window.partitionBy(*by))).drop("_own")
    inside = F.sum(n).over(Window.partitionBy(*by, "_part").orderBy(value))
    return small_join(cut.withColumn("_in", inside), sums, [*by, "_part"]).withColumn("_upto", F.col("_before") + F.col("_in")).select(*counts.columns, "_upto", "_all")


def quantiles(counts: DataFrame, by: list[str], value: str, shares: dict[str, float], n: str = "n") -> DataFrame:
    """(by..., one column for each share): exact quantiles, interpolated between the two rows that they fall between."""
    r = ranked(counts, by, value, n)
    out = []
    for name, share in shares.items():
        at = (F.col("_all") - 1) * F.lit(share)
        low = F.min(F.when(F.col("_upto") >= F.floor(at) + 1, F.col(value)))
        high = F.min(F.when(F.col("_upto") >= F.ceil(at) + 1, F.col(value)))
        part = F.max(at - F.floor(at))
        out.append((low * (1 - part) + high * part).alias(name))
    return r.groupBy(*by).agg(*out)


def weighted_median(counts: DataFrame, by: list[str], value: str, n: str = "n") -> DataFrame:
    """(by..., median): the exact median, the mean of the middle two, from value counts."""
    lo, hi = F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1
    return ranked(counts, by, value, n).groupBy(*by).agg(((F.min(F.when(F.col("_upto") >= lo, F.col(value))) + F.min(F.when(F.col("_upto") >= hi, F.col(value)))) / 2).alias("median"))


def _previous(loads: DataFrame, group: str, load: str) -> DataFrame:
    """(load, previous) within each group, in order of load."""
    return loads.select(group, load).distinct().withColumn("previous", F.lag(load).over(Window.partitionBy(group).orderBy(load))).filter("previous is not null").select(load, "previous")


def _sides(counts: DataFrame, pairs: DataFrame, load: str) -> DataFrame:
    """(load, previous, column_name, value, n1, n0): each pair's counts of its load and of the previous one, not yet added up."""
    a = pairs.join(counts, load).select(load, "previous", "column_name", "value", F.col("n").alias("n1"), F.lit(0).cast("long").alias("n0"))
    b = pairs.join(counts.withColumnRenamed(load, "previous"), "previous").select(load, "previous", "column_name", "value", F.lit(0).cast("long").alias("n1"), F.col("n").alias("n0"))
    return a.unionByName(b)


def _compare(sides: DataFrame, load: str, eps: float = 1e-6) -> DataFrame:
    by = [load, "previous", "column_name"]
    each = sides.groupBy(*by, "value").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    total = each.groupBy(*by).agg(F.sum("n1").alias("all1"), F.sum("n0").alias("all0")).filter("all1 > 0 and all0 > 0")
    each = each.join(total, by).withColumns({"p1": F.col("n1") / F.col("all1"), "p0": F.col("n0") / F.col("all0")})
    pooled = (F.col("n0") + F.col("n1")) / (F.col("all0") + F.col("all1"))
    q0, q1 = F.greatest("p0", F.lit(eps)), F.greatest("p1", F.lit(eps))
    return each.groupBy(*by).agg(
        (F.sum(F.abs(F.col("p1") - F.col("p0"))) / 2).alias("half_abs"),
        F.sum(F.pow(F.col("n0") - F.col("all0") * pooled, 2) / (F.col("all0") * pooled) + F.pow(F.col("n1") - F.col("all1") * pooled, 2) / (F.col("all1") * pooled)).alias("chi_square"),
        F.sum((q1 - q0) * F.log(q1 / q0)).alias("psi"),
    )


def share_shift(counts: DataFrame, pairs: DataFrame, load: str, eps: float = 1e-6) -> DataFrame:
    """(load, previous, column_name, half_abs, chi_square, psi) of the shares of values in two loads.

    counts: (load, column_name, value, n) of the values that count; pairs: (load, previous). half_abs is half the
    sum of absolute differences of shares. A load without values in a column has no row for it.
    """
    return _compare(_sides(counts, pairs, load), load, eps)


def quantile_edges(counts: DataFrame, by: list[str], value: str, bins: int) -> DataFrame:
    """(by..., edges): the distinct exact quantiles at 1/bins, 2/bins and so on, from value counts; each is a value that stands there."""
    edges = [F.min(F.when(F.col("_upto") * bins >= F.col("_all") * i, F.col(value))) for i in range(1, bins)]
    return ranked(counts, by, value).groupBy(*by).agg(F.array_distinct(F.array(*edges)).alias("edges"))


def shifts(df: DataFrame, loads: DataFrame, group: str, load: str, columns: list[str], numeric: list[str] = (), bins: int = 10) -> DataFrame:
    """share_shift() of every column over consecutive loads of a group; nulls count as a value of their own.

    Numeric columns are compared by bins: those that the exact quantiles of the previous load bound, a bin holding its
    upper edge. NaN counts as a value of its own. A previous load without numbers has one bin.
    """
    pairs = _previous(loads, group, load)
    counts = materialise(value_counts(df, [load], columns))
    is_number = F.col("column_name").isin(list(numeric)) & F.col("value").isNotNull() & (F.lower("value") != "nan")
    number = F.when(is_number, F.col("value").try_cast("double"))
    numbers = counts.filter(is_number).groupBy(load, "column_name", number.alias("number")).agg(F.sum("n").alias("n"))
    edges = quantile_edges(numbers, [load, "column_name"], "number", bins).withColumnRenamed(load, "previous")
    sides = _sides(counts.withColumn("value", F.coalesce("value", F.lit("\0null"))), pairs, load)
    texts = sides.filter(~F.coalesce(is_number, F.lit(False)) | (F.col("value") == "\0null"))
    binned = sides.filter(is_number & (F.col("value") != "\0null")).withColumn("number", number).join(edges, ["previous", "column_name"], "left")
    below = F.coalesce(F.size(F.filter("edges", lambda e: e < F.col("number"))), F.lit(0))
    return _compare(texts.unionByName(binned.withColumn("value", below.cast("string")).select(*texts.columns)), load)


# --- rules for pay, level and countries ---------------------------------------------------------

#: The seniority levels, exactly as they are to be written.
LEVELS = ["Internship", "Entry Level", "Mid Level", "Senior Level", "Lead", "Director", "Executive"]
PAY_RANGE = (1_000.0, 2_000_000.0)
NULL_SHARE, MEDIAN_RATIO, SHARE_SHIFT = 0.2, 1.4, 0.25
_PAY, _LEVEL, _PLACE = "yearly_min_compensation", "seniority_level", "workplace_countries"
_TINY = 1e-12


def valid_pay(low: Column, high: Column) -> Column:
    return ~F.isnan(low) & low.between(*PAY_RANGE) & (high.isNull() | F.isnan(high) | (low <= high))


def _countries(c: Column) -> Column:
    return F.from_json(F.when(c.rlike(STRING_ARRAY), c), "array<string>")


def with_validity(jobs: DataFrame, codes: DataFrame, row: str, load: str) -> DataFrame:
    """(load, row, column_name, value, number, valid) for each row and each of the three columns.

    A value of countries is judged once: the distinct values are joined to the codes, and the verdict goes back to the
    rows (the codes are a list in the plan only if they are few; see fits()). Extra columns are not read.
    """
    base = jobs.select(load, row, F.col(_PAY).cast("double").alias("pay"), F.col("yearly_max_compensation").cast("double").alias("high"), F.col(_LEVEL).alias("level"), F.col(_PLACE).alias("place"))
    parsed = _countries(F.col("place"))
    known = codes.select(F.col("country_code").alias("code")).filter("code is not null").distinct()
    if fits(known, 10_000):
        listed = F.array(*[F.lit(r[0]) for r in known.collect()]).cast("array<string>")
        good = F.coalesce((F.size(F.array_distinct(parsed)) == F.size(parsed)) & (F.size(F.array_except(parsed, listed)) == 0), F.lit(False))
        base = base.withColumn("place_ok", good)
    else:
        values = base.select("place").filter("place is not null").distinct().withColumn("codes", parsed)
        each = values.filter(F.size("codes") > 0).select("place", F.size("codes").alias("size"), F.explode("codes").alias("code"))
        hits = each.join(known, "code").groupBy("place", "size").agg(F.count_distinct("code").alias("hits")).filter("hits = size").select("place")
        empty = values.filter(F.size("codes") == 0).select("place")
        base = small_join(base, hits.unionByName(empty).withColumn("place_ok", F.lit(True)), ["place"], "left").withColumn("place_ok", F.coalesce("place_ok", F.lit(False)))
    number = F.lit(None).cast("double")
    parts = F.array(
        F.struct(F.lit(_PAY).alias("column_name"), F.col("pay").cast("string").alias("value"), F.col("pay").alias("number"), valid_pay(F.col("pay"), F.col("high")).alias("valid")),
        F.struct(F.lit(_LEVEL).alias("column_name"), F.col("level").alias("value"), number.alias("number"), F.col("level").isin(LEVELS).alias("valid")),
        F.struct(F.lit(_PLACE).alias("column_name"), F.col("place").alias("value"), number.alias("number"), F.col("place_ok").alias("valid")),
    )
    return base.select(load, row, F.explode(parts).alias("_p")).select(load, row, "_p.*")


def offending(checked: DataFrame, row: str, load: str) -> DataFrame:
    """(load, row, column_name): the non-null values that are not valid."""
    return checked.filter(F.col("value").isNotNull() & ~F.coalesce("valid", F.lit(False))).select(load, row, "column_name")


def changed_loads(checked: DataFrame, loads: DataFrame, group: str, load: str) -> DataFrame:
    """(load, column_name) where a column differs from the previous load of its group; see the limits above.

    The previous load is the one before it, in order of id, among the loads of the group that have rows. Medians are compared if both loads have
    valid pay, shares if both have valid values; a load that is in no group is not compared.
    """
    counts = materialise(checked.groupBy(load, "column_name", "value", "number", "valid").agg(F.count(F.lit(1)).alias("n")))
    nulls = counts.groupBy(load, "column_name").agg((F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("nulls"))
    there = nulls.select(load).distinct()
    pairs = _previous(loads.join(there, load, "left_semi"), group, load)
    good = counts.filter("value is not null and valid")
    medians = weighted_median(good.filter(F.col("column_name") == _PAY), [load, "column_name"], "number")
    first = F.when(F.col("column_name") == _PLACE, F.get(_countries(F.col("value")), 0)).otherwise(F.col("value"))
    labels = good.filter(F.col("column_name") != _PAY).withColumn("value", first).filter("value is not null").groupBy(load, "column_name", "value").agg(F.sum("n").alias("n"))

    def both(stats: DataFrame, value: str) -> DataFrame:
        old = stats.select(F.col(load).alias("previous"), "column_name", F.col(value).alias("before"))
        return stats.join(pairs, load).join(old, ["previous", "column_name"]).select(load, "column_name", F.col(value).alias("now"), "before")

    null_moved = both(nulls, "nulls").filter(F.abs(F.col("now") - F.col("before")) >= NULL_SHARE - _TINY)
    pay_moved = both(medians, "median").filter(F.greatest("now", "before") >= MEDIAN_RATIO * F.least("now", "before") - _TINY)
    shares_moved = share_shift(labels, pairs, load).filter(F.col("half_abs") >= SHARE_SHIFT - _TINY)
    return reduce(DataFrame.unionByName, [x.select(load, "column_name") for x in (null_moved, pay_moved, shares_moved)]).distinct()
