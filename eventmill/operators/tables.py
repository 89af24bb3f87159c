"""Statistics tables: rows are populations of samples, columns are statistics, keywords and formulas.

Moments come from one aggregation of the events that each set of populations holds, order
statistics from ``plans.order_statistics``, each figure once however many columns show it. Tables have a row for each sample and
population; everything after the statistics works on these.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventmill.functions.columns import finite
from eventmill.functions.formulas import compile_formula, references
from eventmill.operators.gates import Gate, masks, paths
from eventmill.plans.joins import null_safe_join
from eventmill.plans.order_statistics import percentiles
from eventmill.plans.scratch import materialize

ROOT = "All events"


@dataclass(frozen=True)
class Statistic:
    """A column of a table: a statistic of a channel, or a count or share of events; of ``control``'s row if that is given."""

    name: str
    statistic: str = "count"
    channel: Column | None = None
    percentile: float = 50.0
    control: object = None


def _geometric(v: Column, value: Column) -> Column:
    return F.when(F.min(v) > 0, value)


#: Statistics that one pass gives, of the finite values ``v``.
ONE_PASS = {
    "finite_count": lambda v, p: F.count(v),
    "nonfinite_count": lambda v, p: F.count("*") - F.count(v),
    "mean": lambda v, p: F.avg(v),
    "std": lambda v, p: F.stddev_samp(v),
    "variance": lambda v, p: F.var_samp(v),
    "cv": lambda v, p: 100.0 * F.stddev_samp(v) / F.nullif(F.abs(F.avg(v)), F.lit(0.0)),
    "geometric_mean": lambda v, p: _geometric(v, F.exp(F.avg(F.log(F.when(v > 0, v))))),
    "geometric_std": lambda v, p: _geometric(v, F.exp(F.stddev_samp(F.log(F.when(v > 0, v))))),
    "min": lambda v, p: F.min(v),
    "max": lambda v, p: F.max(v),
}
#: Statistics of order, with the share of values below.
ORDER = {"median": lambda p: 0.5, "percentile": lambda p: p / 100}
#: Statistics that need the median first.
TWO_PASS = {
    "mad": lambda mad, median: mad,
    "robust_cv": lambda mad, median: 148.26 * mad / F.nullif(F.abs(median), F.lit(0.0)),
}
OF_EVENTS = ("count", "percent_parent", "percent_total")
STATISTICS = (*OF_EVENTS, *ONE_PASS, *ORDER, *TWO_PASS)


def default_columns(channel: Column | None = None) -> list[Statistic]:
    """What a table without columns shows."""
    out = [Statistic("Events"), Statistic("% Parent", "percent_parent"), Statistic("% Total", "percent_total")]
    if channel is not None:
        out += [Statistic(k.replace("_", " ").title(), k, channel) for k in ("median", "mean", "robust_cv", "min", "max")]
    return out


def statistics_table(events: DataFrame, sample: str, gates: list[Gate], columns: list[Statistic], root: bool = True) -> DataFrame:
    """``sample, population, path, place`` and a column for each statistic, a row for each sample and population.

    ``place`` numbers the populations in the order of the tree, the root first. Counts are whole numbers; a
    statistic that is undefined is NULL. A population without events has its row.
    """
    for c in columns:
        if c.statistic not in STATISTICS or (c.statistic not in OF_EVENTS and c.channel is None):
            raise ValueError(f"{c.name}: no statistic {c.statistic!r}, or no channel")
    by, names = masks(gates), paths(gates)
    order = [ROOT, *by] if root else [*by]
    parents = {ROOT: None} | {g.name: g.parent or ROOT for g in gates}
    held = F.array_compact(F.array(*[F.lit(ROOT)] * 1, *[F.when(m, F.lit(n)) for n, m in by.items()]))
    # each channel once, by what it is
    channels: dict[str, str] = {}
    for c in columns:
        if c.channel is not None:
            channels.setdefault(str(c.channel), f"__c{len(channels)}")
    of = {k: channels[str(c.channel)] for k, c in enumerate(columns) if c.channel is not None}
    values = {channels[str(c.channel)]: c.channel for c in columns if c.channel is not None}
    rows = materialize(events.select(F.col(sample).alias("sample"), held.alias("held"), *[finite(c).alias(n) for n, c in values.items()]), "channels")
    keys = ["sample", "population"]
    spread = rows.select("sample", F.explode("held").alias("population"), *values)
    one = [ONE_PASS[c.statistic](F.col(of[k]), c.percentile).alias(f"__v{k}") for k, c in enumerate(columns) if c.statistic in ONE_PASS]
    first = spread.groupBy(*keys).agg(F.count("*").alias("__n"), *one)
    two = {k: c for k, c in enumerate(columns) if c.statistic in TWO_PASS}
    for n in values:
        shares = sorted({ORDER[c.statistic](c.percentile) for k, c in enumerate(columns) if c.statistic in ORDER and of[k] == n} | ({0.5} if any(of[k] == n for k in two) else set()))
        if not shares:
            continue
        twice = any(of[k] == n for k in two)
        q = percentiles(spread, keys, F.col(n), shares, twice).select(*keys, F.col("q").alias(f"__q{n}"), *[F.col("mad").alias("__mad")] * twice)
        middle = F.col(f"__q{n}")[shares.index(0.5)] if 0.5 in shares else None
        first = null_safe_join(first, q, keys, "left")
        for k, c in enumerate(columns):
            if c.statistic in ORDER and of[k] == n:
                first = first.withColumn(f"__v{k}", F.col(f"__q{n}")[shares.index(ORDER[c.statistic](c.percentile))])
        if twice:
            for k in (k for k in two if of[k] == n):
                first = first.withColumns({f"__d{k}": F.col("__mad"), f"__m{k}": middle})
            first = first.drop("__mad")
    first = materialize(first, "statistics")
    places = F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(n).alias("population"), F.lit(parents[n]).alias("parent"), F.array(*map(F.lit, () if n == ROOT else names[n])).cast("array<string>").alias("path")) for k, n in enumerate(order)])).alias("p")
    grid = rows.select("sample").distinct().select("sample", places).select("sample", "p.*")
    told = null_safe_join(grid, first, keys, "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    # counts of parents and totals, by conditional sums over the few rows of a sample
    every = first.groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("population", "__n"))).alias("__of"))
    told = null_safe_join(told, every, ["sample"], "left")
    count_of = lambda name: F.coalesce(F.try_element_at("__of", name), F.lit(0))
    out = []
    for k, c in enumerate(columns):
        if c.statistic == "count":
            v = F.col("__n")
        elif c.statistic == "percent_parent":
            v = 100.0 * F.col("__n") / F.nullif(count_of(F.coalesce("parent", F.lit(ROOT))), F.lit(0))
        elif c.statistic == "percent_total":
            v = 100.0 * F.col("__n") / F.nullif(count_of(F.lit(ROOT)), F.lit(0))
        elif c.statistic in TWO_PASS:
            v = TWO_PASS[c.statistic](F.col(f"__d{k}"), F.col(f"__m{k}"))
        elif c.statistic in ("finite_count", "nonfinite_count"):
            v = F.coalesce(f"__v{k}", F.lit(0))
        else:
            v = F.col(f"__v{k}")
        out.append(v.alias(c.name))
    table = told.select("sample", "population", "path", "place", *out)
    for c in columns:
        if c.control is not None:
            table = of_control(table, c.name, c.control)
    return table


def of_control(table: DataFrame, column: str, control: object) -> DataFrame:
    """``table`` where a column has the value of the control sample's row of the same path; NULL if there is none or several."""
    held = table.where(F.col("sample").eqNullSafe(F.lit(control))).groupBy("path").agg(F.max(f"`{column}`").alias("__v"), F.count("*").alias("__k"))
    told = table.join(held.withColumnRenamed("path", "__path"), F.col("path") == F.col("__path"), "left")
    return told.withColumn(column, F.when(F.col("__k") == 1, F.col("__v"))).drop("__path", "__v", "__k")


def canonical_key(key: Column) -> Column:
    return F.lower(F.regexp_replace(key, r"^\$+", ""))


def keyword_column(samples: DataFrame, keywords: DataFrame, key: str, sources: tuple[str, ...] = ("tags", "metadata"), numeric: bool = False) -> DataFrame:
    """``sample, value, issue`` of every sample, from ``keywords(sample, source, key, value)``.

    In each source the exact key counts first, else keys that are equal in lower case without ``$``; several of
    these are an issue. The first source that has any decides. Names may begin with ``tag:`` or ``metadata:``.
    """
    for prefix, source in (("tag:", "tags"), ("metadata:", "metadata")):
        if key.startswith(prefix):
            key, sources = key[len(prefix) :], (source,)
    wanted = keywords.where(F.col("source").isin(*sources) & (canonical_key(F.col("key")) == canonical_key(F.lit(key))))
    exact = F.when(F.col("key") == key, F.col("value"))
    each = wanted.groupBy("sample", "source").agg(F.max(exact).alias("exact"), F.count_if(F.col("key") == key).alias("n_exact"), F.count("*").alias("n"), F.max("value").alias("any"))
    rank = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    first = each.groupBy("sample").agg(F.min_by(F.struct("exact", "n_exact", "n", "any"), rank).alias("r"))
    told = samples.select("sample").join(first, "sample", "left")
    ambiguous = (F.col("r.n_exact") == 0) & (F.col("r.n") > 1)
    value = F.when(~ambiguous, F.when(F.col("r.n_exact") > 0, F.col("r.exact")).otherwise(F.col("r.any")))
    issue = F.when(F.col("r").isNull() | (~ambiguous & value.isNull()), "missing").when(ambiguous, "ambiguous")
    if numeric:
        number = finite(value.try_cast("double"))
        return told.select("sample", number.alias("value"), F.when(issue.isNull() & number.isNull(), "not a number").otherwise(issue).alias("issue"))
    return told.select("sample", value.alias("value"), issue.alias("issue"))


def ordered(table: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """``table`` with ``position``, from 0: by the samples' own ``place``, or their names, then by population.

    The rows before a sample are those of the samples before it, so that only samples are ordered in one window.
    """
    sizes = table.groupBy("sample").agg(F.count("*").alias("__rows"))
    sizes = sizes.join(samples.select("sample", F.col("place").alias("__order")), "sample") if samples is not None else sizes.withColumn("__order", F.col("sample"))
    before = Window.orderBy("__order", "sample").rowsBetween(Window.unboundedPreceding, -1)  # one row a sample
    starts = sizes.select("sample", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("sample").orderBy("place")) - 1
    return table.join(starts, "sample").withColumn("position", F.col("__start") + inside).drop("__start")


def with_formula(table: DataFrame, name: str, expression: str) -> DataFrame:
    """Adds a formula over the columns of a table that has ``position``.

    ``col("x")`` is a column, ``control("x", "sample")`` the value of the same population in a sample, ``row("x", k)`` that of the
    k-th row and ``offset("x", k)`` that of the row k below; ``mean median sum sd n`` are over the finite values of all rows.
    Rows meet by equi-joins on path and position, and whole-table figures are one row. Undefined results are NULL.
    """
    refs = references(expression)
    helpers: dict[tuple, str] = {}
    out = table
    for k, ref in enumerate(sorted(refs, key=str)):
        h = f"__h{k}"
        helpers[ref] = h
        match ref:
            case ("col", c):
                out = out.withColumn(h, F.col(f"`{c}`"))
            case ("control", c, of):
                held = table.where(F.col("sample").cast("string") == of).groupBy("path").agg(F.max(f"`{c}`").alias(h)).withColumnRenamed("path", f"__p{k}")
                out = out.join(held, F.col("path") == F.col(f"__p{k}"), "left").drop(f"__p{k}")
            case ("offset", c, by):
                held = table.select((F.col("position") - by).alias("position"), F.col(f"`{c}`").alias(h))
                out = out.join(held, "position", "left")
            case ("row", c, at):
                held = table.where(F.col("position") == at - 1).agg(F.max(f"`{c}`").alias(h))
                out = out.crossJoin(F.broadcast(held))  # one row
            case (f, inner):
                flat = with_formula(table, "__x", inner).agg(REDUCTIONS[f](finite(F.col("__x").cast("double"))).alias(h))
                out = out.crossJoin(F.broadcast(flat))  # one row
    value = compile_formula(expression, {}, table=lambda ref: F.col(helpers[ref]))
    return out.withColumn(name, F.when(~F.isnan(value), value)).drop(*helpers.values())


REDUCTIONS = {"mean": F.avg, "median": lambda v: F.percentile(v, 0.5), "sum": F.sum, "sd": F.stddev_samp, "n": lambda v: F.count(v).cast("double")}

AGGREGATIONS = {
    "mean": F.avg,
    "median": lambda v: F.percentile(v, 0.5),
    "sum": F.sum,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    "count": F.count,
}


def pivot_measures(table: DataFrame, rows: list[str], columns: list[str], measures: list[str], aggregation: str) -> DataFrame:
    """``rows, columns, measure, value, n``: each pair of a row and a column group that are there, with the finite values' aggregate and count.

    Values of the groups are those of the table, NULL among them; a pair without rows has n 0.
    """
    if not 1 <= len(rows) <= 4 or len(columns) > 3 or not 1 <= len(measures) <= 32:
        raise ValueError("a pivot has 1 to 4 row, 0 to 3 column dimensions and 1 to 32 measures")
    keys = [*rows, *columns]
    cells = [F.struct(F.lit(m).alias("measure"), finite(F.col(f"`{m}`").cast("double")).alias("v")) for m in measures]
    long = table.select(*[F.col(f"`{k}`") for k in keys], F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")
    got = long.groupBy(*keys, "measure").agg(AGGREGATIONS[aggregation](F.col("v")).cast("double").alias("value"), F.count("v").alias("n"))
    left, right = table.select(*rows).distinct(), table.select(*columns).distinct() if columns else None
    names = long.select("measure").distinct()
    # the groups of a table's own values: rows x columns cells are the result
    grid = left.crossJoin(F.broadcast(names)) if right is None else left.crossJoin(F.broadcast(right)).crossJoin(F.broadcast(names))
    for k in [*keys, "measure"]:
        got = got.withColumnRenamed(k, f"__{k}")
    same = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`__{k}`")) for k in [*keys, "measure"]])
    empty = F.lit(0.0) if aggregation == "count" else F.lit(None).cast("double")
    return grid.join(got, same, "left").select(*keys, "measure", F.coalesce("value", empty).alias("value"), F.coalesce("n", F.lit(0)).alias("n"))


MOST_PIVOT_COLUMNS = 512


def widened(pivoted: DataFrame, rows: list[str], columns: list[str]) -> DataFrame:
    """A column for each column group and measure of ``pivot_measures``; more than 512 are refused."""
    label = F.concat_ws(" · ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in columns], "measure")
    named = pivoted.withColumn("__label", label)
    labels = [r[0] for r in named.select("__label").distinct().limit(MOST_PIVOT_COLUMNS + 1).collect()]
    if len(labels) > MOST_PIVOT_COLUMNS:
        raise ValueError("the pivot has more than 512 columns")
    return named.groupBy(*rows).pivot("__label", sorted(labels)).agg(F.first("value"))


def sorted_rows(table: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """Rows in order, text without regard to case, missing values last in both directions; ``input`` keeps or reverses ``position``."""
    if by == "input":
        return table.orderBy(F.desc("position") if descending else F.asc("position"))
    key = F.lower(F.col(f"`{by}`")) if table.schema[by].dataType.simpleString() == "string" else F.col(f"`{by}`")
    return table.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "position")


def page(table: DataFrame, by: str, offset: int, limit: int, descending: bool = False) -> DataFrame:
    """``limit`` rows from ``offset`` on in order, each with the ``total`` of all rows."""
    total = table.agg(F.count("*").alias("total"))
    return sorted_rows(table, by, descending).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row


def column_ranges(table: DataFrame, columns: list[str]) -> DataFrame:
    """``name, least, most`` of the finite values of each column: the ends of its shading."""
    long = table.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), finite(F.col(f"`{c}`").cast("double")).alias("v")) for c in columns])).alias("c")).select("c.*")
    return long.groupBy("name").agg(F.min("v").alias("least"), F.max("v").alias("most"))


def status_tally(table: DataFrame, columns: list[str]) -> DataFrame:
    """``name, message, rows``: how many rows have each message of each status column."""
    long = table.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("message")) for c in columns])).alias("c")).select("c.*")
    return long.where("message IS NOT NULL").groupBy("name", "message").agg(F.count("*").alias("rows"))


def reconciled(computed: DataFrame, reported: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n, reported`` where a reported count differs from the computed one or its population is missing."""
    named = reported.select(*keys, F.col("n").alias("reported"))
    return named.join(computed.select(*keys, "n"), keys, "left").where(~F.col("n").eqNullSafe(F.col("reported"))).select(*keys, "n", "reported")


def safe_text(c: Column) -> Column:
    """Text that no spreadsheet takes for a formula."""
    return F.when(F.regexp_like(F.ltrim(c), F.lit(r"^[=+@\t\r-]")) | F.regexp_like(c, F.lit(r"^[\t\r]")), F.concat(F.lit("'"), c)).otherwise(c)


def export_columns(table: DataFrame, hidden: tuple[str, ...] = (), include_hidden: bool = False) -> DataFrame:
    """The columns that an export shows, its text made safe."""
    kept = [c for c in table.columns if include_hidden or c not in hidden]
    kinds = dict(table.dtypes)
    return table.select(*[(safe_text(F.col(f"`{c}`")) if kinds[c] == "string" else F.col(f"`{c}`")).alias(c) for c in kept])
