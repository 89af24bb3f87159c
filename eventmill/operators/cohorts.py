"""Pooled cohorts: members by group and filter, mapped populations, shared parameters, merged events with their origins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventmill.operators.gates import Gate, masks, paths, text_filter
from eventmill.plans.blocks import SIZE, with_previous


def members(samples: DataFrame, group: DataFrame | None = None, needle: str = "") -> DataFrame:
    """``samples(sample, name, tags)`` of a group ``(sample, position)`` that hold a text in their name or tag values, in the group's order."""
    held = samples.where(text_filter(needle, "name", F.array_join(F.map_values("tags"), " "))) if needle else samples
    if group is None:
        return held.withColumn("position", F.row_number().over(Window.orderBy("sample")) - 1)  # one row a sample
    twice = group.groupBy("sample").count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("a group holds a sample twice")
    return held.join(group.select("sample", "position"), "sample")


def population_paths(trees: dict[object, list[Gate]]) -> list[tuple[object, str, list[str]]]:
    """(sample, gate, path) of every gate of every sample's tree."""
    return [(s, name, list(path)) for s, gates in trees.items() for name, path in paths(gates).items()]


def mapped_populations(targets: DataFrame, gates: DataFrame, path: list[str], overrides: DataFrame | None = None, unavailable: DataFrame | None = None) -> DataFrame:
    """``sample, gate, status`` for each of ``targets(sample)``: the gate of ``gates(sample, gate, path)`` at a path.

    The status is mapped, missing, ambiguous, overridden or unavailable. ``overrides(sample, gate)`` count
    before the path, if they are gates of that sample; a sample of ``unavailable(sample)`` has none.
    """
    at = F.array(*map(F.lit, path))
    matches = gates.where(F.col("path") == at).groupBy("sample").agg(F.count("*").alias("n"), F.max("gate").alias("found"))
    out = targets.select("sample").join(matches, "sample", "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("mapped")
    gate = F.when(F.col("n") == 1, F.col("found"))
    if unavailable is not None:
        out = out.join(unavailable.select("sample", F.lit(True).alias("gone")), "sample", "left")
        status = F.when(F.coalesce("gone", F.lit(False)), "unavailable").otherwise(status)
        gate = F.when(F.coalesce("gone", F.lit(False)), F.lit(None)).otherwise(gate)
    if overrides is not None:
        own = overrides.select("sample", F.col("gate").alias("forced")).join(gates.select("sample", F.col("gate").alias("forced"), F.lit(True).alias("theirs")), ["sample", "forced"], "left")
        out = out.join(own, "sample", "left")
        status = F.when(F.col("forced").isNotNull(), F.when(F.coalesce("theirs", F.lit(False)), "overridden").otherwise("unavailable")).otherwise(status)
        gate = F.when(F.col("forced").isNotNull(), F.when(F.coalesce("theirs", F.lit(False)), F.col("forced"))).otherwise(gate)
    return out.select("sample", gate.alias("gate"), status.alias("status"))


def common_parameters(panels: DataFrame) -> DataFrame:
    """``parameter, definition``: parameters of ``panels(sample, parameter, definition)`` that every sample has with one definition."""
    n = panels.agg(F.count_distinct("sample").alias("__n"))
    held = panels.groupBy("parameter").agg(F.count_distinct("sample").alias("samples"), F.min("definition").alias("definition"), F.max("definition").alias("__other"))
    return held.crossJoin(F.broadcast(n)).where("samples = __n AND definition = __other").select("parameter", "definition")  # one row


def pooled_counts(events: DataFrame, sample: str, gates: list[Gate], complete: DataFrame | None = None) -> DataFrame:
    """``population, n, pct_parent, pct_total, complete``: every gate over the whole cohort.

    A population that ``complete(population, complete)`` marks as not mapped in every sample has no figures.
    """
    by = masks(gates)
    wide = events.agg(F.count("*").alias("total"), *[F.count_if(m).alias(f"g{k}") for k, m in enumerate(by.values())])
    at = {n: k for k, n in enumerate(by)}
    rows = F.array(*[F.struct(F.lit(g.name).alias("population"), F.col(f"g{at[g.name]}").alias("n"), F.col(f"g{at[g.parent]}" if g.parent else "total").alias("of")) for g in gates])
    told = wide.select("total", F.explode(rows).alias("r")).select("total", "r.*")
    told = told.join(complete, "population", "left") if complete is not None else told.withColumn("complete", F.lit(True))
    ok = F.coalesce("complete", F.lit(True))
    n = F.when(ok, F.col("n"))
    return told.select("population", n.alias("n"), (100.0 * n / F.nullif(F.col("of"), F.lit(0))).alias("pct_parent"), (100.0 * n / F.nullif(F.col("total"), F.lit(0))).alias("pct_total"), ok.alias("complete"))


def source_counts(events: DataFrame, sample: str, mask: Column) -> DataFrame:
    """``sample, source, offset, events, selected``: what each source brings to a pooled view and where it begins; then a row of totals with NULL as sample."""
    c = events.groupBy(F.col(sample).alias("sample")).agg(F.count("*").alias("events"), F.count_if(mask).alias("selected"))
    order = Window.orderBy("sample")  # one row a sample
    told = c.select("sample", F.row_number().over(order).alias("source"), F.coalesce(F.sum("events").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), "events", "selected")
    total = c.agg(F.sum("events").alias("events"), F.sum("selected").alias("selected"))
    return told.unionByName(total.select(F.lit(None).cast(c.schema["sample"].dataType).alias("sample"), F.lit(0).alias("source"), F.lit(0).cast("long").alias("offset"), "events", "selected"))


def merged(events: DataFrame, sample: str, event: str, parameters: dict[str, Column], mask: Column | None = None, size: int = SIZE) -> DataFrame:
    """One table of the selected events of all sources: ``merged_id``, ``CF_Source`` from 1, ``CF_EventID`` and the mapped parameters.

    Offsets are prefix sums of the sources' counts, and inside a source of the counts of blocks of event ids.
    """
    rows = (events.where(mask) if mask is not None else events).select(F.col(sample).alias("__s"), F.col(event).alias("CF_EventID"), *[c.alias(n) for n, c in parameters.items()])
    rows = rows.withColumn("__block", F.floor(F.col("CF_EventID") / size))
    blocks = rows.groupBy("__s", "__block").agg(F.count("*").alias("__n"))
    up = Window.partitionBy("__s").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    starts = blocks.select("__s", "__block", F.coalesce(F.sum("__n").over(up), F.lit(0)).alias("__start"))
    order = Window.orderBy("__s")  # one row a source
    sources = blocks.groupBy("__s").agg(F.sum("__n").alias("__n"))
    sources = sources.select("__s", F.row_number().over(order).alias("CF_Source"), F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    inside = F.row_number().over(Window.partitionBy("__s", "__block").orderBy("CF_EventID")) - 1
    told = rows.withColumn("__in", inside).join(starts, ["__s", "__block"]).join(sources, "__s")
    return told.select((F.col("__offset") + F.col("__start") + F.col("__in")).alias("merged_id"), "CF_Source", "CF_EventID", *parameters)


def with_code(rows: DataFrame, samples: DataFrame, sample: str, keyword: str, name: str) -> DataFrame:
    """Adds the code of a sample's keyword in ``samples(sample, position, <keyword>)``: 1, 2, ... by first appearance."""
    first = samples.groupBy(keyword).agg(F.min("position").alias("__first"))
    codes = first.select(keyword, F.row_number().over(Window.orderBy("__first")).alias(name))  # one row a value
    held = samples.join(codes, samples[keyword].eqNullSafe(codes[keyword])).select(F.col("sample").alias("__s"), name)
    return rows.join(held, F.col(sample) == F.col("__s"), "left").drop("__s")


def batches(samples: DataFrame, size: int) -> DataFrame:
    """``samples`` with ``batch``: stretches of ``size`` samples by ``position``; of samples, so few rows are ordered."""
    return samples.withColumn("batch", F.floor((F.row_number().over(Window.orderBy("position")) - 1) / size))


def keyword_batches(samples: DataFrame, keyword: str, discriminator: str, prototypes: DataFrame) -> DataFrame:
    """``batch, prototype, sample, status``: for each keyword value and prototype ``(prototype, <discriminator>)`` the member with its discriminator.

    A batch without such a member, or with several, has status missing or ambiguous. A sample without the keyword is a batch of its own.
    """
    batch = F.coalesce(F.concat(F.lit("keyword:"), F.col(keyword).cast("string")), F.concat(F.lit("missing:"), F.col("sample").cast("string")))
    named = samples.withColumn("batch", batch)
    grid = named.select("batch").distinct().crossJoin(F.broadcast(prototypes.select("prototype", F.col(discriminator).alias("__d"))))  # prototypes of one layout
    found = named.groupBy("batch", F.col(discriminator).alias("__d")).agg(F.count("*").alias("__n"), F.max("sample").alias("__sample"))
    told = grid.join(found, ["batch", "__d"], "left")
    return told.select("batch", "prototype", F.when(F.col("__n") == 1, F.col("__sample")).alias("sample"), F.when(F.col("__n").isNull(), "missing").when(F.col("__n") > 1, "ambiguous").otherwise("mapped").alias("status"))


def origins(merged_events: DataFrame, sources: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """``merged_id, source_name, CF_EventID`` of merged events, of all or of those with start <= merged_id < end."""
    rows = merged_events if start is None else merged_events.where((F.col("merged_id") >= start) & (F.col("merged_id") < end))
    return rows.join(sources.select("CF_Source", F.col("name").alias("source_name")), "CF_Source").select("merged_id", "source_name", "CF_EventID")


def unordered_origins(merged_events: DataFrame) -> DataFrame:
    """``CF_Source, CF_EventID, times``: origins that are there twice, or whose order in the merged table is not theirs. Empty if all is well."""
    rows = merged_events.select("merged_id", "CF_Source", "CF_EventID")
    seen = rows.groupBy("CF_Source", "CF_EventID").agg(F.count("*").alias("times")).where("times > 1")
    back = with_previous(rows, ["CF_Source"], "merged_id", ["CF_EventID"]).where(F.col("CF_EventID") < F.col("previous_CF_EventID"))
    return seen.unionByName(back.select("CF_Source", "CF_EventID", F.lit(1).cast("long").alias("times"))).groupBy("CF_Source", "CF_EventID").agg(F.max("times").alias("times"))


def harmonised(panels: list[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """Panels with their own channel names as one table of shared names; a name that is already taken in its panel, or an alias of an alias, is refused."""
    parts = []
    for rows, names in panels:
        taken = set(rows.columns) - set(names.values())
        for shared, own in names.items():
            if own not in rows.columns:
                raise ValueError(f"no channel {own!r}; an alias stands for an original channel")
            if shared in taken and shared != own:
                raise ValueError(f"{shared!r} is already there")
        if len(set(names.values())) != len(names):
            raise ValueError("a channel has two names")
        parts.append(rows.select(*[F.col(f"`{own}`").alias(shared) for shared, own in names.items()]))
    return reduce(lambda a, b: a.unionByName(b), parts)


def alias_review(before: DataFrame, after: DataFrame) -> DataFrame:
    """``sample, name, previous, source, action`` of ``(sample, name, source)`` before and after: added, retained, rebound or removed."""
    b = before.select("sample", "name", F.col("source").alias("previous"))
    told = b.join(after.select("sample", "name", "source"), ["sample", "name"], "full")
    action = F.when(F.col("previous").isNull(), "added").when(F.col("source").isNull(), "removed").when(F.col("previous") == F.col("source"), "retained").otherwise("rebound")
    return told.select("sample", "name", "previous", "source", action.alias("action"))


def suggested_samples(sources: DataFrame, samples: DataFrame) -> DataFrame:
    """``source, sample, name_matches``: samples whose ``panel`` holds all channels that a source ``requires``."""
    s = samples.select("sample", F.col("name").alias("sample_name"), "panel")
    fits = F.size(F.array_except("requires", "panel")) == 0
    # sources name few channels: the first one joins by equality, the others are tested
    one = sources.withColumn("__c", F.element_at("requires", 1))
    many = s.withColumn("__c", F.explode("panel"))
    return one.join(many, "__c").where(fits).select("source", "sample", (F.lower("name") == F.lower("sample_name")).alias("name_matches")).distinct()


def compensation_choice(events: DataFrame, sample: str, choice: Column, outputs: dict[str, dict[str, Column]]) -> DataFrame:
    """Channels by each sample's choice: ``outputs`` gives the Columns of every choice, ``uncompensated`` among them; another choice gives NaN."""
    channels = list(next(iter(outputs.values())))
    picked = {}
    for c in channels:
        value = F.when(F.lit(False), F.lit(None).cast("double"))
        for name, columns in outputs.items():
            value = value.when(choice == name, columns[c])
        picked[c] = value.otherwise(F.lit(float("nan")))
    return events.withColumns(picked)


def with_result(events: DataFrame, results: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Saved columns of an analysis beside their events, NaN where an event was not mapped; a result that has an event twice is refused."""
    twice = results.groupBy(*keys).count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError("a result has an event twice")
    told = events.join(results.select(*keys, *columns), keys, "left")
    return told.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns})


def content_fingerprints(events: DataFrame, sample: str, columns: list[str]) -> DataFrame:
    """``sample, n, digest``: the same whatever the order of rows and files; another count or value gives another one."""
    row = F.xxhash64(*[F.col(c) for c in columns]).cast("decimal(38,0)")
    return events.groupBy(F.col(sample).alias("sample")).agg(F.count("*").alias("n"), F.sum(row).alias("digest"))


def changed_samples(now: DataFrame, saved: DataFrame) -> DataFrame:
    """``sample`` of saved fingerprints that are missing now or differ."""
    named = saved.select("sample", F.col("n").alias("was_n"), F.col("digest").alias("was"))
    told = named.join(now, "sample", "left")
    return told.where(~(F.col("n").eqNullSafe(F.col("was_n")) & F.col("digest").eqNullSafe(F.col("was")))).select("sample")


def captured(events: DataFrame, sample: str, event: str, mask: Column) -> DataFrame:
    """``sample, event`` ids of a population, to be kept as a frozen membership beside ``content_fingerprints``."""
    return events.where(mask).select(F.col(sample).alias("sample"), F.col(event).alias("event"))


def in_captured(events: DataFrame, sample: str, event: str, snapshot: DataFrame, inside: bool = True) -> DataFrame:
    """Events of a frozen membership, or those outside it."""
    ids = snapshot.select(F.col("sample").alias("__s"), F.col("event").alias("__e"))
    return events.join(ids, (F.col(sample) == F.col("__s")) & (F.col(event) == F.col("__e")), "left_semi" if inside else "left_anti")
