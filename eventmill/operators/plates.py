"""Plates: wells and their samples, annotations, dilution series and measures of wells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventmill.operators.tables import safe_text

#: Rows and columns of the standard plates.
SHAPES = {6: (2, 3), 12: (3, 4), 24: (4, 6), 48: (6, 8), 96: (8, 12), 384: (16, 24), 1536: (32, 48)}
MIXED = "<mixed>"
_WELL = r"^\s*([A-Za-z]{1,2})[\s_:-]*0*([1-9][0-9]{0,2})\s*$"
#: Columns of an export of measures.
MOST_MEASURES = 64

def well_row(well: Column) -> Column:
    """The row of a well's letters, from 0: A to Z, then AA on; NULL if it is no well."""
    letters = F.upper(F.nullif(F.regexp_extract(well, _WELL, 1), F.lit("")))
    number = lambda k: F.ascii(F.substring(letters, k, 1)) - ord("A") + 1
    return F.when(F.length(letters) == 2, number(1) * 26 + number(2)).otherwise(number(1)) - 1


def well_column(well: Column) -> Column:
    return F.nullif(F.regexp_extract(well, _WELL, 2), F.lit("")).try_cast("int") - 1


def well_name(row: Column, column: Column) -> Column:
    """A01, B12, AA07."""
    letter = lambda k: F.char(k + ord("A"))
    letters = F.when(row < 26, letter(row)).otherwise(F.concat(letter(F.floor(row / 26) - 1), letter(row % 26)))
    return F.concat(letters, F.when(column < 9, F.lpad((column + 1).cast("string"), 2, "0")).otherwise((column + 1).cast("string")))


def canonical_well(well: Column) -> Column:
    return F.when(well_row(well).isNotNull(), well_name(well_row(well), well_column(well)))


def smallest_plate(row: Column, column: Column) -> Column:
    """The smallest of 96, 384 and 1536 wells that holds a row and a column, both from 0; NULL if none does."""
    out = F.when(F.lit(False), F.lit(0))
    for n in (96, 384, 1536):
        out = out.when((row < SHAPES[n][0]) & (column < SHAPES[n][1]), n)
    return out


def plate_keyword(samples: DataFrame, keywords: DataFrame, key: str, sources: tuple[str, ...] = ("tags", "metadata")) -> DataFrame:
    """``sample, value, issue`` from ``keywords(sample, source, key, value)``: keys that are equal in letters and digits.

    Blank values do not count; different values in the first source that has any are conflicting.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    held = keywords.where((plain(F.col("key")) == plain(F.lit(key))) & (F.trim("value") != "") & F.col("source").isin(*sources))
    each = held.groupBy("sample", "source").agg(F.min(F.trim("value")).alias("a"), F.max(F.trim("value")).alias("b"))
    first = each.groupBy("sample").agg(F.min_by(F.struct("a", "b"), F.array_position(F.array(*map(F.lit, sources)), F.col("source"))).alias("r"))
    told = samples.select("sample").join(first, "sample", "left")
    clash = F.col("r.a") != F.col("r.b")
    return told.select("sample", F.when(~clash, F.col("r.a")).alias("value"), F.when(clash, "conflicting").alias("issue"))


def discover(wells: DataFrame, plate_format: int | None = None, geometry: tuple[int, int] | None = None, replicates: bool = False) -> DataFrame:
    """Places samples ``(sample, plate, well)`` on plates: ``plate, well, sample, format, issue``.

    The format is the given one, or the smallest that holds all wells of a plate. A sample's issue is no well, outside
    the plate, or several samples in one well without ``replicates``; samples with an issue are not assigned.
    """
    r, c = well_row(F.col("well")), well_column(F.col("well"))
    most = (96, 96) if geometry else SHAPES[1536]
    rows = wells.withColumns({"__r": r, "__c": c, "__well": canonical_well(F.col("well"))})
    bad = F.when(F.coalesce(F.trim("well"), F.lit("")) == "", "missing").when(F.col("__r").isNull(), "not a well").when((F.col("__r") >= most[0]) | (F.col("__c") >= most[1]), "outside every plate")
    rows = rows.withColumn("__bad", bad)
    good = rows.where("__bad IS NULL")
    extent = good.groupBy("plate").agg(F.max("__r").alias("__mr"), F.max("__c").alias("__mc"))
    shape = F.lit(plate_format).cast("int") if plate_format or geometry else smallest_plate(F.col("__mr"), F.col("__mc"))
    extent = extent.select(F.col("plate").alias("__p"), shape.alias("format"))
    crowd = good.groupBy("plate", "__well").agg(F.count("*").alias("__n")).select(F.col("plate").alias("__q"), F.col("__well").alias("__w"), "__n")
    told = rows.join(extent, F.col("plate").eqNullSafe(F.col("__p")), "left").join(crowd, F.col("plate").eqNullSafe(F.col("__q")) & (F.col("__well") == F.col("__w")), "left")
    if geometry:
        height, width = F.lit(geometry[0]), F.lit(geometry[1])
    else:
        pick = lambda k: F.coalesce(*[F.when(F.col("format") == n, s[k]) for n, s in SHAPES.items()])
        height, width = pick(0), pick(1)
    issue = F.col("__bad")
    outside = (F.col("__r") >= height) | (F.col("__c") >= width)
    issue = F.coalesce(issue, F.when(outside, "outside the plate"), F.lit(None) if replicates else F.when(F.col("__n") > 1, "several samples"))
    return told.select("plate", F.col("__well").alias("well"), "sample", "format", issue.alias("issue"))


def resized(assignments: DataFrame, rows: int, columns: int) -> tuple[DataFrame, DataFrame]:
    """What of ``assignments(well, ...)`` a plate of another shape keeps, and the wells that fall off."""
    inside = (well_row(F.col("well")) < rows) & (well_column(F.col("well")) < columns)
    return assignments.where(inside), assignments.where(~F.coalesce(inside, F.lit(False)))


def well_members(assignments: DataFrame, wells: list[str]) -> DataFrame:
    """``sample`` of some wells, each once: a group."""
    return assignments.where(canonical_well(F.col("well")).isin(*wells)).select("sample").distinct()


def dilution_of(wells: DataFrame, start: Column, factor: Column, step: Column) -> DataFrame:
    """``wells`` with ``value`` start x factor^step as a decimal of 10 places, from columns."""
    power = F.aggregate(F.sequence(F.lit(1), F.greatest(step, F.lit(1))), F.lit(1).cast("decimal(38,10)"), lambda x, k: F.when(k <= step, (x * factor.cast("decimal(18,8)")).cast("decimal(38,10)")).otherwise(x))
    return wells.withColumn("value", (power * start.cast("decimal(18,8)")).cast("decimal(38,10)"))


def staged_annotations(records: DataFrame, well_heading: str, plate_heading: str | None = None, plate: str | None = None, clear_blanks: bool = False) -> DataFrame:
    """Annotation rows as ``well, key, value, issue`` from a table with headings of any case.

    Rows of other plates are left out; a well that comes twice stages nothing and is an issue, as is text that is no well.
    A blank stays away, or clears the value.
    """
    lower = {c.strip().lower(): c for c in records.columns}
    if len(lower) != len(records.columns) or well_heading.lower() not in lower:
        raise ValueError("headings repeat, or there is no heading of wells")
    rows = records
    if plate_heading:
        if plate_heading.lower() not in lower:
            raise ValueError("there is no heading of plates")
        rows = rows.where(F.trim(F.col(f"`{lower[plate_heading.lower()]}`")) == plate) if plate else rows
    well = canonical_well(F.col(f"`{lower[well_heading.lower()]}`"))
    keys = [c for n, c in lower.items() if n not in (well_heading.lower(), (plate_heading or "").lower())]
    cells = F.array(*[F.struct(F.lit(k.strip()).alias("key"), F.col(f"`{k}`").cast("string").alias("value")) for k in keys])
    told = rows.select(well.alias("well"), F.col(f"`{lower[well_heading.lower()]}`").alias("__given"), cells.alias("cells"))
    crowd = told.where("well IS NOT NULL").groupBy("well").agg(F.count("*").alias("__n")).withColumnRenamed("well", "__w")
    told = told.join(crowd, F.col("well") == F.col("__w"), "left")
    issue = F.when(F.col("well").isNull(), "not a well").when(F.col("__n") > 1, "several rows")
    blank = F.coalesce(F.trim(F.col("c.value")), F.lit("")) == ""
    long = told.select(F.coalesce("well", "__given").alias("well"), issue.alias("issue"), F.explode("cells").alias("c")).where(F.col("issue").isNotNull() | ~blank | F.lit(clear_blanks))
    value = F.when(F.col("issue").isNull() & ~blank, F.col("c.value"))
    return long.select("well", F.col("c.key").alias("key"), value.alias("value"), "issue").distinct()


def annotation_table(annotations: DataFrame, plate: str) -> DataFrame:
    """``Plate, Well`` and a column for each key, from ``annotations(well, key, value)``, text made safe: the rows of an export."""
    keys = [r[0] for r in annotations.select("key").distinct().orderBy("key").limit(65).collect()]
    if len(keys) > 64:
        raise ValueError("a plate has 64 annotation keys at most")
    wide = annotations.groupBy("well").pivot("key", keys).agg(F.first("value"))
    return wide.select(F.lit(plate).alias("Plate"), F.col("well").alias("Well"), *[safe_text(F.col(f"`{k}`")).alias(k) for k in keys])


def annotation_review(planned: DataFrame, assignments: DataFrame, tags: DataFrame, fill_missing: bool = False) -> DataFrame:
    """``well, sample, key, before, after, change``: planned ``(well, key, value)`` against ``tags(sample, key, value)`` of the wells' samples.

    A change sets or deletes; with ``fill_missing`` only missing or blank values change. A planned well without sample is ``empty``.
    """
    rows = planned.select("well", "key", F.col("value").alias("after")).join(assignments.select("well", "sample"), "well", "left")
    old = tags.select(F.col("sample").alias("__s"), F.col("key").alias("__k"), F.col("value").alias("before"))
    told = rows.join(old, (F.col("sample") == F.col("__s")) & (F.col("key") == F.col("__k")), "left")
    kept = F.col("before").eqNullSafe(F.col("after"))
    if fill_missing:
        kept = kept | (F.coalesce("before", F.lit("")) != "")
    change = F.when(F.col("sample").isNull(), "empty").when(kept, "unchanged").when(F.col("after").isNull(), "delete").otherwise("set")
    return told.select("well", "sample", "key", "before", "after", change.alias("change"))


def applied(tags: DataFrame, review: DataFrame) -> DataFrame:
    """``tags`` after the changes of a review."""
    changes = review.where(F.col("change").isin("set", "delete")).select("sample", "key", "after")
    kept = tags.join(changes, ["sample", "key"], "left_anti")
    return kept.unionByName(changes.where("after IS NOT NULL").select("sample", "key", F.col("after").alias("value")))


def review_digest(review: DataFrame) -> DataFrame:
    """``changes, samples, empty_wells, digest`` of a review; the digest does not depend on the order of rows."""
    row = F.sha2(F.to_json(F.struct("well", "sample", "key", "before", "after", "change"), {"ignoreNullFields": "false"}), 256)
    changed = F.col("change").isin("set", "delete")
    return review.agg(F.count_if(changed).alias("changes"), F.count_distinct(F.when(changed, F.col("sample"))).alias("samples"), F.count_distinct(F.when(F.col("change") == "empty", F.col("well"))).alias("empty_wells"), F.sum(F.conv(F.substring(row, 1, 8), 16, 10).cast("decimal(38,0)")).alias("digest"))


def well_measures(assignments: DataFrame, measures: DataFrame, method: str = "median", strict: bool = True) -> DataFrame:
    """``well, measure, value, available, replicates, issue``: each sample of a well with equal weight.

    ``measures(sample, measure, value)``. A missing replicate leaves the well without a value if ``strict``.
    """
    of = {"median": lambda v: F.percentile(v, 0.5), "mean": F.avg, "sum": F.sum}[method]
    names = measures.select("measure").distinct()
    grid = assignments.select("well", "sample").crossJoin(F.broadcast(names))  # measures of one plate, 10 at most
    rows = grid.join(measures, ["sample", "measure"], "left")
    v = F.when(~F.isnan("value"), F.col("value"))
    got = rows.groupBy("well", "measure").agg(of(v).alias("value"), F.count(v).alias("available"), F.count("*").alias("replicates"))
    short = F.col("available") < F.col("replicates")
    gone = (F.col("available") == 0) | (short & F.lit(strict))
    return got.select("well", "measure", F.when(~gone, F.col("value")).alias("value"), "available", "replicates", F.when(F.col("available") == 0, "undefined").when(short, "replicates missing").alias("issue"))


def well_labels(assignments: DataFrame, labels: DataFrame) -> DataFrame:
    """``well, label`` from ``labels(sample, label)``: the common text of a well's samples, or ``<mixed>``; a missing label counts as blank."""
    rows = assignments.select("well", "sample").join(labels, "sample", "left").withColumn("label", F.coalesce("label", F.lit("")))
    return rows.groupBy("well").agg(F.min("label").alias("a"), F.max("label").alias("b")).select("well", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(MIXED).alias("label"))


def normalised(measures: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """Adds ``low, high, fraction, clipped``: values on the domain of their measure, the given ``(measure, low, high)`` or that of all wells."""
    own = measures.groupBy("measure").agg(F.min("value").alias("__lo"), F.max("value").alias("__hi"))
    if domains is not None:
        own = own.join(domains.select("measure", F.col("low").alias("__dl"), F.col("high").alias("__dh")), "measure", "left").select("measure", F.coalesce("__dl", "__lo").alias("__lo"), F.coalesce("__dh", "__hi").alias("__hi"))
    told = measures.join(own, "measure").withColumnsRenamed({"__lo": "low", "__hi": "high"})
    v, lo, hi = F.col("value"), F.col("low"), F.col("high")
    fraction = F.when(v.isNull() | lo.isNull(), F.lit(None).cast("double")).when(v < lo, 0.0).when(v > hi, 1.0).when(hi == lo, 0.5).otherwise((v - lo) / F.nullif(hi - lo, F.lit(0.0)))
    return told.withColumns({"fraction": fraction, "clipped": F.coalesce((v < lo) | (v > hi), F.lit(False))})


def measurement_table(measures: DataFrame) -> DataFrame:
    """``well`` and a column for each measure, 64 at most: the rows of an export."""
    names = [r[0] for r in measures.select("measure").distinct().orderBy("measure").limit(MOST_MEASURES + 1).collect()]
    if len(names) > MOST_MEASURES:
        raise ValueError(f"there are more than {MOST_MEASURES} measures")
    return measures.groupBy("well").pivot("measure", names).agg(F.first("value"))
