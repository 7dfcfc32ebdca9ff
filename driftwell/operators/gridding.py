"""Irregular readings onto a regular grid by validity intervals (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(time: str, value: str):
    """A reading can be used where time and value are known finite numbers."""
    big = float("inf")
    t, v = F.col(time), F.col(value)
    return t.isNotNull() & v.isNotNull() & ~F.isnan(t) & ~F.isnan(v) & (F.abs(t) < big) & (F.abs(v) < big)


def regular_grid(readings: DataFrame, *, source: str, time: str, value: str, step: str, reading_id: str | None = None, hold_steps: float = 1.0, span: int = 2048) -> DataFrame:
    """Readings of each source as the cells of a regular grid: source, cell_no, level, mean, coverage, n_readings.

    Cell ``c`` of a source is [c * step, (c + 1) * step); ``cell_no`` = floor(time / step). Each reading holds as a step function from
    its time until the next reading. That interval is cut at the cell borders, and for each cell from the source's first to its last:

    * ``mean``: average of the holding values weighted by time, over the parts held no longer than ``hold_steps`` steps after their
      reading; null where there is no such part,
    * ``coverage``: those parts as a fraction of the cell,
    * ``level``: the last value that holds in the cell, so that an empty cell is filled by the reading carried forward,
    * ``n_readings``: readings in the cell; 0 marks a cell that was filled.

    Sources are cut into spans of ``span`` cells, each sorted by itself, so no source has to fit one task; what a span needs from the span
    before it (its last reading) comes from a table of one row a span. All grouping keeps to the one exchange by source and span.

    Defined cases: a null, NaN or infinite time or value, a null source, and a null or not positive step make a reading unusable and it
    is ignored; repeated rows of one ``reading_id`` count once (without it, repeated rows of time and value); readings at one time hold
    for no time but the last of them, ordered by value, is carried; an empty input gives an empty result; other columns are ignored.
    """
    rid = F.col(reading_id) if reading_id else F.lit(0)
    r = readings.where(usable(time, value) & F.col(source).isNotNull() & (F.col(step) > 0)).select(
        F.col(source).alias("__src"), F.col(time).cast("double").alias("__t"), F.col(value).cast("double").alias("__v"), F.col(step).cast("double").alias("__d"), rid.alias("__id")
    )
    r = r.withColumn("__c", F.floor(F.col("__t") / F.col("__d")).cast("long"))
    r = r.withColumn("__b", F.floor(F.col("__c") / F.lit(span)).cast("long"))
    order = ["__t", "__v", "__id"]
    w = Window.partitionBy("__src", "__b").orderBy(*order)
    same = (F.lag("__id").over(w) == F.col("__id")) & (F.lag("__t").over(w) == F.col("__t"))
    if not reading_id:
        same = same & (F.lag("__v").over(w) == F.col("__v"))
    rows = r.select("*", F.coalesce(same, F.lit(False)).alias("__again"), F.lag("__t").over(w).alias("__pt"), F.lag("__v").over(w).alias("__pv"), F.lead("__t").over(w).alias("__nt"))
    edge = r.groupBy("__src", "__b").agg(F.max(F.struct("__t", "__v")).alias("__last"), F.min("__t").alias("__first"))
    e = Window.partitionBy("__src").orderBy("__b")
    edge = edge.select(
        F.col("__src").alias("__esrc"), F.col("__b").alias("__eb"),
        F.lag("__last.__t").over(e).alias("__et"), F.lag("__last.__v").over(e).alias("__ev"), F.lead("__first").over(e).alias("__en"),
    )
    rows = rows.join(edge, (F.col("__src") == F.col("__esrc")) & (F.col("__b") == F.col("__eb")), "left")
    c, b, lit = F.col("__c"), F.col("__b"), F.lit
    start_c, end_c = b * span, b * span + (span - 1)
    # What a row accounts for: its own holding up to the end of its span, and, for the first row of a span, the cells since the last reading of an earlier span.
    own_end = F.when(F.col("__nt").isNotNull(), F.floor(F.col("__nt") / F.col("__d")).cast("long")).when(F.col("__en").isNotNull(), end_c).otherwise(c)
    before = F.floor(F.col("__et") / F.col("__d")).cast("long")
    before_b = F.floor(before / lit(span)).cast("long")
    own = F.struct(F.col("__t").alias("__pt"), F.coalesce("__nt", "__en", "__t").alias("__pn"), F.col("__v").alias("__pv"), c.alias("__c0"), F.greatest(own_end, c).alias("__c1"))
    carried = F.struct(F.col("__et").alias("__pt"), F.col("__t").alias("__pn"), F.col("__ev").alias("__pv"), ((before_b + 1) * span).alias("__c0"), c.alias("__c1"))
    parts = F.when(F.col("__pt").isNull() & F.col("__et").isNotNull(), F.array(carried, own)).otherwise(F.array(own))
    rows = rows.select("__src", "__b", "__d", "__c", "__again", F.inline(parts))
    # A long outage is first cut into spans, so that no row ever holds more than one span of cells.
    spans = F.sequence(F.floor(F.col("__c0") / lit(span)).cast("long"), F.floor(F.col("__c1") / lit(span)).cast("long"))
    rows = rows.select("*", F.explode(spans).alias("__pb"))
    rows = rows.select("*", F.explode(F.sequence(F.greatest(F.col("__c0"), F.col("__pb") * span), F.least(F.col("__c1"), F.col("__pb") * span + (span - 1)))).alias("cell_no"))
    x0, d = F.col("cell_no") * F.col("__d"), F.col("__d")
    until = F.least(F.col("__pn"), F.col("__pt") + d * hold_steps)
    held = F.greatest(F.lit(0.0), F.least(until, x0 + d) - F.greatest(F.col("__pt"), x0))
    mine = (F.col("cell_no") == F.col("__c")) & (F.col("__c0") == F.col("__c")) & (F.floor(F.col("__pt") / d).cast("long") == F.col("__c")) & ~F.col("__again")
    cells = rows.select("__src", "__b", "cell_no", d.alias("__d"), F.col("__pt").alias("__t"), F.col("__pv").alias("__v"), held.alias("__h"), mine.cast("int").alias("__n"))
    out = cells.groupBy("__src", "__b", "cell_no").agg(
        F.max(F.struct("__t", "__v")).alias("__l"), F.sum(F.col("__v") * F.col("__h")).alias("__vh"), F.sum("__h").alias("__sh"), F.max("__d").alias("__dd"), F.sum("__n").alias("n_readings")
    )
    return out.select(
        F.col("__src").alias(source), "cell_no", F.col("__l.__v").alias("level"),
        F.when(F.col("__sh") > 0, F.col("__vh") / F.col("__sh")).alias("mean"), F.least(F.lit(1.0), F.col("__sh") / F.col("__dd")).alias("coverage"), "n_readings",
    )
