"""Report building blocks: zero-filled counts, top-n, pivots, nearest-rank percentiles, class changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textgate.operators import guards, rules


def zero_filled(counts: DataFrame, key: str, values: list[str], n: str) -> DataFrame:
    """A row for every listed value, 0 where it has none."""
    every = counts.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    return every.join(counts, key, "left").select(key, F.coalesce(n, F.lit(0)).cast("long").alias(n))


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, with their ``rank``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def pivoted(df: DataFrame, key: str, by: str, values: list[str]) -> DataFrame:
    """Counts of each listed value of ``by`` as a column."""
    return df.groupBy(key).agg(*[F.count_if(F.col(by) == v).alias(v) for v in values])


def nearest_rank(column: str, quantiles: dict[str, float], kind: str = "double") -> list[Column]:
    """Percentiles that are values of the column, as ``kind``."""
    return [F.coalesce(F.expr(f"percentile_disc({q}) within group (order by {column})"), F.lit(0)).cast(kind).alias(name) for name, q in quantiles.items()]


def summary(df: DataFrame, keys: list[str], surfaced: Column, latency: str) -> DataFrame:
    """Totals, hits, recall and percentiles by class; recall is 0 for an empty class."""
    total, hits = F.count("*"), F.count_if(surfaced)
    return df.groupBy(*keys).agg(total.alias("total"), hits.alias("surfaced"), F.when(total > 0, hits / total).otherwise(0.0).alias("recall"), *nearest_rank(latency, {"p50": 0.5, "p95": 0.95}, df.schema[latency].dataType.simpleString()), F.max(latency).alias("top"))


def round_robin(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows taking one of each group in turn; no group needs more than ``n`` of its rows."""
    ranked = top_n(df, [by], [F.asc(order)], n).withColumnRenamed("rank", "r")
    return ranked.orderBy("r", by).limit(n)


def classified(current: DataFrame, labels: DataFrame, baseline: DataFrame, key: str = "key") -> DataFrame:
    """``current(key, bucket)`` against labels and an earlier baseline: kept, newly accepted, newly refused, unlabelled, missing."""
    was = baseline.select(key, F.col("bucket").alias("was"))
    joined = current.join(labels.select(key, "label"), key, "left").join(was, key, "left")
    change = F.when(F.col("was").isNull(), "missing").when(F.col("was") == F.col("bucket"), "kept").when(F.col("bucket") == "accepted", "newly accepted").when(F.col("was") == "accepted", "newly refused").otherwise("moved")
    return joined.withColumn("change", change).withColumn("regression", (F.col("label") == "CHANGED") & (F.col("change") == "newly accepted"))


def scored(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The summary of a run, one row, or one for each value of the keys: rows with ``action`` "failed" are in no denominator, nor their latency; rates without rows are 0.

    ``rows``: ``expectedAction``, ``action``, ``surfaced``, ``rejection``, ``milliseconds`` and the stages ``by_model`` and ``by_mechanics``.
    """
    failed = F.col("action") == "failed"
    hit, clean = ~failed & (F.col("expectedAction") == "rewrite"), ~failed & (F.col("expectedAction") == "keep")
    share = lambda a, b: F.when(F.count_if(b) > 0, F.count_if(a & b) / F.count_if(b)).otherwise(0.0)
    rows = rows.withColumn("milliseconds", F.when(~failed, F.col("milliseconds")))
    return rows.groupBy(*keys).agg(
        F.count_if(~failed).alias("scored"),
        F.count_if(hit).alias("positives"),
        F.count_if(hit & F.col("surfaced")).alias("surfaced_on_positives"),
        share(F.col("surfaced"), hit).alias("recall"),
        F.count_if(clean).alias("cleans"),
        F.count_if(clean & F.col("surfaced")).alias("false_positives"),
        share(F.col("surfaced"), clean).alias("false_positive_rate"),
        F.count_if(failed).alias("failures"),
        F.count_if(hit & F.col("surfaced") & F.col("by_model")).alias("surfaced_by_model"),
        F.count_if(hit & F.col("surfaced") & F.col("by_mechanics") & ~F.col("by_model")).alias("surfaced_by_mechanics_only"),
        *nearest_rank("milliseconds", {"latency_p50": 0.5, "latency_p95": 0.95}, "long"),
        F.coalesce(F.max("milliseconds"), F.lit(0)).cast("long").alias("latency_max"),
    )


def verifier_summary(rows: DataFrame) -> DataFrame:
    """How a verifier's answers ``got`` meet ``expected`` (show or hide), one row; only pairs in its remit count, others are listed by answer."""
    mine, hide = F.col("inRemit"), F.col("got") == "hide"
    hides, shows = mine & (F.col("expected") == "hide"), mine & (F.col("expected") == "show")
    answered = F.coalesce(F.col("got").isin("show", "hide"), F.lit(False))
    outside = lambda answer: F.count_if(~mine & (F.col("got") == answer))
    return rows.agg(
        F.count_if(hides & hide).alias("caught"),
        F.count_if(hides).alias("hides"),
        F.count_if(shows & hide).alias("false_hides"),
        F.count_if(shows).alias("shows"),
        F.count_if(~answered).alias("unavailable"),
        outside("hide").alias("outside_hide"),
        outside("show").alias("outside_show"),
        F.count_if(~mine & ~answered).alias("outside_unavailable"),
    )


def rescored(rows: DataFrame, policy: str = "verify") -> DataFrame:
    """A recorded run under the guards as they are now.

    ``rows``: ``source``, ``replacement``, ``rejectedText``, ``action``, ``rejection``, ``modelRejection``,
    ``by_model``, ``by_rule``.  What the model said, whether it was shown or refused, is judged against the
    repaired source; a refusal falls back to the rule's answer or the repair.  A single lost word keeps
    the verifier's recorded verdict.  Failed rows and rows without the model's words stay as they are.
    Adds ``surfaced``.
    """
    was = lambda c: F.col(f"__row.{c}")
    said = F.coalesce(F.nullif("rejectedText", F.lit("")), F.when(F.col("by_model"), F.nullif("replacement", F.lit(""))))
    df = rows.select(F.struct(*rows.columns).alias("__row"), F.when(F.col("action") != "failed", said).alias("__said"), F.col("source").alias("__base"))
    df = rules.repaired(df, "__base").select("__row", "__said", F.coalesce("replacement", "__base").alias("__base"))
    df = guards.bucketed(guards.validated(df, "__base", "__said"), "__base", "__said", policy)
    hidden = (was("rejectedText") == F.col("__said")) & ((was("rejection") == "verifier-hidden") | (was("modelRejection") == "verifier-hidden"))
    same = F.trim("__said") == F.trim(was("source"))
    reason = F.when(F.col("bucket") == "refused", F.col("reason")).when(same, "unchanged").when((F.col("bucket") == "verifier") & hidden, "verifier-hidden")
    ruled = was("by_rule") & (was("replacement") != "")
    floor = F.when(ruled, was("replacement")).when(F.trim("__base") != F.trim(was("source")), F.col("__base")).otherwise("")
    df = df.select("__row", "__said", reason.alias("__reason"), floor.alias("__floor"))
    judged, refused, silent = F.col("__said").isNotNull(), F.col("__reason").isNotNull(), F.col("__floor") == ""
    new = {
        "action": F.when(refused & silent, "keep").otherwise("rewrite"),
        "rejection": F.when(refused & silent, F.col("__reason")),
        "modelRejection": F.col("__reason"),
        "rejectedText": F.when(refused, F.col("__said")),
        "by_model": ~refused,
        "replacement": F.when(refused, F.col("__floor")).otherwise(F.trim("__said")),
    }
    shown = F.when(judged, ~refused | ~silent).otherwise((was("action") == "rewrite") & (F.coalesce(was("replacement"), F.lit("")) != ""))
    return df.select(*[F.when(judged, new[c]).otherwise(was(c)).alias(c) if c in new else was(c).alias(c) for c in rows.columns if c != "surfaced"], shown.alias("surfaced"))


def placed(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds each row's place in the order, from 1, without all rows in one task: parts are sorted and numbered, and begin where the parts before end.

    Rows that the order does not tell apart get places of their own in no fixed order.
    """
    parts = F.spark_partition_id()
    ordered = rows.orderBy(*order).withColumn("__part", parts).withColumn("__nth", F.monotonically_increasing_id() - F.shiftleft(parts.cast("long"), 33))
    sizes = ordered.groupBy("__part").agg((F.max("__nth") + 1).alias("__size"))
    # one row a part
    before = sizes.select("__part", (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__before"))
    return ordered.join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__nth") + 1).cast("int")).drop("__part", "__nth", "__before")


def histogram(rows: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Counts of a key's values with their rank, most first and then by value; null values do not count."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(n))
    return placed(counts, [F.desc(n), F.asc(key)])


def class_counts(pairs: DataFrame, theme: str = "theme", changed: str = "changed", order: str = "id") -> DataFrame:
    """Pairs and changed pairs of each theme, with their place: the largest share of changed ones first, ties in the order in which themes first come."""
    counts = pairs.groupBy(theme).agg(F.count("*").alias("total"), F.count_if(F.col(changed)).alias("changed"), F.min(order).alias("__first"))
    return placed(counts, [F.desc(F.col("changed") / F.col("total")), F.asc("__first")]).select(theme, "total", "changed", "rank")


def markdown_lines(rows: DataFrame, columns: dict[str, str], order: str = "rank") -> DataFrame:
    """A table as lines of Markdown, each with its place ``at``: headings, a rule, and a line for each row; bars in cells are escaped."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "\\|", "\\\\|")
    head = rows.sparkSession.createDataFrame([(-1, "| " + " | ".join(columns.values()) + " |"), (0, "|" + "---|" * len(columns))], "at long, line string")
    body = rows.select(F.col(order).cast("long").alias("at"), F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns]), F.lit(" |")).alias("line"))
    return head.unionByName(body)


def format_bytes(n: Column) -> Column:
    """A number of bytes in words: kB and MB without decimals, GB with two."""
    told = lambda unit, by, digits: F.concat(F.format_string(f"%.{digits}f", n / by), F.lit(f" {unit}"))
    return F.when(F.coalesce(n, F.lit(0)) == 0, "0 bytes").when(n < 1e6, told("kB", 1e3, 0)).when(n < 1e9, told("MB", 1e6, 0)).otherwise(told("GB", 1e9, 2))


def last_wins(entries: Column) -> Column:
    """A map of (key, value) entries in which a later entry overwrites an earlier one of its key; null keys are left out."""
    some = F.filter(entries, lambda e: e["key"].isNotNull())
    keys = F.array_distinct(F.transform(some, lambda e: e["key"]))
    back = F.reverse(some)
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.get(F.filter(back, lambda e: e["key"] == k), F.lit(0))["value"]))


def first_and_rest(counts: DataFrame, by: str, key: str, n: str, first: int) -> DataFrame:
    """The first values of each group by count, and how many rows the others have."""
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(n), key)))
    named = F.array_sort(F.collect_list(F.when(F.col("rank") <= first, F.struct("rank", key))))
    rest = F.coalesce(F.sum(F.when(F.col("rank") > first, F.col(n))), F.lit(0))
    return ranked.groupBy(by).agg(F.array_join(F.transform(named, lambda x: x[key]), ", ").alias("first"), rest.alias("rest"))


def runs(df: DataFrame, keys: list[str], place: str, gap: int = 1) -> DataFrame:
    """Runs of places at most ``gap`` apart: ``first``, ``last`` and ``n``."""
    order = Window.partitionBy(*keys).orderBy(place)
    begins = F.coalesce(F.col(place) - F.lag(place).over(order) > gap, F.lit(True))
    numbered = df.withColumn("run", F.sum(begins.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(*keys, "run").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).drop("run")


def holding(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """Each point with the span of its key that holds it (start included, end not); spans of a key do not overlap.

    Both sides are put in one order and the last span begun is carried forward: no pairs are made.
    """
    rows = spans.select(key, F.col(start).alias("__at"), F.lit(0).alias("__kind"), F.struct(start, end).alias("__span"), F.lit(None).cast(points.schema[at].dataType).alias(at))
    rows = rows.unionByName(points.select(key, F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.lit(None).cast(rows.schema["__span"].dataType).alias("__span"), at))
    begun = F.last("__span", True).over(Window.partitionBy(key).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = rows.withColumn("__span", begun).where("__kind = 1")
    inside = F.col(at) < F.col(f"__span.{end}")
    return found.select(key, at, F.when(inside, F.col(f"__span.{start}")).alias(start), F.when(inside, F.col(f"__span.{end}")).alias(end))


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, left_id: str, right_id: str) -> DataFrame:
    """For each row of ``left`` the row of ``right`` of its key with the nearest ``at``; the smaller id on ties."""
    rows = left.select(key, at, F.lit(1).alias("__side"), left_id, F.lit(None).cast(right.schema[right_id].dataType).alias(right_id))
    rows = rows.unionByName(right.select(key, at, F.lit(0).alias("__side"), F.lit(None).cast(left.schema[left_id].dataType).alias(left_id), right_id))
    # of equal places the smallest id alone
    least = F.min(F.when(F.col("__side") == 0, F.col(right_id))).over(Window.partitionBy(key, at))
    rows = rows.withColumn("__hit", F.when((F.col("__side") == 0) & (F.col(right_id) == least), F.struct(at, right_id)))
    order = Window.partitionBy(key).orderBy(at, "__side")
    before = F.last("__hit", True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # read from the other end: a frame that reaches forwards is gone through again for each row
    back = Window.partitionBy(key).orderBy(F.desc(at), F.desc("__side"))
    after = F.last("__hit", True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    far = lambda hit: F.struct(F.abs(hit[at] - F.col(at)).alias("far"), hit[right_id].alias(right_id))
    rows = rows.withColumn("__before", before).withColumn("__after", after).where("__side = 1")
    best = F.least(F.when(F.col("__before").isNotNull(), far(F.col("__before"))), F.when(F.col("__after").isNotNull(), far(F.col("__after"))))
    return rows.select(key, left_id, best[right_id].alias(right_id))
