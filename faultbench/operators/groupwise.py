"""Bounds by group: for faults that no bound on a whole column can see.

* Marks. A group's latest date on clean data is its mark; a control counts the groups that fell
  behind theirs. Now and then a row is withdrawn for good reasons and its group falls back by
  the gap to the date before. So moves as small as the smallest usual gaps (a quantile of the gaps
  between the dates of a group) don't count, and as many groups may fall behind as withdrawals
  explain at a stated false-alarm rate.
* Shares of NULL. The NULLs of a column, in each group, may be as many as the clean share explains at a
  stated false-alarm rate (divided among the groups).

Both limits are Bernstein's: with an expected count m, more than ``m + l/3 + sqrt(l*l/9 + 2*m*l)``
happen with a probability of exp(-l) at most. The gaps are kept as a histogram by days, which merges
exactly and does not depend on partitioning; its size is that of the calendar, not of the data.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultbench.operators.controls import Control, safe_identifier
from faultbench.operators.variants import VariantSet, with_mask

FALSE_ALARM = 0.01
#: Share of a table's groups whose latest row is withdrawn from one look to the next.
WITHDRAWN = 0.001


def most_expected(expected: float, false_alarm: float) -> int:
    """The count that is exceeded with a probability of ``false_alarm`` at most."""
    if not 0 < false_alarm < 1:
        raise ValueError("a false-alarm rate lies between 0 and 1")
    level = -math.log(false_alarm)
    return math.floor(expected + level / 3 + math.sqrt(level * level / 9 + 2 * expected * level))


def gap_histogram(df: DataFrame, group: str, date: str) -> DataFrame:
    """(gap, n): days between consecutive dates of a group, over all groups; NULL is a group, NULL dates are none.

    Dates are made distinct first, so a hot group is no more rows than the calendar has days.
    """
    dates = df.select(group, F.col(date).alias("_d")).filter("_d IS NOT NULL").distinct()
    gap = F.datediff("_d", F.lag("_d").over(Window.partitionBy(group).orderBy("_d")))
    return dates.select(gap.alias("gap")).filter("gap IS NOT NULL").groupBy("gap").agg(F.count(F.lit(1)).alias("n"))


def marks(df: DataFrame, group: str, date: str) -> DataFrame:
    """(group, _mark): the latest date of each group that has one."""
    return df.groupBy(group).agg(F.max(date).alias("_mark")).filter("_mark IS NOT NULL")


@dataclass(frozen=True)
class GroupProfile:
    """What a control on marks is made of; ``share``: gaps longer than ``slack`` days."""

    group: str
    date: str
    groups: int
    gaps: int
    slack: int
    share: float
    limit: int


def profile_groups(
    df: DataFrame, group: str, date: str, false_alarm: float = FALSE_ALARM, withdrawn: float = WITHDRAWN
) -> GroupProfile:
    """Two aggregates over clean data; one number and one small histogram reach the driver."""
    histogram = sorted((int(r["gap"]), int(r["n"])) for r in gap_histogram(df, group, date).collect())
    groups, total = marks(df, group, date).count(), sum(n for _, n in histogram)
    rank, before, slack, longer = math.ceil(total * false_alarm), 0, 0, total
    for gap, n in histogram:
        before += n
        if before >= rank:
            slack, longer = gap, total - before
            break
    share = longer / total if total else 1.0
    return GroupProfile(group, date, groups, total, slack, share, most_expected(groups * withdrawn * share, false_alarm))


def marks_control(profile: GroupProfile, table: str, marks_table: str, kinds: tuple[str, ...] = ()) -> Control:
    return Control(
        f"{table.removeprefix('raw_')}_{profile.group}_not_behind",
        table,
        kind="behind",
        columns=(safe_identifier(profile.group),),
        measure=safe_identifier(profile.date),
        parent_table=marks_table,
        parent_columns=(profile.group,),
        slack=profile.slack,
        limit=profile.limit,
        description=f"groups over {profile.slack} days behind their latest {profile.date}; up to {profile.limit} are expected",
        detects_faults=kinds,
        generated=True,
    )


def null_share_control(column: str, group: str | None, table: str, limits_table: str, kinds: tuple[str, ...] = ()) -> Control:
    by = f"_by_{group}" if group else ""
    return Control(
        f"{table.removeprefix('raw_')}_{safe_identifier(column)}_null_share{by}",
        table,
        kind="null_share",
        columns=(safe_identifier(group),) if group else (),
        measure=column,
        parent_table=limits_table,
        description=f"more NULLs in {column} than its clean share explains",
        detects_faults=kinds,
        generated=True,
    )


def behind_counts(df: DataFrame, clean_marks: DataFrame, vs: VariantSet, c: Control) -> DataFrame:
    """(variant, behind): groups that are gone or over ``slack`` days behind their mark."""
    (group,), date = c.columns, c.measure
    latest = with_mask(df, vs).groupBy(group).agg(
        *[F.max(F.when(vs.member(v), F.col(date))).alias(f"_l{i}") for i, v in enumerate(vs.names)]
    )
    joined = clean_marks.alias("m").join(latest.alias("l"), F.col(f"m.{group}").eqNullSafe(F.col(f"l.{group}")), "left")

    def behind(i: int) -> Column:
        return F.col(f"_l{i}").isNull() | (F.datediff("_mark", f"_l{i}") > c.slack)

    totals = joined.agg(*[F.count_if(behind(i)).alias(f"_n{i}") for i in range(len(vs.names))])
    rows = [F.struct(F.lit(v).alias("variant"), F.col(f"_n{i}").alias("behind")) for i, v in enumerate(vs.names)]
    return totals.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def null_limits(df: DataFrame, column: str, group: str | None, false_alarm: float = FALSE_ALARM) -> DataFrame:
    """(group, _limit): the most NULLs that the clean share explains, for each group's number of rows.

    A group without any NULL is given the share of one NULL more than it has (rule of succession), so
    its limit is that of a rare event rather than none.
    """
    keyed = df.select((F.col(group) if group else F.lit(0)).alias("_g"), F.col(column).isNull().alias("_null"))
    counts = keyed.groupBy("_g").agg(F.count(F.lit(1)).alias("_rows"), F.count_if("_null").alias("_nulls"))
    groups = F.count(F.lit(1)).over(Window.partitionBy())  # a row for each group
    level = F.log(groups / F.lit(false_alarm)) if group else F.lit(-math.log(false_alarm))
    expected = F.col("_rows") * (F.col("_nulls") + 1) / (F.col("_rows") + 2)
    limit = F.floor(expected + level / 3 + F.sqrt(level * level / 9 + 2 * expected * level))
    return counts.select("_g", "_rows", "_nulls", limit.cast("bigint").alias("_limit"))


def null_share_results(df: DataFrame, limits: DataFrame, vs: VariantSet, column: str, group: str | None) -> DataFrame:
    """(variant, violation_count): groups with more NULLs than their limit; new groups have none allowed."""
    keyed = with_mask(df, vs).withColumn("_g", F.col(group) if group else F.lit(0))
    null = F.col(column).isNull()
    counts = keyed.groupBy("_g").agg(*[F.count_if(vs.member(v) & null).alias(f"_n{i}") for i, v in enumerate(vs.names)])
    joined = counts.alias("c").join(limits.select(F.col("_g").alias("_h"), "_limit"), F.col("_g").eqNullSafe(F.col("_h")), "left")
    over = [F.count_if(F.col(f"_n{i}") > F.coalesce("_limit", F.lit(0))).alias(f"_o{i}") for i in range(len(vs.names))]
    rows = [F.struct(F.lit(v).alias("variant"), F.col(f"_o{i}").alias("violation_count")) for i, v in enumerate(vs.names)]
    return joined.agg(*over).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
