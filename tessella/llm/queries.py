"""Queries over the test tables for the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm import distinct as sets
from tessella.llm import percentiles as pct
from tessella.llm.frequent import frequent_values
from tessella.llm.leakage import find_leaks
from tessella.llm.mixing import mix_sources
from tessella.llm.quality import PUBLISHED, RUNNING, failed_rules, text_figures
from tessella.llm.shares import SHARES
from tessella.llm.topn import top_n_per_group
from tessella.session import partitions_of, table

Query = Callable[[SparkSession, str], DataFrame]


def _p2_values(spark: SparkSession, folder: str) -> DataFrame:
    """Prices by page, additions by channel, and page ids overall, as (field_name, group_key, value)."""
    menu, wiki = table(spark, folder, "menuitem"), table(spark, folder, "wikipedia")

    def part(field: str, key, value) -> Column:
        return F.struct(F.lit(field).alias("field_name"), key.cast("string").alias("group_key"), value.cast("double").alias("value"))

    page = F.col("menu_page_id")
    prices = menu.select(F.inline(F.array(part("price", page, F.col("price")), part("menu_page_id", F.lit(None), page))))
    return prices.unionByName(wiki.select(F.inline(F.array(part("added", F.col("channel"), F.col("added"))))))


def _p2_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    by = ["field_name", "group_key"]
    return pct.percentiles(pct.percentile_states(_p2_values(spark, folder), by, "value"), by, SHARES)


def _p2_judged(values: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """Whether each percentile's true ranks among ``values`` come within its stated error of the rank asked for."""
    values = values.where("value IS NOT NULL AND NOT isnan(value)")
    counts = values.groupBy(*by, F.col("value").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    same = [counts[c].eqNullSafe(found[c]) for c in by]
    ranks = counts.join(found, same).groupBy(*(found[c] for c in by), "n", "share", "rank_error")
    ranks = ranks.agg(
        F.sum("c").alias("n_exact"), F.sum(F.when(F.col("v") < F.col("value"), F.col("c")).otherwise(0)).alias("below"), F.sum(F.when(F.col("v") <= F.col("value"), F.col("c")).otherwise(0)).alias("upto")
    )
    rank = F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("n")))
    within = (rank >= F.col("below") + 1 - F.col("rank_error")) & (rank <= F.col("upto") + F.col("rank_error")) & (F.col("n") == F.col("n_exact"))
    return ranks.select(*by, "share", "n_exact", within.alias("within"), (F.col("rank_error") > 0).alias("sketched"))


def _p2_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each percentile's true ranks come within its stated error of the rank asked for."""
    by = ["field_name", "group_key"]
    values = _p2_values(spark, folder)
    return _p2_judged(values, pct.percentiles(pct.percentile_states(values, by, "value"), by, SHARES), by).drop("sketched")


def _p2_sketched(spark: SparkSession, folder: str) -> DataFrame:
    """The same where every state is a sketch: built at once, merged from days, and with a part taken out again."""
    kind = pct.Dyadic(capacity=0)
    menu, wiki = table(spark, folder, "menuitem"), table(spark, folder, "wikipedia")

    def values(case: str, df: DataFrame, key: Column, value: str) -> DataFrame:
        return df.select(F.lit(case).alias("case_name"), key.cast("string").alias("group_key"), F.substring("timestamp", 1, 10).alias("day") if "timestamp" in df.columns else F.lit("").alias("day"), F.col(value).cast("double").alias("value"))

    by = ["case_name", "group_key"]
    channel = F.col("channel")
    whole = values("price by month", menu, F.date_format("created_at", "yyyy-MM"), "price").unionByName(values("pages", menu, F.lit(None), "menu_page_id"))
    whole = whole.unionByName(values("added by channel", wiki, channel, "added"))
    days, rest = values("days merged", wiki, channel, "added"), values("anonymous taken out", wiki, channel, "added")
    gone = values("anonymous taken out", wiki.where("isAnonymous"), channel, "added")
    states = pct.percentile_states(whole, by, "value", kind)
    merged = pct.merged(pct.percentile_states(days, [*by, "day"], "value", kind), by, kind)
    left = pct.percentile_states(rest, by, "value", kind).unionByName(pct.negated(pct.percentile_states(gone, by, "value", kind), kind))
    found = pct.percentiles(states.unionByName(merged).unionByName(pct.merged(left, by, kind)), by, SHARES, kind)
    true = whole.unionByName(days).unionByName(values("anonymous taken out", wiki.where("NOT coalesce(isAnonymous, false)"), channel, "added"))
    return _p2_judged(true, found, by)


def _p2_days(spark: SparkSession, folder: str) -> DataFrame:
    edits = table(spark, folder, "wikipedia").select(F.substring("timestamp", 1, 10).alias("edit_day"), "channel", "added")
    return pct.percentile_states(edits, ["edit_day", "channel"], "added")


def _p2_merged_days(spark: SparkSession, folder: str) -> DataFrame:
    """Additions per channel over all days, from the days' own states."""
    return pct.percentiles(pct.merged(_p2_days(spark, folder), ["channel"]), ["channel"], SHARES)


def _p2_without_anonymous(spark: SparkSession, folder: str) -> DataFrame:
    """Additions per channel with those of anonymous edits taken out of the finished states again."""
    wiki = table(spark, folder, "wikipedia")
    whole = pct.percentile_states(wiki, ["channel"], "added")
    taken = pct.negated(pct.percentile_states(wiki.where("isAnonymous"), ["channel"], "added"))
    return pct.percentiles(pct.merged(whole.unionByName(taken), ["channel"]), ["channel"], SHARES)


_P4_BY = ["field_name", "grouping", "day", "group_key"]


def _p4_states(spark: SparkSession, folder: str, kind: sets.Registers | None = None) -> DataFrame:
    """States for ids and pages by day and by page, and for countries by day, channel and both."""
    menu, wiki = table(spark, folder, "menuitem"), table(spark, folder, "wikipedia")
    day, page = F.date_format("created_at", "yyyy-MM-dd"), F.col("menu_page_id")
    none = F.lit(None).cast("string")

    def row(field: str, grouping: str, by_day, key, *values) -> Column:
        named = zip(("field_name", "grouping", "day", "group_key", *(["value"] if len(values) == 1 else pct.NAMES)), (F.lit(field), F.lit(grouping), by_day, key, *values))
        return F.struct(*(c.alias(name) for name, c in named))

    ids = F.array(
        row("id", "day", day, none, F.col("id")),
        row("id", "page", none, page.cast("string"), F.col("id")),
        row("menu_page_id", "day", day, none, page),
    )
    menu_parts = sets.distinct_states(menu.select(F.inline(ids)), _P4_BY, "value", kind, merge=False)
    edits = wiki.select(F.substring("timestamp", 1, 10).alias("edit_day"), "channel", "countryName")
    parts = sets.distinct_states(edits, ["edit_day", "channel"], "countryName", kind, merge=False)
    state = [F.col(c) for c in pct.NAMES]
    rolled = F.array(
        row("countryName", "day", F.col("edit_day"), none, *state),
        row("countryName", "channel", none, F.col("channel"), *state),
        row("countryName", "day and channel", F.col("edit_day"), F.col("channel"), *state),
    )
    return sets.merged(menu_parts.unionByName(parts.select(F.inline(rolled))), _P4_BY, kind, parts=partitions_of(menu) + partitions_of(wiki))


def _p4_distinct_counts(spark: SparkSession, folder: str) -> DataFrame:
    return sets.distinct_counts(_p4_states(spark, folder), _P4_BY)


def _p4_exact_values(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct value of every group as (f, g, d, k, v)."""
    menu, wiki = table(spark, folder, "menuitem"), table(spark, folder, "wikipedia")
    day, page = F.date_format("created_at", "yyyy-MM-dd"), F.col("menu_page_id").cast("string")
    edit_day, none = F.substring("timestamp", 1, 10), F.lit(None).cast("string")

    def each(*rows) -> Column:
        return F.inline(F.array(*(F.struct(F.lit(f).alias("f"), F.lit(g).alias("g"), d.alias("d"), k.alias("k"), v.cast("string").alias("v")) for f, g, d, k, v in rows)))

    values = menu.select(each(("id", "day", day, none, F.col("id")), ("id", "page", none, page, F.col("id")), ("menu_page_id", "day", day, none, page)))
    country, channel = F.col("countryName"), F.col("channel")
    edits = wiki.select(each(("countryName", "day", edit_day, none, country), ("countryName", "channel", none, channel, country), ("countryName", "day and channel", edit_day, channel, country)))
    return values.unionByName(edits).where("v IS NOT NULL").distinct()


def _p4_judged(spark: SparkSession, folder: str, kind: sets.Registers | None) -> DataFrame:
    """(f, g, d, k, n_exact, n_distinct, standard_error), with estimates beside the exact counts."""
    exact = _p4_exact_values(spark, folder).groupBy("f", "g", "d", "k").agg(F.count(F.lit(1)).alias("n_exact"))
    found = sets.distinct_counts(_p4_states(spark, folder, kind), _P4_BY, kind)
    same = (F.col("f") == F.col("field_name")) & (F.col("g") == F.col("grouping")) & F.col("d").eqNullSafe(F.col("day")) & F.col("k").eqNullSafe(F.col("group_key"))
    return exact.join(found, same, "left").select("f", "g", "d", "k", "n_exact", "n_distinct", "standard_error")


def _p4_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each estimate comes within four standard errors of the exact count."""
    within = F.abs(F.col("n_distinct") - F.col("n_exact")) <= 4 * F.col("standard_error")
    return _p4_judged(spark, folder, None).select(F.col("f").alias("field_name"), F.col("g").alias("grouping"), F.col("d").alias("day"), F.col("k").alias("group_key"), "n_exact", F.coalesce(within, F.lit(False)).alias("within"))


def _p4_sketched(spark: SparkSession, folder: str) -> DataFrame:
    """Where every state is a sketch: how many groups there are, and whether their errors are as stated.

    Of all groups at least 60 % must come within one standard error (and the half that
    rounding adds), 93 % within two and 99 % within three.
    """
    judged = _p4_judged(spark, folder, sets.Registers(capacity=0))
    off = F.greatest(F.lit(0), F.abs(F.col("n_distinct") - F.col("n_exact")) - F.lit(0.5)) / F.col("standard_error")
    within = [F.avg(F.coalesce(off <= e, F.lit(False)).cast("int")) >= least for e, least in ((1, 0.6), (2, 0.93), (3, 0.99))]
    return judged.groupBy(F.col("f").alias("field_name"), F.col("g").alias("grouping")).agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("n_exact").alias("n_exact"), F.min(F.coalesce(F.col("standard_error") > 0, F.lit(False))).alias("sketched"), (within[0] & within[1] & within[2]).alias("as_stated")
    )


def _p4_overlaps_checked(spark: SparkSession, folder: str) -> DataFrame:
    """What days share with the next ones, from sketches alone: whether estimates agree with exact sets as stated.

    Of all pairs of days at least 93 % must have a Jaccard similarity within two of its
    standard errors, and 98 % within three; unions and intersections likewise, by the
    error that follows.
    """
    kind = sets.Registers(capacity=0)
    found = sets.overlaps(_p4_day_pairs(_p4_states(spark, folder, kind)), ["field_name", "day"], kind)
    values = _p4_exact_values(spark, folder).where("g = 'day'").select("f", F.col("d").cast("date").alias("d"), "v")
    sizes = values.groupBy("f", "d").agg(F.count(F.lit(1)).alias("n"))
    both = values.join(values.select("f", F.date_sub("d", 1).alias("d"), "v"), ["f", "d", "v"]).groupBy("f", "d").agg(F.count(F.lit(1)).alias("b"))
    exact = sizes.join(sizes.select("f", F.date_sub("d", 1).alias("d"), F.col("n").alias("m")), ["f", "d"]).join(both, ["f", "d"], "left").fillna(0, ["b"])
    exact = exact.select(F.col("f").alias("field_name"), F.col("d").alias("day"), (F.col("n") + F.col("m") - F.col("b")).alias("u"), "b")
    judged = exact.join(found, ["field_name", "day"], "left")
    j = F.col("b") / F.col("u")
    off = F.abs(F.col("jaccard") - j) / F.col("jaccard_error")
    # |A| + |B| errs by kind.relative_error, and the Jaccard similarity by its own error
    union = F.abs(F.col("n_union") - F.col("u")) / (F.col("u") * (F.lit(kind.relative_error) + F.col("jaccard_error")))
    common = F.abs(F.col("n_both") - F.col("b")) / (F.col("u") * (F.lit(kind.relative_error) + F.col("jaccard_error")))

    def mostly(x: Column) -> Column:
        share = lambda e: F.avg(F.coalesce(x <= e, F.lit(False)).cast("int"))
        return (share(2) >= 0.93) & (share(3) >= 0.98)

    return judged.groupBy("field_name").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.sum("u").alias("sum_union"), F.sum("b").alias("sum_both"), (mostly(off) & mostly(union) & mostly(common)).alias("as_stated")
    )


def _p4_day_pairs(states: DataFrame) -> DataFrame:
    days = states.where("grouping = 'day'").select("field_name", F.col("day").cast("date").alias("day"), F.struct(*pct.NAMES).alias("state"))
    later = days.select("field_name", F.date_sub("day", 1).alias("day"), F.col("state").alias("right"))
    return days.withColumnRenamed("state", "left").join(later, ["field_name", "day"])


def _p4_next_day(spark: SparkSession, folder: str) -> DataFrame:
    """What the menu pages of each day, and the countries of each day, share with those of the next."""
    return sets.overlaps(_p4_day_pairs(_p4_states(spark, folder)), ["field_name", "day"])


def _p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "wikipedia")
        .where("cityName IS NOT NULL")
        .select(F.substring("timestamp", 1, 10).alias("edit_day"), "channel", F.col("cityName").alias("city_name"), "edit_id", "added")
    )


def _p5_found(spark: SparkSession, folder: str) -> DataFrame:
    best = top_n_per_group(_p5_groups(spark, folder), ["edit_day", "channel", "city_name"], "added", "edit_id", 3)
    return best.select("edit_day", "channel", "city_name", "edit_id")


def _p5_by_channel(spark: SparkSession, folder: str) -> DataFrame:
    return top_n_per_group(table(spark, folder, "wikipedia"), ["channel"], "added", "edit_id", 100)


P6_FIELDS = {"menu_page_id": "menuitem", "cityName": "wikipedia"}


def _p6_named(spark: SparkSession, folder: str, **how) -> DataFrame:
    each = [
        frequent_values(table(spark, folder, t), f, **how).select(F.lit(f).alias("field_name"), F.col("value").cast("string").alias("key_value"), "n")
        for f, t in P6_FIELDS.items()
    ]
    return each[0].unionByName(each[1])


def _p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _p6_named(spark, folder, min_share=(1, 100)).select("field_name", "key_value")


def _p6_top_200(spark: SparkSession, folder: str) -> DataFrame:
    return _p6_named(spark, folder, k=200)


def _p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "test_items"), "doc_id", "item_id")


def _p7_items(spark: SparkSession, folder: str) -> DataFrame:
    return _p7_found(spark, folder).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


def _p8_selection(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "source_targets"))[0]


def _p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "source_targets"))[1]


def _p8_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each source comes within one document of its share, and uses none more often than it may."""
    documents, targets = table(spark, folder, "documents"), table(spark, folder, "source_targets")
    selection, report = mix_sources(documents, targets)
    longest = selection.agg(F.max("n_tokens").alias("longest"))
    total = F.sum("selected_tokens").over(Window.partitionBy(F.lit(1)))  # a row for each named source
    judged = report.withColumn("goal", F.col("share") * total).join(F.broadcast(longest))  # one row
    near = F.abs(F.col("selected_tokens") - F.col("goal")) <= F.coalesce("longest", F.lit(0)) * (F.lit(0.5) + F.col("share") * F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) / 2)
    return judged.select("source", "n_documents", near.alias("near_share"), (F.col("most_uses") <= F.col("max_repeats")).alias("repeats_kept"))


def _p9_figures(spark: SparkSession, folder: str) -> DataFrame:
    return text_figures(table(spark, folder, "documents"), "doc_id").withColumn(
        "failed", F.array_join(failed_rules({**PUBLISHED, **RUNNING}), ",")
    )


def _p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return text_figures(table(spark, folder, "documents"), "doc_id").where(F.size(failed_rules(RUNNING)) > 0).select("doc_id")


def queries() -> dict[str, Query]:
    return {
        "p2_percentiles": _p2_percentiles,
        "p2_checked": _p2_checked,
        "p2_sketched": _p2_sketched,
        "p2_merged_days": _p2_merged_days,
        "p2_without_anonymous": _p2_without_anonymous,
        "p4_distinct_counts": _p4_distinct_counts,
        "p4_checked": _p4_checked,
        "p4_sketched": _p4_sketched,
        "p4_overlaps_checked": _p4_overlaps_checked,
        "p4_next_day": _p4_next_day,
        "p5_found": _p5_found,
        "p5_by_channel": _p5_by_channel,
        "p6_found": _p6_found,
        "p6_top_200": _p6_top_200,
        "p7_found": _p7_found,
        "p7_items": _p7_items,
        "p8_selection": _p8_selection,
        "p8_shares": _p8_shares,
        "p8_checked": _p8_checked,
        "p9_found": _p9_found,
        "p9_figures": _p9_figures,
    }
