"""The analytic queries over the wide appearance fact.

Every function takes the fact (see ``model``) and gives a DataFrame; nothing is
collected. Nulls: money and counts are null-safe zeros where a query says so and
are dropped where it says so; the two are not mixed. Ties are broken by ids.
Percentages and averages are unrounded doubles; rounding belongs to output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oathmill.functions import names
from oathmill.functions.cases import party_color, risk, severity
from oathmill.plans.model import CRORE, LAKH



def wealth() -> Column:
    return F.coalesce("assets", F.lit(0)).cast("long")


def n_cases() -> Column:
    return F.coalesce("cases", F.lit(0)).cast("long")


def party_or_ind() -> Column:
    return F.coalesce("party", F.lit("IND"))


def is_crore() -> Column:
    return wealth() >= CRORE


def _pct(part: Column, whole: Column) -> Column:
    return (part * 100).cast("double") / whole.cast("double")


def _scoped(fact: DataFrame, house: str | None = None, state: str | None = None) -> DataFrame:
    out = fact
    if house:
        out = out.where(F.col("house") == house)
    if state:
        out = out.where(F.col("state") == state)
    return out


def latest(fact: DataFrame, house: str | None = None, scope: str = "all", state: str | None = None, elections: DataFrame | None = None) -> DataFrame:
    """Scope ``current``: winners of the newest election year, none if that year has no winner yet; the year is that of ``elections``
    (state, house, year), which may know elections without any appearance, else of the fact. Scope ``all``: each
    politician's rows of their newest year in the house, winners or not; two in one year both stay."""
    if scope == "current":
        rows = _scoped(fact, house, state)
        held = rows if elections is None else _scoped(elections, house, state)
        newest = held.agg(F.max("year").alias("newest_year"))  # one row
        return rows.join(F.broadcast(newest), F.col("year") == F.col("newest_year")).where("won").drop("newest_year")
    by_politician = Window.partitionBy("politician_id").orderBy(F.desc("year"))
    rows = _scoped(fact, house).withColumn("rank_", F.rank().over(by_politician)).where("rank_ = 1").drop("rank_")
    return _scoped(rows, None, state)


def current_by_state(fact: DataFrame, house: str = "Assembly") -> DataFrame:
    """Winners of the newest year of each state, for all states in one plan."""
    rows = _scoped(fact, house)
    newest = rows.groupBy("state").agg(F.max("year").alias("newest_year"))
    joined = rows.join(newest.withColumnRenamed("state", "s"), (F.col("state") == F.col("s")) & (F.col("year") == F.col("newest_year")))
    return joined.where("won").drop("s", "newest_year")


def upper_median(rows: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """The middle value of each group, the upper of two; null counts as the least. No task holds a group: values are counted,
    counts are walked range by range, then the distinct values of the one range with the middle."""
    key = F.struct(*[F.col(c) for c in by])
    values = rows.groupBy(key.alias("key_"), value.alias("v")).agg(F.count("*").alias("n"))
    spread = F.signum("v") * F.floor(F.log2(F.abs("v").cast("double") + 1) * 64)
    ranged = values.withColumn("range_", F.coalesce(spread.cast("long"), F.lit(-(10**6))))
    totals = ranged.groupBy("key_", "range_").agg(F.sum("n").alias("t"))  # a few thousand ranges a group at most
    here = Window.partitionBy("key_")
    totals = totals.withColumns({"upto": F.sum("t").over(here.orderBy("range_")), "all": F.sum("t").over(here)})
    place = F.col("all") - F.floor((F.col("all") - 1) / 2)
    middle = totals.where((F.col("upto") >= place) & (F.col("upto") - F.col("t") < place)).select(F.col("key_").alias("k2"), F.col("range_").alias("r2"), (place - F.col("upto") + F.col("t")).alias("want"))
    inside = ranged.join(middle, F.col("key_").eqNullSafe(F.col("k2")) & (F.col("range_") == F.col("r2")))
    inside = inside.withColumn("seen", F.sum("n").over(Window.partitionBy("key_").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = inside.where((F.col("seen") >= F.col("want")) & (F.col("seen") - F.col("n") < F.col("want")))
    return found.select("key_.*", F.col("v").alias(name))


# --- leaderboards ---


def rank_labels(rows: DataFrame, *order: Column | str) -> DataFrame:
    """The pages' row labels (W6): ``rank`` from 1 in the given order, and whether the row has the badge of the first three.
    For results that are cut to a page's rows already: the ranks are dealt in one task."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("badge", F.col("rank") <= 3)


def _card(rows: DataFrame) -> DataFrame:
    return rows.select("politician_id", "name", "slug", "appearance_id", "year", party_or_ind().alias("party"), "constituency", wealth().alias("assets"), n_cases().alias("cases"))


def top_by_wealth(fact: DataFrame, limit: int = 10, house: str = "Assembly", scope: str = "all", state: str | None = None) -> DataFrame:
    return _card(latest(fact, house, scope, state).where("assets <> 0").orderBy(F.desc("assets"), "appearance_id").limit(limit))


def top_by_cases(fact: DataFrame, limit: int = 10, house: str = "Assembly", scope: str = "all", state: str | None = None) -> DataFrame:
    return _card(latest(fact, house, scope, state).where("cases > 0").orderBy(F.desc("cases"), "appearance_id").limit(limit))


def first_and_last(fact: DataFrame) -> DataFrame:
    """Per politician with two declared totals or more: the first and last by year (then id)."""
    when, what = F.struct("year", "appearance_id"), F.struct("year", "assets", "appearance_id", "party", "constituency")
    rows = fact.where("assets is not null").groupBy("politician_id").agg(
        F.first("name").alias("name"), F.first("slug").alias("slug"), F.count("*").alias("n"), F.min_by(what, when).alias("a"), F.max_by(what, when).alias("b"))
    return rows.where("n >= 2").select(
        "politician_id", "name", "slug", F.col("a.year").alias("first_year"), F.col("b.year").alias("last_year"), F.col("a.assets").alias("from_inr"), F.col("b.assets").alias("to_inr"),
        F.col("b.appearance_id").alias("latest_id"), F.col("b.party").alias("party"))


def wealth_movers(fact: DataFrame, limit: int = 10, direction: str = "gain") -> DataFrame:
    rows = first_and_last(fact).where("from_inr <> 0").withColumn("delta", F.col("to_inr") - F.col("from_inr"))
    rows = rows.withColumn("pct", F.col("delta").cast("double") / F.col("from_inr").cast("double") * 100)
    order = F.desc("delta") if direction == "gain" else F.asc("delta")
    return rows.orderBy(order, "politician_id").limit(limit).select("politician_id", "name", "first_year", "last_year", "from_inr", "to_inr", "delta", "pct")


def wealth_multipliers(fact: DataFrame, limit: int = 10, house: str = "Assembly", state: str | None = None, floor: int = LAKH) -> DataFrame:
    rows = first_and_last(_scoped(fact, house, state)).where(F.col("from_inr") >= floor)
    pct = F.round((F.col("to_inr") - F.col("from_inr")).cast("double") / F.col("from_inr").cast("double") * 100)
    return rows.where("to_inr > from_inr").withColumn("pct", pct).orderBy(F.desc("pct"), "politician_id").limit(limit).select("politician_id", "name", "first_year", "last_year", "from_inr", "to_inr", "pct")


def crorepati_newcomers(fact: DataFrame, limit: int = 10, house: str = "Assembly", state: str | None = None) -> DataFrame:
    rows = first_and_last(_scoped(fact, house, state)).where((F.col("from_inr") < CRORE) & (F.col("to_inr") >= CRORE))
    pct = (F.col("to_inr") - F.col("from_inr")).cast("double") / F.greatest("from_inr", F.lit(1)).cast("double") * 100
    return rows.withColumn("pct", pct).orderBy(F.desc("to_inr"), "politician_id").limit(limit).select("politician_id", "name", "first_year", "last_year", "from_inr", "to_inr", "pct")


def long_servers(fact: DataFrame, limit: int = 10, house: str = "Assembly", state: str | None = None) -> DataFrame:
    wins = _scoped(fact, house, state).where("won").groupBy("politician_id").agg(
        F.first("name").alias("name"), F.count("*").alias("wins"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return wins.where("wins >= 2").orderBy(F.desc("wins"), F.desc("last_year"), "politician_id").limit(limit)


def clean_and_wealthy(fact: DataFrame, limit: int = 10, house: str = "Assembly", min_crore: float = 5.0, scope: str = "all", state: str | None = None) -> DataFrame:
    rows = latest(fact, house, scope, state).where((wealth() >= F.lit(int(min_crore * CRORE))) & (n_cases() == 0))
    return _card(rows.orderBy(F.desc("assets"), "appearance_id").limit(limit))


def _history(fact: DataFrame) -> DataFrame:
    rows = fact.where("party is not null")
    order = Window.partitionBy("politician_id").orderBy("year", "appearance_id")
    return rows.withColumn("before", F.lag("party").over(order))


def party_switchers(fact: DataFrame, limit: int = 20, state: str | None = None) -> DataFrame:
    """Changes of party between one appearance with a party and the next; ``journey`` is in order of year."""
    when = F.struct("year", "appearance_id")
    rows = _history(_scoped(fact, None, state)).groupBy("politician_id").agg(
        F.first("name").alias("name"), F.count_distinct("party").alias("n_parties"), F.count_if(F.col("party") != F.col("before")).alias("switches"),
        F.min_by("party", when).alias("from_party"), F.max_by("party", when).alias("to_party"), F.min("year").alias("first_year"), F.max("year").alias("last_year"),
        F.array_sort(F.collect_list(F.struct("year", "appearance_id", "party"))).alias("h"))
    rows = rows.where("n_parties >= 2").orderBy(F.desc("switches"), F.desc("last_year"), "politician_id").limit(limit)
    return rows.withColumn("journey", F.array_join(F.transform("h", lambda x: x["party"]), " > ")).drop("h")


# --- trends and parties ---


def trends_by_cycle(fact: DataFrame, state: str | None = None) -> DataFrame:
    """Winners of each election (state, house, year); elections without winners are left out."""
    rows = _scoped(fact, None, state).where("won").groupBy("state", "house", "year").agg(
        F.count("*").alias("total_winners"), F.sum(wealth()).alias("w"), F.count_if(is_crore()).alias("crorepati_count"), F.count_if(n_cases() > 0).alias("with_cases_count"))
    return rows.select(
        "state", "house", "year", "total_winners", F.floor(F.col("w") / F.col("total_winners")).cast("long").alias("avg_wealth_inr"),
        "crorepati_count", _pct(F.col("crorepati_count"), F.col("total_winners")).alias("crorepati_pct"), "with_cases_count", _pct(F.col("with_cases_count"), F.col("total_winners")).alias("with_cases_pct"))


def party_stats(fact: DataFrame, year: int | None = None, state: str | None = None) -> DataFrame:
    rows = _scoped(fact, None, state).where("won and party is not null")
    if year:
        rows = rows.where(F.col("year") == year)
    sums = rows.groupBy("party").agg(F.count("*").alias("count"), F.sum(wealth()).alias("total_inr"), F.count_if(n_cases() > 0).alias("with_cases_count"), F.count_if(is_crore()).alias("crorepati_count"))
    median = upper_median(rows, ["party"], wealth(), "median_inr")
    return sums.join(median, "party").select(
        "party", party_color(F.col("party")).alias("color"), "count", (F.col("total_inr").cast("double") / F.col("count").cast("double")).alias("avg_inr"), "median_inr",
        "with_cases_count", _pct(F.col("with_cases_count"), F.col("count")).alias("with_cases_pct"), "crorepati_count")


def party_seats_by_year(fact: DataFrame, house: str = "Assembly", state: str | None = None) -> DataFrame:
    """Every party in every year, zeros included, with the party's best year."""
    rows = _scoped(fact, house, state).where("won")
    seats = rows.groupBy(party_or_ind().alias("party"), "year").agg(F.count("*").alias("seats"))
    years = seats.agg(F.array_sort(F.collect_set("year")).alias("years"))  # one row
    grid = seats.select("party").distinct().withColumn("k", F.lit(1)).join(F.broadcast(years.withColumn("k", F.lit(1))), "k").select("party", F.explode("years").alias("year"))
    dense = grid.join(seats, ["party", "year"], "left").select("party", "year", F.coalesce("seats", F.lit(0)).alias("seats"))
    return dense.withColumns({"color": party_color(F.col("party")), "max_seats": F.max("seats").over(Window.partitionBy("party"))})


def party_wealth_by_cycle(fact: DataFrame, house: str = "Assembly", state: str | None = None, top: int = 5) -> DataFrame:
    """Mean wealth of winners of the richest parties per year; 0 where a party has no winner."""
    rows = _scoped(fact, house, state).where("won")
    cells = rows.where("party is not null").groupBy("party", "year").agg(F.sum(wealth()).alias("w"), F.count("*").alias("n"))
    best = cells.groupBy("party").agg(F.sum("w").alias("total_inr")).orderBy(F.desc("total_inr"), "party").limit(top)
    years = rows.agg(F.array_sort(F.collect_set("year")).alias("years"))
    grid = best.withColumn("k", F.lit(1)).join(F.broadcast(years.withColumn("k", F.lit(1))), "k").select("party", "total_inr", F.explode("years").alias("year"))
    return grid.join(cells, ["party", "year"], "left").select("party", "year", "total_inr", F.coalesce(F.col("w").cast("double") / F.col("n").cast("double") / 1e7, F.lit(0.0)).alias("avg_cr"))


# --- maps ---


def _tile(rows: DataFrame) -> list[Column]:
    return [F.col("constituency"), F.col("name").alias("mla"), names.slug_or_id(F.col("slug"), F.col("politician_id")).alias("slug"), party_or_ind().alias("party"), party_color(F.col("party")).alias("color"), wealth().alias("wealth_inr"), n_cases().alias("cases"), F.col("year")]


def scatter_points(fact: DataFrame, state: str | None = None) -> DataFrame:
    rows = latest(fact, None, "all", state)
    return rows.select("appearance_id", *_tile(rows)[1:], F.coalesce("constituency", F.lit("")).alias("constituency"))


def constituency_tiles(fact: DataFrame, ac_to_pc: DataFrame, year: int | None = None, state: str | None = None) -> DataFrame:
    """Assembly seats with their member of parliament. ``ac_to_pc`` (pc, ac) is a dimension of a few thousand rows; a seat
    listed twice belongs to the last (largest) pc. Reservation tags are dropped on both sides."""
    newest = Window.partitionBy("pc_key").orderBy(F.desc("year"), "appearance_id")
    mps = fact.where("house = 'LokSabha' and won and constituency is not null").withColumn("pc_key", names.seat_key(F.col("constituency")))
    mps = mps.withColumn("n", F.row_number().over(newest)).where("n = 1").select("pc_key", F.col("name").alias("mp_name"), party_or_ind().alias("mp_party"), F.col("year").alias("mp_year"), wealth().alias("mp_wealth_inr"), n_cases().alias("mp_cases"))
    seats = ac_to_pc.groupBy(names.seat_key(F.col("ac")).alias("ac_key")).agg(F.max("pc").alias("ls_pc"))
    rows = latest(fact, "Assembly", "all", state).where("constituency is not null")
    if year:
        rows = rows.where(F.col("year") == year)
    tiles = rows.select("appearance_id", *_tile(rows), names.seat_key(F.col("constituency")).alias("ac_key"))
    tiles = tiles.join(seats, "ac_key", "left").withColumn("pc_key", names.seat_key(F.col("ls_pc")))
    return tiles.join(mps, "pc_key", "left").drop("ac_key", "pc_key").withColumn("ls_pc", F.coalesce("ls_pc", F.lit("")))


def constituency_dots(fact: DataFrame, centroids: DataFrame, state: str | None = None) -> DataFrame:
    """Current seats with a known centroid (name, lat, lng)."""
    rows = latest(fact, "Assembly", "current", state).where("constituency is not null")
    where = centroids.select(F.upper(F.trim("name")).alias("k"), "lat", "lng")
    return rows.select("appearance_id", *_tile(rows), names.seat_key(F.col("constituency"), spaces=False).alias("k")).join(where, "k").drop("k")


def map_by_constituency(tiles: DataFrame) -> DataFrame:
    """One tile per seat name; of several the last in order of name and id."""
    last = Window.partitionBy("key").orderBy(F.desc("constituency"), F.desc("appearance_id"))
    keyed = tiles.withColumn("key", F.upper(F.trim(F.regexp_replace("constituency", r"\s+", " "))))
    return keyed.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")


def dots_by_year(fact: DataFrame, house: str = "Assembly", state: str | None = None) -> DataFrame:
    rows = _scoped(fact, house, state).where("won and constituency is not null")
    return rows.select("appearance_id", *_tile(rows))


def tile_intensity(kpis: DataFrame) -> DataFrame:
    """Each state's average cases against the largest, for colour interpolation."""
    top = kpis.agg(F.max("avg_cases").alias("top")).withColumn("k", F.lit(1))
    rows = kpis.withColumn("k", F.lit(1)).join(F.broadcast(top), "k").drop("k")
    return rows.select("state", "avg_cases", F.coalesce(F.try_divide("avg_cases", "top"), F.lit(0.0)).alias("intensity"), severity(F.col("avg_cases")).alias("severity"))


# --- figures ---


def _kpis(rows: DataFrame, by: list[str]) -> DataFrame:
    sums = rows.groupBy(*by).agg(F.count("*").alias("count"), F.coalesce(F.sum(wealth()), F.lit(0)).alias("total_wealth_inr"), F.count_if(n_cases() > 0).alias("c"), F.count_if(is_crore()).alias("r"), F.coalesce(F.sum(n_cases()), F.lit(0)).alias("total_cases"))
    per = lambda x: F.coalesce(F.try_divide(x.cast("double"), F.col("count").cast("double")), F.lit(0.0))
    return sums.select(*by, "count", "total_wealth_inr", per(F.col("total_wealth_inr")).alias("avg_wealth_inr"), per(F.col("c") * 100).alias("pct_with_cases"), per(F.col("r") * 100).alias("pct_crorepati"), "total_cases", per(F.col("total_cases")).alias("avg_cases"))


def hero_kpis(fact: DataFrame, house: str = "Assembly", scope: str = "all", state: str | None = None, elections: DataFrame | None = None) -> DataFrame:
    """One row, zeros if nothing matches."""
    return _kpis(latest(fact, house, scope, state, elections), []).withColumn("house", F.lit(house))


def state_kpis(fact: DataFrame, house: str = "Assembly") -> DataFrame:
    return _kpis(current_by_state(fact, house), ["state"])


def zone_summary(fact: DataFrame) -> DataFrame:
    rows = current_by_state(fact).where("zone is not null")
    return rows.groupBy("zone").agg(
        F.count("*").alias("mlas"), _pct(F.count_if(n_cases() == 0), F.count("*")).alias("transparency"), (F.sum(n_cases()).cast("double") / F.count("*").cast("double")).alias("avg_cases"),
        F.array_join(F.array_sort(F.collect_set("state")), ",").alias("states"))


def coverage_summary(fact: DataFrame, registry: DataFrame) -> DataFrame:
    """``registry`` (state, years array<int>): which declared years have appearances."""
    have = fact.where("house = 'Assembly'").groupBy("state").agg(F.collect_set("year").alias("have"))
    rows = registry.join(have, "state", "left").withColumn("have", F.coalesce("have", F.array().cast("array<int>")))
    rows = rows.select("state", F.array_intersect("years", "have").alias("l"), F.array_except("years", "have").alias("m"))
    status = F.when(F.size("l") == 0, "none").when(F.size("m") > 0, "partial").otherwise("full")
    show = lambda c: F.array_join(F.sort_array(c, False), ",")
    return rows.select("state", status.alias("status"), show("l").alias("loaded"), show("m").alias("missing"))


def anomaly_scores(fact: DataFrame, house: str = "Assembly", state: str | None = None, scope: str = "current") -> DataFrame:
    rows = latest(fact, house, scope, state).withColumn("k", F.lit(1))
    median = _median_of_all(rows)
    rows = rows.join(F.broadcast(median), "k")  # one row
    ratio = F.greatest(F.lit(1.0), wealth().cast("double") / F.when(F.col("m") == 0, 1).otherwise(F.col("m")).cast("double"))
    rows = rows.withColumn("ratio", ratio).where((n_cases() > 0) | (F.col("ratio") >= 3))
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - n_cases() * 8 - F.log10(F.col("ratio") + 1) * 15))
    return rows.select("politician_id", "name", "appearance_id", n_cases().alias("cases"), wealth().alias("wealth_inr"), F.col("ratio").alias("wealth_x_median"), score.alias("score"), risk(score).alias("risk"))


def _median_of_all(rows: DataFrame) -> DataFrame:
    """The upper median of one large group without a window over it: count values, then walk the counts of distinct values
    range by range. Only range totals, and the distinct values of the one range with the middle, meet in one place."""
    values = rows.groupBy(wealth().alias("v")).agg(F.count("*").alias("n"))
    ranged = values.withColumn("range", F.floor(F.log2(F.col("v") + 1) * 64))
    totals = ranged.groupBy("range").agg(F.sum("n").alias("t"))  # at most 64 * 64 ranges
    by_range = Window.orderBy("range")
    totals = totals.withColumns({"upto": F.sum("t").over(by_range), "all": F.sum("t").over(Window.partitionBy())})
    target = F.col("all") - F.floor((F.col("all") - 1) / 2)
    hit = totals.where((F.col("upto") >= target) & (F.col("upto") - F.col("t") < target)).select("range", (target - F.col("upto") + F.col("t")).alias("nth"))
    inside = ranged.join(F.broadcast(hit), "range").withColumn("seen", F.sum("n").over(Window.orderBy("v")))
    return inside.where((F.col("seen") >= F.col("nth")) & (F.col("seen") - F.col("n") < F.col("nth"))).select(F.lit(1).alias("k"), F.col("v").alias("m"))


def anomaly_candidates(fact: DataFrame, limit: int = 50, house: str = "Assembly", state: str | None = None, scope: str = "current") -> DataFrame:
    return anomaly_scores(fact, house, state, scope).orderBy("score", "appearance_id").limit(limit)


def anomaly_ranks(fact: DataFrame, limit: int = 50, house: str = "Assembly", state: str | None = None, scope: str = "current") -> DataFrame:
    """``anomaly_candidates`` with the labels of the page's rows."""
    return rank_labels(anomaly_candidates(fact, limit, house, state, scope), "score", "appearance_id").orderBy("rank")


def anomaly_buckets(fact: DataFrame, house: str = "Assembly", state: str | None = None, scope: str = "current", first: int = 500) -> DataFrame:
    rows = anomaly_candidates(fact, first, house, state, scope)
    return rows.agg(*[F.count_if(F.col("risk") == r).alias(r) for r in ("critical", "suspicious", "standard")])


def did_you_know(fact: DataFrame, state: str | None = None) -> DataFrame:
    """Up to six sentences, numbered in order."""
    rows = latest(fact, None, "all", state)
    named = F.trim(F.coalesce("name", F.lit(""))) != ""
    richest, accused = F.max_by(F.struct("name", wealth().alias("x")), F.when(named, F.struct(wealth(), -F.col("appearance_id")))), F.max_by(F.struct("name", n_cases().alias("x")), F.when(named, F.struct(n_cases(), -F.col("appearance_id"))))
    whole = fact.agg(F.count("*").alias("entries"), F.count_distinct("politician_id").alias("people")).withColumn("k", F.lit(1))
    one = rows.agg(F.count("*").alias("n"), richest.alias("w"), accused.alias("c"), F.count_if(n_cases() > 0).alias("with_cases"), F.count_if(is_crore()).alias("rich"), F.min("year").alias("y1"), F.max("year").alias("y2"), F.count_distinct("year").alias("years")).withColumn("k", F.lit(1))
    one = one.join(F.broadcast(whole), "k")
    return _sentences(one)


def facts_of(rows: DataFrame, shown: Column, person: Column) -> DataFrame:
    """``did_you_know`` over rows of all appearances in one aggregation: ``shown`` marks the rows it speaks of, ``person`` one row of each politician."""
    named = shown & (F.trim(F.coalesce("name", F.lit(""))) != "")
    most = lambda x: F.max_by(F.struct("name", x.alias("x")), F.when(named, F.struct(x, -F.col("appearance_id"))))
    year = F.when(shown, F.col("year"))
    return _sentences(rows.agg(
        F.count_if(shown).alias("n"), most(wealth()).alias("w"), most(n_cases()).alias("c"), F.count_if(shown & (n_cases() > 0)).alias("with_cases"), F.count_if(shown & is_crore()).alias("rich"),
        F.min(year).alias("y1"), F.max(year).alias("y2"), F.count_distinct(year).alias("years"), F.count("*").alias("entries"), F.count_if(person).alias("people")))


def _sentences(one: DataFrame) -> DataFrame:
    """pos, fact, from one row of figures: n, w and c (the richest and the most accused), with_cases, rich, y1, y2, years, entries, people."""
    share = lambda c: F.floor(F.col(c) * 100 / F.col("n") + 0.5).cast("long").cast("string")
    facts = F.array(
        F.when(F.col("w.x") > 0, F.concat(F.lit("The wealthiest member on record is "), F.col("w.name"), F.lit(" with declared assets of "), F.floor(F.col("w.x") / CRORE).cast("long").cast("string"), F.lit(" crore."))),
        F.concat(share("with_cases"), F.lit("% of members on record have at least one declared criminal case.")),
        F.when(F.col("c.x") > 0, F.concat(F.col("c.name"), F.lit(" faces the most pending criminal cases: "), F.col("c.x").cast("string"), F.lit("."))),
        F.concat(share("rich"), F.lit("% of members are crorepatis.")),
        F.concat(F.lit("The data covers elections from "), F.col("y1").cast("string"), F.lit(" to "), F.col("y2").cast("string"), F.lit(": "), F.col("years").cast("string"), F.lit(" cycles.")),
        F.when(F.col("entries") > F.col("people"), F.concat((F.col("entries") - F.col("people")).cast("string"), F.lit(" entries are of politicians who stood more than once."))))
    empty = F.array(F.lit("Load some elections first."))
    return one.select(F.posexplode(F.when(F.col("n") > 0, F.array_compact(facts)).otherwise(empty)).alias("pos", "fact"))


# --- pages ---


def browse(fact: DataFrame, state: str, houses: tuple[str, ...] = ("Assembly", "LokSabha", "RajyaSabha"), q: str | None = None, party: str | None = None, year: int | None = None, sort: str = "name", order: str = "desc", cap: int = 1500) -> DataFrame:
    """Politicians with an appearance in the state and houses. The first ``cap`` by name are looked at, as the page does;
    party and year then match any appearance, not necessarily one and the same."""
    inside = fact.where((F.col("state") == state) & F.col("house").isin(*houses)).select("politician_id").distinct()
    when = F.struct("year", "appearance_id")
    people = fact.join(inside, "politician_id", "left_semi").groupBy("politician_id").agg(
        F.first("name").alias("name"), F.first("slug").alias("slug"), F.max_by(wealth(), when).alias("wealth_inr"), F.max_by(n_cases(), when).alias("cases"), F.count_if("won").alias("terms"),
        F.bool_or(F.coalesce(F.col("party") == (party or ""), F.lit(False))).alias("has_party"), F.bool_or(F.col("year") == (year or 0)).alias("has_year"))
    if q:
        people = people.where(F.col("name").ilike(f"%{q}%"))
    people = people.orderBy("name", "politician_id").limit(cap)
    if party:
        people = people.where("has_party")
    if year:
        people = people.where("has_year")
    return people.drop("has_party", "has_year").orderBy(_browse_key(sort, order), "politician_id")


def _browse_key(sort: str, order: str) -> Column:
    key = {"name": F.lower("name"), "wealth": F.col("wealth_inr"), "terms": F.col("terms"), "cases": F.col("cases")}[sort]
    return key.desc() if order == "desc" else key.asc()


def browse_ranks(fact: DataFrame, state: str, *, sort: str = "name", order: str = "desc", **filters) -> DataFrame:
    """``browse`` with the labels of the page's rows."""
    return rank_labels(browse(fact, state, sort=sort, order=order, **filters), _browse_key(sort, order), "politician_id").orderBy("rank")


def term_deltas(fact: DataFrame) -> DataFrame:
    """Each appearance against the one before, where that declared something."""
    order = Window.partitionBy("politician_id").orderBy("year", "appearance_id")
    rows = fact.select("politician_id", "appearance_id", "year", wealth().alias("assets"), F.lag(wealth()).over(order).alias("previous_inr"), F.lag("year").over(order).alias("from_year"))
    rows = rows.where("previous_inr > 0").withColumn("delta", F.col("assets") - F.col("previous_inr"))
    return rows.withColumn("pct", F.col("delta").cast("double") / F.col("previous_inr").cast("double") * 100)


def asset_trend(fact: DataFrame, assets: DataFrame, top: int = 8) -> DataFrame:
    """Per politician the ``top`` asset kinds by peak, in lakhs, for every year with an appearance (0 where absent). Of
    several values of one kind in a year the largest counts."""
    rows = assets.join(fact.select("appearance_id", "politician_id", "year"), "appearance_id")
    cells = rows.groupBy("politician_id", F.coalesce("category", F.lit("movable")).alias("category"), F.coalesce("subcategory", F.lit("Other")).alias("subcategory"), "year").agg(F.max(F.coalesce("value_inr", F.lit(0))).alias("value_inr"))
    kinds = cells.groupBy("politician_id", "category", "subcategory").agg(F.max("value_inr").alias("peak")).where("peak > 0")
    best = kinds.withColumn("n", F.row_number().over(Window.partitionBy("politician_id").orderBy(F.desc("peak"), "category", "subcategory"))).where(F.col("n") <= top)
    years = fact.select("politician_id", "year").distinct()
    dense = best.join(years, "politician_id").join(cells, ["politician_id", "category", "subcategory", "year"], "left")
    label = F.when(F.char_length("subcategory") > 50, F.concat(F.substring("subcategory", 1, 50), F.lit("…"))).otherwise(F.col("subcategory"))
    return dense.select("politician_id", "category", label.alias("label"), "peak", "year", (F.coalesce("value_inr", F.lit(0)).cast("double") / 1e5).alias("lakhs"))


def people(fact: DataFrame) -> DataFrame:
    return fact.groupBy("politician_id").agg(F.first("name").alias("name"), F.first("slug").alias("slug"), F.count("*").alias("appearances"))


def lookup(fact: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` (key, a few): the politician by slug, by the source's candidate id (where the fact has one), by number, or by slug in any
    case; the first way that hits (numbered from 1), then the smallest id. Each politician is read once, under all names that find them."""
    number = F.when(F.col("key").rlike(r"^\d+$"), F.col("key").try_cast("long").cast("string"))
    ways = [(F.col("key"), F.col("slug")), (number, F.col("politician_id").cast("string")), (F.lower("key"), F.lower("slug"))]
    extra = []
    if "candidate_id" in fact.columns:
        extra = [F.max("candidate_id").alias("candidate_id")]
        ways.insert(1, (number, F.col("candidate_id").cast("string")))
    who = fact.groupBy("politician_id").agg(F.first("name").alias("name"), F.first("slug").alias("slug"), *extra)
    numbered = lambda xs: F.explode(F.array(*[F.struct(F.lit(w).alias("way"), x.alias("called")) for w, x in enumerate(xs, 1)]))
    asked = keys.select("key", numbered(k for k, _ in ways).alias("a")).select("key", "a.*")
    named = who.select("politician_id", "name", numbered(c for _, c in ways).alias("c")).select("politician_id", "name", "c.*")
    found = named.join(F.broadcast(asked), ["way", "called"])  # a row per way for each of a few keys
    return found.groupBy("key").agg(F.min(F.struct("way", "politician_id", "name")).alias("r")).select("key", "r.*")


def profile(fact: DataFrame, cases: DataFrame, keys: DataFrame) -> DataFrame:
    """The page of each politician that ``keys`` (key) name: appearances, newest first (``nth`` from 1), each with the change since the
    one before and its cases, the sections of which are listed in the order of ``case_no``. cases: (appearance_id, case_no, ipc)."""
    who = lookup(fact, keys).select("key", "politician_id")
    rows = fact.join(who, "politician_id")
    order = Window.partitionBy("key").orderBy(F.desc("year"), F.desc("appearance_id"))
    rows = rows.withColumn("nth", F.row_number().over(order)).select("key", "nth", "politician_id", "name", "appearance_id", "year", party_or_ind().alias("party"), "constituency", "won", wealth().alias("assets"))
    deltas = term_deltas(fact.join(who.select("politician_id").distinct(), "politician_id")).select("appearance_id", "from_year", "delta", "pct")
    told = cases.join(rows.select("appearance_id"), "appearance_id", "left_semi").groupBy("appearance_id").agg(F.count("*").alias("n_cases"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("case_no", "ipc"))), lambda c: c["ipc"]), "; ").alias("sections"))
    rows = rows.join(deltas, "appearance_id", "left").join(told, "appearance_id", "left")
    return rows.withColumns({"n_cases": F.coalesce("n_cases", F.lit(0)), "sections": F.coalesce("sections", F.lit(""))})


def heat_map(fact: DataFrame, areas: DataFrame) -> DataFrame:
    """Every area of a map (column ``name``) with its seat's newest winner, by seat key; areas without one stay, without numbers."""
    won = fact.where("house = 'Assembly' and won and constituency is not null").withColumn("seat", names.seat_key(F.col("constituency"), ampersand=True))
    newest = F.max_by(F.struct("constituency", F.col("name").alias("mla"), wealth().alias("wealth_inr"), n_cases().alias("cases")), F.struct("year", -F.col("appearance_id")))
    tiles = won.groupBy("seat").agg(newest.alias("t")).select("seat", "t.*")
    areas = areas.withColumn("seat", names.seat_key(F.col("name"), ampersand=True))
    return areas.join(tiles, "seat", "left").select("name", "constituency", "mla", "wealth_inr", "cases", severity(F.col("cases")).alias("severity"))


def similar_names(fact: DataFrame, slug: str, limit: int = 6) -> DataFrame:
    tokens = [t for t in slug.split("-") if len(t) > 2]
    hit = F.exists(F.array(*[F.lit(t) for t in tokens]).cast("array<string>"), lambda t: F.ilike(F.col("name"), F.concat(F.lit("%"), t, F.lit("%")))) if tokens else F.lit(False)
    return people(fact).where(hit).orderBy("politician_id").limit(limit)


def autocomplete(fact: DataFrame, q: str, limit: int = 8) -> DataFrame:
    when = F.struct("year", "appearance_id")
    rows = fact.where(F.col("name").ilike(f"%{q}%") & F.lit(len(q) >= 2))
    rows = rows.groupBy("politician_id").agg(F.first("name").alias("name"), F.first("slug").alias("slug"), F.max_by(party_or_ind(), when).alias("party"), F.max_by("constituency", when).alias("constituency"))
    return rows.orderBy("name", "politician_id").limit(limit)


def politicians_page(fact: DataFrame, limit: int = 50, offset: int = 0, q: str | None = None) -> DataFrame:
    who = people(fact)
    if q:
        who = who.where(F.col("name").ilike(f"%{q}%"))
    return who.orderBy("name", "politician_id").offset(offset).limit(min(limit, 200))


def api_stats(fact: DataFrame) -> DataFrame:
    return fact.agg(F.count_distinct("politician_id").alias("politicians"), F.count("*").alias("appearances"), F.count_distinct("party").alias("parties"), F.count_distinct("state", "house", "year").alias("elections"))


def elections(fact: DataFrame) -> DataFrame:
    return fact.select("state", "house", "year").distinct()


def leaderboards(fact: DataFrame, limit: int = 5) -> DataFrame:
    cols = lambda board, value: (F.lit(board).alias("board"), "politician_id", "name", F.col(value).cast("long").alias("value"))
    return (
        top_by_wealth(fact, limit).select(*cols("wealth", "assets")).unionByName(top_by_cases(fact, limit).select(*cols("cases", "cases")))
        .unionByName(wealth_movers(fact, limit, "gain").select(*cols("gain", "delta"))).unionByName(wealth_movers(fact, limit, "loss").select(*cols("loss", "delta"))))


def random_politician(fact: DataFrame, seed: int = 0) -> DataFrame:
    """A uniform pick that a seed fixes."""
    return people(fact).orderBy(F.md5(F.concat_ws("|", "politician_id", F.lit(seed)).cast("binary")), "politician_id").limit(1)


def case_type_counts(texts: DataFrame, types: Column) -> DataFrame:
    """Rows per label; each distinct text is labelled once."""
    distinct = texts.groupBy(*texts.columns).agg(F.count("*").alias("rows_"))
    return distinct.select(F.explode(types).alias("case_type"), "rows_").groupBy("case_type").agg(F.sum("rows_").alias("n"))
