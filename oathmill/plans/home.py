"""The home page: every section from one scan of the fact, as one frame.

The fact is dealt to politicians once, each with all appearances as one array. From it come, over the same exchange,

* the rankings: each politician's entries for every leaderboard, cut to the first of each board in one ranking pass;
* the sums: cells by state, zone, house, year and party, which are then summed under every section that needs them;
* the rows of maps and plots, the medians of the parties and the figures behind the sentences.

Columns: section, pos (rank or place, from 1 in rankings, else null), id, name, label, state, house, year, party, count, with_cases,
crorepati, amount_inr, from_inr, cases, pct. Averages follow from amount and count. Sections of leaderboards and KPIs are of the
given house and scope, those of parties, cycles and maps of the Assembly, as on the page; ``state`` scopes all but india_states,
zones and cycles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oathmill.plans import analytics as A
from oathmill.plans.model import CRORE, LAKH

OUT = {
    "section": "string", "pos": "int", "id": "long", "name": "string", "label": "string", "state": "string", "house": "string", "year": "int", "party": "string", "count": "long",
    "with_cases": "long", "crorepati": "long", "amount_inr": "long", "from_inr": "long", "cases": "long", "pct": "double",
}
_ROW = ("year", "appearance_id", "name", "state", "zone", "house", "constituency", "party", "won", "assets", "cases")


def careers(fact: DataFrame) -> DataFrame:
    """politician_id, a: their appearances in order of year and id. The one exchange that all sections read."""
    return fact.groupBy("politician_id").agg(F.array_sort(F.collect_list(F.struct(*_ROW))).alias("a"))


def _money(x: Column) -> Column:
    return F.coalesce(x["assets"], F.lit(0)).cast("long")


def _cases(x: Column) -> Column:
    return F.coalesce(x["cases"], F.lit(0)).cast("long")


def _in(x: Column, house: str | None, state: str | None) -> Column:
    tests = [x["house"] == house] if house else []
    tests += [x["state"] == state] if state else []
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out


def _entry(**values: Column | str | None) -> Column:
    """A struct of OUT's columns but ``pos``, with what ranks it (``by``, then ``then``, largest first; then the id)."""
    kinds = {k: v for k, v in OUT.items() if k != "pos"} | {"by": "double", "then": "long"}
    cell = lambda v: F.lit(v) if v is None or isinstance(v, str) else v
    return F.struct(*[cell(values.get(k)).cast(kind).alias(k) for k, kind in kinds.items()])


def _boards(house: str, state: str | None, scope: str, newest: Column) -> Column:
    """Array of a politician's entries for the leaderboards."""
    here = F.filter("a", lambda x: _in(x, house, state))
    own = F.filter("a", lambda x: _in(x, house, None))
    last_year = F.array_max(F.transform(own, lambda x: x["year"]))
    if scope == "current":
        shown = F.filter(here, lambda x: (x["year"] == newest) & F.coalesce(x["won"], F.lit(False)))
    else:
        shown = F.filter(here, lambda x: x["year"] == last_year)
    told = F.filter(here, lambda x: x["assets"].isNotNull())
    won = F.filter(here, lambda x: F.coalesce(x["won"], F.lit(False)))
    parties = F.transform(F.filter("a", lambda x: _in(x, None, state) & x["party"].isNotNull()), lambda x: F.struct(x["party"].alias("party"), x["year"].alias("year")))
    of = F.col("politician_id")

    def card(section: str, x: Column, by: Column) -> Column:
        return _entry(section=section, id=x["appearance_id"], name=x["name"], label=x["constituency"], year=x["year"], party=F.coalesce(x["party"], F.lit("IND")), amount_inr=_money(x), cases=_cases(x), by=by)

    def first(rows: Column) -> Column:
        return F.get(rows, F.lit(0))

    def last(rows: Column) -> Column:
        return F.try_element_at(rows, F.lit(-1))

    def cards(section: str, fits, by) -> Column:
        return F.transform(F.filter(shown, fits), lambda x: card(section, x, by(x).cast("double")))

    a, b = first(told), last(told)
    grown = (b["assets"] - a["assets"]).cast("double") * 100
    way = lambda section, fits, pct, by: F.when(
        (F.size(told) >= 2) & fits, F.array(_entry(section=section, id=of, name=b["name"], label=b["constituency"], year=b["year"], party=b["party"], from_inr=a["assets"], amount_inr=b["assets"], pct=pct, by=by))
    ).otherwise(F.array())
    ratio = F.round(F.try_divide((b["assets"] - a["assets"]).cast("double"), a["assets"].cast("double")) * 100)
    switches = F.size(F.filter(F.sequence(F.lit(1), F.size(parties)), lambda i: (i > 1) & (F.get(parties, i - 1)["party"] != F.get(parties, i - 2)["party"])))
    journey = F.array_join(F.transform(parties, lambda p: p["party"]), " > ")
    served = F.when(F.size(won) >= 2, F.array(_entry(
        section="long_servers", id=of, name=last(won)["name"], year=last(won)["year"], from_inr=None, count=F.size(won), by=F.size(won), then=last(won)["year"]))).otherwise(F.array())
    moved = F.when(F.size(F.array_distinct(F.transform(parties, lambda p: p["party"]))) >= 2, F.array(_entry(
        section="switchers", id=of, name=last(F.col("a"))["name"], label=journey, year=last(parties)["year"], party=last(parties)["party"], count=switches, by=switches, then=last(parties)["year"]))).otherwise(F.array())
    return F.flatten(F.array(
        cards("top_wealth", lambda x: F.coalesce(x["assets"] != 0, F.lit(False)), _money),
        cards("top_cases", lambda x: _cases(x) > 0, _cases),
        cards("clean_wealthy", lambda x: (_money(x) >= 5 * CRORE) & (_cases(x) == 0), _money),
        way("wealth_multipliers", (a["assets"] >= LAKH) & (b["assets"] > a["assets"]), ratio, ratio),
        way("crorepati_newcomers", (a["assets"] < CRORE) & (b["assets"] >= CRORE), grown / F.greatest(a["assets"], F.lit(1)).cast("double"), b["assets"]),
        served, moved))


def _ranked(people: DataFrame, house: str, state: str | None, scope: str, limit: int) -> DataFrame:
    newest = F.lit(None).cast("int")
    if scope == "current":
        years = people.select(F.explode(F.filter("a", lambda x: _in(x, house, state))).alias("x")).agg(F.max("x.year").alias("newest"))  # one row
        people, newest = people.crossJoin(F.broadcast(years)), F.col("newest")
    entries = people.select(F.explode(_boards(house, state, scope, newest)).alias("e")).select("e.*")
    order = Window.partitionBy("section").orderBy(F.desc("by"), F.desc("then"), "id")
    return entries.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit).drop("by", "then")


def _cells(rows: DataFrame, house: str) -> DataFrame:
    """Sums per state, zone, house, year and party: of all rows (n), of winners (w_) and of politicians' newest rows in the house (l_)."""
    measures = {"count": F.lit(1), "amount_inr": A.wealth(), "with_cases": (A.n_cases() > 0).cast("int"), "crorepati": A.is_crore().cast("int"), "cases": A.n_cases(), "clean": (A.n_cases() == 0).cast("int")}
    won, shown = F.coalesce("won", F.lit(False)), F.col("newest_in_house") & (F.col("house") == house)
    sums = [F.count("*").alias("n")] + [F.sum(F.when(on, m).otherwise(0)).cast("long").alias(f"{p}_{k}") for p, on in (("w", won), ("l", shown)) for k, m in measures.items()]
    return rows.groupBy("state", "zone", "house", "year", "party").agg(*sums)


_SUMS = ("count", "amount_inr", "with_cases", "crorepati", "cases")


def _sections(cells: DataFrame, house: str, state: str | None) -> DataFrame:
    """Every section of sums, from the cells: each cell goes to all sections it counts in, then one aggregation."""
    whole = Window.partitionBy("house") if state is None else Window.partitionBy("house", "state")
    here = F.lit(True) if state is None else F.coalesce(F.col("state") == state, F.lit(False))
    seat = here & (F.col("house") == "Assembly") & (F.col("w_count") > 0)
    cells = cells.withColumns({
        "newest": F.max("year").over(whole), "newest_of_state": F.max("year").over(Window.partitionBy("house", "state")), "here": here, "seat": seat,
        "years": F.array_sort(F.collect_set(F.when(seat, F.col("year"))).over(Window.partitionBy("house"))), "wealth": F.sum(F.when(seat & F.col("party").isNotNull(), F.col("w_amount_inr"))).over(Window.partitionBy("house", "party"))})
    cells = cells.withColumn("place", F.when(F.col("seat") & F.col("party").isNotNull(), F.dense_rank().over(Window.partitionBy("house").orderBy(F.desc_nulls_last("wealth"), F.asc_nulls_last("party")))))
    none = F.lit(None)

    def part(section: str, *, of: str = "w", state: Column = none, house: Column = none, year: Column = none, party: Column = none, label: Column = none, some: Column | None = None) -> Column:
        cell = lambda k: F.col(f"{of}_{k}") if some is None else F.when(some, F.col(f"{of}_{k}")).otherwise(0)
        return F.struct(F.lit(section).alias("section"), state.cast("string").alias("state"), house.cast("string").alias("house"), year.cast("int").alias("year"), party.cast("string").alias("party"), label.cast("string").alias("label"),
                        *[cell(k).cast("long").alias(k) for k in _SUMS], cell("clean").cast("long").alias("clean"))

    def dense(section: str, party: Column) -> Column:
        return F.transform("years", lambda y: part(section, year=y, party=party, some=y == F.col("year")))

    house_, state_, year_, party_ = (F.col(c) for c in ("house", "state", "year", "party"))
    ind, won = F.coalesce("party", F.lit("IND")), F.col("w_count") > 0
    current = won & (house_ == "Assembly") & (year_ == F.col("newest_of_state"))
    one = lambda on, x: F.when(F.coalesce(on, F.lit(False)), F.array(x)).otherwise(F.array())
    many = lambda on, xs: F.when(F.coalesce(on, F.lit(False)), xs).otherwise(F.array())
    entries = F.flatten(F.array(
        one(F.col("here") & (house_ == house), part("kpis_all", of="l")),
        one(F.col("here") & (house_ == house), part("kpis_current", some=year_ == F.col("newest"))),
        one(F.lit(True), part("cycles", state=state_, house=house_, year=year_)),
        one(F.col("here") & won, part("trends", state=state_, house=house_, year=year_)),
        one(F.col("here") & won & party_.isNotNull(), part("parties", party=party_)),
        many(seat, dense("party_seats", ind)),
        many(seat & (F.col("place") <= 5), dense("party_wealth", party_)),
        one(current, part("india_states", state=state_)),
        one(current & F.col("zone").isNotNull(), part("zones", label=F.col("zone")))))
    keys = ("section", "state", "house", "year", "party", "label")
    sums = cells.select(F.explode(entries).alias("e")).select("e.*").groupBy(*keys).agg(*[F.sum(k).alias(k) for k in (*_SUMS, "clean")])
    # of zones the share without cases, else that with cases
    share = F.try_divide(F.when(F.col("section") == "zones", F.col("clean")).otherwise(F.col("with_cases")).cast("double") * 100, F.col("count").cast("double"))
    return sums.withColumn("pct", F.coalesce(share, F.lit(0.0))).drop("clean")


def _rows(rows: DataFrame, state: str | None) -> DataFrame:
    """The points of plots and maps: an appearance may be in several."""
    here = F.lit(True) if state is None else F.coalesce(F.col("state") == state, F.lit(False))
    seat = here & (F.col("house") == "Assembly") & F.col("constituency").isNotNull()
    named = F.array_compact(F.array(
        F.when(here & F.col("newest_of_all"), "scatter"), F.when(seat & F.col("newest_in_house"), "tiles"), F.when(seat & F.coalesce("won", F.lit(False)), "dots_by_year")))
    return rows.select(
        F.explode(named).alias("section"), F.col("appearance_id").alias("id"), "name", F.col("constituency").alias("label"), "state", "house", "year", A.party_or_ind().alias("party"), A.wealth().alias("amount_inr"), A.n_cases().alias("cases"))


def _shaped(rows: DataFrame) -> DataFrame:
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in OUT.items()])


def home(fact: DataFrame, house: str = "Assembly", scope: str = "current", state: str | None = None, limit: int = 10) -> DataFrame:
    """All sections of the page in one frame."""
    people = careers(fact)
    newest = F.array_max(F.transform("a", lambda x: x["year"]))
    in_house = F.map_from_entries(F.transform(F.array_distinct(F.transform("a", lambda x: F.coalesce(x["house"], F.lit("")))), lambda h: F.struct(
        h.alias("house"), F.array_max(F.transform(F.filter("a", lambda x: F.coalesce(x["house"], F.lit("")) == h), lambda x: x["year"])).alias("year"))))
    rows = people.select(newest.alias("newest"), in_house.alias("in_house"), F.posexplode("a").alias("nth", "x")).select(
        "nth", "x.*", (F.col("x.year") == F.col("newest")).alias("newest_of_all"), (F.col("x.year") == F.try_element_at("in_house", F.coalesce("x.house", F.lit("")))).alias("newest_in_house"))
    sums = _sections(_cells(rows, house), house, state)
    winners = A._scoped(rows, None, state).where("won and party is not null")
    medians = A.upper_median(winners, ["party"], A.wealth(), "median").select(F.lit("parties").alias("s"), F.col("party").alias("p"), F.col("median").alias("from_inr"))
    sums = sums.join(medians, (F.col("section") == F.col("s")) & (F.col("party") == F.col("p")), "left").drop("s", "p")
    seats = F.count_distinct(F.when(F.col("constituency").isNotNull(), F.struct("state", "house", "constituency")))
    one = rows.agg(seats.alias("count")).withColumn("section", F.lit("unique_constituencies"))
    told = A.facts_of(rows, F.col("newest_of_all") & (F.lit(True) if state is None else F.coalesce(F.col("state") == state, F.lit(False))), F.col("nth") == 0)
    told = told.select(F.lit("facts").alias("section"), F.col("pos"), F.col("fact").alias("label"))
    out = _shaped(_ranked(people, house, state, scope, limit))
    for part in (sums, _rows(rows, state), one, told):
        out = out.unionByName(_shaped(part))
    return out
