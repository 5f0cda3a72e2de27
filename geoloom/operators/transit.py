"""Schedule operators: calendars, service days, calls, patterns, transfers, as-of boarding, rounds of earliest arrival."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .routing import cutter

DAY, INTERCHANGE = 86_400, 90


def active_services(calendar: DataFrame, exceptions: DataFrame, day: date) -> DataFrame:
    """Services running on ``day``: (service, days array from Monday, start, end) with exceptions (service, date, type: 1 added, 2 removed) either way."""
    d = F.lit(day)
    base = calendar.select("service", ((F.element_at("days", day.weekday() + 1) == 1) & d.between(F.col("start"), F.col("end"))).alias("base"))
    told = exceptions.where(F.col("date") == d).groupBy("service").agg(F.max(F.col("type") == 1).alias("added"))
    return base.join(told, "service", "full").where(F.coalesce("added", "base", F.lit(False))).select("service")


def service_window(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    both = calendar.select("start", "end").unionByName(exceptions.select(F.col("date").alias("start"), F.col("date").alias("end")))
    return both.agg(F.min("start").alias("first_day"), F.max("end").alias("last_day"))


def resolve_day(wanted: date, served: set[date], window: tuple[date, date]) -> date | None:
    """The day itself, else within 14 days (later first), else inward from the start of the window (a day before it) or from its end, up to 400 days."""
    near = [wanted + timedelta(days=s * k) for k in range(15) for s in ((1,) if k == 0 else (1, -1))]
    first, last = window
    before = wanted < first
    far = [first + timedelta(days=k) if before else last - timedelta(days=k) for k in range(400)]
    return next((d for d in (*near, *far) if d in served), None)


def day_view(stop_times: DataFrame, trips: DataFrame, today: DataFrame, yesterday: DataFrame) -> DataFrame:
    """Calls of a day: its own trips, and those of the day before that end at 24:00 or later, 86,400 s earlier."""
    calls = stop_times.join(trips.select("trip", "service"), "trip")
    late = stop_times.groupBy("trip").agg(F.max("arr").alias("last")).where(F.col("last") >= DAY).select("trip")
    own = calls.join(today, "service", "left_semi").withColumn("run", F.col("trip"))
    shifted = calls.join(yesterday, "service", "left_semi").join(late, "trip", "left_semi")
    shifted = shifted.withColumns({"arr": F.col("arr") - DAY, "dep": F.col("dep") - DAY, "run": F.concat("trip", F.lit("<"))})
    return own.unionByName(shifted).drop("service")


def folded_calls(calls: DataFrame) -> DataFrame:
    """Calls of a trip (trip, seq, stop, arr, dep) without repeats of the station last kept and without times that run backwards; trips with two calls or more."""
    call = F.struct("seq", "stop", "arr", "dep")
    ordered = F.array_sort(F.collect_list(call))
    start = F.array().cast("array<struct<seq:int,stop:string,arr:int,dep:int>>")

    def step(kept, c):
        last = F.try_element_at(kept, F.lit(-1))
        fine = last.isNull() | ((last["stop"] != c["stop"]) & (c["dep"] >= last["dep"]))
        return F.when(fine, F.concat(kept, F.array(c))).otherwise(kept)

    typed = calls.select("trip", F.col("seq").cast("int"), F.col("stop").cast("string"), F.col("arr").cast("int"), F.col("dep").cast("int"))
    kept = typed.groupBy("trip").agg(ordered.alias("c")).withColumn("c", F.aggregate("c", start, step)).where(F.size("c") >= 2)
    return kept.select("trip", F.posexplode("c").alias("pos", "x")).select("trip", "pos", "x.stop", "x.arr", "x.dep")


def patterns(calls: DataFrame, trips: DataFrame) -> DataFrame:
    """Trips by route and exact sequence of stops: number of trips, first departure."""
    seq = calls.groupBy("trip").agg(F.array_sort(F.collect_list(F.struct("pos", "stop")))["stop"].alias("stops"), F.min("dep").alias("dep"))
    return seq.join(trips.select("trip", "route"), "trip").groupBy("route", "stops").agg(F.count("*").alias("trips"), F.min("dep").alias("first_dep"))


def minimal_transfers(official: DataFrame, geometric: DataFrame) -> DataFrame:
    """(src, dst, seconds): the shortest of both kinds, 90 s where none is given, none inside a station."""
    both = official.unionByName(geometric).where("src <> dst")
    return both.groupBy("src", "dst").agg(F.min(F.coalesce("seconds", F.lit(INTERCHANGE))).alias("seconds"))


def geometric_transfers(near: DataFrame, speed: float = 4.8 / 3.6) -> DataFrame:
    return near.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.greatest((F.col("distance") / speed).cast("int"), F.lit(INTERCHANGE)).alias("seconds"))


def asof_forward(left: DataFrame, right: DataFrame, key: str, time: str, right_time: str, take: list[str]) -> DataFrame:
    """Each left row with the first right row of its key at or after its time: one sort of both sides, no range join, so hot keys only sort."""
    none = lambda c, k: F.lit(None).cast(k).alias(c)
    kinds = dict(right.dtypes)
    l = left.select(*left.columns, F.col(time).alias("_t"), F.lit(0).alias("_side"), *(none(f"_r_{c}", kinds[c]) for c in take))  # noqa: E741
    lk = dict(left.dtypes)
    r = right.select(*(F.col(key) if c == key else none(c, lk[c]) for c in left.columns), F.col(right_time).alias("_t"), F.lit(1).alias("_side"), *(F.col(c).alias(f"_r_{c}") for c in take))
    after = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(0, Window.unboundedFollowing)
    first = F.first(F.when(F.col("_side") == 1, F.struct(*(F.col(f"_r_{c}").alias(c) for c in take))), ignorenulls=True).over(after)
    return l.unionByName(r).withColumn("_m", first).where("_side = 0").select(*left.columns, *(F.col(f"_m.{c}").alias(f"next_{c}") for c in take))


def _improved(found: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A round's stops, written to the shared folder so that no later round runs it again; those at which one is ready earlier than in
    all rounds before (others lead nowhere new); and the earliest of all rounds."""
    old = known.select("origin", "stop", F.col("ready").alias("_old"))
    found = cutter(found.sparkSession)(found.join(old, ["origin", "stop"], "left").withColumn("_new", F.expr("_old is null or ready < _old")).drop("_old"))
    better = found.where("_new").drop("_new")
    return found.drop("_new"), better, known.unionByName(better.select("origin", "stop", "ready")).groupBy("origin", "stop").agg(F.min("ready").alias("ready"))


def earliest_arrivals(initial: DataFrame, calls: DataFrame, transfers: DataFrame, limit: int, max_transfers: int = 3) -> DataFrame:
    """(origin, stop, arrival, vehicles) from initial (origin, stop, ready), in rounds of one ride and one walk each.

    A ride boards the earliest call at or after the ready time; after a ride a change takes 90 s at the platform, after a walk none.
    """
    walked = initial.join(transfers, F.col("stop") == F.col("src")).select("origin", F.col("dst").alias("stop"), (F.col("ready") + F.col("seconds")).alias("ready")).where(F.col("ready") <= limit)
    ready = initial.select("origin", "stop", "ready").unionByName(walked).groupBy("origin", "stop").agg(F.min("ready").alias("ready"))
    best, known = ready.select("origin", "stop", F.col("ready").alias("arrival"), F.lit(0).alias("vehicles")), ready.select("origin", "stop", "ready")
    calls, transfers = (cutter(initial.sparkSession)(x) for x in (calls.where(F.col("arr") <= limit), transfers))  # every round reads them
    on = calls.where(F.col("dep") <= limit).select(F.col("run").alias("r"), F.col("stop").alias("board"), F.col("dep").alias("bdep"), F.col("pos").alias("bpos"))
    off = calls.select(F.col("run").alias("r"), F.col("stop").alias("alight"), "arr", "pos")
    for k in range(1, min(max_transfers, 3) + 2):
        boarded = ready.join(on, (F.col("stop") == F.col("board")) & (F.col("bdep") >= F.col("ready"))).groupBy("origin", "r").agg(F.min("bpos").alias("bpos"))
        rides = boarded.join(off, "r").where((F.col("pos") > F.col("bpos")) & (F.col("arr") <= limit)).groupBy("origin", F.col("alight").alias("stop")).agg(F.min("arr").alias("arrival"))
        walks = rides.join(transfers, F.col("stop") == F.col("src")).select("origin", F.col("dst").alias("stop"), (F.col("arrival") + F.col("seconds")).alias("arrival")).where(F.col("arrival") <= limit)
        both = rides.withColumn("ready", F.col("arrival") + INTERCHANGE).unionByName(walks.withColumn("ready", F.col("arrival")))
        found = both.groupBy("origin", "stop").agg(F.min("arrival").alias("arrival"), F.min("ready").alias("ready")).withColumn("vehicles", F.lit(k))
        found, ready, known = _improved(found, known)
        best = best.unionByName(found.select("origin", "stop", "arrival", "vehicles"))
        if not ready.limit(1).count():
            break
    return best.groupBy("origin", "stop").agg(F.min(F.struct("arrival", "vehicles")).alias("m")).select("origin", "stop", "m.arrival", "m.vehicles")


LEG = "array<struct<kind:string,run:string,src:string,dst:string,dep:int,arr:int>>"


def journeys(initial: DataFrame, calls: DataFrame, transfers: DataFrame, limit: int, max_transfers: int = 3) -> DataFrame:
    """(origin, stop, arrival, vehicles, legs, ride_s, walk_s, wait_s) in the rounds of ``earliest_arrivals``, with the legs carried along.

    Ties go to fewer vehicles, then to the least legs in order. Riding, walking and waiting sum to the time from being ready to arriving.
    """
    leg = lambda kind, run, src, dst, dep, arr: F.struct(F.lit(kind).alias("kind"), run.alias("run"), src.alias("src"), dst.alias("dst"), dep.alias("dep"), arr.alias("arr"))
    ready = initial.select("origin", "stop", F.col("ready").cast("int"), F.col("ready").cast("int").alias("start"), F.array().cast(LEG).alias("legs"))
    calls, transfers = (cutter(initial.sparkSession)(x) for x in (calls.where(F.col("arr") <= limit), transfers))  # every round reads them
    on = calls.where(F.col("dep") <= limit).select(F.col("run").alias("r"), F.col("stop").alias("board"), F.col("dep").alias("bdep"), F.col("pos").alias("bpos"))
    off = calls.select(F.col("run").alias("r"), F.col("stop").alias("alight"), "arr", "pos")
    walk = transfers.select(F.col("src").alias("wsrc"), F.col("dst").alias("wdst"), "seconds")
    at = (F.col("ready") + F.col("seconds")).cast("int")
    walked = ready.join(walk, F.col("stop") == F.col("wsrc")).where(at <= limit).select("origin", F.col("wdst").alias("stop"), at.alias("ready"), "start", F.array(leg("walk", F.lit(None).cast("string"), F.col("wsrc"), F.col("wdst"), F.col("ready"), at)).cast(LEG).alias("legs"))
    ready = ready.unionByName(walked).groupBy("origin", "stop").agg(F.min(F.struct("ready", "legs", "start")).alias("m")).select("origin", "stop", "m.ready", "m.start", "m.legs")
    best, known = ready.select("origin", "stop", F.col("ready").alias("arrival"), F.lit(0).alias("vehicles"), "start", "legs"), ready.select("origin", "stop", "ready")
    for k in range(1, min(max_transfers, 3) + 2):
        boarded = ready.join(on, (F.col("stop") == F.col("board")) & (F.col("bdep") >= F.col("ready"))).groupBy("origin", "r").agg(F.min(F.struct("bpos", "legs", "board", "bdep", "start")).alias("b"))
        rides = boarded.join(off, "r").where((F.col("pos") > F.col("b.bpos")) & (F.col("arr") <= limit))
        legs = F.concat(F.col("b.legs"), F.array(leg("ride", F.col("r"), F.col("b.board"), F.col("alight"), F.col("b.bdep"), F.col("arr"))))
        rides = rides.groupBy("origin", F.col("alight").alias("stop")).agg(F.min(F.struct(F.col("arr").alias("arrival"), legs.alias("legs"), F.col("b.start").alias("start"))).alias("m")).select("origin", "stop", "m.*")
        arrives = F.col("arrival") + F.col("seconds")
        walks = rides.join(walk, F.col("stop") == F.col("wsrc")).where(arrives <= limit)
        walks = walks.select("origin", F.col("wdst").alias("stop"), arrives.alias("arrival"), F.concat("legs", F.array(leg("walk", F.lit(None).cast("string"), F.col("wsrc"), F.col("wdst"), F.col("arrival"), arrives))).alias("legs"), "start")
        both = rides.withColumn("ready", F.col("arrival") + INTERCHANGE).unionByName(walks.withColumn("ready", F.col("arrival")))
        least = F.min(F.struct("arrival", "legs", "start")).alias("a")
        found = both.groupBy("origin", "stop").agg(F.min(F.struct("ready", "legs", "start")).alias("m"), least).select("origin", "stop", "a", "m.ready", "m.start", "m.legs")
        found, ready, known = _improved(found, known)
        best = best.unionByName(found.select("origin", "stop", "a.arrival", F.lit(k).alias("vehicles"), "a.start", "a.legs"))
        ready = ready.drop("a")
        if not ready.limit(1).count():
            break
    out = best.groupBy("origin", "stop").agg(F.min(F.struct("arrival", "vehicles", "legs", "start")).alias("m")).select("origin", "stop", "m.*")
    spent = lambda kind: F.aggregate(F.filter("legs", lambda x: x["kind"] == kind), F.lit(0), lambda s, x: s + x["arr"] - x["dep"])
    out = out.withColumn("ride_s", spent("ride")).withColumn("walk_s", spent("walk"))
    return out.withColumn("wait_s", F.col("arrival") - F.col("start") - F.col("ride_s") - F.col("walk_s")).drop("start")


def itinerary(legs: F.Column) -> F.Column:
    """The steps of a journey as text: board, ride and exit, or walk."""
    step = lambda x: F.when(x["kind"] == "ride", F.concat(F.lit("ride "), x["run"], F.lit(" "), x["src"], F.lit(">"), x["dst"])).otherwise(F.concat(F.lit("walk "), x["src"], F.lit(">"), x["dst"]))
    return F.array_join(F.transform(legs, step), "; ")


def steps(start: F.Column, legs: F.Column, egress: F.Column | None = None) -> F.Column:
    """A journey as steps (kind, run, src, dst, seconds): walk, wait, ride ..., and with ``egress`` (seconds) the walk at its end.
    What passes between the start and the first leg is the way to the stop and the wait there, told as one walk."""
    none = F.lit(None).cast("string")
    made = lambda kind, run, src, dst, seconds: F.struct(F.lit(kind).alias("kind"), run.alias("run"), src.alias("src"), dst.alias("dst"), seconds.cast("int").alias("seconds"))

    def step(x, i):
        before = F.when(i == 0, start).otherwise(F.try_element_at(legs, i)["arr"])
        gap = x["dep"] - before
        own = F.when(x["kind"] == "ride", made("ride", x["run"], x["src"], x["dst"], x["arr"] - x["dep"])).otherwise(made("walk", none, x["src"], x["dst"], x["arr"] - x["dep"]))
        pause = F.when(i == 0, made("walk", none, none, x["src"], gap)).otherwise(made("wait", none, x["src"], x["src"], gap))
        return F.when(gap > 0, F.array(pause, own)).otherwise(F.array(own))

    out = F.flatten(F.transform(legs, step))
    return out if egress is None else F.concat(out, F.array(made("walk", none, F.try_element_at(legs, F.lit(-1))["dst"], none, F.round(egress))))


def with_detail(rows: DataFrame, journeys: DataFrame, order: str = "minutes", most: int = 12) -> DataFrame:
    """``rows`` (origin, category, service, ...) with the journey (of ``journeys``: origin, service, steps) of the first ``most`` of each origin and category; the others have none."""
    near = Window.partitionBy("origin", "category").orderBy(order, "service")
    ranked = rows.withColumn("_r", F.row_number().over(near))
    found = journeys.select("origin", "service", "steps")
    return ranked.join(found, ["origin", "service"], "left").withColumn("steps", F.when(F.col("_r") <= most, F.col("steps"))).drop("_r")


def used_segments(found: DataFrame) -> DataFrame:
    """Distinct rides (run, src, dst) of all journeys."""
    return found.select(F.explode("legs").alias("x")).where("x.kind = 'ride'").select("x.run", "x.src", "x.dst").distinct()
