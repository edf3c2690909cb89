"""Ordering arms in closed loop.

Demand does not answer to orders, so all that an arm believes (forecasts, regimes, switches, verified proposals, parameters)
is windows over demand: a goal for the stock and what is under way, a cap, a pipeline credit, or a fixed quantity, for each
period. Only stock and shipments feed back; closed_loop folds them over an episode's periods, in the JVM, for all arms.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quayside.operators.panel import BEFORE, UP_TO, ordered_fold, over

KEYS = ("episode", "arm")
NORMAL = NormalDist()
#: The order smoother's quantile.
CAP_Z = NORMAL.inv_cdf(0.95)


def moments(value: str, window: Window) -> tuple[Column, Column, Column]:
    """Count, mean and sample deviation (0 below two values) of whole numbers in a window, from exact sums."""
    n, s, q = F.count(value).over(window), F.sum(value).over(window), F.sum(F.col(value) * F.col(value)).over(window)
    return n, F.when(n > 0, s / n), F.when(n > 1, F.sqrt((n * q - s * s) / (n * (n - 1)))).otherwise(0.0)


def forecast(panel: DataFrame, keys: Sequence[str] = ("episode",), value: str = "demand", recent: int | None = None) -> DataFrame:
    """panel with n, mean and sd of all values before each row (or of the last recent ones, as recent_mean and recent_sd)."""
    n, mean, sd = moments(value, over(keys, frame=BEFORE))
    out = panel.withColumns({"n": n, "mean": mean, "sd": sd})
    if recent is None:
        return out
    _, near, spread = moments(value, over(keys, frame=(-recent, -1)))
    return out.withColumns({"recent_mean": F.coalesce(near, "mean"), "recent_sd": spread})


def with_training(panel: DataFrame, train: DataFrame, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """Training values as periods before the first: forecasts over the union see them, and where("period > 0") drops them."""
    size = F.count("*").over(Window.partitionBy(*keys))
    return panel.unionByName(train.withColumn("period", (F.col("period") - size).cast(panel.schema["period"].dataType)), allowMissingColumns=True)


def fractile(profit: Column, holding: Column) -> Column:
    return profit / (profit + holding)


def stock_goal(mean: Column, sd: Column, z: float, m: Column, lead: Column) -> Column:
    """Demand over the lead time and the period itself, scaled by m, and z of its deviations."""
    return m * (1 + lead) * mean + z * F.sqrt(1 + lead) * sd


def base_targets(rows: DataFrame, z: float, *, m: Column | None = None, lead: Column | None = None, gamma: Column | None = None) -> DataFrame:
    """rows (with forecasts) and goal, cap and gamma of a grid point; without columns, of the plain base stock."""
    one = F.lit(1.0)
    return rows.withColumns({"goal": stock_goal(F.col("mean"), F.col("sd"), z, one if m is None else m, F.lit(0) if lead is None else lead), "cap": F.col("mean") + CAP_Z * F.col("sd"), "gamma": one if gamma is None else gamma})


def regime_path(panel: DataFrame, value: str, means: tuple[float, float], sds: tuple[float, float], stay: tuple[float, float], keys: Sequence[str] = ("episode",)) -> DataFrame:
    """keys, period and p: the filtered probability of the second regime, given the values before the period."""
    t = "struct<p:double,path:array<struct<period:int,p:double>>>"
    init = F.struct(F.lit(0.0).alias("p"), F.array().cast("array<struct<period:int,p:double>>").alias("path")).cast(t)
    density = lambda x, k: F.exp(-((x - means[k]) / sds[k]) * ((x - means[k]) / sds[k]) / 2) / sds[k]

    def step(s: Column, row: Column) -> Column:
        x, here = row[value].cast("double"), F.array(F.struct(row["period"].cast("int").alias("period"), s["p"].alias("p")))
        ahead = (1 - s["p"]) * (1 - stay[0]) + s["p"] * stay[1]
        one, two = (1 - ahead) * density(x, 0), ahead * density(x, 1)
        return F.struct(F.when(one + two > 0, two / F.when(one + two > 0, one + two).otherwise(1.0)).otherwise(ahead).alias("p"), F.concat(s["path"], here).alias("path")).cast(t)

    return ordered_fold(panel, keys, [value], init, step).select(*keys, F.explode("result.path").alias("r")).select(*keys, "r.period", "r.p")


def telemetry_targets(rows: DataFrame, z: float, lead: int) -> DataFrame:
    """Base stock on level and deviation blended by p, between all values and the recent ones; the cap keeps to all values."""
    level = (1 - F.col("p")) * F.col("mean") + F.col("p") * F.col("recent_mean")
    spread = (1 - F.col("p")) * F.col("sd") + F.col("p") * F.col("recent_sd")
    return rows.withColumns({"goal": stock_goal(level, spread, z, F.lit(1.0), F.lit(lead)), "cap": F.col("mean") + CAP_Z * F.col("sd"), "gamma": F.lit(1.0)})


def switched(rows: DataFrame, active: Column, z: float, base_lead: int, m: Column, lead: Column, gamma: Column) -> DataFrame:
    """Targets of a compiled grid point where active, of the base stock elsewhere; the forecasts are the same."""
    pick = lambda a, b: F.when(F.coalesce(active, F.lit(False)), a).otherwise(b)
    return base_targets(rows, z, m=pick(m, F.lit(1.0)), lead=pick(lead, F.lit(base_lead)), gamma=pick(gamma, F.lit(1.0))).withColumn("active", F.coalesce(active, F.lit(False)))


def latched(rows: DataFrame, fired: Column, keys: Sequence[str] = ("episode",)) -> Column:
    """True from the first period with fired on."""
    return F.max(F.when(fired, 1).otherwise(0)).over(over(keys, frame=UP_TO)) == 1


def goal_order(state: Column, row: Column) -> Column:
    """The quantity given, or what is missing to the goal, rounded up, at most the cap."""
    missing = F.ceil(row["goal"] - state["stock"] - row["gamma"] * total(state["pipe"]))
    return F.coalesce(row["quantity"], F.greatest(F.lit(0.0), F.least(missing, F.ceil(row["cap"])).cast("double")), F.lit(0.0))


def constant_order(quantity: float) -> Callable[[Column, Column], Column]:
    return lambda state, row: F.lit(float(quantity))


def multiple_order(mean: float, lead: int, multiplier: float = 1.5) -> Callable[[Column, Column], Column]:
    """Up to a multiple of mean demand over the lead time, not rounded."""
    return lambda state, row: F.greatest(F.lit(0.0), mean * (lead + 1) * multiplier - state["stock"] - total(state["pipe"]))


def chase_order(mean: float, lead: int, gain: float = 1.25) -> Callable[[Column, Column], Column]:
    """Up to the last demand, raised, over the lead time, and a quarter of what the last order missed of its arrivals."""

    def order(state: Column, row: Column) -> Column:
        base = F.when(row["period"] > 1, state["demand"] * gain).otherwise(mean)
        short = F.greatest(F.lit(0.0), state["ordered"] - state["arrived"])
        return F.greatest(F.lit(0.0), base * (lead + 1) + 0.25 * short - state["stock"] - total(state["pipe"]))

    return order


def total(pipe: Column) -> Column:
    return F.aggregate(pipe, F.lit(0.0), lambda a, x: a + x)


def closed_loop(panel: DataFrame, order: Callable[[Column, Column], Column] = goal_order, *, max_lead: int = 4, order_cap: float = math.inf, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, period, ordered, arrivals, sold, lost and on_hand_end, by an order rule of state and row.

    panel: period, demand, lead_time (null: lost), pause, and goal, cap, gamma and quantity for goal_order. In a period:
    order, dispatch, receive what has no periods left, sell; a pause keeps shipments where they are.
    """
    t = "struct<stock:double,pipe:array<double>,demand:double,ordered:double,arrived:double,out:array<struct<period:int,ordered:double,arrivals:double,sold:double,lost:double,on_hand_end:double>>>"
    zero = F.lit(0.0)
    init = F.struct(zero.alias("stock"), F.array_repeat(zero, max_lead + 1).alias("pipe"), zero.alias("demand"), zero.alias("ordered"), zero.alias("arrived"), F.array().alias("out")).cast(t)
    columns = ["demand", "lead_time", "pause", *[c for c in ("goal", "cap", "gamma", "quantity") if c in panel.columns]]
    missing = [c for c in ("goal", "cap", "gamma", "quantity") if c not in panel.columns]
    rows = panel.withColumns({c: F.lit(None).cast("double") for c in missing}) if missing else panel
    columns += missing

    def step(s: Column, row: Column) -> Column:
        def settled(x: Column) -> Column:
            q, have = x["q"], s["stock"] + x["pipe"][0]
            sold = F.least(row["demand"].cast("double"), have)
            rest = F.slice(x["pipe"], 2, max_lead)
            moved = F.when(row["pause"], F.concat(F.array(zero), rest)).otherwise(F.concat(rest, F.array(zero)))
            line = F.struct(row["period"].cast("int").alias("period"), q.alias("ordered"), x["pipe"][0].alias("arrivals"), sold.alias("sold"), (row["demand"] - sold).alias("lost"), (have - sold).alias("on_hand_end"))
            return F.struct((have - sold).alias("stock"), moved.alias("pipe"), row["demand"].cast("double").alias("demand"), q.alias("ordered"), x["pipe"][0].alias("arrived"), F.concat(s["out"], F.array(line)).alias("out")).cast(t)

        def dispatched(q: Column) -> Column:
            return F.struct(q.alias("q"), F.transform(s["pipe"], lambda c, i: c + F.when(i == row["lead_time"], q).otherwise(zero)).alias("pipe"))

        once = lambda value, body: F.transform(F.array(value), body)[0]
        return once(F.least(order(s, row).cast("double"), F.lit(order_cap)), lambda q: once(dispatched(q), settled))

    folded = ordered_fold(rows, keys, columns, init, step)
    return folded.select(*keys, F.explode("result.out").alias("r")).select(*keys, "r.*")


def arm_totals(path: DataFrame, profit: float, holding: float, keys: Sequence[str] = KEYS) -> DataFrame:
    reward = F.sum(profit * F.col("sold") - holding * F.col("on_hand_end"))
    return path.groupBy(*keys).agg(F.sum("ordered").alias("ordered"), F.sum("sold").alias("sold"), F.sum("lost").alias("lost"), reward.alias("reward"))


# Parameters that an answer may set: how to get the lead time, the demand over it and its deviation.


def recent_mean(value: str, n: int, keys: Sequence[str]) -> Column:
    return moments(value, over(keys, frame=(-n, -1)))[1]


def lead_of(method: Column, value: Column, promised: Column, seen: Column, recent: Column) -> Column:
    """default: promised; calculate and recent_N: means of lead times seen, promised where there are none; explicit: the value."""
    return F.when(method == "explicit", value).when(method == "calculate", F.coalesce(seen, promised)).when(method == "recent_N", F.coalesce(recent, promised)).otherwise(promised)


def demand_of(method: Column, value: Column, lead: Column, mean: Column, recent: Column, ewma: Column) -> Column:
    """Demand over the lead time; explicit values are taken as they are."""
    per = F.when(method == "recent_N", recent).when(method == "EWMA_gamma", ewma).otherwise(mean)
    return F.when(method == "explicit", value).otherwise(F.coalesce((1 + lead) * per, F.lit(0.0)))


def spread_of(method: Column, value: Column, lead: Column, sd: Column, recent: Column) -> Column:
    per = F.when(method == "recent_N", recent).otherwise(sd)
    return F.when(method == "explicit", value).otherwise(F.coalesce(F.sqrt(1 + lead) * per, F.lit(0.0)))


def parameter_targets(rows: DataFrame, z: float, lead: Column, mu: Column, sigma: Column) -> DataFrame:
    """goal and cap from a lead time, demand over it and its deviation."""
    return rows.withColumns({"goal": mu + z * sigma, "cap": mu / (1 + lead) + CAP_Z * sigma / F.sqrt(1 + lead), "gamma": F.lit(1.0)})


def persisted(rows: DataFrame, column: str, expiry: int, keys: Sequence[str] = ("episode",)) -> Column:
    """The row's own value, or the last one set fewer than expiry periods before; null beyond it."""
    last = F.last(F.when(F.col(column).isNotNull(), F.struct(F.col("period").alias("at"), F.col(column).alias("v"))), ignorenulls=True).over(over(keys, frame=UP_TO))
    return F.when(F.col("period") - last["at"] < expiry, last["v"])


# Proposals and their verification.


def evidence(panel: DataFrame, proposals: DataFrame, mean: float, sd: float, alpha: float, refute_below: float, streak: int, keys: Sequence[str]) -> DataFrame:
    """keys, proposal, tau and the first periods in which a proposal crossed, was refuted and expired."""
    shift = (F.col("multiplier") - 1) * mean
    x = F.col("demand") - mean
    later = proposals.join(panel.select(*keys, "period", "demand"), list(keys)).where(F.col("period") > F.col("tau"))
    w = over([*keys, "proposal"], frame=UP_TO)
    scored = later.withColumn("log_e", F.sum((shift * x - shift * shift / 2) / (sd * sd)).over(w))
    share = -(math.log(alpha) + F.col("proposal") * math.log(0.5))
    alive = F.col("period") - F.col("tau") <= F.col("lifetime")
    low = F.sum(F.when(F.col("log_e") < refute_below, 1).otherwise(0)).over(over([*keys, "proposal"], frame=(-(streak - 1), 0))) >= streak
    rows = scored.withColumns({"crossed": alive & (F.col("log_e") >= share), "refuted": alive & low})
    return rows.groupBy(*keys, "proposal", "tau").agg(F.min(F.when(F.col("crossed"), F.col("period"))).alias("crossed_at"), F.min(F.when(F.col("refuted"), F.col("period"))).alias("refuted_at"), F.min(F.when(~alive, F.col("period"))).alias("expired_at"))


def verified_proposals(panel: DataFrame, proposals: DataFrame, mean: float, sd: float, alpha: float, refute_below: float, streak: int, *, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """keys, proposal, tau, active_from and ended_at of each proposal (proposal, tau, multiplier, lifetime).

    The e-process bets on values after tau only: the log likelihood ratio of demand about multiplier times the mean
    against the mean. Activation is the first crossing of the proposal's share of alpha, halved from one to the next; a
    streak of evidence below refute_below refutes; a lifetime that runs out ends it first.
    """
    ends = evidence(panel, proposals, mean, sd, alpha, refute_below, streak, keys)
    gone = F.least("refuted_at", "expired_at")
    active = F.when(gone.isNull() | (F.col("crossed_at") < gone), F.col("crossed_at"))
    return ends.select(*keys, "proposal", "tau", active.alias("active_from"), F.coalesce(gone, F.lit(None).cast("int")).alias("ended_at"))


def lifecycle_events(panel: DataFrame, proposals: DataFrame, mean: float, sd: float, alpha: float, refute_below: float, streak: int, *, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """keys, proposal, tau, period and event: conditioned in tau, then activated, and refuted or expired, whichever is first."""
    ends = evidence(panel, proposals, mean, sd, alpha, refute_below, streak, keys)
    gone = F.least("refuted_at", "expired_at")
    event = lambda period, name: F.struct(period.cast("int").alias("period"), name.alias("event"))
    after = F.array(event(F.when(gone.isNull() | (F.col("crossed_at") < gone), F.col("crossed_at")), F.lit("activated")), event(gone, F.when(F.col("refuted_at") <= gone, "refuted").otherwise("expired")))
    later = ends.select(*keys, "proposal", "tau", F.explode(after).alias("e")).select(*keys, "proposal", "tau", "e.*").where("period is not null")
    first = proposals.join(panel.select(*keys, F.col("period").alias("tau")), [*keys, "tau"]).select(*keys, "proposal", "tau", F.col("tau").cast("int").alias("period"), F.lit("conditioned").alias("event"))
    return first.unionByName(later)


def rolled_back(panel: DataFrame, proposals: DataFrame, z: float = 2.0, *, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """Immediate activation with a guard: active from tau; two values in a row beyond z deviations on the wrong side of the
    forecast at tau end it. proposals: keys, proposal, tau, direction."""
    at = forecast(panel, keys).select(*keys, F.col("period").alias("tau"), F.col("mean").alias("mean0"), F.col("sd").alias("sd0"))
    later = proposals.join(at, [*keys, "tau"]).join(panel.select(*keys, "period", "demand"), list(keys)).where(F.col("period") > F.col("tau"))
    wrong = F.when(F.col("direction") == "demand_up", F.col("demand") < F.col("mean0") - z * F.col("sd0")).when(F.col("direction") == "demand_down", F.col("demand") > F.col("mean0") + z * F.col("sd0")).otherwise(F.lit(False))
    rows = later.withColumn("_w", F.coalesce(wrong, F.lit(False)))
    rows = rows.withColumn("_two", F.col("_w") & F.coalesce(F.lag("_w").over(over([*keys, "proposal"])), F.lit(False)))
    return rows.groupBy(*keys, "proposal", "tau").agg(F.min(F.when(F.col("_two"), F.col("period"))).alias("ended_at")).withColumn("active_from", F.col("tau"))


def active_spans(panel: DataFrame, spans: DataFrame, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """panel with proposal, the latest proposal that is active in the period, or null. Spans start once and end once: the
    latest start up to a period and that proposal's own end tell, without a join on ranges."""
    kind = panel.schema["period"].dataType
    starts = spans.where("active_from is not null").groupBy(*keys, F.col("active_from").cast(kind).alias("period")).agg(F.max(F.struct("proposal", F.col("ended_at").alias("end"))).alias("_start"))
    latest = F.max("_start").over(over(keys, frame=UP_TO))
    rows = panel.join(starts, [*keys, "period"], "left").withColumn("_s", latest)
    live = F.col("_s.end").isNull() | (F.col("period") < F.col("_s.end"))
    return rows.withColumn("proposal", F.when(live, F.col("_s.proposal"))).drop("_s", "_start")


# The clairvoyant bound.


def landing_room(panel: DataFrame, landings: DataFrame, room: Column, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """keys, period and room: what could land in each period if every order were as large as allowed. landings: keys, period, landing."""
    sent = panel.join(landings.where("landing is not null"), [*keys, "period"]).groupBy(*keys, F.col("landing").alias("period")).agg(F.sum(room).alias("room"))
    return panel.select(*keys, "period", "demand").join(sent, [*keys, "period"], "left").withColumn("room", F.coalesce("room", F.lit(0)).cast("double"))


def clairvoyant(rows: DataFrame, profit: float, holding: float, keys: Sequence[str] = ("episode",)) -> DataFrame:
    """keys, value and sold of the best plan that knows demand and landings: profit of units sold less holding of what lies over.

    rows: period, demand, room (what may land), fixed (what lands anyway, or 0). Fixed stock serves first; the rest of a
    period's demand is served from the latest room that is left, and only while a unit earns more than it costs to hold.
    Pairing the same landings and sales otherwise changes no sum, so that this is the optimum. holding 0 gives the gross bound.
    """
    t = "struct<stock:double,stack:array<struct<at:int,left:double>>,value:double,sold:double>"
    zero = F.lit(0.0)
    init = F.struct(zero.alias("stock"), F.array().alias("stack"), zero.alias("value"), zero.alias("sold")).cast(t)
    once = lambda value, body: F.transform(F.array(value), body)[0]

    def step(s: Column, row: Column) -> Column:
        now, have = row["period"].cast("int"), s["stock"] + row["fixed"]
        own = F.least(row["demand"].cast("double"), have)
        pushed = F.concat(F.array(F.struct(now.alias("at"), row["room"].alias("left"))), s["stack"])  # the latest first
        begin = F.struct((row["demand"] - own).alias("need"), zero.alias("earned"), zero.alias("sold"), F.array().cast("array<struct<at:int,left:double>>").alias("kept"))

        def take(a: Column, x: Column) -> Column:
            worth = profit - holding * (now - x["at"])
            q = F.when(worth > 0, F.least(a["need"], x["left"])).otherwise(zero)
            return once(q, lambda q: F.struct((a["need"] - q).alias("need"), (a["earned"] + q * worth).alias("earned"), (a["sold"] + q).alias("sold"), F.concat(a["kept"], F.array(F.struct(x["at"].alias("at"), (x["left"] - q).alias("left")))).alias("kept")))

        def after(a: Column) -> Column:
            left = F.filter(a["kept"], lambda x: (x["left"] > 0) & (profit - holding * (now + 1 - x["at"]) > 0))
            return F.struct((have - own).alias("stock"), left.alias("stack"), (s["value"] + profit * own - holding * (have - own) + a["earned"]).alias("value"), (s["sold"] + own + a["sold"]).alias("sold")).cast(t)

        return once(F.aggregate(pushed, begin, take), after)

    return ordered_fold(rows, keys, ["demand", "room", "fixed"], init, step).select(*keys, "result.value", "result.sold")
