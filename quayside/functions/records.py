"""Column functions over episodes, incidents and proposals."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from quayside.functions.specs import duration_bin, magnitude_bin

# Fixed values.
EPISODE = r"^([a-z_]+)/f([0-9]+)/s([0-9]+)/([a-z_]+?)(__twin)?$"
COST_RATIOS = {19.0: "high", 4.0: "medium", 1.0: "low"}
ANCHORS = {"onset": 0, "early1": -1, "early2": -2}
FIELDS = ("family", "onset", "magnitude", "persistence", "duration")


def parsed_id(episode: Column) -> Column:
    """split, family, seed, condition, is_null and cluster of an episode's id; null fields if it is none."""
    part = lambda k: F.nullif(F.regexp_extract(episode, EPISODE, k), F.lit(""))
    ok = episode.rlike(EPISODE)
    cluster = F.when(ok, F.concat_ws("/", part(1), F.concat(F.lit("f"), part(2)), F.concat(F.lit("s"), part(3))))
    return F.struct(part(1).alias("split"), part(2).cast("int").alias("family"), part(3).cast("long").alias("seed"), part(4).alias("condition"), F.when(ok, part(5).isNotNull()).alias("is_null"), cluster.alias("cluster"))


def unit_of_seed(seed: Column, stride: int = 1_000_000, block: int = 100_000) -> Column:
    """family, base and index that a seed encodes."""
    rest = F.pmod(seed, F.lit(stride))
    return F.struct(F.floor(seed / stride).alias("family"), (rest - F.pmod(rest, F.lit(block))).alias("base"), F.pmod(rest, F.lit(block)).alias("index"))


def cost_ratio(profit: Column) -> Column:
    """The label of an audited profit; null for any other."""
    out = F.lit(None).cast("string")
    for value, label in COST_RATIOS.items():
        out = F.when(profit == value, label).otherwise(out)
    return out


def path_label(path: Column, labels: Sequence[str]) -> Column:
    """The first of labels that is a part of a path."""
    return F.coalesce(*[F.when(F.array_contains(F.split(path, "/"), label), label) for label in labels])


def threshold_of(text: Column, named: Column) -> Column:
    """A criterion's threshold: none, a name in the map, or a number."""
    return F.when(text == "none", F.lit(None).cast("double")).otherwise(F.coalesce(F.try_element_at(named, text), text.try_cast("double")))


def incident_payload(family: Column, magnitude: Column, duration: Column) -> Column:
    """What a perfect reader would propose for an incident; a null direction for a demand incident of size 1 and for families without one."""
    demand = family.isin("demand_level", "temporary_pulse")
    stream = F.when(demand, "demand").when(family.isin("lead_time_shift", "shipment_loss", "transit_pause"), "arrival").when(family == "compound", "both")
    direction = (
        F.when(demand & (magnitude > 1), "demand_up").when(demand & (magnitude < 1), "demand_down").when(family == "lead_time_shift", "arrival_delayed")
        .when(family.isin("shipment_loss", "transit_pause"), "arrival_interrupted").when(family == "compound", "mixed")
    )
    lasting = F.when(family.isin("temporary_pulse", "compound"), "transient").otherwise("persistent")
    return F.struct(
        stream.alias("target_stream"), family.alias("shock_family"), direction.alias("direction"), magnitude_bin(magnitude).alias("magnitude_bin"), lasting.alias("persistence"), duration_bin(duration).alias("duration_bin"),
        F.array(F.lit(0), F.lit(0)).alias("onset_window"), F.concat(F.lit("sig_oracle_"), family).alias("prospective_signature"),
    )


def unregistrable(family: Column, persistence: Column, duration: Column, tau: Column, horizon: Column) -> Column:
    """Why a legal proposal cannot be registered, reasons joined by +; null if it can, or abstains."""
    reasons = F.concat_ws("+", F.when(persistence == "none", "persistence_none"), F.when(duration == "none", "duration_none"), F.when(tau >= horizon, "tau_at_horizon"))
    return F.when(family != "no_change", F.nullif(reasons, F.lit("")))


def hypothesis_key(family: Column, direction: Column) -> Column:
    return F.when((family == "demand_level") & direction.isin("demand_up", "demand_down"), direction).when(family == "lead_time_shift", "lead_time").when((family == "temporary_pulse") & (direction == "demand_up"), "pulse_up")


def actionability(key: Column, condition: Column, quiet: str = "none") -> Column:
    """Which arm could act: null, supply without and with an alert, demand."""
    supply = key.isin("lead_time_shift", "shipment_loss", "transit_pause")
    return F.when(key == "no_change", "null").when(supply & (condition == quiet), "supply_no_alert").when(supply, "supply_alert_only").otherwise("demand_visible")


def field_scores(p: str = "p", t: str = "t") -> dict[str, Column]:
    """Agreement of a proposal (struct p) with the truth (struct t), field by field; an abstention or no proposal agrees in none."""
    c = lambda s, name: F.col(f"{s}.{name}")
    gap = c(t, "onset") - c(p, "tau")
    flags = {
        "family_ok": (c(p, "family") == c(t, "family")) & (c(p, "direction") == c(t, "direction")), "onset_ok": gap.between(c(p, "lo"), c(p, "hi")), "magnitude_ok": c(p, "magnitude") == c(t, "magnitude"),
        "persistence_ok": c(p, "persistence") == c(t, "persistence"), "duration_ok": c(p, "duration") == c(t, "duration"),
    }
    said = c(p, "family").isNotNull() & (c(p, "family") != "no_change")
    out = {k: F.coalesce(said & v, F.lit(False)) for k, v in flags.items()}
    every = F.lit(True)
    for v in out.values():
        every = every & v
    return out | {"full_ok": F.coalesce(every & (c(p, "stream") == c(t, "stream")), F.lit(False))}


def anchor(name: Column, onset: Column) -> Column:
    """Period at which a clairvoyant plan begins to act."""
    out = F.when(name == "start", F.lit(1))
    for k, offset in ANCHORS.items():
        out = out.when(name == k, onset + offset)
    return out


def error_class(error: Column) -> Column:
    """The first line's first 90 characters; none for no error."""
    return F.when(F.coalesce(error, F.lit("")) == "", "none").otherwise(F.substring(F.substring_index(error, "\n", 1), 1, 90))


def whole(x: Column) -> Column:
    """Signed, with thousands separators, rounded half away from zero."""
    r = F.round(x, 0)
    return F.concat(F.when(r < 0, "-").otherwise("+"), F.format_number(F.abs(r), 0))


def cents(x: Column) -> Column:
    return F.format_string("%.2f", F.round(x, 2))


def noisy_lead(lead: Column, noise: Column, ceiling: Column | None = None) -> Column:
    """A lead time and its noise, at least 0 and at most a ceiling; a lost shipment (infinity) stays lost."""
    moved = F.greatest(F.lit(0.0), lead + noise)
    return F.when(lead == float("inf"), lead).otherwise(moved if ceiling is None else F.least(moved, ceiling))


def call_cost(prompt: Column, completion: Column, price_in: float | Decimal, price_out: float | Decimal) -> Column:
    """US dollars of a call, by prices of a million tokens; sums of decimal prices are exact."""
    return (prompt * price_in + completion * price_out).cast("double") / 1_000_000


def error_kind(status: Column, connected: Column) -> Column:
    """refusal, transient or fatal, of a failed call's status; one that never reached the server is transient."""
    return F.when(~connected, "transient").when(status == 403, "refusal").when(status.isin(408, 409, 429) | (status >= 500), "transient").otherwise("fatal")


def request_digest(system: Column, prompt: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(system, F.lit("")).cast("binary"), F.lit(b"\0"), prompt.cast("binary")), 256)


def normal_abstention(family: Column, value: Column) -> Column:
    """A field spelled none becomes null, for abstentions only."""
    return F.when((family == "no_change") & (value == "none"), F.lit(None)).otherwise(value)


def spec_fault(family: Column, stream: Column, direction: Column, onset: Column, magnitude: Column) -> Column:
    """What breaks the rules between a spec's fields; null if nothing does."""
    none = family == "no_change"
    return (
        F.when(none & (stream != "none"), "stream").when(none & (direction != "none"), "direction").when(none & onset.isNotNull(), "onset").when(none & magnitude.isNotNull(), "magnitude")
        .when(~none & onset.isNull(), "no onset").when(~none & (magnitude.isNull() | (magnitude == "none")), "no magnitude").when(~none & (stream == "none"), "no stream")
    )
