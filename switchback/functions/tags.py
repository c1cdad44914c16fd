"""Predicates and labels from the tags of map ways: tags is a map of strings, an empty string counts as absent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
UNPAVED = ("unpaved", "gravel", "fine_gravel", "dirt", "ground", "compacted", "grass", "sand", "earth", "mud", "pebblestone", "rock", "grass_paver", "wood")
BLOCKED = ("no", "private", "agricultural", "forestry", "delivery", "permit")
ACCESS_KEYS = ("motorcycle", "motor_vehicle", "vehicle", "access")
SPEED_KEYS = ("maxspeed:type", "zone:maxspeed", "source:maxspeed", "maxspeed")


def tag(tags: Column, key: str) -> Column:
    return F.nullif(F.try_element_at(tags, F.lit(key)), F.lit(""))


def is_not(x: Column, *values: str) -> Column:
    return F.coalesce(~x.isin(*values), F.lit(True))


def rideable(tags: Column, unpaved: tuple[str, ...] = UNPAVED) -> Column:
    """Paved, no roundabout, area or motorroad, and not blocked by the first access key that is present."""
    access = F.coalesce(*(F.try_element_at(tags, F.lit(k)) for k in ACCESS_KEYS))
    blocked = F.coalesce(F.forall(F.split(F.replace(access, F.lit(" "), F.lit("")), ";"), lambda v: v.isin(*BLOCKED)), F.lit(False))
    return is_not(tag(tags, "surface"), *unpaved) & is_not(tag(tags, "junction"), "roundabout", "circular") & is_not(tag(tags, "area"), "yes") & is_not(tag(tags, "motorroad"), "yes") & ~blocked


def is_tunnel(tags: Column) -> Column:
    return F.coalesce(tag(tags, "tunnel") != "no", F.lit(False)) | F.coalesce(tag(tags, "covered") == "yes", F.lit(False))


def off_ground(tags: Column) -> Column:
    return is_tunnel(tags) | F.coalesce(tag(tags, "bridge") != "no", F.lit(False)) | F.coalesce(tag(tags, "layer").rlike(LAYER) & (tag(tags, "layer") != "0"), F.lit(False))


def is_narrow(tags: Column) -> Column:
    width = F.regexp_extract(tag(tags, "width"), r"^\s*([-+]?(\d+\.?\d*|\.\d+))", 1).try_cast("double")
    return F.coalesce(tag(tags, "lanes") == "1", F.lit(False)) | F.coalesce(tag(tags, "narrow") == "yes", F.lit(False)) | F.coalesce(width <= 4.5, F.lit(False))


def urban(tags: Column) -> Column:
    return F.concat_ws(" ", *(tag(tags, k) for k in SPEED_KEYS)).rlike("(?i)urban|zone")


def road_key(tags: Column) -> Column:
    """The first reference without spaces in upper case, or the name of a road without reference; null where that is empty."""
    ref = F.upper(F.replace(F.split_part(tag(tags, "ref"), F.lit(";"), F.lit(1)), F.lit(" "), F.lit("")))
    return F.when(tag(tags, "ref").isNotNull(), F.nullif(ref, F.lit(""))).otherwise(tag(tags, "name"))


# How conditional access tags say that a road is closed, whole layers, and the wind chill's terms.
CLOSED = r"(?i)(?:no|private)\s*@\s*\(?([^);]+)\)?"
LAYER = r"^-?\d+$"
CHILL_LIMIT, CHILL = 15, (13.12, 0.6215, -11.37, 0.3965)


def closure(tags: Column) -> Column:
    """The condition of the first conditional access rule that closes the road, else seasonal, else null."""
    rules = [F.nullif(F.trim(F.regexp_extract(tag(tags, f"{k}:conditional"), CLOSED, 1)), F.lit("")) for k in ACCESS_KEYS]
    seasonal = F.when(F.coalesce(tag(tags, "winter_road") == "no", F.lit(False)) | F.coalesce(tag(tags, "seasonal") == "yes", F.lit(False)), "seasonal")
    return F.coalesce(*rules, seasonal)


def title(pass_name: Column, name: Column, share: Column, ref: Column) -> Column:
    return F.coalesce(pass_name, F.when((share >= 0.6) | ref.isNull(), name), ref, name, F.lit("Unnamed road"))


def subtitle(heading: Column, name: Column, share: Column, ref: Column) -> Column:
    return F.concat_ws(" · ", F.when(ref != heading, ref), F.when((name != heading) & (share >= 0.3), name))


def feels_like(celsius: Column, kmh: float = 80.0) -> Column:
    """Wind chill at riding speed, never above the air; null above 15 degrees."""
    (base, per_degree, per_wind, both), wind = CHILL, kmh**0.16
    return F.when(celsius <= CHILL_LIMIT, F.least(celsius, base + per_wind * wind + celsius * (per_degree + both * wind)))


# Weather codes and their words.
WEATHER = {
    "Clear": (0,), "Partly cloudy": (1, 2), "Overcast": (3,), "Fog": (45, 48), "Drizzle": (51, 53, 55, 56, 57), "Rain": (61, 63, 65, 66, 67),
    "Snow": (71, 73, 75, 77), "Showers": (80, 81, 82), "Snow showers": (85, 86), "Thunderstorms": (95, 96, 99)
}


def weather_of(code: Column) -> Column:
    return F.coalesce(*(F.when(code.isin(*codes), words) for words, codes in WEATHER.items()), F.lit("Unknown"))
