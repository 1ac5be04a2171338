"""Map features by tags. A feature table has a column for each tag, null where a feature lacks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from ..operators.tables import in_list, rename_id

# Tags of the map's features.
POI = ("fire_station", "hospital", "clinic", "police", "waste_disposal", "kindergarten", "school")
LEISURE = (
    "bar", "biergarten", "cafe", "fast_food", "food_court", "ice_cream", "pub", "restaurant", "college",
    "dancing_school", "library", "surf_school", "toy_library", "training", "music_school", "university",
    "boat_rental", "boat_sharing", "arts_centre", "brothel", "casino", "cinema", "community_centre",
    "conference_centre", "events_venue", "exhibition_centre", "gambling", "love_hotel", "music_venue", "nightclub",
    "social_centre", "stage", "stripclub", "swingerclub", "theatre", "bbq", "animal_training", "dive_centre",
    "internet_cafe", "lounger", "marketplace", "public_bath",
)
BUILDING_COLUMNS = ("geometry", "amenity", "addr:postcode", "addr:city", "addr:street", "addr:housenumber")
WATERWAYS = ("river", "canal")


def with_columns(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """df with those of the columns that it lacks, as null texts."""
    return df.withColumns({n: F.lit(None).cast(StringType()) for n in names if n not in df.columns})


def boundaries(features: DataFrame) -> DataFrame:
    found = with_columns(features, ("name", "boundary", "admin_level")).where("boundary = 'administrative'")
    ids = [c for c in ("id", "osmid") if c in found.columns][:1]
    return rename_id(found.select(*ids, "geometry", "name", "boundary", "admin_level"))


def railways(features: DataFrame) -> DataFrame:
    return rename_id(with_columns(features, ("railway",)).where("railway = 'rail'"))


def waterways(features: DataFrame) -> DataFrame:
    return rename_id(with_columns(features, ("waterway",)).where(F.col("waterway").isin(*WATERWAYS)))


def buildings(features: DataFrame, project: bool = True) -> DataFrame:
    found = with_columns(features, ("building", *BUILDING_COLUMNS)).where("building = 'yes'")
    return found.select(*[F.col(f"`{c}`") for c in BUILDING_COLUMNS]) if project else found


def any_buildings(features: DataFrame) -> DataFrame:
    """All features with a building tag of any value."""
    return with_columns(features, ("building",)).where("building is not null")


def points_of_interest(features: DataFrame, amenities: list[str] | None = None) -> DataFrame:
    return rename_id(in_list(with_columns(features, ("amenity",)), "amenity", amenities, POI))


def leisure(features: DataFrame) -> DataFrame:
    return rename_id(in_list(with_columns(features, ("amenity",)), "amenity", None, LEISURE))


def emergency_only(features: DataFrame) -> DataFrame:
    return with_columns(features, ("emergency",)).where("emergency = 'yes'")
