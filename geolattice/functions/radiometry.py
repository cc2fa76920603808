"""Scalar expressions on pixel values, all null where an input is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised differences by name, as (a, b) of (a - b) / (a + b), and those that hold over water only.
INDICES = {"NDVI": ("nir", "red"), "NDWI": ("green", "nir"), "MNDWI": ("green", "swir1"), "NDBI": ("swir1", "nir"), "NDCI": ("rededge1", "red"), "NDTI": ("red", "green"), "NBR": ("nir", "swir2")}
WATER_ONLY = ("NDCI", "NDTI")
#: Scene classes that count as cloud, and bits of a quality word: fill, then dilated cloud, cirrus, cloud, shadow and snow.
CLOUD_CLASSES, FILL_BIT, CLOUD_BITS = (0, 1, 3, 8, 9, 10, 11), 0, (1, 2, 3, 4, 5)
CLEAR, CLOUD, NO_DATA = 0, 1, 2


def reflectance(dn: Column, scale: float = 1.0, offset: float = 0.0, nodata: float | None = 0.0) -> Column:
    value = dn.cast("double") * scale + offset
    return value if nodata is None else F.when(dn != nodata, value)


def reflectance_without_shift(dn: Column, scale: float, offset: float, unshifted: Column) -> Column:
    """As ``reflectance``, where rows of a collection that was delivered ``unshifted`` take no offset."""
    return F.when(dn != 0, dn.cast("double") * scale + F.when(unshifted, 0.0).otherwise(offset))


def unflagged(dn: Column, most: int, scale: float) -> Column:
    """Numbers over ``most`` are flags, not values."""
    return F.when(dn <= most, dn * scale)


def normalized_difference(a: Column, b: Column) -> Column:
    """Null where either is, or where the sum is 0."""
    return (a - b) / F.nullif(a + b, F.lit(0.0))


def index(name: str) -> Column:
    a, b = INDICES[name]
    return normalized_difference(F.col(a), F.col(b))


def available_indices(columns: list[str]) -> list[str]:
    return [n for n, bands in INDICES.items() if set(bands) <= set(columns)]


def is_water(columns: list[str]) -> Column:
    """Over the water sheet: MNDWI above 0, NDWI where there is no short-wave band; never null."""
    return F.coalesce(index("MNDWI" if "swir1" in columns else "NDWI") > 0, F.lit(False))


def is_bare(before: Column, after: Column, water: Column, cls: Column, built: int, limit: float = 0.2) -> Column:
    """NDVI under the limit on both dates, not water (unknown counts as land) and not of the built class; never null."""
    return F.coalesce((before < limit) & (after < limit) & ~F.coalesce(water > 0, F.lit(False)) & (cls != built), F.lit(False))


def is_urbanized(ndvi: Column, mndwi: Column) -> Column:
    return F.coalesce((ndvi <= 0.3) & (mndwi < 0), F.lit(False))


def reliable_pair(first: Column, second: Column) -> Column:
    """Both dates from July to October, when green tells built from dry."""
    return F.month(first).between(7, 10) & F.month(second).between(7, 10)


def occurrence_class(percent: Column) -> Column:
    return F.when(percent >= 90, "permanent").when(percent >= 50, "frequent").when(percent > 0, "seldom").otherwise("never")


def scene_class_state(cls: Column) -> Column:
    return F.when(cls.isNull(), NO_DATA).when(cls.isin(*CLOUD_CLASSES), CLOUD).otherwise(CLEAR)


def quality_state(bits: Column, cloud_bits: tuple[int, ...] = CLOUD_BITS) -> Column:
    mask = sum(1 << b for b in cloud_bits)
    return F.when(bits.isNull() | (bits.bitwiseAND(1 << FILL_BIT) != 0), NO_DATA).when(bits.bitwiseAND(mask) != 0, CLOUD).otherwise(CLEAR)


def celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def backscatter_is_water(linear: Column, threshold_db: float) -> Column:
    return linear <= 10 ** (threshold_db / 10)


def change_class(delta: Column, threshold: float) -> Column:
    return F.when(delta <= -threshold, "down").when(delta >= threshold, "up").when(delta.isNotNull(), "stable")


def vegetation_class(ndvi: Column) -> Column:
    """1 to 4, cut at 0.2, 0.4 and 0.6, each cut in the class above; 0 without data."""
    return F.when(ndvi.isNull(), 0).when(ndvi < 0.2, 1).when(ndvi < 0.4, 2).when(ndvi < 0.6, 3).otherwise(4)


def byte_stretch(value: Column, low: Column, high: Column) -> Column:
    span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return F.floor(F.least(F.greatest((value - low) / span, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("long")


def metres_per_degree(latitude: Column) -> tuple[Column, Column]:
    """(metres of a degree of longitude, of latitude) on WGS84. The factors are fixed values."""
    phi = F.radians(latitude)
    lon = 111412.84 * F.cos(phi) - 93.5 * F.cos(3 * phi) + 0.118 * F.cos(5 * phi)
    return lon, 111132.92 - 559.82 * F.cos(2 * phi) + 1.175 * F.cos(4 * phi) - 0.0023 * F.cos(6 * phi)


def runoff_depth(rain_mm: Column, curve_number: Column) -> Column:
    """Runoff in mm by the curve-number method; none up to an initial abstraction of 0.2 S."""
    s = F.lit(25400.0) / curve_number - 254
    return F.when(rain_mm <= 0.2 * s, F.lit(0.0)).otherwise(F.pow(rain_mm - 0.2 * s, F.lit(2.0)) / (rain_mm + 0.8 * s))


def mixed_curve_number(curve_number: Column, new_ha: Column, area_km2: Column, built: float = 98.0) -> Column:
    return curve_number + (F.lit(built) - curve_number) * F.least(F.lit(1.0), new_ha / (area_km2 * 100))


def usable_basins(basins: DataFrame) -> DataFrame:
    """Basins with a curve number and some measured area; the others are discarded, see ``discarded_basins``."""
    return basins.filter("cn is not null and km2 > 0")


def discarded_basins(basins: DataFrame) -> DataFrame:
    return basins.filter("cn is null or coalesce(km2, 0) <= 0")


def runoff_by_basin(basins: DataFrame, zones: DataFrame, rain_mm: Column) -> tuple[DataFrame, DataFrame]:
    """From basins (poly, cn, km2) and built zones (id, poly: the basin that holds it or null, ha): the basins with ha, cn_new and the volumes
    v0 and v1 in cubic metres, and one row with the number of zones outside all basins. A basin without measured area is an error."""
    new = zones.filter("poly is not null").groupBy("poly").agg(F.sum("ha").alias("ha"))
    area = F.coalesce(F.col("km2"), F.raise_error(F.lit("a basin declares no measured area")).cast("double"))
    rows = basins.withColumn("km2", area).join(new, "poly", "left").withColumn("ha", F.coalesce("ha", F.lit(0.0)))
    rows = rows.withColumn("cn_new", mixed_curve_number(F.col("cn"), F.col("ha"), F.col("km2")))
    volume = lambda cn: runoff_depth(rain_mm, F.col(cn)) * F.col("km2") * 1000
    return rows.withColumns({"v0": volume("cn"), "v1": volume("cn_new")}), zones.agg(F.count_if(F.col("poly").isNull()).alias("outside"))


def tag_class(tags: Column) -> Column:
    """The class of a map feature: the first rule that its tags meet."""
    has = lambda k, *vs: F.coalesce(F.try_element_at(tags, F.lit(k)).isin(*vs), F.lit(False))
    rules = [
        (has("access", "private", "no"), "private"), (has("natural", "water"), "public_blue"), (has("leisure", "park", "garden"), "public_green"),
        (has("leisure", "pitch"), "pitch"), (has("leisure", "wood") | has("natural", "wood"), "natural_area"),
    ]
    out = F.lit("context")
    for test, name in reversed(rules):
        out = F.when(test, name).otherwise(out)
    return out


def placemark_attribute(description: Column, name: str) -> Column:
    """The cell behind the one called ``name`` in a placemark's table."""
    return F.regexp_extract(description, rf"<td>{name}</td>\s*<td>(\w+)</td>", 1)


def annual_rate(first: Column, last: Column, years: Column) -> Column:
    return F.pow(last / first, F.lit(1.0) / years) - 1


def slug(text: Column) -> Column:
    """Lower case without accents; runs of anything but letters and digits become one hyphen."""
    plain = F.translate(F.lower(text), "áàäâéèëêíìïîóòöôúùüûñç", "aaaaeeeeiiiioooouuuunc")
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-|-$", "")
