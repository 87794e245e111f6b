"""Indonesian postal addresses split into their administrative parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelab.functions.text import blank_to_null, computed_once, first_match, strip

# Province names, in list order.
PROVINCES = [
    "DKI Jakarta", "Daerah Khusus Ibukota Jakarta",
    "Jawa Barat", "Jawa Tengah", "Jawa Timur",
    "Banten", "Yogyakarta", "D.I. Yogyakarta",
    "Sumatera Utara", "Sumatera Selatan", "Sumatera Barat",
    "Riau", "Kepulauan Riau", "Jambi", "Bengkulu",
    "Lampung", "Bangka Belitung", "Aceh",
    "Kalimantan Timur", "Kalimantan Selatan", "Kalimantan Barat",
    "Kalimantan Tengah", "Kalimantan Utara",
    "Sulawesi Selatan", "Sulawesi Utara", "Sulawesi Tengah",
    "Sulawesi Tenggara", "Sulawesi Barat", "Gorontalo",
    "Bali", "Nusa Tenggara Barat", "Nusa Tenggara Timur",
    "Papua", "Papua Barat", "Papua Selatan", "Papua Tengah",
    "Maluku", "Maluku Utara",
]

# City names tried in this order when no pattern gives a city.
CITIES = [
    "Jakarta Selatan", "Jakarta Pusat", "Jakarta Utara",
    "Jakarta Barat", "Jakarta Timur", "Bandung", "Surabaya",
    "Medan", "Semarang", "Tangerang", "Bekasi", "Depok",
    "Bogor", "Makassar", "Palembang", "Batam",
]

# Address patterns.
ZIP = r"(?U)\b\d{5}\b"
CITY_MARKED = r"(?iUd)(?:Kota|Kab\.|Kabupaten)\s+([^,\n]+?)(?:,|\n|$)"
CITY_NAMED = (
    r"(?iU)(?:Jakarta|Bandung|Surabaya|Medan|Semarang|Makassar|Palembang|Tangerang|Depok|Bekasi|Bogor)"
    r"\s+(?:Selatan|Utara|Barat|Timur|Pusat|Kota)?"
)
DISTRICT_MARKED = r"(?iUd)(?:Kecamatan|Kec\.)\s+([^,\n]+?)(?:,|\n|$)"
DISTRICT_SHORT = r"(?iUd)(?:Kec\.?)\s+([A-Z][a-zA-Z\s]+?)(?:,|\n|$)"
SUBDISTRICT_MARKED = r"(?iUd)(?:Kelurahan|Kel\.)\s+([^,\n]+?)(?:,|\n|$)"
VILLAGE_MARKED = r"(?iUd)(?:Desa)\s+([^,\n]+?)(?:,|\n|$)"
CITY_WORD = r"(?iU)\b(Kota|Kabupaten|Kab\.)\b"
DISTRICT_WORD = r"(?iU)\b(Kecamatan|Kec\.)\b"
STREET_START = r"(?i)^(Jl\.?|Jalan|Gang|Gg\.)"
BARE_ZIP = r"(?U)^\d{5}$"
DIGIT_RUN = r"(?U)\d{2,}"

PARTS = ("subdistrict", "district", "city", "province", "zip_code")


def _named_in(lowered: Column, names: list[str]) -> Column:
    return F.coalesce(*[F.when(F.contains(lowered, F.lit(n.lower())), F.lit(n)) for n in names])


def _may_be_subdistrict(part: Column, city: Column, province: Column) -> Column:
    lowered = F.lower(part)

    def names(place: Column) -> Column:
        return F.coalesce((place != "") & F.contains(lowered, F.lower(place)), F.lit(False))

    return (
        (F.length(part) > 3)
        & ~names(city)
        & ~names(province)
        & ~part.rlike(CITY_WORD)
        & ~part.rlike(BARE_ZIP)
        & ~part.rlike(STREET_START)
        & ~part.rlike(DISTRICT_WORD)
        & ~part.rlike(DIGIT_RUN)
    )


def with_address_parts(df: DataFrame, address: str = "address", parts: tuple[str, ...] = PARTS) -> DataFrame:
    """Add the ``parts`` (subdistrict, district, city, province, zip_code) read from column ``address``.

    The parts build on each other, so they come in three steps, each computed
    once per row. A subdistrict needs all but the zip code; the others need no step but their own.
    """
    lowered = computed_once(df, {"_text": blank_to_null(F.col(address)), "_lower": F.lower(F.col(address))})
    text, longest_first = F.col("_text"), sorted(PROVINCES, key=len, reverse=True)
    steps = {
        "zip_code": first_match(text, ZIP),
        "province": _named_in(F.col("_lower"), longest_first),
        "city": F.coalesce(
            blank_to_null(strip(F.coalesce(first_match(text, CITY_MARKED, 1), first_match(text, CITY_NAMED)))),
            _named_in(F.col("_lower"), CITIES),
        ),
        "district": strip(F.coalesce(first_match(text, DISTRICT_MARKED, 1), first_match(text, DISTRICT_SHORT, 1))),
        "_marked": blank_to_null(
            strip(F.coalesce(first_match(text, SUBDISTRICT_MARKED, 1), first_match(text, VILLAGE_MARKED, 1)))
        ),
    }
    needed = {*parts, "district", "city", "province", "_marked"} if "subdistrict" in parts else set(parts)
    named = computed_once(lowered, {name: step for name, step in steps.items() if name in needed})
    if "subdistrict" not in parts:
        return named.drop("_text", "_lower")
    listed_parts = F.filter(
        F.transform(F.split("_text", ","), strip),
        lambda p: _may_be_subdistrict(p, F.col("city"), F.col("province")),
    )
    listed = computed_once(named, {"_parts": F.when(F.col("_marked").isNull(), listed_parts)})
    before_district = F.filter("_parts", lambda p: F.position(p, text) < F.position(F.col("district"), text))
    inferred = F.coalesce(
        F.when(F.col("district") != "", F.try_element_at(before_district, F.lit(1))),
        F.try_element_at("_parts", F.lit(1)),
    )
    helpers = {"_text", "_lower", "_marked", "_parts", *(needed - set(parts))}
    return listed.withColumn("subdistrict", F.coalesce("_marked", inferred)).drop(*helpers)


def parse_address_columns(df: DataFrame, address: str = "address") -> DataFrame:
    """Only the five parts next to the other columns, in their usual order."""
    others = [c for c in df.columns if c not in PARTS]
    return with_address_parts(df, address).select(*others, *PARTS)
