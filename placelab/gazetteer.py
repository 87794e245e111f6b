"""Administrative names used to plan searches; a fixed dimension, always small enough to broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Districts by city.
DISTRICTS = {
    "Jakarta Selatan": [
        "Kebayoran Baru", "Kebayoran Lama", "Pesanggrahan", "Cilandak", "Pasar Minggu", "Jagakarsa",
        "Mampang Prapatan", "Pancoran", "Tebet", "Setiabudi",
    ],
    "Jakarta Pusat": [
        "Tanah Abang", "Menteng", "Senen", "Johar Baru", "Cempaka Putih", "Kemayoran", "Sawah Besar", "Gambir",
    ],
    "Jakarta Utara": ["Penjaringan", "Pademangan", "Tanjung Priok", "Koja", "Kelapa Gading", "Cilincing"],
    "Jakarta Timur": [
        "Matraman", "Pulo Gadung", "Jatinegara", "Cakung", "Duren Sawit", "Kramat Jati", "Makasar", "Pasar Rebo",
        "Ciracas", "Cipayung",
    ],
    "Jakarta Barat": [
        "Tambora", "Taman Sari", "Cengkareng", "Grogol Petamburan", "Kebon Jeruk", "Kalideres", "Palmerah",
        "Kembangan",
    ],
}

# Subdistricts by district, all in Jakarta Selatan.
SUBDISTRICTS = {
    "Kebayoran Baru": [
        "Gunung", "Melawai", "Kramat Pela", "Selong", "Rawa Barat", "Senayan", "Cipete Selatan", "Pulo",
        "Petogogan", "Gandaria Selatan",
    ],
    "Kebayoran Lama": [
        "Grogol Utara", "Grogol Selatan", "Cipulir", "Kebayoran Lama Utara", "Kebayoran Lama Selatan",
        "Pondok Pinang",
    ],
    "Cilandak": ["Cilandak Barat", "Lebak Bulus", "Pondok Labu", "Cipete Utara", "Gandaria Utara"],
    "Pancoran": ["Pancoran", "Kalibata", "Rawa Jati", "Duren Tiga", "Cikoko", "Pengadegan"],
    "Tebet": [
        "Tebet Timur", "Tebet Barat", "Menteng Dalam", "Kebon Baru", "Bukit Duri", "Manggarai", "Manggarai Selatan",
    ],
}
SUBDISTRICT_CITY = "Jakarta Selatan"


def gazetteer(spark: SparkSession) -> DataFrame:
    """Rows (city, district, subdistrict, level, pos); subdistrict is null on the district level."""
    rows = [
        (city, name, None, "district", pos)
        for city, names in DISTRICTS.items() for pos, name in enumerate(names)
    ] + [
        (SUBDISTRICT_CITY, district, name, "subdistrict", pos)
        for district, names in SUBDISTRICTS.items() for pos, name in enumerate(names)
    ]
    return spark.createDataFrame(rows, "city string, district string, subdistrict string, level string, pos int")


def districts_of(spark: SparkSession, city: str) -> DataFrame:
    return gazetteer(spark).filter((F.col("level") == "district") & (F.col("city") == city))


def subdistricts_of(spark: SparkSession, city: str, district: str) -> DataFrame:
    return gazetteer(spark).filter(
        (F.col("level") == "subdistrict") & (F.col("city") == city) & (F.col("district") == district)
    )
