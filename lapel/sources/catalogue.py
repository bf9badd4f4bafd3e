"""Fixed values of the sample star: its literal rows, word lists and ranges.

Results of the sample questions depend on them, so they are stated as they are.
"""

from __future__ import annotations

from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lapel.sources.schema import SCHEMAS
from lapel.sources.star import cast_dates

TODAY = date(2026, 3, 17)
CLIENTS = 250
CLIENT_DOMAIN = "email.com"

# store_id, place, city, province, region, square feet, year of opening, manager.
STORES = (
    (1, "Bloor Street", "Toronto", "ON", "East", 8500, 1954, "Michael Chen"),
    (2, "Yorkdale", "Toronto", "ON", "East", 6200, 1998, "Sarah Goldstein"),
    (3, "Vancouver Pacific Centre", "Vancouver", "BC", "West", 5800, 1979, "James Nakamura"),
    (4, "Oakridge", "Vancouver", "BC", "West", 4200, 2005, "Emily Park"),
    (5, "Montréal Ogilvy", "Montreal", "QC", "East", 5100, 1967, "Pierre Tremblay"),
    (6, "Market Mall", "Calgary", "AB", "Central", 4800, 1995, "David MacLeod"),
    (7, "Rideau Centre", "Ottawa", "ON", "East", 3900, 2001, "Laura Singh"),
    (8, "Masonville Place", "London", "ON", "East", 3600, 2009, "Robert Kovacs"),
)

# advisor_id, names, store_id, hire date, specialization, commission, revenue of the year, clients.
ADVISORS = (
    (1, "Alessandro", "Ferretti", 1, "2015-03-10", "Suiting", 0.08, 312400.0, 87),
    (2, "Catherine", "Beaumont", 1, "2018-07-22", "Formalwear", 0.07, 198700.0, 54),
    (3, "Marcus", "Williams", 1, "2011-01-15", "Casual & Sport", 0.08, 245300.0, 72),
    (4, "Yuki", "Tanaka", 2, "2019-09-05", "Suiting", 0.07, 178900.0, 45),
    (5, "Olivia", "Stern", 2, "2016-04-18", "Accessories", 0.06, 134200.0, 63),
    (6, "Daniel", "Rosenthal", 2, "2013-11-28", "Suiting", 0.08, 267800.0, 79),
    (7, "Priya", "Mehta", 3, "2017-06-12", "Formalwear", 0.07, 221500.0, 61),
    (8, "Thomas", "Larsen", 3, "2020-02-03", "Casual & Sport", 0.06, 145600.0, 38),
    (9, "Sophie", "Girard", 5, "2014-08-19", "Suiting", 0.08, 289100.0, 83),
    (10, "Étienne", "Leblanc", 5, "2018-03-27", "Formalwear", 0.07, 167400.0, 47),
    (11, "Connor", "MacPherson", 6, "2016-10-14", "Suiting", 0.08, 198300.0, 56),
    (12, "Aisha", "Patel", 6, "2021-01-08", "Casual & Sport", 0.06, 112700.0, 31),
    (13, "Kevin", "O'Brien", 7, "2019-05-21", "Suiting", 0.07, 156800.0, 44),
    (14, "Rachel", "Goldberg", 1, "2012-09-30", "Tailoring", 0.09, 334600.0, 92),
    (15, "James", "Whitfield", 3, "2015-12-07", "Suiting", 0.08, 243900.0, 68),
    (16, "Nina", "Kowalski", 4, "2020-07-15", "Accessories", 0.06, 98400.0, 29),
    (17, "Sanjay", "Krishnamurthy", 2, "2014-02-25", "Suiting", 0.08, 278500.0, 76),
    (18, "Amelia", "Thornton", 8, "2022-03-01", "Formalwear", 0.06, 87600.0, 22),
    (19, "Lucas", "Beauchamp", 5, "2017-11-09", "Casual & Sport", 0.07, 189200.0, 53),
    (20, "Natasha", "Volkov", 6, "2013-06-18", "Tailoring", 0.09, 312700.0, 88),
)

# SKU, name, category, subcategory, brand, list price, colour, season, stock.
PRODUCTS = (
    ("SKU-S001", "Canali Two-Button Wool Suit - Navy", "Suits", "Two-Button", "Canali", 3495.0, "Navy", "All-Season", 12),
    ("SKU-S002", "Canali Two-Button Wool Suit - Charcoal", "Suits", "Two-Button", "Canali", 3495.0, "Charcoal", "All-Season", 9),
    ("SKU-S003", "Zegna Trofeo Slim-Fit Suit", "Suits", "Slim-Fit", "Zegna", 4850.0, "Midnight Blue", "All-Season", 6),
    ("SKU-S004", "Boss H-Hutson Double Breasted Suit", "Suits", "Double-Breasted", "Boss", 1995.0, "Grey", "All-Season", 14),
    ("SKU-S005", "Brioni Brunico Bespoke Suit", "Suits", "Bespoke", "Brioni", 8500.0, "Charcoal", "All-Season", 3),
    ("SKU-S006", "Tom Ford Windsor Base Suit", "Suits", "Two-Button", "Tom Ford", 5200.0, "Black", "All-Season", 5),
    ("SKU-S007", "Pal Zileri Concept Suit - Taupe", "Suits", "Two-Button", "Pal Zileri", 2200.0, "Taupe", "Spring/Summer", 8),
    ("SKU-S008", "Corneliani Full Canvas Suit - Khaki", "Suits", "Three-Button", "Corneliani", 2800.0, "Khaki", "Spring/Summer", 7),
    ("SKU-S009", "Isaia Gregory Suit - Blue Stripe", "Suits", "Slim-Fit", "Isaia", 4200.0, "Blue Stripe", "All-Season", 4),
    ("SKU-S010", "Samuelsohn Custom Suit - Black", "Suits", "Made-to-Measure", "Samuelsohn", 3800.0, "Black", "All-Season", 2),
    ("SKU-SH001", "Canali Slim-Fit Dress Shirt - White", "Shirts", "Dress Shirt", "Canali", 395.0, "White", "All-Season", 40),
    ("SKU-SH002", "Canali Slim-Fit Dress Shirt - Blue", "Shirts", "Dress Shirt", "Canali", 395.0, "Blue", "All-Season", 35),
    ("SKU-SH003", "Eton Contemporary Fit Shirt - White", "Shirts", "Dress Shirt", "Eton", 285.0, "White", "All-Season", 52),
    ("SKU-SH004", "Eton Slim Fit Oxford Shirt", "Shirts", "Casual Shirt", "Eton", 265.0, "Light Blue", "All-Season", 47),
    ("SKU-SH005", "Boss Hank Kent Dress Shirt", "Shirts", "Dress Shirt", "Boss", 225.0, "White", "All-Season", 63),
    ("SKU-SH006", "Tom Ford Grosgrain-Trimmed Shirt", "Shirts", "Dress Shirt", "Tom Ford", 650.0, "White", "All-Season", 18),
    ("SKU-SH007", "Zegna Linen Shirt - Light Grey", "Shirts", "Casual Shirt", "Zegna", 480.0, "Light Grey", "Spring/Summer", 22),
    ("SKU-SH008", "Finamore Napoli Dress Shirt - Ecru", "Shirts", "Dress Shirt", "Finamore", 540.0, "Ecru", "All-Season", 11),
    ("SKU-SHO001", "Magnanni Cap-Toe Oxford - Black", "Shoes", "Oxford", "Magnanni", 695.0, "Black", "All-Season", 20),
    ("SKU-SHO002", "Magnanni Derby Shoe - Tan", "Shoes", "Derby", "Magnanni", 625.0, "Tan", "Spring/Summer", 18),
    ("SKU-SHO003", "To Boot New York Chelsea Boot", "Shoes", "Chelsea Boot", "To Boot NY", 498.0, "Dark Brown", "Fall/Winter", 24),
    ("SKU-SHO004", "Common Projects Achilles Low - White", "Shoes", "Sneaker", "Common Projects", 580.0, "White", "All-Season", 16),
    ("SKU-SHO005", "John Lobb City II Oxford", "Shoes", "Oxford", "John Lobb", 1850.0, "Black", "All-Season", 5),
    ("SKU-O001", "Mackage Edward Leather Jacket - Black", "Outerwear", "Leather Jacket", "Mackage", 1295.0, "Black", "Fall/Winter", 9),
    ("SKU-O002", "Canada Goose Langford Parka", "Outerwear", "Parka", "Canada Goose", 1250.0, "Navy", "Fall/Winter", 11),
    ("SKU-O003", "Zegna Wool Overcoat - Camel", "Outerwear", "Overcoat", "Zegna", 2800.0, "Camel", "Fall/Winter", 6),
    ("SKU-O004", "Boss Cashmere Topcoat - Charcoal", "Outerwear", "Topcoat", "Boss", 1450.0, "Charcoal", "Fall/Winter", 8),
    ("SKU-O005", "Ted Baker Wool Peacoat", "Outerwear", "Peacoat", "Ted Baker", 595.0, "Navy", "Fall/Winter", 14),
    ("SKU-A001", "Canali Silk Tie - Burgundy", "Accessories", "Tie", "Canali", 225.0, "Burgundy", "All-Season", 45),
    ("SKU-A002", "Canali Silk Tie - Navy Stripe", "Accessories", "Tie", "Canali", 225.0, "Navy", "All-Season", 38),
    ("SKU-A003", "Hermès Silk Pocket Square", "Accessories", "Pocket Square", "Hermès", 285.0, "Multi", "All-Season", 22),
    ("SKU-A004", "Boss Leather Belt - Black", "Accessories", "Belt", "Boss", 185.0, "Black", "All-Season", 55),
    ("SKU-A005", "Zegna Cashmere Scarf", "Accessories", "Scarf", "Zegna", 495.0, "Grey", "Fall/Winter", 18),
    ("SKU-A006", "Rolex Datejust 41 - Silver", "Accessories", "Watch", "Rolex", 12800.0, "Silver", "All-Season", 2),
    ("SKU-A007", "Montblanc Meisterstück Pen", "Accessories", "Pen", "Montblanc", 895.0, "Black", "All-Season", 7),
    ("SKU-A008", "Canali Leather Dress Belt - Brown", "Accessories", "Belt", "Canali", 245.0, "Brown", "All-Season", 32),
    ("SKU-T001", "Canali Flat-Front Wool Trousers - Grey", "Trousers", "Dress Trouser", "Canali", 595.0, "Grey", "All-Season", 28),
    ("SKU-T002", "PT01 Five-Pocket Stretch Trousers", "Trousers", "Casual Trouser", "PT01", 395.0, "Navy", "All-Season", 33),
    ("SKU-T003", "Boss Slim-Fit Trousers - Black", "Trousers", "Dress Trouser", "Boss", 325.0, "Black", "All-Season", 40),
    ("SKU-T004", "Zegna Chino - Beige", "Trousers", "Chino", "Zegna", 580.0, "Beige", "Spring/Summer", 22),
)

# Word lists and cycles of the client generator.
FIRST_NAMES = (
    "James", "William", "Oliver", "Ethan", "Noah", "Lucas", "Liam", "Benjamin", "Henry", "Sebastian",
    "Alexander", "Michael", "Daniel", "David", "Matthew", "Andrew", "Anthony", "Joshua", "Ryan", "Nathan",
    "Patrick", "Christopher", "Jonathan", "Nicholas", "Thomas", "Robert", "Edward", "Charles", "George", "Arthur",
    "Lawrence", "Raymond", "Leonard", "Harold", "Walter", "Peter", "Francis", "Paul", "Vincent", "Richard",
)
LAST_NAMES = (
    "Thompson", "MacDonald", "Fitzgerald", "Chen", "Patel", "Kumar", "Williams", "Anderson", "Martin", "Taylor",
    "Harris", "Wilson", "Moore", "Jackson", "Lee", "White", "Clark", "Lewis", "Walker", "Hall",
    "Young", "Allen", "King", "Wright", "Scott", "Green", "Baker", "Adams", "Nelson", "Hill",
    "Ramirez", "Campbell", "Mitchell", "Roberts", "Evans", "Turner", "Parker", "Collins", "Edwards", "Morris",
)
CATEGORIES = ("Suits", "Shirts", "Shoes", "Outerwear", "Accessories", "Trousers")
SEGMENT_CYCLE = ("Active", "Active", "Active", "At-Risk", "At-Risk", "New", "Dormant", "Re-engaged")

# Low and high per segment; spend in whole dollars, days counted back from TODAY.
SEGMENT_RANGES = {
    "New": {"spend": (500, 3000), "orders": (1, 3), "last_days": (7, 90), "first_days": (90, 180)},
    "Active": {"spend": (5000, 85000), "orders": (5, 40), "last_days": (14, 180), "first_days": (365, 1825)},
    "At-Risk": {"spend": (8000, 60000), "orders": (6, 30), "last_days": (180, 365), "first_days": (730, 2190)},
    "Dormant": {"spend": (1000, 15000), "orders": (2, 10), "last_days": (365, 900), "first_days": (900, 2555)},
    "Re-engaged": {"spend": (3000, 25000), "orders": (3, 15), "last_days": (30, 90), "first_days": (900, 2555)},
}

# Weights of the transaction generator.
DISCOUNTS = (0, 0, 0, 0, 5, 10, 15, 20)
PAYMENTS = ("Credit Card", "Credit Card", "Credit Card", "Debit", "Wire Transfer")
RETURN_EVERY = 47

# Homes of clients in cycle order (city, province, store), and the advisors of each store by id.
HOMES = tuple((city, province, key) for key, _, city, province, *_ in STORES)
ADVISORS_OF_STORE = {s[0]: tuple(a[0] for a in ADVISORS if a[3] == s[0]) for s in STORES}


def _local(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """Literal rows as a local relation: Spark knows how small it is, so it is broadcast without being told."""
    table = pa.table({name: [row[i] for row in rows] for i, name in enumerate(schema.names)})
    return spark.createDataFrame(table, schema)


def stores(spark: SparkSession, house: str = "") -> DataFrame:
    """The stores; with ``house`` each is named "house - place"."""
    label = f"{house} - " if house else ""
    rows = [(key, label + place, *rest) for key, place, *rest in STORES]
    return _local(spark, rows, SCHEMAS["stores"])


def advisors(spark: SparkSession) -> DataFrame:
    raw = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name == "hire_date" else f.dataType) for f in SCHEMAS["advisors"]]
    )
    return cast_dates(_local(spark, list(ADVISORS), raw), "hire_date")


def products(spark: SparkSession, numbered: bool = False) -> DataFrame:
    """The catalogue; ``numbered`` adds product_no 0..39 for the generator."""
    schema = T.StructType([T.StructField("product_no", T.IntegerType()), *SCHEMAS["products"].fields])
    out = _local(spark, [(k, *row, True) for k, row in enumerate(PRODUCTS)], schema)
    return out if numbered else out.drop("product_no")


def load_dims(spark: SparkSession, house: str = "") -> dict[str, DataFrame]:
    """The 68 literal rows as DataFrames with the declared columns."""
    return {"stores": stores(spark, house), "advisors": advisors(spark), "products": products(spark)}
