"""Declared schemas of the retail star and its foreign keys. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

INT, TEXT, REAL, DAY, FLAG = T.IntegerType(), T.StringType(), T.DoubleType(), T.DateType(), T.BooleanType()


def _table(*fields: tuple[str, T.DataType, str]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True, {"comment": c}) for n, t, c in fields])


STORES = _table(
    ("store_id", INT, "Store key"),
    ("store_name", TEXT, "Display name of the store"),
    ("city", TEXT, "City of the store"),
    ("province", TEXT, "Province code"),
    ("region", TEXT, "Sales region"),
    ("square_footage", INT, "Floor space in square feet"),
    ("opened_year", INT, "Year of opening"),
    ("manager_name", TEXT, "Name of the manager"),
)
ADVISORS = _table(
    ("advisor_id", INT, "Advisor key"),
    ("first_name", TEXT, "Given name"),
    ("last_name", TEXT, "Family name"),
    ("store_id", INT, "Home store, refers to stores"),
    ("hire_date", DAY, "Date of hire"),
    ("specialization", TEXT, "Main field of expertise"),
    ("commission_rate", REAL, "Commission as a fraction of sales"),
    ("ytd_revenue", REAL, "Revenue of the year so far, as recorded"),
    ("client_count", INT, "Clients in the advisor's book, as recorded (a snapshot, not a live count)"),
)
PRODUCTS = _table(
    ("product_id", TEXT, "Stock keeping unit"),
    ("product_name", TEXT, "Display name"),
    ("category", TEXT, "Top-level category"),
    ("subcategory", TEXT, "Finer category"),
    ("brand", TEXT, "Brand"),
    ("unit_price", REAL, "List price"),
    ("colour", TEXT, "Main colour"),
    ("season", TEXT, "Selling season"),
    ("stock_qty", INT, "Units in stock over all stores"),
    ("is_active", FLAG, "Still on sale"),
)
CLIENTS = _table(
    ("client_id", INT, "Client key"),
    ("first_name", TEXT, "Given name"),
    ("last_name", TEXT, "Family name"),
    ("email", TEXT, "E-mail address"),
    ("city", TEXT, "Home city"),
    ("province", TEXT, "Home province"),
    ("preferred_store_id", INT, "Preferred store, refers to stores"),
    ("advisor_id", INT, "Assigned advisor, refers to advisors"),
    ("membership_tier", TEXT, "Classic, Silver, Gold or Platinum"),
    ("is_vip", FLAG, "Spend above the VIP bound, or flagged by hand"),
    ("client_segment", TEXT, "Active, At-Risk, New, Dormant or Re-engaged"),
    ("lifetime_spend", REAL, "Total spend since the first purchase"),
    ("last_purchase_date", DAY, "Most recent purchase"),
    ("first_purchase_date", DAY, "First purchase"),
    ("total_orders", INT, "Number of transactions"),
    ("avg_order_value", REAL, "Mean transaction value"),
    ("preferred_category", TEXT, "Category bought most often"),
)
TRANSACTIONS = _table(
    ("transaction_id", TEXT, "Transaction key"),
    ("transaction_date", DAY, "Day of purchase"),
    ("client_id", INT, "Buyer, refers to clients"),
    ("store_id", INT, "Store of the sale, refers to stores"),
    ("advisor_id", INT, "Advisor of the sale, refers to advisors"),
    ("product_id", TEXT, "Product sold, refers to products"),
    ("quantity", INT, "Units"),
    ("unit_price", REAL, "Price of one unit at the time of sale"),
    ("discount_pct", REAL, "Discount in percent"),
    ("total_amount", REAL, "Amount after discount; positive for returns too"),
    ("payment_method", TEXT, "Means of payment"),
    ("is_return", FLAG, "The row is a return"),
)

SCHEMAS: dict[str, T.StructType] = {
    "stores": STORES,
    "advisors": ADVISORS,
    "products": PRODUCTS,
    "clients": CLIENTS,
    "transactions": TRANSACTIONS,
}

TABLE_COMMENTS: dict[str, str] = {
    "stores": "Retail stores",
    "advisors": "Advisors and their recorded figures",
    "products": "Product catalogue",
    "clients": "Client profiles with loyalty and segment data",
    "transactions": "Point-of-sale history, one row per sale or return",
}

# (table, column, referenced table, referenced key)
FOREIGN_KEYS: list[tuple[str, str, str, str]] = [
    ("transactions", "client_id", "clients", "client_id"),
    ("transactions", "store_id", "stores", "store_id"),
    ("transactions", "advisor_id", "advisors", "advisor_id"),
    ("transactions", "product_id", "products", "product_id"),
    ("clients", "preferred_store_id", "stores", "store_id"),
    ("clients", "advisor_id", "advisors", "advisor_id"),
    ("advisors", "store_id", "stores", "store_id"),
]
