"""Names, word lists, patterns, defaults and thresholds that decide results.

They are stated as data so the operators that use them stay free of literals.
"""

# --- fixed values: column synonyms of a raw transaction file, best first -----------------
TRANSACTION_SYNONYMS = {
    "transaction_id": ["transaction_id", "invoice", "order_id", "invoice_no"],
    "product_id": ["product_id", "stockcode", "sku", "item_id", "product_code"],
    "user_id": ["user_id", "customer_id", "client_id", "customerid"],
    "timestamp": ["timestamp", "invoicedate", "date", "order_date", "invoice_date"],
    "store_id": ["store_id", "country", "location", "branch"],
}
# --- fixed values: what a transaction column holds when no synonym exists -----------------
TRANSACTION_DEFAULTS = {"product_id": "UNKNOWN", "user_id": "U001", "store_id": "S001"}

# --- fixed values: timestamp text formats tried after ISO ----------------------------------
TIMESTAMP_FORMATS = ["M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy"]

# --- fixed values: upload header patterns, matched from the start, first hit wins ----------
UPLOAD_HEADER_PATTERNS = [
    (r"(transaction|order|invoice|sale)[\s_]*(id|no|number|#)?$", "transaction_id"),
    (r"(user|customer|client|member)[\s_]*(id|no|number)?$", "user_id"),
    (r"(product|item|sku|stock)[\s_]*(id|no|number|code)?$", "product_id"),
    (r"(store|location|branch|shop|country)[\s_]*(id|no|number)?$", "store_id"),
    (r"(amount|total|revenue|sales?)[\s_]*(amount)?$", "amount"),
    (r"(unit[\s_]*)?price$", "price"),
    (r"(date|time|timestamp|created|ordered|invoice[\s_]*date)[\s_]*(at|on|stamp)?$", "timestamp"),
    (r"quantity|qty$", "quantity"),
    (r"(full[\s_]*)?name$", "name"),
    (r"email[\s_]*(address)?$", "email"),
    (r"city$", "city"),
    (r"(signup|registration|created|join)[\s_]*(date|at)?$", "signup_date"),
    (r"(product[\s_]*)?name|description$", "product_name"),
    (r"category$", "category"),
    (r"stock[\s_]*(level|qty|quantity)?$", "stock_level"),
    (r"reorder[\s_]*(point|level)$", "reorder_point"),
    (r"(last[\s_]*)?restock[\s_]*(date)?$", "last_restock_date"),
    (r"stock[\s_]*status$", "stock_status"),
]

# --- fixed values: mapping recommender, searched anywhere in the header --------------------
RECOMMENDED_HEADER_PATTERNS = {
    "transaction_id": [r"(transaction|order|invoice|sale)[_\s]*(id|no|number|#)?", r"^id$", r"invoiceno"],
    "user_id": [r"(user|customer|client|member)[_\s]*(id|no|number)?", r"customerid"],
    "product_id": [r"(product|item|sku|stock)[_\s]*(id|no|code)?", r"stockcode"],
    "timestamp": [r"(date|time|timestamp|created|ordered|invoice[_\s]*date)", r"invoicedate"],
    "amount": [r"(amount|total|revenue|sales?|price)[_\s]*(amount)?$"],
    "quantity": [r"quantity|qty"],
    "store_id": [r"(store|location|branch|shop|country)[_\s]*(id|no)?"],
    "name": [r"(full[_\s]*)?name$", r"description"],
    "email": [r"email[_\s]*(address)?"],
    "city": [r"city"],
    "category": [r"category"],
    "price": [r"(unit[_\s]*)?price$"],
}

# --- fixed values: column kinds by name; a header is held against them from its start ---------
COLUMN_KIND_PATTERNS = {
    "id": [r".*_?id$", r"^id$", r".*_?key$", r".*_?no$", r".*_?number$"],
    "price": [r".*price.*", r".*amount.*", r".*cost.*", r".*total.*"],
    "quantity": [r".*quantity.*", r".*qty.*", r".*count.*", r".*units.*"],
    "date": [r".*date.*", r".*time.*", r".*timestamp.*"],
    "category": [r".*category.*", r".*type.*", r".*class.*"],
    "name": [r".*name.*", r".*description.*", r".*title.*"],
    "email": [r".*email.*", r".*mail.*"],
    "phone": [r".*phone.*", r".*mobile.*", r".*tel.*"],
}
# --- fixed values: id-kind columns and the key they stand for, by word in the header -------
ID_WORDS = [
    ("transaction_id", ["transaction", "order", "invoice"]),
    ("product_id", ["product", "item", "stock"]),
    ("user_id", ["customer", "user"]),
    ("store_id", ["store", "location"]),
]
# --- fixed values: name-kind columns --------------------------------------------------------
NAME_WORDS = [("product_name", ["product", "item", "description"]), ("user_name", ["customer", "user"])]

# --- fixed values: words that reveal what an uploaded file holds ----------------------------
UPLOAD_ENTITY_WORDS = {
    "transaction": ["transaction", "order", "invoice", "sale", "purchase", "amount", "total", "price"],
    "user": ["user", "customer", "client", "member", "name", "email"],
    "product": ["product", "item", "sku", "category", "brand"],
    "inventory": ["stock", "inventory", "warehouse", "reorder", "quantity_on_hand"],
    "shipment": ["shipment", "shipping", "delivery", "carrier", "tracking", "shipped"],
}
# --- fixed values: the shorter list used when a file is only scanned ------------------------
SCAN_ENTITY_WORDS = {
    "transaction": ["transaction", "order", "invoice", "sale", "amount", "price"],
    "user": ["user", "customer", "name", "email"],
    "product": ["product", "item", "sku", "category"],
}
# --- fixed values: name parts of the columns each half of a combined file keeps -------------
COMBINED_PARTS = {
    "users": ["user_id", "name", "email", "city", "signup"],
    "products": ["product_id", "product_name", "category", "price"],
    "transactions": ["transaction_id", "user_id", "product_id", "amount", "timestamp", "store_id"],
}
# --- fixed values: id-like name parts for files of unknown shape ----------------------------
UNKNOWN_FILE_ID_WORDS = ["id", "number", "no", "key"]

# --- fixed values: constants for required upload columns; `{n}` is the row number from 0 ----
UPLOAD_DEFAULTS = {
    "transactions": {
        "transaction_id": "TXN_{n}",
        "user_id": "U001",
        "product_id": "P001",
        "timestamp": "{as_of}",
        "amount": "0.0",
        "store_id": "S001",
    },
    "users": {
        "user_id": "U{n}",
        "name": "Unknown",
        "email": "unknown@example.com",
        "city": "Unknown",
        "signup_date": "{as_of}",
    },
    "products": {
        "product_id": "P{n}",
        "product_name": "Unknown Product",
        "category": "General",
        "price": "0.0",
    },
}
# --- fixed values: columns a mapped upload must bring (or let us derive) --------------------
REQUIRED_COLUMNS = {
    "transactions": ["transaction_id", "amount"],
    "users": ["user_id"],
    "products": ["product_id"],
}

# --- fixed values: stream event types and the raw entity each feeds -------------------------
EVENT_ENTITIES = {
    "order_created": "transactions",
    "user_update": "users",
    "product_update": "products",
    "inventory_update": "inventory",
    "shipment_update": "shipments",
}

# --- fixed values: roles, what they may read, and what is hidden from them ------------------
ACCESS_POLICIES = {
    "analyst": {
        "allowed_tables": ["fact_transactions", "dim_users", "dim_products"],
        "masked_columns": ["email", "phone"],
    },
    "manager": {
        "allowed_tables": ["fact_transactions", "dim_users", "dim_products"],
        "masked_columns": [],
    },
    "viewer": {
        "allowed_tables": ["fact_transactions"],
        "masked_columns": ["email", "phone", "amount"],
    },
}
MASK = "***MASKED***"

# --- fixed values: most rows of an ad-hoc result ---------------------------------------------
ADHOC_ROW_CAP = 100

# --- fixed values: retail concepts and the column each stands for -----------------------------
CONCEPT_COLUMNS = {
    "product_identifier": "product_name",
    "price": "price",
    "category": "category",
    "revenue": "amount",
    "quantity": "quantity",
    "customer": "user_id",
    "location": "city",
    "date": "date",
}
CONCEPT_THRESHOLD = 0.6

# --- fixed values: delivery and customer rules ----------------------------------------------
FAST_DAYS = 3
NORMAL_DAYS = 7
NEW_CUSTOMER_DAYS = 7
LOW_STOCK = 30
HIGH_TURNOVER = 0.8
UNKNOWN_KEY = -1
UNKNOWN_REGION = "Unknown"
