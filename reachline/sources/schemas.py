"""Typed schemas of the marketing tables and stream records."""

CUSTOMERS = """
    id string, name string, email string, phone string, city string, gender string, age int,
    total_orders int, total_spent decimal(18,2), last_order_date timestamp_ntz,
    created_at timestamp_ntz, is_active boolean, tags array<string>
"""

ORDERS = """
    id string, customer_id string, order_number string, amount decimal(18,2),
    items array<struct<name: string, category: string, quantity: int, price: decimal(18,2)>>,
    channel string, status string, city string, created_at timestamp_ntz
"""

SEGMENTS = """
    id string, name string, description string, filter_logic string,
    natural_language_query string, customer_count int, created_at timestamp_ntz,
    created_by string
"""

CAMPAIGNS = """
    id string, name string, segment_id string, channel string, message_template string,
    status string, total_sent int, total_delivered int, total_failed int, total_opened int,
    total_clicked int, created_at timestamp_ntz, sent_at timestamp_ntz,
    completed_at timestamp_ntz
"""

EVENTS = ("array<struct<seq: bigint, event_type: string, ts: timestamp_ntz, "
          "metadata: map<string, string>>>")

COMMUNICATIONS = f"""
    id string, campaign_id string, customer_id string, recipient string, channel string,
    status string, events {EVENTS}, sent_at timestamp_ntz, updated_at timestamp_ntz
"""

# One webhook body.
RECEIPT = """
    campaign_id string, customer_id string, event_type string, `timestamp` string,
    metadata map<string, string>
"""

# The provider's own shape, which names the message instead of campaign and customer.
PROVIDER_RECEIPT = """
    external_id string, status string, `timestamp` string, metadata map<string, string>
"""

# Scalars are read as text so that a number given in quotes still counts.
TABLES = {
    "customers": CUSTOMERS,
    "orders": ORDERS,
    "segments": SEGMENTS,
    "campaigns": CAMPAIGNS,
    "communications": COMMUNICATIONS,
}
