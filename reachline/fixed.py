"""Values that results depend on. They are data, not logic."""

# Progress rank of each receipt type. Unknown types count as 0.
STATUS_RANK = {
    "queued": 0,
    "sent": 1,
    "delivered": 2,
    "failed": 2,
    "opened": 3,
    "read": 4,
    "clicked": 5,
    "converted": 6,
}

# Statuses counted as having reached a stage.
REACHED = {
    "sent": ["sent", "delivered", "failed", "opened", "read", "clicked", "converted"],
    "delivered": ["delivered", "opened", "read", "clicked", "converted"],
    "opened": ["opened", "read", "clicked", "converted"],
    "read": ["read", "clicked", "converted"],
    "clicked": ["clicked", "converted"],
    "converted": ["converted"],
    "failed": ["failed"],
    "queued": ["queued"],
}

# Channels, in the order in which a reply is searched for them.
CHANNELS = ["whatsapp", "sms", "email", "rcs"]
DEFAULT_CHANNEL = "whatsapp"
UNKNOWN_CHANNEL = "unknown"
SMS_LIMIT = 160

# Defaults for segments and drafts taken from model replies.
DEFAULT_SEGMENT_NAME = "Untitled Segment"
DEFAULT_SUBJECT = "Something special for you"
DEFAULT_BODY = "Hey {{name}}, we've got something special for you at %s! Check it out 🛍️"
NAME_PLACEHOLDER = "{{name}}"

# The single line of an order created by a conversion receipt.
CONVERSION_ITEM_NAME = "Campaign Product"
CONVERSION_ITEM_CATEGORY = "Marketing"

# Time-ago units in seconds.
TIME_UNITS = {
    "years": 31536000,
    "months": 2592000,
    "days": 86400,
    "hours": 3600,
    "minutes": 60,
}

# Dashboard gauge targets.
GAUGE_TARGETS = {
    "total_customers": 500,
    "total_messages_sent": 5000,
    "revenue_generated": 100000000,
}

OPEN_CAMPAIGN_STATUSES = ["sending", "running"]
UNFINISHED_CAMPAIGN_STATUSES = ["draft", "sending", "running"]
