from reachline.functions.contact import display_recipient, recipient, render_message
from reachline.functions.dates import as_timestamp, days_before, stamp, time_ago, whole_days_since
from reachline.functions.rates import count_in, percent, whole_percent

__all__ = [
    "as_timestamp", "count_in", "days_before", "display_recipient", "percent", "recipient",
    "render_message", "stamp", "time_ago", "whole_days_since", "whole_percent",
]
