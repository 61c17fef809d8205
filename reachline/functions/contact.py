"""Where a message goes and what it says. Empty text counts as missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reachline.fixed import NAME_PLACEHOLDER


def filled(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def recipient(channel: Column, email: Column, phone: Column) -> Column:
    """E-mail for the e-mail channel; otherwise the phone, or the e-mail without one."""
    return F.when(channel == "email", email).otherwise(F.coalesce(filled(phone), email))


def display_recipient(stored: Column, email: Column, phone: Column) -> Column:
    """The stored recipient, else the e-mail, else the phone."""
    return F.coalesce(filled(stored), filled(email), phone)


def render_message(template: Column, name: Column) -> Column:
    """Every name placeholder replaced by the full name."""
    return F.replace(template, F.lit(NAME_PLACEHOLDER), name)
