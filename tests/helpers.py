"""Dates and times written as text."""

from datetime import date, datetime


def day(text):
    return date.fromisoformat(text)


def at(text):
    return datetime.fromisoformat(text)
