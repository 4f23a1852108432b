"""Canonical schemas of the engine's tables."""

from __future__ import annotations

#: Statement lifecycles as strings, the form of the CSV files: an empty deletion means "still there".
LIFECYCLE_TEXT = "s string, p string, o string, cdate string, cuser string, ddate string, duser string"
#: Statement lifecycles with parsed times; null ddate and duser: still there.
LIFECYCLE = "s string, p string, o string, cdate timestamp, cuser string, ddate timestamp, duser string"
#: One constraint entry: what the statement of property `prop` is measured against during [start, end).
CONSTRAINT_ENTRY = (
    "prop string, role string, pq2306 string, pq2305 string, entity string, start timestamp, end timestamp, "
    "constraint_id string"
)
#: A page of a dump: revisions in document order.
PAGE = (
    "title string, revision array<struct<id:string,timestamp:string,"
    "contributor:struct<username:string,ip:string>,text:string>>"
)
#: Strings that mean "no value".
NULL_WORDS = ("", "NaT", "nan", "None", "null")
