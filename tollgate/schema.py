"""Schemas, status codes and fixed constants of the charging data model.

All money is whole units (LongType); times are TimestampType with the
session time zone set to UTC.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# Status codes, lock timeout, retention horizons, delta operation name and
# the fields of the JSON payload, in the order the reference declares them.
# ---------------------------------------------------------------------------
STATUS_OK = 42
STATUS_NO_MONEY = 43
STATUS_SOME_UNITS_ALLOCATED = 44
STATUS_ALL_UNITS_ALLOCATED = 45
STATUS_TXN_ALREADY_HAPPENED = 46
STATUS_USER_DOESNT_EXIST = 50
STATUS_RECORD_ALREADY_SOFTLOCKED = 53
STATUS_RECORD_HAS_BEEN_SOFTLOCKED = 54
STATUS_CREDIT_ADDED = 56
LOCK_TIMEOUT_MS = 50
USAGE_TTL_MINUTES = 180
TXN_TTL_SECONDS = 3600
PRUNE_TWO_AGE_SECONDS = 60          # report usage: delete <= 2 txns older than 1 min
PRUNE_OLDEST_AGE_SECONDS = 300      # add credit: delete oldest txn if older than 5 min
NEW_LOYALTY_NUMBER = "NEW_LOYALTY_NUMBER"
JSON_FIELDS = ("mysteriousHexPayload", "loyaltySchemeName", "loyaltySchemeNumber")
LOYALTY_SCHEME_NAME = "HelperCard"
EXPORT_RETENTION_HOURS = 2
SLA_P99_MS = 10
PASS_RATIO = 0.9
PERCENTILES = (50.0, 95.0, 99.0, 99.5, 99.9, 99.95, 99.99, 99.999)
SUMMARY_PERCENTILES = (50.0, 99.0, 99.9, 99.99, 99.999)
SUMMARY_MARKER = "GREPABLE SUMMARY"
LOG_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"        # prefix of every client log line
SUMMARY_BLOCKS = ("RQU", "KV_PUT", "KV_GET")   # writer order (Q17)
TOPUP_THRESHOLD = 1000
# Status texts, financial-event messages and ledger purposes, as the
# reference writes them; {name} marks a value filled in per request.
TEXT_USER_MISSING = "User {userid} does not exist"
TEXT_USER_ID_MISSING = "User ID {userid} does not exist"
TEXT_ALREADY_HAPPENED = "Event already happened at {time}"
TEXT_SPENT = "Spent {spent}"
TEXT_NEGATIVE_BALANCE = "; Negative balance: {avail}"
TEXT_SOME_ALLOCATED = "; Allocated {avail} units of {wanted} asked for"
TEXT_ALL_ALLOCATED = "; Allocated {wanted}"
TEXT_CREDIT_ADDED = "{amount} added by Txn {txn_id}"
TEXT_USER_CREATED = "Created user {userid} with opening credit of {amount}"
TEXT_USER_UPSERTED = "Updated user {userid} - added credit of {amount}; balance now 0"
TEXT_ALREADY_LOCKED = "User {userid} has already been locked by session {session}"
TEXT_USER_UPDATED = "User {userid} updated"
TEXT_CURRENTLY_LOCKED = "User {userid} currently locked by session {session}. Expires at {expiry}"
TEXT_BAD_JSON = "Json syntax exception while working with User {userid}, ' {old}' and '{payload}"
TEXT_BAD_NUMBER = "Invalid loyalty card number: '{payload}"
MSG_CREDIT_ALREADY_ADDED = "Credit already added"
MSG_ADDED = "Added {amount}"
MSG_USER_CREATED = "user created"
MSG_USER_UPSERTED = "user upserted"
PURPOSE_ADD_CREDIT = "Add Credit"
PURPOSE_UPSERT_USER = "Upsert user"
TEXT_NO_USERS = "no users"
# The metrics procedure's statistics, in its order (name = help text).
METRIC_NAMES = ("user_locks", "user_count", "allocated_credit", "recent_activity_out_approved",
                "recent_activity_out_spent", "recent_activity_out_qty", "recent_activity_in_spent",
                "recent_activity_in_qty")
TIME_TEXT_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"     # timestamps inside texts, UTC
# ---------------------------------------------------------------------------

# Our own texts (no counterpart in the reference).
TEXT_NO_BALANCE = "No balance for user {userid}"
TEXT_NO_TXN_ID = "Missing transaction id for user {userid}"
TEXT_UNKNOWN_OP = "Unknown operation {op}"

# Our own marker for a request that the reference would abort for a reason
# that has no status code (missing balance row, bad delta payload).
STATUS_ABORTED = -1

STATUS_NAMES = {
    STATUS_OK: "OK",
    STATUS_NO_MONEY: "NO_MONEY",
    STATUS_SOME_UNITS_ALLOCATED: "SOME_UNITS_ALLOCATED",
    STATUS_ALL_UNITS_ALLOCATED: "ALL_UNITS_ALLOCATED",
    STATUS_TXN_ALREADY_HAPPENED: "TXN_ALREADY_HAPPENED",
    STATUS_USER_DOESNT_EXIST: "USER_DOESNT_EXIST",
    STATUS_RECORD_ALREADY_SOFTLOCKED: "RECORD_ALREADY_SOFTLOCKED",
    STATUS_RECORD_HAS_BEEN_SOFTLOCKED: "RECORD_HAS_BEEN_SOFTLOCKED",
    STATUS_CREDIT_ADDED: "CREDIT_ADDED",
    STATUS_ABORTED: "ABORTED",
}

OPS = ("UPSERT_USER", "ADD_CREDIT", "REPORT_USAGE", "LOCK_USER", "UPDATE_USER", "DELETE_USER")

# Statuses each operation is expected to return (used by the status-mix audit).
EXPECTED_STATUSES = {
    "UPSERT_USER": (STATUS_OK, STATUS_TXN_ALREADY_HAPPENED),
    "ADD_CREDIT": (STATUS_CREDIT_ADDED, STATUS_TXN_ALREADY_HAPPENED, STATUS_USER_DOESNT_EXIST),
    "REPORT_USAGE": (STATUS_OK, STATUS_NO_MONEY, STATUS_SOME_UNITS_ALLOCATED,
                     STATUS_ALL_UNITS_ALLOCATED, STATUS_TXN_ALREADY_HAPPENED,
                     STATUS_USER_DOESNT_EXIST),
    "LOCK_USER": (STATUS_RECORD_ALREADY_SOFTLOCKED, STATUS_RECORD_HAS_BEEN_SOFTLOCKED,
                  STATUS_USER_DOESNT_EXIST),
    "UPDATE_USER": (STATUS_OK, STATUS_RECORD_HAS_BEEN_SOFTLOCKED, STATUS_USER_DOESNT_EXIST),
    "DELETE_USER": (STATUS_OK,),
}

USERS = T.StructType([
    T.StructField("userid", T.LongType(), False),
    T.StructField("user_json_object", T.StringType(), True),
    T.StructField("user_last_seen", T.TimestampType(), True),
    T.StructField("user_softlock_sessionid", T.LongType(), True),
    T.StructField("user_softlock_expiry", T.TimestampType(), True),
])

USAGE = T.StructType([
    T.StructField("userid", T.LongType(), False),
    T.StructField("allocated_amount", T.LongType(), False),
    T.StructField("sessionid", T.LongType(), False),
    T.StructField("lastdate", T.TimestampType(), False),
])

TXNS = T.StructType([
    T.StructField("userid", T.LongType(), False),
    T.StructField("user_txn_id", T.StringType(), False),
    T.StructField("txn_time", T.TimestampType(), False),
    T.StructField("sessionid", T.LongType(), True),
    T.StructField("approved_amount", T.LongType(), True),
    T.StructField("spent_amount", T.LongType(), True),
    T.StructField("purpose", T.StringType(), True),
])

FIN_EVENTS = T.StructType([
    T.StructField("userid", T.LongType(), False),
    T.StructField("amount", T.LongType(), False),
    T.StructField("user_txn_id", T.StringType(), False),
    T.StructField("message", T.StringType(), False),
    T.StructField("txn_time", T.TimestampType(), True),
])

USER_JSON = T.StructType([
    T.StructField("mysteriousHexPayload", T.StringType(), True),
    T.StructField("loyaltySchemeName", T.StringType(), True),
    T.StructField("loyaltySchemeNumber", T.LongType(), True),
])

REQUESTS = T.StructType([
    T.StructField("request_id", T.LongType(), False),
    T.StructField("txn_time", T.TimestampType(), False),
    T.StructField("userid", T.LongType(), False),
    T.StructField("op", T.StringType(), False),
    T.StructField("txn_id", T.StringType(), True),
    T.StructField("session_id", T.LongType(), True),
    T.StructField("units_used", T.LongType(), True),
    T.StructField("units_wanted", T.LongType(), True),
    T.StructField("amount", T.LongType(), True),
    T.StructField("json", T.StringType(), True),
    T.StructField("delta_op", T.StringType(), True),
])

DECISIONS = T.StructType([
    T.StructField("request_id", T.LongType(), False),
    T.StructField("userid", T.LongType(), False),
    T.StructField("txn_time", T.TimestampType(), False),
    T.StructField("op", T.StringType(), False),
    T.StructField("status", T.IntegerType(), False),
    T.StructField("status_text", T.StringType(), True),
    T.StructField("session_id", T.LongType(), True),
    T.StructField("approved", T.LongType(), True),
    T.StructField("spent", T.LongType(), True),
    T.StructField("balance_after", T.LongType(), True),
    T.StructField("allocated_after", T.LongType(), True),
])

ADDCREDIT_MSG = T.StructType([
    T.StructField("key", T.StringType(), True),
    T.StructField("value", T.StringType(), True),
])

LATENCY = T.StructType([
    T.StructField("seq", T.LongType(), True),
    T.StructField("type", T.StringType(), True),
    T.StructField("latency", T.IntegerType(), True),
    T.StructField("comment", T.StringType(), True),
    T.StructField("how_many", T.IntegerType(), True),
])

RUN_LOG = T.StructType([
    T.StructField("file", T.StringType(), True),
    T.StructField("line", T.StringType(), True),
])

METRICS = T.StructType([
    T.StructField("statname", T.StringType(), False),
    T.StructField("stathelp", T.StringType(), False),
    T.StructField("statvalue", T.LongType(), True),
])
