"""DataFrame forms of the test inputs described in FIXTURES.md.

The reference ships no data, so every relation it works on is derived from
the driver's ``events`` and ``customer`` tables by deterministic rules.  The
rules only shape rows into the schemas the operators expect; none of the
operators' work happens here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tollgate import schema as S
from tollgate.functions.columns import user_json
from tollgate.sources.tables import table

BASE_US = 1704067200000000          # 2024-01-01T00:00:00Z in microseconds
SQUEEZE = 180                       # 30 days -> 4 hours
HOUR_US = 3600 * 1000000
METRICS_AS_OF_US = BASE_US + 2 * HOUR_US
RETENTION_AS_OF_US = BASE_US + 4 * HOUR_US


def _ts(us: Column | int) -> Column:
    return F.timestamp_micros(us if isinstance(us, Column) else F.lit(us))


def events(spark: SparkSession, sf_dir: str, squeeze: int = SQUEEZE) -> DataFrame:
    """events with the squeezed time ``t_us`` (epoch microseconds)."""
    ev = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    return ev.withColumn(
        "t_us", F.lit(BASE_US) + F.expr(f"(unix_micros(cast(ts as timestamp)) - {BASE_US}) div {squeeze}"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer."""
    c = table(spark, sf_dir, "customer", "c_custkey")
    return c.select(F.col("c_custkey").alias("userid"),
                    user_json(F.col("c_custkey")).alias("user_json_object"),
                    _ts(BASE_US).alias("user_last_seen"),
                    F.lit(None).cast("long").alias("user_softlock_sessionid"),
                    F.lit(None).cast("timestamp").alias("user_softlock_expiry"))


def opening_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opening credit of every customer."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal")
    return c.select(F.col("c_custkey").alias("userid"),
                    F.floor("c_acctbal").cast("long").alias("amount"),
                    F.concat(F.lit("Create_"), F.col("c_custkey").cast("string")).alias("user_txn_id"),
                    F.lit(S.MSG_USER_CREATED).alias("message"),
                    _ts(BASE_US).alias("txn_time"))


def signed_up(df: DataFrame) -> DataFrame:
    """The rows of users who are there before the request log starts; the
    others are unknown until the log signs them up (for the replays, and what
    reports requests of unknown users)."""
    return df.filter(F.col("userid") % 10 != 7)


def known_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signed_up(users(spark, sf_dir))


def known_opening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signed_up(opening_events(spark, sf_dir))


_FIELDS = ["op", "txn_id", "session_id", "units_used", "units_wanted", "amount", "json"]


def _field_cols() -> list[Column]:
    """Request fields of an event under the part-1 mapping (meaningful for
    non-error events)."""
    et, eid = F.col("event_type"), F.col("event_id")
    is_report = et.isin("click", "view")
    return [
        F.when((et == "signup") & (eid % 97 == 0), "DELETE_USER")
         .when(et == "signup", "UPSERT_USER")
         .when(et == "purchase", "ADD_CREDIT")
         .otherwise("REPORT_USAGE").alias("op"),
        F.concat(F.lit("T"), eid.cast("string")).alias("txn_id"),
        F.when(is_report & (eid % 4 != 0), F.col("user_id") * 10 + eid % 4).alias("session_id"),
        F.when(et == "click", eid % 50).when(et == "view", eid % 30).alias("units_used"),
        F.when(et == "click", eid % 2000 + 1).when(et == "view", F.lit(0).cast("long")).alias("units_wanted"),
        F.when(et == "signup", F.floor("value").cast("long"))
         .when(et == "purchase", F.floor(F.col("value") * 10).cast("long")).alias("amount"),
        F.when((et == "signup") & (eid % 97 != 0), user_json(F.col("user_id"))).alias("json"),
    ]


def _fields(ev: DataFrame) -> DataFrame:
    """Request fields of each non-error event (the part-1 mapping)."""
    return ev.filter(F.col("event_type") != "error").select("event_id", "user_id", "event_type", "t_us",
                                                            *_field_cols())


DAY_US = 24 * HOUR_US


def _retries(ev: DataFrame) -> DataFrame:
    """Error events become a copy of the user's latest earlier non-error
    event (max event_id over the earlier events in (ts, event_id) order),
    with their own request id and time.  The source's fields travel inside a
    struct whose first field is event_id, so a running max of the struct is
    the latest source.  Two-level running max, so that a user with a large
    share of the events is split by day: the max inside (user, day) over
    earlier rows, and the max of the user's earlier days (one row per day)
    joined back on (user, day)."""
    src = F.when(F.col("event_type") != "error", F.struct(F.col("event_id"), *_field_cols()))
    ev = (ev.withColumn("_day", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(DAY_US)).cast("long"))
          .withColumn("_src", src))
    per_day = ev.groupBy("user_id", "_day").agg(F.max("_src").alias("_day_max"))
    earlier = Window.partitionBy("user_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_day.select("user_id", "_day", F.max("_day_max").over(earlier).alias("_carry"))
    inside = (Window.partitionBy("user_id", "_day").orderBy("ts", "event_id")
              .rowsBetween(Window.unboundedPreceding, -1))
    errors = (ev.withColumn("_in", F.max("_src").over(inside))
              .filter(F.col("event_type") == "error").join(carry, ["user_id", "_day"])
              .withColumn("_s", F.greatest("_in", "_carry")).filter(F.col("_s").isNotNull()))
    return errors.select((F.col("event_id") * 10).alias("request_id"), _ts(F.col("t_us")).alias("txn_time"),
                         F.col("user_id").alias("userid"), *[F.col(f"_s.{c}").alias(c) for c in _FIELDS],
                         F.lit(None).cast("string").alias("delta_op"))


def requests(spark: SparkSession, sf_dir: str, squeeze: int = SQUEEZE) -> DataFrame:
    """The request log, its times squeezed (1: over the whole 30 days, where
    users are often idle for hours): part 1 (one request per non-error event, a retry for
    each error event) and part 2 (lock / lock / update triples after some
    sign-ups).  Part 1 and part 2 come from one generator pass over events;
    the retries need the running max above."""
    ev = events(spark, sf_dir, squeeze)
    et, eid = F.col("event_type"), F.col("event_id")
    variants = F.concat(F.when(et != "error", F.array(F.lit(0))).otherwise(F.array().cast("array<int>")),
                        F.when((et == "signup") & (eid % 3 == 0), F.array(F.lit(1), F.lit(2), F.lit(3)))
                         .otherwise(F.array().cast("array<int>")))
    k = F.col("k")
    lock = k > 0
    expanded = ev.select("*", *_field_cols()).withColumn("k", F.explode(variants))
    direct = expanded.select(
        (eid * 10 + k).alias("request_id"),
        _ts(F.col("t_us") + F.when(k <= 1, 0).when(k == 2, 20000)
            .when(eid % 2 == 0, 30000).otherwise(90000)).alias("txn_time"),
        F.col("user_id").alias("userid"),
        F.when(k == 0, F.col("op")).when(k < 3, "LOCK_USER").otherwise("UPDATE_USER").alias("op"),
        F.when(~lock, F.col("txn_id")).alias("txn_id"),
        F.when(k == 0, F.col("session_id"))
         .when(k == 3, F.when(eid % 4 == 1, F.lit(-1).cast("long")).otherwise(eid * 10 + 1)).alias("session_id"),
        F.when(~lock, F.col("units_used")).alias("units_used"),
        F.when(~lock, F.col("units_wanted")).alias("units_wanted"),
        F.when(~lock, F.col("amount")).alias("amount"),
        F.when(k == 0, F.col("json"))
         .when(k == 3, F.when(eid % 4 == 2, F.when(eid % 5 == 0, F.lit("abc")).otherwise(eid.cast("string")))
               .otherwise(user_json(F.col("user_id"), number=eid))).alias("json"),
        F.when((k == 3) & (eid % 4 == 2), F.lit(S.NEW_LOYALTY_NUMBER)).alias("delta_op"))
    return direct.unionByName(_retries(ev))


def requests_single_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-session variant: credits and usage reports only, one session per
    user (session id = user id), users that exist only, no retries."""
    fields = _fields(events(spark, sf_dir)).filter(F.col("event_type").isin("purchase", "click", "view"))
    known = users(spark, sf_dir).select(F.col("userid").alias("user_id"))
    return (fields.join(known, "user_id", "left_semi")
            .select((F.col("event_id") * 10).alias("request_id"), _ts(F.col("t_us")).alias("txn_time"),
                    F.col("user_id").alias("userid"), "op", "txn_id",
                    F.when(F.col("op") == "REPORT_USAGE", F.col("user_id")).alias("session_id"),
                    "units_used", "units_wanted", "amount", "json",
                    F.lit(None).cast("string").alias("delta_op")))


def txns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger built directly from events (not the fold's output)."""
    ev = events(spark, sf_dir).filter(F.col("event_type") != "error")
    et, eid = F.col("event_type"), F.col("event_id")
    return ev.select(
        F.col("user_id").alias("userid"),
        F.concat(F.lit("T"), eid.cast("string")).alias("user_txn_id"),
        _ts(F.col("t_us")).alias("txn_time"),
        F.when(et.isin("click", "view") & (eid % 4 != 0), F.col("user_id") * 10 + eid % 4).alias("sessionid"),
        F.when(et == "click", eid % 100).otherwise(F.lit(0).cast("long")).alias("approved_amount"),
        F.when(et == "click", -(eid % 50)).when(et == "view", -(eid % 30))
         .otherwise(F.floor("value").cast("long")).alias("spent_amount"),
        et.alias("purpose"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reservations from click events, *not* keyed (several rows may share a
    (userid, sessionid) pair)."""
    return _usage_raw(spark, sf_dir).drop("event_id")


def _usage_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).filter(F.col("event_type") == "click")
    eid = F.col("event_id")
    return ev.select(
        F.col("user_id").alias("userid"),
        (eid % 100).alias("allocated_amount"),
        (F.col("user_id") * 10 + eid % 4).alias("sessionid"),
        _ts(F.col("t_us")).alias("lastdate"),
        eid.alias("event_id"))


def usage_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reservations keyed on (userid, sessionid): the latest row wins (a
    partial max(struct) aggregate, no per-key sort)."""
    latest = (_usage_raw(spark, sf_dir).groupBy("userid", "sessionid")
              .agg(F.max(F.struct("lastdate", "event_id", "allocated_amount")).alias("m")))
    return latest.select("userid", F.col("m.allocated_amount").alias("allocated_amount"), "sessionid",
                         F.col("m.lastdate").alias("lastdate"))


def addcredit_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).filter(F.col("event_type") == "purchase")
    eid = F.col("event_id")
    good = F.concat(F.lit('"'), F.col("user_id").cast("string"), F.lit('","'),
                    F.floor(F.col("value") * 10).cast("long").cast("string"), F.lit('","T'),
                    eid.cast("string"), F.lit('"'))
    return ev.select(F.concat(F.lit("T"), eid.cast("string")).alias("key"),
                     F.when(eid % 50 == 0, F.lit('"x",,')).otherwise(good).alias("value"))


def addcredit_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The add-credit messages with the metadata a topic record carries:
    ``timestamp`` (the squeezed event time) and ``offset`` (event_id * 10)."""
    ev = events(spark, sf_dir).filter(F.col("event_type") == "purchase")
    msgs = addcredit_messages(spark, sf_dir)
    meta = ev.select(F.concat(F.lit("T"), F.col("event_id").cast("string")).alias("key"),
                     _ts(F.col("t_us")).alias("timestamp"), (F.col("event_id") * 10).alias("offset"))
    return msgs.join(meta, "key")


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", "event_id", "event_type", "value")
    eid = F.col("event_id")
    return ev.select(
        eid.alias("seq"), F.col("event_type").alias("type"),
        (F.floor(F.col("value") * 1000) - 500).cast("int").alias("latency"),
        F.when(eid % 7 == 0, F.concat(F.lit("c"), eid.cast("string"))).otherwise(F.lit("")).alias("comment"),
        (eid % 3 + 1).cast("int").alias("how_many"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark log text: one summary line per (event_type, day of month) in
    the writer's format (every third day with the prefix of a gathered log,
    every seventh cut off), plus one noise line per group without the marker."""
    ev = table(spark, sf_dir, "events", "ts", "event_type")
    g = (ev.groupBy("event_type", F.dayofmonth("ts").alias("day"))
         .agg(F.count(F.lit(1)).alias("c"), F.min("ts").alias("first_ts")))
    c = F.col("c")
    tpms = F.col("day") * 10
    tps = tpms * 10 * (c % 20 + 85)
    prefix = F.when(F.col("day") % 3 == 0, F.lit("ami-1:t1:c5:1:Y:charge:8:3:run.log:")).otherwise(F.lit(""))
    parts = [prefix, F.date_format("first_ts", S.LOG_TIME_FORMAT), F.lit(":" + S.SUMMARY_MARKER + ":"),
             tpms.cast("string"), F.lit(":"), tps.cast("string"), F.lit(".0:")]
    for i in range(3):
        p99 = (c * 37 + i * 1000) % 20000
        for v in ((c + i) % 97, (c * 3 + i) % 500, p99, p99 + 100, p99 + 200, p99 + 300, p99 + 1000):
            parts += [v.cast("string"), F.lit(":")]
        parts.append(F.when(c % 5 == 0, F.lit("1.2E7:")).otherwise(F.concat((c % 5).cast("string"), F.lit(".0:"))))
    file = F.concat(F.lit("run_"), F.col("event_type"), F.lit(".log"))
    text = F.concat(*parts)
    text = F.when(F.col("day") % 7 == 0, F.concat(F.substring_index(text, ":", 12), F.lit(":oops"))).otherwise(text)
    summary = g.select(file.alias("file"), text.alias("line"))
    noise = g.select(file.alias("file"),
                     F.concat(F.date_format("first_ts", S.LOG_TIME_FORMAT), F.lit(":Processed "),
                              c.cast("string"), F.lit(" transactions")).alias("line"))
    return summary.unionByName(noise)


def fin_events(spark: SparkSession, sf_dir: str, opening=opening_events) -> DataFrame:
    """Financial events for the view tests: the opening events plus one event
    per ledger row of ``txns`` that moved money."""
    moves = (txns(spark, sf_dir).filter(F.col("spent_amount") != 0)
             .select("userid", F.col("spent_amount").alias("amount"), "user_txn_id",
                     F.col("purpose").alias("message"), "txn_time"))
    return opening(spark, sf_dir).unionByName(moves)


def users_locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users where every third holds a soft lock expiring around the metrics
    as_of (some before it, some after)."""
    u = users(spark, sf_dir)
    locked = F.col("userid") % 3 == 0
    expiry = _ts(F.lit(METRICS_AS_OF_US) + (F.col("userid") % 7 - 3) * 60000000)
    return u.select("userid", "user_json_object", "user_last_seen",
                    F.when(locked, F.col("userid") * 10 + 1).alias("user_softlock_sessionid"),
                    F.when(locked, expiry).alias("user_softlock_expiry"))
