"""Command-line jobs over stored relations (parquet with the schemas in
``tollgate.schema``).  Submit with spark-submit on a cluster, or run locally:

    python -m tollgate.cli replay  --requests R --users U --opening E --out O [--mode strict]
    python -m tollgate.cli stream  --requests-dir R --users U --opening E --out O --checkpoint C [--usage S --txns T] [--once]
    python -m tollgate.cli metrics --users U --usage S --txns T --as-of 2024-01-01T02:00:00 --out O
    python -m tollgate.cli retain  --usage S --txns T --as-of 2024-01-01T04:00:00 --out O
    python -m tollgate.cli audit   --events E --usage S --users U --out O [--threshold 1000]

Every job reads with explicit schemas, writes new snapshots to a new path
(never over its own input) and takes the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import argparse
import datetime as dt
import os

from pyspark.sql import SparkSession


def _ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def _spark(args) -> SparkSession:
    from tollgate.session import cluster_conf, get_session, prepare
    if args.master:
        return get_session(args.master, shuffle_partitions=args.shuffle_partitions)
    spark = SparkSession.builder.getOrCreate()
    if not (spark.sparkContext.master or "").startswith("local"):
        for key, value in cluster_conf(int(args.shuffled_gb * 1024 ** 3), streaming=args.job == "stream").items():
            spark.conf.set(key, value)  # the job's own session
    return prepare(spark)


def replay(spark, args) -> None:
    from tollgate.operators import charge as D
    from tollgate.sources import tables as TB
    r = D.charge(TB.read_requests(spark, args.requests), users=TB.read_users(spark, args.users),
                 opening_events=spark.read.parquet(args.opening).select("userid", "amount"),
                 usage=TB.read_usage(spark, args.usage) if args.usage else None,
                 txns=TB.read_txns(spark, args.txns) if args.txns else None, mode=args.mode)
    r.save(args.out)


def stream(spark, args) -> None:
    from tollgate.sources import tables as TB
    from tollgate.streaming import charge_stream as CS
    reqs = CS.request_stream(spark, args.requests_dir, max_files_per_trigger=args.max_files)
    out = CS.charge_stream(reqs, users=TB.read_users(spark, args.users),
                           opening_events=spark.read.parquet(args.opening).select("userid", "amount"),
                           usage=TB.read_usage(spark, args.usage) if args.usage else None,
                           txns=TB.read_txns(spark, args.txns) if args.txns else None, mode=args.mode)
    w = (out.writeStream.foreachBatch(CS.write_charge_outputs(args.out))
         .option("checkpointLocation", args.checkpoint))
    q = (w.trigger(availableNow=True) if args.once else w.trigger(processingTime=args.interval)).start()
    q.awaitTermination()


def metrics(spark, args) -> None:
    from tollgate.operators import metrics as M
    from tollgate.sources import tables as TB
    M.current_metrics(TB.read_users(spark, args.users), TB.read_usage(spark, args.usage),
                      TB.read_txns(spark, args.txns), _ts(args.as_of)).write.mode("overwrite").parquet(args.out)


def retain(spark, args) -> None:
    from tollgate.operators import maintenance as R
    from tollgate.sources import tables as TB
    as_of = _ts(args.as_of)
    R.ttl_usage(TB.read_usage(spark, args.usage), as_of).write.parquet(os.path.join(args.out, "usage"))
    R.ttl_txns(TB.read_txns(spark, args.txns), as_of).write.parquet(os.path.join(args.out, "txns"))


def audit(spark, args) -> None:
    from tollgate.operators import audit as C
    from tollgate.sources import tables as TB
    ev = TB.read_fin_events(spark, args.events)
    spend = C.spendable_balance(ev, TB.read_usage(spark, args.usage))
    spend.write.parquet(os.path.join(args.out, "spendable"))
    C.negative_balance_audit(spend).write.parquet(os.path.join(args.out, "negative"))
    C.topup_candidates(spend, args.threshold).write.parquet(os.path.join(args.out, "topup"))
    C.missing_balance_audit(TB.read_users(spark, args.users), ev).write.parquet(os.path.join(args.out, "missing"))


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="tollgate")
    p.add_argument("--master", help="only for local runs, e.g. local[8]")
    p.add_argument("--shuffle-partitions", type=int, default=8, help="of a local run")
    p.add_argument("--shuffled-gb", type=float, default=0, help="GB that the job shuffles, on a cluster")
    sub = p.add_subparsers(dest="job", required=True)
    a = sub.add_parser("replay")
    for k in ("requests", "users", "opening", "out"):
        a.add_argument(f"--{k}", required=True)
    a.add_argument("--usage")
    a.add_argument("--txns")
    a.add_argument("--mode", default="reference", choices=("reference", "strict"))
    a = sub.add_parser("stream")
    for k in ("requests-dir", "users", "opening", "out", "checkpoint"):
        a.add_argument(f"--{k}", required=True)
    a.add_argument("--usage")
    a.add_argument("--txns")
    a.add_argument("--mode", default="reference", choices=("reference", "strict"))
    a.add_argument("--once", action="store_true")
    a.add_argument("--interval", default="30 seconds")
    a.add_argument("--max-files", type=int)
    a = sub.add_parser("metrics")
    for k in ("users", "usage", "txns", "as-of", "out"):
        a.add_argument(f"--{k}", required=True)
    a = sub.add_parser("retain")
    for k in ("usage", "txns", "as-of", "out"):
        a.add_argument(f"--{k}", required=True)
    a = sub.add_parser("audit")
    for k in ("events", "usage", "users", "out"):
        a.add_argument(f"--{k}", required=True)
    a.add_argument("--threshold", type=int, default=1000)
    args = p.parse_args(argv)
    spark = _spark(args)
    {"replay": replay, "stream": stream, "metrics": metrics, "retain": retain, "audit": audit}[args.job](spark, args)


if __name__ == "__main__":
    main()
