"""The command-line jobs run over stored relations."""

import os

from conftest import SF_SMALL

from tollgate import cli
from tollgate.operators import charge as D
from tollgate.sources import fixtures as fx


def test_cli_jobs(spark, tmp_path):
    d = str(tmp_path)
    fx.requests(spark, SF_SMALL).write.parquet(f"{d}/requests")
    fx.users_locked(spark, SF_SMALL).write.parquet(f"{d}/users")
    fx.opening_events(spark, SF_SMALL).write.parquet(f"{d}/opening")
    fx.usage_keyed(spark, SF_SMALL).write.parquet(f"{d}/usage")
    fx.txns(spark, SF_SMALL).write.parquet(f"{d}/txns")
    fx.fin_events(spark, SF_SMALL).write.parquet(f"{d}/events")
    cli.main(["replay", "--requests", f"{d}/requests", "--users", f"{d}/users", "--opening", f"{d}/opening",
              "--out", f"{d}/replay"])
    assert D.ChargeResult.load(spark, f"{d}/replay").decisions.count() == spark.read.parquet(f"{d}/requests").count()
    cli.main(["metrics", "--users", f"{d}/users", "--usage", f"{d}/usage", "--txns", f"{d}/txns",
              "--as-of", "2024-01-01T02:00:00", "--out", f"{d}/metrics"])
    assert spark.read.parquet(f"{d}/metrics").count() >= 3
    cli.main(["retain", "--usage", f"{d}/usage", "--txns", f"{d}/txns", "--as-of", "2024-01-01T04:00:00",
              "--out", f"{d}/retained"])
    assert os.path.isdir(f"{d}/retained/usage") and os.path.isdir(f"{d}/retained/txns")
    cli.main(["audit", "--events", f"{d}/events", "--usage", f"{d}/usage", "--users", f"{d}/users",
              "--out", f"{d}/audit"])
    assert spark.read.parquet(f"{d}/audit/spendable").count() > 0
    cli.main(["stream", "--requests-dir", f"{d}/requests", "--users", f"{d}/users", "--opening", f"{d}/opening",
              "--out", f"{d}/stream", "--checkpoint", f"{d}/ck", "--once"])
    assert spark.read.parquet(f"{d}/stream/out").filter("kind = 'decision'").count() == \
        spark.read.parquet(f"{d}/requests").count()
