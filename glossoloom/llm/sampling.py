"""Reproducible samples that stay stable as data grow: stratified thresholds on a salted hash of the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of the hash that are compared, 52 bits.
DIGITS = 13
#: Default rates by stratum of the occurrence sample and its salt.
SALT = "glossoloom-1"
OTHER_RATE = 0.1
#: Every version of the rates that was ever in force, the newest last; entries are added, never taken away.
VERSIONS = ({"contracted": 0.2, "uncontracted": 0.1},)


def threshold(rate: float) -> str:
    """Hash prefixes below it, as text, are a part ``rate`` of all; 1 and more lies above every prefix."""
    if rate < 0:
        raise ValueError("a rate is not negative")
    return "g" if rate >= 1 else format(int(rate * 16**DIGITS), f"0{DIGITS}x")


def raise_thresholds(*versions: dict[str, float]) -> dict[str, float]:
    """Rates in force after several versions: a stratum's rate never sinks, so no earlier member is lost."""
    out: dict[str, float] = {}
    for v in versions:
        for k, r in v.items():
            out[k] = max(r, out.get(k, 0.0))
    return out


RATES = raise_thresholds(*VERSIONS)


def recorded_rates(spark: SparkSession, store: str, proposed: dict[str, float]) -> dict[str, float]:
    """Rates in force with those proposed, by all versions recorded in ``store`` (stratum, rate); what is higher is added.

    A store that does not exist is empty. A lower proposal changes nothing, so members stay members. The store holds a
    row for each stratum and raise.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    before = {r.stratum: r.rate for r in spark.read.parquet(store).groupBy("stratum").agg(F.max("rate").alias("rate")).collect()} if exists else {}
    now = raise_thresholds(before, proposed)
    raised = [(k, float(r)) for k, r in sorted(now.items()) if r > before.get(k, -1.0)]
    if raised:
        spark.createDataFrame(raised, "stratum string, rate double").write.mode("append").parquet(store)
    return now


def hash_prefix(key, salt: str):
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}|"), key.cast("string")), 256), 1, DIGITS)


def stable_sample(
    df: DataFrame, *, key: str = "datapoint_id", stratum: str = "form", rates: dict[str, float] = RATES, other_rate: float = OTHER_RATE, salt: str = SALT
) -> DataFrame:
    """Distinct (key) of the sample.

    A key is a member when some row of it passes the threshold of that row's stratum. Membership thus depends on
    single rows only: not on order, partitioning or other rows, and rows added later, repeated or with another
    stratum can add members but never remove one. Rows with a null key are no candidates; a null or unlisted stratum
    has ``other_rate``. One row-wise filter comes first, so only members are shuffled, pre-aggregated by key.
    """
    limit = F.lit(threshold(other_rate))
    for name, rate in sorted(rates.items()):
        limit = F.when(F.col(stratum) == name, F.lit(threshold(rate))).otherwise(limit)
    return df.filter(F.col(key).isNotNull() & (hash_prefix(F.col(key), salt) < limit)).select(key).distinct()
