"""Multi-armed bandits and next-best-action with a decision log.

Arms are a table (arm, pulls, rewards, alpha, beta, mu, m2); a batch of rewards is one
aggregate by arm. The number of arms is bounded by MAX_ARMS, which draws check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_ARMS = 100_000
ARMS = "arm string, pulls long, rewards double, alpha double, beta double, mu double, m2 double"
DECISION_SECONDS = 24 * 3600


class TooManyArms(ValueError):
    pass


def init(spark: SparkSession, arms: list[str], warm: DataFrame | None = None, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """New arms at the prior; arms that exist keep what they have learnt."""
    fresh = spark.createDataFrame([(a, 0, 0.0, float(alpha), float(beta), 0.0, 0.0) for a in dict.fromkeys(arms) if a], ARMS)
    return fresh if warm is None else warm.unionByName(fresh.join(warm.select("arm"), "arm", "left_anti"))


def reward_beta(arms: DataFrame, rewards: DataFrame) -> DataFrame:
    """rewards: arm, reward. Over 0.5 adds to alpha, else to beta; unknown arms are ignored."""
    sums = rewards.groupBy("arm").agg(F.count(F.lit(1)).alias("_n"), F.sum("reward").alias("_r"), F.count_if(F.col("reward") > 0.5).alias("_up"))
    j = arms.join(sums, "arm", "left").fillna(0, ["_n", "_r", "_up"])
    return j.select("arm", (F.col("pulls") + F.col("_n")).alias("pulls"), (F.col("rewards") + F.col("_r")).alias("rewards"), (F.col("alpha") + F.col("_up")).alias("alpha"), (F.col("beta") + F.col("_n") - F.col("_up")).alias("beta"), "mu", "m2")


def reward_gaussian(arms: DataFrame, rewards: DataFrame) -> DataFrame:
    """Running mean and squared deviation, merged from the batch's own by the pairwise rule."""
    s = rewards.groupBy("arm").agg(F.count(F.lit(1)).alias("_n"), F.sum("reward").alias("_r"), F.avg("reward").alias("_m"), F.var_pop("reward").alias("_v"))
    j = arms.join(s, "arm", "left").fillna(0, ["_n", "_r", "_m", "_v"])
    total, gap = F.col("pulls") + F.col("_n"), F.col("_m") - F.col("mu")
    mu = F.when(total > 0, F.col("mu") + gap * F.col("_n") / total).otherwise(F.col("mu"))
    m2 = F.when(total > 0, F.col("m2") + F.col("_v") * F.col("_n") + gap * gap * F.col("pulls") * F.col("_n") / total).otherwise(F.col("m2"))
    return j.select("arm", total.alias("pulls"), (F.col("rewards") + F.col("_r")).alias("rewards"), "alpha", "beta", mu.alias("mu"), m2.alias("m2"))


def eligible(arms: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arms of the given ids (arm), and the ids that no arm has; empty ids are ignored."""
    asked = ids.where(F.col("arm").isNotNull() & (F.col("arm") != "")).select("arm").distinct()
    return arms.join(asked, "arm", "left_semi"), asked.join(arms.select("arm"), "arm", "left_anti")


def ucb1(arms: DataFrame, c: float = 2**0.5) -> DataFrame:
    """arm, score of the choice: the first arm without a pull, else the best upper bound."""
    # one row of totals
    n = arms.agg(F.sum("pulls").alias("_all"))
    j = arms.join(F.broadcast(n), F.lit(True))
    mean = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("rewards") / F.col("pulls")))
    score = F.when(F.col("pulls") == 0, F.lit(float("inf"))).otherwise(mean + c * F.sqrt(2 * F.log(F.col("_all").cast("double")) / F.col("pulls")))
    return j.select("arm", score.alias("score")).orderBy(F.desc("score"), "arm").limit(1)


def exploit(arms: DataFrame) -> DataFrame:
    """The arm of the best mean: observed if pulled, else the prior's; ties by id."""
    mean = F.when(F.col("pulls") > 0, F.col("rewards") / F.col("pulls")).otherwise(F.col("alpha") / (F.col("alpha") + F.col("beta")))
    return arms.select("arm", mean.alias("score")).orderBy(F.desc("score"), "arm").limit(1)


def snapshot(arms: DataFrame, family: str = "beta") -> DataFrame:
    mean = F.col("alpha") / (F.col("alpha") + F.col("beta")) if family == "beta" else F.col("mu")
    return arms.select("arm", "pulls", "rewards", mean.alias("mean"))


def _local(arms: DataFrame) -> pd.DataFrame:
    rows = arms.orderBy("arm").limit(MAX_ARMS + 1).toPandas()
    if len(rows) > MAX_ARMS:
        raise TooManyArms(f"more than {MAX_ARMS} arms")
    return rows


GAMMA_COUNTS = 1 << 16
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


class _Numbers:
    """Random numbers by counter: those of a (request, arm) depend on its stream and on how
    many were drawn before, not on what else is in the batch."""

    def __init__(self, streams: np.ndarray):
        self.streams, self.drawn = streams, 0

    def uniform(self) -> np.ndarray:
        """Within 0 and 1, both excluded."""
        self.drawn += 1
        x = _mixed(self.streams + np.array([self.drawn], np.uint64) * _ODD[0])
        return (x >> np.uint64(12)).astype(np.float64) / (1 << 52) + 1 / (1 << 53)

    def normal(self) -> np.ndarray:
        return np.sqrt(-2 * np.log(self.uniform())) * np.cos(2 * np.pi * self.uniform())

    def gamma(self, shape: np.ndarray) -> np.ndarray:
        """By Marsaglia and Tsang's rejection; shapes under 1 are drawn one higher and scaled.
        However often others of the batch are rejected, what follows starts at the same count."""
        after = self.drawn + GAMMA_COUNTS
        d = np.where(shape < 1, shape + 1, shape) - 1 / 3
        c = 1 / np.sqrt(9 * d)
        out, open_ = np.zeros(self.streams.shape), np.ones(self.streams.shape, dtype=bool)
        while open_.any():
            z, u = self.normal(), self.uniform()
            v = (1 + c * z) ** 3
            with np.errstate(invalid="ignore", divide="ignore"):
                ok = open_ & (v > 0) & (np.log(u) < z * z / 2 + d - d * v + d * np.log(v))
            out[ok] = (d * v)[ok]
            open_ &= ~ok
        self.drawn = after
        return np.where(shape < 1, out * self.uniform() ** (1 / shape), out)


def _drawn(table: pd.DataFrame, keys: np.ndarray, policy: str, family: str, seed: int, epsilon: float, sigma: float) -> np.ndarray:
    """The place of the chosen arm of each request."""
    arm = np.arange(len(table), dtype=np.uint64) * _ODD[2]
    base = _mixed(keys.view(np.uint64) ^ np.array([seed % (1 << 64)], np.uint64) * _ODD[1])
    numbers = _Numbers(_mixed(base[:, None] ^ arm[None, :]))
    alpha, beta, pulls = (table[c].to_numpy(float)[None, :] for c in ("alpha", "beta", "pulls"))
    shape = numbers.streams.shape
    if policy == "thompson" and family == "beta":
        x, y = numbers.gamma(np.broadcast_to(alpha, shape)), numbers.gamma(np.broadcast_to(beta, shape))
        draw = x / (x + y)
    elif policy == "thompson":
        draw = table.mu.to_numpy(float)[None, :] + sigma / np.sqrt(pulls + 1) * numbers.normal()
    else:
        mean = np.where(pulls > 0, table.rewards.to_numpy(float)[None, :] / np.maximum(pulls, 1), alpha / (alpha + beta))
        explore = _Numbers(base).uniform() < epsilon
        draw = np.where(explore[:, None], numbers.uniform(), mean)
    return draw.argmax(axis=1)


def sample(arms: DataFrame, requests: DataFrame, key: str, policy: str = "thompson", seed: int = 0, epsilon: float = 0.1, family: str = "beta", sigma: float = 1.0) -> DataFrame:
    """key, arm: one draw for each request row, reproducible by its key and the seed. The arms'
    posteriors go to the tasks; draws are vectorised over blocks of requests and arms."""
    if policy not in ("thompson", "epsilon"):
        raise ValueError(f"unknown policy {policy!r}")
    table = _local(arms)
    names = table.arm.to_numpy()
    block = max(1, 200_000 // max(1, len(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, picks = batch.column(1).to_numpy(), []
            for a in range(0, len(keys), block):
                picks += names[_drawn(table, keys[a:a + block], policy, family, seed, epsilon, sigma)].tolist() if len(names) else [None] * len(keys[a:a + block])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(picks, pa.string())], ["key", "arm"])

    kind = requests.schema[key].dataType.simpleString()
    return requests.select(key, F.xxhash64(key).alias("_h")).mapInArrow(run, f"`{key}` {kind}, arm string")


def next_best_action(arms: DataFrame, requests: DataFrame, key: str, ts: str, allowed: DataFrame | None = None, fallback: str | None = None, **policy) -> DataFrame:
    """Decision log: key, ts, arm, reason, expires. allowed restricts the arms (arm); requests
    get the fallback if no arm is left."""
    usable = arms if allowed is None else eligible(arms, allowed)[0]
    drawn = sample(usable, requests, key, **policy)
    out = requests.select(key, ts).join(drawn, key)
    reason = F.when(F.col("arm").isNull(), F.lit("no_eligible_arm")).otherwise(F.lit("bandit"))
    return out.select(key, ts, F.coalesce("arm", F.lit(fallback)).alias("arm"), reason.alias("reason"), (F.col(ts) + F.lit(DECISION_SECONDS)).alias("expires"))


def record_rewards(decisions: DataFrame, rewards: DataFrame, key: str, ts: str) -> DataFrame:
    """arm, reward of rewards that meet a decision that hasn't expired; one for each decision."""
    first = F.row_number().over(Window.partitionBy(key).orderBy("_ts"))
    j = decisions.select(key, "arm", "expires").join(rewards.select(key, F.col(ts).alias("_ts"), "reward"), key).where(F.col("_ts") <= F.col("expires"))
    return j.withColumn("_n", first).where("_n = 1").select("arm", "reward")
