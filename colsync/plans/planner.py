"""Codec plans: how many bytes of each column go to which codec.

Inputs are small tables of lengths and of measured codecs, never payloads.  For
a column of ``n`` bytes and a codec of gain ``g`` (original over compressed) and
speed ``b`` (original bytes a second), on a network of ``w`` bytes a second,
compressing takes ``n / b`` and sending ``n / (g w)``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsync.operators.codecs import NOCOMPRESSION, POOL
from colsync.plans import simplex

#: Bytes of a sample; bytes below which a block isn't planned; the target of compressing and of sending, in seconds.
UNIT, LEAST, TARGET = 100_000, 100, 0.05
#: Speed that stands for no work at all.
INSTANT = 1e12


def scope(profile: DataFrame, keys: list[str]) -> list[str]:
    """What joins a profile to columns: the column's name, and the block's keys if the profile is that of each block."""
    own = [k for k in keys if k in profile.columns]
    if own and own != keys:
        raise ValueError(f"a profile by block has all of {keys}")
    return [*own, "column_name"]


def with_plain(profile: DataFrame, columns: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The profile with ``nocompression``, gain 1 at no cost, for every column; of every block, if the profile has ``keys``."""
    by = scope(profile, keys or [])
    plain = columns.select(*by).distinct().select(*by, F.lit(NOCOMPRESSION).alias("codec"), F.lit(1.0).alias("gain"), F.lit(INSTANT).alias("bw"))
    return profile.where(F.col("codec") != NOCOMPRESSION).select(*by, "codec", "gain", "bw").unionByName(plain)


def missing_profiles(columns: DataFrame, codecs: DataFrame, profile: DataFrame) -> DataFrame:
    """Pairs of column and codec that have not been measured: ``column_name, codec``."""
    # a short list of codecs beside the names of the columns
    pairs = columns.select("column_name").distinct().join(F.broadcast(codecs.select("codec").distinct()), F.lit(True))
    return pairs.join(profile, ["column_name", "codec"], "left_anti")


def sample_plan(columns: DataFrame, missing: DataFrame, keys: list[str], unit: int = UNIT) -> DataFrame:
    """A sample of ``unit`` bytes for each codec that a column misses, in the order of ids, as far as its bytes go."""
    w = Window.partitionBy(*keys, "column_name").orderBy("codec")
    joined = columns.select(*keys, "column_name", "ori_len").join(missing, "column_name")
    lo = (F.row_number().over(w) - 1) * unit
    return joined.withColumn("lo", lo.cast("long")).withColumn("byte_num", F.least(F.lit(unit), F.col("ori_len") - F.col("lo")).cast("long")).where("byte_num > 0")


def one_best(columns: DataFrame, profile: DataFrame, keys: list[str], bandwidth: float) -> DataFrame:
    """The one codec of each block by ``min(w, compressed / time) * gain``; ties go to the lower id.

    ``profile`` may have the block's ``keys``: each block is judged by its own timings then.  A block without bytes has nothing to send: its scores are 0, and the lowest id is its codec.
    """
    joined = columns.select(*keys, "column_name", "ori_len").join(profile, scope(profile, keys))
    summed = joined.groupBy(*keys, "codec").agg(F.sum("ori_len").alias("ori"), F.sum(F.col("ori_len") / F.col("gain")).alias("cmpr"), F.sum(F.col("ori_len") / F.col("bw")).alias("seconds"))
    none = F.lit(0.0)
    score = F.coalesce(F.least(F.lit(float(bandwidth)), F.col("cmpr") / F.nullif(F.col("seconds"), none)) * F.col("ori") / F.nullif(F.col("cmpr"), none), none)
    best = F.max_by(F.struct("codec", F.round("score", 3).alias("score")), F.struct(F.round("score", 3), -F.col("codec")))
    return summed.withColumn("score", score).groupBy(*keys).agg(best.alias("b")).select(*keys, "b.codec", "b.score")


def allocate(rows: pd.DataFrame, bandwidth: float, busy: float = 0.0, target: float = TARGET) -> tuple[pd.DataFrame, dict]:
    """Bytes of each column for each codec of one block, and what the programs gave.

    The first program sends as fast as it can while compressing takes no longer
    than sending.  If that takes less than ``target``, the second one makes the
    sum of both least, with each of them within ``target``.
    """
    rows = rows.sort_values(["column_name", "codec"]).reset_index(drop=True)
    names, column = np.unique(rows["column_name"], return_inverse=True)
    pack, send = (rows["ori_len"] / rows["bw"]).to_numpy(), (rows["ori_len"] / (rows["gain"] * bandwidth)).to_numpy()
    whole = np.zeros((len(names), len(rows)))
    whole[column, np.arange(len(rows))] = 1
    ones = np.ones(len(names))
    first = simplex.solve(send, [pack - send], [-busy], whole, ones)
    chosen, switched = first, False
    if first.success and first.fun < target:
        second = simplex.solve(send + pack + busy, [send, pack + busy * whole.sum(axis=0)], [target, target], whole, ones)
        if second.success:
            chosen, switched = second, True
    share = np.clip(np.round(chosen.x, 12), 0, 1) if chosen.success else (rows["codec"] == NOCOMPRESSION).to_numpy().astype(float)
    rows = rows.assign(byte_num=np.floor(rows["ori_len"].to_numpy() * share + 1e-6).astype(np.int64))
    left = rows.groupby("column_name")["ori_len"].transform("first") - rows.groupby("column_name")["byte_num"].transform("sum")
    rows["byte_num"] += np.where(rows["codec"] == NOCOMPRESSION, left, 0)
    return rows, {"objective": first.fun, "status": first.status, "switched": switched, "second": chosen.fun}


def _hulls(joined: DataFrame, keys: list[str], bandwidth: float) -> DataFrame:
    """A row for each column: ``*keys, column_name, ori_len, choices, hull, best``.

    A choice is a codec with its seconds to ``pack`` and to ``send`` and ``over``,
    the one less the other.  With a price on ``over`` a choice is the cheapest
    from price ``lo`` to ``hi``; ``hull`` has the choices that are so anywhere, by
    rising price.  ``best`` is the one of the least sum.  A column has a choice
    for each codec that plans choose from, so all this is arithmetic on short arrays.
    """
    pack, send = F.col("ori_len") / F.col("bw"), F.col("ori_len") / (F.col("gain") * bandwidth)
    choice = F.struct("codec", (pack - send).alias("over"), send.alias("send"), pack.alias("pack"), "gain", "bw")
    rows = joined.groupBy(*keys, "column_name").agg(F.first("ori_len").alias("ori_len"), F.array_sort(F.collect_list(choice)).alias("choices"))
    none = F.lit(0.0)

    def price(k: Column, j: Column) -> Column:
        """The price at which both cost the same."""
        return (k["send"] - j["send"]) / F.nullif(j["over"] - k["over"], none)

    def lowest(k: Column) -> Column:
        return F.aggregate("choices", none, lambda acc, j: F.greatest(acc, F.when(j["over"] > k["over"], price(k, j)).otherwise(none)))

    def highest(k: Column) -> Column:
        beaten = lambda j: (j["over"] == k["over"]) & ((j["send"] < k["send"]) | ((j["send"] == k["send"]) & (j["codec"] < k["codec"])))
        return F.aggregate("choices", F.lit(float("inf")), lambda acc, j: F.when(beaten(j), F.lit(-1.0)).when(j["over"] < k["over"], F.least(acc, price(k, j))).otherwise(acc))

    ends = F.transform("choices", lambda k: F.struct(lowest(k).alias("lo"), k["codec"].alias("codec"), k["over"].alias("over"), k["send"].alias("send"), highest(k).alias("hi")))
    best = F.array_min(F.transform("choices", lambda k: F.struct((k["send"] + k["pack"]).alias("sum"), k["codec"].alias("codec"), k["send"].alias("send"), k["pack"].alias("pack"))))
    return rows.withColumn("hull", F.array_sort(F.filter(ends, lambda x: x["lo"] < x["hi"]))).withColumn("best", best)


def _swept(hulls: DataFrame, keys: list[str], busy: float, target: float, least: int) -> DataFrame:
    """A row for each column and choice of its hull: the share that the first program gives it, what it came to, and how the block is planned.

    At price 0 each column has the choice that is sent soonest.  If compressing
    takes too long then, the price rises: columns move along their hulls, the
    cheapest step of all first, until enough is saved, and the last step is taken in
    part.  Steps in the order of their prices with prefix sums of what they save
    are that sweep.
    """
    block = Window.partitionBy(*keys)
    whole = lambda c: F.sum(c).over(block)
    first, last = F.col("hull")[0], F.element_at("hull", -1)
    rows = hulls.withColumn("need", whole(first["over"]) + busy).withColumn("most", whole(first["over"] - last["over"])).withColumn("soonest", whole(first["send"]))
    rows = rows.withColumn("bytes", whole(F.col("ori_len"))).withColumn("_send", whole(F.col("best.send"))).withColumn("_pack", whole(F.col("best.pack") + busy))
    at = rows.select("*", F.posexplode("hull").alias("step", "x"))
    before = F.get("hull", F.greatest(F.col("step") - 1, F.lit(0)))
    at = at.withColumn("saved", before["over"] - F.col("x.over"))
    at = at.withColumn("dearer", F.col("x.send") - before["send"])
    line = block.orderBy(F.col("x.lo"), "column_name", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("need") - (F.sum("saved").over(line) - F.col("saved"))
    taken = F.when(F.col("step") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), left / F.nullif(F.col("saved"), F.lit(0.0)))))
    at = at.withColumn("taken", taken)
    at = at.withColumn("objective", F.col("soonest") + whole(F.col("taken") * F.col("dearer")))
    after = F.coalesce(F.lead("taken").over(Window.partitionBy(*keys, "column_name").orderBy("step")), F.lit(0.0))
    at = at.withColumn("share", F.round(F.col("taken") - after, 12))
    switched = F.col("objective") < target
    unbound = (F.col("_send") <= target) & (F.col("_pack") <= target)
    route = F.when(F.col("bytes") < least, "plain").when(F.col("need") > F.col("most") * (1 + 1e-12), "simplex").when(~switched, "first").when(unbound, "second").otherwise("simplex")
    return at.withColumn("route", route)


def lp_plan(columns: DataFrame, profile: DataFrame, keys: list[str], bandwidth: float, busy: float = 0.0, target: float = TARGET, least: int = LEAST) -> DataFrame:
    """Plan items of each block: ``*keys, column_name, codec, byte_num, objective, status, switched``.

    ``profile`` may have the block's ``keys``, as in ``one_best``.  A block of fewer than ``least`` bytes goes as it is.  The bytes of a column
    add up to its length: what rounding leaves goes uncompressed.

    The programs are those of ``allocate``.  The first has one bound that
    columns share, so a sweep over one price solves it (``_swept``), and the
    second is solved by each column alone where its bounds don't hold it back; both are built-in
    functions.  Only blocks for which the second's bounds bind, or the first
    has no solution, go to the simplex, a block at a time.
    """
    joined = columns.select(*keys, "column_name", "ori_len").where("ori_len > 0").join(with_plain(profile, columns, keys), scope(profile, keys))
    swept = _swept(_hulls(joined, keys, bandwidth), keys, busy, target, least)
    shared = F.floor(F.col("ori_len") * F.col("share") + 1e-6).cast("long")
    alone = (F.col("route") == "second") & (F.col("step") == 0)
    items = F.when(F.col("route") == "first", F.struct(F.col("x.codec").alias("codec"), shared.alias("byte_num"))).when(alone, F.struct(F.col("best.codec").alias("codec"), F.col("ori_len").cast("long").alias("byte_num")))
    solved = swept.where("route <> 'simplex'").groupBy(*keys, "column_name", "ori_len", "objective", "route").agg(F.collect_list(items).alias("items"))
    left = F.col("ori_len") - F.aggregate("items", F.lit(0).cast("long"), lambda acc, x: acc + x["byte_num"])
    every = solved.withColumn("item", F.explode(F.concat("items", F.array(F.struct(F.lit(NOCOMPRESSION).alias("codec"), left.cast("long").alias("byte_num"))))))
    summed = every.groupBy(*keys, "column_name", "item.codec", "objective", "route").agg(F.sum("item.byte_num").alias("byte_num")).where("byte_num > 0")
    objective = F.when(F.col("route") == "plain", 0.0).otherwise(F.col("objective"))
    found = summed.select(*keys, "column_name", F.col("codec").cast("int").alias("codec"), "byte_num", objective.alias("objective"), F.lit(0).alias("status"), (F.col("route") == "second").alias("switched"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema if f.name in keys), "column_name string, codec int, byte_num long, objective double, status int, switched boolean"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out, said = allocate(rows, bandwidth, busy, target)
        out = out.assign(objective=said["objective"], status=said["status"], switched=said["switched"])
        return out.loc[out["byte_num"] > 0, [*keys, "column_name", "codec", "byte_num", "objective", "status", "switched"]]

    bound = swept.where("route = 'simplex' AND step = 0").select(*keys, "column_name", "ori_len", F.explode("choices").alias("c")).select(*keys, "column_name", "ori_len", "c.codec", "c.gain", "c.bw")
    return found.unionByName(bound.groupBy(*keys).applyInPandas(run, schema))


def segments_of(plan: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """Plan items as byte ranges of their column: ``seg_no, lo, hi`` in the order of codec ids."""
    w = Window.partitionBy(*keys, "column_name").orderBy("codec").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hi = F.sum("byte_num").over(w)
    number = F.row_number().over(Window.partitionBy(*keys, "column_name").orderBy("codec")) - 1
    return plan.withColumn("seg_no", number).withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col("byte_num"))


def from_measured(measured: DataFrame, keys: list[str] | None = None, least: int = 1) -> DataFrame:
    """A profile from measured segments: gain is original over compressed bytes, speed original bytes a second; with ``keys``, one for each block."""
    by = [*(keys or []), "column_name", "codec"]
    summed = measured.groupBy(*by).agg(F.sum("ori_len").alias("ori"), F.sum("cmpr_len").alias("cmpr"), F.sum("seconds").alias("s")).where(F.col("ori") >= least)
    return summed.select(*by, (F.col("ori") / F.greatest("cmpr", F.lit(1))).alias("gain"), (F.col("ori") / F.greatest("s", F.lit(1e-9))).alias("bw"))


def pool() -> list[int]:
    """Ids of the codecs that plans choose from."""
    return list(POOL)


def theoretical_times(ori: Column, gain: Column, bw: Column, bandwidth: float) -> dict[str, Column]:
    """Seconds to compress, to send, and the longer of both."""
    pack, send = ori / bw, ori / (gain * bandwidth)
    return {"compress_s": pack, "transmit_s": send, "theoretical_s": F.greatest(pack, send)}
