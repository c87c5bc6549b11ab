"""Matching records by nearest time: a stateful streaming join (problem 6).

Both sides come as one event stream with an event-time watermark. State buffers the left and right events of every
entity; a left event is answered once the watermark has passed its time plus tolerance (no nearer right event can come
any more), and right events are evicted once no left event that may still come or is still held can reach them.

An entity's events are cut into time shards (right events near a shard's border go to both sides of it), and the
(entity, shard) pairs are spread over hash buckets, each one state entry: a hot entity is spread over many buckets, and
one entry holds about 1/buckets of what the watermark has not yet released. Inside a bucket all entities are answered
with one vectorised search.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vislake.session import shared_dir

#: Length of a time shard of an entity in microseconds (four hours); tolerances should be well below it.
SHARD_US = 4 * 3600 * 1_000_000
#: State entries per shuffle partition.
BUCKETS_PER_PARTITION = 8
#: A replay is fed by slices of time of this length (30 days), in groups of neighbouring ones ...
SLICE_US = 30 * 24 * 3600 * 1_000_000
#: ... at least so many groups, if there are slices enough, and more if entries would hold more than so many events.
LEAST_GROUPS = 6
ENTRY_EVENTS = 50_000

LEFT, RIGHT, FLUSH = 0, 1, 2
#: Event time that lets the watermark pass everything (end of a bounded replay); in 2261, the last year pandas can hold.
END_US = 9_190_000_000_000_000

_EVENT = "bucket int, entity string, side int, t_us bigint, id bigint, payload bigint, tol_us double, event_time timestamp"
_OUT = "left_id bigint, payload bigint, right_id bigint, left_us bigint, right_us bigint"
_NO_LEFT = {"e": np.array([], object), "t": np.array([], np.int64), "id": np.array([], np.int64), "p": np.array([], np.int64), "tol": np.array([], float)}
_NO_RIGHT = {"e": np.array([], object), "t": np.array([], np.int64), "id": np.array([], np.int64)}


def nearest(left: dict, right: dict) -> tuple[np.ndarray, np.ndarray]:
    """For each left event the index of its nearest right event of the same entity, and whether it is in tolerance.

    Ties: the earlier right event, then the smaller id. right must be sorted by (entity, t, id).
    """
    n = len(left["t"])
    if not n or not len(right["t"]):
        return np.zeros(n, np.int64), np.zeros(n, bool)
    names, code = np.unique(np.concatenate([left["e"], right["e"]]).astype(str), return_inverse=True)
    lc, rc = code[:n], code[n:]
    # One sorted key over both: rank of (entity, time); equal right times keep the smallest id first.
    times, rank = np.unique(np.concatenate([left["t"], right["t"]]), return_inverse=True)
    lk, rk = lc * len(times) + rank[:n], rc * len(times) + rank[n:]
    after = np.searchsorted(rk, lk, "left")
    first = np.searchsorted(rk, rk, "left")  # first index among equal (entity, time): smallest id
    last = len(rk) - 1
    a, b = np.minimum(after, last), np.maximum(after - 1, 0)
    a_ok, b_ok = (after <= last) & (rc[a] == lc), (after > 0) & (rc[b] == lc)
    far = np.iinfo(np.int64).max
    da = np.where(a_ok, np.abs(right["t"][a] - left["t"]), far)
    db = np.where(b_ok, np.abs(right["t"][b] - left["t"]), far)
    best = np.where(db <= da, first[b], a)
    d = np.minimum(da, db)
    return best, (a_ok | b_ok) & (d <= left["tol"])


def _sorted_right(right: dict) -> dict:
    """Right events by (entity, t, id), repeated ones once."""
    order = np.lexsort((right["id"], right["t"], right["e"].astype(str)))
    r = {k: v[order] for k, v in right.items()}
    if len(order) > 1:
        new = np.ones(len(order), bool)
        new[1:] = (r["e"][1:] != r["e"][:-1]) | (r["t"][1:] != r["t"][:-1])
        r = {k: v[new] for k, v in r.items()}  # of equal times only the smallest id can be an answer
    return r


def step(left: dict, right: dict, watermark_us: int, reach_us: float) -> tuple[pd.DataFrame, dict, dict]:
    """Answers released by the watermark, and the buffers after eviction."""
    due = left["t"] + left["tol"] < watermark_us
    ready = {k: v[due] for k, v in left.items()}
    left = {k: v[~due] for k, v in left.items()}
    right = _sorted_right(right)
    index, hit = nearest(ready, right)
    out = pd.DataFrame({"left_id": ready["id"][hit], "payload": ready["p"][hit], "right_id": right["id"][index[hit]] if hit.any() else np.array([], np.int64), "left_us": ready["t"][hit], "right_us": right["t"][index[hit]] if hit.any() else np.array([], np.int64)})
    # A left event that may still come is not older than the watermark; held ones may be older.
    oldest = min(watermark_us, int(left["t"].min())) if len(left["t"]) else watermark_us
    keep = right["t"] + reach_us >= oldest
    return out, left, {k: v[keep] for k, v in right.items()}


def _operator(reach_us: float):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        left, right = pickle.loads(state.get[0]) if state.exists else (_NO_LEFT, _NO_RIGHT)
        if not state.hasTimedOut:
            new = [b[b["side"] != FLUSH] for b in batches]
            new = pd.concat(new) if new else pd.DataFrame()
            if len(new):
                is_left = (new["side"] == LEFT).to_numpy()
                part = lambda c, at, kind: new[c].to_numpy()[at].astype(kind)
                left = {k: np.concatenate([left[k], part(c, is_left, kind)]) for k, c, kind in (("e", "entity", object), ("t", "t_us", np.int64), ("id", "id", np.int64), ("p", "payload", np.int64), ("tol", "tol_us", float))}
                right = {k: np.concatenate([right[k], part(c, ~is_left, kind)]) for k, c, kind in (("e", "entity", object), ("t", "t_us", np.int64), ("id", "id", np.int64))}
        watermark_ms = state.getCurrentWatermarkMs()
        out, left, right = step(left, right, watermark_ms * 1000, reach_us)
        if len(left["t"]) or len(right["t"]):
            state.update((pickle.dumps((left, right), protocol=5),))
            horizons = [x.min() for x in (left["t"] + left["tol"], right["t"] + reach_us) if len(x)]
            state.setTimeoutTimestamp(max(int(min(horizons) // 1000) + 2, watermark_ms + 1))
        elif state.exists:
            state.remove()
        if len(out):
            yield out

    return run


def events(side: DataFrame, which: int, entity: list[str], t_us: str, row_id: str, payload: str | None, tol_us: str, buckets: int) -> DataFrame:
    """Events of one side. Rows with a NULL entity, time, id or tolerance (or a negative or NaN one) match nothing and are left out."""
    wide = F.col(tol_us).cast("double")
    good = F.col(t_us).isNotNull() & F.col(row_id).isNotNull() & F.coalesce(~F.isnan(wide) & (wide >= 0), F.lit(False))
    for c in entity:
        good = good & F.col(c).isNotNull()
    at = lambda x: F.floor(x / SHARD_US).cast("bigint")
    shards = F.array(at(F.col(t_us))) if which == LEFT else F.sequence(at(F.col(t_us) - wide), at(F.col(t_us) + wide))
    flat = side.where(good).select(F.explode(shards).alias("shard"), *[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(entity)], F.lit(which).alias("side"), F.col(t_us).alias("t_us"), F.col(row_id).cast("bigint").alias("id"), (F.col(payload).cast("bigint") if payload else F.lit(0).cast("bigint")).alias("payload"), wide.alias("tol_us"))
    # Lengths in front make the joined name unambiguous.
    name = F.concat(*[x for i in range(len(entity)) for x in (F.length(f"k{i}").cast("string"), F.lit(":"), F.col(f"k{i}"))], F.col("shard").cast("string"))
    named = flat.select(name.alias("entity"), "side", "t_us", "id", "payload", "tol_us", F.timestamp_micros("t_us").alias("event_time"))
    return named.select(F.pmod(F.xxhash64("entity"), F.lit(buckets)).cast("int").alias("bucket"), *named.columns)


def nearest_time_join(stream: DataFrame, lateness: str, reach_us: float) -> DataFrame:
    """Pairs (left_id, payload, right_id, left_us, right_us) from a stream of events() of both sides.

    Each left event gets the right event of its entity with the smallest time difference if that is within the left
    event's tolerance (inclusive); ties: earlier right event, then smaller id; no row if none is near enough. lateness:
    how far an event may lag behind the newest one seen (events later than that are dropped by the stream, as with any
    watermark). reach_us: the largest tolerance of any left event. Repeated left events are answered each, repeated right
    events change nothing. An empty side gives no rows.
    """
    marked = stream.withWatermark("event_time", lateness)
    return marked.groupBy("bucket").applyInPandasWithState(_operator(reach_us), _OUT, "buffers binary", "append", GroupStateTimeout.EventTimeTimeout)


def default_buckets(df: DataFrame) -> int:
    """State entries: a multiple of the shuffle partitions, so they grow with the cluster's own setting."""
    return BUCKETS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _slices(rows: DataFrame, folder: str) -> list[tuple[int, int]]:
    """Write events by slices of time; (slice, number of events) in order of time. Files are about one a partition."""
    spark = rows.sparkSession
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_time = rows.withColumn("slice", F.floor(F.col("t_us") / SLICE_US).cast("bigint"))
    by_time.repartition("slice", F.pmod("bucket", F.lit(max(1, wide // 16)))).write.partitionBy("slice").parquet(folder)
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not any(x.isDirectory() for x in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)):
        return []
    # One row per 30 days that have events.
    return sorted((r["slice"], r["count"]) for r in spark.read.parquet(folder).groupBy("slice").count().collect())


def replay(rows: DataFrame, reach_us: float) -> DataFrame:
    """Run the join over bounded tables (a union of events() of both sides) and return the pairs.

    The events are written once by slices of SLICE_US and then fed to the stream in the order of time, a group of slices a
    micro-batch: the watermark follows, rows are answered and evicted on the way, and state is what one group and the
    tolerance span. Groups are of equal size, at least LEAST_GROUPS of them and so many that a state entry holds about
    ENTRY_EVENTS. A last flush event lets the watermark pass every horizon. State, offsets and pairs are in the shared
    folder, so a lost executor costs a retry only; the pairs are deleted when the driver ends, all else before returning.
    """
    spark = rows.sparkSession
    home = f"{shared_dir(spark).rstrip('/')}/nearest-time-{uuid.uuid4().hex}"
    path = lambda x: spark._jvm.org.apache.hadoop.fs.Path(f"{home}/{x}")
    files = path("").getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(path("pairs"))
    buckets = default_buckets(rows)
    held = _slices(rows.where(F.col("side") != FLUSH), f"{home}/events")
    if not held:
        files.delete(path("events"), True)
        return spark.createDataFrame([], _OUT)
    total = sum(n for _, n in held)
    size = total / max(LEAST_GROUPS, -(-total // (buckets * ENTRY_EVENTS)))
    groups: list[list[int]] = [[]]
    filled = 0
    for number, n in held:
        if filled >= size:
            groups.append([])
            filled = 0
        groups[-1].append(number)
        filled += n
    flush = spark.range(1).select(F.lit(-1).alias("bucket"), F.lit("").alias("entity"), F.lit(FLUSH).alias("side"), F.lit(END_US).cast("bigint").alias("t_us"), F.lit(0).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("payload"), F.lit(0.0).alias("tol_us"), F.timestamp_micros(F.lit(END_US)).alias("event_time"))
    flush.coalesce(1).write.parquet(f"{home}/flush")
    files.mkdirs(path("feed"))
    own = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    before = {k: spark.conf.get(k, None) for k in own}
    query = None
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        for n, group in enumerate([*groups, None]):
            # A group becomes visible at once, so that it is one micro-batch.
            files.mkdirs(path(f"next/{n}"))
            for number in group if group is not None else [0]:
                source = f"events/slice={number}" if group is not None else "flush"
                if not files.rename(path(source), path(f"next/{n}/{number}")):
                    raise OSError(f"cannot move {home}/{source}")
            if not files.rename(path(f"next/{n}"), path(f"feed/{n}")):
                raise OSError(f"cannot move {home}/next/{n}")
            if query is None:
                stream = spark.readStream.schema(_EVENT).parquet(f"{home}/feed/*/*")
                joined = nearest_time_join(stream, "0 seconds", reach_us)
                query = joined.writeStream.format("parquet").option("path", f"{home}/pairs").option("checkpointLocation", f"{home}/checkpoint").outputMode("append").start()
            query.processAllAvailable()
    finally:
        if query is not None:
            query.stop()
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for x in ("events", "next", "feed", "checkpoint"):
        files.delete(path(x), True)
    return spark.read.schema(_OUT).parquet(f"{home}/pairs")
