"""Percentiles, nearest times, packing and mixing against brute force and invariants."""

import random
import time
from collections import defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vislake.llm.mixing import mix, quotas, shares
from vislake.llm.nearest_time import LEFT, RIGHT, SLICE_US, events, nearest_time_join, replay
from vislake.llm.packing import Capacities, best_fit_decreasing, pack
from vislake.llm import rank_summary
from vislake.llm.rank_summary import EPSILON, Summary, budget_of, combine, combined, merge_all, percentiles, summarise
from vislake.llm.tokens import TOKENIZER, measured, weight

# --- 5 ---------------------------------------------------------------------------------------------------------------


def _ranks(x, v):
    return np.searchsorted(x, v, "left") + 1, np.searchsorted(x, v, "right")


@pytest.mark.parametrize("kind", ["normal", "ties", "heavy", "sorted"])
def test_merged_summaries_keep_their_bound(kind):
    rng = np.random.default_rng(1)
    x = {"normal": rng.normal(size=40_000), "ties": rng.integers(0, 5, 40_000).astype(float), "heavy": rng.standard_cauchy(40_000), "sorted": np.arange(40_000.0)}[kind]
    for epsilon, fans in ((0.1, (37,)), (EPSILON, (37,)), (0.02, (4, 4, 4)), (0.1, (2,) * 7)):
        parts = [Summary.of(np.sort(c)).pruned(epsilon) for c in np.array_split(x, int(np.prod(fans)))]
        for fan in fans:  # trees of any depth stay within epsilon
            parts = [merge_all(parts[i : i + fan], epsilon) for i in range(0, len(parts), fan)]
        (s,) = parts
        full = np.sort(x)
        assert s.n == len(x) and len(s.v) <= budget_of(s.level, epsilon) + 1 and s.level == len(fans) and s.err <= epsilon * s.n
        lo, hi = _ranks(full, s.v)
        assert np.all(s.lo <= hi) and np.all(s.hi >= lo)  # the interval meets the true ranks of the value
        for q in np.linspace(0, 1, 23):
            value, _, _, off = s.at(q)
            want = 1 + q * (len(x) - 1)
            a, b = _ranks(full, value)
            assert max(a - want, want - b, 0) <= off + 1e-9 <= s.err + 0.5 + 1e-6


def test_percentiles_on_spark(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.choice(["hot"] * 8 + ["a", "b"], 60_000), "x": rng.normal(size=60_000) ** 3})
    pdf.loc[::50, "x"] = np.nan
    pdf.loc[1::50, "x"] = np.inf
    df = spark.createDataFrame(pdf).withColumn("v", F.lit(1)).withColumn("n", F.lit(2)).repartition(9)
    direct = percentiles(combined(df, ["g"], "x"), ["g"], [0.0, 0.5, 0.99]).collect()
    days = combine(summarise(df.withColumn("day", (F.rand(1) * 5).cast("int").cast("string")), ["g", "day"], "x"), ["g", "day"])
    for rows in (direct, percentiles(combine(days, ["g"]), ["g"], [0.0, 0.5, 0.99]).collect()):
        assert len(rows) == 9
        for r in rows:
            x = np.sort(pdf.x[(pdf.g == r["g"]) & np.isfinite(pdf.x)])
            assert r["n"] == len(x) and r["rank_error"] <= r["rank_bound"] + 1e-9 <= EPSILON + 0.5 / len(x) + 1e-9
            a, b = _ranks(x, r["value"])
            want = 1 + r["q"] * (len(x) - 1)
            assert max(a - want, want - b, 0) <= r["rank_error"] * len(x) + 1e-6
    before, rank_summary.FAN_IN = rank_summary.FAN_IN, 3  # nine partitions: two more levels
    try:
        deep = percentiles(combined(df, ["g"], "x"), ["g"], [0.5]).collect()
    finally:
        rank_summary.FAN_IN = before
    for r in deep:
        x = np.sort(pdf.x[(pdf.g == r["g"]) & np.isfinite(pdf.x)])
        a, b = _ranks(x, r["value"])
        assert max(a - 1 - r["q"] * (len(x) - 1), 1 + r["q"] * (len(x) - 1) - b, 0) <= r["rank_error"] * len(x) + 1e-6 and r["rank_bound"] <= EPSILON + 0.5 / len(x)
    assert len(deep) == 3
    assert combined(df.where("false"), ["g"], "x").count() == 0
    null = combined(df.withColumn("g", F.lit(None).cast("string")).limit(10), ["g"], "x").collect()
    assert len(null) == 1 and null[0]["g"] is None


# --- 6 ---------------------------------------------------------------------------------------------------------------

_LEFT, _RIGHT = "e string, t bigint, id bigint, p bigint, tol double, shard int, entity string", "e string, t bigint, id bigint, tol double"


def _nearest(left, right):
    out = set()
    for e, t, i, p, tol, *_ in left:
        if None in (e, t, i, tol) or not tol >= 0:
            continue
        c = min(((abs(rt - t), rt, ri) for re, rt, ri, _ in right if re == e and rt is not None and ri is not None), default=None)
        if c and c[0] <= tol:
            out.add((i, p, c[2]))
    return out


def test_nearest_time_replay_matches_brute_force(spark):
    rng = random.Random(3)
    hour = 3_600_000_000
    right = [(rng.choice(["a", "b"]), rng.randrange(0, 30 * hour), k, 5e9) for k in range(400)]
    right += [(e, t, k + 1000, x) for e, t, k, x in right[:40]] + [(None, 5, 1, 5e9), ("a", None, 2, 5e9)]
    left = [(rng.choice(["a", "b", "c"]), rng.randrange(0, 30 * hour), k, k % 7, float(rng.choice([0, 2e8, 5e9])), 0, "x") for k in range(300)]
    left += [("a", right[5][1], 900, 0, 0.0, 0, "x"), (None, 5, 901, 0, 1.0, 0, "x"), ("a", 5, 902, 0, float("nan"), 0, "x"), ("a", 5, 903, 0, -1.0, 0, "x")]
    # exactly between two: the earlier wins
    right += [("d", 100, 5, 5e9), ("d", 300, 4, 5e9), ("d", 300, 3, 5e9)]
    left += [("d", 200, 904, 0, 5e9, 0, "x"), ("d", 301, 905, 0, 5e9, 0, "x")]
    ls, rs = spark.createDataFrame(left, _LEFT), spark.createDataFrame(right, _RIGHT)
    both = events(ls, LEFT, ["e"], "t", "id", "p", "tol", 8).unionByName(events(rs, RIGHT, ["e"], "t", "id", None, "tol", 8))
    got = {(r["left_id"], r["payload"], r["right_id"]) for r in replay(both, 5e9).collect()}
    assert got == _nearest(left, right)
    assert (904, 0, 5) in got and (905, 0, 3) in got


def test_nearest_time_over_many_slices(spark):
    """Two years of events in disorder: the watermark moves from group to group, and pairs across slices are kept."""
    rng = random.Random(5)
    day = 86_400_000_000
    right = [(rng.choice("ab"), rng.randrange(0, 730 * day), k, 2.0 * day) for k in range(800)]
    left = [(rng.choice("abc"), rng.randrange(0, 730 * day), k, 0, rng.choice([0.1, 2.0]) * day, 0, "x") for k in range(600)]
    left += [(rng.choice("ab"), SLICE_US * k + d, 1000 + 10 * k + d, 0, 2.0 * day, 0, "x") for k in range(1, 20) for d in (-1, 0, 1)]
    both = events(spark.createDataFrame(left, _LEFT), LEFT, ["e"], "t", "id", "p", "tol", 8).unionByName(events(spark.createDataFrame(right, _RIGHT), RIGHT, ["e"], "t", "id", None, "tol", 8))
    assert {(r["left_id"], r["payload"], r["right_id"]) for r in replay(both, 2.0 * day).collect()} == _nearest(left, right)


def test_nearest_time_of_nothing(spark):
    ls, rs = spark.createDataFrame([], _LEFT), spark.createDataFrame([("a", 5, 1, 5e9)], _RIGHT)
    both = events(ls, LEFT, ["e"], "t", "id", "p", "tol", 4).unionByName(events(rs, RIGHT, ["e"], "t", "id", None, "tol", 4))
    assert replay(both, 5e9).count() == 0 and replay(both.where("false"), 5e9).count() == 0


def test_live_stream_answers_once_the_watermark_passes_and_evicts(spark, tmp_path):
    """Three micro-batches in time order: early rows are answered before the stream ends, a right row of the next batch
    that is nearer still counts, and state shrinks."""
    minute = 60_000_000
    source, out = Path(tmp_path / "in"), str(tmp_path / "out")
    one = lambda rows: spark.createDataFrame(rows, "side int, e string, t bigint, id bigint, tol double")
    batches = [[(0, "a", 10 * minute, 1, 2e8), (1, "a", 8 * minute, 10, 2e8)], [(1, "a", 11 * minute, 11, 2e8), (0, "a", 60 * minute, 2, 2e8)], [(1, "a", 200 * minute, 12, 2e8), (1, "a", 61 * minute, 13, 2e8)]]
    schema = "side int, e string, t bigint, id bigint, tol double"
    source.mkdir()
    answered = []
    for k, rows in enumerate(batches):
        one(rows).coalesce(1).write.parquet(str(source / f"b{k}"))
        raw = spark.readStream.schema(schema).parquet(f"{source}/b*")
        parts = [events(raw.where(F.col("side") == s), s, ["e"], "t", "id", None, "tol", 2) for s in (LEFT, RIGHT)]
        stream = nearest_time_join(parts[0].unionByName(parts[1]), "5 minutes", 2e8)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        state = q.lastProgress["stateOperators"][0] if q.lastProgress else {}
        answered.append({(r["left_id"], r["right_id"]) for r in spark.read.schema("left_id bigint, payload bigint, right_id bigint, left_us bigint, right_us bigint").parquet(out).collect()})
        time.sleep(0.1)
    assert answered == [set(), {(1, 11)}, {(1, 11), (2, 13)}]
    assert state.get("numRowsTotal", 1) == 1  # what is left holds only the newest right row


# --- 7 ---------------------------------------------------------------------------------------------------------------


def test_tightest_container_is_found():
    rng = random.Random(4)
    tree, rooms, number = Capacities(100), defaultdict(list), 0
    for _ in range(3000):
        if rng.random() < 0.5:
            left = rng.randrange(0, 101)
            tree.add(left, number)
            rooms[left].append(number)
            number += 1
        else:
            need = rng.randrange(1, 101)
            fits = [r for r, v in rooms.items() if r >= need and v]
            got = tree.take(need)
            assert (got is None) == (not fits)
            if got:
                assert got[1] == min(fits) and got[0] in rooms[got[1]]
                rooms[got[1]].remove(got[0])


def _plain_best_fit(lengths, capacity):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - x)
        else:
            rooms.append(capacity - x)
    return len(rooms)


def test_packing_equals_plain_best_fit_and_places_do_not_overlap():
    rng = np.random.default_rng(5)
    lengths = rng.integers(0, 260, 400)
    rows = best_fit_decreasing(lengths, 100)
    got = defaultdict(list)
    total = defaultdict(int)
    for item, part, container, place, n in rows:
        got[container].append((place, n))
        total[item] += n
        assert part == 0 or lengths[item] > 100
    assert all(total[i] == n for i, n in enumerate(lengths))
    for v in got.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:])) and sum(n for _, n in v) <= 100
    whole = sum(n // 100 - (n % 100 == 0) for n in lengths if n > 100)
    rest = [n if n <= 100 else (n - 1) % 100 + 1 for n in lengths if n]
    assert len(got) == whole + _plain_best_fit(rest, 100)


def test_pack_on_spark(spark):
    rng = np.random.default_rng(6)
    n = [int(x) for x in rng.integers(0, 900, 300)]
    df = spark.createDataFrame([(k, x, "s") for k, x in enumerate(n)] + [(7, n[7], "s"), (None, 5, "s"), (999, None, "s")], "doc_id bigint, n_tokens bigint, shard string")
    got = pack(df, {"small": 100, "large": 500}, items_per_shard=50).toPandas()
    for spec, cap in (("small", 100), ("large", 500)):
        g = got[got.spec_id == spec]
        placed = g[g.container.notna()]
        assert placed.n_tokens.sum() == sum(n) + n[7] + 5 and (placed.groupby("container").n_tokens.sum() <= cap).all()
        assert set(g[g.container.isna()].doc_id.dropna()) == {k for k, x in enumerate(n) if x == 0} | {999}
        fill = placed.n_tokens.sum() / (placed.container.nunique() * cap)
        assert fill > 0.9
        cut = set(placed[placed.part > 0].doc_id.dropna())
        assert all(n[int(k)] > cap for k in cut)
    assert pack(df.where("false"), {"small": 100}).count() == 0 and pack(df, {}).count() == 0
    with pytest.raises(ValueError):
        pack(df, {"none": 0})


# --- 8 ---------------------------------------------------------------------------------------------------------------


def _corpus(spark):
    rng = np.random.default_rng(7)
    rows = [(k, s, int(rng.integers(1, 300)), float(rng.uniform(0.05, 1))) for k, s in enumerate(["big"] * 3000 + ["mid"] * 300 + ["tiny"] * 30)]
    rows += [(9000, None, 50, 0.5), (9001, "big", 0, 0.5), (9002, "mid", 40, None), (9003, "mid", 40, float("nan"))]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, weight double")


def _targets(spark, rows):
    return spark.createDataFrame(rows, "mix_id string, source string, target_share double, max_repeats int")


def test_mix_reaches_the_shares_within_the_caps(spark):
    sizes = _corpus(spark).cache()
    targets = _targets(spark, [("m", "big", 0.6, 2), ("m", "mid", 0.3, 3), ("m", "tiny", 0.1, 6), ("n", "tiny", 1.0, 4), ("o", "none", 0.5, 2), ("o", "mid", 0.5, 2)])
    chosen = mix(sizes, targets, seed=1).toPandas()
    assert not chosen.duplicated(["mix_id", "doc_id"]).any() and chosen.times.min() >= 1
    for (m, s), g in chosen.groupby(["mix_id", "source"]):
        cap = targets.where((F.col("mix_id") == m) & (F.col("source") == s)).first()["max_repeats"]
        assert g.times.max() <= cap and g.times.max() - (g.times.min() if len(g) == sizes.where((F.col("source") == s) & (F.col("n_tokens") > 0)).count() else 0) <= 1
    report = shares(mix(sizes, targets, seed=1), sizes, targets).toPandas().set_index(["mix_id", "source"])
    for s, want in (("big", 0.6), ("mid", 0.3), ("tiny", 0.1)):
        assert abs(report.loc[("m", s), "reached_share"] - want) < 0.01
        assert 0 <= report.loc[("m", s), "budget"] - report.loc[("m", s), "tokens"] < 300
    assert report.loc[("n", "tiny"), "tokens"] == 4 * sizes.where("source = 'tiny'").agg(F.sum("n_tokens")).first()[0]
    assert report.loc[("o", "none"), "tokens"] == 0 and report.loc[("o", "mid"), "reached_share"] == 1.0
    again = mix(sizes.repartition(7), targets, seed=1).toPandas()
    key = ["mix_id", "doc_id"]
    assert chosen.sort_values(key, ignore_index=True).equals(again.sort_values(key, ignore_index=True)[chosen.columns])


def test_mix_prefers_heavier_documents_and_takes_a_prefix_of_keys(spark):
    sizes = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit(10).cast("bigint").alias("n_tokens"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(0.1).alias("weight"))
    targets = _targets(spark, [("m", "s", 1.0, 1)])
    got = mix(sizes, targets, total_tokens=20_000).select((F.col("doc_id") % 2).alias("odd")).groupBy("odd").count().toPandas().set_index("odd")["count"]
    assert got.sum() == 2000 and got[0] > 6 * got[1]
    assert quotas(sizes, targets, 10**9).first()["budget"] == 200_000


@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e6])
def test_mix_equals_a_plain_sort_at_any_scale_of_weights(spark, scale):
    """All ranges together draw exactly the smallest keys, and only a small part is sorted by row."""
    rng = np.random.default_rng(9)
    rows = [(k, "s", int(rng.integers(1, 50)), float(rng.uniform(0.2, 1) * scale)) for k in range(5000)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, weight double")
    got = mix(sizes, _targets(spark, [("m", "s", 1.0, 1)]), seed=3, total_tokens=40_000)
    u = sizes.select("doc_id", "n_tokens", (-F.ln((F.pmod(F.xxhash64("doc_id", F.lit("m"), F.lit(3)), F.lit(1 << 52)) + 0.5) / float(1 << 52)) / F.col("weight")).alias("key")).toPandas().sort_values(["key", "doc_id"])
    want = set(u[u.n_tokens.cumsum() <= 40_000].doc_id)
    assert {r["doc_id"] for r in got.collect()} == want and len(want) > 1000


def test_mix_of_nothing(spark):
    sizes, targets = _corpus(spark), _targets(spark, [("m", "big", 1.0, 2)])
    assert mix(sizes.where("false"), targets).count() == 0 and mix(sizes, targets.where("false")).count() == 0
    assert shares(mix(sizes.where("false"), targets), sizes.where("false"), targets).first()["tokens"] == 0


# --- tokens ----------------------------------------------------------------------------------------------------------


@pytest.mark.skipif(not Path(TOKENIZER).exists(), reason="no vocabulary file")
def test_tokens_of_odd_texts(spark):
    df = spark.createDataFrame([(1, "a", "scan 12 of FUMUMIS"), (2, None, ""), (3, "b", None), (4, "b", "é" * 30_000), (5, "b", "<|endoftext|>")], "doc_id bigint, source string, text string").withColumn("n_tokens", F.lit("x"))
    got = {r["doc_id"]: r for r in measured(df).collect()}
    assert got[1]["n_tokens"] > 3 and got[2]["n_tokens"] == got[3]["n_tokens"] == 0 and got[4]["n_tokens"] > 1000 and got[5]["n_tokens"] > 1
    assert weight([]) == 0.05 and weight(list(range(100))) == 1.0
