"""Mixing sources to target shares with capped repeats (problem 4).

Entropy balancing: among all rates r >= 0 of the records, those closest to "once each" in relative
entropy that give every source its share of the total size have the form r = exp(l_s x), with x the
record's size relative to the mean of its source and one multiplier l_s for each source; with at most c_s uses of a
record, r = min(c_s, exp(l_s x)).  The multipliers solve a convex dual, by safeguarded Newton steps whose
gradient and Hessian are sums over a compact table of (source, size) counts; each step
brings a few numbers per source to the driver.  Rates are rounded to copies by a hash of the
record's key, and the rounding offset of each source is tuned so that its size is met.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from corpusloom.plans.staging import stage

#: Newton steps, and the relative miss at which they end.
STEPS, TOLERANCE = 60, 1e-7
_HASH = float(1 << 52)
#: The source of ids that have none.
UNKNOWN = "unknown"


def feasible(sizes: dict, weights: dict, caps: dict) -> tuple[float, dict]:
    """The largest total size at which every source that has records can reach its share, and the size of each.

    Shares of sources without records (or of no size) can't be reached; the others are scaled to one.
    """
    present = {s: w for s, w in weights.items() if w and w > 0 and sizes.get(s, 0) > 0}
    scale = sum(present.values())
    if not scale:
        return 0.0, {}
    total = min(caps[s] * sizes[s] * scale / w for s, w in present.items())
    return total, {s: total * w / scale for s, w in present.items()}


def _rate(multiplier: Column, cap: Column, relative: Column) -> Column:
    return F.least(cap.cast("double"), F.exp(F.least(F.greatest(multiplier * relative, F.lit(-60.0)), F.lit(60.0))))


def _settings(spark, values: dict) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(s, *map(float, v)) for s, v in values.items()], "source string, multiplier double, cap double, mean double"))


def balance(df: DataFrame, key: str, source: str, size: str, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Copies of each record and the shares reached, for ``targets`` of (source, weight, max_repeat).

    Returns ``(key, source, rate, copies)`` for the records of sources with a target, and one row for each source
    of either side: target share, records and size there are, records used, copies, size reached, its share of
    all, and the most copies of a record.  Rows with a null key or source are left out; rows with the same key count
    once (the one of the largest size, then the least source); a null size is 0; sources without a target are not used; null
    weights and repeats count as 0 and 1.  The targets are a small table, one row a source; of
    repeated sources the largest weight holds.
    """
    spark = df.sparkSession
    goals = {
        r["source"]: (r["w"] or 0.0, max(int(r["c"] or 1), 0))
        for r in targets.where("source IS NOT NULL").groupBy("source").agg(F.max("weight").alias("w"), F.max("max_repeat").alias("c")).collect()
    }
    records = stage(
        df.select(F.col(key).alias("key"), F.col(source).alias("source"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"))
        .where("key IS NOT NULL AND source IS NOT NULL")
        .groupBy("key").agg(F.max_by("source", F.struct("size", "source")).alias("source"), F.max("size").alias("size"))
    )
    counts = stage(records.groupBy("source", "size").count())
    there = {r["source"]: (r["n"], r["size"]) for r in counts.groupBy("source").agg(F.sum("count").alias("n"), F.sum(F.col("size") * F.col("count")).alias("size")).collect()}
    sizes = {s: float(v[1]) for s, v in there.items()}
    total, wanted = feasible(sizes, {s: g[0] for s, g in goals.items()}, {s: g[1] for s, g in goals.items()})
    mean = {s: sizes[s] / there[s][0] for s in wanted}
    held = counts.where(F.col("source").isin(list(wanted)) if wanted else F.lit(False))

    def sums(multipliers: dict) -> dict:
        """Size reached and its derivative by the multiplier, for each source."""
        if not multipliers:
            return {}
        at = held.join(_settings(spark, {s: (m, goals[s][1], mean[s]) for s, m in multipliers.items()}), "source")
        relative = F.col("size") / F.col("mean")
        rate = _rate(F.col("multiplier"), F.col("cap"), relative)
        moved = F.when(rate < F.col("cap"), rate * relative).otherwise(0.0)
        rows = at.groupBy("source").agg(F.sum(F.col("count") * F.col("size") * rate).alias("f"), F.sum(F.col("count") * F.col("size") * moved).alias("g")).collect()
        return {r["source"]: (r["f"], r["g"]) for r in rows}

    # start: the mean rate of the source; sources that need every record at its cap are done
    multipliers, low, high, done = {}, {}, {}, set()
    for s in wanted:
        ratio = wanted[s] / sizes[s]
        multipliers[s] = math.log(ratio)
        low[s], high[s] = -60.0, 60.0
        if ratio >= goals[s][1] * (1 - 1e-12):
            multipliers[s] = 60.0
            done.add(s)
    for _ in range(STEPS):
        open_ = {s: m for s, m in multipliers.items() if s not in done}
        if not open_:
            break
        for s, (f, g) in sums(open_).items():
            miss = f - wanted[s]
            if abs(miss) <= TOLERANCE * wanted[s]:
                done.add(s)
                continue
            if miss > 0:
                high[s] = multipliers[s]
            else:
                low[s] = multipliers[s]
            step = multipliers[s] - miss / g if g > 0 else math.nan
            inside = low[s] < step < high[s]
            multipliers[s] = step if inside else (low[s] + high[s]) / 2
    uniform = F.shiftrightunsigned(F.xxhash64("key", F.lit("mix")), 12).cast("double") / _HASH
    rated = records.join(_settings(spark, {s: (m, goals[s][1], mean[s]) for s, m in multipliers.items()}), "source").withColumn(
        "rate", F.when(F.col("multiplier") >= 60.0, F.col("cap")).otherwise(_rate(F.col("multiplier"), F.col("cap"), F.col("size") / F.col("mean")))
    )
    # a record is used floor(rate) times and once more if its fraction exceeds its hash; the fractions of a
    # source are shifted a little so that the rounded size meets the wanted one
    rated = rated.withColumn("excess", F.col("rate") - F.floor("rate") - uniform)
    shifts = _shifts(rated, wanted)
    shift = F.coalesce(F.create_map(*[F.lit(x) for p in shifts.items() for x in p])[F.col("source")], F.lit(0.0)) if shifts else F.lit(0.0)
    more = (F.col("excess") + shift > 0) & (F.col("rate") < F.col("cap"))
    copies = rated.select("key", "source", "size", "rate", (F.floor("rate") + more.cast("int")).cast("int").alias("copies"))
    used = {
        r["source"]: r
        for r in copies.groupBy("source").agg(
            F.sum((F.col("copies") > 0).cast("long")).alias("used"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("size")).alias("size"), F.max("copies").alias("most")
        ).collect()
    }
    reached = sum(r["size"] for r in used.values()) or 1
    report = [
        (
            s, float(goals[s][0]) if s in goals else 0.0, goals[s][1] if s in goals else 0, there.get(s, (0, 0))[0], there.get(s, (0, 0))[1],
            *((used[s]["used"], used[s]["copies"], used[s]["size"], used[s]["size"] / reached, used[s]["most"]) if s in used else (0, 0, 0, 0.0, 0)),
        )
        for s in sorted({*goals, *there})
    ]
    shares = spark.createDataFrame(
        report,
        "source string, target_share double, max_repeat int, records long, size long, records_used long, copies long, size_reached long, share_reached double, most_copies int",
    )
    return copies.select(F.col("key").alias(key), "source", "rate", "copies"), shares


def _shifts(rated: DataFrame, wanted: dict) -> dict:
    """For each source the offset at which rounding meets the wanted size, by bisection over sums."""
    if not wanted:
        return {}
    fine = rated.where("rate < cap").groupBy("source", F.floor(F.col("excess") * 4096).alias("cell")).agg(F.sum("size").alias("size"))
    base = {r["source"]: r["b"] or 0 for r in rated.groupBy("source").agg(F.sum(F.floor("rate") * F.col("size")).alias("b")).collect()}
    cells: dict[str, list] = {}
    for r in fine.collect():  # at most 8192 cells a source
        cells.setdefault(r["source"], []).append((r["cell"], r["size"]))
    shifts = {}
    for s, found in cells.items():
        found.sort(reverse=True)
        gathered, best = float(base.get(s, 0)), (abs(base.get(s, 0) - wanted.get(s, 0)), 1.0)
        for cell, size in found:
            gathered += size
            if abs(gathered - wanted[s]) < best[0]:
                best = (abs(gathered - wanted[s]), cell / 4096)
        shifts[s] = -best[1]
    return shifts


# -- the two mixes ---------------------------------------------------------------------------------


def pair_sources(merged: DataFrame, train: DataFrame) -> DataFrame:
    """``(key, source, size)`` of the training pairs: the source is the prefix of the id in ``query``.

    Ids are trimmed and lower-cased, with any of ``_-:/ `` between their parts; an id without a source gets the one
    of the sample with its number.  Ids of no known form, and ids without a source whose sample is not there, are of
    the source ``unknown``, which has no target, so they are not used but reported.  Null and blank ids give no row.
    """
    plain = F.regexp_replace(F.lower(F.trim("query")), "[\\s_:/-]+", "_")
    every = merged.select(
        plain.alias("id"), F.regexp_extract(plain, "^(?:([a-z0-9]+)_)?query_(.+)$", 1).alias("prefix"), F.regexp_extract(plain, "^(?:([a-z0-9]+)_)?query_(.+)$", 2).alias("number")
    ).where("id <> ''").distinct()
    parts = every.where("number <> ''").select("prefix", "number").distinct()
    samples = train.select(F.col("sample_id").cast("string").alias("number"), F.lower(F.trim("source")).alias("of")).where("number IS NOT NULL").dropDuplicates(["number"])
    bare = parts.where("prefix = ''").select("number").join(samples, "number", "left").select(F.coalesce("of", F.lit(UNKNOWN)).alias("prefix"), "number")
    whole = parts.where("prefix <> ''").union(bare).distinct().select(F.concat("prefix", F.lit("_query_"), "number").alias("key"), F.col("prefix").alias("source"))
    odd = every.where("number = ''").select(F.col("id").alias("key"), F.lit(UNKNOWN).alias("source"))
    return whole.union(odd).withColumn("size", F.lit(1))


def _mixes(spark, folder: str):
    from corpusloom.session import table

    targets = table(spark, folder, "mix_targets")
    pairs = pair_sources(table(spark, folder, "merged_train_data_ids"), table(spark, folder, "train_data"))
    corpus = table(spark, folder, "temp_legal_corpus_withstpvl").select(F.col("oid").cast("string").alias("key"), F.trim("dataset").alias("source"), F.length("text").alias("size"))
    for name, rows in (("pairs", pairs), ("corpus", corpus)):
        yield name, *balance(rows, "key", "source", "size", targets.where(F.lower(F.trim("mix")) == name))


def p4_copies(spark, folder: str) -> DataFrame:
    """How often each record of either mix is used."""
    parts = [copies.select(F.lit(name).alias("mix"), "key", "source", F.round("rate", 9).alias("rate"), "copies") for name, copies, _ in _mixes(spark, folder)]
    return parts[0].union(parts[1])


def p4_shares(spark, folder: str) -> DataFrame:
    parts = [shares.select(F.lit(name).alias("mix"), "*") for name, _, shares in _mixes(spark, folder)]
    return parts[0].union(parts[1])
