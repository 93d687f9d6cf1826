"""Name and contest-pair matching across sources.

Fuzzy joins never compare all pairs. Distinct names are first matched exactly; the rest
get candidates from a segment index that is complete for the asked threshold: a name of
length L that may differ by at most K edits is cut into K + 1 segments, and any partner
within K edits contains one of them, nearly in place. Segments are an ordinary equi-join
key, so Spark hashes them and can split a frequent one. Scores are computed on candidates only.
Joins of names are sort-merge joins: names are derived from a narrow key and segments from names, so the planner, which sizes
both by the key, would hand tables of any length to the driver as small ones.

Inside a scope (a card) of at most DIRECT name pairs, names meet directly and are dropped by their lengths and letter counts:
at low thresholds segments shrink to a letter or two and would hit nearly all names of the scope, many times.
From THRESHOLD on, where segments are long, distinct names are compared once for all scopes and their few links then meet
the contests inside a scope: a name that stands on many cards is not probed again on each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import names
from ..session import stage

THRESHOLD = 0.85
#: Name pairs of one scope up to which they are compared directly; larger scopes go through the segment index.
DIRECT = 1 << 22
LETTERS = "abcdefghijklmnopqrstuvwxyz"
SCORES = {"edit": names.edit_similarity, "gestalt": names.gestalt_similarity}


def _bounds(metric: str, t: float) -> tuple[str, str, str, str]:
    """SQL for: longest partner, shortest partner, edits for a pair, edits for a name and any partner."""
    if metric == "edit":
        longest, shortest = f"floor({{n}} / {t} + 1e-9)", f"ceil({{n}} * {t} - 1e-9)"
        pair = f"floor({1 - t} * greatest(la, lb) + 1e-9)"
        any_partner = f"floor({1 - t} * floor({{n}} / {t} + 1e-9) + 1e-9)"
    else:
        longest, shortest = f"floor({{n}} * {(2 - t) / t} + 1e-9)", f"ceil({{n}} * {t / (2 - t)} - 1e-9)"
        pair = f"floor({1 - t} * (la + lb) + 1e-9)"
        any_partner = f"floor({1 - t} * ({{n}} + floor({{n}} * {(2 - t) / t} + 1e-9)) + 1e-9)"
    as_int = lambda e: f"CAST({e} AS INT)"
    return as_int(longest), as_int(shortest), as_int(pair), as_int(any_partner)


def name_candidates(left: DataFrame, right: DataFrame, metric: str = "edit", threshold: float = THRESHOLD,
                    scope: list[str] | None = None) -> DataFrame:
    """Distinct (left_key, right_key) pairs that include every pair scoring at least the threshold.

    Both inputs have one column ``key`` of distinct, non-empty names, and the ``scope`` columns inside
    which a pair must lie: they are part of the index key, so the work is bounded by the scope.
    """
    by = scope or []
    longest, shortest, pair, spare = _bounds(metric, threshold)
    cut = "CAST(floor({i} * lb / m) AS INT)"
    first, after = cut.format(i="i"), cut.format(i="(i + 1)")

    index = (right.selectExpr(*by, "key AS right_key", "length(key) AS lb")
             .selectExpr(*by, "right_key", "lb", f"{spare.format(n='lb')} + 1 AS m")
             # Too short to cut: such a name is reached by length alone.
             .selectExpr(*by, "right_key", "lb", "m", "explode(IF(m > lb, array(-1), sequence(0, m - 1))) AS i")
             .selectExpr(*by, "right_key", "lb", "i", f"IF(i < 0, '', substring(right_key, {first} + 1, {after} - {first})) AS part"))

    probes = (left.selectExpr(*by, "key AS left_key", "length(key) AS la")
              .selectExpr(*by, "left_key", "la", f"explode(sequence(greatest(1, {shortest.format(n='la')}), {longest.format(n='la')})) AS lb")
              .selectExpr(*by, "left_key", "la", "lb", f"{spare.format(n='lb')} + 1 AS m", f"{pair} AS k")
              .filter("abs(la - lb) <= k")
              .selectExpr(*by, "left_key", "la", "lb", "m", "k", "explode(IF(m > lb, array(-1), sequence(0, m - 1))) AS i")
              .selectExpr("*", f"IF(i < 0, 0, {first}) AS at", f"IF(i < 0, 0, {after} - {first}) AS size")
              .selectExpr("*", "explode(IF(i < 0, array(0), sequence(-k, k))) AS shift")
              # Edits before and after the segment together stay within the pair's allowance.
              .filter("i < 0 OR (abs(shift) + abs(la - lb - shift) <= k AND at + shift >= 0 AND at + shift + size <= la)")
              .selectExpr(*by, "left_key", "lb", "i", "IF(i < 0, '', substring(left_key, at + shift + 1, size)) AS part")
              .distinct())
    return probes.join(index.hint("merge"), [*by, "lb", "i", "part"]).select(*by, "left_key", "right_key").distinct()


def letter_bits(key: Column) -> Column:
    """Two bits a letter: it occurs, it occurs twice. Two names differ in no more bits than letters were added or removed."""
    bits = F.lit(0).cast("long")
    for i, letter in enumerate(LETTERS):
        times = F.length(key) - F.length(F.replace(key, F.lit(letter), F.lit("")))
        bits = bits + F.when(times > 1, F.lit((1 << i) | (1 << (i + 26)))).when(times > 0, F.lit(1 << i)).otherwise(F.lit(0))
    return bits


def bounded_pairs(left: DataFrame, right: DataFrame, metric: str, threshold: float, scope: list[str]) -> DataFrame:
    """(scope, left_key, right_key) pairs of a scope's names that lengths and letter counts allow to score the threshold."""
    side = lambda df, name, n, bits: df.select(*scope, F.col("key").alias(name), F.length("key").alias(n), letter_bits(F.col("key")).alias(bits))
    _, _, pair, _ = _bounds(metric, threshold)
    both = side(left, "left_key", "la", "left_bits").join(side(right, "right_key", "lb", "right_bits"), scope)
    # A substitution adds one letter and removes another; each letter of difference in length is an edit without a pair.
    letters = f"2 * {pair} - abs(la - lb)" if metric == "edit" else pair
    return both.filter(f"abs(la - lb) <= {pair} AND bit_count(left_bits ^ right_bits) <= {letters}").select(*scope, "left_key", "right_key")


def scoped_names(left: DataFrame, right: DataFrame, metric: str, threshold: float, scope: list[str]) -> DataFrame:
    """(scope, left_key, right_key, score) of all pairs of a scope's distinct names that score at least the threshold."""
    count = lambda df, n: df.groupBy(*scope).agg(F.count(F.lit(1)).alias(n))
    sizes = count(left, "nl").join(count(right, "nr"), scope)
    large = sizes.filter(F.col("nl") * F.col("nr") > DIRECT).select(*scope)
    score = SCORES[metric](F.col("left_key"), F.col("right_key"))
    held = lambda df, how: df.join(large, scope, how)
    direct = bounded_pairs(held(left, "left_anti"), held(right, "left_anti"), metric, threshold, scope)
    through_index = name_candidates(held(left, "left_semi"), held(right, "left_semi"), metric, threshold, scope)
    return direct.unionByName(through_index).withColumn("score", score).filter(F.col("score") >= threshold)


def similar_names(left: DataFrame, right: DataFrame, metric: str = "edit", threshold: float = THRESHOLD) -> DataFrame:
    """(left_key, right_key, score) for all pairs of distinct names scoring at least the threshold."""
    pairs = name_candidates(left, right, metric, threshold)
    return pairs.withColumn("score", SCORES[metric](F.col("left_key"), F.col("right_key"))).filter(F.col("score") >= threshold)


def fuzzy_best_match(wanted: DataFrame, known: DataFrame, key=names.basic_key, metric: str = "edit",
                     threshold: float = THRESHOLD) -> DataFrame:
    """Best known name for every distinct wanted name: exact keys first, then the highest score.

    Both inputs have one column ``name``; unmatched names are kept with null.
    """
    # Distinct names are read several times below, and may be few among very many rows.
    left = stage(wanted.select("name").distinct().withColumn("left_key", key(F.col("name"))), "wanted_names")
    right = stage(known.select(F.col("name").alias("match")).withColumn("right_key", key(F.col("match"))).groupBy("right_key").agg(
        F.min("match").alias("match")), "known_names").hint("merge")
    keys = left.select(F.col("left_key").alias("key")).distinct()
    exact = keys.join(right, F.col("key") == F.col("right_key")).select("key", "match", F.lit(1.0).alias("score"))
    rest = keys.join(right, F.col("key") == F.col("right_key"), "left_anti").filter("key <> ''")
    close = similar_names(rest, right.filter("right_key <> ''").select(F.col("right_key").alias("key")), metric, threshold)
    best = close.join(right, "right_key").groupBy(F.col("left_key").alias("key")).agg(
        F.max(F.struct("score", (-F.length("match")).alias("l"))).alias("_top"),
        F.min_by("match", F.struct(-F.col("score"), F.col("match"))).alias("match"))
    found = exact.unionByName(best.select("key", "match", F.col("_top.score").alias("score")))
    return left.join(found.hint("merge"), left["left_key"] == found["key"], "left").select("name", "match", "score")


def canonicalize_names(contests: DataFrame, known: DataFrame, **how) -> DataFrame:
    """Both names of each contest replaced by their best known names, kept when there is none."""
    everyone = contests.select(F.explode(F.array("name_1", "name_2")).alias("name"))
    best = stage(fuzzy_best_match(everyone, known, **how), "best_names")  # read for either name
    out = contests
    for n in ("name_1", "name_2"):
        out = out.join(best.select(F.col("name").alias(n), F.col("match").alias(n + "_known")), n, "left")
    return out.withColumns({n + "_canonical": F.coalesce(n + "_known", n) for n in ("name_1", "name_2")})


def match_counts(canonical: DataFrame) -> DataFrame:
    found = F.col("name_1_known").isNotNull().cast("long") + F.col("name_2_known").isNotNull().cast("long")
    return canonical.agg(F.sum(found).alias("matched"), F.sum(2 - found).alias("unmatched"))


def _pair_candidates(left: DataFrame, right: DataFrame, scope: list[str], metric: str, threshold: float) -> DataFrame:
    """Contest pairs inside a scope that share at least one similar name, with the names of both; a pair may come twice.

    A pair whose two scores average the threshold has one member at or above it, so this is complete.
    """
    members = lambda df, s, k: df.select(*scope, k, f"{s}1", f"{s}2", F.explode(F.array_distinct(F.array(f"{s}1", f"{s}2"))).alias(f"{s}_key"))
    lm, rm = members(left, "l", "l_id"), members(right, "r", "r_id")
    same = lm.withColumnRenamed("l_key", "r_key")
    if threshold >= THRESHOLD:
        distinct = lambda df, k: stage(df.select(F.col(k).alias("key")).filter("key <> ''").distinct(), "names")
        close, by = similar_names(distinct(lm, "l_key"), distinct(rm, "r_key"), metric, threshold), ["l_key"]
    else:
        distinct = lambda df, k: df.select(*scope, F.col(k).alias("key")).filter("key <> ''").distinct()
        close, by = scoped_names(distinct(lm, "l_key"), distinct(rm, "r_key"), metric, threshold, scope), [*scope, "l_key"]
    close = stage(close.filter("left_key <> right_key").drop("score").withColumnsRenamed({"left_key": "l_key", "right_key": "r_key"}), "close_names")
    return same.unionByName(lm.join(close, by).drop("l_key")).join(rm, [*scope, "r_key"]).drop(*scope, "r_key")


def _with_equal_pair(left: DataFrame, right: DataFrame, scope: list[str], found: Column) -> DataFrame:
    """``left`` with the fields of ``found`` from the right contests of the same unordered pair, null where there are none.

    Written: only contests without such a pair keep their names for the search that follows.
    """
    pair = lambda df, a, b: df.withColumn("_pair", names.pair_key(F.col(a), F.col(b)))
    # Nearly every pair is its own group, so rows are dealt before they are grouped.
    keyed = pair(right, "r1", "r2").repartition(*scope, "_pair").groupBy(*scope, "_pair").agg(found.alias("_r"))
    met = pair(left, "l1", "l2").join(keyed, [*scope, "_pair"], "left")
    alone = lambda c: F.when(F.col("_r").isNull(), F.col(c)).alias(c)
    flipped = F.when(F.col("_r").isNotNull(), F.col("l1") != F.col("_r.r1")).alias("flipped")
    return stage(met.select(*scope, "l_id", F.col("_r.r_id").alias("r_id"), flipped, alone("l1"), alone("l2")), "equal_pairs")


def match_contest_pair(left: DataFrame, right: DataFrame, scope: list[str], metric: str = "edit",
                       threshold: float = THRESHOLD) -> DataFrame:
    """Best right contest for each left one: the better of straight and flipped name scores, at least 2 x threshold.

    ``left`` has l_id, l1, l2; ``right`` has r_id, r1, r2 (comparison keys); both carry the
    scope columns, inside which a match must lie. Equal pairs are settled by an equi-join first.
    """
    score = SCORES[metric]
    met = _with_equal_pair(left, right, scope, F.min(F.struct("r_id", "r1")))
    exact = met.filter("r_id IS NOT NULL").select("l_id", "r_id", F.lit(2.0).alias("score"), "flipped")
    rest = met.filter("r_id IS NULL").select(*scope, "l_id", "l1", "l2")
    scored = _pair_candidates(rest, right, scope, metric, threshold).withColumns({
        "straight": score(F.col("l1"), F.col("r1")) + score(F.col("l2"), F.col("r2")),
        "crossed": score(F.col("l1"), F.col("r2")) + score(F.col("l2"), F.col("r1"))})
    good = scored.withColumn("score", F.greatest("straight", "crossed")).filter(F.col("score") >= 2 * threshold)
    best = good.groupBy("l_id").agg(F.min_by(
        F.struct("r_id", "score", (F.col("crossed") > F.col("straight")).alias("flipped")), F.struct(-F.col("score"), F.col("r_id"))).alias("b"))
    return exact.unionByName(best.select("l_id", "b.*"))


def match_both_members(left: DataFrame, right: DataFrame, scope: list[str], metric: str = "edit",
                       threshold: float = THRESHOLD) -> DataFrame:
    """First right contest with the same pair, else the first in which each left name has a partner above the threshold."""
    score = SCORES[metric]
    met = _with_equal_pair(left, right, scope, F.struct(F.min("r_id").alias("r_id"), F.lit(None).cast("string").alias("r1")))
    exact = met.filter("r_id IS NOT NULL").select("l_id", "r_id", F.lit("exact").alias("kind"))
    rest = met.filter("r_id IS NULL").select(*scope, "l_id", "l1", "l2")
    has = lambda l: (score(F.col(l), F.col("r1")) > threshold) | (score(F.col(l), F.col("r2")) > threshold)
    near = (_pair_candidates(rest, right, scope, metric, threshold).filter(has("l1") & has("l2"))
            .groupBy("l_id").agg(F.min("r_id").alias("r_id")))
    return exact.unionByName(near.withColumn("kind", F.lit("both members")))


def match_last_names(left: DataFrame, right: DataFrame, scope: list[str]) -> DataFrame:
    """Equal unordered pairs of last names; the first right contest wins."""
    key = lambda a, b: names.pair_key(names.last_token(F.col(a)), names.last_token(F.col(b)))
    keyed = right.withColumn("_k", key("r1", "r2")).groupBy(*scope, "_k").agg(F.min("r_id").alias("r_id"))
    return left.withColumn("_k", key("l1", "l2")).join(keyed, [*scope, "_k"]).select("l_id", "r_id")


def pair_key_join(left: DataFrame, right: DataFrame, scope: list[str]) -> DataFrame:
    """Canonical unordered pair equality; the last right contest wins."""
    key = lambda a, b: names.pair_key(F.col(a), F.col(b))
    # Nearly every pair is its own group, so rows are dealt before they are grouped.
    keyed = right.select(*scope, "r_id", key("r1", "r2").alias("_k")).repartition(*scope, "_k").groupBy(*scope, "_k").agg(F.max("r_id").alias("r_id"))
    return left.withColumn("_k", key("l1", "l2")).join(keyed, [*scope, "_k"], "left").select("l_id", "r_id")


def name_join_ci(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Exact match, else equal without case, else unmatched. One ``name`` column each."""
    w = wanted.select("name").distinct()
    k = known.select(F.col("name").alias("match")).distinct()
    folded = k.groupBy(F.lower("match").alias("_low")).agg(F.min("match").alias("_ci"))
    return (w.join(k, w["name"] == k["match"], "left").join(folded, F.lower("name") == F.col("_low"), "left")
            .select("name", F.coalesce("match", "_ci").alias("match"),
                    F.when(F.col("match").isNotNull(), "exact").when(F.col("_ci").isNotNull(), "case").otherwise("none").alias("kind")))


def known_competitors(contests: DataFrame, columns: list[str]) -> DataFrame:
    return contests.select(F.explode(F.array(*columns)).alias("name")).filter("name IS NOT NULL").distinct()


def date_band_join(left: DataFrame, right: DataFrame, days: int = 2) -> DataFrame:
    """First right event within ``days`` of each left event (both: event, day).

    Right dates are entered in every bin their band touches, so the range condition becomes
    an equi-join on the bin plus a filter; the winner is an aggregate per left event.
    """
    width = days + 1
    day = lambda c: F.unix_date(F.col(c))
    l = left.select(F.col("event").alias("l_event"), F.col("day").alias("l_day")).withColumn("_bin", F.floor(day("l_day") / width))
    spans = F.sequence(F.floor((day("r_day") - days) / width), F.floor((day("r_day") + days) / width))
    r = right.select(F.col("event").alias("r_event"), F.col("day").alias("r_day")).withColumn("_bin", F.explode(spans))
    near = l.join(r, "_bin").filter(F.abs(F.date_diff("l_day", "r_day")) <= days)
    return near.groupBy("l_event", "l_day").agg(F.min(F.struct("r_day", "r_event")).alias("r")).select("l_event", "l_day", "r.*")


def match_gaps(left: DataFrame, right: DataFrame, matched: DataFrame, scope: list[str], metric: str = "edit",
               floor: float = 0.6) -> DataFrame:
    """Contests without partner on either side; left ones with the closest contest of their scope.

    ``floor`` bounds the search: a contest counts as close when one of its names scores that much. It is
    below the match threshold and stands in the output; without such a contest ``closest`` is null.
    """
    score = SCORES[metric]
    lone = left.join(matched, "l_id", "left_anti")
    spare = right.join(matched, "r_id", "left_anti").select(F.lit("right").alias("side"), F.col("r_id").alias("contest_id"))
    near = _pair_candidates(lone, right, scope, metric, floor)
    total = F.greatest(score(F.col("l1"), F.col("r1")) + score(F.col("l2"), F.col("r2")), score(F.col("l1"), F.col("r2")) + score(F.col("l2"), F.col("r1")))
    best = near.withColumn("score", total).groupBy("l_id").agg(F.min_by(F.struct("r_id", "score"), F.struct(-F.col("score"), F.col("r_id"))).alias("b"))
    gaps = lone.select("l_id").join(best, "l_id", "left").select(
        F.lit("left").alias("side"), F.col("l_id").alias("contest_id"), F.col("b.r_id").alias("closest"), F.col("b.score").alias("score"))
    out = gaps.unionByName(spare.withColumns({"closest": F.lit(None).cast("long"), "score": F.lit(None).cast("double")}))
    return out.withColumn("floor", F.lit(floor))


def match_gap_reason(left: DataFrame, right: DataFrame, matched: DataFrame, scope: list[str], metric: str = "edit") -> DataFrame:
    """Why a left contest has no partner: a respelled name beside an equal opponent, another competitor, or no data."""
    score = SCORES[metric]
    lone = left.join(matched, "l_id", "left_anti")
    shared = []
    for same, other in (("1", "2"), ("2", "1")):
        r = right.select(*scope, "r_id", F.col("r" + same).alias("l" + same), F.col("r" + other).alias("_name"))
        hit = lone.join(r, [*scope, "l" + same]).filter(F.col("_name") != F.col("l" + other))
        shared.append(hit.select("l_id", "r_id", score(F.col("l" + other), F.col("_name")).alias("score")))
    best = shared[0].unionByName(shared[1]).groupBy("l_id").agg(F.max("score").alias("score"))
    reason = (F.when(F.col("score") > 0.6, "transliteration").when(F.col("score").isNotNull(), "different competitor").otherwise("no data"))
    return lone.select("l_id").join(best, "l_id", "left").select("l_id", "score", reason.alias("reason"))
