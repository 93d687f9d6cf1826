"""The engine's tables as derived from the driver's parquet files.

Contests come from orders with at least two suppliers: every supplier meets the next one in
order of first line, so all lines of such orders count. The larger revenue wins, and the remaining
fields follow from line sums.
The text fields have the form a scraped record has, so that parsing is part of every query.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import spec
from ..functions import market as odds_math, names
from ..session import stage
from ..operators import career, history, imputation, opponents, packing, physical, ratings, reshape, serving

DIVISION_OF = {"1-URGENT": "Lightweight", "2-HIGH": "Light Heavyweight", "3-MEDIUM": "Heavyweight",
               "4-NOT SPECIFIED": "Welterweight", "5-LOW": "Middleweight"}
CUTOFF = "2000-01-01"
METHODS = ["No Contest", "Draw", "KO/TKO", "Submission", "Decision - Unanimous", "Decision - Split", "Decision - Majority"]

_whole_numbers = lambda bits: [packing.integer(n, b) for n, b in bits.items()]
#: How lines travel to their order. Prices in cents have no bound, so large ones go whole.
LINE = [[packing.text("flag", ["A", "N", "R"]), *_whole_numbers({"l_linenumber": 4, "landed": 7, "disc": 7, "tax": 6, "cents": 29})]]
_EVENT = packing.derived("event_name", lambda known: event_name(known["contest_date"]))
#: How a side travels to its competitor: first the word that medians and most windows read, then the other numbers of its contest.
SIDE = [[packing.day("contest_date"), packing.text("division", list(DIVISION_OF.values())), packing.text("method", METHODS), packing.flag("detailed"),
         *_whole_numbers({"won": 1, "sig_landed": 9, "td_landed": 3, "sig_absorbed": 9, "duration_s": 11})],
        _whole_numbers({"kd": 2, "sub_attempts": 2, "control_s": 10, "sig_attempted": 10, "td_attempted": 4}),
        _whole_numbers({"opp_sig_attempted": 10, "tot_landed": 10, "tot_attempted": 10}),
        [packing.integer("opp_id", 30), *_whole_numbers({"round": 3}), _EVENT]]


def _rolling_codes(n: int, *measures: str) -> list[packing.Code]:
    """Means of the last rows are quotients by as many rows as the window has, or fewer."""
    parts, top = {3: 6, 5: 60, 10: 2520}[n], {"win_rate": 1, "finish_rate": 1, "sig_landed": 500, "sig_absorbed": 500, "td_landed": 6, "duration": 900}
    return [packing.fraction(f"{m}_last_{n}", parts, (top[m] * parts).bit_length()) for m in measures]


#: How a side with its features travels to its contest. Words hold together what queries read together; the counts have bits for
#: careers of some thousand contests.
PAIR = [[packing.text("division", list(DIVISION_OF.values())), packing.text("method", METHODS), packing.day("contest_date"),
         *_whole_numbers({"side_id": 20, "won": 1, "n_prior": 13})],
        [*_whole_numbers({"wins_prior": 13}), packing.share("sub_rate", "wins_prior", 13), *_rolling_codes(5, "sig_landed", "td_landed")],
        [*_whole_numbers({"win_streak": 6, "loss_streak": 6}), *_rolling_codes(3, "win_rate"), packing.share("win_rate", "n_prior", 13),
         *_rolling_codes(5, "sig_absorbed"), *_whole_numbers({"days_since_last": 12})],
        [*[packing.share(f"{k}_rate", "wins_prior", 13) for k in ("ko", "dec", "finish")], *_rolling_codes(3, "finish_rate"), *_rolling_codes(5, "win_rate")],
        [*_rolling_codes(5, "finish_rate", "duration"), *_rolling_codes(3, "sig_landed", "sig_absorbed", "td_landed")],
        [*_rolling_codes(3, "duration"), *_rolling_codes(10, "win_rate", "finish_rate", "td_landed"), packing.flag("detailed")],
        [*_rolling_codes(10, "sig_landed", "sig_absorbed"), *_whole_numbers({"losses_prior": 13})],
        [*_rolling_codes(10, "duration"), *_whole_numbers({"division_prior": 13, "contests_last_365d": 10, "is_debut": 1}),
         packing.derived("completeness", lambda known: imputation.completeness(known["n_prior"]))],
        [_EVENT, *_whole_numbers({"round": 3, "duration_s": 11})]]

#: How a side with its own skills travels to its contest, where both sides swap them, and from there to its competitor again.
#: Skills are multiples of 2 ** -30.
_skill_code = lambda name: packing.fraction(name, opponents.UNITS, 31)
SWAP = [[packing.day("contest_date"), *_whole_numbers({"side_id": 20, "won": 1, "n_before": 13})],
        [packing.text("division", list(DIVISION_OF.values())), packing.text("method", METHODS), packing.flag("detailed"),
         *_whole_numbers({"sig_landed": 9, "td_landed": 3, "sig_absorbed": 9, "duration_s": 11, "round": 3})],
        SIDE[1], SIDE[2], [packing.integer("opp_id", 20), _EVENT],
        [_skill_code("own_quality"), packing.integer("own_earlier", 13)], *[[_skill_code(f"own_{s}")] for s in ("striking", "grappling", "durability")]]
ADJUST = [[packing.day("contest_date"), *_whole_numbers({"won": 1, "sig_landed": 9, "td_landed": 3, "control_s": 10, "kd": 2})],
          *[[_skill_code(f"opp_{s}")] for s in spec.SKILLS]]


def person_name(key: Column) -> Column:
    """A pronounceable two-word name made from the key's digest."""
    letters = F.translate(F.substring(F.md5(key.cast("string")), 1, 16), "0123456789abcdef", "aeioulnrstmdkbgv")
    return F.initcap(F.overlay(letters, F.lit(" "), 7, 2))


def spread(key: Column) -> Column:
    """A deterministic number in (0, 1) used wherever a model score is needed without a model."""
    return (F.pmod(key * 7919, F.lit(1000)) + F.lit(0.5)) / F.lit(1000.0)


def event_name(day: Column) -> Column:
    return F.concat(F.lit("Card "), day.cast("string"), F.when(F.dayofmonth(day) == 1, F.lit(" Title Night")).otherwise(F.lit("")))


def pair_id(order: Column, place: Column) -> Column:
    """Number of a pair of neighbours within an order; unlike for up to 101 pairs an order."""
    return order * 101 + place - 1


#: Contests beyond which tables of many columns or texts are read through by every query instead of being written for all.
LARGE = 1_000_000

_open: dict[tuple, "Tables"] = {}


def tables(spark: SparkSession, folder: str) -> "Tables":
    """The staged tables of this application and folder, as long as the folder lists the same files."""
    files = [f for n in ("lineitem", "orders", "supplier") for f in spark.read.parquet(f"{folder}/{n}.parquet").inputFiles()]
    key = (spark.sparkContext.applicationId, folder, *sorted(files))
    if key not in _open:
        _open[key] = Tables(spark, folder)
    return _open[key]


class wide:
    """A table of many columns. The first query over it reads through its plan, so Spark drops the columns which that query
    does not use before every shuffle; from the second query on it is written, unless it is ``large``: there a query's own
    columns cost less than all of them written. Other tables take it by ``plan_of``."""

    def __init__(self, build):
        self.build, self.name = build, build.__name__

    def __get__(self, t: "Tables", _owner=None):
        first = self.name not in t.asked
        t.asked.add(self.name)
        plan = t.plan_of(self.name)
        if t.staged is not True or first or self.name in t.__dict__ or t.large:
            return plan
        t.__dict__[self.name] = stage(plan, self.name)
        return t.__dict__[self.name]


class Tables:
    """Lazily built tables. Staged ones are written once and read by all later queries: every shared table by default
    (wide ones from their second query on), the named ones, or none."""

    def __init__(self, spark: SparkSession, folder: str, staged: bool | tuple[str, ...] = True):
        self.spark, self.folder, self.staged = spark, folder, staged
        self.asked: set[str] = set()
        self.plans: dict[str, DataFrame] = {}

    @classmethod
    def sharing(cls, other: "Tables", names: tuple[str, ...]) -> "Tables":
        """Fresh tables over the named staged ones of ``other``; everything else is built anew."""
        out = cls(other.spark, other.folder, staged=names)
        out.__dict__.update({n: other.__dict__[n] for n in names})
        return out

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        wanted = self.staged if isinstance(self.staged, bool) else name in self.staged
        return stage(df, name) if wanted else df

    def _share(self, df: DataFrame, name: str) -> DataFrame:
        """A table of texts that follow from the facts: written for later queries only where it is not ``large``."""
        return df if self.staged is True and self.large else self._keep(df, name)

    @cached_property
    def large(self) -> bool:
        return self.staged is True and self._facts.count() > LARGE

    def plan_of(self, name: str) -> DataFrame:
        """A wide table as another table reads it: written only if it is already, or named in ``staged``."""
        if name not in self.__dict__:
            if name not in self.plans:
                self.plans[name] = type(self).__dict__[name].build(self)
            if isinstance(self.staged, bool) or name not in self.staged:
                return self.plans[name]
            self.__dict__[name] = stage(self.plans[name], name)
        return self.__dict__[name]

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def _pairs(self) -> DataFrame:
        # Dealt by order first: nearly every group is one line, so combining before the shuffle would only fill memory.
        whole = lambda c: F.round(c).cast("long")
        c = F.col
        lines = self.read("lineitem").select(
            "l_orderkey", "l_suppkey", "l_linenumber", whole(c("l_quantity")).alias("landed"), whole(c("l_discount") * 100).alias("disc"),
            whole(c("l_tax") * 100).alias("tax"), whole(c("l_extendedprice") * 100).alias("cents"), c("l_returnflag").alias("flag"))
        per_side = packing.deal(lines, "l_orderkey", LINE).groupBy("l_orderkey", "l_suppkey").agg(
            F.min("l_linenumber").alias("first_line"), *[F.sum(n).alias(n) for n in ("landed", "disc", "tax")],
            F.sum("l_linenumber").alias("lines"), F.sum("cents").alias("cents"), F.min("flag").alias("flag"))
        fields = ("landed", "disc", "tax", "lines", "cents")
        listed = Window.partitionBy("l_orderkey").orderBy("first_line", "l_suppkey")
        nxt = F.lead(F.struct("l_suppkey", *fields)).over(listed)
        met = per_side.withColumns({"_next": nxt, "_place": F.row_number().over(listed)}).filter("_next IS NOT NULL")
        return met.select(
            pair_id(c("l_orderkey"), c("_place")).alias("contest_id"), "l_orderkey", c("l_suppkey").alias("red_id"),
            c("_next.l_suppkey").alias("blue_id"), "flag", *[c(f).alias(f"red_{f}") for f in fields],
            *[c(f"_next.{f}").alias(f"blue_{f}") for f in fields])

    @cached_property
    def _facts(self) -> DataFrame:
        """Keys and numbers of all contests. They are written; the texts of a record are made of them wherever they are read."""
        orders = self.read("orders").select(
            F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("contest_date"),
            F.array_position(F.array(*[F.lit(code) for code in DIVISION_OF]), F.col("o_orderpriority")).cast("smallint").alias("division_no"))
        return self._keep(self._pairs.join(orders, "l_orderkey").drop("l_orderkey"), "facts")

    @cached_property
    def contests(self) -> DataFrame:
        c = F.col
        division = F.get(F.array(*[F.lit(name) for name in DIVISION_OF.values()]), c("division_no").cast("int") - 1)
        draw, void = F.pmod("contest_id", F.lit(41)) == 7, F.pmod("contest_id", F.lit(53)) == 9
        by_lines = F.when(c("red_cents") >= c("blue_cents"), c("red_id")).otherwise(c("blue_id"))
        verdict = F.element_at(F.array(*[F.lit(v) for v in ("Unanimous", "Split", "Majority")]), (c("red_cents") % 3 + 1).cast("int"))
        method = (F.when(void, F.lit("No Contest")).when(draw, F.lit("Draw")).when(c("flag") == "A", F.lit("KO/TKO"))
                  .when(c("flag") == "R", F.lit("Submission")).otherwise(F.concat(F.lit("Decision - "), verdict)))
        clock = lambda s: F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))
        known = c("contest_date") >= F.lit("1995-07-01").cast("date")
        of = lambda a, b: F.when(known, F.concat_ws(" of ", a.cast("string"), b.cast("string")))
        per_side = []
        for s in ("red", "blue"):
            landed, td = c(f"{s}_landed"), c(f"{s}_tax") % 6
            per_side += [
                of(landed, landed + c(f"{s}_disc")).alias(f"{s}_sig_str"),
                of(landed + c(f"{s}_lines"), landed + c(f"{s}_disc") + c(f"{s}_lines")).alias(f"{s}_total_str"),
                of(td, td + c(f"{s}_lines") % 4).alias(f"{s}_td"),
                F.when(known, (c(f"{s}_lines") % 3).cast("string")).alias(f"{s}_kd"),
                F.when(known, (F.floor(c(f"{s}_cents") / 7) % 3).cast("string")).alias(f"{s}_sub_att"),
                F.when(known, clock(c(f"{s}_cents") % 600)).alias(f"{s}_ctrl")]
        made = self._facts.select(
            "contest_id", "contest_date", division.alias("division"), "red_id", "blue_id",
            event_name(c("contest_date")).alias("event_name"),
            F.when(void, F.lit("No Contest")).when(draw, F.lit("Draw")).otherwise(by_lines.cast("string")).alias("winner"),
            method.alias("method"),
            F.when(F.pmod("contest_id", F.lit(29)) != 0, (F.pmod("contest_id", F.lit(3)) + 1).cast("string")).alias("round_text"),
            clock(c("blue_cents") % 300).alias("time_text"), (c("red_landed") - c("blue_landed")).alias("margin"), *per_side)
        return made if self.staged is True else self._keep(made, "contests")

    @cached_property
    def competitors(self) -> DataFrame:
        k = F.col("s_suppkey")
        stance = F.element_at(F.array(*[F.lit(s) for s in ("Orthodox", "Southpaw", "Switch")]), (k % 3 + 1).cast("int"))
        return self.read("supplier").select(
            k.alias("side_id"), person_name(k).alias("name"),
            F.when(k % 10 != 0, (64 + k % 14).cast("int")).alias("height"),
            F.when(k % 7 != 0, (65 + k % 16).cast("int")).alias("reach"),
            F.when(k % 11 != 0, stance).alias("stance"),
            F.when(k % 13 != 0, F.date_add(F.lit("1935-01-01").cast("date"), (k * 911 % 15000).cast("int"))).alias("born"),
            (20 + k % 60).alias("total_wins"), (10 + k % 45).alias("total_losses"), (k % 3).alias("total_draws"))

    @wide
    def sides(self) -> DataFrame:
        return reshape.explode_sides(self.contests)

    @cached_property
    def chunks(self) -> DataFrame | None:
        return history.hot_chunks(self.plan_of("sides"), ["side_id"])

    @cached_property
    def division_chunks(self) -> DataFrame | None:
        # A competitor's rows in one division are a part of all its rows.
        return None if self.chunks is None else history.hot_chunks(self.plan_of("sides"), ["side_id", "division"])

    @cached_property
    def _dealt(self) -> DataFrame:
        """Sides dealt by competitor for the windows over it; the split layout of hot competitors deals them itself."""
        return self.plan_of("sides") if self.chunks is not None else packing.deal(self.plan_of("sides"), "side_id", SIDE)

    @wide
    def career(self) -> DataFrame:
        return career.career_features(self._dealt, self.chunks, self.division_chunks)

    @cached_property
    def _profiles(self) -> DataFrame:
        return opponents.opponent_profiles(self._dealt, self.chunks, lambda scored: packing.deal(scored, "contest_id", SWAP))

    @property
    def profiles(self) -> DataFrame:
        """Profiles for a query that reads them once: of many contests they are not written whole for it."""
        return self._profiles if self.staged is True and self.large and "profiled" not in self.__dict__ else self.profiled

    @cached_property
    def profiled(self) -> DataFrame:
        """Read twice wherever skills are scaled, so it is written, with what profiles and adjusted numbers need."""
        own = [c for c in self._profiles.columns if c not in ("event_name", "method", "round", "duration_s", "detailed", "sig_absorbed", "opp_sig_attempted")]
        return self._keep(self._profiles.select(*own), "profiled")

    @cached_property
    def _profiled_whole(self) -> DataFrame:
        return self._keep(self._profiles, "profiled")

    @cached_property
    def skills(self) -> DataFrame:
        """Scaled skills without the measures they adjust: only the raw skills are written for the two reads."""
        if "profiled" in self.__dict__:
            return self.skilled
        raw = [c for c in self._profiles.columns if c.startswith("raw_opp_")]
        return opponents.zscore_skills(self._keep(self._profiles.select("contest_id", "contest_date", "side_id", *raw), "skills"))

    @cached_property
    def skilled(self) -> DataFrame:
        return opponents.zscore_skills(self.profiled)

    @wide
    def adjusted(self) -> DataFrame:
        return opponents.adjusted_features(opponents.adjust_by_opponent(self.skilled), self.chunks)

    def adjusted_of(self, outputs: list[str], measures: list[str], skills: list[str]) -> DataFrame:
        """The named adjusted columns, which follow from the named measures and opponent skills. Of many contests only those are
        written for the two reads; without any, there is nothing to scale and nothing is written."""
        if not (self.staged is True and self.large) or "profiled" in self.__dict__:
            return self.adjusted.select("contest_id", "side_id", *outputs)
        kept = ["contest_id", "contest_date", "side_id", *measures, *[f"raw_opp_{s}" for s in skills]]
        whole = self._profiles
        rows = stage(whole.select(*kept), "profiled") if skills else whole
        # Columns that no output follows from stand as nulls; they are pruned before anything is computed of them.
        rows = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in whole.schema.fields if f.name not in rows.columns})
        scaled = opponents.zscore_skills(rows)
        if self.chunks is None:
            scaled = packing.deal(scaled, "side_id", ADJUST)
        made = opponents.adjusted_features(opponents.adjust_by_opponent(scaled), self.chunks)
        return made.select("contest_id", "side_id", *outputs)

    @cached_property
    def medians(self) -> DataFrame:
        # One narrow window: neither the profiles nor the other career measures are computed for it.
        counted = history.with_history(self._dealt, ["side_id"], [history.Prefix("_n", "sum", F.lit(1))], self.chunks)
        medians = imputation.division_medians(counted.withColumn("n_prior", F.coalesce("_n", F.lit(0))))
        # Of many contests, medians and career measures of one query read the same exchange.
        return medians if self.staged is True and self.large else self._keep(medians, "medians")

    @wide
    def imputed(self) -> DataFrame:
        return imputation.impute_early_career(self.plan_of("career"), F.broadcast(self.medians))

    @wide
    def matchups(self) -> DataFrame:
        return reshape.temporal_flags(self._paired(self.plan_of("imputed")))

    def _paired(self, sides: DataFrame) -> DataFrame:
        """Both sides of a contest with what pairs have of them, dealt by contest."""
        facts = ["contest_id", "contest_date", "event_name", "division", "method", "round", "duration_s", "side_id", "won"]
        own = [c for c in sides.columns if c in (*facts, "wins_prior", *[f.name for f in spec.SIDE_FEATURES])]
        return reshape.build_matchups(packing.deal(sides.select(*own), "contest_id", PAIR))

    def matchups_of(self, *features: str) -> DataFrame:
        """Pairs with only the named features of both sides, without the temporal flags. The second side is one struct, whose
        fields Spark does not prune, so reading the wide table through ships all features whatever is read of it."""
        if "matchups" in self.__dict__:
            return self.__dict__["matchups"]
        facts = ["contest_id", "contest_date", "event_name", "division", "method", "round", "duration_s", "side_id", "won"]
        counts = ["n_prior", *["wins_prior" for f in features if f in ("sub_rate", "ko_rate", "dec_rate", "finish_rate")]]
        return self._paired(self.plan_of("imputed").select(*facts, *dict.fromkeys([*counts, *features])))

    @cached_property
    def games(self) -> DataFrame:
        return ratings.rating_input(self.contests)

    @cached_property
    def rated(self) -> DataFrame:
        return self._keep(ratings.elo_ratings(self.games), "rated")

    @property
    def latest(self) -> DataFrame:
        """Ratings after the last contest. The streams end with them, so no row per contest is written for them."""
        return ratings.latest_ratings(self.games).drop("k")

    @property
    def feature_pairs(self) -> DataFrame:
        """The feature table without physical and one-hot columns, unwritten: a report over it computes only what it reads."""
        whole = self._profiled_whole
        adjusted = opponents.adjusted_features(opponents.adjust_by_opponent(opponents.zscore_skills(whole)), self.chunks)
        both = career.career_features(adjusted, self.chunks, self.division_chunks)
        # The profile pass has counted each side's earlier rows already.
        medians = imputation.division_medians(whole.withColumnRenamed("n_before", "n_prior"))
        return reshape.temporal_flags(reshape.build_matchups(imputation.impute_early_career(both, medians)))

    def feature_table(self) -> DataFrame:
        """The full feature table: career, rolling, adjusted, style, temporal, physical and division features of both sides.

        Only the profiled sides are staged (they are read twice). From there one shuffle by competitor serves every window and one by contest pairs the sides.
        """
        # The wide rows are written before the join: otherwise the optimizer derives constraints through every column.
        return reshape.one_hot_fixed(stage(self.feature_pairs, "pairs").join(self.physical_pairs.drop("contest_date", "f1_id", "f2_id"), "contest_id"))

    @property
    def physical_pairs(self) -> DataFrame:
        cols = self.plan_of("sides").select("contest_id", "contest_date", "division", "side_id")
        medians = imputation.physical_medians(cols, self.competitors)
        return physical.physical_matchups(imputation.impute_physical(cols, self.competitors, medians))

    # ---------------------------------------------------------------- second-source records
    def _called(self, contests: DataFrame) -> DataFrame:
        c, p = F.col, spread(F.col("contest_id"))
        named = contests.withColumns({"name_1": person_name(c("red_id")), "name_2": person_name(c("blue_id"))})
        called = F.when(p > 0.5, c("name_1")).otherwise(c("name_2"))
        past = c("contest_date") < F.lit(CUTOFF).cast("date")
        won = (F.when(c("winner") == c("red_id").cast("string"), c("name_1")).when(c("winner") == c("blue_id").cast("string"), c("name_2"))
               .otherwise(c("winner")))
        return named.select(
            "contest_id", names.slug(c("event_name")).alias("event_id"), "contest_date", *[n for n in ("position",) if n in contests.columns], "division",
            "name_1", "name_2", p.alias("p1"), called.alias("predicted_winner"),
            odds_math.confidence(p).alias("confidence"), F.when(past, won).alias("actual_winner"),
            F.when(past, c("method")).alias("actual_method"), F.when(past, c("round_text").try_cast("int")).alias("actual_round"),
            F.when(past & ~c("winner").isin("Draw", "No Contest"), called == won).alias("correct"))

    @cached_property
    def ledger_contests(self) -> DataFrame:
        """Predictions in card order; results are filled in for events before the cutoff."""
        return self._share(self._called(serving.card_places(self.contests)), "ledger_contests")

    @cached_property
    def called(self) -> DataFrame:
        """The same without places on the card, which cost a sort and a join by date."""
        if "ledger_contests" in self.__dict__ and not (self.staged is True and self.large):
            return self.ledger_contests.drop("position")
        return self._called(self.contests)

    @cached_property
    def ledger_events(self) -> DataFrame:
        from ..operators import ledger
        dates = self.contests.select(F.col("contest_date").alias("event_date"), "event_name").distinct()
        dates = dates.select(names.slug(F.col("event_name")).alias("event_id"), "event_date")
        scored = ledger.event_accuracy(self.called)
        past = F.col("event_date") < F.lit(CUTOFF).cast("date")
        keep = lambda n: F.when(past, F.col(n)).alias(n)
        return self._keep(dates.join(scored, "event_id").select(
            "event_id", "event_date", past.alias("locked"),
            F.when(F.dayofmonth("event_date") % 2 == 0, "live").otherwise("backtest").alias("prediction_type"),
            keep("overall_correct"), keep("overall_total"), keep("overall_accuracy")), "ledger_events")

    @cached_property
    def other_source(self) -> DataFrame:
        """The same contests as another source lists them: every second one reversed, one division's names
        misspelt, and none for contests without a round."""
        c = F.col
        odd = F.pmod("contest_id", F.lit(2)) == 1
        n1, n2 = c("_n1"), c("_n2")
        first, second = F.when(odd, n2).otherwise(n1), F.when(odd, n1).otherwise(n2)
        typo = F.when(c("division") == "Heavyweight", F.concat(F.substring(first, 1, 2), F.substring(first, 4, F.length(first)))).otherwise(first)
        line = F.when(c("margin") >= 0, -(110 + 3 * c("margin"))).otherwise(100 - 2 * c("margin"))
        back = F.when(-c("margin") >= 0, -(110 - 3 * c("margin"))).otherwise(100 + 2 * c("margin"))
        sign = F.when(odd, back).otherwise(line).cast("long"), F.when(odd, line).otherwise(back).cast("long")
        won = (F.when(c("winner") == c("red_id").cast("string"), F.when(odd, second).otherwise(typo))
               .when(c("winner") == c("blue_id").cast("string"), F.when(odd, typo).otherwise(second)).otherwise(c("winner")))
        named = self.contests.filter("round_text IS NOT NULL").withColumns({"_n1": person_name(c("red_id")), "_n2": person_name(c("blue_id"))})
        return self._share(named.select(
            c("contest_id").alias("r_id"), c("contest_date").alias("event_date"), names.slug(c("event_name")).alias("event_id"), "event_name",
            typo.alias("name_1"), second.alias("name_2"), sign[0].alias("f1_line"), sign[1].alias("f2_line"),
            won.alias("winner"), "method", c("round_text").try_cast("int").alias("round")), "other_source")

    @cached_property
    def matched(self) -> DataFrame:
        """Ledger contests with their partner in the other source."""
        from ..operators import matching
        return self._keep(matching.match_contest_pair(self.ledger_names, self.other_names, ["event_date"]), "matched")

    @property
    def ledger_names(self) -> DataFrame:
        key = lambda c: names.basic_key(F.col(c))
        return self.called.select(F.col("contest_date").alias("event_date"), F.col("contest_id").alias("l_id"),
                                           key("name_1").alias("l1"), key("name_2").alias("l2"))

    @property
    def other_names(self) -> DataFrame:
        key = lambda c: names.basic_key(F.col(c))
        return self.other_source.select("event_date", "r_id", key("name_1").alias("r1"), key("name_2").alias("r2"))

    @cached_property
    def odds(self) -> DataFrame:
        """Prices of two books per contest of the other source."""
        fields = ["r_id", "event_date", "event_name", "name_1", "name_2"]
        # Both prices of a contest lie in one task, so they are combined before the shuffle.
        book = lambda name, shift: F.struct(F.lit(name).alias("book"), F.lit(shift).alias("shift"))
        priced = self.other_source.withColumn("_b", F.explode(F.array(book("alpha", 0), book("beta", 7))))
        shift = F.col("_b.shift")
        return priced.select(*fields, "_b.book", *[(F.col(f) + F.when(F.col(f) > 0, shift).otherwise(-shift)).alias(f) for f in ("f1_line", "f2_line")])

    @cached_property
    def consensus(self) -> DataFrame:
        from ..operators import market
        return market.fair_consensus(market.book_fair(self.odds), ["r_id", "event_date", "name_1", "name_2"])

    @cached_property
    def snapshot(self) -> DataFrame:
        return serving.latest_snapshot(self.plan_of("matchups"), SNAPSHOT_FEATURES)


SNAPSHOT_FEATURES = ["n_prior", "wins_prior", "losses_prior", "win_rate", "finish_rate", "win_streak", "loss_streak", "days_since_last",
                     "win_rate_last_3", "win_rate_last_5", "sig_landed_last_5", "sig_absorbed_last_5", "td_landed_last_5"]
