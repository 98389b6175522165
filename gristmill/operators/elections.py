"""Elections over ballots (ballot_id, prefs: candidates, best first), and district compactness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.plans.ranking import positions
from gristmill.session import cut


def votes(ballots: DataFrame) -> DataFrame:
    """(ballot_id, pos, candidate), pos from 0."""
    return ballots.select("ballot_id", F.posexplode("prefs").alias("pos", "candidate"))


def plurality(ballots: DataFrame) -> DataFrame:
    """(winner, votes): most first places, of equals the first by name; no row without a vote."""
    first = ballots.select(F.get("prefs", F.lit(0)).alias("candidate")).where("candidate IS NOT NULL")
    return first.groupBy("candidate").agg(F.count(F.lit(1)).alias("votes")).orderBy(F.desc("votes"), "candidate").limit(1).select(F.col("candidate").alias("winner"), "votes")


def approval(ballots: DataFrame) -> DataFrame:
    """(winner, votes): most approvals; of equals the one that reached its count first in ballot order."""
    scan = positions(votes(ballots), ["ballot_id", "pos"], name="at")
    total = scan.groupBy("candidate").agg(F.count(F.lit(1)).alias("votes"), F.max("at").alias("reached"))
    return total.orderBy(F.desc("votes"), "reached").limit(1).select(F.col("candidate").alias("winner"), "votes")


def borda(ballots: DataFrame, points: list[int] | None = None) -> DataFrame:
    """(candidate, points, first_met): points by place, by default length of the ballot - 1 downwards. A ballot whose
    length is not that of points fails the query."""
    b = ballots
    if points is not None:
        n = len(points)
        bad = F.when(F.size("prefs") != n, F.raise_error(F.lit("a ballot must rank as many candidates as there are points")).cast("bigint"))
        b = b.withColumn("ballot_id", F.coalesce(bad, F.col("ballot_id")))
        worth = F.element_at(F.array(*map(F.lit, points)), F.col("pos") + 1)
    else:
        worth = F.col("size") - 1 - F.col("pos")
    each = b.select("ballot_id", F.size("prefs").alias("size"), F.posexplode("prefs").alias("pos", "candidate"))
    return each.groupBy("candidate").agg(F.sum(worth).cast("bigint").alias("points"), F.min(F.struct("ballot_id", "pos")).alias("first_met"))


def borda_winner(ballots: DataFrame, points: list[int] | None = None) -> DataFrame:
    return borda(ballots, points).orderBy(F.desc("points"), "first_met").limit(1).select(F.col("candidate").alias("winner"), "points")


def _distinct(candidates: list[str]) -> list[str]:
    assert len(set(candidates)) == len(candidates), "candidates must be distinct"
    return candidates


def pairwise(ballots: DataFrame, candidates: list[str]) -> DataFrame:
    """(a, b, a_votes, b_votes, wins) of every ordered pair of the candidate list: a ballot counts for the one of the two
    that it names first, if any; a tie wins for a. One aggregate with two sums a pair, no join."""
    names = _distinct(candidates)
    place = {c: F.coalesce(F.nullif(F.array_position("prefs", c), F.lit(0)), F.lit(1 << 40)) for c in names}
    aggs, pairs = [], [(a, b) for a in names for b in names if a != b]
    for k, (a, b) in enumerate(pairs):
        aggs.append(F.count_if(place[a] < place[b]).alias(f"w{k}"))
    one = ballots.agg(*aggs) if aggs else ballots.agg(F.lit(1).alias("none"))
    at = {p: k for k, p in enumerate(pairs)}
    rows = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"w{at[a, b]}").alias("a_votes"), F.col(f"w{at[b, a]}").alias("b_votes")) for a, b in pairs
    ]
    kind = "array<struct<a:string,b:string,a_votes:bigint,b_votes:bigint>>"
    out = one.select(F.explode(F.array(*rows) if rows else F.array().cast(kind)).alias("p")).select("p.*")
    return out.withColumn("wins", F.col("a_votes") >= F.col("b_votes"))


def condorcet(ballots: DataFrame, candidates: list[str]) -> DataFrame:
    """(winner): the first listed candidate that loses to none; null if there is none."""
    order = F.array_position(F.array(*map(F.lit, candidates)), F.col("a"))
    good = pairwise(ballots, candidates).groupBy("a").agg(F.bool_and("wins").alias("all")).where("all")
    return good.agg(F.min_by("a", order).alias("winner"))


def ranked_choice(ballots: DataFrame, candidates: list[str]) -> DataFrame:
    """(round, candidate, votes, eliminated, winner) of every round: over half of the live votes wins, else the candidate of
    fewest votes goes (those without one included; of equals the last by name). The candidate list stays
    on the driver; each round is one aggregate."""
    live, rows, k = sorted(_distinct(candidates)), [], 0
    ballots = cut(ballots.select("prefs"))
    while live:
        k += 1
        first = F.get(F.filter("prefs", lambda c: c.isin(live)), F.lit(0))
        got = {r["c"]: r["n"] for r in ballots.select(first.alias("c")).where("c IS NOT NULL").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
        n = {c: got.get(c, 0) for c in live}
        best = max(live, key=lambda c: (n[c], -live.index(c)))
        won = 2 * n[best] > sum(n.values()) or len(live) == 1
        out = max((c for c in live if n[c] == min(n.values())), default=None)
        rows += [(k, c, n[c], not won and c == out, won and c == best) for c in live]
        live = [] if won else [c for c in live if c != out]
    return ballots.sparkSession.createDataFrame(rows, "round int, candidate string, votes long, eliminated boolean, winner boolean")


# --- districts -----------------------------------------------------------------------------------------


def _positive(c: Column, name: str, zero: bool = False) -> Column:
    bad = c < 0 if zero else c <= 0
    return F.when(bad, F.raise_error(F.lit(f"{name} must be positive")).cast("double")).otherwise(c)


def polsby_popper(area: Column, perimeter: Column) -> Column:
    """4 pi area / perimeter squared; both must be positive."""
    return 4 * F.pi() * _positive(area, "area") / F.pow(_positive(perimeter, "perimeter"), F.lit(2.0))


def reock(area: Column, circle: Column) -> Column:
    """Area over that of the smallest circle around; neither may be negative, and a circle of 0 is a division by zero."""
    return _positive(area, "area", True) / _positive(circle, "circle", True)


def population_hull(population: Column, hull: Column) -> Column:
    """Population over that of the convex hull."""
    return _positive(population, "population", True) / _positive(hull, "hull", True)


def running_counts(ballots: DataFrame) -> DataFrame:
    """(ballot_id, pos, candidate, so_far): each candidate's approvals as the ballots are counted."""
    counted = positions(votes(ballots), ["ballot_id", "pos"], ["candidate"], "gm_k")
    return counted.select("ballot_id", "pos", "candidate", (F.col("gm_k") + 1).alias("so_far"))
