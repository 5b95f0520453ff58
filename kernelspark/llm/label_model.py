"""Weak supervision: accuracies of voters that may abstain, by expectation-maximisation.

A row is good or bad, and a bad row is bad in the way that one of the voters looks for.
For each of these classes every voter has its accuracies: how often it votes bad, nothing
or good there. A voter that says "good" of everything thereby weighs nothing, one that
rarely speaks but is then right weighs much, and one kind of bad rows can't pass for good
because other kinds are more frequent. Rows with equal votes are one pattern, so the model
sees at most 3 ** voters counted patterns however many rows there are; the counts are
exact over all rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

#: 3 ** MAX_VOTERS bounds what is gathered and sent back (59,049 patterns).
MAX_VOTERS = 10
#: Where estimation starts: shares of votes bad, none, good on good rows, on bad rows of
#: another voter's kind, and on those of the voter's own kind; and the share of good rows.
ON_GOOD, ON_OTHER, ON_OWN = (0.02, 0.18, 0.80), (0.10, 0.20, 0.70), (0.70, 0.15, 0.15)
START_SHARE = 0.85
#: Weight of the start: it counts as so many rows for each row of a class.
PULL = 0.5


def start(voters: int) -> tuple[np.ndarray, np.ndarray]:
    """(vote shares by class, voter and vote; shares of the classes); class 0 is good."""
    shares = np.empty((voters + 1, voters, 3))
    shares[:] = ON_OTHER
    shares[0] = ON_GOOD
    for j in range(voters):
        shares[j + 1, j] = ON_OWN
    # Slightly unequal, so that voters that agree on every row don't leave rounding to decide.
    own = 1 + np.arange(voters) / 100
    return shares, np.concatenate(([START_SHARE], (1 - START_SHARE) * own / own.sum()))


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The same arrays as ``start``, estimated from pattern votes (-1, 0, 1) and counts.

    Without rows the starting values are returned.
    """
    first, share = start(votes.shape[1])
    shares, total = first, counts.sum()
    if not total:
        return shares, share
    base = PULL * total * share
    cast = np.stack([votes == v for v in (-1, 0, 1)], 2) * counts[:, None, None]
    for _ in range(rounds):
        of = classes(votes, shares, share)
        new = np.einsum("pk,pjv->kjv", of, cast) + base[:, None, None] * first
        new /= new.sum(2, keepdims=True)
        now = (of * counts[:, None]).sum(0) + base
        now /= now.sum()
        done = max(np.abs(new - shares).max(), np.abs(now - share).max()) < 1e-10
        shares, share = new, now
        if done:
            break
    return shares, share


def classes(votes: np.ndarray, shares: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Probability of each class for each pattern."""
    odds = np.repeat(np.log(share)[None], len(votes), 0)
    for j in range(votes.shape[1]):
        odds = odds + np.log(shares[:, j]).T[votes[:, j].astype(int) + 1]
    odds = np.exp(odds - odds.max(1, keepdims=True)) if len(votes) else odds
    return odds / odds.sum(1, keepdims=True)


def posterior(votes: np.ndarray, shares: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Probability that a row with these votes is good."""
    return classes(votes, shares, share)[:, 0]


def vote(good: Column, bad: Column) -> Column:
    """1 if good, else -1 if bad, else (or if unknown) 0."""
    return F.when(good, 1).when(bad, -1).otherwise(0)


def weigh(rows: DataFrame, voters: dict[str, Column], out: str) -> DataFrame:
    """rows with column ``out``: the posterior probability of being good by all voters."""
    if not 0 < len(voters) <= MAX_VOTERS:
        raise ValueError(f"1 to {MAX_VOTERS} voters")
    names = [fresh([*rows.columns, out], f"__vote{i}") for i in range(len(voters))]
    cast = rows.withColumns({n: v.cast("int") for n, v in zip(names, voters.values(), strict=True)})
    seen = cast.groupBy(*names).count().orderBy(*names).collect()      # at most 3 ** voters rows
    votes = np.array([[r[n] for n in names] for r in seen], float).reshape(len(seen), len(names))
    good = posterior(votes, *fit(votes, np.array([r["count"] for r in seen], float)))
    schema = ", ".join(f"`{n}` int" for n in names) + f", `{out}` double"
    table = rows.sparkSession.createDataFrame([(*map(int, v), float(g)) for v, g in zip(votes, good)], schema)
    return cast.join(F.broadcast(table), names).select(*rows.columns, out)
