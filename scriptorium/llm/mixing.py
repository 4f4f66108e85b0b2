"""Mixing sources to target weights by iterative proportional fitting.

Token weights are raked until their sums match the target shares of every
margin (source, language, topic); documents are then drawn, and scarce ones
repeated, by calibrated numbers of copies.  Each margin's values are those that its targets name, and all
others together, so the table of cells has a size that the targets fix.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER = "(other)"
ITERATIONS = 200
TOLERANCE = 1e-9
#: Named targets that leave less than this of 1 leave nothing to ``(other)``.
LEAST_LEFT = 1e-6
#: Rounds of raking under the limit of copies, and that limit; a target that needs more copies is infeasible and shows in its share.
BOUNDED_ITERATIONS = 1000
MOST_COPIES = 64


def token_count(text: Column) -> Column:
    """White-space separated words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic(text: Column) -> Column:
    """The form of a text: ``table`` (many bars), ``marked`` (many signs), ``short`` (under 400 code points) or ``prose``."""
    text = F.coalesce(text, F.lit(""))
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    signs = F.regexp_count(text, F.lit("[#$%&*]"))
    return F.when(bars * 50 > F.length(text), "table").when(signs * 25 > F.length(text), "marked").when(F.length(text) < 400, "short").otherwise("prose")


def named(value: Column, targets: dict[str, float]) -> Column:
    return F.when(value.isin(list(targets)), value).otherwise(F.lit(OTHER))


def goals(cells: dict[tuple, float], margins: list[dict[str, float]]) -> list[dict[str, float]]:
    """The share of tokens that each value with a cell is to get, per margin.

    Targets of values without any cell are given to the others in proportion;
    ``(other)`` gets what the named targets leave of 1.  Where they leave
    nothing, it keeps its own share of the tokens and the named values share the
    rest, so that nulls and values that no target names are drawn too.
    """
    total = sum(cells.values())
    out = []
    for m, targets in enumerate(margins):
        values = sorted({k[m] for k in cells})
        left = 1 - sum(targets.values())
        want = np.array([targets.get(v, max(0.0, left) if v == OTHER else 0.0) for v in values])
        if OTHER in values and OTHER not in targets and left < LEAST_LEFT and total > 0:
            own = sum(n for k, n in cells.items() if k[m] == OTHER) / total
            want *= (1 - own) / (want.sum() or 1.0)
            want[values.index(OTHER)] = own
        if want.sum() <= 0:
            want = np.ones(len(values))
        out.append(dict(zip(values, (want / want.sum()).tolist(), strict=True)))
    return out


def rake(cells: dict[tuple, float], margins: list[dict[str, float]]) -> tuple[dict[tuple, float], float]:
    """Weight of each cell such that weighted sums match the margins' shares of the whole; and the largest miss left.

    Cells without tokens get weight 0.
    """
    keys = [k for k, v in cells.items() if v > 0]
    if not keys:
        return {k: 0.0 for k in cells}, 0.0
    mass = np.array([cells[k] for k in keys], float)
    total = mass.sum()
    wanted, owners = [], []
    for m, shares in enumerate(goals({k: cells[k] for k in keys}, margins)):
        wanted.append(np.array(list(shares.values())) * total)
        owners.append(np.array([list(shares).index(k[m]) for k in keys]))
    weight = np.ones(len(keys))
    miss = 0.0
    for _ in range(ITERATIONS):
        for goal, owner in zip(wanted, owners, strict=True):
            sums = np.bincount(owner, weight * mass, len(goal))
            weight *= np.where(sums > 0, goal / np.where(sums > 0, sums, 1), 0)[owner]
        miss = max(float(np.abs(np.bincount(owner, weight * mass, len(goal)) - goal).max() / total) for goal, owner in zip(wanted, owners, strict=True))
        if miss < TOLERANCE:
            break
    return {k: 0.0 for k in cells} | dict(zip(keys, weight.tolist(), strict=True)), miss


def _factor(mass: np.ndarray, weight: np.ndarray, goal: float, limit: float) -> float:
    """``f`` for which the sum of ``mass * min(limit, f * weight)`` is ``goal``; past what the limit allows, all are at it."""
    order = np.argsort(-weight)
    mass, weight = mass[order], weight[order]
    full = limit * np.concatenate([[0.0], np.cumsum(mass)[:-1]])
    open_ = np.cumsum((mass * weight)[::-1])[::-1]
    f = (goal - full) / open_
    fits = np.flatnonzero(f * weight <= limit)
    return max(0.0, float(f[fits[0]])) if len(fits) else limit / float(weight[-1])


def calibrated(cells: dict[tuple, float], weights: dict[tuple, float], budget: float, margins: list[dict[str, float]] | None = None, limit: float = 1.0) -> dict[tuple, float]:
    """Expected copies of a document of each cell, at most ``limit``, whose tokens are ``budget`` of the whole.

    They are ``weights`` to a common factor where none passes the limit.  Cells
    that pass it stay at it and the others are raked again, so that every margin
    still gets its share of the budget; a value too scarce for its share even
    with all its cells at the limit gets what they hold.  Without ``margins``
    only the total is held.
    """
    out = {k: 0.0 for k in weights}
    keys = [k for k, w in weights.items() if w > 0 and cells[k] > 0]
    if not keys:
        return out
    mass, copies = np.array([cells[k] for k in keys], float), np.array([weights[k] for k in keys]) * budget
    total = sum(cells.values())
    groups = [(np.arange(len(keys)), budget * total)]
    if margins:
        shares = goals({k: v for k, v in cells.items() if v > 0}, margins)
        groups = [(np.flatnonzero([k[m] == v for k in keys]), share * budget * total) for m, of in enumerate(shares) for v, share in of.items()]
        groups = [g for g in groups if len(g[0])]
    for _ in range(BOUNDED_ITERATIONS):
        for at, goal in groups:
            copies[at] = np.clip(copies[at] * _factor(mass[at], copies[at], goal, limit), 1e-100, 1e100)
        held = np.minimum(copies, limit)
        if max(abs(float((mass[at] * held[at]).sum()) - goal) for at, goal in groups) < TOLERANCE * total:
            break
    return out | dict(zip(keys, np.minimum(copies, limit).tolist(), strict=True))


def realised(cells: dict[tuple, float], copies: dict[tuple, float], n_margins: int) -> list[dict[str, float]]:
    """The share of the expected tokens that each value gets, per margin."""
    whole = sum(cells[k] * c for k, c in copies.items()) or 1.0
    out: list[dict[str, float]] = [{} for _ in range(n_margins)]
    for k, c in copies.items():
        for m in range(n_margins):
            out[m][k[m]] = out[m].get(k[m], 0.0) + cells[k] * c / whole
    return out


def mix(docs: DataFrame, targets: dict[str, dict[str, float]], columns: dict[str, Column], tokens: Column, budget: float, id_col: str = "doc_id", seed: int = 17, within_rows: bool = False) -> DataFrame:
    """``docs`` with ``mix_tokens, mix_weight, mix_expected, mix_probability, mix_copies, mix_kept`` and, per margin, ``mix_<margin>_goal`` and ``mix_<margin>_share``.

    ``targets`` maps each margin to the wanted shares of its values, ``columns``
    each margin to its column.  A document is to be taken ``mix_copies`` times:
    the whole part of its cell's expected copies, and once more where a uniform
    hash of its id falls below the rest, so equal ids share their fate and runs
    agree.  What is scarcer than its share of the budget is repeated, up to
    ``MOST_COPIES`` times; ``mix_kept`` says whether it is taken at all and
    ``mix_probability`` how likely.  With ``within_rows`` the budget is lowered
    where more copies than rows of ``docs`` would be expected.

    Beside each document stand the share of tokens that is the goal of its value
    of each margin and the share that the expected copies reach, which is lower
    only for a target that the limit of copies makes infeasible.  Null values of a margin count as
    ``(other)``, which is drawn like a named value; rows without an id draw each for
    themselves; documents without tokens carry no
    mass and are taken like their cell.  An empty table gives an
    empty result.  The table of cells (at most the product of the numbers of
    named values plus one) is all that reaches the driver.
    """
    names = list(targets)
    margins = [targets[m] for m in names]
    keyed = docs.withColumn("mix_tokens", tokens)
    for m in names:
        keyed = keyed.withColumn(f"mix_{m}", named(F.coalesce(columns[m].cast("string"), F.lit(OTHER)), targets[m]))
    found = keyed.groupBy(*[f"mix_{m}" for m in names]).agg(F.sum("mix_tokens").alias("n"), F.count("*").alias("n_rows")).collect()
    key = lambda r: tuple(r[f"mix_{m}"] for m in names)
    cells, rows = {key(r): float(r["n"]) for r in found}, {key(r): r["n_rows"] for r in found}
    weights, _ = rake(cells, margins)
    copies = calibrated(cells, weights, budget, margins, MOST_COPIES)
    for _ in range(ITERATIONS if within_rows else 0):
        expected = sum(rows[k] * c for k, c in copies.items())
        if expected <= sum(rows.values()) * (1 + 1e-6):
            break
        budget *= sum(rows.values()) / expected
        copies = calibrated(cells, weights, budget, margins, MOST_COPIES)
    wanted, got = goals({k: v for k, v in cells.items() if v > 0}, margins), realised(cells, copies, len(names))
    schema = ", ".join(f"mix_{m} string" for m in names) + ", mix_weight double, mix_expected double" + "".join(f", mix_{m}_goal double, mix_{m}_share double" for m in names)
    told = lambda k: [x for m, v in enumerate(k) for x in (wanted[m].get(v, 0.0), got[m][v])]
    known = docs.sparkSession.createDataFrame([(*k, float(weights[k]), float(copies[k]), *told(k)) for k in cells], schema)
    # A row without an id draws by its content and its place in the input, so that such rows don't share one fate.
    content = [c for c, kind in docs.dtypes if not kind.startswith(("map", "struct", "array", "variant"))]
    ticket = F.when(F.col(id_col).isNull(), F.xxhash64(*content, F.monotonically_increasing_id(), F.lit(seed))).otherwise(F.xxhash64(F.col(id_col), F.lit(seed)))
    drawn = F.shiftrightunsigned(ticket, 11).cast("double") / float(1 << 53)
    out = keyed.withColumn("mix_draw", drawn).join(F.broadcast(known), [f"mix_{m}" for m in names], "left")
    whole = F.floor("mix_expected")
    out = out.withColumn("mix_probability", F.least(F.lit(1.0), F.col("mix_expected")))
    out = out.withColumn("mix_copies", (whole + F.when(F.col("mix_draw") < F.col("mix_expected") - whole, 1).otherwise(0)).cast("int"))
    return out.withColumn("mix_kept", F.col("mix_copies") > 0).drop("mix_draw")
