"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Documents fall into cells by source, language and topic. The sample has ``keep`` of all tokens, or as many as the given
shares allow: no value can give more tokens than it has, so a rare one with a large share makes the sample smaller. A cell's
probability is the product of a factor of its source, one of its language and one of its topic, or 1 where that is more.
The factors of each margin in turn are set anew until the expected tokens of each value are its target share. Given shares
are met in expectation. A tempered value is asked for all its tokens at most, and if tempered and given shares can't hold at
once, the given ones do. ``achieved`` gives each value's target and share. A document is kept if a hash of its id and text,
as a number from 0 to 1, is below its cell's probability, so a sample can be made again.

Every value of a margin has its own target. Up to ``most_values`` ** 3 cells are arrays on the driver (``Here``); more stay
in DataFrames (``Wide``). Both take the steps of ``solve`` with the same rounds and limits, and what they add is rounded to
multiples of a power of two first, so sums don't depend on an order and both give the same probabilities to the bit. Nulls
are a value of their own; documents without words have no tokens, and get the sample's share of all tokens as probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lodestar.llm.common import byte_groups, discard, shared_path, stored, text_column
from lodestar.plans.ship import ship

#: Given shares are met if they are as close as this; samples are made smaller by tenths so often until they are.
CLOSE, SMALLER = 1e-6, 40
#: Rounds over the margins at most; they end when all shares are this close, or were not brought to half as far off in STALL rounds.
ROUNDS, ENOUGH, STALL = 200, 1e-10, 20
#: Factors of values that can't give more are not raised beyond this.
HIGHEST = 1e100
MARGINS = ("source", "lang", "topic")
NAMES = [f"__{m}" for m in MARGINS]


@dataclass(frozen=True)
class Targets:
    """Shares by margin and value, where given; otherwise own shares to a power. Both are scaled to sum 1 over what occurs.

    A margin with given shares has values without one too: they have their own shares to the power. A given 0 drops a value.

    keep: the most that stays of all tokens. most_values: its cube is how many cells are raked on the driver.
    """

    given: dict[str, dict[str, float]] = field(default_factory=dict)
    power: float = 0.7
    keep: float = 0.8
    most_values: int = 64


#: Topics by what a text looks like, in the order in which they are tried: bytes, and their least share.
LOOKS = (("numbers", b"0123456789", 0.05), ("table", b"|\t", 0.02), ("signs", b"#$%&*!<>{}=@_/\\", 0.03))
PROSE = "prose"


def _member(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_MEMBERS = [_member(m) for _, m, _ in LOOKS]
_BLANK = _member(bytes([9, 10, 11, 12, 13, 32]))


def looks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Words and topic of each text of a batch."""
    n = len(offsets) - 1
    words, topics = np.zeros(n, np.int64), np.full(n, PROSE, object)
    for i, j in byte_groups(offsets, 1 << 18):
        part = data[offsets[i] : offsets[j]]
        cut = offsets[i : j + 1] - offsets[i]
        size = np.maximum(np.diff(cut), 1)

        def count(hits: np.ndarray, cut: np.ndarray = cut) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(hits, dtype=np.int32)])[cut])

        word = ~_BLANK[part]
        first = word.copy()
        first[1:] &= ~word[:-1]
        begin = cut[:-1][np.diff(cut) > 0]
        first[begin] = word[begin]
        words[i:j] = count(first)
        for (name, _, share), member in reversed(list(zip(LOOKS, _MEMBERS))):
            topics[i:j][count(member[part]) > share * size] = name
    return words, topics.tolist()


def unit(bound: float) -> float:
    """A power of two: multiples of its inverse, with sums up to about that bound, are added as 64-bit integers."""
    return 2.0 ** (61 - math.frexp(bound)[1]) if bound > 0 else 1.0


def exact(x: np.ndarray, u: float) -> float:
    """The sum of x in multiples of 1 / u, the same in any order."""
    return float(np.rint(x * u).astype(np.int64).sum()) / u


def tempered(have: np.ndarray, whole: float, power: float) -> np.ndarray:
    """Shares of all tokens to the power, one by one: by arrays or by Spark's pow(), last bits can differ."""
    return np.array([math.pow(n / max(whole, 1.0), power) for n in have.tolist()], float)


def reach(have: np.ndarray, base: np.ndarray, named: np.ndarray) -> float:
    """The most tokens of a sample in which the named values of a margin have their shares."""
    some = (base > 0) & (have > 0)
    hard = some & named
    if not hard.any():
        return float(have[some].sum())
    return exact(np.minimum(have, (have[hard] / base[hard]).min() * base)[some], unit(float(have.sum())))


def goals(have: np.ndarray, base: np.ndarray, total: float) -> np.ndarray:
    """Target tokens of a sample of that many: in proportion to base, but no value has more than all its tokens."""
    base = np.where(have > 0, base, 0.0)
    u = unit(float(np.count_nonzero(base > 0) * base.max(initial=0.0)))
    scale = 0.0
    while True:
        full = scale * base > have
        rest = exact(base[~full], u)
        more = (total - float(have[full].sum())) / rest if rest > 0 else 0.0
        if more <= scale:
            return np.minimum(have, scale * base)
        scale = more


def rake(tokens: np.ndarray, cells: list[tuple], targets: list[dict], rounds: int = ROUNDS, close: float = ENOUGH) -> np.ndarray:
    """Weights of the cells (sum 1) whose margins have the target shares, with the interactions of tokens and no bound on a cell."""
    weight = tokens / tokens.sum() if tokens.sum() else np.full(len(tokens), 1 / max(1, len(tokens)))
    index = []
    for m, target in enumerate(targets):
        names = sorted({c[m] for c in cells})
        place = {n: i for i, n in enumerate(names)}
        at = np.array([place[c[m]] for c in cells])
        goal = np.array([target.get(n, 0.0) for n in names])
        goal = np.where(np.bincount(at, weight, len(names)) > 0, goal, 0)  # a value without tokens can't be raised
        index.append((at, goal / goal.sum() if goal.sum() else goal))
    for _ in range(rounds):
        worst = 0.0
        for at, goal in index:
            now = np.bincount(at, weight, len(goal))
            worst = max(worst, float(np.abs(now - goal).max(initial=0)))
            weight = weight * np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)[at]
        if worst < close:
            break
    return weight


def calibrate(tokens: np.ndarray, weight: np.ndarray, keep: float) -> np.ndarray:
    """Probabilities up to 1 in proportion to weight over tokens, which keep that share of all tokens if they can."""
    rate = np.divide(weight, tokens, out=np.zeros_like(weight), where=tokens > 0)
    goal = keep * tokens.sum()
    p = np.zeros(len(tokens))
    full = np.zeros(len(tokens), bool)
    for _ in range(len(tokens) + 1):
        rest = (tokens * rate)[~full].sum()
        scale = max(0.0, goal - tokens[full].sum()) / rest if rest > 0 else 0.0
        p = np.where(full, 1.0, np.minimum(1.0, scale * rate))
        more = ~full & (scale * rate >= 1)
        if not more.any():
            break
        full |= more
    return np.where(tokens > 0, p, keep)


def counted(docs: DataFrame, carry: list[str], topic: str | None = None) -> DataFrame:
    """The columns to carry, with __tokens, __source, __lang and __topic; texts are read in one pass.

    topic: a column, instead of what texts look like. Margins are text, nulls '(null)'.
    """
    margin = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("(null)"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = margin(topic) if topic else F.lit(None).cast("string")
    rows = docs.select(text.alias("__text"), margin("source").alias("__source"), margin("lang").alias("__lang"), own.alias("__topic"), *carry)
    schema = rows.drop("__text", "__topic").schema.add("__tokens", "long").add("__topic", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, topics = looks(*text_column(batch, "__text"))
            given = batch.column(3) if topic else pa.array(topics, pa.string())
            columns = batch.columns[1:]
            kept = [k for k in range(len(columns)) if k != 2]
            yield pa.RecordBatch.from_arrays([*[columns[k] for k in kept], pa.array(words), given], names=schema.names)

    return rows.mapInArrow(run, schema)


def fit(rows: DataFrame, t: Targets) -> tuple[DataFrame, bool]:
    """A row for each cell: its margins, tokens and probability; and if they were too many for the driver. rows: from counted()."""
    spark = rows.sparkSession
    sums = rows.groupBy(*NAMES).agg(F.sum("__tokens").alias("tokens"))
    cells = stored(sums, "mix-cells")  # texts are read once for all that follows
    if cells.count() > t.most_values**3:
        return fit_wide(cells, t), True
    rows = sorted(cells.collect(), key=lambda r: tuple(r)[:3])
    keys, tokens = [tuple(r)[:3] for r in rows], np.array([r["tokens"] for r in rows], float)
    p = probabilities(keys, tokens, t) if len(keys) else np.zeros(0)
    out = [(*k, float(n), float(x)) for k, n, x in zip(keys, tokens, p)]
    return spark.createDataFrame(out, "__source string, __lang string, __topic string, tokens double, probability double"), False


def fit_wide(cells: DataFrame, t: Targets) -> DataFrame:
    """probabilities() of any number of cells and values: all but a few sums stays in DataFrames."""
    wide = Wide(cells, t)
    share, factors = solve(wide, t)
    p = F.lit(0.0)
    if factors is not None:
        cells, p = wide.joined(factors, "left"), wide.p()
    return cells.select(*NAMES, F.col("tokens").cast("double").alias("tokens"), F.when(F.col("tokens") > 0, p).otherwise(F.lit(share)).alias("probability"))


def solve(cells: Here | Wide, t: Targets) -> tuple[float, list | None]:
    """The share of all tokens that the sample has, and the factors by margin (none: nothing can be kept).

    The sample is made smaller until the given shares are met; if no size meets them, the closest is taken.
    """
    order = sorted(range(len(MARGINS)), key=lambda i: bool(t.given.get(MARGINS[i])))  # given shares have the last word
    firm = [i for i in order if t.given.get(MARGINS[i])]
    total = min(t.keep * cells.whole, *[cells.reach(i) for i in order])
    if total <= 0:
        return t.keep, None
    best = None
    for _ in range(SMALLER):
        cells.start(total)
        for some in (order, firm):
            worst: list[float] = []
            while some and len(worst) < ROUNDS:
                worst.append(max([cells.step(i) for i in some]) / total)
                if worst[-1] < ENOUGH or (len(worst) > STALL and worst[-1] > worst[-1 - STALL] / 2):
                    break
        off = max([cells.off(i) for i in firm], default=0.0) / total
        if best is None or off < best[0]:
            best = (off, cells.hold())
        if off < CLOSE:
            break
        total *= 0.9
    return cells.kept(best[1]) / cells.whole, best[1]


class Here:
    """Cells as arrays on the driver."""

    def __init__(self, keys: list[tuple], tokens: np.ndarray, t: Targets):
        self.tokens, self.whole = tokens, float(tokens.sum())
        self.unit = unit(self.whole)
        self.margins, self.at = margins(keys, tokens, t), []
        for i, (names, *_) in enumerate(self.margins):
            place = {n: k for k, n in enumerate(names)}
            self.at.append(np.array([place[k[i]] for k in keys], np.int64))

    def reach(self, i: int) -> float:
        return reach(*self.margins[i][1:])

    def start(self, total: float) -> None:
        self.goals = [goals(have, base, total) for _, have, base, _ in self.margins]
        self.factors = [np.where((have > 0) & (base > 0), 1.0, 0.0) for _, have, base, _ in self.margins]
        self.factors[0] = self.factors[0] * (total / self.whole)

    def p(self, factors: list[np.ndarray]) -> np.ndarray:
        a, b, c = (f[at] for f, at in zip(factors, self.at))
        return np.minimum(1.0, a * b * c)

    def sums(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Expected tokens of each value, and those of its cells with probability 1."""
        p = self.p(self.factors)
        now, full = np.zeros(len(self.goals[i]), np.int64), np.zeros(len(self.goals[i]))
        np.add.at(now, self.at[i], np.rint(self.tokens * p * self.unit).astype(np.int64))
        np.add.at(full, self.at[i], np.where(p >= 1, self.tokens, 0.0))
        return now / self.unit, full

    def off(self, i: int) -> float:
        return float(np.abs(self.sums(i)[0] - self.goals[i]).max(initial=0.0))

    def step(self, i: int) -> float:
        """Set the factors of a margin anew; how many tokens a value was off before."""
        (now, full), goal = self.sums(i), self.goals[i]
        # a value that must grow does so in the cells that still can
        full = np.where((goal > now) & (now > full), full, 0.0)
        change = np.divide(goal - full, now - full, out=np.zeros_like(goal), where=now > 0)
        self.factors[i] = np.minimum(HIGHEST, self.factors[i] * change)
        return float(np.abs(now - goal).max(initial=0.0))

    def hold(self) -> list[np.ndarray]:
        return list(self.factors)

    def kept(self, factors: list[np.ndarray]) -> float:
        return exact(self.tokens * self.p(factors), self.unit)


class Wide:
    """Here in DataFrames: cells stay as they are, and each step stores the goals and factors of a margin's values."""

    def __init__(self, cells: DataFrame, t: Targets):
        self.spark = cells.sparkSession
        ship(self.spark)
        self.cells = cells.select(*NAMES, F.col("tokens").cast("double").alias("tokens"))
        self.whole = whole = self.cells.agg(F.sum("tokens")).first()[0] or 0.0
        self.unit = unit(whole)
        self.margins, self.units, self.state, self.held, power = [], [], {}, set(), t.power
        for m, name in zip(MARGINS, NAMES):
            given = self.spark.createDataFrame([(k, float(v)) for k, v in t.given.get(m, {}).items()], f"{name} string, share double")
            have = self.cells.groupBy(name).agg(F.sum("tokens").alias("have")).where("have > 0").join(given, name, "left")

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    own = pa.array(tempered(batch.column(1).to_numpy(), whole, power))
                    yield pa.RecordBatch.from_arrays([*batch.columns, own], names=[*batch.schema.names, "own"])

            have = have.mapInArrow(run, f"{name} string, have double, share double, own double").withColumn("base", F.coalesce("share", "own"))
            have = stored(have.where("base > 0"), "mix-margin")
            n, most = have.agg(F.count("*"), F.max("base")).first()
            self.margins.append(have)
            self.units.append(unit(float(n * (most or 0.0))))

    def exact(self, x: Column, u: float) -> Column:
        return F.coalesce(F.sum(F.rint(x * F.lit(u)).cast("long")).cast("double"), F.lit(0.0)) / F.lit(u)

    def reach(self, i: int) -> float:
        have = self.margins[i]
        least = have.where("share IS NOT NULL").agg(F.min(F.col("have") / F.col("base"))).first()[0]
        most = F.col("have") if least is None else F.least("have", F.lit(least) * F.col("base"))
        return have.agg(self.exact(most, self.unit)).first()[0]

    def start(self, total: float) -> None:
        for i, have in enumerate(self.margins):
            scale = 0.0
            while True:
                full = F.lit(scale) * F.col("base") > F.col("have")
                rest = self.exact(F.when(~full, F.col("base")), self.units[i])
                held, rest = have.agg(F.sum(F.when(full, F.col("have"))), rest).first()
                more = (total - (held or 0.0)) / rest if rest > 0 else 0.0
                if more <= scale:
                    break
                scale = more
            goal = F.least("have", F.lit(scale) * F.col("base"))
            self.put(i, have.select(NAMES[i], goal.alias("goal"), F.lit(1.0 if i else total / self.whole).alias(f"f{i}")))

    def put(self, i: int, state: DataFrame) -> None:
        """Store a margin's goals and factors, and delete those before unless they are held."""
        path = shared_path(self.spark, "mix-factors")
        before, self.state[i] = self.state.get(i), (path, stored(state, "mix-factors", path))
        if before and before[0] not in self.held:
            discard(self.spark, before[0])

    def p(self) -> Column:
        return F.least(F.lit(1.0), F.col("f0") * F.col("f1") * F.col("f2"))  # in the order of Here.p: last bits depend on it

    def joined(self, factors: list[DataFrame], how: str = "inner") -> DataFrame:
        """Cells with f0, f1 and f2; those of a value without a goal go, or have the factor 0."""
        out = self.cells
        for i, f in enumerate(factors):
            out = out.join(f.select(NAMES[i], f"f{i}"), NAMES[i], how)
        return out.fillna(0.0, ["f0", "f1", "f2"])

    def sums(self, i: int) -> DataFrame:
        p = self.p()
        now, full = self.exact(F.col("tokens") * p, self.unit), F.sum(F.when(p >= 1, F.col("tokens")).otherwise(0.0))
        sums = self.joined(self.hold(False)).groupBy(NAMES[i]).agg(now.alias("now"), full.alias("full"))
        return self.state[i][1].join(sums, NAMES[i], "left").fillna(0.0, ["now", "full"])

    def off(self, i: int) -> float:
        return self.sums(i).agg(F.max(F.abs(F.col("now") - F.col("goal")))).first()[0] or 0.0

    def step(self, i: int) -> float:
        grows = (F.col("goal") > F.col("now")) & (F.col("now") > F.col("full"))
        full = F.when(grows, F.col("full")).otherwise(0.0)
        change = F.when(F.col("now") > 0, (F.col("goal") - full) / (F.col("now") - full)).otherwise(0.0)
        seen = Observation()
        sums = self.sums(i).observe(seen, F.max(F.abs(F.col("now") - F.col("goal"))).alias("off"))
        self.put(i, sums.select(NAMES[i], "goal", F.least(F.lit(HIGHEST), F.col(f"f{i}") * change).alias(f"f{i}")))
        return seen.get["off"] or 0.0

    def hold(self, keep: bool = True) -> list[DataFrame]:
        """The factors by margin; if they are to be kept, no step deletes them."""
        if keep:
            self.held |= {path for path, _ in self.state.values()}
        return [self.state[i][1] for i in range(len(NAMES))]

    def kept(self, factors: list[DataFrame]) -> float:
        return self.joined(factors).agg(self.exact(F.col("tokens") * self.p(), self.unit)).first()[0]


def margin_tokens(keys: list[tuple], tokens: np.ndarray, i: int) -> dict[str, float]:
    own: dict[str, float] = {}
    for k, n in zip(keys, tokens):
        own[k[i]] = own.get(k[i], 0.0) + n
    return own


def margins(keys: list[tuple], tokens: np.ndarray, t: Targets) -> list[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """Of each margin: its values, their tokens, what their target shares are in proportion to, and if that was given."""
    parts = []
    for i, m in enumerate(MARGINS):
        own, given = margin_tokens(keys, tokens, i), t.given.get(m, {})
        have = np.array(list(own.values()), float)
        base = [float(given[k]) if k in given else x for k, x in zip(own, tempered(have, float(tokens.sum()), t.power).tolist())]
        parts.append((list(own), have, np.array(base, float), np.array([k in given for k in own], bool)))
    return parts


def margin_targets(keys: list[tuple], tokens: np.ndarray, t: Targets, most: float = np.inf) -> tuple[float, list[dict[str, float]]]:
    """The tokens of the sample, at most that many, and the target shares by margin."""
    parts = margins(keys, tokens, t)
    total = min([most, t.keep * tokens.sum(), *[reach(*part[1:]) for part in parts]])
    return total, [dict(zip(names, (goals(have, base, total) / total if total > 0 else np.zeros(len(names))).tolist())) for names, have, base, _ in parts]


def probabilities(keys: list[tuple], tokens: np.ndarray, t: Targets) -> np.ndarray:
    """Of each cell; the sample is made smaller until the given shares are met, unless no size meets them."""
    here = Here(keys, tokens, t)
    share, factors = solve(here, t)
    return np.where(tokens > 0, 0.0 if factors is None else here.p(factors), share)


def uniform(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) from 48 bits of a digest of the id and the text, so repeated rows share their fate."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text.cast("string"), F.lit("")))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mix(docs: DataFrame, targets: Targets = Targets(), topic: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (or those to keep) with n_tokens, topic, probability, draw and kept."""
    added = {"n_tokens": "__tokens", "topic": "__topic", "probability": "__p", "draw": "__draw"}
    names = [c for c in (docs.columns if keep is None else keep) if c not in (*added, "kept")]
    # one pass over the texts for the sums, one for the sample
    cells, wide = fit(counted(docs, [], topic), targets)
    out = counted(docs.withColumn("__draw", uniform(F.col("doc_id"), F.col("text"))), [*names, "__draw"], topic)
    cells = cells.select(*NAMES, F.col("probability").alias("__p"))
    out = out.join(cells if wide else F.broadcast(cells), NAMES, "left")
    return out.select(*names, *[F.col(c).alias(a) for a, c in added.items()], (F.col("__draw") < F.col("__p")).alias("kept"))


def achieved(docs: DataFrame, targets: Targets = Targets(), topic: str | None = None) -> list[tuple[str, str, float, float]]:
    """Margin, value, target share and expected share of the sample's tokens. Collects a row for each cell."""
    rows = fit(counted(docs, [], topic), targets)[0].collect()
    keys, tokens = [tuple(r)[:3] for r in rows], np.array([r["tokens"] for r in rows], float)
    kept = tokens * np.array([r["probability"] for r in rows], float)
    total, wanted = margin_targets(keys, tokens, targets, kept.sum()) if len(keys) else (0.0, [])
    found = [margin_tokens(keys, kept, i) for i in range(len(wanted))]
    return [(m, v, x, float(found[i][v] / kept.sum()) if total else 0.0) for i, (m, w) in enumerate(zip(MARGINS, wanted)) for v, x in sorted(w.items())]
