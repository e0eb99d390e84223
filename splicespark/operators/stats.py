"""Two-group statistics over per-sample PSI values."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import kernels as K

KEY = ["lsv_id", "junc_idx"]
COLUMNS = 1 << 16  # places of connections that are tested at once
VARIES = 1e-24  # squared standard errors up to this are rounding


def group_summary(psi: DataFrame) -> DataFrame:
    """lsv_id, junc_idx, grp, n, median_psi, q25, q75, iqr over the samples that are quantified; quantiles lie between the
    values on both sides of their place. A connection's samples in a group are ordered once, as rows, and no list or map."""
    own = W.partitionBy(*KEY, "grp")
    placed = psi.select(*KEY, "grp", "psi", F.row_number().over(own.orderBy(F.col("psi").asc_nulls_last())).alias("_place")).withColumn("n", F.count("psi").over(own))

    def quantile(share: float) -> Column:
        at = (F.col("n") - 1) * F.lit(share)
        low, high = F.floor(at), F.ceil(at)
        value = lambda k: F.max(F.when(F.col("_place") == k + 1, F.col("psi"))).over(own)
        return F.when(value(low) == value(high), value(low)).otherwise((high - at) * value(low) + (at - low) * value(high))

    found = placed.withColumns({"median_psi": quantile(0.5), "q25": quantile(0.25), "q75": quantile(0.75)}).filter("_place = 1")
    return found.select(*KEY, "grp", "n", "median_psi", "q25", "q75", (F.col("q75") - F.col("q25")).alias("iqr"))


def two_groups(summary: DataFrame, first: str = "A", second: str = "B") -> DataFrame:
    """Both groups' summaries side by side, and dpsi: second less first median."""
    of = lambda g, p: [F.max(F.when(F.col("grp") == g, F.col(c))).alias(f"{p}_{c}") for c in ("n", "median_psi", "iqr")]
    both = summary.groupBy(*KEY).agg(*of(first, "a"), *of(second, "b")).filter("a_n is not null and b_n is not null")
    return both.withColumn("dpsi", F.col("b_median_psi") - F.col("a_median_psi"))


def welch(psi: DataFrame, first: str = "A", second: str = "B") -> DataFrame:
    """lsv_id, junc_idx, t, dof of Welch's test; null where a group has under 2 samples or nothing varies."""
    m = lambda f, g: f(F.when(F.col("grp") == g, F.col("psi")))
    a = psi.groupBy(*KEY).agg(m(F.count, first).alias("n1"), m(F.count, second).alias("n2"), m(F.avg, first).alias("m1"), m(F.avg, second).alias("m2"), m(F.var_samp, first).alias("v1"), m(F.var_samp, second).alias("v2"))
    e1, e2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    ok = (F.col("n1") > 1) & (F.col("n2") > 1) & (e1 + e2 > 0)
    t = (F.col("m1") - F.col("m2")) / F.sqrt(e1 + e2)
    dof = (e1 + e2) * (e1 + e2) / (e1 * e1 / (F.col("n1") - 1) + e2 * e2 / (F.col("n2") - 1))
    return a.select(*KEY, F.when(ok, t).alias("t"), F.when(ok, dof).alias("dof"))


def mann_whitney(psi: DataFrame, first: str = "A") -> DataFrame:
    """lsv_id, junc_idx, n1, n2, u of the first group, from average ranks over both."""
    w = W.partitionBy(*KEY)
    rank = F.rank().over(w.orderBy("psi")) + (F.count(F.lit(1)).over(W.partitionBy(*KEY, "psi")) - 1) / 2.0
    ranked = psi.filter("psi is not null").withColumn("r", rank)
    own = F.col("grp") == first
    a = ranked.groupBy(*KEY).agg(F.count(F.when(own, 1)).alias("n1"), F.count(F.when(~own, 1)).alias("n2"), F.sum(F.when(own, F.col("r"))).alias("r1"))
    return a.select(*KEY, "n1", "n2", (F.coalesce("r1", F.lit(0.0)) - F.col("n1") * (F.col("n1") + 1) / 2.0).alias("u"))


def thresholds(psi: DataFrame, first: str = "A") -> DataFrame:
    """Every split between distinct values, and both ends: below1, below2 (samples of each group under it), n1, n2."""
    by_value = psi.filter("psi is not null").groupBy(*KEY, "psi").agg(F.count(F.when(F.col("grp") == first, 1)).alias("c1"), F.count(F.when(F.col("grp") != first, 1)).alias("c2"))
    w = W.partitionBy(*KEY)
    upto = w.orderBy("psi").rowsBetween(W.unboundedPreceding, 0)
    return by_value.select(*KEY, F.sum("c1").over(upto).alias("below1"), F.sum("c2").over(upto).alias("below2"), F.sum("c1").over(w).alias("n1"), F.sum("c2").over(w).alias("n2"))


def tnom(psi: DataFrame, first: str = "A") -> DataFrame:
    """lsv_id, junc_idx, n1, n2, score: the fewest samples that one threshold puts on the wrong side."""
    t = thresholds(psi, first)
    wrong = F.least(F.col("below1") + F.col("n2") - F.col("below2"), F.col("n1") - F.col("below1") + F.col("below2"))
    return t.groupBy(*KEY, "n1", "n2").agg(F.least(F.min(wrong), F.col("n1"), F.col("n2")).alias("score"))


def info_score(psi: DataFrame, first: str = "A") -> DataFrame:
    """lsv_id, junc_idx, n1, n2, score: the least sum, over both sides of a threshold, of size times entropy (nats)."""
    t = thresholds(psi, first)
    term = lambda a, b: F.when((a > 0) & (b > 0), -(a * F.ln(a / (a + b)) + b * F.ln(b / (a + b)))).otherwise(0.0)
    split = term(F.col("below1"), F.col("below2")) + term(F.col("n1") - F.col("below1"), F.col("n2") - F.col("below2"))
    return t.groupBy(*KEY, "n1", "n2").agg(F.min(split).alias("score"))


def heterogen_changing(both: DataFrame, p: str = "p", p_most: float = 0.05, dpsi: float = 0.2) -> DataFrame:
    return both.withColumn("changing", (F.col(p) <= p_most) & (F.abs("dpsi") >= dpsi))


def heterogen_nonchanging(both: DataFrame, p: str = "p", p_least: float = 0.05, iqr: float = 0.1, dpsi: float = 0.05) -> DataFrame:
    return both.withColumn("nonchanging", (F.col(p) >= p_least) & (F.greatest("a_iqr", "b_iqr") <= iqr) & (F.abs("dpsi") <= dpsi))


@dataclass
class Ordered:
    """Columns of samples of two groups, each column in order: `first` marks the first group's values; `last` where the
    last of a run of equal values is; n, m: the groups' sizes."""

    x: np.ndarray
    y: np.ndarray
    values: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray) -> Ordered:
        both = np.concatenate((x, y))
        order = np.argsort(both, axis=0, kind="stable")
        values = np.take_along_axis(both, order, 0)
        last = np.concatenate((values[1:] != values[:-1], np.ones((min(1, len(both)), both.shape[1]), bool)))
        return cls(x, y, values, order < len(x), last)

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """The first and the last place of the run of equal values that each value is in."""
        at = np.arange(len(self.values))[:, None]
        begins = np.concatenate((np.ones((min(1, len(self.last)), self.last.shape[1]), bool), self.last[:-1]))
        first = np.maximum.accumulate(np.where(begins, at, 0), axis=0)
        final = np.minimum.accumulate(np.where(self.last, at, len(at))[::-1], axis=0)[::-1]
        return first, final

    def below(self) -> tuple[np.ndarray, np.ndarray]:
        """How many values of each group lie up to and with each place."""
        return np.cumsum(self.first, axis=0), np.cumsum(~self.first, axis=0)


Tested = tuple[np.ndarray, np.ndarray]


def ttest(o: Ordered) -> Tested:
    n, m, none = len(o.x), len(o.y), np.full(o.x.shape[1], np.nan)
    if n < 2 or m < 2:
        return np.ones(len(none)), none
    e1, e2 = o.x.var(0, ddof=1) / n, o.y.var(0, ddof=1) / m
    some = e1 + e2 > VARIES
    safe = np.where(some, e1 + e2, 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        dof = np.where(some, safe * safe / (e1 * e1 / (n - 1) + e2 * e2 / (m - 1)), 1.0)
    return np.where(some, K.t_two_sided((o.x.mean(0) - o.y.mean(0)) / np.sqrt(safe), dof), 1.0), none


def wilcoxon(o: Ordered) -> Tested:
    n, m = len(o.x), len(o.y)
    begin, end = o.runs()
    u = np.where(o.first, (begin + end) / 2 + 1, 0).sum(0) - n * (n + 1) / 2
    size = end - begin + 1.0
    return K.u_tests(u, n, m, np.where(o.last, size**3 - size, 0).sum(0)), np.full(o.x.shape[1], np.nan)


def by_score(scores: np.ndarray, p: Callable[[float], float]) -> np.ndarray:
    """p of each score, computed once for each distinct one."""
    distinct, place = np.unique(scores, return_inverse=True)
    return np.array([p(s) for s in distinct.tolist()])[place]


def tnom_test(o: Ordered) -> Tested:
    n, m = len(o.x), len(o.y)
    if not n or not m:
        return np.ones(o.x.shape[1]), np.full(o.x.shape[1], np.nan)
    a, b = o.below()
    wrong = np.where(o.last, np.minimum(a + m - b, n - a + b), n + m).min(0)
    score = np.minimum(wrong, min(n, m))
    return by_score(score, lambda s: K.tnom_p(int(s), n, m)), score.astype(float)


def infoscore_test(o: Ordered) -> Tested:
    n, m = len(o.x), len(o.y)
    if not n or not m:
        return np.ones(o.x.shape[1]), np.full(o.x.shape[1], np.nan)
    a, b = o.below()

    def term(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where((x > 0) & (y > 0), -(x * np.log(x / (x + y)) + y * np.log(y / (x + y))), 0.0)

    score = np.where(o.last, term(a, b) + term(n - a, m - b), np.inf).min(0)
    return by_score(np.round(score, 9), lambda s: K.info_p(s, n, m)), score


TESTS: dict[str, Callable[[Ordered], Tested]] = {"INFOSCORE": infoscore_test, "TNOM": tnom_test, "TTEST": ttest, "WILCOXON": wilcoxon}


def chosen_tests(names: list[str]) -> list[str]:
    """Sorted, unique names of registered tests; ALL is every one of them."""
    wanted = {n.upper() for n in names}
    unknown = wanted - set(TESTS) - {"ALL"}
    if unknown:
        raise ValueError(f"unknown tests: {sorted(unknown)}")
    return sorted(TESTS if "ALL" in wanted else wanted)


def tests_of_samples(samples: DataFrame, names: list[str], quantile: float = 0.95, first: str = "A") -> DataFrame:
    """lsv_id, junc_idx, stat, p_mean, p_quantile, score.

    samples: grp, experiment, lsv_id, junc_idx, psi array<double>, whose place 0 is the mean and the others draws. At each
    place the test compares the experiments of both groups; p_mean is that of place 0, p_quantile the quantile over the
    draws, score the median of theirs (null where a test has none, or there are no draws). A connection's experiments meet
    in one row; connections with as many experiments in either group are tested at once, all their places together.
    """
    chosen, label = chosen_tests(names), samples.schema["lsv_id"].dataType.simpleString()
    of = lambda own: F.transform(F.sort_array(F.collect_list(F.when(own, F.struct("experiment", "psi")))), lambda s: s["psi"])
    grouped = samples.groupBy(*KEY).agg(of(F.col("grp") == first).alias("x"), of(F.col("grp") != first).alias("y"))

    def tested(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[str, np.ndarray, list, list]]:
        """x, y: connections x experiments x places."""
        rows, width = len(x), x.shape[2]
        columns = lambda v: v.transpose(1, 0, 2).reshape(v.shape[1], rows * width)
        ordered = Ordered.of(columns(x), columns(y))
        for name in chosen:
            p, score = (v.reshape(rows, width) for v in TESTS[name](ordered))
            if width == 1:
                yield name, p[:, 0], [None] * rows, [None] * rows
            else:
                middle = np.median(score[:, 1:], 1)
                yield name, p[:, 0], np.quantile(p[:, 1:], quantile, axis=1).tolist(), [None if np.isnan(s) else s for s in middle.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for c in ("x", "y"):
                lists = batch.column(c)
                sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                values = lists.flatten()
                sides.append((sizes, np.cumsum(sizes) - sizes, values.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(values).to_numpy(zero_copy_only=False)))
            width = max(int(s[3].max(initial=0)) for s in sides)
            if not width:
                continue
            matrices = [s[2].reshape(-1, width) for s in sides]
            for n, m in sorted(set(zip(sides[0][0].tolist(), sides[1][0].tolist()))):
                same = np.flatnonzero((sides[0][0] == n) & (sides[1][0] == m))
                for at in range(0, len(same), max(1, COLUMNS // width)):
                    some = same[at : at + max(1, COLUMNS // width)]
                    x, y = (v[s[1][some][:, None] + np.arange(k)] if k else np.zeros((len(some), 0, width)) for v, s, k in zip(matrices, sides, (n, m)))
                    keys = [batch.column(c).take(pa.array(some)) for c in KEY]
                    for name, mean, above, score in tested(x, y):
                        yield pa.RecordBatch.from_arrays([*keys, pa.array([name] * len(some)), pa.array(mean), pa.array(above, pa.float64()), pa.array(score, pa.float64())], [*KEY, "stat", "p_mean", "p_quantile", "score"])

    return grouped.mapInArrow(run, f"lsv_id {label}, junc_idx int, stat string, p_mean double, p_quantile double, score double")


def later_groups() -> Column:
    """array<struct<g2, m2>>: the groups of a connection behind a row's own, and their medians."""
    every = F.collect_list(F.struct(F.col("grp").alias("g2"), F.col("median_psi").alias("m2"))).over(W.partitionBy(*KEY))
    return F.filter(every, lambda x: x["g2"] > F.col("grp"))


def group_heat_map(summary: DataFrame) -> DataFrame:
    """lsv_id, junc_idx, g1, g2, dpsi for each ordered pair of groups. A connection's groups are one window, so that the
    summary is worked out once."""
    each = summary.select(*KEY, F.col("grp").alias("g1"), "median_psi", later_groups().alias("_later")).select(*KEY, "g1", "median_psi", F.explode("_later").alias("o"))
    return each.select(*KEY, "g1", "o.g2", (F.col("o.m2") - F.col("median_psi")).alias("dpsi"))


def heterogen_index(summary: DataFrame) -> DataFrame:
    """lsv_id, max_abs_dpsi (over connections and pairs of groups), max_iqr, min_quantified: what an index shows of an LSV."""
    most = F.array_max(F.transform("_later", lambda x: F.abs(x["m2"] - F.col("median_psi"))))
    each = summary.withColumn("_later", later_groups()).withColumn("_most", most)
    return each.groupBy("lsv_id").agg(F.max("_most").alias("max_abs_dpsi"), F.max("iqr").alias("max_iqr"), F.min("n").alias("min_quantified"))


def heterogen_rows(summary: DataFrame, groups: list[str]) -> DataFrame:
    """A row for each LSV: for each group its connections' medians, quartiles and numbers of samples as texts with
    semicolons, in order; a group without the LSV has NA for each connection."""
    wanted = summary.select("lsv_id", "junc_idx").distinct().select("*", F.explode(F.array(*map(F.lit, groups))).alias("grp"))
    whole = wanted.join(summary, [*KEY, "grp"], "left")
    text = lambda c: F.when(F.col(c).isNull(), "NA").otherwise(F.format_string("%.4f", F.round(c, 4))).alias(c)
    each = whole.select("lsv_id", "grp", F.struct("junc_idx", text("median_psi"), text("q25"), text("q75"), F.coalesce("n", F.lit(0)).cast("string").alias("n")).alias("x"))
    listed = each.groupBy("lsv_id").pivot("grp", groups).agg(F.sort_array(F.collect_list("x")))
    names = {"median_psi": "median_psi", "q25": "percentile25_psi", "q75": "percentile75_psi", "n": "num_quantified"}
    return listed.select("lsv_id", *(F.array_join(F.col(g).getField(c), ";").alias(f"{g.lower()}_{name}") for g in groups for c, name in names.items()))
