"""Customer segmentation: the behavioural matrix, k-means with restarts,
silhouette, PCA projections, segment profiles, names/actions, CRM summary and
nearest-centroid assignment.

Scale notes: everything per cluster is a ``groupBy`` (k rows out). Pairwise
distances are never formed: the silhouette uses per-cluster sums, so its
cost is rows x k. Centroids and cluster sums reach the driver (k x d values)
and come back as literals in expressions, so no join is needed per row.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import features as fe
from ..functions import lookups as L
from ..session import materialize
from .encode import Standardizer, fit_standardizer
from .joins import attach


# ---------------------------------------------------------------- E1
def segment_matrix(df: DataFrame, cols: Sequence[str] = L.SEGMENT_FEATURES,
                   scaler: Standardizer | None = None, prefix: str = "z_"
                   ) -> tuple[DataFrame, Standardizer]:
    """Fill the behavioural inputs with 0 and standardise (population std)."""
    filled = fe.fill_zero(df, cols)
    scaler = scaler if scaler is not None else fit_standardizer(filled, cols)
    return scaler.transform(filled, prefix=prefix), scaler


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


# ---------------------------------------------------------------- E2
@dataclass(frozen=True)
class Segments:
    """A k-means result: its centers, cost (sum of squared distances) and seed."""
    centers: list
    cost: float
    seed: int
    features: str = "features"

    def transform(self, df: DataFrame, out: str = "raw_cluster") -> DataFrame:
        """Each row's nearest center; ties go to the smallest id."""
        x = [f"_x{i}" for i in range(len(self.centers[0]))]
        arr = vector_to_array(self.features)
        wide = df.withColumns({c: arr[i] for i, c in enumerate(x)})
        return wide.withColumn(out, nearest_centroid(x, dict(enumerate(self.centers)))).drop(*x)


def kmeans_restarts(df: DataFrame, k: int = 5, seeds: Sequence[int] = range(42, 52),
                    features: str = "features", max_iter: int = 20, tol: float = 1e-4
                    ) -> list[Segments]:
    """One k-means fit per seed, all from the same scans.

    The starts are k-means++ draws: a row wins with a chance proportional to its
    squared distance from the centers drawn so far (exponential clocks: the least
    -ln(u) / distance, with u a hash of row and seed), so one aggregate draws the next
    center of every seed. Then one aggregate per step gives every cluster sum of every
    seed whose centers still moved by more than ``tol``. A cluster without rows keeps
    its center; fewer than k different rows give fewer than k centers. Rows that are
    equal in all columns have one clock together.
    """
    seeds = list(seeds)
    names = [c for c in df.columns if c != features]
    arr = vector_to_array(features)
    rows = materialize(df.select(F.xxhash64(*[F.col(f"`{c}`") for c in names], arr).alias("row"),
                                 arr.alias("x")))
    if rows.head() is None:
        raise ValueError("k-means needs rows")
    starts = {s: [] for s in seeds}
    for turn in range(k):
        drawn = _drawn(rows, starts, turn)
        for s, x in drawn.items():
            starts[s].append(x)
    return lloyd(rows, starts, features, max_iter, tol)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(x: np.ndarray, centers: Sequence) -> np.ndarray:
    """(rows, centers): squared distances."""
    return np.stack([((x - np.array(c)) ** 2).sum(1) for c in centers], axis=1)


def _uniform(rows: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """A number in (0, 1) for each row hash, seed and turn (a 64-bit mixer)."""
    z = rows.view(np.uint64) + np.uint64((seed * 1_000_003 + turn + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2**53 + 2.0**-54


def _drawn(rows: DataFrame, starts: dict, turn: int) -> dict:
    """seed -> the next center, for the seeds that have a row away from their centers."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            seeds, clocks, at = [], [], []
            for s, centers in starts.items():
                far = _distances(x, centers).min(1) if centers else np.ones(len(x))
                with np.errstate(divide="ignore"):
                    t = np.where(far > 0, -np.log(_uniform(ids, s, turn)) / far, np.inf)
                i = np.lexsort((ids, t))[0]
                if np.isfinite(t[i]):
                    seeds, clocks, at = [*seeds, s], [*clocks, t[i]], [*at, i]
            yield pa.RecordBatch.from_arrays(
                [pa.array(seeds, pa.int32()), pa.array(clocks, pa.float64()),
                 pa.array(ids[at], pa.int64()),
                 pa.array(x[at].tolist(), pa.list_(pa.float64()))], ["seed", "t", "row", "x"])

    found = rows.select("row", "x").mapInArrow(run, "seed int, t double, row long, x array<double>")
    best = F.min(F.struct("t", "row", "x")).alias("best")
    return {r.seed: list(r.best.x) for r in found.groupBy("seed").agg(best).collect()}


def lloyd(rows: DataFrame, starts: dict, features: str = "features",
          max_iter: int = 20, tol: float = 1e-4) -> list[Segments]:
    """Lloyd's steps over the arrays ``x`` of ``rows`` from ``starts`` (seed -> centers),
    for all seeds at once."""
    centers, open_ = dict(starts), list(starts)
    for _ in range(max_iter):
        sums = _cluster_sums(rows, {s: centers[s] for s in open_})
        moved = {s: 0.0 for s in open_}
        new = {s: [list(c) for c in centers[s]] for s in open_}
        for r in sums:
            new[r.seed][r.c] = [v / r.n for v in r.x]
            moved[r.seed] = max(moved[r.seed], math.dist(new[r.seed][r.c], centers[r.seed][r.c]))
        centers |= new
        open_ = [s for s in open_ if moved[s] > tol]
        if not open_:
            break
    cost = dict.fromkeys(centers, 0.0)
    for r in _cluster_sums(rows, centers):
        cost[r.seed] += r.cost
    return [Segments(c, cost[s], s, features) for s, c in centers.items()]


def _cluster_sums(rows: DataFrame, centers: dict) -> list:
    """(seed, c, n, cost, x) per cluster of every seed: its rows, the sum of their
    squared distances and of their vectors; added up in tasks first."""
    size = len(next(iter(centers.values()))[0])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {s: np.zeros((len(c), size + 2)) for s, c in centers.items()}
        for batch in batches:
            x = _matrix(batch.column(0))
            for s, c in centers.items():
                far = _distances(x, c)
                own = far.argmin(1)
                both = np.column_stack((np.ones(len(x)), far[np.arange(len(x)), own], x))
                for j in range(len(c)):
                    total[s][j] += both[own == j].sum(0)
        for s, t in total.items():
            used = np.flatnonzero(t[:, 0])
            yield pa.RecordBatch.from_arrays(
                [pa.array([s] * len(used), pa.int32()), pa.array(used.astype(np.int32)),
                 pa.array(t[used, 0].astype(np.int64)), pa.array(t[used, 1]),
                 pa.array(t[used, 2:].tolist(), pa.list_(pa.float64()))],
                ["seed", "c", "n", "cost", "x"])

    found = rows.select("x").mapInArrow(
        run, "seed int, c int, n long, cost double, x array<double>")
    # the tasks' shares are added in order of value, not of arrival: the same sums each time
    shares = found.groupBy("seed", "c").agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("cost", "x"))).alias("s"))

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0.0), lambda a, b: a + b)

    def entry(i: int) -> Column:
        return F.transform("s.x", lambda x: x[i])

    return sorted(shares.select(
        "seed", "c", "n", total(F.col("s.cost")).alias("cost"),
        F.array(*[total(entry(i)) for i in range(size)]).alias("x")).collect())


def kmeans_best(df: DataFrame, k: int = 5, seed: int = 42, restarts: int = 10,
                features: str = "features") -> Segments:
    """Best of ``restarts`` k-means fits (seeds seed..seed+restarts-1) by cost, the
    earliest seed on ties; the fits share every scan."""
    fits = kmeans_restarts(df, k, range(seed, seed + restarts), features)
    return min(fits, key=lambda f: (f.cost, f.seed))


def renumber_by(df: DataFrame, cluster: str, by: str, out: str = "cluster") -> DataFrame:
    """Renumber cluster ids by ascending mean of ``by`` (ties by old id).

    Raw k-means ids depend on seed and library; ranks of a business measure
    do not, so names and actions attach to ranks.
    """
    means = df.groupBy(cluster).agg(F.avg(by).alias("_m"))
    ranks = means.select(F.col(cluster).alias("_c"), (F.row_number().over(
        Window.orderBy("_m", cluster)) - 1).cast("int").alias("_rank"))  # one row per cluster
    return attach(df, ranks, {"_c": F.col(cluster)}).withColumn(out, F.col("_rank")).drop("_rank")


# ---------------------------------------------------------------- E3
def silhouette(df: DataFrame, cols: Sequence[str], cluster: str = "cluster") -> DataFrame:
    """Mean silhouette with squared Euclidean distance, exact, in O(rows x k).

    For row i and cluster c: sum_j |x_i - x_j|^2 = n_c |x_i|^2 + Q_c - 2 x_i . S_c
    with n_c, S_c (vector sum) and Q_c (sum of squared norms) per cluster.
    a(i) divides its own cluster's sum by n_c - 1, b(i) is the smallest mean
    over the other clusters, s(i) = (b - a) / max(a, b), and 0 in a singleton and
    where both are 0 (coincident points).
    """
    x = [F.col(c) for c in cols]
    sq = sum((v * v for v in x[1:]), x[0] * x[0])
    stats = (df.groupBy(cluster)
             .agg(F.count(F.lit(1)).alias("n"), F.sum(sq).alias("q"),
                  *[F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)])
             .orderBy(cluster).collect())  # one row per cluster
    own = F.col(cluster)
    totals = {}
    for r in stats:
        dot = sum((v * F.lit(r[f"s{i}"]) for i, v in enumerate(x[1:], 1)), x[0] * F.lit(r["s0"]))
        totals[r[cluster]] = (r["n"], F.lit(r["n"]) * sq + F.lit(r["q"]) - 2 * dot)
    a = None
    for cid, (n, tot) in totals.items():
        e = F.when(own == F.lit(cid), tot / F.lit(max(n - 1, 1)))
        a = e if a is None else F.coalesce(a, e)
    others = [F.when(own != F.lit(cid), tot / F.lit(n)) for cid, (n, tot) in totals.items()]
    b = F.least(*others) if len(others) > 1 else others[0]
    n_own = fe.map_expr(cluster, {cid: n for cid, (n, _) in totals.items()})
    s = F.when(n_own > 1, F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))
               ).otherwise(F.lit(0.0))
    if len(totals) < 2:
        s = F.lit(None).cast("double")
    return df.agg(F.avg(s).alias("silhouette"))


# ---------------------------------------------------------------- E4
def project(df: DataFrame, k: int, features: str = "features") -> tuple[DataFrame, list[float]]:
    """PCA projections ``pc1..pck`` and explained-variance ratios.

    Component signs are fixed so each component's largest loading is positive.
    """
    model = PCA(k=k, inputCol=features, outputCol="_pc").fit(df)
    pcs = model.pc.toArray()
    signs = []
    for j in range(k):
        col = pcs[:, j]
        signs.append(-1.0 if col[abs(col).argmax()] < 0 else 1.0)
    out = model.transform(df).withColumn("_pa", vector_to_array("_pc"))
    out = out.withColumns({f"pc{j + 1}": F.col("_pa")[j] * F.lit(signs[j]) for j in range(k)})
    return out.drop("_pc", "_pa"), [float(v) for v in model.explainedVariance.toArray()]


# ---------------------------------------------------------------- E5, E6
def modes(df: DataFrame, group: str, cols: dict[str, str]) -> DataFrame:
    """Per group and entry of ``cols`` (name -> column): the most frequent value that
    is not NULL, the smallest on ties, as text; NULL without any.

    Counts per (group, column, value) come first and one aggregate picks the winners,
    so no buffer holds a group's values."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"),
                                        F.col(c).cast("string").alias("value"))
                               for name, c in cols.items()]))
    counts = (df.select(F.col(group), each.alias("v")).groupBy(group, "v.name", "v.value")
              .agg(F.count("v.value").alias("n")))
    return counts.groupBy(group).agg(*[
        F.min(F.when((F.col("name") == name) & (F.col("n") > 0),
                     F.struct((-F.col("n")).alias("less"), "value")))["value"].alias(name)
        for name in cols])


def profile_segments(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Per cluster: size, means, modes (ties: smallest; all NULL: Unknown), rates x100."""
    sub = fe.flag_expr(F.col("subscription_status") == "Yes")
    promo = fe.flag_expr(F.col("promo_code_used") == "Yes")
    climate = "climate_group_new" if "climate_group_new" in df.columns else "location"
    fit = ("climate_item_fit_score_new" if "climate_item_fit_score_new" in df.columns else None)
    rel = "rel_spend_cat_new" if "rel_spend_cat_new" in df.columns else "spend_per_purchase_new"
    found = df.groupBy(cluster).agg(
        F.count("customer_id").alias("n"),
        F.avg("age").alias("mean_age"),
        F.avg("purchase_amount_usd").alias("mean_amount"),
        (F.avg(sub) * 100).alias("sub_pct"),
        F.avg("previous_purchases").alias("mean_prev_purchases"),
        F.avg("review_rating").alias("mean_rating"),
        F.avg("frequency_value_new").alias("mean_freq"),
        (F.avg(promo) * 100).alias("promo_pct"),
        (F.avg(fit) if fit else F.avg(sub)).alias("fit_score"),
        F.avg(rel).alias("rel_spend"),
        F.avg("total_spend_weighted_new").alias("mean_weighted_spend"),
    )
    tops = modes(df, cluster, {"top_category": "category", "top_payment": "payment_method",
                               "top_shipping": "shipping_type", "top_climate": climate})
    tops = tops.select(F.col(cluster).alias("_c"), *[
        F.coalesce(c, F.lit("Unknown")).alias(c) for c in tops.columns if c != cluster])
    return attach(found, tops, {"_c": F.col(cluster)})


def label_segments(df: DataFrame, cluster: str = "cluster",
                   names: dict | None = None, actions: dict | None = None) -> DataFrame:
    """Attach segment name and suggested action; unknown ids get the defaults."""
    names = names if names is not None else L.SEGMENT_NAMES
    actions = actions if actions is not None else L.SEGMENT_ACTIONS
    return df.withColumns({
        "segment_name": fe.map_expr(cluster, names, L.DEFAULT_SEGMENT_NAME),
        "action": fe.map_expr(cluster, actions, L.DEFAULT_SEGMENT_ACTION),
    })


# ---------------------------------------------------------------- E7
def crm_summary(df: DataFrame, cluster: str = "cluster", names: dict | None = None
                ) -> DataFrame:
    """Per cluster: count, rates and means rounded half-even to 3 digits,
    subscription percent from the rounded rate (1 digit), and the name."""
    sub = fe.flag_expr(F.col("subscription_status") == "Yes")
    promo = fe.flag_expr(F.col("promo_code_used") == "Yes")
    names = names if names is not None else L.SEGMENT_NAMES

    def mean3(c):
        # decimal mean, then half-even: the tie rule applies to the true mean; 12
        # decimals leave 26 digits for the sum
        x = F.col(c) if isinstance(c, str) else c
        return F.bround(F.avg(x.cast("decimal(38,12)")), 3).cast("double")

    s = df.groupBy(cluster).agg(
        F.count("customer_id").alias("n_customers"),
        mean3(sub).alias("crm_target_rate"),
        mean3("total_spend_weighted_new").alias("avg_spend"),
        mean3("previous_purchases").alias("avg_prev_purchases"),
        mean3("frequency_value_new").alias("avg_freq"),
        mean3(promo).alias("promo_rate"))
    return s.withColumns({
        "segment": fe.map_expr(cluster, names),
        "subscription_pct": F.bround(F.col("crm_target_rate") * 100, 1),
    })


# ---------------------------------------------------------------- E8
def centroids_of(df: DataFrame, cols: Sequence[str], cluster: str = "cluster") -> dict:
    rows = df.groupBy(cluster).agg(*[F.avg(c).alias(c) for c in cols]).collect()
    return {r[cluster]: [r[c] for c in cols] for r in rows}


def nearest_centroid(cols: Sequence[str], centroids: dict) -> Column:
    """Id of the nearest centroid by squared distance; ties go to the smallest id."""
    cands = []
    for cid, ctr in sorted(centroids.items()):
        d = sum(((F.col(c) - F.lit(v)) ** 2 for c, v in zip(cols[1:], ctr[1:])),
                (F.col(cols[0]) - F.lit(ctr[0])) ** 2)
        cands.append(F.struct(d.alias("d"), F.lit(cid).alias("id")))
    return F.array_min(F.array(*cands))["id"]


def assign_segment(df: DataFrame, cols: Sequence[str], centroids: dict,
                   out: str = "segment") -> DataFrame:
    return df.withColumn(out, nearest_centroid(cols, centroids))
