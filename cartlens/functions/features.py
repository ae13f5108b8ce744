"""Column-level features: spend arithmetic, label maps, bins, crosses, flags.

Every function returns a new DataFrame built from native expressions, so the
whole feature chain stays inside one whole-stage-codegen span; no Python UDF.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lookups as L


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---------------------------------------------------------------- B2, B3, B10
def map_expr(col: str | Column, mapping: Mapping, default=None) -> Column:
    """Literal map lookup; keys absent from the map give ``default`` (NULL)."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    out = m[_c(col)]
    return out if default is None else F.coalesce(out, F.lit(default))


def climate_expr(location: str | Column) -> Column:
    """State to climate group; anything else (incl. ``Rare``, NULL) is Unknown."""
    mapping = {s: g for g, states in L.CLIMATE_GROUPS for s in states}
    return map_expr(location, mapping, default="Unknown")


# ---------------------------------------------------------------- B4-B7
def cut_expr(col: str | Column, edges: Sequence[float], labels: Sequence,
             include_lowest: bool = False) -> Column:
    """Right-closed bins ``(e[i], e[i+1]]``; outside values and NULL give NULL.

    With ``include_lowest`` the first bin is closed on the left too.
    """
    if len(labels) != len(edges) - 1:
        raise ValueError("labels must be one fewer than edges")
    x = _c(col)
    lo = x >= F.lit(edges[0]) if include_lowest else x > F.lit(edges[0])
    expr = None
    for i, lab in enumerate(labels):
        cond = (x <= F.lit(edges[i + 1])) & (lo if i == 0 else x > F.lit(edges[i]))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def exact_quantiles_multi(df: DataFrame, probs: dict[str, Sequence[float]],
                          accuracy: int = 10000, max_collect: int = 100000
                          ) -> dict[str, list[float]]:
    """Exact linear-interpolation quantiles for several columns.

    ``percentile`` keeps every value of a column in one aggregation buffer,
    which does not survive 100 TB. Instead:
      1. one scan gives each column's row count, ends and distinct estimate, and
         with ``percentile_approx`` a value bracket [a, b] around every wanted
         rank (its rank error is at most n / accuracy; a margin is added). The
         first and last rank are the ends themselves;
      2. while a bracket may hold more than ``max_collect`` distinct values, one
         scan counts the rows below and inside it and another narrows it by
         ``percentile_approx`` over the rows inside only (each round shrinks it
         about accuracy / 4-fold);
      3. one ``groupBy(value)`` collects the distinct values inside the final
         brackets with their counts, about ``max_collect`` rows per bracket at
         most, and the driver walks them.
    Every wanted rank is checked against the counts, so the result is exact.
    """
    cols = list(probs)
    margin = 2.0 / accuracy + 1e-9
    x = {c: F.col(c).cast("double") for c in cols}
    aggs = []
    for i, c in enumerate(cols):
        qs = [q for p in probs[c] for q in (max(0.0, p - margin), min(1.0, p + margin))]
        aggs += [F.count(x[c]).alias(f"n{i}"), F.min(x[c]).alias(f"lo{i}"),
                 F.max(x[c]).alias(f"hi{i}"), F.approx_count_distinct(x[c], 0.05).alias(f"d{i}"),
                 F.percentile_approx(x[c], F.array(*[F.lit(q) for q in qs]), accuracy)
                 .alias(f"q{i}")]
    st = df.agg(*aggs).first()

    out = {c: [float("nan")] * len(probs[c]) for c in cols}
    whole, targets = {}, []  # few distinct values: the whole column is one bracket
    for i, c in enumerate(cols):
        n = st[f"n{i}"]
        for k, p in enumerate(probs[c]):
            if not n:
                continue
            h = (n - 1) * p
            t = {"col": c, "k": k, "h": h, "r0": int(h // 1), "r1": min(int(-(-h // 1)), n - 1),
                 "lo": st[f"lo{i}"], "hi": st[f"hi{i}"]}
            if t["r1"] == 0:
                out[c][k] = st[f"lo{i}"]
            elif t["r0"] == n - 1:
                out[c][k] = st[f"hi{i}"]
            elif st[f"d{i}"] <= 0.8 * max_collect:
                t |= {"a": t["lo"], "b": t["hi"], "below": 0}
                whole.setdefault(c, []).append(t)
            else:
                t |= {"a": st[f"q{i}"][2 * k], "b": st[f"q{i}"][2 * k + 1]}
                targets.append(t)

    def inside(t):
        return (x[t["col"]] >= F.lit(t["a"])) & (x[t["col"]] <= F.lit(t["b"]))

    open_ = targets
    while open_:
        aggs = []
        for j, t in enumerate(open_):
            v = x[t["col"]]
            aggs += [F.count_if(v < F.lit(t["a"])).alias(f"b{j}"),
                     F.count_if(inside(t)).alias(f"m{j}"),
                     F.approx_count_distinct(F.when(inside(t), v), 0.05).alias(f"d{j}")]
        c = df.agg(*aggs).first()
        wide, aggs = [], []
        for j, t in enumerate(open_):
            t["below"], rows = c[f"b{j}"], c[f"m{j}"]
            if not (t["below"] <= t["r0"] and t["r1"] < t["below"] + rows):  # missed: start over
                t |= {"a": t["lo"], "b": t["hi"]}
                wide.append(t)
            elif c[f"d{j}"] > 0.8 * max_collect:
                lo_q = max(0.0, (t["r0"] - t["below"]) / max(rows - 1, 1) - margin)
                hi_q = min(1.0, (t["r1"] - t["below"]) / max(rows - 1, 1) + margin)
                t["narrow"] = len(aggs)
                aggs.append(F.percentile_approx(F.when(inside(t), x[t["col"]]), F.array(
                    F.lit(lo_q), F.lit(hi_q)), accuracy).alias(f"w{len(aggs)}"))
                wide.append(t)
        r = df.agg(*aggs).first() if aggs else None
        for t in wide:
            if (j := t.pop("narrow", None)) is not None:
                if r[f"w{j}"] == [t["a"], t["b"]]:
                    raise RuntimeError(f"quantile bracket of {t['col']} cannot be narrowed")
                t["a"], t["b"] = r[f"w{j}"]
        open_ = wide

    brackets = [(c, ts[0]["a"], ts[0]["b"], ts) for c, ts in whole.items()]
    brackets += [(t["col"], t["a"], t["b"], [t]) for t in targets]
    if not brackets:
        return out
    # each row meets the few brackets it lies in
    hits = F.filter(F.array(*[
        F.when((x[c] >= F.lit(a)) & (x[c] <= F.lit(b)),
               F.struct(F.lit(j).alias("j"), x[c].alias("v")))
        for j, (c, a, b, _) in enumerate(brackets)]), lambda e: e.isNotNull())
    values: dict[int, list] = {}
    for r in (df.select(F.explode(hits).alias("t")).groupBy("t.j", "t.v")
              .agg(F.count(F.lit(1)).alias("c")).collect()):
        values.setdefault(r["j"], []).append((r["v"], r["c"]))

    def value_at(rank, below, vals):
        acc = below
        for v, cnt in vals:
            acc += cnt
            if rank < acc:
                return v
        raise RuntimeError("rank outside its bracket")

    for j, (c, _, _, ts) in enumerate(brackets):
        vals = sorted(values[j])
        for t in ts:
            v0, v1 = (value_at(t[r], t["below"], vals) for r in ("r0", "r1"))
            out[c][t["k"]] = v0 + (t["h"] - t["r0"]) * (v1 - v0)
    return out


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float],
                    accuracy: int = 10000, max_collect: int = 100000) -> list[float]:
    """Exact quantiles of one column (see :func:`exact_quantiles_multi`)."""
    return exact_quantiles_multi(df, {col: list(probs)}, accuracy, max_collect)[col]


def qcut_edges_multi(df: DataFrame, cols: dict[str, int], exact: bool = True
                     ) -> dict[str, list[float]]:
    """Quantile bin edges for several columns in one set of scans;
    duplicate edges raise, as the analysed code does."""
    probs = {c: [i / q for i in range(q + 1)] for c, q in cols.items()}
    if exact:
        edges = exact_quantiles_multi(df, probs)
    else:
        row = df.agg(*[F.percentile_approx(c, F.array(*[F.lit(p) for p in ps]), 10000).alias(c)
                       for c, ps in probs.items()]).first()
        edges = {c: list(row[c]) if row[c] else [None] for c in probs}
    for c, e in edges.items():
        if any(x is None or x != x for x in e):
            raise ValueError(f"qcut: column {c} has no values")
        if len(set(e)) != len(e):
            raise ValueError(f"qcut: bin edges must be unique for {c}: {e}")
    return edges


def qcut_edges(df: DataFrame, col: str, q: int = 4, exact: bool = True) -> list[float]:
    return qcut_edges_multi(df, {col: q}, exact)[col]


# ---------------------------------------------------------------- B8, B9
def as_label(col: str | Column) -> Column:
    """Text form of a value; NULL prints as ``nan`` like the analysed code."""
    return F.coalesce(_c(col).cast("string"), F.lit("nan"))


def flag_expr(cond: Column) -> Column:
    """Boolean to 0/1 where NULL counts as false."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def target_expr(df: DataFrame, col: str = "subscription_status") -> Column:
    """Yes/No target to 1/0 (other labels NULL); 0 for all rows if absent."""
    if col not in df.columns:
        return F.lit(0)
    return map_expr(col, {"Yes": 1, "No": 0})


# ---------------------------------------------------------------- B12-B15
def drop_present(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    return df.drop(*[c for c in cols if c in df.columns])


def drop_prefixed(df: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(tuple(prefixes))])


def fill_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    present = [c for c in cols if c in df.columns]
    return df.na.fill(0.0, subset=present)


def domain(df: DataFrame, col: str) -> DataFrame:
    """Sorted distinct non-null values of a column."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)
