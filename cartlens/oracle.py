"""Oracle SQL (DuckDB dialect) for the registered queries.

Written directly in SQL over the base tables, independently of the Spark
code: ranks by window functions, quartiles by ``quantile_cont``, modes by
counting, pairwise sums by brute force where that is the clearest form.
Floating results are rounded to 6 decimals, as the Spark side does.
"""

from __future__ import annotations

from .sources.shop import SHOP_SQL

SHOP = f"shop AS ({SHOP_SQL})"

STRING_COLS = ["gender", "item_purchased", "category", "location", "size", "color",
               "season", "subscription_status", "shipping_type", "discount_applied",
               "promo_code_used", "payment_method", "frequency_of_purchases"]


def _rare(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN NULL "
            f"WHEN count(*) OVER (PARTITION BY {c}) / count(*) OVER () < 0.01 THEN 'Rare' "
            f"ELSE {c} END AS {c}")


RARE = ("rare AS (SELECT customer_id, age, purchase_amount_usd, review_rating, "
        "previous_purchases, " + ", ".join(_rare(c) for c in STRING_COLS) + " FROM shop)")

# Engineered table: rare labels collapsed, discount_applied dropped (its V
# against promo_code_used is checked separately by redundancy_check).
ENG = """
cuts AS (SELECT quantile_cont(purchase_amount_usd, [0, 0.25, 0.5, 0.75, 1]) AS qa,
                quantile_cont(previous_purchases, [0, 0.25, 0.5, 0.75, 1]) AS qp FROM rare),
top AS (SELECT location FROM rare WHERE location IS NOT NULL GROUP BY location
        ORDER BY count(*) DESC, location LIMIT 10),
base AS (
  SELECT r.*, CASE subscription_status WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS t,
         CASE WHEN promo_code_used = 'Yes' THEN 1 ELSE 0 END AS promo,
         CAST(CASE frequency_of_purchases WHEN 'Weekly' THEN 52 WHEN 'Bi-Weekly' THEN 26
              WHEN 'Fortnightly' THEN 26 WHEN 'Quarterly' THEN 4 WHEN 'Annually' THEN 1
              WHEN 'Monthly' THEN 12 WHEN 'Every 3 Months' THEN 4 END AS DOUBLE) AS fv,
         CAST(CASE WHEN previous_purchases >= qp[1] AND previous_purchases <= qp[2] THEN 1
              WHEN previous_purchases > qp[2] AND previous_purchases <= qp[3] THEN 2
              WHEN previous_purchases > qp[3] AND previous_purchases <= qp[4] THEN 3
              WHEN previous_purchases > qp[4] AND previous_purchases <= qp[5] THEN 4 END AS INTEGER) AS ls,
         CASE WHEN purchase_amount_usd >= qa[1] AND purchase_amount_usd <= qa[2] THEN 'Low'
              WHEN purchase_amount_usd > qa[2] AND purchase_amount_usd <= qa[3] THEN 'Mid'
              WHEN purchase_amount_usd > qa[3] AND purchase_amount_usd <= qa[4] THEN 'High'
              WHEN purchase_amount_usd > qa[4] AND purchase_amount_usd <= qa[5] THEN 'Very High' END AS amt_bin
  FROM rare r, cuts),
eng AS (
  SELECT customer_id, age, gender, item_purchased, category, purchase_amount_usd, location,
         size, color, season, review_rating, subscription_status, shipping_type,
         promo_code_used, previous_purchases, payment_method, frequency_of_purchases,
         previous_purchases * purchase_amount_usd AS total_spend_weighted_new,
         purchase_amount_usd / (previous_purchases + 1) AS spend_per_purchase_new,
         fv AS frequency_value_new,
         CASE payment_method WHEN 'Cash' THEN 'Cash' WHEN 'Credit Card' THEN 'Card'
              WHEN 'Debit Card' THEN 'Card' WHEN 'PayPal' THEN 'Online' WHEN 'Venmo' THEN 'Online'
              WHEN 'Bank Transfer' THEN 'Online' END AS payment_type_new,
         CASE WHEN age > 0 AND age <= 30 THEN '18-30' WHEN age > 30 AND age <= 45 THEN '31-45'
              WHEN age > 45 AND age <= 56 THEN '46-56' WHEN age > 56 AND age <= 200 THEN '57-70' END AS age_new,
         amt_bin AS purchase_amount_usd_new,
         CASE WHEN previous_purchases >= 0 AND previous_purchases <= 13 THEN 'Low'
              WHEN previous_purchases > 13 AND previous_purchases <= 25 THEN 'Mid'
              WHEN previous_purchases > 25 AND previous_purchases <= 38 THEN 'High'
              WHEN previous_purchases > 38 AND previous_purchases <= 200 THEN 'Very High' END AS loyalty_level_new,
         coalesce(CAST(t AS VARCHAR), 'nan') || '_' || coalesce(frequency_of_purchases, 'nan') AS sub_freq_new,
         CAST(coalesce(promo_code_used = 'Yes' AND t = 0, false) AS INTEGER) AS promo_no_sub_new,
         coalesce(shipping_type, 'nan') || '_' || coalesce(CAST(t AS VARCHAR), 'nan') AS ship_sub_new,
         coalesce(season, 'nan') || '_' || coalesce(category, 'nan') AS season_category_new,
         coalesce(season, 'nan') || '_' || coalesce(color, 'nan') AS season_color_new,
         coalesce(category, 'nan') || '_' || coalesce(item_purchased, 'nan') AS item_category_new,
         CAST(coalesce(review_rating >= 4, false) AS INTEGER) AS high_review_rating_new,
         purchase_amount_usd * review_rating AS spend_rating_new,
         CASE WHEN location IN (SELECT location FROM top) THEN location ELSE 'Other' END AS location_grouped_new,
         CASE WHEN location IN ('Alaska','North Dakota','South Dakota','Minnesota','Wisconsin','Michigan',
                                'Montana','Wyoming','Maine','Vermont','New Hampshire') THEN 'Cold'
              WHEN location IN ('Massachusetts','Connecticut','Rhode Island','New York','Pennsylvania',
                                'New Jersey','Ohio','Indiana','Illinois','Iowa','Nebraska','Kansas',
                                'Colorado','Utah','Idaho','Washington','Oregon') THEN 'Cool'
              WHEN location IN ('Virginia','Maryland','Delaware','Kentucky','Missouri','West Virginia',
                                'North Carolina','Tennessee','Arkansas','Oklahoma') THEN 'Warm'
              WHEN location IN ('Florida','Texas','Louisiana','Mississippi','Alabama','Georgia',
                                'South Carolina','Arizona','Nevada','New Mexico','California') THEN 'Hot'
              WHEN location = 'Hawaii' THEN 'Tropical' ELSE 'Unknown' END AS climate_group_new,
         ls AS loyalty_score_new,
         promo * ls AS promo_x_loyalty,
         CAST(promo AS DOUBLE) * fv AS promo_x_freq
  FROM base)
"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


W_SHOP = with_ctes(SHOP)
W_RARE = with_ctes(SHOP, RARE)
W_ENG = with_ctes(SHOP, RARE, ENG.strip())

ORACLE: dict[str, str] = {}

ORACLE["shop_scan"] = W_SHOP + "SELECT * FROM shop"
ORACLE["csv_scan"] = W_SHOP + """SELECT * REPLACE (
  CASE WHEN customer_id % 7 = 0 THEN 'say "x", ' || item_purchased ELSE item_purchased END
    AS item_purchased,
  CASE WHEN customer_id % 5 = 0 THEN color || chr(10) || 'side, two' ELSE color END AS color,
  CASE WHEN customer_id % 11 = 0 THEN NULL ELSE category END AS category,
  CASE WHEN customer_id % 19 = 0 THEN NULL ELSE size END AS size,
  CASE WHEN customer_id % 13 = 0 THEN NULL ELSE age END AS age,
  CASE WHEN customer_id % 17 = 0 THEN NULL ELSE previous_purchases END AS previous_purchases)
FROM shop"""
ORACLE["header_normalize"] = W_SHOP + "SELECT * FROM shop"
ORACLE["numeric_coercion"] = W_SHOP + "SELECT * FROM shop"
ORACLE["rare_collapse"] = W_RARE + "SELECT * FROM rare"

ORACLE["redundancy_check"] = W_RARE + """,
cells AS (SELECT discount_applied AS a, promo_code_used AS b, count(*) AS o FROM rare
          WHERE discount_applied IS NOT NULL AND promo_code_used IS NOT NULL GROUP BY 1, 2),
ra AS (SELECT a, sum(o) AS rt FROM cells GROUP BY a),
cb AS (SELECT b, sum(o) AS ct FROM cells GROUP BY b),
tot AS (SELECT sum(o) AS n, (SELECT count(*) FROM ra) AS r, (SELECT count(*) FROM cb) AS k FROM cells),
grid AS (SELECT ra.a, cb.b, ra.rt, cb.ct, coalesce(cells.o, 0) AS o FROM ra CROSS JOIN cb
         LEFT JOIN cells ON cells.a = ra.a AND cells.b = cb.b),
chi AS (SELECT sum(CASE WHEN tot.r = 2 AND tot.k = 2
                    THEN power(abs(o - rt * ct / n) - least(0.5, abs(o - rt * ct / n)), 2) / (rt * ct / n)
                    ELSE power(o - rt * ct / n, 2) / (rt * ct / n) END) AS chi2,
               any_value(tot.n) AS n, any_value(tot.r) AS r, any_value(tot.k) AS k
        FROM grid, tot)
SELECT round(chi2, 6) AS chi2, CAST(n AS BIGINT) AS n, CAST(r AS BIGINT) AS r, CAST(k AS BIGINT) AS k,
       round(CASE WHEN r < 2 OR k < 2 THEN 0.0 ELSE sqrt(chi2 / (n * (least(r, k) - 1))) END, 6) AS cramers_v,
       CASE WHEN r < 2 OR k < 2 THEN false ELSE sqrt(chi2 / (n * (least(r, k) - 1))) > 0.8 END AS drop_discount
FROM chi
"""

ORACLE["engineered_features"] = W_ENG + "SELECT * FROM eng"

ORACLE["rate_by_category"] = W_SHOP + """
SELECT category, round(avg(CASE WHEN subscription_status = 'Yes' THEN 1.0 ELSE 0.0 END) * 100, 6) AS subscribed_pct
FROM shop WHERE category IS NOT NULL GROUP BY category
"""

ORACLE["rate_by_category_prepared"] = W_ENG + """
SELECT category, round(avg(CASE WHEN subscription_status = 'Yes' THEN 1.0 ELSE 0.0 END) * 100, 6) AS subscribed_pct
FROM eng WHERE category IS NOT NULL GROUP BY category
"""


def _eng_subset(*cols):
    return W_ENG + "SELECT customer_id, " + ", ".join(cols) + " FROM eng"


ORACLE["spend_features"] = _eng_subset(
    "total_spend_weighted_new", "spend_per_purchase_new", "spend_rating_new")
ORACLE["label_maps"] = _eng_subset("frequency_value_new", "payment_type_new", "climate_group_new")
ORACLE["fixed_bins"] = _eng_subset("age_new", "loyalty_level_new")
ORACLE["quantile_bins"] = _eng_subset("purchase_amount_usd_new", "loyalty_score_new")
ORACLE["label_crosses"] = _eng_subset(
    "season_category_new", "season_color_new", "item_category_new", "sub_freq_new", "ship_sub_new")
ORACLE["flags"] = _eng_subset("high_review_rating_new", "promo_no_sub_new")
ORACLE["promo_interactions"] = _eng_subset("promo_x_loyalty", "promo_x_freq")
ORACLE["location_grouping"] = _eng_subset("location", "location_grouped_new")

ORACLE["drop_leakage"] = W_ENG + """
SELECT gender, category, total_spend_weighted_new, spend_per_purchase_new, frequency_value_new,
       payment_type_new, age_new, purchase_amount_usd_new, loyalty_level_new, season_category_new,
       season_color_new, item_category_new, high_review_rating_new, spend_rating_new,
       location_grouped_new, climate_group_new, loyalty_score_new, promo_x_loyalty, promo_x_freq
FROM eng"""

ORACLE["segment_inputs_filled"] = W_ENG + """
SELECT customer_id, coalesce(purchase_amount_usd, 0) AS purchase_amount_usd,
       coalesce(previous_purchases, 0) AS previous_purchases,
       coalesce(frequency_value_new, 0) AS frequency_value_new,
       coalesce(spend_per_purchase_new, 0) AS spend_per_purchase_new,
       coalesce(total_spend_weighted_new, 0) AS total_spend_weighted_new
FROM eng"""

ORACLE["subscribed_customers"] = W_SHOP + """
SELECT customer_id, purchase_amount_usd FROM shop WHERE subscription_status = 'Yes'"""

ORACLE["category_domain"] = W_SHOP + """
SELECT DISTINCT category FROM shop WHERE category IS NOT NULL"""

ORACLE["value_counts"] = W_SHOP + """,
long AS (SELECT 'gender' AS column_name, gender AS value FROM shop
         UNION ALL SELECT 'subscription_status', subscription_status FROM shop
         UNION ALL SELECT 'size', size FROM shop
         UNION ALL SELECT 'category', category FROM shop),
c AS (SELECT column_name, value, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT column_name, value, n, round(n * 100.0 / sum(n) OVER (PARTITION BY column_name), 6) AS pct FROM c
"""

ORACLE["top_locations"] = W_SHOP + """
SELECT location, count(*) AS n FROM shop WHERE location IS NOT NULL
GROUP BY location ORDER BY n DESC, location LIMIT 10"""

ORACLE["contingency_discount_promo"] = W_SHOP + """,
a AS (SELECT DISTINCT discount_applied FROM shop WHERE discount_applied IS NOT NULL AND promo_code_used IS NOT NULL),
b AS (SELECT DISTINCT promo_code_used FROM shop WHERE discount_applied IS NOT NULL AND promo_code_used IS NOT NULL),
c AS (SELECT discount_applied, promo_code_used, count(*) AS n FROM shop GROUP BY 1, 2)
SELECT a.discount_applied, b.promo_code_used, coalesce(c.n, 0) AS n
FROM a CROSS JOIN b LEFT JOIN c ON c.discount_applied = a.discount_applied AND c.promo_code_used = b.promo_code_used
"""


def _crosstab(a, b, names):
    return W_SHOP + f"""
SELECT {a},
       round(100.0 * count(*) FILTER (WHERE {b} = 'No') / count(*), 6) AS {names[0]},
       round(100.0 * count(*) FILTER (WHERE {b} = 'Yes') / count(*), 6) AS {names[1]}
FROM shop WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY {a}"""


ORACLE["crosstab_discount_promo"] = _crosstab(
    "discount_applied", "promo_code_used", ["promo_no_pct", "promo_yes_pct"])
ORACLE["crosstab_promo_subscription"] = _crosstab(
    "promo_code_used", "subscription_status", ["sub_no_pct", "sub_yes_pct"])
ORACLE["crosstab_gender_subscription"] = _crosstab(
    "gender", "subscription_status", ["sub_no_pct", "sub_yes_pct"])

ORACLE["kpis"] = W_SHOP + """
SELECT count(*) AS n_customers, round(avg(age), 6) AS mean_age,
       round(avg(CASE WHEN subscription_status = 'Yes' THEN 1.0 ELSE 0.0 END) * 100, 6) AS subscription_pct,
       round(avg(previous_purchases * purchase_amount_usd), 6) AS mean_weighted_spend,
       round(avg(previous_purchases), 6) AS mean_previous_purchases,
       round(avg(review_rating), 6) AS mean_rating
FROM shop"""

ORACLE["amount_density"] = W_SHOP + """,
s AS (SELECT subscription_status AS st, count(*) AS n, stddev_samp(purchase_amount_usd) AS sd,
             min(purchase_amount_usd) AS lo, max(purchase_amount_usd) AS hi
      FROM shop WHERE subscription_status IS NOT NULL AND purchase_amount_usd IS NOT NULL GROUP BY 1),
b AS (SELECT st, n, power(n, -0.2) * sd AS bw, lo, hi FROM s),
g AS (SELECT st, n, bw, i, (lo - 3 * bw) + i * ((hi - lo + 6 * bw) / 199) AS x
      FROM b, range(200) t(i))
SELECT g.st AS subscription_status, CAST(g.i AS INTEGER) AS point, round(g.x, 6) AS x,
       round(sum(exp(-0.5 * power((g.x - shop.purchase_amount_usd) / g.bw, 2))) / (any_value(g.n) * any_value(g.bw) * sqrt(2 * pi())), 12) AS density
FROM g JOIN shop ON shop.subscription_status = g.st AND shop.purchase_amount_usd IS NOT NULL
GROUP BY g.st, g.i, g.x
"""


SPLIT = """
cls AS (SELECT subscription_status AS c, count(*) AS nc FROM eng GROUP BY 1),
tot AS (SELECT sum(nc) AS n, CAST(ceil(0.2 * sum(nc)) AS BIGINT) AS n_test FROM cls),
alloc AS (SELECT c, nc, nc * (n - n_test) / n AS ex, floor(nc * (n - n_test) / n) AS fl FROM cls, tot),
extra AS (SELECT c, row_number() OVER (ORDER BY ex - fl DESC, c) AS pos FROM alloc),
trn AS (SELECT a.c, a.nc,
               a.fl + CASE WHEN e.pos <= (SELECT n - n_test FROM tot) - (SELECT sum(fl) FROM alloc)
                           THEN 1 ELSE 0 END AS n_train
        FROM alloc a JOIN extra e ON e.c = a.c),
ranked AS (SELECT e.*, row_number() OVER (PARTITION BY subscription_status
             ORDER BY md5('42:' || CAST(customer_id AS VARCHAR)), customer_id) AS rk FROM eng e),
split AS (SELECT ranked.* EXCLUDE (rk), rk <= trn.nc - trn.n_train AS is_test
          FROM ranked JOIN trn ON trn.c = ranked.subscription_status),
train AS (SELECT * EXCLUDE (is_test) FROM split WHERE NOT is_test),
test AS (SELECT * EXCLUDE (is_test) FROM split WHERE is_test)"""

W_SPLIT = W_ENG.rstrip() + ",\n" + SPLIT.strip() + "\n"

ORACLE["stratified_split"] = W_SPLIT + "SELECT customer_id, subscription_status, is_test FROM split"

ORACLE["conditional_probs"] = W_SPLIT + """,
pc AS (SELECT climate_group_new AS g, category AS c, count(*) AS n FROM train
       WHERE climate_group_new IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2),
gt AS (SELECT g, sum(n) AS tot FROM pc GROUP BY g),
k AS (SELECT count(DISTINCT c) AS k FROM pc)
SELECT pc.g AS climate_group_new, pc.c AS category, round((n + 1.0) / (tot + 1.0 * k), 6) AS p
FROM pc JOIN gt ON gt.g = pc.g, k"""


def _cond(cat: str, name: str) -> str:
    """CTEs computing P(cat | climate) for test rows, filled by the train mean."""
    return f"""
pc_{name} AS (SELECT climate_group_new AS g, {cat} AS c, count(*) AS n FROM train
       WHERE climate_group_new IS NOT NULL AND {cat} IS NOT NULL GROUP BY 1, 2),
gt_{name} AS (SELECT g, sum(n) AS tot FROM pc_{name} GROUP BY g),
k_{name} AS (SELECT count(DISTINCT c) AS k FROM pc_{name}),
tr_{name} AS (SELECT avg((pc.n + 1.0) / (gt.tot + k)) AS m FROM train t
       JOIN pc_{name} pc ON pc.g = t.climate_group_new AND pc.c = t.{cat}
       JOIN gt_{name} gt ON gt.g = t.climate_group_new, k_{name}),
te_{name} AS (SELECT t.customer_id,
       CASE WHEN gt.tot IS NOT NULL AND t.{cat} IN (SELECT c FROM pc_{name})
            THEN (coalesce(pc.n, 0) + 1.0) / (gt.tot + k) ELSE (SELECT m FROM tr_{name}) END AS p
       FROM test t LEFT JOIN pc_{name} pc ON pc.g = t.climate_group_new AND pc.c = t.{cat}
       LEFT JOIN gt_{name} gt ON gt.g = t.climate_group_new, k_{name})"""


ORACLE["conditional_probs_applied"] = W_SPLIT + "," + ",".join(
    _cond(c, n) for c, n in [("category", "cat"), ("size", "size"), ("season", "season")]) + """
SELECT a.customer_id, round(a.p, 6) AS p_category_given_climate_new,
       round(b.p, 6) AS p_size_given_climate_new, round(c.p, 6) AS p_season_given_climate_new,
       round(a.p * b.p * c.p, 9) AS climate_item_fit_score_new
FROM te_cat a JOIN te_size b ON a.customer_id = b.customer_id
JOIN te_season c ON a.customer_id = c.customer_id"""


def _ratio(group: str, value: str, name: str) -> str:
    return f"""
gm_{name} AS (SELECT {group} AS g, avg({value}) AS m FROM train WHERE {group} IS NOT NULL GROUP BY 1),
r_{name} AS (
  SELECT s.customer_id, s.is_test,
         CASE WHEN gm.m IS NULL AND s.is_test THEN s.{value} / (SELECT avg({value}) FROM train)
              WHEN gm.m IS NULL OR gm.m = 0 THEN NULL
              ELSE s.{value} / gm.m END AS v
  FROM split s LEFT JOIN gm_{name} gm ON gm.g = s.{group})"""


ORACLE["group_mean_ratios"] = W_SPLIT + "," + ",".join([
    _ratio("category", "purchase_amount_usd", "a"),
    _ratio("climate_group_new", "purchase_amount_usd", "b"),
    _ratio("age_new", "purchase_amount_usd", "c"),
    _ratio("climate_group_new", "frequency_value_new", "d")]) + """
SELECT a.customer_id, a.is_test, round(a.v, 6) AS rel_spend_cat_new,
       round(b.v, 6) AS purchase_amt_rel_climate_new, round(c.v, 6) AS rel_spend_age_new,
       round(d.v, 6) AS rel_freq_climate_new
FROM r_a a JOIN r_b b ON a.customer_id = b.customer_id JOIN r_c c ON a.customer_id = c.customer_id
JOIN r_d d ON a.customer_id = d.customer_id"""

_OH = ["gender", "category", "payment_type_new", "age_new", "purchase_amount_usd_new",
       "loyalty_level_new", "season_category_new", "season_color_new", "item_category_new",
       "location_grouped_new", "climate_group_new"]
ORACLE["one_hot_levels"] = W_SPLIT + """,
lv AS (""" + "\n UNION ".join(
    f"SELECT DISTINCT '{c}' AS column_name, {c} AS level FROM train WHERE {c} IS NOT NULL" for c in _OH) + """)
SELECT column_name, level, CAST(row_number() OVER (PARTITION BY column_name ORDER BY level) - 1 AS INTEGER) AS slot
FROM lv"""

ORACLE["class_weights"] = W_SPLIT + """
SELECT subscription_status, count(*) AS n,
       round((SELECT count(*) FROM train) / ((SELECT count(DISTINCT subscription_status) FROM train) * count(*)), 6) AS weight
FROM train GROUP BY subscription_status"""

_STD = ["total_spend_weighted_new", "spend_per_purchase_new", "frequency_value_new",
        "spend_rating_new", "loyalty_score_new"]
ORACLE["standardized_features"] = W_SPLIT + """,
st AS (SELECT """ + ", ".join(
    f"avg({c}) AS m_{c}, CASE WHEN coalesce(stddev_pop({c}), 0) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}"
    for c in _STD) + """ FROM train)
SELECT customer_id, """ + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS z_{c}" for c in _STD) + """
FROM test, st"""


SCORED = """scored AS (SELECT customer_id,
       CASE WHEN subscription_status = 'Yes' THEN 1 ELSE 0 END AS label,
       ((customer_id * 7919) % 1000) / 1000.0 AS score FROM shop)"""
W_SCORED = with_ctes(SHOP, SCORED)

ORACLE["confusion_matrix"] = W_SCORED + """
SELECT count(*) FILTER (WHERE label = 0 AND score < 0.5) AS tn,
       count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS fp,
       count(*) FILTER (WHERE label = 1 AND score < 0.5) AS fn,
       count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp FROM scored"""

ORACLE["binary_metrics"] = W_SCORED + """,
c AS (SELECT count(*) FILTER (WHERE label = 0 AND score < 0.5) AS tn,
       count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS fp,
       count(*) FILTER (WHERE label = 1 AND score < 0.5) AS fn,
       count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp FROM scored)
SELECT tn, fp, fn, tp,
       round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
       round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1,
       round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM c"""

# AUC by brute force over all (positive, negative) pairs: ties count half.
ORACLE["roc_auc"] = W_SCORED + """
SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END), 6) AS auc
FROM scored p JOIN scored n ON p.label = 1 AND n.label = 0"""

ORACLE["roc_curve"] = W_SCORED + """,
d AS (SELECT DISTINCT score FROM scored),
tot AS (SELECT sum(label) AS P, sum(1 - label) AS N FROM scored)
SELECT CAST('Infinity' AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr
UNION ALL
SELECT d.score, round(sum(1 - s.label) / any_value(N), 6), round(sum(s.label) / any_value(P), 6)
FROM d JOIN scored s ON s.score >= d.score, tot GROUP BY d.score"""

SWEEP = """sweep AS (
  SELECT t.i * 5 / 100 AS threshold,
         count(*) FILTER (WHERE label = 1 AND score >= t.i * 5 / 100) AS tp,
         count(*) FILTER (WHERE label = 0 AND score >= t.i * 5 / 100) AS fp,
         count(*) FILTER (WHERE label = 1 AND score < t.i * 5 / 100) AS fn
  FROM range(1, 20) t(i), scored GROUP BY t.i),
sweep_m AS (SELECT threshold, tp, fp, fn,
         CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision,
         CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall,
         CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM sweep),
best AS (SELECT threshold, precision, recall, f1 FROM sweep_m WHERE recall >= 0.85
         ORDER BY precision DESC, threshold LIMIT 1)"""
W_SWEEP = with_ctes(SHOP, SCORED, SWEEP)

ORACLE["threshold_sweep"] = W_SWEEP + """
SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       tp, fp, fn FROM sweep_m"""

ORACLE["best_threshold"] = W_SWEEP + """
SELECT coalesce(b.threshold, 0.5) AS threshold, round(b.precision, 6) AS precision,
       round(b.recall, 6) AS recall, round(b.f1, 6) AS f1, b.threshold IS NOT NULL AS found
FROM (SELECT 1) one LEFT JOIN best b ON true"""

ORACLE["classification_report"] = W_SWEEP + """,
thr AS (SELECT coalesce((SELECT threshold FROM best), 0.5) AS t),
c AS (SELECT count(*) FILTER (WHERE label = 0 AND score < t) AS tn,
             count(*) FILTER (WHERE label = 0 AND score >= t) AS fp,
             count(*) FILTER (WHERE label = 1 AND score < t) AS fn,
             count(*) FILTER (WHERE label = 1 AND score >= t) AS tp FROM scored, thr),
m AS (SELECT tn + fp + fn + tp AS n, tn + fp AS s0, tp + fn AS s1,
             CASE WHEN tn + fn = 0 THEN 0 ELSE tn / (tn + fn) END AS p0,
             CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END AS r0,
             CASE WHEN 2 * tn + fn + fp = 0 THEN 0 ELSE 2 * tn / (2 * tn + fn + fp) END AS f0,
             CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p1,
             CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS r1,
             CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1,
             (tp + tn) / (tn + fp + fn + tp) AS acc FROM c)
SELECT 'No' AS row_label, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1_score, CAST(s0 AS DOUBLE) AS support FROM m
UNION ALL SELECT 'Yes', round(p1, 6), round(r1, 6), round(f1, 6), CAST(s1 AS DOUBLE) FROM m
UNION ALL SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), CAST(n AS DOUBLE) FROM m
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), CAST(n AS DOUBLE) FROM m
UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / n, 6), round((r0 * s0 + r1 * s1) / n, 6),
                 round((f0 * s0 + f1 * s1) / n, 6), CAST(n AS DOUBLE) FROM m"""

ORACLE["model_leaders"] = W_SHOP + """,
s AS (SELECT CASE WHEN subscription_status = 'Yes' THEN 1 ELSE 0 END AS label,
             ((customer_id * 7919) % 1000) / 1000.0 AS s_hash,
             CASE WHEN promo_code_used = 'Yes' THEN 0.6 ELSE 0.3 END + ((customer_id * 31) % 100) / 1000.0 AS s_promo,
             CASE WHEN discount_applied = 'Yes' THEN 0.55 ELSE 0.35 END + ((customer_id * 17) % 100) / 1000.0 AS s_discount
      FROM shop),
l AS (SELECT 'hash' AS model, 0 AS pos, label, s_hash AS score FROM s
      UNION ALL SELECT 'promo', 1, label, s_promo FROM s
      UNION ALL SELECT 'discount', 2, label, s_discount FROM s),
f AS (SELECT model, pos,
             count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp,
             count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS fp,
             count(*) FILTER (WHERE label = 1 AND score < 0.5) AS fn FROM l GROUP BY model, pos),
f1 AS (SELECT model, pos, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1 FROM f),
auc AS (SELECT p.model, avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END) AS auc
        FROM l p JOIN l n ON p.model = n.model AND p.label = 1 AND n.label = 0 GROUP BY p.model),
r AS (SELECT f1.model, f1.pos, f1.f1, auc.auc FROM f1 JOIN auc ON auc.model = f1.model)
SELECT (SELECT model FROM r ORDER BY f1 DESC, pos LIMIT 1) AS best_f1_model,
       (SELECT model FROM r ORDER BY auc DESC, pos LIMIT 1) AS best_auc_model"""


_SEG = ["purchase_amount_usd", "previous_purchases", "frequency_value_new",
        "spend_per_purchase_new", "total_spend_weighted_new"]
ZMAT = """rep AS (SELECT *, CAST(customer_id % 5 AS INTEGER) AS cluster FROM eng),
filled AS (SELECT customer_id, cluster, """ + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _SEG) + """ FROM rep),
zst AS (SELECT """ + ", ".join(
    f"avg({c}) AS m_{c}, CASE WHEN coalesce(stddev_pop({c}), 0) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}"
    for c in _SEG) + """ FROM filled),
z AS (SELECT customer_id, cluster, """ + ", ".join(f"({c} - m_{c}) / s_{c} AS z_{c}" for c in _SEG) + """
      FROM filled, zst)"""
W_Z = W_ENG.rstrip() + ",\n" + ZMAT + "\n"

ORACLE["segment_matrix"] = W_Z + "SELECT customer_id, " + ", ".join(
    f"round(z_{c}, 6) AS z_{c}" for c in _SEG) + " FROM z"

_D2 = " + ".join(f"power(a.z_{c} - b.z_{c}, 2)" for c in _SEG)
ORACLE["silhouette"] = W_Z + f""",
pairs AS (SELECT a.customer_id AS i, a.cluster AS ca, b.cluster AS cb, {_D2} AS d
          FROM z a JOIN z b ON a.customer_id <> b.customer_id),
per AS (SELECT i, ca, cb, avg(d) AS md FROM pairs GROUP BY i, ca, cb),
sizes AS (SELECT cluster, count(*) AS n FROM z GROUP BY cluster),
ab AS (SELECT z.customer_id, z.cluster,
              (SELECT md FROM per WHERE per.i = z.customer_id AND per.cb = z.cluster) AS a,
              (SELECT min(md) FROM per WHERE per.i = z.customer_id AND per.cb <> z.cluster) AS b
       FROM z)
SELECT round(avg(CASE WHEN s.n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette
FROM ab JOIN sizes s ON s.cluster = ab.cluster"""


def _mode(col: str, name: str) -> str:
    return f"""md_{name} AS (SELECT cluster, v FROM (
  SELECT cluster, {col} AS v, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, {col}) AS rn
  FROM rep WHERE {col} IS NOT NULL GROUP BY cluster, {col}) WHERE rn = 1)"""


_NAME_CASE = ("CASE cluster WHEN 3 THEN 'VIP''e En Yakınlar' WHEN 0 THEN 'Avantaj Avcıları' "
              "WHEN 2 THEN 'Büyük Sepetliler' WHEN 4 THEN 'Kararsızlar' WHEN 1 THEN 'Sessiz Kitle' ")
_ACTION_CASE = ("CASE cluster WHEN 3 THEN 'Upsell / Premium' WHEN 0 THEN 'Upsell / Premium' "
                "WHEN 2 THEN 'Nurture / Education' WHEN 4 THEN 'Winback / Aggressive Promo' "
                "WHEN 1 THEN 'Winback / Aggressive Promo' ")
W_REP = W_ENG.rstrip() + ",\nrep AS (SELECT *, CAST(customer_id % 5 AS INTEGER) AS cluster FROM eng)\n"

ORACLE["segment_profile"] = W_REP + "," + ",".join([
    _mode("category", "cat"), _mode("payment_method", "pay"), _mode("shipping_type", "ship"),
    _mode("climate_group_new", "clim")]) + """,
agg AS (SELECT cluster, count(customer_id) AS n, avg(age) AS mean_age, avg(purchase_amount_usd) AS mean_amount,
               avg(CASE WHEN subscription_status = 'Yes' THEN 1 ELSE 0 END) * 100 AS sub_pct,
               avg(previous_purchases) AS mean_prev_purchases, avg(review_rating) AS mean_rating,
               avg(frequency_value_new) AS mean_freq,
               avg(CASE WHEN promo_code_used = 'Yes' THEN 1 ELSE 0 END) * 100 AS promo_pct,
               avg(CASE WHEN subscription_status = 'Yes' THEN 1 ELSE 0 END) AS fit_score,
               avg(spend_per_purchase_new) AS rel_spend, avg(total_spend_weighted_new) AS mean_weighted_spend
        FROM rep GROUP BY cluster)
SELECT agg.cluster, n, round(mean_age, 6) AS mean_age, round(mean_amount, 6) AS mean_amount,
       round(sub_pct, 6) AS sub_pct, round(mean_prev_purchases, 6) AS mean_prev_purchases,
       round(mean_rating, 6) AS mean_rating, round(mean_freq, 6) AS mean_freq,
       round(promo_pct, 6) AS promo_pct, round(fit_score, 6) AS fit_score,
       round(rel_spend, 6) AS rel_spend, round(mean_weighted_spend, 6) AS mean_weighted_spend,
       coalesce(c.v, 'Unknown') AS top_category, coalesce(p.v, 'Unknown') AS top_payment,
       coalesce(s.v, 'Unknown') AS top_shipping, coalesce(k.v, 'Unknown') AS top_climate,
       """ + _NAME_CASE.replace("cluster", "agg.cluster") + """ELSE 'Genel Segment' END AS segment_name,
       """ + _ACTION_CASE.replace("cluster", "agg.cluster") + """ELSE 'Genel' END AS action
FROM agg LEFT JOIN md_cat c ON c.cluster = agg.cluster LEFT JOIN md_pay p ON p.cluster = agg.cluster
LEFT JOIN md_ship s ON s.cluster = agg.cluster LEFT JOIN md_clim k ON k.cluster = agg.cluster"""

def _exact3(name: str) -> str:
    """Half-even rounding to 3 decimals of the exact mean, by integer arithmetic
    on values scaled by 10^4 (all inputs here have at most 4 decimals)."""
    return (f"CAST((s_{name} // (10 * n_{name}) + CASE "
            f"WHEN 2 * (s_{name} % (10 * n_{name})) > 10 * n_{name} THEN 1 "
            f"WHEN 2 * (s_{name} % (10 * n_{name})) = 10 * n_{name} THEN (s_{name} // (10 * n_{name})) % 2 "
            f"ELSE 0 END) AS DOUBLE) / 1000.0 AS {name}")


_CRM = {"crm_target_rate": "CASE WHEN subscription_status = 'Yes' THEN 1 ELSE 0 END",
        "avg_spend": "total_spend_weighted_new", "avg_prev_purchases": "previous_purchases",
        "avg_freq": "frequency_value_new",
        "promo_rate": "CASE WHEN promo_code_used = 'Yes' THEN 1 ELSE 0 END"}
ORACLE["crm_summary"] = W_REP + """,
s AS (SELECT cluster, count(customer_id) AS n_customers, """ + ", ".join(
    f"sum(CAST(round(({e}) * 10000) AS HUGEINT)) AS s_{k}, count({e}) AS n_{k}" for k, e in _CRM.items()) + """
      FROM rep GROUP BY cluster),
r AS (SELECT cluster, n_customers, """ + ", ".join(_exact3(k) for k in _CRM) + """ FROM s)
SELECT *, """ + _NAME_CASE + """END AS segment, round_even(crm_target_rate * 100, 1) AS subscription_pct FROM r"""

_DC = " + ".join(f"power(z.z_{c} - c.z_{c}, 2)" for c in _SEG)
ORACLE["assign_segment"] = W_Z + """,
cents AS (SELECT cluster, """ + ", ".join(f"avg(z_{c}) AS z_{c}" for c in _SEG) + f""" FROM z GROUP BY cluster),
d AS (SELECT z.customer_id, c.cluster, {_DC} AS dist FROM z, cents c)
SELECT customer_id, arg_min(cluster, (dist, cluster)) AS segment FROM d GROUP BY customer_id"""


REQ = """req AS (
  SELECT customer_id, purchase_amount_usd, previous_purchases,
         previous_purchases * purchase_amount_usd AS total_spend_weighted_new,
         purchase_amount_usd / (previous_purchases + 1) AS spend_per_purchase_new,
         CAST(coalesce(CASE frequency_of_purchases WHEN 'Weekly' THEN 52 WHEN 'Bi-Weekly' THEN 26
              WHEN 'Fortnightly' THEN 26 WHEN 'Quarterly' THEN 4 WHEN 'Annually' THEN 1
              WHEN 'Monthly' THEN 12 WHEN 'Every 3 Months' THEN 4 END, 12) AS DOUBLE) AS frequency_value_new,
         CASE WHEN previous_purchases < 13 THEN 1 WHEN previous_purchases < 25 THEN 2
              WHEN previous_purchases < 38 THEN 3 ELSE 4 END AS loyalty_score_new,
         CAST(coalesce(review_rating >= 4, false) AS INTEGER) AS high_review_rating_new,
         purchase_amount_usd * review_rating AS spend_rating_new,
         CASE WHEN promo_code_used = 'Yes' THEN 1 ELSE 0 END AS promo,
         CAST(coalesce(gender = 'Male', false) AS INTEGER) AS male
  FROM shop)"""

ORACLE["request_features"] = with_ctes(SHOP, REQ) + """
SELECT customer_id, total_spend_weighted_new, spend_per_purchase_new, frequency_value_new,
       CAST(loyalty_score_new AS DOUBLE) AS loyalty_score_new,
       CAST(high_review_rating_new AS DOUBLE) AS high_review_rating_new,
       spend_rating_new,
       CAST(promo * loyalty_score_new AS DOUBLE) AS promo_x_loyalty,
       promo * frequency_value_new AS promo_x_freq,
       male AS gender__oh_Male, 1 - male AS gender__oh_Female
FROM req"""

ORACLE["cv_winner"] = W_SHOP + """,
s AS (SELECT customer_id % 5 AS fold, CASE WHEN subscription_status = 'Yes' THEN 1 ELSE 0 END AS label,
             ((customer_id * 7919) % 1000) / 1000.0 AS s_hash,
             CASE WHEN promo_code_used = 'Yes' THEN 0.6 ELSE 0.3 END + ((customer_id * 31) % 100) / 1000.0 AS s_promo,
             CASE WHEN discount_applied = 'Yes' THEN 0.55 ELSE 0.35 END + ((customer_id * 17) % 100) / 1000.0 AS s_discount
      FROM shop),
l AS (SELECT 'hash' AS model, 0 AS pos, fold, label, s_hash AS score FROM s
      UNION ALL SELECT 'promo', 1, fold, label, s_promo FROM s
      UNION ALL SELECT 'discount', 2, fold, label, s_discount FROM s),
f AS (SELECT model, pos, fold, avg(CASE WHEN (score >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END) AS a
      FROM l GROUP BY ALL),
m AS (SELECT model, pos, round(avg(a), 9) AS mean FROM f GROUP BY ALL)
SELECT model FROM m ORDER BY mean DESC, pos LIMIT 1"""

_SEG_OF = {"purchase_amount_usd": (250, 100), "previous_purchases": (40, 15),
           "frequency_value_new": (15, 12), "spend_per_purchase_new": (8, 5),
           "total_spend_weighted_new": (9000, 4000)}
_GIVEN_CENTROIDS = {0: (-1.0, -1.0, 0.0, 0.5, -1.0), 1: (0.5, 0.0, -0.5, 0.0, 0.5),
                    2: (1.0, 1.0, 1.0, -0.5, 1.5)}
_GIVEN_DISTANCE = {k: " + ".join(f"power((coalesce({c}, 0) - {m}) / {s} - ({v}), 2)"
                                 for (c, (m, s)), v in zip(_SEG_OF.items(), centre))
                   for k, centre in _GIVEN_CENTROIDS.items()}
ORACLE["score_aligned"] = with_ctes(SHOP, REQ) + """,
p AS (SELECT *, 1 / (1 + exp(-(-0.1
        + 0.3 * (coalesce(total_spend_weighted_new, 0) - 500) / 400
        - 0.2 * (loyalty_score_new - 2) / 1 + 0.1 * (male - 0.5) / 0.5 + 0.7 * 0
        + 0.4 * (promo * frequency_value_new - 5) / 10
        - 0.5 * (coalesce(spend_rating_new, 0) - 100) / 80))) AS probability FROM req),
d AS (SELECT customer_id, probability, """ + ", ".join(
    f"{e} AS d{k}" for k, e in _GIVEN_DISTANCE.items()) + """ FROM p),
n AS (SELECT *, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS segment
      FROM d)
SELECT n.customer_id, round(probability, 6) AS probability, probability >= 0.4 AS subscribes,
       segment, """ + _NAME_CASE.replace("cluster", "segment") + """END AS segment_name FROM n"""

_DR = " + ".join(f"power((coalesce(r.{c}, 0) - zst.m_{c}) / zst.s_{c} - c.z_{c}, 2)" for c in _SEG)
ORACLE["request_segment"] = W_Z + "," + REQ + """,
cents AS (SELECT cluster, """ + ", ".join(f"avg(z_{c}) AS z_{c}" for c in _SEG) + f""" FROM z GROUP BY cluster),
d AS (SELECT r.customer_id, c.cluster, {_DR} AS dist FROM req r, cents c, zst),
best AS (SELECT customer_id, arg_min(cluster, (dist, cluster)) AS cluster FROM d GROUP BY customer_id)
SELECT customer_id, cluster AS segment, """ + _NAME_CASE + """ELSE 'Genel Segment' END AS segment_name FROM best"""


ORACLE["cv_folds"] = W_SPLIT + """,
lab AS (SELECT customer_id, CASE WHEN subscription_status = 'Yes' THEN 1 ELSE 0 END AS label FROM train)
SELECT customer_id, label,
       CAST((row_number() OVER (PARTITION BY label ORDER BY md5('fold42:' || CAST(customer_id AS VARCHAR)),
                                customer_id) - 1) % 5 AS INTEGER) AS fold
FROM lab"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
