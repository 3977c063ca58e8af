"""Features, text, series and transforms over the source tables."""

from pyspark.sql import functions as F

from tablewise.functions.fixed_values import NEGATIVE_WORDS, POSITIVE_WORDS
from tablewise.operators import features as A
from tablewise.operators import studio as S
from tablewise.operators import text as X
from tablewise.operators import timeseries as Z
from tablewise.operators import transforms as R
from tablewise.plans.cleaning_plans import MI
from tablewise.plans.registry import query
from tablewise.plans.sqltext import rnd, union

WS = r"[ \t\n\x0B\f\r]+"
STOP = ["the", "and", "of", "to", "in", "is", "that", "for", "on", "with"]


def r(df, *names, places=4):
    """Round the named columns for comparison."""
    return df.withColumns({c: F.round(F.col(f"`{c}`").cast("double"), places) + F.lit(0.0) for c in names})


@query("FE1", "SELECT 'date_text' AS \"column\" FROM {text_numbers} HAVING avg(CASE WHEN TRY_CAST(date_text AS DATE) IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.8 UNION ALL SELECT 'o_orderdate' FROM orders HAVING count(o_orderdate) > 0")
def fe1(t):
    from tablewise.operators.measures import report

    a, b = t.text_numbers, t.orders
    return report(a, [(c,) for c in A.date_like(a) + A.date_like(b)], "column string")


@query("FE2", """SELECT event_id, CAST(year(ts) AS INTEGER) AS ts_year, CAST(month(ts) AS INTEGER) AS ts_month, CAST(day(ts) AS INTEGER) AS ts_day, CAST(isodow(ts) - 1 AS INTEGER) AS ts_day_of_week,
CAST(quarter(ts) AS INTEGER) AS ts_quarter, CAST(hour(ts) AS INTEGER) AS ts_hour, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS ts_is_weekend FROM events""")
def fe2(t):
    return A.date_parts(t.events.select("event_id", "ts"))


@query("FE3", "SELECT event_id, round(ln(1 + heavy), 4) AS heavy_log FROM {skewed}")
def fe3(t):
    return r(A.log_skewed(t.skewed, ["value", "heavy", "near_copy"]).select("event_id", "heavy_log"), "heavy_log")


FEATURES = ["value", "near_copy", "small_int", "user_id"]


def _top(measure):
    return f"SELECT c, row_number() OVER (ORDER BY m DESC) AS k FROM ({union(f'SELECT {chr(39)}{c}{chr(39)} AS c, {measure.format(c=c)} AS m FROM {{skewed}}' for c in FEATURES)}) z"


def _case(k, table):
    return f"CASE (SELECT c FROM {table} WHERE k = {k}) " + " ".join(f"WHEN '{c}' THEN CAST({c} AS DOUBLE)" for c in FEATURES) + " END"


@query("FE4", f"WITH t AS ({_top('abs(stddev_samp({c}) / avg({c}))')}) SELECT event_id, " + ", ".join(f"round({_case(1, 't')} * {_case(k, 't')}, 6) AS p{k - 1}" for k in (2, 3, 4)) + " FROM {skewed}")
def fe4(t):
    df = A.products(t.skewed.select("event_id", *FEATURES), FEATURES, top=5, pairs=3)
    new = [c for c in df.columns if "_x_" in c]
    return df.select("event_id", *[F.round(c, 6).alias(f"p{i + 1}") for i, c in enumerate(new)])


@query("FE5", f"WITH t AS ({_top('var_samp({c})')}) SELECT event_id, " + ", ".join(f"round({_case(a, 't')} / ({_case(b, 't')} + 1e-8), 2) AS q{i + 1}" for i, (a, b) in enumerate([(1, 2), (1, 3), (2, 3)])) + " FROM {skewed} WHERE small_int IS NOT NULL")
def fe5(t):
    df = A.ratios(t.skewed.select("event_id", *FEATURES), FEATURES, top=5, pairs=10)
    new = [c for c in df.columns if "_div_" in c]
    return df.select("event_id", *[F.round(new[j], 2).alias(f"q{i + 1}") for i, j in enumerate((0, 1, 3))])


@query("FE6", "SELECT event_id, " + ", ".join(f"round({f}(2 * pi() * {x} / {p}), 4) + 0.0 AS {n}_{f}" for n, x, p in (("ts_month", "month(ts)", 12), ("ts_hour", "hour(ts)", 24), ("ts_day", "day(ts)", 31), ("ts_day_of_week", "(isodow(ts) - 1)", 7)) for f in ("sin", "cos")) + " FROM events")
def fe6(t):
    df = A.cycles(A.date_parts(t.events.select("event_id", "ts")))
    names = [c for c in df.columns if c.endswith(("_sin", "_cos"))]
    return r(df.select("event_id", *names), *names)


@query("FE7", "SELECT doc_id, round(n / (SELECT count(*) FROM documents), 6) AS source_freq FROM documents JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) c USING (source)")
def fe7(t):
    return r(A.frequency_encode(t.documents.select("doc_id", "source", "lang")).select("doc_id", "source_freq"), "source_freq", places=6)


def _bins(c, table, key, k, alias):
    probs = "[" + ", ".join(str(i / k) for i in range(k + 1)) + "]"
    return f"SELECT {key}, CAST(len(list_filter(list_slice((SELECT list_sort(list_distinct(quantile_cont(CAST({c} AS DOUBLE), {probs}))) FROM {table}), 2, -2), lambda e: e < CAST({c} AS DOUBLE))) AS INTEGER) AS {alias} FROM {table}"


@query("FE8", _bins("o_totalprice", "orders", "o_orderkey", 5, "o_totalprice_binned"))
def fe8(t):
    return A.quantile_bins(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"]).select("o_orderkey", "o_totalprice_binned")


@query("FE9", f"SELECT doc_id, CAST(CASE WHEN regexp_matches(text, '^{WS}$') OR text = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(text, '^{WS}|{WS}$', '', 'g'), '{WS}')) END AS INTEGER) AS text_word_count, CAST(length(text) AS INTEGER) AS text_char_count FROM documents")
def fe9(t):
    return A.text_lengths(t.documents.select("doc_id", "text", "lang")).select("doc_id", "text_word_count", "text_char_count")


@query("FE10")
def fe10(t):
    return A.engineer(t.events.drop("props"))[0]


@query("FS1", "SELECT o_orderkey, round(ln(1 + o_totalprice) + sqrt(abs(o_custkey - 500)) * power(o_orderkey % 7, 2) - exp(o_orderkey % 3), 4) AS f FROM orders")
def fs1(t):
    return r(S.add_feature(t.orders, "f", "log(o_totalprice) + sqrt(abs(o_custkey - 500)) * (o_orderkey % 7) ** 2 - exp(o_orderkey % 3)").select("o_orderkey", "f"), "f")


@query("FS2", "SELECT event_id, CAST(isodow(ts) - 1 AS INTEGER) AS a, CAST(month(ts) AS INTEGER) AS b, CAST(year(ts) AS INTEGER) AS c, CAST(hour(ts) AS INTEGER) AS d FROM events")
def fs2(t):
    df = t.events
    for name, text in (("a", "day_of_week(ts)"), ("b", "month(ts)"), ("c", "year(ts)"), ("d", "hour(ts)")):
        df = S.add_feature(df, name, text)
    return df.select("event_id", "a", "b", "c", "d")


@query("FS4", f"SELECT 0 AS missing, count(DISTINCT f) AS \"distinct\", {rnd('avg(f)')} AS mean, {rnd('stddev_samp(f)')} AS std, {rnd('min(f)')} AS min, {rnd('max(f)')} AS max, {rnd('corr(f, target)')} AS correlation, CASE WHEN abs(corr(f, target)) > 0.3 THEN 'strong' WHEN abs(corr(f, target)) > 0.1 THEN 'moderate' ELSE 'weak' END AS signal FROM (SELECT CAST(f1 * 3 + f2 AS DOUBLE) AS f, target FROM {{learnable}}) x")
def fs4(t):
    return S.preview(t.learnable, "f1 * 3 + f2", "target")[0]


@query("FS4_hist", "SELECT CAST(b AS INTEGER) AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 20)) AS b) r LEFT JOIN (SELECT least(CAST(floor((f - lo) / ((hi - lo) / 20.0)) AS BIGINT), 19) AS b, count(*) AS n FROM (SELECT CAST(f1 * 3 + f2 AS DOUBLE) AS f FROM {learnable}) x, (SELECT CAST(min(f1 * 3 + f2) AS DOUBLE) AS lo, CAST(max(f1 * 3 + f2) AS DOUBLE) AS hi FROM {learnable}) m GROUP BY 1) h USING (b)")
def fs4_hist(t):
    return S.preview(t.learnable, "f1 * 3 + f2", "target")[1].select("bin", "n")


@query("FS5", "SELECT l_orderkey, round(l_extendedprice * (1 - l_discount) / l_quantity, 9) AS unit FROM lineitem")
def fs5(t):
    return r(S.add_feature(t.lineitem, "unit", "l_extendedprice * (1 - l_discount) / l_quantity").select("l_orderkey", "unit"), "unit", places=9)


@query("FS6")
def fs6(t):
    return S.suggest(t.events.join(t.skewed.select("event_id", "heavy"), "event_id"))


def _mi_of(exprs):
    probs = "[" + ", ".join(str(i / 10) for i in range(11)) + "]"
    return union(
        f"SELECT '{n}' AS feature, target AS y, len(list_filter(list_slice((SELECT list_sort(list_distinct(quantile_cont(CAST({e} AS DOUBLE), {probs}))) FROM {{learnable}}), 2, -2), lambda e: e < CAST({e} AS DOUBLE))) AS bin FROM {{learnable}}"
        for n, e in exprs)


@query("FS7", "SELECT feature, round(mi, 4) AS mi FROM (" + MI.replace("{}", _mi_of([("price_x_o_orderkey", "price * CAST(o_orderkey AS DOUBLE)"), ("price_x_f1", "price * f1"), ("price_x_f2", "price * f2"), ("o_orderkey_x_f1", "o_orderkey * f1"), ("o_orderkey_x_f2", "o_orderkey * f2"), ("f1_x_f2", "f1 * f2")])) + ") m ORDER BY mi DESC LIMIT 10")
def fs7(t):
    return S.crossings(t.learnable, "target")


@query("FS8", "SELECT feature, round(mi, 4) AS mi FROM (" + MI.replace("{}", _mi_of([(f"{c}_pow{d}", f"power(CAST({c} AS DOUBLE), {d})") for c in ("price", "f1", "f2") for d in (2, 3)])) + ") m ORDER BY mi DESC LIMIT 10")
def fs8(t):
    return S.powers(t.learnable, "target", 3, 10, ["price", "f1", "f2"])


# Text

WORDS = f"list_filter(regexp_split_to_array(lower(text), '{WS}'), lambda w: w <> '')"


@query("TX1", f"""SELECT doc_id, n AS text_char_count, w AS text_word_count, round(1.0 * n / greatest(w, 1), 4) AS text_avg_word_length, len(regexp_extract_all(text, '[.!?]+')) AS text_sentence_count,
round(1.0 * len(regexp_extract_all(text, '[A-Z]')) / greatest(n, 1), 4) AS text_uppercase_ratio, round(1.0 * len(regexp_extract_all(text, '[0-9]')) / greatest(n, 1), 4) AS text_digit_ratio,
len(regexp_extract_all(text, '[^a-zA-Z0-9 \\t\\n\\x0B\\f\\r]')) AS text_special_char_count, len(regexp_extract_all(text, '!')) AS text_exclamation_count, len(regexp_extract_all(text, '\\?')) AS text_question_count,
round(1.0 * u / greatest(w, 1), 4) AS text_unique_word_ratio FROM (SELECT doc_id, text, length(text) AS n, len({WORDS}) AS w, len(list_distinct({WORDS})) AS u FROM documents) x""")
def tx1(t):
    df = X.text_measures(t.documents.select("doc_id", "text"), "text").drop("text")
    return r(df, "text_avg_word_length", "text_uppercase_ratio", "text_digit_ratio", "text_unique_word_ratio")


@query("TX2", f"""SELECT conv_id, turn, role, round(1.0 * p / greatest(n, 1), 4) AS text_positive_ratio, round(1.0 * g / greatest(n, 1), 4) AS text_negative_ratio, round(1.0 * (p - g) / greatest(n, 1), 4) + 0.0 AS text_sentiment_score
FROM (SELECT conv_id, turn, role, len({WORDS}) AS n, len(list_filter({WORDS}, lambda w: list_contains({POSITIVE_WORDS}, w))) AS p, len(list_filter({WORDS}, lambda w: list_contains({NEGATIVE_WORDS}, w))) AS g FROM conversations) x""")
def tx2(t):
    df = X.sentiment(t.conversations, "text").drop("text")
    return r(df, "text_positive_ratio", "text_negative_ratio", "text_sentiment_score")


@query("TX3", f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-zA-Z \\t\\n\\x0B\\f\\r]', ' ', 'g'), '{WS}'), lambda x: length(x) >= 2 AND NOT list_contains({STOP}, x)) AS w FROM documents),
g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
f AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents),
v AS (SELECT term, ln((1.0 + n) / (1.0 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df, sum(tf) AS cf FROM f GROUP BY 1) s, n WHERE df >= 2 AND df <= 0.95 * n ORDER BY cf DESC, term LIMIT 50),
x AS (SELECT doc_id, term, tf * idf AS w FROM f JOIN v USING (term))
SELECT doc_id AS key, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 4) AS weight FROM x""")
def tx3(t):
    return r(X.tfidf(t.documents, "doc_id", "text", 50, STOP), "weight")


@query("TX4")
def tx4(t):
    return X.text_features(t.documents.select("doc_id", "text", "lang"), "doc_id", ["text"], 10)


# Time series


@query("TS1", "SELECT true AS is_timeseries, 'o_orderdate' AS date_column, datediff('day', min(o_orderdate), max(o_orderdate)) AS range_days FROM orders")
def ts1(t):
    return Z.detect(t.orders).select("is_timeseries", "date_column", "range_days")


@query("TS2", "SELECT round(median(gap), 2) AS median_gap_seconds, CASE WHEN median(gap) < 3600 THEN 'minutely' WHEN median(gap) < 86400 THEN 'hourly' ELSE 'daily' END AS frequency FROM (SELECT epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (ORDER BY ts) AS gap FROM (SELECT DISTINCT ts FROM events) d) g")
def ts2(t):
    return Z.frequency(t.events, "ts")


@query("TS2_series", "SELECT median(gap) AS median_gap_seconds, 'daily' AS frequency FROM (SELECT event_type, 86400.0 * (day - lag(day) OVER (PARTITION BY event_type ORDER BY day)) AS gap FROM {series}) g")
def ts2_series(t):
    return Z.frequency(t.series, "day", ["event_type"])


@query("TS3", """SELECT event_type, round(f, 8) AS first_mean, round(l, 8) AS last_mean, CASE WHEN n < 10 THEN 'unknown' WHEN (l - f) / greatest(abs(f), 1e-10) > 0.1 THEN 'upward' WHEN (l - f) / greatest(abs(f), 1e-10) < -0.1 THEN 'downward' ELSE 'stable' END AS trend FROM (
SELECT event_type, max(k) AS n, avg(total) FILTER (WHERE p <= floor(k / 4.0)) AS f, avg(total) FILTER (WHERE p > k - ceil(k / 4.0)) AS l FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS p, count(*) OVER (PARTITION BY event_type) AS k FROM {series}) x GROUP BY 1) y""")
def ts3(t):
    return r(Z.trend(t.series.select("event_type", "day", "total"), "day", "total", ["event_type"]), "first_mean", "last_mean", places=8)


@query("TS4", """SELECT event_type, day, CAST(day(day) AS INTEGER) AS _day, CAST(isodow(day) - 1 AS INTEGER) AS _dayofweek, CAST(dayofyear(day) AS INTEGER) AS _dayofyear, CAST(week(day) AS INTEGER) AS _weekofyear,
round(sin(2 * pi() * (isodow(day) - 1) / 7), 4) + 0.0 AS _dow_sin, round(cos(2 * pi() * (isodow(day) - 1) / 7), 4) + 0.0 AS _dow_cos, CASE WHEN isodow(day) >= 6 THEN 1 ELSE 0 END AS _is_weekend FROM {series}""")
def ts4(t):
    return r(Z.calendar(t.series.select("event_type", "day"), "day"), "_dow_sin", "_dow_cos")


W = "OVER (PARTITION BY event_type ORDER BY day)"


def _roll(k, names=("rolling_mean", "rolling_std", "rolling_min", "rolling_max")):
    fr = f"OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    fn = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    return ", ".join(f"CASE WHEN count(total) {fr} = {k} THEN round({fn[n.split('_')[1]]}(total) {fr}, 4) END AS total_{n}_{k}" for n in names)


@query("TS5", "SELECT event_type, day, " + ", ".join(f"lag(total, {k}) {W} AS total_lag_{k}" for k in (1, 2, 3, 7)) + " FROM {series}")
def ts5(t):
    df = t.series
    lags, _, _ = Z.usable(df, ["event_type"], [1, 2, 3, 7, 14, 30], [3])
    out = Z.over_rows(df, ["event_type"], "day", Z.lag_columns("total", lags), back=max(lags))
    return out.drop("n", "total")


@query("TS6", f"SELECT event_type, day, {_roll(3)}, {_roll(7)} FROM {{series}}")
def ts6(t):
    df = t.series
    _, windows, _ = Z.usable(df, ["event_type"], [1], [3, 7, 14, 30])
    out = Z.over_rows(df, ["event_type"], "day", Z.rolling_columns("total", windows), back=max(windows)).drop("n", "total")
    return r(out, *[c for c in out.columns if "rolling" in c])


@query("TS7", f"SELECT event_type, day, round(total - lag(total, 1) {W}, 4) + 0.0 AS total_diff_1, round(total - lag(total, 7) {W}, 4) + 0.0 AS total_diff_7 FROM {{series}}")
def ts7(t):
    out = Z.over_rows(t.series, ["event_type"], "day", Z.diff_columns("total"), back=7).drop("n", "total")
    return r(out, "total_diff_1", "total_diff_7")


@query("TS8", f"SELECT event_type, day, l7 AS total_lag_7, d1 AS total_diff_1 FROM (SELECT *, lag(total, 7) {W} AS l7, round(total - lag(total, 1) {W}, 4) + 0.0 AS d1 FROM {{series}}) x WHERE l7 IS NOT NULL AND d1 IS NOT NULL")
def ts8(t):
    return r(Z.lag_features(t.series, ["event_type"], "day", "total").select("event_type", "day", "total_lag_7", "total_diff_1"), "total_diff_1")


@query("TS9", "SELECT * FROM (SELECT event_type, day, " + ", ".join(f"lag(total, {k}) {W} AS total_lag_{k}" for k in range(1, 6)) + f", {_roll(3, ('roll_mean', 'roll_std'))}, {_roll(7, ('roll_mean', 'roll_std'))} FROM {{series}}) x WHERE total_lag_5 IS NOT NULL AND total_roll_mean_7 IS NOT NULL")
def ts9(t):
    out = Z.auto_lags(t.series, ["event_type"], "day", "total", 5)[0].drop("n", "total")
    return r(out, *[c for c in out.columns if "roll" in c])


def _season(p, even):
    h = p // 2
    fr = f"OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)"
    mean = f"(sum(total) {fr} - 0.5 * lag(total, {h}) {W} - 0.5 * lead(total, {h}) {W}) / {p}" if even else f"avg(total) {fr}"
    return f"""WITH a AS (SELECT event_type, day, total, (row_number() {W} - 1) % {p} AS phase, CASE WHEN count(total) {fr} = {2 * h + 1} THEN {mean} END AS trend FROM {{series}}),
s AS (SELECT event_type, phase, avg(total - trend) AS s FROM a GROUP BY 1, 2), c AS (SELECT event_type, phase, s - avg(s) OVER (PARTITION BY event_type) AS seasonal FROM s)
SELECT event_type, day, round(trend, 8) AS trend, round(seasonal, 8) + 0.0 AS seasonal, round(total - trend - seasonal, 8) + 0.0 AS residual FROM a JOIN c USING (event_type, phase)"""


@query("TS10", _season(7, False))
def ts10(t):
    return r(Z.seasonal_split(t.series, ["event_type"], "day", "total", 7).drop("n", "total"), "trend", "seasonal", "residual", places=8)


@query("TS10_even", _season(4, True))
def ts10_even(t):
    return r(Z.seasonal_split(t.series, ["event_type"], "day", "total", 4).drop("n", "total"), "trend", "seasonal", "residual", places=8)


@query("TS11", "SELECT event_type, day, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY day DESC) <= 7 THEN 'test' ELSE 'train' END AS split FROM {series}")
def ts11(t):
    return Z.holdout(t.series, ["event_type"], "day", 7).select("event_type", "day", "split")


# Transforms


@query("TR1", "SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS o_orderpriority FROM orders")
def tr1(t):
    return R.label_encode(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority")[0]


@query("TR2", "SELECT c_custkey, CASE WHEN flag_text = 'no' THEN 1 ELSE 0 END AS flag_text FROM {text_numbers}")
def tr2(t):
    return R.label_encode(t.text_numbers.select("c_custkey", "flag_text"), "flag_text")[0]


@query("TR3", "SELECT c_custkey, " + ", ".join(f"CASE WHEN c_mktsegment = '{v}' THEN 1 ELSE 0 END AS \"c_mktsegment_{v}\"" for v in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
def tr3(t):
    return R.one_hot(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment")


@query("TR4", """WITH d AS (SELECT doc_id, source, CAST(quality AS DOUBLE) AS y, CAST(floor(CAST('0x' || substr(md5(doc_id || ':42'), 1, 13) AS BIGINT) / 4503599627370496.0 * 5) AS INTEGER) AS fold FROM documents JOIN labels USING (doc_id)),
f AS (SELECT unnest(range(0, 5)) AS fold), g AS (SELECT f.fold, avg(y) AS m, var_pop(y) AS v FROM d JOIN f ON d.fold <> f.fold GROUP BY 1),
s AS (SELECT f.fold, source, count(*) AS n, avg(y) AS m, var_pop(y) AS w FROM d JOIN f ON d.fold <> f.fold GROUP BY 1, 2)
SELECT doc_id, round(CASE WHEN s.n IS NULL OR g.v * s.n + s.w = 0 THEN g.m ELSE (g.v * s.n * s.m + s.w * g.m) / (g.v * s.n + s.w) END, 4) AS source_encoded FROM d JOIN g USING (fold) LEFT JOIN s ON s.fold = d.fold AND s.source = d.source""")
def tr4(t):
    df = t.documents.select("doc_id", "source").join(t.labels.select("doc_id", "quality"), "doc_id")
    return r(R.target_encode(df, "source", "quality", "doc_id").select("doc_id", "source_encoded"), "source_encoded")


@query("TR5", "SELECT p_partkey, round(n / (SELECT count(*) FROM part), 6) AS p_brand FROM part JOIN (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) c USING (p_brand)")
def tr5(t):
    return r(A.frequency_encode(t.part.select("p_partkey", "p_brand"), ["p_brand"], replace=True), "p_brand", places=6)


@query("TR6", "SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem")
def tr6(t):
    return R.drop_low_variance(t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))


@query("TR7", "SELECT event_id, value, small_int FROM {skewed}")
def tr7(t):
    return R.drop_correlated(t.skewed.select("event_id", "value", "near_copy", "small_int"))


@query("TR8", "SELECT o_orderkey, round((o_totalprice - a) / s, 4) + 0.0 AS o_totalprice FROM orders, (SELECT avg(o_totalprice) AS a, stddev_pop(o_totalprice) AS s FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01 00:00:00') m")
def tr8(t):
    df = R.scale(t.orders.select("o_orderkey", "o_totalprice", "o_orderdate"), ["o_totalprice"], F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    return r(df.select("o_orderkey", "o_totalprice"), "o_totalprice")


@query("TR9")
def tr9(t):
    return R.transform_table(t.learnable, "target", "o_orderkey")[1]


@query("TR11")
def tr11(t):
    from tablewise.operators.measures import report

    _, shares, _ = R.principal_components(t.skewed, ["value", "heavy", "near_copy", "small_int"])
    return report(t.skewed, [(i, float(s)) for i, s in enumerate(shares)], "component int, share double")


@query("TR12", "SELECT event_id, round(value * near_copy, 6) AS value_x_near_copy, round(value * small_int, 6) AS value_x_small_int, round(near_copy * small_int, 6) AS near_copy_x_small_int FROM {skewed}")
def tr12(t):
    df = R.pair_products(t.skewed, ["value", "near_copy", "small_int"])
    names = [c for c in df.columns if "_x_" in c]
    return r(df.select("event_id", *names), *names, places=6)


@query("TR13", "SELECT event_id, round(value / (abs(near_copy) + 1e-8), 4) AS value_over_near_copy, round(value - near_copy, 4) + 0.0 AS value_minus_near_copy FROM {skewed}")
def tr13(t):
    df = R.pair_ratios(t.skewed, ["value", "near_copy"])
    names = ["value_over_near_copy", "value_minus_near_copy"]
    return r(df.select("event_id", *names), *names)


@query("TR14", _bins("value", "{skewed}", "event_id", 10, "value_binned"))
def tr14(t):
    return R.decile_bins(t.skewed.select("event_id", "value"), ["value"]).select("event_id", "value_binned")


@query("TR15")
def tr15(t):
    from tablewise.operators.measures import report

    return report(t.learnable, [(c,) for c in R.best_features(t.learnable, ["price", "f1", "f2", "o_orderkey"], "target")], "feature string")


def _inverse(l):
    return f"CASE WHEN y >= 0 THEN power(y * {l} + 1, 1.0 / {l}) - 1 ELSE 1 - power(1 - (2 - {l}) * y, 1.0 / (2 - {l})) END"


@query("TR18", f"SELECT event_id, round({_inverse(0.5)}, 4) + 0.0 AS back FROM (SELECT event_id, (value - 100) / 50 AS y FROM events) x")
def tr18(t):
    return r(t.events.select("event_id", R.inverse_yeo_johnson((F.col("value") - 100) / 50, 0.5).alias("back")), "back")


@query("TR18_round_trip", "SELECT event_id, round((value - 100) / 50, 4) + 0.0 AS back FROM events")
def tr18_round_trip(t):
    y = (F.col("value") - 100) / 50
    return r(t.events.select("event_id", R.inverse_yeo_johnson(R.yeo_johnson(y, 0.7), 0.7).alias("back")), "back")


@query("TR19", """SELECT 'value' AS target, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, min(value) AS min, max(value) AS max,
round(skewness(value) * (count(*) - 2) / sqrt(1.0 * count(*) * (count(*) - 1)), 4) AS skewness, round(kurtosis_pop(value), 4) AS kurtosis, 0.0 AS p_value, false AS is_normal, min(value) < 0 AS has_negatives, bool_or(value = 0) AS has_zeros,
CASE WHEN abs(skewness(value) * (count(*) - 2) / sqrt(1.0 * count(*) * (count(*) - 1))) > 2 AND min(value) > 0 THEN 'log_or_boxcox' WHEN abs(skewness(value)) > 1 THEN 'sqrt_or_yeojohnson' ELSE 'marginal' END AS advice FROM events""")
def tr19(t):
    return R.target_shape(t.events, "value")


@query("TR20", """SELECT 'value' AS "column", round(1 / (1 - pow(corr(value, near_copy), 2)), 2) AS vif, CASE WHEN 1 / (1 - pow(corr(value, near_copy), 2)) > 1000 THEN 'critical' WHEN 1 / (1 - pow(corr(value, near_copy), 2)) > 10 THEN 'high' ELSE 'low' END AS severity FROM {skewed}
UNION ALL SELECT 'near_copy', round(1 / (1 - pow(corr(value, near_copy), 2)), 2), CASE WHEN 1 / (1 - pow(corr(value, near_copy), 2)) > 1000 THEN 'critical' ELSE 'high' END FROM {skewed}""")
def tr20(t):
    return R.vif(t.skewed, ["value", "near_copy"]).withColumn("vif", F.round("vif", 2))


@query("TR20_drop")
def tr20_drop(t):
    return R.vif_without_worst(t.skewed, ["value", "near_copy", "small_int", "heavy"])
