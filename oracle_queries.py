"""DuckDB twins of the registered queries, written from the query semantics alone."""

from __future__ import annotations

TRIPS = """
trips AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
    o_orderdate + to_hours(CAST(l_partkey % 24 AS INT)) AS pickup_ts,
    o_orderdate + to_hours(CAST(l_partkey % 24 AS INT))
      + to_minutes((l_partkey*7 + l_suppkey*13 + l_linenumber*31) % 200 - 5) AS dropoff_ts,
    c_nationkey AS pu_zone, s_nationkey AS do_zone,
    CASE l_returnflag WHEN 'R' THEN 1+5*(l_suppkey%2) WHEN 'A' THEN 1+6*(l_suppkey%2)
      ELSE 1+(l_suppkey%2) END AS vendor_id,
    CASE WHEN l_returnflag='R' THEN NULL ELSE l_linenumber END AS passenger_count,
    CASE WHEN l_returnflag='R' THEN NULL WHEN l_partkey%29=0 THEN 99
      ELSE 1+(l_partkey%6) END AS ratecode_id,
    CASE WHEN l_returnflag='R' THEN NULL ELSE l_linestatus END AS store_flag,
    l_quantity/5 AS trip_distance,
    CASE WHEN l_partkey%97=0 THEN -l_extendedprice ELSE l_extendedprice END AS fare_amount,
    l_extendedprice*l_tax AS tip_amount, l_extendedprice*(1+l_tax) AS total_amount
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey
  JOIN customer ON o_custkey=c_custkey JOIN supplier ON l_suppkey=s_suppkey
)"""

FEAT = (
    TRIPS
    + """,
feat AS (
  SELECT *,
    date_diff('microsecond', pickup_ts, dropoff_ts)/1e6/60 AS duration_min,
    CAST(hour(pickup_ts) AS INTEGER) AS hour,
    CAST(isodow(pickup_ts) - 1 AS INTEGER) AS dow,
    CAST(isodow(pickup_ts) >= 6 AS INTEGER) AS is_weekend
  FROM trips
)"""
)

REQUIRED = """pickup_ts IS NOT NULL AND dropoff_ts IS NOT NULL AND pu_zone IS NOT NULL
    AND do_zone IS NOT NULL AND vendor_id IS NOT NULL AND ratecode_id IS NOT NULL
    AND trip_distance IS NOT NULL AND passenger_count IS NOT NULL AND fare_amount IS NOT NULL
    AND tip_amount IS NOT NULL AND total_amount IS NOT NULL"""

# One after the other, as a reader of the rules would filter by hand.
STEPS = [
    ("required column missing", "SELECT * FROM s0 WHERE " + REQUIRED),
    ("duplicate rows", "SELECT DISTINCT * FROM s1"),
    (
        "outside observation period",
        "SELECT * FROM s2 WHERE pickup_ts >= TIMESTAMP '1996-01-01' "
        "AND pickup_ts < TIMESTAMP '2001-01-01'",
    ),
    ("duration out of range", "SELECT * FROM s3 WHERE duration_min BETWEEN 1 AND 180"),
    (
        "speed out of range",
        "SELECT *, trip_distance/(duration_min/60) AS speed_mph FROM s4 "
        "WHERE trip_distance/(duration_min/60) BETWEEN 1 AND 70",
    ),
    ("fare not positive", "SELECT * FROM s5 WHERE NOT fare_amount <= 0"),
    ("distance too long", "SELECT * FROM s6 WHERE NOT trip_distance > 9.9::DOUBLE"),
    ("unknown zone", "SELECT * FROM s7 WHERE pu_zone NOT IN (23,24) AND do_zone NOT IN (23,24)"),
    ("same zone but far", "SELECT * FROM s8 WHERE NOT (pu_zone = do_zone AND trip_distance > 9)"),
]


def _steps(start: str) -> str:
    parts = [f"s0 AS MATERIALIZED ({start})"]
    parts += [f"s{i} AS MATERIALIZED ({sql})" for i, (_, sql) in enumerate(STEPS, start=1)]
    return ",\n".join(parts)


CLEAN = FEAT + ",\n" + _steps("SELECT * FROM feat") + ",\nclean AS (SELECT * FROM s9)"
DOUBLED = (
    FEAT
    + """,
doubled AS (SELECT * FROM feat UNION ALL SELECT * FROM feat WHERE l_partkey % 50 = 0)"""
)

LABELLED = (
    CLEAN
    + """,
routes AS (
  SELECT pu_zone, do_zone, median(speed_mph) AS route_median_mph, count(*) AS route_trips
  FROM clean GROUP BY pu_zone, do_zone HAVING count(*) >= 10
),
ratios AS MATERIALIZED (
  SELECT c.*, r.route_median_mph, c.speed_mph/r.route_median_mph AS speed_ratio
  FROM clean c JOIN routes r ON c.pu_zone = r.pu_zone AND c.do_zone = r.do_zone
),
thresholds AS MATERIALIZED (
  SELECT (SELECT quantile_cont(speed_mph, 1/3) FROM clean) AS abs_threshold,
         (SELECT quantile_cont(speed_ratio, 1/3) FROM ratios) AS rel_threshold
),
labelled AS MATERIALIZED (
  SELECT ratios.*, CAST(speed_mph < abs_threshold AS INTEGER) AS jam_abs,
         CAST(speed_ratio < rel_threshold AS INTEGER) AS jam_rel
  FROM ratios, thresholds
)"""
)

KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
# A pseudorandom place of a trip, from the text of its keys.
PLACE = f"CAST('0x' || substr(md5(concat_ws('|', '42', {KEYS})), 1, 15) AS BIGINT)"
SPLIT_SIZES = """,
sizes AS (SELECT jam_abs, count(*) AS n, sum(count(*)) OVER () AS total FROM labelled
          GROUP BY jam_abs),
shares AS (SELECT *, total - ceil(0.2::DOUBLE*total) AS n_train FROM sizes),
floors AS (SELECT *, floor(n_train*n/total) AS f, n_train*n/total - floor(n_train*n/total) AS rest
           FROM shares),
train AS (SELECT *, f + CAST(row_number() OVER (ORDER BY rest DESC, jam_abs)
            <= n_train - sum(f) OVER () AS INTEGER) AS k FROM floors)"""
STAT_COLUMNS = [
    "trip_distance",
    "duration_min",
    "speed_mph",
    "fare_amount",
    "tip_amount",
    "total_amount",
    "passenger_count",
]
NUMERIC = ["hour", "dow", "is_weekend", "trip_distance", "passenger_count"]
NOMINAL = ["pu_zone", "do_zone", "vendor_id", "ratecode_id"]
TRIP_COLUMNS = [
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "pickup_ts",
    "dropoff_ts",
    "pu_zone",
    "do_zone",
    "vendor_id",
    "passenger_count",
    "ratecode_id",
    "store_flag",
    "trip_distance",
    "fare_amount",
    "tip_amount",
    "total_amount",
]
FEATURED_COLUMNS = [*TRIP_COLUMNS, "duration_min", "hour", "dow", "is_weekend"]


def r(expr: str) -> str:
    return f"round({expr}, 6) + 0.0::DOUBLE"


def _row_columns() -> str:
    """A trip row in a form both engines print alike."""
    text = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"
    rounded = {"trip_distance", "fare_amount", "tip_amount", "total_amount"}
    return ", ".join(
        text.format(c)
        if c in ("pickup_ts", "dropoff_ts")
        else f"{r(c)} AS {c}"
        if c in rounded
        else c
        for c in TRIP_COLUMNS
    )


def _with(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body.strip()}"


def _passenger(where: str) -> str:
    return f"""SELECT passenger_count, count(*) AS trips, avg(speed) AS mean_speed,
      median(speed) AS median_speed
    FROM (SELECT passenger_count, trip_distance/(duration_min/60) AS speed FROM feat
          WHERE duration_min > 0 AND trip_distance > 0 {where})
    GROUP BY passenger_count"""


KEPT = _passenger("")
DROPPED = _passenger("AND passenger_count IS NOT NULL")


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _null_counts(table: str, alias: str) -> str:
    return _union(
        [
            f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS {alias} FROM {table}"
            for c in TRIP_COLUMNS
        ]
    )


def _quantiles() -> str:
    parts = []
    for q in (0.25, 0.5, 0.75):
        parts.append(
            f"""SELECT {q}::DOUBLE AS prob,
              (SELECT quantile_cont(trip_distance, {q}) FROM trips) AS linear,
              (SELECT x FROM (SELECT trip_distance AS x,
                 row_number() OVER (ORDER BY trip_distance) - 1 AS i, count(*) OVER () AS n
                 FROM trips) WHERE i = floor((n-1)*{q}::DOUBLE + 0.5)) AS nearest"""
        )
    return _union(parts)


def _audit(start: str, ctes: str) -> str:
    counts = ["SELECT 0 AS step, 'start' AS rule, count(*) AS remaining FROM s0"]
    counts += [
        f"SELECT {i} AS step, '{name}' AS rule, count(*) AS remaining FROM s{i}"
        for i, (name, _) in enumerate(STEPS, start=1)
    ]
    return _with(
        ctes + ",\n" + _steps(start) + ",\ncounts AS (" + _union(counts) + ")",
        """SELECT step, rule,
             coalesce(lag(remaining) OVER (ORDER BY step) - remaining, 0) AS removed, remaining
           FROM counts""",
    )


def _describe() -> str:
    return _union(
        [
            f"""SELECT '{c}' AS variable, count({c}) AS "count", {r(f'avg({c})')} AS mean,
              {r(f'stddev_samp({c})')} AS std, {r(f'min({c} + 0.0::DOUBLE)')} AS min,
              {r(f'quantile_cont({c}::DOUBLE, 0.25)')} AS p25,
              {r(f'quantile_cont({c}::DOUBLE, 0.5)')} AS median,
              {r(f'quantile_cont({c}::DOUBLE, 0.75)')} AS p75,
              {r(f'max({c} + 0.0::DOUBLE)')} AS max FROM labelled"""
            for c in STAT_COLUMNS
        ]
    )


def _correlations() -> str:
    return _union(
        [
            f"SELECT '{a}' AS row_var, '{b}' AS col_var, {r(f'corr({a}, {b})')} AS r FROM labelled"
            for a in STAT_COLUMNS
            for b in STAT_COLUMNS
        ]
    )


def _welch(name: str, flag: str, value: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {keys}'{name}' AS test, na AS n_a, nb AS n_b, ma AS mean_a, mb AS mean_b,
        ma - mb AS diff, (ma-mb)/sqrt(va/na + vb/nb) AS t,
        (va/na + vb/nb)*(va/na + vb/nb)
          / ((va/na)*(va/na)/(na-1) + (vb/nb)*(vb/nb)/(nb-1)) AS dof
      FROM (SELECT {keys}
        count({value}) FILTER (WHERE {flag}) AS na, count({value}) FILTER (WHERE NOT ({flag})) AS nb,
        avg({value}) FILTER (WHERE {flag}) AS ma, avg({value}) FILTER (WHERE NOT ({flag})) AS mb,
        var_samp({value}) FILTER (WHERE {flag}) AS va,
        var_samp({value}) FILTER (WHERE NOT ({flag})) AS vb
        FROM labelled {group})"""


TESTS = {
    "jam_distance": ("jam_abs = 1", "trip_distance"),
    "weekend_speed": ("is_weekend = 1", "speed_mph"),
    "rush_speed": ("hour IN (7,8,9,16,17,18,19)", "speed_mph"),
}


def _ttest(parts: list[str], by: str = "") -> str:
    """The tests, with p from Simpson's rule over the density of Student's t."""
    keys = f"{by}, " if by else ""
    on = "w.test = p.test" + (f" AND w.{by} = p.{by}" if by else "")
    picked = f"w.{by}, " if by else ""
    return _with(
        LABELLED + ",\nw AS MATERIALIZED (" + _union(parts) + ")" + f""",
density AS (
  SELECT {keys}test, abs(t)/40000 AS h,
    CASE WHEN i = 0 OR i = 40000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
      * exp(-(dof+1)/2 * ln(1 + (abs(t)*i/40000)*(abs(t)*i/40000)/dof)) AS f,
    exp(lgamma((dof+1)/2) - lgamma(dof/2)) / sqrt(dof*pi()) AS c
  FROM w, (SELECT unnest(range(0, 40001)) AS i)
),
p AS (
  SELECT {keys}test, greatest(0.0, 1 - 2*max(c)*max(h)/3*sum(f)) AS p
  FROM density GROUP BY {keys}test
)""",
        f"""SELECT {picked}w.test, n_a, n_b, {r('mean_a')} AS mean_a, {r('mean_b')} AS mean_b,
          {r('diff')} AS diff, {r('t')} AS t, {r('dof')} AS dof, {r('p')} AS p,
          CASE WHEN p < 0.05 THEN 'significant' ELSE 'not significant' END AS verdict
        FROM w JOIN p ON {on}""",
    )


FIT_SPLIT = (
    FEAT
    + """,
train AS (SELECT * FROM feat WHERE l_partkey % 5 <> 0),
test AS (SELECT * FROM feat WHERE l_partkey % 5 = 0)"""
)
LABEL_SPLIT = (
    LABELLED
    + """,
train AS (SELECT * FROM labelled WHERE l_partkey % 5 <> 0),
test AS (SELECT * FROM labelled WHERE l_partkey % 5 = 0)"""
)


def _filled(c: str) -> str:
    return f"coalesce({c}::DOUBLE, (SELECT median({c})::DOUBLE FROM train))"


def _scaled(c: str) -> str:
    filled = f"coalesce({c}::DOUBLE, (SELECT median({c})::DOUBLE FROM train))"
    return f"""({filled} - (SELECT avg({filled}) FROM train))
      / (SELECT stddev_pop({filled}) FROM train)"""


MODES = _union(
    [
        f"""SELECT '{c}' AS feature, (SELECT {c} FROM train WHERE {c} IS NOT NULL GROUP BY {c}
          ORDER BY count(*) DESC, {c} LIMIT 1)::BIGINT AS mode"""
        for c in NOMINAL
    ]
)
CODES = _union(
    [
        f"SELECT '{c}' AS feature, coalesce({c}::BIGINT, m.mode) AS code "
        f"FROM train, (SELECT mode FROM modes WHERE feature = '{c}') m"
        for c in NOMINAL
    ]
)
FREQUENCIES = """,
modes AS MATERIALIZED ({modes}),
frequencies AS MATERIALIZED (
  SELECT feature, code, count(*) AS n, count(*) >= {least} AS frequent
  FROM ({codes}) GROUP BY feature, code
)"""
MIN_ROWS = 1700
MODEL_MIN_ROWS = 50


def _frequencies(ctes: str, least: int) -> str:
    return ctes + FREQUENCIES.format(modes=MODES, codes=CODES, least=least)


def _mapped() -> str:
    test_codes = _union(
        [
            f"SELECT '{c}' AS feature, coalesce({c}::BIGINT, m.mode) AS code "
            f"FROM test, (SELECT mode FROM modes WHERE feature = '{c}') m"
            for c in NOMINAL
        ]
    )
    return f"""SELECT feature, slot, count(*) AS n FROM (
      SELECT t.feature, CASE WHEN f.frequent THEN t.code::VARCHAR
        WHEN EXISTS (SELECT 1 FROM frequencies g WHERE g.feature = t.feature AND NOT g.frequent)
        THEN 'infrequent' END AS slot
      FROM ({test_codes}) t
      LEFT JOIN frequencies f ON f.feature = t.feature AND f.code = t.code)
    GROUP BY feature, slot"""


def _encoded() -> str:
    """Every numeric value scaled, every code with its slot, in long form."""
    scaled = _union(
        [f"SELECT {KEYS}, '{c}' AS slot, {r(_scaled(c))} AS value FROM test" for c in NUMERIC]
    )
    coded = _union(
        [
            f"SELECT {KEYS}, '{c}' AS feature, coalesce({c}::BIGINT, m.mode) AS code "
            f"FROM test, (SELECT mode FROM modes WHERE feature = '{c}') m"
            for c in NOMINAL
        ]
    )
    return f"""SELECT * FROM ({scaled}) UNION ALL
      SELECT {KEYS}, t.feature || '=' || CASE WHEN f.frequent THEN t.code::VARCHAR
        ELSE 'infrequent' END AS slot, 1.0::DOUBLE AS value
      FROM ({coded}) t LEFT JOIN frequencies f ON f.feature = t.feature AND f.code = t.code
      WHERE f.frequent OR EXISTS (
        SELECT 1 FROM frequencies g WHERE g.feature = t.feature AND NOT g.frequent)"""


def _both_sides(column: str) -> str:
    def side(table: str, q: float) -> str:
        return f"""(SELECT quantile_cont({column}, {q}) FROM {table}) AS linear_{table},
          (SELECT x FROM (SELECT {column} AS x, row_number() OVER (ORDER BY {column}) - 1 AS i,
             count(*) OVER () AS n FROM {table}) WHERE i = floor((n-1)*{q}::DOUBLE + 0.5))
             AS nearest_{table}"""

    parts = [
        f"SELECT {q}::DOUBLE AS prob, {side('trips', q)}, {side('doubled', q)}"
        for q in (0.25, 0.5, 0.75)
    ]
    return f"""SELECT prob, {r('linear_trips')} AS linear_left, {r('nearest_trips')} AS nearest_left,
      {r('linear_doubled')} AS linear_right, {r('nearest_doubled')} AS nearest_right,
      linear_trips <> linear_doubled AS sides_differ,
      linear_trips <> nearest_doubled AS rules_differ FROM ({_union(parts)})"""


def _confusion(table: str, prediction: str) -> str:
    return f"""cells AS (
      SELECT l.label, p.prediction, (SELECT count(*) FROM {table} d
         WHERE d.jam_abs = l.label AND {prediction} = p.prediction) AS n
      FROM (VALUES (0), (1)) l(label), (VALUES (0), (1)) p(prediction)
    ),
    c AS (SELECT sum(n) FILTER (WHERE label=0 AND prediction=0)::DOUBLE AS tn,
      sum(n) FILTER (WHERE label=0 AND prediction=1)::DOUBLE AS fp,
      sum(n) FILTER (WHERE label=1 AND prediction=0)::DOUBLE AS fn,
      sum(n) FILTER (WHERE label=1 AND prediction=1)::DOUBLE AS tp FROM cells),
    k AS (SELECT 0 AS class, tn/nullif(tn+fn,0) AS precision, tn/nullif(tn+fp,0) AS recall,
        2*tn/nullif(2*tn+fn+fp,0) AS f1, (tn+fp)::BIGINT AS support FROM c
      UNION ALL SELECT 1, tp/nullif(tp+fp,0), tp/nullif(tp+fn,0), 2*tp/nullif(2*tp+fp+fn,0),
        (tp+fn)::BIGINT FROM c)"""


SUPPLIED = "CAST(d.hour BETWEEN 8 AND 18 AS INTEGER)"
METRICS = f"""SELECT (SELECT {r('(tn+tp)/(tn+tp+fp+fn)')} FROM c) AS accuracy,
  {r('avg(coalesce(f1,0))')} AS macro_f1, {r('avg(coalesce(precision,0))')} AS macro_precision,
  {r('avg(coalesce(recall,0))')} AS macro_recall FROM k"""
REPORT = f"""SELECT class::VARCHAR AS class, {r('precision')} AS precision, {r('recall')} AS recall,
  {r('f1')} AS f1, support FROM k
UNION ALL SELECT 'accuracy', NULL, NULL, {r('(tn+tp)/(tn+tp+fp+fn)')}, (tn+tp+fp+fn)::BIGINT FROM c
UNION ALL SELECT 'macro avg', {r('avg(precision)')}, {r('avg(recall)')}, {r('avg(f1)')},
  sum(support)::BIGINT FROM k
UNION ALL SELECT 'weighted avg',
  {r('sum(precision*support)/sum(support) FILTER (WHERE precision IS NOT NULL)')},
  {r('sum(recall*support)/sum(support) FILTER (WHERE recall IS NOT NULL)')},
  {r('sum(f1*support)/sum(support) FILTER (WHERE f1 IS NOT NULL)')}, sum(support)::BIGINT FROM k"""

HOURLY = f"""SELECT hour, count(*) AS trips, {r('avg(speed_mph)')} AS mean_speed,
  {r('avg(jam_abs)*100')} AS jam_pct FROM labelled GROUP BY hour"""


def _pivot() -> str:
    hours = ", ".join(
        f"{r(f'avg(speed_mph) FILTER (WHERE hour = {h})')} AS h{h:02d}" for h in range(24)
    )
    return f"""SELECT dow, ['월','화','수','목','금','토','일'][dow+1] AS weekday, {hours}
      FROM labelled GROUP BY dow"""


def _histogram() -> str:
    edge = "(low + ({0})*width)"
    return _with(
        LABELLED
        + """,
near AS (SELECT jam_abs AS label, trip_distance AS x FROM labelled WHERE trip_distance <= 15),
bounds AS (SELECT min(x) AS low, max(x) AS high, (max(x)-min(x))/60 AS width FROM near),
edges AS (SELECT i AS bin, low + i*width AS lo, low + (i+1)*width AS hi, width
          FROM bounds, (SELECT unnest(range(0, 60))::INTEGER AS i)),
placed AS (SELECT label, bin, lo, width FROM near JOIN edges
           ON x >= lo AND (x < hi OR bin = 59))""",
        f"""SELECT label, bin, {r('lo')} AS bin_start, n,
          {r('n / (sum(n) OVER (PARTITION BY label) * width)')} AS density
        FROM (SELECT label, bin, lo, width, count(*) AS n FROM placed GROUP BY ALL)""",
    )


def _label_profile() -> str:
    return _union(
        [
            f"""SELECT '{c}' AS label, {r('median(trip_distance)')} AS median_distance,
              {r('median(duration_min)')} AS median_minutes, {r('median(speed_mph)')} AS median_speed,
              {r('avg(CAST(trip_distance < 1 AS INTEGER))*100')} AS pct_short
            FROM labelled WHERE {c} = 1"""
            for c in ("jam_abs", "jam_rel")
        ]
    )


def _block() -> str:
    nulls = _null_counts("trips", "n")
    differs = _union(
        [
            f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE ({c} IS NULL)
              <> (passenger_count IS NULL)) AS d FROM trips"""
            for c in TRIP_COLUMNS
        ]
    )
    return f"""SELECT count(*) > 1 AS has_block, string_agg("column", ',' ORDER BY pos) AS columns,
        max(n) AS block_rows, {r('max(n) / (SELECT count(*) FROM trips)')} AS block_ratio
      FROM (SELECT a."column", a.n, list_position({TRIP_COLUMNS}, a."column") AS pos
            FROM ({nulls}) a JOIN ({differs}) b ON a."column" = b."column"
            WHERE a.n > 0 AND b.d = 0)"""


def oracle_sql() -> dict[str, str]:
    measures = ["trips", "mean_speed", "median_speed"]
    sides = ", ".join(
        f"a.{m} AS {m}_left, b.{m} AS {m}_right"
        if m == "trips"
        else f"{r('a.' + m)} AS {m}_left, {r('b.' + m)} AS {m}_right"
        for m in measures
    )
    passenger_columns = (
        f"passenger_count, trips, {r('mean_speed')} AS mean_speed, "
        f"{r('median_speed')} AS median_speed"
    )
    pattern = " || ".join(f"CAST({c} IS NULL AS INTEGER)::VARCHAR" for c in FEATURED_COLUMNS)
    welch = {n: _welch(n, flag, value) for n, (flag, value) in TESTS.items()}
    return {
        "scan_shape": _with(
            TRIPS,
            """SELECT count(*) AS n_rows, 16 AS n_cols,
               count(*) + count(*) FILTER (WHERE l_partkey % 50 = 0) AS n_rows_right,
               16 AS n_cols_right, count(*) FILTER (WHERE l_partkey % 50 = 0) = 0 AS shape_match
               FROM trips""",
        ),
        "time_features": _with(
            FEAT,
            f"SELECT {KEYS}, {r('duration_min')} AS duration_min, hour, dow, is_weekend FROM feat",
        ),
        "speed_feature": _with(
            FEAT,
            f"""SELECT {KEYS}, {r('trip_distance/(duration_min/60)')} AS speed_mph
            FROM feat WHERE duration_min > 0""",
        ),
        "speed_by_passenger_nulls_kept": _with(
            FEAT, f"SELECT {passenger_columns} FROM ({KEPT})"
        ),
        "speed_by_passenger_nulls_dropped": _with(
            FEAT, f"SELECT {passenger_columns} FROM ({DROPPED})"
        ),
        "agg_reconcile": _with(
            FEAT,
            f"""SELECT coalesce(a.passenger_count, b.passenger_count) AS passenger_count, {sides}
            FROM ({DROPPED}) a FULL OUTER JOIN ({KEPT}) b
            ON a.passenger_count IS NOT DISTINCT FROM b.passenger_count""",
        ),
        "agg_reconcile_summary": _with(
            FEAT,
            f"""SELECT (SELECT count(*) FROM ({DROPPED})) AS groups_left, count(*) AS groups_right,
            coalesce(sum(trips) FILTER (WHERE passenger_count IS NULL), 0)::BIGINT
              AS null_group_trips FROM ({KEPT})""",
        ),
        "null_count_reconcile": _with(
            TRIPS
            + """,
marked AS (SELECT * REPLACE (CASE WHEN ratecode_id <> 99 THEN ratecode_id END AS ratecode_id)
           FROM (SELECT * FROM trips UNION ALL SELECT * FROM trips WHERE l_partkey % 50 = 0))""",
            f"""SELECT a."column", n_null_left, n_null_right, n_null_left = n_null_right AS match,
              bool_and(n_null_left = n_null_right) OVER () AS all_match,
              (sum(n_null_left) OVER ())::BIGINT AS total_null_left
            FROM ({_null_counts('trips', 'n_null_left')}) a
            JOIN ({_null_counts('marked', 'n_null_right')}) b ON a."column" = b."column" """,
        ),
        "null_profile": _with(
            TRIPS,
            f"""SELECT "column", n_null, {r('n_null / (SELECT count(*) FROM trips) * 100')} AS pct_null,
              total_null FROM (SELECT *, (sum(n_null) OVER ())::BIGINT AS total_null
              FROM ({_null_counts('trips', 'n_null')})) WHERE n_null > 0""",
        ),
        "sentinel_profile": _with(
            TRIPS,
            f"""SELECT 'unknown_ratecode' AS item, count(*) FILTER (WHERE ratecode_id = 99) AS n_rows,
              {r('100.0::DOUBLE * count(*) FILTER (WHERE ratecode_id = 99) / count(*)')} AS pct,
              'keep as a category' AS policy FROM trips
            UNION ALL SELECT 'unknown_zone',
              count(*) FILTER (WHERE pu_zone IN (23,24) OR do_zone IN (23,24)),
              {r('100.0::DOUBLE * count(*) FILTER (WHERE pu_zone IN (23,24) OR do_zone IN (23,24)) / count(*)')},
              'drop' FROM trips""",
        ),
        "missing_patterns": _with(
            FEAT, f"SELECT {pattern} AS pattern, count(*) AS n_rows FROM feat GROUP BY 1"
        ),
        "missing_block": _with(TRIPS, _block()),
        "missing_block_by_group": _with(
            TRIPS,
            """SELECT vendor_id, n_block, n_rest, CASE WHEN n_rest = 0 THEN 'block_only'
                 WHEN n_block = 0 THEN 'rest_only' ELSE 'both' END AS presence
               FROM (SELECT vendor_id, count(*) FILTER (WHERE passenger_count IS NULL) AS n_block,
                 count(*) FILTER (WHERE passenger_count IS NOT NULL) AS n_rest
                 FROM trips WHERE vendor_id IS NOT NULL GROUP BY vendor_id)""",
        ),
        "missing_block_by_group_other": _with(
            TRIPS,
            """SELECT vendor_id, n_block, n_rest, CASE WHEN n_rest = 0 THEN 'block_only'
                 WHEN n_block = 0 THEN 'rest_only' ELSE 'both' END AS presence
               FROM (SELECT vendor_id, count(*) FILTER (WHERE l_linenumber = 1) AS n_block,
                 count(*) FILTER (WHERE l_linenumber <> 1) AS n_rest
                 FROM trips WHERE vendor_id IS NOT NULL GROUP BY vendor_id)""",
        ),
        "duplicate_count": _with(
            DOUBLED,
            """SELECT count(*) AS n_rows,
               count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM doubled)) AS n_duplicates
               FROM doubled""",
        ),
        "dedup_rows": _with(
            DOUBLED, f"SELECT {_row_columns()} FROM (SELECT DISTINCT * FROM doubled)"
        ),
        "quantile_interpolation": _with(
            TRIPS,
            f"""SELECT prob, {r('linear')} AS linear, {r('nearest')} AS nearest,
              linear <> nearest AS differs FROM ({_quantiles()})""",
        ),
        "quantile_reconcile": _with(DOUBLED, _both_sides("total_amount")),
        "clean_audit": _audit("SELECT * FROM feat", FEAT),
        "clean_audit_duplicates": _audit("SELECT * FROM doubled", DOUBLED),
        "clean_trips": _with(
            CLEAN,
            f"SELECT {_row_columns()}, {r('duration_min')} AS duration_min, hour, dow, is_weekend, "
            f"{r('speed_mph')} AS speed_mph FROM clean",
        ),
        "absolute_label": _with(
            CLEAN,
            f"""SELECT {KEYS}, {r('speed_mph')} AS speed_mph,
              CAST(speed_mph < (SELECT quantile_cont(speed_mph, 1/3) FROM clean) AS INTEGER)
              AS jam_abs FROM clean""",
        ),
        "route_medians": _with(
            LABELLED,
            f"""SELECT pu_zone, do_zone, {r('route_median_mph')} AS route_median_mph, route_trips
            FROM routes""",
        ),
        "relative_label": _with(
            LABELLED,
            f"""SELECT {KEYS}, {r('route_median_mph')} AS route_median_mph,
              {r('speed_ratio')} AS speed_ratio, jam_rel FROM labelled""",
        ),
        "label_meta": _with(
            LABELLED,
            f"""SELECT {r('max(abs_threshold)')} AS abs_threshold,
              {r('max(rel_threshold)')} AS rel_threshold, {r('avg(jam_abs)')} AS abs_rate,
              {r('avg(jam_rel)')} AS rel_rate,
              {r('avg(CAST(jam_abs = jam_rel AS INTEGER))')} AS agreement,
              (SELECT count(*) FROM routes) AS reliable_routes, count(*) AS n_rows
            FROM labelled, thresholds""",
        ),
        "label_profile": _with(LABELLED, _label_profile()),
        "describe_numeric": _with(LABELLED, _describe()),
        "correlation_matrix": _with(LABELLED, _correlations()),
        "top_correlations": _with(
            LABELLED + ",\nm AS (" + _correlations() + ")",
            """SELECT col_var AS variable, r, abs(r) AS abs_r FROM m
               WHERE row_var = 'speed_mph' AND col_var <> 'speed_mph'
               ORDER BY abs(r) DESC, col_var LIMIT 5""",
        ),
        "speed_hour_dow_pivot": _with(LABELLED, _pivot()),
        "hourly_summary": _with(LABELLED, HOURLY),
        "hourly_extremes": _with(
            LABELLED
            + """,
h AS (SELECT hour, avg(speed_mph) AS s FROM labelled GROUP BY hour),
low AS (SELECT hour, s FROM h ORDER BY s, hour LIMIT 1),
high AS (SELECT hour, s FROM h ORDER BY s DESC, hour LIMIT 1)""",
            f"""SELECT low.hour AS slowest_hour, {r('low.s')} AS slowest_speed,
              high.hour AS fastest_hour, {r('high.s')} AS fastest_speed,
              {r('high.s/low.s')} AS speed_ratio FROM low, high""",
        ),
        "zone_jam_topk": _with(
            LABELLED,
            f"""SELECT pu_zone, trips, {r('jam_pct')} AS jam_pct, {r('mean_speed')} AS mean_speed
            FROM (SELECT pu_zone, count(*) AS trips, avg(jam_abs)*100 AS jam_pct,
              avg(speed_mph) AS mean_speed FROM labelled GROUP BY pu_zone
              HAVING count(*) >= 500 ORDER BY jam_pct DESC, pu_zone LIMIT 20)""",
        ),
        "distance_histogram": _histogram(),
        "welch_ttest": _ttest(
            [_welch("jam_distance", *TESTS["jam_distance"], by="vendor_id")], by="vendor_id"
        ),
        "welch_jam_distance": _ttest([welch["jam_distance"]]),
        "welch_weekend_speed": _ttest([welch["weekend_speed"]]),
        "welch_rush_hour": _ttest([welch["rush_speed"]]),
        "ttest_summary": _ttest(list(welch.values())),
        "class_distribution": _with(
            LABELLED,
            f"""SELECT jam_abs, count(*) AS n,
              {r('count(*) / (SELECT count(*) FROM labelled)')} AS share
            FROM labelled GROUP BY jam_abs""",
        ),
        "feature_table": _with(
            LABELLED,
            f"""SELECT hour, dow, is_weekend, {r('trip_distance')} AS trip_distance,
              passenger_count, {', '.join(NOMINAL)}, jam_abs, jam_rel FROM labelled""",
        ),
        "impute_median": _with(
            FIT_SPLIT,
            f"SELECT {KEYS}, "
            + ", ".join(f"{r(_filled(c))} AS {c}" for c in NUMERIC)
            + " FROM test",
        ),
        "standardize": _with(
            FIT_SPLIT,
            f"SELECT {KEYS}, "
            + ", ".join(f"{r(_scaled(c))} AS {c}" for c in NUMERIC)
            + " FROM test",
        ),
        "impute_mode": _with(FIT_SPLIT, MODES),
        "category_frequencies": _with(
            _frequencies(FIT_SPLIT, MIN_ROWS), "SELECT feature, code, n, frequent FROM frequencies"
        ),
        "infrequent_mapping": _with(_frequencies(FIT_SPLIT, MIN_ROWS), _mapped()),
        "encoded_features": _with(_frequencies(FIT_SPLIT, MIN_ROWS), _encoded()),
        "feature_width": _with(
            _frequencies(LABEL_SPLIT, MODEL_MIN_ROWS),
            f"""SELECT ({len(NUMERIC)} + count(*) FILTER (WHERE frequent)
              + count(DISTINCT feature) FILTER (WHERE NOT frequent))::INTEGER AS n_features
            FROM frequencies""",
        ),
        "baseline_metrics": _with(
            LABEL_SPLIT
            + ",\n"
            + _confusion(
                "test",
                "(SELECT jam_abs FROM train GROUP BY jam_abs ORDER BY count(*) DESC, jam_abs LIMIT 1)",
            ),
            METRICS,
        ),
        "confusion_matrix": _with(
            LABELLED + ",\n" + _confusion("labelled", SUPPLIED), "SELECT * FROM cells"
        ),
        "classification_metrics": _with(
            LABELLED + ",\n" + _confusion("labelled", SUPPLIED), METRICS
        ),
        "classification_report": _with(
            LABELLED + ",\n" + _confusion("labelled", SUPPLIED), REPORT
        ),
        "sample_exact": _with(
            LABELLED,
            """SELECT count(*) AS n_rows, least(5000, count(*)) AS sample_rows,
               least(5000, count(*)) AS distinct_rows FROM labelled""",
        ),
        "sample_rows": _with(
            LABELLED, f"SELECT {KEYS} FROM labelled ORDER BY {PLACE}, {KEYS} LIMIT 5000"
        ),
        "split_rows": _with(
            LABELLED + SPLIT_SIZES,
            f"""SELECT {KEYS}, jam_abs, CASE WHEN row_number() OVER
                 (PARTITION BY jam_abs ORDER BY {PLACE}, {KEYS}) <= n - k THEN 'test'
                 ELSE 'train' END AS part
               FROM labelled JOIN (SELECT jam_abs, n, k FROM train) USING (jam_abs)""",
        ),
        "model_coverage": _with(
            LABELLED,
            """SELECT jam_abs, count(*) AS n_rows, 0::BIGINT AS n_null
               FROM labelled GROUP BY jam_abs""",
        ),
        "split_counts": _with(
            LABELLED + SPLIT_SIZES,
            """SELECT 'train' AS part, jam_abs, k::BIGINT AS n FROM train
               UNION ALL SELECT 'test', jam_abs, (n - k)::BIGINT FROM train""",
        ),
    }
