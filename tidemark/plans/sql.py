"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

#: Canonical daily bars of the line items.
BARS = """bars AS (
  SELECT symbol, trade_date, arg_min(price, k) AS open, max(price) AS high, min(price) AS low, arg_max(price, k) AS close, sum(quantity) AS volume
  FROM (SELECT l_suppkey AS symbol, l_shipdate::DATE AS trade_date, l_extendedprice / nullif(l_quantity, 0) AS price, l_quantity AS quantity,
               {'a': l_orderkey, 'b': l_linenumber, 'c': l_extendedprice / nullif(l_quantity, 0)} AS k FROM lineitem)
  WHERE price IS NOT NULL GROUP BY ALL
)"""


def rounded(value: str, digits: int = 4) -> str:
    """Half up in double arithmetic; adding 0 turns a negative zero into zero."""
    return f"floor(({value})::DOUBLE * 1e{digits} + 0.5::DOUBLE) / 1e{digits} + 0"


def tidy(columns: tuple[str, ...] | list[str], digits: int = 4) -> str:
    return ", ".join(f"{rounded(c, digits)} AS {c}" for c in columns)


def over(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY trade_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(fn: str, value: str, n: int, first: int | None = None) -> str:
    return f"CASE WHEN rn >= {first or n} THEN {fn}({value}) {over(n)} END"


def ratio(top: str, bottom: str) -> str:
    return f"(CASE WHEN ({bottom}) = 0 THEN (CASE WHEN ({top}) IS NOT NULL THEN 0 END) ELSE ({top}) / ({bottom}) END)::DOUBLE"


BY_DATE = "(PARTITION BY symbol ORDER BY trade_date)"


def _back(n: int) -> str:
    return f"lag(close, {n}) OVER {BY_DATE}"


#: Bars with what the rolling indicators are made of, in stages r0 to r3; r3 has all of them.
ROLLING = f"""{BARS},
n0 AS (SELECT *, row_number() OVER {BY_DATE} AS rn, lag(close) OVER {BY_DATE} AS pc, lag(high) OVER {BY_DATE} AS ph, lag(low) OVER {BY_DATE} AS pl, (high + low + close) / 3 AS TYPPRICE FROM bars),
n1 AS (SELECT *, lag(TYPPRICE) OVER {BY_DATE} AS pt FROM n0),
r0 AS (SELECT *,
  CASE WHEN rn > 1 THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS Trange,
  CASE WHEN rn > 1 THEN close - least(low, pc) END AS buying, CASE WHEN rn > 1 THEN greatest(high, pc) - least(low, pc) END AS span,
  CASE WHEN rn > 1 THEN CASE WHEN TYPPRICE > pt THEN TYPPRICE * volume ELSE 0 END END AS inflow,
  CASE WHEN rn > 1 THEN CASE WHEN TYPPRICE < pt THEN TYPPRICE * volume ELSE 0 END END AS outflow,
  CASE WHEN rn > 1 THEN {ratio("high - ph", "ph")} END AS rx, CASE WHEN rn > 1 THEN {ratio("low - pl", "pl")} END AS ry FROM n1),
r1 AS (SELECT *,
  {", ".join(f"{roll('avg', 'close', n)} AS sma{n}" for n in (5, 10, 12, 15, 20, 26))},
  {roll("stddev_pop", "close", 20)} AS sd20,
  {", ".join(f"{roll('avg', 'close', k)} AS half{n}" for n, k in ((5, 3), (10, 5), (20, 10)))},
  {", ".join(f"{roll('avg', 'TYPPRICE', n)} AS tpm{n}, {roll('list', 'TYPPRICE', n)} AS tpl{n}" for n in (5, 10, 15))},
  {roll("sum", "inflow", 14, 15)} AS in14, {roll("sum", "outflow", 14, 15)} AS out14,
  {", ".join(f"CASE WHEN rn > {n} THEN close - {_back(n)} END AS MOM{n}" for n in (10, 15, 20))},
  {", ".join(f"CASE WHEN rn > {n} THEN 100 * {ratio(f'close - {_back(n)}', _back(n))} END AS ROC{n}" for n in (5, 10, 20))},
  CASE WHEN rn >= 5 THEN 100 * {ratio(f"close - min(low) {over(5)}", f"max(high) {over(5)} - min(low) {over(5)}")} END AS raw_k,
  CASE WHEN rn >= 14 THEN -100 * {ratio(f"max(high) {over(14)} - close", f"max(high) {over(14)} - min(low) {over(14)}")} END AS WILLR,
  {", ".join(f"{roll('sum', x, n, 29)} AS {x}{n}" for x in ("buying", "span") for n in (7, 14, 28))},
  {roll("sum", "rx * ry", 5, 6)} AS sxy, {roll("sum", "rx * rx", 5, 6)} AS sxx, {roll("sum", "rx", 5, 6)} AS sx, {roll("sum", "ry", 5, 6)} AS sy FROM r0),
r2 AS (SELECT *, sma20 + 2 * sd20 AS upperband, sma20 AS middleband, sma20 - 2 * sd20 AS lowerband,
  {", ".join(f"{roll('avg', f'half{n}', k, n)} AS TRIMA{n}" for n, k in ((5, 3), (10, 6), (20, 11)))},
  sma12 - sma26 AS APO, 100 * {ratio("sma12 - sma26", "sma26")} AS PPO,
  {", ".join(f"{ratio(f'TYPPRICE - tpm{n}', f'0.015::DOUBLE * list_sum(list_transform(tpl{n}, lambda x: abs(x - tpm{n}))) / {n}')} AS CCI{n}" for n in (5, 10, 15))},
  CASE WHEN in14 + out14 < 1 THEN 0 ELSE 100 * {ratio("in14", "in14 + out14")} END AS MFI,
  CASE WHEN rn >= 7 THEN raw_k END AS fastk, {roll("avg", "raw_k", 3, 7)} AS fastd, CASE WHEN rn >= 9 THEN {roll("avg", "raw_k", 3, 7)} END AS slowk,
  100 * (4 * {ratio("buying7", "span7")} + 2 * {ratio("buying14", "span14")} + {ratio("buying28", "span28")}) / 7 AS ULTOSC,
  {ratio("5 * sxy - sx * sy", "5 * sxx - sx * sx")} AS BETA FROM r1),
r3 AS (SELECT *, {roll("avg", "fastd", 3, 9)} AS slowd FROM r2)"""


def _ema_step(n: int, first: int, name: str) -> str:
    k = f"(2::DOUBLE / {n + 1})"
    return f"CASE WHEN b.rn = {first} THEN b.m{n} WHEN b.rn > {first} THEN e.{name} + {k} * (b.close - e.{name}) END AS {name}"


_EMAS = [(f"ema{n}", n, n) for n in (5, 10, 15, 20)] + [("fast510", 5, 10), ("slow510", 10, 10), ("fast520", 5, 20), ("slow520", 20, 20), ("fast1020", 10, 20), ("fast1520", 15, 20), ("fast1226", 12, 26), ("slow1226", 26, 26)]
_MEANS = sorted({n for _, n, _ in _EMAS})


def _wilder_step(name: str, value: str, n: int) -> str:
    return f"CASE WHEN b.rn = {n + 1} THEN b.{name}_seed WHEN b.rn > {n + 1} THEN (e.{name} * {n - 1} + b.{value}) / {n} END AS {name}"


_WILDERS = [("g14", "gain", 14), ("l14", "loss", 14), ("g8", "gain", 8), ("l8", "loss", 8), ("ATR", "trange", 14)]

#: Exponential averages, MACD lines, RSI and ATR by recursion over each symbol's bars: table x.
RECURSIVE = f"""{BARS},
c0 AS (SELECT *, row_number() OVER {BY_DATE} AS rn, close - lag(close) OVER {BY_DATE} AS change, lag(close) OVER {BY_DATE} AS pc FROM bars),
c1 AS (SELECT *, greatest(change, 0) AS gain, greatest(-change, 0) AS loss, CASE WHEN rn > 1 THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS trange,
  {", ".join(f"avg(close) {over(n)} AS m{n}" for n in _MEANS)} FROM c0),
c2 AS MATERIALIZED (SELECT *, {", ".join(f"avg({v}) {over(n)} AS {name}_seed" for name, v, n in _WILDERS)} FROM c1),
x0 AS (
  SELECT symbol, rn, {", ".join(f"NULL::DOUBLE AS {name}" for name, _, _ in _EMAS)}, {", ".join(f"NULL::DOUBLE AS {name}" for name, _, _ in _WILDERS)} FROM c2 WHERE rn = 1
  UNION ALL
  SELECT b.symbol, b.rn, {", ".join(_ema_step(n, first, name) for name, n, first in _EMAS)}, {", ".join(_wilder_step(*w) for w in _WILDERS)}
  FROM x0 e JOIN c2 b ON b.symbol = e.symbol AND b.rn = e.rn + 1
),
x AS (SELECT b.symbol, b.trade_date, b.rn, b.close, b.high, b.low, ema5, ema10, ema15, ema20,
  CASE WHEN b.rn >= 18 THEN fast510 - slow510 END AS macd510, CASE WHEN b.rn >= 28 THEN fast520 - slow520 END AS macd520,
  CASE WHEN b.rn >= 28 THEN fast1020 - slow520 END AS macd1020, CASE WHEN b.rn >= 28 THEN fast1520 - slow520 END AS macd1520,
  CASE WHEN b.rn >= 34 THEN fast1226 - slow1226 END AS macd1226,
  100 * {ratio("g14", "g14 + l14")} AS RSI14, 100 * {ratio("g8", "g8 + l8")} AS RSI8, ATR
  FROM x0 JOIN c2 b USING (symbol, rn))"""


def _directional(n: int) -> str:
    """Sums of the directional movements and of the range over n bars, Wilder's way: columns of one recursion."""
    out = []
    for name, value in (("p", "plus"), ("m", "minus"), ("t", "trange")):
        out.append(f"CASE WHEN b.rn = {n} THEN b.{name}{n}_seed WHEN b.rn > {n} THEN e.{name}{n} - e.{name}{n} / {n} + b.{value} END AS {name}{n}")
    return ", ".join(out)


_ADX = (5, 10, 20)

#: ADX by two recursions, after RECURSIVE: table adx.
ADX = f"""y0 AS (SELECT symbol, trade_date, rn, trange,
  CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END::DOUBLE AS plus, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END::DOUBLE AS minus
  FROM (SELECT *, lag(high) OVER {BY_DATE} AS ph, lag(low) OVER {BY_DATE} AS pl FROM c2)),
y1 AS MATERIALIZED (SELECT *, {", ".join(f"sum({v}) {over(n - 1)} AS {name}{n}_seed" for n in _ADX for name, v in (("p", "plus"), ("m", "minus"), ("t", "trange")))} FROM y0),
y2 AS (
  SELECT symbol, rn, {", ".join(f"NULL::DOUBLE AS {x}{n}" for n in _ADX for x in "pmt")} FROM y1 WHERE rn = 1
  UNION ALL SELECT b.symbol, b.rn, {", ".join(_directional(n) for n in _ADX)} FROM y2 e JOIN y1 b ON b.symbol = e.symbol AND b.rn = e.rn + 1
),
y3 AS (SELECT symbol, rn, {", ".join(f"CASE WHEN rn > {n} THEN {ratio(f'100 * abs(p{n} - m{n})', f'p{n} + m{n}')} END AS dx{n}" for n in _ADX)} FROM y2),
y4 AS MATERIALIZED (SELECT *, {", ".join(f"avg(dx{n}) OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS s{n}" for n in _ADX)} FROM y3),
y5 AS (
  SELECT symbol, rn, {", ".join(f"NULL::DOUBLE AS ADX{n}" for n in _ADX)} FROM y4 WHERE rn = 1
  UNION ALL SELECT b.symbol, b.rn, {", ".join(f"CASE WHEN b.rn = {2 * n} THEN b.s{n} WHEN b.rn > {2 * n} THEN (e.ADX{n} * {n - 1} + b.dx{n}) / {n} END" for n in _ADX)} FROM y5 e JOIN y4 b ON b.symbol = e.symbol AND b.rn = e.rn + 1
),
adx AS (SELECT symbol, trade_date, ADX5, ADX10, ADX20 FROM y5 JOIN c2 USING (symbol, rn))"""

#: Parabolic stop and reverse by recursion, after RECURSIVE: table sar. A step first tells whether the bar crosses the stop.
SAR = f"""s0 AS MATERIALIZED (SELECT symbol, trade_date, rn, high, low, CASE WHEN rn = 2 THEN high ELSE lag(high) OVER {BY_DATE} END AS hp, CASE WHEN rn = 2 THEN low ELSE lag(low) OVER {BY_DATE} END AS lp,
  lead(high) OVER {BY_DATE} AS nh, lead(low) OVER {BY_DATE} AS nl FROM c2),
s1 AS (
  SELECT symbol, rn, NULL::DOUBLE AS SAR, NOT (low - nl > nh - high AND low - nl > 0) AS up, CASE WHEN low - nl > nh - high AND low - nl > 0 THEN high ELSE low END AS stop,
    CASE WHEN low - nl > nh - high AND low - nl > 0 THEN nl ELSE nh END AS extreme, 0.02::DOUBLE AS speed FROM s0 WHERE rn = 1
  UNION ALL
  SELECT symbol, rn, SAR, up, CASE WHEN up THEN least(SAR + speed * (extreme - SAR), lp, low) ELSE greatest(SAR + speed * (extreme - SAR), hp, high) END, extreme, speed
  FROM (SELECT b.symbol, b.rn, b.high, b.low, b.hp, b.lp, e.up <> (CASE WHEN e.up THEN b.low <= e.stop ELSE b.high >= e.stop END) AS up,
    CASE WHEN e.up AND b.low <= e.stop THEN greatest(e.extreme, b.hp, b.high) WHEN NOT e.up AND b.high >= e.stop THEN least(e.extreme, b.lp, b.low) ELSE e.stop END AS SAR,
    CASE WHEN e.up AND b.low <= e.stop THEN b.low WHEN NOT e.up AND b.high >= e.stop THEN b.high WHEN e.up THEN greatest(e.extreme, b.high) ELSE least(e.extreme, b.low) END AS extreme,
    CASE WHEN e.up AND b.low <= e.stop OR NOT e.up AND b.high >= e.stop THEN 0.02::DOUBLE WHEN e.up AND b.high > e.extreme OR NOT e.up AND b.low < e.extreme THEN least(e.speed + 0.02::DOUBLE, 0.2::DOUBLE) ELSE e.speed END AS speed
    FROM s1 e JOIN s0 b ON b.symbol = e.symbol AND b.rn = e.rn + 1)
),
sar AS (SELECT symbol, trade_date, SAR FROM s1 JOIN c2 USING (symbol, rn))"""

_KAMA = (10, 20, 30)


def _kama_speed(n: int) -> str:
    way, path = f"abs(close - lag(close, {n}) OVER {BY_DATE})", f"sum(abs(change)) {over(n)}"
    straight = f"(CASE WHEN {path} <= {way} OR {path} = 0 THEN 1 ELSE {way} / {path} END)"
    return f"CASE WHEN rn > {n} THEN ({straight} * (2::DOUBLE / 3 - 2::DOUBLE / 31) + 2::DOUBLE / 31) ** 2 END AS v{n}"


#: KAMA, after RECURSIVE: table kama.
KAMA = f"""k0 AS MATERIALIZED (SELECT symbol, trade_date, rn, close, {", ".join(_kama_speed(n) for n in _KAMA)} FROM c2),
k1 AS (
  SELECT symbol, rn, {", ".join(f"NULL::DOUBLE AS KAMA{n}" for n in _KAMA)} FROM k0 WHERE rn = 1
  UNION ALL SELECT b.symbol, b.rn, {", ".join(f"CASE WHEN b.rn = {n} THEN b.close WHEN b.rn > {n} THEN e.KAMA{n} + b.v{n} * (b.close - e.KAMA{n}) END" for n in _KAMA)} FROM k1 e JOIN k0 b ON b.symbol = e.symbol AND b.rn = e.rn + 1
),
kama AS (SELECT symbol, trade_date, {", ".join(f"CASE WHEN k1.rn > {n} THEN KAMA{n} END AS KAMA{n}" for n in _KAMA)} FROM k1 JOIN c2 USING (symbol, rn))"""

#: Stochastic RSI, after RECURSIVE: table stochrsi.
STOCH_RSI = f"""z0 AS (SELECT symbol, trade_date, rn, CASE WHEN rn >= 19 THEN 100 * {ratio(f"RSI14 - min(RSI14) {over(5)}", f"max(RSI14) {over(5)} - min(RSI14) {over(5)}")} END AS k FROM x),
stochrsi AS (SELECT symbol, trade_date, CASE WHEN rn >= 21 THEN k END AS fastksr, CASE WHEN rn >= 21 THEN avg(k) {over(3)} END AS fastdsr FROM z0)"""


def _list(matrix) -> str:
    return "[" + ", ".join("[" + ", ".join(repr(float(x)) + "::DOUBLE" for x in row) + "]" for row in matrix) + "]"


def buckets(vector: str, planes, band_bits: int) -> str:
    """List of ``band:bits`` of a vector."""
    n_bands = len(planes) // band_bits
    bits = f"array_to_string(list_transform({_list(planes)}, lambda p: CASE WHEN list_dot_product(p, {vector}) >= 0 THEN '1' ELSE '0' END), '')"
    return f"list_transform([{bits}], lambda t: list_transform(range(0, {n_bands}), lambda b: b || ':' || substr(t, (b * {band_bits} + 1)::BIGINT, {band_bits})))[1]"


SUMMARY = ("cum_return", "volatility", "volume_ratio", "rsi", "macd", "sma_gap")

#: Pattern vectors with their outcomes, after RECURSIVE: table patterns.
PATTERNS = f"""q0 AS (SELECT x.symbol, x.trade_date, x.close, b.volume, x.RSI14 AS rsi, x.macd1226 AS macd, CASE WHEN x.rn >= 20 THEN avg(x.close) OVER (PARTITION BY x.symbol ORDER BY x.trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS sma20,
  CASE WHEN x.trade_date < DATE '1999-01-01' THEN 'lib' ELSE 'tgt' END AS market, x.close / lag(x.close) OVER (PARTITION BY x.symbol ORDER BY x.trade_date) - 1 AS daily_return,
  lead(x.close, 3) OVER (PARTITION BY x.symbol ORDER BY x.trade_date) / x.close - 1 AS fwd_return FROM x JOIN bars b USING (symbol, trade_date)),
q1 AS (SELECT *, count(daily_return) {over(20)} AS n, list(daily_return) {over(20)} AS rets, stddev_samp(daily_return) {over(20)} AS volatility, avg(volume) {over(20)} AS mv, sum(daily_return) {over(20)} AS cum_return FROM q0),
q2 AS (SELECT *, CASE WHEN mv > 0 THEN volume / mv ELSE 1 END AS volume_ratio, CASE WHEN sma20 > 0 THEN (close - sma20) / sma20 ELSE 0 END AS sma_gap,
  list_avg(rets) AS rm, sqrt(list_sum(list_transform(rets, lambda r: (r - list_avg(rets)) ** 2)) / 20) AS rs FROM q1 WHERE n = 20),
q3 AS (SELECT market, {", ".join(f"coalesce(avg({f}), 0) AS {f}_mean, CASE WHEN stddev_samp({f}) > 1e-12 THEN stddev_samp({f}) ELSE 1 END AS {f}_sd" for f in SUMMARY)} FROM q2 GROUP BY market),
q4 AS (SELECT q2.*, list_concat(list_transform(rets, lambda r: CASE WHEN rs > 1e-12 THEN (r - rm) / rs ELSE 0 END::DOUBLE), [{", ".join(f"coalesce(({f} - {f}_mean) / {f}_sd, 0)::DOUBLE" for f in SUMMARY)}]) AS raw FROM q2 JOIN q3 USING (market)),
patterns AS MATERIALIZED (SELECT symbol, market, trade_date, close, fwd_return, CASE WHEN fwd_return < 0 THEN 1 WHEN fwd_return IS NOT NULL THEN 0 END::INT AS fwd_down,
  list_transform(raw, lambda r: r / sqrt(list_dot_product(raw, raw))) AS vector, symbol || '|' || trade_date AS id FROM q4)"""


def verdicts(planes, asked: str, band_bits: int = 10, k: int = 50) -> str:
    """CTEs up to table verdicts, after PATTERNS; ``asked`` selects the queries from patterns."""
    z = "1.96::DOUBLE"

    def side(s: str, earlier: str) -> str:
        wilson = lambda sign: f"(({s}_n_down / {s}_n::DOUBLE) + {z} * {z} / (2 * {s}_n) {sign} {z} * sqrt(({s}_n_down / {s}_n::DOUBLE) * (1 - {s}_n_down / {s}_n::DOUBLE) / {s}_n + {z} * {z} / (4 * {s}_n * {s}_n))) / (1 + {z} * {z} / {s}_n)"
        return f"""{s}1 AS (SELECT DISTINCT a.id AS query_id, b.id AS item_id FROM ab a JOIN kb b USING (bucket) WHERE b.market = '{s}' {earlier}),
{s}2 AS (SELECT query_id, item_id, list_dot_product(q.vector, i.vector) AS cosine, i.fwd_return, i.fwd_down FROM {s}1 JOIN asked q ON q.id = query_id JOIN known i ON i.id = item_id),
{s}3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, item_id) AS r FROM {s}2),
{s}4 AS (SELECT query_id, count(*) AS {s}_n, sum(fwd_down) AS {s}_n_down, avg(fwd_return) AS {s}_mean_return, min(fwd_return) AS {s}_worst_return, avg(cosine) AS {s}_avg_cosine FROM {s}3 WHERE r <= {k} GROUP BY query_id),
{s}5 AS (SELECT *, {s}_n_down / {s}_n::DOUBLE AS {s}_p_down, greatest(0, {wilson("-")}) AS {s}_ci_low, least(1, {wilson("+")}) AS {s}_ci_high,
  {s}_n_down / {s}_n::DOUBLE - (SELECT avg(fwd_down) FROM known WHERE market = '{s}') AS {s}_excess FROM {s}4)"""

    figures = ", ".join(f"coalesce({s}_{c}, 0) AS {s}_{c}" for s in ("lib", "tgt") for c in ("n", "p_down", "ci_low", "ci_high", "excess", "mean_return", "worst_return", "avg_cosine"))
    return f"""known AS MATERIALIZED (SELECT *, {buckets("vector", planes, band_bits)} AS band_buckets FROM patterns WHERE fwd_down IS NOT NULL),
asked AS MATERIALIZED (SELECT * FROM known WHERE {asked}),
kb AS (SELECT id, market, trade_date, unnest(band_buckets) AS bucket FROM known), ab AS (SELECT id, trade_date, unnest(band_buckets) AS bucket FROM asked),
{side("lib", "")},
{side("tgt", "AND b.trade_date < a.trade_date")},
v0 AS (SELECT a.id AS query_id, a.symbol, a.trade_date, a.fwd_return, a.fwd_down AS actual_down, {figures} FROM asked a LEFT JOIN lib5 ON lib5.query_id = a.id LEFT JOIN tgt5 ON tgt5.query_id = a.id),
v1 AS (SELECT *, {", ".join(f"greatest(0, least(100, 50 + 100 * {s}_excess)) AS {s}_risk, CASE WHEN {s}_n > 0 THEN {s}_n / ({s}_n + 10.0::DOUBLE) * greatest(0, 1 - greatest(0, {s}_ci_high - {s}_ci_low)) ELSE 0 END AS {s}_trust" for s in ("lib", "tgt"))} FROM v0),
v2 AS (SELECT *, lib_trust + 1.5::DOUBLE * tgt_trust AS weight FROM v1),
v3 AS (SELECT *, CASE WHEN weight > 1e-9 THEN (lib_trust * lib_risk + 1.5::DOUBLE * tgt_trust * tgt_risk) / weight ELSE 50 END AS risk_score,
  CASE WHEN weight > 1e-9 THEN (lib_trust * lib_n + tgt_trust * tgt_n) / greatest(1, lib_n + tgt_n) ELSE 0 END AS both_,
  CASE WHEN abs(lib_excess) < 1e-9 OR abs(tgt_excess) < 1e-9 THEN 'NEUTRAL' WHEN lib_excess * tgt_excess > 0 THEN 'ALIGNED' ELSE 'CONFLICT' END AS agreement FROM v2),
v4 AS (SELECT *, CASE agreement WHEN 'ALIGNED' THEN least(1, both_ * 1.15::DOUBLE) WHEN 'CONFLICT' THEN both_ * 0.8::DOUBLE ELSE both_ END AS confidence,
  CASE WHEN risk_score >= 65 THEN 'STRONG' WHEN risk_score >= 40 THEN 'CAUTION' ELSE 'SAFE' END AS label FROM v3),
verdicts AS (SELECT *, CASE WHEN confidence >= 0.6::DOUBLE THEN 'HIGH' WHEN confidence >= 0.3::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS confidence_label,
  CASE WHEN floor(risk_score * 10 + 0.5::DOUBLE) / 10 >= 50 THEN 1 ELSE 0 END AS pred_down FROM v4)"""
