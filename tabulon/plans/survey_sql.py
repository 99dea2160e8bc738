"""DuckDB SQL that gives the same rows as the deterministic queries in survey.py."""

from __future__ import annotations

_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({c}), '\\W+'), lambda x: x <> ''))"

_SMALL = """small AS (
  SELECT l_orderkey, l_linenumber, l_returnflag = 'N' AS open, CASE WHEN l_orderkey % 5 <> 0 THEN l_linestatus = 'O' END AS status_o,
         (l_suppkey % 3)::BIGINT AS third, (CASE WHEN l_partkey % 10 < 7 THEN 1 ELSE l_partkey % 30 END)::BIGINT AS lump FROM lineitem)"""

_PARTITIONS = """parts AS (
  SELECT c_custkey AS row_id, 0 AS sample, (c_custkey % 4)::INT AS grp FROM customer
  UNION ALL SELECT c_custkey, 1, CASE WHEN c_custkey % 4 < 2 THEN 0 ELSE 1 END FROM customer
  UNION ALL SELECT c_custkey, 2, CASE WHEN c_custkey % 11 = 0 THEN 5 ELSE (c_custkey % 4)::INT END FROM customer)"""

_MODE_BOOL = "SELECT '{c}' AS column_name, (sum({c}::INT) > sum((NOT {c})::INT))::BIGINT AS value, greatest(sum({c}::INT), sum((NOT {c})::INT))::BIGINT AS n, (SELECT count(*) FROM small) AS rows FROM small"
_MODE_COUNT = "SELECT '{c}', v, n, (SELECT count(*) FROM small) FROM (SELECT {c} AS v, count(*) AS n FROM small WHERE {c} < 16 GROUP BY 1 ORDER BY n DESC, v LIMIT 1)"
_MODES = " UNION ALL ".join([_MODE_BOOL.format(c="open"), _MODE_BOOL.format(c="status_o"), _MODE_COUNT.format(c="third"), _MODE_COUNT.format(c="lump")])

_GP = "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS total, sum(lgamma(l_quantity::BIGINT + 1)) AS log_prod FROM lineitem GROUP BY 1, 2"
_NICH = "SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_discount) AS mean, var_pop(l_discount) * count(*) AS m2 FROM lineitem GROUP BY 1, 2"
_ENTROPY = "(SELECT -sum(n / t * ln(n / t)) FROM (SELECT n, sum(n) OVER () AS t FROM (SELECT count(*) AS n FROM lineitem GROUP BY {k})))"

_SCORES = """
t AS (SELECT l_orderkey, l_linenumber, l_linestatus, floor(l_quantity / 10)::INT AS q FROM lineitem),
c AS (SELECT l_linestatus AS grp, q, count(*) AS n FROM t GROUP BY 1, 2),
p AS (SELECT grp, q, ln((n + 0.5) / (sum(n) OVER (PARTITION BY grp) + 3.0)) AS lp FROM c),
g AS (SELECT l_orderkey, l_linenumber, grp, round(lp, 8) AS lp FROM t JOIN p USING (q)),
w AS (SELECT l_linestatus AS grp, ln(count(*) / (SELECT count(*) FROM lineitem)) AS lw FROM lineitem GROUP BY 1),
x AS (SELECT l_orderkey, l_linenumber, lp + lw AS x FROM g JOIN w USING (grp)),
m AS (SELECT l_orderkey, l_linenumber, max(x) AS m FROM x GROUP BY 1, 2),
s AS (SELECT x.l_orderkey, x.l_linenumber, round(max(m) + ln(sum(exp(x - m))), 6) AS lse FROM x JOIN m USING (l_orderkey, l_linenumber) GROUP BY 1, 2)"""

_HALF = "SELECT i, (i + 0.5) / 16 AS t FROM range(16) r(i)"


_DPD = "SELECT l_returnflag, l_linestatus, l_suppkey::INT AS value, count(*) AS n FROM lineitem GROUP BY 1, 2, 3"
_WEIGHTS = f"c AS ({_DPD}), v AS (SELECT value, sum(n) AS v FROM c GROUP BY 1), w AS (SELECT c.*, v / ((SELECT sum(n) FROM c) + 1.0) AS beta FROM c JOIN v USING (value))"


def _decades(low: int, high: int, count: int) -> str:
    return f"SELECT i::INT AS i, pow(10.0, {low} + {high - low} * i / {count - 1}.0) AS point FROM range({count}) r(i)"


# A model of two samples: rows grouped by status (one kind), and by flag (two kinds); alpha 2, d 0.1, an empty group in each kind.
_FIXED = """x AS (SELECT row_number() OVER () AS rn, l_orderkey * 8 + l_linenumber AS row_id, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS l_returnflag, (l_linestatus = 'O')::INT AS l_linestatus, l_linenumber - 1 AS l_linenumber, l_quantity < 20 AS low FROM lineitem),
n AS (SELECT count(*)::DOUBLE AS n FROM x),
c AS (SELECT l_returnflag, l_linestatus, l_linenumber, low, count(*)::DOUBLE AS k FROM x GROUP BY ALL),
s AS (SELECT DISTINCT l_linestatus AS g, 's' AS part FROM x UNION ALL SELECT DISTINCT l_returnflag, 'f' FROM x UNION ALL SELECT 9, 's' UNION ALL SELECT 9, 'f'),
size AS (SELECT part, g, coalesce((SELECT sum(k) FROM c WHERE (part = 's' AND l_linestatus = g) OR (part = 'f' AND l_returnflag = g)), 0) AS k FROM s),
prior AS (SELECT part, g, k, CASE WHEN k > 0 THEN (k - 0.1) / (2 + n) ELSE (2 + 0.1 * (SELECT count(*) FROM size z WHERE z.part = size.part AND z.k > 0)) / (2 + n) END AS p FROM size, n),
pf AS (SELECT part, g, v, (coalesce((SELECT sum(c.k) FROM c WHERE l_returnflag = v AND ((part = 's' AND l_linestatus = g) OR (part = 'f' AND l_returnflag = g))), 0) + 0.5) / (k + 1.5) AS q FROM prior, range(3) r(v)),
ps AS (SELECT part, g, v, (coalesce((SELECT sum(c.k) FROM c WHERE l_linestatus = v AND ((part = 's' AND l_linestatus = g) OR (part = 'f' AND l_returnflag = g))), 0) + 0.5) / (k + 1.0) AS q FROM prior, range(2) r(v)),
pn AS (SELECT part, g, v, (coalesce((SELECT sum(c.k) FROM c WHERE l_linenumber = v AND ((part = 's' AND l_linestatus = g) OR (part = 'f' AND l_returnflag = g))), 0) + 0.5) / (k + 3.5) AS q FROM prior, range(7) r(v)),
pl AS (SELECT part, g, v = 1 AS v, (coalesce((SELECT sum(c.k) FROM c WHERE low = (v = 1) AND ((part = 's' AND l_linestatus = g) OR (part = 'f' AND l_returnflag = g))), 0) + CASE WHEN v = 1 THEN 0.5 ELSE 1.5 END) / (k + 2.0) AS q FROM prior, range(2) r(v))"""


def _fixed_scores(number_seen: str, low_seen: str) -> str:
    """scored: row_id and the log of the samples' mean probability; kinds of which nothing is observed have probability 1, as their priors add up to it."""
    number, low = f"CASE WHEN {number_seen} THEN pn.q ELSE 1 END", f"CASE WHEN {low_seen} THEN pl.q ELSE 1 END"
    joins = "JOIN pf ON pf.part = prior.part AND pf.g = prior.g AND pf.v = x.l_returnflag JOIN ps ON ps.part = prior.part AND ps.g = prior.g AND ps.v = x.l_linestatus JOIN pn ON pn.part = prior.part AND pn.g = prior.g AND pn.v = x.l_linenumber JOIN pl ON pl.part = prior.part AND pl.g = prior.g AND pl.v = x.low"
    return f"""one AS (SELECT rn, row_id, sum(p * pf.q * ps.q * {number} * {low}) AS p FROM x CROSS JOIN prior {joins} WHERE prior.part = 's' GROUP BY 1, 2),
two AS (SELECT rn, sum(p * pf.q * {low}) * sum(p * ps.q * {number}) AS p FROM x CROSS JOIN prior {joins} WHERE prior.part = 'f' GROUP BY 1),
scored AS (SELECT row_id, ln((one.p + two.p) / 2) AS score FROM one JOIN two USING (rn))"""


_CONDITIONAL = """seen AS (SELECT DISTINCT l_returnflag, l_linestatus FROM x),
j AS (SELECT prior.part, l_returnflag, l_linestatus, sum(p * pf.q * ps.q) AS together, sum(p * pf.q) AS f, sum(p * ps.q) AS s FROM seen CROSS JOIN prior
  JOIN pf ON pf.part = prior.part AND pf.g = prior.g AND pf.v = l_returnflag JOIN ps ON ps.part = prior.part AND ps.g = prior.g AND ps.v = l_linestatus GROUP BY 1, 2, 3),
cond AS (SELECT l_returnflag, l_linestatus, sum(CASE WHEN part = 's' THEN together ELSE f * s END) / 2 AS both_p, sum(s) / 2 AS given_p FROM j GROUP BY 1, 2)"""


def oracle_sql() -> dict[str, str]:
    words = lambda c: _WORDS.format(c=c)
    bb_log = "lgamma(heads + 0.5) + lgamma(tails + 0.5) - lgamma(heads + tails + 1) + lgamma(1) - 2 * lgamma(0.5)"
    bb = "SELECT l_returnflag, l_linestatus, sum((l_quantity > 25)::INT)::BIGINT AS heads, sum((l_quantity <= 25)::INT)::BIGINT AS tails FROM lineitem GROUP BY 1, 2"
    dd = "SELECT l_returnflag, l_linestatus, l_linenumber AS value, count(*) AS n FROM lineitem GROUP BY 1, 2, 3"
    priority = " , ".join(f"round(sum((left(o_orderpriority, 1) = '{k}')::INT) / count(*), 8) AS p_{k}" for k in "12345")
    return {
        "lower_categorical": "SELECT c_custkey, nullif(lower(trim(c_mktsegment)), '') AS segment FROM customer",
        "percent_forward": "SELECT id, round(replace(nullif(trim(int_rate), ''), '%', '')::DOUBLE * 0.01, 6) AS rate FROM loans",
        "percent_backward": "SELECT id, round(replace(nullif(trim(int_rate), ''), '%', '')::DOUBLE, 2)::DECIMAL(10, 2)::VARCHAR || '%' AS int_rate FROM loans",
        "presence": "SELECT id, nullif(trim(emp_title), '') IS NOT NULL AS present, nullif(trim(emp_title), '') AS value FROM loans",
        "sparse_real_forward": "WITH m AS (SELECT recoveries AS tare FROM loans WHERE recoveries IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT id, recoveries <> tare AS nonzero, CASE WHEN recoveries <> tare THEN recoveries END AS value FROM loans, m",
        "sparse_real_round_trip": "SELECT id, recoveries FROM loans",
        "date_parts": "SELECT o_orderkey, round((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '2014-03-31')) / 86400000000.0, 6) AS absolute, month(o_orderdate)::INT AS mod_year, day(o_orderdate)::INT AS mod_month, (isodow(o_orderdate) - 1)::INT AS mod_week, hour(o_orderdate)::INT AS mod_day FROM orders",
        "date_relative": "SELECT l_orderkey, l_linenumber, round((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 86400000000.0, 6) AS shipped_after FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
        "date_backward": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events",
        "word_doc_freq": f"SELECT word, count(*) AS n FROM (SELECT unnest({words('p_name')}) AS word FROM part) GROUP BY 1",
        "vocab_filter": f"WITH f AS (SELECT word, count(*) AS n FROM (SELECT unnest({words('emp_title')}) AS word FROM loans) GROUP BY 1) SELECT word, n FROM f WHERE n > 0.01 * (SELECT max(n) FROM f)",
        "word_presence": f"WITH f AS (SELECT word, count(*) AS n FROM (SELECT unnest({words('emp_title')}) AS word FROM loans) GROUP BY 1), v AS (SELECT word FROM f WHERE n > 0.01 * (SELECT max(n) FROM f)) SELECT id, word, list_contains({words('trim(emp_title)')}, word) AS held FROM loans, v WHERE trim(emp_title) <> ''",
        "parse_boolean": "SELECT doc_id, annotator, toxic = 1 AS toxic FROM doc_labels",
        "symbol_codes": "WITH v AS (SELECT 'p_brand' AS feature, trim(p_brand) AS symbol FROM part UNION ALL SELECT 'p_type', trim(p_type) FROM part), c AS (SELECT feature, symbol, count(*) AS n FROM v WHERE symbol <> '' GROUP BY 1, 2) SELECT *, (row_number() OVER (PARTITION BY feature ORDER BY n DESC, symbol) - 1)::INT AS code FROM c",
        "encode_rows": "WITH s AS (SELECT o_orderstatus, (row_number() OVER (ORDER BY count(*) DESC, o_orderstatus) - 1)::INT AS a FROM orders GROUP BY 1), p AS (SELECT o_orderpriority, (row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1)::INT AS b FROM orders GROUP BY 1) SELECT o_orderkey AS row_id, a AS o_orderstatus, b AS o_orderpriority, o_totalprice FROM orders JOIN s USING (o_orderstatus) JOIN p USING (o_orderpriority)",
        "decode_rows": "SELECT o_orderkey AS row_id, o_orderstatus, o_orderpriority FROM orders",
        "rowid_interleave": "SELECT o_orderkey, o_orderkey % 4 + 4 * (row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) - 1) AS row_id FROM orders",
        "dense_row_ids": "SELECT 0::BIGINT AS lo, count(*) - 1 AS hi, count(*) AS ids FROM orders",
        "long_form": "SELECT o_orderkey AS row_id, 'price' AS feature, o_totalprice AS value FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, 'five', (o_custkey % 5)::DOUBLE FROM orders",
        "export_chunks": "SELECT count(*) AS n, greatest(1, ceil(count(*) / 1000))::BIGINT AS chunks FROM orders",
        "csv_round_trip": "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name FROM nation",
        "force_ascii": "SELECT doc_id, md5(regexp_replace(text, '[^\\x00-\\x7f]+', '', 'g')) AS text_md5 FROM documents",
        "repartition_count": "SELECT count(*)::BIGINT AS n, 100::BIGINT AS parts FROM orders",
        "bag_of_words": f"SELECT p_partkey AS doc, array_to_string(list_sort({words('p_name')}), ',') AS words FROM part WHERE len({words('p_name')}) > 0",
        "column_mode": f"WITH {_SMALL} {_MODES}",
        "tare_row": f"WITH {_SMALL}, m AS ({_MODES}) SELECT column_name, value FROM m WHERE n > 0.5 * rows",
        "sparsify_diff": f"""WITH {_SMALL}, m AS ({_MODES}), u AS (SELECT max(CASE WHEN column_name = 'open' AND n > 0.5 * rows THEN value END) AS uo, max(CASE WHEN column_name = 'lump' AND n > 0.5 * rows THEN value END) AS ul, max(CASE WHEN column_name = 'third' AND n > 0.5 * rows THEN value END) AS ut FROM m)
SELECT l_orderkey, l_linenumber, {", ".join(f"CASE WHEN {u} IS NULL OR {c}::BIGINT <> {u} THEN {c}::BIGINT END AS {c}_pos, CASE WHEN {u} IS NOT NULL AND ({c} IS NULL OR {c}::BIGINT <> {u}) THEN {u} END AS {c}_neg" for c, u in (("open", "uo"), ("lump", "ul"), ("third", "ut")))} FROM small, u""",
        "undiff": f"WITH {_SMALL} SELECT l_orderkey, l_linenumber, status_o::BIGINT AS status_o, lump FROM small",
        "suffstats_bb": bb,
        "suffstats_dd": dd,
        "suffstats_gp": f"SELECT l_returnflag, l_linestatus, n, total, round(log_prod, 3) AS log_prod FROM ({_GP})",
        "suffstats_nich": f"SELECT l_returnflag, l_linestatus, n, round(mean, 8) AS mean, round(m2, 6) AS m2 FROM ({_NICH})",
        "log_marginal_bb": f"SELECT l_returnflag, l_linestatus, round({bb_log}, 3) AS log_marginal FROM ({bb})",
        "log_marginal_dd": f"SELECT l_returnflag, l_linestatus, round(lgamma(3.5) - lgamma(sum(n) + 3.5) + sum(lgamma(n + 0.5) - lgamma(0.5)), 3) AS log_marginal FROM ({dd}) GROUP BY 1, 2",
        "log_marginal_gp": f"SELECT l_returnflag, l_linestatus, round(lgamma(2.0 + total) - lgamma(2.0) + 2.0 * ln(0.1) - (2.0 + total) * ln(0.1 + n) - log_prod, 2) AS log_marginal FROM ({_GP})",
        "log_marginal_nich": f"SELECT l_returnflag, l_linestatus, round(lgamma((n + 1.0) / 2) - lgamma(0.5) + 0.5 * ln(0.1 / (0.1 + n)) + 0.5 * ln(0.001) - (n + 1.0) / 2 * ln(0.001 + m2 + n * 0.1 * (mean - 0.05) ^ 2 / (0.1 + n)) - n / 2 * ln(pi()), 2) AS log_marginal FROM ({_NICH})",
        "suffstats_dpd": _DPD,
        "log_marginal_dpd": f"WITH {_WEIGHTS} SELECT l_returnflag, l_linestatus, round(lgamma(2.0) - lgamma(2.0 + sum(n)) + sum(lgamma(n + 2 * beta) - lgamma(2 * beta)), 2) AS log_marginal FROM w GROUP BY 1, 2",
        "hyper_grid_bb": f"WITH g AS ({_decades(-1, 2, 12)}), t AS ({bb}) SELECT i, round(point, 9) AS point, round(sum(lgamma(heads + point) + lgamma(tails + 0.5) - lgamma(heads + tails + point + 0.5) + lgamma(point + 0.5) - lgamma(point) - lgamma(0.5)), 1) AS score FROM t, g GROUP BY i, point",
        "hyper_grid_dd": f"WITH g AS ({_decades(-1, 2, 12)}), t AS ({dd}), p AS (SELECT i, point, l_returnflag, l_linestatus, lgamma(7 * point) - lgamma(7 * point + sum(n)) + sum(lgamma(n + point) - lgamma(point)) AS s FROM t, g GROUP BY 1, 2, 3, 4) SELECT i, round(point, 9) AS point, round(sum(s), 1) AS score FROM p GROUP BY i, point",
        "hyper_grid_dpd": f"WITH {_WEIGHTS}, g AS (SELECT (19 - i)::INT AS i, pow(10.0, 1 - 2 * ((i + 0.5) / 20) ** 2) AS point FROM range(20) r(i)), p AS (SELECT i, point, l_returnflag, l_linestatus, lgamma(point) - lgamma(point + sum(n)) + sum(lgamma(n + point * beta) - lgamma(point * beta)) AS s FROM w, g GROUP BY 1, 2, 3, 4) SELECT i, round(point, 9) AS point, round(sum(s), 1) AS score FROM p GROUP BY i, point",
        "hyper_grid_gp": f"WITH g AS ({_decades(-1, 5, 100)}), t AS ({_GP}) SELECT i, round(point, 9) AS point, round(sum(lgamma(point + total) - lgamma(point) + point * ln(0.1) - (point + total) * ln(0.1 + n) - log_prod), 1) AS score FROM t, g GROUP BY i, point",
        "hyper_grid_nich": f"WITH g AS ({_decades(-2, 2, 30)}), t AS ({_NICH}) SELECT i, round(point, 9) AS point, round(sum(lgamma((n + 1.0) / 2) - lgamma(0.5) + 0.5 * ln(point / (point + n)) + 0.5 * ln(0.001) - (n + 1.0) / 2 * ln(0.001 + m2 + n * point * (mean - 0.05) ^ 2 / (point + n)) - n / 2 * ln(pi())), 1) AS score FROM t, g GROUP BY i, point",
        "score_fixed": f"WITH {_FIXED}, {_fixed_scores('true', 'true')} SELECT row_id, round(score, 6) AS score FROM scored",
        "score_partial": f"WITH {_FIXED}, {_fixed_scores('row_id % 3 <> 0', 'row_id % 2 <> 0')} SELECT row_id, round(score, 6) AS score FROM scored",
        "conditional_fixed": f"WITH {_FIXED}, {_CONDITIONAL} SELECT l_returnflag, l_linestatus, round(ln(both_p / given_p), 6) AS log_probability FROM cond",
        "log_sum_exp": "WITH t AS (SELECT n_regionkey, n_nationkey * 40.0 - 500.0 AS x FROM nation), m AS (SELECT n_regionkey, max(x) AS m FROM t GROUP BY 1) SELECT n_regionkey, round(max(m) + ln(sum(exp(x - m))), 6) AS lse FROM t JOIN m USING (n_regionkey) GROUP BY 1",
        "py_grid_score": """WITH c AS (SELECT l_returnflag, l_linenumber, count(*) AS size FROM lineitem GROUP BY 1, 2), k AS (SELECT l_returnflag, count(*) AS groups, sum(size) AS n FROM c GROUP BY 1),
g AS (SELECT unnest([0.5, 2.0, 10.0])::DOUBLE AS alpha), h AS (SELECT unnest([0.0, 0.1, 0.5])::DOUBLE AS d),
s AS (SELECT l_returnflag, d, sum(lgamma(size - d) - lgamma(1 - d)) AS t FROM c, h GROUP BY 1, 2),
e AS (SELECT l_returnflag, alpha, d, coalesce(sum(ln(alpha + d * i)) FILTER (WHERE i < groups), 0) AS f FROM k, g, h, range(1, 100) r(i) GROUP BY 1, 2, 3)
SELECT e.l_returnflag, e.alpha, e.d, round(f + t - lgamma(e.alpha + n) + lgamma(e.alpha + 1), 2) AS score FROM e JOIN s ON e.l_returnflag = s.l_returnflag AND e.d = s.d JOIN k ON e.l_returnflag = k.l_returnflag""",
        "empirical_entropy": f"SELECT round({_ENTROPY.format(k='l_returnflag, l_linestatus')}, 8) AS h_joint, round({_ENTROPY.format(k='l_returnflag')}, 8) AS h_l_returnflag, round({_ENTROPY.format(k='l_linestatus')}, 8) AS h_l_linestatus",
        "mutual_information": f"WITH e AS (SELECT {_ENTROPY.format(k='l_returnflag')} + {_ENTROPY.format(k='l_linestatus')} - {_ENTROPY.format(k='l_returnflag, l_linestatus')} AS mi) SELECT round(mi, 6) AS mi, round(sqrt(1 - exp(-2 * greatest(mi, 0))), 5) AS relatedness FROM e",
        "variance_of_mean": "SELECT l_returnflag, round(avg(l_discount), 8) AS mean, round(var_samp(l_discount) / count(l_discount), 12) AS variance FROM lineitem GROUP BY 1",
        "grid_uniform": "SELECT i::INT AS i, round(-1 + 4 * t, 9) AS x FROM (" + _HALF + ")",
        "grid_center": "SELECT i::INT AS i, round(0.1 + 9.9 * (asin(2 * t - 1) / pi() + 0.5), 9) AS x FROM (" + _HALF + ")",
        "grid_left": "SELECT i::INT AS i, round(0.1 + 9.9 * t * t, 9) AS x FROM (" + _HALF + ")",
        "grid_right": "SELECT (15 - i)::INT AS i, round(10 - 9.9 * t * t, 9) AS x FROM (" + _HALF + ")",
        "grid_pitman_yor": """WITH a AS (SELECT i, asin(2 * (i + 0.5) / 20 - 1) / pi() + 0.5 AS x FROM range(20) r(i)), b AS (SELECT j, ((j + 0.5) / 10) ** 2 AS y FROM range(10) r(j))
SELECT (row_number() OVER (ORDER BY i, j) - 1)::INT AS i, round(0.1 * pow(1000.0, x), 9) AS alpha, round(0.5 * y, 9) AS d FROM a, b WHERE x + y < 1""",
        "accelerating_passes": "SELECT rows, round(CASE WHEN rows <= 4000 THEN 500 WHEN rows >= 1000000000 THEN 0 WHEN p > 2 THEN p - 1 ELSE 0 END, 6) AS passes FROM (SELECT rows, pow(501.0, ln(1e9 / rows) / ln(1e9 / 4e3)) AS p FROM (SELECT (10 ** k)::BIGINT AS rows FROM range(1, 11) r(k)))",
        "annealing_actions": "WITH RECURSIVE a AS (SELECT 0 AS i, true AS is_add, 5.0 - 1.5 AS st UNION ALL SELECT i + 1, st >= 0, CASE WHEN st >= 0 THEN st - 1.5 ELSE st + 2.5 END FROM a WHERE i < 59) SELECT i, is_add FROM a",
        "jaccard_groups": f"WITH {_PARTITIONS}, z AS (SELECT sample, grp, count(*) AS size FROM parts GROUP BY 1, 2), o AS (SELECT a.sample AS sample_a, a.grp AS grp_a, b.sample AS sample_b, b.grp AS grp_b, count(*) AS overlap FROM parts a JOIN parts b ON a.row_id = b.row_id AND a.sample < b.sample GROUP BY 1, 2, 3, 4) SELECT o.*, round(overlap / (x.size + y.size - overlap), 8) AS jaccard FROM o JOIN z x ON x.sample = sample_a AND x.grp = grp_a JOIN z y ON y.sample = sample_b AND y.grp = grp_b",
        "group_consensus_confidence": f"WITH {_PARTITIONS}, v AS (SELECT row_id, grp % 4 AS part, count(*) / 3 AS confidence FROM parts GROUP BY 1, 2), b AS (SELECT row_id, part, confidence FROM v QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY confidence DESC, part) = 1), z AS (SELECT part, (row_number() OVER (ORDER BY count(*) DESC, part) - 1)::INT AS group_id FROM b GROUP BY 1) SELECT row_id, group_id, round(confidence, 6) AS confidence FROM b JOIN z USING (part)",
        "size_sorted_ids": f"WITH {_PARTITIONS} SELECT sample, 0 AS kind, grp, count(*) AS size, (row_number() OVER (PARTITION BY sample ORDER BY count(*) DESC, grp) - 1)::INT AS new_id FROM parts GROUP BY 1, 3",
        "rowid_join": f"WITH {_PARTITIONS} SELECT c_name AS external_id, grp FROM parts JOIN customer ON row_id = c_custkey WHERE sample = 2",
        "assign_kind_join": f"WITH {_PARTITIONS} SELECT sample, (sample = 1)::INT AS kind, grp + 10 * (sample = 1)::INT AS grp, count(*) AS n FROM parts GROUP BY 1, 2, 3",
        "knn_vote": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), s AS (SELECT * FROM e WHERE vec_id % 20 = 0),
p AS (SELECT s.vec_id AS row_id, e.vec_id AS seed_id, e.label, round(list_cosine_similarity(e.v, s.v), 9) AS score FROM e, s WHERE e.vec_id <> s.vec_id),
k AS (SELECT row_id, label FROM p QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, seed_id) <= 10)
SELECT row_id, label FROM (SELECT row_id, label, count(*) AS n FROM k GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY n DESC, label) = 1""",
        "predict_histogram": f"SELECT o_orderstatus, {priority} FROM orders GROUP BY 1",
        "print_groups": "SELECT o_orderstatus AS group_id, count(*) AS rows, round(sum(o_orderkey % 17 / 16), 4) AS weight, arg_min(lpad(o_orderkey::VARCHAR, 10, '0'), (-(o_orderkey % 17), o_orderkey)) AS example FROM orders GROUP BY 1",
        "pixel_counts": "SELECT floor((x + 1) * 16)::BIGINT AS px, floor((y + 1) * 16)::BIGINT AS py, count(*) AS n FROM fox WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) GROUP BY 1, 2",
        "semi_join_rows": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
        "seeded_split": "SELECT t AS train, CASE WHEN t THEN floor(c * 0.9)::BIGINT ELSE c - floor(c * 0.9)::BIGINT END AS n FROM (SELECT count(*) AS c FROM orders), (SELECT unnest([true, false]) AS t)",
        "seeded_shuffle": "SELECT o_orderkey FROM orders",
        "stream_stats": "SELECT count(*) AS messages, max(length(props))::INT AS longest FROM events",
        "seek_rows": "SELECT event_id, event_type FROM events WHERE event_id >= 100",
        "score_groups": f"WITH {_SCORES} SELECT * FROM g",
        "score_row": f"WITH {_SCORES} SELECT * FROM s",
        "topk_search": f"WITH {_SCORES} SELECT * FROM s ORDER BY lse DESC, l_orderkey, l_linenumber LIMIT 100",
    }
