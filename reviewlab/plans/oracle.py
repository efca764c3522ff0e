"""The same queries as plain SQL for DuckDB, written independently of the Spark plans.

Common parts are composed as CTEs: a split ranks whole classes, neighbours come from all pairs. That is fine for a
check on small tables and is exactly what the Spark side avoids.
"""

from __future__ import annotations

RUNS = 10
SPACES = " || ".join(
    f"chr({code})"
    for code in (
        *range(0x09, 0x0E),
        *range(0x1C, 0x21),
        0x85,
        0xA0,
        0x1680,
        *range(0x2000, 0x200B),
        0x2028,
        0x2029,
        0x202F,
        0x205F,
        0x3000,
    )
)

CLEAN = f"""
raw AS (
  SELECT d.lang AS dataset, d.doc_id AS row_id, d.text,
         CASE WHEN l.quality = 0 THEN 'Negatief' WHEN l.toxic = 1 THEN 'Neutraal' ELSE 'Positief' END AS sentiment
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
clean AS (
  SELECT dataset, row_id, sentiment, replace(trim(text, {SPACES}), '\"\"\"', '') AS review FROM raw),
long_enough AS (SELECT * FROM clean WHERE length(review) > 10),
reviews AS (
  SELECT r.* FROM long_enough r
  WHERE r.sentiment <> 'Neutraal'
     OR (SELECT count(*) FROM long_enough o WHERE o.dataset = r.dataset AND o.sentiment = 'Neutraal') >= 10)"""

VECTORS = """
vectors AS (
  SELECT ['base', 'ext1', 'ext2', 'ext3'][(vec_id % 4) + 1] AS dataset, vec_id AS row_id,
         CASE WHEN vec_id % 4 = 2 AND label >= 7 THEN 'Neutraal'
              WHEN label % 2 = 0 THEN 'Negatief' ELSE 'Positief' END AS label,
         embedding::DOUBLE[] AS v
  FROM embeddings)"""

RUN_LIST = f"SELECT unnest(range({RUNS})) AS run"


def split(source: str, label: str, n_train: str, name: str = "split") -> str:
    """CTEs that rank every class by seeded hash; ``n_train`` is SQL over ``n_group`` and ``dataset``."""
    return f"""
{name}_counts AS (
  SELECT dataset, {label} AS label, count(*) AS n, sum(count(*)) OVER (PARTITION BY dataset)::BIGINT AS n_group
  FROM {source} GROUP BY dataset, {label}),
{name}_sizes AS (SELECT *, ({n_train})::BIGINT AS n_train FROM {name}_counts),
{name}_shares AS (
  SELECT *, (n * n_train) // n_group AS whole,
         row_number() OVER (PARTITION BY dataset ORDER BY (n * n_train) % n_group DESC, label) AS place
  FROM {name}_sizes),
{name}_quota AS (
  SELECT *, whole + CASE WHEN place <= n_train - sum(whole) OVER (PARTITION BY dataset) THEN 1 ELSE 0 END AS quota
  FROM {name}_shares),
{name} AS (
  SELECT s.dataset, s.row_id, q.label, r.run,
         CASE WHEN row_number() OVER (PARTITION BY s.dataset, q.label, r.run
                                      ORDER BY md5((42 + r.run) || ':' || s.row_id), s.row_id) <= q.quota
              THEN 'train' ELSE 'test' END AS part
  FROM {source} s
  JOIN {name}_quota q ON s.dataset = q.dataset AND s.{label} = q.label
  CROSS JOIN ({RUN_LIST}) r)"""


TEST_30 = "n_group - (3 * n_group + 9) // 10"
TEST_80 = "n_group - (8 * n_group + 9) // 10"


def _mix(source: str, base: str) -> str:
    n_base = f"(SELECT count(*) FROM {source} WHERE dataset = '{base}')"
    target = f"round_even(({n_base} - (3 * {n_base} + 9) // 10) * (0.3::DOUBLE / 0.7::DOUBLE), 0)::BIGINT"
    return f"""CASE WHEN dataset = '{base}' THEN {TEST_30}
                    WHEN {target} >= n_group THEN (9 * n_group) // 10 ELSE {target} END"""


def folds(protocol: str, source: str = "vectors", label: str = "label", base: str = "base") -> str:
    """CTE ``folds`` (model_set, eval_set, row_id, label, run, part) of a protocol."""
    rule = {
        "own": TEST_30,
        "transfer": f"CASE WHEN dataset = '{base}' THEN {TEST_30} ELSE 0 END",
        "fraction": f"CASE WHEN dataset = '{base}' THEN {TEST_30} ELSE {TEST_80} END",
        "mix": _mix(source, base),
    }[protocol]
    model_set = {
        "own": "SELECT dataset AS model_set, s.* FROM split s",
        "transfer": f"SELECT '{base}' AS model_set, s.* FROM split s",
    }.get(
        protocol,
        f"""SELECT dataset AS model_set, s.* FROM split s WHERE dataset <> '{base}'
            UNION ALL
            SELECT e.name, s.* FROM split s
            CROSS JOIN (SELECT DISTINCT dataset AS name FROM {source} WHERE dataset <> '{base}') e
            WHERE s.dataset = '{base}'""",
    )
    return f"""{split(source, label, rule)},
folds AS (SELECT model_set, dataset AS eval_set, row_id, label, run, part FROM ({model_set}))"""


WEIGHTS = """
train_counts AS (
  SELECT model_set, run, label, count(*) AS n FROM folds WHERE part = 'train' GROUP BY model_set, run, label),
weights AS (
  SELECT *, sum(n) OVER (PARTITION BY model_set, run) / (count(*) OVER (PARTITION BY model_set, run) * n)::DOUBLE AS weight
  FROM train_counts),
classes AS (
  SELECT model_set, run, list(label ORDER BY label) AS classes FROM train_counts GROUP BY model_set, run)"""

NEIGHBORS = """
pairs AS (
  SELECT t.model_set, t.eval_set, t.run, t.row_id, t.label AS y, n.row_id AS neighbor_id, n.label AS label,
         list_distance(tv.v, nv.v) AS distance
  FROM folds t JOIN folds n ON t.model_set = n.model_set AND t.run = n.run
  JOIN vectors tv ON tv.row_id = t.row_id JOIN vectors nv ON nv.row_id = n.row_id
  WHERE t.part = 'test' AND n.part = 'train'),
neighbors AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY model_set, run, row_id ORDER BY distance, neighbor_id) AS place
    FROM pairs)
  WHERE place <= 5)"""


def votes(weights: str = "uniform") -> str:
    """CTEs ``shares`` (all classes of a model, zero included) and ``scored``."""
    weight = "1.0" if weights == "uniform" else "CASE WHEN nearest = 0 THEN (distance = 0)::INT::DOUBLE ELSE 1 / distance END"
    return f"""
ballots AS (
  SELECT model_set, eval_set, run, row_id, y, label, ({weight})::DOUBLE AS w
  FROM (SELECT *, min(distance) OVER (PARTITION BY model_set, run, row_id) AS nearest FROM neighbors)),
asked AS (
  SELECT model_set, eval_set, run, row_id, y, sum(w) AS total FROM ballots
  GROUP BY model_set, eval_set, run, row_id, y),
given AS (SELECT model_set, run, row_id, label, sum(w) AS w FROM ballots GROUP BY model_set, run, row_id, label),
shares AS (
  SELECT a.model_set, a.eval_set, a.run, a.row_id, a.y, c.label,
         round(coalesce(g.w, 0) / a.total, 12) AS share,
         row_number() OVER (PARTITION BY c.model_set, c.run, a.row_id ORDER BY c.label) AS class_place,
         count(*) OVER (PARTITION BY c.model_set, c.run, a.row_id) AS n_classes
  FROM asked a JOIN train_counts c ON a.model_set = c.model_set AND a.run = c.run
  LEFT JOIN given g ON g.model_set = a.model_set AND g.run = a.run AND g.row_id = a.row_id AND g.label = c.label),
scored AS (
  SELECT model_set, eval_set, run, row_id, y,
         first(label ORDER BY share DESC, label) AS yhat,
         max(CASE WHEN n_classes = 2 AND class_place = 2 THEN share END) AS score
  FROM shares GROUP BY model_set, eval_set, run, row_id, y)"""


ACCURACY = """
facts AS (
  SELECT model_set, eval_set, run, avg((y = yhat)::INT::DOUBLE) AS value, count(*) AS n
  FROM scored GROUP BY model_set, eval_set, run)"""

LISTS = """
test_labels AS (
  SELECT model_set, eval_set, run, list(DISTINCT y ORDER BY y) AS test_labels FROM scored
  GROUP BY model_set, eval_set, run),
lists AS (
  SELECT t.*, c.classes, [x FOR x IN t.test_labels IF list_contains(c.classes, x)] AS labels
  FROM test_labels t JOIN classes c ON t.model_set = c.model_set AND t.run = c.run),
cells AS (
  SELECT model_set, eval_set, run, y, yhat, count(*) AS n FROM scored GROUP BY model_set, eval_set, run, y, yhat)"""

REPORT = """
marks AS (
  SELECT model_set, eval_set, run, y AS class, 1 AS support, (y = yhat)::INT AS hit, 0 AS predicted FROM scored
  UNION ALL
  SELECT model_set, eval_set, run, yhat, 0, 0, 1 FROM scored),
per_class AS (
  SELECT model_set, eval_set, run, class, sum(hit) AS hit, sum(support)::BIGINT AS support,
         CASE WHEN sum(predicted) = 0 THEN 0 ELSE sum(hit) / sum(predicted)::DOUBLE END AS precision,
         CASE WHEN sum(support) = 0 THEN 0 ELSE sum(hit) / sum(support)::DOUBLE END AS recall,
         2 * sum(hit) / (sum(predicted) + sum(support))::DOUBLE AS f1
  FROM marks GROUP BY model_set, eval_set, run, class),
report AS (
  SELECT model_set, eval_set, run, 0 AS place, class, precision, recall, f1, support FROM per_class
  UNION ALL
  SELECT model_set, eval_set, run, 1, 'accuracy', NULL, NULL, sum(hit) / sum(support)::DOUBLE, sum(support)::BIGINT
  FROM per_class GROUP BY model_set, eval_set, run
  UNION ALL
  SELECT model_set, eval_set, run, 2, 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT
  FROM per_class GROUP BY model_set, eval_set, run
  UNION ALL
  SELECT model_set, eval_set, run, 3, 'weighted avg', sum(precision * support) / sum(support),
         sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT
  FROM per_class GROUP BY model_set, eval_set, run)"""

AUC = """
ranked AS (
  SELECT s.model_set, s.eval_set, s.run, s.score, s.y = c.classes[2] AS positive,
         list_contains(c.classes, s.y) AS known,
         rank() OVER w + (count(*) OVER (PARTITION BY s.model_set, s.eval_set, s.run, s.score) - 1) / 2.0 AS mid_rank
  FROM scored s JOIN classes c ON s.model_set = c.model_set AND s.run = c.run
  WHERE len(c.classes) = 2
  WINDOW w AS (PARTITION BY s.model_set, s.eval_set, s.run ORDER BY s.score)),
auc_counts AS (
  SELECT model_set, eval_set, run, count(*) FILTER (positive) AS n_pos, count(*) FILTER (NOT positive) AS n_neg,
         sum(mid_rank) FILTER (positive) AS rank_sum
  FROM ranked GROUP BY model_set, eval_set, run HAVING bool_and(known)),
auc AS (
  SELECT model_set, eval_set, run, n_pos, n_neg,
         (rank_sum - n_pos * (n_pos + 1) / 2.0) / nullif(n_pos::DOUBLE * n_neg, 0) AS auc
  FROM auc_counts)"""

PAIRED = """
per_run AS (
  SELECT model_set, run, max(value) FILTER (eval_set = 'base') AS a, max(value) FILTER (eval_set <> 'base') AS b
  FROM facts GROUP BY model_set, run),
paired AS (
  SELECT 'base' AS a, model_set AS b, model_set, avg(a - b) AS mean_difference,
         avg(a - b) / nullif(stddev_samp(a - b) / sqrt(count(*)), 0) AS t, (count(*) - 1)::DOUBLE AS df
  FROM per_run GROUP BY model_set)"""

# Two-sided p by Simpson's rule over the angle atan(t / sqrt(df)): the density becomes a power of the cosine.
P_VALUE = """
1 - 2 * exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) * atan(abs(t) / sqrt(df)) / 4000 / 3
  * list_sum([(CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
              * pow(cos(atan(abs(t) / sqrt(df)) * i / 4000), df - 1) FOR i IN range(4001)])"""

WELCH = """
stats AS (
  SELECT eval_set, avg(value) AS mean, var_samp(value) / count(*) AS v, count(*) AS n FROM facts GROUP BY eval_set),
welch AS (
  SELECT p.a, p.b, p.place, (a.mean - b.mean) / nullif(sqrt(a.v + b.v), 0) AS t,
         pow(a.v + b.v, 2) / nullif(a.v * a.v / (a.n - 1) + b.v * b.v / (b.n - 1), 0) AS df
  FROM (VALUES ('base', 'ext1', 1), ('base', 'ext2', 2), ('base', 'ext3', 3), ('ext1', 'ext2', 4)) p(a, b, place)
  JOIN stats a ON a.eval_set = p.a JOIN stats b ON b.eval_set = p.b)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(part.strip("\n") for part in parts)


def _knn(protocol: str, weights: str = "uniform", *more: str) -> str:
    return _with(VECTORS, folds(protocol), WEIGHTS, NEIGHBORS, votes(weights), *more)


def _knn_summary(protocol: str) -> str:
    return f"""{_knn(protocol, "uniform", ACCURACY)}
SELECT model_set, eval_set, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*) AS runs
FROM facts GROUP BY model_set, eval_set"""


def _fold_rows(protocol: str) -> str:
    return f"{_with(VECTORS, folds(protocol))} SELECT model_set, eval_set, row_id, label, run, part FROM folds"


def _split_rows(n_train: str) -> str:
    return f"{_with(CLEAN, split('reviews', 'sentiment', n_train))} SELECT dataset, row_id, run, part FROM split"


def _fit_rows(*checks: str) -> str:
    """Every test row of every run; the checks of a fit must all hold."""
    return f"""{_with(CLEAN, folds("own", "reviews", "sentiment"))}
SELECT model_set, eval_set, run, row_id, label AS y, {", ".join(f"true AS {check}" for check in checks)}
FROM folds WHERE part = 'test'"""


_WORDS = "[w FOR w IN regexp_split_to_array(lower(review), '[^\\p{L}\\p{N}]+') IF w <> '']"
_ALL_TEXTS = f"texts AS (SELECT doc_id AS row_id, replace(trim(text, {SPACES}), '\"\"\"', '') AS review FROM documents)"


def _buckets(source: str, width: int) -> str:
    return f"""words AS (SELECT row_id, unnest({_WORDS}) AS word FROM {source}),
buckets AS (SELECT row_id, ('0x' || substr(md5(word), 1, 7))::BIGINT % {width} AS place FROM words)"""


def _hashed_vectors(width: int = 256) -> str:
    """CTE ``sparse`` (row_id, place, v): the reviews' hashed term counts, scaled to length 1, in single precision."""
    return f"""{_buckets("reviews", width)},
tf AS MATERIALIZED (SELECT row_id, place, count(*) AS n FROM buckets GROUP BY row_id, place),
lengths AS (SELECT row_id, sqrt(sum(n * n)::DOUBLE) AS length FROM tf GROUP BY row_id),
sparse AS MATERIALIZED (SELECT tf.row_id, place, (n / length)::FLOAT::DOUBLE AS v FROM tf JOIN lengths l ON tf.row_id = l.row_id)"""


def _text_folds(protocol: str, base: str) -> tuple[str, ...]:
    return CLEAN, folds(protocol, "reviews", "sentiment", base), WEIGHTS, _hashed_vectors()


def tree_scores(protocol: str = "own", base: str = "base", depth: int = 30, width: int = 256) -> str:
    """WITH ... ``scored``: one weighted Gini tree per model, a level per step, and what it says of the test rows."""
    levels = [
        f"""
ever AS (SELECT model_set, row_id, bool_or(part = 'train') AS trains FROM folds GROUP BY model_set, row_id),
x AS MATERIALIZED (
  SELECT e.model_set, e.row_id, e.trains, p.place, coalesce(s.v, 0) AS v
  FROM ever e CROSS JOIN (SELECT unnest(range({width})) AS place) p LEFT JOIN sparse s ON s.row_id = e.row_id AND s.place = p.place),
ends AS (SELECT model_set, place, min(v) AS low, max(v) AS high FROM x WHERE trains GROUP BY model_set, place),
cells AS (
  SELECT x.model_set, row_id, x.place, trains,
         greatest(0, least(1023, floor((v - low) / CASE WHEN high > low THEN high - low ELSE 1 END * 1024))) AS cell
  FROM x JOIN ends e ON x.model_set = e.model_set AND x.place = e.place),
bins AS MATERIALIZED (
  SELECT model_set, row_id, place,
         least(31, coalesce(sum(trains::INT) OVER (PARTITION BY model_set, place ORDER BY cell RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * 32
               // sum(trains::INT) OVER (PARTITION BY model_set, place)::BIGINT) AS bin
  FROM cells),
class_weights AS (
  SELECT model_set, run, max(weight) FILTER (label = 'Negatief') AS w0, max(weight) FILTER (label = 'Neutraal') AS w1,
         max(weight) FILTER (label = 'Positief') AS w2 FROM weights GROUP BY model_set, run),
state0 AS (SELECT model_set, eval_set, run, row_id, label, part, 1::BIGINT AS node FROM folds)"""
    ]
    for i in range(depth):
        levels.append(f"""
open{i} AS (
  SELECT model_set, run, node FROM state{i} WHERE part = 'train' AND node >= {1 << i} GROUP BY ALL HAVING count(DISTINCT label) > 1),
seen{i} AS (
  SELECT s.model_set, s.run, s.node, b.place, b.bin, count(*) FILTER (label = 'Negatief') AS n0,
         count(*) FILTER (label = 'Neutraal') AS n1, count(*) FILTER (label = 'Positief') AS n2
  FROM state{i} s JOIN open{i} o ON s.model_set = o.model_set AND s.run = o.run AND s.node = o.node
  JOIN bins b ON b.model_set = s.model_set AND b.row_id = s.row_id WHERE part = 'train' GROUP BY ALL),
sums{i} AS (
  SELECT *, sum(n0) OVER before AS l0, sum(n1) OVER before AS l1, sum(n2) OVER before AS l2,
         sum(n0) OVER whole AS t0, sum(n1) OVER whole AS t1, sum(n2) OVER whole AS t2
  FROM seen{i}
  WINDOW before AS (PARTITION BY model_set, run, node, place ORDER BY bin), whole AS (PARTITION BY model_set, run, node, place)),
mass{i} AS (
  SELECT s.model_set, s.run, node, place, bin, l0 + l1 + l2 < t0 + t1 + t2 AS splits,
         coalesce(l0 * w0, 0) AS l0, coalesce(l1 * w1, 0) AS l1, coalesce(l2 * w2, 0) AS l2,
         coalesce((t0 - l0) * w0, 0) AS r0, coalesce((t1 - l1) * w1, 0) AS r1, coalesce((t2 - l2) * w2, 0) AS r2,
         coalesce(t0 * w0, 0) AS t0, coalesce(t1 * w1, 0) AS t1, coalesce(t2 * w2, 0) AS t2
  FROM sums{i} s JOIN class_weights w ON s.model_set = w.model_set AND s.run = w.run),
best{i} AS MATERIALIZED (
  SELECT model_set, run, node, place, bin FROM (
    SELECT *, round(((l0 * l0 + l1 * l1 + l2 * l2) / (l0 + l1 + l2) + (r0 * r0 + r1 * r1 + r2 * r2) / (r0 + r1 + r2)) / (t0 + t1 + t2)
           - (t0 * t0 + t1 * t1 + t2 * t2) / ((t0 + t1 + t2) * (t0 + t1 + t2)), 9) AS gain
    FROM mass{i} WHERE splits)
  WHERE gain > 1e-7 QUALIFY row_number() OVER (PARTITION BY model_set, run, node ORDER BY gain DESC, place, bin) = 1),
state{i + 1} AS MATERIALIZED (
  SELECT s.model_set, s.eval_set, s.run, s.row_id, s.label, s.part,
         CASE WHEN t.node IS NULL THEN s.node WHEN b.bin <= t.bin THEN 2 * s.node ELSE 2 * s.node + 1 END AS node
  FROM state{i} s LEFT JOIN best{i} t ON s.model_set = t.model_set AND s.run = t.run AND s.node = t.node
  LEFT JOIN bins b ON b.model_set = s.model_set AND b.row_id = s.row_id AND b.place = t.place)""")
    levels.append(f"""
votes AS (
  SELECT s.model_set, s.run, s.node, s.label, count(*) * any_value(w.weight) AS v
  FROM state{depth} s JOIN weights w ON s.model_set = w.model_set AND s.run = w.run AND s.label = w.label
  WHERE part = 'train' GROUP BY s.model_set, s.run, s.node, s.label),
known AS (
  SELECT l.model_set, l.run, l.node, c.label, round(coalesce(v.v, 0) / l.total, 12) AS share,
         row_number() OVER (PARTITION BY l.model_set, l.run, l.node ORDER BY c.label) AS class_place,
         count(*) OVER (PARTITION BY l.model_set, l.run, l.node) AS n_classes
  FROM (SELECT model_set, run, node, sum(v) AS total FROM votes GROUP BY model_set, run, node) l
  JOIN weights c ON c.model_set = l.model_set AND c.run = l.run
  LEFT JOIN votes v ON v.model_set = l.model_set AND v.run = l.run AND v.node = l.node AND v.label = c.label),
leaves AS (
  SELECT model_set, run, node, first(label ORDER BY share DESC, label) AS yhat,
         max(CASE WHEN n_classes = 2 AND class_place = 2 THEN share END) AS score
  FROM known GROUP BY model_set, run, node),
scored AS (
  SELECT s.model_set, s.eval_set, s.run, s.row_id, s.label AS y, l.yhat, l.score
  FROM state{depth} s JOIN leaves l ON s.model_set = l.model_set AND s.run = l.run AND s.node = l.node WHERE part = 'test')""")
    return _with(*_text_folds(protocol, base), *levels)


def logistic_scores(protocol: str = "own", base: str = "base", one_vs_rest: bool = False, steps: int = 150, width: int = 256) -> str:
    """WITH ... ``scored``: L2 logistic regression by accelerated gradient steps from zero, of fixed length and number.

    ``fit`` holds weights and look-ahead weights of every step. Two classes have one logit, for the second.
    """
    share = "0.25" if one_vs_rest else "CASE WHEN two THEN 0.25 ELSE 0.5 END"
    if one_vs_rest:
        chance = "1 / (1 + exp(-z.z))"
        free = "f.v"
    else:
        chance = "exp(z.z - top) / (sum(exp(z.z - top)) OVER whole + CASE WHEN two THEN exp(-top) ELSE 0 END)"
        free = f"CASE WHEN f.place = {width} THEN 0 ELSE f.v END"
    tables = f"""
vectors AS MATERIALIZED (
  SELECT row_id, place, v FROM sparse UNION ALL SELECT DISTINCT row_id, {width}, 1.0::DOUBLE FROM reviews),
outputs AS MATERIALIZED (
  SELECT model_set, run, label, weight, n_classes = 2 AS two FROM (
    SELECT *, row_number() OVER (PARTITION BY model_set, run ORDER BY label) AS class_place,
           count(*) OVER (PARTITION BY model_set, run) AS n_classes
    FROM weights) WHERE n_classes > 2 OR class_place = 2),
trained AS MATERIALIZED (
  SELECT f.model_set, f.run, f.row_id, f.label, w.weight, sum(w.weight) OVER (PARTITION BY f.model_set, f.run) AS total
  FROM folds f JOIN weights w ON f.model_set = w.model_set AND f.run = w.run AND f.label = w.label WHERE part = 'train'),
bounds AS MATERIALIZED (
  SELECT model_set, run, label, bound, (sqrt(bound) - 1) / (sqrt(bound) + 1) AS rate FROM (
    SELECT o.model_set, o.run, o.label, 1 + {share} * 2 * t.total AS bound
    FROM outputs o JOIN (SELECT model_set, run, sum(weight) AS total FROM trained GROUP BY model_set, run) t
      ON o.model_set = t.model_set AND o.run = t.run)),
fit AS (
  SELECT 0 AS step, o.model_set, o.run, o.label, p.place, 0.0::DOUBLE AS w, 0.0::DOUBLE AS v
  FROM outputs o CROSS JOIN (SELECT unnest(range({width + 1})) AS place) p
  UNION ALL
  SELECT step + 1, model_set, run, label, place, moved, moved + rate * (moved - w) FROM (
    SELECT f.step, f.model_set, f.run, f.label, f.place, f.w, b.rate, f.v - (coalesce(g.g, 0) + {free}) / b.bound AS moved
    FROM fit f
    JOIN bounds b ON b.model_set = f.model_set AND b.run = f.run AND b.label = f.label
    LEFT JOIN (
      SELECT c.model_set, c.run, c.label, x.place, sum(c.off * x.v) AS g FROM (
        SELECT z.model_set, z.run, z.row_id, z.label, t.weight * ({chance} - (t.label = z.label)::INT) AS off
        FROM (
          SELECT *, greatest(max(z) OVER (PARTITION BY model_set, run, row_id), CASE WHEN two THEN 0 ELSE -1e300 END) AS top
          FROM (
            SELECT t.model_set, t.run, t.row_id, f.label, o.two, sum(f.v * x.v) AS z
            FROM trained t JOIN vectors x ON x.row_id = t.row_id
            JOIN fit f ON f.model_set = t.model_set AND f.run = t.run AND f.place = x.place
            JOIN outputs o ON o.model_set = f.model_set AND o.run = f.run AND o.label = f.label
            GROUP BY t.model_set, t.run, t.row_id, f.label, o.two)) z
        JOIN trained t ON t.model_set = z.model_set AND t.run = z.run AND t.row_id = z.row_id
        WINDOW whole AS (PARTITION BY z.model_set, z.run, z.row_id)) c
      JOIN vectors x ON x.row_id = c.row_id GROUP BY c.model_set, c.run, c.label, x.place) g
      ON g.model_set = f.model_set AND g.run = f.run AND g.label = f.label AND g.place = f.place
    WHERE f.step < {steps})),
logits AS (
  SELECT f.model_set, f.eval_set, f.run, f.row_id, f.label AS y, w.label, o.two, sum(w.w * x.v) AS z
  FROM folds f JOIN vectors x ON x.row_id = f.row_id
  JOIN fit w ON w.step = {steps} AND w.model_set = f.model_set AND w.run = f.run AND w.place = x.place
  JOIN outputs o ON o.model_set = w.model_set AND o.run = w.run AND o.label = w.label
  WHERE f.part = 'test' GROUP BY ALL),
scored AS (
  SELECT l.model_set, eval_set, l.run, row_id, y,
         CASE WHEN any_value(two) AND max(z) <= 0 THEN any_value(c.classes[1]) ELSE first(l.label ORDER BY z DESC, l.label) END AS yhat,
         CASE WHEN any_value(two) THEN 1 / (1 + exp(-max(z))) END AS score
  FROM logits l JOIN classes c ON c.model_set = l.model_set AND c.run = l.run
  GROUP BY l.model_set, eval_set, l.run, row_id, y
  UNION ALL
  SELECT f.model_set, f.eval_set, f.run, f.row_id, f.label, c.classes[1], NULL
  FROM folds f JOIN classes c ON c.model_set = f.model_set AND c.run = f.run WHERE part = 'test' AND len(c.classes) = 1)"""
    return _with(*_text_folds(protocol, base), tables).replace("WITH", "WITH RECURSIVE", 1)


_SCORED = "SELECT model_set, eval_set, run, row_id, y, yhat, round(score, {digits}) AS score FROM scored"


_MATRIX_LINES = """
axis AS (
  SELECT t.model_set, t.eval_set, t.run, t.y, t.yhat, coalesce(c.n, 0) AS n
  FROM (SELECT model_set, eval_set, run, y, unnest(classes) AS yhat
        FROM (SELECT model_set, eval_set, run, unnest(classes) AS y, classes FROM lists)) t
  LEFT JOIN cells c USING (model_set, eval_set, run, y, yhat)),
widths AS (
  SELECT model_set, eval_set, run, yhat, max(greatest(length(yhat), length(n::VARCHAR))) AS w
  FROM axis GROUP BY model_set, eval_set, run, yhat),
matrix_lines AS (
  SELECT model_set, eval_set, run, 'y' || y AS place,
         rpad(y, max(length(y)) OVER (PARTITION BY model_set, eval_set, run)::INT, ' ') || cells AS line
  FROM (SELECT a.model_set, a.eval_set, a.run, a.y,
               string_agg('  ' || lpad(a.n::VARCHAR, w.w::INT, ' '), '' ORDER BY a.yhat) AS cells
        FROM axis a JOIN widths w USING (model_set, eval_set, run, yhat) GROUP BY a.model_set, a.eval_set, a.run, a.y)
  UNION ALL
  SELECT model_set, eval_set, run, '',
         repeat(' ', max(length(yhat))::INT) || string_agg('  ' || lpad(yhat, w::INT, ' '), '' ORDER BY yhat)
  FROM widths GROUP BY model_set, eval_set, run)"""

_REPORT_LINES = f"""{_knn("own", "uniform", ACCURACY, LISTS, REPORT, AUC, _MATRIX_LINES)},
sections AS (
  SELECT run, eval_set, 0 AS part, 0 AS a, '' AS b, '--- Evaluatie ' || eval_set || ' (70/30 split) ---' AS line FROM facts
  UNION ALL
  SELECT run, eval_set, 1, CASE WHEN place = 0 THEN 2 ELSE 3 + place END, class, lpad(class, 12, ' ') || ' '
    || ' ' || lpad(CASE WHEN place = 1 THEN '' ELSE printf('%.2f', precision) END, 9, ' ')
    || ' ' || lpad(CASE WHEN place = 1 THEN '' ELSE printf('%.2f', recall) END, 9, ' ')
    || ' ' || lpad(printf('%.2f', f1), 9, ' ') || ' ' || lpad(support::VARCHAR, 9, ' ')
  FROM report
  UNION ALL
  SELECT run, eval_set, 1, 0, '', lpad('', 12, ' ') || '  precision    recall  f1-score   support' FROM facts
  UNION ALL
  SELECT run, eval_set, 1, unnest([1, 3, 7]), '', '' FROM facts
  UNION ALL
  SELECT run, eval_set, 3, 0, '', 'Confusion Matrix:' FROM facts
  UNION ALL
  SELECT run, eval_set, 4, 0, place, line FROM matrix_lines
  UNION ALL
  SELECT run, eval_set, 6, 0, '', 'AUC-ROC: ' || printf('%.4f', auc) FROM auc WHERE auc IS NOT NULL
  UNION ALL
  SELECT run, eval_set, 7, unnest([0, 1]), '', '' FROM facts
  UNION ALL
  SELECT run, '', -1, 0, '', '=== Run ' || (run + 1) || ' Evaluaties ===' FROM ({RUN_LIST}))
SELECT run, line, row_number() OVER (
  PARTITION BY run ORDER BY coalesce(list_position(['base', 'ext1', 'ext2', 'ext3'], eval_set), 0), part, a, b) AS line_no
FROM sections"""

_TITLE = f"=== STATISTISCHE SAMENVATTING OVER {RUNS} RUNS ==="

ORACLE: dict[str, str] = {
    "clean_reviews": f"{_with(CLEAN)} SELECT dataset, row_id, sentiment, review FROM clean",
    "registry_union": f"""{_with(CLEAN, VECTORS)}
SELECT dataset, sentiment AS label, row_id FROM raw UNION ALL SELECT dataset, label, row_id FROM vectors""",
    "registry_files": f"{_with(CLEAN)} SELECT dataset, sentiment, text AS review FROM raw",
    "short_text_filter": f"{_with(CLEAN)} SELECT dataset, row_id, length(review) AS n_chars FROM long_enough",
    "rare_class_drop": f"{_with(CLEAN)} SELECT dataset, row_id, sentiment FROM reviews",
    "rare_any_class_drop": f"""{_with(CLEAN)}
SELECT dataset, row_id, sentiment FROM long_enough
QUALIFY count(*) OVER (PARTITION BY dataset, sentiment) >= 10""",
    "class_counts": f"{_with(CLEAN)} SELECT dataset, sentiment, count(*) AS n FROM long_enough GROUP BY dataset, sentiment",
    "class_lists": f"""{_with(CLEAN)}
SELECT dataset, string_agg(DISTINCT sentiment, ',' ORDER BY sentiment) AS classes FROM reviews GROUP BY dataset""",
    "label_encode": f"""{_with(CLEAN)}
SELECT dataset, row_id, sentiment,
       dense_rank() OVER (PARTITION BY dataset ORDER BY sentiment) - 1 AS label_index, sentiment AS label,
       CASE WHEN n = 2 THEN dense_rank() OVER (PARTITION BY dataset ORDER BY sentiment) - 1 END AS positive
FROM reviews JOIN (SELECT dataset, count(DISTINCT sentiment) AS n FROM reviews GROUP BY dataset) USING (dataset)""",
    "strat_split_30": _split_rows(TEST_30),
    "strat_split_80": _split_rows(TEST_80),
    "strat_sample_fixed": _split_rows("CASE WHEN 50 >= n_group THEN (9 * n_group) // 10 ELSE 50 END"),
    "quota_allocation": f"""{_with(CLEAN, split("reviews", "sentiment", TEST_30))}
SELECT dataset, label AS sentiment, n, n_group, n_train, quota::BIGINT AS quota FROM split_quota""",
    "repeated_runs": f"{_with(CLEAN)} SELECT dataset, row_id, run, 42 + run AS seed FROM reviews CROSS JOIN ({RUN_LIST})",
    "mix_70_30_train": _fold_rows("mix"),
    "fraction_train": _fold_rows("fraction"),
    "transfer_train": _fold_rows("transfer"),
    "mix_fallback_90_10": f"""{_with(CLEAN, folds("mix", "reviews", "sentiment", "en"))}
SELECT model_set, eval_set, row_id, label, run, part FROM folds""",
    "balanced_weights": f"""{_with(VECTORS, folds("mix"), WEIGHTS)}
SELECT model_set, run, label, n, round(weight, 6) AS weight FROM weights""",
    "sample_weights": f"""{_with(VECTORS, folds("own"), WEIGHTS)}
SELECT f.model_set, f.run, f.row_id, f.label, round(w.weight, 6) AS weight
FROM folds f JOIN weights w ON f.model_set = w.model_set AND f.run = w.run AND f.label = w.label
WHERE f.part = 'train'""",
    "model_classes": f"""{_with(VECTORS, folds("mix"), WEIGHTS)}
SELECT model_set, run, array_to_string(classes, ',') AS classes FROM classes""",
    "knn_neighbors": f"""{_with(VECTORS, folds("own"), NEIGHBORS)}
SELECT model_set, run, row_id, place, neighbor_id, label, round(distance, 6) AS distance FROM neighbors""",
    "knn_predict_uniform": f"""{_knn("own")}
SELECT model_set, eval_set, run, row_id, y, yhat, round(score, 6) AS score FROM scored""",
    "knn_predict_distance": f"""{_knn("own", "distance")}
SELECT model_set, eval_set, run, row_id, y, yhat, round(score, 6) AS score FROM scored""",
    "knn_proba": f"""{_knn("own", "distance")}
SELECT model_set, run, row_id, label, round(share, 6) AS share FROM shares""",
    "match_flags": f"{_knn('own')} SELECT model_set, run, row_id, y = yhat AS matched FROM scored",
    "accuracy": f"""{_knn("own", "uniform", ACCURACY)}
SELECT model_set, eval_set, run, round(value, 6) AS accuracy, n FROM facts""",
    "confusion_matrix": f"""{_knn("own", "uniform", LISTS)},
grid AS (
  SELECT model_set, eval_set, run, y, unnest(classes) AS yhat
  FROM (SELECT model_set, eval_set, run, unnest(classes) AS y, classes FROM lists))
SELECT model_set, eval_set, run, y, yhat, coalesce(n, 0) AS n FROM grid
LEFT JOIN cells USING (model_set, eval_set, run, y, yhat)""",
    "confusion_wide": f"""{_knn("own", "uniform", LISTS)},
grid AS (SELECT model_set, eval_set, run, unnest(classes) AS y, classes FROM lists),
counted AS (
  SELECT g.model_set, g.eval_set, g.run, g.y, g.classes,
         count(*) FILTER (s.yhat = 'Negatief') AS a, count(*) FILTER (s.yhat = 'Neutraal') AS b,
         count(*) FILTER (s.yhat = 'Positief') AS c
  FROM grid g LEFT JOIN scored s
    ON s.model_set = g.model_set AND s.eval_set = g.eval_set AND s.run = g.run AND s.y = g.y
  GROUP BY ALL)
SELECT model_set, eval_set, run, y, CASE WHEN list_contains(classes, 'Negatief') THEN a END AS "Negatief",
       CASE WHEN list_contains(classes, 'Neutraal') THEN b END AS "Neutraal",
       CASE WHEN list_contains(classes, 'Positief') THEN c END AS "Positief"
FROM counted""",
    "confusion_overlap": f"""{_knn("transfer", "uniform", LISTS)},
grid AS (
  SELECT model_set, eval_set, run, y, unnest(labels) AS yhat
  FROM (SELECT model_set, eval_set, run, unnest(labels) AS y, labels FROM lists))
SELECT model_set, eval_set, run, y, yhat, coalesce(n, 0) AS n, NULL::VARCHAR AS note FROM grid
LEFT JOIN cells USING (model_set, eval_set, run, y, yhat)
UNION ALL
SELECT model_set, eval_set, run, NULL, NULL, NULL, 'no labels in common' FROM lists WHERE len(labels) = 0""",
    "label_overlap": f"""{_knn("transfer", "uniform", LISTS)}
SELECT model_set, eval_set, run, array_to_string(test_labels, ',') AS test_labels,
       array_to_string(classes, ',') AS classes, array_to_string(labels, ',') AS labels,
       len(classes) = 2 AND len(labels) = len(test_labels) AS due
FROM lists""",
    "classification_report": f"""{_knn("mix", "uniform", REPORT)}
SELECT model_set, eval_set, run, class, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, support FROM report""",
    "roc_auc": f"""{_knn("mix", "distance", AUC)}
SELECT model_set, eval_set, run, round(auc, 6) AS auc, n_pos, n_neg FROM auc""",
    "roc_auc_vectors": f"""{_with(VECTORS)},
rows_ AS (
  SELECT dataset AS eval_set, label = 'Positief' AS positive, v[1] AS score FROM vectors WHERE label <> 'Neutraal'),
ranked AS (
  SELECT eval_set, positive, rank() OVER (PARTITION BY eval_set ORDER BY score)
         + (count(*) OVER (PARTITION BY eval_set, score) - 1) / 2.0 AS mid_rank FROM rows_),
counted AS (
  SELECT eval_set, count(*) FILTER (positive) AS n_pos, count(*) FILTER (NOT positive) AS n_neg,
         sum(mid_rank) FILTER (positive) AS s FROM ranked GROUP BY eval_set)
SELECT eval_set, round((s - n_pos * (n_pos + 1) / 2.0) / nullif(n_pos::DOUBLE * n_neg, 0), 6) AS auc, n_pos, n_neg
FROM counted""",
    "softmax_argmax": f"""{_with(VECTORS)},
powers AS (
  SELECT row_id, exp(v[1] - m) AS a, exp(v[2] - m) AS b, exp(v[3] - m) AS c
  FROM (SELECT row_id, v, greatest(v[1], v[2], v[3]) AS m FROM vectors))
SELECT row_id, round(a / (a + b + c), 6) AS p_negatief, round(b / (a + b + c), 6) AS p_neutraal,
       round(c / (a + b + c), 6) AS p_positief,
       CASE WHEN a >= b AND a >= c THEN 'Negatief' WHEN b >= c THEN 'Neutraal' ELSE 'Positief' END AS yhat
FROM powers""",
    "own_train_knn": _knn_summary("own"),
    "retrain_mix_knn": _knn_summary("mix"),
    "retrain_frac_knn": _knn_summary("fraction"),
    "transfer_knn": _knn_summary("transfer"),
    "run_metrics": f"""{_knn("own", "uniform", REPORT, AUC)}
SELECT model_set, eval_set, run,
       CASE place WHEN 1 THEN 'accuracy' WHEN 2 THEN 'macro_f1' ELSE 'weighted_f1' END AS metric, round(f1, 6) AS value
FROM report WHERE place > 0
UNION ALL SELECT model_set, eval_set, run, 'auc', round(auc, 6) FROM auc""",
    "stored_metrics": f"""{_knn("own", "uniform", REPORT, AUC)}
SELECT 'own' AS protocol, 'KNN' AS model, model_set, eval_set, run,
       CASE place WHEN 1 THEN 'accuracy' WHEN 2 THEN 'macro_f1' ELSE 'weighted_f1' END AS metric, round(f1, 6) AS value
FROM report WHERE place > 0
UNION ALL SELECT 'own', 'KNN', model_set, eval_set, run, 'auc', round(auc, 6) FROM auc""",
    "paired_t": f"""{_knn("mix", "uniform", ACCURACY, PAIRED)}
SELECT model_set, a, b, 'paired' AS kind, round(mean_difference, 6) AS mean_difference, round(t, 6) AS t, df,
       round({P_VALUE}, 6) AS p
FROM paired""",
    "paired_t_pvalue": f"""{_knn("mix", "uniform", ACCURACY, PAIRED)},
angles AS (SELECT a, b, t, atan(abs(t) / 3) AS theta, cos(atan(abs(t) / 3)) AS c FROM paired)
SELECT a, b, round(t, 6) AS t,
       round(1 - 2 / pi() * (theta + sin(theta) * (c + 2 * pow(c, 3) / 3 + 8 * pow(c, 5) / 15 + 48 * pow(c, 7) / 105)), 6) AS p
FROM angles""",
    "welch_t": f"""{_knn("own", "uniform", ACCURACY, WELCH)}
SELECT a, b, 'welch' AS kind, round(t, 6) AS t, round(df, 6) AS df, round({P_VALUE}, 6) AS p FROM welch""",
    "compare_models": f"""{_knn("own", "uniform", ACCURACY)},
{votes("distance").strip().replace("ballots", "d_ballots").replace("asked", "d_asked").replace("given", "d_given").replace("shares", "d_shares").replace("scored", "d_scored")}
SELECT 'own' AS protocol, f.model_set, f.eval_set, round(avg(f.value), 6) AS uniform, round(avg(d.value), 6) AS distance
FROM facts f JOIN (
  SELECT model_set, eval_set, run, avg((y = yhat)::INT::DOUBLE) AS value FROM d_scored GROUP BY model_set, eval_set, run) d
  ON f.model_set = d.model_set AND f.eval_set = d.eval_set AND f.run = d.run
GROUP BY f.model_set, f.eval_set""",
    "report_lines": _REPORT_LINES,
    "own_summary_lines": f"""{_knn("own", "uniform", ACCURACY, WELCH)}
SELECT '' AS set_place, 0::BIGINT AS line_no, '{_TITLE}' AS line
UNION ALL
SELECT '1' || eval_set, 0, eval_set || ': Mean Accuracy = ' || printf('%.4f', avg(value))
       || ', Std Dev = ' || printf('%.4f', stddev_samp(value)) FROM facts GROUP BY eval_set
UNION ALL
SELECT '2', place, 'T-test ' || a || ' vs ' || b || ': t = ' || printf('%.4f', t) || ', p = ' || printf('%.6f', {P_VALUE})
FROM welch""",
    "mix_summary_lines": f"""{_knn("mix", "uniform", ACCURACY, PAIRED)},
sides AS (
  SELECT model_set, eval_set, avg(value) AS mean, stddev_samp(value) AS std FROM facts GROUP BY model_set, eval_set)
SELECT '' AS set_place, 0::BIGINT AS line_no, '{_TITLE}' AS line
UNION ALL SELECT '', 1, ''
UNION ALL SELECT model_set, 0, '--- Vergelijking base vs ' || model_set || ' ---' FROM paired
UNION ALL
SELECT model_set, CASE WHEN eval_set = 'base' THEN 1 ELSE 2 END,
       eval_set || ' (mean acc)= ' || printf('%.4f', mean) || ', std= ' || printf('%.4f', std) FROM sides
UNION ALL
SELECT model_set, 3, 'Gepaarde t-test: t-stat= ' || printf('%.4f', t) || ', p-value= ' || printf('%.6f', {P_VALUE})
FROM paired
UNION ALL SELECT model_set, 4, '' FROM paired""",
    "token_cap": f"""WITH {_ALL_TEXTS}, w AS (SELECT row_id, {_WORDS}[1:512] AS words FROM texts)
SELECT row_id, len(words) AS n_words, md5(array_to_string(words, ' ')) AS words_md5 FROM w""",
    "embed_hashed": f"""WITH {_ALL_TEXTS}, {_buckets("texts", 256)}
SELECT row_id, place, count(*)::DOUBLE AS value FROM buckets GROUP BY row_id, place""",
    "embed_hashed_idf": f"""{_with(CLEAN, split("reviews", "sentiment", TEST_30))}, {_buckets("reviews", 64)},
runs AS (SELECT s.run, s.row_id, b.place, s.part FROM split s JOIN buckets b ON s.row_id = b.row_id),
sizes AS (SELECT run, count(*) AS n FROM split WHERE part = 'train' GROUP BY run),
seen AS (SELECT run, place, count(DISTINCT row_id) AS df FROM runs WHERE part = 'train' GROUP BY run, place),
tf AS (SELECT run, row_id, place, count(*) AS tf FROM runs GROUP BY run, row_id, place),
weighed AS (
  SELECT tf.run, tf.row_id, tf.place, tf.tf * ln((n + 1)::DOUBLE / (coalesce(df, 0) + 1)) AS v
  FROM tf JOIN sizes ON tf.run = sizes.run LEFT JOIN seen ON tf.run = seen.run AND tf.place = seen.place),
lengths AS (SELECT run, row_id, sqrt(sum(v * v)) AS length FROM weighed GROUP BY run, row_id)
SELECT w.run::BIGINT AS run, w.row_id, w.place, round(w.v / length, 6) AS value
FROM weighed w JOIN lengths l ON w.run = l.run AND w.row_id = l.row_id WHERE length > 0 AND v / length <> 0""",
    "embed_user_model": f"""WITH {_ALL_TEXTS},
counts AS (
  SELECT row_id, {", ".join(f"length(review) - length(replace(review, '{c}', '')) AS n_{n}" for n, c in enumerate("aein "))}
  FROM texts)
SELECT row_id, (n_0 + n_1 + n_2)::DOUBLE AS "first", (2 * n_3 + n_4)::DOUBLE AS "second" FROM counts""",
    "embed_distinct_texts": """
SELECT sha256(text) AS content_key, any_value(length(text)) AS n_chars FROM documents GROUP BY sha256(text)""",
    "embed_cached_lookup": f"""WITH {_ALL_TEXTS}, {_buckets("texts", 16)}
SELECT t.row_id, sha256(t.review) AS content_key, b.place, count(*)::DOUBLE AS value
FROM texts t JOIN buckets b ON t.row_id = b.row_id GROUP BY t.row_id, sha256(t.review), b.place""",
    "fit_rf": _fit_rows("label_known", "score_fits", "argmax_agrees", "learned"),
    "fit_rf_depth_15": _fit_rows("label_known", "score_fits", "argmax_agrees", "learned"),
    "fit_dt": f"{tree_scores()} {_SCORED.format(digits=6)}",
    "transfer_dt": f"{tree_scores('transfer', 'en')} {_SCORED.format(digits=6)}",
    "own_train_dt": f"""{tree_scores()}, {ACCURACY.strip()}
SELECT model_set, eval_set, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(*) AS runs
FROM facts GROUP BY model_set, eval_set""",
    "fit_logreg": f"{logistic_scores()} {_SCORED.format(digits=4)}",
    "fit_logreg_one_vs_rest": f"{logistic_scores(one_vs_rest=True)} {_SCORED.format(digits=4)}",
    "transfer_logreg": f"{logistic_scores('transfer', 'en')} {_SCORED.format(digits=4)}",
    "retrain_mix_logreg": f"""{logistic_scores("mix", "en")}, {ACCURACY.strip()}, {PAIRED.strip().replace("'base'", "'en'")}
SELECT a, b, model_set, 'paired' AS kind, round(mean_difference, 6) AS mean_difference, round(t, 6) AS t, df,
       round({P_VALUE}, 6) AS p
FROM paired""",
    "fit_svm": _fit_rows("label_known", "score_fits", "optimal"),
    "fit_densenet": _fit_rows("label_known", "score_fits", "argmax_agrees", "learned"),
    "fit_densenet_weighted": _fit_rows("label_known", "score_fits", "argmax_agrees", "learned"),
    "fit_densenet_early_stopping": _fit_rows("label_known", "score_fits", "argmax_agrees"),
    "fit_logreg_adam": _fit_rows("label_known", "score_fits", "argmax_agrees"),
}
