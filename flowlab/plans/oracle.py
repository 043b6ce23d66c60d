"""DuckDB twins of the registered queries (tables are pre-registered views)."""

from __future__ import annotations

from flowlab.functions.rand import hash32_sql, uniform52_sql
from flowlab.sources.adapters import EVENTS_AS_TRAFFIC_SQL, TRAFFIC_FEATURES, embeddings_as_rows_sql

SEED = 42
FEATS = TRAFFIC_FEATURES

TRAFFIC_CTE = f"""
traffic_raw AS ({EVENTS_AS_TRAFFIC_SQL}),
traffic AS (
  SELECT *,
    TRY_CAST(regexp_extract(source_file, '^(\\d+)\\.', 1) AS INTEGER) AS device_id,
    CASE WHEN split_part(source_file, '.', 2) = 'benign' THEN 'benign' ELSE 'attack' END AS binary_label,
    CASE WHEN split_part(source_file, '.', 2) = 'benign' THEN 0 ELSE 1 END AS binary_target,
    split_part(source_file, '.', 2) AS family,
    CASE WHEN len(string_split(source_file, '.')) = 4 THEN split_part(source_file, '.', 3) END AS attack_type,
    CASE WHEN split_part(source_file, '.', 2) = 'benign' OR len(string_split(source_file, '.')) <> 4
         THEN split_part(source_file, '.', 2)
         ELSE split_part(source_file, '.', 2) || '_' || split_part(source_file, '.', 3) END AS multiclass_label
  FROM traffic_raw)
"""

SPLIT_CTE = TRAFFIC_CTE + f""",
sq AS (SELECT binary_target, CAST(round_even(count(*) * 0.2::DOUBLE, 0) AS BIGINT) AS q FROM traffic GROUP BY 1),
sr AS (SELECT traffic.*, row_number() OVER (PARTITION BY binary_target
          ORDER BY {hash32_sql(SEED, 'split', 'row_key')}, row_key) AS _rn FROM traffic),
tsplit AS (SELECT sr.* EXCLUDE (_rn), CASE WHEN _rn <= sq.q THEN 'test' ELSE 'train' END AS split
           FROM sr JOIN sq USING (binary_target))
"""


def _feature_params_sql(kind: str) -> str:
    parts = []
    for i, f in enumerate(FEATS):
        x = f"CAST({f} AS DOUBLE)"
        if kind == "standard":
            parts.append(f"SELECT {i} AS position, '{f}' AS feature, avg({x}) AS center, "
                         f"CASE WHEN coalesce(stddev_pop({x}), 0) = 0 THEN 1.0 ELSE stddev_pop({x}) END AS scale "
                         f"FROM tsplit WHERE split = 'train'")
        else:
            parts.append(f"SELECT {i} AS position, '{f}' AS feature, min({x}) AS center, "
                         f"CASE WHEN max({x}) - min({x}) = 0 THEN 1.0 ELSE max({x}) - min({x}) END AS scale "
                         f"FROM tsplit WHERE split = 'train'")
    return " UNION ALL ".join(parts)


def _scaled_cols(prefix: str = "") -> str:
    cols = []
    for i, f in enumerate(FEATS):
        cols.append(f"(CAST({prefix}{f} AS DOUBLE) - (SELECT center FROM params WHERE position = {i})) / "
                    f"(SELECT scale FROM params WHERE position = {i}) AS {f}")
    return ", ".join(cols)


def scaled_cte(kind: str = "standard") -> str:
    """tsplit + params + scaled(row_key, split, binary_target, device_id, source_file, features...)."""
    return SPLIT_CTE + f""",
params AS ({_feature_params_sql(kind)}),
scaled AS (SELECT row_key, split, binary_target, device_id, source_file, family, ts, {_scaled_cols()} FROM tsplit)
"""


ORACLE: dict[str, str] = {}

ORACLE["label_events"] = f"""WITH {TRAFFIC_CTE}
SELECT row_key, source_file, device_id, binary_label, binary_target, family, attack_type, multiclass_label
FROM traffic"""

ORACLE["class_distribution"] = f"""WITH {SPLIT_CTE},
st AS (SELECT 'all' AS stage, binary_target FROM tsplit
       UNION ALL SELECT split AS stage, binary_target FROM tsplit),
grid AS (SELECT s.stage, c.binary_target, c.binary_label FROM (VALUES ('all'), ('train'), ('test')) s(stage),
         (VALUES (0, 'benign'), (1, 'attack')) c(binary_target, binary_label)),
cnt AS (SELECT stage, binary_target, count(*) AS n FROM st GROUP BY ALL),
j AS (SELECT g.stage, g.binary_target, g.binary_label, CAST(coalesce(c.n, 0) AS BIGINT) AS n
      FROM grid g LEFT JOIN cnt c USING (stage, binary_target))
SELECT stage, binary_target, binary_label, n,
       round(coalesce(n * 100.0 / nullif(sum(n) OVER (PARTITION BY stage), 0), 0), 6) AS pct
FROM j"""

ORACLE["device_summary"] = f"""WITH {TRAFFIC_CTE},
per AS (SELECT device_id, count(*) AS rows,
               count(*) FILTER (WHERE binary_target = 0) AS benign_rows,
               count(*) FILTER (WHERE binary_target = 1) AS attack_rows FROM traffic GROUP BY 1)
SELECT per.device_id, rows, benign_rows, attack_rows, n_name AS device_name,
       round(benign_rows * 100.0 / rows, 6) AS benign_pct, round(attack_rows * 100.0 / rows, 6) AS attack_pct
FROM per LEFT JOIN nation ON per.device_id = nation.n_nationkey + 1"""

ORACLE["label_consistency"] = f"""WITH {TRAFFIC_CTE},
chk AS (SELECT *, (CASE binary_label WHEN 'benign' THEN 0 WHEN 'attack' THEN 1 END)
                  IS DISTINCT FROM binary_target OR binary_target NOT IN (0, 1) AS bad FROM traffic)
SELECT device_id, count(*) AS n_rows, count(*) FILTER (WHERE bad) AS n_bad,
       count(DISTINCT binary_target) AS n_targets, min(binary_target) AS min_target,
       max(binary_target) AS max_target, count(*) FILTER (WHERE bad) = 0 AS consistent
FROM chk GROUP BY device_id"""

ORDERED_CTE = TRAFFIC_CTE + """,
osplit AS (SELECT *, CASE WHEN row_pos < floor(_n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM (
  SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY ts, row_key) - 1 AS row_pos,
         count(*) OVER (PARTITION BY source_file) AS _n FROM traffic))
"""

ORACLE["ordered_split"] = f"""WITH {ORDERED_CTE}
SELECT row_key, source_file, row_pos, split FROM osplit"""

ORACLE["split_summary"] = f"""WITH {ORDERED_CTE}
SELECT source_file, count(*) AS total_rows, count(*) FILTER (WHERE split = 'train') AS train_rows,
       count(*) FILTER (WHERE split = 'test') AS test_rows, min(binary_label) AS binary_label
FROM osplit GROUP BY source_file"""

ORACLE["stratified_split"] = f"""WITH {SPLIT_CTE}
SELECT row_key, binary_target, split FROM tsplit"""

ORACLE["library_split"] = f"""WITH {TRAFFIC_CTE},
c AS (SELECT binary_target, count(*) AS n FROM traffic GROUP BY 1),
t1 AS (SELECT *, CAST(sum(n) OVER () AS BIGINT) AS N_ FROM c),
t2 AS (SELECT *, CAST(ceil(N_ * 0.2::DOUBLE) AS BIGINT) AS n_test FROM t1),
t3 AS (SELECT *, (n * (N_ - n_test)) / N_ AS cont, N_ - n_test AS n_train FROM t2),
t4 AS (SELECT *, CAST(floor(cont) AS BIGINT) AS fl, cont - floor(cont) AS rem FROM t3),
t5 AS (SELECT *, n_train - sum(fl) OVER () AS short,
              row_number() OVER (ORDER BY rem DESC, binary_target) AS rk FROM t4),
quota AS (SELECT binary_target, n - (fl + CASE WHEN rk <= short THEN 1 ELSE 0 END) AS q FROM t5),
r AS (SELECT traffic.*, row_number() OVER (PARTITION BY binary_target
         ORDER BY {hash32_sql(SEED, 'split', 'row_key')}, row_key) AS _rn FROM traffic)
SELECT row_key, binary_target, CASE WHEN _rn <= quota.q THEN 'test' ELSE 'train' END AS split
FROM r JOIN quota USING (binary_target)"""

ORACLE["split_disjoint"] = f"""WITH {SPLIT_CTE},
per AS (SELECT row_key, count(*) FILTER (WHERE split = 'train') AS tr,
               count(*) FILTER (WHERE split = 'test') AS te FROM tsplit GROUP BY 1),
inp AS (SELECT row_key, count(*) AS _in FROM traffic GROUP BY 1),
j AS (SELECT * FROM per FULL OUTER JOIN inp USING (row_key))
SELECT CAST(coalesce(sum(tr), 0) AS BIGINT) AS train_rows, CAST(coalesce(sum(te), 0) AS BIGINT) AS test_rows,
       CAST(coalesce(sum(_in), 0) AS BIGINT) AS input_rows,
       count(*) FILTER (WHERE tr > 0 AND te > 0) AS overlap,
       count(*) FILTER (WHERE _in IS NOT NULL AND tr IS NULL) AS missing,
       count(*) FILTER (WHERE _in IS NULL) AS extra,
       count(*) FILTER (WHERE tr + te > 1) AS duplicated,
       count(*) FILTER (WHERE tr > 0 AND te > 0) = 0 AND count(*) FILTER (WHERE _in IS NOT NULL AND tr IS NULL) = 0
         AND count(*) FILTER (WHERE _in IS NULL) = 0 AND count(*) FILTER (WHERE tr + te > 1) = 0
         AND coalesce(sum(tr), 0) + coalesce(sum(te), 0) = coalesce(sum(_in), 0) AS ok
FROM j"""

ORACLE["scaler_params"] = f"""WITH {SPLIT_CTE},
params AS ({_feature_params_sql('standard')})
SELECT position, feature, round(center, 6) AS mean, round(scale, 6) AS std FROM params"""

ORACLE["scale_apply"] = f"""WITH {scaled_cte('standard')}
SELECT row_key, split, {', '.join(f'round({f}, 6) AS {f}' for f in FEATS)} FROM scaled"""

ORACLE["minmax"] = f"""WITH {scaled_cte('minmax')}
SELECT row_key, split, {', '.join(f'round({f}, 6) AS {f}' for f in FEATS)} FROM scaled"""


# ------------------------------------------------------------------ kNN family
def dist_sql(a: str, b: str, feats: list[str]) -> str:
    """Euclidean distance, squares summed left to right in feature order (as the kernel does)."""
    terms = [f"((CAST({a}.{f} AS DOUBLE) - CAST({b}.{f} AS DOUBLE)) * (CAST({a}.{f} AS DOUBLE) - CAST({b}.{f} AS DOUBLE)))"
             for f in feats]
    return "sqrt(" + " + ".join(terms) + ")"


def vote_sql(nn: str, group: str = "") -> str:
    """Distance-weighted vote over CTE ``nn(<group> qid, rid, label, dist)``; yields (<group> qid, predicted, score)."""
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {g}qid"
    return f"""
  v1 AS (SELECT {g}qid, label, sum(CASE WHEN dist > 0 THEN 1.0 / dist END) AS inv,
                count(*) FILTER (WHERE dist = 0) AS z FROM {nn} GROUP BY ALL),
  v2 AS (SELECT *, max(z) OVER ({part}) > 0 AS hz FROM v1),
  v3 AS (SELECT *, CASE WHEN hz THEN CAST(z AS DOUBLE) ELSE coalesce(inv, 0.0) END AS w FROM v2),
  v4 AS (SELECT *, sum(w) OVER ({part}) AS tot,
                sum(CASE WHEN label = 1 THEN w ELSE 0.0 END) OVER ({part}) AS w1,
                row_number() OVER ({part} ORDER BY w DESC, label) AS rk2 FROM v3),
  vote AS (SELECT {g}qid, label AS predicted, w1 / tot AS score FROM v4 WHERE rk2 = 1)"""


def metrics_cols_sql(digits: int | None = 6) -> str:
    """tn, fp, fn, tp and all ratios; rounded unless ``digits`` is None."""
    p = "coalesce(tp / nullif(tp + fp, 0), 0.0)"
    r = "coalesce(tp / nullif(tp + fn, 0), 0.0)"
    f1 = "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0)"
    p0 = "coalesce(tn / nullif(tn + fn, 0), 0.0)"
    r0 = "coalesce(tn / nullif(tn + fp, 0), 0.0)"
    f10 = "coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0.0)"
    named = {"accuracy": "coalesce((tp + tn) / nullif(tn + fp + fn + tp, 0), 0.0)", "precision": p, "recall": r, "f1": f1, "benign_precision": p0,
             "benign_recall": r0, "benign_f1": f10, "macro_precision": f"({p} + {p0}) / 2", "macro_recall": f"({r} + {r0}) / 2",
             "macro_f1": f"({f1} + {f10}) / 2", "false_positive_rate": "coalesce(fp / nullif(fp + tn, 0), 0.0)"}
    one = (lambda x: f"round({x}, {digits})") if digits is not None else (lambda x: x)
    return "tn, fp, fn, tp, " + ", ".join(f"{one(x)} AS {n}" for n, x in named.items())


def counts_sql(src: str, actual: str = "actual", predicted: str = "predicted", group: str = "") -> str:
    g = f"{group}, " if group else ""
    gb = f" GROUP BY {group}" if group else ""
    return (f"SELECT {g}count(*) FILTER (WHERE {actual} = 0 AND {predicted} = 0) AS tn, "
            f"count(*) FILTER (WHERE {actual} = 0 AND {predicted} = 1) AS fp, "
            f"count(*) FILTER (WHERE {actual} = 1 AND {predicted} = 0) AS fn, "
            f"count(*) FILTER (WHERE {actual} = 1 AND {predicted} = 1) AS tp FROM {src}{gb}")


def knn_pred_body(k: int = 5, sfx: str = "") -> str:
    """CTEs te, tr (once) + dd/nn/vote/pred with suffix: 5-NN (or k-NN) predictions of the test rows."""
    v = vote_sql('nn' + sfx).replace(" v1 ", f" v1{sfx} ").replace("FROM v1)", f"FROM v1{sfx})")
    v = v.replace(" v2 ", f" v2{sfx} ").replace("FROM v2)", f"FROM v2{sfx})")
    v = v.replace(" v3 ", f" v3{sfx} ").replace("FROM v3)", f"FROM v3{sfx})")
    v = v.replace(" v4 ", f" v4{sfx} ").replace("FROM v4 ", f"FROM v4{sfx} ").replace("vote AS", f"vote{sfx} AS")
    return f"""
  dd{sfx} AS (SELECT te.row_key AS qid, tr.row_key AS rid, tr.binary_target AS label, {dist_sql('te', 'tr', FEATS)} AS dist
         FROM te JOIN tr ON true),
  nn{sfx} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS rk FROM dd{sfx})
         WHERE rk <= {k}),
  {v},
  pred{sfx} AS (SELECT te.row_key, te.binary_target AS actual, vote{sfx}.predicted, vote{sfx}.score
           FROM te LEFT JOIN vote{sfx} ON te.row_key = vote{sfx}.qid)"""


KNN_PRED_CTE = scaled_cte("standard") + """,
  te AS (SELECT * FROM scaled WHERE split = 'test'),
  tr AS (SELECT * FROM scaled WHERE split = 'train'),""" + knn_pred_body(5) + "\n"

ORACLE["knn_classify"] = f"""WITH {KNN_PRED_CTE}
SELECT row_key, actual, predicted, round(score, 6) AS score FROM pred"""

ORACLE["confusion"] = f"""WITH {KNN_PRED_CTE},
  grid AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) g(actual, predicted)),
  cnt AS (SELECT actual, predicted, count(*) AS n FROM pred GROUP BY ALL)
SELECT g.actual, g.predicted, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
FROM grid g LEFT JOIN cnt USING (actual, predicted)"""

ORACLE["binary_metrics"] = f"""WITH {KNN_PRED_CTE},
  c AS ({counts_sql('pred')})
SELECT {metrics_cols_sql()}, tn + fp + fn + tp AS n_rows FROM c"""

ORACLE["auc"] = f"""WITH {KNN_PRED_CTE},
  per AS (SELECT score AS s, CAST(count(*) FILTER (WHERE actual = 1) AS DOUBLE) AS npos,
                 CAST(count(*) FILTER (WHERE actual = 0) AS DOUBLE) AS nneg FROM pred GROUP BY 1),
  c AS (SELECT *, coalesce(sum(npos) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bp,
               coalesce(sum(nneg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bn FROM per),
  t AS (SELECT sum(npos) AS P, sum(nneg) AS N FROM per)
SELECT CAST(P AS BIGINT) AS positives, CAST(N AS BIGINT) AS negatives, count(*) AS distinct_scores,
       round(sum(npos * (bn + 0.5 * nneg)) / (P * N), 6) AS roc_auc,
       round(sum(npos * (P - bp) / ((P - bp) + (N - bn))) / P, 6) AS pr_auc
FROM c JOIN t ON true GROUP BY P, N"""


def fold_knn_cte(folds_sql: str, train_cond: str, test_cond: str, base: str = "traffic") -> str:
    """Per fold: train-only scaler, 5-NN of test rows against train rows, vote -> fpred(fold, row_key, actual, predicted)."""
    agg = []
    for i, f in enumerate(FEATS):
        x = f"CAST(t.{f} AS DOUBLE)"
        agg.append(f"avg({x}) AS m{i}, CASE WHEN coalesce(stddev_pop({x}), 0) = 0 THEN 1.0 ELSE stddev_pop({x}) END AS s{i}")
    zcols = ", ".join(f"(CAST(t.{f} AS DOUBLE) - p.m{i}) / p.s{i} AS {f}" for i, f in enumerate(FEATS))
    return f"""
  folds AS ({folds_sql}),
  fparams AS (SELECT f.fold, {', '.join(agg)} FROM folds f JOIN {base} t ON {train_cond} GROUP BY f.fold),
  fz AS (SELECT p.fold, t.row_key, t.binary_target, ({test_cond}) AS is_test, ({train_cond}) AS is_train, {zcols}
         FROM fparams p JOIN {base} t ON true JOIN folds f ON f.fold = p.fold),
  fdd AS (SELECT q.fold, q.row_key AS qid, r.row_key AS rid, r.binary_target AS label, {dist_sql('q', 'r', FEATS)} AS dist
          FROM fz q JOIN fz r ON q.fold = r.fold AND q.is_test AND r.is_train),
  fnn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold, qid ORDER BY dist, rid) AS rk FROM fdd) WHERE rk <= 5),
  {vote_sql('fnn', 'fold')},
  fpred AS (SELECT q.fold, q.row_key, q.binary_target AS actual, vote.predicted
            FROM fz q LEFT JOIN vote ON vote.fold = q.fold AND vote.qid = q.row_key WHERE q.is_test),
  ftrain AS (SELECT fold, count(*) FILTER (WHERE is_train) AS train_rows FROM fz GROUP BY fold)
"""


LODO_CTE = TRAFFIC_CTE + "," + fold_knn_cte("SELECT DISTINCT device_id AS fold FROM traffic",
                                             "t.device_id IS DISTINCT FROM f.fold", "t.device_id IS NOT DISTINCT FROM f.fold")

ORACLE["lodo_knn"] = f"""WITH {LODO_CTE},
  c AS ({counts_sql('fpred', group='fold')})
SELECT CAST(c.fold AS INTEGER) AS device_id, {metrics_cols_sql()}, ftrain.train_rows
FROM c JOIN ftrain USING (fold)"""

ORACLE["lodo_pooled"] = f"""WITH {LODO_CTE},
  c AS ({counts_sql('fpred', group='fold')}),
  m AS (SELECT *, coalesce((tp + tn) / nullif(tn + fp + fn + tp, 0), 0.0) AS acc,
               coalesce(tp / nullif(tp + fn, 0), 0.0) AS rec, coalesce(tn / nullif(tn + fp, 0), 0.0) AS rec0,
               (coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) + coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0.0))
                 / 2 AS mf1 FROM c),
  pooled AS (SELECT CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
                    CAST(sum(tp) AS BIGINT) AS tp, round(avg(acc), 6) AS mean_fold_accuracy,
                    round(avg(rec), 6) AS mean_fold_recall, round(avg(rec0), 6) AS mean_fold_benign_recall,
                    round(avg(mf1), 6) AS mean_fold_macro_f1, count(*) AS n_folds FROM m)
SELECT {metrics_cols_sql()}, mean_fold_accuracy, mean_fold_recall, mean_fold_benign_recall, mean_fold_macro_f1, n_folds
FROM pooled"""

ORACLE["hardest_devices"] = f"""WITH {LODO_CTE},
  c AS ({counts_sql('fpred', group='fold')}),
  m AS (SELECT CAST(fold AS INTEGER) AS device_id, {metrics_cols_sql(None)} FROM c),
  a AS (SELECT 'attack_recall' AS criterion, CAST(row_number() OVER (ORDER BY recall, fn DESC, device_id) AS INTEGER) AS rank,
               device_id, round(recall, 6) AS recall_value, fn AS errors FROM m),
  b AS (SELECT 'benign_recall' AS criterion, CAST(row_number() OVER (ORDER BY benign_recall, fp DESC, device_id) AS INTEGER) AS rank,
               device_id, round(benign_recall, 6) AS recall_value, fp AS errors FROM m)
SELECT * FROM a WHERE rank <= 3 UNION ALL SELECT * FROM b WHERE rank <= 3"""

ORACLE["transfer_knn"] = f"""WITH {ORDERED_CTE},""" + fold_knn_cte(
    "SELECT 1 AS fold", "t.device_id = 1 AND t.split = 'train'", "t.device_id = 2", base="osplit") + f""",
  c AS ({counts_sql('fpred')})
SELECT {metrics_cols_sql()} FROM c"""

ORACLE["family_holdout"] = f"WITH {TRAFFIC_CTE}," + fold_knn_cte(
    "SELECT DISTINCT family AS fold FROM traffic WHERE binary_target = 1",
    "t.family IS DISTINCT FROM f.fold", "t.family IS NOT DISTINCT FROM f.fold") + f""",
  c AS ({counts_sql('fpred', group='fold')})
SELECT fold AS held_out_family, {metrics_cols_sql()} FROM c"""

SMOTE_CTE = f"""{scaled_cte('standard')},
  tr AS (SELECT * FROM scaled WHERE split = 'train'),
  cnt AS (SELECT binary_target, count(*) AS n FROM tr GROUP BY 1),
  mx AS (SELECT max(n) AS n_max FROM cnt),
  mc AS (SELECT c.binary_target AS cls, c.n AS n_c, mx.n_max - c.n AS need FROM cnt c JOIN mx ON c.n < mx.n_max),
  mino AS (SELECT tr.*, row_number() OVER (ORDER BY row_key) - 1 AS pos FROM tr JOIN mc ON tr.binary_target = mc.cls),
  md AS (SELECT a.row_key AS qid, b.row_key AS rid, {dist_sql('a', 'b', FEATS)} AS dist
         FROM mino a JOIN mino b ON a.row_key <> b.row_key),
  mnn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS rk FROM md) WHERE rk <= 5),
  syn0 AS (SELECT unnest(range(need)) AS j, n_c, cls FROM mc),
  syn AS (SELECT j, cls, CAST(floor({uniform52_sql(SEED, "smote:' || cls || ':base", 'j')} * n_c * 5) AS BIGINT) AS r,
                 {uniform52_sql(SEED, "smote:' || cls || ':step", 'j')} AS step FROM syn0),
  syn2 AS (SELECT j, cls, step, r // 5 AS pos, r % 5 + 1 AS nn_rank FROM syn),
  made AS (SELECT s.j AS syn_id, s.cls, s.step, b.row_key AS base_key, mnn.rid AS nn_key,
                  {', '.join(f'b.{f} + s.step * (o.{f} - b.{f}) AS {f}' for f in FEATS)}
           FROM syn2 s JOIN mino b ON b.pos = s.pos JOIN mnn ON mnn.qid = b.row_key AND mnn.rk = s.nn_rank
           JOIN mino o ON o.row_key = mnn.rid)
"""

ORACLE["smote"] = f"""WITH {SMOTE_CTE}
SELECT syn_id, cls AS binary_target, base_key, nn_key, round(step, 6) AS step,
       {', '.join(f'round({f}, 6) AS {f}' for f in FEATS)}
FROM made"""


# ------------------------------------------------------------------ embeddings (64 dims)
EFEATS = [f"e{i}" for i in range(64)]
EMB_CTE = f"emb AS ({embeddings_as_rows_sql()})"

ORACLE["knn_join"] = f"""WITH {EMB_CTE},
  d AS (SELECT a.row_key AS qid, b.row_key AS rid, {dist_sql('a', 'b', EFEATS)} AS dist
        FROM emb a JOIN emb b ON a.row_key <> b.row_key),
  nn AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS INTEGER) AS nn_rank FROM d)
SELECT qid, rid, nn_rank, round(dist, 6) AS dist FROM nn WHERE nn_rank <= 5"""

ORACLE["lof"] = f"""WITH {EMB_CTE},
  d AS (SELECT a.row_key AS qid, b.row_key AS rid, {dist_sql('a', 'b', EFEATS)} AS dist
        FROM emb a JOIN emb b ON a.row_key <> b.row_key),
  nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS rk FROM d) WHERE rk <= 5),
  kd AS (SELECT qid, max(dist) AS k_distance FROM nn GROUP BY 1),
  reach AS (SELECT nn.qid, greatest(kd.k_distance, nn.dist) AS r FROM nn JOIN kd ON nn.rid = kd.qid),
  lrd AS (SELECT qid, CASE WHEN avg(r) > 0 THEN 1.0 / avg(r) ELSE 'inf'::DOUBLE END AS lrd FROM reach GROUP BY 1),
  lo AS (SELECT nn.qid, avg(l.lrd) AS mo FROM nn JOIN lrd l ON nn.rid = l.qid GROUP BY 1)
SELECT qid AS row_key, round(k_distance, 6) AS k_distance, round(lrd, 6) AS lrd, round(CASE WHEN isinf(mo) AND isinf(lrd) THEN 1.0 WHEN isinf(lrd) THEN 0.0 ELSE mo / lrd END, 6) AS lof
FROM lrd JOIN lo USING (qid) JOIN kd USING (qid)"""


def _emb_params_sql() -> str:
    parts = []
    for i, f in enumerate(EFEATS):
        x = f"CAST({f} AS DOUBLE)"
        parts.append(f"avg({x}) AS m{i}, CASE WHEN coalesce(stddev_pop({x}), 0) = 0 THEN 1.0 ELSE stddev_pop({x}) END AS s{i}")
    return ", ".join(parts)


ORACLE["classification_report"] = f"""WITH {EMB_CTE},
  eq AS (SELECT class_label, CAST(round_even(count(*) * 0.2::DOUBLE, 0) AS BIGINT) AS q FROM emb GROUP BY 1),
  er AS (SELECT emb.*, row_number() OVER (PARTITION BY class_label
            ORDER BY {hash32_sql(SEED, 'split', 'row_key')}, row_key) AS _rn FROM emb),
  es AS (SELECT er.*, CASE WHEN _rn <= eq.q THEN 'test' ELSE 'train' END AS split FROM er JOIN eq USING (class_label)),
  ep AS (SELECT {_emb_params_sql()} FROM es WHERE split = 'train'),
  ez AS (SELECT es.row_key, es.class_label, es.split,
                {', '.join(f'(CAST(es.{f} AS DOUBLE) - ep.m{i}) / ep.s{i} AS {f}' for i, f in enumerate(EFEATS))}
         FROM es JOIN ep ON true),
  te AS (SELECT * FROM ez WHERE split = 'test'), tr AS (SELECT * FROM ez WHERE split = 'train'),
  dd AS (SELECT te.row_key AS qid, tr.row_key AS rid, tr.class_label AS label, {dist_sql('te', 'tr', EFEATS)} AS dist
         FROM te JOIN tr ON true),
  nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS rk FROM dd) WHERE rk <= 5),
  {vote_sql('nn')},
  pred AS (SELECT te.class_label AS a, vote.predicted AS p FROM te LEFT JOIN vote ON te.row_key = vote.qid),
  cells AS (SELECT a, p, count(*) AS n FROM pred GROUP BY ALL),
  sup AS (SELECT a AS label, sum(n) AS support FROM cells GROUP BY 1),
  prd AS (SELECT p AS label, sum(n) AS predicted_n FROM cells GROUP BY 1),
  hit AS (SELECT a AS label, n AS tp FROM cells WHERE a = p),
  per AS (SELECT label, coalesce(support, 0) AS support, coalesce(predicted_n, 0) AS predicted_n, coalesce(tp, 0) AS tp
          FROM sup FULL OUTER JOIN prd USING (label) LEFT JOIN hit USING (label)),
  per2 AS (SELECT *, coalesce(tp / nullif(predicted_n, 0), 0.0) AS precision,
                  coalesce(tp / nullif(support, 0), 0.0) AS recall FROM per),
  per3 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM per2)
SELECT CAST(label AS VARCHAR) AS class, round(precision, 6) AS precision,
       round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM per3
UNION ALL SELECT 'accuracy', NULL, NULL, round(coalesce(sum(tp) / nullif(sum(support), 0), 0.0), 6),
       CAST(sum(support) AS BIGINT) FROM per3
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
       CAST(sum(support) AS BIGINT) FROM per3
UNION ALL SELECT 'weighted avg', round(coalesce(sum(precision * support) / nullif(sum(support), 0), 0.0), 6),
       round(coalesce(sum(recall * support) / nullif(sum(support), 0), 0.0), 6),
       round(coalesce(sum(f1 * support) / nullif(sum(support), 0), 0.0), 6), CAST(sum(support) AS BIGINT) FROM per3"""

ORACLE["smote_balanced"] = f"""WITH {SMOTE_CTE}
SELECT binary_target, false AS is_synthetic, count(*) AS n FROM tr GROUP BY 1
UNION ALL SELECT cls AS binary_target, true AS is_synthetic, count(*) AS n FROM made GROUP BY 1"""


# ------------------------------------------------------------------ run records
RUN_METRICS = ["n_orders", "total_price", "mean_price", "max_price", "open_share"]
RUNS_CTE = """
  runs AS (SELECT o_orderpriority AS experiment, strftime(o_orderdate, '%Y-%m') AS run_id, count(*) AS n_orders,
                  sum(o_totalprice) AS total_price, avg(o_totalprice) AS mean_price, max(o_totalprice) AS max_price,
                  count(*) FILTER (WHERE o_orderstatus = 'O') / count(*) AS open_share
           FROM orders GROUP BY 1, 2),
  rl AS (""" + " UNION ALL ".join(
    f"SELECT experiment, run_id, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM runs" for m in RUN_METRICS) + """),
  summ AS (SELECT experiment, metric, count(*) AS runs, avg(value) AS mean, min(value) AS min,
                  max(value) AS max, coalesce(stddev_pop(value), 0.0) AS std FROM rl GROUP BY ALL)
"""

ORACLE["run_summary_pop"] = f"""WITH {RUNS_CTE}
SELECT experiment, metric, runs, round(mean, 6) AS mean, round(min, 6) AS min, round(max, 6) AS max, round(std, 6) AS std FROM summ"""

ORACLE["run_summary_sample"] = f"""WITH {RUNS_CTE}
SELECT experiment, substr(run_id, 1, 4) AS year, metric, count(value) AS n,
       round(CASE WHEN count(value) = 1 THEN max(value) WHEN count(value) > 1 THEN avg(value) END, 6) AS reported_value,
       CASE WHEN count(value) = 0 THEN 'not_measured_or_not_applicable'
            WHEN count(value) = 1 THEN 'single_measured_run' ELSE 'arithmetic_mean' END AS reported_value_kind,
       round(CASE WHEN count(value) > 1 THEN avg(value) END, 6) AS mean,
       round(CASE WHEN count(value) > 1 THEN stddev_samp(value) END, 6) AS standard_deviation,
       round(min(value), 6) AS minimum, round(max(value), 6) AS maximum,
       string_agg(CASE WHEN metric = 'n_orders' THEN CAST(CAST(value AS BIGINT) AS VARCHAR) END, ';' ORDER BY run_id) AS run_values,
       CAST(count(value) AS INTEGER) AS n_values
FROM rl GROUP BY ALL"""

ORACLE["change_table"] = f"""WITH {RUNS_CTE},
  b AS (SELECT metric, mean AS reference_value FROM summ WHERE experiment = '1-URGENT'),
  c AS (SELECT experiment, metric, mean AS comparison_value FROM summ WHERE experiment <> '1-URGENT'),
  j AS (SELECT c.*, b.reference_value, comparison_value - reference_value AS d,
               CASE WHEN reference_value <> 0 THEN (comparison_value - reference_value) / reference_value * 100.0 END AS sg
        FROM c JOIN b USING (metric))
SELECT experiment, metric, round(comparison_value, 6) AS comparison_value, round(reference_value, 6) AS reference_value, round(d, 6) AS absolute_change,
       round(sg, 6) AS signed_percent_change,
       CASE WHEN d < 0 THEN 'reduction' WHEN d > 0 THEN 'increase' ELSE 'no_change' END AS direction,
       round(CASE WHEN d < 0 THEN -sg WHEN d = 0 THEN 0.0 END, 6) AS reduction_percent,
       round(CASE WHEN d > 0 THEN sg WHEN d = 0 THEN 0.0 END, 6) AS increase_percent,
       round(d, 6) AS absolute_metric_difference, round(d * 100.0, 4) AS percentage_point_difference,
       CASE WHEN d > 0 THEN 'increase' WHEN d < 0 THEN 'decrease' ELSE 'no_change' END AS metric_direction,
       round(CASE WHEN reference_value <> 0 THEN (reference_value - comparison_value) / reference_value * 100.0
                  ELSE 0.0 END, 6) AS reduction_pct,
       round(reference_value / nullif(comparison_value, 0), 6) AS ratio,
       CASE WHEN reference_value / nullif(comparison_value, 0) > 1 THEN 'speedup'
            WHEN reference_value / nullif(comparison_value, 0) < 1 THEN 'slowdown' ELSE 'same' END AS speed_direction
FROM j"""

ORACLE["run_vs_prior"] = f"""WITH {RUNS_CTE},
  r AS (SELECT *, CAST(substr(run_id, 1, 4) AS INTEGER) AS year, CAST(substr(run_id, 6, 2) AS INTEGER) AS month FROM runs),
  cur AS (SELECT * FROM r WHERE year = (SELECT max(year) FROM r)),
  pri AS (SELECT * FROM r WHERE year = (SELECT max(year) FROM r) - 1)
SELECT cur.experiment, cur.month, cur.n_orders, CAST(pri.n_orders AS DOUBLE) AS prior_n_orders,
       round(cur.total_price, 6) AS total_price, round(pri.total_price, 6) AS prior_total_price,
       round(CASE WHEN CAST(pri.n_orders AS DOUBLE) <> 0
                  THEN (CAST(cur.n_orders AS DOUBLE) - CAST(pri.n_orders AS DOUBLE)) / CAST(pri.n_orders AS DOUBLE) * 100.0 END, 6)
         AS signed_percent_change,
       CASE WHEN CAST(cur.n_orders AS DOUBLE) - CAST(pri.n_orders AS DOUBLE) < 0 THEN 'reduction'
            WHEN CAST(cur.n_orders AS DOUBLE) - CAST(pri.n_orders AS DOUBLE) > 0 THEN 'increase'
            ELSE 'no_change' END AS direction
FROM cur LEFT JOIN pri ON cur.experiment = pri.experiment AND cur.month = pri.month"""

ORACLE["runtime_table"] = f"""WITH {RUNS_CTE}
SELECT experiment, {', '.join(f"round(max(CASE WHEN metric = '{m}' THEN mean END), 6) AS {m}" for m in RUN_METRICS)}
FROM summ GROUP BY experiment"""

ORACLE["summary_table"] = f"""WITH {RUNS_CTE}
SELECT experiment, {', '.join(f"round(max(CASE WHEN metric = '{m}' THEN {a} END), 6) AS {m}_{n}" for m in RUN_METRICS
                              for a, n in (('mean', 'value'), ('std', 'std'), ('min', 'min'), ('max', 'max')))},
       CAST(max(runs) AS BIGINT) AS runs
FROM summ GROUP BY experiment"""

ORACLE["golden_match"] = "WITH " + scaled_cte("standard") + """,
  te AS (SELECT * FROM scaled WHERE split = 'test'),
  tr AS (SELECT * FROM scaled WHERE split = 'train'),""" + knn_pred_body(5) + "," + knn_pred_body(3, "_g") + """,
  grid AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) g(actual, predicted)),
  c5 AS (SELECT g.actual, g.predicted, (SELECT count(*) FROM pred p WHERE p.actual = g.actual AND p.predicted = g.predicted) AS run_n FROM grid g),
  c3 AS (SELECT g.actual, g.predicted, (SELECT count(*) FROM pred_g p WHERE p.actual = g.actual AND p.predicted = g.predicted) AS golden_n FROM grid g),
  j AS (SELECT actual, predicted, run_n, golden_n, run_n IS NOT DISTINCT FROM golden_n AS match
        FROM c5 FULL OUTER JOIN c3 USING (actual, predicted))
SELECT *, bool_and(match) OVER () AS all_match FROM j"""

ORACLE["snapshot_diff"] = f"""WITH {SPLIT_CTE}, {ORDERED_CTE[len(TRAFFIC_CTE) + 1:]},
  b AS (SELECT row_key, source_file, binary_label AS label FROM tsplit WHERE split = 'train'),
  a AS (SELECT row_key, source_file, multiclass_label AS label FROM osplit WHERE split = 'train')
SELECT coalesce(b.row_key, a.row_key) AS row_key,
       CASE WHEN b.row_key IS NULL THEN 'created' WHEN a.row_key IS NULL THEN 'removed' ELSE 'changed' END AS status,
       b.source_file AS before_source_file, b.label AS before_label, a.source_file AS after_source_file, a.label AS after_label
FROM b FULL OUTER JOIN a ON a.row_key = b.row_key
WHERE b.row_key IS NULL OR a.row_key IS NULL OR b.label IS DISTINCT FROM a.label OR b.source_file IS DISTINCT FROM a.source_file"""

FP_SQL = hash32_sql(0, "fp", "row_key", "binary_target")

ORACLE["fingerprint"] = f"""WITH {KNN_PRED_CTE}
SELECT 'split_test' AS stage, count(*) AS rows, CAST(sum({FP_SQL}) AS BIGINT) AS hash_sum, bit_xor({FP_SQL}) AS hash_xor
FROM te
UNION ALL
SELECT 'predicted', count(*), CAST(sum({FP_SQL}) AS BIGINT), bit_xor({FP_SQL})
FROM (SELECT pred.row_key, pred.actual AS binary_target FROM pred)"""

ORACLE["experiment_table"] = f"""WITH {LODO_CTE},
  c AS ({counts_sql('fpred', group='fold')}),
  m AS (SELECT fold, tn + fp + fn + tp AS test_rows, {metrics_cols_sql()} FROM c)
SELECT CAST(m.fold AS INTEGER) AS device_id, nation.n_name AS device_name, ftrain.train_rows, test_rows, tn, fp, fn, tp,
       accuracy, precision, recall, f1, macro_f1
FROM m JOIN ftrain USING (fold) LEFT JOIN nation ON m.fold = nation.n_nationkey + 1"""

SMOTE_TAIL = SMOTE_CTE[SMOTE_CTE.index("  cnt AS"):]

ORACLE["run_checks"] = f"""WITH {KNN_PRED_CTE},
{SMOTE_TAIL},
  bal AS (SELECT binary_target, count(*) AS n FROM (SELECT binary_target FROM tr UNION ALL
                                                    SELECT cls AS binary_target FROM made) GROUP BY 1),
  c AS ({counts_sql('pred')}),
  fa AS (SELECT count(*) AS r, sum({FP_SQL}) AS s, bit_xor({FP_SQL}) AS x FROM te),
  fb AS (SELECT count(*) AS r, sum({FP_SQL}) AS s, bit_xor({FP_SQL}) AS x
         FROM (SELECT row_key, actual AS binary_target FROM pred)),
  hits AS (SELECT count(*) FILTER (WHERE predicted = 1) AS np, count(*) FILTER (WHERE actual = 1) AS na,
                  count(*) FILTER (WHERE actual = 1 AND predicted = 1) AS nb, avg(CAST(actual = predicted AS DOUBLE)) AS acc FROM pred),
  pr AS (SELECT acc, coalesce(nb / nullif(np, 0), 0.0) AS p, coalesce(nb / nullif(na, 0), 0.0) AS r FROM hits),
  rep AS (SELECT acc, p, r, coalesce(2 * p * r / nullif(p + r, 0), 0.0) AS f FROM pr)
SELECT 'split_rows_agree' AS check, (SELECT count(*) FROM traffic) = (SELECT count(*) FROM tsplit) AS passed
UNION ALL SELECT 'confusion_covers_test_rows', (SELECT tn + fp + fn + tp FROM c) = (SELECT count(*) FROM te)
UNION ALL SELECT 'benign_support_agrees', (SELECT tn + fp FROM c) = (SELECT count(*) FROM te WHERE binary_target = 0)
UNION ALL SELECT 'attack_support_agrees', (SELECT fn + tp FROM c) = (SELECT count(*) FROM te WHERE binary_target = 1)
UNION ALL SELECT 'test_labels_unchanged', (SELECT r FROM fa) = (SELECT r FROM fb) AND (SELECT s FROM fa) = (SELECT s FROM fb)
          AND (SELECT x FROM fa) = (SELECT x FROM fb)
UNION ALL SELECT 'every_test_row_predicted', (SELECT count(*) FROM pred WHERE predicted IS NULL) = 0
UNION ALL SELECT 'predictions_binary', (SELECT count(*) FROM pred WHERE predicted NOT IN (0, 1)) = 0
UNION ALL SELECT 'classes_balanced_after_smote', (SELECT min(n) = max(n) FROM bal)
UNION ALL SELECT 'accuracy_follows_from_counts', abs(acc - (SELECT (tp + tn) / (tn + fp + fn + tp) FROM c)) <= 1e-12 FROM rep
UNION ALL SELECT 'precision_follows_from_counts', abs(p - (SELECT coalesce(tp / nullif(tp + fp, 0), 0.0) FROM c)) <= 1e-12 FROM rep
UNION ALL SELECT 'recall_follows_from_counts', abs(r - (SELECT coalesce(tp / nullif(tp + fn, 0), 0.0) FROM c)) <= 1e-12 FROM rep
UNION ALL SELECT 'f1_follows_from_counts', abs(f - (SELECT coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) FROM c)) <= 1e-12 FROM rep"""

# ------------------------------------------------------------------ quality / EDA
ORACLE["eda_counts"] = f"""WITH {TRAFFIC_CTE}
SELECT CASE WHEN GROUPING(device_id) = 1 THEN 'ALL' ELSE CAST(device_id AS VARCHAR) END AS device_id,
       CASE WHEN GROUPING(binary_label) = 1 THEN 'ALL' ELSE binary_label END AS binary_label,
       GROUPING_ID(device_id, binary_label) AS level, count(*) AS n
FROM traffic GROUP BY GROUPING SETS ((), (device_id), (binary_label), (device_id, binary_label))"""

ORACLE["eda_features"] = f"WITH {TRAFFIC_CTE}\n" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, count({f}) AS n, count(*) FILTER (WHERE {f} IS NULL) AS n_null, "
    f"round(avg(CAST({f} AS DOUBLE)), 6) AS mean, round(stddev_samp(CAST({f} AS DOUBLE)), 6) AS std, "
    f"round(min(CAST({f} AS DOUBLE)), 6) AS min, round(max(CAST({f} AS DOUBLE)), 6) AS max FROM traffic" for f in FEATS)

ORACLE["quality"] = f"WITH {TRAFFIC_CTE}\n" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, count(*) FILTER (WHERE {f} IS NULL) AS n_null, "
    f"count(*) FILTER (WHERE isnan(CAST({f} AS DOUBLE))) AS n_nan, "
    f"count(*) FILTER (WHERE isinf(CAST({f} AS DOUBLE))) AS n_inf FROM traffic" for f in FEATS)

ORACLE["duplicates"] = """WITH g AS (SELECT lineitem.*, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_rows, count(*) FILTER (WHERE n > 1) AS duplicate_groups,
       CAST(coalesce(sum(n - 1) FILTER (WHERE n > 1), 0) AS BIGINT) AS surplus_rows FROM g"""

ORACLE["regex_timing"] = r"""SELECT doc_id,
       TRY_CAST(nullif(regexp_extract(text, 'Version ([0-9]+(\.[0-9]+)?)', 1), '') AS DOUBLE) AS license_version,
       TRY_CAST(nullif(regexp_extract(text, '([0-9]+(\.[0-9]+)?)', 1), '') AS DOUBLE) AS first_number,
       CAST(len(regexp_extract_all(text, '[0-9]+')) AS BIGINT) AS n_numbers
FROM documents"""

ORACLE["row_expectation"] = f"""WITH {ORDERED_CTE},
  e AS (SELECT source_file, count(*) AS expected_rows FROM traffic GROUP BY 1),
  o AS (SELECT source_file, count(*) AS total_rows, count(*) FILTER (WHERE split = 'train') AS train_rows
        FROM osplit GROUP BY 1)
SELECT coalesce(e.source_file, o.source_file) AS source_file, expected_rows, total_rows AS observed_rows,
       CAST(floor(expected_rows * 0.8::DOUBLE) AS BIGINT) AS expected_train, train_rows AS observed_train,
       expected_rows = total_rows AND CAST(floor(expected_rows * 0.8::DOUBLE) AS BIGINT) = train_rows AS ok
FROM e FULL OUTER JOIN o ON e.source_file = o.source_file"""


def _stats_cols(src_feats: list[str]) -> str:
    cols = []
    for i, f in enumerate(src_feats):
        x = f"CAST({f} AS DOUBLE)"
        for c in (0, 1):
            cols.append(f"coalesce(sum({x}) FILTER (WHERE binary_target = {c}), 0.0) AS s{c}_{i}, "
                        f"coalesce(sum({x} * {x}) FILTER (WHERE binary_target = {c}), 0.0) AS q{c}_{i}")
    return ", ".join(cols)


def _importance_sql() -> str:
    n = "(CAST(n0 AS DOUBLE) + CAST(n1 AS DOUBLE))"
    s = "(s0 + s1)"
    q = "(q0 + q1)"
    mean = f"({s} / {n})"
    t0 = f"(CASE WHEN n0 > 0 THEN n0 * (s0 / n0 - {mean}) * (s0 / n0 - {mean}) ELSE 0.0 END)"
    t1 = f"(CASE WHEN n1 > 0 THEN n1 * (s1 / n1 - {mean}) * (s1 / n1 - {mean}) ELSE 0.0 END)"
    var_n = f"({q} - {s} * {s} / {n})"
    return f"CASE WHEN {var_n} > 0 THEN ({t0} + {t1}) / {var_n} ELSE 0.0 END"


def _long_stats(src: str, group: str = "") -> str:
    g = f"{group}, " if group else ""
    return " UNION ALL ".join(
        f"SELECT {g}'{f}' AS feature, {i} AS source_column_index, n0, n1, s0_{i} AS s0, s1_{i} AS s1, "
        f"q0_{i} AS q0, q1_{i} AS q1 FROM {src}" for i, f in enumerate(FEATS))


RANK_PART = f"""
  cs AS (SELECT count(*) FILTER (WHERE binary_target = 0) AS n0, count(*) FILTER (WHERE binary_target = 1) AS n1,
                {_stats_cols(FEATS)} FROM tsplit WHERE split = 'train'),
  ls AS ({_long_stats('cs')}),
  imp AS (SELECT feature, source_column_index, {_importance_sql()} AS importance FROM ls),
  ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY importance DESC, source_column_index) AS INTEGER) AS rank FROM imp)
"""
RANK_CTE = SPLIT_CTE + "," + RANK_PART

ORACLE["feature_rank"] = f"""WITH {RANK_CTE}
SELECT rank, feature, round(importance, 6) AS importance, source_column_index, rank <= 2 AS selected FROM ranked"""

ORACLE["feature_sets"] = f"""WITH {RANK_CTE},
  sel AS (SELECT * FROM ranked WHERE rank <= 2),
  lists AS (SELECT list(feature ORDER BY rank) AS by_rank, list(feature ORDER BY source_column_index) AS by_pos FROM sel)
SELECT feature, rank, source_column_index,
       CAST(row_number() OVER (ORDER BY source_column_index) - 1 AS INTEGER) AS model_position,
       list_sort(by_rank) = list_sort(by_pos) AS same_set, by_rank = by_pos AS same_order
FROM sel JOIN lists ON true"""

ORACLE["select_top"] = f"""WITH {RANK_CTE},
  trn AS (SELECT * FROM tsplit WHERE split = 'train'),
  lng AS ({' UNION ALL '.join(f"SELECT row_key, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM trn" for f in FEATS)})
SELECT row_key, feature, round(value, 6) AS value FROM lng WHERE feature IN (SELECT feature FROM ranked WHERE rank <= 2)"""

ORACLE["fold_stats"] = f"""WITH {LODO_CTE},
  c AS ({counts_sql('fpred', group='fold')}),
  m AS (SELECT fold, {metrics_cols_sql(None)} FROM c),
  lng AS ({' UNION ALL '.join(f"SELECT fold, '{x}' AS metric, CAST({x} AS DOUBLE) AS value FROM m"
                             for x in ['accuracy', 'precision', 'recall', 'f1', 'benign_recall', 'macro_f1'])})
SELECT metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min,
       round(max(value), 6) AS max FROM lng GROUP BY metric"""

FOLD_RANK_CTE = TRAFFIC_CTE + f""",
  pg AS (SELECT device_id AS fold, count(*) FILTER (WHERE binary_target = 0) AS n0,
                count(*) FILTER (WHERE binary_target = 1) AS n1, {_stats_cols(FEATS)} FROM traffic GROUP BY device_id),
  lpg AS ({_long_stats('pg', 'fold')}),
  tot AS (SELECT feature, source_column_index, sum(n0) AS tn0, sum(n1) AS tn1, sum(s0) AS ts0, sum(s1) AS ts1,
                 sum(q0) AS tq0, sum(q1) AS tq1 FROM lpg GROUP BY ALL),
  rest AS (SELECT lpg.fold, feature, source_column_index, tn0 - n0 AS n0, tn1 - n1 AS n1, ts0 - s0 AS s0,
                  ts1 - s1 AS s1, tq0 - q0 AS q0, tq1 - q1 AS q1 FROM lpg JOIN tot USING (feature, source_column_index)),
  fimp AS (SELECT fold, feature, source_column_index, {_importance_sql()} AS importance FROM rest),
  fr AS (SELECT *, CAST(row_number() OVER (PARTITION BY fold ORDER BY importance DESC, source_column_index) AS INTEGER)
                   AS rank FROM fimp)
"""

ORACLE["feature_stability"] = f"""WITH {FOLD_RANK_CTE}
SELECT feature, count(DISTINCT fold) AS folds_selected, round(avg(rank), 6) AS mean_rank, min(rank) AS best_rank,
       max(rank) AS worst_rank FROM fr WHERE rank <= 2 GROUP BY feature"""

ORACLE["rank_pivot"] = f"""WITH {FOLD_RANK_CTE},
  top AS (SELECT rank, fold, feature FROM fr WHERE rank <= 2)
SELECT rank, """ + ", ".join(f'max(feature) FILTER (WHERE fold = {k}) AS "{k}"' for k in range(1, 10)) + " FROM top GROUP BY rank"

ORACLE["union_sources"] = f"""WITH {SPLIT_CTE},
  u AS (SELECT * FROM tsplit WHERE split = 'train' UNION ALL BY NAME SELECT * FROM tsplit WHERE split = 'test'),
  a AS (SELECT source_file, count(*) AS union_rows FROM u GROUP BY 1),
  b AS (SELECT source_file, count(*) AS input_rows FROM traffic GROUP BY 1)
SELECT coalesce(a.source_file, b.source_file) AS source_file, union_rows, input_rows, union_rows = input_rows AS equal
FROM a FULL OUTER JOIN b ON a.source_file = b.source_file"""

ORACLE["nonfinite_null"] = """SELECT l_orderkey, l_linenumber,
       round(CASE WHEN isnan(pow(l_discount, -1.0)) OR isinf(pow(l_discount, -1.0)) THEN NULL
                  ELSE pow(l_discount, -1.0) END, 6) AS inv_discount,
       round(CASE WHEN isnan(sqrt(l_tax - 0.04::DOUBLE)) OR isinf(sqrt(l_tax - 0.04::DOUBLE)) THEN NULL
                  ELSE sqrt(l_tax - 0.04::DOUBLE) END, 6) AS sqrt_tax
FROM lineitem"""

ORACLE["list_strings"] = f"""WITH {TRAFFIC_CTE},
  d AS (SELECT DISTINCT device_id FROM traffic),
  a AS (SELECT list(device_id ORDER BY device_id) AS alld FROM d),
  s AS (SELECT device_id, array_to_string(list_filter(alld, lambda x: x <> device_id), ' ') AS train_devices FROM d JOIN a ON true)
SELECT device_id, train_devices, CAST(len(string_split(train_devices, ' ')) AS INTEGER) AS n_train_devices FROM s"""

ORACLE["stream_counts"] = f"""WITH {TRAFFIC_CTE}
SELECT device_id, binary_label, count(*) AS n FROM traffic GROUP BY ALL"""

ORACLE["cross_run_checks"] = f"""WITH {RUNS_CTE},
  per AS (SELECT experiment, count(*) AS runs, list_sort(list(DISTINCT run_id)) AS run_set,
                 count(*) FILTER (WHERE {' OR '.join(f'{m} IS NULL' for m in RUN_METRICS)}) AS missing
          FROM runs GROUP BY experiment)
SELECT 'same_run_count' AS check, count(DISTINCT runs) = 1 AS passed FROM per
UNION ALL SELECT 'same_run_ids', count(DISTINCT run_set) = 1 FROM per
UNION ALL SELECT 'no_missing_metrics', sum(missing) = 0 FROM per
UNION ALL SELECT 'several_experiments', count(*) > 1 FROM per"""


def wdist_sql(a: str, b: str, feats: list[str]) -> str:
    """Distance over the selected features only: each squared term times its 0/1 weight from ``sel``."""
    terms = [f"(sel.w_{f} * ((CAST({a}.{f} AS DOUBLE) - CAST({b}.{f} AS DOUBLE)) * "
             f"(CAST({a}.{f} AS DOUBLE) - CAST({b}.{f} AS DOUBLE))))" for f in feats]
    return "sqrt(" + " + ".join(terms) + ")"


def _knn_metrics_sql(tag: str, refs: str, dist: str, config: str, n_feat: str) -> str:
    v = vote_sql(f"nn_{tag}")
    for name in ("v1", "v2", "v3", "v4"):
        v = v.replace(f" {name} AS", f" {name}_{tag} AS").replace(f"FROM {name})", f"FROM {name}_{tag})")
        v = v.replace(f"FROM {name} ", f"FROM {name}_{tag} ")
    v = v.replace("vote AS", f"vote_{tag} AS")
    return f"""
  dd_{tag} AS (SELECT te.row_key AS qid, r.row_key AS rid, r.binary_target AS label, {dist} AS dist
               FROM te JOIN {refs} r ON true JOIN sel ON true),
  nn_{tag} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS rk FROM dd_{tag})
               WHERE rk <= 5),
  {v},
  pred_{tag} AS (SELECT te.binary_target AS actual, vote_{tag}.predicted FROM te LEFT JOIN vote_{tag}
                 ON te.row_key = vote_{tag}.qid),
  c_{tag} AS ({counts_sql(f'pred_{tag}')}),
  m_{tag} AS (SELECT '{config}' AS config, {n_feat} AS n_features,
                     CAST((SELECT count(*) FROM {refs}) AS BIGINT) AS train_rows, {metrics_cols_sql()} FROM c_{tag})"""


def three_config_cte(base_cte: str, train_cond: str, test_cond: str) -> str:
    """kNN three-config experiment over ``src`` rows (defined by ``base_cte``) with train/test predicates."""
    params = " UNION ALL ".join(
        f"SELECT {i} AS position, avg(CAST({f} AS DOUBLE)) AS center, "
        f"CASE WHEN coalesce(stddev_pop(CAST({f} AS DOUBLE)), 0) = 0 THEN 1.0 ELSE stddev_pop(CAST({f} AS DOUBLE)) END "
        f"AS scale FROM src WHERE {train_cond}" for i, f in enumerate(FEATS))
    zcols = ", ".join(f"(CAST({f} AS DOUBLE) - (SELECT center FROM params WHERE position = {i})) / "
                      f"(SELECT scale FROM params WHERE position = {i}) AS {f}" for i, f in enumerate(FEATS))
    rank_part = RANK_PART.replace("FROM tsplit WHERE split = 'train'", f"FROM src WHERE {train_cond}")
    return base_cte + f""",
  params AS ({params}),
  te AS (SELECT row_key, binary_target, {zcols} FROM src WHERE {test_cond}),
  tr AS (SELECT row_key, binary_target, {zcols} FROM src WHERE {train_cond}),""" + rank_part + f""",
  sel AS (SELECT {', '.join(f"max(CASE WHEN feature = '{f}' AND rank <= 2 THEN 1.0 ELSE 0.0 END) AS w_{f}" for f in FEATS)},
                 CAST(count(*) FILTER (WHERE rank <= 2) AS INTEGER) AS n_sel FROM ranked),
  cnt AS (SELECT binary_target, count(*) AS n FROM tr GROUP BY 1),
  mx AS (SELECT max(n) AS n_max FROM cnt),
  mc AS (SELECT c.binary_target AS cls, c.n AS n_c, mx.n_max - c.n AS need FROM cnt c JOIN mx ON c.n < mx.n_max),
  mino AS (SELECT tr.*, row_number() OVER (ORDER BY row_key) - 1 AS pos FROM tr JOIN mc ON tr.binary_target = mc.cls),
  md AS (SELECT a.row_key AS qid, b.row_key AS rid, {wdist_sql('a', 'b', FEATS)} AS dist
         FROM mino a JOIN mino b ON a.row_key <> b.row_key JOIN sel ON true),
  mnn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS rk FROM md) WHERE rk <= 5),
  syn0 AS (SELECT unnest(range(need)) AS j, n_c, cls FROM mc),
  syn AS (SELECT j, cls, CAST(floor({uniform52_sql(SEED, "smote:' || cls || ':base", 'j')} * n_c * 5) AS BIGINT) AS r,
                 {uniform52_sql(SEED, "smote:' || cls || ':step", 'j')} AS step FROM syn0),
  syn2 AS (SELECT j, cls, step, r // 5 AS pos, r % 5 + 1 AS nn_rank FROM syn),
  made AS (SELECT -1 - s.j AS row_key, s.cls AS binary_target,
                  {', '.join(f'b.{f} + s.step * (o.{f} - b.{f}) AS {f}' for f in FEATS)}
           FROM syn2 s JOIN mino b ON b.pos = s.pos JOIN mnn ON mnn.qid = b.row_key AND mnn.rk = s.nn_rank
           JOIN mino o ON o.row_key = mnn.rid),
  bal AS (SELECT row_key, binary_target, {', '.join(FEATS)} FROM tr UNION ALL
          SELECT row_key, binary_target, {', '.join(FEATS)} FROM made),""" + \
        _knn_metrics_sql("all", "tr", dist_sql("te", "r", FEATS), "all_features", str(len(FEATS))) + "," + \
        _knn_metrics_sql("top", "tr", wdist_sql("te", "r", FEATS), "top2", "(SELECT n_sel FROM sel)") + "," + \
        _knn_metrics_sql("bal", "bal", wdist_sql("te", "r", FEATS), "top2_smote", "(SELECT n_sel FROM sel)") + "\n"


THREE_SELECT = """
SELECT config, n_features, train_rows, tn, fp, fn, tp, accuracy, precision, recall, f1, macro_f1 FROM m_all
UNION ALL SELECT config, n_features, train_rows, tn, fp, fn, tp, accuracy, precision, recall, f1, macro_f1 FROM m_top
UNION ALL SELECT config, n_features, train_rows, tn, fp, fn, tp, accuracy, precision, recall, f1, macro_f1 FROM m_bal"""

ORACLE["knn_three_config"] = "WITH " + three_config_cte(SPLIT_CTE + ",\n  src AS (SELECT * FROM tsplit)",
                                                       "split = 'train'", "split = 'test'") + THREE_SELECT

ORACLE["transfer_three_config"] = "WITH " + three_config_cte(ORDERED_CTE + ",\n  src AS (SELECT * FROM osplit)",
                                                            "device_id = 1 AND split = 'train'",
                                                            "device_id = 2") + THREE_SELECT

ORACLE["eda_quantiles"] = f"WITH {TRAFFIC_CTE}\n" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, " + ", ".join(
        f"round(quantile_disc(CAST({f} AS DOUBLE), {p}), 6) AS q{int(round(p * 100))}" for p in (0.25, 0.5, 0.75, 0.9))
    + " FROM traffic" for f in FEATS)


# ------------------------------------------------------------------ M8 / M9 with kNN on selected features
def fold_knn_weighted_cte(folds_sql: str, train_cond: str, test_cond: str, weights_sql: str) -> str:
    """As fold_knn_cte, with per-fold 0/1 feature weights ``fw(fold, w_<feature>...)`` in the distance."""
    agg = []
    for i, f in enumerate(FEATS):
        x = f"CAST(t.{f} AS DOUBLE)"
        agg.append(f"avg({x}) AS m{i}, CASE WHEN coalesce(stddev_pop({x}), 0) = 0 THEN 1.0 ELSE stddev_pop({x}) END AS s{i}")
    zcols = ", ".join(f"(CAST(t.{f} AS DOUBLE) - p.m{i}) / p.s{i} AS {f}" for i, f in enumerate(FEATS))
    terms = " + ".join(f"(fw.w_{f} * ((q.{f} - r.{f}) * (q.{f} - r.{f})))" for f in FEATS)
    return f"""
  folds AS ({folds_sql}),
  fw AS ({weights_sql}),
  fparams AS (SELECT f.fold, {', '.join(agg)} FROM folds f JOIN traffic t ON {train_cond} GROUP BY f.fold),
  fz AS (SELECT p.fold, t.row_key, t.binary_target, ({test_cond}) AS is_test, ({train_cond}) AS is_train, {zcols}
         FROM fparams p JOIN traffic t ON true JOIN folds f ON f.fold = p.fold),
  fdd AS (SELECT q.fold, q.row_key AS qid, r.row_key AS rid, r.binary_target AS label, sqrt({terms}) AS dist
          FROM fz q JOIN fz r ON q.fold = r.fold AND q.is_test AND r.is_train JOIN fw ON fw.fold = q.fold),
  fnn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold, qid ORDER BY dist, rid) AS rk FROM fdd) WHERE rk <= 5),
  {vote_sql('fnn', 'fold')},
  fpred AS (SELECT q.fold, q.row_key, q.binary_target AS actual, vote.predicted
            FROM fz q LEFT JOIN vote ON vote.fold = q.fold AND vote.qid = q.row_key WHERE q.is_test)
"""


def _lodo_sel_select(sel_names_cte: str) -> str:
    return f"""
  c AS ({counts_sql('fpred', group='fold')}),
  fsz AS (SELECT device_id AS fold, count(*) AS n FROM traffic GROUP BY 1),
  names AS ({sel_names_cte})
SELECT CAST(c.fold AS INTEGER) AS device_id, names.selected, tn, fp, fn, tp,
       round(coalesce((tp + tn) / nullif(tn + fp + fn + tp, 0), 0.0), 6) AS accuracy,
       round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall,
       round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1,
       round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) + coalesce(2 * tn / nullif(2 * tn + fn + fp, 0), 0.0)) / 2, 6)
         AS macro_f1,
       tn + fp + fn + tp = fsz.n AS v_confusion_total, names.n_sel = 2 AS v_unique_features,
       names.n_sel = names.n_known AS v_subset_of_all
FROM c JOIN fsz USING (fold) JOIN names USING (fold)"""


_W_GLOBAL = ", ".join(f"max(CASE WHEN feature = '{f}' AND rank <= 2 THEN 1.0 ELSE 0.0 END) AS w_{f}" for f in FEATS)
_KNOWN = ", ".join(f"'{f}'" for f in FEATS)

ORACLE["lodo_knn_global_top"] = f"WITH {RANK_CTE}," + fold_knn_weighted_cte(
    "SELECT DISTINCT device_id AS fold FROM traffic",
    "t.device_id IS DISTINCT FROM f.fold", "t.device_id IS NOT DISTINCT FROM f.fold",
    f"SELECT f.fold, g.* FROM folds f JOIN (SELECT {_W_GLOBAL} FROM ranked) g ON true") + "," + _lodo_sel_select(
    f"SELECT f.fold, s.selected, s.n_sel, s.n_known FROM folds f JOIN (SELECT string_agg(feature, ' ' ORDER BY "
    f"source_column_index) AS selected, count(*) AS n_sel, count(*) FILTER (WHERE feature IN ({_KNOWN})) AS n_known "
    f"FROM ranked WHERE rank <= 2) s ON true")

_W_FOLD = ", ".join(f"max(CASE WHEN feature = '{f}' AND rank <= 2 THEN 1.0 ELSE 0.0 END) AS w_{f}" for f in FEATS)

ORACLE["nested_lodo_knn"] = f"WITH {FOLD_RANK_CTE}," + fold_knn_weighted_cte(
    "SELECT DISTINCT device_id AS fold FROM traffic",
    "t.device_id IS DISTINCT FROM f.fold", "t.device_id IS NOT DISTINCT FROM f.fold",
    f"SELECT fold, {_W_FOLD} FROM fr GROUP BY fold") + "," + _lodo_sel_select(
    f"SELECT fold, string_agg(feature, ' ' ORDER BY source_column_index) AS selected, count(*) AS n_sel, "
    f"count(*) FILTER (WHERE feature IN ({_KNOWN})) AS n_known FROM fr WHERE rank <= 2 GROUP BY fold")

# ------------------------------------------------------------------ families, and the 64 embedding columns
FAMILIES = ["benign", "signup", "click", "error", "purchase"]
_FZ = ", ".join(f"(CAST({f} AS DOUBLE) - m{i}) / s{i} AS {f}" for i, f in enumerate(FEATS))
_FP = ", ".join(f"avg(CAST({f} AS DOUBLE)) AS m{i}, CASE WHEN coalesce(stddev_pop(CAST({f} AS DOUBLE)), 0) = 0 THEN 1.0 ELSE stddev_pop(CAST({f} AS DOUBLE)) END AS s{i}"
                for i, f in enumerate(FEATS))
FAMILY_CTE = TRAFFIC_CTE + f""",
  fam AS (SELECT *, CAST(list_position({FAMILIES}, family) - 1 AS INTEGER) AS family_code FROM traffic),
  fq AS (SELECT family_code, CAST(round_even(count(*) * 0.2::DOUBLE, 0) AS BIGINT) AS q FROM fam GROUP BY 1),
  fr AS (SELECT fam.*, row_number() OVER (PARTITION BY family_code ORDER BY {hash32_sql(SEED, 'split', 'row_key')}, row_key) AS _rn FROM fam),
  fs AS (SELECT fr.*, CASE WHEN _rn <= fq.q THEN 'test' ELSE 'train' END AS split FROM fr JOIN fq USING (family_code)),
  fp AS (SELECT {_FP} FROM fs WHERE split = 'train'),
  te AS (SELECT row_key, family_code, {_FZ} FROM fs JOIN fp ON true WHERE split = 'test'),
  tr AS (SELECT row_key, family_code, {_FZ} FROM fs JOIN fp ON true WHERE split = 'train'),
  cnt AS (SELECT family_code, count(*) AS n FROM tr GROUP BY 1),
  mc AS (SELECT family_code AS cls, n AS n_c, (SELECT max(n) FROM cnt) - n AS need FROM cnt WHERE n < (SELECT max(n) FROM cnt)),
  mino AS (SELECT tr.*, row_number() OVER (PARTITION BY family_code ORDER BY row_key) - 1 AS pos FROM tr JOIN mc ON mc.cls = tr.family_code),
  md AS (SELECT a.row_key AS qid, b.row_key AS rid, {dist_sql('a', 'b', FEATS)} AS dist
         FROM mino a JOIN mino b ON a.family_code = b.family_code AND a.row_key <> b.row_key),
  mnn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS rk FROM md) WHERE rk <= 5),
  syn0 AS (SELECT unnest(range(need)) AS j, n_c, cls FROM mc),
  syn AS (SELECT j, cls, CAST(floor({uniform52_sql(SEED, "smote:' || cls || ':base", 'j')} * n_c * 5) AS BIGINT) AS r,
                 {uniform52_sql(SEED, "smote:' || cls || ':step", 'j')} AS step FROM syn0),
  made AS (SELECT s.j, s.cls, b.row_key AS base_key, o.row_key AS nn_key,
                  {', '.join(f'b.{f} + s.step * (o.{f} - b.{f}) AS {f}' for f in FEATS)}
           FROM syn s JOIN mino b ON b.pos = s.r // 5 AND b.family_code = s.cls JOIN mnn ON mnn.qid = b.row_key AND mnn.rk = s.r % 5 + 1
           JOIN mino o ON o.row_key = mnn.rid)
"""
ORACLE["multiclass_smote"] = f"""WITH {FAMILY_CTE}
SELECT family_code, false AS is_synthetic, count(*) AS n, CAST(0 AS BIGINT) AS base_keys, CAST(0 AS BIGINT) AS nn_keys FROM tr GROUP BY 1
UNION ALL SELECT cls, true, count(*), CAST(sum(base_key) AS BIGINT), CAST(sum(nn_key) AS BIGINT) FROM made GROUP BY 1"""

ORACLE["multiclass_report"] = f"""WITH {FAMILY_CTE},
  bal AS (SELECT row_key, family_code, {', '.join(FEATS)} FROM tr UNION ALL
          SELECT -1 - (j * {len(FAMILIES)} + cls), cls, {', '.join(FEATS)} FROM made),
  dd AS (SELECT te.row_key AS qid, bal.row_key AS rid, bal.family_code AS label, {dist_sql('te', 'bal', FEATS)} AS dist FROM te JOIN bal ON true),
  nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS rk FROM dd) WHERE rk <= 5),
  {vote_sql('nn')},
  pred AS (SELECT te.family_code AS a, vote.predicted AS p FROM te LEFT JOIN vote ON te.row_key = vote.qid),""" + (
    ORACLE["classification_report"][ORACLE["classification_report"].index("  cells AS (SELECT a, p"):]
    .replace("SELECT CAST(label AS VARCHAR) AS class,", f"SELECT {FAMILIES}[label + 1] AS class,"))


def wide_rank_cte() -> str:
    n = []
    for i, f in enumerate(EFEATS):
        x = f"CAST({f} AS DOUBLE)"
        n.append(f"SELECT '{f}' AS feature, {i} AS source_column_index, binary_target AS c, count({x}) AS n, avg({x}) AS m, var_pop({x}) * count({x}) AS v "
                 "FROM et WHERE split = 'train' GROUP BY binary_target")
    return f"""{EMB_CTE},
  wq AS (SELECT binary_target, CAST(round_even(count(*) * 0.2::DOUBLE, 0) AS BIGINT) AS q FROM emb GROUP BY 1),
  wr AS (SELECT emb.*, row_number() OVER (PARTITION BY binary_target ORDER BY {hash32_sql(SEED, 'split', 'row_key')}, row_key) AS _rn FROM emb),
  et AS MATERIALIZED (SELECT wr.*, CASE WHEN _rn <= wq.q THEN 'test' ELSE 'train' END AS split FROM wr JOIN wq USING (binary_target)),
  ws AS ({' UNION ALL '.join(n)}),
  wt AS (SELECT feature, source_column_index, sum(n * m) / sum(n) AS mean FROM ws GROUP BY ALL),
  wi AS (SELECT ws.feature, ws.source_column_index, CASE WHEN sum(v) + sum(n * (m - mean) * (m - mean)) > 0
           THEN sum(n * (m - mean) * (m - mean)) / (sum(v) + sum(n * (m - mean) * (m - mean))) ELSE 0.0 END AS importance
         FROM ws JOIN wt USING (feature) GROUP BY ALL),
  wk AS (SELECT *, CAST(row_number() OVER (ORDER BY importance DESC, source_column_index) AS INTEGER) AS rank FROM wi)"""


ORACLE["feature_rank_wide"] = f"""WITH {wide_rank_cte()}
SELECT rank, feature, round(importance, 6) AS importance, source_column_index, rank <= 20 AS selected FROM wk"""


def wide_config_sql(tag: str, config: str, n: str, weighted: bool) -> str:
    w = (lambda f: f"w_{f} * ") if weighted else (lambda f: "")
    terms = " + ".join(f"{w(f)}(((CAST(te.{f} AS DOUBLE) - m{i}) / s{i} - (CAST(tr.{f} AS DOUBLE) - m{i}) / s{i}) ** 2)" for i, f in enumerate(EFEATS))
    v = vote_sql(f"nn_{tag}")
    for name in ("v1", "v2", "v3", "v4"):
        v = v.replace(f" {name} AS", f" {name}_{tag} AS").replace(f"FROM {name})", f"FROM {name}_{tag})").replace(f"FROM {name} ", f"FROM {name}_{tag} ")
    return f"""
  dd_{tag} AS (SELECT te.row_key AS qid, tr.row_key AS rid, tr.binary_target AS label, sqrt({terms}) AS dist FROM te JOIN tr ON true JOIN ep ON true JOIN wsel ON true),
  nn_{tag} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS rk FROM dd_{tag}) WHERE rk <= 5),
  {v.replace("vote AS", f"vote_{tag} AS")},
  c_{tag} AS ({counts_sql(f'(SELECT te.binary_target AS actual, x.predicted FROM te LEFT JOIN vote_{tag} x ON x.qid = te.row_key)')}),
  m_{tag} AS (SELECT '{config}' AS config, {n} AS n_features, {metrics_cols_sql()} FROM c_{tag})"""


ORACLE["wide_three_config"] = f"""WITH {wide_rank_cte()},
  wsel AS (SELECT {', '.join(f"max(CASE WHEN feature = '{f}' AND rank <= 20 THEN 1.0 ELSE 0.0 END) AS w_{f}" for f in EFEATS)} FROM wk),
  ep AS (SELECT {_emb_params_sql()} FROM et WHERE split = 'train'),
  te AS (SELECT * FROM et WHERE split = 'test'), tr AS (SELECT * FROM et WHERE split = 'train'),""" + wide_config_sql(
    "all", "all_features", "64", False) + "," + wide_config_sql("top", "top20", "20", True) + """
SELECT config, n_features, tn, fp, fn, tp, accuracy, macro_f1 FROM m_all
UNION ALL SELECT config, n_features, tn, fp, fn, tp, accuracy, macro_f1 FROM m_top
UNION ALL SELECT 'top20_ranked', n_features, tn, fp, fn, tp, accuracy, macro_f1 FROM m_top"""

ORACLE["experiment_run_checks"] = ORACLE["knn_three_config"].replace(THREE_SELECT, "") + """,
  runs AS (""" + THREE_SELECT + """)
SELECT 'three_runs' AS check, count(*) = 3 AS passed FROM runs
UNION ALL SELECT 'feature_counts', count(*) FILTER (WHERE config = 'all_features' AND n_features = 4) = 1
          AND count(*) FILTER (WHERE config <> 'all_features' AND n_features = 2) = 2 FROM runs
UNION ALL SELECT 'features_are_as_many_as_counted', (SELECT n_sel FROM sel) = 2
UNION ALL SELECT 'top_runs_share_features_and_order', (SELECT count(*) FROM sel) = 1
UNION ALL SELECT 'one_test_source', true
UNION ALL SELECT 'same_test_labels', (SELECT count(DISTINCT n) FROM (SELECT count(*) AS n FROM pred_all UNION ALL
          SELECT count(*) FROM pred_top UNION ALL SELECT count(*) FROM pred_bal)) = 1
UNION ALL SELECT 'same_test_rows', count(DISTINCT tn + fp + fn + tp) = 1 FROM runs
UNION ALL SELECT 'same_test_attack_rows', count(DISTINCT fn + tp) = 1 FROM runs
UNION ALL SELECT 'smote_run_has_more_train_rows',
          max(CASE WHEN config LIKE '%_smote' THEN train_rows END) > max(CASE WHEN config = 'all_features' THEN train_rows END)
FROM runs"""

ORACLE["nested_lodo_checks"] = f"""WITH {TRAFFIC_CTE}, d AS (SELECT DISTINCT device_id FROM traffic)
SELECT CAST(device_id AS INTEGER) AS fold, c."check", true AS passed FROM d, (VALUES ('fold_was_run'), ('confusion_covers_group'), ('features_distinct'),
  ('features_known'), ('held_out_not_in_train'), ('train_and_test_are_all_rows')) c("check")"""

ORACLE["ordered_cut"] = f"""WITH {ORDERED_CTE}
SELECT row_key, source_file, split FROM osplit"""

ORACLE["attack_type_holdout"] = f"WITH {TRAFFIC_CTE}," + fold_knn_cte(
    "SELECT DISTINCT multiclass_label AS fold FROM traffic WHERE attack_type IS NOT NULL",
    "t.multiclass_label IS DISTINCT FROM f.fold", "t.multiclass_label IS NOT DISTINCT FROM f.fold") + f""",
  c AS ({counts_sql('fpred', group='fold')})
SELECT c.fold AS held_out_type, tn, fp, fn, tp, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall, ftrain.train_rows
FROM c JOIN ftrain USING (fold)"""

_BENIGN = ", ".join(f"avg(CAST({f} AS DOUBLE)) AS m{i}, stddev_pop(CAST({f} AS DOUBLE)) AS s{i}" for i, f in enumerate(FEATS))
_BENIGN_Z = ", ".join(f"(CAST(t.{f} AS DOUBLE) - s.m{i}) / CASE WHEN s.s{i} > 0 THEN s.s{i} ELSE 1.0 END AS {f}" for i, f in enumerate(FEATS))
ORACLE["lof_benign"] = f"""WITH {TRAFFIC_CTE},
  st AS (SELECT device_id, {_BENIGN} FROM traffic WHERE binary_target = 0 GROUP BY device_id),
  z AS (SELECT t.row_key, t.device_id, t.binary_target, {_BENIGN_Z} FROM traffic t JOIN st s ON s.device_id = t.device_id),
  d AS (SELECT a.row_key AS qid, b.row_key AS rid, a.binary_target AS target, {dist_sql('a', 'b', FEATS)} AS dist
        FROM z a JOIN z b ON a.device_id = b.device_id AND b.binary_target = 0 AND a.row_key <> b.row_key),
  nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, rid) AS rk FROM d) WHERE rk <= 5),
  kd AS (SELECT qid, max(dist) AS k_distance FROM nn GROUP BY 1),
  lrd AS (SELECT nn.qid, CASE WHEN avg(greatest(kd.k_distance, nn.dist)) > 0 THEN 1.0 / avg(greatest(kd.k_distance, nn.dist)) ELSE 'inf'::DOUBLE END AS lrd
          FROM nn JOIN kd ON nn.rid = kd.qid GROUP BY 1),
  lo AS (SELECT nn.qid, avg(l.lrd) AS mo FROM nn JOIN lrd l ON nn.rid = l.qid GROUP BY 1)
SELECT t.row_key, t.device_id, round(k_distance, 6) AS k_distance, round(lrd, 6) AS lrd,
       round(CASE WHEN isinf(mo) AND isinf(lrd) THEN 1.0 WHEN isinf(lrd) THEN 0.0 ELSE mo / lrd END, 6) AS lof
FROM traffic t LEFT JOIN kd ON kd.qid = t.row_key LEFT JOIN lrd ON lrd.qid = t.row_key LEFT JOIN lo ON lo.qid = t.row_key"""

ORACLE["knn_approx"] = """SELECT unnest(['recall_at_least_0.9', 'every_query_has_k_rows', 'few_pairs_meet']) AS check,
  (SELECT count(*) FROM events) > 0 AS passed"""


def digest_sql(src: str, value: str, stage: str) -> str:
    """Digest of ``value`` in the order of row_key: chunks of 4096 rows, and the chunks' digests in order (two levels)."""
    return f"""SELECT '{stage}' AS stage, CAST(sum(n) AS BIGINT) AS rows,
  CASE WHEN count(*) = 1 THEN max(h) ELSE sha256(string_agg(h, ',' ORDER BY c)) END AS digest
FROM (SELECT c, count(*) AS n, sha256(string_agg(v, ',' ORDER BY pos)) AS h FROM (
  SELECT pos // 4096 AS c, pos, v FROM (SELECT row_number() OVER (ORDER BY row_key) - 1 AS pos, coalesce({value}::VARCHAR, '') AS v FROM {src})) GROUP BY c)"""


ORACLE["label_digest"] = f"WITH {KNN_PRED_CTE}\n" + " UNION ALL ".join((
    digest_sql("te", "binary_target", "split_test"), digest_sql("pred", "actual", "carried"), digest_sql("pred", "predicted", "predicted")))


def leak_sql(scope: str, src: str, part: str, cols: list[str]) -> str:
    same = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in cols)
    return f"""SELECT '{scope}' AS scope, part, count(*) AS rows, count(*) FILTER (WHERE copied) AS copied_rows,
  count(DISTINCT CASE WHEN copied THEN ({', '.join(cols)}) END) AS copied_tuples, count(*) FILTER (WHERE copied) = 0 AS clean
FROM (SELECT a.*, {part} AS part, EXISTS (SELECT 1 FROM {src} b WHERE {same} AND b.{part} IS DISTINCT FROM a.{part}) AS copied FROM {src} a) GROUP BY part"""


_LEAK = [*FEATS, "binary_target"]
ORACLE["leakage_check"] = f"""WITH {SPLIT_CTE}, {ORDERED_CTE[len(TRAFFIC_CTE) + 1:]}, {EMB_CTE},
  folds AS (SELECT *, CAST(device_id AS VARCHAR) AS fold FROM traffic),
  eq AS (SELECT class_label, CAST(round_even(count(*) * 0.2::DOUBLE, 0) AS BIGINT) AS q FROM emb GROUP BY 1),
  er AS (SELECT emb.*, row_number() OVER (PARTITION BY class_label
            ORDER BY {hash32_sql(SEED, 'split', 'row_key')}, row_key) AS _rn FROM emb),
  es AS (SELECT round(e0, 0) AS e0, round(e1, 0) AS e1, CASE WHEN _rn <= eq.q THEN 'test' ELSE 'train' END AS split FROM er JOIN eq USING (class_label))
""" + " UNION ALL ".join((leak_sql("stratified_split", "tsplit", "split", _LEAK), leak_sql("ordered_split", "osplit", "split", _LEAK),
                          leak_sql("device_folds", "folds", "fold", _LEAK), leak_sql("rounded_embeddings", "es", "split", ["e0", "e1"])))

ORACLE["roundtrip_partitions"] = f"""WITH {TRAFFIC_CTE}
SELECT device_id, binary_label, count(*) AS n, CAST(sum(row_key) AS BIGINT) AS keys, round(sum(CAST(value AS DOUBLE)), 6) AS value, true AS pruned
FROM traffic WHERE device_id <> 3 OR binary_label = 'attack' GROUP BY device_id, binary_label"""

ORACLE["roundtrip_json"] = f"""WITH {RUNS_CTE}
SELECT experiment, run_id, n_orders AS orders, round(open_share, 6) AS open_share, round(max_price, 6) AS max_price,
       round(total_price, 6) AS total_price, CAST(2 AS INTEGER) AS n_names FROM runs"""

_INV = "CASE WHEN isnan(pow(l_discount, -1.0)) OR isinf(pow(l_discount, -1.0)) THEN NULL ELSE pow(l_discount, -1.0) END"
_SQ = "CASE WHEN isnan(sqrt(l_tax - 0.04::DOUBLE)) OR isinf(sqrt(l_tax - 0.04::DOUBLE)) THEN NULL ELSE sqrt(l_tax - 0.04::DOUBLE) END"
ORACLE["nonfinite_nested"] = f"""SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS quantity, round({_INV}, 6) AS inv, round({_SQ}, 6) AS first,
       round({_INV}, 6) AS second, CAST(2 AS INTEGER) AS n_both, round({_INV}, 6) AS by_inv, round({_SQ}, 6) AS by_sqrt FROM lineitem"""

ORACLE["transfer_rf_supports"] = f"""WITH {ORDERED_CTE},
  tr AS (SELECT count(*) AS n, max(c) AS most, count(*) * 0 + max(k) AS k FROM (SELECT count(*) OVER (PARTITION BY binary_target) AS c, 1 AS k
         FROM osplit WHERE device_id = 1 AND split = 'train')),
  te AS (SELECT count(*) FILTER (WHERE binary_target = 0) AS b, count(*) FILTER (WHERE binary_target = 1) AS a FROM traffic WHERE device_id = 2)
SELECT 'all_features' AS config, 4 AS n_features, CAST(n AS BIGINT) AS train_rows, b AS benign_support, a AS attack_support FROM tr, te
UNION ALL SELECT 'top2', 2, CAST(n AS BIGINT), b, a FROM tr, te
UNION ALL SELECT 'top2_smote', 2, CAST(2 * most AS BIGINT), b, a FROM tr, te"""
