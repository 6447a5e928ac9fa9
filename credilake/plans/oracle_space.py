"""ANSI SQL for the vector queries."""

from __future__ import annotations

from credilake.plans.oracle_core import FEATURE_LIST, IMPUTED, with_profile

_VECTORS = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label AS cluster FROM embeddings)"
_PAIRS = f"{_VECTORS}, d AS (SELECT a.id, b.id AS other, a.cluster, b.cluster AS other_cluster, list_distance(a.vec, b.vec) AS distance FROM v a JOIN v b ON a.id <> b.id)"
_RANKED = "nn AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY distance, other) AS rank FROM d) WHERE rank <= {k})"
# one row per vector and dimension
_LONG = f"{_VECTORS}, e AS (SELECT id, cluster, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM v), centre AS (SELECT cluster, dim, AVG(x) AS c, COUNT(*) AS n FROM e GROUP BY 1, 2), gap AS (SELECT e.id, e.cluster, SUM((x - c) * (x - c)) AS d2 FROM e JOIN centre USING (cluster, dim) GROUP BY 1, 2)"


def _silhouette(distance: str) -> str:
    return f"""WITH {_PAIRS},
size AS (SELECT cluster, COUNT(*) AS n FROM v GROUP BY 1),
part AS (SELECT id, cluster, other_cluster, SUM({distance}) AS total FROM d GROUP BY 1, 2, 3),
ab AS (SELECT p.id, MAX(CASE WHEN p.cluster = p.other_cluster THEN total / (n - 1) END) AS a,
              MIN(CASE WHEN p.cluster <> p.other_cluster THEN total / n END) AS b
       FROM part p JOIN size s ON s.cluster = p.other_cluster GROUP BY 1)
SELECT ROUND(AVG((b - a) / GREATEST(a, b)), 6) AS silhouette FROM ab"""


_RULES = """
cestas AS (
  SELECT CASE WHEN ingreso_mensual > m.mi THEN 1 ELSE 0 END + CASE WHEN total_deudas > m.md THEN 2 ELSE 0 END
       + CASE WHEN excedente > 0 THEN 4 ELSE 0 END + CASE WHEN mora_diaria > 30 THEN 8 ELSE 0 END
       + CASE WHEN viable = 1 THEN 16 ELSE 0 END AS basket
  FROM limpio CROSS JOIN (SELECT quantile_cont(ingreso_mensual, 0.5) AS mi, quantile_cont(total_deudas, 0.5) AS md FROM limpio) m),
conjuntos AS (
  SELECT s AS itemset, COUNT(*) / (SELECT CAST(COUNT(*) AS DOUBLE) FROM cestas) AS support
  FROM cestas JOIN (SELECT range AS s FROM range(1, 32)) ON basket & s = s GROUP BY 1
  HAVING COUNT(*) >= (SELECT COUNT(*) FROM cestas) * CAST(0.1 AS DOUBLE)),
reglas AS (
  SELECT CAST(a.itemset AS INTEGER) AS antecedent, CAST(c.itemset AS INTEGER) AS consequent, w.support,
         w.support / a.support AS confidence, w.support / a.support / c.support AS lift
  FROM conjuntos a JOIN conjuntos c ON a.itemset & c.itemset = 0 JOIN conjuntos w ON w.itemset = a.itemset | c.itemset
  WHERE w.support / a.support >= CAST(0.5 AS DOUBLE))"""
_ITEMS = ["ingreso_alto", "deuda_alta_ap", "excedente_positivo", "mora_alta", "resultado_viable"]


def _names(mask: str) -> str:
    return "concat_ws('+', " + ", ".join(
        f"CASE WHEN {mask} & {1 << i} <> 0 THEN '{n}' END" for i, n in enumerate(_ITEMS)
    ) + ")"


SPACE = {
    "robust_scaled": with_profile(
        "SELECT p.id_cliente, "
        + ", ".join(
            f"ROUND((p.{c} - q.m_{c}) / CASE WHEN q.r_{c} = 0 THEN 1 ELSE q.r_{c} END, 9) AS {c}"
            for c in FEATURE_LIST
        )
        + " FROM perfil p CROSS JOIN q",
        "q AS (SELECT "
        + ", ".join(
            f"quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS r_{c}"
            for c in FEATURE_LIST
        )
        + " FROM perfil)",
    ),
    "inverse_scaled": with_profile(
        "SELECT id_cliente, "
        + ", ".join(
            f"ROUND(CAST({c} AS DOUBLE), 6) AS {c}" for c in FEATURE_LIST
        )
        + " FROM perfil"
    ),
    "knn_topk": f"WITH {_PAIRS}, {_RANKED.format(k=5)} SELECT id, other AS neighbor_id, ROUND(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM nn",
    "knn_classify": f"""WITH {_PAIRS}, {_RANKED.format(k=5)},
votes AS (SELECT id, other_cluster AS label, SUM(1 / distance) AS w FROM nn GROUP BY 1, 2)
SELECT id, label AS predicted, ROUND(w / total, 6) AS share FROM (
  SELECT *, SUM(w) OVER (PARTITION BY id) AS total, ROW_NUMBER() OVER (PARTITION BY id ORDER BY w DESC, label) AS rn FROM votes)
WHERE rn = 1""",
    "eps_pairs": f"WITH {_PAIRS} SELECT id, other, ROUND(distance, 6) AS distance FROM d WHERE id < other AND distance <= CAST(1.15 AS DOUBLE)",
    "dbscan": f"""WITH RECURSIVE {_PAIRS},
near AS (SELECT id, other FROM d WHERE distance <= CAST(1.15 AS DOUBLE)),
core AS (SELECT id FROM near GROUP BY 1 HAVING COUNT(*) + 1 >= 5),
edge AS (SELECT n.id, n.other FROM near n JOIN core a ON a.id = n.id JOIN core b ON b.id = n.other),
reach AS (SELECT id, id AS root FROM core UNION SELECT e.other, r.root FROM reach r JOIN edge e ON e.id = r.id),
part AS (SELECT id, MIN(root) AS component FROM reach GROUP BY 1),
numbered AS (SELECT id, DENSE_RANK() OVER (ORDER BY component) - 1 AS cluster FROM part),
border AS (SELECT n.id, MIN(p.cluster) AS cluster FROM near n JOIN numbered p ON p.id = n.other
           WHERE n.id NOT IN (SELECT id FROM core) GROUP BY 1)
SELECT v.id, CAST(COALESCE(p.cluster, b.cluster, -1) AS INTEGER) AS cluster, p.id IS NOT NULL AS is_core
FROM v LEFT JOIN numbered p ON p.id = v.id LEFT JOIN border b ON b.id = v.id""",
    "lof": "",
    "lof_anomalies": "",
    "silhouette": _silhouette("distance"),
    "silhouette_squared": _silhouette("distance * distance"),
    "davies_bouldin": f"""WITH {_LONG},
scatter AS (SELECT cluster, AVG(sqrt(d2)) AS s FROM gap GROUP BY 1),
apart AS (SELECT a.cluster AS i, b.cluster AS j, sqrt(SUM((a.c - b.c) * (a.c - b.c))) AS m
          FROM centre a JOIN centre b ON a.dim = b.dim AND a.cluster <> b.cluster GROUP BY 1, 2)
SELECT ROUND(AVG(worst), 6) AS davies_bouldin FROM (
  SELECT i, MAX((x.s + y.s) / m) AS worst FROM apart JOIN scatter x ON x.cluster = i JOIN scatter y ON y.cluster = j GROUP BY 1)""",
    "calinski_harabasz": f"""WITH {_LONG},
grand AS (SELECT dim, AVG(x) AS g FROM e GROUP BY 1),
between_ss AS (SELECT SUM(n * (c - g) * (c - g)) AS b, COUNT(DISTINCT cluster) AS k FROM centre JOIN grand USING (dim)),
within_ss AS (SELECT SUM(d2) AS w, COUNT(*) AS n FROM gap)
SELECT ROUND(b / w * (n - k) / (k - 1), 6) AS calinski_harabasz FROM between_ss CROSS JOIN within_ss""",
    "inertia": f"WITH {_LONG} SELECT ROUND(SUM(d2), 6) AS inertia FROM gap",
    "count_clusters": "SELECT COUNT(DISTINCT label) AS num_clusters FROM embeddings",
    "cluster_profiles": with_profile(
        "SELECT num_cuotas AS cluster, COUNT(*) AS size, "
        + ", ".join(f"ROUND(ROUND(AVG({c}), 8), 4) AS center_{c}" for c in FEATURE_LIST if c != "num_cuotas")
        + """, ROUND(AVG(viable), 4) AS viable_ratio,
                  ROUND(CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM perfil) * 100, 4) AS percentage, FALSE AS is_noise
           FROM perfil GROUP BY 1"""
    ),
    "assign_cluster": f"""WITH {_LONG},
dist AS (SELECT e.id, c.cluster, SUM((x - c) * (x - c)) AS d2 FROM e JOIN centre c ON c.dim = e.dim GROUP BY 1, 2)
SELECT id, cluster FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY d2, cluster) AS rn FROM dist) WHERE rn = 1""",
    "apriori_rules": with_profile(
        "SELECT antecedent, consequent, ROUND(support, 6) AS support, ROUND(confidence, 6) AS confidence, ROUND(lift, 6) AS lift FROM reglas",
        IMPUTED,
        _RULES,
    ),
    "apriori_top": with_profile(
        f"""SELECT {_names('antecedent')} AS antecedents, {_names('consequent')} AS consequents, ROUND(support, 6) AS support,
              ROUND(confidence, 6) AS confidence, ROUND(lift, 6) AS lift,
              LEAST((SELECT COUNT(*) FROM reglas), 15) AS total_rules
            FROM reglas ORDER BY reglas.lift DESC, reglas.support DESC, antecedent, consequent LIMIT 10""",
        IMPUTED,
        _RULES,
    ),
}

_LOF = f"""WITH {_PAIRS}, {_RANKED.format(k=20)},
kd AS (SELECT id, MAX(distance) AS k_distance FROM nn GROUP BY 1),
density AS (SELECT nn.id, 1 / (AVG(GREATEST(distance, k_distance)) + CAST(1e-10 AS DOUBLE)) AS density
            FROM nn JOIN kd ON kd.id = nn.other GROUP BY 1),
factor AS (SELECT nn.id, AVG(o.density) / MAX(s.density) AS lof
           FROM nn JOIN density o ON o.id = nn.other JOIN density s ON s.id = nn.id GROUP BY 1)"""
SPACE["lof"] = f"{_LOF} SELECT id, ROUND(lof, 6) AS lof FROM factor"
SPACE["lof_anomalies"] = (
    f"{_LOF} SELECT id, ROUND(lof, 6) AS lof FROM factor"
    " WHERE -lof < (SELECT quantile_cont(-lof, 0.1) FROM factor) ORDER BY id LIMIT 50"
)
SPACE["assign_cluster_stored"] = SPACE["assign_cluster"]
SPACE["iforest_stored"] = with_profile("SELECT COUNT(*) AS n, 0 AS n_other FROM perfil WHERE viable = 0")
