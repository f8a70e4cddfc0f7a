"""Queries of re-exports and effects: every part is a TypeScript module ``src/pK.ts``, written by rule from its key.

In each run of 100 keys, key 0 declares a name, keys 1 to 39 hand it on one to the next, renamed; 40 to 49 are barrels over each other and over the chain;
50 to 54 point at each other in a ring, and 55 to 59 hand on a name that is nowhere.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codelattice.operators import modules
from codelattice.operators.lineage import cut
from codelattice.plans.table_queries import query
from codelattice.plans.web_queries import _written

QUERIES, ORACLES = {}, {}  # these register with the table queries


def module_files(t):
    k = F.col("p_partkey")
    r = k % 100
    to = lambda n: _written("'./p", n, "'")
    text = (
        F.when(r == 0, _written("export function n", k, "() { state.items.push(1); this.total = 2; try { a(); } catch (err) { } }\n// export const ghost = 1;\nexport default class X {}\n"))
        .when(r < 40, _written("export { n", k - 1, " as n", k, " } from ", to(k - 1), ";\nexport const own", k, " = 1;\n"))
        .when(r == 40, _written("export * from ", to(k - 1), ";\nexport * from ", to(k - 35), ";\n"))
        .when(r < 50, _written("export * from ", to(k - 1), ";\nexport * from ", to(k - 1 + F.when(r == 44, 3).otherwise(0)), "\n"))
        .when(r < 55, _written("export { ring as ring } from ", to(k - r + 50 + (r - 50 + 1) % 5), ";"))
        .when(r < 60, _written("export { gone } from ", to(k - 1), ";"))
        .otherwise(_written("import D, { n", k - r + 39, " as local, own", k - r + 5, ", ring, n", k - r, " } from ", to(k - r + 40 + k % 10), ";\nimport { n", k - r + k % 40, " } from ", to(k - r + k % 40), ";\nlocal.value = D; p.then(x).catch(e => 1);\n"))
    )
    return t("part").select(_written("src/p", k, ".ts").alias("path"), text.alias("text"))


_MODULES = """k AS (SELECT p_partkey AS k, p_partkey % 100 AS r FROM part), have AS (SELECT p_partkey AS k FROM part),
decl AS (SELECT k, 'n' || k AS name FROM k WHERE r = 0 UNION ALL SELECT k, 'default' FROM k WHERE r = 0 UNION ALL SELECT k, 'own' || k FROM k WHERE r BETWEEN 1 AND 39),
al AS (SELECT k, 'n' || k AS name, k - 1 AS s, 'n' || (k - 1) AS sn FROM k WHERE r BETWEEN 1 AND 39 UNION ALL SELECT k, 'ring', k - r + 50 + (r - 49) % 5, 'ring' FROM k WHERE r BETWEEN 50 AND 54 UNION ALL SELECT k, 'gone', k - 1, 'gone' FROM k WHERE r BETWEEN 55 AND 59),
st AS (SELECT k, k - 1 AS s FROM k WHERE r BETWEEN 40 AND 49 UNION SELECT k, k - 35 FROM k WHERE r = 40 UNION SELECT k, k + 2 FROM k WHERE r = 44),
sc(k, via, d) AS (SELECT k, k, 0 FROM (SELECT k FROM st UNION SELECT s FROM st) UNION SELECT sc.k, st.s, sc.d + 1 FROM sc JOIN st ON sc.via = st.k WHERE sc.d < 14),
reach AS (SELECT k, via, min(d) AS d FROM sc GROUP BY k, via),
ent AS (SELECT k, name, NULL AS s, NULL AS sn FROM decl UNION ALL SELECT * FROM al),
asked AS (SELECT DISTINCT s AS m, name FROM (SELECT k - r + 40 + k % 10 AS s, unnest(['default', 'n' || (k - r + 39), 'own' || (k - r + 5), 'ring', 'n' || (k - r)]) AS name FROM k WHERE r >= 60 UNION ALL SELECT k - r + k % 40, 'n' || (k - r + k % 40) FROM k WHERE r >= 60)),
found AS (SELECT a.m, a.name, arg_min(e.k, (r.d, 'src/p' || e.k)) AS k FROM asked a JOIN (SELECT * FROM reach UNION SELECT k, k, 0 FROM have) r ON r.k = a.m AND (r.d = 0 OR a.name <> 'default') JOIN ent e ON e.k = r.via AND e.name = a.name GROUP BY a.m, a.name),
walk(m, name, k, n, hops) AS (SELECT m, name, k, name, 0 FROM found UNION ALL SELECT w.m, w.name, al.s, al.sn, w.hops + 1 FROM walk w JOIN al ON al.k = w.k AND al.name = w.n WHERE w.hops < 60)"""


def _resolved(t):
    parts = cut(modules.module_text(module_files(t)), "module-parts")
    of = lambda what: parts.where(F.col("what") == what)
    asked = of("imports").select(F.col("source").alias("module"), F.col("source_name").alias("name"))
    return modules.resolve_exports(of("declares"), of("alias"), of("star"), asked)


@query("j15_reexports", f"""WITH RECURSIVE {_MODULES}
SELECT 'src/p' || a.m AS module, a.name, 'src/p' || d.k AS target_module, d.n AS target_name, d.hops, CASE WHEN d.k IS NOT NULL THEN 'declared' WHEN a.name = 'ring' AND found.k IS NOT NULL THEN 'cycle' ELSE 'missing' END AS status
FROM asked a LEFT JOIN found ON a.m = found.m AND a.name = found.name LEFT JOIN (SELECT w.* FROM walk w JOIN decl ON decl.k = w.k AND decl.name = w.n) d ON d.m = a.m AND d.name = a.name""")
def _(t):
    """Imports through chains of up to 39 aliases and barrels that hand on each other in a ring."""
    return _resolved(t)


@query("j15_alias_chains", """WITH RECURSIVE k AS (SELECT p_partkey AS k, p_partkey % 100 AS r FROM part), al AS (SELECT k, 'n' || k AS name, k - 1 AS s, 'n' || (k - 1) AS sn FROM k WHERE r BETWEEN 1 AND 39)
SELECT 'src/p' || k AS module, name, CASE WHEN k - k % 100 IN (SELECT k FROM k) THEN k % 100 END AS hops, CASE WHEN k - k % 100 IN (SELECT k FROM k) THEN 'declared' ELSE 'missing' END AS status FROM al
UNION ALL SELECT 'src/p' || k, 'ring', NULL, CASE WHEN k - r + 54 <= (SELECT max(k) FROM k) THEN 'cycle' ELSE 'missing' END FROM k WHERE r BETWEEN 50 AND 54 UNION ALL SELECT 'src/p' || k, 'gone', NULL, 'missing' FROM k WHERE r BETWEEN 55 AND 59""")
def _(t):
    parts = cut(modules.module_text(module_files(t)), "module-parts")
    of = lambda what: parts.where(F.col("what") == what)
    return modules.resolve_exports(of("declares"), of("alias"), of("star"), of("alias")).select("module", "name", F.col("hops").cast("long").alias("hops"), "status")


@query("j15_effects", """SELECT 'src/p' || p_partkey || '.ts' AS path, unnest(['MUTATES_STATE', 'MUTATES_STATE', 'HANDLES_ERROR']) AS kind, unnest(['state', 'this.total', 'err']) AS name, unnest([8, 8, 7]) AS weight FROM part WHERE p_partkey % 100 = 0
UNION ALL SELECT 'src/p' || p_partkey || '.ts', unnest(['MUTATES_STATE', 'HANDLES_ERROR']), unnest(['local', 'then']), unnest([8, 7]) FROM part WHERE p_partkey % 100 >= 60""")
def _(t):
    return modules.effects(module_files(t)).select("path", "kind", "name", F.col("weight").cast("long").alias("weight"))
