"""Re-exports and effects on small modules."""

from codelattice.operators import modules


def test_reexports(spark):
    files = spark.createDataFrame([
        ("src/a.ts", "export const x = 1, hidden = 2; /* export const no = 1 */\nfunction loc() {}\nexport { loc, loc as other };\nexport default function f() {}"),
        ("src/barrel/index.ts", "export * from '../a';\nexport { x as y } from '../a.ts'; export { default as d } from '../a'"), ("src/top.ts", "export * from './barrel/index'\nexport { y as z } from './barrel/index'; export type { q } from './nowhere'"),
        ("src/self.ts", "export { me } from './self'; export * from './self'"), ("src/shadow.ts", "export const x = 2; export * from './a';"), ("n.ts", None),
        ("use.ts", "import { x, z as w } from './src/top';\nimport def, { default as again } from './src/top'; import pk from 'react'"),
    ], "path string, text string")
    parts = modules.module_text(files)
    of = lambda what: parts.where(f"what = '{what}'")
    imports = of("imports")
    assert {(r.name, r.source, r.source_name) for r in imports.collect()} == {("x", "src/top", "x"), ("w", "src/top", "z"), ("def", "src/top", "default"), ("again", "src/top", "default"), ("pk", "react", "default")}
    asked = spark.createDataFrame([("src/top", "x"), ("src/top", "z"), ("src/top", "default"), ("src/top", "q"), ("src/self", "me"), ("src/shadow", "x"), ("src/top", "other"), ("src/top", "d"), ("src/top", "no"), ("lost", "x")], "module string, name string")
    got = {(r.module, r.name): (r.target_module, r.target_name, r.hops, r.status) for r in modules.resolve_exports(of("declares"), of("alias"), of("star"), asked).collect()}
    assert got == {
        ("src/top", "x"): ("src/a", "x", 0, "declared"), ("src/top", "z"): ("src/a", "x", 2, "declared"), ("src/top", "default"): (None, None, None, "missing"), ("src/top", "q"): (None, None, None, "missing"),
        ("src/self", "me"): (None, None, None, "cycle"), ("src/shadow", "x"): ("src/shadow", "x", 0, "declared"), ("src/top", "other"): ("src/a", "other", 0, "declared"), ("src/top", "d"): ("src/a", "default", 1, "declared"),
        ("src/top", "no"): (None, None, None, "missing"), ("lost", "x"): (None, None, None, "missing"),
    }
    assert modules.resolve_exports(of("declares").limit(0), of("alias").limit(0), of("star").limit(0), asked).where("status = 'missing'").count() == 10


def test_effects(spark):
    text = "a.b.c = 1; x = 2; if (q.r == 1 || q.s === 2) {}\nthis.n += 1; list[0] = 3; const y = z.w;\nitems.sort(); m.get(1);\ntry {} catch (e) {} fetch(u).catch(() => 1); sock.on('error', f); sock.on('data', f)"
    got = {(r.line, r.kind, r["name"]) for r in modules.effects(spark.createDataFrame([("f", text), ("g", None)], "path string, text string")).collect()}
    assert got == {(1, "MUTATES_STATE", "a"), (2, "MUTATES_STATE", "this.n"), (2, "MUTATES_STATE", "list"), (3, "MUTATES_STATE", "items"), (4, "HANDLES_ERROR", "e"), (4, "HANDLES_ERROR", "fetch"), (4, "HANDLES_ERROR", "sock")}
