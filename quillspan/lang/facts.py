"""Lineage facts of a SAS program, from its syntax tree: which columns and tables each table comes from, and what controls its rows."""

from __future__ import annotations

from quillspan.lang import ast as A
from quillspan.lang.programs import parse_sas


def facts(text: str, schemas: dict[str, list[str]] | None = None) -> list[tuple[str, str, str, str, str]]:
    """Distinct (kind, target table, target column, source table, source column), sorted; absent parts are ''.

    schema: the target has the column; ds: the target reads the source; col: the column's value comes from it; ctl: rows depend on it.
    """
    known = {k.lower(): [c.lower() for c in v] for k, v in (schemas or {}).items()}
    out: set = set()

    def full(name: str) -> str:
        return name if "." in name else f"work.{name}"

    def columns(e) -> list[A.Col]:
        return [x for x in A.walk(e) if isinstance(x, A.Col)]

    def select(q: A.Select, target: str) -> list[str]:
        names: list[str] = []
        for c in q.cores:
            scope: dict[str, dict[str, list[tuple[str, str]]]] = {}
            for s in [c.source, *(j.source for j in c.joins)]:
                if isinstance(s, A.Table):
                    t = full(s.name)
                    out.add(("ds", target, "", t, ""))
                    scope[s.alias or s.name.rpartition(".")[2]] = {n: [(t, n)] for n in known.get(t, [])} | {"": [(t, "")]}
                else:  # a subquery passes its columns' own sources on
                    scope[s.alias or ""] = derived(s.query, target)

            def sources(x: A.Col) -> list[tuple[str, str]]:
                places = [scope[x.rel]] if x.rel in scope else list(scope.values())
                hit = [p for p in places if x.name in p] or places[:1]
                return [o for p in hit[:1] for o in p.get(x.name, [(p[""][0][0], x.name)] if "" in p else [])]

            own: list[str] = []
            for i, p in enumerate(c.cols):
                if isinstance(p.expr, A.Star):
                    for alias, cols in scope.items():
                        if p.expr.rel in (None, alias):
                            for n in (n for n in cols if n):
                                own.append(n)
                                out.update(("col", target, n, *o) for o in cols[n])
                    continue
                name = p.alias or (p.expr.name if isinstance(p.expr, A.Col) else f"_auto{i + 1}")
                own.append(name)
                out.update(("col", target, name, *o) for x in columns(p.expr) for o in sources(x))
                for sub in (x for x in A.walk(p.expr) if isinstance(x, A.Scalar)):
                    out.update(("col", target, name, *o) for os in derived(sub.query, target).values() for o in os)
            for e in [c.where, c.having, *c.group, *(j.on for j in c.joins)]:
                if e is not None:
                    aliases = {p.alias: p.expr for p in c.cols if p.alias}
                    out.update(("ctl", target, "", *o) for x in columns(e) for y in ([x] if x.rel or x.name not in aliases else columns(aliases[x.name])) for o in sources(y))
                    for sub in (x for x in A.walk(e) if isinstance(x, A.Scalar)):
                        out.update(("ctl", target, "", *o) for os in derived(sub.query, target).values() for o in os)
            names = names or own
        out.update(("schema", target, n, "", "") for n in names)
        return names

    def derived(q: A.Select, target: str) -> dict[str, list[tuple[str, str]]]:
        mark = f"?{len(out)}"
        select(q, mark)
        mine = [f for f in out if f[1] == mark]
        out.difference_update(mine)
        cols: dict[str, list[tuple[str, str]]] = {f[2]: [] for f in mine if f[0] == "schema"}
        for kind, _, col, t, c in sorted(mine):
            if kind == "col":
                cols.setdefault(col, []).append((t, c))
            elif kind in ("ds", "ctl"):
                out.add((kind, target, "", t, c))
        return cols

    for s in parse_sas(text):
        if s.kind == "sql":
            for name, q in s.args["creates"]:
                if name:
                    known[name] = select(q, name)
        elif s.kind == "data":
            body = s.args["body"]
            cols: dict[str, list[tuple[str, str]]] = {}
            for st in body:
                if st[0] == "input":
                    cols |= {n: [] for n, _, _ in st[1]}
            reads = [d for st in body for d in (st[1] if st[0] in ("set", "merge") else [st[1]] if st[0] == "first_row" else [])]
            for d in reads:
                for n in known.get(d["name"], []):
                    cols.setdefault(d.get("rename", {}).get(n, n), []).append((d["name"], n))
            ctl: set = set()

            def walk(sts: list) -> None:
                for st in sts:
                    if st[0] in ("if", "where"):
                        ctl.update(o for x in columns(st[1]) for o in cols.get(x.name, []))
                    elif st[0] == "if_then":
                        ctl.update(o for x in columns(st[1]) for o in cols.get(x.name, []))
                        walk(st[2])
                        walk(st[3] or [])
                    elif st[0] == "by":
                        ctl.update(o for n, _ in st[1] for o in cols.get(n, []))
                    elif st[0] == "assign":
                        cols[st[1]] = sorted({o for x in columns(st[2]) for o in cols.get(x.name, [])})

            walk(body)
            keep = next((st[1] for st in body if st[0] == "keep"), None)
            drop = {n for st in body if st[0] == "drop" for n in st[1]}
            for o in s.args["outputs"]:
                t = o["name"]
                kept = [n for n in cols if (keep is None or n in keep) and n not in drop and n not in o.get("drop", [])]
                known[t] = kept
                out.update(("ds", t, "", d["name"], "") for d in reads)
                out.update(("ctl", t, "", *c) for c in ctl)
                for n in kept:
                    out.add(("schema", t, n, "", ""))
                    out.update(("col", t, n, *c) for c in cols[n])
        elif s.kind == "sort":
            src, t = s.args["data"]["name"], s.target
            known[t] = known.get(src, [])
            out.add(("ds", t, "", src, ""))
            out.update(("ctl", t, "", src, b) for b, _ in s.args["by"])
            for n in known[t]:
                out.add(("schema", t, n, "", ""))
                out.add(("col", t, n, src, n))
    return sorted(out)
