"""SQL fragments the comparison queries are put together from.

Masks are pixel sets here; only components and dilation look at runs.
"""

from __future__ import annotations

from .fixtures import leaf_sql

STRIDE = 2097152  # component codes are y * STRIDE + x


class Steps:
    """A growing list of named CTEs."""

    def __init__(self, base: str | None = None, n: int = 32):
        self.parts = [base if base is not None else leaf_sql(n)]
        if base is None:
            self.parts.append("fr as (select leaf_id, y, x from leaf_px)")
        self.n = n
        self.h = self.w = n
        self._i = 0

    def add(self, body: str, name: str | None = None) -> str:
        if name is None:
            self._i += 1
            name = f"s{self._i}"
        self.parts.append(f"{name} as materialized ({body})")
        return name

    def layer(self, cond: str, src: str = "leaf_px") -> str:
        return self.add(f"select leaf_id, y, x from {src} where {cond}")

    def dilate(self, m: str, kernel, times: int = 1) -> str:
        rows = self.add(f"select * from (values {','.join(map(str, kernel))}) t(dy,lo,hi)")
        for _ in range(times):
            m = self.add(
                f"select distinct leaf_id, cast(y-dy as int) y, cast(q.x as int) x from {self.runs(m)}, {rows},"
                f" lateral (select unnest(range(greatest(x0-hi, 0), least(x1+lo, {self.w}))) x) q where y-dy between 0 and {self.h - 1}"
            )
        return m

    def minus(self, a: str, b: str) -> str:
        return self.add(f"select leaf_id,y,x from {a} except select leaf_id,y,x from {b}")

    def both(self, a: str, b: str) -> str:
        return self.add(f"select leaf_id,y,x from {a} intersect select leaf_id,y,x from {b}")

    def either(self, *ms: str) -> str:
        return self.add(" union ".join(f"select leaf_id,y,x from {m}" for m in ms))

    def invert(self, m: str) -> str:
        return self.minus("fr", m)

    def erode(self, m: str, kernel, times: int = 1) -> str:
        return self.minus(m, self.dilate(self.invert(m), kernel, times))

    def close(self, m: str, kernel, times: int = 1) -> str:
        return self.erode(self.dilate(m, kernel, times), kernel, times)

    def open(self, m: str, kernel, times: int = 1) -> str:
        return self.dilate(self.erode(m, kernel, times), kernel, times)

    def runs(self, m: str) -> str:
        return self.add(
            "select leaf_id, y, cast(min(x) as int) x0, cast(max(x)+1 as int) x1 from ("
            f"select *, x - row_number() over (partition by leaf_id, y order by x) g from {m}) group by leaf_id, y, g"
        )

    def comps(self, m: str, conn: int = 8) -> str:
        """Runs with the code of their component's first pixel."""
        r = self.runs(m)
        t = 1 if conn == 8 else 0
        self._i += 1
        p = f"p{self._i}"
        self.parts.append(
            f"{p}(leaf_id,y,x0,x1,root) as (select leaf_id,y,x0,x1,y*{STRIDE}::bigint+x0 from {r}"
            f" union select b.leaf_id,b.y,b.x0,b.x1,p.root from {p} p join {r} b on b.leaf_id=p.leaf_id"
            f" and b.y between p.y-1 and p.y+1 and b.y<>p.y and b.x0 < p.x1+{t} and p.x0 < b.x1+{t}"
            f" where b.y*{STRIDE}::bigint+b.x0 > p.root)"
        )
        return self.add(f"select leaf_id,y,x0,x1,min(root) comp from {p} group by leaf_id,y,x0,x1")

    def comp_px(self, m: str, conn: int = 8) -> str:
        """Pixels with their component code."""
        c = self.comps(m, conn)
        return self.add(f"select c.leaf_id, c.y, cast(q.x as int) x, c.comp from {c} c, lateral (select unnest(range(x0,x1)) x) q")

    def holes(self, m: str) -> str:
        """Background pixels that the border cannot reach (4-connected)."""
        r = self.runs(self.invert(m))
        self._i += 1
        p = f"p{self._i}"
        self.parts.append(
            f"{p}(leaf_id,y,x0,x1) as (select leaf_id,y,x0,x1 from {r}"
            f" where x0=0 or y=0 or x1={self.w} or y={self.h - 1}"
            f" union select b.leaf_id,b.y,b.x0,b.x1 from {p} p join {r} b on b.leaf_id=p.leaf_id"
            f" and b.y in (p.y-1,p.y+1) and b.x0 < p.x1 and p.x0 < b.x1)"
        )
        rest = self.add(f"select * from {r} except select * from {p}")
        return self.add(f"select c.leaf_id, c.y, cast(q.x as int) x from {rest} c, lateral (select unnest(range(x0,x1)) x) q")

    def fill(self, m: str) -> str:
        return self.either(m, self.holes(m))

    def largest(self, m: str) -> str:
        c = self.comp_px(m)
        best = self.add(
            f"select leaf_id, comp from (select leaf_id, comp, row_number() over (partition by leaf_id order by count(*) desc, comp) r"
            f" from {c} group by leaf_id, comp) where r=1"
        )
        return self.add(f"select c.leaf_id,c.y,c.x from {c} c join {best} b using (leaf_id, comp)")

    def sized(self, m: str, lo: int, hi: int | None = None, extra: str = "true") -> str:
        c = self.comp_px(m)
        cond = f"count(*) >= {lo}" + (f" and count(*) <= {hi}" if hi is not None else "")
        ok = self.add(f"select leaf_id, comp from {c} group by leaf_id, comp having {cond}")
        return self.add(f"select c.leaf_id,c.y,c.x from {c} c join {ok} using (leaf_id, comp)")

    def closer(self, m: str, limit2: float) -> str:
        """Mask pixels with squared distance to the outside below a limit."""
        from ..operators.runs import disk_kernel

        grown = self.dilate(self.invert(m), disk_kernel(limit2))
        return self.both(m, grown)

    def select(self, final: str) -> str:
        return "with recursive " + ",\n".join(self.parts) + "\n" + final

    def digest(self, m: str, keys: str = "leaf_id") -> str:
        return self.select(
            f"select {keys}, count(*)::bigint px, sum(x)::bigint sum_x, sum(y)::bigint sum_y, sum(x*y)::bigint sum_xy"
            f" from {m} group by {keys}"
        )
