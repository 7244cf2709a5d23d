"""XXH64 in DuckDB's SQL, for the operators' oracles."""

from __future__ import annotations

from .xxh64 import P1, P2, P3, P4, P5

_M = "18446744073709551616::UHUGEINT"


def _n(x: int) -> str:
    return f"{int(x)}::UHUGEINT"


def _bind(value: str, name: str, body: str) -> str:
    """body with `name` bound to value, which is computed once."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _turn(value: str, bits: int, name: str) -> str:
    return _bind(value, name, f"({name} * {1 << bits}::UHUGEINT) % {_M} + {name} // {1 << (64 - bits)}::UHUGEINT")


def _times(value: str, by: int) -> str:
    return f"(({value}) * {_n(by)}) % {_M}"


def _round(acc: str, lane: str, name: str) -> str:
    return _times(_turn(f"({acc} + {_times(lane, P2)}) % {_M}", 31, name), P1)


def xxh64(source: str, out: str, seed: int = 42) -> str:
    """CTEs that end in `out` (s, h): the hash, as UBIGINT, of the UTF-8 of every distinct s of the CTE `source`."""
    m = 1 << 64
    start = [(seed + int(P1) + int(P2)) % m, (seed + int(P2)) % m, seed, (seed - int(P1)) % m]
    acc = ", ".join(_round(f"a[{i}]", f"x[{i}]", f"r{i}") for i in range(1, 5))
    merged = " + ".join(_turn(f"acc[{i}]", t, f"t{i}") for i, t in ((1, 1), (2, 7), (3, 12), (4, 18)))
    merge = f"({merged}) % {_M}"
    folded = (
        f"list_reduce(list_prepend({merge}, acc), lambda w, v: ({_times('xor(w, ' + _round('0::UHUGEINT', 'v', 'q') + ')', P1)} + {_n(P4)}) % {_M})"
    )
    return f"""{out}_1 AS (
  SELECT s, list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda v: ('0x' || v)::UHUGEINT) AS b FROM (SELECT DISTINCT s FROM {source})
), {out}_2 AS (
  SELECT s, b, len(b) AS n,
         list_transform(range(len(b) // 8), lambda i: list_reduce(list_reverse(b[8 * i + 1 : 8 * i + 8]), lambda v, y: v * 256::UHUGEINT + y)) AS lanes
  FROM {out}_1
), {out}_3 AS (
  SELECT s, b, n, lanes, CASE WHEN n >= 32 THEN list_reduce(list_prepend([{", ".join(_n(x) for x in start)}],
           list_transform(range(n // 32), lambda i: lanes[4 * i + 1 : 4 * i + 4])), lambda a, x: [{acc}]) END AS acc
  FROM {out}_2
), {out}_4 AS (
  SELECT s, b, n, lanes, ((CASE WHEN n >= 32 THEN {folded} ELSE {_n((seed + int(P5)) % m)} END) + n::UHUGEINT) % {_M} AS h FROM {out}_3
), {out}_5 AS (
  SELECT s, b, n, list_reduce(list_prepend(h, lanes[4 * (n // 32) + 1 :]),
           lambda w, v: ({_times(_turn('xor(w, ' + _round('0::UHUGEINT', 'v', 'q') + ')', 27, 'z'), P1)} + {_n(P4)}) % {_M}) AS h
  FROM {out}_4
), {out}_6 AS (
  SELECT s, b, n, CASE WHEN n % 8 >= 4 THEN ({_times(_turn(f"xor(h, {_times('list_reduce(list_reverse(b[8 * (n // 8) + 1 : 8 * (n // 8) + 4]), lambda v, y: v * 256::UHUGEINT + y)', P1)})", 23, 'z'), P2)} + {_n(P3)}) % {_M}
              ELSE h END AS h
  FROM {out}_5
), {out}_7 AS (
  SELECT s, list_reduce(list_prepend(h, b[4 * (n // 4) + 1 :]), lambda w, y: {_times(_turn(f"xor(w, {_times('y', P5)})", 11, 'z'), P1)}) AS h
  FROM {out}_6
), {out}_8 AS (SELECT s, {_times(f"xor(h, h // {1 << 33}::UHUGEINT)", P2)} AS h FROM {out}_7
), {out}_9 AS (SELECT s, {_times(f"xor(h, h // {1 << 29}::UHUGEINT)", P3)} AS h FROM {out}_8
), {out} AS (SELECT s, xor(h, h // {1 << 32}::UHUGEINT)::UBIGINT AS h FROM {out}_9)"""
