"""Result tables as plain text, for a console. They are bounded by the limits of the queries that made them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import recommend


def _rows(df: DataFrame, *order: str) -> list[dict]:
    return [r.asDict() for r in df.orderBy(*order).collect()]


def results(found: DataFrame) -> str:
    rows, out = _rows(found, "rank"), []
    for r in rows:
        out.append(f"{r['rank']}. {r['product_name']}")
        out += [f"   {k.capitalize():<7}: {r[k]}" for k in ("price", "rating", "info", "score") if r.get(k) not in (None, "")]
    if rows and rows[0]["total_matches"] > len(rows):
        out.append(f"Showing {len(rows)} of {rows[0]['total_matches']} matching products.")
    return "\n".join(out) or "No matching products found."


def fuzzy_results(found: DataFrame) -> str:
    rows = _rows(found, "rank")
    lines = [f"{r['rank']}. {r['product_name']}  matched: {r['matched']}  distance: {r['distance']}  score: {r['score_text']}" for r in rows]
    return "\n".join(lines) or "No similar products found."


def prefix_results(found: DataFrame, shown: int = 10) -> str:
    rows = _rows(found, "rank")
    lines = [f"{r['rank']}. {r['product_name']}\n   File : {r['file_name']}" for r in rows[:shown]]
    if len(rows) > shown:
        lines.append(f"Showing {shown} of {len(rows)} matching products.")
    return "\n".join(lines) or "No matching products found."


def recommendations(decided: DataFrame) -> str:
    decided = decided.persist()
    chosen = _rows(recommend.selected(decided), "slot")
    if not chosen:
        return "No products available for recommendation."
    width = max(len(r["product_name"]) for r in chosen)
    out = [f"{r['slot']}. {r['product_name']:<{width}}  {r['category']}  {r['brand']}  {r['score']}" for r in chosen]
    out.append("Not selected:")
    out += [f"  - {r['product_name']}  {r['reason']}" for r in _rows(recommend.rejected(decided), "position")] or ["  (every candidate was selected)"]
    checks = _rows(recommend.constraints(decided), "kind", "label")
    out += [f"{r['label']}  {r['used']} / {r['allowed']}  {'OK' if r['ok'] else 'FAIL'}" for r in checks]
    out.append("All constraints satisfied." if all(r["ok"] for r in checks) else "Warning: a constraint was violated.")
    decided.unpersist()
    return "\n".join(out)


def timing(measured: dict) -> str:
    lines = [f"{k:<10}: {v:.4f} ms" for k, v in measured["ms"].items()]
    return "\n".join([f"count     : {measured['count']}", *lines, f"winner    : {measured['winner'] or 'no clear winner'}"])
