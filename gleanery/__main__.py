"""Command line: python -m gleanery query|report|health --data DIR [--as-of T] [filters]."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from gleanery.operators import browse, match, ranking
from gleanery.plans.opportunities import AS_OF, opportunities
from gleanery.plans.queries import QUERIES
from gleanery.session import build_session
from gleanery.sources import writers


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(prog="gleanery")
    a.add_argument("command", choices=("query", "report", "health"))
    a.add_argument("--data", required=True)
    a.add_argument("--as-of", default=AS_OF)
    a.add_argument("--out", default="report")
    a.add_argument("--all", action="store_true")
    a.add_argument("--soon", action="store_true")
    a.add_argument("--q")
    a.add_argument("--tier")
    a.add_argument("--country")
    a.add_argument("--funding")
    a.add_argument("--min-score", type=float, default=0.0)
    a.add_argument("--limit", type=int, default=20)
    o = a.parse_args(argv)
    spark = build_session()
    if o.command == "health":
        QUERIES["health_latest_run"](spark, o.data).show(100, truncate=False)
        return
    rows = match.evaluate(opportunities(spark, o.data), match.Profile(), o.as_of)
    if o.command == "report":
        best = rows.orderBy(*ranking.best_first()).limit(400)
        writers.write_csv(best, f"{o.out}/csv")
        writers.json_report(best, browse.statistics(rows, o.as_of), o.as_of).write.mode("overwrite").text(f"{o.out}/json")
        writers.markdown(rows.where("gate_pass")).write.mode("overwrite").text(f"{o.out}/md")
        return
    cond = browse.keyword(o.q, ("title", "field", "country")) & browse.equal(tier=o.tier, funding_type=o.funding) & (F.col("score") >= o.min_score)
    if not o.all:
        cond = cond & (F.col("status") == "active")
    if o.country:
        cond = cond & F.ilike(F.col("country"), F.lit(f"%{o.country}%"))
    if o.soon:
        cond = cond & F.col("deadline").isNotNull()
    browse.page(rows.where(cond), "deadline" if o.soon else "score", o.limit).select("id", "title", "country", "deadline", "score", "tier").show(o.limit, truncate=False)


if __name__ == "__main__":
    main()
