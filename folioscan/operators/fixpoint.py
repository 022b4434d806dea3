"""Repair to a fixpoint: evaluate, mend what has a repair, and again, at most four times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.operators.graph import written
from folioscan.operators.results import violation_counts

MAX_ROUNDS = 4


def repair(state: DataFrame, evaluate: Callable[[DataFrame], DataFrame], fix: Callable[[DataFrame, DataFrame], DataFrame], max_rounds: int = MAX_ROUNDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(state, issues, rounds): state has file_id; evaluate gives issues (file_id, check_id); fix gives the state with
    the issues mended. A file leaves the loop when it is clean, or when its issues are as they were a round ago; only
    files that are still in it are evaluated and mended again. rounds has file_id and the number of fixes applied."""
    active, done, rounds, issues_done = state, [], [], []
    before: DataFrame | None = None
    for k in range(max_rounds + 1):
        issues = written(evaluate(active), "issues")
        now = written(violation_counts(issues), "counts")
        stay = now
        if before is not None:
            stay = now.join(before.withColumnRenamed("signature", "was"), "file_id").where(~F.col("signature").eqNullSafe(F.col("was"))).select("file_id", "signature")
        if k == max_rounds:
            stay = stay.limit(0)
        out = active.join(stay.select("file_id"), "file_id", "left_anti")
        done.append(out)
        issues_done.append(issues.join(stay.select("file_id"), "file_id", "left_anti"))
        rounds.append(out.select("file_id", F.lit(k).alias("rounds")).distinct())
        active = written(fix(active.join(stay.select("file_id"), "file_id", "left_semi"), issues), "state")
        if not active.limit(1).count():
            break
        before = now
    join = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(join(parts[1:]))
    return join(done), join(issues_done), join(rounds)
