"""python -m sievewright [--direction D] [--policy P] TEXT: a text's verdict; 1 is returned if it is refused."""

from __future__ import annotations

import argparse
import re
import sys

from .plans.policy import INPUT, OUTPUT, RETRIEVAL, Policies
from .plans.scan import ScanPlan
from .plans.verdict import detections
from .session import build_session


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import functions as F

    options = argparse.ArgumentParser(prog="sievewright")
    options.add_argument("text")
    options.add_argument("--direction", choices=(INPUT, OUTPUT, RETRIEVAL), default=INPUT)
    options.add_argument("--policy")
    given = options.parse_args(argv)
    policy = Policies().get(given.policy)
    spark = build_session("sievewright-cli")
    df = ScanPlan(policy, given.direction).apply(spark.createDataFrame([(given.text,)], "text string"))
    row = df.select("verdict.valid", "verdict.severity", "verdict.risk_score", "verdict.sanitized_text", detections(F.col("verdict")).alias("found")).first()
    shown = re.sub(r"[\x00-\x08\x0b-\x1f\x7f]", "", row.sanitized_text)
    print(f"direction {given.direction}, policy {policy.name}, severity {row.severity}, risk {row.risk_score:g}: {'passed' if row.valid else 'BLOCKED'}\n{shown}")
    for d in row.found:
        print(f"  {d.scanner}\t{d.type}\t{d.score:g}\t{d.start}-{d.end}")
    return 0 if row.valid else 1


if __name__ == "__main__":
    sys.exit(main())
