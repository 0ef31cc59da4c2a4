"""Print the operators that matter (exchanges, joins, windows, scans) of queries' plans.

    python tools/show_plans.py NAME ...
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from canvasser.plans import catalogue  # noqa: E402
from canvasser.session import local_session  # noqa: E402

KEEP = r"Exchange|Join|Window|Aggregate|Scan|Sort|Python|Pandas|Generate|Cartesian|Nested|Limit|TakeOrdered|Union|Subquery"


def main() -> None:
    spark = local_session()
    # Broadcast joins hide the shuffles a large table would need.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for name in sys.argv[1:]:
        df = catalogue.callables()[name](spark, "/root/testdata/sf0.01")
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"=== {name}")
        for line in plan.splitlines():
            if re.search(KEEP, line):
                print(re.sub(r"#\d+L?", "", line)[:190])


if __name__ == "__main__":
    main()
