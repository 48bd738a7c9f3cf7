"""Print the formatted physical plans of registered queries (default: the bench headline).

Usage: python tools/plans.py [sf_dir] [key ...]
"""

from __future__ import annotations

import sys

sys.path.insert(0, ".")
from bench import HEADLINE  # noqa: E402
from ridegrid.plans.registry import queries  # noqa: E402
from ridegrid.session import get_session  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or HEADLINE
    spark = get_session("local[8]")
    qs = queries()
    for key in keys:
        print(f"===== {key}")
        qs[key](spark, sf_dir).explain("formatted")


if __name__ == "__main__":
    main()
