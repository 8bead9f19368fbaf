"""``python -m glossoloom COMMAND ...`` on a local session; on a cluster call ``plans.commands.main`` with its session."""

import sys

from .plans.commands import main, parser
from .session import get_spark

if __name__ == "__main__":
    parser().parse_args()  # usage errors before a session starts
    sys.exit(main(get_spark(), sys.argv[1:]))
