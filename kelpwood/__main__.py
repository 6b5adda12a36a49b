"""``python -m kelpwood NAME FOLDER [ROWS]``: rows of a tool or query."""

import sys

from .tools import TOOLS, main

if len(sys.argv) < 3:
    print(__doc__, "\n\nTools:", ", ".join(sorted(TOOLS)))
else:
    main(sys.argv[1:])
