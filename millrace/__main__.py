"""``python -m millrace module:Program [options] inputs... output``: run a program of this package's kind.

On a cluster the same command goes behind ``spark-submit``, with the module's file under ``--py-files``.
"""

import importlib
import sys

from millrace.plans.program import main

if __name__ == "__main__":
    module, _, name = sys.argv[1].partition(":")
    sys.exit(main(getattr(importlib.import_module(module), name), sys.argv[2:]))
