import os
import sys

sys.path.insert(0, os.path.dirname(__file__))

from tables import empty, odd  # noqa: E402, F401
