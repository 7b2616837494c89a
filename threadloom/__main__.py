"""The command line."""

import sys

from .plans.main import main

sys.exit(main())
