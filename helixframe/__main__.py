import sys

from .plans.cli import main

sys.exit(main())
