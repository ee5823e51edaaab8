import sys

from webloom.plans.cli import main

sys.exit(main())
