import sys

from foliospark.plans.cli import main

sys.exit(main())
