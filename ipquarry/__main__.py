import sys

from ipquarry.plans.cli import main

sys.exit(main())
