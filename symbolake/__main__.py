import sys

from symbolake.cli import main

sys.exit(main())
